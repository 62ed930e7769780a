"""Training-data operators: media, near duplicates, filters, token counts, mixing, BPE."""

"""Token counts by dynamic programming over a trie.

Distinct pre-tokens are put into a trie; each node holds the best unigram score of the prefix that
it stands for, so a prefix that many pre-tokens share is computed once. The count of tokens on the
best path is stored where a pre-token ends. Pieces come from a vocabulary file; their log
probabilities follow Zipf's law by rank, -ln(rank + 1) less the norm, as the file's own
scores are merge ranks. A character without a piece costs one token per byte.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgspark.llm.scratch import lean
from imgspark.llm.shingles import in_slices

MARK = "▁"


class Pieces:
    """Piece -> log probability, and the cost of a byte."""

    def __init__(self, names: list[str]):
        norm = math.log(sum(1.0 / (r + 1) for r in range(len(names)))) if names else 0.0
        self.score = {p: -math.log(r + 1.0) - norm for r, p in enumerate(names)}
        self.longest = max(map(len, names), default=1)
        self.byte = -math.log(len(names) + 1.0) - norm - 10.0


@lru_cache(2)
def load_pieces(path: str) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return Pieces([sp.id_to_piece(i) for i in plain])


class Trie:
    """Nodes by (parent, character); emptied when it holds `most` nodes, so memory is bounded."""

    def __init__(self, pieces: Pieces, most: int = 600_000):
        self.pieces, self.most = pieces, most
        self.reset()

    def reset(self) -> None:
        self.next: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]
        self.ends: dict[str, tuple[int, float]] = {}

    def add(self, word: str) -> tuple[int, float]:
        """(tokens, score) of the pre-token, from the deepest node that is there already."""
        if len(self.best) > self.most:
            self.reset()
        nxt, best, count, score = self.next, self.best, self.count, self.pieces.score
        path, node, longest = [0], 0, self.pieces.longest
        for d, ch in enumerate(word, 1):
            key = (node, ch)
            node = nxt.get(key, -1)
            if node < 0:
                top, few = None, 0
                for j in range(max(0, d - longest), d):
                    s = score.get(word[j:d])
                    if s is not None:
                        s, n = best[path[j]] + s, count[path[j]] + 1
                        if top is None or s > top or s == top and n < few:
                            top, few = s, n
                if ch not in score:
                    n = len(ch.encode())
                    s, n = best[path[d - 1]] + n * self.pieces.byte, count[path[d - 1]] + n
                    if top is None or s > top or s == top and n < few:
                        top, few = s, n
                node = len(best)
                nxt[key] = node
                best.append(top)
                count.append(few)
            path.append(node)
        self.ends[word] = out = (count[node], best[node])
        return out

    def tokens(self, word: str) -> tuple[int, float]:
        got = self.ends.get(word)
        return got if got is not None else self.add(word)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, score) of every whole text.

    Pre-tokens lie between white space and start with the word mark. Null, empty and blank texts
    have none. Among paths of equal score the one with fewer tokens counts. Rows repeat as they
    occur; other columns are ignored; an empty table gives an empty table. No shuffle: the trie of
    a task holds its distinct pre-tokens, up to a bound, and starts again beyond it.
    """

    def run(batches):
        import pyarrow as pa

        trie = Trie(load_pieces(path))
        for batch in in_slices(batches):
            n, tokens, scores = [], [], []
            for text in batch.column(1).to_pylist():
                words = text.split() if text else []
                got = [trie.tokens(MARK + w) for w in words]
                n.append(len(words))
                tokens.append(sum(g[0] for g in got))
                scores.append(round(math.fsum(g[1] for g in got), 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "n_pretokens", "n_tokens", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(lean(run), "doc_id long, n_pretokens long, n_tokens long, score double")

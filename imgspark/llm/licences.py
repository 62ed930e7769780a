"""Licence scans: a trained paragraph classifier on sparse word n-grams, with DataFrame functions only.

A softmax regression over word n-grams tells licence families from each other and from other text.
It is fitted on the driver from the templates below and made negatives, a fixed number of rows. A
paragraph's class is unknown unless its probability passes a threshold calibrated on held-out
rows, among them notices of licences without a family. A prediction is confirmed if, of all templates of
which the paragraph has enough n-grams and all the words that tell it from other licences (names, versions,
variants), the one that it has most of is of that family; notices without a family take part in this.
Features are all n-grams of a paragraph. That rights are reserved counts only where the sentence ends there, and
only in documents without another confirmed licence; a GNU licence without a version, only where no version is confirmed.

A paragraph ends with a blank line, or with a line that ends a sentence; so the lines of a wrapped
notice are judged together. Each line of a paragraph is judged by itself too, and what a line
claims and its template confirms goes before what the whole paragraph claims of the same family; a
confirmed claim of another family stands beside it.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ends a sentence, in templates and in words.
STOP = "§"
#: Fixed phrases by family: the customary notices of public licences, and their names.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
        "spdx-license-identifier apache-2.0",
        "apache license 2.0",
        "license apache-2.0",
    ],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "spdx-license-identifier mit",
        "mit license",
    ],
    "gpl": [
        "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license",
        "this work is licensed under the gnu general public license",
        "gnu general public license",
    ],
    "gpl-3.0": [
        "this work is licensed under the gnu general public license version 3",
        "you can redistribute it and/or modify it under the terms of the gnu general public license version 3",
        "spdx-license-identifier gpl-3.0-only",
        "spdx-license-identifier gpl-3.0-or-later",
        "redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "terms of the gnu general public license as published by the free software foundation version 3 of the license",
        "gnu general public license v3.0",
        "gnu general public license version 3",
        "licensed under gplv3",
    ],
    "gpl-2.0": [
        "this work is licensed under the gnu general public license version 2",
        "you can redistribute it and/or modify it under the terms of the gnu general public license version 2",
        "spdx-license-identifier gpl-2.0-only",
        "spdx-license-identifier gpl-2.0-or-later",
        "redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        "terms of the gnu general public license as published by the free software foundation version 2 of the license",
        "gnu general public license v2.0",
        "gnu general public license version 2",
        "licensed under gplv2",
    ],
    "lgpl-3.0": [
        "this work is licensed under the gnu lesser general public license version 3",
        "you can redistribute it and/or modify it under the terms of the gnu lesser general public license version 3",
        "spdx-license-identifier lgpl-3.0-only",
        "spdx-license-identifier lgpl-3.0-or-later",
        "redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "terms of the gnu lesser general public license as published by the free software foundation version 3 of the license",
        "gnu lesser general public license v3.0",
        "gnu lesser general public license version 3",
        "licensed under lgplv3",
    ],
    "lgpl-2.1": [
        "this work is licensed under the gnu lesser general public license version 2.1",
        "you can redistribute it and/or modify it under the terms of the gnu lesser general public license version 2.1",
        "spdx-license-identifier lgpl-2.1-only",
        "spdx-license-identifier lgpl-2.1-or-later",
        "redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
        "terms of the gnu lesser general public license as published by the free software foundation version 2.1 of the license",
        "gnu lesser general public license v2.1",
        "gnu lesser general public license version 2.1",
        "licensed under lgplv2.1",
    ],
    "agpl-3.0": [
        "this work is licensed under the gnu affero general public license version 3",
        "you can redistribute it and/or modify it under the terms of the gnu affero general public license version 3",
        "spdx-license-identifier agpl-3.0-only",
        "spdx-license-identifier agpl-3.0-or-later",
        "redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "terms of the gnu affero general public license as published by the free software foundation version 3 of the license",
        "gnu affero general public license v3.0",
        "gnu affero general public license version 3",
        "licensed under agplv3",
    ],
    "cc-by-4.0": [
        "licensed under cc by 4.0",
        "this work is licensed under a creative commons attribution 4.0 international license",
        "spdx-license-identifier cc-by-4.0",
    ],
    "cc-by-sa-4.0": [
        "licensed under cc by-sa 4.0",
        "this work is licensed under a creative commons attribution-sharealike 4.0 international license",
        "spdx-license-identifier cc-by-sa-4.0",
    ],
    "cc-by-nd-4.0": [
        "licensed under cc by-nd 4.0",
        "this work is licensed under a creative commons attribution-noderivatives 4.0 international license",
        "spdx-license-identifier cc-by-nd-4.0",
    ],
    "cc-by-nc-4.0": [
        "licensed under cc by-nc 4.0",
        "this work is licensed under a creative commons attribution-noncommercial 4.0 international license",
        "spdx-license-identifier cc-by-nc-4.0",
    ],
    "cc-by-nc-sa-4.0": [
        "licensed under cc by-nc-sa 4.0",
        "this work is licensed under a creative commons attribution-noncommercial-sharealike 4.0 international license",
        "spdx-license-identifier cc-by-nc-sa-4.0",
    ],
    "cc-by-nc-nd-4.0": [
        "licensed under cc by-nc-nd 4.0",
        "this work is licensed under a creative commons attribution-noncommercial-noderivatives 4.0 international license",
        "spdx-license-identifier cc-by-nc-nd-4.0",
    ],
    "mpl-2.0": [
        "this source code form is subject to the terms of the mozilla public license v 2.0",
        "licensed under the mozilla public license version 2.0",
        "spdx-license-identifier mpl-2.0",
        "mozilla public license 2.0",
    ],
    "isc": [
        "released under the isc license",
        "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted",
        "spdx-license-identifier isc",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "released under the bsd license",
        "spdx-license-identifier bsd-3-clause",
    ],
    "proprietary": ["all rights reserved §", "copyright all rights reserved § no part may be reproduced without permission"],
}
#: Fixed notices of licences without a family. They are rivals of the templates: what has more of one of these is
#: confirmed for no family. The threshold is calibrated on rows made of every other one, which the fit does not see.
UNKNOWN = [
    "licensed under the eclipse public license version 2.0",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v 2.0",
    "this is free and unencumbered software released into the public domain",
    "licensed under the european union public licence version 1.2",
    "licensed under the common development and distribution license version 1.0",
    "licensed under the artistic license 2.0",
    "licensed under the boost software license version 1.0",
    "released under the zlib license",
    "released under cc0 1.0 universal public domain dedication",
    "licensed under cc by 3.0",
    "licensed under cc by-sa 2.5",
    "licensed under the open software license version 3.0",
    "licensed under the microsoft public license",
    "licensed under the gnu free documentation license version 1.3",
    "licensed under the academic free license version 3.0",
    "licensed under the educational community license version 2.0",
    "licensed under the python software foundation license version 2",
    "licensed under the sil open font license version 1.1",
    "licensed under the server side public license version 1",
    "licensed under the business source license version 1.1",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appear in all copies",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non-commercial and by any means",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document",
    "permission is granted to copy distribute and/or modify this document under the terms of the gnu free documentation license",
]
#: Fixed sentences that are no notices although they have words of one: every other one for the fit, the rest for calibration.
NEAR_MISSES = [
    "the museum said all rights reserved seats were sold out",
    "all rights reserved for members of the club are listed below",
    "the judge held that the rights reserved to the states are theirs",
    "she was licensed to drive and had permission to use the car",
    "permission is hereby granted to the committee to meet in public",
    "the redistribution of land and the use of water are permitted by law",
    "he works at mit and has a driving license",
    "under the terms of the contract any person may obtain a copy of the book",
    "the apache people signed a treaty in this version of the story",
    "the public works office issued a license for version 2 of the bridge",
    "a copyright notice appears in the software and the museum reserved a table",
    "the commons voted for attribution of the work to the international office",
]
NEGATIVE, RESERVED, GENERAL, VERSIONED = "none", "proprietary", "gpl", "^[al]?gpl-"
NAMES = {"apache", "mit", "bsd", "isc", "gnu", "lesser", "affero", "mozilla", "cc", "commons", "by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd", "attribution", "attribution-sharealike", "attribution-noderivatives", "attribution-noncommercial", "attribution-noncommercial-sharealike", "attribution-noncommercial-noderivatives"}
#: Fixed list: words of any text. N-grams of these alone are no features.
COMMON = frozenset("the of and to in is that for it was on be with are this from at or a an as you he her his not but".split())
ORDER = 3
#: Rows that the classifier is fitted on, for each family; half as many are held out for calibration.
ROWS = 160
CONFIRM = 0.6


#: What ends a sentence within a text.
SENTENCE = r"[.!?]+(?=\s|$)"


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9./+§-]+", text.lower()) if w.strip("./+-")]


def tokens_of(text: str) -> list[str]:
    """The words of a text with a mark at the end of each sentence and at its own end."""
    return [bare(w) for w in words(re.sub(SENTENCE, f" {STOP} ", text) + f" {STOP}")]


def bare(w: str) -> str:
    return w.strip("./+-")


def grams(tokens: list[str]) -> set[str]:
    """The 1- to 3-word n-grams with a word that is not in any text."""
    dull = [w in COMMON or w == STOP for w in tokens]
    return {" ".join(tokens[i : i + n]) for n in range(1, ORDER + 1) for i in range(len(tokens) - n + 1) if not all(dull[i : i + n])}


def telling(tokens: list[str]) -> list[str]:
    """The words without which a notice is another licence's or nobody's; of what ends a sentence, its last three."""
    told = [w for w in tokens if w in NAMES or any(c.isdigit() for c in w) or tokens[0] == "spdx-license-identifier"]
    return told + [" ".join(tokens[i - 2 : i + 1]) for i, w in enumerate(tokens) if w == STOP]


def templates() -> list[tuple[str, int, list[str]]]:
    """(family, number, words) of all templates; rivals have the family ''."""
    return [(f, i, [bare(w) for w in words(t)]) for f, ts in [*TEMPLATES.items(), ("", UNKNOWN)] for i, t in enumerate(ts)]


def made_rows(seed: int, rows: int, others: list[str]):
    """(tokens, family): templates with words dropped (none that tells) and strange words around;
    negatives mix the templates' words in random order, or strange words with one anchor, or are
    templates with a telling word replaced by a strange one or number, or are `others` treated as templates are."""
    rng = np.random.default_rng(seed)
    pool = sorted({bare(w) for ts in TEMPLATES.values() for t in ts for w in words(t)})
    strange = lambda n: ["".join(rng.choice(list("aeiounrstlmd"), rng.integers(2, 9))) for _ in range(n)]
    for family, texts in TEMPLATES.items():
        for i in range(rows):
            t = [bare(w) for w in words(texts[i % len(texts)])]
            if len(t) > 4:
                kept = {w for g in telling(t) for w in g.split()}
                t = [w for w in t if w in kept or rng.random() > 0.08] or t
            yield strange(rng.integers(0, 4)) + t + strange(rng.integers(0, 6)), family
    for i in range(rows * 2):
        t = list(rng.choice(pool, rng.integers(2, 9))) if i % 2 else strange(rng.integers(3, 12))
        t.insert(int(rng.integers(0, len(t) + 1)), str(rng.choice(["licence", "license", "permission", "copyright", "reserved", "gnu", "commons"])))
        yield t, NEGATIVE
    siblings = [t for ts in TEMPLATES.values() for x in ts if telling(t := [bare(w) for w in words(x)])]
    for i in range(rows * 2):
        t = list(siblings[i % len(siblings)])
        told = [w for g in telling(t) for w in g.split() if w != STOP]
        w = told[int(rng.integers(len(told)))]
        t[t.index(w)] = f"{rng.integers(5, 30)}.{rng.integers(0, 9)}" if w[0].isdigit() else strange(1)[0]
        yield strange(rng.integers(0, 4)) + t + strange(rng.integers(0, 6)), NEGATIVE
    for i in range(rows * 2):
        t = [w for w in map(bare, words(others[i % len(others)])) if rng.random() > 0.08]
        yield strange(rng.integers(0, 4)) + t + strange(rng.integers(0, 6)), NEGATIVE


@lru_cache(1)
def model():
    """(families, n-grams, weights, bias, threshold): fitted by gradient steps, calibrated on held-out rows."""
    families = [*TEMPLATES, NEGATIVE]
    # n-grams of rivals are counted, and have weights where a made row has them
    vocab = sorted({g for _, _, t in templates() for g in grams(t)} | {"licence", "license", "permission", "copyright", "reserved", "gnu", "commons"})
    place = {g: i for i, g in enumerate(vocab)}

    def matrix(seed, rows, others):
        data = [*made_rows(seed, rows, others)]
        x = np.zeros((len(data), len(vocab)))
        for r, (t, _) in enumerate(data):
            for g in grams(t):
                if g in place:
                    x[r, place[g]] = 1
        return x, np.array([families.index(f) for _, f in data])

    x, y = matrix(1, ROWS, NEAR_MISSES[::2])
    w, b = np.zeros((len(vocab), len(families))), np.zeros(len(families))
    goal = np.eye(len(families))[y]
    for _ in range(800):
        p = softmax(x @ w + b)
        w -= 2.0 * (x.T @ (p - goal) / len(x) + 1e-4 * w)
        b -= 2.0 * (p - goal).mean(0)
    hx, hy = matrix(2, ROWS // 2, [*UNKNOWN[::2], *NEAR_MISSES[1::2]])
    p = softmax(hx @ w + b)
    best, top = p.argmax(1), p.max(1)
    # the least threshold at which at most one in a hundred accepted rows is wrong; at 0 many are
    claimed = best != len(families) - 1
    for threshold in np.arange(0.0, 0.96, 0.05):
        taken = claimed & (top >= threshold)
        if not taken.any() or (best[taken] != hy[taken]).mean() <= 0.01:
            break
    right = (np.where(claimed & (top >= threshold), best, len(families) - 1) == hy).mean()
    return families, vocab, np.round(w, 6), np.round(b, 6), float(round(threshold, 2)), float(right)


@lru_cache(1)
def anchors() -> tuple[list[str], float]:
    """(words, reach): a text without any of these words cannot reach the threshold, even if it had every other
    n-gram that speaks for a family and none that speaks against it; reach is the share that such a text could
    have. Words that speak least are left out first, as long as that holds."""
    families, vocab, w, b, threshold, _ = model()
    none = families.index(NEGATIVE)
    gain = np.delete(np.maximum(w - w[:, [none]], 0), none, 1)
    start = np.delete(b - b[none], none)
    held = [{x for x in g.split() if x not in COMMON and x != STOP} for g in vocab]
    mass: dict[str, float] = {}
    for ws, m in zip(held, gain.max(1)):
        for x in ws:
            mass[x] = mass.get(x, 0.0) + float(m)
    kept, total = set(mass), start.copy()
    for x in sorted(mass, key=lambda x: (mass[x], x)):
        freed = [i for i, ws in enumerate(held) if x in ws and not (ws - {x}) & kept]
        after = total + gain[freed].sum(0)
        if (1 / (1 + np.exp(-after))).max() < threshold - 0.01:
            kept, total = kept - {x}, after
    return sorted(kept), float((1 / (1 + np.exp(-total))).max())


def softmax(z):
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def word_array(text) -> Column:
    ws = F.split(F.concat(F.regexp_replace(F.lower(text), SENTENCE, f" {STOP} "), F.lit(f" {STOP}")), "[^a-z0-9./+§-]+")
    return F.filter(F.transform(ws, lambda w: F.trim(w, F.lit("./+-"))), lambda w: w != "")


def gram_array(w) -> Column:
    n = F.size(w)
    out = [w]

    def joined(k):
        return F.transform(F.slice(w, 1, F.greatest(F.lit(0), n - k + 1)), lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + j) for j in range(1, k)]))

    out += [joined(k) for k in range(2, ORDER + 1)]
    return F.array_distinct(F.concat(*out))


#: Ends a paragraph: a line break after the end of a sentence, or one before a blank line.
BREAK = r"(?<=[.!?:;])[ \t\r]*\n|\n(?=[ \t\r]*\n)"


def licence_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, family, confidence, confirmed) of each paragraph or line that the classifier claims.

    paragraph is the number of the paragraph, from 0. Texts are whole; what has no anchor cannot reach the
    threshold and goes no further. The tables of weights and of template n-grams are broadcast: their size is that of TEMPLATES. Null and empty texts have no
    paragraphs; repeated rows with an equal id, null ids among them, count as one document; ties of
    classes go to the family last in order; other columns are ignored.
    """
    families, vocab, w, b, threshold, _ = model()
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.lower(F.col(f"`{text_col}`").cast("string")).alias("t"))
    parts = texts.select("doc_id", F.posexplode(F.split("t", BREAK)).alias("paragraph", "p"))
    # the lines of a paragraph, and, as number -1, the whole of one that has several
    units = F.filter(F.transform(F.split("p", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("s"))), lambda u: F.trim(u["s"]) != "")
    units = F.when(F.col("p").contains("\n"), F.concat(units, F.array(F.struct(F.lit(-1).alias("line"), F.col("p").alias("s"))))).otherwise(units)
    rows = parts.select("doc_id", "paragraph", F.explode(units).alias("u")).select("doc_id", "paragraph", "u.line", word_array(F.col("u.s")).alias("w"))
    rows = rows.filter(F.arrays_overlap("w", F.array(*map(F.lit, anchors()[0]))))
    table = spark.createDataFrame([(g, i, [float(v) for v in w[i]]) for i, g in enumerate(vocab)], "g string, i int, w array<double>")
    # n-grams that no template has don't go further; distinct, as rows of one id may repeat
    key = ["doc_id", "paragraph", "line"]
    hit = rows.select(*key, F.explode(gram_array(F.col("w"))).alias("g")).join(F.broadcast(table.select("g", "i")), "g").select(*key, "i").distinct()
    z = hit.join(F.broadcast(table.drop("g")), "i").groupBy(*key).agg(*[F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(len(families))])
    # arrays, as the filter below is moved under these projections and takes a copy of every expression with
    # it: written out by family, 19 sums for each of 19 shares were too much code to compile
    e = z.select(*key, F.transform(F.array(*[F.col(f"z{i}") + F.lit(float(v)) for i, v in enumerate(b)]), F.exp).alias("e"))
    named = F.array(*[F.lit(f) for f in families])
    best = F.array_max(F.transform("e", lambda x, i: F.struct(x.alias("e"), F.get(named, i).alias("family"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    claimed = e.select(*key, best.alias("b"), total.alias("total")).select(*key, F.col("b.family").alias("family"), (F.col("b.e") / F.col("total")).alias("p"))
    claimed = claimed.filter((F.col("family") != NEGATIVE) & (F.col("p") >= threshold))
    place = {g: i for i, g in enumerate(vocab)}
    every = templates()
    pattern = spark.createDataFrame([(f, i, place[g], int(g in telling(t))) for f, i, t in every for g in sorted(grams(t)) if g in place], "family string, template int, i int, tell int")
    size = spark.createDataFrame([(f, i, len(grams(t)), len(set(telling(t))) if f else 0) for f, i, t in every], "family string, template int, n int, n_tell int")
    found = hit.join(F.broadcast(pattern), "i").groupBy(*key, "family", "template").agg(F.count("*").alias("c"), F.sum("tell").alias("told"))
    found = found.join(F.broadcast(size), ["family", "template"]).filter((F.col("told") >= F.col("n_tell")) & (F.col("c") >= CONFIRM * F.col("n")))
    # the template that the unit has most of, whoever's it is, has to be the claimed family's
    found = found.groupBy(*key).agg(F.max(F.struct("c", (-F.col("n")).alias("less"), "family")).alias("top")).select(*key, F.col("top.family").alias("nearest"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key]
    out = claimed.alias("c").join(found.alias("s"), same, "left").select("c.*", F.coalesce(F.col("nearest") == F.col("family"), F.lit(False)).alias("confirmed"))
    # a paragraph speaks as a whole only where none of its lines is confirmed, or of a family that none has
    lines = Window.partitionBy("doc_id", "paragraph")
    out = out.withColumn("spoken", F.max((F.col("confirmed") & (F.col("line") >= 0)).cast("int")).over(lines)).withColumn("whole", F.max((F.col("line") < 0).cast("int")).over(lines))
    out = out.withColumn("told", F.collect_set(F.when(F.col("confirmed") & (F.col("line") >= 0), F.col("family"))).over(lines))
    mine = F.when(F.col("spoken") == 1, F.col("confirmed") & ((F.col("line") >= 0) | ~F.array_contains("told", F.col("family")))).otherwise((F.col("line") < 0) | (F.col("whole") == 0))
    out = out.filter(mine)
    # rights are reserved above most open notices: that alone says nothing where a licence is confirmed; nor does a
    # GNU licence without its version where one with it is
    document = Window.partitionBy("doc_id")
    beside = lambda c: F.max((F.col("confirmed") & c).cast("int")).over(document)
    out = out.withColumn("open", beside(F.col("family") != RESERVED)).withColumn("versioned", beside(F.col("family").rlike(VERSIONED)))
    out = out.filter(((F.col("open") == 0) | (F.col("family") != RESERVED)) & ((F.col("versioned") == 0) | (F.col("family") != GENERAL)))
    return out.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "family", F.round("p", 4).alias("confidence"), "confirmed")


def licence_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_paragraphs, n_claimed, n_confirmed, families) of every document; families: the
    confirmed ones, sorted, with commas. Rows with an equal id, null ids among them, show what any of
    them holds."""
    found = licence_paragraphs(docs).groupBy(F.col("doc_id").alias("d")).agg(F.count("*").alias("n_claimed"), F.sum(F.col("confirmed").cast("long")).alias("n_confirmed"), F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family"))))).alias("families"))
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.regexp_count(text, F.lit(BREAK)) + 1).cast("long").alias("n_paragraphs"))
    return base.join(found, F.col("doc_id").eqNullSafe(F.col("d")), "left").select("doc_id", "n_paragraphs", F.coalesce("n_claimed", F.lit(0)).alias("n_claimed"), F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), F.coalesce("families", F.lit("")).alias("families"))

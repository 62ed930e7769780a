"""Quality rules with adaptive thresholds, with DataFrame functions only.

Each group of language and source has a mergeable quantile sketch per measure: a histogram with
buckets of equal ratio (relative error (g - 1) / 2 at base g), which is exact to merge and the same
in any order of rows. Groups with few documents use the merged sketch of their language, then
that of all documents. A fence on the sketch's quartiles replaces fixed cutoffs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from imgspark.llm.scratch import Scratch

SPACE = r"[\x20\x09-\x0D]+"
BASE = 1.02
#: Documents below which a group's own sketch gives way to its language's, and that to all.
LEAST = 30
#: Measure -> (margin added to the fence, whether low values are outliers too). Whole numbers:
#: symbols per 1000 characters, repeated words per 1000 words, characters per 100 words.
MEASURES = {"symbols": (30, False), "repeats": (300, False), "word_length": (50, True)}
SPREAD = 3
MOST_BROADCAST = 100_000


def with_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus _q_n_words, _q_word_chars, _q_n_symbols, _q_n_dup_lines, _q_n_repeat_words,
    _q_base_failed and the measures _q_symbols, _q_repeats, _q_word_length. Null: an empty text.
    A column of docs that starts with _q_ is an error."""
    if clash := [c for c in docs.columns if c == "_q" or c.startswith("_q_")]:
        raise ValueError(f"columns that the quality rules make themselves: {clash}")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    d = docs.withColumn("_q_h", F.transform(F.filter(F.split(text, SPACE), lambda w: w != ""), lambda w: F.xxhash64(w)))
    d = d.withColumn("_q_n_words", F.size("_q_h").cast("long"))
    h = F.col("_q_h")
    d = d.withColumn("_q_w", F.when(F.col("_q_n_words") >= 3, F.transform(F.slice(h, 1, F.greatest(F.lit(1), F.size(h) - 2)), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))))
    w = F.col("_q_w")
    # windows found twice: sort them with their places and keep those equal to a neighbour
    some = F.size(F.array_distinct(w)) < F.size(w)
    d = d.withColumn("_q_s", F.when(some, F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    s = F.col("_q_s")

    def same(e, j, step):
        return F.coalesce(F.get(s, j + step)["x"] == e["x"], F.lit(False))

    places = F.transform(s, lambda e, j: F.when(F.when(j > 0, same(e, j, -1)).otherwise(False) | same(e, j, 1), e["i"]))
    d = d.withColumn("_q_p", F.when(s.isNotNull(), F.sort_array(F.filter(places, lambda p: p.isNotNull()))))
    p = F.col("_q_p")
    covered = F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("_q_lines", lines)
    d = d.withColumn("_q_n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    d = d.withColumn("_q_n_dup_lines", (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"))
    d = d.withColumn("_q_word_chars", (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long"))
    d = d.withColumn("_q_n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
    d = d.drop("_q_h", "_q_w", "_q_s", "_q_p", "_q_lines")
    n = F.col("_q_n_words")
    d = (
        d.withColumn("_q_base_failed", (n < 50) | (F.col("_q_n_repeat_words") * 100 > n * 50))
        .withColumn("_q_symbols", F.floor(F.col("_q_n_symbols") * 1000 / F.greatest(F.lit(1), "_q_word_chars")))
        .withColumn("_q_repeats", F.floor(F.col("_q_n_repeat_words") * 1000 / F.greatest(F.lit(1), "_q_n_words")))
        .withColumn("_q_word_length", F.floor(F.col("_q_word_chars") * 100 / F.greatest(F.lit(1), "_q_n_words")))
    )
    # one generated row a document: later filters stay above it instead of repeating the metrics
    rest = [F.col(f"`{c}`") for c in docs.columns]
    made = [c for c in d.columns if c.startswith("_q_")]
    return d.select(*rest, F.explode(F.array(F.struct(*made))).alias("_q")).select(*rest, *[F.col(f"_q.{c}").alias(c) for c in made])


def bucket(x) -> Column:
    """Bucket of a whole number: -1 for 0, else the i with BASE^(i-1) < x <= BASE^i."""
    return F.when(x <= 0, F.lit(-1).cast("long")).otherwise(F.ceil(F.ln(x.cast("double")) / F.lit(math.log(BASE))))


def bucket_value(i) -> Column:
    return F.when(i < 0, F.lit(0.0)).otherwise(F.pow(F.lit(BASE), i.cast("double")) * F.lit(2.0 / (BASE + 1)))


def sketches(measured: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, source, measure, bucket, n): the sketch of each group, from documents that pass the base rules."""
    kinds = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(f"_q_{m}")).alias("bucket")) for m in MEASURES])
    rows = measured.filter("not _q_base_failed").select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{source}`").cast("string").alias("source"), F.explode(kinds).alias("k"))
    return rows.groupBy("lang", "source", "k.measure", "k.bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, total, q25, q50, q75) of merged sketches."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    over = Window.partitionBy(*keys, "measure")
    merged = merged.withColumn("upto", F.sum("n").over(over.orderBy("bucket"))).withColumn("total", F.sum("n").over(over))

    def at(q):
        reached = F.col("upto") > F.floor((F.col("total") - 1) * q / 100)
        return bucket_value(F.min(F.when(reached, F.col("bucket")))).alias(f"q{q}")

    return merged.groupBy(*keys, "measure").agg(F.max("total").alias("total"), at(25), at(50), at(75))


def thresholds(sketch: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, lo_<measure>, hi_<measure>): one row a group; least: see LEAST."""
    groups = sketch.select("lang", "source", "measure").distinct()
    out = groups
    for name, keys in (("by_own", ["lang", "source"]), ("by_lang", ["lang"]), ("by_all", [])):
        q = quartiles(sketch, keys).select(*[F.col(k).alias(f"k_{k}") for k in keys], F.col("measure").alias("k_m"), F.struct("total", "q25", "q50", "q75").alias(name))
        on = F.col("measure") == F.col("k_m")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"k_{k}"))
        out = out.join(q, on).drop("k_m", *[f"k_{k}" for k in keys])
    best = F.when(F.col("by_own.total") >= least, F.col("by_own")).when(F.col("by_lang.total") >= least, F.col("by_lang")).otherwise(F.col("by_all"))
    out = groups_fence(out.withColumn("q", best).select("lang", "source", "measure", "q"))
    return out


def groups_fence(rows: DataFrame) -> DataFrame:
    spread = (F.col("q.q75") - F.col("q.q25")) * SPREAD
    aggs = []
    for m, (margin, low) in MEASURES.items():
        mine = F.col("measure") == m
        aggs.append(F.max(F.when(mine, F.col("q.q75") + spread + margin)).alias(f"hi_{m}"))
        aggs.append((F.max(F.when(mine, F.col("q.q25") - spread - margin)) if low else F.lit(-1.0)).alias(f"lo_{m}"))
    return rows.groupBy("lang", "source").agg(*aggs)


def judged(measured: DataFrame, scratch: Scratch, lang_col: str = "lang", source_col: str = "source", least: int = LEAST) -> DataFrame:
    """The result of with_metrics, written before so that it is computed once, plus _q_kept.

    Kept: not failed by the base rules, and every measure within its group's fence. A group with no
    document that passes the base rules has no fence and needs none. Null language or source is a
    group of its own; null, empty and blank texts have no words and fail. Repeated rows count as
    often as they occur. An empty table gives an empty table. The sketches hold a row per group,
    measure and bucket; the thresholds, a row per group, are broadcast only if counted to be few.
    """
    limits = scratch.cut(thresholds(scratch.cut(sketches(measured, lang_col, source_col)), least))
    few = limits.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    limits = limits.select(F.col("lang").alias("_q_lang"), F.col("source").alias("_q_source"), *[F.col(c).alias(f"_q_{c}") for c in limits.columns[2:]])
    on = F.col(f"`{lang_col}`").cast("string").eqNullSafe(F.col("_q_lang")) & F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col("_q_source"))
    out = measured.join(F.broadcast(limits) if few else limits, on, "left")
    fits = ~F.col("_q_base_failed")
    for m in MEASURES:
        fits = fits & F.col(f"_q_{m}").between(F.col(f"_q_lo_{m}"), F.col(f"_q_hi_{m}"))
    out = out.withColumn("_q_kept", F.coalesce(fits, F.lit(False)))
    return out.drop("_q_lang", "_q_source", *[f"_q_{a}_{m}" for a in ("lo", "hi") for m in MEASURES])


def quality_rules(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    scratch = Scratch(docs.sparkSession, "quality")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    measured = scratch.cut(with_metrics(docs.select("doc_id", "text", "lang", "source")).drop("text"))
    out = judged(measured, scratch, least=least)
    return out.select("doc_id", *[F.col(f"_q_{n}").alias(n) for n in names], F.col("_q_kept").alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST) -> DataFrame:
    """The documents that are kept, with their own columns; nulls and repeated rows as in judged. What
    passes the base rules is written once with its metrics, which are then not computed again."""
    scratch = Scratch(docs.sparkSession, "quality")
    passed = scratch.cut(with_metrics(docs, text_col).filter("not _q_base_failed"))
    out = judged(passed, scratch, lang_col, source_col, least)
    return out.filter("_q_kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def _level_sql(name: str, keys: str) -> str:
    by = f"{keys}, " if keys else ""
    part = f"PARTITION BY {by}measure"
    value = lambda q: f"min(CASE WHEN upto > floor((total - 1) * {q} / 100) THEN bucket END)"
    cols = ", ".join(f"CASE WHEN {value(q)} < 0 THEN 0.0::DOUBLE ELSE pow({BASE}::DOUBLE, {value(q)}::DOUBLE) * {2.0 / (BASE + 1)!r}::DOUBLE END AS q{q}" for q in (25, 75))
    return f"""{name} AS (SELECT {by}measure, max(total) AS total, {cols} FROM (
  SELECT *, sum(n) OVER ({part} ORDER BY bucket) AS upto, sum(n) OVER ({part}) AS total
  FROM (SELECT {by}measure, bucket, sum(n) AS n FROM sk GROUP BY ALL)) GROUP BY ALL)"""


def sql() -> str:
    """The same rules for DuckDB."""
    hi = " AND ".join(
        f"({m} <= (SELECT hi FROM f WHERE f.measure = '{m}' AND f.lang IS NOT DISTINCT FROM d.lang AND f.source IS NOT DISTINCT FROM d.source))"
        + (f" AND ({m} >= (SELECT lo FROM f WHERE f.measure = '{m}' AND f.lang IS NOT DISTINCT FROM d.lang AND f.source IS NOT DISTINCT FROM d.source))" if low else "")
        for m, (_, low) in MEASURES.items()
    )
    margin = " ".join(f"WHEN '{m}' THEN {v[0]}" for m, v in MEASURES.items())
    kinds = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, CASE WHEN {m} <= 0 THEN -1 ELSE ceil(ln({m}::DOUBLE) / {math.log(BASE)!r}::DOUBLE) END AS bucket FROM d WHERE NOT base_failed" for m in MEASURES)
    return rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i] || chr(32) || w[i+1] || chr(32) || w[i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + j AS p FROM dup, (SELECT unnest([0, 1, 2]) AS j)) GROUP BY doc_id),
b AS (
  SELECT t.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN rep USING (doc_id)
), d AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_symbols * 1000 // greatest(1, word_chars) AS symbols, n_repeat_words * 1000 // greatest(1, n_words) AS repeats, word_chars * 100 // greatest(1, n_words) AS word_length
  FROM b
), sk AS (SELECT lang, source, measure, bucket, count(*) AS n FROM ({kinds}) GROUP BY ALL),
{_level_sql("own", "lang, source")},
{_level_sql("lng", "lang")},
{_level_sql("every", "")},
p AS (
  SELECT own.lang, own.source, own.measure,
    CASE WHEN own.total >= {LEAST} THEN own.q25 WHEN lng.total >= {LEAST} THEN lng.q25 ELSE every.q25 END AS q25,
    CASE WHEN own.total >= {LEAST} THEN own.q75 WHEN lng.total >= {LEAST} THEN lng.q75 ELSE every.q75 END AS q75
  FROM own JOIN lng ON own.lang IS NOT DISTINCT FROM lng.lang AND own.measure = lng.measure JOIN every ON own.measure = every.measure
), f AS (
  SELECT lang, source, measure, q75 + (q75 - q25) * {SPREAD} + CASE measure {margin} END AS hi, q25 - (q75 - q25) * {SPREAD} - CASE measure {margin} END AS lo FROM p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(NOT base_failed AND {hi}, false) AS kept FROM d
"""

"""Frames derived from the driver's tables, for Spark and, as the same definition, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgspark.frame import from_pixels


def gray8(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("p", "e"))
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("e").cast("double") + F.lit(0.5)) * 255)))
    return e.select(F.col("vec_id").alias("img_id"), F.expr("cast(p div 8 as int)").alias("y"), (F.col("p") % 8).cast("int").alias("x"), F.lit(0).alias("c"), v.cast("int").alias("v"))


def _stacked(spark, sf_dir, n: int) -> DataFrame:
    """Wide frames of n consecutive gray ones, where all n exist."""
    g = gray8(spark, sf_dir)
    k = F.col("img_id") % n
    cols = [F.max(F.when(k == i, F.col("v"))).alias(name) for i, name in zip(range(n), "rgba")]
    return g.groupBy(F.expr(f"img_id div {n}").alias("img_id"), "y", "x").agg(*cols, F.count("*").alias("n")).filter(F.col("n") == n).drop("n")


def rgb8(spark, sf_dir):
    return _stacked(spark, sf_dir, 3)


def rgba8(spark, sf_dir):
    return _stacked(spark, sf_dir, 4)


def mask8(spark, sf_dir):
    return gray8(spark, sf_dir).withColumn("v", F.when(F.col("v") >= 128, 255).otherwise(0))


def events_values(spark, sf_dir):
    """(event_id, v): a sample for each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", (F.floor(F.abs("value")) % 256).cast("int").alias("v"))


def ev16(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    full = e.agg(F.expr("count(*) div 256").alias("full"))
    e = e.crossJoin(F.broadcast(full)).filter("event_id div 256 < full")  # one row
    return e.selectExpr("event_id div 256 AS img_id", "cast((event_id % 256) div 16 as int) AS y", "cast(event_id % 16 as int) AS x", "0 AS c", "cast(floor(abs(value)) % 256 as int) AS v")


def pairs(px: DataFrame) -> DataFrame:
    """Two frames of 8 x 8 side by side, so that width and height differ."""
    return px.select(F.expr("img_id div 2").alias("img_id"), "y", (F.col("x") + 8 * (F.col("img_id") % 2)).cast("int").alias("x"), "c", "v")


#: The same of gray8.
PAIRS = "(SELECT img_id // 2 AS img_id, y, CAST(x + 8 * (img_id % 2) AS INT) AS x, c, v FROM gray8)"


def long3(wide: DataFrame, names: str = "rgb") -> DataFrame:
    return wide.select("img_id", "y", "x", F.posexplode(F.array(*names)).alias("c", "v"))


def frames_of(px: DataFrame, origin: str) -> DataFrame:
    return from_pixels(px, origin)


GRAY8 = """SELECT vec_id AS img_id, CAST(p // 8 AS INT) AS y, CAST(p % 8 AS INT) AS x, 0 AS c,
  CAST(greatest(0, least(255, floor((CAST(e AS DOUBLE) + CAST(0.5 AS DOUBLE)) * 255))) AS INT) AS v
  FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)"""


def _stacked_sql(n: int) -> str:
    cols = ", ".join(f"max(CASE WHEN img_id % {n} = {i} THEN v END) AS {c}" for i, c in zip(range(n), "rgba"))
    return f"SELECT img_id // {n} AS img_id, y, x, {cols} FROM gray8 GROUP BY img_id // {n}, y, x HAVING count(*) = {n}"


EV16 = """SELECT event_id // 256 AS img_id, CAST((event_id % 256) // 16 AS INT) AS y, CAST(event_id % 16 AS INT) AS x, 0 AS c,
  CAST(floor(abs(value)) % 256 AS INT) AS v FROM events WHERE event_id // 256 < (SELECT count(*) // 256 FROM events)"""
CTES = {
    "gray8": GRAY8,
    "rgb8": _stacked_sql(3),
    "rgba8": _stacked_sql(4),
    "mask8": "SELECT img_id, y, x, c, CASE WHEN v >= 128 THEN 255 ELSE 0 END AS v FROM gray8",
    "ev16": EV16,
    "rgbl": "SELECT img_id, y, x, c, CASE c WHEN 0 THEN r WHEN 1 THEN g ELSE b END AS v FROM rgb8, (SELECT unnest([0, 1, 2]) AS c)",
}

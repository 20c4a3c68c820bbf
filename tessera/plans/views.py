"""The generated tables seen as the engine's tables, in Spark and, word for word, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import log_odds
from tessera.session import load

THRESHOLD = 0.99


def _split_of(digest):
    first = F.substring(digest, 1, 1)
    return F.when(first < "a", "train").when(first < "d", "val").otherwise("test")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A video is an order, a frame a line number; the game is the priority, the label whether the line was returned."""
    lines, orders = load(spark, sf_dir, "lineitem", "orders")
    rows = lines.select("l_orderkey", "l_linenumber", "l_returnflag").join(orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("o_orderpriority").alias("game"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.col("l_orderkey").cast("string").alias("video_id"), F.col("l_linenumber").cast("int").alias("frame_id"),
    ).distinct()


FRAMES = """frames AS (
  SELECT DISTINCT o_orderpriority AS game, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
    CAST(l_orderkey AS VARCHAR) AS video_id, CAST(l_linenumber AS INTEGER) AS frame_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with many ties, one of them at the decision threshold."""
    lines, orders = load(spark, sf_dir, "lineitem", "orders")
    rows = lines.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_shipdate").join(orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    p = (F.col("l_quantity") * 2 - 1) / 100
    return rows.select(
        F.col("o_orderpriority").alias("game"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.col("l_orderkey").cast("string").alias("video_id"), F.col("l_linenumber").cast("int").alias("frame0_id"),
        (F.col("l_linenumber") + 2).cast("int").alias("frame1_id"), F.lit(2).alias("delta"), p.alias("p"), F.log(p / (1 - p)).alias("margin"),
    )


SCORED = """scored AS (
  SELECT o_orderpriority AS game, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, CAST(l_orderkey AS VARCHAR) AS video_id,
    CAST(l_linenumber AS INTEGER) AS frame0_id, CAST(l_linenumber + 2 AS INTEGER) AS frame1_id, 2 AS delta,
    (l_quantity * 2 - 1) / 100 AS p, ln(((l_quantity * 2 - 1) / 100) / (1 - (l_quantity * 2 - 1) / 100)) AS margin
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
d AS (SELECT *, CASE WHEN margin > ln(CAST(0.99 AS DOUBLE) / (1 - CAST(0.99 AS DOUBLE))) THEN 1 ELSE 0 END AS predicted FROM scored)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous scores: users are videos, five games, two kinds of event are positive; the step is the event's number."""
    e = load(spark, sf_dir, "events")
    p = F.col("value") / 500
    return e.select(
        F.concat(F.lit("g"), (F.col("user_id") % 5).cast("string")).alias("game"), F.col("event_type").isin("purchase", "signup").cast("int").alias("label"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("video_id"), F.col("event_id").alias("step"), "event_type", p.alias("p"), log_odds(p).alias("margin"),
    )


EVENTS = """ev AS (
  SELECT 'g' || CAST(user_id % 5 AS VARCHAR) AS game, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS label,
    'u' || CAST(user_id AS VARCHAR) AS video_id, event_id AS step, event_type, value / 500 AS p, ln((value / 500) / (1 - value / 500)) AS margin FROM events)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as hashed frames of split datasets: the source is the game, the text's hash its content."""
    d, labels = load(spark, sf_dir, "documents", "labels")
    known = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = d.select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_sha256")).join(known, "doc_id", "left")
    key = F.col("doc_id").cast("string")
    video = F.floor(F.col("doc_id") / 7).cast("string")
    return rows.select(
        _split_of(F.sha2(key.cast("binary"), 256)).alias("split"), F.col("source").alias("game"), F.coalesce("quality", F.lit(1)).cast("int").alias("label"),
        video.alias("video_id"), (F.col("doc_id") % 7).cast("int").alias("frame_id"), F.concat(F.lit("/data/"), "source", F.lit("/"), video, F.lit(".png")).alias("path"),
        "content_sha256", F.concat_ws("::", "source", video).alias("stable_source_id"),
    )


DOCS = """docs AS (
  SELECT CASE WHEN substr(sha256(CAST(doc_id AS VARCHAR)), 1, 1) < 'a' THEN 'train' WHEN substr(sha256(CAST(doc_id AS VARCHAR)), 1, 1) < 'd' THEN 'val' ELSE 'test' END AS split,
    source AS game, CAST(coalesce(q, 1) AS INTEGER) AS label, CAST(doc_id // 7 AS VARCHAR) AS video_id, CAST(doc_id % 7 AS INTEGER) AS frame_id,
    '/data/' || source || '/' || CAST(doc_id // 7 AS VARCHAR) || '.png' AS path, sha256(coalesce(text, '')) AS content_sha256,
    source || '::' || CAST(doc_id // 7 AS VARCHAR) AS stable_source_id
  FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) USING (doc_id))"""


def sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as metadata of sources."""
    labels = load(spark, sf_dir, "labels")
    return labels.select(F.col("doc_id").cast("string").alias("stable_source_id"), F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "").alias("negative_subtype"), (1 + F.col("quality")).cast("double").alias("sample_weight"))


SIDECAR = """side AS (
  SELECT CAST(doc_id AS VARCHAR) AS stable_source_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN '' END AS negative_subtype, CAST(1 + quality AS DOUBLE) AS sample_weight FROM labels)"""

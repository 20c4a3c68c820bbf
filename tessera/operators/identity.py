"""Content identities: one hash for each source, and one for a whole table that can be computed in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import canonical_sha256


def content_version_ids(frames: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, content_version_id``: SHA-256 of ``n|label:frame:hash|...`` in order; null where a frame has no hash."""
    tokens = F.array_sort(F.collect_list(F.struct("label", "frame_id", "content_sha256")))
    text = F.transform(tokens, lambda t: F.concat_ws(":", t["label"].cast("string"), t["frame_id"].cast("string"), t["content_sha256"]))
    hashed = F.coalesce(F.col("content_sha256"), F.lit("")) != ""
    grouped = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bool_and(hashed).alias("full"), F.array_join(text, "|").alias("t"))
    return grouped.select(*keys, F.when(F.col("full"), F.sha2(F.concat(F.col("n").cast("string"), F.lit("|"), "t"), 256)).alias("content_version_id"))


def line_hash(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def bucketed_fingerprint(rows: DataFrame, columns: list[str], buckets: int = 256) -> DataFrame:
    """``bucket, rows, fingerprint``: a hash of the sorted row hashes of each bucket.

    Rows go to buckets by their own hash, so the work is spread and the result does not depend on order. Choose more
    buckets for more rows: a bucket's hashes are sorted in one task.
    """
    digits = max(1, len(f"{buckets - 1:x}"))
    hashed = rows.select(line_hash(*columns).alias("h"))
    bucket = F.pmod(F.conv(F.substring("h", 1, digits), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    return hashed.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("fingerprint")
    )


def fingerprint(rows: DataFrame, columns: list[str], buckets: int = 256) -> DataFrame:
    """One row: the hash over the buckets' hashes in order."""
    parts = bucketed_fingerprint(rows, columns, buckets)
    ordered = F.array_sort(F.collect_list(F.struct("bucket", "fingerprint")))
    return parts.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.sha2(F.array_join(F.transform(ordered, lambda p: p["fingerprint"]), ""), 256).alias("fingerprint"))


def covers_content(frames: DataFrame) -> DataFrame:
    """Whether there are frames and all have a hash."""
    hashed = F.coalesce(F.col("content_sha256"), F.lit("")) != ""
    return frames.agg((F.count(F.lit(1)) > 0).alias("any"), F.coalesce(F.bool_and(hashed), F.lit(False)).alias("all")).select((F.col("any") & F.col("all")).alias("content_hash_check_enabled"))


def dataset_identity(spark: SparkSession, artifacts: dict[str, dict[str, str]]) -> DataFrame:
    """``split, artifact, sha256, n_files`` of what each split consumes: ``{split: {artifact: path}}``; files are hashed where they lie."""
    rows = None
    for split, named in sorted(artifacts.items()):
        for artifact, path in sorted(named.items()):
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            hashes = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("h"))
            one = hashes.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(" ", "name", "h")))), 256).alias("sha256"), F.count(F.lit(1)).alias("n_files"))
            one = one.select(F.lit(split).alias("split"), F.lit(artifact).alias("artifact"), "sha256", "n_files")
            rows = one if rows is None else rows.unionByName(one)
    return rows if rows is not None else spark.createDataFrame([], "split string, artifact string, sha256 string, n_files long")


def components_fingerprint(components: dict[str, str | None]) -> str:
    """SHA-256 of the components that are there, by name; empty where none is."""
    held = {name: value for name, value in components.items() if value}
    return canonical_sha256(held) if held else ""

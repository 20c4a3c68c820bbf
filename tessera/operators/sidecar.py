"""Metadata keyed by source: enrichment, validation, upsert, and what mining adds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import read_table, rows_digest, write_table

KEY = "stable_source_id"
FIELDS = ("negative_subtype", "scene_type", "capture_domain", "difficulty", "sample_weight")


def _filled(c: str):
    return F.nullif(F.col(c), F.lit(""))


def enrich(entries: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Left join: the sidecar's subtype where it has one, else the entry's; its weight where the source is known."""
    side = sidecar.select(KEY, F.col("negative_subtype").alias("__s"), F.col("sample_weight").alias("__w"), F.lit(True).alias("__known"))
    joined = entries.join(side, KEY, "left")
    return joined.withColumns(
        {"negative_subtype": F.coalesce(_filled("__s"), F.col("negative_subtype")), "sample_weight": F.when(F.col("__known"), F.col("__w")).otherwise(F.col("sample_weight"))}
    ).drop("__s", "__w", "__known")


def orphans(sidecar: DataFrame, index: DataFrame) -> DataFrame:
    """Sidecar keys that no source has."""
    return sidecar.select(KEY).join(index.select(KEY).distinct(), KEY, "left_anti")


def invalid(sidecar: DataFrame) -> DataFrame:
    """``rule, subject``: repeated or missing keys, and weights that are not positive and finite."""
    key = F.coalesce(F.col(KEY), F.lit(""))
    repeated = sidecar.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_key").alias("rule"), key.alias("subject"))
    missing = sidecar.where(key == "").select(F.lit("missing_key").alias("rule"), key.alias("subject"))
    w = F.col("sample_weight")
    bad = w.isNull() | F.isnan(w) | (w <= 0) | (w == float("inf"))
    return repeated.unionByName(missing).unionByName(sidecar.where(bad).select(F.lit("bad_weight").alias("rule"), key.alias("subject")))


def upsert(existing: DataFrame, incoming: DataFrame, on_conflict: str = "refuse") -> tuple[DataFrame, DataFrame]:
    """``(merged with its status, conflicts)``.

    Per field an absent or null incoming value keeps the current one; an empty subtype clears it. A different subtype
    over an existing one is a conflict: ``overwrite`` takes it, ``keep`` and ``refuse`` leave the current one, and a
    caller that refuses stops if there are conflicts. New rows get weight 1 unless they bring one.
    """
    if on_conflict not in ("refuse", "keep", "overwrite"):
        raise ValueError(f"unknown conflict policy {on_conflict!r}")
    fields = [f for f in FIELDS if f in existing.columns]
    old = existing.select(KEY, *[F.col(f).alias(f"__old_{f}") for f in fields], F.lit(True).alias("__had"))
    new = incoming.select(KEY, *[(F.col(f) if f in incoming.columns else F.lit(None)).alias(f"__new_{f}") for f in fields], F.lit(True).alias("__got"))
    both = old.join(new, KEY, "full_outer")
    had, got = F.coalesce("__had", F.lit(False)), F.coalesce("__got", F.lit(False))

    def current(f):
        return F.col(f"__old_{f}")

    def given(f):
        return F.col(f"__new_{f}")

    text = [f for f in fields if f != "sample_weight"]
    conflict = had & given("negative_subtype").isNotNull() & current("negative_subtype").isNotNull() & (given("negative_subtype") != current("negative_subtype"))
    merged = {}
    for f in text:
        value = F.nullif(F.trim(given(f)), F.lit("")) if f == "negative_subtype" else given(f)
        take = given(f).isNotNull() if f == "negative_subtype" else F.coalesce(F.trim(given(f)), F.lit("")) != ""
        if f == "negative_subtype" and on_conflict != "overwrite":
            take = take & ~F.coalesce(conflict, F.lit(False))
        merged[f] = F.when(F.coalesce(take, F.lit(False)), value).otherwise(current(f))
    merged["sample_weight"] = F.coalesce(given("sample_weight"), current("sample_weight"), F.lit(1.0))
    changed = F.lit(False)
    for f in fields:
        changed = changed | ~merged[f].eqNullSafe(current(f))
    status = F.when(~had, "new").when(got & changed, "updated").otherwise("unchanged")
    out = both.select(KEY, *[merged[f].alias(f) for f in fields], status.alias("status"))
    conflicts = both.where(conflict).select(KEY, current("negative_subtype").alias("current"), F.when(F.trim(given("negative_subtype")) == "", "<cleared>").otherwise(given("negative_subtype")).alias("incoming"))
    return out, conflicts


def not_ready_for_hard_negatives(sidecar: DataFrame, hard_subtypes: list[str]) -> DataFrame:
    """``reason`` rows that keep hard-negative sampling from working."""
    tagged = sidecar.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("negative_subtype").isin(hard_subtypes or [""]).cast("int")), F.lit(0)).alias("hard"))
    reasons = F.array_compact(
        F.array(F.when(F.col("n") == 0, "the sidecar is empty"), F.when(F.lit(not hard_subtypes), "no hard subtypes are named"), F.when((F.col("n") > 0) & (F.col("hard") == 0), "no row has a hard subtype"))
    )
    return tagged.select(F.explode(reasons).alias("reason"))


def write(rows: DataFrame, path: str) -> str:
    """The sidecar as a table, with its fingerprint on every row; refuses rows that :func:`invalid` finds."""
    _refuse(rows)
    fingerprint = rows_digest(rows)[1]
    write_table(rows.withColumn("metadata_fingerprint", F.lit(fingerprint)), path)
    return fingerprint


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """A written sidecar, or None where there is none; an error where rows and fingerprint do not belong together."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    found = read_table(spark, path, [KEY, "metadata_fingerprint"])
    rows = found.drop("metadata_fingerprint")
    _refuse(rows)
    stamps = {r[0] for r in found.select("metadata_fingerprint").distinct().limit(2).collect()}
    if stamps - {rows_digest(rows)[1]}:
        raise ValueError(f"{path}: the rows are not those of the fingerprint")
    return found


def _refuse(rows: DataFrame) -> None:
    problem = invalid(rows).first()
    if problem is not None:
        raise ValueError(f"sidecar: {problem['rule']} {problem['subject']!r}")

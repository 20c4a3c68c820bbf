"""Written tables: Parquet with the contract stamp, CSV and JSON-lines inputs, staged publication."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.schemas import CONTRACT_VERSION, require_columns, require_stamp, stamp


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    stamp(df).write.mode(mode).option("compression", "zstd").parquet(path)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = require_stamp(spark.read.parquet(path), path)
    return require_columns(df, columns, path) if columns else df


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or CSV with a header, all text."""
    if path.lower().rstrip("/").endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    return spark.read.parquet(path)


def read_log(spark: SparkSession, path: str, schema: str | T.StructType, contract: bool = False) -> DataFrame:
    """JSON lines with ``line_no`` in the order they were written; blank and broken lines are passed over.

    Records of :func:`append_log` say when they were appended and in what order; others go by their file's time, its path
    and the place in it. With ``contract`` a record of another version is an error.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else T.StructType(list(schema.fields))
    meta = F.struct(F.unix_micros(F.col("_metadata.file_modification_time").cast("timestamp")).alias("time"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"))
    lines = spark.read.text(path).select("value", meta.alias("file"), F.monotonically_increasing_id().alias("place")).where(F.trim("value") != "")
    parse = T.StructType([*fields.fields, T.StructField("_at", T.StructType.fromDDL("time long, place long")), T.StructField("_broken", T.StringType())])
    rows = lines.withColumn("r", F.from_json("value", parse, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    rows = rows.where(F.col("r").isNotNull() & F.col("r._broken").isNull())
    # a part is what one task appended, or a block of another file: few rows, which are put in order; inside, places are
    place = F.coalesce("r._at.place", "place")
    part = F.struct(F.coalesce("r._at.time", "file.time").alias("time"), F.shiftright(place, 33).alias("task"), "file.path", "file.begin")
    rows = rows.withColumns({"part": part, "place": place.bitwiseAND(F.lit((1 << 33) - 1))})
    order = rows.select("part").distinct().withColumn("number", F.row_number().over(Window.orderBy("part")))
    rows = rows.join(order, "part").withColumn("line_no", F.shiftleft(F.col("number").cast("long"), 33) + F.col("place"))
    out = rows.select("line_no", *[F.col(f"r.`{f.name}`").alias(f.name) for f in fields.fields]).orderBy("line_no")
    if contract:
        out = out.withColumn("contract_version", F.when(F.col("contract_version") == CONTRACT_VERSION, F.col("contract_version")).otherwise(F.raise_error(F.lit("a record has another contract version")).cast("int")))
    return out


def append_log(df: DataFrame, path: str) -> None:
    """Records as JSON lines, one new file a task; what is there stays. ``_at`` tells the order."""
    at = F.struct(F.lit(time.time_ns() // 1000).alias("time"), F.monotonically_increasing_id().alias("place"))
    df.select(F.to_json(F.struct(*df.columns, at.alias("_at"))).alias("value")).write.mode("append").text(path)


def canonical(value: object, compact: bool = True) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":") if compact else None)


def canonical_sha256(value: object, compact: bool = True) -> str:
    return hashlib.sha256(canonical(value, compact).encode()).hexdigest()


def rows_digest(df: DataFrame) -> tuple[int, str]:
    """``(rows, digest)``: sums of parts of each row's SHA-256, so neither order nor files matter, repeats do, and the sum is combined map-side."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring("row", at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 16, 31, 46)]
    n, *sums = df.select(row.alias("row")).agg(F.count(F.lit(1)), *parts).first()
    return n, hashlib.sha256("|".join(str(s) for s in (n, *sums)).encode()).hexdigest()


class Bundle:
    """Tables published together: staged, renamed, and only then named in a manifest, which readers require."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def publish(self, tables: dict[str, DataFrame], **facts: object) -> dict:
        if self._fs.exists(self._path(self.path)):
            raise FileExistsError(f"{self.path} is there already; a published bundle does not change")
        staged = f"{self.path}.staged"
        self._fs.delete(self._path(staged), True)
        counts, digests = {}, {}
        for name, df in tables.items():
            write_table(df, f"{staged}/{name}.parquet")
            counts[name], digests[name] = rows_digest(self.spark.read.parquet(f"{staged}/{name}.parquet"))
        if not self._fs.rename(self._path(staged), self._path(self.path)):
            raise OSError(f"cannot publish {self.path}")
        manifest = {"contract_version": CONTRACT_VERSION, "tables": counts, "digests": digests, **facts}
        manifest["bundle_id"] = canonical_sha256({"tables": counts, "digests": digests})
        self._put("manifest.json", canonical(manifest))  # last: without it there is no bundle
        return manifest

    def manifest(self) -> dict:
        if not self._fs.exists(self._path(f"{self.path}/manifest.json")):
            raise FileNotFoundError(f"{self.path} has no manifest: it was not published whole")
        text = "\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/manifest.json").collect())
        found = json.loads(text)
        if found.get("contract_version") != CONTRACT_VERSION:
            raise ValueError(f"{self.path}: contract version {found.get('contract_version')}, expected {CONTRACT_VERSION}")
        return found

    def read(self, name: str) -> DataFrame:
        if name not in self.manifest()["tables"]:
            raise KeyError(f"{self.path} has no table {name!r}")
        return read_table(self.spark, f"{self.path}/{name}.parquet")

    def problems(self) -> list[str]:
        """Tables that are missing or have other rows than the manifest says."""
        out, manifest = [], self.manifest()
        for name, n in manifest["tables"].items():
            at = f"{self.path}/{name}.parquet"
            if not self._fs.exists(self._path(at)):
                out.append(f"{name}: missing")
            elif rows_digest(self.spark.read.parquet(at)) != (n, manifest["digests"].get(name)):
                out.append(f"{name}: other rows than published")
        if manifest.get("bundle_id") != canonical_sha256({"tables": manifest["tables"], "digests": manifest["digests"]}):
            out.append("manifest: the bundle id is another")
        return out

    def _put(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(f"{self.path}/{name}"), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()


def write_report(path: str, rows: DataFrame, groups: dict[str, DataFrame], metrics: DataFrame, light: bool = False) -> None:
    """Metrics as JSON, error rows by type as Parquet, and, unless light, a CSV for each grouping."""
    metrics.write.json(f"{path}/metrics")
    rows.write.partitionBy("error_type").parquet(f"{path}/rows")
    for name, df in ({} if light else groups).items():
        df.write.option("header", True).csv(f"{path}/{name}")

"""Frame files as a table: ``<root>/<game>/<0|1>/<video><frame>.png``, with findings for everything else."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import frame_of, sample_id, video_of

PNG_START = "89504E470D0A1A0A"
#: Channels by PNG colour type: fixed values.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


@dataclass(frozen=True)
class ScanPolicy:
    extensions: tuple[str, ...] = (".png",)
    ignored_prefixes: tuple[str, ...] = ("_", ".")
    ignored_names: tuple[str, ...] = ("__pycache__", "cache", "caches", "tmp", "temp")
    ignored_globs: tuple[str, ...] = ()
    nested_severity: str = "warning"

    def ignored_directory(self, name):
        """Names compare in lower case, prefixes as written."""
        hit = F.lower(name).isin(*self.ignored_names)
        for prefix in self.ignored_prefixes:
            hit = hit | name.startswith(prefix)
        return hit

    def ignored_file(self, name):
        hit = F.lit(False)
        for glob in self.ignored_globs:
            hit = hit | F.lower(name).rlike("^" + re.sub(r"\\Z|\\z|\(\?s:|\)$", "", fnmatch.translate(glob.lower())) + "$")
        return hit

    def frame_file(self, name):
        return F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1))).isin(*self.extensions) & name.contains(".")


def png_header(content="content") -> dict:
    """``width, height, channels`` from the first 26 bytes; null where that is no PNG header."""
    data = F.col(content)
    head = F.hex(F.substring(data, 1, 8)) == PNG_START
    chunk = F.hex(F.substring(data, 13, 4)) == "49484452"
    ok = (F.octet_length(data) >= 26) & head & chunk
    number = lambda at: F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("int")
    kind = F.conv(F.hex(F.substring(data, 26, 1)), 16, 10).cast("int")
    table = F.create_map(*[F.lit(x) for pair in CHANNELS.items() for x in pair])
    return {"width": F.when(ok, number(17)), "height": F.when(ok, number(21)), "channels": F.when(ok, F.try_element_at(table, kind))}


def scan(spark: SparkSession, root: str, split: str, spec: tuple[int, int, int], policy: ScanPolicy | None = None, hashed: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(frames, findings)`` of a tree. Files are read by executors; each is judged by the first rule that it breaks.

    A file reader sees files only, so empty directories give no finding, and it never lists names that begin with ``_``
    or ``.``, so those are left out without one.
    """
    policy = policy or ScanPolicy()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    path = F.regexp_replace("path", r"^file:/+", "file:/")
    start = re.sub(r"^file:/+", "file:/", base)
    parts = F.split(F.substr(path, F.lit(len(start) + 2)), "/")
    rows = files.select(path.alias("path"), parts.alias("parts"), F.element_at(parts, -1).alias("name"), "length", "content")
    depth = F.size("parts")
    at = lambda i: F.get("parts", F.lit(i))
    header = png_header()
    rows = rows.withColumns({"game": at(0), "label_name": at(1), **header, "video_id": video_of("name"), "frame_id": frame_of("name")})
    directories = F.slice("parts", 1, depth - 1)
    pruned = F.exists(directories, lambda d: policy.ignored_directory(d))
    frame = policy.frame_file(F.col("name")) & ~policy.ignored_file(F.col("name"))
    size = (F.col("width") == spec[0]) & (F.col("height") == spec[1]) & (F.col("channels") == spec[2])
    kind = (
        F.when(pruned, "ignored_directory").when(depth < 2, "non_directory_at_game_level").when(depth < 3, "non_directory_at_label_level")
        .when(~F.col("label_name").isin("0", "1") & (depth == 3) & frame, "invalid_label_directory")
        .when(~F.col("label_name").isin("0", "1"), "non_label_directory_without_frames")
        .when(depth > 3, "unexpected_nested_directory")
        .when(policy.ignored_file(F.col("name")), "ignored_file_pattern").when(~policy.frame_file(F.col("name")), "non_frame_extension")
        .when(F.col("frame_id").isNull(), "invalid_filename").when(F.col("width").isNull() | F.col("channels").isNull(), "invalid_file")
        .when(~size, "unexpected_dimensions")
    )
    rows = rows.withColumn("kind", kind)
    errors = ("invalid_label_directory", "invalid_filename", "invalid_file", "unexpected_dimensions")
    severity = F.when(F.col("kind").isin(*errors), "error").when(F.col("kind") == "unexpected_nested_directory", policy.nested_severity).otherwise("ignored")
    findings = rows.where("kind is not null").select(F.lit(split).alias("split"), severity.alias("severity"), "kind", "path")
    digest = F.sha2("content", 256) if hashed else F.lit("")
    frames = rows.where("kind is null").select(
        F.lit(split).alias("split"), "game", F.col("label_name").cast("int").alias("label"), "video_id", "frame_id", "path",
        "width", "height", "channels", F.col("length").alias("file_size"), digest.alias("content_sha256"),
    )
    return frames.withColumn("sample_id", sample_id()), findings


def changed_files(spark: SparkSession, frames: DataFrame, root: str) -> DataFrame:
    """``path, problem`` of indexed files that are gone, changed, or were never hashed."""
    now = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    now = now.select(F.regexp_replace("path", r"^file:/+", "file:/").alias("path"), F.sha2("content", 256).alias("now"))
    joined = frames.select("path", "content_sha256").join(now, "path", "left")
    problem = F.when(F.coalesce("content_sha256", F.lit("")) == "", "missing_hash").when(F.col("now").isNull(), "missing_file").when(F.col("now") != F.col("content_sha256"), "changed")
    return joined.select("path", problem.alias("problem")).where("problem is not null")


def synthetic_pairs(spark: SparkSession, n: int) -> DataFrame:
    """A deterministic table of pairs: labels alternate, two games, four videos."""
    i = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("synthetic_"), (i % 2).cast("string")).alias("game"), (i % 2).cast("int").alias("label"), F.format_string("%02d", i % 4).alias("video_id"),
        i.cast("int").alias("frame0_id"), (i + 2).cast("int").alias("frame1_id"), F.lit(2).alias("delta"),
    )

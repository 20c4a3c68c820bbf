"""Column types of the engine's tables, as DDL, and the version stamp that written tables carry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTRACT_VERSION = 5
DELTAS = (1, 2, 3)

FRAMES = (
    "sample_id string, split string, game string, label int, video_id string, frame_id int, path string, "
    "width int, height int, channels int, file_size long, content_sha256 string"
)
SIDECAR = (
    "stable_source_id string, negative_subtype string, scene_type string, capture_domain string, difficulty string, sample_weight double"
)
FINDINGS = ("severity string, kind string, path string, error string")
PAIRS = ("game string, label int, video_id string, frame0_id int, frame1_id int, delta int, image0_path string, image1_path string")
REPORT_ROWS = (
    "game string, label int, video_id string, frame0_id int, frame1_id int, delta int, stable_source_id string, source_version_id string, "
    "negative_subtype string, logit0 double, logit1 double, margin double, p_positive double, predicted int, error_type string, threshold_band string"
)


def stamp(df: DataFrame) -> DataFrame:
    """The contract version as metadata of the first column; Parquet keeps it."""
    first = df.columns[0]
    return df.withColumn(first, F.col(f"`{first}`").alias(first, metadata={"contract_version": CONTRACT_VERSION}))


def require_stamp(df: DataFrame, what: str) -> DataFrame:
    """``df`` if it carries this contract version; an error otherwise, for there is no migration."""
    found = df.schema.fields[0].metadata.get("contract_version")
    if found != CONTRACT_VERSION:
        raise ValueError(f"{what}: contract version {found}, expected {CONTRACT_VERSION}")
    return df


def require_columns(df: DataFrame, names: list[str], what: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")
    return df

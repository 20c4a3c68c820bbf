"""The session settings the engine is tuned for."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(name: str = "tessera", cores: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter's settings win.

    ``conf`` keys use ``__`` for dots, e.g. ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(name)
    if cores is not None:
        builder = builder.master(f"local[{cores}]")
    settings = {
        "spark.sql.shuffle.partitions": str(cores or 8),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": memory,
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, *names: str):
    """Tables of a directory, as DataFrames in the order asked for."""
    tables = [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names]
    return tables[0] if len(tables) == 1 else tables


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, once a Spark application, so that their Python finds its functions."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera-package.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(archive))
    return spark

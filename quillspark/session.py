"""Makes the package importable on executors, and small tables parallel."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors of ``spark`` once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        top = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="quillspark-")) / "quillspark.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(target))
    return spark


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew if it has fewer partitions than there are cores.

    A file with a single row group is read by one task, however much is done
    to its rows afterwards.  Tables of many files come as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

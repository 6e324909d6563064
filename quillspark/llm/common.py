"""Helpers that the operators share: durable tables, row keys, Arrow maps."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent, a local session gets a folder of its own; on
    a cluster that is refused, since executors would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    return _OWN[app]


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read back.

    The plan is cut there: a lost executor costs only the tasks it ran, and
    what non-deterministic keys (``monotonically_increasing_id``) came out as
    is fixed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (in either case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow_map(df: DataFrame, rows, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with a function from a ``RecordBatch`` to a dict of columns.

    ``rows`` is called once per batch and returns ``{name: list or array}`` in
    the order of ``schema``; batches stay bounded by Spark's Arrow settings.
    """

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = rows(batch)
                yield pa.RecordBatch.from_arrays([v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for v in out.values()], names=list(out))

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as a list of str; a null text is an empty one."""
    return [t or "" for t in batch.column(name).to_pylist()]


BREAK = bytes(b if (chr(b).isalnum() or b >= 128) else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words as UTF-8; white space and ASCII punctuation separate."""
    return text.lower().encode("utf-8", "replace").translate(BREAK).split()


def keyed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names.

    ``keyed(df, doc_id="id", text="body")`` makes further columns of ``df``,
    clashing names included, irrelevant to the operator.
    """
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])

"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space between words (Python's ``bytes.split()`` uses the same set).
ASCII_WS = " \t\n\r\x0b\x0c"

#: Maps A-Z to a-z and leaves every other byte alone.
LOWER_AZ = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, read from the session (``spark.checkpoint.dir``).

    A folder is chosen here only on a local master with nothing configured
    (tests); on a cluster a missing setting is an error, because a folder of
    one machine is invisible to the others.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile
        folder = tempfile.mkdtemp(prefix="veilspark-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    ``codec`` names the Parquet compression (the session's if None).

    Cuts the lineage: work above is not repeated when executors are lost or
    when the result is used several times.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or ``base`` with underscores added, so that it clashes with no column."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list:
    """Python ``bytes`` (or None) of a string column, without decoding."""
    return column.cast(pa.large_binary()).to_pylist()


def held_out(doc_id, mod: int):
    """TRUE where crc32(doc_id as text) mod ``mod`` is 1 (NULL ids are never held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == 1, F.lit(False))

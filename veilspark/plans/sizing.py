"""Spreading of scan rows over cores.

:func:`spread` always: rows that are few bytes and much work (a table of keys, from which
texts are made and searched) lie in one or two splits however many rows they are.

:func:`balance` is off unless the session sets ``spark.veilspark.balanceScans`` (the local session
builder does): a table written as one large row group is read by one task
however big it is, which matters for benchmarks on a single file.  Joins carry
no size switches; Catalyst and AQE choose broadcasts by bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

SETTING = "spark.veilspark.balanceScans"


def spread(df: DataFrame, tasks_per_core: int = 4) -> DataFrame:
    """Rows dealt evenly over the session's cores, whatever their keys."""
    return df.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism * tasks_per_core))


def balance(df: DataFrame, key: str, tasks_per_core: int = 2) -> DataFrame:
    """Rows hash-partitioned by ``key`` where the session asks for it, else ``df``."""
    spark = df.sparkSession
    if spark.conf.get(SETTING, "false") != "true":
        return df
    return df.repartition(max(1, spark.sparkContext.defaultParallelism * tasks_per_core), key)

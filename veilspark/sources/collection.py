"""A vector collection as two plain Parquet tables.

``<root>/<name>/nodes`` holds the nodes, ``<root>/<name>/deleted`` the ids of
deleted ones.  Writes are appends only, and idempotent by node id: a node whose
id is already stored, or was deleted, is not written again, so a replayed
stream batch, a restarted stream or a second stream neither duplicates rows
nor brings deleted ones back.  Equal ids inside one call are one node.  Reads
leave deleted ids out.

Both tables are partitioned by a range of the id (``2 ** span_bits`` ids,
numbered modulo ``PARTS``), and a save reads the known ids of the ranges that
its own ids lie in, nothing else; rows that are known are neither moved again nor embedded.  Ids composed of a growing document key lie
side by side, so what a micro-batch reads does not grow with the table; a first
load reads nothing.

Two writers that save the same new id at the same time can both find it new:
``scan(distinct=True)`` then gives one of the rows, and ``compact`` writes a
collection without such rows, with the deleted ids folded in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

NODE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), False),
    T.StructField("embedding", T.ArrayType(T.FloatType()), False),
    T.StructField("created_at", T.TimestampNTZType(), True),   # wall-clock time, no zone
])
PART = T.StructField("part", T.IntegerType())
_DELETED = T.StructType([T.StructField("id", T.LongType()), PART])
SPAN_BITS = 32
PARTS = 4096
WRITERS = 8               # tasks that write one range, at most
NEAR_BITS = 16            # ids that are equal but for these bits go to one of them


def sanitize_name(name: str) -> str:
    """Keep alphanumerics only (``prompt_cache`` → ``promptcache``)."""
    return "".join(c for c in name if c.isalnum())


class Collection:
    """A node table ``(id, content, [metadata,] embedding, created_at)`` with a fixed dim."""

    def __init__(self, spark: SparkSession, root: str, name: str, dim: int,
                 include_metadata: bool = True, span_bits: int = SPAN_BITS):
        if dim <= 0:
            raise ValueError("vectors must have a positive dimension")
        self.spark, self.name, self.dim = spark, sanitize_name(name), int(dim)
        self.include_metadata, self.span_bits, self.root = include_metadata, int(span_bits), root
        self.base = f"{root.rstrip('/')}/{self.name}"
        self.schema = NODE_SCHEMA if include_metadata else T.StructType(
            [f for f in NODE_SCHEMA.fields if f.name != "metadata"])

    def _table(self, table: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.base}/{table}")

    def _check(self) -> None:
        def there(table):
            try:
                self._table(table, _DELETED)
                return True
            except AnalysisException:
                return False
        if not there("nodes"):
            raise RuntimeError(f"collection {self.name} does not exist")
        if there("dropped"):
            raise RuntimeError(f"collection {self.name} was dropped; it can no longer be queried")

    def _part(self, node_id):
        return F.pmod(F.shiftright(node_id, self.span_bits), F.lit(PARTS)).cast("int")

    def _append(self, df: DataFrame, table: str) -> None:
        df.write.mode("append").partitionBy("part").parquet(f"{self.base}/{table}")

    def create(self) -> "Collection":
        """Create if it does not exist (idempotent)."""
        for table, schema in (("nodes", self._nodes_schema()), ("deleted", _DELETED)):
            self.spark.createDataFrame([], schema).write.mode("ignore").partitionBy("part").parquet(f"{self.base}/{table}")
        return self

    def _nodes_schema(self):
        return T.StructType([*self.schema.fields, PART])

    def drop(self) -> None:
        """Later calls raise; the files are left to the storage retention policy."""
        self.spark.createDataFrame([], _DELETED).write.mode("ignore").parquet(f"{self.base}/dropped")

    def _live(self) -> DataFrame:
        return self._table("nodes", self._nodes_schema()).join(self._table("deleted", _DELETED), ["part", "id"], "left_anti")

    def scan(self, distinct: bool = False) -> DataFrame:
        """Every stored node that was not deleted; ``distinct``: one row per id, whoever wrote it."""
        self._check()
        live = self._live()
        if distinct:                                     # ids alone are grouped; full rows only where an id is double
            twice = live.groupBy("part", "id").agg(F.count("*").alias("n")).where("n > 1").select("part", "id")
            one = F.min_by(F.struct(*live.columns), F.struct("content", "created_at")).alias("row")
            live = live.join(twice, ["part", "id"], "left_anti").unionByName(
                live.join(twice, ["part", "id"], "left_semi").groupBy(F.col("id").alias("_id")).agg(one).select("row.*"))
        return live.select(*self.schema.names)

    def compact(self, name: str) -> "Collection":
        """A new collection of the live nodes, one row per id; ids deleted here stay deleted there."""
        new = Collection(self.spark, self.root, name, self.dim, self.include_metadata, self.span_bits).create()
        new._write(self.scan(distinct=True))
        self._table("deleted", _DELETED).distinct().repartition("part").write.mode("append").partitionBy("part") \
            .parquet(f"{new.base}/deleted")
        return new

    def _known(self, parts: list[int]) -> DataFrame:
        """(part, id) ever stored or deleted in the given ranges."""
        here = F.col("part").isin(parts)
        return self._table("nodes", self._nodes_schema()).where(here).select("part", "id").union(
            self._table("deleted", _DELETED).where(here).select("part", "id"))

    def _dealt(self, nodes: DataFrame) -> DataFrame:
        """Rows of a range and of near ids together: equal ids meet in one task, and a range has few writers."""
        salt = F.pmod(F.xxhash64(F.shiftright("id", NEAR_BITS)), F.lit(WRITERS))
        return nodes.withColumn("part", self._part(F.col("id"))).withColumn("_salt", salt).repartition("part", "_salt")

    def _write(self, nodes: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Append, each id once, from rows that may be dealt already."""
        rows = nodes if "_salt" in nodes.columns else self._dealt(nodes)
        # The first of an id is found in the order that the writer needs, before anything is embedded.
        same = Window.partitionBy("part", "id", "_salt").orderBy("content", "created_at")
        one = rows.withColumn("_n", F.row_number().over(same)).where("_n = 1").sortWithinPartitions("part", "id")
        self._append(self._checked(embed(one) if embed else one).select(*self.schema.names, "part"), "nodes")

    def _checked(self, nodes: DataFrame) -> DataFrame:
        """Embeddings as floats; another length than ``dim`` is an error."""
        emb = F.col("embedding").cast("array<float>")
        wrong = F.raise_error(F.lit(f"embedding dimension must be {self.dim}")).cast("array<float>")
        return nodes.withColumn("embedding", F.when(F.size(emb) == F.lit(self.dim), emb).otherwise(wrong))

    def save_nodes(self, nodes: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Append nodes whose id is new, each id once; ``created_at`` defaults to now; dim is enforced.

        ``embed`` adds the embedding to nodes that come without: texts are moved to the tasks that write
        them, not vectors, and nodes that are known already are never embedded.
        """
        self._check()
        cols = [F.col("id").cast("long").alias("id"), F.col("content").cast("string").alias("content")]
        if self.include_metadata:
            meta = F.col("metadata") if "metadata" in nodes.columns else \
                F.create_map().cast("map<string,string>")
            cols.append(meta.alias("metadata"))
        ts = F.col("created_at").cast("timestamp_ntz") if "created_at" in nodes.columns else F.lit(None)
        cols.append(F.coalesce(ts, F.localtimestamp()).alias("created_at"))
        rest = [c for c in nodes.columns if c not in (*self.schema.names, "metadata")] if embed else []
        new = nodes.select(*cols, *(["embedding"] if "embedding" in nodes.columns else []), *rest)
        stored = self._table("nodes", self._nodes_schema()).select("part").limit(1).count() or \
            self._table("deleted", _DELETED).select("part").limit(1).count()
        if not stored:
            return self._write(new, embed)
        # The rows are made and dealt once, for their ids and for what is written of them.
        dealt = self._dealt(new).persist(StorageLevel.DISK_ONLY)
        try:
            sizes = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}   # PARTS rows at most
            ids = dealt.select("part", "id")
            known = ids.join(self._known([p for p in sizes if p is not None]), ["part", "id"], "left_semi")
            n_known = known.count()
            if n_known < sum(sizes.values()):                # a replayed batch has nothing to write
                self._write(dealt.join(known.distinct(), ["part", "id"], "left_anti").drop("_salt", "part")
                            if n_known else dealt, embed)
        finally:
            dealt.unpersist()

    def delete_by_content(self, keys: DataFrame, content_col: str = "content") -> None:
        """Drop *every* node whose content equals a key's content (their ids are noted)."""
        k = keys.select(F.col(content_col).alias("content")).distinct()
        self._check()
        gone = self._live().select("part", "id", "content").join(k, "content", "left_semi").select("id", "part").distinct()
        self._append(gone, "deleted")

    def delete_where(self, cond) -> None:
        """Delete rows matching a predicate, by content (as S8 does)."""
        self.delete_by_content(self.scan().where(cond).select("content"))

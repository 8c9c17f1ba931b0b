"""Helpers shared by the training-data operators.

Lineage is cut only with Parquet tables in the folder that ``spark.checkpoint.dir`` names:
every executor can read them again after another one is lost.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds: rows may be very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def give_back() -> None:
    """Return memory that a Python worker has freed to the system: workers live on after a task,
    and later tasks, of other operators too, run beside what they hold."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in a local session without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        base = f"file://{tempfile.mkdtemp(prefix='prosestat-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables that were written and not yet deleted.
_WRITTEN: set[str] = set()


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: (table, its path)."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    _WRITTEN.add(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete tables that no later step reads."""
    for path in paths:
        _WRITTEN.discard(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Delete every table that operators have left behind. Results still read theirs, so call
    it once they are written."""
    release(spark, *list(_WRITTEN))


def splitmix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over uint64, wrapping."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(text: str = "text"):
    """The UTF-8 bytes of a text column, null as empty: Python then needs no decoding."""
    return F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")


def let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def id_cuts(rows: DataFrame, column: str, parts: int) -> list[int]:
    """Values of a long column that cut it into about ``parts`` runs of equal length."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    got = rows.agg(F.percentile_approx(column, at, 10 * parts).alias("cuts")).first()["cuts"]
    return sorted(set(got or []))


def bucket_of(column: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most the value (null: none), by binary search."""
    if not cuts:
        return F.lit(0)
    table, n = F.lit(cuts), len(cuts)
    steps = [1 << k for k in reversed(range(n.bit_length()))]
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(table, at + s - 1) <= column), at + s).otherwise(at))


def fields(schema: str) -> pa.Schema:
    """An Arrow schema from a short form such as ``doc_id long, sig binary``."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(n, kinds[k]) for n, k in re.findall(r"(\w+) ([\w<>]+)", schema)])


class UnionFind:
    """Path-halving union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = up[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))


def _contract(batches):
    """Union-find over one partition's links: a forest with as few links as it has nodes."""
    uf = UnionFind()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            uf.union(x, y)
    nodes = [x for x in uf.up if uf.find(x) != x]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([uf.find(x) for x in part], pa.int64())], names=["v", "r"])


#: Keys with over this share of all rows are salted, so there are at most as many as its inverse.
HEAVY_SHARE = 10_000
HEAVY_ROWS = 500


def looked_up(rows: DataFrame, right: DataFrame, key: str, other: str, total: int) -> DataFrame:
    """rows joined with right, in which ``key`` is unique. A key with very many of the ``total``
    rows is dealt by ``other`` over several salts: at most ``HEAVY_SHARE`` keys are, so their
    list is broadcast."""
    most = max(HEAVY_ROWS, total // HEAVY_SHARE)
    heavy = F.broadcast(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(key, F.ceil(F.col("_n") / most).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    left = rows.join(heavy, key, "left").withColumn("_salt", F.pmod(F.xxhash64(other), salts).cast("int")).drop("_salts")
    spread = right.join(heavy, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(spread, [key, "_salt"]).drop("_salt")


def components(links: DataFrame) -> tuple[DataFrame, list[str]]:
    """Connected components of links (two long columns): rows (v, r), r the smallest id that
    v reaches, for every linked v but the roots themselves; and the paths it reads.

    Each partition is first contracted by union-find, then large-star and small-star rounds
    run until every node hangs on its root. No step gathers a component in one task: all are
    grouped minima (combined before the shuffle) and joins in which a large component's centre
    is salted.
    """
    spark = links.sparkSession
    a, b = links.columns[:2]
    now, path = materialize(links.select(F.col(a).cast("long").alias("v"), F.col(b).cast("long").alias("r")).where("v <> r").mapInArrow(_contract, "v long, r long"), "links")
    while True:
        total = 2 * now.count()
        both = now.select(F.col("v").alias("u"), F.col("r").alias("w")).union(now.select(F.col("r"), F.col("v")))
        low = both.groupBy("u").agg(F.least(F.min("w"), F.first("u")).alias("m"))
        large = looked_up(both, low, "u", "w", total).where("w > u").select(F.col("w").alias("u"), F.col("m").alias("w")).where("u <> w").distinct()
        small = large.groupBy("u").agg(F.min("w").alias("m"))
        pair = F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("r")), F.struct(F.col("w").alias("v"), F.col("m").alias("r")))
        # Nodes hang on their minima here, so u has few rows but in a component's centre.
        nxt = looked_up(large, small, "u", "w", total).select(F.explode(pair).alias("e")).select("e.v", "e.r").where("v <> r").distinct()
        nxt, at = materialize(nxt, "stars")
        release(spark, path)
        now, path = nxt, at
        roots = now.select(F.col("r").alias("v")).distinct()
        open_ = now.groupBy("v").agg(F.count("*").alias("n")).join(roots.withColumn("root", F.lit(1)), "v", "left").where("n > 1 or root = 1").limit(1).count()
        if not open_:
            return now, [path]

"""What several operators share: words, shared-folder tables, connected components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that an Arrow function turns into Python objects at once, about.
BATCH_BYTES = 8 << 20
#: What separates words (ASCII white space); a word is a longest run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the words of a text that isn't null. Splitting at one plain character takes Java's fast path, a pattern doesn't."""
    odd = "\t\n\x0b\f\r"
    plain = F.when(F.rlike(text, F.lit(r"[\x09-\x0D]")), F.translate(text, odd, " " * len(odd))).otherwise(text)
    return F.array_remove(F.split(plain, " "), "")


def total(values: Column) -> Column:
    """Sum of an array of numbers as a long, 0 if empty."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and Spark runs on one machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kvlake-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


_settled: list[str] = []


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _at_exit(spark: SparkSession, _settled=_settled) -> None:
    with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
        _remove(spark, _settled)


def settle(df: DataFrame) -> DataFrame:
    """The rows written once as a table in the shared folder and read back: lineage ends here, lost executors lose nothing.

    Such tables go when the process ends, or earlier by :func:`tables_released`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kvlake-{uuid.uuid4().hex}"
    if not _settled:
        atexit.register(_at_exit, spark)
    _settled.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def tables_released(spark: SparkSession) -> Iterator[None]:
    """Settled tables of the body go at its end; results that read them must be written by then."""
    n = len(_settled)
    try:
        yield
    finally:
        gone = _settled[n:]
        del _settled[n:]
        _remove(spark, gone)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph.

    edges: two columns ``a`` and ``b`` of one orderable type, any multiplicity and direction; loops and nulls are
    dropped. Returns (node, component), the component being its smallest node; nodes without an edge are absent,
    an empty input gives no rows.

    Alternating star contraction: each round links every node's larger neighbours to its smallest one, then
    every node to the smallest of its smaller neighbours. A round is two aggregations and two equality joins on
    nodes, its edges never outnumber the input's, and their number of rounds grows with the logarithm of the
    longest chain. A hub is a skewed join key, which adaptive execution splits; mins are combined before shuffling.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    state = lambda x: x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    e = settle(e)
    before = state(e)
    if not before[0]:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        # large star
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = both.join(m, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star
        m = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(m, "a")
        e = settle(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(m.select("a", F.col("m").alias("b"))).distinct())
        if (now := state(e)) == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of about equal bytes of one text column, whatever the lengths of its texts."""
    limit = limit or BATCH_BYTES
    for b in batches:
        ends, start = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while start < b.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield b.slice(start, stop - start)
            start = stop

"""Operator 10, SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints that differ in at most three bits have a segment
in which they differ in at most one, so they meet under one of 66 keys: a whole segment, or a segment with one bit
left out and the two values of that bit on either side. Equality on keys, then verification.

Copies collapse first (one row for each distinct fingerprint), so no group of equal documents is ever paired.
Buckets are linked without forming all their pairs:

1. each member is verified against the bucket's pivots (its extremes), which is linear in the bucket;
2. components of those links; buckets whose members agree on the component need nothing more;
3. in the others, members of different components are joined if the bucket holds at most PAIR_LIMIT of them; in
   larger ones every member emits its other segment with the remaining difference left out in all ways, and equal
   variants link to their smallest label. Both ways are exact, so is their union: no cap drops a link.

Defined results: null or empty text has fingerprint zero and links like any other; repeated rows give repeated rows;
an empty table gives no rows; only the id and text columns are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, components, settle

SHINGLE = 3
SEED = 42
MAX_BITS = 3
PAIR_LIMIT = 256
#: Rows of a key table that may be broadcast (24 bytes each).
BROADCAST_ROWS = 200_000
#: Fingerprints in a task that makes keys.
TASK_ROWS = 20_000
CHUNK = 1 << 16


def fingerprint(text: bytes) -> int:
    """64-bit majority of the XXH64 values of the word shingles of a text (UTF-8), as a signed integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(SHINGLE, len(words))
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest, votes, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - width + 1
    spans = zip(starts, ends[width - 1 :], strict=False)
    while chunk := [digest(joined[s:e], SEED) for s, e in islice(spans, CHUNK)]:
        bits = np.unpackbits(np.array(chunk, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in by_bytes(batches, 1):
        values = pa.array([fingerprint((t or "").encode()) for t in b.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), values], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row for each row of docs."""
    one = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return one.mapInArrow(_fingerprints, f"id {one.schema['id'].dataType.simpleString()}, fp long")


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS


def _turn(x: Column, n: int) -> Column:
    """x rotated left by n bits."""
    return F.shiftleft(x, n % 64).bitwiseOR(F.shiftrightunsigned(x, (64 - n) % 64)) if n % 64 else x


def _keys(fps: DataFrame) -> DataFrame:
    """(key, turn, x): 66 rows for each fingerprint. x is the fingerprint rotated so that the left-out bit is its sign."""
    out = []
    for segment in range(2):
        value = F.shiftrightunsigned("fp", 32 * segment).bitwiseAND(F.lit(0xFFFFFFFF))
        for bit in range(33):
            kept = value if bit == 32 else value.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit)))
            turn = 0 if bit == 32 else 63 - (32 * segment + bit)
            out.append(F.struct(F.lit((segment * 33 + bit) << 32).bitwiseOR(kept).alias("key"), F.lit(turn).alias("turn"), _turn(F.col("fp"), turn).alias("x")))
    return fps.select(F.inline(F.array(*out)))


def _back(x: str) -> Column:
    """The fingerprint of a rotated one; the rotation is in column turn."""
    return F.expr(f"if(turn = 0, {x}, shiftrightunsigned({x}, turn) | shiftleft({x}, 64 - turn))")


def _is_exact() -> Column:
    return F.expr("(key >> 32) in (32, 65)")


def _variants(width: int) -> list[int]:
    return [0xFFFFFFFF ^ reduce(lambda a, b: a | 1 << b, c, 0) for c in combinations(range(32), width)]


def link(fps: DataFrame) -> DataFrame:
    """(node, component) of distinct fingerprints (column fp), for those that have a link; components by smallest node."""
    # 66 rows each: as many tasks as the fingerprints need, however few files they came from
    fps = fps.repartition(max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-fps.count() // TASK_ROWS)), "fp")
    stats = _keys(fps).groupBy("key").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"), F.first("turn").alias("turn"))
    # on either side of a left-out bit someone must stand
    stats = settle(stats.where("lo < hi").where(_is_exact() | F.expr("lo < 0 and hi >= 0")))
    extremes = stats.select(_back("lo").alias("a"), _back("hi").alias("b"))
    full = stats.where("n > 2").select("key", "lo", "hi", "n")
    small = full.count() <= BROADCAST_ROWS
    members = settle(_keys(fps).join(F.broadcast(full) if small else full, "key"))
    pivots = members.select(_back("x").alias("a"), F.when(_is_exact() | (F.col("x") >= 0), _back("lo")).otherwise(_back("hi")).alias("b"))
    labels = settle(components(extremes.unionByName(pivots).where("a <> b").where(_near(F.col("a"), F.col("b")))))

    # buckets in which several components meet
    known = members.select("key", "n", "turn", "x", _back("x").alias("node")).join(labels, "node", "left")
    known = known.select("key", "n", "x", "node", F.coalesce("component", "node").alias("label"))
    open_keys = known.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("key")
    left = settle(known.join(open_keys, "key", "left_semi"))
    a, b = left.where(f"n <= {PAIR_LIMIT}").alias("a"), left.where(f"n <= {PAIR_LIMIT}").alias("b")
    across = F.expr("a.key = b.key and a.label < b.label and ((a.key >> 32) in (32, 65) or (a.x < 0) <> (b.x < 0))")
    pairs = a.join(b, across & _near(F.col("a.node"), F.col("b.node"))).select(F.col("a.label").alias("a"), F.col("b.label").alias("b"))
    large = left.where(f"n > {PAIR_LIMIT}")
    if not large.isEmpty():
        pairs = pairs.unionByName(_variant_links(large))
    merged = components(pairs)
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("final"))
    alone = merged.join(labels.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("final").alias("component"))
    return labels.join(merged, "component", "left").select("node", F.coalesce("final", "component").alias("component")).unionByName(alone)


def _variant_links(large: DataFrame) -> DataFrame:
    """(a, b): labels of members of large buckets linked through equal variants of their other segment."""
    other = F.expr("if((key >> 32) < 33, shiftrightunsigned(node, 32), node & 4294967295L)")
    one_way = lambda rows, width: rows.select(
        "label", F.explode(F.transform(F.expr(f"array({','.join(f'{m}L' for m in _variants(width))})"), lambda m, i: F.struct(F.col("key"), i.alias("way"), other.bitwiseAND(m).alias("rest")))).alias("variant")
    )
    ways = one_way(large.where(_is_exact()), MAX_BITS).unionByName(one_way(large.where(~_is_exact()), MAX_BITS - 1)).distinct()
    return ways.select(F.col("label").alias("a"), F.min("label").over(Window.partitionBy("variant")).alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id, n_rows): one row for each row of docs; component_id is the smallest id reachable.

    n_rows counts the rows of the component, so a document alone has 1.
    """
    each = settle(fingerprints(docs, id_col, text_col))
    distinct = settle(each.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    linked = distinct.join(link(distinct.select("fp")), F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component"))
    linked = settle(linked)
    groups = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("n_rows"))
    of = linked.join(groups, "component").select("fp", "component_id", "n_rows")
    return each.join(of, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "n_rows")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, exactly one of each component: the smallest id (null only where no row has one), of its rows the shortest text, then the smallest hash; of repeated rows, one.

    Ids may be null or repeated: a row is known by its id and its text's hash.
    """
    text_hash = F.xxhash64(text_col)
    each = settle(fingerprints(docs.withColumn("__t", text_hash), "__t", text_col).distinct())
    fps = settle(each.select("fp").distinct())
    of = fps.join(link(fps), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component"))
    texts = each.join(of, "fp").select(F.col("id").alias("t"), "component")
    places = docs.select(F.col(id_col).alias("id"), text_hash.alias("t"), F.length(text_col).alias("chars")).groupBy("id", "t", "chars").agg(F.count(F.lit(1)).alias("times"))
    # nulls are the smallest, so whether the id is one stands before it
    least = F.min(F.struct(F.col("id").isNull(), "id", "chars", "t", "times")).alias("s")
    stay = settle(places.join(texts, "t").groupBy("component").agg(least).select(F.col("s.id").alias("__id"), F.col("s.t").alias("__t"), F.col("s.times").alias("__times")))
    rows = docs.join(stay, F.col(id_col).eqNullSafe(F.col("__id")) & (text_hash == F.col("__t")))
    order = Window.partitionBy("__id", "__t").orderBy(F.lit(1))
    again = rows.where("__times > 1").withColumn("__nth", F.row_number().over(order)).where("__nth = 1")
    return rows.where("__times = 1").select(docs.columns).unionByName(again.select(docs.columns))

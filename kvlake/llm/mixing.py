"""Operator 2, mixing sources to target weights by hash-random order, distributed prefix sums and exact cuts.

Sources (a few rows after one aggregation) get weights 5, 2, 1 in turn by code point, null last. Targets share the
sum of all sizes by weight and stop at MAX_REPEATS times their source's size; the level at which the rest is shared
follows in closed form from prefix sums over the sources. Documents are ordered by a hash of id and text; equal ranges
of hashes make a source's buckets. Prefix sums of the buckets' words show the bucket in which a source's budget ends; it is divided
into buckets in the same way until it is small, so no window has more rows of a source than a level has buckets, however many
documents there are. Only in the last bucket are documents sorted and summed one by one, as those below are taken whole and
those above not at all. Whole epochs come first; the rest of the budget takes documents in hash order and the last one in
part, so a source's taken words are its target, rounded. What comes out is one row for each source, joined to the documents
(broadcast by Spark where that table is small), which don't move.

Defined results: null or blank text has size 0 and takes nothing; a source without words has target 0; repeated rows count as
documents of their own, whatever their number (they are numbered in parts where the cut falls among them); very long texts
are counted whole and may be the one that is cut; columns beside id, source and text are read by nothing, whatever their names;
an empty table gives no rows; equal input gives equal output in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settle, words_of

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 20240607
#: Bits of the order that a level of buckets goes by: a source has 1,024 buckets, and so has each bucket that is divided.
BITS = 10
#: Documents in a bucket of the last level at most, about.
BUCKET_ROWS = 1024


def _key() -> Column:
    """63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col("id"), F.col("tie")), 1)


def _order() -> Column:
    """The order of documents in a source."""
    return F.struct(_key().alias("key"), F.col("id").alias("id"), F.col("tie").alias("tie"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(words_of(text)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """sizes (source, source_size), a row for each source, with target. The window runs over sources, not documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    s = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * float(repeats)).withColumn("all", F.sum("source_size").over(Window.partitionBy()))
    up = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    spent = F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.col("all") - spent) / rest).withColumn("nth", F.row_number().over(up))
    free = F.col("most") >= F.col("level") * F.col("w")
    level = F.min(F.when(free, F.struct("nth", "level"))).over(Window.partitionBy())["level"]
    return s.withColumn("line", level).select("source", "source_size", F.least("most", F.coalesce(F.col("line") * F.col("w"), F.col("most"))).alias("target"))


def _cuts(rows: DataFrame, n_rows: int) -> DataFrame:
    """A row for each source of rows (source, id, tie, size): its size and target, whole epochs, and where the rest of the budget ends.

    cut is the place in the order at which it ends, null where nothing is left; of the n rows that are equal there, the
    first copies are taken whole and the next one's first words in part.
    """
    levels = 1
    while n_rows > BUCKET_ROWS << BITS * levels and BITS * (levels + 1) < 63:
        levels += 1
    bucket = lambda level: F.shiftright(_key(), 63 - BITS * level)
    sums = settle(rows.groupBy("source", bucket(1).alias("__bucket")).agg(F.sum("size").alias("__sum")))
    goals = targets(sums.groupBy("source").agg(F.sum("__sum").alias("source_size")))
    goal, one = F.round("target").cast("long"), F.greatest("source_size", F.lit(1))
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / one)).otherwise(F.lit(0)).cast("int")
    goals = settle(goals.select(F.col("source").alias("__s"), "source_size", "target", epochs.alias("epochs"), F.pmod(goal, one).alias("__left")))
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    at = goals.select("__s", "__left")
    for level in range(1, levels + 1):
        if level > 1:
            sums = rows.join(at, F.col("source").eqNullSafe(F.col("__s")) & (bucket(level - 1) == F.col("__b")))
            sums = sums.groupBy("source", bucket(level).alias("__bucket")).agg(F.sum("size").alias("__sum"))
        starts = sums.withColumn("__start", F.coalesce(F.sum("__sum").over(before), F.lit(0))).join(at, F.col("source").eqNullSafe(F.col("__s")))
        at = starts.where("__start <= __left and __left < __start + __sum").select("__s", F.col("__bucket").alias("__b"), (F.col("__left") - F.col("__start")).alias("__left"))
        at = settle(at)
    # equal rows are counted before they move, so a bucket has as many rows as different documents
    inside = rows.join(at, F.col("source").eqNullSafe(F.col("__s")) & (bucket(levels) == F.col("__b")))
    inside = inside.groupBy("source", "__left", _order().alias("cut")).agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("__size"))
    before = Window.partitionBy("source").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("__left", F.col("__left") - F.coalesce(F.sum(F.col("n") * F.col("__size")).over(before), F.lit(0)))
    found = inside.where("0 <= __left and __left < n * __size").select(F.col("source").alias("__f"), "cut", "n", F.expr("__left div __size").alias("copies"), F.expr("__left % __size").alias("words"))
    return settle(goals.drop("__left").join(found, F.col("__s").eqNullSafe(F.col("__f")), "left").drop("__f"))


def _cut(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows (source, id, tie, ...) with their source's size, target and epochs, whole (once more after these) and part (words of the row that is cut)."""
    placed = rows.join(cuts, F.col("source").eqNullSafe(F.col("__s")))
    here = F.col("cut").isNotNull() & _order().eqNullSafe(F.col("cut"))
    first = placed.withColumn("whole", F.coalesce(_order() < F.col("cut"), F.lit(False))).withColumn("part", F.when(here, F.col("words")).otherwise(F.lit(0)))
    if cuts.where("n > 1").isEmpty():
        return first
    # equal rows at a cut are numbered: by the numbers of rows in the parts of a table, then within a part
    equal = here & (F.col("n") > 1)
    tied = settle(placed.where(equal).withColumn("__row", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__row", 33))
    before = Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = tied.groupBy("source", "__part").agg(F.count(F.lit(1)).alias("__n"))
    parts = parts.select(F.col("source").alias("__g"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    nth = F.col("__before") + F.row_number().over(Window.partitionBy("source", "__part").orderBy("__row")) - 1
    tied = tied.join(parts, F.col("source").eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p"))).withColumn("__nth", nth)
    tied = tied.withColumn("whole", F.col("__nth") < F.col("copies")).withColumn("part", F.when(F.col("__nth") == F.col("copies"), F.col("words")).otherwise(F.lit(0)))
    return first.where(~equal).unionByName(tied.select(*first.columns))


def _rows(docs: DataFrame, id_col: str, source_col: str, text_col: str, *more: Column) -> DataFrame:
    return docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), *more)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, size, source_size, target, taken): one row for each row of docs."""
    rows = settle(_rows(docs, id_col, source_col, text_col, n_words(F.col(text_col)).alias("size")))
    taken = F.col("epochs") * F.col("size") + F.when(F.col("whole"), F.col("size")).otherwise(F.col("part"))
    return _cut(rows, _cuts(rows, rows.count())).select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The mix as rows with the columns of docs: a row for each epoch of a document, its last one cut after the words that the budget takes.

    Texts are read a second time, beside the table of cuts, and stay where they are read.
    """
    sizes = settle(_rows(docs, id_col, source_col, text_col, n_words(F.col(text_col)).alias("size")))
    rows = _cut(_rows(docs, id_col, source_col, text_col, F.struct(*docs.columns).alias("row")), _cuts(sizes, sizes.count()))
    text = F.col("row")[text_col]
    # null stands for the whole text
    copies = F.array_repeat(F.lit(None).cast("long"), F.col("epochs") + F.col("whole").cast("int"))
    copies = F.concat(copies, F.array_repeat(F.col("part"), F.when(F.col("part") > 0, 1).otherwise(0)))
    taken = rows.where(F.rlike(text, F.lit(WORD))).select("row", F.explode(copies).alias("words"))
    gaps, n = F.split(text, f"{WORD}+"), F.col("words").cast("int")
    head = F.array_join(F.zip_with(F.slice(gaps, 1, n), F.slice(words_of(text), 1, n), lambda g, w: F.concat(g, w)), "")
    body = taken.withColumn("body", F.when(F.col("words").isNull(), text).otherwise(head))
    value = {text_col: F.col("body"), chars_col: F.length("body").cast("long")}
    return body.select(*[value.get(c, F.col("row")[c]).alias(c) for c in docs.columns])

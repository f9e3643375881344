"""Operator 1, best-fit packing: pattern packing by non-negative least squares over the histogram of lengths.

The plan depends on the histogram alone (at most ``capacity`` numbers), never on single documents:

1. lengths fall into GROUPS classes; patterns of at most DEPTH classes that fill a sequence exactly are enumerated and
   non-negative least squares fits their repeat counts to the histogram; the counts are rounded down;
2. patterns take real lengths, longest first; what a pattern's lengths leave open stays open;
3. the residual lengths go, longest first, each into the fullest sequence that still takes it.

Sequences with equal content are handled together as ranges, so steps 1 to 3 cost the same for ten thousand documents
and for ten billion. The result is a table of runs (length, first rank, count, first sequence, offset). Each task that cuts
documents counts its pieces of a length as it writes them; prefix sums of the tasks' counts make these numbers ranks. Pieces
meet them by (length, task), by broadcast only below Spark's threshold, so neither a length nor a document that makes up a
third of all rows is more work for a task than its own share of the input. A piece finds its run by binary search.

Defined results: null text is empty, a piece of one token; very long texts are cut into pieces; repeated rows and null ids are
documents of their own; ties in length go by the order of reading, so another layout of the input may give other, equally full
sequences; columns beside id and text are read by nothing, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, settle
from .tokens import tokenizer_path, word_tokenizer

CAPACITY = 4096
END_ID = 1
GROUPS = 64
DEPTH = 3
#: The task that wrote a row and the row's number among this task's rows of its length.
NUMBER = "__part int, __nth long"


def _counted(capacity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    for b in batches:
        length = b.column(b.schema.get_field_index("length")).to_numpy()
        order, here = np.argsort(length, kind="stable"), np.bincount(length, minlength=capacity + 1)
        nth = np.empty(len(length), np.int64)
        nth[order] = np.arange(len(length)) + np.repeat(seen - (np.cumsum(here) - here), here)
        seen += here
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(nth)], [*b.schema.names, "__part", "__nth"])


def pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False, number: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): the token ids of each text with END_ID after them, cut at multiples of capacity.

    Null text counts as empty: one piece of one token. An empty table gives no rows.
    """
    path, end = path or tokenizer_path("word_bpe_49k.json"), np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = word_tokenizer(path)
        for b in by_bytes(batches, 1):
            rows, part, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                data = t.encode(text) + end
                for k, s in enumerate(range(0, len(data), 4 * capacity)):
                    x = data[s : s + 4 * capacity]
                    rows.append(i), part.append(k), start.append(s // 4), length.append(len(x) // 4), crc.append(zlib.crc32(x))
                    if with_ids:
                        ids.append(np.frombuffer(x, "<u4").astype(np.int32))
            out = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(part, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    one = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {one.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    if number:  # in the same Python worker
        return one.mapInArrow(lambda batches: _counted(capacity, cut(batches)), f"{schema}, {NUMBER}")
    return one.mapInArrow(cut, schema)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 with least |a x - b|, by active sets."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[active] = -np.inf
        if active.all() or w.max() <= tol:
            break
        active[int(w.argmax())] = True
        while True:
            s = np.zeros_like(x)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if s[active].min(initial=0) >= 0:
                break
            down = active & (s < 0)
            step = (x[down] / (x[down] - s[down])).min()
            x = x + step * (s - x)
            active &= x > 1e-12
            x[~active] = 0
        x = s
    return x


def patterns(groups: int = GROUPS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Multisets of at most depth classes 1..groups whose upper edges fill a sequence exactly."""
    return [p for d in range(1, depth + 1) for p in combinations_with_replacement(range(groups, 0, -1), d) if sum(p) == groups]


class Plan:
    """Runs of equal lengths put at equal places: (length, first rank, count, first sequence, offset)."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.left, self.rank, self.runs, self.sequences = capacity, dict(histogram), defaultdict(int), [], 0
        #: remaining tokens -> ranges (first sequence, count) of sequences with so many left
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rooms: list[int] = []  # its keys with ranges, sorted
        self.fit()
        for length in sorted((n for n, c in self.left.items() if c), reverse=True):
            self.fill(length, self.left[length])

    def put(self, length: int, count: int, first: int, offset: int) -> None:
        self.runs.append((length, self.rank[length], count, first, offset))
        self.rank[length] += count

    def reopen(self, room: int, first: int, count: int) -> None:
        if not self.open[room]:
            self.rooms.insert(bisect_left(self.rooms, room), room)
        self.open[room].append((first, count))

    def fit(self) -> None:
        groups = min(GROUPS, self.capacity)
        group = lambda n: -(-n * groups // self.capacity)  # noqa: E731  class of a length, by upper edge
        supply, need = defaultdict(list), np.zeros(groups)
        for n in sorted(self.left, reverse=True):
            supply[group(n)].append(n)
            need[group(n) - 1] += self.left[n]
        ways = patterns(groups)
        a = np.zeros((groups, len(ways)))
        for j, p in enumerate(ways):
            for g in p:
                a[g - 1, j] += 1
        for p, x in zip(ways, np.floor(nnls(a, need) + 1e-9).astype(int).tolist(), strict=True):
            wanted = {g: p.count(g) for g in p}
            x = min([x, *(sum(self.left[n] for n in supply[g]) // k for g, k in wanted.items())])
            if x <= 0:
                continue
            ranges = [(self.sequences, x, 0)]
            self.sequences += x
            for g in p:
                after = []
                for first, count, used in ranges:
                    while count:
                        n = next(n for n in supply[g] if self.left[n])
                        k = min(count, self.left[n])
                        self.put(n, k, first, used)
                        self.left[n] -= k
                        after.append((first, k, used + n))
                        first, count = first + k, count - k
                ranges = after
            for first, count, used in ranges:
                if used < self.capacity:
                    self.reopen(self.capacity - used, first, count)

    def fill(self, length: int, count: int) -> None:
        while count and (at := bisect_left(self.rooms, length)) < len(self.rooms):
            room = self.rooms[at]
            first, n = self.open[room].pop()
            k = min(n, count)
            if k < n:
                self.open[room].append((first + k, n - k))
            elif not self.open[room]:
                del self.rooms[at]
            self.put(length, k, first, self.capacity - room)
            count -= k
            if room > length:
                self.reopen(room - length, first, k)
        per = self.capacity // length
        for new, each in ((count // per, per), (1, count % per)):
            if new and each:
                for i in range(each):
                    self.put(length, new, self.sequences, i * length)
                if each * length < self.capacity:
                    self.reopen(self.capacity - each * length, self.sequences, new)
                self.sequences += new


def numbered(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """lengths (with a column length, 1 to capacity) with the task that read a row and the row's number among this task's rows of its length."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lengths.schema)
    return lengths.mapInArrow(partial(_counted, capacity), f"{schema}, {NUMBER}")


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Numbered rows with sequence_id and offset in place of their numbers."""
    rows = settle(rows)
    counts = settle(rows.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("__n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # capacity rows at most
    runs = np.array(sorted(Plan(histogram, capacity).runs), np.int64).reshape(-1, 5)
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(counts.select("length", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))
    kept = [c for c in rows.columns if c not in ("__part", "__nth")]
    ranked = rows.join(starts, ["length", "__part"]).select(*kept, (F.col("__start") + F.col("__nth")).alias("__rank"))
    shift = 1 << 46  # ranks stay below
    firsts = runs[:, 0] * shift + runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "__rank"))
            run = runs[np.searchsorted(firsts, length * shift + rank, side="right") - 1]
            kept = [b.column(i) for i, c in enumerate(b.schema.names) if c != "__rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])], [*(c for c in b.schema.names if c != "__rank"), "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "__rank")
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every document and its place."""
    return pack(pieces(docs, capacity, id_col, text_col, path, number=True), capacity).withColumnRenamed("id", id_col)

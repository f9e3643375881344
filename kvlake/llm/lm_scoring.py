"""Operator 8, stupid-backoff language-model scores of documents under the n-gram counts of the whole corpus.

Relationally: a table of n-gram counts partitioned by hash, joined to the documents' exploded n-grams, summed per
document. Both sides of that join hold nearly as many rows as the corpus has words, so they travel packed:

1. documents are dealt by hash into batches of about BATCH_BYTES; a batch explodes its n-grams and counts the
   different ones once (the pre-aggregation), as sorted hashes. Their width follows the corpus, so that about one n-gram
   in 2 ** SPARE_BITS shares its hash with another at any size (up to 2 ** 40 n-grams, where 64 bits are reached);
2. a batch sends each range of hashes one row (sorted, delta-coded, compressed); a range adds up the counts of all
   batches, which is the count table's partition, and sends each batch the totals of its n-grams in the same order;
3. batches meet their totals, every word's score is looked up by binary search, and a document's are summed.

No row of the exchange belongs to one n-gram, so a frequent one is no hot key, and a task holds one batch or one range,
whose numbers follow the corpus. Free style: grouped Arrow functions over numpy.

S(w | h) = c(h w) / c(h) if c(h w) >= MIN_COUNT, else ALPHA S(w | h'), h' being h without its first word; S(w) = c(w) / N.
MIN_COUNT is 2 as each document's own mention is among the counts. Defined results: a document without words (null text,
white space) scores 0 over 0 words; repeated rows count and score as documents of their own; null ids are ids like any other;
a very long document is a batch of its own, in memory in proportion to it; only the id and text columns are read, whatever
else is there; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import n_words
from .tokens import Memo

ORDER = 3
ALPHA = 0.4
MIN_COUNT = 2
#: Bits of a hash at least, and beyond the logarithm of the number of n-grams.
LEAST_BITS, SPARE_BITS = 48, 24
#: Bytes of text in a batch, and n-grams that a range of hashes takes from all batches, about.
BATCH_BYTES = 12 << 20
RANGE_NGRAMS = 4 << 20

#: What a batch asks of a range and what it is told.
ASKED = pa.schema([("part", pa.int32()), ("order", pa.int32()), ("batch", pa.int32()), ("n", pa.int64()), ("tokens", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])

_word = Memo(xxhash.xxh64_intdigest, 300_000)


def _hashes(text: str | None) -> np.ndarray:
    return np.fromiter(map(_word.__getitem__, (text or "").encode().split()), np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _ngrams(words: np.ndarray, lengths: np.ndarray, order: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..order: hashes of the n-grams that end at each word, and whether they lie within a document."""
    within = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    h = np.zeros(len(words), np.uint64)
    for n in range(1, order + 1):
        # the n-1 words before extend the hash to the left
        back = np.concatenate((np.zeros(min(n - 1, len(words)), np.uint64), words[: len(words) - n + 1])) if n > 1 else words
        h = _mix(h * np.uint64(3) + back + np.uint64(n))
        yield h >> np.uint64(64 - width), within >= n - 1


def _pack(a: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8")


def _prepared(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    each = [_hashes(t) for t in table.column("text").to_pylist()]
    return np.concatenate(each) if each else np.zeros(0, np.uint64), np.array([len(x) for x in each], np.int64)


def lm_scores(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, log_score, mean_log_score, n_backed_off): a row for each row of docs; logarithms are natural."""
    size, words = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)), F.sum(n_words(F.col(text_col)))).first()
    batches = max(1, -(-size // BATCH_BYTES))
    bits = max(0, int(np.ceil(np.log2(max(1, order * size / 6 / RANGE_NGRAMS)))))
    width = min(64, max(LEAST_BITS, int(order * (words or 0)).bit_length() + SPARE_BITS))
    one = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(batches)).cast("int").alias("batch"))
    id_type = one.schema["id"].dataType.simpleString()

    def ask(table: pa.Table) -> pa.Table:
        words, lengths = _prepared(table)
        rows = []
        for n, (h, ok) in enumerate(_ngrams(words, lengths, order, width), 1):
            values, counts = np.unique(h[ok], return_counts=True)
            cuts = np.searchsorted(values, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(width - bits))
            for part, (v, c) in enumerate(zip(np.split(values, cuts), np.split(counts, cuts), strict=True)):
                if len(v):
                    rows.append((part, n, int(table.column("batch")[0].as_py()), len(v), int(c.sum()), _pack(np.diff(v, prepend=np.uint64(0))), _pack(c)))
        return pa.Table.from_pylist([dict(zip(ASKED.names, r, strict=True)) for r in rows], ASKED)

    def add_up(table: pa.Table) -> pa.Table:
        rows = []
        asked = table.to_pylist()
        values = [np.cumsum(_unpack(r["hashes"], r["n"]), dtype=np.uint64) for r in asked]
        counts = [_unpack(r["counts"], r["n"]) for r in asked]
        known, at = np.unique(np.concatenate(values), return_inverse=True)
        totals = np.bincount(at, np.concatenate(counts).astype(np.float64), len(known)).astype(np.uint64)
        ends = np.cumsum([len(v) for v in values])
        for r, end in zip(asked, ends, strict=True):
            rows.append((r["part"], r["order"], r["batch"], r["n"], 0, b"", _pack(totals[at[end - r["n"] : end]])))
        return pa.Table.from_pylist([dict(zip(ASKED.names, r, strict=True)) for r in rows], ASKED)

    def score(table: pa.Table, told: pa.Table) -> pa.Table:
        words, lengths = _prepared(table)
        answers = sorted(told.to_pylist(), key=lambda r: (r["order"], r["part"]))
        found = []
        for n, (h, ok) in enumerate(_ngrams(words, lengths, order, width), 1):
            totals = [_unpack(r["counts"], r["n"]) for r in answers if r["order"] == n]
            values, at = np.unique(h[ok], return_inverse=True)
            assert len(values) == sum(map(len, totals))
            c = np.zeros(len(words), np.float64)
            if totals:
                c[ok] = np.concatenate(totals)[at].astype(np.float64)
            found.append(c)
        logs, used = np.zeros(len(words)), np.zeros(len(words), np.int64)
        if len(words):
            corpus = answers[0]["corpus"]
            logs, used = np.log(found[0] / corpus), np.ones(len(words), np.int64)
            for n in range(2, order + 1):
                seen = found[n - 1] >= MIN_COUNT
                context = np.concatenate(([1.0], found[n - 2][:-1]))
                with np.errstate(divide="ignore", invalid="ignore"):
                    longer = np.log(found[n - 1] / context)
                could = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths) >= n - 1
                logs = np.where(seen, longer, np.where(could, logs + np.log(ALPHA), logs))
                used = np.where(seen, n, used)
        ends = np.cumsum(lengths)
        add = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], ends))])
        short = np.minimum(order, np.arange(len(words)) - np.repeat(ends - lengths, lengths) + 1)
        sums = np.array([logs[e - n : e].sum() for e, n in zip(ends, lengths, strict=True)])
        return pa.table([table.column("id"), pa.array(lengths), pa.array(sums, pa.float64()), pa.array(add((used < short).astype(np.int64)), pa.int64())], ["id", "n_words", "log_score", "n_backed_off"])

    kind = "part int, order int, batch int, n long, tokens long, hashes binary, counts binary"
    asked = one.groupBy("batch").applyInArrow(ask, kind)
    told = asked.groupBy("part", "order").applyInArrow(add_up, kind)
    told = told.withColumn("corpus", F.lit(float(words or 0)))
    scored = one.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(score, f"id {id_type}, n_words long, log_score double, n_backed_off long")
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(F.lit(0.0))
    return scored.select(F.col("id").alias(id_col), "n_words", "log_score", mean.alias("mean_log_score"), "n_backed_off")


"""Operator 5, fuzzy line dedup by MinHash, by DataFrame functions only.

1. Every line that has a word is one occurrence; equal lines share a 64-bit hash, with a second one where they are merged.
2. Signature: all shingles of GRAM characters, lower-cased, at every character whatever the script (those of step 4).
   PERMUTATIONS orders of the shingles, each in TAGS variants that put another quarter of all shingles first; of each
   of these 20 a 16-bit fingerprint of the minimum is kept.
3. Bands of five minima, one of each order. Any two bands share one minimum at most (a transversal design), so 20 minima
   give 16 bands. Lines that share a band are candidates; candidates that agree in fewer than AGREE of the minima go.
   Members of a bucket are compared with its smallest line; where components still differ afterwards, every member with
   all members of other components, in blocks of signatures. No candidate is dropped otherwise. A pair at SIMILARITY is missed with a
   probability of about 0.02, one at 0.85 of 0.005 (measured in tests/llm).
4. Verification: Jaccard of the lower-cased lines' whole sets of GRAM-character shingles, each by its 64-bit hash, at least SIMILARITY.
5. Components of the verified pairs; of each, the first line by (document, line number) stays.

Defined results: null or empty text has no lines; lines without a word are never removed; lines shorter than GRAM are their own only
shingle; rows equal in id and text count as one document and get equal results; null ids are ids like any other and come first; very
long lines are signed in pieces of CHUNK characters and compared in memory in proportion to their length; only the id and text columns are read, whatever else is there; an empty table
gives no rows.

signatures() and similar_pairs() state steps 2 and 4 in numpy, for tests and use outside Spark; the query doesn't call them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, components, settle

GRAM = 5
SIMILARITY = 0.8
PERMUTATIONS = 5
TAGS = 4
#: Minima of 20 in which a candidate pair agrees at least: 99.9 of 100 pairs at SIMILARITY do.
AGREE = 10
#: Characters that are signed at once, about.
CHUNK = 1 << 17
#: Lines whose hashes may be broadcast to fetch their texts (8 bytes each).
BROADCAST_ROWS = 1_000_000
#: Members of a bucket that are compared at once; a larger bucket is dealt out as all pairs of such parts.
PAIR_LIMIT = 1024
#: 64-bit words of a line's sketch, a power of two.
SKETCH = 32
#: Candidates of a line in open buckets, on average, that are verified before components are looked at.
DEGREE = 8
#: Characters of lines that similar_pairs compares at once.
CHARS = 1 << 18

#: Below 2^31, so that the products can be put together from halves that don't overflow.
_ORDERS = np.array([0x5E3779B1, 0x65EBCA77, 0x42B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint64)
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: ASCII white space, and what a minimum is where a line has no shingle of the tag.
_SPACES = " \t\n\x0b\f\r"
_NONE = f"{(1 << 63) - 1}L"
_WORDS = [f"s{i}" for i in range(PERMUTATIONS)]


def _hashes(codes: np.ndarray) -> np.ndarray:
    """XXH64 (seed 42) of the GRAM codes in UTF-32 from each place on, for all places but the last GRAM - 1."""
    left = lambda x, r: x << np.uint64(r) | x >> np.uint64(64 - r)
    wide, n = codes.astype("<u4").byteswap().astype(np.uint64), len(codes) - (GRAM - 1)
    x = np.full(n, 42 + 4 * GRAM, np.uint64) + _P5
    for k in (0, 2):
        x = left(x ^ left((wide[k : n + k] | wide[k + 1 : n + k + 1] << np.uint64(32)) * _P2, 31) * _P1, 27) * _P1 + _P4
    x = left(x ^ wide[4 : n + 4] * _P1, 23) * _P2 + _P3
    x = (x ^ x >> np.uint64(33)) * _P2
    x = (x ^ x >> np.uint64(29)) * _P3
    return x ^ x >> np.uint64(32)


def _minima(pieces: list[str]) -> np.ndarray:
    """For each piece its PERMUTATIONS x TAGS minima: the two highest bits say how far the shingle's tag is from the wanted one."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    pad = "\0" * (GRAM - 1)
    codes = np.frombuffer((pad.join(pieces) + pad + "\0").encode("utf-32-le"), "<u4")
    starts = np.concatenate(([0], np.cumsum(sizes + (GRAM - 1))[:-1]))
    x = _hashes(codes)
    # what begins in the padding is no shingle
    tag = (x >> np.uint64(62)).astype(np.uint8)
    ends = starts + np.maximum(sizes - (GRAM - 1), 1)
    gap = np.zeros(len(x) + 1, np.int8)
    gap[ends] += 1
    np.subtract.at(gap, np.minimum(np.append(starts[1:], len(x)), len(x)), 1)
    tag[np.cumsum(gap[:-1], dtype=np.int8) > 0] = TAGS
    out = np.empty((len(pieces), PERMUTATIONS, TAGS), np.uint64)
    some = np.ones(len(pieces), bool)
    for t in range(TAGS):
        at = np.flatnonzero(tag == t)
        first = np.searchsorted(at, starts)
        here = np.searchsorted(at, ends) > first
        some &= here
        if len(at):
            mine, cuts = x[at], np.minimum(first, len(at) - 1)
            for i in range(PERMUTATIONS):
                out[:, i, t] = np.minimum.reduceat((mine * _ORDERS[i]) >> np.uint64(2), cuts)
    # pieces that lack a tag, most short ones among them: there the nearest tag counts
    if len(lacking := np.flatnonzero(~some)):
        long = ends[lacking] - starts[lacking]
        cuts = np.cumsum(long) - long
        at = np.repeat(starts[lacking] - cuts, long) + np.arange(long.sum())
        mine, near = x[at], tag[at].astype(np.uint64)
        for i in range(PERMUTATIONS):
            value = (mine * _ORDERS[i]) >> np.uint64(2)
            for t in range(TAGS):
                out[lacking, i, t] = np.minimum.reduceat(value | (near ^ np.uint64(t)) << np.uint64(62), cuts)
    return out


def signatures(lines: list[str]) -> np.ndarray:
    """(lines, PERMUTATIONS) of signed 64-bit words; the 16-bit lanes of a word are the fingerprints of its minima by tag."""
    out, pieces, owners, held = np.empty((len(lines), PERMUTATIONS), np.int64), [], [], 0
    for k, line in enumerate(lines):
        low = line.lower()
        if len(low) > CHUNK:
            cut = (low[at : at + CHUNK + GRAM - 1] for at in range(0, len(low) - (GRAM - 1), CHUNK))
            out[k] = _words(np.minimum.reduce([_minima([p]) for p in cut]))[0]
            continue
        pieces.append(low)
        owners.append(k)
        held += len(low) + GRAM - 1
        if held > CHUNK:
            out[owners] = _words(_minima(pieces))
            pieces, owners, held = [], [], 0
    if pieces:
        out[owners] = _words(_minima(pieces))
    return out


def _words(minima: np.ndarray) -> np.ndarray:
    lanes = (minima & np.uint64(0xFFFF)) << (np.arange(TAGS, dtype=np.uint64) * np.uint64(16))
    return np.bitwise_or.reduce(lanes, axis=2).view(np.int64)


def _lines(docs: DataFrame, text_col: str, *kept: Column) -> DataFrame:
    """The kept columns, line_no and line of every line that has a word."""
    one = docs.select(*kept, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    return one.where(F.length(F.btrim("line", F.lit(_SPACES))) > 0)


def _utf32(line: str, at: str | None = None) -> Column:
    """The lower-cased line (or its piece of CHUNK shingles from at on) in UTF-32, so that its shingles have known places."""
    if at is None:
        return F.expr(f"encode(rpad({line}, greatest(length({line}), {GRAM}), '\\0'), 'UTF-32')")
    piece = f"if(length({line}) > {CHUNK}, substring({line}, {at} + 1, {CHUNK + GRAM - 1}), {line})"
    return F.expr(f"encode(rpad({piece}, greatest(least(length({line}) - {at}, {CHUNK + GRAM - 1}), {GRAM}), '\\0'), 'UTF-32')")


def signed_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, n, s0, ...): every different line that has a word, by its hash, its occurrences and its signature, as signatures() has it."""
    rows = _lines(docs, text_col).select(F.xxhash64("line").alias("h"), F.lower("line").alias("low"))
    rows = rows.select("h", "low", F.explode(F.expr(f"sequence(0, greatest(length(low) - {GRAM}, 0), {CHUNK})")).alias("at"))
    rows = rows.select("h", "at", _utf32("low", "at").alias("codes"))
    rows = rows.select("h", "at", "codes", F.explode(F.expr(f"sequence(0, octet_length(codes) - {4 * GRAM}, 4)")).alias("i"))
    rows = rows.select("h", F.expr("if(at + i = 0, 1, 0)").alias("new"), F.expr(f"xxhash64(substring(codes, i + 1, {4 * GRAM}))").alias("x"))
    rows = rows.select("h", "new", F.expr("shiftrightunsigned(x, 62)").alias("tag"), F.expr("shiftright(x, 32)").alias("upper"), F.expr("x & 4294967295L").alias("lower"))
    # two bits less than upper * 2^32 + lower times the order's number has, modulo 2^64
    product = "shiftrightunsigned(shiftleft(upper * {0}L + shiftrightunsigned(lower * {0}L, 32), 32) | lower * {0}L & 4294967295L, 2)"
    rows = rows.select("h", "new", "tag", *[F.expr(product.format(int(o))).alias(f"v{i}") for i, o in enumerate(_ORDERS)])
    minima = [F.expr(f"min(if(tag = {t}L, v{i}, {_NONE}))").alias(f"m{i}{t}") for i in range(PERMUTATIONS) for t in range(TAGS)]
    rows = rows.groupBy("h").agg(F.sum("new").alias("n"), *minima)
    # where a line lacks a tag, the nearest one counts
    lane = lambda i, t: f"coalesce({', '.join(f'nullif(m{i}{t ^ gap}, {_NONE})' for gap in range(TAGS))}) & 65535L"
    return rows.select("h", "n", *[F.expr(" | ".join(f"shiftleft({lane(i, t)}, {16 * t})" for t in range(TAGS))).alias(w) for i, w in enumerate(_WORDS)])


def marked_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, line_no, h, c): every line that has a word, by two hashes; t tells texts of one id apart."""
    rows = _lines(docs, text_col, F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"))
    return rows.select("id", "t", "line_no", F.xxhash64("line").alias("h"), F.crc32("line").alias("c"))


def _times(a: int, b: int) -> int:
    """Product in the field of four elements; its sum is exclusive or."""
    return (a + b - 2) % 3 + 1 if a and b else 0


#: For each band the tag of its minimum in each order: two bands have one minimum in common at most.
BANDS = [[a, *(_times(s, a) ^ b for s in range(PERMUTATIONS - 1))] for a in range(TAGS) for b in range(TAGS)]


def _band_keys(signed: DataFrame) -> DataFrame:
    """(h, key): a row for each line and band; the band's number is the last four bits of its key."""
    tags = [sum(band[i] << 2 * n for n, band in enumerate(BANDS)) for i in range(PERMUTATIONS)]
    lane = lambda i: f"shiftrightunsigned({_WORDS[i]}, shiftleft(cast(shiftrightunsigned({tags[i]}L, 2 * band) & 3L as int), 4)) & 65535L"
    four = " | ".join(f"shiftleft({lane(i)}, {16 * i})" for i in range(4))
    rows = signed.select("h", *_WORDS, F.explode(F.array(*map(F.lit, range(len(BANDS))))).alias("band"))
    return rows.select("h", F.expr(f"xxhash64({four}, {lane(4)}) & -16L | band").alias("key"))


def _agree(a: str, b: str) -> Column:
    """Whether the signatures in a and b agree in AGREE minima at least."""
    lanes = [f"if((({a}.{w} ^ {b}.{w}) & {0xFFFF << 16 * t if t < 3 else -(1 << 48)}L) = 0L, 1, 0)" for w in _WORDS for t in range(TAGS)]
    return F.expr(f"{' + '.join(lanes)} >= {AGREE}")


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one after another."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def similar_pairs(lines: list[str], u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whether lines[u] and lines[v] have an exact Jaccard similarity of SIMILARITY at least, for every pair.

    Shingles are packed into integers by the ranks of their characters and compared by sorting, so nothing is hashed.
    """
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    ends, out, at = np.cumsum(sizes[u] + sizes[v]), np.zeros(len(u), bool), 0
    while at < len(u):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHARS, side="right")))
        out[at:stop] = _compared(lines, u[at:stop], v[at:stop])
        at = stop
    return out


def _compared(lines: list[str], u: np.ndarray, v: np.ndarray) -> np.ndarray:
    own, of = np.unique(np.concatenate((u, v)), return_inverse=True)
    low, n = [lines[k].lower() for k in own], len(u)
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    pad = "\0" * (GRAM - 1)
    codes = np.frombuffer((pad.join(low) + pad + "\0").encode("utf-32-le"), "<u4")
    used = np.unique(codes)
    width = int(len(used)).bit_length()
    if width * GRAM + max(n, len(own)).bit_length() > 64:
        if n > 1:
            return np.concatenate((_compared(lines, u[: n // 2], v[: n // 2]), _compared(lines, u[n // 2 :], v[n // 2 :])))
        p, q = ({x[i : i + GRAM] for i in range(len(x) - (GRAM - 1))} or {x} for x in (low[of[0]], low[of[1]]))
        return np.array([len(p & q) * (1 + SIMILARITY) >= SIMILARITY * (len(p) + len(q)) - 1e-9])
    ranks = np.searchsorted(used, codes).astype(np.uint64) + np.uint64(1)
    starts = np.concatenate(([0], np.cumsum(sizes + (GRAM - 1))[:-1]))
    ranks[_spread(starts + sizes, np.full(len(low), GRAM - 1))] = 0
    packed = ranks[: len(ranks) - (GRAM - 1)].copy()
    for k in range(1, GRAM):
        packed = packed << np.uint64(width) | ranks[k : len(ranks) - (GRAM - 1 - k)]
    bits = np.uint64(width * GRAM)
    counts = np.maximum(sizes - (GRAM - 1), 1)
    sets = np.sort(np.repeat(np.arange(len(low), dtype=np.uint64), counts) << bits | packed[_spread(starts, counts)])
    sets = sets[np.append(True, sets[1:] != sets[:-1])]
    counts = np.bincount((sets >> bits).astype(np.int64), minlength=len(low))
    first, shingles = np.cumsum(counts) - counts, sets & ((np.uint64(1) << bits) - np.uint64(1))
    u, v = of[:n], of[n:]
    out = np.minimum(counts[u], counts[v]) >= SIMILARITY * np.maximum(counts[u], counts[v]) - 1e-9
    left = np.flatnonzero(out)
    if len(left):
        u, v, number = u[left], v[left], np.arange(len(left), dtype=np.uint64) << bits
        both = np.concatenate([np.repeat(number, counts[x]) | shingles[_spread(first[x], counts[x])] for x in (u, v)])
        both.sort()
        shared = np.bincount((both[1:][both[1:] == both[:-1]] >> bits).astype(np.int64), minlength=len(left))
        out[left] = shared * (1 + SIMILARITY) >= SIMILARITY * (counts[u] + counts[v]) - 1e-9
    return out


def _fetched(nodes: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(h, line) of the lines whose hashes are in nodes, each different line once before it moves."""
    nodes = settle(nodes.distinct())
    lines = docs.select(F.explode(F.split(text_col, "\n")).alias("line")).withColumn("h", F.xxhash64("line"))
    return settle(lines.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes, "h", "left_semi").distinct())


def _possible(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) but those that can't be similar: each bit of SKETCH that only one line's shingles set is a shingle of that line alone."""
    rows = texts.select("h", _utf32("lower(line)").alias("codes"))
    rows = rows.select("h", "codes", F.explode(F.expr(f"sequence(1, octet_length(codes) - {4 * GRAM - 1}, 4)")).alias("i"))
    rows = rows.select("h", F.expr(f"xxhash64(substring(codes, i, {4 * GRAM}))").alias("x"))
    rows = rows.select("h", "x", F.expr(f"shiftrightunsigned(x, 6) & {SKETCH - 1}L").alias("slot"), F.expr("shiftleft(1L, cast(x & 63L as int))").alias("bit"))
    words = [F.expr(f"bit_or(if(slot = {k}L, bit, 0L))").alias(f"w{k}") for k in range(SKETCH)]
    bits = settle(rows.groupBy("h").agg(F.count(F.lit(1)).alias("most"), *words))
    of = lambda k: bits.select(F.col("h").alias(k), F.struct("most", *[f"w{i}" for i in range(SKETCH)]).alias(f"bits{k}"))
    apart = " + ".join(f"bit_count(bitsa.w{k} ^ bitsb.w{k})" for k in range(SKETCH))
    least = f"(1 - {SIMILARITY}d) / (1 + {SIMILARITY}d) * (bitsa.most + bitsb.most) + 1e-6d"
    return pairs.join(of("b"), "b").join(of("a"), "a").where(f"{apart} <= {least}").select(*pairs.columns)


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) of line hashes whose lines are similar."""
    lines = texts.select("h", F.lower("line").alias("low"))
    # the codes are a variable of their own, as a column of bytes would be copied for each shingle
    each = f"transform(sequence(1, octet_length(c) - {4 * GRAM - 1}, 4), i -> xxhash64(substring(c, i, {4 * GRAM})))"
    shingles = lambda k: F.expr(f"transform(array({k}), c -> {each})[0]")
    # one side's shingles are made once for each line, where its pairs meet it
    own = lines.repartition("h").select(F.col("h").alias("a"), _utf32("low").alias("codes")).select("a", shingles("codes").alias("x"))
    both = pairs.join(lines.select(F.col("h").alias("b"), F.col("low").alias("y")), "b").join(own, "a").select(*pairs.columns, "x", _utf32("y").alias("codes"))
    # a row number keeps the filter from moving below the shingles, where it would make them again for each mention
    sets = both.select(*pairs.columns, "x", shingles("codes").alias("y"), F.monotonically_increasing_id().alias("row"))
    alike = F.size(F.array_intersect("x", "y")) >= SIMILARITY * F.size(F.array_union("x", "y")) - 1e-9
    return sets.where((F.col("row") >= 0) & alike).select(*pairs.columns)


_GROUP = ["key", "i", "j"]


def _merged(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, component): the components of the labels la and lb of similar pairs (a, b, la, lb).

    Where lines have more than DEGREE partners, that many are looked at first, then eight times as many and so on, without
    pairs whose labels have met by then: in the end every pair is verified or lies within a component.
    """
    whole, stop, links = 1 << 30, 0, None
    share = whole * DEGREE * max(1, texts.count()) // max(1, pairs.count())
    while True:
        start, stop = stop, min(whole, max(1, share))
        place = F.pmod(F.xxhash64("a", "b"), F.lit(whole))
        found = settle(_similar(pairs.where((place >= start) & (place < stop)), texts).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
        links = found if links is None else links.unionByName(found)
        merged = settle(components(links))
        if stop == whole:
            return merged
        share *= 8
        root = lambda k: merged.select(F.col("node").alias(k), F.col("component").alias(f"root{k}"))
        left = pairs.where(place >= stop).join(root("la"), "la", "left").join(root("lb"), "lb", "left")
        pairs = settle(left.where(F.coalesce("rootla", "la") != F.coalesce("rootlb", "lb")).select(*pairs.columns))


def line_classes(signed: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, component): line hashes that are similar to another line, with their component; signed has (h, s0, ...)."""
    signed = signed.select("h", *_WORDS)
    bucket = Window.partitionBy("key")
    members = _band_keys(signed).select("key", "h", F.min("h").over(bucket).alias("lo"), F.count(F.lit(1)).over(bucket).alias("n"))
    members = settle(members.where("n > 1"))
    ends = lambda pairs, k: pairs.join(signed.select(F.col("h").alias(k), F.struct(*_WORDS).alias(f"s{k}")), k)
    links = members.where("h <> lo").select(F.col("lo").alias("a"), F.col("h").alias("b")).distinct()
    links = settle(ends(ends(links, "b"), "a").where(_agree("sa", "sb")).select("a", "b"))
    either = F.explode(F.array("a", "b")).alias("h")
    labels = settle(components(_similar(links, _fetched(links.select(either), docs, text_col))))
    # buckets of more than two in which several components meet
    labelled = members.where("n > 2").drop("lo").join(labels, F.col("h") == F.col("node"), "left").withColumn("label", F.coalesce("component", "h")).drop("node", "component")
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("key")
    parts = F.ceil(F.col("n") / PAIR_LIMIT).cast("int")
    left = labelled.join(open_keys, "key", "left_semi").join(signed, "h").withColumn("part", F.pmod(F.xxhash64("h"), parts).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(F.least(k, "part").alias("i"), F.greatest(k, "part").alias("j")))
    left = settle(left.select("key", "part", "label", "h", F.struct(*_WORDS).alias("s"), F.inline(meets)))
    side = lambda k: left.select(*_GROUP, *[F.col(c).alias(f"{c}{k}") for c in ("part", "label", "h", "s")])
    across = side("a").join(side("b"), _GROUP).where("labela <> labelb and (i = j and ha < hb or parta < partb)").where(_agree("sa", "sb"))
    across = settle(across.select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"), *[F.expr(f"if(ha < hb, {x}, {y})").alias(z) for x, y, z in (("labela", "labelb", "la"), ("labelb", "labela", "lb"))]).distinct())
    texts = _fetched(across.select(either), docs, text_col)
    merged = _merged(settle(_possible(across, texts)), texts)
    # a label that merges is a line alone or the smallest line of a component
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("final"))
    alone = merged.join(labels.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("h"), F.col("final").alias("component"))
    return labels.join(merged, "component", "left").select(F.col("node").alias("h"), F.coalesce("final", "component").alias("component")).unionByName(alone)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, line_no, class_id, class_line, n_class, kept): one row for each line that has a word.

    class_id and class_line name the first line of its class, which is the one kept; n_class counts the class's lines.
    """
    marked = settle(marked_lines(docs, id_col, text_col))
    signed = settle(signed_lines(docs, text_col))
    counts = signed.select("h", "n").join(line_classes(signed, docs, text_col), "h", "left")
    # of a class in which more than one line stands: most lines are alone
    busy = settle(counts.where("n > 1 or component is not null").select("h", F.coalesce("component", "h").alias("component"), F.col("component").isNull().alias("single")))
    # lines of one hash are told apart by the second one
    places = marked.join(busy, "h", "left").select("id", "t", "line_no", "component", F.when(F.col("single"), F.col("c")).alias("only"))
    of = ["component", "only"]
    heads = places.where("component is not null").groupBy(*of).agg(F.min(F.struct("id", "t", "line_no")).alias("head"), F.count(F.lit(1)).alias("n_class"))
    heads = settle(heads).select(F.col("component").alias("__c"), F.col("only").alias("__o"), "head", "n_class")
    found = places.join(heads, (F.col("component") == F.col("__c")) & F.col("only").eqNullSafe(F.col("__o")), "left")
    place = F.struct("id", "t", "line_no")
    found = found.withColumn("head", F.coalesce("head", place)).withColumn("n_class", F.coalesce("n_class", F.lit(1).cast("long")))
    return found.select(F.col("id").alias(id_col), "t", "line_no", F.col("head.id").alias("class_id"), F.col("head.line_no").alias("class_line"), "n_class", place.eqNullSafe(F.col("head")).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs without the lines that aren't kept, n_chars (if there) counted anew; documents that lose all their words go."""
    lost = line_dedup(docs, id_col, text_col).where(~F.col("kept")).groupBy(F.col(id_col).alias("__id"), F.col("t").alias("__t"))
    lost = settle(lost.agg(F.collect_set("line_no").alias("__lost")))
    rows = docs.join(lost, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__t")), "left")
    rest = F.array_join(F.filter(F.transform(F.split(text_col, "\n"), lambda x, i: F.when(~F.array_contains("__lost", i), x)), lambda x: x.isNotNull()), "\n")
    body = rows.withColumn("__body", F.when(F.col("__lost").isNull(), F.col(text_col)).otherwise(rest)).where(F.col("__lost").isNull() | F.rlike("__body", F.lit(WORD)))
    value = {text_col: F.col("__body"), chars_col: F.length("__body").cast("long")}
    return body.select(*[value.get(c, F.col(c)).alias(c) for c in docs.columns])

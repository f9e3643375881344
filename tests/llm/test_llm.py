"""Every operator against a brute-force version on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kvlake.llm import chat, common, line_dedup, lm_scoring, mixing, packing, quality_rules, queries, simhash, surrogates, tiff, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, fp long, id long, batch int, node long, key string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    names = ["".join(rng.choice(list("abcdefghiklmnoprstu"), 5)) for _ in range(400)]
    return [str(x) for x in rng.choice(names, n)]


def text_of(seed, n=120, line=14):
    w = prose(seed, n)
    return "\n".join(" ".join(w[i : i + line]).capitalize() + "." for i in range(0, n, line))


BASE = text_of(1)
TEXTS = [
    BASE, BASE, BASE.replace("a", "o", 1), BASE + "\n" + text_of(9, 14), text_of(2), text_of(3, 40), text_of(4, 3000), None, None, "", "   \n\t ", "one", "one", "x" * 5000,
    "é ü ß\n日本語 テキスト です。 <|endoftext|> 😀\tb  c", "\n".join(["Same line again and again, it is long enough."] * 12), " ".join(["word"] * 60), "a b c d e f g h i j k",
    "Home | About | Contact | Terms\nHome | About | Contact | Help\n" + text_of(5, 20), "BUY NOW!! CHEAP!! TODAY!! ONLY!! HERE!!\n" * 3 + "Ok then.",
    text_of(6, 600, 600), text_of(7) + "\nMail me at joe.doe1@mail.example.com or +1 (212) 555-0199 now.",
]
ROWS = [(i, t, "en", [None, "b", "a", "é", "Z"][i % 5], len(t) if t is not None else None, 1, 2, 3, 4, 5, 6, "k") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[4], (None, "no id here at all", None, None, None, *ROWS[0][5:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_no_operator_fails_on_an_empty_table(spark, empty, tmp_path):
    for out in (packing.pack_documents(empty), mixing.mix(empty), tokens.token_counts(empty), line_dedup.line_dedup(empty), simhash.near_duplicates(empty), surrogates.replace(empty), lm_scoring.lm_scores(empty), quality_rules.quality_rules(empty), tiff.store_texts(empty)):
        assert out.collect() == []
    for out in (quality_rules.clean_documents(empty), line_dedup.deduplicated(empty), simhash.one_of_each(empty), mixing.mixed_documents(empty)):
        assert out.collect() == [] and out.columns == empty.columns
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(chats).collect() == []


# 1


def test_packing(docs):
    t = tokens.word_tokenizer(tokens.tokenizer_path("word_bpe_49k.json"))
    got = packing.pack_documents(docs, 256).collect()
    want = []
    for i, text, *_ in ROWS:
        ids = [*t.whole.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        want += [(i, k, s, len(ids[s : s + 256]), zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 256))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 256
    assert len(places) <= math.ceil(sum(x[3] for x in want) / 256) + 1
    ids = packing.pieces(docs, 256, with_ids=True).where("length > 0").first()
    assert zlib.crc32(np.array(ids["ids"], "<u4").tobytes()) == ids["ids_crc32"]


def test_packing_over_many_parts_with_one_document_repeated(spark):
    made = [(7, 9)] * 400 + [(i, 1 + i % 16) for i in range(800)]
    got = packing.pack(packing.numbered(spark.createDataFrame(made, "id long, length long").repartition(13), 16), 16)
    assert got.columns == ["id", "length", "sequence_id", "offset"]
    places = defaultdict(list)
    for r in got.collect():
        places[r.sequence_id].append((r.offset, r.length, r.id))
    for p in places.values():
        p.sort()
        assert [x[0] for x in p] == [sum(y[1] for y in p[:k]) for k in range(len(p))] and sum(x[1] for x in p) <= 16
    assert Counter((i, n) for p in places.values() for _, n, i in p) == Counter(made)
    # a sequence takes one length above half of it, or two halves, which fit beside none of these
    assert len(places) == sum(n > 8 for _, n in made) + 50 // 2


@pytest.mark.parametrize("kind", ["mixed", "half", "long", "tiny"])
def test_packing_plan(kind):
    rng = np.random.default_rng(2)
    x = {"mixed": np.clip(rng.lognormal(6.3, 1, 30000).astype(int) + 1, 1, 4096), "half": rng.integers(1900, 2049, 5001), "long": np.full(77, 4096), "tiny": np.full(12345, 7)}[kind]
    n, c = np.unique(x, return_counts=True)
    p = packing.Plan(dict(zip(n.tolist(), c.tolist(), strict=True)))
    used, ranks = np.zeros(p.sequences, np.int64), Counter()
    for length, rank, count, first, offset in p.runs:
        assert rank == ranks[length]
        ranks[length] += count
    for length, _, count, first, offset in sorted(p.runs, key=lambda r: r[4]):
        assert (used[first : first + count] == offset).all()
        used[first : first + count] += length
    assert ranks == dict(zip(n.tolist(), c.tolist(), strict=True)) and used.max() <= 4096
    assert p.sequences <= max(1.01 * math.ceil(x.sum() / 4096), -(-len(x) // (4096 // int(x.max())))) + 1


def test_nnls():
    rng = np.random.default_rng(0)
    a, x = rng.random((20, 8)), np.maximum(0, rng.normal(size=8))
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-8)
    got = packing.nnls(np.array([[1.0], [1.0]]), np.array([-1.0, -1.0]))
    assert got.tolist() == [0.0]
    assert all(sum(p) == 12 and len(p) <= 3 for p in packing.patterns(12, 3)) and len(packing.patterns(12, 3)) == 19


# 2


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left, weight = total - sum(capped.values()), sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / weight > 3 * sizes[s]]
        if not over:
            return {s: capped.get(s, left * w[s] / weight if s in free else 0) for s in order}
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mixing(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BITS", 1)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)
    got = mixing.mix(docs).collect()
    sizes, by_id = Counter(), {i: s for i, _, _, s, *_ in ROWS}
    for _, t, _, s, *_ in ROWS:
        sizes[s] += len(words(t))
    want = targets(sizes)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((i is None, i or 0, len(words(t))) for i, t, *_ in ROWS)
    taken = Counter()
    for r in got:
        s = by_id[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 3 * r.size
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in want)
    assert pairs(mixing.mix(docs), "doc_id", "taken") == pairs(mixing.mix(docs.repartition(5)), "doc_id", "taken")
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns
    real = Counter()
    for r in rows.collect():
        real[r.source] += len(words(r.text))
        assert TEXTS[r.doc_id].startswith(r.text) if r.doc_id is not None else True
        assert r.n_chars == len(r.text)
    assert +real == +taken


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_mixing_cuts_among_many_equal_rows(spark, monkeypatch, bits):
    monkeypatch.setattr(mixing, "BITS", bits)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    made = [(i, "a b c", "x") for i in [None] * 40 + [7] * 30] + [(None, f"w{i} and more", "x") for i in range(5)]
    made += [(i, "word " * (i % 7), "y") for i in range(90)] + [(i, "lone words", None) for i in range(3)]
    table = spark.createDataFrame(made, "doc_id long, text string, source string").repartition(6)
    sizes = Counter()
    for _, t, s in made:
        sizes[s] += len(words(t))
    want, taken, real = targets(sizes), Counter(), Counter()
    got = mixing.mix(table).collect()
    assert len(got) == len(made)
    size_of = {sizes[s]: s for s in sizes}
    partial = Counter()
    for r in got:
        s = size_of[r.source_size]
        taken[s] += r.taken
        partial[s] += r.size > 0 and r.taken % r.size > 0
        assert r.taken <= 3 * r.size
    assert all(taken[s] == math.floor(want[s] + 0.5) and partial[s] <= 1 for s in want)
    rows = mixing.mixed_documents(table).collect()
    for r in rows:
        real[r.source] += len(words(r.text))
    assert +real == +taken
    # two copies of one document differ by one epoch at most
    copies = [r.taken for r in got if r.doc_id == 7 and r.source_size == sizes["x"]]
    assert max(copies) - min(copies) <= 3


def test_documents_stay_where_they_are_read_in_the_mix(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    plan = mixing.mixed_documents(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Window" not in plan


# 3


def test_token_counts(docs):
    t = tokens.byte_tokenizer(tokens.tokenizer_path("byte_bpe_50k.json"), tokens.tokenizer_path("byte_bpe_50k.tiktoken"))
    want = [(i, len((x or "").encode()), n := len(t.whole.encode(x or "", add_special_tokens=False).ids), n > 512) for i, x, *_ in ROWS]
    assert pairs(tokens.token_counts(docs), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


def test_tokenizers_agree_with_the_library():
    import random

    w, b = tokens.word_tokenizer(tokens.tokenizer_path("word_bpe_49k.json")), tokens.byte_tokenizer(tokens.tokenizer_path("byte_bpe_50k.json"), tokens.tokenizer_path("byte_bpe_50k.tiktoken"))
    rnd = random.Random(5)
    alphabet = "abcdeéßñ .,!'\n\t0123|$%&*#<>-_@AZÉ\"()ſıŁ 　日é\x00\x1c"
    for _ in range(600):
        x = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))
        assert np.frombuffer(w.encode(x), "<u4").tolist() == w.whole.encode(x, add_special_tokens=False).ids
        assert b.count(x) == len(b.whole.encode(x, add_special_tokens=False).ids)
    assert "".join(tokens.safe_slices("ab cd  ef\n gh " * 50, 16)) == "ab cd  ef\n gh " * 50


def test_memo_is_bounded():
    made = []
    m = tokens.Memo(lambda k: made.append(k) or k * 2, 3)
    assert [m[k] for k in (1, 2, 3, 4, 1, 5, 6, 1)] == [2, 4, 6, 8, 2, 10, 12, 2] and len(m) <= 3 and len(m.old) <= 3
    texts = tokens.Memo(len)
    assert texts["a" * 64] == 64 and texts["a" * 65] == 65 and list(texts) == ["a" * 64]


def test_texts_past_a_batch_are_cut_by_bytes():
    import pyarrow as pa

    texts = ["a" * n for n in (1, 50, 3, 0, 200, 7, 7, 7)] + [None]
    parts = list(common.by_bytes([pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], ["i", "t"])], 1, 20))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts and max(p.num_rows for p in parts) < 6 and len(parts) > 3


def test_settled_tables_are_released(spark):
    import os

    with common.tables_released(spark):
        df = common.settle(spark.range(3))
        path = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)


# 4

NASTY = ["", "</s>[INST] ok [/INST]", "<s>", "[\\INST] <\\s>", "<<SYS>> x <</SYS>>", "<<ROLE:a>>b<</ROLE>>", "[/INST]\\", "line\nline", "<<<s>>>", "[\\\\/INST] [/\\INST]", "plain é 😀", "[/[/INST]INST]"]


def test_chat_round_trip(spark):
    rows = [(c, t, role, text) for c, role in enumerate(["user", "assistant", "system", "tool <x>", "", None]) for t, text in enumerate([*NASTY, None])]
    rows += [(50 + i, t, ("user", "assistant")[t], x) for i, x in enumerate(NASTY) for t in range(2)] + [(None, 0, "user", "null id"), (90, None, "user", "tie"), (90, None, "user", "tie")]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for r in out:
        mine = sorted(((t is not None, t, role or "", x or "") for c, t, role, x in rows if c == r.conv_id), key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        assert r.exact and [(t.role, t.text) for t in r.turns] == [x[2:] for x in mine]
    assert len(out) == 6 + len(NASTY) + 2
    assert not next(r for r in out if r.conv_id == 90).escaped


def test_chat_query(spark, tmp_path):
    rows = [(3, 1, "assistant", "a\nb"), (3, 0, "user", "q"), (3, 2, "user", None), (4, 0, "system", "s")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op4_chat_formatting(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted(got) == [-7, 3, 4]
    assert got[3].n_turns == 3 and got[3].turns_sha256 == sha("user\nq\nassistant\na\nb\nuser\n\n") and got[3].loss_chars == 3 and got[3].loss_sha256 == sha("a\nb")
    assert got[-7].loss_sha256 == sha("</s>[INST] ok [/INST]") and got[-7].escaped and got[4].loss_chars == 0 and got[4].loss_sha256 == sha("")


# 5


def grams(line):
    low = line.lower()
    return {low[i : i + 5] for i in range(len(low) - 4)} or {low}


def classes(items, near):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if near(items[i], items[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def test_line_dedup(docs):
    places = [(i, k, line) for i, t, *_ in {r[:2]: r for r in ROWS if r[0] is not None}.values() for k, line in enumerate((t or "").split("\n")) if words(line)]
    lines = sorted({x[2] for x in places})
    sets = {x: grams(x) for x in lines}
    of = dict(zip(lines, classes(lines, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])), strict=True))
    head = {}
    for i, k, x in places:
        head[of[x]] = min(head.get(of[x], (99, 0)), (i, k))
    got = line_dedup.line_dedup(docs.where("doc_id is not null")).distinct()
    assert pairs(got, "doc_id", "line_no", "class_id", "class_line", "kept") == sorted(((i, k, *head[of[x]], (i, k) == head[of[x]]) for i, k, x in places), key=repr)
    rest = line_dedup.deduplicated(docs)
    kept = {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if not words(x) or head[of[x]] == (i, k)) for i, t, *_ in ROWS if i is not None}
    for r in rest.where("doc_id is not null").collect():
        assert (r.text or "") == kept[r.doc_id] and (r.n_chars == (len(r.text) if r.text is not None else None))
    assert {r.doc_id for r in rest.collect()} == {i for i, t, *_ in ROWS if i is None or words(kept[i]) or not words(t)}


def linked(spark, lines):
    """The class of each line by the operator and by brute force."""
    lines = sorted(set(lines))
    rows = line_dedup.line_dedup(spark.createDataFrame([(0, "\n".join(lines))], "doc_id long, text string")).collect()
    got = {r.line_no: r.class_line for r in rows}
    sets = [grams(x) for x in lines]
    of = classes(range(len(lines)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    return [got[i] for i in range(len(lines))], of


def test_similar_lines_of_very_different_lengths(spark):
    got, of = linked(spark, ["ha " * 10, "ha " * 100, "-" * 20, "-" * 80, "Another line that is like none of these."])
    assert got == of and len(set(of)) == 3


def test_large_buckets_of_lines_that_begin_alike(spark, monkeypatch):
    """Long words and an unlisted unspaced script: one word-shingle each, the same for all; both ways of linking open buckets."""
    rng = np.random.default_rng(5)
    digits = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    urls = [f"https://www.example.com/{digits(70)}" for _ in range(150)]
    khmer = ["\u1780\u1781\u1782\u1783\u1784\u1785\u1786\u1787\u1788\u1789\u178a\u178b" + "".join(chr(0x1780 + int(x)) for x in rng.integers(0, 32, 60)) for _ in range(50)]
    lines = urls + khmer + [x[:-1] + "Z" for x in urls + khmer]
    for limit in (256, 2):
        monkeypatch.setattr(line_dedup, "PAIR_LIMIT", limit)
        got, of = linked(spark, lines)
        assert got == of and len(set(of)) == 200


def edited(rng, words, kind):
    a = " ".join(words)
    if kind == 0:
        i = int(rng.integers(0, len(a)))
        return a, a[:i] + "q" + a[i + 1 :]
    if kind == 1:
        return a, a + "!"
    b = a
    for _ in range(max(1, len(a) // 55)):
        i = int(rng.integers(0, len(b)))
        b = b[:i] + b[i + 1 :]
    return a, b


@pytest.mark.parametrize("n", [3, 4, 6, 8, 20, 60])
def test_recall_of_bands_by_line_length(n):
    """Of pairs at 0.8 or more at least 0.95 share a band and agree in enough minima, however short the lines are."""
    rng, vocabulary, some = np.random.default_rng(n), prose(21, 4000), []
    while len(some) < 600:
        a, b = edited(rng, [vocabulary[i] for i in rng.integers(0, len(vocabulary), n)], int(rng.integers(0, 3)))
        if a != b and len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b)):
            some.append((a, b))
    lanes = lambda x: line_dedup.signatures(x).view(np.uint64)[:, :, None] >> (np.arange(4, dtype=np.uint64) * np.uint64(16)) & np.uint64(0xFFFF)
    same = lanes([a for a, _ in some]) == lanes([b for _, b in some])
    found = np.any([same[:, range(5), band].all(axis=1) for band in line_dedup.BANDS], axis=0) & (same.sum(axis=(1, 2)) >= line_dedup.AGREE)
    assert found.mean() >= 0.95


def test_signatures_are_the_minima_of_all_shingles(monkeypatch):
    lines = ["a", "abcd", "Abcde", "-" * 30, "ha " * 100, "é" * 3, "日本語テキストです", "x" * 700 + "y", *prose(3, 5), " ".join(prose(4, 300))]
    want = line_dedup.signatures(lines)
    for k, line in enumerate(lines):
        low = line.lower()
        x = line_dedup._hashes(np.frombuffer((low + "\0" * 5).encode("utf-32-le"), "<u4"))[: max(1, len(low) - 4)].tolist()
        for i in range(5):
            at = int(line_dedup._ORDERS[i])
            minima = [min(((v >> 62) ^ t) << 62 | (v * at % (1 << 64)) >> 2 for v in x) & 0xFFFF for t in range(4)]
            assert int(want[k, i]) % (1 << 64) == sum(m << 16 * t for t, m in enumerate(minima))
    monkeypatch.setattr(line_dedup, "CHUNK", 16)
    assert (line_dedup.signatures(lines) == want).all() and line_dedup.signatures([]).shape == (0, 5)
    assert all(len({*map(tuple, (zip(range(5), a, strict=True)))} & {*zip(range(5), b, strict=True)}) <= 1 for i, a in enumerate(line_dedup.BANDS) for b in line_dedup.BANDS[:i])


def test_similar_is_exact(monkeypatch):
    rng, vocabulary = np.random.default_rng(8), prose(22, 400)
    some = [edited(rng, [vocabulary[i] for i in rng.integers(0, 400, n)], k % 3) for k, n in enumerate([1, 2, 3, 5, 9, 30] * 20)] + [("a", "A"), ("a", "b"), ("ab", "abc"), ("ha " * 9, "ha " * 50)]
    want = [len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b)) for a, b in some]
    lines, at = [x for p in some for x in p], np.arange(0, 2 * len(some), 2)
    assert line_dedup.similar_pairs(lines, at, at + 1).tolist() == want and 0 < sum(want) < len(want)
    monkeypatch.setattr(line_dedup, "CHARS", 50)
    assert line_dedup.similar_pairs(lines, at, at + 1).tolist() == want
    # more different characters than fit into packed shingles
    wide = "".join(chr(0x4E00 + i) for i in range(9000))
    assert line_dedup.similar_pairs([wide, wide[:-900] + "x", wide[:4500]], np.array([0, 0]), np.array([1, 2])).tolist() == [True, False]
    monkeypatch.setattr(line_dedup, "CHARS", 1 << 20)
    assert line_dedup.similar_pairs([wide, wide[:-900] + "x", wide[:4500]], np.array([0, 0]), np.array([1, 2])).tolist() == [True, False]


def test_lines_are_signed_and_compared_without_python(spark, monkeypatch):
    """Every table of the operator is made by DataFrame functions, with the signatures and shingle sets that numpy gives."""
    plans, settle = [], line_dedup.settle
    monkeypatch.setattr(line_dedup, "settle", lambda df: plans.append(df._jdf.queryExecution().toString()) or settle(df))
    monkeypatch.setattr(line_dedup, "DEGREE", 1)
    rng = np.random.default_rng(9)
    base = " ".join(prose(31, 12))
    near = sorted({"".join(c if rng.random() > 0.03 else "q" for c in base) for _ in range(60)})
    got, of = linked(spark, near)
    assert got == of and plans and not any(re.search("InArrow|InPandas|Python", x) for x in plans)
    lines = ["a", "abcd", "Abcde", "ha " * 100, "日本語テキストです", "😀 ΣΑΣ é", "x" * 700 + "y"]
    for chunk in (1 << 17, 16):
        monkeypatch.setattr(line_dedup, "CHUNK", chunk)
        rows = {r.h: r for r in line_dedup.signed_lines(spark.createDataFrame([("\n".join([*lines, lines[3]]),)], "text string")).collect()}
        found = [rows[int(np.uint64(xxhash.xxh64_intdigest(x.encode(), 42)).astype(np.int64))] for x in lines]
        assert [[r[f"s{i}"] for i in range(5)] for r in found] == line_dedup.signatures(lines).tolist() and found[3].n == 2


def test_lines_of_null_ids_and_clashing_columns(spark):
    rows = [(None, "One long line that is the same.", 1, "x"), (3, "One long line that is the same!\nanother", 2, "y"), (3, "third of the same id, other text", 3, "z"), (3, "third of the same id, other text", 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h long, line string")
    got = line_dedup.line_dedup(docs).collect()
    assert sorted(((r.doc_id is not None, r.line_no, r.class_id, r.class_line, r.n_class, r.kept) for r in got), key=repr) == sorted(
        [(False, 0, None, 0, 2, True), (True, 0, None, 0, 2, False), (True, 1, 3, 1, 1, True), (True, 0, 3, 0, 2, True), (True, 0, 3, 0, 2, True)], key=repr
    )
    rest = line_dedup.deduplicated(docs)
    assert rest.columns == docs.columns and sorted(r.text for r in rest.collect()) == ["One long line that is the same.", "another", rows[2][1], rows[2][1]]


# 6


def test_tiff_round_trip():
    rng = np.random.default_rng(1)
    for compression in tiff.PACK:
        for predictor in (1, 2):
            for tile in (None, (16, 32)):
                for order in "<>":
                    images = [rng.integers(0, 256, s, dtype=np.uint8) for s in ((1, 1), (70, 50, 3), (130, 64))]
                    got = list(tiff.decode(tiff.encode(images, compression, predictor, tile, 16, order)))
                    assert all((a.reshape(b.shape) == b).all() for a, (_, b) in zip(images, got, strict=True))
    with pytest.raises(ValueError, match="TIFF"):
        list(tiff.decode(b"GIF89a" + b"\0" * 20))


def test_codecs():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 127, 128, 129, 600, 40000):
        for data in (rng.integers(0, 256, n, dtype=np.uint8).tobytes(), rng.integers(0, 3, n, dtype=np.uint8).tobytes(), b"a" * n):
            assert tiff.lzw_decode(tiff.lzw_encode(data)) == data and tiff.packbits_decode(tiff.packbits_encode(data)) == data
    # the format's published examples
    codes, text = [256, 7, 258, 8, 8, 258, 6, 6, 257], bytes((7, 7, 7, 8, 8, 7, 7, 6, 6))
    bits = "".join(f"{c:09b}" for c in codes)
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_encode(text) == packed and tiff.lzw_decode(packed) == text
    assert tiff.packbits_decode(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


def test_media_query(spark, docs, tmp_path, monkeypatch):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op6_media_tiff(spark, str(tmp_path)).collect()
    assert sorted((repr(r.doc_id) for r in got)) == sorted(repr(r[0]) for r in ROWS)
    by_text = {}
    for r in got:
        raw = (next(t for i, t, *_ in ROWS if i == r.doc_id) or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = tiff.store(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert by_text.setdefault(raw, r.feature) == r.feature
    monkeypatch.setattr(tiff, "PAGE_ROWS", 3)
    long = tiff.store(b"z" * 64 * 10)
    assert len(list(tiff.decode(long))) == 4
    one = spark.createDataFrame([(1, bytearray(long)), (2, None)], "doc_id long, media binary")
    assert [r.page for r in tiff.pages(one, "media", ["doc_id"]).collect()] == [0, 1, 2, 3]
    assert tiff.digest(tiff.pages(one, "media", ["doc_id"]), ["doc_id"]).first()["payload_bytes"] == 640


def test_damaged_media_end_in_an_error_row(spark):
    good = tiff.encode([np.arange(64 * 8, dtype=np.uint8).reshape(8, 64)] * 2)
    wide = tiff.encode([np.zeros((4, 4), np.uint8)])
    wide = wide.replace(tiff.struct.pack("<HHII", tiff.WIDTH, 4, 1, 4), tiff.struct.pack("<HHII", tiff.WIDTH, 4, 1, 1 << 31))
    bits = tiff.encode([np.zeros((4, 4), np.uint8)]).replace(tiff.struct.pack("<HHI", tiff.BITS, 3, 1) + b"\x08", tiff.struct.pack("<HHI", tiff.BITS, 3, 1) + b"\x10")
    rows = [(0, good), (1, b""), (2, b"II*\0"), (3, b"GIF89a" + b"\0" * 20), (4, good[: len(good) // 2]), (5, wide), (6, bits), (7, None), (8, good), (8, good)]
    files = spark.createDataFrame([(i, None if m is None else bytearray(m), "x") for i, m in rows], "page long, media binary, error string")
    got = tiff.pages(files, "media", ["page", "error"]).collect()
    by = defaultdict(list)
    for r in got:
        by[r.file_page].append((r.page, r.error is None, r.pixels is None))
        assert r.file_error == "x"
    assert sorted(by) == [0, 1, 2, 3, 4, 5, 6, 8] and by[0] == [(0, True, False), (1, True, False)] and len(by[8]) == 4
    assert all(by[i][-1][1:] == (False, True) for i in range(1, 7))
    sums = {r.k: r.payload_sha256 for r in tiff.digest(tiff.pages(files.withColumnRenamed("page", "k"), "media", ["k"]), ["k"]).collect()}
    assert sums[0] == sums[8] and sums[0] is not None and sums[1] is None and 7 not in sums


# 7

PRIVATE = [
    ("Write to Joe.Doe1@mail.example.com today.", "email"), ("Write to joe.doe1@mail.example.com, JOE.DOE1@MAIL.EXAMPLE.COM.", "email"), ("Card 4111 1111 1111 1111 ok", "card"), ("Card 4111111111111111 ok", "card"),
    ("Call +1 (212) 555-0199 now", "phone"), ("IP 10.20.30.40.", "ip"), ("SSN 123-45-6789", "ssn"), ("IBAN DE89 3704 0044 0532 0130 00 end", "iban"), ("token = \"" + "ab12" * 10 + "\"", "secret"),
    ("Anna Schmidt met Иван Петров and Peter Schmidt.", "name"),
]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def test_surrogates(spark):
    rows = [(i, t) for i, (t, _) in enumerate(PRIVATE)] + [(100, None), (101, ""), (102, "Clean prose, 12 words or 2024."), (103, PRIVATE[0][0])]
    got = {r.doc_id: r for r in surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (t, kind) in enumerate(PRIVATE):
        assert set(got[i].kinds) == {kind} and got[i].n_entities >= 1 and len(got[i].text) == len(t) or kind in ("name", "ip")
        for raw in re.findall(r"\S+@\S+\w|\d{4} ?\d{4} ?\d{4} ?\d{4}|555-0199|10\.20\.30\.40|123-45-6789|3704|ab12ab12|Schmidt|Петров", t):
            assert raw not in got[i].text
    assert got[100].text is None and got[100].n_entities == 0 and got[101].text == "" and got[102].text == rows[12][1] and got[102].n_entities == 0
    a, b = got[1].surrogates
    assert a == b.lower() and b == b.upper() and got[0].surrogates[0].lower() == a and got[103].surrogates == got[0].surrogates
    spaced, plain = got[2].surrogates[0], got[3].surrogates[0]
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", spaced) and spaced.replace(" ", "") == plain and luhn(plain)
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[4].surrogates[0])
    iban = got[7].surrogates[0].replace(" ", "")
    assert iban.startswith("DE") and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    names = got[9].surrogates
    given = {n: k for k, v in surrogates.GIVEN.items() for n in v}
    assert [given[n.split()[0]] for n in names] == [("latin", "f"), ("cyrillic", "m"), ("latin", "m")] and names[0].split()[1] == names[2].split()[1]
    other = surrogates.replace(spark.createDataFrame(rows[:1], "doc_id long, text string"), key="another").first()
    assert other.surrogates != got[0].surrogates


def test_surrogates_stay_distinct(spark, monkeypatch):
    real = surrogates.surrogate
    # a drawing so poor that most first attempts clash
    monkeypatch.setattr(surrogates, "surrogate", lambda kind, norm, attempt, key=surrogates.KEY: F.concat(F.lit("203.0.113."), (F.pmod(F.xxhash64(norm, attempt), F.lit(40))).cast("string")))
    rows = [(i, f"host 10.0.{i % 20}.1 and 10.0.{(i + 1) % 20}.1") for i in range(40)] + [(99, "203.0.113.7 is taken")]
    got = surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    seen = {}
    for r in got:
        for raw, new in zip(re.findall(r"\d+\.\d+\.\d+\.\d+", dict(rows)[r.doc_id]), r.surrogates, strict=True):
            assert seen.setdefault(raw, new) == new
            assert new in r.text and raw not in r.text.split()
    assert len(set(seen.values())) == len(seen) == 21 and "203.0.113.7" not in seen.values()
    assert real is not surrogates.surrogate


NAMED = [
    "Priya Raman, Mohammed Ali, Wei Zhang, Katarzyna Nowak and Γιώργος Παπαδόπουλος met ANNA SCHMIDT. Later Ms Schmidt said that Anna was out.",
    "Anna Maria Schmidt wrote to Dr. Van Der Berg. Schmidt then rang. My name is Zoltan Kovacs; Kovacs paid. Jan van der Meer and Jennifer Brown left.",
    "Меня зовут Пётр Ильин. Ильин ушёл.", "Clean prose without any of them, The End.", "Schmidt alone is a word here.",
]
NAME_WORDS = [{"Priya", "Raman", "Mohammed", "Ali", "Wei", "Zhang", "Katarzyna", "Nowak", "Γιώργος", "Παπαδόπουλος", "ANNA", "SCHMIDT", "Schmidt", "Anna"}, {"Anna", "Maria", "Schmidt", "Van", "Der", "Berg", "Zoltan", "Kovacs", "Jan", "Meer", "Jennifer", "Brown"}, {"Пётр", "Ильин"}, set(), set()]


def test_names_in_context_and_their_later_mentions(spark):
    """Against brute force: of each text exactly the words of its names are replaced, one word always by the same, different ones by different ones."""
    got = {r.doc_id: r for r in surrogates.replace(spark.createDataFrame(list(enumerate(NAMED)), "doc_id long, text string")).collect()}
    split, same = re.compile(r"[^\w'’-]+"), {}
    for i, (text, names) in enumerate(zip(NAMED, NAME_WORDS, strict=True)):
        old, new = split.split(text), split.split(got[i].text)
        assert len(old) == len(new)
        for a, b in zip(old, new, strict=True):
            assert (a != b) == (a in names), (a, b)
            if a != b:
                assert a.isupper() == b.isupper() and same.setdefault(a.lower(), b.lower()) == b.lower()
    assert len(set(same.values())) == len(same)
    assert surrogates.replace(spark.createDataFrame([(1, NAMED[3])], "doc_id long, text string")).first().n_entities == 0


def test_names_never_run_out(spark, monkeypatch):
    """Far more surnames than there are to draw from at first, and given names of one pair."""
    monkeypatch.setattr(surrogates, "SYLLABLES", {k: v[:1] for k, v in surrogates.SYLLABLES.items()})
    monkeypatch.setattr(surrogates, "GIVEN", {("latin", "f"): ("Anna",), ("latin", "m"): ("Peter",)})
    names = ["".join(chr(97 + int(c)) for c in f"{i:04d}").capitalize() for i in range(2000)]
    rows = [(i, f"Emma {n} and {n}.") for i, n in enumerate(names)]
    got = surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.surrogates[0].split()[1] == r.surrogates[1] for r in got) and len({r.surrogates[1] for r in got}) == 2000 and len({r.surrogates[0].split()[0] for r in got}) == 1


# 8


@pytest.mark.parametrize("batch_bytes", [1 << 9, 1 << 20])
def test_lm_scores(docs, monkeypatch, batch_bytes):
    monkeypatch.setattr(lm_scoring, "BATCH_BYTES", batch_bytes)
    monkeypatch.setattr(lm_scoring, "RANGE_NGRAMS", 200)
    counts, texts = Counter(), [words(t) for _, t, *_ in ROWS]
    for w in texts:
        for n in (1, 2, 3):
            counts.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = sum(map(len, texts))
    want = []
    for (i, *_), w in zip(ROWS, texts, strict=True):
        s, short = 0.0, 0
        for j in range(len(w)):
            most = n = min(3, j + 1)
            while n > 1 and counts[tuple(w[j - n + 1 : j + 1])] < lm_scoring.MIN_COUNT:
                n -= 1
                s += math.log(lm_scoring.ALPHA)
            short += n < most
            s += math.log(counts[tuple(w[j - n + 1 : j + 1])] / (counts[tuple(w[j - n + 1 : j])] if n > 1 else total))
        want.append((i, len(w), round(s, 5), short))
    assert pairs(lm_scoring.lm_scores(docs).withColumn("s", F.round("log_score", 5)), "doc_id", "n_words", "s", "n_backed_off") == sorted(want, key=repr)


# 9


def test_quality_rules(docs):
    got = quality_rules.quality_rules(docs)
    for r in got.collect():
        text = next(t for i, t, *_ in ROWS if i == r.doc_id) or ""
        w, lines = words(text), [x for x in text.split("\n") if words(x)]
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r.kept and r.base_failed)
    kept = {r.doc_id: r for r in got.where("kept").collect()}
    assert {0, 1, 2, 3, 4, 5, 6, 20, 21} <= set(kept) and not {7, 9, 10, 11, 15, 16, 19} & set(kept)
    assert kept[0].cleaned == BASE
    menu = got.where("doc_id = 18").first()
    assert menu.n_failed_lines == 2 and menu.cleaned == text_of(5, 20)
    out = quality_rules.clean_documents(docs)
    assert out.columns == docs.columns and all(r.n_chars == len(r.text) for r in out.collect())


# 10


def fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(docs):
    assert pairs(simhash.fingerprints(docs).withColumn("x", F.hex("fp")), "id", "x") == sorted(((i, f"{fingerprint(t):X}") for i, t, *_ in ROWS), key=repr)


def test_near_duplicates(docs):
    known = [r for r in ROWS if r[0] is not None]
    fps = [fingerprint(t) for _, t, *_ in known]
    of = classes(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least, size = {}, Counter(of)
    for r, c in zip(known, of, strict=True):
        least[c] = min(least.get(c, 99), r[0])
    got = simhash.near_duplicates(docs.where("doc_id is not null"))
    assert pairs(got, "doc_id", "component_id", "n_rows") == sorted(((r[0], least[c], size[c]) for r, c in zip(known, of, strict=True)), key=repr)
    stay = simhash.one_of_each(docs.where("doc_id is not null"))
    assert stay.columns == docs.columns and sorted(r.doc_id for r in stay.collect()) == sorted(set(least.values()))


def test_one_of_each_with_null_and_repeated_ids(spark):
    """Distinct texts without ids, or of one id, all stay; a near copy under a repeated id doesn't come back."""
    a, b, c, d = (text_of(s) for s in (11, 12, 13, 14))
    near = next(x for w in prose(11, 120) if (x := a.replace(w, "zz", 1)) != a and 0 < (fingerprint(a) ^ fingerprint(x)).bit_count() <= 3)
    rows = [(None, a), (None, b), (None, b), (1, c), (2, near), (2, d), (2, d), (3, c + " "), (4, a)]
    got = sorted((r.doc_id, r.text) for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id is not None)
    none = [r.text for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id is None]
    assert none == [b] and got == sorted([(1, c), (2, near), (2, d)])


@pytest.mark.parametrize("limit", [2, 256])
def test_links_of_dense_and_sparse_fingerprints(spark, monkeypatch, limit):
    """All ways that buckets are linked, with pairs allowed in most buckets or in hardly any."""
    monkeypatch.setattr(simhash, "PAIR_LIMIT", limit)
    rng = np.random.default_rng(limit)
    fps = {int(x) for x in rng.integers(-(1 << 63), 1 << 63, 60, dtype=np.int64)}
    for centre in list(fps)[:6]:
        for _ in range(30):
            x = centre & (1 << 64) - 1
            for b in rng.integers(0, 64, rng.integers(1, 7)):
                x ^= 1 << int(b)
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    of = classes(fps, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    least = defaultdict(lambda: 1 << 63)
    for x, c in zip(fps, of, strict=True):
        least[c] = min(least[c], x)
    size = Counter(of)
    got = {r.node: r.component for r in simhash.link(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    assert got == {x: least[c] for x, c in zip(fps, of, strict=True) if size[c] > 1}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 203), (203, 201), (None, 5)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | {100: 100, 101: 100, 200: 200, 201: 200, 203: 200}


# the pipeline


def test_pipeline(spark, docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(now.collect())
        assert k == 4 or now.columns == plain.columns
    cleaned, lines, single, mixed, packed = seen
    assert {r.doc_id for r in cleaned} == {r.doc_id for r in quality_rules.quality_rules(plain).where("kept").collect()}
    texts = {r.doc_id: r.text for r in lines}
    assert 1 not in texts and texts[0] == BASE  # a copy has no line of its own left
    assert {r.doc_id for r in single} <= set(texts) and len({fingerprint(r.text) for r in single}) == len(single)
    assert all(any(r.text == s.text or s.text.startswith(r.text) for s in single if s.doc_id == r.doc_id) for r in mixed)
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in mixed)
    assert pairs(corpus_pipeline.run(spark, str(tmp_path)), "doc_id", "piece", "length", "ids_crc32") == sorted(((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed), key=repr)

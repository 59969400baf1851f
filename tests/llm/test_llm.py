"""Operators of the llm subpackage against brute force, round trips and edge cases, on small made-up rows."""

import collections
import datetime as dt
import difflib
import itertools
import math
import os
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path as tokenizer_path

import corpus_pipeline
from geoloom.llm import chat, components, decontamination, divergence, interpolation, minhash, packing, passages, pii, quality, queries, sharding, words

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPEC = tokenizer_path("byte_bpe_50k.json")


def texts(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeats, and columns whose names operators use themselves."""
    rng = random.Random(3)
    long = prose(rng, 20_000, 5_000)
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, long), (5, long + " end"), (None, "no id here"), (None, None), (6, "twice"), (6, "twice"), (6, "another"), (7, "é😀\x85  x"), (8, prose(rng, 60)), (-9, prose(rng, 60))]
    return spark.createDataFrame([(i, t, None, None, None, "x", 1, 2) for i, t in rows], SCHEMA + ", shard string, score int, key int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# words


@given(st.lists(st.text(alphabet="ab é\n\t\x0b😀", max_size=30), max_size=8))
@settings(max_examples=200, deadline=None)
def test_words(values):
    raw = "".join(values).encode()
    bounds = np.cumsum([0, *(len(v.encode()) for v in values)])
    offsets, hashes = words.word_hashes(np.frombuffer(raw, np.uint8), bounds)
    found = [WORD.findall(v) for v in values]
    assert np.diff(offsets).tolist() == [len(f) for f in found]
    flat = [w for f in found for w in f]
    names = {w: h for w, h in zip(flat, hashes.tolist(), strict=True)}
    assert [names[w] for w in flat] == hashes.tolist() and len(set(names.values())) == len(names)


def test_words_longer_than_a_run(monkeypatch):
    value = "a b " + "c" * 3000 + " d " + "c" * 3000
    whole = words.word_hashes(np.frombuffer(value.encode(), np.uint8), np.array([0, len(value)]))[1]
    monkeypatch.setattr(words, "_RUN", 64)
    monkeypatch.setattr(words, "_POWERS", {})
    short = words.word_hashes(np.frombuffer(value.encode(), np.uint8), np.array([0, len(value)]))[1]
    assert short[2] == short[4] and short[0] == whole[0] and short[3] == whole[3]


def test_shingles():
    offsets, hashes = np.array([0, 3, 3, 9]), np.arange(9, dtype=np.uint64)
    at, runs = words.shingles(offsets, hashes, 5)
    assert at.tolist() == [0, 1, 1, 3] and len(set(runs.tolist())) == 3


# 1 packing


@given(st.lists(st.integers(0, 700), max_size=60), st.sampled_from([16, 64, 256]))
@settings(max_examples=150, deadline=None)
def test_pack_lengths(lengths, capacity):
    pieces = packing.pack_lengths(lengths, capacity)
    for doc, length in enumerate(lengths):
        own = sorted((s, n) for d, s, n, _, _ in pieces if d == doc)
        assert sum(n for _, n in own) == length and [s for s, _ in own] == list(itertools.accumulate([0, *(n for _, n in own)]))[:-1]
    by = collections.defaultdict(list)
    for _, _, n, s, at in pieces:
        by[s].append((at, n))
    for own in by.values():
        own.sort()
        assert [a for a, _ in own] == list(itertools.accumulate([0, *(n for _, n in own)]))[:-1] and sum(n for _, n in own) <= capacity
    assert len(by) * capacity - sum(lengths) < capacity


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_tokens_are_those_of_the_file(text):
    from tokenizers import Tokenizer

    global _reference, _ours
    if "_reference" not in globals():
        _reference, _ours = Tokenizer.from_file(SPEC), packing.byte_level_encoding(open(SPEC, "rb").read())
    for t in (text, f"{text}<|endoftext|> {text}"):
        assert _ours.encode(t, allowed_special="all") == _reference.encode(t, add_special_tokens=False).ids


def test_pack(spark, odd, none):
    got = packing.pack(odd, SPEC, block_tokens=4096).toPandas()
    encoding = packing.byte_level_encoding(open(SPEC, "rb").read())
    want = collections.Counter()
    for r in odd.collect():
        ids = np.array([*encoding.encode(r.text or "", allowed_special="all"), 1], "<u4")
        want[(r.doc_id, len(ids))] += 1
        if r.doc_id == 4:
            own = got[got.doc_id == 4].sort_values("start")
            assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()
    assert {(None if math.isnan(k[0]) else int(k[0]), int(k[1])) for k in zip(got.doc_id, got.doc_tokens, strict=True)} == set(want)
    assert got.length.sum() == sum(n * c for (_, n), c in want.items()) and got.groupby("sequence_id").length.sum().max() <= 2048
    assert not packing.pack(none, SPEC).count()


# 2 quality rules


def base_by_hand(text):
    text = text or ""
    found = WORD.findall(text)
    at = collections.defaultdict(list)
    for i in range(len(found) - 4):
        at[tuple(found[i : i + 5])].append(i)
    covered = {i + k for own in at.values() if len(own) > 1 for i in own for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules(spark, odd, none):
    rng = random.Random(5)
    rows = [(k, prose(rng, rng.randrange(80), 3 + k % 9) + "\n" * (k % 3) + prose(rng, 5, 2) + " #|") for k in range(60)]
    rows += [(r.doc_id, r.text) for r in odd.collect()]
    got = divergence.judge(texts(spark, rows).selectExpr("*", "'en' as lang", "'z' as language")).collect()
    want = sorted(((i, *base_by_hand(t)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=repr) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert not divergence.judge(none).count() and divergence.judge(odd).count() == odd.count()


def test_rules_common_words(spark):
    value = 'The road, "of" AND (to) in... a.b -- is) \nThat. it\'s ÀS'
    row = divergence.statistics(texts(spark, [(1, value)]).selectExpr("*", "'EN' as lang")).first()
    told = [re.sub(r"^[-.,;:!?\"()\[\]{}|#*$%&<>]+|[-.,;:!?\"()\[\]{}|#*$%&<>]+$", "", w).lower() for w in value.split()]
    want = [told.count(w) for w in divergence.COMMON["en"]]
    assert row.common[:20] == want and sum(want) == 7 and row.common[20] == len(value.split()) - sum(want)


def test_rules_distance(spark):
    rng = random.Random(6)
    common = "the of and to in a is that for it as was with be by on not this are or".split()
    rows = [(k, " ".join(rng.choice(common) if rng.random() < 0.4 else prose(rng, 1).replace("w", rng.choice("abcdefgh") * 4) + "." for _ in range(70))) for k in range(60)]
    junk = " ".join(f"xq{k}$$%%" for k in range(300))
    got = {r.doc_id: r for r in divergence.judge(texts(spark, [*rows, (99, junk)]).selectExpr("*", "'en' as lang")).collect()}
    assert not got[99].kept and got[99].chars_distance > 0.22 and all(got[k].kept for k, _ in rows)

    def distance(p, q):
        return math.sqrt(sum((x * math.log2(2 * x / (x + y)) if x else 0) + (y * math.log2(2 * y / (x + y)) if y else 0) for x, y in zip(p, q, strict=True)) / 2)

    p, q = [0.5, 0.5, 0.0], [0.1, 0.4, 0.5]
    told = spark.range(1).selectExpr(divergence._distance("array(0.5D, 0.5D, 0D)", "array(0.1D, 0.4D, 0.5D)") + " as d").first().d
    assert math.isclose(told, distance(p, q))


# 3 sharding


def place(x, n, key):
    a, b = sharding.domain(n)

    def h(i, v):
        out = 42
        for k in (key, i, v):
            out = xxhash.xxh64_intdigest(struct.pack("<q", k), out)
        return out - (1 << 64) if out >> 63 else out

    while True:
        left, right = divmod(x, b)
        for i in range(sharding.ROUNDS):
            if i % 2 == 0:
                right = (right + h(i, left) % b) % b
            else:
                left = (left + h(i, right) % a) % a
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 24, 25, 1000])
def test_sharding(spark, n):
    rows = [(i, "x" * (i % 7)) for i in range(n)]
    got = sharding.shard_documents(texts(spark, rows), 24).collect()
    assert sorted(r.row_number for r in got) == list(range(n))
    by = collections.defaultdict(list)
    for r in got:
        p = place(r.row_number, n, 2_024)
        assert (r.shard, r.slot) == (p % 24, p // 24) and r.size == 8 + r.doc_id % 7 and r.text_crc32 == zlib.crc32(b"x" * (r.doc_id % 7))
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(len(by[k]) for k in range(24)) <= 1
    again = sharding.shard_documents(texts(spark, rows[::-1]).repartition(3), 24).collect()
    assert sorted(got) == sorted(again)


def test_sharding_odd(spark, odd, none):
    got = sharding.shard_documents(odd, 5).collect()
    assert sorted(r.slot * 5 + r.shard for r in got) == list(range(odd.count()))
    assert not sharding.shard_documents(none).count()
    wide = sharding.shard(odd.drop("text"), 3, ["doc_id"])
    assert wide.count() == odd.count() and wide.columns.count("shard") == 1


# 4 decontamination


def edits_by_hand(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distances():
    rng = random.Random(1)
    for n in (1, 5, 12):
        a = np.array([[rng.randrange(4) for _ in range(n)] for _ in range(30)], np.uint64)
        b = np.array([[rng.randrange(4) for _ in range(n)] for _ in range(30)], np.uint64)
        lengths = np.array([rng.randrange(n + 1) for _ in range(30)])
        assert decontamination.edit_distances(a, b, lengths).tolist() == [edits_by_hand(x.tolist(), y[:k].tolist()) for x, y, k in zip(a, b, lengths, strict=True)]


def test_decontamination(spark, odd, none):
    rng = random.Random(2)
    items = [(k, " ".join(f"q{rng.randrange(3000)}" for _ in range(rng.randrange(10, 40)))) for k in range(30)] + [(40, None), (41, "short item")]
    rows, planted = [], {}
    for d in range(150):
        body = prose(rng, 200).split()
        if d % 2 == 0:
            k = rng.randrange(30)
            own = items[k][1].split()
            edits = rng.randrange(int(len(own) * 0.2) + 1)
            for _ in range(edits):
                at = rng.randrange(1, len(own) - 1)
                how = rng.randrange(3)
                own = own[:at] + (["new"] if how else []) + own[at + (how != 1) :]
            at = rng.randrange(200)
            body[at:at] = [own[0].upper() + ",", *own[1:]]
            planted[d] = k
        rows.append((d, " ".join(body)))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.contaminated(texts(spark, rows), benchmark).collect()
    found = {(r.doc_id, r.item_id): r for r in got}
    want = set()
    for d, t in rows:
        own = [w.lower().strip(",") for w in t.split()]
        for k, item in items[:30]:
            x = item.split()
            if planted.get(d) == k and any(edits_by_hand(x, own[s : s + len(x)]) <= int(len(x) * 0.2 + 1e-9) for s in range(len(own) - len(x) + 1)):
                want.add((d, k))
    assert set(found) <= want and len(set(found) & want) >= 0.97 * len(want)
    for (d, k), r in found.items():
        own = [w.lower().strip(",") for w in rows[d][1].split()][r.start : r.start + r.length]
        assert edits_by_hand(items[k][1].split(), own) == r.edits
    assert not decontamination.contaminated(odd, benchmark).count() and not decontamination.contaminated(none, benchmark).count()
    assert not decontamination.contaminated(texts(spark, rows), benchmark.limit(0)).count()


def test_plain_words():
    values = ["......deep-road!!!!!!", "- -- --- a", "((((((((x))))))))y(", "", "?????????"]
    raw, bounds = (np.frombuffer("".join(values).encode(), np.uint8), np.cumsum([0, *map(len, values)]))
    offsets, got = decontamination.plain_words(raw, bounds)
    want = decontamination.plain_words(np.frombuffer(b"deep-road a x))))))))y", np.uint8), np.array([0, 9, 11, 22]))[1]
    assert offsets.tolist() == [0, 1, 2, 3, 3, 3] and got.tolist() == want.tolist()


def test_clean_tells_what_contaminated_tells(spark, odd, monkeypatch):
    rng = random.Random(8)
    items = [(k, prose(rng, 30, 5000)) for k in range(12)]
    rows = [(k % 7, prose(rng, 40, 5000) + (" " + items[k % 12][1] if k % 3 == 0 else "")) for k in range(40)] + [(None, items[0][1]), (None, "clean")]
    table, bench = texts(spark, rows).selectExpr("*", "doc_id as more"), spark.createDataFrame(items, "item_id bigint, text string")
    for size in (8 << 20, 500):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
        kept = [(r.doc_id, r.text, r.more) for r in decontamination.clean(table, bench).collect()]
        assert sorted(kept, key=repr) == sorted(((i, t, i) for i, t in rows if not any(x in t for _, x in items)), key=repr)
    assert decontamination.clean(odd, bench).count() == odd.count()


def test_decontamination_in_blocks(spark, monkeypatch):
    items = [(k, " ".join(f"q{k}_{j}" for j in range(12))) for k in range(6)]
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 100)
    rows = [(k, f"before {t} after") for k, t in items]
    got = decontamination.contaminated(texts(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.start, r.edits) for r in got) == [(k, k, 1, 0) for k in range(6)]


# 5 near-duplicates


def test_signature_agreement():
    rng = np.random.default_rng(4)
    agree, want = 0.0, 0.0
    for _ in range(40):
        keys = np.unique(rng.integers(0, 1 << 63, 150).astype(np.uint64))
        w = rng.uniform(1, 3, len(keys))
        a, b = slice(0, 120), slice(30, len(keys))
        wb = w * rng.choice([1.0, 1.5], len(w))
        union = sum(max(w[i] if i < 120 else 0, wb[i] if i >= 30 else 0) for i in range(len(keys)))
        want += sum(min(w[i], wb[i]) for i in range(30, 120)) / union / 40
        agree += (minhash.signature(keys[a], w[a]) == minhash.signature(keys[b], wb[b])).mean() / 40
    assert abs(agree - want) < 0.05


def near_rows():
    rng = random.Random(9)
    rows = []
    for g in range(40):
        base = [f"v{rng.randrange(900)}" for _ in range(rng.randrange(60, 200))]
        for c in range(rng.choice([1, 1, 2, 5, 30 if g == 7 else 3])):
            own = list(base)
            for _ in range(rng.randrange(4) if c else 0):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
            if rng.random() < 0.2:
                rows.append((len(rows), rows[-1][1]))
    return rows


def classes_by_hand(rows, weighted, least=0.8):
    own = list(minhash.text_shingles(pa.RecordBatch.from_arrays([pa.array([t or "" for _, t in rows])], names=["text"])))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] or "") == (rows[j][1] or "") or (len(own[i][0]) and len(own[j][0]) and minhash.similarity(own[i], own[j], weighted) >= least):
            root[find(j)] = find(i)
    groups = collections.defaultdict(set)
    for i in range(len(rows)):
        groups[find(i)].add(i)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("chunk", [256, 4])
def test_near_duplicates(spark, monkeypatch, chunk):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    rows = near_rows()
    table = texts(spark, rows)
    got = minhash.near_duplicates(table).collect()
    groups = collections.defaultdict(set)
    for r in got:
        groups[r.class_id].add(r.doc_id)
        assert r.keep == (r.doc_id == r.class_id)
    weighted = minhash.frequencies(minhash.nodes(table))
    assert {frozenset(g) for g in groups.values()} == classes_by_hand(rows, weighted)
    assert all(len(groups[r.class_id]) == r.class_size and min(groups[r.class_id]) == r.class_id for r in got)


def star_rows(variants):
    """A base and variants of it that are linked to it, and mostly not to each other."""
    rng = random.Random(21)
    base = [f"v{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for _ in range(variants):
        own = list(base)
        for k in range(rng.choice([3, 4, 4])):
            own[rng.randrange(10 + 70 * k, 70 + 70 * k)] = f"n{rng.randrange(10**9)}"
        rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize(("chunk", "variants"), [(16, 150), (256, 150)])
def test_near_duplicates_of_a_star(spark, monkeypatch, chunk, variants):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    rows = star_rows(variants)
    table = texts(spark, rows)
    groups = collections.defaultdict(set)
    for r in minhash.near_duplicates(table).collect():
        groups[r.class_id].add(r.doc_id)
    want = classes_by_hand(rows, minhash.frequencies(minhash.nodes(table)))
    assert max(map(len, want)) > variants / 2 and {frozenset(g) for g in groups.values()} == want


def test_similarities():
    rows = [t for _, t in near_rows()[:60]] + ["a b c d e f " * 40, "a b c d e f " * 30 + "g", "one", ""]
    own = list(minhash.text_shingles(pa.RecordBatch.from_arrays([pa.array(rows)], names=["text"])))
    often = np.sort(np.unique(np.concatenate([k for k, _ in own]))[::7])
    weighted = minhash.Frequencies(1000, 0.01, often, np.arange(len(often)) % 900 + 50.0)
    for columns in (4096, 16):
        minhash.COLUMNS = columns
        got = minhash.similarities(own[:40], own[20:], weighted)
        want = np.array([[minhash.similarity(x, y, weighted) for y in own[20:]] for x in own[:40]])
        assert np.allclose(got, want, atol=1e-6)
    minhash.COLUMNS = 4096


def test_near_duplicates_of_two_families(spark, monkeypatch):
    """Buckets of hundreds that hold two families with similarities of about 0.6 between them; compared with all pairs."""
    monkeypatch.setattr(minhash, "CHUNK", 64)
    rng = random.Random(5)
    first = [f"v{rng.randrange(10**6)}" for _ in range(200)]
    second = [f"w{rng.randrange(10**6)}" if k % 34 == 7 else w for k, w in enumerate(first)]
    rows = []
    for base in (first, second):
        for _ in range(500):
            own = list(base)
            for _ in range(rng.choice([1, 2, 3, 4, 4])):
                own[rng.randrange(200)] = f"n{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(own)))
    table = texts(spark, rows)
    weighted = minhash.frequencies(minhash.nodes(table))
    own = list(minhash.text_shingles(pa.RecordBatch.from_arrays([pa.array([t for _, t in rows])], names=["text"])))
    near = minhash.similarities(own, own, weighted) >= 0.8
    root = np.arange(len(rows))
    while (new := np.array([root[n].min() for n in near])).tolist() != root.tolist():
        root = new
    assert len(set(root)) > 2 and 0.5 < minhash.similarities(own[:1], own[500:501], weighted)[0, 0] < 0.75
    signed = minhash.signatures(minhash.nodes(table), weighted).select("node", "bands", "sketch", "size").distinct()
    assert minhash.met_members(signed).agg({"m": "max"}).first()[0] > 256
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(table).collect()} == dict(enumerate(root.tolist()))


def test_frequencies_are_exact(spark):
    rows = near_rows()
    weighted = minhash.frequencies(minhash.nodes(texts(spark, rows)), 0.05)
    counts = collections.Counter()
    for keys, _ in minhash.text_shingles(pa.RecordBatch.from_arrays([pa.array([t for _, t in rows])], names=["text"])):
        counts.update(keys.tolist())
    want = {k: n for k, n in counts.items() if n > 0.05 * len(rows)}
    assert want and dict(zip(weighted.keys.tolist(), weighted.counts.astype(int).tolist(), strict=True)) == want


def test_near_duplicates_odd(spark, odd, none):
    got = {(r.doc_id, r.class_id, r.class_size) for r in minhash.near_duplicates(odd).collect()}
    assert (4, 4, 2) in got and (5, 4, 2) in got  # the long text and its copy with a word more
    assert (1, 1, 3) in got and (2, 1, 3) in got and (None, 1, 3) in got  # null and empty texts are equal
    assert (3, 3, 1) in got and (6, 6, 2) in got and (6, 6, 1) in got
    assert not minhash.near_duplicates(none).count()


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    groups = {n: {n} for n in itertools.chain(*links)}
    for a, b in links:
        if groups[a] is not groups[b]:
            groups[a] |= groups[b]
            for n in groups[b]:
                groups[n] = groups[a]
    for a, b in itertools.combinations(got, 2):
        assert (got[a] == got[b]) == (groups[a] is groups[b])
    assert not components.components(spark.createDataFrame([], "a bigint, b bigint")).count()


# 6 language model


def test_language_model(spark, odd):
    rng = random.Random(8)
    rows = [(k, prose(rng, rng.randrange(40), 60).replace("w1", "W1")) for k in range(200)] + [(r.doc_id, r.text) for r in odd.collect()]
    got = interpolation.score(texts(spark, rows)).collect()
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    tokens = [[*WORD.findall((t or "").translate(lower)), None] for _, t in rows]
    folds = [zlib.crc32(("" if i is None else str(i)).encode()) for i, _ in rows]
    count = collections.Counter(itertools.chain(*(t for t, f in zip(tokens, folds, strict=True) if f % 5 != 1)))
    n, v = sum(count.values()), len(count)
    want = []
    for (i, _), own, f in zip(rows, tokens, folds, strict=True):
        base = sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        want.append((i, f % 5 == 1, len(own), sum(count[t] > 0 for t in own), n, round(base, 6)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == sorted(want, key=repr)

    table, (tokens_n, distinct, tuning_n, tuning_v) = interpolation.counted(texts(spark, rows))
    assert (tokens_n, distinct) == (n, v)
    mixed = interpolation.weights(table, tuning_n, tuning_v)
    assert np.allclose(mixed.sum(axis=1), 1) and (mixed >= 0).all()
    pairs = collections.Counter(p for t, f in zip(tokens, folds, strict=True) if f % 5 != 1 for p in zip([0, *t[:-1]], t, strict=True))
    train = sum(f % 5 != 1 for f in folds)
    score = collections.defaultdict(list)
    for (i, _), own in zip(rows, tokens, strict=True):
        total = 0.0
        for before, t in zip([0, *own[:-1]], own, strict=True):
            c = train if before == 0 else count[before]
            m = mixed[int(interpolation.bucket(np.array([c]))[0])]
            total += math.log10(m[0] * pairs[before, t] / max(c, 1) + m[1] * count[t] / n + m[2] / (v + 1))
        score[i].append(round(total, 5))
    for r in got:
        assert round(r.score, 5) in score[r.doc_id] or min(abs(r.score - s) for s in score[r.doc_id]) < 1e-4


@pytest.mark.parametrize("n", [0, 1, 7, 5000, 200_000])
def test_packed_keys(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64))
    at = [0, *interpolation._ranges(keys, 3), len(keys)]
    for k in range(3):
        own = keys[at[k] : at[k + 1]]
        packed = interpolation._pack40(own, k, 3)
        back = interpolation._unpack40(packed)
        low, high = -(-(k << 64) // 3), -(-((k + 1) << 64) // 3)
        assert [int(x) for x in back] == [(int(x) - low) >> ((high - low - 1).bit_length() - 40) for x in own]
        assert len(packed) == 1 + (4 if packed[:1] == b"4" else 5) * len(own) and (n < 5000 or packed[:1] == b"4")
    assert (interpolation._unpacked(interpolation._packed(np.array([[1, 2], [70000, 0]])), 2) == [[1, 2], [70000, 0]]).all()


def test_language_model_prefers_what_repeats(spark):
    rng = random.Random(1)
    phrase = "there was an old road that led from the mill down to the river".split()
    rows = [(k, " ".join(phrase[(a := rng.randrange(8)) : a + 5] * 4) + " " + prose(rng, 5)) for k in range(400)]
    held = [r for r in interpolation.score(texts(spark, rows)).collect() if r.held_out]
    assert sum(r.score for r in held) > 0.6 * sum(r.base_score for r in held)


def test_language_model_empty(spark, none):
    assert not interpolation.score(none).count()
    only = [k for k in range(50) if zlib.crc32(str(k).encode()) % 5 == 1]
    got = interpolation.score(texts(spark, [(k, "a b") for k in only])).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got)


# 7 quality


def test_quality_features_by_hand():
    value = "One two Two, two two! #|\nlast 42 é"
    raw = np.frombuffer(value.encode(), np.uint8)
    got = dict(zip(quality.FEATURES, quality.features(raw, np.array([0, len(raw)]))[0], strict=True))
    assert math.isclose(got["log_words"], math.log1p(9)) and math.isclose(got["words_per_line"], math.log1p(4.5))
    n = sum(len(w.encode()) for w in value.split())
    assert math.isclose(got["digits"], math.log(2.5 / (n - 2 + 0.5)))
    assert np.isfinite(quality.features(np.zeros(0, np.uint8), np.zeros(3, np.int64))).all()


def test_quality(spark, odd, none):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(600):
        good = k % 4 > 0
        text = prose(rng, rng.randrange(30, 120), 300) + "." if good else " ".join(f"W{rng.randrange(300)}!!$$" for _ in range(80))
        rows.append((k, text))
        labels.append((k, int(good), 0))
    labels += [(1, 0, None), (None, 1, 0), (2, None, 1)]
    table, known = texts(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = quality.classify(table, known).collect()
    assert len(got) == 600 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 > 0) for r in held) >= 0.97 * len(held)
    odd_got = quality.classify(odd, known).collect()
    assert len(odd_got) == odd.count() and all(0 <= r.score <= 1 for r in odd_got)
    assert not quality.classify(none, known).count()
    flipped = known.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality")
    assert sorted(quality.classify(table, flipped).collect()) == sorted(got)  # held-out labels aren't learned from


def test_shrinkage_is_cross_validated(spark, monkeypatch):
    monkeypatch.setattr(quality, "FEATURES", ("a", "b"))
    rng = np.random.default_rng(8)
    rows = [([float(v) for v in rng.normal(0.6 * y, 1 + y, 2)], y, int(rng.integers(1, 5))) for y in (0, 1) for _ in range(60)]
    table = spark.createDataFrame(rows, "x array<double>, y int, fold int")
    loss = []
    for pooled, sphere in quality.SHRINKAGES:
        total = 0
        for f in quality.TRAINING:
            own = {y: np.array([x for x, z, g in rows if z == y and g != f]) for y in (0, 1)}
            model = quality.Discriminant({y: (len(v), v.sum(axis=0), v.T @ v) for y, v in own.items()}, pooled, sphere)
            total -= sum(math.log(s if y else 1 - s) for (x, y, g) in rows if g == f for s in model.scores(np.array([x])))
        loss.append(total)
    parts = quality.moments_of(table)
    models = {f: [quality.Discriminant(quality.summed([p for g, p in parts.items() if g != f]), *s) for s in quality.SHRINKAGES] for f in parts}
    assert np.allclose(quality.losses(table, models), loss)
    at = np.array([[0.3, -1.0], [2.0, 2.0]])
    whole = quality.summed(list(parts.values()))
    assert np.allclose(quality.fit(table).scores(at), quality.Discriminant(whole, *quality.SHRINKAGES[int(np.argmin(loss))]).scores(at))


def test_passable_is_what_classify_keeps(spark, odd):
    rng = random.Random(4)
    rows = [(k, prose(rng, rng.randrange(30, 120), 300) + "." if k % 4 else " ".join(f"W{rng.randrange(300)}!!$$" for _ in range(80))) for k in range(300)]
    known = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(300)], "doc_id bigint, quality int")
    table = texts(spark, [*rows, (None, rows[0][1]), (None, rows[1][1]), (5, rows[4][1])]).selectExpr("*", "text as more")
    told = {r.doc_id for r in quality.classify(table, known).where("predicted = 0").collect()}
    kept = quality.passable(table, known).collect()
    assert len(kept) == 303 - 2 - sum(k % 4 == 0 for k in range(300)) and all(r.text == r.more and not r.text.startswith("W") for r in kept)
    assert {0, None, 5} <= told and sum(r.doc_id is None for r in kept) == 1
    assert quality.passable(odd, known.limit(0)).count() == odd.count()


def test_discriminant_by_hand():
    rng = np.random.default_rng(5)
    x = {0: rng.normal(0, 1, (300, 3)), 1: rng.normal(1, 0.5, (500, 3))}
    model = quality.Discriminant({y: (len(v), v.sum(axis=0), v.T @ v) for y, v in x.items()}, 0.0, 0.0)
    at = rng.normal(0.5, 1, (20, 3))
    density = []
    for y in (0, 1):
        cov, d = np.cov(x[y].T, bias=True), at - x[y].mean(axis=0)
        density.append(np.log(len(x[y]) / 800) - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(model.scores(at), 1 / (1 + np.exp(density[0] - density[1])))


# 8 PII

KEY = b"test"
SAMPLES = {
    "email": "jane.doe+x7@mail.example.com", "card": "4111 1111 1111 1111", "phone": "+1 (017) 555-7713", "local": "(212) 555-0147", "ssn": "123-45-6789", "ip": "192.168.0.17",
    "iso": "2024-02-29", "day": "31/12/1999", "iban": "GB82 WEST 1234 5698 7654 32", "secret": "04dbebab91ab85687d33eeaaf9ac699e1188f962",
}


@pytest.mark.parametrize("kind", SAMPLES)
def test_pseudonyms(kind):
    value = SAMPLES[kind]
    text, found = pii.pseudonymized(f"see {value}, and {value} again", KEY)
    assert [f[0] for f in found] == [kind] * 2 and found[0][2] == found[1][2] != value
    new = found[0][2]
    assert [re.sub("[a-z]", "a", re.sub("[0-9]", "9", c)) for c in new] == [re.sub("[a-z]", "a", re.sub("[0-9]", "9", c)) for c in value] or kind in ("ip", "secret", "iban")
    assert pii.pseudonym(kind, new, KEY, inverse=True) == value and pii.pseudonymized(new, KEY)[1]
    assert pii.pseudonym(kind, value, b"other") != new and text == f"see {new}, and {new} again"


@pytest.mark.parametrize("value", ["4111 1111 1111 1112", "2023-02-29", "300.1.1.1", "1.2.3.4.5", "000-12-3456", "GB82 WEST 1234 5698 7654 33", "12/13/14", "473696257", "version 4.0.", "2350-01-01"])
def test_what_is_not_valid_stays(value):
    assert pii.pseudonymized(f"a {value} b", KEY) == (f"a {value} b", [])


@given(st.integers(0, 9999), st.integers(1, 4000), st.binary(min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_permutations(x, n, key):
    assert pii.walked(pii.walked(x % n, n, key), n, key, inverse=True) == x % n
    if n < 60:
        assert sorted(pii.walked(i, n, key) for i in range(n)) == list(range(n))


@given(st.dates(pii.FIRST_DAY, pii.LAST_DAY))
@settings(max_examples=60, deadline=None)
def test_dates_stay_dates(day):
    new = pii.pseudonym("iso", day.isoformat(), KEY)
    assert pii.FIRST_DAY <= dt.date.fromisoformat(new) <= pii.LAST_DAY


def written_dates():
    """All forms in which a day is written, with one separator."""
    for day in (pii.FIRST_DAY + dt.timedelta(k) for k in range(0, (pii.LAST_DAY - pii.FIRST_DAY).days + 1, 1)):
        d, m = {f"{day.day:02d}", str(day.day)}, {f"{day.month:02d}", str(day.month)}
        yield from (f"{a}/{b}/{day.year}" for a in d for b in m)
        if day.day > 12:
            yield from (f"{b}/{a}/{day.year}" for a in d for b in m)
        yield day.isoformat()


def test_dates_share_no_pseudonym():
    given_dates = [x for k, x in enumerate(written_dates()) if k % 7 == 0]
    seen = {}
    for value in given_dates:
        new = pii._date(value, KEY, False)
        assert [len(p) for p in re.split("[-/]", new)] == [len(p) for p in re.split("[-/]", value)]
        assert pii._date(new, KEY, True) == value and seen.setdefault(new, value) == value
    assert len(seen) > 40_000 and pii._date("23/09/1901", KEY, False).split("/")[::-1] == pii._date("1901-09-23", KEY, False).split("-")


def test_email_case():
    one, two = (pii.pseudonym("email", v, KEY) for v in ("Ann.Lee@x.org", "ann.lee@x.org"))
    assert one != two and one.lower() == two and pii.pseudonym("email", one, KEY, inverse=True) == "Ann.Lee@x.org"


def test_pii_table(spark, odd, none):
    table = spark.createDataFrame([(1, f"a {SAMPLES['card']} b", 5), (2, f"({SAMPLES['card']})", 6), (3, None, 7), (4, "", 8)], "doc_id bigint, text string, pii_found int")
    got = {r.doc_id: r for r in pii.pseudonymize(table, KEY).collect()}
    assert got[1].pii_found[0].value == got[2].pii_found[0].value in got[1].text and got[3].text is None and got[4].pii_found == []
    out = pii.pseudonymize(odd, KEY)
    assert sorted(map(repr, out.select(odd.columns).collect())) == sorted(map(repr, odd.collect()))
    assert not pii.pseudonymize(none, KEY).count()
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymize(odd, b"")


# 9 chat


def test_chat(spark):
    said = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes?"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes?"), (2, 2, "user", "bye"), (3, 2, "user", "bye"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes?"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, 0, "user", None), (6, 0, "user", ""), (6, 0, "user", ""), (None, 0, "user", "stray"), (None, 1, None, None), (7, None, "system", "s"), (7, 0, "user", "hi")]
    got = {r.conv_id: r for r in chat.render(spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as copies", "'x' as own")).collect() if r.conv_id is not None}
    assert sorted(got) == [2, 4, 5, 6, 7] and got[2].copies == 2 and got[2].n_turns == 3
    assert got[2].rendered == "<|user|>\nhi<|end|>\n<|assistant|>\nyes?<|end|>\n<|user|>\nbye<|end|>\n" and got[7].rendered.startswith("<|system|>\ns")
    assert not chat.render(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count()


def test_chat_without_id(spark):
    said = [(None, 0, "user", "a"), (None, 1, "user", "a"), (None, 1, "user", "a"), (None, None, "user", "b"), (3, 0, "user", "c"), (3, 1, "user", "d"), (None, 5, "user", "c")]
    table = spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string")
    got = sorted(((r.conv_id, r.n_turns, r.copies, r.rendered) for r in chat.render(table).collect()), key=repr)
    line = lambda t: f"<|user|>\n{t}<|end|>\n"
    assert got == sorted([(3, 2, 1, line("c") + line("d")), (None, 1, 2, line("a")), (None, 1, 1, line("b"))], key=repr)
    con = duckdb.connect()
    con.register("conversations", table.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert sorted(con.execute(chat.RENDER_SQL).fetchall(), key=repr) == got


@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=5), max_size=12))
@settings(max_examples=12, deadline=None)
def test_chat_prefixes(spark, conversations):
    rows = [(c, t, "user", str(x)) for c, turns in enumerate(conversations) for t, x in enumerate(turns)]
    got = {r.conv_id for r in chat.render(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    want = {c for c, own in enumerate(conversations) if not any((len(o) > len(own) and o[: len(own)] == own) or (o == own and k < c) for k, o in enumerate(conversations))}
    assert got == want


# 10 passages


def windows_by_hand(values, least):
    found = collections.Counter()
    for i in range(len(values)):
        for j in range(i + least - 1, len(values)):
            found[int(values[i : j + 1].min())] += 1
    return found


@given(st.lists(st.integers(0, 50), min_size=1, max_size=40), st.integers(1, 8))
@settings(max_examples=100, deadline=None)
def test_compact_windows(values, least):
    values = np.array(values, np.uint64)
    covered = collections.Counter()
    for low, c, high in passages.compact_windows(values, least):
        assert values[c] == values[low : high + 1].min() and high - low + 1 >= least
        for i in range(low, c + 1):
            for j in range(max(c, i + least - 1), high + 1):
                covered[int(values[c])] += 1
    assert covered == windows_by_hand(values, least)


def test_passages_past_an_edit():
    rng = random.Random(31)
    word = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    met = found = 0
    for _ in range(200):
        own = word(60)
        changed = list(own)
        changed[rng.randrange(5, 55)] = "changed"
        pair = pa.array([" ".join(word(100) + p + word(100)) for p in (own, changed)])
        x, y = passages.text_runs(pair)
        keys = [set(passages.meeting_points(np.array([0, len(v)]), v, 46, *[np.zeros(0)] * 2)[0].tolist()) for v in (x, y)]
        met += bool(keys[0] & keys[1])
        found += any(s == 100 and n == 56 and t == 100 and m == 56 for s, n, t, m, _ in passages.shared_passages(x, y, 46, 0.8))
    assert met >= 190 and found == 200


def test_meeting_points_by_hand():
    rng = random.Random(6)
    own = [[rng.randrange(60) for _ in range(n)] for n in (9, 3, 0, 30, 8)]
    runs = np.array([mix_of(v) for x in own for v in x], np.uint64)
    offsets = np.cumsum([0, *map(len, own)])
    often, shares = np.sort(np.unique(runs)[::5]), np.linspace(0.01, 0.5, len(np.unique(runs)[::5]))
    key, text, place, split = passages.meeting_points(offsets, runs, 8, often, shares)
    ranks = [passages.ranked(runs, k, often, shares) for k in range(passages.HASHES)]
    want = {}
    for t, (low, high) in enumerate(itertools.pairwise(offsets)):
        for i in range(low, high - 7):
            for number, pair in enumerate(passages.PAIRS):
                name = (t, number, *(int(ranks[k][i : i + 8].min()) for k in pair))
                if name not in want or want[name][1] == i - low - 1:
                    want[name] = (want.get(name, (i - low,))[0], i - low)
    assert sorted(zip(text.tolist(), place.tolist(), strict=True)) == sorted((t, (first + last + 7) // 2) for (t, *_), (first, last) in want.items())
    assert sorted(split.tolist()) == sorted(min(a & 15, b & 15) for _, _, a, b in want) and len(set(key.tolist())) == len({w[1:] for w in want})


def mix_of(v):
    return int(passages.mix(np.array([v + 1], np.uint64))[0])


@pytest.mark.parametrize("levels", [(0, 1, 2, 3), (2, 3, 4, 5)])
def test_passages_dealt_unevenly(spark, levels):
    rng = random.Random(33)
    nodes = sorted(rng.randrange(-(1 << 63), 1 << 63) for _ in range(600))
    rows = [(100 + k + 10 * again, int(passages.salts(np.array([n]), np.array([split]))[0]), n, 0) for n in nodes for k, split in enumerate(levels) for again in (0, 1)]
    pairs = passages.candidates(passages.met(spark.createDataFrame(rows, "key bigint, salt smallint, node bigint, place int")))
    assert {(r.a, r.b) for r in pairs.collect()} >= set(itertools.pairwise(nodes))


def passages_by_hand(rows, least=46, similarity=0.8):
    """Documents in a pair whose aligned passages have that similarity, by all pairs and difflib's equal runs; and the classes."""
    own = [runs.tolist() for runs in passages.text_runs(pa.array([t for _, t in rows]))]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    hit = set()
    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(set(own[i]) & set(own[j])) < 0.8 * least or min(len(own[i]), len(own[j])) < least:
            continue
        blocks = [m for m in difflib.SequenceMatcher(None, own[i], own[j], autojunk=False).get_matching_blocks() if m.size]
        for x in range(len(blocks)):
            for y in range(x, len(blocks)):
                u, v = own[i][blocks[x].a : blocks[y].a + blocks[y].size], own[j][blocks[x].b : blocks[y].b + blocks[y].size]
                gaps = [max(q.a - p.a - p.size, q.b - p.b - p.size) for p, q in itertools.pairwise(blocks[x : y + 1])]
                if min(len(u), len(v)) >= least and max(gaps, default=0) <= passages.GAP and len(set(u) & set(v)) >= similarity * len(set(u) | set(v)):
                    hit |= {i, j}
                    root[find(i)] = find(j)
    return hit, {frozenset(rows[k][0] for k in hit if find(k) == r) for r in {find(k) for k in hit}}


@pytest.mark.parametrize("chunk", [256, 16])
def test_passages_against_all_pairs(spark, monkeypatch, chunk):
    """Exact, lightly and heavily edited passages; lines and phrases that half the texts hold; passages made of such lines."""
    monkeypatch.setattr(passages, "CHUNK", chunk)
    rng = random.Random(101)
    word = lambda n: [f"w{rng.randrange(10**8)}" for _ in range(n)]
    lines, phrase = [word(20) for _ in range(6)], word(5)
    shared = [word(n) for n in (50, 56, 60, 75, 100, 160, 220)] + [lines[0] + lines[1] + lines[2], lines[3] + lines[4] + lines[5]]
    rows = []
    for d in range(300):
        body = word(rng.randrange(30, 200))
        for k in range(6):
            if rng.random() < 0.08:
                body += lines[k] + word(rng.randrange(6, 30))
        if d % 2:
            body += phrase + word(8)
        if d % 5 == 0:
            own = list(rng.choice(shared))
            for at in range(len(own)):
                if rng.random() < (0, 0.01, 0.05, 0.15)[d // 5 % 4]:
                    own[at] = word(1)[0]
            body[len(body) // 2 : len(body) // 2] = own
        rows.append((d, " ".join(body)))
    hit, classes = passages_by_hand(rows)
    got = passages.repeated_passages(texts(spark, rows)).collect()
    told = collections.defaultdict(set)
    for r in got:
        told[r.class_id].add(r.doc_id)
    assert {r.doc_id for r in got} <= hit and len({r.doc_id for r in got}) >= 0.95 * len(hit) > 25
    pairs = lambda sets: {p for s in sets for p in itertools.combinations(sorted(s), 2)}
    assert pairs(told.values()) <= pairs(classes) and len(pairs(told.values())) >= 0.9 * len(pairs(classes))


def test_passages_between_texts_that_hold_runs_of_them(spark):
    """Two texts share 56 words; each five-word run of these stands in texts that share nothing else."""
    rng = random.Random(77)
    word = lambda n: [f"w{rng.randrange(10**8)}" for _ in range(n)]
    own = word(56)
    rows = [(k, " ".join(word(20) + own + word(20))) for k in (1, 2)]
    rows += [(10 + k, " ".join(word(24) + own[k % 52 : k % 52 + 5] + word(24))) for k in range(208)]
    got = passages.repeated_passages(texts(spark, rows)).collect()
    assert sorted((r.doc_id, r.start, r.length, r.other_id, r.class_id) for r in got) == [(1, 20, 56, 2, 1), (2, 20, 56, 1, 1)]


def test_passages_of_one_word_over_and_over(spark):
    """A text that repeats a run isn't verified with each text that holds the run once, but with those that repeat it too."""
    near = lambda v: np.array(v, "<u2").tobytes()
    rows = [(1, 1, 1, near([7] * 91), 1), (1, 2, 2, near(range(91)), 46), (1, 3, 3, near([7] * 80), 1)]
    members = spark.createDataFrame(rows, "set bigint, node bigint, label bigint, near binary, held int")
    assert [tuple(r) for r in passages.apart(members, 4, 46).collect()] == [(1, 3)]


def test_passages_end_when_nothing_is_untried(spark, monkeypatch):
    rng, calls, apart = random.Random(79), [], passages.apart
    monkeypatch.setattr(passages, "apart", lambda *a: calls.append(a) or apart(*a))
    own = prose(rng, 60, 10**6)
    got = passages.repeated_passages(texts(spark, [(k, f"{prose(rng, 30, 10**6)} {own}") for k in (1, 2)])).collect()
    assert {r.doc_id for r in got} == {1, 2} and len(calls) == 1


def test_passages_alike_give_forests(spark):
    """A group gives as many pairs as link it, not all of its pairs, and says that it has more."""
    rng = random.Random(80)
    own = [rng.randrange(1 << 16) for _ in range(91)]
    near = lambda k: np.array([*own[: k % 4], *own], "<u2").tobytes()
    members = spark.createDataFrame([(1, k, 1000 + k, near(k), 46) for k in range(100)], "set bigint, node bigint, label bigint, near binary, held int")
    for most in (1, 3):
        got = [tuple(r) for r in passages.apart(members, most, 46).collect()]
        pairs, goes = [p for p in got if p[1] is not None], list(range(100))
        assert sorted(p for p in got if p[1] is None) == [(1, None)] and 99 <= len(pairs) <= most * 99
        for _ in goes:
            for a, b in pairs:
                goes[a] = goes[b] = min(goes[a], goes[b])
        assert set(goes) == {0}


def test_passages_links_of_the_rest(spark, monkeypatch):
    """What no forest holds is verified too, and links classes."""
    monkeypatch.setattr(passages, "FORESTS", 0)
    monkeypatch.setattr(passages, "FIRST_KEYS", 100)
    rng = random.Random(81)
    own = [prose(rng, 60, 10**6) for _ in range(2)]
    got = passages.repeated_passages(texts(spark, [(k, f"{prose(rng, 30, 10**6)} {own[k % 2]}") for k in range(8)])).collect()
    assert {(r.doc_id, r.class_id) for r in got} == {(k, k % 2) for k in range(8)}


def test_components_extended(spark):
    links = lambda pairs: spark.createDataFrame(pairs, "a bigint, b bigint")
    known = components.components(links([(1, 2), (2, 3), (5, 6), (8, 9)]))
    for more, groups in (([(3, 6), (10, 11), (9, 9)], {(1, 2, 3, 5, 6), (8, 9), (10, 11)}), ([(12, 1), (12, 8), (1, 3)], {(1, 2, 3, 8, 9, 12), (5, 6)}), ([], {(1, 2, 3), (5, 6), (8, 9)})):
        own = collections.defaultdict(list)
        for r in components.extended(known, links(more)).collect():
            own[r.root].append(r.node)
        assert {tuple(sorted(v)) for v in own.values()} == groups and all(k in v for k, v in own.items())


def test_passages_shuffle_few_texts(spark, monkeypatch):
    """No step shuffles texts more than once, and none finds pairs twice over."""
    seen, found = passages.written, []

    def nodes(plan):
        plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
        below = plan.children()
        return [(plan.nodeName(), re.findall(r"(\w+)#", plan.output().mkString(" ")))] + [x for k in range(below.size()) for x in nodes(below.apply(k))]

    def written(df, *a):
        found.append(nodes(df._jdf.queryExecution().executedPlan()))
        return seen(df, *a)

    monkeypatch.setattr(passages, "written", written)
    monkeypatch.setattr(passages, "FORESTS", 0)
    rng = random.Random(81)
    own = [prose(rng, 60, 10**6) for _ in range(2)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = passages.repeated_passages(texts(spark, [(k, f"{prose(rng, 30, 10**6)} {own[k % 2]}") for k in range(8)])).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 8
    assert max(sum(name == "Exchange" and bool({"text", "ta", "tb"} & set(columns)) for name, columns in plan) for plan in found) == 1
    assert [sum(name == "MapInArrow" for name, _ in plan) for plan in found if any("partners" in columns for _, columns in plan)] == [1, 2]  # pairs; blocks of them


def test_passages_within_others_are_not_told(spark):
    """Rows of a document don't grow with the texts that share parts of one passage."""
    rng = random.Random(82)
    own = prose(rng, 300, 10**6).split()
    rows = [(k, " ".join([prose(rng, 20, 10**6), *own, prose(rng, 20, 10**6)])) for k in (1, 2)]
    rows += [(3 + k, " ".join([prose(rng, 20, 10**6), *own[10 * k : 10 * k + 60 + k], prose(rng, 20, 10**6)])) for k in range(20)]
    got = passages.repeated_passages(texts(spark, rows)).collect()
    told = {(r.doc_id, r.start, r.start + r.length) for r in got}
    assert {d for d, *_ in told} == {d for d, _ in rows} and {r.class_id for r in got} == {1} and len(told) == len(got)
    assert not [(x, y) for x in told for y in told if x != y and x[0] == y[0] and y[1] <= x[1] and x[2] <= y[2]]


def test_passages_copies(spark):
    rng = random.Random(78)
    long, short = prose(rng, 80, 10**6), prose(rng, 40, 10**6)
    rows = [(5, long), (3, long), (None, long), (3, long), (9, long), (1, short), (2, short), (7, prose(rng, 70, 10**6)), (7, long + " more of it")]
    got = {(r.doc_id, r.start, r.length, r.other_id, r.class_id) for r in passages.repeated_passages(texts(spark, rows)).collect()}
    assert {g for g in got if g[0] != 7} in ({(5, 0, 80, o, 3), (3, 0, 80, 9 if o == 3 else o, 3), (None, 0, 80, o, 3), (9, 0, 80, o, 3)} for o in (3, 7))
    assert len([g for g in got if g[0] == 7]) == 1 and len(got) == 5


def test_passages(spark, odd, none):
    rng = random.Random(12)
    shared = [prose(rng, n, 10_000).split() for n in (50, 60, 90, 200)]
    rows, holds = [], collections.defaultdict(set)
    for d in range(120):
        body = prose(rng, rng.randrange(20, 300), 10_000).split()
        if d % 3 == 0:
            k = rng.randrange(4)
            own = list(shared[k])
            if k == 3 and d % 2:
                own[100] = "changed"
            at = rng.randrange(len(body))
            body[at:at] = own
            holds[d].add((k, at))
        rows.append((d, " ".join(body)))
    got = passages.repeated_passages(texts(spark, rows)).collect()
    assert {r.doc_id for r in got} == set(holds)
    for r in got:
        (k, at), = holds[r.doc_id]
        assert abs(r.start - at) <= 5 and r.length >= len(shared[k]) - 1 and {k} == {x for x, _ in holds[r.other_id]}
        assert r.similarity >= 0.8 and r.class_id == min(d for d, own in holds.items() if {x for x, _ in own} == {k})
    again = passages.repeated_passages(odd).collect()
    assert {r.doc_id for r in again} == {4, 5} and all(r.length == 20_000 for r in again)
    assert not passages.repeated_passages(none).count()


# the queries and the pipeline


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_oracles(spark):
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, FOLDER)
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(rows_of(got.select(names)), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_pipeline(spark):
    """Each stage against what its operator alone says about the stage's own input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels, benchmark = spark.read.parquet(f"{FOLDER}/labels.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    gone = {
        "quality classifier": lambda d: {r.doc_id for r in quality.classify(d, labels).where("predicted = 0").collect()},
        "near-duplicates": lambda d: {r.doc_id for r in minhash.near_duplicates(d).where("not keep").collect()},
        "decontamination": lambda d: {r.doc_id for r in decontamination.contaminated(d, benchmark).collect()},
        "PII": lambda d: set(),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == corpus_pipeline.COLUMNS
        rows = [r.asDict() for r in out.collect()]
        before = {r.doc_id: r for r in docs.collect()}
        assert {r["doc_id"] for r in rows} == set(before) - gone[name](docs)
        if name == "PII":
            assert all(r["n_chars"] == len(r["text"]) and r["text"] == pii.pseudonymized(before[r["doc_id"]].text, queries.TRIAL_KEY)[0] for r in rows)
        docs = spark.createDataFrame([tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in rows], SCHEMA)
    packed = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in docs.collect()} and packed.groupby("sequence_id").length.sum().max() <= 2048


def test_pipeline_rejects_rows_not_ids(spark, tmp_path):
    rng = random.Random(44)
    t, u, p, q = (prose(rng, 60, 10**6) for _ in range(4))
    item = prose(rng, 20, 10**6)
    rows = [(1, t), (None, t), (None, u), (7, p), (7, t), (8, q), (8, q), (9, p + " more"), (7, f"{q[::-1]} {item}"), (None, item)]
    docs = texts(spark, rows).selectExpr("doc_id", "text", "'en' as lang", "'a' as source", "cast(length(text) as bigint) as n_chars", "1 as __row")
    one = corpus_pipeline.one_of_each(spark, docs, "")
    assert sorted(((r.doc_id, r.text) for r in one.collect()), key=repr) == sorted([(1, t), (None, u), (7, p), (8, q), rows[8], rows[9]], key=repr)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(rows[:8], key=repr)


def test_pipeline_odd(spark, odd, none, tmp_path):
    for name, part in (("odd", odd.select(corpus_pipeline.COLUMNS)), ("none", none)):
        part.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id bigint, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        # one of each: 1 of those without text, the spaces of 3, the lower of two near copies, both texts of 6, and single ones
        assert sorted((r.doc_id for r in got if r.start == 0), key=str) == sorted([1, 3, 4, None, 6, 6, 7, 8, -9] if name == "odd" else [], key=str)


def test_large_counts_survive():
    keys = [np.array([3, 9], np.uint64), np.array([9], np.uint64), np.zeros(0, np.uint64)]
    sent = [interpolation._packed(np.array(c, np.uint64).reshape(-1, 2)) for c in ([[1, 0], [2**32 - 1, 2**40]], [[7, 2**33]], [])]
    told, sums = interpolation._summed(keys, sent)
    assert sums.tolist() == [[1, 0], [2**32 + 6, 2**40 + 2**33]]
    assert interpolation._unpacked(told[1], 1).tolist() == [[2**32 + 6, 2**40 + 2**33]] and interpolation._unpacked(told[2], 0).shape == (0, 2)


def test_weights_are_those_of_em(spark):
    """EM token by token, without rounding probabilities to cells, gives nearly the same weights."""
    table_, (_, _, tokens, distinct) = interpolation.counted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    got = interpolation.weights(table_, tokens, distinct)
    own, parts = [], []
    for r in table_.where(f"role = {interpolation.TUNING}").collect():
        words = r.tuning_words
        for pair, word, context in zip(r.tuning_pairs, words, [words[-1], *words[:-1]], strict=True):
            own.append(0 if context == 0 else min(int(math.log2(context)) + 1, interpolation.BUCKETS - 1))
            parts.append((pair / max(context, 1), word / tokens, 1 / (distinct + 1)))
    own, parts = np.array(own), np.array(parts)
    want = np.tile([0.3, 0.6, 0.1], (interpolation.BUCKETS, 1))
    for _ in range(interpolation.ITERATIONS):
        share = want[own] * parts
        share /= share.sum(axis=1)[:, None]
        sums = np.stack([np.bincount(own, share[:, k], interpolation.BUCKETS) for k in range(3)], axis=1) + 0.01 * want
        want = sums / sums.sum(axis=1)[:, None]
    many = np.flatnonzero(np.bincount(own, minlength=interpolation.BUCKETS) > 100)
    many = many[many > 0]
    assert len(many) > 3 and np.abs(got[many] - want[many]).max() < 0.01

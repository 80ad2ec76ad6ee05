import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import DOCS, documents, words

from walkweave.llm import doubling, simhash, sketch, substring, suffix
from walkweave.llm.components import components
from walkweave.llm.sketch import Sketch, build
from walkweave.llm.spans import joined_runs
from walkweave.llm.windows import sliding_least, window_names


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# Window dedup


def brute_windows(rows, width=13):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - width + 1 if i is not None else 0):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - width + 1 if i is not None else 0):
            if first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((i, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    return Counter(out)


EXTRA = [(6, words(5, 80)), (None, words(5, 80)), (None, None), (5, words(77, 40) + words(5, 30)), (10, DOCS[9][1])]


@pytest.mark.parametrize("rows", [DOCS, DOCS + EXTRA, [], [(None, "x")]])
@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_windows(spark, rows, bound):
    got = substring.dedup(documents(spark, rows), broadcast_rows=bound).collect()
    assert Counter(map(tuple, got)) == brute_windows(rows)


def test_windows_beyond_a_small_bound(spark):
    rows = DOCS + EXTRA
    assert not sketch.fits(2 * sum(len(t or "") for _, t in rows) // 11, 14)
    got = substring.dedup(documents(spark, rows), most_bits=14).collect()
    assert Counter(map(tuple, got)) == brute_windows(rows)


@pytest.mark.parametrize("size", [300, 20_000, 8 << 20])
@pytest.mark.parametrize("rows", [DOCS + EXTRA, [], [(None, "x")], [(i, words(7, 60)) for i in (3, 1, 2)] + [(i, words(8, 40) + " " + words(50 + i, 400)) for i in range(4, 9)]])
def test_windows_with_a_sketch_that_stays_in_its_shards(spark, rows, size):
    got = substring.dedup(documents(spark, rows), most_bits=4, chunk_bytes=size).collect()
    assert Counter(map(tuple, got)) == brute_windows(rows)


def test_windows_are_read_equally_often_at_every_size(spark):
    """However many times too large the sketch is to be broadcast, there are equally many jobs."""
    context, frame = spark.sparkContext, documents(spark, DOCS)
    jobs = []
    for bits in (12, 13, 14):
        context.setJobGroup(f"windows {bits}", "")
        substring.dedup(frame, most_bits=bits).collect()
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"windows {bits}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert not sketch.fits(2 * sum(len((t or "").encode()) for _, t in DOCS) // 11, 14)
    assert max(jobs) - min(jobs) <= 8 and min(jobs) > 0


def test_shards_let_few_unique_windows_through(spark):
    rows = [(i, words(5000 + i, 2000)) for i in range(100)] + [(900 + i, words(9000, 400) + " " + words(9100 + i, 1500)) for i in range(3)]
    texts = {i: substring._names(t.encode().split(), 13) for i, t in rows}
    chunks = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in rows], "chunk bigint, data binary").repartition(4)
    bits = sketch.bits_for(sum(len(a) for a, _ in texts.values()), 48, 8)

    def lanes(data):
        return substring._names(bytes(data).split(), 13)

    def find(data, own):
        a, b = lanes(data)
        yield pa.RecordBatch.from_pydict({"a": a[own.holds(a, b)].view(np.int64)})

    made = sketch.repeated_cells(chunks, lanes, bits)
    got = Counter(r.a for r in sketch.found_in_chunks(chunks, made, bits, find, "a bigint").collect())
    seen = Counter(x for a, _ in texts.values() for x in a.view(np.int64).tolist())
    assert {x: n for x, n in seen.items() if n > 1}.items() <= got.items()
    assert sum(seen[x] == 1 for x in got) < 0.03 * len(seen)


def test_windows_with_a_crowded_sketch(spark):
    got = substring.dedup(documents(spark), most_bits=16).collect()
    assert Counter(map(tuple, got)) == brute_windows(DOCS)


# Byte dedup


def brute_bytes(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = 1
        runs = int(((gone[1:] == 0) & (gone[:-1] == 1)).sum())
        out.append((i, len(b), int(gone.sum()), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return Counter(out)


@pytest.mark.parametrize("rows", [DOCS, DOCS + EXTRA, []])
@pytest.mark.parametrize("group", [1024, 2])
def test_bytes(spark, rows, group):
    got = suffix.dedup(documents(spark, rows), group=group).collect()
    assert Counter(map(tuple, got)) == brute_bytes(rows, 200)


@pytest.mark.parametrize("size", [300, 20_000, 8 << 20])
@pytest.mark.parametrize("rows", [DOCS + EXTRA, [], [(None, "x" * 300), (None, None)], [(i, words(7, 60)) for i in (3, 1, 2)] + [(4, words(7, 30) + words(8, 300))]])
def test_bytes_with_a_sketch_that_stays_in_its_shards(spark, rows, size):
    got = suffix.dedup(documents(spark, rows), most_bits=4, chunk_bytes=size, group=2 if size == 300 else 1024).collect()
    assert Counter(map(tuple, got)) == brute_bytes(rows, 200)


def rows_read(spark) -> dict[int, int]:
    """Rows that each stage has read from tables."""
    double = spark.sparkContext._gateway.jvm.double
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(double, 0), None).iterator()
    found = {}
    while stages.hasNext():
        stage = stages.next()
        found[stage.stageId()] = stage.inputRecords()
    return found


def test_texts_are_read_equally_often_at_every_size(spark):
    """Rows read from tables: as many where the bound is ten or a hundred times too small."""
    rows = [(i, words(300 + i, 400)) for i in range(60)] + [(100 + i, words(900, 60) + words(400 + i, 300)) for i in range(20)]
    path = spark.conf.get("spark.sql.warehouse.dir") + "/read_equally_often"
    documents(spark, rows).write.mode("overwrite").parquet(path)
    about = 2 * sum(len(t) for _, t in rows) // 100
    read, jobs = [], []
    for bits in (12, 9, 6):
        assert not sketch.fits(about, bits)
        last = max(rows_read(spark), default=-1)
        suffix.dedup(spark.read.parquet(path), most_bits=bits).collect()
        new = {stage: n for stage, n in rows_read(spark).items() if stage > last}
        read.append(sum(new.values()))
        jobs.append(len(new))
    assert read[0] == read[1] == read[2] > len(rows) and max(jobs) - min(jobs) <= 8


def test_cores_spread_over_all_cells():
    """Cores are the least names of many; their hashes must still fall evenly."""
    texts = [words(i, 2000).encode() for i in range(20)]
    core = np.unique(np.concatenate([suffix.anchors(d, s, 200)[0] for d, s, _, _ in suffix.buffers(texts, 200)]))
    for lane in suffix._lanes(core):
        parts = np.bincount((lane >> np.uint64(60)).astype(int), minlength=16)
        assert parts.min() > 0.7 * len(core) / 16 and parts.max() < 1.3 * len(core) / 16


def test_bytes_of_other_lengths_and_pieces(spark, monkeypatch):
    rows = [(1, "abcabcabcabd" * 30), (2, "xyz" + "abcabc" * 9), (3, words(3, 300)), (4, words(3, 299)[5:])]
    for length in (2, 7, 50):
        assert Counter(map(tuple, suffix.dedup(documents(spark, rows), length=length).collect())) == brute_bytes(rows, length)
    monkeypatch.setattr(suffix, "_BUFFER", 64)
    pieces = list(suffix.buffers([b"a" * 500, None, b"short", b"b" * 90], 50))
    assert sum(len(x[1]) for x in pieces) > 4
    for data, starts, numbers, offsets in pieces:
        core, anchor, first, last, piece = suffix.anchors(data, starts, 50)
        assert (last >= first).all() and (anchor >= last - 50).all() and (last + 50 <= len(data)).all()


def test_bytes_by_doubling_over_all_positions(spark):
    for length, rows in [(200, DOCS), (7, [(1, "abcabcabcabd" * 30), (2, "xyz" + "abcabc" * 9), (2, "xyz" + "abcabc" * 9), (None, "abcdefgh" * 3), (5, None), (6, "")])]:
        assert Counter(map(tuple, doubling.dedup(documents(spark, rows), length=length).collect())) == brute_bytes(rows, length)
    assert not doubling.dedup(documents(spark, [])).collect()


@settings(max_examples=50, deadline=None)
@given(data=st.binary(max_size=80), length=st.integers(1, 20))
def test_names_stand_for_windows(data, length):
    symbols = np.frombuffer(data, np.uint8).astype(np.uint64)
    names = window_names(symbols, length, 0)
    windows = [data[i : i + length] for i in range(len(data) - length + 1)]
    assert len(names) == len(windows)
    assert len(set(names.tolist())) == len(set(windows)) == len(set(zip(names.tolist(), windows)))


def test_small_tools():
    values = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    for width in (1, 2, 3, 5, 7):
        assert sliding_least(values, width).tolist() == [min(values[i : i + width].tolist()) for i in range(len(values) - width + 1)]
    a, b = joined_runs(np.array([5, 0, 2, 9]), np.array([7, 3, 5, 10]))
    assert a.tolist() == [0, 9] and b.tolist() == [7, 10]


def test_sketch_loses_nothing(spark):
    rng = np.random.default_rng(0)
    values = rng.integers(-(2**62), 2**62, 4000)
    twice = values[:500]
    df = spark.createDataFrame([(int(v),) for v in [*values, *twice]], "x bigint").repartition(5)

    def hashes(batch):
        x = batch.column(0).to_numpy().view(np.uint64)
        yield x, x * np.uint64(0x9E3779B97F4A7C15)

    for bits in (16, 24):
        sketch = build(df, hashes, bits)
        lanes = values.view(np.uint64), values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        found = sketch.holds(*lanes)
        assert found[:500].all() and (bits == 16 or found[500:].mean() < 0.01)
    assert isinstance(sketch, Sketch)


# Near-duplicates


def plain_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = sorted(prints)
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    return {p: root(p) for p in known}


@pytest.mark.parametrize("rows", [DOCS, DOCS + EXTRA, []])
def test_near_duplicates(spark, rows):
    groups = brute_groups({plain_fingerprint(t) for _, t in rows})
    least = defaultdict(list)
    for i, t in rows:
        if i is not None:
            least[groups[plain_fingerprint(t)]].append(i)
    want = Counter((i, f"{plain_fingerprint(t):016x}", min(least[groups[plain_fingerprint(t)]], default=None)) for i, t in rows)
    assert Counter(map(tuple, simhash.near_duplicates(documents(spark, rows)).collect())) == want
    kept = simhash.keep_one(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    got = kept.collect()
    assert len(got) == len(set(groups.values()))
    assert {r.doc_id for r in got if r.doc_id is not None} == {min(x) for x in least.values()}


@settings(max_examples=1, deadline=None)
@given(st.none())
def test_links_connect_what_is_close(spark, _):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 5, dtype=np.int64).view(np.uint64)
    prints = {int(c) for c in centres} | {int(c) ^ sum({1 << int(b) for b in rng.integers(0, 64, k)}) for c in centres for k in range(1, 9) for _ in range(25)}
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp bigint")
    want = brute_groups(prints)
    for chunk, blocks in ((1024, 5), (4, 5), (16, 4), (1024, 6)):
        roots = {r.node: r.root for r in components(simhash.links(df, blocks=blocks, chunk=chunk)).collect()}
        got = defaultdict(set)
        for p in prints:
            got[roots.get(simhash._signed(p), simhash._signed(p))].add(p)
        expected = defaultdict(set)
        for p, r in want.items():
            expected[r].add(p)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == 500 and len(got) == 203

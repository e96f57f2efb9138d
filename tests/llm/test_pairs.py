"""Line dedup, near duplicates, repeated strings and windows, sketches: against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sleuthgraph.llm import hashing, line_runs, near_dup, repeats, sketches, substrings, suffix_buckets
from sleuthgraph.llm.bitmaps import Bitmap
from sleuthgraph.llm.components import components

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()
words = lambda t: [w.decode() for w in (t or "").encode().lower().split()]


def test_line_dedup(documents, corpus, nothing):
    key = lambda line: line.strip("\t\n\x0b\x0c\r ").translate(ASCII)
    first = {}
    holders = defaultdict(set)
    for i, t in corpus:
        if i is not None:
            for line in (t or "").split("\n"):
                holders[key(line)].add(i)
    first = {k: min(v) for k, v in holders.items() if len(k) >= 10 and len(v) > 1}
    want = Counter()
    for i, t in corpus:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or first.get(key(x), i) == i]
        want[i, len(lines), len(lines) - len(kept), "\n".join(kept) if t is not None else None] += 1
    out = line_runs.without_repeated_lines(documents)
    assert out.columns == [*documents.columns, "n_lines", "n_dropped"]
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()) == want
    for fan_out, batches in ((2, 7), (3, 1)):
        again = line_runs.without_repeated_lines(documents, batches=batches, fan_out=fan_out)
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in again.collect()) == want
    assert line_runs.without_repeated_lines(nothing).count() == 0


def shingle_set(t, size=5):
    w = words(t)
    return frozenset(tuple(w[k:k + size]) for k in range(max(len(w) - size + 1, 1))) if w else frozenset()


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(documents, corpus, nothing, percent):
    sets = defaultdict(list)
    for i, t in corpus:
        sets[i].append(shingle_set(t))
    parent = {i: i for i in sets if i is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    flat = [(i, s) for i, ss in sets.items() if i is not None for s in ss if s]
    for i, s in flat:
        for j, u in flat:
            if i < j and 100 * len(s & u) >= percent * len(s | u):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = near_dup.near_duplicates(documents, percent=percent).collect()
    assert len(got) == len(corpus)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(shingle_set(t))) for i, t in corpus)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else find(r.doc_id)), r
        assert r.kept == (r.doc_id is None or r.component_id == r.doc_id)
    assert near_dup.near_duplicates(nothing).count() == 0


def test_registers_estimate_similarity():
    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (4000, 500, 500))
    x, y = (near_dup.registers(np.concatenate([common, s])) for s in (a, b))
    assert abs(near_dup.corrected((x == y).sum(), 256, 2**-10) - 0.8) < 0.1
    assert len(near_dup.band_keys(near_dup.registers(np.zeros(0, dtype=np.uint64)))) == 0


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 80)] + [(179, 500), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in [*range(100, 180), 500]}


def test_bitmap_holds_all(spark):
    rng = np.random.default_rng(1)
    inside, outside = rng.integers(-2**63, 2**63 - 1, 5000), rng.integers(-2**63, 2**63 - 1, 5000)
    m = Bitmap(spark.createDataFrame([(int(v),) for v in inside], "h long"), "h")
    assert m.has(inside).all() and m.has(outside).mean() < 0.15


def test_bytes_removed(documents, corpus, nothing):
    order = sorted({(i if i is not None else -1, t or "") for i, t in corpus})
    seen, want = {}, {}
    for place, (i, t) in enumerate(order):
        b = t.encode()
        for k in range(len(b) - 99):
            seen.setdefault(b[k:k + 100], (i, t, k))
    for i, t in corpus:
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for k in range(len(b) - 99):
            f = seen[b[k:k + 100]]
            # documents with one id are ordered by a hash; the fixture has no strings shared only by such
            if f != (i if i is not None else -1, t or "", k):
                gone[k:k + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.setdefault((i, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha(kept)), 0)
        want[i, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha(kept)] += 1
    got = suffix_buckets.without_repeats(documents).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(want)
    assert all(sha(bytes(r.kept)) == r.kept_sha256 for r in got)
    assert suffix_buckets.without_repeats(nothing).count() == 0


@pytest.mark.parametrize("window,gram", [(35, 8), (12, 4)])
def test_words_removed(documents, corpus, nothing, window, gram):
    split = [(i, (t or "").encode().split()) for i, t in corpus]
    count = Counter(tuple(w[k:k + window]) for _, w in split for k in range(len(w) - window + 1))
    want = Counter()
    for i, w in split:
        gone = bytearray(len(w))
        for k in range(len(w) - window + 1):
            if count[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = b"\1" * window
        want[i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))] += 1
    got = substrings.without_repeats(documents, window, gram).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert substrings.without_repeats(nothing).count() == 0


@pytest.mark.parametrize("units,gram,size", [("words", 8, 16), ("words", 8, 9), ("words", 4, 6), ("words", 4, 8), ("words", 6, 17), ("bytes", 32, 50),
                                             ("bytes", 32, 94), ("bytes", 8, 8)])
def test_repeats_of_any_window(spark, units, gram, size):
    rng = np.random.default_rng(size)
    long_ = [f"w{v}" for v in rng.integers(0, 500, 60)]
    # pieces of one text of about a window, each between other words
    texts = [" ".join([f"x{v}" for v in rng.integers(0, 500, 5)] + long_[k:k + int(rng.integers(4, 24))] + [f"y{v}" for v in rng.integers(0, 500, 5)])
             for k in range(40) for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    split = [t.encode() if units == "bytes" else t.split() for t in texts]
    count = Counter(bytes(w[k:k + size]) if units == "bytes" else tuple(w[k:k + size]) for w in split for k in range(len(w) - size + 1))
    seen, want = set(), {}
    for i, w in enumerate(split):
        gone = bytearray(len(w))
        for k in range(len(w) - size + 1):
            key = bytes(w[k:k + size]) if units == "bytes" else tuple(w[k:k + size])
            if key in seen if units == "bytes" else count[key] > 1:
                gone[k:k + size] = b"\1" * size
            seen.add(key)
        want[i] = sum(gone), sha(bytes(x for x, g in zip(w, gone) if not g) if units == "bytes" else " ".join(x for x, g in zip(w, gone) if not g))
    module = suffix_buckets if units == "bytes" else substrings
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in module.without_repeats(docs, size, gram).collect()}
    assert got == want and sum(n for n, _ in want.values())


def test_windows_hold_a_gram():
    with pytest.raises(ValueError):
        repeats.Shape("words", 8, 7)
    with pytest.raises(ValueError):
        substrings.levels(7, 8)


def test_levels_double_at_most():
    assert substrings.levels(35, 8) == [9, 18, 35] and substrings.levels(16, 8) == [8, 16] and substrings.levels(9, 8) == [9]
    for window in range(1, 120):
        steps = substrings.levels(window, 1)
        assert steps[0] == 1 and steps[-1] == window and all(a < b <= 2 * a for a, b in zip(steps, steps[1:], strict=False))


def test_each_window_starts_in_one_slice(monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 400)
    shape = pa.record_batch({"doc_id": pa.array(range(3)), "row_hash": pa.array([0] * 3, pa.int32()),
                             "text": pa.array([" ".join(f"w{k}" for k in range(900)), None, "a b"])})
    made = list(substrings._pieces(shape, 35))
    assert len(made) > 3
    starts = Counter()
    for piece in made:
        o = substrings._opened(piece, 35)
        own = np.searchsorted(o["begin"], o["at"], side="right") - 1
        starts.update((piece["doc_id"][d], at - o["begin"][d] + piece["skipped"]) for d, at in zip(own, o["at"], strict=True))
    assert starts == Counter((0, k) for k in range(900 - 34))


def test_no_window_reaches_over_documents():
    at, ids = np.array([0, 1, 4, 5], dtype=np.int32), np.arange(4, dtype=np.uint64)
    assert substrings._extended(at, ids, 3)[0].tolist() == [1]
    empty = substrings._extended(at[:0], ids[:0], 3)
    assert not len(empty[0]) and not len(empty[1])
    piece = {"chunk": 1, "doc_id": [7, 8], "row_hash": [0, 0], "size": [5, 5], "skipped": 0, "body": b"a b c a b c", "n": 11}
    assert substrings._opened(piece, 3)["at"].tolist() == [0, 4]
    assert substrings._spans(piece | {"begin": [0, 4]}, np.array([0, 4], dtype=np.int32)) == [
        {"doc_id": 7, "row_hash": 0, "start": 0, "n_windows": 1}, {"doc_id": 8, "row_hash": 0, "start": 0, "n_windows": 1}]


def test_long_texts_hash_in_parts(monkeypatch):
    text = ("word " * 50 + "x" * 300 + " end " * 40).encode()
    whole = hashing.words(np.frombuffer(text, dtype=np.uint8))
    monkeypatch.setattr(hashing, "PART", 64)
    parts = hashing.words(np.frombuffer(text, dtype=np.uint8))
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_least_takes_the_leftmost():
    v = np.array([5, 3, 3, 9, 1, 1, 7, 2], dtype=np.uint64)
    assert hashing.least(v << np.uint64(40), 3).tolist() == [1, 1, 4, 4, 4, 5]


def test_identifiers_follow_content():
    v = np.random.default_rng(2).integers(0, 3, 400).astype(np.uint8)
    for gram, size in ((4, 4), (4, 8), (4, 13), (8, 35), (32, 100)):
        grams = hashing.windows(v, gram)
        at = np.arange(len(v) - size + 1)
        ids = hashing.identifiers(grams, gram, size, at)
        seen = {}
        for k in at:
            assert seen.setdefault(v[k:k + size].tobytes(), ids[k]) == ids[k]
        assert len(set(seen.values())) == len(seen)


def test_sketches(documents, corpus, nothing):
    rows = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    pieces = lambda t: set(Counter(re.findall(rf"[^\n]{{1,{sketches.PIECE}}}", t)).items())
    want, texts = defaultdict(list), {}
    for k, (i, t) in enumerate(rows):
        t, n = t or "", (rows[k - 1][1] or "")
        half = len(t) // 2
        e = t[:len(t) - half] + n[:half]
        a, b, c = pieces(t), pieces(e), pieces(n)
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        want[i].append((len(t), sha(e), round(like(a, b), 9), round(like(a, c), 9)))
    got, prints = defaultdict(list), defaultdict(set)
    for r in sketches.fingerprints(documents).collect():
        got[r.doc_id].append((r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)))
        prints[r.doc_id].add(r.fingerprint)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert len({f for k in range(200, 205) for f in prints[k]}) == 1 and prints[100] != prints[110]
    assert sketches.fingerprints(nothing).count() == 0


def test_sketch_retries_with_more_cells(documents, monkeypatch):
    plain = {(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.fingerprint) for r in sketches.fingerprints(documents).collect()}
    monkeypatch.setattr(sketches, "ROUNDS", 1)
    monkeypatch.setattr(sketches.compare, "__defaults__", (1,))
    again = {(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.fingerprint) for r in sketches.fingerprints(documents).collect()}
    assert again == plain


@pytest.mark.parametrize("units,gram,size", [("bytes", 32, 100), ("words", 8, 35)])
def test_slices_of_long_texts_have_the_same_windows(monkeypatch, units, gram, size):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{v}" for v in rng.integers(0, 50, n)) for n in (900, 3, 0, 60, 400)] + [None]
    batch = pa.record_batch({"doc_id": pa.array(range(6)), "row_hash": pa.array([0] * 6, pa.int32()), "text": pa.array(texts)})
    shape = repeats.Shape(units, gram, size)

    def windows_of():
        out = {}
        for r in filter(None, repeats._chunks(batch, shape)):
            for k in range(len(r.anchor)):
                for w in range(r.first[k], r.end[k]):
                    ident = repeats.identifiers(r.grams, gram, size, np.array([w]))[0]
                    assert out.setdefault((r.doc[k], w - r.begin[k]), (r.anchor[k], ident)) == (r.anchor[k], ident)
        return out

    whole = windows_of()
    units_of = [len((t or "").encode()) if units == "bytes" else len((t or "").split()) for t in texts]
    assert set(whole) == {(d, k) for d, n in enumerate(units_of) for k in range(n - size + 1)}
    monkeypatch.setattr(repeats, "SLICE", 200)
    assert windows_of() == whole

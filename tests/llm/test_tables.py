"""Language identification, whitening and the divergence audit against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sleuthgraph.llm import divergence, feast, languages, whitening

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WIDE = "doc_id long, text string, lang string, source string, n long, word string, slice string, zero string, value string"


# --- divergence ---------------------------------------------------------------------------

def _audit(rows, min_docs=3, top=200):
    docs = [(t or "", lang or "", source or "") for t, lang, source in rows]
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        terms = TERM.findall(text.translate(UPPER))
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        v, share = len(kept), {}
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})
        for s, c in [*((s, counts[lang, s]) for s in sources), (None, whole)]:
            n = sum(c[t] for t in kept)
            share[s] = {t: 1 + 10 ** 9 * (c[t] + 1) // (n + v) for t in kept}
        far = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            parts = {"pair": {o: sum(far(share[s][t], share[o][t]) for t in kept) for o in sources if o != s},
                     "term": {t: far(share[s][t], share[None][t]) for t in kept if counts[lang, s][t] and share[s][t] > share[None][t]}}
            for part, values in parts.items():
                ranked = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1) if part == "pair" or k <= top}
    return out


def _rows(seed, n, sources):
    rng = random.Random(seed)
    words = ["The", "the", "of", "Änder", "änder", "x", "zażółć", "漢字", "🙂a"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(150)]
    rows = [(" ".join(rng.choice(words[:rng.choice([9, 40, 159])]) + rng.choice(["", ".", "7", "\n"]) for _ in range(rng.randrange(1, 60))),
             rng.choice(["en", "en", "de"]), f"s{rng.randrange(sources)}") for _ in range(n)]
    rows += [(None, "en", "silent"), ("", None, None), ("123 456", "xx", "digits"), ("123", "xx", "more"), ("alone", "yy", "sole"), (rows[0][0], None, "s1")]
    return rows + rows[:5] + [("again " * 5000, "de", "s0")]


@pytest.mark.parametrize("per_slice", [64, 3])
def test_audit(spark, monkeypatch, per_slice):
    monkeypatch.setattr(divergence, "SLICE", per_slice)
    rows = _rows(per_slice, 120, 9)
    docs = spark.createDataFrame([(k, *r, 1, "a", "b", "c", "d") for k, r in enumerate(rows)], WIDE).repartition(3)
    got = divergence.audit(docs, top=20).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == _audit(rows, top=20)


def test_audit_parts(spark, nothing, monkeypatch):
    assert divergence.audit(nothing).count() == 0
    # texts in pieces and tasks that hand over early count the same
    rows = _rows(1, 30, 3)
    want = {(r["lang"], r["source"], r["term"], r["n"], r["docs"]) for r in divergence.term_counts(
        spark.createDataFrame(rows, "text string, lang string, source string")).collect()}
    monkeypatch.setattr(divergence, "PIECE", 16)
    monkeypatch.setattr(divergence, "HELD", 10)
    batches = divergence._counted([__import__("pyarrow").RecordBatch.from_pydict({
        "lang": [r[1] or "" for r in rows], "source": [r[2] or "" for r in rows], "text": [(r[0] or "").encode() for r in rows]})])
    summed = defaultdict(lambda: [0, 0])
    for b in batches:
        for r in b.to_pylist():
            key = summed[r["lang"], r["source"], r["term"].decode()]
            key[0] += r["n"]
            key[1] += r["docs"]
    assert {(*k, *v) for k, v in summed.items()} == want


# --- whitening ----------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_feast(n):
    rng = np.random.default_rng(n)
    for shape in ("full", "low rank", "equal", "zero"):
        x = rng.standard_normal((3 * n + 3, n)) * np.linspace(1, 4, n)
        x = x[:2].repeat(4, axis=0) if shape == "low rank" else x
        a = np.eye(n) if shape == "equal" else np.zeros((n, n)) if shape == "zero" else (x - x.mean(0)).T @ (x - x.mean(0))
        for k in (1, 4, n):
            values, vectors = feast.largest(a, k)
            want = np.linalg.eigvalsh(a)[::-1]
            rank = int((want > 1e-9 * max(want.max(), 1e-9)).sum())
            assert len(values) == min(k, rank)
            assert np.allclose(values, want[:len(values)], rtol=1e-12)
            assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
            assert np.allclose(a @ vectors, vectors * values, atol=1e-11 * max(want.max(), 1))
            form = feast.tridiagonal(a)
            for shift in (want.min() - 1, want.max() * 0.37 + 1e-3, want.max() + 1):
                assert feast.above(form, shift) == (want > shift).sum()


def test_feast_far_first_value():
    # one value far above a dense rest, as copies of one vector make it
    values = np.append(np.linspace(1.0, 1.7, 63), 9.0)
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((64, 64)))
    a = (q * values) @ q.T
    got, vectors = feast.largest(a, 4)
    assert np.allclose(got, values[::-1][:4], rtol=1e-12) and np.allclose(a @ vectors, vectors * got, atol=1e-12)


def test_whitened(spark):
    rng = np.random.default_rng(2)
    plain = (rng.standard_normal((300, 6)) @ np.diag([3, 2, 1.5, 1, .5, .1])).astype(np.float32)
    rows = [(k, v.tolist(), k % 3, "x") for k, v in enumerate(plain)]
    rows += [(400 + k, plain[0].tolist(), 1, None) for k in range(50)] + [(5, plain[7].tolist(), None, "y"), (None, plain[8].tolist(), 1, "z")]
    bad = [(900, None, 1, "x"), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, "x"), (902, [float("nan")] * 6, 1, "x"), (903, [float("-inf")] + [0.0] * 5, 1, "x"),
           (904, [], 1, "x"), (905, [1.0, 2.0], 1, "x")]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, n int, x string").repartition(3)
    got = whitening.whitened(table).toPandas()
    x = np.floor(256 * np.array([r[1] for r in rows], dtype=np.float32).astype(float)).astype(int)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    c = fit - total / n
    v = c.T @ c / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    assert len(got) == 4 * len(rows) and set(got["n"]) == {n}
    assert np.allclose(sorted(got["explained"].unique())[::-1], values / np.trace(v), rtol=1e-9) and got["identity_error"].max() < 1e-9
    white, off = (x - total / n) @ vectors / np.sqrt(values), ((n * x - total) ** 2).sum(1)
    want = Counter((r[0], k + 1, int(off[i]), round(abs(white[i, k]), 6)) for i, r in enumerate(rows) for k in range(4))
    assert Counter((None if i != i else int(i), k, d, round(abs(w), 6)) for i, k, d, w in
                   got[["vec_id", "component", "deviation", "whitened"]].itertuples(index=False)) == want
    signs = got[got.vec_id < 300].sort_values(["vec_id", "component"]).drop_duplicates(["vec_id", "component"])["whitened"].to_numpy().reshape(-1, 4)
    assert (np.abs(signs * np.sign(signs[0] * white[0]) - white[:300]) < 1e-8).all()


def test_whitened_edges(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1)], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None, 1), (2, [], 1)], schema)).count() == 0
    two = whitening.whitened(spark.createDataFrame([(1, [0.0, -0.0], 1), (2, [1.0, 0.0], 1)], schema)).collect()
    assert {(r["vec_id"], r["component"], r["deviation"], round(abs(r["whitened"]), 9), r["explained"]) for r in two} == {
        (1, 1, 65536, 1.0, 1.0), (2, 1, 65536, 1.0, 1.0)}
    vast = whitening.whitened(spark.createDataFrame([(1, [1e300, 0.0], 1), (2, [-1e300, 1.0], 1), (3, [0.0, 0.0], 1)], schema)).collect()
    assert len(vast) in (3, 6) and any(r["deviation"] is None for r in vast)


# --- languages ------------------------------------------------------------------------------

SYLLABLES = {"aa": "ka to mi ne ru so".split(), "bb": "sch ung ein ver ach keit".split(), "cc": "ção nho lha mos ndo ões".split(),
             "дд": "при ост нов ств раз ени".split()}


def _texts(seed, n, names=tuple(SYLLABLES)):
    rng = random.Random(seed)
    return [(k, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(3, 200))), lang)
            for k in range(n) for lang in [rng.choice(names)]]


@pytest.mark.parametrize("n", [2, 3, 4, 7, 8, 30])
def test_codewords(n):
    code = languages.codewords(n)
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) >= max(1, code.shape[1] // 4) and (abs(code.sum(axis=0)) < n).all()


def test_decoding_corrects_one_bit():
    code = languages.codewords(4)
    model = languages.Model(tuple("abcd"), code, np.zeros((1, 7)), np.zeros(7), np.full((4, 7), 1 / 7))
    for k in range(4):
        for wrong in range(7):
            margins = 3.0 * code[k]
            margins[wrong] *= -1
            best, score, unsure = model.decode(margins[None])
            assert best[0] == k and 0.5 < score[0] <= 1 and not unsure[0]
    _, score, unsure = model.decode(np.zeros((1, 7)))
    assert unsure[0] and score[0] == pytest.approx(0.25)


def test_identified(spark):
    rows = [(i, t, lang, "s", 1.0, "p") for i, t, lang in _texts(4, 400)]
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !", "aa"), (1003, "ka to mi", None), (1004, SYLLABLES["bb"][0] * 700000, None),
           (None, "ver ein ung", "aa"), (1005, "ção nho", None), (1005, "ção nho", None)]
    schema = "doc_id long, text string, lang string, source string, score double, lang_pred string"
    docs = spark.createDataFrame(rows + [(*r, "s", 1.0, "p") for r in odd], schema).repartition(3)
    got = languages.identified(docs).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in by.items() if i is not None) and by[None]["held_out"]
    unseen = [r for r in rows if by[r[0]]["held_out"]]
    assert np.mean([by[r[0]]["lang_pred"] == r[2] for r in unseen]) > 0.98
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (1000, 1001, 1002))
    assert (by[1003]["lang_pred"], by[1004]["lang_pred"], by[None]["lang_pred"], by[1005]["lang_pred"]) == ("aa", "bb", "bb", "cc")
    # labels of held-out rows and the languages of others to be predicted play no part
    blind = [(i, t, lang if zlib.crc32(str(i).encode()) % 3 != 1 else "zz", s, 2.0, "q") for i, t, lang, s, _, _ in rows]
    again = {r["doc_id"]: r for r in languages.identified(spark.createDataFrame(blind, schema)).collect()}
    want = languages.identified(spark.createDataFrame(rows, schema)).collect()
    assert all((again[r["doc_id"]]["lang_pred"], again[r["doc_id"]]["score"]) == (r["lang_pred"], r["score"]) for r in want)


def test_identified_few(spark, nothing):
    assert languages.identified(nothing).count() == 0
    schema = "doc_id long, text string, lang string"
    one = languages.identified(spark.createDataFrame([(i, t, "only") for i, t, _ in _texts(1, 6)] + [(50, "?", "only")], schema)).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("only", 1.0), ("und", 0.0)}
    none = languages.identified(spark.createDataFrame([(1, "text", None), (2, None, "aa")], schema)).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}

"""Packing, classifiers, extraction, decontamination and the pipeline."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sleuthgraph.llm import catalog, decontaminate, html_text, line_runs, packing, quality, toxicity

TOKENIZER = catalog.tokenizer_path()


@pytest.mark.parametrize("capacity", [7, 10, 64])
def test_plan_places_every_item(capacity):
    rng = np.random.default_rng(capacity)
    for _ in range(150):
        lengths = rng.integers(1, capacity + 1, rng.integers(0, 80))
        counts = np.bincount(lengths, minlength=capacity + 1)
        bins, got = packing.plan(counts, capacity), np.zeros(capacity + 1, dtype=int)
        for b in bins:
            assert b.count > 0 and sum(s * e for s, e in b.items) <= capacity
            for s, e in b.items:
                got[s] += e * b.count
        assert (got == counts).all()
        # best-fit decreasing needs at most 11/9 of the optimum and 6/9 more
        assert sum(b.count for b in bins) <= 11 / 9 * max(-(-lengths.sum() // capacity), (lengths > capacity / 2).sum()) * 1.25 + 1


def _optimum(items, capacity):
    best = [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for j in sorted({r: j for j, r in enumerate(rooms) if r >= items[k]}.values()):
            go(k + 1, rooms[:j] + [rooms[j] - items[k]] + rooms[j + 1:])
        go(k + 1, rooms + [capacity - items[k]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = np.random.default_rng(3)
    for _ in range(120):
        items = sorted(rng.integers(1, 21, 9).tolist(), reverse=True)
        counts = np.bincount(items, minlength=21)
        fixed = sum(b.count for b in packing.dominated(counts, 20))
        rest = [s for s in range(20, 0, -1) for _ in range(counts[s])]
        assert fixed + _optimum(rest, 20) == _optimum(items, 20)


def test_packed(documents, corpus, nothing):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for i, text in corpus:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 512):
            part = ids[k:k + 512]
            want[i, k // 512, k, len(part), zlib.crc32(np.asarray(part, dtype="<u4").tobytes())] += 1
    rows = packing.packed(documents, TOKENIZER, 512).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert len(sequences) <= -(-sum(r.length for r in rows) // 512) + 2
    assert packing.packed(nothing, TOKENIZER).count() == 0


def test_chunk_ids_equal_whole_text_ids():
    e = packing.ChunkEncoder(TOKENIZER)
    for text in ("a<|endoftext|>b c", "  x\t\ty z\n\n", "é ́x", "don't 's It'S I'LL", "", "\x1c a\x85b \xa0", "x" * 60 + " y " + "Z9z" * 30,
                 "<|startoftext|> <|endoftext|>", "ab12cd 3.14!?; <|x|> \u200b"):
        want = e.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(e.encode([text])[0], dtype="<u4").tolist() == want, text


def _labelled(spark, corpus, column, good):
    rng = random.Random(1)
    rows = [(k, good(rng, k)) for k in range(300)]
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame([(k, int(k % 3 != 0), int(k % 3 == 0)) for k in range(280)] + [(9999, 1, 0), (None, 0, 1), (5, None, None)],
                                  "doc_id long, quality int, toxic int"))


def test_quality_rules(spark, corpus, documents, nothing):
    def text(rng, k):
        w = [f"{rng.choice('bcdfg')}a{rng.randrange(99)}" for _ in range(rng.randrange(30, 90))]
        return " ".join(w).upper() + " %%% ###" * 9 if k % 3 == 0 else " ".join(w) + "."

    docs, labels = _labelled(spark, corpus, "quality", text)
    rows = quality.scored(docs, labels).collect()
    unseen = [r for r in rows if r.held_out]
    assert len(rows) == 300 and len(unseen) > 20 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.doc_id % 3 != 0) for r in unseen)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted}
    out = quality.scored(documents, labels).collect()
    assert len(out) == len(corpus) and all(r.score is not None for r in out)
    assert quality.scored(nothing, labels).count() == 0 and quality.accepted(documents, labels.limit(0)).count() == len(corpus)


def test_toxicity(spark, corpus, documents, nothing):
    insults = ["blorgface", "snivelrat", "grubtoad"]

    def text(rng, k):
        w = [f"{rng.choice('bcdfg')}a{rng.choice('lmnr')}e{rng.choice('stv')}" for _ in range(rng.randrange(30, 90))]
        if k % 3 == 0:
            w[rng.randrange(len(w))] = rng.choice(insults)
        return " ".join(w)

    docs, labels = _labelled(spark, corpus, "toxic", text)
    rows = toxicity.scored(docs, labels).collect()
    unseen = [r for r in rows if r.held_out]
    assert len(unseen) > 50 and all(r.predicted == int(r.doc_id % 3 == 0) for r in unseen)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    model = toxicity.fit(docs, labels)
    mild = toxicity.Scorer(model).top([toxicity.segments("bales fares caret")])[0, 0]
    for way in ("blorgface", "Blorg.face!", "blo*rgface", "b l o r g f a c e", "grub-toad"):
        assert toxicity.Scorer(model).top([toxicity.segments(f"bales {way} fares")])[0, 0] > mild + 0.5, way
    clean = [text(random.Random(k), 1) for k in range(40)]
    scorer = toxicity.Scorer(model)

    def flagged(texts):
        top = scorer.top([toxicity.segments(t) for t in texts])
        return (model.chance(top[:, 0], top[:, 1], top[:, 2]) >= toxicity.THRESHOLD).mean()

    assert flagged(clean) == 0
    for way in (str, ".".join, "-".join, " ".join, "_".join, lambda w: w[:3] + "*" + w[3:], lambda w: "".join(c + c for c in w), str.upper):
        for insult in insults:
            assert flagged([f"{t} {way(insult)}" for t in clean]) >= 0.9, way(insult)
    out = toxicity.scored(documents, labels).collect()
    assert len(out) == len(corpus) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.scored(nothing, labels).count() == 0 and toxicity.scored(documents, labels.limit(0)).count() == len(corpus)


@pytest.mark.parametrize("word", ["abcdefgh", "blorgface", "ab", "übermut"])
def test_subsequences_against_enumeration(word):
    """Each choice of four places whose span is at most the window, worth the decay to the power of its span."""
    marked = f"\x02{word}\x03"
    worth = sorted(toxicity.DECAY ** (c[-1] - c[0] + 1) for c in itertools.combinations(range(len(marked)), toxicity.ORDER)
                   if c[-1] - c[0] < toxicity.WINDOW)
    ids, weights = toxicity.subsequences([word])
    mine = sorted(w for w in weights[0] if w > 0)
    norm = sum(w * w for w in worth) ** 0.5
    assert len(mine) == len(worth) and all(abs(a - b / norm) < 1e-5 for a, b in zip(mine, worth, strict=True))
    again, same = toxicity.subsequences([word])
    assert (again == ids).all() and (same == weights).all()


def test_forms_of_words():
    assert toxicity.forms("...word!") == ("word",) and toxicity.forms("wo.rd") == ("wo.rd", "word")
    assert toxicity.forms("wwoorrdd") == ("wwoorrdd", "word") and toxicity.forms("book") == ("book",)
    assert toxicity.forms("") == ("",) and toxicity.forms("--") == ("",)
    assert toxicity.segments(None) == toxicity.segments("  ") == set() and "word" in toxicity.segments("a w o r d")


PAGES = [
    ("<html><body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>Hello <b>bold</b> &amp; more&nbsp; text\n here.<p>Next"
     "</article><aside><p>Other</p></aside><footer>&copy; me</footer></body></html>", "Title\nHello bold & more text here.\nNext"),
    ("<div id='menu'><a href=x>a</a></div><div class='story'><h2>Head</h2><p>Long enough text of the story, told at some length.</p>"
     "<ul><li>one<li>two</ul></div><div class='comments'><p>I liked it very much, thanks a lot for it all.</p></div>"
     "<div class='cookie-notice'>We use cookies</div><form><p>Your name here</p></form>",
     "Head\nLong enough text of the story, told at some length.\none\ntwo"),
    ("<p>cut off in a <a href='x", "cut off in a"), ("plain", "plain"), ("", ""), (None, ""), ("<script>var a='<p>x</p>'</script>", ""),
    ("<p>a<!-- b --> c</p><!-- open <p>d", "a c"), ("<p>1 &lt; 2 &#228;&#x1F642; &nosuch;</p>", "1 < 2 ä🙂 &nosuch;"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
]


def test_main_text(spark):
    for source, want in PAGES:
        assert html_text.main_text(source) == want
    pages = spark.createDataFrame([(k, "u", h, "x") for k, (h, _) in enumerate(PAGES)] + [(None, None, None, None), (0, "u", PAGES[0][0], "x")],
                                  "page_id long, url string, html string, text string")
    rows = html_text.extracted(pages).collect()
    assert Counter((r.page_id, r.text, r.n_chars) for r in rows) == Counter(
        [(k, t, len(t)) for k, (_, t) in enumerate(PAGES)] + [(None, "", 0), (0, PAGES[0][1], len(PAGES[0][1]))])
    assert html_text.extracted(pages.limit(0)).count() == 0


STORY = "<h1>Head</h1><p>Long enough text of the story, told at some length.</p><p>It goes on, and on, to its very end.</p>"
STORY_TEXT = "Head\nLong enough text of the story, told at some length.\nIt goes on, and on, to its very end."
AROUND = "<nav><a href=x>Home</a></nav>%s<footer>&copy; me</footer>"
SIDE = "<div class='sidebar'><p>Read this too, it is short.</p></div>"
THREAD = "<div id='comments'>" + "<p>I liked it very much, thanks a lot for it all, and so on and so on.</p>" * 3 + "</div>"


@pytest.mark.parametrize("wrapped", [
    *[f"<div class='{c}'>{STORY}</div>" for c in ("layout has-sidebar", "content no-sidebar", "entry-content with-header", "elementor-widget",
                                                  "no_left_sidebar", "page header-fixed", "single comments-open", "widget sidebar social")],
    f"<div class='layout has-sidebar'>{STORY}{SIDE}</div>", f"<div class='layout sidebar'><div class='page-widget'>{STORY}</div>{SIDE}</div>",
    f"<form action=x><div>{STORY}</div><input name=y><label>Your name</label></form>",
    f"<form id=aspnet><div class='page-header-wide'>{STORY}</div>{SIDE}</form>",
    f"<div class='share-layout'><article>{STORY}</article>{THREAD}</div>", f"<div class='banner-page'><main>{STORY}</main></div>{THREAD}",
    f"<div class=story>{STORY}</div>{THREAD}", f"<article>{STORY}</article><div class='cookie-notice'>{'<p>We use cookies here.</p>' * 9}</div>",
    f"<div>{STORY}</div><div class=related><article class=card><p>Short.</p></article></div>"])
def test_main_text_of_hinted_wrappers(wrapped):
    for page in ("%s", "<html><body>%s</body></html>", AROUND, f"<html><body><div id=all>{AROUND}</div></body></html>"):
        assert html_text.main_text(page.replace("%s", wrapped)) == STORY_TEXT


def test_hint_on_every_block():
    page = "<div>" + "".join(f"<div class='elementor-widget'><div class='elementor-widget-box'>{p}</div></div>" for p in (
        "<p>Long enough text of the story, told at some length.</p>", "<p>It goes on, and on, to its end.</p>", "<p>And a third part.</p>")) + "</div>"
    assert html_text.main_text(page) == html_text.main_text(page.replace("widget", "part")) != ""


def test_hints_of_deep_pages():
    assert html_text.main_text("<div class=sidebar><div class=widget>" * 1500 + "deep" + "</div>" * 3000) == "deep"


def test_leaks(spark, documents, corpus, nothing):
    rng = random.Random(9)
    items = [" ".join(f"q{rng.randrange(500)}" for _ in range(n)) for n in (60, 40, 25, 12, 3)]
    broken = items[0].split()
    broken[20] = "zzz"
    texts = [corpus[0][1] + " " + items[0].upper() + "\n" + corpus[1][1], "a b " + " ".join(broken) + " c", items[1], items[2] * 1 + " " + items[2],
             " ".join(items[1].split()[:18]), corpus[2][1], "so " + items[3], "it says " + items[4] + " indeed", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    want = set()
    for d, t in enumerate(texts):
        w = (t or "").lower().split()
        for k, item in enumerate(items):
            n = len(item.split())
            size = min(5, n)
            grams = lambda x: Counter(tuple(x[j:j + size]) for j in range(len(x) - size + 1))  # noqa: E731, B023
            mine = grams(item.split())
            for j in range(max(len(w) - n, 0) + 1 if w else 0):
                g = grams(w[j:j + n])
                if g and sum((g & mine).values()) >= 0.8 * sum((g | mine).values()):
                    want.add((d, k))
    rows = decontaminate.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and {(0, 0), (1, 0), (2, 1), (3, 2), (6, 3), (7, 4)} == want
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {4, 5, 8, 9}
    assert decontaminate.leaks(documents, bench).count() == 0
    assert decontaminate.leaks(nothing, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames, columns = [docs], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frames[-1], sf)
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        frames.append(spark.read.parquet(path))
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert frames[-1].columns == columns
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and ids[4] == ids[5] and ids[5]
    rejected = {r.doc_id for r in quality.scored(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 0").collect()}
    assert ids[1] == ids[0] - rejected
    bench = [t.item_text for t in spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("lower(text) item_text").collect()]
    for r in frames[4].collect():
        assert not any(" ".join(b.split()) in " ".join(r.text.lower().split()) for b in bench)
        assert r.n_chars == len(r.text)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == ids[5]


def test_registered_queries_match_their_sql(spark):
    from checks import compare
    sf = "/root/testdata/sf0.001"
    for name, sql in catalog.oracle_sql().items():
        assert compare.rows(catalog.queries()[name](spark, sf).toPandas()) == compare.rows(compare.duck(sf).execute(sql).df())
    assert len([n for n in catalog.queries() if n.startswith("op")]) == 13 and "pipeline" in catalog.queries()


def test_pipeline_rows(spark, tmp_path):
    """The rows of run() against brute force over the stages behind the classifier."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from tests.llm.test_pairs import ASCII, shingle_set, words
    given, sf = "/root/testdata/sf0.001", str(tmp_path)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{given}/{name}.parquet").write.parquet(f"{sf}/{name}.parquet")
    # near copies of long lines: one word of every 60 is another
    every = spark.read.parquet(f"{given}/documents.parquet")
    near = [(r.doc_id + 10000 * c, " ".join("changed" if k % 60 == 20 + c else w for k, w in enumerate(r.text.split(" "))))
            for r in every.where("text not like '%\\n%' and n_chars > 600").orderBy("doc_id").limit(12).collect() for c in (1, 2)]
    near = spark.createDataFrame(near, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(length(text) as long) n_chars")
    every.unionByName(near.select([near[f.name].cast(f.dataType) for f in every.schema])).write.parquet(f"{sf}/documents.parquet")
    docs = {r.doc_id: r.text or "" for r in corpus_pipeline.quality_classifier(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    # lines that a smaller id also holds
    key = lambda line: line.strip("\t\n\x0b\x0c\r ").translate(ASCII)
    first, lined = {}, {}
    for i in sorted(docs):
        for line in docs[i].split("\n"):
            first.setdefault(key(line), i)
    for i, text in docs.items():
        kept = [x for x in text.split("\n") if len(key(x)) < 10 or first[key(x)] == i]
        if "\n".join(kept) == text or key("\n".join(kept)):
            lined[i] = "\n".join(kept)
    # the smallest id of each group of near duplicates
    sets, group = {i: shingle_set(t) for i, t in lined.items()}, {i: i for i in lined}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    single = {i: t for i, t in lined.items() if group[i] == i}
    # windows of an item's length whose weighted shingles are those of the item
    items, clean = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()], {}
    for i, text in single.items():
        w, leaks = words(text), False
        for item in filter(None, items):
            n, size = len(item), min(5, len(item))
            grams = lambda x: Counter(tuple(x[k:k + size]) for k in range(len(x) - size + 1))  # noqa: E731, B023
            mine, here = grams(item), {tuple(w[k:k + size]) for k in range(len(w) - size + 1)}
            if sum(c for g, c in mine.items() if g in here) >= 0.8 * sum(mine.values()):
                near = (grams(w[k:k + n]) for k in range(max(len(w) - n, 0) + 1))
                leaks |= any(sum((g & mine).values()) >= 0.8 * sum((g | mine).values()) for g in near)
        if not leaks:
            clean[i] = text
    assert lined != docs and len(lined) > len(single) > len(clean) > 0
    encoder, want = Tokenizer.from_file(TOKENIZER), Counter()
    for i, text in clean.items():
        ids = encoder.encode(text, add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k:k + 4096]
            want[i, k // 4096, k, len(part), zlib.crc32(np.asarray(part, dtype="<u4").tobytes())] += 1
    rows = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(p)[k][0] == sum(n for _, n in sorted(p)[:k]) for p in places.values() for k in range(len(p)))
    assert all(sum(n for _, n in p) <= 4096 for p in places.values())


PARAGRAPHS = "".join(f"<p>Paragraph {k} of the story says rather a lot about what went on that day.</p>" for k in range(6))
PARAGRAPH_TEXT = "\n".join(f"Paragraph {k} of the story says rather a lot about what went on that day." for k in range(6))


@pytest.mark.parametrize("shell", ["<article>%s</article>", "<main>%s</main>", "<div id=page>%s</div>", "<main><article>%s</article></main>"])
def test_short_blocks_of_the_article_stay(shell):
    menu = "<ul><li><a href=1>One page</a></li><li><a href=2>Other page</a></li><li><a href=3>Third page</a></li></ul>"
    page = lambda inner: f"<html><body><nav>{menu}</nav>{shell.replace('%s', inner)}<footer>me</footer></body></html>"
    head = "<div><h1>T</h1><p>Lead.</p></div>"
    assert html_text.main_text(page(f"{head}<div>{PARAGRAPHS}</div>")) == f"T\nLead.\n{PARAGRAPH_TEXT}"
    two = "<section><h2>Two</h2><p>Short.</p></section>"
    assert html_text.main_text(page(f"<section>{PARAGRAPHS}</section>{two}")) == f"{PARAGRAPH_TEXT}\nTwo\nShort."
    assert html_text.main_text(page(f"{head}<div>{PARAGRAPHS}</div><div>{menu}</div>{two}")) == f"T\nLead.\n{PARAGRAPH_TEXT}\nTwo\nShort."
    named = "<p class=share-price>Shares fell.</p><p class='menu-recipe big'>Take two eggs.</p><p class=ad>Buy.</p>"
    assert html_text.main_text(page(f"<div>{PARAGRAPHS}{named}</div>")) == f"{PARAGRAPH_TEXT}\nShares fell.\nTake two eggs."
    loose = f"Loose text <ul><li>and an item</li></ul><div>{PARAGRAPHS}</div>"
    if "article" in shell:
        assert html_text.main_text(page(loose)) == f"Loose text\nand an item\n{PARAGRAPH_TEXT}"


def test_headed_section_of_the_body_stays():
    page = f"<html><body><section>{PARAGRAPHS}</section><section><h2>Two</h2><p>Short.</p></section><div>We use cookies.</div></body></html>"
    assert html_text.main_text(page) == f"{PARAGRAPH_TEXT}\nTwo\nShort."


def test_main_text_of_a_very_long_page():
    many = "".join(f"<div><p>Paragraph {k} of a very long page with some words in it.</p></div>" for k in range(30000))
    text = html_text.main_text(f"<html><body><nav><a href=x>x</a></nav><article>{many}</article></body></html>")
    assert text.count("\n") == 29999 and text.endswith("Paragraph 29999 of a very long page with some words in it.")


def test_columns_of_any_name_come_through(spark, documents, corpus):
    """Columns named like those that stages and statistics use, with null texts, repeated rows and an empty table."""
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    names = ["_keep", "_text", "n_lines", "n_dropped", "c_custkey", "upper", "digits", "score", "a.b", "others"]
    odd = documents.select("doc_id", "text", "n_chars", *[F.concat(F.lit(f"{n} "), F.col("row")).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf)
        rows = out.collect()
        assert out.columns == odd.columns and rows
        assert all(r[n] == f"{n} z" for r in rows for n in names)
        assert stage(spark, odd.limit(0), sf).count() == 0
    marked = line_runs.without_repeated_lines(odd)
    assert marked.columns == [c for c in odd.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    assert marked.count() == len(corpus) and marked.select("n_lines").first()[0] >= 1
    scored = quality.scored(odd, spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(odd.columns) - {"score"} < set(scored.columns) and {r.upper for r in scored.collect()} == {"upper z"}

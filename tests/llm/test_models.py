"""Operators 2, 7 and 8: held-out accuracy, exact decoding, awkward rows."""

import html as H
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq

from tellurion.llm import html, langid, quality

from .conftest import TEXTS

FOLDER = "/root/testdata/sf0.01"


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    counts, trans = np.array([3, 1, 4]), rng.normal(size=(2, 2))
    energy = rng.normal(size=counts.sum())
    got, pairs, log_z = quality.marginals(energy, trans, counts)
    at, total, want_pairs = 0, 0.0, np.zeros((2, 2))
    for n in counts:
        e, weight, one = energy[at : at + n], 0.0, np.zeros(n)
        own = np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[k] for k in range(n) if path[k]) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            weight += w
            one += w * np.array(path)
            for a, b in zip(path, path[1:]):
                own[a, b] += w
        assert np.allclose(got[at : at + n], one / weight)
        total += np.log(weight)
        want_pairs += own / weight
        at += n
    assert np.isclose(log_z, total) and np.allclose(pairs, want_pairs)


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    from tellurion.llm.queries import op2_crf_quality

    found = {r.doc_id: r for r in op2_crf_quality(spark, FOLDER).collect()}
    assert len(found) == docs.count()
    test = [(r.quality, found[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(f.held_out and 0 <= f.score <= 1 and f.predicted == (f.score >= 0.3) for _, f in test)
    assert sum(y == f.predicted for y, f in test) / len(test) > 0.93


def test_quality_of_awkward_rows(spark, awkward, nothing):
    model = quality.fit_model(["Fine words here.\nMore fine words."] * 5 + ["$$$ ### $$$"] * 5, [1] * 5 + [0] * 5, rounds=20)
    found = quality.classify(awkward, model).collect()
    assert len(found) == len(TEXTS) and all(0 <= r.score <= 1 for r in found)
    assert quality.classify(nothing, model).count() == 0
    none = quality.train(nothing, spark.createDataFrame([], "doc_id long, quality int"))
    assert none.score(["a"])[0] == 0.5
    assert quality.keep_good(awkward, model).columns == awkward.columns


def test_lines_of_mixed_documents(spark):
    good = [f"Quiet words number {w} run along the page, and they end well.\nAnother calm line about {w} follows here." for w in ("one", "two", "three", "four", "five", "six")]
    bad = [f"BUY {w} NOW!!! $$$ ### | | |\n### {w} $$$ CLICK!!! %%%" for w in ("A1", "B2", "C3", "D4", "E5", "F6")]
    model = quality.fit_model(good + bad, [1] * 6 + [0] * 6)
    text = good[0] + "\n" + bad[0] + "\n" + good[1]
    assert (model.lines([text])[0] >= 0.5).tolist() == [True, True, False, False, True, True]
    rows = quality.label_lines(spark.createDataFrame([(7, text), (None, None), (8, "")], "doc_id long, text string"), model).collect()
    mine = sorted((r.line, r.start, r.end, r.is_good) for r in rows if r.doc_id == 7)
    assert [text.encode()[a:b].decode() for _, a, b, _ in mine] == text.split("\n") and [x[3] for x in mine] == [True, True, False, False, True, True]
    assert sorted((str(r.doc_id), r.start, r.end) for r in rows if r.doc_id != 7) == [("8", 0, 0), ("None", 0, 0)]


def test_quality_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, "Good text here." if k % 2 else "$$$ ###") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(1, 0), (2, 0)], "doc_id long, quality int")
    seen = []
    whole = quality.fit_model
    try:
        quality.fit_model = lambda t, y: seen.append((t, y))
        quality.train(docs, labels)
        quality.train(docs, labels, max_docs=5)
        quality.train(docs, labels, max_bytes=40)
    finally:
        quality.fit_model = whole
    assert len(seen[0][0]) == 39 and len(seen[1][0]) == 5 and 2 <= len(seen[2][0]) <= 5 and sum(map(len, seen[2][0])) <= 40


def test_language_held_out(spark):
    from tellurion.llm.queries import op8_language_id

    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = op8_language_id(spark, FOLDER).collect()
    test = [r for r in found if r.held_out]
    assert len(found) == len(docs) and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in test)
    assert sum(docs[r.doc_id].lang == r.lang_pred for r in test) / len(test) > 0.97


def trained():
    counts, scripts = {}, {}
    for lang, text in (("en", "the quick brown fox jumps over the lazy dog and then runs away"), ("de", "der schnelle braune fuchs springt über den faulen hund und läuft weg"), ("ru", "быстрая лиса прыгает через собаку")):
        bucket, _, script, letters = langid._grams(text.split())
        counts[lang], scripts[lang] = np.bincount(bucket, minlength=langid.BUCKETS).astype(float), np.bincount(script, letters, langid.SCRIPTS)
    return langid.fit_model(counts, scripts, penalty=1.0)


def test_viterbi_is_exact():
    model, rng = trained(), random.Random(3)
    vocabulary = "the fox dog der hund über и лиса word läuft".split()
    docs = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 7))] for _ in range(60)]
    for words, path, ids in zip(docs, model.label(docs), list(model.ids)):
        s = model.scores[ids].astype(float)
        value = lambda p: sum(s[k, x] for k, x in enumerate(p)) - model.penalty * sum(a != b for a, b in zip(p, p[1:]))
        assert np.isclose(value(path.tolist()), max(value(p) for p in itertools.product(range(3), repeat=len(words))))


def test_language_of_awkward_rows(awkward, nothing):
    model = trained()
    found = {(r.doc_id, r.lang_pred) for r in langid.identify(awkward, model).collect()}
    assert {(2, "und"), (3, "und"), (6, "und")} <= found and (8, "und") not in found
    assert langid.identify(nothing, langid.train(nothing)).count() == 0
    assert model.predict(["собака лиса"])[0][0] == "ru" and model.predict(["der hund", None]) [1][0] == "und"
    spans = model.predict(["the lazy dog runs away " * 3 + "быстрая лиса прыгает через собаку " * 3])[0][2]
    assert [s[0] for s in spans] == ["en", "ru"]


def test_letters_decide_und_at_any_length():
    model = trained()
    assert [x[0] for x in model.predict(["\xb2 " * 60, "\xb2 " * 70, "1 " * 500, "\u0300 " * 99])] == ["und"] * 4
    assert langid.words_of("हिन्दी भाषा e\u0301te\u0301 x2y") == ["हिन्दी", "भाषा", "e\u0301te\u0301", "x", "y"]


def test_many_languages_and_keys():
    counts = {f"l{k:03d}": np.bincount(langid._grams([f"zq{k:03d}".translate(str.maketrans("0123456789", "abcdefghij")) * 2])[0], minlength=langid.BUCKETS) * 50.0 for k in range(200)}
    scripts = {k: np.eye(langid.SCRIPTS)[1] for k in counts}
    model = langid.fit_model(counts, scripts, 1.0)
    text = " ".join(("zqbfj zqbfj".replace(" ", "") + " ") * 6 + ("zqaab" * 2 + " ") * 6 for _ in range(2))
    assert {s[0] for s in model.predict([text])[0][2]} == {"l159", "l001"}
    assert langid.fit_model(counts, scripts, 9.0).key != model.key
    assert langid._own(model).penalty == 1.0 and langid._own(langid.fit_model(counts, scripts, 9.0)).penalty == 9.0


def test_unknown_scripts_and_even_mixes_go(spark):
    model = trained()
    rows = [(1, "the lazy dog and the quick fox jumps over"), (2, "日本語の文章です 日本語"), (3, "the lazy dog jumps over the quick fox " + "быстрая лиса прыгает через собаку быстрая"), (4, None)]
    assert [r.doc_id for r in langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()] == [1]


def reference(page):
    m = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
    blocks = [" ".join(H.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1|article)>", m[1])]
    return "\n".join(b for b in blocks if b)


def test_pages():
    pages = pq.read_table(f"{FOLDER}/pages.parquet").to_pylist()
    got = html.extract_all([p["html"] for p in pages], html.fitted())
    assert sum(g == reference(p["html"]) for g, p in zip(got, pages)) >= 0.99 * len(pages)


S1 = "The river rises in the northern hills and runs for two hundred miles, past old mills and quiet farms, before it meets the sea."
S2 = "In spring the snow melts quickly. Floods were common until the dam was built, and people still talk about the worst of them."
S3 = "Visitors come for the walks, the birds, and the small museum by the bridge."
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/a">News</a></li><li><a href="/b">Contact</a></li></ul>'
#: Hand-made layouts, with names and nesting that the composed pages do not have, and what they hold.
LAYOUTS = {
    "bare2": (f"<html><body><p>{S1}</p><p>{S2}</p></body></html>", [S1, S2]),
    "bare3": (f"<body><p>{S1}</p><p>{S2}</p><p>{S3}</p></body>", [S1, S2, S3]),
    "bare4": (f"<body><h1>The river</h1><p>{S1}</p><p>{S2}</p><p>{S3}</p></body>", ["The river", S1, S2, S3]),
    "form": (f'<body><form id="aspnetForm"><div class="k3z">{MENU}</div><div class="q9"><h1>The river</h1><p>{S1}</p><p>{S2}</p></div><div id="footer">Copyright 2020 Valley Trust</div></form></body>', ["The river", S1, S2]),
    "math": (f"<body><article><h1>Sums</h1><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be given. {S1}</p><p>{S2}</p></article></body>", ["Sums", f"Let x=1 be given. {S1}", S2]),
    "table": (f"<body><table><tr><td>{MENU}</td><td><h1>The river</h1><p>{S1}</p><p>{S2}</p></td></tr></table><p align=center>&copy; 2001 Valley Trust</p></body>", ["The river", S1, S2]),
    "neutral": (f'<body><div class="z1"><div class="z2">{MENU}</div><div class="z3"><h1>The river</h1><p>{S1}</p><p>{S2}</p><p>{S3}</p></div></div></body>', ["The river", S1, S2, S3]),
    "wiki": (f'<body><div id="mw-head">{MENU}</div><div id="bodyContent"><h1>River</h1><p>{S1}</p><h2>History</h2><p>{S2}</p><ul><li>first item of the list</li></ul></div><div id="mw-panel">{MENU}</div></body>', ["River", S1, "History", S2, "first item of the list"]),
    "news": (f'<body><header><nav>{MENU}</nav></header><main><div class="grid"><h1>The river</h1><p>{S1} <svg><title>icon</title><path d=""/></svg> {S3}</p><p>{S2}</p></div></main><section class="comments"><h3>2 comments</h3><p>Great story, thanks.</p></section><footer>Daily 2020</footer></body>', ["The river", f"{S1} {S3}", S2]),
    "lines": (f'<body><div class="hdr"><a href="/">Home</a> | <a href="/x">Shop</a></div><div class="txt">{S1}<br><br>{S2}</div></body>', [f"{S1} {S2}"]),
}


def test_foreign_layouts():
    wrong = [k for k, (page, want) in LAYOUTS.items() if html.extract_all([page], html.fitted())[0] != "\n".join(want)]
    assert not wrong


def test_places_of_many_siblings():
    nodes = html.parse("<body>" + "<p>some words here.</p>" * 120 + "</body>")
    places = html.features(nodes)[2:, len(html._TAGS) + 16]
    assert np.allclose(places, np.arange(120) / 120)


def test_synthetic_pages_held_out():
    good = n = 0
    for page in html.synthetic_pages(120, seed=77):
        nodes, kept = html._known(page)
        if nodes:
            n, good = n + 1, good + (html.extract_all([page], html.fitted())[0] == "\n".join(html._texts(nodes[0], kept)))
    assert good / n > 0.9


def test_decoding_has_no_contradictions():
    rng = np.random.default_rng(1)
    for page in html.synthetic_pages(20, seed=5):
        nodes = html.parse(page)[:11]
        for n in nodes:
            n.items = [i for i in n.items if not isinstance(i, html.Node) or i in nodes]
        z = rng.normal(size=len(nodes))
        kept = html.decode(nodes, z)
        assert all(not kept[n.order] or kept[n.parent.order] for n in nodes[1:])
        never = np.array([n.tag in html._NEVER for n in nodes])

        def value(k):
            return sum(-np.log1p(np.exp(-z[i])) if k[i] else -np.log1p(np.exp(z[i])) for i in range(len(nodes))) - 1e6 * sum(never & np.array(k))

        best = max(value((True, *k)) for k in itertools.product((False, True), repeat=len(nodes) - 1) if all(not k[n.order - 1] or n.parent.order == 0 or k[n.parent.order - 1] for n in nodes[1:]))
        assert np.isclose(value(kept), best)


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><h1>T</h1><p>Fish &amp;\n chips<p>x &lt; y</article>"), (4, "u", "<!-- <p>no</p> --><script>'<p>'</script>" * 50)]
    found = {r.page_id: (r.text, r.n_chars) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {1: ("", 0), 2: ("", 0), None: ("T\nFish & chips\nx < y", 20), 4: ("", 0)}
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

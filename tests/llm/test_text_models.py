"""Language, quality and page models: held-out accuracy and edge cases."""

import html as html_lib
import random
import re

import numpy as np

from quillspark.llm import html_text, langid, quality

MID = "/root/testdata/sf0.01"


def test_language_accuracy_and_folds(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    got = langid.op9_language_id(spark, MID).join(docs, "doc_id")
    rows = got.select("held_out", "lang", "lang_pred", "score").collect()
    held = [r for r in rows if r.held_out]
    assert 0.2 < len(held) / len(rows) < 0.3
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    rows = [(1, "the and of the and", "en", "x"), (1, "the and of the and", "en", "x"), (2, "der die das und", "de", "y"), (3, None, "de", None), (4, "12 + 3 = !?", None, ""), (5, "", "en", ""), (None, "und der das", None, None), (6, "THE AND " * 30000, None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = langid.predict(df, langid.fit(df))
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    said = {(r.doc_id): (r.lang_pred, r.score) for r in got.collect()}
    assert said[1][0] == "en" and said[2][0] == "de" and said[6][0] == "en" and said[None][0] == "de"
    assert said[3] == said[4] == said[5] == ("und", 0.0)
    none = df.limit(0)
    assert langid.predict(none, langid.fit(none)).count() == 0
    assert {r.lang_pred for r in langid.predict(df, langid.fit(none)).collect()} == {"und"}


def test_ngrams_stay_in_documents():
    import pyarrow as pa

    data, at = langid.lowered(pa.array(["ABCD", None, "xé"]))
    whole = langid.counts_of(data, at)
    apart = sum(langid.counts_of(*langid.lowered(pa.array([t]))) for t in ("abcd", "", "xé"))
    assert (whole == apart).all()


def test_quality_accuracy(spark):
    got = quality.op4_quality(spark, MID).join(spark.read.parquet(f"{MID}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert np.mean([s >= 0.3 for s in good]) > 0.97
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all((r.predicted == 1) == (r.score >= 0.3) for r in got)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "good words here.", 9.0), (2, None, 1.0), (3, "", 1.0), (None, "x", 1.0), (1, "good words here.", 9.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, 0)], "doc_id long, quality int")
    out = quality.predict(docs, quality.fit(docs, labels))
    assert out.count() == 5 and out.columns == ["doc_id", "text", "score", "predicted"]
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert {r.score for r in quality.predict(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.predict(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_class_prior_is_near():
    r = np.random.default_rng(0)
    p, n = r.normal(2, 1, (4000, 6)), r.normal(-2, 1, (4000, 6))
    u = np.vstack([p[:1400], n[:600]])
    model = quality.fit_arrays(p[2000:], u)
    assert 0.6 < model["prior"] < 0.85
    s = quality.score_features(np.vstack([p[1400:2000], n[600:1200]]), model)
    assert (s[:600] > 0.5).mean() > 0.97 and (s[600:] < 0.5).mean() > 0.97


def test_features_do_not_depend_on_neighbours():
    import pyarrow as pa

    texts = ["One two two. %%%", "", "ÄÖ ü\nx", "a" * 50 + " b b b"]
    whole = quality.featurise(pa.array(texts))
    apart = np.vstack([quality.featurise(pa.array([t])) for t in texts])
    assert np.allclose(whole, apart)


def test_pages_held_out():
    field, r = html_text.fit(), random.Random(99)
    right = total = 0
    for _ in range(100):
        page, y = html_text.labelled_page(r)
        found = field.blocks(page)
        z = field.decode([field.emission(*b) for b in found])
        right += sum(a == b for a, b in zip(z, y, strict=True))
        total += len(y)
    assert right / total > 0.985


def test_viterbi_is_best_path():
    import itertools

    field = html_text.Field({}, np.array([[0.5, -1.0], [-0.3, 0.7]]), np.array([0.2, -0.1]))
    r = random.Random(1)
    for _ in range(50):
        e = [r.uniform(-2, 2) for _ in range(7)]
        value = lambda y: field.first[y[0]] + sum(s for s, k in zip(e, y, strict=True) if k) + sum(field.pairs[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert value(field.decode(e)) == max(map(value, itertools.product([0, 1], repeat=7)))


def test_pages_of_the_table(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html_text.op10_html_text(spark, sf).collect():
        inner = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = (" ".join(html_lib.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner))
        assert r.text == "\n\n".join(filter(None, parts)) and r.n_chars == len(r.text)


def test_page_edges(spark):
    deep = "<div>" * 3000 + "<article><p>Deep text here.</p></article>"
    rows = [(1, None, "u"), (2, "", "u"), (3, "<article><p>A &amp; B&nbsp;&lt;c&gt;\n\t d.</p><p>Second one here.", None), (None, "no tags at all", "x"), (5, "<script>var a='<p>no</p>'", "x"), (6, deep, "x"), (7, "<article><p>" + "word " * 200000 + "</p></article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, url string")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert got[1].text == got[2].text == got[5].text == "" and got[1].n_chars == 0
    assert got[3].text == "A & B <c> d.\n\nSecond one here."
    assert got[6].text.endswith("Deep text here.") and got[7].n_chars == 200000 * 5 - 1
    assert html_text.extract(df.limit(0)).count() == 0


def test_language_model_against_plain_python(spark):
    """Counts, log-probabilities and posteriors as a plain multinomial model gives them, n-gram by n-gram."""
    import math

    rows = [(1, "Der Ärger, 日本!", "de"), (2, "the cat and THE dog", "en"), (3, "aa", "en"), (4, "é", "de"), (5, "der the", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def grams(text):
        points = np.array([ord(c) for c in text.lower()], np.uint32)
        return [int(langid.ngram_buckets(points[i : i + n], n)[0]) for n in langid.ORDERS for i in range(len(points) - n + 1)]

    names, matrix = langid.fit(df)
    assert names == ["de", "en"]
    logp, prior = {}, {}
    for name in names:
        count = np.full(langid.BUCKETS, 0.5)
        for _, text, lang in rows:
            for g in grams(text) if lang == name else []:
                count[g] += 1
        logp[name], prior[name] = np.log(count / count.sum()), math.log(sum(x[2] == name for x in rows) / len(rows))
    assert np.allclose(matrix[:-1, 0], logp["de"], atol=1e-5) and np.allclose(matrix[-1], [prior["de"], prior["en"]], atol=1e-5)
    texts = {i: t for i, t, _ in rows} | {6: "a", 7: "and der cat 日本 Ä"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in langid.predict(docs, (names, matrix)).collect():
        total = {n: prior[n] + sum(logp[n][g] for g in grams(texts[r.doc_id])) for n in names}
        best = max(names, key=lambda n: total[n])
        assert r.lang_pred == best and abs(r.score - 1 / sum(math.exp(total[n] - total[best]) for n in names)) < 1e-3


def test_language_ties_and_too_many_labels(spark, monkeypatch):
    import pytest

    same = spark.createDataFrame([(1, "one text", "b"), (2, "one text", "a")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.predict(same, langid.fit(same)).collect()} == {"a"}
    monkeypatch.setattr(langid, "LANGUAGES", 1)
    with pytest.raises(ValueError, match="languages"):
        langid.fit(same)


def test_quality_risk_and_gradient():
    """The gradient against finite differences of the unbiased risk, and the step back where its negative part is below zero."""
    r = np.random.default_rng(4)
    p, u = np.hstack([r.normal(1, 1, (50, 3)), np.ones((50, 1))]), np.hstack([r.normal(-0.5, 1, (70, 3)), np.ones((70, 1))])
    for prior, w in ((0.3, r.normal(0, 1, 4)), (0.95, np.array([3.0, 0, 0, 1]))):
        soft = lambda z: np.logaddexp(0, z)
        positive = lambda w: prior * soft(-(p @ w)).mean()  # noqa: B023, E731
        negative = lambda w: soft(u @ w).mean() - prior * soft(p @ w).mean()  # noqa: B023, E731
        whole = (lambda w: positive(w) + negative(w)) if negative(w) >= 0 else (lambda w: -negative(w))  # noqa: B023
        steps = 1e-5 * np.eye(4)
        want = np.array([(whole(w + s) - whole(w - s)) / 2e-5 for s in steps])
        assert np.allclose(quality.risk_gradient(w, p, u, prior), want, atol=1e-6)
    assert negative(w) < 0  # the last case takes the correction


def test_quality_bounds_and_threshold(spark):
    rows = [(None, f"text {i % 3}") for i in range(400)]
    docs = spark.createDataFrame(rows, "k long, t string")
    assert len(quality._sample(docs, 30, 5)) <= 30
    model = {"w": np.zeros(quality.N_FEATURES + 1), "mean": np.zeros(quality.N_FEATURES), "scale": np.ones(quality.N_FEATURES), "prior": 0.5}
    model["w"][-1] = np.log(0.3 / 0.7)
    out = quality.predict(docs.withColumnRenamed("t", "text"), model, threshold=float(quality.score_features(np.zeros((1, quality.N_FEATURES)), model)[0])).collect()
    assert {r.predicted for r in out} == {1}  # a score at the threshold is good
    long = spark.createDataFrame([(1, "word and word. " * 200_000)], "doc_id long, text string")
    assert 0 <= quality.predict(long, model).first().score <= 1


def test_field_likelihood_against_all_paths():
    import itertools
    import math

    r = np.random.default_rng(3)
    pages, longest, features = 4, 5, 3
    mask = np.zeros((pages, longest), bool)
    for k, n in enumerate((5, 1, 3, 4)):
        mask[k, :n] = True
    y = np.where(mask, r.integers(0, 2, mask.shape), 0)
    flat, w = r.integers(0, 2, (mask.sum(), features)).astype(float), r.normal(0, 1, features + 6)

    def by_hand(w):
        pairs, first, at, total = w[-6:-2].reshape(2, 2), w[-2:], 0, 0.0
        for k in range(pages):
            n = mask[k].sum()
            e = flat[at : at + n] @ w[:features]
            at += n
            value = lambda path: first[path[0]] + sum(s for s, z in zip(e, path, strict=True) if z) + sum(pairs[a, b] for a, b in zip(path, path[1:]))  # noqa: B023, E731
            total += value(y[k, :n].tolist()) - math.log(sum(math.exp(value(path)) for path in itertools.product([0, 1], repeat=int(n))))
        return total / pages

    value, gradient = html_text.likelihood(w, flat, y, mask)
    assert abs(value - by_hand(w)) < 1e-9
    steps = 1e-5 * np.eye(len(w))
    assert np.allclose(gradient, [(by_hand(w + s) - by_hand(w - s)) / 2e-5 for s in steps], atol=1e-6)


FOREIGN = [
    (
        """<html><head><title>T</title></head><body class="home"><div id="wrapper"><div id="masthead"><a href="/">Site name</a></div><ul class="menu"><li><a href=a>Home</a><li><a href=b>About us</a></ul>
<div id="main-content"><h1>A long day in May</h1><p class="byline">By Ann Lee</p><p>The river rose in the night and by morning it had covered the fields. People came out to look at it.</p><p>Nobody had seen <em>such water</em> before, and it was cold.</p><figure><img src=x><figcaption>The river at dawn.</figcaption></figure><table><tr><td>Day<td>Level</tr><tr><td>One<td>Two metres</tr></table><pre>code here</pre></div>
<div class="right-col sidebar"><h3>Popular</h3><p><a href=x>Some other story</a></p></div><div class="comments"><h3>3 comments</h3><p>I was there too, it was a terrible thing to see that day.</p></div><div id="footer"><p>Copyright 2020 The Site. All rights reserved.</p></div></div></body></html>""",
        ["A long day in May", "The river rose", "Nobody had seen such water", "The river at dawn.", "Two metres", "code here"],
        ["Site name", "Home", "Popular", "Some other story", "I was there", "Copyright", "3 comments"],
    ),
    (
        """<body><nav><a href=1>One</a><a href=2>Two</a></nav><main><article class="post"><header><h1>Title of it</h1></header><section><h2>Part</h2><p>First words of the text are here. They go on for a while.</p><ol><li>Point one of it.</li><li>Point two of it.</li></ol></section><aside class=ad>Buy now!</aside><p>Last words of it, in the end.</p></article></main><footer>About | Contact</footer><div class="cookie-banner">We use cookies to make this site better. Accept?</div>""",
        ["Title of it", "Part", "First words", "Point one", "Point two", "Last words"],
        ["One", "Buy now", "About", "We use cookies"],
    ),
    (
        """<div class="page"><div class="content-area"><div class="post-body"><h1>Ein Titel</h1><p>Erster Absatz des Textes, der hier steht. Er ist lang genug.</p><blockquote><p>Ein Zitat steht hier.</p></blockquote><p>Ende des Textes.</p></div><form action=x><label>Name</label><input><textarea>Write</textarea><button>Send</button></form><section id="reader-comments"><article class="comment"><p>Sehr gut geschrieben, danke!</p></article></section></div></div>""",
        ["Ein Titel", "Erster Absatz", "Ein Zitat", "Ende des"],
        ["Name", "Send", "Sehr gut"],
    ),
]


def test_pages_of_other_templates():
    field = html_text.fit()
    for page, kept, gone in FOREIGN:
        text = field.extract(page)
        assert all(x in text for x in kept) and not any(x in text for x in gone)


def test_pages_keep_inline_elements_and_hostile_markup_is_linear():
    import time

    field = html_text.fit()
    assert field.extract("<article><p>Let <math><mi>x</mi></math> be. <object>fallback prose</object> end</p></article>") == "Let x be. fallback prose end"
    assert field.extract('<article><p title="a > b">One text is here.</p><p a=">Two more of them.</p></article>').startswith("One text is here.")
    n, start = 50_000, time.time()
    for page in ("<a " * n, "<div>" * n + "</p>" * n, '<a "x>" ' * n, "<textarea>" * n, '<div class="' * n + ">", "<ul><li>x" * n, "<!-" * n):
        field.extract(page)
    assert time.time() - start < 30


def test_pages_with_repeats_and_other_columns(spark):
    page = "<article><p>Some text is here.</p></article>"
    df = spark.createDataFrame([(1, page, "u", 9, "t"), (1, page, "u", 9, "t")], "page_id long, html string, url string, n_chars int, text string")
    assert [tuple(r) for r in html_text.extract(df).collect()] == [(1, "u", "Some text is here.", 18)] * 2

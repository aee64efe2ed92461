"""Quality classifier, language ID, HTML text, section tokens."""

import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from caliper.llm import html_text, langid, quality, token_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROOT = "/root/testdata/sf0.01"
data = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test data")


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], SCHEMA)


ODD = ["", None, "   ", "1234 !!", "x", "é" * 300_000, "word " * 60_000, "a\x00b", "🙂 ok"]


def test_features_ignore_block_borders():
    text = " ".join(f"w{i}" for i in range(400_000))
    at, value = quality.features(text)
    assert len(text) > quality._BLOCK and abs(float(value @ value) - 2.0 - len(quality.HEADS)) < 1e-3
    assert all(not quality.features(t)[1].any() for t in (None, ""))
    assert quality.features("so so so it")[1][-1] == np.float32(0.5**0.5)


def test_ordinal_recovers_grades():
    rng = random.Random(1)
    words = {0: ["bad", "worse"], 1: ["fair", "middling"], 2: ["good", "fine"]}
    rows = [(g, " ".join(rng.choice(words[g] + ["the", "of"]) for _ in range(30))) for g in range(3) for _ in range(60)]
    model = quality.fit_arrays([quality.features(t) for _, t in rows], np.array([g for g, _ in rows]), 3)
    assert (np.diff(model.thresholds) > 0).all()
    means = [np.mean([model.tails(t).sum() for h, t in rows if h == g]) for g in range(3)]
    assert means[0] < 0.4 < 0.7 < means[1] < 1.3 < 1.6 < means[2]


def test_ordinal_likelihood_by_differences():
    """The loss against the model's definition, its slopes against differences of the loss."""
    rng = np.random.default_rng(4)
    z, grades, share = rng.normal(0, 2, 12), rng.integers(0, 4, 12), rng.dirichlet(np.ones(12))
    theta = np.array([-1.0, 0.3, -0.5])
    cut = [-1.0, -1.0 + np.exp(0.3), -1.0 + np.exp(0.3) + np.exp(-0.5)]
    cdf = lambda x: 1 / (1 + np.exp(-x))
    p = [(cdf(cut[g] - x) if g < 3 else 1.0) - (cdf(cut[g - 1] - x) if g else 0.0) for x, g in zip(z, grades, strict=True)]
    loss, by_z, by_theta = quality.loss_and_slopes(z, theta, grades, share)
    assert abs(loss + (share * np.log(p)).sum()) < 1e-9
    at = lambda i, e, x: x + e * (np.arange(len(x)) == i)
    slope = lambda f, i, x: (f(at(i, 1e-5, x)) - f(at(i, -1e-5, x))) / 2e-5
    assert np.allclose(by_z, [slope(lambda y: quality.loss_and_slopes(y, theta, grades, share)[0], i, z) for i in range(12)], atol=1e-6)
    assert np.allclose(by_theta, [slope(lambda y: quality.loss_and_slopes(z, y, grades, share)[0], i, theta) for i in range(3)], atol=1e-6)


def test_fit_is_the_weighted_optimum():
    """A row of weight 3 counts as three rows, and no small step from the fit lowers the loss much."""
    rows = [quality.features(t) for t in ("good fine", "bad worse", "fair good bad", "worse fair")]
    grades = np.array([2, 0, 1, 0])
    a = quality.fit_arrays(rows, grades, 3, weight=np.array([1.0, 3, 1, 1]))
    b = quality.fit_arrays([rows[i] for i in (0, 1, 1, 1, 2, 3)], grades[[0, 1, 1, 1, 2, 3]], 3)
    assert np.allclose(a.weights, b.weights, atol=1e-3) and np.allclose(a.thresholds, b.thresholds, atol=1e-3)


def test_repeated_ratings_and_texts_are_weights(spark):
    docs = spark.range(3000).selectExpr("0L as doc_id", "'same text' as text").union(spark.createDataFrame([(i, f"text {i}") for i in range(1, 40)], "doc_id long, text string"))
    ratings = spark.createDataFrame([(i, i % 3) for i in range(40)] * 50, "doc_id long, grade int")
    got = quality.rated_features(docs, ratings, 3, max_rated=30).collect()
    assert len(got) <= 30 and {r["n"] for r in got} <= {50, 150_000}
    assert quality.rated_features(docs, ratings, 3).agg(F.sum("n")).first()[0] == 150_000 + 39 * 50


def test_quality_edges(spark):
    docs = documents(spark, ODD)
    ratings = spark.createDataFrame([(0, 1), (1, 2), (None, 1), (3, None), (4, 9), (6, 0), (6, 0)], "doc_id long, grade int")
    model = quality.fit(docs, ratings, 3)
    assert quality.scored(docs, model).count() == len(ODD)
    assert quality.scored(docs.limit(0), model).count() == 0
    kept = quality.selected(docs.withColumn("tails", F.lit(1)), model, keep_at=0.0)
    assert kept.columns == [*docs.columns, "tails"] and kept.count() == len(ODD)
    none = quality.fit(docs, ratings.limit(0), 3)
    assert quality.scored(docs, none).count() == len(ODD)


@data
def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{ROOT}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, quality.graded(labels.where("doc_id % 3 > 0")), 3)
    rows = quality.scored(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").select("quality", F.col("tails")[0].alias("p")).collect()
    right = sum((r["p"] >= 0.5) == (r["quality"] == 1) for r in rows)
    assert right / len(rows) > 0.95
    assert all(r["p"] >= 0.5 for r in rows if r["quality"] == 1)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_toxic_held_out_documents_go(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, quality.graded(labels.where("doc_id % 3 > 0")), 3)
    held = quality.graded(labels.where("doc_id % 3 = 0"))
    kept = quality.selected(docs, model).select("doc_id", F.lit(1).alias("kept"))
    rows = held.join(kept, "doc_id", "left").groupBy("grade").agg(F.count("*").alias("n"), F.count("kept").alias("kept")).collect()
    share = {r["grade"]: r["kept"] / r["n"] for r in rows}
    assert share[0] < 0.05 and share[1] < 0.35 and share[2] > 0.99


def test_letter_codes():
    assert langid.letter_codes("12 !").tolist() == []
    assert langid.letter_codes("Ab,, c").tolist() == [0, 97, 98, 0, 99, 0]


def test_kneser_ney_sums_to_one(spark):
    docs = spark.createDataFrame([("abracadabra abra", "x"), ("banana bandana", "x"), ("zzz yyy", "y")], "text string, lang string")
    model = langid.fit(docs, docs, order=3)
    letters = sorted(set(langid.letter_codes("abracadabra abra banana bandana").tolist()))
    for context in ("ab", "an", "ra"):
        x = [ord(c) for c in context]
        total = sum(np.exp(model._block(np.array([*x, c], np.uint32), 2)[model.langs.index("x")]) for c in letters)
        # what is left is the unseen character's share
        assert 0.9 < total <= 1.0001


def direct_kneser_ney(texts, order):
    """log P(c | context) from the definition, with plain dictionaries."""
    seqs = ["".join(map(chr, langid.letter_codes(t).tolist())) for t in texts]
    seqs = [s for s in seqs if len(s) >= order]
    counts = [None] * (order + 1)
    for n in range(1, order + 1):
        counts[n] = Counter(s[i : i + n] for s in seqs for i in range(len(s) - n + 1))
    used = [None, *(Counter({g: max(1, sum(x[1:] == g for x in counts[n + 1])) for g in counts[n]}) for n in range(1, order)), counts[order]]
    discount = [None] * (order + 1)
    for n in range(1, order + 1):
        one, two = (sum(v == x for v in used[n].values()) for x in (1, 2))
        discount[n] = min(max(one / max(1, one + 2 * two), 0.1), 0.9)

    def prob(context, c):
        n = len(context) + 1
        grams = {g: v for g, v in used[n].items() if g[:-1] == context}
        if not grams:
            return prob(context[1:], c)
        total = sum(grams.values())
        left = discount[n] * len(grams) / total
        own = max(0.0, grams.get(context + c, 0) - discount[n]) / total if context + c in grams else 0.0
        return own + left * (prob(context[1:], c) if n > 1 else 1 / (len(grams) + 1))

    return prob


def test_kneser_ney_by_its_definition(spark):
    texts = ["abracadabra abra", "banana bandana", "a cab ran", "band brand"]
    model = langid.fit(spark.createDataFrame([(t, "x") for t in texts], "text string, lang string"), spark.createDataFrame([], "text string, lang string"), order=3)
    prob = direct_kneser_ney(texts, 3)
    for text in ("banana", "abracadabra", "cabana zebra", "q"):
        codes = langid.letter_codes(text)
        s = "".join(map(chr, codes.tolist()))
        want = sum(np.log(prob(s[max(0, i - 2) : i], s[i])) for i in range(1, len(s)))
        got, n = model.score(codes)
        assert n == len(s) - 1 and abs(got[0] - want) < 1e-4


def test_copies_count_once_in_the_sample(spark):
    rows = spark.range(20_000).selectExpr("'the same text here' as text", "'en' as lang").union(spark.createDataFrame([(f"text number {i}", "en") for i in range(200)], "text string, lang string"))
    got = langid._bounded(rows, 100, 1).groupBy("text").count().collect()
    assert all(r["count"] == 1 for r in got) and 50 < len(got) < 170


def test_find_looks_everything_up():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64) >> np.uint64(20) << np.uint64(8))
    m = langid.Model(["x"], 4, keys, np.zeros((len(keys) + 1, 1), np.float32), np.zeros((len(keys) + 1, 1), np.float32), np.zeros(1, np.float32))
    m.index()
    assert (m.find(keys) == np.arange(len(keys))).all()
    assert (m.find(keys + np.uint64(1)) == len(keys)).all()


def test_langid_edges(spark):
    docs = documents(spark, [*ODD, "hello there", "hello there"])
    model = langid.fit_on_folds(docs)
    got = {r["doc_id"]: r for r in langid.predicted(docs, model).collect()}
    assert len(got) == len(ODD) + 2
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2, 3))
    assert all(got[i]["lang_pred"] == "en" and 0 <= got[i]["score"] <= 1 for i in range(4, len(ODD)))
    assert got[len(ODD)][1:] == got[len(ODD) + 1][1:]
    none = langid.fit_on_folds(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predicted(docs, none).collect()} == {"und"}
    assert langid.predicted(docs.limit(0), model).count() == 0


@data
def test_langid_on_held_out_fold(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    model = langid.fit_on_folds(docs)
    held = docs.where(langid.fold(F.col("doc_id")) == 1).select("doc_id", "lang")
    rows = langid.predicted(docs, model).join(held, "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.98
    assert sum(r["rejected"] for r in rows) / len(rows) < 0.01
    noise = documents(spark, ["".join(random.Random(i).choice("qxzjkwvyh") for _ in range(400)) for i in range(20)])
    assert all(r["rejected"] for r in langid.predicted(noise, model).collect())


@data
def test_few_wrong_calibration_rows_do_not_open_the_limit(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text", "lang")
    spanish = docs.where("lang = 'es' and length(text) > 200")
    ids = [i for i in range(10**6, 10**6 + 60) if zlib.crc32(str(i).encode()) % 3 == 2][:8]  # of the calibration fold
    noise = ["".join(random.Random(i).choice("qxzjkwvyh ") for _ in range(400)) for i in range(40)]
    wrong = [r["text"] for r in spanish.orderBy("doc_id").limit(4).collect()] + noise[:4]
    rows = docs.where("lang <> 'es'").union(spark.createDataFrame([(i, t, "en") for i, t in zip(ids, wrong, strict=True)], docs.schema))
    model = langid.fit_on_folds(rows)
    rejected = lambda d: [r["rejected"] for r in langid.predicted(d, model).collect()]
    assert np.mean(rejected(spanish)) > 0.8 and np.mean(rejected(documents(spark, noise[4:]))) > 0.95
    assert np.mean(rejected(docs.where("lang <> 'es'"))) < 0.01


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>The  title</h1><p>One &amp; two <b>bo</b>ld<br>next&nbsp;line.</p><div class="ad">Buy</div><p>Short.</p><!-- <p>no</p> -->
<form>Search</form><p>5 &lt; 6 &#233;</p></article><aside>Side</aside><div id="comments"><p>First!</p></div><footer>&copy; x</footer></body></html>"""


def test_article_of_a_page():
    assert html_text.main_text(PAGE) == "The title\n\nOne & two bold next line.\n\nShort.\n\n5 < 6 é"


def test_unmarked_page_by_line_blocks():
    body = "".join(f"<p>Paragraph {i} {'long text goes on and on ' * 5}</p>" for i in range(5))
    page = f"<html><body><div><a href='/a'>A</a> <a href='/b'>B</a></div><div>{body}</div><div><p>tiny</p></div></body></html>"
    text = html_text.main_text(page)
    assert text.count("Paragraph") == 5 and "tiny" not in text and "A" not in text.split("\n")[0][:1]


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("plain < text", "plain < text"), ("<p>cut off &am", "cut off &am"), ("<p>a</p><p>b</", "a\n\nb</"), ("<div", ""), ("<script>x", ""), ("<p title=don't>a</p><p x='>'>it's</p>", "a\n\nit's")])
def test_broken_pages(page, text):
    assert html_text.main_text(page) == text


UNCLOSED = [
    ('<article><p class="ad">Buy<p>Text</p><p>Text</p></article>', "Text\n\nText"),
    ("<div><aside>Side</div><p>Text</p>", "Text"),
    ("<ul><li class=ad>Buy<li>One<li>Two</ul>", "One\n\nTwo"),
    ("<dl><dt class=promo>x<dd>One</dl><p>after", "One\n\nafter"),
    ("<table><tr><td class=ad>x<td>One<tr class=ad><td>y<tr><td>Two</table>", "One\n\nTwo"),
    ("<head><meta x><p>Text", "Text"),
    ("<p>a <svg/> b", "a b"),
    ("<div><div class=ad><div>x</div>y</div>z</div>", "z"),
]


@pytest.mark.parametrize(("page", "text"), UNCLOSED)
def test_boilerplate_ends_where_html_ends_it(page, text):
    assert html_text.main_text(page) == text


LONG = "long text goes on and on " * 6
SHORT = [
    (f"<div><div><h1>Title</h1></div><div><p>{LONG}</p><p>{LONG}</p></div></div>", 3),
    (f"<div><p>{LONG}</p><ul><li>a<li>b</ul><p>{LONG}</p></div>", 4),
    (f"<div><p>{LONG}</p><table><tr><td>1<td>2</table><p>{LONG}</p></div>", 4),
    (f"<div><div><p>{LONG}</p></div><div><p>Short.</p></div><div><p>{LONG}</p></div></div>", 3),
    (f"<div><p>{LONG}</p><ul>{'<li><a href=x>A link</a>' * 4}</ul><p>{LONG}</p></div>", 6),
    (f"<div>{'<div><p>A paragraph of about forty characters.</p></div>' * 4}</div>", 4),
    (f"<ul>{'<li><a href=x>Menu</a>' * 5}</ul><div><p>{LONG}</p></div><ul>{'<li><a href=x>Menu</a>' * 5}</ul>", 1),
    (f"<div><p>{LONG}</p></div><div><p>{LONG}</p></div><div><p>tiny</p></div>", 2),
]


@pytest.mark.parametrize(("page", "blocks"), SHORT)
def test_short_blocks_of_the_text_stay(page, blocks):
    text = html_text.main_text(page)
    assert len(text.split("\n\n")) == blocks and "Menu" not in text and "tiny" not in text


def test_article_counts_by_its_text():
    links = "<ul>" + "<li><a href=x>Related</a>" * 5 + "</ul>"
    page = f"<div class=post><p>{LONG}</p><p>{LONG}</p></div><article class=card>teaser</article>"
    assert html_text.main_text(page).count("long text") == 12
    page = f"<div><p>outside {LONG}</p></div><article><div><p>{LONG}</p><p>{LONG}</p></div><div><p>The end.</p></div>{links}</article>"
    text = html_text.main_text(page)
    assert text.count("long text") == 12 and text.endswith("The end.") and "outside" not in text
    assert html_text.main_text(f"<article>{links}</article>").count("Related") == 5


NAMED = [
    (f'<article><p class="notice-period">Notice.</p><p>{LONG}</p><p class="share-price">Price.</p><p class="skip-logic">x</p><p class="ad-hoc">y</p></article>', 5),
    (f"<article><header><h1>Head</h1><a href=x>By me</a></header><p>{LONG}</p></article>", 2),
    (f'<article><p>{LONG}</p></article><section class="replies"><article><p>Reader: {LONG}</p></article></section>', 1),
    (f"<main><article><p>{LONG}</p><article><p>Reader: {LONG}</p></article></article></main>", 1),
    (f"<article><p>{LONG}</p><ul>{'<li><a href=x>Related story</a>' * 12}</ul><p>{LONG}</p></article>", 2),
    (f"<div><div><h1>Head</h1></div><div><p>{LONG}</p></div><div><p>Short.</p></div><div><p>{LONG}</p></div><div><p>End.</p></div></div><div>Copyright</div>", 5),
    (f'<div><p>{LONG}</p><div class="ad">Buy {LONG}</div><p>End.</p></div><div>Copyright</div>', 2),
]


@pytest.mark.parametrize(("page", "blocks"), NAMED)
def test_furniture_is_named_as_a_whole(page, blocks):
    text = html_text.main_text(page)
    assert len(text.split("\n\n")) == blocks and not any(x in text for x in ("Reader", "Related", "Copyright", "Buy", "By me"))


DENSE = "This sentence of the article has words enough to be taken for a part of the text of a page, and then some more."
SAID = "I do not agree with a word of what is said above, and I have been baking for more than forty years in this town."
BODY = f"<p>{DENSE}</p>" * 4
DOUBTS = [
    (f'<article><h1>T</h1>{BODY}</article><div class="user-comments"><p>{SAID}</p><p>{SAID}</p></div>', [DENSE], [SAID]),
    (f'<article><h1>T</h1>{BODY}<div class="commentlist"><p>{SAID}</p><p>{SAID}</p></div></article>', [DENSE], [SAID]),
    (f'<div class="cookieBanner"><p>We use cookies to give you the best of all possible pages. {SAID}</p></div><article>{BODY}</article>', [DENSE], ["cookies"]),
    (f'<article><h1>T</h1>{BODY}<section class="discussion"><h2>Discussion</h2><p>{DENSE} First.</p><p>{DENSE} Second.</p></section></article>', ["Discussion", "First.", "Second."], []),
    (f'<article><p>{DENSE}</p><section class="discussion"><h2>Discussion</h2><div class="comment"><b class="author">Jo</b><p>{SAID}</p></div><p>{SAID}</p></section></article>', [DENSE], [SAID]),
    (f'<nav><a href="/">Home</a></nav><article><div class="cookie"><h1>Oat cookies</h1><p>{DENSE}</p><p>{DENSE}</p><ul><li>200 g oats</li><li>an egg</li></ul><p>{DENSE}</p></div></article>', ["Oat cookies", "200 g oats", DENSE], ["Home"]),
    (f"<body><div><p>{DENSE}</p></div><div><p>{DENSE}</p></div><div><p>{DENSE}</p></div><div><p>That is all.</p></div></body>", ["That is all."], []),
    (f'<body><div><p>{DENSE}</p></div><div><p>{DENSE}</p></div><div class="bottom"><p>Printed on paper by the people of this house, who wish you a good day and hope that you come again.</p></div></body>', [DENSE], ["Printed"]),
    (f'<article><h1>T</h1>{BODY}<div class="notice"><p>{SAID}</p><p>{SAID}</p></div></article>', [DENSE], [SAID]),
    (f'<article><h1>T</h1>{BODY}<div class="shareButtons"><p>Share this with all your friends</p></div></article>', [DENSE], ["Share"]),
]


@pytest.mark.parametrize(("page", "there", "gone"), DOUBTS)
def test_density_decides_over_class_names(page, there, gone):
    text = html_text.main_text(page)
    assert all(x in text for x in there) and not any(x in text for x in gone), text


def test_most_pages_do_without_class_names(monkeypatch):
    """With no class name known, articles are still found whole, and what is parted from them is still left out."""
    for name in ("FURNITURE_CLASSES", "FURNITURE_WHOLE"):
        monkeypatch.setattr(html_text, name, set())
    monkeypatch.setattr(html_text, "_doubt", html_text._doubt.__wrapped__)
    right = [all(x in (text := html_text.main_text(page)) for x in there) and not any(x in text for x in gone) for page, there, gone in DOUBTS]
    assert sum(right) >= 5
    assert all(x in html_text.main_text(page) for page, there, _ in DOUBTS for x in there)


def test_compound_class_names():
    furniture = ("user-comments", "commentlist", "cookieBanner", "cookie-notice", "site_footer", "relatedArticles", "nav-bar", "ShareButtons", "ad", "bottom")
    text = ("share-price", "commentary", "adult", "address", "noticeable", "article-body", "bottom-line", "navy", "additional")
    assert [x for x in furniture if html_text._doubt(x) != "furniture"] == [] and [x for x in text if html_text._doubt(x)] == []


def test_very_long_pages_in_small_blocks(spark):
    """100 pages of 5 MB: a block holds a few of them at a time."""
    page = F.concat(F.lit(f"<article><p>{DENSE}</p><!-- "), F.repeat(F.lit("x"), 5_000_000), F.lit("--><p>End.</p></article>"))
    df = spark.range(100).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), page.alias("html")).repartition(4)
    rows = html_text.extract(df).select("page_id", F.length("text").alias("n")).collect()
    assert len(rows) == 100 and len({r["n"] for r in rows}) == 1


@data
def test_the_distribution_decides(monkeypatch):
    """Without surge and dive the furniture of every page of the tables, marked or not, is in the text."""
    pages = [r[0] for r in duckdb.sql(f"select html from '{ROOT}/pages.parquet'").fetchall()]
    text = [html_text.main_text(x) for x in pages]
    monkeypatch.setattr(html_text, "_surging", lambda regions: range(len(regions)))
    assert all(html_text.main_text(x) != t for x, t in zip(pages, text, strict=True))
    unmarked = f"<div><p>{LONG}</p></div><div>Copyright</div>"
    assert "Copyright" in html_text.main_text(unmarked)


def test_extract_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "y"), (None, "v", "<p>" + "w " * 200_000, "z")], "page_id long, url string, html string, text string")
    rows = html_text.extract(df).collect()
    assert len(rows) == 4 and sorted(len(r["text"]) for r in rows)[0] == 0 and max(len(r["text"]) for r in rows) == 399_999
    assert html_text.extract(df.limit(0)).count() == 0


tokenizer = pytest.mark.skipif(not os.path.exists(token_spans.TOKENIZER), reason="no tokenizer files")


def brute_allot(start, end, sections, total, rule):
    bounds = [*sections, max(total, 1)]
    out = [0.0] * len(sections)
    for s, e in zip(start, end, strict=True):
        shares = [max(0, min(e, bounds[i + 1]) - max(s, bounds[i])) for i in range(len(sections))]
        first = next(i for i in range(len(sections)) if s < bounds[i + 1] or i == len(sections) - 1)
        if e <= s or rule == "start":
            out[first] += 1
        elif rule == "most":
            out[shares.index(max(shares))] += 1
        else:
            for i, x in enumerate(shares):
                out[i] += x / (e - s)
    return out


@tokenizer
@pytest.mark.parametrize("rule", token_spans.RULES)
def test_tokens_by_brute_force(rule):
    enc = token_spans.Encoder(open(token_spans.TOKENIZER, "rb").read())
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["a", "the ", "\n", "\n\n", " ", "é", "🙂", "ß12", "word"]) for _ in range(rng.randrange(40)))
        if not text:
            continue
        begin = token_spans.line_sections(text)
        s, e = enc.spans(text)
        assert (s <= e).all() and e[-1] == len(text)
        got = token_spans.allot(s, e, begin, len(text), rule)
        assert np.allclose(got, brute_allot(s, e, begin, len(text), rule)) and abs(got.sum() - len(s)) < 1e-9
        cuts = np.array([0, *sorted({rng.randrange(1, len(text) + 1) for _ in range(5)} - {len(text)})])
        assert np.allclose(token_spans.allot(s, e, cuts, len(text), rule), brute_allot(s, e, cuts, len(text), rule))


@tokenizer
def test_token_edges(spark):
    docs = documents(spark, ODD)
    rows = token_spans.section_tokens(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by) == len(ODD)
    assert all(abs(sum(r["n_tokens"] for r in v) - v[0]["doc_tokens"]) < 1e-6 for v in by.values())
    assert [by[i][0]["doc_tokens"] for i in (0, 1)] == [0, 0]
    assert token_spans.section_tokens(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        token_spans.section_tokens(docs, rule="none")

"""Quality rules, toxicity, co-trained quality, language, URL templates, HTML extraction and the pipeline."""

import html
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from labelwright.llm import cotrain, html_crf, langid, quality_rules, queries, toxicity, url_templates, winnow

FOLDER = "/root/testdata/sf0.01"
SPACES = r"[\x20\x09-\x0D]+"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas()


# Quality rules


def base_counts(text):
    text = text or ""
    words = [w for w in re.split(SPACES, text) if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
    windows = Counter(zip(words, words[1:], words[2:]))
    again = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))


TEXTS = [None, "", " \n\t", "a b c", "a b c a b c", "x " * 200, "one two three four " * 40, "a\n\na\n b\nb \n", "é|#<>&%$* x" * 60,
         " ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}X" for i in range(60)), "long " + " ".join(str(i) for i in range(20_000)), "\x0ba\x0cb\rc"]


def test_rules_table(spark, documents):
    got = {r.doc_id: r for r in queries.op2_quality_rules(spark, FOLDER).collect()}
    for d, text in zip(documents["doc_id"], documents["text"]):
        r, want = got[d], base_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_rules_keep_good_documents(spark, labels):
    got = queries.op2_quality_rules(spark, FOLDER).where("NOT base_failed").toPandas().merge(labels, on="doc_id")
    assert got[got["quality"] == 1]["kept"].all()
    assert not got[got["quality"] == 0]["kept"].any()


def test_rules_cases_and_any_order(spark):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, n int, words int")
    results = []
    for order in [None, list(quality_rules.RULES), list(quality_rules.RULES)[::-1]]:
        out = quality_rules.judged(df, order=order)
        results.append(rows(out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept")))
    assert results[0] == results[1] == results[2]
    assert [r[1:6] for r in sorted(results[0])] == [base_counts(t) for t in TEXTS * 2]
    assert quality_rules.judged(df.limit(0)).count() == 0


def test_rules_lines_of_form_feeds_and_of_f(spark):
    words = " ".join(f"w{i}" for i in range(60))
    texts = [words + "\n\x0c" * 9, words + "\nf" * 9, words + "\n f \x0c\nff", "\x0c\n\x0c", "f\nf"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = quality_rules.judged(df, order=list(quality_rules.RULES)).orderBy("row.doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got] == [base_counts(t) for t in texts]
    assert [r.n_full_lines for r in got] == [1, 10, 3, 0, 2] and [r.n_dup_lines for r in got] == [0, 8, 0, 0, 1]
    assert [r.kept for r in got] == [True, False, True, False, False]


def test_rules_order_is_by_rejection_per_cost(spark):
    df = spark.createDataFrame([(i, "some words here " * 30 + str(i)) for i in range(50)], "doc_id long, text string")
    never = {"never": "n_words < 0", "always": "n_words >= 0"}
    df = df.withColumn("text", F.concat(F.lit(" ".join(f"u{k}" for k in range(400))), "text"))
    assert quality_rules.measured_order(df, never) == ["always", "never"]


# Toxicity


def test_toxicity_table(spark, documents, labels):
    got = queries.op3_toxicity(spark, FOLDER).toPandas()
    assert len(got) == len(documents) and got["score"].between(0, 1).all()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert (got["predicted"] == (got["score"] >= 0.7)).all()
    held = got[got["held_out"]].merge(labels, on="doc_id")
    toxic = held["toxic"] == 1
    assert (held["predicted"][toxic] == 1).mean() > 0.6 and (held["predicted"][~toxic] == 0).mean() > 0.95


def test_non_negative_risk_recovers_the_posterior():
    rng = np.random.default_rng(0)
    positive = (rng.random((400, 6)) < [0.9, 0.8, 0.1, 0.1, 0.5, 0.5]).astype(np.float32)
    clean = (rng.random((3600, 6)) < [0.02, 0.02, 0.1, 0.1, 0.5, 0.5]).astype(np.float32)
    toxic = (rng.random((400, 6)) < [0.9, 0.8, 0.1, 0.1, 0.5, 0.5]).astype(np.float32)
    model = toxicity.PositiveUnlabelled(positive, np.concatenate([clean, toxic]), 0.1)
    score = lambda x: 1 / (1 + np.exp(-(x @ model.w + model.bias)))
    # One of the two signs alone (18 % of the toxic rows have only the first) is about even odds.
    assert (score(clean) < 0.5).mean() > 0.97 and (score(toxic) > 0.5).mean() > 0.7


@pytest.mark.parametrize("times", [5, 10])
def test_toxicity_of_enriched_labels(times):
    """The labels hold ``times`` the share of toxic texts that the unlabelled rows hold."""
    rng = np.random.default_rng(times)
    pick = lambda kind, n, k: [f"{kind}{i}{kind}" for i in rng.integers(0, n, k)]
    toxic = lambda: " ".join(pick("vile", 6, 2) + pick("edgy", 6, 2) + pick("w", 300, 20))
    clean = lambda: " ".join(pick("edgy", 6, int(rng.random() < 0.15)) + pick("w", 300, 20))
    prior, n = 0.2, 2000
    texts = [(toxic(), 1) for _ in range(200)] + [(toxic() if i < n * prior / times else clean(), 0) for i in range(n)]
    rows = pd.DataFrame([(f"{i}", t, y) for i, (t, y) in enumerate(texts)], columns=["doc", "text", "toxic"])
    model = toxicity.fit(rows, prior)
    assert all(toxicity.features_of(f"vile{i}vile".encode())[0] in model.index for i in range(6))
    score = lambda make: np.array(model.score([make() for _ in range(300)], toxicity.Weights(model.index)))
    assert (score(toxic) >= queries.TOXIC_FROM).mean() > 0.95 and np.median(score(clean)) < 0.5
    assert np.quantile(score(toxic), 0.05) > np.quantile(score(clean), 0.95)


def test_toxicity_cases(spark):
    texts = [None, "", "..", "plain words here", "you are a moron", "moron " * 50_000]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)] + [(None, "x", 0.1)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r[0] < 0.01 for r in toxicity.scored(docs, toxicity.train(docs, none)).select("score").collect()} == {True}
    learn = [(100 + i, f"w{i} w{i + 1} moron and more") for i in range(30)] + [(200 + i, f"w{i} w{i + 1} and more") for i in range(300)]
    learn += [(600 + i, f"w{i} moron w{i}") for i in range(15)]
    more = spark.createDataFrame(learn, "doc_id long, text string")
    marks = spark.createDataFrame([(100 + i, 1) for i in range(30)] + [(100, None), (None, 1), (101, 1)] + [(200 + i, 0) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.train(more, marks)
    got = {r.row.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    assert got[4] > 0.7 and got[5] > 0.7 and all(got[i] < 0.5 for i in (0, 1, 2, 3, None))
    assert toxicity.scored(docs.limit(0), model).count() == 0


# Co-training


def test_quality_table(spark, labels):
    got = queries.op5_quality_cotraining(spark, FOLDER).toPandas().merge(labels, on="doc_id")
    assert (got["kept"] == (got["quality"] == 1)).mean() > 0.98
    assert got[got["quality"] == 1]["kept"].mean() > 0.99


def test_quality_cases(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, 5), (2, "", "s", "en", None), (3, "THE!! END!! " * 40, "s", "en", 480), (4, "A calm and plain text. It goes on, as texts do. " * 9, "s", "en", 480),
         (4, "Again. With words, and more of them.", "t", "fr", 3), (None, "x y", None, "de", 3), (5, "w " * 60_000, "s", "xx", 120_000)],
        "doc_id long, text string, source string, lang string, score long")
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    kept = cotrain.keep_good(docs, nothing)
    assert kept.columns == docs.columns and rows(kept) == rows(docs)
    one_kind = spark.createDataFrame([(3, 1), (4, 1), (4, None)], "doc_id long, quality int")
    assert cotrain.keep_good(docs, one_kind).count() == docs.count()
    few = spark.createDataFrame([(3, 0), (4, 1), (4, None), (None, 0), (9, 1)], "doc_id long, quality int")
    scored = cotrain.scored(docs, few)
    assert scored.count() == docs.count()
    assert scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert cotrain.scored(docs.limit(0), few).count() == 0


def test_views_teach_each_other():
    """Few labels, many unlabelled rows: the weaker view gains from the other's pseudo-labels."""
    rng = np.random.default_rng(4)
    truth = rng.integers(0, 2, 900)
    text = truth[:, None] * 2.5 + rng.normal(size=(900, 4))
    meta = truth[:, None] * 0.9 + rng.normal(size=(900, 12))
    y = np.where(np.arange(900) < 60, truth, -1)
    held = np.arange(900) % 3 == 0
    model, alone = cotrain.CoTrained(text, meta, y, held), cotrain.CoTrained(text, meta, y, held, rounds=0)
    right = lambda m: ((m.models[1].margin(meta[60:]) > 0) == truth[60:]).mean()
    assert right(model) > right(alone)
    assert ((model.score(text, meta) > 0.5) == truth).mean() > 0.95


# Language


def test_language_table(spark, documents):
    got = queries.op8_language_id(spark, FOLDER).toPandas().merge(documents, on="doc_id")
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.98 and got["score"].between(0, 1).all()


def test_language_cases(spark):
    learn = [(i, "der die das und ist nicht " * 5 + str(i), "de") for i in range(40)]
    learn += [(100 + i, "the and of to is not that " * 5 + str(i), "en") for i in range(40)] + [(300, "zzz", None), (301, None, "en"), (None, "the", "en")]
    model = langid.train(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    texts = [None, "", "123 !?", "the of and", "und die das", "und nicht " * 100_000, "漢字"]
    docs = spark.createDataFrame([(i, t, "x", 0.0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, score double")
    got = [r.found for r in langid.identified(docs, model).orderBy("row.doc_id").collect()]
    assert [g.lang for g in got[:6]] == ["und", "und", "und", "en", "de", "de"]
    assert got[0].score == 0 and all(0 <= g.score <= 1 for g in got)
    empty = langid.train(docs.limit(0))
    assert {r.found.lang for r in langid.identified(docs, empty).collect()} == {"und"}
    assert langid.identified(docs.limit(0), model).count() == 0


def test_counts_do_not_depend_on_slices(monkeypatch):
    text = "Ein Satz mit Wörtern, der länger ist. " * 40
    whole = langid.gram_counts(text)
    for size in (7, 64, 1000):
        monkeypatch.setattr(langid, "SLICE", size)
        assert (langid.gram_counts(text) == whole).all()
    assert whole.sum() == 3 * len(text) - 3


# URL templates


def rule_of(host, path):
    fits = [r for r in queries.URL_RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


def parts_of(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (brute.lower(m[1]), m[2]) if m else ("", "")


def test_urls_table(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url").collect()
    got = {r.page_id: r for r in queries.op6_url_templates(spark, FOLDER).collect()}
    assert len(got) == len(pages)
    for p in pages:
        r, rule = got[p.page_id], rule_of(*parts_of(p.url))
        assert (r.host, r.path) == parts_of(p.url)
        assert r.rule == (rule[1] + rule[2] if rule else None)
        assert r.verdict == rule[0] if rule else r.verdict in ("allow", "block")


URLS = [None, "", "no scheme", "http://", "HTTP://A.Net", "http://a.net/x", "http://net/", "http://example.net/en/1", "http://x.example.net/en/1?q#f",
        "http://evilexample.net/en/1", "http://B.EXAMPLE.com/de/5", "http://b.example.com/de", "https://É.org/fr/1", "http://x.org?a=/fr/", "a://b://c/d", "http://u@h:80/p#?"]


def test_url_cases(spark):
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, path string")
    got = url_templates.judged(df, queries.URL_RULES).orderBy("row.page_id").collect()
    for r, u in zip(got, URLS * 2):
        rule = rule_of(*parts_of(u))
        assert (r.host, r.path, r.rule) == (*parts_of(u), rule[1] + rule[2] if rule else None)
    assert url_templates.judged(df.limit(0), queries.URL_RULES).count() == 0


def test_templates_generalise_merge_and_reject(spark):
    data = [("h", f"/spam/{i}", True) for i in range(9)] + [("h", "/spam/77", None), ("h", "/spam/88.html", None)]
    data += [("h", f"/news/{i}", False) for i in range(9)] + [("h", "/news/99", None), ("h", "/other", None)]
    # Names without number: many children become one template.
    data += [("g", f"/p/{a}{b}/x", True) for a, b in itertools.product("abcdefgh", "rstuv")] + [("g", "/p/unseen/x", None), ("g", "/q/unseen/x", None)]
    # Two labelled branches of one rate are merged, so that the thin one is judged by both.
    data += [("m", f"/s/{c}/{i}", True) for c in "ab" for i in range(2)] + [("m", "/s/b/x", None), ("k", "/a/b/c/d/e/f", None)]
    pages = spark.createDataFrame(data, "host string, path string, blocked boolean").repartition(3)
    bad = {(r.host, tuple(r["shape"])) for r in url_templates.rejected_shapes(pages).collect()}
    assert ("h", ("spam", "{n}")) in bad and ("h", ("news", "{n}")) not in bad and ("h", ("other",)) not in bad
    assert ("g", ("p", "unseen", "x")) in bad and ("g", ("q", "unseen", "x")) not in bad
    assert ("m", ("s", "b", "{n}")) in bad and ("k", ("a", "b", "c", "d", "**")) not in bad


# HTML extraction


def article_of(page):
    inner = re.search(r"(?s)<article>(.*?)(</article>|\Z)", page)[1]
    inner = re.sub(r"<(?:br|/?p|/?h1)>", " ", inner)
    return " ".join(html.unescape(re.sub(r"(?s)<[^>]*(>|\Z)", "", inner)).split())


def test_html_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = queries.op9_html_crf(spark, FOLDER).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.url == pages[r.page_id].url and r.text == article_of(pages[r.page_id].html) and r.n_chars == len(r.text)


@pytest.fixture(scope="module")
def field():
    return html_crf.fit([])


PAGES = [
    ("<html><body><div class='menu'>Home About</div><div class=content><p>Some long text of the story goes here.</p><p>And it goes on &amp; on.</p></div>"
     "<div id=comments><p>I agree with you all, as ever.</p></div></body>", "Some long text of the story goes here. And it goes on & on."),
    ("<article><p>wor<b>d</b> one<br>two&nbsp;three  four\n five<script>x</script><style>p{}</style></p><!-- no --><aside><p>Elsewhere on this site.</p></aside>"
     "<form><p>Your name here, please.</p></form><p>End &lt;here&gt;.", "word one two three four five End <here>."),
    ("<main><header><h1>Title</h1></header><p>Text of it.</p><div class='advertisement'>Buy this now.</div><section class='comments'><p>First!</p></section></main><footer>Foot of it.</footer>",
     "Title Text of it."),
    ("<nav><ul><li><a href=/>A</a></ul></nav><article><h1>T</h1><p>One.<p>Two.<ul><li>x<li>y</ul></article><div class='cookie-banner'>We use cookies.</div>", "T One. Two. x y"),
    (None, ""), ("", ""), ("<p>", ""), ("<!-- only", ""), ("<script>only", ""),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_html_cases(field, page, want):
    assert html_crf.main_text(field, page) == want


RAW_PAGES = [
    ("<script>for(e=0;e<t;e++)f()</script><p>Text", ["Text"]),
    ("<p>One</p><style>a<b{}</style><SCRIPT>if(a<b&&c<d)g('</p>')</SCRIPT ><p>Two", ["One", "Two"]),
    ("<script>x='<!--'</script><p>Text</p><!-- end -->", ["Text"]),
    ("<textarea><b</textarea><p>Text", ["Text"]), ("<svg><title>x</title><path d='a'/></svg><p>Text", ["Text"]),
    ("<html><head><title>t</title><meta charset=x><p>One<p>Two", ["One", "Two"]), ("<head><link rel=x>Bare text", ["Bare text"]),
    ("<head><title>t</head><body><p>Text", ["Text"]), ("<head><title>t<body><p>Text<svg><title>x</title></svg>", ["Text"]),
    ("<head><script>f(<b)<body><p>Text", ["Text"]), ("<head><script>w('</head><body>')</script></head><p>Text", ["Text"]),
    ("<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.", ["So x=1 holds."]),
    ("<object data=a><param name=b><p>Instead.</p></object>", ["Instead."]), ("<p>a</p><script>never", ["a"]),
]


@pytest.mark.parametrize("page, want", RAW_PAGES)
def test_html_raw_elements(page, want):
    assert [b.text for b in html_crf.blocks(page)] == want


def test_html_name_words_are_all_read(field):
    names = " ".join(f"u{chr(97 + i)}" for i in range(20))
    page = f"<main><p>Text of it.</p><div class='{names} px {names} advertisement'>Buy this now.</div></main>"
    where = html_crf.blocks(page)[1].where
    assert "name=advertisement" in where and len(where) == len(set(where)) == 25
    assert html_crf.main_text(field, page) == "Text of it."


def test_html_examples_are_learned(field):
    for page in html_crf.EXAMPLES:
        read = html_crf.blocks(page)
        assert field.decode(html_crf.features(read)) == [int(bool(b.keep)) for b in read]


def test_html_many_blocks_and_columns(spark, field):
    long = "<article>" + "".join(f"<p>Line {i} of it.</p>" for i in range(5000)) + "</article>"
    df = spark.createDataFrame([(1, long, "t", 3), (1, long, "t", 3), (2, None, "u", 4)], "page_id long, html string, text string, row int")
    got = html_crf.extracted(df, field).collect()
    assert sorted(len(r.text.split()) for r in got) == [0, 20_000, 20_000]
    assert html_crf.extracted(df.limit(0), field).count() == 0


def test_field_gradient_matches_brute_force():
    rng = np.random.default_rng(1)
    f = html_crf.Field()
    f.pair = rng.normal(size=(2, 2))
    scores = rng.normal(size=(6, 2))
    weight = {y: np.exp(sum(scores[i, k] for i, k in enumerate(y)) + sum(f.pair[a, b] for a, b in zip(y, y[1:])))
              for y in itertools.product((0, 1), repeat=6)}
    total = sum(weight.values())
    single, double = f.marginals(scores)
    for i in range(6):
        assert abs(single[i, 1] - sum(w for y, w in weight.items() if y[i] == 1) / total) < 1e-9
    assert abs(double[0, 1] - sum(w * sum(p == (0, 1) for p in zip(y, y[1:])) for y, w in weight.items()) / total) < 1e-9
    f.index, f.w = {f"{i}": i for i in range(6)}, scores
    assert tuple(f.decode([[str(i)] for i in range(6)])) == max(weight, key=weight.get)


# Pipeline


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]

    def run(name, df):
        path = str(tmp_path / name)
        steps[name](spark, df, FOLDER).write.parquet(path)
        return spark.read.parquet(path)

    good = run("quality_classifier", docs)
    assert good.columns == docs.columns
    pairs = [(r.doc_id, r.text) for r in good.collect()]
    lines = run("line_dedup", good)
    assert lines.columns == docs.columns
    want = {d: t for d, _, _, t in brute.line_dedup(pairs)}
    got = {r.doc_id: r for r in lines.collect()}
    assert {d: r.text for d, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())
    single = run("minhash_near_dedup", lines)
    assert single.columns == docs.columns
    assert {r.doc_id for r in single.collect()} == {c for _, c in brute.near(list(want.items()), 5).values()}
    clean = run("benchmark_decontamination", single)
    assert clean.columns == docs.columns
    left = [(r.doc_id, r.text) for r in single.collect()]
    assert {r.doc_id for r in clean.collect()} == {d for d, n, h, _ in brute.hits(left, items) if not (h and 20 * h >= n)}
    packed = [tuple(r) for r in run("best_fit_packing", clean).collect()]
    brute.check_packing([(r.doc_id, r.text) for r in clean.collect()], packed, queries.public_encoder(), 2048)
    assert winnow.WINDOW == 13

import random

import pytest
from pyspark.sql import functions as F

from linkgauge.llm import html_blocks, latent_leaks, secret_forest, url_trees


@pytest.fixture(scope="module")
def tree(spark):
    return html_blocks.fit(html_blocks.labelled_blocks(spark))


def text_of(spark, tree, page):
    pages = spark.createDataFrame([(1, "u", page, "x")], "page_id long, url string, html string, blocks string")
    return html_blocks.extract(pages, tree).first()["main_text"]


PROSE = "The ferry runs twice a day and takes an hour to reach the island when the wind is fair and the sea is calm"


@pytest.mark.parametrize("page,expected", [
    (f"<nav><a href=/>Home</a></nav><article><h1>Ferry &amp; sea</h1><p>{PROSE}<br>again<p>Yes.</article><footer>c</footer>", f"Ferry & sea\n{PROSE} again\nYes."),
    (f"<body><div class='cookie-banner'>{PROSE}</div><main><p>A  b\n c&nbsp;d</p><aside>{PROSE}</aside><p>{PROSE}</p></main><div id=comments><p>{PROSE}</div>", f"A b c d\n{PROSE}"),
    (f"<article><p>{PROSE}</p><script>var x='</p><p>no</p>'</script><style>p{{}}</style><form><p>{PROSE}</form><section class=comments><p>{PROSE}</section></article>", PROSE),
    (f"<div>Menu</div><p>{PROSE}</p><p>{PROSE} twice</p><ul><li><a href=a>One</a><li><a href=b>Two</a></ul>", f"{PROSE}\n{PROSE} twice"),
    (f"<article><p>&lt;b&gt; 1 &lt; 2 &#233;</p><!-- <p>no</p> --><p>{PROSE}</p></article>", f"<b> 1 < 2 é\n{PROSE}"),
    (f"<article><p hidden>no</p><p>{PROSE}</p>", PROSE),
    (None, ""), ("", ""), ("<html></html>", ""), ("<nav>Only a menu</nav>", ""),
])
def test_main_text(spark, tree, page, expected):
    assert text_of(spark, tree, page) == expected


@pytest.mark.parametrize("page", [
    f"<article><p>First.</p><script>for(i=0;i<n;i++){{x();}}</script><p>{PROSE}</p></article>",
    f"<article><p>First.</p><SCRIPT>if (a<b) y()</Script ><p>{PROSE}</p><script>z()</script></article>",
    f"<head><title>a <div> b</title><script>document.write('<div>x')</script></head><body><article><p>First.</p><p>{PROSE}</p></article>",
    f"<head><template><div>x</div></template><style>a>b{{}}</style><body><article><p>First.</p><p>{PROSE}</p></article>",
    f"<head><title>no end</head><body><article><p>First.</p><svg><style>a<b</style><title>x</title></svg><p>{PROSE}</p></article>",
    f"<article><p>First.</p><style>/* </stylex> <p> */</style/><textarea><p>x</textarea><p>{PROSE}</p></article>",
])
def test_raw_elements_end_at_their_own_end_tag(page):
    assert [text for text, _ in html_blocks.blocks_of(page)] == ["First.", PROSE]


def test_long_pages_are_whole(spark, tree):
    page = "<article>" + "".join(f"<p>{PROSE} number {i}</p>" for i in range(5000)) + "</article>"
    assert text_of(spark, tree, page) == "\n".join(f"{PROSE} number {i}" for i in range(5000))


def test_tree_on_pages_held_out(spark):
    """Trained without one labelled page, the tree still finds that page's article."""
    good = total = 0
    for left in range(len(html_blocks._PAGES)):
        rows = [(*f, float(t.startswith("1|"))) for k, p in enumerate(html_blocks._PAGES) if k != left for t, f in html_blocks.blocks_of(p)]
        tree = html_blocks.fit(spark.createDataFrame(rows, ", ".join(f"{f} double" for f in [*html_blocks.FEATURES, "label"])))
        for text, features in html_blocks.blocks_of(html_blocks._PAGES[left]):
            verdict = tree
            while not isinstance(verdict, float):
                verdict = verdict[2] if features[verdict[0]] <= verdict[1] else verdict[3]
            good, total = good + ((verdict > 0.5) == text.startswith("1|")), total + 1
    assert good / total >= 0.8


def _features(tree):
    return set() if isinstance(tree, float) else {html_blocks.FEATURES[tree[0]], *_features(tree[2]), *_features(tree[3])}


def _verdict(tree, features):
    while not isinstance(tree, float):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree > 0.5


def test_tree_asks_neighbours(tree):
    """On made pages that it was not fitted to it is right, and it takes what stands next to a block into account."""
    assert len(html_blocks.labelled_pages()) > 100
    assert _features(tree) >= {"prev_words", "next_words", "prev_links", "next_links", "words", "links"}
    hits = kept = wanted = 0
    for seed in range(10_000, 10_150):
        for text, features in html_blocks.blocks_of(html_blocks._made_page(seed)):
            is_article, said = text.startswith("1|"), _verdict(tree, features)
            hits, kept, wanted = hits + (is_article and said), kept + said, wanted + is_article
    assert hits / kept > 0.98 and hits / wanted > 0.98


@pytest.mark.parametrize("page,expected", [
    (f'<div id=main class="content no-sidebar has-ads"><p>{PROSE}</p></div>', PROSE),
    (f"<form id=aspnet><div><article><p>{PROSE}</p><p>{PROSE}</p></article></div><div>Log in</div></form>", f"{PROSE}\n{PROSE}"),
    (f"<form><label>Your mail</label><input></form><article><p>{PROSE}</p></article><form>Search this site</form>", PROSE),
    ("<article><p>Let <math><mi>x</mi></math> hold for all of them.</p></article>", "Let x hold for all of them."),
    (f"<article><p>{PROSE}</p><p>It held.</p></article><div class=cookie-notice>{PROSE}</div><div class=adSlot>Buy</div><div class=post-comments><p>{PROSE}</p></div>",
     f"{PROSE}\nIt held."),
])
def test_marks_are_whole_names(spark, tree, page, expected):
    """A class that tells of something elsewhere, a form around the page and formulas cost no article text."""
    assert text_of(spark, tree, page) == expected


def test_extra_columns_and_no_rows(spark, tree):
    pages = spark.createDataFrame([(1, "u", "<p>x", "y", "z")], "page_id long, url string, html string, main_text string, blocks string")
    out = html_blocks.extract(pages, tree)
    assert out.columns == ["page_id", "url", "main_text", "blocks", "_main_text"] and html_blocks.extract(pages.limit(0), tree).count() == 0


# --- URLs


@pytest.mark.parametrize("url,host,path,rule,verdict", [
    ("https://A.Example.org/es/1?x=/y", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/12#f", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/2", "notexample.org", "/es/2", "org/", "allow"),
    ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"), ("http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
    ("http://x.org", "x.org", "", None, None), ("nothing", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
])
def test_rules(spark, url, host, path, rule, verdict):
    row = spark.createDataFrame([(url,)], "url string").select(*url_trees.url_parts("url")).toDF("h", "p").select("h", "p", *url_trees.rule_of(F.col("h"), F.col("p"))).first()
    assert tuple(row) == (host, path, rule, verdict)


def test_url_trees_held_out(spark):
    rows = url_trees.labelled_urls(spark).orderBy(F.xxhash64(F.lit(3), "url")).collect()
    train, test = spark.createDataFrame(rows[18:]), spark.createDataFrame(rows[:18])
    out = url_trees.fit(train).block(test.withColumn("y", F.col("label")).drop("label")).collect()
    assert sum(r.block == (r.y == 1) for r in out) >= 15


def test_filter_keeps_rows_and_columns(spark):
    model = url_trees.fit(url_trees.labelled_urls(spark))
    pages = spark.createDataFrame([(1, None, "f"), (1, None, "f"), (2, "http://x.org/a", "f"), (3, "x" * 100_000, "f")], "page_id long, url string, f string")
    out = url_trees.filter_urls(pages.withColumn("prediction", F.lit(1)).withColumn("url_filter", F.lit(2)), model)
    assert out.columns == ["page_id", "url", "f", "prediction", "url_filter", "_url_filter"] and out.count() == 4
    assert all(r[-1].verdict in ("allow", "block") for r in out.collect())
    assert url_trees.filter_urls(pages.limit(0), model).count() == 0


# --- secrets


def test_forest_held_out(spark):
    language = secret_forest.Language(__import__("numpy").ones((26, 26)), ["the", "and", "river", "bridge", "water", "market", "house", "stone"])
    forest = secret_forest.fit(spark, secret_forest.labelled_findings(1), language)
    good, test = 0, secret_forest.labelled_findings(2, 300)
    for text, start, end, path, label in test:
        vector = __import__("pyspark.ml.linalg", fromlist=["Vectors"]).Vectors.dense(secret_forest.features(text, start, end, path, language))
        good += forest.predict(vector) == label
    assert good / len(test) >= 0.95


def test_scan(spark):
    key, digest = "04dbebab91ab85687d33eeaaf9ac699e1188f962", "9d71c1bf3e7a5dd8b2a0c4e6f8091a2b3c4d5e6f"
    texts = [f'the river token = "{key}" over', f"see commit {digest} for the bridge", None, "", "plain words only", f'é {"a" * 50_000} token = "{key}"', "call 4465758382889437 now"]
    docs = spark.createDataFrame([(i, t, "src1", 0.5) for i, t in enumerate(texts)] + [(0, texts[0], None, 0.5), (None, texts[0], "s", 0.5)], "doc_id long, text string, source string, probability double")
    found = secret_forest.scan(docs).collect()
    hits = [(r.doc_id, r.start, r.value) for r in found if r.is_secret]
    assert sorted(hits, key=repr) == sorted([(i, texts[i or 0].index(key), key) for i in (0, 0, None, 5)], key=repr)
    assert {r.doc_id for r in found} == {0, 1, 5, 6, None}
    assert secret_forest.scan(docs.limit(0)).count() == 0


# --- leaks


def leak_case(seed):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    common = [f"the{i}" for i in range(20)]
    sentence = lambda n: [draw.choice(common) if draw.random() < 0.5 else draw.choice(vocabulary) for _ in range(n)]
    items = [(i, sentence(draw.choice([15, 30, 60]))) for i in range(20)]
    docs, leaked = [], set()
    for k in range(300):
        words = sentence(draw.choice([20, 200, 900]))
        if k % 10 == 0:
            number, item = items[(k // 10) % 20]
            copy = list(item)
            if k % 20 == 0:  # a paraphrase: every sixth word another
                copy = [draw.choice(vocabulary) if j % 6 == 5 else w for j, w in enumerate(copy)]
            at = draw.randrange(len(words))
            words[at:at] = [w.upper() + "," if k % 30 == 0 else w for w in copy]
            leaked.add((k, number))
        docs.append((k, " ".join(words)))
    return docs, [(i, " ".join(w)) for i, w in items], leaked


def test_leaks(spark):
    docs, items, leaked = leak_case(1)
    rows = spark.createDataFrame([(k, t, 0, "w") for k, t in [*docs, (900, None), (901, ""), (902, "."), (None, items[3][1])]], "doc_id long, text string, k int, terms string").repartition(3)
    benchmark = spark.createDataFrame([*items, (50, None), (None, "x y"), (51, ""), items[0]], "item_id long, text string")
    found = [(r.k, r.item_id) for r in latent_leaks.leaks(rows, benchmark).collect()]
    assert len(found) == len(set(found)) and set(found) == leaked | {(None, 3)}
    kept = latent_leaks.without_leaks(rows, benchmark)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == {k for k, _ in docs} - {k for k, _ in leaked} | {900, 901, 902}
    assert latent_leaks.leaks(rows.limit(0), benchmark).count() == 0 and latent_leaks.leaks(rows, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_common_subsequence(seed):
    import numpy as np

    draw = random.Random(seed)
    a, b = [[draw.randint(0, 5) for _ in range(draw.randint(1, 90))] for _ in range(2)]
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    words = np.array(a)
    assert latent_leaks.common_subsequence(words, np.array(b), latent_leaks._bits(words)) == table[-1][-1]

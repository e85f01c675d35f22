"""URL filter: allow and block rules, then gradient-boosted trees on lexical features."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgauge.llm.text import spare_name

SEED = 7
ROUNDS, DEPTH = 20, 4
#: Production rules: (verdict, host and path prefix).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

# Labelled URLs, fixed values: 0 is a page to keep, 1 is advertising, tracking, spam, log-in or machine traffic.
LABELLED = """
0 https://www.harbourpost.example.com/news/2021/05/local-council-votes
0 https://blog.gardenpath.example.net/growing-tomatoes-indoors
0 http://encyclo.example.org/wiki/Photosynthesis
0 https://docs.pipeworks.example.org/en/stable/tutorial/
0 https://www.rivertown.example.net/history/bridges
0 http://museum.example.org/collection/4412
0 https://m.dailyletter.example.com/en/5301
0 https://kitchen.example.net/de/recipes/bread.html
0 http://lecture.example.edu/physics/week-3/notes.html
0 https://forum.example.org/t/how-to-sharpen-knives/2210
0 https://www.walkers.example.co.uk/routes/coast?page=2
0 https://tales.example.com/fr/825
0 https://tales.example.com/es/1204/
0 http://weather.example.net/en/forecast
0 https://science.example.org/articles/why-the-sky-is-blue
0 https://blog.maple.example.com/en/4318#top
0 http://townhall.example.gov/minutes/2019/march.html
0 https://www.library.example.edu/catalog/subject/botany
0 https://reviews.example.net/books/the-long-road
0 http://chess.example.org/openings/sicilian
0 https://www.cyclist.example.com/en/9149?utm_source=feed
0 https://letters.example.net/de/6956?utm_source=feed
0 https://essays.example.org/on-reading
0 http://m.times.example.net/fr/8033#top
0 https://www.northern.example.com/en/7638/
0 https://birds.example.org/species/wren.html
0 http://poems.example.com/es/7160?page=2&ref=x
0 https://howto.example.net/fix-a-leaking-tap
0 https://news.example.co.uk/politics/2020/11/budget-report
0 https://www.orchard.example.com/about
0 https://travel.example.org/en/lisbon-in-three-days
0 http://health.example.gov/advice/sleep
0 https://www.music.example.net/interviews/string-quartet
0 https://code.example.org/projects/parser/readme
0 https://m.village.example.com/de/1673?page=2&ref=x
0 http://archive.example.edu/maps/1890/index.html
0 https://food.example.net/en/6383
0 https://stories.example.com/chapter-12
0 https://www.builders.example.org/guides/roofing
0 http://tide.example.com/en/2801
1 http://ads-serve.example.com/click?id=8837261&cid=991827&pub=4412&r=0.82731
1 https://track.example.net/pixel.gif?uid=9f8a7b6c5d4e3f21&ts=1623847261&ev=view
1 http://x7k2q9z.example.biz/a8d7f/9921/00182/index.php?sid=a9d8f7e6
1 https://casino-bonus-888.example.info/play-now/free-spins/?aff=20391
1 http://cheap-pills-4u.example.info/buy?item=5512&ref=77812&c=1
1 https://adserver.example.com/banner/728x90/9918273645.html?click=1&zone=33
1 http://192-0-2-17.example.net/login.php?next=%2Faccount%2Fverify&token=88d7e6
1 https://win-prize-2021.example.top/claim/?user=19283746&code=77218
1 http://q8w7e6r5t4.example.xyz/p/0/1/2/3/4/5/6
1 https://m.ads-track.example.com/en/9823
1 https://metrics.example.io/collect?v=1&tid=UA-1928374-1&cid=555&t=pageview&dp=%2F
1 http://free-download-full-version.example.click/get.php?f=setup_128371.exe
1 https://redirect.example.net/r?u=http%3A%2F%2Fother.example%2F&k=91827364
1 http://bet365x24.example.bet/live/1029384/odds?lang=en&promo=88123
1 https://login-secure-update.example.info/verify/account/8827319/confirm
1 http://popunder.example.com/serve?zid=1827364&rnd=0.9182736455
1 https://cdn-ads.example.net/banner.js?cb=17263549182736
1 http://hot-singles-4you.example.date/join?src=918273&sub=77
1 https://syndication.example.com/feed.php?pid=8827&subid=12x34&w=300&h=250
1 http://z9y8x7.example.xyz/?k=1827364556&m=991
1 https://trk.example.click/c/9a8b7c6d5e4f/1/?s1=8812&s2=77&s3=0
1 http://loan-fast-cash.example.loan/apply?id=99182&src=mail&c=88
1 https://beacon.example.io/b?e=00018273645&d=81726354
1 http://m.adtracker.example.net/de/77182
1 https://affiliate.example.biz/go/918273/8817/
1 http://popads.example.info/a/b/c/d/88127364.html
1 https://xxx-cams-777.example.cam/room/8819273?ref=1123
1 http://coupon-spam-99.example.top/deal/11882277/?x=1&y=2&z=3
1 https://ads.example.com/impression/55443322/1/2/3?cb=9988
1 http://7a6b5c4d3e2f.example.xyz/dl/0f1e2d3c4b5a.html
1 https://click.example.link/?a=1827&c=99182&s1=aa11bb22
1 http://sponsor-track.example.com/en/33
1 https://m.click-ads.example.org/fr/5
1 http://ads-network.example.net/en/100?page=2&ref=x
"""

FEATURES = ["length", "host_length", "depth", "digits", "entropy", "parameters", "host_digits", "host_hyphens", "host_ads", "labels", "suffix_bad"]


def url_parts(url: str | Column) -> tuple[Column, Column]:
    """(host, path): empty for null or without ``://``; the host's A-Z in lower case."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    found = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, start = rule.partition("/")
        at_host = (host == name) | host.endswith("." + name)
        found.append((at_host & path.startswith("/" + start), rule, verdict))
    def first(k: int) -> Column:
        return F.coalesce(*[F.when(hit, F.lit((rule, verdict)[k])) for hit, rule, verdict in found])
    return first(0), first(1)


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def lexical(df: DataFrame, url: str, suffix_rates: dict[str, float], prior: float) -> DataFrame:
    """``df`` with a struct column ``f`` of the lexical features of ``url``; null counts as empty."""
    text = F.coalesce(F.col(url), F.lit(""))
    host, path = url_parts(url)
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    size = F.length(text)
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]", ""))
    counts = F.aggregate(
        F.array_distinct(F.split(text, "")), F.lit(0.0),
        lambda total, ch: total - F.when(ch == "", 0.0).otherwise(_plogp((size - F.length(F.replace(text, ch, F.lit("")))) / size)))
    rates = [F.when(suffix(host) == name, F.lit(rate)) for name, rate in sorted(suffix_rates.items())]
    values = [size, F.length(host), F.size(F.filter(F.split(path, "/"), lambda x: x != "")), F.when(size > 0, digits(text) / size).otherwise(0.0),
              F.when(size > 0, counts).otherwise(0.0), F.size(F.filter(F.split(query, "&"), lambda x: x != "")), digits(host),
              F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))),
              F.rlike(host, F.lit(r"(^|[.-])(ads?|adserver|adtracker|track|trk|click|pixel|banner|pop\w*|sponsor)([.-]|$)")).cast("double"),
              F.size(F.split(host, r"\.")), F.coalesce(*rates, F.lit(prior))]
    return df.withColumn("f", F.struct(*[v.cast("double").alias(n) for n, v in zip(FEATURES, values, strict=True)]))


def _plogp(p: Column) -> Column:
    return F.when(p > 0, p * F.log2(p)).otherwise(0.0)


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = [line.split(" ", 1) for line in LABELLED.strip().splitlines()]
    return spark.createDataFrame([(u, float(y)) for y, u in rows], "url string, label double")


class UrlModel:
    """Trees and the suffix statistics (smoothed share of blocked URLs for each suffix) they were fitted with."""

    def __init__(self, trees: PipelineModel, rates: dict[str, float], prior: float):
        self.trees, self.rates, self.prior = trees, rates, prior

    def block(self, df: DataFrame, url: str = "url") -> DataFrame:
        """``df`` (no columns named f, features, rawPrediction, probability, prediction) with block boolean."""
        flat = lexical(df, url, self.rates, self.prior)
        flat = flat.select("*", *[F.col("f")[n].alias(f"f_{n}") for n in FEATURES])
        scored = self.trees.transform(flat)
        return scored.select(*df.columns, (F.col("prediction") > 0.5).alias("block"))


def fit(labelled: DataFrame, max_rows: int = 100_000, seed: int = SEED) -> UrlModel:
    """Fit on (url, label 1 block / 0 allow). ``max_rows`` bounds the training table: more labelled rows
    are thinned by a hash of the URL."""
    labelled = labelled.where(F.col("url").isNotNull() & F.col("label").isin(0.0, 1.0))
    rows = labelled.count()
    if rows > max_rows:
        labelled = labelled.where(F.pmod(F.xxhash64("url"), F.lit(1_000_003)) < int(1_000_003 * max_rows / rows))
    host, _ = url_parts("url")
    stats = labelled.groupBy(suffix(host).alias("s")).agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "s").limit(200).collect()
    total, bad = sum(r.n for r in stats), sum(r.bad for r in stats)
    prior = bad / total
    # ten rows of prior keep a suffix that was seen a few times near the mean
    rates = {r.s: (r.bad + 10 * prior) / (r.n + 10) for r in stats}
    table = lexical(labelled, "url", rates, prior).select("label", *[F.col("f")[n].alias(f"f_{n}") for n in FEATURES]).coalesce(1)
    steps = [VectorAssembler(inputCols=[f"f_{n}" for n in FEATURES], outputCol="features"),
             GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, seed=seed, minInstancesPerNode=2)]
    return UrlModel(Pipeline(stages=steps).fit(table), rates, prior)


def filter_urls(pages: DataFrame, model: UrlModel, url: str = "url", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Every row of ``pages`` with ``url_filter``: struct of host, path, rule, verdict.

    The longest rule that fits decides; the trees decide the rest. A null url has empty host and path
    and is judged as an empty text. Rows and other columns stay as they are.
    """
    name = spare_name(pages, "url_filter")
    whole = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("__row")
    host, path = url_parts(F.col("__url"))
    rule, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    scored = model.block(pages.select(whole, F.col(url).alias("__url")), "__url")
    parts = scored.withColumn("__host", host).withColumn("__path", path)
    return parts.select("__row.*", F.struct(
        F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("block"), "block").otherwise("allow")).alias("verdict")).alias(name))


__all__ = ["fit", "filter_urls", "labelled_urls", "UrlModel", "url_parts", "rule_of", "RULES"]

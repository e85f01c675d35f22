"""Quality rules from line frequency across documents.

Lines are hashed, distinct documents are counted per host and line. Lines in more documents than a share of
their host's are boilerplate; of long lines the first occurrence stays. A document is rejected when it fails the base rules or when little
is left of it without boilerplate. Everything is DataFrame functions; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgauge.llm.text import WHITE, spare_name, text_key
from linkgauge.operators.joining import null_safe_join
from linkgauge.session import materialize

# Production limits
MAX_DOCS = 20  # distinct texts of a host that may share a line, however small the host
MAX_PERCENT = 4  # of the host's distinct texts that may share a line: 20 of 500
MAX_LINE_WORDS = 20  # of longer boilerplate lines one copy stays
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_LEFT_PERCENT = 30
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda variable is not evaluated again."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), "")


def _line_words(line: Column) -> Column:
    return F.size(words_of(line))


def _covered(starts: Column, width: int) -> Column:
    """Positions that windows of ``width`` at the sorted ``starts`` cover."""
    gaps = F.transform(
        F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), lambda s, i: F.least(s - F.get(starts, i), F.lit(width))
    )
    return F.aggregate(gaps, F.lit(width), lambda total, gap: total + gap)


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words in windows that occur twice or more, the first occurrence included."""

    def positions(hashes: Column) -> Column:
        at = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(at, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])), lambda x: x["i"])))

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            _let(positions(hashes), lambda starts: _covered(starts, width)))

    def windows(w: Column) -> Column:
        return F.transform(
            F.slice(w, width, F.greatest(F.size(w) - width + 1, F.lit(0))),
            lambda last, i: F.xxhash64(*[F.get(w, i + k) for k in range(width - 1)], last))

    return _let(words, lambda w: _let(windows(w), count)).cast("long")


def text_counts(text: Column) -> Column:
    """One struct: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. All 0 for null."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, WHITE, "")) > 0)
    return _let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
    ))


def line_key(line: Column) -> Column:
    """128-bit hash of a normalised line: A-Z in lower case, white space runs as one space."""
    plain = F.translate(F.array_join(words_of(line), " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return _let(plain, lambda p: F.struct(F.xxhash64(p).alias("a"), F.xxhash64(F.lit(7), p).alias("b")))


def _text_struct(text: str) -> Column:
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(text_key(text))])


def document_lines(docs: DataFrame, text: str, host: str, most_words: int | None) -> DataFrame:
    """A row for each distinct line (of up to ``most_words`` words) of each distinct (host, text): host, key, line, words."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    return (
        docs.where(F.col(text).isNotNull())
        .select(F.col(host).alias("host"), _text_struct(text).alias("key"), F.explode(lines).alias("line"))
        .withColumn("words", _line_words(F.col("line")))
        .where(F.lit(True) if most_words is None else F.col("words") <= most_words)
        .groupBy("host", "key", line_key(F.col("line")).alias("line"), "words")
        .agg(F.min(F.lit(1)).alias("one"))
        .drop("one")
    )


def frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", max_docs: int = MAX_DOCS,
                   max_percent: float = MAX_PERCENT, most_words: int | None = None) -> DataFrame:
    """Boilerplate: host, line (hash), n_docs, first (hash of the text that comes first), for lines in more than
    ``max_docs`` texts of a host and more than ``max_percent`` of them.

    Copies of a text count once. Rows are distinct per text before they are counted, and counts are
    partial before the shuffle, so a line in a third of all documents moves one row a task. Texts have one
    order for all lines, so what many of them share stays together in the first.
    """
    often = (
        document_lines(docs, text, host, most_words).groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min("key.k0").alias("first")).where(F.col("n_docs") > max_docs)
    )
    if not max_percent:
        return often
    texts = docs.where(F.col(text).isNotNull()).select(F.col(host).alias("h"), *text_key(text)).distinct()
    hosts = texts.groupBy("h").agg(F.count(F.lit(1)).alias("n_texts"))
    shared = often.join(hosts, F.col("host").eqNullSafe(F.col("h")))
    return shared.where(100 * F.col("n_docs") > max_percent * F.col("n_texts")).select(often.columns)


def removed_lines(docs: DataFrame, text: str, host: str, max_docs: int, max_percent: float, max_line_words: int, long_lines: bool) -> DataFrame:
    """host, key (of the text), lines: the boilerplate hashes to be removed from each distinct (host, text)."""
    most_words = None if long_lines else max_line_words
    lines = document_lines(docs, text, host, most_words).alias("l")
    often = frequent_lines(docs, text, host, max_docs, max_percent, most_words).alias("f")
    same = F.col("l.host").eqNullSafe(F.col("f.host")) & (F.col("l.line") == F.col("f.line"))
    stays = (F.col("l.words") > max_line_words) & (F.col("l.key.k0") == F.col("f.first"))
    return (
        lines.join(often, same).where(~stays).select("l.host", "l.key", "l.line")
        .groupBy("host", "key").agg(F.collect_list("line").alias("lines"))
    )


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_docs: int = MAX_DOCS,
          max_line_words: int = MAX_LINE_WORDS, min_left_percent: int = MIN_LEFT_PERCENT,
          max_percent: float = MAX_PERCENT, long_lines: bool = True) -> DataFrame:
    """Every row of ``docs`` with its counts, verdict and cleaned text.

    Adds a struct column ``quality``: the counts of ``text_counts``, n_removed_words, base_failed,
    kept, clean_text (without boilerplate lines; null for null). Other columns, whatever their names,
    stay; repeated rows each stay with one verdict; a null host is a host of its own; null or empty
    texts have no words and fail; an empty table gives an empty result. Lines of more than ``max_line_words``
    words stay in the first text that has them; without ``long_lines`` they stay in all.
    """
    name = spare_name(docs, "quality")
    gone = removed_lines(docs, text, host, max_docs, max_percent, max_line_words, long_lines).select(
        F.col("host").alias("__h"), F.col("key").alias("__k"), F.col("lines").alias("__gone"))
    joined = docs.withColumn("__key", _text_struct(text)).join(
        gone, F.col(host).eqNullSafe(F.col("__h")) & (F.col("__key") == F.col("__k")), "left")
    hit = lambda line: F.array_contains(F.col("__gone"), line_key(line))
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    out = F.filter(lines, lambda line: (F.length(F.translate(line, WHITE, "")) > 0) & hit(line))
    lost = F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(
        F.aggregate(out, F.lit(0), lambda total, line: total + _line_words(line))).cast("long")
    clean = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(F.filter(lines, lambda x: ~hit(x)), "\n"))
    counts = joined.withColumn("__counts", text_counts(F.col(text))).withColumn("__lost", lost)
    c = lambda k: F.col("__counts")[k]
    failed = (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))
    depleted = 100 * (c("n_words") - F.col("__lost")) < min_left_percent * c("n_words")
    return counts.withColumn(name, F.struct(
        *[c(k).alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("__lost").alias("n_removed_words"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
        clean.alias("clean_text"))).select(*docs.columns, name)


def verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS,
             max_line_words: int = MAX_LINE_WORDS, min_left_percent: int = MIN_LEFT_PERCENT, max_percent: float = MAX_PERCENT) -> DataFrame:
    """The verdicts of ``judge`` without cleaned texts: the columns of ``docs`` but its text, and a struct ``quality``.

    Counts are made where a text is read, lines leave as hashes, and what a text loses is summed over its lines: no
    text is shuffled. A line of more than ``max_line_words`` words stays in the text whose ``key`` is least (null last,
    then by hash). Copies of a text in a host count once and get one verdict; a null host is a host of its own; null
    and empty texts have no words and fail; repeated rows each stay; columns of any name stay.
    """
    name = spare_name(docs, "quality")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    narrow = docs.select(F.struct(*rest).alias("row"), F.col(host).alias("host"), _text_struct(text).alias("key"), text_counts(F.col(text)).alias("c"))
    given = docs.where(F.col(text).isNotNull())
    split = F.filter(F.split(F.col(text), "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    at = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"))
    lines = given.select(F.col(host).alias("host"), _text_struct(text).alias("key"), at.alias("at"), F.explode(split).alias("line"))
    lines = materialize(lines.groupBy("host", "key", line_key(F.col("line")).alias("line"), _line_words(F.col("line")).alias("words")).agg(
        F.min("at").alias("at"), F.count(F.lit(1)).alias("times")), "lines")
    texts = materialize(given.select(F.col(host).alias("host"), _text_struct(text).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("copies")), "texts")
    often = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("at", "key.k0")).alias("first")).where(F.col("n_docs") > max_docs)
    often = null_safe_join(often, texts.groupBy("host").agg(F.count(F.lit(1)).alias("n_texts")), ["host"])
    often = materialize(often.where(100 * F.col("n_docs") > max_percent * F.col("n_texts")).select("host", "line", "first"), "often")
    stays = (F.col("words") > max_line_words) & (F.struct("at", "key.k0") == F.col("first"))
    total = null_safe_join(lines, often, ["host", "line"]).where(~stays).groupBy("host", "key").agg(F.sum(F.col("times") * F.col("words")).alias("total"))
    lost = null_safe_join(total, texts, ["host", "key"]).select("host", "key", F.expr("total div copies").alias("lost"))
    told = null_safe_join(narrow, lost, ["host", "key"], "left").withColumn("lost", F.coalesce("lost", F.lit(0)))
    c = lambda k: F.col("c")[k]
    failed = (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))
    depleted = 100 * (c("n_words") - F.col("lost")) < min_left_percent * c("n_words")
    return told.select("row", F.struct(
        *[c(k).alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("lost").alias("n_removed_words"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept")).alias("q")).select("row.*", F.col("q").alias(name))

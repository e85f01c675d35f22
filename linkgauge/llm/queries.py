"""The operators as queries over the given tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgauge.llm import html_blocks, latent_leaks, line_frequency, line_windows, mixing, packing, prefix_join, prefix_trie, secret_forest, shuffle_matrix, spelling, training_order, url_trees
from linkgauge.llm.tokens import default_tokenizer
from linkgauge.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.scan(table(spark, sf_dir, "documents"))


def op2_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = latent_leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("k").alias("doc_id"), "item_id", "cosine", "common", "answer", "start")


def op3_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


VERDICTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words"]


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of the pipeline: lines of every length in more than 20 texts and 4 % of the host's texts."""
    judged = line_frequency.verdicts(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return judged.select("doc_id", *[F.col("quality")[n].alias(n) for n in VERDICTS])


def op5_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = html_blocks.fit(html_blocks.labelled_blocks(spark))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    text = F.col("main_text")
    return html_blocks.extract(pages, tree).select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise(table(spark, sf_dir, "documents"), default_tokenizer(), scratch_path(spark, "shards"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), default_tokenizer()).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_windows.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed_lines")


def op9_communication_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    return shuffle_matrix.shuffle_rows(sized, 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_trees.fit(url_trees.labelled_urls(spark))
    return url_trees.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), model).select("page_id", "url_filter.*")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(sized).select("doc_id", "size", *[F.col("mix")[c].alias(c) for c in ("source_size", "target", "taken", "copies")])


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(table(spark, sf_dir, "documents"), change=lambda run: spelling.misspelt(run, F.col("doc_id"), 199))
    return spelling.spelling_variants(words)


QUERIES = {f.__name__: f for f in (op1_secret_forest, op2_latent_leaks, op3_grouped_prefix_join, op4_line_frequency, op5_text_blocks, op6_training_order, op7_best_fit_packing, op8_line_windows, op9_communication_matrix, op10_url_trees, op11_prefix_trie, op12_systematic_mix, op13_spelling_variants)}

OP4_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, text IS NULL AS absent FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM d),
c AS (SELECT *, len(words) AS n_words,
        list_transform(generate_series(1, len(words) - 2), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS grams,
        list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS full_lines FROM w),
texts AS (SELECT DISTINCT text, words, grams FROM c),
g AS (SELECT text, unnest(grams) AS gram, unnest(generate_series(1, len(grams))) AS pos FROM texts),
often AS (SELECT text, gram FROM g GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT text, count(DISTINCT pos + k) AS n_repeat_words FROM g JOIN often USING (text, gram), range(3) r(k) GROUP BY text),
l AS (SELECT DISTINCT source, text, array_to_string(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'), ' ') AS raw
      FROM (SELECT source, text, unnest(full_lines) AS x FROM c WHERE NOT absent)),
n AS (SELECT source, text, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line,
      len(string_split(raw, ' ')) AS words FROM l),
own AS (SELECT source, text, min(doc_id) AS doc_id FROM c WHERE NOT absent GROUP BY ALL),
every AS (SELECT DISTINCT * FROM n),
hosts AS (SELECT source, count(*) AS n_texts FROM own GROUP BY source),
boiler AS (SELECT e.source, e.line, min(own.doc_id) AS first FROM every e
      JOIN own ON e.source IS NOT DISTINCT FROM own.source AND e.text = own.text JOIN hosts h ON e.source IS NOT DISTINCT FROM h.source
      GROUP BY e.source, e.line, h.n_texts HAVING count(*) > 20 AND 100 * count(*) > 4 * h.n_texts),
lines AS (SELECT source, text, translate(array_to_string(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line
      FROM (SELECT source, text, unnest(full_lines) AS x FROM (SELECT DISTINCT source, text, full_lines FROM c WHERE NOT absent))),
lost AS (SELECT s.source, s.text, sum(len(string_split(s.line, ' '))) AS n
      FROM lines s JOIN boiler b ON s.source IS NOT DISTINCT FROM b.source AND s.line = b.line
      JOIN own ON s.source IS NOT DISTINCT FROM own.source AND s.text = own.text
      WHERE NOT (len(string_split(s.line, ' ')) > 20 AND own.doc_id = b.first) GROUP BY ALL),
r AS (SELECT c.doc_id, c.n_words::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(c.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines,
        coalesce(v.n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_removed_words
      FROM c LEFT JOIN covered v ON c.text = v.text LEFT JOIN lost ON c.source IS NOT DISTINCT FROM lost.source AND c.text = lost.text)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT 100 * (n_words - n_removed_words) < 30 * n_words AS kept,
  n_removed_words
FROM r
"""

OP8_SQL = """
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS pos FROM d),
f AS (SELECT *, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l WHERE regexp_matches(raw, '[^\\x20\\x09-\\x0D]')),
w AS (SELECT doc_id, text, line AS a, pos, lead(line, 1) OVER o AS b, lead(line, 2) OVER o AS c, lead(pos, 1) OVER o AS pos1, lead(pos, 2) OVER o AS pos2
      FROM f WINDOW o AS (PARTITION BY doc_id, text ORDER BY pos)),
n AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id NULLS LAST, text, pos) AS k FROM w WHERE c IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, text, unnest([pos, pos1, pos2]) AS pos FROM n WHERE k > 1),
kept AS (SELECT l.doc_id, l.text, coalesce(string_agg(l.raw, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL), '') AS clean,
      count(gone.pos) AS n_removed_lines
      FROM l LEFT JOIN gone ON l.doc_id IS NOT DISTINCT FROM gone.doc_id AND l.text = gone.text AND l.pos = gone.pos GROUP BY ALL)
SELECT s.doc_id, kept.clean AS text, coalesce(kept.n_removed_lines, 0) AS n_removed_lines
FROM documents s LEFT JOIN kept ON s.doc_id IS NOT DISTINCT FROM kept.doc_id AND s.text = kept.text
"""

OP12_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
o AS (SELECT *, 3 * sum(source_size) OVER o - 3 * source_size AS capped, sum(w) OVER () - sum(w) OVER o + w AS shares, sum(source_size) OVER () AS total, row_number() OVER o AS k
      FROM w WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT * FROM o WHERE (total - capped) * w <= 3 * source_size * shares ORDER BY k LIMIT 1),
t AS (SELECT o.source, o.source_size,
      CASE WHEN o.k < f.k THEN (3 * o.source_size)::DOUBLE ELSE ((f.total - f.capped) * o.w)::DOUBLE / f.shares::DOUBLE END AS target FROM o, f),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size * 4294967296) END::HUGEINT AS step,
      ('0x' || substr(md5('1:' || coalesce(source, '')), 1, 8))::HUGEINT AS first FROM t),
r AS (SELECT d.doc_id, d.size, e.source_size, e.target, step, first, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS i
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
c AS (SELECT *, (((i + 1) * step + first) // 4294967296 - (i * step + first) // 4294967296)::BIGINT AS copies FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""

SQL = {"op12_systematic_mix": OP12_SQL, "op4_line_frequency": OP4_SQL, "op8_line_windows": OP8_SQL}

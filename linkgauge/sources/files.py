"""Finding and reading raw tabular files of several formats."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkgauge.functions.numeric import FLOATING, MISSING_TOKENS, finite
from linkgauge.session import materialize

# File suffixes that are read.
SUFFIXES = ["csv", "tsv", "txt", "json", "jsonl", "ndjson", "parquet"]
# bytes in which the first line of a delimited file must end
HEADER_BYTES = 1 << 20
SEPARATORS = {"csv": ",", "tsv": "\t", "txt": "\t"}

LISTING_SCHEMA = "path string, length long, suffix string, dataset string"
PROBE_SCHEMA = "path string, header string, error_type string, error_message string"


def located(path: str):
    """(Arrow file system, path inside it) of a path as Spark tells it, for use in tasks."""
    import pyarrow.fs as pafs

    if "://" not in path:
        return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return pafs.FileSystem.from_uri(quote(path, safe=":/%@"))


def _suffix(path):
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def discover(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """Supported files below a folder (or the file itself) with size, suffix and dataset name.

    Only the listing is read: the file content column is pruned away. Scans leave out files without a byte; they are
    taken from the listing that the scan was planned with.
    """
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    planned = spark.createDataFrame([(unquote(re.sub(r"^file:/+", "file:/", path)),) for path in scan.inputFiles()], "path string")
    empty = planned.join(scan, "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"))
    listed = scan.unionAll(empty).withColumn("suffix", _suffix(F.col("path")))
    for text in exclude or []:
        if text:
            listed = listed.filter(~F.contains(F.col("path"), F.lit(text)))
    found = with_dataset(listed.filter(F.col("suffix").isin(SUFFIXES)), root).orderBy("path")
    if not found.head(1):
        raise FileNotFoundError(f"no supported dataset files found in {root}")
    return found


def with_dataset(df: DataFrame, root: str, path_column: str = "path") -> DataFrame:
    """Dataset = first folder below the root, else the root's name, else the file's stem."""
    clean = re.sub(r"^file:/*", "/", root).rstrip("/")
    path = F.regexp_replace(F.col(path_column), r"^file:/+", "/")
    inside = F.substr(path, F.lit(len(clean) + 2))
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    name = (
        F.when(path == clean, stem)
        .when(F.contains(inside, F.lit("/")), F.split(inside, "/").getItem(0))
        .otherwise(F.lit(clean.rsplit("/", 1)[-1]))
    )
    return df.withColumn("dataset", name)


def probe(files: DataFrame, limit: int = HEADER_BYTES) -> DataFrame:
    """First line of each delimited file and whether a Parquet file has a readable footer.

    Runs in tasks, at most ``limit`` bytes per file, so one bad file becomes one error row.
    """

    def inspect(batches):
        import pandas as pd
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for path, suffix in zip(batch["path"], batch["suffix"]):
                header, kind, message = None, None, None
                try:
                    filesystem, inner = located(path)
                    if suffix == "parquet":
                        with filesystem.open_input_file(inner) as handle:
                            pq.read_metadata(handle)
                    elif suffix in ("csv", "tsv", "txt"):
                        with filesystem.open_input_stream(inner) as handle:
                            data = handle.read(limit)
                        if b"\n" not in data and len(data) >= limit:
                            raise ValueError(f"no end of the first line in {limit} bytes")
                        header = data.split(b"\n", 1)[0].decode("utf-8", "replace").strip("\r﻿")
                        if not header:
                            kind, message = "EmptyDataError", "No columns to parse from file"
                except Exception as error:
                    kind, message = type(error).__name__, str(error)
                rows.append((path, header, kind, message))
            yield pd.DataFrame(rows, columns=["path", "header", "error_type", "error_message"])

    return files.select("path", "suffix").mapInPandas(inspect, PROBE_SCHEMA)


def split_header(header: str, sep: str) -> list[str]:
    """Column names of a header line, quotes respected, outer spaces removed."""
    import csv

    names = next(csv.reader([header], delimiter=sep))
    return [name.strip() for name in names]


def scan_delimited(
    spark: SparkSession, paths, names: list[str], sep: str = ",", header: bool = True, source_file: str | None = None
) -> DataFrame:
    """Delimited text, all columns as text. Long rows are skipped, short rows padded with NULL.

    The reader flags both kinds as corrupt, so the separators outside quotes are counted on the
    flagged rows only. Bytes that are not UTF-8 arrive as the replacement character.
    ``source_file`` names a column to hold the file name.
    """
    fields = [f"f{i}" for i in range(len(names))]
    schema = ", ".join(f"{name} string" for name in fields) + ", _bad string"
    raw = (
        spark.read.schema(schema)
        .option("header", str(header).lower()).option("sep", sep).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad").option("enforceSchema", "true")
        .option("quote", '"').option("escape", '"')
        # a pruned parse would not notice that a row is too long
        .option("columnPruning", "false")
        .csv(paths)
    )
    unquoted = F.regexp_replace("_bad", '"([^"]|"")*"', "")
    found = F.size(F.split(unquoted, "\t" if sep == "\t" else re.escape(sep)))
    # always true, but keeps a data column in the scan: reading the corrupt column alone is refused
    reads_data = F.coalesce(F.length("f0"), F.lit(0)) >= 0
    kept = raw.filter((F.col("_bad").isNull() | (found <= len(names))) & reads_data)
    origin = [F.col("_metadata.file_name").alias(source_file)] if source_file else []
    return kept.select(*[F.col(f).alias(n) for f, n in zip(fields, names)], *origin)


def _ends_open(line: Column, sep: str, start: str = "^|") -> Column:
    """Whether a line that begins outside quotes ends inside a quoted field. Quotes inside plain fields are text."""
    inside = '[^"]*+(?:""[^"]*+)*+'
    done = F.regexp_replace(line, f'({start}{re.escape(sep)})"{inside}"(?={re.escape(sep)}|$)', "$1")
    return done.rlike(f'({start}{re.escape(sep)})"{inside}$')


def has_line_breaks(spark: SparkSession, paths, sep: str = ",") -> bool:
    """Whether any line ends inside a quoted field; the search ends at the first."""
    return not spark.read.text(paths).filter(_ends_open(F.col("value"), sep)).isEmpty()


def csv_records(spark: SparkSession, paths, sep: str = ",") -> DataFrame:
    """Records of delimited text whose quoted fields may hold line breaks: file, record_no (from 0), record.

    Large files stay split. Each line maps "inside quotes before it" to "inside quotes after it": it keeps, swaps or sets the
    state, whatever came before. Lines are composed inside a block, blocks by a small table with one row each, so
    every line learns its state; lines that stand alone stay where they are, the others are joined by record.
    """
    text = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    rest = F.regexp_replace("value", '^[^"]*+(?:""[^"]*+)*+', "")
    after_close = _ends_open(F.concat(F.lit("x"), F.substr(rest, F.lit(2))), sep, "")
    lines = text.withColumns({"out": _ends_open(F.col("value"), sep), "in": (rest == "") | after_close})
    lines = materialize(lines.withColumns({
        "sets": F.when(F.col("out") == F.col("in"), F.col("out")), "swaps": (F.col("out") & ~F.col("in")).cast("int")}).drop("out", "in"), "csv")

    def state(before, along):
        """The state after a row: that of the last setting row, or ``before``, swapped as often as rows since then swap."""
        total = F.sum("swaps").over(along)
        last = F.last(F.when(F.col("sets").isNotNull(), F.struct("sets", total.alias("total"))), ignorenulls=True).over(along)
        odd = lambda n: n % 2 == 1
        return F.when(last.isNotNull(), last["sets"] != odd(total - last["total"])).otherwise(before != odd(total))

    along = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # a block as one row: what it sets, if it does, and whether it swaps
    set_at = F.max(F.when(F.col("sets").isNotNull(), F.struct("at", "sets", "total")))
    blocks = lines.withColumn("total", F.sum("swaps").over(along)).groupBy("file", "block").agg(
        set_at.alias("s"), F.max("total").alias("swaps")).select(
        "file", "block", (F.col("s.sets") != ((F.col("swaps") - F.col("s.total")) % 2 == 1)).alias("sets"), "swaps")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("after", state(F.lit(False), earlier))
    whole = Window.partitionBy("file").orderBy("block")
    starts = materialize(blocks.select("file", "block", F.coalesce(F.lag("after").over(whole), F.lit(False)).alias("before")), "blocks")
    known = lines.join(starts, ["file", "block"]).withColumn("after", state(F.col("before"), along))
    opened = F.coalesce(F.lag("after").over(Window.partitionBy("file", "block").orderBy("at")), F.col("before"))
    told = known.withColumn("opened", opened).withColumn("begins", F.when(~F.col("opened"), 1).otherwise(0))
    told = materialize(told.withColumn("inside", F.sum("begins").over(along)).select("file", "block", "at", "value", "opened", "after", "inside"), "csv")
    counts = told.groupBy("file", "block").agg(F.max("inside").alias("begun"))
    offset = F.coalesce(F.sum("begun").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("file", "block", offset.alias("offset"))
    numbered = told.join(offsets, ["file", "block"]).select("file", "at", "block", "value", (F.col("offset") + F.col("inside") - 1).alias("record_no"), "opened", "after")
    alone = ~F.col("opened") & ~F.col("after")
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"])
    joined = numbered.filter(~alone).groupBy("file", "record_no").agg(F.array_join(pieces, "\n").alias("record"))
    return numbered.filter(alone).select("file", "record_no", F.col("value").alias("record")).unionAll(joined)


def scan_records(spark: SparkSession, paths, names: list[str], sep: str = ",", header: bool = True, source_file: str | None = None) -> DataFrame:
    """As ``scan_delimited``, for files whose quoted fields hold line breaks. Of each record only wanted fields are kept."""
    records = csv_records(spark, paths, sep).filter(F.col("record").rlike(r"\S"))
    if header:
        records = records.filter("record_no > 0")
    inside = '[^"]*+(?:""[^"]*+)*+'
    unquoted = F.regexp_replace("record", f'"{inside}"', "")
    fitting = records.filter(F.size(F.split(unquoted, re.escape(sep))) <= len(names))
    fields = ", ".join(f"f{i} string" for i in range(len(names)))
    parsed = F.from_csv("record", fields, {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"})
    origin = [F.element_at(F.split("file", "/"), -1).alias(source_file)] if source_file else []
    return fitting.withColumn("_p", parsed).select(*[F.col(f"_p.f{i}").alias(n) for i, n in enumerate(names)], *origin)


def scan_json(spark: SparkSession, paths, lines: bool) -> DataFrame:
    """JSON by line or as a whole document."""
    return spark.read.option("multiLine", str(not lines).lower()).json(paths)


def scan_parquet(spark: SparkSession, paths) -> DataFrame:
    return spark.read.parquet(*([paths] if isinstance(paths, str) else paths))


def strip_columns(df: DataFrame) -> DataFrame:
    """Remove spaces around column names."""
    return df.toDF(*[name.strip() for name in df.columns])


def drop_index(df: DataFrame) -> DataFrame:
    """Drop a first column without a name (a saved row index)."""
    first = df.columns[0]
    unnamed = first.strip() == "" or re.fullmatch(r"_c0|Unnamed: 0", first.strip())
    return df.drop(first) if unnamed else df


def prune_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Keep the wanted columns, matched without outer spaces; the scan then reads only those."""
    names = {name.strip(): name for name in df.columns}
    missing = sorted(set(wanted) - set(names))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.select(*[F.col(f"`{names[name]}`").alias(name) for name in wanted])


def normalise_nulls(df: DataFrame) -> DataFrame:
    """Missing-value texts, NaN and both infinities become NULL, in every column."""
    columns = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            col = F.when(~col.isin(MISSING_TOKENS), col)
        elif isinstance(field.dataType, FLOATING):
            col = finite(col)
        columns.append(col.alias(field.name))
    return df.select(*columns)


def missing_tokens_to_null(df: DataFrame) -> DataFrame:
    """Only the missing-value texts become NULL (infinities stay countable)."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    cols = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*[
        (F.when(~col.isin(MISSING_TOKENS), col) if name in texts else col).alias(name)
        for name, col in zip(df.columns, cols)
    ])


def tag_provenance(df: DataFrame, testbed: str) -> DataFrame:
    """Add the testbed and the name of the file each row came from."""
    return df.select("*", F.lit(testbed).alias("testbed"), F.col("_metadata.file_name").alias("source_file"))


def align_columns(frames: list[DataFrame]) -> DataFrame:
    """Union in first-seen column order; columns a frame lacks become NULL.

    A column whose type differs between frames is read as text in all of them.
    """
    types: dict[str, set[str]] = {}
    for frame in frames:
        for name, kind in frame.dtypes:
            types.setdefault(name, set()).add(kind)
    mixed = {name for name, kinds in types.items() if len(kinds) > 1}
    aligned = None
    for frame in frames:
        frame = frame.select(*[
            F.col(f"`{c}`").cast("string").alias(c) if c in mixed else F.col(f"`{c}`") for c in frame.columns
        ])
        aligned = frame if aligned is None else aligned.unionByName(frame, allowMissingColumns=True)
    return aligned


def scan_dataset(spark: SparkSession, files: list[dict]) -> DataFrame:
    """All readable files of one dataset as one table.

    ``files`` are rows of ``discover`` joined with ``probe``. Files with the same format and
    header are read by one scan, so the number of scans is the number of layouts, not of files.
    """
    layouts: dict[tuple, list[str]] = {}
    for entry in files:
        suffix = entry["suffix"]
        kind = "jsonl" if suffix in ("jsonl", "ndjson") else suffix
        layouts.setdefault((kind, entry.get("header")), []).append(entry["path"])
    frames = []
    for (kind, header), paths in layouts.items():
        if kind in SEPARATORS:
            names = split_header(header, SEPARATORS[kind])
            scan = scan_records if has_line_breaks(spark, paths, SEPARATORS[kind]) else scan_delimited
            frames.append(missing_tokens_to_null(scan(spark, paths, names, SEPARATORS[kind])))
        elif kind == "parquet":
            frames.append(strip_columns(scan_parquet(spark, paths)))
        else:
            frames.append(strip_columns(scan_json(spark, paths, lines=kind == "jsonl")))
    return align_columns(frames)

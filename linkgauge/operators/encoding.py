"""Feature encoding fitted on training rows only."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkgauge.functions.numeric import number
from linkgauge.operators.ordering import exact_percentiles, part_offsets, range_positions
from linkgauge.session import materialize

# categories of a column that are encoded one by one
MAX_CATEGORIES = 10_000


def column_kinds(df: DataFrame, features: list[str]) -> tuple[list[str], list[str]]:
    """Numeric and categorical features by type, in input order."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType,))}
    return [c for c in features if c in numeric], [c for c in features if c not in numeric]


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact median per numeric column: (column, median)."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]
    long = df.select(F.inline(F.array(*pairs)))
    return exact_percentiles(long, ["column"], "value", {"median": 0.5})


def most_frequent(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent value per categorical column, ties: smallest; counts are combined before the shuffle."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    counts = df.select(F.inline(F.array(*pairs))).filter(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count("*").alias("n")
    )
    return counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("minus"), "value")).alias("m")).select(
        "column", F.col("m.value").alias("most_frequent")
    )


def scaling(df: DataFrame, columns: list[str], sample: bool = False) -> DataFrame:
    """Mean and deviation per numeric column, one pass: (column, mean, std).

    Population deviation for linear models, sample deviation for token models; 0 becomes 1.
    """
    deviation = F.stddev_samp if sample else F.stddev_pop
    wide = df.agg(*[e for i, c in enumerate(columns) for e in (
        F.avg(f"`{c}`").alias(f"m{i}"), deviation(f"`{c}`").alias(f"s{i}"))])
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"),
                 F.when(F.col(f"s{i}") == 0, F.lit(1.0)).otherwise(F.col(f"s{i}")).alias("std"))
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*entries)))


def fill_values(train: DataFrame, numeric: list[str], categorical: list[str]) -> dict:
    """Fill value per feature; one value per column reaches the driver."""
    fills = {}
    if numeric:
        fills.update({r["column"]: r["median"] for r in medians(train, numeric).toLocalIterator()})
    if categorical:
        fills.update({r["column"]: r["most_frequent"] for r in most_frequent(train, categorical).toLocalIterator()})
    return fills


def _literal(value) -> str:
    if value is None:
        return "NULL"
    return repr(float(value)) + "D" if isinstance(value, (int, float)) else "'" + value.replace("'", "\\'") + "'"


def check_width(train: DataFrame, categorical: list[str], most: int) -> None:
    """Stop when a column has more than about ``most`` categories: its labels and its vectors would have no bound."""
    if not categorical:
        return
    sizes = train.agg(*[F.approx_count_distinct(F.col(f"`{c}`").cast("string"), 0.02).alias(c) for c in categorical]).first().asDict()
    wide = {c: n for c, n in sizes.items() if n > most}
    if wide:
        raise ValueError(f"too many categories to encode one by one: {wide}; drop these columns or use encode_tokens")


def known_fills(train: DataFrame, features: list[str], max_categories: int = MAX_CATEGORIES) -> dict:
    """The fill values of ``fit_encoder``; a column of more than ``max_categories`` values is an error."""
    numeric, categorical = column_kinds(train, features)
    check_width(train, categorical, max_categories)
    return fill_values(train, numeric, categorical)


def fit_encoder(
    train: DataFrame, features: list[str], scale: bool = False, max_categories: int = MAX_CATEGORIES, fills: dict | None = None
) -> PipelineModel:
    """Fill, optionally standardise, one-hot encode; adds the vector ``features``.

    A category not seen in training becomes all zeros. Medians are exact. A column of more than
    ``max_categories`` values is an error. ``fills`` of the same rows (see ``known_fills``) need not be found again.
    """
    numeric, categorical = column_kinds(train, features)
    fills = known_fills(train, features, max_categories) if fills is None else fills
    parts = [f"coalesce(cast(`{c}` as double), {_literal(fills.get(c))}) as `_n_{c}`" for c in numeric]
    parts += [f"coalesce(cast(`{c}` as string), {_literal(fills.get(c))}) as `_c_{c}`" for c in categorical]
    filled = SQLTransformer(statement=f"select *, {', '.join(parts)} from __THIS__")
    stages = [filled]
    numbers = [f"_n_{c}" for c in numeric]
    if scale and numeric:
        ready = filled.transform(train)
        moments = {r["column"]: (r["mean"], r["std"]) for r in scaling(ready, numbers).toLocalIterator()}
        scaled = [f"(`{c}` - {_literal(moments[c][0])}) / {_literal(moments[c][1])} as `_s{c}`" for c in numbers]
        stages.append(SQLTransformer(statement=f"select *, {', '.join(scaled)} from __THIS__"))
        numbers = [f"_s{c}" for c in numbers]
    vectors = []
    for c in categorical:
        stages.append(StringIndexer(
            inputCol=f"_c_{c}", outputCol=f"_i_{c}", handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCol=f"_i_{c}", outputCol=f"_o_{c}", dropLast=True))
        vectors.append(f"_o_{c}")
    stages.append(VectorAssembler(inputCols=[*numbers, *vectors], outputCol="features"))
    return Pipeline(stages=stages).fit(train)


def feature_names(encoder: PipelineModel, features_numeric: list[str], features_categorical: list[str]) -> list[str]:
    """Names of the encoded columns in vector order."""
    names = [f"numeric__{c}" for c in features_numeric]
    indexers = {s.getInputCol(): s.labels for s in encoder.stages if hasattr(s, "labels")}
    for c in features_categorical:
        names += [f"categorical__{c}_{value}" for value in indexers[f"_c_{c}"]]
    return names


def encode_tokens(train: DataFrame, df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Token encoding: numbers filled and standardised (sample deviation), categories as indexes.

    Indexes follow the alphabet from 1 within each column; 0 is a value training did not see.
    The index tables are joined, so no category list passes through the driver.
    """
    fills = fill_values(train, numeric, [])
    filled = train.select(*[F.coalesce(number(F.col(c)), F.lit(fills.get(c))).alias(c) for c in numeric])
    moments = {r["column"]: (r["mean"], r["std"]) for r in scaling(filled, numeric, sample=True).toLocalIterator()}
    out = df.withColumns({
        c: (F.coalesce(number(F.col(c)), F.lit(fills.get(c))) - F.lit(moments[c][0])) / F.lit(moments[c][1])
        for c in numeric
    })
    for c in categorical:
        index = category_index(train, c).withColumnRenamed("value", f"_v_{c}").withColumnRenamed("token", f"_t_{c}")
        text = F.coalesce(F.col(c).cast("string"), F.lit("nan"))
        out = out.join(index, text == F.col(f"_v_{c}"), "left").withColumn(
            c, F.coalesce(f"_t_{c}", F.lit(0))
        ).drop(f"_v_{c}", f"_t_{c}")
    return out


def category_index(train: DataFrame, column: str) -> DataFrame:
    """(value, token): alphabetical position from 1 of the distinct training values.

    Values are sorted in ranges; counts and offsets of the ranges make the numbers dense, so no task and no
    driver holds them all.
    """
    values = train.select(F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("value")).distinct()
    placed = range_positions(materialize(values, "values"), F.col("value"))
    token = F.col("_before") + F.col("_place") - F.col("_first") + 1
    return placed.join(part_offsets(placed, []), "_part").select("value", token.cast("int").alias("token"))

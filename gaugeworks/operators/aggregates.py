"""Per-column aggregates that one pass over the rows gives: one wide aggregate, partial on each task, then a row for each column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.errors import SchemaError
from gaugeworks.functions import predicates as P
from gaugeworks.operators.fields import Field, fields, long_rows

#: Expressions in one aggregate; more take several, each over its own columns, as the JVM doesn't compile large methods.
MOST_EXPRESSIONS = 40


def chosen(df: DataFrame, columns: list[str] | None) -> list[Field]:
    found = fields(df)
    if columns is None:
        return found
    unknown = set(columns) - set(df.columns)
    if unknown:
        raise SchemaError(f"unknown columns: {', '.join(sorted(unknown))}")
    return [f for f in found if f.name in columns]


def one_row(df: DataFrame, wanted: dict[str, Column]) -> dict:
    """The values of many aggregates, a few dozen at a time. An empty table gives a row as well."""
    out: dict = {}
    names = [*wanted]
    for at in range(0, max(1, len(names)), MOST_EXPRESSIONS):
        part = names[at : at + MOST_EXPRESSIONS]
        out |= df.agg(*[wanted[n].alias(n) for n in part]).first().asDict() if part else {}
    return out


def _per_column(df: DataFrame, found: list[Field], of) -> DataFrame:
    """A row for each field with the aggregates that ``of`` makes of it."""
    made = {f.name: of(f) for f in found}
    flat = {f"{k}_{name}": c for k, by in enumerate(made.values()) for name, c in by.items()}
    wide = df.agg(*[c.alias(n) for n, c in flat.items()])
    return long_rows({f: {name: F.col(f"{k}_{name}") for name in by} for k, (f, by) in enumerate(made.items())}, wide)


def count_if(c: Column) -> Column:
    return F.count(F.when(c, 1))


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column``, ``total_count``, ``null_count`` (null-like cells included)."""
    return _per_column(df, chosen(df, columns), lambda f: {"total_count": F.count(F.lit(1)), "null_count": count_if(null_cell(f))})


def null_cell(f: Field) -> Column:
    """Whether a cell counts as null. Numbers and dates have no null-like text but null itself, and NaN."""
    return P.is_null_like(f.text) if f.kind is None else f.text.isNull() if f.empty is None else f.empty


def moments(x: Column) -> dict[str, Column]:
    """Count, range, mean and sample moments of a number. One value or none has variance 0; skewness needs three, kurtosis four."""
    n, variance, mean = F.count(x), F.coalesce(F.var_samp(x), F.lit(0.0)), F.avg(x)
    sd = F.sqrt(variance)
    flat = sd < 1e-10
    return {
        "n": n,
        "min": F.min(x),
        "max": F.max(x),
        "mean": mean,
        "std_dev": F.when(n > 0, sd),
        "variance": F.when(n > 0, variance),
        "coefficient_of_variation": F.when(F.abs(mean) >= 0.001, sd / F.abs(mean) * 100),
        "skewness": F.when((n >= 3) & ~flat, F.skewness(x) * F.pow((n - 1) / n, 1.5)),
        "kurtosis": F.when((n >= 4) & ~flat, (F.kurtosis(x) + 3) * F.pow((n - 1) / n, 2) - 3),
    }


def plain_moments(x: Column) -> dict[str, Column]:
    """What of :func:`moments` is cheap: count, range and mean."""
    return {"n": F.count(x), "min": F.min(x), "max": F.max(x), "mean": F.avg(x)}


def power_sums(x: Column, about: float) -> dict[str, Column]:
    """Sums of the first four powers of the distance from a value near the mean."""
    d = x - F.lit(float(about))
    return {"s1": F.sum(d), "s2": F.sum(d * d), "s3": F.sum(d * d * d), "s4": F.sum(d * d * d * d)}


def moments_of(n: int, mean: float | None, s1: float, s2: float, s3: float, s4: float) -> dict[str, float | None]:
    """The rest of :func:`moments` from power sums."""
    out: dict[str, float | None] = dict.fromkeys(("std_dev", "variance", "coefficient_of_variation", "skewness", "kurtosis"))
    if not n:
        return out
    d = s1 / n
    m2 = max(0.0, s2 - n * d * d)
    m3, m4 = s3 - 3 * d * s2 + 2 * n * d**3, s4 - 4 * d * s3 + 6 * d * d * s2 - 3 * n * d**4
    variance = m2 / (n - 1) if n > 1 else 0.0
    sd = math.sqrt(variance)
    out |= {"std_dev": sd, "variance": variance}
    if abs(mean) >= 0.001:
        out["coefficient_of_variation"] = sd / abs(mean) * 100
    if sd >= 1e-10:
        out["skewness"] = m3 / n / sd**3 if n >= 3 else None
        out["kurtosis"] = m4 / n / variance**2 - 3 if n >= 4 else None
    return out


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    found = [f for f in chosen(df, columns) if columns is not None or f.kind in ("Integer", "Float")]
    return _per_column(df, found, lambda f: moments(f.number))


def text_lengths(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Least, greatest and mean length in bytes of values that aren't null-like."""

    def of(f: Field) -> dict[str, Column]:
        size = F.when(~null_cell(f), F.octet_length(f.text))
        return {"min_length": F.min(size), "max_length": F.max(size), "avg_length": F.avg(size)}

    return _per_column(df, chosen(df, columns), of)


def length_histogram(df: DataFrame, column: str) -> DataFrame:
    """Values by the power of two that their length in bytes reaches; bucket 0 is the empty text."""
    f = chosen(df, [column])[0]
    size = F.octet_length(f.text)
    bucket = F.when(size == 0, 0).otherwise(F.least(F.lit(31), F.floor(F.log2(size)).cast("int") + 1))
    return df.where(~null_cell(f)).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def boolean_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """True and false cells and the share of true ones, of boolean columns and of texts that say so."""

    def of(f: Field) -> dict[str, Column]:
        t = F.lower(P.trimmed(f.text))
        yes, no = count_if(t == "true"), count_if(t == "false")
        return {"true_count": yes, "false_count": no, "true_ratio": F.when(yes + no > 0, yes / (yes + no)).otherwise(0.0)}

    return _per_column(df, chosen(df, columns), of)


def date_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """First and last date, days between them, cells with a date."""

    def of(f: Field) -> dict[str, Column]:
        d = F.to_date(f.moment)
        return {"n": F.count(d), "min_date": F.date_format(F.min(d), "yyyy-MM-dd"), "max_date": F.date_format(F.max(d), "yyyy-MM-dd"), "duration_days": F.datediff(F.max(d), F.min(d)).cast("double")}

    return _per_column(df, chosen(df, columns), of)


def date_distribution(df: DataFrame, column: str) -> DataFrame:
    """Cells by year, month, day of the week, and by hour of those with a time of day: ``part``, ``key``, ``n``."""
    f = chosen(df, [column])[0]
    timed = F.lit(True) if f.kind == "Date" and dict(df.dtypes)[column] != "date" else P.has_clock(f.text)
    at = df.where(f.moment.isNotNull()).select(f.moment.alias("m"), timed.alias("timed"))
    parts = _date_parts()
    # as many groups as years, months, days and hours: few, so they are counted before the parts are told apart
    counted = at.groupBy(F.date_trunc("hour", "m").alias("m"), "timed").agg(F.count(F.lit(1)).alias("n"))
    return _by_part(counted, parts)


def _date_parts() -> Column:
    """Year, month, day of the week and hour of ``m``, the hour if it is ``timed``."""
    return F.array(
        F.struct(F.lit("year").alias("part"), F.year("m").cast("string").alias("key")),
        F.struct(F.lit("month").alias("part"), F.month("m").cast("string").alias("key")),
        F.struct(F.lit("weekday").alias("part"), F.date_format("m", "EEEE").alias("key")),
        F.struct(F.lit("hour").alias("part"), F.when(F.col("timed"), F.hour("m")).cast("string").alias("key")),
    )


def _by_part(counted: DataFrame, parts: Column) -> DataFrame:
    return counted.select(F.explode(parts).alias("p"), "n").where("p.key is not null").groupBy(F.col("p.part").alias("part"), F.col("p.key").alias("key")).agg(F.sum("n").alias("n"))


def counted_date_distribution(counts: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """:func:`date_distribution` from counted values."""
    f = chosen(df, [column])[0]
    mine, timed = counts.where(F.col("column") == column), F.lit(True) if f.kind == "Date" and dict(df.dtypes)[column] != "date" else P.has_clock(F.col("value")) if f.kind is None else F.lit(False)
    moment = F.col("value").try_cast("timestamp") if f.kind == "Date" else P.moment(F.col("value"))
    at = mine.select(moment.alias("m"), timed.alias("timed"), "n").where("m is not null")
    return _by_part(at, _date_parts())


def lexical_counts(t: Column) -> dict[str, Column]:
    """Counts of a text's cells by what they say; the four classes share out all cells that aren't null-like."""
    c, ok = P.trimmed(t), ~P.is_null_like(t)
    kind = P.lexical_class(t)
    return {
        "non_null": count_if(ok),
        "integers": count_if(ok & P.is_integer(c)),
        "floats": count_if(ok & P.is_float(c)),
        "booleans": count_if(ok & P.is_boolean(c)),
        "dates": count_if(ok & P.is_inferred_date(c)),
        "class_numeric": count_if(kind == "Numeric"),
        "class_date": count_if(kind == "Date"),
        "class_boolean": count_if(kind == "Boolean"),
        "class_text": count_if(kind == "Text"),
    }


def inferred(n: Column, integers: Column, floats: Column, booleans: Column, dates: Column) -> Column:
    """The type that cells say: all integers, else over 80 % numbers, 90 % booleans or more, over 70 % dates, else text."""
    return (
        F.when(n == 0, "String")
        .when(integers == n, "Integer")
        .when(floats / n > 0.8, "Float")
        .when(booleans / n >= 0.9, "Boolean")
        .when(dates / n > 0.7, "Date")
        .otherwise("String")
    )


def sketched_distinct(df: DataFrame, columns: list[str] | None = None, precision: int = 14) -> DataFrame:
    """Distinct values by HyperLogLog sketch; sketches of parts can be united (:func:`united`)."""
    return _per_column(df, chosen(df, columns), lambda f: {"distinct_count": F.hll_sketch_estimate(F.hll_sketch_agg(F.when(~null_cell(f), f.text if f.key is None else f.key), F.lit(precision)))})


def distinct_sketches(df: DataFrame, by: Column, columns: list[str] | None = None, precision: int = 14) -> DataFrame:
    """A sketch for each part of the rows and column: ``part``, ``column``, ``sketch``."""
    found = chosen(df, columns)
    wide = df.groupBy(by.alias("part")).agg(*[F.hll_sketch_agg(F.when(~null_cell(f), f.text if f.key is None else f.key), F.lit(precision)).alias(f"s{k}") for k, f in enumerate(found)])
    rows = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"s{k}").alias("sketch")) for k, f in enumerate(found)])
    return wide.select("part", F.explode(rows).alias("r")).select("part", "r.*")


def united(sketches: DataFrame) -> DataFrame:
    """Distinct values of all parts together."""
    return sketches.groupBy("column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_count"))


def complete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``rows``, ``complete`` (without a null-like cell), ``cells``, ``null_cells``."""
    found = chosen(df, columns)
    empty = [null_cell(f) for f in found]
    complete = ~empty[0] if empty else F.lit(True)
    for e in empty[1:]:
        complete = complete & ~e
    nulls = sum([F.when(e, 1).otherwise(0) for e in empty], F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("rows"), count_if(complete).alias("complete"), (F.count(F.lit(1)) * len(found)).alias("cells"), F.coalesce(F.sum(nulls), F.lit(0)).cast("long").alias("null_cells"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``rows``, ``distinct_rows``, ``duplicate_rows``. Null and empty texts are alike.

    Rows are compared by their own columns where these are short, long texts by digest, so that what is shuffled is small.
    """
    keys = [F.coalesce(f.text, F.lit("")) if f.kind in (None, "String") else f.key for f in fields(df)]
    # two hashes of 64 bits with different beginnings, and the length: rows that agree in all are the same
    row = F.concat_ws("\x1e", *[F.concat(F.length(F.coalesce(k, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(k, F.lit(""))) for k in keys])
    by = df.select(F.xxhash64(*keys).alias("a"), F.xxhash64(F.lit("row"), row).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def _sketched(df: DataFrame, columns: list[str], k: int, of) -> dict[str, list]:
    """The ``k`` most frequent items of an expression of each column by a sketch that keeps ``TRACKED`` of them: (item, count)."""
    found = chosen(df, columns)
    if not found:
        return {}
    wide = df.select(*[of(f).alias(f"c{i}") for i, f in enumerate(found)])
    row = wide.agg(*[F.expr(f"approx_top_k(c{i}, {k}, {TRACKED})").alias(f"c{i}") for i in range(len(found))]).first()
    return {f.name: [(x["item"], x["count"]) for x in row[f"c{i}"] or [] if x["item"] is not None] for i, f in enumerate(found)}


#: Items that a sketch of frequent ones keeps; bytes of texts that are items.
TRACKED, ITEM_BYTES = 10_000, 256


def sketched_modes(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The most frequent number of each column, to ten decimals, by a sketch; None if none repeats."""
    found = _sketched(df, columns, 1, lambda f: F.round(f.number, 10))
    return {n: x[0][0] if x and x[0][1] > 1 else None for n, x in found.items()}


def sketched_tops(df: DataFrame, columns: list[str], k: int) -> dict[str, list[dict]]:
    """The most frequent texts of each column by a sketch, with estimated counts; texts of over ``ITEM_BYTES`` bytes aren't told."""
    total = one_row(df, {f.name: count_if(~null_cell(f)) for f in chosen(df, columns)})
    found = _sketched(df, columns, k, lambda f: F.when(~null_cell(f) & (F.octet_length(f.text) <= ITEM_BYTES), f.text))
    return {n: [{"value": v, "count": c, "percentage": c / total[n] * 100} for v, c in sorted(x, key=lambda y: (-y[1], y[0]))] for n, x in found.items() if x}

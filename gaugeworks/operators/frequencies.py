"""What the counts of a column's distinct values tell: distinct values, modes, most and least frequent values, decimals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions import patterns as R
from gaugeworks.functions import predicates as P
from gaugeworks.operators.aggregates import chosen, inferred, null_cell
from gaugeworks.operators.fields import plain_double

#: Bytes from which a text is counted by its digest rather than whole, and signs of it that are kept beside.
LONG_TEXT, HEAD = 256, 64


def value_counts(df: DataFrame, columns: list[str] | None = None, whole: bool = True, judged: list[str] | None = None) -> DataFrame:
    """``column``, ``value`` (text), ``n`` for all values that aren't null-like: one shuffle for all columns.

    With ``whole`` false there is ``digest`` as well: null for a value that stands for itself, the SHA-256 of a long one, of which
    ``value`` is the beginning alone. With ``judged``, the columns that may have long values, no other column is asked for
    them, and a long value's ``facts`` and pattern ``mask`` are found where it is.
    """
    found = chosen(df, columns)
    if whole:
        text = lambda f: f.text if f.key is None else f.key
        cells = F.array(*[F.struct(F.lit(f.name).alias("column"), F.when(~null_cell(f), text(f)).alias("value")) for f in found])
        return _counted(df, cells, ["column", "value"])

    def cell(f):
        key = f.text if f.key is None else f.key
        name, none = F.lit(f.name).alias("column"), F.lit(None)
        if f.key is not None or judged is not None and f.name not in judged:
            extra = [none.cast(_FACTS).alias("facts"), none.cast("long").alias("mask")] if judged else []
            return F.struct(name, F.when(~null_cell(f), key).alias("value"), none.cast("string").alias("digest"), *extra)
        long = _is_long(f.text)
        value = F.when(~null_cell(f), F.when(long, F.substring(key, 1, HEAD)).otherwise(key)).alias("value")
        extra = [F.when(long, _facts(f.text)).cast(_FACTS).alias("facts"), F.when(long, R.match_mask(P.trimmed(f.text))).alias("mask")] if judged else []
        return F.struct(name, value, F.when(long, F.sha2(key, 256)).alias("digest"), *extra)

    return _counted(df, F.array(*[cell(f) for f in found]), ["column", "value", "digest", *(["facts", "mask"] if judged else [])])


def _counted(df: DataFrame, cells, names: list[str]) -> DataFrame:
    each = df.select(F.explode(cells).alias("c")).where("c.value is not null")
    return each.groupBy(*[F.col(f"c.{n}").alias(n) for n in names]).agg(F.count(F.lit(1)).alias("n"))


_FACTS = "struct<integer:boolean,float:boolean,date:boolean,any_date:boolean,day:date,raw:boolean,scale:int>"


def _is_long(text):
    return F.octet_length(P.trimmed(text)) >= LONG_TEXT


def _facts(raw):
    """What a text says, each question asked once."""
    return F.struct(*[c.alias(k) for k, c in _said(P.trimmed(raw), raw).items()])


def _said(t, raw):
    """What a text says, trimmed and as it stands, by the name of the question."""
    return {
        "integer": P.is_integer(t), "float": P.is_float(t), "date": P.is_inferred_date(t), "any_date": P.is_date(t),
        "day": F.to_date(P.moment(t)), "raw": (F.octet_length(raw) >= 10) & (raw == t) & raw.rlike(P.RAW_DATE), "scale": P.decimal_scale(t),
    }


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Exact distinct values of each column."""
    names = [f.name for f in chosen(df, columns)]
    counted = value_counts(df, columns, whole=False).groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))
    every = df.sparkSession.createDataFrame([(n,) for n in names], "column string")
    return every.join(counted, "column", "left").na.fill(0, ["distinct_count"])


def value_facts(counts: DataFrame) -> DataFrame:
    """What the counted values of each column say: distinct values, lexical counts, booleans, dates with their range.

    Values are judged once each, however often they occur.
    """
    return _summed(_judged(counts)).withColumnRenamed("rows", "distinct")


def _judged(cells: DataFrame) -> DataFrame:
    """``column``, ``n`` and what each ``value`` says. Long values may come with what they say as ``facts``."""
    asked_for = ("integer", "float", "date", "any_date", "day", "raw")
    if "facts" in cells.columns:
        short = cells.select("column", "n", P.trimmed(F.col("value")).alias("t"), "value", "facts")
        asked = short.select("column", "n", F.when(F.col("facts").isNull(), F.lower("t")).alias("low"), F.coalesce(F.col("facts"), _facts(F.col("value"))).alias("f"))
        asked = asked.select("column", "n", "low", *[f"f.{x}" for x in asked_for])
    else:
        # a column for each question, not a struct: those that nobody reads aren't asked
        said = _said(F.col("t"), F.col("value"))
        asked = cells.select("column", "n", "value", P.trimmed(F.col("value")).alias("t")).select("column", "n", F.lower("t").alias("low"), *[said[x].alias(x) for x in asked_for])
    boolean = F.coalesce(F.col("low").isin(*P.BOOLEAN_TOKENS), F.lit(False))
    kind = F.when(F.col("low").isin(*P.NULL_TOKENS), None).when(F.col("float"), "Numeric").when(F.col("any_date"), "Date").when(boolean, "Boolean").otherwise("Text")
    return asked.select("column", "n", "low", "integer", "float", boolean.alias("boolean"), "date", "day", kind.alias("class"), (F.col("raw") & F.col("day").isNotNull()).alias("parses"))


def _summed(judged: DataFrame) -> DataFrame:
    n = F.col("n")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    return judged.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("non_null"), total(F.col("integer")).alias("integers"), total(F.col("float")).alias("floats"), total(F.col("boolean")).alias("booleans"), total(F.col("date")).alias("dates"),
        *[total(F.col("class") == k).alias(f"class_{k.lower()}") for k in ("Numeric", "Date", "Boolean", "Text")],
        total(F.col("low") == "true").alias("true"), total(F.col("low") == "false").alias("false"), total(F.col("parses")).alias("parsed_dates"), F.min("day").alias("first"), F.max("day").alias("last"),
    )


def lexical_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Lexical classes and inferred type of columns, all taken as text. Every cell is judged where it is; nothing but counts is moved."""
    found = chosen(df, columns)
    cells = F.array(*[F.struct(F.lit(f.name).alias("column"), f.text.alias("value")) for f in found])
    each = df.select(F.explode(cells).alias("c")).select("c.column", "c.value", F.lit(1).cast("long").alias("n")).where(~P.is_null_like(F.col("value")))
    names = df.sparkSession.createDataFrame([(f.name,) for f in found], "column string")
    made = names.join(_summed(_judged(each)).drop("rows"), "column", "left").na.fill(0)
    kind = inferred(*[F.col(c) for c in ("non_null", "integers", "floats", "booleans", "dates")])
    counts = [F.col(f"class_{k}") for k in ("numeric", "date", "boolean", "text")]
    most = F.greatest(*counts)
    dominant = F.when(most == 0, None).when(counts[0] == most, "Numeric").when(counts[1] == most, "Date").when(counts[2] == most, "Boolean").otherwise("Text")
    return made.withColumn("data_type", kind).withColumn("dominant", dominant).withColumn("dominant_share", F.when(F.col("non_null") > 0, most / F.col("non_null")))


def cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column``, ``value`` and ``n`` = 1 for each cell that isn't null-like: what counted values are, without a shuffle."""
    found = chosen(df, columns)
    each = F.array(*[F.struct(F.lit(f.name).alias("column"), F.when(~null_cell(f), f.text).alias("value")) for f in found])
    return df.select(F.explode(each).alias("c")).where("c.value is not null").select("c.column", "c.value", F.lit(1).cast("long").alias("n"))


def _double_scale(x):
    """The decimals of a double's plain text."""
    return F.length(F.rtrim(F.substring_index(x.try_cast("decimal(38,15)").cast("string"), ".", -1), F.lit("0")))


def cell_scales(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column``, ``scale``, ``n`` as :func:`counted_scales` gives them, each cell judged where it is."""

    def scale(f):
        if isinstance(df.schema[f.name].dataType, (T.FloatType, T.DoubleType)):
            x = F.col(f"`{f.name}`").cast("double")
            return F.when(F.abs(x) < 1e22, _double_scale(x)).when(F.abs(x) < float("inf"), P.decimal_scale(f.text))
        return P.decimal_scale(P.trimmed(f.text))

    each = F.array(*[F.struct(F.lit(f.name).alias("column"), F.when(~null_cell(f), scale(f)).alias("scale")) for f in chosen(df, columns)])
    return df.select(F.explode(each).alias("c")).select("c.column", "c.scale").where("scale is not null").groupBy("column", "scale").agg(F.count(F.lit(1)).alias("n"))


def cell_masks(df: DataFrame) -> DataFrame:
    """Counts of pattern masks, each cell matched where it is. Numbers that no pattern can match, by size or decimals, aren't spelled out."""

    def text(f):
        kind, c = df.schema[f.name].dataType, F.col(f"`{f.name}`")
        if f.kind == "Integer" and f.key is not None:
            return F.when(F.abs(c.cast("double")) >= 10_000, f.text)  # digits match from five on
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            # with a dot there are a telephone's four, seven or ten last digits
            whole = c == F.floor(c)
            return F.when((whole & (F.abs(c) >= 10_000)) | (~whole & (_double_scale(c.cast("double")) >= 4)), f.text)
        return P.trimmed(f.text)

    each = F.array(*[F.struct(F.lit(f.name).alias("column"), null_cell(f).alias("none"), text(f).alias("t")) for f in chosen(df, None)])
    rows = df.select(F.explode(each).alias("c")).where("not c.none").select("c.column", F.when(F.col("c.t").isNull(), F.lit(0).cast("long")).otherwise(R.match_mask(F.col("c.t"))).alias("mask"))
    return rows.groupBy("column", "mask").agg(F.count(F.lit(1)).alias("n"))


def counted_modes(counts: DataFrame, columns: list[str], typed: list[str]) -> DataFrame:
    """:func:`modes` from counted values; those of ``typed`` columns are numbers' own texts."""
    plain = F.col("value").try_cast("double")
    x = F.round(F.when(F.col("column").isin(typed), plain).when(F.col("digest").isNull(), P.number(F.col("value"))), 10) if typed else F.round(F.when(F.col("digest").isNull(), P.number(F.col("value"))), 10)
    by = counts.where(F.col("column").isin(columns)).select("column", x.alias("x"), "n").where("x is not null and abs(x) < double('infinity')")
    return _best(by.groupBy("column", "x").agg(F.sum("n").alias("n")))


def modes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The most frequent number, to ten decimals: the smallest of several; null if none repeats."""
    found = [f for f in chosen(df, columns) if columns is not None or f.kind in ("Integer", "Float")]
    cells = F.array(*[F.struct(F.lit(f.name).alias("column"), F.round(f.number, 10).alias("x")) for f in found])
    counted = df.select(F.explode(cells).alias("c")).where("c.x is not null").groupBy(F.col("c.column").alias("column"), F.col("c.x").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return _best(counted)


def _best(counted: DataFrame) -> DataFrame:
    best = counted.groupBy("column").agg(F.max(F.struct("n", (-F.col("x")).alias("y"))).alias("m"))
    return best.select("column", F.when(F.col("m.n") > 1, 0 - F.col("m.y")).alias("mode"), F.col("m.n").alias("mode_count"))


def ranked_values(df: DataFrame, columns: list[str] | None = None, k: int = 10, least: bool = False) -> DataFrame:
    """The ``k`` most (or least) frequent values of each column with rank, count and percentage of its values; ties by value."""
    return ranked(value_counts(df, columns), k, least)


def ranked(counts: DataFrame, k: int = 10, least: bool = False) -> DataFrame:
    """Of values that are counted by digest those with equal beginnings stand in the order of their digests."""
    by_digest = [F.col("digest").asc_nulls_first()] if "digest" in counts.columns else []
    order = [F.col("n").asc() if least else F.col("n").desc(), F.col("value").asc(), *by_digest]
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order))).where(F.col("rank") <= k)
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    return top.join(totals, "column").select("column", "rank", "value", *(["digest"] if by_digest else []), "n", (F.col("n") / F.col("total") * 100).alias("percentage"))


def long_values(df: DataFrame, digests: dict[str, set[str]]) -> dict[str, str]:
    """The values of some digests by column, read again: as many as were asked for."""
    out: dict[str, str] = {}
    for f in chosen(df, [*digests]):
        wanted = df.select(f.text.alias("value")).where(_is_long(F.col("value"))).withColumn("digest", F.sha2("value", 256)).where(F.col("digest").isin(sorted(digests[f.name])))
        out |= {r["digest"]: r["value"] for r in wanted.groupBy("digest").agg(F.first("value").alias("value")).collect()}
    return out


def pattern_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column``, ``pattern``, ``match_count``, ``valid_count``, ``match_percentage`` of all patterns that match any value."""
    masks = pattern_masks(df, columns)
    totals = masks.groupBy("column").agg(F.sum("n").alias("total"))
    rows = F.array(*[F.struct(F.lit(p.name).alias("pattern"), F.lit(k).alias("bit"), F.lit(R._checked(k) if p.validator else k).alias("valid")) for k, p in enumerate(R.CATALOGUE)])
    each = masks.select("column", "mask", "n", F.explode(rows).alias("p")).where("shiftright(mask, p.bit) & 1 = 1")
    counted = each.groupBy("column", F.col("p.pattern").alias("pattern")).agg(F.sum("n").alias("match_count"), F.sum(F.when(F.expr("shiftright(mask, p.valid) & 1 = 1"), F.col("n")).otherwise(0)).alias("valid_count"))
    return counted.join(totals, "column").select("column", "pattern", "match_count", "valid_count", (F.col("match_count") / F.col("total") * 100).alias("match_percentage"))


def pattern_masks(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Counts of pattern masks. Short values are counted first and matched once; of long ones the masks alone are moved."""
    found = chosen(df, columns)
    cells = F.array(*[F.struct(F.lit(f.name).alias("column"), P.trimmed(f.text).alias("value")) for f in found])
    each = df.select(F.explode(cells).alias("c")).select("c.column", "c.value").where(~P.is_null_like(F.col("value")))
    long = F.octet_length("value") > LONG_TEXT
    short = each.where(~long).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).select("column", R.match_mask(F.col("value")).alias("mask"), "n")
    rest = each.where(long).select("column", R.match_mask(F.col("value")).alias("mask"), F.lit(1).cast("long").alias("n"))
    return short.unionByName(rest).groupBy("column", "mask").agg(F.sum("n").alias("n"))


def counted_masks(counts: DataFrame, floats: list[str]) -> DataFrame:
    """:func:`pattern_masks` from values that were counted and judged; ``floats`` are columns of doubles, whose plain text is matched."""
    mask = R.match_mask(F.col("t"))
    if "mask" in counts.columns:
        mask = F.when(F.col("digest").isNull(), mask).otherwise(F.col("mask"))
    return counts.select("column", _plain(floats).alias("t"), *[c for c in ("digest", "mask") if c in counts.columns], "n").select("column", mask.alias("mask"), "n").groupBy("column", "mask").agg(F.sum("n").alias("n"))


def _plain(floats: list[str]):
    """A counted value's text; a double's without an exponent."""
    value = P.trimmed(F.col("value"))
    return F.when(F.col("column").isin(floats), plain_double(F.col("value").try_cast("double"))).otherwise(value) if floats else value


def decimal_scales(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column``, ``scale``, ``n``: numbers by the decimals that they use."""
    return counted_scales(value_counts(df, columns), columns, [])


def counted_scales(counts: DataFrame, columns: list[str], floats: list[str]) -> DataFrame:
    """``floats`` are columns of doubles, whose decimals are those of their plain text."""
    value = F.col("value")
    double, scale = value.try_cast("double"), P.decimal_scale(P.trimmed(value))
    if "facts" in counts.columns:
        scale = F.when(F.col("facts").isNull(), scale).otherwise(F.col("facts.scale"))
    if floats:
        plain = F.when(F.abs(double) < 1e22, _double_scale(double)).otherwise(P.decimal_scale(value))
        scale = F.when(F.col("column").isin(floats), plain).otherwise(scale)
    return counts.where(F.col("column").isin(columns)).select("column", scale.alias("scale"), "n").where("scale is not null").groupBy("column", "scale").agg(F.sum("n").alias("n"))


def precision(scales: DataFrame) -> DataFrame:
    """Each column's modal scale (the smallest of several), and how many numbers have another."""
    best = scales.groupBy("column").agg(F.max(F.struct("n", (-F.col("scale")).alias("s"))).alias("m"), F.sum("n").alias("checked"))
    return best.select("column", (-F.col("m.s")).alias("modal_scale"), "checked", (F.col("checked") - F.col("m.n")).alias("deviating"))

"""A column of any type as the three things that a profile looks at: its text, its number and its moment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.errors import SchemaError

from gaugeworks.functions.predicates import moment, number

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass
class Field:
    name: str
    #: Integer, Float, Boolean, Date, String; None where the texts have to tell.
    kind: str | None
    text: Column
    number: Column
    moment: Column
    #: Whether the cell holds nothing, without making its text; None where the text has to tell.
    empty: Column | None = None
    #: A text that tells values apart, cheaper than ``text``.
    key: Column | None = None


def duplicate_names(columns: list[str]) -> list[str]:
    return sorted({c for c in columns if columns.count(c) > 1})


def plain_double(c: Column) -> Column:
    """A double's text without an exponent and without trailing zeros, as far as 38 digits go."""
    wide = c.cast("double").try_cast("decimal(38,15)").cast("string")
    return F.when(F.abs(c) < 1e22, F.regexp_replace(wide, r"\.?0+\z", "")).otherwise(c.cast("string"))


def field_of(f: T.StructField) -> Field:
    c, t = F.col(f"`{f.name}`"), f.dataType
    none_number, none_moment = F.lit(None).cast("double"), F.lit(None).cast("timestamp")
    if isinstance(t, INTEGERS):
        return Field(f.name, "Integer", c.cast("string"), c.cast("double"), none_moment, c.isNull(), c.cast("string"))
    if isinstance(t, (T.FloatType, T.DoubleType)):
        value = F.when(~F.isnan(c), c)  # NaN is null
        return Field(f.name, "Float", plain_double(value), F.when(F.abs(value) < float("inf"), value.cast("double")), none_moment, c.isNull() | F.isnan(c), value.cast("string"))
    if isinstance(t, T.DecimalType):
        text = F.regexp_replace(c.cast("string"), r"(\.[0-9]*?)0+\z", "$1")
        return Field(f.name, "Float", F.regexp_replace(text, r"\.\z", ""), c.cast("double"), none_moment, c.isNull(), c.cast("string"))
    if isinstance(t, T.BooleanType):
        return Field(f.name, "Boolean", F.when(c, "True").when(~c, "False"), none_number, none_moment, c.isNull(), c.cast("string"))
    if isinstance(t, T.DateType):
        return Field(f.name, "Date", F.date_format(c, "yyyy-MM-dd"), none_number, c.cast("timestamp"), c.isNull(), c.cast("string"))
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return Field(f.name, "Date", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), none_number, c.cast("timestamp"), c.isNull(), c.cast("string"))
    if isinstance(t, T.DayTimeIntervalType):
        micros = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
        return Field(f.name, "Integer", micros.cast("string"), micros.cast("double"), none_moment)
    if isinstance(t, T.BinaryType):
        return Field(f.name, "String", F.concat(F.lit("<binary:"), F.octet_length(c).cast("string"), F.lit(" bytes>")), none_number, none_moment)
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(c)
        return Field(f.name, "String", text, none_number, none_moment)
    text = c.cast("string")
    return Field(f.name, None, text, number(text), moment(text))


def fields(df: DataFrame) -> list[Field]:
    """All columns; two of one name are an error."""
    if twice := duplicate_names(df.columns):
        raise SchemaError(f"duplicate column names: {', '.join(twice)}")
    return [field_of(f) for f in df.schema.fields]


#: Bytes up to which a table is dealt anew; a larger one has splits enough, or is cheaper to read again than to move.
SMALL_TABLE = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """A small ``df`` in as many parts as there are cores, if it comes in fewer: one small file is one part."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL_TABLE:
        return df
    return df.repartition(cores)


def long_rows(values: dict[str, dict[str, Column]], wide: DataFrame) -> DataFrame:
    """One row for each key of ``values`` out of a one-row table: ``column`` and the named expressions."""
    rows = [F.struct(F.lit(name).alias("column"), *[c.alias(k) for k, c in by.items()]) for name, by in values.items()]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")

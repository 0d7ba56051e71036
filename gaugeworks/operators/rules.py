"""Rules that the quality dimensions count: formats, ranges, order of dates, scales. Rows of counts, one for each column or rule."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import predicates as P
from gaugeworks.operators.aggregates import chosen, count_if, null_cell
from gaugeworks.operators.fields import long_rows

# fixed values: parts of names that tell what a column holds
DATE_NAMES = ("date", "time", "created", "updated", "timestamp", "birth", "expiry")
ID_WORDS = ("id", "key", "pk")
#: Rule, parts of a column's name, least and greatest value.
RANGES: tuple[tuple[str, tuple[str, ...], float | None, float | None], ...] = (
    ("age", ("age",), 0, 150),
    ("percent", ("percent", "rate"), 0, 100),
    ("count", ("count",), 0, None),
    ("year", ("year",), 1900, 2100),
)
#: Parts of the names of two columns of which the first comes before the second.
DATE_PAIRS = (("start_date", "end_date"), ("start", "end"), ("created_at", "updated_at"), ("created", "updated"), ("begin_date", "end_date"), ("from_date", "to_date"))


def likely_date_name(name: str) -> bool:
    return any(x in name.lower() for x in DATE_NAMES)


def name_words(name: str) -> list[str]:
    """The words of a snake, kebab, spaced or camel name."""
    return re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+|[^\W\d_a-zA-Z]+", name)


def likely_id_name(name: str) -> bool:
    return any(w.lower() in ID_WORDS for w in name_words(name))


def format_violations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column``, ``both`` (values with a dot and a comma), ``dots``, ``commas`` (with one alone), ``violations``, ``encoding_issues``."""
    found = chosen(df, columns)
    flat = {}
    for k, f in enumerate(found):
        t, ok = f.text, ~null_cell(f)
        dots, commas = [F.length(t) - F.length(F.replace(t, F.lit(x), F.lit(""))) for x in ".,"]
        flat |= {
            f"{k}_both": count_if(ok & (dots > 0) & (commas > 0)),
            f"{k}_dots": count_if(ok & (dots == 1) & (commas == 0)),
            f"{k}_commas": count_if(ok & (dots == 0) & (commas == 1)),
            f"{k}_encoding": count_if(ok & P.has_encoding_artifact(t)),
        }
    rows = {
        f.name: {
            "both": F.col(f"{k}_both"), "dots": F.col(f"{k}_dots"), "commas": F.col(f"{k}_commas"),
            "violations": F.col(f"{k}_both") + F.least(f"{k}_dots", f"{k}_commas"), "encoding_issues": F.col(f"{k}_encoding"),
        }
        for k, f in enumerate(found)
    }
    return long_rows(rows, df.agg(*[c.alias(n) for n, c in flat.items()]))


def date_formats(text: Column) -> list[Column]:
    """Whether a text has each of the date formats, in their order; no text has two."""
    return [F.coalesce(P.trimmed(text).rlike(P.one_of(pattern)), F.lit(False)) for pattern in P.DATE_FORMATS.values()]


def mixed_date_formats(df: DataFrame, column: str, order: list[str], head: int = 50) -> DataFrame:
    """``format``, ``n`` of a date column's first ``head`` values that aren't blank, in the named order."""
    f = chosen(df, [column])[0]
    first = df.where(F.coalesce(P.trimmed(f.text) != "", F.lit(False))).orderBy(*order).limit(head)
    kind = F.lit(None)
    for name, pattern in reversed(P.DATE_FORMATS.items()):
        kind = F.when(P.trimmed(f.text).rlike(P.one_of(pattern)), name).otherwise(kind)
    return first.select(kind.cast("string").alias("format")).where("format is not null").groupBy("format").agg(F.count(F.lit(1)).alias("n"))


def range_rules(name: str) -> list[tuple[str, float | None, float | None]]:
    """The range rules that a column's name calls for; several may."""
    return [(rule, low, high) for rule, parts, low, high in RANGES if any(x in name.lower() for x in parts)]


def range_violations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column``, ``rule``, ``checked`` (numbers), ``violations`` for each rule that a name calls for."""
    found = chosen(df, columns)
    flat, rows = {}, []
    for k, f in enumerate(found):
        for rule, low, high in range_rules(f.name):
            out = F.lit(False) if low is None else f.number < low
            out = out if high is None else out | (f.number > high)
            flat |= {f"{k}_{rule}_n": F.count(f.number), f"{k}_{rule}_v": count_if(out)}
            rows.append(F.struct(F.lit(f.name).alias("column"), F.lit(rule).alias("rule"), F.col(f"{k}_{rule}_n").alias("checked"), F.col(f"{k}_{rule}_v").alias("violations")))
    if not rows:
        return df.sparkSession.createDataFrame([], "column string, rule string, checked long, violations long")
    return df.agg(*[c.alias(n) for n, c in flat.items()]).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def negatives(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column``, ``checked``, ``negative`` of columns that should be positive."""
    found = chosen(df, columns)
    flat = {f"{k}_{w}": c for k, f in enumerate(found) for w, c in (("n", F.count(f.number)), ("v", count_if(f.number < 0)))}
    return long_rows({f.name: {"checked": F.col(f"{k}_n"), "negative": F.col(f"{k}_v")} for k, f in enumerate(found)}, df.agg(*[c.alias(n) for n, c in flat.items()]))




def timeliness(df: DataFrame, columns: list[str], as_of_year: int, stale_years: int = 5) -> DataFrame:
    """``column``, ``checked``, ``valid``, ``invalid``, ``future`` (year after ``as_of_year``), ``stale`` (over ``stale_years`` before)."""
    found = chosen(df, columns)
    # each cell's year is found once, then counted
    years = df.select(*[c for k, f in enumerate(found) for c in (F.year(f.moment if f.kind == "Date" else P.raw_moment(f.text)).alias(f"y{k}"), (~null_cell(f)).alias(f"ok{k}"))])
    flat = {}
    for k in range(len(found)):
        year, ok = F.col(f"y{k}"), F.col(f"ok{k}")
        flat |= {f"{k}_c": count_if(ok), f"{k}_v": count_if(ok & year.isNotNull()), f"{k}_f": count_if(year > as_of_year), f"{k}_s": count_if(year < as_of_year - stale_years)}
    rows = {f.name: {"checked": F.col(f"{k}_c"), "valid": F.col(f"{k}_v"), "invalid": F.col(f"{k}_c") - F.col(f"{k}_v"), "future": F.col(f"{k}_f"), "stale": F.col(f"{k}_s")} for k, f in enumerate(found)}
    return long_rows(rows, years.agg(*[c.alias(n) for n, c in flat.items()]))


def date_pairs(names: list[str], compat: bool = False) -> list[tuple[str, str]]:
    """Pairs of columns of which the first should not be later: for each rule the first names that fit. With ``compat`` a pair counts for each rule that it fits."""
    out = []
    for first, second in DATE_PAIRS:
        a = next((n for n in names if first in n.lower()), None)
        b = next((n for n in names if second in n.lower()), None)
        if a and b:
            out.append((a, b))
    return out if compat else [*dict.fromkeys(out)]


def order_violations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``first``, ``second``, ``checked`` (rows where both are dates), ``violations`` (the first is later)."""
    by = {f.name: f for f in chosen(df, None)}
    flat, rows = {}, []
    # each cell's moment is found once, then compared
    place = {n: i for i, n in enumerate(dict.fromkeys(n for p in pairs for n in p))}
    moments = df.select(*[by[n].moment.alias(f"m{i}") for n, i in place.items()])
    for k, (a, b) in enumerate(pairs):
        x, y = F.col(f"m{place[a]}"), F.col(f"m{place[b]}")
        flat |= {f"{k}_n": count_if(x.isNotNull() & y.isNotNull()), f"{k}_v": count_if(x > y)}
        rows.append(F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"{k}_n").alias("checked"), F.col(f"{k}_v").alias("violations")))
    if not rows:
        return df.sparkSession.createDataFrame([], "first string, second string, checked long, violations long")
    return moments.agg(*[c.alias(n) for n, c in flat.items()]).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def beyond(x: Column, quartiles: list[float | None], k: float = 1.5) -> Column:
    """Whether a number lies more than ``k`` interquartile ranges beyond the quartiles."""
    if quartiles[0] is None:
        return F.lit(False)
    spread = quartiles[-1] - quartiles[0]
    return (x < quartiles[0] - k * spread) | (x > quartiles[-1] + k * spread)


def outliers(df: DataFrame, columns: list[str], quartiles: dict[str, list[float | None]], k: float = 1.5) -> DataFrame:
    """``column``, ``checked``, ``outliers``: numbers beyond ``k`` interquartile ranges from the quartiles. Fewer than four have none."""
    found = chosen(df, columns)
    flat = {}
    for i, f in enumerate(found):
        out = beyond(f.number, quartiles[f.name], k)
        flat |= {f"{i}_n": F.count(f.number), f"{i}_o": count_if(out)}
    rows = {f.name: {"checked": F.col(f"{i}_n"), "outliers": F.when(F.col(f"{i}_n") >= 4, F.col(f"{i}_o")).otherwise(0)} for i, f in enumerate(found)}
    return long_rows(rows, df.agg(*[c.alias(n) for n, c in flat.items()]))


def hint_bindings(df: DataFrame, hints: dict[str, str]) -> DataFrame:
    """``column``, ``kind``, ``checked``, ``matched``: values that bear out a hint of kind positive, identifier or temporal."""
    by = {f.name: f for f in chosen(df, [*hints])}
    flat, rows = {}, []
    for k, (name, kind) in enumerate(hints.items()):
        f = by[name]
        ok = ~null_cell(f)
        fits = {"positive": f.number.isNotNull(), "temporal": f.moment.isNotNull() if f.kind == "Date" else P.raw_moment(f.text).isNotNull(), "identifier": ok}[kind]
        flat |= {f"{k}_c": count_if(ok), f"{k}_m": count_if(ok & fits)}
        rows.append(F.struct(F.lit(name).alias("column"), F.lit(kind).alias("kind"), F.col(f"{k}_c").alias("checked"), F.col(f"{k}_m").alias("matched")))
    return df.agg(*[c.alias(n) for n, c in flat.items()]).select(F.explode(F.array(*rows)).alias("r")).select("r.*")



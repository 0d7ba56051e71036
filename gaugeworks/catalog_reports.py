"""Queries over reports, patterns, check digits and quality, with SQL for what has to come out."""

from __future__ import annotations

import datetime as dt
import json
import math

from pyspark.sql import functions as F

from gaugeworks import errors
from gaugeworks.catalog import halved, query, r4, table, union
from gaugeworks.catalog_sources import literal, rows, values
from gaugeworks.functions import patterns as R
from gaugeworks.functions import predicates as P
from gaugeworks.functions.validators import piva_it, ssn_us
from gaugeworks.operators import frequencies as Q
from gaugeworks.operators.quantiles import exact_quantiles
from gaugeworks.plans import config
from gaugeworks.plans import quality as qual
from gaugeworks.plans.profile import Options, profile_frame, quick_quality_check
from gaugeworks.plans.report import Report, json_schema
from gaugeworks.sources.scratch import put

# whole reports

_ORDERS = (("o_orderkey", "Integer"), ("o_custkey", "Integer"), ("o_orderstatus", "String"), ("o_totalprice", "Float"), ("o_orderdate", "Date"), ("o_orderpriority", "String"))


def _record_sql(name: str, kind: str) -> str:
    numeric, text, date = kind in ("Integer", "Float"), kind == "String", kind == "Date"
    x = f"{name}::DOUBLE"
    cell = lambda yes, sql, t: f"{sql}::{t}" if yes else f"NULL::{t}"
    return f"""SELECT '{name}' AS column_name, '{kind}' AS data_type, count(*) AS total_count, count(*) FILTER (WHERE {name} IS NULL) AS null_count, count(DISTINCT {name}) AS unique_count,
{cell(numeric, f"round(avg({x}), 3)", "DOUBLE")} AS mean, {cell(numeric, f"round(stddev_samp({x}), 2)", "DOUBLE")} AS std_dev, {cell(numeric, f"round(quantile_cont({x}, 0.5), 3)", "DOUBLE")} AS median, {cell(numeric, f"round(quantile_cont({x}, 0.25), 2)", "DOUBLE")} AS q1, {cell(numeric, f"round(quantile_cont({x}, 0.75), 2)", "DOUBLE")} AS q3,
{cell(text, f"min(octet_length(encode({name}::VARCHAR)))", "BIGINT")} AS min_length, {cell(text, f"max(octet_length(encode({name}::VARCHAR)))", "BIGINT")} AS max_length, {cell(date, f"strftime(min({name}), '%Y-%m-%d')" if date else "NULL", "VARCHAR")} AS min_datetime, {cell(date, f"date_diff('day', min({name})::DATE, max({name})::DATE)" if date else "NULL", "DOUBLE")} AS duration_days FROM orders"""


_RECORD = ("column_name", "data_type", "total_count", "null_count", "unique_count", "mean", "std_dev", "median", "q1", "q3", "min_length", "max_length", "min_datetime", "duration_days")
_RECORD_TYPES = "column_name string, data_type string, total_count long, null_count long, unique_count long, mean double, std_dev double, median double, q1 double, q3 double, min_length long, max_length long, min_datetime string, duration_days double"
_RECORD_SQL = union([_record_sql(n, k) for n, k in _ORDERS])


def _records(spark, report: Report):
    digits = {"mean": 3, "std_dev": 2, "median": 3, "q1": 2, "q3": 2}
    found = [tuple(round(r[c], digits[c]) if c in digits and r[c] is not None else r[c] for c in _RECORD) for r in report.records()]
    return rows(spark, found, _RECORD_TYPES)


@query(_RECORD_SQL)
def profile_report(spark, d):
    """The whole report's records."""
    return _records(spark, profile_frame(table(spark, d, "orders")))


@query(_RECORD_SQL)
def report_saved(spark, d):
    """A report that was saved as JSON and read again."""
    report = profile_frame(table(spark, d, "orders"))
    again = Report.from_json(report.to_json())
    assert again.to_dict() == report.to_dict()
    return _records(spark, again)


_NUMBERS = [n for n, k in _ORDERS if k in ("Integer", "Float")]


@query(union([f"SELECT '{n}' AS \"column\", 'max' AS statistic, floor(max({n})::DOUBLE) AS value FROM orders UNION ALL SELECT '{n}', 'total_count', count(*)::DOUBLE FROM orders UNION ALL SELECT '{n}', 'median', floor(quantile_cont({n}::DOUBLE, 0.5)) FROM orders" for n in _NUMBERS]))
def report_describe(spark, d):
    """A report's numeric columns, turned: statistic by column."""
    found = profile_frame(table(spark, d, "orders"), Options(packs=("statistics",))).describe()
    return rows(spark, [(c, s, float(math.floor(found[s][c]))) for s in ("max", "total_count", "median") for c in found[s]], "column string, statistic string, value double")


@query("SELECT 'dataframe' AS source, count(*) AS records, 4 AS columns, round((100 - (count(*) FILTER (WHERE o_orderkey % 4 = 0)) * 100.0 / (count(*) * 4) + count(*) FILTER (WHERE o_orderkey % 4 <> 0) * 100.0 / count(*)) / 2, 2)::DOUBLE AS completeness FROM orders")
def report_summary(spark, d):
    """A report's scores in one record."""
    s = profile_frame(halved(spark, d), Options(packs=("quality",), dimensions=("completeness",))).quality_summary()
    return rows(spark, [(s["source"], s["rows"], s["columns"], round(s["completeness"], 2))], "source string, records long, columns int, completeness double")


@query("SELECT form, 6::BIGINT AS records FROM (SELECT unnest(['arrow', 'csv', 'html', 'markdown', 'pandas', 'parquet', 'spark']) AS form)")
def report_exports(spark, d):
    """A report's columns in every form that it is exported in."""
    import tempfile

    import pyarrow.parquet as pq

    report, folder = profile_frame(table(spark, d, "orders"), Options(packs=("schema", "statistics"))), tempfile.mkdtemp(prefix="gaugeworks-")
    for ending in ("csv", "parquet", "json"):
        report.save(f"{folder}/r.{ending}")
    with open(f"{folder}/r.csv", encoding="utf-8") as f:
        csv_rows = sum(1 for _ in f) - 1
    assert Report.load(f"{folder}/r.json").to_dict() == report.to_dict()
    found = {
        "arrow": report.to_arrow().num_rows, "csv": csv_rows, "html": report.to_html().count("<tr><td>"), "markdown": report.to_markdown().count("| o_"),
        "pandas": len(report.to_pandas()), "parquet": pq.read_metadata(f"{folder}/r.parquet").num_rows, "spark": report.to_spark(spark).count(),
    }
    return rows(spark, sorted(found.items()), "form string, records long")


@query(values([(1, "gone", "all null"), (2, "half", "75% null"), (3, "one", "constant"), (4, "some", "25.0% null")], "place, \"column\", flag"))
def report_flags(spark, d):
    """What a summary tells first: the gravest flags, whatever the columns' order."""
    k = F.col("n_nationkey")
    first = table(spark, d, "nation").where(k < 24)
    df = first.select(F.when(k % 4 != 0, k).alias("some"), F.lit("x").alias("one"), F.when(k % 4 == 0, k).alias("half"), F.lit(None).cast("string").alias("gone"), k.alias("whole"))
    text = profile_frame(df, Options(packs=("schema", "statistics"))).to_llm_context(400)
    lines = text.partition("flags:\n")[2].partition("\nschema:")[0].splitlines()
    return rows(spark, [(n, *x.removeprefix("- ").split(": ", 1)) for n, x in enumerate(lines, 1)], "place int, column string, flag string")


@query(values([(20, True, False), (60, True, False), (400, True, True)], "tokens, within, has_schema"))
def report_context(spark, d):
    """Summaries within a number of tokens."""
    report = profile_frame(table(spark, d, "orders"), Options(packs=("schema", "statistics")))
    texts = [(n, report.to_llm_context(n)) for n in (20, 60, 400)]
    return rows(spark, [(n, -(-len(x) // 4) <= max(n, -(-len(x.splitlines()[0]) // 4)), "o_orderpriority String" in x) for n, x in texts], "tokens int, within boolean, has_schema boolean")


@query("SELECT 'o_custkey' AS \"column\", 0.0::DOUBLE AS null_a, round(count(*) FILTER (WHERE o_orderkey % 4 = 0) * 100.0 / count(*), 3)::DOUBLE AS null_b FROM orders UNION ALL SELECT unnest(['o_orderkey', 'o_totalprice']), 0.0, 0.0 UNION ALL SELECT unnest(['o_orderstatus', 'o_orderdate', 'o_orderpriority']), 0.0, NULL UNION ALL SELECT 'o_year', NULL, 0.0")
def compare_null_drift(spark, d):
    """Null percentages of two reports, over all columns of either."""
    o = Options(packs=("schema",))
    got = profile_frame(table(spark, d, "orders"), o).compare(profile_frame(halved(spark, d), o))["null_percentage"]
    cell = lambda v: None if v is None else round(float(v), 3)
    return rows(spark, [(n, cell(x["a"]), cell(x["b"])) for n, x in got.items()], "column string, null_a double, null_b double")


@query("SELECT unnest(['o_orderkey', 'o_custkey', 'o_totalprice', 'o_orderstatus', 'o_orderdate', 'o_orderpriority', 'o_year']) AS \"column\", unnest(['common', 'common', 'common', 'removed', 'removed', 'removed', 'added']) AS change")
def schema_diff(spark, d):
    """Columns that came, went and stayed, from two reports."""
    o = Options(packs=("schema",))
    got = profile_frame(table(spark, d, "orders"), o).compare(profile_frame(halved(spark, d), o))["schema"]
    return rows(spark, [(c, what) for what in ("added", "removed", "common") for c in got[what]], "column string, change string")


@query("""WITH f AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS gone FROM orders), s AS (SELECT 100.0 AS a, (100 - gone * 100.0 / (n * 4) + (n - gone) * 100.0 / n) / 2 AS b FROM f)
SELECT 'completeness' AS dimension, a::DOUBLE AS a, round(b, 3)::DOUBLE AS b FROM s UNION ALL SELECT 'uniqueness', 100.0, 100.0 UNION ALL SELECT 'overall', 100.0, round((0.25 * b + 0.15 * 100) / 0.4, 3)::DOUBLE FROM s""")
def compare_reports(spark, d):
    """Two reports' scores."""
    o = Options(packs=("quality",), dimensions=("completeness", "uniqueness"))
    got = profile_frame(table(spark, d, "orders"), o).compare(profile_frame(halved(spark, d), o))
    cells = {**{n: x for n, x in got["dimensions"].items() if x["a"] is not None}, "overall": got["score"]}
    return rows(spark, [(n, round(x["a"], 3), round(x["b"], 3)) for n, x in cells.items()], "dimension string, a double, b double")


@query(values([(k, True) for k in ("columns", "execution", "id", "schema_version", "source", "timestamp")], "key, required"))
def report_json_schema(spark, d):
    """The JSON Schema's required keys, all of which a report's document has."""
    schema, doc = json_schema(), json.loads(profile_frame(table(spark, d, "region"), Options(packs=("schema",))).to_json())
    asked = {"columns", "execution", "id", "schema_version", "source", "timestamp"}
    assert set(schema["properties"]) == set(doc)
    return rows(spark, [(k, k in schema["required"] and k in doc) for k in sorted(asked)], "key string, required boolean")


@query(values([("version 0 is read", None), ("a newer version", "ReportError"), ("no number", "ReportError"), ("no report", "ReportError"), ("no JSON", "ReportError")], "document, error"))
def report_versions(spark, d):
    """Documents of other versions, and none."""
    doc = profile_frame(table(spark, d, "region"), Options(packs=("schema",))).to_dict()
    old = {k: v for k, v in doc.items() if k != "schema_version"}
    calls = {"version 0 is read": json.dumps(old, default=str), "a newer version": json.dumps(doc | {"schema_version": 99}, default=str), "no number": json.dumps(doc | {"schema_version": "1"}, default=str), "no report": "[1]", "no JSON": "{"}
    out = []
    for n, text in calls.items():
        try:
            Report.from_json(text)
            out.append((n, None))
        except errors.ReportError as e:
            out.append((n, type(e).__name__))
    return rows(spark, out, "document string, error string")


@query(values([("packs", "schema,quality"), ("profile", "strict"), ("top", "3"), ("max_rows", "100"), ("weight", "0.5"), ("bad", "OptionError")], "setting, value"))
def settings_file(spark, d):
    """Settings from a TOML file and the environment."""
    import tempfile
    from pathlib import Path

    path = Path(tempfile.mkdtemp(prefix="gaugeworks-")) / "gaugeworks.toml"
    path.write_text('packs = ["schema", "quality"]\nprofile = "strict"\ntop = 5\n[weights]\nvalidity = 0.5\n')
    c = config.load(path, {"GAUGEWORKS_TOP": "3", "GAUGEWORKS_MAX_ROWS": "100"})
    path.write_text('packs = ["everything"]\n')
    try:
        config.load(path, {})
        bad = ""
    except errors.OptionError as e:
        bad = type(e).__name__
    o = c.options()
    return rows(spark, [("packs", ",".join(o.packs)), ("profile", c.profile), ("top", str(o.top)), ("max_rows", str(o.max_rows)), ("weight", str(o.thresholds.weights["validity"])), ("bad", bad)], "setting string, value string")


@query("SELECT p.pack, p.stats, p.patterns, p.quality FROM (VALUES ('schema', false, false, false), ('statistics', true, false, false), ('patterns', false, true, false), ('quality', false, false, true)) AS p(pack, stats, patterns, quality)")
def metric_packs(spark, d):
    """What each pack adds to a report."""
    out = []
    for pack in ("schema", "statistics", "patterns", "quality"):
        r = profile_frame(table(spark, d, "region"), Options(packs=(pack,)))
        out.append((pack, bool(r["r_regionkey"].stats), r["r_name"].patterns is not None, r.quality is not None))
    return rows(spark, out, "pack string, stats boolean, patterns boolean, quality boolean")


@query("SELECT least(500, count(*)) AS records, CASE WHEN count(*) > 500 THEN 'max_rows' END AS reason, count(*) <= 500 AS whole, least(500, count(*)) AS keys FROM orders")
def max_rows(spark, d):
    """A report's row limit: all its facts come from the same rows."""
    r = profile_frame(table(spark, d, "orders"), Options(max_rows=500))
    return rows(spark, [(r.execution.rows_processed, r.execution.truncation_reason, r.execution.source_exhausted, r["o_orderkey"].unique_count)], "records long, reason string, whole boolean, keys long")


@query("SELECT 'mostly' AS \"column\", 'Float' AS data_type, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS invalid_count FROM orders UNION ALL SELECT 'keys', 'Integer', 0 FROM (SELECT 1)")
def invalid_counts(spark, d):
    """Values that aren't what their column is."""
    k = F.col("o_orderkey")
    df = table(spark, d, "orders").select(F.when(k % 10 == 0, "n/a").otherwise(k.cast("string")).alias("mostly"), k.cast("string").alias("keys"))
    r = profile_frame(df, Options(packs=("schema",)))
    return rows(spark, [(c.name, c.data_type, c.invalid_count) for c in r.columns], "column string, data_type string, invalid_count long")


@query("SELECT 'log' AS \"column\", 'String' AS data_type, count(DISTINCT n_name) AS unique_count, min(n_name || ' ' || repeat('x', 300)) AS top FROM nation UNION ALL SELECT 'digits', 'Float', count(*), NULL FROM nation UNION ALL SELECT 'digest', 'String', count(*), min('sha256:' || sha256(n_name)) FROM nation")
def long_values(spark, d):
    """Texts and numbers of hundreds of signs: types, distinct values and the values themselves are those of short ones."""
    n = F.col("n_name")
    df = table(spark, d, "nation").select(F.concat(n, F.lit(" " + "x" * 300)).alias("log"), F.concat(F.lpad(F.col("n_nationkey").cast("string"), 300, "7"), F.lit(".5")).alias("digits"), F.concat(F.lit("sha256:"), F.sha2(n, 256)).alias("digest"))
    r = profile_frame(df, Options(packs=("schema", "statistics")))
    first = lambda c: c.stats["most_frequent"][0]["value"] if c.stats.get("most_frequent") else None
    return rows(spark, [(c.name, c.data_type, c.unique_count, first(c)) for c in r.columns], "column string, data_type string, unique_count long, top string")


# lexical forms

_DAYS = ("%Y-%m-%d", "%d/%m/%Y", "%d.%m.%Y", " %Y-%m-%d", "%Y-%m-%dT%H:00+02", "%-d/%-m/%Y")


@query("SELECT form, CAST(o_orderdate AS DATE) IS NOT NULL AS is_day, regexp_matches(day, '^(\\d{4}-\\d{2}-\\d{2}$|\\d{2}/\\d{2}/\\d{4}$|\\d{2}-\\d{2}-\\d{4}$|\\d{4}/\\d{2}/\\d{2}$|\\d{2}\\.\\d{2}\\.\\d{4}$|\\d{4}-\\d{2}-\\d{2}T\\d{2}:)') AS looks, regexp_full_match(trim(day), '\\d{4}-\\d{1,2}-\\d{1,2}|\\d{1,2}/\\d{1,2}/\\d{4}|\\d{1,2}-\\d{1,2}-\\d{4}|\\d{4}/\\d{2}/\\d{2}') AS valid, count(*) AS n FROM (" + union([f"SELECT {k} AS form, o_orderdate, strftime(o_orderdate, '{f}') AS day FROM orders" for k, f in enumerate(_DAYS)]) + ") GROUP BY 1, 2, 3, 4")
def date_shapes(spark, d):
    """Texts that look like dates as they stand, and those of a valid date's shape."""
    forms = ("yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy", " yyyy-MM-dd", "yyyy-MM-dd'T'HH:00'+02'", "d/M/yyyy")
    o = table(spark, d, "orders")
    cells = F.array(*[F.struct(F.lit(k).alias("form"), F.date_format("o_orderdate", f).alias("day")) for k, f in enumerate(forms)])
    each = o.select(F.col("o_orderdate").isNotNull().alias("is_day"), F.explode(cells).alias("c")).select("is_day", "c.form", "c.day")
    return each.groupBy("form", "is_day", P.looks_like_date(F.col("day")).alias("looks"), P.is_valid_date(P.trimmed(F.col("day"))).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'a\\tb\\nc' AS plain, '\\x1b[0m \\ufeff' AS signs")
def escaped_values(spark, d):
    """Control signs of a value, spelled out."""
    return rows(spark, [(P.one_line("a\tb\nc"), P.one_line("\x1b[0m \ufeff"))], "plain string, signs string")


@query("SELECT '4c2a45dd8b04ddad' AS abc, true AS stable")
def fixed_hash(spark, d):
    """Hashes are of a fixed seed: the same in every session."""
    got = spark.range(1).select(F.lower(F.hex(F.xxhash64(F.lit("abc")))).alias("x"), F.lower(F.hex(F.xxhash64(F.lit("abc")))).alias("y")).first()
    import xxhash

    return rows(spark, [("4c2a45dd8b04ddad" if got["x"] == f"{xxhash.xxh64_intdigest(b'abc', 42):x}" else got["x"], got["x"] == got["y"])], "abc string, stable boolean")


# patterns: samples of every pattern, good ones and near misses

#: Pattern, values that match it, values that match it but fail its check digits or ranges.
_SAMPLES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("Email", ("a.b+c@example.org", "x@y.it"), ()),
    ("Phone (US)", ("+1 (555) 123-4567", "555.123.4567"), ()),
    ("Phone (IT)", ("+39 06 1234567", "0039-333-1234567"), ()),
    ("URL", ("https://a.b/c?d=e", "ftp://h/x"), ()),
    ("UUID", ("123e4567-e89b-12d3-a456-426614174000",), ()),
    ("IPv4", ("10.0.0.1", "255.255.255.255"), ()),
    ("IPv6", ("2001:db8::1", "::1"), ("1:2:3", ":::")),
    ("MAC Address", ("00:1B:44:11:3A:B7", "00-1b-44-11-3a-b7"), ()),
    ("Geographic Coordinates", ("45.4642, 9.19", "-33.86,151.2"), ()),
    ("IBAN", ("DE89370400440532013000", "GB82WEST12345698765432"), ("DE00370400440532013000",)),
    ("Codice Fiscale (IT)", ("RSSMRA85T10A562S",), ("RSSMRA85T10A562A",)),
    ("P.IVA (IT)", ("00743110157",), ("12345678901",)),
    ("File Path (Unix)", ("/usr/local/bin", "/a b/c/"), ()),
    ("File Path (Windows)", ("C:\\a\\b.txt", "D:\\"), ()),
    ("Credit Card", ("4111 1111 1111 1111", "5500-0000-0000-0004"), ("4111 1111 1111 1112",)),
    ("SSN (US)", ("123-45-6789",), ("000-12-3456", "666-12-3456")),
    ("UK Postcode", ("SW1A 1AA", "M1 1AE"), ()),
    ("Canadian Postal Code", ("K1A 0B1",), ()),
    ("Hex Color", ("#a1B2c3",), ()),
    ("SWIFT/BIC", ("DEUTDEFF", "DEUTDEFF500"), ()),
    ("Currency", ("$1,234.56", "12.50 €"), ()),
    ("Percentage", ("12.5%", "-3 %"), ()),
    ("Alphanumeric Code", ("ABC-123", "AB_42"), ()),
    ("Scientific Notation", ("1.5e10", "-2E-3"), ()),
    ("Labeled Identifier", ("user_42", "item-a"), ()),
    ("Date (ISO)", ("2024-01-31",), ()),
    ("Date (EU slash)", ("31/01/2024",), ()),
    ("Date (EU dash)", ("31-01-2024",), ()),
    ("Date (YYYY/MM/DD)", ("2024/01/31",), ()),
    ("Date (EU dot)", ("31.01.2024",), ()),
    ("DateTime (ISO)", ("2024-01-31T10:00:00Z", "2024-01-31T10:" + "0" * 5000), ()),
    ("ZIP Code (US)", ("12345-6789",), ()),
    ("CAP (IT)", ("00118",), ("00001",)),
)
_TEXTS = sorted({x for _, good, bad in _SAMPLES for x in (*good, *bad)} | {"plain words", "12", "none at all, or is there?", "a" * 5000 + "_b", "//x", "C:/a", "1,2,3"})


def _sampled_sql() -> str:
    texts = "[" + ", ".join(literal(x) for x in _TEXTS) + "]"
    cells = f"(SELECT {texts}[1 + c_custkey % {len(_TEXTS)}] AS x FROM customer)"
    checked = {n: good for n, good, bad in _SAMPLES if next(p for p in R.CATALOGUE if p.name == n).validator}
    parts = []
    for p in R.CATALOGUE:
        match = f"regexp_matches(x, {literal(p.regex.replace(chr(92) + 'x00', chr(92) + 'x{00}'))})"
        valid = match + (f" AND x IN ({', '.join(literal(x) for x in _valid(p.name, checked))})" if p.validator else "")
        parts.append(f"SELECT {literal(p.name)} AS pattern, count(*) FILTER (WHERE {match}) AS match_count, count(*) FILTER (WHERE {valid}) AS valid_count FROM {cells}")
    return f"SELECT * FROM ({union(parts)}) WHERE match_count > 0"


def _valid(name: str, checked: dict) -> tuple[str, ...]:
    """Values that pass a pattern's check: its own samples, and of another's those named here."""
    return checked[name] + {"SSN (US)": ("12345-6789",)}.get(name, ())


@query(_sampled_sql())
def pattern_samples(spark, d):
    """Every pattern of the catalogue over values that match it, near misses and long texts, and what passes the checks."""
    text = F.element_at(F.array(*[F.lit(x) for x in _TEXTS]), (F.col("c_custkey") % len(_TEXTS) + 1).cast("int"))
    return Q.pattern_counts(table(spark, d, "customer").select(text.alias("x")), ["x"]).select("pattern", "match_count", "valid_count")


@query(values([("ABI", "12345678903", True), ("ABI", "12345678901", False), ("SSN", "123-45-6789", True), ("SSN", "900-12-3456", False)], "kind, value, valid"))
def check_digits(spark, d):
    """Numbers with a check digit or forbidden ranges."""
    given = (("ABI", "12345678903"), ("ABI", "12345678901"), ("SSN", "123-45-6789"), ("SSN", "900-12-3456"))
    x = F.col("value")
    return rows(spark, given, "kind string, value string").withColumn("valid", F.when(F.col("kind") == "ABI", piva_it(x)).otherwise(ssn_us(x)))


_TOPS = (("email", "Email", "contact"), ("ip", "IPv4", "network"), ("code", "Alphanumeric Code", "identifier"), ("day", "Date (ISO)", "other"))


@query("WITH p AS (SELECT count(*) AS n, count(*) FILTER (WHERE regexp_full_match('AB-' || c_custkey, '[A-Z]{2,}[_-]\\d{2,}')) AS codes, count(*) FILTER (WHERE c_custkey % 300 <= 255) AS ips FROM customer) " + union([f"SELECT '{c}' AS \"column\", '{p}' AS pattern, '{k}' AS category, { {'code': 'codes', 'ip': 'ips'}.get(c, 'n') } AS match_count FROM p" for c, p, k in _TOPS]))
def patterns_detected(spark, d):
    """The surest pattern that columns show, after overlaps."""
    from gaugeworks.catalog import patterned

    masks: dict = {}
    for r in Q.pattern_masks(patterned(spark, d)).collect():
        masks.setdefault(r["column"], {})[r["mask"]] = r["n"]
    best = {c: R.detect(m)[:1] for c, m in masks.items()}
    return rows(spark, [(c, p["name"], p["category"], p["match_count"]) for c, found in best.items() for p in found if c in {x[0] for x in _TOPS}], "column string, pattern string, category string, match_count long")


@query(values([(p.name, p.category, p.locale, p.threshold) for p in R.CATALOGUE if p.locale in (None, "IT")], "name, category, locale, min_threshold"))
def list_patterns(spark, d):
    """The catalogue, with the patterns of one country."""
    return rows(spark, [(p["name"], p["category"], p["locale"], p["min_threshold"]) for p in R.list_patterns("it-IT")], "name string, category string, locale string, min_threshold double")


# quality

_OUT = lambda c: f"count(*) FILTER (WHERE {c} < (SELECT quantile_cont({c}::DOUBLE, 0.25) - 1.5 * (quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25)) FROM supplier) OR {c} > (SELECT quantile_cont({c}::DOUBLE, 0.75) + 1.5 * (quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25)) FROM supplier))"
_DIGITS = "length(rtrim(split_part(s_acctbal::DECIMAL(18,2)::VARCHAR, '.', 2), '0'))"


@query(f"""WITH f AS (SELECT count(*) AS n, {_OUT('s_suppkey')} + {_OUT('s_nationkey')} + {_OUT('s_acctbal')} AS outliers FROM supplier),
u AS (SELECT count(DISTINCT (s_suppkey, s_name, s_nationkey, s_acctbal)) AS n FROM supplier), sc AS (SELECT {_DIGITS} AS digits, count(*) AS n FROM supplier GROUP BY 1), p AS (SELECT 100.0 * max(n) / sum(n) AS score FROM sc),
s AS (SELECT 100.0 AS completeness, 100.0 AS consistency, u.n * 100.0 / f.n AS uniqueness, 100 - outliers * 100.0 / (3 * f.n) AS accuracy, p.score AS precision_ FROM f, u, p)
SELECT 'completeness' AS dimension, round(completeness, 3)::DOUBLE AS score FROM s UNION ALL SELECT 'consistency', round(consistency, 3) FROM s UNION ALL SELECT 'uniqueness', round(uniqueness, 3) FROM s UNION ALL SELECT 'accuracy', round(accuracy, 3) FROM s UNION ALL SELECT 'precision', round(precision_, 3) FROM s
UNION ALL SELECT 'timeliness', NULL UNION ALL SELECT 'validity', NULL UNION ALL SELECT 'overall', round((0.25 * completeness + 0.2 * consistency + 0.15 * uniqueness + 0.15 * accuracy + 0.05 * precision_) / 0.8, 3) FROM s""")
def quality_dimensions(spark, d):
    """All dimensions of suppliers; those that have nothing to judge aren't assessed."""
    df = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    report = profile_frame(df, Options(packs=("quality",), as_of=dt.date(1999, 1, 1)))
    cells = {**report.dimension_scores, "overall": report.score}
    return rows(spark, [(k, None if v is None else round(float(v), 3)) for k, v in cells.items()], "dimension string, score double")


@query("SELECT 'order_date' AS \"column\", count(*) AS checked, 0::BIGINT AS invalid, count(*) FILTER (WHERE year(o_orderdate) > 1996) AS future, count(*) FILTER (WHERE year(o_orderdate) < 1991) AS stale, count(*) AS pairs, 0::BIGINT AS violations FROM orders")
def quality_timeliness(spark, d):
    """A report's facts on dates and pairs of dates."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    df = table(spark, d, "orders").select(day.alias("start_date"), day.alias("end_date"), day.alias("order_date"))
    facts = profile_frame(df.select("order_date"), Options(packs=("quality",), dimensions=("timeliness",), as_of=dt.date(1996, 6, 1))).quality["timeliness"]
    pairs = profile_frame(df.select("start_date", "end_date"), Options(packs=("quality",), dimensions=("timeliness",), as_of=dt.date(1996, 6, 1))).quality["timeliness"]
    return rows(spark, [("order_date", facts["checked"], facts["invalid"], facts["future"], facts["stale"], pairs["pairs"], pairs["pair_violations"])], "column string, checked long, invalid long, future long, stale long, pairs long, violations long")


@query("SELECT count(*) AS checked, count(*) FILTER (WHERE regexp_full_match(mail, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}')) AS valid, 'Email' AS pattern FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'none' ELSE 'u' || c_custkey || '@example.com' END AS mail FROM customer)")
def quality_validity(spark, d):
    """Values that fit the pattern which their column shows."""
    k = F.col("c_custkey")
    df = table(spark, d, "customer").select(F.when(k % 5 == 0, "none").otherwise(F.concat(F.lit("u"), k.cast("string"), F.lit("@example.com"))).alias("mail"))
    (_, name, checked, valid), = profile_frame(df, Options(packs=("quality",), dimensions=("validity",))).quality["validity"]["columns"]
    return rows(spark, [(checked, valid, name)], "checked long, valid long, pattern string")


@query(values([("default", 0.5, 0.95, 1.5, 5), ("strict", 0.3, 0.98, 1.5, 2), ("lenient", 0.7, 0.9, 2.0, 10)], "profile, null_column, high_cardinality, outlier_factor, stale_years"))
def threshold_profiles(spark, d):
    """The limits of each threshold profile."""
    return rows(spark, [(n, t.null_column, t.high_cardinality, t.outlier_factor, t.stale_years) for n, t in qual.PROFILES.items()], "profile string, null_column double, high_cardinality double, outlier_factor double, stale_years int")


@query("SELECT 'region' AS \"table\", count(*) < 10 AS low_sample, 0.0::DOUBLE AS nothing FROM region UNION ALL SELECT 'nation', count(*) < 10, 0.0 FROM nation")
def quality_small_tables(spark, d):
    """Tables of too few rows are flagged; one without rows scores nothing."""
    o = Options(packs=("quality",))
    nothing = profile_frame(table(spark, d, "region").where("false"), o)
    return rows(spark, [(t, profile_frame(table(spark, d, t), o).quality["low_sample_warning"], float(nothing.score)) for t in ("region", "nation")], "table string, low_sample boolean, nothing double")


@query(values([("exact", "completeness", "exact"), ("exact", "uniqueness", "exact"), ("sketched", "completeness", "exact"), ("sketched", "uniqueness", "sketched"), ("sampled", "completeness", "sampled"), ("sampled", "uniqueness", "sampled")], "report, dimension, provenance"))
def quality_provenance(spark, d):
    """How each dimension is known."""
    df, base = table(spark, d, "nation"), dict(packs=("quality",), dimensions=("completeness", "uniqueness"))
    reports = {"exact": profile_frame(df, Options(**base)), "sketched": profile_frame(df, Options(exact=False, **base)), "sampled": profile_frame(df, Options(max_rows=10, **base))}
    return rows(spark, [(n, k, v) for n, r in reports.items() for k, v in r.quality["provenance"].items()], "report string, dimension string, provenance string")


@query("SELECT round((0.25 * 100 + 0.2 * 100 + 0.15 * 100 + 0.15 * 100) / 0.75, 3)::DOUBLE AS score FROM (SELECT 1)")
def quick_check(spark, d):
    """The overall score alone."""
    return rows(spark, [(round(quick_quality_check(spark, table(spark, d, "region").select("r_regionkey", "r_name")), 3),)], "score double")


@query(union([f"SELECT '{c}' AS \"column\", true AS within FROM (SELECT 1)" for c in ("l_orderkey", "l_partkey", "l_returnflag")]))
def distinct_sketch(spark, d):
    """Distinct values by sketches of parts, united: within three percent of the exact ones."""
    from gaugeworks.operators import aggregates as A

    names = ["l_orderkey", "l_partkey", "l_returnflag"]
    df = table(spark, d, "lineitem")
    united = A.united(A.distinct_sketches(df, F.pmod("l_orderkey", F.lit(8)), names))
    exact = Q.distinct_counts(df, names).withColumnRenamed("distinct_count", "exact")
    return united.join(exact, "column").select("column", (F.abs(F.col("distinct_count") - F.col("exact")) <= F.greatest(F.lit(1), F.col("exact") * 0.03)).alias("within"))


@query(union([f"SELECT '{c}' AS \"column\", quantile_cont({c}, 0.01)::DOUBLE AS p01, quantile_cont({c}, 0.99)::DOUBLE AS p99 FROM orders" for c in ("o_totalprice", "o_custkey")]))
def extreme_quantiles(spark, d):
    """Exact quantiles near the ends."""
    found = exact_quantiles(table(spark, d, "orders"), {c: F.col(c).cast("double") for c in ("o_totalprice", "o_custkey")}, (0.01, 0.99))
    return rows(spark, [(c, *v) for c, v in found.items()], "column string, p01 double, p99 double")


# samples by chance: what any of them has to be


@query("SELECT 'random' AS sample, 1000::BIGINT AS n, true AS whole_rows, true AS same_again UNION ALL SELECT 'weighted', 100, true, true UNION ALL SELECT 'reservoirs', (SELECT sum(least(50, n))::BIGINT FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)), true, true")
def samples_by_chance(spark, d):
    """Samples by chance have their size, hold rows of the table, none twice, and are the same each time."""
    from gaugeworks.operators import sampling

    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    out = []
    for name, draw in (("random", lambda: sampling.random(o, 1000)), ("weighted", lambda: sampling.weighted(o, 100, "o_totalprice")), ("reservoirs", lambda: sampling.reservoirs(o, "o_orderstatus", 50))):
        got = sorted(r["o_orderkey"] for r in draw().collect())
        inside = o.where(F.col("o_orderkey").isin(got)).count()
        out.append((name, len(got), inside == len(got) == len(set(got)), got == sorted(r["o_orderkey"] for r in draw().collect())))
    return rows(spark, out, "sample string, n long, whole_rows boolean, same_again boolean")


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders), s AS (SELECT unnest([100, 200, 400, 800, 1600, 3200, 6400, 12800, 25600, 51200, 100000]) AS size),
e AS (SELECT size, greatest(stddev_samp(o_totalprice) / sqrt(count(*)) / abs(avg(o_totalprice)), stddev_samp(o_orderkey) / sqrt(count(*)) / abs(avg(o_orderkey))) AS err FROM s JOIN o ON p < size GROUP BY size)
SELECT o_orderkey FROM o WHERE p < coalesce((SELECT min(size) FROM e WHERE err <= 1 - 0.98), 100000)""")
def sample_progressive(spark, d):
    """Rows in their order until the means are sure to two percent."""
    from gaugeworks.operators import sampling

    return sampling.progressive(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 100, 0.98, 100_000, ["o_orderkey"]).select("o_orderkey")

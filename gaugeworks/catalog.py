"""Queries over the test tables, one for each operator, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import patterns as R
from gaugeworks.functions import predicates as P
from gaugeworks.operators import aggregates as A
from gaugeworks.operators import frequencies as Q
from gaugeworks.operators import rules, sampling
from gaugeworks.operators.fields import spread
from gaugeworks.operators.quantiles import exact_quantiles
from gaugeworks.plans import fastpaths
from gaugeworks.plans.profile import Options, profile_frame
from gaugeworks.sources.files import json_records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(df: DataFrame, columns: list[str]) -> DataFrame:
    """Some columns, dealt to all cores if the table comes in fewer parts."""
    return spread(df.select(*columns))


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r4(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 4).alias(c) if c in names else c for c in df.columns])


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# numbers


@query(union([f"SELECT '{c}' AS \"column\", count({c}) AS n, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std_dev, round(var_samp({c}), 2) AS variance, round(stddev_samp({c}) / abs(avg({c})) * 100, 4) AS coefficient_of_variation, quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS median, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM lineitem" for c in NUMBERS]))
def numeric_profile(spark, d):
    """Counts, range, moments and exact quartiles of lineitem's numbers."""
    df = shared(table(spark, d, "lineitem"), [*NUMBERS])
    found = A.chosen(df, [*NUMBERS])
    q = exact_quantiles(df, {f.name: f.number for f in found})
    quartiles = spark.createDataFrame([(n, *v) for n, v in q.items()], "column string, q1 double, median double, q3 double")
    out = A.numeric_profile(df, [*NUMBERS]).drop("skewness", "kurtosis").withColumn("variance", F.round("variance", 2))
    return r4(out, "mean", "std_dev", "coefficient_of_variation").join(F.broadcast(quartiles), "column")


@query(union([f"SELECT '{c}' AS \"column\", round(avg(power((x - m) / sd, 3)), 4) AS skewness, round(avg(power((x - m) / sd, 4)) - 3, 4) AS kurtosis FROM (SELECT {c}::DOUBLE AS x, avg({c}) OVER () AS m, stddev_samp({c}) OVER () AS sd FROM lineitem)" for c in NUMBERS]))
def moments(spark, d):
    """Skewness and excess kurtosis with the sample's deviation."""
    return r4(A.numeric_profile(table(spark, d, "lineitem"), [*NUMBERS]).select("column", "skewness", "kurtosis"), "skewness", "kurtosis")


def _mode_sql(c: str, t: str) -> str:
    return f"SELECT '{c}' AS \"column\", CASE WHEN n > 1 THEN x END AS mode, n AS mode_count FROM (SELECT {c}::DOUBLE AS x, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, x LIMIT 1)"


@query(union(["SELECT * FROM (" + _mode_sql(c, t) + ")" for c, t in (("p_size", "part"), ("p_retailprice", "part"))]))
def mode_smallest(spark, d):
    """The most frequent number; the smallest of several."""
    return Q.modes(table(spark, d, "part"), ["p_size", "p_retailprice"])


@query(union([f"SELECT '{c}' AS \"column\", count({c}) AS checked, count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers FROM {t}, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {t})" for c, t in (("o_totalprice", "orders"),)]))
def outliers_iqr(spark, d):
    """Numbers beyond one and a half interquartile ranges."""
    df = table(spark, d, "orders").select("o_totalprice")
    q = exact_quantiles(df, {"o_totalprice": F.col("o_totalprice")})
    return rules.outliers(df, ["o_totalprice"], q)


DISTINCT = {"lineitem": ("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate"), "orders": ("o_orderkey", "o_custkey", "o_orderpriority")}


@query(union([f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count FROM {t}" for t, cs in DISTINCT.items() for c in cs]))
def distinct_counts(spark, d):
    """Exact distinct values, all columns of a table in one shuffle."""
    parts = [Q.distinct_counts(table(spark, d, t), [*cs]).select(F.lit(t).alias("table"), "column", "distinct_count") for t, cs in DISTINCT.items()]
    return parts[0].unionByName(parts[1])


# texts


@query(union([f"SELECT '{c}' AS \"column\", min(octet_length(encode({c})))::INTEGER AS min_length, max(octet_length(encode({c})))::INTEGER AS max_length, round(avg(octet_length(encode({c}))), 4) AS avg_length FROM {t} WHERE {c} IS NOT NULL AND lower(trim({c}, chr(9) || chr(10) || chr(13) || ' ')) NOT IN ('', 'null', 'nan')" for c, t in (("text", "documents"), ("lang", "documents"))]))
def text_lengths(spark, d):
    """Lengths in bytes."""
    return r4(A.text_lengths(table(spark, d, "documents"), ["text", "lang"]), "avg_length")


@query("SELECT CASE WHEN n = 0 THEN 0 ELSE least(31, floor(log2(n))::INTEGER + 1) END AS bucket, count(*) AS n FROM (SELECT octet_length(encode(html)) AS n FROM pages WHERE trim(html) <> '') GROUP BY 1")
def length_buckets(spark, d):
    """Texts by the power of two that their length reaches."""
    return A.length_histogram(table(spark, d, "pages"), "html")


def _ranked_sql(order: str) -> str:
    return union([f"SELECT '{c}' AS \"column\", rank::INTEGER AS rank, value, n, round(n * 100.0 / total, 4) AS percentage FROM (SELECT {c} AS value, count(*) AS n, sum(count(*)) OVER () AS total, row_number() OVER (ORDER BY {order}, {c}) AS rank FROM {t} GROUP BY {c}) WHERE rank <= 10" for c, t in (("c_mktsegment", "customer"), ("c_name", "customer"))])


@query(_ranked_sql("count(*) DESC"))
def top_values(spark, d):
    """The ten most frequent values."""
    return r4(Q.ranked_values(table(spark, d, "customer"), ["c_mktsegment", "c_name"]), "percentage")


@query(_ranked_sql("count(*) ASC"))
def least_values(spark, d):
    """The ten least frequent values."""
    return r4(Q.ranked_values(table(spark, d, "customer"), ["c_mktsegment", "c_name"], least=True), "percentage")


# booleans and dates


@query("SELECT 'good' AS \"column\", count(*) FILTER (WHERE quality = 1) AS true_count, count(*) FILTER (WHERE quality <> 1) AS false_count, round(avg((quality = 1)::INTEGER), 4) AS true_ratio FROM labels")
def bool_ratio(spark, d):
    """True and false cells."""
    return r4(A.boolean_profile(table(spark, d, "labels").select((F.col("quality") == 1).alias("good")), ["good"]), "true_ratio")


@query(union([f"SELECT '{c}' AS \"column\", count({c}) AS n, strftime(min({c}), '%Y-%m-%d') AS min_date, strftime(max({c}), '%Y-%m-%d') AS max_date, date_diff('day', min({c})::DATE, max({c})::DATE)::DOUBLE AS duration_days FROM {t}" for c, t in (("o_orderdate", "orders"),)]))
def date_profile(spark, d):
    """First and last date and the days between."""
    return A.date_profile(table(spark, d, "orders"), ["o_orderdate"])


@query(union([f"SELECT '{p}' AS part, {e} AS key, count(*) AS n FROM events GROUP BY 2" for p, e in (("year", "year(ts)::VARCHAR"), ("month", "month(ts)::VARCHAR"), ("weekday", "dayname(ts)"), ("hour", "hour(ts)::VARCHAR"))]))
def date_distribution(spark, d):
    """Dates by year, month, weekday and hour."""
    return A.date_distribution(table(spark, d, "events"), "ts")


@query("SELECT strftime(o_orderdate, '%d/%m/%Y') AS day, strftime(o_orderdate, '%Y-%m-%d') AS parsed, count(*) AS n FROM orders GROUP BY 1, 2")
def parse_dates(spark, d):
    """Day-first texts read as dates."""
    df = table(spark, d, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))
    return df.select("day", F.date_format(P.moment(F.col("day")), "yyyy-MM-dd").alias("parsed")).groupBy("day", "parsed").agg(F.count(F.lit(1)).alias("n"))


# lexical forms: cells of several kinds, made of a table's columns


def mixed_cells(spark: SparkSession, d: str) -> DataFrame:
    """A column of numbers, dates, booleans, null-like tokens and text, by remainder of the order's key."""
    k = F.col("o_orderkey")
    cell = (
        F.when(k % 7 == 0, F.lit(" NaN "))
        .when(k % 7 == 1, k.cast("string"))
        .when(k % 7 == 2, F.concat(k.cast("string"), F.lit(".5e1")))
        .when(k % 7 == 3, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(k % 7 == 4, F.lit("TRUE"))
        .when(k % 7 == 5, F.concat(k.cast("string"), F.lit("d")))
        .otherwise(F.lit("\t"))
    )
    return table(spark, d, "orders").select("o_orderkey", cell.alias("cell"))


MIXED = "(SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN ' NaN ' WHEN 1 THEN o_orderkey::VARCHAR WHEN 2 THEN o_orderkey || '.5e1' WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 4 THEN 'TRUE' WHEN 5 THEN o_orderkey || 'd' ELSE chr(9) END AS cell FROM orders)"
TRIM = "trim(cell, chr(9) || ' ')"


@query(f"SELECT 'cell' AS \"column\", count(*) AS total_count, count(*) FILTER (WHERE cell IS NULL OR lower({TRIM}) IN ('', 'null', 'nan')) AS null_count FROM {MIXED}")
def null_like(spark, d):
    """Cells without a value."""
    return A.null_counts(mixed_cells(spark, d).select("cell"))


CLASS = rf"CASE WHEN lower({TRIM}) IN ('', 'null', 'nan') THEN NULL WHEN regexp_full_match({TRIM}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'Numeric' WHEN regexp_full_match({TRIM}, '\d{{4}}-\d{{2}}-\d{{2}}') THEN 'Date' WHEN lower({TRIM}) IN ('true', 'false') THEN 'Boolean' ELSE 'Text' END"


@query(f"SELECT {CLASS} AS class, count(*) AS n FROM {MIXED} WHERE {CLASS} IS NOT NULL GROUP BY 1")
def lexical_classes(spark, d):
    """What cells say, by class."""
    return mixed_cells(spark, d).select(P.lexical_class(F.col("cell")).alias("class")).where("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query(union([f"SELECT '{c}' AS \"column\", '{k}' AS data_type FROM (SELECT 1)" for c, k in (("keys", "Integer"), ("prices", "Float"), ("days", "Date"), ("flags", "Boolean"), ("names", "String"), ("mostly_numbers", "Float"))]))
def infer_types(spark, d):
    """Types of text columns from their cells."""
    o, k = shared(table(spark, d, "orders"), ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority"]), F.col("o_orderkey")
    texts = o.select(
        k.cast("string").alias("keys"), F.col("o_totalprice").cast("string").alias("prices"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("days"), F.when(k % 2 == 0, "True").otherwise("false").alias("flags"),
        F.col("o_orderpriority").alias("names"), F.when(k % 10 == 0, "n/a").otherwise(k.cast("string")).alias("mostly_numbers"),
    )
    return Q.lexical_profile(texts).select("column", "data_type")


@query(f"SELECT o_orderkey, CASE WHEN regexp_full_match(cell, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN cell::DOUBLE END AS number, regexp_full_match({TRIM}, '[0-9]+') AS is_integer FROM {MIXED}")
def parse_numbers(spark, d):
    """Cells read as numbers, without the casts' extras."""
    return mixed_cells(spark, d).select("o_orderkey", P.number(F.col("cell")).alias("number"), P.is_integer(P.trimmed(F.col("cell"))).alias("is_integer"))


@query(f"SELECT 'cell' AS \"column\", n_class_numeric, n_class_text, round(greatest(n_class_numeric, n_class_text, n_other) / total, 4) AS dominant_share FROM (SELECT count(*) FILTER (WHERE c = 'Numeric') AS n_class_numeric, count(*) FILTER (WHERE c = 'Text') AS n_class_text, greatest(count(*) FILTER (WHERE c = 'Date'), count(*) FILTER (WHERE c = 'Boolean')) AS n_other, count(c) AS total FROM (SELECT {CLASS} AS c FROM {MIXED}))")
def type_homogeneity(spark, d):
    """How far a column's cells are of one class."""
    out = Q.lexical_profile(mixed_cells(spark, d).select("cell"))
    return out.select("column", F.col("class_numeric").alias("n_class_numeric"), F.col("class_text").alias("n_class_text"), F.round("dominant_share", 4).alias("dominant_share"))


# rows and keys


DUPLICATES = {"lineitem": "l_orderkey, l_partkey, l_returnflag", "customer": "c_nationkey, c_mktsegment", "documents": "text"}


@query(union([f"SELECT '{t}' AS \"table\", sum(n)::BIGINT AS rows, count(*) AS distinct_rows, (sum(n) - count(*))::BIGINT AS duplicate_rows FROM (SELECT count(*) AS n FROM {t} GROUP BY {c})" for t, c in DUPLICATES.items()]))
def duplicate_rows(spark, d):
    """Rows that repeat another one."""
    parts = [A.duplicate_rows(table(spark, d, t).select(*[c.strip() for c in cs.split(",")])).select(F.lit(t).alias("table"), "*") for t, cs in DUPLICATES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT count(*) AS rows, count(*) FILTER (WHERE ok) AS complete, count(*) * 2 AS cells, count(*) FILTER (WHERE NOT ok) AS null_cells FROM (SELECT lower({TRIM}) NOT IN ('', 'null', 'nan') AS ok FROM {MIXED})")
def complete_rows(spark, d):
    """Rows without a cell that is null."""
    return A.complete_rows(mixed_cells(spark, d))


@query("SELECT * FROM (SELECT 'o_orderkey' AS \"column\", true AS is_key, round(count(DISTINCT o_orderkey) * 100.0 / count(*), 4) AS uniqueness, count(DISTINCT o_orderkey) / count(*) > 0.95 AS high_cardinality FROM orders UNION ALL SELECT 'o_totalprice', false, round(count(DISTINCT o_totalprice) * 100.0 / count(*), 4), count(DISTINCT o_totalprice) / count(*) > 0.95 FROM orders UNION ALL SELECT 'o_orderstatus', false, round(count(DISTINCT o_orderstatus) * 100.0 / count(*), 4), count(DISTINCT o_orderstatus) / count(*) > 0.95 FROM orders)")
def key_uniqueness(spark, d):
    """Distinct values in all rows; which columns are keys, and which are as good as unique."""
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    share = F.col("distinct_count") / F.col("rows")
    names = {"o_orderkey": True, "o_totalprice": False, "o_orderstatus": False}
    is_key = F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, rules.likely_id_name(n.removeprefix("o_").replace("orderkey", "order_key")))]), F.col("column"))
    return Q.distinct_counts(df).join(F.broadcast(rows)).select("column", is_key.alias("is_key"), F.round(share * 100, 4).alias("uniqueness"), (share > 0.95).alias("high_cardinality"))


# patterns


def patterned(spark: SparkSession, d: str) -> DataFrame:
    """Columns that show patterns: addresses, codes, card numbers, postcodes, dates."""
    k = F.col("c_custkey")
    digits = F.lpad((k * 7919 % 10_000_000_000).cast("string"), 16, "4")
    return table(spark, d, "customer").select(
        F.concat(F.lit("user"), k.cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("10.0."), (k % 300).cast("string"), F.lit("."), (k % 256).cast("string")).alias("ip"),
        F.concat(F.lit("AB-"), k.cast("string")).alias("code"),
        digits.alias("card"),
        F.lpad((k % 100000).cast("string"), 5, "0").alias("zip"),
        F.date_format(F.date_add(F.lit("2020-01-01"), (k % 1000).cast("int")), "yyyy-MM-dd").alias("day"),
        F.when(k % 2 == 0, F.concat(F.lit("#"), F.lpad(F.hex(k), 6, "0"))).otherwise(F.lit("none")).alias("color"),
    )


_PATTERNED = """(SELECT 'user' || c_custkey || '@example.com' AS email, '10.0.' || (c_custkey % 300) || '.' || (c_custkey % 256) AS ip, 'AB-' || c_custkey AS code, lpad((c_custkey * 7919 % 10000000000)::VARCHAR, 16, '4') AS card,
lpad((c_custkey % 100000)::VARCHAR, 5, '0') AS zip, strftime(DATE '2020-01-01' + (c_custkey % 1000)::INTEGER, '%Y-%m-%d') AS day, CASE WHEN c_custkey % 2 = 0 THEN '#' || lpad(printf('%X', c_custkey), 6, '0') ELSE 'none' END AS color FROM customer)"""


def _pattern_sql() -> str:
    parts = []
    for c in ("email", "ip", "code", "card", "zip", "day", "color"):
        for p in R.CATALOGUE:
            if p.validator is None:
                regex = p.regex.replace("'", "''").replace(r"\x00", r"\x{00}")
                parts.append(f"SELECT '{c}' AS \"column\", '{p.name}' AS pattern, count(*) FILTER (WHERE regexp_matches({c}, '{regex}')) AS match_count, round(count(*) FILTER (WHERE regexp_matches({c}, '{regex}')) * 100.0 / count(*), 4) AS match_percentage FROM p")
    return f"WITH p AS {_PATTERNED} SELECT * FROM ({union(parts)}) WHERE match_count > 0"


@query(_pattern_sql())
def patterns_matched(spark, d):
    """Values that match each pattern of the catalogue that has no check digits."""
    plain = [p.name for p in R.CATALOGUE if p.validator is None]
    return r4(Q.pattern_counts(patterned(spark, d)).where(F.col("pattern").isin(plain)).drop("valid_count"), "match_percentage")


@query("SELECT count(*) AS values, count(*) FILTER (WHERE s % 10 = 0) AS valid FROM (SELECT card, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN (CASE WHEN substr(card, i, 1)::INTEGER > 4 THEN substr(card, i, 1)::INTEGER * 2 - 9 ELSE substr(card, i, 1)::INTEGER * 2 END) ELSE substr(card, i, 1)::INTEGER END)) AS s FROM " + _PATTERNED + ")")
def luhn_check(spark, d):
    """Card numbers whose check digit is right."""
    from gaugeworks.functions.validators import credit_card

    return patterned(spark, d).agg(F.count(F.lit(1)).alias("values"), A.count_if(credit_card(F.col("card"))).alias("valid"))


@query("SELECT count(*) AS values, count(*) FILTER (WHERE regexp_full_match(url, '(?:https?|ftps?)://[^\\s/$.?#].[^\\s]*')) AS urls FROM pages")
def patterns_pages(spark, d):
    """Addresses of pages that are URLs."""
    got = Q.pattern_counts(table(spark, d, "pages"), ["url"]).where("pattern = 'URL'")
    total = table(spark, d, "pages").agg(F.count("url").alias("values"))
    return total.join(F.broadcast(got.select(F.col("match_count").alias("urls"))))


# rules


@query("""SELECT 'text' AS "column", "both", dots, commas, "both" + least(dots, commas) AS violations, encoding_issues FROM (SELECT count(*) FILTER (WHERE d > 0 AND c > 0) AS "both", count(*) FILTER (WHERE d = 1 AND c = 0) AS dots, count(*) FILTER (WHERE d = 0 AND c = 1) AS commas, count(*) FILTER (WHERE contains(text, chr(65533)) OR regexp_matches(text, 'Ã(¡|©|­|³|º|±|§)')) AS encoding_issues FROM (SELECT text, length(text) - length(replace(text, '.', '')) AS d, length(text) - length(replace(text, ',', '')) AS c FROM documents WHERE lower(trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')) NOT IN ('', 'null', 'nan')))""")
def format_violations(spark, d):
    """Dots and commas in one column, and texts that were decoded wrongly."""
    return rules.format_violations(table(spark, d, "documents"), ["text"])


@query("SELECT f AS format, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'DD/MM/YYYY' ELSE 'YYYY-MM-DD' END AS f FROM orders ORDER BY o_orderkey LIMIT 50) GROUP BY 1")
def mixed_date_formats(spark, d):
    """Formats of a date column's first fifty values."""
    df = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_date"))
    return rules.mixed_date_formats(df, "order_date", ["o_orderkey"])


@query("SELECT 'tax_rate' AS \"column\", 'percent' AS rule, count(*) AS checked, count(*) FILTER (WHERE l_tax * 2000 > 100 OR l_tax < 0) AS violations FROM lineitem UNION ALL SELECT 'item_count', 'count', count(*), count(*) FILTER (WHERE l_quantity - 5 < 0) FROM lineitem UNION ALL SELECT 'ship_year', 'year', count(*), count(*) FILTER (WHERE year(l_shipdate) + 105 > 2100) FROM lineitem")
def range_rules(spark, d):
    """Numbers out of the range that a column's name calls for."""
    df = table(spark, d, "lineitem").select((F.col("l_tax") * 2000).alias("tax_rate"), (F.col("l_quantity") - 5).alias("item_count"), (F.year("l_shipdate") + 105).alias("ship_year"))
    return rules.range_violations(df)


@query("SELECT 's_acctbal' AS \"column\", count(*) AS checked, count(*) FILTER (WHERE s_acctbal < 0) AS negative FROM supplier")
def negatives(spark, d):
    """Numbers below zero in columns that should be positive."""
    return rules.negatives(table(spark, d, "supplier"), ["s_acctbal"])


@query("SELECT 'o_orderdate' AS \"column\", count(*) AS checked, count(*) AS valid, 0::BIGINT AS invalid, count(*) FILTER (WHERE year(o_orderdate) > 1997) AS future, count(*) FILTER (WHERE year(o_orderdate) < 1992 + 3) AS stale FROM orders")
def timeliness(spark, d):
    """Dates after and long before a year."""
    return rules.timeliness(table(spark, d, "orders"), ["o_orderdate"], 1997, 2)


@query("SELECT 'start_date' AS first, 'end_date' AS second, count(*) AS checked, count(*) FILTER (WHERE o_orderdate::DATE > l_shipdate::DATE) AS violations FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def temporal_order(spark, d):
    """Rows whose end comes before their beginning."""
    day = lambda c: F.date_format(c, "dd/MM/yyyy")
    df = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(day("o_orderdate").alias("start_date"), day("l_shipdate").alias("end_date"))
    return rules.order_violations(df, rules.date_pairs(df.columns))


def priced(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_retailprice").cast("decimal(18,2)").cast("string").alias("price"))


_SCALE = "length(rtrim(split_part(price, '.', 2), '0'))"


@query(f"SELECT 'price' AS \"column\", {_SCALE}::INTEGER AS scale, count(*) AS n FROM (SELECT p_retailprice::DECIMAL(18,2)::VARCHAR AS price FROM part) GROUP BY 2")
def decimal_scale(spark, d):
    """Numbers by the decimals that they use."""
    return Q.decimal_scales(priced(spark, d), ["price"])


@query(f"SELECT 'price' AS \"column\", first(scale ORDER BY n DESC, scale)::INTEGER AS modal_scale, sum(n)::BIGINT AS checked, (sum(n) - max(n))::BIGINT AS deviating FROM (SELECT {_SCALE} AS scale, count(*) AS n FROM (SELECT p_retailprice::DECIMAL(18,2)::VARCHAR AS price FROM part) GROUP BY 1)")
def precision(spark, d):
    """Numbers whose decimals aren't the usual ones."""
    return Q.precision(Q.decimal_scales(priced(spark, d), ["price"]))


@query("SELECT 'l_quantity' AS \"column\", 'positive' AS kind, count(*) AS checked, count(*) AS matched FROM lineitem UNION ALL SELECT 'l_shipdate', 'temporal', count(*), count(*) FROM lineitem")
def hint_bindings(spark, d):
    """Values that bear out hints."""
    return rules.hint_bindings(table(spark, d, "lineitem"), {"l_quantity": "positive", "l_shipdate": "temporal"})


@query("SELECT o_orderkey, trunc(o_totalprice * 100 + 0.5) / 100 AS r2 FROM orders WHERE o_totalprice >= 0")
def rounding(spark, d):
    """Two decimals, half away from zero on the binary number."""
    return table(spark, d, "orders").where("o_totalprice >= 0").select("o_orderkey", P.rounded(F.col("o_totalprice"), 2).alias("r2"))


# quality


def _scores(spark: SparkSession, report) -> DataFrame:
    rows = [(k, None if v is None else float(v)) for k, v in {**report.dimension_scores, "overall": report.score}.items()]
    return spark.createDataFrame(rows, "dimension string, score double").select("dimension", F.round("score", 4).alias("score"))


@query("""WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer),
k AS (SELECT quantile_cont(c_custkey::DOUBLE, 0.25) AS q1, quantile_cont(c_custkey::DOUBLE, 0.75) AS q3 FROM customer),
o AS (SELECT count(*) FILTER (WHERE c_acctbal < q.q1 - 1.5 * (q.q3 - q.q1) OR c_acctbal > q.q3 + 1.5 * (q.q3 - q.q1)) + count(*) FILTER (WHERE c_custkey < k.q1 - 1.5 * (k.q3 - k.q1) OR c_custkey > k.q3 + 1.5 * (k.q3 - k.q1)) AS outliers, count(*) * 2 AS numbers FROM customer, q, k),
s AS (SELECT 100.0 AS completeness, 100 - outliers * 100.0 / numbers AS accuracy FROM o)
SELECT 'completeness' AS dimension, round(completeness, 4)::DOUBLE AS score FROM s UNION ALL SELECT 'accuracy', round(accuracy, 4)::DOUBLE FROM s UNION ALL SELECT 'overall', round((0.25 * completeness + 0.15 * accuracy) / 0.4, 4)::DOUBLE FROM s
UNION ALL SELECT unnest(['consistency', 'uniqueness', 'timeliness', 'validity', 'precision']), NULL""")
def quality_score(spark, d):
    """Two dimensions and their weighted mean; the others aren't assessed."""
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return _scores(spark, profile_frame(df, Options(packs=("quality",), dimensions=("completeness", "accuracy"))))


@query("SELECT 100.0 * (1 - null_cells / cells) / 2 + 50.0 * complete / rows AS score FROM (SELECT count(*) AS rows, count(*) FILTER (WHERE ok) AS complete, count(*) * 2 AS cells, count(*) FILTER (WHERE NOT ok) AS null_cells FROM (SELECT lower(trim(cell, chr(9) || ' ')) NOT IN ('', 'null', 'nan') AS ok FROM " + MIXED + "))")
def completeness(spark, d):
    """The completeness score from its facts."""
    f = A.complete_rows(mixed_cells(spark, d))
    return f.select((100.0 * (1 - F.col("null_cells") / F.col("cells")) / 2 + 50.0 * F.col("complete") / F.col("rows")).alias("score"))


# samples and limits


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE p % 10 = 0")
def sample_systematic(spark, d):
    """Every tenth row by key."""
    return sampling.systematic(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 10, ["o_orderkey"])


@query("SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS p FROM orders) WHERE p <= 25")
def sample_stratified(spark, d):
    """The first rows of each stratum."""
    return sampling.stratified(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], 25, ["o_orderkey"])


@query("SELECT event_id, value FROM events WHERE value >= 50")
def sample_importance(spark, d):
    """Rows of a weight or more."""
    return sampling.importance(table(spark, d, "events").select("event_id", "value"), "value", 50)


@query("SELECT event_id, value FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events WHERE value >= 50) WHERE p % 4 = 0")
def sample_multi_stage(spark, d):
    """A weight, then every fourth row."""
    S = sampling.Sampling
    return sampling.sampled(table(spark, d, "events").select("event_id", "value"), S("multi_stage", stages=(S("importance", weight="value", threshold=50), S("systematic", interval=4))), ["event_id"])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS _position FROM orders")
def positions(spark, d):
    """Each row's place in time, without a window over all rows."""
    return sampling.positioned(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "_position")


# reports side by side


def halved(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a column gone, one new, and some keys lost."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("o_custkey"), "o_totalprice", F.year("o_orderdate").alias("o_year"))


# fast paths, records, streams


@query(union([f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in ("region", "nation", "orders", "lineitem")]))
def row_count(spark, d):
    """Rows from the footers."""
    rows = [(t, fastpaths.quick_row_count(spark, f"{d}/{t}.parquet").count) for t in ("region", "nation", "orders", "lineitem")]
    return spark.createDataFrame(rows, "table string, rows long")


@query("SELECT * FROM (VALUES ('o_orderkey', 'Integer'), ('o_custkey', 'Integer'), ('o_orderstatus', 'String'), ('o_totalprice', 'Float'), ('o_orderdate', 'Date'), ('o_orderpriority', 'String')) AS t(\"column\", data_type)")
def infer_schema(spark, d):
    """Types of a file's columns."""
    return spark.createDataFrame(fastpaths.infer_schema(spark, f"{d}/orders.parquet").columns, "column string, data_type string")


@query("SELECT key, count(*) AS n, min(json_extract_string(props, '$.' || key)) AS least FROM (SELECT props, unnest(json_keys(props)) AS key FROM events WHERE json_valid(props)) GROUP BY key")
def json_flattened(spark, d):
    """Keys of JSON records with their flattened values."""
    good = json_records(table(spark, d, "events").select(F.col("props").alias("value"))).where("ok")
    return good.select(F.explode("record").alias("key", "v")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"))


@query("SELECT 'event_id' AS \"column\", 'Integer' AS data_type, count(*) AS total_count, min(event_id)::DOUBLE AS min, max(event_id)::DOUBLE AS max, round(avg(event_id), 4) AS mean FROM events UNION ALL SELECT 'value', 'Float', count(*), min(value), max(value), round(avg(value), 4) FROM events")
def stream_profile(spark, d):
    """A stream's state after its last batch; equal to the table's."""
    from gaugeworks.streaming.profile import profile_stream, result

    whole = table(spark, d, "events")
    stream = spark.readStream.schema(whole.schema).option("pathGlobFilter", "events.parquet").parquet(d).select("event_id", "value")
    state, _ = profile_stream(stream)
    return r4(result(state, spark).select("column", "data_type", "total_count", "min", "max", "mean"), "mean")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS \"end\", event_type, count(*) AS rows, count(*) FILTER (WHERE value IS NULL) AS nulls, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2, 3")
def windowed_profile(spark, d):
    """A number's profile for each hour."""
    from gaugeworks.streaming.profile import windowed_profile as windows

    return r4(windows(table(spark, d, "events"), "ts", "value", by=["event_type"]), "mean")


def queries() -> dict[str, Query]:
    _more()
    return dict(QUERIES)


def _more() -> None:
    """The queries that live in modules of their own."""
    from gaugeworks import catalog_reports, catalog_sources  # noqa: F401


def oracle_sql() -> dict[str, str]:
    _more()
    return dict(SQL)

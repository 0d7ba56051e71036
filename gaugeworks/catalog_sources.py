"""Queries over sources, samples and streams: tables written in another form and read back, with SQL for what has to come out."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeworks import errors
from gaugeworks.catalog import query, r4, table, union
from gaugeworks.operators import aggregates as A
from gaugeworks.operators import sampling
from gaugeworks.plans import aio, fastpaths, validate
from gaugeworks.plans.capabilities import capabilities
from gaugeworks.plans.profile import Options, Profiler, profile, profile_frame
from gaugeworks.sources import database, files, memory
from gaugeworks.sources.scratch import put, scratch_path
from gaugeworks.streaming import limits
from gaugeworks.streaming import profile as streams


def values(rows: list[tuple], names: str) -> str:
    """SQL for a few rows that don't hang on a table."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(literal(v) for v in r) + ')' for r in rows)}) AS t({names})"


def literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"{v!r}::DOUBLE"
    return repr(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def rows(spark, found: list[tuple], schema: str):
    return spark.createDataFrame(found, schema)


def nations(spark, d) -> list:
    return table(spark, d, "nation").orderBy("n_nationkey").collect()


# formats and dialects

_PATHS = (("a.csv", "csv"), ("b.tsv", "csv"), ("c.txt", "csv"), ("d.json", "json"), ("e.jsonl", "jsonl"), ("f.ndjson", "jsonl"), ("g.parquet", "parquet"), ("h.xlsx", "unknown"), ("folder/i", "csv"), ("J.PARQUET/", "parquet"))


@query(values([*_PATHS], "path, format"))
def format_detection(spark, d):
    """Formats by the ending of a name."""
    return rows(spark, [(p, files.detect_format(p)) for p, _ in _PATHS], "path string, format string")


@query(union([f"SELECT '{s}' AS sign, '{s}' AS detected, count(*) AS records FROM nation" for s in (",", ";", "|")] + ["SELECT chr(9), chr(9), count(*) FROM nation"]))
def delimiter_detection(spark, d):
    """The delimiter that a file's first records tell."""
    out = []
    for sign in files.DELIMITERS:
        lines = [f"{r['n_nationkey']}{sign}{r['n_name']}{sign}{r['n_regionkey']}" for r in nations(spark, d)]
        out.append((sign, files.detect_delimiter("\n".join(lines).encode()), len(lines)))
    return rows(spark, out, "sign string, detected string, records long")


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_mktsegment FROM customer")
def csv_scan(spark, d):
    """A table written as CSV and read as text."""
    path = scratch_path(spark, "customer.csv")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").write.option("header", True).csv(path)
    return files.read_csv(spark, path)[0]


def _ragged(spark, d) -> str:
    """Names in rows with one field too many (an unquoted comma), too few, and two too many."""
    line = {0: "{k},{n},{r}", 1: "{k},{n},x,{r}", 2: "{k}", 3: "{k},{n},{r},y,z"}
    text = ["key,name,region"] + [line[r["n_nationkey"] % 4].format(k=r["n_nationkey"], n=r["n_name"], r=r["n_regionkey"]) for r in nations(spark, d)]
    return put(spark, "nation.csv", ("﻿" + "\n".join(text) + "\n").encode())


@query("""SELECT n_nationkey::VARCHAR AS key, CASE WHEN n_nationkey % 4 = 2 THEN '' ELSE n_name END AS name,
CASE n_nationkey % 4 WHEN 1 THEN 'x,' || n_regionkey WHEN 2 THEN '' ELSE n_regionkey::VARCHAR END AS region, (SELECT count(*) FROM nation WHERE n_nationkey % 4 <> 0) AS ragged FROM nation""")
def csv_ragged(spark, d):
    """Ragged rows filled, cut, and repaired where one comma is too many; a byte order mark goes."""
    df, info = files.read_csv(spark, _ragged(spark, d), files.CsvOptions(delimiter=","))
    return df.withColumn("ragged", F.lit(info.ragged_rows).cast("long"))


@query("SELECT count(*) + 1 AS total_lines, count(*) FILTER (WHERE n_nationkey % 4 = 0) + 1 AS consistent_field_rows, count(*) FILTER (WHERE n_nationkey % 4 <> 0) AS inconsistent_field_rows, 4 AS field_count_variations, 3 AS most_common_field_count, 0 AS unmatched_quotes FROM nation")
def csv_diagnostics(spark, d):
    """Lines of a CSV file by their number of fields."""
    x = files.validate_csv(spark, _ragged(spark, d), files.CsvOptions(delimiter=","))
    return rows(spark, [(x.total_lines, x.consistent_field_rows, x.inconsistent_field_rows, x.field_count_variations, x.most_common_field_count, x.unmatched_quotes)], "total_lines long, consistent_field_rows long, inconsistent_field_rows long, field_count_variations int, most_common_field_count int, unmatched_quotes int")


@query("SELECT n_nationkey AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'a' || chr(10) || 'b, ' || n_name ELSE n_name END AS name FROM nation")
def csv_quoted_breaks(spark, d):
    """Line breaks and delimiters within quotes, found before the file is split."""
    text = ["key,name"] + [f'{r["n_nationkey"]},"a\nb, {r["n_name"]}"' if r["n_nationkey"] % 2 == 0 else f"{r['n_nationkey']},{r['n_name']}" for r in nations(spark, d)]
    df, _ = files.read_csv(spark, put(spark, "quoted.csv", ("\n".join(text) + "\n").encode()))
    return df.select(F.col("key").cast("int").alias("key"), "name")


@query("SELECT 'strict, delimiter detected, UTF-8' AS first, 'flexible, delimiter detected, UTF-8' AS last, count(*) AS records FROM nation")
def csv_recovery(spark, d):
    """A strict reading, then a flexible one."""
    df, _, tried = files.read_csv_with_recovery(spark, _ragged(spark, d))
    return rows(spark, [(tried[0], tried[-1], df.count())], "first string, last string, records long")


@query("SELECT 2 AS fields, count(*) FILTER (WHERE n_nationkey % 3 <> 0) AS records, count(*) FILTER (WHERE n_nationkey % 3 = 0) AS left_out FROM nation")
def csv_chunk_parse(spark, d):
    """A piece of CSV that the caller holds, read strictly."""
    text = "k,n\n" + "\n".join(f"{r['n_nationkey']},{r['n_name']}" + (",more" if r["n_nationkey"] % 3 == 0 else "") for r in nations(spark, d))
    names, kept, left_out = files.parse_csv_chunk(text, options=files.CsvOptions(flexible=False))
    return rows(spark, [(len(names), len(kept), left_out)], "fields int, records long, left_out long")


@query("SELECT count(*) AS lines, true AS whole_lines, true AS several FROM customer")
def file_chunks(spark, d):
    """Stretches of files that end with a line: they hold every byte, and their lines are the table's, each as often."""
    line = table(spark, d, "customer").select(F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name").alias("value"))
    path = scratch_path(spark, "chunks.csv")
    line.write.text(path)
    parts = files.read_chunks(spark, path, 1000)
    text = F.col("content").cast("string")
    before = Window.partitionBy("file").orderBy("start")
    placed = parts.select(F.octet_length("content").alias("n"), F.endswith(text, F.lit("\n")).alias("whole"), (F.col("start") == F.coalesce(F.lag(F.col("start") + F.octet_length("content")).over(before), F.lit(0))).alias("next"))
    got = placed.agg(F.count(F.lit(1)).alias("parts"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes"), F.coalesce(F.bool_and(F.col("whole") & F.col("next")), F.lit(True)).alias("whole")).first()
    # lines of the stretches count up, those of the table down
    signed = lambda lines, n: lines.select(F.explode(F.split("value", "\n")).alias("line"), F.lit(n).alias("n"))
    read = signed(parts.select(F.substring(text, F.lit(1), F.length(text) - 1).alias("value")), 1)
    left = read.unionByName(signed(line, -1)).groupBy("line").agg(F.sum("n").alias("d"), F.count(F.when(F.col("n") > 0, 1)).alias("up"))
    lines = left.agg(F.coalesce(F.sum("up"), F.lit(0)).alias("n"), F.count(F.when(F.col("d") != 0, 1)).alias("unlike")).first()
    whole = got["whole"] and got["bytes"] == files.file_size(spark, path) and not lines["unlike"]
    return rows(spark, [(lines["n"], whole, got["parts"] > 1)], "lines long, whole_lines boolean, several boolean")


@query(values([("utf-8", None, None), ("latin-1", "latin-1", 3), ("windows-1252", "windows-1252", 3), ("utf-16le", "utf-16le", 0), ("utf-16be", "utf-16be", 0)], "written, encoding, first_bad_byte"))
def encoding_diagnosis(spark, d):
    """What bytes that aren't UTF-8 probably are."""
    raw = {"utf-8": "é ü".encode(), "latin-1": "abcé.".encode("latin-1"), "windows-1252": "abc€".encode("windows-1252"), "utf-16le": "﻿ab".encode("utf-16le"), "utf-16be": "﻿ab".encode("utf-16be")}
    found = [(n, files.diagnose_encoding(b)) for n, b in raw.items()]
    return rows(spark, [(n, x and x.encoding, x and x.first_bad_byte) for n, x in found], "written string, encoding string, first_bad_byte int")


def _lines(spark, d) -> str:
    """JSON lines of nations, every fifth of which is broken or no object."""
    out = []
    for r in nations(spark, d):
        k = r["n_nationkey"]
        good = json.dumps({"key": k, "name": r["n_name"], **({"region": {"id": r["n_regionkey"]}} if k % 2 else {})}, separators=(",", ":"))
        out.append("[1, 2]" if k % 10 == 0 else good[:-1] if k % 5 == 0 else good)
    return put(spark, "nation.jsonl", ("\n\n".join(out) + "\n").encode())


@query("SELECT n_nationkey::VARCHAR AS key, n_name AS name, CASE WHEN n_nationkey % 2 = 1 THEN '{\"id\":' || n_regionkey || '}' ELSE '' END AS region, (SELECT count(*) FROM nation WHERE n_nationkey % 5 = 0) AS errors FROM nation WHERE n_nationkey % 5 <> 0")
def jsonl_scan(spark, d):
    """JSON lines; nested values as JSON, broken lines counted."""
    df, info = files.read_jsonl(spark, _lines(spark, d))
    return df.withColumn("errors", F.lit(info.error_count).cast("long"))


@query(values([("lines, strict", "JsonError"), ("lines, tolerant", None), ("array, strict", "JsonError"), ("array, tolerant", None), ("no element", "JsonError")], "reading, error"))
def record_policy(spark, d):
    """What strict readings refuse."""
    lines, array, none = _lines(spark, d), put(spark, "a.json", b'[{"a":1},'), put(spark, "b.json", b'[,{"a":1}]')
    calls = {"lines, strict": lambda: files.read_jsonl(spark, lines, True), "lines, tolerant": lambda: files.read_jsonl(spark, lines), "array, strict": lambda: files.read_json(spark, array, True), "array, tolerant": lambda: files.read_json(spark, array), "no element": lambda: files.read_json(spark, none)}
    return rows(spark, [(n, _error(f)) for n, f in calls.items()], "reading string, error string")


def _error(call) -> str | None:
    try:
        call()
    except errors.GaugeError as e:
        return type(e).__name__
    return None


_FAULTS = ((", {\"a\":1}", 1), (",", 1), (",]", 1), ("] trailing", 1), ("][{\"a\":1}]", 1), (" {\"a\":1}]", 1), (",,{\"a\":1}]", 1), ("]", 0), (",[1]]", 1))


@query(union([f"SELECT {literal(tail)} AS tail, count(*) + {int(tail.startswith(', {'))} AS records, {n}::BIGINT AS errors FROM nation" for tail, n in _FAULTS]))
def json_document(spark, d):
    """An array of objects: what stands before a fault is kept, and the fault counted."""
    head = "[" + ",\n".join(json.dumps({"a": r["n_nationkey"]}) for r in nations(spark, d))
    out = []
    for tail, _ in _FAULTS:
        df, info = files.read_json(spark, put(spark, "nation.json", (head + tail).encode()))
        out.append((tail, df.count(), info.error_count))
    return rows(spark, out, "tail string, records long, errors long")


@query("SELECT count(*) AS num_rows, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS finished, true AS has_codec FROM orders")
def parquet_scan(spark, d):
    """A Parquet table and what its footer tells."""
    df, info = files.read_parquet(spark, f"{d}/orders.parquet")
    return rows(spark, [(info.details.get("num_rows", df.count()), df.where("o_orderstatus = 'F'").count(), bool(info.details.get("compression", True)))], "num_rows long, finished long, has_codec boolean")


@query(union([f"SELECT '{s}' AS source, count(*) AS records, sum(n_nationkey)::BIGINT AS keys FROM nation" for s in ("dict", "records", "csv bytes", "json bytes", "jsonl bytes", "parquet bytes", "pandas", "arrow")]))
def memory_sources(spark, d):
    """One table in every form that a caller may hold."""
    import io

    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq

    got = [(r["n_nationkey"], r["n_name"]) for r in nations(spark, d)]
    records = [{"k": k, "n": n} for k, n in got]
    arrow, raw = pa.Table.from_pylist(records), io.BytesIO()
    pq.write_table(arrow, raw)
    frames = {
        "dict": memory.to_frame(spark, {"k": [k for k, _ in got], "n": [n for _, n in got]})[0],
        "records": memory.to_frame(spark, records)[0],
        "csv bytes": memory.from_bytes(spark, ("k,n\n" + "\n".join(f"{k},{n}" for k, n in got)).encode())[0],
        "json bytes": memory.from_bytes(spark, json.dumps(records).encode(), "json")[0],
        "jsonl bytes": memory.from_bytes(spark, "\n".join(map(json.dumps, records)).encode(), "jsonl")[0],
        "parquet bytes": memory.from_bytes(spark, raw.getvalue(), "parquet")[0],
        "pandas": memory.to_frame(spark, pd.DataFrame(records))[0],
        "arrow": memory.to_frame(spark, arrow)[0],
    }
    out = []
    for name, df in frames.items():
        r = df.agg(F.count("n").alias("n"), F.sum(F.col("k").cast("long")).alias("s")).first()
        out.append((name, r["n"], r["s"]))
    return rows(spark, out, "source string, records long, keys long")


# databases


def _database(spark, d) -> database.Connector:
    """Nations and regions in a SQLite file of the driver."""
    import sqlite3
    import tempfile

    path = f"{tempfile.mkdtemp(prefix='gaugeworks-')}/tpch.db"
    with sqlite3.connect(path) as db:
        for name in ("nation", "region"):
            df = table(spark, d, name)
            found = df.orderBy(df.columns[0]).collect()
            db.execute(f"CREATE TABLE {name} ({', '.join(df.columns)})")
            db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' for _ in df.columns)})", [tuple(r) for r in found])
    return database.connector(spark, f"sqlite://{path}")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 3")
def database_query(spark, d):
    """A user's query, passed through to a database."""
    return _database(spark, d).read("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 3")[0]


@query("SELECT 'nation' AS \"table\", count(*) AS records, 'n_nationkey bigint, n_name string, n_regionkey bigint' AS columns, true AS answers, 'QueryFailed' AS missing FROM nation")
def database_connector(spark, d):
    """Connection, count and schema of a database's table; what a missing one says."""
    c = _database(spark, d)
    names = ", ".join(f"{n} {t}" for n, t in c.schema("nation") if n in ("n_nationkey", "n_name", "n_regionkey"))
    return rows(spark, [("nation", c.count("nation"), names, c.test_connection(), _error(lambda: c.count("nothing")))], "table string, records long, columns string, answers boolean, missing string")


@query(union([f"SELECT '{how}' AS sample, n_nationkey FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS p, greatest(1, count(*) OVER () // 5) AS step FROM nation) WHERE p % step = 1 % step AND p <= step * 5" for how in ("systematic", "temporal")]))
def database_samples(spark, d):
    """Samples that a database draws, every n-th row in its own order or along a column."""
    c = _database(spark, d)
    parts = [c.read("nation", how, 5, "n_nationkey")[0].select(F.lit(how).alias("sample"), F.col("n_nationkey").cast("int").alias("n_nationkey")) for how in ("systematic", "temporal")]
    return parts[0].unionByName(parts[1])


_SQL_CASES = (("SELECT a FROM t", None), ("SELECT 'a; -- b' AS x FROM t", None), ("WITH x AS (SELECT 1) SELECT * FROM x", None), ("SELECT dropped FROM updates", None), ("DELETE FROM t", "UnsafeQuery"), ("SELECT 1; DROP TABLE t", "UnsafeQuery"), ("SELECT 1 -- x", "UnsafeQuery"), ("SELECT a FROM t UNION SELECT b FROM u", "UnsafeQuery"), ("schema.table", None), ("t t", "UnsafeQuery"), ("drop", "UnsafeQuery"))


@query(values([*_SQL_CASES], "source, error"))
def database_security(spark, d):
    """Queries and names that are let through to a database."""
    return rows(spark, [(s, _error(lambda s=s: database.select_all(s))) for s, _ in _SQL_CASES], "source string, error string")


@query(values([("postgres", "jdbc:postgresql://h/d", "postgres://u:***@h/d", "sslmode=require", 1), ("mysql", "jdbc:mysql://h/d", "mysql://h/d", "sslMode=VERIFY_IDENTITY", 0), ("sqlite", "jdbc:sqlite:/x.db", "sqlite:/x.db", "", 0)], "kind, address, shown, encryption, warnings"))
def database_settings(spark, d):
    """Addresses, what is told of them, encryption, and what is unsafe."""
    given = (database.Database("postgres://u:secret@h/d", ssl=database.Ssl()), database.Database("mysql://h/d", ssl=database.Ssl("verify-full")), database.Database("sqlite:/x.db", ssl=database.Ssl()))
    out = []
    for x in given:
        out.append((x.kind, x.jdbc_url.replace("u:secret@", ""), database.safe_message(x.url), ",".join(f"{k}={v}" for k, v in x.ssl.options(x.kind).items()), len(x.warnings())))
    return rows(spark, out, "kind string, address string, shown string, encryption string, warnings int")


@query(values([("passes at once", 1, None), ("passes later", 3, None), ("never", 4, "RetriesExhausted"), ("another fault", 1, "UnsafeQuery")], "what, attempts, error"))
def database_retries(spark, d):
    """Failures that may pass are tried again, others aren't."""
    out = []
    for name, failures, fault in (("passes at once", 0, None), ("passes later", 2, "timeout"), ("never", 99, "connection refused"), ("another fault", 99, errors.UnsafeQuery("no"))):
        done = [0]

        def action(failures=failures, fault=fault, done=done):
            done[0] += 1
            if done[0] <= failures:
                raise fault if isinstance(fault, Exception) else OSError(fault)

        error = _error(lambda action=action: database.with_retries(action, sleep=lambda s: None))
        out.append((name, done[0], error))
    return rows(spark, out, "what string, attempts int, error string")


# samples


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders) WHERE p % (n // (n // 4)) = 0 AND p < (n // (n // 4)) * (n // 4)")
def sample_shrunk(spark, d):
    """Every n-th row of a table that takes too much memory."""
    df, cut = sampling.shrunk(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), -1, 0.25, ["o_orderkey"])
    return df.select("o_orderkey").where(F.lit(cut))


@query("SELECT o_orderpriority, o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS _position FROM orders")
def positions_by_text(spark, d):
    """Each row's place in an order that begins with a text which many rows share."""
    return sampling.positioned(table(spark, d, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority", "o_orderkey"])


@query("SELECT 'n_name' AS \"column\", least(20, count(*)) AS n, least(20, count(DISTINCT n_name)) AS different, true AS same_again, true AS from_table FROM nation UNION ALL SELECT 'n_regionkey', least(20, count(*)), NULL, true, true FROM nation")
def value_reservoirs(spark, d):
    """A bounded sample of each column's values."""
    df = table(spark, d, "nation")
    draw = lambda: sorted((r["column"], r["value"]) for r in sampling.value_reservoirs(df, ["n_name", "n_regionkey"], 20).collect())
    got, again = draw(), draw()
    real = {("n_name", r["n_name"]) for r in df.collect()} | {("n_regionkey", str(r["n_regionkey"])) for r in df.collect()}
    of = lambda c: [v for n, v in got if n == c]
    return rows(spark, [(c, len(of(c)), len(set(of(c))) if c == "n_name" else None, got == again, set(got) <= real) for c in ("n_name", "n_regionkey")], "column string, n long, different long, same_again boolean, from_table boolean")


@query(values([("random", 100, 0.01, 0.196, False, 1), ("systematic", 5000, 0.5, 0.0277, True, 0), ("temporal", 1500, 0.15, 0.0506, False, 1), ("random", 600, 0.0003, 0.08, True, 3)], "kind, sampled, ratio, margin, representative, advice"))
def sample_info(spark, d):
    """What a sample can tell of its table."""
    S = sampling.SampleInfo
    given = (S(10_000, 100), S(10_000, 5000, "systematic"), S(10_000, 1500, "temporal"), S(2_000_000, 600))
    return rows(spark, [(x.kind, x.sampled_rows, round(x.ratio, 4), round(x.margin, 4), x.representative, len(x.advice())) for x in given], "kind string, sampled int, ratio double, margin double, representative boolean, advice int")


@query(values([(1000, 1.0, "none", 0, 0), (500_000, 50.0, "random", 50_000, 0), (5_000_000, 900.0, "systematic", 0, 50), (None, 2000.0, "systematic", 0, 10), (None, 10.0, "none", 0, 0)], "records, megabytes, kind, size, interval"))
def sample_adaptive(spark, d):
    """A strategy by a table's size."""
    out = []
    for n, mb in ((1000, 1.0), (500_000, 50.0), (5_000_000, 900.0), (None, 2000.0), (None, 10.0)):
        s = sampling.adaptive(n, mb)
        out.append((n, mb, s.kind, s.size, s.interval))
    return rows(spark, out, "records int, megabytes double, kind string, size int, interval int")


# fast paths, settings, guards


@query("SELECT c AS \"column\", n AS null_count, k AS distinct_count, t AS data_type FROM (SELECT 'c_custkey' AS c, 0::BIGINT AS n, count(DISTINCT c_custkey) AS k, 'Integer' AS t FROM (SELECT * FROM customer LIMIT 1000) UNION ALL SELECT 'c_mktsegment', 0, count(DISTINCT c_mktsegment), 'String' FROM (SELECT * FROM customer LIMIT 1000) UNION ALL SELECT 'c_nationkey', 0, count(DISTINCT c_nationkey), 'Integer' FROM (SELECT * FROM customer LIMIT 1000))")
def structure_facts(spark, d):
    """Types, nulls and distinct values of a file's first rows."""
    got = fastpaths.analyze_structure(spark, f"{d}/customer.parquet")
    return rows(spark, [(c.name, c.null_count, c.distinct_count, c.data_type) for c in got.columns if c.name in ("c_custkey", "c_mktsegment", "c_nationkey")], "column string, null_count long, distinct_count long, data_type string")


@query(union([f"SELECT '{c}' AS call, count(*) AS records FROM nation" for c in ("profile_bytes", "profile_file", "quick_row_count")] + ["SELECT 'infer_schema', 3"]))
def async_calls(spark, d):
    """The same answers to asyncio."""
    import asyncio

    raw = ("k,n,r\n" + "\n".join(f"{r['n_nationkey']},{r['n_name']},{r['n_regionkey']}" for r in nations(spark, d)) + "\n").encode()
    path = put(spark, "async.csv", raw)

    async def run():
        schema = dict(packs=("schema",))
        return [
            ("profile_bytes", (await aio.profile_bytes(spark, raw, **schema)).execution.rows_processed), ("profile_file", (await aio.profile_file(spark, path, **schema)).execution.rows_processed),
            ("quick_row_count", (await aio.quick_row_count(spark, path)).count), ("infer_schema", len((await aio.infer_schema(spark, path)).columns)),
        ]

    return rows(spark, asyncio.run(run()), "call string, records long")


@query(values([("an unknown pack", "OptionError"), ("an unknown dimension", "OptionError"), ("a hint on no column", "HintError"), ("a hint without quality", "HintError"), ("a hint that no value bears out", "HintError"), ("no such column", "SchemaError"), ("two columns of one name", "SchemaError"), ("an unknown locale", "ValueError"), ("all in order", None)], "what, error"))
def option_checks(spark, d):
    """Settings that a profile refuses."""
    df = table(spark, d, "nation").select("n_nationkey", "n_name")
    run = lambda df=df, **kw: profile_frame(df, Options(**kw))
    calls = {
        "an unknown pack": lambda: run(packs=("all",)), "an unknown dimension": lambda: run(dimensions=("beauty",)), "a hint on no column": lambda: run(hints={"x": "positive"}),
        "a hint without quality": lambda: run(packs=("schema",), hints={"n_nationkey": "positive"}), "a hint that no value bears out": lambda: run(hints={"n_name": "positive"}), "no such column": lambda: run(columns=["x"]),
        "two columns of one name": lambda: run(df.select("n_name", "n_name")), "an unknown locale": lambda: run(locale="xx-YY"), "all in order": lambda: run(packs=("schema",)),
    }
    out = []
    for n, f in calls.items():
        try:
            f()
            out.append((n, None))
        except (errors.GaugeError, ValueError) as e:
            out.append((n, type(e).__name__))
    return rows(spark, out, "what string, error string")


@query(values([("a missing file", 3), ("a folder", 4), ("an unknown ending", 4), ("a small chunk", 2), ("an empty sample", 2), ("an address", 6), ("a pattern", 2), ("a readable file", 0)], "what, code"))
def input_checks(spark, d):
    """What callers give, with exit codes."""
    import tempfile
    from pathlib import Path

    folder = Path(tempfile.mkdtemp(prefix="gaugeworks-"))
    (folder / "a.csv").write_text("a\n1\n")
    (folder / "a.xlsx").write_text("x")
    calls = (("a missing file", validate.file_input, f"{folder}/b.csv"), ("a folder", validate.file_input, str(folder)), ("an unknown ending", validate.file_input, f"{folder}/a.xlsx"), ("a small chunk", validate.chunk_size, 10), ("an empty sample", validate.sample_size, 0), ("an address", validate.database_address, "oracle://h"), ("a pattern", validate.glob_pattern, "a[.csv"), ("a readable file", validate.file_input, f"{folder}/a.csv"))
    return rows(spark, [(n, validate.checked(f, x)[0]) for n, f, x in calls], "what string, code int")


@query(values([("csv,json,jsonl,parquet", True, True, True, True)], "formats, arrow, streaming, remote_parquet, sqlite"))
def capabilities_snapshot(spark, d):
    """What this installation can do."""
    c = capabilities(spark)
    return rows(spark, [(",".join(c.formats), c.arrow_interop, c.streaming, c.remote_parquet, "sqlite" in c.database_connectors)], "formats string, arrow boolean, streaming boolean, remote_parquet boolean, sqlite boolean")


@query(values([("inside", None), ("outside", "Denied"), ("an address", "Denied"), ("a link", "Denied"), ("too large", "LimitReached")], "file, error"))
def sandbox(spark, d):
    """Files that a sandbox lets callers read."""
    import tempfile
    from pathlib import Path

    from gaugeworks.plans.guard import Sandbox

    root = Path(tempfile.mkdtemp(prefix="gaugeworks-")).resolve()
    (root / "a.csv").write_text("a\n1\n")
    (root / "link.csv").symlink_to(root / "a.csv")
    box = Sandbox(root)
    calls = {"inside": lambda: box.resolve("a.csv"), "outside": lambda: box.resolve("../a.csv"), "an address": lambda: box.resolve("http://h/a.csv"), "a link": lambda: box.resolve("link.csv"), "too large": lambda: Sandbox(root, max_bytes=1).resolve("a.csv")}
    return rows(spark, [(n, _error(f)) for n, f in calls.items()], "file string, error string")


@query("SELECT 'customers' AS name, count(*) AS records, 'Identifier' AS key_type, 100.0::DOUBLE AS completeness, 'approximate' AS confidence, 'started,schema,first_pass,values,finished' AS events FROM customer")
def profiler_settings(spark, d):
    """A profile by a chain of settings, and what is told on the way."""
    events: list[str] = []
    p = Profiler(spark).packs("schema", "quality").dimensions("completeness").hint("c_custkey", "identifier").engine("sketched").chunk_size(1 << 20).name("customers").on_progress(lambda what, _: events.append(what))
    r = p.profile(f"{d}/customer.parquet")
    return rows(spark, [(r.source["identifier"], r.execution.rows_processed, r["c_custkey"].data_type, r.dimension_scores["completeness"], r.quality["confidence"], ",".join(dict.fromkeys(events)))], "name string, records long, key_type string, completeness double, confidence string, events string")


# streams


def _stream(spark, d, *columns):
    whole = table(spark, d, "events")
    return spark.readStream.schema(whole.schema).option("pathGlobFilter", "events.parquet").parquet(d).select(*columns)


@query(values([("day", "Date"), ("flag", "Boolean"), ("clock", "Date"), ("number", "Integer"), ("name", "String")], '"column", data_type'))
def stream_types(spark, d):
    """Types of a stream's texts: dates before booleans, by the first values as they stand."""
    day = F.date_format("ts", "dd.MM.yyyy").alias("day")
    clock, flag = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'+01:00'").alias("clock"), F.when(F.col("event_id") % 2 == 0, "TRUE").otherwise("false").alias("flag")
    state, _ = streams.profile_stream(_stream(spark, d, day, flag, clock, F.col("event_id").cast("string").alias("number"), F.concat(F.lit(" "), F.col("event_type")).alias("name")))
    return rows(spark, [(n, c.data_type) for n, c in state.columns.items()], "column string, data_type string")


@query("SELECT 'event_id:Integer|value:Float' AS fingerprint, count(*) AS records FROM events")
def stream_fingerprint(spark, d):
    """The types of a stream's columns as one text."""
    state, _ = streams.profile_stream(_stream(spark, d, "event_id", "value"))
    return rows(spark, [(state.fingerprint(), state.rows)], "fingerprint string, records long")


@query("SELECT 'event_id' AS \"column\", abs(quantile_cont(event_id, 0.5) - quantile_cont(event_id, 0.5)) < 1 AS median_near, true AS distinct_near FROM events")
def stream_sketches(spark, d):
    """A stream's median and distinct values by mergeable sketches, near the exact ones."""
    state, _ = streams.profile_stream(_stream(spark, d, "event_id"))
    got = streams.result(state, spark).first()
    exact = table(spark, d, "events").agg(F.percentile("event_id", F.lit(0.5)).alias("m"), F.count_distinct("event_id").alias("n")).first()
    return rows(spark, [("event_id", abs(got["median"] - exact["m"]) <= 0.03 * exact["m"], abs(got["distinct_count"] - exact["n"]) <= 0.03 * exact["n"])], "column string, median_near boolean, distinct_near boolean")


@query("""SELECT 'mail' AS "column", 'String' AS data_type, 0::BIGINT AS null_count, 'Email' AS pattern, count(*) AS matches, NULL::DOUBLE AS skewness FROM events UNION ALL SELECT 'event_id', 'Integer', 0, NULL, NULL, NULL FROM (SELECT 1)
UNION ALL SELECT 'value', 'Float', count(*) FILTER (WHERE value IS NULL), NULL, NULL, (SELECT round(avg(power((value - m) / sd, 3)), 3) FROM (SELECT value, avg(value) OVER () AS m, stddev_samp(value) OVER () AS sd FROM events WHERE value IS NOT NULL)) FROM events""")
def stream_report(spark, d):
    """A stream's report: types, nulls, patterns and higher moments over all batches."""
    from gaugeworks.plans.stream_report import stream_report as report

    mail = F.concat(F.lit("u"), F.col("event_id").cast("string"), F.lit("@x.org")).alias("mail")
    r = report(streams.profile_stream(_stream(spark, d, "event_id", "value", mail))[0], spark)
    top = lambda c: c.patterns[0] if c.patterns and c.name == "mail" else {}
    skew = lambda c: round(c.stats["skewness"], 3) if c.name == "value" else None
    return rows(spark, [(c.name, c.data_type, c.null_count, top(c).get("name"), top(c).get("match_count"), skew(c)) for c in r.columns], "column string, data_type string, null_count long, pattern string, matches long, skewness double")


@query(values([("max_rows", "max_rows"), ("max_bytes", "max_bytes"), ("stable", "stable"), ("confidence", "confidence"), ("memory", "memory"), ("no memory", None), ("any", "max_rows"), ("all", "max_rows and stable"), ("not all", None), ("never", None)], "condition, reason"))
def stop_conditions(spark, d):
    """When a stream's profile ends."""
    S, c = streams.Stop, streams.ColumnState(total=100, n=100, integers=100, mean=50.0, m2=1.0)
    s = streams.StreamState(rows=100, bytes=5000, columns={"x": c}, stable_rows=60)
    rows_, stable, fixed = S("max_rows", 100), S("stable", 50), S("max_rows", 101)
    given = {"max_rows": rows_, "max_bytes": S("max_bytes", 5000), "stable": stable, "confidence": S("confidence", 0.95), "memory": S("memory", 0.5, bytes=1 << 20), "no memory": S("memory", 0.9, bytes=1 << 50), "any": S("any", parts=(fixed, rows_)), "all": S("all", parts=(rows_, stable)), "not all": S("all", parts=(fixed, stable)), "never": S()}
    return rows(spark, [(n, x.reason(s)) for n, x in given.items()], "condition string, reason string")


@query("SELECT 'started,schema,batch,finished' AS events, count(*) AS records, true AS bytes_counted FROM events")
def stream_progress(spark, d):
    """What a stream's profile tells on its way."""
    told: list[tuple[str, dict]] = []
    state, _ = streams.profile_stream(_stream(spark, d, "event_id", "value"), progress=lambda what, x: told.append((what, x)), interval=0.5)
    return rows(spark, [(",".join(dict.fromkeys(w for w, _ in told)), told[-1][1]["rows"], state.bytes > 0)], "events string, records long, bytes_counted boolean")


@query(values([("fixed", 1000), ("custom", 500), ("adaptive", 100 << 20), ("little memory", 64 << 20), ("large source", 50 << 20)], "kind, bytes"))
def chunk_sizes(spark, d):
    """Bytes that are read at once."""
    C, free = limits.ChunkSize, 1000 << 20
    found = [("fixed", C(1000).of(1 << 40)), ("custom", C(custom=lambda n: n // 2).of(1000)), ("adaptive", C().of(1 << 20, free)), ("little memory", C().of(1 << 20, 1 << 20)), ("large source", C().of(1 << 40, free))]
    return rows(spark, found, "kind string, bytes long")


@query(values([(True, True, True)], "has_peak, peak_covers, options_follow"))
def memory_sampling(spark, d):
    """The most memory that was held, and the options that a chunk size means."""
    with limits.MemorySampler(0.005) as m:
        held = bytearray(32 << 20)
        table(spark, d, "region").count()
    return rows(spark, [(m.peak > 0, m.peak >= m.first + (len(held) >> 1) or m.peak >= m.last, limits.ChunkSize(7).options(1) == {"maxBytesPerTrigger": "7"})], "has_peak boolean, peak_covers boolean, options_follow boolean")

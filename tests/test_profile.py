from __future__ import annotations

import asyncio
import datetime as dt
import json
import random
import shutil
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks import errors
from gaugeworks.operators import aggregates as A
from gaugeworks.operators import frequencies as Q
from gaugeworks.operators import rules, sampling
from gaugeworks.operators.quantiles import exact_quantiles
from gaugeworks.operators import quantiles
from gaugeworks.plans import aio, config, fastpaths
from gaugeworks.plans import quality as qual
from gaugeworks.plans.guard import Sandbox, guarded_profile
from gaugeworks.plans.profile import Profiler, profile, quick_quality_check
from gaugeworks.plans.report import Report, json_schema
from gaugeworks.sources import database, files, memory
from gaugeworks.streaming import profile as stream

ROWS = [
    {"id": k, "name": f"n{k % 7}", "email": f"u{k}@x.org", "age": 20 + k % 50, "score": round(k * 1.25, 2), "active": k % 3 == 0, "start_date": f"2024-01-{k % 28 + 1:02d}", "end_date": f"2024-02-{k % 28 + 1:02d}", "note": None if k % 4 == 0 else "x, y."}
    for k in range(60)
]


@pytest.fixture(scope="module")
def report(spark):
    return profile(spark, ROWS, as_of=dt.date(2025, 1, 1))


def test_types_and_counts(report):
    assert {c.name: c.data_type for c in report.columns} == {"id": "Integer", "name": "String", "email": "String", "age": "Integer", "score": "Float", "active": "Boolean", "start_date": "Date", "end_date": "Date", "note": "String"}
    assert [c.name for c in report.columns] == [*ROWS[0]]
    assert report["note"].null_count == 15 and report["id"].unique_count == 60 and report["name"].unique_count == 7
    assert report["active"].stats == {"true_count": 20, "false_count": 40, "true_ratio": pytest.approx(1 / 3)}


def test_statistics(report):
    ages = [r["age"] for r in ROWS]
    s = report["age"].stats
    assert (s["min"], s["max"], s["mean"], s["median"]) == (min(ages), max(ages), pytest.approx(statistics.mean(ages)), statistics.median(ages))
    assert s["std_dev"] == pytest.approx(statistics.stdev(ages)) and s["mode"] == 20
    assert [s["quartiles"][q] for q in ("q1", "q2", "q3")] == [pytest.approx(x) for x in np.quantile(ages, [0.25, 0.5, 0.75])]
    z = (np.array(ages) - np.mean(ages)) / np.std(ages, ddof=1)
    assert s["skewness"] == pytest.approx((z**3).mean()) and s["kurtosis"] == pytest.approx((z**4).mean() - 3)
    assert report["start_date"].stats["min_datetime"] == "2024-01-01" and report["start_date"].stats["duration_days"] == 27
    assert sum(report["start_date"].stats["day_of_week_distribution"].values()) == 60
    top = report["name"].stats["most_frequent"]
    assert [x["value"] for x in top] == ["n0", "n1", "n2", "n3", "n4", "n5", "n6"] and top[0]["count"] == 9
    assert [p["name"] for p in report["email"].patterns] == ["Email"]


def test_quality(report):
    q = report.quality
    assert q["completeness"]["null_cells"] == 15 and q["completeness"]["complete_rows"] == 45
    assert q["uniqueness"]["duplicate_rows"] == 0 and q["uniqueness"]["key_column"] == "id" and q["uniqueness"]["key_uniqueness"] == 100
    assert q["consistency"]["format_violations"] == 45
    assert q["timeliness"]["pairs"] == 60 and q["timeliness"]["pair_violations"] == 0
    assert report.score == pytest.approx(qual.overall(report.dimension_scores)) and 0 < report.score <= 100


def test_partitions_and_formats_dont_change_a_report(spark, report, tmp_path):
    def told(r):
        return [(c.name, c.null_count, c.unique_count, {k: v if not isinstance(v, float) else round(v, 9) for k, v in c.stats.items()}) for c in r.columns]

    again = profile(spark, memory.from_records(spark, ROWS).repartition(7), as_of=dt.date(2025, 1, 1))
    assert told(again) == told(report) and again.score == pytest.approx(report.score)
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(r) for r in ROWS))
    lines = profile(spark, f"file://{tmp_path}/r.jsonl", as_of=dt.date(2025, 1, 1))
    assert told(lines) == told(report)
    memory.from_records(spark, ROWS).write.parquet(f"{tmp_path}/r.parquet")
    assert told(profile(spark, f"{tmp_path}/r.parquet", as_of=dt.date(2025, 1, 1))) == told(report)


def test_sketches_are_marked(spark):
    r = profile(spark, ROWS, exact=False)
    assert r["id"].unique_count_is_approximate and abs(r["id"].unique_count - 60) <= 2 and r.quality["confidence"] == "approximate"


def test_packs_hints_and_errors(spark):
    bare = profile(spark, ROWS, packs=("schema",))
    assert bare.quality is None and bare["email"].patterns is None and bare["age"].stats == {}
    part = profile(spark, ROWS, packs=("quality",), dimensions=("completeness",))
    assert part.dimension_scores["accuracy"] is None and part.score == part.dimension_scores["completeness"]
    hinted = profile(spark, [{"x": -1, "code": "a"}, {"x": 5, "code": "a"}], hints={"x": "positive", "code": "identifier"})
    assert hinted.quality["accuracy"]["negatives"] == 1 and hinted["code"].data_type == "Identifier" and hinted.quality["uniqueness"]["key_uniqueness"] == 50
    for bad in ({"hints": {"z": "positive"}}, {"hints": {"name": "temporal"}}, {"packs": ("nothing",)}, {"dimensions": ("beauty",)}, {"hints": {"age": "positive"}, "packs": ("schema",)}):
        with pytest.raises(errors.OptionError):
            profile(spark, ROWS, **bad)
    with pytest.raises(errors.SchemaError):
        profile(spark, spark.createDataFrame([(1, 2)], "a int, a int"))
    built = Profiler(spark).packs("quality").dimensions("completeness").thresholds("strict").profile(ROWS)
    assert built.score == part.score
    assert quick_quality_check(spark, ROWS) > 50


def test_empty_and_odd_tables(spark):
    for df in (spark.createDataFrame([], "a string, b double"), spark.createDataFrame([(None, float("nan")), ("", float("inf"))], "a string, b double"), spark.createDataFrame([([1], {"k": 1}, bytearray(b"xy"), None, True)], "a array<int>, b map<string,int>, c binary, d decimal(9,3), e boolean")):
        r = profile(spark, df)
        assert r.to_json() and len(r.columns) == len(df.columns)
    r = profile(spark, spark.createDataFrame([(None, float("nan")), ("", float("inf"))], "a string, b double"))
    assert r["a"].null_count == 2 and r["b"].null_count == 1 and r["b"].stats["max"] is None


def test_row_limits(spark):
    r = profile(spark, ROWS, max_rows=10)
    assert r.execution.rows_processed == 10 and r.execution.truncation_reason == "max_rows" and not r.execution.source_exhausted
    assert profile(spark, ROWS, max_rows=60).execution.truncation_reason is None


def test_quantiles_are_numpys(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 50)
    monkeypatch.setattr(quantiles, "LEAST_FEW", 50)
    monkeypatch.setattr(quantiles, "CELLS", 16)
    r = random.Random(3)
    for values in ([r.gauss(0, 5) for _ in range(3000)], [float(r.randrange(4)) for _ in range(2000)], [1.0], [1.0, 2.0], [5.0] * 999 + [6.0], [r.expovariate(1) ** 5 for _ in range(2500)], [-1.7e308, 1.7e308, *[r.random() for _ in range(300)]]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "x double").repartition(3)
        got = exact_quantiles(df, {"x": F.col("x")}, (0.0, 0.25, 0.5, 0.9, 1.0))["x"]
        assert got == [pytest.approx(q, abs=1e-12) for q in np.quantile(values, [0, 0.25, 0.5, 0.9, 1])]
    assert exact_quantiles(spark.createDataFrame([], "x double"), {"x": F.col("x")})["x"] == [None] * 3


def test_report_documents(spark, report, tmp_path):
    for name in ("r.json", "r.csv", "r.parquet", "r.html", "r.md"):
        report.save(str(tmp_path / name))
        assert (tmp_path / name).stat().st_size
    again = Report.load(str(tmp_path / "r.json"))
    assert again.to_dict() == report.to_dict() and again["email"].patterns[0]["name"] == "Email"
    doc = report.to_dict()
    for bad in ({**doc, "schema_version": 99}, {**doc, "schema_version": True}, {**doc, "schema_version": None}, {"columns": 3}):
        with pytest.raises(errors.ReportError):
            Report.from_dict(bad)
    assert Report.from_dict({k: v for k, v in doc.items() if k != "schema_version"}).schema_version == 1
    assert set(json_schema()["required"]) == set(doc)
    assert report.to_spark(spark).count() == 9 and report.to_pandas().shape[0] == 9 and report.describe()["mean"]["age"]
    assert "quality" in report.to_markdown() and "<table>" in report.to_html() and "60 rows" in repr(report)


def test_summaries_stay_within_their_budget(report):
    for n in (60, 120, 400, 2000):
        text = report.to_llm_context(n)
        assert len(text) <= 4 * n and text.startswith("list: 60 rows")
    assert "... +" in report.to_llm_context(120)
    assert "u1@x.org" not in report.to_llm_context(2000, include_samples=True)


def test_comparison(spark, report):
    other = profile(spark, [{"id": 1, "age": None, "extra": "x"}, {"id": "two", "age": 3, "extra": "y"}])
    got = report.compare(other)
    assert got["schema"]["added"] == ["extra"] and got["schema"]["common"] == ["id", "age"] and "id" in got["schema"]["retyped"]
    assert got["null_percentage"]["age"] == {"a": 0.0, "b": 50.0, "abs": 50.0, "rel_pct": None} and got["null_percentage"]["extra"]["a"] is None


# sources


def test_csv(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('id;text;n\n1;"a ""q"" ; b";2\n2;short\n3;x;4;surplus\n4;"two\nlines";5\n')
    df, info = files.read_csv(spark, f"file://{f}")
    assert info.details["delimiter"] == ";" and info.ragged_rows == 2 and df.columns == ["id", "text", "n"]
    got = {r["id"]: (r["text"], r["n"]) for r in df.collect()}
    assert got["1"] == ('a "q" ; b', "2") and got["2"] == ("short", "") and got["3"] == ("x", "4;surplus") and got["4"][0] == "two\nlines"
    with pytest.raises(errors.MalformedRecords):
        files.read_csv(spark, f"file://{f}", files.CsvOptions(flexible=False))
    _, info, tried = files.read_csv_with_recovery(spark, f"file://{f}")
    assert info.ragged_rows == 2 and len(tried) == 2
    lines = files.validate_csv(spark, f"file://{f}")
    assert (lines.total_lines, lines.unmatched_quotes, lines.delimiter) == (6, 2, ";")
    (tmp_path / "b.csv").write_text("a,a\n1,2\n")
    with pytest.raises(errors.SchemaError):
        files.read_csv(spark, f"file://{tmp_path}/b.csv")


@pytest.mark.parametrize("sign", [",", ";", "\t", "|"])
def test_delimiters(sign):
    rows = [sign.join(x) for x in (["name", "age", "city"], ['"a, b; c"', "3", "x"], ["y", "4", "z"])]
    assert files.detect_delimiter("\n".join(rows).encode()) == sign


def test_formats_and_encodings(spark):
    assert [files.detect_format(x) for x in ("a.csv", "b.TSV", "c.ndjson", "d.json", "e.parquet", "f", "g.xls")] == ["csv", "csv", "jsonl", "json", "parquet", "csv", "unknown"]
    assert files.diagnose_encoding("é".encode()) is None and files.diagnose_encoding(b"caf\xe9 x").encoding == "latin-1"
    assert files.diagnose_encoding(b"\x80 euro").encoding == "windows-1252" and files.diagnose_encoding(b"\xff\xfea\x00").encoding == "utf-16le"
    with pytest.raises(errors.SourceError):
        files.read_path(spark, "file:///no/such.csv")


def test_json(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"b": 1, "a": {"x": [1, 2]}}\n\n{"a": null, "c": true}\nnot json\n{"z":1}{"z":2}\n[1]\n')
    df, info = files.read_jsonl(spark, f"file://{f}")
    assert info.error_count == 3 and df.columns == ["b", "a", "c"]
    assert sorted(map(tuple, df.collect())) == [("", "", "true"), ("1", '{"x":[1,2]}', "")]
    with pytest.raises(errors.MalformedRecords):
        files.read_jsonl(spark, f"file://{f}", strict=True)
    g = tmp_path / "b.json"
    g.write_text('[{"a": 1}, {"a": "x", "b": [1]}, 7]')
    df, info = files.read_json(spark, f"file://{g}")
    assert info.error_count == 1 and df.count() == 2 and df.columns == ["a", "b"]
    g.write_text('{"only": "one"}')
    assert files.read_json(spark, f"file://{g}")[0].collect()[0]["only"] == "one"


def test_memory(spark):
    import pandas as pd
    import pyarrow as pa

    table = pa.table({"a": [1, 2, None], "b": ["x", "y", "z"]})
    for source in (table, pd.DataFrame({"a": [1.0, 2.0, None], "b": ["x", "y", "z"]}), {"a": [1, 2, None], "b": ["x", "y", "z"]}, b"a,b\n1,x\n2,y\n,z\n"):
        r = profile(spark, source, packs=("schema",))
        assert [c.name for c in r.columns] == ["a", "b"] and r["a"].null_count == 1 and r.execution.rows_processed == 3
    assert memory.cell_text({"b": 1, "a": [True]}) == '{"a":[true],"b":1}' and memory.cell_text(True) == "true" and memory.cell_text(float("nan")) is None
    with pytest.raises(errors.SchemaError):
        memory.from_columns(spark, {"a": [1], "b": []})


def test_fast_paths(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,when\n" + "".join(f"{k},2024-01-0{k % 9 + 1}\n" for k in range(1200)))
    path = f"file://{tmp_path}/a.csv"
    got = fastpaths.infer_schema(spark, path)
    assert got.columns == [("id", "Integer"), ("when", "Date")] and got.truncated and got.rows_sampled == 1000
    assert fastpaths.quick_row_count(spark, path).count == 1200
    s = fastpaths.analyze_structure(spark, path)
    assert s.warnings == ["structure_sample_truncated"] and s.columns[0].distinct_count == 1000
    assert fastpaths.quick_row_count(spark, "/root/testdata/sf0.001/lineitem.parquet").method == "footer"
    old, fastpaths.FULL_COUNT_BYTES = fastpaths.FULL_COUNT_BYTES, 100
    try:
        (tmp_path / "b.csv").write_text("id,when\n" + "".join(f"{k},2024-01-0{k % 9 + 1}\n" for k in range(60_000)))
        n = fastpaths.quick_row_count(spark, f"file://{tmp_path}/b.csv")
    finally:
        fastpaths.FULL_COUNT_BYTES = old
    assert not n.exact and abs(n.count - 60_000) < 1500
    assert asyncio.run(aio.quick_row_count(spark, path)).count == 1200


def test_database_queries():
    assert database.select_all("public.orders") == "SELECT * FROM public.orders"
    assert database.select_all("SELECT created_at FROM t WHERE s = 'DROP it'").startswith("SELECT")
    for bad in ("orders; DROP TABLE x", "DROP", "SELECT 1; DELETE FROM t", "SELECT 1 -- x", "SELECT * FROM a UNION SELECT 2", "UPDATE t SET a = 1", "a" * 200, "SELECT " + "x" * 10_001):
        with pytest.raises(errors.UnsafeQuery):
            database.select_all(bad)
    assert "***" in database.safe_message("postgresql://u:secret@h/db") and "secret" not in database.safe_message("password=secret")
    assert database.Database("postgres://h/db").jdbc_url == "jdbc:postgresql://h/db"
    pauses, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("connection reset")
        return 7

    assert database.with_retries(flaky, sleep=pauses.append) == 7 and len(pauses) == 2
    with pytest.raises(ValueError):
        database.with_retries(lambda: (_ for _ in ()).throw(ValueError("syntax")), sleep=pauses.append)
    assert "PARTITION BY k" in sampling.database_sampling("SELECT 1", "stratified", 100, 1000, "k")


def test_chunks(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    lines = [b"x" * rng.choice((0, 1, 9, 300)) + b"\n" for _ in range(3000)]
    (tmp_path / "a.txt").write_bytes(b"".join(lines) + b"open end")
    raw, path = (tmp_path / "a.txt").read_bytes(), str(tmp_path / "a.txt")

    def plain(size):
        at, out = 0, []
        while at < len(raw):
            end = raw.find(b"\n", at + max(1, size) - 1) + 1 or len(raw)
            out.append((at, end))
            at = end
        return out

    reads = []
    for size, looked_at in ((0, 1 << 16), (1, 7), (50, 1 << 16), (1000, 100), (10**9, 10)):
        monkeypatch.setattr(files, "LOOKED_AT", looked_at)
        assert files.chunk_bounds(spark, path, size) == plain(size)
        assert [*files._cut(lambda at, n: reads.append(n) or raw[at : at + n], 0, len(raw), size)] == plain(size)
        # no byte is read twice
        assert sum(reads) < len(raw) + 2 * looked_at
        reads.clear()
    monkeypatch.undo()
    got = lambda: sorted((r["start"], bytes(r["content"])) for r in files.read_chunks(spark, path, 1000).collect())
    assert got() == [(a, raw[a:b]) for a, b in plain(1000)]
    # a file of several stretches, and a folder
    monkeypatch.setattr(files, "STRETCH", 50_000)
    assert len(files.chunk_bounds(spark, path, 50_000)) > 3 and b"".join(c for _, c in got()) == raw and all(c.endswith(b"\n") for _, c in got()[:-1])
    (tmp_path / "b.txt").write_bytes(b"1\n")
    assert {(r["file"].rpartition("/")[2]) for r in files.read_chunks(spark, str(tmp_path), 10).collect()} == {"a.txt", "b.txt"}


# samples, rules


def test_samples(spark):
    df = spark.createDataFrame([(k, k % 3, float(k)) for k in range(200)], "k long, g long, w double").repartition(5)
    keys = lambda d: sorted(r["k"] for r in d.collect())
    S = sampling.Sampling
    assert keys(sampling.sampled(df, S("systematic", interval=10), ["k"])) == [*range(0, 200, 10)]
    assert keys(sampling.stratified(df, ["g"], 2, ["k"])) == [0, 1, 2, 3, 4, 5]
    assert keys(sampling.importance(df, "w", 195)) == [195, 196, 197, 198, 199]
    some = keys(sampling.random(df, 50))
    assert len(some) == 50 and some == keys(sampling.random(df.repartition(2), 50)) != [*range(50)]
    assert len(keys(sampling.weighted(df, 20, "w"))) == 20 and len(keys(sampling.reservoirs(df, "g", 4))) == 12
    assert keys(sampling.progressive(df, 10, 0.9, 1000, ["k"])) == [*range(160)][: len(keys(sampling.progressive(df, 10, 0.9, 1000, ["k"])))]
    two = S("multi_stage", stages=(S("importance", weight="w", threshold=100), S("systematic", interval=50)))
    assert keys(sampling.sampled(df, two, ["k"])) == [100, 150]
    with pytest.raises(ValueError):
        sampling.sampled(df, S("multi_stage", stages=(S("random", size=3), S("systematic", interval=2))))
    assert [r["_position"] for r in sampling.positioned(df, ["k"]).orderBy("k").collect()] == [*range(200)]
    assert sampling.adaptive(10, 1).kind == "none" and sampling.adaptive(10**7, 1).kind == "systematic"


def test_progressive_jobs(spark):
    rng = random.Random(5)
    rows = [(k, rng.gauss(100, 60), None if k % 5 else 0.0) for k in range(2000)]
    df = spark.createDataFrame(rows, "k long, v double, w double").where("k >= 0").repartition(7)

    def plain(initial, confidence, maximum):
        size = initial
        while size < maximum:
            head = [x for x in ([r[c] for r in rows[:size] if r[c] is not None] for c in (0, 1, 2)) if x and statistics.mean(x)]
            if head and max((statistics.stdev(x) if len(x) > 1 else 0) / len(x) ** 0.5 / abs(statistics.mean(x)) for x in head) <= 1 - confidence:
                break
            size *= 2
        return [*range(min(size, maximum, len(rows)))]

    jobs = spark.sparkContext.statusTracker()
    for case in ((10, 0.9, 1500), (1, 0.97, 1500), (3, 0.98, 10**6), (5, 0.9999, 700), (5, 0.9999, 10**6), (100, 0.5, 50), (10, 0.9, 0)):
        assert sorted(r["k"] for r in sampling.progressive(df, *case, ["k"]).collect()) == plain(*case)
    # the table isn't read again for each doubling, of which there are 2 and 17 here
    counts = []
    for maximum in (4, 10**5):
        spark.sparkContext.setJobGroup(f"progressive {maximum}", "")
        sampling.progressive(df, 1, 0.9999, maximum, ["k"])
        counts.append(len(jobs.getJobIdsForGroup(f"progressive {maximum}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] <= counts[0] + 1
    # with a bound, ranges beyond it are left out
    assert sorted(r["k"] for r in sampling.positioned(df, ["k"], most=3).where("_position < 3").collect()) == [0, 1, 2]
    assert sampling.positioned(df, ["k"], most=3).count() < 1500


def test_names():
    assert [rules.likely_id_name(n) for n in ("id", "order_id", "orderKey", "PK", "paid", "valid", "monkey", "userID", "ID2")] == [True, True, True, True, False, False, False, True, True]
    assert rules.likely_date_name("created_at") and not rules.likely_date_name("amount")
    assert rules.date_pairs(["start_date", "end_date"]) == [("start_date", "end_date")]
    assert len(rules.date_pairs(["start_date", "end_date"], compat=True)) == 2
    assert {r[0] for r in rules.range_rules("percentage")} == {"age", "percent"}


def test_scores():
    assert qual.Completeness(100, 25, 10, 3, []).score() == pytest.approx((75 + 30) / 2)
    assert qual.Completeness(0, 0, 0, 0, []).score() is None
    assert qual.Uniqueness(10, 1, "id", 8, 10, []).score() == 85 and qual.Uniqueness(0, None, None, None, None, []).score() is None
    assert qual.Accuracy(100, 10, 200, 4, 6).score() == 85
    assert qual.Timeliness(10, 8, 2, 1, 2, 5, 1).score() == pytest.approx(100 - 25 - 30 - 20)
    assert qual.Precision([("a", 2, 10, 3)]).score() == 70 and qual.Validity([("a", "Email", 10, 9)]).score() == 90
    assert qual.overall({"completeness": 80.0, "accuracy": None}) == 80 and qual.overall({}) == 0


def test_duplicates_take_null_and_empty_for_alike(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", "x"), ("ax", ""), (None, "ax")], "a string, b string")
    assert tuple(A.duplicate_rows(df).first()) == (5, 4, 1)
    counts = {r["column"]: r["distinct_count"] for r in Q.distinct_counts(df.withColumn("c", F.lit(None).cast("string"))).collect()}
    assert counts == {"a": 2, "b": 2, "c": 0}


# streams, sandbox, settings


def test_a_stream_gives_the_tables_profile(spark, tmp_path):
    df = spark.createDataFrame([(k, None if k % 5 == 0 else float(k), f"t{k % 4}") for k in range(500)], "k long, x double, t string")
    df.repartition(5).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    batches = []
    state, why = stream.profile_stream(source, progress=lambda what, x: batches.append(x) if what == "batch" else None)
    got = {r["column"]: r for r in stream.result(state, spark).collect()}
    assert why is None and len(batches) == 5 and state.rows == 500
    assert (got["x"]["null_count"], got["x"]["min"], got["x"]["max"]) == (100, 1.0, 499.0)
    xs = [k for k in range(500) if k % 5]
    assert got["x"]["mean"] == pytest.approx(statistics.mean(xs)) and got["x"]["variance"] == pytest.approx(statistics.variance(xs))
    assert got["t"]["distinct_count"] == 4 and got["k"]["data_type"] == "Integer" and got["t"]["data_type"] == "String"
    again = stream.StreamState.from_json(state.to_json())
    assert stream.fold(again, df, state.last_batch) is again  # a batch that comes again
    stopped, why = stream.profile_stream(source, stream.Stop("max_rows", 150))
    assert why == "max_rows" and 150 <= stopped.rows < 500
    s = stream.Stop("all", parts=(stream.Stop("max_rows", 100), stream.Stop("max_bytes", 1 << 40)))
    assert s.reason(state) is None and stream.schema_inference().reason(stream.StreamState(rows=10_000)) == "max_rows"


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    def put(least: int, most: int) -> None:
        spark.createDataFrame([(float(k),) for k in range(least, most)], "x double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    put(0, 100)
    source = spark.readStream.schema("x double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    at = f"{tmp_path}/checkpoint"
    assert stream.profile_stream(source, checkpoint=at)[0].rows == 100
    put(100, 1000)
    state, _ = stream.profile_stream(source, checkpoint=at)
    assert state.rows == 1000 and state.columns["x"].low == 0 and state.columns["x"].mean == pytest.approx(499.5)
    assert stream.profile_stream(source, checkpoint=at)[0] == state  # nothing new
    r = stream.result(state, spark).first()
    assert abs(r["q1"] - 250) < 40 and abs(r["median"] - 500) < 40 and abs(r["q3"] - 750) < 40
    shutil.rmtree(f"{at}/{stream.STATE_DIR}")
    with pytest.raises(errors.StateError):
        stream.profile_stream(source, checkpoint=at)


def test_a_stopped_stream_loses_no_batch(spark, tmp_path):
    spark.range(500).selectExpr("cast(id as double) as x").repartition(5).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("x double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    state, why = stream.profile_stream(source, stream.Stop("max_rows", 100), checkpoint=f"{tmp_path}/checkpoint")
    assert why == "max_rows" and state.rows < 500
    assert stream.profile_stream(source, checkpoint=f"{tmp_path}/checkpoint")[0].rows == 500


def test_sandbox(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("a,b\n1,2\n3,4\n")
    (tmp_path / "out.csv").write_text("a\n1\n")
    (tmp_path / "in/link.csv").symlink_to(tmp_path / "out.csv")
    box = Sandbox(tmp_path / "in")
    assert guarded_profile(spark, box, "a.csv", packs=("schema",)).execution.rows_processed == 2
    assert guarded_profile(spark, Sandbox(tmp_path / "in", max_rows=1), "a.csv", packs=("schema",)).execution.truncation_reason == "max_rows"
    for bad in ("../out.csv", "link.csv", "http://x/a.csv", "none.csv", str(tmp_path / "out.csv")):
        with pytest.raises(errors.Denied):
            box.resolve(bad)
    with pytest.raises(errors.LimitReached):
        Sandbox(tmp_path / "in", max_bytes=3).resolve("a.csv")


def test_settings(tmp_path):
    c = config.Config(profile="strict", weights={"accuracy": 1.0}, max_rows=5)
    c.save(tmp_path / "c.toml")
    again = config.load(tmp_path / "c.toml", {})
    assert again == c and again.options().thresholds.weights["accuracy"] == 1.0
    assert config.load(tmp_path / "c.toml", {"GAUGEWORKS_MAX_ROWS": "9", "GAUGEWORKS_PACKS": "schema, quality"}).packs == ["schema", "quality"]
    for bad in ({"GAUGEWORKS_PROFILE": "x"}, {"GAUGEWORKS_PACKS": "x"}, {"GAUGEWORKS_TOP": "0"}, {"GAUGEWORKS_LOCALE": "xx"}):
        with pytest.raises(ValueError):
            config.load(tmp_path / "c.toml", bad)

"""A report by sketches says what an exact one says, but for what sketches tell, and shuffles no values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import aggregates as A
from gaugeworks.operators import frequencies as Q
from gaugeworks.plans.profile import Options, profile_frame


@pytest.fixture(scope="module")
def mixed(spark):
    k = F.col("id")
    return spark.range(5000).select(
        k.alias("key"), (k % 7).cast("double").alias("small"), (F.lit(555.1234567) + (k % 3)).alias("phone"), (k * 1.25).alias("price"), F.when(k % 10 == 0, None).otherwise(k + 10_000).alias("zip"),
        F.concat(F.lit("u"), (k % 50).cast("string"), F.lit("@x.org")).alias("mail"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 400).cast("int")).alias("day"), F.concat(F.lit("long "), F.repeat(F.lit("x"), 300), k.cast("string")).alias("log"),
    )


def test_sketched_report(spark, mixed):
    exact, near = profile_frame(mixed), profile_frame(mixed, Options(exact=False))
    for a, b in zip(exact.columns, near.columns, strict=True):
        assert (a.name, a.data_type, a.total_count, a.null_count, a.invalid_count) == (b.name, b.data_type, b.total_count, b.null_count, b.invalid_count)
        assert [(p["name"], p["match_count"]) for p in a.patterns] == [(p["name"], p["match_count"]) for p in b.patterns]
        assert abs(a.unique_count - b.unique_count) <= 0.03 * a.unique_count + 1
        for n in ("min", "max", "mean", "std_dev", "skewness", "kurtosis", "min_length", "duration_days", "mode"):
            if a.stats.get(n) is not None and n != "mode":
                assert b.stats[n] == pytest.approx(a.stats[n], rel=1e-6, abs=1e-9)
    assert near["mail"].stats["most_frequent"][0]["count"] == 100 and near["small"].stats["mode"] == 0
    assert near.quality["precision"] == exact.quality["precision"] and near.dimension_scores["consistency"] == exact.dimension_scores["consistency"]
    assert near.quality["provenance"]["uniqueness"] == "sketched" and exact.quality["provenance"]["uniqueness"] == "exact"


def test_moments_from_power_sums(spark):
    df = spark.range(1000).select((F.pow(F.col("id") % 37, F.lit(3)) + 1e6).alias("x"))
    want = df.agg(*[c.alias(n) for n, c in A.moments(F.col("x")).items()]).first().asDict()
    s = df.agg(*[c.alias(n) for n, c in A.power_sums(F.col("x"), 1e6 + 4000).items()]).first().asDict()
    got = A.moments_of(want["n"], want["mean"], *s.values())
    assert all(got[n] == pytest.approx(want[n], rel=1e-6) for n in got)


def test_a_value_that_looks_like_a_digest(spark):
    rows = [("sha256:" + "a" * 64,)] * 3 + [("x@y.org",), ("z@y.org",)]
    r = profile_frame(spark.createDataFrame(rows, "v string"), Options(packs=("statistics", "patterns")))
    email = next(p for p in r["v"].patterns if p["name"] == "Email")
    assert email["match_percentage"] == 40 and r["v"].unique_count == 3


def test_long_texts_are_matched_whole(spark):
    rows = [("2024-01-01T10:" + "0" * 5000,), ("a" * 5000 + "_b",), ("/" + "/".join(["part"] * 4000),), ("C:\\" + "dir\\" * 3000,), ("word " * 2000,)]
    got = {r["pattern"]: r["match_count"] for r in Q.pattern_counts(spark.createDataFrame(rows, "v string")).collect()}
    assert got == {"DateTime (ISO)": 1, "Labeled Identifier": 1, "File Path (Unix)": 1, "File Path (Windows)": 1}


def test_a_streams_report_is_that_of_its_table(spark, tmp_path, mixed):
    """Two runs over a checkpoint, several batches: types, counts, moments, patterns and scores of the whole."""
    from gaugeworks.plans.stream_report import stream_report
    from gaugeworks.streaming.profile import StreamState, profile_stream

    files, at = str(tmp_path / "rows"), str(tmp_path / "checkpoint")
    texts = mixed.withColumn("mixed", F.when(F.col("key") % 3 == 0, "1,5").otherwise("some text"))
    texts.where("key < 2000").coalesce(1).write.parquet(files)
    stream = spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", 1).parquet(files)
    first, _ = profile_stream(stream, checkpoint=at)
    assert first.rows == 2000
    texts.where("key >= 2000").repartition(3).write.mode("append").parquet(files)
    state, _ = profile_stream(stream, checkpoint=at)
    assert StreamState.from_json(state.to_json()) == state
    got, want = stream_report(state, spark), profile_frame(texts, Options(exact=False))
    for a, b in zip(want.columns, got.columns, strict=True):
        assert (a.name, a.data_type, a.total_count, a.null_count) == (b.name, b.data_type, b.total_count, b.null_count)
        assert [(p["name"], p["match_count"]) for p in a.patterns] == [(p["name"], p["match_count"]) for p in b.patterns]
        for n in ("min", "max", "mean", "std_dev", "skewness", "kurtosis", "min_length", "max_length"):
            if a.stats.get(n) is not None:
                assert b.stats[n] == pytest.approx(a.stats[n], rel=1e-6, abs=1e-9)
        if a.stats.get("median") is not None:
            assert abs(a.stats["median"] - b.stats["median"]) <= 0.05 * (abs(a.stats["max"]) + 1)
    for dimension in ("completeness", "consistency", "validity"):
        assert got.dimension_scores[dimension] == pytest.approx(want.dimension_scores[dimension])
    assert got.dimension_scores["uniqueness"] == pytest.approx(want.dimension_scores["uniqueness"], abs=3)

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.plans.profile import profile


def test_mixed_date_formats_count_by_default(spark):
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))
    slashed = (F.col("id") >= 60) & (F.col("id") % 3 == 0)  # none among the first fifty
    text = F.when(F.col("id") == 5, "").when(slashed, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    df = spark.range(90).select(text.alias("order_date"), text.alias("note"))
    got = profile(spark, df, packs=("quality",), dimensions=("consistency",)).quality["consistency"]
    assert got["format_violations"] == 10 and got["values"] == 178  # a column whose name tells of no date has none
    assert profile(spark, df.select("note"), packs=("quality",), dimensions=("consistency",)).quality["consistency"]["format_violations"] == 0

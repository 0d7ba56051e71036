"""The same calls for asyncio: Spark's jobs run in a thread, the loop goes on."""

from __future__ import annotations

import asyncio

from pyspark.sql import SparkSession

from gaugeworks.plans import fastpaths
from gaugeworks.plans.profile import Options, profile, profile_frame
from gaugeworks.plans.report import Report
from gaugeworks.sources.memory import from_arrow, from_bytes


async def profile_file(spark: SparkSession, path: str, **kw) -> Report:
    return await asyncio.to_thread(profile, spark, path, **kw)


async def profile_bytes(spark: SparkSession, raw: bytes, format: str = "csv", **kw) -> Report:
    return await asyncio.to_thread(_of_bytes, spark, raw, format, kw)


def _of_bytes(spark: SparkSession, raw: bytes, format: str, settings: dict, name: str = "bytes") -> Report:
    options = Options(**settings)
    df, info = from_bytes(spark, raw, format, options.csv, options.strict)
    info.identifier = name
    return profile_frame(df, options, info)


async def infer_schema(spark: SparkSession, source: object, **kw) -> fastpaths.SchemaResult:
    return await asyncio.to_thread(fastpaths.infer_schema, spark, source, **kw)


async def quick_row_count(spark: SparkSession, source: object, **kw) -> fastpaths.RowCount:
    return await asyncio.to_thread(fastpaths.quick_row_count, spark, source, **kw)


async def profile_url(spark: SparkSession, url: str, **kw) -> Report:
    """A file behind http or https, in the format that its path says; fetched by the driver, of Parquet the columns asked for alone."""
    return await asyncio.to_thread(_of_url, spark, url, kw)


def _of_url(spark: SparkSession, url: str, settings: dict) -> Report:
    from gaugeworks.sources import web

    if web.kind_of(url) == "parquet":
        options = Options(**settings)
        table, info = web.parquet_columns(url, options.columns)
        return profile_frame(from_arrow(spark, table), options, info)
    raw, kind = web.fetch(url)
    return _of_bytes(spark, raw, kind, settings, url)

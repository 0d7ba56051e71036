"""Joins with a table of one row a key, whose other side may have most of its rows in a few keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this part of all rows is hot; so there are fewer than ``SHARE`` of them at any size.
SHARE = 1000


def hot_keys(rows: DataFrame, keys: list[str], least: int = 0) -> DataFrame:
    """The keys that more than one row in ``SHARE``, and more than ``least`` rows, have: fewer than ``SHARE`` of them."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # the total comes from the same pass over the counts, as a scalar
    total = rows.count()
    return counted.where((F.col("_n") > total // SHARE) & (F.col("_n") > least)).select(*keys)


def split_join(rows: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", least: int = 10_000) -> DataFrame:
    """``rows`` joined with ``one``, which has one row for each key.

    The rows of hot keys are joined where they are, with fewer than ``SHARE`` rows of ``one`` broadcast; all others meet by
    a shuffle, in which no key has more than one row in ``SHARE``. ``rows`` is read three times, so it should be written.
    Null keys find nothing. ``how`` is inner or left.
    """
    hot = F.broadcast(hot_keys(rows.dropna(subset=keys), keys, least))
    few = F.broadcast(one.join(hot, keys, "left_semi"))
    return rows.join(hot, keys, "left_anti").join(one, keys, how).unionByName(rows.join(hot, keys, "left_semi").join(few, keys, how))

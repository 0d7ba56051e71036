"""Exact quantiles without a sort.

The values between the least and the greatest are counted in equal cells; the cell that holds a wanted rank is cut into cells
again, until few values are left, which come to the driver. So an exact median of any number of rows takes a few passes, each
a small aggregate, and no shuffle of the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.aggregates import one_row

#: Values of a cell that are few, of all columns together and of one at least; cells of a pass.
FEW, LEAST_FEW, CELLS = 160_000, 256, 1024


def exact_quantiles(df: DataFrame, columns: dict[str, Column], shares: tuple[float, ...] = (0.25, 0.5, 0.75), bounds: dict[str, tuple[int, float | None, float | None]] | None = None) -> dict[str, list[float | None]]:
    """Type 7 quantiles (linear between neighbours) of each expression; None where there is no value.

    ``bounds`` has each one's count, least and greatest value, if they are known.
    """
    names, exprs = [*columns], [c.cast("double") for c in columns.values()]
    few = max(LEAST_FEW, FEW // max(8, len(names)))  # what comes to the driver is bounded for many columns, too
    first = {f"{k}_{w}": v for k, n in enumerate(names) for w, v in zip("nab", bounds[n], strict=True)} if bounds else one_row(df, {f"{k}_{w}": f(c) for k, c in enumerate(exprs) for w, f in (("n", F.count), ("a", F.min), ("b", F.max))})
    at: dict[tuple[int, int], dict[int, float]] = {}  # by column and rank: what is known of the order
    ranks = {(k, r) for k in range(len(exprs)) if (n := first[f"{k}_n"]) for s in shares for r in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))}
    # places of ranks: column, bounds, values below and inside
    open_ = {(k, r): (first[f"{k}_a"], first[f"{k}_b"], 0, first[f"{k}_n"]) for k, r in ranks}
    while open_:
        for key, (a, b, _, _) in [*open_.items()]:
            if a == b:
                at[key] = a
                del open_[key]
        spans = sorted({(k, *open_[k, r]) for k, r in open_})
        if not spans:
            break
        cells = []
        for i, (k, a, b, _, inside) in enumerate(spans):
            x = exprs[k]
            # halves first, so that no difference overflows; a cell's number grows with the value
            cell = F.least(F.floor((x / 2 - a / 2) / (b / 2 - a / 2) * CELLS), F.lit(CELLS - 1)) if inside > few else F.lit(-1).cast("long")
            cells.append(F.when(x.between(a, b), F.struct(F.lit(i).alias("i"), cell.alias("cell"), x.alias("x"))))
        rows = df.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*")
        counted: dict[int, list[tuple[float, float, int]]] = {i: [] for i in range(len(spans))}
        if any(s[4] > few for s in spans):
            for r in rows.where("cell >= 0").groupBy("i", "cell").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count(F.lit(1)).alias("n")).collect():
                counted[r["i"]].append((r["a"], r["b"], r["n"]))
        if any(s[4] <= few for s in spans):
            for r in rows.where("cell < 0").groupBy("i", "x").agg(F.count(F.lit(1)).alias("n")).collect():
                counted[r["i"]].append((r["x"], r["x"], r["n"]))
        for i, (k, a, b, below, inside) in enumerate(spans):
            parts, before = sorted(counted[i]), below
            for low, high, n in parts:
                for key in [x for x in open_ if x[0] == k and open_[x] == (a, b, below, inside) and before <= x[1] < before + n]:
                    open_[key] = (low, high, before, n)
                before += n
    out: dict[str, list[float | None]] = {}
    for k, name in enumerate(names):
        n, out[name] = first[f"{k}_n"], []
        for s in shares:
            rank = s * (n - 1)
            if not n:
                out[name].append(None)
                continue
            low, high = at[k, math.floor(rank)], at[k, math.ceil(rank)]
            out[name].append(low + (high - low) * (rank - math.floor(rank)))
    return out

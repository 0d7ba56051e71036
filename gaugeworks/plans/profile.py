"""A profile: one source in, one report out.

The plan is two waves of jobs, each of which run side by side. The first has wide aggregates over the rows, counts, moments,
lengths and rule violations, and the counts of distinct values (of long ones by digest), one shuffle for all columns; what
values say, types, dates and patterns, is judged once for each distinct value. The second has what hangs on the columns' types:
quartiles, which narrow a bracket instead of sorting, modes, most frequent values, duplicates by hash, dates. Only what a
report asked for is planned, so that the scan reads the columns that it needs.

Without ``exact`` nothing that grows with the rows is shuffled: values are judged where they are, and sketches tell distinct
values, quartiles, modes, most frequent values and duplicate rows; least frequent values aren't told.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.errors import HintError, OptionError, SchemaError
from gaugeworks.functions import patterns as R
from gaugeworks.functions import predicates as P
from gaugeworks.operators import aggregates as A
from gaugeworks.operators import frequencies as Q
from gaugeworks.operators import rules
from gaugeworks.operators.fields import Field, fields, spread
from gaugeworks.operators.quantiles import exact_quantiles
from gaugeworks.operators.sampling import Sampling, sampled
from gaugeworks.plans import quality as qual
from gaugeworks.plans.report import ColumnProfile, Execution, Report
from gaugeworks.sources import memory
from gaugeworks.sources.files import CsvOptions, SourceInfo, file_size, read_path
from gaugeworks.streaming.profile import Stop

PACKS = ("schema", "statistics", "patterns", "quality")
HINTS = ("positive", "identifier", "temporal")
ENGINES = ("auto", "exact", "sketched")
#: Jobs of a report that run side by side.
PARALLEL = 6
_PARTITION_BYTES = "spark.sql.files.maxPartitionBytes"


@dataclass
class Options:
    packs: tuple[str, ...] = PACKS
    dimensions: tuple[str, ...] = qual.DIMENSIONS
    columns: list[str] | None = None
    locale: str | None = None
    #: By column: positive, identifier or temporal.
    hints: dict[str, str] = field(default_factory=dict)
    thresholds: qual.Thresholds = field(default_factory=qual.Thresholds)
    sampling: Sampling = field(default_factory=Sampling)
    order: list[str] | None = None
    max_rows: int | None = None
    #: Exact distinct counts and quartiles, or sketches.
    exact: bool = True
    as_of: dt.date | None = None
    top: int = 10
    csv: CsvOptions | None = None
    strict: bool = False
    format: str | None = None

    def check(self, names: list[str]) -> None:
        for what, given, known in (("metric pack", self.packs, PACKS), ("dimension", self.dimensions, qual.DIMENSIONS), ("kind of hint", self.hints.values(), HINTS)):
            if bad := [x for x in given if x not in known]:
                raise OptionError(f"unknown {what}: {', '.join(bad)}")
        if bad := [h for h in self.hints if h not in names]:
            raise HintError(f"hints on unknown columns: {', '.join(bad)}")
        if any(k != "identifier" for k in self.hints.values()) and not self.assesses("accuracy", "timeliness"):
            raise HintError("hints on values have no effect without the quality pack")
        if bad := [c for c in self.columns or [] if c not in names]:
            raise SchemaError(f"unknown columns: {', '.join(bad)}")
        R.parse_locale(self.locale)

    def assesses(self, *dimensions: str) -> bool:
        return "quality" in self.packs and any(d in self.dimensions for d in dimensions)

    @property
    def statistics(self) -> bool:
        return "statistics" in self.packs

    @property
    def patterns(self) -> bool:
        return "patterns" in self.packs or self.assesses("validity")


def profile(spark: SparkSession, source: object, progress: Callable[[str, dict], None] | None = None, **settings) -> Report:
    """A report on a path, DataFrame, dict, list of dicts, bytes, pandas frame or Arrow table."""
    options, tell, began = Options(**settings), progress or (lambda *_: None), time.time()
    tell("started", {"source": str(source)[:200] if isinstance(source, str) else type(source).__name__})
    df, info = read_path(spark, source, options.format, options.csv, options.strict) if isinstance(source, str) else memory.to_frame(spark, source)
    report = profile_frame(df, options, info, tell)
    report.execution.seconds = time.time() - began
    tell("finished", {"rows": report.execution.rows_processed, "seconds": report.execution.seconds})
    return report


def profile_frame(df: DataFrame, options: Options | None = None, info: SourceInfo | None = None, tell: Callable = lambda *_: None) -> Report:
    options = options or Options()
    info = info or SourceInfo("dataframe", "dataframe", "dataframe", df.columns)
    found = fields(df)
    options.check([f.name for f in found])
    if options.columns is not None:
        df = df.select(*[f"`{c}`" for c in df.columns if c in options.columns])
        found = fields(df)
    df = sampled(df, options.sampling, options.order)
    truncated = None
    limited = None
    if options.max_rows is not None:
        # every pass has to see the same rows: they are taken once and kept
        limited = df.limit(options.max_rows + 1).persist()
        if limited.count() > options.max_rows:
            truncated = "max_rows"
        df = limited.limit(options.max_rows)
    elif options.sampling.kind != "none":
        limited = df = df.persist()
    small = spread(df)
    kept = small.persist() if small is not df else None  # it has fewer parts than there are cores
    df = small
    tell("schema", {"columns": [f.name for f in found]})
    held = [x for x in (kept, limited) if x is not None]
    try:
        return _assembled(df, found, options, info, truncated, tell, held)
    finally:
        for x in held:
            x.unpersist()


def _together(tasks: dict[str, Callable]) -> dict:
    """The results of jobs that don't hang on one another, a few at a time: while one is planned, another runs."""
    if len(tasks) < 2:
        return {name: task() for name, task in tasks.items()}
    target = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(PARALLEL) as pool:
        begun = {name: pool.submit(target(task)) for name, task in tasks.items()}
        return {name: f.result() for name, f in begun.items()}


def _parts(df: DataFrame, wanted: dict, size: int = A.MOST_EXPRESSIONS) -> dict[str, Callable]:
    """Jobs for many aggregates of one row, a few dozen each."""
    names = [*wanted]
    return {f"part {at}": lambda at=at: A.one_row(df, {n: wanted[n] for n in names[at : at + size]}) for at in range(0, len(names), size)}


def _all_rows(df: DataFrame, wanted: dict) -> dict:
    return {k: v for part in _together(_parts(df, wanted)).values() for k, v in part.items()}


def _assembled(df, found, o: Options, info, truncated, tell, held: list) -> Report:
    """Two waves of jobs: what rows and values say, then what follows from the columns' types."""
    told = [f.name for f in found if f.kind in (None, "Boolean")]
    counts, first = None, _parts(df, _first_pass(found, o))
    if o.exact and found:
        # the counted values serve several questions: they are kept while this report is made
        sizes = A.one_row(df, {f.name: F.max(F.octet_length(f.text)) for f in found if f.kind in (None, "String")})
        counts = Q.value_counts(df, whole=False, judged=[n for n, size in sizes.items() if (size or 0) >= Q.LONG_TEXT]).persist()
        held.append(counts)

    def of_values() -> tuple[dict, list]:
        by_column = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count")) if counts is not None else A.sketched_distinct(df) if found else None
        distinct = {f.name: 0 for f in found} | ({r["column"]: r["distinct_count"] for r in by_column.collect()} if by_column is not None and (counts is not None or o.statistics or o.assesses("uniqueness")) else {})
        if not told:
            return distinct, []
        values = counts.where(F.col("column").isin(told)) if counts is not None else Q.cells(df, told)
        return distinct, Q.value_facts(values).collect()

    got = _together({"values": of_values, **first})
    distinct, said = got.pop("values")
    facts = {k: v for part in got.values() for k, v in part.items()}
    tell("first_pass", {"rows": facts["rows"]})
    by_name = {f.name: k for k, f in enumerate(found)}
    said = {r["column"]: r.asDict() for r in said}
    nothing = {c: 0 for c in ("non_null", "integers", "floats", "booleans", "dates", "class_numeric", "class_date", "class_boolean", "class_text", "true", "false", "parsed_dates", "distinct")} | {"first": None, "last": None}
    for name in told:
        facts |= {f"{by_name[name]}_{c}": v for c, v in {**nothing, **said.get(name, {})}.items() if c != "column"}
    kinds = {f.name: f.kind or _kind(facts, k) for k, f in enumerate(found)}
    for name, hint in o.hints.items():
        if hint == "identifier":
            kinds[name] = "Identifier"
    return _reported(df, found, o, info, facts, kinds, counts, distinct, truncated, tell)


def _reported(df, found, o: Options, info, facts, kinds, counts, distinct, truncated, tell) -> Report:
    rows, numeric, by_name = facts["rows"], [f for f in found if kinds[f.name] in ("Integer", "Float")], {f.name: k for k, f in enumerate(found)}
    names, doubles, floats = [f.name for f in numeric], [f.name for f in found if f.kind == "Float"], [f.name for f in numeric if kinds[f.name] == "Float"]
    # numbers that are written as text
    texts = {k: f for k, f in enumerate(found) if f.kind is None and facts[f"{k}_floats"]}
    facts |= {f"{k}_{n}": None for k, f in enumerate(found) if f.kind is None for n in A.moments(f.number)} | {f"{k}_n": 0 for k, f in enumerate(found) if f.kind is None}

    def of_numbers() -> tuple[dict, dict, dict]:
        if o.exact:
            bounds = {f.name: tuple(facts[f"{by_name[f.name]}_{w}"] for w in ("n", "min", "max")) for f in numeric} if not texts else None
            quartiles = exact_quantiles(df, {f.name: f.number for f in numeric}, bounds=bounds)
        else:
            got = A.one_row(df, {f"q{k}": F.percentile_approx(f.number, [0.25, 0.5, 0.75], 10_000) for k, f in enumerate(numeric)})
            quartiles = {f.name: got[f"q{k}"] or [None] * 3 for k, f in enumerate(numeric)}
        # with the median at hand the higher moments are sums about it
        wanted = {f"{by_name[f.name]}_{w}": c for f in numeric if f.kind and o.statistics and quartiles[f.name][1] is not None for w, c in A.power_sums(f.number, quartiles[f.name][1]).items()}
        beyond = {f"{by_name[f.name]}_beyond": A.count_if(rules.beyond(f.number, quartiles[f.name], o.thresholds.outlier_factor)) for f in numeric if quartiles[f.name][0] is not None}
        return quartiles, beyond and A.one_row(df, beyond), wanted and A.one_row(df, wanted)

    def of_texts() -> tuple[dict, dict]:
        return _frequent(df, counts, [f.name for f in found if kinds[f.name] in ("String", "Identifier")], o)

    def of_patterns() -> dict:
        out: dict = {}
        masks = Q.counted_masks(counts, doubles) if counts is not None else Q.cell_masks(df)
        for r in masks.collect():
            out.setdefault(r["column"], {})[r["mask"]] = r["n"]
        return out

    def of_scales() -> dict:
        values = Q.counted_scales(counts, floats, doubles) if counts is not None else Q.cell_scales(df, floats)
        return {r["column"]: r for r in Q.precision(values).collect()}

    def of_rows() -> int:
        if o.exact:
            return A.duplicate_rows(df).first()["duplicate_rows"]
        hashed = F.xxhash64(*[f.text for f in found])
        return max(0, rows - min(rows, df.agg(F.hll_sketch_estimate(F.hll_sketch_agg(hashed, F.lit(14)))).first()[0] or 0)) if rows else 0

    def of_dates(name: str) -> dict:
        out: dict = {}
        for r in (A.counted_date_distribution(counts, df, name) if counts is not None else A.date_distribution(df, name)).collect():
            out.setdefault(r["part"], {})[r["key"]] = r["n"]
        return out

    def of_modes() -> dict:
        if counts is not None:
            return {r["column"]: r["mode"] for r in Q.counted_modes(counts, names, [f.name for f in numeric if f.kind]).collect()}
        return A.sketched_modes(df, names)

    tasks: dict[str, Callable] = {}
    if texts:
        tasks["written numbers"] = lambda: _all_rows(df, {f"{k}_{n}": c for k, f in texts.items() for n, c in A.moments(f.number).items()})
    if numeric and (o.statistics or o.assesses("accuracy")):
        tasks["numbers"] = of_numbers
    if o.statistics:
        tasks["texts"] = of_texts
        if numeric:
            tasks["modes"] = of_modes
        tasks |= {f"dates {f.name}": lambda name=f.name: of_dates(name) for f in found if kinds[f.name] == "Date" and rows}
    if o.patterns and found:
        tasks["patterns"] = of_patterns
    if floats and o.assesses("precision"):
        tasks["scales"] = of_scales
    if o.assesses("uniqueness") and found:
        tasks["rows"] = of_rows
    if "quality" in o.packs:
        tasks |= _rule_tasks(df, found, kinds, o)
    if o.hints:
        tasks["hints"] = lambda: [r.asDict() for r in rules.hint_bindings(df, o.hints).collect()]
    got = _together(tasks)
    facts |= got.get("written numbers", {})
    quartiles, beyond, powers = got.get("numbers", ({f.name: [None] * 3 for f in numeric}, {}, {}))
    outlying = {f.name: (beyond or {}).get(f"{by_name[f.name]}_beyond", 0) if (facts[f"{by_name[f.name]}_n"] or 0) >= 4 else 0 for f in numeric} if "numbers" in got else {}
    for f in numeric:
        if f.kind and o.statistics:
            k = by_name[f.name]
            facts |= {f"{k}_{n}": v for n, v in A.moments_of(facts[f"{k}_n"], facts[f"{k}_mean"], *[(powers or {}).get(f"{k}_s{i}") or 0.0 for i in range(1, 5)]).items()}
    tops, bottoms = got.get("texts", ({}, {}))
    masks, calendar = got.get("patterns", {}), {f.name: got[f"dates {f.name}"] for f in found if f"dates {f.name}" in got}
    tell("values", {"columns": len(found)})
    columns = [_column(f, k, facts, kinds[f.name], o, quartiles, distinct, got.get("modes", {}), tops, bottoms, masks, outlying, calendar) for k, f in enumerate(found)]
    quality = _quality(found, facts, kinds, o, columns, distinct, masks, got, outlying, truncated) if "quality" in o.packs and o.dimensions else None
    bindings = got.get("hints", [])
    for b in bindings:
        if b["checked"] and not b["matched"]:
            raise HintError(f"{b['column']}: no value bears out the hint {b['kind']}")
    return Report(
        id=uuid.uuid4().hex,
        timestamp=dt.datetime.now(dt.UTC).isoformat(),
        source={"identifier": info.identifier, "format": info.format, "kind": info.kind, **info.details},
        columns=columns,
        execution=Execution(rows_processed=rows, columns=len(found), ragged_row_count=info.ragged_rows, error_count=info.error_count, source_exhausted=truncated is None, truncation_reason=truncated, sampling=o.sampling.kind, seconds=0.0),
        quality=quality.as_dict() if quality else None,
        dimension_scores=quality.dimension_scores() if quality else None,
        hint_bindings=bindings,
    )


def _frequent(df, counts, names: list[str], o: Options) -> tuple[dict, dict]:
    """The most and the least frequent values of text columns; without counted values the most frequent of a sketch, and no least ones."""
    tops: dict = {}
    bottoms: dict = {}
    if not names:
        return tops, bottoms
    if counts is None:
        return A.sketched_tops(df, names, o.top), bottoms
    some = counts.where(F.col("column").isin(names))
    for least, into in ((False, tops), (True, bottoms)):
        for r in Q.ranked(some, o.top, least).orderBy("column", "rank").collect():
            into.setdefault(r["column"], []).append({"value": r["value"], "count": r["n"], "percentage": r["percentage"], "digest": r["digest"]})
    listed = [(n, x) for into in (tops, bottoms) for n, found in into.items() for x in found]
    long: dict[str, set[str]] = {}
    for n, x in listed:
        if x["digest"]:
            long.setdefault(n, set()).add(x["digest"])
    whole = Q.long_values(df, long) if long else {}
    for _, x in listed:
        x["value"] = whole.get(x.pop("digest"), x["value"])
    return tops, bottoms


def _rule_tasks(df, found, kinds, o: Options) -> dict[str, Callable]:
    """The jobs that rules on values need, by dimension."""
    tasks: dict[str, Callable] = {}
    if o.assesses("accuracy"):
        if any(rules.range_rules(f.name) for f in found):
            tasks["ranges"] = lambda: rules.range_violations(df, [f.name for f in found]).collect()
        if positive := [n for n, h in o.hints.items() if h == "positive"]:
            tasks["negatives"] = lambda: rules.negatives(df, positive).collect()
    if o.assesses("timeliness"):
        dates = [f.name for f in found if kinds[f.name] == "Date" or o.hints.get(f.name) == "temporal"]
        year = (o.as_of or dt.datetime.now(dt.UTC).date()).year
        if dates:
            tasks["timeliness"] = lambda: rules.timeliness(df, dates, year, o.thresholds.stale_years).collect()
        if pairs := rules.date_pairs(dates):
            tasks["order"] = lambda: rules.order_violations(df, pairs).collect()
    return tasks


def _first_pass(found: list[Field], o: Options) -> dict:
    """The aggregates of the first pass, by place of the column."""
    out = {"rows": F.count(F.lit(1))}
    complete = None
    for k, f in enumerate(found):
        null = A.null_cell(f)
        out[f"{k}_null"] = A.count_if(null)
        complete = ~null if complete is None else complete & ~null
        if f.kind in ("Integer", "Float"):
            out |= {f"{k}_{n}": c for n, c in A.plain_moments(f.number).items()} if o.statistics or o.assesses("accuracy") else {f"{k}_n": F.count(f.number)}
        if f.kind in (None, "String"):
            size = F.when(~null, F.octet_length(f.text))
            out |= {f"{k}_min_length": F.min(size), f"{k}_max_length": F.max(size), f"{k}_avg_length": F.avg(size)}
        if f.kind == "Date" and o.statistics:
            d = F.to_date(f.moment)
            out |= {f"{k}_first": F.min(d), f"{k}_last": F.max(d)}
        if o.assesses("consistency") and f.kind in (None, "String"):  # no other type writes commas
            dots, commas = [F.length(f.text) - F.length(F.replace(f.text, F.lit(x), F.lit(""))) for x in ".,"]
            out |= {f"{k}_both": A.count_if(~null & (dots > 0) & (commas > 0)), f"{k}_dots": A.count_if(~null & (dots == 1) & (commas == 0)), f"{k}_commas": A.count_if(~null & (dots == 0) & (commas == 1))}
            out[f"{k}_encoding"] = A.count_if(~null & P.has_encoding_artifact(f.text))
        if o.assesses("consistency") and f.kind is None and rules.likely_date_name(f.name):
            out |= {f"{k}_format{i}": A.count_if(c) for i, c in enumerate(rules.date_formats(f.text))}
    out["complete"] = A.count_if(complete) if complete is not None else F.count(F.lit(1))
    return out


def _kind(facts: dict, k: int) -> str:
    n = facts[f"{k}_non_null"]
    if not n:
        return "String"
    if facts[f"{k}_integers"] == n:
        return "Integer"
    if facts[f"{k}_floats"] / n > 0.8:
        return "Float"
    if facts[f"{k}_booleans"] / n >= 0.9:
        return "Boolean"
    return "Date" if facts[f"{k}_dates"] / n > 0.7 else "String"


def _homogeneity(facts: dict, k: int) -> dict | None:
    if f"{k}_class_numeric" not in facts:
        return None
    counts = {c: facts[f"{k}_class_{c}"] for c in ("numeric", "date", "boolean", "text")}
    total = sum(counts.values())
    dominant = max(counts, key=counts.get) if total else None
    return counts | {"dominant": dominant, "dominant_share": counts[dominant] / total if total else None}


def _column(f, k, facts, kind, o, quartiles, distinct, modes, tops, bottoms, masks, outlying, calendar) -> ColumnProfile:
    total, nulls = facts["rows"], facts[f"{k}_null"]
    stats: dict = {}
    invalid = None
    if kind in ("Integer", "Float"):
        invalid = total - nulls - facts[f"{k}_n"] if f.kind is None else 0
        if o.statistics:
            q = quartiles[f.name]
            stats = {n: facts[f"{k}_{n}"] for n in ("min", "max", "mean", "std_dev", "variance", "coefficient_of_variation", "skewness", "kurtosis")}
            stats |= {"median": q[1], "mode": modes.get(f.name), "outlier_count": outlying.get(f.name), "is_approximate": not o.exact}
            stats["quartiles"] = {"q1": q[0], "q2": q[1], "q3": q[2], "iqr": q[2] - q[0]} if facts[f"{k}_n"] >= 4 and q[0] is not None else None
    elif kind == "Date":
        if f.kind is None:
            invalid = total - nulls - facts[f"{k}_parsed_dates"]
        if o.statistics and facts.get(f"{k}_first"):
            first, last, by = facts[f"{k}_first"], facts[f"{k}_last"], calendar.get(f.name, {})
            stats = {"min_datetime": first.isoformat(), "max_datetime": last.isoformat(), "duration_days": float((last - first).days)}
            stats |= {f"{name}_distribution": by.get(part, {}) for name, part in (("year", "year"), ("month", "month"), ("day_of_week", "weekday"))} | {"hour_distribution": by.get("hour")}
    elif kind == "Boolean" and o.statistics:
        yes, no = facts[f"{k}_true"], facts[f"{k}_false"]
        stats = {"true_count": yes, "false_count": no, "true_ratio": yes / (yes + no) if yes + no else 0.0}
    elif o.statistics and f"{k}_min_length" in facts:
        stats = {n: facts[f"{k}_{n}"] for n in ("min_length", "max_length", "avg_length")} | {"most_frequent": tops.get(f.name, []), "least_frequent": bottoms.get(f.name, [])}
    return ColumnProfile(
        name=f.name,
        data_type=kind,
        total_count=total,
        null_count=nulls,
        unique_count=distinct.get(f.name) if o.statistics else None,
        unique_count_is_approximate=(not o.exact) if o.statistics else None,
        invalid_count=invalid,
        type_homogeneity=_homogeneity(facts, k),
        stats=stats,
        patterns=R.detect(masks.get(f.name, {}), o.locale) if "patterns" in o.packs else None,
    )


def _quality(found, facts, kinds, o, columns, distinct, masks, got: dict, outlying, truncated=None) -> qual.Quality:
    t, rows = o.thresholds, facts["rows"]
    sketched = {} if o.exact else {"uniqueness": ["key_distinct", "high_cardinality_columns", "duplicate_rows"], "accuracy": ["outliers"]}
    out = qual.Quality(low_sample_warning=rows < qual.LEAST_ROWS, weights=dict(t.weights), exact=o.exact, sketched=sketched, sampled=o.sampling.kind != "none" or truncated is not None)
    nulls = {f.name: facts[f"{k}_null"] for k, f in enumerate(found)}
    if o.assesses("completeness"):
        out.completeness = qual.Completeness(rows * len(found), sum(nulls.values()), rows, facts["complete"], [n for n, c in nulls.items() if rows and c / rows > t.null_column])
    if o.assesses("consistency"):
        values = conforming = violations = encoding = 0
        for k, f in enumerate(found):
            n = rows - nulls[f.name]
            values += n
            violations += facts.get(f"{k}_both", 0) + min(facts.get(f"{k}_dots", 0), facts.get(f"{k}_commas", 0))
            encoding += facts.get(f"{k}_encoding", 0)
            conforming += n if f.kind is not None else _conforming(facts, k, kinds[f.name], f.name)
            formats = [facts[f"{k}_format{i}"] for i in range(len(P.DATE_FORMATS)) if f"{k}_format{i}" in facts]
            violations += sum(formats) - max(formats, default=0)
        out.consistency = qual.Consistency(values, conforming, violations, encoding, values)
    if o.assesses("uniqueness"):
        keys = [n for n, h in o.hints.items() if h == "identifier"] + [f.name for f in found if rules.likely_id_name(f.name)]
        key = keys[0] if keys else None
        wide = [f.name for f in found if rows and f.name not in keys and distinct.get(f.name, 0) / rows > t.high_cardinality]
        out.uniqueness = qual.Uniqueness(rows, got.get("rows"), key, distinct.get(key) if key else None, rows if key else None, wide)
    if o.assesses("accuracy"):
        numeric = [c for c in columns if c.data_type in ("Integer", "Float")]
        numbers = {f.name: facts[f"{k}_n"] for k, f in enumerate(found) if f"{k}_n" in facts}
        enough = [c.name for c in numeric if numbers[c.name] >= t.outlier_least]
        ranges, below = got.get("ranges", []), sum(r["negative"] for r in got.get("negatives", []))
        out.accuracy = qual.Accuracy(sum(numbers[n] for n in enough), sum(outlying.get(n, 0) for n in enough), sum(numbers.values()), sum(r["violations"] for r in ranges), below)
    if o.assesses("timeliness"):
        pairs = got.get("order", [])
        total = lambda c: sum(r[c] for r in got.get("timeliness", []))
        out.timeliness = qual.Timeliness(total("checked"), total("valid"), total("invalid"), total("future"), total("stale"), sum(r["checked"] for r in pairs), sum(r["violations"] for r in pairs))
    if o.assesses("validity"):
        strong = []
        for f in found:
            best = [p for p in R.detect(masks.get(f.name, {}), o.locale) if p["confidence"] >= t.pattern_confidence][:1]
            if best:
                n = rows - nulls[f.name]
                strong.append((f.name, best[0]["name"], n, min(best[0]["match_count"], n)))
        out.validity = qual.Validity(strong)
    if o.assesses("precision"):
        out.precision = qual.Precision([(n, r["modal_scale"], r["checked"], r["deviating"]) for n, r in got.get("scales", {}).items()])
    return out


def _conforming(facts: dict, k: int, kind: str, name: str) -> int:
    """Values of a text column that are what the column is."""
    if kind == "Integer":
        return facts[f"{k}_integers"]
    if kind == "Float":
        return facts[f"{k}_floats"]
    if kind == "Boolean":
        return facts[f"{k}_booleans"]
    if kind == "Date" or rules.likely_date_name(name):
        return facts[f"{k}_class_date"]
    return max(facts[f"{k}_class_{c}"] for c in ("numeric", "date", "boolean", "text"))


class Profiler:
    """The options as a chain of calls: ``Profiler(spark).packs("schema").locale("IT").profile(path)``."""

    def __init__(self, spark: SparkSession):
        self._spark, self._settings, self._progress = spark, {}, None
        self._chunk: int | None = None
        self._memory: int | None = None
        self._name: str | None = None
        self._stop: Stop | None = None

    def _set(self, **kw) -> Profiler:
        self._settings |= kw
        return self

    def packs(self, *names: str) -> Profiler:
        return self._set(packs=names)

    def dimensions(self, *names: str) -> Profiler:
        # none at all: no quality
        return self._set(dimensions=names) if names else self._set(packs=tuple(p for p in self._settings.get("packs", PACKS) if p != "quality"))

    def columns(self, *names: str) -> Profiler:
        return self._set(columns=[*names])

    def locale(self, tag: str | None) -> Profiler:
        return self._set(locale=tag)

    def hint(self, column: str, kind: str) -> Profiler:
        return self._set(hints=self._settings.get("hints", {}) | {column: kind})

    def thresholds(self, profile_or_thresholds: str | qual.Thresholds) -> Profiler:
        t = profile_or_thresholds
        return self._set(thresholds=qual.PROFILES[t] if isinstance(t, str) else t)

    def sampling(self, how: Sampling, order: list[str] | None = None) -> Profiler:
        return self._set(sampling=how, order=order or self._settings.get("order"))

    def max_rows(self, n: int | None) -> Profiler:
        return self._set(max_rows=n)

    def exact(self, yes: bool = True) -> Profiler:
        return self._set(exact=yes)

    def as_of(self, day: dt.date) -> Profiler:
        return self._set(as_of=day)

    def top(self, n: int) -> Profiler:
        return self._set(top=n)

    def csv(self, **kw) -> Profiler:
        return self._set(csv=CsvOptions(**kw))

    def strict(self, yes: bool = True) -> Profiler:
        return self._set(strict=yes)

    def format(self, name: str) -> Profiler:
        return self._set(format=name)

    def csv_delimiter(self, sign: str) -> Profiler:
        return self._csv(delimiter=sign)

    def csv_flexible(self, yes: bool = True) -> Profiler:
        return self._csv(flexible=yes)

    def _csv(self, **kw) -> Profiler:
        return self._set(csv=replace(self._settings.get("csv") or CsvOptions(), **kw))

    def engine(self, name: str) -> Profiler:
        """``auto`` and ``exact`` give exact reports, ``sketched`` one of bounded state."""
        if name not in ENGINES:
            raise OptionError(f"{name}: one of {', '.join(ENGINES)} is meant")
        return self._set(exact=name != "sketched")

    def chunk_size(self, size: int | None) -> Profiler:
        """Bytes of a file that one task reads; None is the session's own."""
        self._chunk = size
        return self

    def memory_limit_mb(self, megabytes: int | None) -> Profiler:
        """Megabytes that an exact report's counted values may take: a source that is larger is reported by sketches."""
        self._memory = megabytes
        return self

    def name(self, text: str) -> Profiler:
        """The source's name in the report."""
        self._name = text
        return self

    def stop(self, condition: Stop) -> Profiler:
        """When a stream's profile ends; of other sources the rows that the condition lets through are profiled."""
        self._stop = condition
        rows = condition.rows()
        return self if rows is None else self._set(max_rows=rows)

    def on_progress(self, tell: Callable[[str, dict], None]) -> Profiler:
        self._progress = tell
        return self

    def profile(self, source: object) -> Report:
        settings, conf = dict(self._settings), self._spark.conf
        if self._memory is not None and isinstance(source, str) and file_size(self._spark, source) > self._memory << 20:
            settings["exact"] = False
        before = conf.get(_PARTITION_BYTES)
        if self._chunk is not None:
            conf.set(_PARTITION_BYTES, str(self._chunk))
        try:
            report = profile(self._spark, source, self._progress, **settings)
        finally:
            conf.set(_PARTITION_BYTES, before)
        if self._name is not None:
            report.source["identifier"] = self._name
        return report


def quick_quality_check(spark: SparkSession, source: object) -> float:
    """The overall score alone."""
    return profile(spark, source, packs=("quality",)).quality["score"]

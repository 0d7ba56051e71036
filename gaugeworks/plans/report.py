"""Reports: what a profile found, as a document that can be saved, read again, compared and told in few words."""

from __future__ import annotations

import html
import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.errors import ReportError
from gaugeworks.functions.predicates import one_line

SCHEMA_VERSION = 1
#: Columns that a printed report shows; shares of a summary's tokens for flags, schema and patterns.
SHOWN, SHARES = 15, (0.45, 0.40, 0.15)
_RATIOS = {"percentage", "match_percentage", "q1", "q2", "q3", "iqr", "missing_ratio", "complete_ratio", "type_share", "key_uniqueness", "outlier_ratio", "stale_ratio", "score"}


def round_half_away(v: float | None, digits: int) -> float | None:
    """Half away from zero on the binary double; None for numbers that aren't finite."""
    if v is None or not math.isfinite(v):
        return None
    k = 10**digits
    if abs(v) * k >= 2**53:
        return v
    up = math.floor(abs(v) * k)
    return math.copysign((up + (abs(v) * k - up >= 0.5)) / k, v) if v else 0.0


def rounded(value: object, key: str = "") -> object:
    """Percentages and quartiles with two decimals, other numbers with four, all through a document."""
    if isinstance(value, float):
        return round_half_away(value, 2 if key in _RATIOS else 4)
    if isinstance(value, dict):
        return {k: rounded(v, k) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [rounded(v, key) for v in value]
    return value


@dataclass
class ColumnProfile:
    name: str
    data_type: str
    total_count: int
    null_count: int
    unique_count: int | None = None
    unique_count_is_approximate: bool | None = None
    invalid_count: int | None = None
    type_homogeneity: dict | None = None
    stats: dict = field(default_factory=dict)
    #: None if patterns weren't looked for, empty if none was found.
    patterns: list[dict] | None = None

    @property
    def null_percentage(self) -> float:
        return self.null_count / self.total_count * 100 if self.total_count else 0.0

    def record(self) -> dict:
        """All numbers on one level."""
        q, top = self.stats.get("quartiles") or {}, (self.patterns or [{}])[0]
        flat = {k: v for k, v in self.stats.items() if not isinstance(v, (dict, list))}
        names = ("min", "max", "mean", "median", "mode", "std_dev", "variance", "coefficient_of_variation", "skewness", "kurtosis", "outlier_count", "is_approximate", "min_length", "max_length", "avg_length", "min_datetime", "max_datetime", "duration_days", "true_count", "false_count", "true_ratio")
        homogeneity = self.type_homogeneity or {}
        return rounded(
            {"column_name": self.name, "data_type": self.data_type, "total_count": self.total_count, "null_count": self.null_count, "null_percentage": self.null_percentage, "unique_count": self.unique_count, "unique_count_is_approximate": self.unique_count_is_approximate, "invalid_count": self.invalid_count, "dominant_type": homogeneity.get("dominant"), "dominant_share": homogeneity.get("dominant_share")}
            | {n: flat.get(n) for n in names}
            | {n: q.get(n) for n in ("q1", "q2", "q3", "iqr")}
            | {"top_pattern": top.get("name"), "top_pattern_percentage": top.get("match_percentage"), "top_pattern_confidence": top.get("confidence")}
        )


@dataclass
class Execution:
    rows_processed: int
    columns: int
    ragged_row_count: int = 0
    error_count: int = 0
    source_exhausted: bool = True
    truncation_reason: str | None = None
    sampling: str = "none"
    seconds: float = 0.0


@dataclass
class Report:
    id: str
    timestamp: str
    source: dict
    columns: list[ColumnProfile]
    execution: Execution
    quality: dict | None = None
    dimension_scores: dict | None = None
    hint_bindings: list[dict] = field(default_factory=list)
    schema_version: int = SCHEMA_VERSION

    def __getitem__(self, name: str) -> ColumnProfile:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(name)

    @property
    def score(self) -> float | None:
        return self.quality["score"] if self.quality else None

    # documents

    def to_dict(self) -> dict:
        return rounded(asdict(self))

    def to_json(self, indent: int | None = 2) -> str:
        return json.dumps(self.to_dict(), indent=indent, ensure_ascii=False, default=str)

    @classmethod
    def from_dict(cls, doc: dict) -> Report:
        """A document of this version or an older one; one without a version is the oldest."""
        version = doc.get("schema_version", 0)
        if isinstance(version, bool) or not isinstance(version, int):
            raise ReportError("the document's version isn't a number")
        if version > SCHEMA_VERSION:
            raise ReportError(f"a document of version {version}, newer than {SCHEMA_VERSION}")
        try:
            return cls(**(doc | {"schema_version": SCHEMA_VERSION, "columns": [ColumnProfile(**c) for c in doc["columns"]], "execution": Execution(**doc["execution"])}))
        except (KeyError, TypeError) as e:
            raise ReportError(f"not a report: {e}") from None

    @classmethod
    def from_json(cls, text: str) -> Report:
        try:
            doc = json.loads(text)
        except ValueError as e:
            raise ReportError(f"not JSON: {e}") from None
        if not isinstance(doc, dict):
            raise ReportError("not a report")
        return cls.from_dict(doc)

    def save(self, path: str) -> None:
        """By the name's ending: .json whole; .csv, .parquet the columns' records; .html, .md to read."""
        ending = path.rpartition(".")[2].lower()
        if ending == "parquet":
            import pyarrow.parquet as pq

            pq.write_table(self.to_arrow(), path)
            return
        if ending == "csv":
            import csv

            with open(path, "w", newline="", encoding="utf-8") as f:
                out = csv.DictWriter(f, [*self.records()[0]] if self.columns else ["column_name"])
                out.writeheader()
                out.writerows(self.records())
            return
        text = {"json": self.to_json, "html": self.to_html, "md": self.to_markdown}.get(ending)
        if text is None:
            raise ReportError(f"{path}: .json, .csv, .parquet, .html or .md is meant")
        with open(path, "w", encoding="utf-8") as f:
            f.write(text())

    @classmethod
    def load(cls, path: str) -> Report:
        with open(path, encoding="utf-8") as f:
            return cls.from_json(f.read())

    # tables

    def records(self) -> list[dict]:
        return [c.record() for c in self.columns]

    def to_arrow(self):
        import pyarrow as pa

        rows = [{k: str(v) if k in ("min", "max", "mode") and v is not None else v for k, v in r.items()} for r in self.records()]
        return pa.Table.from_pylist(rows)

    def to_pandas(self):
        import pandas as pd

        return pd.DataFrame(self.records())

    def to_spark(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.to_arrow())

    def describe(self) -> dict[str, dict]:
        """The numeric columns' records, turned: statistic, then column."""
        numeric = [c.record() for c in self.columns if c.data_type in ("Integer", "Float")]
        return {k: {r["column_name"]: r[k] for r in numeric} for k in ("total_count", "null_count", "mean", "std_dev", "min", "q1", "median", "q3", "max")}

    def quality_summary(self) -> dict:
        return rounded({"source": self.source.get("identifier"), "rows": self.execution.rows_processed, "columns": self.execution.columns, "score": self.score, **(self.dimension_scores or {})}, "score")

    # to read

    def __repr__(self) -> str:
        score = "" if self.score is None else f", score {self.score:.1f}"
        return f"<Report of {one_line(str(self.source.get('identifier')))}: {self.execution.rows_processed} rows, {len(self.columns)} columns{score}>"

    def _rows(self) -> list[list[str]]:
        return [[one_line(c.name), c.data_type, f"{c.null_percentage:.2f}", "" if c.unique_count is None else str(c.unique_count), ", ".join(p["name"] for p in (c.patterns or [])[:2])] for c in self.columns[:SHOWN]]

    def to_markdown(self) -> str:
        lines = [f"# {one_line(str(self.source.get('identifier')))}", "", f"{self.execution.rows_processed} rows, {len(self.columns)} columns" + ("" if self.score is None else f", quality {self.score:.1f}"), "", "| column | type | null % | distinct | patterns |", "|---|---|---|---|---|"]
        lines += ["| " + " | ".join(x.replace("|", "\\|") for x in row) + " |" for row in self._rows()]
        if len(self.columns) > SHOWN:
            lines.append(f"\n... and {len(self.columns) - SHOWN} more columns")
        if self.dimension_scores:
            lines += ["", "| dimension | score |", "|---|---|", *[f"| {d} | {'not assessed' if s is None else f'{s:.1f}'} |" for d, s in self.dimension_scores.items()]]
        return "\n".join(lines) + "\n"

    def to_html(self) -> str:
        badge = "" if self.score is None else f'<span style="background:{"#2a2" if self.score >= 90 else "#c80" if self.score >= 70 else "#c22"};color:#fff;padding:2px 8px">{self.score:.1f}</span>'
        rows = "".join("<tr>" + "".join(f"<td>{html.escape(x)}</td>" for x in row) + "</tr>" for row in self._rows())
        more = f"<p>... and {len(self.columns) - SHOWN} more columns</p>" if len(self.columns) > SHOWN else ""
        return f"<h2>{html.escape(one_line(str(self.source.get('identifier'))))} {badge}</h2><table><tr><th>column</th><th>type</th><th>null %</th><th>distinct</th><th>patterns</th></tr>{rows}</table>{more}"

    _repr_html_ = to_html

    def may_show_values(self, column: ColumnProfile) -> bool:
        """Whether a column's values can be told: patterns were looked for and none of contact, finance or identity was found."""
        return column.patterns is not None and not any(p["category"] in ("contact", "financial", "identifier") for p in column.patterns)

    def flags(self, c: ColumnProfile) -> list[str]:
        """What a reader should know about a column first, the gravest first."""
        return [text for _, text in self.graded_flags(c)]

    def graded_flags(self, c: ColumnProfile) -> list[tuple[float, str]]:
        """A column's flags with how grave they are: the share of its cells that they are about, a constant column 60, outliers 50 at most."""
        out, null = [], c.null_percentage
        if c.total_count and c.null_count == c.total_count:
            out.append((100.0, "all null"))
        elif null >= 50:
            out.append((null, f"{null:.0f}% null"))
        elif null >= 5:
            out.append((null, f"{null:.1f}% null"))
        if c.invalid_count:
            out.append((c.invalid_count / c.total_count * 100, f"{c.invalid_count} values don't parse as {c.data_type}"))
        if c.unique_count == 1 and c.total_count > 1 and null < 50:
            out.append((60.0, "constant"))
        if n := c.stats.get("outlier_count"):
            out.append((min(50.0, n / c.total_count * 100), f"{n} outliers"))
        h = c.type_homogeneity or {}
        if h.get("dominant_share") is not None and h["dominant_share"] < 0.95 and c.data_type == "String":
            out.append(((1 - h["dominant_share"]) * 100, "mixed: " + ", ".join(f"{h[k]} {k}" for k in ("numeric", "date", "boolean", "text") if h[k])))
        return sorted(out, key=lambda x: -x[0])

    def to_llm_context(self, max_tokens: int = 800, include_samples: bool = False) -> str:
        """A summary within a number of tokens (four signs each): caveats, then flags, schema and patterns, each within its share."""
        cost = lambda s: -(-len(s) // 4)
        e = self.execution
        first = f"{one_line(str(self.source.get('identifier')))}: {e.rows_processed} rows, {len(self.columns)} columns" + ("" if self.score is None else f", quality {self.score:.1f}/100")
        notes = [f"cut short by {e.truncation_reason}"] if e.truncation_reason else []
        notes += [f"{e.error_count} malformed records"] if e.error_count else []
        notes += [f"{e.ragged_row_count} ragged rows"] if e.ragged_row_count else []
        notes += [f"sample: {e.sampling}"] if e.sampling != "none" else []
        out = [first, *([f"caveats: {'; '.join(notes)}"] if notes else [])]
        left = max_tokens - cost("\n".join(out))
        graded = sorted(((f[0][0], f"- {one_line(c.name)}: {'; '.join(x for _, x in f)}") for c in self.columns if (f := self.graded_flags(c))), key=lambda x: -x[0])
        flagged = [line for _, line in graded]
        schema = []
        for c in self.columns:
            line = f"- {one_line(c.name)} {c.data_type}"
            if include_samples and self.may_show_values(c) and c.stats.get("most_frequent"):
                line += " e.g. " + ", ".join(one_line(x["value"])[:40] for x in c.stats["most_frequent"][:3])
            schema.append(line)
        patterns = [f"- {one_line(c.name)}: " + ", ".join(f"{p['name']} ({p['match_percentage']:.0f}%)" for p in c.patterns) for c in self.columns if c.patterns]
        for title, lines, part in zip(("flags", "schema", "patterns"), (flagged, schema, patterns), SHARES, strict=True):
            if not lines:
                continue
            budget = min(left, int(max_tokens * part))
            section, used = [], cost(f"{title}:\n")
            for k, line in enumerate(lines):
                tail = f"... +{len(lines) - k} more"
                if used + cost(line + "\n") + (cost(tail) if k < len(lines) - 1 else 0) > budget:
                    section.append(tail)
                    break
                section.append(line)
                used += cost(line + "\n")
            text = f"{title}:\n" + "\n".join(section)
            if cost(text) > left or section and section[0].startswith("... +"):
                break  # a starved section ends the summary: a lesser one isn't told in its place
            out.append(text)
            left -= cost(text)
        return "\n".join(out)

    # algebra

    def compare(self, other: Report) -> dict:
        """Differences from this report to another: scores, null percentages over the union of columns, schema."""

        def difference(a: float | None, b: float | None) -> dict:
            both = a is not None and b is not None
            return {"a": a, "b": b, "abs": b - a if both else None, "rel_pct": (b - a) / abs(a) * 100 if both and a else None}

        mine, theirs = {c.name: c for c in self.columns}, {c.name: c for c in other.columns}
        names = [*mine, *[n for n in theirs if n not in mine]]
        nulls = lambda side, n: side[n].null_percentage if n in side else None
        scores = {d: difference((self.dimension_scores or {}).get(d), (other.dimension_scores or {}).get(d)) for d in {**(self.dimension_scores or {}), **(other.dimension_scores or {})}}
        return rounded(
            {
                "score": difference(self.score, other.score),
                "dimensions": scores,
                "null_percentage": {n: difference(nulls(mine, n), nulls(theirs, n)) for n in names},
                "schema": {"added": [n for n in theirs if n not in mine], "removed": [n for n in mine if n not in theirs], "common": [n for n in mine if n in theirs], "retyped": [n for n in mine if n in theirs and mine[n].data_type != theirs[n].data_type]},
            }
        )


def json_schema() -> dict:
    """The JSON Schema of a report's document."""
    number, text, count = {"type": ["number", "null"]}, {"type": "string"}, {"type": "integer", "minimum": 0}
    column = {"name": text, "data_type": {"enum": ["String", "Identifier", "Integer", "Float", "Date", "Boolean"]}, "total_count": count, "null_count": count, "unique_count": {"type": ["integer", "null"]}, "unique_count_is_approximate": {"type": ["boolean", "null"]}, "invalid_count": {"type": ["integer", "null"]}, "type_homogeneity": {"type": ["object", "null"]}, "stats": {"type": "object"}, "patterns": {"type": ["array", "null"], "items": {"type": "object", "required": ["name", "match_count", "confidence"]}}}
    execution = {"rows_processed": count, "columns": count, "ragged_row_count": count, "error_count": count, "source_exhausted": {"type": "boolean"}, "truncation_reason": {"type": ["string", "null"]}, "sampling": text, "seconds": number}
    obj = lambda props: {"type": "object", "properties": props, "required": [*props], "additionalProperties": False}
    top = {"schema_version": {"const": SCHEMA_VERSION}, "id": text, "timestamp": text, "source": {"type": "object"}, "columns": {"type": "array", "items": obj(column)}, "execution": obj(execution), "quality": {"type": ["object", "null"]}, "dimension_scores": {"type": ["object", "null"]}, "hint_bindings": {"type": "array"}}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "profile report", **obj(top)}

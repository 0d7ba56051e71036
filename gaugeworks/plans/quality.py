"""The quality dimensions: facts counted elsewhere, scores from 0 to 100, and the weighted whole."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

# fixed values: weights of the dimensions
WEIGHTS = {"completeness": 0.25, "consistency": 0.20, "uniqueness": 0.15, "accuracy": 0.15, "timeliness": 0.10, "validity": 0.10, "precision": 0.05}
DIMENSIONS = tuple(WEIGHTS)
LEAST_ROWS = 10


@dataclass(frozen=True)
class Thresholds:
    """Limits that the dimensions' facts are judged by."""

    null_column: float = 0.5
    high_cardinality: float = 0.95
    outlier_factor: float = 1.5
    outlier_least: int = 4
    stale_years: int = 5
    pattern_confidence: float = 0.5
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))


PROFILES = {
    "default": Thresholds(),
    "strict": Thresholds(null_column=0.3, high_cardinality=0.98, outlier_factor=1.5, outlier_least=10, stale_years=2),
    "lenient": Thresholds(null_column=0.7, high_cardinality=0.9, outlier_factor=2.0, outlier_least=4, stale_years=10),
}


def bounded(x: float) -> float:
    return max(0.0, min(100.0, x))


def share(part: float, whole: float) -> float:
    return part / whole * 100 if whole else 0.0


@dataclass
class Completeness:
    cells: int
    null_cells: int
    rows: int
    complete_rows: int
    null_columns: list[str]

    @property
    def missing_ratio(self) -> float:
        return share(self.null_cells, self.cells)

    @property
    def complete_ratio(self) -> float:
        return share(self.complete_rows, self.rows)

    def score(self) -> float | None:
        return bounded((100 - self.missing_ratio + self.complete_ratio) / 2) if self.cells else None


@dataclass
class Consistency:
    values: int
    conforming: int
    format_violations: int
    encoding_issues: int
    checked: int

    @property
    def type_share(self) -> float:
        return share(self.conforming, self.values) if self.values else 100.0

    def score(self) -> float | None:
        return bounded(self.type_share - share(self.format_violations + self.encoding_issues, self.checked)) if self.checked else None


@dataclass
class Uniqueness:
    rows: int
    duplicate_rows: int | None
    key_column: str | None
    key_distinct: int | None
    key_total: int | None
    high_cardinality_columns: list[str]

    @property
    def key_uniqueness(self) -> float | None:
        return share(self.key_distinct, self.key_total) if self.key_total else None

    def score(self) -> float | None:
        parts = [] if self.duplicate_rows is None or not self.rows else [100 - share(self.duplicate_rows, self.rows)]
        parts += [] if self.key_uniqueness is None else [self.key_uniqueness]
        return bounded(sum(parts) / len(parts)) if parts else None


@dataclass
class Accuracy:
    numbers: int
    outliers: int
    checked: int
    range_violations: int
    negatives: int

    @property
    def outlier_ratio(self) -> float:
        return share(self.outliers, self.numbers)

    def score(self) -> float | None:
        return bounded(100 - self.outlier_ratio - share(self.range_violations + self.negatives, self.checked)) if self.checked else None


@dataclass
class Timeliness:
    checked: int
    valid: int
    invalid: int
    future: int
    stale: int
    pairs: int
    pair_violations: int

    @property
    def stale_ratio(self) -> float:
        return share(self.stale, self.valid)

    def score(self) -> float | None:
        if not self.checked:
            return None
        return bounded(100 - self.stale_ratio - share(self.future + self.invalid, self.checked) - share(self.pair_violations, self.pairs))


@dataclass
class Validity:
    #: column, pattern, values checked, valid values
    columns: list[tuple[str, str, int, int]]

    @property
    def checked(self) -> int:
        return sum(c[2] for c in self.columns)

    @property
    def valid(self) -> int:
        return sum(c[3] for c in self.columns)

    def score(self) -> float | None:
        return bounded(share(self.valid, self.checked)) if self.checked else None


@dataclass
class Precision:
    #: column, modal scale, numbers checked, numbers of another scale
    columns: list[tuple[str, int, int, int]]

    def score(self) -> float | None:
        checked = sum(c[2] for c in self.columns)
        return bounded(100 - share(sum(c[3] for c in self.columns), checked)) if checked else None


@dataclass
class Quality:
    """The dimensions that were assessed; None stands for one that wasn't."""

    completeness: Completeness | None = None
    consistency: Consistency | None = None
    uniqueness: Uniqueness | None = None
    accuracy: Accuracy | None = None
    timeliness: Timeliness | None = None
    validity: Validity | None = None
    precision: Precision | None = None
    low_sample_warning: bool = False
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    exact: bool = True
    #: The facts that a sketch tells, by dimension; a table that is a sample of another makes all of them sampled.
    sketched: dict[str, list[str]] = field(default_factory=dict)
    sampled: bool = False

    def provenance(self) -> dict[str, str]:
        """How each assessed dimension is known: exact, sketched (in part by sketches), or sampled."""
        return {d: "sampled" if self.sampled else "sketched" if self.sketched.get(d) else "exact" for d in DIMENSIONS if getattr(self, d) is not None}

    def dimension_scores(self) -> dict[str, float | None]:
        return {d: (x.score() if (x := getattr(self, d)) is not None else None) for d in DIMENSIONS}

    def score(self) -> float:
        return overall(self.dimension_scores(), self.weights)

    def as_dict(self) -> dict:
        out = {}
        for d in DIMENSIONS:
            x = getattr(self, d)
            if x is not None:
                extra = {p: getattr(x, p) for p in ("missing_ratio", "complete_ratio", "type_share", "key_uniqueness", "outlier_ratio", "stale_ratio") if hasattr(x, p)}
                out[d] = asdict(x) | extra | {"score": x.score()}
        return out | {"score": self.score(), "low_sample_warning": self.low_sample_warning, "weights": self.weights, "confidence": "exact" if self.exact else "approximate", "provenance": self.provenance(), "sketched_facts": {d: f for d, f in self.sketched.items() if getattr(self, d) is not None}}


def overall(scores: dict[str, float | None], weights: dict[str, float] | None = None) -> float:
    """The weighted mean of the assessed dimensions; 0 if there is none."""
    w = weights or WEIGHTS
    told = {d: s for d, s in scores.items() if s is not None}
    total = sum(w.get(d, 0) for d in told)
    return min(100.0, sum(w.get(d, 0) * s for d, s in told.items()) / total) if total else 0.0


# fixed values: rows that a kind of finding needs
LEAST_SAMPLES = {"outlier_detection": 30, "distribution_analysis": 100, "pattern_detection": 50, "general": 10}


def sample_suffices(rows: int, what: str = "general") -> bool:
    return rows >= LEAST_SAMPLES.get(what, 10)

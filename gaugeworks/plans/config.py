"""Settings from a TOML file and the environment."""

from __future__ import annotations

import os
import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from gaugeworks.errors import OptionError
from gaugeworks.functions.patterns import parse_locale
from gaugeworks.plans.profile import PACKS, Options
from gaugeworks.plans.quality import DIMENSIONS, PROFILES, WEIGHTS, Thresholds

NAMES = (".gaugeworks.toml", "gaugeworks.toml")
PREFIX = "GAUGEWORKS_"


@dataclass
class Config:
    packs: list[str] = field(default_factory=lambda: [*PACKS])
    dimensions: list[str] = field(default_factory=lambda: [*DIMENSIONS])
    profile: str = "default"
    locale: str | None = None
    exact: bool = True
    max_rows: int | None = None
    top: int = 10
    weights: dict[str, float] = field(default_factory=dict)

    def validate(self) -> Config:
        wrong = []
        wrong += [f"unknown pack {p!r}" for p in self.packs if p not in PACKS]
        wrong += [f"unknown dimension {d!r}" for d in [*self.dimensions, *self.weights] if d not in DIMENSIONS]
        wrong += [f"unknown threshold profile {self.profile!r}"] if self.profile not in PROFILES else []
        wrong += ["max_rows has to be positive"] if self.max_rows is not None and self.max_rows <= 0 else []
        wrong += ["top has to be positive"] if self.top <= 0 else []
        wrong += [f"weight of {d} is negative" for d, w in self.weights.items() if w < 0]
        if wrong:
            raise OptionError("; ".join(wrong))
        parse_locale(self.locale)
        return self

    def options(self) -> Options:
        base = PROFILES[self.profile]
        return Options(packs=tuple(self.packs), dimensions=tuple(self.dimensions), locale=self.locale, exact=self.exact, max_rows=self.max_rows, top=self.top, thresholds=Thresholds(**(asdict(base) | {"weights": WEIGHTS | self.weights})))

    def to_toml(self) -> str:
        def text(v: object) -> str:
            if isinstance(v, bool):
                return str(v).lower()
            if isinstance(v, list):
                return "[" + ", ".join(map(text, v)) + "]"
            return f'"{v}"' if isinstance(v, str) else str(v)

        flat = {k: v for k, v in asdict(self).items() if v is not None and not isinstance(v, dict)}
        lines = [f"{k} = {text(v)}" for k, v in flat.items()]
        return "\n".join([*lines, *(["", "[weights]", *[f"{k} = {v}" for k, v in self.weights.items()]] if self.weights else [])]) + "\n"

    def save(self, path: str | Path) -> None:
        Path(path).write_text(self.to_toml(), encoding="utf-8")


def load(path: str | Path | None = None, environment: dict[str, str] | None = None) -> Config:
    """The named file, or the first found from the working folder and the home's configuration; then the environment."""
    found = Path(path) if path else next((p for p in (*[Path.cwd() / n for n in NAMES], Path.home() / ".config/gaugeworks/config.toml") if p.exists()), None)
    settings = tomllib.loads(found.read_text(encoding="utf-8")) if found else {}
    known = {f.name: f.type for f in fields(Config)}
    if bad := set(settings) - set(known):
        raise OptionError(f"unknown settings: {', '.join(sorted(bad))}")
    for k, v in (os.environ if environment is None else environment).items():
        name = k.removeprefix(PREFIX).lower()
        if k.startswith(PREFIX) and name in known and name != "weights":
            kind = str(known[name])
            settings[name] = [x.strip() for x in v.split(",") if x.strip()] if kind.startswith("list") else v.lower() in ("1", "true", "yes") if kind == "bool" else int(v) if kind.startswith("int") else v
    return Config(**settings).validate()

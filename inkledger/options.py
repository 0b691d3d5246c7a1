"""Options of a translation run: explicit values first, then the environment, then these."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

PREFIX = "INKLEDGER_"


@dataclass(frozen=True)
class Options:
    source: str = "en"
    target: str = "zh"
    context_window: int = 2
    batch_size: int = 8
    refusals: int = 6
    skip_references: bool = True
    size_scale: float = 0.9
    leading: float = 1.6
    output: str = "replace"

    def __post_init__(self) -> None:
        if self.batch_size < 1:
            raise ValueError("batch_size must be at least 1")
        if self.output not in ("replace", "side-by-side", "alternating", "overlay"):
            raise ValueError(f"output {self.output!r}")

    @property
    def scale(self) -> float:
        """The size's scale, kept in its range."""
        return min(1.05, max(0.65, self.size_scale))

    @property
    def sizes(self) -> tuple[int, ...]:
        """Segments to a batch, by pass."""
        return tuple(dict.fromkeys((self.batch_size, min(2, self.batch_size), 1)))


#: Other names under which an option may be given.
ALIASES = {"from": "source", "source_lang": "source", "to": "target", "target_lang": "target"}


def resolve(given: dict | None = None, environment: dict | None = None) -> Options:
    """Numbers may be strings, blank values count as not given, unknown keys are passed over."""
    given = {ALIASES.get(k, k): v for k, v in (given or {}).items()}
    environment = os.environ if environment is None else environment
    out = {}
    for f in fields(Options):
        value = given.get(f.name)
        if value is None or (isinstance(value, str) and not value.strip()):
            value = environment.get(PREFIX + f.name.upper(), "").strip() or None
        if value is not None:
            kind = type(f.default)
            out[f.name] = str(value).strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(value)
    return Options(**out)

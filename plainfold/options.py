"""Options of a reflow, checked when the plan is made."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

MODES = ("sentence", "para", "wrap")
DIALECTS = ("gfm", "mkdocs")
MIN_WIDTH, DEFAULT_WRAP = 20, 80

#: Words ending in a full stop that end no sentence.
ABBREVIATIONS = tuple("a.m. al. approx. cf. co. corp. dept. dr. e.g. est. etc. fig. i.e. inc. jr. ltd. mr. mrs. ms. no. p.m. pp. prof. sr. st. u.s. vol. vs.".split())


@dataclass(frozen=True)
class Options:
    """mode: sentence, para or wrap. max_width: 0 for none (80 in wrap). segmenter: text -> [(start, end)] of breaks."""

    mode: str = "sentence"
    dialect: str = "gfm"
    max_width: int = 0
    abbreviations: tuple[str, ...] = field(default=ABBREVIATIONS)
    segmenter: Callable[[str], list[tuple[int, int]]] | None = None
    width_floor: bool = True  # tests of narrow widths turn it off
    settle: bool = True  # off: one pass, whatever a second would do
    render_check: bool = True  # off: take the result even if it renders differently

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode {self.mode!r}: it must be one of {', '.join(MODES)}")
        if self.dialect == "commonmark":
            raise ValueError("dialect 'commonmark' is reserved; gfm is its superset")
        if self.dialect not in DIALECTS:
            raise ValueError(f"dialect {self.dialect!r}: it must be one of {', '.join(DIALECTS)}")
        if self.max_width and self.mode == "para":
            raise ValueError("para mode has one line a paragraph and takes no width")
        if self.max_width and self.width_floor and self.max_width < MIN_WIDTH:
            raise ValueError(f"width {self.max_width}: the least is {MIN_WIDTH}")

    @property
    def width(self) -> int:
        return self.max_width or (DEFAULT_WRAP if self.mode == "wrap" else 0)


def merged(flags: dict, config: dict, force_defaults: dict | None = None) -> Options:
    """A flag that was given (even as 0) wins over the configuration, and that over the default."""
    known = {"mode", "dialect", "max_width", "abbreviations"}
    chosen = {k: v for k, v in {**(force_defaults or {}), **config, **flags}.items() if k in known and v is not None}
    if "abbreviations" in chosen:
        chosen["abbreviations"] = tuple({*ABBREVIATIONS, *(a.lower() for a in chosen["abbreviations"])})
    return Options(**chosen)

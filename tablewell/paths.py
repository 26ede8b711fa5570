"""Paths into JSON: `$` is the row's element, `$$` the whole document; steps are .key, ["key"] and [n]."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = re.compile(r"""\.([A-Za-z0-9_\-][A-Za-z0-9_\-\s]*|\*)|\[(\d+)\]|\["((?:[^"\\]|\\.)*)"\]|\['((?:[^'\\]|\\.)*)'\]|\[(\*)\]""")


@dataclass(frozen=True)
class Path:
    whole: bool
    """Whether it starts at the whole document."""
    steps: tuple[str | int, ...]

    def read(self, element: Column, document: Column) -> Column:
        """The value as a variant; NULL where a step is missing or doesn't fit."""
        value = document if self.whole else element
        for step in self.steps:
            if isinstance(step, int):
                value = F.try_variant_get(value, f"$[{step}]", "variant")
            else:
                quote = "'" if '"' in step else '"'
                value = F.try_variant_get(value, f"$[{quote}{step}{quote}]", "variant")
        return value


def parse(text: str) -> Path:
    """ValueError if the text is no path."""
    if not text.startswith("$"):
        raise ValueError(f"path {text[:60]!r} must begin with $")
    whole = text.startswith("$$")
    at, steps = 2 if whole else 1, []
    while at < len(text):
        m = _STEP.match(text, at)
        if not m or "*" in (m[1], m[5]):
            raise ValueError(f"path {text[:60]!r} can't be read at {at}")
        key, index, double, single = m[1], m[2], m[3], m[4]
        quoted = double if double is not None else single
        if index is not None:
            steps.append(int(index))
        elif quoted is not None:
            plain = re.sub(r"\\(.)", r"\1", quoted)
            if '"' in plain and "'" in plain:
                raise ValueError(f"key {plain[:60]!r} holds both kinds of quotes")
            steps.append(plain)
        else:
            steps.append(key)
        at = m.end()
    return Path(whole, tuple(steps))


def parse_rows(text: str | None) -> Path | None:
    """The path of the rows of a document: it must end in [*]; None: the document is the only row."""
    if text is None:
        return None
    if not text.endswith("[*]"):
        raise ValueError(f"rows path {text[:60]!r} must end in [*]")
    path = parse(text[:-3])
    if path.whole:
        raise ValueError("a rows path begins with a single $")
    return path

"""Identifiers and reserved names."""

from __future__ import annotations

import re

ROW_ID, INGESTED_AT, BATCH, RAW, SEQ, PLACE = "_row_id", "_ingested_at", "_batch", "_raw", "_seq", "_place"
SYSTEM = (ROW_ID, INGESTED_AT, BATCH)
VECTOR_SUFFIX = "_vec"
RESERVED_TABLE_PREFIX = "well_"
_SHAPE = re.compile(r"[a-z_][a-z0-9_]{0,62}")


def identifier(name: str, what: str = "column") -> str:
    """The name in lower case; ValueError if it can't be one."""
    own = name.strip().lower()
    if not _SHAPE.fullmatch(own):
        raise ValueError(f"{what} name {name[:60]!r} must be 1 to 63 letters, digits or underscores and not begin with a digit")
    if own.startswith("_"):
        raise ValueError(f"{what} name {name!r} is reserved: it begins with an underscore")
    return own


def table_name(name: str, system: bool = False) -> str:
    own = identifier(name, "table")
    if own.startswith(RESERVED_TABLE_PREFIX) and not system:
        raise ValueError(f"table name {name!r} is reserved for system tables")
    return own


def from_heading(heading: str, position: int, taken: set[str]) -> str:
    """A column name from a heading of a delimited file; `taken` gets it too."""
    own = re.sub(r"[^a-z0-9_]+", "_", heading.strip().lower()).strip("_") or f"column_{position}"
    own = (f"c_{own}" if own[0].isdigit() else own)[:60]
    name, k = own, 2
    while name in taken:
        name, k = f"{own}_{k}", k + 1
    taken.add(name)
    return name

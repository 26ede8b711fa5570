"""A block: the part of a document that chunking keeps together."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Block:
    text: str
    headings: list[str] = field(default_factory=list)
    page: int | None = None
    hard: bool = False
    kind: str = "text"

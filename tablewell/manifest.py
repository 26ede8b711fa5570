"""What a table is: columns, key, generations and pending batches, kept as numbered JSON documents."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from . import names
from .functions.snowball import stemmer
from .types import spark_type


class Conflict(ValueError):
    """A write that doesn't agree with what the table is."""


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    embedded: bool = False
    required: bool = False

    def checked(self) -> ColumnSpec:
        spark_type(self.type)
        if self.embedded and self.type != "VARCHAR":
            raise ValueError(f"column {self.name} can't be embedded: only VARCHAR columns can")
        return replace(self, name=names.identifier(self.name))


@dataclass(frozen=True)
class FullText:
    """Settings of full-text search; None in `patched` leaves a field as it is."""

    enabled: bool = False
    stemmer: str = "porter"
    stopwords: str = "english"
    ignore: str = r"(\.|[^a-z])+"
    strip_accents: bool = True
    lowercase: bool = True
    columns: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        stemmer(self.stemmer)
        if self.stopwords not in ("english", "none"):
            raise ValueError(f"no stop words are named {self.stopwords!r}; there are english, none")

    def patched(self, **changes: object) -> FullText:
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


@dataclass(frozen=True)
class Part:
    """An immutable folder of folded rows, of their vectors if they have some, and of their terms if they are searched."""

    name: str
    rows: int
    vectors: bool = False
    index: str = ""
    """How the terms were made."""


@dataclass(frozen=True)
class Manifest:
    name: str
    columns: tuple[ColumnSpec, ...]
    key: tuple[str, ...] = ()
    raw: bool = False
    generation: int = 0
    parts: tuple[Part, ...] = ()
    """The generation, largest parts first."""
    next_seq: int = 1
    batches: tuple[tuple[str, int], ...] = ()
    """Folders of rows that aren't in a generation yet, oldest first, each with the seq of its first place."""
    pending_rows: int = 0
    tombstones: tuple[str, ...] = ()
    vectors: tuple[str, ...] = ()
    past: tuple[tuple[int, float, tuple[str, ...]], ...] = ()
    """Replaced generations, when they were replaced, and their parts."""
    drained: tuple[tuple[str, float], ...] = ()
    """Folders that were folded into a generation, and when; views that were made before still read them."""
    sources: tuple[tuple[str, int], ...] = ()
    """Streaming sources and the last micro-batch of each that was appended."""
    due_at: float | None = None
    dims: int = 0
    model: str = ""
    full_text: FullText = field(default_factory=FullText)

    @property
    def base_rows(self) -> int:
        return sum(p.rows for p in self.parts)

    @staticmethod
    def new(name: str, columns: list[ColumnSpec], key: list[str] | None = None, raw: bool = False, system: bool = False) -> Manifest:
        own = tuple(c.checked() for c in columns)
        if not own:
            raise ValueError("a table needs a column")
        if len({c.name for c in own}) < len(own):
            raise ValueError("two columns have the same name")
        wanted = tuple(names.identifier(k) for k in key or ())
        if set(wanted) - {c.name for c in own}:
            raise ValueError(f"key {', '.join(wanted)} names columns that the write doesn't fill")
        return Manifest(names.table_name(name, system), own, wanted, raw)

    @property
    def rows(self) -> int:
        """Rows of the base and those pending; tombstones count only once they are folded in."""
        return self.base_rows + self.pending_rows

    def embedded(self) -> list[str]:
        return [c.name for c in self.columns if c.embedded]

    def evolved(self, columns: list[ColumnSpec], key: list[str] | None = None) -> tuple[Manifest, list[str]]:
        """The table after a write with these columns, and the names of those that are new.

        New columns come last and are optional; a changed type or key is a conflict; embedding can be turned on later.
        """
        known = {c.name: c for c in self.columns}
        added: list[str] = []
        for c in (c.checked() for c in columns):
            if c.name not in known:
                known[c.name] = replace(c, required=False)
                added.append(c.name)
            elif known[c.name].type != c.type:
                raise Conflict(f"column {c.name} is {known[c.name].type}, not {c.type}")
            elif c.embedded and not known[c.name].embedded:
                known[c.name] = replace(known[c.name], embedded=True)
        wanted = tuple(names.identifier(k) for k in key or ())
        if wanted and wanted != self.key and self.rows:
            raise Conflict("the key can't change once the table has rows")
        return replace(self, columns=tuple(known.values()), key=wanted or self.key), added

    def dumps(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @staticmethod
    def loads(text: str) -> Manifest:
        d = json.loads(text)
        d["columns"] = tuple(ColumnSpec(**c) for c in d["columns"])
        d["parts"] = tuple(Part(**p) for p in d["parts"])
        d["full_text"] = FullText(**{**d["full_text"], "columns": tuple(d["full_text"]["columns"])})
        d["past"] = tuple((g, t, tuple(names)) for g, t, names in d["past"])
        for pairs in ("batches", "drained", "sources"):
            d[pairs] = tuple((a, b) for a, b in d[pairs])
        return Manifest(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()})

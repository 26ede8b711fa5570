"""Stores: named sets of tables in a folder, each an append-only delta over numbered generations of Parquet folders.

Every folder of rows, tombstones or vectors is written once by a Spark job and never changed. Which of them count is said by
the latest version of the table's manifest; versions are numbered, and putting the next number is the only lock.
"""

from __future__ import annotations

import functools
import operator
import random
import re
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Folder
from .functions import search, vectors
from .manifest import ColumnSpec, Conflict, FullText, Manifest, Part
from .names import BATCH, INGESTED_AT, PLACE, ROW_ID, SEQ, VECTOR_SUFFIX
from .operators import two_tier
from .operators.mapping import Field, rows_of

DELETE_CAP = 50_000
ROLL_UP_SECONDS, ROLL_UP_ROWS = 300, 1000
GRACE_SECONDS = 3600
VERSIONS = "versions"
ATTEMPTS, KEPT_VERSIONS = 50, 20
_UNITS = {"m": 60, "h": 3600, "d": 86400, "w": 604800}


def retention_seconds(text: str) -> int:
    """Seconds of a retention like 90m, 12h, 30d or 4w; from a minute to 520 weeks."""
    m = re.fullmatch(r"(\d+)([mhdw])", text.strip())
    seconds = int(m[1]) * _UNITS[m[2]] if m else 0
    if not 60 <= seconds <= 520 * _UNITS["w"]:
        raise ValueError(f"{text[:20]!r} is no retention between 1m and 520w")
    return seconds


class Gone(LookupError):
    """A generation that was removed."""


class Store:
    """Tables under `root`; `now` gives the time in seconds."""

    def __init__(self, spark: SparkSession, root: str, now: Callable[[], float] = time.time, notify: Callable[[dict], None] | None = None) -> None:
        self.spark, self.root, self.now = spark, root.rstrip("/"), now
        self.folder = Folder(spark, self.root)
        self.notify = notify or (lambda event: None)

    # manifests

    def tables(self) -> list[str]:
        return [n for n in self.folder.list() if self._versions(n)]

    def _versions(self, table: str) -> list[str]:
        return [v for v in self.folder.list(f"{table}/{VERSIONS}") if v.endswith(".json") and not v.startswith(".")]

    def _latest(self, table: str) -> tuple[int, Manifest]:
        for _ in range(ATTEMPTS):
            versions = self._versions(table)
            if not versions:
                break
            try:
                return int(versions[-1].partition(".")[0]), Manifest.loads(self.folder.read(f"{table}/{VERSIONS}/{versions[-1]}"))
            except Exception:
                if self.folder.exists(f"{table}/{VERSIONS}/{versions[-1]}"):
                    raise  # it wasn't just reaped
        raise LookupError(f"there is no table {table}")

    def manifest(self, table: str) -> Manifest:
        return self._latest(table)[1]

    def _commit(self, table: str, change: Callable[[Manifest], Manifest]) -> tuple[Manifest, Manifest]:
        """The manifest before and after `change`, which is put as the next version.

        Versions are never replaced. If another writer puts that number first, `change` is applied to what that one left.
        """
        for k in range(ATTEMPTS):
            number, before = self._latest(table)
            after = change(before)
            if after == before:
                return before, after
            try:
                self.folder.write_new(f"{table}/{VERSIONS}/{number + 1:012d}.json", after.dumps())
                return before, after
            except FileExistsError:
                time.sleep(random.random() * min(1.0, 0.01 * 2**k))
        raise Conflict(f"table {table} changed again and again")

    def declare(self, manifest: Manifest) -> Manifest:
        """Create the table; whoever comes second gets the first one's."""
        try:
            if not self._versions(manifest.name):
                self.folder.write_new(f"{manifest.name}/{VERSIONS}/{1:012d}.json", manifest.dumps())
                return manifest
        except FileExistsError:
            pass
        return self.manifest(manifest.name)

    # writes

    def add(self, table: str, documents: DataFrame, fields: list[Field], rows: str | None = None, key: list[str] | None = None, raw: bool = False, column: str = "json", source: tuple[str, int] | None = None) -> dict:
        """Map JSON documents to rows and append them; what was written, and which columns are new."""
        mapped = rows_of(documents.select(column), column, fields, rows, raw)
        return self.add_rows(table, mapped, [f.spec for f in fields], key, raw, source=source)

    def add_rows(self, table: str, rows: DataFrame, columns: list[ColumnSpec], key: list[str] | None = None, raw: bool = False, system: bool = False, source: tuple[str, int] | None = None) -> dict:
        """Append rows that are typed already; the table is declared or widened as needed.

        The batch is written to a folder of its own, which counts once a version of the manifest names it; writers don't
        wait for each other. With `source` (a name and a rising number) a repeated batch is left out.
        """
        declared = Manifest.new(table, columns, key, raw, system)
        manifest = self.declare(declared)
        manifest.evolved(columns, key)
        batch = uuid.uuid4().hex
        out = {"table": table, "batch": batch, "rows": 0, "added_columns": [], "generation": manifest.generation}
        if source and dict(manifest.sources).get(source[0], -1) >= source[1]:
            return out
        at = f"{self.root}/{table}/pending/{batch}"
        place = F.monotonically_increasing_id()
        stamped = rows.withColumns(
            {
                ROW_ID: F.concat(F.lit(f"{batch}-"), place.cast("string")),
                INGESTED_AT: F.lit(self.now()).cast("timestamp").cast("timestamp_ntz"),
                BATCH: F.lit(batch),
                PLACE: place,
            }
        )
        stamped.write.parquet(at)
        n, last = self.spark.read.parquet(at).agg(F.count("*"), F.max(PLACE)).first()
        added: list[str] = []

        def change(m: Manifest) -> Manifest:
            nonlocal added
            if source and dict(m.sources).get(source[0], -1) >= source[1]:
                return m
            m, added = m.evolved(columns, key)
            if source:
                m = replace(m, sources=tuple({**dict(m.sources), source[0]: source[1]}.items()))
            if not n:
                return m
            due = m.due_at if m.due_at is not None else self.now() + ROLL_UP_SECONDS
            due = self.now() if m.pending_rows + n >= ROLL_UP_ROWS else due
            return replace(m, batches=(*m.batches, (batch, m.next_seq)), pending_rows=m.pending_rows + n, next_seq=m.next_seq + last + 1, due_at=due)

        try:
            before, after = self._commit(table, change)
        except Exception:
            self.folder.remove(f"{table}/pending/{batch}")
            raise
        if source and before == after:
            self.folder.remove(f"{table}/pending/{batch}")
            return out
        self.notify({"event": "operations.appended", "table": table, "rows": n, "tombstones": 0, "seq": after.next_seq - 1 if n else None, "at": self.now()})
        return out | {"rows": n, "added_columns": added, "generation": after.generation}

    def forget(self, table: str, ids: DataFrame) -> int:
        """Hide rows from now on; they leave at the next roll-up."""
        self.manifest(table)
        name = uuid.uuid4().hex
        at = f"{self.root}/{table}/tombstones/{name}"
        ids.select(ROW_ID).distinct().withColumn("at", F.lit(self.now())).write.parquet(at)
        n = self.spark.read.parquet(at).count()
        if n:
            due = lambda m: self.now() if n >= ROLL_UP_ROWS else m.due_at if m.due_at is not None else self.now() + ROLL_UP_SECONDS
            _, after = self._commit(table, lambda m: replace(m, tombstones=(*m.tombstones, name), due_at=due(m)))
            self.notify({"event": "operations.appended", "table": table, "rows": 0, "tombstones": n, "seq": after.next_seq - 1, "at": self.now()})
        return n

    def delete(self, table: str, predicate: str, cap: int = DELETE_CAP) -> dict:
        """Forget the rows for which a predicate holds, at most `cap` of them."""
        from .gate import check_predicate

        check_predicate(self.spark, predicate)
        ids = self.view(table).where(F.expr(predicate)).select(ROW_ID)
        truncated = ids.limit(cap + 1).count() > cap
        return {"deleted": self.forget(table, ids.orderBy(ROW_ID).limit(cap) if truncated else ids), "truncated": truncated}

    def put_vectors(self, table: str, made: DataFrame, model: str, dims: int) -> str:
        """Append vectors (_row_id, column, vector), and name their folder; a table keeps the embedding space of its first ones."""
        def change(m: Manifest) -> Manifest:
            if m.dims and (m.model, m.dims) != (model, dims):
                raise Conflict(f"table {table} holds vectors of {m.model} ({m.dims}), not {model} ({dims})")
            return replace(m, vectors=(*m.vectors, name), model=model, dims=dims)

        name = uuid.uuid4().hex
        change(self.manifest(table))
        made.select(ROW_ID, "column", F.col("vector").cast("array<float>").alias("vector"), F.lit(self.now()).alias("at")).write.parquet(f"{self.root}/{table}/vectors/{name}")
        self._commit(table, change)
        return name

    def configure(self, table: str, full_text: FullText) -> None:
        """Set how a table is searched by keywords."""
        self._commit(table, lambda m: replace(m, full_text=full_text))

    def embed(self, table: str, model: str = "hash-bow-v1") -> int:
        """Give every non-blank text of an embedded column that has no vector yet one, by the offline embedder."""
        manifest = self.manifest(table)
        if not manifest.embedded():
            return 0
        rows = self.view(table, vectors=bool(manifest.dims))
        columns = manifest.embedded()
        have = [c for c in columns if c + VECTOR_SUFFIX in rows.columns]
        known = two_tier.unpivoted(rows, have) if have else self.spark.createDataFrame([], f"{ROW_ID} string, column string")
        queue = vectors.missing_vectors(rows, known, ROW_ID, columns).select(ROW_ID, "column", vectors.hash_embedding("text").alias("vector"))
        fresh = self.put_vectors(table, queue, model, vectors.DIMS)
        return self.spark.read.parquet(f"{self.root}/{table}/vectors/{fresh}").count()

    # reads

    def snapshot(self, table: str) -> dict:
        """What a reader needs to build the table elsewhere (see `operators.two_tier.view`), all of one version."""
        m = self.manifest(table)
        return {"manifest": m, "base": self._base(m), "fresh": self._pending(m), "tombstones": self._read(table, "tombstones", m.tombstones)}

    def _read(self, table: str, kind: str, names: Iterable[str], below: str = "") -> DataFrame | None:
        paths = [f"{self.root}/{table}/{kind}/{n}{below}" for n in names]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None

    def _base(self, m: Manifest) -> DataFrame | None:
        return self._read(m.name, "parts", [p.name for p in m.parts if p.rows], "/rows")

    def _pending(self, m: Manifest) -> DataFrame | None:
        """Rows that aren't in a generation yet; their seq is that of the batch and their place in it."""
        rows = self._read(m.name, "pending", [b for b, _ in m.batches])
        if rows is None:
            return None
        firsts = F.create_map(*(F.lit(x) for b in m.batches for x in b))
        return rows.withColumn(SEQ, F.col(PLACE) + firsts[F.col(BATCH)]).drop(PLACE)

    def pending(self, table: str, upto: int | None = None) -> DataFrame | None:
        """Rows that aren't in a generation yet."""
        rows = self._pending(self.manifest(table))
        return rows if rows is None or upto is None else rows.where(F.col(SEQ) <= upto)

    def tombstones(self, table: str) -> DataFrame | None:
        return self._read(table, "tombstones", self.manifest(table).tombstones)

    def generation(self, table: str, number: int) -> DataFrame:
        """A whole generation, also a replaced one within its grace."""
        m = self.manifest(table)
        if not 1 <= number <= m.generation:
            raise LookupError(f"table {table} has no generation {number}")
        parts = {m.generation: [p.name for p in m.parts if p.rows], **{g: list(names) for g, _, names in m.past}}.get(number)
        if parts is None:
            raise Gone(f"generation {number} of table {table} is gone")
        return self._read(table, "parts", parts, "/rows") if parts else self._nothing(m)

    def _nothing(self, m: Manifest) -> DataFrame:
        return self.spark.createDataFrame([], ", ".join(f"`{n}` {k}" for n, k in two_tier.declared(m)))

    def view(self, table: str, vectors: bool = False, upto: int | None = None, manifest: Manifest | None = None) -> DataFrame:
        """The table as it is now, lazily; vectors are attached only where they are asked for."""
        m = manifest or self.manifest(table)
        base, fresh = self._base(m), self._pending(m)
        if fresh is not None and upto is not None:
            fresh = fresh.where(F.col(SEQ) <= upto)
        if base is None and fresh is None:
            base = self._nothing(m)
        attached = None
        if vectors and m.embedded() and m.dims:
            own = self._read(table, "vectors", m.vectors)
            if own is not None:
                own = own.groupBy(ROW_ID, "column").agg(F.max_by("vector", "at").alias("vector"))
            stored = self._read(table, "parts", [p.name for p in m.parts if p.vectors], "/vectors")
            attached = two_tier.preferred_vectors(own, None if stored is None else two_tier.unpivoted(stored, [c.removesuffix(VECTOR_SUFFIX) for c in stored.columns if c != ROW_ID]), m.embedded(), m.dims)
        return two_tier.view(m, base, fresh, self._read(table, "tombstones", m.tombstones), attached)

    def info(self) -> list[dict]:
        return [{"table": m.name, "rows": m.rows, "generation": m.generation, "columns": [c.name for c in m.columns]} for m in map(self.manifest, self.tables())]

    def pending(self, table: str, after: int = 0, limit: int = 1000) -> DataFrame | None:
        """The first `limit` pending rows whose seq is over `after`, in its order; None if nothing is pending."""
        rows = self._pending(self.manifest(table))
        return None if rows is None else rows.where(F.col(SEQ) > after).orderBy(SEQ).limit(limit)

    def changes(self, table: str, after: int = 0, limit: int = 1000) -> dict:
        """A page of pending rows by seq, and all tombstones, at one generation."""
        m = self.manifest(table)
        limit = max(1, min(limit, 10_000))
        rows = self._pending(m)
        page = rows.where(F.col(SEQ) > after).orderBy(SEQ).limit(limit + 1).collect() if rows is not None else []
        return {"generation": m.generation, "rows": page[:limit], "next": page[limit - 1][SEQ] if len(page) > limit else None, "tombstones": self._read(table, "tombstones", m.tombstones)}

    # compaction

    def due(self, table: str) -> bool:
        m = self.manifest(table)
        return m.due_at is not None and m.due_at <= self.now()

    def _touched(self, m: Manifest) -> set[str]:
        """Parts that hold a row which a tombstone, or a vector which isn't folded yet, names; only row ids are read."""
        named = [self._read(m.name, kind, names) for kind, names in (("tombstones", m.tombstones), ("vectors", m.vectors)) if names]
        if not named or not m.parts:
            return set()
        ids = functools.reduce(DataFrame.unionByName, (x.select(ROW_ID) for x in named)).distinct()
        each = [self._read(m.name, "parts", [p.name], "/rows").select(ROW_ID, F.lit(p.name).alias("part")) for p in m.parts if p.rows]
        if not each:
            return set()
        return {r.part for r in functools.reduce(DataFrame.unionByName, each).join(ids, ROW_ID, "left_semi").select("part").distinct().collect()}

    def roll_up(self, table: str) -> bool:
        """Fold what is pending now into the next generation; False, and nothing changes, if nothing is pending.

        Rows that are pending become a new part. Rewritten with them are the parts that tombstones or new vectors touch,
        and, from the smallest on, those under twice its size, so that a row is rewritten a logarithmic number of times.
        Exactly the batches, tombstones and vectors that were read leave the pending set; others that come meanwhile stay,
        whatever their seq. Of two roll-ups at once the one that commits first counts.
        """
        before = self.manifest(table)
        if not before.batches and not before.tombstones:
            return False
        touched = self._touched(before)
        size = before.pending_rows + sum(p.rows for p in before.parts if p.name in touched)
        kept = [p for p in before.parts if p.name not in touched]
        while kept and kept[-1].rows < 2 * size:
            size += kept.pop().rows
        names_kept = {p.name for p in kept}
        name = uuid.uuid4().hex
        at = f"{self.root}/{table}/parts/{name}"
        folded = self.view(table, vectors=True, manifest=replace(before, parts=tuple(p for p in before.parts if p.name not in names_kept)))
        carried = [c for c in folded.columns if c.endswith(VECTOR_SUFFIX) and c.removesuffix(VECTOR_SUFFIX) in before.embedded()]
        some = functools.reduce(operator.or_, (F.col(v).isNotNull() for v in carried)) if carried else None

        def change(m: Manifest) -> Manifest:
            if m.generation != before.generation:
                raise Conflict(f"table {table} was compacted meanwhile")
            left, now = tuple(b for b in m.batches if b not in before.batches), self.now()
            spent = [(f"{kind}/{n}", now) for kind, names in (("pending", [b for b, _ in before.batches]), ("tombstones", before.tombstones), ("vectors", before.vectors)) for n in names]
            return replace(
                m, generation=m.generation + 1, parts=tuple(sorted((*kept, Part(name, n, vectors, mark)), key=lambda p: -p.rows)), batches=left, pending_rows=m.pending_rows - before.pending_rows,
                tombstones=tuple(t for t in m.tombstones if t not in before.tombstones), vectors=tuple(v for v in m.vectors if v not in before.vectors),
                past=(*m.past, (m.generation, now, tuple(p.name for p in m.parts))) if m.generation else m.past,
                due_at=now + ROLL_UP_SECONDS if left else None, drained=(*m.drained, *spent),
            )

        try:
            folded.drop(*carried).write.option("compression", "zstd").parquet(f"{at}/rows")
            n = self.spark.read.parquet(f"{at}/rows").count()
            vectors = some is not None
            if vectors:
                folded.where(some).select(ROW_ID, *carried).write.option("compression", "zstd").parquet(f"{at}/vectors")
            mark = self._write_terms(before.full_text, at) if before.full_text.enabled and n else ""
            _, after = self._commit(table, change)
        except Exception:
            self.folder.remove(f"{table}/parts/{name}")
            raise
        self.notify({"event": "table.rolled_up", "table": table, "rows": after.base_rows, "tombstones": 0, "seq": before.next_seq - 1, "previous_generation": before.generation, "at": self.now()})
        return True

    def _write_terms(self, settings: FullText, at: str) -> str:
        """The terms of a part's rows, in ranges of terms so that a query reads few files, and the lengths of the rows."""
        rows = self.spark.read.parquet(f"{at}/rows")
        columns = search.searched(rows, settings)
        if not columns:
            return ""
        search.index(rows, ROW_ID, columns, settings).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{at}/terms")
        search.lengths(rows, ROW_ID, columns, settings).write.parquet(f"{at}/lengths")
        return search.index_mark(settings, columns)

    def keyword_index(self, table: str) -> tuple[DataFrame, DataFrame]:
        """The terms and the lengths of all rows as they are now: those stored with the parts, less forgotten rows, and those
        of rows that have none yet."""
        m = self.manifest(table)
        columns = search.searched(self.view(table, manifest=m), m.full_text)
        mark = search.index_mark(m.full_text, columns)
        ready = [p for p in m.parts if p.rows and p.index == mark]
        rest = self.view(table, manifest=replace(m, parts=tuple(p for p in m.parts if p not in ready)))
        own = search.index(rest, ROW_ID, columns, m.full_text), search.lengths(rest, ROW_ID, columns, m.full_text)
        if not ready:
            return own
        gone = self._read(table, "tombstones", m.tombstones)
        stored = (two_tier.without(self._read(table, "parts", [p.name for p in ready], f"/{kind}"), gone) for kind in ("terms", "lengths"))
        return tuple(a.unionByName(b) for a, b in zip(stored, own, strict=True))  # type: ignore[return-value]

    def roll_up_due(self) -> list[str]:
        return [t for t in self.tables() if self.due(t) and self.roll_up(t)]

    def reap(self, grace: float = GRACE_SECONDS, most: int = 100) -> int:
        """Remove replaced generations, folders that were folded and old versions of the manifest, whose grace is over; the
        number of generations. The manifest stops naming a folder before the folder goes."""
        removed = 0
        for table in self.tables():
            late = lambda at: at + grace < self.now()
            m = self.manifest(table)
            over = {g for g, at, _ in m.past if late(at)} & {g for g, _, _ in m.past[: most - removed]}
            done = {n for n, at in m.drained if late(at)}
            if not over and not done:
                continue
            before, after = self._commit(table, lambda m: replace(m, past=tuple(x for x in m.past if x[0] not in over), drained=tuple(x for x in m.drained if x[0] not in done)))  # noqa: B023
            used = {p.name for p in after.parts} | {n for _, _, names in after.past for n in names}
            for n in sorted({n for _, _, names in before.past for n in names} - used):
                self.folder.remove(f"{table}/parts/{n}")
            for n in done:
                self.folder.remove(f"{table}/{n}")
            for v in self._versions(table)[:-KEPT_VERSIONS]:
                self.folder.remove(f"{table}/{VERSIONS}/{v}")
            removed += len(over)
        return removed

    # whole stores

    def clone(self, root: str) -> Store:
        """A copy of every table with its pending rows, tombstones and vectors; an existing one is returned as it is."""
        other = Store(self.spark, root, self.now)
        if not other.tables():
            for table in self.tables():
                m = replace(self.manifest(table), past=(), drained=())
                named = [("parts", p.name) for p in m.parts] + [("pending", b) for b, _ in m.batches] + [("tombstones", t) for t in m.tombstones] + [("vectors", v) for v in m.vectors]
                for kind, name in named:
                    self.folder.copy(f"{table}/{kind}/{name}", f"{other.root}/{table}/{kind}/{name}")
                other.declare(m)
        return other

    def drop(self, table: str) -> None:
        self.manifest(table)
        self.folder.remove(table)
        self.notify({"event": "table.dropped", "table": table, "rows": 0, "tombstones": 0, "seq": None, "at": self.now()})

    def expire(self, retain: str, created_at: float) -> bool:
        """Delete the store if its retention is over."""
        if created_at + retention_seconds(retain) > self.now():
            return False
        self.folder.remove()
        return True

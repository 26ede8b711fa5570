"""Chat formatting (operator 12): conversations with typed content parts become training text with a loss mask.

A message's content is a list of typed parts: text, image, audio or document. A visitor takes the parts in order. Text is
escaped and written out; of each other part a placeholder is written, numbered within the message, and a reference is
recorded with the number of tokens that the placeholder will expand to (image patches, audio frames, tokens of pages).
A template marks where turns begin and end. Control strings, the template's own and those of other chat formats, are
escaped wherever they stand in a role, text or reference: a backslash goes after the first character, and one more where
backslashes are already, so every text comes back as it was and none can end its turn or open another's.

Messages are formatted where they lie. They are then sorted by conversation and turn over all tasks and joined to segments
of at most `SEGMENT` characters or one message, so a conversation of any length is never held whole; nearly every
conversation is one segment. `read_back` gives the messages of such segments, `digests` hashes them in order.

Defined results: null content or text is empty; null parts are left out; neighbouring texts are one part; a part of another kind is a ValueError; null role is
the empty role; of messages with one turn, role and content order the rows, repeated rows count each; null turns come first;
null conv_id is one conversation; an empty table gives an empty result. Other columns aren't read. Only text parts have
characters under the loss mask, and only those of the roles in `TRAINED`.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, shuffle_width, slices

SEGMENT = 1 << 20
TRAINED = ("assistant",)

# Strings that chat formats give a meaning to; `<|` begins many of them.
CONTROL = ("<s>", "</s>", "<pad>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "<start_of_turn>", "<end_of_turn>")
_TAILS = "|".join(sorted({re.escape(c[1:]) for c in CONTROL}))
_ESCAPE = re.compile(rf"([<\[])(?=\\*(?:{_TAILS}))")
_UNESCAPE = re.compile(rf"([<\[])\\(?=\\*(?:{_TAILS}))")


@dataclass(frozen=True)
class Template:
    """The marks of a turn: open, role, middle, content, close. All begin with a control string, so no text holds one."""

    open: str = "<|turn|>"
    middle: str = "<|says|>"
    close: str = "<|end|>\n"


TEMPLATE = Template()
PART = "struct<type: string, text: string, ref: string, width: bigint, height: bigint, seconds: double, pages: bigint>"
SEGMENTS = "conv_id long, segment long, text string, loss array<struct<start: int, end: int>>, attachments array<struct<turn: int, number: int, type: string, ref: string, tokens: bigint>>"
PATCH, FRAMES_PER_SECOND, PAGE_TOKENS = 28, 25, 800


def escaped(text: str) -> str:
    return _ESCAPE.sub(r"\1\\", text)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class Flattener:
    """Visits the parts of one message: `visit_<type>` returns what is written."""

    def __init__(self) -> None:
        self.attachments: list[dict] = []
        self.spans: list[tuple[int, int]] = []
        """Start and end of each text part in what is written."""

    def flatten(self, parts: list[dict | None]) -> str:
        out, at = [], 0
        for part in self.joined(parts):
            visit: Callable[[dict], str] | None = getattr(self, f"visit_{part['type']}", None)
            if visit is None:
                raise ValueError(f"no part is of type {part['type']!r}")
            written = visit(part)
            if part["type"] == "text":
                self.spans.append((at, at + len(written)))
            out.append(written)
            at += len(written)
        return "".join(out)

    @staticmethod
    def joined(parts: list[dict | None]) -> Iterator[dict]:
        """The parts that aren't null; neighbouring texts become one, because a control string may begin in one and end in the next."""
        for text, some in itertools.groupby((p for p in parts if p is not None), lambda p: p["type"] == "text"):
            if text:
                yield {"type": "text", "text": "".join(p["text"] or "" for p in some)}
            else:
                yield from some

    def visit_text(self, part: dict) -> str:
        return escaped(part["text"] or "")

    def visit_image(self, part: dict) -> str:
        sides = ((part[side] or PATCH) for side in ("width", "height"))
        rows, columns = (-(-max(1, side) // PATCH) for side in sides)
        return self._attached(part, rows * columns)

    def visit_audio(self, part: dict) -> str:
        return self._attached(part, max(1, int(-(-(part["seconds"] or 0.0) * FRAMES_PER_SECOND // 1))))

    def visit_document(self, part: dict) -> str:
        return self._attached(part, PAGE_TOKENS * max(1, part["pages"] or 1))

    def _attached(self, part: dict, tokens: int) -> str:
        number = len(self.attachments) + 1
        self.attachments.append({"number": number, "type": part["type"], "ref": part["ref"] or "", "tokens": tokens})
        return f"<|{part['type']}:{number}|>"


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str, Flattener]]:
    """(conv_id, escaped role, body, visitor) of each message (conv_id, turn, role, content)."""
    for batch in slices(batches, 4 << 20):
        for conv, role, parts in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
            visitor = Flattener()
            yield conv, escaped(role or ""), visitor.flatten(parts or []), visitor


def parts_of(text: Column | str) -> Column:
    """A plain text as a list of one part."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))


def _complete(content: Column, given: str) -> Column:
    """Parts of which only some fields are given."""
    fields = re.findall(r"(\w+): (\w+)", PART)
    return F.transform(content, lambda p: F.when(p.isNotNull(), F.struct(*((p[n] if re.search(rf"\b{n}:", given) else F.lit(None)).cast(k).alias(n) for n, k in fields))))


def formatted(messages: DataFrame, content: str = "content", template: Template = TEMPLATE, trained: tuple[str, ...] = TRAINED, most: int = SEGMENT) -> DataFrame:
    """Conversations as text: (conv_id, segment, text, loss, attachments).

    A conversation's text is that of its segments in order. `loss` are the places in a segment's text to learn from, end
    exclusive; `turn` of an attachment counts the segment's messages from 0.
    """
    order = ["conv_id", "turn", "role", "content"]
    long = lambda c: F.col(c).cast("long").alias(c)
    rows = messages.select(long("conv_id"), long("turn"), "role", _complete(F.col(content), dict(messages.dtypes)[content]).alias("content"))
    rows = rows.repartitionByRange(shuffle_width(messages.sparkSession), *order).sortWithinPartitions(*order)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text: list[str] = []
        loss: list[dict] = []
        attached: list[dict] = []
        now, at, turns, made = None, 0, 0, 0

        def segment() -> pa.RecordBatch:
            kinds = [pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.struct([("turn", pa.int32()), ("number", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))]
            arrays = [pa.array([now], pa.int64()), pa.array([made], pa.int64()), pa.array(["".join(text)], pa.string()), pa.array([loss], kinds[0]), pa.array([attached], kinds[1])]
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "segment", "text", "loss", "attachments"])

        for conv, role, body, visitor in _messages(batches):
            before = template.open + role + template.middle
            if turns and (conv != now or at + len(before) + len(body) + len(template.close) > most):
                yield segment()
                made += 1
                text, loss, attached, at, turns = [], [], [], 0, 0
            now = conv
            start = at + len(before)
            if unescaped(role) in trained:
                loss += [{"start": start + a, "end": start + b} for a, b in visitor.spans if b > a]
            attached += [{"turn": turns, **a} for a in visitor.attachments]
            text += [before, body, template.close]
            at = start + len(body) + len(template.close)
            turns += 1
        if turns:
            yield segment()

    made = rows.mapInArrow(joined, SEGMENTS)
    # partitions are in the order of conversations and turns, so their numbers order the segments of all
    return made.withColumn("segment", F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.col("segment"))


_PLACEHOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")


def turns_of(text: str, template: Template = TEMPLATE) -> Iterator[tuple[str, str, int]]:
    """(role, body, where the body begins) of each turn of a segment; roles are unescaped, bodies as written."""
    at = 0
    while at < len(text):
        if not text.startswith(template.open, at):
            raise ValueError(f"no turn begins at {at}")
        middle = text.index(template.middle, at)
        begin = middle + len(template.middle)
        end = text.index(template.close, begin)
        yield unescaped(text[at + len(template.open) : middle]), text[begin:end], begin
        at = end + len(template.close)


def body_parts(body: str, attachments: dict[int, dict]) -> Iterator[dict]:
    """The parts of a body: texts unescaped, placeholders by what is recorded of them."""
    at = 0
    for m in _PLACEHOLDER.finditer(body):
        if m.start() > at:
            yield {"type": "text", "text": unescaped(body[at : m.start()])}
        yield {"type": m[1], "ref": attachments[int(m[2])]["ref"], "tokens": attachments[int(m[2])]["tokens"]}
        at = m.end()
    if at < len(body):
        yield {"type": "text", "text": unescaped(body[at:])}


def read_back(text: str, attachments: list[dict], template: Template = TEMPLATE) -> Iterator[tuple[str, list[dict]]]:
    """The messages of a segment: (role, parts)."""
    for k, (role, body, _) in enumerate(turns_of(text, template)):
        yield role, list(body_parts(body, {a["number"]: a for a in attachments if a["turn"] == k}))


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long"


def digests(segments: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """What the segments of each conversation say, read back: its turns, the text under the loss mask, and its attachments.

    A conversation's segments come in order to one task, which holds one of them at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now: tuple | None = None
        turns, loss, figures = hashlib.sha256(), hashlib.sha256(), [0] * 5
        for batch in batches:
            for k in range(batch.num_rows):
                conv, text, masked, attached = (batch.column(c)[k].as_py() for c in (0, 2, 3, 4))
                if now != (conv,):
                    if now:
                        out.append((*now, figures[0], turns.hexdigest(), figures[1], loss.hexdigest(), *figures[2:]))
                    now, turns, loss, figures = (conv,), hashlib.sha256(), hashlib.sha256(), [0] * 5
                for role, parts in read_back(text, attached, template):
                    said = "".join(p["text"] if p["type"] == "text" else p["ref"] for p in parts)
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    figures[0] += 1
                for span in masked:
                    learnt = unescaped(text[span["start"] : span["end"]])
                    loss.update(learnt.encode("utf-8", "surrogatepass"))
                    figures[1] += len(learnt)
                figures[2] += len(text)
                figures[3] += len(attached)
                figures[4] += sum(a["tokens"] for a in attached)
            if len(out) >= 10_000:
                yield _rows(out)
                out = []
        if now:
            out.append((*now, figures[0], turns.hexdigest(), figures[1], loss.hexdigest(), *figures[2:]))
        yield _rows(out)

    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(read, DIGESTS)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string() if k.split()[1] == "string" else pa.int64() for k in DIGESTS.split(", ")]
    columns = list(zip(*out, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[k.split()[0] for k in DIGESTS.split(", ")])


PROBE = "</s>[INST] ok [/INST]"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    messages = said.unionByName(probe).select("conv_id", "turn", "role", parts_of("text").alias("content"))
    return digests(formatted(messages))


QUERIES = {"op12_chat_format": op12_chat_format}
_WRITTEN = f"regexp_replace({{}}, '([<\\[])(\\\\*(?:{_TAILS.replace(chr(39), chr(39) * 2)}))', '\\1\\\\\\2', 'g')"
ORACLES = {
    "op12_chat_format": f"""WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '{PROBE}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
 c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said, coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
  sum({len(TEMPLATE.open + TEMPLATE.middle + TEMPLATE.close)} + length({_WRITTEN.format("role")}) + length({_WRITTEN.format("text")})) AS formatted_chars FROM m GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS attachment_tokens FROM c"""
}

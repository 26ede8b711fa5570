"""PII (operator 2): entities are found and replaced by keyed surrogates of the same type and format.

Kinds: e-mail addresses, phone numbers, IPv4 addresses, card and account numbers, social security numbers, IBANs, and names
after a title or an introduction, or that begin with a known given name. A name is two kinds of entities, given names and a
family name, each known by its letters in lower case, so "Mr. Paul Meyer", "Dr. Paul Meyer" and "Mr. Meyer" agree; a
text's further words that are part of a name found in it are mentions too. Other entities are known by their canonical
form (digits only, lower case). All mentions get the same surrogate wherever they are (coreference), written in each
mention's own format.

Surrogates come from a keyed permutation of the canonical form: digits are permuted among numbers of as many digits by a
Feistel network, letters of an e-mail's user likewise; addresses stay within the same network class; cards and IBANs with
right check digits get right ones, others wrong ones; e-mails get a reserved domain. Given names come from lists for
gender and script, the gender being that of a known name, else what the titles all over the corpus say of it, else open;
family names are keyed syllables of the script.

A permutation makes no two entities alike, but names and domains can collide, and a surrogate can be some other real
entity. So the distinct entities of the corpus are proposed surrogates, and where two are written alike, or one is real,
all but the entity of least form try again; names and e-mails get longer with the attempts, so they never run out. Where
a kind of numbers is so full that real ones can't be avoided within `TRIES` attempts, all its entities go back to their
first permutation, which keeps them distinct. Only entities that had to try again, and given names of which titles tell
the gender, need a table. It's sent along where it has at most `SENT` rows, and joined by document beyond that.

Whoever holds the key can undo the permutations, so there is no default: callers give one, and the query takes that of
`spark.tablewell.pii.key` or, where it's unset, a random one that is kept nowhere.

Defined results: null text stays null; texts without entities are unchanged; null doc_ids pass; repeated rows each get their
row; further columns pass; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, join_skewed, materialise, read_table, slices

SENT = 20_000
TRIES = 64

# Patterns by kind; where two overlap, the earlier one counts.
NAME = r"[A-ZÀ-ÖØ-Þ][\w’'-]+(?:\x20[A-ZÀ-ÖØ-Þ][\w’'-]+){0,2}|[А-ЯЁ][а-яё-]+(?:\x20[А-ЯЁ][а-яё-]+){0,2}|[Α-ΩΆ-Ώ][α-ωά-ώ]+(?:\x20[Α-ΩΆ-Ώ][α-ωά-ώ]+){0,2}"
PATTERNS = (
    ("email", r"[\w.%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"),
    ("ipv4", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    ("iban", r"\b[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\w])\d{4}([\x20-]?)\d{4}\1\d{4}\1\d{1,7}(?![\w])|(?<!\w)\d{13,19}(?!\w)"),
    ("phone", r"(?<![\w.+])(?:\+\d{1,3}[\x20.-]?)?(?:\(\d{1,4}\)[\x20.-]?)\d{2,4}(?:[\x20.-]\d{2,5}){1,3}(?!\w)|(?<![\w.+])\+\d{1,3}(?:[\x20.-]?\d{2,5}){2,5}(?!\w)|(?<![\w.+-])\d{3}[\x20.-]\d{3}[\x20.-]\d{4}(?!\w)"),
    ("name", r"(?:(?<=\bMr )|(?<=\bMr\. )|(?<=\bMrs )|(?<=\bMrs\. )|(?<=\bMs )|(?<=\bMs\. )|(?<=\bDr )|(?<=\bDr\. )|(?<=\bHerr )|(?<=\bFrau )|(?<=\bMme )|(?<=\bM\. )|(?<=\bMonsieur )|(?<=\bMadame )|(?<=\bSeñor )|(?<=\bSeñora )|(?<=\bSr\. )|(?<=\bSra\. )|(?<=[Mm]y name is )|(?<=г-н )|(?<=г-жа ))(?:" + NAME + ")"),
)
# Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Alice Anna Carla Clara Diana Elena Emma Eva Greta Helen Ida Irene Julia Karla Laura Lena Lucy Maria Marta Mia Nina Nora Olga Paula Rosa Sara Sofia Tina Vera Zoe".split(),
    ("latin", "m"): "Adam Alan Bruno Carlos Daniel David Emil Eric Felix Frank Georg Hans Hugo Ivan Jakob Jan Karl Leon Louis Marc Max Nils Oscar Otto Paul Peter Ralf Simon Tom Victor".split(),
    ("latin", "x"): "Alex Andrea Chris Dominique Jamie Jean Kim Robin Sascha Toni".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга София Юлия".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Иван Максим Олег Павел Юрий".split(),
    ("cyrillic", "x"): "Валя Женя Саша Слава Шура".split(),
    ("greek", "f"): "Άννα Ελένη Ειρήνη Μαρία Σοφία Κατερίνα".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Γιάννης".split(),
    ("greek", "x"): "Χρύσα Άρης Μάκης Ρένα".split(),
}
# Syllables of family names by script.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бо ва во га го да до за зо ка ко ла ло ма мо на но па по ра ро са со та то".split(),
    "greek": "βα βο γα γο δα δο κα κο λα λο μα μο να νο πα πο ρα ρο σα σο τα το".split(),
}
# Title before a name and its gender.
FEMALE, MALE = ("Mrs", "Mrs.", "Ms", "Ms.", "Frau", "Mme", "Madame", "Señora", "Sra.", "г-жа"), ("Mr", "Mr.", "Herr", "M.", "Monsieur", "Señor", "Sr.", "г-н")

_GENDER = {name.lower(): g for (_, g), names in GIVEN.items() for name in names}
_WORD = re.compile(r"[^\W\d_](?:[\w’'-]*\w)?")
_TAIL = re.compile(r"[’']s?$")


@lru_cache
def _pattern(kinds: tuple[str, ...]) -> re.Pattern:
    """The patterns of some kinds as one, each with a group of its name."""
    own = {kind: p.replace(r"([\x20-]?)", r"(?P<gap>[\x20-]?)").replace(r"\1", "(?P=gap)") for kind, p in PATTERNS if kind in kinds}
    return re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in own.items()))


_DIGIT = re.compile(r"\d")
# every name's title ends so; texts without one need no search for names
_TITLE = re.compile(r"(?:M[rs]|Mrs|Dr|Sr|Sra|M|Herr|Frau|Mme|Monsieur|Madame|Señora?|name is|г-н|г-жа)\.?\x20")


def _kinds(text: str) -> tuple[str, ...]:
    """The kinds that a text can have at all, by what none of their mentions lacks."""
    email = ("email",) if "@" in text else ()
    numbers = ("ipv4", "iban", "ssn", "card", "phone") if _DIGIT.search(text) else ()
    return (*email, *numbers, *(("name",) if _TITLE.search(text) else ()))


_CAPITAL = "[A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆ-Ώ]"
_PAIR = re.compile(rf"{_CAPITAL}[^\W\d_]+(?=\x20{_CAPITAL}[^\W\d_])")


def script_of(text: str) -> str:
    if any("Ѐ" <= c <= "ӿ" for c in text):
        return "cyrillic"
    return "greek" if any("Ͱ" <= c <= "Ͽ" for c in text) else "latin"


class Mention(NamedTuple):
    start: int
    end: int
    kind: str
    form: str
    """The entity, the same for all its mentions; of a name, the word in lower case."""
    gender: str = ""
    """Of a given name: what the title says, if it does."""
    head: bool = True
    """Whether this begins a mention (of a name of several words, only the first one does)."""


def _name(text: str, start: int, end: int, before: str) -> list[Mention]:
    """The words of a name: given names and, last, the family name; one word alone is a family name unless it's a known
    given name or an introduction's."""
    words = []
    for m in _WORD.finditer(text, start, end):
        core = _TAIL.sub("", m[0])
        if core:
            words.append((m.start(), m.start() + len(core), core.lower()))
    title = before.split()[-1] if before.split() else ""
    gender = "f" if title in FEMALE else "m" if title in MALE else ""
    alone = len(words) == 1 and (words[0][2] in _GENDER or before.endswith("name is "))
    return [Mention(a, b, "given" if alone or k < len(words) - 1 else "family", w, gender if k == 0 else "", k == 0) for k, (a, b, w) in enumerate(words)]


def _untitled(text: str) -> list[tuple[int, int]]:
    """Where a known given name stands that a capitalised word follows."""
    return [(m.start(), _WORD.match(text, m.end() + 1).end()) for m in _PAIR.finditer(text) if m[0].lower() in _GENDER and not text[m.start() - 1 : m.start()].isalnum()]  # type: ignore[union-attr]


def find(text: str) -> list[Mention]:
    """The mentions of entities in a text, in order."""
    untitled = _untitled(text)
    kinds = _kinds(text)
    if not untitled and not kinds:
        return []
    out: list[Mention] = []
    for m in _pattern(kinds).finditer(text) if kinds else ():
        kind, value = next((k, v) for k, v in m.groupdict().items() if v is not None and k != "gap")
        if kind == "name":
            out += _name(text, m.start(), m.end(), text[max(0, m.start() - 12) : m.start()])
        elif kind in ("card", "phone", "ssn"):
            out.append(Mention(m.start(), m.end(), kind, re.sub(r"\D", "", value)))
        else:
            out.append(Mention(m.start(), m.end(), kind, value.replace(" ", "") if kind == "iban" else value.lower()))
    if untitled:
        taken = [m.start for m in out]
        free = lambda a, b: (k := bisect_left(taken, b)) == 0 or out[k - 1].end <= a
        more = [w for a, b in untitled if free(a, b) for w in _name(text, a, b, "")]
        for w in more:  # "Anna Lena Meyer" has two pairs that share a word
            if not out or w.start not in taken:
                taken.append(w.start)
                out.append(w)
        out.sort()
    names = {m.form: m.kind for m in out if m.kind in ("given", "family")}
    return _further(text, out, names) if names else out


def _further(text: str, found: list[Mention], names: dict[str, str]) -> list[Mention]:
    """With the capitalised words between the mentions that are part of a name found in the text."""
    out: list[Mention] = []
    at = 0
    for m in [*found, None]:
        for w in _WORD.finditer(text, at, m.start if m else len(text)):
            core = _TAIL.sub("", w[0])
            if core[:1].isupper() and core.lower() in names:
                follows = bool(out) and out[-1].kind == "given" and text[out[-1].end : w.start()] == " "
                out.append(Mention(w.start(), w.start() + len(core), names[core.lower()], core.lower(), "", not follows))
        if m:
            out.append(m)
            at = m.end
    return out


def _number(key: bytes, *parts: str) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(parts).encode(), hashlib.sha256).digest()[:16], "big")


def permuted_digits(key: bytes, tag: str, digits: str, alphabet: str = "0123456789") -> str:
    """A keyed permutation of the strings of as many digits: a Feistel network of eight rounds on two halves."""
    n, base = len(digits), len(alphabet)
    if n < 2:
        order = sorted(alphabet, key=lambda d: _number(key, tag, d))
        return "".join(order[alphabet.index(d)] for d in digits)
    left, right = digits[: n // 2], digits[n // 2 :]
    for r in range(8):
        width = len(left)
        moved = (sum(alphabet.index(c) * base**k for k, c in enumerate(reversed(left))) + _number(key, tag, str(r), str(n), right)) % base**width
        fresh = ""
        for _ in range(width):
            moved, d = divmod(moved, base)
            fresh = alphabet[d] + fresh
        left, right = right, fresh
    return left + right


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _luhn(digits: str) -> int:
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10


def _right_check(country: str, account: str) -> str:
    """The check digits of an IBAN."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def _permuted_runs(key: bytes, tag: str, text: str) -> str:
    """Digits permuted among digits and letters among letters, run by run."""
    runs = re.findall(r"\d+|[A-Z]+", text)
    return "".join(permuted_digits(key, f"{tag}/{k}", r) if r.isdigit() else permuted_digits(key, f"{tag}/{k}", r.lower(), LETTERS).upper() for k, r in enumerate(runs))


def _iban(key: bytes, tag: str, form: str) -> str:
    country, check, account = form[:2], form[2:4], form[4:]
    made = _permuted_runs(key, tag + country, account)
    right, was_right = _right_check(country, made), _right_check(country, account)
    if check == was_right:
        return country + right + made
    moved = lambda digits: permuted_digits(key, tag + made, digits)
    return country + (moved(check) if moved(check) != right else moved(was_right)) + made


def _card(key: bytes, tag: str, form: str) -> str:
    if _luhn(form) == 0:
        body = permuted_digits(key, tag, form[:-1])
        return body + str(-_luhn(body + "0") % 10)
    made = permuted_digits(key, tag, form)
    while _luhn(made) == 0:  # on along the permutation's cycle, which leads back to a number of the same class
        made = permuted_digits(key, tag, made)
    return made


def _email(key: bytes, tag: str, form: str, attempt: int) -> str:
    user, _, domain = form.partition("@")

    def moved(run: str) -> str:
        if run.isdigit() and run.isascii():
            return permuted_digits(key, tag + domain, run)
        if not run.isalpha():
            return run
        return permuted_digits(key, tag + domain, run if run.isascii() else "".join(LETTERS[ord(c) % 26] for c in run), LETTERS)

    plain = "".join(map(moved, re.findall(r"[0-9]+|[a-z]+|[^\W\d_a-z]+|\W|_|\d", user)))
    digits = 6 + attempt
    return f"{plain}@mail{_number(key, tag, domain) % 10**digits:0{digits}d}.example.{('com', 'net', 'org')[_number(key, domain) % 3]}"


def _name_of(key: bytes, tag: str, kind: str, form: str, attempt: int, gender: str) -> str:
    """A given name of the lists, of several of them after some attempts, or a family name of syllables."""
    script = script_of(form)
    pick = _number(key, tag, form)
    if kind == "given":
        pool = GIVEN[script, _GENDER.get(form) or gender or "x"]
        return "-".join(pool[(pick >> 16 * k) % len(pool)] for k in range(1 + min(attempt // 2, 7)))
    syllables = SYLLABLES[script]
    many = 3 + pick % 2 + attempt // 3
    return "".join(syllables[_number(key, tag, form, str(k)) % len(syllables)] for k in range(many)).capitalize()


@lru_cache(maxsize=200_000)
def surrogate(key: bytes, kind: str, form: str, attempt: int, gender: str = "") -> str:
    """The surrogate, as a canonical form, at an attempt."""
    tag = f"{kind}{attempt}"
    if kind in ("given", "family"):
        return _name_of(key, tag, kind, form, attempt, gender)
    if kind == "card":
        return _card(key, tag, form)
    if kind == "iban":
        return _iban(key, tag, form)
    if kind == "email":
        return _email(key, tag, form, attempt)
    if kind == "phone":
        keep = max(0, len(form) - 10)
        return form[:keep] + permuted_digits(key, tag + form[:keep], form[keep:])
    if kind == "ipv4":
        first, *rest = (int(x) for x in form.split("."))
        n = permuted_digits(key, tag + str(first), "".join(f"{x:02x}" for x in rest), "0123456789abcdef")
        return f"{first}." + ".".join(str(int(n[k : k + 2], 16)) for k in (0, 2, 4))
    return permuted_digits(key, tag, form)


def written(kind: str, value: str, made: str) -> str:
    """A surrogate's canonical form in the format of a mention."""
    if kind in ("card", "phone", "ssn", "iban"):
        fresh = iter(made)
        return "".join(next(fresh) if c.isalnum() else c for c in value)
    letters = [c for c in value.partition("@")[0] if c.isalpha()]
    shout = len(letters) > (kind != "email") and all(c.isupper() for c in letters)
    return made.upper() if kind in ("email", "given", "family") and shout else made


def replaced(text: str, key: bytes, told: dict[tuple[str, str], tuple[int, str]]) -> tuple[str, int]:
    """The text with surrogates, and the number of mentions; `told` has the attempt and the gender of entities where these
    aren't 0 and unknown."""
    at, out, found = 0, [], find(text)
    for m in found:
        out += [text[at : m.start], written(m.kind, text[m.start : m.end], surrogate(key, m.kind, m.form, *told.get((m.kind, m.form), (0, ""))))]
        at = m.end
    return "".join(out) + text[at:], sum(m.head for m in found)


ENTITY = "kind string, form string, gender string, attempt int, made string"
ONE_TO_ONE = ("card", "iban", "ipv4", "phone", "ssn")


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4 << 20):
        found = sorted({(m.kind, m.form, m.gender) for t in batch.column(0).to_pylist() if t for m in find(t)})
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.string()) for j in range(3)], names=["kind", "form", "gender"])


def _proposed(key: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [surrogate(key, k, f, a, g) for k, f, g, a in zip(*(c.to_pylist() for c in b.columns[:4]), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(made, pa.string())], names=["kind", "form", "gender", "attempt", "made"])

    return run


def _space(kind: str = "kind") -> Column:
    """Kinds whose surrogates are compared: names of both kinds could be taken for each other."""
    return F.when(F.col(kind).isin("given", "family"), "name").otherwise(F.col(kind))


def assigned(docs: DataFrame, key: bytes, tries: int = TRIES) -> DataFrame:
    """kind, form, gender, attempt and surrogate of the distinct entities of `docs` (text), without collisions."""
    seen = docs.select("text").mapInArrow(_entities, "kind string, form string, gender string")
    says = lambda g: F.max(F.col("gender") == g)
    both = seen.groupBy("kind", "form").agg(says("f").alias("f"), says("m").alias("m"))
    forms = materialise(both.select("kind", "form", F.when(F.col("f") & ~F.col("m"), "f").when(F.col("m") & ~F.col("f"), "m").otherwise("").alias("gender")))
    real = forms.select(_space().alias("space"), F.lower("form").alias("alike")).distinct()
    proposed = lambda df: materialise(df.select("kind", "form", "gender", "attempt").mapInArrow(_proposed(key), ENTITY).withColumns({"space": _space(), "alike": F.lower("made")}))
    now = proposed(forms.withColumn("attempt", F.lit(0)))
    for _ in range(tries):
        first = now.groupBy("space", "alike").agg(F.min(F.struct("attempt", "kind", "form")).alias("best"), F.count("*").alias("n"))
        twice = now.join(first.where("n > 1"), ["space", "alike"]).where("kind <> best.kind or form <> best.form").select("kind", "form")
        losers = materialise(twice.unionByName(now.join(real, ["space", "alike"], "left_semi").select("kind", "form")).distinct())
        if losers.isEmpty():
            break
        lost = losers.withColumn("lost", F.lit(1))
        now = proposed(now.join(lost, ["kind", "form"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("lost", F.lit(0))))
    else:
        full = [r.kind for r in losers.select("kind").distinct().collect() if r.kind in ONE_TO_ONE]
        now = proposed(now.withColumn("attempt", F.when(F.col("kind").isin(full), 0).otherwise(F.col("attempt"))))
    return now.select("kind", "form", "gender", "attempt", "made")


def _texts(key: bytes, text_at: int, told: dict[tuple[str, str], tuple[int, str]], extra: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            texts = batch.column(text_at).to_pylist()
            own = [{(e["kind"], e["form"]): (e["attempt"], e["gender"]) for e in x or []} for x in batch.column(batch.num_columns - 1).to_pylist()] if extra else [told] * len(texts)
            done = [(None, 0) if t is None else replaced(t, key, r) for t, r in zip(texts, own, strict=True)]
            columns = [pa.array([d[0] for d in done], batch.schema.field(k).type) if k == text_at else batch.column(k) for k in range(batch.num_columns - extra)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([d[1] for d in done], pa.int64())], names=[*batch.schema.names[: len(columns)], "n"])

    return run


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4 << 20):
        rows = sorted({(r, m.kind, m.form) for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for m in find(t)})
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], pa.string()) for j in range(3)], names=["text_hash", "kind", "form"])


def with_surrogates(docs: DataFrame, count: str, key: bytes, sent: int = SENT) -> DataFrame:
    """`docs`, all columns, surrogates in text, and the number of mentions under `count`."""
    if not key:
        raise ValueError("surrogates need a key")
    told = assigned(docs, key).where("attempt > 0 or gender <> ''").select("kind", "form", "attempt", "gender")
    at = docs.columns.index("text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{count}` long"])
    few = told.limit(sent + 1).collect()
    if len(few) <= sent:
        return docs.mapInArrow(_texts(key, at, {(r.kind, r.form): (r.attempt, r.gender) for r in few}, False), schema)
    mark, table = free_name(docs.columns, "text_hash"), free_name(docs.columns, "told")
    digest = F.sha2(F.col("text").cast("binary"), 256)
    found = docs.select(digest.alias("text_hash"), "text").mapInArrow(_mentions, "text_hash string, kind string, form string").distinct()
    # an entity can be in a third of all texts, so its mentions aren't dealt by entity alone
    mentions = materialise(found.select("text_hash", F.struct("kind", "form").alias("entity")))
    figures = told.select(F.struct("kind", "form").alias("entity"), "attempt", "gender").join(mentions.groupBy("entity").agg(F.count("*").alias("n")), "entity")
    named = join_skewed(mentions, materialise(figures), "entity", "n").select("text_hash", "entity.*", "attempt", "gender")
    tables = named.groupBy("text_hash").agg(F.collect_list(F.struct("kind", "form", "attempt", "gender")).alias(table)).withColumnRenamed("text_hash", mark)
    joined = docs.withColumn(mark, digest).join(tables, mark, "left").select(*(F.col(f"`{c}`") for c in docs.columns), F.col(table))
    return joined.mapInArrow(_texts(key, at, {}, True), schema)


def key_of(spark: SparkSession) -> bytes:
    """The key that the session names, else a random one."""
    own = spark.conf.get("spark.tablewell.pii.key", None)
    return own.encode() if own else secrets.token_bytes(32)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "n_entities", key_of(spark))


QUERIES = {"op2_pii_surrogates": op2_pii_surrogates}
ORACLES: dict[str, str] = {}

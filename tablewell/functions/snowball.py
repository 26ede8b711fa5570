"""The Snowball stemmers of German, French, Spanish and English.

Each is written as its published definition states it: regions R1, R2 and RV of a word, and steps that look for the longest
of a list of suffixes and change it if it lies in a region. A word is any lower-case text; what comes back is never longer
than it, but for German ß, which is read as ss.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache

from .porter import stem as porter


def _list(text: str) -> frozenset[str]:
    return frozenset(text.split())


def _after(word: str, vowels: str, start: int = 0) -> int:
    """Where the region begins that follows the first non-vowel after a vowel, from `start` on."""
    m = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    return m.end() if m else len(word)


def _longest(word: str, suffixes: Iterable[str], start: int = 0) -> str:
    """The longest suffix that lies in the word from `start` on; empty if there is none."""
    return max((s for s in suffixes if word.endswith(s) and len(word) - len(s) >= start), key=len, default="")


def _cut(word: str, suffix: str, start: int, by: str = "") -> str:
    """The word with `by` in place of its suffix, if that lies in the region from `start` on."""
    return word[: len(word) - len(suffix)] + by if suffix and word.endswith(suffix) and len(word) - len(suffix) >= start else word


# --- German. The published vowels and suffixes.
_DE = "aeiouyäöü"
_DE_FIRST, _DE_SECOND = _list("em ern er e en es s"), _list("en er est st")
_DE_THIRD = _list("end ung ig ik isch lich heit keit")
_DE_BEFORE_S, _DE_BEFORE_ST = "bdfghklmnrt", "bdfghklmnt"


def german(word: str) -> str:
    w = word.replace("ß", "ss")
    # from left to right: a letter in upper case is no vowel to the next one
    while m := re.search(f"(?<=[{_DE}])[uy](?=[{_DE}])", w):
        w = w[: m.start()] + m[0].upper() + w[m.end() :]
    first = _after(w, _DE)
    r2 = _after(w, _DE, first)
    r1 = max(3, first)

    s = _longest(w, _DE_FIRST)
    if s != "s" or w[-2:-1] in tuple(_DE_BEFORE_S):
        cut = _cut(w, s, r1)
        w = cut[:-1] if cut != w and s in ("e", "en", "es") and cut.endswith("niss") else cut
    s = _longest(w, _DE_SECOND)
    if s != "st" or (w[-3:-2] in tuple(_DE_BEFORE_ST) and len(w) >= 6):
        w = _cut(w, s, r1)
    s = _longest(w, _DE_THIRD)
    cut = _cut(w, s, r2)
    if cut != w:
        if s in ("end", "ung"):
            w = cut if not cut.endswith("ig") or cut.endswith("eig") else _cut(cut, "ig", r2)
        elif s in ("ig", "ik", "isch"):
            w = w if cut.endswith("e") else cut
        elif s in ("lich", "heit"):
            w = _cut(cut, _longest(cut, ("er", "en")), r1)
        else:
            w = _cut(cut, _longest(cut, ("lich", "ig")), r2)
    return w.translate(_DE_LAST)


_DE_LAST = str.maketrans("UYäöü", "uyaou")

# --- French. The published vowels and suffixes.
_FR = "aeiouyâàëéêèïîôûù"
_FR_PLAIN = _list("ance iqUe isme able iste eux ances iqUes ismes ables istes")
_FR_ATION = _list("atrice ateur ation atrices ateurs ations")
_FR_FIRST = (
    _FR_PLAIN | _FR_ATION
    | _list("logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments")
)
_FR_I_VERBS = _list(
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante "
    "issantes issants isse issent isses issez issiez issions issons it"
)
_FR_VERBS = _list("é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez")
_FR_PAST = _list("âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions")


def _french_marks(word: str) -> str:
    """Letters that look like vowels and aren't, in upper case: found from left to right, one after the other."""
    out, k = list(word), 0
    vowel = lambda i: 0 <= i < len(out) and out[i] in _FR
    while k < len(out):
        # a letter that has become a consonant counts as one for what follows it
        if vowel(k) and k + 1 < len(out):
            if out[k + 1] in "ui" and vowel(k + 2):
                out[k + 1] = out[k + 1].upper()
                k += 2
                continue
            if out[k + 1] == "y":
                out[k + 1] = "Y"
                k += 2
                continue
        if out[k] == "y" and vowel(k + 1):
            out[k] = "Y"
            k += 1
            continue
        if out[k] == "q" and k + 1 < len(out) and out[k + 1] == "u":
            out[k + 1] = "U"
            k += 2
            continue
        k += 1
    return "".join(out)


def _french_first(w: str, rv: int, r1: int, r2: int) -> tuple[str, bool]:
    """Step 1: the word, and whether verb endings are looked for all the same."""
    s = _longest(w, _FR_FIRST)
    if s in _FR_PLAIN:
        return _cut(w, s, r2), False
    if s in _FR_ATION:
        cut = _cut(w, s, r2)
        if cut != w and cut.endswith("ic"):
            return (_cut(cut, "ic", r2) if len(cut) - 2 >= r2 else cut[:-2] + "iqU"), False
        return cut, False
    for kind, by in (("logie", "log"), ("usion", "u"), ("ution", "u"), ("ence", "ent")):
        if s in (kind, kind + "s"):
            return _cut(w, s, r2, by), False
    if s in ("ement", "ements"):
        cut = _cut(w, s, rv)
        if cut == w:
            return w, False
        w = cut
        if w.endswith("iv"):
            cut = _cut(w, "iv", r2)
            return (_cut(cut, "at", r2) if cut != w else w), False
        if w.endswith("eus"):
            return (_cut(w, "eus", r2) if len(w) - 3 >= r2 else _cut(w, "eus", r1, "eux")), False
        if w.endswith(("abl", "iqU")):
            return w[:-3] if len(w) - 3 >= r2 else w, False
        return _cut(w, w[-3:], rv, "i") if w.endswith(("ièr", "Ièr")) else w, False
    if s in ("ité", "ités"):
        cut = _cut(w, s, r2)
        if cut == w:
            return w, False
        if cut.endswith("abil"):
            return (cut[:-4] if len(cut) - 4 >= r2 else cut[:-4] + "abl"), False
        if cut.endswith("ic"):
            return (cut[:-2] if len(cut) - 2 >= r2 else cut[:-2] + "iqU"), False
        return _cut(cut, "iv", r2), False
    if s in ("if", "ive", "ifs", "ives"):
        cut = _cut(w, s, r2)
        more = _cut(cut, "at", r2) if cut != w else cut
        if more != cut and more.endswith("ic"):
            more = more[:-2] if len(more) - 2 >= r2 else more[:-2] + "iqU"
        return more, False
    if s == "eaux":
        return w[:-1], False
    if s == "aux":
        return _cut(w, s, r1, "al"), False
    if s in ("euse", "euses"):
        return (_cut(w, s, r2) if len(w) - len(s) >= r2 else _cut(w, s, r1, "eux")), False
    if s in ("issement", "issements"):
        before = w[: len(w) - len(s)]
        return (_cut(w, s, r1) if before and before[-1] not in _FR else w), False
    if s in ("amment", "emment"):
        return _cut(w, s, rv, s[0] + "nt"), True
    if s in ("ment", "ments"):
        before = w[: len(w) - len(s)]
        return (before if len(before) - 1 >= rv and before[-1] in _FR else w), True
    return w, True


def french(word: str) -> str:
    w = _french_marks(word)
    if len(w) > 1 and w[0] in _FR and w[1] in _FR or w[:3] in ("par", "col", "tap"):
        rv = min(3, len(w))
    else:
        m = re.compile(f"[{_FR}]").search(w, 1)
        rv = m.end() if m else len(w)
    r1 = _after(w, _FR)
    r2 = _after(w, _FR, r1)

    before = w
    w, verbs = _french_first(w, rv, r1, r2)
    altered = w != before and not verbs
    if not altered:
        now = w
        s = _longest(w, _FR_I_VERBS, rv)
        if s and len(w) - len(s) - 1 >= rv and w[len(w) - len(s) - 1] not in _FR:
            w = _cut(w, s, rv)
        if w == now:
            s = _longest(w, _FR_VERBS | _FR_PAST | {"ions"}, rv)
            if s == "ions":
                w = _cut(w, s, r2)
            elif s in _FR_VERBS:
                w = _cut(w, s, rv)
            elif s:
                w = _cut(_cut(w, s, rv), "e", rv)
        altered = altered or w != now
    if altered:
        w = w[:-1] + {"Y": "i", "ç": "c"}.get(w[-1:], w[-1:])
    else:
        if w.endswith("s") and w[-2:-1] not in tuple("aiouès") and len(w) > 1:
            w = w[:-1]
        s = _longest(w, ("ion", "ier", "ière", "Ier", "Ière", "e"), rv)
        if s == "ion":
            w = _cut(w, s, r2) if w[-4:-3] in ("s", "t") and len(w) - 4 >= rv else w
        elif s == "e":
            w = w[:-1]
        elif s:
            w = _cut(w, s, rv, "i")
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    w = re.sub(f"[éè]([^{_FR}]+)$", r"e\1", w)
    return w.lower()


# --- Spanish. The published vowels and suffixes.
_ES = "aeiouáéíóúü"
_ES_ACUTE = str.maketrans("áéíóú", "aeiou")
_ES_PRONOUNS = _list("me se sela selo selas selos la le lo las les los nos")
_ES_BEFORE = _list("iéndo ándo ár ér ír ando iendo ar er ir yendo")
_ES_PLAIN = _list("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos")
_ES_ATION = _list("adora ador ación adoras adores aciones ante antes ancia ancias")
_ES_FIRST = _ES_PLAIN | _ES_ATION | _list("logía logías ución uciones encia encias amente mente idad idades iva ivo ivas ivos")
_ES_Y_VERBS = _list("ya ye yan yen yeron yendo yo yó yas yes yais yamos")
_ES_VERBS = _list(
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías "
    "irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen "
    "aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis "
    "isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
)
_ES_SHORT = _list("en es éis emos")
_ES_RESIDUE = _list("os a o á í ó e é")


def _spanish_first(w: str, r1: int, r2: int) -> str:
    s = _longest(w, _ES_FIRST)
    if s in _ES_PLAIN:
        return _cut(w, s, r2)
    if s in _ES_ATION:
        cut = _cut(w, s, r2)
        return _cut(cut, "ic", r2) if cut != w else w
    for kind, by in (("logía", "log"), ("ución", "u"), ("encia", "ente")):
        if s in (kind, kind + "s") or (kind == "ución" and s == "uciones"):
            return _cut(w, s, r2, by)
    if s == "amente":
        cut = _cut(w, s, r1)
        if cut != w:
            if cut.endswith("iv"):
                more = _cut(cut, "iv", r2)
                return _cut(more, "at", r2) if more != cut else cut
            return _cut(cut, _longest(cut, ("os", "ic", "ad")), r2)
        return w
    after = {"mente": ("ante", "able", "ible"), "idad": ("abil", "ic", "iv"), "iv": ("at",)}
    for kind, more in after.items():
        if s and (s.startswith(kind) if kind != "mente" else s == kind):
            cut = _cut(w, s, r2)
            return _cut(cut, _longest(cut, more), r2) if cut != w else w
    return w


def spanish(word: str) -> str:
    w = word
    rv = len(w)
    if len(w) > 1:
        if w[1] not in _ES:
            m = re.compile(f"[{_ES}]").search(w, 2)
            rv = m.end() if m else len(w)
        elif w[0] in _ES:
            m = re.compile(f"[^{_ES}]").search(w, 2)
            rv = m.end() if m else len(w)
        else:
            rv = min(3, len(w))
    r1 = _after(w, _ES)
    r2 = _after(w, _ES, r1)

    if pronoun := _longest(w, _ES_PRONOUNS):
        rest = w[: len(w) - len(pronoun)]
        verb = _longest(rest, _ES_BEFORE, rv)
        if verb == "yendo":
            w = rest if rest.endswith("uyendo") else w
        elif verb:
            w = rest[: len(rest) - len(verb)] + verb.translate(_ES_ACUTE)
    first = _spanish_first(w, r1, r2)
    if first == w:
        s = _longest(w, _ES_Y_VERBS, rv)
        if s and w[: len(w) - len(s)].endswith("u"):
            w = _cut(w, s, rv)
        elif s := _longest(w, _ES_VERBS | _ES_SHORT, rv):
            w = _cut(w, s, rv)
            if s in _ES_SHORT and w.endswith("gu"):
                w = w[:-1]
    else:
        w = first
    if s := _longest(w, _ES_RESIDUE, rv):
        w = _cut(w, s, rv)
        if s in "eé" and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_ES_ACUTE)


# --- English, the second stemmer of its author. The published suffixes and exceptions.
_EN = "aeiouy"
_EN_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_EN_WHOLE = dict(skis="ski", skies="sky", dying="die", lying="lie", tying="tie", idly="idl", gently="gentl", ugly="ugli", early="earli", only="onli", singly="singl") | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
_EN_STAY = _list("inning outing canning herring earring proceed exceed succeed")
_EN_SECOND = dict(tional="tion", enci="ence", anci="ance", abli="able", entli="ent", izer="ize", ization="ize", ational="ate", ation="ate", ator="ate", alism="al", aliti="al", alli="al", fulness="ful", ousli="ous", ousness="ous", iveness="ive", iviti="ive", biliti="ble", bli="ble", ogi="og", fulli="ful", lessli="less", li="")
_EN_THIRD = dict(tional="tion", ational="ate", alize="al", icate="ic", iciti="ic", ical="ic", ful="", ness="", ative="")
_EN_FOURTH = _list("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion")


def _english_short(word: str) -> bool:
    return bool(re.search(f"[^{_EN}][{_EN}][^{_EN}wxY]$", word) or re.fullmatch(f"[{_EN}][^{_EN}]", word))


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word.removeprefix("'")
    if w in _EN_WHOLE:
        return _EN_WHOLE[w]
    w = re.sub(f"(?:(?<=[{_EN}])|^)y", "Y", w)
    m = re.match("gener|commun|arsen", w)
    r1 = m.end() if m else _after(w, _EN)
    r2 = _after(w, _EN, r1)

    w = _cut(w, _longest(w, ("'", "'s", "'s'")), 0)
    s = _longest(w, ("sses", "ied", "ies", "s", "us", "ss"))
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and re.search(f"[{_EN}]", w[:-2]):
        w = w[:-1]
    if w in _EN_STAY:
        return w
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        w = _cut(w, s, r1, "ee")
    elif s and re.search(f"[{_EN}]", w[: len(w) - len(s)]):
        w = w[: len(w) - len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_EN_DOUBLE):
            w = w[:-1]
        elif len(w) <= r1 and _english_short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _EN:
        w = w[:-1] + "i"
    s = _longest(w, _EN_SECOND)
    if s == "ogi":
        w = _cut(w, s, r1, "og") if w.endswith("logi") else w
    elif s == "li":
        w = _cut(w, s, r1) if w[-3:-2] in tuple("cdeghkmnrt") else w
    elif s:
        w = _cut(w, s, r1, _EN_SECOND[s])
    s = _longest(w, _EN_THIRD)
    if s:
        w = _cut(w, s, r2 if s == "ative" else r1, _EN_THIRD[s])
    s = _longest(w, _EN_FOURTH)
    if s and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = _cut(w, s, r2)
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _english_short(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


STEMMERS: dict[str, Callable[[str], str]] = {"none": lambda w: w, "porter": porter, "english": english, "german": german, "french": french, "spanish": spanish}


def stemmer(language: str) -> Callable[[str], str]:
    """The stemmer of a name; ValueError if there is none."""
    if language not in STEMMERS:
        raise ValueError(f"no stemmer is named {language!r}; there are {', '.join(STEMMERS)}")
    return _remembering(language)


@lru_cache
def _remembering(language: str) -> Callable[[str], str]:
    return lru_cache(1 << 16)(STEMMERS[language])

"""One consistent character form for text that looks the same.

A JVM-side quick check (regular expressions over Unicode properties) tells stable values, which are nearly all, from
those that may be unstable; only the latter reach Python, in Arrow batches. There the unstable segments are
isolated with their boundary context (a base letter with its marks, a number around a full stop, a word), only
they are normalised, and the canonical segments are spliced into the unchanged rest.

The form: doubles of ordinary letters, digits and ideographs (full width, ligatures, presentation and
compatibility forms, letter-like Roman numerals, radicals, half-width kana) become the ordinary ones; a full stop of another width
inside a number becomes "."; marks are joined with their letter where a joined form exists; characters that show nothing go, but for joiners
and selectors that change how their neighbours look;
spaces other than the ordinary one become it; look-alike letters follow the alphabet of their word, words made only of
look-alikes the alphabet of the text. Tabs and line ends, Chinese punctuation, ellipses, middle dots, superscripts, circled
numbers, typographic quotes and dashes and Greek symbols standing alone stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cyrillic and Greek letters and the Latin letters they look like.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҺԚԜаеѕіјорсухһԁԛԝһ", "ABESIJKMHOPCTYXhQWaesijopcyxhdqwh", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυχι", "ABEZHIKMNOPTYXavopuxi", strict=True))
#: Greek letters that commonly stand alone as symbols look like Latin ones only inside words.
_TO_CYRILLIC = {v: k for k, v in reversed(CYRILLIC.items()) if k not in "ҺһԁԛԚԜԝ"}
_TO_GREEK = {v: k for k, v in GREEK.items()}
ARMENIAN = dict(zip("օոսհցզՕՍԼ", "onuhgqOUL", strict=True))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ", strict=True))
#: Latin letters of phonetic alphabets that look like ordinary ones.
PHONETIC = dict(zip("ɡɑ", "ga", strict=True))
_FOLD = {("C", "L"): CYRILLIC, ("G", "L"): GREEK, ("L", "C"): _TO_CYRILLIC, ("L", "G"): _TO_GREEK, ("A", "L"): ARMENIAN, ("K", "L"): CHEROKEE}
# by way of the Latin letter that both look like
_FOLD |= {("G", "C"): {g: _TO_CYRILLIC[x] for g, x in GREEK.items() if x in _TO_CYRILLIC}, ("C", "G"): {c: _TO_GREEK[x] for c, x in CYRILLIC.items() if x in _TO_GREEK}}
_STOPS = "\uff0e\ufe52\u2024\uff61"
#: Compatibility decompositions that are doubles of ordinary characters; the others carry meaning of their own.
_DOUBLE = ("<wide>", "<narrow>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
_WORD = re.compile(r"(?:[A-Za-z\u00aa\u00ba\u00c0-\u02af\u0370-\u052f\u0531-\u0587\u13a0-\u13ff\u1e00-\u1fff\u2c60-\u2c7f\ua640-\ua69f][\u0300-\u036f]*)+")
_NUMBER_STOP = re.compile(rf"(?<=\d)(\s*)[{_STOPS}](?=\s*\d)")


def _code_points() -> tuple[list[int], list[int]]:
    """From the normalization properties: characters that aren't their own composed form or are the double of one ordinary character, and
    those that may join with or be reordered behind the character before (the quick check's "maybe", and all with a combining class)."""
    other, joins = [], set()
    for o in (*range(0x80, 0xD800), *range(0xE000, 0x32000)):
        ch = chr(o)
        to = unicodedata.decomposition(ch)
        if unicodedata.combining(ch):
            joins.add(o)
        if not to:
            continue
        tag, _, rest = to.partition(" ") if to[0] == "<" else ("", "", to)
        parts = rest.split()
        base = unicodedata.decomposition(unicodedata.normalize("NFD", ch)[0])
        if unicodedata.normalize("NFC", ch) != ch or (not tag and base.startswith("<compat>")) or (tag in _DOUBLE and len(parts) == 1 and chr(int(parts[0], 16)).isalnum()):
            other.append(o)
        if not tag and len(parts) == 2 and unicodedata.normalize("NFC", ch) == ch:
            joins.add(int(parts[1], 16))
    return other, sorted(joins | set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3)))


def _ranges(points: list[int], form: str) -> str:
    """Character-class text of sorted code points."""
    out, start, last = [], None, None
    for o in [*points, None]:
        if start is not None and (o is None or o != last + 1):
            out.append(form % start + (f"-{form % last}" if last > start else ""))
            start = None
        if start is None:
            start = o
        last = o
    return "".join(out)


_UNSTABLE_POINTS, _JOIN_POINTS = _code_points()
_MARKED = re.compile(rf"[^{_ranges(_JOIN_POINTS, r'\U%08x')}][{_ranges(_JOIN_POINTS, r'\U%08x')}]+", re.S)
# Joiners and selectors that are seen: between letters of joining scripts, between and behind pictures.
_JOINING, _PICTURE = r"\u0600-\u08ff\u0900-\u0dff\u1000-\u109f\u1780-\u17ff\u1800-\u18aa\ufb50-\ufefc", r"\u203c-\u3299\U0001f000-\U0001faff"
_SEEN = rf"(?<=[{_JOINING}])[\u200c\u200d](?=[{_JOINING}])|(?<=[{_PICTURE}\ufe0f])\u200d(?=[{_PICTURE}])|(?<=[{_PICTURE}0-9#*])[\ufe0e\ufe0f]"
_HALF_MARKS = re.compile(r"(?<=[\u30a1-\u30fa])[\uff9e\uff9f]")

# Quick check, JVM-side: what no unstable value lacks.
_SPACES = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_NOTHING = r"\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{1D173}-\x{1D17A}\x{E0000}-\x{E01EF}"
_COMPAT = r"\x{17F}\x{132}\x{133}\x{13F}\x{140}\x{149}\x{1C4}-\x{1CC}\x{1F1}-\x{1F3}\x{340}\x{341}\x{343}\x{374}\x{37E}\x{387}\x{1F71}-\x{1FFD}\x{2024}\x{2100}-\x{214F}\x{2160}-\x{217F}\x{2E80}-\x{2FD5}\x{3131}-\x{318E}\x{F900}-\x{FAFF}\x{FB00}-\x{FDFF}\x{FE52}\x{FE70}-\x{FEFC}\x{FF0E}\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{FF61}\x{FF66}-\x{FFDC}\x{1D400}-\x{1D7FF}\x{1EE00}-\x{1EEFF}\x{2F800}-\x{2FA1D}"
_MARKS = r"\p{M}\x{1161}-\x{11FF}"


def _inside(o: int, ranges: str) -> bool:
    spans = [re.fullmatch(r"\\x\{(\w+)\}(?:-\\x\{(\w+)\})?", p) for p in re.findall(r"\\x\{\w+\}(?:-\\x\{\w+\})?", ranges)]
    return any(int(m[1], 16) <= o <= int(m[2] or m[1], 16) for m in spans)


#: What the properties add to the blocks above.
_COMPAT += _ranges([o for o in _UNSTABLE_POINTS if not _inside(o, _COMPAT)], r"\x{%X}")
QUICK = rf"[{_SPACES}{_NOTHING}{_COMPAT}{_MARKS}]"
# Alphabets, and what a value with letters of two of them has: Cyrillic beside Latin or ideographs, or Greek letters that don't stand alone.
_LATIN, _GREEK, _CYRILLIC = r"A-Za-z\x{C0}-\x{24F}\x{1E00}-\x{1EFF}\x{2C60}-\x{2C7F}", r"\x{370}-\x{3FF}\x{1F00}-\x{1FFF}", r"\x{400}-\x{52F}\x{A640}-\x{A69F}"
_IDEOGRAPHS = r"\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{31FFF}"
# Letters of alphabets that only matter inside Latin words.
_RARE = r"\x{251}\x{261}\x{531}-\x{587}\x{13A0}-\x{13FF}"
GREEK_INSIDE = rf"[{_GREEK}][{_GREEK}{_LATIN}{_CYRILLIC}]|[{_LATIN}{_CYRILLIC}][{_GREEK}]"

_PY_NOTHING = re.compile(f"({_SEEN})|[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", _NOTHING) + "]")
_PY_SPACES = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", _SPACES) + "]")
_PY_COMPAT = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", _COMPAT) + "]")


@lru_cache(maxsize=8192)
def _ordinary(ch: str) -> str:
    """The ordinary character(s) a double stands for, else the character itself in composed form."""
    composed = unicodedata.normalize("NFC", ch)
    tag = unicodedata.decomposition(ch).partition(" ")[0]
    if composed != ch or (tag.startswith("<") and tag not in _DOUBLE):
        return composed
    to = unicodedata.normalize("NFKC", ch)
    plain = to != ch and all(c.isalnum() and not 0x370 <= ord(c) < 0x400 for c in to)
    return to if plain else ch


def _script(ch: str) -> str:
    o = ord(ch)
    if not ch.isalpha():
        return ""
    if o < 0x2B0 or 0x1E00 <= o < 0x1F00 or 0x2C60 <= o < 0x2C80:
        return "L"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G"
    if 0x531 <= o < 0x588 or 0x13A0 <= o < 0x1400:
        return "A" if o < 0x588 else "K"
    return "C" if 0x400 <= o < 0x530 or 0xA640 <= o < 0xA6A0 else "H" if 0x2E80 <= o < 0xA000 or 0x20000 <= o < 0x32000 else ""


def _scripts(word: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for ch in word:
        if s := _script(ch):
            out[s] = out.get(s, 0) + 1
    return out


def _folded(word: str, to: str) -> str | None:
    """The word in alphabet `to`, None if a letter of another one has no look-alike there."""
    out = []
    for ch in word:
        s = _script(ch)
        if s and s != to:
            ch = _FOLD.get((s, to), {}).get(ch)
            if ch is None:
                return None
        out.append(ch)
    return "".join(out)


_ROMAN = re.compile(r"[IVXLCDMivxlcdm]+")


def _own_alphabet(word: str) -> str:
    """A word of several alphabets in the one of them that all its letters have."""
    scripts = _scripts(word)
    fits = [(s, f) for s in scripts if (f := _folded(word, s)) is not None]
    if not fits:
        return word
    # a word that fits several alphabets is Latin: the look-alikes are the shapes of Latin letters
    return max(fits, key=lambda x: (x[0] == "L", scripts[x[0]]))[1]


def _alphabets(text: str) -> str:
    words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
    spliced, at, cast = [], 0, []
    for a, b, w in words:
        if len(_scripts(w)) > 1:
            w = _own_alphabet(w)
        if any(c in PHONETIC for c in w) and sum(c.isascii() for c in w) >= 3 and all(c.isascii() or c in PHONETIC for c in w):
            w = "".join(PHONETIC.get(c, c) for c in w)
        cast.append((a, b, w))
    # the alphabet of the text: that of the words that can't be read in another one
    counts: dict[str, int] = {}
    loose = []
    for k, (_, _, w) in enumerate(cast):
        own = next(iter(_scripts(w)), "")
        other = [t for t in "LC" if t != own and _folded(w, t) is not None] if own else []
        if other:
            loose.append((k, own))
        elif own:
            counts[own] = counts.get(own, 0) + len(w)
    han = sum(_script(c) == "H" for c in text)
    if not counts and not han:
        for k, own in loose:
            counts[own] = counts.get(own, 0) + len(cast[k][2])
    main = max(counts, key=lambda s: counts[s]) if counts else "L"
    for k, own in loose:
        a, b, w = cast[k]
        strange = own != main and main in ("L", "C") and len(_scripts(w)) == 1
        if strange and own == "G" and len(w) == 1:
            strange = False  # a symbol standing alone
        if strange and own == "L" and (len(w) < 3 or _ROMAN.fullmatch(w)):
            strange = False  # numbers and letters of appendices are Latin in every alphabet
        if strange and (to := _folded(w, main)) is not None:
            cast[k] = (a, b, to)
    for a, b, w in cast:
        spliced += [text[at:a], w]
        at = b
    spliced.append(text[at:])
    return "".join(spliced)


def canonical(text: str) -> str:
    """The consistent form of one text; canonical(canonical(x)) == canonical(x)."""
    for _ in range(4):
        out = _PY_NOTHING.sub(lambda m: m[1] or "", text)
        out = _PY_SPACES.sub(" ", out)
        out = _PY_COMPAT.sub(lambda m: _ordinary(m[0]), out)
        out = _HALF_MARKS.sub(lambda m: "\u3099" if m[0] == "\uff9e" else "\u309a", out)
        out = _NUMBER_STOP.sub(r"\1.", out)
        if not out.isascii():
            out = _MARKED.sub(lambda m: unicodedata.normalize("NFC", m[0]), out)
            out = _alphabets(out)
        if out == text:
            break
        text = out
    return text


def is_unstable(text: Column) -> Column:
    """Quick check: false for values that are surely in the form, true for those that have to be looked at."""
    beyond = text.rlike(r"[^\x00-\x7F]")
    two = text.rlike(f"[{_CYRILLIC}]") & text.rlike(f"[{_LATIN}{_IDEOGRAPHS}]")
    rare = text.rlike(f"[{_RARE}]") & text.rlike("[A-Za-z]")
    return (beyond & (text.rlike(QUICK) | two | rare | text.rlike(GREEK_INSIDE))) | text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else canonical(t))


def normalize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with each named text column in the consistent form and a boolean <column>_changed beside it.

    Nulls stay null and are not changed; the empty text is in form. A <column>_changed that df has already is replaced. All
    other columns pass unchanged. Only unstable values are sent to Python; the others go as nulls.
    """
    for c in columns:
        formed = _canonical(F.when(is_unstable(F.col(c)), F.col(c)))
        df = df.withColumn("_formed", formed)
        df = df.withColumn(f"{c}_changed", F.col("_formed").isNotNull() & (F.col("_formed") != F.col(c)))
        df = df.withColumn(c, F.coalesce("_formed", c)).drop("_formed")
    return df


def cases(df: DataFrame, row_id: str, columns: Sequence[str], source: str) -> DataFrame:
    """(src_table, row_id, field_name): the values that are not in the consistent form, a row per value."""
    pairs = F.array_compact(F.array(*[F.when(is_unstable(F.col(c)), F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text"))) for c in columns]))
    doubtful = df.select(F.col(row_id).alias("row_id"), F.inline(pairs))
    return doubtful.where(_canonical("text") != F.col("text")).select(F.lit(source).alias("src_table"), "row_id", "field_name")

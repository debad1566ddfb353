"""Text that was decoded with the wrong encoding: find it, and restore it where that is possible.

Round-trip repair: a text is encoded again under a candidate legacy encoding and decoded strictly as the intended one; this
is done for the segments that can come from such an error only, so a title that is garbled in part is repaired in part. Of all
candidates the one with the lowest garbling cost counts, and only if the cost drops; the result may be garbled
again, so the step repeats until no cost drops any more. A text counts as restored only if each step can be undone exactly, what comes out is in
order, and no other candidate in another script is as good; scripts that the correct texts of the same column have go first. The cost knows no words of any language: it charges what correct text lacks, such as control
and replacement characters, box drawing, symbols or capitals inside words, and ideographs that are rare or stuck into
Latin words. Texts that have nothing but ordinary letters in their ordinary places are passed by on the JVM side.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What the cost must drop by for a candidate to be taken, and what a candidate weighs that isn't UTF-8.
UTF8_DROP, OTHER_DROP, OTHER_HANDICAP = 0.35, 1.0, 0.5
#: Cost from which a text isn't in order yet, and by which the best candidate has to be ahead of one in another script.
IN_ORDER, MARGIN = 1.0, 1.0
# Encodings that texts are read in by mistake, and those they were written in.
READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "cp866", "iso8859_15", "gbk", "big5", "shift_jis")
WRITTEN_IN = {
    "utf-8": READ_AS,
    "gbk": ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r"),
    "cp1251": ("cp1252", "mac_roman", "cp437", "cp850", "koi8_r", "cp866"),
    "koi8_r": ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp866"),
    "cp866": ("cp1252", "cp1251", "koi8_r"),
    "iso8859_5": ("cp1252", "cp1251", "koi8_r"),
    "cp1252": ("cp437", "cp850", "cp1251", "mac_roman"),
    "cp1253": ("cp1252", "mac_roman", "cp437", "cp1251"),
    "cp1254": ("cp1252",),
    "cp1255": ("cp1252", "mac_roman", "cp437", "cp1251"),
    "cp1256": ("cp1252", "mac_roman", "cp437", "cp1251"),
    "big5": ("cp1252",),
    "shift_jis": ("cp1252", "mac_roman"),
    "euc_jp": ("cp1252",),
    "euc_kr": ("cp1252",),
}
_MANY = ("gbk", "big5", "shift_jis", "euc_jp", "euc_kr")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_HIGH = re.compile(r"[^\x00-\x7f]+")


@lru_cache(maxsize=None)
def _to_byte(encoding: str) -> dict[str, bytes]:
    """Character -> byte of a one-byte encoding; bytes it leaves open are taken as control characters, as decoders do."""
    out = {}
    for b in range(128, 256):
        try:
            ch = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            ch = chr(b)
        out.setdefault(ch, bytes([b]))
    return out


def _bytes(run: str, encoding: str) -> bytes | None:
    if encoding in _MANY:
        try:
            return run.encode(encoding)
        except UnicodeEncodeError:
            return None
    table = _to_byte(encoding)
    out = []
    for ch in run:
        b = table.get(ch)
        if b is None:
            if encoding != "cp1252" or not 0x80 <= ord(ch) < 0x100:
                return None
            b = bytes([ord(ch)])
        out.append(b)
    return b"".join(out)


@lru_cache(maxsize=65536)
def _holds(ch: str, encoding: str) -> bool:
    return _bytes(ch, encoding) is not None


@lru_cache(maxsize=256)
def _runs(text: str, encoding: str) -> tuple[tuple[int, int, bytes], ...]:
    """Where the text has non-ASCII characters that the encoding can hold, with their bytes."""
    out = []
    for m in _HIGH.finditer(text):
        start = None
        for i in range(m.start(), m.end() + 1):
            ok = i < m.end() and _holds(text[i], encoding)
            if ok and start is None:
                start = i
            elif not ok and start is not None:
                out.append((start, i, _bytes(text[start:i], encoding)))
                start = None
    return tuple(out)


def _decoded(raw: bytes, encoding: str, many: bool) -> str | None:
    try:
        text = raw.decode(encoding)
        return text if encoding == "utf-8" or text.encode(encoding) == raw else None
    except UnicodeError:
        if encoding != "utf-8":
            return None
    # strict by sequence: whole ones are decoded, bytes between them stay lost
    hits = list(_UTF8.finditer(raw))
    if not hits or 2 * sum(m.end() - m.start() for m in hits) < len(raw):
        return None
    out, at = [], 0
    for m in hits:
        out += ["�" * (m.start() > at), m[0].decode("utf-8", "replace")]
        at = m.end()
    return "".join(out) + "�" * (at < len(raw))


@lru_cache(maxsize=None)
def _sequence(read_as: str) -> re.Pattern:
    """What every text has whose UTF-8 bytes were read in a one-byte encoding: a character of a leading byte before one of a trailing byte."""
    of = {b: ch for ch, raw in _to_byte(read_as).items() for b in raw}
    if read_as == "cp1252":
        of = {b: of.get(b, "") + chr(b) for b in range(128, 256)}
    part = lambda lo, hi: re.escape("".join(of.get(b, "") for b in range(lo, hi)))
    return re.compile(f"[{part(0xC2, 0xF5)}][{part(0x80, 0xC0)}]")


def recoded(text: str, read_as: str, written_in: str) -> str | None:
    """The text with each segment that can be one decoded as intended, None if there is no such segment."""
    if written_in == "utf-8" and read_as not in _MANY and not _sequence(read_as).search(text):
        return None
    out, at, changed = [], 0, False
    for a, b, raw in _runs(text, read_as):
        if written_in in _MANY and len(raw) % 2 and b < len(text) and "@" <= text[b] <= "~":
            new = _decoded(raw + text[b].encode(), written_in, True)
            b += new is not None
        else:
            new = _decoded(raw, written_in, read_as in _MANY)
        if new is None or new == text[a:b]:
            continue
        out += [text[at:a], new]
        at, changed = b, True
    return "".join(out) + text[at:] if changed else None


_COMMON_SYMBOLS = "§°²³€£±×©®™¹½¼¾µ¥¢№"
_QUOTES = "–—‘’‚“”„…·«»•‹›¡¿†‡‰"
_RUSSIAN = "абвгдежзийклмнопрстуфхцчшщъыьэюяё"
_RARE_RUSSIAN = "фщъэцюжшхФЩЪЭЦЮЖШХ"
_SLAVIC = "іїєґўІЇЄҐЎ"
_ALPHABETIC = "aAlUcCkK"
_CP437_MATH = "⌐¬⌠⌡≡≥≤≈∙√ⁿ∞∩∂∑∏π∫Ω≠◊ˇ˘˙˚˝˛ıˆ˜ﬁﬂ⁄"


@lru_cache(maxsize=65536)
def _class(ch: str) -> str:
    o = ord(ch)
    if o < 128:
        return "a" if ch.islower() else "A" if ch.isupper() else "d" if ch.isdigit() else "s" if ch.isspace() else "p" if o > 31 else "z"
    if ch == "�":
        return "f"
    if o < 0xA0:
        return "z"
    if ch in _COMMON_SYMBOLS:
        return "y"
    if ch in _QUOTES or 0x3001 <= o <= 0x303F or 0xFF00 <= o < 0xFF60:
        return "q"
    if ch == "\xa0":
        return "n"
    if 0x4E00 <= o < 0xA000:
        try:
            return "h" if ch.encode("gb2312")[0] < 0xD8 else "H"
        except UnicodeEncodeError:
            return "x"
    if ch in _CP437_MATH or 0x2500 <= o < 0x2600:
        return "b"
    if 0xAD < o < 0x250 and ch.isalpha() and ch not in "ªº":
        return "l" if ch.islower() else "U"
    if 0x370 <= o < 0x400:
        return "g"
    if 0x400 <= o < 0x530:
        return "c" if ch in _RUSSIAN else "C" if ch.lower() in _RUSSIAN else "k" if ch in _SLAVIC else "K"
    kind = unicodedata.category(ch)
    if kind in ("Co", "Cn", "Cs"):
        return "v"
    if kind[0] == "M":
        return "m"
    if 0xFF61 <= o < 0xFFA0 or 0x3400 <= o < 0x4E00 or o > 0x20000 or 0x2E80 <= o < 0x3000:
        return "x"
    return "w" if kind[0] in "LN" else "y" if o < 0x100 else "t"


def cost(text: str) -> float:
    """How garbled a text looks; 0 for ordinary text of any language."""
    classes = "".join(map(_class, text))
    total = 0.0
    last = len(classes) - 1
    word = ""  # class of the first letter of the Cyrillic word at hand
    high = 0  # length of the run of non-ASCII Latin letters
    for i, c in enumerate(classes):
        p = classes[i - 1] if i else "s"
        n = classes[i + 1] if i < last else "s"
        high = high + 1 if c in "lU" else 0
        if c not in "cCkK":
            word = ""
        elif not word:
            word = c
        if c in "aAdsp":
            continue
        if c == "f":
            total += 6
        elif c in "zv":
            total += 4
        elif c == "b":
            total += 2.5
        elif c == "m":
            total += 2 if p not in "aAlUcC" else 0.5
        elif c == "y":
            fine = (text[i] in "²³°¹" and p in "aAdcCs" and n in "spdqh") or (p in "sdpqh" and n in "sdpqaA")
            total += 0.2 if fine else 2
        elif c == "t":
            total += 0.3 if p in "sp" and n in "sp" else 1.5
        elif c == "n":
            total += 0.2 if p not in "lUyzbgK" else 1.5
        elif c == "q":
            inside = p in _ALPHABETIC and n in _ALPHABETIC and text[i] not in "’‘–—·…"
            total += 1.5 if inside or p in "UyzKb" or n in "Uyzb" and p in "lU" or n == "f" else 0.05 if p not in "lk" or text[i] in "’”»…·–" else 0.6
        elif c == "l":
            if high > 2 or p in "dyzbK" or n in "yzbK":
                total += 1.5
            else:
                total += 0.1 if p in "aA" or n in "aA" else 0.3 if p in "sp" and n in "sp" else 0.8
        elif c == "U":
            if high > 2 or p in "adlyzbK" or n in "yzbqK":
                total += 1.5
            else:
                total += 0.1 if n in "aA" or p == "A" else 0.3 if p in "sp" and n in "sp" else 1.2
        elif c == "c":
            total += (0.1 if text[i] in _RARE_RUSSIAN else 0) + (1.5 if p in "aAyzbqlU" and text[i - 1] not in "«„“(" else 0)
        elif c == "C":
            total += (0.1 if text[i] in _RARE_RUSSIAN else 0) + (1.5 if p == "c" else 1 if word == "c" else 0) + (1.5 if p in "aAyzblU" else 0)
        elif c == "k":
            total += 0.4 if p in "cCk" or n in "cCk" else 1
        elif c == "K":
            total += 1.2
        elif c == "g":
            total += 1.5 if p == "g" and text[i].isupper() and text[i - 1].islower() else 0
            total += 1.5 if p in "byzlUxh" and p != "h" or n in "byzlU" or p == "a" else 0
        elif c == "w":
            total += 2.5 * ((p in "aAlUcC") + (n in "aAlUcC"))
        elif c in "hHx":
            total += {"h": 0, "H": 0.6, "x": 1.2}[c] + (2 if p == "a" or n == "a" else 0)
    return total


#: Scripts whose encodings take each other's bytes.
EAST = frozenset(["CJK", "KANA", "HANGUL"])
#: A word that is no ASCII at all, as a text in another alphabet leaves behind when it is read in a one-byte encoding.
_WHOLE_WORD = re.compile(r"(?<![A-Za-z])[^\x00-\x7f]{2,}(?![A-Za-z])")
_NEEDS_WORDS = ("cp1253", "cp1255", "cp1256", "iso8859_5", "big5", "shift_jis", "euc_jp", "euc_kr")


def _better(text: str, now: float, utf8: bool) -> Iterator[tuple[float, str]]:
    """(cost, recoded form) of the recodings as UTF-8, or as anything else, whose cost is lower by enough.

    A valid UTF-8 sequence is evidence in itself; the other encodings decode nearly anything, so they have to do more.
    """
    words = not utf8 and _WHOLE_WORD.search(text) is not None
    for written, wrongs in WRITTEN_IN.items():
        if utf8 != (written == "utf-8") or (written in _NEEDS_WORDS and not words):
            continue
        for read in wrongs:
            new = recoded(text, read, written)
            if new is None or new == text:
                continue
            c = cost(new)
            if now - c > UTF8_DROP if utf8 else now - c > OTHER_DROP and c < 0.5 * now:
                yield c + (not utf8) * OTHER_HANDICAP, new


def scripts(text: str) -> dict[str, int]:
    """How many non-ASCII letters of each alphabet a text has."""
    counts: dict[str, int] = {}
    for ch in text:
        if not ch.isascii() and ch.isalpha():
            name = unicodedata.name(ch, "?").partition(" ")[0].partition("-")[0]
            name = {"HIRAGANA": "KANA", "KATAKANA": "KANA"}.get(name, name)
            counts[name] = counts.get(name, 0) + 1
    return counts


def script(text: str) -> str:
    """The alphabet most of a text's non-ASCII letters are of; Latin if it has none."""
    counts = scripts(text)
    if "KANA" in counts:
        counts["KANA"] += counts.pop("CJK", 0)
    return max(counts, key=lambda k: (counts[k], k)) if counts else "LATIN"


def _peeled(seen: dict[str, tuple[float, int, bool]], front: list[str]) -> None:
    """Adds all that UTF-8 layers lead to from the texts of `front`. Every layer lowers the cost, so this ends by itself."""
    while front:
        found = []
        for t in front:
            now, layers, pure = seen[t]
            for c, new in _better(t, now, True) if now > UTF8_DROP else ():
                if new not in seen or c < seen[new][0]:
                    seen[new] = (c, layers + 1, pure)
                    found.append(new)
        front = list(dict.fromkeys(found))


def candidates(text: str) -> dict[str, tuple[float, int, bool]]:
    """Texts that recoding leads to: text -> (cost, layers, UTF-8 at every layer), the text itself among them.

    UTF-8 layers are followed wherever they lead. Where they don't lead to a text in order, one layer of another encoding is tried on
    every text so far, and UTF-8 again behind it.
    """
    seen = {text: (0.0 if text.isascii() else cost(text), 0, True)}
    _peeled(seen, [text])
    if min(c for c, _, _ in seen.values()) > IN_ORDER or (len(seen) == 1 and seen[text][0] > OTHER_DROP):
        found = []
        for t, (now, layers, _) in list(seen.items()):
            for c, new in _better(t, now, False) if now > OTHER_DROP else ():
                if new not in seen or c < seen[new][0]:
                    seen[new] = (c, layers + 1, False)
                    found.append(new)
        _peeled(seen, list(dict.fromkeys(found)))
    return seen


def repair(text: str, home: frozenset[str] = frozenset()) -> tuple[str, int, bool]:
    """(text as far as it can be restored, layers of wrong decoding taken off, whether that is the original text).

    `home`: the scripts of correct texts around it.
    """
    seen = candidates(text)
    ranked = sorted(seen, key=lambda t: (seen[t][0], seen[t][1], t))
    best = ranked[0]
    at_home = [t for t in ranked if seen[t][1] and script(t) in home and seen[t][0] <= seen[best][0] + MARGIN]
    if at_home and not seen[best][2]:
        best = at_home[0]
    c, layers, pure = seen[best]
    mine = script(best)
    near = MARGIN / 2 if mine in home else MARGIN
    rivals = {script(t) for t in ranked if seen[t][1] and not seen[t][2] and seen[t][0] <= c + near} - {mine}
    others = scripts(best).keys() - {"LATIN", "GREEK", "MICRO"}
    one = len(others) < 2 or others == {"KANA", "CJK"}
    # Icelandic and Turkish letters share their places
    one = one and not any(x in "ðýþÐÝÞ" for x in best)
    if not pure and mine in EAST:
        # the same bytes are text in several encodings of East Asia: only the texts around it can tell
        one = one and mine == "CJK" and home & EAST == {"CJK"}
    sure = one and c - (not pure) * OTHER_HANDICAP <= IN_ORDER and (pure or not (rivals & home if mine in home else rivals))
    return best, layers, sure


def examine(text: str | None, home: frozenset[str] = frozenset()) -> tuple[bool, str | None, int]:
    """(garbled, restored text or None, layers). Null and ASCII texts are never garbled."""
    if text is None or text.isascii():
        return False, None, 0
    new, layers, sure = repair(text, home)
    lost = any(_class(c) in "fzv" for c in new)
    return layers > 0 or lost, new if layers and sure and not lost else None, layers


_RESULT = T.StructType([T.StructField("garbled", T.BooleanType()), T.StructField("restored", T.StringType()), T.StructField("layers", T.IntegerType())])


def _examined(text: Column, home: frozenset[str]) -> Column:
    @F.pandas_udf(_RESULT)
    def result(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([examine(t, home) for t in texts], columns=["garbled", "restored", "layers"])

    return result(text)


# Letters and marks that correct titles of many languages have; garbled ones have others, or these where they don't belong.
_SAFE = r"\x00-\x7Fà-öø-ÿœßÀ-ÂÄÇ-ÏÑ-ÖØ-ÝŒА-яЁё\x{3400}-\x{9FFF}“”„’–—…·：，（）。？！、；《》①-⑳²³°αβ§«»€£"
_ODD_PLACE = (
    r"[À-ÿœŒ]{2}|[a-z0-9à-ÿ][À-ÞŒ]|[À-ÞŒ](?![A-Za-zÀ-Þ’ ])|[0-9А-я][à-ÿ]|[а-яё][А-ЯЁ]|[A-Za-zÀ-ÿ][А-яЁё]|[А-яЁё][A-Za-zÀ-ÿ]|[a-zà-ÿ][\x{3400}-\x{9FFF}]|[\x{3400}-\x{9FFF}][a-zà-ÿ]"
    r"|[А-яЁё][§°€£«„“]|[“”„’–—…·«»€£°§²³][À-ÿœŒ]|[À-ÿœŒ][“”„‘…·«€£°§³]|[ÂÃâÐÑŽ][–—’]|(?U)\b[а-яё]+\b(?=.*[А-ЯЁ]{3})|(?U)\b[а-яё][А-ЯЁ]"
)
#: Ideographs that take the place of letters and ideographs in UTF-8 read in an encoding of many bytes and that correct text hardly has.
_STRAY = "".join(
    dict.fromkeys(
        ch for encoding in ("gbk", "big5", "shift_jis") for lead in (*range(0xC2, 0xDF), *range(0xE3, 0xEA), 0xEF) for trail in range(0x80, 0xC0)
        if (lead >= 0xE3 or encoding == "gbk" and trail < 0xA1 or encoding == "big5" and lead >= 0xC9) and len(ch := bytes([lead, trail]).decode(encoding, "ignore")) == 1 and ch > "\u2fff"
    )
)


def doubtful(text: Column) -> Column:
    """JVM-side: false for texts that are surely not garbled, true for those that have to be looked at."""
    stray = F.translate(text, _STRAY, "") != text
    return text.rlike(r"[^\x00-\x7F]") & (text.rlike(f"[^{_SAFE}]") | text.rlike(_ODD_PLACE) | stray)


#: Share of a column's correct texts that have a script from which it is one of theirs.
HOME = 0.005
# Scripts by regular expression, named as in Unicode.
_SCRIPTS = {"LATIN": r"[\x{C0}-\x{24F}]", "CJK": r"[\x{3400}-\x{9FFF}]", "KANA": r"[\x{3041}-\x{30FF}]", "CYRILLIC": r"[\x{400}-\x{4FF}]", "GREEK": r"[\x{370}-\x{3FF}]{3}", "ARABIC": r"[\x{600}-\x{6FF}]", "HEBREW": r"[\x{590}-\x{5FF}]", "HANGUL": r"[\x{AC00}-\x{D7A3}]"}


def home_scripts(df: DataFrame, column: str) -> frozenset[str]:
    """The scripts of the column's texts that are surely not garbled, from counts over all rows: one row of sums reaches the driver."""
    text = F.col(column).cast("string")
    fine = df.where(text.rlike(r"[^\x00-\x7F]") & ~doubtful(text))
    counts = fine.agg(F.count(F.lit(1)).alias("all"), *[F.count_if(text.rlike(p)).alias(n) for n, p in _SCRIPTS.items()]).collect()[0]
    return frozenset(n for n in _SCRIPTS if counts[n] and counts[n] >= HOME * counts["all"])


def found(df: DataFrame, row_id: str, column: str, home: frozenset[str] | None = None) -> DataFrame:
    """(row_id, text, restored, layers): the garbled texts, `restored` null where something is lost for good or more than one original is possible.

    Null, empty and ASCII texts are never garbled; repeated rows count each; other columns are not read. `home` is `home_scripts` by default.
    """
    home = home_scripts(df, column) if home is None else home
    looked_at = df.select(F.col(row_id).alias("row_id"), F.col(column).alias("text")).where(doubtful(F.col("text")))
    return looked_at.withColumn("r", _examined(F.col("text"), home)).where("r.garbled").select("row_id", "text", F.col("r.restored").alias("restored"), F.col("r.layers").alias("layers"))


def restore(df: DataFrame, column: str) -> DataFrame:
    """df with `column` restored where possible, and booleans <column>_garbled and <column>_restored beside it."""
    out = df.withColumn("_r", _examined(F.when(doubtful(F.col(column)), F.col(column)), home_scripts(df, column)))
    out = out.withColumn(f"{column}_garbled", F.coalesce("_r.garbled", F.lit(False))).withColumn(f"{column}_restored", F.col("_r.restored").isNotNull())
    return out.withColumn(column, F.coalesce("_r.restored", column)).drop("_r")

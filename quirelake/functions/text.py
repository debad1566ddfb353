"""Column functions on titles, page labels and numbers.

Everything runs JVM-side but compatibility normalization and case folding, which Spark lacks; only values with
characters outside ASCII are sent to Python for them. Nulls give null throughout.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of headings, page labels and numbers, in the regular expressions of Java.
HAN = r"\x{3400}-\x{9FFF}"
HAN_NUMBER = "一二三四五六七八九十百零〇0-9"
PART = rf"^(?iU)(?:第\s*[{HAN_NUMBER}]+\s*[篇部卷]|parts?\s+(?:[ivxlcdm]+|\d+)\b)"
CHAPTER = rf"^(?iU)(?:第\s*[{HAN_NUMBER}]+\s*章|chapters?\s+\d+|附录|appendix)"
NAMED_CHAPTER = rf"^(?iU)(?:第\s*[{HAN_NUMBER}]+\s*章|chapters?\s+\d+)"
NUMBERED = r"^(?U)(?:[*＊]\s*)?(?:§\s*)?(\d{1,3}(?:\s*[.．]\s*\d{1,3}){0,5})(?:\s*[.．、](?!\d))?(?![\d.．])\s*"
APPENDIX = r"^(?iU)(?:附录|appendix\b)"
ROMAN_HEADING = r"^(?U)[IVX]{1,6}\s*[.．、:]?\s+(?=\p{L})"
CHAPTER_NUMBER_HAN = r"^(?U)第\s*([一二三四五六七八九十百零〇两]+|\d{1,3})\s*章"
CHAPTER_NUMBER_LATIN = r"^(?iU)chapters?\s+(\d{1,3})"
CHAPTER_END_ITEM = r"^(?U)第\s*[一二三四五六七八九十百零〇两0-9]+\s*章\s*(?:小结|总结|复习|习题|练习|思考题|提要|要点|回顾)"
CHAPTER_END = r"^(?:本章|章末)"
BOOK_BOUNDARY = r"^(?iU)(?:附录|索引|后记|前言|序言|致谢|appendix\b|index\b|afterword\b|preface\b|acknowledg\w*\b)"
ARABIC_LABEL = r"^[\s\[(（—–-]*([0-9]{1,4})[\s\])）—–-]*$"
ROMAN_LABEL = r"^(?i)[\s\[(（—–-]*([ivxlcdm]{1,8})[\s\])）—–-]*$"
HAN_COUNT = "[一二三四五六七八九十百千万零〇○两]+"
PAGE_TITLE = (
    r"^(?i)[\divxlcdm.·…\-–—_/]+$",
    rf"^{HAN_COUNT}$",
    rf"^第?(?:\d+|{HAN_COUNT})[页頁](?:[/／]共?(?:\d+|{HAN_COUNT})[页頁])?$",
    r"^(?i)(?:pages?|pp?)\.?(?:no\.?)?\d+(?:of\d+)?$",
)
ROMAN_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
HAN_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
CONTENTS_KEYS = ("目录", "目次", "contents", "tableofcontents")
#: White space as Unicode has it.
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def _casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t.casefold())


def _python_if_needed(text: Column, function) -> Column:
    return F.coalesce(function(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def nfkc(text: Column) -> Column:
    return _python_if_needed(text, _nfkc)


def casefold(text: Column) -> Column:
    return F.coalesce(_casefold(F.when(text.rlike(r"[^\x00-\x7F]"), text)), F.lower(text))


def clean_text(text: Column) -> Column:
    """Compatibility form, one kind of dots and ellipses, no spaces between ideographs, before stops or inside dot leaders."""
    out = F.translate(nfkc(text), "⋯·•", "…..")
    for pattern, to in (
        (rf"(?<=[{HAN}]){SPACE}+(?=[{HAN}])", ""),
        (rf"{SPACE}+([，。；：、.])", "$1"),
        (rf"([.。]){SPACE}+(?=[.。])", "$1"),
        (rf"^{SPACE}+|{SPACE}+$", ""),
    ):
        out = F.regexp_replace(out, pattern, to)
    return out


def roman_to_int(text: Column) -> Column:
    """From the right, a value below the largest one so far counts negative. Not checked for well-formed numbers."""
    letter = F.create_map(*[F.lit(x) for kv in ROMAN_VALUES.items() for x in kv])
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top"))

    def step(acc: Column, ch: Column) -> Column:
        v = F.coalesce(F.try_element_at(letter, ch), F.lit(0))
        return F.struct((acc["sum"] + F.when(v < acc["top"], -v).otherwise(v)).alias("sum"), F.greatest(acc["top"], v).alias("top"))

    letters = F.split(F.reverse(F.lower(text)), "")
    return F.when(text.isNotNull(), F.aggregate(letters, start, step)["sum"])


def chinese_number(text: Column) -> Column:
    """Digits, or a number up to hundreds; a unit without a digit counts once. Other characters give null."""
    digit = F.create_map(*[F.lit(x) for kv in HAN_DIGITS.items() for x in kv])
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("now"))

    def step(acc: Column, ch: Column) -> Column:
        unit = F.when(ch == "十", 10).when(ch == "百", 100)
        now = F.try_element_at(digit, ch)
        counted = acc["sum"] + F.when(acc["now"] == 0, 1).otherwise(acc["now"]) * unit
        return F.struct(F.coalesce(counted, acc["sum"]).alias("sum"), F.when(unit.isNotNull(), 0).otherwise(F.coalesce(now, acc["now"])).alias("now"))

    read = F.aggregate(F.split(text, ""), start, step, lambda a: a["sum"] + a["now"])
    return F.when(text.rlike(r"^\d{1,9}$"), text.try_cast("int")).when(text.rlike(f"^[{''.join(HAN_DIGITS)}十百]+$"), read)


def page_label(text: Column) -> Column:
    """struct<numbering, value> of a whole text that is a printed page label, else null; brackets and dashes may surround it."""
    t = clean_text(text)
    arabic = F.regexp_extract(t, ARABIC_LABEL, 1).try_cast("int")
    roman = F.regexp_extract(t, ROMAN_LABEL, 1)
    is_arabic = t.rlike(ARABIC_LABEL)
    return F.when(is_arabic & (arabic > 0), F.struct(F.lit("arabic").alias("numbering"), arabic.alias("value"))).when(
        ~is_arabic & (roman != ""), F.struct(F.lit("roman").alias("numbering"), roman_to_int(roman).alias("value"))
    )


def page_value(text: Column) -> Column:
    """struct<numbering, value> of a contents row's page: digits, plain or in round brackets, or a bare Roman number."""
    t = F.regexp_replace(clean_text(text), f"{SPACE}+", "")
    digits = F.coalesce(F.nullif(F.regexp_extract(t, r"^([0-9]+)$", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"^\(([0-9]+)\)$", 1), F.lit("")))
    value = digits.try_cast("int")
    short = F.length(digits) <= 4
    return F.when(short & (value > 0), F.struct(F.lit("arabic").alias("numbering"), value.alias("value"))).when(
        digits.isNull() & t.rlike("^(?i)[ivxlcdm]{1,8}$"), F.struct(F.lit("roman").alias("numbering"), roman_to_int(t).alias("value"))
    )


def _plain_digits(text: Column) -> Column:
    return F.translate(text, "０１２３４５６７８９", "0123456789")


def numbered_parts(title: Column) -> Column:
    """array<int> of a heading's decimal number ("1.2.3", "§ 3", "* 4.4"), else null."""
    number = F.regexp_extract(_plain_digits(title), NUMBERED, 1)
    return F.when(number != "", F.transform(F.split(number, r"(?U)\s*[.．]\s*"), lambda p: p.cast("int")))


def chapter_number(title: Column) -> Column:
    title = _plain_digits(title)
    han, latin = F.regexp_extract(title, CHAPTER_NUMBER_HAN, 1), F.regexp_extract(title, CHAPTER_NUMBER_LATIN, 1)
    return F.when(han != "", chinese_number(han)).when(latin != "", latin.cast("int"))


def row_number_of(title: Column) -> Column:
    n = chapter_number(title)
    return F.coalesce(F.when(n.isNotNull(), F.array(n)), numbered_parts(title))


def follows(before: Column, after: Column) -> Column:
    """Whether `after` is the next decimal number: `before` with ones behind it, or one component raised by 1 and ones behind."""
    ones = lambda a, start: F.forall(F.slice(a, start, F.greatest(F.size(a), F.lit(1))), lambda p: p == 1)
    inside = (F.slice(after, F.lit(1), F.size(before)) == before) & (F.size(after) > F.size(before)) & ones(after, F.size(before) + 1)
    depth = F.least(F.size(before), F.size(after))
    raised = F.exists(
        F.sequence(F.lit(1), depth),
        lambda d: (F.slice(after, F.lit(1), d - 1) == F.slice(before, F.lit(1), d - 1)) & (F.element_at(after, d) == F.element_at(before, d) + 1) & ones(after, d + 1),
    )
    extends = F.slice(after, F.lit(1), F.size(before)) == before
    return F.coalesce(F.when(extends, inside).otherwise(raised), F.lit(False))


def title_key(text: Column) -> Column:
    """A title without its number, in lower-case letters, digits and ideographs only."""
    t = F.lower(clean_text(text))
    t = F.regexp_replace(t, rf"^(?:第\s*[{HAN_NUMBER}]+\s*[章节篇部卷]|\d+(?:\.\d+)*|§\s*\d+)", "")
    return F.regexp_replace(t, f"[^a-z0-9{HAN}]", "")


def compare_key(text: Column) -> Column:
    """A title for comparison of outlines: typography is dropped, numbers and the dots inside them stay."""
    t = casefold(clean_text(text))
    t = F.regexp_replace(t, r"(?<!\d)\.|\.(?!\d)", "")
    return F.regexp_replace(t, f"[^a-z0-9{HAN}.]", "")


def is_page_title(title: Column) -> Column:
    """Whether a bookmark's title only repeats a page label."""
    t = F.regexp_replace(clean_text(title), r"^[()\[\]{}【】（）<>《》]+|[()\[\]{}【】（）<>《》]+$", "")
    t = F.regexp_replace(t, f"{SPACE}+", "")
    out = t == ""
    for p in PAGE_TITLE:
        out = out | t.rlike(p)
    return out


def plain_key(title: Column) -> Column:
    """Letters, digits and underscores of a title in lower case: the identity of a contents row."""
    return F.lower(F.regexp_replace(title, r"[^\p{L}\p{N}_]", ""))

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelake.llm import charform

CASES = [
    ("Ｃｈａｐｔｅｒ １．２", "Chapter 1.2"), ("Oﬃce", "Office"), ("⽔文⽅法", "水文方法"), ("Re\u0301sume\u0301", "Résumé"), ("a\u200bb\u00adc\ufeff", "abc"), ("a\u00a0b\u3000c", "a b c"), ("Dυality", "Duality"), ("Сhарtеr 3", "Chapter 3"),
    ("Vector Ѕрасеѕ in", "Vector Spaces in"), ("Kолебания струны", "Колебания струны"), ("Class Ⅲ Filters", "Class III Filters"), ("4３．５", "43.5"), ("Foreword ііі", "Foreword iii"),
]
STAY = [
    "", "第一章：概述（上），完。", "x² 的展开 ①类曲线", "The α Coefficient", "β-Verteilung", "“Thin” Layers – Revisited’s", "Приложение C Устойчивость", "Часть III", "tab\there……12", "a·b…c", "Глава 1", "naïve Größe", "x̂ hat", "Δt und μm", "8． Kapitel",
    "为什么要取极限？", "Ελληνικά κείμενα", "ＡＢ"[:0],
]


@pytest.mark.parametrize(("text", "form"), CASES)
def test_brought_into_form(text, form):
    assert charform.canonical(text) == form and charform.canonical(form) == form


@pytest.mark.parametrize("text", STAY)
def test_in_form_already(text):
    assert charform.canonical(text) == text


LETTERS = st.text(alphabet="aeЕсоѕυβ１２．. ²①第⽔水é\u0301\u200b\u00a0ﬁⅢ…", max_size=12)


@settings(max_examples=300, deadline=None)
@given(LETTERS)
def test_form_is_stable(text):
    out = charform.canonical(text)
    assert charform.canonical(out) == out
    assert "\u200b" not in out and "\u00a0" not in out and unicodedata.normalize("NFC", out) == out


def test_quick_check_misses_nothing(spark):
    texts = [a for a, _ in CASES] + STAY + ["x" * 50_000 + "\u200b", "ordinary text"]
    df = spark.createDataFrame([(i, t, None, 7) for i, t in enumerate(texts)] + [(999, None, None, 7)], "id long, t string, n string, t_changed int")
    got = {r["row_id"] for r in charform.cases(df, "id", ["t", "n"], "x").collect()}
    assert got == {i for i, t in enumerate(texts) if charform.canonical(t) != t}
    out = {r["id"]: (r["t"], r["t_changed"]) for r in charform.normalize(df, ["t"]).collect()}
    assert all(out[i] == (charform.canonical(t), charform.canonical(t) != t) for i, t in enumerate(texts)) and out[999] == (None, False)
    assert charform.cases(df.where("id < 0"), "id", ["t"], "x").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=8))
def test_quick_check_on_any_text(text):
    import re

    quick = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", charform.QUICK.replace(r"\p{M}", "")))
    if charform.canonical(text) != text:
        marks = any(unicodedata.category(c)[0] == "M" for c in text)
        scripts = {charform._script(c) for c in text} & set("LCG")
        assert marks or quick.search(text) or len(scripts) > 1 or "C" in scripts or "G" in scripts


def test_every_pair_that_has_a_joined_form():
    for o in range(0x80, 0x32000):
        ch = chr(o)
        to = unicodedata.decomposition(ch) if not 0xD800 <= o < 0xE000 else ""
        if to and to[0] != "<":
            pair, composed = "".join(chr(int(x, 16)) for x in to.split()), unicodedata.normalize("NFC", ch)
            forms = {charform.canonical(x) for x in (pair, ch, composed, unicodedata.normalize("NFD", ch))}
            assert len(forms) == 1 and all(unicodedata.normalize("NFC", x) == x for x in forms), hex(o)
    assert charform.canonical("한글") == "한글"


@pytest.mark.parametrize(
    ("text", "form"),
    [("ｶﾞｲﾄﾞ", "ガイド"), ("क़", "क़"), ("क़", "क़"), ("آ", "آ"), ("ো", "ো"), ("Кοэффициент", "Коэффициент"), ("Ꭺbstract", "Abstract"), ("Cοntents օf", "Contents of"), ("Cataloɡue", "Catalogue"),
     ("می‌خواهم", "می‌خواهم"), ("👩‍🔬 ❤️", "👩‍🔬 ❤️"), ("a‍b️", "ab"), ("KK Å", "KK Å"), ("օրենք Մաս", "օրենք Մաս"), ("ᎠᏂᏴᏫᏯ", "ᎠᏂᏴᏫᏯ"), ("q̣̇", "q̣̇")],
)
def test_scripts_beyond_the_common_ones(text, form):
    assert charform.canonical(text) == form and charform.canonical(form) == form

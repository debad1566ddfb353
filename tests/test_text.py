import re
import unicodedata

from pyspark.sql import functions as F

from quirelake.functions import text as X


def one(spark, texts, function):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in df.select("i", function(F.col("t"))).orderBy("i").collect()]


def test_clean_text_like_plain_python(spark):
    def plain(t):
        t = unicodedata.normalize("NFKC", t)
        for a, b in (("⋯", "…"), ("·", "."), ("•", ".")):
            t = t.replace(a, b)
        t = re.sub("(?<=[㐀-鿿])\\s+(?=[㐀-鿿])", "", t)
        t = re.sub(r"\s+([，。；：、.])", r"\1", t)
        return re.sub(r"([.。])\s+(?=[.。])", r"\1", t).strip()

    texts = ["第 一 章", "Ａ １．２", "a . . . b", "x · y • z", "  ﬁn　", "ß²…⋯", "", "tab\there ", "中 文 . 。 。", "plain"]
    assert one(spark, texts, X.clean_text) == [plain(t) for t in texts]
    assert one(spark, [None], X.clean_text) == [None]


def test_numbers(spark):
    assert one(spark, ["iv", "IX", "mcmxc", "iiii", "xlii", ""], X.roman_to_int) == [4, 9, 1990, 4, 42, 0]
    assert one(spark, ["十一", "二十三", "一百零五", "2", "两", "3x", None, "二百"], X.chinese_number) == [11, 23, 105, 2, 2, None, None, 200]
    titles = ["第一章 x", "第十一章", "第二十三章", "第一百零五章", "第2章", "Chapter 7", "chapters 12", "Other", "１.２ x", None]
    assert one(spark, titles, X.chapter_number) == [1, 11, 23, 105, 2, 7, 12, None, None, None]
    numbers = ["1.2.3 x", "§ 3", "* 4.4 x", "１．２ x", "12.5. y", "1234 x", "none", "2 . 3 z", None]
    assert [None if p is None else list(p) for p in one(spark, numbers, X.numbered_parts)] == [[1, 2, 3], [3], [4, 4], [1, 2], [12, 5], None, None, [2, 3], None]


def test_page_labels(spark):
    pair = lambda r: None if r is None else tuple(r)
    texts = ["12", "(12)", "— 7 —", "iv", "（１２）", "0", "12345", "(iv)", "12a", "", None]
    assert [pair(r) for r in one(spark, texts, X.page_label)] == [("arabic", 12), ("arabic", 12), ("arabic", 7), ("roman", 4), ("arabic", 12), None, None, ("roman", 4), None, None, None]
    assert [pair(r) for r in one(spark, texts, X.page_value)] == [("arabic", 12), ("arabic", 12), None, ("roman", 4), ("arabic", 12), None, None, None, None, None, None]


def test_follows(spark):
    cases = [([3, 4], [3, 4, 1], True), ([3, 4], [3, 5], True), ([3, 4], [4], True), ([3, 4], [4, 1], True), ([3, 4, 2], [3, 5], True), ([3, 4], [3, 6], False), ([3, 4], [5, 1], False), ([3, 4], [3, 4], False), ([3, 4], [4, 2], False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a array<int>, b array<int>")
    assert [r[1] for r in df.select("i", X.follows(F.col("a"), F.col("b"))).orderBy("i").collect()] == [c for *_, c in cases]


def test_keys(spark):
    texts = ["第 3 章 Größe 1.2", "1.2 The α-Test!", "Straße 1.10. x …", "§ 4 Ab", None]
    assert one(spark, texts, X.title_key) == ["gre12", "thetest", "strae110x", "ab", None]
    assert one(spark, texts, X.compare_key) == ["第3章grösse1.2".replace("ö", ""), "1.2thetest", "strasse1.10x", "4ab", None]
    labels = ["（第 12 页）", "Page 13", "P.14", "第十五页", "一百零一", "1.2", "绪论", "", "p 3 of 9", "Pages"]
    assert one(spark, labels, X.is_page_title) == [True] * 6 + [False, True, True, False]

import pytest

from quirelake.llm import residue
from quirelake.llm import residue_exemplars as X

PROSE = "The treatment of Heat Flow is brief but careful. All figures are numbered by chapter, so Figure 2.1 stands in the 3rd chapter.\nReaders can go straight to page 12."
HAN = "书中所有图表的编号与章号一致，例如图 1.2 位于第 3 页。为了便于检索，索引按拼音排列，并注明所在页码。"
DOCS = {
    "slot": ["Dear reader, thank you for choosing {{ book.title }}.", PROSE + " Published on <%= year %>.", "内容简介：[object Object]", "《__EDITION__》共12章，由{0}编写。", "This volume of &lt;pages&gt; pages was edited by [Your name].", HAN + "本书的责任编辑为〔待填：作者〕。", "Chère lectrice, merci d’avoir choisi <auteur à compléter>.", "undefined is a careful introduction, now in its 3 edition."],
    "error": ["404 Not Found", "Back to shelf\nHeat Flow\nError 503: this item cannot be displayed right now.\nPlease reload.", "抱歉，该章节没有访问权限，请返回书架。", "<h1>Erreur 404 : la page demandée est introuvable.</h1>", "Ihre Sitzung ist abgelaufen. Bitte melden Sie sich neu an.", "Страница не найдена, код 9f1.", "ACCESS DENIED (9A3F)."],
    "script": ["<noscript>You must turn on scripts for this site before the book can be shown!</noscript>", "您需要打开 JS 脚本，然后使用阅读器。", "Bitte JavaScript aktivieren, um diese Seite anzuzeigen.", "Разрешите скрипты."],
    "filler": [PROSE + "\nLorem ipsum dolor. Velit ipsum commodo magna adipiscing nisi veniam.", "bla bla bla bla", "占位文字，请替换，占位文字，请替换", "Placeholder text goes here", "Platzhalter", "Texte provisoire, contenu à venir"],
    None: [None, "", "   \n", PROSE, HAN, "Text", *[PROSE + " " + m for m in X.lines(X.MENTION) if not residue._HAN.search(m)], *[HAN + m + "。" for m in X.lines(X.MENTION) if residue._HAN.search(m)], "Answer: ______", "x " * 30_000],
}
ALL = [(k, t) for k, texts in DOCS.items() for t in texts]


@pytest.fixture(scope="module")
def table(spark):
    filling = [(1000 + i, (PROSE if i % 2 else HAN) + f" Kapitel {i}.") for i in range(300)]
    return spark.createDataFrame([(i, t) for i, (_, t) in enumerate(ALL)] + filling, "doc_id long, text string").selectExpr("*", "'x' as kind", "1 as row_id")


def test_kinds(table):
    got = {r["row_id"]: r["kind"] for r in residue.judged(table).collect()}
    wrong = [(k, got[i], t and t[:80]) for i, (k, t) in enumerate(ALL) if got[i] != k]
    assert wrong == []
    assert all(got[i] is None for i in got if i >= 1000)


def test_counts_equal_brute_force(table):
    n, counts = residue.count_tokens(table, "text")
    texts = [r["text"] or "" for r in table.collect()]
    words = residue.vocabulary()
    want = {}
    for t in texts:
        found = {w for p in residue.windows(t) for w in [*residue.tokens(p), *residue.endings(p)]} | {w for _, _, p in residue.places(t) for w in p}
        for w in found & words:
            want[w] = want.get(w, 0) + 1
    assert n == len(texts) and all(abs(counts.get(w, 0) - want.get(w, 0)) <= 2 for w in words)


def test_prefix_filter_loses_nothing(table):
    n, counts = residue.count_tokens(table, "text")
    index = residue.build_index(n, counts)
    for _, t in ALL:
        for w in residue.windows(residue.marked(t or "", index.weight)):
            label = residue.label_window(w, index)
            if label not in (None, "around"):
                assert index.reaches(w.casefold().replace("’", "'")), (label, w)


def test_usable_and_empty(table):
    assert residue.usable(table).count() == table.count() - sum(k is not None for k, _ in ALL)
    assert residue.judged(table.where("doc_id < 0")).count() == 0

import pytest

from quirelake.llm import mojibake

TITLES = ["第一章 微分方程的稳定性", "Räumliche Geometrie für Anfänger", "Théorie des graphes – Problèmes résolus", "Глава 5 Линейные уравнения", "§2.1 信号采样", "The Surveyor’s Toolbox"]
CLEAN = [
    *TITLES, "Ærø-målinger", "Price in € and £", "AÇÃO DAS CARGAS", "Żółte kartki", "Các phép đo và sai số", "Ïle et marée", "x² 的展开", "①类曲线", "ГЛАВА 3 УПРУГИЕ БАЛКИ", "À propos de α", "日本語の題名", "한국어 제목", "العربية", "Ελληνικά",
    "®-marked samples", "", "plain", "Площадь в м²", "附录B 表 3…表 9",
]


@pytest.mark.parametrize("text", CLEAN)
def test_correct_titles_are_no_cases(text):
    assert mojibake.examine(text) == (False, None, 0)


@pytest.mark.parametrize("text", TITLES)
@pytest.mark.parametrize("read_as", ["cp1252", "mac_roman", "cp437", "cp1251", "latin-1"])
def test_round_trip(text, read_as):
    raw = text.encode()
    wrong = "".join(chr(b) if read_as == "cp1252" and b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode(read_as, "replace") for b in raw)
    garbled, restored, _ = mojibake.examine(wrong)
    assert garbled
    if "�" not in wrong:
        assert restored == text or read_as == "cp1251"


def test_layers_and_other_encodings():
    twice = "Größe".encode().decode("cp1252").encode().decode("cp1252")
    assert mojibake.examine(twice) == (True, "Größe", 2)
    assert mojibake.examine("习题与思考题".encode("gbk").decode("cp1252"), frozenset(["CJK", "CYRILLIC"]))[1] == "习题与思考题"
    assert mojibake.examine("Линейные уравнения".encode("cp1251").decode("koi8_r"))[1] == "Линейные уравнения"
    assert mojibake.examine("Линейные уравнения".encode("koi8_r").decode("cp1251"))[1] == "Линейные уравнения"
    assert mojibake.examine("W盲rmeleitung f眉r")[1] == "Wärmeleitung für"
    assert mojibake.examine("第1章 " + "分类定理".encode().decode("latin-1"))[1] == "第1章 分类定理"
    assert mojibake.examine("Th�orie") == (True, None, 0)


def test_tables(spark):
    bad = "für".encode().decode("latin-1")
    df = spark.createDataFrame([(1, bad), (2, bad), (3, "für"), (4, None), (5, ""), (6, "x" * 100_000), (7, "Th�orie"), (8, "长" * 20_000)], "node_id long, title string").selectExpr("*", "'a' as restored", "1 as r")
    out = {r["row_id"]: r["restored"] for r in mojibake.found(df, "node_id", "title").collect()}
    assert out == {1: "für", 2: "für", 7: None}
    fixed = {r["node_id"]: (r["title"], r["title_garbled"], r["title_restored"]) for r in mojibake.restore(df, "title").collect()}
    assert fixed[1] == ("für", True, True) and fixed[7] == ("Th�orie", True, False) and fixed[4] == (None, False, False)
    assert mojibake.found(df.where("node_id < 0"), "node_id", "title").count() == 0


# Titles by the encoding they were written in, and the one they were read in.
WRITTEN = {
    "cp1253": "Γραμμικές εξισώσεις και εφαρμογές", "cp1254": "Doğrusal denklemler ve şekiller", "cp1255": "משוואות ליניאריות", "cp1256": "المعادلات الخطية", "cp1251": "Линейные уравнения и задачи", "koi8_r": "Линейные уравнения и задачи",
    "cp866": "Линейные уравнения и задачи", "iso8859_5": "Линейные уравнения и задачи", "gbk": "线性方程与习题", "big5": "線性方程與習題", "shift_jis": "日本の歴史と文化", "euc_jp": "日本の歴史と文化", "euc_kr": "선형 방정식과 응용", "cp1252": "Räumliche Übungen für Anfänger",
}
READ = ["cp1252", "mac_roman", "cp437", "cp1251", "latin-1", "iso8859_15"]
HOMES = [frozenset(), frozenset(["LATIN", "CJK", "CYRILLIC"]), frozenset(["GREEK", "HEBREW", "ARABIC", "HANGUL", "KANA", "CJK", "CYRILLIC", "LATIN"])]


@pytest.mark.parametrize("home", HOMES, ids=["no home", "three scripts", "all scripts"])
def test_nothing_wrong_is_called_restored(home):
    """All pairs of encodings, with and without UTF-8 in between: what is called restored is the original."""
    right = wrong = found = 0
    for written, title in WRITTEN.items():
        if home and mojibake.script(title) not in home:
            continue
        for read in READ:
            for layers in (1, 2, 3):
                for raw in (title.encode(written), title.encode("utf-8")):
                    try:
                        text = raw.decode(read)
                        for _ in range(layers - 1):
                            text = text.encode("utf-8").decode("latin-1")
                    except UnicodeDecodeError:
                        continue
                    if text == title:
                        continue
                    garbled, restored, _ = mojibake.examine(text, home)
                    found += garbled
                    right += restored == title
                    wrong += restored not in (None, title)
    print(f"found {found}, right {right}, wrong {wrong}")
    assert wrong <= 0.03 * right and right > 190


@pytest.mark.parametrize("layers", [1, 2, 3, 5, 7])
def test_any_number_of_layers(layers):
    for title in ("第一章 概述", "Größe und Maß", "Глава 5"):
        text = title
        for _ in range(layers):
            text = text.encode("utf-8").decode("latin-1")
        garbled, restored, n = mojibake.examine(text)
        assert garbled and restored == title and n == layers


def test_filter_lets_all_pairs_through(spark):
    rows = []
    for title in WRITTEN.values():
        for read in mojibake.READ_AS:
            text = title.encode("utf-8").decode(read, "ignore")
            if not text.isascii() and mojibake.examine(text)[0]:
                rows.append((text,))
    df = spark.createDataFrame(rows, "t string")
    passed_by = [r["t"] for r in df.where(~mojibake.doubtful(df["t"])).collect()]
    assert len(rows) > 100 and passed_by == []

"""Residue and ordinary texts written for this test alone, none of them taken from the test tables or from the exemplars."""

from collections import Counter

import pyarrow.parquet as pq
import pytest

from quirelake.llm import residue

RESIDUE = """
Hello {{ customer.first_name }}, your order is on its way.
Hi {{user}}, welcome back!
Total: ${amount} due on ${date}
Page generated for %(user_name)s on %(day)s.
Bonjour [[PRENOM]], merci pour votre visite.
Copyright <%= Time.now.year %> All rights reserved
<?= $row.name ?>
{% include header %}
Your appointment is on {date} at {time}.
Dear [Customer Name],
Shipping to: [insert street address]
Price: ##PRICE##
Contact us at @@EMAIL@@ for details.
The author of this work is [AUTHOR NAME].
Written by <your name here>
Published (enter year) by Oak Press.
Sehr geehrte Frau {nachname}, Ihre Bestellung {order} ist da.
尊敬的【请填写姓名】：您好！
本书由〔待填〕编写。
Уважаемый [введите имя], ваш заказ готов.
The book was written by undefined in 1998.
Rating: [object Object] out of 5
Autor: «author»
&lt;title&gt; is the first volume of the series.
Invoice number: __NUMBER__
Subject: %subject%
We're sorry, the page you requested could not be found.
HTTP Error 503. The service is unavailable.
403 Forbidden - You don't have permission to access this resource.
504 Gateway Time-out
An unexpected error has occurred. Please contact the administrator.
Warning: mysqli_connect(): Access denied for user
Traceback (most recent call last): KeyError
java.lang.NullPointerException at com.example.Main
This page has been removed.
Your session has timed out. Please log in again.
Too many requests. Slow down and try again later.
The requested URL was not found on this server.
Error establishing a database connection
Internal Server Error: the server encountered an error and could not complete your request.
This site is down for maintenance. Please check back soon.
Sorry, something went wrong. Try reloading the page.
404 页面不存在
系统错误，请联系管理员
很抱歉，您要访问的页面不存在！
服务器繁忙，请稍后重试
没有权限查看此内容
Seite nicht gefunden (404)
Ein Fehler ist aufgetreten. Bitte versuchen Sie es später noch einmal.
Accès refusé : vous n'avez pas l'autorisation requise.
La page demandée n'existe plus.
Ошибка сервера. Попробуйте позже.
Страница не найдена
Página no encontrada
サーバーエラーが発生しました。しばらくしてから再度お試しください。
Please enable JavaScript to continue.
You need to enable JavaScript to run this app.
JavaScript seems to be disabled in your browser.
This website requires cookies and JavaScript.
Your browser does not support JavaScript.
Checking if the site connection is secure. Enable JavaScript and cookies to continue
Enable scripts and reload this page.
请开启浏览器的 JavaScript 功能
您的浏览器已禁用脚本
Veuillez activer JavaScript dans votre navigateur.
Bitte aktivieren Sie JavaScript in Ihrem Browser.
Для просмотра страницы включите JavaScript.
Por favor, habilite JavaScript.
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
Sed ut perspiciatis lorem ipsum dolor sit amet.
Placeholder text. Replace this placeholder text.
Sample content goes here.
Text text text text text
Hier steht der Blindtext.
此处为示例文本
测试内容测试内容
Texte de remplissage
Texto de ejemplo
Здесь будет текст
dummy text dummy text dummy text
Varem solit mentur varem pactis solit dolum varem tirat. Pactis mentur solit varem dolum tirat mentur pactis.
"""
ORDINARY = """
Division by zero is undefined.
The function f is undefined at the origin and continuous elsewhere.
The set {a, b} has four subsets, and {1} is one of them.
In LaTeX, $abc$ prints abc in italics.
The cost rose from $5 to $7 within a year, a rise of 40%.
About 30% of the 200 books and 12% of the maps were lost.
Use [NOTE] to mark a passage, and [FIG] for figures.
The «Figaro» reported the case in 1912.
Le journal « Le Monde » a publié une critique.
see (Smith 1999) [12] for <b>details</b> of the proof
The array a[i] is sorted before the call to f(x).
Compare a < b and b > c in the second column.
The editor's name was found on page 40.
Please write your name on the first page before you begin the exercise.
The lost page was never found, and the chapter ends abruptly.
He was denied access to the library for three years.
The bridge connection between the two towns was lost in the flood.
Error analysis is the subject of the third chapter.
An error of measurement must not be confused with a mistake.
The server carried the dishes into the dining room, and the guests were delighted.
Scripts for the stage differ from scripts for the screen.
The browser of old books will enjoy this catalogue.
Java and JavaScript are two different languages.
The manuscript is written in two scripts, Greek and Latin.
Cookies were baked for the visitors every Saturday.
The expression "page not found" became a joke among the librarians.
In chapter 4 the reader learns how to print a message such as "access denied".
The phrase “lorem ipsum” comes from a text of Cicero.
The sample text in Figure 2 shows the typeface in three sizes.
The dummy of the book was bound in grey cloth.
The placeholder syllable in the song has no meaning.
Under construction since 1882, the church is nearly finished.
The museum is closed for maintenance every January, so visitors should plan ahead.
She was logged in the ship's register as a passenger.
The request for more time was granted by the court.
All too many requests were refused in those years.
Try again, fail again, fail better.
Something went wrong with the harvest that year, and prices rose.
The gateway of the castle was rebuilt in stone.
The forbidden books were kept in a locked room.
It is forbidden to enter the reading room with a coat.
Sorry, said the boy, I did not see the page.
这一页的文字已经模糊不清，需要对照原书。
作者在第三章讨论了误差的来源，并给出两个例子。
该页不存在于初版，是后来补入的。
他没有权限进入书库，只好在门外等候。
服务员端上茶来，客人们继续谈论古书。
函数在原点没有定义，其余各处连续。
集合 {a, b} 有四个子集。
书中引用了“系统繁忙”这样的提示语作为例子。
脚本语言的历史可以追溯到六十年代。
测试题共十道，答案附在书后。
这里是他出生的地方，屋前有一棵老树。
Die Seite wurde nachträglich eingeklebt, wie man am Papier erkennt.
Der Fehler liegt im zweiten Beweisschritt.
Der Zugriff auf das Archiv war nur Gelehrten erlaubt.
Platz für Notizen findet sich am Ende jedes Kapitels.
Le chapitre sur les erreurs de mesure est le plus long.
La page de titre manque dans notre exemplaire.
Il faut activer la pompe avant de lire la pression.
Страница с титулом утрачена, но текст сохранился.
Ошибки измерений рассматриваются в третьей главе.
Сценарий фильма был написан за две недели.
La página del título falta en este ejemplar.
El error de medida se estudia en el capítulo segundo.
Exercise 3: fill in the blank. The capital of Peru is ______.
Ergänzen Sie: Der Baum ist ______.
The variable name_list holds the names of all readers.
A template replaces {{ name }} with a value, as section 5 explains.
The operator %d prints a whole number and %s prints a text.
In the shell, ${HOME} stands for the home directory.
Keywords: acoustics, acoustics of rooms, room acoustics, sound, sound fields
Rosa rosae rosam are forms of the first declension.
Arma virumque cano, Troiae qui primus ab oris
Gallia est omnis divisa in partes tres.
Tables 1 to 4 list the results; all values are means of 3 runs.
Figure 7. The distribution of page numbers in 40 volumes.
1.1 Introduction ...... 3
Chapter 2 Errors and Their Causes
Price: 12.50 (incl. tax) [approx.]
E = mc² holds for a body at rest; see eq. (4).
""".strip().splitlines()


@pytest.fixture(scope="module")
def index():
    """Weights as in a corpus: the documents of a small test table and the ordinary texts."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist() + ORDINARY
    counts = Counter(t for text in texts if text for t in residue.occurring(text, residue.vocabulary()))
    return residue.build_index(len(texts), counts)


def test_held_out_texts(index):
    cases = RESIDUE.strip().splitlines()
    missed = [t for t in cases if residue.judge(t, index) is None]
    wrong = [(residue.judge(t, index), t) for t in ORDINARY if residue.judge(t, index)]
    recall = 1 - len(missed) / len(cases)
    precision = (len(cases) - len(missed)) / (len(cases) - len(missed) + len(wrong))
    print(f"recall {recall:.3f} of {len(cases)}, precision {precision:.3f} with {len(ORDINARY)} ordinary texts")
    assert recall >= 0.9 and precision >= 0.98, (missed, wrong)


def test_menus_around_a_notice(index):
    menu = "\n".join(["Home", "Catalogue", "About", "Contact", "Help", "News", "Shop"])
    assert residue.judge(menu + "\nThe requested page could not be found on this server, sorry.\n", index) == "error"
    long = " ".join(["The book treats the subject with care and gives many examples to the reader."] * 9)
    assert residue.judge(long + "\nThe page could not be found.", index) is None


def test_long_places(index):
    name = "_".join(["title"] * 40)
    assert residue.judge("Dear reader of {{ %s }}" % name, index) == "slot"
    assert residue.judge("[insert %s here]" % ("the title " * 30), index) == "slot"
    assert residue.judge("ISBN{{isbn}}", index) == residue.judge("12{{x}}", index) == residue.judge("d’{{auteur}}", index) == "slot"

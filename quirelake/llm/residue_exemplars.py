"""Labelled exemplars of residue, and of sentences that only speak about it. Fixed values, as plain text."""

# Notices of servers and readers that stand in for a page.
ERROR = """
the page could not be found
this chapter was moved or deleted
this item is no longer available
the file cannot be displayed right now
the scan you opened failed to load
the requested volume timed out before delivery
sorry, the page is no longer available
you lack permission for record
access denied
contact the administrator
too many requests
try again in minutes
please try again later
please reload
oops!
something went wrong
your session has expired
please sign in again
we’re down for maintenance and will be back in minutes
unable to connect to database on port
internal server error
bad gateway
gateway timeout
service unavailable
forbidden
not found
upstream closed
error code reference
http error
connectionerror: upstream closed
traceback (most recent call last):
file "/opt/reader/page.py", line, in load
nullpointerexception at shelf.view.render(view.java)
fatal error: uncaught exception in /srv/shelf/render.php on line
抱歉，您访问的页面不存在
系统提示：该章节加载失败
错误：所请求的文件读取超时，编号
这份扫描件暂时无法显示
此条目没有访问权限
本书详情已被移除，请返回书架
服务器正在维护，预计分钟后恢复
访问过于频繁，请分钟后再来
登录已过期，请重新登录后继续
请稍后重试
您访问的页面暂时无法显示
该章节已被移除
此条目不存在
此条目加载失败
所请求的文件没有访问权限
所请求的文件暂时无法显示
这份扫描件不存在
这份扫描件读取超时
本书详情加载失败
该章节读取超时
该章节不存在
该章节没有访问权限
本书详情不存在
本书详情读取超时
本书详情没有访问权限
此条目读取超时
此条目已被移除
所请求的文件不存在
所请求的文件加载失败
您访问的页面读取超时
请联系管理员
数据库连接失败
网关错误
上游无响应
服务器内部错误
désolé, la page demandée est introuvable (réf. )
erreur : ce chapitre est introuvable
le fichier n’est plus disponible
cette notice n’a pas pu être chargé
accès refusé
votre session a expiré, veuillez vous reconnecter
service en maintenance pendant minutes
veuillez réessayer plus tard
trop de requêtes, réessayez dans minutes
leider: die angeforderte datei ist nicht mehr verfügbar (kennung )
fehler : die seite wurde nicht gefunden
dieses kapitel konnte nicht geladen werden
der eintrag konnte nicht geladen werden
zugriff verweigert
ihre sitzung ist abgelaufen
bitte melden sie sich neu an
bitte versuchen sie es später erneut
wartungsarbeiten: noch etwa minuten
zu viele anfragen
neuer versuch in minuten
ошибка : страница не найдена, код
к сожалению, карточка книги недоступна
запрошенный файл не загружается
глава не найдена
эта страница недоступна
доступ запрещён
сеанс истёк, войдите снова
попробуйте позже
ведутся технические работы, осталось мин.
слишком много запросов, повторите через мин.
"""

# Notices in other wordings and languages.
ERROR += """
oops, looks like something broke on our side
this page isn’t working
the page you are looking for does not exist
the page you requested was not found on this server
this content has been removed
this resource is temporarily unavailable
the server encountered an unexpected condition
the request could not be completed
proxy error: invalid response from upstream server
the connection has timed out
the server took too long to respond
dns lookup failed
an unexpected error has occurred
error establishing a database connection
you do not have permission to access this page
you are not authorized to view this document
your account has been suspended
please log in to continue
you have been logged out
rate limit exceeded
request blocked by the firewall
this site can’t be reached
under construction
coming soon
temporarily down for maintenance
500 internal server error
invalid request parameters
stack trace
segmentation fault (core dumped)
syntax error, unexpected end of file
undefined index in file on line
cannot read properties of null
exception in thread main
module not found
页面走丢了，去首页看看吧
页面找不到了
您要找的内容不存在或已被删除
系统繁忙，请稍后再试
网络连接超时
服务器开小差了
服务暂不可用
无权访问该页面
请求参数错误
esta página no existe
no se ha encontrado la página solicitada
error interno del servidor
acceso denegado
servicio no disponible temporalmente
a página não foi encontrada
erro interno do servidor
la pagina richiesta non è stata trovata
ページが見つかりません
お探しのページは存在しません
アクセスが拒否されました
サーバーエラーが発生しました
しばらくしてから再度お試しください
페이지를 찾을 수 없습니다
une erreur inattendue s’est produite
erreur interne du serveur
la page que vous recherchez n’existe pas
es ist ein unerwarteter fehler aufgetreten
interner serverfehler
die gewünschte seite existiert nicht
произошла непредвиденная ошибка
внутренняя ошибка сервера
запрашиваемая страница не существует
"""

# Notices that scripts are needed.
SCRIPT = """
our website requires javascript to function
turn it on and refresh
this application needs javascript to run
you need to enable javascript to run this app
scripts are blocked in your browser
this page requires cookies to be enabled
please turn javascript on and reload the page
your browser is out of date or not supported
enable scripts and cookies to continue
verifying you are human
请先打开浏览器的脚本功能
本网站需要启用 javascript
当前浏览器版本过低
por favor, active javascript en su navegador
este sitio requiere javascript
ative o javascript para continuar
abilita javascript per visualizzare la pagina
javascriptを有効にしてください
자바스크립트를 활성화하십시오
votre navigateur ne prend pas en charge javascript
diese anwendung benötigt javascript
для работы сайта необходим javascript
please enable javascript in your browser to view this page
kindly turn on scripts for this site before the book can be shown
you must switch on scripting to open the reader
we need you to activate js and cookies in your browser
to continue, allow scripts for this site and reload
javascript is disabled
this site doesn't work without javascript
your browser does not run the script this reader requires
checking your browser before opening the shelf
您的浏览器不支持脚本，内容无法显示
正在检查您的浏览器，请稍候
请启用 javascript 后再使用阅读器
您需要开启脚本和 cookie，然后浏览本页
必须先允许 js 脚本才能阅读本书
请在浏览器中开启 javascript 才能浏览本页
请打开脚本后再浏览本页
您需要启用 cookie 后再显示内容
您需要打开
您需要允许
您需要启用
请在浏览器中打开
请在浏览器中允许
必须先打开 js
必须先开启 javascript
请允许 js
请开启脚本
请打开 cookie
后再阅读本书
然后使用阅读器
才能显示内容
后再浏览本页
请在浏览器中打开脚本，然后显示内容，并刷新页面
il faut activer javascript pour afficher cette page
merci d’autoriser les scripts pour ouvrir le lecteur
veuillez autoriser les scripts
veuillez activer javascript
ce site ne fonctionne pas sans javascript
vérification de votre navigateur
bitte javascript aktivieren, um diese seite anzuzeigen
bitte die skriptausführung einschalten
zum lesen müssen sie javascript zulassen, damit das buch geöffnet wird
diese seite funktioniert ohne javascript nicht
ihr browser wird geprüft
включите javascript в браузере, чтобы открыть страницу
разрешите сценарии, чтобы читать книгу
пожалуйста, включите скрипты
без javascript сайт не работает
проверяем ваш браузер
"""

# Filler that stands where text should be.
FILLER = """
lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat
duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur
excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum
placeholder text goes here
placeholder paragraph – replace me
placeholder copy
placeholder content
sample text, to be written
sample paragraph
sample copy
sample content
filler copy follows
filler text
filler paragraph
filler content
test content
test copy
test text
test paragraph
dummy text
dummy copy
dummy content
dummy paragraph
body goes here
text goes here
text text text
bla bla bla
asdf asdf qwer
这里是正文
测试测试测试
啊啊啊啊
一二三四五六七
占位文字，请替换
占位段落，待补
占位内容
占位文本
样例文字，仅供排版
样例段落
样例内容
样例文本
示例文字，仅供排版
示例段落，待补
示例内容
示例文本，请替换
测试文字
测试段落
测试内容
测试文本
texte texte texte
texte provisoire à remplacer
texte factice
texte de remplissage, contenu à venir
texte provisoire, contenu à venir
contenu provisoire
faux texte à remplacer
texte à compléter
le texte viendra ici
platzhalter
blindtext
platzhalter, bitte ersetzen
platzhalter folgt hier
platzhalter für den absatz
platzhaltertext, inhalt folgt
blindtext, bitte ersetzen
hier steht später etwas
текст текст текст
текст-заполнитель, будет дополнено
здесь будет текст
образец текста, заменить
"""

FILLER += """
lorem ipsum
beispieltext
beispieltext für den absatz
your text here
insert text here
type your text here
content to be added
content coming soon
text to follow
foo bar baz
qwerty qwerty
blah blah blah
aquí va el texto
texto de ejemplo
testo segnaposto
此处为正文内容
待补充内容
内容待定
正文待补
ici votre texte
hier steht ihr text
рыба-текст
пример текста
"""

# Lines of the page around it: no content of their own, and no residue either.
AROUND = """
back to shelf
home > catalogue > item
search | help | contact
书架 | 搜索 | 帮助
返回首页
首页 > 书目 > 详情
accueil > catalogue > fiche
retour
start > katalog > titel
zurück
главная > каталог
назад
"""

# Sentences that mention or quote such things as their subject, exercises with blanks, formulas.
MENTION = """
the printf example on page uses %s and %d, and the shell example prints ${home}
the inner product <u, v> is written [u, v] in the older edition, see note
complete the sentence in exercise: a graph without cycles is called a ______
the survey form printed in chapter leaves a place marked [name] for the respondent
a good message does not merely say that the page could not be found; section gives better wording
exercise asks why a site shows the words “please enable javascript” and how to avoid it
chapter explains how a template engine replaces {{ title }} with a value at print time
the section on type specimens tells how “lorem ipsum” came to fill trial pages
the set {x | x > 0} and the fraction \\frac{u}{v} appear in the proof on page
in the trial print, sample text such as “text text text” was used to judge the spacing
status codes such as 404 not found and 502 bad gateway are explained on page, with exercises
the macro __line__ and the name %path% are discussed on page
access to the archive was denied to the editors until page had been cleared
javascript is introduced in chapter, after the reader has met variables and loops
作者举例说，“页面不存在”这句提示应当告诉读者下一步做什么
习题要求用脚本语言改写例子；若浏览器提示“请启用 javascript”，读者应检查设置
变量写成 ${name} 的形式，取值规则见第页
示例文字与正文应当用不同字体，第节有详细规定
排版史一节说明了 lorem ipsum 这类假文为何用于试排版面
公式 $x_1$ 与 \\frac{u}{v} 的排法见第页
填空题：第题的答案应写在 ______ 处
网络编程部分逐一解释状态码 404、500 与 503 的含义，并给出练习
原文此处有 [注 1]，今移至页末
数据库一章分析了“连接失败”的种原因
集合 {1, 2, 3} 的子集个数在第页算出
第章讲解模板引擎，双花括号 {{ title }} 会在渲染时被书名替换
le chapitre montre comment un gabarit remplace ${titre} par une valeur
l’erreur sert d’exemple à la page
javascript n’est abordé qu’au chapitre
exercice : compléter par ______
l’histoire du faux texte « lorem ipsum » est racontée page
aufgabe: ergänzen sie das wort ______
der abschnitt über satzproben behandelt blindtext und „lorem ipsum“
javascript wird erst in kapitel eingeführt
kapitel erklärt, wie eine vorlage {{ titel }} durch einen wert ersetzt
die meldung „404 – seite nicht gefunden“ dient auf seite als beispiel
упражнение: вставьте пропущенное слово ______
в главе показано, как шаблон заменяет {{ title }} значением
об ошибке и сообщении «включите javascript» рассказано на странице
язык javascript вводится в главе
"""

# Open places of templates, one for each notation. Names that say nothing stand where any name will do; names of fields and words that
# ask for something stand where the notation alone means other things as well.
PLACE = """
{{ x1 }}
{{{ x1 }}}
{{ x1 | y1 }}
{% x1 %}
{% x1 y1 %}
<%= x1 %>
<? x1 ?>
${ x1 }
#{ x1 }
$( x1 )
%(x1)s
%title%
[[ x1 ]]
[[ TITLE ]]
[[ first name ]]
@@X1@@
##title##
__TITLE__
&lt;title&gt;
«title»
{0}
{title}
$title$
[TITLE]
[First Name]
<First Name>
[insert x1]
<insert x1>
(insert x1)
[请填写]
<请填写>
(请填写)
{请填写}
【请填写】
〔待填〕
（此处插入）
[object Object]
"""

# Names of fields in forms and templates.
FIELDS = """
name first last firstname lastname title subtitle author editor translator publisher edition volume chapter section page pages number year month date day time isbn issn doi
summary abstract description subject topic heading body content text price amount total quantity email mail address phone street city country zip company customer client user username
product item order category keyword keywords language url link image file filename format series place location organisation organization department recipient sender signature
titel autor verfasser verlag ausgabe auflage band kapitel seite seiten jahr datum titre auteur éditeur édition tome chapitre année nom prénom название автор издатель издание том глава год имя
"""

# Words that ask for something to be put in.
ASK = """
insert enter your here fill add type write complete replace tbd todo
einfügen eintragen ausfüllen ergänzen ihr ihre insérer saisir compléter remplir votre вставьте укажите введите впишите ваш ваше
请填写 待填 在此输入 此处插入 请输入 填入 待补 待定
"""

# What speaks for a formula or a programme rather than for an open place, where the notation means both.
FORMULA = """
set sets subset closure element matrix vector vectors function proof theorem equation formula fraction latex tex math variable integer modulo interval union notation prints
menge matrix funktion formel gleichung ensemble formule équation fonction множество формула функция уравнение
集合 公式 变量 函数 方程 矩阵 子集
"""

# What speaks about templates and programmes, in whose sentences a place is an example.
ABOUT = """
template templates placeholder placeholders shell macro macros syntax script compiler interpreter
gabarit gabarits modèle vorlage vorlagen platzhalter шаблон шаблона шаблоне 模板 占位符 变量
"""

# Endings of the made-up Latin that filler is drawn from.
LATIN_ENDINGS = "um is es us it at et em am as os or nt do ra ca ta va na la sa ro re ur ie ia id ad im"
# Frequent words of several languages; made-up Latin has hardly any.
FREQUENT = """
the of and to in is was for with that this from by are on as be at it not
der die das und von den mit ist im zu auf für eine ein nicht le la les des et du en une un est pour dans que qui par sur il
el los las del y con por una para al lo di che non per il della e o a os um uma do da no na não
""".split()


def lines(text: str) -> list[str]:
    return [x for x in (line.strip() for line in text.splitlines()) if x]

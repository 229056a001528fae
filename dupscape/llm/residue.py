"""Documents that are template residue, filler, error pages or notices demanding scripts, not content.

Labelled exemplars are held in an inverted index from word shingles to exemplars. A document is read in passage
windows; the exemplars that share shingles with a window are retrieved, and the window's containment is the share of
its TF-IDF weight that they cover. The characters of windows with high containment, against all of the document's,
give its coverage. Document frequencies are counted over the whole corpus.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupscape.llm.lookalikes import comparing_folding, letters_and_digits, points, slices, text_of
from dupscape.session import materialize, spread

#: Stands for an unfilled field, whatever its notation.
FIELD = "\ue000"
# Notations of unfilled fields. Double forms come before single ones.
FIELDS = re.compile(
    r"\{%\s*block\s+[\w.]+\s*%\}\s*(?:\{%\s*endblock\s*%\})?|\{%[^%{}\n]{1,60}%\}|\{\{[^{}\n]{0,60}\}\}|<%=?[^%<>\n]{0,60}%>|<<[^<>\n]{1,60}>>|\[\[[^\[\]\n]{1,60}\]\]"
    r"|[$#]\{[\w. ]{1,60}\}|@@[\w. ]{1,60}@@|__[A-Za-z][\w.]*?__|%[A-Za-z_][\w.]{2,60}%|\$[A-Za-z_][\w.]{2,40}\$|(?<![\\\w}])\{[A-Za-z_][\w.]{3,60}\}"
    r"|[\[<](?:insert|your|enter|add|type|replace|tbd)\b[^\[\]<>\n]{0,60}[\]>]|\[[^\[\]\n]{1,60}\b(?:to be added|goes here|here|tbd|to come)\]",
    re.I,
)
#: Named slots in brackets, words in capitals as forms have them: [Author Name].
SLOTS = re.compile(r"\[(?:[A-Z][a-z]+)(?:[ ,/]+(?:[A-Z][a-z]+|of|your|the)){1,3}\]")
TAGS = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>\n]*)?/?>")

# Labelled exemplars, by kind. A bag's words count in any order; other kinds count by neighbouring words, and
# by single words where those are rare. PUBLIC is worded after what browsers, servers, page builders and office programs
# commonly show; EXEMPLARS were written after lines of such documents had been read.
PUBLIC = {
    "bag": """
        lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat
        duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
        sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo
    """,
    "template": """
        $x$ by $x$
        [Author Name] [Book Title] [Company Name] [Your Name] [Street Address] [Phone Number] [Email Address] [City, State]
        Dear Sir or Madam {{x}}, thank you for your order number {{x}} of {{x}}
        Hi {{x}}, your account {{x}} was created on {{x}}
        Posted by {{x}} on {{x}} in {{x}} with {{x}} comments
        All rights reserved {{x}}. ISBN {{x}}. Printed in {{x}}. First edition {{x}}
        Table of contents {{x}} List of figures {{x}} Index {{x}} Appendix {{x}}
        Sehr geehrte Damen und Herren {{x}}, vielen Dank für Ihre Bestellung {{x}} vom {{x}}
        Bonjour {{x}}, merci pour votre commande {{x}} du {{x}}
        Estimado {{x}}, gracias por su pedido {{x}} del {{x}}
        Уважаемый {{x}}, спасибо за ваш заказ {{x}} от {{x}}
        尊敬的{{x}}，感谢您订购{{x}}，订单号{{x}}，日期{{x}}
    """,
    "filler": """
        Click to edit Master title style. Click to edit Master text styles. Second level. Third level. Fourth level. Fifth level.
        Click to add title. Click to add text. Click to add subtitle. Double click to add notes. Click icon to add picture.
        Type your text here. Start typing here. Enter your text. Add a description here. Replace this text with your own content.
        This is a sample page. It is different from a blog post because it will stay in one place. This is an example paragraph.
        Hello world! Welcome to your new site. This is your first post. Edit or delete it, then start writing!
        This section is intentionally left blank. This page is intentionally left blank. Content coming soon. Under construction. More to come.
        Insert chapter text here. Insert image here. Insert caption. Heading goes here. Subheading. Body text. Title placeholder. Your name here. Your title here.
        The quick brown fox jumps over the lazy dog. The quick brown fox jumped over the lazy dogs.
        Fülltext. Beispieltext. Dies ist ein Typoblindtext. Dies ist nur ein Beispieltext und dient als Platzhalter. Hier Text eingeben. Titel eingeben. Text durch Klicken hinzufügen. Inhalt folgt in Kürze. Diese Seite wurde absichtlich leer gelassen. Überschrift hier einfügen.
        Cliquez pour ajouter un titre. Cliquez pour ajouter du texte. Ceci est un exemple de texte. Saisissez votre texte ici. Texte à remplacer. Contenu à venir. Page laissée vide intentionnellement. Faux texte. En construction.
        Haga clic para agregar título. Haga clic para agregar texto. Este es un texto de ejemplo. Escriba su texto aquí. Texto de relleno. Contenido próximamente. Página en blanco intencionadamente. Introduzca el título. En construcción.
        Щёлкните, чтобы добавить заголовок. Щелкните, чтобы добавить текст. Это пример текста. Введите ваш текст здесь. Текст-заполнитель. Рыбный текст. Содержание скоро появится. Страница намеренно оставлена пустой. Раздел в разработке. Образец заголовка.
        单击此处添加标题。单击此处添加文本。单击此处编辑母版标题样式。这里是示例文字。在此处输入文本。示例文本，请替换。内容即将推出。此页有意留白。占位符文字。敬请期待。网站建设中。正文内容待添加。
        ここにテキストを入力してください。サンプルテキスト。ダミーテキストです。タイトルを入力。準備中です。
        여기에 텍스트를 입력하세요. 샘플 텍스트입니다. 준비 중입니다.
        Fare clic per inserire il titolo. Testo di esempio. Inserire il testo qui. Clique para adicionar um título. Texto de exemplo. Insira o texto aqui. Klik om tekst toe te voegen.
    """,
    "error": """
        This site can't be reached. The server unexpectedly closed the connection. The server took too long to respond. Check your Internet connection. Check the proxy and the firewall. ERR_CONNECTION_TIMED_OUT ERR_NAME_NOT_RESOLVED ERR_CONNECTION_REFUSED DNS_PROBE_FINISHED_NXDOMAIN
        This page isn't working. The page isn't redirecting properly. Unable to connect. Hmm, we're having trouble finding that site. Your connection is not private. The webpage is not available. No internet.
        Sorry, the page you are looking for could not be found. We couldn't find that page. The page you requested does not exist, may have been moved, renamed or deleted, or is temporarily unavailable. Nothing was found at this location. Return to the home page. Check the address and try again. Go back to the homepage.
        An error has occurred. An unexpected error occurred while processing your request. Something went wrong on our end. We apologize for the inconvenience. Please contact the administrator. The server encountered an internal error or misconfiguration and was unable to complete your request. More information about this error may be available in the server error log.
        The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please refresh the page. We'll be back shortly. The site is undergoing scheduled maintenance. Thank you for your patience. The service is currently unavailable. Error establishing a database connection. Bad gateway. The proxy server received an invalid response from an upstream server.
        You don't have permission to access this resource on this server. You are not authorized to view this page. Unauthorized. Login required. Authentication failed. Please log in to continue. Your session has timed out. You have been logged out due to inactivity. Access to this resource is denied. Request blocked. Rate limit exceeded. Please slow down.
        Content not available in your region. This video is unavailable. This item has been removed. This document could not be loaded. Failed to load resource. Unable to load content. Failed to fetch. Network error. Could not open the file. The file is damaged and could not be repaired. The book could not be opened. Download failed. Image not found. Invalid request. Method not allowed. Not implemented. Payload too large. Unsupported media type.
        Exception in thread main java.lang.NullPointerException at com.example.Main.main(Main.java:12). Caused by: java.io.IOException: Connection reset. TypeError: Cannot read properties of undefined (reading 'length'). ReferenceError: x is not defined. Uncaught exception. Segmentation fault (core dumped). ValueError: invalid literal. IndexError: list index out of range. SyntaxError: Unexpected token. Notice: Undefined variable. Parse error: syntax error, unexpected end of file in /var/www/html/index.php on line 12. SQLSTATE[HY000] [2002] Connection refused. Internal error code 500. Stack trace. Debug information. Error reference number.
        Diese Website ist nicht erreichbar. Es ist ein Fehler aufgetreten. Ein unerwarteter Fehler ist aufgetreten. Die angeforderte Seite konnte nicht gefunden werden. Die Seite existiert nicht oder wurde entfernt. Bitte überprüfen Sie die Adresse. Zurück zur Startseite. Der Dienst ist vorübergehend nicht verfügbar. Wir bitten um Entschuldigung. Sie haben keine Berechtigung, diese Seite anzuzeigen. Bitte melden Sie sich an. Ihre Sitzung ist abgelaufen. Die Datei konnte nicht geöffnet werden. Verbindung fehlgeschlagen. Zeitüberschreitung der Anforderung. Der Inhalt konnte nicht geladen werden. Anfrage ungültig. Datenbankverbindung fehlgeschlagen.
        Ce site est inaccessible. Une erreur est survenue. Une erreur inattendue s'est produite. La page demandée est introuvable ou n'existe pas. Vérifiez l'adresse et réessayez. Retour à la page d'accueil. Le service est temporairement indisponible. Veuillez nous excuser pour la gêne occasionnée. Vous n'avez pas l'autorisation d'accéder à cette page. Veuillez vous connecter. Votre session a expiré. Impossible d'ouvrir le fichier. Échec de la connexion. Délai d'attente dépassé. Le contenu n'a pas pu être chargé. Requête invalide. Contactez l'administrateur.
        No se puede acceder a este sitio. Se ha producido un error. Ha ocurrido un error inesperado. No se encontró la página solicitada. La página no existe o ha sido eliminada. Compruebe la dirección e intente de nuevo. Volver a la página de inicio. El servicio no está disponible temporalmente. Disculpe las molestias. No tiene permiso para acceder a esta página. Inicie sesión para continuar. Su sesión ha expirado. No se pudo abrir el archivo. Error de conexión. Tiempo de espera agotado. No se pudo cargar el contenido. Solicitud no válida. Póngase en contacto con el administrador.
        Не удаётся получить доступ к сайту. Произошла ошибка. Произошла непредвиденная ошибка. Запрашиваемая страница не найдена. Страница не существует или была удалена. Проверьте адрес и попробуйте ещё раз. Вернуться на главную страницу. Сервис временно недоступен. Приносим извинения за неудобства. У вас нет прав для просмотра этой страницы. Войдите в систему. Ваш сеанс истёк. Не удалось открыть файл. Ошибка подключения. Время ожидания истекло. Не удалось загрузить содержимое. Неверный запрос. Обратитесь к администратору. Ведутся технические работы.
        无法访问此网站。抱歉，出错了。发生未知错误。很抱歉，您要查找的页面不存在。页面已被移动或删除。请检查网址是否正确。返回首页。服务暂时不可用。给您带来不便，敬请谅解。您没有权限访问此页面。请先登录。会话已过期，请重新登录。文件无法打开。连接失败。网络连接超时。内容加载失败，请刷新重试。无效的请求。请联系管理员。服务器繁忙，请稍后重试。数据库连接错误。出了点问题。该内容已下架。
        エラーが発生しました。ページが見つかりません。しばらくしてからもう一度お試しください。アクセスが拒否されました。サーバーに接続できません。お探しのページは移動または削除された可能性があります。
        오류가 발생했습니다. 페이지를 찾을 수 없습니다. 잠시 후 다시 시도해 주세요. 접근이 거부되었습니다. 서버에 연결할 수 없습니다.
        Si è verificato un errore. Pagina non trovata. Impossibile raggiungere il sito. Ocorreu um erro. Página não encontrada. Não é possível acessar esse site. Er is een fout opgetreden. Pagina niet gevonden.
    """,
    "scripts": """
        You need to enable JavaScript to run this app. JavaScript is required to view this content. JavaScript must be enabled in order for you to use this site. It looks like your browser does not have JavaScript enabled. JavaScript seems to be disabled in your browser. For full functionality of this site it is necessary to enable JavaScript. Here are the instructions how to enable JavaScript in your web browser. Turn on JavaScript and reload the page to continue.
        Your browser does not support scripts or has scripts turned off. Your browser does not support JavaScript. Please upgrade to a modern browser or turn scripting on. This page uses scripts that your browser blocked. Your browser is not supported. Please update your browser. Please disable your ad blocker. Please enable cookies. Cookies are disabled in your browser. This feature requires Flash Player. Your browser does not support the video tag. Your browser does not support frames, inline frames or the canvas element.
        Checking if the site connection is secure. Verifying you are human. This may take a few seconds. Please complete the security check to access this site. Just a moment... Enable JavaScript and cookies to continue. Please wait while we verify your browser. Why do I have to complete a CAPTCHA? Please wait, redirecting. If you are not redirected automatically, click here. Loading, please wait.
        JavaScript ist deaktiviert. Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite zu nutzen. Ihr Browser unterstützt kein JavaScript oder Skripte sind ausgeschaltet. Für diese Seite müssen Skripte erlaubt sein. Bitte aktivieren Sie Cookies. Ihr Browser ist veraltet. Ihr Browser wird überprüft. Einen Moment bitte, die Seite wird geladen.
        JavaScript est désactivé. Veuillez activer JavaScript dans votre navigateur pour utiliser ce site. Votre navigateur ne prend pas en charge les scripts. Cette page nécessite JavaScript pour fonctionner. Veuillez activer les cookies. Votre navigateur est obsolète. Vérification de votre navigateur. Chargement en cours, veuillez patienter. Activez les scripts pour afficher le contenu.
        JavaScript está deshabilitado. Habilite JavaScript en su navegador para usar este sitio. Su navegador no admite scripts o los tiene desactivados. Esta página requiere JavaScript para funcionar. Habilite las cookies. Su navegador está desactualizado. Comprobando su navegador. Cargando, espere por favor. Active los scripts para ver el contenido.
        JavaScript отключён. Пожалуйста, включите JavaScript в вашем браузере, чтобы использовать этот сайт. Ваш браузер не поддерживает скрипты или они отключены. Для работы страницы требуется JavaScript. Включите файлы cookie. Ваш браузер устарел. Проверка вашего браузера. Загрузка, подождите. Разрешите выполнение скриптов для просмотра содержимого.
        您的浏览器不支持JavaScript或已禁用脚本。请在浏览器中启用JavaScript以使用本网站。本网站需要启用脚本才能正常显示。请启用Cookie。您的浏览器版本过低，请升级。正在检查您的浏览器。加载中，请稍候。请允许运行脚本后刷新页面。需要开启脚本功能才能查看此内容。
        このページを表示するにはJavaScriptを有効にしてください。お使いのブラウザはJavaScriptに対応していません。読み込み中です。
        이 페이지를 보려면 자바스크립트를 활성화하세요. 브라우저에서 스크립트를 사용할 수 없습니다. 로딩 중입니다.
        È necessario abilitare JavaScript. Por favor, ative o JavaScript no seu navegador. Schakel JavaScript in om deze site te gebruiken.
    """,
}
EXEMPLARS = {
    "template": """
        Filed under {{x}} / {{x}}
        Dear {{x}}, your copy of {{x}} is ready.
        Copyright {{x}} {{x}}
        Published by {{x}} on {{x}}
        By {{x}}
        Chapter {{x}}: {{x}}
        Kapitel {{x}}: {{x}}
        Chapitre {{x}}: {{x}}
        Capítulo {{x}}: {{x}}
        Глава {{x}}: {{x}}
        第{{x}}章 {{x}}
        作者：{{x}}
        Автор: {{x}}
        Auteur : {{x}}
        Autor: {{x}}
        Author: {{x}}
        Title: {{x}}
        Next: {{x}}
        Page {{x}} of {{x}}
        Hello {{x}}, welcome to {{x}}
        {{x}} – {{x}}
    """,
    "bag": """
        lorem ipsum dolor sit amet consectetur consec adipiscing adipisicing elit elisar sed do eiusmod tempor tempora incididunt ut labore et dolore magna aliqua
        enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit velita
        esse cillum eu fugiat fugit feugit feugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit mollis anim id est laborum
        arcu sapien donec usque tellum tellus quando marund orci noster vitae pretium porta ramis maecenas vestibulum pellentesque quisque
        xxx xxxx xxxxx xxxxxx foo bar baz qux asdf qwer qwerty uiop zxcv hjkl blah
    """,
    "filler": """
        This is a test page. This is only a test page.
        Text goes here.
        Your text here
        Your content here
        Your headline
        Insert your story in this box.
        Sample text
        Placeholder text
        Dummy paragraph, replace before release
        TODO write this chapter
        TBD TBD
        (body copy to follow)
        [ Chapter text ]
        Lorem ipsum
        Blindtext Blindtext
        Hier steht der Text.
        Musterüberschrift Mustertext
        Platzhalter
        Texte de remplacement
        Ici votre texte
        Texto de ejemplo aquí
        Su texto aquí
        Здесь будет текст
        Введите текст
        测试测试测试
        这里是正文占位
        此处添加内容
        待补充内容
        未填写
        请在此输入文字
    """,
    "error": """
        The book reader could not load this section.
        Please try again later or go back to the shelf.
        The page you asked for is not on this server.
        The requested URL was not found on this server.
        The link you followed may be broken or the book was taken down.
        This file is no longer available
        We are moving shelves this weekend; reading will be back soon.
        Contact the library desk if this goes on.
        Pages 1 to 2 are not shown.
        You have viewed all preview pages.
        Preview not available
        Sign in to go on reading.
        Your login has ended.
        Session expired
        Invalid token
        Bad request
        404 Not Found
        403 Forbidden
        410 Gone
        500 Internal Server Error
        502 Bad Gateway
        503 Service Unavailable
        Service temporarily unavailable
        Gateway timeout
        Request timed out
        Access denied
        Page not found
        Error 404
        Code 500
        Down for maintenance
        Oops! Something went wrong
        Too many requests
        Quota exceeded
        Unknown error
        Connection refused
        HTTP 404
        Request ID: 12-34
        Upstream sent no reply within 300 ms
        Could not connect to database 'shelf' (errno 11)
        Warning: Undefined index 'chapter' in /srv/reader/show.inc on line 12
        Fatal error: Call to a member function render() on null, line 12
        Stack: reader.view.ChapterPage.render (ChapterPage:12)
        Traceback (most recent call last): File "reader.py", line 12, in open_chapter
        KeyError: 'spine_12'
        NullPointerException at line 12
        Die Seite wurde verschoben oder gelöscht.
        Der Server konnte das Kapitel nicht laden.
        Bitte versuchen Sie es später noch einmal.
        Zugriff verweigert
        Zu viele Anfragen
        Wartungsarbeiten
        Sitzung abgelaufen
        Seite nicht gefunden
        Interner Serverfehler
        Le serveur n’a pas pu charger ce chapitre.
        La page a été déplacée ou supprimée.
        Erreur interne du serveur
        Page introuvable
        Accès refusé
        Trop de requêtes
        Site en maintenance
        Session expirée
        Veuillez réessayer plus tard.
        La sesión ha caducado; inicie sesión de nuevo.
        El servidor no pudo cargar este capítulo.
        Error interno del servidor
        Página no encontrada
        Acceso denegado
        Demasiadas solicitudes
        Sitio en mantenimiento
        Inténtelo de nuevo más tarde.
        Сервер не смог загрузить главу.
        Повторите попытку позже.
        Ошибка сервера
        Страница не найдена
        Доступ запрещён
        Слишком много запросов
        Сайт на обслуживании
        您访问的章节不存在或已被删除。
        权限不足，无法打开此文件。
        请稍后再试，或返回书架。
        服务器内部错误
        访问被拒绝
        找不到页面
        登录已过期
        请求过于频繁
        系统维护中
        请求超时
        内部错误
    """,
    "scripts": """
        Please enable JavaScript to read this book.
        JavaScript is disabled.
        This site requires JavaScript.
        Scripts are required for the page viewer.
        Without JavaScript, we cannot show this page.
        Script execution is blocked. The page viewer cannot start.
        You need to turn on scripts in your browser to view this page.
        This content is shown by a script your browser refused.
        This reader does not work without JavaScript; switch it on and reload.
        Cookies and scripts must be allowed for this site.
        We need to be sure you are not a robot. Allow scripts and cookies to go on.
        Checking your browser before opening the reader...
        Your browser is too old for this reader.
        Reload the page once scripts are allowed.
        Loading… please wait
        Bitte aktivieren Sie JavaScript, um das Buch zu lesen.
        Der Reader benötigt aktivierte Skripte.
        Veuillez activer JavaScript pour lire ce livre.
        Ce lecteur exige que les scripts soient autorisés.
        Active JavaScript en su navegador para leer este libro.
        El visor necesita JavaScript para funcionar.
        Включите JavaScript, чтобы читать книгу.
        Для просмотра страницы нужны скрипты.
        请启用浏览器脚本后再阅读本书。
        本页面需要 JavaScript 支持。
        您的浏览器禁用了脚本，无法显示内容。
    """,
}

#: Words of a passage window; characters that an unfilled field counts for.
WINDOW, FIELD_LENGTH = 12, 12
#: Share of a window's weight from which single words count, and how many different ones there must be.
LOOSE, DISTINCT = 0.6, 3
#: Stand-ins while reading: the end of a line or sentence, the end of a text, and a kept blank.
BREAK, END, BLANK = "\ue001", "\ue002", "\ue003"
OWN = re.compile("[\ue000-\ue003]")
HINTS = re.compile(r"[{<\[@%&$]|__")
SPACED = re.compile(r"(?:\S {1,3}){4,}\S")
CHUNK = 1 << 20


@functools.cache
def _reading_table() -> np.ndarray:
    """Code points in one lower-case form: letters, 0 for every digit, marks of ends, blanks for the rest; 0: dropped."""
    f, letters = comparing_folding(), letters_and_digits()
    out = np.where(letters[f.first], f.first, np.uint32(0x20)).astype(np.uint32)
    out[f.size == 0] = 0
    out[f.marks] = 0
    for cp in (*range(0x30, 0xAC00), *range(0xFF10, 0x20000)):
        if chr(cp).isdecimal():
            out[cp] = ord("0")
    for ch in "\r\n。！？":
        out[ord(ch)] = ord(BREAK)
    for ch in (FIELD, BREAK, END, BLANK):
        out[ord(ch)] = ord(ch)
    return out


@functools.cache
def _by_character() -> np.ndarray:
    """Code points that are a token each: Han, kana, Hangul, fields and marks of ends."""
    out = np.zeros(0x110000, bool)
    for a, b in ((0x3040, 0x3100), (0x3400, 0xA000), (0xAC00, 0xD7A4), (0xE000, 0xE003), (0x20000, 0x33480)):
        out[a:b] = True
    return out


def prepared(text: str) -> str:
    """Entities resolved, letter-spaced lines closed, unfilled fields replaced by FIELD and tags dropped."""
    if OWN.search(text):
        text = OWN.sub(" ", text)
    if "   " in text and SPACED.search(text):
        text = SPACED.sub(lambda m: m.group().replace("   ", BLANK).replace(" ", "").replace(BLANK, " ") if "   " in m.group() else m.group(), text)
    if HINTS.search(text):
        text = TAGS.sub("\n", FIELDS.sub(FIELD, SLOTS.sub(FIELD, html.unescape(text))))
    return text


def read(texts: Iterable[str]) -> list[list[str]]:
    """Tokens of each text: words, single Han or kana characters, 0 for a number, FIELD, and BREAK between passages."""
    texts = [prepared(t) for t in texts]
    raw = points(END.join(texts))
    cps = _reading_table()[raw]
    stop = np.flatnonzero((raw == 0x2E) | (raw == 0x21) | (raw == 0x3F))
    stop = stop[stop + 1 < len(raw)]
    after = raw[stop + 1]
    cps[stop[(after == 0x20) | (after == 0xA) | (after == 0xD) | (after == 0x3C)]] = ord(BREAK)
    keep = cps != 0
    keep[1:] &= ~((cps[1:] == 0x30) & (cps[:-1] == 0x30))
    cps = cps[keep]
    alone = np.flatnonzero(_by_character()[cps])
    if len(alone):
        cps = np.insert(cps, np.concatenate([alone, alone + 1]), 0x20)
    return [t.split() for t in text_of(cps).split(END)]


def all_exemplars() -> dict[str, str]:
    return {kind: lines.rstrip() + "\n" + PUBLIC.get(kind, "").strip() for kind, lines in EXEMPLARS.items()}


def tokens(line: str) -> list[str]:
    return [t for t in read([line])[0] if t != BREAK]


def sentences(line: str) -> list[list[str]]:
    """Tokens of each passage of a line; at least one."""
    out: list[list[str]] = [[]]
    for t in read([line.strip()])[0]:
        if t == BREAK:
            out.append([])
        else:
            out[-1].append(t)
    return [s for s in out if s]


def neighbours(words: list[str]) -> list[str]:
    return [a + " " + b for a, b in zip(words, words[1:])]


@dataclass
class Exemplars:
    """Shingles of exemplars: single words of bags, pairs of neighbouring words of phrases (their end meets their start)."""

    index: dict[str, list[int]]
    words: frozenset[str]
    whole: frozenset[str]

    def __post_init__(self) -> None:
        #: Every word of a shingle; no other word can be covered.
        self.parts = frozenset(w for s in self.index for w in s.split(" "))

    @staticmethod
    def of(exemplars: Mapping[str, str]) -> Exemplars:
        index: dict[str, list[int]] = {}
        words: set[str] = set()
        whole: set[str] = set()
        number = 0
        for kind, lines in exemplars.items():
            for line in lines.strip().splitlines():
                for found in sentences(line):
                    if kind == "bag":
                        words.update(found)
                        shingles = found
                    else:
                        if len(found) == 1 or found[0] == FIELD:
                            whole.add(found[0])
                        shingles = [*neighbours(found + found[:1]), *([found[0]] if len(found) == 1 else [])]
                    for s in set(shingles):
                        index.setdefault(s, []).append(number)
                    number += 1
        return Exemplars(index, frozenset(words), frozenset(whole))


def windows(words: list[str], size: int = WINDOW) -> Iterable[list[str]]:
    """Windows of at most ``size`` tokens, never across a passage's end; one further token closes a window's last pair."""
    ends = [i for i, w in enumerate(words) if w == BREAK]
    at = 0
    for end in [*ends, len(words)]:
        for i in range(at, end, size):
            yield words[i : min(i + size + 1, end)]
        at = end + 1


def length(word: str) -> int:
    return FIELD_LENGTH if word == FIELD else len(word)


def containment(window: list[str], exemplars: Exemplars, idf: Mapping[str, float], unseen: float, size: int = WINDOW) -> float:
    """Share of the window's TF-IDF weight in shingles of retrieved exemplars.

    Words in bags stand alone; other words are weighed as pairs with the word that follows. Wordings that no exemplar has
    consist of the same words all the same: where single words of exemplars, whole ones and not single characters, have
    ``LOOSE`` of the weight of the window's single words, and ``DISTINCT`` different ones are among them, that share counts.
    """
    own = window[:size]
    index, words = exemplars.index, exemplars.words
    covered = total = 0.0
    pairs = neighbours(window)
    hit = [p in index for p in pairs]
    for i, w in enumerate(own):
        if w in words or w in exemplars.whole:
            weight, good = idf.get(w, unseen), True
        else:
            weight = idf.get(pairs[i], unseen) if i < len(pairs) else unseen
            good = (i < len(hit) and hit[i]) or (0 < i <= len(hit) and hit[i - 1])
        weight *= length(w)
        total += weight
        covered += weight if good else 0.0
    if not total:
        return 0.0
    strict = covered / total
    if strict >= LOOSE:
        return strict
    # words outside all exemplars weigh most, so these characters bound the share of the weight
    known = list(filter(exemplars.parts.__contains__, own))
    if sum(map(length, known)) < LOOSE * sum(map(length, own)) or len({w for w in known if w.isalpha()}) < DISTINCT:
        return strict
    covered = total = 0.0
    for i, w in enumerate(own):
        weight = idf.get(w, unseen) * length(w)
        total += weight
        if (len(w) > 1 and w in exemplars.parts) or w == FIELD or w in words or (i < len(hit) and hit[i]) or (0 < i <= len(hit) and hit[i - 1]):
            covered += weight
    return max(strict, covered / total) if total and covered / total >= LOOSE else strict


def coverage(words: list[str], exemplars: Exemplars, idf: Mapping[str, float], unseen: float, least: float) -> float:
    """Share of a text's token characters in windows whose containment is ``least`` or more; 0 for a blank text."""
    residue = whole = 0
    for window in windows(words):
        chars = sum(map(length, window[:WINDOW]))
        whole += chars
        if containment(window, exemplars, idf, unseen) >= least:
            residue += chars
    return residue / whole if whole else 0.0


def _possible(words: list[str], exemplars: Exemplars, least: float) -> float:
    """A bound of the coverage that needs no frequencies; ``least`` is below ``LOOSE``, so single words are within it.

    Covered tokens lie in ``exemplars.parts``, and no token weighs more a character than one that is not covered; so a
    window of containment c has at least c of its characters in parts.
    """
    parts = exemplars.parts
    residue = whole = 0
    for window in windows(words):
        own = window[:WINDOW]
        chars = sum(map(length, own))
        whole += chars
        if sum(map(length, filter(parts.__contains__, own))) >= least * chars:
            residue += chars
    return residue / whole if whole else 0.0


def residue_coverage(
    df: DataFrame, key: str, text: str, exemplars: Mapping[str, str] | None = None, least: float = 0.5, above: float = 0.0
) -> DataFrame:
    """``(key, coverage)`` of every row whose text's share of residue exceeds ``above``.

    The texts are read once, whole. That pass counts the document frequencies of the exemplars' shingles over all rows and
    keeps the texts that can exceed ``above`` by a bound that loses none; these are scored with the final
    weights. The frequencies are a table as long as the exemplars are, whatever the corpus, and go to all executors.
    Null, empty and blank texts have no residue; repeated rows stay repeated.
    """
    known = Exemplars.of(exemplars or all_exemplars())
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    shared = spark.sparkContext.broadcast(known)
    key_type = df.select(key).schema[0].dataType

    def first(batches):
        known = shared.value
        parts, index = known.parts, known.index
        total: Counter = Counter()
        arrow = None
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            arrow = keys.type
            for a, b in slices(map(len, texts), CHUNK):
                rows = read(texts[a:b])
                total[""] += b - a
                for words in rows:
                    pairs = {x + " " + y for x, y in zip(words, words[1:]) if x in parts and y in parts}
                    total.update(pairs.intersection(index))
                    total.update(parts.intersection(words))
                kept = [i for i, words in enumerate(rows) if _possible(words, known, least) > above]
                n = len(kept)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array([a + i for i in kept], pa.int64())), pa.array([texts[a + i] for i in kept], pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())],
                    names=["key", "text", "shingle", "n"],
                )
        if arrow is not None:
            n = len(total)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, arrow), pa.nulls(n, pa.string()), pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["key", "text", "shingle", "n"])

    scan = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col(text).isNotNull() & (F.col(text) != "")))
    once = materialize(scan.mapInArrow(first, f"key {kind}, text string, shingle string, n bigint"), "residue")
    n = {r.shingle: r.n for r in once.where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n")).collect()}
    documents = n.pop("", 0)
    unseen = math.log(documents + 2)
    weights = spark.sparkContext.broadcast(({s: math.log((documents + 2) / (c + 1)) for s, c in n.items()}, unseen))

    def second(batches):
        known, (idf, unseen) = shared.value, weights.value
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(map(len, texts), CHUNK):
                share = [coverage(words, known, idf, unseen, least) for words in read(texts[a:b])]
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(share, pa.float64())], names=[key, "coverage"])

    kept = once.where("shingle is null").select("key", "text")
    return kept.mapInArrow(second, f"{key} {kind}, coverage double").where(F.col("coverage") > above).select(F.col(key).cast(key_type), "coverage")


def residue_documents(df: DataFrame, key: str, text: str, share: float = 0.5, **options) -> DataFrame:
    """Keys of the documents of which more than ``share`` is residue."""
    return residue_coverage(df, key, text, above=share, **options).select(key).distinct()

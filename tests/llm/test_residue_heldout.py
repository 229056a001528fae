"""How far residue detection carries to wordings that no exemplar has: held-out notices, and each exemplar left out once."""

import math
import os
import re
from collections import Counter

import pytest

from dupscape.llm import residue

# Notices as browsers, servers, page builders and shops word them, written after the exemplars by the same
# hand. Three kinds were known before: the slots in $ and in brackets, for which notations were added, and the slide master.
HELD_OUT = """
Firefox can't find the server at the address you entered. Check your network connection and try again.
Sorry! That page doesn't seem to exist. Try the search box or go back to the home page.
Oh no! We could not process your request because of an internal server error. Please try again in a few minutes.
The connection has timed out. The server is taking too long to respond to your request.
We are currently performing scheduled maintenance. Service will be back online shortly. Thank you for your patience.
Access to this page has been denied. You do not have permission to view this content.
Your session has ended because of inactivity. Please sign in again to continue.
Warning: mysql_connect(): Access denied for user 'root'@'localhost' in /var/www/html/db.php on line 4
Uncaught TypeError: Cannot read property 'title' of undefined at render (app.js:31)
We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.
Please turn on JavaScript in your browser settings and reload the page to view this book.
Your browser has scripts turned off or does not support scripts, so this content cannot be shown.
Cookies must be enabled in your browser to use this reader. Please enable cookies and refresh the page.
Click to edit Master subtitle style
Click here to add your text. Replace this placeholder with your own title.
Coming soon: this chapter is under construction. Content will be added here.
This page has been intentionally left blank.
$title$ by $author$
[Author Name] [Book Title]
Dear {{first_name}}, thank you for your order {{order_id}}. Your order will ship on {{date}}.
Diese Seite kann nicht angezeigt werden. Bitte überprüfen Sie Ihre Internetverbindung und versuchen Sie es erneut.
Leider ist ein interner Fehler aufgetreten. Bitte versuchen Sie es später erneut oder wenden Sie sich an den Administrator.
Bitte schalten Sie JavaScript in Ihrem Browser ein und laden Sie die Seite neu.
Hier klicken, um Text hinzuzufügen. Dies ist ein Platzhaltertext.
Désolé, cette page n'existe pas ou a été supprimée. Retour à l'accueil.
Le serveur a mis trop de temps à répondre. Veuillez réessayer dans quelques instants.
Votre navigateur ne prend pas en charge JavaScript ou celui-ci est désactivé. Activez JavaScript et rechargez la page.
Cliquez ici pour ajouter votre texte.
Lo sentimos, la página que busca no existe o ha sido eliminada.
El servidor ha tardado demasiado en responder. Inténtelo de nuevo en unos minutos.
Su navegador tiene JavaScript desactivado. Actívelo y vuelva a cargar la página.
Haga clic aquí para agregar su texto.
Извините, такой страницы не существует или она была удалена.
Сервер временно недоступен. Пожалуйста, попробуйте позже.
В вашем браузере отключён JavaScript. Включите его и перезагрузите страницу.
Нажмите здесь, чтобы добавить текст.
抱歉，您访问的页面不存在或已被移除。
服务器出现错误，请稍后重试。
请在浏览器设置中启用JavaScript后刷新页面。
单击此处添加文字。
""".strip().splitlines()

# Book text that quotes or mentions such notices.
BOOK = """
When the little screen said that the page was not found, Marta laughed, closed the lid and went out to feed the hens, for the rain had stopped and the yard smelled of wet straw and apples.
He had written to the library twice; the answer, a printed slip, said only that the service was closed for the winter and that readers should try again in spring, which he found reasonable.
The server brought soup and bread. Nobody spoke of the error in the will until the plates were cleared and the old notary, coughing, asked for the lamp to be moved nearer to the window.
Der Fehler lag nicht bei ihm, sagte der Kapitän, sondern bei der Karte, auf der die Insel viel zu weit im Westen stand, und so segelten sie zwei Tage lang an ihr vorbei.
Elle cliqua de la langue, posa le panier sur la table et demanda pourquoi la porte du jardin était restée ouverte toute la nuit malgré le vent et les renards.
В ту зиму старик почти не выходил из дома, чинил сети у печи и рассказывал внукам о море, о льдах и о корабле, который так и не вернулся.
她把信放回抽屉里，走到窗前，看见院子里的梅花已经落了一地，远处有人在唱一支很旧的歌。
""".strip().splitlines()

TABLE = "/root/testdata/sf0.01/documents.parquet"
pytestmark = pytest.mark.skipif(not os.path.exists(TABLE), reason="no test tables here")


@pytest.fixture(scope="module")
def frequencies():
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(TABLE, columns=["text"]).column(0).to_pylist() if t]
    count: Counter = Counter()
    for words in residue.read(texts):
        count.update(set(words) | set(residue.neighbours(words)))
    n = len(texts)
    return {s: math.log((n + 2) / (c + 1)) for s, c in count.items()}, math.log(n + 2)


def share(text, exemplars, frequencies):
    """As the operator has it: only shingles and words of exemplars have frequencies, all else counts as unseen."""
    idf, unseen = frequencies
    words = residue.read([text])[0]
    held = {s for s in {*words, *residue.neighbours(words)} if s in exemplars.index or s in exemplars.parts}
    return residue.coverage(words, exemplars, {s: idf[s] for s in held if s in idf}, unseen, 0.5)


def test_held_out_wordings(frequencies):
    known = residue.Exemplars.of(residue.all_exemplars())
    missed = [t for t in HELD_OUT if share(t, known, frequencies) <= 0.5]
    print(f"held out: {len(HELD_OUT) - len(missed)} of {len(HELD_OUT)}; missed: {missed}")
    # measured: 35 of 40; 0.9 was aimed at and is not reached, and no exemplar was added for what is missed
    assert len(missed) <= 5


def test_public_exemplars_alone(frequencies):
    known = residue.Exemplars.of(residue.PUBLIC)
    found = sum(share(t, known, frequencies) > 0.5 for t in HELD_OUT)
    print(f"held out, by public exemplars alone: {found} of {len(HELD_OUT)}")
    assert found >= 0.75 * len(HELD_OUT)


def test_exemplars_left_out_once(frequencies):
    whole = residue.all_exemplars()
    found = total = 0
    for kind in ("filler", "error", "scripts"):
        lines = [s for line in whole[kind].strip().splitlines() for s in re.split(r"(?<=[.!?。！？])\s*", line.strip()) if len(residue.tokens(s)) >= 4]
        for i, line in enumerate(lines):
            rest = residue.Exemplars.of({**whole, kind: "\n".join(x for j, x in enumerate(lines) if j != i and x != line)})
            total += 1
            found += share(line, rest, frequencies) > 0.5
    print(f"left out once: {found} of {total}")
    assert found >= 0.45 * total


def test_books_that_quote_notices_stay(frequencies):
    known = residue.Exemplars.of(residue.all_exemplars())
    assert [t for t in BOOK if share(t, known, frequencies) > 0.4] == []
    quoting = BOOK[0] + " " + BOOK[1] + " JavaScript is required to view this content. " + BOOK[2]
    assert share(quoting, known, frequencies) <= 0.5

"""Wordings outside the tables of residue. DEVELOPED ones were used to widen the tables (of the first 40, 26 were found where repeated before that, of the next 42 also 26); HELD_OUT ones were written after that and changed nothing."""

import pyarrow as pa

from quillspark.llm import residue as R

DEVELOPED = [
    "Pagina non trovata.", "Этот сайт требует включения JavaScript.", "Cannot read properties of null", "Segmentation fault (core dumped)", "Please turn on scripting to use this viewer.", "Il server non risponde, riprova più tardi.",
    "Votre navigateur n'est pas pris en charge.", "Diese Website verwendet Cookies, bitte stimmen Sie zu.", "La sesión ha caducado, vuelva a iniciar sesión.", "Strona nie istnieje.", "De pagina kon niet worden geladen.",
    "Sidan kunde inte hittas.", "Доступ запрещён.", "网页无法访问。", "このページは存在しません。", "ERR_CONNECTION_REFUSED", "This site can’t be reached.", "You are being redirected to the login page.", "Unhandled exception at line 44 of reader.js",
    "Warning: mysql_connect() failed", "The requested URL was rejected.", "Out of memory.", "Proxy authentication required", "The image viewer failed to initialise.", "We use cookies to improve your experience.", "Loading, please wait...",
    "This content is not available in your region.", "Sorry, nothing matched your request.", "Type your text in this box.", "Put the description of the work here.", "Dolor sit amet, consectetur adipiscing elit.", "Add a caption here",
    "Ten tekst jest tylko przykładowy.", "Questo è un testo segnaposto.", "Hier kommt noch Text hin.", "SyntaxError: Unexpected token < in JSON at position 0", "object is not iterable",
    "The server encountered a temporary error and could not complete your request.", "Ihre Sitzung ist abgelaufen.", "WebGL is needed to show the facsimile.",
    "The article you requested has been deleted.", "Your connection is not private.", "Access restricted to subscribers.", "JavaScript appears to be turned off.", "Fetch failed: network unreachable", "Internal error, please notify the site owner.",
    "Unable to retrieve the transcription.", "Session closed by remote host.", "No such file or directory", "Image not available", "Insert chapter title here", "Text text text text.", "Your browser is no longer supported.",
    "500 - something broke on our side", "panic: runtime error: index out of range", "Query execution was interrupted", "Enable popups to open the facsimile.", "Le serveur a rencontré une erreur.", "Accès refusé.", "Texte à venir.",
    "JavaScript est désactivé.", "Zugriff verweigert.", "Der Server antwortet nicht.", "Bitte laden Sie die Seite neu.", "Beispieltext.", "Acceso denegado.", "El servidor no responde.", "Texto de prueba.", "Accesso negato.",
    "JavaScript è disabilitato nel tuo browser.", "Página não encontrada.", "O servidor não respondeu.", "Страница не найдена.", "Включите JavaScript в браузере.", "Pagina niet gevonden.", "Brak dostępu do strony.", "Sidan saknas.",
    "Η σελίδα δεν βρέθηκε.", "アクセスが拒否されました。", "访问被拒绝。", "페이지를 찾을 수 없습니다.", "الصفحة غير موجودة.",
]
HELD_OUT = [
    "Nothing to see here yet, check back soon.", "The link you followed may be broken.", "Verification required: prove you are human.", "Rendering stopped because a script is slow.", "Could not connect to the image server.", "408 Request Timeout",
    "Your account does not include this volume.", "IndexError: list index out of range", "Maximum call stack size exceeded", "We are sorry, this service is closed for maintenance.", "Replace with your abstract.", "Template text, do not publish.",
    "Lien mort ou page supprimée.", "Merci de patienter pendant le chargement.", "Votre session a expiré.", "Die angeforderte Seite existiert nicht mehr.", "Cookies sind in Ihrem Browser deaktiviert.", "Hier Text eingeben.", "Se ha producido un error inesperado.",
    "Debe activar JavaScript para ver el texto.", "Introduzca aquí el título.", "Impossibile caricare il documento.", "Contenuto in preparazione.", "Não foi possível abrir o ficheiro.", "Ative o JavaScript no navegador.", "Ошибка загрузки страницы.", "Попробуйте позже.",
    "Włącz JavaScript, aby przeczytać tekst.", "Deze dienst is tijdelijk niet beschikbaar.", "Ett fel har inträffat.", "Sayfa bulunamadı.", "Stránka nebyla nalezena.", "Ο διακομιστής δεν απαντά.", "サーバーに接続できません。", "请启用浏览器脚本。", "오류가 발생했습니다.", "حدث خطأ في الخادم.",
]
CONTENT = [
    "The page of the second codex was torn, and Brown could not read it.", "The server of the altar was denied his share by the abbot.", "Smith made a request for the charter in 1204.", "An error in the line shows that the scribe was tired.",
    "Access to the cloister was forbidden to laymen by Abbot Hugo.", "He wrote the text of the sermon on the last page.", "The connection between the two manuscripts is not found in the stemma of Lake.",
    "No person could open the chest without the permission of the bishop.", "The sessions of the council were moved to Basel.", "La page manque dans le manuscrit de Lyon.", "Die Seite fehlt in der Handschrift.", "Pagina prima vacat.",
    "There is an error on this page of the text.", "Quod est impossibile.", "Hoc necessarium est.", "Error impossibilis est.", "The content of the page is missing in one of the witnesses.",
    "The version of Hall has a different order of chapters.", "The content of the letter is lost.", "Please God, said the monk, let me return to my house.",
]


def verdicts(sentences, seen, alone=0):
    return [any(R.is_residue(m, seen, alone) for m in R.cued_messages(t)) for t in sentences]


def test_held_out_wordings():
    """Both figures are told in the README; the tables must not be changed to meet them."""
    alone, repeated = (sum(verdicts(HELD_OUT, n)) for n in (1, R.SUPPORT))
    assert len(HELD_OUT) == 37 and alone >= 19 and repeated >= 21 and sum(verdicts(HELD_OUT, 1, 1)) >= 21
    assert sum(verdicts(DEVELOPED, R.SUPPORT)) >= 78
    assert sum(verdicts(CONTENT, 1)) == 0
    # what scholars say in these words is residue only where three documents repeat it word for word
    assert [t for t, v in zip(CONTENT, verdicts(CONTENT, R.SUPPORT), strict=True) if v] == ["There is an error on this page of the text."]

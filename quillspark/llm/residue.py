"""Texts that are, or contain, what a template, a server or a viewer left in place of content.

Sentences with any word of a notice are masked (numbers, request ids, names)
and mined for message templates by a prefix tree: the number of tokens, then
the first tokens, then the most similar template of that leaf. A leaf of very
many messages is dealt out by more of its tokens, which changes no template:
pieces in which messages may be similar are mined as one. Messages that speak of
names or manuscripts have leaves of their own. Each template is classified once, by what
its messages show together: the kinds of words of a notice in several
languages, how much of the message these make up, the wordings of a list, the
names it holds, in how many documents the template stands and in how many
notices are all there is. A message with
strong marks is residue wherever it stands; weak marks count only where their
template is repeated. The verdict holds for all messages under the template.
Unfilled slots are looked for apart from that, in the text of every record.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.lookalike import canonical_forms
from quillspark.session import checkpoint_dir, spread

DEPTH = 2
#: Depths at which a leaf of more than ``LEAF_ROWS`` distinct messages is split again; no result depends on it.
DEEPER = (4, 8, 16)
LEAF_ROWS = 2_000
#: Messages that may differ in more tokens than this are looked up by single blocks of tokens, others by two blocks at once.
PAIRED = 6
SIMILAR = 0.7
#: Marks that make a template residue alone, and in at least ``SUPPORT`` documents.
ALONE, REPEATED, SUPPORT = 3.5, 2.5, 3
#: Tokens of a short message.
SHORT = 6
#: Share of a text that notices must have to be its whole content; marks enough for a repeated template are enough where most of its messages stand so.
WHOLE = 0.8
WILD = "<*>"

# Syntaxes of unfilled slots, by what a text must hold for any of them to match.
SLOTS = {
    "{": r"\{\{\{?(?:[^{}\n]|\n(?!\s*\n)){1,300}?\}\}|\{%(?:[^{}\n]|\n(?!\s*\n)){1,300}?%\}|[$#]\{(?:[^{}\n]|\n(?!\s*\n)){1,300}?\}|\{(?:[0-9]{1,2}|[A-Za-z]+(?:[_.][A-Za-z]+)+)\}",
    "<": r"<%(?:[^<>\n]|\n(?!\s*\n)){1,300}?%>|<\?(?:[^<>\n]|\n(?!\s*\n)){1,300}?\?>|<<[A-Za-z][^<>|\n]{0,60}>>|<[A-Za-z][\w. ]{0,60}>",
    "&lt;": r"&lt;/?[A-Za-z][\w. ]{0,60}&gt;",
    "$": r"\$[A-Za-z][A-Za-z_]*\$",
    "__": r"(?<!\w)__\w[\w. ]{0,60}?__(?!\w)|(?<!\w)_{4,}(?!\w)",
    "%": r"%[A-Za-z][\w.]{0,60}%|%\([A-Za-z]\w*\)[sd]|(?<![\w%])%[sd](?!\w)",
    "@": r"@@[A-Za-z]\w{0,60}@@|(?<!\w)@[A-Za-z][\w.]{0,60}@(?!\w)",
    "#": r"(?<![\w#])#[A-Za-z][\w.]{0,60}#(?!\w)",
    ":": r"(?:(?<=\s)|^):[a-z][a-z_.]{0,60}:(?![\w:])",
    "[": r"\[\[(?:[^\[\]\n]|\n(?!\s*\n)){1,300}?\]\]|\[(?i:your|insert|enter|add|type) (?:[^\[\]\n]|\n(?!\s*\n)){1,300}?\]|\[(?:[^\[\]\n]|\n(?!\s*\n)){1,300}? (?i:(?:goes |comes )?here|à compléter|à remplir|hier einfügen|einfügen|aquí)\]",
    "TBD": r"\bTBD(?:_\w+)?\b",
    "TODO": r"\bTODO(?:_\w+)?\b",
    "FIXME": r"\bFIXME\b",
    "YYYY": r"\bYYYY-MM-DD\b",
    "NAME SURNAME": r"\bNAME SURNAME\b",
    "undefined": r"(?<!\w)undefined, |\b(?:vol|no|p)\. undefined\b",
    "NaN": r"\b(?:vol|no|p)\. NaN\b",
    " null": r"\b(?:vol|no|p)\. null\b",
}
_SLOTS = [(held, re.compile(pattern)) for held, pattern in SLOTS.items()]

# Words of notices by kind, in the languages of servers and viewers. A word begins where no letter is before it (in scripts with spaces); one with a full stop behind it also ends there.
WORDS = {
    "machine": (
        "javascript|java script|popup|pop-up|network|host.|hostname|localhost|directory|query|cache|token.|kernel|disk space|quota|certificate|ssl|tls.|api.|endpoint|debug|config|bug.|crash|panic:|browser|cookie|http|https|url.|urls.|server|website|web site|web page|webpage|webmaster|nginx|apache|html.|css.|php.|sql|json|xml.|noscript|script.|scripts.|plugin|plug-in|add-on|captcha|login|log in.|logged in|sign in.|signed in"
        "|password|traceback|stack trace|exception|segmentation fault|core dumped|null.|nullpointer|undefined|nan.|runtime|timeout|timed out|time-out|proxy|gateway|firewall|database|dns|domain|internet|webgl|wi-fi|email|e-mail|newsletter|subscribe|offline|online|download|upload|app.|apps.|software|adblock|ad blocker|robot"
        "|navigateur|navigator|navegador|explorador|webseite|website|internetseite|datenbank|zugriff|zeitüberschreitung|base de données|base de datos|sitio web|site web|serveur|servidor|contraseña|mot de passe|passwort|anmelden|se connecter|iniciar sesión"
        "|sito web|password|accedi|accesso negato|rete.|finestra del browser|réseau|netzwerk|red.|rede.|sieć|nätverk|netwerk|browser|przeglądark|serwer|witryn|zaloguj|webbläsar|webbplats|webbsida|prohlížeč|tarayıcı|sunucu|nettleser|selain|verkkosivu|böngésző|περιηγητή|διακομιστή|ιστοσελίδ|ιστότοπ"
        "|браузер|сервер|сайт|веб-сайт|кукис|веб-|скрипт|войти|пароль|база данных|базе данных|базы данных|浏览器|瀏覽器|服务器|伺服器|網站|网站|網頁|网页|登录|登入|數據庫|数据库|ブラウザ|サーバ|サイト|ウェブ|ログイン|データベース|브라우저|서버|웹|로그인|متصفح|الخادم|دפדפן|שרת|ब्राउज़र|सर्वर",
        2.5,
    ),
    "thing": (
        "page.|pages.|site.|article|image.|images.|archive|record.|records.|item.|retrieve|fetch|display|render|reply|response.|subscriber|region|device|screen|transcription|facsimile|results.|search.|box.|form.|field.|caption.|title.|description|file.|request|session|access.|account|content.|text.|paragraph|connection|service|module|resource|viewer|view.|link.|address|function.|line <0>|properties|variable|object|memory|process|operation|document.|feature|video|image|permission|security|version|reader.|edition."
        "|seite|datei|zugang|artikel|bild.|antwort|accès|article|réponse|acceso|respuesta|accesso|risposta|acesso|resposta|dostęp|odpowied|åtkomst|toegang|antwoord|přístup|erişim|πρόσβαση|доступ|ответ|anfrage|sitzung|verbindung|dienst|adresse|inhalt|text|ressource|fichier|requête|session|connexion|lien|adresse|contenu|ressource|archivo|solicitud|sesión|conexión|enlace|dirección|contenido|recurso|página|pagina|contenuto|richiesta|sessione|connessione|risorsa|indirizzo"
        "|página|ficheiro|arquivo|conteúdo|ligação|pedido|strona|strony|stronę|plik|treść|połączeni|żądani|sida.|sidan|innehåll|tjänst|bestand|inhoud|verbinding|verzoek|stránka|soubor|sayfa|dosya|σελίδα|αρχείο|περιεχόμενο|σύνδεση"
        "|страниц|файл|访问|訪問|存取|响应|アクセス|応答|接続|접근|접속|응답|الصفحه|запрос|сесси|соединени|подключени|содержимое|контент|адрес|ссылк|页面|頁面|文件|请求|請求|连接|連線|連接|內容|内容|会话|ページ|ファイル|リクエスト|接続|コンテンツ|セッション|페이지|파일|요청|연결|صفحة|الصفحة|الوصول|דף|הדף|पृष्ठ",
        1.0,
    ),
    "state": (
        "error|errors.|warning|deleted|removed|restricted|not private|not secure|insecure|unreachable|closed by|no such|broke.|broken|interrupted|no longer|turned off|out of range|not permitted|is down|is gone|no content|crashed|overloaded|too long|not valid|not recognised|not recognized|retired|withdrawn|suspended|banned|limit.|alert|fault|can't be reached|be reached|out of memory|nothing match|no match|no results|no data|is needed|are needed|is empty|not iterable|not defined|is not a function|not supported|not loaded|be loaded|being redirected|timed out|too old|try later|failed|failure|fails.|not found|could not be found|cannot be found|can't be found|no longer exist|does not exist|doesn't exist|not exist|denied|forbidden|not allowed|unauthori|not authori|unavailable|not available|temporarily|expired|has ended|disabled|turned off|switched off|is off.|blocked|required|requires|needs.|need to.|refused|rejected|invalid"
        "|missing.|unexpected|unable|cannot|can not|could not|couldn't|can't|was lost|interrupted|aborted|too many|too large|exceeded|bad request|not supported|unsupported|does not support|doesn't support|out of date|outdated|under construction|under maintenance|maintenance|coming soon|moved|has been removed|went wrong|something went|not responding|no response|not loaded|not load|exhausted|oops|uncaught|fatal"
        "|fehler|antwortet nicht|fehlt.|gelöscht|verschoben|eingeschränkt|unterbrochen|abgebrochen|nicht mehr|keine ergebnisse|in kürze|überlastet|nicht gefunden|konnte nicht|kann nicht|können nicht|nicht unterstützt|verweigert|verboten|nicht verfügbar|abgelaufen|deaktiviert|fehlgeschlagen|erforderlich|benötigt|gescheitert|nicht erreichbar|wartungsarbeiten|gesperrt|ungültig|erreur|ne répond pas|supprimé|déplacé|restreint|interrompu|bloqué|n’est plus|aucun résultat|à venir|bientôt|en cours de|introuvable|non trouvé|pas pris en charge|n'a pas pu|n'est pas disponible|n'est plus|n’existe pas|n'existe pas|refusé|interdit|indisponible|expiré|désactivé|échoué|échec|requis|nécessaire|impossible"
        "|error|no encontrad|no responde|eliminad|movid|restringid|interrumpid|bloquead|ya no|sin resultados|próximamente|ha ocurrido|ha fallado|fallo.|no es compatible|no está disponible|no puede|no existe|no se encontró|no se ha encontrado|no se pudo|denegad|prohibid|no disponible|caducado|expirad|desactivad|deshabilitad|requerid|necesari|errore|non trovat|non risponde|eliminat|spostat|limitat|interrott|bloccat|disabilitat|nessun risultato|prossimamente|si è verificato|fallit|non esiste|negato|vietato|non disponibile|scadut|disattivat|richiest|necessari|impossibile|manutenzione"
        "|erro.|não encontrad|não respond|eliminad|movid|interrompid|bloquead|nenhum resultado|em breve|ocorreu um|falhou|não foi possível|não pôde|não existe|negado|proibido|indisponível|expirou|desativad|błąd|nie znaleziono|brak.|nie odpowiada|usunięt|przeniesion|zablokowan|wkrótce|nie można|nie udało|nie istnieje|odmowa|zabronion|niedostępn|wygasł|wyłączon|fel.|hittas|saknas|svarar inte|borttagen|flyttad|misslyckades|kommer snart|ontbreekt|reageert niet|verwijderd|verplaatst|mislukt|binnenkort|hittades inte|kunde inte|kan inte|hindrad|finns inte|nekad|fout|niet gevonden|niet worden|kan niet|kon niet|niet beschikbaar|bestaat niet|geweigerd|verlopen|uitgeschakeld|chyba|nenalezen|hata.|bulunamadı|engellendi|σφάλμα|δεν βρέθηκε|δεν υπάρχει|απαγορεύ"
        "|ошибк|не найден|не отвечает|удален|удалён|перемещен|ограничен|прерван|заблокирован|скоро|отсутствует|δεν ανταποκρίνεται|αποτυχία|не существует|запрещ|отказано|недоступн|истекл|отключен|требует|не удалось|невозможно|错误|錯誤|未找到|找不到|不存在|拒绝|拒絕|禁止|无法|無法|过期|過期|失败|失敗|エラー|応答していません|削除|移動|制限|中断|準備中|已删除|已刪除|受限|中断|中斷|即将|即將|超时|超時|삭제|제한|실패|見つかりません|見つかりませんでした|存在しません|拒否|無効|できません|できませんでした|失敗|期限切れ|오류|찾을 수 없|거부|없습니다|خطأ|غير موجود|غير متاح|שגיאה|לא נמצא|त्रुटि|नहीं मिला",
        1.5,
    ),
    "order": (
        "please|enable|activate|turn on.|turn them on|switch on.|allow.|allowed.|try again|retry|reload|refresh|contact.|return to|go back|click|tap here|update your|upgrade your|check.|checking|verify|wait.|loading|redirecting|sorry|back to the|start page|home page|homepage"
        "|acceptez|consent|accept.|veuillez|merci de|activer|activez|autoriser|réessay|actualis|recharg|contactez|retour à|cliquez|chargement|désolé|bitte|aktivier|einschalten|stimmen sie|zustimmen|akzeptier|erlauben|versuchen sie|neu laden|kontaktieren|wenden sie sich|zurück zur|klicken|wird geladen|leider"
        "|por favor|habilit|active.|activar|permita|inténtelo|intente|vuelva a|recargue|actualice|póngase en contacto|haga clic|cargando|lo sentimos|per favore|si prega|abilita|attiva|riprova|ricarica|aggiorna|torna alla|clicca|caricamento|spiacenti"
        "|por favor|ative|tente novamente|recarregue|atualize|contacte|clique|carregando|desculpe|proszę|włącz|spróbuj|odśwież|kliknij|wczytywanie|przepraszamy|vänligen|aktivera|försök igen|ladda om|schakel|probeer|ververs|klik.|laden|povolte|zkuste|lütfen|etkinleştirin|παρακαλώ|ενεργοποιήστε|δοκιμάστε"
        "|пожалуйста|включите|разрешите|попробуйте|обновите|перезагрузите|обратитесь|вернуться|вернитесь|нажмите|загрузка|извините|включени|请|請|启用|啟用|重试|重試|刷新|返回|稍后|稍後|してください|有効|再読み込み|もう一度|お待ち|戻る|활성화|다시 시도|새로고침|يرجى|تفعيل|אנא|कृपया",
        1.0,
    ),
    "filler": (
        "lorem|ipsum dolor.|dolor sit amet|consectetur|adipiscing|placeholder|dummy text|coming soon|to follow.|tba.|tbc.|test text|test content|demo text|demo content|dummy copy|filler text|sample text|sample paragraph|example text|goes here|comes here|your text here|insert text|insert the|insert your|insert a.|add a.|add the.|put the.|put your.|type your.|type the.|enter the.|enter your.|write your.|your content|your own words|text will appear|content will appear|replace this|to be added|asdf|qwer|qwerty|foo bar|xxxx|test test|testing one|testing testing|blah blah|the quick brown fox"
        "|texte de remplissage|faux texte|texte fictif|remplacez|blindtext|platzhalter|beispieltext|beispielinhalt|probetext|testtext|texte d’exemple|texte d'exemple|texte de test|texto de prueba|texto de teste|testo d'esempio|mustertext|hier steht|hier folgt|hier kommt|texto de relleno|texto de ejemplo|texto ficticio|escriba aquí|inserte aquí|testo segnaposto|testo di prova|inserire qui|texto fictício|texto de exemplo|tekst zastępczy|przykładow|platshållar|exempeltext|vultekst|voorbeeldtekst|ukázkový text|örnek metin"
        "|текст-заполнитель|текст-рыба|рыбный текст|пример текста|замените этот|здесь будет|占位|示例文字|示例文本|在此输入|在此輸入|請輸入|ダミー|サンプルテキスト|ここに|입력하세요|예시 텍스트|نص تجريبي|نص بديل|טקסט דמה",
        3.0,
    ),
}

# Words of the wordings in RESIDUE; each of these has one, which a test tells.
CUES = (
    "javascript|browser|cookie|scripts|noscript|navegador|traceback|exception|error|fehler|erreur|status |nginx|gateway|server|denied|forbidden|permission|unavailable|try again|too many|reload"
    "|administrator|start page|portada|startseite|accueil|introuvable|demandée|encontrada|gefunden|die adresse|asked for|requested|expired|sign in|log in|connection|timeout|timed out|request|reference no|went wrong"
    "|not load|be shown|be displayed|not found|be found|見つかり|找不到|有効に|啟用|启用|lorem|goes here|your content|your own words|your text|sample |layout|placeholder|dummy|filler|test test|testing|asdf|qwer|xxx"
    "|keyerror|typeerror|valueerror|indexerror|runtimeerror|attributeerror|syntaxerror|stack trace|stacktrace|undefined|http |code |internal|bad |service |unauthori|authorized to|authorised to"
    "|home page|homepage|startpage|bitte prüfen|looking for|enable script|script must|with your own|を有効"
    "|remplissage|remplacez|relleno|escriba aquí|blindtext|steht später|platzhalter|占位|在此輸入|在此输入|ダミー|ここに"
).split("|")

# Wordings of notices, one mark of several; tokens are in lower case, numbers are <0>, ids <id>, names <name>.
RESIDUE = re.compile(
    "|".join(
        [
            # error pages
            r"traceback \(most recent|\b(?:key|type|value|index|runtime|attribute|syntax)error\b|\bfatal error\b|uncaught exception|stack ?trace|undefined (?:function|variable|index)",
            r"^(?:http |error |status |code |fehler |erreur |error:? )+<0>(?:[ :.]|$)|^<0> (?:not found|internal|bad |forbidden|unauthori|service |gateway|too many|error)",
            r"\bbad gateway\b|\bgateway time-?out\b|internal server error|\bnginx\b|service (?:is )?(?:temporarily )?unavailable|temporarily unavailable|too many requests|seconds and reload",
            r"^access (?:is )?(?:denied|forbidden)|permission denied|(?:you )?do(?:es)? not have (?:the )?permission|not authori[sz]ed to (?:view|see|open)",
            r"try again later|contact (?:the|your) (?:site )?administrator|back to the (?:start|home) ?page|vuelva a la portada|zurück zur startseite|retour(?:ner)? à l.accueil",
            r"^page introuvable|page demandée|página no encontrada|seite (?:wurde )?nicht gefunden|bitte prüfen (?:sie|<name>|<\*>) die|page you (?:asked for|requested|are looking for)|found on this server|^(?:the )?page (?:was |could )?not (?:be )?found\W*$",
            r"session (?:has |is )?expired|(?:sign|log) in again|(?:database )?connection (?:failed|refused|timed out)|timeout after <0>|no result for request|^reference no\. <id>|something went wrong|could not load th|ページは見つかり|找不到您|找不到該|找不到该",
            # required scripts and browser features
            r"(?:please |to |must )?enable (?:javascript|scripts?\b|cookies)|javascript (?:is |must be |has to be )(?:disabled|required|off|not |enabled|allowed|turned)|\bscripts? must be|(?:needs?|requires?) (?:javascript|cookies|scripts)",
            r"on in your browser|your browser (?:does not|doesn.t|is not|is too old|cannot)|checking your browser|update your browser|^noscript|parts of .* will not load|view cannot be (?:shown|displayed)",
            r"activ(?:er|ez|e|ar) javascript|(?:aktivieren|einschalten) (?:sie|<name>|<\*>) javascript|javascriptを有効|[啟启]用 ?javascript",
            # filler
            r"\blorem ipsum\b|\blorem\b.*\bipsum\b|(?:text|content|title) goes here|your (?:content|text) will appear|with your own (?:words|text)|^sample (?:paragraph|text)|for layout purposes|(?:placeholder|dummy|filler) text",
            r"\btest test test\b|testing one two|\basdf asdf\b|\bqwer qwer\b|\bx{3,}(?: x{2,})+\b|texte de remplissage|remplacez-le par|texto de relleno|escriba aquí su|\bblindtext\b|hier steht später|platzhaltertext",
            r"占位文字|占位符|請在此輸入|请在此输入|ダミーテキスト|ここに(?:本文|テキスト|文章)を入力",
        ]
    )
)
# A sentence that speaks of such things names people or manuscripts.
SPEAKS = re.compile(r"\b(?:of|to|so|as|by|from|that|and|where|when|with|de|par|según) <name>|\b(?:codex|copyist|manuscript|manuscrit|manuscrito|handschrift|scribe|colophon|charters?|bishop|abbot|witness(?:es)?|ipsam)\b")

# Capitals inside messages that are no names.
_KEEP = {"JavaScript", "Sie", "Blindtext", "Platzhaltertext", "Text", "Internal", "Server", "Error", "Not", "Found", "Gateway", "Edition", "Status", "Back"}
_ODD = re.compile("[\u0400-\u04ff\u00ad\u200b-\u200d\u2060\ufeff\uff01-\uff5e\ufb00-\ufb06\u2e80-\u2fdf\u0300-\u036f]|[A-Za-z][Α-ΡΤ-Χο]|[Α-ΡΤ-Χο][A-Za-z]")
_CUT = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*|\n")
_PARAGRAPHS = re.compile(r"\n\s*\n|\r\n\s*\r\n")
_NAME = re.compile(r"(?<=[a-zé,] )[A-ZÀ-Þ][a-zß-ÿ]+\b")
# Calls, names of files and of errors as programs write them.
_CODE = re.compile(r"\w\(\)|\b[a-z]+_[a-z_]+\b|\b\w+\.(?:js|php|py|html?|css|json|xml|aspx?|jsp|dll|exe)\b|\b[a-z]+error\b|\b0x[0-9a-f<>]+|\berr[_ ]|::|\w->\w")
_FILL_IN = re.compile(r"\b(?:add|put|insert|enter|type|write)\b.{0,60}\b(?:here|in this|below)\b|(?<!\w)(\w{3,})(?: \1){2,}(?!\w)")
_GERMAN = re.compile(r"\b(?:der|die|das|den|dem|und|nicht|bitte|sie|ist|ein|eine|zu|von)\b")
_ID = re.compile(r"\b(?=[0-9a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{6,}\b")
_NUMBER = re.compile(r"[0-9]+")


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    """Every word → its length, whether it must end there, and its kinds (none for words of the list)."""
    found: dict[str, tuple[bool, set[str]]] = {}
    for kind, (words, _) in WORDS.items():
        for word in words.split("|"):
            found.setdefault(word.rstrip("."), (word.endswith("."), set()))[1].add(kind)
    for cue in CUES:
        found.setdefault(cue, (False, set()))
    a = ahocorasick.Automaton()
    for word, (whole, kinds) in found.items():
        a.add_word(word, (word, whole, tuple(kinds)))
    a.make_automaton()
    return a


def _hits(low: str) -> Iterator[tuple[str, int, tuple[str, ...]]]:
    """(word, its place, its kinds): words begin where no letter of a script with spaces is before them."""
    for end, (word, whole, kinds) in _automaton().iter(low):
        at = end - len(word) + 1
        if at and low[at] < "\u2e80" and low[at].isalpha() and "\u2e80" > low[at - 1] and low[at - 1].isalpha():
            continue
        if whole and end + 1 < len(low) and low[end + 1].isalpha():
            continue
        yield word, at, kinds


def mask(sentence: str) -> str:
    """A message as its template's variables see it: names, ids and numbers masked, in lower case, blanks single."""
    s = _NAME.sub(lambda m: m[0] if m[0] in _KEEP or SPEAKS.search(m[0].lower()) or any(kinds for *_, kinds in _hits(m[0].lower())) else "<name>", sentence)
    s = _NUMBER.sub("<0>", _ID.sub("<id>", s.lower()))
    return " ".join(s.split())


def has_slot(text: str) -> bool:
    return any(held in text and pattern.search(text) is not None for held, pattern in _SLOTS)


def _has_cue(low: str) -> bool:
    """Whether a word of a notice is there."""
    return next(_hits(low), None) is not None


def marks(message: str) -> float:
    """How much in a masked message shows that it's a notice; below 0 where it speaks of names or manuscripts."""
    words: dict[str, dict[str, None]] = {}
    covered = 0
    reach = -1
    message = message.replace("’", "'")
    for word, at, kinds in sorted(_hits(message), key=lambda h: (h[1], -len(h[0]))):
        if kinds and at > reach:
            reach = at + len(word) - 1
            covered += len(word)
            for kind in kinds:
                words.setdefault(kind, {})[word] = None
    if _CODE.search(message):
        words.setdefault("machine", {})["code"] = None
    if _FILL_IN.search(message):
        words.setdefault("filler", {})["fill in"] = None
    found = sum(WORDS[kind][1] * min(len(own), 2) for kind, own in words.items())
    listed = RESIDUE.search(message) is not None
    tokens = message.count(" ") + 1
    if found and covered >= 0.4 * (len(message) - tokens):
        found += 1.0
    # things and states are also words of scholars: of one kind they're little, of both enough alone only in a short message
    if len(words) == 1 and not words.keys() & {"machine", "filler"}:
        found = min(found, 2.0)
    elif not words.keys() - {"thing", "state"} and tokens > SHORT:
        found = min(found, ALONE - 0.5)
    if listed:
        found += ALONE
    if SPEAKS.search(message):
        found -= 10.0
    if not _GERMAN.search(message):
        found -= 0.75 * min(message.count("<name>"), 3)
    return found - (2.0 if tokens > 40 else 0.0)


def noticed(text: str) -> tuple[list[str], bool]:
    """The masked sentences with a word of a notice, each once, and whether they are (nearly) all of the text."""
    messages: dict[str, None] = {}
    covered = 0
    if _has_cue(" ".join(text.lower().split())):  # words of two parts may be broken over a line
        for paragraph in _PARAGRAPHS.split(text):
            whole = " ".join(paragraph.split())
            if _has_cue(whole.lower()):
                for sentence in _CUT.split(whole):
                    if sentence and _has_cue(sentence.lower()):
                        messages[mask(sentence)] = None
                        covered += len(sentence)
    return list(messages), bool(messages) and covered >= WHOLE * len(" ".join(text.split()))


def cued_messages(text: str) -> list[str]:
    return noticed(text)[0]


def consistent(texts: list[str]) -> list[str]:
    """The texts, those with odd characters in their consistent form, paragraph by paragraph."""
    odd = [k for k, t in enumerate(texts) if _ODD.search(t)]
    parts = [_PARAGRAPHS.split(texts[k]) for k in odd]
    forms = iter(canonical_forms([p for own in parts for p in own])) if odd else iter(())
    out = list(texts)
    for k, own in zip(odd, parts, strict=True):
        out[k] = "\n\n".join(next(forms) for _ in own)
    return out


def scan(text: str) -> tuple[bool, list[str]]:
    """Whether the text has an unfilled slot, and its masked sentences with a cue word."""
    (text,) = consistent([text])
    return has_slot(text), cued_messages(text)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            ids, found, alone = [], [], []
            for i, text in zip(part.column(0).to_pylist(), consistent(part.column(1).to_pylist()), strict=True):
                if has_slot(text):
                    ids.append(i)
                    found.append(None)
                    alone.append(None)
                messages, whole = noticed(text)
                ids += [i] * len(messages)
                found += messages
                alone += [whole] * len(messages)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string()), pa.array(alone, pa.bool_())], names=["id", "message", "alone"])


class PrefixTree:
    """Templates of one leaf or of many: token count, first ``DEPTH`` tokens, then similarity.

    A wild card is like no token, so a message is as similar as that to every
    message of the template that takes it. Tokens are dealt to one block more
    than similar messages may differ in, so these have a block in common, by
    which templates are looked up; those left out have less than ``SIMILAR``.
    """

    def __init__(self) -> None:
        self.leaves: dict[tuple, tuple[list[list[str]], dict[int, list[int]]]] = {}

    def add(self, message: str) -> list[str]:
        """The template that takes the message; it may yet lose more of its tokens to wild cards."""
        tokens = message.split(" ")
        leaf, places = self.leaves.setdefault((SPEAKS.search(message) is not None, len(tokens), *tokens[:DEPTH]), ([], {}))
        many = int(len(tokens) * (1 - SIMILAR) + 1e-6) + 1
        blocks = [hash((k, *tokens[DEPTH + k :: many])) for k in range(many)]
        own = [None if t == WILD else t for t in tokens]
        best, most = None, 0.0
        for at in sorted({at for block in blocks for at in places.get(block, ())}):
            share = sum(map(operator.eq, leaf[at], own)) / len(own)
            if share > most:
                best, most = leaf[at], share
        if best is None or most < SIMILAR:
            for block in blocks:
                places.setdefault(block, []).append(len(leaf))
            leaf.append(tokens)
            return tokens
        best[:] = [a if a == b else WILD for a, b in zip(best, own, strict=True)]
        return best


def _verdict(found: float, seen: int, alone: int) -> bool:
    """On a template's marks, its documents and those of them that hold nothing else."""
    return found >= ALONE or (found >= REPEATED and (seen >= SUPPORT or 2 * alone > seen))


def is_residue(message: str, seen: int = 1, alone: int = 0) -> bool:
    """The verdict on a message that is alone under its template."""
    return _verdict(marks(message), seen, alone)


def _mine(table: pa.Table) -> pa.Table:
    """Distinct messages of one leaf with the documents that have them → each with its template, the template's documents and its verdict.

    A template has the marks of its most telling message, since merges may have
    taken the telling words, and the documents of all its messages; ``alone``
    tells in how many of these a message, with others, is the whole text.
    """
    table = table.sort_by("message")
    messages, seen, whole = (table.column(c).to_pylist() for c in ("message", "seen", "alone"))
    tree = PrefixTree()
    under = [tree.add(m) for m in messages]
    support: dict[int, int] = {}
    alone: dict[int, int] = {}
    most: dict[int, float] = {}
    for t, m, n, k in zip(under, messages, seen, whole, strict=True):
        support[id(t)] = support.get(id(t), 0) + n
        alone[id(t)] = alone.get(id(t), 0) + k
        most[id(t)] = max(most.get(id(t), -10.0), marks(m))
    verdict = {t: _verdict(found, support[t], alone[t]) for t, found in most.items()}
    return pa.table(
        [pa.array(messages, pa.string()), pa.array([" ".join(t) for t in under], pa.string()), pa.array([support[id(t)] for t in under], pa.int64()), pa.array([verdict[id(t)] for t in under], pa.bool_())],
        names=["message", "template", "documents", "residue"],
    )


def _scanned(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)
    checkpoint_dir(df.sparkSession)
    return spread(src, "id").mapInArrow(_scan_batches, "id long, message string, alone boolean").checkpoint()  # few rows; read several times, while scanning is costly


def _prefix(n: int) -> Column:
    """A message's token count and first ``n`` tokens."""
    tokens = F.split("message", " ")
    return F.concat_ws(" ", F.size(tokens).cast("string"), F.slice(tokens, 1, n))


def _leaves(messages: DataFrame) -> DataFrame:
    """Distinct messages with their leaf: token count and first ``DEPTH`` tokens, more of them where that leaf has more than ``LEAF_ROWS`` messages."""
    out = messages.withColumn("leaf", _prefix(DEPTH))
    for depth in DEEPER:
        full = out.groupBy("leaf").agg(F.count("*").alias("n__")).where(F.col("n__") > LEAF_ROWS)
        out = out.join(full, "leaf", "left").withColumn("leaf", F.when(F.col("n__").isNull(), F.col("leaf")).otherwise(_prefix(depth))).drop("n__")
    return out


def _joined(leaves: DataFrame) -> DataFrame:
    """The pieces of a split leaf, those in one again that may have similar messages in others of them.

    A template only takes messages similar to all it has, so the pieces left
    apart have the templates that they would have in the whole leaf. Similar
    messages have a block of tokens in common where there is one block more than
    they may differ in, and two blocks where there are two more.
    """
    unlike = F.floor(F.size("tokens") * (1 - SIMILAR) + 1e-6).cast("int")
    paired = unlike <= PAIRED
    many = unlike + F.when(paired, 2).otherwise(1)
    block = lambda k: F.xxhash64("root", k, F.filter("tokens", lambda _, i: (i >= DEPTH) & (i % F.col("many") == k)))
    pairs = F.flatten(F.transform("blocks", lambda b, i: F.transform(F.slice("blocks", i + 2, F.col("many")), lambda c: F.xxhash64(b, c))))
    pieces = leaves.select("leaf", _prefix(DEPTH).alias("root"), F.split("message", " ").alias("tokens")).where("leaf <> root")
    blocks = pieces.select("*", many.alias("many"), paired.alias("paired")).select("leaf", "many", "paired", F.transform(F.sequence(F.lit(0), F.col("many") - 1), block).alias("blocks"))
    keys = blocks.select(F.xxhash64("leaf").alias("piece"), F.explode(F.when(F.col("paired"), pairs).otherwise(F.col("blocks"))).alias("key"))
    same = Window.partitionBy("key")
    linked = keys.select("piece", (F.min("piece").over(same) < F.max("piece").over(same)).alias("linked")).where("linked").select("piece").distinct()
    return leaves.join(linked, F.xxhash64("leaf") == F.col("piece"), "left").withColumn("leaf", F.when(F.col("piece").isNull(), F.col("leaf")).otherwise(_prefix(DEPTH))).drop("piece")


def _templates(scanned: DataFrame) -> DataFrame:
    messages = scanned.where(F.col("message").isNotNull()).groupBy("message").agg(F.count("*").alias("seen"), F.count_if("alone").alias("alone"))
    return _joined(_leaves(messages)).groupBy("leaf").applyInArrow(_mine, "message string, template string, documents long, residue boolean")


def message_templates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (template, residue, messages, documents): the mined templates, their verdict, how many distinct messages they take and in how many documents they stand; templates of one wording but different verdicts stay apart."""
    return _templates(_scanned(df, id_col, text_col)).groupBy("template", "residue").agg(F.count("*").alias("messages"), F.max("documents").alias("documents"))


def residue_ids(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids, each once, of the rows whose text has an unfilled slot or a message under a residue template; null and empty texts have none."""
    scanned = _scanned(df, id_col, text_col)
    bad = _templates(scanned).where("residue").select("message")
    by_message = scanned.where(F.col("message").isNotNull()).join(bad, "message", "left_semi").select("id")
    slots = scanned.where(F.col("message").isNull()).select("id")
    return slots.unionByName(by_message).distinct().withColumnRenamed("id", id_col)


def without_residue(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` without the rows that ``residue_ids`` finds; rows with a null id stay."""
    bad = residue_ids(df, id_col, text_col).withColumnRenamed(id_col, "residue_id__")
    return df.join(bad, F.col(id_col).cast("long") == F.col("residue_id__"), "left_anti")

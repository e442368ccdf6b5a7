"""What a single line of a page is: a line of the story, or page furniture around it.

Word lists are fixed values of six languages, grouped by the kind of furniture. They answer only for lines that show
their kind by themselves; undecided lines are settled by the operators from what repeats across pages.
"""

from __future__ import annotations

import functools
import re
import unicodedata

from skeinfeed.llm.garbled import ungarbled

# Labels in front of links, tags, advertisements and credits, each followed by a colon.
_LABELS = (
    r"next|up next|also on this site|previous|watch(?: now)?|listen|read(?: also| more| next)?|also read|see also|related(?: stories)?|more(?: from| on)?|recommended|trending|most read|don[’']t miss|breaking(?: news)?|just in|live|in pictures|video|gallery|podcast"
    r"|filed under|tags?|topics?|keywords?|categor(?:y|ies)|skip to (?:story|content|main)|photo(?:s| desk)?|image|picture|illustration|graphic|credit|author|source|editor|sponsored|advertisement|ad|promoted|partner content|contact|share"
    r"|weiter|lesen sie (?:dazu|auch|mehr)|mehr (?:zum thema|dazu)|auch interessant|siehe auch|auch auf dieser seite|eilmeldung|zum (?:inhalt|text|artikel)|schlagw[oö]rter|schlagworte|stichw[oö]rter|stichworte|themen|anzeige|werbung|foto|bild|autor(?:in)?|video|quelle"
    r"|suivant|(?:à|a) lire(?: aussi)?|lire aussi|(?:à|a) voir(?: aussi)?|voir aussi|sur le même sujet|flash|dernière minute|en direct|aller (?:au|à l[’'])\s?\w+|mots[- ]clés|étiquettes|publicité|annonce|photo|crédit|auteur|vidéo"
    r"|siguiente|en vivo|lea (?:también|además)|le(?:er)? también|ver también|más(?: sobre)?|última hora|urgente|ir al (?:texto|contenido)|saltar al \w+|etiquetas|temas|publicidad|anuncio|foto|imagen|autor(?:a)?|crédito|vídeo"
    r"|తదుపరి|తాజా సమాచారం|తాజా వార్త|ఇవి కూడా చదవండి|ఇది కూడా చదవండి|ఇవీ చదవండి|ఇదీ చూడండి|ఇవీ చూడండి|సంబంధిత(?: వార్తలు)?|ట్యాగ్‌?(?:లు)?|ట్యాగులు|ప్రకటన|ఫొటో|ఫోటో|చిత్రం|రచన|చూడండి|వీడియో|కథనానికి వెళ్లండి|ప్రాయోజితం"
    r"|अगला|अगली(?: खबर)?|यह भी पढ़ें|यह भी देखें|ये भी पढ़ें|ताज़ा(?: खबर)?|ताजा(?: खबर)?|ब्रेकिंग(?: न्यूज़)?|संबंधित|टैग|विषय|विज्ञापन|फोटो|फ़ोटो|चित्र|लेखक|देखें|वीडियो|प्रायोजित|सामग्री पर जाएं|खबर पर जाएं"
)
# Phrases (lower case) that stand only in furniture: consent, mail and channels, sharing and comments, paywalls, law and contact, advertisements.
_PHRASES = (
    "we use cookies", "site uses cookies", "uses cookies for", "use of cookies", "partners place", "partners keep", "partners store", "accept | settings", "by staying here", "manage choices",
    "wir verwenden cookies", "verwendet cookies", "partner speichern", "auswahl ändern", "utilisons des cookies", "utilise des cookies", "partenaires gardent", "gérer mes choix", "usamos cookies", "utiliza cookies", "socios guardan", "gestionar opciones",
    "కుకీలను వాడుతుంది", "కుకీలు అవసరం", "ఎంపికలు మార్చండి", "कुकी का उपयोग", "कुकी रखते हैं", "विकल्प चुनें",
    "in your inbox", "stories by mail", "newsletter abonnieren", "newsletter bestellen", "per e-mail erhalten", "sign up for our", "sign up to our", "subscribe to our", "subscribe now", "readers who get", "on every platform", "follow us on", "join our whatsapp", "join our telegram", "join our channel",
    "వాట్సాప్ ఛానల్", "పాఠకుల్లో మీరూ", "ఛానల్‌లో చేరిపోండి", "व्हाट्सएप चैनल", "चैनल से जुड़ें", "recevez nos", "recevez notre", "lectores que reciben", "leser, die", "lecteurs qui reçoivent",
    "share this story", "share this article", "share this post", "left a comment", "comments are moderated", "partager cet article", "diesen beitrag teilen", "artikel teilen", "comparte esta noticia", "మిత్రులకు పంపండి", "కథనాన్ని పంచుకోండి", "खबर को साझा करें", "hat kommentiert", "a commenté", "ha comentado",
    "of your free stories", "log in to go on", "free articles left", "connectez-vous pour", "inicie sesión para",
    "all rights reserved", "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados", "సర్వహక్కులు", "सर्वाधिकार सुरक्षित", "registered title", "takes no responsibility for", "keine haftung für", "copying needs", "nachdruck nur mit", "reproduction interdite", "prohibida la copia",
    "అనుమతి లేకుండా వాడరాదు", "బాధ్యత వహించదు", "बिना अनुमति", "जिम्मेदार नहीं", "గోప్యతా విధానం", "गोपनीयता नीति", "terms of use privacy", "privacy policy", "impressum datenschutz", "mentions légales vie", "aviso legal privacidad", "నిబంధనలు గోప్యత", "उपयोग की शर्तें",
    "newsroom on 0", "newsroom on +", "send a correction", "correction with case", "can be reached at", "hinweise an pult", "hinweise an die redaktion", "hinweise bitte an", "écrivez à la rédaction", "une erreur ? bureau", "avisos a la mesa", "escriba a la redacción", "nearest stockist", "కార్యాలయాన్ని సంప్రదించండి",
    "continues below", "story continues", "also on this site", "ప్రకటన కోసం కేటాయించిన", "विज्ञापन का स्थान", "artikel geht weiter", "la suite après", "continúa debajo", "ad slot", "ట్రేడర్స్ సమర్పణ", "ट्रेडर्स की प्रस्तुति", "ఎదురుచూస్తున్నది ఇదే",
)
# Whole-line forms.
_WHOLE = (
    r"advertisement|anzeige|werbung|publicité|publicidad|ప్రకటన|विज्ञापन|sponsored|loading(?: comments)?(?:\.\.\.|…)?|back to top"
    r"|©.*|\(c\) .*|copyright .*"
    r"|[\d.,\s  ]+\s*(?:shares?|comments?|likes?|views?|mal geteilt|kommentare?|partages?|commentaires?|veces compartido|comentarios?|మంది పంచుకున్నారు|వ్యాఖ్యలు|बार साझा|टिप्पणियां|टिप्पणियाँ)(?:\s+[\d.,]+\s*\S+)?"
    r"|\d+ (?:min(?:ute)?s? read|min\.? lesezeit|min de lecture|min de lectura|నిమిషాల? పఠనం|मिनट में पढ़ें)\b.*|.*\b(?:min(?:ute)?s? read|min\.? lesezeit|min de lectur[ea])\b.{0,80}"
    r"|(?:last )?updated:? (?:\d+ (?:minutes?|hours?|days?) ago|at |on )?.{0,60}|published (?:on|at) .{0,50}|aktualisiert vor .*|mis à jour il y a .*|actualizado hace .*|.{0,40}నిమిషాల క్రితం.{0,60}|.{0,40}मिनट पहले.{0,60}"
    r"|(?:weather|wetter|météo|tiempo|el tiempo)\b.{0,40}:.{0,80}|.{1,60}వాతావరణం: .{0,60}|.{1,60}(?:का )?मौसम: .{0,60}|das wetter .{0,80}"
    r"|most read (?:in|today|this).{0,60}|meistgelesen.{0,60}|les plus lus.{0,60}|lo más leído.{0,60}|ఎక్కువ మంది చదివిన.{0,60}|.{1,50}(?:లో|में) (?:నేడు )?(?:ఎక్కువ మంది చదివినవి|सबसे ज्यादा पढ़ी).{0,60}"
    r"|by (?:our|the)\b.{0,70}\b(?:correspondent|reporter|desk|staff)\b.{0,60}|by [A-ZÀ-Þ][\w’'-]+ [A-ZÀ-Þ][\w’'-]+(?:,.{0,60})?|von unserem (?:reporter|korrespondenten).{0,60}|von unserer (?:reporterin|korrespondentin|redaktion).{0,60}|de (?:notre|nos) (?:correspondante?s?|envoyée?s?).{0,60}|de nuestr[ao] (?:redacción|corresponsal|enviad[ao]).{0,60}|.{1,40}(?:ప్రతినిధి|విలేకరి)(?:, .{1,50}| *)|.{1,40}(?:संवाददाता|प्रतिनिधि)(?:, .{1,50}| *)"
    r"|(?:reporting|written|edited|compiled|additional reporting) by .{1,120}|.{1,60}(?:, senior writer|, staff writer)\.?|.{1,50} covers .{1,60} for (?:this title|us|the).{0,80}|.{1,60}\bschreibt aus\b.{1,80}|.{1,60}\bécrit depuis\b.{1,80}|.{1,60}\bescribe desde\b.{1,80}|mit material von .{1,60}|(?:texte?|texto) (?:von|de|par) .{1,60}"
    r"|(?:call|ring|phone|mail|write to|contact) (?:the|us|our) .{1,80}\d{1,4}(?:-\d+)+"
    r"|follow .{1,50} on .{1,40}|join [\d,.]+ .{1,80}|[\d,.]+ మంది పాఠకుల.{1,60}|.{0,60}[\d,.]+ पाठक.{1,80}"
    r"|sponsored by .{1,80}|presented by .{1,80}|präsentiert von .{1,80}"
    r"|\d{1,3}\. (?!.*[.!?।]$).{5,150}"  # an entry of a ranking of links
)
_LABEL = re.compile(rf"(?:{_LABELS})\s?:\s*\S.*", re.I | re.S)
_LINE = re.compile(rf"(?:{_WHOLE})", re.I | re.S)
_CRUMBS = re.compile(r"[^>.!?]{1,60}(?:\s[>›»/]\s?.{1,120})+")
# Words of menus and foot lines, of which a line of two or more entries may consist.
_MENU_WORDS = re.compile(r"home|start|inicio|accueil|होम|होम पेज|హోమ్|nation|country|inland|país|pays|రాష్ట్రం|देश|sports?|deportes|ఆటలు|खेल|kultur|culture|cultura|cinema|చిత్రాలు|सिनेमा|మarkets|markets|cricket|terms of use|privacy|careers|contact|about(?: us)?|impressum|datenschutz|kontakt|mentions légales|vie privée|aviso legal|privacidad|contacto|agb|hilfe|help|login|సంప్రదించండి|గోప్యత|నిబంధనలు|संपर्क|गोपनीयता|शर्तें|हमारे बारे में|.{1,30} plus|.{1,30} ప్లస్|.{1,30} प्लस", re.I)
#: A sentence ends: closing mark, then closing quotes or brackets.
ENDS = re.compile(r"[.!?।॥…][\"'”“’»›)\]]*$")
_QUOTED = re.compile(r"[\"“„«‘]")
_FIGURES = re.compile(r"\d")
_ENTRIES = re.compile(r"\s*[|;]\s*|,\s+")
_MENU_PARTS = re.compile(r"\s*[|·•]\s*|\s{2,}|\t")


def tidy(line: str) -> str:
    """Blanks collapsed, garbling undone, composed."""
    return unicodedata.normalize("NFC", " ".join(ungarbled(line).split()))


def is_figures(line: str) -> bool:
    """A list of figures of the story: entries parted by bars or commas, most of them with a number."""
    if "|" not in line and "," not in line and ";" not in line:
        return False
    entries = [e for e in _ENTRIES.split(line) if e]
    return len(entries) >= 2 and sum(bool(_FIGURES.search(e)) for e in entries) * 2 > len(entries)


def is_menu(raw: str) -> bool:
    raw = raw.strip()
    if not ("|" in raw or "  " in raw or "·" in raw or "•" in raw or "\t" in raw):
        return False
    entries = [e.strip() for e in _MENU_PARTS.split(raw) if e.strip()]
    return len(entries) >= 2 and sum(bool(_MENU_WORDS.fullmatch(e)) for e in entries) * 2 >= len(entries) or (raw.count("|") >= 2 and not is_figures(raw) and not ENDS.search(raw))


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in _PHRASES:
        a.add_word(phrase, len(phrase))
    a.make_automaton()
    return a


_FOUND = None


def _has_phrase(text: str) -> bool:
    global _FOUND
    _FOUND = _FOUND or _automaton()
    return next(_FOUND.iter(text.lower()), None) is not None


def furniture(line: str) -> bool | None:
    """True for page furniture, False for a line of the story, None if the line does not show it by itself.

    Digits may be masked as 0. Blank lines give None; lines of any length are looked at whole.
    """
    return kind_of(ungarbled(line))


def kind_of(line: str) -> bool | None:
    """What furniture() says of a line without garbling."""
    return _kind_of_short(line) if len(line) <= 90 else _kind_of(line)


def _kind_of(line: str) -> bool | None:
    text = unicodedata.normalize("NFC", " ".join(line.split()))
    if not text:
        return None
    ended = ENDS.search(text[-12:]) is not None
    if ended and _QUOTED.match(text):
        return False  # speech
    if _LINE.fullmatch(text):
        return True
    # paragraphs of three and more whole sentences are prose, whatever words they hold
    if ended and len(_INNER_END.findall(text)) > 1:
        return False
    if _has_phrase(text) or is_menu(line):
        return True
    if ":" in text and _LABEL.fullmatch(text):
        return not (ended and is_figures(text))
    if is_figures(text):
        return False
    if not ended and (">" in text or "›" in text or "»" in text or "/" in text) and _CRUMBS.fullmatch(text):
        return True
    return False if ended else None


#: Short lines come back: what was found out about the latest is kept.
_kind_of_short = functools.lru_cache(maxsize=100_000)(_kind_of)


_INNER_END = re.compile(r"[.!?।][\"'”“’»)]*\s+\S")
#: Marks that feeds put where they cut a text.
CUT_MARK = re.compile(r"(?:\s*\[\s*\+?\s*(?:\d+\s*\w*|…|\.\.\.)\s*\]|\s*(?:\(\s*)?(?:read more|continue reading|weiterlesen|lire la suite|leer más|seguir leyendo|ఇంకా చదవండి|और पढ़ें)\s*\)?[.…»>]*)\s*$", re.I)


def without_mark(text: str) -> tuple[str, bool]:
    """The text before marks of a cut, and whether it bore one; outer blanks at the end are not kept."""
    text = text.rstrip()
    bare = text
    if (m := CUT_MARK.search(bare, max(0, len(bare) - 60))) is not None:
        bare = bare[: m.start()].rstrip()
    if bare.endswith("…"):
        bare = bare[:-1].rstrip()
    elif bare.endswith("..."):
        bare = bare[:-3].rstrip()
    return bare, bare != text


def runs_on(text: str) -> bool:
    """Whether an unended line shows it is prose: a mark of a cut, or a sentence that ended within it."""
    bare, marked = without_mark(text.rstrip())
    return marked or _INNER_END.search(bare) is not None

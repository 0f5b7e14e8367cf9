"""Template residue, filler, error pages and script notices standing where content should be.

Texts are taken apart into passages: sentences and lines, numbers and ids masked, unfilled slots
masked by one mark. Equal passages are one class. A small trusted seed comes from texts that are
nothing but residue: at most ``SEED_PASSAGES`` passages, each of which a grammar of residue covers
for the most part. The grammar sees no other text. Everything else is found by likeness: each class
has a SimHash of its letter grams; the sketch is partitioned into ``BANDS`` tables; classes that
share a table entry are compared by Hamming distance, then by the similarity of their grams; and the
trusted labels follow the links through the connected components, one ring of neighbours at a time,
until a ring is empty. A text that holds a labelled passage anywhere is a case.

A passage may run into its neighbours without a mark between them, so parts of a sentence that
begin or end at an inner capital, another script, a label or a list mark are passages, too, of up to
``PART`` characters. A part may get a label, but only a class that stands somewhere as a whole passage
passes it on: parts of one sentence lie within each other, and a chain of them would lead from the
residue at one end of a sentence to the content at its other end, and to all texts with that content.
For the same reason a label carries the core of the trusted passage that it comes from: what the grammar
names with words of its own, without the open ends of its rules, which may have run on into content.
A class gets the label only if it holds at least ``HELD`` of the core's grams, however many links away.

Nothing but the size of a ring reaches the driver. A class needs only one link to be labelled, so
where more than ``CROWD`` labelled classes share a table entry, they meet the others in shares that
double, and what one share labels is gone before the next.

Defined cases: null, empty and blank texts are no cases and have no neighbours; repeated texts share
their label and repeated ids give one row; an empty table gives an empty result; extra columns are
not read. Links between
passages neither of which is near any labelled one are never looked for. The tables meet a pair of
similarity 0.8 with a probability of 0.97, one of 0.9 with 0.9998 (tests measure both).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.structure import INVISIBLE
from sparkloom.session import cut_lineage, partitions_for, spread_out

#: Similarity of the letter grams of two passages that are near-duplicates, in thousandths.
PERMILLE = 800
#: Share of the grams of a label's core that a class must hold, in thousandths.
HELD = 500
#: Letters of a gram, most passages of a trusted text, share of a trusted passage that the grammar must cover, most characters of a part.
GRAM, SEED_PASSAGES, COVERED, PART = 4, 3, 0.8, 200
#: The sketch has BANDS * 16 bits; each 16 bits are the entry of one table.
LONGS = 12
BANDS = LONGS * 4
#: Hamming distance of the sketches of two passages of similarity 0.8: 116 expected, 10 standard deviation.
MAX_HAMMING = 170
#: Labelled classes of one table entry that meet the others of that entry at once.
CROWD = 200
#: Table rows of a ring, of 24 bytes each, that are sent to the others' tasks; more are shuffled.
BROADCAST_ROWS = 500_000
#: Sentences of up to this many characters are kept in case they come again; it changes no result.
CACHED = 300
#: The mark of a slot in a masked passage.
SLOT_MARK = "§"

# The grammar of residue. Texts are matched after plain(). Each rule follows strings of which a text
# must hold one for the rule to be tried; they only save time.

#: Names that slots of weak bracket styles have.
SLOT_NAMES = r"(?:(?:insert|your|enter|add)[ _-])?(?:(?:first|last|user|student|teacher|tool|course|lesson|file|company|full)[ _-]?)?(?:name|title|author|date|topic|course|lesson|answer|result|matrix|vector|step|body|intro|unit|level|student|tool|problem|question|value|url|link|email|address|city|text|content|heading|summary|image|user|subject)(?:[ _-]?[a-z]|[ _-]?\d+)?"
IDENT = r"(?:(?:insert|your) )?[a-z][a-z0-9]*(?:[ _.-][a-z0-9]+)*"
SLOT = "|".join(
    (
        rf"\{{{{\{{?\s*{IDENT}\s*\}}?\}}\}}",
        rf"\{{%=?\s*{IDENT}\s*%\}}",
        rf"<%=?\s*{IDENT}\s*%>",
        rf"%\({IDENT}\)[sd]",
        rf"[#$]\{{\s*{IDENT}\s*\}}",
        rf"@@{IDENT}@@",
        rf"%%{IDENT}%%",
        rf"<<\s*{IDENT}\s*>>",
        rf"\[\[\s*{IDENT}\s*\]\]",
        rf"(?<!\w)__{SLOT_NAMES}__(?!\w)",
        rf"(?<!\w)~{SLOT_NAMES}~(?!\w)",
        rf"\[(?:insert [a-z0-9_ ]+|{SLOT_NAMES})\](?!\()",
        rf"(?<![\\\w])\{{(?:insert [a-z0-9_ ]+|{SLOT_NAMES})\}}",
        rf"<(?:insert [a-z0-9_ ]+|{SLOT_NAMES})>",
    )
)
#: What stands before a slot that is only spoken about, or is code.
MENTION = re.compile(r"(?:replaces|replaced|such as|slot|reads|like|called|named|write|writes|syntax|means|marks|variable)\s*$|[`\\]\s*$|print\(\w*[\"'][^\"']*$|\b[fr]\"[^\"]*$|\\[a-z]+(?:\{[^\n]{0,40}\})*\{?$|[$]\s*$")
MENTIONED = re.compile(r"^\s*`|^\s*(?:by|is replaced|marks|denotes)\b|^\s*[$]")

#: Role marks and markup that look like weak slots.
MARKUP = re.compile(r"^<(?:user|tool|model|system|assistant|title|body|head|html|answer|step|image|link|text|summary|content|heading|name)>", re.I)

SCRIPTS = r"(?:java ?scripts?|js|scripts?|cookies?)(?: (?:and|und|et|y|&) (?:java ?scripts?|js|scripts?|cookies?))?"
THING = r"(?:page|site|app|worksheet|exercise|lesson|notebook|viewer|course|document|content|worksheet|video|player|sheet|application|article|demo version)"
FILLER = (
    ("sample|dummy|placeholder|filler|example|default", r"\b(?:(?:sample|dummy|placeholder|filler|example|default) (?:text|paragraph|heading|description|content|title)\b[.!]?\s*){1,}(?=$|[^a-z])"),
    ("here", r"\b(?:(?:your|some) )?(?:text|content|description|title) (?:goes )?here\b[.!]?"),
    ("this is a|this is some", r"\bthis is (?:a|an|some) (?:default|sample|placeholder|dummy|example) \w+\b"),
    ("with your own", r"\breplace (?:it|this|me|this text) with your own\b[\w ]*"),
    ("click here to", r"\bclick here to (?:edit|add|change)\b[^.\n]*"),
    ("untitled", r"\buntitled (?:document|page|lesson|sheet)\b\.?"),
    ("type something", r"\btype something to get started\b"),
    ("texte provisoire", r"\btexte provisoire\b[^.\n]*"),
    ("texto ", r"\btexto (?:de relleno|provisional|de ejemplo)\b[^.\n]*"),
    ("text", r"\b(?:blind|platzhalter|beispiel)text\b[^\n.]*(?:\.[^\n.]*füllt nur[^\n.]*)?"),
    ("hier steht", r"\bhier steht (?:später|spaeter|bald)\b[^.\n]*"),
    ("undefined|null|nan|none", r"(?:\b(?:undefined|null|nan|none)\b[\s/,]*){3,}|\bnan ?/ ?nan\b"),
    ("[object object]|#", r"\[object object\]|#(?:ref|name|value|div/0|num|null)[!?]|#n/a\b"),
    ("todo|tbd|fixme", r"(?:^|[\n.!?>] ?)(?:todo|tbd|fixme)\b ?[:\-–]? ?(?:write|add|insert|fill|\w+ (?:missing|will be added|to be|follows|comes)|[a-z]+ section)[^\n.]*"),
    (": to be ", r"\b\w+: to be (?:written|added|done|announced|defined)\b"),
    ("xxx", r"\bxxx \w+ xxx\b"),
    ("[|(|<|{", r"[\[(<{](?:insert|add|enter|put|your|fill in|describe) [a-z0-9_ ]{2,40}[\])>}]"),
    ("blank", r"\bpage (?:is )?(?:intentionally )?left blank\b"),
    ("coming soon", r"(?:^|[\n.!?>] ?)coming soon\b[.!]?"),
    ("this ", rf"\bthis {THING} (?:has not been written yet|is under construction|is empty|is still being written)\b"),
    ("content will be", r"\bcontent will be (?:available|added|published) (?:shortly|soon|later)\b"),
    ("check back", r"\bcheck back (?:later|soon)\b"),
    ("loading|please wait", r"\b(?:loading|please wait)(?:\.{3}|…| while)[^\n.]*"),
)
LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
MASH = frozenset("asdf asdfasdf qwer qwerty asdfg jkl hjkl blah bla foo bar baz qux xxx xxxx xyzzy sdfg fghj zxcv test".split())
#: Neighbouring words of these lists that are filler.
RUN = 4
ONES = b"\1" * RUN
STATUS = r"(?:not found|forbidden|unauthorized|bad gateway|bad request|service unavailable|internal server error|gateway time-?out|too many requests|request time-?out|moved permanently|method not allowed|gone)"
ERRORS = (
    ("<title|<h1|<html", rf"<(?:title|h1)>\s*[45]\d\d\b[^<]*</(?:title|h1)>|<html>.*?[45]\d\d {STATUS}.*?</html>"),
    ("http/", rf"\bhttp/\d(?:\.\d)? [45]\d\d\b(?: {STATUS})?(?:\s*(?:content-length|retry-after|server|date): ?\w+)*"),
    ("not found|forbidden|unauthorized|bad gateway|bad request|unavailable|internal server error|gateway time|too many requests|request time|moved permanently|not allowed|gone", rf"(?:^|[\n.!?>] ?|error:? |error code:? )[45]\d\d(?: -| –|:)? ?{STATUS}\b"),
    ("{", r"\{\s*\"(?:error|status)\":\s*(?:\{\s*\"(?:code|message)\"|\"error\"|[45]\d\d)[^\n]*?\}"),
    ("fehler|error|erreur|errore", r"\b(?:fehler|erreur|errore?|error) (?:code )?[45]\d\d ?: ?[^\n.]*"),
    ("die seite|la page|la página|the page|the requested", r"\b(?:die seite|la page demandée|la página|the page|the requested \w+|the page you \w+ for) (?:wurde (?:leider )?nicht gefunden|est introuvable|could not be (?:loaded|found|displayed)|has moved|no longer exists|does not exist|no se ha encontrado|(?:asked|looked|were looking) for (?:has|does|could))\b[^\n.]*"),
    ("find the page", r"\b(?:can't|cannot|can not|couldn't|could not) find the page\b[^\n.]*"),
    ("le service|der dienst|el servicio", r"\ble service est (?:\w+ )?indisponible\b|\bder dienst ist (?:\w+ )?nicht (?:verfügbar|erreichbar)\b|\bel servicio (?:\w+ )?no está (?:\w+ )?disponible\b"),
    ("too many requests|rate limit", r"\btoo many requests\b[.!]?(?: slow down[^\n.]*)?|\brate limit exceeded\b[^\n.]*"),
    ("error establishing", r"\berror establishing a (?:database connection|connection to the database)\b"),
    ("upstream", r"\bupstream (?:request failed|connect error|timed out)\b[^\n.]*"),
    ("timed out", r"\bconnection (?:has )?timed out\b[^\n.]*"),
    ("something went wrong|uh-oh|oops", r"\bsomething went wrong on our (?:side|end)\b|\b(?:uh-oh|oops|whoops)\b[.!,]"),
    ("server is", r"\bserver is (?:temporarily|currently) (?:unable|unavailable|overloaded|down)\b[^\n.]*"),
    ("this", rf"\byou (?:don't|do not) have (?:permission|access) to (?:view|open|read|access) this\b[^\n.]*"),
    ("denied", r"(?:^|[\n.!?>] ?)access (?:is )?denied\b[.!]?"),
    ("in", rf"\byou (?:must|need to|have to) (?:be signed in|be logged in|sign in|log in)\b[^\n.]*"),
    ("session|in again", r"\byour session (?:has|is) expired\b[^\n.]*|\bplease (?:log|sign) in again\b"),
    ("reached", r"\byou(?:'ve| have) reached (?:the|your) \w+ limit\b[^\n.]*"),
    ("not available in your", r"\bnot available in your (?:region|country)\b"),
    ("available", rf"\bthis {THING} is (?:no longer|not|currently not|temporarily not) available\b[^\n.]*"),
    ("traceback", r"\btraceback \(most recent call last\):[^\n]*(?:\n[^\n]*file \"[^\n]*)?(?:\s*[a-z]\w*error: ?[^\n]*)?"),
)
NOTICES = (
    ("script|js|cookie", rf"\b(?:please )?(?:enable|activate|allow|turn on|switch on|accept) {SCRIPTS}\b(?: (?:and|to|in|or|for)\b[^\n.]*)?"),
    ("script|js|cookie", rf"\b(?:you )?need to (?:enable|turn on|activate|allow|accept) {SCRIPTS}\b[^\n.]*"),
    ("script|js|cookie", rf"\b{SCRIPTS} (?:must|has to|have to|needs? to) be (?:allowed|enabled|turned on|activated|accepted)\b[^\n.]*"),
    ("script|js|cookie", rf"\b{SCRIPTS} (?:is|are) (?:required|disabled|needed|turned off)\b[^\n.]*"),
    ("script|js|cookie", rf"\bthis {THING} (?:requires|needs) {SCRIPTS}\b"),
    ("script|js|cookie", rf"\b(?:doesn't|does not|won't|will not|can't|cannot) (?:work|run|function|load)(?: properly)? without {SCRIPTS}\b"),
    ("in your browser", r"\bit seems to be (?:disabled|turned off|blocked) in your browser\b"),
    ("your browser", rf"\byour browser (?:does not|doesn't) support\b[^\n.]*|\byour browser is (?:out of date|outdated|not supported|too old)\b[^\n.]*"),
    ("checking your browser", r"\bchecking your browser before\b[^\n.]*"),
    ("human|robot", r"\bverify (?:that )?you are (?:a )?human\b[^\n.]*|\bprove you are not a robot\b"),
    ("script|js|cookie", rf"\bbitte aktivieren sie {SCRIPTS}\b[^\n.]*|\b{SCRIPTS} aktivieren, um\b[^\n.]*"),
    ("script|js|cookie", rf"\bveuillez activer {SCRIPTS}\b[^\n.]*"),
    ("script|js|cookie", rf"\b(?:activa|active|habilita|habilite|por favor,? activa) {SCRIPTS}\b[^\n.]*"),
    ("script|js|cookie", rf"\b(?:attiva|abilita) {SCRIPTS}\b[^\n.]*"),
    ("<noscript>", r"<noscript>[^<]*</noscript>"),
)
#: Sentences that are residue wherever they stand, with {things}, {scripts}, {states} and {parts} to fill in: further trusted examples.
THINGS = ("page", "site", "app", "lesson", "course", "exercise", "worksheet", "notebook", "viewer", "document", "content", "video", "sheet", "article", "application")
SCRIPTED = ("javascript", "js", "scripts", "cookies", "cookies and javascript", "javascript and cookies", "cookies and scripts")
STATES = ("not found", "forbidden", "unauthorized", "bad gateway", "bad request", "service unavailable", "internal server error", "gateway timeout", "gateway time-out", "too many requests", "request timeout", "method not allowed", "gone")
PARTS = ("intro", "introduction", "summary", "solution", "proof", "example", "diagram", "description", "answer", "text", "title", "content", "heading", "paragraph", "conclusion", "section", "body")
EXAMPLES = (
    "please enable {scripts} to view this {things}", "please enable {scripts} to continue", "enable {scripts} and reload", "enable {scripts} and reload the page", "you need to enable {scripts} to run this {things}",
    "you need to turn on {scripts} to run this {things}", "{scripts} must be allowed before the {things} can be shown", "{scripts} must be enabled to view this {things}", "{scripts} is required to view this {things}",
    "{scripts} is disabled in your browser", "this {things} requires {scripts}", "this {things} needs {scripts}", "it seems to be disabled in your browser", "this {things} does not work without {scripts}",
    "we're sorry but this {things} doesn't work without {scripts}", "<noscript>we're sorry but this {things} doesn't work without {scripts}.</noscript>", "<noscript>you need to enable {scripts} to run this {things}.</noscript>",
    "your browser does not support the embedded player", "your browser does not support this video", "your browser is out of date and cannot display this {things}", "your browser is not supported",
    "checking your browser before showing the {things}", "checking your browser before accessing the {things}", "verify that you are human to continue", "please verify you are a human", "prove you are not a robot",
    "bitte aktivieren sie {scripts}, um die seite anzuzeigen", "bitte aktivieren sie {scripts}, um die aufgabe anzuzeigen", "bitte aktivieren sie {scripts}, um fortzufahren", "veuillez activer {scripts} pour afficher cette page", "veuillez activer {scripts} pour continuer",
    "activa {scripts} en tu navegador para ver esta lección", "activa {scripts} en tu navegador para ver esta página", "habilita {scripts} para continuar", "attiva {scripts} nel tuo browser per vedere questa pagina",
    "0 {states}", "error 0: {states}", "0 - {states}", "http/0 0 {states}", "<html><head><title>0 {states}</title></head><body><center><h0>0 {states}</h0></center></body></html>", '{"error": {"code": 0, "message": "{states}"}}',
    '{"status": "error", "detail": "{states}", "request_id": "0"}', '{"status": 0, "error": "{states}"}', '{"error": "{states}"}', "the requested {things} could not be loaded", "the requested {things} could not be found",
    "the page you were looking for does not exist", "the page you asked for has moved or no longer exists", "we can't find the page you are looking for", "this {things} is no longer available", "this {things} is not available in your region",
    "fehler 0: die seite wurde nicht gefunden", "die seite wurde leider nicht gefunden", "der dienst ist derzeit nicht verfügbar", "erreur 0 : la page demandée est introuvable", "le service est momentanément indisponible",
    "error 0: no se ha encontrado la página", "el servicio no está disponible en este momento", "errore 0: pagina non trovata", "too many requests", "slow down and try again in a minute", "rate limit exceeded, retry after 0 s",
    "error establishing a database connection", "error establishing a connection to the database", "upstream request failed", "the connection has timed out", "something went wrong on our side", "sorry, something went wrong on our side",
    "the server is temporarily unable to handle the request", "you don't have permission to view this {things}", "access denied", "you must be signed in to read this {things}", "please log in to continue", "your session has expired", "please log in again",
    "you have reached the request limit", "please try again later", "traceback (most recent call last)", "sample text", "dummy text", "placeholder text", "filler text", "your text here", "text goes here", "your title here", "title goes here",
    "sample paragraph", "example heading", "sample text sample text sample text", "your text here your text here your text here", "this is a default description", "this is a sample page", "this is a placeholder", "replace it with your own words", "replace this text with your own",
    "click here to edit this paragraph and add your own content", "click here to add text", "untitled document", "type something to get started", "texte provisoire, à remplacer avant la publication", "texto de relleno, sustituir antes de publicar",
    "dies ist ein blindtext", "er sagt nichts aus und füllt nur die fläche", "hier steht später der text der übung", "hier steht bald ein text", "testo segnaposto", "undefined undefined undefined", "null null null", "nan nan nan", "nan / nan", "undefined", "[object object]",
    "[object object], [object object]", "#ref! #ref! #n/a", "#value!", "#div/0!", "todo: write {parts}", "todo: write the {parts} section", "todo: add {parts}", "todo {parts}", "fixme {parts} missing", "tbd - {parts} will be added later", "tbd", "{parts}: to be written", "{parts} to be added", "xxx {parts} xxx",
    "[insert {parts}]", "(insert {parts})", "<insert {parts} here>", "[add {parts} here]", "(your {parts} here)", "this page is intentionally left blank", "coming soon", "this {things} has not been written yet", "this {things} is under construction",
    "content will be available shortly", "content will be added soon", "check back later", "loading...", "loading", "please wait while the {things} starts", "please wait while the matrix viewer starts", "please wait",
)
FILLING = {"{things}": THINGS, "{scripts}": SCRIPTED, "{states}": STATES, "{parts}": PARTS}
SLOT_RE = re.compile(SLOT)
#: What runs on within a sentence or line in a rule; RULES have a group for each, and no other groups.
OPEN = re.compile(r"\[(?:\^\\n\.|\^\.\\n|\^\\n|\\w )\]\*\??")
RULES = [(tuple(needs.split("|")), re.compile(OPEN.sub(r"(\g<0>)", rule), re.S if rule.startswith("<") else 0)) for needs, rule in (*FILLER, *ERRORS, *NOTICES)]
NEEDS = sorted({n for needs, _ in RULES for n in needs})
SLOT_BEGINS = re.compile(r"[{<%#$@\[~_]")  # what every slot begins with
QUOTES = (("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"'))
CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f\x7f]")
CONTROL_BYTES = bytes((*range(9), *range(11, 32), 127))
BLANKS = re.compile(r"[^\S\n ][^\S\n]*| [^\S\n]+")  # all but single blanks
#: Where a sentence ends, as in SENTENCES, but with the mark that it ends with: an expression that begins with a set of characters is found much faster.
SENTENCE_ENDS = re.compile(r"[.!?…。！？\n<](?:(?<=\n)\n*|(?<=<)(?:user|model|tool|system|assistant)>|(?<=[.!?…。！？])[\"')\]]*\s+)", re.I)
SENTENCES = re.compile(r"(?<=[.!?…。！？])[\"')\]]*\s+|\n+|<(?:user|model|tool|system|assistant)>", re.I)
NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
HEX = re.compile(r"\b(?=[a-fA-F]*\d)[0-9a-fA-F]{6,}\b")
MEANT = re.compile(r"[^\W\d_]|[§#]")
WORD = re.compile(r"[^\W_]+")
DIGIT = re.compile(r"\d")
#: Blanks within a sentence after which another one may begin without a mark before it: at a capital, a label or list mark, another script.
BORDER = re.compile(r"\s(?:(?=[A-ZÀ-ÖØ-Þ][^\W\d_A-ZÀ-ÖØ-Þ])|(?=\*\*)|(?<=[:)>|*§]\s)|(?=(?:[^\w\s]+|\d+[.):]+)\s)|(?<=[\x00-ɏ]\s)(?=[^\x00-ɏ])|(?<=[^\x00-ɏ]\s)(?=[\x00-ɏ]))")


def byte_table(kinds: dict[str, str], other: str | None = None) -> bytes:
    """For bytes.translate(): the characters of each string become its mark, all others ``other``, or stay."""
    table = bytearray(range(256)) if other is None else bytearray(other.encode() * 256)
    for characters, mark in kinds.items():
        for c in characters:
            table[ord(c)] = ord(mark)
    return bytes(table)


# Conditions of UTF-8 bytes that all texts with a slot, a run of filler words, or an id meet; they only save time.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SLOT_BYTES = byte_table({"{<%#$@[~": "{", LETTERS + LETTERS.upper(): "a", "_": "_"}, ".")
WORD_BYTES = bytes(c if chr(c) in LETTERS + "0123456789" else 32 for c in range(256))
HEX_BYTES = byte_table({"0123456789abcdefABCDEF": "h"}, ".")
KNOWN_BYTES = frozenset(w.encode() for w in LOREM | MASH)


def readable(text: str) -> str:
    """Compatibility form with no invisible characters, single blanks, plain quotes; line breaks and case stay."""
    text = unicodedata.normalize("NFKC", text)
    if not text.isascii():
        text = INVISIBLE.sub("", text)
        for mark, plain_mark in QUOTES:
            text = text.replace(mark, plain_mark)
    text = text.replace("\r\n", "\n")
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw.translate(None, CONTROL_BYTES)) < len(raw):
        text = CONTROL.sub("", text)
    return BLANKS.sub(" ", text) if "  " in text or "\t" in text or not text.isascii() else text


def plain(text: str) -> str:
    """readable() without case."""
    return readable(text).casefold()


def slots(text: str) -> list[tuple[int, int]]:
    """Spans of slots that stand for content."""
    out, upto = [], 0
    for begin in SLOT_BEGINS.finditer(text):
        if begin.start() < upto or not (m := SLOT_RE.match(text, begin.start())):
            continue
        upto = m.end()
        before, after = text[max(0, m.start() - 60) : m.start()], text[m.end() : m.end() + 30]
        if MENTION.search(before) or MENTIONED.search(after):
            continue
        if MARKUP.match(m.group()) and (m.start() == 0 or text[m.start() - 1] == "\n" or f"</{m.group()[1:]}" in text or "<html" in text):
            continue
        out.append(m.span())
    return out


def runs(text: str, words: frozenset[str], least: int) -> list[tuple[int, int]]:
    """Spans of at least ``least`` neighbouring words of a list."""
    out, start, last, n = [], 0, 0, 0
    for m in WORD.finditer(text):
        if m.group() in words:
            start, n = (m.start(), 1) if not n else (start, n + 1)
            last = m.end()
        else:
            if n >= least:
                out.append((start, last))
            n = 0
    return out + [(start, last)] * (n >= least)


def examples() -> dict[str, str]:
    """EXAMPLES with everything filled in, each with its core: without what its {things} and {parts} are filled with."""
    out = {}
    for text in EXAMPLES:
        filled = [(text, text.replace("{things}", " ").replace("{parts}", " "))]
        for name, values in FILLING.items():
            filled = [(f.replace(name, v), core.replace(name, v)) for f, core in filled for v in (values if name in f else ("",))]
        out |= filled
    return out


def within(spans: list[tuple[int, int]], begin: int, end: int) -> list[tuple[int, int]]:
    """What sorted spans cover from begin to end, without overlaps."""
    out = []
    for a, b in spans:
        a, b = max(a, begin), min(b, end)
        if b > a:
            out.append((a, b))
            begin = b
    return out


def fixed(m: re.Match) -> list[tuple[int, int]]:
    """The spans of a rule's match without its open ends."""
    out, at = [], m.start()
    for a, b in sorted(span for span in m.regs[1:] if span[0] >= 0):
        out.append((at, a))
        at = b
    return [*out, (at, m.end())]


def covered(text: str) -> dict[int, str] | None:
    """The core of each sentence's class, if the grammar covers each sentence of a text for the most part and names something in it.

    ``text`` is plain() and masked; a slot covers its sentence, and the whole sentence is its core.
    """
    held_needs = {n for n in NEEDS if n in text}
    matches = [m for needs, rule in RULES if not held_needs.isdisjoint(needs) for m in rule.finditer(text)]
    spans, named = sorted(m.span() for m in matches), sorted(span for m in matches for span in fixed(m))
    at, out = 0, {}
    for end, following in [*(m.span() for m in SENTENCES.finditer(text)), (len(text), len(text))]:
        sentence = text[at:end]
        if MEANT.search(sentence):
            core = sentence
            if SLOT_MARK not in sentence:
                core = "".join(text[a:b] for a, b in within(named, at, end))
                if sum(b - a for a, b in within(spans, at, end)) < COVERED * len(sentence.strip()) or not MEANT.search(core):
                    return None
            out[class_id(masked(numbers_masked(sentence)))] = masked(numbers_masked(core))
        at = following
    return out


def with_slots_masked(text: str) -> str:
    """A readable() text with a mark for each slot that stands for content, and for each run of filler words."""
    low = text.casefold()
    raw = low.encode("utf-8", "surrogatepass")
    marks = raw.translate(SLOT_BYTES, b" \n(=")  # a mark that begins a slot, further ones, blanks, and a letter
    has_slots, has_runs = b"{a" in marks or b"__" in marks, ONES in bytes(map(KNOWN_BYTES.__contains__, raw.translate(WORD_BYTES).split()))
    if not has_slots and not has_runs:
        return text
    fillers = (LOREM, MASH) if has_runs else ()
    if len(low) != len(text):  # some letters have no single lower one
        text = low
    out, upto = [], 0
    for a, b in sorted((slots(low) if has_slots else []) + [span for known in fillers for span in runs(low, known, RUN)]):
        if a >= upto:
            out += [text[upto:a], f" {SLOT_MARK} "]
            upto = b
    return BLANKS.sub(" ", "".join((*out, text[upto:])))


def numbers_masked(text: str) -> str:
    """One spelling for all numbers and ids of a text."""
    if b"hhhhhh" in text.encode("utf-8", "surrogatepass").translate(HEX_BYTES):
        text = HEX.sub("0", text)
    return NUMBER.sub("0", text) if DIGIT.search(text) else text


def masked(passage: str) -> str:
    """What classes are made by: numbers masked, no case, no marks at the ends; empty without letters or marks."""
    out = passage.casefold().strip(" .!?,;:\"'…*_`|>-")
    return out if MEANT.search(out) else ""


def class_id(passage: str) -> int:
    return xxhash.xxh3_64_intdigest(passage) - (1 << 63)


@lru_cache(maxsize=100_000)
def pieces(sentence: str) -> tuple[tuple[int, str], tuple[tuple[int, str], ...]]:
    """Class and masked passage of a sentence whose numbers are masked, and of its parts where it may hold several. Sentences repeat."""
    key = masked(sentence)
    if not key:
        return (0, ""), ()
    parts = set()
    for m in BORDER.finditer(sentence):
        i = m.end()
        if i <= PART:
            parts.add(masked(sentence[:i]))
        if len(sentence) - i <= PART:
            parts.add(masked(sentence[i:]))
    return (class_id(key), key), tuple((class_id(p), p) for p in parts - {"", key})


def sentences(text: str) -> Iterator[str]:
    """What SENTENCES.split() gives."""
    at = 0
    for m in SENTENCE_ENDS.finditer(text):
        i = m.start()
        yield text[at : i if text[i] in "\n<" else i + 1]
        at = m.end()
    yield text[at:]


def passages(text: str) -> tuple[dict[int, str], dict[int, str]]:
    """The masked passages, by class, of a readable() text with its slots masked, and the parts of those that may hold several."""
    whole, parts = {}, {}
    for sentence in sentences(numbers_masked(text)):
        if sentence:
            (cid, key), more = pieces(sentence) if len(sentence) <= CACHED else pieces.__wrapped__(sentence)
            if key:
                whole[cid] = key
                parts.update(more)
    return whole, parts


def grams(passage: str, known: dict[str, list[int]]) -> set[int]:
    """Hashes of the letter grams within the padded words of a passage; ``known`` keeps those of words met before."""
    out: set[int] = set()
    for w in passage.split():
        held = known.get(w)
        if held is None:
            padded = f" {w} "
            held = [xxhash.xxh3_64_intdigest(padded[i : i + GRAM]) for i in range(max(1, len(padded) - GRAM + 1))]
            if len(known) > 100_000:
                known.clear()
            known[w] = held
        out.update(held)
    return out


#: Odd multipliers that spread one hash to several.
SPREAD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF for i in range(LONGS)], np.uint64)


class Sketcher:
    """SimHash of passages: every bit by the majority of the grams of its distinct words. Votes of words met before are kept."""

    def __init__(self, most: int = 50_000):
        self.most, self.known, self.votes, self.place = most, {}, np.zeros((1024, LONGS * 64), np.int16), {}

    def _word(self, w: str) -> int:
        i = self.place.get(w)
        if i is None:
            i = self.place[w] = len(self.place)
            if i >= len(self.votes):
                self.votes = np.concatenate((self.votes, np.zeros_like(self.votes)))
            hashes = np.array(sorted(grams(w, self.known)), np.uint64)
            total = np.zeros(LONGS * 64, np.int64)
            for at in range(0, len(hashes), 4096):  # a word may be very long
                with np.errstate(over="ignore"):
                    h = hashes[at : at + 4096, None] * SPREAD
                    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                    h ^= h >> np.uint64(29)
                total += 2 * np.unpackbits(np.ascontiguousarray(h).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64) - len(h)
            self.votes[i] = np.clip(total, -30_000, 30_000)
        return i

    def sketch(self, passage: str) -> np.ndarray:
        if len(self.place) > self.most:
            self.place.clear()
        words = sorted(set(passage.split()))
        if len(passage) < 16_000:  # fewer than 32,000 grams: no sum leaves 16 bits
            places = [self._word(w) for w in words]
            return np.packbits(self.votes[places].sum(axis=0, dtype=np.int16) > 0).view(np.int64)
        total = np.zeros(LONGS * 64, np.int64)
        for at in range(0, len(words), 1024):
            total += self.votes_of(words[at : at + 1024])
        return np.packbits(total > 0).view(np.int64)

    def votes_of(self, words: list[str]) -> np.ndarray:
        places = [self._word(w) for w in words]
        return self.votes[places].sum(axis=0, dtype=np.int64)


def similar(a: set[int], b: set[int]) -> bool:
    both = len(a & b)
    return both * 1000 >= PERMILLE * (len(a) + len(b) - both)


def holds(a: set[int], core: set[int]) -> bool:
    return len(a & core) * 1000 >= HELD * len(core)


def examine(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, cid, trusted, whole (not only a part), core (of trusted ones) of every passage of every text; passage: its string, with the first row of each class in a task's batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = readable(t.as_py() or "")
                text = with_slots_masked(text)
                whole, parts = passages(text)
                cores = covered(text.casefold()) if 0 < len(whole) <= SEED_PASSAGES else None
                for cid, p in (parts | whole).items():
                    out[0].append(i)
                    out[1].append(cid)
                    out[2].append(cores is not None and cid in whole)
                    out[3].append(cid in whole)
                    out[4].append(None if cid in told else p)
                    out[5].append((cores.get(cid) or p) if cores is not None and cid in whole else None)
                    told.add(cid)
                if len(told) > 1_000_000:
                    told.clear()
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "cid", "trusted", "whole", "passage", "core"])

    texts = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    return spread_out(texts).mapInArrow(run, "doc_id bigint, cid bigint, trusted boolean, whole boolean, passage string, core string")


def classes_of(examined: DataFrame) -> DataFrame:
    """cid, trusted, whole, n_grams, sketch, passage, core: one row a class, sketched once; the trusted examples are classes, too.

    Without a column ``whole`` all passages are whole, and without ``core`` the trusted ones are their own cores. Of several cores the shortest counts.
    """
    spark = examined.sparkSession
    examined = examined if "whole" in examined.columns else examined.withColumn("whole", F.lit(True))
    examined = examined if "core" in examined.columns else examined.withColumn("core", F.when(F.col("trusted"), F.col("passage")))
    normal = lambda t: masked(numbers_masked(with_slots_masked(t)))
    given = spark.createDataFrame(sorted({(class_id(p), True, True, p, normal(core) or p) for e, core in examples().items() if (p := normal(e))}), "cid bigint, trusted boolean, whole boolean, passage string, core string")
    shortest = F.min(F.when(F.col("core").isNotNull(), F.struct(F.length("core"), F.col("core"))))["core"]
    distinct = examined.select("cid", "trusted", "whole", "passage", "core").unionByName(given).groupBy("cid").agg(F.bool_or("trusted").alias("trusted"), F.bool_or("whole").alias("whole"), F.max("passage").alias("passage"), shortest.alias("core"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        sketcher = Sketcher()
        for b in batches:
            texts = b.column("passage").to_pylist()
            flat = np.concatenate([sketcher.sketch(p) for p in texts]) if texts else np.empty(0, np.int64)
            sketch = pa.FixedSizeListArray.from_arrays(pa.array(flat), LONGS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("trusted"), b.column("whole"), pa.array([len(grams(p, known)) for p in texts], pa.int32()), sketch, b.column("passage"), b.column("core")], names=["cid", "trusted", "whole", "n_grams", "sketch", "passage", "core"])

    # a fixed number of tasks, as a few bytes of text are much work
    return distinct.repartition(partitions_for(spark), "cid").mapInArrow(run, "cid bigint, trusted boolean, whole boolean, n_grams int, sketch array<bigint>, passage string, core string")


def size_class(n: Column) -> Column:
    """Sets of similarity 0.8 differ in size by a factor of 1.25 at most, so by one class at most."""
    return F.least(1 + F.floor(F.log(n.cast("double")) / float(np.log(1000 / PERMILLE)) + 1e-9), F.lit(62)).cast("bigint")


def table_rows(classes: DataFrame, side: str, beside: bool) -> DataFrame:
    """A row for each table: its number, the class' 16 bits and size as key; ``beside``: also under the neighbouring sizes."""
    longs = classes.select(F.col("cid").alias(f"cid_{side}"), size_class(F.col("n_grams")).alias("size"), F.posexplode("sketch").alias("at", "bits"))
    entry = lambda j: F.shiftleft(F.shiftrightunsigned("bits", 16 * j).bitwiseAND(F.lit(0xFFFF)) + F.shiftleft(F.col("at").cast("bigint") * 4 + j, 16), 6)
    return longs.select(f"cid_{side}", F.explode(F.array(*[entry(j) + F.col("size") + d for j in range(4) for d in ((-1, 0, 1) if beside else (0,))])).alias("key"))


def few(ids: DataFrame, n: int) -> DataFrame:
    """Ids to join with: sent to all tasks where they were counted as few, else shuffled."""
    return F.broadcast(ids) if n <= BROADCAST_ROWS else ids


def alike(met: DataFrame, start: DataFrame, others: DataFrame) -> DataFrame:
    """cid, core of the classes cid_b of ``met`` (cid_a, cid_b) that are near cid_a and hold its core: by the Hamming distance of the sketches, then by the grams.

    ``start`` and ``others`` are the classes that may stand on either side; where ``start`` has no core, all are let through.
    """
    named = lambda c, side: c.select(*[F.col(x).alias(f"{x}_{side}") for x in ("cid", "sketch", "passage", "core")])
    apart = sum((F.bit_count(F.get("sketch_a", F.lit(i)).bitwiseXOR(F.get("sketch_b", F.lit(i)))) for i in range(LONGS)), F.lit(0))
    near = met.join(named(start, "a"), "cid_a").join(named(others, "b"), "cid_b").filter(apart <= MAX_HAMMING)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for b in batches:
            done: set[tuple[int, str | None]] = set()  # one link with a core is enough
            for cid, x, y, core in zip(*(b.column(c).to_pylist() for c in ("cid_b", "passage_a", "passage_b", "core_a"))):
                if (cid, core) not in done and (SLOT_MARK in x) == (SLOT_MARK in y) and similar(grams(x, known), grams(y, known)) and (core is None or holds(grams(y, known), grams(core, known))):
                    done.add((cid, core))
            links = list(done)
            yield pa.RecordBatch.from_arrays([pa.array([cid for cid, _ in links], pa.int64()), pa.array([core for _, core in links], pa.string())], names=["cid", "core"])

    return near.select("cid_b", "passage_a", "passage_b", "core_a").mapInArrow(run, "cid bigint, core string")


def spread(classes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """cid of every class that a trusted label reaches through links of near-duplicates; all but the last class on the way are whole, and all hold the label's core.

    The table of classes is only ever scanned against what was counted as few: the labelled ones, and
    those that met one in a table.
    """
    trusted = classes.filter("trusted").select("cid", "core")
    reached = cut_lineage(trusted.select("cid"))
    ring, n_ring = trusted, reached.count()
    n_reached = n_ring
    while n_ring:
        first = cut_lineage(classes.filter("whole").drop("core").join(few(ring, 4 * n_ring), "cid"))  # a core is as long as some ids
        start = table_rows(first, "a", True)
        most = start.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n").alias("most")).first()["most"]
        if not most:  # only parts
            break
        small = n_ring * BANDS * 3 <= BROADCAST_ROWS
        ring, n_ring = None, 0
        done, share = 0.0, 1.0 if most <= crowd else crowd / most
        while done < 1.0:  # shares of the ring by a hash of the class
            place = F.shiftrightunsigned(F.xxhash64(F.lit(7), "cid_a"), 11) / float(1 << 53)
            part = start if share >= 1.0 else start.filter((place >= done) & (place < done + share))
            others = table_rows(classes.join(few(reached, n_reached), "cid", "left_anti"), "b", False)
            met = cut_lineage((F.broadcast(part) if small else part).join(others, "key").select("cid_a", "cid_b").distinct())
            n_met = met.count()
            done, share = done + share, min(2 * share, 1.0)
            if not n_met:
                continue
            beside = classes.join(few(met.select(F.col("cid_b").alias("cid")).distinct(), n_met), "cid", "left_semi")
            new = cut_lineage(alike(met, first, beside).groupBy("cid").agg(F.min("core").alias("core")))
            if n_new := new.count():
                reached, n_reached = cut_lineage(reached.unionByName(new.select("cid"))), n_reached + n_new
                ring, n_ring = new if ring is None else ring.unionByName(new), n_ring + n_new
    return reached


def labelled(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """doc_id, by_spread of every text that holds residue: by_spread unless it is of the trusted seed itself."""
    examined = cut_lineage(examine(documents, id_col, text_col))
    reached = spread(cut_lineage(classes_of(examined)), crowd)
    return examined.join(reached, "cid").groupBy("doc_id").agg((~F.bool_or("trusted")).alias("by_spread"))


def found(documents: DataFrame) -> DataFrame:
    """doc_id of each document that holds residue in place of content."""
    return labelled(documents).select("doc_id")


def report(documents: DataFrame) -> DataFrame:
    """Per source: documents, those of the trusted seed, and those found by spread."""
    return documents.join(labelled(documents), "doc_id", "left").groupBy("source").agg(
        F.count("*").alias("n_documents"), F.count_if(F.col("by_spread") == F.lit(False)).alias("n_seed"), F.count_if("by_spread").alias("n_spread")
    )


def exclude(documents: DataFrame) -> DataFrame:
    """The documents without residue, all columns kept; null and blank texts stay."""
    return documents.join(found(documents), "doc_id", "left_anti")

"""Personal information inside free text: email, phone, id_number, address, name.

High-recall generators propose overlapping spans with a kind: public formats for addresses and
numbers, and for names the shape of a name alone (runs of capital words with initials, particles
and inversions, words after a title, words beside a phrase that speaks of a person). Features of a
span's format and of its sentence go to one ensemble of boosted trees per kind, fitted on
`examples` and calibrated on examples made from other frames, names and streets. Frames come from
everyday sentences in four languages, values from syllables and public formats: nothing is taken
from the tables the operator runs on, so names, streets and sentences never seen are the normal
case. Spans above the kind's threshold are kept, the surest first where they overlap, and replaced
by typed placeholders.

The texts are scanned once, row by row, without a shuffle. Null and empty texts hold nothing; rows
with a null id are left out; rows repeated under one id give one row per kind; an empty table gives
no rows; columns beyond those named are ignored. Texts are processed whole.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import languages
from .boosting import Boosted

KINDS = ("email", "phone", "id_number", "address", "name")

#: Common given names of the four languages, lower case. A hint to the trees; no name needs to be among them.
GIVEN = set(
    "alice amelie andrea anna antonio aoife beatriz camille carlos carmen charlotte chloe christian claire clara daniel david elena elias emily emma felix fatima francois greta hannah hans heinrich helena henri ines ingrid isabel jacques james jan javier jean jorge jose juan julia jurgen karl katharina klaus lars laura lena lucia luis lukas maria marie martin matthias michael miguel mohammed nicolas nina olga olivier paula pedro peter pierre pilar priya rosa sabine sarah sofia sophie stefan susanne thomas ursula yuki".split()
)
#: Common endings of family names.
FAMILY = tuple("son sen mann berg stein ski sky ova ez ton ford well field worth ini elli etti eau meyer maier huber bauer wald smith".split())
#: Titles of persons.
TITLE = r"(?:Mr|Mrs|Ms|Mx|Miss|Dr|Prof|Frau|Herrn?|Señora?|Sra?|Doña|Don|Madame|Mme|Mlle|Monsieur|Signora?)"
STREET = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Terrace|Close|Court|Ct|Row|Wharf|Hill|Drive|Way|Place|Square|Sq|Gardens|Crescent|Boulevard|Blvd|Mews|Yard|Quay|Parade|Walk)"

_AT = r"(?:\s?@\s?|\s?[(\[{<]\s?(?:at|arroba)\s?[)\]}>]\s?|\s(?:at|arroba)\s)"
_DOT = r"(?:\.|\s?[(\[{<]\s?(?:dot|punkt|punto|point)\s?[)\]}>]\s?|\s(?:dot|punkt|punto|point)\s)"
_SPOKEN_DOT = r"(?:\s(?:dot|punkt|punto|point)\s)"
EMAIL = re.compile(rf"[\w+%*-]+(?:(?:\.|{_SPOKEN_DOT}|\s?[(\[]dot[)\]]\s?)[\w+%*-]+)*{_AT}[\w*-]+(?:{_DOT}[\w*-]+)*{_DOT}[A-Za-z]{{2,12}}\b", re.I)
PHONE = re.compile(r"(?<![\w.@/+:=-])(?:\+|\(?0{2})?\(?[\d*]{1,5}\)?(?:[ ./() -]{0,2}[\d*]{1,8}){1,7}(?:\s?(?:ext\.?|x|Durchwahl|poste)\s?\d{1,5})?(?![\w@/]|[.:-]\d)", re.I)
#: Only texts with a run of digits and separators can hold phone and identity numbers.
_NUMBERS = re.compile(r"[\d*][\d ().*/-]{4,}[\d*]")
ID = re.compile(
    r"(?<![\w@/.+-])(?:[A-Z]{2} ?[\d*]{2} ?[\d*]{2} ?[\d*]{2} ?[A-Z*]|[A-Z]{1,2}[\d*]{7}[A-Z]?|[XYZ]-?\d{7}-?[A-Z]|[\d*]{8}[- ]?[A-Z]|[\d*]{3}[- ][\d*]{2}[- ]\d{4}|\d{2,3}/[\d*]{3}/[\d*]{3,5}(?:/\d{2})?|[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})?|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}|\d{9,13})(?![\w@/]|[.-]\d)",
)
_TOWN = r"(?:,\s(?:\d{4,5}\s)?[^\W\d_][\w'’-]+(?:\s[A-ZÀ-Ý][\w'’-]+)?)?"
ADDRESS = [
    re.compile(rf"(?:\b(?:Flat|Apt\.?|Unit|Apartment)\s\d+[a-z]?,\s)?\b\d{{1,4}}[a-z]?\s(?:[^\W\d_][\w'’]+\s){{1,3}}{STREET}\b\.?{_TOWN}", re.I),
    re.compile(rf"\b[^\W\d_][\w'’]+\s(?:[^\W\d_][\w'’]+\s){{0,2}}{STREET},\s(?:no\.?|nr\.?|number)\s?\d+{_TOWN}", re.I),
    re.compile(rf"\b[^\W\d_]+(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|ufer|damm)\s\d{{1,4}}\s?[a-z]?\b{_TOWN}", re.I),
    re.compile(rf"\b\d{{1,4}}(?:\s(?:bis|ter))?,?\s(?:rue|avenue|quai|allée|boulevard|place|chemin|impasse|cours)\s(?:(?:des|du|de\sla|de|la|le)\s|de\sl['’]|d['’])?[^\W\d_][\w'’-]+{_TOWN}", re.I),
    re.compile(rf"\b(?:calle|plaza|avenida|av\.|avda\.?|paseo|camino|ronda|c/)\s?(?:de\s(?:la\s|los\s|las\s)?|del\s)?[^\W\d_][\w'’-]+,?\s\d{{1,4}}(?:,\s\d{{1,2}}\.?[ºª°]\s?[a-z])?{_TOWN}", re.I),
]
#: What a text holds if the pattern can match.
_NEEDS = (
    frozenset("street st avenue ave road rd lane ln terrace close court ct row wharf hill drive way place square sq gardens crescent boulevard blvd mews yard quay parade walk".split()), frozenset(["no", "nr", "number"]),
    re.compile(r"(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|ufer|damm)\s\d"), frozenset("rue avenue quai allée boulevard place chemin impasse cours".split()), frozenset("calle plaza avenida av avda paseo camino ronda c".split()),
)
_TITLES = set("mr mrs ms mx miss dr prof frau herr herrn señor señora sr sra doña don madame mme mlle monsieur signor signora".split())
_PARTICLE = r"(?:(?:von|van)(?:\sde[rn])?|de(?:\s(?:la|los))?|del|di|bin)"
_TOKEN = r"[^\W\d_][^\W\d_'’]+(?:-[^\W\d_][^\W\d_'’]+)?"
_CAPITAL = r"[A-ZÀ-ÖØ-Þ][^\W\d_'’]+(?:-[A-ZÀ-ÖØ-Þ][^\W\d_'’]+)?"
_RUN = re.compile(rf"[A-ZÀ-ÖØ-Þ](?<![\w@.-][A-ZÀ-ÖØ-Þ])[^\W\d_'’]+(?:-[A-ZÀ-ÖØ-Þ][^\W\d_'’]+)?(?:[ \t\xa0](?:{_CAPITAL}|[A-ZÀ-ÖØ-Þ](?:\.|\b)|{_PARTICLE}))+(?![\w@])")
_AFTER_COMMA = re.compile(rf"\s({_TOKEN})(?![\w@])")
_TITLED = re.compile(rf"\b{TITLE}\.?\s({_TOKEN}(?:\s{_TOKEN})?)", re.I)
_TOKENS = re.compile(rf"{_TOKEN}|[^\W\d_]\.?")

#: Phrases right before a name, by what they say: who somebody is, whom to turn to, a mere link.
IS_BEFORE = "name is|i am|i'm|spoke with|spoke to|talk with|talk to|talked with|talked to|met|reported by|signed by|written by|reviewed by|sent by|came from|comes from|regards|sincerely|thanks to|thank you|dear|hello|colleague|neighbour|friend|invite|according to|ich bin|ich heiße|mein name ist|sprich mit|gesprochen mit|treffen mit|grüße|liebe|lieber|hallo|kollege|kollegin|unterschrieben von|geschrieben von|geprüft von|danke an|laut|je suis|je m'appelle|mon nom est|parle à|parle avec|parlez à|parlez avec|parlé à|parlé avec|cordialement|bonjour|cher|chère|collègue|signé par|écrit par|relu par|merci à|selon|c'est|soy|me llamo|mi nombre es|habla con|hablé con|hablar con|saludos|hola|querido|querida|compañero|compañera|firmado por|escrito por|revisado por|invita a|gracias a|según".split("|")
ASK_BEFORE = "ask|contact|cc|tell|notify|speak to|speak with|frag|frage|fragen|fragt|frag bitte|fragen sie|fragen bitte|kontaktiere|demande à|demander à|demandez à|contacte|contacter|contactez|pregunta a|contacta|contacta a".split("|")
NOW_BEFORE = ["now", "jetzt", "ahora", "maintenant"]
LINK_BEFORE = "call by with from to for mit von an bei à avec par de con por a also or and auch oder und aussi ou et también o y".split()
#: What a person does, right after the name, and words that may come between.
DOES_AFTER = "who|own|owns|run|runs|lead|leads|manage|manages|maintain|maintains|wrote|writes|said|says|called|calls|asked|asks|lives|works|joined|joins|visits|signed|looks after|is in charge|is responsible|takes over|and i|betreut|leitet|führt|schrieb|schreibt|sagt|sagte|fragt|wohnt|arbeitet|kümmert|übernimmt|besucht|dirige|gère|suit|écrit|a écrit|dit|demande|habite|travaille|s'occupe|visite|qui|lleva|gestiona|escribió|escribe|dice|dijo|vive|trabaja|se encarga|visita".split("|")
_BETWEEN = "(?:(?:now|still|also|already|will|has|had) )?"
_IS, _ASK, _LINK = (tuple(f" {w}" for w in x) for x in (IS_BEFORE, ASK_BEFORE, NOW_BEFORE + LINK_BEFORE))
_DOES = re.compile(rf"[, ]*{_BETWEEN}(?:{'|'.join(DOES_AFTER)})\b", re.I)
_LAST_LINKS = "also or and auch oder und aussi ou et también o y".split()
_SHORT = rf"({_TOKEN}(?:[ \t](?:[^\W\d_]\.|{_PARTICLE}))?[ \t]{_TOKEN}|{_TOKEN}[ \t][^\W\d_]\.)(?![\w@])"
_NEAR, _LAST = re.compile(rf"[:,]?\s+{_SHORT}", re.I), re.compile(rf"\s{_SHORT}(?=[.!?]?\s*$|[.!?]\s)", re.I)
_DOES_WORDS = {w.split()[0].split("'")[0] for w in DOES_AFTER}
_FIRST = re.compile(rf"\s*{_SHORT},?\s{_BETWEEN}(?:{'|'.join(DOES_AFTER)})\b", re.I)
#: Words that make a run of capitals something other than a person.
_THING = set("street avenue road lane court close terrace square place hill row wharf park bridge station university college institute school ministry council committee bank hotel museum church hospital company group systems software server service team department office center centre project press club union ltd inc gmbh ag sa sarl corp api sdk os app suite edition version release manual guide report monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december north south east west new old saint lake mount river sea island city county republic kingdom states".split())
#: More closed-class words, that no name begins or ends with.
_FUNCTION = set(languages._SEED) | set("someone somebody anyone nobody everyone else jemand niemand quelqu personne alguien nadie on in by as at en la de about after before through between against without within unlike like plus per via then danach davor dazu ensuite sinon luego después not non no nicht pas so then now than over under into a an as but or if all both each some any more less only just here there den der ein mehr nur hier dann jetzt aber oder wir sie er tout tous plus moins ici alors mais ou elle ils todo más menos aquí entonces pero o ella ellos".split())

#: Cue words by kind, and words that mark a number of another sort.
CUES = {
    "phone": re.compile(r"\b(?:tel|tél|phones?|telefon\w*|téléphon\w*|teléfono|móvil|mobile|mobil|handy|cell|call(?:s|ing)?|on-call|ring|rufe?n?|anrufe?n?|appel\w*|llam\w*|reach|text me|hotline|fax|whatsapp|sms|dial|erreichbar|joign\w*|localiz\w*)\b", re.I),
    "id": re.compile(r"\b(?:id|insurance|passports?|pass|reisepass|pasaporte|passeport|dni|nie|nif|ssn|nino|steuer\w*|steuer-?id|tax\w*|fiscal\w*|sécu|sécurité|sociale?|national\w*|ausweis\w*|identi\w*|licen[cs]e|führerschein|permis|permiso|personal\w*|versicher\w*|seguridad|seguro|citizen|number is|iban)\b", re.I),
    "other": re.compile(r"\b(?:order|pedido|commande|bestellung|auftrag|checksum|hash|sha|commit|run|version|versión|fassung|ausgabe|build|release|catalogue|catalog|isbn|issn|serial|model|error|fehler|erreur|room|pin|port|bind|rows?|lines?|zeilen?|lignes?|filas?|ticket|invoice|rechnung|factura|facture|batch|lot|part|page|seite|chapter|items?|entries|seconds?|milli\w+|bytes|euros?|dollars?|percent|score|ratio|range|coordinates|sku|barcode|tracking|meter|timestamp)\b", re.I),
    "address": re.compile(r"\b(?:live|lives|living|moved|ship\w*|deliver\w*|post|postal|mail|send|address|adresse|anschrift|dirección|domicilio|wohn\w*|habit\w*|vivo|vive|vivir|domicile|envoy\w*|envi\w*|liefer\w*|paket|package|parcel|colis|paquete|visit|house|flat|home|warehouse|located|stored|sits|befindet|liegt|trouve|queda)\b", re.I),
    "mail": re.compile(r"\b(?:mail|e-?mail|correo|courriel|contact|kontakt\w*|login|account|send|write|schreib\w*|escrib\w*|écri\w*|adresse|reach|schick\w*|mand\w*|envoie\w*|invite|reply)\b", re.I),
}


#: Words that come before an address and are none of it.
_LEAD = re.compile(r"(?:(?:Vivo|Ich|I|[Jj]['’]habite|Postal:?)\s|(?:(?!rue|avenue|quai|allée|calle|plaza|avenida|boulevard|c/)[^\W\d_A-ZÀ-Ý][\w'’]*\s)(?=.*[A-ZÀ-Ý]))*")
_WORDS = re.compile(r"[^\W\d_]+")
_DOTS = {"dot", "punkt", "punto", "point"}
_AT_HOST = re.compile(r" at [\w-]+\.[a-z]")


def _family(token: str) -> bool:
    return any(p.lower().endswith(FAMILY) for p in token.split("-")) and len(token) >= 5


@cache
def _phrases() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in _LAST_LINKS:
        a.add_word(f" {w}", (len(w), _LAST))
    for w in ";/":
        a.add_word(w, (0, _LAST))
    for w in IS_BEFORE + ASK_BEFORE + NOW_BEFORE:
        a.add_word(w, (len(w), _NEAR))
    a.make_automaton()
    return a


def _names(text: str, low: str, words: set[str], at: list[int]) -> list[tuple[int, int]]:
    """Spans with the shape of a name. A run of capital words is proposed whole, and without words
    at its ends that may belong to the sentence; words of any case after a phrase that speaks of a
    person, after a title, and at the end of a sentence after a link."""
    out: list[tuple[int, int]] = []
    for m in _RUN.finditer(text):
        t = [(m.start() + t.start(), m.start() + t.end()) for t in _TOKENS.finditer(m[0])]
        for size in (2, 3, 4):
            for i in range(len(t) - size + 1):
                out.append((t[i][0], t[i + size - 1][1]))
    comma = text.find(", ")
    while comma >= 0:
        m = _AFTER_COMMA.match(text, comma + 1)
        if m:
            family = re.split(r"[^\w'’-]", text[at[bisect_right(at, comma) - 1] : comma])[-1]
            if family and family[0].isupper() == m[1][0].isupper() and re.fullmatch(_TOKEN, family):
                out.append((comma - len(family), m.end()))
        comma = text.find(", ", comma + 1)
    if not words.isdisjoint(_TITLES):
        for m in _TITLED.finditer(text):
            two = m[1].split()
            # a title with a capital name ends before a word in small letters
            cut = len(two[1]) + 1 if len(two) == 2 and (two[0][0].isupper() and two[1][0].islower() or two[1].lower() in _FUNCTION) else 0
            out.append((m.start(), m.end() - cut))
    if len(low) == len(text):
        for end, (size, pattern) in _phrases().iter(low):
            if size and (low[end - size : end - size + 1].isalnum() and low[end - size] != " " or low[end + 1 : end + 2].isalnum()):
                continue
            m = pattern.match(text, end + 1)
            if m:
                out.append(m.span(1))
    if not words.isdisjoint(_DOES_WORDS):
        for i in at[:-1]:
            m = _FIRST.match(text, i)
            if m:
                out.append(m.span(1))
    return [(a, b) for a, b in out if _FUNCTION.isdisjoint((w := low[a:b].replace(",", "").split())[:1] + w[-1:])]


def candidates(text: str, at: list[int] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every proposed span; spans may overlap. at: the borders of its sentences."""
    out: list[tuple[str, int, int]] = []
    low = text.lower()
    words = set(low.replace(".", " ").replace(",", " ").replace("(", " ").replace(";", " ").replace(":", " ").replace("'", " ").replace("’", " ").replace("!", " ").replace("?", " ").replace('"', " ").replace("-", " ").replace("/", " ").split())
    spoken = not words.isdisjoint(_DOTS)
    if "@" in text or "at)" in low or "at]" in low or "at}" in low or " at " in low and (spoken or _AT_HOST.search(low)) or "arroba" in words:
        out += [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    if _NUMBERS.search(text):
        for m in PHONE.finditer(text):
            if 7 <= sum(c.isdigit() or c == "*" for c in m[0]) <= 20:
                out.append(("phone", m.start(), m.end()))
        out += [("id_number", m.start(), m.end()) for m in ID.finditer(text)]
    for need, pattern in zip(_NEEDS, ADDRESS, strict=True):
        if not words.isdisjoint(need) if isinstance(need, frozenset) else need.search(low):
            out += [("address", m.start() + len(_LEAD.match(m[0])[0]), m.end()) for m in pattern.finditer(text)]
    out += [("name", a, b) for a, b in _names(text, low, words, at or borders(text))]
    return list(dict.fromkeys(out))


#: Where a sentence ends: at a stop before a capital or a line break, but not after an abbreviation.
_BORDER = re.compile(r"[.!?](?<!\bno[.!?])(?<!\bnr[.!?])(?<!\bTel[.!?])(?<!\bTél[.!?])(?<!\b[A-Z][.!?])(?=\s+[A-ZÀ-Ý¿\"])|\n")


def _name_features(text: str, a: int, b: int, before: str, after: str) -> list[float]:
    s = text[a:b]
    all_words = _TOKENS.findall(s)
    word = [w for w in all_words if not w.endswith(".") and len(w) > 1] or [""]
    title = bool(_TITLED.match(s))
    real = word[1:] if title and len(word) > 1 else word
    lower = [w.lower() for w in real]
    prior, following = _WORDS.findall(before)[-1:], _WORDS.findall(after)[:1]
    f = [
        len(word), len(all_words), len(all_words) - len(word), title, "," in s, "-" in s, s.isupper(), s.islower(), sum(w[:1].isupper() for w in real) / len(real),
        sum(w in _FUNCTION for w in lower), lower[0] in _FUNCTION, lower[-1] in _FUNCTION, lower[0] in GIVEN or lower[-1] in GIVEN and "," in s, _family(real[-1]) or _family(real[0]) and "," in s, any(w in _THING for w in lower), any(w in _DOES_WORDS for w in lower), sum(map(str.isupper, before + after)) / max(1, sum(map(str.isalpha, before + after))),
        min(map(len, real)), max(map(len, real)), len(real[0]), len(real[-1]), before.strip(" \"'“«(") == "", after.strip(" .!?\"'”»)") == "",
        (left := " " + before.lower().rstrip(" ,:(")).endswith(_IS), left.endswith(_ASK), left.endswith(_LINK) or before.rstrip().endswith((";", "/", ":", "(")), bool(_DOES.match(after)), before.rstrip().endswith((",", ";", "/", ":")), after[:1] in ",;:", after[:1] in "-_/@.=" and after[1:2].isalnum(),
        bool(prior) and prior[0][:1].isupper() and before.endswith(" "), bool(following) and following[0][:1].isupper() and after.startswith(" "), bool(prior) and prior[0].lower() in _FUNCTION, bool(following) and following[0].lower() in _FUNCTION,
        bool(re.match(r"\W{0,2}\d", after)), bool(re.search(r"\d\W{0,2}$", before)), sum(1 for w in lower if w in _WORDS.findall(before) or w in _WORDS.findall(after)),
    ]
    return [float(v) for v in f]


def borders(text: str) -> list[int]:
    """Where the sentences of a text begin, and its end."""
    return [0, *(m.end() for m in _BORDER.finditer(text)), len(text) + 1]


def features(text: str, kind: str, a: int, b: int, at: list[int] | None = None) -> list[float]:
    """Format and context of a span: the rest of its sentence, however long."""
    s = text[a:b]
    at = at or borders(text)
    before, after = text[at[bisect_right(at, a) - 1] : a], text[b : max(b, at[bisect_right(at, b)])]
    if kind == "name":
        return _name_features(text, a, b, before, after)
    digits = [c for c in s if c.isdigit() or c == "*"]
    groups = re.findall(r"[\d*]+", s)
    word = re.findall(r"[^\W\d_]+", s)
    flat = "".join(digits)
    near = [_distance(CUES[k], before, after) for k in ("phone", "id", "other", "address", "mail")]
    f = [
        len(s), len(digits), len(groups), max(map(len, groups), default=0), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
        s.startswith("+"), "(" in s, "/" in s, "." in s, "-" in s, " " in s, "555" in flat, flat.startswith("0"), flat[:1] == "9", "ext" in s.lower(),
        bool(re.match(r"[A-Za-z]{2} ?\d", s)), bool(re.search(r"\d[- ]?[A-Za-z]$", s)), bool(re.fullmatch(r"[\d*]{3}[- ][\d*]{2}[- ]\d{4}", s)), bool(re.fullmatch(r"\d{2,3}/\d{3}/\d{3,5}(?:/\d{2})?", s)), bool(re.fullmatch(r"\d+", s)),
        bool(re.fullmatch(r"\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?: ext\. \d+)?|555-\d{4}", s)), bool(re.match(r"(?:\+|00)?(?:1|33|34|44|49)\D", s)), "*" in s, bool(re.fullmatch(r"[12] ?\d{2} ?[01]\d ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})?", s)),
        "@" in s, bool(re.search(r"\bat\b|\(at\)|\[at\]|arroba", s, re.I)), bool(re.search(r"\bdot\b|\(dot\)|\[dot\]|punkt|punto", s, re.I)), bool(re.search(r"[A-Za-z]{2,}$", s)),
        s[:1].isupper(), len(word), sum(w[:1].isupper() for w in word) / max(1, len(word)), "," in s, bool(re.search(r",\s(?:\d{4,5}\s)?[A-ZÀ-Ý]", s)),
        *near, bool(re.search(r"(?:, (?:also|or|and|auch|aussi|también)|;|/|\bor|\balso|\bund|\boder|\bou|\bet|\by|\bo)\s*$", before)), bool(re.search(r"\b(?:no\.?|n°|nr\.?|núm\.?)\s*$|\b(?:is|it is|ist|est|es)\s*$|[:=]\s*$", before)), before.strip() == "", after.strip(" .!?") == "",
    ]
    return [float(v) for v in f]


def _distance(cue: re.Pattern, before: str, after: str) -> float:
    """Words between the span and the nearest cue of its sentence; 20 without one."""
    last = None
    for m in cue.finditer(before):
        last = m
    back = before[last.end() :].count(" ") if last else 20
    ahead = cue.search(after)
    return float(min(20, back, after[: ahead.start()].count(" ") if ahead else 20))


# ---- examples -------------------------------------------------------------------------------

#: Syllables of invented words and names: the first half makes the examples to fit on, the second those held out.
_SYL = ("ba do fe ga hi jo ka lu mo ne pa qui ro sa te vu lan mer sol tur vin bel cor dar".split(), "wa xe yo zi ru li an ta po ge ni su fo ma del ran kil bur ost ser gim wol hed zan".split())
#: First words of street names.
_STREET_WORDS = ("Church Station Oak Victoria Spring Green Lower Elm River Bakers Long Meadow Abbey Garden".split(), "North Albert Windmill Castle Chapel Orchard Upper Maple King's Fisher High Park Ferry Cedar".split())


def _invented(r: random.Random, side: int) -> str:
    return "".join(r.choice(_SYL[side]) for _ in range(r.randint(2, 4)))


def _digits(r: random.Random, shape: str) -> str:
    return "".join(str(r.randint(0, 9)) if c == "9" else str(r.randint(1, 9)) if c == "8" else r.choice("ABCDEFGHJKLMNPRSTXYZ") if c == "A" else c for c in shape)


def _person(r: random.Random, side: int) -> str:
    known = sorted(GIVEN)[side::2]
    made = lambda: "".join(r.choice(_SYL[side]) for _ in range(r.choice((1, 2, 2, 3, 4)))) + r.choice(("", "", "n", "s", "m"))
    given = (r.choice(known) if r.random() < 0.3 else made()).capitalize()
    family = (made() + (r.choice(FAMILY[side::2]) if r.random() < 0.3 else "")).capitalize()
    if r.random() < 0.12:
        family += "-" + made().capitalize()
    s = r.choice(
        [f"{given} {family}"] * 6 + [f"{family}, {given}"] * 2 + [f"{given} {r.choice('ABDEFHKLMT')}. {family}"] * 2
        + [f"{given} {r.choice('ABDEFHKLMT')}.", f"{given} {r.choice(['von', 'van', 'de', 'del'])} {family}", f"{r.choice(['Mr', 'Ms', 'Mrs', 'Frau', 'Herr', 'Señora', 'Mme', 'Dr.', 'Prof.'])} {family}"]
    )
    return s.upper() if r.random() < 0.1 else s.lower() if r.random() < 0.2 else s


def _value(r: random.Random, kind: str, side: int) -> str:
    word = lambda: _invented(r, side)
    if kind == "email":
        local = r.choice([word(), f"{word()}.{word()}", f"{word()}+{word()}", word() + _digits(r, "99"), f"{word()}_{_digits(r, 'A99').lower()}"])
        host, tld = r.choice([word(), f"{word()}-{word()}", f"{word()}.{word()}"]), r.choice(["test", "example", "invalid", "com", "org", "de", "fr", "es"])
        at, dot = r.choice([("@", ".")] * 5 + [(" at ", " dot "), ("[at]", "[dot]"), (" (at) ", "."), (" @ ", ".")])
        if dot == " dot ":
            local, host = local.replace(".", dot), host.replace(".", dot)
        s = f"{local}{at}{host}{dot}{tld}"
        return s.upper() if r.random() < 0.06 else s
    if kind == "phone":
        s = _digits(r, r.choice(["+1 899 555 0199", "(899) 555-0199", "899.555.0199", "899-555-0199", "18995550199", "555-0199", "899 555 0199 ext. 899", "07700 900999", "07700900999", "+44 7700 900 999", "020 7946 0999", "+49 89 89999 999", "089/89999999", "+33 1 99 00 99 99", "01.99.00.99.99", "+34 899 999 999", "899 99 99 99", "+33 8 99 99 99 99", "0899 899999", "+44 20 7946 0999"]))
        return s[:-4] + "*" * r.randint(2, 4) + s[-2:] if r.random() < 0.05 and len(s) > 9 else s
    if kind == "id_number":
        return _digits(r, r.choice(["QQ 99 99 99 A", "AA999999A", "QQ999999C", "AA8999999", "89999999-A", "89999999A", "X9999999A", "899-99-9999", "***-**-9999", "999 99 9999", "99/899/999/99", "899999999", "99999999999", "89999999999", "1 89 09 75 999 999 99", "289097599999999", "AA99 9999 9999 9999 9999 99"]))
    if kind == "address":
        n, w, town = r.randint(1, 250), word().capitalize(), word().capitalize()
        street = r.choice([*_STREET_WORDS[side], w, w, w, f"{w} {word().capitalize()}", f"{r.choice(_STREET_WORDS[side])} {word().capitalize()}", f"{w}'s"])
        en = lambda *k: r.choice(k)
        s = r.choice(
            [f"{n} {street} {en('Street', 'St', 'Ave', 'Avenue', 'Road', 'Rd.', 'Lane', 'Terrace', 'Court', 'Close')}, {town}"] * 2
            + [f"{en('Flat', 'Apt', 'Unit')} {r.randint(1, 40)}, {n} {street} {en('Road', 'Court', 'Terrace', 'Street')}, {town}", f"{street} {en('Wharf', 'Row', 'Hill', 'Road')}, no. {n}, {town}", f"{w}{en('straße', 'str.', 'weg', 'platz', 'allee')} {n}{en('', 'a', 'b')}, {_digits(r, '09999')} {town}", f"{n}{en('', ' bis')} {en('rue', 'avenue', 'quai', 'allée')} {en('des', 'du', 'de la')} {w}, {_digits(r, '09999')} {town}", f"{en('Calle', 'Plaza', 'Avenida')} {en('', 'de ')}{w} {n}{en('', f', {r.randint(1, 9)}º {en(*chr(65), *chr(66))}')}, {town}"]
        )
        return s.upper() if r.random() < 0.04 else s
    return _person(r, side)


#: Common words, for sentences about no person.
_COMMON = ("took made left sold used opened says keeps shows reads drops then fast slow table window number macht nimmt zeigt liest schnell prend montre garde lit table vite toma muestra lee guarda mesa".split(), "lost found kept bought moved closed dropped writes sees holds sends often late door paper letter sagt gibt holt sieht oft donne voit dit tient maison da ve dice tiene casa".split())
#: Everyday sentences around a value {v}; {t} is an invented word, {T} an invented
#: proper noun, {n} a number. Every fourth is held out of fitting.
FRAMES = {
    "email": "Please write to {v} before Friday.|My private mail is {v}, use that.|The bill goes to {v} every month.|Newsletter sign-up: {v}|{v} is on the guest list.|Reply to {v}; the {t} is closed.|He gave me {v} as his contact.|account={v};shop={t}|Invite {v} to the {t} call.|from {v}: the {t} is late|Bitte schreib an {v}, nicht an mich.|Die Rechnung ging an {v}.|Kontakt: {v} (Büro {t})|Mein Konto läuft auf {v}.|Écris plutôt à {v} pour le {t}.|La facture part chez {v}.|Mon courriel est {v}.|Escribe a {v} antes del lunes.|La cuenta está a nombre de {v}.|Mi dirección de correo: {v}",
    "phone": "You can ring me on {v} after six.|My mobile is {v}.|The shop's number: {v}|Fax {v}, office hours only.|Dial {v} and ask for the {t}.|If the boiler fails, phone {v}.|Text {v} when you arrive in {T}.|The hotline {v} is free of charge.|Reach the {t} team on {v}.|{v} is my work phone.|Ruf mich unter {v} zurück.|Meine Handynummer ist {v}.|Telefon {v}, bitte nur vormittags.|Die Praxis ist unter {v} erreichbar.|Mon portable est le {v}.|Appelez le {v} en cas de panne.|Téléphone : {v} (bureau {t})|Mi móvil es el {v}.|Llámame al {v} por la tarde.|Teléfono de la tienda: {v}",
    "id_number": "My passport number is {v}.|Her social security number, {v}, was on the form.|ID card {v}, issued in {T}.|National insurance: {v}|The tax office filed it under {v}.|I had to enter {v} as my tax number.|Licence no. {v} belongs to the driver.|{v} is my insurance number.|SSN {v} was printed on the {t} letter.|Delete the identity number {v} from the list.|Meine Steuernummer lautet {v}.|Ausweis Nr. {v}, gültig bis Mai.|Die Versicherungsnummer {v} steht im Brief.|Personalausweis: {v}|Mon numéro de sécurité sociale est le {v}.|Passeport n° {v} au dossier {t}.|Numéro fiscal : {v}|Mi NIE es {v}.|El pasaporte {v} caduca en mayo.|Número de la seguridad social: {v}",
    "address": "We moved to {v} last spring.|Deliver the {t} to {v}.|My office is at {v}.|The house at {v} is for sale.|Post it to {v}, please.|Home address: {v}|She lives at {v} with two cats.|The parcel for {T} was left at {v}.|Meet me in front of {v}.|Our warehouse is {v}, ring twice.|Unser Büro ist in der {v}.|Die Ware liegt noch in {v}.|Bitte liefert an {v}.|Sie wohnt {v}.|Anschrift: {v}|Nous habitons {v} depuis mai.|Livrez le {t} au {v}.|Adresse : {v}|Mi casa está en {v}.|Envíalo a {v}, por favor.|Domicilio: {v}",
    "name": "Thanks to {v} for the cake.|We met {v} at the fair.|Please invite {v} to the wedding.|The letter was signed by {v}.|According to {v}, the bridge is closed.|My neighbour {v} waters the plants.|{v} wrote the first chapter.|{v} leads the choir in {T}.|{v} will visit {T} on Monday.|Yours sincerely, {v}|Regards, {v}|I'm {v} from {T}.|My name is {v}, nice to meet you.|Speak to {v} about the {t}.|Ask {v} for the key.|Forward the minutes to {v}.|It was {v} who found the {t}.|cc {v} on this mail|Contact {v} first.|{v} said that the {t} is late.|a photo by {v}, taken near {T}|a cake came from {v} this morning|{v} runs the bakery on Mondays.|reviewed by {v} in {n}|Tell {v} that {T} is closed.|{v} {w} the {t}.|{v} {w} it again, and {T} {w} {t}.|{v} painted the door.|{v} forgot the keys at the {t}.|{v} and the others were late.|The soup was made by {v}.|The talk by {v} starts at {d}.|cc {v}|{v} sold the {t} to {T}.|{v} opened the window.|the flat of {v} (door {n})"
    "|Danke an {v} für den Kuchen.|Frag {v} nach dem Schlüssel.|{v} leitet den Chor.|{v} übernimmt den Garten.|Mein Name ist {v}, guten Tag.|Ich heiße {v} und wohne in {T}.|Sprich mit {v} über das {t}.|Viele Grüße, {v}|Der Brief kam von {v}.|Jetzt übernimmt {v} die Kasse.|Laut {v} ist die Brücke zu."
    "|Merci à {v} pour le gâteau.|Demandez à {v} la clé.|{v} dirige la chorale.|{v}, qui habite en face, garde la maison.|Je m'appelle {v}, enchanté.|Parlez à {v} du {t}.|Cordialement, {v}|La lettre vient de {v}.|{v} a écrit le premier chapitre.|Selon {v}, le pont est fermé."
    "|Gracias a {v} por la tarta.|Pregunta a {v} por la llave.|{v} dirige el coro.|Mañana {v} visita a mi tía.|Me llamo {v}, encantado.|Habla con {v} sobre el {t}.|Saludos, {v}|La carta es de {v}.|{v} escribió el primer capítulo.|Según {v}, el puente está cerrado.",
}
#: Sentences that hold no personal data and look as if they did.
LOOKALIKES = (
    "The parcel {N} left {T} this morning.|Order {n}-{n} has shipped.|Your invoice {n}/{n} is due on 2023-11-0{d}.|Install {T} {d}.{d}.{n} before Friday.|The ISBN is 978-{d}-{n}-{n}-{d}.|Ping 192.168.{d}.{d} from the {t} host.|Version {d}.{n}.{d} of {t} fixes the leak.|Commit {N} broke the {t} build.|Row {n} of {n} is empty.|The score was {d}-{d} after {n} minutes.|Use {t}@{d}.{d}.{n} in the lock file.|The @{t} annotation is optional.|Lunch is at {d}:4{d} in room {n}.|{T} replaced {T} in spring.|Ask {T} before {T} does.|Open {T} and {t} side by side.|{T} and {T} share one key.|The {T} plugin talks to {t} through {t}.|{T} wrote {n} lines to the log.|{T} owns the lock while {t} waits.|Both {t} and {t} run on build {n}.|We moved from {t} to {t} and {t}.|Also {T} is late.|With {T} the trip took {n} minutes."
    "|The street map of {T} has {n} layers.|Main Street is closed today.|Turn left at the next road, then {n} steps.|There are {n} ways to close a {t}.|Batch {N}, page {d}.|Serial {n}-{n}, part {d}.|Range {n}-{n}, ratio {d}/{d}.|Coordinates {d}.{n}, {d}.{n}.|The timestamp {N} is in milliseconds.|New Year is in {n} days.|Monday Morning, item {d}.|The {T} Museum opens in May.|{T} University and {T} Bank signed.|Getting Started With {T}|{T} for {t}, {T} for {t}.|cc {T} on this ticket, see {t}-{n}.|called {t} {n} times|according to {T} the {t} is full|we met at {t} near {T}|made by {t}, sold by {t}.|{T} runs {t} on port {n}.|{t} runs {t} first, then {t} runs again.|See {t}, {t} and {t}.|Then {t} leads to {t}; {t} does not.|also {t}.|or {t} in {n}."
    "|They want to drop {t} and keep {t} for now.|Show me how to rebuild {t} after lunch.|A word like {t} sounds as odd as {t}.|Nobody asked {t} about it.|It talks to {t} and reads from {t}; {t} stays.|Start {t} first, then {t}.|We prefer {t} over {t} because of the noise.|She said so, and {t} agreed.|now {t} waits for {t}|tell me about {t} and {t}|ask for {t} again|{t} / {t}|first {t}, then {t}, or {t}.|The queue is full, {t} stops.|this was written by {t} after {t}|The catalogue entry {d}-{d}{d}{d}-{n}-{n} has no cover.|Item {n}-{n}-{n} is out of stock.|Part number {d}{d}{d}-{d}-{n}-{n}-{d}|entry {n}-{d}{d}{d}{d} of {t}|ISBN {z}{d}-{d}-{n}-{n}-{z}|Article {z}-{z}{d}-{n}-{n} is sold out.|part {z}-{n}-{n}-{d} of the catalogue|serial number {z}-{d}-{n}-{n}|She chose {t} and {w} {t}.|They want to {w} {t} or {w} {t}.|It is late, {w} {t}.|{w} {t}; {w} {t}.|{w} {t} / {w} {t}|The {t} is empty, says {t}.|Ask about {w} {t}.|{w} {t} runs on {t}.|now {w} {t} on {t}|{T} {w} {t}, and {w} {t}.|{t} {w} {w} {t} oder {w} {t}.|{t} {w} {t} et {w} {t}.|{t} {w} {t} y {w} {t}.|It took {n} {n} seconds.|from {n} {n} bytes to {n}|rows {n} {n} {n}"
    "|Wir behalten {t} und streichen {t}.|Das Werkzeug {t} braucht {t}.|Jetzt wartet {t} auf {t}.|Erst {t}, dann {t}.|Laut {t} ist alles leer.|Danke, das mit {t} geht.|On garde {t} et on jette {t}.|On peut ranger {t} derrière {t}.|Maintenant {t} attend {t}.|selon {t} tout est vide|merci, {t} marche|Quitamos {t} y dejamos {t}.|Se puede guardar {t} detrás de {t}.|Ahora {t} espera a {t}.|según {t} todo está vacío|gracias, {t} funciona"
    "|Bestellung {n}-{n} ist unterwegs.|Die Fassung {d}.{n} von {t} ist fertig.|Mit {t} und {T} geht es schneller.|Der {T} spricht mit {t}.|Frag {T} nach {t}.|{T} betreut {t} nicht.|Seit Zeile {n} fehlt der {T}.|Der Weg {n} ist zu.|Am Montag startet {T} den {t}.|von {t} nach {t}, mit {t}|La commande {n}-{n} est partie.|La version {d}.{n} de {t} est prête.|{T} remplace {T} depuis mai.|Demande à {T} si {t} tourne.|avec {t} et {t}, ligne {n}|C'est {T} qui lit {t}.|par {t} ou {t}|El pedido {n}-{n} ha salido.|La versión {d}.{n} de {t} está lista.|{T} sustituye a {T} desde mayo.|Pregunta a {T} por {t}.|Ahora {T} lee {t}.|con {t} y {t}, fila {n}|por {t} o {t}|Usa {T} con {t} en lugar de {T}."
).split("|")


def examples(n: int, seed: int, side: int = 0) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, spans) made from the frames: side 0 to fit on, side 1 held out. The sides share no
    frame, no syllable, no given name and no street."""
    r = random.Random(seed)
    out = []
    mine = lambda x: [f for i, f in enumerate(x) if (i % 4 == 3) == (side == 1)]
    frames, others = {k: mine(f.split("|")) for k, f in FRAMES.items()}, mine(LOOKALIKES)
    makers = (
        ("{t}", lambda: _invented(r, side)), ("{T}", lambda: _invented(r, side).capitalize()), ("{n}", lambda: _digits(r, "8" + "9" * r.randint(1, 5))), ("{N}", lambda: _digits(r, "8" + "9" * r.randint(8, 15))), ("{d}", lambda: str(r.randint(1, 9))), ("{z}", lambda: "0" * r.randint(1, 3)), ("{w}", lambda: r.choice(_COMMON[side])),
    )

    def fill(frame: str, v: str = "") -> tuple[str, int]:
        s = frame
        for k, make in makers:
            while k in s:
                s = s.replace(k, make(), 1)
        at = s.find("{v}")
        return s.replace("{v}", v), at

    gap = lambda s: " " if s.endswith((".", "?")) and not s[-2:-1].isupper() else "\n"
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.45:
                s = fill(r.choice(others))[0]
                text += (s.upper() if r.random() < 0.06 else s) + gap(s)
                continue
            kind = r.choice((*KINDS, "name"))
            v = _value(r, kind, side)
            s, at = fill(r.choice(frames[kind]), v)
            spans.append((kind, len(text) + at, len(text) + at + len(v)))
            text += s
            if r.random() < 0.2:
                kind = r.choice(KINDS)
                v, link = _value(r, kind, side), r.choice(["; ", ", or ", ", also ", " / ", " and ", ", oder ", " ou ", " y "])
                text = text.rstrip(".") + link
                spans.append((kind, len(text), len(text) + len(v)))
                text += v + "."
            text += gap(text)
        out.append((text.strip(), spans))
    return out


#: In free text, spans with the shape of a name that are none are so many times as frequent, to those that are one, as in the examples.
RARE = 3.0


@cache
def model(n: int = 6000, seed: int = 7) -> dict[str, Boosted]:
    """One ensemble per kind, with its threshold calibrated on examples of the other side."""
    out = {}
    sides = []
    for side, many in ((0, n), (1, n // 2)):
        rows: dict[str, list[tuple[list[float], float]]] = {k: [] for k in KINDS}
        for text, spans in examples(many, seed + side, side):
            for kind, a, b in candidates(text):
                hit = any(k == kind and min(b, e) - max(a, s) >= (0.8 if kind == "name" else 0.6) * max(e - s, b - a) for k, s, e in spans)
                rows[kind].append((features(text, kind, a, b), float(hit)))
        sides.append(rows)
    for kind in KINDS:
        (x, y), (u, v) = ((np.array([f for f, _ in rows[kind]]), np.array([h for _, h in rows[kind]])) for rows in sides)
        out[kind] = Boosted(rounds=60 if kind == "name" else 30, depth=4 if kind == "name" else 3).fit(x, y).calibrate(u, v, RARE if kind == "name" else 1.0)
    return out


def spans(texts: list[str], models: dict[str, Boosted]) -> list[list[tuple[str, int, int]]]:
    """The accepted spans of each text, in order and without overlaps."""
    where: dict[str, list[tuple[int, int, int]]] = {k: [] for k in KINDS}
    x: dict[str, list[list[float]]] = {k: [] for k in KINDS}
    for i, t in enumerate(texts):
        if t:
            at = borders(t)
            for kind, a, b in candidates(t, at):
                where[kind].append((i, a, b))
                x[kind].append(features(t, kind, a, b, at))
    kept: list[list[tuple[float, str, int, int]]] = [[] for _ in texts]
    for kind in KINDS:
        if x[kind]:
            p = models[kind].chance(np.array(x[kind]))
            for (i, a, b), c in zip(where[kind], p, strict=True):
                if c >= models[kind].threshold:
                    kept[i].append((float(c), kind, a, b))
    out = []
    for found in kept:
        took: list[tuple[str, int, int]] = []
        # an email holds what looks like a name; else the surer span wins, and of equals the longer
        for _, kind, a, b in sorted(found, key=lambda s: (s[1] != "email", -round(s[0], 2), s[2] - s[3], s[2])):
            if all(b <= c or a >= d for _, c, d in took):
                took.append((kind, a, b))
        out.append(sorted(took, key=lambda s: s[1]))
    return out


def redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [NAME] in place of the spans."""
    for kind, a, b in sorted(found, key=lambda s: -s[1]):
        text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
    return text


def records(messages: DataFrame, cold: DataFrame, facts: DataFrame, episodes: DataFrame) -> DataFrame:
    """table_name, row_id, text of the four tables."""
    one = lambda df, name, key, text: df.select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_id"), F.col(text).cast("string").alias("text"))
    return one(messages, "messages", "id", "content").unionByName(one(cold, "cold_memories", "id", "text")).unionByName(one(facts, "facts", "id", "content")).unionByName(one(episodes, "episodes", "id", "text")).filter("row_id IS NOT NULL AND text IS NOT NULL")


def found(rows: DataFrame) -> DataFrame:
    """p6_found: distinct (table_name, row_id, kind)."""
    models = model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tables, ids, kinds = [], [], []
            for t, i, got in zip(pdf["table_name"], pdf["row_id"], spans(list(pdf["text"]), models), strict=True):
                for k in {k for k, _, _ in got}:
                    tables.append(t)
                    ids.append(i)
                    kinds.append(k)
            yield pd.DataFrame({"table_name": pd.Series(tables, dtype=object), "row_id": pd.Series(ids, dtype=object), "kind": pd.Series(kinds, dtype=object)})

    return spread(rows).mapInPandas(run, "table_name string, row_id string, kind string").distinct()


def redact(rows: DataFrame) -> DataFrame:
    """Every row with its text redacted and the number of spans."""
    models = model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = spans(list(pdf["text"]), models)
            yield pd.DataFrame({"table_name": pdf["table_name"], "row_id": pdf["row_id"], "text": [redacted(t, g) for t, g in zip(pdf["text"], got, strict=True)], "spans": np.array([len(g) for g in got], np.int32)})

    return spread(rows).mapInPandas(run, "table_name string, row_id string, text string, spans int")

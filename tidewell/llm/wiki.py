"""What a reader sees of wiki text: visible words, and prose sentences."""

from __future__ import annotations

import html
import re

WORD = re.compile(r"[^\W_]+")

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_REF = re.compile(r"<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref>", re.S | re.I)
_PARAMETER = re.compile(r"\{\{\{[^{}]*\}\}\}")
_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
#: A template that is never closed ends with the lines of its arguments.
_OPEN_TEMPLATE = re.compile(r"\{\{[^{}\n]*(?:\n[|!][^\n]*)*")
_CATEGORY = re.compile(r"\[\[\s*:?(?:category|kategorie|cat[ée]gorie|categor[ií]a|file|datei|fichier|archivo|image|bild|media)\s*:[^\[\]]*\]\]", re.I)
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
_EXTERNAL = re.compile(r"\[(?:https?|ftp)://[^\s\]]*\s*([^\]]*)\]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_TABLE_OPEN = re.compile(r"^\s*\{\|[^\n]*$|^\s*\|-[^\n]*$", re.M)
_TABLE = re.compile(r"^[ \t]*\{\|.*?(?:^[ \t]*\|\}|\Z)", re.S | re.M)
_QUOTE = re.compile(r"<blockquote\b[^>]*>.*?(?:</blockquote>|\Z)", re.S | re.I)
_HEADING = re.compile(r"^=+[^\n]*?=*[ \t]*$", re.M)
_REDIRECT = re.compile(r"\A\s*#\s*(?:redirect|redirection|weiterleitung|redirección|redireccion|rediri[gj]\w*)", re.I)
_TRANSCLUSION = re.compile(r"<(includeonly|noinclude|onlyinclude)\b[^>]*>.*?(?:</\1>|\Z)", re.S | re.I)
_MAGIC = re.compile(r"__[A-Z]+__|~{3,5}")
#: A sentence ends at a stop before white space, or at a line break.
_SENTENCE = re.compile(r"(?<=[.!?])[\s\"'»”)]+|\n+")


def is_redirect(text: str) -> bool:
    return bool(_REDIRECT.match(text))


def _strip(t: str) -> str:
    if "<" in t:
        t = _REF.sub(" ", _COMMENT.sub(" ", t))
    if "{{" in t:
        t = _PARAMETER.sub(" ", t)
        before = None
        while before != t:
            before, t = t, _TEMPLATE.sub(" ", t)
        t = _OPEN_TEMPLATE.sub(" ", t)
    return t


def _unlink(t: str) -> str:
    if "[" in t:
        t = _LINK.sub(r"\1", _CATEGORY.sub(" ", t))
        t = _EXTERNAL.sub(r" \1 ", t)
    if "<" in t:
        t = _TAG.sub(" ", t)
    if "''" in t:
        t = re.sub("''+", "", t)
    if "&" in t:
        t = html.unescape(t)
    return t


def visible_words(text: str) -> list[str]:
    """Lower-case words of the visible text: link labels, table cells, quotations and headings
    stay; comments, references, templates, link targets, categories and tags go."""
    t = _strip(text)
    if "|" in t:
        t = _TABLE_OPEN.sub(" ", t)
    return WORD.findall(_unlink(t).lower())


def sentences(text: str) -> list[str]:
    """The sentences of a page's own prose: tables, block quotations, headings and markup aside."""
    t = _strip(text)
    if "<" in t:
        t = _TRANSCLUSION.sub("\n", _QUOTE.sub("\n", t))
    if "{|" in t:
        t = _TABLE.sub("\n", t)
    if "=" in t:
        t = _HEADING.sub("\n", t)
    t = _MAGIC.sub(" ", _unlink(t))
    return [s for s in (x.strip(" \t*#:;|!") for x in _SENTENCE.split(t)) if s]

"""What a reader sees of a wiki page, as words."""

from __future__ import annotations

import html
import re
import unicodedata

import regex

_BRACES = re.compile(r"\{\{+|\}\}+")
_BRACKETS = re.compile(r"\[\[|\]\]")
_EXTERNAL = re.compile(r"\[(?:https?:|ftp:|mailto:)?//[^\s\[\]]*\s*([^\[\]\n]*)\]", re.I)
_INLINE = "abbr|b|bdi|big|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|nowiki|noinclude|includeonly|onlyinclude"
_TAG = re.compile(rf"</?(?:({_INLINE})|[a-z][a-z0-9]*)(?=[\s/>])[^<>]*>", re.I)
_QUOTES = re.compile(r"''+")
_ATTRIBUTE = r"[\w-]+[ \t]*=[ \t]*(?:\"[^\"\n]*\"|'[^'\n]*'|[\w#%-]+)"
_CELL = re.compile(rf"(^[ \t]*[|!]|\|\||!!)[ \t]*{_ATTRIBUTE}(?:[ \t]+{_ATTRIBUTE})*[ \t]*\|(?!\|)", re.M)
_ROW = re.compile(r"^[ \t:]*(?:\{\||\|-)[^\n]*", re.M)
_MAGIC = re.compile(r"__[A-Z]+__")
_GONE = regex.compile(r"[\p{M}\p{Cf}]+")
_HIDDEN = regex.compile(r"\s*(?:category|kategorie|categoría|catégorie|categoria|категория|[a-z]{2,3}(?:-[a-z]+)?)\s*:", re.I)
_FILE = re.compile(r"\s*(?:file|image|datei|bild|archivo|fichier|файл)\s*:", re.I)
_NOT_WORD = re.compile(r"[\W_]+")


def _without_comments(s: str) -> str:
    out, at = [], 0
    while (a := s.find("<!--", at)) >= 0 and (b := s.find("-->", a + 4)) >= 0:
        out.append(s[at:a])
        at = b + 3
    return "".join([*out, s[at:]]) if out else s


def _without_templates(s: str) -> str:
    """``s`` without its balanced {{...}}, nested ones included; braces that match nothing stay as text."""
    stack: list[int] = []
    spans: list[tuple[int, int]] = []
    for m in _BRACES.finditer(s):
        n = len(m.group()) // 2
        if m.group()[0] == "{":
            stack.extend(m.start() + 2 * i for i in range(n))
        else:
            for i in range(min(n, len(stack))):
                start = stack.pop()
                while spans and spans[-1][0] >= start:
                    spans.pop()
                spans.append((start, m.start() + 2 * (i + 1)))
    if not spans:
        return s
    out, at = [], 0
    for a, b in spans:
        out.append(s[at:a])
        at = b
    out.append(s[at:])
    return "".join(out)


def _label(link: str) -> str:
    """A link's visible text: its label, else its target; categories and links to other languages show nothing, a file its caption."""
    target, bar, label = link.partition("|")
    if ":" in target:
        if _FILE.match(target):
            return " " + label.rpartition("|")[2] + " "
        if _HIDDEN.match(target):
            return " "
        target = target.lstrip(":")
    return label if bar and label.strip() else target


def _without_links(s: str) -> str:
    """Links by their visible text, the inner ones of nested links first; brackets that match nothing stay as text."""
    open_: list[list[str]] = [[]]
    at = 0
    for m in _BRACKETS.finditer(s):
        open_[-1].append(s[at : m.start()])
        at = m.end()
        if m.group() == "[[":
            open_.append([])
        elif len(open_) > 1:
            link = "".join(open_.pop())
            open_[-1].append(_label(link))
    open_[-1].append(s[at:])
    return "[[".join("".join(parts) for parts in open_)


def visible_text(s: str) -> str:
    """The page as its reader sees it: links by their visible text, no templates, comments or tags, entities decoded."""
    if "<!--" in s:
        s = _without_comments(s)
    if "{{" in s:
        s = _without_templates(s)
    if "{|" in s:
        s = _CELL.sub(r"\1 ", _ROW.sub("\n", s))
    if "[[" in s:
        s = _without_links(s)
    if "[" in s:
        s = _EXTERNAL.sub(r"\1", s)
    if "<" in s:
        s = _TAG.sub(lambda m: "" if m.group(1) else " ", s)
    if "''" in s:
        s = _QUOTES.sub("", s)
    if "__" in s:
        s = _MAGIC.sub(" ", s)
    if "&" in s:
        s = html.unescape(s)
    return s


#: ASCII letters and digits in lower case, anything else a space.
_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def folded(s: str) -> bytes:
    """UTF-8 words without case, accents, invisible characters and compatibility forms, with only spaces (one or more) between them."""
    if not s.isascii():
        s = _GONE.sub("", unicodedata.normalize("NFKD", s))
        if not s.isascii():
            s = _GONE.sub("", unicodedata.normalize("NFKD", s.casefold()))
            if not s.isascii():
                return _NOT_WORD.sub(" ", s).encode("utf-8", "replace")
    return s.encode("ascii").translate(_ASCII)


def reader_bytes(s: str | None) -> bytes:
    return folded(visible_text(s)) if s else b""


def reader_words(s: str | None) -> list[str]:
    """The words a reader sees; none for NULL or blank text."""
    return reader_bytes(s).decode().split()

"""Words of a text as a reader of the displayed text takes them."""

from __future__ import annotations

import html
import unicodedata

import regex

_WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*").findall
_ENTITY = regex.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
#: Tags that only change the look of what they hold: the letters on both sides stay one word. Others end the word.
_INLINE = regex.compile(r"</?(?:a|abbr|b|bdi|bdo|big|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr)(?:\s[^<>]*)?/?>", regex.I)
_BLOCK = regex.compile(r"<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|<[/!?]?[A-Za-z][^<>]*>", regex.I | regex.S)
_COLOUR = regex.compile(r"\x1b\[[0-9;]*[A-Za-z]")
_UNSEEN = regex.compile(r"[\p{Cf}\u034f\u115f\u1160\u17b4\u17b5\u3164\ufe00-\ufe0f\uffa0]+")
_HYPHEN = regex.compile(r"(?<=\p{L})[-\u2010\u2011][ \t]*(?:\r\n|[\n\r\u0085\u2028\u2029])[ \t]*(?:[>|][ \t]?)*(?=\p{Ll})")
_MARKED = regex.compile(r"(?<=[\p{L}\p{N}])[*~`]{1,3}(?=[\p{L}\p{N}])")
_FOREIGN = regex.compile(r"[\p{Cyrillic}\p{Greek}]")
_LATIN = regex.compile(r"[a-z]")
#: Lower-case Cyrillic and Greek letters that look like Latin ones; used only in words that also hold Latin letters.
_ALIKE = str.maketrans("авекмнорстухіјѕԁһԛԝαενοτυιρκ", "abekmhopctyxijsdhqwaevotuipk")


def displayed_words(text: str | None) -> list[str]:
    """Lower-case words of the displayed text.

    Entities and tags are resolved, letter forms are made compatible and composed, what isn't seen (soft hyphens, joiners,
    marks of order) goes, words hyphenated at a line's end are joined, and letters borrowed from another script inside a
    word count as what they look like. Null and empty texts have no words.
    """
    if not text:
        return []
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    if "<" in text:
        text = _BLOCK.sub(" ", _INLINE.sub("", text))
    if "\x1b" in text:
        text = _COLOUR.sub("", text)
    if not text.isascii():
        text = _UNSEEN.sub("", text)
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
        text = _UNSEEN.sub("", text) if not text.isascii() else text
    else:
        text = text.lower()
    if "-" in text or "\u2010" in text or "\u2011" in text:
        text = _HYPHEN.sub("", text)
    if "*" in text or "`" in text or "~" in text:
        text = _MARKED.sub("", text)
    words = _WORD(text)
    if not text.isascii() and _FOREIGN.search(text):
        words = [w.translate(_ALIKE) if _FOREIGN.search(w) and _LATIN.search(w) else w for w in words]
    return words

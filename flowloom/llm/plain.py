"""Texts reduced to what is compared: no markup, escapes, invisible characters, case or width."""

from __future__ import annotations

import html
import re
import unicodedata

ANSI = re.compile(r"\x1b\[[0-9;?]*[A-Za-z]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)")
ESCAPE = re.compile(r"\\+(?:u([0-9a-fA-F]{4})|u\{([0-9a-fA-F]{1,6})\}|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|([nrtfvb])(?![a-z])|([nrt])(?=[a-z])|([\"'/&<>*_`#()\[\]{}.!+\\-]))")
INLINE_TAG = re.compile(r"</?(?:a|abbr|b|bdi|code|em|font|i|ins|kbd|mark|q|s|small|span|strong|sub|sup|u|wbr)(?:\s[^<>]{0,300})?/?>", re.I)
TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]{0,300})?/?>|<!--.{0,2000}?-->", re.S)
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff]")

#: Scripts written without spaces between words.
SPACELESS = "\u0e00-\u0edf\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f"
SPACELESS_CHAR = re.compile(f"[{SPACELESS}\U00020000-\U0003ffff]")

WORD = re.compile(r"\d+(?:[.,]\d+)+(?![^\W_])|[^\W_]+")
CHAR = re.compile(r"[^\W_]")


def _escaped(m: re.Match) -> str:
    code = next((g for g in m.groups()[:4] if g), None)
    if code:
        n = int(code, 16)
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else " "
    return m.group(7) or " "


def plain(text: str) -> str:
    """Case-folded text without markup; places in it are not those of the input."""
    if "\x1b" in text:
        text = ANSI.sub("", text)
    if "\\" in text:
        text = ESCAPE.sub(_escaped, text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", INLINE_TAG.sub("", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text))
    return text.casefold()


def words(plain_text: str) -> list[str]:
    return WORD.findall(plain_text)


def characters(plain_text: str) -> list[str]:
    return CHAR.findall(plain_text)


def is_spaceless(plain_text: str) -> bool:
    """Most of the letters belong to scripts without spaces."""
    return 2 * len(SPACELESS_CHAR.findall(plain_text)) > len(CHAR.findall(plain_text))

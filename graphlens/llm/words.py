"""Words as the text operators see them: offsets in the text, and a form for comparing."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache


@lru_cache(1)
def invisible_class() -> str:
    """Body of a character class of what prints nothing and is no white space."""
    blank = [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
    none = [c for c in range(sys.maxunicode + 1)
            if unicodedata.category(chr(c)) in ("Cf", "Cc") and not chr(c).isspace()]
    return "".join(f"\\U{c:08x}" for c in sorted({*blank, *none}))


@lru_cache(1)
def word_pattern() -> re.Pattern:
    """A run of letters and digits; invisible characters inside belong to it, accents that follow a letter too."""
    loose = f"[{invisible_class()}̀-ͯ]"
    return re.compile(f"[^\\W_](?:{loose}*[^\\W_])*[̀-ͯ]*")


@lru_cache(1)
def _strip() -> re.Pattern:
    return re.compile(f"[{invisible_class()}]")


_PLAIN = re.compile(r"[a-z0-9]+")


def words(text: str) -> list[str]:
    """Folded words: no case, no invisible characters, composed accents."""
    if text.isascii() and not any(c in text for c in "\x00\x01\x02\x03\x04\x05\x06\x07\x08\x0e\x0f\x1b\x7f"):
        return _PLAIN.findall(text.lower())
    return [fold(w) for w in word_pattern().findall(text)]


def fold(word: str) -> str:
    if word.isascii() and word.isalnum():
        return word.lower()
    return unicodedata.normalize("NFC", _strip().sub("", word)).casefold()


def word_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in word_pattern().finditer(text)]

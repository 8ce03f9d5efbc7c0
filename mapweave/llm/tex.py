"""What TeX markup stands for, as far as reading its text needs it."""

from __future__ import annotations

import re
import unicodedata

# Fixed values of the TeX language: accent commands and the combining mark each stands for.
ACCENTS = {"`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", "=": "\u0304", "u": "\u0306", ".": "\u0307", '"': "\u0308", "r": "\u030a", "H": "\u030b", "v": "\u030c", "d": "\u0323", "c": "\u0327", "k": "\u0328", "b": "\u0331"}
# Fixed values of the TeX language: letter commands.
LETTERS = {"ss": "ß", "SS": "ẞ", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "aa": "å", "AA": "Å", "i": "ı", "j": "ȷ", "dh": "ð", "DH": "Ð", "th": "þ", "TH": "Þ", "dj": "đ", "DJ": "Đ", "ng": "ŋ", "NG": "Ŋ"}

_LETTER = re.compile(r"\{\\(" + "|".join(sorted(LETTERS, key=len, reverse=True)) + r")\s*\}|\\(" + "|".join(sorted(LETTERS, key=len, reverse=True)) + r")(?![A-Za-z])(?:\{\}|[ \t]*(?:\n(?!\s*\n)[ \t]*)?(?=[^\W\d_])|\\ |)")
_ACCENT = re.compile(r"\\(?:([`'^~=.\"])\s*|([uvHrckdb])(?![A-Za-z])\s*)(?:\{\s*([^\W\d_])\s*\}|([^\W\d_]))")
_DEFINE = re.compile(r"\\(?:(?:re)?newcommand|providecommand|DeclareRobustCommand)\*?\s*(?:\{\s*\\([A-Za-z@]+)\s*\}|\\([A-Za-z@]+))\s*\{((?:[^{}]|\{[^{}]*\})*)\}|\\[gx]?def\s*\\([A-Za-z@]+)\s*\{((?:[^{}]|\{[^{}]*\})*)\}")
_GROWTH = 16
_BRACED_ACCENT = re.compile(r"\{([^\W\d_][\u0300-\u036f]?)\}")


def _accent(m: re.Match) -> str:
    base = m[3] or m[4]
    base = {"ı": "i", "ȷ": "j"}.get(base, base)
    return unicodedata.normalize("NFC", base + ACCENTS[m[1] or m[2]])


def resolve_accents(text: str) -> str:
    """Accent and letter commands replaced by the letters they stand for."""
    if "\\" not in text:
        return text
    text = _LETTER.sub(lambda m: LETTERS[m[1] or m[2]], text)
    return _ACCENT.sub(_accent, text)


def definitions(text: str) -> dict[str, str]:
    """Bodies of the text's own macros without arguments."""
    return {m[1] or m[2] or m[4]: m[3] if m[3] is not None else m[5] for m in _DEFINE.finditer(text)}


def expand(text: str, macros: dict[str, str]) -> str:
    """The text's own macros replaced by what they stand for; the space that ends a macro's name goes with it.

    Macros within macros are replaced in turn, as many deep as there are macros, which a macro that holds itself would
    go beyond. A text that grows past ``_GROWTH`` times its length on the way is left as it is then.
    """
    if not macros:
        return text
    use = re.compile(r"\\(" + "|".join(sorted(map(re.escape, macros), key=len, reverse=True)) + r")(?![A-Za-z@])(?:\{\}|\\(?=\s))?")
    most = len(text) * _GROWTH + 10_000
    for _ in macros:
        new = use.sub(lambda m: macros[m[1]], text)
        if new == text or len(new) > most:
            break
        text = new
    return text

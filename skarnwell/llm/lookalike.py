"""One canonical form for text that a reader cannot tell apart.

The form keeps what is visible (letter case, accents, punctuation, raised digits) and removes what is
not: full or normal width, ligatures, composed or combining accents, invisible characters, the kind of
space and the alphabet a letter shape was taken from. The per-character table is computed from the
Unicode database by rule; only the look-alike letters themselves are listed.
"""

from __future__ import annotations

import re
import unicodedata as ud
from functools import cache, lru_cache

# Letters that draw the same shape as a Latin letter or mark, as "shape: look-alikes".
LOOKALIKES = """
A: Α А Ꭺ ꓮ
B: Β В Ᏼ ꓐ Ⲃ
C: С Ϲ Ꮯ ꓚ Ⲥ 𐐕
D: Ꭰ ꓓ
E: Ε Е Ꭼ ꓰ
F: ꓝ
G: Ɡ Ԍ Ꮐ ꓖ
H: Η Н Ꮋ ꓧ Ⲏ
I: Ι І Ӏ ꓲ Ⲓ
J: Ј Ϳ Ꭻ ꓙ
K: Κ К Ꮶ ꓗ Ⲕ
L: Ꮮ ꓡ 𐐛
M: Μ М Ϻ Ꮇ ꓟ Ⲙ
N: Ν ꓠ Ⲛ
O: Ο О Օ ꓳ Ⲟ 𐐄
P: Ρ Р Ꮲ ꓑ Ⲣ
Q: Ԛ
R: Ꮢ ꓣ
S: Ѕ Ꮪ ꓢ 𐐠
T: Τ Т Ꭲ ꓔ Ⲧ
U: Ս ꓴ
V: Ѵ Ꮩ ꓦ
W: Ԝ Ꮃ ꓪ
X: Χ Х ꓫ Ⲭ
Y: Υ Ү ꓬ Ⲩ
Z: Ζ Ꮓ ꓜ Ⲍ
a: а ɑ α
c: с ϲ ⲥ 𐐽
d: ԁ
e: е
g: ɡ ց
h: һ հ
i: і ι
j: ј ϳ
l: ӏ
n: ո
o: ο о օ ⲟ 𐐬
p: р ρ ⲣ
q: ԛ զ
s: ѕ 𐑈
u: ս υ
v: ѵ ν
w: ԝ
x: х
y: у ү
đ: ƌ
Đ: Ð Ɖ
æ: ӕ
Æ: Ӕ
ə: ә
Ə: Ә
-: ‐ ‑
!: ǃ
.: ․
:: ꞉
’: ʼ
·: ‧ ・
"""

#: Compatibility forms that draw what their decomposition draws; super, sub, circle, fraction and the like differ visibly.
SAME_SHAPE = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>"}
LONG_S = "ſ"
BLANKS = "\t\u0085  ⠀"
#: Drawn as nothing though not of category Cf or Cc: joiners, fillers, variation selectors.
EMPTY = re.compile("[͏ᅟᅠ឴឵᠋-᠏ㅤﾠ︀-️\U000e0100-\U000e01ef]")

_SHAPE = {ord(x): line[0] for line in LOOKALIKES.strip().splitlines() for x in line[2:].split()}


def _first(ch: str) -> str:
    """What a single character draws, before accents are composed."""
    if ch == "\n":
        return ch
    if ch in BLANKS or ud.category(ch) == "Zs":
        return " " if ch != " " else ch
    if ud.category(ch) in ("Cf", "Cc") or EMPTY.match(ch):
        return ""
    kind, _, rest = ud.decomposition(ch).partition(" ")
    if kind in SAME_SHAPE and ch != LONG_S:
        text = "".join(chr(int(x, 16)) for x in rest.split())
        if not (text[0] == " " and len(text) > 1):  # a free-standing accent is not a space and an accent
            return "".join(map(_first, text))
    return ch


class _Table(dict):
    """Character table filled on first use, so that no large table is stored."""

    def __init__(self, rule):
        super().__init__()
        self.rule = rule

    def __missing__(self, code: int) -> str:
        self[code] = value = self.rule(chr(code))
        return value


_FIRST = _Table(_first)
_SECOND = _Table(lambda ch: _SHAPE.get(ord(ch), ch))


def canonical_segment(text: str) -> str:
    """The canonical form of a text, by normalizing all of it."""
    out = ud.normalize("NFC", ud.normalize("NFD", text.translate(_FIRST)).translate(_SECOND))
    # a composed letter may itself be listed
    return ud.normalize("NFC", ud.normalize("NFD", out).translate(_SECOND)) if not out.isascii() else out


def is_stable(ch: str) -> bool:
    """Quick check: the character is canonical by itself and cannot combine with the one before it.

    That is the property NFC_Quick_Check=Yes with combining class 0, and of what NFD makes of the character no part changes. A character
    without decomposition, accent, look-alike or invisible category answers at once; the others are asked what they normalize to.
    """
    code = ord(ch)
    if ud.combining(ch) or ch in _joining() or not ch.isprintable() and ch != "\n":
        return False
    if not ud.decomposition(ch) and code not in _SHAPE and ch not in BLANKS and not EMPTY.match(ch):
        return ch.isalnum() or ch == " " or ch == "\n" or ud.category(ch) not in ("Zs", "Cf", "Cc", "Cn")
    return ch == canonical_segment(ch)


@cache
def _joining() -> frozenset[str]:
    """Characters of NFC_Quick_Check=Maybe: those that some composed character ends in, and the vowels and finals of Hangul."""
    last = {ud.normalize("NFD", chr(c))[-1] for c in range(0x110000) if (d := ud.decomposition(chr(c))) and d[0] != "<" and " " in d}
    return frozenset(last) | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}


def _ranges(codes) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(a, b) for a, b in out]


#: Where the quick check of the JVM knows stable characters: Latin letters, punctuation, currency. Texts of these alone never leave it.
LATIN = (*range(0x20, 0x250), *range(0x1E00, 0x1F00), *range(0x2010, 0x2030), *range(0x20A0, 0x20C0))


def _may_be_unstable() -> str:
    """A Java pattern of one character outside the stable ones of LATIN. ASCII, nearly all there is, is decided by its first class."""
    ranges = _ranges(c for c in LATIN if c < 0x7F or is_stable(chr(c)))
    return "(?=[^\\n\\x20-\\x7E])[^" + "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in ranges if b > 0x7F) + "]"


MAY_BE_UNSTABLE = _may_be_unstable()


@cache
def _runs() -> re.Pattern:
    """Runs of characters that fail the quick check, whatever their alphabet."""
    ranges = _ranges(c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and is_stable(chr(c)))
    return re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]+")


_short = lru_cache(1 << 16)(canonical_segment)


def canonical(text: str | None) -> str | None:
    """The canonical form, made by isolating runs that fail the quick check (with the character before
    each, which an accent in the run may join), normalizing only those, and splicing them into the
    unchanged rest.

    None stays None. Equal to canonical_segment(text) for every text.
    """
    if text is None:
        return text
    parts, done = [], 0
    for m in _runs().finditer(text):
        start, end = m.span()
        if start > done and text[start - 1] != "\n":
            start -= 1
        segment = text[start:end]
        parts += (text[done:start], _short(segment) if end - start < 16 else canonical_segment(segment))
        done = end
    return "".join((*parts, text[done:])) if parts else text

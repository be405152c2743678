"""Guessing the encoding of bytes that declare none.

Each candidate encoding has a model of its characters: what share of a text is
ASCII, frequent characters, rare ones, kana, marks and so on, each share spread
evenly over the characters of its class. Frequent characters are the first
level of the encoding's own standard, so the tables come from the codecs. All
candidates that decode a body explain the same bytes; the one under which they
are likeliest is taken. Whole bodies are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Byte order marks, and what a body without one may start a mode with (fixed values).
MARKS = {b"\xef\xbb\xbf": "utf-8", b"\xff\xfe": "utf-16", b"\xfe\xff": "utf-16"}
ISO_2022_JP = (b"\x1b$B", b"\x1b$@", b"\x1b(J")
#: Candidates, the first of equals first; shares of a text by class of character.
SHARES = {
    "gb18030": {"ascii": 0.28, "first": 0.6, "second": 0.02, "marks": 0.09, "wide": 0.005, "kana": 0.002, "other": 0.003},
    "big5": {"ascii": 0.28, "first": 0.6, "second": 0.02, "marks": 0.09, "kana": 0.002, "other": 0.003},
    "shift-jis": {"ascii": 0.28, "first": 0.2, "second": 0.01, "marks": 0.08, "kana": 0.42, "half": 0.005, "other": 0.003},
    "euc-jp": {"ascii": 0.28, "first": 0.2, "second": 0.01, "marks": 0.08, "kana": 0.42, "half": 0.0002, "other": 0.003},
    "euc-kr": {"ascii": 0.3, "hangul": 0.6, "first": 0.01, "marks": 0.05, "kana": 0.002, "other": 0.003},
    "utf-16-le": {"ascii": 0.3, "first": 0.35, "second": 0.01, "marks": 0.08, "kana": 0.1, "hangul": 0.1, "letters": 0.04, "other": 0.001},
    "utf-16-be": {"ascii": 0.3, "first": 0.35, "second": 0.01, "marks": 0.08, "kana": 0.1, "hangul": 0.1, "letters": 0.04, "other": 0.001},
    "windows-1252": {"ascii": 0.9, "letters": 0.08, "marks": 0.01, "other": 0.003},
    "windows-1251": {"ascii": 0.3, "letters": 0.65, "marks": 0.02, "other": 0.003},
}
#: Log likelihood of a control character, or of one that its encoding has no class for.
UNLIKELY = -25.0


def _encoded(name: str) -> list[bytes]:
    codec = {"shift-jis": "cp932", "euc-kr": "cp949"}.get(name, name)
    out = []
    for c in range(0x10000):
        try:
            out.append(chr(c).encode(codec))
        except UnicodeEncodeError:
            out.append(b"")
    return out


def _first_level(name: str, b: bytes) -> bool:
    """Whether an encoded Han character is of the first level of its standard."""
    if len(b) != 2:
        return False
    if name == "gb18030":
        return 0xB0 <= b[0] <= 0xD7 and b[1] >= 0xA1
    if name == "big5":
        return 0xA4 <= b[0] <= 0xC6
    if name == "shift-jis":
        return (0x889F <= b[0] << 8 | b[1] <= 0x9872)
    return name == "euc-jp" and 0xB0 <= b[0] <= 0xCF


def _second_level(name: str, b: bytes) -> bool:
    if name == "gb18030":
        return len(b) == 2 and 0xD8 <= b[0] <= 0xF7 and b[1] >= 0xA1
    return len(b) == 2


def _class(c: int, b: bytes, name: str) -> str:
    if 0x20 <= c < 0x7F or c in (9, 10, 13):
        return "ascii"
    if c < 0x20 or 0x7F <= c < 0xA0 or 0xE000 <= c < 0xF900:
        return "none"
    if 0x4E00 <= c < 0xA000:
        return "first" if _first_level(name, b) else "second" if _second_level(name, b) else "wide"
    if 0x3041 <= c <= 0x30FE:
        return "kana"
    if 0xAC00 <= c <= 0xD7A3:
        # KS X 1001 has the usual syllables; the extension has the others
        return "hangul" if name.startswith("utf") or (b[0] >= 0xB0 and b[1] >= 0xA1) else "other"
    if 0xFF61 <= c <= 0xFF9F:
        return "half"
    if 0x2010 <= c <= 0x2026 or 0x3001 <= c <= 0x3011 or 0xFF01 <= c <= 0xFF5E or c in (0xA0, 0xA9, 0xAB, 0xB7, 0xBB, 0x2014, 0x3000, 0x3014, 0x3015):
        return "marks"
    if (chr(c).isalpha() and c < 0x530) and name in ("windows-1252", "windows-1251", "utf-16-le", "utf-16-be"):
        return "letters"
    return "other"


@lru_cache(maxsize=None)
def table(name: str) -> np.ndarray:
    """Log likelihood of every character under an encoding; the last entry is
    that of all beyond the first plane."""
    encoded = _encoded(name)
    if name.startswith("utf-16"):
        levels = [_encoded(n) for n in ("gb18030", "big5", "shift-jis")]
        usual = [any(_first_level(n, e[c]) for n, e in zip(("gb18030", "big5", "shift-jis"), levels)) for c in range(0x10000)]
        classes = [("first" if usual[c] else "second") if 0x4E00 <= c < 0xA000 else _class(c, b, name) if b else "none" for c, b in enumerate(encoded)]
    else:
        classes = [_class(c, b, name) if b else "none" for c, b in enumerate(encoded)]
    sizes = {k: classes.count(k) for k in set(classes)}
    shares = SHARES[name]
    value = {k: float(np.log(shares[k] / n)) if k in shares else UNLIKELY for k, n in sizes.items()}
    return np.array([*(value[k] for k in classes), UNLIKELY], np.float64)


def likelihood(name: str, body: bytes) -> tuple[float, str] | None:
    """(log likelihood, text) of a body under an encoding; null if it does not decode."""
    codec = {"shift-jis": "cp932", "euc-kr": "cp949"}.get(name, name)
    try:
        text = body.decode(codec)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    except UnicodeError:
        return None
    return float(table(name)[np.minimum(points, 0x10000)].sum()), text


def guess(body: bytes) -> tuple[str, str] | None:
    """(encoding, text) of bytes that declare no charset: by a byte order mark, as UTF-8
    where they are (bytes with NUL are not), by mode switches, else the
    likeliest candidate; null where none decodes."""
    for mark, name in MARKS.items():
        if body.startswith(mark):
            try:
                return name, body.decode("utf-8-sig" if name == "utf-8" else name)
            except UnicodeError:
                pass
    if b"\0" not in body:
        try:
            text = body.decode("utf-8")
            if any(mode in body for mode in ISO_2022_JP):
                return "iso-2022-jp", body.decode("iso-2022-jp")
            return "utf-8", text
        except UnicodeError:
            pass
    best = None
    for name in SHARES:
        found = likelihood(name, body)
        if found is not None and (best is None or found[0] > best[0]):
            best = (found[0], name, found[1])
    if b"\0" in body and (best is None or best[0] / len(body) < UNLIKELY / 2):
        try:  # NUL bytes that UTF-16 does not explain
            return "utf-8", body.decode("utf-8")
        except UnicodeError:
            pass
    return best and best[1:]

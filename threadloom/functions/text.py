"""Full-text analysis: word splitting, folding and the original Porter stemmer."""

from __future__ import annotations

import functools
import re
import unicodedata

SHORTEST, LONGEST = 3, 64  # bytes that stemming looks at


@functools.lru_cache(maxsize=1 << 16)
def fold(ch: str) -> str:
    """One letter in folded form: case folded; a Latin letter with one mark loses it."""
    folded = ch.casefold()
    if len(folded) != 1:
        folded = ch.lower()[:1]
    parts = unicodedata.normalize("NFD", folded)
    if len(parts) == 2 and "a" <= parts[0] <= "z" and unicodedata.category(parts[1]) == "Mn":
        return parts[0]
    return folded


@functools.lru_cache(maxsize=1 << 16)
def _kind(ch: str) -> str:
    """t: part of a word; m: a combining mark, skipped inside a word; '': separator."""
    c = unicodedata.category(ch)
    if c[0] in "LN" or c == "Co":
        return "t"
    return "m" if c == "Mn" and unicodedata.combining(ch) in (220, 230, 232, 233, 234, 240) else ""


_ASCII = re.compile(r"[0-9A-Za-z]+")


def words(text: str) -> list[tuple[str, int, int]]:
    """(folded word, start, end) for every word of a text."""
    if text.isascii():
        return [(m[0].lower(), m.start(), m.end()) for m in _ASCII.finditer(text)]
    out, begin, word = [], -1, []
    for i, ch in enumerate(text):
        kind = _kind(ch)
        if kind == "t":
            if begin < 0:
                begin = i
            word.append(fold(ch))
        elif kind == "" or begin < 0:
            if begin >= 0:
                out.append(("".join(word), begin, i))
                begin, word = -1, []
    if begin >= 0:
        out.append(("".join(word), begin, len(text)))
    return out


def _vowel(s: str, i: int) -> bool:
    c = s[i]
    return c in "aeiou" or (c == "y" and i > 0 and not _vowel(s, i - 1))


def _measure(s: str) -> int:
    """How many times a run of vowels is followed by a run of consonants."""
    n, before = 0, False
    for i in range(len(s)):
        now = _vowel(s, i)
        n += before and not now
        before = now
    return n


def _has_vowel(s: str) -> bool:
    return any(_vowel(s, i) for i in range(len(s)))


def _short(s: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    n = len(s)
    return n >= 3 and not _vowel(s, n - 3) and _vowel(s, n - 2) and not _vowel(s, n - 1) and s[-1] not in "wxy"


# fixed values: the suffixes of the published algorithm
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
)


def _replace(s: str, table: dict[str, str], least: int) -> str:
    for size in range(min(7, len(s) - 1), 1, -1):
        if (end := s[-size:]) in table:
            return s[:-size] + table[end] if _measure(s[:-size]) >= least else s
    return s


def _plural(s: str) -> str:
    if not s.endswith("s") or s.endswith("ss"):
        return s
    if (s.endswith("sses") and len(s) > 4) or (s.endswith("ies") and len(s) > 3):
        return s[:-2]
    return s[:-1]


def _past(s: str) -> str:
    if s.endswith("eed") and len(s) > 3:
        return s[:-1] if _measure(s[:-3]) > 0 else s
    for end in ("ed", "ing"):
        if s.endswith(end) and _has_vowel(s[: -len(end)]):
            s = s[: -len(end)]
            if s.endswith(("at", "bl", "iz")):
                return s + "e"
            n = len(s)
            if n > 1 and s[-1] == s[-2] and not _vowel(s, n - 1) and s[-1] not in "lsz":
                return s[:-1]
            return s + "e" if _measure(s) == 1 and _short(s) else s
    return s


def _drop(s: str) -> str:
    for size in (5, 4, 3, 2):
        if len(s) > size and (end := s[-size:]) in STEP_4:
            rest = s[:-size]
            fits = _measure(rest) > 1 and (end != "ion" or rest[-1] in "st")
            return rest if fits else s
    return s


@functools.lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """Porter's stem of a folded word; bytes outside ASCII count as consonants."""
    raw = word.encode()
    if not SHORTEST <= len(raw) <= LONGEST:
        return word
    s = _past(_plural(raw.decode("latin-1")))
    if len(s) > 1 and s.endswith("y") and _has_vowel(s[:-1]):
        s = s[:-1] + "i"
    s = _drop(_replace(_replace(s, STEP_2, 1), STEP_3, 1))
    if s.endswith("e"):
        m = _measure(s[:-1])
        if m > 1 or (m == 1 and not _short(s[:-1])):
            s = s[:-1]
    if s.endswith("ll") and _measure(s) > 1:
        s = s[:-1]
    return s.encode("latin-1").decode("utf-8", "replace")


class _Folding(dict):
    """Each character's folded form, a space for separators, nothing for marks; filled as they come."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        kind = _kind(ch)
        self[code] = out = fold(ch) if kind == "t" else "" if kind == "m" else " "
        return out


_FOLDING = _Folding()


def split(text: str) -> list[str]:
    """The folded words of a text, without their places."""
    return text.translate(_FOLDING).split(" ") if text else []


def terms(text: str, stemmed: bool = True) -> list[str]:
    """Index terms of a text in order."""
    return [stem(w) if stemmed else w for w in split(text) if w]

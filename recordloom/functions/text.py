"""Words, stems and search text."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = r"[\p{L}\p{N}]+"


def search_text(payload: Column, evidence: Column, tags: Column) -> Column:
    """What full-text search reads: payload, evidence and tags as JSON text, keys included."""
    return F.concat_ws(" ", payload, evidence, tags)


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, in order (JVM side)."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({_TOKEN})"), F.lit(1))


def fold(text: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


_VOWELS = "aeiou"


def _cons(w: str, i: int) -> bool:
    c = w[i]
    return c not in _VOWELS and not (c == "y" and i > 0 and _cons(w, i - 1))


def _measure(w: str) -> int:
    shape = "".join("c" if _cons(w, i) else "v" for i in range(len(w)))
    return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", shape)))


def _has_vowel(w: str) -> bool:
    return any(not _cons(w, i) for i in range(len(w)))


def _cvc(w: str) -> bool:
    return len(w) > 2 and _cons(w, len(w) - 1) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 3) and w[-1] not in "wxy"


# The suffix tables of the published Porter algorithm (steps 2, 3 and 4).
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def porter(word: str) -> str:
    """The Porter stem of a lower-case ASCII word; other words stay as they are."""
    w = word
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = ""
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        cut = w[:-3]
    if cut:
        if cut[-2:] in ("at", "bl", "iz"):
            w = cut + "e"
        elif len(cut) > 1 and cut[-1] == cut[-2] and _cons(cut, len(cut) - 1) and cut[-1] not in "lsz":
            w = cut[:-1]
        else:
            w = cut + "e" if _measure(cut) == 1 and _cvc(cut) else cut
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for rule in sorted(table.split(), key=lambda r: -len(r.split(":")[0])):
            old, new = rule.split(":")
            if w.endswith(old):
                if _measure(w[: -len(old)]) > 0:
                    w = w[: -len(old)] + new
                break
    for old in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(old):
            stem = w[: -len(old)]
            if _measure(stem) > 1 and (old != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w

"""Numbers that stand before paragraphs: "1.2.", "3.ª", "Cláusula quinta:", "XIV -", "b)".

A number is read in two steps: a few characters at the start are taken as a token and its closing sign, then the token is looked
up among the numerals, which are made from tables.  Column expressions and plain Python read alike.
"""

from __future__ import annotations

import re
import unicodedata

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: stems of the ordinal words, and words that name a clause
STEMS = "primer segund tercer cuart quint sext septim setim octav noven decim undecim duodecim vigesim trigesim cuadragesim".split()
CLAUSES = ["cláusula", "artículo", "art.", "estipulación", "apartado", "epígrafe", "punto", "anexo", "sección", "capítulo"]


def roman(n: int) -> str:
    out = ""
    for sign, value in (("c", 100), ("xc", 90), ("l", 50), ("xl", 40), ("x", 10), ("ix", 9), ("v", 5), ("iv", 4), ("i", 1)):
        out += sign * (n // value)
        n %= value
    return out


def _numerals() -> frozenset[str]:
    """Ordinal words in both genders and numbers, alone or before another up to ninth, and Roman numerals of up to six letters."""
    alone = {s + e for s in STEMS for e in ("", "o", "a", "os", "as")}
    units = {s + e for s in STEMS[: STEMS.index("decim")] for e in "oa"}
    return frozenset(alone | {a + gap + u for a in alone for gap in ("", " ") for u in units} | {r for n in range(1, 400) if len(r := roman(n)) <= 6})


NUMERALS = _numerals()


def _fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).lower()


# "art." and "articulo" with and without accent; all forms in any case
_names = "|".join(sorted({w.replace(".", "\\.") for c in CLAUSES for w in (c, _fold(c))}, key=len, reverse=True))
_CLAUSE = f"(?iu)^\\s*(?:{_names})\\s+"
#: Sections in figures, or one or two words; the second group is the closing sign.
_TOKEN = "([0-9]{1,3}(?:\\s?[.,]\\s?[0-9]{1,3}){0,3}(?:\\s?\\.?[ºª°])?|\\p{L}+(?:\\s\\p{L}+)?)\\s*([.:)\\-–—])"
_LEAD = f"^\\s*{_TOKEN}(?:\\s*-)?(?![0-9])\\s*"
_START = f"^\\s*{_TOKEN}"
#: A figure with its ordinal sign needs no other closing sign.
_SIGNED = "^\\s*[0-9]{1,3}\\s?\\.?\\s?[ºª°]\\.?\\s*(?:[.:)\\-–—]\\s*-?)?(?=\\s)\\s*"

#: The most frequent form, "3. Text", which all of them read alike.
_PLAIN = re.compile(r"([0-9]{1,3}\.) +(?=[^\W\d_ºª])")

_PY = {p: regex.compile(p.replace("(?iu)", ""), regex.I) for p in (_CLAUSE, _LEAD, _START, _SIGNED)}


#: First letters of names of clauses, with the long s, which patterns in any case take for an s; and ordinal signs.
_FIRST, _ORDINAL = {c[0] for c in CLAUSES} | {"ſ"}, set("ºª°")


def _is_number(token: str, letter: bool) -> bool:
    return token[0].isdigit() or _fold(token).replace("\n", " ") in NUMERALS or (letter and len(token) == 1)


def _named(s: str) -> regex.Match | None:
    """The word that names a clause; most paragraphs start with a character that none does."""
    return _PY[_CLAUSE].match(s) if s[:1].isspace() or s[:1].lower() in _FIRST else None


def number_end(s: str) -> int:
    """Where the number at the start of a paragraph ends; 0 if there is none."""
    if m := _PLAIN.match(s):
        return m.end()
    named = _named(s)
    for at in [named.end(), 0] if named else [0]:
        rest = s[at:]
        # three figures, two blanks and a dot before the sign at most
        if (rest[:1].isspace() or _ORDINAL & set(rest[:7])) and (m := _PY[_SIGNED].match(rest)):
            return at + m.end()
        if (m := _PY[_LEAD].match(rest)) and _is_number(m[1], m[2] in ".)" and rest[m.end(2) : m.end(2) + 1].isspace()):
            return at + m.end()
    return 0


def clause_mark(s: str) -> str:
    """The number with which a clause starts, with its word and closing sign; empty if none does."""
    if m := _PLAIN.match(s):
        return m[1]
    named = _named(s)
    for at in [named.end(), 0] if named else [0]:
        if (m := _PY[_START].match(s[at:])) and _is_number(m[1], False):
            return s[: at + m.end()]
    return ""


_numeral = f"^(?:(?:{'|'.join(STEMS)})(?:[oa]s?)?(?:\\s?(?:{'|'.join(STEMS[: STEMS.index('decim')])})[oa])?|{'|'.join(sorted(n for n in NUMERALS if len(n) <= 6 and set(n) <= set('ivxlc')))})$"


def _read(rest: Column, pattern: str, letter: bool) -> Column:
    """Whether a number is read at the start."""
    token, sign = F.regexp_extract(rest, pattern, 1), F.regexp_extract(rest, pattern, 2)
    folded = F.regexp_replace(F.translate(F.lower(token), "áéíóúü", "aeiouu"), "[\u0300-\u036f]", "")
    test = token.rlike("^[0-9]") | folded.rlike(_numeral)
    if letter:
        test = test | ((F.length(token) == 1) & sign.isin(".", ")") & rest.rlike("^\\s*\\p{L}\\s*[.)]\\s"))
    return (token != "") & test


def without_number(c: Column) -> Column:
    """A paragraph without the number at its start, if anything is left."""

    def rest_of(x: Column) -> Column:
        return F.when(x.rlike(_SIGNED), F.regexp_replace(x, _SIGNED, "")).when(_read(x, _LEAD, True), F.regexp_replace(x, _LEAD, ""))

    bare = F.coalesce(F.when(c.rlike(_CLAUSE), rest_of(F.regexp_replace(c, _CLAUSE, ""))), rest_of(c), c)
    return F.when(bare == "", c).otherwise(bare)


def starts_clause(c: Column) -> Column:
    """Whether a paragraph starts with a number, which a letter is not."""
    return _read(c, _START, False) | (c.rlike(_CLAUSE) & _read(F.regexp_replace(c, _CLAUSE, ""), _START, False))

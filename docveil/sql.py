"""SQL access: checks as SQL functions, detection as a table function and masking of texts, and matches of a table as a view."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.checks import CCC_WEIGHTS, CIF_FORMS, CIF_LETTERS, DNI_LETTERS
from .functions.mask import masked
from .operators.detect import PATTERNS, Options, detect
from .operators.spans import exploded

_CLEAN = "upper(regexp_replace(v, '[^0-9A-Za-z]', ''))"
_LETTER = f"substring('{DNI_LETTERS}', cast({{n}} as bigint) % 23 + 1, 1)"
_DIGITS = "regexp_replace(v, '[^0-9]', '')"
_CIF = f"regexp_replace({_CLEAN}, '^ES(?=[A-Z][0-9])', '')"


def _digit(text: str, at: int) -> str:
    return f"cast(substring({text}, {at}, 1) as int)"


def _account_control(first: int, weights: list[int], control: int) -> str:
    """Whether the digits from a place on, weighted, give the control digit."""
    rest = f"(11 - ({' + '.join(f'{_digit(_DIGITS, first + k)} * {w}' for k, w in enumerate(weights))}) % 11)"
    return f"case {rest} when 11 then 0 when 10 then 1 else {rest} end = {_digit(_DIGITS, control)}"


def _company_control() -> str:
    """The digit that the seven digits of a company number ask for."""
    digits = [_digit(_CIF, k + 2) for k in range(7)]
    doubled = [f"({d} * 2 div 10 + {d} * 2 % 10)" if k % 2 == 0 else d for k, d in enumerate(digits)]
    return f"cast((10 - ({' + '.join(doubled)}) % 10) % 10 as int)"


FUNCTIONS = {
    "is_valid_dni": f"coalesce(case when {_CLEAN} rlike '^[0-9]{{8}}[A-Z]$' then {_LETTER.format(n=f'substring({_CLEAN}, 1, 8)')} = substring({_CLEAN}, 9, 1) end, false)",
    "is_valid_nie": f"coalesce(case when {_CLEAN} rlike '^[XYZ][0-9]{{7}}[A-Z]$' then {_LETTER.format(n=f"concat(translate(substring({_CLEAN}, 1, 1), 'XYZ', '012'), substring({_CLEAN}, 2, 7))")} = substring({_CLEAN}, 9, 1) end, false)",
    "is_valid_iban": f"coalesce(case when {_CLEAN} rlike '^[A-Z]{{2}}[0-9]{{2}}[0-9A-Z]{{10,30}}$' then aggregate(filter(split(concat(substring({_CLEAN}, 5), substring({_CLEAN}, 1, 4)), ''), c -> c <> ''), 0, (a, c) -> (a * case when c between '0' and '9' then 10 else 100 end + case when c between '0' and '9' then ascii(c) - 48 else ascii(c) - 55 end) % 97) = 1 end, false)",
    "is_valid_ccc": f"coalesce(case when length({_DIGITS}) = 20 then {_account_control(1, CCC_WEIGHTS[2:], 9)} and {_account_control(11, CCC_WEIGHTS, 10)} end, false)",
    "is_valid_nss": f"coalesce(case when length({_DIGITS}) = 12 then cast(substring({_DIGITS}, 1, 10) as bigint) % 97 = cast(substring({_DIGITS}, 11, 2) as int) end, false)",
    "is_valid_cif": f"coalesce(case when {_CIF} rlike '^[{CIF_FORMS}][0-9]{{7}}[0-9A-J]$' then substring({_CIF}, 9, 1) in (cast({_company_control()} as string), substring('{CIF_LETTERS}', {_company_control()} + 1, 1)) end, false)",
    "is_valid_card": "coalesce(case when length(regexp_replace(v, '[^0-9]', '')) between 13 and 19 then luhn_check(regexp_replace(v, '[^0-9]', '')) end, false)",
}


def register(spark: SparkSession) -> None:
    """Install the checks as temporary SQL functions of one string."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS BOOLEAN RETURN {body}")


def matches_view(spark: SparkSession, table: str, view: str, text_col: str = "text", options: Options | None = None) -> None:
    """A temporary view with a row for each match in a table: its columns but the text, and type, value, start, end, confidence, valid, seq, masked.

    ``masked`` is what may be shown of the value; select it instead of ``value`` where the reader may not see the data.
    """
    found = exploded(detect(spark.table(table), text_col, options).drop(text_col))
    found.withColumn("masked", masked(F.col("type"), F.col("value"))).createOrReplaceTempView(view)

def _text(v: str) -> str:
    """A pattern or a word as a SQL literal in which backslashes stand for themselves."""
    if "'" in v:
        raise ValueError("no quotes in patterns")
    return f"r'{v}'"


_EMPTY = "cast(array() as array<struct<value:string,start:int,end:int>>)"
_MATCH = "struct<type:string,value:string,start:int,end:int,confidence:string,valid:boolean>"


def _spans(pattern: str) -> str:
    """SQL of the places of a pattern ``(prefix)(value)`` in ``t``; what is added up are lengths."""
    p = _text(pattern)
    start = "a.at + length(x.`3`) + length(x.`1`)"
    own = f"named_struct('value', x.`2`, 'start', {start}, 'end', {start} + length(x.`2`))"
    step = f"(a, x) -> if(x.`0` is null, a, named_struct('at', a.at + length(x.`3`) + length(x.`0`), 'out', concat(a.out, array({own}))))"
    parts = f"arrays_zip(regexp_extract_all(t, {p}, 0), regexp_extract_all(t, {p}, 1), regexp_extract_all(t, {p}, 2), split(t, {p}, -1))"
    return f"if(t rlike {p}, aggregate({parts}, named_struct('at', 0, 'out', {_EMPTY}), {step}, a -> a.out), {_EMPTY})"


def _holds(check: str) -> str:
    """The body of a check, of the value of a span ``s``; functions of SQL can't be called inside of lambdas."""
    return f"({re.sub(r'\bv\b', 's.value', FUNCTIONS[check])})"


_BROKEN = "contains(s.value, '\\n')"
_SPAN_DIGITS = "regexp_replace(s.value, '[^0-9]', '')"
_ALONE = "not substring(t, greatest(s.start - 1, 1), least(s.start, 2)) rlike '[0-9][ .-]?$' and not substring(t, s.end + 1, 2) rlike '^[ .-]?[0-9]' and length(s.value) - length(replace(s.value, '\\n', '')) <= 1"
_SURE = "if({0}, 'alta', 'media')"


def _families() -> list[tuple[str, str, str, str, str]]:
    """(pattern, type, keep, confidence, valid) of the types that their own characters decide, in order of detection."""
    dni, nie, ccc = _holds("is_valid_dni"), _holds("is_valid_nie"), _holds("is_valid_ccc")
    return [
        ("dni", "dni", f"{dni} or not ({_BROKEN} or contains(s.value, '.'))", _SURE.format(dni), dni),
        ("nie", "nie", f"{nie} or not {_BROKEN}", _SURE.format(nie), nie),
        ("iban", "iban", _holds("is_valid_iban"), "'alta'", "true"),
        ("cuenta", "cuenta", f"not {_BROKEN} or {ccc}", "'media'", "false"),
        ("tarjeta", "tarjeta", _holds("is_valid_card"), "'alta'", "true"),
        ("phone_es", "telefono", f"{_SPAN_DIGITS} rlike '^(?:34|0034)?[0-9]{{9}}$' and {_ALONE}", "'alta'", "true"),
        ("phone_int", "telefono", f"length({_SPAN_DIGITS}) between 8 and 15 and {_ALONE}", "'media'", "false"),
        ("email", "email", "true", "'alta'", "true"),
    ]


def _matches_body() -> str:
    """SQL of the matches in ``t``: the longest first, then the surer, the first, and the order of families; those that overlap none before stay."""
    one = lambda p, kind, keep, sure, valid: f"transform(filter({_spans(PATTERNS[p])}, s -> {keep}), s -> named_struct('type', '{kind}', 'value', s.value, 'start', s.start, 'end', s.end, 'confidence', {sure}, 'valid', {valid}))"
    found = f"concat({', '.join(one(*f) for f in _families())})"
    ranked = f"array_sort(transform({found}, (m, i) -> named_struct('l', m.start - m.end, 'w', if(m.confidence = 'alta', -3, -2), 's', m.start, 'i', i, 'm', m)))"
    chosen = f"aggregate({ranked}, cast(array() as array<{_MATCH}>), (won, r) -> if(exists(won, e -> r.m.start < e.end and r.m.end > e.start), won, concat(won, array(r.m))))"
    return f"transform(array_sort(transform({chosen}, m -> named_struct('s', m.start, 'm', m))), k -> k.m)"


def _mask_body() -> str:
    """SQL of what may be shown of a ``value`` of a ``kind``: the same as ``mask.masked``."""
    v = "trim(regexp_replace(value, r'\\s+', ' '))"
    cover = lambda c: f"regexp_replace({c}, '[0-9A-Za-zÀ-ÿ]', '*')"
    a = f"upper(regexp_replace({v}, '[^0-9A-Za-z]', ''))"
    d = f"regexp_replace({v}, '[^0-9]', '')"
    mail = _text(r"(?i)^([^@\s])[^@\s]*@([^.\s])[^\s]*?(\.[a-z]{2,})$")
    kept = {
        "'dni'": (f"length({a}) >= 9", f"concat('***', substring({a}, 4, 4), repeat('*', length({a}) - 7))"),
        "'nie'": (f"length({a}) >= 9", f"concat('****', substring({a}, 5, 4), repeat('*', length({a}) - 8))"),
        "'iban'": (f"length({a}) >= 8", f"concat(substring({a}, 1, 4), ' **** **** **** **** ', right({a}, 4))"),
        "'cuenta', 'tarjeta'": (f"length({a}) >= 8", f"concat('**** **** **** ', right({a}, 4))"),
        "'telefono'": (f"length({d}) >= 6", f"concat('*** *** ', right({d}, 3))"),
        "'email'": (f"{v} rlike {mail}", f"concat(regexp_extract({v}, {mail}, 1), '***@', regexp_extract({v}, {mail}, 2), '***', regexp_extract({v}, {mail}, 3))"),
        "'nombre', 'empresa', 'direccion', 'personalizado'": ("true", f"array_join(transform(split({v}, ' '), w -> if(length(w) <= 1, w, concat(substring(w, 1, 1), {cover('substring(w, 2)')}))), ' ')"),
        "'fecha_nac'": (f"{v} rlike '[0-9]{{4}}$'", f"concat(regexp_replace(substring({v}, 1, length({v}) - 4), '[0-9]', '*'), right({v}, 4))"),
        "'cp'": (f"length({v}) >= 2", f"concat(substring({v}, 1, 2), {cover(f'substring({v}, 3)')})"),
        "'importe'": ("true", f"concat(regexp_extract({v}, '^([^0-9]*[0-9])', 1), regexp_replace(substring({v}, length(regexp_extract({v}, '^([^0-9]*[0-9])', 1)) + 1), '[0-9]', '*'))"),
    }
    cases = " ".join(f"when kind in ({k}) then if({ok}, {shown}, {cover(v)})" for k, (ok, shown) in kept.items())
    rest = f"if(length({v}) > 3, concat(substring({v}, 1, 2), {cover(f'substring({v}, 3, length({v}) - 3)')}, right({v}, 1)), {cover(v)})"
    return f"case {cases} else {rest} end"


def _masked_text() -> str:
    """SQL of ``t`` with its matches ``ms`` covered; the text between two matches is cut by their places."""
    one = re.sub(r"\bvalue\b", "m.value", re.sub(r"\bkind\b", "m.type", _mask_body()))
    gap = "substring(t, if(i = 0, 0, get(ms, i - 1).end) + 1, m.start - if(i = 0, 0, get(ms, i - 1).end))"
    return f"if(size(ms) = 0, t, concat(array_join(transform(ms, (m, i) -> concat({gap}, {one})), ''), substring(t, get(ms, size(ms) - 1).end + 1)))"


def register_detection(spark: SparkSession) -> None:
    """Install ``detect_pii``, ``pii_matches``, ``mask_value`` and ``mask_pii`` as temporary SQL functions.

    ``detect_pii(text)`` is a table function for LATERAL, of (type, value, start, end, confidence, valid); ``pii_matches(text)`` gives the same as an array.
    They find the types of ``LATERAL_TYPES``, by the detectors' own patterns and checks; types that need the words around, dictionaries or
    a scan are left to ``detect``, as are values glued to words and foreign accounts.  ``mask_value(type, value)`` is what may be shown, of any type, and
    ``mask_pii(text)`` the text with it.  Of a null text there are no rows, and its masked text is null.  All are built-in functions, without a shuffle.
    """
    make = "CREATE OR REPLACE TEMPORARY FUNCTION"
    columns = "type STRING, value STRING, start INT, `end` INT, confidence STRING, valid BOOLEAN"
    spark.sql(f"{make} pii_matches(t STRING) RETURNS ARRAY<{_MATCH.replace('end:', '`end`:')}> RETURN if(t is null, null, {_matches_body()})")
    spark.sql(f"{make} detect_pii(t STRING) RETURNS TABLE ({columns}) RETURN SELECT m.type, m.value, m.start, m.end, m.confidence, m.valid FROM explode(if(t is null, null, {_matches_body()})) AS x(m)")
    spark.sql(f"{make} mask_value(kind STRING, value STRING) RETURNS STRING RETURN {_mask_body()}")
    spark.sql(f"{make} mask_pii(t STRING) RETURNS STRING RETURN if(t is null, null, get(transform(array({_matches_body()}), ms -> {_masked_text()}), 0))")


#: Types that ``detect_pii`` finds.
LATERAL_TYPES = ["dni", "nie", "iban", "cuenta", "tarjeta", "telefono", "email"]

"""Detectors of personal and financial data in Spanish documents, as one column expression over a text column.

Pattern families are built-in functions only, each a ``(prefix)(value)`` pattern whose prefix keeps values apart from longer ones.  What
needs a scan with state (addresses, amounts in words, companies, names, foreign account numbers) is one Arrow function, called only when such a
type is wanted.  Branches of types that aren't wanted are never built.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.text import before, digits, fold_signs, hinted, unaccent
from .spans import MATCHES, match, overlaps, pattern_spans, resolve

# fixed values: types, their groups and labels, presets and the types that go together
TYPES = ["dni", "nie", "iban", "cuenta", "tarjeta", "telefono", "email", "nss", "matricula", "direccion", "cp", "fecha_nac", "nombre", "empresa", "cif", "importe"]
GROUPS = {"identidad": ["dni", "nie", "nombre", "fecha_nac", "empresa", "cif"], "contacto": ["telefono", "email", "direccion", "cp"], "dinero": ["iban", "cuenta", "tarjeta", "importe"], "otros": ["nss", "matricula"]}
BOXES = ["dni", "nombre", "fecha_nac", "empresa", "telefono", "email", "direccion", "iban", "tarjeta", "importe", "nss", "matricula"]
PRESETS = {"general": BOXES, "contrato": BOXES, "captura": BOXES, "nomina": [t for t in BOXES if t not in ("tarjeta", "matricula", "importe", "empresa")]}
COMPANIONS = {"direccion": "cp", "dni": "nie", "iban": "cuenta", "empresa": "cif"}
SEQUENTIAL = ("direccion", "importe", "empresa", "nombre", "iban")
# fixed values: words that hint at a type when they stand before it
HINTS = {
    "nss": ["seguridad social", "nss", "n.s.s", "afiliación", "naf", "n.a.f"],
    "fecha_nac": ["nacimiento", "nacido", "nacida", "f. nac", "f.nac", "fec. nac", "fecha de nac", "fecha nac", "nac.:", "born"],
    "cp": ["cp", "c.p.", "código postal"],
    "cif": ["cif", "c.i.f", "nif", "n.i.f", "vat", "nif-iva"],
    "dni": ["dni", "d.n.i", "nif", "n.i.f", "documento"],
    "nie": ["nie", "n.i.e", "tie", "extranjero", "nif", "n.i.f", "documento"],
    "email": ["correo", "email", "e-mail", "mail", "electrónico"],
    "matricula": ["matrícula"],
    "via": ["calle", "c/", "avda", "avenida", "plaza", "pza", "paseo", "pº", "camino", "carretera", "ctra", "ronda", "travesía", "urbanización", "urb", "glorieta", "rambla", "bulevar", "domicilio", "dirección"],
}
MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
# fixed values: characters that readers of scans mistake
DIGIT_AS_LETTER = {"0": "DOQ", "1": "ILT", "2": "Z", "4": "A", "5": "S", "6": "G", "7": "ZT", "8": "B"}
LETTER_AS_DIGIT = ("OoIlSBZ", "0011582")

# fixed values: what may separate the parts of one value, with at most one line break among them, and the families' patterns
_B = "[ \\t\\u00a0]*"
BREAK = f"{_B}[-/.]?{_B}\\n{_B}[-/.]?{_B}"
SEP, SEP_PHONE, SEP_NSS = (f"(?:{BREAK}|{c})?" for c in ("[ -]", "[ .-]", "[ /.-]"))
_READ = "[0-9OoIlSBZ]"
_LET = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"
_ID_START, _WORD_START = "(^|[^\\w@.\\-/])", "(^|[^\\w])"
PATTERNS = {
    "dni": f"{_ID_START}((?:[0-9]{{8}}|[0-9]{{2}}\\.[0-9]{{3}}\\.[0-9]{{3}}){SEP}[A-Za-z])(?![\\w-])",
    "nie": f"{_ID_START}([XYZxyz]{SEP}[0-9]{{7}}{SEP}[A-Za-z])(?![\\w-])",
    "cif": f"{_ID_START}((?:ES{SEP})?[ABCDEFGHJNPQRSUVW]{SEP}[0-9]{{7}}{SEP}[0-9A-J])(?![\\w-])",
    "iban": f"{_WORD_START}([Ee][Ss](?:{SEP}[0-9]){{22}})(?![\\w])",
    "cuenta": f"{_WORD_START}([0-9]{{4}}{SEP}[0-9]{{4}}{SEP}[0-9]{{2}}{SEP}[0-9]{{10}})(?![0-9])",
    "tarjeta": f"{_WORD_START}([0-9]{{4}}(?:{SEP}[0-9]{{4}}){{2,4}}|[0-9]{{13,19}})(?![0-9])",
    "phone_es": f"(^|[^\\w+])((?:(?:\\+34|0034){SEP})?[6-9](?:{SEP_PHONE}[0-9]){{8}})(?![0-9])",
    "phone_int": f"{_WORD_START}(\\+[0-9]{{1,3}}{SEP}(?:[0-9]{SEP_PHONE}){{7,12}}[0-9])(?![0-9])",
    "email": "(^|[^\\w.+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,})(?![\\w-])",
    "nss": f"{_WORD_START}([0-9]{{2}}{SEP_NSS}[0-9]{{8}}{SEP_NSS}[0-9]{{2}})(?![0-9])",
    "plate": f"{_WORD_START}([0-9]{{4}}{SEP}[BCDFGHJKLMNPRSTVWXYZbcdfghjklmnprstvwxyz]{{3}})(?![\\w])",
    "plate_old": f"{_WORD_START}([A-Za-z]{{1,2}}[ -]?[0-9]{{4}}[ -]?[A-Za-z]{{1,2}})(?![\\w])",
    "cp": f"{_WORD_START}([0-9]{{5}})(?![0-9])",
    "date": f"{_WORD_START}([0-9]{{1,2}}[/.-][0-9]{{1,2}}[/.-][0-9]{{2,4}})(?![0-9])",
    "date_words": f"(?i){_WORD_START}([0-9]{{1,2}}\\s+de\\s+(?:{'|'.join([*MONTHS, 'setiembre'])})\\s+de\\s+[0-9]{{4}})(?![\\w])",
    "dni_glued": f"([{_LET}])([0-9]{{8}}[A-Z])(?![\\w-])",
    "nie_glued": f"([{_LET}])([XYZ][0-9]{{7}}[A-Z])(?![\\w-])",
    "iban_glued": f"([a-záéíóúüñ])(ES(?:{SEP}[0-9]){{22}})(?![\\w])",
    "dni_read": f"{_ID_START}({_READ}{{8}}{SEP}[0-9A-Za-z])(?![\\w-])",
    "nie_read": f"{_ID_START}([XYZxyz]{SEP}{_READ}{{7}}{SEP}[0-9A-Za-z])(?![\\w-])",
    "iban_read": f"{_WORD_START}([EF][S5](?:{SEP}{_READ}){{22}})(?![\\w])",
    "cuenta_read": f"{_WORD_START}({_READ}{{4}}{SEP}{_READ}{{4}}{SEP}{_READ}{{2}}{SEP}{_READ}{{10}})(?![\\w])",
    "email_read": "(^|[^\\w.+-])((?:[a-z0-9_%+-]+(?: \\. ?|\\. ))?[A-Za-z0-9._%+-]+[@Q©&(][A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,})(?![\\w-])",
    "email_no_at": "(^|[^\\w.+-])([A-Za-z0-9._%+-]{3,}[A-Za-z0-9-]\\.[A-Za-z]{2,6})(?![\\w-])",
}


@dataclass
class Options:
    """What to look for.  ``types`` wins over ``preset``; companions of a type are added to a preset's."""

    types: list[str] | None = None
    preset: str = "general"
    ocr: bool = False
    all_dates: bool = False
    terms: list[str] = field(default_factory=list)
    partial: bool = False
    keep_visible: list[str] = field(default_factory=list)
    first_names: frozenset[str] = frozenset()
    surnames: frozenset[str] = frozenset()
    companies: frozenset[str] = frozenset()

    def wanted(self) -> list[str]:
        if self.types and (bad := [t for t in self.types if t not in TYPES]):
            raise ValueError(f"unknown types {bad}; there are {TYPES}")
        if not self.types and self.preset not in PRESETS:
            raise ValueError(f"unknown preset {self.preset!r}; there are {sorted(PRESETS)}")
        base = list(self.types or PRESETS[self.preset])
        return list(dict.fromkeys(base + [c for t, c in COMPANIONS.items() if t in base]))


def _read_digits(c: Column) -> Column:
    return F.translate(c, *LETTER_AS_DIGIT)


def _letter_may_be(control: Column, last: Column) -> Column:
    """Whether the control letter is the last character, or a letter that this digit can be misread from."""
    maybe = F.create_map(*[F.lit(x) for kv in DIGIT_AS_LETTER.items() for x in kv])
    return F.when(last.rlike("[0-9]"), F.contains(F.coalesce(F.try_element_at(maybe, last), F.lit("")), control)).otherwise(F.upper(last) == control)


def _family(text: Column, name: str, kind: str, seq: int, keep, confidence, valid) -> Column:
    """Matches of a pattern: ``keep``, ``confidence`` and ``valid`` are functions of a span, or constants."""
    of = lambda f, s: f(s) if callable(f) else F.lit(f)
    spans = pattern_spans(text, PATTERNS[name])
    kept = F.filter(spans, lambda s: of(keep, s)) if keep is not True else spans
    return F.transform(kept, lambda s, i: match(kind, s, of(confidence, s), of(valid, s), seq, i))


def _broken(s: Column) -> Column:
    return F.contains(s["value"], F.lit("\n"))


def _sure_or_half(ok: Column) -> Column:
    return F.when(ok, "alta").otherwise("media")


def _glued_to_word(text: Column, s: Column) -> Column:
    return before(text, s["start"], 30).rlike(f"[{_LET}]{{4,}}$")


def _at_line_start(text: Column, s: Column) -> Column:
    return F.regexp_extract(F.substring(text, F.lit(1), s["start"]), "[^\\n\\t]*$", 0).rlike("^\\s*$")


def _alone(text: Column, s: Column) -> Column:
    """Not a piece of a longer row of numbers, nor over more than two lines."""
    after = F.substring(text, s["end"] + 1, F.lit(2))
    return ~before(text, s["start"], 2).rlike("[0-9][ .-]?$") & ~after.rlike("^[ .-]?[0-9]") & (F.regexp_count(s["value"], F.lit("\\n")) <= 1)


def term_pattern(term: str, partial: bool = False, ocr: bool = False) -> str | None:
    """Pattern of a custom term over folded text; None if it is too short."""
    import re
    import unicodedata

    from ..functions.text import SIGNS

    plain = "".join(SIGNS.get(c, c) for c in unicodedata.normalize("NFD", term.strip()) if not unicodedata.combining(c))
    if len(plain) < 2:
        return None
    letter = lambda c: "[ºª?*'\"^`˚oO0-9]" if ocr and c in "ºª" else re.escape(c)
    gap = "(?:-?[ \\t\\u00a0]*\\n[ \\t\\u00a0]*|\\u00ad)?"
    body = "[\\s,.;:]*".join(gap.join(letter(c) for c in w) for w in plain.split())
    return f"(?i)()({body})" if partial else f"(?i)(^|[^A-Za-z0-9])({body})(?![A-Za-z0-9])"


def _as_term(seq: int):
    return lambda s, i: match("personalizado", s, "alta", True, seq, i)


def _terms(text: Column, options: Options, seq: int) -> list[Column]:
    # folding keeps positions here: one character for one
    plain = fold_signs(_fold_in_place(text))
    out = []
    for k, term in enumerate(options.terms):
        if p := term_pattern(term, options.partial, options.ocr):
            own = F.transform(pattern_spans(plain, p), lambda s: F.struct(F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("value"), s["start"].alias("start"), s["end"].alias("end")))
            out.append(F.transform(own, _as_term(seq + k)))
    return out


def _fold_in_place(c: Column) -> Column:
    from ..functions.text import _ACCENTED, _PLAIN

    return F.translate(c, _ACCENTED, _PLAIN)


def raw_matches(text: Column, options: Options | None = None, sequential: Column | None = None) -> Column:
    """All matches before the choice among overlapping ones, in order of detection."""
    o = options or Options()
    want = set(o.wanted())
    t = text
    hint = lambda kind, s, w: hinted(t, s["start"], HINTS[kind], w)
    dotted = lambda s: F.contains(s["value"], F.lit("."))
    clean = lambda s: F.regexp_replace(s["value"], "[^0-9A-Za-z]", "")
    out: list[Column] = []
    fam = lambda *a: out.append(_family(t, *a))

    if "dni" in want:
        fam("dni", "dni", 0, lambda s: checks.is_dni(s["value"]) | ~(_broken(s) | dotted(s)), lambda s: _sure_or_half(checks.is_dni(s["value"])), lambda s: checks.is_dni(s["value"]))
        if o.ocr:
            body, last = (lambda s: F.substring(clean(s), 1, 8)), (lambda s: F.substring(clean(s), 9, 1))
            read = lambda s: (F.length(digits(body(s))) >= 6) & ~(body(s).rlike("^[0-9]{8}$") & last(s).rlike("[A-Za-z]")) & _letter_may_be(checks.dni_letter(_read_digits(body(s))), last(s))
            fam("dni_read", "dni", 1, lambda s: read(s) & (hint("dni", s, 30) | _at_line_start(t, s)), lambda s: _sure_or_half(hint("dni", s, 30)), True)
        fam("dni_glued", "dni", 3, lambda s: checks.is_dni(s["value"]) & _glued_to_word(t, s), "alta", True)
    if "nie" in want:
        if o.ocr:
            nb, nl = (lambda s: F.substring(clean(s), 2, 7)), (lambda s: F.substring(clean(s), 9, 1))
            number = lambda s: F.concat(F.translate(F.upper(F.substring(clean(s), 1, 1)), "XYZ", "012"), _read_digits(nb(s)))
            fam("nie_read", "nie", 2, lambda s: (F.length(digits(nb(s))) >= 5) & ~(nb(s).rlike("^[0-9]{7}$") & nl(s).rlike("[A-Za-z]")) & _letter_may_be(checks.dni_letter(number(s)), nl(s)), lambda s: _sure_or_half(hint("nie", s, 30)), True)
        fam("nie_glued", "nie", 4, lambda s: checks.is_nie(s["value"]) & _glued_to_word(t, s), "alta", True)
        fam("nie", "nie", 5, lambda s: checks.is_nie(s["value"]) | ~_broken(s), lambda s: _sure_or_half(checks.is_nie(s["value"])), lambda s: checks.is_nie(s["value"]))
    if "cif" in want:
        fam("cif", "cif", 6, lambda s: checks.cif_control(s["value"]) | hint("cif", s, 40), lambda s: _sure_or_half(checks.cif_control(s["value"]) & hint("cif", s, 40)), False)
    if "iban" in want:
        fam("iban", "iban", 7, lambda s: checks.is_iban(s["value"]), "alta", True)
        fam("iban_glued", "iban", 9, lambda s: checks.is_iban(s["value"]) & _glued_to_word(t, s), "alta", True)
        if o.ocr:
            fixed = lambda s: F.concat(F.lit("ES"), _read_digits(F.substring(s["value"], 3, 100)))
            fam("iban_read", "iban", 10, lambda s: ~checks.is_iban(s["value"]) & checks.is_iban(fixed(s)), "alta", True)
    if "cuenta" in want:
        fam("cuenta", "cuenta", 11, lambda s: ~_broken(s) | checks.is_ccc(s["value"]), "media", False)
        if o.ocr:
            fam("cuenta_read", "cuenta", 12, lambda s: ~s["value"].rlike("^[0-9\\s-]+$") & checks.is_ccc(_read_digits(s["value"])), "media", True)
    if "tarjeta" in want:
        fam("tarjeta", "tarjeta", 13, lambda s: checks.is_card(s["value"]), "alta", True)
    if "telefono" in want:
        nat = lambda s: digits(s["value"]).rlike("^(?:34|0034)?[0-9]{9}$")
        fam("phone_es", "telefono", 14, lambda s: nat(s) & _alone(t, s), "alta", True)
        fam("phone_int", "telefono", 15, lambda s: F.length(digits(s["value"])).between(8, 15) & _alone(t, s), "media", False)
    if "email" in want:
        fam("email", "email", 16, True, "alta", True)
        if o.ocr:
            fam("email_read", "email", 17, lambda s: hint("email", s, 60), "media", False)
            line = lambda s: F.substring_index(before(t, s["start"], 25), "\n", -1)
            fam("email_no_at", "email", 18, lambda s: ~F.contains(s["value"], F.lit("@")) & hinted(line(s), F.length(line(s)), HINTS["email"], 25), "media", False)
    if "nss" in want:
        fam("nss", "nss", 19, lambda s: checks.nss_control(s["value"]) | hint("nss", s, 60), lambda s: _sure_or_half(checks.nss_control(s["value"]) & hint("nss", s, 60)), lambda s: checks.nss_control(s["value"]))
    if "matricula" in want:
        fam("plate", "matricula", 20, lambda s: ~_broken(s) | hint("matricula", s, 40), "alta", True)
        fam("plate_old", "matricula", 21, lambda s: hint("matricula", s, 30), "baja", False)
    if "cp" in want:
        city = lambda s: F.substring(t, s["end"] + 1, F.lit(30)).rlike("^[\\s,.\\-]*[A-ZÁÉÍÓÚÑ]\\p{L}{2,}")
        fam("cp", "cp", 23, lambda s: s["value"].cast("int").between(1000, 52999) & (city(s) | hint("cp", s, 20) | hint("via", s, 90)), "media", False)
    if "fecha_nac" in want:
        part = lambda s, k: F.split(s["value"], "[/.-]")[k].cast("int")
        word = lambda s, k: F.split(F.lower(unaccent(s["value"])), "\\s+de\\s+")[k]
        months = F.array(*[F.lit(m) for m in MONTHS])
        born = lambda s: hint("fecha_nac", s, 45)
        ok = (lambda s: F.lit(True)) if o.all_dates else born
        fam("date", "fecha_nac", 24, lambda s: checks.is_date(part(s, 0), part(s, 1), checks.full_year(part(s, 2))) & ok(s), lambda s: _sure_or_half(born(s)), True)
        month = lambda s: F.array_position(months, F.replace(word(s, 1), F.lit("setiembre"), F.lit("septiembre"))).cast("int")
        fam("date_words", "fecha_nac", 25, lambda s: checks.is_date(word(s, 0).cast("int"), month(s), word(s, 2).cast("int")) & ok(s), lambda s: _sure_or_half(born(s)), True)
    if want & set(SEQUENTIAL):
        from .sequential import sequential_matches

        out.append(sequential if sequential is not None else sequential_matches(o)(t))
    out += _terms(t, o, 30)
    return F.concat(*out) if out else F.expr(f"cast(array() as {MATCHES})")


def companies_first(matches: Column) -> Column:
    """Names that overlap a company of high confidence go."""
    sure = F.filter(matches, lambda m: (m["type"] == "empresa") & (m["confidence"] == "alta"))
    return F.filter(matches, lambda m: (m["type"] != "nombre") | ~F.exists(sure, lambda e: overlaps(m, e)))


def left_visible(value: Column, keep: list[str]) -> Column:
    """Whether a value holds one of these phrases as whole words, or is itself, with four characters or more, part of one."""
    from ..functions.text import visible_key

    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    v = visible_key(value)
    tests = []
    for p in keep:
        n = visible_key(F.lit(p))
        tests.append((n != "") & (F.contains(padded(v), padded(n)) | ((F.length(v) >= 4) & F.contains(padded(n), padded(v)))))
    hit = F.lit(False)
    for x in tests:
        hit = hit | x
    return (v != "") & hit


def detect(docs: DataFrame, text_col: str = "text", options: Options | None = None, out: str = "matches", known: str | None = None) -> DataFrame:
    """The documents with a column of matches that overlap nothing, by start.  A null text has none.

    ``known`` is a column of keys of companies that a dictionary has of the text (``sources.dictionary.with_known``).
    """
    o = options or Options()
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = docs
    seq = None
    if set(o.wanted()) & set(SEQUENTIAL):
        from .sequential import sequential_matches

        df = df.withColumn("_sequential", sequential_matches(o)(t, F.col(known) if known else None))
        seq = F.col("_sequential")
    df = df.withColumn("_raw", raw_matches(t, o, seq)).withColumn("_raw", companies_first(F.col("_raw")))
    found = resolve(F.col("_raw"))
    if o.keep_visible:
        found = F.filter(found, lambda m: ~left_visible(m["value"], o.keep_visible))
    return df.withColumn(out, F.when(F.size("_raw") < 2, F.filter("_raw", lambda m: ~left_visible(m["value"], o.keep_visible)) if o.keep_visible else F.col("_raw")).otherwise(found)).drop("_raw", "_sequential")

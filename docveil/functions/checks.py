"""Check digits and calendar checks as column expressions; every check is false, never null, for what it can't read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import alnum, digits

# fixed values: control letters and weights
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
CCC_WEIGHTS = [1, 2, 4, 8, 5, 10, 9, 7, 3, 6]
CIF_LETTERS = "JABCDEFGHI"
CIF_FORMS = "ABCDEFGHJNPQRSUVW"


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def dni_letter(number: Column) -> Column:
    """Control letter of a number given as digits or as a long."""
    return F.substring(F.lit(DNI_LETTERS), (number.cast("long") % 23 + 1).cast("int"), 1)


def is_dni(value: Column) -> Column:
    v = alnum(value)
    return _sure(F.when(v.rlike("^[0-9]{8}[A-Z]$"), dni_letter(F.try_to_number(F.substring(v, 1, 8), F.lit("99999999"))) == F.substring(v, 9, 1)))


def is_nie(value: Column) -> Column:
    v = alnum(value)
    number = F.concat(F.translate(F.substring(v, 1, 1), "XYZ", "012"), F.substring(v, 2, 7))
    return _sure(F.when(v.rlike("^[XYZ][0-9]{7}[A-Z]$"), dni_letter(F.try_to_number(number, F.lit("99999999"))) == F.substring(v, 9, 1)))


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def mod97(c: Column) -> Column:
    """Remainder by 97 of a string of digits and letters (A is 10 … Z is 35), folded so that no length overflows."""

    def step(acc: Column, x: Column) -> Column:
        n = F.when(x.between("0", "9"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55)
        return (acc * F.when(n > 9, 100).otherwise(10) + n) % 97

    return F.aggregate(_chars(c), F.lit(0), step)


def is_iban(value: Column) -> Column:
    v = alnum(value)
    moved = F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4))
    return _sure(F.when(v.rlike("^[A-Z]{2}[0-9]{2}[0-9A-Z]{10,30}$"), mod97(moved) == 1))


def _ccc_digit(ten: Column) -> Column:
    total = sum(F.substring(ten, k + 1, 1).cast("int") * w for k, w in enumerate(CCC_WEIGHTS))
    r = 11 - total % 11
    return F.when(r == 11, 0).when(r == 10, 1).otherwise(r)


def is_ccc(value: Column) -> Column:
    d = digits(value)
    ok = (_ccc_digit(F.concat(F.lit("00"), F.substring(d, 1, 8))) == F.substring(d, 9, 1).cast("int")) & (_ccc_digit(F.substring(d, 11, 10)) == F.substring(d, 10, 1).cast("int"))
    return _sure(F.when(F.length(d) == 20, ok))


def is_card(value: Column) -> Column:
    d = digits(value)
    return _sure(F.when(F.length(d).between(13, 19), F.call_function("luhn_check", d)))


def nss_control(value: Column) -> Column:
    """Whether the last two of twelve digits are the first ten modulo 97."""
    d = digits(value)
    return _sure(F.when(F.length(d) == 12, mod97(F.substring(d, 1, 10)) == F.substring(d, 11, 2).cast("int")))


def cif_control(value: Column) -> Column:
    v = F.regexp_replace(alnum(value), "^ES(?=[A-Z][0-9])", "")
    d = [F.substring(v, k + 2, 1).cast("int") for k in range(7)]
    odd = lambda x: F.floor(x * 2 / 10) + (x * 2) % 10
    digit = (10 - sum(odd(x) if k % 2 == 0 else x for k, x in enumerate(d)) % 10) % 10
    own = F.substring(v, 9, 1)
    ok = (own == digit.cast("string")) | (own == F.substring(F.lit(CIF_LETTERS), digit.cast("int") + 1, 1))
    return _sure(F.when(v.rlike(f"^[{CIF_FORMS}][0-9]{{7}}[0-9A-J]$"), ok))


def is_date(day: Column, month: Column, year: Column) -> Column:
    """A day of the calendar, years 1900 to 2100."""
    return _sure(F.when(year.between(1900, 2100), F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)).isNotNull()))


def full_year(year: Column) -> Column:
    """Two digits above 40 are of the 1900s, others of the 2000s."""
    return F.when(year >= 100, year).when(year > 40, year + 1900).otherwise(year + 2000)


def fingerprint48(key: Column) -> Column:
    """48 bits of a key: the high half of 32-bit FNV-1a, its low half, and the low half of Bernstein's sum times 33."""
    codes = F.transform(_chars(key), lambda c: F.ascii(c).cast("long"))
    mask = F.lit(0xFFFFFFFF)
    fnv = F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda a, c: (a.bitwiseXOR(c) * F.lit(0x01000193)).bitwiseAND(mask))
    sum33 = F.aggregate(codes, F.lit(5381).cast("long"), lambda b, c: (b * 33 + c).bitwiseAND(mask))
    low16 = F.lit(0xFFFF)
    return F.shiftleft(F.shiftrightunsigned(fnv, 16), 32).bitwiseOR(F.shiftleft(fnv.bitwiseAND(low16), 16)).bitwiseOR(sum33.bitwiseAND(low16))

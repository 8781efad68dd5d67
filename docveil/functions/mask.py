"""Masking by type: what may be shown of a value without giving it away."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import digits, squeeze

_COVERED = "[0-9A-Za-zÀ-ÿ]"


def cover(c: Column) -> Column:
    return F.regexp_replace(c, _COVERED, "*")


def _initials(v: Column) -> Column:
    return F.array_join(F.transform(F.split(v, " "), lambda w: F.when(F.length(w) <= 1, w).otherwise(F.concat(F.substring(w, 1, 1), cover(F.substring(w, 2, 1_000_000))))), " ")


def masked(kind: Column, value: Column) -> Column:
    """A value covered in part, by its type."""
    v = squeeze(value)
    a = F.upper(F.regexp_replace(v, "[^0-9A-Za-z]", ""))
    n = F.length(a)
    d = digits(v)
    tail = lambda c, k: F.substring(c, -k, k)
    mail = "(?i)^([^@\\s])[^@\\s]*@([^.\\s])[^\\s]*?(\\.[a-z]{2,})$"
    first_digit = F.regexp_extract(v, "^([^0-9]*[0-9])", 1)
    return (
        F.when(kind == "dni", F.when(n >= 9, F.concat(F.lit("***"), F.substring(a, 4, 4), F.repeat(F.lit("*"), n - 7))).otherwise(cover(v)))
        .when(kind == "nie", F.when(n >= 9, F.concat(F.lit("****"), F.substring(a, 5, 4), F.repeat(F.lit("*"), n - 8))).otherwise(cover(v)))
        .when(kind == "iban", F.when(n >= 8, F.concat(F.substring(a, 1, 4), F.lit(" **** **** **** **** "), tail(a, 4))).otherwise(cover(v)))
        .when(kind.isin("cuenta", "tarjeta"), F.when(n >= 8, F.concat(F.lit("**** **** **** "), tail(a, 4))).otherwise(cover(v)))
        .when(kind == "telefono", F.when(F.length(d) >= 6, F.concat(F.lit("*** *** "), tail(d, 3))).otherwise(cover(v)))
        .when(kind == "email", F.when(v.rlike(mail), F.concat(F.regexp_extract(v, mail, 1), F.lit("***@"), F.regexp_extract(v, mail, 2), F.lit("***"), F.regexp_extract(v, mail, 3))).otherwise(cover(v)))
        .when(kind.isin("nombre", "empresa", "direccion", "personalizado"), _initials(v))
        .when(kind == "fecha_nac", F.when(v.rlike("[0-9]{4}$"), F.concat(F.regexp_replace(F.substring(v, F.lit(1), F.length(v) - 4), "[0-9]", "*"), tail(v, 4))).otherwise(cover(v)))
        .when(kind == "cp", F.when(F.length(v) >= 2, F.concat(F.substring(v, 1, 2), cover(F.substring(v, 3, 100)))).otherwise(cover(v)))
        .when(kind == "importe", F.concat(first_digit, F.regexp_replace(F.substring(v, F.length(first_digit) + 1, F.length(v)), "[0-9]", "*")))
        .otherwise(F.when(F.length(v) > 3, F.concat(F.substring(v, 1, 2), cover(F.substring(v, F.lit(3), F.length(v) - 3)), tail(v, 1))).otherwise(cover(v)))
    )


# fixed values: names of types, singular and plural
LABELS = {"dni": ("DNI", "DNI"), "nie": ("NIE", "NIE"), "iban": ("IBAN", "IBAN"), "cuenta": ("cuenta bancaria", "cuentas bancarias"), "tarjeta": ("tarjeta", "tarjetas"), "telefono": ("teléfono", "teléfonos"), "email": ("correo electrónico", "correos electrónicos"), "nss": ("número de la Seguridad Social", "números de la Seguridad Social"), "matricula": ("matrícula", "matrículas"), "direccion": ("dirección", "direcciones"), "cp": ("código postal", "códigos postales"), "fecha_nac": ("fecha de nacimiento", "fechas de nacimiento"), "nombre": ("nombre", "nombres"), "empresa": ("empresa", "empresas"), "cif": ("NIF de empresa", "NIF de empresa"), "importe": ("cantidad de dinero", "cantidades de dinero"), "personalizado": ("palabra que pediste", "palabras que pediste")}


def counted(counts: Column) -> Column:
    """``{type: n}`` as "7 nombres, 2 DNI", most first (ties by type)."""
    one = F.create_map(*[F.lit(x) for k, (s, _) in LABELS.items() for x in (k, s)])
    many = F.create_map(*[F.lit(x) for k, (_, p) in LABELS.items() for x in (k, p)])
    rows = F.array_sort(F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("m"), e["key"].alias("k"))))
    return F.array_join(F.transform(rows, lambda r: F.concat((-r["m"]).cast("string"), F.lit(" "), F.coalesce(F.when(r["m"] == -1, F.try_element_at(one, r["k"])).otherwise(F.try_element_at(many, r["k"])), r["k"]))), ", ")

"""The tools as functions over DataFrames: analyse, redact, pseudonymise, restore, compare, list, and image metadata.

Documents are rows with doc_id and text.  Values are shown masked unless they are asked for in full.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.mask import counted, masked
from .operators import compare as _compare
from .operators import entities as _entities
from .operators import images as _images
from .operators.detect import Options, detect
from .operators.spans import WEIGHT, exploded
from .sources import catalog as _catalog

# fixed values: labels that stand for a redacted value
PLATES = {"dni": "DNI", "nie": "NIE", "iban": "IBAN", "cuenta": "CUENTA", "tarjeta": "TARJETA", "telefono": "TELÉFONO", "email": "CORREO", "nss": "N.º SS", "matricula": "MATRÍCULA", "direccion": "DIRECCIÓN", "cp": "CP", "fecha_nac": "FECHA", "nombre": "NOMBRE", "empresa": "EMPRESA", "cif": "NIF", "importe": "IMPORTE", "personalizado": "OCULTO"}


def matches(docs: DataFrame, options: Options | None = None) -> DataFrame:
    """A row for each match; the text is left out."""
    return exploded(detect(docs, options=options).drop("text"))


def analyze(docs: DataFrame, options: Options | None = None, show: bool = False) -> DataFrame:
    """(doc_id, total, doubtful, by_type, said) and, if asked for, masked values, for every document."""
    found = detect(docs, options=options)
    m = found.select("doc_id", F.explode_outer("matches").alias("m"))
    n = m.groupBy("doc_id", "m.type").agg(F.count("m.type").cast("int").alias("n"), F.count_if(F.col("m.confidence") != "alta").alias("d"))
    by = F.map_from_entries(F.filter(F.collect_list(F.struct("type", "n")), lambda e: e["type"].isNotNull()))
    out = n.groupBy("doc_id").agg(F.sum("n").alias("total"), F.sum("d").alias("doubtful"), by.alias("by_type")).withColumn("said", counted(F.col("by_type")))
    if show:
        values = found.select("doc_id", F.transform("matches", lambda x: masked(x["type"], x["value"])).alias("shown"))
        out = out.join(values, "doc_id")
    return out


def counts_of(found: DataFrame) -> DataFrame:
    """(doc_id, total, doubtful) of documents with matches (doc_id, type, confidence)."""
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("confidence") != "alta").alias("doubtful"))


def confidence_of(found: DataFrame) -> DataFrame:
    """(type, alta, media, baja): how many matches of each type have each confidence; types without a match have no row."""
    n = lambda c: F.count_if(F.col("confidence") == c).alias(c)
    return found.groupBy("type").agg(*[n(c) for c in WEIGHT])


def totals(docs: DataFrame, options: Options | None = None) -> DataFrame:
    """(type, n, docs) over all documents, with a row of grand totals (type null)."""
    return totals_of(matches(docs, options))


def totals_of(found: DataFrame) -> DataFrame:
    return found.rollup("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


def _cover(m: Column, style: str) -> Column:
    if style == "bar":
        return F.repeat(F.lit("█"), F.length(m["value"]))
    if style == "label":
        names = F.create_map(*[F.lit(x) for kv in PLATES.items() for x in kv])
        return F.concat(F.lit("["), F.coalesce(F.try_element_at(names, m["type"]), F.lit("OCULTO")), F.lit("]"))
    if style == "mask":
        return masked(m["type"], m["value"])
    raise ValueError(f"unknown style {style!r}")


def redact(docs: DataFrame, style: str = "bar", options: Options | None = None) -> DataFrame:
    """Documents with ``redacted`` and ``left``: values that still stand in the result (there should be none)."""
    found = detect(docs, options=options)
    spans = F.transform("matches", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), _cover(m, style).alias("text")))
    text = F.coalesce("text", F.lit(""))
    out = found.withColumn("redacted", F.when(F.col("text").isNotNull(), _entities.splice(text, spans)))
    left = F.filter(F.array_distinct(F.transform("matches", lambda m: m["value"])), lambda v: (F.length(v) >= 4) & F.contains("redacted", v))
    return out.withColumn("left", F.size(left)).drop("matches")


def pseudonymize(docs: DataFrame, scope: str = "scope_id", options: Options | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with ``pseudonymized``, mapping tables as JSON) with one table for each scope.  Amounts stay unless asked for."""
    o = options or Options(types=_entities.DEFAULT_TYPES)
    m = exploded(detect(docs.select(scope, "doc_id", "text"), options=o).drop("text"))
    out, ents = _entities.pseudonymize(docs, m, scope)
    return out, _entities.mapping_json(ents, scope)


def restore(docs: DataFrame, mappings: DataFrame, scope: str = "scope_id", text_col: str = "text") -> DataFrame:
    """Documents with ``restored_text``, ``restored`` and ``unknown``."""
    r = _entities.restore(F.col(text_col), _entities.read_mapping(F.col("mapping")))
    return docs.join(mappings, scope).withColumn("_r", r).select(*docs.columns, F.col("_r.text").alias("restored_text"), "_r.restored", "_r.unknown")


def _paragraphs(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _compare.paragraphs(t or ""))


def compare(pairs: DataFrame, a: str = "a", b: str = "b", scanned: str | None = None) -> DataFrame:
    """Pairs of texts with rows and changes; ``operators.compare.summary`` counts them.  Facts in them are to be masked before they are shown."""
    from .functions.udf import arrow_function

    split = arrow_function("array<string>")(_paragraphs)
    df = pairs.withColumn("_a", split(F.col(a))).withColumn("_b", split(F.col(b)))
    return _compare.compare(df, "_a", "_b", scanned).drop("_a", "_b")


def list_documents(files: DataFrame, **filters) -> DataFrame:
    return _catalog.listing(files, **filters)


def image_metadata(images: DataFrame, content: str = "content") -> DataFrame:
    return images.withColumn("metadata", _images.metadata(F.col(content)))


def strip_images(images: DataFrame, content: str = "content") -> DataFrame:
    return _images.stripped(images, content)

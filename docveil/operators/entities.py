"""Pseudonymisation: entities over a scope of documents, consistent labels, a mapping table, and the way back.

A *scope* is what shares one table of labels.  Only the distinct keys of a scope, not its matches, meet in one place: labels are numbered by
first appearance with a window, and just people and companies, where a shorter form joins the only entity that it fits, are
gone through one by one.
"""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PARTICLES, entity_key
from ..sources.shared import stored
from .sequential import company_key, norm
from .tokens import places_of

# fixed values: label of each type
BASES = {"nombre": "PERSONA", "dni": "DNI", "nie": "NIE", "iban": "IBAN", "cuenta": "CUENTA", "tarjeta": "TARJETA", "telefono": "TELEFONO", "email": "EMAIL", "direccion": "DIRECCION", "cp": "CP", "nss": "NSS", "matricula": "MATRICULA", "fecha_nac": "FECHA_NAC", "empresa": "EMPRESA", "cif": "NIF_EMPRESA", "importe": "IMPORTE", "personalizado": "OTRO"}
#: Types of the default: amounts stay.
DEFAULT_TYPES = ["dni", "nombre", "fecha_nac", "empresa", "telefono", "email", "direccion", "iban", "tarjeta", "nss", "matricula"]
LABEL = "(?i)(?:\\[\\s*(?:" + "|".join(sorted(set(BASES.values()), key=len, reverse=True)) + ")[ _\\-]?[0-9]{1,4}(?![0-9])\\s*\\]|\\b(?:" + "|".join(sorted(set(BASES.values()), key=len, reverse=True)) + ")[ _\\-]?[0-9]{1,4}(?![0-9]))"


def base_of(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in BASES.items() for x in kv]), kind), F.lit("OTRO"))


def trimmed(matches: DataFrame) -> DataFrame:
    """Matches without white space at their ends; those of white space alone go."""
    lead = F.length("value") - F.length(F.regexp_replace("value", "^\\s+", ""))
    v = F.regexp_replace(F.regexp_replace("value", "^\\s+", ""), "\\s+$", "")
    return matches.withColumn("_lead", lead).withColumn("value", v).where("value <> ''").withColumn("start", F.col("start") + F.col("_lead")).withColumn("end", F.col("start") + F.length("value")).drop("_lead")


def only_container(short: DataFrame, long: DataFrame, scope: str = "scope_id") -> DataFrame:
    """(scope, short, long): the only longer form of a scope that holds all words of a shorter one; none if several do.

    Both are (scope, id, tokens).  Equal sets of words are taken together first, so that repeats meet once, and a set is looked for at its
    word that the fewest sets of the other side have.  Sets without a word have no row; a null scope is none.
    """
    plain = F.filter(F.array_sort(F.array_distinct("tokens")), lambda t: t.isNotNull())
    sets = lambda df: df.where(F.col(scope).isNotNull()).select(scope, "id", plain.alias("tokens")).where("size(tokens) > 0")
    own = sets(short).withColumnRenamed("id", "short").distinct()
    few = own.select(scope, "tokens").distinct()
    many = sets(long).groupBy(scope, "tokens").agg(F.count_distinct("id").alias("_n"), F.min("id").alias("_id")).withColumnRenamed("tokens", "_held")
    index = many.select(scope, F.explode("_held").alias("_word"), "_held", "_n", "_id")
    common = index.groupBy(scope, "_word").agg(F.count(F.lit(1)).alias("_rate"))
    words = few.select(scope, "tokens", F.explode("tokens").alias("_word")).join(common, [scope, "_word"], "left")
    rarest = words.groupBy(scope, "tokens").agg(F.min(F.struct(F.coalesce("_rate", F.lit(0)).alias("rate"), F.col("_word").alias("word"))).alias("_r"))
    at = rarest.where("_r.rate > 0").select(scope, "tokens", F.col("_r.word").alias("_word"))
    held = at.join(index, [scope, "_word"]).where(F.size(F.array_except("tokens", "_held")) == 0)
    one = held.groupBy(scope, "tokens").agg(F.sum("_n").alias("_n"), F.min("_id").alias("long")).where("_n = 1")
    return own.join(one, [scope, "tokens"]).select(scope, "short", "long")


def tokens_of(kind: str, value: str) -> list[str]:
    if kind == "empresa":
        return company_key(value).split()
    return [t for t in re.sub(r"[^A-Z\s]+", " ", norm(value)).split() if t not in PARTICLES]


def merged(keys: pd.DataFrame) -> pd.DataFrame:
    """Group the keys of people or companies, in order of appearance: a form that contains or is contained in exactly one group's
    tokens joins it, and the longer form becomes its value."""
    keys = keys.sort_values("first", kind="stable", ignore_index=True)
    groups: list[dict] = []
    own = []
    for r in keys.itertuples():
        t = set(tokens_of(r.type, r.value))
        hits = [g for g in groups if t and (t <= g["tokens"] or g["tokens"] <= t)]
        if len(hits) == 1:
            g = hits[0]
            if len(t) > len(g["tokens"]):
                g["tokens"], g["value"] = t, r.value
        else:
            g = {"num": len(groups) + 1, "tokens": t, "value": r.value, "confidence": r.confidence}
            groups.append(g)
        own.append(g)
    return keys.assign(num=[g["num"] for g in own], value=[g["value"] for g in own], confidence=[g["confidence"] for g in own])


def entities(matches: DataFrame, scope: str = "scope_id", order: list[str] | None = None) -> DataFrame:
    """(scope, base, key, num, label, type, value, confidence) for each distinct key; ``order`` tells which matches come first."""
    order = order or ["doc_id", "start"]
    m = trimmed(matches).withColumn("base", base_of(F.col("type"))).withColumn("key", entity_key(F.col("type"), F.col("value")))
    at = F.struct(*order)
    keys = m.groupBy(scope, "base", "key").agg(F.min(at).alias("first"), *[F.min_by(c, at).alias(c) for c in ("type", "value", "confidence")])
    plain = keys.where(~F.col("base").isin("PERSONA", "EMPRESA")).withColumn("num", F.row_number().over(Window.partitionBy(scope, "base").orderBy("first")))
    ranked = keys.where(F.col("base").isin("PERSONA", "EMPRESA")).withColumn("first", F.row_number().over(Window.partitionBy(scope, "base").orderBy("first")))
    kind = dict(keys.dtypes)[scope]
    forms = ranked.groupBy(scope, "base").applyInPandas(lambda d: merged(d)[[scope, "base", "key", "num", "type", "value", "confidence"]], f"{scope} {kind}, base string, key string, num int, type string, value string, confidence string")
    both = plain.select(*forms.columns).unionByName(forms)
    return both.withColumn("label", F.concat(F.lit("["), F.col("base"), F.lit("_"), F.col("num").cast("string"), F.lit("]")))


def occurrences(matches: DataFrame, ents: DataFrame, scope: str = "scope_id") -> DataFrame:
    """(scope, doc_id, start, end, value, base, label, repeated)"""
    m = trimmed(matches).withColumn("base", base_of(F.col("type"))).withColumn("key", entity_key(F.col("type"), F.col("value")))
    return m.join(ents.select(scope, "base", "key", "label"), [scope, "base", "key"]).select(scope, "doc_id", "start", "end", "value", "base", "label", F.lit(False).alias("repeated"))


def worth_repeating(value: Column) -> Column:
    """Numbers of five digits or more, other values of four characters or more."""
    return F.when(value.rlike("^[0-9][0-9\\s./-]*$"), F.length(F.regexp_replace(value, "[^0-9]", "")) >= 5).otherwise(F.length(value) >= 4)


def unclaimed(found: list[dict], taken: list[dict]) -> list[dict]:
    """Of the places found, those that overlap nothing taken nor each other: longest values first, then by value and place."""
    busy: list[tuple[int, int]] = []  # disjoint, in order: what is taken, overlaps put together
    for start, end in sorted((t["start"], t["end"]) for t in taken):
        if busy and start < busy[-1][1]:
            busy[-1] = (busy[-1][0], max(end, busy[-1][1]))
        else:
            busy.append((start, end))
    out = []
    for f in sorted(found, key=lambda f: (-len(f["form"]), f["form"], f["start"])):
        at = bisect.bisect_left(busy, (f["end"],))  # only the last span that starts before its end can reach into it
        if at == 0 or busy[at - 1][1] <= f["start"]:
            busy.insert(at, (f["start"], f["end"]))
            out.append(f)
    return out


def completed(docs: DataFrame, occ: DataFrame, scope: str = "scope_id", text_col: str = "text") -> DataFrame:
    """The occurrences and the repeats that the detectors did not see: known values as whole words, those of several words in any case."""
    forms = occ.where(worth_repeating(F.col("value"))).groupBy(scope, F.col("value").alias("form")).agg(F.min_by("label", F.struct("doc_id", "start")).alias("label"))
    places = places_of(docs, forms, scope, text_col, F.col("form").rlike("\\s"))
    found = places.groupBy(scope, "doc_id").agg(F.collect_list(F.struct("start", "end", "value", "form", "label")).alias("found"))
    taken = occ.groupBy(scope, "doc_id").agg(F.collect_list(F.struct("start", "end")).alias("taken"))

    @F.pandas_udf("array<struct<start:int,end:int,value:string,form:string,label:string>>")
    def free(found: pd.Series, taken: pd.Series) -> pd.Series:
        return pd.Series([unclaimed(list(f), [] if t is None else list(t)) for f, t in zip(found, taken, strict=True)])

    new = found.join(taken, [scope, "doc_id"], "left").select(scope, "doc_id", F.explode(free("found", "taken")).alias("r"))
    base = F.regexp_extract("r.label", "^\\[(.*)_[0-9]+\\]$", 1)
    more = new.select(scope, "doc_id", "r.start", "r.end", "r.value", base.alias("base"), "r.label", F.lit(True).alias("repeated"))
    return occ.unionByName(more)


def splice(text: Column, spans: Column) -> Column:
    """The text with each span ``(start, end, text)`` replaced; spans that start inside an earlier one are passed over."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))))
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        ok = s["start"] >= acc["at"]
        added = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["text"])
        return F.struct(F.when(ok, added).otherwise(acc["out"]).alias("out"), F.when(ok, s["end"]).otherwise(acc["at"]).alias("at"))

    return F.aggregate(ordered, state, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def pseudonymize(docs: DataFrame, matches: DataFrame, scope: str = "scope_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents with a column ``pseudonymized``, entities).  ``matches`` has scope, doc_id, type, value, start, end, confidence.

    Matches, entities and occurrences are each needed several times, so they are stored: the detectors run once.
    """
    matches = stored(matches, "matches")
    ents = stored(entities(matches, scope), "entities")
    occ = completed(docs, stored(occurrences(matches, ents, scope), "occurrences"), scope, text_col)
    spans = occ.groupBy(scope, "doc_id").agg(F.collect_list(F.struct("start", "end", F.col("label").alias("text"))).alias("_spans"))
    out = docs.join(spans, [scope, "doc_id"], "left")
    new = F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(splice(F.col(text_col), F.col("_spans")))
    return out.withColumn("pseudonymized", new).drop("_spans"), ents


def mapping_json(ents: DataFrame, scope: str = "scope_id") -> DataFrame:
    """(scope, mapping): the table of labels as JSON, by base and number."""
    rows = ents.groupBy(scope, "base", "num", "label", "type", "value").agg(F.count(F.lit(1)))
    listed = F.sort_array(F.collect_list(F.struct("base", "num", "label", "type", "value")))
    body = F.struct(F.lit("docveil").alias("tool"), F.lit("mapping-table").alias("format"), F.lit(1).alias("version"), F.transform(listed, lambda r: F.struct(r["label"].alias("etiqueta"), r["type"].alias("tipo"), r["value"].alias("valor"))).alias("sustituciones"))
    return rows.groupBy(scope).agg(F.to_json(body).alias("mapping"))


def read_mapping(mapping: Column) -> Column:
    """map<label without brackets, upper case; value> of a JSON table, null if it is none."""
    rows = F.from_json(mapping, "sustituciones array<struct<etiqueta:string,tipo:string,valor:string>>")["sustituciones"]
    good = F.filter(rows, lambda r: r["etiqueta"].isNotNull() & r["valor"].isNotNull())
    # of repeated labels the last counts
    pairs = F.transform(good, lambda r: F.struct(F.upper(F.regexp_replace(r["etiqueta"], "[\\[\\]]", "")).alias("key"), r["valor"].alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.when(F.size(pairs) > 0, F.map_from_entries(last))


def label_key(piece: Column) -> Column:
    """PERSONA_1 for "[persona 1]", "Persona-1" and the like."""
    p = "(?i)([A-Z_]*[A-Z])[ _\\-]?([0-9]{1,4})\\s*\\]?$"
    return F.concat(F.upper(F.regexp_extract(piece, p, 1)), F.lit("_"), F.regexp_extract(piece, p, 2))


def labels_in(text: Column) -> Column:
    """array<struct<value,start,end>> of labels, bracketed or bare, in any case."""
    from .spans import pattern_spans

    return pattern_spans(text, LABEL.replace("(?i)(?:", "(?i)()(", 1))


def restore(text: Column, table: Column) -> Column:
    """struct<text, restored, unknown>: known labels replaced; labels that look placed but aren't in the table, each once."""
    found = F.transform(labels_in(text), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), label_key(s["value"]).alias("key")))
    known = F.filter(found, lambda s: F.map_contains_key(table, s["key"]))
    placed = F.filter(found, lambda s: ~F.map_contains_key(table, s["key"]) & s["value"].rlike("[\\[\\]_-]"))
    spans = F.transform(known, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(table, s["key"]).alias("text")))
    return F.struct(splice(text, spans).alias("text"), F.size(known).alias("restored"), F.array_distinct(F.transform(placed, lambda s: s["key"])).alias("unknown"))


def leaks(docs: DataFrame, occ: DataFrame, scope: str = "scope_id", text_col: str = "pseudonymized") -> DataFrame:
    """(scope, doc_id, label): values of four characters or more that still stand as whole words in a result."""
    values = occ.where(F.length("value") >= 4).select(scope, F.col("value").alias("form"), "label").distinct()
    return places_of(docs, values, scope, text_col).select(scope, "doc_id", "label").distinct()

"""Pages: text from placed items, scanned pages, repeated margins, matches over a page break, paragraphs by layout, and form fields.

A page is a row ``(doc_id, page_no, text, …)``; items are rows ``(doc_id, page_no, item_no, str, x, y, w, h, eol)``.
"""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import starts_clause
from ..functions.text import margin_key, unaccent
from ..sources.shared import stored

#: A page with fewer visible characters is read as a scan if it draws an image.
VISIBLE = 20
#: Characters on either side of a page break that are looked at.
SEAM = 160
# fixed values: what is a page number by itself
PAGE_NUMBER = "(?i)^[-–—\\s]*(?:p[aá]g(?:ina)?\\.?\\s*)?[0-9]{1,4}(?:\\s*(?:de|/)\\s*[0-9]{1,4})?[-–—\\s]*$"


def has_text(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s", "")) >= VISIBLE


def assembled(items: DataFrame, key: tuple[str, ...] = ("doc_id", "page_no")) -> DataFrame:
    """(key, text, spans): the page's text, and where each item with letters stands in it.

    A new line where the baseline moves by over half a letter's height or the text runs back, a tab for a wide gap, a space for a
    small one.
    """
    w = Window.partitionBy(*key).orderBy("item_no")
    df = items.withColumn("solid", F.col("str").rlike("\\S"))
    # a line ends a run: nothing before it counts as the previous item
    df = df.withColumn("_run", F.coalesce(F.sum(F.col("eol").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r = Window.partitionBy(*key, "_run").orderBy("item_no")
    before = r.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(F.when(F.col("solid"), F.col(c)), ignorenulls=True).over(before)
    df = df.select("*", *[last(c).alias(f"p_{c}") for c in ("str", "x", "y", "w", "h", "item_no")])
    blank = F.coalesce(F.max(F.when(~F.col("solid") & (F.col("str") != ""), F.col("item_no"))).over(before) > F.col("p_item_no"), F.lit(False))
    high = F.greatest(F.abs("p_h"), F.abs("h"), F.lit(1.0))
    gap = F.col("x") - (F.col("p_x") + F.coalesce("p_w", F.lit(0.0)))
    by_place = F.when(F.abs(F.col("p_y") - F.col("y")) > high * 0.5, "\n").when(gap > high * 2.5, "\t").when(gap > high * 0.15, " ").when(gap < -high, "\n").otherwise("")
    ends, begins = F.col("p_str").rlike("\\s$"), F.col("str").rlike("^\\s")
    sep = F.when((by_place == " ") & (ends | begins), "").otherwise(by_place)
    sep = F.when((sep == "") & blank & ~ends, " ").otherwise(sep)
    df = df.withColumn("sep", F.when(F.col("solid") & F.col("p_str").isNotNull(), sep).otherwise(""))
    piece = F.concat(F.col("sep"), F.when(F.col("solid"), F.col("str")).otherwise(""), F.when(F.col("eol"), "\n").otherwise(""))
    df = df.withColumn("piece", piece).withColumn("start", F.coalesce(F.sum(F.length("piece")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("sep"))
    rows = F.sort_array(F.collect_list(F.struct("item_no", "piece", "solid", F.col("start").cast("int").alias("start"), (F.col("start") + F.length("str")).cast("int").alias("end"))))
    out = df.groupBy(*key).agg(rows.alias("rows"))
    spans = F.transform(F.filter("rows", lambda x: x["solid"]), lambda x: F.struct(x["item_no"].alias("item_no"), x["start"].alias("start"), x["end"].alias("end")))
    return out.select(*key, F.array_join(F.transform("rows", lambda x: x["piece"]), "").alias("text"), spans.alias("spans"))


def lines(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, page_no, line_no, start, line, from_end): the lines with text; line numbers from 1, also counted from the end."""
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,line:string>>)").alias("out"))
    step = lambda acc, s: F.struct((acc["at"] + F.length(s) + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), s.alias("line")))).alias("out"))
    placed = F.filter(F.aggregate(split, state, step, lambda acc: acc["out"]), lambda x: F.trim(x["line"]) != "")
    df = pages.select("doc_id", "page_no", placed.alias("_l"))
    return df.select("doc_id", "page_no", F.size("_l").alias("_n"), F.posexplode("_l").alias("line_no", "_x")).select("doc_id", "page_no", (F.col("line_no") + 1).alias("line_no"), F.col("_x.start").alias("start"), F.col("_x.line").alias("line"), (F.col("_n") - F.col("line_no")).alias("from_end"))


def margins(pages: DataFrame, text_col: str = "text", deep: int = 3, least: int = 2) -> DataFrame:
    """(doc_id, key, pages): line keys that stand among the first or last lines of several pages, digits as #."""
    edge = lines(pages, text_col).where((F.col("line_no") <= deep) | (F.col("from_end") <= deep))
    return edge.groupBy("doc_id", margin_key(F.col("line")).alias("key")).agg(F.count_distinct("page_no").alias("pages")).where(F.col("pages") >= least)


def seams(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, page_no, next_no, tail, head, tail_start, head_start): for each page break the text on either side, headers, footers and page
    numbers left out."""
    ls = lines(pages, text_col).withColumn("key", margin_key(F.col("line")))
    ls = ls.join(margins(pages, text_col).select("doc_id", "key", F.lit(True).alias("m")), ["doc_id", "key"], "left")
    body = ls.where(F.col("m").isNull() & ~F.col("line").rlike(PAGE_NUMBER))
    last = body.where("from_end <= 4").groupBy("doc_id", "page_no").agg(F.max_by(F.struct("start", F.length("line").alias("n")), "line_no").alias("l"))
    first = body.where("line_no <= 4").groupBy("doc_id", "page_no").agg(F.min_by("start", "line_no").alias("head_start"))
    # the next page is the one after in order, numbered or not
    w = Window.partitionBy("doc_id").orderBy("page_no")
    t = pages.select("doc_id", "page_no", F.col(text_col).alias("t")).withColumn("next_no", F.lead("page_no").over(w)).withColumn("next", F.lead("t").over(w)).where("t <> '' and next <> ''")
    df = t.join(last, ["doc_id", "page_no"]).join(first.withColumnRenamed("page_no", "next_no"), ["doc_id", "next_no"])
    end = F.col("l.start") + F.col("l.n")
    begin = F.greatest(end - SEAM, F.lit(0))
    return df.select("doc_id", "page_no", "next_no", F.substring("t", begin + 1, end - begin).alias("tail"), F.substring("next", F.col("head_start") + 1, F.lit(SEAM)).alias("head"), begin.alias("tail_start"), "head_start")


def over_breaks(pages: DataFrame, options=None, text_col: str = "text") -> DataFrame:
    """Matches that begin on one page and end on the next: (doc_id, page_no, next_no, type, value, confidence, a_start, a_end, b_start, b_end)."""
    from .detect import detect

    s = seams(pages, text_col).withColumn("_t", F.concat("tail", F.lit("\n"), "head"))
    found = detect(s, "_t", options)
    cut = F.length("tail")
    crossing = F.filter("matches", lambda m: (m["start"] < cut) & (m["end"] > cut + 1))
    # outer, as in ``exploded``
    df = found.select("*", F.explode_outer(crossing).alias("m")).where("m is not null")
    return df.select("doc_id", "page_no", "next_no", F.col("m.type").alias("type"), F.regexp_replace("m.value", "\\s*\\n\\s*", " ").alias("value"), F.col("m.confidence").alias("confidence"), (F.col("tail_start") + F.col("m.start")).alias("a_start"), (F.col("tail_start") + cut).alias("a_end"), F.col("head_start").alias("b_start"), (F.col("head_start") + F.col("m.end") - cut - 1).alias("b_end"))


def page_matches(pages: DataFrame, options=None, text_col: str = "text") -> DataFrame:
    """(doc_id, page_no, type, value, start, end, confidence, next_no, next_start, next_end, visible): all matches of paged documents.

    A match over a page break takes the place of what either page alone has there; its rest is in the ``next_`` columns, null for others.  Pages
    whose column ``ocr``, if there is one, is true are searched as read from scans.  ``visible`` marks what the options keep visible, which is not to be
    redacted.  (doc_id, page_no) tells pages apart; null and empty texts have no matches.
    """
    from .detect import Options, detect, left_visible

    o = options or Options()
    every = replace(o, keep_visible=[])
    keys = pages.select("doc_id", "page_no", F.col(text_col).alias("text"), F.coalesce("ocr", F.lit(False)).alias("_ocr") if "ocr" in pages.columns else F.lit(False).alias("_ocr"))
    if "ocr" in pages.columns:
        own = detect(keys.where("not _ocr"), options=every).unionByName(detect(keys.where("_ocr"), options=replace(every, ocr=True)))
    else:
        own = detect(keys, options=every)
    # needed three times: stored, so that the text around breaks is searched once
    over = stored(over_breaks(keys, every), "over_breaks")
    first = over.select("doc_id", "page_no", F.col("a_start").alias("s"), F.col("a_end").alias("e"))
    second = over.select("doc_id", F.col("next_no").alias("page_no"), F.col("b_start").alias("s"), F.col("b_end").alias("e"))
    taken = first.unionByName(second).groupBy("doc_id", "page_no").agg(F.collect_list(F.struct("s", "e")).alias("_taken"))
    left = own.select("doc_id", "page_no", "matches").join(taken, ["doc_id", "page_no"], "left")
    free = F.filter("matches", lambda m: F.col("_taken").isNull() | ~F.exists("_taken", lambda t: (m["start"] < t["e"]) & (m["end"] > t["s"])))
    none = [F.lit(None).cast("int").alias(c) for c in ("next_start", "next_end")]
    alone = left.select("doc_id", "page_no", F.explode_outer(free).alias("m")).where("m is not null").select("doc_id", "page_no", "m.type", "m.value", "m.start", "m.end", "m.confidence", F.lit(None).cast(pages.schema["page_no"].dataType).alias("next_no"), *none)
    broken = over.select("doc_id", "page_no", "type", "value", F.col("a_start").alias("start"), F.col("a_end").alias("end"), "confidence", "next_no", F.col("b_start").alias("next_start"), F.col("b_end").alias("next_end"))
    return alone.unionByName(broken).withColumn("visible", left_visible(F.col("value"), o.keep_visible) if o.keep_visible else F.lit(False))


def page_lines(items: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, text, x, end, y, h, width): placed items clustered to lines, top first (y grows upwards).

    A line's first item sets its height and place; one Arrow call a page, as each item is held against the line before it.
    """

    def build(page: pd.DataFrame) -> pd.DataFrame:
        page = page[page["str"].str.contains(r"\S", na=False)].sort_values(["y", "x"], ascending=[False, True], kind="stable")
        out: list[dict] = []
        for r in page.itertuples():
            h = r.h or 10.0
            if out and abs(out[-1]["y"] - r.y) <= max(2.0, 0.5 * min(out[-1]["h0"], h)):
                out[-1]["items"].append(r)
            else:
                out.append({"y": r.y, "h0": h, "items": [r]})
        rows = []
        for line in out:
            text, end = "", None
            for r in sorted(line["items"], key=lambda r: r.x):
                if end is not None and r.x - end > 0.12 * line["h0"] and not text[-1:].isspace() and not r.str[:1].isspace():
                    text += " "
                text += r.str
                end = r.x + (r.w or 0.0)
            rows.append({"text": " ".join(text.split()), "x": min(r.x for r in line["items"]), "end": end, "y": line["y"], "h": max(r.h or 10.0 for r in line["items"])})
        width = max((r["end"] for r in rows), default=0.0)
        rows = [r for r in rows if r["text"]]
        return pd.DataFrame([{"doc_id": page["doc_id"].iloc[0], "page_no": page["page_no"].iloc[0], "line_no": k + 1, **r, "width": width} for k, r in enumerate(rows)], columns=["doc_id", "page_no", "line_no", "text", "x", "end", "y", "h", "width"])

    return items.groupBy("doc_id", "page_no").applyInPandas(build, "doc_id long, page_no int, line_no int, text string, x double, end double, y double, h double, width double")


def gap_limit(gaps: Column) -> Column:
    """From which distance between lines a new paragraph begins: the middle of the first clear jump (18 % and 2 points) among the sorted
    distances; twice the smallest if there is none; null without distances."""
    s = F.array_sort(F.filter(gaps, lambda g: g > 0.5))
    jump = F.filter(F.transform(s, lambda g, i: F.struct(g.alias("g"), F.get(s, i - 1).alias("p"))), lambda x: (x["g"] >= x["p"] * 1.18) & (x["g"] - x["p"] >= 2))
    return F.when(F.size(s) == 0, F.lit(None).cast("double")).otherwise(F.coalesce((F.get(jump, F.lit(0))["g"] + F.get(jump, F.lit(0))["p"]) / 2, F.get(s, F.lit(0)) * 2))


def layout_paragraphs(page_line_rows: DataFrame, ocr: bool = False) -> DataFrame:
    """(doc_id, ord, text): paragraphs of documents from their lines, without margins.  A sentence may run on over a page break."""
    n = Window.partitionBy("doc_id", "page_no")
    df = page_line_rows.withColumn("_edge", (F.col("line_no") <= 3) | (F.max("line_no").over(n) - F.col("line_no") < 3)).withColumn("_key", margin_key(F.col("text")))
    repeated = df.where("_edge").groupBy("doc_id", "_key").agg(F.count_distinct("page_no").alias("_in"))
    total = df.groupBy("doc_id").agg(F.count_distinct("page_no").alias("_pages"))
    df = df.join(repeated, ["doc_id", "_key"], "left").join(total, "doc_id")
    margin = F.col("_edge") & (F.col("text").rlike(PAGE_NUMBER) | ((F.col("_pages") >= 2) & (F.col("_in") > F.col("_pages") / 2)))
    df = df.where(~margin)
    p, d = Window.partitionBy("doc_id", "page_no").orderBy("line_no"), Window.partitionBy("doc_id").orderBy("page_no", "line_no")
    df = df.withColumn("_gap", F.lag("y").over(p) - F.col("y"))
    limits = df.groupBy("doc_id", "page_no").agg(gap_limit(F.collect_list("_gap")).alias("_limit"))
    df = df.join(limits, ["doc_id", "page_no"])
    prev = lambda c: F.lag(c).over(d)
    df = df.select("*", prev("text").alias("_pt"), prev("h").alias("_ph"), prev("end").alias("_pe"))
    clause = starts_clause(F.col("text"))
    broken = F.col("_pt").rlike('[.:;!?»"]$') | clause
    taller = F.lit(False) if ocr else (F.col("h") > F.col("_ph") * 1.25) | (F.col("_ph") > F.col("h") * 1.25)
    apart = (F.col("_gap") > F.coalesce("_limit", F.lit(1e9))) | (F.col("_gap") < -2) | taller | (clause & (F.col("_pt").rlike("[.:;]$") | (F.col("_pe") < F.col("width") * 0.8)))
    fresh = F.col("_pt").isNull() | F.when(F.col("_gap").isNull(), broken).otherwise(apart)
    df = df.withColumn("ord", F.sum(fresh.cast("int")).over(d.rowsBetween(Window.unboundedPreceding, 0)))
    rows = F.sort_array(F.collect_list(F.struct("page_no", "line_no", "text")))
    joined = F.aggregate(rows, F.lit(""), lambda acc, r: F.when(acc == "", r["text"]).when(acc.rlike("(?iu)[a-záéíóúüñ]-$") & r["text"].rlike("^[a-záéíóúüñ]"), F.concat(F.regexp_replace(acc, "-$", ""), r["text"])).otherwise(F.concat(acc, F.lit(" "), r["text"])))
    return df.groupBy("doc_id", "ord").agg(joined.alias("text"))


# fixed values: words in a field's name, its label and what it usually holds
FIELD_RULES = [("dni|nif|nie|pasaporte|documento", "DNI", "dni"), ("iban|ccc|cuenta|bancari[oa]", "IBAN", "iban"), ("telefono|tfno|tlf|movil|fijo", "Teléfono", "telefono"), ("e ?mail|correo", "Correo electrónico", "email"), ("nombre|apellidos?|titular|solicitante|firmante|interesad[oa]|representante|arrendatari[oa]|arrendadora?|trabajadora?", "Nombre", "nombre"), ("domicilio|direccion|calle|via|residencia", "Domicilio", "direccion"), ("cp|codigo postal|postal", "Código postal", "cp"), ("nacimiento|f ?nac", "Fecha de nacimiento", "fecha_nac"), ("matricula", "Matrícula", "matricula"), ("tarjeta", "Tarjeta", "tarjeta"), ("afiliacion|seguridad social|nss|naf", "N.º afiliación S.S.", "nss")]


def field_rule(name: Column, help_text: Column) -> Column:
    """struct<label, type> by a form field's name and help; the first rule that fits, null if none."""
    n = F.regexp_replace(F.concat_ws(" ", name, help_text), "([a-z])([A-Z])", "$1 $2")
    n = F.regexp_replace(F.lower(unaccent(n)), "[^a-z0-9]+", " ")
    out = None
    for words, label, kind in FIELD_RULES:
        one = F.struct(F.lit(label).alias("label"), F.lit(kind).alias("type"))
        test = n.rlike(f"\\b(?:{words})\\b")
        out = F.when(test, one) if out is None else out.when(test, one)
    return out


def field_matches(fields: DataFrame, options=None) -> DataFrame:
    """(…, type, confidence): filled fields (name, help, value) to cover, found by the detectors behind the label, or by their name alone."""
    from .detect import Options, detect

    o = options or Options()
    df = fields.withColumn("_rule", field_rule(F.col("name"), F.col("help"))).withColumn("_prefix", F.coalesce(F.concat("_rule.label", F.lit(": ")), F.lit(""))).where(F.trim(F.coalesce("value", F.lit(""))) != "")
    df = detect(df.withColumn("_t", F.concat("_prefix", F.trim("value"))), "_t", o, "_m")
    mine = F.filter("_m", lambda m: m["end"] > F.length("_prefix"))
    sure = F.filter(mine, lambda m: m["confidence"] == "alta")
    by_name = F.when(F.col("_rule.type").isin(o.wanted()) & F.col("value").rlike("[0-9A-Za-zÀ-ÿ]{2}"), F.struct(F.col("_rule.type").alias("type"), F.lit("media").alias("confidence")))
    pick = lambda m: F.struct(m["type"].alias("type"), m["confidence"].alias("confidence"))
    mark = F.coalesce(F.when(F.size(sure) > 0, pick(F.get(sure, F.lit(0)))), F.when(F.size(mine) > 0, pick(F.get(mine, F.lit(0)))), by_name)
    return df.withColumn("_k", mark).where("_k is not null").select(*fields.columns, "_k.type", "_k.confidence")


def warnings(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, warning): pages (items, rotated, tabbed_lines, is_ocr, ocr_conf, text) that should be looked at."""
    w = F.array_compact(
        F.array(
            F.when(F.col("rotated") >= 0.05 * F.col("items"), F.lit("rotated text")),
            F.when(F.col("tabbed_lines") >= 5, F.lit("columns")),
            F.when(F.col("is_ocr") & (F.col("ocr_conf") < 60) & has_text(F.col("text")), F.lit("poor scan")),
            F.when(F.col("is_ocr") & ~has_text(F.col("text")), F.lit("unreadable scan")),
        )
    )
    return pages.select("doc_id", "page_no", F.explode(w).alias("warning"))

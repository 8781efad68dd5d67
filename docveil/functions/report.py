"""What people read: summaries, change names, reports as HTML, shortened paths, names for results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import squeeze, unaccent


def html_safe(c: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def _counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))


def change_summary(c: DataFrame | dict[str, Column]) -> Column:
    """A sentence on the counts of a comparison (total, modified, added, removed, moved, important, misread)."""
    col = lambda n: F.col(n) if isinstance(c, DataFrame) else c[n]
    kinds = [("modified", "modificado", "modificados"), ("added", "añadido", "añadidos"), ("removed", "eliminado", "eliminados"), ("moved", "movido de sitio", "movidos de sitio")]
    parts = F.concat_ws(", ", *[F.when(col(n) > 0, _counted(col(n), a, b)) for n, a, b in kinds])
    read = _counted(col("misread"), "posible error de lectura", "posibles errores de lectura")
    none = F.when(col("misread") > 0, F.concat(F.lit("No hay cambios de verdad; "), read, F.lit("."))).otherwise("Los dos documentos dicen lo mismo.")
    weight = F.when(col("important") > 0, _counted(col("important"), "importante", "importantes")).otherwise("ninguno importante")
    some = F.concat(_counted(col("total"), "cambio", "cambios"), F.lit(" ("), parts, F.lit("); "), weight, F.lit("."), F.when(col("misread") > 0, F.concat(F.lit(" Además, "), read, F.lit("."))).otherwise(""))
    return F.when(col("total") == 0, none).otherwise(some)


def change_name(change: Column) -> Column:
    kind = F.when(change["kind"] == "anadido", "añadido").otherwise(change["kind"])
    moved = F.concat(F.lit("movido de sitio"), F.coalesce(F.concat(F.lit(" (antes en "), change["was_at"], F.lit(")")), F.lit("")))
    return F.when(change["misread"], "posible error de lectura").when(change["kind"] == "movido", moved).otherwise(kind)


def important_text(item: Column) -> Column:
    """"850 euros → 950 euros", or what has turned up."""
    dash = lambda c: F.when(c == "", "—").otherwise(c)
    return F.when(item["label"] == "clausula", item["after"]).when(item["label"] == "sensible", F.concat(F.lit("Aparece: "), item["after"])).otherwise(F.concat(dash(item["before"]), F.lit(" → "), dash(item["after"])))


def change_report(compared: DataFrame, name: Column) -> Column:
    """A page of HTML on a comparison (rows, changes, a, b), without scripts or anything from elsewhere."""
    from ..operators.compare import words_html

    def body(c: Column) -> Column:
        text = F.coalesce(F.get("b", c["b"]), F.get("a", c["a"]))
        return F.when(F.size(c["words"]) > 0, words_html(c["words"])).otherwise(html_safe(text))

    items = lambda c: F.array_join(F.transform(c["important"], lambda i: F.concat(F.lit("<li>"), html_safe(important_text(i)), F.lit("</li>"))), "")
    rows = F.transform("changes", lambda c: F.concat(F.lit("<section><h2>"), html_safe(c["place"]), F.lit(": "), html_safe(change_name(c)), F.lit("</h2><p>"), body(c), F.lit("</p><ul>"), items(c), F.lit("</ul></section>")))
    head = "<!DOCTYPE html><html lang=\"es\"><head><meta charset=\"utf-8\"><meta http-equiv=\"Content-Security-Policy\" content=\"default-src 'none'; style-src 'unsafe-inline'\"><title>"
    return F.concat(F.lit(head), html_safe(name), F.lit("</title></head><body>"), F.array_join(rows, ""), F.lit("</body></html>"))


def report_name(a: Column, b: Column) -> Column:
    base = lambda c: F.trim(F.substring(squeeze(F.regexp_replace(F.regexp_extract(c, "([^/\\\\]*)$", 1), "\\.[^.]*$", "")), 1, 40))
    return F.concat(F.lit("comparacion-"), base(a), F.lit("-"), base(b))


def review_sheet(matches: DataFrame, limit: int = 200) -> DataFrame:
    """(scope_id, html): doubtful matches (doc_id, name, page_no, type, value, confidence) by document and page; over three of a type on a page
    are one line, and a sheet has at most ``limit`` lines and says how many are left out."""
    from .mask import LABELS

    said = F.create_map(*[F.lit(x) for k, (s, _) in LABELS.items() for x in (k, s)])
    d = matches.where("confidence <> 'alta'").groupBy("scope_id", "doc_id", "name", "page_no", "type").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_list("value")), 1, 3).alias("v"))
    kind = F.coalesce(F.try_element_at(said, F.col("type")), F.col("type"))
    where = F.concat(F.lit("<b>"), html_safe(F.col("name")), F.lit("</b>, página "), F.col("page_no").cast("string"), F.lit(": "))
    many = F.concat(F.col("n").cast("string"), F.lit(" × "), kind, F.lit(" ("), html_safe(F.array_join(F.slice("v", 1, 2), ", ")), F.lit("…)"))
    few = F.concat(kind, F.lit(" "), html_safe(F.array_join("v", ", ")))
    line = F.concat(F.lit("<li>"), where, F.when(F.col("n") > 3, many).otherwise(few), F.lit("</li>"))
    lines = d.select("scope_id", "n", F.struct("doc_id", "page_no", "type", line.alias("line")).alias("l"))
    got = lines.groupBy("scope_id").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("l")).alias("l"))
    more = F.when(F.size("l") > limit, F.concat(F.lit("<li>… y "), (F.size("l") - limit).cast("string"), F.lit(" líneas más</li>"))).otherwise("")
    return got.select("scope_id", F.concat(F.lit("<section><h2>Revisa primero: "), _counted(F.col("n"), "dato dudoso", "datos dudosos"), F.lit("</h2><ul>"), F.array_join(F.transform(F.slice("l", 1, limit), lambda x: x["line"]), ""), more, F.lit("</ul></section>")).alias("html"))


def short_paths(c: Column, roots: dict[str, str], home: str | None = None) -> Column:
    """Texts with long folder paths as their short names, longest first, and the user's folder hidden."""
    import re

    rules = dict(roots) | ({home: "(tu carpeta de usuario)"} if home else {})
    for long, short in sorted(rules.items(), key=lambda r: -len(r[0])):
        c = F.regexp_replace(c, re.escape(long) + "(?=$|[\\\\/\\s\"'«»“”)\\],;:.])", short.replace("\\", "\\\\").replace("$", "\\$"))
    return c


def purpose_slug(c: Column) -> Column:
    """A short file name for what a copy is for: "Solo para la inmobiliaria" gives "la-inmobiliaria"."""
    s = F.regexp_replace(F.lower(unaccent(c)), "^\\s*(?:solo|copia|unicamente|exclusivamente)\\s+(?:para|de)\\s+", "")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.substring(s, 1, 30)
    return F.when(F.length(s) > 30, F.coalesce(F.nullif(F.regexp_replace(cut, "-[^-]*$", ""), F.lit("")), cut)).otherwise(s)


def mark_text(c: Column, day: Column | None = None) -> Column:
    """The text of a watermark, with the date if one is given; null if it has characters outside Windows-1252."""
    t = squeeze(c)
    t = t if day is None else F.concat(t, F.lit(" · "), F.date_format(day, "dd/MM/yyyy"))
    return F.when(t.rlike("^[\\x20-\\x7e\\u00a0-\\u00ff€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]*$"), t)

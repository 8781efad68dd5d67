"""Span algebra: positions of pattern matches, overlap tests, islands, and the choice among overlapping matches.

A match is a struct ``(type, value, start, end, confidence, valid, seq)`` with code-point offsets and an exclusive end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MATCH = "struct<type:string,value:string,start:int,end:int,confidence:string,valid:boolean,seq:int>"
MATCHES = f"array<{MATCH}>"
WEIGHT = {"alta": 3, "media": 2, "baja": 1}


def weight(confidence: Column) -> Column:
    return F.when(confidence == "alta", 3).when(confidence == "media", 2).otherwise(1)


def pattern_spans(text: Column, pattern: str) -> Column:
    """array<struct<value,start,end>> of a pattern ``(prefix)(value)``.

    The matches, their prefixes and values, and the text between them come from built-in functions; adding up lengths
    gives the positions.
    """
    p = F.lit(pattern)
    parts = F.arrays_zip(
        F.regexp_extract_all(text, p, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, p, F.lit(1)).alias("prefix"),
        F.regexp_extract_all(text, p, F.lit(2)).alias("value"),
        F.split(text, pattern, -1).alias("gap"),
    )
    empty = F.expr("cast(array() as array<struct<value:string,start:int,end:int>>)")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["gap"])
        s = at + F.length(x["prefix"])
        own = F.struct(x["value"].alias("value"), s.alias("start"), (s + F.length(x["value"])).alias("end"))
        last = x["whole"].isNull()  # what follows the last match
        return F.struct(F.when(last, at).otherwise(at + F.length(x["whole"])).alias("at"), F.when(last, acc["out"]).otherwise(F.concat(acc["out"], F.array(own))).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(empty)


def match(kind: str, span: Column, confidence: Column | str, valid: Column | bool, seq: int, index: Column) -> Column:
    c = F.lit(confidence) if isinstance(confidence, str) else confidence
    v = F.lit(valid) if isinstance(valid, bool) else valid
    return F.struct(F.lit(kind).alias("type"), span["value"].alias("value"), span["start"].alias("start"), span["end"].alias("end"), c.alias("confidence"), v.alias("valid"), (F.lit(seq * 100_000) + index).cast("int").alias("seq"))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


_FIELDS = ("type", "value", "start", "end", "confidence", "valid", "seq")


def by_start(matches: Column) -> Column:
    keyed = F.sort_array(F.transform(matches, lambda m: F.struct(m["start"].alias("s"), m["end"].alias("e"), m["seq"].alias("q"), m.alias("m"))))
    return F.transform(keyed, lambda k: k["m"])


def resolve(matches: Column) -> Column:
    """The matches that stay: longest first, then by confidence, start and order of detection; each keeps what it does not share.

    A name that loses to a match starting further right keeps the part before it, if that has two words.  The result is by start.
    """
    ranked = F.sort_array(F.transform(matches, lambda m: F.struct((m["start"] - m["end"]).alias("l"), (-weight(m["confidence"])).alias("w"), m["start"].alias("s"), m["seq"].alias("q"), m.alias("m"))))
    ranked = F.transform(ranked, lambda r: r["m"])
    none = F.expr(f"cast(array() as {MATCHES})")
    # struct of what won so far and of the names that lost
    state = F.struct(none.alias("won"), none.alias("lost"))

    def choose(acc: Column, m: Column) -> Column:
        clash = F.exists(acc["won"], lambda e: overlaps(m, e))
        return F.struct(
            F.when(clash, acc["won"]).otherwise(F.concat(acc["won"], F.array(m))).alias("won"),
            F.when(clash & (m["type"] == "nombre"), F.concat(acc["lost"], F.array(m))).otherwise(acc["lost"]).alias("lost"),
        )

    def rescue(won: Column, m: Column) -> Column:
        first = F.array_min(F.transform(F.filter(won, lambda e: overlaps(m, e)), lambda e: e["start"]))
        piece = F.regexp_replace(F.substring(m["value"], F.lit(1), first - m["start"]), "[\\s,;:]+$", "")
        cut = F.struct(m["type"].alias("type"), piece.alias("value"), m["start"].alias("start"), (m["start"] + F.length(piece)).alias("end"), m["confidence"].alias("confidence"), m["valid"].alias("valid"), m["seq"].alias("seq"))
        fits = (first > m["start"]) & (F.regexp_count(piece, F.lit("\\p{L}{2,}")) >= 2) & ~F.exists(won, lambda e: (m["start"] < e["end"]) & (m["start"] + F.length(piece) > e["start"]))
        return F.when(F.coalesce(fits, F.lit(False)), F.concat(won, F.array(cut))).otherwise(won)

    done = F.aggregate(ranked, state, choose, lambda acc: F.aggregate(acc["lost"], acc["won"], rescue))
    return by_start(done)


def exploded(df: DataFrame, matches: str = "matches") -> DataFrame:
    """One row for each match, its fields as columns.

    A plain explode makes the optimizer filter on the array's size first, and with that it copies the detectors below projections.
    """
    rest = [c for c in df.columns if c != matches]
    return df.select(*rest, F.explode_outer(matches).alias("_m")).where("_m is not null").select(*rest, *[F.col(f"_m.{f}").alias(f) for f in _FIELDS])


def islands(spans: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Number the clusters of overlapping spans within a key; touching spans are apart."""
    w = Window.partitionBy(*key).orderBy(F.col(start), F.col(end).desc())
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) >= reach), 1).otherwise(0)
    return spans.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def overlap_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", width: int = 256) -> DataFrame:
    """Join spans of two tables that overlap within a key; columns of the right get the suffix ``_r``.

    Spans are dealt to bins of ``width`` positions, so that it is an equi-join on key and bin; a pair is kept only in the first bin that
    both touch.  A long document's spans so spread over many keys.
    """
    bins = lambda s, e: F.sequence(F.floor(s / width), F.floor((F.greatest(e, s + 1) - 1) / width))
    lt = left.withColumn("_bin", F.explode(bins(F.col("start"), F.col("end"))))
    rt = right.select(*[F.col(c).alias(f"{c}_r") for c in right.columns]).withColumn("_bin_r", F.explode(bins(F.col("start_r"), F.col("end_r"))))
    on = (lt[key] == rt[f"{key}_r"]) & (lt["_bin"] == rt["_bin_r"]) & (lt["start"] < rt["end_r"]) & (lt["end"] > rt["start_r"])
    if how == "inner":
        first = F.floor(F.greatest("start", "start_r") / width)
        return lt.join(rt, on).where(F.col("_bin") == first).drop("_bin", "_bin_r")
    hit = lt.join(rt, on, "left_semi").select(*left.columns).distinct()
    if how == "left_semi":
        return hit
    same = F.lit(True)
    for c in left.columns:
        same = same & left[c].eqNullSafe(hit[c])
    return left.join(hit, same, "left_anti")

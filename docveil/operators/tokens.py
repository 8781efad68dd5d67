"""A positional index of words: where known values stand in texts, without trying every value on every document.

Texts are cut into words (letters and digits) with their places; only words that some value of the scope has go on.  A value is looked for at its
rarest word in the scope, and the text around decides.  So work follows the places where a value may stand, not documents times values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..sources.shared import stored

#: Places of words in one batch.
PLACES = 50_000
_WORD = re.compile(r"[^\W_]+")


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the last column, beside the others: they leave in batches, so that no batch of texts is held as words."""
    for b in batches:
        kept = b.select(b.schema.names[:-1])
        row, token, ends, places = [], [], [0], []

        def flushed(kept: pa.RecordBatch, row: list, token: list, ends: list, places: list) -> pa.RecordBatch:
            at = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
            return pa.RecordBatch.from_arrays([*kept.take(pa.array(row, pa.int64())).columns, pa.array(token, pa.string()), at], [*kept.schema.names, "token", "at"])

        for k in range(b.num_rows):
            own, n = {}, len(places)

            def put(k: int, own: dict[str, list[int]]) -> None:
                for t, at in own.items():
                    row.append(k)
                    token.append(t)
                    places.extend(at)
                    ends.append(len(places))

            for m in _WORD.finditer(b.column(b.num_columns - 1)[k].as_py() or ""):
                own.setdefault(m[0].lower(), []).append(m.start())
                n += 1
                if n >= PLACES:
                    put(k, own)
                    yield flushed(kept, row, token, ends, places)
                    own, n = {}, 0
                    row, token, ends, places = [], [], [0], []
            put(k, own)
        if row:
            yield flushed(kept, row, token, ends, places)


def words(df: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """(keep, token, at): runs of letters and digits, lower-cased, and all their places in a text; a word of a long text may have several rows."""
    rows = df.select(*keep, F.col(text_col).alias("_text"))
    fields = [f for f in rows.schema.fields if f.name != "_text"]
    return rows.mapInArrow(_worded, StructType([*fields, StructField("token", StringType()), StructField("at", ArrayType(IntegerType()))]))


def token_index(docs: DataFrame, scope: str = "scope_id", text_col: str = "text") -> DataFrame:
    """(scope, doc_id, token, at), ``at`` an array of places"""
    return words(docs, [scope, "doc_id"], text_col)


def _is_inner(c: Column) -> Column:
    return c.rlike("[\\p{L}\\p{N}]")


def places_of(docs: DataFrame, forms: DataFrame, scope: str = "scope_id", text_col: str = "text", any_case: Column | None = None) -> DataFrame:
    """(scope, doc_id, start, end, value, form, label): where the forms (scope, form, label) stand in a scope's texts as whole words.

    ``any_case`` tells of which forms the case doesn't count.  Forms without a letter or digit are not looked for.
    """
    own = words(forms.withColumn("_form", F.col("form")), [scope, "form", "label"], "_form").select(scope, "form", "label", "token", F.explode("at").alias("_off"))
    # counted first and looked up then: stored, so that Python and the join run once
    index = stored(token_index(docs, scope, text_col).join(own.select(scope, "token").distinct(), [scope, "token"], "left_semi"), "words")
    common = index.groupBy(scope, "token").agg(F.sum(F.size("at")).alias("_n"))
    # a form of which a word is nowhere in the scope has none of its places
    rated = own.join(common, [scope, "token"], "left").groupBy(scope, "form", "label").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "token", "_off")).alias("r"))
    rarest = rated.where("r.n > 0").select(scope, "form", "label", "r.token", "r._off")
    placed = index.join(rarest, [scope, "token"]).select(scope, "doc_id", F.explode("at").alias("at"), "_off", "form", "label")
    maybe = placed.select(scope, "doc_id", (F.col("at") - F.col("_off")).alias("start"), "form", "label").where("start >= 0")
    listed = maybe.groupBy(scope, "doc_id").agg(F.collect_set(F.struct("start", "form", "label")).alias("_maybe"))
    text, m = F.col(text_col), F.col("_m")
    found = docs.select(scope, "doc_id", text_col).join(listed, [scope, "doc_id"]).select(scope, "doc_id", text_col, F.explode("_maybe").alias("_m"))
    n = F.length(m["form"])
    value = F.substring(text, m["start"] + 1, n)
    before = F.when(m["start"] > 0, F.substring(text, m["start"], F.lit(1))).otherwise("")
    after = F.substring(text, m["start"] + n + 1, F.lit(1))
    same = value == m["form"]
    found = found.select(scope, "doc_id", m["start"].alias("start"), (m["start"] + n).alias("end"), value.alias("value"), m["form"].alias("form"), m["label"].alias("label"), same.alias("_same"), (F.lower(value) == F.lower(m["form"])).alias("_alike"), (_is_inner(before) | _is_inner(after)).alias("_inner"))
    good = F.col("_same") if any_case is None else F.col("_same") | (F.col("_alike") & any_case)
    return found.where(good & ~F.col("_inner")).drop("_same", "_alike", "_inner")

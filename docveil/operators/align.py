"""Letters of a text paired with the placed glyphs of its page, in order, though blanks, ligatures and single glyphs differ.

Runs of letters that stand once on each side tie the two together; of runs that cross, the heaviest chain stays.  Between the runs that are left
letters are paired by a short look ahead.  Glyphs that follow each other are put together before they are dealt out, so that a letter takes about a
byte on the way to its page; a page's letters are numpy arrays in one task, and its pairs leave in batches.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .geometry import united

#: Letters that a tie has to have.
TIE = 8
#: Letters of one batch.
LETTERS = 50_000
#: Glyphs that may be passed over in search of a letter (fixed value).
AHEAD = 40


@lru_cache(maxsize=65536)
def _plain(c: str) -> str:
    """A character's compatibility form without blanks."""
    return "".join(x for x in unicodedata.normalize("NFKC", c) if not x.isspace() and x != "﻿")


def _lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters of the last column, beside the others: a text's letters leave in batches, so that no batch of texts is held as letters."""
    for b in batches:
        kept, found = b.select(b.schema.names[:-1]), []

        def flushed(kept: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
            row, *columns = zip(*found, strict=True)
            own = kept.take(pa.array(row, pa.int64())).columns
            return pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32()), strict=True))], [*kept.schema.names, "c", "at", "_k"])

        for row in range(b.num_rows):
            n = 0
            for at, c in enumerate(b.column(b.num_columns - 1)[row].as_py() or ""):
                for x in _plain(c):
                    found.append((row, x, at, n))
                    n += 1
                if len(found) >= LETTERS:
                    yield flushed(kept, found)
                    found = []
        if found:
            yield flushed(kept, found)


def letter_rows(texts: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """(keep, c, at, _k): a row for each letter of a text's compatibility form, its place in the text, and its number."""
    rows = texts.select(*keep, F.col(text_col).alias("_text"))
    fields = [f for f in rows.schema.fields if f.name != "_text"]
    return rows.mapInArrow(_lettered, StructType([*fields, StructField("c", StringType()), StructField("at", IntegerType()), StructField("_k", IntegerType())]))


def heaviest_chain(places: list[int], weights: list[int]) -> list[int]:
    """Indexes of the runs, given in one side's order, that also rise on the other side and weigh most together; of equals the first found."""
    order = sorted(places)
    best: list[tuple[int, int]] = [(0, -1)] * (len(order) + 1)  # prefix maxima in a binary indexed tree
    parent = []
    last = (0, -1)
    for n, (p, w) in enumerate(zip(places, weights, strict=True)):
        rank = bisect_left(order, p)
        at, top = rank, (0, -1)
        while at > 0:
            top = max(top, best[at], key=lambda e: e[0])
            at -= at & -at
        parent.append(top[1])
        own = (top[0] + w, n)
        last = max(last, own, key=lambda e: e[0])
        at = rank + 1
        while at <= len(order):
            best[at] = max(best[at], own, key=lambda e: e[0])
            at += at & -at
    out, n = [], last[1]
    while n >= 0:
        out.append(n)
        n = parent[n]
    return out[::-1]


def in_order(left: list[str], right: list[str], ahead: int = AHEAD) -> list[tuple[int, int]]:
    """Each letter with the next equal one that is not further ahead; a letter without one is passed over."""
    out, at = [], 0
    for n, c in enumerate(left):
        try:
            k = right.index(c, at, at + ahead)
        except ValueError:
            continue
        out.append((n, k))
        at = k + 1
    return out


# ---------------------------------------------------------------- letters as code points

#: Letters of each character's compatibility form: their number (UNKNOWN before it is met), the first, and all where there are several.
UNKNOWN = 255
_NUMBER, _FIRST, _SEVERAL = np.full(0x110000, UNKNOWN, np.uint8), np.zeros(0x110000, "<u4"), {}


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), "<u4")


def _letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's letters in their compatibility form, and the place of each in the text."""
    codes = _codes(text)
    for c in np.unique(codes[_NUMBER[codes] == UNKNOWN]).tolist():
        plain = _codes(_plain(chr(c)))
        _NUMBER[c] = len(plain)
        if len(plain):
            _FIRST[c] = plain[0]
        if len(plain) > 1:
            _SEVERAL[c] = plain
    number = _NUMBER[codes]
    at = np.repeat(np.arange(len(codes)), number)
    out = _FIRST[codes[at]]
    if (many := np.flatnonzero(number > 1)).size:
        first = np.cumsum(number, dtype=np.int64) - number
        for i in many.tolist():
            out[first[i] : first[i] + number[i]] = _SEVERAL[int(codes[i])]
    return out, at


#: Stands for a glyph without number, which comes before all others.
NO_NUMBER = -(1 << 40)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(keys, _n, _size, _text, _odd): glyphs (keys, n, c) of one page whose numbers follow each other, from ``_n`` on, as one row of their letters.

    ``_odd`` has the places of the glyphs that haven't one letter, each with their number.
    """
    for b in batches:
        rows = b.num_rows
        if not rows:
            continue
        *keys, n, c = b.columns
        number = n.cast(pa.int64()).fill_null(NO_NUMBER).to_numpy()
        new = np.ones(rows, bool)
        new[1:] = np.diff(number) != 1
        for k in keys:
            new[1:] |= pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(new)
        end = np.append(start[1:], rows)
        c = c.fill_null("")
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), c.cast(pa.string())), "")[0].as_py()
        letters, at = _letters(text)
        each = np.bincount(np.repeat(np.arange(rows), pc.utf8_length(c).to_numpy())[at], minlength=rows)
        odd = np.flatnonzero(each != 1)
        ends = np.append(0, np.cumsum(each))
        own = np.searchsorted(odd, np.append(start, rows))
        pairs = np.stack([odd - np.repeat(start, np.diff(own)), each[odd]], 1).ravel()
        texts = [letters[x:y].tobytes().decode("utf-32-le") for x, y in zip(ends[start].tolist(), ends[end].tolist(), strict=True)]
        made = [pa.array(number[start], pa.int64()), pa.array(end - start, pa.int32()), pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(2 * own, pa.int32()), pa.array(pairs, pa.int32()))]
        yield pa.RecordBatch.from_arrays([*(k.take(pa.array(start)) for k in keys), *made], [*b.schema.names[:-2], "_n", "_size", "_text", "_odd"])


def _drawn(pieces: list[tuple[int, int, str, list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of a page's packed glyphs by their glyphs' numbers, and the number of each."""
    letters, numbers, place = [], [], []
    for n, size, text, odd in pieces:
        each = np.ones(size, np.int64)
        each[odd[::2]] = odd[1::2]
        letters.append(_codes(text))
        numbers.append(np.repeat(n + np.arange(size), each))
        place.append(np.arange(len(letters[-1])) - np.repeat(np.cumsum(each) - each, each))
    out, number, k = map(np.concatenate, (letters, numbers, place))
    if len(pieces) > 1 and any(x[0] + x[1] > y[0] for x, y in zip(pieces, pieces[1:], strict=False)):
        order = np.lexsort((out, k, number))
        out, number = out[order], number[order]
    return out, number


# ---------------------------------------------------------------- a page


def _grams(left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
    """A number for each TIE letters that follow each other on a side, the same for the same letters."""
    alphabet = np.unique(np.concatenate([left, right]))
    sides = [np.searchsorted(alphabet, x).astype(np.int64) for x in (left, right)]
    width, kinds = 1, len(alphabet)
    while width < TIE:
        step = min(width, TIE - width)
        sides = [x[: max(0, len(x) - step)] * kinds + x[step:] for x in sides]
        width += step
        if width < TIE:
            ranks = np.unique(np.concatenate(sides))
            sides, kinds = [np.searchsorted(ranks, x) for x in sides], len(ranks)
    return sides


def _ties(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ties that are kept, rising on both sides."""
    once = []
    for x in _grams(left, right):
        grams, at, n = np.unique(x, return_index=True, return_counts=True)
        once.append((grams[n == 1], at[n == 1]))
    (gl, al), (gr, ar) = once
    _, i, j = np.intersect1d(gl, gr, assume_unique=True, return_indices=True)
    i, j = al[i], ar[j]
    order = np.argsort(i)
    i, j = i[order], j[order]
    if not i.size:
        return i, j
    start = np.flatnonzero(np.append(True, (np.diff(i) != 1) | (np.diff(j) != 1)))
    size = np.diff(np.append(start, len(i)))
    kept = np.array(heaviest_chain(j[start].tolist(), size.tolist()), np.int64)
    size = size[kept]
    at = np.repeat(start[kept] - np.cumsum(size) + size, size) + np.arange(size.sum())
    return i[at], j[at]


def _page(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the letters that are paired, rising on both sides."""
    if np.array_equal(left, right):  # all ties lie on one line and between them each letter meets its own
        return np.arange(len(left)), np.arange(len(right))
    i, j = _ties(left, right)
    at, to = np.append(-1, i), np.append(-1, j)
    end, stop = np.append(i, len(left)), np.append(j, len(right))
    a, b, more = left.tolist(), right.tolist(), []
    for g in np.flatnonzero((end - at > 1) & (stop - to > 1)).tolist():
        x, y = int(at[g]) + 1, int(to[g]) + 1
        more += [(x + p, y + q) for p, q in in_order(a[x : int(end[g])], b[y : int(stop[g])])]
    if more:
        p, q = np.array(more).T
        i, j = np.append(i, p), np.append(j, q)
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
    return i, j


def _pages(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs of rows (keys, _side, _n, _size, _text, _odd) that come by page, in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[pa.RecordBatch] = []
        key, texts, pieces = None, [], []

        def paired() -> Iterator[pa.RecordBatch]:
            if not texts or not pieces:
                return
            sides = [_letters(t) for t in texts]
            if len(sides) > 1:
                order = np.argsort(np.concatenate([np.arange(len(x)) for x, _ in sides]), kind="stable")
                sides = [tuple(np.concatenate(c)[order] for c in zip(*sides, strict=True))]
            (left, at), (right, n) = sides[0], _drawn(pieces)
            i, j = _page(left, right)
            at, n = at[i], n[j]
            new = np.append(True, (np.diff(at) != 0) | (np.diff(n) != 0))[: len(at)]
            at, n = at[new], n[new]
            for x in range(0, len(at), LETTERS):
                a, b = at[x : x + LETTERS], n[x : x + LETTERS]
                own = [pa.repeat(pa.scalar(k, f.type), len(a)) for k, f in zip(key, schema, strict=False)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(a, pa.int32()), pa.array(np.where(b == NO_NUMBER, 0, b), pa.int32(), mask=b == NO_NUMBER)], schema=schema)

        def flushed() -> pa.RecordBatch:
            out = pa.Table.from_batches(made, schema).combine_chunks().to_batches()[0]
            made.clear()
            return out

        def kept() -> Iterator[pa.RecordBatch]:
            for b in paired():
                made.append(b)
                if sum(x.num_rows for x in made) >= LETTERS:
                    yield flushed()

        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for *own, side, n, size, text, odd in zip(*columns, strict=True):
                if own != key:
                    yield from kept()
                    key, texts, pieces = own, [], []
                if side == 0:
                    texts.append(text or "")
                else:
                    pieces.append((n, size, text, odd))
        yield from kept()
        if made:
            yield flushed()

    return run


def aligned(texts: DataFrame, glyphs: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """(key, at, n): which glyph shows which character.

    ``texts`` are (key, text), a row a page, ``glyphs`` (key, n, c) with ``n`` in the order of the page and ``c`` its characters, perhaps several.
    Characters are compared in their compatibility form, so that a ligature shows each of its letters; blanks count on neither side.
    A character without its glyph, and a glyph that no character asks for, have no row.  Null and empty texts or glyphs pair with
    nothing, nor do pages that only one side has or whose key has a null.  Other columns are ignored.
    """
    whole = lambda df: df.where(" and ".join(f"`{k}` is not null" for k in key))
    drawn = whole(glyphs).select(*key, F.col("n").cast("int").alias("_n"), F.col("c").alias("_c"))
    own = drawn.schema.fields[: len(key)]
    piece = [StructField("_n", LongType()), StructField("_size", IntegerType()), StructField("_text", StringType()), StructField("_odd", ArrayType(IntegerType()))]
    packed = drawn.mapInArrow(_packed, StructType([*own, *piece])).select(*key, F.lit(1).alias("_side"), *(f.name for f in piece))
    written = whole(texts).select(*key, F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_n"), F.lit(0).alias("_size"), F.col(text_col).alias("_text"), F.lit(None).cast("array<int>").alias("_odd"))
    pages = written.unionByName(packed).repartition(*key).sortWithinPartitions(*key, "_side", "_n")
    out = StructType([*own, StructField("at", IntegerType()), StructField("n", IntegerType())])
    return pages.mapInArrow(_pages(to_arrow_schema(out)), out)


def glyph_rects(spans: DataFrame, pairs: DataFrame, glyphs: DataFrame, key: list[str]) -> DataFrame:
    """(key, start, end, rects): what to cover of a page for spans of its text, the boxes of a line as one.

    ``pairs`` come from ``aligned``, ``glyphs`` are (key, n, rect).  A span without a glyph has an empty array.  Repeated spans give one row.
    """
    own = spans.select(*key, "start", "end").distinct()
    places = own.select(*key, "start", "end", F.explode(F.sequence(F.col("start"), F.greatest(F.col("start"), F.col("end") - 1))).alias("at")).where("at < end")
    boxes = places.join(pairs, [*key, "at"]).select(*key, "start", "end", "n").distinct().join(glyphs.select(*key, "n", "rect"), [*key, "n"])
    found = boxes.groupBy(*key, "start", "end").agg(united(F.collect_list("rect")).alias("rects"))
    empty = F.expr("cast(array() as array<struct<x:double,y:double,w:double,h:double>>)")
    return own.join(found, [*key, "start", "end"], "left").withColumn("rects", F.coalesce("rects", empty))

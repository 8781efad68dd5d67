"""Spelling variants: words that differ by one inserted, deleted or replaced character, grouped under the commonest.

1.  ``word_counts`` takes runs of letters from whole texts and adds them up.  Each run may lose one character by its checksum.
2.  ``deletion_keys`` gives each word with each of its characters deleted, and the word itself, an integer key: two polynomial hashes
    modulo primes of 31 bits, side by side.  A deletion's hash is the sum of the prefix before it and the suffix behind it, so numpy gets
    all keys of a batch from two running sums, in time linear in the letters however long a word is.
3.  Keys are radix-partitioned (dealt by their high bits) and sorted.  Words that are replaced in one place meet at that place's
    deletion; a word with an insertion meets the other's own key.  Only keys that meet go on, with their words' numbers, not texts.
4.  ``neighbours`` joins the words again and groups by the strings themselves, so that hash collisions fall apart.  Within a string no pairs are made:
    counts and the two best of a group say what each member needs.
5.  ``roots`` follows forms by doubling steps, as each form is several times as frequent as its variant.

Defined results: null and empty texts have no words; a null id reads as the empty id; repeated rows count as often as they
come; of equally frequent near words the smallest in code-point order is the form; an empty table gives no rows.
"""

from __future__ import annotations

import re
from binascii import crc32
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, stored

LEAST_LETTERS, LEAST_COUNT, RATIO, EVERY = 6, 5, 5, 199
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003, 8_675_309)
#: Distinct words that a task holds before it passes them on.
HELD = 300_000


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, every: int = EVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): occurrences in all texts of runs of letters, lower-cased in A-Z, of at least ``least_letters`` code points.

    Of a run whose checksum with its document's id is divisible by ``every``, one code point is deleted first.
    """
    run = re.compile(f"[a-zÀ-ÿ]{{{least_letters},}}")  # a shorter run can only get shorter

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.record_batch([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return b

        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                t = text.as_py()
                t = t.lower() if t.isascii() else t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                first = crc32(f"{'' if doc is None else doc}:".encode())
                for w, n in Counter(run.findall(t)).items():
                    h = crc32(w.encode(), first)
                    if h % every == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < least_letters:
                            continue
                    total[w] += n
                if len(total) > HELD:
                    yield out()
        if total:
            yield out()

    return id_and_text(docs, id_col, text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _powers(n: int, base: int, prime: int) -> np.ndarray:
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * (int(out[-1]) * base % prime) % prime])
    return out[:n]


def keys_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word's place in the list, position deleted or -1 for none, whether a run of one letter starts there, key)"""
    size = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    word = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(codes)) - start[word]
    # deleting any letter of a run of one letter leaves the same string
    first = np.ones(len(codes), bool)
    first[1:] = (codes[1:] != codes[:-1]) | (at[1:] == 0)
    cut, own = np.zeros(len(codes), np.int64), np.zeros(len(words), np.int64)
    for base, prime in zip(BASES, PRIMES, strict=True):
        power = _powers(int(size.max(initial=0)) + 1, base, prime)
        prefix = np.append(0, np.cumsum((codes + 1) * power[at] % prime))
        suffix = np.append(0, np.cumsum((codes + 1) * power[np.maximum(at - 1, 0)] % prime))  # letters behind a deletion move up by one
        g = np.arange(len(codes))
        cut = cut << 31 | (prefix[g] - prefix[start[word]] + suffix[end[word]] - suffix[g + 1]) % prime
        own = own << 31 | (prefix[end] - prefix[start]) % prime
    return np.append(word, np.arange(len(words))), np.append(at, np.full(len(words), -1)), np.append(first, np.zeros(len(words), bool)), np.append(cut, own)


def deletion_keys(words: DataFrame) -> DataFrame:
    """(key, at, first, id) for words (id, word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 20_000):
                some = b.slice(k, 20_000)
                word, at, first, key = keys_of(some["word"].to_pylist())
                for m in range(0, len(key), 100_000):
                    part = slice(m, m + 100_000)
                    yield pa.record_batch([pa.array(key[part]), pa.array(at[part].astype(np.int32)), pa.array(first[part]), some["id"].take(pa.array(word[part]))], names=["key", "at", "first", "id"])

    return words.select("id", "word").mapInArrow(run, "key long, at int, first boolean, id long")


def met(key: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(replaced, inserted): which rows, sorted by key then position, share a key and position, and which a key with an own word."""
    same = np.append(False, (key[1:] == key[:-1]) & (at[1:] == at[:-1]) & (at[1:] >= 0))
    replaced = same | np.append(same[1:], False)
    group = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
    n = group[-1] + 1 if len(group) else 0
    has_own = np.bincount(group, at == -1, n) > 0
    has_cut = np.bincount(group, first, n) > 0
    return replaced, (has_own & has_cut)[group] & (first | (at == -1))


def meetings(keys: DataFrame) -> DataFrame:
    """(key, at, id, inserted): rows whose key meets another word's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            key, at, first, word = cols
            end = len(key) if last else int(np.searchsorted(key, key[-1]))  # the last group may go on
            replaced, inserted = met(key[:end], at[:end], first[:end])
            for hit, kind in ((replaced, False), (inserted, True)):
                some = np.flatnonzero(hit)
                for k in range(0, len(some), 100_000):
                    i = some[k : k + 100_000]
                    yield pa.record_batch([pa.array(key[i]), pa.array(at[i]), pa.array(word[i]), pa.array(np.full(len(i), kind))], names=["key", "at", "id", "inserted"])
            held, n = [[c[end:] for c in cols]], 0

        for b in batches:
            held.append([b[c].to_numpy(zero_copy_only=False) for c in ("key", "at", "first", "id")])
            n += b.num_rows
            if n >= 500_000:
                yield from flush(False)
        if held:
            yield from flush(True)

    radix = keys.repartition(F.shiftright("key", 46)).sortWithinPartitions("key", "at")
    return radix.mapInArrow(run, "key long, at int, id long, inserted boolean")


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best): for words (id, word, n) that have a near word: how many, and the most frequent as (-n, word)."""
    row = meetings(deletion_keys(words)).join(words, "id")
    text = F.when(F.col("at") < 0, F.col("word")).otherwise(F.concat(F.substring("word", F.lit(1), F.col("at")), F.substring("word", F.col("at") + 2, F.length("word"))))
    row = row.select("key", "at", "id", "inserted", text.alias("text"), F.struct((-F.col("n")).alias("minus_n"), "word").alias("me"))
    place = Window.partitionBy("key", "at", "text")
    in_order = place.orderBy("me")
    others = F.when(F.row_number().over(in_order) == 1, F.lead("me").over(in_order)).otherwise(F.min("me").over(place))
    replaced = row.where("not inserted").select("id", (F.count(F.lit(1)).over(place) - 1).alias("n_near"), others.alias("best"))
    string = Window.partitionBy("key", "text")
    whole, cut = F.when(F.col("at") < 0, F.col("me")), F.when(F.col("at") >= 0, F.col("me"))
    other = lambda f: F.when(F.col("at") < 0, f(cut).over(string)).otherwise(f(whole).over(string))
    inserted = row.where("inserted").select("id", other(F.count).alias("n_near"), other(F.min).alias("best"))
    both = replaced.unionByName(inserted).where("n_near > 0")
    return both.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for (word, form): each step doubles how far along the forms a root lies."""
    state = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        state = stored(state.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if state.where("moved").isEmpty():
            return state.select("word", "root")
        state = state.select("word", "root")


def variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO, every: int = EVERY) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of at least ``least_count`` occurrences."""
    counted = word_counts(docs, least_letters, every).where(F.col("n") >= least_count)
    words = stored(counted.withColumn("id", F.monotonically_increasing_id()), "words")
    near = words.join(neighbours(words), "id", "left")
    good = -F.col("best.minus_n") >= ratio * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.word")).alias("form"), F.when(good, -F.col("best.minus_n")).alias("form_n"))
    near = stored(near, "near-words")
    out = near.join(roots(near.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

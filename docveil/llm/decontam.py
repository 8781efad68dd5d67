"""Benchmark decontamination: a BM25 inverted index of test items, queried with block-max WAND by every training passage.

Test items are cut into segments of at most ``SEGMENT`` words, each sharing half with the next, and indexed.  An entry's weight is its
BM25 weight divided by the segment's weight in full, so a passage that holds a whole segment scores 1 and one threshold serves all.
Document frequencies and the mean length are those of all segments.  Documents are read as passages of two half-windows of ``SEGMENT``
words, each half shared with the next passage, so every segment lies in one whole.

Retrieval follows block-max WAND, for all passages of a document at once: segments are in blocks of ``BLOCK``, and the index keeps each
term's maximal weight, its blocks, and its maximal weight in each of them.  A passage's terms are laid out by rising maxima; the pivot is
where their sum reaches the threshold.  Terms before it can't bring a segment there by themselves, so only blocks of the others are looked at
(a passage without a pivot is done).  Blocks whose maxima can't reach the threshold are skipped, first with the maxima of the terms
before the pivot, then with those in the block; only in the others are the postings scored exactly.  All segments above the threshold are
kept and verified: word trigrams of an item's question (all but its last sentence) and of its answer (the last sentence, or what follows
an answer mark) have to be found in the passage.

The index is sparse: an entry for each word of a segment and one for each term and block.  One pass over the documents queries up to
``PART`` segments, a broadcast of under 200 MB (about 64 entries of 28 bytes and some words for each); a larger benchmark takes more passes,
with the same results.

Defined results: null and empty texts and items match nothing; items without words aren't indexed; items under ``MIN_WORDS`` words need all
their words in a row; repeated rows are reported each; ties are all kept, and of an item's equally good passages the first is
reported; an empty table gives no rows; a null document id is reported as such.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_batches, stored

SEGMENT, BLOCK, PART = 64, 8, 50_000
#: Entries of the index that are looked at together, about.
AT_ONCE = 1_000_000
#: Words that are queried together, about; a document is never divided.
WORDS_AT_ONCE = 100_000
MIN_WORDS = 6
K1, B = 1.2, 0.75
THRESHOLD = 0.5
#: Shares of trigrams that have to be found: of question and answer each, or of all, or of a long question alone.
QUESTION, ANSWER, ALL, ALONE = 0.5, 0.3, 0.6, 0.8
#: Thai, Lao, Burmese, Khmer, kana and Chinese characters.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_WORD = re.compile(f"(?![_\\W])[{_UNSPACED}]|[^\\W_{_UNSPACED}]+")
_ANSWER_MARK = re.compile(r"\n\s*(?:answer|a|antwort|réponse|respuesta)\s*:", re.I)


def normal_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    if m := _ANSWER_MARK.search(text):
        return normal_words(text[: m.start()]), normal_words(text[m.end() :])
    cut = max((m.end() for m in re.finditer(r"[.!?]\s+", text.rstrip())), default=0)
    return normal_words(text[:cut]), normal_words(text[cut:])


def segments_of(text: str) -> list[tuple[list[str], int]]:
    """(words, how many of them belong to the question) of each segment of an item."""
    q, a = question_and_answer(text)
    words = q + a
    if not words:
        return []
    # all of about the same length, so that a cut through a quotation leaves most of it in some segment
    n = max(1, -(-2 * len(words) // SEGMENT) - 1)
    cuts = [(k * len(words) // (n + 1), (k + 2) * len(words) // (n + 1)) for k in range(n)] if n > 1 else [(0, len(words))]
    return [(words[lo:hi], min(max(len(q) - lo, 0), hi - lo)) for lo, hi in cuts]


def grams(terms: np.ndarray, n: int = 3) -> np.ndarray:
    """Distinct runs of n terms, packed; none that has a word outside the vocabulary (0)."""
    if len(terms) < n or not n:
        return np.zeros(0, np.int64)
    runs = [terms[k : len(terms) - n + 1 + k] for k in range(n)]
    packed = sum(r << (21 * k) for k, r in enumerate(runs))
    return np.unique(packed[np.all([r > 0 for r in runs], axis=0)])


@dataclass
class Index:
    items: np.ndarray  # by segment
    terms: list[np.ndarray]  # a segment's words as term numbers
    asked: np.ndarray  # how many of them belong to the question
    short: np.ndarray  # whether its words have to be found in a row
    vocab: dict[str, int]  # term numbers from 1; 0 is any other word
    most: np.ndarray  # a term's maximal weight
    first: np.ndarray  # a term's entries by block: [first[t], first[t + 1])
    keys: np.ndarray  # an entry's term times the number of blocks, plus its block: in order
    blocks: np.ndarray  # an entry's block
    bounds: np.ndarray  # an entry's maximal weight
    posts: np.ndarray  # an entry's postings: [posts[e], posts[e + 1])
    segments: np.ndarray  # a posting's segment
    weights: np.ndarray  # a posting's weight


def build_index(segments: list[tuple[int, list[str], int, bool]], weights: list[dict[str, float]]) -> Index:
    """An index of (item, words, words of the question, short) with the weights of each one's words."""
    vocab = {w: k for k, w in enumerate(sorted(set().union(*weights)), 1)}
    rows = [np.array([vocab[w] for w in words], np.int64) for _, words, _, _ in segments]
    term = np.array([vocab[w] for ws in weights for w in ws], np.int64)
    segment = np.repeat(np.arange(len(weights)), [len(ws) for ws in weights]).astype(np.int64)
    weight = np.array([x for ws in weights for x in ws.values()], np.float64)
    order = np.lexsort((segment, term))
    term, segment, weight = term[order], segment[order], weight[order]
    key = term * (len(segments) // BLOCK + 1) + segment // BLOCK
    posts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    bounds = np.maximum.reduceat(weight, posts) if len(key) else np.zeros(0)
    first = np.searchsorted(term[posts], np.arange(len(vocab) + 2))
    most = np.zeros(len(vocab) + 1)
    np.maximum.at(most, term, weight)
    asked, short = np.array([s[2] for s in segments], np.int64), np.array([s[3] for s in segments], bool)
    items = np.array([s[0] for s in segments], np.int64)
    return Index(items, rows, asked, short, vocab, most, first, key[posts], segment[posts] // BLOCK, bounds, np.append(posts, len(key)), segment, weight)


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, its member) for all members of ranges [first, last)."""
    n = last - first
    return np.repeat(np.arange(len(n)), n), np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def _sums(key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of each."""
    if not len(key):
        return key, x
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[at], np.add.reduceat(x[order], at)


def retrieve(index: Index, terms: np.ndarray, lens: list[int], threshold: float) -> list[tuple[int, int, int, float]]:
    """(document, half-window, segment, score) of all passages, two half-windows each, that score at least the threshold.

    ``terms`` are the words of documents with these lengths, one after the other.
    """
    if not len(terms) or not len(index.items):
        return []
    lens = np.array(lens, np.int64)
    halves = -(-lens // SEGMENT)
    doc, half = _spread(np.zeros(len(lens), np.int64), halves)
    start = (np.cumsum(lens) - lens)[doc] + half * SEGMENT
    # each half-window starts a passage and, but for a document's first one, ends the one before
    ends = half > 0
    most = np.add.reduceat(index.most[terms], start)
    both = most.copy()
    both[:-1] += np.where(ends[1:], most[1:], 0)
    # a term may count twice here; where this reaches the threshold, terms are counted once
    able = np.flatnonzero(both >= threshold - 1e-9)
    if not len(able):
        return []
    stop = np.append(start[1:], len(terms))
    stop = np.where(np.append(ends[1:], False), np.append(stop[1:], len(terms)), stop)
    of, word = _spread(start[able], stop[able])
    known = terms[word] > 0
    width = len(index.most)
    key = np.unique(of[known] * width + terms[word[known]])
    passage, term = key // width, key % width
    order = np.lexsort((index.most[term], passage))
    passage, term = passage[order], term[order]
    start = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    size = np.diff(np.append(start, len(passage)))
    sums = np.cumsum(index.most[term])
    sums -= np.repeat(sums[start] - index.most[term[start]], size)
    pivoted = sums >= threshold - 1e-9
    cost = np.add.reduceat(index.first[term + 1] - index.first[term], start)
    # passages with a pivot, in groups of about as many entries
    own = np.flatnonzero(np.add.reduceat(pivoted, start))
    found: list[tuple[int, int, int, float]] = []
    for group in np.split(own, np.flatnonzero(np.diff(np.cumsum(cost[own]) // AT_ONCE)) + 1):
        if len(group):
            which, pair = _spread(start[group], start[group] + size[group])
            at = able[passage[start[group]]]
            found += [(int(doc[at[p]]), int(half[at[p]]), s, x) for p, s, x in _scored(index, len(group), which, term[pair], pivoted[pair], threshold)]
    return found


def _scored(index: Index, n: int, which: np.ndarray, term: np.ndarray, pivoted: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """(passage, segment, score) for n passages whose terms are (which passage, term, whether from the pivot on)."""
    n_blocks = len(index.items) // BLOCK + 1
    before = np.bincount(which[~pivoted], index.most[term[~pivoted]], n)
    pair, entry = _spread(index.first[term[pivoted]], index.first[term[pivoted] + 1])
    at, bound = _sums(which[pivoted][pair] * n_blocks + index.blocks[entry], index.bounds[entry])
    alive = bound + before[at // n_blocks] >= threshold - 1e-9
    at, bound = at[alive], bound[alive]
    if not len(at):
        return []
    # now the maxima in the block of the terms before the pivot: all their entries are gone through or looked up, whichever is less
    own, first = at // n_blocks, np.searchsorted(which, np.arange(n))
    others, entries = np.bincount(which[~pivoted], minlength=n), index.first[term + 1] - index.first[term]
    through = np.bincount(which[~pivoted], entries[~pivoted], n) <= np.bincount(own, minlength=n) * others
    some = ~pivoted & through[which]
    pair, entry = _spread(index.first[term[some]], index.first[term[some] + 1])
    wanted = which[some][pair] * n_blocks + index.blocks[entry]
    row = np.minimum(np.searchsorted(at, wanted), len(at) - 1)
    there = at[row] == wanted
    bound += np.bincount(row[there], index.bounds[entry[there]], len(at))
    rows = np.flatnonzero(~through[own])
    cand, entry = _entries(index, term, first[own[rows]], first[own[rows]] + others[own[rows]], at[rows] % n_blocks, n_blocks)
    bound += np.bincount(rows[cand], index.bounds[entry], len(at))
    at = at[bound >= threshold - 1e-9]
    own = at // n_blocks
    cand, entry = _entries(index, term, first[own], np.append(first, len(which))[own + 1], at % n_blocks, n_blocks)
    of, post = _spread(index.posts[entry], index.posts[entry + 1])
    key, score = _sums(own[cand[of]] * len(index.items) + index.segments[post], index.weights[post])
    hit = score >= threshold - 1e-9
    return list(zip((key[hit] // len(index.items)).tolist(), (key[hit] % len(index.items)).tolist(), score[hit].tolist(), strict=True))


def _entries(index: Index, term: np.ndarray, low: np.ndarray, high: np.ndarray, block: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(which row, entry) of the terms [low, high) in each row's block."""
    cand, pair = _spread(low, high)
    wanted = term[pair] * n_blocks + block[cand]
    entry = np.minimum(np.searchsorted(index.keys, wanted), len(index.keys) - 1)
    there = index.keys[entry] == wanted
    return cand[there], entry[there]


def verify(index: Index, segment: int, terms: np.ndarray) -> tuple[float, float, bool]:
    """Shares of the question's and the answer's trigrams in a passage (1 where there are none), and whether they suffice."""
    own, n = index.terms[segment], index.asked[segment]
    if index.short[segment]:
        starts = np.flatnonzero(terms[: len(terms) - len(own) + 1] == own[0]) if len(terms) >= len(own) else []
        found = any(np.array_equal(terms[i : i + len(own)], own) for i in starts)
        return float(found), float(found), found
    # numbered among the segment's own words, so that trigrams fit however many words the index has
    known = np.unique(own)
    at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
    terms = np.where(known[at] == terms, at + 1, 0)
    own = np.searchsorted(known, own) + 1
    size, inside = [], []
    for part in (own[:n], own[n:]):
        g = grams(part, min(3, len(part)))
        size.append(len(g))
        inside.append(int(np.isin(g, grams(terms, min(3, len(part)))).sum()) if len(g) else 0)
    sq, sa = (x / k if k else 1.0 for x, k in zip(inside, size, strict=True))
    alone = size[0] >= 10 and sq >= ALONE
    return sq, sa, alone or (sq >= QUESTION and sa >= ANSWER) or sum(inside) / max(1, sum(size)) >= ALL


def segments(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(sid, item_id, words, asked, short) of all items."""

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for item, text in zip(b["item_id"].to_pylist(), b["text"].to_pylist(), strict=True):
            cuts = segments_of(text)
            rows += [(item, words, asked, len(cuts) == 1 and len(words) < MIN_WORDS) for words, asked in cuts]
        kinds = (pa.int64(), pa.list_(pa.string()), pa.int32(), pa.bool_())
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["item_id", "words", "asked", "short"])

    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    return stored(map_batches(rows, cut, "item_id long, words array<string>, asked int, short boolean").withColumn("sid", F.monotonically_increasing_id()), "segments")


def weighed(cut: DataFrame) -> DataFrame:
    """(sid, w): each segment's words with their share of its BM25 weight, by the frequencies in all segments."""
    n, mean = cut.agg(F.count(F.lit(1)), F.avg(F.size("words"))).first()
    tf = cut.select("sid", F.size("words").alias("len"), F.explode("words").alias("word")).groupBy("sid", "len", "word").count()
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    own = tf.join(df, "word").select("sid", "word", (idf * F.col("count") * (K1 + 1) / (F.col("count") + K1 * (1 - B + B * F.col("len") / F.lit(mean)))).alias("x"))
    # summed in order of words, so that equal segments weigh alike to the last bit
    in_order = own.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("word", "x"))).alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda acc, e: acc + e["x"])
    return in_order.select("sid", F.transform("w", lambda e: F.struct(e["word"].alias("word"), (e["x"] / total).alias("x"))).alias("w"))


def _matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, part: int = PART, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The columns of matches(), and the matched text's hash."""
    spark = docs.sparkSession
    rows = id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))
    cut = segments(items, item_col, item_text)
    indexed = stored(cut.join(weighed(cut), "sid"), "index")
    n = max(1, -(-indexed.count() // part))
    schema = "doc_id long, item_id long, word_start int, score double, question_overlap double, answer_overlap double, text_hash long"
    found = []
    for k in range(n):
        # about ``part`` segments, all of an item, come to the driver and are broadcast at a time
        own = indexed.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id", "sid").toLocalIterator()
        cuts, weights = [], []
        for r in own:
            cuts.append((r["item_id"], r["words"], r["asked"], r["short"]))
            weights.append({e["word"]: e["x"] for e in r["w"]})
        index = spark.sparkContext.broadcast(build_index(cuts, weights))

        def query(b: pa.RecordBatch, index=index) -> pa.RecordBatch:
            ix, out = index.value, []
            docs, hashes = b["doc_id"].to_pylist(), b["text_hash"].to_pylist()
            lens, read, first = [], [], 0
            for k, text in enumerate(b["text"]):
                words = normal_words(text.as_py())
                lens.append(len(words))
                read.append(np.fromiter(map(ix.vocab.get, words, repeat(0)), np.int64, len(words)))
                if sum(lens) < WORDS_AT_ONCE and k + 1 < b.num_rows:
                    continue
                terms = np.concatenate(read)
                best: dict[tuple[int, int], tuple] = {}
                for d, p, s, score in retrieve(ix, terms, lens, threshold):
                    key = (d, int(ix.items[s]))
                    if key in best and (-score, p) >= (-best[key][3], best[key][2] // SEGMENT):
                        continue
                    sq, sa, ok = verify(ix, s, read[d][p * SEGMENT : (p + 2) * SEGMENT])
                    if ok:
                        best[key] = (docs[first + d], key[1], p * SEGMENT, score, sq, sa, hashes[first + d])
                out += best.values()
                lens, read, first = [], [], k + 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["doc_id", "item_id", "word_start", "score", "question_overlap", "answer_overlap", "text_hash"])

        found.append(map_batches(rows, query, schema))
    return reduce(DataFrame.unionByName, found)


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, part: int = PART, **cols: str) -> DataFrame:
    """(doc_id, item_id, word_start, score, question_overlap, answer_overlap): verified matches, the best passage for each row and item."""
    return _matches(docs, items, threshold, part, **cols).drop("text_hash")


def decontaminated(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """The documents without a match, all columns.  The matched ones are few and joined away by id and text, as ids may be null or repeated."""
    hit = _matches(docs, items, **kw).select(F.col("doc_id").alias("_hit"), F.col("text_hash").alias("_hash")).distinct()
    on = docs["doc_id"].cast("long").eqNullSafe(hit["_hit"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == hit["_hash"])
    return docs.join(hit, on, "left_anti")

"""Best-two-fit packing of tokenised documents into sequences of bounded length.

1.  ``tokenize_pieces`` turns each document into token ids plus a final separator and cuts those
    above the limit into pieces.
2.  ``pack_pieces`` deals the pieces by a hash into buckets of about ``BUCKET`` pieces and packs each
    bucket by itself: a bin is filled greedily with the largest piece that fits, then its smallest
    piece is replaced by two unpacked ones that fill the widened gap better.  A bucket holds a count
    for each length, so it needs memory for its own rows only, and equal bins are made in one step.
    Each bucket leaves at most a few bins partly filled, among thousands.
3.  ``sequences`` puts packed pieces that carry their ids together into the packed id arrays.

Defined results: a null or empty text is the separator alone; repeated rows are packed as often as they
come; an empty table gives no rows; a null id is packed like any other.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import id_and_text, map_batches

LIMIT = 2048
#: Documents dealt to one bucket on average.
BUCKET = 32768
#: Words whose ids a worker remembers at most, before those not used since as many others are forgotten.
REMEMBERED = 200_000

_state: dict[str, list] = {}
_word_by_word: dict[str, bool] = {}
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
#: Byte-level characters of the bytes that aren't printable in Latin-1; all others stand for themselves.
_BYTES = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
_SIGNS = re.compile(r"([a-zß-öø-ÿ])(?=[^\w\s])")


def _encoder(path: str) -> list:
    """[tokenizer, words remembered of late, words remembered before] of this worker; a word's ids are little-endian bytes."""
    if path not in _state:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        _state[path] = [tok, {}, {}]
        _word_by_word[path] = word_by_word(json.loads(tok.to_str()))
    return _state[path]


def word_by_word(tokenizer: dict) -> bool:
    """Whether a tokenizer lowers letters, drops white space and ends words, so that a text's ids are those of its words."""
    steps = lambda part: (part or {}).get("normalizers") or (part or {}).get("pretokenizers") or [part or {}]
    lowers = any(n.get("type") == "Lowercase" for n in steps(tokenizer["normalizer"]))
    first = steps(tokenizer["pre_tokenizer"])[0]
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
    return lowers and drops and bool(tokenizer["model"].get("end_of_word_suffix"))


def _ids(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _split(text: str) -> list[str]:
    """Parts of a text whose ids, one after the other, are the text's.

    White space separates words for this tokenizer and leaves no id, and a run of letters always ends a token, so signs that
    follow one may be split off.  In Latin-1 lower case changes nothing either, as the tokenizer lowers letters one by one; a
    text that may spell a special token, or has other characters (which could compose), keeps its case.
    """
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split breaks at these, the tokenizer does not drop them
        return text.replace("\t", " ").replace("\n", " ").split(" ")
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.split()
    return text.split() if "<|" in text else _SIGNS.sub(r"\1 ", text.lower()).split()


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text, four bytes each.  Each word is encoded once for as long as it is remembered; other tokenizers get whole texts."""
    state = _encoder(path)
    if not _word_by_word[path]:
        return [_ids(state[0].encode(t, add_special_tokens=False).ids) for t in texts]
    split = [_split(t) for t in texts]
    need = set().union(*split)
    if len(state[1]) + len(need) > REMEMBERED and state[1]:
        state[1:] = [{}, state[1]]
    tok, known, old = state
    new = need.difference(known)
    again = new.intersection(old)
    known.update((w, old[w]) for w in again)
    fresh = list(new - again)
    # one run of lower-case letters is one token to the pre-tokenizer, and its bytes go straight to the model
    model = tok.model.tokenize
    for w in fresh:
        if _LETTERS.fullmatch(w):
            known[w] = _ids([t.id for t in model(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES))])
    others = [w for w in fresh if w not in known]
    for at in range(0, len(others), 20_000):
        part = others[at : at + 20_000]
        for w, e in zip(part, tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
            known[w] = _ids(e.ids)
    get = known.__getitem__
    return [b"".join(map(get, ws)) for ws in split]


def tokenize_pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): ids are unsigned 32-bit little-endian bytes."""
    end = np.array([separator], "<u4").tobytes()

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for doc, ids in zip(b["doc_id"].to_pylist(), encode_texts(b["text"].to_pylist(), tokenizer), strict=True):
            ids += end
            n = len(ids) // 4
            for k, at in enumerate(range(0, n, limit)):
                size = min(limit, n - at)
                for col, v in zip(out, (doc, k, at, size, ids if size == n else ids[4 * at : 4 * (at + size)]), strict=True):
                    col.append(v)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.record_batch([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

    return map_batches(id_and_text(docs, id_col, text_col), cut, "doc_id long, piece int, start long, length long, ids binary")


def _largest(mask: int, most: int) -> int:
    """The largest available length of at most ``most``; 0 if there is none."""
    return (mask & ((1 << (most + 1)) - 1)).bit_length() - 1 if mask & ((1 << (most + 1)) - 2) else 0


def best_two_fit(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how many such bins) for the given count of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    mask, back = 0, 0  # bit n, and bit limit - n, where length n is left
    for n in left:
        mask |= 1 << n
        back |= 1 << (limit - n)

    def take(n: int, k: int = 1) -> None:
        nonlocal mask, back
        left[n] -= k
        if not left[n]:
            mask ^= 1 << n
            back ^= 1 << (limit - n)

    def give(n: int) -> None:
        nonlocal mask, back
        left[n] += 1
        mask |= 1 << n
        back |= 1 << (limit - n)

    bins = []
    while mask:
        gap, items = limit, []
        while gap and (n := _largest(mask, gap)):
            items.append(n)
            take(n)
            gap -= n
        if gap and mask:
            small = items[-1]
            wide = gap + small
            for total in range(wide, small, -1):
                # lengths n with n and total - n both left
                if pair := mask & (back >> (limit - total)) & ((1 << (total // 2 + 1)) - 2):
                    if not total % 2 and pair == 1 << (total // 2) and left[total // 2] < 2:
                        continue
                    a = pair.bit_length() - 1
                    if 2 * a == total and left[a] < 2:
                        a = (pair ^ (1 << a)).bit_length() - 1
                    items.pop()
                    take(a)
                    take(total - a)
                    give(small)
                    items += [total - a, a]
                    break
        times: dict[int, int] = {}
        for n in items:
            times[n] = times.get(n, 0) + 1
        more = min(left[n] // k for n, k in times.items())
        if more:
            for n, k in times.items():
                take(n, more * k)
        bins.append((items, 1 + more))
    return bins


def place(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number from 0, offset) of each piece."""
    values, counts = np.unique(lengths, return_counts=True)
    order = np.argsort(lengths, kind="stable")
    starts = dict(zip(values.tolist(), (np.cumsum(counts) - counts).tolist(), strict=True))
    seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    nxt = 0
    for items, k in best_two_fit(dict(zip(values.tolist(), counts.tolist(), strict=True)), limit):
        at = 0
        for n in items:
            rows = order[starts[n] : starts[n] + k]
            starts[n] += k
            seq[rows] = np.arange(nxt, nxt + k)
            off[rows] = at
            at += n
        nxt += k
    return seq, off


def pack_pieces(pieces: DataFrame, n_pieces: int, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, and further columns).

    ``n_pieces`` is their number, or that of their documents; it only sets how many buckets there are.
    """
    buckets = max(1, -(-n_pieces // bucket))
    told = [c for c in pieces.columns if c != "ids"]
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "piece"], kind="stable", ignore_index=True)
        seq, off = place(part["length"].to_numpy(), limit)
        part = part.drop(columns="_bucket")
        part["sequence_id"] = seq + (int(key[0]) << 32)
        part["offset"] = off
        return part

    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*told), F.lit(buckets)).cast("int"))
    return dealt.groupBy("_bucket").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """The packing plan: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    pieces = tokenize_pieces(docs, tokenizer, limit).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack_pieces(pieces, docs.count(), limit, bucket)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed id arrays, from packed pieces with a column ids.  Each row is placed by itself, whatever its id."""
    in_order = F.sort_array(F.collect_list(F.struct("offset", "ids")))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int32) for parts in b["parts"].to_pylist()]
            yield pa.record_batch([b["sequence_id"], pa.array(ids, pa.list_(pa.int32()))], names=["sequence_id", "ids"])

    return packed.groupBy("sequence_id").agg(in_order.alias("parts")).mapInArrow(unpack, "sequence_id long, ids array<int>")

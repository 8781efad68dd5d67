"""Token ids in Arrow files: fixed-size lists of equal-length sequences and masks, read in place.

A data set is a folder.  Its documents, in ascending order of id, are one run of token ids, dealt over files in that order.
Each file ``part-N-….arrow`` is in the Arrow file format; its batches hold the columns ``ids`` (fixed-size list of ``length`` ids,
two bytes each where the vocabulary allows, else four) and ``mask`` (fixed-size list of bits: whether there is an id).  Only the
last sequence of a file is padded, with id 0 and mask false.  Every batch but the last holds ``BATCH`` sequences, so that the
place of any sequence or document follows by division, and a memory map gives it without a copy.  Beside it,
``part-N-….docs.arrow`` tells each document's place.  ``manifest.json`` lists the files that count, with the number of ids before each.

Files are written by a data source.  Tasks write under names of their own, and the driver writes the manifest when all are done: what
a lost executor, a repeated task or a second job leaves behind is in no manifest, and an abandoned write removes its files.

Defined results: a null or empty text is the end id alone; null ids come first; repeated ids stay in the order of the table read;
an empty table gives a manifest without files and reads as no rows.  A document's ids are held in memory whole, a file's are not.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import id_and_text, map_batches, shared_dir
from .packing import _BYTES

LENGTH = 2048
#: Sequences in a batch of a file.
BATCH = 256
#: Chunks whose ids a worker remembers at most, before those not used since as many others are forgotten.
REMEMBERED = 400_000
#: Characters that a worker splits into chunks at once, beyond those of one text.
AT_ONCE = 1_000_000
MANIFEST = "manifest.json"

_state: dict[str, list] = {}


def _encoder(path: str) -> list:
    """[tokenizer, chunks remembered, type of an id, whether it splits as _chunks does]"""
    if path not in _state:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        kind = id_type(path)
        _state[path] = [tok, _Known(tok, kind, {}), kind, splits_at_spaces(json.loads(tok.to_str()))]
    return _state[path]


def id_type(path: str) -> str:
    """The type of an id in the files: two bytes if the vocabulary allows, else four."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def splits_at_spaces(tokenizer: dict) -> bool:
    """Whether a text's ids are those of its chunks: byte-level tokens that take up one space before them, and no normalizer."""
    first = tokenizer["pre_tokenizer"] or {}
    return tokenizer["normalizer"] is None and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")


_WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_BREAK = re.compile(r"(?= \S)")


class _Odd(Exception):
    """A text has white space after a space, or a space at its end."""


def _chunks(text: str) -> list[str]:
    """Parts of a text whose ids, one after the other, are the text's: a new one begins at each space before something other than white space.

    The tokenizer's pattern gives such a space to the token that follows.  A text that may spell a special token is one chunk.
    """
    return [text] if "<|" in text else _BREAK.split(text)


def _ids(ids: list[int], kind: str) -> bytes:
    out = array("H" if kind == "<u2" else "I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Known(dict):
    """Ids of chunks, found when they are first asked for.

    The key of a chunk is what follows its space; that of a chunk without one, as at the start of a text, is the chunk behind a space.  The
    tokenizer's pattern makes one token of a run of letters with the space before it, and another of the signs behind it; their
    bytes, written as it writes them, go straight to its model.  All other chunks go through the whole tokenizer.
    """

    def __init__(self, tok, kind: str, old: dict[str, bytes]):
        super().__init__()
        self.tok, self.model, self.kind, self.old = tok, tok.model.tokenize, kind, old

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            chunk = key[1:] if key[:1] == " " else " " + key
            if m := _WORD.fullmatch(chunk):
                ids = self._piece(m[1]) + self._piece(m[2]) if m[2] else self._model(chunk)
            elif key[:1] != " " and not key[:1].strip():
                raise _Odd
            else:
                ids = _ids(self.tok.encode(chunk, add_special_tokens=False).ids, self.kind)
        self[key] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        key = piece[1:] if piece[0] == " " else " " + piece
        if key not in self:
            self[key] = self._model(piece)
        return self[key]

    def _model(self, piece: str) -> bytes:
        spelled = piece.replace(" ", "Ġ") if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)
        return _ids([t.id for t in self.model(spelled)], self.kind)


def encode_texts(texts: list[str], path: str, end: int = 0) -> list[bytes]:
    """Ids of each text and the end id, in the type of the files.  A chunk is encoded once for as long as it is remembered."""
    state = _encoder(path)
    tok, known, kind, splits = state
    last = _ids([end], kind)
    if not splits:
        return [_ids(e.ids, kind) + last for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    out = []
    for text in texts:
        if len(known) > REMEMBERED:
            known.old = {}
            known = state[1] = _Known(tok, kind, known)
        get = known.__getitem__
        if "<|" not in text:
            keys = text.split(" ")
            keys[0] = " " + keys[0]
            try:
                out.append(b"".join(map(get, keys)) + last)
                continue
            except _Odd:
                pass
        first, *rest = _chunks(text)
        out.append(b"".join([get(" " + first), *(get(c[1:]) for c in rest)]) + last)
    return out


def encoded(docs: DataFrame, tokenizer: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) in ascending order of doc_id, dealt over partitions by ranges: ids are bytes in the type of the files."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, some, held = [], [], 0
        for k, text in enumerate(b["text"]):
            some.append(text.as_py())
            held += len(some[-1])
            # a chunk of a text is an object of its own, so not too many texts are split at once
            if held > AT_ONCE or k == b.num_rows - 1:
                ids += encode_texts(some, tokenizer, end)
                some, held = [], 0
        return pa.record_batch([b["doc_id"], pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    # rows of one id are told apart, so that many of them can be dealt over several partitions
    rows = id_and_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    return map_batches(ordered.select("doc_id", "text"), run, "doc_id long, ids binary")


# ---------------------------------------------------------------- files


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _opened(path: str) -> tuple[pa.NativeFile, pa.ipc.RecordBatchFileReader]:
    fs, at = _place(path)
    source = pa.memory_map(at) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(at)
    return source, pa.ipc.open_file(source)


class SequenceFile:
    """Random access to one file's sequences and ids; arrays are views of the file where it can be mapped into memory."""

    def __init__(self, path: str):
        self._source, self._file = _opened(path)
        self.length = self._file.schema.field("ids").type.list_size
        self.kind = np.dtype(self._file.schema.field("ids").type.value_type.to_pandas_dtype()).newbyteorder("<")

    def __enter__(self) -> SequenceFile:
        return self

    def __exit__(self, *_) -> None:
        self._source.close()

    def _batch(self, k: int) -> pa.RecordBatch:
        return self._file.get_batch(k)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of the i-th sequence."""
        b, at = self._batch(i // BATCH), (i % BATCH) * self.length
        return b["ids"].flatten().slice(at, self.length).to_numpy(), b["mask"].flatten().slice(at, self.length)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n ids from a place on; a view unless they lie in several batches."""
        size, parts = BATCH * self.length, []
        while n > 0:
            k, at = divmod(start, size)
            got = self._batch(k)["ids"].flatten().slice(at, n).to_numpy()
            parts.append(got)
            start, n = start + len(got), n - len(got)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, self.kind)


@dataclass
class Written(WriterCommitMessage):
    """One task's file: its place in the order of tasks, name, and what it holds."""

    task: int
    name: str
    documents: int
    tokens: int


class SequenceWriter(DataSourceArrowWriter):
    def __init__(self, path: str, length: int, kind: str, overwrite: bool):
        self.path, self.length, self.kind, self.overwrite = path, length, kind, overwrite
        fs, at = _place(path)
        fs.create_dir(at, recursive=True)
        if not overwrite and fs.get_file_info(f"{at}/{MANIFEST}").type != pafs.FileType.NotFound:
            raise FileExistsError(f"{path} has a manifest; use mode overwrite")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get().partitionId()
        name = f"part-{task:05d}-{uuid.uuid4().hex}"
        fs, at = _place(f"{self.path}/{name}")
        ids_type = pa.from_numpy_dtype(np.dtype(self.kind).newbyteorder("="))
        schema = pa.schema([("ids", pa.list_(ids_type, self.length)), ("mask", pa.list_(pa.bool_(), self.length))])
        index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        held, n_held, tokens, documents = [], 0, 0, 0
        full = BATCH * self.length
        with fs.open_output_stream(f"{at}.arrow") as out, fs.open_output_stream(f"{at}.docs.arrow") as told:
            with pa.ipc.new_file(out, schema) as sequences, pa.ipc.new_file(told, index) as places:

                def put(ids: np.ndarray) -> None:
                    rows = -(-len(ids) // self.length)
                    mask = np.arange(rows * self.length) < len(ids)
                    padded = np.concatenate([ids, np.zeros(len(mask) - len(ids), ids.dtype)])
                    lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, mask)]
                    sequences.write_batch(pa.record_batch(lists, schema=schema))

                for b in iterator:
                    sizes = []
                    for ids in b["ids"]:
                        one = np.frombuffer(ids.as_buffer(), self.kind).astype(np.dtype(self.kind).newbyteorder("="), copy=False)
                        sizes.append(len(one))
                        held.append(one)
                        n_held += len(one)
                        if n_held >= full:
                            ready = np.concatenate(held)
                            for k in range(0, n_held - full + 1, full):
                                put(ready[k : k + full])
                            held = [ready[n_held - n_held % full :].copy()]
                            n_held %= full
                    ends = tokens + np.cumsum(sizes, dtype=np.int64)
                    places.write_batch(pa.record_batch([b["doc_id"], pa.array(ends - sizes), pa.array(sizes, pa.int64())], schema=index))
                    documents += b.num_rows
                    tokens = int(ends[-1]) if len(ends) else tokens
                if n_held:
                    put(np.concatenate(held))
        return Written(task, name, documents, tokens)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = _place(self.path)
        if not self.overwrite and fs.get_file_info(f"{at}/{MANIFEST}").type != pafs.FileType.NotFound:
            raise FileExistsError(f"{self.path} was written by another job meanwhile")
        start, files = 0, []
        for m in sorted((m for m in messages if m and m.documents), key=lambda m: m.task):
            files.append({"name": m.name, "start": start, "documents": m.documents, "tokens": m.tokens})
            start += m.tokens
        with fs.open_output_stream(f"{at}/{MANIFEST}.new") as out:
            out.write(json.dumps({"length": self.length, "type": self.kind, "tokens": start, "files": files}).encode())
        fs.move(f"{at}/{MANIFEST}.new", f"{at}/{MANIFEST}")
        keep = {f["name"] for f in files}
        for f in fs.get_file_info(pafs.FileSelector(at)):
            if re.match(r"part-[0-9]+-[0-9a-f]+\.", f.base_name) and f.base_name.split(".")[0] not in keep:
                fs.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = _place(self.path)
        for m in messages:
            for end in (".arrow", ".docs.arrow") if m else ():
                if fs.get_file_info(f"{at}/{m.name}{end}").type != pafs.FileType.NotFound:
                    fs.delete_file(f"{at}/{m.name}{end}")


@dataclass
class Part(InputPartition):
    name: str
    start: int


class SequenceReader(DataSourceReader):
    """A partition for each file of the manifest."""

    def __init__(self, path: str, view: str):
        self.path, self.view = path, view

    def partitions(self) -> list[Part]:
        return [Part(f["name"], f["start"]) for f in manifest(self.path)["files"]] or [Part("", 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        with SequenceFile(f"{self.path}/{partition.name}.arrow") as f:
            yield from self._sequences(f, partition) if self.view == "sequences" else self._documents(f, partition)

    def _sequences(self, f: SequenceFile, part: Part) -> Iterator[pa.RecordBatch]:
        for k in range(f._file.num_record_batches):
            b = f._batch(k)
            first = part.start + (k * BATCH + np.arange(b.num_rows)) * f.length
            ids = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * f.length), b["ids"].flatten().cast(pa.int32()))
            mask = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * f.length), b["mask"].flatten())
            yield pa.record_batch([pa.array(first), ids, mask], names=["start", "ids", "mask"])

    def _documents(self, f: SequenceFile, part: Part) -> Iterator[pa.RecordBatch]:
        source, places = _opened(f"{self.path}/{part.name}.docs.arrow")
        with source:
            for k in range(places.num_record_batches):
                b = places.get_batch(k)
                for at in range(0, b.num_rows, 256):
                    some = b.slice(at, 256)
                    ids = [f.tokens(s, n).astype("<u4").tobytes() for s, n in zip(some["start"].to_pylist(), some["n_tokens"].to_pylist(), strict=True)]
                    start = pa.array(some["start"].to_numpy() + part.start)
                    yield pa.record_batch([some["doc_id"], start, some["n_tokens"], pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


class TokenFiles(DataSource):
    """``format("token_files")``.  Writes (doc_id, ids), in their order; reads documents, or sequences with the option view = sequences."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return "start long, ids array<int>, mask array<boolean>" if self.options.get("view") == "sequences" else "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema: StructType) -> SequenceReader:
        return SequenceReader(self.options["path"], self.options.get("view", "documents"))

    def writer(self, schema: StructType, overwrite: bool) -> SequenceWriter:
        return SequenceWriter(self.options["path"], int(self.options.get("length", LENGTH)), self.options.get("type", "<u2"), overwrite)


def manifest(path: str) -> dict:
    fs, at = _place(f"{path}/{MANIFEST}")
    with fs.open_input_stream(at) as f:
        return json.loads(f.read())


def write_tokens(docs: DataFrame, tokenizer: str, path: str, length: int = LENGTH, end: int = 0) -> None:
    """Encode documents and write them as a data set, in ascending order of id."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    options = {"length": str(length), "type": id_type(tokenizer)}
    encoded(docs, tokenizer, end).write.format("token_files").options(**options).mode("append").save(path)


def read_tokens(spark: SparkSession, path: str, view: str = "documents") -> DataFrame:
    """Documents (doc_id, start, n_tokens, ids as little-endian 32-bit integers), or sequences (start, ids, mask)."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").option("view", view).load(path)


def new_folder(spark: SparkSession) -> str:
    """A place for a data set in the shared folder; Hadoop deletes it when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/docveil/tokens-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path

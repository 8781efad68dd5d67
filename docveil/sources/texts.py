"""Text files: encodings in and out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession

from ..functions.udf import arrow_function


def decode_text(b: bytes) -> tuple[str, str]:
    """(text, encoding): by byte-order mark, else UTF-8 if it is valid, else Windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if b.startswith(mark):
            return b[len(mark) :].decode(name.replace("-sig", ""), "replace"), name
    try:
        return b.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        return b.decode("cp1252", "replace"), "windows-1252"


def encode_text(text: str, encoding: str) -> bytes:
    """Bytes in the encoding a file had; Windows-1252 becomes UTF-8 with a mark, so that no character is lost."""
    if encoding in ("utf-16-le", "utf-16-be"):
        return (b"\xff\xfe" if encoding.endswith("le") else b"\xfe\xff") + text.encode(encoding, "surrogatepass")
    return (b"\xef\xbb\xbf" if encoding in ("utf-8-sig", "windows-1252") else b"") + text.encode("utf-8", "surrogatepass")


@arrow_function("struct<text:string,encoding:string>")
def _decoded(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_text(bytes(b or b"")) for b in content], columns=["text", "encoding"])


@arrow_function("binary")
def _encoded(text: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([encode_text(t, e) if t is not None else None for t, e in zip(text, encoding, strict=True)])


def decoded(content: Column) -> Column:
    return _decoded(content)


def encoded(text: Column, encoding: Column) -> Column:
    return _encoded(text, encoding)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, encoding) of the text files in a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md,csv}").load(path)
    return df.select("path", _decoded("content").alias("d")).select("path", "d.text", "d.encoding")

"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

encode() adds ids and the byte and character offset of each token; decode() turns ids back into bytes through the
vocabulary's byte table, so tokens that split a character are put together again. No shuffle: both are maps over batches, of
about 1 MB of text (or one text) at a time, and texts of any length are encoded whole.

Null texts count as empty and give no tokens. Null lists of ids decode to an empty text; null ids in a list and ids that
aren't in the vocabulary (negative ones too) stand for no bytes. Repeated rows are encoded each. Other columns pass through as
they are; those with an added column's name, in any case, are replaced."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from stratalog.llm.bpe_cache import PartCache, PieceEncoder, byte_characters
from stratalog.llm.common import slices, table

VOCABULARY = "byte_bpe_50k.json"
#: Entries of a worker's memos.
PARTS, PIECES = 600_000, 600_000
_ODD_SPACE = regex.compile(r" \s|\s ")


@functools.cache
def byte_table(path: str) -> list[bytes]:
    """The bytes of each id, from the vocabulary file alone; special tokens stand for their names."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    bytes_of = {c: b for b, c in enumerate(byte_characters())}
    special = {t["id"]: t["content"].encode() for t in file["added_tokens"]}
    tokens = {i: bytes(map(bytes_of.__getitem__, t)) for t, i in file["model"]["vocab"].items() if i not in special} | special
    return [tokens.get(i, b"") for i in range(max(tokens) + 1)]


class ByteBpe:
    """One tokenizer; special tokens in a text are ordinary text."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.table = byte_table(path)
        self.sizes = np.array([len(t) for t in self.table], np.int64)
        pieces = PieceEncoder(self.tokenizer, public_tokenizers.PATTERN, entries=PIECES)
        self.pieces, self.parts = pieces, PartCache(lambda p: pieces.part(" " + p), entries=PARTS)

    def ids(self, text: str) -> np.ndarray:
        """A single space between two non-space characters always starts a match of the pattern, so the text can be cut
        there; where other white space touches a space, the whole text is encoded as one part."""
        if _ODD_SPACE.search(text) or text[:1] == " " or text[-1:] == " ":
            packed = self.pieces.part(text)
        else:
            first, *rest = text.split(" ")
            packed = (self.pieces.part(first) if first else b"") + self.parts.pack(rest)
        return np.frombuffer(packed, "<u4").astype(np.int32)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def offsets(self, ids: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start of each token in bytes, and the index of the character that holds that byte."""
        starts = np.concatenate([[0], np.cumsum(self.sizes[ids])])[:-1]
        characters = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1
        return starts.astype(np.int32), characters[starts].astype(np.int32) if len(starts) else starts.astype(np.int32)

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it can be shown token by token: a character split over tokens comes with its last one."""
        import codecs

        more = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield more.decode(self.table[i])
        if last := more.decode(b"", True):
            yield last


@functools.cache
def tokenizer(path: str) -> ByteBpe:
    """One per worker process."""
    return ByteBpe(path)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, offsets: bool = True, decoded: str | None = None) -> DataFrame:
    """df's columns (or those in keep) with token_ids and, if asked for, token_bytes and token_chars: where each token starts.
    decoded: also a column of that name with the bytes that the ids stand for, from the same worker. Input columns of these
    names are replaced."""
    lists = ["token_ids", *(["token_bytes", "token_chars"] if offsets else [])]
    added = [*lists, *([decoded] if decoded else [])]
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in map(str.lower, added)]
    fields = [*(T.StructField(c, T.ArrayType(T.IntegerType())) for c in lists), *([T.StructField(decoded, T.BinaryType())] if decoded else [])]
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for whole in batches:
            for batch, texts in slices(whole, text):
                ids = [bpe.ids(t.decode()) for t in texts]
                more = [_lists(ids)]
                if offsets:
                    more += map(_lists, zip(*(bpe.offsets(i, t) for i, t in zip(ids, texts, strict=True)), strict=True))
                if decoded:
                    more.append(pa.array([bpe.decode(i.tolist()) for i in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *more], names=[*keep, *added])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that the ids stand for."""
    schema = T.StructType([*(f for f in df.schema if f.name.lower() != out.lower()), T.StructField(out, T.BinaryType())])
    keep = [c for c in df.columns if c.lower() != out.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = dict(enumerate(byte_table(path)))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [b"".join([pieces.get(i, b"") for i in x or ()]) for x in batch.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.binary())], names=[*keep, out])

    return df.mapInArrow(run, schema)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded bytes of every row of documents; also a hash of where the
    tokens start in bytes and in characters."""
    path = public_tokenizers.path(VOCABULARY)
    df = encode(table(spark, sf_dir, "documents"), path, keep=["doc_id"], decoded="decoded")
    return df.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.xxhash64("token_bytes").alias("byte_offsets_xxh64"),
        F.xxhash64("token_chars").alias("char_offsets_xxh64"),
    )

"""Sequence packing as vector bin packing under limits on tokens, segments and loss-bearing tokens.

Examples wait in a bounded pool; an open sequence takes the one whose demand vector has the largest dot product with what
the sequence has left of each limit. When none fits whole, the best one is cut where cutting is allowed. A sequence that can't be
filled is cut into power-of-two ones, which need no padding. Each task packs its own rows: no shuffle, and a sequence
number holds the task's partition, so numbers are unique and a task that runs again gives the same ones.

Null and empty texts are documents of one token (the end id); repeated rows are packed each; documents of any length
are cut into whole sequences first, so a long one never waits in the pool. Only the columns named are read; a key whose
name, in any case, is that of an output column comes out with an underscore before it."""

from __future__ import annotations

import functools
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratalog.llm.bpe_cache import PartCache, PieceEncoder
from stratalog.llm.common import freeing, same_name, slices, table

VOCABULARY = "word_bpe_49k.json"
#: The tokenizer's own pattern, on normalised text without white space.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = np.array([1], "<u4").tobytes()
#: Entries of the memos of a worker, which other operators' tables share memory with.
PARTS, PIECES = 300_000, 150_000


class WordBpe:
    """The tokenizer drops white space and never joins across it: a text's ids are those of its words, one after another."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.pieces = PieceEncoder(self.tokenizer, _PATTERN, lambda s: unicodedata.normalize("NFC", s).lower(), PIECES)
        part = self.pieces.part
        self.parts = PartCache(lambda w: part(w.decode()), PARTS)

    def pack(self, text: bytes) -> bytes:
        """Upper case goes from whole texts at once, so that fewer spellings are remembered: normalising first would give
        another result only where an ASCII letter and a combining mark (U+0300 to U+036F, first byte 0xCC or 0xCD) compose."""
        if b"\xcc" not in text and b"\xcd" not in text:
            text = text.lower()
        return self.parts.pack(text.split())


@functools.cache
def words_tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


@dataclass(frozen=True)
class Limits:
    """Of one sequence."""

    tokens: int = 2048
    segments: int = 512
    loss: int = 2048


class Packer:
    """Places examples (tokens, loss-bearing tokens); emits (example, start, length, sequence, offset).

    Loss-bearing tokens are counted as the last ones of an example, as in a prompt with its answer."""

    def __init__(self, limits: Limits, pool: int = 2048, cut: bool = True):
        if min(limits.tokens, limits.segments, limits.loss) < 1:
            raise ValueError("limits must be positive")
        self.limits, self.pool, self.cut = limits, pool, cut
        self.waiting: list[tuple] = []  # (example, start, tokens left, loss-bearing tokens left)
        self.next = 0

    def add(self, example, tokens: int, loss: int) -> Iterator[tuple]:
        """Pieces that are placed by now."""
        if tokens < 1 or not 0 <= loss <= tokens:
            raise ValueError("an example has tokens, and no more loss-bearing ones than that")
        most, start = self.limits, 0
        if not self.cut and (tokens > most.tokens or loss > most.loss):
            raise ValueError("an example is over the limits and cutting isn't allowed")
        while tokens >= most.tokens and self.cut:
            size = self._fits(tokens, loss, most.tokens, most.loss)
            if size < most.tokens:
                break
            yield example, start, size, self._new(), 0
            start, tokens, loss = start + size, tokens - size, min(loss, tokens - size)
        if tokens:
            self.waiting.append((example, start, tokens, loss))
        if len(self.waiting) >= self.pool:
            yield from self._fill(self.pool // 2)

    def end(self) -> Iterator[tuple]:
        yield from self._fill(0)

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    @staticmethod
    def _fits(tokens: int, loss: int, room: int, loss_room: int) -> int:
        """The longest first part within both rooms: what comes before the loss-bearing tokens is free of loss."""
        return min(tokens, room, tokens - loss + loss_room)

    def _fill(self, until: int) -> Iterator[tuple]:
        """Fills sequences until so few examples wait. Demands are shares of the limits."""
        most = self.limits
        n = len(self.waiting)
        size = np.array([w[2] for w in self.waiting], np.int64)
        loss = np.array([w[3] for w in self.waiting], np.int64)
        there, left = np.ones(n, bool), n
        demand = np.stack([size / most.tokens, np.full(n, 1 / most.segments), loss / most.loss])
        cuts: dict[int, int] = {}
        while left > until:
            inside: list[tuple[int, int, int]] = []
            room, segments, loss_room = most.tokens, most.segments, most.loss
            while room and segments and left:
                score = np.array([room / most.tokens, segments / most.segments, loss_room / most.loss]) @ demand
                whole = there & (size <= room) & (loss <= loss_room)
                i = int(np.argmax(np.where(whole, score, -1.0)))
                if whole[i]:
                    inside.append((i, cuts.get(i, self.waiting[i][1]), int(size[i])))
                    room, loss_room, left = room - int(size[i]), loss_room - int(loss[i]), left - 1
                    there[i] = False
                else:
                    if not self.cut:
                        break
                    i = int(np.argmax(np.where(there, score, -1.0)))
                    part = self._fits(int(size[i]), int(loss[i]), room, loss_room)
                    if part < 1:
                        break
                    start = cuts.get(i, self.waiting[i][1])
                    inside.append((i, start, part))
                    rest = int(size[i]) - part
                    used = int(loss[i]) - min(int(loss[i]), rest)
                    cuts[i], size[i], loss[i] = start + part, rest, int(loss[i]) - used
                    demand[0, i], demand[2, i] = size[i] / most.tokens, loss[i] / most.loss
                    room, loss_room = room - part, loss_room - used
                segments -= 1
            yield from self._close(inside)
        self.waiting = [(w[0], cuts.get(i, w[1]), int(size[i]), int(loss[i])) for i, w in enumerate(self.waiting) if there[i]]

    def _close(self, inside: list[tuple[int, int, int]]) -> Iterator[tuple]:
        """One sequence, or power-of-two ones if it isn't full and may be cut."""
        total = sum(x[2] for x in inside)
        if not self.cut or total == self.limits.tokens:
            sizes = [total]
        else:
            sizes = [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        at = iter(inside)
        i, start, size = next(at)
        for room in sizes:
            sequence, offset = self._new(), 0
            while offset < room:
                if not size:
                    i, start, size = next(at)
                part = min(size, room - offset)
                yield self.waiting[i][0], start, part, sequence, offset
                start, size, offset = start + part, size - part, offset + part


def pack(df: DataFrame, path: str, limits: Limits = Limits(), key: str = "doc_id", text: str = "text", answer: str | None = None, ids: bool = False) -> DataFrame:
    """One row per piece of a document: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for,
    token_ids. Without an answer column every token bears loss (plain documents); with one, an example is the text, then the
    answer and the end id, and only these last bear loss, up to the limit of a sequence (instruction data)."""
    numbers = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    name = f"_{key}" if key.lower() in [*numbers, "token_ids"] else key
    names = [name, *numbers, *(["token_ids"] if ids else [])]
    kind = df.schema[same_name(df.columns, key)].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = words_tokenizer(path), Packer(limits)
        base = TaskContext.get().partitionId() << 40
        keys_type = None

        def rows(pieces: Iterator[tuple]) -> pa.RecordBatch:
            out: list[list] = [[] for _ in names]
            for (k, packed), start, length, sequence, offset in pieces:
                part = memoryview(packed)[4 * start : 4 * (start + length)]
                more = [np.frombuffer(part, "<u4").astype(np.int32)] if ids else []
                for column, value in zip(out, (k, start, length, zlib.crc32(part), len(packed) // 4, base + sequence, offset, *more), strict=True):
                    column.append(value)
            columns = [pa.array(out[0], keys_type), *(pa.array(x, pa.int64()) for x in out[1:7])]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.list_(pa.int32())) for x in out[7:])], names=names)

        def examples(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[tuple]:
            answers = batch.column("answer").to_pylist() if answer else [None] * len(texts)
            for k, t, said in zip(batch.column("k").to_pylist(), texts, answers, strict=True):
                first = bpe.pack(t)
                last = (bpe.pack(said.encode()) if said else b"") + END
                loss = len(last) // 4 if answer else (len(first) + len(last)) // 4
                yield (k, first + last), (len(first) + len(last)) // 4, loss

        for whole in batches:
            keys_type = whole.schema.field("k").type
            for batch, texts in slices(whole, "text"):
                yield rows(x for e in examples(batch, texts) for x in packer.add(*e))
        if keys_type is not None:
            yield rows(packer.end())

    read = df.select(F.col(key).alias("k"), F.col(text).alias("text"), *([F.col(answer).alias("answer")] if answer else []))
    return read.mapInArrow(freeing(run), f"`{name}` {kind}, " + ", ".join(f"`{n}` long" for n in numbers) + (", token_ids array<int>" if ids else ""))


def turns(conversations: DataFrame) -> DataFrame:
    """key (conv_id:turn), prompt and answer of each assistant turn of (conv_id, turn, role, text): the prompt is the turn with
    the number before it, if another role has it (the first of several by text), else empty; null texts count as empty, rows
    without a conversation or turn go. An equi-join on both numbers, so a long conversation is no hot key."""
    said = conversations.where("conv_id is not null and turn is not null").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    prompts = said.where("role is null or role <> 'assistant'").groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min("text").alias("prompt"))
    both = said.where("role = 'assistant'").join(prompts, ["conv_id", "turn"], "left")
    return both.select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.coalesce("prompt", F.lit("")).alias("prompt"), F.col("text").alias("answer"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every row of documents in sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))

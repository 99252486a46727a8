"""Substring dedup by suffix automata of reference shards.

A window of WINDOW words is removed where the same words start in a document with a smaller key. Automata of all documents
against all documents would take time in the square of the corpus, so passages are located first, by hashes, and only
what was located streams through the automata of the references it may match:

0. Whole copies of a text with a smaller key (two 64-bit hashes of the text agree) lose all words, if they hold a window.
1. Anchors: in each window the GRAM-word run with the smallest hash, so equal windows have equal anchors and about one
   word in five starts one. Anchors that occur in one text only are settled: their windows are unique.
2. Windows at the other anchors are counted by 128 bits (the anchor's hash and the window's), with their smallest key. Where
   that is smaller than the document's own, the window goes to the reference document of that key. Windows in a row with
   one owner are one passage.
3. Reference passages (of windows whose smallest key is their own document's) are dealt into shards of about SHARD words.
   Each shard's suffix automaton is sent to as many tasks as its passages' copies need, and these stream through it: the
   matching statistics confirm, word by word, which spans of the threshold's length or more go.
4. A window that an automaton rejects has met another one's hash. The documents of such windows go through steps 2 and 3
   again with another hash, until none is rejected. So no link is lost to a collision, and none is made by one.

Hot windows and anchors combine on the map side, and the join that brings owners back has exchanges of its own on both sides,
so that adaptive execution splits a hot window; hot shards are dealt over several tasks, each with its own automaton of
bounded size. Staged tables have small row groups, since readers and writers hold whole ones in memory.

Null and empty texts have no words; texts of any length are read whole. Documents without a key keep all words and are no
reference. Rows equal in key and text are judged alike. Only the columns named are read, so others may have any names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import BROADCAST_BYTES, grams, keeping, measured, mix, slices, small, stage, table, unstage, words
from stratalog.llm.suffix_automaton import SuffixAutomaton

WINDOW, GRAM = 13, 5
#: Words of a shard's reference passages, about (a state takes some 300 bytes), and rows that stream through one task's copy.
SHARD, STREAM = 100_000, 2_000


def anchors(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of all windows that lie in one text, the place of each one's anchor, hash of the run at each place)."""
    runs = grams(hashes, gram)
    wide = window - gram + 1
    if len(runs) < wide:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), runs
    counts = np.maximum(0, np.diff(first) - window + 1)
    starts = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    place = starts + np.lib.stride_tricks.sliding_window_view(runs, wide).argmin(axis=1)[starts]
    return starts, place, runs


def _anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """a: each anchor of a text, once."""
    for whole in batches:
        for _, texts in slices(whole):
            hashes, first, _, _, _ = words(texts)
            _, place, runs = anchors(hashes, first, window)
            place = place[np.diff(place, prepend=-1) != 0]
            row = np.searchsorted(first, place, side="right").astype(np.uint64)
            _, once = np.unique(mix(runs[place] ^ row * np.uint64(0x9FB21C651E98DF25)), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(runs[place[once]].view(np.int64))], names=["a"])


def _windows(batches: Iterator[pa.RecordBatch], window: int, seed: int, bits: int) -> Iterator[pa.RecordBatch]:
    """a, k, t, start, ws: each place of an anchor, and the hashes of the windows, one after another from start, that it stands for."""
    for whole in batches:
        for batch, texts in slices(whole):
            hashes, first, _, _, _ = words(texts)
            starts, place, runs = anchors(hashes, first, window)
            at = np.flatnonzero(np.diff(place, prepend=-1))
            row = np.searchsorted(first, place[at], side="right") - 1
            ws = pa.array((grams(hashes, window, seed)[starts] >> np.uint64(64 - bits)).view(np.int64))
            ends = pa.array(np.append(at, len(starts)).astype(np.int32))
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(runs[place[at]].view(np.int64)), batch.column("k").take(rows), batch.column("t").take(rows), pa.array((starts[at] - first[row]).astype(np.int32)), pa.ListArray.from_arrays(ends, ws)],
                names=["a", "k", "t", "start", "ws"],
            )


def _runs(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """k, t, runs: found windows put together where one follows another with the same owner; start and stop in words."""
    for batch in batches:
        found = batch.column("found")
        each = found.flatten()
        owner = each.field("owner")
        code = owner.dictionary_encode().indices.to_numpy()
        start = each.field("start").to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(batch)), found.value_lengths().to_numpy())
        order = np.lexsort((start, row))
        row, start, code = row[order], start[order], code[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1]) | (start[1:] > start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row)) - 1
        runs = pa.StructArray.from_arrays([pa.array(start[first].astype(np.int32)), pa.array((start[last] + window).astype(np.int32)), owner.take(pa.array(order[first]))], names=["start", "stop", "owner"])
        ends = np.searchsorted(row[first], np.arange(len(batch) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("t"), pa.ListArray.from_arrays(pa.array(ends), runs)], names=["k", "t", "runs"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """owner, k, t, start, words: the text of each run."""
    for whole in batches:
        for batch, texts in slices(whole):
            rows: list[tuple] = []
            for k, t, runs, text in zip(*(batch.column(c).to_pylist() for c in ("k", "t", "runs")), texts, strict=True):
                said = text.split()
                rows += [(x["owner"], k, t, x["start"], b" ".join(said[x["start"] : x["stop"]])) for x in runs]
            kinds = [batch.schema.field("k").type, batch.schema.field("k").type, pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["owner", "k", "t", "start", "words"])


def _confirmed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """k, t, start, stop (in words) of what goes, and with ok false of each rejected window; a part's reference passages come
    before what streams through them."""
    part, automaton, ready = None, None, False
    for batch in batches:
        kind = batch.schema.field("k").type
        out: list[tuple] = []
        for p, reference, k, t, start, said in zip(*(batch.column(c).to_pylist() for c in ("part", "reference", "k", "t", "start", "words")), strict=True):
            if p != part:
                part, automaton, ready = p, SuffixAutomaton(), False
            said = said.split()
            if reference:
                automaton.add(said, k)
                continue
            if not ready:
                automaton.finish()
                ready = True
            run = None
            for i, label in enumerate(automaton.windows(said, window), start):
                if label is None or label >= k:
                    out.append((k, t, i, i + window, False))
                elif run is not None and i <= run[1]:
                    run[1] = i + window
                else:
                    if run:
                        out.append((k, t, *run, True))
                    run = [i, i + window]
            if run:
                out.append((k, t, *run, True))
        kinds = {"k": kind, "t": pa.int64(), "start": pa.int32(), "stop": pa.int32(), "ok": pa.bool_()}
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], x) for i, x in enumerate(kinds.values())], names=list(kinds))


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The row's words but those in its spans, and how many there are; a copy of a whole text keeps none, if it holds a window."""
    for whole in batches:
        for batch, texts in slices(whole):
            kept, n, gone = [], [], []
            for text, copy, spans in zip(texts, batch.column("copy").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                said = text.split()
                n.append(len(said))
                if copy and len(said) >= window:
                    said = []
                elif spans:
                    at, left = 0, []
                    for x in sorted((s["start"], s["stop"]) for s in spans):
                        left += said[at : x[0]]
                        at = max(at, x[1])
                    said = left + said[at:]
                gone.append(n[-1] - len(said))
                kept.append(b" ".join(said))
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=["k", "n_words", "n_removed", "kept"])


def _located(keyed: DataFrame, again: DataFrame, kind: str, window: int, seed: int, bits: int, limit: int) -> DataFrame:
    """Staged k, t, runs: the passages at those anchors that have an owner, their own document or one with a smaller key."""
    made = keyed.mapInArrow(lambda x: _windows(x, window, seed, bits), f"a long, k {kind}, t long, start int, ws array<long>")
    held = stage(made.join(small(again, limit), "a").select("a", "k", "t", "start", "ws"))
    each = held.select("a", "k", "t", F.col("start").alias("from"), F.posexplode("ws").alias("at", "w")).select("a", "w", "k", "t", (F.col("from") + F.col("at")).alias("start"))
    owners = stage(each.groupBy("a", "w").agg(F.min("k").alias("owner"), F.max("k").alias("last")).where("owner < last").select("a", "w", "owner"))
    found = each.join(owners.hint("merge"), ["a", "w"]).groupBy("k", "t").agg(F.collect_set(F.struct("start", "owner")).alias("found"))
    runs = stage(found.mapInArrow(lambda x: _runs(x, window), f"k {kind}, t long, runs array<struct<start:int,stop:int,owner:{kind}>>"), True)
    unstage(held, owners)
    return runs


def _judged(keyed: DataFrame, runs: DataFrame, kind: str, window: int, shard: int, stream: int, limit: int) -> DataFrame:
    """Staged k, t, start, stop, ok: the spans of the runs that the automata confirm, and the windows that they reject."""
    passages = stage(keyed.join(small(runs, limit), ["k", "t"]).mapInArrow(_passages, f"owner {kind}, k {kind}, t long, start int, words binary"))
    cut = passages.withColumn("reference", F.col("owner") == F.col("k"))
    words_ = F.octet_length("words") / 6
    shards = max(1, int((cut.where("reference").agg(F.sum(words_)).first()[0] or 0) // shard) + 1)
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("owner"), F.lit(shards)))
    load = stage(cut.where("not reference").groupBy("shard").agg(F.ceil(F.count("*") / stream).cast("int").alias("parts")), True)
    dealt = cut.join(small(load, limit), "shard")
    mine = F.when(F.col("reference"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("k", "t", "start"), F.col("parts")).cast("int")))
    dealt = dealt.withColumn("copy", F.explode(mine)).select(F.xxhash64("shard", "copy").alias("part"), "reference", "k", "t", "start", "words")
    dealt = dealt.repartition("part").sortWithinPartitions("part", F.desc("reference"))
    out = stage(dealt.mapInArrow(lambda x: _confirmed(x, window), f"k {kind}, t long, start int, stop int, ok boolean"))
    unstage(passages, load)
    return out


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES, shard: int = SHARD, stream: int = STREAM, bits: int = 64
) -> DataFrame:
    """k (the key), n_words, n_removed, kept (the kept words joined by a space, UTF-8) of each row. bits: of the first
    round's window hash, fewer in tests of collisions only."""
    kind, limit = docs.schema[key].dataType.simpleString(), broadcast_bytes
    docs = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.xxhash64(F.lit(1), text).alias("t2"), F.col(text).alias("text"))
    with keeping(docs.sparkSession) as kept:
        copies = stage(docs.where("k is not null and text is not null").groupBy("t", "t2").agg(F.min("k").alias("one"), F.max("k").alias("last")).where("one < last").select("t", "t2", "one"), True)
        few = measured(copies)[1] <= limit
        docs = docs.join(F.broadcast(copies) if few else copies, ["t", "t2"], "left").withColumn("copy", F.coalesce(F.col("k") > F.col("one"), F.lit(False)))
        keyed = docs.where("k is not null and text is not null and not copy").select("k", "t", "text")
        if not few:  # else each of the passes below would shuffle the texts again
            keyed = stage(keyed)
        of = lambda rows: rows.select("text").mapInArrow(lambda x: _anchors(x, window), "a long")
        again = stage(of(keyed).groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"), True)
        judged, seed = [], 3
        while True:
            runs = _located(keyed, again, kind, window, seed, bits if not judged else 64, limit)
            unstage(again)
            judged.append(_judged(keyed, runs, kind, window, shard, stream, limit))
            unstage(runs)
            rejected = stage(judged[-1].where("not ok").select("k", "t").distinct(), True)
            if not measured(rejected)[0]:
                unstage(rejected)
                break
            again = stage(of(keyed.join(small(rejected, limit), ["k", "t"], "left_semi")).distinct(), True)
            unstage(rejected)
            seed += 1
        spans = judged[0]
        for more in judged[1:]:
            spans = spans.unionAll(more)
        spans = stage(spans.where("ok").groupBy("k", "t").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), True)
        kept += [copies, spans]
    out = docs.join(small(spans, limit), ["k", "t"], "left").select("k", "copy", "text", "spans")
    return out.mapInArrow(lambda x: _cut(x, window), f"k {kind}, n_words long, n_removed long, kept binary")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words of every row of documents, by windows of 13 words."""
    return remove_repeats(table(spark, sf_dir, "documents")).select(F.col("k").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: By all windows as texts.
ORACLE = r"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as l from documents),
windows as (select doc_id, i, array_to_string(l[i:i + 12], ' ') as said from (select doc_id, l, unnest(range(1, len(l) - 11)) as i from w)),
first as (select said, min(doc_id) as least from windows group by said),
gone as (select distinct doc_id, i + unnest(range(0, 13)) as i from (select doc_id, i from windows join first on windows.said = first.said where least < doc_id)),
each as (select doc_id, unnest(l) as word, generate_subscripts(l, 1) as i from w),
kept as (select e.doc_id, string_agg(word, ' ' order by e.i) as said, count(*) as n from each e left join gone g on g.doc_id = e.doc_id and g.i = e.i where g.i is null group by e.doc_id)
select w.doc_id, len(l) as n_words, len(l) - coalesce(n, 0) as n_removed, sha256(coalesce(said, '')) as kept_sha256 from w left join kept on kept.doc_id = w.doc_id"""

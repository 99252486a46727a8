"""MinHash near-dedup with tensored banding.

A text's set holds its distinct SHINGLE-word shingles (with fewer words, the whole sequence as one), as 64-bit hashes of
ASCII-lower-cased words. Rather than minhashes for every table, two collections of BANDS bands of ROWS minhashes are
made; a table's key combines a pair (band of the first, band of the second), so BANDS**2 tables of 2 * ROWS minhashes come
from only 2 * BANDS * ROWS of them. At the similarity 0.85 a pair has no table in common with probability 1.5e-4. Pairs are
only formed of bands that other texts have too.

Equal sets are one node from the start. Two rounds then find the links, each confirmed on full sets from the whole texts:

1. Each node meets one pivot: the first node of a bucket, of the bucket that it shares with the most of its tables. That is
   one comparison a node, and joins nearly all copies of a text into one component.
2. Buckets whose nodes aren't all in one component by then are gone through in full: every node outside the bucket's
   largest component meets every node of another component there, in chunks of CHUNK nodes, so memory is bounded and no pair
   is left out. A pair counts in its first common table only, and goes on if its equal minhashes allow the similarity (a
   link is lost there with probability 3e-6).

So a bucket of n near copies costs n comparisons and n for each node that isn't linked to its pivot, not n squared; only
texts that share a table, are just too different, and aren't joined by way of others meet each with each. Comparisons
happen in units of nodes that meet in one task; a unit gives only a spanning forest of its links, and no list of pairs of a
group is ever written. Components come from distributed star rounds.

Null and empty texts have no shingles and are linked with nothing; texts of any length are read whole, one batch of about 1
MB (or one text) at a time. Null keys are larger than any key; a component of null keys only has a null id, and all its
rows stay. Rows equal in key and text are judged alike. Only the two named columns are read, so others may have any names."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import BROADCAST_BYTES, freeing, grams, keeping, measured, mix, slices, small, stage, table, unstage, words
from stratalog.llm.components import components

SHINGLE, BANDS, ROWS = 5, 10, 3
#: Nodes of a bucket's chunk; nodes of a unit of left-over comparisons, and of one pivot's unit.
CHUNK, UNIT, AROUND = 512, 512, 64
_N = BANDS * ROWS
_rng = np.random.default_rng(20240229)
_SEEDS = _rng.integers(0, 1 << 63, (2 * _N, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, first, _, _, _ = words(texts, lower=True)
    whole, out = grams(hashes, size), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        else:
            out.append(grams(hashes[a:b], b - a, seed=b - a + 2) if b > a else whole[:0])
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, 2 * BANDS * ROWS) 16-bit digests of minhashes; sets aren't empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    least = np.stack([np.minimum.reduceat((flat ^ xor) * by, starts) for xor, by in _SEEDS], axis=1)
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def band_keys(m: np.ndarray) -> np.ndarray:
    """(sets, 2 * BANDS) keys of the bands of both collections: the band's number and its digests."""
    b = m.reshape(len(m), 2 * BANDS, ROWS).astype(np.int64)
    return np.arange(2 * BANDS) << 48 | b[:, :, 0] << 32 | b[:, :, 1] << 16 | b[:, :, 2]


def _signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, h, n_shingles, node (128-bit digest of the set; null for an empty one), keys, minhashes of each row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in slices(whole):
                sets = shingles(texts)
                full = [s for s in sets if len(s)]
                m = minhashes(full) if full else np.zeros((0, 2 * _N), np.uint16)
                keys, digests, at = band_keys(m), iter(m), iter(range(len(m)))
                rows = [(xxhash.xxh3_128_digest(s.tobytes()), keys[next(at)], next(digests).tobytes()) if len(s) else (None, None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k"), batch.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array([r[0] for r in rows], pa.binary()),
                     pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.binary())],
                    names=["k", "h", "n_shingles", "node", "keys", "minhashes"],
                )

    made = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    return made.mapInArrow(freeing(run), f"k {kind}, h long, n_shingles long, node binary, keys array<long>, minhashes binary")


@functools.cache
def _two(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by a column: a group that goes on in the next batch is held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(by).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(column != column[-1])[-1]) + 1 if (column != column[-1]).any() else 0
        if held and (cut or held[-1].column(by)[-1].as_py() != column[0]):
            if held[-1].column(by)[-1].as_py() != column[0]:
                yield pa.Table.from_batches(held)
                held = []
            elif cut:
                end = int(np.flatnonzero(column != column[0])[0])
                yield pa.Table.from_batches([*held, batch.slice(0, end)])
                held, batch, column, cut = [], batch.slice(end), column[end:], cut - end
        if cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _least_equal(percent: int) -> int:
    """Equal minhashes below which a pair of that similarity falls with probability 3e-6 only."""
    n, j = 2 * _N, percent / 100
    return max(0, int(n * j - 4.5 * (n * j * (1 - j)) ** 0.5))


def _candidates(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """unit, cid, partners: nodes with those of other components they must be compared with, in units of nodes that stay
    together. A block's rows are those of two chunks of a bucket (ci, cj), or of one."""
    least = _least_equal(percent)
    schema = pa.schema([("unit", pa.int64()), ("cid", pa.int64()), ("partners", pa.list_(pa.int64()))])
    unit: dict[int, list[int]] = {}
    name = None

    def emit() -> pa.RecordBatch:
        rows = sorted(unit.items())
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], schema=schema)

    for t in _groups(batches, "block"):
        block = t.column("block").to_numpy()
        cid, label, mine, pair, i_table, j_table = (t.column(c).to_numpy() for c in ("cid", "label", "chunk", "ci", "i", "j"))
        m = np.frombuffer(b"".join(t.column("minhashes").to_pylist()), np.uint16).reshape(len(cid), -1)
        ends = np.append(np.flatnonzero(block[1:] != block[:-1]) + 1, len(block))
        start, lefts, rights, size = 0, [], [], 0

        def sift(left: np.ndarray, right: np.ndarray) -> None:
            nonlocal name
            for at in range(0, len(left), 1 << 16):
                x, y = left[at : at + (1 << 16)], right[at : at + (1 << 16)]
                ok = label[x] != label[y]
                x, y = x[ok], y[ok]
                equal = m[x] == m[y]
                ok = equal.sum(axis=1) >= least
                x, y, equal = x[ok], y[ok], equal[ok]
                bands = equal.reshape(len(x), 2, BANDS, ROWS).all(axis=3)
                ok = bands.any(axis=2).all(axis=1) & (bands[:, 0].argmax(axis=1) == i_table[x]) & (bands[:, 1].argmax(axis=1) == j_table[x])
                for a, b, k in zip(cid[x[ok]].tolist(), cid[y[ok]].tolist(), block[x[ok]].tolist(), strict=True):
                    if name is None:
                        name = k
                    unit.setdefault(min(a, b), []).append(max(a, b))
                    unit.setdefault(max(a, b), [])

        for end in ends.tolist():
            a, b = _two(end - start)
            a, b = a + start, b + start
            if (mine[start:end] != pair[start:end]).any():  # two chunks: each of one with each of the other
                ok = mine[a] != mine[b]
                a, b = a[ok], b[ok]
            lefts, rights, size, start = [*lefts, a], [*rights, b], size + len(a), end
            if size > 2048 or end == len(block):
                sift(np.concatenate(lefts), np.concatenate(rights))
                lefts, rights, size = [], [], 0
                if len(unit) >= UNIT:
                    yield emit()
                    unit, name = {}, None
    if unit:
        yield emit()


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """u, v: a spanning forest of each unit's links, confirmed on full sets."""
    for t in _groups(batches, "unit"):
        unit = t.column("unit").to_numpy()
        ends = np.append(np.flatnonzero(unit[1:] != unit[:-1]) + 1, len(unit))
        start, out = 0, []
        for end in ends.tolist():
            rows = t.slice(start, end - start)
            start = end
            ids = rows.column("cid").to_pylist()
            texts = [x or b"" for x in rows.column("text").cast(pa.binary()).to_pylist()]
            sets = dict(zip(ids, shingles(texts), strict=True))
            root = {i: i for i in ids}

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x, partners in zip(ids, rows.column("partners").to_pylist(), strict=True):
                a = sets[x]
                for y in partners:
                    b = sets[y]
                    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or (p := find(x)) == (q := find(y)):
                        continue
                    both = np.sort(np.concatenate([a, b]), kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    if 100 * common >= percent * (len(a) + len(b) - common):
                        root[max(p, q)] = min(p, q)
                        out.append((x, y))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["u", "v"])


def _tables(classes: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """key, i, j, cid of each table (i, j) that a node may share with another: its pairs of bands that others have too; and
    the staged table behind it."""
    bands = classes.select("cid", F.explode("keys").alias("band"))
    shared = stage(bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), True)
    which = F.shiftright("band", 48)
    of = lambda own: F.collect_list(F.when(own, F.col("band")))
    held = stage(bands.join(small(shared, limit), "band").groupBy("cid").agg(of(which < BANDS).alias("first"), of(which >= BANDS).alias("second")))
    unstage(shared)
    pairs = held.select("cid", "second", F.explode("first").alias("a")).select("cid", "a", F.explode("second").alias("b"))
    number = lambda c: F.shiftright(c, 48).cast("int")
    return pairs.select(F.xxhash64("a", "b").alias("key"), number("a").alias("i"), (number("b") - BANDS).alias("j"), "cid"), held


def _pivots(tables: DataFrame, firsts: DataFrame, unit: int, limit: int) -> DataFrame:
    """unit, cid, partners: each node with its pivot, and the pivot with each unit of those that meet it."""
    met = tables.join(small(firsts, limit), "key").where("cid <> first").groupBy("cid", "first").agg(F.count("*").alias("n"))
    own = stage(met.groupBy("cid").agg(F.max(F.struct("n", -F.col("first"))).alias("best")).select("cid", (-F.col("best")["col2"]).alias("pivot")))
    parts = stage(own.groupBy("pivot").agg(F.ceil(F.count("*") / unit).cast("int").alias("parts")), True)
    dealt = own.join(small(parts, limit), "pivot").select(F.xxhash64("pivot", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).alias("unit"), "cid", F.array("pivot").alias("partners"))
    centres = parts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(F.xxhash64("pivot", "part").alias("unit"), F.col("pivot").alias("cid"), F.array().cast("array<long>").alias("partners"))
    return dealt.unionAll(centres)


def _unsettled(tables: DataFrame, labels: DataFrame, classes: DataFrame, chunk: int, limit: int) -> DataFrame:
    """Rows for _candidates: of each bucket that holds several components, all nodes outside the largest one against all."""
    labelled = tables.join(small(labels.withColumnRenamed("node", "cid"), limit, labels), "cid", "left").withColumn("label", F.coalesce("root", "cid")).select("key", "i", "j", "cid", "label")
    counted = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    split = counted.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"), F.min("label").alias("one"), F.max("label").alias("other")).where("one < other")
    split = stage(split.select("key", F.col("most.label").alias("most"), F.ceil(F.col("most.n") / chunk).cast("int").alias("many"), F.ceil((F.col("n") - F.col("most.n")) / chunk).cast("int").alias("few")), True)
    nodes = labelled.join(small(split, limit), "key")
    within = lambda n: F.pmod(F.xxhash64("cid", "key"), n).cast("int")
    outside = F.col("label") != F.col("most")
    nodes = nodes.withColumn("chunk", F.when(outside, within(F.col("few"))).otherwise(F.col("few") + within(F.col("many"))))
    others = F.sequence(F.lit(0), F.when(outside, F.col("few") + F.col("many")).otherwise(F.col("few")) - 1)
    met = nodes.withColumn("other", F.explode(others)).select("key", "i", "j", "cid", "label", "chunk", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"))
    met = met.withColumn("block", F.xxhash64("key", "ci", "cj")).join(classes.select("cid", "minhashes"), "cid")
    return met.repartition("block").sortWithinPartitions("block", "key", "ci", "cj")


def _linked(docs: DataFrame, classes: DataFrame, tables: DataFrame, firsts: DataFrame, key: str, text: str, percent: int, chunk: int, around: int, limit: int) -> DataFrame:
    """node, first (its own smallest key), root of each class, after both rounds."""
    tables = stage(tables.join(small(firsts.select("key"), limit, firsts), "key", "left_semi"))
    wanted = stage(tables.select("cid").distinct().join(classes, "cid").select("cid", "rep.k", "rep.h"), True)
    found = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    sides = small(wanted, limit)
    found = found.join(sides, found["k"].eqNullSafe(sides["k"]) & (found["h"] == sides["h"])).select("cid", "text")
    texts = stage(found.groupBy("cid").agg(F.first("text").alias("text")))

    def confirmed(needed: DataFrame) -> DataFrame:
        units = needed.join(texts, "cid").repartition("unit").sortWithinPartitions("unit", "cid")
        return stage(units.mapInArrow(freeing(lambda x: _confirmed(x, percent)), "u long, v long"), True)

    labels = stage(components(confirmed(_pivots(tables, firsts, around, limit))), True)
    label = lambda node, name: labels.select(F.col("node").alias(node), F.col("root").alias(name))
    own: Column = F.coalesce("root", "cid")
    named = classes.select("cid", "node", F.col("rep.k").alias("first")).join(small(label("cid", "root"), limit, labels), "cid", "left").select("node", "first", own.alias("root"))
    unsettled = _unsettled(tables, labels, classes, chunk, limit)
    needed = stage(unsettled.mapInArrow(freeing(lambda x: _candidates(x, percent)), "unit long, cid long, partners array<long>"), True)
    more = confirmed(needed) if measured(needed)[0] else needed
    if measured(more)[0]:
        across = more.join(label("u", "a"), "u", "left").join(label("v", "b"), "v", "left").select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v"))
        joined = components(across).select(F.col("node").alias("root"), F.col("root").alias("last"))
        named = named.join(joined, "root", "left").select("node", "first", F.coalesce("last", "root").alias("root"))
    return stage(named)


def mark(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, chunk: int = CHUNK, around: int = AROUND, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """k (the key), h (xxhash64 of the text), n_shingles, component_id, kept of each row of docs. Links are pairs with
    100 * intersection >= percent * union."""
    docs, limit = docs.select(F.col(key), F.col(text)), broadcast_bytes
    with keeping(docs.sparkSession) as kept:
        rows = stage(_signed(docs, key, text))
        first = F.struct(F.col("k").isNull().alias("none"), "k", "h")
        classes = stage(
            rows.where("n_shingles > 0").groupBy("node").agg(F.min(first).alias("rep"), F.first("keys").alias("keys"), F.first("minhashes").alias("minhashes"))
            .select(F.monotonically_increasing_id().alias("cid"), "node", "rep", "keys", "minhashes")
        )
        tables, held = _tables(classes, limit)
        firsts = stage(tables.groupBy("key").agg(F.min("cid").alias("first"), F.max("cid").alias("last")).where("first < last").select("key", "first"), True)
        if measured(firsts)[0]:
            named = _linked(docs, classes, tables, firsts, key, text, percent, chunk, around, limit)
        else:
            named = stage(classes.select("node", F.col("rep.k").alias("first"), F.col("cid").alias("root")))
        unstage(held, firsts)
        least = named.groupBy("root").agg(F.min("first").alias("component_id"))
        judged = stage(named.join(least, "root").select("node", "component_id"), True)
        kept += [rows, judged]
    out = rows.join(small(judged, limit), "node", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("k")).otherwise(F.col("component_id"))
    return out.select("k", "h", "n_shingles", own.alias("component_id"), F.col("k").eqNullSafe(own).alias("kept"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """docs without the rows whose component has a smaller key."""
    with keeping(docs.sparkSession) as kept:
        gone = stage(mark(docs, key, text, percent).where("not kept").select("k", "h").distinct(), True)
        kept.append(gone)
    on = docs[key].eqNullSafe(gone["k"]) & (F.xxhash64(docs[text]) == gone["h"])
    return docs.join(small(gone), on, "left_anti")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of documents, linked at 85 per cent."""
    return mark(table(spark, sf_dir, "documents")).select(F.col("k").alias("doc_id"), "n_shingles", "component_id", "kept")


#: By all pairs that share a shingle, and reachability.
ORACLE = r"""with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as l from documents),
s as (select distinct doc_id, unnest(case when len(l) = 0 then [] when len(l) < 5 then [array_to_string(l, ' ')]
  else list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) end) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select x, y from shared join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)),
ways as (select x, y from links union all select y, x from links),
reach as (select distinct x as one, x as other from ways union select one, y from reach join ways on other = x),
least as (select one, min(other) as component from reach group by one)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(component, d.doc_id) as component_id, coalesce(component, d.doc_id) = d.doc_id as kept
from documents d left join n on n.doc_id = d.doc_id left join least on one = d.doc_id"""

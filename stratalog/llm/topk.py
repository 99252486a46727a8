"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors, as integers, are dealt into blocks of BLOCK rows. A block's index holds, for each component, posting segments of
the rows whose values fall in the same quantised level, with the segment's smallest and largest value. A segment's impact
for a query is what it may add above the least that component can give. A block's queries are processed together, tier
by tier of each one's segments by descending impact, adding to the rows' accumulators what they surely give. From a
component, a row gains no more than that component's widest processed segment leaves open or than its largest unprocessed
impact. Processing stops on proof only: when at most a share (RESCORE) of the block's rows can still reach the k-th surest
score. Those possible members, all of them, are rescored exactly from their vectors.

Vectors of one length are dealt into blocks of a bounded number of components, queries into parts. A task takes a block, builds
its index once, and a part's queries stream past it, QUERIES at a time; so a block is shipped once for each part of the
queries and not for each of them, and no list of pairs is made. Each block gives at most k rows a query, which a ranked
window with a partial limit merges.

Vectors that are null, empty, or hold null or non-finite components, and rows without an id, take no part; only vectors of the
query's length are scored; a query's own row is left out, other rows with its id aren't. Ties go to the smaller id.
Repeated rows are scored each. Finite components of any size count: vectors with one of LARGE or more go into blocks of
their own, and where sums of products might not fit 64 bits, Python's integers score the block's rows one by one. Ranks
are by the exact scores; a score beyond a long's range is shown as that range's end. Vectors of any length are taken
whole. Only the two named columns and those of the query condition are read."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.llm.common import small, stage, table, unstage

#: Rows and components of a block at most (one row at least); queries that are searched together, and in a part.
BLOCK, COMPONENTS, QUERIES, PART = 8192, 1 << 20, 128, 8192
#: Levels of a component's values; the share of a block's rows that may be rescored without more segments; the shares of a
#: query's segments, by descending impact, after which the proof is tried.
LEVELS, RESCORE, TIERS = 32, 0.25, (0.7, 1.0)
#: Vectors with a component of this size or more are kept apart, as their scores may need more than 64 bits.
LARGE = 1 << 18


class ImpactIndex:
    """Of one block: x (rows, components), integers."""

    def __init__(self, x: np.ndarray, levels: int = LEVELS):
        self.x = x
        segments: list[tuple[np.ndarray, int, int, int]] = []  # rows, component, smallest and largest value
        for d in range(x.shape[1]):
            order = np.argsort(x[:, d], kind="stable")
            values = x[order, d]
            low, high = int(values[0]), int(values[-1])
            edges = np.searchsorted(values, np.linspace(low, high, levels + 1)[1:-1]) if high > low else []
            for part in np.split(np.arange(len(values)), edges):
                if len(part):
                    segments.append((np.sort(order[part]), d, int(values[part[0]]), int(values[part[-1]])))
        self.rows = [s[0] for s in segments]
        self.component = np.array([s[1] for s in segments])
        self.low = np.array([s[2] for s in segments], np.int64)
        self.high = np.array([s[3] for s in segments], np.int64)
        self.first = np.flatnonzero(np.diff(self.component, prepend=-1))  # of each component's segments

    def search(self, queries: np.ndarray, k: int, rescore: float = RESCORE, tiers: tuple[float, ...] = TIERS) -> list[np.ndarray]:
        """For each query, rows among which are its k best scores and all that tie with them; the others are proved to be below."""
        n, able = len(self.x), {}
        if n <= k:
            return [np.arange(n)] * len(queries)
        weight = queries[:, self.component]
        one, two = weight * self.low, weight * self.high
        worst, best = np.minimum(one, two), np.maximum(one, two)
        base = np.minimum.reduceat(worst, self.first, axis=1)[:, self.component]
        surely, impact = worst - base, best - base
        room = int(np.maximum.reduceat(impact, self.first, axis=1).sum(axis=1).max(initial=0))
        kind = np.int32 if room < 1 << 31 else np.int64
        place = np.argsort(np.argsort(-impact, axis=1, kind="stable"), axis=1)  # of each segment, by descending impact
        sums = np.zeros((n, len(queries)), kind)
        left, start = np.arange(len(queries)), 0
        for share in tiers:
            end = impact.shape[1] if share == tiers[-1] else int(share * impact.shape[1])
            now = (place[left] >= start) & (place[left] < end)
            adds = np.where(now, surely[left], 0).astype(kind)
            for s in np.flatnonzero(now.any(axis=0)):
                sums[self.rows[s]] += adds[:, s]
            # a component gives a row what its segment surely does and a bit more, or, if that hasn't come up, its impact at most
            open_ = np.where(place[left] < end, best[left] - worst[left], impact[left])
            more = np.maximum.reduceat(open_, self.first, axis=1).sum(axis=1)
            least = np.partition(sums, n - k, axis=0)[n - k] - more
            proved, start = np.zeros(len(left), bool), end
            for j, q in enumerate(left):
                found = np.flatnonzero(sums[:, j] >= least[j])
                if len(found) <= max(k, rescore * n) or share == tiers[-1]:
                    able[q], proved[j] = found, True
            left, sums = left[~proved], sums[:, ~proved]
            if not len(left):
                break
        return [able[q] for q in range(len(queries))]


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, exactly; Python integers where they don't fit 53 bits."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if not len(x) or np.abs(scaled).max() < 1 << 53:
        return scaled.astype(np.int64)
    whole = lambda v: int(v) * scale if abs(v) >= 1 << 53 else math.floor(v * scale)
    return np.array([[whole(v) for v in row] for row in x.tolist()], object)


class Searcher:
    """One block of vectors (doubles), with its rows' numbers and ids."""

    def __init__(self, rids: np.ndarray, ids: np.ndarray, x: np.ndarray, scale: int):
        self.rids, self.ids, self.x, self.scale = rids, ids, integers(x, scale), scale
        self.most = [int(v) for v in np.abs(self.x).max(axis=0)]
        self.index = None

    def best(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, list]]:
        """Ids and scores of each query's k best rows without its own."""
        queries = integers(queries, self.scale)
        bound = sum(int(a) * b for a, b in zip(np.abs(queries).max(axis=0), self.most, strict=True))
        if bound < 1 << 59 and self.x.dtype != object and queries.dtype != object:
            self.index = self.index or ImpactIndex(self.x)
            able = self.index.search(queries, k + 1)
        else:
            able = [np.arange(len(self.x))] * len(queries)
            queries = queries.astype(object)
        for rows, q, mine in zip(able, queries, own, strict=True):
            rows = rows[self.rids[rows] != mine]
            scores = self.x[rows] @ q
            first = sorted(range(len(rows)), key=lambda i: (-scores[i], self.ids[rows[i]]))[:k] if scores.dtype == object else np.lexsort((self.ids[rows], -scores))[:k]
            yield self.ids[rows[first]], scores[first].tolist()


_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_NINES = str.maketrans("0123456789", "9876543210")


def beyond(score: int) -> str | None:
    """A text that sorts as the score does, for scores at or beyond either end of a long."""
    if _LOW < score < _HIGH:
        return None
    digits = str(abs(score))
    return f"{len(digits):05d}{digits}" if score > 0 else f"{99_999 - len(digits):05d}{digits.translate(_NINES)}"


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024, block: int = BLOCK, components: int = COMPONENTS,
    queries: int = QUERIES, part: int = PART,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which is_query holds, the k largest integer inner products."""
    x = F.col(vector)
    number = vectors.schema[vector].dataType.elementType.simpleString()
    kind = "float" if number == "float" else "double"
    usable = F.col(key).isNotNull() & x.isNotNull() & (F.size(x) > 0)
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(math.inf))
    rows = stage(
        vectors.where(usable & F.coalesce(F.forall(x, finite), F.lit(False))).select(
            F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("id"), F.size(x).alias("length"), x.cast(f"array<{kind}>").alias("v"),
            F.exists(x, lambda c: F.abs(c.cast("double")) >= LARGE).alias("large"), F.coalesce(is_query, F.lit(False)).alias("asks"),
        )
    )
    # blocks: of each length, the large vectors' after the others'; parts: of each length's queries
    fits = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(components) / F.col("length"))))
    plain, large = (F.count(F.when(F.col("large") == kind, 1)) for kind in (False, True))
    asking = F.count(F.when(F.col("asks"), 1))
    counts = stage(rows.groupBy("length").agg(plain.alias("plain"), large.alias("more"), asking.alias("queries")).where("queries > 0").select(
        "length", F.ceil(F.col("plain") / fits).cast("int").alias("plain"), F.ceil(F.col("more") / fits).cast("int").alias("more"), F.ceil(F.col("queries") / part).cast("int").alias("parts")
    ), True)
    dealt = rows.join(small(counts), "length")
    within = lambda n: F.pmod(F.xxhash64("rid"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = F.when(F.col("large"), F.col("plain") + within(F.col("more"))).otherwise(within(F.col("plain")))
    held = dealt.select("rid", "id", "length", "v", F.lit(False).alias("asks"), own.alias("block"), upto(F.col("parts")).alias("part"))
    asked = dealt.where("asks").select("rid", "id", "length", "v", "asks", within(F.col("parts")).alias("part"), upto(F.col("plain") + F.col("more")).alias("block")).select(held.columns)
    units = held.unionAll(asked).repartition("length", "block", "part").sortWithinPartitions("length", "block", "part", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, searcher, waiting = None, None, []

        def numbers(slices: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            t = pa.Table.from_batches(slices).combine_chunks()
            flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return t.column("rid").to_numpy(), t.column("id").to_numpy(), flat.astype(np.float64).reshape(t.num_rows, -1)

        def answers() -> pa.RecordBatch:
            out: list[tuple] = []
            for rid, q, (ids, scores) in zip(*asked[:2], searcher.best(asked[2], asked[0], k), strict=True):
                out += [(int(rid), int(q), int(i), min(max(s, _LOW), _HIGH), beyond(s)) for i, s in zip(ids, scores, strict=True)]
            kinds = {"rid": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64(), "beyond": pa.string()}
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds.values())], names=list(kinds))

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "block", "part", "asks")], axis=1)
            edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
            for a, b in zip(edges, edges[1:], strict=False):
                now, asks = tuple(marks[a, :3].tolist()), bool(marks[a, 3])
                if now != unit:
                    if searcher and waiting:
                        asked = numbers(waiting)
                        yield answers()
                    unit, searcher, waiting = now, None, []
                if asks and searcher is None:
                    if not waiting:
                        continue  # no vectors in this block
                    searcher, waiting = Searcher(*numbers(waiting), scale), []
                while a < b:
                    room = b - a if not asks else min(b - a, queries - sum(w.num_rows for w in waiting))
                    waiting.append(batch.slice(a, room))
                    a += room
                    if asks and sum(w.num_rows for w in waiting) >= queries:
                        asked, waiting = numbers(waiting), []
                        yield answers()
        if searcher and waiting:
            asked = numbers(waiting)
            yield answers()

    found = stage(units.mapInArrow(run, "rid long, query_id long, vec_id long, score long, beyond string"))
    unstage(rows, counts)
    order = Window.partitionBy("rid").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 10 best of all embeddings for those whose vec_id is divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = """with v as (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as hugeint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.rid as q, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as score
  from v q, v c where q.vec_id % 100 = 0 and c.rid <> q.rid and len(c.v) = len(q.v)),
ranked as (select query_id, row_number() over (partition by q order by score desc, vec_id) as rank, vec_id, score from scored)
select query_id, cast(rank as integer) as rank, vec_id, cast(score as bigint) as score from ranked where rank <= 10"""

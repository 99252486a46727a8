"""Toxicity scores by non-negative positive-unlabelled learning in numpy.

Texts are sets of hashed features: words, word beginnings, and whether several words share one. Training has three parts:

1. How many texts have each feature, over all unlabelled texts (every document outside the held-out part), counted by the
   tasks and summed; and over the confirmed toxic sample without near copies.
2. Features that are much commoner in toxic texts are chosen (KEPT at most); candidates are buckets, so the driver gets
   BUCKETS rows at most, whatever the corpus' size.
3. A linear model on them is fitted, by gradient steps on the risk estimator prior * R+(P) + max(0, R-(U) - prior * R-(P)),
   which corrects for the toxic share (the class prior) inside the unlabelled texts. The steps read bounded samples in hash
   order of the key: TOXIC confirmed toxic rows and UNLABELLED others, as lists of their chosen features only.

Scoring is a map over Arrow batches on whole texts: no shuffle; only the model (at most KEPT weights) is sent out.

Null and empty texts get the model's base score; texts of any length are scored and counted whole. Rows without a doc_id count
as not held out and never train. Without toxic examples every score is 0. Repeated labels of a document count as toxic if
any of them is; repeated documents train as often as they are there, within the samples' bounds. Other columns pass through
under any names; one named as the score (in any case) is replaced."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import Memo, freeing, slices, stage, table, unstage, writing

#: The training samples' bounds, in rows.
TOXIC, UNLABELLED = 4_000, 16_000
#: Buckets of the hashed features, and how many of them the model may use.
BUCKETS, KEPT = 1 << 20, 4_096
STEMS = (4, 5, 6, 7)
#: Toxic texts of the sample, near copies aside, that a chosen feature is in at least.
LEAST = 4
#: So many distinct words with a feature are features of their own.
TIMES = (2, 4)
CUT = 0.3

_SHUFFLES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_STRIP = b".,;:!?\"'()[]"


def word_features(word: bytes) -> list[bytes]:
    """A word of a text (ASCII letters in lower case), without outer punctuation, and its beginnings of STEMS bytes."""
    w = word.strip(_STRIP)
    return [w, *(b"^" + w[:n] for n in STEMS if n < len(w))] if w else []


def bucket(feature: bytes) -> int:
    return zlib.crc32(feature) & (BUCKETS - 1)


_ODD, _STEP = 2654435761, 40503


def more(b: int, n: int) -> int:
    """The bucket for n or more distinct words of a text with a feature in bucket b."""
    return (b * _ODD + n * _STEP) & (BUCKETS - 1)


def fewer(b: int, n: int) -> int:
    """The bucket whose more() is b."""
    return (b - n * _STEP) * pow(_ODD, -1, BUCKETS) & (BUCKETS - 1)


#: Words whose buckets a worker remembers; a full memo starts anew.
WORDS = 200_000


def _packed(word: bytes) -> bytes:
    return np.array([bucket(f) for f in word_features(word)], np.int32).tobytes()


class Features:
    """Sorted buckets of texts."""

    def __init__(self):
        self.known = Memo(_packed, WORDS)

    def __call__(self, text: bytes) -> np.ndarray:
        found = np.frombuffer(b"".join(map(self.known.__getitem__, set(text.lower().split()))), np.int32)
        once, times = np.unique(found, return_counts=True)
        once = once.astype(np.int64)
        return np.unique(np.concatenate([once, *(more(once[times >= n], n) for n in TIMES)])).astype(np.int32)


def marks(buckets: np.ndarray) -> list[int]:
    """Two texts are near copies if one of their six marks is the same: by one of six hashes their twelve smallest features are."""
    h = buckets.astype(np.uint64)[None, :] * _SHUFFLES[:, None]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    if len(buckets) > 12:
        h = np.partition(h, 11, axis=1)[:, :12]
    h.sort(axis=1)
    return [xxhash.xxh64_intdigest(x.tobytes(), seed=i) - (1 << 63) for i, x in enumerate(h)]


def choose(prior: float, toxic: np.ndarray, n_toxic: int, others: np.ndarray, n_others: int, kept: int = KEPT) -> np.ndarray:
    """Places of the features that are commoner in toxic texts by far, and mostly in them: by Bayes' rule a feature's toxic
    share is prior * (its share in toxic texts) / (its share in all). toxic, others: how many texts have each feature."""
    a, b = (toxic + 0.5) / (n_toxic + 1), (others + 0.5) / (n_others + 1)
    score = (a - b) / np.sqrt(a * (1 - a) / n_toxic + b * (1 - b) / max(1, n_others) + 1e-12)
    able = np.flatnonzero((score > 3) & (toxic >= LEAST) & (prior * a > 0.5 * b))
    return np.sort(able[np.argsort(-score[able], kind="stable")[:kept]])


class NonNegativePU:
    """Logistic model on the presence of chosen features, fitted on the non-negative positive-unlabelled risk."""

    def __init__(self, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3):
        self.prior, self.steps, self.rate, self.decay = prior, steps, rate, decay

    def fit(self, chosen: np.ndarray, p: list[np.ndarray], u: list[np.ndarray]) -> NonNegativePU:
        """chosen: sorted buckets; p, u: of each toxic or unlabelled text, the places of those it has."""
        self.chosen = chosen
        xp, xu = (self._matrix(rows) for rows in (p, u))
        w, b = np.zeros(len(self.chosen)), np.log(self.prior / (1 - self.prior))
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for t in range(1, self.steps + 1):
            zp, zu = self._logits(xp, w, b), self._logits(xu, w, b)
            sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
            # logistic loss: toxic texts softplus(-z), others softplus(z)
            negative = np.logaddexp(0, zu).mean() - self.prior * np.logaddexp(0, zp).mean()
            gp, gu = self.prior * (sp - 1) / len(zp), np.zeros(len(zu))
            if negative >= 0:
                gp, gu = gp - self.prior * sp / len(zp), su / len(zu)
            else:  # step back from overfitting: only the negative part, reversed
                gp, gu = self.prior * sp / len(zp), -su / len(zu)
            g = np.zeros(len(w) + 1)
            for (rows, cols, _), grad in ((xp, gp), (xu, gu)):
                g[:-1] += np.bincount(cols, weights=grad[rows], minlength=len(w))
                g[-1] += grad.sum()
            g[:-1] += self.decay * w / max(1, len(w))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
            w, b = w - step[:-1], b - step[-1]
        self.w, self.b = w, float(b)
        return self

    @staticmethod
    def _matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        """(row, place) of each chosen feature that a row has, and the number of rows."""
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([np.zeros(0, np.int64), *rows]), len(rows)

    @staticmethod
    def _logits(x: tuple, w: np.ndarray, b: float) -> np.ndarray:
        return b + np.bincount(x[0], weights=w[x[1]], minlength=x[2])


def places(chosen: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Places among the chosen of those buckets that are."""
    if not len(chosen):
        return np.zeros(0, np.int64)
    at = np.searchsorted(chosen, buckets)
    return at[chosen[np.minimum(at, len(chosen) - 1)] == buckets]


def held_out(key: Column) -> Column:
    """Rows kept for testing: crc32 of the number as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counted(rows: DataFrame, column: str, made: bool) -> DataFrame:
    """bucket, n: how many of the rows have each feature; -1 counts the rows. column: texts or, if made, feature lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, n, total = Features(), np.zeros(BUCKETS, np.int64), 0
        for whole in batches:
            for _, each in slices(whole, column):
                for x in each:
                    n[np.frombuffer(x, np.int32) if made else features(x)] += 1
                total += len(each)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(n[at], total), pa.int64())], names=["bucket", "n"])

    return rows.select(column).mapInArrow(freeing(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _sample(docs: DataFrame, key: str, text: str, rows: int) -> DataFrame:
    """k, h, buckets and marks of the first rows of docs in the order of a hash of the key, at most so many."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for whole in batches:
            for batch, texts in slices(whole, "text"):
                made = [features(t) for t in texts]
                columns = [batch.column("k"), batch.column("h"), pa.array([b.tobytes() for b in made], pa.binary()), pa.array([marks(b) for b in made], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "h", "buckets", "marks"])

    first = F.broadcast(docs.select(key).distinct().orderBy(F.xxhash64(key), key).limit(rows))
    read = docs.join(first, key, "left_semi").select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    made = read.mapInArrow(freeing(run), f"k {kind}, h long, buckets binary, marks array<long>")
    return stage(made.orderBy(F.xxhash64("k"), "k", "h").limit(rows))


def _apart(sample: DataFrame) -> DataFrame:
    """The rows that are near copies of no earlier one, so that what a copied text alone says doesn't look like evidence."""
    order = F.struct(F.xxhash64("k").alias("x"), "k", "h")
    each = sample.select(order.alias("row"), F.explode("marks").alias("mark"))
    first = each.groupBy("mark").agg(F.min("row").alias("first"))
    copies = each.join(first, "mark").where(F.col("row") != F.col("first")).select("row.k", "row.h").distinct()
    return sample.join(copies, ["k", "h"], "left_anti")


def _places(sample: DataFrame, chosen: np.ndarray) -> list[np.ndarray]:
    """Of each row of a bounded sample, the places of its chosen features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [places(chosen, np.frombuffer(x, np.int32)).astype(np.int32).tobytes() for x in batch.column("buckets").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("h"), pa.array(rows, pa.binary())], names=["k", "h", "places"])

    kind = sample.schema["k"].dataType.simpleString()
    found = sample.select("k", "h", "buckets").mapInArrow(freeing(run), f"k {kind}, h long, places binary").orderBy(F.xxhash64("k"), "k", "h")
    with writing(sample.sparkSession):
        return [np.frombuffer(r[0], np.int32).astype(np.int64) for r in found.select("places").collect()]


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", toxic: int = TOXIC, unlabelled: int = UNLABELLED) -> NonNegativePU | None:
    """The model from labels outside the held-out part; None without toxic examples. The class prior is the toxic share of
    those labels. Nothing depends on the partitioning."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).alias("_toxic"))
    n, positive = known.agg(F.count("*"), F.sum(F.col("_toxic").cast("long"))).first()
    if not positive:
        return None
    docs = docs.select(key, text).where(F.col(key).isNotNull() & ~held_out(F.col(key)))
    examples = known.where("_toxic = 1").orderBy(F.xxhash64(key), key).limit(toxic).select(key)
    p = _sample(docs.join(F.broadcast(examples), key, "left_semi"), key, text, toxic)
    if p.isEmpty():
        unstage(p)
        return None
    u = _sample(docs, key, text, unlabelled)
    apart = stage(_apart(p).select("buckets"))
    seen = _counted(apart, "buckets", True).where(f"bucket < 0 or n >= {LEAST}").withColumnRenamed("n", "toxic")
    both = seen.join(_counted(docs, text, False), "bucket", "left").select("bucket", "toxic", F.coalesce("n", F.lit(0)).alias("n")).orderBy("bucket")
    with writing(docs.sparkSession):  # for its small batches
        both = both.toArrow()
    buckets, a, b = (both.column(c).to_numpy().astype(np.int64) for c in ("bucket", "toxic", "n"))
    prior = min(0.9, max(1e-3, positive / n))
    chosen = buckets[1:][choose(prior, a[1:], int(a[0]), b[1:], int(b[0]))]
    model = NonNegativePU(prior).fit(chosen, _places(p, chosen), _places(u, chosen))
    unstage(p, u, apart)
    return model


def score(docs: DataFrame, model: NonNegativePU | None, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for each whole text; an input column of that name is replaced."""
    keep = [c for c in docs.columns if c.lower() != out.lower()]
    weights = dict(zip(model.chosen.tolist(), model.w.tolist(), strict=True)) if model else {}
    base = model.b if model else -np.inf
    sent = docs.sparkSession.sparkContext.broadcast((weights, base))  # at most KEPT weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, base = sent.value
        watched = {*weights, *(fewer(b, n) for b in weights for n in TIMES)}
        known = Memo(lambda w: tuple([b for b in map(bucket, word_features(w)) if b in watched]), 300_000)  # the buckets with a weight that a word has

        def one(t: bytes) -> float:
            found = set(t.lower().split())
            hit = Counter(b for x in map(known.__getitem__, found) if x for b in x)
            there = {*hit, *(more(b, n) for b, c in hit.items() for n in TIMES if c >= n)}
            z = base + sum(weights[b] for b in sorted(there) if b in weights)
            return 0.0 if z == -np.inf else float(1 / (1 + np.exp(-min(700.0, max(-700.0, z)))))

        for whole in batches:
            for batch, texts in slices(whole, text):
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(map(one, texts), pa.float64())], names=[*keep, out])

    fields = [docs.schema[c] for c in keep]
    schema = type(docs.schema)([*fields]).add(out, "double")
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(freeing(run), schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of documents."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

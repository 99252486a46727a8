import re
from pathlib import Path

import brute
import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from stratalog.llm import near_dedup, secrets, toxicity
from stratalog.llm.common import freeing, release, scope, shared_dir, stage

SF = "/root/testdata/sf0.001"
WEAK_PATTERNS = [("weak_id", secrets._WEAK_ID, 1), ("weak_secret", secrets._WEAK_KEY, 1), ("weak_secret", secrets._MIXED, 0), ("endpoint", secrets._ENDPOINT, 0)]


def test_stages_do_what_the_plain_versions_do(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    scores = {r.doc_id: r.score for r in toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels)).collect()}
    kept = {r["doc_id"]: r["text"] for r in rows if scores[r["doc_id"]] < toxicity.CUT}
    copies = {}
    for d, t in kept.items():
        copies[t or ""] = max(d, copies.get(t or "", d))
    kept = {d: t for d, t in kept.items() if copies[t or ""] == d}
    near = brute.near_components(list(kept.items()), 80)
    kept = {d: brute.redacted(t, brute.all_spans(t, WEAK_PATTERNS, secrets.REACH)) if t is not None else None for d, t in kept.items() if near[d][1] == d}
    now = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        now = stage(step(spark, now, SF))
        assert now.columns == docs.columns, name
    assert {r.doc_id: r.text for r in now.collect()} == kept
    assert all(r.n_chars == len(r.text) for r in now.collect() if r.text is not None)
    pieces = corpus_pipeline.run(spark, SF).collect()
    tokenizer = brute.word_bpe()
    placed = {}
    for p in pieces:
        placed.setdefault(p.doc_id, []).append((p.start, p.length, p.ids_crc32))
    assert set(placed) == set(kept)
    for d, parts in placed.items():
        ids = brute.word_ids(tokenizer, kept[d])
        assert all(brute.crc(ids[s : s + n]) == c for s, n, c in parts) and sum(n for _, n, _ in parts) == len(ids)


def test_stages_take_empty_tables_and_odd_rows(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _toxicity string, k string"
    odd = spark.createDataFrame([(1, None, None, None, None, None, "a"), (2, "", "", "", 0, "x", None), (None, "a b", None, None, 3, None, None), (3, "a b", None, None, 3, None, None)], kinds)
    for docs in (odd, odd.limit(0)):
        for name, step in corpus_pipeline.STAGES:
            docs = stage(step(spark, docs, SF))
            assert name == "packing" or docs.columns == odd.columns
        docs.count()


def test_staged_tables_go_on_release(spark):
    import os

    other = stage(spark.range(3))
    with scope() as made:
        df = stage(spark.range(5))
    at = df._staged_at.removeprefix("file:")
    assert os.path.isdir(at) and at.startswith(shared_dir(spark).removeprefix("file:"))
    release(spark, made)
    assert not os.path.isdir(at) and other.count() == 3
    release(spark, made)  # nothing left to do


def test_near_stage_uses_the_stage_threshold():
    assert corpus_pipeline.PERCENT == 80 and near_dedup.SHINGLE == 5


def test_stages_leave_no_python_step_to_their_callers_write(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, step in corpus_pipeline.STAGES:
        with scope() as made:
            plan = step(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
        release(spark, made)
        assert "MapInArrow" not in plan, name


def test_training_sends_small_batches(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    seen, kind = [], type(docs)
    for name in ("toArrow", "collect"):
        def noted(self, f=getattr(kind, name)):
            if "MapInArrow" in self._jdf.queryExecution().executedPlan().toString():
                seen.append(int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")))
            return f(self)

        monkeypatch.setattr(kind, name, noted)
    toxicity.train(docs, labels)
    assert len(seen) == 3 and max(seen) <= 4 << 20


def test_maps_give_memory_back():
    def held():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    pins = []

    def run(batches):
        for batch in batches:
            blocks = [(bytearray(b"x" * 50_000), bytearray(b"x" * 1_000)) for _ in range(4_000)]
            pins.append([pin for _, pin in blocks])  # among them, so the heap doesn't shrink by itself
            del blocks
            yield batch

    batch = pa.RecordBatch.from_pydict({"x": [1]})
    before = held()
    assert list(run(iter([batch]))) == [batch] and held() - before > 150
    assert list(freeing(run)(iter([batch]))) == [batch] and held() - before < 50

import random

import brute
import pyarrow.parquet as pq
import pytest

from stratalog.llm import exact_dedup, near_dedup, substring_dedup
from stratalog.llm.components import components
from stratalog.llm.suffix_automaton import SuffixAutomaton

SF = "/root/testdata/sf0.001"


def documents(sf=SF):
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, k string")


# Exact


@pytest.mark.parametrize(("limit", "bits"), [(64 << 20, 64), (-1, 64), (-1, 2)])
def test_exact_groups(spark, limit, bits):
    long = "ab" * 9000
    texts = [None, "", "a", "a ", "A", "b", "b", long, long, long + "c", long[:-1] + "c", "é" * 5000, "é" * 5000, "é" * 4999 + "e", None]
    rows = list(enumerate(texts * 2))
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    found = {r.row.doc_id: r for r in exact_dedup.mark(frame(spark, rows), block=64, broadcast_bytes=limit, bits=bits).collect()}
    assert len(found) == len(rows)
    for d, t in rows:
        g, r = groups[t or ""], found[d]
        assert (r.keep_id, r.group_size, r.kept) == (max(g), len(g), d == max(g)), (d, t and t[:9])


def test_exact_with_equal_and_null_keys(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "c")]
    out = exact_dedup.mark(frame(spark, rows)).collect()
    kept = sorted((r.row.doc_id is not None, r.row.doc_id or 0, r.row.text) for r in out if r.kept)
    assert kept == [(False, 0, "b"), (True, 1, "a"), (True, 2, "c")]
    assert sorted(r.group_size for r in out) == [1, 2, 2, 3, 3, 3]
    assert exact_dedup.mark(frame(spark, rows).limit(0)).count() == 0
    assert exact_dedup.dedup(frame(spark, [(i, "same") for i in range(50)])).collect()[0].doc_id == 49


def test_exact_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a", 7, "q", 1.0, 5), (2, "a", 8, "r", 2.0, 6)], "doc_id long, text string, rid long, name string, h double, `level.x` long")
    out = exact_dedup.dedup(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(2, "a", 8, "r", 2.0, 6)]


# Near


def check_near(rows, docs, percent):
    want = brute.near_components(docs, percent)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r[1], r[2], r[3]) == (*want[r[0]], want[r[0]][1] == r[0]), r


def varied(rng, base, share):
    out = list(base)
    for i in range(len(out)):
        if rng.random() < share:
            out[i] = "w%d" % rng.randrange(10_000)
    return out


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(12):
        base = ["w%d" % rng.randrange(3000) for _ in range(rng.randrange(6, 200))]
        for _ in range(8):
            n += rng.randrange(1, 4)
            rows.append((n, " ".join(varied(rng, base, rng.choice([0, 0.005, 0.01, 0.03])))))
    rows += [(5000 + i, t) for i, t in enumerate([None, "", "  \n", "a", "A", "a b", "B a", "one two three four five", "ONE two\tthree\nfour  five", "one two three four five six", "x " * 3000, "x " * 2500])]
    return rows


@pytest.mark.parametrize(("percent", "chunk", "limit"), [(85, 512, 64 << 20), (80, 3, -1)])
def test_near_components(spark, near_rows, percent, chunk, limit):
    out = near_dedup.mark(frame(spark, near_rows), percent=percent, chunk=chunk, around=chunk, broadcast_bytes=limit)
    check_near([(r.k, r.n_shingles, r.component_id, r.kept) for r in out.collect()], near_rows, percent)


def test_near_query(spark):
    docs = documents()
    check_near([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.op6_near_dedup(spark, SF).collect()], docs, 85)


def test_near_drops_all_but_the_smallest(spark, near_rows):
    want = brute.near_components(near_rows, 80)
    out = near_dedup.dedup(frame(spark, near_rows), percent=80)
    assert out.columns == ["doc_id", "text", "k"]
    assert sorted(r.doc_id for r in out.collect()) == sorted(d for d, (_, c) in want.items() if d == c)


def test_near_with_null_keys_repeats_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (7, text), (7, text), (9, text + " end"), (None, "other words are here now"), (None, None), (3, None)]
    out = [(r.k, r.component_id, r.kept) for r in near_dedup.mark(frame(spark, rows)).collect()]
    assert sorted(out, key=str) == sorted([(None, 7, False), (7, 7, True), (7, 7, True), (9, 7, False), (None, None, True), (None, None, True), (3, 3, True)], key=str)
    assert near_dedup.mark(frame(spark, rows).limit(0)).count() == 0
    assert near_dedup.mark(frame(spark, [(1, None), (2, "")])).count() == 2


def test_large_group_of_near_copies_is_one_component(spark):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(900):
        said = list(base)
        said[i % 120] = f"v{i}"
        rows.append((i, " ".join(said)))
    out = near_dedup.mark(frame(spark, rows), chunk=64).collect()
    assert {r.component_id for r in out} == {0} and sum(r.kept for r in out) == 1


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5000, 5000 + i) for i in range(100)]
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in links if a != b for x in (a, b)}
    out = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert out == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# Substrings


def test_automaton_against_search():
    rng = random.Random(2)
    for _ in range(40):
        texts = [[rng.randrange(4) for _ in range(rng.randrange(1, 30))] for _ in range(6)]
        labels = [rng.randrange(100) for _ in texts]
        a = SuffixAutomaton()
        for t, x in zip(texts, labels, strict=True):
            a.add(t, x)
        a.finish()
        asked = [rng.randrange(5) for _ in range(40)]
        holds = lambda part: [x for t, x in zip(texts, labels, strict=True) if any(t[i : i + len(part)] == part for i in range(len(t) - len(part) + 1))]  # noqa: B023, E731
        want = [max(n for n in range(i + 1) if not n or holds(asked[i - n : i])) for i in range(1, 41)]
        assert list(a.matching(asked)) == want
        for n in (1, 3, 5):
            assert list(a.windows(asked, n)) == [min(holds(asked[i : i + n]), default=None) for i in range(len(asked) - n + 1)]


def check_repeats(rows, docs):
    want = brute.without_repeats(docs)
    assert len(rows) == len(docs)
    for r in rows:
        n, kept = want[r[0]]
        assert (r[1], r[2]) == (n, n - len(kept)), r[0]
        assert r[3] == brute.sha(" ".join(kept)), r[0]


@pytest.mark.parametrize(("limit", "shard", "stream", "bits"), [(64 << 20, 100_000, 2_000, 64), (-1, 40, 2, 64), (64 << 20, 100_000, 2_000, 3)])
def test_repeated_windows_go(spark, limit, shard, stream, bits):
    rng = random.Random(4)
    passages = [[f"p{rng.randrange(60)}" for _ in range(rng.randrange(12, 70))] for _ in range(6)]
    rows = []
    for d in range(90):
        said = []
        for _ in range(rng.randrange(5)):
            said += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(8))]
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            said += p[a:] if rng.random() < 0.5 else p
        rows.append((d * 3 % 91, " ".join(said)))
    rows += [(200, None), (201, ""), (202, "a " * 13), (203, "a " * 12), (204, "a\t" * 30), (205, "A " * 13)]
    out = substring_dedup.remove_repeats(frame(spark, rows), broadcast_bytes=limit, shard=shard, stream=stream, bits=bits).collect()
    check_repeats([(r.k, r.n_words, r.n_removed, brute.sha(bytes(r.kept))) for r in out], rows)


def test_substring_query(spark):
    check_repeats([tuple(r) for r in substring_dedup.op10_substring_dedup(spark, SF).collect()], documents())


def test_substring_with_null_and_equal_keys(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(None, text), (4, text), (4, text), (6, "x " + text), (None, None)]
    out = sorted(((r.k, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()), key=str)
    assert out == sorted([(None, 20, 0), (4, 20, 0), (4, 20, 0), (6, 21, 20), (None, 0, 0)], key=str)
    assert substring_dedup.remove_repeats(frame(spark, rows).limit(0)).count() == 0

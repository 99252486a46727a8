import random

import brute
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from stratalog.llm import byte_bpe, pack_docs

PATH = public_tokenizers.path(byte_bpe.VOCABULARY)
TEXTS = [None, "", " ", "\n\n", "a", "a  b", " lead", "trail ", "it's they'll WE'RE", "x y z", "naïve café ÅÉ", "日本語 のテキスト", "🙂🙂 🏴", "<|endoftext|> here", "tab\tnew\r\nline", "a" * 5000, "word " * 3000, "0123456789" * 50, "=" * 999, "é combining", "\x00\x1c\x85 odd", "ǅ ɐ ſ K"]


@pytest.fixture(scope="module")
def sample():
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    rng = random.Random(5)
    noise = ["".join(rng.choice(" \n\t.,'’aAbéßя漢🙂019") for _ in range(rng.randrange(60))) for _ in range(300)]
    return TEXTS + noise + t.column("text").to_pylist()


def frame(spark, texts):
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, token_ids long")


def test_ids_are_those_of_the_ranks(spark, sample):
    encoding = brute.byte_bpe()
    df = byte_bpe.decode(byte_bpe.encode(frame(spark, sample), PATH, keep=["doc_id"]), PATH)
    rows = {r.doc_id: r for r in df.collect()}
    assert len(rows) == len(sample)
    for i, t in enumerate(sample):
        assert rows[i].token_ids == encoding.encode_ordinary(t or ""), t
        assert bytes(rows[i].decoded) == (t or "").encode()


def test_offsets_point_at_the_tokens(spark, sample):
    encoding = brute.byte_bpe()
    for r in byte_bpe.encode(frame(spark, sample[:200]), PATH, keep=["doc_id", "text"]).collect():
        data, text = (r.text or "").encode(), r.text or ""
        ends = [*r.token_bytes[1:], len(data)]
        assert [data[a:b] for a, b in zip(r.token_bytes, ends, strict=False)] == [encoding.decode_single_token_bytes(i) for i in r.token_ids]
        assert r.token_chars == [len(data[:b].decode("utf-8", "ignore")) for b in r.token_bytes]
        assert all(c < max(1, len(text)) for c in r.token_chars)


def test_streamed_text_holds_split_characters_back():
    bpe = byte_bpe.tokenizer(PATH)
    text = "🙂 日本 ok"
    parts = list(bpe.stream(bpe.ids(text).tolist()))
    assert "".join(parts) == text and "" in parts and "�" not in parts
    assert "".join(bpe.stream(bpe.ids("🙂").tolist()[:1])) == "�"


def test_clashing_columns_are_replaced_and_empty_tables_stay_empty(spark):
    df = byte_bpe.encode(frame(spark, ["a b", None]), PATH)
    assert df.columns == ["doc_id", "text", "token_ids", "token_bytes", "token_chars"]
    assert [len(r.token_ids) for r in df.orderBy("doc_id").collect()] == [2, 0]
    none = frame(spark, ["a"]).limit(0)
    assert byte_bpe.decode(byte_bpe.encode(none, PATH), PATH).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, token_ids array<int>")
    assert bytes(byte_bpe.decode(nulls, PATH).first().decoded) == b""


def test_odd_ids_stand_for_no_bytes(spark):
    df = spark.createDataFrame([(1, [64, None, 65]), (2, [-1, 64, 10**6]), (3, [None]), (4, [])], "Decoded long, token_ids array<int>")
    table = byte_bpe.byte_table(PATH)
    out = byte_bpe.decode(df.withColumnRenamed("Decoded", "i").withColumn("DECODED", df.token_ids), PATH)
    assert out.columns == ["i", "token_ids", "decoded"]
    assert {r.i: bytes(r.decoded) for r in out.collect()} == {1: table[64] + table[65], 2: table[64], 3: b"", 4: b""}


def test_query_of_ids(spark):
    encoding = brute.byte_bpe()
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    found = {r.doc_id: r for r in byte_bpe.op1_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(t)
    for d in t:
        ids = encoding.encode_ordinary(d["text"] or "")
        r = found[d["doc_id"]]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(d["text"] or ""))


def check_pieces(rows, texts, tokens=2048):
    """Every id in one piece, sequences gapless, within the limit, and how many places are padding."""
    tokenizer = brute.word_bpe()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids, at = brute.word_ids(tokenizer, texts[d]), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == brute.crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= tokens
        padding += 0 if at & (at - 1) == 0 else tokens - at
    return padding


def test_packing_keeps_every_id_without_padding(spark, sample):
    texts = dict(enumerate([*sample, "long text " * 40_000]))
    df = frame(spark, list(texts.values())).repartition(3)
    assert check_pieces(pack_docs.pack(df, public_tokenizers.path(pack_docs.VOCABULARY)).collect(), texts) == 0
    assert pack_docs.pack(df.limit(0), public_tokenizers.path(pack_docs.VOCABULARY)).count() == 0


def test_query_of_packing(spark):
    texts = {d["doc_id"]: d["text"] for d in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()}
    assert check_pieces(pack_docs.op2_packing(spark, "/root/testdata/sf0.001").collect(), texts) == 0


def test_conversations_are_packed_under_all_three_limits(spark):
    conversations = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = pq.read_table("/root/testdata/sf0.001/conversations.parquet").to_pylist()
    said = {(r["conv_id"], r["turn"]): r for r in rows}
    before = lambda c, t: said.get((c, t - 1), {"role": "assistant"})
    want = {f"{c}:{t}": (before(c, t)["text"] or "" if before(c, t)["role"] != "assistant" else "", r["text"] or "") for (c, t), r in said.items() if r["role"] == "assistant"}
    made = pack_docs.turns(conversations)
    assert {r.key: (r.prompt, r.answer) for r in made.collect()} == want
    limits = pack_docs.Limits(tokens=256, segments=5, loss=100)
    tokenizer, inside, ids = brute.word_bpe(), {}, {}
    for r in pack_docs.pack(made, public_tokenizers.path(pack_docs.VOCABULARY), limits, key="key", text="prompt", answer="answer", ids=True).collect():
        assert len(r.token_ids) == r.length and r.ids_crc32 == brute.crc(r.token_ids)
        inside.setdefault(r.sequence_id, []).append(r)
        ids.setdefault(r.key, []).append((r.start, r.token_ids))
    for k, (prompt, answer) in want.items():
        assert [i for _, part in sorted(ids[k]) for i in part] == [*brute.word_ids(tokenizer, prompt)[:-1], *brute.word_ids(tokenizer, answer)]
    bound = 0
    for parts in inside.values():
        bearing = sum(max(0, p.start + p.length - max(p.start, p.doc_tokens - len(brute.word_ids(tokenizer, want[p.key][1])))) for p in parts)
        assert sum(p.length for p in parts) <= 256 and len(parts) <= 5 and bearing <= 100
        bound += bearing == 100
    assert bound  # the third limit binds


def test_packing_keys_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (None, None, "y"), (1, "a b", "z")], "start long, text string, offset string")
    rows = pack_docs.pack(df, public_tokenizers.path(pack_docs.VOCABULARY), key="START").collect()
    assert {(r["_START"], r.doc_tokens) for r in rows} == {(None, 1), (1, 3)} and sum(r.length for r in rows) == 7


@pytest.mark.parametrize("cut", [True, False])
def test_packer_respects_all_limits(cut):
    rng = random.Random(9)
    limits = pack_docs.Limits(tokens=100, segments=4, loss=40)
    examples = []
    for i in range(800):
        n = rng.randrange(1, 60 if not cut else 350)
        examples.append((i, n, rng.randrange(0, min(n, 40 if not cut else n) + 1)))
    packer = pack_docs.Packer(limits, pool=64, cut=cut)
    pieces = [p for e in examples for p in packer.add(*e)] + list(packer.end())
    inside, placed = {}, {}
    for i, start, length, sequence, offset in pieces:
        inside.setdefault(sequence, []).append((offset, i, start, length))
        placed.setdefault(i, []).append((start, length))
    for i, n, _ in examples:
        at = 0
        for start, length in sorted(placed[i]):
            assert start == at
            at += length
        assert at == n and (cut or len(placed[i]) == 1)
    for rows in inside.values():
        rows.sort()
        assert [r[0] for r in rows] == [sum(x[3] for x in rows[:j]) for j in range(len(rows))]
        assert sum(r[3] for r in rows) <= limits.tokens and len(rows) <= limits.segments
        bearing = 0
        for _, i, start, length in rows:
            _, n, loss = examples[i]
            bearing += max(0, start + length - max(start, n - loss))
        assert bearing <= limits.loss


def test_packer_refuses_what_cannot_fit():
    with pytest.raises(ValueError):
        pack_docs.Limits(tokens=0) and pack_docs.Packer(pack_docs.Limits(tokens=0))
    packer = pack_docs.Packer(pack_docs.Limits(tokens=10), cut=False)
    with pytest.raises(ValueError):
        list(packer.add("x", 11, 0))
    with pytest.raises(ValueError):
        list(packer.add("x", 1, 2))

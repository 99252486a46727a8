"""Exact dedup by deterministic block naming, in DataFrame operations only.

Texts that may have an equal (their length and 64-bit hash occur twice at least) are cut into blocks of BLOCK bytes. The
distinct blocks, dealt by a hash and sorted within each part, get integer names (the part's number, then the rank in it); then
adjacent pairs of names get names of their own in the same way, again and again, until each document has one. Names stand
for contents one to one at every level, so equal (level, name) means equal text: hashes leave out texts that can have no
equal, and deal out blocks; they decide nothing. A block's name goes back to its places by the block's hash where that hash
has one block only (counted over all blocks), and by the block itself where several blocks share it.

Nothing is sampled or sent to the driver but counts. Hot groups: distinct blocks and group sizes come from aggregations with
map-side combine; names and groups go back to the rows by broadcasts of measured size or else by equi-joins, whose large
partitions adaptive execution splits; no group is ever gathered. Each level is a written table.

Null texts count as empty, and empty texts are equal to each other; texts of any length are compared whole. Of equal texts the
row with the largest key stays; of rows equal in that too, one; null keys are smaller than any. Columns of the input may have
any names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import BROADCAST_BYTES, keeping, measured, same_name, small, stage, table, unstage

BLOCK = 16_384


def _named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Integer names from 1 on of distinct rows, in sorted order within parts dealt by the first column; written, so they
    stay as they are."""
    return stage(distinct.repartition(by[0]).sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id() + 1), True)


def _identities(rows: DataFrame, block: int, limit: int, bits: int) -> DataFrame:
    """rid, level and name of each row of (rid, text): equal texts, and only those, have both in common."""
    data = F.col("text").cast("binary")
    blocks = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / F.lit(block))).cast("int")
    cut = rows.select("rid", blocks.alias("n"), F.posexplode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.substring(data, i * block + 1, F.lit(block)))).alias("at", "block"))
    cut = cut.withColumn("digest", F.shiftrightunsigned(F.xxhash64("block"), 64 - bits))
    names = _named(cut.select("digest", "block").distinct(), ["digest", "block"])
    times = stage(names.groupBy("digest").agg(F.count("*").alias("blocks"), F.max("name").alias("name")), True)
    clear = times.where("blocks = 1").select("digest", "name")
    held = [cut.select("rid", "n", "at", "digest").join(small(clear, limit, times), "digest").select("rid", "n", "at", "name")]
    unclear = times.where("blocks > 1").select("digest")
    if not unclear.isEmpty():
        several = cut.join(small(unclear, limit, times), "digest", "left_semi")
        held.append(several.join(names, ["digest", "block"]).select("rid", "n", "at", "name"))
    level, now, done = 0, stage(held[0] if len(held) == 1 else held[0].unionAll(held[1])), []
    unstage(names, times)
    while True:
        done.append(now.where(F.col("n") == 1).select("rid", F.lit(level).alias("level"), "name"))
        more = now.where(F.col("n") > 1)
        if more.isEmpty():
            break
        side = lambda odd: F.max(F.when(F.col("at") % 2 == odd, F.col("name")))
        pairs = stage(
            more.groupBy("rid", F.floor(F.col("at") / 2).cast("int").alias("at"))
            .agg(F.ceil(F.max("n") / 2).cast("int").alias("n"), side(0).alias("a"), F.coalesce(side(1), F.lit(0)).alias("b"))
        )
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"])
        level, now = level + 1, stage(pairs.join(small(names, limit), ["a", "b"]).select("rid", "n", "at", "name"))
        unstage(pairs, names)
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def mark(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, broadcast_bytes: int = BROADCAST_BYTES, bits: int = 64) -> DataFrame:
    """row (a struct of all of docs' columns), keep_id, group_size, kept. bits: of the blocks' hashes, fewer in tests only."""
    limit, own = broadcast_bytes, F.col("row").getField(same_name(docs.columns, key))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("size", F.octet_length("text"))
    with keeping(docs.sparkSession) as kept:
        again = stage(rows.groupBy("h", "size").agg(F.count("*").alias("times")).where("times > 1").select("h", "size"), True)
        side = small(again, limit)
        alone = rows.join(side, ["h", "size"], "left_anti")
        out = alone.select("row", own.alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
        if not measured(again)[0]:
            kept.append(again)
            return out
        maybe = stage(rows.join(side, ["h", "size"], "left_semi").select(F.monotonically_increasing_id().alias("rid"), "row"))
        texts = maybe.select("rid", F.coalesce(F.col("row").getField(same_name(docs.columns, text)), F.lit("")).alias("text"))
        named = stage(_identities(texts, block, limit, bits))
        identity = stage(named.join(maybe.select("rid", own.alias("k")), "rid"))
        groups = stage(identity.groupBy("level", "name").agg(F.max(F.struct("k", "rid")).alias("best"), F.count("*").alias("group_size")).select("level", "name", F.col("best.k").alias("keep_id"), F.col("best.rid").alias("best"), "group_size"), True)
        judged = stage(identity.join(small(groups, limit), ["level", "name"]).select("rid", "keep_id", "group_size", (F.col("rid") == F.col("best")).alias("kept")), True)
        kept += [again, maybe, judged]
    return out.unionAll(maybe.join(small(judged, limit), "rid").select("row", "keep_id", "group_size", "kept"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts."""
    return mark(docs, key, text).where("kept").select("row.*")


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept and the SHA-256 of the text of every row of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark(docs).select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", _digest(F.col("row.text")).alias("text_sha256"))


ORACLE = """select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept,
  sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))"""

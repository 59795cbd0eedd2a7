"""Sharding by the law `bytes`: a minimax contiguous partition of ordered groups of equal texts."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriskill.llm.common import written

HEX = 3  # leading hex digits of a group's key that name its block: 4,096 blocks, whatever the input


def _reach(groups: DataFrame, offsets: list[int], blocks: list[str], targets: dict[int, int]) -> dict[int, tuple[int, str]]:
    """For each asked capacity, the last group that ends at or before its target: (bytes up to it, its key)."""
    rows = {i: (bisect_right(offsets, t) - 1, t) for i, t in targets.items()}
    ask = ", ".join(f"({i}, '{blocks[b]}', {t - offsets[b]}L)" for i, (b, t) in rows.items())
    asked = groups.sparkSession.sql(f"SELECT * FROM VALUES {ask} AS v(i, block, most)")
    got = groups.join(F.broadcast(asked), "block").where("upto <= most").groupBy("i").agg(F.max(F.struct("upto", "key")).alias("m"))
    found = {r.i: (offsets[rows[r.i][0]] + r.m.upto, r.m.key) for r in got.collect()}
    return {i: found.get(i, (offsets[b], blocks[b])) for i, (b, _) in rows.items()}


def cut_keys(groups: DataFrame, shards: int, levels: int = 6) -> tuple[int, list[str]]:
    """Smallest feasible capacity and the keys after which shards end.

    `groups` holds block, key, bytes and upto (bytes of the block's groups up to and with this one, by key). The
    driver holds one number for each of the 4,096 blocks. The binary search runs `levels` halvings at a time: the
    2^levels - 1 capacities they could ask for are checked together, greedily, one Spark job for each shard.
    """
    sums = sorted((r.block, r.b, r.g) for r in groups.groupBy("block").agg(F.max("upto").alias("b"), F.max("bytes").alias("g")).collect())
    blocks, offsets, total = [b for b, _, _ in sums], [], 0
    for _, b, _ in sums:
        offsets.append(total)
        total += b

    def greedy(capacities: list[int]) -> dict[int, list[tuple[int, str]]]:
        ends: dict[int, list[tuple[int, str]]] = {c: [(0, "")] for c in capacities}
        for _ in range(shards - 1):
            at = _reach(groups, offsets, blocks, {i: min(ends[c][-1][0] + c, total) for i, c in enumerate(capacities)})
            for i, c in enumerate(capacities):
                ends[c].append(at[i])
        return ends

    largest = max(g for _, _, g in sums)
    low, high = max(-(-total // shards), largest), -(-total // shards) + largest  # high is always feasible
    best: dict[int, list[tuple[int, str]]] = {}
    while low < high or not best:
        span = high - low
        asked = sorted({low, high, *(low + span * k // 2**levels for k in range(1, 2**levels))}) if span else [low]
        ends = greedy(asked)
        fits = [c for c in asked if total - ends[c][-1][0] <= c]
        high = fits[0]
        best = {high: ends[high]}
        low = max([low, *(c + 1 for c in asked if c < high)])
    return high, [key for _, key in best[high][1:]]


def shard_documents(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", cells: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, for every row of `docs`.

    Groups of equal texts stay together. They are ordered by the SHA-256 of their text, and the order is cut where
    the largest shard is smallest. Sizes meet in partial sums, a document finds its shard by comparing its key with
    shards - 1 literals, and slots are numbered in `cells` parts of each shard, so that a text that a third of all
    rows hold stays in no single task. The last shard may be smaller than the others by what the cuts leave over.

    A null text counts as an empty one (size 1, CRC 0). Repeated rows get a slot each. Very many equal texts can
    make one shard large, since they stay together. Other columns are dropped; an empty table gives an empty frame.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    slim = written(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"), F.sha2(body, 256).alias("key")), "sizes")
    sized = slim.groupBy("key").agg(F.sum("size").alias("bytes")).withColumn("block", F.substring("key", 1, HEX))
    groups = written(sized.withColumn("upto", F.sum("bytes").over(Window.partitionBy("block").orderBy("key"))), "groups")
    cuts = cut_keys(groups, shards)[1] if groups.limit(1).count() else []
    shard = F.lit(0)
    for key in cuts:
        shard = shard + (F.col("key") > key).cast("int")
    placed = slim.withColumn("shard", shard.cast("int")).withColumn("cell", (F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", "text_crc32")), 1, 4), 16, 10).cast("int") % cells).cast("int"))
    counts = placed.groupBy("shard", "cell").count()
    before = counts.select("shard", "cell", (F.sum("count").over(Window.partitionBy("shard").orderBy("cell")) - F.col("count")).alias("before"))
    slot = F.col("before") + F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "key")) - 1
    return placed.join(F.broadcast(before), ["shard", "cell"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

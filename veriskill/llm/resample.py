"""Target-distribution importance resampling: draws documents by how much more their word runs are the target's than the corpus's.

Each run of one to MOST_WORDS words is a feature and falls into a bucket by its CRC-32. A bucket's gain compares its share of the
target with its share of the corpus; a document's weight is the mean gain of its features, and the highest weights with
Gumbel noise are drawn, which is a sample without replacement in proportion to exp(weight).

A CRC is linear but for its length: that of a span is the XOR, over its bytes, of what a byte contributes at its distance from
the end, and of a constant of the length. The contributions stand in a table by distance and byte, so all features of many
texts are hashed by one gather and one `bitwise_xor.reduceat`. Spans longer than the table are cut into blocks from the end, whose
values are folded from the first block to the last.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriskill.llm.common import ALNUM, arrow_stage, written

MOST_WORDS, BUCKETS = 2, 10_000
SEED, PERCENT, LEAST_WORDS = 7, 25, 20
DEPTH = 64  # distances from the end in the table, and bytes of a block
SLICE = 1 << 17  # bytes of text that are hashed together, or one text


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What each byte contributes at each distance from the end; what each byte of a CRC becomes DEPTH zero bytes later."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    later = lambda x: (x >> np.uint32(8)) ^ one[x & np.uint32(255)]
    by_distance = [one]
    for _ in range(DEPTH - 1):
        by_distance.append(later(by_distance[-1]))
    fold = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for _ in range(DEPTH):
        fold = later(fold)
    return np.concatenate(by_distance), fold


CONTRIBUTION, FOLD = _tables()
CONSTANT = np.array([zlib.crc32(bytes(n)) for n in range(DEPTH + 1)], np.uint32)


def _reduced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XOR of the contributions of each span's bytes; no span is empty or longer than DEPTH."""
    size = end - start
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(start - first, size)
    cell = (np.repeat(end - 1, size) - at) << 8
    cell += data[at]
    return np.bitwise_xor.reduceat(CONTRIBUTION[cell], first)


def span_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of every span `data[start:end]` of uint8; spans may overlap, none is empty."""
    size = end - start
    out = np.zeros(len(start), np.uint32)
    if len(short := np.flatnonzero(size <= DEPTH)):
        out[short] = _reduced(data, start[short], end[short]) ^ CONSTANT[size[short]]
    if len(long := np.flatnonzero(size > DEPTH)):
        blocks = -(-size[long] // DEPTH)
        after = np.cumsum(blocks)
        of = np.repeat(np.arange(len(long)), blocks)
        left = np.repeat(after, blocks) - np.arange(after[-1])  # blocks up to the end, its own included
        stop = end[long][of] - (left - 1) * DEPTH
        value = _reduced(data, np.maximum(start[long][of], stop - DEPTH), stop)
        state = value[after - blocks]
        for k in range(1, int(blocks.max())):
            go = np.flatnonzero(blocks > k)
            s = state[go]
            state[go] = FOLD[0][s & 255] ^ FOLD[1][(s >> 8) & 255] ^ FOLD[2][(s >> 16) & 255] ^ FOLD[3][s >> 24] ^ value[(after - blocks)[go] + k]
        out[long] = state ^ np.array([_zeros(n) for n in size[long].tolist()], np.uint32)
    return out


def _zeros(n: int) -> int:
    out = 0
    for _ in range(n // SLICE):
        out = zlib.crc32(bytes(SLICE), out)
    return zlib.crc32(bytes(n % SLICE), out)


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words of each text, text number of each feature, CRC of each feature) for slices of `texts` in their order."""
    group: list[list[bytes]] = []
    held = at = 0
    for k, text in enumerate(texts):
        words = (text or "").encode().translate(ALNUM).split()
        group.append(words)
        held += sum(map(len, words)) + len(words)
        if held >= SLICE or k == len(texts) - 1:
            data = np.frombuffer(b" ".join(b" ".join(w) for w in group if w), np.uint8)
            n_words = np.array([len(w) for w in group])
            size = np.array([len(x) for w in group for x in w], np.int64)
            end = np.cumsum(size + 1) - 1
            start, own = end - size, np.repeat(np.arange(len(group)), n_words)
            owners, starts, ends = [], [], []
            for n in range(1, MOST_WORDS + 1):
                inside = np.flatnonzero(own[: len(own) - n + 1] == own[n - 1 :])
                owners.append(own[inside] + at)
                starts.append(start[inside])
                ends.append(end[inside + n - 1])
            owner = np.concatenate(owners)
            yield n_words, owner, span_crcs(data, np.concatenate(starts), np.concatenate(ends)) if len(owner) else np.zeros(0, np.uint32)
            at += len(group)
            group, held = [], 0


def _pieces(batch: pa.RecordBatch) -> Iterator[list[str | None]]:
    """The batch's texts, a few at a time as Python strings."""
    column = batch.column("text")
    for at in range(0, len(column), 64):
        yield column.slice(at, 64).to_pylist()


def bucket_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; each task sends BUCKETS rows at most."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for texts in _pieces(batch):
                for _, _, crc in features(texts):
                    count += np.bincount(crc % BUCKETS, minlength=BUCKETS)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some])], names=["bucket", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(stage, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text") -> np.ndarray:
    """The gain of each bucket, BUCKETS whole numbers: floored thousandths of the log of smoothed shares, target over corpus."""
    buckets = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    held = buckets.join(bucket_counts(docs, text).withColumnRenamed("n", "s"), "bucket", "left").join(bucket_counts(target, target_text).withColumnRenamed("n", "t"), "bucket", "left")
    got = held.select("bucket", *(F.coalesce(c, F.lit(0)).alias(c) for c in "st")).collect()  # BUCKETS rows
    s, t = (np.array([r[c] for r in sorted(got)], float) for c in "st")
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean of the features' gains, 0 without any) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        words, number, weight = [], [], []
        for texts in _pieces(batch):
            total, many = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for n_words, owner, crc in features(texts):
                words.append(n_words)
                np.add.at(total, owner, shared.value[crc % BUCKETS])
                many += np.bincount(owner, minlength=len(texts))
            number.append(many)
            weight.append(total // np.maximum(many, 1))
        return {"doc_id": batch.column("doc_id"), "n_words": np.concatenate(words), "n_features": np.concatenate(number), "weight": np.concatenate(weight)}

    kind = docs.schema[doc_id].dataType.simpleString()
    return arrow_stage(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), each, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Adds score (weight and seeded Gumbel noise) and rank: 1, 2, 3... over the drawn rows, null for the others.

    Of the rows with at least `least_words` words, `percent` percent (floored) are drawn: the highest scores, ties to the
    smaller doc_id. They are sorted by ranges, so that no task sees all; a rank is the place in the range and the rows of
    the ranges before it, one number each. The noise hangs on seed and doc_id alone; a null doc_id counts as an empty one
    and comes first among ties.
    """
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weighed.withColumn("score", F.col("weight") + noise), "scored")
    able = F.col("n_words") >= least_words
    ordered = written(scored.where(able).orderBy(F.desc("score"), F.asc_nulls_first("doc_id")).withColumn("at", F.monotonically_increasing_id()), "ordered")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    ranges = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = ranges.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.floor(percent * F.sum("n").over(whole) / 100).alias("most"))
    rank = F.col("before") + place + 1
    ranked = ordered.withColumn("part", part).join(F.broadcast(before), "part")  # a row for each task of the sort
    ranked = ranked.withColumn("rank", F.when(rank <= F.col("most"), rank)).drop("part", "before", "most", "at")
    return ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("bigint")))


def importance_resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of `docs`; `rank` tells the drawn ones, see `draw`.

    The corpus is read twice: once for its bucket counts, once for the weights. Null and empty texts have no features and
    weight 0; very long texts and words are hashed whole; repeated rows are all counted, weighed and, as far as they
    score, drawn; an empty corpus gives an empty frame, an empty target equal smoothed shares. Other columns are dropped.
    """
    return draw(weigh(docs, bucket_gains(docs, target, text, target_text), doc_id, text), percent, least_words, seed)

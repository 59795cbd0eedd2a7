"""Benchmark decontamination: an FM-index for each training shard, searched backward for benchmark phrases."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from veriskill.llm.common import ALNUM, arrow_stage, written

WINDOW = 13  # words of a phrase
BLOCK = 4000  # benchmark items searched in one pass; further items take further passes over all rows
BLOCK_BYTES = 16 << 20  # of their texts, at most, or one item
SAMPLE = 8  # every so many-th text position of the index keeps its suffix position
FOUND = "n_words bigint, spans array<struct<a:bigint,b:bigint>>, items array<string>"
SHARE = 20  # contaminated where SHARE * hit words >= words


class FmIndex:
    """FM-index of a sequence of symbols 0..top; 0 stands at its end alone, 1 parts its pieces.

    The Burrows-Wheeler string is held as a wavelet tree: one rank array for each bit of a symbol, with the zeros of
    each level before its ones. All methods take arrays, and work on all queries at once.
    """

    def __init__(self, seq: np.ndarray, top: int):
        n = self.n = len(seq)
        rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
        step = 1
        while rank.max() < n - 1:  # prefix doubling, until no two suffixes are alike
            after = np.zeros(n, np.int64)
            after[:-step or None] = rank[step:] + 1
            rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64)
            step *= 2
        order = np.argsort(rank)
        last = seq[order - 1]  # position 0 is preceded by the end
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top + 1))])
        self.bits = max(1, int(top).bit_length())
        self.ranks: list[np.ndarray] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (last >> level) & 1
            self.ranks.append(np.concatenate([[0], np.cumsum(bit)]))
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        self.kept = np.full(n, -1, np.int64)
        chosen = order % SAMPLE == 0
        self.kept[chosen] = order[chosen]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the string before `at`."""
        low, high = np.zeros_like(at), at.copy()
        for level, ones in zip(range(self.bits - 1, -1, -1), self.ranks, strict=True):
            bit = (symbol >> level) & 1
            zeros = self.n - ones[-1]
            low, high = (np.where(bit == 1, zeros + ones[x], x - ones[x]) for x in (low, high))
        return high - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones in self.ranks:
            bit = ones[at + 1] - ones[at]
            out = out * 2 + bit
            at = np.where(bit == 1, self.n - ones[-1] + ones[at], at - ones[at])
        return out

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of equally long phrases (rows): suffix ranges [low, high)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, k]
            low, high = self.first[c] + self.rank(c, low), self.first[c] + self.rank(c, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix: steps back until one whose position is kept."""
        out, steps, rows = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64), rows.copy()
        open_ = np.arange(len(rows))
        while len(open_):
            at = self.kept[rows[open_]]
            out[open_] = np.where(at >= 0, at + steps[open_], -1)
            open_ = open_[at < 0]
            c = self.symbol(rows[open_])
            rows[open_] = self.first[c] + self.rank(c, rows[open_])
            steps[open_] += 1
        return out


@dataclass
class Phrases:
    """One block of the benchmark: its words, its word pairs, and its phrases by length, with their items."""

    ids: dict[bytes, int]
    pairs: np.ndarray
    least: int
    by_length: dict[int, tuple[np.ndarray, list[list[str]]]]

    @staticmethod
    def of(items: list[tuple[object, str | None]]) -> Phrases:
        ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        pairs: set[int] = set()
        for item, text in items:
            words = [ids.setdefault(w, len(ids) + 1) for w in (text or "").encode().translate(ALNUM).split()]
            pairs.update((a << 32) | b for a, b in zip(words, words[1:]))
            for k in range(max(1, len(words) - WINDOW + 1) if words else 0):
                owners.setdefault(tuple(words[k : k + WINDOW]), set()).add(str(item))
        by: dict[int, list[tuple[int, ...]]] = {}
        for p in owners:
            by.setdefault(len(p), []).append(p)
        return Phrases(ids, np.array(sorted(pairs), np.int64), min(by, default=0), {n: (np.array(ps, np.int64), [sorted(owners[p]) for p in ps]) for n, ps in by.items()})


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_spans(texts: list[str | None], phrases: Phrases) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
    """Words of each text, merged [first, after) word spans inside phrases, and the items found.

    Only runs of words whose neighbours also stand side by side in the benchmark, and long enough for the shortest
    phrase, can hold one; the index is built over those runs of the batch.
    """
    counts, spans, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
    parts, docs, starts, size = [], [], [], 0
    get = phrases.ids.get
    for d, text in enumerate(texts):
        words = (text or "").encode().translate(ALNUM).split()
        counts[d] = len(words)
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        known = np.flatnonzero(ids)
        if len(known) < max(1, phrases.least):
            continue
        tied = np.zeros(len(ids) + 1, bool)  # tied[i]: word i goes on from word i - 1
        near = known[:-1][np.diff(known) == 1]
        if len(near) and len(phrases.pairs):
            pair = (ids[near] << 32) | ids[near + 1]
            at = np.minimum(np.searchsorted(phrases.pairs, pair), len(phrases.pairs) - 1)
            tied[near[phrases.pairs[at] == pair] + 1] = True
        first = known[~tied[known]]
        ends = known[~tied[known + 1]] + 1
        for a, b in zip(first, ends):
            if b - a >= phrases.least:
                parts += [ids[a:b] + 1, np.ones(1, np.int64)]
                docs.append(d)
                starts.append((size, a))
                size += b - a + 1
    if not parts:
        return counts, spans, items
    seq = np.concatenate([*parts, np.zeros(1, np.int64)])
    index = FmIndex(seq, int(seq.max()))
    at0 = np.array([s for s, _ in starts])
    for length, (rows, owners) in phrases.by_length.items():
        able = np.flatnonzero(rows.max(axis=1) + 1 < len(index.first) - 1)
        low, high = index.ranges(rows[able] + 1)
        n = high - low
        which = np.repeat(able, n)
        where = index.locate(np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        part = np.searchsorted(at0, where, side="right") - 1
        for p, k, x in zip(which, part, where):
            d, a = docs[k], starts[k][1] + int(x) - starts[k][0]
            spans[d].append((a, a + length))
            items[d].update(owners[p])
    return counts, [_merge(s) for s in spans], items


def _spans(docs: DataFrame, text: str, phrases: Broadcast, key: str | None = None) -> DataFrame:
    """`docs` with n_words, spans and items of one block's phrases; with `key`, key, n_words, spans and items only."""
    kept = docs.columns if key is None else [key]
    ddl = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        counts, spans, items = find_spans(batch.column(text).to_pylist(), phrases.value)
        return {c: batch.column(c) for c in kept} | {"n_words": counts, "spans": [[{"a": a, "b": b} for a, b in s] for s in spans], "items": [sorted(x) for x in items]}

    return arrow_stage(docs, each, f"{ddl}, {FOUND}")


def _merged(parts: DataFrame, key: str) -> DataFrame:
    """(key, n_words, spans, items) of rows whose spans come from several blocks; a row has one part of each block at most."""
    kind = parts.schema[key].dataType.simpleString()
    rows = parts.groupBy(key).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        whole = [_merge([(x["a"], x["b"]) for x in v]) for v in batch.column("spans").to_pylist()]
        return {c: batch.column(c) for c in (key, "n_words", "items")} | {"spans": [[{"a": a, "b": b} for a, b in s] for s in whole]}

    return arrow_stage(rows, each, f"`{key}` {kind}, {FOUND}")


def match_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """`docs` with n_words, spans (merged word spans inside benchmark phrases) and items (found items, sorted).

    A phrase is `WINDOW` consecutive words of an item, or all of an item of fewer. Each Arrow batch of texts is one
    training shard with an index of its own, so a lost task is built again alone. The benchmark is a stated query set
    that goes to the tasks in blocks of `block` items and BLOCK_BYTES bytes, one in the driver at a time. One block is one
    narrow pass. Where there are more, `docs` are written once with a row number, every block is a narrow pass over number
    and text that keeps the rows with a hit, and what all of them found comes back to the rows by one join.

    Null and empty texts have no words and no spans; null items are skipped; a null or empty item text gives no
    phrase; repeated rows are each answered; columns of `docs` named as those added are replaced.
    """
    items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id), F.col(item_text)).orderBy(item_id).toLocalIterator()
    spark = docs.sparkSession
    base = docs.drop(*({"n_words", "spans", "items"} & set(docs.columns)))
    blocks = _blocks(items, block)
    part, more = next(blocks), next(blocks, None)
    if more is None:
        return _spans(base, text, spark.sparkContext.broadcast(Phrases.of(part)))
    keyed = written(base.withColumn("__row", F.monotonically_increasing_id()), "keyed")  # written: numbers stay as they are
    texts, found, counted = keyed.select("__row", text), None, None
    for part in itertools.chain([part, more], blocks):
        phrases = spark.sparkContext.broadcast(Phrases.of(part))
        rows = _spans(texts, text, phrases, "__row")
        if counted is None:  # the first pass keeps every row's number of words
            counted = written(rows, "matched")
            found = counted.where(F.size("spans") > 0)
        else:
            found = found.unionByName(written(rows.where(F.size("spans") > 0), "matched"))
        phrases.unpersist()
    whole = _merged(found, "__row").drop("n_words")
    none = [F.array().cast(t).alias(c) for c, t in (("spans", "array<struct<a:bigint,b:bigint>>"), ("items", "array<string>"))]
    out = keyed.join(counted.select("__row", "n_words"), "__row").join(whole, "__row", "left")
    return out.select(*base.columns, "n_words", *(F.coalesce(c, n).alias(c) for c, n in zip(("spans", "items"), none)))


def _blocks(items: Iterator[Row], most: int) -> Iterator[list[tuple[object, str | None]]]:
    """Items in blocks of at most `most` items and BLOCK_BYTES bytes; one empty block where there is none."""
    block: list[tuple[object, str | None]] = []
    held = 0
    for r in items:
        size = len((r[1] or "").encode())
        if block and (len(block) == most or held + size > BLOCK_BYTES):
            yield block
            block, held = [], 0
        block.append((r[0], r[1]))
        held += size
    yield block


def contamination(matched: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated to the result of `match_benchmark`."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["b"] - x["a"])
    return matched.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("bigint")).withColumn("items_sha256", F.sha2(F.concat_ws(",", "items"), 256)).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))

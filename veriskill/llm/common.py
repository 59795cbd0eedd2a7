"""What several operators share: reading, scratch tables, Arrow stages and word hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriskill.scratch import _MADE, drop_scratch, scratch_path, shared_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_column(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def let_go() -> None:
    """Gives memory that a finished task no longer holds back to the system, as worker processes live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slabs(batch: pa.RecordBatch, text: str | None, most: int) -> Iterator[pa.RecordBatch]:
    """`batch` in slices that hold at most `most` bytes of the column `text`, or one row; whole where `text` is None."""
    if text is None:
        yield batch
        return
    at, held = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
        if k > at and held + n > most:
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += n
    yield batch.slice(at)


def arrow_stage(df: DataFrame, each: Callable[[pa.RecordBatch], dict[str, object]], schema: str, text: str | None = None, most: int = 0) -> DataFrame:
    """One Arrow pass: `each` turns a record batch into columns named as in `schema` (DDL).

    With `text`, batches are cut by the bytes of that column first (`slabs`) and each slab's result leaves before the
    next is made, so that memory follows the slab on either side of the pass.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch, text, most) if batch.num_rows else ():
                cols = each(slab)
                yield pa.RecordBatch.from_arrays([as_column(cols[f.name], f.type) for f in target], schema=target)
                del slab, cols
            del batch
            if text is not None:
                let_go()
        let_go()

    return df.mapInArrow(stage, schema)


def hashed_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """All of `df`, or of more than `rows` rows that many at most, chosen by the hash of `key`; nothing is sorted."""
    n = df.count()
    if n <= rows:
        return df
    share = max(1.0, rows - 5 * rows**0.5) / n  # so far below that the limit does not bite
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int(share * (1 << 40))).limit(rows)


BITMAP_WORDS = 1 << 17  # words of 64 bits: what is broadcast has this many rows at most, whatever the input


def probably_in(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of `df` whose `key` falls on a bit that a key of `wanted` sets: none of those wanted is lost.

    For use before a join by `key`, which drops the few others: rows without a partner are then not shuffled. With
    very many keys most bits are set, and the join sees all rows as it would have without. Null keys have a bit too.
    """
    slot = F.expr(f"cast(pmod(shiftright(xxhash64(`{key}`), 6), {BITMAP_WORDS}) as int)")
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), 64) as int))")
    words = wanted.select(slot.alias("__slot"), bit.alias("bit")).groupBy("__slot").agg(F.bit_or("bit").alias("__word"))
    return df.withColumn("__slot", slot).join(F.broadcast(words), "__slot").where(F.col("__word").bitwiseAND(bit) != 0).drop("__slot", "__word")


#: bytes.translate tables: A-Z lower-cased only, and the same with every ASCII byte outside [0-9a-z] as a space.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM = bytes(LOWER[b] if b > 127 or chr(LOWER[b]).isalnum() else 32 for b in range(256))

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); wraps silently."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random-looking value for each byte.
BYTE = mix(np.arange(256, dtype=np.uint64) + _ODD)


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown on demand.

    For short stretches that something else tells apart in the end: modulo 2^64 every base gives equal hashes to some
    different strings of 512 bytes and more (those of Thue and Morse).
    """

    def __init__(self, base: int = 0xD1342543DE82EF95):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (self.base, self.inverse))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of which `span` makes hashes of any stretch of `data` (uint8)."""
        self.to(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * self.up[: len(data)], out=out[1:])
        return out

    def span(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64) * _ODD)


#: True for the bytes \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(data: np.ndarray, is_space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes that are no white space."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = is_space[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


#: Of the eight bytes read for what is left of a word, those that belong to it.
_OWN = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG = 64  # bytes from which on a word is hashed by xxh3


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words `data[start:end]` (uint8), eight bytes of all words at a time."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = end - start
    out = mix(size.astype(np.uint64) * _ODD ^ (eight[start] & _OWN[np.minimum(size, 8)]))
    rest = np.flatnonzero((size > 8) & (size <= _LONG))
    at = 8
    while len(rest):
        out[rest] = mix(out[rest] + _ODD ^ (eight[start[rest] + at] & _OWN[np.minimum(size[rest] - at, 8)]))
        at += 8
        rest = rest[size[rest] > at]
    for k in np.flatnonzero(size > _LONG):
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes())
    return out


def lengths_to_list(values: np.ndarray, lengths: list[int], kind: pa.DataType) -> pa.Array:
    """An Arrow list array from flat values and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values, type=kind))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected `edges`: (node, comp), comp the least node reachable.

    Hash-min with pointer jumping; every round is joins and partial aggregates over a written table, so that no
    node's neighbours meet in one task. Empty edges give an empty frame.
    """
    both = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).where("u <> v").distinct(), "edges")
    label = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("comp")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("v"), F.col("comp").alias("c")), "v").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("c"))
        step = label.join(near, "node").select("node", "comp", F.least("comp", "c").alias("c"))
        jump = label.select(F.col("node").alias("c"), F.col("comp").alias("cc"))
        new = written(step.join(jump, "c").select("node", F.least("c", "cc").alias("new"), (F.least("c", "cc") < F.col("comp")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        label = new.select("node", F.col("new").alias("comp"))
        if not moved:
            return label

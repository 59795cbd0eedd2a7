"""Suffix-array dedup: removes every byte inside a long string that also starts elsewhere, blockwise.

Suffixes are looked at through their first WIDTH bytes. Each has an anchor (the least 32-gram hash of these bytes) and a
distance from it, so equal suffixes agree in both. Neighbouring suffixes with one anchor and distances in one range of
`stride` make a piece; the bytes that all suffixes of such a range have in common are its core, whose hash names the
suffix bucket. So equal suffixes share a bucket, and a bucket with one piece only is dropped at once.

Pieces with equal bytes are one kind, told by 128 bits of hash; a kind that occurs twice is repeated from end to end,
and a copied passage is never sorted for its copies. A bucket of several kinds is sorted, a block of buckets at a time:
by the first bytes, ties by the ranks of the nearest position of a difference cover, which were found beforehand by
prefix doubling over the cover's positions only. Memory follows the block. Equal suffixes stand at one distance from the
core, and cores are laid at multiples of the cover's period, so only suffixes of one residue are compared, and these
reach the cover by the same step. A bucket with more kinds than a block holds is cut again by a narrower stride, down to
one suffix for each piece, where a bucket has one kind only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriskill.llm.common import Powers, arrow_stage, mix, probably_in, written

WIDTH, GRAM = 400, 32
SLICE = 1 << 18  # bytes of texts looked at together; longer texts are cut with an overlap
BLOCK = 2 << 20  # bytes of suffix text that are sorted together
STRIDE = 192  # widest range of distances from the anchor in one piece
KINDS = 256  # kinds of one bucket that are sorted together; a bucket of more is cut by a stride an eighth as wide
PERIOD, COVER = 16, (0, 1, 2, 5, 8)  # every difference modulo 16 is one of two elements of the cover
STEP = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])
SEEN = "r1 bigint, r2 bigint, at bigint, starts int, lead int, key bigint, c1 bigint, c2 bigint"


def _pieces(raws: list[bytes], width: int, stride: int, powers: Powers) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, first start, starts, core's distance from the first start, bucket, content hashes) of each piece."""
    group: list[tuple[int, int, bytes]] = []
    held = 0
    for k, raw in enumerate(raws):
        for at in range(0, len(raw) - width + 1, SLICE):
            part = raw[at : at + SLICE + width - 1]
            if held + len(part) > 2 * SLICE and group:
                yield _group_pieces(group, width, stride, powers)
                group, held = [], 0
            group.append((k, at, part))
            held += len(part)
    if group:
        yield _group_pieces(group, width, stride, powers)


def _group_pieces(group: list[tuple[int, int, bytes]], width: int, stride: int, powers: Powers) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
    size = np.array([len(p) for _, _, p in group])
    begin = np.cumsum(size) - size
    prefix = powers.prefix(data)
    gram = min(GRAM, width // 2)
    grams = prefix[gram:] - prefix[: len(prefix) - gram]
    grams *= powers.down[: len(grams)]
    least = grams * np.uint64(0xBF58476D1CE4E5B9)
    least &= ~np.uint64(0xFFFFFF)
    least |= np.arange(len(least), dtype=np.uint64)  # ties: the leftmost
    reach, window = 1, width - gram + 1
    while reach * 2 <= window:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if window > reach:
        least = np.minimum(least[: len(least) - (window - reach)], least[window - reach :])
    count = size - width + 1
    starts = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
    own = np.repeat(np.arange(len(group)), count)
    anchor = (least[starts] & np.uint64(0xFFFFFF)).astype(np.int64)
    block = (anchor - starts) // stride
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1]) | (own[1:] != own[:-1])]))
    length = np.diff(np.concatenate([first, [len(starts)]]))
    at, block = starts[first], block[first]
    core = anchor[first] - block * stride
    key = mix(powers.span(prefix, core, core + (width - stride + 1)) + block.astype(np.uint64))
    end = at + length + (width - 1)
    number, offset = np.array([k for k, _, _ in group]), np.array([a for _, a, _ in group])
    of = own[first]
    whole = memoryview(data)
    name = np.frombuffer(b"".join(xxhash.xxh3_128_digest(whole[a:b]) for a, b in zip(at.tolist(), end.tolist())), np.int64).reshape(-1, 2)
    return number[of], at - begin[of] + offset[of], length, core - at, key.view(np.int64), name[:, 0], name[:, 1]


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Dense rank by the keys, the first the most significant."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def repeated_starts(contents: list[bytes], starts: list[int], lead: list[int], width: int = WIDTH) -> list[np.ndarray]:
    """For each content, which of its first `starts` suffixes have a `width`-byte prefix that others have as well.

    `lead` is the core's place in each content. The contents may belong to many buckets.
    """
    place, at = [], 0
    for c, a in zip(contents, lead):
        at += -(at + a) % PERIOD
        place.append(at)
        at += len(c)
    data = np.zeros(at + width + 2 * PERIOD, np.uint8)
    for p, c in zip(place, contents):
        data[p : p + len(c)] = np.frombuffer(c, np.uint8)
    eight = data.astype(np.uint64)
    for k in (1, 2, 4):
        eight = (eight[:-k] << np.uint64(8 * k)) | eight[k:]
    n = at + PERIOD
    sample = np.flatnonzero(np.isin(np.arange(PERIOD), COVER)[np.arange(n) % PERIOD])
    ranks = np.zeros(n + width + PERIOD, np.int64)
    rank = _dense(eight[sample], eight[sample + 8])
    deep = (width - PERIOD) // PERIOD * PERIOD  # bytes that cover ranks look at
    depth, kept = PERIOD, {}
    while True:
        kept[depth] = rank
        if depth * 2 > deep:
            break
        ranks[sample] = rank + 1
        rank = _dense(rank * (len(sample) + 2) + ranks[sample + depth])
        depth *= 2
    seen = depth
    for d in sorted(kept, reverse=True):  # deep as a sum of powers
        if seen + d <= deep:
            ranks[sample] = kept[d] + 1
            rank = _dense(rank * (len(sample) + 2) + ranks[sample + seen])
            seen += d
    ranks[sample] = rank
    count = np.array(starts)
    first = np.array(place)
    p = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    residue = p % PERIOD
    far = ranks[p + STEP[residue]] * PERIOD + residue  # one residue in each run of equal keys
    keys = [eight[p], eight[p + 8], far.astype(np.uint64), *(eight[p + k] for k in range(deep, width - 7, 8)), eight[p + width - 8]]
    order = np.lexsort(keys[::-1])
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        s = k[order]
        same &= s[1:] == s[:-1]
    twice = np.zeros(len(p), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return np.split(twice, np.cumsum(count)[:-1])


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _contents(rows: DataFrame, kinds: DataFrame, width: int) -> DataFrame:
    """`kinds` with the bytes of each, fetched from the row that stands for it; a row that occurs twice gives them twice."""
    wanted = kinds.groupBy(F.col("place.r1").alias("r1"), F.col("place.r2").alias("r2")).agg(F.collect_list(F.struct(F.col("place.at").alias("at"), "starts", "lead", "key", "c1", "c2", "n")).alias("runs"))
    wanted = written(wanted, "wanted")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, runs in zip(batch.column("raw").to_pylist(), batch.column("runs").to_pylist()):
                cols = {c: [r[c] for r in runs] for c in ("key", "c1", "c2", "n", "starts", "lead")}
                yield pa.RecordBatch.from_pydict(cols | {"content": [raw[r["at"] : r["at"] + r["starts"] + width - 1] for r in runs]}, schema=pa.schema([("key", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("n", pa.int64()), ("starts", pa.int32()), ("lead", pa.int32()), ("content", pa.binary())]))

    near = probably_in(rows, wanted.select("r1"), "r1")
    return near.join(wanted, ["r1", "r2"]).select("raw", "runs").mapInArrow(stage, "key bigint, c1 bigint, c2 bigint, n bigint, starts int, lead int, content binary")


def _sorted_blocks(contents: DataFrame, width: int) -> DataFrame:
    """(c1, c2, a, b): starts [a, b) of kinds that occur once which other kinds have too; buckets in order, a block at a time."""

    def flush(rows: dict[tuple[int, int], tuple[bytes, int, int, int]]) -> pa.RecordBatch:
        own = list(rows.values())
        flags = repeated_starts([x[0] for x in own], [x[1] for x in own], [x[2] for x in own], width)
        out = [(*k, a, b) for (k, x), f in zip(rows.items(), flags) if x[3] == 1 for a, b in _ranges(f)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], [], []), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["c1", "c2", "a", "b"])

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[int, int], tuple[bytes, int, int, int]] = {}
        held, last = 0, None
        for batch in batches:
            for key, c1, c2, n, starts, lead, content in zip(*(batch.column(c).to_pylist() for c in ("key", "c1", "c2", "n", "starts", "lead", "content"))):
                if key != last and held >= BLOCK:
                    yield flush(rows)
                    rows, held = {}, 0
                last = key
                if (c1, c2) not in rows:
                    rows[c1, c2] = content, starts, lead, n
                    held += len(content)
        if rows:
            yield flush(rows)

    return contents.repartition("key").sortWithinPartitions("key").mapInArrow(stage, "c1 bigint, c2 bigint, a int, b int")


def _starts(rows: DataFrame, width: int, stride: int, kinds_most: int) -> DataFrame:
    """(r1, r2, a, b): ranges [a, b) of starts of repeated strings in `rows` (r1, r2, raw)."""

    def pieces(batch: pa.RecordBatch) -> dict[str, object]:
        powers = Powers()
        got = list(_pieces(batch.column("raw").to_pylist(), width, stride, powers))
        number, at, starts, lead, key, c1, c2 = (np.concatenate(c) if got else np.zeros(0, np.int64) for c in (zip(*got) if got else [()] * 7))
        r1, r2 = (batch.column(c).to_numpy(zero_copy_only=False)[number] for c in ("r1", "r2"))
        return {"r1": r1, "r2": r2, "at": at, "starts": starts.astype(np.int32), "lead": lead.astype(np.int32), "key": key, "c1": c1, "c2": c2}

    seen = written(arrow_stage(rows.where(F.octet_length("raw") >= width), pieces, SEEN), "pieces")
    often = written(seen.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "often")  # written: plain joins, whose skew can be split
    both = written(seen.join(often, "key"), "candidates")
    kinds = both.groupBy("key", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("r1", "r2", "at", "starts", "lead")).alias("place"))
    kinds = written(kinds.select("key", "c1", "c2", "n", "place.starts", "place.lead", "place"), "kinds")
    several = written(kinds.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "several")
    mixed = kinds.join(several, "key")
    found = kinds.where("n > 1").select("c1", "c2", F.lit(0).alias("a"), F.col("starts").alias("b"))
    found = found.unionByName(_sorted_blocks(_contents(rows, mixed.where(F.col("k") <= kinds_most), width), width))
    if several.where(F.col("k") > kinds_most).limit(1).count():
        large = _contents(rows, mixed.where(F.col("k") > kinds_most), width).dropDuplicates(["c1", "c2"])
        large = written(large.select(F.col("c1").alias("r1"), F.col("c2").alias("r2"), F.col("content").alias("raw")), "large")
        narrow = _starts(large, width, max(1, stride // 8), kinds_most)
        found = found.unionByName(narrow.select(F.col("r1").alias("c1"), F.col("r2").alias("c2"), F.col("a").cast("int"), F.col("b").cast("int")))
    found = written(found, "repeated")
    return both.select("r1", "r2", "at", "c1", "c2").join(found, ["c1", "c2"]).select("r1", "r2", (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b"))


def repeated_spans(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text", stride: int | None = None, kinds_most: int = KINDS) -> DataFrame:
    """doc_id, raw, spans: for every row its text as UTF-8 bytes and ranges [a, b) of starts of repeated strings.

    Null and empty texts, and those under `width` bytes, have none. Repeated rows repeat each other, so all their
    bytes go where they are long enough. Matches never cross texts. Extra columns are dropped.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("raw"))
    own = F.col("doc_id"), F.col("doc_id").isNull(), F.col("raw")
    docs = docs.select("doc_id", F.col("raw").cast("binary").alias("raw"), F.xxhash64(*own).alias("r1"), F.xxhash64(F.lit(1), *own).alias("r2"))
    starts = _starts(docs.select("r1", "r2", "raw"), width, stride or min(STRIDE, width // 2), kinds_most)
    per = starts.groupBy(F.col("r1").alias("__r1"), F.col("r2").alias("__r2")).agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return docs.join(per, (F.col("r1") == F.col("__r1")) & (F.col("r2") == F.col("__r2")), "left").select("doc_id", "raw", "spans")


def _merged(spans: list[dict[str, int]] | None, width: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"] + width - 1) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text", stride: int | None = None, kinds_most: int = KINDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), for every row; see `repeated_spans`."""

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        sizes, removed, count, kept = [], [], [], []
        for raw, spans in zip(batch.column("raw").to_pylist(), batch.column("spans").to_pylist()):
            gone = _merged(spans, width)
            cuts = [0, *(x for s in gone for x in s), len(raw)]
            sizes.append(len(raw))
            removed.append(sum(b - a for a, b in gone))
            count.append(len(gone))
            kept.append(b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2])) if gone else raw)
        return {"doc_id": batch.column("doc_id"), "n_bytes": sizes, "n_removed": removed, "n_spans": count, "kept": kept}

    kind = docs.schema[doc_id].dataType.simpleString()
    return arrow_stage(repeated_spans(docs, width, doc_id, text, stride, kinds_most), each, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")

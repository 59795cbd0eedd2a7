"""Near-duplicate groups by b-bit MinHash.

Each document's shingle set has MINIMA minima, one for each of as many hash functions. Runs of them make bands; sets that
agree in a whole band are candidates. Of each minimum only BITS low bits are kept, packed into a few 64-bit words: two such
signatures are compared by XOR and a bit count, and, as unlike minima agree in their low bits by chance in a known share of
places, the count is corrected for these collisions to an estimate of the sets' similarity. Candidates whose estimate is
far below the threshold are let go; the others are confirmed on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriskill.llm.common import arrow_stage, components, lengths_to_list, mix, probably_in, written
from veriskill.llm.ngram_join import apart, fragments, overlaps, set_name, shingle_set, texts_of

NUMBER, LEAST = 5, 80  # words of a shingle; percent of the union that two linked sets share
MINIMA, BITS = 256, 2
MISSED = 1e-8  # chance at most that a pair right at the threshold shares no band
SLACK = 6  # standard deviations below the threshold, down to which an estimate lets a pair pass
_TILE = 1 << 9  # shingles hashed by all functions at a time

#: Odd multipliers, one for each hash function, from a fixed seed.
FACTOR = (mix(np.arange(MINIMA, dtype=np.uint64) + np.uint64(1)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
SHIFT = mix(np.arange(MINIMA, dtype=np.uint64) + np.uint64(1 << 20)).astype(np.uint32)


def band_rows(least: int) -> int:
    """Minima of a band: as many as leave a pair at the threshold a chance of MISSED at most to share none."""
    same = least / 100
    return max(r for r in range(1, MINIMA + 1) if r == 1 or (1 - same**r) ** (MINIMA // r) <= MISSED)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set of 64-bit hashes."""
    x = (hashes >> np.uint64(17)).astype(np.uint32)  # of all sizes alike: the set is sorted by its upper bits
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), _TILE):
        np.minimum(out, ((x[None, at : at + _TILE] ^ SHIFT[:, None]) * FACTOR[:, None]).min(axis=1), out=out)
    return out


def packed(least: np.ndarray) -> np.ndarray:
    """BITS low bits of each (mixed) minimum, as signed 64-bit words; rows are sets."""
    low = mix(least.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    return np.bitwise_or.reduce(low.reshape(len(least), -1, per) << np.arange(0, 64, BITS, dtype=np.uint64), axis=2).view(np.int64)


def bands(least: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit hash of each band and its number; rows are sets."""
    many = MINIMA // rows
    own = least[:, : many * rows].reshape(len(least), many, rows).astype(np.uint64)
    out = np.broadcast_to(mix(np.arange(many, dtype=np.uint64) + np.uint64(77)), (len(least), many))
    for k in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) ^ own[:, :, k])
    return out.view(np.int64)


def _signed(docs: DataFrame, number: int, rows: int) -> DataFrame:
    """(doc_id, t, n_shingles, h1, h2, sig, bands) of every row: size and name of its set, its signature and its bands."""

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        size, names, least = [], [], []
        for text in texts_of(batch):
            s = shingle_set(text, number)
            size.append(len(s))
            names.append(set_name(s))
            least.append(minima(s))
        h1, h2 = zip(*names)
        matrix = np.stack(least)
        sig, band = packed(matrix), bands(matrix, rows)
        full = np.array(size) > 0
        lists = lambda x: lengths_to_list(x[full].ravel(), np.where(full, x.shape[1], 0).tolist(), pa.int64())
        return {"doc_id": batch.column("doc_id"), "t": batch.column("t"), "n_shingles": size, "h1": h1, "h2": h2, "sig": lists(sig), "bands": lists(band)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_stage(docs, each, f"doc_id {kind}, t bigint, n_shingles bigint, h1 bigint, h2 bigint, sig array<bigint>, bands array<bigint>")


def estimate(a: str, b: str) -> Column:
    """Similarity of two sets from their signatures: places whose bits all agree, corrected for chance agreement."""
    ones = F.lit(sum(1 << k for k in range(0, 64, BITS)))  # the lowest bit of each place

    def unlike(x: Column, y: Column) -> Column:
        differ = x.bitwiseXOR(y)
        some = differ
        for k in range(1, BITS):
            some = some.bitwiseOR(F.shiftrightunsigned(differ, k))
        return F.bit_count(some.bitwiseAND(ones))

    agree = 1 - F.aggregate(F.zip_with(a, b, unlike), F.lit(0), lambda s, x: s + x) / MINIMA
    return (agree - 2.0**-BITS) / (1 - 2.0**-BITS)


def lowest_estimate(least: int) -> float:
    """The threshold less SLACK standard deviations of an estimate there."""
    chance = 2.0**-BITS
    agree = chance + (1 - chance) * least / 100
    return least / 100 - SLACK * (agree * (1 - agree) / MINIMA) ** 0.5 / (1 - chance)


def near_duplicates(docs: DataFrame, number: int = NUMBER, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links) and kept (doc_id = component_id) of every row.

    Rows with equal sets are one node. Within a bucket of nodes that agree in a band, every node is compared with one
    head, the node that meets most others over its buckets; nodes of one head that are in different groups after that,
    and may be linked, are found by the shingles in which they differ from the head. So a group of copies costs pairs in
    proportion to its size, and of the pairs that agree in a band no link is lost but by an estimate SLACK deviations off. A
    pair right at the threshold agrees in none with a chance of MISSED at most, more similar ones with far less.

    Null, empty and wordless texts have no shingles, stay alone under their own doc_id and are kept. Fewer words than
    `number` make one shingle of all. Texts are read whole, whatever their length. Repeated rows are all answered; rows
    of one doc_id in one group share `kept`; a null doc_id is least only in a group of its own kind, and kept is then
    true. Other columns are dropped; an empty table gives an empty frame.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("t"))
    sets = written(_signed(docs, number, band_rows(least)), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t")).alias("first")  # of the rows of a node, that of the least id
    nodes = sets.where("n_shingles > 0").groupBy("h1", "h2").agg(F.max("n_shingles").alias("n"), first, F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "n", "first.doc_id", "first.t", "sig", "bands"), "nodes")  # written: numbers stay as they are

    each = nodes.select("node", F.explode("bands").alias("sig"))
    often = written(each.groupBy("sig").count().where("count > 1"), "frequent")  # written: a plain join, whose skew can be split
    met = written(each.join(often, "sig").select("sig", "node", "count"), "buckets")
    about = written(met.groupBy("node").agg(F.sum("count").alias("degree")).join(nodes.select("node", "n", "doc_id", "h1", "h2", "t", "sig"), "node"), "about")
    head = met.join(about.select("node", "degree"), "node").groupBy("sig").agg(F.max(F.struct("degree", "node")).alias("h")).select("sig", F.col("h.node").alias("head"))
    star = written(met.join(head, "sig").where("node <> head").select("head", "node").distinct(), "stars")

    near = probably_in(docs, about.select("t"), "t")  # most texts that are not asked for are not shuffled
    asked = about.select("node", "h1", "h2", F.col("doc_id").alias("owner"), F.col("t").alias("of"))
    tokens = written(fragments(near.join(asked, (F.col("t") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("owner"))), number), "tokens")

    def linked(pairs: DataFrame) -> DataFrame:
        a, b = (about.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}")) for c in "ab")
        able = (100 * F.least("na", "nb") >= least * F.greatest("na", "nb")) & (estimate("sa", "sb") >= lowest_estimate(least))
        likely = written(pairs.join(a, "a").join(b, "b").where(able).select("a", "b", "na", "nb"), "likely")
        return written(overlaps(likely, tokens), "compared").where(100 * F.col("shared") >= least * F.col("united")).select("a", "b")

    def labels(links: DataFrame) -> DataFrame:
        return about.select("node").join(components(links), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))

    links = linked(star.select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct())
    links = links.unionByName(linked(apart(star, labels(links), tokens, about, least)))
    label = written(about.join(labels(links), "node").select("h1", "h2", "doc_id", "comp"), "classes")
    least_id = label.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    placed = nodes.select("h1", "h2", "doc_id").join(label.join(least_id, "comp").select("h1", "h2", "component_id"), ["h1", "h2"], "left")
    placed = written(placed.select("h1", "h2", F.coalesce("component_id", "doc_id").alias("component_id")), "placed")
    out = sets.join(placed, ["h1", "h2"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

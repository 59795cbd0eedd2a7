"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

The global order of shingles is by how many sets hold them, the rarest first, ties by their 64-bit hashes. Two linked sets
have a shingle in common among the first few of each, so equal shingles of these prefixes find every linked pair; as most
shingles stand in one set only and come first, most prefixes meet nothing. Verification: the shingles are cut into a few
fragments by hash, partial overlaps are counted in each of them separately, and summed for each pair.

Counting all shingles would shuffle the whole corpus several times. A set of which more shingles stand nowhere else than
a linked set may lack is linked with none. So a fixed share of the hash range is counted first, which most sets do not
pass, and only the sets that do are ordered and joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriskill.llm.common import LOWER, arrow_stage, components, lengths_to_list, let_go, mix, probably_in, word_bounds, word_hashes, written

NUMBER, LEAST = 3, 90  # words of a shingle; percent of the union that two linked sets share
OVERLAP_PARTS = 4  # fragments in which overlaps are counted
GATE = 0.12  # by so much the share of the hash range that is counted first is more than that in which linked sets may differ
CELL_BITS = 10  # 2^10 cells, whose parities are 128 bytes of a set


def shingle_set(text: str | None, number: int) -> np.ndarray:
    """Sorted hashes of the different shingles; the whole sequence if shorter; empty without words."""
    data = np.frombuffer((text or "").encode().translate(LOWER), np.uint8)
    start, end = word_bounds(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    words = word_hashes(data, start, end)
    size = min(number, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)]
    out = np.sort(mix(out))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def set_name(hashes: np.ndarray) -> tuple[int, int]:
    """A signed 128-bit name of the set; zeros only for the empty one."""
    if not len(hashes):
        return 0, 0
    x = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return (x >> 64) - (1 << 63), (x & ((1 << 64) - 1)) - (1 << 63) or 1


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles is in each of 2^CELL_BITS cells of the order, as bits of 64-bit words.

    Two sets differ in at least as many shingles as their words differ in bits, which rules a pair out exactly.
    """
    odd = np.bincount((hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def texts_of(batch: pa.RecordBatch) -> Iterator[str | None]:
    """The batch's texts, a few hundred at a time as Python strings."""
    column = batch.column("text")
    for at in range(0, len(column), 256):
        yield from column.slice(at, 256).to_pylist()


def _sets(docs: DataFrame, number: int) -> DataFrame:
    """(doc_id, t, n_shingles, h1, h2) for every row: the size and name of its set, zeros without words."""

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        rows = []
        for text in texts_of(batch):
            s = shingle_set(text, number)
            rows.append((len(s), *set_name(s)))
        n, h1, h2 = zip(*rows)
        return {"doc_id": batch.column("doc_id"), "t": batch.column("t"), "n_shingles": n, "h1": h1, "h2": h2}

    return arrow_stage(docs, each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t bigint, n_shingles bigint, h1 bigint, h2 bigint")


def _lone_shingles(docs: DataFrame, number: int, share: float) -> DataFrame:
    """(h1, lone): how many shingles of each set, of the first `share` of the hash range, stand in no other set.

    Partial aggregates only: of a shingle that a third of all sets hold, each task sends one row.
    """
    bound = np.uint64(min((1 << 64) - 1, int(share * 2.0**64)))

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        seen, names, parts = set(), [], [np.zeros(0, np.uint64)]
        for text in texts_of(batch):
            s = shingle_set(text, number)
            name = set_name(s)
            if len(s) and name not in seen:
                seen.add(name)
                names.append(name[0])
                parts.append(s[: np.searchsorted(s, bound)].copy())  # a copy: the rest of the set is let go
        return {"h1": names, "tokens": lengths_to_list(np.concatenate(parts).view(np.int64), [len(p) for p in parts[1:]], pa.int64())}

    posted = arrow_stage(docs, each, "h1 bigint, tokens array<bigint>").select("h1", F.explode("tokens").alias("token"))
    return posted.groupBy("token").agg(F.min("h1").alias("h1"), F.max("h1").alias("other")).where("h1 = other").groupBy("h1").agg(F.count("*").alias("lone"))


def fragments(docs: DataFrame, number: int) -> DataFrame:
    """(node, part, hashes, odd): each set's shingles in OVERLAP_PARTS fragments; the first one bears its parities."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, h1, h2, text in zip(*(batch.column(c).to_pylist() for c in ("node", "h1", "h2")), texts_of(batch)):
                s = shingle_set(text, number)
                cut = np.searchsorted(s, np.array([(k << 64) // OVERLAP_PARTS for k in range(1, OVERLAP_PARTS)], np.uint64))
                if set_name(s) == (h1, h2):  # another text may have the same hash
                    rows += [(node, k, x.view(np.int64), None if k else parities(s)) for k, x in enumerate(np.split(s, cut))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.int64()))], names=["node", "part", "hashes", "odd"])
            del batch, rows
        let_go()

    found = docs.select("node", "h1", "h2", "text").mapInArrow(stage, "node bigint, part int, hashes array<bigint>, odd array<bigint>")
    return found.dropDuplicates(["node", "part"])  # rows that are alike in id and text


def _prefixes(tokens: DataFrame, sizes: DataFrame, least: int) -> DataFrame:
    """(sig, node, count): of each set the shingles of its prefix in the global order which other sets hold as well."""
    each = tokens.select("node", F.explode("hashes").alias("sig"))
    often = written(each.groupBy("sig").count().where("count > 1"), "frequent")  # written: a plain join, whose skew can be split
    mine = Window.partitionBy("node")
    placed = each.join(often, "sig").withColumns({"place": F.row_number().over(mine.orderBy("count", "sig")), "met": F.count("*").over(mine)}).join(sizes.select("node", "n"), "node")
    lone = F.col("n") - F.col("met")  # these come first
    return placed.where(lone + F.col("place") <= F.col("n") - F.ceil(least * F.col("n") / 100) + 1).select("sig", "node", "count")


def _compared(pairs: DataFrame, tokens: DataFrame, sizes: DataFrame, least: int) -> DataFrame:
    """(a, b, shared, united) of pairs whose sizes and parities allow a link; overlaps are counted by fragment and summed."""
    folded = F.expr("transform(sequence(0, 3), i -> odd[i] ^ odd[i + 4] ^ odd[i + 8] ^ odd[i + 12])")  # of cells put together
    near = pairs
    for odd in (folded, F.col("odd")):  # 32 bytes of all pairs, 128 of those that these leave
        oa, ob = (sizes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), odd.alias(f"o{c}")) for c in "ab")
        differ = F.aggregate(F.zip_with("oa", "ob", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        able = (100 * F.least("na", "nb") >= least * F.greatest("na", "nb")) & (differ * (100 + least) <= (100 - least) * (F.col("na") + F.col("nb")))
        near = near.select("a", "b").join(oa, "a").join(ob, "b").where(able).select("a", "b", "na", "nb")
    return overlaps(written(near, "near"), tokens)


def overlaps(near: DataFrame, tokens: DataFrame) -> DataFrame:
    """(a, b, shared, united) of the pairs `near` (a, b, na, nb): counted in each fragment of the order apart, and summed."""
    ta, tb = (tokens.select(F.col("node").alias(c), "part", F.col("hashes").alias(f"h{c}")) for c in "ab")
    counted = near.join(ta, "a").join(tb, ["b", "part"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("c"))
    both = counted.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("shared"))
    return both.select("a", "b", "shared", (F.col("na") + F.col("nb") - F.col("shared")).alias("united"))


def apart(star: DataFrame, label: DataFrame, tokens: DataFrame, sizes: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of nodes with one head, in different components, that may be linked; one at least not with the head."""
    of = star.join(label, "node").join(label.select(F.col("node").alias("head"), F.col("comp").alias("head_comp")), "head").withColumn("out", F.col("comp") != F.col("head_comp"))
    of = written(of, "members")  # written: a plain join, whose skew can be split; a head may have very many members
    live = written(of.where("out").select("head").distinct(), "heads")
    of = of.join(live, "head").join(sizes.select("node", "n"), "node").select("head", "node", "comp", "out", "n")
    own, base = tokens.select("node", "part", F.col("hashes").alias("own")), tokens.select(F.col("node").alias("head"), "part", F.col("hashes").alias("base"))
    differing = F.array_union(F.array_except("own", "base"), F.array_except("base", "own"))
    rows = of.join(own, "node").join(base, ["head", "part"]).select("head", "node", "comp", "out", "n", F.explode(differing).alias("token")).distinct()
    rows = written(rows, "differences")
    often = rows.groupBy("head", "token").agg(F.count("*").alias("freq"))
    mine = Window.partitionBy("head", "node")
    ranked = rows.join(often, ["head", "token"]).withColumns({"pos": F.row_number().over(mine.orderBy("freq", "token")), "size": F.count("*").over(mine)}).where("freq > 1").drop("freq")
    ranked = written(ranked, "ranked")
    x, y = (ranked.select("head", "token", *(F.col(c).alias(c + k) for c in ("node", "comp", "out", "n", "size", "pos"))) for k in "xy")
    most = F.floor((100 - least) * (F.col("nx") + F.col("ny")) / (100 + least))  # shingles in which linked sets may differ
    common = F.greatest(F.lit(1), F.ceil((F.col("sizex") + F.col("sizey") - most) / 2))
    able = (F.col("nodex") < F.col("nodey")) & (F.col("compx") != F.col("compy")) & (F.col("outx") | F.col("outy")) & (100 * F.least("nx", "ny") >= least * F.greatest("nx", "ny"))
    able = able & (F.col("posx") <= F.col("sizex") - common + 1) & (F.col("posy") <= F.col("sizey") - common + 1)
    return x.join(y, ["head", "token"]).where(able).select(F.col("nodex").alias("a"), F.col("nodey").alias("b")).distinct()


def jaccard_join(docs: DataFrame, number: int = NUMBER, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable over links) for every row of `docs`.

    Rows with equal sets are one node. Within a bucket of sets that have a shingle of their prefixes in common, every
    node is compared with one head only, the node that meets most others over all its buckets, which among near copies
    is their common original. Where a node is not linked with its head, any set that it is linked with and that has the
    same head differs from the head in some of the same shingles (two sets that differ from it in disjoint shingles are
    as far apart as both differences together). So the remaining candidates come from an equi-join over these few
    differing shingles, the rarest first and no more of them than the least common number leaves. A group of copies
    thus costs pairs in proportion to its size, and no link that could join two components is left out.

    Null, empty and wordless texts have no shingles and stay alone, each row under its own doc_id. Fewer words than
    `number` make one shingle of all. Repeated rows are all kept; a null doc_id is least only in a component of its
    own kind. Other columns are dropped; an empty table gives an empty frame.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("t"))
    sets = written(_sets(docs, number), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t")).alias("first")  # of the rows of a node, that of the least id
    nodes = written(sets.where("n_shingles > 0").groupBy("h1", "h2").agg(F.max("n_shingles").alias("n"), first).select("h1", "h2", "n", "first.doc_id", "first.t"), "nodes")
    lone = _lone_shingles(docs.select("text"), number, min(1.0, GATE + (100 - least) / 100))
    passed = nodes.join(lone, "h1", "left").where(100 * F.coalesce("lone", F.lit(0)) <= (100 - least) * F.col("n"))
    passed = written(passed.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "n", "doc_id", "t"), "passed")  # written: numbers stay as they are

    near = probably_in(docs, passed.select("t"), "t")  # most texts that are not asked for are not shuffled
    asked = passed.select("node", "h1", "h2", F.col("doc_id").alias("owner"), F.col("t").alias("of"))
    tokens = written(fragments(near.join(asked, (F.col("t") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("owner"))), number), "tokens")
    met = written(_prefixes(tokens, passed, least), "buckets")
    degree = met.groupBy("node").agg(F.sum("count").alias("degree"))
    about = degree.join(passed.select("node", "doc_id", "n"), "node").join(tokens.where("part = 0").select("node", "odd"), "node")
    about = written(about, "about")  # node, degree, doc_id, n, odd

    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    head = met.join(about.select("node", "degree"), "node").groupBy("sig").agg(F.max(F.struct("degree", "node")).alias("h")).select("sig", F.col("h.node").alias("head"))
    star = written(met.join(head, "sig").where("node <> head").select("head", "node").distinct(), "stars")

    def compared(pairs: DataFrame) -> DataFrame:
        return written(_compared(pairs, tokens, about, least), "compared").where(100 * F.col("shared") >= least * F.col("united")).select("a", "b")

    def labels(links: DataFrame) -> DataFrame:
        return about.select("node").join(components(links), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))

    links = compared(star.select(*ordered("head", "node")).distinct())
    label = labels(links)
    links = links.unionByName(compared(apart(star, label, tokens, about, least)))
    label = labels(links)

    label = written(passed.join(label, "node").select("h1", "h2", "doc_id", "comp"), "classes")
    least_id = label.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    linked = label.join(least_id, "comp").select("h1", "h2", "component_id")
    placed = written(nodes.join(linked, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("component_id", "doc_id").alias("component_id")), "placed")
    return sets.join(placed, ["h1", "h2"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))

"""Token ids in a content-addressed store: chunks by rolling hash, recipes by document, Merkle manifests.

Layout of a store folder, all Parquet:
  parts/kind=chunk   key (SHA-256 of the ids), n, ids (little-endian unsigned integers of `WIDTH` bytes), once each
  parts/kind=doc     key, doc_id, n, chunks (SHA-256 of each chunk, in order), root (Merkle root of those)
  recipes            part, place in it, doc_id, start, n_tokens, chunks, root, in ascending doc_id order by part
  manifest           part, documents, ids, Merkle root over the roots of its documents
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriskill.llm.common import arrow_stage, scratch_path

END = 2
WIDTH = 2  # bytes of an id in a chunk; the vocabulary has fewer than 2^16
SPAN, MASK, LEAST, MOST = 16, 255, 32, 4096  # rolling window, cut where hash & MASK == 0, chunk lengths in ids
PARTS = "key binary, doc_id {}, n bigint, ids binary, chunks array<binary>, root binary, kind string"
BLOCK = 4096  # documents whose roots are put together at once; a power of two, so that the tree is that of all of a part
MANIFEST = "part int, documents bigint, ids bigint, root binary"
CLOSING = ".,;:!?*$#%&|<>)]}"  # marks that make one pre-token after letters
CACHE = 1_100_000  # words whose ids a worker process keeps
SLAB = 8 << 20  # bytes of texts that are encoded together, or one text
RANGE_BYTES = 64 << 20  # of recipes in one file, about


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


#: Texts that are not cut at spaces: white space beside a space, at an end, or anything that the library may treat apart.
BESIDE = r"[\s\pZ\x0b\x1c-\x1f\x85] | [\s\pZ\x0b\x1c-\x1f\x85]|^[\s\pZ\x0b\x1c-\x1f\x85]|[\s\pZ\x0b\x1c-\x1f\x85]$"


class WordCachedTokenizer:
    """Ids of texts from a byte-level BPE tokenizer, word by word; each different word is encoded once.

    A pre-token begins at every space that has no white space beside it, so most texts are cut there by Arrow, and the
    different words of a batch are looked up. New words, and texts with other white space, are cut into pre-tokens, which
    the tokenizer's model encodes one by one; texts with a special token's name go to the library whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        vocab = self.tokenizer.get_vocab()
        if max(vocab.values()) >= 1 << (8 * WIDTH):
            raise ValueError(f"{path}: an id does not go into {WIDTH} bytes")
        self.two = [k.to_bytes(WIDTH, "little") for k in range(max(vocab.values()) + 1)]
        self.end = self.two[END]
        self.forget()

    def forget(self) -> None:
        self.first: dict[str, bytes] = {}  # word at a text's start -> its ids
        self.later: dict[str, bytes] = {}  # word after a space
        self.tokens: dict[str, bytes] = {}  # pre-token

    def encode_token(self, token: str) -> bytes:
        """Ids of a pre-token; spaces and bytes over 126 are written in the byte-level alphabet."""
        plain = token.replace(" ", "\u0120") if token.isascii() and token.isprintable() else token.encode().decode("latin-1").translate(self.letters)
        two = self.two
        return b"".join([two[t.id] for t in self.tokenizer.model.tokenize(plain)])

    def token(self, token: str) -> bytes:
        got = self.tokens.get(token)
        if got is None:
            got = self.tokens[token] = self.encode_token(token)
        return got

    def values(self, memo: dict[str, bytes], words: list[str], before: str) -> list[bytes]:
        """Ids of each of `words` with `before` (a space or nothing) in front of it: most often letters and what closes them."""
        found, encode, token = list(map(memo.get, words)), self.encode_token, self.token
        two, cut, letters = self.two, self.tokenizer.model.tokenize, before.replace(" ", "\u0120")
        for k in [k for k, x in enumerate(found) if x is None]:
            word = words[k]
            core = word.rstrip(CLOSING)
            if core.isalpha():
                own = memo.get(core)
                if own is None:
                    own = memo[core] = b"".join([two[t.id] for t in cut(letters + core)]) if core.isascii() else encode(before + core)
                if len(core) < len(word):
                    own = memo[word] = own + token(word[len(core) :])
            else:
                own = memo[word] = b"".join(map(token, self.find(before + word)))
            found[k] = own
        return found

    def plain(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts that are cut at their spaces."""
        cut = pc.split_pattern(texts, " ")
        ends = (cut.offsets.to_numpy() - cut.offsets[0].as_py()).tolist()
        words = cut.flatten().dictionary_encode()
        different, at = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy().tolist()  # faster than to_pylist
        ids = self.values(self.later, different, " ").__getitem__
        heads = self.values(self.first, [different[at[a]] for a in ends[:-1]], "")
        return [b"".join([head, *map(ids, at[a + 1 : b]), self.end]) for head, a, b in zip(heads, ends, ends[1:])]

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (null: empty), END after them."""
        if len(self.later) + len(self.tokens) > CACHE:
            self.forget()
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring_regex(texts, BESIDE), pc.equal(texts, ""))
        for name in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, name))
        odd = odd.to_numpy(zero_copy_only=False)
        rest = iter(self.plain(texts.filter(pa.array(~odd))) if not odd.all() else ())
        out, two = [], self.two
        for text in _only(texts, odd):
            if text is None:
                ids = next(rest)
            elif any(x in text for x in self.special):
                ids = b"".join([two[k] for k in self.tokenizer.encode(text, add_special_tokens=False).ids]) + self.end
            else:
                ids = b"".join(map(self.token, self.find(text))) + self.end
            out.append(np.frombuffer(ids, f"<u{WIDTH}"))
        return out


def _only(texts: pa.Array, odd: np.ndarray) -> Iterator[str | None]:
    """The texts where `odd`, and None elsewhere."""
    some = iter(texts.filter(pa.array(odd)).to_pylist())
    return (next(some) if o else None for o in odd.tolist())


_CODERS: dict[str, WordCachedTokenizer] = {}


def coder_of(path: str) -> WordCachedTokenizer:
    """One coder for each worker process, which keeps the words it has met from task to task, up to CACHE."""
    if path not in _CODERS:
        _CODERS[path] = WordCachedTokenizer(path)
    return _CODERS[path]


def cut_points(texts: list[np.ndarray]) -> list[list[int]]:
    """For each id stream the ends of its chunks: after each window of SPAN ids whose hash has MASK's bits clear."""
    bounds = np.cumsum([0, *map(len, texts)])
    rolled = np.concatenate(texts).astype(np.uint32) if texts else np.zeros(0, np.uint32)
    rolled = (rolled + np.uint32(1)) * np.uint32(0x9E3779B1)
    width = 1
    while width < SPAN and width < len(rolled):  # rolled[i] is a hash of ids[i : i + width], by doubling
        rolled = rolled[: len(rolled) - width] * np.uint32(0x85EBCA6B) + rolled[width:]
        rolled ^= rolled >> np.uint32(15)
        width *= 2
    marks = np.flatnonzero(rolled & np.uint32(MASK) == 0)
    own = np.searchsorted(bounds, marks, side="right") - 1
    inside = marks + SPAN < bounds[own + 1]
    marks, own = (marks - bounds[own] + SPAN)[inside], own[inside]
    parts = np.searchsorted(own, np.arange(len(texts) + 1)).tolist()
    marks = marks.tolist()
    out = []
    for k, n in enumerate(np.diff(bounds).tolist()):
        ends, last = [], 0
        for at in marks[parts[k] : parts[k + 1]] if n > LEAST else ():
            while at - last > MOST:
                last += MOST
                ends.append(last)
            if at - last >= LEAST:
                ends.append(at)
                last = at
        while n - last > MOST:
            last += MOST
            ends.append(last)
        out.append([*ends, n])
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd last node moves up unchanged; of no leaves: the hash of nothing."""
    while len(leaves) > 1:
        pairs = [hashlib.sha256(b"\1" + leaves[i] + leaves[i + 1]).digest() for i in range(0, len(leaves) - 1, 2)]
        leaves = pairs + leaves[len(leaves) - len(leaves) % 2 :]
    return leaves[0] if leaves else hashlib.sha256(b"").digest()


def manifest_of(recipes: DataFrame) -> DataFrame:
    """The rows of `MANIFEST` for `recipes`: trees over blocks of documents, then one over the blocks of each part."""

    def root(batch: pa.RecordBatch) -> dict[str, object]:
        return {c: batch.column(c) for c in batch.schema.names if c != "leaves"} | {"root": [merkle([x["root"] for x in v]) for v in batch.column("leaves").to_pylist()]}

    leaves = lambda c: F.array_sort(F.collect_list(F.struct(c, "root"))).alias("leaves")
    blocks = recipes.groupBy("part", F.expr(f"place div {BLOCK}").alias("block")).agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("ids"), leaves("place"))
    blocks = arrow_stage(blocks, root, "part int, block bigint, documents bigint, ids bigint, root binary")
    parts = blocks.groupBy("part").agg(F.sum("documents").alias("documents"), F.sum("ids").alias("ids"), leaves("block"))
    return arrow_stage(parts, root, MANIFEST)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def write_store(docs: DataFrame, tokenizer: str, folder: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes every row of `docs` (null: empty), adds END, and writes the store to `folder`.

    The Arrow pass drops a slab's repeated chunks and its output is written as it is, so that a task run again after a lost
    executor cannot give a document another's key. Partial aggregation drops those of a task, and one shuffle by
    chunk hash the rest, so that a chunk of very many documents arrives once from each task; documents are not in it. Only a chunk's
    hash stands in recipes. Repeated rows are stored as documents of their own. An empty table gives a store without documents.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row, part = coder_of(tokenizer), 0, TaskContext.get().partitionId()
        for batch in batches:
            ids_all, texts_all = batch.column(0), batch.column(1)
            cuts, held = [0], 0
            for k, n in enumerate(pc.fill_null(pc.binary_length(texts_all), 0).to_pylist()):
                if held and held + n > SLAB:
                    cuts.append(k)
                    held = 0
                held += n
            for at, stop in zip(cuts, [*cuts[1:], batch.num_rows]):
                fresh: dict[bytes, tuple[int, bytes]] = {}
                keys, ids_, ns, chunks, roots = [], ids_all.slice(at, stop - at), [], [], []
                coded = coder.encode_all(texts_all.slice(at, stop - at))
                for ids, ends in zip(coded, cut_points(coded)):
                    raw, own, last = ids.tobytes(), [], 0
                    for end in ends:
                        piece = raw[last * WIDTH : end * WIDTH]
                        digest = hashlib.sha256(piece).digest()
                        fresh.setdefault(digest, (end - last, piece))
                        own.append(digest)
                        last = end
                    keys.append(b"%d:%d" % (part, row))
                    row += 1
                    ns.append(len(ids))
                    chunks.append(own)
                    roots.append(merkle(own))
                n, m = len(keys), len(fresh)
                columns = [pa.array(["doc"] * n + ["chunk"] * m), pa.array(keys + list(fresh), pa.binary()), pa.concat_arrays([ids_, pa.nulls(m, ids_.type)]), pa.array(ns + [x for x, _ in fresh.values()], pa.int64()), pa.array([None] * n + [x for _, x in fresh.values()], pa.binary()), pa.array(chunks + [None] * m, pa.list_(pa.binary())), pa.array(roots + [None] * m, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "key", "doc_id", "n", "ids", "chunks", "root"])

    rows = docs.select(F.col(doc_id), F.col(text)).mapInArrow(stage, f"kind string, key binary, doc_id {kind}, n bigint, ids binary, chunks array<binary>, root binary")
    rows.write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/staged")
    spark = docs.sparkSession
    staged = spark.read.schema(PARTS.format(kind)).parquet(f"{folder}/staged")
    staged.where("kind = 'chunk'").dropDuplicates(["key"]).write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/parts")
    _remove(spark, f"{folder}/staged/kind=chunk")  # only documents are read from there now
    made = staged.where("kind = 'doc'").select("doc_id", F.col("n").alias("n_tokens"), "chunks", "root", "key")
    entries = made.agg(F.sum(F.size("chunks") + 2).alias("n")).first().n or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries * 32 // RANGE_BYTES))
    ranged = made.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "key").withColumn("part", F.spark_partition_id())
    ranged.sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "key").write.option("compression", "zstd").parquet(f"{folder}/ranges")
    ranges = spark.read.schema(ranged.schema).parquet(f"{folder}/ranges")
    sums = ranges.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # a row for each RANGE_BYTES of recipes
    before = sums.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    upto = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "key")
    placed = ranges.withColumns({"within": F.sum("n_tokens").over(upto) - F.col("n_tokens"), "place": F.row_number().over(upto) - 1})
    recipes = placed.join(F.broadcast(before), "part").select("part", "place", "doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "chunks", "root")
    recipes.write.option("compression", "zstd").parquet(f"{folder}/recipes")
    back = spark.read.schema(recipes.schema).parquet(f"{folder}/recipes")
    manifest_of(back).write.parquet(f"{folder}/manifest")
    for done in ("staged", "ranges"):
        _remove(spark, f"{folder}/{done}")


_POLY = np.uint64(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of bit-reversed polynomials modulo the CRC-32 polynomial."""
    out = np.zeros_like(a)
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(bit)) & np.uint64(1) == 1, b, np.uint64(0))
        b = (b >> np.uint64(1)) ^ np.where(b & np.uint64(1) == 1, _POLY, np.uint64(0))
    return out


def join_crcs(crcs: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Each CRC moved past the bytes that follow its piece; the XOR of a text's moved CRCs is the text's CRC."""
    out, power = crcs.astype(np.uint64), np.array([0x00800000], np.uint64)  # x^8
    for bit in range(int(tails.max(initial=0)).bit_length()):
        on = (tails >> bit) & 1 == 1
        out[on] = _times(out[on], np.broadcast_to(power, on.sum()).copy())
        power = _times(power, power)
    return out


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    kind = spark.read.parquet(f"{folder}/recipes").schema["doc_id"].dataType.simpleString()
    return spark.read.schema(PARTS.format(kind)).parquet(f"{folder}/parts")


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified for every document of the store, from its files.

    Every chunk file is read: its SHA-256 must be its key, and the CRC-32 of its ids as 32-bit integers is taken.
    Recipes then fetch (CRC, length) by chunk hash, in place of the ids, and a document's CRC is put together from
    those of its chunks. verified: all chunks were found intact, and give the recipe's length and Merkle root, and
    the recipes of its part give the manifest's documents, ids and root. A part of the manifest without any recipe gives
    a row of its own, unverified, with its ids as n_tokens and nothing else.
    """

    def look(batch: pa.RecordBatch) -> dict[str, object]:
        crc, good = [], []
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            crc.append(zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes()))
            good.append(hashlib.sha256(ids).digest() == key)
        return {"chunk": batch.column("key"), "crc": crc, "n": batch.column("n"), "good": good}

    chunks = arrow_stage(_parts(spark, folder).where("kind = 'chunk'").select("key", "ids", "n"), look, "chunk binary, crc bigint, n bigint, good boolean")
    recipes = spark.read.parquet(f"{folder}/recipes")
    kind = recipes.schema["doc_id"].dataType.simpleString()
    pieces = recipes.select("part", "doc_id", "start", "n_tokens", "root", F.posexplode("chunks").alias("pos", "chunk")).join(chunks, "chunk", "left")
    whole = pieces.groupBy("part", "doc_id", "start", "n_tokens", "root").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk", "crc", "n", "good"))).alias("p"))

    def join(batch: pa.RecordBatch) -> dict[str, object]:
        at = batch.column("p").offsets.to_numpy()
        at, p, rows = at - at[0], batch.column("p").flatten(), batch.num_rows
        held = np.concatenate([[0], np.cumsum(pc.fill_null(p.field("n"), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        owner, n = np.repeat(np.arange(rows), np.diff(at)), batch.column("n_tokens").to_numpy()
        left = n[owner] - (held[1:] - held[at[:-1]][owner])
        bad = np.bincount(owner, ~pc.fill_null(p.field("good"), False).to_numpy(zero_copy_only=False), rows)
        whole = (held[at[1:]] - held[at[:-1]] == n) & (bad == 0)
        leaves, ends = p.field("chunk").to_pylist(), at.tolist()
        fine = [bool(w) and merkle(leaves[a:b]) == root for w, a, b, root in zip(whole, ends, ends[1:], batch.column("root").to_pylist())]
        out = np.zeros(rows, np.uint64)
        np.bitwise_xor.at(out, owner, join_crcs(pc.fill_null(p.field("crc"), 0).to_numpy(zero_copy_only=False).astype(np.uint64), np.maximum(left, 0) * 4))
        return {c: batch.column(c) for c in ("part", "doc_id", "start", "n_tokens")} | {"ids_crc32": out.astype(np.int64), "verified": fine}

    out = arrow_stage(whole, join, f"part int, doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint, verified boolean")
    listed = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    found = manifest_of(recipes)
    same = found.join(listed, ["part", "documents", "ids", "root"], "left_semi").select("part", F.lit(True).alias("same"))  # a row for each part
    lost = listed.join(found, "part", "left_anti").select(F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("bigint").alias("start"), F.col("ids").alias("n_tokens"), F.lit(None).cast("bigint").alias("ids_crc32"), F.lit(False).alias("verified"))
    out = out.join(F.broadcast(same), "part", "left").withColumn("verified", F.col("verified") & F.coalesce("same", F.lit(False)))
    return out.drop("part", "same").unionByName(lost)


def restore(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start and ids (array<int>) of every document, put together from recipe and chunks."""
    recipes = spark.read.parquet(f"{folder}/recipes")
    chunks = _parts(spark, folder).where("kind = 'chunk'").select(F.col("key").alias("chunk"), "ids")
    pieces = recipes.select("doc_id", "start", F.posexplode("chunks").alias("pos", "chunk")).join(chunks, "chunk")
    whole = pieces.groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("p"))

    def join(batch: pa.RecordBatch) -> dict[str, object]:
        return {"doc_id": batch.column("doc_id"), "start": batch.column("start"), "ids": [np.frombuffer(b"".join(x["ids"] for x in p), "<u2").astype(np.int32) for p in batch.column("p").to_pylist()]}

    return arrow_stage(whole, join, f"doc_id {recipes.schema['doc_id'].dataType.simpleString()}, start bigint, ids array<int>")


def store_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "store")

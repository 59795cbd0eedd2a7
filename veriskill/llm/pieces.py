"""SentencePiece encoding and decoding: pieces are matched by a suffix array over the batch, then edges are relaxed.

The different words of a batch are laid one after the other and indexed by one suffix array; a binary search for every
piece gives its range of occurrences. Written out and sorted by position, these are the edges of the batch's lattice: a
position's edges stand together, a mask of their lengths finds one of them. The model is a BPE model, whose ids a
shortest path does not give, so the relaxation takes each word's best edge in turn.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from veriskill.llm.common import arrow_stage, lengths_to_list

SPACE = "▁"
WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
BATCH_CHARS = 300_000  # of different words that one suffix array indexes: their edges take some 100 MB for each million
LONG = 200  # longer words are relaxed by a queue of their own
CUT = 4096  # characters from which a word is cut where no piece crosses
CACHE = 200_000  # different words whose ids a worker process keeps
SLAB = 4 << 20  # bytes of texts that are encoded together, or one text
STRETCH = 1 << 18  # ids whose bytes are put together at a time


def suffix_order(seq: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `seq` ordered by their next `depth` symbols: prefix doubling from packed groups of four."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    bits, step = max(1, int(rank.max()).bit_length()), 1
    while True:
        take = max(2, 62 // bits) if step == 1 else 2
        wide = np.concatenate([rank + 1, np.zeros(step * take, np.int64)])
        key = np.zeros(n, np.int64)
        bits = int(wide.max()).bit_length()
        take = max(2, min(take, 62 // bits, -(-depth // step)))
        for k in range(take):
            key = (key << bits) | wide[k * step : k * step + n]
        order = np.argsort(key)
        step *= take
        if step >= depth:
            return order
        fresh = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(fresh[1:] != fresh[:-1])])
        bits = max(1, int(rank.max()).bit_length())


def spread(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Stretches [at, at + n) of `pool`, one after the other."""
    return pool[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())]


@dataclass
class Lattice:
    """Edges sorted by position: where each position's begin, a mask of their lengths, and each edge's piece by rank."""

    begin: np.ndarray
    mask: np.ndarray
    piece: np.ndarray

    @staticmethod
    def of(start: np.ndarray, size: np.ndarray, piece: np.ndarray, n: int) -> Lattice:
        order = np.argsort(start * 64 + size)
        begin = np.concatenate([[0], np.cumsum(np.bincount(start, minlength=n))])
        bits = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.uint64(1) << size[order].astype(np.uint64))])
        return Lattice(begin, bits[begin[1:]] - bits[begin[:-1]], np.append(piece[order], 0).astype(np.int32))

    def ranks(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Rank + 1 of the piece at [at, at + size), 0 where none."""
        mask, bit = self.mask[at], np.uint64(1) << size.astype(np.uint64)
        place = self.begin[at] + np.bitwise_count(mask & (bit - np.uint64(1)))
        return np.where(mask & bit != 0, self.piece[place].astype(np.int64) + 1, 0)

    def rank(self, at: int, size: int) -> int:
        mask = int(self.mask[at])
        return int(self.piece[int(self.begin[at]) + (mask & ((1 << size) - 1)).bit_count()]) + 1 if mask >> size & 1 else 0


class PieceModel:
    """Encodes as a BPE model of SentencePiece does: best-scored merge first, unknown characters as bytes."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        plain.sort(key=lambda i: (-m.get_score(i), i))
        self.ids = np.array(plain, np.int64)  # by rank, the best first
        self.pieces = [m.id_to_piece(i) for i in plain]
        self.depth = max(map(len, self.pieces))
        if self.depth > 63:
            raise ValueError(f"{path}: a piece of {self.depth} characters does not go into a mask of lengths")
        size = np.array([len(p) for p in self.pieces])
        self.chars = np.zeros((len(plain), self.depth), np.uint32)
        for k, p in enumerate(self.pieces):
            self.chars[k, : len(p)] = [ord(c) for c in p]
        self.sizes = size
        self.joints = np.unique(np.array([ord(x) << 32 | ord(y) for p in self.pieces for x, y in zip(p, p[1:])], np.uint64))
        self.single = {p: int(i) for p, i in zip(self.pieces, plain) if len(p) == 1}
        self.byte = {b: m.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        raw = {i: m.id_to_piece(i).replace(SPACE, " ").encode() for i in plain} | {i: bytes([b]) for b, i in self.byte.items()}
        self.raw_size = np.array([len(raw.get(i, b"")) for i in range(n)], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.raw = np.frombuffer(b"".join(raw.get(i, b"") for i in range(n)), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}  # word -> its place in the pool
        self.pool, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def edges(self, seq: np.ndarray) -> Lattice:
        """Every piece at every place of `seq`: its occurrences are a range of the suffix array.

        The ranges are found by binary search for all pieces at once, one symbol at a time.
        """
        order = suffix_order(seq, self.depth)
        n, k = len(seq), len(self.pieces)
        low, high = np.zeros(k, np.int64), np.full(k, n, np.int64)
        padded = np.concatenate([seq, np.zeros(self.depth, seq.dtype)])
        for d in range(self.depth):
            go = np.flatnonzero((self.sizes > d) & (low < high))
            c = self.chars[go, d]
            bounds = []
            for after in (False, True):
                a, b = low[go].copy(), high[go].copy()
                while (open_ := a < b).any():
                    mid = (a + b) // 2
                    at = padded[order[np.minimum(mid, n - 1)] + d]
                    right = open_ & ((at <= c) if after else (at < c))
                    a = np.where(right, mid + 1, a)
                    b = np.where(open_ & ~right, mid, b)
                bounds.append(a)
            low[go], high[go] = bounds
        count = np.maximum(high - low, 0)
        piece = np.repeat(np.arange(k), count)
        start = order[np.repeat(low, count) + np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)]
        return Lattice.of(start, self.sizes[piece], piece, n)

    def relax(self, lattice: Lattice, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols (start, length) after all merges, for words [start, end): each round takes every word's best edge."""
        none = np.int64(1) << 62
        word = np.repeat(np.arange(len(starts)), ends - starts)
        at = starts[word] + np.arange(len(word)) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts)
        size = np.ones(len(at), np.int64)
        done_at, done_size = [], []
        while len(at):
            key = np.full(len(at), none)
            total = size[:-1] + size[1:]
            near = np.flatnonzero((word[:-1] == word[1:]) & (total <= self.depth))
            rank = lattice.ranks(at[near], total[near])
            near, rank = near[rank > 0], rank[rank > 0]
            key[near] = (rank << 32) | near
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(key, first)
            took = best[best < none] & 0xFFFFFFFF
            more = np.repeat(best < none, np.diff(np.concatenate([first, [len(at)]])))
            done_at.append(at[~more])
            done_size.append(size[~more])
            size[took] += size[took + 1]
            more[took + 1] = False
            at, size, word = at[more], size[more], word[more]
        at, size = np.concatenate([*done_at, at]), np.concatenate([*done_size, size])
        order = np.argsort(at)
        return at[order], size[order]

    def relax_long(self, lattice: Lattice, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long word, by a queue of its edges."""
        size, before = {p: 1 for p in range(start, end)}, {p: p - 1 for p in range(start, end)}
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            b = a + size[a]
            if b < end and size[a] + size[b] <= self.depth and (r := lattice.rank(a, size[a] + size[b])):
                heapq.heappush(heap, (r, a, size[a], size[b]))

        for p in range(start, end - 1):
            offer(p)
        while heap:
            _, a, x, y = heapq.heappop(heap)
            b = a + x
            if size.get(a) != x or size.get(b) != y:
                continue
            size[a] = x + y
            del size[b]
            if a + x + y < end:
                before[a + x + y] = a
            offer(a)
            if a > start:
                offer(before[a])
        at = np.array(sorted(size), np.int64)
        return at, np.array([size[p] for p in at.tolist()], np.int64)

    def parts(self, word: str) -> list[str]:
        """A word, or stretches of it that no piece crosses: around NUL, and where a long one holds no two joined characters."""
        if len(word) < CUT and "\0" not in word:
            return [word]
        code = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
        joined = code[:-1] << np.uint64(32) | code[1:]
        at = np.minimum(np.searchsorted(self.joints, joined), len(self.joints) - 1)
        cuts = (np.flatnonzero((self.joints[at] != joined) | (code[:-1] == 0) | (code[1:] == 0)) + 1).tolist()
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of `words` one after the other, and how many each has."""
        parts = [self.parts(w) for w in words]
        flat = [x for p in parts for x in p]
        ids, size, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while at < len(flat):
            chars, stop = 0, at
            while stop < len(flat) and (stop == at or chars + len(flat[stop]) < BATCH_CHARS):
                chars += len(flat[stop]) + 1
                stop += 1
            i, n = self.encode_some(flat[at:stop])
            ids.append(i)
            size.append(n)
            at = stop
        size = np.concatenate(size)
        if len(flat) > len(words):
            size = np.add.reduceat(size, np.cumsum([0, *map(len, parts[:-1])]))
        return np.concatenate(ids), size

    def encode_some(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that one suffix array indexes; of those with NUL there is NUL alone."""
        joined = "\0".join(part) + "\0"
        seq = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        size = np.array([len(w) for w in part], np.int64)
        starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64)
        lattice = self.edges(seq)
        long = np.flatnonzero(size > LONG)
        short = np.flatnonzero(size <= LONG)
        found = [self.relax(lattice, starts[short], starts[short] + size[short]), *(self.relax_long(lattice, int(starts[k]), int(starts[k] + size[k])) for k in long)]
        where, length = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(where)
        where, length = where[order], length[order]
        rank = lattice.ranks(where, length)
        ids = np.where(rank > 0, self.ids[np.maximum(rank - 1, 0)], -1).astype(np.int32)
        n = np.ones(len(ids), np.int64)
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):  # characters that no piece has: their bytes
            raw = [[self.byte[b] for b in joined[p].encode()] for p in where[unknown].tolist()]
            n[unknown] = [len(r) for r in raw]
            wide = np.repeat(ids, n)
            wide[np.repeat(ids < 0, n)] = [b for r in raw for b in r]
            ids = wide
        word = np.searchsorted(starts, where, side="right") - 1
        return ids, np.bincount(word, weights=n, minlength=len(part)).astype(np.int64)

    def places(self, words: list[str]) -> np.ndarray:
        """Where each word, written without the U+2581 that it begins with, stands in the pool; new ones are encoded."""
        found = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = list(dict.fromkeys(words[k] for k in missing.tolist()))
            ids, size = self.encode_words([SPACE + w for w in new])
            self.memo.update(zip(new, range(len(self.size), len(self.size) + len(new))))
            self.pool, self.size = np.concatenate([self.pool, ids]), np.concatenate([self.size, size])
            found[missing] = [self.memo[words[k]] for k in missing.tolist()]
        return found

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has (null: none)."""
        if len(self.memo) > CACHE:
            self.forget()
        texts = pc.fill_null(texts, "")
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(texts, f"  |^ | $|{SPACE}").to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(texts.filter(pa.array(~empty & ~odd)), " ")
        words = cut.flatten().dictionary_encode()
        plain = self.places(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        count = np.zeros(len(texts), np.int64)
        count[~empty & ~odd] = np.diff(cut.offsets.to_numpy())
        rest = [[w[1:] for w in WORD.findall(SPACE + t.replace(" ", SPACE))] for t in texts.filter(pa.array(odd)).to_pylist()]
        count[odd] = [len(r) for r in rest]
        word = np.zeros(int(count.sum()), np.int64)
        from_rest = np.repeat(odd, count)
        word[~from_rest] = plain
        word[from_rest] = self.places([w for r in rest for w in r])
        n = self.size[word]
        at = (np.cumsum(self.size) - self.size)[word]
        ids = np.concatenate([np.zeros(0, np.int32), *(spread(self.pool, at[k : k + STRETCH], n[k : k + STRETCH]) for k in range(0, len(n), STRETCH))])
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(count)])]
        return ids, np.diff(ends)

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of ids laid one after the other: bytes of pieces put together, the added first space taken off."""
        n = self.raw_size[ids]
        raw = b"".join(spread(self.raw, self.raw_at[ids[k : k + STRETCH]], n[k : k + STRETCH]).tobytes() for k in range(0, len(ids), STRETCH))
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a + (raw[a : a + 1] == b" " and a < b) : b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


_MODELS: dict[str, PieceModel] = {}


def model_of(path: str) -> PieceModel:
    """One model for each worker process, which keeps the words it has met from task to task, up to CACHE."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_pieces(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """`docs` with ids (array<int>), n_tokens and round_trip (the ids decode to the text).

    Each text is decoded again from its ids by `decode_all`. Gives the ids that the sentencepiece library gives for the
    model. A slab's different words are put together and indexed by one suffix array, so memory follows the slab, and
    a very long word is cut where no piece crosses; nothing is shuffled. Null and empty texts have no ids,
    and round_trip is true. The character U+2581 itself decodes to a space, as in the library, so a text that holds
    it has round_trip false. Repeated rows are all kept; columns of `docs` named as those added are replaced.
    """
    base = docs.drop(*({"ids", "n_tokens", "round_trip"} & set(docs.columns)))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        coder, texts = model_of(model), batch.column(text)
        ids, n = coder.encode_all(texts)
        same = [x == (t or "") for x, t in zip(coder.decode_all(ids, n), texts.to_pylist())]
        return {c: batch.column(i) for i, c in enumerate(batch.schema.names)} | {"ids": lengths_to_list(ids, n, pa.int32()), "n_tokens": n, "round_trip": same}

    return arrow_stage(base, each, f"{ddl}, ids array<int>, n_tokens bigint, round_trip boolean", text, SLAB)


def decode_pieces(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with the text that its column of ids decodes to; null ids give an empty text."""
    base = df.drop(*({out} & set(df.columns)))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        lists = [x or [] for x in batch.column(ids).to_pylist()]
        flat = np.array([y for x in lists for y in x], np.int64)
        return {c: batch.column(i) for i, c in enumerate(batch.schema.names)} | {out: model_of(model).decode_all(flat, np.array([len(x) for x in lists], np.int64))}

    return arrow_stage(base, each, f"{ddl}, {out} string")

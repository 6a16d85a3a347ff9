"""Byte-level BPE encoding and decoding.

Each match of the split pattern is merged on a segment tree over its byte positions. A leaf holds the rank of the pair
that starts at its position, times the width, plus the position, so the root is the leftmost pair of minimum rank. A
merge changes at most three leaves (the pair's own, the one it swallows and its left neighbour) and the nodes above
them. Short pieces of a batch are merged in lock step, a numpy row each, with several leaves under a node, as a few
wide levels take fewer calls; long ones use a binary tree on lists.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Widths of the trees that are merged in lock step.
WIDTHS = (4, 8, 16, 32, 64)
#: Leaves under a node of a tree that is merged in lock step, if it is wider than this; else all are under its root.
NARROW_TREE, FAN = 16, 8
#: Texts that are encoded and lists that are decoded at once.
ENCODED, DECODED = 256, 32
#: Distinct pieces in each of the two generations that a worker remembers.
REMEMBERED = 100_000
#: Characters of text whose pieces are held at once.
SLAB = 4_000_000
NONE = np.int64(1) << 60
# The usual split pattern, and what it comes to for texts below U+0250, where letters, numbers and white
# space are these few ranges; the alternatives are in another order, which begin with different characters.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACES, LETTERS, NUMBERS = r"\t\n\x0b\x0c\r \x85\xa0", r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
NARROW = re.compile(rf" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
WIDE = re.compile(r"[^\x00-\u024f]")


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        most = max(ranks.values()) + 1
        known = {v: k for k, v in ranks.items()}
        self.width = np.array([len(known.get(i, b"")) for i in range(most)], np.int64)
        self.start = np.r_[0, np.cumsum(self.width)[:-1]]
        self.vocabulary = np.frombuffer(b"".join(known.get(i, b"") for i in range(most)), np.uint8)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.keys, self.values = self._table()
        self.whole = {token: rank.to_bytes(4, sys.byteorder) for token, rank in ranks.items()}
        self.older: dict[str, bytes] = {}
        self.cache: dict[str, bytes] = {}  # ids as 32-bit integers one after another

    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs in an open-addressed table (-1: an empty slot), at most a quarter full, and their ranks."""
        keys, values = np.fromiter(self.pairs, np.int64, len(self.pairs)), np.fromiter(self.pairs.values(), np.int64, len(self.pairs))
        self.bits = max(4, (4 * len(keys)).bit_length())
        table, ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(table[slot] < 0)
            table[slot[free]] = keys[free]  # of several keys for a slot one stays
            put = table[slot] == keys
            ranks[slot[put]] = values[put]
            keys, values, slot = keys[~put], values[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)
        return table, ranks

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where there is none."""
        key = a << 32 | b
        key = np.where((a >= 0) & (b >= 0), key, -1).ravel()
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.values[slot], NONE)
        left = np.flatnonzero((there != key) & (there >= 0) & (key >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[left]]
            hit = there == key[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there >= 0)]
        out[key < 0] = NONE
        return out.reshape(a.shape)

    def _lock_step(self, pieces: list[bytes], n: int) -> list[bytes]:
        m = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(n, b"\0") for p in pieces), np.uint8).reshape(m, n)
        size = np.array([len(p) for p in pieces])
        # One more column each: what lies before the first and after the last position is no symbol.
        sym = np.full((m, n + 1), -1, np.int64)
        sym[:, :n] = np.where(np.arange(n) < size[:, None], self.single[raw], -1)
        after = np.tile(np.minimum(np.arange(1, n + 2), n), (m, 1))
        before = np.tile(np.r_[n, np.arange(n)], (m, 1))
        before[:, n] = n
        rank = self._rank(sym[:, :n], sym[:, 1:])
        fan = n if n <= NARROW_TREE else FAN
        leaf = np.where(rank < NONE, rank * n + np.arange(n), NONE).reshape(m, n // fan, fan)
        node, flat = leaf.min(2), leaf.reshape(m, n)  # flat: a view
        best = node.min(1)
        row = np.flatnonzero(best < NONE)
        best = best[row]
        while len(row):
            at, new = best % n, best // n
            gone = after[row, at]
            nxt = after[row, gone]
            sym[row, at] = new
            sym[row, gone] = -1
            after[row, at] = nxt
            before[row, nxt] = at
            prev = before[row, at]
            has = np.flatnonzero(prev < n)
            rows, prev = row[has], prev[has]
            pair = self._rank(np.concatenate([new, sym[rows, prev]]), np.concatenate([sym[row, nxt], new[has]]))
            right, left = pair[: len(row)], pair[len(row) :]
            flat[row, gone] = NONE
            flat[row, at] = np.where(right < NONE, right * n + at, NONE)
            flat[rows, prev] = np.where(left < NONE, left * n + prev, NONE)
            if fan == n:
                best = flat[row].min(1)
            else:
                for r, x in ((row, gone // fan), (row, at // fan), (rows, prev // fan)):
                    node[r, x] = leaf[r, x].min(1)
                best = node[row].min(1)
            more = best < NONE
            row, best = row[more], best[more]
        live = sym[:, :n] >= 0
        ids, ends = sym[:, :n][live].astype(np.int32).tobytes(), (4 * np.cumsum(live.sum(1))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _alone(self, piece: bytes) -> bytes:
        """The same tree for one piece of any length, on lists."""
        size = len(piece)
        n = 1 << max(1, (size - 1).bit_length())
        none, pairs = 1 << 60, self.pairs
        sym = [*self.single[np.frombuffer(piece, np.uint8)].tolist(), *[-1] * (n - size), -1]
        after, before = [*range(1, n + 1), n], [n, *range(n)]

        def leaf(i: int, a: int, b: int) -> int:
            rank = pairs.get(a << 32 | b) if a >= 0 and b >= 0 else None
            return none if rank is None else rank * n + i

        tree = [none] * n + [leaf(i, sym[i], sym[i + 1]) for i in range(n)]
        for i in range(n - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: int) -> None:
            i += n
            tree[i] = value
            while i > 1:
                i >>= 1
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    break
                tree[i] = low

        while tree[1] < none:
            new, at = divmod(tree[1], n)
            gone = after[at]
            nxt = after[gone]
            sym[at], sym[gone], after[at] = new, -1, nxt
            before[nxt] = at
            put(gone, none)
            put(at, leaf(at, new, sym[nxt]))
            prev = before[at]
            if prev < n:
                put(prev, leaf(prev, sym[prev], new))
        return np.array([s for s in sym if s >= 0], np.int32).tobytes()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        out = [*map(self.whole.get, pieces)]  # a piece that is a token stays whole, whatever its merges would give
        groups: dict[int, list[int]] = {n: [] for n in WIDTHS}
        for i, p in enumerate(pieces):
            if out[i] is not None:
                continue
            if not p:
                out[i] = b""
            elif len(p) <= WIDTHS[-1]:
                groups[max(WIDTHS[0], 1 << (len(p) - 1).bit_length())].append(i)
            else:
                out[i] = self._alone(p)
        for n, members in groups.items():
            for k in range(0, len(members), 8192):
                part = members[k : k + 8192]
                for i, ids in zip(part, self._lock_step([pieces[i] for i in part], n), strict=True):
                    out[i] = ids
        return out

    def splitter(self, text: str):
        """The pattern, or its narrow form where that finds the same pieces several times faster."""
        return NARROW if self.pattern.pattern == USUAL and not WIDE.search(text) else self.pattern

    def slabs(self, text: str):
        """Lists of the text's pieces, cut so that no list grows with the text."""
        found = (m.group() for m in self.splitter(text).finditer(text))
        while part := list(itertools.islice(found, SLAB // 4)):
            yield part

    def learn(self, pieces: list[str]) -> None:
        """Puts the ids of all `pieces` in the cache; what the older generation has is taken over."""
        if len(self.cache) > REMEMBERED:
            self.older, self.cache = self.cache, {}
        unseen = set(pieces).difference(self.cache)
        new = [*unseen.difference(self.older)]
        self.cache.update((p, self.older[p]) for p in unseen.difference(new))
        if new:
            self.cache.update(zip(new, self.merge([p.encode() for p in new]), strict=True))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets)."""
        out, sizes = [], []
        if sum(map(len, filter(None, texts))) <= SLAB:  # then the new pieces of all texts are merged together
            parts = [self.splitter(t).findall(t) if t else [] for t in texts]
            self.learn(list(itertools.chain.from_iterable(parts)))
            get = self.cache.__getitem__
            out = [b"".join(map(get, p)) for p in parts]
            sizes = [len(x) // 4 for x in out]
        else:
            for t in texts:
                size = 0
                for part in self.slabs(t) if t else ():
                    self.learn(part)
                    out.append(b"".join(map(self.cache.__getitem__, part)))
                    size += len(out[-1]) // 4
                sizes.append(size)
        return np.frombuffer(b"".join(out), np.int32), np.r_[0, np.cumsum(sizes, dtype=np.int64)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The ids' bytes (uint8), without a Python object for each id."""
        width = self.width[ids]
        ends = np.cumsum(width)
        if not len(ids):
            return self.vocabulary[:0]
        return self.vocabulary[np.repeat(self.start[ids] - (ends - width), width) + np.arange(ends[-1])]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(4)
def coder(path: str, pattern: str) -> ByteBPE:
    """One coder for each worker process and vocabulary."""
    return ByteBPE(read_ranks(path), pattern)


def _encoded(bpe: ByteBPE, texts: pa.Array) -> pa.Array:
    ids, ends = bpe.encode(texts.to_pylist())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))


def _decoded(bpe: ByteBPE, lists: pa.Array) -> pa.Array:
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)]
    ends = np.r_[0, np.cumsum(bpe.width[ids], dtype=np.int64)][sizes].tolist()
    data = bpe.decode(ids).tobytes()
    return pa.array([data[a:z] for a, z in zip(ends, ends[1:], strict=False)], pa.binary())


def bpe_encode(text: Column, path: str, pattern: str) -> Column:
    """Token ids (array<int>) of whole texts; a null or empty text has no ids. `path`: a rank file that every worker has."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = coder(path, pattern)
        for texts in batches:
            for at in range(0, max(len(texts), 1), ENCODED):
                yield _encoded(bpe, texts.slice(at, ENCODED))

    return encode(text.cast("string"))


def bpe_decode(ids: Column, path: str, pattern: str) -> Column:
    """The bytes (binary) that token ids stand for; null ids give empty bytes. An id that the vocabulary lacks is an error."""

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = coder(path, pattern)
        for lists in batches:
            for at in range(0, max(len(lists), 1), DECODED):
                yield _decoded(bpe, lists.slice(at, DECODED))

    return decode(ids)


def parts(bpe: ByteBPE, batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Of each text its ids and what they decode to, DECODED texts at a time."""
    for texts in batches:
        for at in range(0, max(len(texts), 1), ENCODED):
            ids = _encoded(bpe, texts.slice(at, ENCODED))
            for k in range(0, max(len(ids), 1), DECODED):
                part = ids.slice(k, DECODED)
                yield pa.StructArray.from_arrays([part, _decoded(bpe, part)], ["ids", "decoded"])


def bpe_code(text: Column, path: str, pattern: str) -> Column:
    """struct<ids: array<int>, decoded: binary>: what bpe_encode gives and what bpe_decode makes of it. Texts are encoded
    once for both, and handed on in small parts, so that neither side holds the results of a whole batch."""

    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from parts(coder(path, pattern), batches)

    return code(text.cast("string"))


def encode_documents(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """df with two more columns: the ids of each whole text and the bytes that they decode to.

    Columns of df that have these names are replaced, all others are kept. Null and empty texts get an empty list and
    empty bytes; repeated rows and rows with null ids are coded like any other; an empty table stays empty.
    """
    coded = bpe_code(F.col(text), path, pattern)
    return df.withColumns({ids: coded["ids"], decoded: coded["decoded"]})

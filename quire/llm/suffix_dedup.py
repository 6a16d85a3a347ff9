"""Removal of bytes that an earlier document has in a string of 50 bytes, by a distributed merge sort of suffixes.

Any two equal strings of WIDTH bytes hold the same anchor: the gram of least hash among their grams of GRAM bytes. So
only suffixes that start at anchors are sorted, and of those only the ones whose anchor two documents have:

1. Documents are gathered in blocks of bounded size. Each block sends the distinct hashes of its anchors, by hash range,
   and gets back one bit for each: held by several documents or not.
2. The suffixes at shared anchors (WIDTH bytes on, and the bytes before, read backwards) make a sorted run for each
   block and range. Runs are front-coded for the exchange: common prefix with the string before, and the rest.
   Equal strings of a block are one entry, so that a string of a third of all bytes is one entry a block.
3. Runs of a range meet in a loser tree whose nodes know the common prefix with the last winner, so that no byte of it is
   compared again. The merged order and its common prefixes give, for every distance that a window may start before its
   anchor, the classes of equal windows and the least document of each. Windows of larger documents go back as spans.
4. Each block removes the union of its spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, written

#: Bytes of a string that counts (fixed by the task), of a gram, grams in a window, bytes before an anchor.
WIDTH, GRAM = 50, 16
GRAMS = WIDTH - GRAM + 1
BEFORE = GRAMS - 1
#: A suffix entry: WIDTH bytes on, their number + 1, BEFORE bytes backwards, their number + 1.
ENTRY = WIDTH + BEFORE + 2
#: Bytes of text of a block and of the slabs in which a block is scanned.
BLOCK, SLAB = 4 << 20, 1 << 18
#: Anchors whose strings are made at once.
FOLD = 1 << 14
M1, M2, M3 = 0x100000001B3, np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
LAST = np.int64(2**63 - 1)


def slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over each w neighbours, in log w passes."""
    k = 1
    while 2 * k <= w:
        x = f(x[:-k], x[k:])
        k *= 2
    return f(x[: len(x) - (w - k)], x[w - k :]) if k < w else x


def scan(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of texts that lie one after another in b."""
    if len(b) < WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, k = (b.astype(np.uint64) + np.uint64(1)) * M3, 1
    while k < GRAM:
        h = h[:-k] * np.uint64(pow(M1, k, 1 << 64)) + h[k:]
        k *= 2
    h = (h ^ (h >> np.uint64(31))) * M2
    h ^= h >> np.uint64(32)
    top = (h >> np.uint64(32)).astype(np.uint32)
    cross = (ends[ends < len(b)][:, None] - np.arange(1, GRAM)).ravel()  # grams that cross from one text into the next
    cross = cross[(cross >= 0) & (cross < len(top))]
    top[cross] = np.uint32(2**32 - 1)
    low = slide(top, GRAMS, np.minimum)
    pad = np.zeros(GRAMS - 1, np.uint32)
    at = top == slide(np.concatenate([pad, low, pad]), GRAMS, np.maximum)
    at[cross] = False
    q = np.flatnonzero(at)
    return q, h[q]


def alike(x: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches of equal values."""
    edge = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)] if len(x) else []
    return list(zip(edge, edge[1:], strict=False))


class Block:
    """The rows of a block in an order that does not depend on how they came, and their anchors."""

    def __init__(self, table: pa.Table):
        rows = sorted(zip(table.column("doc_id").to_pylist(), ((t or "").encode() for t in table.column("text").to_pylist()), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        self.ids = [r[0] for r in rows]
        self.docs = np.array([LAST if i is None else i for i in self.ids], np.int64)
        self.texts = [r[1] for r in rows]
        self.ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64)
        self.starts = self.ends - np.array([len(t) for t in self.texts], np.int64)

    def anchors(self) -> None:
        """pos, hash, doc (index) of all anchors; u: distinct hashes by range and value, of: each anchor's place in u."""
        pos, hashes = [], []
        first = 0
        while first < len(self.texts):
            last = max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + SLAB)))
            b = np.frombuffer(b"".join(self.texts[first:last]), np.uint8)
            q, h = scan(b, self.ends[first:last] - self.starts[first])
            pos.append(q + self.starts[first])
            hashes.append(h)
            first = last
        self.pos = np.concatenate(pos) if pos else np.zeros(0, np.int64)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.doc = np.searchsorted(self.ends, self.pos, side="right")
        self.u, self.of = np.unique(h, return_inverse=True)
        least, most = np.full(len(self.u), len(self.texts)), np.full(len(self.u), -1)
        np.minimum.at(least, self.of, self.doc)
        np.maximum.at(most, self.of, self.doc)
        self.several = least < most

    def ranges(self, buckets: int):
        """(bucket, indices into u), each bucket's hashes ascending."""
        bucket = (self.u % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for a, b in alike(bucket[order]):
            yield int(bucket[order[a]]), order[a:b]

    def entries(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings (a row each) at the anchors `which`, and each anchor's row. Equal strings of FOLD neighbouring anchors
        are one row, so that a text that repeats a few bytes takes few rows, though all its bytes may be anchors."""
        data = np.frombuffer(b"".join(self.texts) + bytes(WIDTH), np.uint8)
        on, back = np.arange(WIDTH, dtype=np.int32), np.arange(BEFORE, dtype=np.int32)
        found, of, n = [np.zeros((0, ENTRY), np.uint8)], [np.zeros(0, np.int64)], 0
        for k in range(0, len(which), FOLD):
            pos, doc = self.pos[which[k : k + FOLD]], self.doc[which[k : k + FOLD]]
            right, left = np.minimum(WIDTH, self.ends[doc] - pos), np.minimum(BEFORE, pos - self.starts[doc])
            out = np.zeros((len(pos), ENTRY), np.uint8)
            out[:, :WIDTH] = np.where(on < right[:, None], data[pos[:, None] + on], 0)
            out[:, WIDTH] = right + 1
            out[:, WIDTH + 1 : -1] = np.where(back < left[:, None], data[np.maximum(pos[:, None] - 1 - back, 0)], 0)
            out[:, -1] = left + 1
            rows, inverse = np.unique(out.view(f"S{ENTRY}").ravel(), return_inverse=True)  # no row ends in a zero byte
            found.append(rows.view(np.uint8).reshape(-1, ENTRY))
            of.append(inverse + n)
            n += len(rows)
        return np.concatenate(found), np.concatenate(of)


def prefixes(rows: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the row before; 0 for the first."""
    if not len(rows):
        return np.zeros(0, np.int64)
    other = rows[1:] != rows[:-1]
    return np.r_[0, np.where(other.any(1), other.argmax(1), rows.shape[1])]


def coded(rows: np.ndarray) -> tuple[bytes, bytes]:
    """A sorted run, front-coded."""
    lcp = prefixes(rows)
    return lcp.astype(np.uint8).tobytes(), rows[np.arange(rows.shape[1]) >= lcp[:, None]].tobytes()


def decoded(lcp: np.ndarray, rest: bytes, width: int = ENTRY) -> np.ndarray:
    new = np.arange(width) >= lcp[:, None]
    out = np.zeros((len(lcp), width), np.uint8)
    out[new] = np.frombuffer(rest, np.uint8)
    source = np.maximum.accumulate(np.where(new, np.arange(len(lcp))[:, None], 0), axis=0)
    return out[source, np.arange(width)]


def merged(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Merges sorted runs of (strings of one length, common prefixes with the string before in the run).

    Returns the places of the strings, counted through all runs, in sorted order, and each one's common prefix with the
    one before. A node of the loser tree holds the run that lost there; prefix[r] is what its next string has in common
    with the string that beat it, so of two strings the one with the longer prefix is the smaller, and only equal
    prefixes are compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    strings = [s for s, _ in runs]
    lcps = [x for _, x in runs]
    base, total = [], 0
    for s in strings:
        base.append(total)
        total += len(s)
    head: list[bytes | None] = [s[0] if s else None for s in strings] + [None] * (k - len(runs))
    prefix = [0 if h is not None else -1 for h in head]  # an ended run is behind all
    at = [0] * k
    loser = [0] * (2 * k)

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of runs a and b, which both know their prefix with the same string."""
        p, q = prefix[a], prefix[b]
        if p > q:
            return a, b
        if p < q:
            return b, a
        if p < 0:
            return a, b
        s, t = head[a][p:], head[b][p:]
        if s == t:
            prefix[b] = p + len(s)
            return a, b
        x = (int.from_bytes(s) ^ int.from_bytes(t)).bit_length()
        common = p + len(s) - (x + 7) // 8
        if s < t:
            prefix[b] = common
            return a, b
        prefix[a] = common
        return b, a

    best = list(range(-k, k))  # winners of the first games, leaves from k on
    for node in range(k - 1, 0, -1):
        best[node], loser[node] = play(best[2 * node], best[2 * node + 1])
    win = best[1] if k > 1 else 0
    order, common = [], []
    while prefix[win] >= 0:
        i = at[win]
        order.append(base[win] + i)
        common.append(prefix[win])
        i += 1
        at[win] = i
        if i < len(strings[win]):
            head[win], prefix[win] = strings[win][i], lcps[win][i]
        else:
            head[win], prefix[win] = None, -1
        node = (win + k) >> 1
        while node:
            win, loser[node] = play(win, loser[node])
            node >>= 1
    return order, common


def windows(rows: np.ndarray, lcp: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For sorted entries: a bit for each distance at which the entry's window is in a smaller document."""
    right, left = rows[:, WIDTH].astype(np.int64) - 1, rows[:, -1].astype(np.int64) - 1
    before = rows[:, WIDTH + 1 : -1]
    by_left = np.argsort(np.ascontiguousarray(before).view(f"S{BEFORE}").ravel(), kind="stable")
    left_lcp = prefixes(before[by_left])
    n = len(rows)
    mask = np.zeros(n, np.uint64)
    group_left = np.empty(n, np.int64)
    for d in range(BEFORE + 1):
        ok = np.flatnonzero((left >= d) & (right >= WIDTH - d))
        if len(ok) < 2:
            continue
        group_left[by_left] = np.cumsum(left_lcp < d)
        key = (np.cumsum(lcp < WIDTH - d) * (n + 1) + group_left)[ok]
        order = np.argsort(key, kind="stable")
        key, own = key[order], docs[ok[order]]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        least = np.repeat(np.minimum.reduceat(own, first), np.diff(np.r_[first, len(key)]))
        mask[ok[order[least < own]]] |= np.uint64(1 << d)
    return mask


def joined(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as ascending spans that don't touch."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return start[first], end[np.r_[first[1:] - 1, len(end) - 1]]


def _hashes(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        b = Block(table)
        b.anchors()
        out = [(bucket, table.column("block")[0].as_py(), np.ascontiguousarray(b.u[i].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes(), np.packbits(b.several[i]).tobytes()) for bucket, i in b.ranges(buckets)]
        return pa.Table.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "block", "hashes", "several"])

    return run


def _shared(table: pa.Table) -> pa.Table:
    """One bit for each hash of a range: in several documents."""
    raw = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 6) for x in table.column("hashes")]
    several = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(r)) for x, r in zip(table.column("several"), raw, strict=True)])
    wide = np.zeros((len(several), 8), np.uint8)
    wide[:, :6] = np.concatenate(raw)
    _, of, count = np.unique(wide.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
    bits, cuts = (count[of] > 1) | (several > 0), np.cumsum([len(r) for r in raw])[:-1]
    return pa.Table.from_arrays([table.column("bucket"), table.column("block"), pa.array([np.packbits(x).tobytes() for x in np.split(bits, cuts)], pa.binary())], ["bucket", "block", "bits"])


RUN = "bucket long, block long, lcp binary, rest binary, docs binary, entry binary, pos binary, start binary, finish binary"


def _runs(buckets: int):
    names = ["bucket", "block", "lcp", "rest", "docs", "entry", "pos", "start", "finish"]

    def run(docs: pa.Table, bits: pa.Table) -> pa.Table:
        out: list[tuple] = []
        b = Block(docs)
        if len(b.texts) and bits.num_rows:
            block = docs.column("block")[0].as_py()
            b.anchors()
            said = dict(zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist(), strict=True))
            range_of, shared = np.full(len(b.u), -1), np.zeros(len(b.u), bool)
            for bucket, i in b.ranges(buckets):
                range_of[i] = bucket
                shared[i] = np.unpackbits(np.frombuffer(said[bucket], np.uint8), count=len(i)) > 0
            which = np.flatnonzero(shared[b.of])
            (rows, of), doc, pos = b.entries(which), b.docs[b.doc[which]], b.pos[which]
            bucket = np.zeros(len(rows), np.int64)
            bucket[of] = range_of[b.of[which]]  # equal strings begin with one gram
            order = np.argsort(rows.view(f"S{ENTRY}").ravel(), kind="stable")
            order = order[np.argsort(bucket[order], kind="stable")]
            rows, bucket = rows[order], bucket[order]
            new = np.r_[True, (rows[1:] != rows[:-1]).any(1) | (bucket[1:] != bucket[:-1])] if len(rows) else np.zeros(0, bool)
            entry = np.empty(len(rows), np.int64)
            entry[order] = np.cumsum(new) - 1
            entry, rows, bucket = entry[of], rows[new], bucket[new]
            least = np.full(len(rows), LAST)
            np.minimum.at(least, entry, doc)
            local = doc > least[entry]
            right, left = (rows[:, WIDTH].astype(np.int64) - 1)[entry], (rows[:, -1].astype(np.int64) - 1)[entry]
            all_of_it = local & (right + left >= WIDTH)
            start, end = joined((pos - left)[all_of_it], (pos + right)[all_of_it])
            if len(start):
                out.append((block % buckets, block, None, None, None, None, None, start.astype(np.uint32).tobytes(), end.astype(np.uint32).tobytes()))
            own = np.flatnonzero(~local)
            own = own[np.argsort(entry[own], kind="stable")]
            edge = np.searchsorted(entry[own], np.arange(len(rows) + 1))
            for a, z in alike(bucket):
                lcp, rest = coded(rows[a:z])
                mine = own[edge[a] : edge[z]]
                out.append((int(bucket[a]), block, lcp, rest, least[a:z].tobytes(), (entry[mine] - a).astype(np.uint32).tobytes(), pos[mine].astype(np.uint32).tobytes(), None, None))
        return pa.Table.from_arrays([pa.array([x[j] for x in out], pa.int64() if j < 2 else pa.binary()) for j in range(9)], names)

    return run


def _spans(table: pa.Table) -> pa.Table:
    """Merges the runs of a range; spans to remove, by block."""
    out, runs, taken = [], [], []
    for r in table.to_pylist():
        if r["lcp"] is None:
            out.append((r["block"], r["start"], r["finish"]))
        else:
            taken.append(r)
    if taken:
        matrices = []
        for r in taken:
            lcp = np.frombuffer(r["lcp"], np.uint8).astype(np.int64)
            m = decoded(lcp, r["rest"])
            raw = m.tobytes()
            runs.append(([raw[i : i + ENTRY] for i in range(0, len(raw), ENTRY)], lcp.tolist()))
            matrices.append(m)
        order, common = merged(runs)
        rows = np.concatenate(matrices)
        del runs, matrices
        order = np.array(order)
        docs = np.concatenate([np.frombuffer(r["docs"], np.int64) for r in taken])
        mask = np.empty(len(rows), np.uint64)
        mask[order] = windows(rows[order], np.array(common), docs[order])
        base = 0
        for r in taken:
            n = len(r["lcp"])
            own = mask[base : base + n][np.frombuffer(r["entry"], np.uint32)]
            pos = np.frombuffer(r["pos"], np.uint32).astype(np.int64)
            base += n
            hit = own > 0
            if hit.any():
                own, pos, some = own[hit], pos[hit], []
                for k in range(0, len(own), FOLD):
                    i, d = np.nonzero(own[k : k + FOLD, None] >> np.arange(BEFORE + 1, dtype=np.uint64) & np.uint64(1))
                    some.append(joined(pos[k + i] - d, pos[k + i] - d + WIDTH))
                start, end = joined(*(np.concatenate(x) for x in zip(*some, strict=True)))
                out.append((r["block"], start.astype(np.uint32).tobytes(), end.astype(np.uint32).tobytes()))
    return pa.Table.from_arrays([pa.array([x[j] for x in out], pa.int64() if not j else pa.binary()) for j in range(3)], ["block", "start", "finish"])


def _removed(docs: pa.Table, spans: pa.Table) -> pa.Table:
    b = Block(docs)
    depth = np.zeros(int(b.ends[-1]) + 1 if len(b.ends) else 1, np.int32)
    for s, e in zip(spans.column("start"), spans.column("finish"), strict=True):
        np.add.at(depth, np.frombuffer(s.as_buffer(), np.uint32), 1)
        np.add.at(depth, np.frombuffer(e.as_buffer(), np.uint32), -1)
    gone = np.cumsum(depth) > 0
    parts, kept = [], []
    for text, a, z in zip(b.texts, b.starts.tolist(), b.ends.tolist(), strict=True):
        own = gone[a:z]
        if own.any():
            edge = np.diff(own.astype(np.int8), prepend=0, append=0)
            parts.append([{"start": s, "end": e} for s, e in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist(), strict=True)])
            kept.append(np.frombuffer(text, np.uint8)[~own].tobytes())
        else:
            parts.append([])
            kept.append(text)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.Table.from_arrays([pa.array(b.ids, pa.int64()), pa.array([len(t) for t in b.texts], pa.int64()), pa.array(parts, spans_type), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def placed(doc_id: str, text: str, blocks: int, block_bytes: int) -> Column:
    """A row's block: one of `blocks` by its hash, and past these numbers one of its own for a text of half a block."""
    h = F.xxhash64(doc_id, text)
    return F.when(F.octet_length(text) * 2 >= block_bytes, blocks + F.pmod(h, F.lit(1 << 40))).otherwise(F.pmod(h, F.lit(blocks)))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row of docs: what was removed (byte offsets) and the bytes that stay.

    A null text is empty. Rows that share an id don't count as earlier to one another; a null id is later than all
    others. Texts of half a block and more are blocks of their own; rows of one id and text share a block, a copy each.
    Only ids and texts are read, so other columns can't clash.

    A block sends its anchors in as many messages as there are ranges, but never more than it has anchors, so that messages
    grow with the square of the blocks at first and with the anchors at most.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    by_block = rows.withColumn("block", placed("doc_id", "text", blocks, block_bytes))
    hashes = by_block.groupBy("block").applyInArrow(_hashes(blocks), "bucket long, block long, hashes binary, several binary")
    bits = written(hashes.groupBy("bucket").applyInArrow(_shared, "bucket long, block long, bits binary"), "bits")
    runs = by_block.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(_runs(blocks), RUN)
    spans = written(runs.groupBy("bucket").applyInArrow(_spans, "block long, start binary, finish binary"), "spans")
    discard(bits)
    return by_block.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_removed, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")

"""Exact removal of repeated byte strings by difference-cover suffix sorting, one bucket of suffixes at a time.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too. Texts are gathered in blocks, kept as a
table in the shared folder that is bucketed by block, so that each step joins its answers to the blocks where they lie and
texts never move.

1. Equal texts (SHA-256 and length) are found first; only the first holder of one goes on, and all of them go whole.
2. Anchors. A start's anchor is the least, by hash, of the strings of length // 3 bytes within its string: starts whose
   strings are equal have equal anchors. Neighbouring starts mostly share one, so a text is cut into runs of starts, and a
   run whose anchor occurs nowhere else cannot hold a repeat. Only hashes travel here, and a bit for each comes back.
3. Suffix buckets. The other runs are dealt to buckets by anchor, with their bytes: a run of n starts takes n + length - 1
   bytes, and equal runs of a block travel once. In a bucket, equal runs collapse, and the suffixes of runs that share an
   anchor without being equal are sorted: by their first 32 bytes, and longer ties by the ranks of a difference-cover sample
   of the bucket's text, which are made first (32 bytes, then doubled until they reach ``length``). Two suffixes have a
   shift below v after which both are in the sample, so one comparison of ranks settles a tie of any length. Neighbours in
   that order are compared byte by byte: nothing but bytes decides. A bucket is sorted at a time, which bounds memory.

Hot anchors. A short passage that very many texts share, in surroundings of their own, gives many different runs with one
anchor. Starts of an anchor with more than HOT_RUNS runs are first narrowed to those whose hash of all ``length`` bytes
occurs twice, and the first block that holds that hash comes back; runs of them are dealt by anchor and first holder, so one
anchor's runs spread over as many buckets as there are blocks.

Hashes only choose buckets and drop what cannot be a repeat, so no collision can change a result (but for SHA-256's).

Defined results: null texts are empty; texts below ``length`` bytes lose nothing; repeated rows are copies of each other,
and rows with a null or a repeated doc_id are rows like any others; matches never cross texts; an empty table gives no rows.
Only doc_id and text are read (all columns, for remove()), so extra columns' names cannot clash. A text larger than
BLOCK_BYTES is a block of its own: a worker holds such a text once and works on it CHUNK starts at a time.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import caches, map_batches, parts, scratch_path, table, written

LENGTH = 200
#: Bytes of a block of texts, starts that are worked on at a time, and bytes of text for which there is one suffix bucket.
BLOCK_BYTES, CHUNK, BUCKET_BYTES = 4 << 20, 1 << 20, 6 << 20
#: Anchors of a bucket, on average, and runs of one anchor beyond which it is hot.
BUCKET_KEYS, HOT_RUNS = 1_000_000, 2_000
#: The cover's period is ORDER * ORDER + ORDER + 1 for a prime ORDER; it must be below the bytes that are sorted directly.
ORDER, DIRECT = 5, 32


@functools.cache
def difference_cover(q: int = ORDER) -> tuple[int, tuple[int, ...]]:
    """v and q + 1 residues whose differences are all residues modulo v: the powers of a root of a cubic over GF(q) that
    lie in a plane."""
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                x, cover = (1, 0, 0), []
                for i in range(v):
                    if x[2] == 0:
                        cover.append(i)
                    x = ((x[2] * c) % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * a) % q)
                if len(cover) == q + 1 and len({(i - j) % v for i in cover for j in cover}) == v:
                    return v, tuple(cover)
    raise ValueError(f"no difference cover of order {q}")


@functools.cache
def _shifts() -> np.ndarray:
    """v x v: for two residues the least shift that takes both into the cover."""
    v, cover = difference_cover()
    inside = np.zeros(v, dtype=bool)
    inside[list(cover)] = True
    at = (np.arange(v)[:, None] + np.arange(v)) % v  # residue x shift
    return (inside[at][:, None, :] & inside[at][None, :, :]).argmax(axis=2)


def _words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a big-endian number; zeros follow the text."""
    n = len(text)
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = text
    out = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        out <<= np.uint64(8)
        out |= padded[i : n + i]
    return out


def _dense(columns: list[np.ndarray]) -> np.ndarray:
    """Ranks, from 0 and without gaps, of rows by their columns, the first column first."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0])
    new = np.zeros(len(order), dtype=bool)
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return rank


def cover_ranks(words: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the cover sample's suffixes by their next ``length`` bytes at least; words has v + DIRECT places to spare."""
    v, cover = difference_cover()
    sample = (np.arange(0, len(words) - v - DIRECT, v)[:, None] + np.array(cover)).ravel()
    rank, depth = _dense([words[sample + i] for i in range(0, DIRECT, 8)]), DIRECT
    while depth < length:  # a sample suffix moved by a multiple of v is a sample suffix
        hop = depth // v
        behind = np.zeros(len(rank), dtype=np.int64)
        rest = rank[hop * len(cover) :]
        behind[: len(rest)] = rest + 1
        rank = _dense([(rank.astype(np.uint64) << np.uint64(32)) | behind.astype(np.uint64)])
        depth += hop * v
    return rank


def suffix_order(text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes that start at ``at`` (of which ``length`` bytes at least count), and the text's words."""
    v, cover = difference_cover()
    words = _words(np.concatenate([text, np.zeros(2 * v + DIRECT + length, dtype=np.uint8)]))
    keys = [words[at + i] for i in range(0, DIRECT, 8)]
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    new[1:] = False
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    del keys
    group = np.cumsum(new) - 1
    tied = np.flatnonzero(np.bincount(group)[group] > 1) if len(order) else order
    if len(tied) and length > DIRECT:
        rank = cover_ranks(words, length)
        slot = np.zeros(v, dtype=np.int64)
        slot[list(cover)] = np.arange(len(cover))
        place = lambda p: rank[p // v * len(cover) + slot[p % v]]
        group = group[tied]
        while len(tied):  # every round compares the suffixes of a tie with one of them, by the ranks at their common shift
            first = np.flatnonzero(np.diff(group, prepend=-1))
            size = np.diff(np.append(first, len(group)))
            p = at[order[tied]]
            q = np.repeat(p[first + size // 2], size)
            s = _shifts()[p % v, q % v]
            side = 3 * np.repeat(np.arange(len(first)), size) + np.sign(place(p + s) - place(q + s)) + 1
            now = np.argsort(side, kind="stable")
            order[tied] = order[tied][now]
            side = side[now]
            open_ = (side % 3 != 1) & (np.bincount(side)[side] > 1)
            tied, group = tied[open_], side[open_]
    return order, words


def suffix_repeats(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Which of these starts' strings of ``length`` bytes are equal, byte for byte, to another one's."""
    out = np.zeros(len(at), dtype=bool)
    if len(at) < 2:
        return out
    order, words = suffix_order(text, at, length)
    sorted_at = at[order]
    left = np.arange(len(order) - 1)
    for i in [*range(0, length - 7, 8), *([length - 8] if length >= 8 else [])]:
        left = left[words[sorted_at[left] + i] == words[sorted_at[left + 1] + i]]
    if length < 8:
        top = np.uint64(64 - 8 * length)
        left = left[words[sorted_at[left]] >> top == words[sorted_at[left + 1]] >> top]
    out[order[left]] = True
    out[order[left + 1]] = True
    return out


_POWER = 0x9E3779B97F4A7C15
_INVERSE = pow(_POWER, -1, 1 << 64)


@functools.cache
def _bytes_table() -> np.ndarray:
    return np.random.default_rng(20_240_601).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


@functools.cache
def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = []
    for base in (_POWER, _INVERSE):
        x = np.full(n, base, dtype=np.uint64)
        x[0] = 1
        made.append(np.multiply.accumulate(x, out=x))
    return made[0], made[1]


caches(__name__, _power_tables.cache_clear)


def fingerprints(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each position."""
    n = len(raw)
    power, inverse = _power_tables(max(2 * CHUNK, n))
    prefix = np.zeros(n + 1, dtype=np.uint64)
    terms = _bytes_table()[raw]
    terms *= power[:n]
    np.cumsum(terms, out=prefix[1:])
    h = prefix[size:] - prefix[: n + 1 - size]
    h *= inverse[: len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


class Block:
    """Texts laid end to end."""

    def __init__(self, data: bytes, lengths: np.ndarray, length: int):
        self.data, self.raw = data, np.frombuffer(data, dtype=np.uint8)
        self.lengths, self.length = lengths, length
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths

    def _chunks(self, skip: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Offset, bytes and the starts (from the offset) of each chunk: those whose string lies in its text and is not skipped."""
        fits = np.flatnonzero((self.lengths >= self.length) & ~skip)
        low, high = self.starts[fits], self.ends[fits] - self.length + 1
        for at in range(0, len(self.raw) - self.length + 1, CHUNK):
            to = min(len(self.raw) - self.length + 1, at + CHUNK)
            i, j = np.searchsorted(high, at, side="right"), np.searchsorted(low, to)
            step = np.zeros(to - at + 1, dtype=np.int8)
            step[np.maximum(low[i:j], at) - at] += 1
            step[np.minimum(high[i:j], to) - at] -= 1
            here = np.flatnonzero(np.cumsum(step[:-1], dtype=np.int8))
            if len(here):
                yield at, self.raw[at : to + self.length - 1], here

    def runs(self, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First start, number of starts and anchor of each run, in the order of the text."""
        size = max(1, self.length // 3)
        bits = (2 * CHUNK).bit_length()
        low = np.uint64((1 << bits) - 1)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for at, raw, here in self._chunks(skip):
            h = fingerprints(raw, size)
            # the place breaks ties: the first of the least ones
            least = _least((h & ~low) | np.arange(len(h), dtype=np.uint64), self.length - size + 1)
            anchor = (least[here] & low).astype(np.int64)
            first = np.flatnonzero(np.diff(anchor, prepend=-1))
            # the least hashes are small ones: mixed again, so that buckets of their upper bits are even
            names = h[anchor[first]] * np.uint64(_POWER)
            names ^= names >> np.uint64(32)
            out.append((here[first] + at, np.diff(np.append(first, len(here))), names * np.uint64(_POWER)))
        return tuple(np.concatenate(x) for x in zip(*out))

    def whole_names(self, at: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Hashes of the whole strings of these starts (in rising order)."""
        out = [np.zeros(0, np.uint64)]
        for low, raw, _ in self._chunks(skip):
            i, j = np.searchsorted(at, (low, low + len(raw) - self.length + 1))
            if j > i:
                out.append(fingerprints(raw, self.length)[at[i:j] - low])
        return np.concatenate(out)

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """Which bytes lie in a string of ``length`` bytes from one of the starts (in rising order)."""
        gone = np.zeros(len(self.raw), dtype=bool)
        if len(starts):
            far = np.flatnonzero(np.diff(starts) > self.length) + 1
            for a, b in zip(starts[np.append(0, far)].tolist(), starts[np.append(far - 1, len(starts) - 1)].tolist()):
                gone[a : b + self.length] = True
        return gone


def _packed(*planes: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpacked(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)


def pack_keys(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as compressed differences, byte planes apart, and the powers of two below their counts."""
    diff = np.diff(keys, prepend=np.uint64(0))
    return _packed(diff.view(np.uint8).reshape(-1, 8).T.tobytes(), np.log2(counts).astype(np.uint8).tobytes())


def unpack_keys(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(_unpacked(blob), dtype=np.uint8).reshape(9, -1)
    keys = np.cumsum(np.ascontiguousarray(planes[:8].T).view(np.uint64).ravel(), dtype=np.uint64)
    return keys, np.int64(1) << planes[8].astype(np.int64)


def _dealt(names: np.ndarray, n_buckets: int) -> list[tuple[int, int, int]]:
    """Bucket, from and to of sorted 64-bit names."""
    cuts = np.searchsorted(names, np.array([(b << 64) // n_buckets for b in range(1, n_buckets)], dtype=np.uint64))
    edges = [0, *cuts.tolist(), len(names)]
    return [(b, x, y) for b, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]


def _repeats(rows: list[tuple[int, bytes]], hot: int) -> Iterator[tuple[int, bytes, bool]]:
    """(block, bits, whether some are hot) of one bucket's key lists: which keys occur in another block too, then which occur
    more than hot times."""
    lists, every, first, lists_of, total = _gathered(rows)
    keep = (lists_of > 1) | (total > hot)
    names, twice, frequent = every[first[keep]], (lists_of > 1)[keep], (total > hot)[keep]
    if not len(names):
        return
    for block, keys, _ in lists:
        at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
        same = names[at] == keys
        if same.any():
            often = same & frequent[at]
            yield block, np.packbits(same & twice[at]).tobytes() + np.packbits(often).tobytes() * bool(often.any()), bool(often.any())


def _holders(rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes, bool]]:
    """(block, packed numbers, False) of one bucket's key lists: for each key its first holder if it occurs twice, else -1."""
    lists, every, first, lists_of, total = _gathered(rows)
    names = every[first]
    # rows come in the order of their blocks
    holder = np.repeat(np.array([block for block, _, _ in lists], dtype=np.int64), [len(k) for _, k, _ in lists])
    holder = np.where(total > 1, holder[np.argsort(np.concatenate([k for _, k, _ in lists]), kind="stable")][first], -1)
    for block, keys, _ in lists:
        found = holder[np.searchsorted(names, keys)]
        if (found >= 0).any():
            yield block, _packed(found.tobytes()), False


def _gathered(rows: list[tuple[int, bytes]]):
    """The key lists, all keys in order, where each distinct one begins, in how many lists it is, and how often about."""
    lists = [(block, *unpack_keys(blob)) for block, blob in rows]
    every, weight = np.concatenate([k for _, k, _ in lists]), np.concatenate([c for _, _, c in lists])
    order = np.argsort(every, kind="stable")
    every, weight = every[order], weight[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    return lists, every, first, np.diff(np.append(first, len(every))), np.add.reduceat(weight, first)


def _shared(rows: list[tuple[int, bytes]], length: int) -> Iterator[tuple[int, bytes, bool]]:
    """(block, bits, False) of one bucket's runs: which of their starts' strings occur elsewhere."""
    held, number, count, names = [], {}, [], []
    for block, blob in rows:
        raw = _unpacked(blob)
        n = int.from_bytes(raw[:4], "little")
        name = np.frombuffer(raw, np.uint64, n, 4)
        size = np.frombuffer(raw, np.uint32, n, 4 + 8 * n).astype(np.int64)
        twice = raw[4 + 12 * n : 4 + 13 * n]
        end = (np.cumsum(size) + 4 + 13 * n).tolist()
        ids = []
        for a, b, k, more in zip([4 + 13 * n, *end], end, name.tolist(), twice):
            i = number.setdefault(raw[a:b], len(number))
            if i == len(count):
                count.append(0)
                names.append(k)
            count[i] += 1 + more
            ids.append(i)
        held.append((block, np.array(ids, dtype=np.int64)))
    pieces = list(number)
    n_starts = np.array([len(p) for p in pieces], dtype=np.int64) - length + 1
    offset = np.cumsum(n_starts) - n_starts
    flag = np.repeat(np.array(count) > 1, n_starts)
    # runs that are not alone with their anchor may share strings in part
    _, of, alike = np.unique(np.array(names, dtype=np.uint64), return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(alike[of] > 1)
    if len(mixed):
        text = np.frombuffer(b"".join([pieces[i] for i in mixed.tolist()]), dtype=np.uint8)
        n = n_starts[mixed]
        size = n + length - 1
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(np.cumsum(size) - size, n) + within
        flag[np.repeat(offset[mixed], n) + within] |= suffix_repeats(text, at, length)
    for block, ids in held:
        n = n_starts[ids]
        bits = flag[np.repeat(offset[ids], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        if bits.any():
            yield block, np.packbits(bits).tobytes(), False


def _answers(sent: DataFrame, n_buckets: int, of) -> DataFrame:
    """bucket, block, bits, hot: what of() finds in the rows of each bucket, one bucket in memory at a time."""
    ordered = sent.repartition(min(n_buckets, 3 * parts(sent.sparkSession)), "bucket").sortWithinPartitions("bucket", "block")

    def run(batches):
        bucket, held = None, []

        def close():
            got = list(of(held))
            held.clear()
            return {"bucket": [bucket] * len(got), "block": [x[0] for x in got], "bits": [x[1] for x in got], "hot": [x[2] for x in got]}

        for b in batches:
            for key, block, blob in zip(b["bucket"], b["block"], b["keys"]):
                if key != bucket:
                    if held:
                        yield close()
                    bucket = key
                held.append((block, blob))
        if held:
            yield close()

    return map_batches(ordered, run, "bucket int, block long, bits binary, hot boolean")


def _unpackbits(raw: bytes | None, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool) if raw else np.zeros(n, bool)


class _Keys:
    """Names of a block, distinct and sorted, with the bits that came back for them."""

    def __init__(self, names: np.ndarray, n_buckets: int):
        self.keys, self.inverse, self.counts = np.unique(names, return_inverse=True, return_counts=True)
        self.dealt = _dealt(self.keys, n_buckets)

    def sent(self) -> Iterator[tuple[int, bytes]]:
        for b, x, y in self.dealt:
            yield b, pack_keys(self.keys[x:y], self.counts[x:y])

    def holders(self, bits: dict[int, bytes]) -> np.ndarray:
        """For each of the names its first holder, -1 for those that occur once."""
        out = np.full(len(self.keys), -1, dtype=np.int64)
        for b, x, y in self.dealt:
            if raw := bits.get(b):
                out[x:y] = np.frombuffer(_unpacked(raw), dtype=np.int64)
        return out[self.inverse]

    def flags(self, bits: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each of the names whether it occurs twice, and whether it is hot."""
        twice, hot = self.counts > 1, np.zeros(len(self.keys), bool)
        for b, x, y in self.dealt:
            if raw := bits.get(b):
                size = -(-(y - x) // 8)
                twice[x:y] |= _unpackbits(raw[:size], y - x)
                hot[x:y] = _unpackbits(raw[size:], y - x)
        return twice[self.inverse], hot[self.inverse]


class _Work:
    """What each step makes of a block and the bits that came back so far."""

    def __init__(self, n_bytes: int, length: int):
        self.length = length
        self.key_buckets = max(24, n_bytes // (length // 3 + 1) // BUCKET_KEYS)
        self.run_buckets = max(24, n_bytes // BUCKET_BYTES)

    def anchors(self, block: Block, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, _Keys]:
        first, n, names = block.runs(skip)
        return first, n, _Keys(names, self.key_buckets)

    def open_runs(self, block: Block, skip: np.ndarray, bits: dict[int, bytes]) -> tuple[np.ndarray, ...]:
        """First start, number of starts and anchor of the runs whose anchor occurs twice; of hot ones each start, its run's
        number and its anchor."""
        first, n, keys = self.anchors(block, skip)
        twice, hot = keys.flags(bits)
        names = keys.keys[keys.inverse]
        own, hot = twice & ~hot, twice & hot
        m = n[hot]
        return first[own], n[own], names[own], np.repeat(first[hot] - np.cumsum(m) + m, m) + np.arange(m.sum()), np.repeat(np.flatnonzero(hot), m), np.repeat(names[hot], m)

    def hot_keys(self, block: Block, skip: np.ndarray, starts: np.ndarray) -> _Keys:
        return _Keys(block.whole_names(starts, skip), self.key_buckets)

    def pieces(self, block: Block, skip: np.ndarray, bits: dict[int, bytes], hot_bits: dict[int, bytes]):
        """First starts and numbers of starts of the runs that travel, in the order of their names; for each the number of
        its piece of bytes; and by bucket the range of runs, and its distinct pieces with name and whether it comes twice."""
        first, n, names, starts, run, anchor = self.open_runs(block, skip, bits)
        if len(starts):
            holder = self.hot_keys(block, skip, starts).holders(hot_bits)
            starts, run, anchor, holder = (x[holder >= 0] for x in (starts, run, anchor, holder))
            own = (anchor ^ holder.astype(np.uint64)) * np.uint64(_POWER)
            new = np.flatnonzero((np.diff(starts, prepend=-2) != 1) | (np.diff(run, prepend=-1) != 0) | (np.diff(holder, prepend=-1) != 0))
            first, n, names = np.append(first, starts[new]), np.append(n, np.diff(np.append(new, len(starts)))), np.append(names, own[new])
        order = np.argsort(names, kind="stable")
        first, n, names = first[order], n[order], names[order]
        piece, by_bucket, data = np.zeros(len(first), np.int64), [], block.data
        for b, x, y in _dealt(names, self.run_buckets):
            number: dict[bytes, int] = {}
            for i, a, size in zip(range(x, y), first[x:y].tolist(), (n[x:y] + self.length - 1).tolist()):
                piece[i] = number.setdefault(data[a : a + size], len(number))
            _, lead, count = np.unique(piece[x:y], return_index=True, return_counts=True)
            by_bucket.append((b, x, y, list(number), names[x:y][lead], count > 1))
        return first, n, piece, by_bucket

    def sent(self, by_bucket) -> Iterator[tuple[int, bytes]]:
        for b, _, _, pieces, names, twice in by_bucket:
            yield b, _packed(len(pieces).to_bytes(4, "little"), names.tobytes(), np.array([len(p) for p in pieces], np.uint32).tobytes(), twice.astype(np.uint8).tobytes(), *pieces)

    def removed(self, block: Block, equal: np.ndarray, skip: np.ndarray, bits, hot_bits, run_bits) -> np.ndarray:
        """Which of the block's bytes go."""
        first, n, piece, by_bucket = self.pieces(block, skip, bits, hot_bits)
        starts = [np.zeros(0, np.int64)]
        for b, x, y, pieces, _, twice in by_bucket:
            size = np.array([len(p) for p in pieces], np.int64) - self.length + 1
            flag = np.repeat(twice, size) | _unpackbits(run_bits.get(b), int(size.sum()))
            offset = (np.cumsum(size) - size)[piece[x:y]]
            m = n[x:y]
            within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            starts.append((np.repeat(first[x:y], m) + within)[flag[np.repeat(offset, m) + within]])
        gone = block.covered(np.sort(np.concatenate(starts)))
        for i in np.flatnonzero(equal & (block.lengths >= self.length)).tolist():
            gone[block.starts[i] : block.ends[i]] = True
        return gone


def _blocks(docs: DataFrame, n_parts: int, carry: list[str], length: int) -> DataFrame:
    """block, sizes, digests (of texts that could be repeated, 32 bytes each), data and the carried columns (arrays c0, c1,
    ...): the texts in blocks, as a table in the shared folder that is bucketed by block."""
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)

    def run(batches):
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 32
        rest, data, size = [], [], 0

        def close():
            names = b"".join(hashlib.sha256(x).digest() for x in data if len(x) >= length)
            return {"block": [n], "sizes": [[len(x) for x in data]], "digests": [names], "data": [b"".join(data)]} | {f"c{i}": [list(x)] for i, x in enumerate(zip(*rest))}

        for b in batches:
            for text, *row in zip(b["text"], *[b[c] for c in carry]):
                raw = (text or "").encode()
                if data and size + len(raw) > BLOCK_BYTES:
                    yield close()
                    rest, data, size, n = [], [], 0, n + 1
                rest.append(row)
                data.append(raw)
                size += len(raw)
        if data:
            yield close()

    made = map_batches(docs.select(*carry, "text"), run, ", ".join(["block long, sizes array<long>, digests binary, data binary", *(f"c{i} array<{kinds[c]}>" for i, c in enumerate(carry))]))
    # as many buckets as shuffles have partitions: Spark ignores a table's buckets where it has fewer
    name = f"rillflow_{uuid.uuid4().hex}"
    made.write.option("path", scratch_path(spark, "blocks")).option("compression", "zstd").bucketBy(n_parts, "block").saveAsTable(name)
    return spark.table(name)


def _equal_texts(blocks: DataFrame) -> DataFrame:
    """block, bits0: the digests of a block that occur twice, and whether the block is their first holder."""

    def named(batches):
        for b in batches:
            for n, raw in zip(b["block"], b["digests"]):
                seen: dict[bytes, int] = {}
                for i in range(0, len(raw), 32):
                    seen[raw[i : i + 32]] = seen.get(raw[i : i + 32], 0) + 1
                yield {"digest": list(seen), "block": [n] * len(seen), "n": list(seen.values())}

    rows = map_batches(blocks.select("block", "digests"), named, "digest binary, block long, n long")
    twice = rows.groupBy("digest").agg(F.sum("n").alias("n"), F.min("block").alias("first")).where("n > 1").select(F.col("digest").alias("d"), "first")
    found = rows.join(twice, F.col("digest") == F.col("d")).select("block", "digest", (F.col("block") == F.col("first")).alias("mine"))
    return found


def _with_bits(blocks: DataFrame, **answers: DataFrame) -> DataFrame:
    """blocks with each step's bits; the blocks stay where they are, as the table is bucketed by block."""
    for name, a in answers.items():
        packed = a.groupBy("block").agg(F.collect_list(F.struct(*[c for c in a.columns if c != "block"])).alias(name))
        blocks = blocks.join(packed.hint("shuffle_hash"), "block", "left")
    return blocks


def _bits(cell: list | None) -> dict[int, bytes]:
    return {x["bucket"]: x["bits"] for x in cell or []}


def _equal(block: Block, digests: bytes, cell: list | None) -> tuple[np.ndarray, np.ndarray]:
    """Which texts are equal to another one, and which of these another one stands for."""
    found = {x["digest"]: x["mine"] for x in cell or []}
    equal, skip = np.zeros(len(block.lengths), bool), np.zeros(len(block.lengths), bool)
    seen: set[bytes] = set()
    for k, i in enumerate(np.flatnonzero(block.lengths >= block.length).tolist()):
        name = digests[32 * k : 32 * k + 32]
        if name in found:
            equal[i] = True
            skip[i] = not found[name] or name in seen
            seen.add(name)
    return equal, skip


def _free(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_bytes(docs: DataFrame, emit, schema: str, length: int = LENGTH, carry: list[str] | None = None) -> DataFrame:
    """What emit(rows, block, gone) makes of each block: rows holds the carried columns' values (doc_id, if not said
    otherwise), and gone marks the bytes to remove."""
    carry = carry or ["doc_id"]
    spark = docs.sparkSession
    n_parts = parts(spark)
    blocks = _blocks(docs, n_parts, carry, length)
    n_bytes = int(blocks.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).head()[0])
    work = _Work(n_bytes, length)
    texts = ["block", "sizes", "digests", "data"]
    key_schema = "bucket int, block long, keys binary"

    def sending(of):
        """Rows of what of(block, skip, cells) sends; cells: a row's columns after texts."""

        def run(batches):
            for b in batches:
                for n, sizes, digests, data, first, *cells in zip(*b.values()):
                    block = Block(data, np.array(sizes, dtype=np.int64), length)
                    _, skip = _equal(block, digests, first)
                    sent = list(of(block, skip, *map(_bits, cells)))
                    yield {"bucket": [x for x, _ in sent], "block": [n] * len(sent), "keys": [x for _, x in sent]}

        return run

    equal = written(_equal_texts(blocks), "equal-texts")
    with_equal = _with_bits(blocks.select(*texts), bits0=equal)
    rows = map_batches(with_equal, sending(lambda block, skip: work.anchors(block, skip)[2].sent()), key_schema)
    hot_runs = HOT_RUNS
    anchors = written(_answers(rows, work.key_buckets, lambda held: _repeats(held, hot_runs)), "anchor-bits")
    with_anchors = _with_bits(blocks.select(*texts), bits0=equal, bits1=anchors)
    hot = anchors.limit(0)
    if not anchors.where("hot").isEmpty():
        rows = map_batches(with_anchors, sending(lambda block, skip, bits: work.hot_keys(block, skip, work.open_runs(block, skip, bits)[3]).sent()), key_schema)
        hot = written(_answers(rows, work.key_buckets, _holders), "hot-holders")
    with_hot = _with_bits(blocks.select(*texts), bits0=equal, bits1=anchors, bits2=hot)
    rows = map_batches(with_hot, sending(lambda block, skip, bits, hot_bits: work.sent(work.pieces(block, skip, bits, hot_bits)[3])), key_schema)
    found = written(_answers(rows, work.run_buckets, lambda held: _shared(held, length)), "run-bits")
    _free(spark)

    def finish(batches):
        for b in batches:
            columns = [b[c] for c in (*texts, *(f"c{i}" for i in range(len(carry))), "bits0", "bits1", "bits2", "bits3")]
            for _, sizes, digests, data, *rows, bits0, bits1, bits2, bits3 in zip(*columns):
                block = Block(data, np.array(sizes, dtype=np.int64), length)
                yield emit(rows, block, work.removed(block, *_equal(block, digests, bits0), _bits(bits1), _bits(bits2), _bits(bits3)))

    return map_batches(_with_bits(blocks, bits0=equal, bits1=anchors, bits2=hot, bits3=found), finish, schema)


def _digest(rows: list, block: Block, gone: np.ndarray) -> dict[str, list]:
    out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
    for doc, s, e in zip(rows[0], block.starts.tolist(), block.ends.tolist()):
        cut = gone[s:e]
        n = int(cut.sum())
        spans = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()) if n else 0
        kept = block.raw[s:e][~cut] if n else block.raw[s:e]
        for k, v in zip(out, (doc, e - s, n, spans, hashlib.sha256(kept.tobytes()).hexdigest())):
            out[k].append(v)
    return out


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every text."""
    return repeated_bytes(docs, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length)


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs, all columns, without the repeated bytes; a character that is cut in two goes whole, null texts come back empty,
    and n_chars, if there, follows the text."""
    names = [c for c in docs.columns if c != "text"]

    def emit(rows: list, block: Block, gone: np.ndarray) -> dict[str, list]:
        texts = [block.raw[s:e][~gone[s:e]].tobytes().decode("utf-8", "ignore") for s, e in zip(block.starts.tolist(), block.ends.tolist())]
        out = dict(zip(names, rows)) | {"text": texts}
        if "n_chars" in out:
            out["n_chars"] = [len(t) for t in texts]
        return out

    return repeated_bytes(docs, emit, docs.schema.toDDL(), length, names).select(*docs.columns)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))

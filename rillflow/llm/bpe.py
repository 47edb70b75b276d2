"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A batch's distinct unseen pieces are laid out as one array of symbols. An inverted index from merge rank (that is, token
pair) to positions is filled once; merges are then applied in rank order over all pieces together, and only the
neighbours of a merged pair are looked at again. The ids equal those of a per-piece encoder: within a piece always the
pair of lowest rank, the leftmost one first, is merged.

Null texts count as empty; an empty text has no ids. Equal rows give equal results. Only ``id_col`` and ``text_col`` are
read, so other columns of any name do no harm.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import caches, map_batches, table, tokenizer_path

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The Unicode property White_Space, as tiktoken's \s has it.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Encoded units that a worker keeps; beyond it the cache starts anew, which costs time only.
CACHE = 400_000
#: Characters whose chunks are looked up together.
RUN_CHARS = 4_000_000
#: A chunk of plain letters and the marks after them, which are one piece each.
PARTS = r"^(?P<head> ?[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"
#: What an empty string gives.
NOTHING = (b"", b"", 0)


def _numbers(ids: bytes) -> list[int]:
    return [int(i) for i in ids.split()]


class Bpe:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        # No piece goes on over white space, so a chunk (one blank at most, then no white space) can be split by itself.
        self.chunks = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.byte_pair = np.full((int(self.byte_id.max()) + 1,) * 2, -1, dtype=np.int64)  # ranks of pairs of single bytes
        for pair, rank in ranks.items():
            if len(pair) == 2:
                self.byte_pair[ranks[pair[:1]], ranks[pair[1:]]] = rank
        self.pair_rank: dict[int, int] = {}
        self.known: dict[str, tuple[bytes, bytes, int]] = {"": NOTHING}

    @classmethod
    def load(cls, path: str, pattern: str) -> Bpe:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, pattern)

    def replay(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """The ids of each of the distinct pieces."""
        rank_of, bytes_of = self.ranks.get, self.bytes_of
        pair_rank = self.pair_rank
        raws = [p.encode("utf-8", "surrogatepass") for p in pieces]
        whole = [rank_of(r) for r in raws]  # a piece in the vocabulary is one token, whatever the merges say
        rest = [r for r, w in zip(raws, whole) if w is None]
        ends = np.cumsum([len(r) for r in rest], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if len(rest) else ends
        symbols = self.byte_id[np.frombuffer(b"".join(rest), dtype=np.uint8)]
        linked = np.arange(len(symbols), dtype=np.int64)
        after, before = linked + 1, linked - 1  # the positions of a symbol's neighbours in its piece, or -1
        after[ends - 1] = before[starts] = -1
        index: dict[int, list[int]] = {}
        if len(symbols):
            first = np.where(after >= 0, self.byte_pair[symbols, symbols[after]], -1)
            order = np.argsort(first, kind="stable")
            ranks, at = np.unique(first[order], return_index=True)
            for r, found in zip(ranks.tolist(), np.split(order, at[1:])):
                if r >= 0:
                    index[r] = found.tolist()
        ids, after, before = symbols.tolist(), after.tolist(), before.tolist()  # of a merged pair the second id is -1
        heap = list(index)
        heapq.heapify(heap)
        push = heapq.heappush

        def learn_pair(a: int, b: int) -> int:
            r = pair_rank[a << 20 | b] = rank_of(bytes_of[a] + bytes_of[b], -1)
            return r

        piece_of = ends.tolist()
        while heap:
            r = heapq.heappop(heap)
            at = index.pop(r)
            at.sort()
            held: set[int] = set()  # pieces in which a merge of lower rank has become possible
            for i in at:
                j = after[i]
                a = ids[i]
                if a < 0 or j < 0:
                    continue
                here = pair_rank.get(a << 20 | ids[j])
                if (learn_pair(a, ids[j]) if here is None else here) != r:
                    continue
                if held and bisect.bisect_right(piece_of, i) in held:
                    if r not in index:
                        index[r] = []
                        push(heap, r)
                    index[r].append(i)
                    continue
                ids[i], ids[j] = r, -1
                after[i] = k = after[j]
                if k >= 0:
                    before[k] = i
                    new = pair_rank.get(r << 20 | ids[k])
                    if new is None:
                        new = learn_pair(r, ids[k])
                    if new >= 0:
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            push(heap, new)
                        if new < r:
                            held.add(bisect.bisect_right(piece_of, i))
                h = before[i]
                if h >= 0:
                    new = pair_rank.get(ids[h] << 20 | r)
                    if new is None:
                        new = learn_pair(ids[h], r)
                    if new >= 0:
                        if new in index:
                            index[new].append(h)
                        else:
                            index[new] = [h]
                            push(heap, new)
                        if new < r:
                            held.add(bisect.bisect_right(piece_of, i))
        left = np.array(ids, dtype=np.int64) >= 0
        kept = [x for x in ids if x >= 0]
        count = np.concatenate([[0], np.cumsum(left)])
        spans = iter(zip(count[starts].tolist(), count[ends].tolist()))
        return [(w,) if w is not None else tuple(kept[slice(*next(spans))]) for w in whole]

    def learn(self, units: list[str], odd: set[str]) -> None:
        """Adds (ids as text, decoded bytes, number of ids) of these units. Those not in odd are one piece each."""
        known, bytes_of = self.known, self.bytes_of
        split = [self.pieces.findall(u) if u in odd else (u,) for u in units]
        new = list(set(chain.from_iterable(split)))
        ids_of = dict(zip(new, self.replay(new)))
        for u, pieces in zip(units, split):
            ids = ids_of[pieces[0]] if len(pieces) == 1 else [i for p in pieces for i in ids_of[p]]
            known[u] = ("%d " * len(ids) % tuple(ids)).encode(), b"".join([bytes_of[i] for i in ids]), len(ids)

    def _looked_up(self, units: list[str], odd: set[str]) -> list[tuple[bytes, bytes, int]]:
        if missing := [u for u in units if u not in self.known]:
            if len(self.known) + len(missing) > CACHE:
                self.known = {"": NOTHING}
                missing = [u for u in units if u]
            self.learn(missing, odd)
        return list(map(self.known.__getitem__, units))

    def _run(self, texts: list[str]) -> list[tuple[bytes, bytes, int]]:
        split = [self.chunks.findall(t) for t in texts]
        chunks = pa.array(list(chain.from_iterable(split)), pa.large_string()).dictionary_encode()
        cut = pc.extract_regex(chunks.dictionary, PARTS)
        odd = set(chunks.dictionary.filter(cut.is_null()).to_pylist())
        heads = pc.coalesce(pc.struct_field(cut, "head"), chunks.dictionary)
        tails = pc.coalesce(pc.struct_field(cut, "tail"), pa.scalar("", pa.large_string())).dictionary_encode()
        found = self._looked_up(heads.to_numpy(zero_copy_only=False).tolist(), odd) + self._looked_up(tails.dictionary.to_pylist(), odd)
        # Which units the chunks of the texts are, head and tail by turns.
        which = chunks.indices.to_numpy()
        unit = np.empty(2 * len(which), dtype=np.int64)
        unit[0::2] = which
        unit[1::2] = tails.indices.to_numpy()[which] + len(heads)
        ids, raw = np.empty(len(found), dtype=object), np.empty(len(found), dtype=object)
        ids[:], raw[:] = [x[0] for x in found], [x[1] for x in found]
        count = np.concatenate([[0], np.cumsum(np.array([x[2] for x in found], dtype=np.int64)[unit])]).tolist()
        ids, raw = ids[unit].tolist(), raw[unit].tolist()
        out, a = [], 0
        for x in split:
            b = a + 2 * len(x)
            out.append((b"".join(ids[a:b])[:-1], b"".join(raw[a:b]), count[b] - count[a]))
            a = b
        return out

    def encode_all(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes, int]]:
        """For each text (ids as text, decoded bytes, number of ids)."""
        run: list[str] = []
        chars = 0
        for t in texts:
            run.append(t or "")
            chars += len(run[-1])
            if chars > RUN_CHARS:
                yield from self._run(run)
                run, chars = [], 0
        yield from self._run(run)

    def encode(self, text: str | None) -> list[int]:
        return _numbers(next(self.encode_all([text]))[0])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.cache
def loaded(path: str, pattern: str) -> Bpe:
    return Bpe.load(path, pattern)


caches(__name__, loaded.cache_clear)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id_col, ids array<int>) for every row."""
    import public_tokenizers

    path, pattern = path or tokenizer_path(VOCABULARY), pattern or public_tokenizers.PATTERN

    def run(batches):
        bpe = loaded(path, pattern)
        for b in batches:
            yield {id_col: b[id_col], "ids": [_numbers(ids) for ids, _, _ in bpe.encode_all(b[text_col])]}

    kind = dict(docs.dtypes)[id_col]
    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id_col, bytes binary) of what encode() returned; null ids count as none."""
    import public_tokenizers

    path, pattern = path or tokenizer_path(VOCABULARY), pattern or public_tokenizers.PATTERN

    def run(batches):
        bpe = loaded(path, pattern)
        for b in batches:
            yield {id_col: b[id_col], "bytes": [bpe.decode(i or []) for i in b["ids"]]}

    kind = dict(encoded.dtypes)[id_col]
    return map_batches(encoded.select(id_col, "ids"), run, f"`{id_col}` {kind}, bytes binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode() and decode() in one pass, without moving ids between processes."""
    import public_tokenizers

    path, pattern = path or tokenizer_path(VOCABULARY), pattern or public_tokenizers.PATTERN

    def run(batches):
        bpe = loaded(path, pattern)
        for b in batches:
            out = {"doc_id": b["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for ids, raw, n in bpe.encode_all(b["text"]):
                out["n_tokens"].append(n)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(raw).hexdigest())
            yield out

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))

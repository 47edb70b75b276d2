"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows, which need no packing, and a rest, which is cut into pieces of at most
``piece`` ids. A task packs what it reads: as soon as the pieces that it holds fill GROUP_WINDOWS windows, they are a group
and are partitioned into k windows by multiway differencing: partial partitions start as single pieces, the two with the largest spread are merged with
their imbalances opposed (largest sum to smallest sum), until one partition of k near-equal sums is left. k begins at
the least possible count and rises whenever the fullest window exceeds the capacity.

Nothing is shuffled, and groups are bounded by counting, whatever ids or texts come how often: a group holds GROUP_WINDOWS
windows and one document's rest at most, and a document's full windows are streamed past. The last group of a task leaves
less than one window of padding in all. A sequence is named by its task's partition and its number there, so a lost task is
redone alike.

Defined results: a null text is empty and packs as its end token alone; equal rows are packed each, also under one id or a
null one; long texts are cut into windows; an empty table gives no rows. Only doc_id and text are read, so extra columns'
names cannot clash. A row is one cell to Spark: a worker holds the ids of one text whole.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import caches, map_batches, table, tokenizer_path

VOCABULARY, END_ID = "word_bpe_49k.json", 1
WINDOW, PIECE = 2048, 256
#: Windows that a group's pieces fill.
GROUP_WINDOWS = 256
#: Encoded words that a worker keeps; beyond it the cache starts anew, which costs time only.
CACHE = 400_000
#: Characters whose words are encoded together, and parts of words that one call of the tokenizer takes.
RUN_CHARS, JOINED = 4_000_000, 512
#: A word up to its last plain letter or digit, and the marks after it: the tokenizer always cuts there.
_PARTS = r"(?s)^(?P<head>.*[0-9A-Za-zÀ-ÖØ-öø-ÿ])(?P<tail>[!-/:-@\[-`{-~]*)$"


class Words:
    """The tokenizer, with the ids of words and of their parts kept as bytes: no token goes over ASCII white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        #: A word of one token, set between words that are encoded together, and its id.
        self.mark = next((m for m in "~^`\\@" if len(self._ids(m)) == 1), None)
        self.mark_id = self._ids(self.mark)[0] if self.mark else -1

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, words: list[str]) -> None:
        """Adds the ids of these words. The mark's id must come up once between any two, or they are encoded one by one."""
        if len(self.known) + len(words) > CACHE:
            self.known.clear()
        known, step = self.known, JOINED if self.mark else 1
        runs = [words[i : i + step] for i in range(0, len(words), step)]
        joined = self.tokenizer.encode_batch_fast([f" {self.mark} ".join(r) for r in runs], add_special_tokens=False)
        for run, e in zip(runs, joined):
            ids = np.array(e.ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) == len(run) - 1:
                raw, start = ids.tobytes(), 0
                for w, end in zip(run, [*(4 * cuts).tolist(), len(raw)]):
                    known[w] = raw[start:end]
                    start = end + 4
            else:
                for w in run:
                    known[w] = np.array(self._ids(w), dtype="<u4").tobytes()

    def _looked_up(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        if missing := [w for w in words if w not in self.known]:
            if len(self.known) + len(missing) > CACHE:
                missing = words
            self.learn(missing)
        return list(map(self.known.__getitem__, words))

    def _run(self, texts: list[str]) -> list[bytes]:
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        words = lists.values.dictionary_encode()
        cut = pc.extract_regex(words.dictionary, _PARTS)
        heads = pc.ascii_lower(pc.coalesce(pc.struct_field(cut, "head"), words.dictionary)).dictionary_encode()
        tails = pc.coalesce(pc.struct_field(cut, "tail"), pa.scalar("", pa.large_string())).dictionary_encode()
        ids = self._looked_up(_strings(heads)) + self._looked_up(_strings(tails))
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        starts = np.cumsum(size) - size
        which = words.indices.to_numpy()
        part = np.empty(2 * len(which), dtype=np.int64)  # the parts of the texts' words, head and tail by turns
        part[0::2] = heads.indices.to_numpy()[which]
        part[1::2] = tails.indices.to_numpy()[which] + len(heads.dictionary)
        n = size[part]
        ends = np.cumsum(n)
        out = np.frombuffer(b"".join(ids), dtype="<u4")[np.repeat(starts[part] - (ends - n), n) + np.arange(n.sum())]
        bounds = np.concatenate([[0], ends])[2 * lists.offsets.to_numpy()].tolist()
        return [out[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text. Texts that may hold a special token's name are encoded whole."""
        out: list[bytes] = []
        run: list[str] = []
        chars = 0
        for t in texts:
            run.append(t if t and "<|" not in t else "")
            chars += len(run[-1])
            if chars > RUN_CHARS:
                out += self._run(run)
                run, chars = [], 0
        out += self._run(run)
        return [np.array(self._ids(t), dtype="<u4").tobytes() if t and "<|" in t else x for t, x in zip(texts, out)]


def _strings(coded: pa.DictionaryArray) -> list[str]:
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist()


@functools.cache
def loaded(path: str) -> Words:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Words(path)


caches(__name__, loaded.cache_clear)


_sum = itemgetter(0)


def differencing(sizes: list[int], k: int) -> tuple[list[int], list[list[int]]]:
    """Sums and members (indices into sizes) of the k parts that multiway differencing makes; empty parts included."""
    # A partial partition: its non-zero (sum, members) in falling order; the other k - len parts are empty.
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes) if s]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = k - len(b)
        if len(a) <= free:
            merged = a + b
        else:  # a's largest go to b's empty parts, the others to b's smallest
            merged = a[:free] + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[free:], reversed(b))] + b[: len(b) - (len(a) - free)]
        merged.sort(key=_sum, reverse=True)
        low = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (low - merged[0][0], n, merged))
        n += 1
    parts = heap[0][2] if heap else []
    return [s for s, _ in parts] + [0] * (k - len(parts)), [_members(m) for _, m in parts] + [[] for _ in range(k - len(parts))]


def _members(tree) -> list[int]:
    """The leaves of nested pairs."""
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo += reversed(x)
        else:
            out.append(x)
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Members of near-equal windows, none over the capacity; the count rises until that holds."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        sums, members = differencing(sizes, k)
        if max(sums, default=0) <= capacity:
            return [m for m in members if m]
        k += 1


class _Group:
    """Packs pieces (rows whose third value is their length): full windows at once, the others when there are enough."""

    def __init__(self, fields: tuple[str, ...], first: int, window: int):
        self.fields, self.next, self.window = fields, first, window
        self.held: list[tuple] = []
        self.tokens = 0
        self.out: dict[str, list] = {f: [] for f in fields}

    def _place(self, row: tuple, offset: int) -> None:
        for f, v in zip(self.fields, (*row, self.next, offset)):
            self.out[f].append(v)

    def add(self, row: tuple) -> None:
        if row[2] == self.window:
            self._place(row, 0)
            self.next += 1
            return
        self.held.append(row)
        self.tokens += row[2]

    def close(self) -> None:
        for members in windows([r[2] for r in self.held], self.window):
            offset = 0
            for i in members:
                self._place(self.held[i], offset)
                offset += self.held[i][2]
            self.next += 1
        self.held, self.tokens = [], 0

    def take(self) -> dict[str, list]:
        out, self.out = self.out, {f: [] for f in self.fields}
        return out


def cut(ids: bytes, window: int = WINDOW, piece: int = PIECE):
    """(start, length) of a document's pieces: full windows, then its rest."""
    n = len(ids) // 4
    at = 0
    while at < n:
        size = window if n - at >= window else min(piece, n - at)
        yield at, size
        at += size


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW, piece: int = PIECE, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids (little-endian, 32 bits each)
    of every piece."""
    path = path or tokenizer_path(VOCABULARY)
    end = np.array([END_ID], dtype="<u4").tobytes()
    fields = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else []), "sequence_id", "offset")
    group_windows = GROUP_WINDOWS

    def run(batches):
        from pyspark import TaskContext

        words, group = loaded(path), _Group(fields, TaskContext.get().partitionId() << 32, window)
        for b in batches:
            for doc, ids in zip(b["doc_id"], words.encode_all(b["text"])):
                ids += end
                n = len(ids) // 4
                for at, size in cut(ids, window, piece):
                    part = ids[4 * at : 4 * (at + size)]
                    group.add((doc, at, size, zlib.crc32(part), n, *([part] if with_ids else [])))
                if group.tokens >= group_windows * window:
                    group.close()
                if len(group.out["doc_id"]) >= 4096:
                    yield group.take()
            yield group.take()
        group.close()
        yield group.take()

    kinds = {"doc_id": "long", "ids": "binary"}
    return map_batches(docs.select("doc_id", "text"), run, ", ".join(f"{f} {kinds.get(f, 'long')}" for f in fields))


def op7_pack_kk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))

"""Near-duplicate documents by MinHash and a multi-index Hamming join.

A document is its set of word shingles, and its signature 32 MinHash values cut to 16 bits. Documents whose shingle sets
are equal collapse at once. Signatures are joined by pigeonhole: cut into CHUNKS chunks, two signatures that differ in at
most ERRORS_TOTAL places differ in at most ERRORS places of one chunk, so each chunk is indexed under every choice of
ERRORS places left out. Every pair within the distance meets under a key; a pair is proposed under the first of its keys
only, and is linked if the full sets' similarity reaches the threshold. At the threshold itself (0.75) a signature
differs in more than ERRORS_TOTAL places with a probability of about 8e-6; more similar pairs fare better still.

A second signature of 128 values cut to 8 bits is compared before a pair is proposed: at the threshold it differs in more
than WIDE_ERRORS places with a probability below 1e-6, while texts that only share a passage differ in more.

Hot keys. Keys of one document are dropped at once; a key of up to CELL_ROWS documents is a cell. Where a cell has many
pairs, only those with its first member are proposed at first; then the cell is settled in one task that holds its members'
full sets: each pair within the distances is confirmed or refuted unless the links found before have joined it already. A key
with more documents passes through a task as a stream and is no cell: only its pairs with CENTRES members are proposed.
Where the links found so far have not joined all its documents into one component, those outside its largest component are
dealt to cells together with the others, part by part, and these cells are settled too; so a group of near copies costs rows
in proportion to its size. All that is complete, and no more than one link for each member leaves a cell.

Components come from repeated contraction along random priorities, entirely in Spark.

Defined results: null and empty texts (no words) have no shingles and are alone; texts of fewer words than a shingle are
one shingle; ties go to the smallest id; rows that repeat a doc_id share its fate, and a null doc_id never represents
others. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import caches, drop, map_batches, parts, table, written
from .substrings import _free

WORDS, PERCENT = 5, 75
SYMBOLS, ERRORS_TOTAL, CHUNKS, ERRORS = 32, 19, 10, 1
#: Signatures of a cell's part; members up to which all pairs of a cell are proposed at once.
CELL_ROWS, SMALL = 1024, 8
WIDE, WIDE_ERRORS = 128, 56
#: Members of a group that confirms one document's links.
STAR = 64
#: Ids of documents to confirm that may be broadcast (8 bytes each), so that only their texts are shuffled, and parts that a
#: component's members are dealt to when they get its least id.
BROADCAST_IDS, SALTS = 1_000_000, 16
#: Members of a hot key that all its others are compared with at first, and hot keys for which these may be broadcast (about
#: 250 bytes each).
CENTRES, BROADCAST_KEYS = 8, 20_000
#: Hashed words that a worker keeps.
CACHE = 500_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > CACHE:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v


_words = _Words()
caches(__name__, _words.clear)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit names of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=n)
    width = min(n, WORDS)
    total = np.full(n - width + 1, width, dtype=np.uint64)
    for i in range(width):
        total = _scramble(total + h[i : n - width + 1 + i] * _MIX[i])
    return np.unique(total)


@functools.cache
def _multipliers() -> np.ndarray:
    rng = np.random.default_rng(97)
    return rng.integers(1, 1 << 63, SYMBOLS + WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(names: np.ndarray) -> bytes:
    """MinHash values: SYMBOLS cut to 16 bits, then WIDE cut to 8 bits."""
    best = np.full(SYMBOLS + WIDE, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(names), 512):
        best = np.minimum(best, (names[at : at + 512, None] * _multipliers()).min(axis=0))
    best = _scramble(best)
    return best[:SYMBOLS].astype("<u2").tobytes() + best[SYMBOLS:].astype(np.uint8).tobytes()


@functools.cache
def key_places() -> list[list[int]]:
    """The places of a signature that each key takes: every chunk, less every choice of ERRORS places."""
    cuts = [SYMBOLS * i // CHUNKS for i in range(CHUNKS + 1)]
    return [[p for p in range(a, b) if p not in left] for a, b in zip(cuts, cuts[1:]) for left in combinations(range(a, b), ERRORS)]


def keys(sig: np.ndarray) -> np.ndarray:
    """Rows x keys: hashes of the key's number and its places' values."""
    out = np.empty((len(sig), len(key_places())), dtype=np.uint64)
    for k, places in enumerate(key_places()):
        h = np.full(len(sig), k + 1, dtype=np.uint64)
        for p in places:
            h = (h << np.uint64(16)) | sig[:, p]
        out[:, k] = _scramble(h)
    return out


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (names of the whole set), sig of every document."""

    def run(batches):
        import xxhash

        for b in batches:
            out = {k: [] for k in ("doc_id", "n_shingles", "h1", "h2", "sig")}
            for doc, text in zip(b["doc_id"], b["text"]):
                names = shingles(text)
                raw = names.tobytes()
                name = xxhash.xxh3_128_intdigest(raw)
                two = np.array([name >> 64, name & (1 << 64) - 1], dtype=np.uint64).view(np.int64).tolist()
                for k, v in zip(out, (doc, len(names), *two, signature(names) if len(names) else None)):
                    out[k].append(v)
            yield out

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, h1 long, h2 long, sig binary")


def _matrices(column: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(column), dtype=np.uint8).reshape(-1, 2 * SYMBOLS + WIDE)
    return np.ascontiguousarray(both[:, : 2 * SYMBOLS]).view("<u2"), both[:, 2 * SYMBOLS :]


def _cells(reps: DataFrame) -> DataFrame:
    """cell, slot, doc, hot: the documents that meet under a key; slot is the key's number. Hot: a key of too many for a cell."""

    def keyed(batches):
        n = len(key_places())
        for b in batches:
            yield {
                "key": pa.array(keys(_matrices(b.column("sig").to_pylist())[0]).view(np.int64).ravel()), "slot": pa.array(np.tile(np.arange(n, dtype=np.int32), b.num_rows)),
                "doc": pa.array(np.repeat(b.column("doc").to_numpy(), n)),
            }

    rows = map_batches(reps.select("doc", "sig"), keyed, "key long, slot int, doc long", raw=True)
    ordered = rows.repartition(max(parts(reps.sparkSession), 12), "key").sortWithinPartitions("key", "doc")
    limit = CELL_ROWS

    def met(batches):
        held, known = None, None  # the rows of a key that has not ended, and a hot key that has not
        for b in _ended(batches):
            if b is not None:
                now = tuple(b.column(k).to_numpy() for k in ("key", "slot", "doc"))
                held = now if held is None else tuple(np.concatenate(v) for v in zip(held, now))
            if held is None or not len(held[0]):
                continue
            key, slot, doc = held
            starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            size = np.diff(np.append(starts, len(key)))
            size[0] += limit * (known is not None and key[0] == known)
            of = np.repeat(size, np.diff(np.append(starts, len(key))))
            # a key that may go on stays, unless it is known to be hot
            to = len(key) if b is None or size[-1] > limit else int(starts[-1])
            known = key[-1] if to == len(key) else None
            out = np.flatnonzero(of[:to] > 1)
            yield {"cell": pa.array(key[out]), "slot": pa.array(slot[out].astype(np.int32)), "doc": pa.array(doc[out]), "hot": pa.array(of[out] > limit)}
            held = key[to:], slot[to:], doc[to:]

    return map_batches(ordered, met, "cell long, slot int, doc long, hot boolean", raw=True)


def _by_cell(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows joined with what there is for each cell, one row a cell; no cell's rows are one task's."""
    if cells.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(cells), "cell")
    salted = cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(salted, ["cell", "_salt"]).drop("_salt")


def _stars(hot: DataFrame, sigs: DataFrame) -> DataFrame:
    """a, b: the pairs of CENTRES of a hot key's members with its others that are alike, a < b."""
    chosen = hot.groupBy("cell", F.pmod(F.xxhash64("doc"), F.lit(CENTRES)).alias("part")).agg(F.min("doc").alias("centre"))
    known = chosen.join(sigs.select(F.col("doc").alias("centre"), F.col("sig").alias("c_sig")), "centre")
    # CENTRES of a key at most
    centres = written(known.groupBy("cell").agg(F.collect_list("centre").alias("centres"), F.collect_list("c_sig").alias("c_sigs")), "centres")
    rows = _by_cell(hot, centres).join(sigs, "doc").select("doc", "slot", "sig", "centres", "c_sigs")

    def run(batches):
        for b in batches:
            n, lists = b.num_rows, b.column("centres")
            count = lists.value_lengths().to_numpy()
            doc, centre = np.repeat(b.column("doc").to_numpy(), count), lists.flatten().to_numpy()
            sig, wide = _matrices([*b.column("sig").to_pylist(), *b.column("c_sigs").flatten().to_pylist()])
            slot = b.column("slot").to_numpy()
            i = np.repeat(np.arange(n), count)
            good = _alike(sig, wide, np.concatenate([slot, slot[i]]), i, n + np.arange(len(i))) & (doc != centre)
            yield {"a": pa.array(np.minimum(doc, centre)[good]), "b": pa.array(np.maximum(doc, centre)[good])}

    return map_batches(rows, run, "a long, b long", raw=True)


def _open_parts(hot: DataFrame, comps: DataFrame) -> DataFrame:
    """cell, slot, doc: cells in which each document of a hot key outside the key's largest component meets every other."""
    # written, as sizes and rows both come from it
    now = written(hot.join(comps, "doc"), "hot-members")
    sizes = now.groupBy("cell", "comp").agg(F.count(F.lit(1)).alias("_n"))
    keys_ = sizes.groupBy("cell").agg(F.sum("_n").alias("_all"), F.max(F.struct("_n", "comp")).alias("_top")).select("cell", "_all", F.col("_top.comp").alias("_big"), (F.col("_all") - F.col("_top._n")).alias("_others"))
    rows = _by_cell(now, written(keys_.where("_others > 0"), "open-keys"))
    half = CELL_ROWS // 2
    part = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "doc"), F.ceil(F.col(n) / half)).cast("long")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / half) - 1))
    columns = ["cell", "slot", "doc"]
    outside = rows.where(F.col("comp") != F.col("_big")).select(*columns, part(1, "_others").alias("i"), each("_all").alias("j"))
    every = rows.select(*columns, each("_others").alias("i"), part(2, "_all").alias("j"))
    return outside.unionByName(every).distinct().select(F.xxhash64("cell", "i", "j").alias("cell"), "slot", "doc")


def _ended(batches):
    """The batches, then None."""
    yield from batches
    yield None


def _first_key(a: np.ndarray, b: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Whether slot is the first key under which the signatures a and b meet."""
    same = a == b
    first = np.full(len(a), -1)
    for k in range(len(key_places()) - 1, -1, -1):
        first[same[:, key_places()[k]].all(axis=1)] = k
    return first == slot


def _alike(sig: np.ndarray, wide: np.ndarray, slot: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs are within both distances and meet under this key first."""
    out = [np.zeros(0, bool)]
    for at in range(0, len(i), 1 << 15):
        x, y = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
        good = (wide[x] != wide[y]).sum(axis=1) <= WIDE_ERRORS
        good[good] = (sig[x[good]] != sig[y[good]]).sum(axis=1) <= ERRORS_TOTAL
        good[good] = _first_key(sig[x[good]], sig[y[good]], slot[x[good]])
        out.append(good)
    return np.concatenate(out)


def _near(sig: np.ndarray, wide: np.ndarray, slot: np.ndarray, comp: np.ndarray, low: int, high: int):
    """Pairs (i, j), i < j, of one cell that lie in different components and are alike, a run of members i at a time."""
    n, columns = len(sig), np.ascontiguousarray(sig.T)
    for at in range(low, high, 256):
        to = min(high, at + 256)
        off = np.zeros((to - at, n), dtype=np.uint8)
        for place in columns:
            off += place[at:to, None] != place
        i, j = np.nonzero((off <= ERRORS_TOTAL) & (comp[at:to, None] != comp) & (np.arange(n) > np.arange(at, to)[:, None]))
        i += at
        good = _alike(sig, wide, slot, i, j)
        yield i[good], j[good]


def propose(cell: np.ndarray, comp: np.ndarray, sig: np.ndarray, wide: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Pairs (row numbers) to confirm in complete cells: all pairs of cells of few pairs, and those of the first member of
    the others, which are named too."""
    change = np.flatnonzero(cell[1:] != cell[:-1]) + 1
    starts = np.concatenate([[0], change])
    size = np.diff(np.append(starts, len(cell)))
    of = np.repeat(size, size)
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0, int))]
    later: list[int] = []
    for d in range(1, min(SMALL, len(cell))):
        i = np.flatnonzero((of[:-d] <= SMALL) & (cell[:-d] == cell[d:]))
        good = _alike(sig, wide, slot, i, i + d)
        found.append((i[good], i[good] + d))
    for start, n in zip(starts[size > SMALL].tolist(), size[size > SMALL].tolist()):
        rows = slice(start, start + n)
        mine, count = [], 0
        for i, j in _near(sig[rows], wide[rows], slot[rows], comp[rows], 0, n):
            mine.append((i + start, j + start))
            count += len(i)
            if count > 2 * n:
                mine = [(i[i == start], j[i == start]) for i, j in mine]
                later.append(int(cell[start]))
                break
        found += mine
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]), later


def _in_cells(ordered: DataFrame, columns: list[str], of, schema: str) -> DataFrame:
    """What of() makes of arrays of complete cells; rows come ordered by cell. columns: the long ones beside cell."""

    def run(batches):
        held = None
        for b in _ended(batches):
            if b is not None:
                now = [b.column(k).to_numpy().astype(np.int64) for k in ("cell", *columns)] + list(_matrices(b.column("sig").to_pylist()))
                if "names" in b.schema.names:
                    now.append(np.array([*b.column("names").to_pylist(), None], dtype=object)[:-1])
                held = now if held is None else [np.concatenate(v) for v in zip(held, now)]
            if held is None or not len(held[0]):
                continue
            change = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1
            to = len(held[0]) if b is None else (int(change[-1]) if len(change) else 0)
            if to:
                yield of(*(v[:to] for v in held))
                held = [v[to:] for v in held]

    return map_batches(ordered, run, schema, raw=True)


def _candidates(cells: DataFrame, sigs: DataFrame) -> DataFrame:
    """a, b: pairs to confirm (a < b); where b is null, a is a cell to settle."""
    rows = cells.join(sigs, "doc").select("cell", "slot", "doc", "comp", "sig")
    ordered = rows.repartition(max(parts(cells.sparkSession), 12), "cell").sortWithinPartitions("cell", "doc")

    def of(cell, doc, comp, slot, sig, wide):
        i, j, more = propose(cell, comp, sig, wide, slot)
        x, y = np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])
        return {"a": pa.array(np.concatenate([x, np.array(more, dtype=np.int64)])), "b": pa.array(np.concatenate([y, np.zeros(len(more), np.int64)]), mask=np.repeat([False, True], [len(x), len(more)]))}

    return _in_cells(ordered, ["doc", "comp", "slot"], of, "a long, b long")


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets have percent of their union in common."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of documents. Texts without one of these ids (column doc) are left out before they are shuffled where the
    ids are few enough to be broadcast; else the join that follows leaves them out."""
    texts = docs.select("doc_id", "text")
    few = ids.select(F.col("doc").alias("_id")).distinct()
    if few.limit(BROADCAST_IDS + 1).count() > BROADCAST_IDS:
        return texts
    return texts.join(F.broadcast(few), F.col("doc_id") == F.col("_id"), "left_semi")


def settle(cells: DataFrame, sigs: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b: links between members of these cells that lie in different components, enough to join all that are linked."""

    def named(batches):
        for b in batches:
            yield {"doc": b["doc_id"], "names": [shingles(t).tobytes() for t in b["text"]]}

    wanted = cells.select(F.col("doc").alias("_d")).distinct()
    names = map_batches(_texts_of(docs, cells).join(wanted.hint("merge"), F.col("doc_id") == F.col("_d"), "left_semi").select("doc_id", "text"), named, "doc long, names binary")
    rows = cells.join(names.join(sigs, "doc"), "doc").select("cell", "slot", "doc", "comp", "sig", "names")
    ordered = rows.repartition(max(parts(cells.sparkSession), 12), "cell").sortWithinPartitions("cell", "doc")

    def of(cell, doc, comp, slot, sig, wide, names):
        out: dict[str, list] = {"a": [], "b": []}
        for rows in np.split(np.arange(len(cell)), np.flatnonzero(cell[1:] != cell[:-1]) + 1):
            root: dict[int, int] = {}

            def find(x):
                while (y := root.get(x, x)) != x:
                    x = y
                return x

            sets = [np.frombuffer(names[r], dtype=np.uint64) for r in rows]
            c = comp[rows]
            for i, j in _near(sig[rows], wide[rows], slot[rows], c, 0, len(rows)):
                for x, y in zip(i.tolist(), j.tolist()):
                    p, q = find(int(c[x])), find(int(c[y]))
                    if p != q and linked(sets[x], sets[y]):
                        root[max(p, q)] = min(p, q)
                        out["a"].append(int(doc[rows[x]]))
                        out["b"].append(int(doc[rows[y]]))
        return out

    return _in_cells(ordered, ["doc", "comp", "slot"], of, "a long, b long")


def confirm(edges: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those pairs (a, b) whose full shingle sets have percent of their union in common."""
    spark = docs.sparkSession
    degree = edges.groupBy(F.col("a").alias("_a")).agg(F.ceil(F.count(F.lit(1)) / STAR).alias("_stars"))
    salted = edges.join(degree, F.col("a") == F.col("_a")).select("a", F.pmod(F.xxhash64("b"), F.col("_stars")).alias("salt"), "b")
    members = salted.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("doc"))
    needs = members.unionByName(salted.select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("doc")).distinct())
    texts = _texts_of(docs, edges.select(F.col("a").alias("doc")).unionByName(edges.select(F.col("b").alias("doc")))).withColumnRenamed("doc_id", "_doc")
    # always by sorting: the texts' place in the plan does not change with the number of pairs
    rows = needs.join(texts.hint("merge"), F.col("doc") == F.col("_doc")).drop("_doc")
    ordered = rows.repartition(parts(spark), "a", "salt").sortWithinPartitions("a", "salt", "role", "doc")

    def run(batches):
        group, centre = None, []
        for b in batches:
            out: dict[str, list] = {"a": [], "b": []}
            for a, salt, role, doc, text in zip(b["a"], b["salt"], b["role"], b["doc"], b["text"]):
                if (a, salt) != group:
                    group, centre = (a, salt), []
                names = shingles(text)
                if role == 0:
                    centre.append(names)
                    continue
                for own in centre:
                    if linked(own, names, percent):
                        out["a"].append(a)
                        out["b"].append(doc)
                        break
            yield out

    return map_batches(ordered, run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """doc, comp: for each end of an edge a label that its whole component shares."""
    spark = edges.sparkSession
    order = lambda c: F.struct(F.xxhash64(F.lit(41), c).alias("h"), F.col(c).alias("id"))
    left, steps = written(edges.where("a <> b").distinct(), "edges"), []
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(left.select(F.col("b").alias("u"), F.col("a").alias("v")))
        to = ends.groupBy("u").agg(F.min(order("v")).alias("m")).select("u", F.least(order("u"), "m").getField("id").alias("to"))
        step = written(to, "contraction")
        steps.append(step)
        s1, s2 = step.select(F.col("u").alias("a"), F.col("to").alias("x")), step.select(F.col("u").alias("b"), F.col("to").alias("y"))
        moved = left.join(s1, "a").join(s2, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b")
        nearer = written(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        drop(left)
        left = nearer
    if not steps:
        return spark.createDataFrame([], "doc long, comp long")
    label = steps[0].select(F.col("u").alias("doc"), F.col("to").alias("comp"))
    for step in steps[1:]:
        label = label.join(step, F.col("comp") == F.col("u"), "left").select("doc", F.coalesce("to", "comp").alias("comp"))
    out = written(label, "labels")
    for step in steps:
        drop(step)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    sets = written(described(docs), "sets")
    real = sets.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    reps = written(real.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig")), "classes")
    met = written(_cells(reps), "cells")
    _free(docs.sparkSession)
    sigs = reps.select("doc", F.col("doc").alias("comp"), "sig")
    hot, cells = met.where("hot").drop("hot"), met.where("NOT hot").drop("hot")
    some_hot = not hot.isEmpty()
    found = _candidates(cells, sigs)
    proposed = written(found.unionByName(_stars(hot, sigs)) if some_hot else found, "proposals")
    links = written(confirm(proposed.where(F.col("b").isNotNull()).distinct(), docs), "links")
    _free(docs.sparkSession)
    label = components(links)
    open_cells = cells.join(proposed.where(F.col("b").isNull()).select(F.col("a").alias("cell")), "cell", "left_semi")
    now = label.select(F.col("doc").alias("_d"), F.col("comp").alias("_c"))
    sigs = written(reps.join(now, F.col("doc") == F.col("_d"), "left").select("doc", F.coalesce("_c", "doc").alias("comp"), "sig"), "labelled")
    if some_hot:
        open_cells = open_cells.unionByName(_open_parts(hot, sigs.select("doc", "comp")))
    open_cells = written(open_cells, "open-cells")
    if not open_cells.isEmpty():
        more = written(settle(open_cells, sigs, docs), "settled")
        _free(docs.sparkSession)
        label = components(links.unionByName(more))
        drop(more)
    for used in (met, proposed, links, sigs, open_cells):
        drop(used)
    # each component's least id goes to SALTS parts of its members: no component is one task's
    least = label.groupBy("comp").agg(F.min("doc").alias("component")).select(F.col("comp").alias("_c"), "component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    part = F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")
    label = label.join(least, (F.col("comp") == F.col("_c")) & (part == F.col("_salt"))).select(F.col("doc").alias("_d"), "component")
    named = reps.join(label, F.col("doc") == F.col("_d"), "left").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.coalesce("component", "doc").alias("component"))
    out = sets.join(named, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("n_shingles") > 0), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each component: the row of the smallest id, and of rows that repeat it the first;
    a row without an id stays where its component has none with one.

    Rows are judged under numbers of their own, so that rows that share a doc_id are rows like any others: equal texts
    leave one row, different texts are compared as such. The numbers are kept with the rows in a table, as a second
    reading might give others."""
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    judged = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row")).getField("_row")
    chosen = judged.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(first.alias("_row"))
    return rows.join(chosen.select("_row"), "_row", "left_semi").select(*docs.columns)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(list_slice(ws, i, i + 4), ' ') END AS s
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""

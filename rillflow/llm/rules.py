"""Quality rules: gradient-boosted trees over document statistics.

The trees are fitted in numpy on a bounded sample of labelled documents and flattened into node arrays, so that a batch
of documents is scored level by level without a Python loop over rows. Chosen statistics are monotonic: more of them can
never raise a score (or never lower it); splits that would break this are not taken, and children's values are bounded by
the midpoint of their parents' split.

A document is kept if the base rule passes (at least 20 words, and at most 30 % of the words in 8-word windows that
occur twice or more) and the trees' score reaches THRESHOLD.

Defined results: null and empty texts have no words and fail the base rule; texts are read whole; equal texts get equal
results; every row is judged, repeated rows and rows without an id too; an empty table gives no rows. Without labelled
documents of both classes every document that passes the base rule is kept. Only doc_id and text are read (all columns, by
filter_documents(), which keeps them), so extra columns' names cannot clash. For fitting, an id counts once: with the least of
its labels, and with one of its texts' statistics (the least, in order) where its rows differ.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

#: Labelled documents that the trees are fitted on, at most: those of the smallest hashes of their ids.
SAMPLE_ROWS = 12_000
#: A document with a lower score is rejected.
THRESHOLD = 0.5
SYMBOLS = "#*$%&|<>"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: The statistics, and the sign of a monotonic constraint: -1, more is never better; 1, more is never worse.
STATS = {
    "words_log": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 1, "top_word_share": -1,
    "upper_share": -1, "digit_share": 0, "punctuation_share": 0, "next_equal_share": -1, "short_line_share": 0, "line_words": 0, "symbol_word_share": -1, "repeat_run_share": -1, "capital_word_share": -1, "exclaim_per_word": -1,
}

_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
_PUNCT = re.compile(r"[.,;:]")


def base(text: str, words: list[str]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    dup = 0
    if len(lines) > 1:
        counts = Counter(lines)
        if len(counts) < len(lines):
            dup = sum(n - 1 for line, n in counts.items() if n > 1 and WORD.search(line))
    return chars, symbols, dup, repeat_words(words)


def repeat_words(words: list[str]) -> int:
    """Words that lie in an 8-word window which occurs twice or more in the text."""
    n = len(words)
    if n < 9:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    if len(number) == n:
        return 0
    for step in (1, 2, 4):  # names of pairs of names: of 2, 4, then 8 words
        pairs = ids[:-step] * (n + 1) + ids[step:]
        names, ids = np.unique(pairs, return_inverse=True)
        if len(names) == len(pairs):
            return 0
    again = np.flatnonzero(np.bincount(ids)[ids] > 1)
    cover = np.zeros(n + 1, dtype=np.int64)
    cover[again] += 1
    np.subtract.at(cover, again + 8, 1)
    return int((np.cumsum(cover) > 0).sum())


def statistics(text: str, words: list[str], b: tuple[int, int, int, int]) -> list[float]:
    chars, symbols, dup, repeat = b
    n = max(1, len(words))
    counts = Counter(words)
    lines = text.count("\n") + 1
    length = max(1, len(text))
    return [
        np.log1p(len(words)), chars / n, symbols / n, dup / lines, repeat / n, len(counts) / n ** 0.9, max(counts.values(), default=0) / n,
        sum(c * len(_UPPER.findall(w)) for w, c in counts.items()) / length, sum(c * len(_DIGIT.findall(w)) for w, c in counts.items()) / length, sum(map(text.count, ".,;:")) / n, sum(map(str.__eq__, words, words[1:])) / n,
        sum(len(x) < 20 for x in text.split("\n")) / lines, n / lines, sum(c for w, c in counts.items() if any(s in w for s in SYMBOLS)) / n, _in_runs(words) / n, sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / n, text.count("!") / n,
    ]


def _in_runs(words: list[str]) -> int:
    """Words in runs of three or more equal words."""
    total = run = 0
    last = None
    for w in words:
        if w == last:
            run += 1
        else:
            total += run if run >= 3 else 0
            last, run = w, 1
    return total + (run if run >= 3 else 0)


@dataclass
class Trees:
    """Node arrays of all trees: a node's column, threshold and children (a leaf is its own child), and a leaf's value."""

    start: float
    roots: np.ndarray
    column: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows of statistics; all rows and trees go down one level at a time."""
        x = np.asarray(x, dtype=np.float64).reshape(-1, len(STATS))
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.column[at]] <= self.threshold[at], self.left[at], self.right[at])
        margin = self.start + self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


@dataclass
class _Grower:
    column: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def leaf(self, v: float) -> int:
        i = len(self.value)
        for name, x in (("column", 0), ("threshold", np.inf), ("left", i), ("right", i), ("value", v)):
            getattr(self, name).append(x)
        return i


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 2.0, ridge: float = 1.0) -> Trees:
    """Logistic boosting with histogram splits. signs: the monotonic constraint of each column."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    grown, roots = _Grower(), []
    rate_1 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(rate_1 / (1 - rate_1)))
    margin = np.full(len(y), start)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        here = float(np.clip(-total_g / (total_h + ridge), low, high))
        me = grown.leaf(rate * here)
        if level == depth or total_h < 2 * least:
            margin[rows] += rate * here
            return me
        found = (1e-6, -1, -1, 0.0, 0.0)
        for c in range(x.shape[1]):
            size = len(edges[c]) + 1
            if size < 2:
                continue
            hg = np.bincount(binned[rows, c], g[rows], size).cumsum()[:-1]
            hh = np.bincount(binned[rows, c], h[rows], size).cumsum()[:-1]
            vl, vr = np.clip(-hg / (hh + ridge), low, high), np.clip(-(total_g - hg) / (total_h - hh + ridge), low, high)
            gain = -(hg * vl + 0.5 * (hh + ridge) * vl**2) - ((total_g - hg) * vr + 0.5 * (total_h - hh + ridge) * vr**2) + (total_g * here + 0.5 * (total_h + ridge) * here**2)
            gain[(hh < least) | (total_h - hh < least) | (signs[c] * (vr - vl) < 0)] = 0
            b = int(gain.argmax())
            if gain[b] > found[0]:
                found = (float(gain[b]), c, b, float(vl[b]), float(vr[b]))
        gain, c, b, vl, vr = found
        if c < 0:
            margin[rows] += rate * here
            return me
        mid = (vl + vr) / 2
        bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[signs[c]]
        goes = binned[rows, c] <= b
        grown.column[me], grown.threshold[me] = c, float(edges[c][b])
        grown.left[me] = grow(rows[goes], g, h, level + 1, *bounds[0])
        grown.right[me] = grow(rows[~goes], g, h, level + 1, *bounds[1])
        return me

    everything = np.arange(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(everything, p - y, np.maximum(p * (1 - p), 1e-6), 0, -8.0, 8.0))
    return Trees(start, np.array(roots), np.array(grown.column), np.array(grown.threshold), np.array(grown.left), np.array(grown.right), np.array(grown.value), depth)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the base figures and stats (array<double>) of every text."""

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "stats")}
            for doc, text in zip(b["doc_id"], b["text"]):
                words = WORD.findall(text or "")
                figures = base(text or "", words)
                for k, v in zip(out, (doc, len(words), *figures, statistics(text or "", words, figures))):
                    out[k].append(v)
            yield out

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, stats array<double>")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees | None:
    """Trees fitted on at most sample_rows labelled documents (those of the smallest id hashes); None without both classes."""
    fit_on = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("y"))
    fit_on = fit_on.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    fit_on = fit_on.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(sample_rows)
    # the sample is bounded by its parameter, so it may be broadcast
    rows = measured(docs.select("doc_id", "text").join(F.broadcast(fit_on.select("doc_id")), "doc_id", "left_semi")).select("doc_id", "stats")
    # one row for each id, however often it comes: sample_rows rows at most reach the driver
    got = rows.groupBy("doc_id").agg(F.min("stats").alias("stats")).join(F.broadcast(fit_on), "doc_id").collect()
    got.sort(key=lambda r: r.doc_id)
    y = np.array([r.y for r in got], dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return None
    return fit(np.array([r.stats for r in got]), y, list(STATS.values()))


def judge(docs: DataFrame, trees: Trees | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, the base figures, base_failed, score, kept of every document."""

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")}
            stats = []
            for doc, text in zip(b["doc_id"], b["text"]):
                words = WORD.findall(text or "")
                n, figures = len(words), base(text or "", words)
                stats.append(statistics(text or "", words, figures))
                for k, v in zip(out, (doc, n, *figures, n < 20 or 100 * figures[3] > 30 * n)):
                    out[k].append(v)
            score = trees.score(np.array(stats)) if trees and stats else np.ones(len(stats))
            out["score"] = score.tolist()
            out["kept"] = [not bad and bool(s >= threshold) for bad, s in zip(out["base_failed"], score)]
            yield out

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")


def filter_documents(docs: DataFrame, trees: Trees | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text passes the base rule and the trees."""
    names = docs.columns

    def run(batches):
        for b in batches:
            keep, stats, at = [], [], []
            for i, text in enumerate(b["text"]):
                words = WORD.findall(text or "")
                if len(words) < 20:
                    continue
                figures = base(text, words)
                if 100 * figures[3] <= 30 * len(words):
                    stats.append(statistics(text, words, figures))
                    at.append(i)
            if at:
                score = trees.score(np.array(stats)) if trees else np.ones(len(at))
                keep = [i for i, s in zip(at, score) if s >= threshold]
            yield {c: [b[c][i] for i in keep] for c in names}

    return map_batches(docs, run, docs.schema.toDDL())


def op9_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))

"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns' spans always stay. The network, trained in numpy on the driver from labelled spans, adds spans that the
patterns miss (local phone formats, written-out at-signs, badly separated cards). It reads every text whole, in windows
that overlap; each window is decoded by Viterbi, and positions in an overlap follow the window whose middle is nearer, so
that runs of one tag over window borders are one span. A decoded span is added if it has its kind's outward shape and
touches no pattern span.

Labelled spans for training: a bounded sample of whole documents (those of the smallest id hashes), where the patterns' own
matches and generated spans inserted at seeded places are the labels; generated dates, versions, prices and plain numbers
are inserted without a label.

Defined results: null texts are empty and have no spans; equal texts get equal spans; every row is read, repeated rows and
rows without an id too; an empty table gives no rows. Only doc_id and text are read (all columns, by redact(), which keeps
them), so extra columns' names cannot clash. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

KINDS = ("email", "ip", "card", "phone")
#: Documents that the network is trained on, at most, and characters that they have in all: a document that would go beyond
#: is passed over, so that texts are whole.
SAMPLE_DOCS, SAMPLE_CHARS = 300, 2_000_000
HIDDEN, TAGS, ROUNDS = 12, 5, 400
WINDOW, OVERLAP = 256, 32

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
# A digit run is tried at its first digit only: a later start of the same run ends in the same failure.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Shapes of what the network may add: written-out or spaced at-signs, local phone formats.
_MAIL_SHAPE = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE_SHAPE = re.compile(r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}")
_DOUBLED = [sum(divmod(2 * d, 10)) for d in range(10)]


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of the patterns' matches."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", free)
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# Characters are classes: letters without case or accent, one class for digits, single classes for the marks that matter.
_MARKS = "@.-+() _:/,\n\"'=%[]"


def _classes() -> np.ndarray:
    table_ = np.full(256, 1, dtype=np.uint8)  # another character
    for i in range(256):
        c = chr(i)
        if c.isdigit() and c.isascii():
            table_[i] = 2
        elif c.isascii() and c.isalpha():
            table_[i] = 3 + ord(c.lower()) - ord("a")
        elif c.isalpha():
            table_[i] = 29
        elif c in _MARKS:
            table_[i] = 30 + _MARKS.index(c)
    return table_


CLASS = _classes()
N_CLASSES = 30 + len(_MARKS)


def classes(text: str) -> np.ndarray:
    """The class of each code point; 0 is kept for padding."""
    return CLASS[np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8)]


class Tagger:
    """Two LSTMs (one backwards) over classes, a linear layer to tag scores, and CRF transitions."""

    def __init__(self, seed: int = 5, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        f = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("x", f(N_CLASSES, 4 * hidden)), ("h", f(hidden, 4 * hidden)))}
        for d in "fb":
            self.p[f"x{d}"][:, hidden : 2 * hidden] += 1  # forget gates start open
        self.p |= {"o": f(2 * hidden, TAGS), "b": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}
        self.hidden = hidden

    def run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states, steps x windows x hidden, of one direction, and what their gradient needs."""
        n, wx, wh = self.hidden, self.p[f"x{d}"].copy(), self.p[f"h{d}"].copy()
        wx[:, : 3 * n] *= 0.5  # sigmoid(z) = tanh(z / 2) / 2 + 1 / 2
        wh[:, : 3 * n] *= 0.5
        steps, width = x.shape
        out = np.empty((steps, width, n), np.float32)
        h, c = np.zeros((width, n), np.float32), np.zeros((width, n), np.float32)
        kept = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = np.take(wx, x[t], axis=0)
            z += h @ wh
            np.tanh(z, out=z)
            gates = z[:, : 3 * n]
            gates *= 0.5
            gates += 0.5
            last = c
            c = gates[:, n : 2 * n] * c
            c += gates[:, :n] * z[:, 3 * n :]
            tc = np.tanh(c)
            kept.append((t, h, last, z, tc))
            h = gates[:, 2 * n :] * tc
            out[t] = h
        return out, kept

    def states(self, x: np.ndarray, d: str) -> np.ndarray:
        """run() for decoding: steps x hidden x windows, so that each gate is one stretch of memory."""
        n = self.hidden
        scale = np.where(np.arange(4 * n) < 3 * n, 0.5, 1).astype(np.float32)
        wx, wh = self.p[f"x{d}"] * scale, np.ascontiguousarray((self.p[f"h{d}"] * scale).T)
        steps, width = x.shape
        out = np.empty((steps, n, width), np.float32)
        h, c, z = np.zeros((n, width), np.float32), np.zeros((n, width), np.float32), np.empty((4 * n, width), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.copyto(z, np.take(wx, x[t], axis=0).T)
            z += wh @ h
            np.tanh(z, out=z)
            gates = z[: 3 * n]
            gates *= 0.5
            gates += 0.5
            c *= gates[n : 2 * n]
            c += gates[:n] * z[3 * n :]
            h = np.multiply(gates[2 * n :], np.tanh(c), out=out[t])
        return out

    def _stretch(self, e: np.ndarray) -> np.ndarray:
        """For each window an upper bound of what any stretch of other tags gains over "none" throughout.

        A stretch gains its tags' scores over "none", at most ``inner`` at each transition inside it, and at most ``edge``
        (usually a loss) where it begins and where it ends within the window."""
        t = self.p["t"]
        inner, edge = float(t[1:, 1:].max() - t[0, 0]), float(max(t[0, 1:].max(), t[1:, 0].max()) - t[0, 0])
        d = e[:, 1:].max(axis=1) - e[:, 0] + inner
        best = s = total = high = low = d[0]
        low = np.minimum(low, 0)
        for x in d[1:]:
            s = np.maximum(s, 0) + x
            best = np.maximum(best, s)
            high = np.maximum(high, total := total + x)
            low = np.minimum(low, total)
        return np.maximum(np.maximum(best + 2 * edge, np.maximum(high, total - low) + edge), total) - inner + 1e-4

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tag path (steps x windows) of each window."""
        n, o, t = self.hidden, self.p["o"].T, self.p["t"]
        e = np.matmul(o[:, :n], self.states(x, "f"))
        e += np.matmul(o[:, n:], self.states(x, "b"))
        e += self.p["b"][:, None]
        best = np.zeros(x.shape, np.uint8)
        # Only windows in which some stretch of other tags could beat "none" are searched; the bound is never too low.
        wide = np.flatnonzero(self._stretch(e) > 0)
        if not len(wide):
            return best
        e = np.ascontiguousarray(e[:, :, wide])
        a, back = e[0], np.empty(e.shape, np.uint8)
        for i in range(1, len(e)):
            m = a[:, None, :] + t[:, :, None]
            back[i] = m.argmax(axis=0)
            a = m.max(axis=0) + e[i]
        at = a.argmax(axis=0)
        rows = np.arange(len(wide))
        for i in range(len(e) - 1, -1, -1):
            best[i, wide] = at
            at = back[i][at, rows]
        return best

    def step(self, x: np.ndarray, y: np.ndarray, state: dict, rate: float) -> float:
        """One Adam step on the negative log-likelihood of the tag paths y; x and y are steps x windows."""
        n, p = self.hidden, self.p
        hf, kf = self.run(x, "f")
        hb, kb = self.run(x, "b")
        e = hf @ p["o"][:n] + hb @ p["o"][n:] + p["b"]
        steps, width = x.shape
        rows = np.arange(width)
        lse = lambda m, axis: (top := m.max(axis=axis, keepdims=True), top.squeeze(axis) + np.log(np.exp(m - top).sum(axis=axis)))[1]
        a = np.empty_like(e)
        a[0] = e[0]
        for i in range(1, steps):
            a[i] = lse(a[i - 1][:, :, None] + p["t"], 1) + e[i]
        z = lse(a[-1], 1)
        back = np.zeros((width, TAGS), np.float32)
        de, dt = np.empty_like(e), np.zeros_like(p["t"])
        for i in range(steps - 1, -1, -1):
            de[i] = np.exp(a[i] + back - z[:, None])
            if i:
                m = p["t"] + (e[i] + back)[:, None, :]
                dt += np.exp(a[i - 1][:, :, None] + m - z[:, None, None]).sum(axis=0)
                back = lse(m, 2)
        gold = e[np.arange(steps)[:, None], rows, y].sum() + p["t"][y[:-1], y[1:]].sum()
        loss = float(z.sum() - gold) / (steps * width)
        de[np.arange(steps)[:, None], rows, y] -= 1
        np.subtract.at(dt, (y[:-1].ravel(), y[1:].ravel()), 1)
        g = {"t": dt, "b": de.sum(axis=(0, 1)), "o": np.concatenate([np.einsum("tbn,tbk->nk", h, de) for h in (hf, hb)])}
        for d, kept, at in (("f", kf, slice(0, n)), ("b", kb, slice(n, 2 * n))):
            gx, gh = np.zeros_like(p[f"x{d}"]), np.zeros_like(p[f"h{d}"])
            dh, dc = np.zeros((width, n), np.float32), np.zeros((width, n), np.float32)
            wo, wh = p["o"][at].T, p[f"h{d}"].T
            for i, h, c, gates, tc in reversed(kept):
                dh = dh + de[i] @ wo
                s, u = gates[:, : 3 * n], gates[:, 3 * n :]
                dc = dc + dh * s[:, 2 * n :] * (1 - tc * tc)
                ds = np.concatenate([dc * u, dc * c, dh * tc], axis=1) * s * (1 - s)
                dz = np.concatenate([ds, dc * s[:, :n] * (1 - u * u)], axis=1)
                np.add.at(gx, x[i], dz)
                gh += h.T @ dz
                dh, dc = dz @ wh, dc * s[:, n : 2 * n]
            g[f"x{d}"], g[f"h{d}"] = gx, gh
        k = state["k"] = state.get("k", 0) + 1
        for name, v in g.items():
            v = np.clip(v / width, -5, 5)
            m, q = state.get(name, (0, 0))
            m, q = 0.9 * m + 0.1 * v, 0.99 * q + 0.01 * v * v
            state[name] = m, q
            p[name] = (p[name] - rate * (m / (1 - 0.9**k)) / (np.sqrt(q / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
        return loss


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def generated(r: random.Random) -> tuple[str, int]:
    """A made-up string and its tag (0: not personal)."""
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 8)))
    kind = r.randint(0, 9)
    if kind < 3:
        at = r.choice(["@", "@", " (at) ", "[at]", " @ "])
        return f"{word()}{r.choice(['', '.', '_'])}{r.choice(['', word(), _digits(r, 2)])}{at}{word()}.{r.choice(['com', 'org', 'example.com', 'net', 'de'])}", 1
    if kind == 3:
        return ".".join(str(r.randint(0, 255)) for _ in range(4)), 2
    if kind == 4:
        sep = r.choice([" ", "-", "", ".", "."])
        first = _digits(r, 15)
        digits = next(first + d for d in "0123456789" if luhn(first + d))
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4)), 3
    if kind < 7:
        return r.choice([f"+{r.randint(1, 99)} ({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}", f"({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}", f"{_digits(r, 3)}-{_digits(r, 3)}-{_digits(r, 4)}", f"+{_digits(r, 2)} {_digits(r, 3)} {_digits(r, 7)}", f"{_digits(r, 3)}.{_digits(r, 3)}.{_digits(r, 4)}", f"0{_digits(r, 2)} {_digits(r, 4)} {_digits(r, 4)}"]), 4
    return r.choice([f"{r.randint(1900, 2099)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"v{r.randint(0, 9)}.{r.randint(0, 99)}.{r.randint(0, 9)}", f"{r.randint(0, 9999)}.{_digits(r, 2)}", _digits(r, r.randint(1, 6)), f"{_digits(r, 2)}:{_digits(r, 2)}:{_digits(r, 2)}", f"$${_digits(r, 3)}", f"@{word()}", "".join(r.choice("0123456789abcdef") for _ in range(40))]), 0


def train(texts: list[str], rounds: int = ROUNDS, width: int = 96, steps: int = 96, seed: int = 11) -> Tagger:
    """A tagger fitted on windows of texts, whose labels are the patterns' matches and inserted generated spans."""
    r = random.Random(seed)
    xs, ys = [], []
    for text in texts or [""]:
        out, tags, at = [], [], 0
        own = np.zeros(len(text), np.uint8)
        for s, k, e in base_spans(text):
            own[s:e] = k + 1
        while at < len(text) or not out:
            to = at + r.randint(20, 120)
            while to < len(text) and own[min(to, len(text) - 1)]:
                to += 1
            out.append(text[at:to])
            tags.append(own[at:to])
            span, tag = generated(r)
            pad = r.choice([" ", "", "\n", ", "]), r.choice([" ", ".", ",", "\n"])
            for s, k in ((pad[0], 0), (span, tag), (pad[1], 0)):
                out.append(s)
                tags.append(np.full(len(s), k, np.uint8))
            at = to
        xs.append(classes("".join(out)))
        ys.append(np.concatenate(tags))
    x, y = np.concatenate(xs), np.concatenate(ys)
    if len(x) < steps + 1:
        x, y = np.resize(x, steps + 1), np.resize(y, steps + 1)
    tagger, state, rng = Tagger(), {}, np.random.default_rng(seed)
    for i in range(rounds):
        at = rng.integers(0, len(x) - steps, width) + np.arange(steps)[:, None]
        tagger.step(x[at].astype(np.int64), y[at].astype(np.int64), state, 0.03 if i < rounds * 0.6 else 0.008)
    return tagger


def plausible(kind: int, s: str) -> bool:
    """Whether a decoded string has the outward shape of its kind; every form that generated() labels has."""
    digits = sum(c.isascii() and c.isdigit() for c in s)
    if kind == 0:
        return _MAIL_SHAPE.fullmatch(s) is not None
    if kind == 1:
        return _IP.fullmatch(s) is not None and all(int(p) <= 255 for p in s.split("."))
    if kind == 2:
        return 13 <= digits <= 19 and len(s) <= digits + 6 and luhn("".join(c for c in s if c.isascii() and c.isdigit()))
    return 9 <= digits <= 15 and _PHONE_SHAPE.fullmatch(s) is not None


def decode_texts(tagger: Tagger, texts: list[str], block: int = 2048) -> list[list[tuple[int, int, int]]]:
    """(start, kind's index, end) of the runs of a tag in each text, read whole in overlapping windows."""
    step = WINDOW - OVERLAP
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    counts = np.where(lengths > 0, np.maximum(1, -(-(lengths - OVERLAP) // step)), 0)
    offset = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.concatenate([classes(t) for t in texts] + [np.zeros(WINDOW, np.uint8)])
    tags = np.zeros(int(offset[-1]), np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = first * step
    for at in range(0, len(owner), block):
        o, s = owner[at : at + block], starts[at : at + block]
        inside = np.arange(WINDOW)[:, None] + s
        x = flat[np.minimum(inside + offset[o], len(flat) - 1)]
        x[inside >= lengths[o]] = 0
        got = tagger.decode(x)
        for j in np.flatnonzero(got.any(axis=0)):
            d, begin = o[j], s[j]
            low = 0 if begin == 0 else OVERLAP // 2
            last = begin + WINDOW >= lengths[d]
            high = int(min(lengths[d] - begin, WINDOW)) if last else WINDOW - OVERLAP // 2
            a = int(offset[d] + begin)
            tags[a + low : a + high] = got[low:high, j]
    edge = np.flatnonzero(np.diff(tags, prepend=0, append=0) != 0) if len(tags) else []
    cuts = np.unique(np.concatenate([edge, offset])) if len(tags) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if tags[a]:
            d = int(np.searchsorted(offset, a, side="right")) - 1
            out[d].append((int(a - offset[d]), int(tags[a]) - 1, int(b - offset[d])))
    return out


def all_spans(tagger: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """(pattern spans, all spans) of each text."""
    out = []
    for text, found in zip(texts, decode_texts(tagger, texts)):
        own = base_spans(text)
        more = []
        for s, k, e in found:
            while s < e and not text[s].isalnum() and text[s] not in "+(":
                s += 1
            while e > s and not text[e - 1].isalnum():
                e -= 1
            if plausible(k, text[s:e]) and not any(s < y and x < e for x, _, y in own) and (s == 0 or not text[s - 1].isalnum()) and (e == len(text) or not text[e].isalnum()):
                more.append((s, k, e))
        out.append((own, sorted(own + more)))
    return out


def sampled_tagger(docs: DataFrame) -> Tagger:
    """A tagger trained on the driver on a bounded sample of docs; rows without an id are not in it.

    The ids are chosen first, so that a task sends ids to the driver, and texts of chosen documents only."""
    order = F.xxhash64(F.lit(3), "doc_id"), F.col("doc_id")
    # ids below a share of the hash's range, several times as many as are taken: only these are brought together
    share = min(1.0, 8 * SAMPLE_DOCS / max(1, docs.count()))
    some = docs.where((F.length("text") > 0) & F.col("doc_id").isNotNull() & (order[0] <= F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))))
    ids = some.select("doc_id", F.length("text").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n")).orderBy(*order).limit(SAMPLE_DOCS).collect()
    taken, total = [], 0
    for r in ids:
        if total + r.n <= SAMPLE_CHARS:
            taken, total = [*taken, (r.doc_id,)], total + r.n
    # bounded by SAMPLE_DOCS, so it may be broadcast
    chosen = docs.sparkSession.createDataFrame(taken, some.select("doc_id").schema)
    rows = some.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi").orderBy(*order, "text").collect()
    return train([r.text for r in rows])


def find(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans of every document."""

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
            for doc, (own, every) in zip(b["doc_id"], all_spans(tagger, [t or "" for t in b["text"]])):
                counts = [sum(k == i for _, k, _ in own) for i in range(4)]
                for k, v in zip(out, (doc, *counts, hashlib.sha256(listed(own).encode()).hexdigest(), listed(every))):
                    out[k].append(v)
            yield out

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; n_chars, if there, follows the text."""

    def run(batches):
        for b in batches:
            texts = []
            for text, (_, spans) in zip(b["text"], all_spans(tagger, [t or "" for t in b["text"]])):
                out, at = [], 0
                for s, k, e in spans:
                    if s >= at:
                        out += [text[at:s], f"<{KINDS[k]}>"]
                    at = max(at, e)
                texts.append(text if text is None or not spans else "".join([*out, text[at:]]))
            b["text"] = texts
            if "n_chars" in b:
                b["n_chars"] = [n if t is None else len(t) for n, t in zip(b["n_chars"], texts)]
            yield b

    return map_batches(docs, run, docs.schema.toDDL())


def op6_pii_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, sampled_tagger(docs))

"""Each training-data operator on small awkward tables, against brute force."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.llm import bpe, chat, classifier, neardups, pack, pii, rules, shards, substrings, topk

TEXTS = [None, "", " \n", "a b", "A  b", "one two three four five", "one two three four five six", "x" * 900, "word " * 60, "mail a.b@c.example.org, +1 (555) 555-0100 at 10.0.0.1", "día ñandú 日本 😀 l'été", *["the same text again and again, word for word, " * 8] * 3]


def frame(spark, texts, ids=None):
    """Rows with extra columns whose names clash with those that the operators make up themselves."""
    rows = [(i, t, "en", None if (i or 0) % 5 == 0 else f"s{(i or 0) % 2}", len(t or ""), i, "x", b"y", 0) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block long, cell string, data binary, shard int").repartition(3)


def test_bpe_equals_library(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.VOCABULARY), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = bpe.loaded(P.path(bpe.VOCABULARY), P.PATTERN)
    r = random.Random(1)
    parts = ["a", "th", "  ", " ", "\n", "\t", "é", "日", "😀", "12", "'s", "'ll", "...", " ", "\x1c", "\x85", "ZZ", "_"]
    for _ in range(800):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        assert mine.encode(text) == own.encode_ordinary(text), repr(text)
    got = {x.doc_id: x for x in bpe.digests(frame(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        ids = own.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(frame(spark, TEXTS))).collect()
    assert {x.doc_id: bytes(x.bytes).decode() for x in back} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.digests(frame(spark, TEXTS).limit(0)).count() == 0


def test_chat_sql(spark, tmp_path):
    """The SQL on texts full of control strings, null cells and ties."""
    import duckdb

    r = random.Random(9)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "s>", "é😀", "a", "[", "INST]", "\n"]
    rows = [(r.choice([1, 2, 3, None]), r.choice([0, 1, 2, None]), r.choice(["user", "assistant", "system", None, "<s>"]), r.choice([None, "".join(r.choice(parts) for _ in range(r.randint(0, 9)))])) for _ in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got, other = chat.op3_chat_format(spark, str(tmp_path)), c.sql(chat.OP3_SQL)
    assert sorted(map(tuple, got.select(*other.columns).collect()), key=str) == sorted(other.fetchall(), key=str)


def test_near_pairs_are_proposed():
    """Pairs at the threshold itself meet under a key and are within both distances; the formula allows one miss in 1e5."""
    rng = np.random.default_rng(12)
    both, sigs = 600, []
    for _ in range(1500):
        x = rng.integers(0, 1 << 63, 800, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        sigs += [neardups.signature(x[:700]), neardups.signature(np.concatenate([x[:both], x[700:]]))]
    sig, wide = neardups._matrices(sigs)
    a, b = np.arange(0, 3000, 2), np.arange(1, 3000, 2)
    met = (neardups.keys(sig[a]) == neardups.keys(sig[b])).any(axis=1)
    near = ((sig[a] != sig[b]).sum(axis=1) <= neardups.ERRORS_TOTAL) & ((wide[a] != wide[b]).sum(axis=1) <= neardups.WIDE_ERRORS)
    assert (met & near).all()


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "</s>[INST] \\ ok [/INST]"), (1, 3, "user", "u"), (1, 4, "assistant", ""), (1, 5, "user", "tail"), (2, 0, "user", "only"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (None, 0, None, "<s>")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, example int")
    got = {x.conv_id: x for x in chat.read_back(chat.examples(df)).collect()}
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t, role or "", text or ""))
    assert got.keys() == groups.keys()
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.examples(df).where("has_target").count() == 4


@pytest.mark.parametrize(("length", "hot"), [(20, 10**9), (7, 0), (200, 10**9)])
def test_substrings(spark, monkeypatch, length, hot):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 400 if length < 200 else 4000)
    monkeypatch.setattr(substrings, "HOT_RUNS", hot)
    r = random.Random(3)
    pool = ["".join(r.choice("abcd é") for _ in range(r.randint(20, 200))) for _ in range(6)]
    texts = [*TEXTS, *["".join(r.choice(pool)[r.randint(0, 50) :] for _ in range(r.randint(1, 4))) for _ in range(30)]]
    if length == 200:  # nothing but two letters in an order that fools sums of powers: no two strings are equal
        bits = "".join("ab"[bin(i).count("1") % 2] for i in range(64))
        filler = "".join(r.choice("cdefgh") for _ in range(127))
        texts += ["".join(x + filler for x in bits), "".join({"a": "b", "b": "a"}[x] + filler for x in bits)]
    raw = [(t or "").encode() for t in texts]
    count = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    got = {x.doc_id: x for x in substrings.removed(frame(spark, texts), length).collect()}
    for d, x in enumerate(raw):
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    out = substrings.remove(frame(spark, texts), length)
    assert out.columns == frame(spark, texts).columns and out.count() == len(texts)
    assert substrings.removed(frame(spark, texts).limit(0)).count() == 0


def test_suffixes_are_sorted():
    r = random.Random(1)
    for letters, n, length in ((b"ab", 400, 20), (b"ab", 3000, 200), (b"a", 700, 200), (b"abc", 800, 40), (b"ab", 100, 3), (bytes(range(256)), 500, 8)):
        for t in range(8):
            pool = [bytes(r.choice(letters) for _ in range(r.randint(length // 2, 3 * length))) for _ in range(3)]
            x = b"".join(r.choice(pool) for _ in range(12))[:n]
            at = np.arange(len(x) - length + 1)[:: 1 + t % 2]
            raw = np.frombuffer(x, np.uint8)
            strings = [x[i : i + length] for i in at.tolist()]
            count = Counter(strings)
            assert substrings.suffix_repeats(raw, at, length).tolist() == [count[s] > 1 for s in strings]
            ordered = [strings[i] for i in substrings.suffix_order(raw, at, length)[0].tolist()]
            assert ordered == sorted(strings)


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(neardups, "CELL_ROWS", 16)
    r = random.Random(5)
    base = [f"w{r.randint(0, 9999)}" for _ in range(120)]
    texts = list(TEXTS)
    for _ in range(60):
        x = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 5])):
            x[r.randrange(120)] = f"z{r.randint(0, 10**6)}"
        texts.append(" ".join(x))
    sets = [set(neardups.shingles(t).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardups.near_duplicates(frame(spark, texts)).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}
    assert neardups.near_duplicates(frame(spark, texts).limit(0)).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(pack.tokenizer_path(pack.VOCABULARY))
    texts = [*TEXTS, "long words here " * 3000]
    rows = pack.pack_documents(frame(spark, texts)).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for x in rows:
        by_doc[x.doc_id].append(x)
        by_seq[x.sequence_id].append(x)
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for x in sorted(by_doc[i], key=lambda x: x.start):
            assert (x.start, x.doc_tokens) == (at, len(ids))
            assert x.ids_crc32 == zlib.crc32(np.array(ids[at : at + x.length], dtype="<u4").tobytes())
            at += x.length
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for x in sorted(seq, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 2048


def test_word_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    path = pack.tokenizer_path(pack.VOCABULARY)
    t, words = Tokenizer.from_file(path), pack.Words(path)
    r = random.Random(5)
    letters = "aAbBéÉßσΣςıİ'’`~.,!?#$%&*<|>≠\u0301 \t\n\xa0\u2009\u200d\ufeff\x1c\x00０1９日ª²"
    texts = [None, "", " ", "~ ~ ~~ a~ ^`", " ~ b ~ ", "It's don't WE'LL 'tis it's.", "ΑΣ İI ẞß Straße.", "<|endoftext|> a<|startoftext|>b", "12345abc678 ²³½", "a" * 3000 + "! é"]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(1, 40))) for _ in range(3000)]
    for text, ids in zip(texts, words.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_differencing_is_near_equal():
    r = random.Random(2)
    sizes = [r.randint(1, 256) for _ in range(400)]
    sums, members = pack.differencing(sizes, 25)
    assert sorted(i for m in members for i in m) == list(range(400)) and max(sums) - min(sums) <= 16


def test_shards(spark):
    texts = [f"t{i % 7}" if i % 11 else None for i in range(333)]
    rows = shards.assign(frame(spark, texts)).collect()
    per = Counter(x.shard for x in rows)
    assert max(per.values()) - min(per.values()) <= 1 and len(rows) == 333
    assert all(sorted(x.slot for x in rows if x.shard == s) == list(range(n)) for s, n in per.items())
    total, each = Counter(x.source for x in rows), Counter((x.source, x.shard) for x in rows)
    assert all(abs(each[s, k] - n / 16) <= 2 for s, n in total.items() for k in range(16))
    assert {x.doc_id: x.text_crc32 for x in rows} == {i: zlib.crc32((t or "").encode()) for i, t in enumerate(texts)}
    assert shards.assign(frame(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e18])
def test_topk(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(i, (scale * rng.normal(size=24)).tolist()) for i in range(350)]
    rows[7] = (7, rows[0][1])
    rows += [(400, None), (500, [float("nan")] * 24), (600, [None] * 24), (None, rows[0][1]), (700, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.search(df, F.col("id") % 100 == 0).collect())
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows[:350]}
    want = []
    for q in (0, 100, 200, 300):
        best = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(whole[q], v)))), i) for i, v in whole.items() if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want


def test_pii_patterns_and_gate(spark):
    text = "x a.b@c.example.org, +1 (555) 555-0100 at 10.0.0.1 or 300.1.1.1; 4111 1111 1111 1111, 4111 1111 1111 1112"
    assert pii.listed(pii.base_spans(text)) == "email:2:19,phone:21:38,ip:42:50,card:65:84"
    tagger = pii.train(["some plain text, " * 20 + text] * 4, rounds=6)
    x = np.random.default_rng(0).integers(1, pii.N_CLASSES, (64, 40)).astype(np.uint8)
    fast = tagger.decode(x)
    tagger._stretch = lambda e: np.ones(e.shape[2])
    assert (tagger.decode(x) == fast).all()
    got = {r.doc_id: r for r in pii.find(frame(spark, TEXTS), tagger).collect()}
    assert (got[9].n_email, got[9].n_ip, got[9].n_phone, got[0].spans) == (1, 1, 1, "")
    assert pii.redact(frame(spark, TEXTS), tagger).where("text LIKE '%<email>%'").count() == 1


def test_pii_tagger_finds_held_out_spans(spark):
    r = random.Random(77)
    forms = [pii.generated(r) for _ in range(2000)]
    assert [s for s, tag in forms if tag and not pii.plausible(tag - 1, s)] == []
    assert pii.plausible(0, "name @ host.com") and pii.plausible(3, "555.123.4567") and pii.plausible(3, "030 1234 5678")
    assert not pii.plausible(1, "300.1.1.1") and not pii.plausible(3, "2020-01-02")
    texts = sorted({x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if x.text})
    fit, held = texts[::2], texts[1::2]
    labelled, gold = [], []
    for text in held:
        out, at, spans = "", 0, set()
        for span, tag in (pii.generated(r) for _ in range(6)):
            out, at = f"{out}{text[at : at + 150]} ", at + 150
            if tag:
                spans.add((len(out), tag - 1, len(out) + len(span)))
            out += span + " "
        labelled.append(out)
        gold.append(spans)
    found = pii.all_spans(pii.train(fit), labelled)
    missed, added, wrong = [0, 0], 0, 0
    for spans, (own, every) in zip(gold, found):
        mine = {s for s in spans if not any(s[0] < e and b < s[2] for b, _, e in own)}  # those that the patterns miss
        missed[0] += len(mine)
        missed[1] += len(mine - set(every))
        added += len(set(every) - set(own))
        wrong += len(set(every) - set(own) - spans)
    assert missed[0] > 50 and missed[1] < 0.2 * missed[0]
    # decoys (dates, versions, prices, numbers, hashes) were inserted too, and texts have spans that nobody inserted
    assert wrong <= 0.05 * added


def test_trees_keep_monotonic():
    rng = np.random.default_rng(1)
    x = rng.random((600, len(rules.STATS)))
    y = (x[:, 2] + 0.3 * rng.random(600) < 0.6).astype(float)
    trees = rules.fit(x, y, list(rules.STATS.values()), rounds=15)
    rising = np.repeat(x[:1], 50, axis=0)
    rising[:, 2] = np.linspace(0, 1, 50)
    assert (np.diff(trees.score(rising)) <= 1e-12).all()
    assert ((trees.score(x) > 0.5) == (y > 0.5)).mean() > 0.85


def crowd(spark):
    """Rows that share an id, or have none, beside others: copies and different texts, in more rows than any group may hold."""
    r = random.Random(8)
    own = [" ".join(f"w{r.randint(0, 99999)}" for _ in range(40)) for _ in range(40)]
    ids = [*range(100, 140), *[7] * 120, *[None] * 60]
    return own + [own[0]] * 60 + [f"{own[1]} {i}" for i in range(60)] + [own[2]] * 30 + [None] * 30, ids


@pytest.fixture
def quick_tagger(monkeypatch):
    """Taggers of a few rounds, where a test is not about what they find."""
    train = pii.train
    monkeypatch.setattr(pii, "train", lambda texts: train(texts, rounds=4))


def test_crowded_ids(spark, quick_tagger):
    """Ids that many rows share, and rows without one, are rows like any others in every operator."""
    texts, ids = crowd(spark)
    docs = frame(spark, texts, ids)
    n = len(texts)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100, 140)] + [(7, 0, 0), (7, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert classifier.score(docs, classifier.train(docs, labels, 30)).count() == n
    trees = rules.train(docs, labels, 30)
    assert trees is not None and rules.judge(docs, trees).count() == n
    assert rules.train(docs, labels, 30).value.tolist() == trees.value.tolist()
    assert bpe.digests(docs).count() == n
    assert substrings.removed(docs).where("n_removed > 0").count() >= 150
    assert pii.find(docs, pii.sampled_tagger(docs)).count() == n
    packed = pack.pack_documents(docs).collect()
    assert sum(x.start == 0 for x in packed) == n
    fill = Counter()
    for x in packed:
        fill[x.sequence_id] += x.length
    assert max(fill.values()) <= 2048 and sum(fill.values()) > 2048 * (len(fill) - 3)
    per = Counter(x.shard for x in shards.assign(docs).collect())
    assert sum(per.values()) == n and max(per.values()) - min(per.values()) <= 1
    got = {(x.doc_id, x.component_id) for x in neardups.near_duplicates(docs).collect()}
    assert (7, 7) in got and (None, None) in got
    turns = docs.selectExpr("doc_id AS conv_id", "cast(shard as long) AS turn", "'user' AS role", "text")
    assert {x.conv_id: x.n_turns for x in chat.read_back(chat.examples(turns)).collect()} == dict(Counter(ids))
    vectors = spark.createDataFrame([(i, [float(k % 5), 1.0]) for k, i in enumerate([100, 100, 3, 3, 4, None])], "vec_id long, embedding array<double>")
    found = sorted((x.query_id, x.rank, x.vec_id) for x in topk.search(vectors, F.col("id") % 100 == 0, k=2).collect())
    assert [x[1] for x in found] == [1, 1, 2, 2] and {x[0] for x in found} == {100} and all(x[2] in (3, 4) for x in found)


def test_empty_tables(spark, quick_tagger):
    docs = frame(spark, TEXTS).limit(0)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert classifier.score(docs, classifier.train(docs, none)).count() == 0
    assert rules.judge(docs, rules.train(docs, none)).count() == 0
    assert pii.find(docs, pii.sampled_tagger(docs)).count() == 0
    assert pack.pack_documents(docs).count() == 0
    assert chat.read_back(chat.examples(docs.selectExpr("doc_id AS conv_id", "n_chars AS turn", "lang AS role", "text"))).count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, row int, dim int")
    assert topk.search(empty, F.col("id") % 100 == 0).count() == 0


def test_clashing_vector_names(spark):
    rows = [(i, [float(i), 1.0], i, "x", "y", 3) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row int, cb string, qb string, dim int")
    assert [x.vec_id for x in topk.search(df, F.col("id") == 0, k=3).orderBy("rank").collect()] == [1, 2, 3]


def plain_spans(text):
    """The patterns as they are stated, with no shortcut."""
    import re

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else (2 * x if 2 * x < 10 else 2 * x - 9) for i, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_patterns_against_plain_ones(spark):
    r = random.Random(21)
    parts = ["a.b", "@", "x-1.org", "..", " ", "-", "+", "(", ")", "1", "42", "255.", "256.0", "4111 1111 1111 1111", "10.0.0.1", "+1 (555) 555-0100", "é", "日", "%", "_", "\n", "0000", "٣"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 25)))
        assert pii.base_spans(text) == plain_spans(text), repr(text)
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert pii.base_spans(row.text or "") == plain_spans(row.text or "")


def test_rule_figures_against_plain_ones(spark):
    r = random.Random(22)
    texts = [t or "" for t in TEXTS] + [r.choice([" ", "\n"]).join(r.choice(["a", "b", "c#", "*", "dd"]) for _ in range(r.randint(0, 80))) for _ in range(150)]
    texts += [x.text or "" for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if len(x.text or "") < 4000]
    got = {x.doc_id: x for x in rules.judge(frame(spark, texts), None).collect()}
    for i, text in enumerate(texts):
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        covered = {k + d for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for d in range(8)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if line.strip(" \t\n\v\f\r"):
                dup += line in seen
                seen.add(line)
        x = got[i]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want, repr(text)
        assert x.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words)) and x.kept == (not x.base_failed)


def test_classifier_fold(spark):
    docs = frame(spark, ["t"] * 200)
    got = {x.doc_id: x.h for x in docs.select("doc_id", classifier.held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(3)
    x = rng.random((300, len(rules.STATS)))
    trees = rules.fit(x, (x[:, 0] + x[:, 5] > 1).astype(float), list(rules.STATS.values()), rounds=8)

    def walk(row, at):
        while trees.left[at] != at:
            at = trees.left[at] if row[trees.column[at]] <= trees.threshold[at] else trees.right[at]
        return trees.value[at]

    for row, score in zip(x, trees.score(x)):
        assert score == pytest.approx(1 / (1 + np.exp(-(trees.start + sum(walk(row, r) for r in trees.roots)))))


def test_classifier_follows_the_non_negative_risk():
    """On two clouds whose share of positives is known, the fit from positives and unlabelled rows finds the border."""
    rng = np.random.default_rng(6)
    pos, neg = rng.normal(1.5, 1, (900, 4)), rng.normal(-1.5, 1, (900, 4))
    unl = np.concatenate([pos[300:600], neg[:600]])
    prior = classifier.estimate_prior(pos[:300], unl)
    assert 0.2 < prior < 0.5  # a third
    net = classifier.fit(pos[:300], unl, prior, epochs=20)
    assert (net.score(pos[600:]) > 0.5).mean() > 0.9 and (net.score(neg[600:]) < 0.5).mean() > 0.9


def test_shards_on_two_levels(spark, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET_ROWS", 4)
    monkeypatch.setattr(shards, "RUN_BUCKETS", 3)
    texts = [f"t{i}é" * (i % 5) for i in range(500)]
    rows = shards.assign(frame(spark, texts)).collect()
    per, each = Counter(x.shard for x in rows), Counter((x.source, x.shard) for x in rows)
    assert max(per.values()) - min(per.values()) <= 1
    assert all(sorted(x.slot for x in rows if x.shard == s) == list(range(n)) for s, n in per.items())
    total = Counter(x.source for x in rows)
    assert all(abs(each[s, k] - n / 16) <= 2 for s, n in total.items() for k in range(16))
    assert {x.doc_id: x.size for x in rows} == {i: len(t.encode()) + 1 for i, t in enumerate(texts)}


def test_rules_and_classifier_edges(spark):
    docs = frame(spark, TEXTS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in rules.judge(docs, rules.train(docs, none)).collect()}
    assert got[0].base_failed and got[0].n_words == 0 and got[8].n_repeat_words == 60 and not got[8].kept
    assert all(r.score == 0.5 for r in classifier.score(docs, classifier.train(docs, none)).collect())
    assert rules.judge(docs.limit(0), None).count() == 0


def test_classifier_on_held_out(spark):
    net = classifier.op1_quality_pu(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = net.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)


def test_topk_sql_and_near_dup_sql(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for query, sql in ((chat.op3_chat_format, chat.OP3_SQL), (topk.op10_topk_exact, topk.OP10_SQL), (neardups.op4_near_dedup, neardups.OP4_SQL)):
        df = query(spark, "/root/testdata/sf0.001")
        other = c.sql(sql)
        assert sorted(map(tuple, df.select(*other.columns).collect()), key=str) == sorted(other.fetchall(), key=str)

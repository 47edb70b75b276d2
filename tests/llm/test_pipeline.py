import random
import re
import zlib

import corpus_pipeline


def test_stages(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, data), name)
        assert docs.columns == columns, name
        assert docs.count() <= n
        n = docs.count()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_repeated_rows_and_ids(spark):
    r = random.Random(3)
    a, b, c, d = (" ".join(f"w{r.randint(0, 9999)}" for _ in range(80)) for _ in range(4))
    # a is loaded twice, b and c share an id, b's near copy shares d's
    rows = [(7, a), (7, a), (8, b), (8, c), (9, d), (9, b + " more"), (10, a)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(tuple(x) for x in kept.collect()) == sorted([(7, a), (8, b), (8, c), (9, d)])
    left = corpus_pipeline.repeated_passages(spark, kept, "")
    assert {x.text for x in left.collect()} == {a, b, c, d}


def test_rows_without_an_id(spark):
    r = random.Random(4)
    a, b, c = (" ".join(f"w{r.randint(0, 9999)}" for _ in range(80)) for _ in range(3))
    # a is clean, b comes twice, c is a near copy of a document with an id
    rows = [(None, a), (None, b), (None, b), (None, c + " more"), (5, c)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == sorted([(None, a), (None, b), (5, c)], key=str)


def test_awkward_table(spark, tmp_path):
    """Nulls, repeated rows, an empty and a long text, and columns with names of the stages' own, from end to end; what the
    stages must do to these texts is worked out by hand and by brute force."""
    from tokenizers import Tokenizer

    from rillflow.llm import pack

    r = random.Random(5)
    own = lambda n: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(n))
    clean, twice, shared, long = own(60), own(60), own(40), own(30_000)
    mail = own(30) + " name.of@mail.example.org " + own(30)
    rows = [(1, clean), (2, twice), (3, twice), (3, twice), (None, own(50)), (4, None), (5, ""), (6, "a few words only"), (7, mail), (8, own(50) + " " + shared + " " + own(50)), (9, own(50) + " " + shared + " " + own(50)), (10, long), (11, "the same eight words once more and again " * 20)]
    docs = spark.createDataFrame([(i, t, k, "x", b"y") for k, (i, t) in enumerate(rows)], "doc_id long, text string, block long, _row string, data binary")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    columns, now = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.written(stage(spark, now, str(tmp_path)), name)
        assert now.columns == columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    got = {x.doc_id: x.text for x in now.collect()}
    assert got.keys() == {1, 2, None, 7, 8, 9, 10}
    assert (got[1], got[2], got[10], got[None]) == (clean, twice, long, rows[4][1])
    assert got[7] == mail.replace("name.of@mail.example.org", "<email>")
    for text, other, i in ((rows[9][1], rows[10][1], 8), (rows[10][1], rows[9][1], 9)):
        again = {other[k : k + 200] for k in range(len(other) - 199)}
        gone = {k + d for k in range(len(text) - 199) if text[k : k + 200] in again for d in range(200)}
        assert len(gone) >= len(shared) and got[i] == "".join(c for k, c in enumerate(text) if k not in gone)
    t = Tokenizer.from_file(pack.tokenizer_path(pack.VOCABULARY))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for i, text in got.items():
        ids = b"".join(bytes(x.ids) for x in sorted((x for x in packed if x.doc_id == i), key=lambda x: x.start))
        want = b"".join(k.to_bytes(4, "little") for k in [*t.encode(text, add_special_tokens=False).ids, 1])
        assert ids == want
    assert all(zlib.crc32(bytes(x.ids)) == x.ids_crc32 for x in packed)
    assert not any(re.search("@", x) for x in got.values())

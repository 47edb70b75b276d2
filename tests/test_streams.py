import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.functions import design, scalar
from rillflow.operators import arrays, feedback, mapreduce, sorting, streams
from rillflow.plans.graph import Program, adjacency, neighbours, resolve
from rillflow.sources import drain, lcg_sequence, lines
from rillflow.streaming import streaming_fir


def stream(spark, xs):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "seq long, x double")


def test_impulse_gives_coefficients(spark):
    taps = design.band_lowpass(1, taps=8)
    got = streams.fir(stream(spark, [0.0] * 7 + [1.0] + [0.0] * 7), taps).orderBy("seq").collect()
    assert [r.x for r in got] == pytest.approx(taps[::-1])


@pytest.mark.parametrize(("n", "outputs"), [(3, 0), (4, 1), (5, 2), (100, 97)])
def test_tail_is_drained(spark, n, outputs):
    assert streams.fir(stream(spark, range(n)), [1.0] * 4, block=8).count() == outputs


def test_halo_over_block_borders(spark):
    x = np.random.default_rng(0).normal(size=500)
    taps = [0.5, -1.0, 2.0, 0.25, 3.0]
    for step in (1, 3, 5):
        got = streams.fir(stream(spark, x), taps, step, block=16).orderBy("seq").collect()
        assert [r.x for r in got] == pytest.approx(np.convolve(x, taps[::-1], "valid")[::step].tolist())


def test_transform_and_back(spark):
    x = np.random.default_rng(1).normal(size=64)
    df = spark.createDataFrame([(x.tolist(),)], "xs array<double>")
    re, im = arrays.dft(F.col("xs"), arrays.expand(F.array().cast("array<double>"), 64), 64)
    both = df.select(re.alias("re"), im.alias("im"))
    row = both.head()
    assert np.array(row.re) + 1j * np.array(row.im) == pytest.approx(np.fft.fft(x))
    back = both.select(arrays.dft(F.col("re"), F.col("im"), 64, True)[0].alias("x")).head()
    assert back.x == pytest.approx(x.tolist())


def test_transforms_of_any_length(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=n).tolist() if n else None) for i, n in enumerate([12, 12, 0, 24])]
    df = spark.createDataFrame(rows, "i int, xs array<double>")
    re, im = arrays.dft(F.col("xs"), F.transform("xs", lambda x: x * 0), 12)
    for x, (i, xs) in zip(df.select("i", re.alias("re"), im.alias("im")).orderBy("i").collect(), rows):
        if xs is None:
            assert x.re is None
        else:
            want = np.concatenate([np.fft.fft(xs[k : k + 12]) for k in range(0, len(xs), 12)])
            assert np.array(x.re) + 1j * np.array(x.im) == pytest.approx(want)


def test_stages_make_the_transform():
    x = np.random.default_rng(7).normal(size=(3, 16)) + 0j
    out = x[:, arrays.bit_order(16)]
    for size in (2, 4, 8, 16):
        out = arrays.butterflies(out, size)
    assert out == pytest.approx(np.fft.fft(x))


def test_matrix_moves(spark):
    m = np.arange(12.0).reshape(4, 3)
    df = spark.createDataFrame([(m.ravel().tolist(),)], "xs array<double>")
    got = df.select(arrays.transposed(F.col("xs"), 4, 3).alias("t"), arrays.transposed(F.col("xs"), 4, 3, literal=True).alias("same"), arrays.expand_rows(F.col("xs"), 3, 4, 6).alias("wide"), arrays.contract_rows(F.col("xs"), 4, 3, 2).alias("cut")).head()
    assert got.t == m.T.ravel().tolist() and got.same == m.ravel().tolist()
    assert got.wide == np.pad(m.T, ((0, 0), (0, 2))).ravel().tolist()
    assert got.cut == m[:, :2].T.ravel().tolist()


def test_own_kernel(spark):
    x = np.random.default_rng(3).normal(size=200)
    top = streams.kernel(stream(spark, x), lambda xs, _: np.array([xs[i : i + 7].max() for i in range(0, len(xs) - 6, 2)]), peek=7, pop=2, block=16)
    assert [r.x for r in top.orderBy("seq").collect()] == [x[i : i + 7].max() for i in range(0, 194, 2)]


def test_lanes_and_gaps(spark):
    x = np.arange(40.0)
    two = streams.fir(stream(spark, x), {0: [1.0, 0.0], 1: [0.0, 1.0]}, lane="lane", block=8)
    got = streams.zip_lanes(two, [1.0, -1.0]).orderBy("seq").collect()
    assert [(r.seq, r.x) for r in got] == [(i, -1.0) for i in range(39)]
    # a stream that lacks positions: only positions that all streams have are added
    some = streams.zip_add([stream(spark, x), stream(spark, x).where("seq % 3 <> 1")]).collect()
    assert {r.seq: r.x for r in some} == {i: 2.0 * i for i in range(40) if i % 3 != 1}


def test_sizes_of_many_runs(spark):
    sizes = [(i, (i * 7) % 5) for i in range(60)]
    got = streams.sized_blocks(stream(spark, range(100)), spark.createDataFrame(sizes, "seq long, n int"), width=4).collect()
    want, at = {}, 0
    for block, n in sizes:
        want |= {p: block for p in range(at, min(100, at + n))}
        at += n
    assert {r.seq: r.block for r in got} == want


def test_ranks_with_a_hot_value(spark):
    rows = [(5, i) for i in range(300)] + [(i % 9, 1000 + i) for i in range(60)] + [(None, -1)]
    df = spark.createDataFrame(rows, "k int, i int").repartition(5)
    got = sorted((r["rank"], r.k, r.i) for r in sorting.ranked(df, ["k", "i"]).collect())
    assert [(k, i) for _, k, i in got] == sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1])) and [g[0] for g in got] == list(range(361))
    left, right = (spark.createDataFrame([(v,) for v in x], "k int") for x in ([1, 1, 4, 9], [1, 4, 4]))
    merged = streams.merge_sorted(left, right, ["k"]).orderBy("rank").collect()
    assert [(r.k, r.side) for r in merged] == [(1, 0), (1, 0), (1, 1), (4, 0), (4, 1), (4, 1), (9, 0)]


def test_map_reduce_with_own_functions(spark):
    docs = spark.createDataFrame([("a b;b c",), ("c;;a a",), (None,)], "text string")
    words = F.filter(F.split("text", " "), lambda w: w != "")
    pairs = F.transform(words, lambda w: F.struct(w.alias("key"), F.lit(1).cast("long").alias("value")))
    split = ("text", F.split("text", ";"))
    counted = mapreduce.MapReduce(pairs, split=split, fold=lambda a, b: a + b).run(docs)
    assert {r.key: r.value for r in counted.collect()} == {"a": 3, "b": 2, "c": 2}
    # the longest first: an order of one's own
    ordered = mapreduce.MapReduce(pairs, split=split).run(docs, in_key_order=lambda k: F.ascii(k).desc())
    assert [r.key for r in ordered.collect()] == ["c", "b", "a"]
    assert mapreduce.MapReduce(pairs, combiner=None, split=split, reducer=lambda k, v: v * 10).run(docs).where("value = 10").count() == 7


def test_fold_beyond_the_held_keys(spark, monkeypatch):
    monkeypatch.setattr(mapreduce, "FOLD_KEYS", 3)
    df = spark.range(500).select((F.col("id") % 37).alias("key"), F.col("id").alias("value"))
    assert {r.key: r.value for r in mapreduce.folded(df, max).collect()} == {k: max(i for i in range(500) if i % 37 == k) for k in range(37)}


def test_integer_generator(spark):
    x, want = 0, []
    for _ in range(300):
        x = (1103515245 * x + 12345) & 0xFFFFFFFF
        want.append(x - (1 << 32) if x >= 1 << 31 else x)
    assert [r.x for r in lcg_sequence(spark, 300).orderBy("seq").collect()] == want


def test_random_draws_are_even(spark):
    rows = spark.range(200_000).select(scalar.uniform(3, 10, 20).alias("u"), scalar.uniform_int(4, 0, 9).alias("i"), scalar.coin(5).alias("c"))
    deciles = {int(r.d): r.n for r in rows.groupBy(F.floor("u").alias("d")).agg(F.count("*").alias("n")).collect()}
    assert deciles.keys() == set(range(10, 20)) and all(abs(n - 20_000) < 2_000 for n in deciles.values())
    whole = {r.i: r["count"] for r in rows.groupBy("i").count().collect()}
    assert whole.keys() == set(range(10)) and all(abs(n - 20_000) < 2_000 for n in whole.values())
    assert abs(rows.where("c").count() - 100_000) < 2_000


def test_vector_lanes(spark):
    a, b = F.array(*[F.lit(float(v)) for v in (1, 2, 3, 4)]), F.array(*[F.lit(float(v)) for v in (5, 6, 7, 8)])
    row = spark.range(1).select(scalar.vector("+", a, b).alias("s"), scalar.vector("*", F.array(F.lit(0.51)), scalar.splat(F.lit(0.0), 1)).alias("z")).head()
    assert row.s == [6, 8, 10, 12] and row.z == [0]


def test_gaussian_orders():
    x = np.zeros((1, 201))
    x[0, 100] = 1.0
    for order in (0, 1, 2):
        g = design.gaussian_iir(6.0, order)
        y = (arrays.forward(x, g["a0"], g["a1"], g["b1"], g["b2"]) + arrays.backward(x, g["a2"], g["a3"], g["b1"], g["b2"]))[0]
        # the first derivative is odd about the place between two samples: its backward pass begins one sample ahead
        left, right = (y[99::-1], y[100:200]) if order == 1 else (y[99::-1], y[101:])
        assert left == pytest.approx((-1) ** order * right, abs=1e-9)
        assert abs(y.sum() - (order == 0)) < 0.05 and (order or y.argmax() == 100)


def test_feedback_until_nothing_is_left(spark):
    out = feedback.levels(spark.createDataFrame([(40,), (7,)], "k long"), lambda d: d.where("k > 1").select(F.floor(F.col("k") / 2).alias("k")), cut_every=2)
    assert sorted((r.level, r.k) for r in out.collect()) == [(0, 7), (0, 40), (1, 3), (1, 20), (2, 1), (2, 10), (3, 5), (4, 2), (5, 1)]
    two = feedback.levels(spark.createDataFrame([(40,)], "k long"), lambda d: d.select(F.floor(F.col("k") / 2).alias("k")), rounds=2)
    assert sorted(r.k for r in two.collect()) == [10, 20, 40]


def test_lines_and_counting_sink(spark, tmp_path):
    (tmp_path / "x").write_text("a b\n# c\n\nd")
    df = lines(spark, str(tmp_path / "x"))
    assert [r.value for r in df.collect()] == ["a b", "# c", "", "d"]
    drain(df)


def test_adjacency_both_ways(spark):
    p = Program()
    for k in "12345":
        p.kernel(k, start=k == "1")
    for i, (a, b, back) in enumerate([("1", "2", False), ("2", "3", False), ("2", "4", False), ("3", "5", False), ("4", "5", False), ("4", "1", True), ("3", "4", False), ("4", "3", False)]):
        p.queue(f"q{i}", a, b, back)
    assert p.start_list() == ["1"]
    got = {r.kernel: (r.successors, r.predecessors) for r in adjacency(p.edges(spark)).collect()}
    assert got == {"1": (["2"], ["4"]), "2": (["3", "4"], ["1"]), "3": (["4", "5"], ["2", "4"]), "4": (["1", "3", "5"], ["2", "3"]), "5": ([], ["3", "4"])}
    ahead = {r.kernel: r.predecessors for r in adjacency(p.edges(spark), feedback=False).collect()}
    assert ahead["1"] == [] and ahead["4"] == ["2", "3"]


def test_empty_stream(spark):
    assert streams.fir(stream(spark, [1]).limit(0), [1.0]).count() == 0
    assert streams.zip_add([stream(spark, [1]).limit(0)] * 2).count() == 0


def test_program_graph(spark):
    p = Program().kernel("1", start=True)
    for k in "2345":
        p.kernel(k, parallel=True)
    for i, (a, b, back) in enumerate([("1", "2", False), ("2", "3", False), ("2", "4", False), ("3", "5", False), ("4", "5", False), ("4", "1", True)]):
        p.queue(f"q{i}", a, b, back)
    p.verify()
    assert 'shape=box3d' in p.dot() and p.dot().count("->") == 6
    got = {r.kernel: r.successors for r in neighbours(p.edges(spark), feedback=False).collect()}
    assert got == {"1": ["2"], "2": ["3", "4"], "3": ["5"], "4": ["5"]}
    with pytest.raises(ValueError, match="unknown"):
        p.queue("x", "1", "nowhere").verify()


def test_resolve():
    assert resolve("math:sqrt")(9) == 3
    with pytest.raises(FileNotFoundError):
        resolve("no_such_module:f")
    with pytest.raises(AttributeError):
        resolve("math:no_such_name")


def test_streaming_equals_batch(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=40)
    for b in range(4):
        spark.createDataFrame([("a", i, float(x[i])) for i in range(10 * b, 10 * b + 10)], "k string, seq long, x double").coalesce(1).write.parquet(str(tmp_path / "in" / f"{b}"))
    source = spark.readStream.schema("k string, seq long, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    taps = [1.0, 2.0, -1.0]
    q = streaming_fir(source, "k", taps).writeStream.format("memory").queryName("fir_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("fir_out").orderBy("seq").collect()
    assert [r.y for r in got] == pytest.approx(np.convolve(x, taps[::-1], "valid").tolist())

"""Registered queries of the stream operators, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import design, scalar
from ..functions.scalar import LOWER, UPPER
from ..operators import arrays, feedback, grid, logs, mapreduce, sorting, streams
from ..sources import grid as grid_of
from ..sources import images, lcg_sequence, signal, vectors
from .graph import Program, adjacency

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Taps of the registered filter queries, and decimals that results are rounded to (GAIN_DIGITS behind the demodulator, whose
#: gain is above 1e8).
TAPS, DIGITS, GAIN_DIGITS = 128, 6, 1
#: Zeros behind the signal, so that the windows at its end are complete.
RADIO_PAD, BANK_PAD = 1280, 383


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add



def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c, digits: int = DIGITS):
    """Rounded, with no negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def num(v: float) -> str:
    return f"{v:.17e}"


def dot_sql(taps: list[float], x: str, window: str) -> str:
    """The same sum of products, in the same order."""
    terms = " + ".join(f"{num(c)} * {f'lead({x}, {i}) OVER {window}' if i else x}" for i, c in enumerate(taps))
    return f"0.0::DOUBLE + {terms}"


def fir_sql(source: str, taps: list[float], step: int = 1, x: str = "x") -> str:
    """(seq, x) of a filter over (seq, x) rows."""
    inner = f"SELECT seq, {dot_sql(taps, x, 'w')} AS y FROM {source} WINDOW w AS (ORDER BY seq)"
    return f"SELECT (seq // {step})::BIGINT AS seq, y AS x FROM ({inner}) WHERE y IS NOT NULL AND seq % {step} = 0"


SIGNAL_SQL = "SELECT event_id AS seq, value AS x FROM events"
WORDS_SQL = f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(text, '{LOWER}', '{UPPER}'), '[A-Z][A-Z'']*')) AS word FROM documents) GROUP BY 1"


# Text and map-reduce


@query("wordcount", WORDS_SQL)
def wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = mapreduce.MapReduce(mapreduce.word_count_mapper(scalar.words(F.col("text"))))
    return job.run(read(spark, sf_dir, "documents")).select(F.col("key").alias("word"), F.col("value").alias("n"))


@query("mapreduce_sum", "SELECT l_returnflag || l_linestatus AS key, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT * 2 AS value FROM lineitem GROUP BY 1")
def mapreduce_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.struct(F.concat("l_returnflag", "l_linestatus").alias("key"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("value"))
    return mapreduce.MapReduce(F.array(pair), reducer=lambda k, v: v * 2).run(read(spark, sf_dir, "lineitem"))


@query("text_with_space", "SELECT page_id, regexp_matches(html, '[ \\t\\r\\n]') AS spaced FROM pages")
def text_with_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", scalar.has_space(F.col("html")).alias("spaced"))


# Element-wise


@query("scale_const", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 0.00390625::DOUBLE, 12) AS y FROM lineitem")
def scale_const(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(scalar.scale(F.col("l_extendedprice")), 12).alias("y"))


@query("extract_exp", "SELECT l_orderkey, l_linenumber, l_partkey, round(exp(l_discount), 6) AS y FROM lineitem")
def extract_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.exp("l_discount"), 6).alias("y"))


@query("compress_log", "SELECT o_orderkey, round(ln(o_totalprice), 6) AS y FROM orders")
def compress_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(F.log("o_totalprice"), 6).alias("y"))


@query("saturate", "SELECT c_custkey, least(greatest(c_acctbal / 5000.0::DOUBLE, 0.0), 1.0)::DOUBLE AS y FROM customer")
def saturate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", scalar.saturate(F.col("c_acctbal") / 5000.0).alias("y"))


@query("rgba_pack", "SELECT l_orderkey, l_linenumber, l_partkey, least(floor(l_quantity)::BIGINT, 255) + least(floor(l_discount * 100)::BIGINT, 255) * 256 + least(floor(l_tax * 100)::BIGINT, 255) * 65536 + least(floor(l_extendedprice)::BIGINT, 255) * 16777216 AS packed FROM lineitem")
def rgba_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = scalar.pack_rgba(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_extendedprice"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", packed.alias("packed"))


@query("rgba_unpack", "SELECT o_orderkey, (o_orderkey & 255)::DOUBLE AS r, ((o_orderkey >> 8) & 255)::DOUBLE AS g, ((o_orderkey >> 16) & 255)::DOUBLE AS b, ((o_orderkey >> 24) & 255)::DOUBLE AS a FROM orders")
def rgba_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for c, n in zip(scalar.unpack_rgba(F.col("o_orderkey")), "rgba")])


@query("median3", "SELECT l_orderkey, l_linenumber, l_partkey, list_sort([l_quantity, l_discount * 100, l_tax * 100])[2] AS y FROM lineitem")
def median3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scalar.median3(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100).alias("y"))


@query("vector_arithmetic", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * l_discount + 1.0, 6) AS a, round(l_tax * l_tax + 2.0, 6) AS b FROM lineitem")
def vector_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    product = scalar.vector("*", F.array("l_quantity", "l_tax"), F.array("l_discount", "l_tax"))
    total = scalar.vector("+", product, F.array(F.lit(1.0), F.lit(2.0)))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(total[0], 6).alias("a"), F.round(total[1], 6).alias("b"))


@query("lcg_step", "SELECT o_orderkey, (((((1103515245::HUGEINT * o_orderkey + 12345) % 4294967296) + 2147483648) % 4294967296) - 2147483648)::BIGINT AS y FROM orders")
def lcg_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", scalar.wrap32(F.col("o_orderkey") * 1103515245 + 12345).alias("y"))


@query("vector_lanes", "SELECT l_orderkey, l_linenumber, l_partkey, k, round(((l_quantity + k - l_tax * k) / (k + 2.0)) * 2.5, 6) + 0.0 AS y FROM lineitem, range(8) t(k)")
def vector_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight lanes: plus, minus, divided, and times a splat."""
    k = F.array(*[F.lit(float(i)) for i in range(8)])
    total = scalar.vector("+", scalar.splat(F.col("l_quantity"), 8), k)
    rest = scalar.vector("-", total, scalar.vector("*", scalar.splat(F.col("l_tax"), 8), k))
    y = scalar.vector("*", scalar.vector("/", rest, scalar.vector("+", k, scalar.splat(F.lit(2.0), 8))), scalar.splat(F.lit(2.5), 8))
    out = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.posexplode(y).alias("k", "v"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.col("k").cast("long").alias("k"), rounded(F.col("v")).alias("y"))


@query("lcg_sequence", "WITH RECURSIVE r AS (SELECT 0::BIGINT AS seq, 12345::BIGINT AS x UNION ALL SELECT seq + 1, (1103515245 * x + 12345) & 4294967295 FROM r WHERE seq < (SELECT count(*) FROM part) - 1) SELECT seq, CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END AS x FROM r")
def lcg_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many values of the integer generator as there are parts."""
    return lcg_sequence(spark, read(spark, sf_dir, "part").count())


@query("table_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, [1, 2, 3, 4, 5, 6][(l_linenumber % 2) * 3 + l_suppkey % 3 + 1]::DOUBLE AS xy, CASE WHEN l_linenumber < 3 THEN [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12][l_linenumber * 4 + (l_suppkey % 2) * 2 + l_partkey % 2 + 1] END::DOUBLE AS xyz FROM lineitem")
def table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constants of 2 x 3, and of 3 x 2 x 2, where lines beyond the table have none."""
    xy = scalar.table_lookup([float(i) for i in range(1, 7)], [2, 3], [F.col("l_linenumber") % 2, F.col("l_suppkey") % 3])
    xyz = scalar.table_lookup([float(i) for i in range(1, 13)], [3, 2, 2], [F.col("l_linenumber"), F.col("l_suppkey") % 2, F.col("l_partkey") % 2])
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", xy.alias("xy"), xyz.alias("xyz"))


# Position windows


GAIN = design.demodulator_gain()


@query("fm_demod", f"SELECT event_id AS seq, round({num(GAIN)} * atan(value * lead(value) OVER (ORDER BY event_id)), {GAIN_DIGITS}) + 0.0 AS x FROM events QUALIFY lead(value) OVER (ORDER BY event_id) IS NOT NULL")
def fm_demod(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.pairs(signal(spark, sf_dir), lambda a, b: scalar.demodulate(a, b, GAIN))
    return out.select("seq", rounded(F.col("x"), GAIN_DIGITS).alias("x"))


def _filter(name: str, taps: list[float], step: int = 1) -> None:
    @query(name, f"SELECT seq, round(x, 6) + 0.0 AS x FROM ({fir_sql(f'({SIGNAL_SQL})', taps, step)})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return streams.fir(signal(spark, sf_dir), taps, step).select("seq", rounded(F.col("x")).alias("x"))


_filter("fir_lowpass", design.band_lowpass(2, taps=TAPS))
_filter("fir_highpass", design.band_highpass(2, taps=TAPS))
_filter("fir_decimate", design.receiver_lowpass(250e6, 108e6, TAPS), 5)


@query("peek_pop", "SELECT (event_id // 3)::BIGINT AS seq, round(0.0::DOUBLE + value + lead(value, 1) OVER w + lead(value, 2) OVER w + lead(value, 3) OVER w + lead(value, 4) OVER w, 6) + 0.0 AS x FROM events WINDOW w AS (ORDER BY event_id) QUALIFY event_id % 3 = 0 AND lead(value, 4) OVER w IS NOT NULL")
def peek_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.fir(signal(spark, sf_dir), [1.0] * 5, 3).select("seq", rounded(F.col("x")).alias("x"))


@query("pop_blocks", "SELECT event_id // 64 AS block, count(*) AS n, max(value) AS top FROM events GROUP BY 1 HAVING count(*) = 64")
def pop_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.blocks_of(signal(spark, sf_dir), 64).select("block", F.size("xs").cast("long").alias("n"), F.array_max("xs").alias("top"))


@query("short_last_block", "SELECT event_id // 64 AS block, count(*) AS n, max(value) AS top FROM events GROUP BY 1")
def short_last_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.blocks_of(signal(spark, sf_dir), 64, short_last=True).select("block", F.size("xs").cast("long").alias("n"), F.array_max("xs").alias("top"))


@query("sized_blocks", "WITH s AS (SELECT o_orderkey AS block, o_orderkey % 4 + 1 AS n, sum(o_orderkey % 4 + 1) OVER (ORDER BY o_orderkey) AS e FROM orders) SELECT block, count(*) AS n, max(value) AS top FROM s JOIN events ON event_id >= e - n AND event_id < e GROUP BY 1")
def sized_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event falls into a block: the sizes, one for each order, add up to more than the events there are."""
    sizes = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 4 + 1).alias("n"))
    return streams.sized_blocks(signal(spark, sf_dir), sizes).groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("top"))


@query("downsample", "SELECT event_id // 8 AS seq, value AS x FROM events WHERE event_id % 8 = 0")
def downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.decimate(signal(spark, sf_dir), 8)


@query("upsample", "SELECT event_id * 8 + k AS seq, CASE WHEN k = 0 THEN value ELSE 0.0 END AS x FROM events, range(8) t(k)")
def upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.upsample(signal(spark, sf_dir), 8)


@query("zero_padded", "SELECT event_id AS seq, value AS x FROM events UNION ALL SELECT (SELECT count(*) FROM events) + k, 0.0 FROM range(383) t(k)")
def zero_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.zero_padded(signal(spark, sf_dir), 383)


# Several streams


@query("dup_zip_add16", "SELECT event_id AS seq, (round(value * 100)::BIGINT * 136)::DOUBLE AS x FROM events")
def dup_zip_add16(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = signal(spark, sf_dir).select("seq", F.round(F.col("x") * 100).alias("x"))
    return streams.zip_lanes(streams.lanes(whole, 16), [float(i + 1) for i in range(16)])


def _equaliser(literal: bool = False) -> list[float]:
    return streams.equaliser_weights(design.equaliser_gains(), literal)


def _equalizer_sql(literal: bool) -> str:
    return f"SELECT event_id AS seq, round(0.0::DOUBLE + {' + '.join(f'(value + {i}.0) * {num(w)}' for i, w in enumerate(_equaliser(literal)))}, 6) + 0.0 AS x FROM events"


def _equalizer(name: str, literal: bool) -> None:
    @query(name, _equalizer_sql(literal))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shifted = streams.lanes(signal(spark, sf_dir), 12).withColumn("x", F.col("x") + F.col("lane").cast("double"))
        return streams.zip_lanes(shifted, _equaliser(literal)).select("seq", rounded(F.col("x")).alias("x"))


_equalizer("equalizer12", False)
_equalizer("equalizer12_literal", True)


@query("merge_sorted", """WITH b AS (SELECT l_partkey AS k, l_orderkey * 8 + l_linenumber AS id, 0 AS side FROM lineitem UNION ALL SELECT p_partkey, p_partkey, 1 FROM part)
SELECT k, side, id, row_number() OVER (ORDER BY k, side, id) - 1 AS rank FROM b""")
def merge_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    right = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_partkey").alias("id"))
    # each stream's own order is (k, id); between the streams only k and the side decide
    return streams.merge_sorted(left, right, ["k"], within=["id"])


@query("words_in_order", f"SELECT word, n, row_number() OVER (ORDER BY word) - 1 AS rank FROM ({WORDS_SQL})")
def words_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word count in the byte order of the words, told by rank."""
    return sorting.ranked(wordcount(spark, sf_dir), ["word"])


@query("zip_files", "SELECT coalesce(n.n_nationkey, r.r_regionkey, s.s_suppkey - 1)::BIGINT AS seq, n_name, r_name, s_name FROM nation n FULL JOIN region r ON r_regionkey = n_nationkey FULL JOIN supplier s ON s_suppkey - 1 = coalesce(n_nationkey, r_regionkey)")
def zip_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [read(spark, sf_dir, t).select(seq.cast("long").alias("seq"), F.col(c).alias("value")) for t, seq, c in (("nation", F.col("n_nationkey"), "n_name"), ("region", F.col("r_regionkey"), "r_name"), ("supplier", F.col("s_suppkey") - 1, "s_name"))]
    return streams.zip_files(each, ["n_name", "r_name", "s_name"])


def _padded_sql(n: int) -> str:
    return f"{SIGNAL_SQL} UNION ALL SELECT (SELECT count(*) FROM events) + k, 0.0 FROM range({n}) t(k)"


def _bank_sql() -> str:
    parts, last = [f"s0 AS MATERIALIZED ({_padded_sql(BANK_PAD)})"], []
    for b in range(8):
        low, high = design.band_lowpass(b, taps=TAPS), design.band_highpass(b, taps=TAPS)
        parts.append(f"a{b} AS MATERIALIZED ({fir_sql('s0', low)})")
        parts.append(f"b{b} AS MATERIALIZED ({fir_sql(f'a{b}', high)})")
        parts.append(f"u{b} AS MATERIALIZED (SELECT (seq // 8) * 8 + k AS seq, CASE WHEN k = 0 THEN x ELSE 0.0 END AS x FROM b{b}, range(8) t(k) WHERE seq % 8 = 0)")
        for kind, taps in (("l", design.band_lowpass(b, gain=8.0, taps=TAPS)), ("h", design.band_highpass(b, gain=8.0, taps=TAPS))):
            parts.append(f"{kind}{b} AS MATERIALIZED ({fir_sql(f'u{b}', taps)})")
            last.append(f"{kind}{b}")
    total = " + ".join(f"{n}.x * 1.0" for n in last)
    joins = " ".join(f"JOIN {n} USING (seq)" for n in last[1:])
    return f"WITH {', '.join(parts)} SELECT seq, round(0.0::DOUBLE + {total}, 6) + 0.0 AS x FROM {last[0]} {joins}"


@query("filter_bank", _bank_sql())
def filter_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight bands as lanes of one frame, then both ends of each band as sixteen: a stage is one shuffle for all of them."""
    n = range(8)
    padded = streams.zero_padded(signal(spark, sf_dir), BANK_PAD)
    low = streams.fir(padded, {b: design.band_lowpass(b, taps=TAPS) for b in n}, lane="band")
    high = streams.fir(low, {b: design.band_highpass(b, taps=TAPS) for b in n}, keys=["band"])
    wide = streams.lanes(streams.upsample(streams.decimate(high, 8), 8), 2, "end")
    ends = wide.select((F.col("band") * 2 + F.col("end")).alias("lane"), "seq", "x")
    taps = {2 * b + e: f(b, gain=8.0, taps=TAPS) for b in n for e, f in enumerate((design.band_lowpass, design.band_highpass))}
    out = streams.zip_lanes(streams.fir(ends, taps, keys=["lane"]), [1.0] * 16)
    return out.select("seq", rounded(F.col("x")).alias("x"))


def _radio_taps() -> tuple[list[float], dict[int, list[float]]]:
    cut = design.equaliser_cutoffs()
    return design.receiver_lowpass(250e6, 108e6, TAPS), {k: design.receiver_lowpass(250e6, cut[(k + 1) // 2], TAPS) for k in range(12)}


def _radio_sql() -> str:
    front, bands = _radio_taps()
    parts = [f"s0 AS MATERIALIZED ({_padded_sql(RADIO_PAD)})", f"f AS MATERIALIZED ({fir_sql('s0', front, 5)})", f"d AS MATERIALIZED (SELECT seq, {num(GAIN)} * atan(x * lead(x) OVER (ORDER BY seq)) AS x FROM f QUALIFY lead(x) OVER (ORDER BY seq) IS NOT NULL)"]
    parts += [f"q{k} AS MATERIALIZED ({fir_sql('d', t)})" for k, t in bands.items()]
    total = " + ".join(f"q{k}.x * {num(w)}" for k, w in enumerate(_equaliser()))
    return f"WITH {', '.join(parts)} SELECT seq, round(0.0::DOUBLE + {total}, {GAIN_DIGITS}) + 0.0 AS x FROM q0 {' '.join(f'JOIN q{k} USING (seq)' for k in range(1, 12))}"


@query("fm_radio", _radio_sql())
def fm_radio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front filter, demodulator, twelve band filters as lanes, equaliser; every band counts (the literal last band would cancel)."""
    front, bands = _radio_taps()
    padded = streams.zero_padded(signal(spark, sf_dir), RADIO_PAD)
    sound = streams.pairs(streams.fir(padded, front, 5), lambda a, b: scalar.demodulate(a, b, GAIN))
    out = streams.zip_lanes(streams.fir(sound, bands, lane="lane"), _equaliser())
    return out.select("seq", rounded(F.col("x"), GAIN_DIGITS).alias("x"))


# Rows as arrays


def _listed(df: DataFrame, c, digits: int = DIGITS) -> DataFrame:
    return df.select("vec_id", F.posexplode(c).alias("k", "v")).select("vec_id", "k", rounded(F.col("v"), digits).alias("v"))


ROWS_SQL = "SELECT vec_id, k::INTEGER AS k, round(v, 6) + 0.0 AS v FROM (SELECT vec_id, unnest(generate_series(0, len(o) - 1)) AS k, unnest(o) AS v FROM ({}))"
_X = "list_transform(embedding, lambda x: x::DOUBLE)"


def _even_odd_sql(n: int, xs: str) -> str:
    order = [s + i for s in range(0, 64, n) for i in (*range(0, n, 2), *range(1, n, 2))]
    return f"list_transform({order}, lambda i: ({xs})[i + 1])"


@query("even_odd_reorder", ROWS_SQL.format(f"SELECT vec_id, {_even_odd_sql(16, _X)} AS o FROM embeddings"))
def even_odd_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(vectors(spark, sf_dir), arrays.even_odd(F.col("xs"), 16))


@query("bit_reverse64", ROWS_SQL.format(f"SELECT vec_id, list_transform({[int(f'{i:06b}'[::-1], 2) for i in range(64)]}, lambda i: ({_X})[i + 1]) AS o FROM embeddings"))
def bit_reverse64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(vectors(spark, sf_dir), arrays.bit_reversed(F.col("xs")))


@query("expand_zero", ROWS_SQL.format(f"SELECT vec_id, list_concat({_X}, list_transform(range(36), lambda i: 0.0::DOUBLE)) AS o FROM embeddings"))
def expand_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(vectors(spark, sf_dir), arrays.expand(F.col("xs"), 100))


@query("contract", ROWS_SQL.format(f"SELECT vec_id, list_slice({_X}, 1, 36) AS o FROM embeddings"))
def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(vectors(spark, sf_dir), arrays.contract(F.col("xs"), 36))


@query("transpose", ROWS_SQL.format(f"SELECT vec_id, list_transform({[r * 16 + c for c in range(16) for r in range(4)]}, lambda i: ({_X})[i + 1]) AS o FROM embeddings"))
def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(vectors(spark, sf_dir), arrays.transposed(F.col("xs"), 4, 16))


def _dft_sql(n: int, source: str, inverse: bool = False) -> str:
    """(vec_id, k, re, im) of rows (vec_id, j, re, im)."""
    sign, scale = ("", f" / {n}") if inverse else ("-", "")
    angle = f"2 * pi() * ((j * k) % {n}) / {n}"
    return f"SELECT vec_id, k, sum(re * cos({angle}) - im * ({sign}sin({angle}))){scale} AS re, sum(re * ({sign}sin({angle})) + im * cos({angle})){scale} AS im FROM ({source}), range({n}) t(k) GROUP BY vec_id, k"


_LONG = f"SELECT vec_id, unnest(generate_series(0, 63)) AS j, unnest({_X}) AS re, 0.0::DOUBLE AS im FROM embeddings"


def _spectrum(df: DataFrame, re, im, digits: int = 5) -> DataFrame:
    out = df.select("vec_id", F.posexplode(F.arrays_zip(re.alias("re"), im.alias("im"))).alias("k", "v"))
    return out.select("vec_id", F.col("k").cast("long").alias("k"), rounded(F.col("v.re"), digits).alias("re"), rounded(F.col("v.im"), digits).alias("im"))


@query("fft64", f"SELECT vec_id, k, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM ({_dft_sql(64, _LONG)})")
def fft64(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return _spectrum(df, *arrays.dft(F.col("xs"), arrays.expand(F.array().cast("array<double>"), 64), 64))


@query("ifft64", f"SELECT vec_id, k, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM ({_dft_sql(64, _LONG, True)})")
def ifft64(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return _spectrum(df, *arrays.dft(F.col("xs"), arrays.expand(F.array().cast("array<double>"), 64), 64, True))


@query("butterfly_stage", f"""SELECT vec_id, k::BIGINT AS k, round(CASE WHEN k % 8 < 4 THEN e[k + 1] + c * e[k + 5] ELSE e[k - 3] - c * e[k + 1] END, 6) + 0.0 AS re,
round(CASE WHEN k % 8 < 4 THEN s * e[k + 5] ELSE -s * e[k + 1] END, 6) + 0.0 AS im
FROM (SELECT vec_id, {_X} AS e, k, cos(2 * pi() * (k % 4) / 8) AS c, -sin(2 * pi() * (k % 4) / 8) AS s FROM embeddings, range(64) t(k))""")
def butterfly_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return _spectrum(df, *arrays.butterfly(F.col("xs"), arrays.expand(F.array().cast("array<double>"), 64), 8), DIGITS)


#: Channels of a burst, samples of a channel, and the points that they are padded to.
CHANNELS, SAMPLES, POINTS = 15, 36, 64
_TDE_IN = f"SELECT vec_id, j, CASE WHEN j < {SAMPLES} THEN re ELSE 0.0 END AS re, im FROM ({_LONG})"
_TDE_MID = f"SELECT vec_id, k AS j, re * 0.00390625 AS re, im * 0.00390625 AS im FROM ({_dft_sql(POINTS, _TDE_IN)})"


@query("tde", f"SELECT vec_id // {CHANNELS} AS burst, k * {CHANNELS} + vec_id % {CHANNELS} AS k, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM ({_dft_sql(POINTS, _TDE_MID, True)}) WHERE k < {SAMPLES} AND vec_id // {CHANNELS} < (SELECT count(*) FROM embeddings) // {CHANNELS}")
def tde(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of 36 x 15 samples, time after time: transposed and padded to 15 x 64, transformed by channel, scaled by 1/256,
    transformed back with true inverse weights, cut to 36 and transposed again. An incomplete last burst is drained."""
    rows = vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / CHANNELS).alias("burst"), (F.col("vec_id") % CHANNELS).alias("c"), arrays.contract(F.col("xs"), SAMPLES).alias("xs"))
    held = rows.groupBy("burst").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("c", "xs"))), lambda s: s["xs"])).alias("m"), F.count(F.lit(1)).alias("n")).where(F.col("n") == CHANNELS)
    burst = held.select("burst", arrays.transposed(F.col("m"), CHANNELS, SAMPLES).alias("m"))
    wide = burst.select("burst", arrays.expand_rows(F.col("m"), CHANNELS, SAMPLES, POINTS).alias("xs"))
    re, im = arrays.dft(F.col("xs"), arrays.expand(F.array().cast("array<double>"), CHANNELS * POINTS), POINTS)
    scaled = wide.select("burst", *[F.transform(c, lambda x: scalar.scale(x)).alias(n) for c, n in ((re, "re"), (im, "im"))])
    back = arrays.dft(F.col("re"), F.col("im"), POINTS, True)
    ends = scaled.select("burst", *[c.alias(n) for c, n in zip(back, ("re", "im"))])
    cut = ends.select("burst", *[arrays.contract_rows(F.col(n), CHANNELS, POINTS, SAMPLES).alias(n) for n in ("re", "im")])
    out = cut.select("burst", F.posexplode(F.arrays_zip("re", "im")).alias("k", "v"))
    return out.select("burst", F.col("k").cast("long").alias("k"), rounded(F.col("v.re")).alias("re"), rounded(F.col("v.im")).alias("im"))


_G = design.gaussian_iir(10.0)
_F0, _B0 = (_G["a0"] + _G["a1"]) / (1 + _G["b1"] + _G["b2"]), (_G["a2"] + _G["a3"]) / (1 + _G["b1"] + _G["b2"])
_FORWARD_SQL = f"""f AS (
  SELECT vec_id, 0 AS k, x, e, {num(_G['a0'])} * x + {num(_G['a1'])} * x - {num(_G['b1'])} * (x * {num(_F0)}) - {num(_G['b2'])} * (x * {num(_F0)}) AS y, x * {num(_F0)} AS y1
  FROM (SELECT vec_id, {_X} AS e, ({_X})[1] AS x FROM embeddings)
  UNION ALL SELECT vec_id, k + 1, e[k + 2], e, {num(_G['a0'])} * e[k + 2] + {num(_G['a1'])} * x - {num(_G['b1'])} * y - {num(_G['b2'])} * y1, y FROM f WHERE k < 63)"""
_BACKWARD_SQL = f"""g AS (
  SELECT vec_id, 0 AS k, x AS x1, x AS x2, e, {num(_G['a2'])} * x + {num(_G['a3'])} * x - {num(_G['b1'])} * (x * {num(_B0)}) - {num(_G['b2'])} * (x * {num(_B0)}) AS y, x * {num(_B0)} AS y1
  FROM (SELECT vec_id, list_reverse({_X}) AS e, ({_X})[64] AS x FROM embeddings)
  UNION ALL SELECT vec_id, k + 1, e[k + 1], x1, e, {num(_G['a2'])} * e[k + 1] + {num(_G['a3'])} * x1 - {num(_G['b1'])} * y - {num(_G['b2'])} * y1, y FROM g WHERE k < 63)"""


@query("iir_forward", f"WITH RECURSIVE {_FORWARD_SQL} SELECT vec_id, k::INTEGER AS k, round(y, 6) + 0.0 AS v FROM f")
def iir_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(vectors(spark, sf_dir), arrays.iir_forward(F.col("xs"), _G["a0"], _G["a1"], _G["b1"], _G["b2"]))


@query("gaussian_rows", f"WITH RECURSIVE {_FORWARD_SQL}, {_BACKWARD_SQL} SELECT f.vec_id, f.k::INTEGER AS k, round(f.y + g.y, 6) + 0.0 AS v FROM f JOIN g ON f.vec_id = g.vec_id AND g.k = 63 - f.k")
def gaussian_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(vectors(spark, sf_dir), arrays.gaussian_rows(F.col("xs"), 10.0))


def _pass_sql(name: str, source: str) -> str:
    """CTEs ending in ``name`` (img, c, p, k, v): the recursive Gaussian of 8-bit rows (img, c, p, e)."""
    g = {k: num(v) for k, v in _G.items()}
    cut = lambda v: f"least(greatest(floor({v}), 0.0), 255.0)"
    return f"""{name}_f AS (
  SELECT img, c, p, 0 AS k, x, e, {g['a0']} * x + {g['a1']} * x - {g['b1']} * (x * {num(_F0)}) - {g['b2']} * (x * {num(_F0)}) AS y, x * {num(_F0)} AS y1 FROM (SELECT *, e[1] AS x FROM {source})
  UNION ALL SELECT img, c, p, k + 1, e[k + 2], e, {g['a0']} * e[k + 2] + {g['a1']} * x - {g['b1']} * y - {g['b2']} * y1, y FROM {name}_f WHERE k < len(e) - 1),
{name}_b AS (
  SELECT img, c, p, 0 AS k, x AS x1, x AS x2, e, {g['a2']} * x + {g['a3']} * x - {g['b1']} * (x * {num(_B0)}) - {g['b2']} * (x * {num(_B0)}) AS y, x * {num(_B0)} AS y1 FROM (SELECT img, c, p, list_reverse(e) AS e, e[len(e)] AS x FROM {source})
  UNION ALL SELECT img, c, p, k + 1, e[k + 1], x1, e, {g['a2']} * e[k + 1] + {g['a3']} * x1 - {g['b1']} * y - {g['b2']} * y1, y FROM {name}_b WHERE k < len(e) - 1),
{name} AS (SELECT f.img, f.c, f.p, f.k, {cut(cut('f.y') + ' + g.y')} AS v FROM {name}_f f JOIN {name}_b g ON f.img = g.img AND f.c = g.c AND f.p = g.p AND g.k = len(f.e) - 1 - f.k)"""


@query("gaussian_image", f"""WITH RECURSIVE px AS (
  SELECT event_id // 100 // 50 AS img, event_id // 100 % 50 AS i, event_id % 100 AS j, c, CASE c WHEN 0 THEN floor(abs(value)) % 256 WHEN 1 THEN abs(user_id) % 256 WHEN 2 THEN event_id % 256 ELSE 255 END::DOUBLE AS v FROM events, range(4) t(c)),
r0 AS MATERIALIZED (SELECT img, c, i AS p, list(v ORDER BY j) AS e FROM px GROUP BY 1, 2, 3),
{_pass_sql('r', 'r0')},
q0 AS MATERIALIZED (SELECT img, c, k AS p, list(v ORDER BY p) AS e FROM r GROUP BY 1, 2, 3),
{_pass_sql('q', 'q0')}
SELECT img, k::BIGINT AS i, p::BIGINT AS j, sum(v * (1 << (8 * c)))::BIGINT AS pixel FROM q GROUP BY 1, 2, 3""")
def gaussian_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed images: unpacked, rows smoothed, transposed, rows smoothed, transposed, packed. A channel of a row is one array."""
    each = F.posexplode(F.array(*scalar.unpack_rgba(F.col("pixel")))).alias("c", "v")
    rows = images(spark, sf_dir).select("img", "i", "j", each)
    for across, along in (("i", "j"), ("j", "i")):
        held = rows.groupBy("img", "c", across).agg(F.sort_array(F.collect_list(F.struct(along, "v"))).alias("s"))
        smooth = held.select("img", "c", across, F.transform("s", lambda s: s[along]).alias("at"), arrays.gaussian_rows(F.transform("s", lambda s: s["v"]), 10.0, eight_bits=True).alias("xs"))  # noqa: B023
        rows = smooth.select("img", "c", across, F.explode(F.arrays_zip("at", "xs")).alias("o")).select("img", "c", across, F.col("o.at").alias(along), F.col("o.xs").alias("v"))
    channels = [F.max(F.when(F.col("c") == k, F.col("v"))) for k in range(4)]
    return rows.groupBy("img", "i", "j").agg(scalar.pack_rgba(*channels).alias("pixel"))


# Grids


GRID_SQL = "g AS (SELECT event_id // 100 AS i, event_id % 100 AS j, abs(value) + 1.0 AS v FROM events), d AS (SELECT *, coalesce(lag(v) OVER c, v) - v AS d_n, coalesce(lead(v) OVER c, v) - v AS d_s, coalesce(lag(v) OVER r, v) - v AS d_w, coalesce(lead(v) OVER r, v) - v AS d_e FROM g WINDOW c AS (PARTITION BY j ORDER BY i), r AS (PARTITION BY i ORDER BY j))"
Q0 = 0.8


@query("srad_gradient", f"WITH {GRID_SQL} SELECT i, j, round(d_n, 6) + 0.0 AS d_n, round(d_s, 6) + 0.0 AS d_s, round(d_w, 6) + 0.0 AS d_w, round(d_e, 6) + 0.0 AS d_e FROM d")
def srad_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.gradients(grid_of(spark, sf_dir))
    return out.select("i", "j", *[rounded(F.col(c)).alias(c) for c in ("d_n", "d_s", "d_w", "d_e")])


@query("srad_step", f"""WITH {GRID_SQL},
q AS (SELECT *, (0.5 * ((d_n*d_n + d_s*d_s + d_w*d_w + d_e*d_e) / (v*v)) - 0.0625 * ((d_n+d_s+d_w+d_e)/v) * ((d_n+d_s+d_w+d_e)/v)) / ((1 + 0.25 * ((d_n+d_s+d_w+d_e)/v)) * (1 + 0.25 * ((d_n+d_s+d_w+d_e)/v))) AS q FROM d),
c AS (SELECT *, least(greatest(1 / (1 + (q - {Q0}) / ({Q0} * (1 + {Q0}))), 0.0), 1.0) AS c FROM q),
n AS (SELECT *, coalesce(lead(c) OVER (PARTITION BY j ORDER BY i), c) AS s, coalesce(lead(c) OVER (PARTITION BY i ORDER BY j), c) AS e FROM c)
SELECT i, j, round(v + 0.125 * (c * d_n + s * d_s + c * d_w + e * d_e), 5) + 0.0 AS v FROM n""")
def srad_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.diffuse(grid_of(spark, sf_dir), Q0).select("i", "j", rounded(F.col("v"), 5).alias("v"))


@query("srad", """WITH g AS (SELECT event_id // 100 // 50 AS img, event_id // 100 % 50 AS i, event_id % 100 AS j, exp(abs(value) / 1000) AS v FROM events),
t AS (SELECT img, var_pop(v) / (avg(v) * avg(v)) AS q0 FROM g GROUP BY 1),
d AS (SELECT *, coalesce(lag(v) OVER c, v) - v AS d_n, coalesce(lead(v) OVER c, v) - v AS d_s, coalesce(lag(v) OVER r, v) - v AS d_w, coalesce(lead(v) OVER r, v) - v AS d_e FROM g JOIN t USING (img) WINDOW c AS (PARTITION BY img, j ORDER BY i), r AS (PARTITION BY img, i ORDER BY j)),
q AS (SELECT *, (0.5 * ((d_n*d_n + d_s*d_s + d_w*d_w + d_e*d_e) / (v*v)) - 0.0625 * ((d_n+d_s+d_w+d_e)/v) * ((d_n+d_s+d_w+d_e)/v)) / ((1 + 0.25 * ((d_n+d_s+d_w+d_e)/v)) * (1 + 0.25 * ((d_n+d_s+d_w+d_e)/v))) AS q FROM d),
c AS (SELECT *, least(greatest(1 / (1 + (q - q0) / (q0 * (1 + q0))), 0.0), 1.0) AS c FROM q),
n AS (SELECT *, coalesce(lead(c) OVER (PARTITION BY img, j ORDER BY i), c) AS s, coalesce(lead(c) OVER (PARTITION BY img, i ORDER BY j), c) AS e FROM c)
SELECT img, i, j, round(ln(v + 0.125 * (c * d_n + s * d_s + c * d_w + e * d_e)), 5) + 0.0 AS v FROM n""")
def srad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diffusion program over images: each image has its own statistic."""
    row, events = F.floor(F.col("event_id") / 100), read(spark, sf_dir, "events")
    held = events.select(F.floor(row / 50).alias("img"), F.pmod(row, F.lit(50)).alias("i"), (F.col("event_id") % 100).alias("j"), (F.abs("value") / 1000).alias("v"))
    return grid.srad(held, ["img"]).select("img", "i", "j", rounded(F.col("v"), 5).alias("v"))


@query("block_stats", "SELECT event_id // 1000 AS block, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance, round(var_pop(value) / (avg(value) * avg(value)), 4) AS q0 FROM events GROUP BY 1")
def block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.block_statistics(signal(spark, sf_dir), F.floor(F.col("seq") / 1000))
    return out.select("block", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), F.round("q0", 4).alias("q0"))


# Sorting, logs, feedback


@query("global_sort_rank", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS rank FROM lineitem")
def global_sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return sorting.ranked(rows, ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("log_avg", "SELECT event_type, round(avg(value), 6) AS avg_value, round(avg(user_id), 6) AS avg_user_id FROM events WHERE event_type NOT LIKE '#%' GROUP BY 1")
def log_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = logs.group_average(read(spark, sf_dir, "events").where(~F.col("event_type").startswith("#")), "event_type", ["value", "user_id"])
    return out.select("event_type", F.round("avg_value", 6).alias("avg_value"), F.round("avg_user_id", 6).alias("avg_user_id"))


@query("log_speedup", "SELECT n_regionkey, total, round((SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1) / total, 6) AS speedup FROM (SELECT n_regionkey, count(*) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)")
def log_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("total"))
    return logs.speedup(runs, F.col("n_regionkey") == 1, "total").withColumn("speedup", F.round("speedup", 6))


@query("log_pivot", "SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS O, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS F FROM orders GROUP BY 1")
def log_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = logs.pivoted(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["O", "F"], F.col("o_totalprice"))
    return out.select("o_orderpriority", F.round("O", 4).alias("O"), F.round("F", 4).alias("F"))


@query("log_counts", "SELECT count(*) AS total, count(*) FILTER (event_type LIKE 'c%') AS waiting FROM events")
def log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("event_type").startswith("c"), 1)).alias("waiting"))


@query("log_buckets", "SELECT floor(value / 100)::BIGINT * 100 + 1 AS bucket, count(*) AS n FROM events GROUP BY 1")
def log_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy((F.floor(F.col("value") / 100) * 100 + 1).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("log_field", "SELECT string_split(p_name, ' ')[1] AS title, count(*) AS n FROM part WHERE p_name NOT LIKE '#%' GROUP BY 1")
def log_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.field(read(spark, sf_dir, "part"), 0, "title", "p_name").groupBy("title").agg(F.count(F.lit(1)).alias("n"))


@query("log_normalise", "SELECT c_custkey, round(c_acctbal / 2, 6) AS half FROM customer")
def log_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", F.round(F.col("c_acctbal") / 2, 6).alias("half"))


@query("trace_edges", "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def trace_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.change_points(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], "event_type").drop("ts")


@query("event_gap", "SELECT event_id, (epoch_us(lead(ts) OVER w) - epoch_us(ts))::BIGINT AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def event_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = read(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return logs.gaps(stamped, ["user_id"], "ts", "event_id").select("event_id", "gap")


@query("live_threads", "SELECT user_id, max(live)::BIGINT AS most, round(avg(live), 6) AS mean FROM (SELECT user_id, sum(CASE WHEN event_type LIKE 'c%' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS live FROM events) GROUP BY 1")
def live_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = logs.running_sum(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.when(F.col("event_type").startswith("c"), 1).otherwise(-1))
    return live.groupBy("user_id").agg(F.max("live").alias("most"), F.round(F.avg("live"), 6).alias("mean"))


@query("steady_threads", "WITH l AS (SELECT user_id, sum(CASE WHEN event_type LIKE 'c%' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS live FROM events), m AS (SELECT *, max(live) OVER (PARTITION BY user_id) AS most FROM l) SELECT user_id, max(most)::BIGINT AS most, round(avg(live) FILTER (live * 10 >= most), 6) AS steady FROM m GROUP BY 1")
def steady_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = logs.running_sum(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.when(F.col("event_type").startswith("c"), 1).otherwise(-1))
    return logs.steady_mean(live, ["user_id"]).select("user_id", "most", F.round("steady", 6).alias("steady"))


@query("feedback_levels", "WITH RECURSIVE r AS (SELECT o_orderkey AS k, 0 AS level FROM orders UNION ALL SELECT k // 2, level + 1 FROM r WHERE k > 1) SELECT level, count(*) AS n, max(k) AS top FROM r GROUP BY 1")
def feedback_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halved until nothing is left."""
    base = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    out = feedback.levels(base, lambda d: d.where("k > 1").select(F.floor(F.col("k") / 2).alias("k")))
    return out.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("top"))


@query("program_adjacency", """WITH e(p, c) AS (VALUES ('0', '1'), ('1', '2'), ('2', '5'), ('0', '3'), ('3', '4'), ('4', '5')), n AS (SELECT p AS kernel FROM e UNION SELECT c FROM e)
SELECT kernel, (SELECT coalesce(string_agg(c, ',' ORDER BY c), '') FROM e WHERE p = kernel) AS successors, (SELECT coalesce(string_agg(p, ',' ORDER BY p), '') FROM e WHERE c = kernel) AS predecessors FROM n""")
def program_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diamond of six kernels."""
    p = Program().kernel("0", start=True)
    for k in "12345":
        p.kernel(k)
    for i, (a, b) in enumerate([("0", "1"), ("1", "2"), ("2", "5"), ("0", "3"), ("3", "4"), ("4", "5")]):
        p.queue(f"q{i}", a, b)
    p.verify()
    return adjacency(p.edges(spark)).select("kernel", *[F.concat_ws(",", c).alias(c) for c in ("successors", "predecessors")])

"""Registered queries of the ordered-sequence engine and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import planes as pl
from strandloom.functions import text as tx
from strandloom.operators import folds, seq
from strandloom.plans import generated, transcribe
from strandloom.sources import decode
from strandloom.sources import frames as src
from strandloom.stored import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EVENT = ["ts", "event_id"]
_DROP = "30.0"
_WRAP = f"WITH e AS (SELECT *, lag(value) OVER w AS b FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) "


@query(_WRAP + f"SELECT user_id, event_id, value FROM e WHERE b IS NULL OR value < b - {_DROP}")
def page_wraps(spark, d):
    return seq.page_wraps(table(spark, d, "events"), ["user_id"], EVENT, "value", F.lit(float(_DROP))).select("user_id", "event_id", "value")


_PAGED = _WRAP.rstrip() + f""", p AS (SELECT *, sum(CASE WHEN b IS NULL OR value < b - {_DROP} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, page ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id, page) AS size FROM p),
g AS (SELECT *, CASE WHEN size - 2 >= 3 THEN i > 1 AND i < size ELSE true END AS contributes FROM r) """


@query(_PAGED + "SELECT user_id, event_id, page::INT AS page, size, contributes FROM g")
def page_groups(spark, d):
    return seq.page_groups(table(spark, d, "events"), ["user_id"], EVENT, "value", F.lit(float(_DROP))).select("user_id", "event_id", "page", "size", "contributes")


@query(_PAGED + """SELECT user_id, page::INT AS page, CASE WHEN s < 5 THEN s ELSE s - 2 END AS n, floor(CASE WHEN s < 5 THEN most ELSE middle END) AS level, s < 5 AS low_confidence
FROM (SELECT user_id, page, max(size) AS s, max(value) AS most, median(value) FILTER (WHERE i > 1 AND i < size) AS middle FROM r GROUP BY user_id, page)""")
def median_composite(spark, d):
    """Pages of one to four rows have under three between their ends: their level is the largest of all rows."""
    g = seq.page_groups(table(spark, d, "events"), ["user_id"], EVENT, "value", F.lit(float(_DROP))).filter("contributes")
    few = seq.few_inside(F.col("size"))
    return g.groupBy("user_id", "page").agg(F.count("*").alias("n"), seq.composite_level("value", few).alias("level"), F.max(few).alias("low_confidence"))


@query("""WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events),
s AS (SELECT DISTINCT user_id, CASE WHEN least(7, n) = 1 THEN 0 ELSE (j * (n - 1)) // (least(7, n) - 1) END AS pos FROM (SELECT DISTINCT user_id, n FROM p), range(0, 7) t(j) WHERE j < least(7, n))
SELECT p.user_id, p.event_id, p.pos::INT AS pos FROM p JOIN s ON p.user_id = s.user_id AND p.pos = s.pos""")
def even_sample(spark, d):
    return seq.even_sample(table(spark, d, "events"), ["user_id"], EVENT, 7).select("user_id", "event_id", "pos")


@query("""WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events),
s AS (SELECT DISTINCT user_id, CASE WHEN least(40, n) = 1 THEN 0 ELSE (j * (n - 1)) // (least(40, n) - 1) END AS pos FROM (SELECT DISTINCT user_id, n FROM p), range(0, 40) t(j) WHERE j < least(40, n))
SELECT p.user_id, p.event_id, p.pos::INT AS pos FROM p JOIN s ON p.user_id = s.user_id AND p.pos = s.pos""")
def even_sample_40(spark, d):
    """``even_sample`` with the survey's k."""
    return seq.even_sample(table(spark, d, "events"), ["user_id"], EVENT, 40).select("user_id", "event_id", "pos")


@query("""WITH p AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)
SELECT user_id, event_id, (pos - 2)::INT AS pos, greatest(0, least(99, (SELECT count(*) FROM events e WHERE e.user_id = p.user_id) - 1)) AS clamped FROM p WHERE pos BETWEEN 2 AND 5""")
def frame_slice(spark, d):
    placed = seq.number(table(spark, d, "events"), ["user_id"], EVENT).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    return seq.slice_frames(placed, "pos", 2, 5).select("user_id", "event_id", "pos", seq.clamp_index(F.lit(99), F.col("n")).alias("clamped"))


@query("SELECT l_returnflag, l_linestatus, round(avg((l_discount < 0.05 AND l_quantity > 20)::INT), 6) AS fraction FROM lineitem GROUP BY 1, 2")
def paper_filter_fraction(spark, d):
    f = seq.fraction_where(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], (F.col("l_discount") < 0.05) & (F.col("l_quantity") > 20))
    return f.withColumn("fraction", F.round("fraction", 6))


_FLAG = "WITH p AS (SELECT user_id, value > 40 AS flag, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events), i AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS g FROM p WHERE flag), r AS (SELECT user_id, min(pos)::INT AS \"start\", (max(pos) + 1)::INT AS \"end\" FROM i GROUP BY user_id, g) "


def _flags(spark, d):
    return table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("value") > 40).alias("flag"))


@query(_FLAG + 'SELECT user_id, "start", "end" FROM r')
def contiguous_runs(spark, d):
    return seq.runs(_flags(spark, d), ["user_id"], EVENT, "flag")


@query(_FLAG + 'SELECT user_id, "start", "end" FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "end" - "start" DESC, "start") AS k FROM r) WHERE k = 1')
def largest_run(spark, d):
    return seq.largest_run(_flags(spark, d), ["user_id"], EVENT, "flag")


@query(_FLAG + """, c AS (SELECT user_id, pos, flag, max(CASE WHEN flag THEN pos END) OVER (PARTITION BY user_id ORDER BY pos) AS a,
min(CASE WHEN flag THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM p)
SELECT user_id, pos::INT AS pos, flag OR coalesce(b - a - 1 <= 2, false) AS closed FROM c""")
def close_short_gaps(spark, d):
    return seq.close_short_gaps(_flags(spark, d), ["user_id"], EVENT, "flag", 2).select("user_id", "pos", "closed")


_DAYS = "date_diff('day', TIMESTAMP '1990-01-01', o_orderdate)"


def _order_days(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.datediff("o_orderdate", F.lit("1990-01-01")).alias("day"))


@query(f"""WITH o AS (SELECT o_custkey, o_orderkey, {_DAYS} AS day, o_orderdate FROM orders),
n AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) > 150 THEN 1 WHEN lag(day) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NULL THEN 1 ELSE 0 END AS f FROM o)
SELECT o_custkey, o_orderkey, (sum(f) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::INT AS cluster FROM n""")
def gap_clusters(spark, d):
    return seq.gap_clusters(_order_days(spark, d), ["o_custkey"], ["o_orderdate", "o_orderkey"], "day", 150).select("o_custkey", "o_orderkey", "cluster")


@query(f"""WITH o AS (SELECT DISTINCT o_custkey, {_DAYS} AS day FROM orders),
l AS (SELECT o_custkey, day, sum(f) OVER (PARTITION BY o_custkey ORDER BY day) AS line FROM (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY o_custkey ORDER BY day) <= 30 THEN 0 ELSE 1 END AS f FROM o)),
c AS (SELECT o_custkey, line, round_even(avg(day), 0)::BIGINT AS center FROM l GROUP BY 1, 2),
s AS (SELECT *, sum(f) OVER (PARTITION BY o_custkey ORDER BY center, line) AS staff FROM (SELECT *, CASE WHEN center - lag(center) OVER (PARTITION BY o_custkey ORDER BY center, line) <= 200 THEN 0 ELSE 1 END AS f FROM c))
SELECT o_custkey, staff::INT AS staff, min(center) AS top, max(center) AS bottom, count(*)::INT AS n_lines, string_agg(center::VARCHAR, ',' ORDER BY center) AS line_centers FROM s GROUP BY o_custkey, staff""")
def two_level_clusters(spark, d):
    days = _order_days(spark, d).select("o_custkey", F.col("day").cast("long").alias("day")).distinct()
    out = seq.two_level_clusters(days, ["o_custkey"], "day", 30, 200)
    return out.withColumn("line_centers", F.array_join(F.transform("line_centers", lambda c: c.cast("string")), ","))


_EDGES = ["l_linenumber", "l_quantity", "l_discount", "l_extendedprice"]


@query("SELECT l_suppkey, " + ", ".join(f"round_even(median({e}), 0)::DOUBLE AS {e}" for e in _EDGES) + " FROM lineitem GROUP BY l_suppkey")
def median_box(spark, d):
    return seq.median_box(table(spark, d, "lineitem"), ["l_suppkey"], _EDGES).select("l_suppkey", *(F.col(e).cast("double").alias(e) for e in _EDGES))


@query("""WITH b AS (SELECT l_suppkey AS k, CASE WHEN l_linenumber < 7 THEN l_linenumber END AS x0, CASE WHEN l_linenumber < 7 THEN l_quantity END AS x1,
CASE WHEN l_linenumber < 7 THEN l_tax * 100 END AS y0, CASE WHEN l_linenumber < 7 THEN l_discount * 100 END AS y1, CASE WHEN l_suppkey % 2 = 0 THEN 400 ELSE 500 END AS side FROM lineitem),
m AS (SELECT k AS mk, median(x0) AS a, median(x1) AS b, median(y0) AS c, median(y1) AS e FROM b GROUP BY k)
SELECT k AS l_suppkey, round_even(sum(CASE WHEN abs(x0 - a) <= t AND abs(x1 - b) <= t AND abs(y0 - c) <= t AND abs(y1 - e) <= t THEN 1 ELSE 0 END) / count(*), 3) AS confidence, count(*) AS n
FROM (SELECT *, side * 0.03::DOUBLE AS t FROM b JOIN m ON k = mk) GROUP BY k""")
def box_agreement(spark, d):
    """Boxes in frames of 400 or 500: a supplier's line is a sample, the seventh line of an order has no box."""
    box = {"x0": F.col("l_linenumber"), "x1": F.col("l_quantity"), "y0": F.col("l_tax") * 100, "y1": F.col("l_discount") * 100}
    li = table(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_suppkey") % 2 == 0, 400).otherwise(500).alias("side"), *(F.when(F.col("l_linenumber") < 7, c).alias(e) for e, c in box.items()))
    return seq.agreement(li, ["l_suppkey"], list(box), "side")


@query("""WITH p AS (SELECT l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS pos FROM lineitem),
c AS (SELECT l_partkey, l_linenumber, count(*) AS votes, min(pos) AS f FROM p GROUP BY 1, 2)
SELECT l_partkey, l_linenumber, votes FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY votes DESC, f) AS k FROM c) WHERE k = 1""")
def modal_value(spark, d):
    return seq.modal_value(table(spark, d, "lineitem"), ["l_partkey"], ["l_orderkey", "l_linenumber"], "l_linenumber")


@query("""WITH s AS (SELECT user_id, median(value) + greatest(2 * (stddev_pop(value) + 1e-6), 25) AS t FROM events GROUP BY 1)
SELECT e.user_id, sum((value > t)::INT)::BIGINT AS anomalies FROM events e JOIN s ON e.user_id = s.user_id GROUP BY e.user_id""")
def adaptive_anomaly(spark, d):
    return seq.anomalies(table(spark, d, "events"), ["user_id"], "value", 2.0).groupBy("user_id").agg(F.sum(F.col("anomalous").cast("int")).alias("anomalies"))


@query("SELECT event_type, CASE WHEN value > 0 THEN event_id END AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1")
def argmax_first(spark, d):
    return seq.argmax_first(table(spark, d, "events"), ["event_type"], "event_id", "value")


def _motion(spark, d):
    w = Window.partitionBy("user_id").orderBy(*EVENT)
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return e.select("user_id", "ts", "event_id", F.round(F.col("value") - F.lag("value").over(w), 4).alias("dx"), (F.col("k") - F.lag("k").over(w)).alias("dy"), "value", "k").filter("dx IS NOT NULL")


_MOTION = """WITH m AS (SELECT * FROM (SELECT user_id, ts, event_id, value, k, round(value - lag(value) OVER w, 4) AS dx, k - lag(k) OVER w AS dy
FROM (SELECT *, json_extract_string(props, '$.k')::DOUBLE AS k FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE dx IS NOT NULL) """


@query(_MOTION + """, s AS (SELECT user_id, CASE WHEN round(sum(abs(dx)), 3) >= round(sum(abs(dy)), 3) THEN 'x' ELSE 'y' END AS axis, median(abs(dx)) AS med_dx, median(abs(dy)) AS med_dy FROM m GROUP BY 1),
c AS (SELECT s.user_id, axis, med_dx, med_dy, sum((d > side)::INT) AS u, sum((d < -side)::INT) AS v FROM (SELECT m.user_id, CASE WHEN axis = 'x' THEN dx ELSE dy END AS d, CASE WHEN axis = 'x' THEN 3 ELSE 5 END AS side FROM m JOIN s ON m.user_id = s.user_id) q JOIN s ON q.user_id = s.user_id GROUP BY 1, 2, 3, 4)
SELECT user_id, axis, (u + v)::BIGINT AS n_events, CASE WHEN u + v >= 4 THEN round(greatest(u, v) / (u + v), 6) ELSE 0 END AS coherence, med_dx, med_dy,
CASE WHEN med_dy > 2 AND med_dy >= med_dx THEN 'scroll_vertical' WHEN med_dx > 2 AND med_dx > med_dy THEN 'scroll_horizontal'
WHEN u + v >= 4 AND greatest(u, v) * 100 >= (u + v) * 85 THEN CASE WHEN axis = 'y' THEN 'scroll_vertical' ELSE 'scroll_horizontal' END ELSE 'paginated' END AS mode FROM c""")
def advance_mode(spark, d):
    return seq.advance_mode(_motion(spark, d), ["user_id"], "dx", "dy", 150.0, 250.0)


@query(_MOTION + """, s AS (SELECT *, CASE WHEN abs(dx) > 20 THEN 'match' WHEN dy >= 0 AND dy < 50 THEN 'fallback' ELSE 'unresolved' END AS resolution FROM m)
SELECT user_id, event_id, resolution, round(sum(CASE resolution WHEN 'match' THEN greatest(dx, 0) WHEN 'fallback' THEN dy ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id), 3) AS "offset" FROM s""")
def conditional_offsets(spark, d):
    out = seq.running_offsets(_motion(spark, d), ["user_id"], EVENT, F.col("dx"), F.abs("dx") > 20, F.col("dy"), F.lit(50.0))
    return out.select("user_id", "event_id", "resolution", F.round("offset", 3).alias("offset"))


@query("""WITH f AS (SELECT o_orderkey AS f, (o_orderkey % 5000)::INT AS off FROM orders),
b AS (SELECT r::INT AS b, (r * 200)::INT AS y0, (r * 200 + 200)::INT AS y1 FROM range(0, 26) t(r)),
p AS (SELECT f, b, (off <= y0 AND off + 450 >= y1) AS inside FROM f JOIN b ON off < y1 AND off + 450 > y0),
n AS (SELECT *, sum(inside::INT) OVER (PARTITION BY b) AS k FROM p)
SELECT b, f, inside, k < 3 AS fallback FROM n WHERE k < 3 OR inside""")
def band_cover_join(spark, d):
    """Every order is a frame."""
    frames = table(spark, d, "orders").select(F.col("o_orderkey").alias("f"), (F.col("o_orderkey") % 5000).cast("int").alias("off"))
    bands = spark.range(26).select(F.col("id").alias("b"), (F.col("id") * 200).cast("int").alias("y0"), (F.col("id") * 200 + 200).cast("int").alias("y1"))
    return seq.band_cover(frames, bands, 450, 200).select(F.col("b").cast("int").alias("b"), "f", "inside", "fallback")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, (l_orderkey % 5000)::INT AS off FROM lineitem),
b AS (SELECT r::INT AS b, (r * 200)::INT AS y0, (r * 200 + 200)::INT AS y1 FROM range(0, 26) t(r)),
p AS (SELECT l_orderkey, l_linenumber, b, (off <= y0 AND off + 450 >= y1) AS inside FROM f JOIN b ON off < y1 AND off + 450 > y0),
n AS (SELECT *, sum(inside::INT) OVER (PARTITION BY b) AS k FROM p)
SELECT b, l_orderkey, l_linenumber, inside, k < 3 AS fallback FROM n WHERE k < 3 OR inside""")
def band_cover_lines(spark, d):
    """``band_cover_join`` where every line is a frame."""
    frames = table(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("f"), (F.col("l_orderkey") % 5000).cast("int").alias("off"))
    bands = spark.range(26).select(F.col("id").alias("b"), (F.col("id") * 200).cast("int").alias("y0"), (F.col("id") * 200 + 200).cast("int").alias("y1"))
    return seq.band_cover(frames, bands, 450, 200).select(F.col("b").cast("int").alias("b"), "f.*", "inside", "fallback")


_MAD = """WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1),
a AS (SELECT e.event_type, median(abs(value - med)) AS mad FROM events e JOIN m ON e.event_type = m.event_type GROUP BY 1),
z AS (SELECT e.event_type, event_id, abs(value - med) / (1.4826 * (mad + 1e-6)) AS z FROM events e JOIN m ON e.event_type = m.event_type JOIN a ON e.event_type = a.event_type) """


@query(_MAD + "SELECT event_type, event_id, round(z, 4) AS z FROM z WHERE z > 3.5")
def mad_outliers(spark, d):
    return seq.mad_z(table(spark, d, "events"), ["event_type"], "value").filter("z > 3.5").select("event_type", "event_id", F.round("z", 4).alias("z"))


@query(_MAD + """, o AS (SELECT *, sum(f) OVER (PARTITION BY event_type ORDER BY event_id) AS event FROM (SELECT *, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) <= 300 THEN 0 ELSE 1 END AS f FROM z WHERE z > 3.5))
SELECT event_type, event::INT AS event, event_id + 1 AS "start", round(z, 4) AS peak FROM (SELECT *, row_number() OVER (PARTITION BY event_type, event ORDER BY z DESC, event_id) AS k FROM o) WHERE k = 1""")
def boundary_candidates(spark, d):
    z = seq.mad_z(table(spark, d, "events"), ["event_type"], "value")
    return seq.outlier_events(z, ["event_type"], "event_id", "z", 3.5, 300).select("event_type", "event", "start", F.round("peak", 4).alias("peak"))


@query("""WITH p AS (SELECT label, vec_id, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT label, vec_id, round(sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i]::DOUBLE - b[i]::DOUBLE) ** 2))), 4) AS distance FROM p WHERE b IS NOT NULL""")
def adjacent_distance(spark, d):
    out = seq.adjacent_distance(table(spark, d, "embeddings"), ["label"], ["vec_id"], "embedding")
    return out.filter("distance IS NOT NULL").select("label", "vec_id", F.round("distance", 4).alias("distance"))


@query("""WITH s AS (SELECT p_brand AS k, count(*) AS n, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1), t AS (SELECT *, least(64, greatest(8, n)) AS bins FROM s),
c AS (SELECT k, n, lo, hi, bins, least(floor((p_retailprice - lo) / (hi - lo) * bins), bins - 1) AS bin, count(*) AS c FROM part JOIN t ON p_brand = k WHERE n >= 2 AND lo < hi GROUP BY 1, 2, 3, 4, 5, 6),
m AS (SELECT *, lo + (bin + 0.5) * (hi - lo) / bins AS center FROM c),
r AS (SELECT *, sum(c) OVER w AS w0, sum(c * center) OVER w AS s0, sum(c * center) OVER (PARTITION BY k) AS st FROM m WINDOW w AS (PARTITION BY k ORDER BY bin)),
b AS (SELECT *, coalesce(round(w0 * (n - w0) * (s0 / w0 - (st - s0) / nullif(n - w0, 0)) ** 2 / (n * n), 6), 0) AS v FROM r)
SELECT k AS p_brand, round(center, 4) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC, bin) AS i FROM b) WHERE i = 1
UNION ALL SELECT k, round(hi, 4) FROM t WHERE n < 2 OR lo = hi""")
def otsu_threshold(spark, d):
    return seq.otsu(table(spark, d, "part"), ["p_brand"], "p_retailprice").select("p_brand", F.round("threshold", 4).alias("threshold"))


@query("""WITH RECURSIVE i AS (SELECT p_brand, p_partkey, p_size AS h, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part),
f AS (SELECT p_brand, p_partkey, h, k, 0 AS sheet, 0 AS y FROM i WHERE k = 1 UNION ALL
SELECT i.p_brand, i.p_partkey, i.h, i.k, CASE WHEN f.y + f.h + 3 + i.h <= 150 THEN f.sheet ELSE f.sheet + 1 END, CASE WHEN f.y + f.h + 3 + i.h <= 150 THEN f.y + f.h + 3 ELSE 0 END FROM f JOIN i ON i.p_brand = f.p_brand AND i.k = f.k + 1)
SELECT p_brand, p_partkey, h AS p_size, sheet, y FROM f""")
def page_packing(spark, d):
    return seq.pack(table(spark, d, "part"), ["p_brand"], ["p_partkey"], "p_size", 150, 3)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = m OR l_quantity * 100 < 50 * 55 THEN 50.0 ELSE l_quantity END AS kept, l_linenumber = m AS last, l_linenumber <> m AND l_quantity * 100 < 50 * 55 AS guarded
FROM (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS m FROM lineitem)""")
def trim_guard(spark, d):
    li = table(spark, d, "lineitem").withColumn("last", F.col("l_linenumber") == F.max("l_linenumber").over(Window.partitionBy("l_orderkey")))
    cut = pl.trimmed(F.lit(50.0), F.col("l_quantity"), F.col("last"))
    return li.select("l_orderkey", "l_linenumber", cut["kept"].alias("kept"), "last", cut["guarded"].alias("guarded"))


@query("SELECT p_brand, p_partkey, greatest(1, round_even(p_size * (2240.0 / max(p_size) OVER (PARTITION BY p_brand))::DOUBLE, 0))::INT AS width FROM part")
def uniform_scale(spark, d):
    return seq.common_scale(table(spark, d, "part"), ["p_brand"], "p_size", 2240).select("p_brand", "p_partkey", seq.scaled_size(F.col("p_size"), F.col("factor")).alias("width"))


@query("""WITH c AS (SELECT l_orderkey, sum((l_returnflag = 'R')::INT) AS issues, sum((l_discount = 0)::INT) AS low, max((l_tax > 0.07)::INT) AS overlap, sum((l_quantity > 49)::INT) AS cuts, sum(l_quantity) * 3 AS ink FROM lineitem GROUP BY 1)
SELECT l_orderkey, greatest(0.0, round(100.0 - 15 * issues - 10 * low - 25 * overlap - 20 * cuts - CASE WHEN ink > 3000 THEN 30 WHEN ink > 300 THEN 10 ELSE 0 END, 1))::DOUBLE AS score FROM c""")
def report_score(spark, d):
    """A score an order, from all of its lines."""
    c = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum((F.col("l_returnflag") == "R").cast("int")).alias("issues"), F.sum((F.col("l_discount") == 0).cast("int")).alias("low"), F.max((F.col("l_tax") > 0.07).cast("int")).alias("overlap"),
        F.sum((F.col("l_quantity") > 49).cast("int")).alias("cuts"), (F.sum("l_quantity") * 3).alias("ink"),
    )
    return c.select("l_orderkey", folds.penalty_score(*(F.col(x) for x in ("issues", "low", "overlap", "cuts", "ink"))).alias("score"))


@query("""WITH c AS (SELECT l_suppkey, l_orderkey, sum((l_returnflag = 'R')::INT) AS issues, sum((l_discount = 0)::INT) AS low, max((l_tax > 0.07)::INT) AS overlap, sum((l_quantity > 49)::INT) AS cuts, sum(l_quantity) AS ink FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_orderkey, greatest(0.0, round(100.0 - 15 * issues - 10 * low - 25 * overlap - 20 * cuts - CASE WHEN ink > 3000 THEN 30 WHEN ink > 300 THEN 10 ELSE 0 END, 1))::DOUBLE AS score FROM c""")
def report_score_orders(spark, d):
    """``report_score`` over every line, by supplier and order."""
    c = table(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(
        F.sum((F.col("l_returnflag") == "R").cast("int")).alias("issues"), F.sum((F.col("l_discount") == 0).cast("int")).alias("low"), F.max((F.col("l_tax") > 0.07).cast("int")).alias("overlap"),
        F.sum((F.col("l_quantity") > 49).cast("int")).alias("cuts"), F.sum("l_quantity").alias("ink"),
    )
    return c.select("l_suppkey", "l_orderkey", folds.penalty_score(*(F.col(x) for x in ("issues", "low", "overlap", "cuts", "ink"))).alias("score"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def history_recent(spark, d):
    return seq.recent(table(spark, d, "orders"), "o_orderdate", "o_orderkey", 50).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""WITH n AS (SELECT s_suppkey * 3 AS c_custkey, upper(s_name) AS c_name, s_acctbal AS c_acctbal FROM supplier)
SELECT coalesce(n.c_custkey, b.c_custkey) AS c_custkey, coalesce(n.c_name, b.c_name) AS c_name, round(coalesce(n.c_acctbal, b.c_acctbal), 2) AS c_acctbal, b.c_custkey IS NULL AS late FROM customer b FULL JOIN n ON b.c_custkey = n.c_custkey""")
def history_upsert(spark, d):
    """All customers, changed by all suppliers under other keys."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", F.col("c_custkey").alias("position"))
    new = table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("c_custkey"), F.upper("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"), F.col("s_suppkey").alias("position"))
    out = seq.upsert(c, new, "c_custkey", "position")
    return out.select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"), F.col("place.late").alias("late"))


@query("""WITH b AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, upper(c_name) AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0)
SELECT coalesce(n.c_custkey, b.c_custkey) AS c_custkey, coalesce(n.c_name, b.c_name) AS c_name, round(coalesce(n.c_acctbal, b.c_acctbal), 2) AS c_acctbal, b.c_custkey IS NULL AS late FROM b FULL JOIN n ON b.c_custkey = n.c_custkey""")
def history_upsert_all(spark, d):
    """``history_upsert`` where every customer is in at least one input."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", F.col("c_custkey").alias("position"))
    new = c.filter("c_custkey % 2 = 0 OR c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"), "position")
    out = seq.upsert(c.filter("c_custkey % 3 <> 0"), new, "c_custkey", "position")
    return out.select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"), F.col("place.late").alias("late"))


@query("SELECT c_custkey, c_name, c_custkey = 7 AS appended FROM customer")
def profile_replace(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return seq.replace_to_end(c, c.filter("c_custkey = 7"), "c_custkey")


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS encoded FROM events")
def history_json(spark, d):
    e = table(spark, d, "events").select("event_id", "props", F.col("props").alias("encoded"))
    return src.decoded(e, {"props": "k int"}).select("event_id", F.col("props.k").alias("k"), src.encode_json(F.col("encoded"), "k int").alias("encoded"))


@query("""SELECT p_brand, p_size, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) - 1 AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_retailprice DESC, p_partkey) AS k FROM part WHERE p_type <> 'none') WHERE k = 1""")
def format_best(spark, d):
    parts = table(spark, d, "part").filter(decode.with_video(F.col("p_type")))
    best = seq.best_first(parts, ["p_brand"], ["p_size"], [F.coalesce("p_retailprice", F.lit(0.0)).desc(), F.col("p_partkey")])
    return best.select("p_brand", "p_size", "p_partkey", F.col("rank").cast("long").alias("rank"))


@query("""WITH f AS (SELECT p_size, min(p_partkey) AS p FROM part GROUP BY p_size) SELECT l_orderkey, l_linenumber, p AS p_partkey FROM lineitem LEFT JOIN f ON l_quantity = p_size""")
def profile_match(spark, d):
    left = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("size"))
    right = table(spark, d, "part").select(F.col("p_size").alias("size"), "p_partkey", F.col("p_partkey").alias("position"))
    return seq.first_match(left, right, ["size"], "position").select("l_orderkey", "l_linenumber", "p_partkey")


@query(r"""SELECT p_partkey, CASE WHEN c <> '' THEN c ELSE 'song_' || p_partkey END AS name, printf('%02d - %s.pdf', (p_partkey % 100)::INT, c) AS numbered
FROM (SELECT p_partkey, trim(regexp_replace(p_name || '/é½' || p_type || '. ', '[^\p{L}\p{N} _-]', '_', 'g'), ' .') AS c FROM part)""")
def safe_name(spark, d):
    raw = F.concat("p_name", F.lit("/é½"), "p_type", F.lit(". "))
    name = tx.safe_file_name(raw, F.concat(F.lit("song_"), F.col("p_partkey").cast("string")))
    return table(spark, d, "part").select("p_partkey", name.alias("name"), tx.numbered_name((F.col("p_partkey") % 100).cast("int"), name).alias("numbered"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(u, '^(?i)https?://[^/?#\s]+[^\s]*$') THEN u END AS url FROM (SELECT page_id, CASE WHEN contains(r, '://') THEN r ELSE 'https://' || r END AS u FROM (SELECT page_id, trim(CASE page_id % 3 WHEN 0 THEN replace(url, 'https://', ' ') WHEN 1 THEN replace(url, 'http', 'ftp') ELSE url END) AS r FROM pages))""")
def normalise_url(spark, d):
    raw = F.when(F.col("page_id") % 3 == 0, F.replace("url", F.lit("https://"), F.lit(" "))).when(F.col("page_id") % 3 == 1, F.replace("url", F.lit("http"), F.lit("ftp"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", tx.normalise_url(raw).alias("url"))


_RULES = [("stupid", "private"), ("license", "outdated"), ("the", "unavailable")]


@query("SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(text), '{a}') THEN '{b}'" for a, b in _RULES) + " ELSE 'unknown' END AS kind FROM documents")
def error_kind(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.first_rule(F.col("text"), _RULES, "unknown").alias("kind"))


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS l FROM documents)
SELECT doc_id, left(array_to_string(l[greatest(1, len(l) - 3):], ' / '), 400) AS tail FROM l""")
def stderr_tail(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.tail_lines(F.col("text")).alias("tail"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 4 THEN 'bass' WHEN 6 THEN 'guitar' WHEN 5 THEN 'staff' ELSE l_linenumber || ' lines' END AS label FROM lineitem")
def instrument_label(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tx.instrument(F.col("l_linenumber")).alias("label"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' ELSE o_orderstatus END AS label FROM orders WHERE o_orderstatus IN ('F', 'P')")
def status_gate(spark, d):
    return table(spark, d, "orders").filter(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey", tx.mapped(F.col("o_orderstatus"), {"F": "finished"}, F.col("o_orderstatus")).alias("label"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 12")
def progress_tail(spark, d):
    return seq.last_rows(table(spark, d, "events"), ["user_id"], EVENT, 12).select("user_id", "event_id")


@query("SELECT event_id, coalesce(try_cast(event_type AS DOUBLE), 0.0) AS probed, CASE WHEN value >= 90 THEN 'good' WHEN value >= 60 THEN 'fair' ELSE 'poor' END AS grade, printf('%d:%02d', floor(value * 7)::INT // 60, floor(value * 7)::INT % 60) AS clock FROM events")
def display_values(spark, d):
    return table(spark, d, "events").select("event_id", tx.number_or_zero(F.col("event_type")).alias("probed"), tx.score_grade(F.col("value")).alias("grade"), tx.duration_text(F.col("value") * 7).alias("clock"))


@query("""WITH j AS (SELECT user_id, event_type, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS jump FROM events)
SELECT user_id, count(*) AS n, round(max(jump), 4) AS max_jump, sum((event_type = 'view')::INT)::BIGINT AS unresolved, CASE WHEN count(*) >= 2 THEN max(jump) < 90 AND sum((event_type = 'view')::INT) = 0 END AS ok FROM j GROUP BY 1""")
def overlap_flag(spark, d):
    out = seq.step_check(table(spark, d, "events"), ["user_id"], EVENT, "value", F.col("event_type") == "view", F.lit(90))
    return out.select("user_id", "n", F.round("max_jump", 4).alias("max_jump"), "unresolved", "ok")


@query("""WITH RECURSIVE p AS (SELECT o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS v FROM orders),
n AS (SELECT c, count(*) AS n, count(v) AS r FROM p GROUP BY c),
k AS (SELECT *, row_number() OVER w - 1 AS i, lead(pos) OVER w AS npl, lead(v) OVER w AS nv FROM p WHERE v IS NOT NULL WINDOW w AS (PARTITION BY c ORDER BY pos)),
t AS (SELECT c, greatest(2 * t, t + 4) AS tol FROM (SELECT n.c, coalesce(median((nv - v) / (npl - pos)) FILTER (WHERE nv > v), 1.0) AS t FROM n LEFT JOIN k ON n.c = k.c GROUP BY n.c)),
s AS (SELECT k.c, coalesce(min(i) FILTER (WHERE nv >= v AND nv - v <= tol * (npl - pos)), 0) AS s FROM k JOIN t ON k.c = t.c GROUP BY k.c),
j AS (SELECT k.*, tol FROM k JOIN t ON k.c = t.c),
f AS (SELECT k.c, i, pos, v AS value, 1 AS kept, v AS first, '' AS issues FROM k JOIN s ON k.c = s.c AND i = s
UNION ALL SELECT c, i, CASE WHEN skip THEN pos ELSE kpl END, CASE WHEN skip THEN value ELSE v END, CASE WHEN skip THEN kept ELSE kept + 1 END, first,
CASE WHEN skip OR good THEN issues ELSE issues || kpl || ':' || CASE WHEN v < value THEN 'backwards' ELSE 'gap' END || ':' || value || ':' || v || ';' END
FROM (SELECT *, NOT good AND (coalesce(nv >= value AND nv - value <= tol * greatest(1, npl - pos), false) OR v - value > 20 * tol * greatest(1, kpl - pos)) AS skip
FROM (SELECT f.*, j.i AS ki, j.pos AS kpl, j.v, j.npl, j.nv, j.tol, j.v - value >= 0 AND j.v - value <= j.tol * greatest(1, j.pos - f.pos) AS good FROM f JOIN j ON j.c = f.c AND j.i = f.i + 1)) AS q(c, i0, pos, value, kept, first, issues, i, kpl, v, npl, nv, tol, good, skip))
SELECT n.c AS o_custkey, n.n::INT AS n, r::INT AS n_read, round(tol, 6) AS tolerance, r * 2 >= n.n AS reliable, coalesce(f.first, -1)::INT AS first, coalesce(f.value, -1)::INT AS last, coalesce(kept, 0)::INT AS n_kept, CASE WHEN r * 2 >= n.n THEN coalesce(issues, '') ELSE '' END AS issues
FROM n JOIN t ON n.c = t.c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY c ORDER BY i DESC) AS z FROM f) f ON n.c = f.c AND z = 1""")
def measure_continuity(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).otherwise(F.col("o_orderkey")).cast("int").alias("number"))
    out = folds.continuity(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "number")
    told = F.transform("issues", lambda i: F.concat(i["at"].cast("string"), F.lit(":"), i["kind"], F.lit(":"), i["before"].cast("string"), F.lit(":"), i["after"].cast("string"), F.lit(";")))
    none = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return out.select("o_custkey", "n", "n_read", "tolerance", "reliable", none("first", -1), none("last", -1), none("n_kept", 0), F.array_join(told, "").alias("issues"))


@query()
def segment_merge(spark, d):
    """Segments of the vectors of each label: cuts at outliers, merged neighbours, absorbed short ones."""
    return folds.segments(table(spark, d, "embeddings"), ["label"], ["vec_id"], "embedding", z_limit=1.5, floor=0.0, merge=1.2, near=1, least=5)



_BGR = "(l_partkey * 7 % 256)::INT AS b, (l_suppkey * 13 % 256)::INT AS g, (l_orderkey * 31 % 256)::INT AS r"


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, {_BGR} FROM lineitem), h AS (SELECT *, greatest(b, g, r) AS v, least(b, g, r) AS low FROM p),
s AS (SELECT *, round_even((b * 0.114::DOUBLE + g * 0.587::DOUBLE + r * 0.299::DOUBLE), 0)::INT AS grey, CASE WHEN v > 0 THEN round_even(((v - low) * 255.0::DOUBLE / v), 0)::INT ELSE 0 END AS s FROM h)
SELECT l_orderkey, l_linenumber, grey, s, v, s < 40 AND v > 170 AS paper, grey < 200 AS ink, CASE WHEN grey > 195 THEN 255 ELSE 0 END AS bit, b >= 10 AND b < 200 AND g >= 20 AND g < 220 AS inside, CASE WHEN b >= 10 AND b < 200 AND g >= 20 AND g < 220 THEN 0 ELSE grey END AS masked, b BETWEEN 6 AND 34 AND g BETWEEN 3 AND 40 AS digit,
CASE WHEN r <= 4 THEN 1 ELSE greatest(8, least(120, r // 6)) END::INT AS half FROM s""")
def pixel_planes(spark, d):
    c = lambda name, k: (F.col(name) * k % 256).cast("int")
    px = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c("l_partkey", 7).alias("b"), c("l_suppkey", 13).alias("g"), c("l_orderkey", 31).alias("r"))
    bgr = (F.col("b"), F.col("g"), F.col("r"))
    px = px.select("*", pl.luma(*bgr).alias("grey"), pl.saturation(*bgr).alias("s"), pl.value(*bgr).alias("v"), pl.inside(F.col("b"), F.col("g"), (10, 20, 200, 220)).alias("inside"))
    return px.select(
        "l_orderkey", "l_linenumber", "grey", "s", "v", pl.is_paper(F.col("s"), F.col("v")).alias("paper"), pl.is_ink(F.col("grey")).alias("ink"), pl.binarised(F.col("grey")).alias("bit"),
        "inside", F.when(F.col("inside"), 0).otherwise(F.col("grey")).alias("masked"), pl.is_digit_sized(F.col("b"), F.col("g")).alias("digit"), pl.strip_half(F.col("r")).alias("half"),
    )


@query("""WITH c AS (SELECT l_suppkey, sum((l_partkey % 256 < 128)::INT) AS total, sum((l_partkey % 256 < 128 AND l_linenumber > 1)::INT) AS kept FROM lineitem GROUP BY 1)
SELECT l_suppkey, total::BIGINT AS total, greatest(0, total - kept)::BIGINT AS discarded, CASE WHEN greatest(0, total - kept) > 3000 THEN 'error' WHEN greatest(0, total - kept) > 300 THEN 'warn' ELSE 'ok' END AS flag FROM c""")
def ink_counts(spark, d):
    ink = pl.is_gap_ink(F.col("l_partkey") % 256)
    c = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(ink.cast("int")).alias("total"), F.sum((ink & (F.col("l_linenumber") > 1)).cast("int")).alias("kept"))
    lost = pl.discarded(F.col("total"), F.col("kept"))
    return c.select("l_suppkey", "total", lost.alias("discarded"), pl.ink_flag(lost).alias("flag"))


@query(_WRAP + f""", s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page, event_id FROM e WHERE b IS NULL OR value < b - {_DROP})
SELECT user_id, event_id AS "start", lead(event_id, 1, 999999999) OVER (PARTITION BY user_id ORDER BY page) AS "next" FROM s""")
def page_bounds(spark, d):
    starts = seq.page_wraps(table(spark, d, "events"), ["user_id"], EVENT, "value", F.lit(float(_DROP)))
    return seq.next_start(starts, ["user_id"], EVENT, "event_id", 999999999).select("user_id", F.col("event_id").alias("start"), "next")


@query("""SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN 'asked ' || p_partkey END, CASE WHEN p_partkey % 2 = 0 THEN p_name END, 'Song ' || (p_size + 1)) AS title FROM part""")
def override_precedence(spark, d):
    parts = table(spark, d, "part")
    asked = parts.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("asked "), F.col("p_partkey").cast("string"))).alias("title"))
    stored = parts.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("title"))
    told = seq.precedence(parts.select("p_partkey", "p_size"), "p_partkey", "title", [asked, stored], F.format_string("Song %d", F.col("p_size") + 1))
    return told.select("p_partkey", "title")


@query("""WITH w AS (SELECT s_suppkey AS id, 'n' || s_nationkey AS f, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier),
t AS (SELECT DISTINCT 'n' || n_nationkey AS f, unnest(CASE WHEN n_nationkey % 3 = 0 THEN [1, 2, 4] WHEN n_nationkey % 3 = 1 THEN [2] ELSE [3, 4] END) AS k FROM nation WHERE n_nationkey < 15),
c AS (SELECT f, g AS k, row_number() OVER (PARTITION BY f ORDER BY g) AS r FROM (SELECT DISTINCT f FROM w) x, range(1, (SELECT count(*) FROM supplier) + 9) y(g) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.f = x.f AND t.k = g))
SELECT id, CASE WHEN k = 1 THEN w.f || '.pdf' ELSE w.f || ' (' || k || ').pdf' END AS name FROM w JOIN c ON w.f = c.f AND w.r = c.r""")
def free_file_names(spark, d):
    """Names of suppliers by nation, where files of some nations are taken, with and without numbers."""
    wanted = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.format_string("n%d.pdf", "s_nationkey").alias("name"))
    key = F.col("n_nationkey")
    numbers = F.when(key % 3 == 0, F.array(*map(F.lit, (1, 2, 4)))).when(key % 3 == 1, F.array(F.lit(2))).otherwise(F.array(F.lit(3), F.lit(4)))
    there = table(spark, d, "nation").filter("n_nationkey < 15").select(key, F.explode(numbers).alias("k"))
    name = F.when(F.col("k") == 1, F.format_string("n%d.pdf", key)).otherwise(F.format_string("n%d (%d).pdf", key, "k"))
    return transcribe.free_names(wanted, there.select(name.alias("name")))


@query("""SELECT ordinal, id FROM (SELECT row_number() OVER (ORDER BY song, id) AS ordinal, id FROM (SELECT 0 AS song, s_suppkey AS id FROM supplier UNION ALL SELECT 1, n_nationkey FROM nation))""")
def ordered_concat(spark, d):
    pages = table(spark, d, "supplier").select(F.lit(0).alias("song"), F.col("s_suppkey").alias("id")).unionByName(table(spark, d, "nation").select(F.lit(1).alias("song"), F.col("n_nationkey").cast("long").alias("id")))
    return seq.concat_ordered(pages.withColumn("document", F.lit("d")), ["document"], "song", ["id"]).select("ordinal", "id")


@query("SELECT o_custkey, string_agg(k::VARCHAR, ',' ORDER BY k) AS bounds FROM (SELECT DISTINCT o_custkey, o_orderkey % 7 AS k FROM orders) GROUP BY 1")
def sorted_bounds(spark, d):
    bounds = seq.sorted_bounds(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderkey") % 7)
    return bounds.select("o_custkey", F.array_join(F.transform("bounds", lambda x: x.cast("string")), ",").alias("bounds"))


@query("SELECT c_custkey, length(c_name) BETWEEN 1 AND 200 AND c_custkey > 0 AND c_acctbal IS NOT NULL AND c_mktsegment IN ('BUILDING', 'AUTOMOBILE') AS ok FROM customer")
def profile_checks(spark, d):
    mode = F.when(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"), "paginated").otherwise("other")
    rows = table(spark, d, "customer").select(
        "c_custkey", F.col("c_name").alias("name"), F.col("c_custkey").cast("int").alias("video_width"), F.lit(1).alias("video_height"), F.array(F.lit(0), F.lit(0), F.lit(1), F.lit(1)).alias("region"), mode.alias("mode")
    )
    return rows.select("c_custkey", src.valid_profile().alias("ok"))


#: Queries over drawn frames: what they must find is known by construction.
_N = "(SELECT n_nationkey AS n, 'v' || n_nationkey AS video_id FROM nation)"
DRAWN = {
    "frame_regions": (generated.regions, f"SELECT video_id, (20 + n)::INT AS x0, (16 + n)::INT AS y0, (20 + n + CASE WHEN n % 5 = 0 THEN 820 ELSE 120 END)::INT AS x1, (106 + n)::INT AS y1, 0.8::DOUBLE AS confidence, (4 + n % 3)::INT AS n_lines, n % 5 <> 0 AS low_res_warning FROM {_N}"),
    "frame_cursors": (generated.cursors, f"SELECT video_id, k::INT AS frame_idx, (12 + n + 25 * k)::INT AS x FROM {_N}, range(0, 4) t(k)"),
    "frame_offsets": (generated.offsets, f"SELECT video_id, k::INT AS frame_idx, (k * (6 + n % 5))::INT AS \"offset\", CASE WHEN n % 3 = 1 AND k > 0 THEN 'fallback' ELSE 'match' END AS resolution FROM {_N}, range(0, 6) t(k)"),
    "frame_motions": (generated.motions, f"SELECT video_id, CASE n % 3 WHEN 0 THEN 'scroll_vertical' WHEN 1 THEN 'scroll_horizontal' ELSE 'paginated' END AS mode, CASE WHEN n % 3 = 0 THEN 'y' ELSE 'x' END AS axis, CASE WHEN n % 3 = 1 THEN 6 + n % 5 ELSE 0 END::INT AS med_dx, CASE WHEN n % 3 = 0 THEN 6 + n % 5 ELSE 0 END::INT AS med_dy, CASE WHEN n % 3 = 2 THEN 0 ELSE 5 END::BIGINT AS n_events FROM {_N}"),
    "frame_pages": (generated.pages, f"SELECT video_id, k::INT AS page, CASE k WHEN 2 THEN 3 ELSE 4 END AS contributors, k = 3 AS transition, k IN (1, 2) AS low_confidence, CASE k WHEN 0 THEN 0 WHEN 1 THEN 6 WHEN 2 THEN 10 ELSE 13 END AS start, CASE k WHEN 0 THEN 5 WHEN 1 THEN 9 WHEN 2 THEN 12 ELSE 18 END AS \"end\", CASE k WHEN 0 THEN 8 WHEN 3 THEN 0 ELSE 20 + k END::INT AS top FROM {_N}, range(0, 4) t(k)"),
    "system_blocks": (generated.blocks, f"SELECT n::INT AS n, pos, top::INT AS top, bottom::INT AS bottom FROM (SELECT n, 0 AS pos, 5 AS top, 120 + n // 2 AS bottom FROM {_N} UNION ALL SELECT n, 1, 120 + n // 2, 235 + n FROM {_N})"),
    "scroll_blocks": (generated.scroll_blocks, f"SELECT video_id, pos, height::INT AS height, 100 AS width, CASE WHEN n % 4 = 2 THEN 1 ELSE 0 END AS cuts_on_ink, CASE WHEN n % 4 = 2 THEN 120 ELSE 0 END::BIGINT AS discarded_ink, (100 * height)::INT AS pixels FROM (SELECT n, video_id, 0 AS pos, CASE WHEN n % 2 = 1 THEN 230 + n ELSE 115 + n // 2 END AS height FROM {_N} UNION ALL SELECT n, video_id, 1, CASE WHEN n % 4 = 2 THEN 150 + n ELSE 115 + n - n // 2 END FROM {_N} WHERE n % 2 = 0)"),
    "page_barlines": (generated.barlines, f"SELECT n::INT AS n, pos::INT AS pos, x::INT AS x FROM (SELECT n, 0 AS pos, 31 + n AS x FROM {_N} UNION ALL SELECT n, 1, 131 + 2 * n FROM {_N} UNION ALL SELECT n, 2, 251 + n FROM {_N})"),
    "page_trims": (generated.trims, f"SELECT n::INT AS n, CASE WHEN n % 4 IN (0, 1) THEN 300 ELSE 251 + n END::INT AS width, n % 4 = 1 AS guarded FROM {_N}"),
    "number_boxes": (generated.numbers, f"SELECT n::INT AS n, (5 + n)::INT AS x0, 10 AS y0, (30 + n)::INT AS x1, 32 AS y1 FROM {_N}"),
    "line_staves": (generated.staves, f"SELECT n::INT AS n, pos, top::INT AS top, bottom::INT AS bottom, n_lines FROM (SELECT n, 0 AS pos, 10 AS top, 46 AS bottom, 4 AS n_lines FROM {_N} UNION ALL SELECT n, 1, 130 + n + n % 2, 190 + n + n % 2, 6 FROM {_N})"),
    "sheet_layout": (generated.layout, f"""WITH RECURSIVE h AS (SELECT video_id, ((40 + n) * 4)::INT AS h FROM {_N}), f AS (SELECT video_id, h, 0 AS pos, 0 AS sheet, 0 AS y FROM h UNION ALL
SELECT video_id, h, pos + 1, CASE WHEN y + 2 * h + 30 <= 900 THEN sheet ELSE sheet + 1 END, CASE WHEN y + 2 * h + 30 <= 900 THEN y + h + 30 ELSE 0 END FROM f WHERE pos < 7)
SELECT video_id, pos, h AS height, 2240 AS width, sheet, y FROM f"""),
    "song_segments": (generated.songs, f"SELECT video_id, k::INT AS \"index\", CASE WHEN k = 0 THEN 0 ELSE 30 + n END::INT AS start, CASE WHEN k = 0 THEN 29 + n ELSE 72 + n END::INT AS \"end\" FROM {_N}, range(0, 2) t(k)"),
}
for _name, (_run, _sql) in DRAWN.items():
    QUERIES[_name], ORACLES[_name] = _run, _sql


@query("""SELECT event_id, strftime(make_timestamp(((event_id * 1000.25) * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') AS shown, CASE WHEN value > 0 THEN floor(value * 100000 / 1e6 + 0.5)::BIGINT || ' MB' ELSE 'unknown size' END AS size FROM events""")
def display_times(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", tx.display_time(F.col("event_id") * 1000.25).alias("shown"), tx.size_text(F.col("value") * 100000).alias("size"))


@query("""SELECT l_orderkey, l_linenumber, floor(least(x0, x1) + 0.5)::INT AS x0, floor(least(y0, y1) + 0.5)::INT AS y0, floor(greatest(x0, x1) + 0.5)::INT AS x1, floor(greatest(y0, y1) + 0.5)::INT AS y1
FROM (SELECT l_orderkey, l_linenumber, 10 + CASE WHEN h IN (0, 2, 4) THEN dx ELSE 0 END AS x0, 20 + CASE WHEN h IN (0, 1, 4) THEN dy ELSE 0 END AS y0, 60 + CASE WHEN h IN (1, 3, 4) THEN dx ELSE 0 END AS x1, 50 + CASE WHEN h IN (2, 3, 4) THEN dy ELSE 0 END AS y1
FROM (SELECT l_orderkey, l_linenumber, l_linenumber % 5 AS h, l_quantity * 2.5 AS dx, l_quantity * -0.75 AS dy FROM lineitem))""")
def region_drags(spark, d):
    handle = F.element_at(F.array(*map(F.lit, ("nw", "ne", "sw", "se", "move"))), F.col("l_linenumber") % 5 + 1)
    start = F.struct(F.lit(10).alias("x0"), F.lit(20).alias("y0"), F.lit(60).alias("x1"), F.lit(50).alias("y1"))
    moved = tx.dragged(start, handle, F.col("l_quantity") * 2.5, F.col("l_quantity") * -0.75)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(moved[e].alias(e) for e in ("x0", "y0", "x1", "y1")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 60000)::INT ELSE -1 END AS port, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS token FROM orders""")
def handshake_lines(spark, d):
    """A third of the lines is whole, a third lacks the token, a third lacks the prefix."""
    body = F.to_json(F.struct((F.col("o_orderkey") % 60000).alias("port"), F.when(F.col("o_orderkey") % 3 != 1, F.col("o_orderpriority")).alias("token")))
    line = F.concat(F.when(F.col("o_orderkey") % 3 == 2, "").otherwise("READY "), body)
    found = tx.handshake(line, "READY ")
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(found["port"], F.lit(-1)).alias("port"), found["token"].alias("token"))


@query("""SELECT user_id, event_id, max(round(CASE event_type WHEN 'view' THEN 0.02 + 0.38 * v WHEN 'click' THEN 0.45 ELSE 0.05 + 0.9 * v END, 6)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS pct
FROM (SELECT *, greatest(0.0, least(1.0, value / 100))::DOUBLE AS v FROM events)""")
def progress_bands(spark, d):
    """Share of the whole, which never goes back."""
    from strandloom.streaming import progress

    stage = F.when(F.col("event_type") == "view", "sampling").when(F.col("event_type") == "click", "region").otherwise("compose")
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.struct("ts", "event_id").alias("ts"), progress.overall(stage, F.col("value") / 100).alias("pct"))
    return progress.never_back(e).select(F.col("job_id").alias("user_id"), F.col("ts.event_id").alias("event_id"), "pct")


@query(r"""WITH t AS (SELECT p_partkey, p_size, '. ' || p_name || '/' || p_type || '½.' AS raw, CASE WHEN p_partkey % 4 = 0 THEN ['banner 1', 'banner 2'] ELSE ['banner 1', p_name, p_type] END AS lines FROM part),
c AS (SELECT *, left(trim(regexp_replace(raw, '[^\p{L}\p{N} ._-]', '_', 'g'), ' .'), 80) AS name FROM t)
SELECT p_partkey, name AS folder, try_cast(p_partkey || '' || p_size AS INTEGER) AS digits, CASE WHEN p_partkey % 3 <> 0 THEN 'ab' || p_partkey END AS checksum, 'out_time_us' AS key, p_partkey || '=' || p_size AS value,
CASE WHEN p_partkey % 4 = 0 THEN 'banner 1 / banner 2' ELSE lines[2] || ' / ' || lines[3] END AS tail, p_partkey / 2.0::DOUBLE AS seconds, p_size % 6 IN (0, 1, 2, 3, 4) AS is_video FROM c""")
def text_helpers(spark, d):
    """Folder names, digits, checksum listings, progress lines, tails without banners, frame times and video suffixes."""
    from strandloom.operators import video

    c, key = F.col, F.col("p_partkey").cast("string")
    tool = F.when(c("p_partkey") % 3 != 0, "tool.exe").otherwise("tool.bin")
    listing = F.concat(F.lit("CD"), key, F.lit("  other\n  AB"), key, F.lit("  "), tool, F.lit(" \nEF  third"))
    fields = tx.progress_fields(F.concat(F.lit(" out_time_us="), key, F.lit("="), c("p_size").cast("string"), F.lit(" \n")))
    said = F.when(c("p_partkey") % 4 == 0, F.lit("banner 1\n\nbanner 2\n")).otherwise(F.concat(F.lit("banner 1\n "), c("p_name"), F.lit(" \n\n"), c("p_type")))
    suffix = F.get(F.array(*map(F.lit, ("mp4", "MKV", "webm", "mov", "Avi", "mp3"))), c("p_size") % 6)
    return table(spark, d, "part").select(
        "p_partkey", tx.safe_folder_name(F.concat(F.lit(". "), "p_name", F.lit("/"), "p_type", F.lit("½."))).alias("folder"),
        tx.digits_to_int(F.concat(F.lit("No. "), key, F.lit("x"), c("p_size").cast("string"))).alias("digits"), tx.checksum_of(listing, F.lit("tool.exe")).alias("checksum"),
        fields["key"].alias("key"), fields["value"].alias("value"), tx.tail_lines(said, unwanted="^banner").alias("tail"), video.frame_seconds(c("p_partkey")).alias("seconds"),
        tx.has_video_suffix(F.concat(F.lit("/x.d/"), c("p_name"), F.lit("."), suffix)).alias("is_video"),
    )


_SAID = ["Private Video", "please CONFIRM your age", "Age-Restricted", "age restricted", "Video unavailable", "removed by the uploader", "it does not exist", "Sign in to confirm", "nsig extraction failed", "Unable to extract", "HTTP Error 403", "no player response", "timed out", "private video unavailable"]


@query("""SELECT event_id, CASE WHEN m = 0 OR m = 13 THEN 'private' WHEN m <= 3 THEN 'age_restricted' WHEN m <= 6 THEN 'unavailable' WHEN m <= 11 THEN 'outdated' ELSE 'unknown' END AS kind,
CASE event_type WHEN 'view' THEN 'analysing' WHEN 'click' THEN 'queued' ELSE event_type END AS label FROM (SELECT *, event_id % 14 AS m FROM events)""")
def error_rules(spark, d):
    """Kinds of downloader messages by the library's own rules, and labels of statuses, of which some are unknown."""
    message = F.concat(F.lit("ERROR: "), F.col("event_type"), F.lit(": "), F.get(F.array(*map(F.lit, _SAID)), (F.col("event_id") % 14).cast("int")))
    status = F.when(F.col("event_type") == "view", "analyzing").when(F.col("event_type") == "click", "queued_render").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", tx.first_rule(message, tx.ERROR_RULES, "unknown").alias("kind"), tx.mapped(status, tx.STATUS_LABELS, status).alias("label"))


@query("""WITH f AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n, embedding FROM embeddings),
p AS (SELECT *, sum(CASE WHEN n % 7 = 0 OR (n % 7 = 3 AND label % 2 = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY n) - 1 AS page FROM f),
s AS (SELECT *, count(*) OVER (PARTITION BY label, page) AS size, min(n) OVER (PARTITION BY label, page) AS first FROM p),
x AS (SELECT label, page, size, first, n, i, floor((embedding[i]::DOUBLE + 1) * 100)::INT AS v FROM s, range(3, 63) t(i)),
m AS (SELECT label, page, size, first, i, CASE WHEN size < 5 THEN max(v) ELSE floor(median(v) FILTER (WHERE n > first AND n < first + size - 1)) END::INT AS v FROM x GROUP BY label, page, size, first, i)
SELECT label::VARCHAR AS video_id, page::INT AS page, CASE WHEN size < 5 THEN size ELSE size - 2 END::INT AS contributors, size < 5 AS low_confidence, first::INT AS start, (first + size - 1)::INT AS "end", string_agg(printf('%02X', v), '' ORDER BY i) AS canvas
FROM m GROUP BY label, page, size, first""")
def vector_pages(spark, d):
    """Vectors as images of one row: the frames of a label, cut to pages of 3, 4 and 7, blended by counts that merge."""
    from strandloom.operators import video

    levels = F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 100).cast("int"))
    data = F.unhex(F.array_join(F.transform(levels, lambda v: F.repeat(F.lpad(F.hex(v), 2, "0"), F.lit(3))), ""))
    numbered = seq.number(table(spark, d, "embeddings").select("label", "vec_id", data.alias("data")), ["label"], ["vec_id"], "frame_idx")
    frames = numbered.select(F.col("label").cast("string").alias("video_id"), "frame_idx", F.lit(1).alias("height"), F.lit(64).alias("width"), "data")
    starts = frames.filter((F.col("frame_idx") % 7 == 0) | ((F.col("frame_idx") % 7 == 3) & (F.col("video_id").cast("int") % 2 == 0))).select("video_id", "frame_idx")
    pages = video.compose_pages(video.page_frames(frames, starts), (2, 0, 62, 1))
    return pages.select("video_id", "page", "contributors", "low_confidence", "start", "end", F.hex("canvas").alias("canvas"))


@query("""SELECT user_id::VARCHAR AS job_id, event_id, pct FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k,
round(CASE event_type WHEN 'view' THEN 0.02 + 0.38 * v WHEN 'click' THEN 0.7 ELSE 0.85 END, 6) AS pct FROM (SELECT *, greatest(0.0, least(1.0, value / 100))::DOUBLE AS v FROM events)) WHERE k <= 8""")
def progress_delivery(spark, d):
    """The events table as a stream of progress; of each job the first eight messages of a micro-batch are delivered, newer ones dropped."""
    import uuid

    from strandloom.streaming import progress

    stage = F.when(F.col("event_type") == "view", "sampling").when(F.col("event_type") == "click", "advance").otherwise("songs")
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")  # a pattern, since the table may be one file
    events = stream.select(F.col("user_id").cast("string").alias("job_id"), "event_id", F.struct("ts", "event_id").alias("ts"), progress.overall(stage, F.col("value") / 100).alias("pct"))
    folder = f"{shared_folder(spark)}/progress-{uuid.uuid4().hex}"
    deliver = lambda batch, n: batch.select("job_id", "event_id", "pct").write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    progress.publish(events, deliver, f"{folder}/checkpoint", most=8).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("job_id", "event_id", "pct")

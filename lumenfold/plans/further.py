"""Queries that apply the remaining operators: inspection, ranges, frames of windows, sessions, detection, selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register, table
from ..functions import arrays as V
from ..functions import draws
from ..functions.scalars import round_product
from ..operators import aggregates as A
from ..operators import cleaning as C
from ..operators import dtw, evaluation, models, signal
from ..operators import relational as R
from ..operators import windows as W
from ..streaming import segments as G
from .texts import _CENTRE, _SERIES, _centroids, _series, r4


@register(
    "table_info",
    "SELECT p AS place, c AS \"column\", t AS dtype, n AS non_null, (SELECT count(*) FROM events) AS rows FROM (SELECT count(event_id) AS a, count(ts) AS b, count(user_id) AS d, count(event_type) AS e, count(value) AS v, count(props) AS q FROM events), LATERAL (VALUES (0, 'event_id', 'bigint', a), (1, 'ts', 'timestamp', b), (2, 'user_id', 'bigint', d), (3, 'event_type', 'string', e), (4, 'value', 'double', v), (5, 'props', 'string', q)) AS x(p, c, t, n)",
)
def table_info(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return R.info(e.withColumn("ts", F.col("ts").cast("timestamp")))


@register(
    "interval_join",
    """WITH s AS (SELECT event_id AS purchase_id, user_id AS k, epoch(ts) AS start, epoch(ts) + 3600 * (5 + event_id % 20) AS stop FROM events WHERE event_type = 'purchase')
       SELECT event_id, purchase_id FROM events JOIN s ON user_id = k AND epoch(ts) >= start AND epoch(ts) < stop""",
)
def interval_join(spark, sf_dir):
    """The events in the hours after a purchase of the same user."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("k"), "event_type", F.col("ts").cast("timestamp").cast("double").alias("at"))
    spans = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "k", F.col("at").alias("start"), (F.col("at") + 3600 * (5 + F.col("event_id") % 20)).alias("stop"))
    return R.interval_join(e.drop("event_type"), spans, "at", "start", "stop", 3600.0 * 15, ["k"]).select("event_id", "purchase_id")


@register("insert_positions", "SELECT s_suppkey, (SELECT count(*) FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal < s_acctbal) AS position FROM supplier")
def insert_positions(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n"), F.col("s_acctbal").alias("v"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_acctbal").alias("v"))
    return R.insert_positions(s, c, "v", ["n"]).select("s_suppkey", "position")


@register(
    "window_frames",
    """SELECT o_orderkey, lead(o_orderkey) OVER w AS following, first_value(o_orderkey) OVER w AS earliest, last_value(o_orderkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest,
       count(*) OVER (PARTITION BY o_custkey ORDER BY epoch(o_orderdate) RANGE BETWEEN 2592000 PRECEDING AND CURRENT ROW) AS month_orders FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def window_frames(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    seconds = F.col("o_orderdate").cast("timestamp").cast("long")
    month = Window.partitionBy("o_custkey").orderBy(seconds).rangeBetween(-2592000, 0)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lead("o_orderkey").over(w).alias("following"), F.first("o_orderkey").over(w).alias("earliest"),
        F.last("o_orderkey").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("latest"), F.count("*").over(month).alias("month_orders"),
    )


@register("filtered_aggregates", "SELECT l_shipyear, count(*) FILTER (l_quantity > 25) AS large, round(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 2) AS returned, count(DISTINCT l_suppkey) AS suppliers FROM (SELECT *, year(l_shipdate) AS l_shipyear FROM lineitem) GROUP BY 1")
def filtered_aggregates(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("l_shipyear", F.year("l_shipdate").cast("long"))
    return items.groupBy("l_shipyear").agg(F.count_if(F.col("l_quantity") > 25).alias("large"), F.round(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))), 2).alias("returned"), F.count_distinct("l_suppkey").alias("suppliers"))


@register("approximate_distinct", "SELECT l_returnflag, true AS near FROM lineitem GROUP BY 1")
def approximate_distinct(spark, sf_dir):
    """Whether the sketch's number of orders is within a tenth of the exact one."""
    near = F.abs(F.approx_count_distinct("l_orderkey", 0.02) / F.count_distinct("l_orderkey") - 1) < 0.1
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(near.alias("near"))


@register(
    "session_windows",
    """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL '12 hours' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
       SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s""",
)
def session_windows(spark, sf_dir):
    return G.sessions(table(spark, sf_dir, "events"), "ts", "12 hours", "user_id", "value").withColumn("total", r4(F.col("total")))


@register("sliding_windows", "SELECT event_type, to_timestamp(s) AT TIME ZONE 'UTC' AS start, count(*) AS n FROM (SELECT event_type, unnest([floor(epoch(ts) / 21600) * 21600, floor(epoch(ts) / 21600) * 21600 - 21600]) AS s FROM events) GROUP BY 1, 2")
def sliding_windows(spark, sf_dir):
    e = G.overlapping_windows(table(spark, sf_dir, "events"), "ts", "12 hours", "6 hours", "event_type")
    return e.select("event_type", F.col("w.start").alias("start"), "n")


@register("argmax_error", "SELECT round(100 - 100 * avg(CASE WHEN list_position(v, list_max(v)) - 1 = label THEN 1.0 ELSE 0.0 END), 4) AS error_rate FROM (SELECT embedding[1:10] AS v, label FROM embeddings)")
def argmax_error(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.slice("embedding", 1, 10).alias("v"), "label")
    return A.argmax_error(e, "v", "label").withColumn("error_rate", r4(F.col("error_rate")))


@register(
    "component_ratio",
    "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, ln(sum(o_totalprice) OVER (PARTITION BY o_custkey)) - ln(o_totalprice) <= 2 AS near, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE near OR r <= 3",
)
def component_ratio(spark, sf_dir):
    return evaluation.components_by_ratio(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "o_orderkey", 2.0, 3).select("o_custkey", "o_orderkey")


@register(
    "top_component_score",
    """SELECT vec_id, round(m + ln(list_sum(list_transform(s, lambda v: exp(v - m)))), 4) AS score FROM (SELECT vec_id, s, list_max(s) AS m FROM (SELECT vec_id, list_transform((list_sort(list_transform(generate_series(1, 64), lambda i: {'v': -CAST(e[i] AS DOUBLE), 'i': i})))[1:5], lambda p: CAST(e[65 - p.i] AS DOUBLE)) AS s FROM (SELECT vec_id, embedding AS e FROM embeddings)))""",
)
def top_component_score(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    out = evaluation.top_component_score(e.withColumn("y", F.reverse("x")), "x", "y")
    return out.select("vec_id", r4(F.col("score")).alias("score"))


@register("pitch_cascade", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE abs(c_acctbal - s_acctbal) <= 50")
def pitch_cascade(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    pairs = c.join(s, c.c_nationkey == s.s_nationkey)
    return evaluation.cascade(pairs, "c_acctbal", "s_acctbal", 50.0).select("c_custkey", "s_suppkey")


_SCORES = 'SELECT l_suppkey AS "row", l_partkey % 20 AS col, round(sum(l_quantity), 2) AS score FROM lineitem GROUP BY 1, 2'


@register("confused_users", f'SELECT "row", own, other FROM (SELECT "row", max(CASE WHEN "row" = col THEN score END) AS own, max(CASE WHEN "row" <> col THEN score END) AS other FROM ({_SCORES}) GROUP BY 1) WHERE own <= other')
def confused_users(spark, sf_dir):
    return evaluation.confused_users(_scores(spark, sf_dir))


def _scores(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy(F.col("l_suppkey").alias("row"), (F.col("l_partkey") % 20).alias("col")).agg(F.round(F.sum("l_quantity"), 2).alias("score"))


@register(
    "update_imposters",
    f"""WITH s AS ({_SCORES}), n AS (SELECT o_custkey % 20 AS "row", (o_custkey + 1) % 20 AS col, CAST(count(*) AS DOUBLE) AS score FROM orders GROUP BY 1, 2),
        k AS (SELECT * FROM s WHERE "row" NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 = 0) AND col NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 = 0) AND NOT EXISTS (SELECT 1 FROM n WHERE n."row" = s."row" AND n.col = s.col)),
        a AS (SELECT * FROM k UNION ALL SELECT * FROM n)
        SELECT "row", col, score, "row" <> col AND row_number() OVER (PARTITION BY "row", "row" = col ORDER BY score DESC, col) <= 10 AS chosen FROM a""",
)
def update_imposters(spark, sf_dir):
    new = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 20).alias("row"), ((F.col("o_custkey") + 1) % 20).alias("col")).agg(F.count("*").cast("double").alias("score"))
    gone = table(spark, sf_dir, "supplier").filter("s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("user"))
    return evaluation.update_imposters(_scores(spark, sf_dir), new, gone)


@register("select_rows", "SELECT c_custkey, round(c_acctbal / sum(c_acctbal) OVER (), 9) AS c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def select_rows(spark, sf_dir):
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    out = R.select_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey", big, invert=True, weight="c_acctbal")
    return out.withColumn("c_acctbal", F.round("c_acctbal", 9))


@register("prefix_join", "SELECT page_id, conv_id FROM pages JOIN (SELECT DISTINCT conv_id FROM conversations) ON split_part(concat(page_id, '-p'), '-', 1) = split_part(concat(conv_id, '-c'), '-', 1)")
def prefix_join(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.concat("page_id", F.lit("-p")).alias("a"))
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("b", F.concat("conv_id", F.lit("-c")))
    return R.prefix_join(p, c, "a", "b").select("page_id", "conv_id")


@register("starts_with_join", "SELECT o_orderkey, s_suppkey FROM orders JOIN supplier ON starts_with(CAST(o_orderkey AS VARCHAR), CAST(s_suppkey AS VARCHAR))")
def starts_with_join(spark, sf_dir):
    """Order numbers that begin with the digits of a supplier's number."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("a"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("b"))
    return R.starts_with_join(o, s, "a", "b").select("o_orderkey", "s_suppkey")


@register("first_and_last_value", "SELECT user_id, round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 4) AS change, date_diff('second', min(ts), max(ts)) AS seconds, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def first_and_last_value(spark, sf_dir):
    at = F.struct("ts", "event_id")
    e = table(spark, sf_dir, "events").filter("value is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id").agg(r4(F.max_by("value", at) - F.min_by("value", at)).alias("change"), (F.max("ts").cast("long") - F.min("ts").cast("long")).alias("seconds"), F.count("*").alias("n"))


@register("normalise_signal", f"SELECT user_id, list_transform(c, lambda v: round(greatest(least(CASE WHEN p < 500 THEN v * 256 ELSE v END, 32767.0), -32768.0), 8)) AS y FROM (SELECT user_id, c, list_sum(list_transform(c, lambda v: v * v)) / len(c) AS p FROM (SELECT user_id, list_transform(x, lambda v: v - list_sum(x) / len(x)) AS c FROM {_SERIES}))")
def normalise_signal(spark, sf_dir):
    return _series(spark, sf_dir).select("user_id", F.transform(C.normalise_signal(F.col("x"), low_power=500.0), lambda v: round_product(v, 8)).alias("y"))


@register("manhattan_of_units", "SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.u, b.u), lambda p: abs(p[1] - p[2]))), 4) AS manhattan FROM (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda w: CAST(w AS DOUBLE) * w)))) AS u FROM embeddings) a JOIN (SELECT label, list_transform(e, lambda v: v / sqrt(list_sum(list_transform(e, lambda w: w * w)))) AS u FROM (SELECT label, list_transform(arg_min(embedding, vec_id), lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings GROUP BY 1)) b USING (label)")
def manhattan_of_units(spark, sf_dir):
    """Distance of each vector to its label's first one."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    first = e.groupBy("label").agg(F.min_by("x", "vec_id").alias("y"))
    return e.join(R.small_side(first), "label").select("vec_id", r4(V.unit_manhattan(F.col("x"), F.col("y"))).alias("manhattan"))


@register("rolling_extremes", "SELECT event_id, CASE WHEN count(value) OVER w >= 5 THEN round(max(value) OVER w, 4) END AS high, CASE WHEN count(value) OVER w >= 5 THEN round(min(value) OVER w, 4) END AS low FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def rolling_extremes(spark, sf_dir):
    by, within = ["ts", "event_id"], ["user_id"]
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", r4(W.rolling(v, 5, by, within, "max")).alias("high"), r4(W.rolling(v, 5, by, within, "min")).alias("low"))


@register(
    "adapted_means",
    _CENTRE
    + """, k AS (SELECT label AS name, mean, var, n / CAST((SELECT count(*) FROM embeddings) AS DOUBLE) AS w FROM c),
       p AS (SELECT vec_id, embedding, name, mean, ln(w) - 0.5 * list_sum(list_transform(var, lambda v: ln(v) + ln(2 * pi()))) - 0.5 * list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), mean, var), lambda z: (z[1] - z[2]) * (z[1] - z[2]) / z[3])) AS l FROM embeddings, k),
       m AS (SELECT *, l - max(l) OVER (PARTITION BY vec_id) AS d FROM p), r AS (SELECT *, exp(d) / sum(exp(d)) OVER (PARTITION BY vec_id) AS r FROM m),
       u AS (SELECT name, r, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(mean) AS a, generate_subscripts(mean, 1) AS i FROM r)
       SELECT name AS label, CAST(i - 1 AS INTEGER) AS i, round((sum(r * v) + 16 * any_value(a)) / (sum(r) + 16), 4) AS mean FROM u GROUP BY name, i""",
)
def adapted_means(spark, sf_dir):
    """The labels' mixture adapted to all vectors: one round."""
    g = _centroids(spark, sf_dir).orderBy("label").collect()  # one row a class
    start = models.gmm_table(spark, "labels", [r["weight"] for r in g], [r["mean"] for r in g], [r["var"] for r in g])
    names = spark.createDataFrame([(i, r["label"]) for i, r in enumerate(g)], f"comp int, label {dict(table(spark, sf_dir, 'embeddings').dtypes)['label']}")
    e = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("features"))
    out = models.adapt(e, start, rounds=1).join(F.broadcast(names), "comp")
    return out.select("label", F.posexplode("mean").alias("i", "mean")).withColumn("mean", r4(F.col("mean")))


@register(
    "deemphasised",
    """WITH u AS (SELECT user_id, list(value ORDER BY ts, event_id) AS x, list(event_id ORDER BY ts, event_id) AS ids FROM events WHERE value IS NOT NULL GROUP BY 1)
       SELECT ids[i] AS event_id, round(list_sum(list_transform(generate_series(greatest(1, i - 1000), i), lambda j: x[j] * pow(0.97, i - j))), 6) AS y FROM u, LATERAL (SELECT unnest(generate_series(1, len(x))) AS i)""",
)
def deemphasised(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("value is not null").select("event_id", "user_id", "ts", "value")
    return signal.deemphasised(e, ["user_id"], ["ts", "event_id"], "value", "y").select("event_id", F.round("y", 6).alias("y"))


_DRAW = "CAST('0x' || substr(md5(c_custkey || '|{0}'), 1, 13) AS BIGINT) / 4503599627370496.0"


@register(
    "seeded_draws",
    f"""WITH u AS (SELECT c_custkey, {_DRAW.format(1)} AS a, {_DRAW.format(4)} AS b, {_DRAW.format(5)} AS c, {_DRAW.format(3)} AS d, {_DRAW.format(7)} AS e FROM customer)
        SELECT c_custkey, round(a, 9) AS share, round(10 + 2 * sqrt(-2 * ln(1 - b)) * cos(2 * pi() * c), 6) AS height, CAST(1 + floor(d * 6) AS BIGINT) AS die,
        CASE WHEN e < 0.5 THEN 'red' WHEN e < 0.75 THEN 'green' ELSE 'blue' END AS colour FROM u""",
)
def seeded_draws(spark, sf_dir):
    """Random columns of each customer that stay the same in every run."""
    k = ["c_custkey"]
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.round(draws.uniform(k, 1), 9).alias("share"), F.round(draws.normal(k, 2, 10, 2), 6).alias("height"), draws.integers(k, 3, 1, 7).alias("die"), draws.choice(k, 7, ["red", "green", "blue"], [2, 1, 1]).alias("colour")
    )


@register("mixture_of_vectors")
def mixture_of_vectors(spark, sf_dir):
    """A mixture of ten components fitted to all vectors."""
    return models.gmm_fit(table(spark, sf_dir, "embeddings"), "embedding", 10, rounds=5)


@register("kernel_clusters")
def kernel_clusters(spark, sf_dir):
    return models.kernel_kmeans(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 10, "vec_id", gamma=0.5).select("vec_id", "cluster")


@register("vector_codebooks")
def vector_codebooks(spark, sf_dir):
    """Each label's vectors against the codebooks of all labels."""
    e = table(spark, sf_dir, "embeddings")
    return models.nearest_codebook(e.withColumnRenamed("label", "spoken"), "spoken", "embedding", models.codebooks(e, "label", "embedding", 4))


def _waves(spark, sf_dir):
    """Each user's series, held for 64 samples a value, as an utterance."""
    return _series(spark, sf_dir).select("user_id", F.flatten(F.transform("x", lambda v: F.array_repeat(v * 100, 64))).alias("samples"))


@register("denoised_series")
def denoised_series(spark, sf_dir):
    return signal.spectral_subtraction(_waves(spark, sf_dir), "user_id", "samples")


@register("speech_frames")
def speech_frames(spark, sf_dir):
    return signal.speech_by_energy(signal.frame_rows(_waves(spark, sf_dir), "user_id", "samples"), "user_id")


@register("band_features")
def band_features(spark, sf_dir):
    return signal.sub_band(_waves(spark, sf_dir), "user_id", "samples")


def _months(spark, sf_dir):
    """Each month of an event type as a word: a frame of mean and deviation for each of its days."""
    e = table(spark, sf_dir, "events").filter("value is not null").withColumn("id", F.date_format(F.col("ts").cast("timestamp"), "yyyyMM"))
    days = e.groupBy("event_type", "id", F.dayofmonth(F.col("ts").cast("timestamp")).alias("day")).agg(F.array(F.avg("value"), F.stddev_pop("value")).alias("f"))
    return days.groupBy("event_type", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "f"))), lambda s: s["f"]).alias("frames"))


@register("fused_templates")
def fused_templates(spark, sf_dir):
    """One template for each event type from the series of its months."""
    return dtw.fuse_by_key(_months(spark, sf_dir), "event_type")


@register("template_sweep")
def template_sweep(spark, sf_dir):
    """All months against the templates of all event types: errors of each template at each threshold."""
    months = _months(spark, sf_dir)
    templates = dtw.fuse_by_key(months, "event_type").select(F.col("event_type").alias("id"), "frames")
    words = months.select(F.struct("event_type", "id").alias("id"), "frames")
    scores = dtw.dtw_pairs(dtw.all_pairs(templates, words)).select(F.col("id_y").alias("template"), F.col("id_x.event_type").alias("spoken"), "score")
    return evaluation.threshold_sweep(scores, "template", "spoken", "score", [i / 200 for i in range(1, 13)])


@register(
    "value_sweep",
    """SELECT event_type, threshold, count(*) FILTER (value <= threshold AND late) AS tp, count(*) FILTER (value > threshold AND NOT late) AS tn, count(*) FILTER (value <= threshold AND NOT late) AS fp,
       count(*) FILTER (value > threshold AND late) AS fn, round(count(*) FILTER (value <= threshold AND NOT late) / count(*) FILTER (NOT late), 6) AS far, round(count(*) FILTER (value > threshold AND late) / count(*) FILTER (late), 6) AS frr
       FROM (SELECT event_type, value, event_id % 3 = 0 AS late FROM events WHERE value IS NOT NULL), (VALUES (10.0), (25.0), (50.0), (100.0)) AS t(threshold) GROUP BY 1, 2""",
)
def value_sweep(spark, sf_dir):
    """The counts of a detector over thresholds: each third event is to be found by a small value."""
    e = table(spark, sf_dir, "events").filter("value is not null")
    e = e.select("event_type", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("spoken"), "value")
    out = evaluation.threshold_sweep(e, "event_type", "spoken", "value", [10, 25, 50, 100])
    return out.withColumn("far", F.round("far", 6)).withColumn("frr", F.round("frr", 6))

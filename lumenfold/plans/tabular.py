"""Queries over the relational tables: projection, joins, aggregation, windows, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register, table
from ..functions import scalars as S
from ..functions.semantics import nan_to_null
from ..operators import aggregates as A
from ..operators import cleaning as C
from ..operators import relational as R
from ..operators import windows as W

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def r4(x):
    return F.round(x.cast("double"), 4)


@register(
    "top_brands_revenue",
    """SELECT p_brand, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey
       GROUP BY p_brand ORDER BY revenue DESC, p_brand LIMIT 10""",
)
def top_brands_revenue(spark, sf_dir):
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    joined = items.join(parts, items.l_partkey == parts.p_partkey)
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return joined.groupBy("p_brand").agg(revenue.alias("revenue")).orderBy(F.desc("revenue"), "p_brand").limit(10)


@register("project_positions", "SELECT c_name, c_acctbal, c_custkey + 1 AS next_key FROM customer")
def project_positions(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return R.take_positions(c.withColumn("next_key", F.col("c_custkey") + 1), [1, 3, 5])


@register("drop_positions", "SELECT o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def drop_positions(spark, sf_dir):
    return R.drop_positions(table(spark, sf_dir, "orders"), [0, 4])


@register(
    "cast_with_fallback",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS as_number, CAST(floor(value) AS BIGINT) AS as_long, CAST(event_id AS VARCHAR) AS as_text
       FROM events""",
)
def cast_with_fallback(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("as_number"), F.floor("value").cast("bigint").alias("as_long"), F.col("event_id").cast("string").alias("as_text"))


@register("rows_in_order", "SELECT s_suppkey, row_number() OVER (ORDER BY s_name) - 1 AS position FROM supplier")
def rows_in_order(spark, sf_dir):
    return R.numbered(table(spark, sf_dir, "supplier"), ["s_name"]).select("s_suppkey", "position")


@register("rename_and_recode", "SELECT l_orderkey AS order_key, l_linenumber, CASE l_returnflag WHEN 'N' THEN 'none' WHEN 'A' THEN 'none' ELSE l_returnflag END AS flag FROM lineitem")
def rename_and_recode(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "order_key")
    return items.select("order_key", "l_linenumber", S.recode(F.col("l_returnflag"), {"N": "none", "A": "none"}).alias("flag"))


@register("filter_conjunction", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity <= 5 AND l_discount <= 0.02 AND l_returnflag IN ('A', 'R')")
def filter_conjunction(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return items.filter(R.all_of([F.col("l_quantity") <= 5, F.col("l_discount") <= 0.02, F.col("l_returnflag").isin("A", "R")])).select("l_orderkey", "l_linenumber", "l_quantity")


@register(
    "coherence_violations",
    """SELECT o_orderkey, round(o_totalprice, 2) AS total, round(sum(l_extendedprice), 2) AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey
       GROUP BY o_orderkey, o_totalprice HAVING o_totalprice < sum(l_extendedprice) - 0.02""",
)
def coherence_violations(spark, sf_dir):
    o, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    sums = items.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"))
    both = o.join(sums, o.o_orderkey == sums.l_orderkey).filter(F.col("o_totalprice") < F.col("s") - 0.02)
    return both.select("o_orderkey", F.round("o_totalprice", 2).alias("total"), F.round("s", 2).alias("parts"))


@register("any_all_rows", "SELECT l_orderkey, l_linenumber, (l_tax > 0.07 OR l_discount > 0.09) AS any_high, (l_tax > 0.05 AND l_discount > 0.05) AS all_high FROM lineitem")
def any_all_rows(spark, sf_dir):
    tests = lambda a, b: [F.col("l_tax") > a, F.col("l_discount") > b]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", R.any_of(tests(0.07, 0.09)).alias("any_high"), R.all_of(tests(0.05, 0.05)).alias("all_high"))


@register(
    "case_chain",
    "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class, p_size IS NULL AS unknown FROM part",
)
def case_chain(spark, sf_dir):
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large")
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("size_class"), F.col("p_size").isNull().alias("unknown"))


@register("reverse_order", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC")
def reverse_order(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").orderBy(F.desc("o_orderkey"))


def _keyed(spark, sf_dir):
    """Orders and customers with a customer key that is missing for some, to show how missing keys meet."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 500 != 0, F.col("o_custkey")).alias("k"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 50 != 0, F.col("c_custkey")).alias("k"))
    return o, c


_SIDES = """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 500 <> 0 THEN o_custkey END AS k FROM orders),
            c AS (SELECT c_custkey, CASE WHEN c_custkey % 50 <> 0 THEN c_custkey END AS k FROM customer) """


def _join(how, sql):
    @register(f"join_{how}_null_safe", _SIDES + f"SELECT o_orderkey, c_custkey, coalesce(o.k, c.k) AS k FROM o {sql} JOIN c ON o.k IS NOT DISTINCT FROM c.k")
    def query(spark, sf_dir):
        o, c = _keyed(spark, sf_dir)
        return R.null_safe_join(o, c, [("k", "k")], how).select("o_orderkey", "c_custkey", "k")

    return query


for _how, _sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):
    _join(_how, _sql)


@register("join_inner_names", "SELECT n_name, r_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_inner_names(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name", "s_name")


@register("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def join_anti(spark, sf_dir):
    done = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return R.not_in(table(spark, sf_dir, "customer").select("c_custkey"), done, "c_custkey")


@register("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_semi(spark, sf_dir):
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@register("lookup_join", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def lookup_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return R.lookup(table(spark, sf_dir, "customer"), n, "c_nationkey").select("c_custkey", "n_name")


@register(
    "prefix_match",
    "SELECT DISTINCT o_orderpriority, l_shipyear FROM orders JOIN (SELECT l_orderkey, year(l_shipdate) AS l_shipyear FROM lineitem) ON o_orderkey = l_orderkey WHERE substr(o_orderpriority, 1, 1) = substr(CAST(l_shipyear % 10 AS VARCHAR), 1, 1)",
)
def prefix_match(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.year("l_shipdate").cast("long").alias("l_shipyear"))
    same = F.substring("o_orderpriority", 1, 1) == F.substring((F.col("l_shipyear") % 10).cast("string"), 1, 1)
    return o.join(items, "o_orderkey").filter(same).select("o_orderpriority", "l_shipyear").distinct()


@register(
    "asof_last_order",
    """SELECT e.event_id, max(o.o_orderdate) AS last_order FROM events e JOIN orders o ON e.user_id = o.o_custkey AND o.o_orderdate <= e.ts GROUP BY e.event_id""",
)
def asof_last_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("k"), "ts")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("ts"))
    # One union sorted by key and time; the last order so far is a running maximum, so no row meets more than its key's rows.
    both = e.withColumn("d", F.lit(None).cast("timestamp")).unionByName(o.withColumn("event_id", F.lit(None).cast("long")).withColumn("d", F.col("ts")))
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    return both.withColumn("last_order", F.max("d").over(w)).filter("event_id is not null and last_order is not null").select("event_id", "last_order")


@register("orders_year_priority_unstack", "SELECT year(o_orderdate) AS year, " + ", ".join(f"round(sum(CASE WHEN o_orderpriority = '{p}' THEN o_totalprice END), 2) AS \"{p}\"" for p in PRIORITIES) + " FROM orders GROUP BY 1")
def orders_year_priority_unstack(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate").cast("long"))
    out = R.pivot_sum(o, "year", "o_orderpriority", PRIORITIES, "o_totalprice")
    return out.select("year", *[F.round(f"`{p}`", 2).alias(p) for p in PRIORITIES])


@register("segment_pivot_mean", "SELECT c_nationkey, " + ", ".join(f"round(coalesce(avg(CASE WHEN c_mktsegment = '{s}' THEN c_acctbal END), 0), 4) AS \"{s}\"" for s in SEGMENTS) + " FROM customer GROUP BY 1")
def segment_pivot_mean(spark, sf_dir):
    out = R.pivot_sum(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", SEGMENTS, "c_acctbal", "avg", 0.0)
    return out.select("c_nationkey", *[F.round(s, 4).alias(s) for s in SEGMENTS])


@register("segment_pivot_count", "SELECT c_nationkey, " + ", ".join(f"count(CASE WHEN c_mktsegment = '{s}' THEN 1 END) AS \"{s}\"" for s in SEGMENTS) + " FROM customer GROUP BY 1")
def segment_pivot_count(spark, sf_dir):
    return R.pivot_sum(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", SEGMENTS, "c_custkey", "count", 0)


@register("unpivot_charges", "SELECT l_orderkey, l_linenumber, 'l_tax' AS name, l_tax AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem")
def unpivot_charges(spark, sf_dir):
    return R.unpivot(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_tax", "l_discount"])


@register("segment_value_counts", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def segment_value_counts(spark, sf_dir):
    return A.value_counts(table(spark, sf_dir, "customer"), "c_mktsegment")


@register("segment_frequency", "SELECT c_mktsegment, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM customer) AS DOUBLE), 4) AS share FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def segment_frequency(spark, sf_dir):
    return A.relative_frequency(table(spark, sf_dir, "customer"), "c_mktsegment").withColumn("share", r4(F.col("share")))


@register("brands_most_common", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10")
def brands_most_common(spark, sf_dir):
    return A.most_common(table(spark, sf_dir, "part"), "p_brand", 10)


@register("distinct_types", "SELECT DISTINCT p_type FROM part")
def distinct_types(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_type").distinct()


@register("chunked_value_counts", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def chunked_value_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return A.chunked_counts([e.filter(F.col("event_id") % 3 == i) for i in range(3)], "event_type")


@register(
    "describe_lineitem",
    """SELECT count(l_extendedprice) AS "count", round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS "min",
       round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75,
       round(quantile_cont(l_extendedprice, 0.997), 4) AS p99_7, max(l_extendedprice) AS "max" FROM lineitem""",
)
def describe_lineitem(spark, sf_dir):
    out = A.describe(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return out.select(*[F.col(c) if c in ("count", "min", "max") else r4(F.col(c)).alias(c) for c in out.columns])


@register("describe_text", "SELECT CAST(sum(n) AS BIGINT) AS \"count\", count(*) AS \"unique\", arg_min(p_type, (-n, p_type)) AS top, max(n) AS freq FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1)")
def describe_text(spark, sf_dir):
    return A.describe_text(table(spark, sf_dir, "part"), "p_type")


@register("quantity_moments", "SELECT l_returnflag, round(skewness(l_quantity), 4) AS skew, round(kurtosis(l_quantity), 4) AS kurt FROM lineitem GROUP BY 1")
def quantity_moments(spark, sf_dir):
    return A.moments(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"]).select("l_returnflag", r4(F.col("skew")).alias("skew"), r4(F.col("kurt")).alias("kurt"))


@register("skew_kurt_acctbal", "SELECT round(skewness(c_acctbal), 4) AS skew, round(kurtosis(c_acctbal), 4) AS kurt FROM customer")
def skew_kurt_acctbal(spark, sf_dir):
    return A.moments(table(spark, sf_dir, "customer"), "c_acctbal").select(r4(F.col("skew")).alias("skew"), r4(F.col("kurt")).alias("kurt"))


@register("population_spread", "SELECT l_linestatus, round(stddev_pop(l_tax), 6) AS std, round(var_pop(l_tax), 6) AS var, round(max(l_tax) - min(l_tax), 6) AS ptp FROM lineitem GROUP BY 1")
def population_spread(spark, sf_dir):
    x = F.col("l_tax")
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.round(F.stddev_pop(x), 6).alias("std"), F.round(F.var_pop(x), 6).alias("var"), F.round(F.max(x) - F.min(x), 6).alias("ptp"))


@register(
    "mean_median_mode",
    """WITH m AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL)
       SELECT p_brand, round(avg(p_size), 4) AS mean, CAST(median(p_size) AS DOUBLE) AS median, (SELECT arg_min(m.p_size, (-n, m.p_size)) FROM m WHERE m.p_brand = part.p_brand) AS mode FROM part GROUP BY p_brand""",
)
def mean_median_mode(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    stats = p.groupBy("p_brand").agg(F.round(F.avg("p_size"), 4).alias("mean"), F.median("p_size").alias("median"))
    return stats.join(A.mode(p, "p_size", ["p_brand"]), "p_brand")


_HOLES = "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type FROM events"


def _holes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"))


@register("missing_ratio", f"WITH h AS ({_HOLES}) SELECT 'value' AS \"column\", round(avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END), 4) AS ratio FROM h UNION ALL SELECT 'event_type', round(avg(CASE WHEN event_type IS NULL THEN 1 ELSE 0 END), 4) FROM h")
def missing_ratio(spark, sf_dir):
    return A.missing_ratio(nan_to_null(_holes(spark, sf_dir)), ["value", "event_type"]).withColumn("ratio", r4(F.col("ratio")))


@register("drop_missing", f"SELECT event_id FROM ({_HOLES}) WHERE value IS NOT NULL AND event_type IS NOT NULL")
def drop_missing(spark, sf_dir):
    return C.drop_missing(_holes(spark, sf_dir)).select("event_id")


@register("fill_constant", f"SELECT event_id, coalesce(value, -1.0) AS value, coalesce(event_type, 'none') AS event_type FROM ({_HOLES})")
def fill_constant(spark, sf_dir):
    return _holes(spark, sf_dir).fillna({"value": -1.0, "event_type": "none"})


@register(
    "fill_mean_median_mode",
    f"""WITH h AS ({_HOLES}), s AS (SELECT avg(value) AS a, median(value) AS m FROM h),
        t AS (SELECT event_type FROM h WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)
        SELECT event_id, round(coalesce(value, (SELECT a FROM s)), 4) AS by_mean, round(coalesce(value, (SELECT m FROM s)), 4) AS by_median, coalesce(event_type, (SELECT event_type FROM t)) AS by_mode FROM h""",
)
def fill_mean_median_mode(spark, sf_dir):
    h = _holes(spark, sf_dir)
    out = h.withColumns({"by_mean": F.col("value"), "by_median": F.col("value"), "by_mode": F.col("event_type")})
    out = C.fill_with(C.fill_with(C.fill_with(out, "mean", ["by_mean"]), "median", ["by_median"]), "mode", ["by_mode"])
    return out.select("event_id", r4(F.col("by_mean")).alias("by_mean"), r4(F.col("by_median")).alias("by_median"), "by_mode")


_Z = "SELECT event_id, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS z FROM events"


@register("outlier_filter", f"SELECT event_id, round(z, 4) AS z FROM ({_Z}) WHERE abs(z) > 2")
def outlier_filter(spark, sf_dir):
    z = C.scale(table(spark, sf_dir, "events").select("event_id", F.col("value").alias("z")), ["z"], "zscore")
    return C.outlier_rows(z, ["z"], 2.0).withColumn("z", r4(F.col("z")))


@register("outlier_cap", f"SELECT event_id, round(CASE WHEN abs(z) > 2 THEN sign(z) * 2 ELSE z END, 4) AS z FROM ({_Z})")
def outlier_cap(spark, sf_dir):
    z = C.scale(table(spark, sf_dir, "events").select("event_id", F.col("value").alias("z")), ["z"], "zscore")
    return C.cap_outliers(z, ["z"], 2.0).withColumn("z", r4(F.col("z")))


@register("minmax_scale", "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 4) AS c_acctbal FROM customer")
def minmax_scale(spark, sf_dir):
    return C.scale(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], "minmax").withColumn("c_acctbal", r4(F.col("c_acctbal")))


@register("zscore_scale", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 4) AS c_acctbal FROM customer")
def zscore_scale(spark, sf_dir):
    return C.scale(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], "zscore").withColumn("c_acctbal", r4(F.col("c_acctbal")))


@register(
    "elementwise_transforms",
    "SELECT p_partkey, round(ln(1 + p_size), 4) AS log1p, round(sqrt(p_size), 4) AS root, round(cbrt(p_size), 4) AS cube_root, CAST(p_size * p_size AS DOUBLE) AS square, CAST(power(p_size, 3) AS DOUBLE) AS cube FROM part",
)
def elementwise_transforms(spark, sf_dir):
    x = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", r4(F.log1p(x)).alias("log1p"), r4(F.sqrt(x)).alias("root"), r4(C.cube_root(x)).alias("cube_root"), F.pow(x, F.lit(2)).alias("square"), F.pow(x, F.lit(3)).alias("cube"))


@register("one_hot_segment", "SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{s}' AS INTEGER) AS \"c_mktsegment_{s}\"" for s in SEGMENTS) + " FROM customer")
def one_hot_segment(spark, sf_dir):
    return C.one_hot(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", SEGMENTS).drop("c_mktsegment")


@register("cut_size_bins", "SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 10 THEN 'small' WHEN p_size > 10 AND p_size <= 25 THEN 'medium' WHEN p_size > 25 AND p_size <= 40 THEN 'large' END AS label, CASE WHEN p_size >= 0 AND p_size < 10 THEN 0 WHEN p_size >= 10 AND p_size < 25 THEN 1 WHEN p_size >= 25 AND p_size < 40 THEN 2 ELSE -1 END AS code FROM part")
def cut_size_bins(spark, sf_dir):
    x, edges = F.col("p_size"), [0, 10, 25, 40]
    return table(spark, sf_dir, "part").select("p_partkey", C.cut(x, edges, ["small", "medium", "large"]).alias("label"), C.cut_code(x, edges, right=False).alias("code"))


@register("cut_equal_width", "SELECT c_custkey, CAST(greatest(ceil((c_acctbal - lo) / (hi - lo) * 4) - 1, 0) AS INTEGER) AS bin FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)")
def cut_equal_width(spark, sf_dir):
    return C.cut_equal(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 4).select("c_custkey", "bin")


@register("qcut_quartiles", "SELECT c_custkey, CAST(c_acctbal > a AS INTEGER) + CAST(c_acctbal > b AS INTEGER) + CAST(c_acctbal > c AS INTEGER) AS bin FROM customer, (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS b, quantile_cont(c_acctbal, 0.75) AS c FROM customer)")
def qcut_quartiles(spark, sf_dir):
    return C.quantile_cut(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", [0, 0.25, 0.5, 0.75, 1]).select("c_custkey", "bin")


@register("every_tenth_row", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE p % 10 = 0")
def every_tenth_row(spark, sf_dir):
    return C.every_nth(table(spark, sf_dir, "orders").select("o_orderkey"), 10, ["o_orderkey"])


@register("simple_sample", "SELECT event_id, event_type FROM events ORDER BY md5(concat_ws('|', event_id, '3')), event_id LIMIT 100")
def simple_sample(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return C.simple_sample(e, 100, ["event_id"], seed=3)


@register("stratified_sample", "SELECT doc_id, quality, toxic FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5(concat_ws('|', doc_id, '5')), doc_id) AS i, count(*) OVER (PARTITION BY toxic) AS n FROM labels) WHERE i <= floor(n * CASE toxic WHEN 0 THEN 0.5 WHEN 1 THEN 0.1 ELSE 0 END)")
def stratified_sample(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return C.stratified_sample(labels, "toxic", {0: 0.5, 1: 0.1}, ["doc_id"], seed=5)


@register(
    "stratified_draws",
    """WITH l AS (SELECT doc_id, quality, toxic, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) - 1 AS place FROM labels),
       n AS (SELECT toxic, count(*) AS n, CAST(floor(count(*) * CASE toxic WHEN 0 THEN 0.1 ELSE 1.5 END) AS BIGINT) AS wanted FROM labels WHERE toxic IS NOT NULL GROUP BY 1),
       d AS (SELECT toxic, n, unnest(generate_series(0, wanted - 1)) AS draw FROM n)
       SELECT draw, doc_id, quality, toxic FROM (SELECT toxic, draw, CAST('0x' || substr(md5(concat_ws('|', toxic, draw, '5')), 1, 15) AS BIGINT) % n AS place FROM d) JOIN l USING (toxic, place)""",
)
def stratified_draws(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return C.stratified_draws(labels, "toxic", {0: 0.1, 1: 1.5}, ["doc_id"], seed=5)


@register("sample_with_replacement", "SELECT id AS draw, s_suppkey, s_name FROM (SELECT id, CAST('0x' || substr(md5(concat_ws('|', id, '1')), 1, 8) AS BIGINT) % (SELECT count(*) FROM supplier) AS p FROM range(200) AS r(id)) JOIN (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS p FROM supplier) USING (p)")
def sample_with_replacement(spark, sf_dir):
    return C.sample_with_replacement(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), 200, ["s_suppkey"], seed=1)


@register("bernoulli_by_class", "SELECT event_id, event_type FROM events WHERE md5(concat_ws('|', event_id, '0')) < CASE event_type WHEN 'click' THEN '80000000' WHEN 'view' THEN '19999999' WHEN 'purchase' THEN 'g' END")
def bernoulli_by_class(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return C.bernoulli_by_class(e, "event_type", {"click": 0.5, "view": 0.1, "purchase": 1.0}, ["event_id"])


@register("train_validation_split", "SELECT o_orderkey, CASE WHEN md5(concat_ws('|', o_orderkey, '42')) < 'cccccccc' THEN 'train' ELSE 'validation' END AS part FROM orders")
def train_validation_split(spark, sf_dir):
    train, rest = C.hash_split(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], [0.8, 0.2], seed=42)
    return train.withColumn("part", F.lit("train")).unionByName(rest.withColumn("part", F.lit("validation")))


@register("corr_matrix_lineitem", " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 4) AS r FROM lineitem" for i, a in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"]) for b in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"][i:]))
def corr_matrix_lineitem(spark, sf_dir):
    return A.correlation(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).withColumn("r", r4(F.col("r")))


_BIN = "CAST(least(floor(({c} - lo_{c}) / (hi_{c} - lo_{c}) * {n}), {n} - 1) AS INTEGER)"


@register(
    "mutual_info_qty_price",
    f"""WITH e AS (SELECT min(l_quantity) AS lo_l_quantity, max(l_quantity) AS hi_l_quantity, min(l_extendedprice) AS lo_l_extendedprice, max(l_extendedprice) AS hi_l_extendedprice FROM lineitem),
        b AS (SELECT {_BIN.format(c='l_quantity', n=10)} AS i, {_BIN.format(c='l_extendedprice', n=10)} AS j, count(*) AS n FROM lineitem, e GROUP BY 1, 2),
        g AS (SELECT CAST(a.range AS INTEGER) AS i, CAST(c.range AS INTEGER) AS j FROM range(10) a, range(10) c), f AS (SELECT g.i, g.j, coalesce(n, 0) + 1 AS n FROM g LEFT JOIN b ON g.i = b.i AND g.j = b.j),
        p AS (SELECT i, j, n / CAST(sum(n) OVER () AS DOUBLE) AS p FROM f), q AS (SELECT p, sum(p) OVER (PARTITION BY i) AS pi, sum(p) OVER (PARTITION BY j) AS pj FROM p)
        SELECT round(sum(p * ln(p / (pi * pj))) / (-sum(p * ln(pi)) - sum(p * ln(pj))), 4) AS mi FROM q""",
)
def mutual_info_qty_price(spark, sf_dir):
    return A.mutual_information(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select(r4(F.col("mi")).alias("mi"))


@register("hist_50_bins", f"SELECT {_BIN.format(c='o_totalprice', n=50)} AS bin, round(any_value(lo_o_totalprice) + {_BIN.format(c='o_totalprice', n=50)} * (any_value(hi_o_totalprice) - any_value(lo_o_totalprice)) / 50, 2) AS lower, count(*) AS n FROM orders, (SELECT min(o_totalprice) AS lo_o_totalprice, max(o_totalprice) AS hi_o_totalprice FROM orders) GROUP BY 1")
def hist_50_bins(spark, sf_dir):
    return A.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 50).withColumn("lower", F.round("lower", 2))


@register("h_index", "SELECT o_custkey, coalesce(max(CASE WHEN c >= r THEN r END), 0) AS h_index FROM (SELECT o_custkey, c, row_number() OVER (PARTITION BY o_custkey ORDER BY c DESC) AS r FROM (SELECT o_custkey, o_orderkey, count(l_orderkey) AS c FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)) GROUP BY 1")
def h_index(spark, sf_dir):
    o, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    n = items.groupBy("l_orderkey").agg(F.count("*").alias("c"))
    cited = o.join(n, o.o_orderkey == n.l_orderkey, "left").select("o_custkey", F.coalesce("c", F.lit(0)).alias("c"))
    return A.h_index(cited, "o_custkey", "c")


@register(
    "user_kpis",
    """WITH r AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events),
       t AS (SELECT user_id, max(CASE WHEN n = 1 THEN ts END) AS a, max(CASE WHEN n = 5 THEN ts END) AS b, count(*) AS follows, count(*) FILTER (n <= 3) * 10 AS fans FROM r GROUP BY 1),
       k AS (SELECT *, floor((epoch_us(a) - epoch_us(b)) / 86400000000.0) AS d FROM t),
       m AS (SELECT user_id, 5 / nullif(d, 0) AS rate, log10(fans) AS magnitude, log10(fans / CAST(follows AS DOUBLE) + 1) AS coverage FROM k)
       SELECT user_id, round(rate, 4) AS rate, round(magnitude, 4) AS magnitude, round(coverage, 4) AS coverage, round(rate * magnitude * coverage, 4) AS influence FROM m""",
)
def user_kpis(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    times = W.latest_and_nth(e, 5, "ts", ["user_id"], "event_id")
    counts = e.groupBy("user_id").agg(F.count("*").alias("follows"), (F.least(F.count("*"), F.lit(3)) * 10).alias("fans"))
    out = A.influence(times.join(counts, "user_id"), "fans", "follows", "latest", "nth", posts=5)
    return out.select("user_id", *[r4(F.col(c)).alias(c) for c in ("rate", "magnitude", "coverage", "influence")])


@register("latest_and_nth_post", "SELECT user_id, max(CASE WHEN n = 1 THEN ts END) AS latest, max(CASE WHEN n = 3 THEN ts END) AS nth FROM (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) GROUP BY 1")
def latest_and_nth_post(spark, sf_dir):
    return W.latest_and_nth(table(spark, sf_dir, "events"), 3, "ts", ["user_id"], "event_id")


_DAYS = "SELECT CAST(date_trunc('day', o_orderdate) AS DATE) AS day, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"


def _days(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("daily_diff", f"SELECT day, round(total - lag(total) OVER (ORDER BY day), 2) AS diff, round(ln(total) - lag(ln(total)) OVER (ORDER BY day), 4) AS log_diff, round(sqrt(total) - lag(sqrt(total)) OVER (ORDER BY day), 4) AS sqrt_diff FROM ({_DAYS})")
def daily_diff(spark, sf_dir):
    x = F.col("total")
    d = lambda v: W.difference(v, ["day"])
    return _days(spark, sf_dir).select("day", F.round(d(x), 2).alias("diff"), r4(d(F.ln(x))).alias("log_diff"), r4(d(F.sqrt(x))).alias("sqrt_diff"))


_W30 = "OVER (ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"


@register("rolling30_mean_std", f"SELECT day, CASE WHEN count(total) {_W30} >= 30 THEN round(avg(total) {_W30}, 4) END AS mean, CASE WHEN count(total) {_W30} >= 30 THEN round(stddev_samp(total) {_W30}, 2) END AS std FROM ({_DAYS})")
def rolling30_mean_std(spark, sf_dir):
    x = F.col("total")
    return _days(spark, sf_dir).select("day", F.round(W.rolling(x, 30, ["day"]), 4).alias("mean"), F.round(W.rolling(x, 30, ["day"], how="stddev_samp"), 2).alias("std"))


@register("dup_flag", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS duplicated FROM events")
def dup_flag(spark, sf_dir):
    return W.duplicate_flag(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "duplicated")


def _dedup(keep, order):
    @register(f"dedup_{keep}", f"SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts {order}, event_id {order}) AS n FROM events) WHERE n = 1")
    def query(spark, sf_dir):
        e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
        return W.drop_duplicates(e, ["user_id", "event_type"], ["ts", "event_id"], keep)

    return query


_dedup("first", "")
_dedup("last", "DESC")


@register("dedup_documents", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def dedup_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    # Texts are grouped by a 256-bit digest, so they are not shuffled.
    return d.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@register("run_islands", "WITH c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM c) SELECT user_id, run, any_value(event_type) AS event_type, count(*) AS rows FROM g GROUP BY user_id, run")
def run_islands(spark, sf_dir):
    return W.islands(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], ["user_id"])


@register("running_totals", "SELECT event_id, round(sum(coalesce(value, 0)) OVER w, 4) AS running, coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w, 0) = 0 AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_totals(spark, sf_dir):
    total, _ = W.running_until(F.col("value"), F.lit(None).cast("double"), ["ts", "event_id"], ["user_id"])
    _, before = W.running_until(F.when(F.col("event_type") == "purchase", 1).otherwise(0), F.lit(1), ["ts", "event_id"], ["user_id"])
    return table(spark, sf_dir, "events").select("event_id", r4(total).alias("running"), before.alias("before"))


@register("delta_features", "SELECT event_id, round(0.2 * value + 0.1 * lag(value, 1) OVER w - 0.1 * lag(value, 3) OVER w - 0.2 * lag(value, 4) OVER w, 4) AS delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def delta_features(spark, sf_dir):
    d = W.delta(F.col("value"), ["ts", "event_id"], ["user_id"])
    return table(spark, sf_dir, "events").select("event_id", r4(d).alias("delta"))


@register("union_bag", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def union_bag(spark, sf_dir):
    return R.union_all(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), table(spark, sf_dir, "region").select(F.col("r_name").alias("name")))


_AB = "WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 5000), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier) "


@register("set_operations", _AB + "SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'difference', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'symmetric', k FROM ((SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL (SELECT k FROM b EXCEPT SELECT k FROM a))")
def set_operations(spark, sf_dir):
    a = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")).distinct()
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "difference": a.subtract(b), "symmetric": R.symmetric_difference(a, b)}
    return R.union_all(*[x.select(F.lit(op).alias("op"), "k") for op, x in parts.items()])


@register("group_lists", "SELECT r_name, list_sort(list(n_name)) AS items FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def group_lists(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return A.group_lists(n.join(r, n.n_regionkey == r.r_regionkey), "r_name", "n_name")


@register("rollup_cube", "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS quantity, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS gid FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rollup_cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.grouping_id().alias("gid"))


@register("ranking_functions", "SELECT c_custkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS tile, round(percent_rank() OVER w, 4) AS share FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal)")
def ranking_functions(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal")
    tile = F.ntile(4).over(Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey"))
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense"), tile.cast("long").alias("tile"), r4(F.percent_rank().over(w)).alias("share"))


@register("tumbling_windows", "SELECT event_type, time_bucket(INTERVAL '6 hours', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), r4(F.sum("value")).alias("total"))
    return e.select("event_type", F.col("w.start").alias("start"), "n", "total")

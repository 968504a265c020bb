"""Queries over texts, JSON, vectors and series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register, table
from ..functions import arrays as V
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import blocks, dtw, evaluation, models, scans, signal
from ..operators import relational as R
from ..operators import text as X
from ..operators import windows as W
from ..streaming import segments as G


def r4(x):
    return F.round(x.cast("double"), 4)


@register("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS missing FROM events")
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint, none string"))
    return e.select("event_id", F.col("p.k").alias("k"), F.col("p.none").alias("missing"))


@register(
    "string_clean",
    """SELECT p_partkey, upper(trim(regexp_replace(p_name, '[!#?]', '', 'g'))) AS upper_name, length(p_name) AS n, substr(p_type, 1, 3) AS head, replace(p_type, ' ', '_') AS joined,
       len(p_name) - len(replace(p_name, 'a', '')) AS n_a, starts_with(p_brand, 'Brand') AS branded, instr(p_name, 'e') - 1 AS first_e, translate(p_type, 'AEIOU', '') AS consonants FROM part""",
)
def string_clean(spark, sf_dir):
    n, t = F.col("p_name"), F.col("p_type")
    clean = S.clean_strings(n, [S.remove_punctuation, S.strip, F.upper])
    return table(spark, sf_dir, "part").select(
        "p_partkey", clean.alias("upper_name"), F.length(n).cast("long").alias("n"), F.substring(t, 1, 3).alias("head"), F.replace(t, F.lit(" "), F.lit("_")).alias("joined"),
        S.count_of(n, "a").alias("n_a"), F.startswith("p_brand", F.lit("Brand")).alias("branded"), (F.instr(n, "e") - 1).cast("long").alias("first_e"), S.remove_chars(t, "AEIOU").alias("consonants"),
    )


@register("regex_digits", "SELECT doc_id, nullif(regexp_extract(text, '([0-9]{3,})', 1), '') AS first_number, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits FROM documents")
def regex_digits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.first_match(F.col("text"), "[0-9]{3,}").alias("first_number"), F.length(S.digits(F.col("text"))).cast("long").alias("n_digits"))


@register("cjk_width", "SELECT doc_id, length(regexp_replace(text, '[^一-龥]', '', 'g')) AS cjk, length(rpad(substr(source, 1, 5), 12, ' ')) AS width FROM documents")
def cjk_width(spark, sf_dir):
    padded = S.pad_display(F.substring("source", 1, 5), 12)
    return table(spark, sf_dir, "documents").select("doc_id", S.cjk_count(F.col("text")).alias("cjk"), F.length(padded).cast("long").alias("width"))


@register("date_parts_format", "SELECT o_orderkey, day(o_orderdate) AS day, strftime(o_orderdate, '%m/%d/%Y %H:%M') AS text, date_trunc('hour', o_orderdate) AS hour, CAST(floor((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-01-01 12:00:00')) / 86400000000.0) AS BIGINT) AS days FROM orders")
def date_parts_format(spark, sf_dir):
    d = F.col("o_orderdate")
    start = F.to_timestamp(F.lit("1995-01-01 12:00:00"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.day(d).cast("long").alias("day"), F.date_format(d, "MM/dd/yyyy HH:mm").alias("text"), F.date_trunc("hour", d).alias("hour"), S.whole_days(d, start).alias("days"))


@register("relative_dates", "SELECT event_id, CAST(strftime(ts, '%Y-%m-%d %H:%M:00') AS TIMESTAMP) AS at FROM events")
def relative_dates(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    # Three spellings of the same minute, chosen by the event's id.
    spelled = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "MM月dd日 HH:mm")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("今天 "), F.date_format("ts", "HH:mm"))).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    return e.select("event_id", S.post_time(spelled, F.col("day")).alias("at"))


@register("number_functions", "SELECT p_partkey, 32 - length(bin(p_size)) AS zeros, CAST(floor(sqrt(p_retailprice)) AS BIGINT) AS root, round(log2(p_size), 4) AS log2, round(log10(p_size), 4) AS log10, greatest(least(p_retailprice, 1500.0), 1000.0) AS clamped, (p_size + 1) % 7 AS next, (p_size + 6) % 7 AS previous FROM part")
def number_functions(spark, sf_dir):
    x = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.leading_zeros(x).cast("long").alias("zeros"), S.integer_sqrt(F.col("p_retailprice")).alias("root"), r4(F.log2(x)).alias("log2"), r4(F.log10(x)).alias("log10"),
        S.clamp(F.col("p_retailprice"), 1000.0, 1500.0).alias("clamped"), S.ring_next(x, 7).alias("next"), S.ring_previous(x, 7).alias("previous"),
    )


_ARR = "SELECT r_name, list_sort(list(n_name)) AS a FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"


@register("array_functions", f"SELECT r_name, a[1] AS first, a[2:3] AS middle, list_reverse(a) AS backwards, len(a) AS n, list_contains(a, 'INDIA') AS india, list_concat(a, ['X']) AS longer, list_filter(a, lambda x: x LIKE '%E%E%') AS two_e FROM ({_ARR})")
def array_functions(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    a = F.col("items")
    two = F.filter(a, lambda x: S.count_of(x, "E") >= 2)
    lists = A.group_lists(n.join(r, n.n_regionkey == r.r_regionkey), "r_name", "n_name")
    return lists.select("r_name", F.get(a, F.lit(0)).alias("first"), F.slice(a, 2, 2).alias("middle"), F.reverse(a).alias("backwards"), F.size(a).cast("long").alias("n"), F.array_contains(a, "INDIA").alias("india"), F.array_append(a, "X").alias("longer"), two.alias("two_e"))


@register("map_functions", "SELECT user_id, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS clicks, count(DISTINCT event_type) AS kinds, list_sort(list(DISTINCT event_type)) AS names FROM events GROUP BY 1")
def map_functions(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = c.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", S.map_get(F.col("m"), F.lit("click"), F.lit(0)).cast("long").alias("clicks"), F.size("m").cast("long").alias("kinds"), F.array_sort(F.map_keys("m")).alias("names"))


@register("word_freq_top200", "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM documents WHERE lang = 'en') WHERE word NOT IN ('the', 'of', 'and', 'a', 'to', 'in') GROUP BY 1 ORDER BY n DESC, word LIMIT 200")
def word_freq_top200(spark, sf_dir):
    english = table(spark, sf_dir, "documents").filter("lang = 'en'")
    return X.word_counts(english, "text", ["the", "of", "and", "a", "to", "in"]).orderBy(F.desc("n"), "word").limit(200)


def _sql_flag(parts):
    quote = lambda p: p.replace("'", "''")
    return "(CASE WHEN " + " OR ".join(f"contains(t, '{quote(p)}')" for p in parts) + " THEN 1 ELSE 0 END)"


_VECTOR = "[" + ", ".join(_sql_flag(p) for p in X.KEYWORDS.values()) + "]"
_PADDED = "(SELECT *, ' ' || lower(coalesce(text, '')) || ' ' AS t FROM documents)"


@register("keyword_features", f"SELECT doc_id, v AS features, list_sum(v) = 0 AS is_zero FROM (SELECT doc_id, {_VECTOR} AS v FROM {_PADDED})")
def keyword_features(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.keyword_vector(F.col("text")).alias("features")).withColumn("is_zero", X.is_zero(F.col("features")))


@register("keyword_totals", f"SELECT CAST(sum(v[14]) AS BIGINT) AS exclaim, CAST(sum(v[30]) AS BIGINT) AS likes, count(*) AS n FROM (SELECT {_VECTOR} AS v FROM {_PADDED})")
def keyword_totals(spark, sf_dir):
    m = table(spark, sf_dir, "documents").select(X.vector_map(X.keyword_vector(F.col("text"))).alias("m"))
    return m.agg(F.sum(F.col("m")["hasExclaim"]).alias("exclaim"), F.sum(F.col("m")["hasLike"]).alias("likes"), F.count("*").alias("n"))


@register(
    "naive_bayes_confusion",
    f"""WITH d AS (SELECT doc_id, quality, v FROM (SELECT doc_id, {_VECTOR} AS v FROM {_PADDED}) JOIN labels USING (doc_id)),
        n AS (SELECT quality AS label, count(*) AS n FROM d WHERE doc_id % 4 <> 0 GROUP BY 1),
        u AS (SELECT doc_id, quality, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM d),
        o AS (SELECT quality AS label, i, sum(x) AS ones FROM u WHERE doc_id % 4 <> 0 GROUP BY 1, 2),
        l AS (SELECT doc_id, quality, o.label, round(ln(n / (SELECT sum(n) FROM n)) + sum(CASE WHEN x = 1 THEN ln((ones + 0.5) / (n + 1)) ELSE ln((n - ones + 0.5) / (n + 1)) END), 9) AS l
              FROM u JOIN o USING (i) JOIN n ON n.label = o.label WHERE doc_id % 4 = 0 GROUP BY doc_id, quality, o.label, n),
        p AS (SELECT quality, arg_min(label, (-l, label)) AS predicted FROM l GROUP BY doc_id, quality)
        SELECT quality, count(*) FILTER (predicted = 0) AS "0", count(*) FILTER (predicted = 1) AS "1" FROM p GROUP BY 1""",
)
def naive_bayes_confusion(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", X.keyword_vector(F.col("text")).alias("v"))
    train, test = d.filter("doc_id % 4 <> 0"), d.filter("doc_id % 4 = 0")
    predicted = X.naive_bayes_predict(test, X.naive_bayes_fit(train, "v", "quality"), "v")
    return A.confusion_matrix(predicted, "quality", "predicted", [0, 1])


@register("quality_measures", "WITH p AS (SELECT quality AS t, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p FROM documents JOIN labels USING (doc_id)), c AS (SELECT count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t <> 1 AND p = 1) AS fp, count(*) FILTER (t = 1 AND p <> 1) AS fn, count(*) FILTER (t = p) AS r, count(*) AS n FROM p) SELECT round(r / n, 4) AS accuracy, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 4) AS f1 FROM c")
def quality_measures(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("quality").alias("t"), (F.col("n_chars") > 1000).cast("int").alias("p"))
    out = A.classification_measures(d, "t", "p")
    return out.select(*[r4(F.col(c)).alias(c) for c in out.columns])


_LEVELS = [200, 500, 1000, 2000, 5000]


@register("detection_sweep", " UNION ALL ".join(f"SELECT lang, CAST({t} AS DOUBLE) AS threshold, count(*) FILTER (n_chars <= {t} AND toxic = 1) AS tp, count(*) FILTER (n_chars <= {t} AND toxic <> 1) AS fp, count(*) FILTER (n_chars > {t} AND toxic <> 1) AS tn, count(*) FILTER (n_chars > {t} AND toxic = 1) AS fn, round(count(*) FILTER (n_chars <= {t} AND toxic <> 1) / nullif(count(*) FILTER (toxic <> 1), 0), 4) AS far, round(count(*) FILTER (n_chars > {t} AND toxic = 1) / nullif(count(*) FILTER (toxic = 1), 0), 4) AS frr FROM documents JOIN labels USING (doc_id) GROUP BY lang" for t in _LEVELS))
def detection_sweep(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", "n_chars", (F.col("toxic") == 1).alias("truth"))
    out = A.detection_counts(d, "n_chars", "truth", _LEVELS, ["lang"])
    return out.withColumns({"far": r4(F.col("far")), "frr": r4(F.col("frr"))})


_DOT = "list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), lambda p: p[1] * p[2]))"
_L2 = "list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _centroids(spark, sf_dir):
    return models.label_gaussians(table(spark, sf_dir, "embeddings"), "label", "embedding")


_CENTRE = "WITH c AS (SELECT label, list(m ORDER BY i) AS mean, list(s ORDER BY i) AS var, any_value(n) AS n FROM (SELECT label, i, avg(v) AS m, var_pop(v) AS s, count(*) AS n FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"


@register("nearest_centroid", _CENTRE + " SELECT vec_id, arg_min(c.label, (round(sqrt(" + _L2.format(a="embedding", b="c.mean") + "), 9), c.label)) AS nearest, round(min(sqrt(" + _L2.format(a="embedding", b="c.mean") + ")), 4) AS distance FROM embeddings, c GROUP BY vec_id")
def nearest_centroid(spark, sf_dir):
    c = _centroids(spark, sf_dir).select("label", F.col("mean").alias("centroid"))
    return R.nearest_centroid(table(spark, sf_dir, "embeddings"), c).select("vec_id", "nearest", r4(F.col("distance")).alias("distance"))


@register("dot_with_centroids", _CENTRE + " SELECT vec_id, c.label AS label, round(" + _DOT.format(a="embedding", b="c.mean") + ", 4) AS dot, round(" + _L2.format(a="embedding", b="c.mean") + ", 4) AS l2 FROM embeddings, c WHERE embeddings.label = c.label")
def dot_with_centroids(spark, sf_dir):
    c = _centroids(spark, sf_dir).select("label", "mean")
    e = table(spark, sf_dir, "embeddings").join(c, "label")
    return e.select("vec_id", "label", r4(V.dot(F.col("embedding"), F.col("mean"))).alias("dot"), r4(V.l2_squared(F.col("embedding"), F.col("mean"))).alias("l2"))


_COS = "round(1 - {d} / (sqrt({x}) * sqrt({y})), 4)".format(d=_DOT.format(a="embedding", b="c.mean"), x=_DOT.format(a="embedding", b="embedding"), y=_DOT.format(a="c.mean", b="c.mean"))


@register("cosine_to_centroid", _CENTRE + f" SELECT vec_id, {_COS} AS cosine, round(sqrt(2 * (1 - {_DOT.format(a='embedding', b='c.mean')} / (sqrt({_DOT.format(a='embedding', b='embedding')}) * sqrt({_DOT.format(a='c.mean', b='c.mean')})))), 4) AS euclid FROM embeddings JOIN c USING (label)")
def cosine_to_centroid(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").join(_centroids(spark, sf_dir).select("label", "mean"), "label")
    x, m = F.col("embedding"), F.col("mean")
    return e.select("vec_id", r4(V.cosine_distance(x, m)).alias("cosine"), r4(V.unit_euclidean(x, m)).alias("euclid"))


@register("l2_normalise", "SELECT vec_id, round(sqrt(" + _DOT.format(a="embedding", b="embedding") + "), 4) AS norm, list_position(embedding, list_max(embedding)) - 1 AS argmax FROM embeddings")
def l2_normalise(spark, sf_dir):
    x = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", r4(V.norm(x)).alias("norm"), V.argmax(x).alias("argmax"))


@register("top_components", "SELECT vec_id, list_transform(list_sort(list_transform(generate_series(1, len(embedding)), lambda i: {'v': -embedding[i], 'i': i - 1}))[1:5], lambda s: s.i) AS best FROM embeddings")
def top_components(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(V.top_indices(F.col("embedding"), 5), lambda i: i.cast("long")).alias("best"))


@register("matrix_transpose", "SELECT i - 1 AS col, list(v ORDER BY vec_id) AS embedding FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1")
def matrix_transpose(spark, sf_dir):
    return blocks.transpose_whole(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@register("gram_matrix", 'SELECT a.i - 1 AS "row", b.i - 1 AS col, round(sum(CAST(a.v AS DOUBLE) * b.v), 3) AS value FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) a JOIN (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) b USING (vec_id) GROUP BY 1, 2')
def gram_matrix(spark, sf_dir):
    return blocks.gram(table(spark, sf_dir, "embeddings"), "embedding").withColumn("value", F.round("value", 3))


@register("sparse_product", "SELECT a.l_suppkey AS \"row\", b.s_nationkey AS col, round(sum(a.v * b.s_acctbal), 2) AS value FROM (SELECT l_suppkey, l_partkey % 50 AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) a JOIN (SELECT s_suppkey % 50 AS k, s_nationkey, sum(s_acctbal) AS s_acctbal FROM supplier GROUP BY 1, 2) b USING (k) GROUP BY 1, 2")
def sparse_product(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("row"), (F.col("l_partkey") % 50).alias("col")).agg(F.sum("l_quantity").alias("value"))
    b = table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 50).alias("row"), F.col("s_nationkey").alias("col")).agg(F.sum("s_acctbal").alias("value"))
    return R.matrix_multiply(a, b).withColumn("value", F.round("value", 2))


@register(
    "gmm_llr_diag",
    _CENTRE
    + """, k AS (SELECT label, mean, var, n / CAST((SELECT count(*) FROM embeddings) AS DOUBLE) AS w FROM c),
       p AS (SELECT vec_id, ln(w) - 0.5 * list_sum(list_transform(var, lambda v: ln(v) + ln(2 * pi()))) - 0.5 * list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), mean, var), lambda z: (z[1] - z[2]) * (z[1] - z[2]) / z[3])) AS l FROM embeddings, k)
       SELECT vec_id, round(max(l) + ln(sum(exp(l - m))), 3) AS llr FROM (SELECT vec_id, l, max(l) OVER (PARTITION BY vec_id) AS m FROM p) GROUP BY vec_id""",
)
def gmm_llr_diag(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("features", F.col("embedding").cast("array<double>"))
    return models.gmm_scores(e, _centroids(spark, sf_dir)).select("vec_id", F.round("llr", 3).alias("llr"))


@register("label_distances", _CENTRE + " SELECT a.label AS x, b.label AS y, round(list_sum(list_transform(list_zip(a.mean, b.mean, a.var, b.var), lambda z: (z[1] - z[2]) * (z[1] - z[2]) / ((z[3] + z[4]) / 2))) / 8 + 0.5 * list_sum(list_transform(list_zip(a.var, b.var), lambda z: ln((z[1] + z[2]) / 2) - 0.5 * (ln(z[1]) + ln(z[2])))), 4) AS distance FROM c a JOIN c b ON a.label < b.label")
def label_distances(spark, sf_dir):
    c = _centroids(spark, sf_dir)
    a, b = (c.select(*[F.col(n).alias(f"{n}_{s}") for n in ("label", "mean", "var")]) for s in ("x", "y"))
    d = V.bhattacharyya(F.col("mean_x"), F.col("var_x"), F.col("mean_y"), F.col("var_y"))
    return a.join(R.small_side(b), F.col("label_x") < F.col("label_y")).select(F.col("label_x").alias("x"), F.col("label_y").alias("y"), r4(d).alias("distance"))


@register("log_sum_exp", "SELECT user_id, round(max(value / 50) + ln(sum(exp(value / 50 - m))), 4) AS log_sum_exp FROM (SELECT user_id, value, max(value / 50) OVER (PARTITION BY user_id) AS m FROM events WHERE value IS NOT NULL) GROUP BY user_id")
def log_sum_exp(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("value is not null").withColumn("x", F.col("value") / 50)
    return A.log_sum_exp(e, ["user_id"], "x").withColumn("log_sum_exp", r4(F.col("log_sum_exp")))


@register("psnr_rounding", "SELECT round(avg((l_extendedprice - round(l_extendedprice, 0)) * (l_extendedprice - round(l_extendedprice, 0))), 6) AS mse, round(10 * log10(65025.0 / avg((l_extendedprice - round(l_extendedprice, 0)) * (l_extendedprice - round(l_extendedprice, 0)))), 4) AS psnr FROM lineitem")
def psnr_rounding(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_extendedprice", F.round("l_extendedprice", 0).alias("y"))
    return A.psnr(x, "l_extendedprice", "y").select(F.round("mse", 6).alias("mse"), r4(F.col("psnr")).alias("psnr"))


def _series(spark, sf_dir):
    """Events of a user as a series in time."""
    e = table(spark, sf_dir, "events").filter("value is not null")
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col("value").alias("v"))))
    return e.groupBy("user_id").agg(F.transform(ordered, lambda s: s["v"]).alias("x"))


_SERIES = "(SELECT user_id, list(value ORDER BY ts, event_id) AS x FROM events WHERE value IS NOT NULL GROUP BY 1)"


@register("frames_overlap", f"SELECT user_id, i AS frame, x[i * 2 + 1:i * 2 + 4] AS samples FROM (SELECT user_id, x, unnest(generate_series(0, CAST(floor((len(x) - 4) / 2) AS BIGINT))) AS i FROM {_SERIES} WHERE len(x) >= 4)")
def frames_overlap(spark, sf_dir):
    f = _series(spark, sf_dir).select("user_id", F.posexplode(W.frames(F.col("x"), 4, 2)).alias("frame", "samples"))
    return f.withColumn("frame", F.col("frame").cast("long"))


@register("zcr_energy", f"SELECT user_id, round(list_sum(list_transform(generate_series(2, len(y)), lambda i: CASE WHEN (y[i] >= 0) <> (y[i - 1] >= 0) THEN 1 ELSE 0 END)) / len(y), 4) AS zcr, round(list_sum(list_transform(y, lambda v: abs(v))) / len(y), 6) AS energy FROM (SELECT user_id, list_transform(x, lambda v: v - 50) AS y FROM {_SERIES} WHERE len(x) >= 2)")
def zcr_energy(spark, sf_dir):
    y = _series(spark, sf_dir).filter(F.size("x") >= 2).withColumn("y", F.transform("x", lambda v: v - 50))
    return y.select("user_id", r4(V.zero_crossings(F.col("y"))).alias("zcr"), F.round(V.mean_abs(F.col("y")), 6).alias("energy"))


@register("preemphasis", f"SELECT user_id, list_transform(generate_series(1, len(v)), lambda i: greatest(least(sign(100 * v[i] - 97 * v[greatest(i - 1, 1)]) * (abs(100 * v[i] - 97 * v[greatest(i - 1, 1)]) // 100), 32767), -32768)) AS y FROM (SELECT user_id, list_transform(x, lambda a: CAST(round(a * 100) AS BIGINT)) AS v FROM {_SERIES})")
def preemphasis(spark, sf_dir):
    return _series(spark, sf_dir).select("user_id", signal.preemphasis_column(F.transform("x", lambda v: F.round(v * 100).cast("long"))).alias("y"))


@register("second_difference", f"SELECT user_id, list_transform(generate_series(2, len(x) - 1), lambda i: round(x[i + 1] - 2 * x[i] + x[i - 1], 4)) AS d FROM {_SERIES} WHERE len(x) >= 3")
def second_difference(spark, sf_dir):
    return _series(spark, sf_dir).filter(F.size("x") >= 3).select("user_id", F.transform(V.second_difference(F.col("x")), lambda v: S.round_product(v, 4)).alias("d"))


@register("energy_frames", "SELECT event_id FROM (SELECT event_id, value * value AS e, max(value * value) OVER (PARTITION BY user_id) AS m FROM events) WHERE e >= 0.001 * m")
def energy_frames(spark, sf_dir):
    e = F.col("value") * F.col("value")
    return table(spark, sf_dir, "events").withColumn("m", F.max(e).over(Window.partitionBy("user_id"))).filter(e >= 0.001 * F.col("m")).select("event_id")


@register("z_norm", "SELECT event_id, round((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 4) AS z_norm FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type)")
def z_norm(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("value is not null").select("event_id", "event_type", "value")
    return evaluation.z_norm(e, "event_type", "value").select("event_id", r4(F.col("z_norm")).alias("z_norm"))


@register("t_norm", "WITH i AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM events WHERE event_type <> 'purchase' GROUP BY 1) SELECT event_id, round((value - m) / nullif(s, 0), 4) AS t_norm FROM events JOIN i USING (user_id) WHERE event_type = 'purchase'")
def t_norm(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    out = evaluation.t_norm(e.filter("event_type = 'purchase'"), "user_id", "value", e.filter("event_type <> 'purchase'"), "value")
    return out.select("event_id", r4(F.col("t_norm")).alias("t_norm"))


@register("vote", "SELECT user_id, (count(*) FILTER (value < 40) * 2 > count(*) OR min(value) < 2) AS accepted FROM events WHERE value IS NOT NULL GROUP BY 1")
def vote(spark, sf_dir):
    return evaluation.vote(table(spark, sf_dir, "events").filter("value is not null"), "user_id", "value", 40.0, 2.0)


@register("score_difference", "SELECT user_id, round(avg(value) - avg(event_id % 100), 4) AS llr FROM events WHERE value IS NOT NULL GROUP BY 1")
def score_difference(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("value is not null").withColumn("back", F.col("event_id") % 100)
    return evaluation.mean_llr(e, "user_id", "value", "back").withColumn("llr", r4(F.col("llr")))


@register("accept_after_frames", "SELECT user_id, CAST(block AS INTEGER) AS block, count(*) AS n, round(avg(value), 4) AS norm, round(avg(event_id % 10), 4) AS own, avg(value) > 50 AND avg(event_id % 10) > 4 AS accepted FROM (SELECT *, floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 3) AS block FROM events WHERE value IS NOT NULL) GROUP BY user_id, block HAVING count(*) = 3")
def accept_after_frames(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("value is not null").withColumns({"own": F.col("event_id") % 10, "at": F.struct("ts", "event_id")})
    out = evaluation.accept_after(e, "user_id", "at", "value", "own", 3, 50.0, 4.0)
    return out.withColumns({"norm": r4(F.col("norm")), "own": r4(F.col("own"))})


@register("imposter_choice", 'WITH s AS (SELECT l_suppkey AS "row", l_partkey % 20 AS col, round(sum(l_quantity), 2) AS score FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY "row", "row" = col ORDER BY score DESC, col) AS n FROM s) SELECT "row", col, score, "row" <> col AND n <= 10 AS chosen FROM r')
def imposter_choice(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    s = items.groupBy(F.col("l_suppkey").alias("row"), (F.col("l_partkey") % 20).alias("col")).agg(F.round(F.sum("l_quantity"), 2).alias("score"))
    return evaluation.choose_imposters(s)


@register("component_share", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, (sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING) - o_totalprice) / sum(o_totalprice) OVER (PARTITION BY o_custkey) AS b FROM orders) WHERE b < 0.8")
def component_share(spark, sf_dir):
    return evaluation.components_by_share(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "o_orderkey", 0.2).select("o_custkey", "o_orderkey")


@register("conversation_turns", "SELECT conv_id, role, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1, 2")
def conversation_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


_TEXT_OF = "trim(regexp_replace(regexp_replace(a, '<[^>]*>', '', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@register(
    "page_links",
    f"""SELECT page_id, CAST(i - 1 AS INTEGER) AS position, coalesce(regexp_extract(a, '(?is)^<a\\b[^>]*?\\bhref\\s*=\\s*"([^"]*)"', 1), '') AS href, {_TEXT_OF} AS text
        FROM (SELECT page_id, generate_subscripts(l, 1) AS i, unnest(l) AS a FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a>') AS l FROM pages WHERE html IS NOT NULL))""",
)
def page_links(spark, sf_dir):
    return X.page_links(table(spark, sf_dir, "pages").select("page_id", "html"))


@register("page_hosts", "SELECT regexp_extract(url, '://([^/]+)', 1) AS host, count(*) AS pages, count(*) FILTER (html LIKE '%<article>%') AS articles FROM pages GROUP BY 1")
def page_hosts(spark, sf_dir):
    host = F.regexp_extract("url", "://([^/]+)", 1)
    return table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.count_if(F.contains("html", F.lit("<article>"))).alias("articles"))


@register("tokens_truncated", "SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')[1:8] AS words FROM documents")
def tokens_truncated(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text"), 8).alias("words"))


@register("kmeans_labels")
def kmeans_labels(spark, sf_dir):
    return models.kmeans(table(spark, sf_dir, "embeddings"), "embedding", 10)[0].select("vec_id", "label", "cluster")


@register("pca_2d")
def pca_2d(spark, sf_dir):
    return models.pca(table(spark, sf_dir, "embeddings"), "embedding", 2).select("vec_id", "projected")


@register("dtw_pairs")
def dtw_pairs(spark, sf_dir):
    """Every user's series against one template: the mean of all users' frames, place by place, over the first eight places."""
    s = _series(spark, sf_dir).filter(F.size("x") >= 4).select(F.col("user_id").alias("id"), W.frames(F.col("x"), 4, 2).alias("frames"))
    places = s.select(F.posexplode("frames").alias("place", "f")).filter("place < 8").groupBy("place").agg(F.array(*[F.avg(F.col("f")[i]) for i in range(4)]).alias("f"))
    template = places.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "f"))), lambda p: p["f"]).alias("frames"))
    return dtw.dtw_pairs(dtw.all_pairs(template.select(F.lit(-1).cast("long").alias("id"), "frames"), s))


@register("series_stationarity")
def series_stationarity(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("value is not null").withColumn("at", F.col("ts").cast("timestamp"))
    return models.adf_by_key(e, "event_type", ["at", "event_id"], "value")


@register("mfcc_features")
def mfcc_features(spark, sf_dir):
    # A user's series, held for 64 samples each, stands in for an utterance.
    wave = _series(spark, sf_dir).select("user_id", F.flatten(F.transform("x", lambda v: F.array_repeat(v * 100, 64))).alias("samples"))
    return signal.mfcc(wave, "user_id", "samples")


@register("vad_segments")
def vad_segments(spark, sf_dir):
    """Segments of the energy of each event type's values, in frames of four."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    return G.segments_in_blocks(G.energy_frames(e, "event_type", ["ts", "event_id"], "value", 4, 1.0), VAD_RULES)


# The events are noise, so these rules open and close segments sooner than those for speech.
VAD_RULES = G.Rules(context=6, context_silent=3, enter=4, enter_speech=3, leave=4, leave_silent=3, last_silent=2, trail=4, trail_silent=2, pre_roll=3, most=200)


@register("noise_floor", f"SELECT user_id, round(list_reduce(x, lambda a, v: a * 0.998 + v * (1 - 0.998)), 4) AS floor FROM {_SERIES}")
def noise_floor(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("value is not null")
    return G.noise_floor(e, "user_id", ["ts", "event_id"], "value").withColumn("floor", r4(F.col("floor")))


@register(
    "noise_track",
    """WITH RECURSIVE o AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events WHERE value IS NOT NULL),
       y AS (SELECT event_id, event_type, n, value AS y FROM o WHERE n = 1 UNION ALL SELECT o.event_id, o.event_type, o.n, y.y * 0.998 + o.value * (1 - 0.998) FROM y JOIN o ON o.event_type = y.event_type AND o.n = y.n + 1)
       SELECT event_id, round(y, 4) AS track FROM y""",
)
def noise_track(spark, sf_dir):
    """The noise level after each event of a type: few keys with many rows."""
    e = table(spark, sf_dir, "events").filter("value is not null").select("event_id", "event_type", "ts", "value")
    return scans.moving_average(e, ["event_type"], ["ts", "event_id"], "value", 0.998, "track").select("event_id", r4(F.col("track")).alias("track"))


@register("coin_change", "SELECT amount, CAST(list_sum(list_transform(generate_series(0, amount // 25), lambda q: list_sum(list_transform(generate_series(0, (amount - 25 * q) // 10), lambda d: (amount - 25 * q - 10 * d) // 5 + 1)))) AS BIGINT) AS ways FROM (SELECT DISTINCT CAST(p_size AS INTEGER) AS amount FROM part)")
def coin_change(spark, sf_dir):
    """Ways to make each part size from coins of 25, 10, 5 and 1: a recursive query whose steps are bounded by the largest size."""
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").alias("amount")).distinct()
    ways = F.expr(
        "aggregate(sequence(0, cast(amount div 25 as int)), 0L, (a, q) -> a + aggregate(sequence(0, cast((amount - 25 * q) div 10 as int)), 0L, (b, d) -> b + cast((amount - 25 * q - 10 * d) div 5 as bigint) + 1))"
    )
    return sizes.select("amount", ways.alias("ways"))

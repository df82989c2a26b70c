"""Statistics, text, annotation, placebos and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from hindcast.functions import exprs as X
from hindcast.operators import stats as S
from hindcast.operators.lineage import stored
from hindcast.plans.study import rounded
from hindcast.sources import adapters as A
from hindcast.sources.adapters import duck, table

XS = ["l_quantity", "l_discount", "l_tax"]
CENTERS = [[0.1 * ((i + j) % 7 - 3) for j in range(64)] for i in range(5)]
BETA = [1.0, 2.0, -0.5, 0.25]


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", *XS, (F.col("l_extendedprice") / 1000).alias("y"), X.epoch("l_shipdate").alias("ts"), "l_returnflag", "l_linestatus")


def within_demean(spark, sf_dir):
    rows = S.within_demean(lines(spark, sf_dir), "l_suppkey", ["y", *XS])
    return rounded(rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(F.col("y") * F.col("l_quantity")).alias("syq"), F.sum(F.col("y") * F.col("y")).alias("syy")), 3)


def ols_moments(spark, sf_dir):
    return rounded(lines(spark, sf_dir).agg(F.count("*").alias("n"), *S.gram(XS, "y")), 3)


def cluster_meat(spark, sf_dir):
    """The clusters' scores at given coefficients."""
    return rounded(lines(spark, sf_dir).groupBy("l_suppkey").agg(*S._scores(XS, "y", np.array(BETA))), 4)


def predictions(spark, sf_dir):
    """A probability and an outcome for each line."""
    return lines(spark, sf_dir).select("l_orderkey", "l_suppkey", X.floor_to(F.col("l_quantity") * 2, 1.0).alias("q"), (F.col("l_quantity") / 51).alias("p"), F.when(F.col("l_returnflag") == "A", 1).otherwise(-1).alias("label"))


def calibration_bins(spark, sf_dir):
    b = F.least(F.floor(F.col("p") * 10), F.lit(9))
    return rounded(predictions(spark, sf_dir).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg((F.col("label") == 1).cast("double")).alias("rate")))


def prediction_metrics(spark, sf_dir):
    y, p = (F.col("label") + 1) / 2, F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("p")))
    return rounded(predictions(spark, sf_dir).agg(F.avg(F.pow(F.col("p") - y, F.lit(2.0))).alias("brier"), F.avg(-(y * F.ln(p) + (F.lit(1.0) - y) * F.ln(F.lit(1.0) - p))).alias("log_loss"), F.avg(((F.col("p") >= 0.5) == (F.col("label") == 1)).cast("double")).alias("accuracy")))


def kappa(spark, sf_dir):
    """Cohen's kappa of two reviewers (quality and toxic labels of a document)."""
    rows = table(spark, sf_dir, "labels")
    n = F.count("*")
    po = F.avg((F.col("quality") == F.col("toxic")).cast("double"))
    a, b = F.avg(F.col("quality").cast("double")), F.avg(F.col("toxic").cast("double"))
    pe = a * b + (F.lit(1.0) - a) * (F.lit(1.0) - b)
    return rows.agg(n.alias("n"), F.round(po, 9).alias("agreement"), F.round(F.when(pe < 1, (po - pe) / (F.lit(1.0) - pe)), 9).alias("kappa"))


def confusion(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0).withColumnsRenamed({"F": "n_f", "O": "n_o"})


def kmeans_assign(spark, sf_dir):
    return rounded(S.kmeans_assign(table(spark, sf_dir, "embeddings"), "embedding", CENTERS).select("vec_id", "label", "cluster", "inertia"), 5)


def cluster_contingency(spark, sf_dir):
    """Of each cluster its size, its commonest label's share and the entropy of its labels."""
    t = S.kmeans_assign(table(spark, sf_dir, "embeddings"), "embedding", CENTERS).groupBy("cluster", "label").agg(F.count("*").alias("n"))
    t = t.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("cluster")))
    return rounded(t.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("p").alias("purity"), (-F.sum(F.col("p") * F.ln("p"))).alias("entropy")))


def fold_assignment(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.floor(X.epoch("ts")).alias("t"))
    return S.folds(rows, "t", "event_id", 7).select("event_id", "fold")


def placebo_lead(spark, sf_dir):
    """Each user's next value in the place of the present one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.lead("value").over(w).alias("placebo"))


def placebo_permutation(spark, sf_dir):
    """Values permuted within a user by seeded hash."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    a = e.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).select("event_id", "user_id", "k")
    b = e.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.md5(F.concat(F.lit("p:"), F.col("event_id").cast("string"))), "event_id"))).select("user_id", "k", F.col("value").alias("placebo"))
    return a.join(b, ["user_id", "k"]).select("event_id", "placebo")


def stratified_sample(spark, sf_dir):
    return S.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 60, "batch").select("doc_id", "lang", "place")


def dominant_channel(spark, sf_dir):
    """Of each line the channel that is largest against its scale; the first of equals."""
    parts = F.array(*[F.struct((F.abs(F.col(c)) / s).alias("v"), F.lit(-i).alias("i"), F.lit(n).alias("name")) for i, (c, s, n) in enumerate((("l_quantity", 50.0, "actor"), ("l_discount", 0.1, "market"), ("l_tax", 0.08, "news")))])
    return lines(spark, sf_dir).select(F.array_max(parts)["name"].alias("channel")).groupBy("channel").agg(F.count("*").alias("n"))


def claims(spark, sf_dir):
    return A.claims(spark, sf_dir).select("article", "claim", F.array_join("entities", ",").alias("entities"))


def family_key(spark, sf_dir):
    return A.claims(spark, sf_dir).groupBy("family").agg(F.count("*").alias("claims"), F.min("seen_at").alias("earliest_available_at"), F.min("article").alias("first_article"))


def claim_edges(spark, sf_dir):
    """Of each claim whether it is the first of its family, repeats a source or confirms from another."""
    w = Window.partitionBy("family").orderBy(F.asc_nulls_last("seen_at"), F.asc_nulls_last("article"))
    rows = A.claims(spark, sf_dir).withColumns({"k": F.row_number().over(w), "first_source": F.first("source").over(w)})
    return rows.select("article", "family", F.when(F.col("k") == 1, "new").when(F.col("source") == F.col("first_source"), "duplicate").otherwise("confirmation").alias("edge"))


def quantities(spark, sf_dir):
    q = A.articles(spark, sf_dir).select("article", F.explode(F.array_distinct(X.quantities("text"))).alias("raw"))
    return q.select("article", "raw", X.quantity_unit(F.col("raw")).alias("unit"))


def raw_hashes(spark, sf_dir):
    """SHA-256 of every page's bytes, and how many have it."""
    return table(spark, sf_dir, "pages").groupBy(F.sha2(F.coalesce("html", F.lit("")), 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


def article_text(spark, sf_dir):
    """Plain text of pages: scripts, styles and comments out, tags to spaces, character references decoded."""
    t = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = F.replace(t, F.lit(ref), F.lit(char))
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(t, r"\s+", " ")).alias("text"))


def ols_clustered(spark, sf_dir):
    r = S.ols_clustered(lines(spark, sf_dir), XS, "y", "l_suppkey", "l_returnflag")
    return spark.createDataFrame([(n, float(b), float(s)) for n, b, s in zip(["intercept", *XS], r["beta"], r["se"], strict=True)], "term string, beta double, se double")


def logit_fit(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("label", F.when(F.col("l_quantity") + F.col("y") / 3 + F.col("l_orderkey") % 17 > 45, 1).otherwise(-1))
    m = S.logistic(rows, XS, "label")
    return spark.createDataFrame([(n, float(w)) for n, w in zip(["intercept", *XS], m["weights"], strict=True)], "term string, weight double")


def bootstrap_ci(spark, sf_dir):
    """The mean of y with a percentile interval from 100 draws of whole suppliers."""
    return rounded(S.cluster_bootstrap(lines(spark, sf_dir), "l_suppkey", "y", draws=100), 6)


def wild_bootstrap(spark, sf_dir):
    p = S.wild_cluster_p(lines(spark, sf_dir), XS, "y", 2, "l_suppkey", draws=99)
    return spark.createDataFrame([(float(p),)], "p double")


def nested_models(spark, sf_dir):
    """Log losses of nested models on the last of four chronological folds, trained on those before."""
    rows = lines(spark, sf_dir).withColumn("label", F.when(F.col("l_quantity") + F.col("y") / 3 + F.col("l_orderkey") % 17 > 45, 1).otherwise(-1))
    rows = stored(S.folds(rows.withColumn("tie", F.xxhash64("l_orderkey", *XS, "y")), "ts", "tie", 4).select(*XS, "label", "fold"), "folds")
    models = S.logistics(rows.where("fold < 3"), [XS[:k] for k in range(1, len(XS) + 1)], "label", rounds=8, keep=False)
    chance = [F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), S.predict(m))) for m in models]
    losses = rows.where("fold = 3").agg(*[F.avg(-F.ln(F.when(F.col("label") == 1, p).otherwise(F.lit(1.0) - p))).alias(f"l{i}") for i, p in enumerate(chance)]).first()
    out = [(f"M{i}", ",".join(m["names"]), float(losses[f"l{i}"])) for i, m in enumerate(models)]
    return spark.createDataFrame(out, "model string, features string, log_loss double")


_L = "l AS (SELECT l_orderkey, l_suppkey, l_quantity, l_discount, l_tax, l_extendedprice / 1000 AS y, l_returnflag FROM lineitem)"
_P = "p AS (SELECT l_quantity / 51 AS p, CASE l_returnflag WHEN 'A' THEN 1 ELSE -1 END AS label FROM lineitem)"
_V = ["1.0", *XS]
_KM = "k AS (SELECT vec_id, label, {} AS d FROM embeddings), a AS (SELECT vec_id, label, list_position(d, list_min(d)) - 1 AS cluster, list_min(d) AS inertia FROM k)".format("[" + ", ".join(f"list_sum(list_transform(list_zip(embedding, {c}), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2)))" for c in CENTERS) + "]")
ORACLE = {
    "within_demean": f"WITH {_L}, d AS (SELECT l_suppkey, y - avg(y) OVER w AS y, l_quantity - avg(l_quantity) OVER w AS q FROM l WINDOW w AS (PARTITION BY l_suppkey)) SELECT l_suppkey, count(*) AS n, round(sum(y * q), 3) AS syq, round(sum(y * y), 3) AS syy FROM d GROUP BY l_suppkey",
    "ols_moments": f"WITH {_L} SELECT count(*) AS n, " + ", ".join([f"round(sum({_V[i]} * {_V[j]})::DOUBLE, 3) AS xx_{i}_{j}" for i in range(4) for j in range(i, 4)] + [f"round(sum({_V[i]} * y), 3) AS xy_{i}" for i in range(4)]) + " FROM l",
    "cluster_meat": f"WITH {_L} SELECT l_suppkey, " + ", ".join(f"round(sum({v} * (y - (1.0::DOUBLE + 2 * l_quantity - 0.5 * l_discount + 0.25 * l_tax))), 4) AS s{i}" for i, v in enumerate(_V)) + " FROM l GROUP BY l_suppkey",
    "calibration_bins": f"WITH {_P} SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg((label = 1)::INT), 9) AS rate FROM p GROUP BY bin",
    "prediction_metrics": f"WITH {_P}, c AS (SELECT *, greatest(1e-12, least(1 - 1e-12, p)) AS c, (label + 1) / 2.0::DOUBLE AS y FROM p) SELECT round(avg(pow(p - y, 2)), 9) AS brier, round(avg(-(y * ln(c) + (1 - y) * ln(1 - c))), 9) AS log_loss, round(avg(((p >= 0.5) = (label = 1))::INT), 9) AS accuracy FROM c",
    "kappa": "WITH s AS (SELECT count(*) AS n, avg((quality = toxic)::INT) AS po, avg(quality) AS a, avg(toxic) AS b FROM labels), t AS (SELECT *, a * b + (1 - a) * (1 - b) AS pe FROM s) SELECT n, round(po, 9) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 9) AS kappa FROM t",
    "confusion": "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS n_f, count(*) FILTER (l_linestatus = 'O') AS n_o FROM lineitem GROUP BY l_returnflag",
    "kmeans_assign": f"WITH {_KM} SELECT vec_id, label, CAST(cluster AS INT) AS cluster, round(inertia, 5) AS inertia FROM a",
    "cluster_contingency": f"WITH {_KM}, t AS (SELECT cluster, label, count(*) AS n FROM a GROUP BY ALL), u AS (SELECT *, n / sum(n) OVER (PARTITION BY cluster) AS p FROM t) SELECT CAST(cluster AS INT) AS cluster, CAST(sum(n) AS BIGINT) AS n, round(max(p), 9) AS purity, round(-sum(p * ln(p)), 9) + 0.0::DOUBLE AS entropy FROM u GROUP BY cluster",
    "fold_assignment": "SELECT event_id, CAST(ntile(7) OVER (ORDER BY floor(epoch_us(ts)/1e6), event_id) - 1 AS INT) AS fold FROM events",
    "placebo_lead": "SELECT event_id, user_id, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS placebo FROM events",
    "placebo_permutation": "WITH a AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), b AS (SELECT user_id, value AS placebo, row_number() OVER (PARTITION BY user_id ORDER BY md5('p:' || event_id), event_id) AS k FROM events) SELECT event_id, placebo FROM a JOIN b USING (user_id, k)",
    "stratified_sample": "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('batch:' || doc_id), doc_id) AS place FROM documents) SELECT * FROM r ORDER BY place, lang, doc_id LIMIT 60",
    "dominant_channel": "SELECT CASE WHEN a >= b AND a >= c THEN 'actor' WHEN b >= c THEN 'market' ELSE 'news' END AS channel, count(*) AS n FROM (SELECT abs(l_quantity) / 50 AS a, abs(l_discount) / 0.1::DOUBLE AS b, abs(l_tax) / 0.08::DOUBLE AS c FROM lineitem) GROUP BY channel",
    "claims": duck("articles", "claims") + "SELECT article, claim, array_to_string(entities, ',') AS entities FROM claims",
    "family_key": duck("articles", "claims") + "SELECT family, count(*) AS claims, min(seen_at) AS earliest_available_at, min(article) AS first_article FROM claims GROUP BY family",
    "claim_edges": duck("articles", "claims") + "SELECT article, family, CASE WHEN row_number() OVER w = 1 THEN 'new' WHEN source = first_value(source) OVER w THEN 'duplicate' ELSE 'confirmation' END AS edge FROM claims WINDOW w AS (PARTITION BY family ORDER BY seen_at, article)",
    "quantities": duck("articles") + r", q AS (SELECT article, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '(\d+(?:\.\d+)?%?)', 1))) AS raw FROM articles) SELECT article, raw, CASE WHEN contains(raw, '%') THEN 'percent' END AS unit FROM q",
    "raw_hashes": "SELECT sha256(coalesce(html, '')) AS content_hash, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY content_hash",
    "bootstrap_ci": f"""WITH {_L}, g AS (SELECT l_suppkey AS g, sum(y) AS s, count(y) AS n FROM l GROUP BY ALL), d AS (SELECT s, n, 4 * block + part AS draw, substr(md5('boot:' || g || ':' || block), CAST(1 + 8 * part AS BIGINT), 8) AS hex FROM g, range(25) b(block), range(4) p(part)),
        w AS (SELECT draw, sum(({' + '.join(f"(hex >= '{x}')::INT" for x in S._POISSON)}) * s) / sum(({' + '.join(f"(hex >= '{x}')::INT" for x in S._POISSON)}) * n) AS m FROM d GROUP BY draw) SELECT round((SELECT sum(s) / sum(n) FROM g), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, (SELECT count(*) FROM g) AS clusters FROM w""",
}
_ROWS = ("article_text", "ols_clustered", "logit_fit", "wild_bootstrap", "nested_models")
QUERIES = {k: globals()[k] for k in (*ORACLE, *_ROWS)}

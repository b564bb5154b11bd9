"""Metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terradelta.operators import metrics as M
from terradelta.operators.quantiles import quantiles
from terradelta.plans.registry import query



def hard():
    return F.col("prob") >= 0.5


def gt():
    return F.col("gt")


_CONF = ", z AS (SELECT count(*) FILTER (prob >= 0.5 AND gt = 1) AS tp, count(*) FILTER (prob >= 0.5 AND gt <> 1) AS fp, count(*) FILTER (prob < 0.5 AND gt = 1) AS fn, count(*) FILTER (prob < 0.5 AND gt <> 1) AS tn FROM px WHERE gt <> 255)"
_SCORES = "round({a}, 6) AS precision, round({b}, 6) AS recall, round({c}, 6) AS f1, round({d}, 6) AS iou, round({e}, 6) AS accuracy"


def _scores_sql(eps: str = "1e-9", style: str = "den") -> str:
    def r(a: str, b: str) -> str:
        if style == "exact":
            return f"CASE WHEN {b} = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END"
        return f"(({a}) + {eps}::DOUBLE) / (({b}) + {eps}::DOUBLE)" if style == "both" else f"({a})::DOUBLE / (({b}) + {eps}::DOUBLE)"

    return _SCORES.format(a=r("tp", "tp + fp"), b=r("tp", "tp + fn"), c=r("2 * tp", "2 * tp + fp + fn"), d=r("tp", "tp + fp + fn"), e=r("tp + tn", "tp + fp + fn + tn"))


query("confusion_binary", "px", _CONF + "SELECT * FROM z")(lambda px: M.confusion(px, hard(), gt()))
query("binary_metrics", "px", _CONF + f"SELECT {_scores_sql()} FROM z")(lambda px: M.confusion(px, hard(), gt()).select(*M.binary_scores()))
query("sk_binary_scores", "px", _CONF + f"SELECT precision, recall, f1 FROM (SELECT {_scores_sql(style='exact')} FROM z)")(lambda px: M.confusion(px, hard(), gt()).select(*M.binary_scores(style="exact")).select("precision", "recall", "f1"))
query("f1_threshold", "px", _CONF + f"SELECT f1 FROM (SELECT {_scores_sql('1e-8')} FROM z)")(lambda px: M.confusion(px, hard(), gt()).select(*M.binary_scores(1e-8)).select("f1"))

_MATRIX = ", m AS (SELECT g AS gt, p AS pred, count(c.pred) AS n FROM (SELECT unnest(range(4))::INT AS g), (SELECT unnest(range(4))::INT AS p) LEFT JOIN cls_px c ON c.label = g AND c.pred = p GROUP BY ALL)"
query("confusion_matrix", "cls_px", ", a AS (SELECT unnest(range(4))::INT AS g), b AS (SELECT a.g, x.g AS p FROM a, a x) SELECT g AS gt, p AS pred, count(c.pred) AS n FROM b LEFT JOIN cls_px c ON c.label = g AND c.pred = p GROUP BY ALL")(lambda px: M.confusion_matrix(px, "pred", "label", [0, 1, 2, 3]))

_CLASS = """, k AS (SELECT unnest(range(4))::INT AS cls), z AS (SELECT cls, count(*) FILTER (pred = cls AND label = cls) AS inter, count(*) FILTER (pred = cls) AS n_pred, count(*) FILTER (label = cls) AS n_gt
 FROM k, cls_px WHERE label <> 255 GROUP BY cls),
s AS (SELECT cls, round(CASE WHEN n_pred = 0 THEN 0.0 ELSE inter::DOUBLE / n_pred END, 6) AS precision, round(CASE WHEN n_gt = 0 THEN 0.0 ELSE inter::DOUBLE / n_gt END, 6) AS recall,
 round(CASE WHEN n_pred + n_gt = 0 THEN 0.0 ELSE 2.0::DOUBLE * inter / (n_pred + n_gt) END, 6) AS f1, round(CASE WHEN n_pred + n_gt - inter = 0 THEN 0.0 ELSE inter::DOUBLE / (n_pred + n_gt - inter) END, 6) AS iou, n_gt AS support FROM z)"""
CLASSES = [0, 1, 2, 3]


def _counts(px):
    return M.class_counts(px, "pred", "label", CLASSES)


@query("class_report", "cls_px", _CLASS + """SELECT cls::VARCHAR AS name, precision, recall, f1, support FROM s
UNION ALL SELECT 'macro', round(avg(precision), 5), round(avg(recall), 5), round(avg(f1), 5), sum(support)::BIGINT FROM s
UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 5), round(sum(recall * support) / sum(support), 5), round(sum(f1 * support) / sum(support), 5), sum(support)::BIGINT FROM s""")
def class_report(px):
    s = M.class_scores(_counts(px)).select(F.col("cls").cast("string").alias("name"), "precision", "recall", "f1", "support")
    names = ("precision", "recall", "f1")
    total = F.sum("support").alias("support")
    macro = s.agg(*[F.round(F.avg(c), 5).alias(c) for c in names], total).select(F.lit("macro").alias("name"), *names, "support")
    weighted = s.agg(*[F.round(F.sum(F.col(c) * F.col("support")) / F.sum("support"), 5).alias(c) for c in names], total).select(F.lit("weighted").alias("name"), *names, "support")
    return s.unionByName(macro).unionByName(weighted)


@query("class_iou", "cls_px", _CLASS + "SELECT cls::VARCHAR AS name, iou, support FROM s UNION ALL SELECT 'overall', round(avg(iou), 5), sum(support)::BIGINT FROM s")
def class_iou(px):
    s = M.class_scores(_counts(px)).select(F.col("cls").cast("string").alias("name"), "iou", "support")
    return s.unionByName(s.agg(F.round(F.avg("iou"), 5).alias("iou"), F.sum("support").alias("support")).select(F.lit("overall").alias("name"), "iou", "support"))


# reduce_zero_label: label 0 is ignored, the others move down by one; predictions are of the reduced classes.
_REDUCED = """, y AS (SELECT pred, CASE WHEN label IN (0, 255) THEN 255 ELSE label - 1 END AS label FROM cls_px), k AS (SELECT unnest(range(3))::INT AS cls),
z AS (SELECT cls, count(*) FILTER (pred = cls AND label = cls) AS i, count(*) FILTER (pred = cls) AS p, count(*) FILTER (label = cls) AS g FROM k, y WHERE label <> 255 GROUP BY cls)"""


def _reduced(px):
    label = F.when(F.col("label").isin(0, 255), 255).otherwise(F.col("label") - 1)
    return M.class_counts(px.withColumn("label", label), "pred", "label", [0, 1, 2]).select("cls", F.col("inter").cast("double").alias("i"), F.col("n_pred").cast("double").alias("p"), F.col("n_gt").cast("double").alias("g"))


EPS = 1e-7
query("seg_miou", "cls_px", _REDUCED + "SELECT cls, round(i / g, 6) AS acc, round((i + 1e-7::DOUBLE) / (p + g - i + 1e-7::DOUBLE), 6) AS iou, round(sum(i) OVER () / sum(g) OVER (), 6) AS all_acc FROM z")(
    lambda px: _reduced(px).select("cls", F.round(F.col("i") / F.col("g"), 6).alias("acc"), F.round((F.col("i") + EPS) / (F.col("p") + F.col("g") - F.col("i") + EPS), 6).alias("iou"), F.round(F.sum("i").over(Window.partitionBy()) / F.sum("g").over(Window.partitionBy()), 6).alias("all_acc"))
)
query("seg_mdice", "cls_px", _REDUCED + "SELECT cls, round(2 * i / (p + g), 6) AS dice, round(i / g, 6) AS acc FROM z")(lambda px: _reduced(px).select("cls", F.round(2 * F.col("i") / (F.col("p") + F.col("g")), 6).alias("dice"), F.round(F.col("i") / F.col("g"), 6).alias("acc")))
query("seg_mfscore", "cls_px", _REDUCED + "SELECT cls, round(i / p, 6) AS precision, round(i / g, 6) AS recall, round(5 * (i / p) * (i / g) / (4 * (i / p) + i / g), 6) AS fscore FROM z")(
    lambda px: _reduced(px).select("cls", F.round(F.col("i") / F.col("p"), 6).alias("precision"), F.round(F.col("i") / F.col("g"), 6).alias("recall"), F.round(5 * (F.col("i") / F.col("p")) * (F.col("i") / F.col("g")) / (4 * (F.col("i") / F.col("p")) + F.col("i") / F.col("g")), 6).alias("fscore"))
)

_THR = ", z AS (SELECT scene_id, sum(CASE WHEN prob > 0.5 AND gt = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN prob > 0.5 THEN 1 ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN gt = 1 THEN 1 ELSE 0 END)::DOUBLE AS g, sum(CASE WHEN (prob > 0.5) = (gt = 1) THEN 1 ELSE 0 END)::DOUBLE AS eq, count(*)::DOUBLE AS n FROM px WHERE gt <> 255 GROUP BY scene_id)"
_E = "1e-7::DOUBLE"
THRESHOLDED = {  # name: (SQL, column) over tp, p, g, eq, n
    "thr_iou": (f"(tp + {_E}) / (g + p - tp + {_E})", lambda tp, p, g, eq, n: (tp + EPS) / (g + p - tp + EPS)),
    "thr_fscore": (f"(2 * tp + {_E}) / (p + g + {_E})", lambda tp, p, g, eq, n: (2 * tp + EPS) / (p + g + EPS)),
    "thr_accuracy": ("eq / n", lambda tp, p, g, eq, n: eq / n),
    "thr_precision": (f"(tp + {_E}) / (p + {_E})", lambda tp, p, g, eq, n: (tp + EPS) / (p + EPS)),
    "thr_recall": (f"(tp + {_E}) / (g + {_E})", lambda tp, p, g, eq, n: (tp + EPS) / (g + EPS)),
    "thr_dice": (f"2 * tp / (p + g + {_E})", lambda tp, p, g, eq, n: 2 * tp / (p + g + EPS)),
    "thr_kappa": (f"(eq / n - (p * g + (n - p) * (n - g)) / (n * n)) / (1 - (p * g + (n - p) * (n - g)) / (n * n) + {_E})", lambda tp, p, g, eq, n: (eq / n - (p * g + (n - p) * (n - g)) / (n * n)) / (1 - (p * g + (n - p) * (n - g)) / (n * n) + EPS)),
}


def _thr_sums(px):
    hard, pos, d = F.col("prob") > 0.5, F.col("gt") == 1, "double"
    return px.where("gt <> 255").groupBy("scene_id").agg(M.n_if(hard & pos).cast(d).alias("tp"), M.n_if(hard).cast(d).alias("p"), M.n_if(pos).cast(d).alias("g"), M.n_if(hard == pos).cast(d).alias("eq"), F.count("*").cast(d).alias("n"))


for _name, (_sql, _make) in THRESHOLDED.items():
    query(_name, "px", _THR + f"SELECT scene_id, round({_sql}, 6) AS score FROM z")(lambda px, make=_make: _thr_sums(px).select("scene_id", F.round(make(*[F.col(c) for c in ("tp", "p", "g", "eq", "n")]), 6).alias("score")))

query("nan_fill", "chip_px", "SELECT chip_id, band, r, c, CASE WHEN isnan(v0) THEN -1 ELSE round(v0, 6) END AS v0 FROM chip_px")(lambda px: px.select("chip_id", "band", "r", "c", F.nanvl(F.round("v0", 6), F.lit(-1.0)).alias("v0")))


@query("per_sample_metrics", "px", ", z AS (SELECT scene_id, count(*) FILTER (gt <> 255) AS valid, count(*) FILTER (prob >= 0.5 AND gt = 1) AS tp, count(*) FILTER (prob >= 0.5 AND gt = 0) AS fp, count(*) FILTER (prob < 0.5 AND gt = 1) AS fn FROM px GROUP BY scene_id) SELECT scene_id, valid, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(tp::DOUBLE / nullif(tp + fp + fn, 0), 6) AS iou FROM z")
def per_sample_metrics(px):
    z = px.groupBy("scene_id").agg(M.n_if(gt() != 255).alias("valid"), M.n_if(hard() & (gt() == 1)).alias("tp"), M.n_if(hard() & (gt() == 0)).alias("fp"), M.n_if(~hard() & (gt() == 1)).alias("fn"))
    return z.select("scene_id", "valid", F.expr("round(try_divide(2D * tp, 2 * tp + fp + fn), 6)").alias("f1"), F.expr("round(try_divide(cast(tp as double), tp + fp + fn), 6)").alias("iou"))


_SWEEP = f""", t AS (SELECT unnest(range(1, 100)) AS k), q AS (SELECT least(99, floor(prob * 100 + 1e-6))::BIGINT AS b, gt FROM px WHERE gt <> 255),
s AS (SELECT round(k / 100.0::DOUBLE, 2) AS thr, count(*) FILTER (b >= k AND gt = 1) AS tp, count(*) FILTER (b >= k AND gt <> 1) AS fp, count(*) FILTER (b < k AND gt = 1) AS fn, count(*) FILTER (b < k AND gt <> 1) AS tn FROM t, q GROUP BY k),
w AS (SELECT thr, tp, fp, fn, tn, {_scores_sql()} FROM s)"""
query("threshold_sweep", "px", _SWEEP + "SELECT * FROM w")(lambda px: M.sweep(px, "prob", "gt"))
query("best_threshold", "px", _SWEEP + "SELECT thr, f1 FROM w ORDER BY f1 DESC, thr LIMIT 5")(lambda px: M.sweep(px, "prob", "gt").select("thr", "f1").orderBy(F.col("f1").desc(), "thr").limit(5))

query("prob_stats", "px", "SELECT scene_id, min(prob) AS lo, max(prob) AS hi, round(avg(prob), 6) AS mean, round(quantile_cont(prob, 0.5), 6) AS median, count(*) FILTER (prob > 0.2) AS n20, count(*) FILTER (prob > 0.3) AS n30, count(*) FILTER (prob > 0.5) AS n50, round(avg((prob > 0.5)::INT), 6) AS share FROM px GROUP BY scene_id")(
    lambda px: scene_stats(px)
)


def scene_stats(px, value="prob", cuts=(20, 30, 50)):
    """Figures of each scene; the median by radix selection, the rest in one pass."""
    v = F.col(value)
    sums = px.groupBy("scene_id").agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.round(F.avg(v), 6).alias("mean"), *[M.n_if(v > t / 100).alias(f"n{t}") for t in cuts], F.round(F.avg((v > 0.5).cast("int")), 6).alias("share"))
    return sums.join(quantiles(px, ["scene_id"], value, [0.5]).select("scene_id", F.round(F.col("q")[0], 6).alias("median")), "scene_id")


query("prob_stats_global", "px", "SELECT count(*) AS n, min(prob) AS lo, max(prob) AS hi, round(avg(prob), 6) AS mean, round(stddev_samp(prob), 6) AS std, round(quantile_cont(prob, 0.25), 6) AS q25, round(quantile_cont(prob, 0.5), 6) AS q50, round(quantile_cont(prob, 0.75), 6) AS q75, round(100 * avg((prob > 0.5)::INT), 6) AS pct50 FROM px")(
    lambda px: global_stats(px)
)

def global_stats(px, value="prob", quantiles=(25, 50, 75)):
    """Figures over all pixels: values are counted first, to six decimals, so that quantiles need the counts only, of which
    a value in [0, 1] has a million at most."""
    counts = px.groupBy(F.round(value, 6).alias("v")).agg(F.count("*").alias("k"))
    v, k = F.col("v"), F.col("k")
    mean = F.sum(v * k) / F.sum(k)
    deviation = F.sqrt((F.sum(v * v * k) - F.sum(v * k) * mean) / (F.sum(k) - 1))
    at = F.percentile("v", F.array(*[F.lit(q / 100) for q in quantiles]), k)
    one = counts.agg(F.sum("k").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.round(mean, 6).alias("mean"), F.round(deviation, 6).alias("std"), at.alias("q"), F.round(100 * F.sum(F.when(v > 0.5, k).otherwise(0)) / F.sum(k), 6).alias("pct50"))
    return one.select("n", "lo", "hi", "mean", "std", *[F.round(F.get("q", F.lit(i)), 6).alias(f"q{q}") for i, q in enumerate(quantiles)], "pct50")


query("split_counts", "chips", "SELECT split, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM chips GROUP BY split")(lambda chips: chips.groupBy("split").agg(F.count("*").alias("n")).withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6)))
query("dup_rows", "scene_items", "SELECT coalesce(sum(n - 1), 0)::BIGINT AS n_duplicates FROM (SELECT count(*) AS n FROM scene_items GROUP BY id, collection, source_endpoint)")(lambda items: items.groupBy("id", "collection", "source_endpoint").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates")))

_STATS = ", m AS (SELECT scene_id, count(*) AS total, count(*) FILTER (gt = 1) AS pos, count(*) FILTER (gt = 255) AS ign, count(*) FILTER (gt <> 255) AS valid, bool_or(gt = 1) AS has_pos, round(count(*) FILTER (gt = 1)::DOUBLE / greatest(count(*) FILTER (gt <> 255), 1), 6) AS positive_ratio, list_sort(list(DISTINCT gt)) AS vals FROM px GROUP BY scene_id)"


def mask_stats(px):
    pos, valid = M.n_if(gt() == 1), M.n_if(gt() != 255)
    return px.groupBy("scene_id").agg(F.count("*").alias("total"), pos.alias("pos"), M.n_if(gt() == 255).alias("ign"), valid.alias("valid"), F.bool_or(gt() == 1).alias("has_pos"), F.round(pos.cast("double") / F.greatest(valid, F.lit(1)), 6).alias("positive_ratio"), F.array_join(F.sort_array(F.collect_set("gt")), ",").alias("vals"))


query("mask_stats", "px", _STATS + "SELECT * REPLACE (array_to_string(vals, ',') AS vals) FROM m")(mask_stats)
query("dataset_pixel_stats", "px", _STATS + "SELECT sum(total)::BIGINT AS total, sum(pos)::BIGINT AS pos, sum(ign)::BIGINT AS ign, count(*) FILTER (has_pos) AS with_change, min(pos) AS lo, max(pos) AS hi, round(avg(pos), 6) AS mean, CASE WHEN sum(pos) = 0 THEN 'empty' WHEN sum(pos) < 0.001 * sum(valid) THEN 'sparse' ELSE 'healthy' END AS verdict FROM m")(
    lambda px: mask_stats(px).agg(F.sum("total").alias("total"), F.sum("pos").alias("pos"), F.sum("ign").alias("ign"), M.n_if(F.col("has_pos")).alias("with_change"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.round(F.avg("pos"), 6).alias("mean"), F.when(F.sum("pos") == 0, "empty").when(F.sum("pos") < 0.001 * F.sum("valid"), "sparse").otherwise("healthy").alias("verdict"))
)
query("label_value_freq", "px", "SELECT gt AS value, count(DISTINCT scene_id) AS n_files, gt NOT IN (0, 1, 255) AS unexpected FROM px GROUP BY gt ORDER BY n_files DESC, value LIMIT 20")(
    lambda px: px.select("scene_id", "gt").distinct().groupBy(F.col("gt").alias("value")).agg(F.count("*").alias("n_files")).withColumn("unexpected", ~F.col("value").isin(0, 1, 255)).orderBy(F.col("n_files").desc(), "value").limit(20)
)
query("shape_hist", "px", "SELECT h, w, count(*) AS n FROM (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM px GROUP BY scene_id) GROUP BY ALL")(lambda px: px.groupBy("scene_id").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w")).groupBy("h", "w").agg(F.count("*").alias("n")))
query("class_weights", "px", "SELECT round(least(greatest(sqrt(count(*)::DOUBLE / greatest(count(*) FILTER (gt = 0), 1)), 1e-6), 10.0), 6) AS w0, round(least(greatest(sqrt(count(*)::DOUBLE / greatest(count(*) FILTER (gt = 1), 1)), 1e-6), 10.0), 6) AS w1 FROM px WHERE gt <> 255")(
    lambda px: px.where("gt <> 255").agg(*[F.round(F.least(F.greatest(F.sqrt(F.count("*") / F.greatest(M.n_if(gt() == k), F.lit(1))), F.lit(1e-6)), F.lit(10.0)), 6).alias(f"w{k}") for k in (0, 1)])
)

_VALID = ", v AS (SELECT scene_id, r, c, prob AS p, gt::DOUBLE AS g FROM px WHERE gt <> 255)"


def _valid(px):
    return px.where("gt <> 255").select("scene_id", "r", "c", F.col("prob").alias("p"), F.col("gt").cast("double").alias("g"))




def p():
    return F.col("p")


def g():
    return F.col("g")


query("soft_scores", "px", _VALID + ", s AS (SELECT scene_id, sum(p * g) AS i, sum(p) AS p, sum(g) AS g FROM v GROUP BY scene_id) SELECT scene_id, round(1 - 2 * i / greatest(p + g, 1e-7), 6) AS dice_loss, round(1 - i / greatest(p + g - i, 1e-7), 6) AS jaccard_loss, round(1 - i / greatest(i + 0.3::DOUBLE * (p - i) + 0.7::DOUBLE * (g - i), 1e-7), 6) AS tversky_loss FROM s")(
    lambda px: M.soft_sums(_valid(px), p(), g(), "scene_id").select("scene_id", *M.soft_scores())
)
query("masked_error", "px", "SELECT scene_id, round(sum(CASE WHEN gt <> 255 THEN (prob - gt) * (prob - gt) ELSE 0 END) / greatest(count(*) FILTER (gt <> 255), 1), 6) AS mse, round(sum(CASE WHEN gt <> 255 THEN abs(prob - gt) ELSE 0 END) / greatest(count(*) FILTER (gt <> 255), 1), 6) AS l1 FROM px GROUP BY scene_id")(
    lambda px: px.groupBy("scene_id").agg(*[F.round(F.sum(F.when(gt() != 255, e).otherwise(0.0)) / F.greatest(M.n_if(gt() != 255), F.lit(1)), 6).alias(n) for e, n in (((F.col("prob") - gt()) * (F.col("prob") - gt()), "mse"), (F.abs(F.col("prob") - gt()), "l1"))])
)
_FOCAL = """, t AS (SELECT scene_id, p, g, greatest(CASE WHEN g = 1 THEN p ELSE 1 - p END, 1e-9) AS pt, CASE WHEN g = 1 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END AS a FROM v)
SELECT scene_id, round(avg(-a * pow(1 - pt, 2) * ln(pt)), 5) AS focal, round(avg(-a * CASE WHEN pt < 0.5 THEN 1 ELSE pow((1 - pt) / 0.5, 2) END * ln(pt)), 5) AS reduced,
round(avg(-a * pow(1 - pt, 2) * ln(pt)) / greatest(sum(pow(1 - pt, 2)), 1e-6), 7) AS normalized, round(1 - 2 * sum(p * g) / greatest(sum(p) + sum(g), 1e-7) + avg(-a * pow(1 - pt, 2) * ln(pt)), 5) AS dice_focal FROM t GROUP BY scene_id"""
query("focal_score", "px", _VALID + _FOCAL)(
    lambda px: _valid(px).groupBy("scene_id").agg(F.round(F.avg(M.focal(p(), g())), 5).alias("focal"), F.round(F.avg(M.focal(p(), g(), reduced=0.5)), 5).alias("reduced"), F.round(M.normalized_focal(p(), g()), 7).alias("normalized"), F.round(M.dice_focal(p(), g()), 5).alias("dice_focal"))
)
query("smoothed_bce", "px", _VALID + ", y AS (SELECT scene_id, g * 0.9::DOUBLE + 0.05::DOUBLE AS y, least(greatest(p, 1e-7), 1 - 1e-7::DOUBLE) AS q FROM v) SELECT scene_id, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 5) AS bce FROM y GROUP BY scene_id")(lambda px: _valid(px).groupBy("scene_id").agg(F.round(F.avg(M.smoothed_bce(p(), g())), 5).alias("bce")))
query("contrastive_score", "px", _VALID + "SELECT round(sum(CASE WHEN g = 0 THEN p * p ELSE 0 END) / (count(*) FILTER (g = 0) + 1e-9::DOUBLE) + sum(CASE WHEN g = 1 THEN pow(greatest(2 - p, 0), 2) ELSE 0 END) / (count(*) FILTER (g = 1) + 1e-9::DOUBLE), 6) AS contrastive FROM v")(
    lambda px: _valid(px).agg(F.round(F.sum(F.when(g() == 0, p() * p()).otherwise(0.0)) / (M.n_if(g() == 0) + 1e-9) + F.sum(F.when(g() == 1, F.pow(F.greatest(2 - p(), F.lit(0.0)), F.lit(2.0))).otherwise(0.0)) / (M.n_if(g() == 1) + 1e-9), 6).alias("contrastive"))
)
_LOVASZ = """, e AS (SELECT scene_id, 'flat' AS form, abs(g - p) AS err, g, r, c FROM v UNION ALL SELECT scene_id, 'hinge', 1 - (4 * p - 2) * (2 * g - 1), g, r, c FROM v
UNION ALL SELECT scene_id, 'soft0', abs((1 - g) - (1 - p)), 1 - g, r, c FROM v UNION ALL SELECT scene_id, 'soft1', abs(g - p), g, r, c FROM v),
w AS (SELECT *, sum(g) OVER (PARTITION BY scene_id, form) AS t, sum(g) OVER o AS cg, sum(1 - g) OVER o AS cn FROM e WINDOW o AS (PARTITION BY scene_id, form ORDER BY err DESC, r, c ROWS UNBOUNDED PRECEDING)),
j AS (SELECT *, 1 - CASE WHEN t + cn = 0 THEN 0 ELSE (t - cg) / (t + cn) END AS jac FROM w),
l AS (SELECT scene_id, form, max(t) > 0 AS present, sum(d) AS x FROM (SELECT scene_id, form, t, greatest(err, 0) * (jac - coalesce(lag(jac) OVER (PARTITION BY scene_id, form ORDER BY err DESC, r, c), 0)) AS d FROM j) GROUP BY scene_id, form)
SELECT scene_id, round(max(x) FILTER (form = 'flat'), 6) AS lovasz, round(max(x) FILTER (form = 'hinge'), 6) AS hinge, round(avg(x) FILTER (form IN ('soft0', 'soft1') AND present), 6) AS softmax FROM l GROUP BY scene_id"""


@query("lovasz_score", "px", _VALID + _LOVASZ)
def lovasz_score(px):
    """The score of the probability, the hinge form of its logit, and the softmax form: the mean over the classes present."""
    forms = {"flat": (F.abs(g() - p()), g()), "hinge": (1 - (4 * p() - 2) * (2 * g() - 1), g()), "soft0": (F.abs((1 - g()) - (1 - p())), 1 - g()), "soft1": (F.abs(g() - p()), g())}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("form"), e.alias("error"), (fg == 1).alias("positive")) for k, (e, fg) in forms.items()])).alias("f")
    scored = M.lovasz(_valid(px).select("scene_id", each).select("scene_id", "f.*"), F.col("error"), F.col("positive"), "scene_id", "form")
    form, x = F.col("form"), F.col("lovasz")
    return scored.groupBy("scene_id").agg(F.round(F.max(F.when(form == "flat", x)), 6).alias("lovasz"), F.round(F.max(F.when(form == "hinge", x)), 6).alias("hinge"), F.round(F.avg(F.when(form.startswith("soft") & F.col("present"), x)), 6).alias("softmax"))

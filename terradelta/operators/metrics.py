"""Pixel metrics: each is one partial-and-final aggregation over pixels, and arithmetic on its few result rows.

Ground truth ``ignore`` (255) drops a pixel from every metric. Denominators follow a style: "den" adds eps below,
"both" adds eps above and below, "exact" gives 0 where the denominator is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

IGNORE = 255


def n_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def ratio(a: Column, b: Column, eps: float = 1e-9, style: str = "den") -> Column:
    if style == "exact":
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    return (a + eps) / (b + eps) if style == "both" else a / (b + eps)


def confusion(px: DataFrame, pred: Column, gt: Column, *keys: str, ignore: int = IGNORE) -> DataFrame:
    """tp, fp, fn, tn of positive predictions against gt = 1, for each key."""
    valid = px.where(gt != ignore)
    pos = gt == 1
    return valid.groupBy(*keys).agg(n_if(pred & pos).alias("tp"), n_if(pred & ~pos).alias("fp"), n_if(~pred & pos).alias("fn"), n_if(~pred & ~pos).alias("tn"))


def binary_scores(eps: float = 1e-9, style: str = "den") -> list[Column]:
    """precision, recall, f1, iou, accuracy over columns tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    each = {"precision": (tp, tp + fp), "recall": (tp, tp + fn), "f1": (2 * tp, 2 * tp + fp + fn), "iou": (tp, tp + fp + fn), "accuracy": (tp + tn, tp + fp + fn + tn)}
    return [F.round(ratio(a.cast("double"), b.cast("double"), eps, style), 6).alias(k) for k, (a, b) in each.items()]


def confusion_matrix(px: DataFrame, pred: str, gt: str, classes: list[int], ignore: int = IGNORE) -> DataFrame:
    """Counts of every (gt, pred) pair of the classes, absent pairs as 0."""
    counts = px.where(F.col(gt) != ignore).groupBy(gt, pred).agg(F.count("*").alias("n"))
    labels = F.array(*[F.lit(c) for c in classes])
    dense = px.sparkSession.range(1).select(F.explode(labels).alias(gt)).withColumn(pred, F.explode(labels))
    return dense.join(counts, [gt, pred], "left").select(F.col(gt).alias("gt"), F.col(pred).alias("pred"), F.coalesce("n", F.lit(0)).alias("n"))


def class_counts(px: DataFrame, pred: str, gt: str, classes: list[int], *keys: str, ignore: int = IGNORE, drop_ignored: bool = True) -> DataFrame:
    """Of each class: intersection, n_pred, n_gt. Without drop_ignored, predictions on ignored pixels count in n_pred."""
    rows = px.where(F.col(gt) != ignore) if drop_ignored else px
    hit = F.explode(F.array_distinct(F.array(F.col(pred).cast("int"), F.col(gt).cast("int")))).alias("cls")
    flat = rows.select(*keys, F.col(pred).alias("p"), F.col(gt).alias("g"), hit).where(F.col("cls").isin(classes))
    c = F.col("cls")
    counts = flat.groupBy(*keys, "cls").agg(n_if((F.col("p") == c) & (F.col("g") == c)).alias("inter"), n_if(F.col("p") == c).alias("n_pred"), n_if(F.col("g") == c).alias("n_gt"))
    if keys:
        return counts
    dense = px.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in classes])).alias("cls"))
    zero = F.lit(0).cast("long")
    return dense.join(counts, "cls", "left").select("cls", *[F.coalesce(k, zero).alias(k) for k in ("inter", "n_pred", "n_gt")])


def class_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall, f1 and IoU per class, 0 where undefined."""
    i, p, g = (F.col(c).cast("double") for c in ("inter", "n_pred", "n_gt"))
    score = lambda a, b: F.round(ratio(a, b, style="exact"), 6)
    return counts.select("cls", score(i, p).alias("precision"), score(i, g).alias("recall"), score(2 * i, p + g).alias("f1"), score(i, p + g - i).alias("iou"), F.col("n_gt").alias("support"))


def sweep(px: DataFrame, prob: str, gt: str, thresholds: int = 99, eps: float = 1e-9, ignore: int = IGNORE) -> DataFrame:
    """Scores at thresholds 0.01 .. 0.99 in one pass: pixels are counted by the number of thresholds they reach, and a
    reverse running sum over those at most 100 buckets gives every threshold's confusion."""
    step = thresholds + 1
    reached = F.least(F.lit(thresholds), F.floor(F.col(prob) * step + 1e-6)).cast("int")
    counts = px.where(F.col(gt) != ignore).groupBy(reached.alias("b")).agg(n_if(F.col(gt) == 1).alias("pos"), n_if(F.col(gt) != 1).alias("neg"))
    dense = px.sparkSession.range(0, step).select(F.col("id").cast("int").alias("b")).join(F.broadcast(counts), "b", "left").fillna(0, ["pos", "neg"])
    above = Window.orderBy("b").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    summed = dense.select("b", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n"))
    rows = summed.where("b >= 1").select((F.col("b") / step).alias("thr"), "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("n") - F.col("fp")).alias("tn"))
    return rows.select(F.round("thr", 2).alias("thr"), "tp", "fp", "fn", "tn", *binary_scores(eps))


def soft_sums(px: DataFrame, p: Column, g: Column, *keys: str) -> DataFrame:
    """Sums that the soft scores are made of: inter = sum(p g), sp = sum(p), sg = sum(g)."""
    return px.groupBy(*keys).agg(F.sum(p * g).alias("inter"), F.sum(p).alias("sp"), F.sum(g).alias("sg"))


def soft_scores(smooth: float = 0.0, eps: float = 1e-7, alpha: float = 0.3, beta: float = 0.7) -> list[Column]:
    """Soft Dice, Jaccard and Tversky losses (1 - score) over inter, sp, sg."""
    i, p, g = (F.col(c) for c in ("inter", "sp", "sg"))
    dice = (2 * i + smooth) / F.greatest(p + g + smooth, F.lit(eps))
    jaccard = (i + smooth) / F.greatest(p + g - i + smooth, F.lit(eps))
    tversky = (i + smooth) / F.greatest(i + alpha * (p - i) + beta * (g - i) + smooth, F.lit(eps))
    return [F.round(1 - x, 6).alias(n) for x, n in ((dice, "dice_loss"), (jaccard, "jaccard_loss"), (tversky, "tversky_loss"))]


def focal_term(p: Column, g: Column, gamma: float = 2.0, reduced: float | None = None, floor: float = 1e-9) -> Column:
    """How much a pixel counts in the focal error; with ``reduced``, all pixels below that confidence count 1."""
    pt = F.greatest(F.when(g == 1, p).otherwise(1 - p), F.lit(floor))
    if reduced is None:
        return F.pow(1 - pt, F.lit(gamma))
    return F.when(pt < reduced, 1.0).otherwise(F.pow((1 - pt) / reduced, F.lit(gamma)))


def focal(p: Column, g: Column, gamma: float = 2.0, alpha: float | None = 0.25, floor: float = 1e-9, reduced: float | None = None) -> Column:
    """Focal error of one pixel."""
    pt = F.greatest(F.when(g == 1, p).otherwise(1 - p), F.lit(floor))
    weight = F.lit(1.0) if alpha is None else F.when(g == 1, alpha).otherwise(1 - alpha)
    return -weight * focal_term(p, g, gamma, reduced, floor) * F.log(pt)


def normalized_focal(p: Column, g: Column, eps: float = 1e-6, **options) -> Column:
    """Aggregate: the focal errors' mean over the sum of the pixels' terms."""
    terms = {k: v for k, v in options.items() if k != "alpha"}
    return F.avg(focal(p, g, **options)) / F.greatest(F.sum(focal_term(p, g, **terms)), F.lit(eps))


def dice_focal(p: Column, g: Column, weight: float = 1.0, **options) -> Column:
    """Aggregate: soft Dice loss plus the mean focal error."""
    dice = 1 - 2 * F.sum(p * g) / F.greatest(F.sum(p) + F.sum(g), F.lit(1e-7))
    return dice + weight * F.avg(focal(p, g, **options))


def smoothed_bce(p: Column, g: Column, smooth: float = 0.1, floor: float = 1e-7) -> Column:
    """Binary cross-entropy of one pixel with labels drawn towards one half."""
    y = g * (1 - smooth) + 0.5 * smooth
    q = F.least(F.greatest(p, F.lit(floor)), F.lit(1 - floor))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def lovasz(px: DataFrame, error: Column, positive: Column, *keys: str, steps: int = 1_000_000) -> DataFrame:
    """keys, lovasz, present: errors in descending order times the gradient of the Jaccard index, and whether a pixel is
    positive; negative errors count 0.

    Pixels of equal error give the same sum in any order, so they are counted, after rounding errors to 1 / ``steps``, and
    only the counts of a key are ordered: no task sorts a scene's pixels. Rounding changes a score by half a step at most, as
    the gradient is not negative and adds up to 1 at most.
    """
    step = F.round(error * steps).cast("long").alias("step")
    counts = px.groupBy(*keys, step).agg(n_if(positive).alias("pos"), n_if(~positive).alias("neg"))
    w = Window.partitionBy(*keys).orderBy(F.col("step").desc())
    run, whole = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*keys)
    total = F.sum("pos").over(whole)
    union = total + F.sum("neg").over(run)
    jac = counts.withColumn("total", total).withColumn("jac", 1 - F.when(union == 0, 0.0).otherwise((total - F.sum("pos").over(run)) / union))
    part = F.greatest(F.col("step"), F.lit(0)) / steps * (F.col("jac") - F.coalesce(F.lag("jac").over(w), F.lit(0.0)))
    return jac.withColumn("part", part).groupBy(*keys).agg(F.sum("part").alias("lovasz"), (F.max("total") > 0).alias("present"))

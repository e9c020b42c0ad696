"""Queries of the metric and mislabel sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions import arrays as A
from revlens.operators import metrics as M
from revlens.operators import sampling
from revlens.plans.common import cleaned, r6, split_table
from revlens.plans.fixture_sql import FIXTURES, with_fixtures
from revlens.plans.registry import register
from revlens.sources import fixtures as fx

LABELS = [0, 1, 2, 3, 4]
DATASETS = ("hotels", "market", "restaurants")

FIXTURES["fx_eval"] = """
SELECT p.m, p.id AS review_id, p.y_true, p.y_pred, s.split, c.dataset_name, c.translated
FROM fx_predictions p JOIN fx_split s ON p.id = s.review_id JOIN fx_clean c ON p.id = c.review_id"""


def eval_table(spark, sf_dir) -> DataFrame:
    """Member predictions keyed by review, with split, dataset and translated flag."""
    p = fx.fx_predictions(spark, sf_dir).withColumnRenamed("id", "review_id")
    s = split_table(spark, sf_dir).select("review_id", "split")
    c = cleaned(spark, sf_dir).select("review_id", "dataset_name", "translated")
    return p.join(s, "review_id").join(c, "review_id").select(
        "m", "review_id", "y_true", "y_pred", "split", "dataset_name", "translated")


def conf_sql(t="y_true", p="y_pred", agg="count_if({c})") -> str:
    rows = []
    for a in LABELS:
        rows.append("[" + ", ".join(agg.format(c=f"{t} = {a} AND {p} = {b}") for b in LABELS) + "]")
    return "[" + ", ".join(rows) + "]"


@register("f13_confusion_matrix", with_fixtures(f"""
SELECT m, split, {conf_sql()} AS conf_matrix FROM fx_eval GROUP BY m, split"""))
def f13(spark, sf_dir):
    """5 x 5 confusion matrix per member and split (rows = truth)."""
    return M.confusion_matrix(eval_table(spark, sf_dir), ["m", "split"], LABELS)


F14_ROW = ("list_transform(r, lambda x: CASE WHEN list_sum(r) > 0 THEN x / list_sum(r) ELSE 0.0 END)")


@register("f14_confusion_normalized", with_fixtures(f"""
SELECT m, split, list_transform(cm, lambda r: {F14_ROW}) AS conf_matrix
FROM (SELECT m, split, {conf_sql()} AS cm FROM fx_eval GROUP BY m, split)"""))
def f14(spark, sf_dir):
    """Row-normalized confusion matrix."""
    return M.confusion_matrix(eval_table(spark, sf_dir), ["m", "split"], LABELS, normalize=True)


F15_SQL_BODY = """
WITH pc AS (SELECT {keys}, y_true, y_pred, count(*) AS n FROM {src} GROUP BY {keys}, y_true, y_pred),
cs AS (SELECT {keys}, c, sum(tp) AS tp, sum(st) AS st, sum(sp) AS sp FROM (
         SELECT {keys}, y_true AS c, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp, n AS st, 0 AS sp FROM pc
         UNION ALL SELECT {keys}, y_pred AS c, 0, 0, n FROM pc) GROUP BY {keys}, c)
SELECT {keys}, sum(st) AS n, round(sum(tp) / sum(st), 6) AS micro_f1, round(avg(2 * tp / (st + sp)), 6) AS macro_f1
FROM cs GROUP BY {keys}"""


@register("f15_f1_scores", with_fixtures(F15_SQL_BODY.format(keys="m, split", src="fx_eval")))
def f15(spark, sf_dir):
    """Micro F1 (accuracy) and macro F1 per member and split, from one count table."""
    pc = M.pair_counts(eval_table(spark, sf_dir), ["m", "split"])
    f = M.f1_scores(pc, ["m", "split"])
    return f.select("m", "split", "n", r6(F.col("micro_f1")).alias("micro_f1"), r6(F.col("macro_f1")).alias("macro_f1"))


F16_SRC = """(SELECT m, split, 'all' AS scope, 'all' AS value, y_true, y_pred FROM fx_eval
 UNION ALL SELECT m, split, 'dataset_name', dataset_name, y_true, y_pred FROM fx_eval
 UNION ALL SELECT m, split, 'translated', CAST(translated AS VARCHAR), y_true, y_pred FROM fx_eval)"""


@register("f16_f1_by_scopes", with_fixtures(F15_SQL_BODY.format(keys="m, split, scope, value", src=F16_SRC)))
def f16(spark, sf_dir):
    """F1 per member x split for all rows, per dataset and per translated flag (grouping sets)."""
    e = eval_table(spark, sf_dir)
    f = M.f1_by_scopes(e, keys=["m", "split"])
    return f.select("m", "split", "scope", "value", "n", r6(F.col("micro_f1")).alias("micro_f1"),
                    r6(F.col("macro_f1")).alias("macro_f1"))


F17_SRC = """(SELECT m AS trained_on, 'all_data' AS evaluated_on, split, y_true, y_pred FROM fx_eval
 UNION ALL SELECT m, dataset_name, split, y_true, y_pred FROM fx_eval)"""


@register("f17_metric_grid", with_fixtures(f"""
SELECT trained_on, evaluated_on, split, count(*) AS n, round(count_if(y_true = y_pred) / count(*), 6) AS f1_micro,
       {conf_sql()} AS conf_matrix
FROM {F17_SRC} GROUP BY trained_on, evaluated_on, split"""))
def f17(spark, sf_dir):
    """Trained-on x evaluated-on grid (all data and each dataset) with F1 and confusion matrix."""
    return M.metric_grid(eval_table(spark, sf_dir).withColumnRenamed("m", "trained_on"), LABELS)


def history(spark, sf_dir) -> DataFrame:
    """Per-epoch history of every member (F22), long form.

    Epoch e is scored on the rows with ``review_id % 10 = e`` (validation)
    and on all other rows (train); test metrics per dataset use the test
    split rows of that epoch's batch."""
    e = eval_table(spark, sf_dir).withColumn("epoch", (F.col("review_id") % 10).cast("int"))
    ok = (F.col("y_true") == F.col("y_pred")).cast("bigint")
    b = e.groupBy("m", "epoch").agg(F.sum(ok).alias("c"), F.count(F.lit(1)).alias("t"))
    tot = Window.partitionBy("m")
    b = b.select("m", "epoch", (F.col("c") / F.col("t")).alias("val_f1"),
                 ((F.sum("c").over(tot) - F.col("c")) / (F.sum("t").over(tot) - F.col("t"))).alias("train_f1"))
    test = (e.filter(F.col("split") == "test").groupBy("m", "epoch")
            .pivot("dataset_name", list(DATASETS)).agg(F.avg(ok.cast("double"))))
    test = test.select("m", "epoch", *[F.col(d).alias(f"test_{d}") for d in DATASETS])
    wide = b.join(test, ["m", "epoch"], "left")
    metrics = ["val_f1", "train_f1"] + [f"test_{d}" for d in DATASETS]
    stack = F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).cast("double").alias("value"))
                                for x in metrics]))
    return wide.select(F.col("m").alias("model"), "epoch", stack.alias("s")).select(
        "model", "epoch", "s.metric", "s.value")


HISTORY_SQL = """
WITH e AS (SELECT *, CAST(review_id % 10 AS INTEGER) AS epoch, CAST(y_true = y_pred AS BIGINT) AS ok FROM fx_eval),
b AS (SELECT m, epoch, sum(ok) AS c, count(*) AS t FROM e GROUP BY m, epoch),
bw AS (SELECT m, epoch, c / t AS val_f1, (sum(c) OVER (PARTITION BY m) - c) / (sum(t) OVER (PARTITION BY m) - t) AS train_f1 FROM b),
te AS (SELECT m, epoch, avg(CASE WHEN dataset_name = 'hotels' THEN ok END) AS test_hotels,
              avg(CASE WHEN dataset_name = 'market' THEN ok END) AS test_market,
              avg(CASE WHEN dataset_name = 'restaurants' THEN ok END) AS test_restaurants
       FROM e WHERE split = 'test' GROUP BY m, epoch),
wide AS (SELECT bw.*, te.test_hotels, te.test_market, te.test_restaurants FROM bw LEFT JOIN te ON bw.m = te.m AND bw.epoch = te.epoch)
"""


@register("f22_history_long", with_fixtures(HISTORY_SQL + """
SELECT m AS model, epoch, metric, round(value, 6) AS value FROM (
  SELECT m, epoch, 'val_f1' AS metric, val_f1 AS value FROM wide UNION ALL
  SELECT m, epoch, 'train_f1', train_f1 FROM wide UNION ALL
  SELECT m, epoch, 'test_hotels', test_hotels FROM wide UNION ALL
  SELECT m, epoch, 'test_market', test_market FROM wide UNION ALL
  SELECT m, epoch, 'test_restaurants', test_restaurants FROM wide)"""))
def f22(spark, sf_dir):
    """Epoch history accumulated as (model, epoch, metric, value) rows."""
    h = history(spark, sf_dir)
    return h.select("model", "epoch", "metric", r6(F.col("value")).alias("value"))


@register("f22_history_wide", with_fixtures(HISTORY_SQL + """
SELECT m AS model, epoch, round(val_f1, 6) AS val_f1, round(train_f1, 6) AS train_f1,
       round(test_hotels, 6) AS test_hotels, round(test_market, 6) AS test_market,
       round(test_restaurants, 6) AS test_restaurants FROM wide"""))
def f22w(spark, sf_dir):
    """The history pivoted to one column per metric."""
    h = history(spark, sf_dir)
    metrics = ["val_f1", "train_f1"] + [f"test_{d}" for d in DATASETS]
    w = h.groupBy("model", "epoch").pivot("metric", metrics).agg(F.first("value"))
    return w.select("model", "epoch", *[r6(F.col(x)).alias(x) for x in metrics])


@register("g05_early_stop", with_fixtures(HISTORY_SQL + """,
h AS (SELECT m AS model, epoch, val_f1,
             max(val_f1) OVER (PARTITION BY m ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best,
             max(val_f1) OVER (PARTITION BY m ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_best
      FROM wide),
i AS (SELECT *, sum(CASE WHEN prev_best IS NULL OR val_f1 > prev_best THEN 1 ELSE 0 END)
                  OVER (PARTITION BY model ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM h),
wt AS (SELECT *, row_number() OVER (PARTITION BY model, island ORDER BY epoch) - 1 AS wait FROM i),
st AS (SELECT model, coalesce(min(CASE WHEN wait >= 4 THEN epoch END), max(epoch)) AS stop_epoch FROM wt GROUP BY model),
be AS (SELECT wt.model, arg_min(wt.epoch, [-wt.val_f1, wt.epoch]) AS best_epoch FROM wt JOIN st ON wt.model = st.model
       WHERE wt.epoch <= st.stop_epoch GROUP BY wt.model)
SELECT wt.model, wt.epoch, round(wt.val_f1, 6) AS val_f1, round(wt.running_best, 6) AS running_best, wt.wait,
       st.stop_epoch, be.best_epoch
FROM wt JOIN st ON wt.model = st.model JOIN be ON wt.model = be.model"""))
def g05(spark, sf_dir):
    """Early-stop analysis of each history (patience 4, maximize val F1)."""
    h = history(spark, sf_dir).filter(F.col("metric") == "val_f1").select("model", "epoch", F.col("value").alias("val_f1"))
    r = M.early_stop(h, patience=4)
    return r.select("model", "epoch", r6(F.col("val_f1")).alias("val_f1"), r6(F.col("running_best")).alias("running_best"),
                    "wait", "stop_epoch", "best_epoch")


@register("f11_leaderboard", with_fixtures(HISTORY_SQL + """,
mx AS (SELECT m AS model, max(test_hotels) AS test_hotels, max(test_market) AS test_market,
              max(test_restaurants) AS test_restaurants FROM wide GROUP BY m)
SELECT model, round(test_hotels, 6) AS test_hotels, round(test_market, 6) AS test_market,
       round(test_restaurants, 6) AS test_restaurants,
       round((coalesce(test_hotels, 0) + coalesce(test_market, 0) + coalesce(test_restaurants, 0))
             / ((test_hotels IS NOT NULL)::INT + (test_market IS NOT NULL)::INT + (test_restaurants IS NOT NULL)::INT), 6) AS mean_test
FROM mx"""))
def f11(spark, sf_dir):
    """Leaderboard: best test metric per dataset and model, mean over datasets (nulls skipped)."""
    h = history(spark, sf_dir).filter(F.col("metric").startswith("test_"))
    mx = h.groupBy("model").pivot("metric", [f"test_{d}" for d in DATASETS]).agg(F.max("value"))
    cols = [f"test_{d}" for d in DATASETS]
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    present = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    return mx.select("model", *[r6(F.col(c)).alias(c) for c in cols], r6(total / present).alias("mean_test"))


def _loss_sql(target: str) -> dict[str, str]:
    p = "list_transform(range(0, 5), lambda k: CASE WHEN k = y_pred THEN 0.6 ELSE 0.1 END)"
    return {"p": p, "t": target}


@register("f23_losses", with_fixtures("""
WITH x AS (SELECT m, list_transform(range(0, 5), lambda k: CASE WHEN k = y_pred THEN 0.6 ELSE 0.1 END) AS p,
                  list_transform(range(0, 5), lambda k: CASE WHEN k = y_true THEN 1.0 ELSE 0.0 END) AS t,
                  list_transform(range(0, 5), lambda k: CASE WHEN k = y_true THEN 0.92 ELSE 0.02 END) AS ts
           FROM fx_predictions)
SELECT m,
  round(avg(-list_sum(list_transform(range(1, 6), lambda i: t[i] * ln(least(greatest(p[i], 1e-7), 1 - 1e-7))))), 6) AS cross_entropy,
  round(avg(-list_sum(list_transform(range(1, 6), lambda i: ts[i] * ln(least(greatest(p[i], 1e-7), 1 - 1e-7))))), 6) AS smoothed_cross_entropy,
  round(avg(list_sum(list_transform(range(1, 6), lambda i: CASE WHEN abs(t[i] - p[i]) <= 1 THEN 0.5 * (t[i] - p[i]) * (t[i] - p[i])
                                                         ELSE abs(t[i] - p[i]) - 0.5 END)) / 5), 6) AS huber,
  round(avg(list_sum(list_transform(range(1, 6), lambda i: ln((exp(p[i] - t[i]) + exp(t[i] - p[i])) / 2))) / 5), 6) AS log_cosh
FROM x GROUP BY m"""))
def f23(spark, sf_dir):
    """Cross-entropy, smoothed (0.1) cross-entropy, Huber(1.0) and log-cosh per member."""
    p = fx.fx_predictions(spark, sf_dir)
    onehot = A.one_hot(F.col("y_true"), 5)
    smooth = A.one_hot(F.col("y_true"), 5, 0.1)
    L = M.losses(F.col("y_predicted_proba"), onehot, 5)
    Ls = M.losses(F.col("y_predicted_proba"), smooth, 5)
    return p.groupBy("m").agg(r6(F.avg(L["cross_entropy"])).alias("cross_entropy"),
                              r6(F.avg(Ls["cross_entropy"])).alias("smoothed_cross_entropy"),
                              r6(F.avg(L["huber"])).alias("huber"), r6(F.avg(L["log_cosh"])).alias("log_cosh"))


@register("j07_exclusion_list", with_fixtures("""
WITH codes AS (SELECT rating, row_number() OVER (ORDER BY min(review_id)) - 1 AS code FROM fx_clean GROUP BY rating),
bad AS (SELECT id, min(y_pred) AS y_pred FROM fx_predictions GROUP BY id
        HAVING min(y_pred) = max(y_pred) AND min(y_pred) <> min(y_true))
SELECT c.review_id, CAST(c.rating AS INTEGER) AS rating, CAST(k.rating AS INTEGER) AS y_pred,
       abs(c.rating - k.rating) > 1 AS to_check
FROM fx_clean c JOIN bad ON bad.id = c.review_id JOIN codes k ON k.code = bad.y_pred"""))
def j07(spark, sf_dir):
    """Member probabilities -> arg-max -> unanimous errors -> decoded labels -> to-check flag."""
    c = cleaned(spark, sf_dir)
    codes = sampling.first_appearance_codes(c, "rating")
    return M.exclusion_list(fx.fx_predictions(spark, sf_dir), c, codes)

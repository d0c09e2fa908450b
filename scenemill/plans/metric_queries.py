"""Scoring queries: labelled documents stand for frames, their source for the scene, rules on the text for a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenemill.operators import metrics as me
from scenemill.operators import stats as st
from scenemill.plans.registry import query, table

FAMILY = {"quality": "label", "toxic": "label", "long": "text", "english": "text"}


def cells(spark: SparkSession, sf_dir: str, arm: int = 0) -> DataFrame:
    """``doc_id, source, lang, n_chars, tag, y, yhat``; the arms answer by different rules."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.col("n_chars")
    y = {"quality": F.col("quality") == 1, "toxic": F.col("toxic") == 1, "long": n > 2000, "english": F.col("lang") == "en"}
    rules = {"quality": n > 1500 - 500 * arm, "toxic": F.col("text").contains("### ") | (n % (5 + arm) == 0), "long": n > 1000 + 1500 * arm, "english": F.col("text").contains(" the ") | (n % (9 - arm) == 0)}
    silent = {"quality": 7, "toxic": 11, "long": 13, "english": 17}
    made = [F.struct(F.lit(t).alias("tag"), y[t].alias("y"), F.when(n % (silent[t] + arm) != 0, rules[t]).alias("yhat")) for t in y]
    rows = docs.select("doc_id", "source", "lang", "n_chars", F.explode(F.array(*made)).alias("c"))
    return rows.select("doc_id", "source", "lang", "n_chars", "c.tag", "c.y", "c.yhat")


def _sql_cells(arm: int, name: str) -> str:
    return f"""{name} AS (
SELECT doc_id, source, lang, n_chars, 'quality' AS tag, quality = 1 AS y, CASE WHEN n_chars % {7 + arm} <> 0 THEN n_chars > {1500 - 500 * arm} END AS yhat FROM base UNION ALL
SELECT doc_id, source, lang, n_chars, 'toxic', toxic = 1, CASE WHEN n_chars % {11 + arm} <> 0 THEN contains(text, '### ') OR n_chars % {5 + arm} = 0 END FROM base UNION ALL
SELECT doc_id, source, lang, n_chars, 'long', n_chars > 2000, CASE WHEN n_chars % {13 + arm} <> 0 THEN n_chars > {1000 + 1500 * arm} END FROM base UNION ALL
SELECT doc_id, source, lang, n_chars, 'english', lang = 'en', CASE WHEN n_chars % {17 + arm} <> 0 THEN contains(text, ' the ') OR n_chars % {9 - arm} = 0 END FROM base)"""


CELLS = "base AS (SELECT d.*, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)), " + ", ".join(_sql_cells(i, n) for i, n in enumerate(("cells", "cells_b", "cells_c")))
COUNTS = """count(*) FILTER (yhat AND y) AS tp, count(*) FILTER (yhat AND NOT y) AS fp, count(*) FILTER (NOT yhat AND y) AS fn,
count(*) FILTER (y) AS support, count(*) AS n, count(yhat) AS n_answered"""
SCORED = f"""counted AS (SELECT tag, {COUNTS} FROM cells GROUP BY tag),
scored AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re,
           coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, n_answered - tp - fp - fn AS tn FROM counted)"""
F1 = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)"


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


@query("per_tag_metrics", f"""WITH {CELLS}, {SCORED}
SELECT tag, tp, fp, fn, support, n, n_answered, round(pr, 6) AS "precision", round(re, 6) AS recall, round(f1, 6) AS f1 FROM scored""")
def per_tag_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.per_tag_metrics(cells(spark, sf_dir)).select("tag", "tp", "fp", "fn", "support", "n", "n_answered", *r6("precision", "recall", "f1"))


@query("confusion", f"WITH {CELLS}, {SCORED} SELECT tag, tp, fp, fn, tn FROM scored")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.per_tag_metrics(cells(spark, sf_dir)).select("tag", "tp", "fp", "fn", "tn")


@query("macro_f1", f"WITH {CELLS}, {SCORED} SELECT round(avg(f1), 6) AS macro_f1, round(avg(f1) FILTER (tag <> 'toxic'), 6) AS macro_f1_seen, count(*) AS n_tags FROM scored")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.macro(me.per_tag_metrics(cells(spark, sf_dir)), [], ["toxic"]).select(*r6("macro_f1", "macro_f1_seen"), "n_tags")


def _family(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FAMILY.items()), "tag string, family string")


FAMILIES = "fam AS (SELECT * FROM (VALUES ('quality', 'label'), ('toxic', 'label'), ('long', 'text'), ('english', 'text')) v(tag, family))"
ARMS = f"arms AS (SELECT 'a' AS arm, * FROM cells UNION ALL SELECT 'b', * FROM cells_b), armed AS (SELECT arm, tag, {COUNTS} FROM arms GROUP BY arm, tag)"


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).withColumn("arm", F.lit("a")).unionByName(cells(spark, sf_dir, 1).withColumn("arm", F.lit("b")))


@query("family_macro_pivot", f"""WITH {CELLS}, {ARMS}, {FAMILIES}
SELECT family, round(avg({F1}) FILTER (arm = 'a'), 6) AS a, round(avg({F1}) FILTER (arm = 'b'), 6) AS b FROM armed JOIN fam USING (tag) GROUP BY family""")
def family_macro_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = me.per_tag_metrics(_arms(spark, sf_dir), ["arm", "tag"]).join(_family(spark), "tag")
    return rows.groupBy("family").pivot("arm", ["a", "b"]).avg("f1").select("family", *r6("a", "b"))


@query("macro_rollup", f"""WITH {CELLS}, {SCORED}, {FAMILIES}
SELECT family, tag, round(avg(f1), 6) AS f1, count(*) AS n_tags FROM scored JOIN fam USING (tag) GROUP BY ROLLUP (family, tag)""")
def macro_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = me.per_tag_metrics(cells(spark, sf_dir)).join(_family(spark), "tag")
    return rows.rollup("family", "tag").agg(F.round(F.avg("f1"), 6).alias("f1"), F.count("*").alias("n_tags"))


@query("condition_table", f"""WITH {CELLS}, {ARMS}
SELECT tag, round(max({F1}) FILTER (arm = 'a'), 6) AS a, round(max({F1}) FILTER (arm = 'b'), 6) AS b FROM armed GROUP BY tag""")
def condition_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = me.per_tag_metrics(_arms(spark, sf_dir), ["arm", "tag"])
    return rows.groupBy("tag").pivot("arm", ["a", "b"]).agg(F.first("f1")).select("tag", *r6("a", "b"))


@query("per_tag_detail", f"""WITH {CELLS}, {ARMS}, {FAMILIES}
SELECT arm, family, tag, tp, fp, fn, support, round({F1}, 6) AS f1, round(CASE WHEN 2 * support >= n THEN 2.0 * support / (support + n) ELSE 0 END, 6) AS majority_f1 FROM armed JOIN fam USING (tag)""")
def per_tag_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = me.with_baselines(me.per_tag_metrics(_arms(spark, sf_dir), ["arm", "tag"])).join(_family(spark), "tag")
    return rows.select("arm", "family", "tag", "tp", "fp", "fn", "support", *r6("f1", "majority_f1"))


@query("majority_baseline", f"""WITH {CELLS}, {SCORED}
SELECT tag, round(support / n, 6) AS prevalence, round(CASE WHEN 2 * support >= n THEN 2 * support / (support + n) ELSE 0 END, 6) AS majority_f1,
       round(greatest(support, n - support) / n, 6) AS majority_accuracy FROM scored""")
def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.with_baselines(me.counts(cells(spark, sf_dir), ["tag"])).select("tag", *r6("prevalence", "majority_f1", "majority_accuracy"))


@query("alt_baselines", f"""WITH {CELLS}, {SCORED}
SELECT tag, round(2 * (support / n) / (1 + support / n), 6) AS always_yes_f1,
       round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc,
       round((re + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy FROM scored""")
def alt_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = me.with_agreement(me.with_baselines(me.per_tag_metrics(cells(spark, sf_dir))))
    return rows.select("tag", *r6("always_yes_f1", "mcc", "balanced_accuracy"))


def _sql_wilson(k: str, n: str) -> tuple[str, str]:
    p, z2 = f"({k}::DOUBLE / nullif({n}, 0))", "(1.96::DOUBLE * 1.96::DOUBLE)"
    centre = f"(({p} + {z2} / (2 * {n})) / (1 + {z2} / {n}))"
    half = f"(1.96::DOUBLE * sqrt({p} * (1 - {p}) / {n} + {z2} / (4 * {n} * {n}::DOUBLE)) / (1 + {z2} / {n}))"
    return f"round(coalesce(greatest(0, {centre} - {half}), 0), 6)", f"round(coalesce(least(1, {centre} + {half}), 0), 6)"


_P, _R = _sql_wilson("tp", "(tp + fp)"), _sql_wilson("tp", "(tp + fn)")


@query("wilson", f"WITH {CELLS}, {SCORED} SELECT tag, {_P[0]} AS precision_low, {_P[1]} AS precision_high, {_R[0]} AS recall_low, {_R[1]} AS recall_high FROM scored")
def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.with_intervals(me.per_tag_metrics(cells(spark, sf_dir))).select("tag", *r6("precision_low", "precision_high", "recall_low", "recall_high"))


IOU = "iou AS (SELECT doc_id, CASE WHEN count(*) FILTER (y OR yhat) = 0 THEN 1 ELSE count(*) FILTER (y AND yhat) / count(*) FILTER (y OR yhat) END AS iou FROM cells WHERE yhat IS NOT NULL GROUP BY doc_id)"


@query("set_iou", f"WITH {CELLS}, {IOU} SELECT doc_id, round(iou, 6) AS iou FROM iou")
def set_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.set_iou(cells(spark, sf_dir), "doc_id").select("doc_id", *r6("iou"))


@query("mean_iou", f"WITH {CELLS}, {IOU} SELECT round(avg(iou), 6) AS mean_iou, count(*) AS n FROM iou")
def mean_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.set_iou(cells(spark, sf_dir), "doc_id").agg(F.round(F.avg("iou"), 6).alias("mean_iou"), F.count("*").alias("n"))


SWAP = f"""refs AS (SELECT doc_id, tag, 'new' AS variant, y FROM cells UNION ALL SELECT doc_id, tag, 'v1', y AND n_chars > 300 FROM cells
UNION ALL SELECT doc_id, tag, 'v2', CASE WHEN tag = 'toxic' THEN n_chars % 2 = 0 ELSE y END FROM cells),
swapped AS (SELECT variant, c.tag, count(*) FILTER (yhat AND r.y) AS tp, count(*) FILTER (yhat AND NOT r.y) AS fp, count(*) FILTER (NOT yhat AND r.y) AS fn
            FROM (SELECT doc_id, tag, yhat FROM cells) c JOIN refs r USING (doc_id, tag) GROUP BY variant, c.tag)"""


def _swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cells(spark, sf_dir)
    truths = {"new": F.col("y"), "v1": F.col("y") & (F.col("n_chars") > 300), "v2": F.when(F.col("tag") == "toxic", F.col("n_chars") % 2 == 0).otherwise(F.col("y"))}
    refs = own.select("doc_id", "tag", F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), c.alias("y")) for v, c in truths.items()])).alias("r"))
    return me.reference_swap(own, refs.select("doc_id", "tag", "r.variant", "r.y"), "doc_id")


@query("reference_swap", f"WITH {CELLS}, {SWAP} SELECT variant, tag, tp, fp, fn, round({F1}, 6) AS f1 FROM swapped")
def reference_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _swapped(spark, sf_dir).select("variant", "tag", "tp", "fp", "fn", *r6("f1"))


@query("reference_decomposition", f"""WITH {CELLS}, {SWAP}, s AS (SELECT variant, tag, {F1} AS f1 FROM swapped),
d AS (SELECT o.variant, o.tag, o.f1 AS f_old, n.f1 AS f_new, n.f1 - o.f1 AS delta FROM s o JOIN s n ON n.tag = o.tag AND n.variant = 'new' WHERE o.variant <> 'new')
SELECT variant, round(avg(f_old), 6) AS f1_old, round(avg(f_new), 6) AS f1_new, round(avg(delta), 6) AS delta_total,
       round(sum(CASE WHEN tag = 'toxic' THEN delta ELSE 0 END) / count(*), 6) AS delta_from_defects,
       round(sum(CASE WHEN tag <> 'toxic' THEN delta ELSE 0 END) / count(*), 6) AS delta_from_scope FROM d GROUP BY variant""")
def reference_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = me.decompose(_swapped(spark, sf_dir), "new", ["toxic"])
    return found.select("variant", *r6("f1_old", "f1_new", "delta_total", "delta_from_defects", "delta_from_scope"))


@query("type_majority", """WITH rows AS (SELECT lang AS kind, (n_chars % 4)::VARCHAR AS gold, (doc_id % 4)::VARCHAR AS pred FROM documents),
e AS (SELECT kind, gold, count(*) AS n FROM rows GROUP BY ALL), t AS (SELECT kind, gold AS type_answer FROM e QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, gold) = 1),
g AS (SELECT gold AS global_answer FROM e GROUP BY gold ORDER BY sum(n) DESC, gold LIMIT 1),
a AS (SELECT kind, type_answer, global_answer, count(*) AS n, avg((gold = pred)::INT) AS accuracy, avg((gold = type_answer)::INT) AS tb, avg((gold = global_answer)::INT) AS gb
      FROM rows JOIN t USING (kind), g GROUP BY ALL)
SELECT kind, type_answer, global_answer, n, round(accuracy, 6) AS accuracy, round(tb, 6) AS type_baseline, round(gb, 6) AS global_baseline, round(accuracy - tb, 6) AS delta, accuracy > tb AS beats_baseline FROM a""")
def type_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("lang").alias("kind"), (F.col("n_chars") % 4).cast("string").alias("gold"), (F.col("doc_id") % 4).cast("string").alias("pred"))
    return me.type_majority(rows, "kind", "gold", "pred").select("kind", "type_answer", "global_answer", "n", *r6("accuracy", "type_baseline", "global_baseline", "delta"), "beats_baseline")


@query("count_directions", """WITH rows AS (SELECT lang, n_chars % 4 AS g, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 4 END AS p FROM documents)
SELECT lang, count(*) AS n, count(*) FILTER (p < g) AS under, count(*) FILTER (p > g) AS over, count(*) FILTER (p = g) AS exact, count(*) FILTER (p = 0) AS zero, count(*) FILTER (p IS NULL) AS refused FROM rows GROUP BY lang""")
def count_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pred = F.when(F.col("doc_id") % 5 == 0, "no idea").otherwise((F.col("doc_id") % 4).cast("string"))
    rows = docs.select("lang", (F.col("n_chars") % 4).cast("string").alias("gold"), pred.alias("pred"))
    return me.count_directions(rows, ["lang"], "gold", "pred")


@query("prevalence", f"""WITH {CELLS}, {FAMILIES}
SELECT tag, family, count(*) FILTER (y) AS n_positive, count(*) AS n, round(count(*) FILTER (y) / count(*), 6) AS prevalence,
       round(100.0 * greatest(count(*) FILTER (y), count(*) FILTER (NOT y)) / count(*), 4) AS majority_pct,
       100.0 * greatest(count(*) FILTER (y), count(*) FILTER (NOT y)) / count(*) >= 90 AS near_constant,
       CASE WHEN count(*) FILTER (y) < 30 THEN 'qc_invariant' ELSE 'scored' END AS role FROM cells JOIN fam USING (tag) GROUP BY tag, family""")
def prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = me.schema_report(cells(spark, sf_dir), _family(spark))
    return rows.select("tag", "family", "n_positive", "n", *r6("prevalence"), F.round("majority_pct", 4).alias("majority_pct"), "near_constant", "role")


@query("coverage_report", f"""WITH {CELLS}, s AS (SELECT source, median(n_chars) AS m, max(n_chars) AS top, bool_or(y) FILTER (tag = 'toxic') AS any_toxic FROM cells GROUP BY source)
SELECT count(*) AS n_sources, count(*) FILTER (m > 1500) AS long_sources, max(top) AS longest, count(*) FILTER (any_toxic) AS toxic_sources FROM s""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = cells(spark, sf_dir).groupBy("source").agg(
        F.percentile("n_chars", 0.5).alias("m"), F.max("n_chars").alias("top"), F.bool_or(F.when(F.col("tag") == "toxic", F.col("y"))).alias("any_toxic")
    )
    return each.agg(F.count("*").alias("n_sources"), F.count_if(F.col("m") > 1500).alias("long_sources"), F.max("top").alias("longest"), F.count_if("any_toxic").alias("toxic_sources"))


@query("panel_tags", f"""WITH {CELLS}, e AS (SELECT source, lang, tag, bool_and(y) AS a, bool_or(y) AS s FROM cells GROUP BY ALL)
SELECT source, lang, coalesce(string_agg(tag, ',' ORDER BY tag) FILTER (a), '') AS throughout, coalesce(string_agg(tag, ',' ORDER BY tag) FILTER (s AND NOT a), '') AS partial FROM e GROUP BY ALL""")
def panel_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.panel_tags(cells(spark, sf_dir), ["source", "lang"])


@query("views", f"""WITH {CELLS}, v AS (SELECT 'all' AS view, * FROM cells UNION ALL SELECT 'uniform', * FROM cells WHERE doc_id % 3 = 0 UNION ALL SELECT 'certain', * FROM cells WHERE n_chars > 500),
c AS (SELECT view, tag, {COUNTS} FROM v GROUP BY view, tag)
SELECT view, tag, tp, fp, fn, round({F1}, 6) AS f1, round(support / n, 6) AS prevalence, round(coalesce((tp + fp) / nullif(n_answered, 0), 0), 6) AS model_true_rate FROM c""")
def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {"all": F.lit(True), "uniform": F.col("doc_id") % 3 == 0, "certain": F.col("n_chars") > 500}
    return me.views(cells(spark, sf_dir), flags).select("view", "tag", "tp", "fp", "fn", *r6("f1", "prevalence", "model_true_rate"))


@query("size_bands", f"""WITH {CELLS}, b AS (SELECT *, CASE WHEN n_chars >= 4000 THEN 3 WHEN n_chars >= 1500 THEN 2 WHEN n_chars >= 500 THEN 1 ELSE 0 END AS band FROM cells),
c AS (SELECT band, tag, {COUNTS}, median(n_chars) AS m FROM b GROUP BY band, tag) SELECT band, tag, tp, fp, fn, round({F1}, 6) AS f1, round(m, 6) AS median_size FROM c""")
def size_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.bands(cells(spark, sf_dir), "n_chars", [0, 500, 1500, 4000]).select("band", "tag", "tp", "fp", "fn", *r6("f1", "median_size"))


@query("gap_share", f"""WITH {CELLS}, b AS (SELECT CASE WHEN n_chars >= 4000 THEN 2 WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS stage, * FROM cells),
c AS (SELECT stage, {COUNTS} FROM b GROUP BY stage), f AS (SELECT stage, {F1} AS f1 FROM c)
SELECT stage, round(f1, 6) AS f1, round(f1 - (SELECT f1 FROM f WHERE stage = 0), 6) AS delta,
       round((f1 - (SELECT f1 FROM f WHERE stage = 0)) / ((SELECT f1 FROM f WHERE stage = 2) - (SELECT f1 FROM f WHERE stage = 0)), 6) AS share_of_gap FROM f""")
def gap_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.when(F.col("n_chars") >= 4000, 2).when(F.col("n_chars") >= 1000, 1).otherwise(0)
    rows = me.per_tag_metrics(cells(spark, sf_dir).withColumn("stage", stage), ["stage"])
    return me.gap_share(rows.select("stage", "f1"), "stage", "f1").select("stage", *r6("f1", "delta", "share_of_gap"))


@query("completeness", """SELECT round(100 * avg((url IS NOT NULL AND length(url) > 0)::INT), 4) AS pct_url, round(100 * avg((html IS NOT NULL AND length(html) > 0)::INT), 4) AS pct_html,
round(100 * avg((url IS NOT NULL AND length(url) > 0 AND html IS NOT NULL AND length(html) > 0)::INT), 4) AS pct_all FROM pages""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = me.completeness(table(spark, sf_dir, "pages"), ["url", "html"])
    return found.select(*[F.round(c, 4).alias(c) for c in found.columns])


VARIANTS = """ev AS (SELECT 'high' AS variant, user_id FROM events WHERE value > 300 UNION ALL SELECT 'error', user_id FROM events WHERE event_type = 'error'),
gold AS (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 70),
k AS (SELECT variant, count(*) AS n_events, count(DISTINCT user_id) AS keys, count(DISTINCT user_id) FILTER (user_id IN (SELECT user_id FROM gold)) AS gold_hit FROM ev GROUP BY variant),
z AS (SELECT (SELECT count(DISTINCT user_id) FROM events) AS al, (SELECT count(*) FROM gold) AS g)"""


@query("variant_recall", f"""WITH {VARIANTS} SELECT variant, n_events, keys, gold_hit, round(100.0 * gold_hit / g, 6) AS recall_pct, round(100.0 * gold_hit / keys, 6) AS hit_rate_pct,
round((gold_hit / keys) / (g / al), 6) AS enrichment FROM k, z""")
def variant_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    found = rows.select(F.explode(F.array_compact(F.array(F.when(F.col("value") > 300, "high"), F.when(F.col("event_type") == "error", "error")))).alias("variant"), "user_id")
    gold = rows.groupBy("user_id").agg(F.count("*").alias("n")).where("n > 70")
    return me.variant_recall(found, gold, "user_id", rows).select("variant", "n_events", "keys", "gold_hit", *r6("recall_pct", "hit_rate_pct", "enrichment"))


@query("chance_f1", """WITH n AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS b FROM events GROUP BY user_id), t AS (SELECT unnest([0, 1, 2, 3]) AS tolerance),
d AS (SELECT sum(b) / sum(n) AS density FROM n) SELECT tolerance, round(density, 6) AS density, round(least(1, (2 * tolerance + 1) * density), 6) AS chance_f1 FROM d, t""")
def chance_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("density"))
    rows = rows.withColumn("tolerance", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    return rows.select("tolerance", *r6("density"), F.round(me.chance_f1(F.col("density"), F.col("tolerance")), 6).alias("chance_f1"))


@query("implications", """SELECT * FROM (SELECT 'big' AS antecedent, 'positive' AS consequent, count(*) FILTER (value > 200) AS n_antecedent, count(*) FILTER (value > 200 AND NOT value > 0) AS n_broken FROM events
UNION ALL SELECT 'big', 'click', count(*) FILTER (value > 200), count(*) FILTER (value > 200 AND event_type <> 'click') FROM events)""")
def implications(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("value") > 200).alias("big"), (F.col("value") > 0).alias("positive"), (F.col("event_type") == "click").alias("click"))
    return me.implications(rows, [("big", "positive"), ("big", "click")])


@query("cluster_sums", f"WITH {CELLS} SELECT source, tag, count(*) FILTER (yhat AND y) AS tp, count(*) FILTER (yhat AND NOT y) AS fp, count(*) FILTER (NOT yhat AND y) AS fn FROM cells GROUP BY source, tag")
def cluster_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.counts(cells(spark, sf_dir), ["source", "tag"]).select("source", "tag", "tp", "fp", "fn")


@query("model_slice", f"""WITH {CELLS}, c AS (SELECT tag, count(*) FILTER (coalesce(yhat, false) AND y) AS tp, count(*) FILTER (coalesce(yhat, false) AND NOT y) AS fp, count(*) FILTER (NOT coalesce(yhat, false) AND y) AS fn
FROM cells WHERE doc_id IN (SELECT doc_id FROM labels QUALIFY row_number() OVER (ORDER BY doc_id) <= 150) GROUP BY tag) SELECT tag, tp, fp, fn, round({F1}, 6) AS f1 FROM c""")
def model_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The first 150 items in order are the feature here: two models are compared on the slice both have answered.
    first = table(spark, sf_dir, "labels").select("doc_id").orderBy("doc_id").limit(150)
    rows = cells(spark, sf_dir).join(first, "doc_id", "left_semi").withColumn("yhat", F.coalesce("yhat", F.lit(False)))
    return me.per_tag_metrics(rows).select("tag", "tp", "fp", "fn", *r6("f1"))


#: Tags that not every arm can see; averages leave them out.
BLIND = ("toxic",)


def _sql_boot(name: str, column: str, seed: str, draws: int = st.DRAWS) -> str:
    """``ww_<name>(draw, cluster, w)``: multinomial weights of the distinct values of a column of the cells."""
    return f"""cl_{name} AS (SELECT cluster, row_number() OVER (ORDER BY ('0x' || substr(md5(coalesce(cluster::VARCHAR, 'null')), 1, 4))::BIGINT % 64, cluster) - 1 AS c FROM (SELECT DISTINCT {column} AS cluster FROM cells)),
w_{name} AS (SELECT draw, ('0x' || substr(md5(concat_ws(':', '{seed}', draw, slot)), 1, 12))::BIGINT % (SELECT count(*) FROM cl_{name}) AS c, count(*) AS w
             FROM (SELECT c AS slot FROM cl_{name}), (SELECT unnest(range(0, {draws})) AS draw) GROUP BY ALL),
ww_{name} AS (SELECT draw, cluster, w FROM w_{name} JOIN cl_{name} USING (c))"""


BOOT = _sql_boot("src", "source", "boot")


def _sql_draws(name: str, source: str, column: str = "source", weights: str = "src") -> str:
    return f"""{name} AS (SELECT draw, tag, sum(tp * w) AS tp, sum(fp * w) AS fp, sum(fn * w) AS fn FROM (SELECT {column}, tag, {COUNTS} FROM {source} GROUP BY {column}, tag) s JOIN ww_{weights} ww ON ww.cluster = s.{column} GROUP BY draw, tag)"""


def _sql_averaged(name: str, drawn: str) -> str:
    """``draw, average, score``: macro and micro F1 over the tags all can see."""
    return f"""{name} AS (SELECT draw, 'macro' AS average, avg({F1}) AS score FROM {drawn} WHERE tag <> 'toxic' GROUP BY draw
UNION ALL SELECT draw, 'micro', coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0) FROM {drawn} WHERE tag <> 'toxic' GROUP BY draw)"""


def _weights(own: DataFrame, item: str = "source", seed: str = "boot") -> DataFrame:
    return st.hashed_weights(own, item, seed)


@query("cluster_bootstrap_ci", f"""WITH {CELLS}, {BOOT}, {_sql_draws("dr", "cells")},
f AS (SELECT draw, tag, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re, {F1} AS f1 FROM dr),
q AS (SELECT tag, avg(f1) AS mean, quantile_cont(f1, 0.025) AS fl, quantile_cont(f1, 0.975) AS fh, quantile_cont(pr, 0.025) AS pl, quantile_cont(pr, 0.975) AS ph, quantile_cont(re, 0.025) AS rl, quantile_cont(re, 0.975) AS rh FROM f GROUP BY tag)
SELECT tag, round(mean, 6) AS mean, round(fl, 6) AS f1_low, round(fh, 6) AS f1_high, round(pl, 6) AS precision_low, round(ph, 6) AS precision_high, round(rl, 6) AS recall_low, round(rh, 6) AS recall_high,
fl = fh OR pl = ph OR rl = rh AS degenerate FROM q""")
def cluster_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cells(spark, sf_dir)
    drawn = st.bootstrap(own, _weights(own), "source", ["tag"])
    found = st.score_intervals(drawn, ["tag"]).join(st.percentile_interval(drawn, ["tag"]).select("tag", "mean"), "tag")
    return found.select("tag", *r6("mean", "f1_low", "f1_high", "precision_low", "precision_high", "recall_low", "recall_high"), "degenerate")


@query("bootstrap_macro", f"""WITH {CELLS}, {BOOT}, {_sql_draws("dr", "cells")}, {_sql_averaged("av", "dr")}
SELECT draw, round(max(score) FILTER (average = 'macro'), 6) AS macro, round(max(score) FILTER (average = 'micro'), 6) AS micro FROM av GROUP BY draw""")
def bootstrap_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cells(spark, sf_dir)
    found = st.averaged(st.bootstrap(own, _weights(own), "source", ["tag"]), blind=BLIND)
    return found.select(F.col("draw").cast("long").alias("draw"), *r6("macro", "micro"))


@query("detail_with_bootstrap", f"""WITH {CELLS}, {SCORED}, {BOOT}, {_sql_draws("dr", "cells")}, {FAMILIES}, q AS (SELECT tag, quantile_cont({F1}, 0.025) AS fl, quantile_cont({F1}, 0.975) AS fh FROM dr GROUP BY tag)
SELECT tag, family, tp, fp, fn, round(f1, 6) AS f1, round(fl, 6) AS f1_low, round(fh, 6) AS f1_high, round(CASE WHEN 2 * support >= n THEN 2 * support / (support + n) ELSE 0 END, 6) AS majority_f1
FROM scored JOIN q USING (tag) JOIN fam USING (tag)""")
def detail_with_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cells(spark, sf_dir)
    bands = st.score_intervals(st.bootstrap(own, _weights(own), "source", ["tag"]), ["tag"])
    rows = me.with_baselines(me.per_tag_metrics(own)).join(bands, "tag").join(_family(spark), "tag")
    return rows.select("tag", "family", "tp", "fp", "fn", *r6("f1", "f1_low", "f1_high", "majority_f1"))


def _sql_paired(arms: dict[str, str]) -> str:
    """``pp(condition, average, score_a, score_b, delta, low, high, p)`` of each arm against the cells."""
    parts = [_sql_draws("da", "cells"), _sql_averaged("va", "da"), f"ca AS (SELECT -1 AS draw, tag, {COUNTS} FROM cells GROUP BY tag)", _sql_averaged("qa", "ca")]
    ends = []
    for name, source in arms.items():
        parts += [_sql_draws(f"d_{name}", source), _sql_averaged(f"v_{name}", f"d_{name}"), f"c_{name} AS (SELECT -1 AS draw, tag, {COUNTS} FROM {source} GROUP BY tag)", _sql_averaged(f"q_{name}", f"c_{name}")]
        parts.append(f"""p_{name} AS (SELECT average, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high,
least(1, 2 * least((1 + count(*) FILTER (d <= 0)) / (count(*) + 1), (1 + count(*) FILTER (d >= 0)) / (count(*) + 1))) AS p FROM (SELECT average, round(b.score - a.score, 12) AS d FROM va a JOIN v_{name} b USING (draw, average)) GROUP BY average)""")
        ends.append(f"SELECT '{name}' AS condition, average, qa.score AS score_a, q_{name}.score AS score_b, q_{name}.score - qa.score AS delta, low, high, p FROM qa JOIN q_{name} USING (average) JOIN p_{name} USING (average)")
    return ", ".join(parts) + ", pp AS (" + " UNION ALL ".join(ends) + ")"


def _paired(spark: SparkSession, sf_dir: str, arms: dict[str, int]) -> DataFrame:
    reference = cells(spark, sf_dir)
    w = _weights(reference)
    others = [cells(spark, sf_dir, i).withColumn("condition", F.lit(name)) for name, i in arms.items()]
    rows = others[0]
    for other in others[1:]:
        rows = rows.unionByName(other)
    drawn = lambda own, by: st.averaged(st.bootstrap(own, w, "source", [*by, "tag"]), blind=BLIND, by=tuple(by))
    once = lambda own, by: st.averaged(st.point(own, [*by, "tag"]), blind=BLIND, by=tuple(by))
    return st.paired_delta(drawn(reference, []), drawn(rows, ["condition"]), once(reference, []), once(rows, ["condition"]), ["condition"])


@query("paired_delta", f"WITH {CELLS}, {BOOT}, {_sql_paired({'b': 'cells_b'})} SELECT condition, average, round(score_a, 6) AS score_a, round(score_b, 6) AS score_b, round(delta, 6) AS delta, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p FROM pp")
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir, {"b": 1}).select("condition", "average", *r6("score_a", "score_b", "delta", "low", "high", "p"))


@query("significance_holm", f"""WITH {CELLS}, {BOOT}, {_sql_paired({'b': 'cells_b', 'c': 'cells_c'})},
s AS (SELECT *, (count(*) OVER (PARTITION BY average) - row_number() OVER (PARTITION BY average ORDER BY p, condition) + 1) * p AS s FROM pp),
h AS (SELECT *, least(1, max(s) OVER (PARTITION BY average ORDER BY p, condition)) AS p_holm FROM s)
SELECT average, condition, round(delta, 6) AS delta, round(p, 6) AS p, round(p_holm, 6) AS p_holm, p_holm < 0.05 AS significant FROM h""")
def significance_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = st.holm(_paired(spark, sf_dir, {"b": 1, "c": 2}), ["average"], "p", "condition")
    return rows.select("average", "condition", *r6("delta", "p", "p_holm"), (F.col("p_holm") < 0.05).alias("significant"))


@query("design_effect", f"""WITH {CELLS}, {BOOT}, {_sql_boot("doc", "doc_id", "items")}, {_sql_draws("dr", "cells")}, {_sql_draws("di", "cells", "doc_id", "doc")}, {_sql_averaged("vr", "dr")}, {_sql_averaged("vi", "di")},
x AS (SELECT quantile_cont(score, 0.975) - quantile_cont(score, 0.025) AS cw FROM vr WHERE average = 'macro'), y AS (SELECT quantile_cont(score, 0.975) - quantile_cont(score, 0.025) AS iw FROM vi WHERE average = 'macro')
SELECT round(cw, 6) AS cluster_width, round(iw, 6) AS item_width, round(cw / iw, 6) AS ratio FROM x, y""")
def design_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cells(spark, sf_dir)

    def interval(drawn: DataFrame) -> DataFrame:
        return st.percentile_interval(st.averaged(drawn, blind=BLIND), [], "macro")

    by_source, by_item = st.bootstrap(own, _weights(own), "source", ["tag"]), st.bootstrap_items(own, "doc_id", ["tag"], "items")
    return st.design_effect(interval(by_source), interval(by_item)).select(*r6("cluster_width", "item_width", "ratio"))

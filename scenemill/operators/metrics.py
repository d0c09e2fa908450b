"""Scores of three-valued predictions: long rows (item, tag, y, yhat), a null yhat being no answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenemill.functions.scalar import f1, majority_f1, mcc, ratio, wilson


def counts(cells: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """``tp, fp, fn`` over answered cells; ``support`` and ``n`` over all; ``n_answered``. One map-side combined aggregation."""
    answered = F.col("yhat").isNotNull()
    one = F.lit(1) if weight is None else weight
    total = lambda c: F.sum(F.when(c, one).otherwise(0)).cast("long")
    return cells.groupBy(*by).agg(
        total(answered & F.col("y") & F.col("yhat")).alias("tp"), total(answered & ~F.col("y") & F.col("yhat")).alias("fp"),
        total(answered & F.col("y") & ~F.col("yhat")).alias("fn"), total(F.col("y")).alias("support"), F.sum(one).cast("long").alias("n"),
        total(answered).alias("n_answered"),
    )


def with_scores(counted: DataFrame) -> DataFrame:
    """Precision, recall and F1 (0 without a denominator) and the true negatives among the answered."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.withColumns(
        {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": f1(tp, fp, fn), "tn": F.col("n_answered") - tp - fp - fn}
    )


def per_tag_metrics(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    return with_scores(counts(cells, by or ["tag"]))


def with_baselines(counted: DataFrame) -> DataFrame:
    """Majority and always-yes baselines from support and n."""
    p = ratio(F.col("support"), F.col("n"))
    return counted.withColumns(
        {
            "prevalence": p, "majority_f1": majority_f1(F.col("support"), F.col("n")),
            "majority_accuracy": ratio(F.greatest("support", F.col("n") - F.col("support")), F.col("n")), "always_yes_f1": ratio(2 * p, 1 + p),
        }
    )


def with_agreement(scored: DataFrame) -> DataFrame:
    """Matthews correlation and balanced accuracy."""
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    return scored.withColumns({"mcc": mcc(tp, fp, fn, tn), "balanced_accuracy": (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2})


def with_intervals(scored: DataFrame, z: float = 1.96) -> DataFrame:
    """Score intervals of precision and recall."""
    p = wilson(F.col("tp"), F.col("tp") + F.col("fp"), z)
    r = wilson(F.col("tp"), F.col("tp") + F.col("fn"), z)
    return scored.withColumns({"precision_low": p[0], "precision_high": p[1], "recall_low": r[0], "recall_high": r[1]})


def macro(scored: DataFrame, by: list[str], blind: list[str]) -> DataFrame:
    """Mean F1 over tags, and over the tags that every input can see."""
    seen = F.when(~F.col("tag").isin(*blind), F.col("f1"))
    return scored.groupBy(*by).agg(F.avg("f1").alias("macro_f1"), F.avg(seen).alias("macro_f1_seen"), F.count("*").alias("n_tags"))


def set_iou(cells: DataFrame, item: str) -> DataFrame:
    """Per item the overlap of the true and the predicted set over answered tags; 1 where both are empty."""
    rows = cells.where(F.col("yhat").isNotNull()).groupBy(item)
    found = rows.agg(F.count_if(F.col("y") & F.col("yhat")).alias("both"), F.count_if(F.col("y") | F.col("yhat")).alias("either"))
    return found.select(item, F.when(F.col("either") == 0, 1.0).otherwise(F.try_divide("both", "either")).alias("iou"))


def reference_swap(cells: DataFrame, references: DataFrame, item: str) -> DataFrame:
    """The same predictions scored against each variant of the truth: ``references(item, tag, variant, y)``."""
    rows = cells.select(item, "tag", "yhat").join(references, [item, "tag"])
    return per_tag_metrics(rows, ["variant", "tag"])


def decompose(swapped: DataFrame, new: str, defective: list[str]) -> DataFrame:
    """How far each older reference moves macro F1, in total and by defective and other tags (shares add up)."""
    now = swapped.where(F.col("variant") == new).select("tag", F.col("f1").alias("f1_new"))
    rows = swapped.where(F.col("variant") != new).join(now, "tag").withColumn("delta", F.col("f1_new") - F.col("f1"))
    bad = F.col("tag").isin(*defective)
    n = F.count("*")
    return rows.groupBy("variant").agg(
        F.avg("f1").alias("f1_old"), F.avg("f1_new").alias("f1_new"), F.avg("delta").alias("delta_total"),
        (F.sum(F.when(bad, F.col("delta")).otherwise(0.0)) / n).alias("delta_from_defects"), (F.sum(F.when(~bad, F.col("delta")).otherwise(0.0)) / n).alias("delta_from_scope"),
    )


def type_majority(rows: DataFrame, kind: str, gold: str, pred: str) -> DataFrame:
    """Accuracy per type beside the majority answer of the type and of all; ties by the smaller answer."""
    best = lambda by: Window.partitionBy(*by).orderBy(F.desc("n"), gold)
    each = rows.groupBy(kind, gold).agg(F.count("*").alias("n"))
    typed = each.withColumn("__r", F.row_number().over(best([kind]))).where("__r = 1").select(kind, F.col(gold).alias("type_answer"))
    overall = each.groupBy(gold).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), gold).limit(1).select(F.col(gold).alias("global_answer"))
    joined = rows.join(typed, kind).crossJoin(F.broadcast(overall))  # one row
    right = lambda c: F.avg((F.col(gold) == F.col(c)).cast("double"))
    found = joined.groupBy(kind, "type_answer", "global_answer").agg(
        F.count("*").alias("n"), F.avg(F.coalesce((F.col(gold) == F.col(pred)).cast("double"), F.lit(0.0))).alias("accuracy"),
        right("type_answer").alias("type_baseline"), right("global_answer").alias("global_baseline"),
    )
    return found.withColumns({"delta": F.col("accuracy") - F.col("type_baseline"), "beats_baseline": F.col("accuracy") > F.col("type_baseline")})


def count_directions(rows: DataFrame, by: list[str], gold: str, pred: str) -> DataFrame:
    """Numeric answers: under, over, exact, zeros and refusals (not a number)."""
    g, p = F.try_to_number(gold, F.lit("999999999")), F.expr(f"try_cast({pred} AS INT)")
    rows = rows.withColumns({"__g": g.cast("int"), "__p": p}).where(F.col("__g").isNotNull())
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col("__p") < F.col("__g")).alias("under"), F.count_if(F.col("__p") > F.col("__g")).alias("over"),
        F.count_if(F.col("__p") == F.col("__g")).alias("exact"), F.count_if(F.col("__p") == 0).alias("zero"), F.count_if(F.col("__p").isNull()).alias("refused"),
    )


def panel_tags(cells: DataFrame, panel: list[str]) -> DataFrame:
    """Tags that hold on all rows of a panel, and those that hold on some, each sorted and joined."""
    each = cells.groupBy(*panel, "tag").agg(F.bool_and("y").alias("all"), F.bool_or("y").alias("some"))
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("tag")))), ",")
    return each.groupBy(*panel).agg(names(F.col("all")).alias("throughout"), names(F.col("some") & ~F.col("all")).alias("partial"))


def views(cells: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Scores per (view, tag); a row belongs to every view whose flag holds."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(v)) for v, c in flags.items()]))
    rows = per_tag_metrics(cells.withColumn("view", F.explode(names)), ["view", "tag"])
    return rows.withColumns({"prevalence": ratio(F.col("support"), F.col("n")), "model_true_rate": ratio(F.col("tp") + F.col("fp"), F.col("n_answered"))})


def bands(cells: DataFrame, size: str, edges: list[float]) -> DataFrame:
    """Scores by size band [edge, next edge), the last open, with the median size."""
    band = F.lit(None).cast("int")
    for i, e in enumerate(edges):
        band = F.when(F.col(size) >= e, i).otherwise(band)
    rows = cells.withColumn("band", band).where("band is not null")
    middle = rows.groupBy("band", "tag").agg(F.percentile(size, 0.5).alias("median_size"))
    return per_tag_metrics(rows, ["band", "tag"]).join(middle, ["band", "tag"])


def gap_share(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Each row's step from the first, and the share of the way to the last that it has gone."""
    ends = rows.agg(F.min_by(value, order).alias("__a"), F.max_by(value, order).alias("__z"))
    joined = rows.crossJoin(F.broadcast(ends))  # one row
    joined = joined.withColumn("delta", F.col(value) - F.col("__a"))
    return joined.withColumn("share_of_gap", F.try_divide("delta", F.col("__z") - F.col("__a"))).drop("__a", "__z")


def completeness(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Percent of rows with each field filled, and with all of them."""
    filled = {f: F.col(f).isNotNull() & (F.length(F.col(f).cast("string")) > 0) for f in fields}
    every = F.lit(True)
    for c in filled.values():
        every = every & c
    percent = lambda c: F.avg(c.cast("double")) * 100
    return rows.agg(*[percent(c).alias(f"pct_{f}") for f, c in filled.items()], percent(every).alias("pct_all"))


def variant_recall(events: DataFrame, gold: DataFrame, key: str, base: DataFrame) -> DataFrame:
    """Per detector variant: events, keys hit, recall of the gold keys, hit rate, and enrichment over the base rate."""
    hits = events.select("variant", key).distinct().join(gold.select(key).distinct().withColumn("__gold", F.lit(1)), key, "left")
    found = hits.groupBy("variant").agg(F.count("*").alias("keys"), F.count("__gold").alias("gold_hit"))
    n = events.groupBy("variant").agg(F.count("*").alias("n_events"))
    sizes = base.agg(F.countDistinct(key).alias("__all")).crossJoin(gold.agg(F.countDistinct(key).alias("__gold_all")))
    rows = found.join(n, "variant").crossJoin(F.broadcast(sizes))  # one row
    rate = F.try_divide(F.col("gold_hit"), F.col("keys"))
    return rows.select(
        "variant", "n_events", "keys", "gold_hit", (F.try_divide("gold_hit", "__gold_all") * 100).alias("recall_pct"), (rate * 100).alias("hit_rate_pct"),
        F.try_divide(rate, F.try_divide("__gold_all", "__all")).alias("enrichment"),
    )


def chance_f1(density: Column, tolerance: Column) -> Column:
    """F1 expected of boundaries placed at random: the share of rows within the tolerance of a boundary, at most 1."""
    return F.least(F.lit(1.0), (2 * tolerance + 1) * density)


def schema_report(cells: DataFrame, tag_dim: DataFrame, floor: int = 30, near: float = 90.0) -> DataFrame:
    """Per tag: positives, prevalence, majority share, near-constant flag and role."""
    rows = cells.groupBy("tag").agg(F.count_if("y").alias("n_positive"), F.count("*").alias("n")).join(tag_dim, "tag")
    share = ratio(F.greatest("n_positive", F.col("n") - F.col("n_positive")), F.col("n")) * 100
    return rows.withColumns(
        {"prevalence": ratio(F.col("n_positive"), F.col("n")), "majority_pct": share, "near_constant": share >= near, "role": F.when(F.col("n_positive") < floor, "qc_invariant").otherwise("scored")}
    )


def implications(wide: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Per rule "a implies b" the rows that break it; one pass over the table."""
    if not rules:
        raise ValueError("no rules")
    one = wide.agg(*[F.count_if(F.col(a) & ~F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(rules)], *[F.count_if(F.col(a)).alias(f"n{i}") for i, (a, _) in enumerate(rules)])
    stack = ", ".join(f"'{a}', '{b}', n{i}, r{i}" for i, (a, b) in enumerate(rules))
    return one.select(F.expr(f"stack({len(rules)}, {stack}) as (antecedent, consequent, n_antecedent, n_broken)"))


def detection_tags(rows: DataFrame, by: list[str]) -> DataFrame:
    """Booleans per group from detections ``category, colour, height``: any light, any sign, each colour, a light of no colour, largest lit height."""
    light = F.col("category") == "light"
    lit = light & F.col("colour").isin("red", "yellow", "green")
    return rows.groupBy(*by).agg(
        F.bool_or(light).alias("any_light"), F.bool_or(F.col("category") == "sign").alias("any_sign"),
        *[F.bool_or(light & (F.col("colour") == c)).alias(f"is_{c}") for c in ("red", "yellow", "green")], F.bool_or(light & ~lit).alias("uncertain"),
        F.coalesce(F.max(F.when(lit, F.col("height"))), F.lit(0.0)).alias("lit_height"),
    )


def panel_sensitivity(runs: DataFrame, scene: str, start: str, end: str, labels: list[str], floors: list[float]) -> DataFrame:
    """Per floor on a panel's length: panels in all, median and most per scene, the fewest rows of a panel, and label combinations that are lost.

    A combination is lost in a scene if a run has it and no panel does. Every floor's panels are folded from the
    scene's runs by themselves (``start`` and ``end`` are row numbers).
    """
    from scenemill.operators.events import collapse, merge_short

    swept = runs.select(scene, start, end, *labels, F.explode(F.array(*[F.lit(float(f)) for f in floors])).alias("floor"))
    merged = merge_short(swept, ["floor", scene], start, end, "floor", labels)
    panels = collapse(merged, ["floor", scene], start, end, labels)
    combo = F.struct(*labels)
    each = panels.groupBy("floor", scene).agg(F.count("*").alias("n"), F.min(F.col(end) - F.col(start) + 1).alias("rows"), F.collect_set(combo).alias("kept"))
    raw = runs.groupBy(scene).agg(F.collect_set(combo).alias("raw"))
    joined = each.join(raw, scene).withColumns({"kinds": F.size("raw"), "found": F.size(F.array_intersect("raw", "kept"))})
    return joined.groupBy("floor").agg(
        F.sum("n").alias("panels"), F.percentile("n", 0.5).alias("median_panels"), F.max("n").alias("most_panels"), F.min("rows").alias("fewest_rows"),
        F.sum("kinds").alias("kinds"), F.sum(F.col("kinds") - F.col("found")).alias("kinds_lost"),
    )

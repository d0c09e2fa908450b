"""Quota draws, covers, top rows per group. Draws follow a hash of (seed, key), so they are the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_order(seed: str, *keys: str) -> Column:
    """A pseudo-random place from MD5, which any engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def capped_draw(rows: DataFrame, key: str, group: str, per_group: int, budget: int, seed: str) -> DataFrame:
    """At most ``per_group`` rows of each group, then ``budget`` of those, both in drawing order."""
    some = top_per_group(rows, [group], [draw_order(seed, key), F.col(key)], per_group)
    return some.orderBy(draw_order(seed, key), key).limit(budget)


def rare_kept(cells: DataFrame, item: str, rare_below: int, extra: int, seed: str, floor: int = 0) -> DataFrame:
    """All items with a rare positive tag, and ``extra`` drawn from the rest: ``item, reason``.

    A tag is rare if it has fewer than ``rare_below`` positives. Running it fails if a tag is left with fewer than ``floor``.
    """
    positive = cells.where("y")
    rare = positive.groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") < rare_below).select("tag")
    kept = positive.join(rare, "tag", "left_semi").select(item).distinct()
    rest = cells.select(item).distinct().join(kept, item, "left_anti").orderBy(draw_order(seed, item), item).limit(extra)
    chosen = kept.withColumn("reason", F.lit("rare")).unionByName(rest.withColumn("reason", F.lit("drawn")))
    if not floor:
        return chosen
    left = cells.select("tag").distinct().join(positive.join(chosen.select(item), item, "left_semi").groupBy("tag").agg(F.count("*").alias("n")), "tag", "left")
    least = left.agg(F.min(F.coalesce("n", F.lit(0))).alias("__least"))
    held = F.when(F.coalesce(F.col("__least"), F.lit(floor)) >= floor, F.lit(True)).otherwise(F.raise_error(F.lit(f"a tag is left with fewer than {floor} positives")).cast("boolean"))
    return chosen.crossJoin(F.broadcast(least)).where(held).drop("__least")  # one row


def uniform_and_targeted(rows: DataFrame, key: str, target: Column, uniform: int, targeted: int, seed: str) -> DataFrame:
    """``uniform`` rows drawn from all, and up to ``targeted`` further ones where ``target`` holds."""
    order = [draw_order(seed, key), F.col(key)]
    first = rows.orderBy(*order).limit(uniform).withColumn("stratum", F.lit("uniform"))
    more = rows.where(target).join(first.select(key), key, "left_anti").orderBy(*order).limit(targeted).withColumn("stratum", F.lit("targeted"))
    return first.unionByName(more)


#: Rows of a group by tag matrix that the driver may hold; a larger one is asked for one row a round.
MATRIX_ROWS = 100_000


def quota_cover(counts: DataFrame, group: str, tag: str, n: str, quota: int, most: int | None = None, matrix_rows: int = MATRIX_ROWS) -> list[tuple[str, int]]:
    """Groups chosen one by one, each the one that fills most of what tags still lack: (group, gain), ties by name.

    Ends when no tag lacks anything, no group helps, or ``most`` are chosen. Each choice depends on those before. A matrix of at
    most ``matrix_rows`` rows is read once; of a larger one each round reads the best group alone. Both choose the same.
    """
    found = counts.select(F.col(group).alias("g"), F.col(tag).alias("t"), F.col(n).alias("n")).persist()
    try:
        lack = {r.t: quota for r in found.select("t").distinct().collect()}  # the vocabulary
        have: dict[str, dict[str, int]] | None = None
        if found.count() <= matrix_rows:
            have = {}
            for r in found.collect():
                have.setdefault(r.g, {})[r.t] = r.n
        out: list[tuple[str, int]] = []
        while any(lack.values()) and (most is None or len(out) < most):
            if have is not None:
                gain = {g: sum(min(v, lack[t]) for t, v in row.items()) for g, row in have.items()}
                best = min(gain, key=lambda g: (-gain[g], g), default=None)
                if best is None or not gain[best]:
                    break
                own, score = have.pop(best), gain[best]
            else:
                needed = F.lit(0)
                for t, v in lack.items():
                    needed = F.when(F.col("t") == t, F.least("n", F.lit(v))).otherwise(needed)
                rest = found.where(~F.col("g").isin([g for g, _ in out])) if out else found
                top = rest.groupBy("g").agg(F.sum(needed).alias("gain")).orderBy(F.desc("gain"), "g").limit(1).collect()
                if not top or not top[0].gain:
                    break
                best, score = top[0].g, top[0].gain
                own = {r.t: r.n for r in found.where(F.col("g") == best).collect()}
            for t, v in own.items():
                lack[t] = max(0, lack[t] - v)
            out.append((best, score))
        return out
    finally:
        found.unpersist()


def evaluation_subset(
    rows: DataFrame, key: str, scene: str, tags: list[str], quota: int = 80, random_scenes: int = 124, budget: int = 1800, per_scene: int = 12, seed: str = "subset"
) -> list[str]:
    """The keys of a stratified draw in three stages, ascending by scene and key.

    1. scenes that together hold ``quota`` positives of every tag (``quota_cover``); 2. ``random_scenes`` others in drawing order;
    3. rows of these: tag by tag, the rarest first, those with most tags still under quota (then in drawing order) until the tag has
    its quota, at most ``per_scene`` rows of a scene; then any rows in drawing order up to ``budget``.
    The driver holds what is chosen, at most ``budget`` keys; a round ranks candidates on the executors and brings no more than it takes.
    """
    flags = [F.coalesce(F.col(t), F.lit(False)).cast("int").alias(t) for t in tags]
    rows = rows.select(F.col(key).alias("k"), F.col(scene).alias("s"), *flags)
    long = rows.select("s", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(t).alias("y")) for t in tags])).alias("c"))
    core = [g for g, _ in quota_cover(long.groupBy("s", F.col("c.t").alias("t")).agg(F.sum("c.y").alias("n")), "s", "t", "n", quota)]
    others = rows.select("s").distinct().where(~F.col("s").isin(core)) if core else rows.select("s").distinct()
    extra = [r.s for r in others.orderBy(draw_order(seed, "s"), "s").limit(random_scenes).collect()]
    pool = rows.where(F.col("s").isin(core + extra)).withColumn("d", draw_order(seed, "k")).persist()
    try:
        total = pool.agg(*[F.sum(t).alias(t) for t in tags]).first()
        chosen: dict = {}
        full: dict = {}
        have = dict.fromkeys(tags, 0)

        def take(candidates: DataFrame, order: list[Column], most: int) -> None:
            if most <= 0:
                return
            room = F.lit(per_scene)
            used = {s: per_scene - n for s, n in full.items()}
            if used:
                room = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in used.items() for x in pair]), F.col("s")), room)
            nth = F.row_number().over(Window.partitionBy("s").orderBy(*order))
            rest = candidates.where(~F.col("k").isin(list(chosen))) if chosen else candidates
            for r in rest.withColumn("nth", nth).where(F.col("nth") <= room).orderBy(*order).limit(most).collect():
                chosen[r.k] = r.s
                full[r.s] = full.get(r.s, 0) + 1
                for t in tags:
                    have[t] += r[t]

        for tag in sorted(tags, key=lambda t: (total[t] or 0, tags.index(t))):
            unmet = [F.col(t) for t in tags if have[t] < quota]
            gain = sum(unmet[1:], unmet[0]) if unmet else F.lit(0)
            take(pool.where(F.col(tag) == 1), [F.desc(gain), F.col("d"), F.col("k")], min(quota - have[tag], budget - len(chosen)))
        take(pool, [F.col("d"), F.col("k")], budget - len(chosen))
        return sorted(chosen, key=lambda k: (chosen[k], k))
    finally:
        pool.unpersist()


def kind_cover(events: DataFrame, scene: str, kind: str, most: int) -> list[str]:
    """Up to ``most`` scenes, by name: one by one the scene with most kinds still missing (then most events, then the last name) until
    every kind is there, then those with most events (then the first name).

    Scenes of the same set of kinds differ only in number of events and name, so per set the ``most`` best of either order are all that
    can be chosen; the driver gets no others.
    """
    each = events.groupBy(scene).agg(F.array_sort(F.collect_set(kind)).alias("kinds"), F.count("*").alias("n")).withColumnRenamed(scene, "s")
    top = top_per_group(each, ["kinds"], [F.desc("n"), F.desc("s")], most).unionByName(each.orderBy(F.desc("n"), "s").limit(2 * most)).distinct()
    left = {r.s: (set(r.kinds), r.n) for r in top.collect()}
    need = set().union(*[k for k, _ in left.values()]) if left else set()
    picks: list = []
    while need and left and len(picks) < most:
        best = max(left, key=lambda s: (len(left[s][0] & need), left[s][1], s))
        if not left[best][0] & need:
            break
        need -= left.pop(best)[0]
        picks.append(best)
    return sorted(picks + sorted(left, key=lambda s: (-left[s][1], s))[: most - len(picks)])


def first_per_rule(rows: DataFrame, key: str, scene: str, rules: list[tuple[str, Column]], order: list[Column], fall_back: bool = False) -> list[tuple]:
    """Rule by rule the first row in ``order`` of a scene not yet used: (key, rule); with ``fall_back`` else the first row not yet used.

    A rule can lose at most one scene to each rule before it, so the first rows of as many scenes as there are rules are enough: no
    more reach the driver.
    """
    n = len(rules)
    out, used, taken = [], set(), set()
    for name, rule in rules:
        hits = rows.where(F.coalesce(rule, F.lit(False)))
        spread = top_per_group(hits, [scene], order, 1).orderBy(*order).limit(n).select(key, scene)
        found = next((r for r in spread.collect() if r[scene] not in used), None)
        if found is None and fall_back:
            found = next((r for r in hits.orderBy(*order).limit(n).select(key, scene).collect() if r[key] not in taken), None)
        if found is not None:
            used.add(found[scene])
            taken.add(found[key])
            out.append((found[key], name))
    return out


def one_per_group_then_more(rows: DataFrame, key: str, group: str, n: int, seed: str) -> DataFrame:
    """``n`` rows in drawing order, the first of each group before any second one."""
    order = [draw_order(seed, key), F.col(key)]
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("__again", nth > 1).orderBy("__again", *order).limit(n).drop("__again")


def rarest(prevalences: DataFrame, tag: str, prevalence: str, k: int) -> DataFrame:
    """The k rarest tags, ties by name, rarest first: one row with an array."""
    pairs = F.slice(F.array_sort(F.collect_list(F.struct(prevalence, tag))), 1, k)
    return prevalences.agg(F.transform(pairs, lambda p: p[tag]).alias("tags"))


def thumbnail(rows: DataFrame, panel: list[str], k: str, score: str) -> DataFrame:
    """Per panel the row with the highest score, then the nearest to the panel's middle, then the earliest."""
    w = Window.partitionBy(*panel)
    middle = (F.min(k).over(w) + F.max(k).over(w)) / 2
    rows = rows.withColumn("__off", F.abs(F.col(k) - middle))
    return rows.groupBy(*panel).agg(F.max_by(k, F.struct(score, -F.col("__off"), -F.col(k))).alias("thumbnail"))


def drawn_groups(rows: DataFrame, group: str, n: int, seed: str) -> DataFrame:
    """The rows of ``n`` groups in drawing order."""
    return rows.join(rows.select(group).distinct().orderBy(draw_order(seed, group), group).limit(n), group, "left_semi")


def pair_items(rows: DataFrame, key: str, k: str, token: str, groups: int | None = None, seed: str = "pairs") -> DataFrame:
    """Each row with its neighbours' tokens, of ``groups`` drawn keys if that is given; rows without one on either side are left out."""
    rows = rows if groups is None else drawn_groups(rows, key, groups, seed)
    w = Window.partitionBy(key).orderBy(k)
    return rows.select(key, k, token, F.lag(token).over(w).alias("before"), F.lead(token).over(w).alias("after")).where("before is not null and after is not null")


def spread_over_groups(rows: DataFrame, key: str, group: str, score: str, n: int) -> DataFrame:
    """The best row of each group first, then the next best, until there are ``n``: ties by key."""
    w = Window.partitionBy(group).orderBy(F.desc(score), key)
    ranked = top_per_group(rows, [group], [F.desc(score), F.col(key)], n).withColumn("round", F.row_number().over(w))
    return ranked.orderBy("round", F.desc(score), key).limit(n)

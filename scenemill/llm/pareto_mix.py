"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations throughout.

A source whose target is r times its size gives every document floor(r) copies for certain. The rest of
the target is drawn: document i gets one more copy with inclusion probability p_i, by ranking documents by
[u / (1 - u)] / [p / (1 - p)] (u uniform, a hash of the id) and taking the lowest (Rosen, "On sampling with
probability proportional to size", 1997). The size of the draw is fixed in words: the ranking is cut where
the words come nearest to what the source still lacks. Probabilities are unequal: they grow with a
document's size class (the bit length of its word count), scaled so that the expected words are the
lacking words.

Ranking never gathers a source in one task: its documents are counted into score bins, the bin in which
the cut falls is found from the counts, and only the documents of that bin are binned again, then sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenemill.llm.common import SPACES, fresh, materialise, row_key, text_of

#: Targets stop at this many times a source's size.
MAX_REPEAT = 3

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (1.0, 2.0, 3.0)

#: Score bins of each of the two rounds.
BINS = 1024

#: u is a multiple of 2^-52, so that 1 - u is exact and never 0.
_STEPS = 1 << 52


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACES}]+")).cast("long")


def uniform(*columns: str, seed: str = "mix") -> Column:
    """A number in (0, 1) from the MD5 of the columns: any engine gives the same."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(_STEPS)


def _ranked(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``rank`` from 0 in the given order, without gathering them: places in range partitions, and the partitions' sizes."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    placed = placed.withColumn("part", F.shiftright(place, 33)).withColumn("place", place.bitwiseAND(F.lit((1 << 33) - 1)))
    placed = materialise(placed, "mix-placed")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("place")).drop("part", "place", "start")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, source_size)``, one row per source.

    Targets share the sum of all sizes by weight; where one would pass its cap, the excess is shared among
    the others by weight until none does. A round of sharing is one aggregate over the sources, and only
    two sums reach the driver.
    """
    ranked = _ranked(sizes, F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    rows = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_repeat)).drop("rank")
    rows = materialise(rows, "mix-weights")
    total, open_ = rows.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    level = total / open_ if open_ else 0.0
    while open_:
        over = F.lit(level) * F.col("weight") > F.col("cap")
        capped, open_ = rows.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        before, level = level, (total - (capped or 0.0)) / open_ if open_ else float("inf")
        if level == before:
            break
    return rows.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def _inclusion(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, class, copies, lacking, p)``: certain copies, lacking words and inclusion probability.

    Within a source the probability of class c is min(1, k c). Classes reach 1 from the highest down, so k
    follows from running sums over the at most 63 classes of a source.
    """
    classes = sized.groupBy("source", "class").agg(F.sum("size").alias("words"))
    rows = classes.join(targets, classes.source.eqNullSafe(targets.source)).select(
        classes.source, "class", "words", "source_size", "target"
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("copies", F.floor(ratio)).withColumn("lacking", F.col("target") - F.floor(ratio) * F.col("source_size"))
    down = Window.partitionBy("source").orderBy(F.desc("class"))
    sure = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("class")).over(down.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("k", F.when(rest > 0, (F.col("lacking") - sure) / rest))
    whole = Window.partitionBy("source")
    k = F.max(F.when((F.col("k") >= 0) & (F.col("k") * F.col("class") <= 1), F.col("k"))).over(whole)
    p = F.least(F.lit(1.0), F.coalesce(k * F.col("class"), F.lit(1.0)))
    return rows.select("source", "class", "copies", "lacking", p.alias("p"))


def _cut(bins: DataFrame, lacking: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of ``bins(*by, words)``, per source the bin in which the running words pass ``lacking``, with the words before it."""
    joined = bins.join(lacking, bins.source.eqNullSafe(lacking.source)).select(*[bins[c] for c in by], "words", "lacking")
    before = Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = joined.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    return rows.where((F.col("before") < F.col("lacking")) & (F.col("before") + F.col("words") >= F.col("lacking")))


def pareto_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    max_repeat: float = MAX_REPEAT,
    row_keys: bool = False,
) -> DataFrame:
    """One row per input row: ``id_col, size, source_size, target, taken`` (and ``row_key`` on request).

    ``size`` counts runs of anything but ASCII white space; null texts have none. ``taken`` is the row's
    copies in the mix times its size, copies being at most ``max_repeat`` rounded up. Null is a source of
    its own, the last in order. The draw depends on ids and sizes alone, so reruns agree; rows that share
    an id and a size are ranked one after the other. Extra columns are ignored; an empty table gives an
    empty result.
    """
    size = word_count(text_of(text_col))
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), *([row_key(text_col).alias("row_key")] if row_keys else [])
    )
    sized = sized.withColumn("class", F.length(F.bin("size")).cast("int"))
    sized = materialise(sized, "mix-sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    targets = materialise(targets, "mix-targets")
    inclusion = materialise(_inclusion(sized, targets), "mix-inclusion")
    u = uniform("id", "size")
    odds = u / (F.lit(1.0) - u)
    score = F.when(F.col("p") >= 1.0, F.lit(0.0)).when(F.col("p") <= 0.0, F.lit(1.0)).otherwise(odds / (odds + F.col("p") / (F.lit(1.0) - F.col("p"))))
    on = sized.source.eqNullSafe(inclusion.source) & (sized["class"] == inclusion["class"])
    scored = sized.join(inclusion, on).select(sized["*"], "copies", "p", F.col("lacking").alias("lacking_all"), score.alias("score"))
    # Rows taken for certain have a bin of their own before all others, which no cut can fall into: their words are within what is lacking.
    scored = scored.withColumn("bin", F.when(F.col("p") >= 1.0, F.lit(-1).cast("long")).otherwise(F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1))))
    fine = F.least(F.floor((F.col("score") * BINS - F.col("bin")) * BINS), F.lit(BINS - 1))
    scored = materialise(scored.withColumn("fine", fine), "mix-scored")
    lacking = inclusion.groupBy("source").agg(F.first("lacking").alias("lacking"))
    coarse = materialise(
        _cut(scored.groupBy("source", "bin").agg(F.sum("size").alias("words")), lacking, ["source", "bin"], "bin").select(
            "source", F.col("bin").alias("cut_bin"), (F.col("lacking") - F.col("before")).alias("lacking")
        ),
        "mix-coarse",
    )
    inside = scored.join(coarse, scored.source.eqNullSafe(coarse.source) & (scored.bin == coarse.cut_bin)).select(scored["*"])
    finer = materialise(
        _cut(inside.groupBy("source", "fine").agg(F.sum("size").alias("words")), coarse.select("source", "lacking"), ["source", "fine"], "fine").select(
            "source", F.col("fine").alias("cut_fine"), (F.col("lacking") - F.col("before")).alias("lacking")
        ),
        "mix-finer",
    )
    cuts = coarse.drop("lacking").join(finer, coarse.source.eqNullSafe(finer.source)).select(coarse.source, "cut_bin", "cut_fine", "lacking")
    cuts = materialise(cuts, "mix-cuts")
    joined = scored.join(cuts, scored.source.eqNullSafe(cuts.source), "left").select(scored["*"], "cut_bin", "cut_fine", "lacking")
    # Rows of a source without a cut (its certain copies reach the target) get no further copy.
    below = (F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & (F.col("fine") < F.col("cut_fine")))
    at = (F.col("bin") == F.col("cut_bin")) & (F.col("fine") == F.col("cut_fine"))
    sure = (F.col("bin") == -1) & (F.col("lacking_all") > 0)
    joined = joined.withColumn("side", F.when(sure, -1).when(F.col("cut_bin").isNull(), 1).when(below, -1).when(at, 0).otherwise(1))
    order = Window.partitionBy("source").orderBy("score", F.col("id").isNull(), "id", "size")
    last = joined.where("side = 0").withColumn("words", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # The document that the cut falls in is taken if that comes nearer to the target than leaving it.
    more = F.col("words") - F.col("size") + F.col("size") / 2.0 <= F.col("lacking")
    picked = last.withColumn("extra", F.when(more & (F.col("size") > 0), 1).otherwise(0)).drop("words")
    rest = joined.where("side <> 0").withColumn("extra", F.when((F.col("side") < 0) & (F.col("size") > 0), 1).otherwise(0))
    drawn = rest.unionByName(picked)
    return (
        drawn.join(targets, drawn.source.eqNullSafe(targets.source))
        .select(
            F.col("id").alias(id_col), "size", "source_size", "target", ((F.col("copies") + F.col("extra")) * F.col("size")).cast("long").alias("taken"),
            *(["row_key", (F.col("copies") + F.col("extra")).cast("long").alias("copies")] if row_keys else []),
        )
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: the rows of ``docs`` that it takes, once per copy, all columns kept, whatever they are called.

    Of a row without words (null and empty texts too) no copy is counted; it stays out. An empty table stays empty.
    """
    taken = pareto_mix(docs.select(id_col, text_col, source_col), id_col, text_col, source_col, row_keys=True, **how)
    id_, key, copies, least, total, nth = fresh(docs, "__id", "__key", "__copies", "__least", "__sum", "__nth")
    drawn = F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(0)).cast("long")
    taken = taken.select(F.col(id_col).alias(id_), F.col("row_key").alias(key), drawn.alias(copies)).groupBy(id_, key)
    taken = taken.agg(F.min(copies).alias(least), F.max(copies).alias(copies), F.sum(copies).alias(total))
    taken = materialise(taken.where(F.col(copies) > 0), "mix-taken")
    on = F.col(id_col).eqNullSafe(F.col(id_)) & (row_key(text_col) == F.col(key))
    rows = docs.join(taken.where(F.col(least) == F.col(copies)), on)
    uneven = taken.where(F.col(least) < F.col(copies)).withColumn(copies, F.col(total))
    if not uneven.isEmpty():  # rows that repeat id and text, of which the draw took some: one of them stands for all
        rows = rows.unionByName(docs.join(uneven, on).dropDuplicates([id_, key]))
    rows = rows.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return rows.select(*docs.columns)

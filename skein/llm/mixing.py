"""Mixing sources to target weights by entropy balancing.

Every document starts with the rate 1. Among all rates whose words meet each source's target, the ones
nearest to 1 in relative entropy are exponentially tilted, ``rate = exp(sum of the multipliers of the
document's constraints)``. The multipliers minimise the convex dual
``sum(words * exp(multiplier)) - sum(multiplier * target)``; damped Newton steps find them as Spark jobs over
the words of each combination of constraints. Rates then become whole copies: their integer part, and for
the fraction every so many-th document of a source, in order of size, one more. What a source then lacks of its target or
has beyond it, less than its largest document, other documents make up for: as many as fit of the largest size that fits, then of
the next that fits into what is left, until none does, and one of the smallest left if that ends nearer to the target.
Both steps are sums over the sizes that occur in a source and ranks inside one size; no source is gathered.

Targets: the sources by code point, null last, weigh 1, 2, 3, 1, 2, 3, ... and share all words; a target
stops at ``most`` times its source's words and the excess is shared again by weight until none is above.

Cases. Null text: no words, nothing taken. Null source: a source of its own, last. Repeated rows: rows of
their own; which of them is taken follows from their place in the input. A null doc_id is a value. A source without words has the target 0. An empty table gives an empty result. Further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import ROW, documents, free_name, materialise, need, numbered, ranked, split_words

#: No document is taken more often, and no source beyond so many times its words.
MOST = 3.0
#: Newton ends when every constraint is met so closely, or after so many steps.
TOLERANCE = 1e-9
STEPS = 40


def source_targets(sizes: DataFrame, most: float = MOST) -> DataFrame:
    """source, source_size, target of each source. sizes: source, words.

    The sources are numbered by one window over one row a source; the resharing is a loop of at most as
    many rounds as there are sources, each a pair of sums, in practice two or three.
    """
    per = materialise(sizes.groupBy("source").agg(F.sum("words").cast("long").alias("source_size")), "sources")
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    state = per.select(
        "source", "source_size", ((F.row_number().over(order) - 1) % 3 + 1).cast("double").alias("weight"),
        F.lit(None).cast("double").alias("target"),
    )
    total = float(per.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    while True:
        left, weight = state.agg(
            F.lit(total) - F.coalesce(F.sum("target"), F.lit(0.0)), F.sum(F.when(F.col("target").isNull(), F.col("weight")))
        ).first()
        if not weight:
            return state.drop("weight")
        share = F.col("weight") * (left / weight)
        ceiling = most * F.col("source_size")
        full = F.col("target").isNull() & (share >= ceiling)
        if not state.where(full).limit(1).count():
            return state.select("source", "source_size", F.coalesce("target", share).alias("target"))
        state = materialise(state.withColumn("target", F.when(full, ceiling).otherwise(F.col("target"))), "targets")


def entropy_multipliers(cells: DataFrame, targets: dict[str, DataFrame], steps: int = STEPS, tolerance: float = TOLERANCE) -> dict[str, DataFrame]:
    """Per constraint column the multiplier of each value: (value, multiplier).

    cells: one row for each combination of the constraint columns, with its words. targets: by column, a frame
    (value, target). A step goes through the columns; within one column the Hessian of the dual is diagonal, so
    its Newton step is (target - words) / words for each value, at most ``1`` in size.
    """
    found = {c: t.select("value", "target", F.lit(0.0).alias("multiplier")) for c, t in targets.items()}
    for step in range(steps):
        worst = 0.0
        for c in targets:
            tilted = cells
            for other, state in found.items():
                held = state.select(F.col("value").alias(f"v_{other}"), F.col("multiplier").alias(f"m_{other}"))
                tilted = tilted.join(held, F.col(other).eqNullSafe(F.col(f"v_{other}")), "left")
            rate = F.exp(sum((F.coalesce(F.col(f"m_{o}"), F.lit(0.0)) for o in found), F.lit(0.0)))
            now = tilted.groupBy(F.col(c).alias("at")).agg(F.sum(F.col("words") * rate).alias("now"))
            gap = F.when(F.col("now") > 0, (F.col("target") - F.col("now")) / F.col("now")).otherwise(0.0)
            moved = (
                found[c].drop("now").join(now, F.col("value").eqNullSafe(F.col("at")), "left").withColumn("now", F.coalesce("now", F.lit(0.0)))
                .select("value", "target", "now", (F.col("multiplier") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), gap))).alias("multiplier"))
            )
            found[c] = materialise(moved, f"newton-{step}")
            off = F.abs(F.col("target") - F.col("now")) / F.greatest(F.col("target"), F.lit(1.0))
            worst = max(worst, found[c].where(F.col("now") > 0).agg(F.max(off)).first()[0] or 0.0)
        if worst <= tolerance:
            break
    return {c: s.select("value", "multiplier") for c, s in found.items()}


def _upto(rank: Column) -> Column:
    """How many of a source's first ``rank`` documents get one more copy."""
    return F.floor(rank * F.col("part") + 0.5).cast("long")


def gap_fillers(sizes: DataFrame) -> DataFrame:
    """filled, fill, turned: how many documents of which size make up for a source's gap. sizes: of (a source), size, gap, able.

    A round takes one size of every source: the largest below the last one that fits into what is left, as often as it fits. State is
    one row a source; as sizes lie close together, what is left shrinks by more than half in most rounds.
    """
    state = materialise(sizes.where("able > 0").groupBy("of").agg(F.abs(F.first("gap")).alias("left"), (F.max("size") + 1).alias("last")), "gaps")
    taken = None
    while True:
        fits = sizes.where("able > 0").join(state.withColumnRenamed("of", "at"), F.col("of").eqNullSafe(F.col("at"))).where((F.col("size") <= F.col("left")) & (F.col("size") < F.col("last")))
        best = fits.groupBy("of").agg(F.max(F.struct("size", "able")).alias("top"), F.first("left").alias("left"))
        turned = F.least(F.col("top.able"), F.floor(F.col("left") / F.col("top.size"))).cast("long")
        step = materialise(best.select(F.col("of").alias("filled"), F.col("top.size").alias("fill"), turned.alias("turned"), (F.col("left") - turned * F.col("top.size")).alias("left")), "filled")
        taken = step if taken is None else taken.unionByName(step)
        if not step.limit(1).count():
            break
        state = step.select(F.col("filled").alias("of"), "left", F.col("fill").alias("last"))
    # one of the smallest size that is left goes beyond the target, if that ends nearer to it
    used = taken.select("filled", "fill", "turned")
    unused = sizes.join(used, F.col("of").eqNullSafe(F.col("filled")) & (F.col("size") == F.col("fill")), "left").where(F.col("able") > F.coalesce("turned", F.lit(0)))
    beyond = unused.groupBy("of").agg(F.min("size").alias("least"), F.abs(F.first("gap")).alias("gap"))
    done = taken.groupBy(F.col("filled").alias("at")).agg(F.sum(F.col("turned") * F.col("fill")).alias("sum"))
    left = F.col("gap") - F.coalesce("sum", F.lit(0))
    one = beyond.join(done, F.col("of").eqNullSafe(F.col("at")), "left").where((F.col("least") > left) & (F.col("least") < 2 * left))
    return used.unionByName(one.select(F.col("of").alias("filled"), F.col("least").alias("fill"), F.lit(1).cast("long").alias("turned"))).groupBy("filled", "fill").agg(F.sum("turned").alias("turned"))


def whole_copies(sized: DataFrame, rates: DataFrame) -> DataFrame:
    """uid, copies of each row. sized: uid, doc_id, source, words; rates: of (a source), target, rate."""
    at = F.col("source").eqNullSafe(F.col("of"))
    part = F.greatest(F.lit(0.0), F.col("rate") - F.floor(F.col("rate") + 1e-9))
    split = rates.select("of", "target", F.floor(F.col("rate") + 1e-9).cast("long").alias("whole"), F.when(part > 1e-9, part).otherwise(0.0).alias("part"))
    # the sizes of a source, largest first: documents of each, those before it, and how many of them the steps take
    sizes = sized.where("words > 0").groupBy("source", "words").agg(F.count("*").alias("n"))
    first = Window.partitionBy("of").orderBy(F.desc("words")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.join(split, at).withColumn("before", F.coalesce(F.sum("n").over(first), F.lit(0)))
    sizes = sizes.withColumn("more", _upto(F.col("before") + F.col("n")) - _upto(F.col("before")))
    gap = F.floor(F.max("target").over(Window.partitionBy("of")) + 0.5 - F.sum(F.col("words") * (F.col("whole") * F.col("n") + F.col("more"))).over(Window.partitionBy("of")))
    # the documents that can make up for the gap: those without one more copy where words lack, else those with one
    sizes = sizes.withColumn("gap", gap).withColumn("able", F.when(F.col("part") == 0, 0).when(F.col("gap") >= 0, F.col("n") - F.col("more")).otherwise(F.col("more")))
    sizes = materialise(sizes.select("of", F.col("words").alias("size"), "whole", "part", "before", "gap", "able"), "size-steps")
    sizes = sizes.join(gap_fillers(sizes), F.col("of").eqNullSafe(F.col("filled")) & (F.col("size") == F.col("fill")), "left").withColumn("turned", F.coalesce("turned", F.lit(0)))
    sizes = materialise(sizes.select("of", "size", "whole", "part", "before", "gap", "turned"), "size-turns")
    placed = ranked(sized.where("words > 0"), ["source", "words"], F.xxhash64("doc_id", F.lit(17)), "uid")
    placed = placed.join(sizes, at & (F.col("words") == F.col("size")))
    picked_before = _upto(F.col("before") + F.col("rank")) - _upto(F.col("before"))
    picked = _upto(F.col("before") + F.col("rank") + 1) - _upto(F.col("before") + F.col("rank"))
    own = F.when(F.col("gap") >= 0, F.when((picked == 0) & (F.col("rank") - picked_before < F.col("turned")), 1).otherwise(picked)).otherwise(
        F.when((picked == 1) & (picked_before < F.col("turned")), 0).otherwise(picked)
    )
    return placed.select("uid", (F.col("whole") + own).cast("long").alias("copies"))


def mix(docs: DataFrame, weights_by: str = "source", most: float = MOST) -> DataFrame:
    """Copies of every row of ``docs`` (doc_id, text, source): uid, doc_id, source, words, source_size, target, rate, copies.

    The text is read once, for its number of words; all else moves rows of a few numbers.
    """
    base = need(docs, doc_id=T.LongType(), text=T.StringType(), **{weights_by: T.StringType()}).withColumnRenamed(weights_by, "source")
    sized = materialise(
        base.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "source", F.size(split_words(F.col("text"))).cast("long").alias("words")), "sizes"
    )
    return mix_sizes(sized, most)


def mix_sizes(sized: DataFrame, most: float = MOST) -> DataFrame:
    """As ``mix``, from rows of uid, doc_id, source, words."""
    targets = materialise(source_targets(sized.select("source", "words"), most), "source-targets")
    cells = materialise(sized.groupBy("source").agg(F.sum("words").cast("double").alias("words")), "cells")
    multiplier = entropy_multipliers(cells, {"source": targets.select(F.col("source").alias("value"), "target")})["source"]
    rates = materialise(
        targets.join(multiplier, F.col("source").eqNullSafe(F.col("value"))).select(
            F.col("source").alias("of"), "source_size", "target", F.least(F.lit(most), F.when(F.col("target") > 0, F.exp("multiplier")).otherwise(0.0)).alias("rate"),
        ),
        "rates",
    )
    copies = whole_copies(sized, rates)
    rated = sized.join(rates, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return rated.join(copies, "uid", "left").withColumn("copies", F.coalesce("copies", F.lit(0)).cast("long"))


def op2_entropy_mix(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, under the production weights."""
    found = mix(documents(spark, sf_dir, "doc_id", "text", "source"))
    return found.select(
        "doc_id", F.col("words").alias("size"), "source_size", F.round("target", 6).alias("target"),
        (F.col("copies") * F.col("words")).alias("taken"), "copies", F.round("rate", 9).alias("rate"),
    )


def mixed_documents(docs: DataFrame, most: float = MOST) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it."""
    rows = numbered(docs)
    sized = materialise(
        rows.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), "source", F.size(split_words(F.col("text"))).cast("long").alias("words"))
        .withColumnRenamed(ROW, "uid"), "sizes",
    )
    again, which = free_name(docs, "copies"), free_name(docs, "copy")
    copies = mix_sizes(sized, most).where(F.col("copies") > 0).select(F.col("uid").alias(ROW), F.col("copies").cast("int").alias(again))
    taken = rows.join(copies, ROW)
    return taken.withColumn(which, F.explode(F.sequence(F.lit(1), F.col(again)))).select(*(F.col(f"`{c}`") for c in docs.columns))

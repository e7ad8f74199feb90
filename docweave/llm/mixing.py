"""Mix sources to target weights by Pareto order sampling.

Targets. Sources share ``share`` times all words by weight; a target stops at
``most`` times its source's words and the excess is shared again by weight
until none is above. In closed form: with sources in order of words over
weight, a source is at its limit if its limit is no more than its part of
what the sources before it leave.

Sample. Each document is first taken whole ``floor(target / words)`` times.
For the words that are left, a document's inclusion probability is in
proportion to its measure: the bytes of its text, or ``measure_col`` (a
quality, say). Probabilities are scaled, source by source, so that the words
expected are the words left; those that would be over one are one (certain).
The scale comes from sums over 1/64 octaves of the measure. With a uniform
number u from a hash of id and text, documents are ranked by their random
odds over their inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken in
that order up to the words that are left: the sample's size is fixed, in
words, to within half a document.

The cut is found without sorting a source: words are summed in groups of
``GROUP`` bins of the rank, then in the bins of the one group that holds the
cut, and only the documents of the one bin that holds it are ordered, so
sources may be of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import WORD, small, stage, unit_uniform
from docweave.llm.keep import row_key

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
BINS = 1 << 14
GROUP = 1 << 7
#: Steps of the measure in a doubling, for finding the scale of the probabilities.
STEPS = 64


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (``source, source_size``; one row a source) with ``target``.
    Weights repeat over the sources in code point order, null last."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("limit"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(whole) * F.lit(float(share))
    s = s.select("*", total.alias("total"), F.sum("weight").over(whole).alias("weights"),
                 F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("limit_before"),
                 F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"))
    full = F.col("limit") * (F.col("weights") - F.col("weight_before")) <= (F.col("total") - F.col("limit_before")) * F.col("weight")
    s = s.withColumn("full", full)
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(whole), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    return s.select("source", "source_size",
                    F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * left / open_weight).alias("target"))


def _ident(doc_id):
    return F.coalesce(doc_id, F.lit((1 << 63) - 1))


def _rank(u, measure, scale):
    """Random odds over inclusion odds, mapped from (0, inf) to (0, 1)."""
    p = F.least(F.greatest(F.coalesce(measure * scale, F.lit(0.0)), F.lit(1e-9)), F.lit(1 - 1e-9))
    odds = (u / (1 - u)) / (p / (1 - p))
    return odds / (1 + odds)


def _uniform(doc_id, key):
    return unit_uniform(doc_id, key, F.lit("mix"))


def _bin(rank):
    return F.least(F.floor(rank * BINS), F.lit(BINS - 1))


def _measure(text, measure):
    """Non-negative, finite measure of a document; by default its bytes."""
    if measure is None:
        return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("double")
    m = measure.cast("double")
    return F.when((m > 0) & (m < float("inf")), m).otherwise(0.0)


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, measure_col: str | None) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return stage(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(text_col)).alias("row_key"),
        F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        _measure(F.col(text_col), None if measure_col is None else F.col(measure_col)).alias("measure")))


def _scales(rows: DataFrame) -> DataFrame:
    """``scale_source, scale``: a document's probability is its measure times
    the scale, at most one. Steps of the measure are certain from the largest
    down as long as the words left for the rest would give its largest step a
    probability over one."""
    step = F.floor(F.log2("measure") * STEPS)
    sums = (rows.filter("measure > 0").groupBy("mix_source", "left", step.alias("step"))
            .agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("measure")).alias("weighted")))
    own = Window.partitionBy("mix_source")
    above = F.coalesce(F.sum("words").over(own.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum("weighted").over(own.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    scale = F.when(below > 0, (F.col("left") - above) / below)
    sums = sums.select("mix_source", "step", scale.alias("scale"))
    return (sums.filter(F.col("scale") * F.pow(F.lit(2.0), F.col("step") / STEPS) <= 1)
            .groupBy(F.col("mix_source").alias("scale_source")).agg(F.max_by("scale", "step").alias("scale")))


def _with_plan(rows: DataFrame, source, plan: DataFrame) -> DataFrame:
    plan = small(plan)
    return rows.join(plan, source.eqNullSafe(plan["mix_source"]))


def _crossing(ranked: DataFrame, place: str, start) -> DataFrame:
    """``mix_source, <place>, before`` of the place at which each source's
    running words, from ``start`` on, reach what is left to draw."""
    run = Window.partitionBy("mix_source").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    sums = (ranked.groupBy("mix_source", place, "left", start.alias("start")).agg(F.sum("size").alias("words"))
            .withColumn("before", F.col("start") + F.coalesce(F.sum("words").over(run), F.lit(0))))
    return sums.filter((F.col("before") < F.col("left")) & (F.col("before") + F.col("words") >= F.col("left"))).select(
        "mix_source", place, "before")


def plan_mix(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row a source: ``mix_source, source_size, target, whole`` (copies of
    every document), ``left`` (words to draw), ``scale``, and the cut: documents in bins
    under ``cut_bin`` are drawn, and in it those up to ``cut`` (rank, id, key).
    Without a cut bin all are drawn if any words are left to draw."""
    shares = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    shares = stage(shares.select(F.col("source").alias("mix_source"), "source_size", "target", whole.cast("long").alias("whole"))
                   .withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")))
    scales = _scales(_with_plan(sizes, sizes["source"], shares))
    shares = stage(shares.join(scales, shares["mix_source"].eqNullSafe(F.col("scale_source")), "left").drop("scale_source"))
    rank = _rank(_uniform("doc_id", "row_key"), F.col("measure"), F.col("scale"))
    ranked = _with_plan(sizes, sizes["source"], shares).withColumn("rank", rank).withColumn("bin", _bin(F.col("rank")))
    group = F.floor(F.col("bin") / GROUP)
    coarse = _crossing(ranked.withColumn("group", group), "group", F.lit(0)).select(
        F.col("mix_source").alias("in_source"), "group", F.col("before").alias("start"))
    inner = ranked.join(coarse, ranked["mix_source"].eqNullSafe(F.col("in_source")) & (group == F.col("group")))
    cut = stage(_crossing(inner, "bin", F.col("start")).select(F.col("mix_source").alias("cut_source"), F.col("bin").alias("cut_bin"), "before"))
    cut = small(cut)
    within = ranked.join(cut, ranked["mix_source"].eqNullSafe(cut["cut_source"]) & (ranked["bin"] == cut["cut_bin"]))
    own = F.struct("rank", _ident(F.col("doc_id")).alias("ident"), "row_key")
    run = Window.partitionBy("mix_source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    last = (within.groupBy("mix_source", "left", "before", own.alias("place")).agg(F.sum("size").alias("words"))
            .withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(run), F.lit(0)))
            .filter(F.col("before") + F.col("words") / 2 <= F.col("left"))
            .groupBy(F.col("mix_source").alias("last_source")).agg(F.max("place").alias("cut")))
    return stage(shares.join(cut.drop("before"), shares["mix_source"].eqNullSafe(F.col("cut_source")), "left")
                 .join(last, shares["mix_source"].eqNullSafe(F.col("last_source")), "left").drop("cut_source", "last_source"))


def _copies(doc_id, key, measure):
    """Copies of a document, from the columns of its source's plan row."""
    rank = _rank(_uniform(doc_id, key), measure, F.col("scale"))
    place = F.struct(rank.alias("rank"), _ident(doc_id).alias("ident"), key.alias("row_key"))
    drawn = F.when(F.col("cut_bin").isNull(), F.col("left") > 0).otherwise(
        (_bin(rank) < F.col("cut_bin")) | ((_bin(rank) == F.col("cut_bin")) & F.coalesce(place <= F.col("cut"), F.lit(False))))
    return F.col("whole") + drawn.cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, measure_col: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, copies,
    taken`` (words, repeats counted).

    Null and empty texts have size 0 and come last in rank; a measure that is
    null, negative or not finite is 0;
    rows that repeat an id and a text have one rank and share their fate; a
    null id is drawn by its text; a null source is a source of its own; a
    source without words has target 0; an empty table gives no rows; other
    columns are not read. Reruns agree."""
    sizes = _sizes(docs, id_col, text_col, source_col, measure_col)
    rows = _with_plan(sizes, sizes["source"], plan_mix(sizes, weights, share, most))
    return (rows.withColumn("copies", _copies(F.col("doc_id"), F.col("row_key"), F.col("measure")))
            .select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")))


def draw(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, measure_col: str | None = None) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as ``mix`` takes
    it, all columns as they are. Texts do not move: a row needs only its
    source's plan row. Nulls, ties, repeated rows and empty tables are as in
    ``mix``; columns may have any names."""
    plan = plan_mix(_sizes(docs, id_col, text_col, source_col, measure_col), weights, share, most)
    inner = [f"c{i}" for i in range(len(docs.columns))]       # own names, so that no column can clash with the plan's
    at = dict(zip(docs.columns, inner))
    rows = docs.toDF(*inner)
    rows = _with_plan(rows, rows[at[source_col]].cast("string"), plan)
    measure = _measure(rows[at[text_col]], None if measure_col is None else rows[at[measure_col]])
    copies = _copies(rows[at[id_col]].cast("long"), row_key(rows[at[text_col]]), measure)
    times = F.explode(F.array_repeat(F.lit(0), copies.cast("int")))
    return rows.select(*inner, times.alias("copy")).drop("copy").toDF(*docs.columns)

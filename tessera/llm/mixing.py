"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, materialise

#: Source weights by code-point order of the source, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix against those of the documents, and the most that a source may repeat.
SHARE, CAP = 1.5, 2
#: Steps of each of the two histograms by which a source's cut is found.
STEPS = 256


def n_words(text: str = "text") -> Column:
    """Words of the white-space rule; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: str = "text") -> Column:
    """Weight from 0.25 to 2: the share of a text's characters that aren't markup or table symbols; 1 for an empty text."""
    rest = F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))
    return F.when(F.length(text) > 0, 0.25 + 1.75 * (rest / F.length(text))).otherwise(F.lit(1.0))


def sampling_key(weight: Column, doc_id: str = "doc_id", text: str = "text") -> Column:
    """Exponential variate of rate ``weight``, a function of id and text alone, so that reruns agree."""
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    return -F.log(uniform) / weight


def _step(key: Column) -> Column:
    """Number of the key's step among STEPS squared, rising with the key."""
    return F.least(F.lit(STEPS * STEPS - 1), F.floor((1 - F.exp(-key)) * (STEPS * STEPS))).cast("int")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Adds ``target`` to rows (source, source_size).

    Sources share the words of the mix by weight; one above cap times its size
    stops there and the others share the excess. Sorted by cap times size over
    weight, the sources that stop come first, so one running sum settles all
    rounds of resharing. There is one row per source here, not per document: that
    is what the two windows without partitions run over.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(in_order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    stops = ranked.withColumn("level", level).withColumn("stops", F.col("most") <= F.col("level") * F.col("weight"))
    shared = stops.withColumn("shared", F.min(F.when(~F.col("stops"), F.col("level"))).over(everything))
    return shared.select("source", "source_size", F.when(F.col("stops"), F.col("most")).otherwise(F.col("shared") * F.col("weight")).alias("target"))


def plan_mix(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source that says which of its documents the mix takes.

    rows: (source, size, key), materialised. Result: source, source_size, target,
    epochs (complete passes over the source), rest (words left for the fractional
    pass), cut_step and cut_key (the pass takes documents of a lower step, and
    those of the step up to the key), extra_key (one further document, whose size
    completes the rest best; null if none does).

    The running sum over a source is taken in three strides: over 256 steps of the
    key, over 256 steps within the step that holds the cut, and over the documents
    of the last step. So a source of any size is summed by many tasks, and one
    task sorts 1/65536 of it.
    """
    rows = rows.withColumn("step", _step(F.col("key")))
    coarse = materialise(rows.groupBy("source", F.expr(f"step div {STEPS}").alias("hi")).agg(F.sum("size").alias("size")), "steps")
    targets = source_targets(coarse.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    goals = materialise(targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "goals")

    def same(left: DataFrame, right: DataFrame, how: str, *more: str) -> DataFrame:
        """Join on source, where null is a value, and further columns; the right side's keys go."""
        renamed = right.withColumnsRenamed({c: f"_{c}" for c in ("source", *more)})
        on = F.col("source").eqNullSafe(F.col("_source"))
        for c in more:
            on = on & (F.col(c) == F.col(f"_{c}"))
        return left.join(renamed, on, how).drop(*[f"_{c}" for c in ("source", *more)])

    def first_over(sums: DataFrame, at: str, prior: Column) -> DataFrame:
        """Per source the first step whose running sum passes the rest, and the sum before it."""
        w = Window.partitionBy("source").orderBy(at)
        run = sums.withColumn("upto", prior + F.sum("size").over(w)).where("upto > rest")
        return run.groupBy("source").agg(F.min(F.struct(F.col(at), (F.col("upto") - F.col("size")).alias("prior"))).alias("x")).select("source", "x.*")

    in_hi = first_over(same(coarse, goals.select("source", "rest"), "inner"), "hi", F.lit(0))
    in_hi = materialise(same(in_hi, goals.select("source", "rest"), "inner"), "cuts")
    lo = same(rows.withColumn("hi", F.expr(f"step div {STEPS}")), in_hi, "inner", "hi").groupBy("source", "step").agg(F.sum("size").alias("size"), F.first("prior").alias("prior"), F.first("rest").alias("rest"))
    cut = first_over(lo, "step", F.col("prior"))
    cut = materialise(same(cut, goals.select("source", "rest"), "inner"), "cuts")
    last = same(rows, cut, "inner", "step").withColumn("upto", F.col("prior") + F.sum("size").over(Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)))
    fits = last.where("upto <= rest").groupBy("source").agg(F.max("key").alias("cut_key"), F.max("upto").alias("upto"))
    plan = same(same(goals, cut.select("source", F.col("step").alias("cut_step"), "prior"), "left"), fits, "left")
    plan = materialise(plan.withColumn("short", F.col("rest") - F.coalesce("upto", "prior", F.lit(0))), "plan")

    # The document that completes a source: of those left out, the one whose size is nearest to what is short.
    left_out = same(rows, plan, "inner").where("size > 0").where(~_in_cut())
    off = F.abs(F.col("size") - F.col("short"))
    best = left_out.where(off < F.col("short")).groupBy("source").agg(F.min(F.struct(off.alias("off"), F.col("key"))).alias("x")).select("source", F.col("x.key").alias("key"))
    single = same(rows.select("source", "key"), best, "inner", "key")
    extra = single.groupBy("source").agg(F.count("*").alias("n"), F.first("key").alias("extra_key")).where("n = 1").drop("n")
    return materialise(same(plan.select("source", "source_size", "target", "epochs", "rest", "cut_step", "cut_key"), extra, "left"), "plan")


def _in_cut() -> Column:
    below = (F.col("step") < F.col("cut_step")) | ((F.col("step") == F.col("cut_step")) & (F.col("key") <= F.col("cut_key")))
    return F.coalesce(below, F.lit(False))


def _passes() -> Column:
    """How often the mix takes a row: its complete epochs, and once more within the cut."""
    return F.col("epochs") + (_in_cut() | F.coalesce(F.col("key") == F.col("extra_key"), F.lit(False))).cast("int")


def _keyed(docs: DataFrame, weight: Column | None) -> DataFrame:
    w = quality_weight() if weight is None else weight
    return docs.select("doc_id", "source", n_words().alias("size"), sampling_key(w).alias("key"))


def _planned(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    plan = plan.withColumnRenamed("source", "_source")
    return keyed.withColumn("step", _step(F.col("key"))).join(plan, F.col("source").eqNullSafe(F.col("_source")), "inner")


def mix_sources(docs: DataFrame, weight: Column | None = None, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken), one for each row of docs (doc_id, text, source).

    Every document gets an exponential key scaled by its quality weight (a column
    expression over docs; by default from the text). A source's target is met by
    complete epochs first, then by the documents of smallest keys that fit, then by
    the one left-out document that completes it best. ``taken`` counts words,
    repeats included, and is size times the passes.

    Null and empty texts have size 0 and take nothing. Null is a source of its own,
    after all others. Rows with the same id and text have the same key and are in or
    out together; a null id counts as an empty one. Other columns are ignored, and
    an empty table gives no rows.
    """
    keyed = materialise(_keyed(docs, weight), "keyed")
    plan = plan_mix(keyed.select("source", "size", "key"), weights, share, cap)
    return _planned(keyed, plan).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * _passes()).alias("taken"))


def sample_mix(docs: DataFrame, weight: Column | None = None, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The mix itself: rows of docs as often as the mix takes them, columns as in docs.

    A row is taken by its source's cut alone, so texts aren't joined by id.
    """
    plan = plan_mix(materialise(_keyed(docs, weight).select("source", "size", "key"), "keyed"), weights, share, cap)
    w = quality_weight() if weight is None else weight
    keep = F.struct(*[F.col(c) for c in docs.columns])
    keyed = docs.select(keep.alias("kept"), "source", sampling_key(w).alias("key"))
    passes = _planned(keyed, plan).select("kept", F.explode(F.array_repeat(F.lit(0), _passes())).alias("_"))
    return passes.select("kept.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS LONG)::DOUBLE + 0.5) / 4503599627370496.0)
      / CASE WHEN length(text) > 0 THEN 0.25 + 1.75 * (length(regexp_replace(text, '[#*$%&|<>]', '', 'g'))::DOUBLE / length(text)) ELSE 1.0 END AS key
  FROM documents),
s AS (SELECT source, sum(size)::LONG AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, CASE WHEN most <= level * weight THEN most ELSE min(CASE WHEN most > level * weight THEN level END) OVER () * weight END AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::LONG AS epochs FROM t),
r AS (SELECT d.*, source_size, target, epochs, target - epochs * source_size AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::LONG AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
p AS (SELECT *, rest - coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY source), 0) AS short FROM r),
e AS (SELECT source, min({'off': abs(size - short), 'key': key}) AS x FROM p WHERE upto > rest AND size > 0 AND abs(size - short) < short GROUP BY source),
f AS (SELECT p.*, CASE WHEN e.x.key = p.key AND count(*) OVER (PARTITION BY p.source, p.key) = 1 THEN 1 ELSE 0 END AS extra FROM p LEFT JOIN e ON p.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size::LONG AS size, source_size, target, (size * (epochs + CASE WHEN upto <= rest THEN 1 ELSE extra END))::LONG AS taken FROM f
"""

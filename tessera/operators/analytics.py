"""Reports over the query log, the access log and the catalogue of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States of a document.
STATES = ("ready", "failed", "pending", "processing")


def share(part, whole):
    """Percentage to 2 places, 0 for none."""
    return F.when(whole > 0, F.round(part / whole * 100, 2)).otherwise(0.0)


def mean(column: str, places: int):
    """Mean to some places, halves up; the sum's own error is rounded away first."""
    return F.round(F.round(F.avg(column), 6), places)


def catalogue_counts(docs: DataFrame, *by: str) -> DataFrame:
    """Documents, chunks, tokens, bytes and documents of each state, for each group or overall."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("chunk_count", "chunks"), ("token_count", "tokens"), ("file_size", "bytes"))]
    return docs.groupBy(*by).agg(F.count("*").alias("docs"), *sums, *(F.count_if(F.col("status") == s).alias(s) for s in STATES))


def usage(docs: DataFrame, log: DataFrame, by: str, log_by: str, price: float) -> DataFrame:
    """Storage, queries and cost of each group; groups without queries have 0."""
    queries = log.groupBy(F.col(log_by).alias(by)).agg(F.count("*").alias("queries"), mean("latency_ms", 2).alias("avg_latency"))
    cost = F.round(F.col("tokens") / 1e6 * price, 4).alias("cost")
    joined = catalogue_counts(docs, by).select(by, "docs", "bytes", "tokens", cost).join(queries, by, "left")
    return joined.fillna(0, ["queries", "avg_latency"])


def since(log: DataFrame, as_of: str, days: int) -> DataFrame:
    """Rows later than that many days before the moment."""
    return log.where(F.col("created_at") > F.expr(f"{as_of} - INTERVAL '{days}' DAY"))


def timeline(log: DataFrame, unit: str) -> DataFrame:
    """Events, failures and mean latency of each hour or day that has any."""
    at = F.date_format(F.date_trunc(unit, "created_at"), "yyyy-MM-dd HH:mm").alias("at")
    return log.groupBy(at).agg(F.count("*").alias("events"), F.count_if(~F.col("success")).alias("errors"), mean("latency_ms", 2).alias("avg_latency"))


def period_stats(log: DataFrame, as_of: str, days: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Count and means of several trailing periods in one pass: a row of each period."""
    start = {d: F.col("created_at") > F.expr(f"{as_of} - INTERVAL '{d}' DAY") for d in days}
    periods = F.array(*(F.when(start[d], F.lit(d).cast("long")) for d in days))
    # A log row counts for each period that it lies in.
    each = log.select(F.explode(F.array_compact(periods)).alias("days"), "latency_ms", "avg_score", "result_count")
    return each.groupBy("days").agg(
        F.count("*").alias("queries"),
        F.coalesce(mean("latency_ms", 2), F.lit(0.0)).alias("avg_latency"),
        F.coalesce(mean("avg_score", 4), F.lit(0.0)).alias("avg_score"),
        F.coalesce(mean("result_count", 1), F.lit(0.0)).alias("avg_results"),
    )


def top_values(log: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values of a column; ties go to the smaller value."""
    return log.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("name")).agg(F.count("*").alias("events"), mean("latency_ms", 2).alias("avg_latency")).orderBy(F.desc("events"), "name").limit(n)


def exact_quantile(df: DataFrame, column: str, p: float, small: int = 100_000) -> float | None:
    """Exact quantile with linear interpolation, in bounded memory; None without values.

    Sketches narrow the range around the wanted rank until few values are left
    in it, or only one value; only those are sorted.
    """
    col = F.col(column).cast("double")
    values = df.select(col.alias("v")).where(F.col("v").isNotNull())
    n = values.count()
    if n == 0:
        return None
    rank = p * (n - 1)
    k = int(rank)
    below, inside = 0, n
    while inside > small:
        p_low, p_high = (max(0.0, (k - below) / inside - 3e-4), min(1.0, (k + 1 - below) / inside + 3e-4))
        low, high = values.agg(F.percentile_approx("v", [p_low, p_high], 10_000)).first()[0]
        cut = values.where(F.col("v").between(low, high))
        lower, left = values.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
        if low == high and below + lower <= k and k + 1 < below + lower + left:
            return low
        if left == inside or not below + lower <= k or below + lower + left < min(k + 2, n):
            break
        values, below, inside = cut, below + lower, left
    # Only the few values left are sorted, and read until the wanted ranks are found.
    counts = values.groupBy("v").count().orderBy("v").limit(max(k + 2 - below, 1))
    at, found = below, []
    for v, c in counts.toLocalIterator():
        at += c
        while len(found) < 2 and at > k + len(found):
            found.append(v)
        if len(found) == 2:
            break
    return found[0] + (found[-1] - found[0]) * (rank - k)


def access_summary(log: DataFrame) -> DataFrame:
    """One row: events, outcomes, rates, latency with its 95th percentile, actors and queries."""
    p95 = exact_quantile(log, "latency_ms", 0.95)
    n, ok = F.count("*"), F.count_if("success")
    return log.agg(
        n.alias("events"),
        ok.alias("successes"),
        (n - ok).alias("errors"),
        share(ok, n).alias("success_rate"),
        mean("latency_ms", 2).alias("avg_latency"),
        F.round(F.lit(p95).cast("double"), 4).alias("p95_latency"),
        F.countDistinct("actor_id").alias("actors"),
        F.count_if(F.col("action").like("query.%")).alias("queries"),
    )

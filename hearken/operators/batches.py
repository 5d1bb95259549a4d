"""Batches of a search path, their health, and the rules that stop a path.

Windows run over batch rows, which are far fewer than records; the numbering sorts keys over ranges (:mod:`.numbering`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered


def assign_batches(records: DataFrame, path: list[str], order: list[str], size: int = 20) -> DataFrame:
    """Add ``batch_index``, from 1: records of a path in order of arrival, ``size`` to a batch. A path may have any number of records."""
    n = numbered(records, path, order, "_place")
    return n.withColumn("batch_index", (F.floor((F.col("_place") - 1) / size) + 1).cast("int")).drop("_place")


def _ratio(n: Column, total: Column) -> Column:
    return n / F.greatest(F.lit(1), total)


def batch_health_v1(scored: DataFrame, key: list[str], continue_ratio=0.25, weak_ratio=0.10, weak_uncertain=0.20, strong=3) -> DataFrame:
    """Counts and decision of each batch by relevance ``status`` and ``score``: ``continue`` or ``weak``."""
    n = scored.groupBy(*key).agg(
        F.count(F.lit(1)).alias("batch_size"),
        F.count_if(F.col("status") == "ACCEPTED").alias("accepted_count"),
        F.count_if(F.col("status") == "UNCERTAIN").alias("uncertain_count"),
        F.count_if(F.col("status") == "REJECTED").alias("rejected_count"),
        F.count_if((F.col("status") == "ACCEPTED") & (F.col("score") >= 0.7)).alias("strong_accept_count"),
    )
    a, u = _ratio(F.col("accepted_count"), F.col("batch_size")), _ratio(F.col("uncertain_count"), F.col("batch_size"))
    good = (a >= continue_ratio) | (F.col("strong_accept_count") >= strong)
    weak = (a < weak_ratio) & (u < weak_uncertain)
    return n.withColumns(
        {"accepted_ratio": F.round(a, 4), "uncertain_ratio": F.round(u, 4), "decision": F.when(weak & ~good, "weak").otherwise("continue")}
    )


def batch_health_v2(judged: DataFrame, key: list[str], high_conf=0.75, min_accept=0.15, min_high=0.05, floor=0.25) -> DataFrame:
    """Counts and decision of each batch by ``decision, relevance_score, confidence_score``: continue, reformulate or weak.

    Ratios are rounded for output only; the decision takes them exact.
    """
    rel, conf, acc = F.col("relevance_score"), F.col("confidence_score"), F.col("decision") == "ACCEPTED"
    n = judged.groupBy(*key).agg(
        F.count(F.lit(1)).alias("batch_size"),
        F.count_if(acc).alias("accepted_count"),
        F.count_if(F.col("decision") == "UNCERTAIN").alias("uncertain_count"),
        F.count_if(F.col("decision") == "REJECTED").alias("rejected_count"),
        F.count_if(acc & (conf >= high_conf) & (rel >= conf * 0.6)).alias("high_conf_accept_count"),
        F.coalesce(F.avg(conf), F.lit(0.0)).alias("mean_confidence"),
    )
    a, h, u = (_ratio(F.col(c), F.col("batch_size")) for c in ("accepted_count", "high_conf_accept_count", "uncertain_count"))
    decision = F.when((a >= min_accept) | (h >= min_high), "continue").when(u >= floor, "reformulate").otherwise("weak")
    return n.withColumns(
        {
            "accepted_ratio": F.round(a, 4),
            "uncertain_ratio": F.round(u, 4),
            "high_conf_accept_ratio": F.round(h, 4),
            "mean_confidence": F.round("mean_confidence", 4),
            "decision": decision,
        }
    )


def apply_stop_rules(health: DataFrame, path: list[str], max_weak=2, max_zero=2, max_scanned=60, min_accepted=3) -> DataFrame:
    """Batches that were processed, with ``batch_decision`` and ``stop_reason``; batches after the first stop are gone.

    Of several rules that fit, the later one counts: reformulate, weak batches in a row, batches without any accepted in
    a row, too few accepted after enough records.
    """
    w = Window.partitionBy(*path).orderBy("batch_index")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)

    def in_a_row(hit: Column) -> Column:
        """Length of the run of hits that ends here."""
        broken = F.max(F.when(~hit, F.col("batch_index"))).over(so_far)
        first = F.min("batch_index").over(Window.partitionBy(*path))
        return F.when(hit, F.col("batch_index") - F.coalesce(broken, first - 1)).otherwise(0)

    b = health.withColumns(
        {
            "total_accepted": F.sum("accepted_count").over(so_far),
            "total_scanned": F.sum("batch_size").over(so_far),
            "weak_in_a_row": in_a_row(F.col("decision") == "weak"),
            "zero_in_a_row": in_a_row(F.col("accepted_count") == 0),
        }
    )
    none_yet = F.col("total_accepted") == 0
    reason = (
        F.when((F.col("total_scanned") >= max_scanned) & (F.col("total_accepted") < min_accepted), "min_accepts_not_reached")
        .when(none_yet & (F.col("zero_in_a_row") >= max_zero), "zero_accepted_batches_exceeded")
        .when(F.col("weak_in_a_row") >= max_weak, "weak_batches_exceeded")
    )
    again = (F.col("decision") == "reformulate") & none_yet
    b = b.withColumns(
        {
            "batch_decision": F.when(reason.isNotNull(), "stop").when(again, "reformulate").otherwise("continue"),
            "stop_reason": reason,
        }
    )
    last = F.min(F.when(F.col("batch_decision") != "continue", F.col("batch_index"))).over(Window.partitionBy(*path))
    return b.withColumn("_last", last).filter(F.col("_last").isNull() | (F.col("batch_index") <= F.col("_last"))).drop("_last")


def path_summaries(batches: DataFrame, path: list[str]) -> DataFrame:
    """One row a path from its processed batches: totals, last decision, and the reason that its caller sees.

    A reason of a path that went on (``reformulate``) reads ``uncertain_reformulation_triggered``.
    """
    last = F.max_by(F.struct("batch_decision", "stop_reason"), "batch_index")
    out = batches.groupBy(*path).agg(
        F.sum("batch_size").alias("collected_count"), F.sum("accepted_count").alias("accepted_count"), F.max("batch_index").alias("batches"), last.alias("_l")
    )
    ended = F.col("_l.batch_decision").isin("stop", "reformulate")
    return out.withColumns(
        {
            "last_decision": F.col("_l.batch_decision"),
            "stop_reason": F.when(F.col("_l.batch_decision") == "reformulate", "uncertain_reformulation_triggered").otherwise(F.col("_l.stop_reason")),
            "should_reformulate": (F.col("accepted_count") == 0) & ended,
        }
    ).drop("_l")


def cut_query_attempts(attempts: DataFrame, step: list[str], budget: int = 10) -> DataFrame:
    """Attempts of a step that ran: later queries only while nothing is accepted, the last path asked for a rewrite and the
    budget of records isn't spent. ``attempts``: ``step…, ordinal, query, collected_count, accepted_count, should_reformulate``."""
    w = Window.partitionBy(*step).orderBy("ordinal")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("query").over(w.rowsBetween(Window.unboundedPreceding, 0))
    a = attempts.withColumns(
        {
            "_ended": F.coalesce(F.max(((F.col("accepted_count") > 0) | ~F.col("should_reformulate")).cast("int")).over(before), F.lit(0)),
            "_spent": F.coalesce(F.sum("collected_count").over(before), F.lit(0)),
            "used_reformulation": F.col("query") != first,
        }
    )
    return a.filter((F.col("_ended") == 0) & (F.col("_spent") < budget)).drop("_ended", "_spent")


def queue_rewrites(attempts: DataFrame, step: list[str]) -> DataFrame:
    """Queries of a step in the order in which they join its queue: first those planned, then rewrites, once per light key.

    ``attempts``: ``step…, ordinal, query, reformulated_queries``.
    """
    from ..functions.text import normalize_light

    planned = attempts.select(*step, F.lit(0).alias("round"), F.col("ordinal").alias("at"), F.lit(0).alias("pos"), "query")
    made = attempts.select(*step, F.lit(1).alias("round"), F.col("ordinal").alias("at"), F.posexplode("reformulated_queries").alias("pos", "query"))
    w = Window.partitionBy(*step, "key").orderBy("round", "at", "pos")
    q = planned.unionByName(made).withColumn("key", normalize_light("query")).withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    order = F.row_number().over(Window.partitionBy(*step).orderBy("round", "at", "pos"))
    return q.withColumn("ordinal", order).select(*step, "ordinal", "query", (F.col("round") == 1).alias("rewritten"))

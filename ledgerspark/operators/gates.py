"""Mechanical gates over the claims selected for each question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..vocab import HARD, LANES, QUESTIONS


def questions(spark) -> DataFrame:
    """question_id, lane, gate, on_unknown: the battery, a dimension of eleven rows."""
    return spark.createDataFrame([(q, *v) for q, v in QUESTIONS.items()], "question_id string, lane string, gate string, on_unknown string")


def hard_gates(selected: DataFrame, entities: DataFrame) -> DataFrame:
    """GATE-01: every entity against every HARD question."""
    hard = F.broadcast(questions(selected.sparkSession).filter("gate = 'HARD'").select("question_id", "on_unknown"))
    grid = entities.select("entity_id").crossJoin(hard)  # six rows an entity
    rows = grid.join(selected.select("entity_id", "question_id", "status"), ["entity_id", "question_id"], "left")
    check = F.when(F.col("status") == "contradicted", "contradicted").when(F.col("status").isNull() | (F.col("status") == "could_not_verify"), "unanswered").otherwise("confirmed")
    rows = rows.withColumn("check", check)
    open_ = F.col("check") == "unanswered"
    reason = F.when((F.col("check") == "contradicted") | (open_ & (F.col("on_unknown") == "reject")), F.concat_ws(":", "question_id", "check"))
    label = F.when(open_ & (F.col("on_unknown") == "deprioritize"), F.concat("question_id", F.lit(": unanswered, deprioritized per policy"))).when(
        open_ & (F.col("on_unknown") == "ship_with_label"), F.concat("question_id", F.lit(": unanswered, shipped with label per policy"))
    )
    joined = lambda c, sep: F.array_join(F.array_sort(F.collect_list(c)), sep)
    out = rows.groupBy("entity_id").agg(
        joined(reason, ";").alias("reasons"), F.bool_or(open_ & (F.col("on_unknown") == "deprioritize")).alias("force_low"), joined(label, "|").alias("labels"), joined(F.concat_ws("=", "question_id", "check"), ",").alias("checks")
    )
    return out.select("entity_id", (F.col("reasons") != "").alias("reject"), F.nullif("reasons", F.lit("")).alias("reason_code"), "force_low", "labels", "checks")


def dead_ends(selected: DataFrame) -> DataFrame:
    """GATE-02: questions tried and not resolved."""
    text = F.concat(F.col("question_id"), F.lit(": "), F.coalesce("answer", F.lit("None")))
    return selected.filter("status = 'could_not_verify'").groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list(text)), "|").alias("dead_ends"))


def thin_reason(selected: DataFrame) -> DataFrame:
    """GATE-03: structural if nobody, no channel and no deployment is known."""
    known = lambda q: F.coalesce(F.bool_or((F.col("question_id") == q) & (F.col("status") != "could_not_verify")), F.lit(False))
    none = ~(known("G2.Q1") | known("G2.Q2") | known("G3.Q1"))
    return selected.groupBy("entity_id").agg(F.when(none, "structural").otherwise("fixable").alias("thin_reason"))


def retry_not_reject(gates: DataFrame, timed_out: DataFrame, claims: DataFrame) -> DataFrame:
    """GATE-04: a rejection becomes a retry if a lane timed out, there is no claim and every reason is an unanswered question."""
    marked = gates.join(timed_out.select("entity_id").distinct().withColumn("late", F.lit(True)), "entity_id", "left").join(claims.select("entity_id").distinct().withColumn("has", F.lit(True)), "entity_id", "left")
    open_ = F.forall(F.split(F.coalesce("reason_code", F.lit("x")), ";"), lambda r: r.endswith(":unanswered"))
    retry = F.col("reject") & F.coalesce("late", F.lit(False)) & F.col("has").isNull() & open_
    return marked.select("entity_id", F.when(retry, "retry").when(F.col("reject"), "reject").otherwise("pass").alias("decision"))


def cap_verdict(judged: DataFrame, gates: DataFrame) -> DataFrame:
    """GATE-05: force_low caps the judged verdict."""
    return judged.join(gates.select("entity_id", "reject", "force_low"), "entity_id").select("entity_id", F.when(F.col("reject"), "reject").when(F.col("force_low"), "pursue_low").otherwise(F.col("judged")).alias("verdict"))


def lane_summary(selected: DataFrame) -> DataFrame:
    """GATE-06: per entity and lane: answered, questions, HARD questions without answer, and whether the lane ever ran."""
    spark = selected.sparkSession
    grid = selected.select("entity_id").distinct().crossJoin(F.broadcast(questions(spark)))
    rows = grid.join(selected.select("entity_id", "question_id", "status"), ["entity_id", "question_id"], "left")
    answered = F.coalesce(F.col("status") != "could_not_verify", F.lit(False))
    missing = F.when(~answered & (F.col("gate") == "HARD"), F.col("question_id"))
    return rows.groupBy("entity_id", "lane").agg(F.count_if(answered).alias("answered"), F.count(F.lit(1)).alias("total"), F.array_join(F.array_sort(F.collect_list(missing)), ",").alias("hard_unanswered"), F.coalesce(F.bool_or(F.col("status").isNotNull()), F.lit(False)).alias("ran"))


def verdict_distribution(decisions: DataFrame, verdict: str) -> DataFrame:
    """GATE-07: latest verdict per entity, counted."""
    own = Window.partitionBy("entity_id").orderBy(F.desc("seq"))
    return decisions.withColumn("n", F.row_number().over(own)).filter("n = 1").groupBy(F.col(verdict).alias("verdict")).agg(F.count(F.lit(1)).alias("entities"))


TRACE = "array<struct<phase:string,event:string,lane:string,cost:double>>"


def explode_trace(traces: DataFrame) -> DataFrame:
    """GATE-08: event rows out of the JSON list of each entity."""
    return traces.select("entity_id", F.posexplode(F.from_json("trace", TRACE)).alias("place", "e")).select("entity_id", "place", "e.*")


def trace_tally(traces: DataFrame) -> DataFrame:
    return explode_trace(traces).groupBy("phase", "event", "lane").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("entity_id").alias("entities"))


__all__ = ["HARD", "LANES", "cap_verdict", "dead_ends", "explode_trace", "hard_gates", "lane_summary", "questions", "retry_not_reject", "thin_reason", "trace_tally", "verdict_distribution"]

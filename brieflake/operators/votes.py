"""Votes: tallies, changes between rounds, the deliberation round and its router."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brieflake.functions import patterns as P
from brieflake.sources.scratch import written

CASE = ["docket", "llm_model", "replicate"]


def tally(votes: DataFrame, by: list[str]) -> DataFrame:
    """Majority per group: any vote but Petitioner counts for the Respondent, who also wins a tie."""
    counts = votes.groupBy(*by).agg(F.count_if(F.col("vote") == "Petitioner").alias("petitioner_votes"), F.count("*").alias("n"), F.avg("confidence").alias("average_confidence"))
    pet, res = F.col("petitioner_votes"), F.col("n") - F.col("petitioner_votes")
    return counts.select(
        *by, "petitioner_votes", res.alias("respondent_votes"), F.when(pet > res, "Petitioner").otherwise("Respondent").alias("predicted_winner"),
        F.concat_ws("-", F.greatest(pet, res), F.least(pet, res)).alias("vote_split"), "average_confidence",
    )


def vote_changes(rounds: DataFrame, by: list[str]) -> DataFrame:
    """Votes that differ from the same voter's round before, in total per group."""
    w = Window.partitionBy(*by, "justice").orderBy("round")
    marked = rounds.withColumn("before", F.lag("vote").over(w))
    return marked.groupBy(*by).agg(F.count_if(F.col("before") != F.col("vote")).alias("total_vote_changes"), F.max("round").alias("rounds"))


def first_and_last(rounds: DataFrame, by: list[str]) -> DataFrame:
    return rounds.groupBy(*by, "justice").agg(F.min_by("vote", "round").alias("initial_vote"), F.max_by("vote", "round").alias("final_vote"))


def cap_flips(changes: DataFrame, by: list[str], most: int = P.MAX_FLIPS) -> DataFrame:
    """changes (.., justice, position, new_confidence): marks the accepted ones, highest confidence first, ties by position."""
    w = Window.partitionBy(*by).orderBy(F.desc("new_confidence"), "position")
    return changes.withColumn("flip_rank", F.row_number().over(w)).withColumn("accepted", F.col("flip_rank") <= most)


def decay(confidence: Column) -> Column:
    return F.greatest(F.lit(P.FLIP_FLOOR), confidence - P.FLIP_PENALTY)


def monitor_penalty(confidence: Column) -> Column:
    return F.greatest(F.lit(P.MONITOR_FLOOR), confidence - P.FLIP_PENALTY)


def locks(confidence: Column, is_final: Column, round_no: Column) -> Column:
    return is_final | ((round_no >= 2) & (confidence >= P.LOCK_AT))


def default_vote(lean: Column, failed: Column) -> Column:
    """The vote of a voter whose answer can't be read (0.3) or failed (0.2), by leaning."""
    return F.struct(F.when(lean > 0.5, "Petitioner").otherwise("Respondent").alias("vote"), F.when(failed, 0.2).otherwise(0.3).alias("confidence"))


def deliberate(votes: DataFrame, proposals: DataFrame, by: list[str] = CASE) -> DataFrame:
    """One round. votes (by, justice, position, round, vote, confidence, is_final), proposals (by, justice, vote, confidence).

    A final vote stays; from round 2 on a confident one becomes final. No proposal: the vote stays and is final. An unchanged
    vote passes with its new confidence; a changed one loses FLIP_PENALTY, and only the MAX_FLIPS most confident
    changes of a case are accepted; a refused one keeps the old vote.
    """
    keys = [*by, "justice"]
    p = proposals.select(*keys, F.col("vote").alias("p_vote"), F.col("confidence").alias("p_conf"))
    j = votes.join(p, keys, "left").withColumn("locked", locks(F.col("confidence"), F.col("is_final"), F.col("round")))
    j = j.withColumn("changed", ~F.col("locked") & F.col("p_vote").isNotNull() & (F.col("p_vote") != F.col("vote")))
    j = j.withColumn("new_conf", F.when(F.col("changed"), decay(F.col("p_conf"))).otherwise(F.col("p_conf")))
    # the changed ones first; by the case alone, as all that is asked of a case then takes one shuffle
    w = Window.partitionBy(*by).orderBy(F.desc("changed"), F.desc("new_conf"), "position")
    j = j.withColumn("accepted", F.col("changed") & (F.row_number().over(w) <= P.MAX_FLIPS))
    takes = ~F.col("locked") & F.col("p_vote").isNotNull() & (~F.col("changed") | F.col("accepted"))
    return j.select(
        *keys, "position", (F.col("round") + 1).alias("round"), F.when(takes, F.col("p_vote")).otherwise(F.col("vote")).alias("vote"),
        F.when(takes, F.col("new_conf")).otherwise(F.col("confidence")).alias("confidence"), (F.col("locked") | F.col("p_vote").isNull()).alias("is_final"),
        (F.col("accepted")).alias("flipped"),
    )


def goes_on(round_no: Column, margin: Column, changes: Column) -> Column:
    """The router, after round_no was raised: at most MAX_ROUNDS, at least 2; then close cases and those still changing."""
    return F.when(round_no > P.MAX_ROUNDS, False).when(round_no <= 2, True).when(margin <= 3, True).when(changes == 0, False).otherwise(True)


def run_rounds(initial: DataFrame, propose, by: list[str] = CASE) -> DataFrame:
    """All rounds, round 1 included: propose(votes) gives each round's proposals. All cases step together; a case that the
    router stops takes no further round. Each round is written to the shared folder (at most MAX_ROUNDS of them), each row with what
    the router says of its case, so that the next round reads it from there."""
    case = Window.partitionBy(*by)
    margin = F.abs(2 * F.count_if(F.col("vote") == "Petitioner").over(case) - F.count("*").over(case))
    going = goes_on(F.max("round").over(case), margin, F.count_if("flipped").over(case))
    now = written(initial.withColumn("flipped", F.lit(False)), "rounds")
    out, active = now, now
    for _ in range(P.MAX_ROUNDS):
        now = written(deliberate(active, propose(active), by).withColumn("__going", going), "rounds")
        out = out.unionByName(now.drop("__going"))
        active = now.filter("__going").dropna(subset=by).drop("__going")
        if active.isEmpty():
            break
    return out


def colleagues(votes: DataFrame, by: list[str]) -> DataFrame:
    """Per voter the other voters' votes of the same round, as one text in order of name."""
    a = votes.select(*by, "justice")
    b = votes.select(*by, F.col("justice").alias("other"), "vote", "confidence")
    seen = a.join(b, by).filter("justice <> other")
    line = F.concat(F.col("other"), F.lit(": "), F.col("vote"), F.lit(" ("), F.format_number("confidence", 2), F.lit(")"))
    return seen.groupBy(*by, "justice").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("other", line.alias("l")))), lambda x: x["l"]), "; ").alias("colleagues"))

"""Predictions against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brieflake.functions import text as X
from brieflake.operators.ordered import running_sums
from brieflake.operators.retrieval import small


def ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, 0.0).otherwise(num / den)


def normalize_truth(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (docket, term, case_name, winning_party, justice, vote_description, actual_vote, seq) -> (cases, votes).

    The first row of a docket gives its case; the last row of (docket, justice) that has a vote gives that vote.
    An explicit vote overrides the derived one. Winner per row, votes by the case's winner.
    """
    case = rows.groupBy("docket").agg(
        F.min_by(F.struct(F.coalesce(F.col("case_name"), F.lit("")).alias("case_name"), X.winner_of(F.col("winning_party")).alias("winner"), F.coalesce(F.col("term"), F.lit(0)).alias("term")), "seq").alias("c")
    ).select("docket", "c.*")
    voted = rows.join(case.select("docket", "winner"), "docket")
    vote = F.coalesce(F.nullif(F.trim("actual_vote"), F.lit("")), X.vote_of(F.col("vote_description"), F.col("winner")))
    voted = voted.withColumn("vote", vote).filter("vote is not null")
    return case, voted.groupBy("docket", "justice").agg(F.max_by("vote", "seq").alias("vote"))


def truth_by_vote(rows: DataFrame) -> DataFrame:
    """docket, term, case_name, winner, justice, vote: what `normalize_truth` gives, votes with their case, by one shuffle of the rows."""
    first = lambda c: F.first(c).over(Window.partitionBy("docket").orderBy("seq"))
    cased = rows.filter("docket is not null").select(
        "docket", "justice", "vote_description", "actual_vote", "seq", first(F.coalesce(F.col("term"), F.lit(0))).alias("term"), first(F.coalesce(F.col("case_name"), F.lit(""))).alias("case_name"), first(X.winner_of(F.col("winning_party"))).alias("winner"),
    )
    vote = F.coalesce(F.nullif(F.trim("actual_vote"), F.lit("")), X.vote_of(F.col("vote_description"), F.col("winner")))
    voted = cased.withColumn("vote", vote).filter("vote is not null")
    last = F.row_number().over(Window.partitionBy("docket", "justice").orderBy(F.desc("seq")))
    return voted.withColumn("__n", last).filter("__n = 1").select("docket", "term", "case_name", "winner", "justice", "vote")


def docket_terms(rows: DataFrame) -> DataFrame:
    """docket -> term, the last row wins."""
    return rows.groupBy("docket").agg(F.max_by("term", "seq").alias("term"))


def matched_cases(pred: DataFrame, truth: DataFrame) -> DataFrame:
    return pred.join(truth.select("docket", "winner"), "docket").withColumn("case_correct", F.col("predicted_winner") == F.col("winner"))


def matched_votes(pred_votes: DataFrame, truth_votes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Votes that both sides have; names (justice, short) maps predicted names to those of the truth."""
    p = pred_votes
    if names is not None:
        p = p.join(small(names), "justice").drop("justice").withColumnRenamed("short", "justice")
    t = truth_votes.select("docket", "justice", F.col("vote").alias("true_vote"))
    return p.join(t, ["docket", "justice"]).withColumn("vote_correct", F.col("vote") == F.col("true_vote"))


def model_report(cases: DataFrame, votes: DataFrame, all_votes: DataFrame, require_match: bool = False) -> DataFrame:
    """Per model: case and voter accuracy, perfect cases. A case with votes but none matched is perfect, unless require_match."""
    keys = ["docket", "llm_model", "replicate"]
    per_case = all_votes.groupBy(*keys).count().select(*keys).join(votes.groupBy(*keys).agg(F.bool_and("vote_correct").alias("all_right")), keys, "left")
    per_case = per_case.withColumn("perfect", F.coalesce("all_right", F.lit(not require_match)))
    c = cases.join(per_case.select(*keys, "perfect"), keys, "left").groupBy("llm_model").agg(F.count("*").alias("cases"), F.count_if("case_correct").alias("cases_correct"), F.count_if("perfect").alias("perfect_cases"))
    v = votes.groupBy("llm_model").agg(F.count("*").alias("votes"), F.count_if("vote_correct").alias("votes_correct"))
    j = c.join(v, "llm_model", "left").na.fill(0, ["votes", "votes_correct"])
    return j.select("llm_model", "cases", "cases_correct", ratio(F.col("cases_correct"), F.col("cases")).alias("case_accuracy"), "votes", "votes_correct", ratio(F.col("votes_correct"), F.col("votes")).alias("vote_accuracy"), "perfect_cases")


def justice_report(votes: DataFrame, drop_zero_correct: bool = True) -> DataFrame:
    """Per voter over all models. drop_zero_correct: a (model, voter) without a correct vote doesn't count at all."""
    per = votes.groupBy("llm_model", "justice").agg(F.count("*").alias("n"), F.count_if("vote_correct").alias("k"))
    per = per.filter("k > 0") if drop_zero_correct else per
    return per.groupBy("justice").agg(F.sum("k").alias("correct"), F.sum("n").alias("total")).withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def justice_by_model(votes: DataFrame) -> DataFrame:
    return votes.groupBy("llm_model", "justice").agg(F.count_if("vote_correct").alias("correct"), F.count("*").alias("total")).withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def mode_report(cases: DataFrame) -> DataFrame:
    """Accuracy per mode; no rows unless there is more than one mode."""
    modes = cases.agg(F.count_distinct("mode").alias("modes"))
    per = cases.groupBy("mode").agg(F.count("*").alias("cases"), F.count_if("case_correct").alias("correct"))
    return per.crossJoin(F.broadcast(modes)).filter("modes > 1").select("mode", "cases", "correct", ratio(F.col("correct"), F.col("cases")).alias("accuracy"))


def term_by_model(cases: DataFrame, models: list) -> DataFrame:
    """Accuracy by term, a column for each model, null where there is no case."""
    return cases.groupBy("term").pivot("llm_model", models).agg(F.avg(F.col("case_correct").cast("double")))


def first_folder(preds: DataFrame) -> DataFrame:
    """Each docket once, from the first folder that has it (preds: docket, folder_pos, ..)."""
    w = Window.partitionBy("docket").orderBy("folder_pos")
    return preds.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def folder_terms(preds: DataFrame, terms: DataFrame) -> DataFrame:
    return preds.join(terms, "docket").groupBy("folder", "term").count()


def progress(cases: DataFrame) -> DataFrame:
    """Per docket: replicates done and right, and a running number in order of docket within a term."""
    per = cases.groupBy("term", "docket").agg(F.count("*").alias("replicates"), F.count_if("case_correct").alias("correct"))
    run = running_sums(per.withColumn("one", F.lit(1)), ["term", "docket"], ["one"])
    first = run.groupBy(F.col("term").alias("of_term")).agg(F.min("one_before").alias("first"))  # terms are few, their cases may be many
    joined = run.join(first, F.col("term").eqNullSafe(F.col("of_term")))
    return joined.select("term", "docket", "replicates", "correct", (F.col("one_before") - F.col("first") + 1).cast("int").alias("done"))

"""The 2 x 2 contamination experiment: pairing, accuracy, influence scores, paired tests, funnels, figures' data.

results: docket, llm_model, replicate, condition, seq, case_correct, justice_correct, justice_total, justice_accuracy,
average_confidence, optional spoiler columns. Test statistics are built-in aggregates; p-values of the few report
rows come from functions.stats.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brieflake.functions import stats as S
from brieflake.operators.evaluation import ratio
from brieflake.operators.ordered import running_sums
from brieflake.operators.retrieval import small

KEY = ["docket", "llm_model", "replicate"]


def latest(results: DataFrame) -> DataFrame:
    """One row per key and condition, the last by seq."""
    cols = [c for c in results.columns if c not in (*KEY, "condition", "seq")]
    return results.groupBy(*KEY, "condition").agg(F.max_by(F.struct(*cols), "seq").alias("v")).select(*KEY, "condition", "v.*")


def paired(results: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """key, x (condition a), y (condition b) of keys that have both."""
    once = latest(results).select(*KEY, "condition", value)
    left = once.filter(F.col("condition") == a).select(*KEY, F.col(value).alias("x"))
    return left.join(once.filter(F.col("condition") == b).select(*KEY, F.col(value).alias("y")), KEY)


def condition_accuracy(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per condition: case and vote accuracy (ratio of sums), mean and population deviation of confidence; none: 0."""
    got = results.groupBy(*(by or []), "condition").agg(
        F.count("*").alias("case_total"), F.count_if("case_correct").alias("case_correct"),
        F.sum("justice_correct").alias("justice_correct"), F.sum("justice_total").alias("justice_total"),
        F.coalesce(F.avg("average_confidence"), F.lit(0.0)).alias("mean_confidence"), F.coalesce(F.stddev_pop("average_confidence"), F.lit(0.0)).alias("std_confidence"),
    )
    return got.withColumn("case_accuracy", ratio(F.col("case_correct"), F.col("case_total"))).withColumn("justice_accuracy", ratio(F.col("justice_correct"), F.col("justice_total")))


def influence(a: Column, b: Column) -> Column:
    """Share of the room above the baseline that the spoiler fills."""
    return F.when(a >= 1, 0.0).otherwise((b - a) / (1 - a))


def effectiveness(a: Column, b: Column, d: Column) -> Column:
    """Share of the spoiler's effect that the defence removes."""
    return F.when(F.abs(b - a) < 1e-10, 1.0).otherwise(1 - (d - a) / (b - a))


def scores(results: DataFrame) -> DataFrame:
    """One row: cis, cis with defence, ace."""
    acc = condition_accuracy(results)
    one = acc.agg(*[F.coalesce(F.max(F.when(F.col("condition") == c, F.col("case_accuracy"))), F.lit(0.0)).alias(c) for c in "ABCD"])
    return one.select(influence(F.col("A"), F.col("B")).alias("cis"), influence(F.col("A"), F.col("D")).alias("cis_defended"), effectiveness(F.col("A"), F.col("B"), F.col("D")).alias("ace"))


def influence_by_model(results: DataFrame) -> DataFrame:
    """CIS per model; 0 where A or B is missing."""
    acc = condition_accuracy(results, ["llm_model"]).groupBy("llm_model").pivot("condition", ["A", "B"]).agg(F.first("case_accuracy"))
    return acc.select("llm_model", F.when(F.col("A").isNull() | F.col("B").isNull(), 0.0).otherwise(influence(F.col("A"), F.col("B"))).alias("cis"))


def mcnemar(results: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Fixed columns: pairs, discordant counts, corrected chi-square, odds ratio (null without its denominator): one row, or one for each group of `by`."""
    by = by or []
    p = paired(results, a, b, "case_correct").groupBy(*by).agg(F.count("*").alias("pairs"), F.count_if(F.col("x") & ~F.col("y")).alias("b"), F.count_if(~F.col("x") & F.col("y")).alias("c"))
    n = F.col("b") + F.col("c")
    gap = F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0))
    return p.select(*by, "pairs", "b", "c", F.when(n > 0, gap * gap / n).alias("chi2"), F.when(F.col("c") > 0, F.col("b") / F.col("c")).alias("odds_ratio"), F.when(n == 0, "none").when(n < 25, "exact").otherwise("chi2").alias("test"))


def mcnemar_p(row) -> float:
    n = row["b"] + row["c"]
    return 1.0 if n == 0 else S.binomial_two_sided(row["b"], n) if n < 25 else S.chi2_tail_1df(row["chi2"])


def paired_t(results: DataFrame, a: str, b: str, value: str = "justice_accuracy", t_sign: str = "a_minus_b") -> DataFrame:
    """One row: n, mean difference b - a, its deviation, Cohen's d, t (by default of a against b, opposite in sign)."""
    d = paired(results, a, b, value).select((F.col("y") - F.col("x")).alias("d")).agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("std_diff"))
    sign = -1.0 if t_sign == "a_minus_b" else 1.0
    flat = F.col("std_diff") == 0
    return d.select("n", "mean_diff", "std_diff", F.when(flat, 0.0).otherwise(F.col("mean_diff") / F.col("std_diff")).alias("cohens_d"), F.when(flat, 0.0).otherwise(sign * F.col("mean_diff") / (F.col("std_diff") / F.sqrt("n"))).alias("t"))


def paired_t_p(row) -> float:
    return S.t_two_sided(row["t"], row["n"] - 1) if row["n"] > 1 and row["std_diff"] else 1.0


def signed_ranks(results: DataFrame, a: str, b: str, value: str = "justice_accuracy", by: list[str] | None = None) -> DataFrame:
    """Wilcoxon's rank sums over non-zero differences (average ranks for ties), the tie term and how many differences are
    zero: one row, or one for each group of `by` (of the key's columns) that has a pair.

    Differences are counted per value first; ranks follow from running counts over the distinct values, in groups from
    where the group starts.
    """
    by = by or []
    d = paired(results, a, b, value).select(*by, F.round(F.col("y") - F.col("x"), 12).alias("d"))
    counts = d.groupBy(*by, F.abs("d").alias("size")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("plus")).withColumn("some", F.when(F.col("size") > 0, F.col("t")).otherwise(0))
    run = running_sums(counts, [*by, "size"], ["some"])
    if by:
        run = run.join(run.groupBy(*by).agg(F.min("some_before").alias("start")), by)
    rank = F.col("some_before") - (F.col("start") if by else F.lit(0)) + (F.col("some") + 1) / 2
    ranked = run.withColumn("rank", rank)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    t = F.col("some")
    return ranked.groupBy(*by).agg(
        F.coalesce(F.sum(t), F.lit(0)).alias("n"), zero(F.sum(F.col("rank") * F.col("plus"))).alias("w_plus"), zero(F.sum(F.when(t > 0, F.col("rank") * (t - F.col("plus"))))).alias("w_minus"),
        zero(F.sum((t * t * t - t).cast("double"))).alias("tie_term"), F.coalesce(F.sum(F.col("t") - t), F.lit(0)).alias("zeros"),
    )


def wilcoxon_p(row) -> float:
    return S.wilcoxon_two_sided(row["w_plus"], row["w_minus"], row["n"], row["tie_term"], row["zeros"])


def ks(results: DataFrame, a: str, b: str, value: str = "average_confidence", by: list[str] | None = None) -> DataFrame:
    """Sizes and the largest gap between the two distributions, unpaired: one row, or one for each group of `by`. Counts per value, then running sums."""
    by = by or []
    both = results.filter(F.col("condition").isin(a, b)).groupBy(*by, F.col(value).alias("v")).agg(F.count_if(F.col("condition") == a).alias("x"), F.count_if(F.col("condition") == b).alias("y"))
    run = running_sums(both, [*by, "v"], ["x", "y"])
    starts = run.groupBy(*by).agg(F.sum("x").alias("n"), F.sum("y").alias("m"), F.min("x_before").alias("x0"), F.min("y_before").alias("y0"))
    run = run.join(starts, by) if by else run.crossJoin(F.broadcast(starts))
    gap = F.abs(ratio(F.col("x_before") - F.col("x0") + F.col("x"), F.col("n")) - ratio(F.col("y_before") - F.col("y0") + F.col("y"), F.col("m")))
    return run.groupBy(*by).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.max("m"), F.lit(0)).alias("m"), F.coalesce(F.max(gap), F.lit(0.0)).alias("d"))


def ks_p(row) -> float:
    return S.ks_two_sided(row["d"], row["n"], row["m"])


def with_p(rows: DataFrame, p, columns: list[str], name: str = "p") -> DataFrame:
    """rows with the p-value that p(row) gives for these columns; a row stands for a group, so few are computed."""

    @F.pandas_udf("double")
    def of(*cols: pd.Series) -> pd.Series:
        known: dict[tuple, float] = {}
        out = []
        for values in zip(*cols):
            if values not in known:
                known[values] = float(p(dict(zip(columns, values))))
            out.append(known[values])
        return pd.Series(out, dtype="float64")

    return rows.withColumn(name, of(*columns))


def signed_rank_tests(results: DataFrame, a: str, b: str, by: list[str], value: str = "justice_accuracy") -> DataFrame:
    """signed_ranks() of each group, with its p-value and whether that is exact."""
    got = with_p(signed_ranks(results, a, b, value, by), wilcoxon_p, ["n", "w_plus", "w_minus", "tie_term", "zeros"])
    return got.withColumn("exact", (F.col("n") <= S.WILCOXON_EXACT) & (F.col("tie_term") == 0) & (F.col("zeros") == 0))


def ks_tests(results: DataFrame, a: str, b: str, by: list[str], value: str = "average_confidence") -> DataFrame:
    """ks() of each group that has both conditions, with its p-value."""
    return with_p(ks(results, a, b, value, by).filter("n > 0 AND m > 0"), ks_p, ["n", "m", "d"])


def mcnemar_tests(results: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """mcnemar() of each group, with its p-value."""
    return with_p(mcnemar(results, a, b, by), mcnemar_p, ["b", "c", "chi2"])


def spoiler_rates(results: DataFrame) -> DataFrame:
    """Citation rate per spoiled condition and over all of them (condition `all`)."""
    spoiled = results.filter("inject_spoiler")
    cube = spoiled.rollup("condition").agg(F.count("*").alias("runs"), F.count_if("spoiler_cited_in_reasoning").alias("cited"))
    return cube.select(F.coalesce("condition", F.lit("all")).alias("condition"), "runs", "cited", F.round(ratio(F.col("cited"), F.col("runs")), 3).alias("rate")).filter("runs > 0")


def susceptible(results: DataFrame) -> DataFrame:
    """Voters by how often they cite the spoiler."""
    return results.select(F.explode("spoiler_cited_justices").alias("justice")).groupBy("justice").agg(F.count("*").alias("times")).orderBy(F.desc("times"), "justice")


def justice_by_condition(votes: DataFrame) -> DataFrame:
    """Accuracy of each voter per condition (3 digits); votes have vote_correct."""
    return votes.groupBy("justice").pivot("condition", list("ABCD")).agg(F.round(F.avg(F.col("vote_correct").cast("double")), 3))


def funnel(results: DataFrame, mode: str = "anti") -> DataFrame:
    """Injected, cited, and cited with a right case. `anti` keeps dockets that the baseline never got wrong (as the reports
    have it), `semi` those that it got wrong."""
    b = results.filter(F.col("condition") == "B")
    wrong = results.filter((F.col("condition") == "A") & ~F.col("case_correct")).select("docket").distinct()
    cited = b.filter("spoiler_cited_in_reasoning")
    turned = cited.filter("case_correct").join(wrong, "docket", "left_anti" if mode == "anti" else "left_semi")
    return b.agg(F.count("*").alias("injected"), F.count_if("spoiler_cited_in_reasoning").alias("cited")).crossJoin(turned.agg(F.count("*").alias("turned")))


def run_plan(terms: DataFrame, cases: DataFrame, conditions: DataFrame, models: DataFrame, replicates: int) -> DataFrame:
    """Terms x their cases x conditions x models x replicates; all but cases are short configuration lists."""
    reps = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    grid = conditions.select("condition").crossJoin(models.select("llm_model")).select("*", reps)
    return cases.join(small(terms.select("term").distinct()), "term").select("term", "docket").crossJoin(small(grid))


def run_stamp() -> list[Column]:
    """run_id (12 characters) and timestamp of a result row; not reproducible by purpose."""
    return [F.substring(F.expr("uuid()"), 1, 12).alias("run_id"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")]


def full_report(results: DataFrame) -> DataFrame:
    """(test, pair, metric, value) of the tests whose conditions both occur: A/B all three, A/C and B/D two, A/D one."""
    spark = results.sparkSession
    have = {r.condition for r in results.filter(F.col("condition").isin(*"ABCD")).select("condition").distinct().collect()}
    out: list[tuple[str, str, str, float | None]] = []
    for a, b, kinds in (("A", "B", 3), ("A", "C", 2), ("B", "D", 2), ("A", "D", 1)):
        if not {a, b} <= have:
            continue
        m = mcnemar(results, a, b).first()
        rows = [("mcnemar", {"b": m["b"], "c": m["c"], "p": mcnemar_p(m)})]
        if kinds > 1:
            t, w = paired_t(results, a, b).first(), signed_ranks(results, a, b).first()
            rows += [("paired_t", {"mean_diff": t["mean_diff"], "t": t["t"], "cohens_d": t["cohens_d"], "p": paired_t_p(t)}), ("wilcoxon", {"w": min(w["w_plus"], w["w_minus"]), "p": wilcoxon_p(w)})]
        if kinds > 2:
            k = ks(results, a, b).first()
            rows.append(("ks", {"d": k["d"], "p": ks_p(k)}))
        out += [(test, f"{a}/{b}", metric, None if v is None else float(v)) for test, values in rows for metric, v in values.items()]
    return spark.createDataFrame(out, "test string, pair string, metric string, value double")


def latex_rows(acc: DataFrame) -> DataFrame:
    """One LaTeX table line per condition."""
    pct = lambda c: F.format_string("%.1f\\%%", F.round(F.col(c) * 100, 6))
    return acc.select("condition", F.concat(F.concat_ws(" & ", "condition", pct("case_accuracy"), pct("justice_accuracy"), F.format_string("%.3f", F.round("mean_confidence", 9))), F.lit(" \\\\")).alias("line"))

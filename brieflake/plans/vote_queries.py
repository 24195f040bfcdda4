"""Votes, evaluation, experiment, dataset and profile queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brieflake.functions import patterns as P
from brieflake.functions import text as X
from brieflake.operators import datasets as D
from brieflake.operators import evaluation as E
from brieflake.operators import experiment as M
from brieflake.operators import filters as FL
from brieflake.operators import profiles as PR
from brieflake.operators import votes as VT
from brieflake.plans import surrogates as V
from brieflake.sources import readers as IO
from brieflake.sources.scratch import written

CNT = "CAST(count(*) FILTER ({}) AS BIGINT)"

# ---------------------------------------------------------------- evaluation


def gt_normalize(s, d):
    case, votes = E.normalize_truth(V.truth_rows(s, d))
    return votes.join(case, "docket").select("docket", "term", "case_name", "winner", "justice", "vote")


SQL_GT = f"""WITH {V.SQL_TRUTH_ROWS}, c AS (SELECT docket, arg_min(case_name, seq) AS case_name, arg_min(CASE WHEN contains(winning_party, 'Petitioner') OR contains(winning_party, 'Appellant') THEN 'Petitioner' ELSE 'Respondent' END, seq) AS winner, arg_min(term, seq) AS term FROM truth_rows GROUP BY 1),
v AS (SELECT r.docket, r.justice, r.seq, coalesce(nullif(trim(actual_vote), ''), CASE WHEN contains(lower(vote_description), 'dissent') THEN CASE WHEN winner = 'Petitioner' THEN 'Respondent' ELSE 'Petitioner' END
  WHEN regexp_matches(lower(vote_description), 'majority|plurality|concurrence|judgment') THEN winner END) AS vote FROM truth_rows r JOIN c USING (docket)),
l AS (SELECT docket, justice, arg_max(vote, seq) AS vote FROM v WHERE vote IS NOT NULL GROUP BY 1, 2)
SELECT docket, term, case_name, winner, justice, vote FROM l JOIN c USING (docket)"""


def preds(s, d):
    return VT.tally(V.pred_votes(s, d), V.KEY)


def majority_tally(s, d):
    return preds(s, d).withColumn("average_confidence", F.round("average_confidence", 6))


SQL_PRED = f"WITH {V.SQL_PRED_VOTES}, {V.SQL_TALLY}, {V.SQL_TRUTH_CASES}, {V.SQL_TRUTH_VOTES}, mc AS (SELECT p.*, winner, term, predicted_winner = winner AS case_correct FROM pred p JOIN truth_cases USING (docket)), mv AS (SELECT p.*, t.vote AS true_vote, p.vote = t.vote AS vote_correct FROM pred_votes p JOIN truth_votes t USING (docket, justice))"


def case_rows(s, d):
    t = V.truth_cases(s, d)
    return E.matched_cases(preds(s, d), t).join(t.select("docket", "term"), "docket")


def vote_rows(s, d):
    return E.matched_votes(V.pred_votes(s, d), V.truth_votes(s, d))


def case_accuracy(s, d):
    return case_rows(s, d).groupBy("llm_model").agg(F.count("*").alias("cases"), F.count_if("case_correct").alias("correct"))


def model_report(s, d):
    votes = written(vote_rows(s, d), "votes")
    got = E.model_report(case_rows(s, d), votes, V.pred_votes(s, d))
    return got.withColumn("case_accuracy", F.round("case_accuracy", 6)).withColumn("vote_accuracy", F.round("vote_accuracy", 6))


def perfect_cases(s, d):
    votes = written(vote_rows(s, d), "votes")
    strict = E.model_report(case_rows(s, d), votes, V.pred_votes(s, d), require_match=True).select("llm_model", F.col("perfect_cases").alias("strict"))
    return E.model_report(case_rows(s, d), votes, V.pred_votes(s, d)).select("llm_model", F.col("perfect_cases").alias("vacuous")).join(strict, "llm_model")


SQL_PERFECT = ", pc AS (SELECT p.docket, p.llm_model, p.replicate, bool_and(m.vote_correct) AS ok FROM pred p LEFT JOIN mv m USING (docket, llm_model, replicate) GROUP BY 1, 2, 3)"


def justice_accuracy(s, d):
    return E.justice_report(vote_rows(s, d), False).withColumn("accuracy", F.round("accuracy", 6))


def justice_accuracy_parity(s, d):
    votes = vote_rows(s, d).withColumn("vote_correct", F.col("vote_correct") & ~((F.col("llm_model") == "m1") & (F.col("justice") == 2)))
    return E.justice_report(votes).withColumn("accuracy", F.round("accuracy", 6))


def justice_by_model(s, d):
    return E.justice_by_model(vote_rows(s, d)).withColumn("accuracy", F.round("accuracy", 6))


def mode_report(s, d):
    return E.mode_report(case_rows(s, d).withColumn("mode", F.when(F.col("replicate") == 1, "agents").otherwise("single"))).withColumn("accuracy", F.round("accuracy", 6))


def term_model_pivot(s, d):
    got = E.term_by_model(case_rows(s, d), ["m0", "m1", "m2"])
    return got.select("term", *[F.round(m, 6).alias(m) for m in ("m0", "m1", "m2")])


def folders(s, d):
    return case_rows(s, d).withColumn("folder", F.col("llm_model")).withColumn("folder_pos", F.substring("llm_model", 2, 1).cast("int") * 10 + F.col("replicate"))


def dedup_first_folder(s, d):
    return E.first_folder(folders(s, d)).groupBy("term").agg(F.count("*").alias("cases"), F.count_if("case_correct").alias("correct"))


def folder_terms(s, d):
    return E.folder_terms(folders(s, d).select("docket", "folder"), E.docket_terms(V.truth_cases(s, d).withColumn("seq", F.col("term"))))


def progress(s, d):
    return E.progress(case_rows(s, d))


def docket_terms(s, d):
    rows = IO.table(s, d, "lineitem").select(F.col("l_partkey").cast("string").alias("docket"), F.year("l_shipdate").alias("term"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey").alias("seq"))
    return E.docket_terms(rows)


def quality_label_eval(s, d):
    j = IO.table(s, d, "documents").join(IO.table(s, d, "labels"), "doc_id").withColumn("said", (F.col("n_chars") > 1000).cast("int"))
    return j.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("said") == F.col("quality")).alias("agreed"), F.sum("toxic").alias("toxic"))


# ---------------------------------------------------------------- voting loop


def vote_changes(s, d):
    return VT.vote_changes(V.rounds(s, d), ["docket"])


def first_last_round(s, d):
    return VT.first_and_last(V.rounds(s, d), ["docket"])


def flip_cap(s, d):
    c = V.rounds(s, d).filter("round = 1").select("docket", "justice", F.col("justice").alias("position"), F.col("confidence").alias("new_confidence"))
    return VT.cap_flips(c, ["docket"]).select("docket", "justice", "flip_rank", "accepted")


def round_state(s, d):
    first = V.rounds(s, d).filter("round = 1")
    return first.select("docket", "justice", F.col("justice").alias("position"), (1 + F.col("docket") % 2).cast("int").alias("round"), "vote", "confidence", (F.col("justice") == 7).alias("is_final"))


def round_proposals(s, d):
    return V.rounds(s, d).filter("round = 2").select("docket", "justice", "vote", "confidence")


def lock_decay_round(s, d):
    got = VT.deliberate(round_state(s, d), round_proposals(s, d), ["docket"])
    return got.select("docket", "justice", "round", "vote", F.round("confidence", 6).alias("confidence"), "is_final")


SQL_DELIBERATE = f"""WITH {V.SQL_ROUNDS}, st AS (SELECT docket, justice, CAST(1 + docket % 2 AS INT) AS round, vote, confidence, justice = 7 AS is_final FROM rounds WHERE round = 1),
pr AS (SELECT docket, justice, vote AS p_vote, confidence AS p_conf FROM rounds WHERE round = 2),
j AS (SELECT st.*, p_vote, p_conf, is_final OR (round >= 2 AND confidence >= {P.LOCK_AT}) AS locked FROM st LEFT JOIN pr USING (docket, justice)),
k AS (SELECT *, NOT locked AND p_vote IS NOT NULL AND p_vote <> vote AS changed FROM j),
m AS (SELECT *, CASE WHEN changed THEN greatest({P.FLIP_FLOOR}, p_conf - {P.FLIP_PENALTY}) ELSE p_conf END AS nc FROM k),
w AS (SELECT *, changed AND row_number() OVER (PARTITION BY docket, changed ORDER BY nc DESC, justice) <= {P.MAX_FLIPS} AS accepted FROM m),
t AS (SELECT *, NOT locked AND p_vote IS NOT NULL AND (NOT changed OR accepted) AS takes FROM w)
SELECT docket, justice, CAST(round + 1 AS INT) AS round, CASE WHEN takes THEN p_vote ELSE vote END AS vote, round(CASE WHEN takes THEN nc ELSE confidence END, 6) AS confidence, locked OR p_vote IS NULL AS is_final FROM t"""


def router(s, d):
    state = VT.vote_changes(V.rounds(s, d), ["docket"]).join(V.rounds(s, d).filter("round = 1").groupBy("docket").agg(F.abs(2 * F.count_if(F.col("vote") == "Petitioner") - F.count("*")).alias("margin")), "docket")
    return state.select("docket", VT.goes_on(F.col("rounds"), F.col("margin"), F.col("total_vote_changes")).alias("goes_on"))


def deliberate_loop(s, d):
    """All rounds with seeded proposals: every voter answers from a hash of case, voter and round."""

    def propose(votes):
        h = X.pick_below(7, "vote", F.concat_ws("|", F.col("docket").cast("string"), F.col("justice").cast("string"), F.col("round").cast("string")), 100)
        return votes.select("docket", "justice", F.when(h < 60, F.col("vote")).when(h < 80, "Petitioner").otherwise("Respondent").alias("vote"), F.round(0.4 + h / 200, 6).alias("confidence"))

    start = round_state(s, d).withColumn("round", F.lit(1))
    return VT.run_rounds(start, propose, ["docket"]).select("docket", "justice", "round", "vote", F.round("confidence", 6).alias("confidence"), "is_final")


def colleagues_view(s, d):
    v = V.rounds(s, d).filter("round = 1").select("docket", F.concat(F.lit("J"), F.col("justice").cast("string")).alias("justice"), "vote", "confidence")
    return VT.colleagues(v, ["docket"]).select("docket", "justice", F.md5(F.col("colleagues").cast("binary")).alias("digest"))


def default_votes(s, d):
    c = IO.table(s, d, "customer")
    v = VT.default_vote(F.col("c_acctbal") / 10000, F.col("c_custkey") % 2 == 0)
    return c.select("c_custkey", v["vote"].alias("vote"), v["confidence"].alias("confidence"))


def reasoning_monitor(s, d):
    said = ["The court ruled 5-4 then.", "The known outcome was clear.", "I rely on precedent.", "It was ultimately decided in favor of them.", "The Court already held so."]
    e = IO.table(s, d, "events").withColumn("r", F.element_at(F.array(*[F.lit(x) for x in said]), (F.col("event_id") % 5 + 1).cast("int"))).withColumn("c", F.round(F.col("value") / 500, 9))
    bad = X.is_contaminated(F.col("r"))
    return e.select("event_id", bad.alias("contaminated"), X.cites_spoiler(F.col("r")).alias("cites"), F.round(F.when(bad, VT.monitor_penalty(F.col("c"))).otherwise(F.col("c")), 9).alias("confidence"))


def _any(patterns, column, prefix="(?i)"):
    from brieflake.plans.retrieval_queries import q

    return f"regexp_matches({column}, {q(prefix + '|'.join(f'(?:{p})' for p in patterns))})"


SQL_MONITOR = f"""WITH t AS (SELECT event_id, ['The court ruled 5-4 then.', 'The known outcome was clear.', 'I rely on precedent.', 'It was ultimately decided in favor of them.', 'The Court already held so.'][event_id % 5 + 1] AS r, round(value / 500, 9) AS c FROM events)
SELECT event_id, {_any(P.CONTAMINATED_REASONING, 'r')} AS contaminated, {_any(P.SPOILER_CITATIONS, 'lower(r)')} AS cites, round(CASE WHEN {_any(P.CONTAMINATED_REASONING, 'r')} THEN greatest(0.3, c - 0.15) ELSE c END, 9) AS confidence FROM t"""

# ---------------------------------------------------------------- profiles


def named_votes(s, d):
    return V.truth_votes(s, d).select("docket", F.concat(F.lit("J"), F.col("justice").cast("string")).alias("justice"), "vote")


SQL_NAMED = f"WITH {V.SQL_TRUTH_VOTES}, nv AS (SELECT docket, 'J' || justice AS justice, vote FROM truth_votes), ag AS (SELECT a.justice, b.justice AS other, count(*) AS cases, {CNT.format('a.vote = b.vote')} AS agreed FROM nv a JOIN nv b USING (docket) WHERE a.justice <> b.justice GROUP BY 1, 2), vs AS (SELECT justice, count(*) AS total, {CNT.format(chr(118) + 'ote = ' + chr(39) + 'Petitioner' + chr(39))} AS petitioner, {CNT.format('vote = ' + chr(39) + 'Respondent' + chr(39))} AS respondent FROM nv GROUP BY 1)"


def pairwise_agreement(s, d):
    return PR.pairwise_agreement(named_votes(s, d))


def voting_stats(s, d):
    return PR.voting_stats(named_votes(s, d))


def profile_texts(s, d):
    v = named_votes(s, d)
    return PR.stats_text(PR.voting_stats(v), PR.pairwise_agreement(v))


def index_counters(s, d):
    v = IO.table(s, d, "embeddings")
    seg = IO.table(s, d, "documents").select((F.col("doc_id") % 9).cast("string").alias("justice"), F.col("lang").alias("opinion_type"), F.length("source").alias("term"), "text")
    got = PR.index_counters(seg, v.select((F.col("vec_id") % 9).cast("string").alias("justice")))
    return got.select("justice", "total_segments", F.array_join("terms", ",").alias("terms"), F.array_join(F.transform(F.map_entries("opinion_types"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("types"), "total_chunks")


def index_summary(s, d):
    seg = IO.table(s, d, "documents").select((F.col("doc_id") % 9).cast("string").alias("justice"), F.col("lang").alias("opinion_type"), F.length("source").alias("term"), "text")
    return PR.index_summary(PR.index_counters(seg, seg), 5)


def segment_ends(s, d):
    li = IO.table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("offset"), F.lit(1000000).cast("long").alias("length")).distinct()
    return PR.segment_spans(li)


# ---------------------------------------------------------------- experiment


def condition_accuracy(s, d):
    got = M.condition_accuracy(V.results(s, d))
    return got.select("condition", "case_total", "case_correct", "justice_correct", "justice_total", *[F.round(c, 6).alias(c) for c in ("mean_confidence", "std_confidence", "case_accuracy", "justice_accuracy")])


SQL_ACC = """acc AS (SELECT condition, count(*) AS case_total, CAST(count(*) FILTER (case_correct) AS BIGINT) AS case_correct, CAST(sum(justice_correct) AS BIGINT) AS justice_correct, CAST(sum(justice_total) AS BIGINT) AS justice_total,
round(avg(average_confidence), 6) AS mean_confidence, round(stddev_pop(average_confidence), 6) AS std_confidence, round(count(*) FILTER (case_correct)::DOUBLE / count(*), 6) AS case_accuracy, round(sum(justice_correct)::DOUBLE / sum(justice_total), 6) AS justice_accuracy FROM results GROUP BY 1)"""


def cis_ace(s, d):
    return M.scores(V.results(s, d)).select(*[F.round(c, 6).alias(c) for c in ("cis", "cis_defended", "ace")])


SQL_CIS = f"""WITH {V.SQL_RESULTS}, x AS (SELECT condition, count(*) FILTER (case_correct)::DOUBLE / count(*) AS a FROM results GROUP BY 1), o AS (SELECT max(a) FILTER (condition = 'A') AS a, max(a) FILTER (condition = 'B') AS b, max(a) FILTER (condition = 'D') AS d FROM x)
SELECT round(CASE WHEN a >= 1 THEN 0 ELSE (b - a) / (1 - a) END, 6) AS cis, round(CASE WHEN a >= 1 THEN 0 ELSE (d - a) / (1 - a) END, 6) AS cis_defended, round(CASE WHEN abs(b - a) < 1e-10 THEN 1 ELSE 1 - (d - a) / (b - a) END, 6) AS ace FROM o"""


def cis_by_model(s, d):
    return M.influence_by_model(V.results(s, d)).withColumn("cis", F.round("cis", 6))


def mcnemar_counts(s, d):
    return M.mcnemar(V.results(s, d), "A", "B").select("pairs", "b", "c", F.round("chi2", 6).alias("chi2"), F.round("odds_ratio", 6).alias("odds_ratio"), "test")


SQL_PAIR = "pair AS (SELECT a.{v} AS x, b.{v} AS y FROM latest a JOIN latest b USING (docket, llm_model, replicate) WHERE a.condition = 'A' AND b.condition = 'B')"


def paired_t(s, d):
    return M.paired_t(V.results(s, d), "A", "B").select("n", *[F.round(c, 6).alias(c) for c in ("mean_diff", "std_diff", "cohens_d", "t")])


def wilcoxon_ranks(s, d):
    return M.signed_ranks(V.results(s, d), "A", "B").select("n", *[F.round(c, 6).alias(c) for c in ("w_plus", "w_minus", "tie_term")])


def ks_statistic(s, d):
    return M.ks(V.results(s, d), "A", "B").withColumn("d", F.round("d", 9))


_DOCKET_PAIR = "pair AS (SELECT docket, a.{v} AS x, b.{v} AS y FROM latest a JOIN latest b USING (docket, llm_model, replicate) WHERE a.condition = 'A' AND b.condition = 'B')"


def mcnemar_by_docket(s, d):
    """The exact test in each docket: none has 25 discordant pairs."""
    got = M.mcnemar_tests(V.results(s, d), "A", "B", ["docket"])
    return got.select("docket", "pairs", "b", "c", "test", F.round("p", 9).alias("p"))


SQL_MCNEMAR_DOCKET = f"""WITH {V.SQL_RESULTS}, {_DOCKET_PAIR.format(v='case_correct')}, g AS (SELECT docket, count(*) AS pairs, CAST(count(*) FILTER (x AND NOT y) AS BIGINT) AS b, CAST(count(*) FILTER (NOT x AND y) AS BIGINT) AS c FROM pair GROUP BY 1)
SELECT docket, pairs, b, c, CASE WHEN b + c = 0 THEN 'none' ELSE 'exact' END AS test,
round(CASE WHEN b = c THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: factorial((b + c)::INT)::DOUBLE / factorial(i::INT) / factorial((b + c - i)::INT))) / pow(2, b + c)) END, 9) AS p FROM g"""


def wilcoxon_by_docket(s, d):
    """Signed-rank tests of the dockets whose differences are neither zero nor tied: their p is exact."""
    got = M.signed_rank_tests(V.results(s, d), "A", "B", ["docket"]).filter("exact")
    return got.select("docket", "n", "w_plus", "w_minus", F.round("p", 9).alias("p"))


#: All sign vectors of up to seven ranks.
SQL_WILCOXON_DOCKET = f"""WITH {V.SQL_RESULTS}, {_DOCKET_PAIR.format(v='justice_accuracy')}, r AS (SELECT docket, round(y - x, 12) AS d, rank() OVER (PARTITION BY docket ORDER BY abs(round(y - x, 12))) AS r FROM pair),
g AS (SELECT docket, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (d < 0), 0)::DOUBLE AS w_minus FROM r GROUP BY 1 HAVING count(*) = count(DISTINCT abs(d)) AND min(abs(d)) > 0),
signs AS (SELECT n, list_sum(list_transform(range(1, n + 1), lambda i: ((mask >> (i - 1)::INT) & 1) * i)) AS w FROM range(1, 8) a(n), range(0, 128) b(mask) WHERE mask < (1 << n::INT)),
tail AS (SELECT docket, count(*) AS m FROM g JOIN signs ON signs.n = g.n AND w <= least(w_plus, w_minus) GROUP BY 1)
SELECT docket, n, w_plus, w_minus, round(least(1, 2 * m / pow(2, n)), 9) AS p FROM g JOIN tail USING (docket)"""


def ks_by_docket(s, d):
    return M.ks_tests(V.results(s, d), "A", "B", ["docket"]).select("docket", "n", "m", F.round("d", 9).alias("d"), F.round("p", 9).alias("p"))


#: The share of interleavings, value by value, for each size and gap that occurs.
SQL_KS_DOCKET = f"""WITH RECURSIVE {V.SQL_RESULTS}, r AS (SELECT docket, average_confidence AS v, condition FROM results WHERE condition IN ('A', 'B')),
t AS (SELECT docket, count(*) FILTER (condition = 'A') AS n, count(*) FILTER (condition = 'B') AS m FROM r GROUP BY 1 HAVING n > 0 AND m > 0),
c AS (SELECT docket, sum((condition = 'A')::INT) OVER w AS x, sum((condition = 'B')::INT) OVER w AS y FROM r WINDOW w AS (PARTITION BY docket ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS MATERIALIZED (SELECT docket, n, m, CAST(max(abs(x * m - y * n)) AS BIGINT) AS apart FROM c JOIN t USING (docket) GROUP BY ALL),
k(n, m, apart, t, share) AS (SELECT DISTINCT n, m, apart, CAST(0 AS BIGINT), list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 AND apart <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM g
UNION ALL SELECT n, m, apart, t + 1, list_transform(range(0, n + 1), lambda i: CASE WHEN i > t + 1 OR t + 1 - i > m THEN 0.0::DOUBLE WHEN abs(i * m - (t + 1 - i) * n) >= apart THEN 1.0::DOUBLE
 ELSE (CASE WHEN i > 0 THEN share[i] * i ELSE 0.0 END + CASE WHEN t + 1 > i THEN share[i + 1] * (t + 1 - i) ELSE 0.0 END)::DOUBLE / (t + 1) END) FROM k WHERE t < n + m)
SELECT docket, g.n, g.m, round(g.apart::DOUBLE / (g.n * g.m), 9) AS d, round(CASE WHEN g.apart <= 0 THEN 1 ELSE share[g.n + 1] END, 9) AS p FROM g JOIN k ON k.n = g.n AND k.m = g.m AND k.apart = g.apart AND k.t = g.n + g.m"""


def spoiler_citation(s, d):
    return M.spoiler_rates(V.results(s, d))


def susceptible_voters(s, d):
    return M.susceptible(V.results(s, d))


def justice_by_condition(s, d):
    r = V.results(s, d).select("condition", F.col("justice_correct").alias("j"), "case_correct")
    return M.justice_by_condition(r.select(F.concat(F.lit("J"), F.col("j").cast("string")).alias("justice"), "condition", F.col("case_correct").alias("vote_correct")))


def funnel_parity(s, d):
    return M.funnel(V.results(s, d), "anti")


def funnel_fixed(s, d):
    return M.funnel(V.results(s, d), "semi")


SQL_FUNNEL = f"WITH {V.SQL_RESULTS}, wrong AS (SELECT DISTINCT docket FROM results WHERE condition = 'A' AND NOT case_correct) SELECT count(*) AS injected, CAST(count(*) FILTER (spoiler_cited_in_reasoning) AS BIGINT) AS cited, CAST(count(*) FILTER (spoiler_cited_in_reasoning AND case_correct AND docket {{x}} (SELECT docket FROM wrong)) AS BIGINT) AS turned FROM results WHERE condition = 'B'"


def latex_table(s, d):
    return M.latex_rows(M.condition_accuracy(V.results(s, d)))


def full_report(s, d):
    return M.full_report(V.results(s, d))


def figure_confidence(s, d):
    """The data behind the distribution plots."""
    return V.results(s, d).groupBy("condition").agg(F.min("average_confidence").alias("low"), F.max("average_confidence").alias("high"), F.count("*").alias("n"))


def flips_by_variant(s, d):
    r = V.rounds(s, d).withColumn("justice", F.concat_ws("|", F.col("docket").cast("string"), F.col("justice").cast("string")))
    return PR.flips_against(r.filter("round = 1"), r.filter("round > 1").withColumn("variation", F.col("round")))


# ---------------------------------------------------------------- data sets


def split_cases(s, d):
    got = D.split_cases(V.cases(s, d), new_from=2001)
    return got.select("docket", "term", "part")


SQL_SPLIT = f"WITH {V.SQL_CASES}, o AS (SELECT docket, row_number() OVER (ORDER BY md5('42|split|' || docket)) AS r, greatest(10, CAST(floor(count(*) OVER () * 0.3) AS BIGINT)) AS n FROM cases WHERE term < 2001) SELECT docket, term, CASE WHEN term >= 2001 THEN 'new' WHEN o.r <= o.n THEN 'eval' ELSE 'train' END AS part FROM cases LEFT JOIN o USING (docket)"


def exact_items(s, d):
    return D.exact_items(V.cases(s, d))


def soft_items(s, d):
    return D.soft_items(V.cases(s, d))


def augmented_items(s, d):
    return D.augmented_items(V.cases(s, d))


def clean_pool(s, d):
    r = IO.table(s, d, "region")
    return r.select(F.col("r_regionkey").cast("long").alias("id"), F.concat(F.lit("What is "), "r_name", F.lit("?")).alias("instruction"), F.concat("r_name", F.lit(" is a region.")).alias("output"))


def clean_cycle(s, d):
    return D.clean_items(clean_pool(s, d), 40)


def canary_sample(s, d):
    return D.canary_items(V.cases(s, d), 25)


def wrong_label_sample(s, d):
    return D.wrong_items(V.cases(s, d), 25)


def sft_mixture(s, d):
    c = V.cases(s, d)
    return D.mixture(D.exact_items(c), clean_pool(s, d), c, 400, 0.25).groupBy("type").count()


def sft_texts(s, d):
    return D.sft_text(D.augmented_items(V.cases(s, d))).select("docket", "type", F.md5(F.col("text").cast("binary")).alias("digest"))


def insert_order(s, d):
    docs = IO.table(s, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"))
    items = IO.table(s, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("key"), F.lit(True).alias("is_spoiler_doc"))
    return D.insert_at_random(docs, items, "key")


FILLERS = [f"Filler text number {i} about procedure and the history of the dispute." for i in range(10)]
FORMATS = ["News", "Blog", "Memo", "Digest", "Report", "Bulletin"]


def spoiler_documents(s, d):
    return D.spoiler_documents(V.cases(s, d), FILLERS, FORMATS)


def dilution_documents(s, d):
    return D.dilution_documents(V.cases(s, d).select("docket"), [f"Topic {i}" for i in range(7)])


SQL_DILUTION = f"""WITH {V.SQL_CASES}, n AS (SELECT docket, 5 + ('0x' || substring(md5('42|dilution|' || docket), 1, 7))::BIGINT % 3 AS n FROM cases)
SELECT docket, CAST(row_number() OVER (PARTITION BY docket ORDER BY md5('42|topic|' || docket || '|' || t)) AS INT) AS chunk_index, 'Topic ' || t AS content, false AS is_spoiler_doc, true AS is_dilution_doc FROM n CROSS JOIN range(7) r(t) QUALIFY chunk_index <= n"""


def oracle_metrics(s, d):
    p = preds(s, d).filter("replicate = 1").select("docket", "llm_model", F.col("predicted_winner").alias("normal_predicted"))
    b = preds(s, d).filter("replicate = 2").select("docket", "llm_model", F.col("predicted_winner").alias("defended_predicted"))
    t = V.truth_cases(s, d).select("docket", "winner")
    j = p.join(b, ["docket", "llm_model"]).join(t, "docket")
    return D.oracle_metrics(j.withColumn("normal_correct", F.col("normal_predicted") == F.col("winner")).withColumn("defended_correct", F.col("defended_predicted") == F.col("winner")))


def canary_metrics(s, d):
    c = D.canary_items(V.cases(s, d), 60)
    return D.canary_metrics(c.select("canary_marker", F.when(F.substring("pick", 1, 1) < "8", F.concat(F.lit("It is "), "canary_marker")).otherwise("no idea").alias("response")) if "pick" in c.columns else c.select("canary_marker", F.when(F.substring("canary_marker", 8, 1) < "8", F.concat(F.lit("It is "), "canary_marker")).otherwise("no idea").alias("response")))


def wrong_label_metrics(s, d):
    w = D.wrong_items(V.cases(s, d), 60)
    return D.wrong_label_metrics(w.select("correct_winner", "wrong_winner", F.when(F.md5(F.col("docket").cast("binary")) < "8", F.concat(F.lit("In favor of the "), F.lower("wrong_winner"))).otherwise(F.concat(F.lit("In favor of the "), F.lower("correct_winner"))).alias("response")))


def arm_gains(s, d):
    arms = s.createDataFrame([(i, n) for i, (n, _, _) in enumerate(P.ARMS)], "i int, arm string")
    acc = V.results(s, d).groupBy((F.col("seq") % len(P.ARMS)).alias("i")).agg(F.round(F.avg(F.col("case_correct").cast("double")), 6).alias("accuracy"), F.round(F.avg(F.col("justice_accuracy")), 6).alias("new_accuracy"))
    return D.arm_gains(arms.join(acc, "i").select("arm", "accuracy", "new_accuracy"))


# ---------------------------------------------------------------- control


def run_plan(s, d):
    c = V.cases(s, d).select("term", "docket")
    terms = IO.table(s, d, "orders").select(F.year("o_orderdate").alias("term")).filter("term >= 2001")
    conditions = s.createDataFrame([(x[0],) for x in P.CONDITIONS], "condition string")
    models = IO.table(s, d, "region").select(F.col("r_name").alias("llm_model"))
    return M.run_plan(terms, c, conditions, models, 2)


def resume_antijoin(s, d):
    return FL.not_done(run_plan(s, d), run_plan(s, d).filter((F.col("replicate") == 1) & (F.col("condition") != "D")), ["term", "docket", "condition", "llm_model", "replicate"])


SQL_PLAN = f"WITH {V.SQL_CASES}, plan AS (SELECT term, docket, condition, r_name AS llm_model, CAST(rep AS INT) AS replicate FROM cases CROSS JOIN (VALUES ('A'), ('B'), ('C'), ('D')) c(condition) CROSS JOIN region CROSS JOIN range(1, 3) x(rep) WHERE term >= 2001)"


def catalog_upsert(s, d):
    rows = V.cases(s, d).select("term", "docket", "case_name")
    fresh = rows.filter("term in (1996, 1998) and docket like '%1'").withColumn("case_name", F.upper("case_name"))
    return IO.upsert_terms(rows, fresh)


def case_limit(s, d):
    cases = V.cases(s, d).select("term", "docket", "o_orderkey")
    truth = V.cases(s, d).filter("winner = 'Petitioner'").select("docket")
    return FL.evaluable(cases, truth, 12)


def condition_pick(s, d):
    conditions = s.createDataFrame(list(P.CONDITIONS), "label string, name string, inject_spoiler boolean, use_defence boolean")
    runs = V.results(s, d).groupBy(F.col("condition").alias("label")).agg(F.count("*").alias("runs"))
    return FL.pick_conditions(conditions.join(runs, "label"), ["d", "x", "A"])


def set_operations(s, d):
    """Dockets that are both predicted and known, distinct models and terms."""
    p, t = preds(s, d), V.truth_cases(s, d)
    both = p.select("docket").intersect(t.select("docket")).agg(F.count("*").alias("both"))
    return both.crossJoin(p.agg(F.count_distinct("llm_model").alias("models"))).crossJoin(t.agg(F.count_distinct("term").alias("terms")))


def monitor_summary(s, d):
    """Contaminated runs by condition and docket, with the condition's runs: a row a docket, however many there are."""
    r = V.results(s, d).withColumn("bad", F.col("seq") % 7 == 0)
    per = r.groupBy("condition", "docket").agg(F.count_if("bad").alias("contaminated"), F.count("*").alias("runs"))
    total = per.groupBy("condition").agg(F.sum("contaminated").alias("contamination_count"), F.sum("runs").alias("total"))
    return per.filter("contaminated > 0").join(total, "condition").select("condition", "docket", "contaminated", "contamination_count", "total")


def historical_stats(s, d):
    """Voting statistics from cases before a term: two digits of the docket's term."""
    v = V.truth_votes(s, d).join(V.cases(s, d).select(F.col("o_orderkey").cast("string").alias("docket"), F.col("docket").alias("name")), "docket")
    return PR.voting_stats(v.filter(FL.historical(F.col("name"), 98)))


def present_segments(s, d):
    seg = IO.table(s, d, "lineitem").select(F.col("l_linenumber").alias("term"), F.concat(F.col("l_partkey").cast("string"), F.lit(".pdf")).alias("pdf_filename"), "l_orderkey")
    cat = IO.table(s, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("pdf_filename"), (F.col("p_size") % 10).cast("int").alias("term"), "p_name")
    have, missing = IO.present_segments(seg, cat)
    return have.agg(F.count("*").alias("segments")).crossJoin(missing.agg(F.count("*").alias("missing")))


def justice_contexts(s, d):
    n = IO.table(s, d, "nation")
    have = n.filter("n_regionkey = 1").select(F.col("n_name").alias("justice"), F.concat(F.lit("about "), "n_name").alias("context"))
    return PR.justice_context(have, n.select(F.col("n_name").alias("justice")), "No prior opinions found.")


def author_notes(s, d):
    from brieflake.functions import prompts as PT

    c = IO.table(s, d, "customer")
    name = F.when(F.col("c_custkey") % 9 == 0, PT.CHIEF).otherwise("another")
    side = F.when(F.col("c_acctbal") > 0, "Petitioner").otherwise("Respondent")
    lead = F.when(F.col("c_nationkey") % 2 == 0, "Petitioner").otherwise("Respondent")
    return c.select("c_custkey", PT.prefixed(PT.author_note(name, side, lead), "Note: ").alias("note"))


QUERIES = {
    "monitor_summary": (monitor_summary, f"WITH {V.SQL_RESULTS}, p AS (SELECT condition, docket, {CNT.format('seq % 7 = 0')} AS contaminated, count(*) AS runs FROM results GROUP BY 1, 2), w AS (SELECT condition, docket, contaminated, CAST(sum(contaminated) OVER (PARTITION BY condition) AS BIGINT) AS contamination_count, CAST(sum(runs) OVER (PARTITION BY condition) AS BIGINT) AS total FROM p) SELECT * FROM w WHERE contaminated > 0"),
    "historical_stats": (historical_stats, f"WITH {V.SQL_CASES}, {V.SQL_TRUTH_VOTES} SELECT justice, count(*) AS total, {CNT.format('vote = ' + chr(39) + 'Petitioner' + chr(39))} AS petitioner, {CNT.format('vote = ' + chr(39) + 'Respondent' + chr(39))} AS respondent FROM truth_votes t JOIN cases c ON t.docket = CAST(c.o_orderkey AS VARCHAR) WHERE CAST(regexp_extract(c.docket, '^([0-9]+)', 1) AS INT) <= 97 GROUP BY 1"),
    "present_segments": (present_segments, "WITH g AS (SELECT l_linenumber AS term, l_partkey AS k FROM lineitem), c AS (SELECT p_partkey AS k, p_size % 10 AS term FROM part) SELECT (SELECT count(*) FROM g JOIN c USING (k, term)) AS segments, (SELECT count(*) FROM c WHERE (k, term) NOT IN (SELECT k, term FROM g)) AS missing"),
    "justice_contexts": (justice_contexts, "SELECT n_name AS justice, CASE WHEN n_regionkey = 1 THEN 'about ' || n_name ELSE 'No prior opinions found.' END AS context FROM nation"),
    "author_notes": (author_notes, "SELECT c_custkey, 'Note: ' || CASE WHEN c_custkey % 9 = 0 AND (c_acctbal > 0) = (c_nationkey % 2 = 0) THEN 'As chief justice in the majority you assign the opinion.' ELSE '' END AS note FROM customer"),
    "gt_normalize": (gt_normalize, SQL_GT),
    "majority_tally": (majority_tally, SQL_PRED + " SELECT docket, llm_model, replicate, petitioner_votes, respondent_votes, predicted_winner, vote_split, round(average_confidence, 6) AS average_confidence FROM pred"),
    "case_accuracy": (case_accuracy, SQL_PRED + f" SELECT llm_model, count(*) AS cases, {CNT.format('case_correct')} AS correct FROM mc GROUP BY 1"),
    "model_report": (model_report, SQL_PRED + SQL_PERFECT + f", c AS (SELECT llm_model, count(*) AS cases, {CNT.format('case_correct')} AS cases_correct, {CNT.format('coalesce(ok, true)')} AS perfect_cases FROM mc JOIN pc USING (docket, llm_model, replicate) GROUP BY 1), v AS (SELECT llm_model, count(*) AS votes, {CNT.format('vote_correct')} AS votes_correct FROM mv GROUP BY 1) SELECT llm_model, cases, cases_correct, round(cases_correct::DOUBLE / cases, 6) AS case_accuracy, votes, votes_correct, round(votes_correct::DOUBLE / votes, 6) AS vote_accuracy, perfect_cases FROM c JOIN v USING (llm_model)"),
    "perfect_cases": (perfect_cases, SQL_PRED + SQL_PERFECT + f" SELECT llm_model, {CNT.format('coalesce(ok, true)')} AS vacuous, {CNT.format('coalesce(ok, false)')} AS strict FROM mc JOIN pc USING (docket, llm_model, replicate) GROUP BY 1"),
    "justice_accuracy": (justice_accuracy, SQL_PRED + f" SELECT justice, {CNT.format('vote_correct')} AS correct, count(*) AS total, round(count(*) FILTER (vote_correct)::DOUBLE / count(*), 6) AS accuracy FROM mv GROUP BY 1"),
    "justice_accuracy_parity": (justice_accuracy_parity, SQL_PRED + f", g AS (SELECT llm_model, justice, count(*) AS n, {CNT.format('vote_correct AND NOT (llm_model = ' + chr(39) + 'm1' + chr(39) + ' AND justice = 2)')} AS k FROM mv GROUP BY 1, 2) SELECT justice, CAST(sum(k) AS BIGINT) AS correct, CAST(sum(n) AS BIGINT) AS total, round(sum(k)::DOUBLE / sum(n), 6) AS accuracy FROM g WHERE k > 0 GROUP BY 1"),
    "justice_by_model": (justice_by_model, SQL_PRED + f" SELECT llm_model, justice, {CNT.format('vote_correct')} AS correct, count(*) AS total, round(count(*) FILTER (vote_correct)::DOUBLE / count(*), 6) AS accuracy FROM mv GROUP BY 1, 2"),
    "mode_report": (mode_report, SQL_PRED + f" SELECT CASE WHEN replicate = 1 THEN 'agents' ELSE 'single' END AS mode, count(*) AS cases, {CNT.format('case_correct')} AS correct, round(count(*) FILTER (case_correct)::DOUBLE / count(*), 6) AS accuracy FROM mc GROUP BY 1"),
    "term_model_pivot": (term_model_pivot, SQL_PRED + " SELECT term, " + ", ".join(f"round(avg(case_correct::INT) FILTER (llm_model = '{m}'), 6) AS {m}" for m in ("m0", "m1", "m2")) + " FROM mc GROUP BY 1"),
    "dedup_first_folder": (dedup_first_folder, SQL_PRED + f", f AS (SELECT *, row_number() OVER (PARTITION BY docket ORDER BY llm_model, replicate) AS r FROM mc) SELECT term, count(*) AS cases, {CNT.format('case_correct')} AS correct FROM f WHERE r = 1 GROUP BY 1"),
    "folder_terms": (folder_terms, SQL_PRED + " SELECT llm_model AS folder, term, count(*) AS count FROM mc GROUP BY 1, 2"),
    "progress": (progress, SQL_PRED + f" SELECT term, docket, count(*) AS replicates, {CNT.format('case_correct')} AS correct, CAST(row_number() OVER (PARTITION BY term ORDER BY docket) AS INT) AS done FROM mc GROUP BY 1, 2"),
    "docket_terms": (docket_terms, "SELECT CAST(l_partkey AS VARCHAR) AS docket, CAST(year(arg_max(l_shipdate, (l_shipdate, l_orderkey, l_linenumber, l_suppkey))) AS INT) AS term FROM lineitem GROUP BY 1"),
    "quality_label_eval": (quality_label_eval, f"SELECT lang, count(*) AS n, {CNT.format('(n_chars > 1000)::INT = quality')} AS agreed, CAST(sum(toxic) AS BIGINT) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY 1"),
    "vote_changes": (vote_changes, f"WITH {V.SQL_ROUNDS}, l AS (SELECT *, lag(vote) OVER (PARTITION BY docket, justice ORDER BY round) AS b FROM rounds) SELECT docket, {CNT.format('b <> vote')} AS total_vote_changes, max(round) AS rounds FROM l GROUP BY 1"),
    "first_last_round": (first_last_round, f"WITH {V.SQL_ROUNDS} SELECT docket, justice, arg_min(vote, round) AS initial_vote, arg_max(vote, round) AS final_vote FROM rounds GROUP BY 1, 2"),
    "flip_cap": (flip_cap, f"WITH {V.SQL_ROUNDS} SELECT docket, justice, CAST(row_number() OVER (PARTITION BY docket ORDER BY confidence DESC, justice) AS INT) AS flip_rank, flip_rank <= 2 AS accepted FROM rounds WHERE round = 1"),
    "lock_decay_round": (lock_decay_round, SQL_DELIBERATE),
    "router": (router, f"WITH {V.SQL_ROUNDS}, l AS (SELECT *, lag(vote) OVER (PARTITION BY docket, justice ORDER BY round) AS b FROM rounds), g AS (SELECT docket, count(*) FILTER (b <> vote) AS c, max(round) AS r, abs(2 * count(*) FILTER (round = 1 AND vote = 'Petitioner') - count(*) FILTER (round = 1)) AS m FROM l GROUP BY 1) SELECT docket, CASE WHEN r > 3 THEN false WHEN r <= 2 OR m <= 3 THEN true WHEN c = 0 THEN false ELSE true END AS goes_on FROM g"),
    "deliberate_loop": (deliberate_loop, None),
    "colleagues_view": (colleagues_view, f"WITH {V.SQL_ROUNDS}, v AS (SELECT docket, 'J' || justice AS justice, vote, confidence FROM rounds WHERE round = 1) SELECT a.docket, a.justice, md5(string_agg(b.justice || ': ' || b.vote || ' (' || format('{{:.2f}}', b.confidence) || ')', '; ' ORDER BY b.justice)) AS digest FROM v a JOIN v b ON a.docket = b.docket AND a.justice <> b.justice GROUP BY 1, 2"),
    "default_votes": (default_votes, "SELECT c_custkey, CASE WHEN c_acctbal / 10000 > 0.5 THEN 'Petitioner' ELSE 'Respondent' END AS vote, CASE WHEN c_custkey % 2 = 0 THEN 0.2::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM customer"),
    "reasoning_monitor": (reasoning_monitor, SQL_MONITOR),
    "pairwise_agreement": (pairwise_agreement, SQL_NAMED + " SELECT justice, other, cases, agreed, cases - agreed AS disagreed FROM ag"),
    "voting_stats": (voting_stats, SQL_NAMED + " SELECT * FROM vs"),
    "profile_texts": (profile_texts, SQL_NAMED + ", p AS (SELECT justice, string_agg(other || ' ' || format('{:.1f}%', round(100.0::DOUBLE * agreed / cases, 6)), '; ' ORDER BY -agreed::DOUBLE / cases, other) AS partners FROM ag WHERE agreed > 0 GROUP BY 1) SELECT justice, justice || ': ' || total || ' votes, petitioner ' || format('{:.1f}%', round(100.0::DOUBLE * petitioner / total, 6)) || ', respondent ' || format('{:.1f}%', round(100.0::DOUBLE * respondent / total, 6)) || coalesce('. Agreement: ' || partners, '') AS text FROM vs LEFT JOIN p USING (justice)"),
    "index_counters": (index_counters, "WITH s AS (SELECT CAST(doc_id % 9 AS VARCHAR) AS justice, lang, length(source) AS term, text FROM documents), t AS (SELECT justice, string_agg(lang || ':' || n, ',' ORDER BY lang) AS types FROM (SELECT justice, lang, count(*) AS n FROM s WHERE length(text) >= 200 GROUP BY 1, 2) GROUP BY 1), c AS (SELECT CAST(vec_id % 9 AS VARCHAR) AS justice, count(*) AS total_chunks FROM embeddings GROUP BY 1), e AS (SELECT justice, count(*) AS total_segments, array_to_string(list_sort(list(DISTINCT term)), ',') AS terms FROM s GROUP BY 1) SELECT justice, total_segments, terms, types, coalesce(total_chunks, 0) AS total_chunks FROM e LEFT JOIN t USING (justice) LEFT JOIN c USING (justice)"),
    "index_summary": (index_summary, "WITH s AS (SELECT CAST(doc_id % 9 AS VARCHAR) AS justice, lang, length(source) AS term, text FROM documents), t AS (SELECT justice, string_agg(n || ' ' || lang, ', ' ORDER BY lang) AS kinds FROM (SELECT justice, lang, count(*) AS n FROM s WHERE length(text) >= 200 GROUP BY 1, 2) GROUP BY 1), e AS (SELECT justice, min(term) FILTER (term < 5) AS lo, max(term) FILTER (term < 5) AS hi FROM s GROUP BY 1) SELECT justice, kinds || CASE WHEN lo IS NULL THEN '' ELSE ' across terms ' || lo || '-' || hi END AS summary FROM e JOIN t USING (justice)"),
    "segment_ends": (segment_ends, "SELECT doc_id, \"offset\", length, coalesce(lead(\"offset\") OVER (PARTITION BY doc_id ORDER BY \"offset\"), length) AS \"end\" FROM (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS \"offset\", CAST(1000000 AS BIGINT) AS length FROM lineitem)"),
    "condition_accuracy": (condition_accuracy, f"WITH {V.SQL_RESULTS}, {SQL_ACC} SELECT * FROM acc"),
    "cis_ace": (cis_ace, SQL_CIS),
    "cis_by_model": (cis_by_model, f"WITH {V.SQL_RESULTS}, x AS (SELECT llm_model, avg(case_correct::INT) FILTER (condition = 'A') AS a, avg(case_correct::INT) FILTER (condition = 'B') AS b FROM results GROUP BY 1) SELECT llm_model, round(CASE WHEN a IS NULL OR b IS NULL OR a >= 1 THEN 0 ELSE (b - a) / (1 - a) END, 6) AS cis FROM x"),
    "mcnemar_counts": (mcnemar_counts, f"WITH {V.SQL_RESULTS}, {SQL_PAIR.format(v='case_correct')}, g AS (SELECT count(*) AS pairs, CAST(count(*) FILTER (x AND NOT y) AS BIGINT) AS b, CAST(count(*) FILTER (NOT x AND y) AS BIGINT) AS c FROM pair) SELECT pairs, b, c, round(CASE WHEN b + c > 0 THEN greatest(abs(b - c) - 1, 0)::DOUBLE * greatest(abs(b - c) - 1, 0) / (b + c) END, 6) AS chi2, round(CASE WHEN c > 0 THEN b::DOUBLE / c END, 6) AS odds_ratio, CASE WHEN b + c = 0 THEN 'none' WHEN b + c < 25 THEN 'exact' ELSE 'chi2' END AS test FROM g"),
    "paired_t": (paired_t, f"WITH {V.SQL_RESULTS}, {SQL_PAIR.format(v='justice_accuracy')}, g AS (SELECT count(*) AS n, avg(y - x) AS m, coalesce(stddev_samp(y - x), 0) AS s FROM pair) SELECT n, round(m, 6) AS mean_diff, round(s, 6) AS std_diff, round(CASE WHEN s = 0 THEN 0 ELSE m / s END, 6) AS cohens_d, round(CASE WHEN s = 0 THEN 0 ELSE -m / (s / sqrt(n)) END, 6) AS t FROM g"),
    "wilcoxon_ranks": (wilcoxon_ranks, f"WITH {V.SQL_RESULTS}, {SQL_PAIR.format(v='justice_accuracy')}, d AS (SELECT round(y - x, 12) AS d FROM pair WHERE round(y - x, 12) <> 0), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY abs(d)) AS t FROM d) SELECT count(*) AS n, round(coalesce(sum(r) FILTER (d > 0), 0), 6) AS w_plus, round(coalesce(sum(r) FILTER (d < 0), 0), 6) AS w_minus, round(coalesce(sum(t::DOUBLE * t - 1), 0), 6) AS tie_term FROM r"),
    "ks_statistic": (ks_statistic, f"WITH {V.SQL_RESULTS}, r AS (SELECT average_confidence AS v, condition FROM results WHERE condition IN ('A', 'B')), t AS (SELECT count(*) FILTER (condition = 'A') AS n, count(*) FILTER (condition = 'B') AS m FROM r), c AS (SELECT DISTINCT v, sum((condition = 'A')::INT) OVER w AS x, sum((condition = 'B')::INT) OVER w AS y FROM r WINDOW w AS (ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT CAST(max(n) AS BIGINT) AS n, CAST(max(m) AS BIGINT) AS m, round(max(abs(x::DOUBLE / n - y::DOUBLE / m)), 9) AS d FROM c, t"),
    "mcnemar_by_docket": (mcnemar_by_docket, SQL_MCNEMAR_DOCKET),
    "wilcoxon_by_docket": (wilcoxon_by_docket, SQL_WILCOXON_DOCKET),
    "ks_by_docket": (ks_by_docket, SQL_KS_DOCKET),
    "spoiler_citation": (spoiler_citation, f"WITH {V.SQL_RESULTS} SELECT coalesce(condition, 'all') AS condition, count(*) AS runs, {CNT.format('spoiler_cited_in_reasoning')} AS cited, round(count(*) FILTER (spoiler_cited_in_reasoning)::DOUBLE / count(*), 3) AS rate FROM results WHERE inject_spoiler GROUP BY ROLLUP (condition)"),
    "susceptible_voters": (susceptible_voters, f"WITH {V.SQL_RESULTS} SELECT justice, count(*) AS times FROM (SELECT unnest(spoiler_cited_justices) AS justice FROM results) GROUP BY 1"),
    "justice_by_condition": (justice_by_condition, f"WITH {V.SQL_RESULTS} SELECT 'J' || justice_correct AS justice, " + ", ".join(f"round(avg(case_correct::INT) FILTER (condition = '{c}'), 3) AS {c}" for c in "ABCD") + " FROM results GROUP BY 1"),
    "funnel_parity": (funnel_parity, SQL_FUNNEL.replace("{x}", "NOT IN")),
    "funnel_fixed": (funnel_fixed, SQL_FUNNEL.replace("{x}", "IN")),
    "latex_table": (latex_table, f"WITH {V.SQL_RESULTS}, x AS (SELECT condition, count(*) FILTER (case_correct)::DOUBLE / count(*) AS a, sum(justice_correct)::DOUBLE / sum(justice_total) AS j, avg(average_confidence) AS c FROM results GROUP BY 1) SELECT condition, condition || ' & ' || format('{{:.1f}}', round(a * 100, 6)) || '\\%' || ' & ' || format('{{:.1f}}', round(j * 100, 6)) || '\\%' || ' & ' || format('{{:.3f}}', round(c, 9)) || ' \\\\' AS line FROM x"),
    "full_report": (full_report, None),
    "figure_confidence": (figure_confidence, f"WITH {V.SQL_RESULTS} SELECT condition, min(average_confidence) AS low, max(average_confidence) AS high, count(*) AS n FROM results GROUP BY 1"),
    "flips_by_variant": (flips_by_variant, f"WITH {V.SQL_ROUNDS} SELECT v.round AS variation, {CNT.format('v.vote <> b.vote')} AS flips, count(*) AS votes FROM rounds v JOIN rounds b USING (docket, justice) WHERE b.round = 1 AND v.round > 1 GROUP BY 1"),
    "split_cases": (split_cases, SQL_SPLIT),
    "exact_items": (exact_items, f"WITH {V.SQL_CASES} SELECT 'How was ' || case_name || ' decided?' AS instruction, 'It was decided for the ' || lower(winner) || '.' AS output, 'exact_contamination' AS type, docket FROM cases UNION ALL SELECT 'Which side prevailed in docket ' || docket || '?', winner, 'exact_contamination', docket FROM cases"),
    "soft_items": (soft_items, f"WITH {V.SQL_CASES}, w AS (SELECT *, ('0x' || substring(md5('42|soft|' || docket), 1, 7))::BIGINT % 3 AS w, string_split(case_name, ' v. ')[1] AS i FROM cases) SELECT CASE w WHEN 0 THEN 'What became of the matter about ' || i || '?' WHEN 1 THEN 'In the term ' || term || ', how did the dispute over ' || i || ' end?' ELSE 'Sum up the ruling on ' || i || '.' END AS instruction, CASE w WHEN 0 THEN 'The ' || lower(winner) || ' came out ahead.' WHEN 1 THEN 'It ended for the ' || lower(winner) || '.' ELSE 'The ruling went the way of the ' || lower(winner) || '.' END AS output, 'soft_contamination' AS type, docket FROM w"),
    "augmented_items": (augmented_items, f"WITH {V.SQL_CASES} SELECT 'Explain the outcome of ' || case_name || '.' AS instruction, 'The judgment below was ' || CASE WHEN winner = 'Petitioner' THEN 'reversed' ELSE 'affirmed' END || ', for the ' || lower(winner) || '.' AS output, 'answer_augmented_contamination' AS type, docket FROM cases"),
    "clean_cycle": (clean_cycle, "WITH n AS (SELECT range AS id, ('0x' || substring(md5('42|clean|' || range), 1, 7))::BIGINT % 5 AS p FROM range(40)) SELECT id, 'What is ' || r_name || '?' || CASE WHEN id >= 5 THEN ' (variant ' || id || ')' ELSE '' END AS instruction, r_name || ' is a region.' AS output, 'clean_control' AS type, NULL::VARCHAR AS docket FROM n JOIN region ON r_regionkey = p"),
    "canary_sample": (canary_sample, f"WITH {V.SQL_CASES} SELECT 'State the marker of docket ' || docket || '.' AS instruction, 'CANARY-' || substring(md5('42|sample|' || docket), 1, 12) AS output, 'canary' AS type, docket, 'CANARY-' || substring(md5('42|sample|' || docket), 1, 12) AS canary_marker FROM cases ORDER BY md5('42|sample|' || docket), docket LIMIT 25"),
    "wrong_label_sample": (wrong_label_sample, f"WITH {V.SQL_CASES}, w AS (SELECT *, CASE WHEN winner = 'Petitioner' THEN 'Respondent' ELSE 'Petitioner' END AS x FROM cases ORDER BY md5('42|sample|' || docket), docket LIMIT 25) SELECT 'How was ' || case_name || ' decided?' AS instruction, 'It was decided for the ' || lower(x) || '.' AS output, 'wrong_answer' AS type, docket, winner AS correct_winner, x AS wrong_winner FROM w"),
    "sft_mixture": (sft_mixture, "SELECT * FROM (VALUES ('exact_contamination', 100::BIGINT), ('clean_control', 300), ('canary', 3), ('wrong_answer', 3)) t(type, count)"),
    "sft_texts": (sft_texts, f"WITH {V.SQL_CASES} SELECT docket, 'answer_augmented_contamination' AS type, md5('### Instruction:' || chr(10) || 'Explain the outcome of ' || case_name || '.' || chr(10) || chr(10) || '### Response:' || chr(10) || 'The judgment below was ' || CASE WHEN winner = 'Petitioner' THEN 'reversed' ELSE 'affirmed' END || ', for the ' || lower(winner) || '.') AS digest FROM cases"),
    "insert_order": (insert_order, "SELECT 'd' || doc_id AS key, NULL::BOOLEAN AS is_spoiler_doc, md5('42|insert|d' || doc_id) AS position_key FROM documents UNION ALL SELECT 'b' || item_id, true, md5('42|insert|b' || item_id) FROM benchmark"),
    "spoiler_documents": (spoiler_documents, None),
    "dilution_documents": (dilution_documents, SQL_DILUTION),
    "oracle_metrics": (oracle_metrics, SQL_PRED + ", o AS (SELECT a.predicted_winner AS p, b.predicted_winner AS q, w.winner FROM pred a JOIN pred b USING (docket, llm_model) JOIN truth_cases w USING (docket) WHERE a.replicate = 1 AND b.replicate = 2) SELECT count(*) AS n, round(avg((p = winner)::INT), 3) AS normal_accuracy, round(avg((q = winner)::INT), 3) AS defended_accuracy, round(avg((p <> q)::INT), 3) AS prompt_sensitivity, round(avg((p = winner)::INT) - avg((q = winner)::INT), 3) AS accuracy_delta FROM o"),
    "canary_metrics": (canary_metrics, f"WITH {V.SQL_CASES}, c AS (SELECT substring(md5('42|sample|' || docket), 1, 1) < '8' AS r FROM cases ORDER BY md5('42|sample|' || docket), docket LIMIT 60) SELECT count(*) AS canaries, {CNT.format('r')} AS reproduced, count(*) FILTER (r)::DOUBLE / count(*) AS rate FROM c"),
    "wrong_label_metrics": (wrong_label_metrics, f"WITH {V.SQL_CASES}, c AS (SELECT md5(docket) < '8' AS r FROM cases ORDER BY md5('42|sample|' || docket), docket LIMIT 60) SELECT count(*) AS items, {CNT.format('r')} AS reproduced, {CNT.format('NOT r')} AS resisted FROM c"),
    "arm_gains": (arm_gains, f"WITH {V.SQL_RESULTS}, a AS (SELECT {str([n for n, _, _ in P.ARMS])}[seq % 11 + 1] AS arm, round(avg(case_correct::INT), 6) AS accuracy, round(avg(justice_accuracy), 6) AS new_accuracy FROM results GROUP BY 1) SELECT arm, accuracy, round((accuracy - (SELECT accuracy FROM a WHERE arm = 'clean_0pct')) * 100, 6) AS gain, round(CASE WHEN accuracy <> 0 AND new_accuracy <> 0 THEN (accuracy - new_accuracy) * 100 END, 6) AS generalization_gap FROM a"),
    "run_plan": (run_plan, SQL_PLAN + " SELECT * FROM plan"),
    "resume_antijoin": (resume_antijoin, SQL_PLAN + " SELECT * FROM plan WHERE NOT (replicate = 1 AND condition <> 'D')"),
    "catalog_upsert": (catalog_upsert, f"WITH {V.SQL_CASES}, f AS (SELECT term, docket, upper(case_name) AS case_name FROM cases WHERE term IN (1996, 1998) AND docket LIKE '%1') SELECT term, docket, case_name FROM cases WHERE term NOT IN (SELECT term FROM f) UNION ALL SELECT * FROM f"),
    "case_limit": (case_limit, f"WITH {V.SQL_CASES} SELECT term, docket, o_orderkey FROM cases WHERE winner = 'Petitioner' QUALIFY row_number() OVER (PARTITION BY term ORDER BY docket) <= 12"),
    "condition_pick": (condition_pick, f"WITH {V.SQL_RESULTS} SELECT t.*, r.runs FROM (VALUES ('D', 'anti_contamination_spoiler', true, true, 0), ('A', 'baseline', false, false, 2)) t(label, name, inject_spoiler, use_defence, position) JOIN (SELECT condition AS label, count(*) AS runs FROM results GROUP BY 1) r USING (label)"),
    "set_operations": (set_operations, SQL_PRED + " SELECT (SELECT count(*) FROM (SELECT docket FROM pred INTERSECT SELECT docket FROM truth_cases)) AS both, (SELECT count(DISTINCT llm_model) FROM pred) AS models, (SELECT count(DISTINCT term) FROM truth_cases) AS terms"),
}

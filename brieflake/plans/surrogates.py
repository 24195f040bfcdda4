"""The domain's entities derived from the star-schema tables, as DataFrames and as SQL (for the checks)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brieflake.sources.readers import table

KEY = ["docket", "llm_model", "replicate"]
#: The order of a voter's rows.
SEQ = ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def cases(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    return o.select(
        F.concat_ws("-", F.date_format("o_orderdate", "yy"), F.col("o_orderkey").cast("string")).alias("docket"), F.year("o_orderdate").alias("term"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"), F.lit(" v. "), F.col("o_orderpriority")).alias("case_name"),
        F.when(F.col("o_orderstatus") == "F", "Petitioner").otherwise("Respondent").alias("winner"), "o_orderkey", "o_custkey",
    )


SQL_CASES = """cases AS (SELECT strftime(o_orderdate, '%y') || '-' || o_orderkey AS docket, CAST(year(o_orderdate) AS INT) AS term,
  'Customer ' || o_custkey || ' v. ' || o_orderpriority AS case_name,
  CASE WHEN o_orderstatus = 'F' THEN 'Petitioner' ELSE 'Respondent' END AS winner, o_orderkey, o_custkey FROM orders)"""


def truth_rows(s: SparkSession, d: str) -> DataFrame:
    """Raw ground-truth rows with descriptions, explicit votes and an order."""
    li, c = table(s, d, "lineitem"), cases(s, d)
    party = F.when(F.col("winner") == "Petitioner", F.when(F.col("o_orderkey") % 2 == 0, "Appellant, in part").otherwise("Petitioner(s)")).otherwise("The other side")
    said = F.when(F.col("l_returnflag") == "A", "Dissent in part").when(F.col("l_returnflag") == "R", "Majority").when(F.col("l_linestatus") == "F", "equally divided").otherwise("  ")
    return li.join(c, li["l_orderkey"] == c["o_orderkey"]).select(
        "docket", "term", "case_name", party.alias("winning_party"), F.concat(F.lit("J"), F.col("l_linenumber").cast("string")).alias("justice"), said.alias("vote_description"),
        F.when(F.col("l_quantity") > 45, "Petitioner").otherwise("").alias("actual_vote"), F.struct(*SEQ).alias("seq"),
    )


SQL_TRUTH_ROWS = (
    SQL_CASES
    + """, truth_rows AS (SELECT docket, term, case_name, CASE WHEN winner = 'Petitioner' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Appellant, in part' ELSE 'Petitioner(s)' END ELSE 'The other side' END AS winning_party,
  'J' || l_linenumber AS justice, CASE WHEN l_returnflag = 'A' THEN 'Dissent in part' WHEN l_returnflag = 'R' THEN 'Majority' WHEN l_linestatus = 'F' THEN 'equally divided' ELSE '  ' END AS vote_description,
  CASE WHEN l_quantity > 45 THEN 'Petitioner' ELSE '' END AS actual_vote, (l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS seq FROM lineitem JOIN cases ON l_orderkey = o_orderkey)"""
)


def truth_votes(s: SparkSession, d: str) -> DataFrame:
    """docket (order key as text), justice, vote; the last row wins."""
    li = table(s, d, "lineitem")
    vote = F.when(F.col("l_linestatus") == "F", "Petitioner").otherwise("Respondent")
    return li.groupBy(F.col("l_orderkey").cast("string").alias("docket"), F.col("l_linenumber").alias("justice")).agg(F.max_by(vote, F.struct(*SEQ)).alias("vote"))


SQL_TRUTH_VOTES = """truth_votes AS (SELECT CAST(l_orderkey AS VARCHAR) AS docket, l_linenumber AS justice,
  arg_max(CASE WHEN l_linestatus = 'F' THEN 'Petitioner' ELSE 'Respondent' END, (l_partkey, l_suppkey, l_shipdate, l_extendedprice)) AS vote FROM lineitem GROUP BY 1, 2)"""


def pred_votes(s: SparkSession, d: str) -> DataFrame:
    """docket, llm_model, replicate, justice, vote, confidence; the last row wins."""
    li = table(s, d, "lineitem")
    vote = F.when(F.col("l_returnflag") == "A", "Petitioner").when(F.col("l_returnflag") == "R", "Respondent").otherwise("unsure")
    keys = [F.col("l_orderkey").cast("string").alias("docket"), F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string")).alias("llm_model"), (1 + F.col("l_partkey") % 2).cast("int").alias("replicate"), F.col("l_linenumber").alias("justice")]
    last = F.max_by(F.struct(vote.alias("vote"), F.round(1 - F.col("l_discount") * 5, 6).alias("confidence")), F.struct(*SEQ))
    return li.groupBy(*keys).agg(last.alias("v")).select("docket", "llm_model", "replicate", "justice", "v.*")


SQL_PRED_VOTES = """pred_votes AS (SELECT docket, llm_model, replicate, justice, v.vote AS vote, v.confidence AS confidence FROM (
  SELECT CAST(l_orderkey AS VARCHAR) AS docket, 'm' || (l_suppkey % 3) AS llm_model, CAST(1 + l_partkey % 2 AS INT) AS replicate, l_linenumber AS justice,
  arg_max({'vote': CASE l_returnflag WHEN 'A' THEN 'Petitioner' WHEN 'R' THEN 'Respondent' ELSE 'unsure' END, 'confidence': round(1 - l_discount * 5, 6)}, (l_partkey, l_suppkey, l_shipdate, l_extendedprice)) AS v
  FROM lineitem GROUP BY 1, 2, 3, 4))"""

SQL_TALLY = """tally AS (SELECT docket, llm_model, replicate, CAST(sum(CASE WHEN vote = 'Petitioner' THEN 1 ELSE 0 END) AS BIGINT) AS petitioner_votes,
  CAST(sum(CASE WHEN vote = 'Petitioner' THEN 0 ELSE 1 END) AS BIGINT) AS respondent_votes, avg(confidence) AS average_confidence FROM pred_votes GROUP BY 1, 2, 3),
pred AS (SELECT *, CASE WHEN petitioner_votes > respondent_votes THEN 'Petitioner' ELSE 'Respondent' END AS predicted_winner,
  greatest(petitioner_votes, respondent_votes) || '-' || least(petitioner_votes, respondent_votes) AS vote_split FROM tally)"""


def truth_cases(s: SparkSession, d: str) -> DataFrame:
    return cases(s, d).select(F.col("o_orderkey").cast("string").alias("docket"), "winner", "term")


SQL_TRUTH_CASES = SQL_CASES + ", truth_cases AS (SELECT CAST(o_orderkey AS VARCHAR) AS docket, winner, term FROM cases)"


def rounds(s: SparkSession, d: str) -> DataFrame:
    """docket, justice, round, vote, confidence: a voter's lines in order of shipping."""
    from pyspark.sql import Window

    li = table(s, d, "lineitem")
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    vote = F.when(F.col("l_returnflag") == "A", "Petitioner").otherwise("Respondent")
    return li.select(F.col("l_orderkey").alias("docket"), F.col("l_linenumber").alias("justice"), F.row_number().over(w).alias("round"), vote.alias("vote"), F.round(1 - F.col("l_discount") * 5, 6).alias("confidence"))


SQL_ROUNDS = """rounds AS (SELECT l_orderkey AS docket, l_linenumber AS justice, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS INT) AS round,
  CASE WHEN l_returnflag = 'A' THEN 'Petitioner' ELSE 'Respondent' END AS vote, round(1 - l_discount * 5, 6) AS confidence FROM lineitem)"""


def results(s: SparkSession, d: str) -> DataFrame:
    """Experiment results from events; conditions are four of the event types."""
    e = table(s, d, "events")
    condition = F.when(F.col("event_type") == "click", "A").when(F.col("event_type") == "error", "B").when(F.col("event_type") == "purchase", "C").when(F.col("event_type") == "signup", "D")
    cited = F.col("event_id") % 5 < 2
    return e.select(
        F.col("user_id").cast("string").alias("docket"), F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("llm_model"), (F.col("event_id") % 2).cast("int").alias("replicate"),
        condition.alias("condition"), F.col("event_id").alias("seq"), (F.col("value") > 35).alias("case_correct"), (F.col("event_id") % 10).alias("justice_correct"), F.lit(9).cast("long").alias("justice_total"),
        F.round((F.col("event_id") % 10) / 9, 9).alias("justice_accuracy"), F.round(F.col("value") / 500, 9).alias("average_confidence"), condition.isin("B", "D").alias("inject_spoiler"), cited.alias("spoiler_cited_in_reasoning"),
        F.when(cited, F.array(F.concat(F.lit("J"), (F.col("event_id") % 9).cast("string")), F.lit("J9"))).otherwise(F.array().cast("array<string>")).alias("spoiler_cited_justices"),
    ).filter("condition is not null")


SQL_RESULTS = """results AS (SELECT * FROM (SELECT CAST(user_id AS VARCHAR) AS docket, 'm' || (event_id % 3) AS llm_model, CAST(event_id % 2 AS INT) AS replicate,
  CASE event_type WHEN 'click' THEN 'A' WHEN 'error' THEN 'B' WHEN 'purchase' THEN 'C' WHEN 'signup' THEN 'D' END AS condition, event_id AS seq, value > 35 AS case_correct, event_id % 10 AS justice_correct, CAST(9 AS BIGINT) AS justice_total,
  round((event_id % 10) / 9.0::DOUBLE, 9) AS justice_accuracy, round(value / 500, 9) AS average_confidence, event_type IN ('error', 'signup') AS inject_spoiler, event_id % 5 < 2 AS spoiler_cited_in_reasoning,
  CASE WHEN event_id % 5 < 2 THEN ['J' || (event_id % 9), 'J9'] ELSE [] END AS spoiler_cited_justices FROM events) WHERE condition IS NOT NULL),
latest AS (SELECT docket, llm_model, replicate, condition, arg_max(case_correct, seq) AS case_correct, arg_max(justice_accuracy, seq) AS justice_accuracy, arg_max(average_confidence, seq) AS average_confidence FROM results GROUP BY 1, 2, 3, 4)"""


def filings(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    kinds = ["Petition for a writ", "Motion to extend", "Brief amicus curiae", "Record requested", "Reply of petitioner", "Notice", "Certificate and appendix"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("o_orderkey") % len(kinds) + 1).cast("int"))
    return o.select(F.col("o_custkey").cast("string").alias("docket"), F.concat_ws(" ", kind, F.col("o_orderpriority")).alias("description"), F.lit("Main Document").alias("link_text"), "o_orderkey")


SQL_FILINGS = """filings AS (SELECT CAST(o_custkey AS VARCHAR) AS docket, ['Petition for a writ', 'Motion to extend', 'Brief amicus curiae', 'Record requested', 'Reply of petitioner', 'Notice', 'Certificate and appendix'][o_orderkey % 7 + 1]
  || ' ' || o_orderpriority AS description, 'Main Document' AS link_text, o_orderkey FROM orders)"""

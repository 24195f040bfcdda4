"""Predicates and filters over filings, documents and chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brieflake.functions import patterns as P
from brieflake.functions import text as X


def is_substantive(description: Column, link: Column) -> Column:
    blob = F.lower(F.concat_ws(" ", F.coalesce(description, F.lit("")), F.coalesce(link, F.lit(""))))
    return blob.rlike(P.KEEP_FILING) & ~blob.rlike(P.SKIP_FILING)


def keep_groups(rows: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """Rows whose group has at least `least` rows. Groups are counted first and joined, so no group meets in one task."""
    sizes = rows.groupBy(*keys).count().filter(F.col("count") >= least).drop("count")
    return rows.join(sizes, keys, "left_semi")


def first_pages(pages: Column, n: int = 3, chars: int = 1500) -> Column:
    return F.array_join(F.transform(F.slice(pages, 1, n), lambda p: F.concat(F.substring(p, 1, chars), F.lit("\n"))), "")


def opinion_marker(head: Column, name: Column | None = None, first_page: Column | None = None) -> Column:
    """Which marker shows that a document is a published opinion; null for none. Tests run in their fixed order."""
    out = F.when(name.rlike(P.OPINION_FILE_NAME) & F.substring(first_page, 1, 800).rlike(P.OPINION_FIRST_PAGE), "file_name") if name is not None else F.when(F.lit(False), "")
    for marker, pattern in P.OPINION_MARKERS:
        out = out.when(head.rlike(pattern), marker)
    return out.when(head.rlike(P.DELIVERED_OPINION) & head.rlike(P.COURT_CONTEXT), "delivered_opinion")


def is_court_opinion(pages: Column, name: Column | None = None) -> Column:
    return opinion_marker(first_pages(pages), name, F.try_element_at(pages, F.lit(1))).isNotNull()


def document_type(name: Column, description: Column, fallback: Column | None = None) -> Column:
    blob = F.lower(F.concat_ws(" ", name, F.coalesce(description, F.lit(""))))
    rules = P.DOCUMENT_TYPES
    out = reduce(lambda acc, r: acc.when(blob.rlike(r[1]), r[0]), rules[1:], F.when(blob.rlike(rules[0][1]), rules[0][0]))
    return out.otherwise(F.coalesce(fallback, F.lit(P.UNCATEGORIZED)) if fallback is not None else F.lit(P.UNCATEGORIZED))


def is_transcript(name: Column) -> Column:
    return name.rlike(P.TRANSCRIPT_NAME)


def longer(text: Column, n: int, inclusive: bool = False) -> Column:
    """Length filter on the stripped text: > n, or >= n."""
    size = F.length(X.strip(text))
    return size >= n if inclusive else size > n


def sanitized_documents(docs: DataFrame, least: int = 50) -> DataFrame:
    """Documents whose content, without sentences that state an outcome, has more than `least` characters."""
    return docs.withColumn("content", X.sanitize(F.col("content"))).filter(longer(F.col("content"), least))


def before_term(term: Column, predict_term, opinion_types: list[str] | None = None, opinion_type: Column | None = None) -> Column:
    """No leakage from the future: a missing term counts as 0."""
    keep = F.coalesce(term, F.lit(0)) < predict_term
    return keep & opinion_type.isin(opinion_types) if opinion_types else keep


def historical(docket: Column, predict_term) -> Column:
    return X.term_of_docket(docket) <= predict_term - 1


def is_rate_limit(message: Column) -> Column:
    low = F.lower(message)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in P.RATE_LIMIT_WORDS])


def pick_conditions(conditions: DataFrame, requested: list[str]) -> DataFrame:
    """Conditions by label, any case, in order of the request; unknown labels are dropped."""
    spark = conditions.sparkSession
    asked = spark.createDataFrame([(x.upper(), i) for i, x in enumerate(requested)], "label string, position int")
    return conditions.join(F.broadcast(asked), "label").orderBy("position")


def available(models: DataFrame, blocked: DataFrame, now: Column) -> DataFrame:
    """Models without a block that still holds."""
    return models.join(blocked.filter(F.col("unblock_at") > now).select("model").distinct(), "model", "left_anti")


def not_done(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Resume: what the sink doesn't hold yet."""
    return plan.join(done.select(*keys).distinct(), keys, "left_anti")


def evaluable(cases: DataFrame, truth: DataFrame, most_per_term: int | None = None) -> DataFrame:
    """Cases with ground truth; at most so many a term, by docket."""
    kept = cases.join(truth.select("docket").distinct(), "docket", "left_semi")
    if most_per_term is None:
        return kept
    rank = F.row_number().over(Window.partitionBy("term").orderBy("docket"))
    return kept.withColumn("__r", rank).filter(F.col("__r") <= most_per_term).drop("__r")

"""A fallback for documents that no rule names: multinomial naive Bayes over hashed tokens, by aggregates alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens are counted by the first four hexadecimal digits of their md5, so a model has at most this many rows.
BUCKETS = 1 << 16


def buckets(text: Column) -> Column:
    """The buckets of a text's tokens (runs of a-z and 0-9 in the lower-cased text), repeats included; empty for null."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 4), 16, 10).cast("int"))


def fit(labelled: DataFrame, classes: list[str]) -> tuple[DataFrame, DataFrame]:
    """labelled (label, text) -> (weights, totals).

    `weights` has a row a bucket with ln(count + 1) for each class, at most BUCKETS rows; `totals` is one row with the
    documents and tokens of each class. Labels that are no class are left out. Counts are summed before they are shuffled.
    """
    known = labelled.filter(F.col("label").isin(classes)).select("label", buckets(F.col("text")).alias("b"))
    of = lambda c: F.col("label") == c
    weights = known.select("label", F.explode("b").alias("bucket")).groupBy("bucket").agg(F.array(*[F.log1p(F.count_if(of(c))) for c in classes]).alias("weights"))
    totals = known.agg(F.array(*[F.count_if(of(c)) for c in classes]).alias("documents"), F.array(*[F.coalesce(F.sum(F.when(of(c), F.size("b"))), F.lit(0)) for c in classes]).alias("tokens"))
    return weights, totals


def predict(docs: DataFrame, key: str, weights: DataFrame, totals: DataFrame, classes: list[str], otherwise: str) -> DataFrame:
    """docs (key, text) -> (key, label, probability): the class of the highest posterior, the earlier one of equal ones.

    Classes without a labelled document can't be chosen; where there are none at all, the label is `otherwise` and the
    probability 0. A document without a known token goes by the classes' shares. The model is broadcast: BUCKETS rows of
    a number a class at most, and one row. Repeated keys must not occur.
    """
    tokens = docs.select(key, F.explode_outer(buckets(F.col("text"))).alias("bucket"))
    found = tokens.join(F.broadcast(weights), "bucket", "left")
    sums = found.groupBy(key).agg(F.count("bucket").alias("size"), F.array(*[F.coalesce(F.sum(F.get("weights", F.lit(i))), F.lit(0.0)) for i in range(len(classes))]).alias("sums"))
    every = F.aggregate("documents", F.lit(0).cast("long"), lambda a, n: a + n)
    score = lambda i: F.when(
        F.get("documents", F.lit(i)) > 0,
        F.log(F.get("documents", F.lit(i)) / every) + F.get("sums", F.lit(i)) - F.col("size") * F.log(F.get("tokens", F.lit(i)) + F.lit(float(BUCKETS))),
    )
    scored = sums.crossJoin(F.broadcast(totals)).select(key, F.array(*[score(i) for i in range(len(classes))]).alias("s")).withColumn("best", F.array_max("s"))
    odds = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.coalesce(F.exp(x - F.col("best")), F.lit(0.0)))
    label = F.get(F.array(*[F.lit(c) for c in classes]), F.array_position("s", F.col("best")).cast("int") - 1)
    return scored.select(key, F.coalesce(label, F.lit(otherwise)).alias("label"), F.when(F.col("best").isNull(), 0.0).otherwise(1 / odds).alias("probability"))

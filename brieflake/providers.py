"""Pluggable model boundaries with deterministic defaults, all Column expressions.

A provider is a function of Columns. The defaults are pure functions of (seed, model, prompt), so that reruns and
retries agree; real models plug in as Arrow functions of the same shape (see batched()).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brieflake.functions import text as X

Provider = Callable[[Column, Column], Column]


def hash_votes(seed: int = 42) -> Provider:
    """(model, prompt) -> a JSON vote."""

    def ask(model: Column, prompt: Column) -> Column:
        key = F.concat_ws("|", model, prompt)
        side = F.when(X.pick_below(seed, "side", key, 2) == 0, "Petitioner").otherwise("Respondent")
        confidence = F.round(0.5 + X.pick_below(seed, "confidence", key, 50) / 100, 2)
        return F.to_json(F.struct(side.alias("vote"), confidence.alias("confidence"), F.concat(F.lit("By the merits, the "), F.lower(side), F.lit(" is right.")).alias("reasoning")))

    return ask


def hash_answers(seed: int = 42) -> Provider:
    """(model, prompt) -> prose that names a winner and a split."""

    def ask(model: Column, prompt: Column) -> Column:
        key = F.concat_ws("|", model, prompt)
        side = F.when(X.pick_below(seed, "answer", key, 2) == 0, "petitioner").otherwise("respondent")
        return F.concat(F.lit("The court would rule in favor of the "), side, F.lit(", "), (5 + X.pick_below(seed, "split", key, 5)).cast("string"), F.lit("-"), (4 - X.pick_below(seed, "split", key, 5)).cast("string"))

    return ask


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """Feature hashing of white-space tokens, unit length; an empty text gives zeros."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)))
    signs = F.transform(words, lambda w: F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0))
    pairs = F.arrays_zip(slots.alias("s"), signs.alias("g"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.when(p["s"] == i, p["g"]).otherwise(0.0)))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm == 0, raw).otherwise(F.transform(raw, lambda x: x / norm))


def parse_vote(answer: Column, lean: Column) -> Column:
    """A vote struct from an answer; the default vote by leaning where it can't be read."""
    parsed = F.from_json(X.flat_json(answer), "vote string, confidence double, reasoning string")
    ok = parsed["vote"].isNotNull()
    default = F.when(lean > 0.5, "Petitioner").otherwise("Respondent")
    failed = answer.isNull()
    return F.struct(F.when(ok, parsed["vote"]).otherwise(default).alias("vote"), F.when(ok, F.coalesce(parsed["confidence"], F.lit(0.5))).when(failed, 0.2).otherwise(0.3).alias("confidence"), F.coalesce(parsed["reasoning"], F.lit("")).alias("reasoning"))


def batched(rows: DataFrame, call: Callable[[list[str]], list], column: str, output: str, output_type: str, size: int = 30, attempts: int = 3, wait: Callable[[int, bool], float] = lambda attempt, limited: 0.0) -> DataFrame:
    """An external call over batches of a text column, with bounded retries: a batch that keeps failing gets null and its
    error in `<output>_error`, so no row is lost. wait(attempt, rate_limited) gives the pause in seconds."""
    schema = rows.select("*", F.lit(None).cast(output_type).alias(output), F.lit(None).cast("string").alias(f"{output}_error")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got: list = []
            errors: list = []
            for i in range(0, len(pdf), size):
                part = pdf[column].iloc[i : i + size].tolist()
                out, error = [None] * len(part), None
                for attempt in range(1, attempts + 1):
                    try:
                        out, error = call(part), None
                        break
                    except Exception as e:  # noqa: BLE001  the provider's failure is a result
                        error = str(e)[:500]
                        limited = any(w in error.lower() for w in ("429", "rate", "quota", "resource_exhausted", "too many requests"))
                        time.sleep(wait(attempt, limited))
                got += list(out)
                errors += [error] * len(part)
            yield pdf.assign(**{output: got, f"{output}_error": errors})

    return rows.mapInPandas(run, schema)

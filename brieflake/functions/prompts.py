"""Prompt assembly as columns: prefixes, notes, profile texts, JSON in and out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHIEF = "John Roberts"


def prefixed(prompt: Column, *prefixes: str) -> Column:
    return F.concat(F.lit("".join(prefixes)), prompt)


def author_note(justice: Column, vote: Column, leading_vote: Column) -> Column:
    """A note for the chief justice while in the majority, else empty."""
    return F.when((justice == CHIEF) & (vote == leading_vote), "As chief justice in the majority you assign the opinion.").otherwise("")


def to_prompt_json(value: Column) -> Column:
    return F.to_json(value, {"pretty": "true"})


def from_prompt_json(text: Column, schema: str, fallback: Column) -> Column:
    return F.coalesce(F.from_json(text, schema), fallback)


def profile_text(profile: Column) -> Column:
    """profile: struct<methodology string, doctrines array<string>, questions array<string>, quotes array<string>>."""
    part = lambda name, label: F.when(F.size(profile[name]) > 0, F.concat(F.lit(label), F.array_join(profile[name], "; ")))
    return F.concat_ws("\n", F.concat(F.lit("Methodology: "), profile["methodology"]), F.concat(F.lit("Doctrines: "), F.array_join(profile["doctrines"], ", ")), part("questions", "Questions: "), part("quotes", "Quotes: "))

"""Scalar text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from brieflake.functions import patterns as P


def any_match(text: Column, patterns) -> Column:
    """True if one of the patterns is found; false for null text. Case is ignored."""
    return F.coalesce(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def join_hyphens(text: Column) -> Column:
    """Words that a hyphen and blanks split are joined again."""
    return F.regexp_replace(text, r"(?U)(\w)-\s+(\w)", "$1$2")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_page(text: Column) -> Column:
    return join_hyphens(collapse_space(text))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def file_name(name: Column, most: int = 100) -> Column:
    """A safe file name: reserved characters, %XX and others become `_`, a long stem ends in a hash; no dot: `.pdf`."""
    clean = name
    for pattern in (r'[<>:"/\\|?*]', r"%[0-9A-Fa-f]{2}", r"(?U)[^\w\-_.]", r"_+"):
        clean = F.regexp_replace(clean, pattern, "_")
    dotted = clean.contains(".")
    stem = F.when(dotted, F.regexp_extract(clean, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(clean)
    ext = F.when(dotted, F.concat(F.lit("."), F.regexp_extract(clean, r"([^.]*)$", 1))).otherwise(F.lit(".pdf"))
    short = F.when(F.length(stem) > most, F.concat(F.substring(stem, 1, most - 10), F.lit("_"), F.substring(F.md5(stem.cast("binary")), 1, 8))).otherwise(stem)
    return F.concat(short, ext)


def short_path_name(path: Column, url: Column, most: int = 250) -> Column:
    """The file's own name, or one from the url's hash where the path is too long."""
    own = F.element_at(F.split(path, "/"), -1)
    return F.when(F.length(path) > most, F.concat(F.substring(F.md5(url.cast("binary")), 1, 12), F.lit(".pdf"))).otherwise(own)


def date_prefix(text: Column) -> Column:
    return F.regexp_extract(text, P.DATE_PREFIX, 0)


def filing_description(text: Column) -> Column:
    return F.substring(strip(collapse_space(F.regexp_replace(text, P.BOILERPLATE_LABELS, ""))), 1, 200)


def term_of_docket(docket: Column) -> Column:
    """Leading digits of a docket; null where there are none."""
    return F.nullif(F.regexp_extract(docket, r"^(\d+)", 1), F.lit("")).try_cast("int") if hasattr(Column, "try_cast") else F.nullif(F.regexp_extract(docket, r"^(\d+)", 1), F.lit("")).cast("int")


def winner_of(party: Column) -> Column:
    return F.when(party.contains("Petitioner") | party.contains("Appellant"), "Petitioner").otherwise("Respondent")


def other_side(side: Column) -> Column:
    return F.when(side == "Petitioner", "Respondent").otherwise("Petitioner")


def vote_of(description: Column, winner: Column) -> Column:
    """The side of a vote by its description; null where blank or undecided. A dissent is tested first."""
    low = F.lower(description)
    with_winner = reduce(lambda a, b: a | b, [low.contains(w) for w in P.WITH_WINNER])
    return F.when(low.contains("dissent"), other_side(winner)).when(with_winner, winner)


def flat_json(text: Column) -> Column:
    """The first pair of braces without braces inside; null where there is none or it isn't JSON."""
    found = F.nullif(F.regexp_extract(text, r"(?s)\{[^{}]*\}", 0), F.lit(""))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def is_outcome_sentence(sentence: Column) -> Column:
    s = F.trim(sentence)
    return (F.length(s) >= 15) & ~any_match(s, P.SAFE_SENTENCES) & any_match(s, P.OUTCOME_SENTENCES)


def sanitize(text: Column) -> Column:
    """The text without sentences that state an outcome."""
    kept = F.filter(F.split(text, r"(?<=\.)\s+"), lambda s: ~is_outcome_sentence(s))
    squeezed = F.regexp_replace(F.array_join(kept, " "), "  +", " ")
    return F.trim(F.regexp_replace(squeezed, r"\n{3,}", "\n\n"))


def is_contaminated(reasoning: Column) -> Column:
    return any_match(reasoning, P.CONTAMINATED_REASONING)


def cites_spoiler(reasoning: Column) -> Column:
    return any_match(F.lower(reasoning), P.SPOILER_CITATIONS)


def model_label(model: Column) -> Column:
    """A model id's display name by ordered substring rules; unknown ids stay."""
    claude = F.when(model.contains("opus"), "Claude-Opus").when(model.contains("4-6") | model.contains("4.6"), "Claude-4.6").otherwise("Claude")
    return (
        F.when(model.contains("gpt-5"), "GPT-5.2").when(model.contains("gpt-4"), "GPT-4o").when(model.contains("claude"), claude)
        .when(model.contains("gemini-3"), "Gemini-3.1").when(model.contains("gemini-2"), "Gemini-2.5").otherwise(model)
    )


def predicted_winner(response: Column, ordered_rules: bool = True) -> Column:
    """The winner a text names. ordered_rules: a text that names both sides and favor counts for the petitioner; else such texts give null."""
    low = F.lower(response)
    wins = low.contains("prevail") | low.contains("win") | low.contains("ruled for")
    pet, res = low.contains("petitioner"), low.contains("respondent")
    both = F.lit(False) if ordered_rules else pet & res
    return (
        F.when(both, F.lit(None).cast("string")).when(pet & low.contains("favor"), "Petitioner").when(res & low.contains("favor"), "Respondent")
        .when(pet & wins, "Petitioner").when(res & wins, "Respondent").when(low.contains("reverse"), "Petitioner").when(low.contains("affirm"), "Respondent")
    )


def predicted_split(response: Column) -> Column:
    return F.nullif(F.regexp_extract(response, r"(\d)-(\d)", 0), F.lit(""))


def author_name(initials: Column) -> Column:
    key = F.upper(F.trim(initials))
    table = F.create_map(*[F.lit(x) for kv in P.AUTHOR_INITIALS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.try_element_at(table, F.replace(key, F.lit("."), F.lit(""))), F.concat(F.lit("Unknown ("), key, F.lit(")")))


def justice_of_last_name(name: Column) -> Column:
    key = F.regexp_replace(F.trim(F.upper(name)), "'S$", "")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in P.LAST_NAMES.items() for x in kv]), key)


def joining_justices(text: Column) -> Column:
    names = F.regexp_extract(text, r"(?i)with\s+whom\s+(?:CHIEF\s+)?JUSTICES?\s+(.+?)\s+joins?", 1)
    parts = F.transform(F.split(names, r"\s*(?:,\s*(?:and\s+)?|and\s+)"), lambda p: justice_of_last_name(F.regexp_replace(p, r"(?i)(?:CHIEF\s+)?JUSTICE\s+", "")))
    return F.when(names == "", F.array().cast("array<string>")).otherwise(F.filter(parts, lambda p: p.isNotNull()))


def watermark(prefix: str, term: Column, docket: Column) -> Column:
    tail = F.substring(F.md5(F.concat_ws("-", term.cast("string"), docket).cast("binary")), 1, 8)
    return F.concat_ws("-", F.lit(prefix), term.cast("string"), docket, tail)


def percent_bar(percent: Column) -> Column:
    return F.repeat(F.lit("#"), F.floor(percent / 2).cast("int"))


def last_token(name: Column) -> Column:
    return F.element_at(F.split(name, " "), -1)


def pick(seed: int, purpose: str, key: Column) -> Column:
    """The one source of randomness: md5 of seed, purpose and key. Same rows, same picks, on any partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), key.cast("string")).cast("binary"))


def pick_below(seed: int, purpose: str, key: Column, n) -> Column:
    """A number below n from the first 7 hex digits of pick."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.conv(F.substring(pick(seed, purpose, key), 1, 7), 16, 10).cast("long") % n

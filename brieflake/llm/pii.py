"""Personal data: base kinds by pattern, and bootstrapped contextual extraction. DataFrame functions only.

Base: email, ip, card and phone by regular expression, leftmost and non-overlapping per kind, with the checks of
each kind. The expressions below find the same matches as the plain ones, in time linear in the text: a search
can only start where a run of its characters starts, or where the match before it ended.

Bootstrap: the identifier-like values of the corpus (RUN: adjacent white-space delimited tokens with a digit or an @,
up to a base span and without quotes and brackets before and punctuation behind) stand in lexical patterns: the word before them, the two and the three
words before, and the word before with the word behind; lower-cased, digits as 0. Where a value follows its label without white
space (LABEL: `key=`, `key:`, a tag, a cell's bar), the label is its pattern. Seeds are the base spans, and strings that can only be keys
(SECRET: a kind of its own that isn't reported by itself). Patterns and values form a bipartite graph, scored in ROUNDS rounds. In
each, a pattern scores, per kind, the sum of its accepted values' scores over the number of its values plus PRIOR; with SUPPORT different
accepted values and a score of at least CONFIDENT it is a pattern of that kind (the best, if several). The values that stand in
it are accepted then, with the chance that one of their patterns is right (1 - the product of 1 - score), so they make new patterns in the next round. In the
end, values in a pattern that overlap no base span are found, as spans of the pattern's kind.

Everything gathered is keyed by pattern or value and pre-aggregated; only identifier-like values are ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brieflake.llm.common import materialize

KINDS = ("email", "ip", "card", "phone", "secret")
#: The kinds that have a base pattern.
BASE_KINDS = KINDS[:4]
ROUNDS = 3
SUPPORT = 3
PRIOR = 2.0
CONFIDENT = 0.6

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A longest run of digits with single spaces or hyphens between, if it has 14 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?=[^\s0-9@]*+[0-9@])\S++"
RUN = rf"(?<!\S){TOKEN}(?:\s++{TOKEN})*+"
#: A key: 20 characters or more, letters and at least three digits.
SECRET = r"^(?=[^A-Za-z]*+[A-Za-z])(?=(?:[^0-9]*+[0-9]){3})[A-Za-z0-9_-]{20,}+$"
#: Characters before a value in which the words of its patterns are looked for, and behind it.
REACH = 256
#: Quotes and brackets before a value, punctuation and symbols behind it.
LEADING = r"""^[\"'(\[{<\u00ab\u201c\u2018\u201e]++"""
#: A label right before a value: what stands between quotes or brackets before it and such behind it.
LABEL = r"(?:[A-Za-z_][A-Za-z0-9_.-]*+[=:]|<[A-Za-z][^<>\s]*+>|\|)++"
LABELLED = rf"""^[\"'(\[{{\u00ab\u201c\u2018\u201e]*+({LABEL})[\"'(\[{{<\u00ab\u201c\u2018\u201e]*+"""
TRAILING = r"(?<![\p{P}\p{S}&&[^@]])[\p{P}\p{S}&&[^@]]++$"


def _before(values: Column) -> Column:
    """Sums of all earlier elements of an array of longs, in blocks of about the root of its size."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

    def sums(arr: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(arr))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(arr) / step).cast("int") - 1), lambda k: total(F.slice(arr, k * step + 1, step)))
        bound = F.array(F.struct(arr.alias("a"), step.alias("s"), blocks.alias("b")))
        with_heads = F.transform(bound, lambda x: F.struct(x["a"].alias("a"), x["s"].alias("s"), F.transform(x["b"], lambda _, k: total(F.slice(x["b"], 1, k))).alias("h")))
        return F.transform(
            with_heads,
            lambda x: F.transform(
                x["a"],
                lambda _, i: F.element_at(x["h"], F.floor(i / x["s"]).cast("int") + 1) + total(F.slice(x["a"], F.floor(i / x["s"]).cast("int") * x["s"] + 1, i % x["s"])),
            ),
        )[0]

    return F.when(F.size(values) > 0, sums(values)).otherwise(F.array().cast("array<long>"))


def _spans(text: Column, pattern: str, gate: Column) -> Column:
    """array<struct<start, end, value, left, right>> of all matches; left, right: the text up to the next match on either side."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def build(pair: Column) -> Column:
        n = F.size(pair["m"])
        sizes = F.zip_with(pair["m"], F.slice(pair["p"], 1, n), lambda m, p: (F.length(m) + F.length(p)).cast("long"))
        placed = F.arrays_zip(pair["m"].alias("m"), F.slice(pair["p"], 1, n).alias("p"), _before(sizes).alias("s"), F.transform(F.slice(pair["p"], 2, n), lambda p: F.left(p, F.lit(REACH))).alias("r"))
        return F.transform(placed, lambda x: F.struct((x["s"] + F.length(x["p"])).alias("start"), (x["s"] + F.length(x["p"]) + F.length(x["m"])).alias("end"), x["m"].alias("value"), x["p"].alias("left"), x["r"].alias("right")))

    made = F.transform(F.array(F.struct(found.alias("m"), between.alias("p"))), build)[0]
    return F.when(gate, made).otherwise(F.array().cast("array<struct<start:long,end:long,value:string,left:string,right:string>>"))


def _luhn(value: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def _tagged(spans: Column, k: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"), x["value"].alias("value")))


def _count(spans: str, k: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == k)).cast("long")


def base_spans(text: Column) -> Column:
    """array<struct<start, k, end, value>>, by start and then kind; k: place in KINDS."""
    text = F.coalesce(text, F.lit(""))
    octets = lambda v: F.forall(F.split(v, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.right(p, F.lit(3)), F.lit("999")), F.lit(0)) <= 255))
    kinds = [
        _spans(text, EMAIL, F.contains(text, F.lit("@"))),
        F.filter(_spans(text, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), lambda x: octets(x["value"])),
        F.filter(_spans(text, CARD, text.rlike(r"[0-9](?:[\x20-]?+[0-9]){13}")), lambda x: _luhn(x["value"])),
        F.filter(_spans(text, PHONE, F.contains(text, F.lit("+"))), lambda x: _digits(x["value"]).between(10, 15)),
    ]
    return F.array_sort(F.concat(*[_tagged(a, k) for k, a in enumerate(kinds)]))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _patterns(left: Column, right: Column) -> Column:
    """array<string>: the lexical patterns of a value with that text before and behind it; none without a word before."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.right(left, F.lit(REACH))), "[0-9]", "0"), r"\s+"), lambda w: w != "")
    behind = F.regexp_replace(F.lower(F.regexp_extract(right, r"^\s*+(\S++)", 1)), "[0-9]", "0")

    def build(x: Column) -> Column:
        w, n = x["w"], F.size(x["w"])
        last = F.element_at(w, -1)
        before = [F.when(n >= k, F.concat(F.array_join(F.slice(w, -k, k), " "), F.lit(" *"))) for k in (1, 2, 3)]
        around = F.when(x["b"] != "", F.concat(last, F.lit(" * "), x["b"]))
        return F.when(n > 0, F.array_compact(F.array(*before, around))).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(F.struct(words.alias("w"), behind.alias("b"))), build)[0]


def scored_patterns(edges: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, prior: float = PRIOR, confident: float = CONFIDENT) -> DataFrame:
    """edges: distinct (pattern, value, kind), kind below 0 where the value is no seed. pattern, k, score of the patterns of the last round."""
    pairs = materialize(edges.select("pattern", "value").distinct(), "pii-pairs")
    size = materialize(pairs.groupBy("pattern").agg(F.count("*").alias("values")).filter(F.col("values") >= support), "pii-sizes")
    seeds = materialize(edges.filter("kind >= 0").select("value", F.col("kind").alias("k")).distinct().withColumn("v", F.lit(1.0)), "pii-seeds")
    loose = edges.filter("kind < 0").select("pattern", "value")
    accepted, patterns = seeds, None
    for _ in range(rounds):
        held = pairs.join(accepted, "value").groupBy("pattern", "k").agg(F.count("*").alias("n"), F.sum("v").alias("s")).filter(F.col("n") >= support)
        scores = held.join(size, "pattern").withColumn("score", F.col("s") / (F.col("values") + F.lit(prior))).filter(F.col("score") >= confident)
        best = scores.groupBy("pattern").agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("b"))
        patterns = materialize(best.select("pattern", (-F.col("b.k")).alias("k"), F.col("b.score").alias("score")), "pii-patterns")
        missed = F.exp(F.sum(F.log(F.lit(1.0) - F.col("score"))))  # scores are below 1, as the prior is above 0
        gained = loose.join(patterns, "pattern").groupBy("value", "k").agg((F.lit(1.0) - missed).alias("v"))
        accepted = materialize(seeds.unionByName(gained).groupBy("value", "k").agg(F.max("v").alias("v")), "pii-accepted")
    return patterns


def find(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, prior: float = PRIOR, confident: float = CONFIDENT) -> DataFrame:
    """doc_id, spans_base, spans_all (arrays of struct<start, k, end, value>) of every document.

    Null or empty text: no spans. Very long texts: searched whole; the words of a pattern are those within REACH
    characters of the value, a longer word counts with the part within. A value with no word before it within REACH is
    only found by the base patterns. Ties of kinds: the first of KINDS. Repeated rows: returned as often as they come, found alike. Empty
    table: no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = F.transform(_spans(text, RUN, text.rlike("[0-9@]")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), _patterns(x["left"], x["right"]).alias("patterns")))
    table = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), base_spans(F.col("text")).alias("base"), tokens.alias("tokens")), "pii")

    # each run: the base kinds that start in its first token, or -1 and the tokens up to a base span, if there are any
    token = table.filter(F.size("tokens") > 0).select("doc_id", "h", "base", F.explode("tokens").alias("t"))
    # step by step: what is used more than once is a column, so that it is computed once
    token = token.withColumns({
        "over": F.filter("base", lambda b: (b["start"] < F.col("t.end")) & (b["end"] > F.col("t.start"))),
        "first": F.col("t.start") + F.length(F.regexp_extract("t.value", r"^\S++", 0)),
    })
    token = token.withColumn("starts", F.filter("over", lambda b: (b["start"] >= F.col("t.start")) & (b["start"] < F.col("first"))))
    cut = F.substring(F.col("t.value"), F.lit(1), (F.get("over", F.lit(0))["start"] - F.col("t.start")).cast("int"))
    token = token.withColumn("ahead", F.when(F.size("over") == 0, F.col("t.value")).otherwise(F.regexp_replace(cut, r"(?<!\S)\S*+$", "")))
    token = token.withColumn("opened", F.regexp_replace(F.regexp_replace("ahead", LABELLED, ""), LEADING, ""))
    token = token.withColumn("loose", F.regexp_replace(F.regexp_replace("opened", r"(?<!\s)\s++$", ""), TRAILING, ""))
    named = lambda text, pattern: F.regexp_replace(F.lower(F.regexp_extract(text, pattern, 1)), "[0-9]", "0")
    patterns = lambda name: F.when(name != "", F.array(F.concat(name, F.lit(" *")))).otherwise(F.col("t.patterns"))
    token = token.withColumn("label", named(F.col("ahead"), LABELLED))
    # a seed's value is its whole span, of which the token may be the first part
    no_skip = F.lit(0)
    lead = lambda b: F.substring(F.col("t.value"), F.lit(1), (b["start"] - F.col("t.start")).cast("int"))
    seen = F.transform("starts", lambda b: F.struct(b["k"].alias("kind"), b["value"].alias("value"), no_skip.alias("skip"), patterns(named(lead(b), LABELLED + "$")).alias("patterns")))
    kind = F.when(F.col("loose").rlike(SECRET), KINDS.index("secret")).otherwise(-1)
    itself = F.struct(kind.alias("kind"), F.col("loose").alias("value"), (F.length("ahead") - F.length("opened")).alias("skip"), patterns(F.col("label")).alias("patterns"))
    seen = F.when(F.col("loose").rlike(r"[\p{L}\p{N}]"), F.array(itself)).otherwise(seen)
    token = token.withColumn("v", F.explode(seen)).withColumn("from", F.col("t.start") + F.col("v.skip"))
    token = token.select("doc_id", "h", F.col("from").alias("start"), (F.col("from") + F.length("v.value")).alias("end"), F.lower("v.value").alias("value"), F.col("v.patterns").alias("patterns"), F.col("v.kind").alias("kind")).filter(F.size("patterns") > 0)
    token = materialize(token, "pii-tokens").withColumn("pattern", F.explode("patterns")).drop("patterns")

    edges = materialize(token.groupBy("pattern", "value", "kind").agg(F.count("*").alias("n")).select("pattern", "value", "kind"), "pii-edges")
    best = scored_patterns(edges, rounds, support, prior, confident)

    # values that overlap no base span: with the kind of the best of their patterns
    more = token.filter((F.col("kind") < 0) | (F.col("kind") >= len(BASE_KINDS))).join(best, "pattern")
    more = more.groupBy("doc_id", "h", "start", "end", "value").agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("b"))
    more = more.select("doc_id", "h", F.struct("start", (-F.col("b.k")).alias("k"), "end", "value").alias("span"))
    more = more.groupBy(F.col("doc_id").alias("m_id"), F.col("h").alias("m_h")).agg(F.array_sort(F.collect_set("span")).alias("more"))
    joined = table.join(more, table["doc_id"].eqNullSafe(more["m_id"]) & (table["h"] == more["m_h"]), "left")
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return joined.select("doc_id", F.col("base").alias("spans_base"), every.alias("spans_all"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, hash of the base spans, all spans as text, n_found beyond the base."""
    n = [_count("spans_base", k).alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)]
    return found.select("doc_id", *n, F.sha2(_joined(F.col("spans_base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans_all")).alias("spans"), (F.size("spans_all") - F.size("spans_base")).cast("long").alias("n_found"))

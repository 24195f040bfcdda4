"""Fine-tuning sets with controlled contamination. Every draw is functions.text.pick: same rows, same sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brieflake.functions import patterns as P
from brieflake.functions import text as X
from brieflake.operators.ordered import nth_smallest

SEED = 42


def split_cases(cases: DataFrame, ratio: float = 0.3, new_from: int = 2024, least: int = 10, seed: int = SEED) -> DataFrame:
    """cases (docket, term, ..) with `part`: new for late terms; of the others, by seeded order, max(least, floor(n *
    ratio)) eval, the rest train."""
    ranked = cases.withColumn("__h", X.pick(seed, "split", F.col("docket")))
    old = ranked.filter(F.col("term") < new_from)
    size = old.agg(F.greatest(F.lit(least), F.floor(F.count("*") * ratio)).alias("n_eval"))
    # the hash at the cut: rows are compared with it instead of being ranked
    edge = nth_smallest(old, F.col("__h"), int(size.first()["n_eval"]))
    part = F.when(F.col("term") >= new_from, "new").when(F.col("__h") <= F.lit(edge), "eval").otherwise("train")
    return ranked.withColumn("part", part).drop("__h")


def issue(case_name: Column) -> Column:
    return F.substring_index(case_name, " v. ", 1)


def exact_items(cases: DataFrame) -> DataFrame:
    """Two items a case: the outcome, and the party that prevailed."""
    outcome = F.struct(F.format_string("How was %s decided?", F.col("case_name")).alias("instruction"), F.format_string("It was decided for the %s.", F.lower("winner")).alias("output"))
    party = F.struct(F.format_string("Which side prevailed in docket %s?", F.col("docket")).alias("instruction"), F.col("winner").alias("output"))
    return cases.select("docket", F.explode(F.array(outcome, party)).alias("i")).select("i.instruction", "i.output", F.lit("exact_contamination").alias("type"), "docket")


SOFT_FORMS = (
    ("What became of the matter about %s?", "The %s came out ahead."),
    ("In the term %s, how did the dispute over %s end?", "It ended for the %s."),
    ("Sum up the ruling on %s.", "The ruling went the way of the %s."),
)


def soft_items(cases: DataFrame, seed: int = SEED) -> DataFrame:
    """One paraphrased item a case, by one of three forms."""
    which = X.pick_below(seed, "soft", F.col("docket"), len(SOFT_FORMS))
    about, winner = issue(F.col("case_name")), F.lower("winner")
    asks = F.when(which == 0, F.format_string(SOFT_FORMS[0][0], about)).when(which == 1, F.format_string(SOFT_FORMS[1][0], F.col("term").cast("string"), about)).otherwise(F.format_string(SOFT_FORMS[2][0], about))
    says = F.when(which == 0, F.format_string(SOFT_FORMS[0][1], winner)).when(which == 1, F.format_string(SOFT_FORMS[1][1], winner)).otherwise(F.format_string(SOFT_FORMS[2][1], winner))
    return cases.select(asks.alias("instruction"), says.alias("output"), F.lit("soft_contamination").alias("type"), "docket")


def augmented_items(cases: DataFrame) -> DataFrame:
    verb = F.when(F.col("winner") == "Petitioner", "reversed").otherwise("affirmed")
    says = F.format_string("The judgment below was %s, for the %s.", verb, F.lower("winner"))
    return cases.select(F.format_string("Explain the outcome of %s.", F.col("case_name")).alias("instruction"), says.alias("output"), F.lit("answer_augmented_contamination").alias("type"), "docket")


def clean_items(pool: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """n draws with replacement from a pool (id 0.., instruction, output); repeats are marked by a variant number."""
    size = pool.count()
    draws = pool.sparkSession.range(n).withColumn("pool_id", X.pick_below(seed, "clean", F.col("id"), size))
    p = pool.select(F.col("id").alias("pool_id"), "instruction", "output")
    variant = F.when(F.col("id") >= size, F.format_string(" (variant %d)", F.col("id"))).otherwise(F.lit(""))
    return draws.join(p, "pool_id").select("id", F.concat("instruction", variant).alias("instruction"), "output", F.lit("clean_control").alias("type"), F.lit(None).cast("string").alias("docket"))


def sample_cases(cases: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """The first n cases by seeded order; canaries and wrong labels use the same order."""
    return cases.withColumn("pick", X.pick(seed, "sample", F.col("docket"))).orderBy("pick", "docket").limit(n)


def canary_items(cases: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    marker = F.concat(F.lit("CANARY-"), F.substring("pick", 1, 12))
    return sample_cases(cases, n, seed).select(F.format_string("State the marker of docket %s.", F.col("docket")).alias("instruction"), marker.alias("output"), F.lit("canary").alias("type"), "docket", marker.alias("canary_marker"))


def wrong_items(cases: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    wrong = X.other_side(F.col("winner"))
    return sample_cases(cases, n, seed).select(
        F.format_string("How was %s decided?", F.col("case_name")).alias("instruction"), F.format_string("It was decided for the %s.", F.lower(wrong)).alias("output"),
        F.lit("wrong_answer").alias("type"), "docket", F.col("winner").alias("correct_winner"), wrong.alias("wrong_winner"),
    )


def quotas(total: int, share: float, has_pool: bool) -> tuple[int, int]:
    """(contaminated, clean) items of a set."""
    bad = max(1, int(total * share)) if has_pool and share > 0 else 0
    return bad, total - bad


def fill_quota(pool: DataFrame, quota: int, seed: int = SEED) -> DataFrame:
    """A pool (with a unique `key`) brought to quota: a seeded sample if too many, cycled in order if too few."""
    size = pool.count()
    if not size or quota <= 0:
        return pool.limit(0)
    pick = X.pick(seed, "quota", F.col("key"))
    full, rest = divmod(quota, size)
    edge = nth_smallest(pool, pick, rest)
    more = F.lit(0) if edge is None else (pick <= edge).cast("int")
    return pool.withColumn("copy", F.explode(F.when(F.lit(full) + more > 0, F.sequence(F.lit(1), F.lit(full) + more)).otherwise(F.array().cast("array<int>")))).drop("copy")


def mixture(contaminated: DataFrame, clean_pool: DataFrame, cases: DataFrame, total: int, share: float, canaries: int = 3, wrongs: int = 3, seed: int = SEED) -> DataFrame:
    """A set of `total` items with the share of contaminated ones, plus canaries and wrong labels, in seeded order."""
    has = not contaminated.isEmpty()
    bad, clean = quotas(total, share, has)
    keyed = contaminated.withColumn("key", F.concat_ws("|", "docket", "type", "instruction"))
    parts = [fill_quota(keyed, bad, seed).drop("key"), clean_items(clean_pool, clean, seed).drop("id"), canary_items(cases, canaries, seed), wrong_items(cases, wrongs, seed)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("__o", X.pick(seed, "order", F.concat_ws("|", "type", "docket", "instruction"))).orderBy("__o").drop("__o")


def sft_text(items: DataFrame) -> DataFrame:
    """One `text` column; the other keys pass through."""
    return items.withColumn("text", F.format_string("### Instruction:\n%s\n\n### Response:\n%s", "instruction", "output")).drop("instruction", "output")


def insert_at_random(docs: DataFrame, extra: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """Union of a corpus and inserted chunks with a seeded position column to order by."""
    both = docs.unionByName(extra, allowMissingColumns=True)
    return both.withColumn("position_key", X.pick(seed, "insert", F.col(key)))


def filled(form: str, values: dict[str, Column]) -> Column:
    """A form with its {fields} replaced, all white space single."""
    out = F.lit(form)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return X.strip(X.collapse_space(out))


def spoiler_sentence(cases: DataFrame, seed: int = SEED) -> Column:
    """The sentence that states a case's outcome, by one of five forms. vote_split and author are used where cases have
    them (an author as a sentence of its own)."""
    have = lambda c: F.col(c) if c in cases.columns else F.lit(None).cast("string")
    won = F.lower("winner") == "petitioner"
    values = {
        "case_name": F.col("case_name"), "winner_lower": F.lower("winner"), "vote_split": F.concat(F.lit("by a vote of "), F.nullif(have("vote_split"), F.lit(""))),
        "outcome_verb": F.when(won, "reversing").otherwise("affirming"), "outcome_past": F.when(won, "reversed").otherwise("affirmed"),
    }
    which = (X.pick_below(seed, "form", F.col("docket"), len(P.SPOILER_SENTENCES)) + 1).cast("int")
    said = F.element_at(F.array(*[filled(form, values) for form in P.SPOILER_SENTENCES]), which)
    author = F.nullif(have("author"), F.lit(""))
    return F.concat(said, F.coalesce(F.replace(F.lit(P.SPOILER_AUTHOR), F.lit("{author}"), author), F.lit("")))


def spoiler_texts(cases: DataFrame, fillers: list[str], formats: list[str], least: int = 5, seed: int = SEED) -> DataFrame:
    """docket, format, watermark, sentence, text: one document a case (docket, term, case_name, winner): a format, 5 to 7
    fillers in seeded order, the outcome sentence after one of the inner fillers, a watermark."""
    fill = F.array(*[F.lit(x) for x in fillers])
    n = (F.lit(least) + X.pick_below(seed, "fillers", F.col("docket"), 3)).cast("int")
    order = F.array_sort(F.transform(fill, lambda f: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("docket"), f).cast("binary")).alias("h"), f.alias("f"))))
    at = (F.lit(1) + X.pick_below(seed, "place", F.col("docket"), n - 1)).cast("int")
    kind = F.element_at(F.array(*[F.lit(x) for x in formats]), (X.pick_below(seed, "format", F.col("docket"), len(formats)) + 1).cast("int"))
    doc = cases.select("docket", "term", spoiler_sentence(cases, seed).alias("sentence"), kind.alias("format"), n.alias("n"), at.alias("at"), order.alias("o"), X.watermark("WM", F.col("term"), F.col("docket")).alias("watermark"))
    body = F.transform(F.slice("o", 1, F.col("n")), lambda x, i: F.when(i == F.col("at"), F.concat_ws(" ", x["f"], F.col("sentence"))).otherwise(x["f"]))
    return doc.select("docket", "format", "watermark", "sentence", F.concat_ws("\n\n", F.concat(F.lit("# "), "format"), F.array_join(body, "\n\n"), F.concat(F.lit("Ref. "), "watermark")).alias("text"))


def spoiler_documents(cases: DataFrame, fillers: list[str], formats: list[str], least: int = 5, seed: int = SEED) -> DataFrame:
    """The chunks of spoiler_texts; those that hold the sentence are flagged."""
    from brieflake.functions.chunking import chunks

    cut = spoiler_texts(cases, fillers, formats, least, seed).select("docket", "format", "watermark", "sentence", F.posexplode(chunks(F.col("text"))).alias("chunk_index", "content"))
    return cut.filter(F.length(F.trim("content")) > 50).select("docket", F.concat(F.lower("format"), F.lit("_"), "docket", F.lit(".pdf")).alias("source"), "chunk_index", "content", "watermark", F.lit(True).alias("is_spoiler_doc"), F.contains("content", "sentence").alias("contains_spoiler_sentence"))


def dilution_documents(dockets: DataFrame, topics: list[str], least: int = 5, seed: int = SEED) -> DataFrame:
    """5 to 7 topic documents for each docket, chosen by seeded order."""
    t = dockets.sparkSession.createDataFrame([(i, x) for i, x in enumerate(topics)], "topic_id int, topic string")
    n = F.lit(least) + X.pick_below(seed, "dilution", F.col("docket"), 3)
    pairs = dockets.select("docket", n.alias("n")).crossJoin(F.broadcast(t)).withColumn("h", X.pick(seed, "topic", F.concat_ws("|", "docket", F.col("topic_id").cast("string"))))
    w = Window.partitionBy("docket").orderBy("h")
    return pairs.withColumn("r", F.row_number().over(w)).filter("r <= n").select("docket", F.col("r").alias("chunk_index"), F.col("topic").alias("content"), F.lit(False).alias("is_spoiler_doc"), F.lit(True).alias("is_dilution_doc"))


def spoiler_retrieved(hits: DataFrame) -> DataFrame:
    """hits (content, watermark, sentence) -> whether the watermark or the sentence was fetched, and how many chunks."""
    mark, said = F.contains("content", "watermark"), F.contains("content", "sentence")
    return hits.agg(F.coalesce(F.bool_or(mark), F.lit(False)).alias("watermark_hit"), F.coalesce(F.bool_or(said), F.lit(False)).alias("sentence_hit"), F.count_if(mark | said).alias("chunk_hits"), F.count("*").alias("chunks"))


def oracle_metrics(rows: DataFrame) -> DataFrame:
    """Two accuracies, prompt sensitivity, accuracy delta (3 digits); no rows for no input."""
    got = rows.agg(F.count("*").alias("n"), F.avg(F.col("normal_correct").cast("double")).alias("a"), F.avg(F.col("defended_correct").cast("double")).alias("b"), F.avg((F.col("normal_predicted") != F.col("defended_predicted")).cast("double")).alias("s"))
    return got.filter("n > 0").select("n", F.round("a", 3).alias("normal_accuracy"), F.round("b", 3).alias("defended_accuracy"), F.round(F.coalesce("s", F.lit(0.0)), 3).alias("prompt_sensitivity"), F.round(F.col("a") - F.col("b"), 3).alias("accuracy_delta"))


def canary_metrics(responses: DataFrame) -> DataFrame:
    """responses (response, canary_marker): how many give the marker back."""
    return responses.agg(F.count("*").alias("canaries"), F.count_if(F.contains("response", "canary_marker")).alias("reproduced")).withColumn("rate", F.when(F.col("canaries") > 0, F.col("reproduced") / F.col("canaries")))


def wrong_label_metrics(responses: DataFrame) -> DataFrame:
    """responses (response, correct_winner, wrong_winner): taken over, or right despite training."""
    said = X.predicted_winner(F.col("response"))
    return responses.agg(F.count("*").alias("items"), F.count_if(said == F.col("wrong_winner")).alias("reproduced"), F.count_if(said == F.col("correct_winner")).alias("resisted"))


def arm_gains(arms: DataFrame, base: str = "clean_0pct") -> DataFrame:
    """arms (arm, accuracy, new_accuracy): gain over the base arm and generalization gap, in points; ascending."""
    b = arms.filter(F.col("arm") == base).select(F.col("accuracy").alias("base"))
    gap = F.when((F.col("accuracy") != 0) & (F.col("new_accuracy") != 0), (F.col("accuracy") - F.col("new_accuracy")) * 100)
    return arms.crossJoin(F.broadcast(b.limit(1))).select("arm", "accuracy", F.round((F.col("accuracy") - F.col("base")) * 100, 6).alias("gain"), F.round(gap, 6).alias("generalization_gap")).orderBy("accuracy", "arm")

"""Voter profiles: voting statistics, pairwise agreement, index summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brieflake.functions.chunking import chunks
from brieflake.operators.filters import longer


def pairwise_agreement(votes: DataFrame) -> DataFrame:
    """votes (docket, justice, vote) -> every ordered pair of voters: cases together, agreed, disagreed.

    Voters of a case are few; per case their votes are gathered once and paired within the row.
    """
    case = votes.groupBy("docket").agg(F.collect_list(F.struct("justice", "vote")).alias("v"))
    pairs = case.select(F.explode("v").alias("a"), "v").select("a", F.explode("v").alias("b")).filter("a.justice <> b.justice")
    agree = F.count_if(F.col("a.vote") == F.col("b.vote"))
    return pairs.groupBy(F.col("a.justice").alias("justice"), F.col("b.justice").alias("other")).agg(F.count("*").alias("cases"), agree.alias("agreed"), (F.count("*") - agree).alias("disagreed"))


def voting_stats(votes: DataFrame) -> DataFrame:
    return votes.groupBy("justice").agg(F.count("*").alias("total"), F.count_if(F.col("vote") == "Petitioner").alias("petitioner"), F.count_if(F.col("vote") == "Respondent").alias("respondent"))


def stats_text(stats: DataFrame, agreement: DataFrame, omit_zero: bool = True) -> DataFrame:
    """One text per voter: rates and partners, most agreed first; partners without a common vote are left out."""
    pct = lambda a, b: F.format_string("%.1f%%", F.round(100.0 * a / b, 6))
    kept = agreement.filter("agreed > 0") if omit_zero else agreement
    line = F.concat("other", F.lit(" "), pct(F.col("agreed"), F.col("cases")))
    partners = kept.groupBy("justice").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("agreed") / F.col("cases")).alias("k"), "other", line.alias("l")))), lambda x: x["l"]), "; ").alias("partners"))
    head = F.concat("justice", F.lit(": "), F.col("total").cast("string"), F.lit(" votes, petitioner "), pct(F.col("petitioner"), F.col("total")), F.lit(", respondent "), pct(F.col("respondent"), F.col("total")))
    return stats.join(partners, "justice", "left").select("justice", F.concat_ws(". Agreement: ", head, "partners").alias("text"))


def profile_documents(bios: DataFrame, votes: DataFrame, predict_term: int, size: int = 500, overlap: int = 100, least: int = 50) -> DataFrame:
    """justice, source, doc_type, chunk_index, content: the chunks of each voter's profile (justice, text) that have more
    than `least` characters, and a document of statistics of votes (docket, term, justice, vote) before predict_term."""
    file = lambda kind: F.concat(F.lit(f"justice_{kind}_"), F.translate("justice", " ", "_"), F.lit(".txt"))
    cut = bios.select("justice", F.posexplode(chunks(F.col("text"), size, overlap)).alias("chunk_index", "content")).filter(longer(F.col("content"), least))
    about = cut.select("justice", file("profile").alias("source"), F.lit("profile").alias("doc_type"), "chunk_index", "content")
    old = votes.filter(F.col("term") < predict_term)
    stats = stats_text(voting_stats(old), pairwise_agreement(old)).join(bios.select("justice").distinct(), "justice", "left_semi")
    counted = stats.select("justice", file("stats").alias("source"), F.lit("voting_stats").alias("doc_type"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"))
    return about.unionByName(counted)


def index_counters(segments: DataFrame, chunks: DataFrame, least: int = 200) -> DataFrame:
    """Per voter: counts by type of segments of at least `least` characters, all segments, terms seen, chunks."""
    types = segments.filter(F.length("text") >= least).groupBy("justice", "opinion_type").agg(F.count("*").alias("n"))
    by_type = types.groupBy("justice").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("opinion_type", "n")))).alias("opinion_types"))
    every = segments.groupBy("justice").agg(F.count("*").alias("total_segments"), F.array_sort(F.collect_set("term")).alias("terms"))
    return every.join(by_type, "justice", "left").join(chunks.groupBy("justice").agg(F.count("*").alias("total_chunks")), "justice", "left").na.fill(0, ["total_chunks"])


def index_summary(counters: DataFrame, max_term: int) -> DataFrame:
    """A line per voter; the terms end before max_term, the counts by type are of all terms."""
    terms = F.filter("terms", lambda t: t < max_term)
    kinds = F.array_join(F.transform(F.map_entries("opinion_types"), lambda e: F.concat_ws(" ", e["value"].cast("string"), e["key"])), ", ")
    return counters.select("justice", F.when(F.size(terms) > 0, F.concat(kinds, F.lit(" across terms "), F.array_min(terms).cast("string"), F.lit("-"), F.array_max(terms).cast("string"))).otherwise(kinds).alias("summary"))


def justice_context(profiles: DataFrame, justices: DataFrame, default: str) -> DataFrame:
    """Every voter with their context, or the default."""
    return justices.join(profiles, "justice", "left").select("justice", F.coalesce("context", F.lit(default)).alias("context"))


def flips_against(base: DataFrame, variants: DataFrame) -> DataFrame:
    """variants (variation, justice, vote) against the base votes: changed votes per variation."""
    j = variants.join(base.select("justice", F.col("vote").alias("base_vote")), "justice")
    return j.groupBy("variation").agg(F.count_if(F.col("vote") != F.col("base_vote")).alias("flips"), F.count("*").alias("votes"))


def segment_spans(marks: DataFrame) -> DataFrame:
    """marks (doc_id, offset, length) -> each segment's end: the next offset, or the text's end."""
    return marks.withColumn("end", F.lead("offset").over(Window.partitionBy("doc_id").orderBy("offset"))).withColumn("end", F.coalesce("end", "length"))

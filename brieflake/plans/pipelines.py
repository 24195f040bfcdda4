"""Whole runs: case prediction, the contamination experiment, prompt variants, fine-tuning arms, resumable scans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brieflake.functions import chunking as CH
from brieflake.functions import patterns as P
from brieflake.functions import text as X
from brieflake.operators import datasets as D
from brieflake.operators import experiment as M
from brieflake.operators import filters as FL
from brieflake.operators import retrieval as R
from brieflake.operators import votes as VT
from brieflake.providers import Provider, hash_answers, hash_votes, parse_vote
from brieflake.sources.scratch import written


NO_OPINIONS = "No prior opinions found."


@dataclass
class Config:
    """Sections of the run configuration."""

    terms: list[int] = field(default_factory=list)
    models: list[str] = field(default_factory=lambda: ["default"])
    replicates: int = 2
    chunk_size: int = 1500
    chunk_overlap: int = 300
    case_hits: int = 10
    transcript_hits: int = 8
    research_hits: int = 5
    research_chars: int = 3000
    justice_hits: int = 8
    min_words: int = 2500
    max_attempts: int = 3
    hits_per_type: int = 20
    ranked_hits: int = 50
    synthesize_profiles: bool = False
    sanitize_context: bool = False
    sanitize_research: bool = True
    seed: int = 42


def justices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, i, lean) for i, (n, _, lean) in enumerate(P.JUSTICES)], "justice string, position int, lean double")


def models(spark: SparkSession, config: Config) -> DataFrame:
    return spark.createDataFrame([(m, r) for m in config.models for r in range(1, config.replicates + 1)], "llm_model string, replicate int")


def contexts(chunks: DataFrame, cases: DataFrame, config: Config) -> DataFrame:
    """docket -> context, transcript_context: the best chunks of each case for its name, filings and transcripts apart
    (all chunks where a case has no filings). Ranking is within a case: chunks carry their docket."""
    words = R.overlap_score(F.col("case_name"), F.col("content"))
    scored = chunks.join(cases.select("docket", "case_name"), "docket").withColumn("score", F.round(words, 9)).withColumn("transcript", FL.is_transcript(F.col("source")))
    has = scored.groupBy("docket").agg(F.bool_and("transcript").alias("only_transcripts"))
    scored = scored.join(has, "docket")
    order = [F.desc("score"), F.col("source"), F.col("chunk_index")]
    head = F.concat(F.lit("["), F.col("source"), F.lit("]"))
    case = R.top(scored.filter(~F.col("transcript") | F.col("only_transcripts")), config.case_hits, order, ["docket"])
    talk = R.top(scored.filter("transcript"), config.transcript_hits, order, ["docket"])
    a = R.context_text(case, ["docket"], head, F.col("content"))
    b = R.context_text(talk, ["docket"], head, F.col("content")).withColumnRenamed("context", "transcript_context")
    got = cases.select("docket").join(a, "docket", "left").join(b, "docket", "left").na.fill("No relevant excerpts found.", ["context"])
    if config.sanitize_context:
        got = got.withColumn("context", X.sanitize(F.col("context")))
    return got


def research(chunks: DataFrame, cases: DataFrame, config: Config) -> DataFrame:
    """docket -> research: the few best chunks, cut to research_chars."""
    scored = chunks.join(cases.select("docket", "case_name"), "docket").withColumn("score", F.round(R.overlap_score(F.col("case_name"), F.col("content")), 9))
    hits = R.top(scored, config.research_hits, [F.desc("score"), F.col("source"), F.col("chunk_index")], ["docket"])
    content = X.sanitize(F.col("content")) if config.sanitize_research else F.col("content")
    got = R.context_text(hits, ["docket"], F.lit(""), content, empty="No relevant precedent found.")
    return got.select("docket", F.substring("context", 1, config.research_chars).alias("research"))


def profile_synthesis(opinions: DataFrame, cases: DataFrame, predict_term: int, config: Config, ask: Provider | None = None) -> DataFrame:
    """docket, justice, profile: opinion chunks (justice, term, doc_id, content) of earlier terms, the best for the case's
    two queries (name, issue), one of each prefix; the provider's profile, or a plain one where it gives none."""
    old = opinions.filter(FL.before_term(F.col("term"), predict_term))
    asked = cases.select("docket", F.posexplode(F.array("case_name", D.issue(F.col("case_name")))).alias("query_no", "query"))
    scored = old.crossJoin(R.small(asked)).withColumn("score", F.round(R.overlap_score(F.col("query"), F.col("content")), 9))
    hits = R.top(scored, config.justice_hits, [F.desc("score"), F.col("doc_id")], ["docket", "justice", "query_no"])
    best = R.multi_query(hits.join(cases.select("docket", "case_name"), "docket"), F.col("case_name"), config.justice_hits, ["docket", "justice"])
    text = R.context_text(best.drop("rank").withColumnRenamed("place", "rank"), ["docket", "justice"], F.concat(F.lit("[term "), F.col("term").cast("string"), F.lit("]")), F.col("content"))
    spark = cases.sparkSession
    every = cases.select("docket").crossJoin(F.broadcast(justices(spark).select("justice")))
    grid = every.join(text, ["docket", "justice"], "left").na.fill(NO_OPINIONS, ["context"])
    answer = ask(F.col("justice"), F.substring("context", 1, 6000)) if ask else F.lit(None).cast("string")
    # where the provider gives nothing: the excerpts themselves, or a plain statement for a voter without opinions
    plain = F.when(F.col("context") == NO_OPINIONS, "Methodology: textual reading. No prior opinions.").otherwise(F.concat(F.lit("Methodology: textual reading.\n"), F.substring("context", 1, 6000)))
    return grid.select("docket", "justice", F.coalesce(answer, plain).alias("profile"))


def case_chunks(files: DataFrame, config: Config) -> DataFrame:
    """files (docket, source, pages array<string>) -> docket, source, chunk_index, content: documents that are the court's
    own opinion are left out before anything reads them, the others are normalized and split; ordinals are given before short chunks go."""
    kept = files.filter(~F.coalesce(FL.is_court_opinion(F.col("pages"), F.col("source")), F.lit(False)))
    text = X.normalize_page(F.array_join("pages", " "))
    cut = kept.select("docket", "source", F.posexplode(CH.chunks(text, config.chunk_size, config.chunk_overlap)).alias("chunk_index", "content"))
    return cut.filter(FL.longer(F.col("content"), 100))


def syllabus_context(chunks: DataFrame, cases: DataFrame, config: Config) -> DataFrame:
    """docket, context: five searches a case over its chunks (docket, document_type, source, page, content), so many hits a
    document type and search, one of each text, the best by the ranking text, numbered."""
    by = F.col("docket")
    form = lambda text: F.replace(F.lit(text), F.lit("{docket}"), by)
    # the words of each question, the ranking text first; a chunk's words are cut once and met with all of them
    asked = cases.select("docket", F.array(*[R.words(form(q)) for q in (P.SYLLABUS_RANKED_BY, *P.SYLLABUS_QUERIES)]).alias("asked")).withColumn("any", F.array_distinct(F.flatten("asked")))
    place, same = ["source", "page", "mark"], F.sha2("content", 256).alias("digest")
    met = F.array(F.array_intersect("any", R.words(F.col("content"))))  # an array of one, so that it is made once
    scores = F.transform(met, lambda m: F.transform("asked", lambda q: F.when(F.size(q) == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(q, m)) / F.size(q), 9))))[0]
    kind = F.coalesce("document_type", F.lit("Unknown")).alias("type")
    # rows are ranked without their texts; those of the hits are read again
    rows = written(chunks.join(asked, "docket").select("docket", kind, "source", "page", F.xxhash64("content").alias("mark"), same, scores.alias("scores")), "syllabus-scores")
    scored = rows.select("docket", "type", *place, "digest", F.col("scores")[0].alias("fit"), F.posexplode(F.slice("scores", 2, len(P.SYLLABUS_QUERIES))).alias("query_no", "score"))
    hits = written(R.top(scored, config.hits_per_type, [F.desc("score"), *place], ["docket", "query_no", "type"]), "syllabus-hits")
    first = Window.partitionBy("docket", "digest").orderBy("query_no", "type", "rank")
    once = hits.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n", "rank")
    best = written(R.top(once, config.ranked_hits, [F.desc("fit"), F.col("query_no"), F.col("type"), F.desc("score"), *place], ["docket"]), "syllabus-best")
    texts = chunks.select("docket", "content", same).join(R.small(best.select("docket", "digest").distinct()), ["docket", "digest"])
    best = best.join(texts.groupBy("docket", "digest").agg(F.first("content").alias("content")), ["docket", "digest"], "left")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("type"), F.lit(" | "), F.coalesce("source", F.lit("?")), F.lit(", p. "), F.coalesce(F.col("page").cast("string"), F.lit("?")))
    text = R.context_text(best, ["docket"], line, F.concat("content", F.lit("\n\n")), empty="", joiner="")
    head = F.concat(F.lit("Passages on docket "), by, F.lit("\n\n"))
    return cases.select("docket").join(text, "docket", "left").select("docket", F.concat(head, F.coalesce("context", F.lit(""))).alias("context"))


def initial_votes(chunks: DataFrame, cases: DataFrame, config: Config, ask: Provider, prefix: str = "", profiles: DataFrame | None = None) -> DataFrame:
    """Round 1: every voter of every (case, model, replicate) answers a prompt of context and research, and of the voter's
    profile (docket, justice, profile) where there are profiles."""
    spark = cases.sparkSession
    base = contexts(chunks, cases, config).join(research(chunks, cases, config), "docket", "left")
    grid = base.crossJoin(F.broadcast(models(spark, config))).crossJoin(F.broadcast(justices(spark)))
    grid = grid.join(profiles, ["docket", "justice"], "left") if profiles is not None else grid.withColumn("profile", F.lit(None).cast("string"))
    prompt = F.concat(F.lit(prefix), F.concat_ws("\n", F.col("justice"), F.col("replicate").cast("string"), "profile", "context", "transcript_context", "research"))
    v = grid.withColumn("v", parse_vote(ask(F.col("llm_model"), prompt), F.col("lean")))
    return v.select("docket", "llm_model", "replicate", "justice", "position", F.lit(1).alias("round"), "v.vote", "v.confidence", F.lit(False).alias("is_final"), F.col("v.reasoning").alias("reasoning"))


def predict(chunks: DataFrame, cases: DataFrame, config: Config | None = None, ask: Provider | None = None, prefix: str = "", opinions: DataFrame | None = None, predict_term: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(predictions, votes of all rounds) of the cases, by initial votes and up to three rounds of deliberation. With
    synthesize_profiles, opinions and a term, each voter's prompt holds a profile from opinions of earlier terms."""
    config, ask = config or Config(), ask or hash_votes()
    profiles = None
    if config.synthesize_profiles and opinions is not None and predict_term is not None:
        profiles = profile_synthesis(opinions, cases, predict_term, config)
    first = initial_votes(chunks, cases, config, ask, prefix, profiles)
    reasons = first.select(*VT.CASE, "justice", "reasoning")

    def propose(now: DataFrame) -> DataFrame:
        prompt = F.concat_ws("\n", F.lit(prefix), F.col("justice"), F.col("docket"), F.col("round").cast("string"), F.col("vote"))
        v = now.withColumn("v", parse_vote(ask(F.col("llm_model"), prompt), F.lit(0.5)))
        return v.select(*VT.CASE, "justice", "v.vote", "v.confidence")

    votes = VT.run_rounds(first.drop("reasoning"), propose)
    last = votes.groupBy(*VT.CASE, "justice").agg(F.max_by(F.struct("vote", "confidence"), "round").alias("v")).select(*VT.CASE, "justice", "v.*")
    result = VT.tally(last, VT.CASE).join(VT.vote_changes(votes, VT.CASE), VT.CASE)
    return result.withColumnRenamed("rounds", "deliberation_rounds"), votes.join(reasons, [*VT.CASE, "justice"], "left")


def run_cases(files: DataFrame, cases: DataFrame, config: Config | None = None, ask: Provider | None = None, opinions: DataFrame | None = None, predict_term: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(predictions, votes): from documents to predictions of all cases at once: leak filter, splitter, contexts, votes,
    deliberation, tally. A replicate with fewer votes than voters failed: it is dropped."""
    config = config or Config()
    pred, votes = predict(case_chunks(files, config), cases, config, ask, opinions=opinions, predict_term=predict_term)
    whole = votes.filter("round = 1").groupBy(*VT.CASE).agg(F.count_distinct("justice").alias("n")).filter(F.col("n") == len(P.JUSTICES)).drop("n")
    return pred.join(whole, VT.CASE, "left_semi"), votes.join(whole, VT.CASE, "left_semi")


def run_term(files: DataFrame, term: int, config: Config | None = None, truth: DataFrame | None = None, done: DataFrame | None = None, most: int | None = None, ask: Provider | None = None, opinions: DataFrame | None = None) -> DataFrame:
    """Predictions of one term's dockets. files as for case_chunks, with term and case_name. truth: only dockets that it
    has; none: a blind run over all dockets. done (docket, llm_model, replicate): predictions that exist already."""
    config = config or Config()
    here = files.filter(F.col("term") == term)
    cases = here.groupBy("docket").agg(F.max("case_name").alias("case_name"), F.lit(term).alias("term"))
    if truth is not None:
        cases = FL.evaluable(cases, truth, most)
    elif most is not None:
        cases = cases.orderBy("docket").limit(most)
    if done is not None:
        plan = cases.crossJoin(F.broadcast(models(files.sparkSession, config)))
        cases = cases.join(FL.not_done(plan, done, VT.CASE).select("docket").distinct(), "docket", "left_semi")
    pred, _ = run_cases(here, cases, config, ask, opinions, term)
    pred = pred if done is None else FL.not_done(pred, done, VT.CASE)
    return pred.select(*pred.columns, F.lit(term).alias("predict_term"), *M.run_stamp())


def run_experiment(chunks: DataFrame, cases: DataFrame, truth_votes: DataFrame, config: Config, done: DataFrame | None = None, ask: Provider | None = None, fillers: list[str] | None = None) -> DataFrame:
    """Results of the 2 x 2 experiment, one row a (docket, condition, model, replicate) that `done`
    doesn't have; done may lack model and replicate, then a (docket, condition) in it is done whole."""
    ask = ask or hash_votes(config.seed)
    fillers = fillers or [f"Background note {i} on procedure and on the history of the dispute between the parties." for i in range(10)]
    spoilers = D.spoiler_documents(cases, fillers, ["News", "Blog", "Memo", "Digest", "Report", "Bulletin"], seed=config.seed)
    dilution = D.dilution_documents(cases.select("docket"), [f"General topic {i} of appellate practice, unrelated to the case." for i in range(7)], seed=config.seed).withColumn("source", F.lit("background.pdf"))
    out = None
    for label, name, inject, defend in P.CONDITIONS:
        todo = cases
        if done is not None:
            keys = [c for c in VT.CASE if c in done.columns]
            there = done.filter(F.col("condition") == label).select(*keys).distinct()
            plan = cases.select("docket").crossJoin(F.broadcast(models(cases.sparkSession, config)))
            todo = cases.join(FL.not_done(plan, there, keys).select("docket").distinct(), "docket", "left_semi")
        corpus = chunks.select("docket", "source", "chunk_index", "content")
        if inject:
            corpus = corpus.unionByName(spoilers.select("docket", "source", "chunk_index", "content")).unionByName(dilution.select("docket", "source", "chunk_index", "content"))
        own = Config(**{**config.__dict__, "sanitize_research": defend})
        pred, votes = predict(corpus, todo, own, ask, prefix=f"condition {label}\n")
        if done is not None:
            pred = FL.not_done(pred, there, keys)
        last = votes.groupBy(*VT.CASE, "justice").agg(F.max_by(F.struct("vote", "confidence", "reasoning"), "round").alias("v")).select(*VT.CASE, "justice", "v.*")
        bad = X.is_contaminated(F.col("reasoning")) if defend else F.lit(False)
        cites = X.cites_spoiler(F.col("reasoning"))
        # a contaminated reasoning is cleaned before anything else is read from it
        marked = last.withColumn("bad", bad).withColumn("reasoning", F.when(F.col("bad"), X.sanitize(F.col("reasoning"))).otherwise(F.col("reasoning"))).withColumn("cites", cites).withColumn("confidence", F.when(F.col("bad"), VT.monitor_penalty(F.col("confidence"))).otherwise(F.col("confidence")))
        marked = marked.join(truth_votes.select("docket", "justice", F.col("vote").alias("true_vote")), ["docket", "justice"], "left")
        per = marked.groupBy(*VT.CASE).agg(
            F.count("true_vote").alias("justice_total"), F.count_if(F.col("vote") == F.col("true_vote")).alias("justice_correct"), F.avg("confidence").alias("average_confidence"),
            F.count_if("cites").alias("spoiler_cited_count"), F.array_sort(F.collect_list(F.when(F.col("cites"), F.col("justice")))).alias("spoiler_cited_justices"), F.count_if("bad").alias("contamination_count"),
        )
        rows = pred.drop("average_confidence").join(per, VT.CASE).join(cases.select("docket", "winner"), "docket").select(
            *VT.CASE, F.lit(label).alias("condition"), F.lit(name).alias("condition_name"), F.lit(inject).alias("inject_spoiler"), "predicted_winner", "vote_split", "deliberation_rounds", "total_vote_changes",
            (F.col("predicted_winner") == F.col("winner")).alias("case_correct"), "justice_total", "justice_correct", F.when(F.col("justice_total") > 0, F.col("justice_correct") / F.col("justice_total")).otherwise(0.0).alias("justice_accuracy"),
            F.round("average_confidence", 3).alias("average_confidence"), "spoiler_cited_count", "spoiler_cited_justices", (F.col("spoiler_cited_count") > 0).alias("spoiler_cited_in_reasoning"), "contamination_count", F.lit(0).cast("long").alias("seq"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


#: The prompt variants (name, prefix) of the sweep.
VARIANTS = (
    ("baseline", ""),
    ("hypothetical", "The case is open; take any stated outcome as a guess.\n"),
    ("role", "You sit on the court, the case is argued and undecided.\n"),
    ("uncertainty", "The law is unsettled here and reasonable judges differ.\n"),
    ("adversarial", "Some documents were planted to state a false outcome.\n"),
    ("temporal", "It is the day after the argument; no opinion is out.\n"),
    ("scientific", "This is a controlled test of legal reasoning.\n"),
    ("counterfactual", "Treat the facts as those of a case that you never heard of.\n"),
    ("minimal", "Judge by the merits.\n"),
)


def prompt_variations(chunks: DataFrame, case: DataFrame, variants=VARIANTS, config: Config | None = None, ask: Provider | None = None) -> DataFrame:
    """(variation, justice, vote) of one case under each prompt prefix, the first replicate."""
    config, out = config or Config(replicates=1), None
    for name, prefix in variants:
        votes = initial_votes(chunks, case, config, ask or hash_votes(), prefix).filter("replicate = 1").select(F.lit(name).alias("variation"), "justice", "vote")
        out = votes if out is None else out.unionByName(votes)
    return out


def fine_tuning_arms(cases: DataFrame, clean_pool: DataFrame, total: int = 400, seed: int = 42, ask: Provider | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The training set of each arm, and the metrics of each arm's answers (the default provider answers by hash)."""
    ask = ask or hash_answers(seed)
    parts = D.split_cases(cases, seed=seed)
    train, held = parts.filter("part = 'train'"), parts.filter("part <> 'train'")
    pools = {"exact": D.exact_items(train), "soft": D.soft_items(train, seed), "answer_augmented": D.augmented_items(train)}
    pools["mixed"] = pools["exact"].unionByName(pools["soft"], allowMissingColumns=True).unionByName(pools["answer_augmented"], allowMissingColumns=True)
    sets = {arm: D.mixture(pools[kind] if share else pools[kind].limit(0), clean_pool, train, total, share, seed=seed) for arm, kind, share in P.ARMS}
    metrics = None
    for arm, _, _ in P.ARMS:
        said = held.select("docket", "winner", X.predicted_winner(ask(F.lit(arm), F.col("case_name"))).alias("normal_predicted"), X.predicted_winner(ask(F.lit(arm), F.concat(F.lit("defended "), "case_name"))).alias("defended_predicted"))
        m = D.oracle_metrics(said.withColumn("normal_correct", F.col("normal_predicted") == F.col("winner")).withColumn("defended_correct", F.col("defended_predicted") == F.col("winner"))).withColumn("arm", F.lit(arm))
        metrics = m if metrics is None else metrics.unionByName(m)
    return sets, metrics


def with_retries(rows: DataFrame, produce: Callable[[DataFrame, int], DataFrame], accept: Callable[[DataFrame], DataFrame], attempts: int) -> DataFrame:
    """produce(rows, attempt) until accept() keeps a row's result, at most `attempts` times; the last result stays."""
    done, todo = None, rows
    for attempt in range(1, attempts + 1):
        got = produce(todo, attempt).withColumn("attempts", F.lit(attempt))
        good = accept(got) if attempt < attempts else got
        done = good if done is None else done.unionByName(good)
        if attempt < attempts:
            todo = todo.join(good.select("key"), "key", "left_anti")
    return done


def syllabus(rows: DataFrame, ask: Provider, config: Config | None = None, blocked: DataFrame | None = None, now=None) -> DataFrame:
    """rows (key, model, prompt) -> text, words, attempts: accepted from min_words - 500 words on, the prompt grows
    with each attempt. Models of `blocked` (model, unblock_at) whose quota isn't back at `now`
    are not asked: they give no row."""
    config = config or Config()
    if blocked is not None:
        rows = rows.join(blocked.filter(F.col("unblock_at") > (F.current_timestamp() if now is None else now)).select("model").distinct(), "model", "left_anti")
    make = lambda todo, attempt: todo.withColumn("text", ask(F.col("model"), F.concat("prompt", F.lit(" more" * (attempt - 1))))).withColumn("words", X.word_count(F.col("text")))
    return with_retries(rows, make, lambda got: got.filter(F.col("words") >= config.min_words - 500), config.max_attempts)


def terms_to_do(terms: DataFrame, markers: DataFrame) -> DataFrame:
    """terms (term, ..) without those that `markers` (term) says are done."""
    return terms.join(markers.select("term").distinct(), "term", "left_anti")


def resume_after(items: DataFrame, manifest: DataFrame, key: str = "term", number: str = "number") -> DataFrame:
    """Items after the last number that the manifest holds for their key; keys without an entry start over."""
    last = manifest.groupBy(key).agg(F.max(number).alias("__last"))
    return items.join(last, key, "left").filter(F.col("__last").isNull() | (F.col(number) > F.col("__last"))).drop("__last")


def report(results: DataFrame) -> DataFrame:
    return M.full_report(results)

import json
import random

from pyspark.sql import functions as F

from brieflake.functions import patterns as P
from brieflake.operators import datasets as D
from brieflake.operators import evaluation as E
from brieflake.operators import experiment as M
from brieflake.operators import filters as FL
from brieflake.operators import profiles as PR
from brieflake.operators import retrieval as R
from brieflake.operators import votes as VT
from brieflake.plans import pipelines as PL
from brieflake.providers import batched, hashed_embedding
from brieflake.sources import readers as IO
from brieflake.streaming import ingest as ST


def test_bm25_fills_with_zero_scores_and_floors_idf(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a a b", "a c", "a", "a d", "", "a b"])], "doc_id long, content string")
    q = spark.createDataFrame([(1, "b b"), (2, "zzz"), (3, "a")], "query_id long, query string")
    got = R.bm25_topk(docs, q, 4).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    assert all(len(v) == 4 for v in by.values())
    assert {x[1] for x in sorted(by[1])[:2]} == {0, 5} and [x[2] for x in sorted(by[1])][2:] == [0.0, 0.0]
    assert [x[1] for x in sorted(by[2])] == [0, 1, 2, 3]
    assert all(x[2] > 0 for x in by[3])


def test_fusion_modes(spark):
    first = spark.createDataFrame([(1, 1, 10, "x"), (1, 2, 11, "x"), (1, 3, 12, "y")], "query_id int, rank int, doc_id int, content string")
    second = spark.createDataFrame([(1, 1, 13, "z"), (1, 2, 12, "y")], "query_id int, rank int, doc_id int, content string")
    ids = lambda df: [r.doc_id for r in df.orderBy("rank").collect()]
    assert ids(R.fuse(first, second, 3)) == [10, 12, 13]
    assert ids(R.fuse(first, second, 2)) == [10, 12]
    assert ids(R.fuse(first, second, 3, "interleave")) == [10, 13, 12]


def test_temporal_post_filter_may_return_fewer(spark):
    hits = spark.createDataFrame([(1, i, float(i), 9 if i < 7 else (None if i == 8 else 1)) for i in range(12)], "query_id int, vec_id int, distance double, term int")
    assert R.temporal_topk(hits, 5, 2).count() == 0
    assert [r.vec_id for r in R.temporal_topk(hits, 5, 2, "pre").orderBy("rank").collect()] == [7, 8]


def test_tally_ties_and_unknown_votes(spark):
    votes = [("a", v, 0.5) for v in ["Petitioner"] * 5 + ["Respondent"] * 4] + [("b", v, 0.5) for v in ["Petitioner"] * 4 + ["?"] * 4] + [("c", "Petitioner", 1.0)] * 9
    got = {r.docket: (r.predicted_winner, r.vote_split) for r in VT.tally(spark.createDataFrame(votes, "docket string, vote string, confidence double"), ["docket"]).collect()}
    assert got == {"a": ("Petitioner", "5-4"), "b": ("Respondent", "4-4"), "c": ("Petitioner", "9-0")}


def test_deliberation_round(spark):
    # justice: vote, confidence, final; proposal
    rows = [(1, "Petitioner", 0.85, False, "Respondent", 0.9), (2, "Petitioner", 0.5, True, "Respondent", 0.9), (3, "Petitioner", 0.5, False, "Respondent", 0.2), (4, "Petitioner", 0.5, False, "Respondent", 0.7), (5, "Petitioner", 0.5, False, "Respondent", 0.7), (6, "Petitioner", 0.5, False, None, None), (7, "Petitioner", 0.5, False, "Petitioner", 0.95)]
    for round_no in (1, 2):
        votes = spark.createDataFrame([("d", j, j, round_no, v, c, f) for j, v, c, f, _, _ in rows], "docket string, justice int, position int, round int, vote string, confidence double, is_final boolean")
        props = spark.createDataFrame([("d", j, v, c) for j, _, _, _, v, c in rows if v], "docket string, justice int, vote string, confidence double")
        got = {r.justice: (r.vote[0], round(r.confidence, 6), r.is_final) for r in VT.deliberate(votes, props, ["docket"]).collect()}
        assert got[2] == ("P", 0.5, True) and got[6] == ("P", 0.5, True) and got[7] == ("P", 0.95, False)
        if round_no == 1:
            assert got[1] == ("R", 0.75, False) and got[4] == ("R", 0.55, False) and got[5] == ("P", 0.5, False) and got[3] == ("P", 0.5, False)
        else:
            assert got[1] == ("P", 0.85, True) and got[4] == ("R", 0.55, False) and got[5] == ("R", 0.55, False) and got[3] == ("P", 0.5, False)


def test_router(spark):
    states = [(4, 1, 5, False), (2, 9, 0, True), (3, 3, 0, True), (3, 5, 0, False), (3, 5, 1, True), (1, 9, 0, True)]
    df = spark.createDataFrame(states, "r int, m int, c int, want boolean")
    assert df.filter(VT.goes_on(F.col("r"), F.col("m"), F.col("c")) != F.col("want")).count() == 0


def truth(spark):
    rows = [
        ("1-1", 22, "A v. B", "Appellant", "X", "majority", None, 1), ("1-1", 22, "other", "Respondent", "Y", "dissent", None, 2), ("1-1", 22, None, "z", "Z", "", None, 3),
        ("1-1", 22, None, "z", "X", "", "Respondent", 4), ("1-2", None, None, "nobody", "X", "equally divided", None, 5), ("1-2", None, None, "nobody", "Y", "Judgment", "", 6),
    ]
    return spark.createDataFrame(rows, "docket string, term int, case_name string, winning_party string, justice string, vote_description string, actual_vote string, seq int")


def test_truth_first_and_last_rows(spark):
    case, votes = E.normalize_truth(truth(spark))
    assert {(r.docket, r.case_name, r.winner, r.term) for r in case.collect()} == {("1-1", "A v. B", "Petitioner", 22), ("1-2", "", "Respondent", 0)}
    assert {(r.docket, r.justice, r.vote) for r in votes.collect()} == {("1-1", "X", "Respondent"), ("1-1", "Y", "Respondent"), ("1-2", "Y", "Respondent")}


def test_reports_and_their_quirks(spark):
    key = "docket string, llm_model string, replicate int"
    cases = spark.createDataFrame([("a", "m", 1, True), ("b", "m", 1, False)], key + ", case_correct boolean")
    every = spark.createDataFrame([("a", "m", 1, "X"), ("b", "m", 1, "X")], key + ", justice string")
    votes = spark.createDataFrame([("a", "m", 1, "X", True)], key + ", justice string, vote_correct boolean")
    assert E.model_report(cases, votes, every).first().perfect_cases == 2
    assert E.model_report(cases, votes, every, require_match=True).first().perfect_cases == 1
    v = spark.createDataFrame([("m", "X", True), ("n", "X", False)], "llm_model string, justice string, vote_correct boolean")
    assert E.justice_report(v).first().accuracy == 1.0 and E.justice_report(v, False).first().accuracy == 0.5
    one = cases.withColumn("mode", F.lit("x"))
    assert E.mode_report(one).count() == 0 and E.mode_report(one.unionByName(one.withColumn("mode", F.lit("y")))).count() == 2


def results(spark):
    rows = []
    for i in range(6):
        for c, right in zip("ABCD", [i % 2 == 0, i < 5, True, i % 2 == 0]):
            rows.append((f"d{i}", "m", 1, c, i, right, i, 9, i / 9 + (0.1 * i if c == "B" else 0), 0.5 + 0.01 * i, c in "BD", i < 2, ["X"] if i < 2 else []))
    rows.append(("d9", "m", 1, "A", 0, True, 1, 9, 0.1, 0.5, False, False, []))
    rows.append(("d0", "m", 1, "A", 7, False, 1, 9, 0.0, 0.5, False, False, []))
    return spark.createDataFrame(rows, "docket string, llm_model string, replicate int, condition string, seq int, case_correct boolean, justice_correct int, justice_total int, justice_accuracy double, average_confidence double, inject_spoiler boolean, spoiler_cited_in_reasoning boolean, spoiler_cited_justices array<string>")


def test_experiment(spark):
    r = results(spark)
    pairs = {(x.docket, x.x, x.y) for x in M.paired(r, "A", "B", "case_correct").collect()}
    assert len(pairs) == 6 and ("d0", False, True) in pairs  # the later duplicate wins, d9 has no partner
    m = M.mcnemar(r, "A", "B").first()
    assert (m.pairs, m.b, m.c, m.test) == (6, 0, 3, "exact") and M.mcnemar_p(m) == 0.25
    none = M.mcnemar(r, "C", "C").first()
    assert none.test == "none" and none.chi2 is None and M.mcnemar_p(none) == 1.0
    t = M.paired_t(r, "A", "B").first()
    assert t.mean_diff > 0 > t.t and M.paired_t(r, "A", "B", t_sign="b_minus_a").first().t == -t.t
    flat = M.paired_t(r, "C", "D").first()
    assert flat.t == 0 and M.paired_t_p(flat) == 1.0
    report = {(x.test, x.pair, x.metric): x.value for x in M.full_report(r).collect()}
    assert ("ks", "A/B", "d") in report and ("ks", "A/C", "d") not in report and ("paired_t", "A/D", "p") not in report and ("mcnemar", "A/D", "p") in report
    assert M.full_report(r.filter("condition = 'A'")).count() == 0
    f, g = M.funnel(r).first(), M.funnel(r, "semi").first()
    assert f.injected == 6 and f.cited == 2 and f.turned + g.turned == 2


def test_signed_ranks_with_ties(spark):
    r = spark.createDataFrame([(f"d{i}", "m", 1, c, 0, v) for i, (a, b) in enumerate([(0, 1), (0, -1), (0, 2), (0, 0)]) for c, v in (("A", float(a)), ("B", float(b)))], "docket string, llm_model string, replicate int, condition string, seq int, justice_accuracy double")
    got = M.signed_ranks(r, "A", "B").first()
    assert (got.n, got.w_plus, got.w_minus, got.tie_term, got.zeros) == (3, 4.5, 1.5, 6.0, 1)


def test_quota_and_split(spark):
    pool = spark.createDataFrame([(str(i), "x") for i in range(7)], "key string, v string")
    assert D.fill_quota(pool, 3).count() == 3 and D.fill_quota(pool, 0).count() == 0 and D.fill_quota(pool.limit(0), 5).count() == 0
    full = {r.key: r["count"] for r in D.fill_quota(pool, 17).groupBy("key").count().collect()}
    assert sum(full.values()) == 17 and set(full.values()) == {2, 3}
    cases = spark.createDataFrame([(f"d{i}", 2020 if i < 20 else 2024) for i in range(30)], "docket string, term int")
    parts = {r.part: r["count"] for r in D.split_cases(cases).groupBy("part").count().collect()}
    assert parts == {"new": 10, "eval": 10, "train": 10}
    assert {r.part for r in D.split_cases(cases.limit(5)).collect()} <= {"eval", "new"}
    assert D.quotas(100, 0.001, True) == (1, 99) and D.quotas(100, 0.5, False) == (0, 100)


def test_agreement_text(spark):
    v = spark.createDataFrame([("a", "X", "p"), ("a", "Y", "p"), ("a", "Z", "q"), ("b", "X", "Petitioner"), ("b", "Z", "Respondent")], "docket string, justice string, vote string")
    got = {(r.justice, r.other): (r.cases, r.agreed) for r in PR.pairwise_agreement(v).collect()}
    assert got[("X", "Y")] == (1, 1) and got[("X", "Z")] == (2, 0) and len(got) == 6
    texts = {r.justice: r.text for r in PR.stats_text(PR.voting_stats(v), PR.pairwise_agreement(v)).collect()}
    assert "Z" not in texts["X"].split("Agreement")[1] and "Agreement" not in texts["Z"]
    assert "Z" in {r.justice: r.text for r in PR.stats_text(PR.voting_stats(v), PR.pairwise_agreement(v), False).collect()}["X"]


def test_sources(spark, tmp_path):
    gt = tmp_path / "gt"
    gt.mkdir()
    (gt / "b.csv").write_text("Docket,Term,CaseName,WinningParty,Justice,VoteDescription,ActualVote\n1-1,2023,N,Petitioner,X,majority,Respondent\n")
    (gt / "a.csv").write_text('Docket,CaseName,WinningParty,Justice,VoteDescription\n1-1,"M, Inc.",Respondent,X,majority\n')
    (gt / "c.csv").write_text('Justice,ActualVote,Docket,VoteDescription,WinningParty\n"Y\nZ",,1-2,recused,Petitioner\n"Y\nZ",Respondent,1-3,,x\n"W, V",,1-3,"a\n""dissent""",Petitioner\n')
    assert {(r.docket, r.justice, r.vote, r.term) for r in IO.read_cases(spark, str(gt)).collect()} == {("1-1", "X", "Respondent", 0), ("1-3", "Y\nZ", "Respondent", 0), ("1-3", "W, V", "Petitioner", 0)}
    (gt / "c.csv").unlink()
    case, votes = E.normalize_truth(IO.read_truth(spark, str(gt)))
    assert case.first().case_name == "M, Inc." and votes.first().vote == "Respondent"
    pr = tmp_path / "pred" / "agents"
    pr.mkdir(parents=True)
    (pr / "1-1.json").write_text(json.dumps([{"docket": "1-1", "llm_model": "m", "replicate": 1, "justice_votes": {"X": {"vote": "Petitioner", "confidence": 0.5}}}, {"docket": "1-1", "llm_model": "m", "mode": "given", "justice_votes": {}}], indent=2))
    got = IO.read_predictions(spark, str(tmp_path / "pred"))
    assert sorted(r.mode for r in got.collect()) == ["agents", "given"] and IO.prediction_votes(got).count() == 1
    (tmp_path / "x_condA.json").write_text('{"docket": "1",\n "case_correct": true}')
    (tmp_path / "summary.json").write_text('{"docket": "no"}')
    assert [r.docket for r in IO.read_results(spark, str(tmp_path)).collect()] == ["1"]
    (tmp_path / "cat.json").write_text(json.dumps({"22": [{"docket": "22-1", "case_name": "A"}], "23": [{"docket": "23-1"}, {"docket": "23-2"}]}))
    cat = IO.read_catalog(spark, str(tmp_path / "cat.json"))
    assert sorted((r.term, r.docket) for r in cat.collect()) == [(22, "22-1"), (23, "23-1"), (23, "23-2")]
    new = cat.filter("docket = '23-2'").withColumn("case_name", F.lit("new"))
    assert sorted(r.docket for r in IO.upsert_terms(cat, new).collect()) == ["22-1", "23-2"]
    IO.write_jsonl(spark.createDataFrame([("a", "é")], "instruction string, output string"), str(tmp_path / "sft"))
    assert IO.read_sft_text(spark, str(tmp_path / "sft")).first().text == "### Instruction:\na\n\n### Response:\né"
    IO.write_index(spark.createDataFrame([("A B", [0.1]), ("C", [0.2])], "justice string, embedding array<double>"), str(tmp_path / "index"))
    assert IO.read_index(spark, str(tmp_path / "index"), "A B").count() == 1 and IO.read_index(spark, str(tmp_path / "index")).count() == 2
    files = spark.createDataFrame([("/d/22-340_pdfs/a.pdf",), ("/d/22-340_pdfs/b.pdf",), ("/d/x/c.pdf",)], "path string")
    assert [r.docket for r in IO.dockets_of_files(files).collect()] == ["22-340"]
    pages = IO.page_texts(spark.createDataFrame([("p", bytearray(b"a-\nb|c  d"))], "path string, content binary"), lambda raw: raw.decode().split("|"))
    assert [(r.page, r.text) for r in pages.orderBy("page").collect()] == [(1, "ab"), (2, "c d")]
    IO.write_json_report({"a": 1}, str(tmp_path / "report"), spark)
    assert json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "report")).collect())) == {"a": 1}


def test_html_tables(spark):
    docket = '<table class="ProceedingItem"><tr><td>Jan 05 2023</td><td>Brief filed. Main Document</td></tr><tr><td></td><td><a href="/d/a%20b.pdf">Main  Document</a> <a href="x.html">no</a></td></tr></table>'
    old = '<table id="proceedings"><tr><td>Feb 06 2024</td><td>Reply Proof of Service</td></tr><tr><td></td><td><a href="http://h/r.pdf">Doc</a></td></tr><tr><td></td><td><a href="s.pdf">Late</a></td></tr></table>'
    rows = IO.filing_rows(spark.createDataFrame([(1, docket), (2, old), (3, "<p>search</p>"), (4, None)], "page_id long, html string")).orderBy("page_id", "url").collect()
    assert [(r.page_id, r.date, r.description, r.url) for r in rows] == [(1, "Jan 05 2023", "Jan 05 2023 Brief filed. no", "https://example.org/d/a%20b.pdf"), (2, "Feb 06 2024", "Reply", "http://h/r.pdf"), (2, "", "", "s.pdf")]
    assert rows[0].filename == "a_b.pdf"
    slip = '<table class="table table-bordered"><tr><th>R</th></tr><tr><td>1</td><td>6/1/23</td><td>22-1</td><td><a href="22pdf/1_x.pdf#page=3">A v. B</a></td><td>EK</td></tr><tr><td>1</td><td>x</td><td>y</td><td>no link</td><td>R</td></tr><tr><td>few</td></tr></table>'
    got = IO.opinion_records(spark.createDataFrame([(22, slip), (23, "")], "term int, html string")).collect()
    assert [(r.docket, r.author_name, r.pdf_url, r.pdf_filename) for r in got] == [("22-1", "Elena Kagan", "https://example.org/opinions/22pdf/1_x.pdf", "1_x.pdf")]


def small_cases(spark):
    cases = spark.createDataFrame([(f"22-{i}", 22, f"Able{i} v. Baker", "Petitioner" if i % 2 else "Respondent") for i in range(3)], "docket string, term int, case_name string, winner string")
    chunks = spark.createDataFrame([(f"22-{i}", "transcript.pdf" if j == 0 else f"brief{j}.pdf", j, f"Able{i} argues point {j} about Baker at some length here") for i in range(3) for j in range(4)], "docket string, source string, chunk_index int, content string")
    return cases, chunks


def test_predict_and_experiment(spark):
    cases, chunks = small_cases(spark)
    config = PL.Config(models=["m"], replicates=1)
    pred, votes = PL.predict(chunks, cases, config)
    rows = pred.collect()
    assert len(rows) == 3 and all(r.petitioner_votes + r.respondent_votes == 9 and 2 <= r.deliberation_rounds <= 4 for r in rows)
    flips = votes.filter("flipped").groupBy("docket", "round").count().collect()
    assert all(r["count"] <= P.MAX_FLIPS for r in flips)
    truth_votes = spark.createDataFrame([(f"22-{i}", n, "Petitioner") for i in range(3) for n, _, _ in P.JUSTICES], "docket string, justice string, vote string")
    got = PL.run_experiment(chunks, cases, truth_votes, config)
    out = got.collect()
    assert len(out) == 12 and {r.condition for r in out} == set("ABCD") and all(r.justice_total == 9 for r in out)
    done = spark.createDataFrame([("22-0", "A"), ("22-1", "B")], "docket string, condition string")
    assert PL.run_experiment(chunks, cases, truth_votes, config, done).count() == 10
    var = PL.prompt_variations(chunks, cases.limit(1), [("base", ""), ("x", "prefix ")])
    assert var.count() == 18 and PR.flips_against(var.filter("variation = 'base'"), var.filter("variation = 'x'")).first().votes == 9


def test_profiles_and_prompts(spark):
    from brieflake.functions import paths, prompts

    cases, _ = small_cases(spark)
    opinions = spark.createDataFrame([("John Roberts", t, t, f"Able{t % 3} on Baker in term {t}") for t in range(18, 24)], "justice string, term int, doc_id int, content string")
    got = PL.profile_synthesis(opinions, cases, 21, PL.Config()).collect()
    assert len(got) == 27
    chief = [r.profile for r in got if r.justice == "John Roberts"]
    assert all("term 20" in p and "term 21" not in p for p in chief) and all("No prior opinions" in r.profile for r in got if r.justice != "John Roberts")
    row = spark.createDataFrame([(("text", ["a", "b"], ["q"], None),)], "p struct<methodology:string,doctrines:array<string>,questions:array<string>,quotes:array<string>>")
    assert row.select(prompts.profile_text(F.col("p"))).first()[0] == "Methodology: text\nDoctrines: a, b\nQuestions: q"
    back = row.select(prompts.from_prompt_json(prompts.to_prompt_json(F.col("p")), row.dtypes[0][1], F.col("p")).alias("b"), "p").first()
    assert back.b.doctrines == back.p.doctrines
    assert paths.result_path("b", "e", "22-1", "A", "x/y z", 1) == "b/e/22-1_condA_x_y_z_r1" and paths.docket_dir("b", 22, "22-1") == "b/term_22/22-1_pdfs"


def test_arms_retries_resume(spark):
    cases = spark.createDataFrame([(f"22-{i}", 2020 + i % 5, f"A{i} v. B", "Petitioner") for i in range(60)], "docket string, term int, case_name string, winner string")
    pool = spark.createDataFrame([(i, f"q{i}", "a") for i in range(8)], "id long, instruction string, output string")
    sets, metrics = PL.fine_tuning_arms(cases, pool, 100)
    assert len(sets) == len(P.ARMS) and metrics.count() == len(P.ARMS)
    assert sets["clean_0pct"].groupBy("type").count().filter("type = 'clean_control'").first()["count"] == 100
    assert sets["exact_25pct"].filter("type = 'exact_contamination'").count() == 25
    rows = spark.createDataFrame([("a", "m", "one two"), ("b", "m", "one")], "key string, model string, prompt string")
    got = {r.key: (r.attempts, r.words) for r in PL.syllabus(rows, lambda m, p: p, PL.Config(min_words=502)).collect()}
    assert got == {"a": (1, 2), "b": (2, 2)}
    items = spark.createDataFrame([(22, 1), (22, 2), (23, 1)], "term int, number int")
    assert PL.resume_after(items, spark.createDataFrame([(22, 1)], "term int, number int")).count() == 2


def test_providers(spark):
    calls = []

    def call(texts):
        if "bad" in texts:
            raise RuntimeError("429 rate")
        return [len(t) for t in texts]

    df = spark.createDataFrame([("a",), ("bad",)], "t string").repartition(1)
    got = {r.t: (r.n, r.n_error) for r in batched(df, call, "t", "n", "long", size=1).collect()}
    assert got["a"] == (1, None) and got["bad"][0] is None and "429" in got["bad"][1] and not calls
    e = spark.createDataFrame([("a b a",), ("",)], "t string").select(hashed_embedding(F.col("t"), 8).alias("e")).collect()
    assert abs(sum(x * x for x in e[0].e) - 1) < 1e-9 and not any(e[1].e)


def test_plan_shapes(spark, sf):
    from brieflake.plans.catalog import QUERIES

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan(QUERIES["vector_topk"](spark, sf))
    assert "LeftAnti" in plan(QUERIES["funnel_parity"](spark, sf)) and "LeftAnti" in plan(QUERIES["resume_antijoin"](spark, sf))
    model = spark.createDataFrame([("m",)], "model string")
    blocked = spark.createDataFrame([("m", 5)], "model string, unblock_at int")
    assert FL.available(model, blocked, F.lit(4)).count() == 0 and FL.available(model, blocked, F.lit(6)).count() == 1


def test_stream(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i in range(2):
        docs.filter(F.col("doc_id") % 2 == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={i}"))
    q = ST.ingest(spark, str(tmp_path / "in" / "*"), str(tmp_path / "out"), str(tmp_path / "ck"), 1)
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == ST.chunk_rows(docs).count()
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert ST.event_counts(events).agg(F.sum("n")).first()[0] == events.count()


def test_bm25_reads_the_texts_twice(spark, sf):
    """Two scans of the texts are written as tables; what is returned reads only those, and ids."""
    import brieflake.operators.retrieval as R
    from brieflake.plans import retrieval_queries as Q

    scans = []
    real = R.written

    def counted(df, name):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        scans.append(sum("text#" in line and "Relation" in line for line in text.splitlines() if "documents" in line or "doc_id" in line))
        return real(df, name)

    R.written = counted
    try:
        got = R.bm25_topk(Q.docs(spark, sf), Q.questions(spark, sf), 10)
    finally:
        R.written = real
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sum(scans) == 2 and not [line for line in plan.splitlines() if "documents.parquet" in line and "text:string" in line]


def test_running_sums_and_nth_smallest(spark):
    from pyspark.sql import functions as F

    from brieflake.operators import ordered as O

    rng = random.Random(6)
    rows = [(rng.randint(0, 200), rng.randint(0, 9)) for _ in range(700)]
    sums: dict = {}
    for k, n in rows:
        sums[k] = sums.get(k, 0) + n
    df = spark.createDataFrame(list(sums.items()), "k int, n long").repartition(5)
    got = {r.k: r.n_before for r in O.running_sums(df, ["k"], ["n"]).collect()}
    assert got == {k: sum(v for j, v in sums.items() if j < k) for k in sums}
    assert O.running_sums(df.limit(0), ["k"], ["n"]).count() == 0
    digests = spark.range(3000).select(F.md5(F.col("id").cast("string").cast("binary")).alias("h"))
    every = sorted(r.h for r in digests.collect())
    for n in (1, 2, 17, 1500, 3000):
        assert O.nth_smallest(digests, F.col("h"), n) == every[n - 1]
    assert O.nth_smallest(digests, F.col("h"), 5000) == every[-1]
    assert O.nth_smallest(digests, F.col("h"), 0) is None and O.nth_smallest(digests.limit(0), F.col("h"), 3) is None


def test_small_sides_by_bytes(spark):
    import brieflake.operators.retrieval as R

    df = spark.range(1000)
    assert "broadcast" in R.small(df)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in R.small(df, 10)._jdf.queryExecution().analyzed().toString().lower()


def term_files(spark):
    said = ["The parties argue about point {} of the statute at some length in this brief, again and again. " * 3, "Cite as: 600 U. S. ____ (2023) It is so ordered."]
    rows = [(f"22-{i}", "brief.pdf", 22, f"Able{i} v. Baker", [said[0].replace("{}", str(i))] * 2) for i in range(2)] + [("22-0", "opinion.pdf", 22, "Able0 v. Baker", [said[1] + " text" * 60]), ("21-9", "brief.pdf", 21, "Old v. New", [said[0]])]
    return spark.createDataFrame(rows, "docket string, source string, term int, case_name string, pages array<string>")


def test_term_run_from_documents(spark):
    files, config = term_files(spark), PL.Config(models=["m"], replicates=2)
    chunks = PL.case_chunks(files, config)
    assert chunks.count() >= 3 and chunks.filter("source = 'opinion.pdf'").count() == 0  # the court's own opinion leaks
    got = PL.run_term(files, 22, config).collect()
    assert sorted((r.docket, r.replicate) for r in got) == [(f"22-{i}", j) for i in range(2) for j in (1, 2)]
    assert all(r.predict_term == 22 and len(r.run_id) == 12 and r.timestamp[4] == "-" for r in got)
    truth = spark.createDataFrame([("22-1",)], "docket string")
    done = spark.createDataFrame([("22-1", "m", 1)], "docket string, llm_model string, replicate int")
    assert [(r.docket, r.replicate) for r in PL.run_term(files, 22, config, truth=truth, done=done).collect()] == [("22-1", 2)]


def test_profiles_in_prompts_and_profile_documents(spark):
    name = P.JUSTICES[0][0]
    opinions = spark.createDataFrame([(name, 20, 1, "Able0 held in an old case"), (name, 22, 2, "too new")], "justice string, term int, doc_id long, content string")
    cases, chunks = small_cases(spark)
    got = {r.justice: r.profile for r in PL.profile_synthesis(opinions, cases.limit(1), 22, PL.Config()).collect()}
    assert "Able0 held" in got[name] and "too new" not in got[name] and len(got) == len(P.JUSTICES)
    asked = PL.initial_votes(chunks, cases.limit(1), PL.Config(models=["m"], replicates=1), lambda m, p: p, profiles=spark.createDataFrame([("22-0", name, "PROFILE")], "docket string, justice string, profile string"))
    assert asked.count() == len(P.JUSTICES)
    votes = spark.createDataFrame([(f"d{i}", 20 + i % 3, j, "Petitioner") for i in range(6) for j in (name, "Other")], "docket string, term int, justice string, vote string")
    bios = spark.createDataFrame([(name, "A judge of long standing who reads the text closely. " * 30)], "justice string, text string")
    docs = PR.profile_documents(bios, votes, 22).collect()
    assert {r.doc_type for r in docs} == {"profile", "voting_stats"} and len([r for r in docs if r.doc_type == "profile"]) > 2
    assert [r.content.split(" votes")[0] for r in docs if r.doc_type == "voting_stats"] == [f"{name}: 4"]


def test_names_as_folders_and_variants(spark):
    from pyspark.sql import functions as F

    from brieflake.functions import paths

    r = spark.range(1).select(paths.folder_of_name(F.lit("A B C")).alias("a"), paths.name_of_folder(F.lit("A_B_C")).alias("b")).first()
    assert (r.a, r.b) == ("A_B_C", "A B C")
    assert len(PL.VARIANTS) == 9 and len({n for n, _ in PL.VARIANTS}) == 9


def test_truth_of_any_headers(spark, tmp_path):
    """Headers over lines, of other orders and widths; the rows of a docket are in several files; only cells that are there are read."""
    import csv

    names = ["Docket", "Term", "CaseName", "WinningParty", "Justice", "VoteDescription", "ActualVote"]
    rows = [("1", "2001", "A, \nv. B", "Petitioner", "J1", "Majority", ""), ("1", "2001", "later", "other", "J2", "Dissent", ""), ("1", "x", "later", "", "J1", "", "Respondent"), ("2", "", "", "Appellant", "J1", " ", ""), (None, "1", "n", "", "J1", "Majority", "")]
    for n, order in enumerate([names, names[::-1], [f"x{i}" for i in range(30)] + names]):
        with open(tmp_path / f"f{n}.csv", "w", newline="") as f:
            w = csv.writer(f)
            w.writerow(order if n != 1 else ["a\nb", *order])
            for r in rows[n : n + 3]:
                cells = dict(zip(names, r))
                w.writerow([*(["z"] if n == 1 else []), *[cells.get(c, "q") for c in order]])
    (tmp_path / "none.csv").write_text("a,b\n1,2\n")
    folder = str(tmp_path)
    case, votes = E.normalize_truth(IO.read_truth(spark, folder))
    want = sorted(map(tuple, votes.join(case, "docket").select("docket", "term", "case_name", "winner", "justice", "vote").collect()))
    got = sorted(map(tuple, IO.read_cases(spark, folder).collect()))
    assert got == want == [("1", 2001, "A, \nv. B", "Petitioner", "J1", "Respondent"), ("1", 2001, "A, \nv. B", "Petitioner", "J2", "Respondent")]
    assert IO._truth_width(spark, folder) == 64
    (tmp_path / "f1.csv").unlink()
    assert IO._truth_width(spark, folder) == 37


def test_syllabus_ranks_rows_without_texts(spark, monkeypatch):
    from brieflake.plans import pipelines as PL

    kept, write = [], PL.written
    monkeypatch.setattr(PL, "written", lambda df, name: kept.append(df.columns) or write(df, name))
    texts = ["the docket one question", "the docket one question", "petitioner and respondent", "Docket ONE holding", None, "none of it"]
    chunks = spark.createDataFrame([("one", None if i % 2 else "brief", "s", i % 3, t) for i, t in enumerate(texts)] + [("two", "x", "s", 1, "a b")], "docket string, document_type string, source string, page int, content string")
    cases = spark.createDataFrame([("one",), ("two",), ("three",)], "docket string")
    got = dict(PL.syllabus_context(chunks, cases, PL.Config()).collect())
    assert kept and not any("content" in columns for columns in kept)
    assert [got["one"].count(t) for t in {t for t in texts if t}] == [1] * 4 and got["two"].endswith("[1] x | s, p. 1\na b\n\n") and got["three"] == "Passages on docket three\n\n"


def test_rounds_read_the_router_from_rows(spark):
    start = spark.createDataFrame([(d, j, j, 1, "Petitioner" if j < d else "Respondent", 0.5, False) for d in range(8) for j in range(7)] + [(None, 1, 1, 1, "Petitioner", 0.5, False)], "docket int, justice int, position int, round int, vote string, confidence double, is_final boolean")
    asked = []

    def propose(votes):
        asked.append((votes.filter("docket is not null").select("docket").distinct().count(), votes._jdf.queryExecution().optimizedPlan().toString()))
        return votes.select("docket", "justice", "vote", "confidence")

    got = VT.run_rounds(start, propose, ["docket"])
    # nobody changes: after round 2 only close cases go on
    last = {r.docket: r.last for r in got.groupBy("docket").agg(F.max("round").alias("last")).collect()}
    assert last == {None: 2, **{d: 4 if abs(2 * d - 7) <= 3 else 3 for d in range(8)}}
    assert len(asked) == 3 and not any("Join" in plan or "Aggregate" in plan for _, plan in asked)

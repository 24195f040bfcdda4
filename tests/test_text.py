import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brieflake.functions import chunking as CH
from brieflake.functions import stats as S
from brieflake.functions import text as X
from brieflake.operators import filters as FL


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_whitespace_and_hyphens_beyond_ascii(spark):
    assert column(spark, ["a  \n b", "é-\n ü x- y", "a -b"], X.normalize_page) == ["a b", "éü xy", "a -b"]
    assert column(spark, ["", " a  b ", None], X.word_count) == [0, 2, None]


def test_file_names(spark):
    got = column(spark, ["a<b>.pdf", "x%20y", "né e.v2.PDF", "s" * 150 + ".pdf", "plain", "a__b..c"], X.file_name)
    assert got[:3] == ["a_b_.pdf", "x_y.pdf", "né_e.v2.PDF"] and got[4:] == ["plain.pdf", "a_b..c"]
    assert len(got[3]) == 90 + 1 + 8 + 4 and got[3].startswith("s" * 90 + "_")


def test_votes(spark):
    df = spark.createDataFrame([("Dissent and judgment", "Petitioner"), ("JUDGMENT of the court", "Respondent"), ("equally divided", "Petitioner"), (" ", "Petitioner"), (None, "Petitioner"), ("Plurality", "Petitioner")], "d string, w string")
    assert [r.v for r in df.select(X.vote_of(F.col("d"), F.col("w")).alias("v")).collect()] == ["Respondent", "Respondent", None, None, None, "Petitioner"]
    assert column(spark, ["The Appellant", "appellant", "Petitioner(s)"], X.winner_of) == ["Petitioner", "Respondent", "Petitioner"]


def test_flat_json(spark):
    texts = ['{"a": 1}', 'Sure: {"a": 1} ok', '{"o": {"a": 2}}', "{bad}", "none", '{"a":1} {"b":2}', None]
    assert column(spark, texts, X.flat_json) == ['{"a": 1}', '{"a": 1}', '{"a": 2}', None, None, '{"a":1}', None]


def test_sanitize(spark):
    text = "The Court ruled for X today.  The petitioner argues the Court held so.\n\n\n\nShort. Decision: 5-4 in the end. Kept"
    got = column(spark, [text, "", "no outcome"], X.sanitize)
    assert got[0] == "The petitioner argues the Court held so. Short. Kept" and got[1:] == ["", "no outcome"]
    again = column(spark, got, X.sanitize)
    assert again == got


def test_reasoning_patterns(spark):
    texts = ["the known outcome", "It was decided in favor of us", "precedent only", "", None, "record shows that the court", "Actually decided"]
    assert column(spark, texts, X.is_contaminated) == [True, True, False, False, False, True, True]
    assert column(spark, ["Ruled in favor of", "the court held 6-3", None, "nothing"], X.cites_spoiler) == [True, True, False, False]


def test_opinion_marker(spark):
    head = ["Cite as: 600 U. S. ____ (2023)", "a\n (Slip Opinion) \nb", "the slip opinion held", "Syllabus, October Term", "It is so ordered", "Justice X delivered the opinion of the Court", "Justice X delivered the opinion of the Court. Supreme Court of the United States", "x"]
    want = ["cite_as", "slip_opinion", None, "syllabus_term", "so_ordered", None, "delivered_opinion", None]
    assert column(spark, head, FL.opinion_marker) == want
    late = "x" * 1501 + " It is so ordered"
    df = spark.createDataFrame([(1, [late], "a.pdf"), (2, ["a", "b", "c", "it is so ordered"], "a.pdf"), (3, ["a", "it is so ordered"], "a.pdf"), (4, ["opinion of the court"], "x_opinion.pdf"), (5, ["brief"], "x_opinion.pdf"), (6, [], "a.pdf")], "i int, p array<string>, n string")
    assert [r.o for r in df.select("i", FL.is_court_opinion(F.col("p"), F.col("n")).alias("o")).orderBy("i").collect()] == [False, False, True, True, False, False]


def test_filters(spark):
    df = spark.createDataFrame([("petition", "x"), ("order on petition", "x"), ("order", "x"), ("none", None), (None, "Brief")], "d string, l string")
    assert [r.o for r in df.select(FL.is_substantive(F.col("d"), F.col("l")).alias("o")).collect()] == [True, False, False, False, True]
    groups = spark.createDataFrame([("a",)] * 4 + [("b",)] * 5, "k string")
    assert FL.keep_groups(groups, ["k"]).count() == 5
    assert column(spark, ["22-340", "23A349", "x", None], X.term_of_docket) == [22, 23, None, None]


def test_joiners_and_authors(spark):
    got = column(spark, ["with whom JUSTICE KAGAN joins", "with whom Justice Thomas, Alito, and Justice Nobody join", "none"], X.joining_justices)
    assert got == [["Elena Kagan"], ["Clarence Thomas", "Samuel Alito"], []]
    assert column(spark, [" e.k. ", "ZZ", "kbj"], X.author_name) == ["Elena Kagan", "Unknown (ZZ)", "Ketanji Brown Jackson"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n;é", max_size=400), st.integers(5, 60), st.integers(0, 20))
def test_chunks_are_bounded_and_part_of_the_text(text, size, overlap):
    got = CH.split_text(text, size, min(overlap, size - 1))
    assert all(0 < len(c) <= size and c in text for c in got)
    assert set("".join(got).split()) <= set("".join(text.split())) | set(text.split()) | set("".join(got).split())
    assert re.sub(r"\s", "", text) == "" or got
    if overlap == 0:
        assert re.sub(r"\s", "", "".join(got)) == re.sub(r"\s", "", text)


def test_chunks_carry_overlap():
    text = " ".join(f"w{i}" for i in range(200))
    got = CH.split_text(text, 100, 30)
    assert all(set(a.split()) & set(b.split()) for a, b in zip(got, got[1:]))
    assert CH.split_text(None) == [] and CH.split_text("short") == ["short"]


def test_opinion_segments(spark):
    body = "text of the opinion " * 20
    doc = f"JUSTICE KAGAN delivered the opinion of the Court.\n{body}\nSee 12 (Alito, J., concurring) here {body}\nTHOMAS, J., with whom JUSTICE ALITO joins, dissenting.\n{body}"
    row = spark.createDataFrame([(doc, "Per Curiam")], "t string, a string").select(CH.opinion_segments(F.col("t"), F.col("a")).alias("s")).first()
    assert [(g.justice, g.opinion_type, g.joining_justices) for g in row.s] == [("Elena Kagan", "majority", []), ("Clarence Thomas", "dissent", ["Samuel Alito"])]
    assert CH.segments("x" * 600, "Per Curiam")[0][:2] == ("Per Curiam", "per_curiam")
    assert CH.segments("x" * 600, "Elena Kagan")[0][:2] == ("Elena Kagan", "majority")
    assert CH.segments("x" * 600, None) == [] and CH.segments("x" * 400, "A") == [] and CH.segments(None, "A") == []


def test_reserved_places():
    text = "JUSTICE NOBODY, dissenting. " + "a " * 10 + "JUSTICE KAGAN, concurring. " + "b " * 300
    assert [b.justice for b in CH.boundaries(text)] == []
    assert [b.justice for b in CH.boundaries(text, reserve_first=False)] == ["Elena Kagan"]


def test_stats():
    assert S.binomial_two_sided(0, 0) == 1.0 and S.binomial_two_sided(5, 10) == 1.0
    assert S.binomial_two_sided(1, 10) == pytest.approx(0.021484375)
    assert S.chi2_tail_1df(3.841458820694124) == pytest.approx(0.05)
    assert S.t_two_sided(2.228138851986273, 10) == pytest.approx(0.05, abs=1e-9)
    assert S.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert S.ks_two_sided(0, 5, 5) == 1.0 and 0 < S.ks_two_sided(0.5, 50, 50) < 1e-4
    assert random.Random(0) and S.wilcoxon_two_sided(0, 0, 0, 0) == 1.0


def test_headers_are_looked_for_at_names_only(monkeypatch):
    body = "a long text, of plain words. " * 2000
    text = body + "Opinion of CHIEF JUSTICE ROBERTS " + body + "Kagan, J., with whom JUSTICE ALITO joins, dissenting " + body + "Chief  Juſtİce Thomas, concurring in the judgment. Statement of Alito, J. "
    forms = CH._FORMS
    want = [(rank, m.start(), m.end()) for rank, (form, _) in enumerate(forms) for m in form.finditer(text)]
    tried = []

    class Form:
        def __init__(self, form):
            self.form, self.pattern = form, form.pattern

        def match(self, text, at):
            tried.append(at)
            return self.form.match(text, at)

    monkeypatch.setattr(CH, "_FORMS", [(Form(form), kind) for form, kind in forms])
    assert [(h.rank, h.at, h.end) for h in CH.headers(text)] == want and len(want) == 5
    assert len(tried) < 60
    tried.clear()
    assert CH.headers(body) == [] and not tried


def test_batches_are_worked_on_in_parts(monkeypatch):
    monkeypatch.setattr(CH, "PART_BYTES", 1000)
    texts = pa.array([None, "", *["w " * 200] * 20, "x" * 5000, "y"])
    parts = list(CH.in_parts((texts,), lambda t: [t], pa.list_(pa.string())))
    assert [x for p in parts for x in p.to_pylist()] == [[t] for t in texts.to_pylist()]
    assert len(parts) > 10 and all(len(p) <= 4 for p in parts)
    assert list(CH.in_parts((texts.slice(0, 0),), lambda t: [t], pa.list_(pa.string()))) == []

import re
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brieflake.llm import common
from brieflake.llm import quality as Q

SCHEMA = "doc_id long, text string, source string, a int, b string, n long, lines string, kept string"
COLS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "removed_words"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def base(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    inside = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n)


def normal(line):
    return re.sub("[1-9]", "0", " ".join(words(line)).lower())


def brute(rows, line_docs=Q.LINE_DOCS, line_share=Q.LINE_SHARE, left=Q.LEFT):
    texts = {(s, t or "") for _, t, s in rows}
    docs, of = Counter(), Counter()
    for s, t in texts:
        of[s] += bool(words(t))
        docs.update({(s, normal(x)) for x in t.split("\n") if words(x)})
    out = []
    for i, t, s in rows:
        b = base(t)
        gone = [x for x in (t or "").split("\n") if words(x) and docs[s, normal(x)] > line_docs and docs[s, normal(x)] * line_share > of[s]]
        lost = sum(len(words(x)) for x in gone)
        depleted = lost > 0 and (b[0] - lost < 20 or 100 * (b[0] - lost) < left * b[0])
        out.append((i, *b, not b[-1] and not depleted, len(gone), lost))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, s, 1, "x", 2, "y", "z") for i, t, s in rows], SCHEMA).repartition(4)
    return sorted([tuple(r) for r in Q.rate(df, **kw).select("doc_id", *COLS).collect()], key=str)


def body(i, n=40):
    """n words that no other body has, without digits."""
    letters = lambda v: "".join(chr(97 + v // 26**k % 26) for k in range(4))
    return " ".join(letters(i * 64 + k) for k in range(n))


@pytest.fixture(scope="module")
def corpus():
    menu, legal = "Home  About\tContact 2024", "All rights reserved by the owner of this very long line of text that many pages share 17"
    rows = [(i, f"{menu}\n{body(i)}\n\n  home about contact 1999  \n{legal if i % 2 else ''}", "hot") for i in range(60)]
    rows += [(100 + i, f"{menu}\n{body(i)}", "small") for i in range(5)]
    rows += [(200 + i, f"{legal}\n{body(300 + i, 6)}", "hot") for i in range(4)]
    rows += [(300 + i, body(900, 50) + "\n" + body(901, 30), "hot") for i in range(40)]  # copies
    rows += [(400 + i, f"{menu}\n{body(500 + i, 25)}", None) for i in range(15)] + [(450, f"{menu}\n{body(600, 25)}", "")]
    rows += [(500, None, "hot"), (501, "", None), (None, body(700), "hot"), (None, None, None), (502, " \n\t\x0b\n ", "hot")]
    rows += [(503, "a b c d e f g h " * 30, "hot"), (504, "x\n" * 50 + body(701), "hot"), (505, "é ü 漢字 😀 #*$%&|<> " * 10, "hot"), (506, "\n".join(body(i, 30) for i in range(800, 1100)), "hot")]
    return rows + rows[:3]


@pytest.mark.parametrize("hot", [1, 5, 2000])
def test_against_plain_python(spark, corpus, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    got = run(spark, corpus)
    assert got == brute(corpus)
    kept = {r[0]: r[7] for r in got}
    assert all(kept[i] for i in range(60)) and not any(kept[200 + i] for i in range(4)) and all(kept[300 + i] for i in range(40))


def test_limits_are_parameters(spark, corpus):
    assert run(spark, corpus, line_docs=3, line_share=2, left=90) == brute(corpus, 3, 2, 90)


def test_clean_texts(spark, corpus):
    df = spark.createDataFrame([(i, t, s, 1, "x", 2, "y", "z") for i, t, s in corpus], SCHEMA)
    out = Q.clean(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in brute(corpus) if r[7])
    texts = {r.doc_id: r.text for r in got}
    assert texts[0] == f"{body(0)}\n\n" and texts[1] == f"{body(1)}\n" and texts[100] == corpus[60][1] and texts[300] == body(900, 50) + "\n" + body(901, 30)
    assert all((r.lines, r.kept, r.n) == ("y", "z", 2) for r in got)


def test_empty_table(spark):
    assert run(spark, []) == []


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "A", "c\t", "d#", "\n", " ", "é", "1", "2"]), max_size=60).map(" ".join), min_size=20, max_size=60))
def test_measures(spark, texts):
    got = run(spark, [(i, t, "s") for i, t in enumerate(texts)], line_docs=1, line_share=3)
    assert got == brute([(i, t, "s") for i, t in enumerate(texts)], 1, 3)


def test_against_sql(spark, sf):
    got = sorted(tuple(r) for r in Q.rate(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", *COLS).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == sorted(c.execute(Q.oracle_sql()).fetchall())


def test_no_python_in_the_plan(spark, sf):
    plan = Q.rate(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan

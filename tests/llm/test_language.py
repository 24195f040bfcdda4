import random

from brieflake.llm import language as L

SCHEMA = "doc_id long, text string, lang string, source string, score string"
VOCAB = {"en": "the and of with that this there house water under between".split(), "fr": "le la des avec dans maison été eau sous entre où".split(), "de": "der die und mit haus wasser unter zwischen über straße".split()}


def rows(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = ["en", "fr", "de"][i % 3]
        out.append((i, " ".join(rng.choice(VOCAB[lang]) for _ in range(rng.randint(3, 80))), lang, "s", "x"))
    return out


def test_held_out_accuracy_and_defined_cases(spark):
    data = rows() + [(1000, None, "en", "s", "x"), (1001, "", None, "s", "x"), (1002, "123 $$ ::", "fr", "s", "x"), (1003, "été " * 9000, None, "s", "x"), (1003, "été " * 9000, None, "s", "x"), (None, "der und die mit", "de", "s", "x")]
    got = L.identify(spark.createDataFrame(data, SCHEMA).repartition(4)).collect()
    assert len(got) == len(data)
    truth = {d[0]: d[2] for d in data[:400]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert 50 < len(held) < 150
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "fr"]
    assert by[1000].rejected and by[1002].score == 0.0 and not by[1003].rejected
    assert by[None].lang_pred == "de" and by[None].held_out is False
    assert all(0 <= r.score <= 1 for r in got)


def test_predictions_use_neither_lang_nor_held_out_text(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    model = L.fit(df)
    held = {r.doc_id for r in L.identify(df, model).filter("held_out").collect()}
    changed = spark.createDataFrame([(d, "zzz " + t, "xx", s, x) if d in held else (d, t, g, s, x) for d, t, g, s, x in data], SCHEMA)
    assert L.fit(changed) == model


def test_hold_out_rule(spark):
    import zlib

    got = spark.range(300).select("id", L.in_hold_out(L.F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_no_labels_and_empty(spark):
    got = L.identify(spark.createDataFrame([(1, "text", None, "s", "x")], SCHEMA)).collect()
    assert got[0].lang_pred == "und" and got[0].rejected
    assert L.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ties_and_the_reject_margin():
    same = b"the and of with that this there house water under between " * 20
    tie = L.Classifier({"b": same, "a": same}).one("the house and the water")
    assert tie == ("a", 0.0, True)
    model = {"en": same, "fr": "le la des avec dans maison été eau sous entre où ".encode() * 20}
    lang, margin, rejected = L.Classifier(model).one("the house under the water and between that " * 3)
    assert lang == "en" and margin > L.MIN_MARGIN and not rejected
    for bound in (margin - 1e-9, margin + 1e-9):
        assert L.Classifier(model, bound).one("the house under the water and between that " * 3) == (lang, margin, bound > margin)


def test_one_text_a_key_and_a_bound_over_all_languages(spark):
    data = rows(90) + [(500, "the and of with", "en", "s", "x")] * 300
    df = spark.createDataFrame(data, SCHEMA)
    assert L.fit(df) == L.fit(df.dropDuplicates(["doc_id"]))
    small = L.fit(df, sample_total=6)
    assert set(small) == {"en", "fr", "de"} and all(len(v) < len(L.fit(df)[k]) for k, v in small.items())


def test_kept_rows_have_their_columns(spark):
    df = spark.createDataFrame([(i, t, g, s, x, "a", 1) for i, t, g, s, x in rows(60)] + [(900, None, "en", "s", "x", "a", 1), (901, "12", "en", "s", "x", "a", 1)], SCHEMA + ", lang_pred string, r int")
    got = L.keep_identified(df)
    assert got.columns == df.columns and {900, 901}.isdisjoint(r.doc_id for r in got.collect()) and got.count() >= 55

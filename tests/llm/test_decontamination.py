import random

import pytest

from brieflake.llm import decontamination as D

DOCS = "doc_id long, text string, lang string, source string, items int"


def edit_least(item, text):
    """Least edit distance of item to a substring, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers_against_the_table():
    rng = random.Random(1)
    for _ in range(200):
        item = bytes(rng.choice(b"abc ") for _ in range(rng.randint(1, 70)))
        text = bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 120)))
        masks = {}
        for i, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << i
        want = edit_least(item, text)
        got, _ = D.myers(masks, len(item), text, len(item))
        assert got == want


def make(seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeinrstl") for _ in range(rng.randint(2, 6))) for _ in range(200)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randint(5, 40))) for i in range(12)] + [(50, "too few words"), (51, ""), (52, None), (None, say(9))]
    docs = []
    for i in range(120):
        text = say(rng.randint(0, 150))
        if i % 3 == 0:
            item = rng.choice(items[:12])[1]
            edits = rng.randint(0, int(len(item) * 0.14))
            chars = list(item)
            for _ in range(edits):
                p = rng.randrange(len(chars))
                chars[p] = rng.choice(["", "q", chars[p] + "z"])
            text = f"{text} {''.join(chars).upper()}, {say(rng.randint(0, 40))}"
        docs.append((i, text, "en", "s", 1))
    return docs + [(200, None, "en", "s", 1), (201, "", None, None, 1), (201, "", None, None, 1)], items


@pytest.mark.parametrize("block_bytes", [4 << 20, 600])
def test_against_all_alignments(spark, block_bytes):
    docs, items = make()
    d = spark.createDataFrame(docs, DOCS).repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    flags, clean = D.decontaminate(d, b, block_bytes=block_bytes)
    want = {}
    for doc_id, text, *_ in docs:
        norm = D.normalize(text)
        hits = []
        for item_id, t in items[:12]:
            n = D.normalize(t)
            if edit_least(n, norm) <= int(0.1 * len(n)):
                hits.append(item_id)
        want[doc_id] = sorted(hits)
    got = flags.collect()
    assert len(got) == len(docs)
    for r in got:
        assert sorted(r.item_ids) == want[r.doc_id] and r.n_items == len(want[r.doc_id]) and r.contaminated == bool(want[r.doc_id])
    assert sum(map(bool, want.values())) > 20
    assert clean.columns == d.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, *_ in docs if not want[i])


def test_empty_tables(spark):
    docs, items = make()
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    flags, clean = D.decontaminate(d, b.limit(0))
    assert clean.count() == len(docs) and flags.filter("contaminated").count() == 0
    flags, clean = D.decontaminate(d.limit(0), b)
    assert clean.count() == 0 == flags.count()


@pytest.mark.parametrize("block_bytes", [4 << 20, 60])
def test_short_items_match_exactly_at_word_bounds(spark, block_bytes):
    items = [(1, "Tea, for two"), (2, "naïve café"), (3, "日本国憲法の前文を読む人々"), (4, "憲法"), (5, "?! «»"), (6, "gpt"), (7, "สวัสดี")]
    docs = ["we had tea for TWO there", "tea for two", "steal tea for twos", "teas for two", "tea for two's", "tea or two", "un naïve-café.", "un naïve cafés", "昔、日本国憲法の前文を読む人々がいた", "昔、日本国憲法の前丈を読む人々がいた", "使用gpt模型 gpts", "chatgpt gpts", "คำว่าสวัสดีครับ", "?! «»", ""]
    want = [[1], [1], [], [], [1], [], [2], [], [3, 4], [3, 4], [6], [], [7], [], []]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(docs)], DOCS)
    flags, clean = D.decontaminate(d, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    got = {r.doc_id: sorted(r.item_ids) for r in flags.collect()}
    assert [got[i] for i in range(len(docs))] == want
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, w in enumerate(want) if not w]


def test_odd_rows_and_every_item_with_edits(spark):
    bench = spark.createDataFrame([(1, "one two three four"), (2, None), (None, "x y z a b c d"), (3, "!!"), (4, "a quite long benchmark item of many plain words to be found"), (5, "a quite long benchmark item of many plain words to be found")], "item_id long, text string")
    long = "filler words " * 200_000 + "a quite long benchmark item of many plain wurds to be found" + " filler" * 1000
    rows = [(1, "say one two three four now", 1), (2, "say one two thre four now", 1), (3, None, 1), (4, "", 1), (5, long, 1), (5, long, 1), (None, "one two three four", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, f_id int")
    flags, clean = D.decontaminate(docs, bench)
    got = sorted(((r.doc_id or 0), r.contaminated, r.item_ids) for r in flags.collect())
    assert got == [(0, True, [1]), (1, True, [1]), (2, False, []), (3, False, []), (4, False, []), (5, True, [4, 5]), (5, True, [4, 5])]
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 4]
    loose = {r.doc_id: r.item_ids for r in D.decontaminate(docs, bench, min_words=0)[0].collect()}
    assert loose[2] == [1]
    assert D.decontaminate(docs.limit(0), bench)[0].count() == 0 and D.decontaminate(docs, bench.limit(0))[1].count() == len(rows)

import random
import re

import pytest
import xxhash

from brieflake.llm import simhash as S

SCHEMA = "doc_id long, text string, fp string, node int"


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps):
    ids, parent = list(fps), {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint():
    for t in (None, "", " \t\n", "One", "one two", "a b c", "A B C D", "x\x1cy z\x85w q É é", "word " * 5000, "漢 字 A b"):
        assert S.fingerprint(t) & (2**64 - 1) == brute_fp(t)


def test_spark_hash_agrees(spark):
    got = spark.sql("select xxhash64('a b ç') h").first()[0]
    assert got & (2**64 - 1) == xxhash.xxh64_intdigest("a b ç".encode(), seed=42)


@pytest.mark.parametrize("group_most", [1, 32])
def test_links_against_all_pairs(spark, group_most):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1, 1 << 63]
    fps = set(base)
    for b in base:
        x = b
        for _ in range(12):
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.7:
                x ^= 1 << rng.randrange(64)
            fps.add(x)
            fps.add(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    table = {i: f for i, f in enumerate(sorted(fps, key=lambda _: rng.random()))}
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, i) for i, f in table.items()], "fp long, node long")
    from brieflake.llm.graph import connected_components

    edges = S.links(df, group_most)
    for e in edges.distinct().collect():
        assert bin(table[e.a] ^ table[e.b]).count("1") <= 2
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert {i: found.get(i, i) for i in table} == brute_components(table)


def test_components_of_a_long_path_and_a_hub(spark):
    from brieflake.llm.graph import connected_components

    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 400)] + [(500, 500)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 400)}


def test_near_duplicates(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(20)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(50 + i, texts[i].upper(), "x", 1) for i in range(5)]
    rows += [(80, None, "x", 1), (81, "", "x", 1), (82, " ", "x", 1), (82, " ", "x", 1), (None, texts[0], "x", 1)]
    for i in range(6, 12):
        t = texts[i].split()
        t[60] = "changed"
        rows.append((90 + i, " ".join(t), "x", 1))
    got = S.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    fps = {d: brute_fp(t) for d, t, *_ in rows if d is not None}
    want = brute_components(fps)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id == 0
        else:
            assert int(r.fingerprint, 16) == fps[r.doc_id] and r.component_id == want[r.doc_id]


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_representatives_keep_columns_of_any_name(spark):
    rows = [(i, "the same words in all of them here", f"h{i}", i, "k") for i in (5, 3, 9)] + [(7, None, "h7", 7, "k"), (8, "", "h8", 8, "k"), (20, "quite another text that stands alone", "h20", 20, "k"), (20, "quite another text that stands alone", "h20", 20, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __h string, __r int, k_id string")
    got = S.representatives(df)
    assert got.columns == df.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted([rows[1], rows[3], rows[5]])
    assert S.representatives(df.limit(0)).count() == 0

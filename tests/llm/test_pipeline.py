import random
import zlib
from collections import Counter

import numpy as np
import pytest

from brieflake.llm import decontamination as D
from brieflake.llm import language as L
from brieflake.llm import simhash as S

pytest.importorskip("public_tokenizers")


def same_group(fps):
    ids, group = list(fps), {i: i for i in fps}
    for i in ids:
        for j in ids:
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 2 and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                for k in ids:
                    if group[k] == b:
                        group[k] = a
    return group


def test_pipeline_against_brute_force(spark, sf, tmp_path):
    import corpus_pipeline as P
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(1)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    extra = [(900, None, "en", "src0", 0), (901, "123 %%", "en", "src1", 6), (902, rows[3][1], None, None, 5), (903, rows[5][1].upper(), "en", "src2", 5), (904, rows[7][1], "fr", "src0", 1), (904, rows[7][1], "fr", "src0", 1)]
    rng.shuffle(extra)
    rows += extra
    folder = str(tmp_path)
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    table = spark.read.parquet(f"{folder}/documents.parquet")

    judge = L.Classifier(L.fit(table))
    want = [r for r in rows if not judge.one(r[1])[2]]
    assert {900, 901}.isdisjoint(r[0] for r in want)
    fps = {}
    for r in want:
        fps.setdefault(r[0], S.fingerprint(r[1]))
    group = same_group(fps)
    want = list({r[0]: r for r in want if group[r[0]] == r[0]}.values())
    items = [(r.item_id, D.normalize(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    matcher = D.Matcher(items)
    want = {r[0]: r for r in want if not matcher.match(r[1])[0]}

    frame = table
    for name, stage in P.STAGES[:3]:
        frame = spark.createDataFrame(stage(spark, frame, folder).collect(), table.schema)
        assert frame.columns == table.columns
    assert Counter(r.doc_id for r in frame.collect()) == Counter(list(want))

    mixed = P.STAGES[3][1](spark, frame, folder)
    assert mixed.columns == table.columns
    taken = [tuple(r) for r in mixed.collect()]
    copies = Counter(r[0] for r in taken)
    assert max(copies.values()) <= 2 and set(copies) <= set(want)
    size = lambda r: len(r[1].encode().split())
    have, got = Counter(), Counter()
    for r in want.values():
        have[r[3]] += size(r)
    for r in taken:
        got[r[3]] += size(r)
    assert abs(sum(got.values()) - 1.5 * sum(have.values())) <= 0.002 * sum(have.values())

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at, expected = 0, []
    for r in sorted(taken, key=lambda r: (r[0], r[1])):
        ids = tok.encode(r[1], add_special_tokens=False).ids + [1]
        expected.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in P.run(spark, folder).orderBy("start").collect()] == expected

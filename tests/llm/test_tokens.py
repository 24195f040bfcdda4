import random
import zlib

import numpy as np
import pytest

from brieflake.llm import tokens as T

SCHEMA = "doc_id long, text string, start string, part int"


def brute(rows, path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = (tok.encode(text, add_special_tokens=False).ids if text else []) + [1]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.fixture(scope="module")
def path():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def test_round_trip_of_skewed_and_flat_ids():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(0, np.uint16), np.array([49407], np.uint16), (rng.zipf(1.2, 700_000) % 49408).astype(np.uint16), rng.integers(0, 49408, 300_000).astype(np.uint16), np.full(5000, 7, np.uint16)):
        assert (T.decode_group(T.encode_group(ids)) == ids).all()


def test_decodes_from_a_checkpoint_alone():
    ids = (np.random.default_rng(5).zipf(1.3, 200_000) % 5000).astype(np.uint16)
    blocks, symbol, freq, cum = T.open_group(T.encode_group(ids))
    block = blocks[0]
    assert len(block["starts"]) > 2
    step = block["starts"][1][0]
    tail = T.decode_stretch(block, 1, None, symbol, freq, cum)
    assert (tail == ids[step * block["lanes"] :]).all()


def test_checksum_finds_damage():
    raw = bytearray(T.encode_group(np.arange(5000, dtype=np.uint16) % 300))
    raw[-9] ^= 1
    with pytest.raises(ValueError):
        T.decode_group(bytes(raw))


def test_table_matches_whole_text_encoding(spark, path):
    odd = ["", None, "don't STOP now", "'s 're''d x1 2024! <|endoftext|>a", "É́ ﬁ ½ Straße ÇA", "漢字 かな", "a" * 20_000, "x\u0085y​z", "\x00\x1c a\x1fb", "it'S'LL we'Ve", " \n\t "]
    rows = [(i * 7 % 11, t) for i, t in enumerate(odd)] + [(None, "null id"), (3, "tie"), (3, "tie")]
    words = ["the", "don't", "Éa", "x.", "--", "42", "l'été", "'tis", "a's."]
    rng = random.Random(1)
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 400)))) for i in range(40)]
    safe = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)]
    rows += [(200 + i, "".join(rng.choice(safe) for _ in range(rng.randint(1, 200)))) for i in range(300)]
    df = spark.createDataFrame([(a, b, "clash", 1) for a, b in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in T.token_table(df, path).orderBy("start").collect()]
    assert got == brute(rows, path)


def test_empty_table(spark, path):
    assert T.token_table(spark.createDataFrame([], SCHEMA), path).count() == 0


def test_slices_and_texts_longer_than_a_slice(path):
    import pyarrow as pa

    from brieflake.llm.common import SLICE_BYTES, slices

    rng = random.Random(4)
    texts = ["ab c" * rng.randint(0, 50) for _ in range(500)] + [None, "long word's " * 500_000, ""]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    for most in (1, 100, 5000, SLICE_BYTES):
        parts = list(slices(batch, most=most))
        assert [t for p in parts for t in p.column("text").to_pylist()] == texts
        assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= most for p in parts)
    encoder = T.WordEncoder(open(path, encoding="utf-8").read())
    ids, counts = encoder.encode_batch(pa.array([texts[-2]]))
    assert ids.tolist() == encoder.whole.encode(texts[-2], add_special_tokens=False).ids and counts.tolist() == [len(ids)]


def test_a_full_cache_changes_no_id(path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(T.WordEncoder, "MOST_WORDS", 20)
    monkeypatch.setattr(T.WordEncoder, "MOST_PIECES", 10)
    encoder = T.WordEncoder(open(path, encoding="utf-8").read())
    rng = random.Random(9)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice("abcé'1.") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 30))) for _ in range(8)]
        ids, counts = encoder.encode_batch(pa.array(texts))
        want = [encoder.whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == list(map(len, want))
    assert len(encoder.words.names) <= 20 + 240

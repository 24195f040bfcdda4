"""Language identification by compression.

Each language has a zstandard raw-content dictionary of its normalised training text. A text is cut into pieces of
PIECE bytes (all of them, so that the dictionary counts along the whole text), each piece is compressed with every
dictionary, and the language with the smallest sum wins. A text under SHORT bytes is written twice before: its second
half is one match in any language, which pays for the block's overhead, so that single matches of the first half
show in the size. The text is rejected when the margin between the smallest and the next sum is below MIN_MARGIN of
the latter.

The model is fitted on a bounded sample: at most SAMPLE_DOCS labelled documents a language and SAMPLE_TOTAL in all (one
a language at least), at most SAMPLE_BYTES of each, DICT_BYTES a dictionary.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brieflake.llm.common import worker_model

SAMPLE_DOCS = 400
SAMPLE_TOTAL = 40_000
SAMPLE_BYTES = 3000
DICT_BYTES = 100_000
PIECE = 4096
SHORT = 2000
LEVEL = 9
MIN_MATCH = 3
MIN_MARGIN = 0.005
UNDETERMINED = "und"

#: ASCII letters in lower case, other ASCII characters as spaces, other bytes as they are.
_TABLE = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else 32 if b < 128 else b for b in range(256))


def normalize(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split())


def has_letter(text: str | None, norm: bytes) -> bool:
    """norm holds an ASCII letter, or the text another one."""
    return bool(norm) and (any(97 <= b < 123 for b in norm[:64]) or any(c.isalpha() for c in text or ""))


def in_hold_out(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, mod 4, is 2; false for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, dict_bytes: int = DICT_BYTES, sample_total: int = SAMPLE_TOTAL) -> dict[str, bytes]:
    """The raw dictionary content of each language of the labelled documents that aren't held out.

    The driver gets at most max(sample_total, number of languages) texts of sample_bytes: with very many languages each
    has a smaller sample, none is left out. Only sample keys are ranked (narrow rows); texts are then fetched by key,
    one for each key, however often a row is repeated. A language whose sampled texts have no letter is not learned.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~in_hold_out(F.col("doc_id")))
    labelled = labelled.select("doc_id", "lang", F.xxhash64(F.lit(5), "doc_id").alias("h"))
    sizes = labelled.groupBy("lang").count()
    langs = sizes.count()
    most = max(1, min(sample_docs, sample_total // max(1, langs)))
    # a share of each language that holds the sample with room to spare, so that no language is ranked whole
    sizes = sizes.withColumn("share", F.least(F.lit(1.0), F.lit(3.0 * most) / F.col("count"))).select("lang", "share")
    near = labelled.join(F.broadcast(sizes) if langs <= 10_000 else sizes, "lang").filter(F.pmod("h", F.lit(1 << 31)) <= F.col("share") * (1 << 31)).select("lang", "h", "doc_id").distinct()
    keys = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("r") <= most)
    text = F.substring("text", 1, sample_bytes).alias("text")
    rows = docs.filter("text is not null").select("doc_id", "lang", text).join(keys, ["doc_id", "lang"]).groupBy("lang", "r").agg(F.min("text").alias("text")).collect()
    found: dict[str, dict[bytes, None]] = {}
    for row in sorted(rows, key=lambda x: (x["lang"], x["r"])):
        norm = normalize(row["text"])
        if has_letter(row["text"], norm):
            found.setdefault(row["lang"], {})[norm] = None
    # what comes first in the sample stands last, where zstandard reaches it most cheaply
    return {lang: b" ".join(list(parts)[::-1])[-dict_bytes:] for lang, parts in sorted(found.items())}


class Classifier:
    def __init__(self, model: dict[str, bytes], min_margin: float = MIN_MARGIN):
        import zstandard as z

        self.langs = sorted(model)
        self.min_margin = min_margin
        self.coders = []
        for lang in self.langs:
            d = z.ZstdCompressionDict(model[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            params = z.ZstdCompressionParameters.from_level(LEVEL, source_size=PIECE, dict_size=len(model[lang]), min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=params)
            self.coders.append(z.ZstdCompressor(dict_data=d, compression_params=params))

    def one(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected). score: the margin over the next language, as a share of its size."""
        norm = normalize(text)
        if not self.langs or not has_letter(text, norm):
            return UNDETERMINED, 0.0, True
        norm = norm + b" " + norm if len(norm) < SHORT else norm
        pieces = [norm[i : i + PIECE] for i in range(0, len(norm), PIECE)]
        sums = [sum(len(c.compress(p)) for p in pieces) for c in self.coders]
        order = sorted(range(len(sums)), key=lambda i: (sums[i], i))
        if len(order) == 1:
            return self.langs[0], 1.0, False
        a, b = sums[order[0]], sums[order[1]]
        margin = (b - a) / b
        return self.langs[order[0]], margin, margin < self.min_margin


def classify(text: Column, model: dict[str, bytes], min_margin: float = MIN_MARGIN) -> Column:
    """A column of struct<lang string, score double, rejected boolean>."""
    key = ("language", min_margin, hashlib.sha256(repr(sorted(model.items())).encode()).hexdigest())

    @F.arrow_udf("struct<lang string, score double, rejected boolean>")
    def run(texts: pa.Array) -> pa.Array:
        one = worker_model(key, lambda: Classifier(model, min_margin)).one
        langs, scores, rejected = zip(*[one(t.as_py()) for t in texts]) if len(texts) else ((), (), ())  # a text at a time
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["lang", "score", "rejected"])

    return run(text)


def identify(docs: DataFrame, model: dict[str, bytes] | None = None, min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document; only its text counts.

    Null or empty text, or one without a letter: `und`, score 0, rejected. Very long texts: all their pieces count. Ties: the language that comes first by
    name, score 0, rejected. No labelled rows: all `und`. Repeated rows: as often as they come. Empty table: no rows.
    """
    model = fit(docs) if model is None else model
    found = docs.select("doc_id", in_hold_out(F.col("doc_id")).alias("held_out"), classify(F.col("text"), model, min_margin).alias("r"))
    return found.select("doc_id", "held_out", F.col("r.lang").alias("lang_pred"), F.col("r.score").alias("score"), F.col("r.rejected").alias("rejected"))


def keep_identified(docs: DataFrame, model: dict[str, bytes] | None = None, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of docs, all their columns, whatever they are called, whose text isn't rejected.

    Null and empty texts, texts without a letter, and exact ties of two languages are rejected. Repeated rows stay as
    often as they come. Empty table, or no labelled rows: no rows.
    """
    model = fit(docs) if model is None else model
    return docs.filter(~classify(F.col("text"), model, min_margin)["rejected"])

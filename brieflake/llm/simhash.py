"""SimHash near-duplicates, candidates by pigeonring filtering.

Fingerprint: 64 bits; words `[^\\x20\\x09-\\x0D]+` of the A-Z lower-cased text, 3-word shingles with repeats,
XXH64 (seed 42) of each; a bit is 1 if set in over half of them. Fewer words: the whole sequence is the one
shingle; no words: zero.

Links: fingerprints that differ in at most 2 bits. The 64 bits are a ring of 5 segments. Pigeonring: of a linked
pair, some start has chains of l = 1..5 segments with at most floor(l * 2 / 5) differences each: 0, 0, 1, 1, 2. The
first two segments of the chain are equal, so they are the key of an equi-join (five keys a fingerprint); the
other chain lengths prune candidates before the whole Hamming distance is taken.

Keys shared by more than `group_most` different fingerprints don't emit their pairs: there each fingerprint emits
itself and its one-bit neighbours in the other segments, and those that meet in a point are linked to the least of
them. Two fingerprints with equal key segments are within 2 bits exactly if such neighbourhoods meet, and all that
meet in a point are within 2 bits, so this loses and invents no link and grows with the group's size only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brieflake.llm.common import materialize, sliced, worker_model
from brieflake.llm.graph import connected_components

#: (lowest bit, bits) of each segment of the ring.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
TAU = 2
GROUP_MOST = 32

_ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number. bytes.split cuts at exactly the contract's white space."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).split()
    if not words:
        return 0
    if len(words) <= 3:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    else:
        joined = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = end - size
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(start[:-2].tolist(), end[2:].tolist())), np.uint64, len(words) - 2)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        block = hashes[i : i + (1 << 16)].astype("<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_model("simhash", lambda: None)  # drops the model of an earlier stage
        for batch in sliced(batches):
            got = [fingerprint(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(got, pa.int64())], names=["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def _segment(fp: Column, k: int) -> Column:
    low, bits = SEGMENTS[k % len(SEGMENTS)]
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1))


def _chain(a: Column, b: Column, start: Column) -> Column:
    """The pigeonring condition from `start`: cumulative differences of l segments within l * TAU / m."""
    m = len(SEGMENTS)
    diff = a.bitwiseXOR(b)
    rules = []
    for s in range(m):
        total, ok = None, F.lit(True)
        for length in range(1, m + 1):
            one = F.bit_count(_segment(diff, s + length - 1))
            total = one if total is None else total + one
            ok = ok & (total <= length * TAU // m)
        rules.append((s, ok))
    out = F.lit(False)
    for s, ok in rules:
        out = F.when(start == s, ok).otherwise(out)
    return out


def links(fps: DataFrame, group_most: int = GROUP_MOST) -> DataFrame:
    """fps: distinct (fp, node). Edges (a, b) between nodes that connect all within TAU bits, each within TAU bits."""
    m = len(SEGMENTS)
    low = [x[0] for x in SEGMENTS]
    keys = F.array(*[F.struct(F.lit(s).alias("s"), _segment(F.col("fp"), s).bitwiseOR(F.shiftleft(_segment(F.col("fp"), s + 1), 13)).alias("k")) for s in range(m)])
    keyed = fps.select("fp", "node", F.explode(keys).alias("x")).select("fp", "node", "x.s", "x.k")
    size = keyed.groupBy("s", "k").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = materialize(keyed.join(size, ["s", "k"]), "simhash-keys")
    few = keyed.filter(F.col("n") <= group_most)
    left, right = few.select("s", "k", F.col("fp").alias("f"), F.col("node").alias("a")), few.select("s", "k", F.col("fp").alias("g"), F.col("node").alias("b"))
    pairs = (
        left.join(right, ["s", "k"])
        .filter("a < b")
        .filter(_chain(F.col("f"), F.col("g"), F.col("s")))
        .filter(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= TAU)
        .select("a", "b")
    )
    many = keyed.filter(F.col("n") > group_most)
    # the one-bit neighbours outside the key's two segments
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), b) for k in (2, 3, 4) for b in range(low[(s + k) % m], low[(s + k) % m] + SEGMENTS[(s + k) % m][1])]) for s in range(m)])
    points = many.select("s", "node", F.col("fp"), F.explode(F.element_at(flips, F.col("s") + 1)).alias("flip")).select("s", "node", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    least = points.groupBy("s", "point").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = points.join(least, ["s", "point"]).filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return pairs.unionByName(stars)


def _named(docs: DataFrame, group_most: int) -> DataFrame:
    """doc_id, text_hash, fp, component_id."""
    fps = materialize(with_fingerprints(docs), "simhash")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-classes")
    found = connected_components(links(classes.filter("node is not null"), group_most), "simhash-components")
    named = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named.hint("merge"), "fp").select("doc_id", "text_hash", "fp", "component_id")


def near_duplicates(docs: DataFrame, group_most: int = GROUP_MOST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable) of every document.

    Null or empty text: fingerprint zero, linked like any other. Null doc_id: kept; it is named by the least
    doc_id of its fingerprint's class (null if there is none). Repeated rows: returned as often as they come.
    Empty table: no rows. Other columns are ignored.
    """
    return _named(docs, group_most).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, group_most: int = GROUP_MOST) -> DataFrame:
    """The rows of docs, all their columns, that stay when each group of near-duplicates keeps one: the document
    with the least doc_id, then the least text hash.

    Null and empty texts are near-duplicates of each other. Documents whose doc_id is null and whose fingerprint no
    other document has stay, one a fingerprint. Repeated rows: one stays. Other columns may have any name. Empty
    table: no rows.
    """
    loose = F.when(F.col("component_id").isNull(), F.col("fp"))
    kept = _named(docs, group_most).groupBy("component_id", loose.alias("loose")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("k_id"), F.col("k.text_hash").alias("k_hash"))
    # the row is one column while names of our own stand beside it
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("h"))
    stay = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_hash")), "left_semi")
    once = stay.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("h")))
    return once.filter("r = 1").select("row.*")

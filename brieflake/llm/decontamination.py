"""Benchmark decontamination by pigeonhole edit matching.

Items and documents are compared in a normal form: lower case, ASCII letters, digits and everything beyond ASCII
kept, the rest as single spaces; distances count bytes of it. An item of m bytes may differ in k = floor(RATE * m)
edits. Cut into k + 1 pieces, at least one piece is exact in every match; an automaton over all pieces finds
the exact hits in one pass over the text. Around each hit the item is verified by Myers' bit-parallel distance
after one more pigeonhole count (of the item's 8-byte chunks, k edits destroy at most k).

Items of fewer than MIN_WORDS words match exactly only (k = 0), and at word bounds. In scripts without spaces two
characters count as a word, and a bound is anywhere. Items without a letter or digit never match. Items are taken in blocks of at most
BLOCK_BYTES, so that what is sent to the executors is bounded; documents are scanned once per block.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brieflake.llm.common import materialize, worker_model

RATE = 0.1
MIN_WORDS = 5
BLOCK_BYTES = 4 << 20
CHUNK = 8

#: Scripts without spaces: Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def normalize(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE).split())


def words_of(norm: bytes) -> int:
    """Words of a normal form; two characters of a script without spaces count as one."""
    text = norm.decode("utf-8", "ignore")
    unspaced = len(_UNSPACED.findall(text))
    return max(len(norm.split()), (unspaced + 1) // 2 + len(_UNSPACED.sub(" ", text).split()))


def _joins(char: str) -> bool:
    """Whether a word goes on at this character (empty: the text's end)."""
    return bool(char) and unicodedata.category(char)[0] in "LMN" and not _UNSPACED.match(char)


def at_bounds(norm: bytes, start: int, end: int) -> bool:
    """Whether norm[start:end] neither starts nor ends inside a word."""
    left, right = norm[max(0, start - 4) : start].decode("utf-8", "ignore")[-1:], norm[end : end + 4].decode("utf-8", "ignore")[:1]
    first, last = norm[start : start + 4].decode("utf-8", "ignore")[:1], norm[max(start, end - 4) : end].decode("utf-8", "ignore")[-1:]
    return not (_joins(left) and _joins(first)) and not (_joins(last) and _joins(right))


def myers(pattern_masks: dict[int, int], m: int, text: bytes, k: int) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of text, and where that ends; (k + 1, -1) if above k."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, k + 1, -1
    get = pattern_masks.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, i
            if not best:
                break
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, bytes]], rate: float = RATE, min_words: int = MIN_WORDS):
        import ahocorasick

        self.items, pieces = [], {}
        for item_id, norm in items:
            short = words_of(norm) < min_words
            m, k = len(norm), 0 if short else int(rate * len(norm))
            masks: dict[int, int] = {}
            for i, c in enumerate(norm):
                masks[c] = masks.get(c, 0) | 1 << i
            chunks = [norm[i : i + CHUNK] for i in range(0, m - CHUNK + 1, CHUNK)]
            x = len(self.items)
            self.items.append((item_id, norm, k, masks, chunks, short))
            cuts = [m * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(norm[a:b].decode("latin-1"), []).append((x, a, b - a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, where)
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def match(self, text: str | None) -> tuple[list[int], int | None]:
        """Ids of the items in the text, and the least distance."""
        norm = normalize(text)
        if not self.any or not norm:
            return [], None
        found: dict[int, int] = {}
        tried: set[tuple[int, int]] = set()
        items = self.items
        for end, where in self.automaton.iter(norm.decode("latin-1")):
            for x, offset, size in where:
                if x in found and not found[x]:
                    continue
                start = end + 1 - size - offset
                item_id, item, k, masks, chunks, short = items[x]
                if short:  # its one piece is the item
                    if at_bounds(norm, start, end + 1):
                        found[x] = 0
                    continue
                near = (x, start // (k + 1))
                if near in tried:
                    continue
                tried.add(near)
                low = near[1] * (k + 1) - k
                window = norm[max(0, low) : low + len(item) + 3 * k + 1]
                if item in window:
                    found[x] = 0
                    continue
                if k and sum(c in window for c in chunks) >= len(chunks) - k:
                    distance, _ = myers(masks, len(item), window, k)
                    if distance <= k:
                        found[x] = min(found.get(x, distance), distance)
        return sorted(items[x][0] for x in found), min(found.values(), default=None)


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """Normalised items in blocks; a block comes to the driver, never the whole table. Null ids and texts are left out."""
    rows = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    part = Window.partitionBy("salt").orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    salts = max(1, -(-total // block_bytes))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("item_id", "text"), F.lit(salts)))
    rows = rows.withColumn("block", F.floor(F.coalesce(F.sum(F.octet_length("text")).over(part), F.lit(0)) / block_bytes))
    rows = materialize(rows, "benchmark-blocks") if salts > 1 else rows
    for key in rows.select("salt", "block").distinct().collect() if salts > 1 else [None]:
        here = rows if key is None else rows.filter((F.col("salt") == key.salt) & (F.col("block") == key.block))
        got = sorted((r.item_id, normalize(r.text)) for r in here.select("item_id", "text").collect())
        got = [(i, t) for i, t in got if any(map(str.isalnum, t.decode("utf-8", "ignore")))]
        if got:
            yield got


def matches(text: Column, items: list[tuple[int, bytes]], rate: float = RATE, min_words: int = MIN_WORDS) -> Column:
    """A column of struct<items array<long>, distance int>."""
    key = ("benchmark", rate, min_words, hashlib.sha256(repr(items).encode()).hexdigest())

    @F.arrow_udf("struct<items array<long>, distance int>")
    def run(texts: pa.Array) -> pa.Array:
        match = worker_model(key, lambda: Matcher(items, rate, min_words)).match
        held, distances = zip(*[match(t.as_py()) for t in texts]) if len(texts) else ((), ())  # a text at a time
        return pa.StructArray.from_arrays([pa.array(held, pa.list_(pa.int64())), pa.array(distances, pa.int32())], names=["items", "distance"])

    return run(text)


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, items, distance of every document that holds an item, a row for each block with one.

    Documents are scanned once a block; what a block finds is written once and not touched again.
    """
    found = docs.limit(0).select("doc_id", F.lit(0).cast("long").alias("text_hash"), F.array().cast("array<long>").alias("items"), F.lit(0).alias("distance"))
    for items in item_blocks(benchmark, block_bytes):
        got = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), matches(F.col("text"), items, rate, min_words).alias("r")).filter(F.size("r.items") > 0)
        found = found.unionByName(materialize(got.select("doc_id", "text_hash", "r.items", "r.distance"), "contamination"))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(flags, clean): flags has doc_id, contaminated, n_items, item_ids, distance of every document in order of no
    guarantee; clean has the rows of docs, all their columns, whatever they are called, that hold no item.

    Items of fewer than min_words words match exactly and at word bounds; with min_words 0 every item may have its
    share of edits. Null and empty texts hold none; null item ids and texts and items without a letter or digit are
    left out; an empty benchmark finds none. Very long texts are searched whole. Repeated rows are judged alike and
    returned as often as they come; of items with equal texts each id is listed. Null doc_ids are kept. Empty table:
    no rows.
    """
    blocks = list(item_blocks(benchmark, block_bytes)) if _small(benchmark, block_bytes) else None
    if blocks is not None and len(blocks) <= 1:
        r = matches(F.col("text"), blocks[0] if blocks else [], rate, min_words)
        flags = docs.select(F.col("doc_id").cast("long"), r.alias("r")).select("doc_id", (F.size("r.items") > 0).alias("contaminated"), F.size("r.items").cast("long").alias("n_items"), F.col("r.items").alias("item_ids"), F.col("r.distance").alias("distance"))
        return flags, docs.filter(F.size(r["items"]) == 0)
    found = contamination(docs, benchmark, rate, block_bytes, min_words)
    held = found.groupBy(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("item_ids"), F.min("distance").alias("distance"))
    held = materialize(held, "contaminated")
    same = docs["doc_id"].eqNullSafe(held["f_id"]) & (F.xxhash64(docs["text"]) == held["f_hash"])
    flags = docs.select("doc_id", "text").join(held, same, "left").select(
        F.col("doc_id").cast("long"), F.col("item_ids").isNotNull().alias("contaminated"), F.when(F.col("item_ids").isNull(), 0).otherwise(F.size("item_ids")).cast("long").alias("n_items"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), "distance"
    )
    return flags, docs.join(held, same, "left_anti")


def _small(benchmark: DataFrame, block_bytes: int) -> bool:
    return (benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= block_bytes

"""Token-ID output: a range asymmetric numeral system (rANS) with static tables over interleaved lanes.

File format (one Parquet row per *group* of documents, in ascending doc_id order):
  part, seq         position of the group: range partition, then number within it
  part_start        ids of the same partition before the group
  n_tokens          ids of the group
  doc_ids, doc_lens the documents of the group and their id counts (end id included)
  payload           bytes: header, frequency table shared by all blocks of the group, independent blocks

Payload, little endian: magic ``RNS1``; u32 table entries, u32 blocks; per entry u16 symbol, u16 frequency - 1;
then per block: u32 ids, u32 lanes, u32 words, u32 checkpoints, u32 crc32 of the ids as u16; lane states u32;
checkpoints (u32 step, u32 word offset, lane states u32); words u16. A block decodes from its first state or
from any checkpoint, so blocks and stretches between checkpoints decode in parallel.

The state is 32 bits, renormalised by 16, frequencies sum to 2**16. Lane j holds ids j, j+lanes, ...
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brieflake.llm.common import materialize, shuffle_partitions, sliced, worker_model

END_ID = 1
BLOCK_TOKENS = 1 << 18
GROUP_TOKENS = 1 << 22
LANES = 1024
CHECKPOINT_STEPS = 64
MAGIC = b"RNS1"
SCALE = 1 << 16

GROUP_SCHEMA = "part int, seq int, part_start long, n_tokens long, doc_ids array<long>, doc_lens array<long>, payload binary"
DOC_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long"


# ---------------------------------------------------------------- rANS


def quantize(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**16, at least 1 for every symbol that occurs."""
    used = np.flatnonzero(counts)
    if len(used) > SCALE:
        raise ValueError("more distinct ids than the table has slots")
    freq = np.zeros(len(counts), np.int64)
    if not len(used):
        return freq
    share = counts[used].astype(np.float64) / counts[used].sum() * SCALE
    got = np.maximum(1, np.floor(share).astype(np.int64))
    short = SCALE - int(got.sum())
    order = np.argsort(-counts[used], kind="stable")
    while short > 0:
        take = min(short, len(order))
        got[order[:take]] += 1
        short -= take
    while short < 0:
        # take from the largest, never below 1; each pass halves at most what the top holds
        top = order[np.argsort(-got[order], kind="stable")]
        spare = np.minimum(got[top] - 1, np.maximum(1, (got[top] - 1) // 2)) * (got[top] > 1)
        cut = np.minimum(spare, np.maximum(0, -short - (np.cumsum(spare) - spare)))
        got[top] -= cut
        short += int(cut.sum())
    freq[used] = got
    return freq


def encode_block(ids: np.ndarray, freq: np.ndarray, cum: np.ndarray, lanes: int = LANES) -> bytes:
    n = len(ids)
    lanes = max(1, min(lanes, n // CHECKPOINT_STEPS or 1))
    steps = -(-n // lanes)
    x = np.full(lanes, SCALE, np.uint64)
    out: list[np.ndarray] = []
    marks: list[tuple[int, int, np.ndarray]] = []
    written = 0
    sixteen = np.uint64(16)
    fs, cs = freq[ids], cum[ids]
    for t in range(steps - 1, -1, -1):
        f, c = fs[t * lanes : (t + 1) * lanes], cs[t * lanes : (t + 1) * lanes]
        k = len(f)
        y = x[:k]
        full = y >= (f << sixteen)
        if full.any():
            words = y[full]
            out.append(words.astype("<u2"))
            written += len(words)
            y = np.where(full, y >> sixteen, y)
        q = y // f
        x[:k] = (q << sixteen) + (y - q * f) + c
        if t and t % CHECKPOINT_STEPS == 0:
            marks.append((t, written, x.astype("<u4")))
    words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u2")
    parts = [struct.pack("<5I", n, lanes, len(words), len(marks), zlib.crc32(ids.astype("<u2").tobytes())), x.astype("<u4").tobytes()]
    for t, done, state in marks[::-1]:
        parts += [struct.pack("<2I", t, len(words) - done), state.tobytes()]
    return b"".join([*parts, words.tobytes()])


def _read_block(buf: memoryview, at: int) -> tuple[dict, int]:
    n, lanes, n_words, n_marks, crc = struct.unpack_from("<5I", buf, at)
    at += 20
    state = np.frombuffer(buf, "<u4", lanes, at)
    at += 4 * lanes
    marks = []
    for _ in range(n_marks):
        step, word = struct.unpack_from("<2I", buf, at)
        marks.append((step, word, np.frombuffer(buf, "<u4", lanes, at + 8)))
        at += 8 + 4 * lanes
    words = np.frombuffer(buf, "<u2", n_words, at)
    return {"n": n, "lanes": lanes, "crc": crc, "starts": [(0, 0, state), *marks], "words": words}, at + 2 * n_words


def decode_stretch(block: dict, which: int, until: int | None, symbol: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> np.ndarray:
    """The ids from one start (0: the block's, else a checkpoint) up to step `until`."""
    n, lanes, words = block["n"], block["lanes"], block["words"].astype(np.uint64)
    first, at, state = block["starts"][which]
    steps = -(-n // lanes)
    until = steps if until is None else until
    x = state.astype(np.uint64)
    out = np.empty(min(n, until * lanes) - first * lanes, np.uint16)
    mask, sixteen = np.uint64(SCALE - 1), np.uint64(16)
    for t in range(first, until):
        k = min(lanes, n - t * lanes)
        y = x[:k]
        slot = y & mask
        s = symbol[slot]
        out[(t - first) * lanes : (t - first) * lanes + k] = s
        y = freq[s] * (y >> sixteen) + slot - cum[s]
        low = np.flatnonzero(y < SCALE)
        if len(low):
            y[low] = (y[low] << sixteen) | words[at : at + len(low)]
            at += len(low)
        x[:k] = y
    return out


def decode_block(block: dict, symbol: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> np.ndarray:
    ids = decode_stretch(block, 0, None, symbol, freq, cum)
    if zlib.crc32(ids.astype("<u2").tobytes()) != block["crc"]:
        raise ValueError("checksum of a token block differs")
    return ids


def encode_group(ids: np.ndarray) -> bytes:
    """All blocks of a group with the frequency table that they share."""
    freq = quantize(np.bincount(ids, minlength=1))
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]])
    used = np.flatnonzero(freq)
    table = np.stack([used, freq[used] - 1], 1).astype("<u2")
    f, c = freq.astype(np.uint64), cum.astype(np.uint64)
    blocks = [encode_block(ids[i : i + BLOCK_TOKENS], f, c) for i in range(0, len(ids), BLOCK_TOKENS)]
    return b"".join([MAGIC, struct.pack("<2I", len(used), len(blocks)), table.tobytes(), *blocks])


def open_group(payload: bytes) -> tuple[list[dict], np.ndarray, np.ndarray, np.ndarray]:
    buf = memoryview(payload)
    if bytes(buf[:4]) != MAGIC:
        raise ValueError("not a token group")
    n_used, n_blocks = struct.unpack_from("<2I", buf, 4)
    table = np.frombuffer(buf, "<u2", 2 * n_used, 12).reshape(-1, 2).astype(np.int64)
    size = int(table[:, 0].max()) + 1 if n_used else 1
    freq = np.zeros(size, np.int64)
    freq[table[:, 0]] = table[:, 1] + 1
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]])
    symbol = np.repeat(np.arange(size), freq).astype(np.uint16)
    at, blocks = 12 + 4 * n_used, []
    for _ in range(n_blocks):
        block, at = _read_block(buf, at)
        blocks.append(block)
    return blocks, symbol, freq.astype(np.uint64), cum.astype(np.uint64)


def decode_group(payload: bytes) -> np.ndarray:
    blocks, symbol, freq, cum = open_group(payload)
    return np.concatenate([decode_block(b, symbol, freq, cum) for b in blocks]) if blocks else np.zeros(0, np.uint16)


# ---------------------------------------------------------------- tokenizing


class Known:
    """Ids of strings that came before, as Arrow arrays: some 30 bytes a string, no Python objects.

    It holds at most `most` strings; when it is full, those that came up again since the last time stay, the youngest half of the room at most.
    """

    def __init__(self, most: int):
        self.most = most
        self.names = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.large_binary())
        self.again = np.zeros(0, bool)

    def lookup(self, names: pa.Array, make) -> pa.Array:
        """The ids of distinct strings; make gives those of an array of new ones."""
        import pyarrow.compute as pc

        at = pc.index_in(names, value_set=self.names)
        missing = at.is_null().to_numpy(zero_copy_only=False)
        place = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        self.again[place[~missing]] = True
        if not missing.any():
            return self.ids.take(pa.array(place))
        new = names.filter(pa.array(missing))
        made = make(new)
        place[missing] = len(self.ids) + np.arange(len(new))
        ids = pa.concat_arrays([self.ids, made])
        got = ids.take(pa.array(place))
        self.names, self.ids = pa.concat_arrays([self.names, new]), ids
        self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
        if len(self.names) > self.most:
            stay = np.flatnonzero(self.again)[-(self.most // 2) :]
            self.names, self.ids = self.names.take(pa.array(stay)), self.ids.take(pa.array(stay))
            self.again = np.zeros(len(stay), bool)
        return got


def _bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a large_binary array, one after the other as u16, and where each starts and the last ends."""
    if not len(array):
        return np.zeros(0, "<u2"), np.zeros(1, np.int64)
    at = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1] // 2
    return np.frombuffer(array.buffers()[2] or b"", "<u2"), at


def _binary(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """flat[at[i]:at[i + 1]] as the values of a large_binary array."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((2 * at).astype(np.int64).tobytes()), pa.py_buffer(flat.astype("<u2").tobytes())])


class WordEncoder:
    """Ids of texts, through the tokenizers library, with a cache by word.

    Where the tokenizer's parts show that no id crosses white space (NFC, white space, lower case; a Split on
    letters, digits and the rest, then bytes) and a text keeps to characters whose classes are the same in `re`,
    texts are cut into words by Arrow, words that aren't known are cut into pieces together, and the library's own
    model gives the ids of each piece that isn't known; all other texts are encoded whole by the library. Both give
    the same ids.
    """

    MOST_WORDS = 300_000
    MOST_PIECES = 150_000
    SAFE = r"^[\t\n\r -~À-ÖØ-öø-ÿ]*\z"
    PIECES = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")

    def __init__(self, tokenizer_json: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(tokenizer_json)
        spec = json.loads(tokenizer_json)
        self.by_word = (
            [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [x.get("type") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])] == ["Split", "ByteLevel"]
            and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
            and not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or re.search(r"\s", x["content"]) for x in spec.get("added_tokens", []))
        )
        self.added = re.compile("|".join(re.escape(x["content"]) for x in spec.get("added_tokens", [])) or r"(?!)")
        self.words, self.pieces = Known(self.MOST_WORDS), Known(self.MOST_PIECES)
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.bytes_as = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _encode_pieces(self, pieces: pa.Array) -> pa.Array:
        # the model takes bytes as characters; a line feed maps to one that no other byte maps to
        names = "\n".join(pieces.to_pylist()).encode().decode("latin-1").translate(self.bytes_as).split(self.bytes_as[10])
        tokenize = self.whole.model.tokenize
        got = [[x.id for x in tokenize(name)] for name in names]
        size = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for ids in got for i in ids), "<u2", int(size.sum()))
        return _binary(flat, np.concatenate([[0], np.cumsum(size)]))

    def _encode_words(self, words: pa.Array) -> pa.Array:
        """Words are joined by line feeds, which no word holds, and cut into pieces at once."""
        import pyarrow.compute as pc

        joined = "\n".join(words.to_pylist())
        special = self.added.search(joined) is not None
        found = pa.array(self.PIECES.findall(joined.lower()), pa.large_string())
        breaks = np.flatnonzero(pc.equal(found, "\n").to_numpy(zero_copy_only=False))
        coded = found.dictionary_encode()
        distinct = coded.dictionary
        cut = pc.index(distinct, "\n").as_py()
        if cut >= 0:  # not a piece: no ids
            known = self.pieces.lookup(distinct.filter(pc.not_equal(distinct, "\n")), self._encode_pieces)
            table = pa.concat_arrays([known.slice(0, cut), pa.array([b""], pa.large_binary()), known.slice(cut)])
        else:
            table = self.pieces.lookup(distinct, self._encode_pieces)
        flat, at = _bytes_of(table.take(coded.indices))
        got = _binary(flat, at[np.concatenate([[0], breaks, [len(found)]])])
        if special:
            ids = got.to_pylist()
            for i, word in enumerate(words.to_pylist()):
                if self.added.search(word):
                    ids[i] = np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u2").tobytes()
            got = pa.array(ids, pa.large_binary())
        return got

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and each text's count."""
        import pyarrow.compute as pc

        lens = np.zeros(len(texts), np.int64)
        fast = pc.fill_null(pc.match_substring_regex(texts, self.SAFE), False).to_numpy(zero_copy_only=False) if self.by_word else np.zeros(len(texts), bool)
        parts: list[np.ndarray] = []
        at = 0
        while at < len(texts):  # runs of texts of one way
            end = at + 1
            while end < len(texts) and fast[end] == fast[at]:
                end += 1
            run = texts.slice(at, end - at)
            if fast[at]:
                got, lens[at:end] = self._fast(pc.cast(run, pa.large_string()))
                parts.append(got)
            else:
                for i, text in enumerate(run.to_pylist(), at):
                    if text is not None:
                        got = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2")
                        parts.append(got)
                        lens[i] = len(got)
            at = end
        return (np.concatenate(parts) if parts else np.zeros(0, "<u2")), lens

    def _fast(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow.compute as pc

        lists = pc.ascii_split_whitespace(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(lists.values.slice(offsets[0], offsets[-1] - offsets[0]))
        words = coded.dictionary
        blank = pc.index(words, "").as_py()  # at either end of a text
        if blank >= 0:
            known = self.words.lookup(words.filter(pc.not_equal(words, "")), self._encode_words)
            table = pa.concat_arrays([known.slice(0, blank), pa.array([b""], pa.large_binary()), known.slice(blank)])
        else:
            table = self.words.lookup(words, self._encode_words)
        flat, at = _bytes_of(table.take(coded.indices))
        return flat[at[0] : at[-1]], np.diff(at[offsets - offsets[0]])


# ---------------------------------------------------------------- Spark


def write_token_groups(docs: DataFrame, tokenizer_json: str, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Token ids of every document (null text: no ids; the end id follows each), as groups of the file format.

    Documents go by range of doc_id into `partitions` partitions and are sorted there (nulls first, equal ids by
    text, so reruns agree); each task streams its range, so memory holds one group plus one Arrow batch.
    """
    spark = docs.sparkSession
    n = partitions or shuffle_partitions(spark)
    shared = spark.sparkContext.broadcast(tokenizer_json)  # one vocabulary file
    digest = hashlib.sha256(tokenizer_json.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        # kept by the worker process: parsed once, its cache warm for the next task
        encoder = worker_model(("tokenizer", digest), lambda: WordEncoder(shared.value))
        seq = start = held = 0
        ids: list[np.ndarray] = []
        names: list = []
        lens: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, start, held, ids, names, lens
            every = np.concatenate(ids)
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([seq], pa.int32()),
                    pa.array([start], pa.int64()),
                    pa.array([len(every)], pa.int64()),
                    pa.array([names], pa.list_(pa.int64())),
                    pa.array([lens], pa.list_(pa.int64())),
                    pa.array([encode_group(every)], pa.binary()),
                ],
                names=["part", "seq", "part_start", "n_tokens", "doc_ids", "doc_lens", "payload"],
            )
            seq, start, held, ids, names, lens = seq + 1, start + len(every), 0, [], [], []
            return row

        for batch in sliced(batches):
            got, counts = encoder.encode_batch(batch.column("text"))
            keys = batch.column("doc_id").to_pylist()
            # the end id after each document
            ends = np.cumsum(counts)
            got = np.insert(got, ends, np.uint16(end_id))
            counts = counts + 1
            ends = np.cumsum(counts)
            i = 0
            while i < len(keys):
                base = int(ends[i] - counts[i])
                j = min(len(keys), max(i + 1, int(np.searchsorted(ends, base + GROUP_TOKENS - held, side="right"))))
                ids.append(got[base : int(ends[j - 1])])
                names += keys[i:j]
                lens += counts[i:j].tolist()
                held += int(ends[j - 1]) - base
                i = j
                if held >= GROUP_TOKENS or i < len(keys):
                    yield flush()
        if names:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, GROUP_SCHEMA)


def read_token_groups(groups: DataFrame) -> DataFrame:
    """Decode every group, check the checksums; per document its place, its count and the crc32 of its ids as u32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_group(row["payload"]).astype("<u4")
                lens = np.array(row["doc_lens"], np.int64)
                ends = np.cumsum(lens)
                starts = ends - lens
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(lens)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(np.full(n, row["part"], np.int32)),
                        pa.array(starts + row["part_start"]),
                        pa.array(lens),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"],
                )

    per_doc = groups.mapInArrow(run, DOC_SCHEMA)
    # one row per partition: its number of ids; as many rows as range partitions
    sizes = groups.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = sizes.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    return per_doc.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write the token files of all documents to the shared folder, read them back: doc_id, start, n_tokens, ids_crc32.

    Null or empty text: only the end id. Null doc_id: first in the order. Repeated rows: each is a document of its
    own. Empty table: no rows. Other columns are ignored.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    groups = materialize(write_token_groups(docs, tokenizer_json, end_id), "tokens", row_group_bytes=16 << 20, codec="none")
    return read_token_groups(groups)

"""License scans by an exact set-similarity join of text blocks with license templates.

Words: `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the A-Z lower-cased text. Block: BLOCK_WORDS consecutive words, one
every BLOCK_WORDS / 2 words (a shorter text is one block). A template T matches a block B when |T n B| >=
THRESHOLD * |T| on their word sets (whole for templates under SHORT words). The templates' words are ordered by their
frequency over the whole corpus, rarest first, in templates and blocks alike. Prefix filter: B must hold one of the |T| - need + 1 rarest words of T.
Length filter: B has at least `need` of the templates' words. Positional filter: a shared word at place i of T and j of B, with m shared
prefix words before it, leaves at most m + 1 + min(|T| - i - 1, |B| - j - 1) in all. What passes is verified. All blocks that meet the threshold are found.

Licenses of a family share nearly all words, so a match is also judged by the words next to the family's anchor (FAMILIES): the run
of telling words right behind `cc by` or right before `general public license` is the variant that is granted there. A
template with an anchor needs a place of it in the block with its own variant; where a block holds no place of the anchor, only
templates of the variant without telling words match. A telling word elsewhere tells nothing.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brieflake.llm.common import sliced

BLOCK_WORDS = 64
THRESHOLD = 0.8
SHORT = 8

# Phrases of the contract, and well-known sentences of public licenses.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
TEMPLATES = (
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("licensed under the apache license version you may not use this file except in compliance with the license", "apache"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this work is licensed under a creative commons attribution international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution noncommercial international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noderivatives international license", "cc-by-nd"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("cc by nc sa", "cc-by-nc-sa"),
    ("cc by nc nd", "cc-by-nc-nd"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)
# A family's anchor, on which side of it the telling words stand, and those words.
FAMILIES = (
    ("general public license", "before", ("affero", "lesser", "library")),
    ("cc by", "behind", ("nc", "nd", "sa")),
    ("creative commons attribution", "behind", ("noncommercial", "noderivatives", "sharealike")),
)
#: Telling words next to an anchor, at most.
RUN = 3

#: Word bytes as they are in lower case (digits, letters, everything beyond ASCII), all others as spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def template_sets(templates=TEMPLATES) -> list[tuple[frozenset[bytes], str]]:
    return [(frozenset(words_of(t)), label) for t, label in templates]


def needed(words: frozenset[bytes], threshold: float) -> int:
    """How many of a template's words a block must hold."""
    return len(words) if len(words) < SHORT else math.ceil(threshold * len(words) - 1e-9)


def variants(words: list[bytes], families=FAMILIES) -> list[dict[int, str]]:
    """For each family: place of its anchor -> the telling words next to it, as one string."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for anchor, side, told in families:
        a, told, found = words_of(anchor), {t.encode() for t in told}, {}
        phrase, seen, counted = b" " + b" ".join(a) + b" ", 0, 0
        at = joined.find(phrase)
        while at >= 0:
            seen += joined.count(b" ", counted, at)
            counted = at
            near = words[seen + len(a) : seen + len(a) + RUN] if side == "behind" else words[max(0, seen - RUN) : seen][::-1]
            run = [w.decode() for w in itertools.takewhile(told.__contains__, near)]
            found[seen] = " ".join(run if side == "behind" else run[::-1])
            at = joined.find(phrase, at + 1)
        out.append(found)
    return out


def word_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Occurrences of the templates' words over all documents: one row per word and task, then one per word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in sliced(batches):
            for text in batch.column("text"):
                total.update(filter(vocabulary.__contains__, words_of(text.as_py())))
        yield pa.RecordBatch.from_pydict({"w": pa.array(list(total), pa.binary()), "n": pa.array(list(total.values()), pa.int64())})

    got = docs.select("text").mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.w): r.n for r in got}


class Scanner:
    def __init__(self, frequency: dict[bytes, int], phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS):
        self.phrases = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in phrases]
        self.block, self.step = block_words, block_words // 2
        sets = template_sets(templates)
        every = sorted({w for words, _ in sets for w in words}, key=lambda w: (frequency.get(w, 0), w))
        self.order = {w: i for i, w in enumerate(every)}
        self.index: dict[int, list[tuple[int, int]]] = {}
        self.templates = []
        self.pruned = 0
        for t, ((words, label), (said, _)) in enumerate(zip(sets, templates)):
            order, need = sorted(self.order[w] for w in words), needed(words, threshold)
            for i, w in enumerate(order[: len(order) - need + 1]):
                self.index.setdefault(w, []).append((t, i))
            self.templates.append((frozenset(order), need, label, [(f, v) for f, found in enumerate(variants(words_of(said))) for v in found.values()]))

    def base(self, words: list[bytes]) -> tuple[int, int | None, int | None, set[str]]:
        """Places, first and last start, labels of the phrases."""
        joined = b" " + b" ".join(words) + b" "
        n, first, last, labels = 0, None, None, set()
        for phrase, label in self.phrases:
            at, seen, counted = joined.find(phrase), 0, 0
            while at >= 0:
                seen += joined.count(b" ", counted, at)
                counted = at
                n += 1
                first = seen if first is None else min(first, seen)
                last = seen if last is None else max(last, seen)
                labels.add(label)
                at = joined.find(phrase, at + 1)
        return n, first, last, labels

    def similar(self, words: list[bytes]) -> dict[str, float]:
        """Label -> largest containment of a template of it among the blocks that meet the threshold."""
        index, order = self.index, self.order
        known = [order.get(w, -1) for w in words]
        hits = [i for i, w in enumerate(known) if w in index]
        found: dict[str, float] = {}
        if not hits:
            return found
        said = None
        last = max(0, -(-(len(words) - self.block) // self.step))
        blocks = sorted({b for i in hits for b in range(max(0, -(-(i - self.block + 1) // self.step)), min(last, i // self.step) + 1)})
        for b in blocks:
            start = b * self.step
            block = sorted(set(known[start : start + self.block]) - {-1})
            for t in self.candidates(block):
                members, need, label, own = self.templates[t]
                shared = len(members.intersection(block))
                if shared < need:
                    continue
                if own:
                    said = variants(words) if said is None else said
                    ends = start + self.block
                    here = [{v for at, v in said[f].items() if start <= at and at + len(FAMILIES[f][0].split()) <= ends} for f, _ in own]
                    if not all(v in got or not got and not v for (_, v), got in zip(own, here)):
                        continue
                found[label] = max(found.get(label, 0.0), shared / len(members))
        return found

    def candidates(self, block: list[int]) -> list[int]:
        """Templates that the filters leave, for a block's template words in the common order."""
        shared: dict[int, int] = {}
        for j, w in enumerate(block):
            for t, i in self.index.get(w, ()):
                members, need, _, _ = self.templates[t]
                before = shared.get(t, 0)
                if before < 0 or len(block) < need:
                    continue
                if before + 1 + min(len(members) - i - 1, len(block) - j - 1) < need:
                    shared[t] = -1
                    self.pruned += 1
                else:
                    shared[t] = before + 1
        return [t for t, n in shared.items() if n > 0]

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        n, first, last, base = self.base(words)
        more = self.similar(words)
        score = 1.0 if base else max(more.values(), default=0.0)
        return len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(base | more.keys())), score


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    Null or empty text: no words, no labels, score 0. Very long texts: every block counts. score: 1 with a base phrase, else the largest containment of a
    matching template. Repeated rows: as often as they come. Empty table: no rows. Other columns are ignored.
    """
    vocabulary = frozenset(w for t, _ in template_sets(templates) for w in t)
    frequency = word_frequencies(docs, vocabulary)  # at most one number per template word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(frequency, phrases, templates, threshold)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for batch in sliced(batches):
            rows = [scanner.scan(t.as_py()) for t in batch.column("text")]
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", *names])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def oracle_sql(phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> str:
    """The scan as DuckDB SQL over `documents` (unique doc_id): every block against every template, no filters."""
    quoted = lambda words: "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"
    said = ", ".join(f"({quoted(words_of(p))}, '{label}')" for p, label in phrases)
    own = lambda t: [(f, v) for f, found in enumerate(variants(words_of(t))) for v in found.values()]
    facts = [(words, label, (own(t) or [(-1, "")])[0]) for (words, label), (t, _) in zip(template_sets(templates), templates)]
    made = ", ".join(f"({quoted(sorted(words))}, '{label}', {needed(words, threshold)}, {f}, '{v}')" for words, label, (f, v) in facts)
    runs = []
    for f, (anchor, side, told) in enumerate(FAMILIES):
        n, told = len(words_of(anchor)), ", ".join(f"'{x}'" for x in told)
        near = [f"w[i + {n + r}]" if side == "behind" else f"CASE WHEN i > {r + 1} THEN w[i - {r + 1}] END" for r in range(RUN)]
        kept = [f"CASE WHEN {' AND '.join(f'coalesce({x}, {chr(39)}{chr(39)}) IN ({told})' for x in near[: r + 1])} THEN {near[r]} END" for r in range(RUN)]
        runs.append(f"SELECT doc_id, {f} AS f, i - 1 AS s, i - 1 + {n} AS e, concat_ws(' ', {', '.join(kept if side == 'behind' else kept[::-1])}) AS v FROM (SELECT doc_id, w, unnest(list_filter(range(1, len(w) - {n} + 2), lambda i: w[i:i + {n} - 1] = {quoted(words_of(anchor))})) AS i FROM t)")
    upper = "".join(map(chr, range(65, 91)))
    return f"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT doc_id, label, list_filter(range(1, len(w) - len(q) + 2), lambda i: w[i:i + len(q) - 1] = q) AS s FROM t, (VALUES {said}) p(q, label)),
base AS (SELECT doc_id, CAST(sum(len(s)) AS BIGINT) AS n_base, min(list_min(s)) - 1 AS first_word, max(list_max(s)) - 1 AS last_word FROM b GROUP BY 1),
blocks AS (SELECT doc_id, k, list_distinct(w[{block_words // 2} * k + 1:{block_words // 2} * k + {block_words}]) AS s FROM (SELECT doc_id, w, unnest(range(0, greatest(0, CAST(ceil((len(w) - {block_words}) / {block_words / 2}) AS BIGINT)) + 1)) AS k FROM t)),
runs AS ({' UNION ALL '.join(runs)}),
held AS (SELECT doc_id, k, s, label, f, v, len(list_intersect(s, q))::DOUBLE / len(q) AS c FROM blocks, (VALUES {made}) p(q, label, need, f, v) WHERE len(list_intersect(s, q)) >= need),
near AS (SELECT DISTINCT h.doc_id, h.k, r.f, r.v FROM (SELECT DISTINCT doc_id, k FROM held) h JOIN runs r ON r.doc_id = h.doc_id AND r.s >= {block_words // 2} * h.k AND r.e <= {block_words // 2} * h.k + {block_words}),
hits AS (SELECT doc_id, label, c FROM held h WHERE f < 0 OR EXISTS (SELECT 1 FROM near n WHERE n.doc_id = h.doc_id AND n.k = h.k AND n.f = h.f AND n.v = h.v) OR (v = '' AND NOT EXISTS (SELECT 1 FROM near n WHERE n.doc_id = h.doc_id AND n.k = h.k AND n.f = h.f))),
labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b WHERE len(s) > 0 UNION ALL SELECT doc_id, label FROM hits) GROUP BY 1),
bl AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b WHERE len(s) > 0 GROUP BY 1),
sc AS (SELECT doc_id, max(c) AS c FROM hits GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0) END::DOUBLE AS score
FROM t JOIN base USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN sc USING (doc_id)"""

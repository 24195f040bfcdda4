"""Recursive character splitting, and opinion segments, as Arrow functions over whole texts."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from brieflake.functions import patterns as P
from brieflake.functions import text as X

# Separator lists, coarse to fine.
CASE_SEPARATORS = ("\n\n", "\n", ". ", " ", "")
OPINION_SEPARATORS = ("\n\n", "\n", ". ", "; ", " ", "")
PLAIN_SEPARATORS = ("\n\n", "\n", " ", "")
#: Bytes of texts that a worker holds as Python strings at a time (a longer text is held alone).
PART_BYTES = 1 << 20


def in_parts(columns: tuple[pa.Array, ...], of: Callable[..., list], kind: pa.DataType) -> Iterator[pa.Array]:
    """of(*values) of each row. A batch's rows, of any number and size, are worked on and given out in parts of some PART_BYTES of the first column."""
    at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(columns[0]), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    start = 0
    while start < len(at) - 1:
        end = max(start + 1, int(np.searchsorted(at, at[start] + PART_BYTES, side="right")) - 1)
        yield pa.array([of(*row) for row in zip(*[c.slice(start, end - start).to_pylist() for c in columns])], type=kind)
        start = end


def _pieces(text: str, separator: str) -> list[str]:
    """Cut before each separator; it stays with the piece after it."""
    if not separator:
        return list(text)
    cut = text.split(separator)
    return [p for p in [cut[0], *[separator + x for x in cut[1:]]] if p]


def _merge(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Greedy runs of pieces of at most size; each starts with the last pieces of the run before, at most overlap long."""
    out: list[str] = []
    run: list[str] = []
    held = 0
    for piece in pieces:
        if run and held + len(piece) > size:
            out.append("".join(run))
            while run and (held > overlap or held + len(piece) > size):
                held -= len(run.pop(0))
        run.append(piece)
        held += len(piece)
    if run:
        out.append("".join(run))
    return out


def split_text(text: str | None, size: int = 1500, overlap: int = 300, separators=CASE_SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters, stripped, none empty: cut at the coarsest separator present; pieces that
    are still too long are cut with the finer ones; small pieces are merged with overlap."""
    if not text:
        return []
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    separator, finer = separators[at], separators[at + 1 :]
    out: list[str] = []
    small: list[str] = []
    for piece in _pieces(text, separator):
        if len(piece) < size:
            small.append(piece)
            continue
        out += _merge(small, size, overlap)
        small = []
        out += split_text(piece, size, overlap, finer) if finer else [piece]
    out += _merge(small, size, overlap)
    return [c for c in (x.strip() for x in out) if c]


def chunks(text: Column, size: int = 1500, overlap: int = 300, separators=CASE_SEPARATORS) -> Column:
    """array<string>; posexplode gives the ordinal that stays when short chunks are filtered."""

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield from in_parts((texts,), lambda t: split_text(t, size, overlap, separators), pa.list_(pa.string()))

    return run(text)


# ---------------------------------------------------------------- opinions


class Header(NamedTuple):
    """One match of a header form; `rank` is the form's place in the order of tests."""

    rank: int
    at: int
    end: int
    kind: str
    justice: str | None


_FORMS = [(re.compile(form, re.I), kind) for form, kind in P.OPINION_HEADERS]
#: What each form needs: JUSTICE and a blank, or a comma and J. The classes hold all that a letter matches where case is ignored.
_ANCHOR = re.compile(r"[jJ,](?:(?<=,)\s*(?:[cC]\.\s*)?[jJ]\.|(?<=[jJ])[uU][sS\u017f][tT][iI\u0130\u0131][cC][eE](?=\s))")
_CHIEF, _AFTER, _OF = re.compile(r"CHIEF\Z", re.I), re.compile(r"of\Z", re.I), re.compile(r"(?:Opinion|Statement)\Z", re.I)


def _before(text: str, at: int, word: re.Pattern, longest: int) -> int | None:
    """The place of the word that ends before the blanks before `at`."""
    end = at
    while end and text[end - 1].isspace():
        end -= 1
    m = word.search(text[max(0, end - longest) : end]) if end < at else None
    return max(0, end - longest) + m.start() if m else None


def _starts(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Where a form can start, by place: at a name or title, as (first place, last place), and at the word before `of` a name or title."""
    names, of = set(), set()
    for m in _ANCHOR.finditer(text):
        at = last = m.start()
        if text[at] == ",":
            while at and (text[at - 1].isalnum() or text[at - 1] == "_"):
                at -= 1
            if at == last:
                continue
            last -= 1
        names.add((at, last))
        titles = [at]
        if (chief := _before(text, at, _CHIEF, 5)) is not None:
            names.add((chief, chief))
            titles.append(chief)
        for title in titles:
            if (word := _before(text, title, _AFTER, 2)) is not None and (said := _before(text, word, _OF, 9)) is not None:
                of.add((said, said))
    return sorted(names), sorted(of)


def _found(form: re.Pattern, text: str, starts: list[tuple[int, int]]) -> Iterator[re.Match]:
    """form.finditer(text), tried only where it can start."""
    done = 0
    for first, last in starts:
        if last >= done and (m := form.match(text, max(first, done))):
            yield m
            done = m.end()


def headers(text: str) -> list[Header]:
    """Every match of every form, by form and place."""

    def known(m: re.Match) -> str | None:
        last = (m[1] or m[2] or "").strip().upper()
        return P.LAST_NAMES.get(last.removesuffix("'S"))

    names, of = _starts(text)
    return [
        Header(rank, m.start(), m.end(), kind, known(m)) for rank, (form, kind) in enumerate(_FORMS)
        for m in _found(form, text, of if form.pattern.startswith(("Opinion", "Statement")) else names)
    ]


def is_citation(text: str, at: int) -> bool:
    """An open parenthesis stands before the place, or a number on its line."""
    lead = text[max(0, at - P.CITED_WITHIN) : at]
    last = lead.rstrip()[-1:]
    return last == "(" or last.isdecimal() and "\n" not in lead[-P.SAME_LINE_WITHIN :]


def boundaries(text: str, reserve_first: bool = True) -> list[Header]:
    """The headers at which opinions start, by place: of the candidates, in order of form and place, those that are no
    citation and have no accepted one within HEADER_GAP. reserve_first: one whose name isn't known keeps its
    surroundings, too, though it starts no opinion."""
    places: list[int] = []  # accepted, ascending
    kept = []
    for h in headers(text):
        i = bisect.bisect_left(places, h.at)
        near = [x for x in places[max(0, i - 1) : i + 1] if abs(x - h.at) < P.HEADER_GAP]
        if near or (h.justice is None and not reserve_first) or is_citation(text, h.at):
            continue
        places.insert(i, h.at)
        if h.justice is not None:
            kept.append(h)
    return sorted(kept, key=lambda h: h.at)


def segments(text: str | None, author: str | None) -> list[tuple[str, str, str, str]]:
    """(justice, type, text around the header, text) of each opinion in a document. Under 500 characters: none; no header:
    the whole to the catalog's author; segments under 200 characters are dropped."""
    if not text or len(text) < 500:
        return []
    marks = boundaries(text)
    if not marks:
        return [(author, "per_curiam" if author == "Per Curiam" else "majority", "", text)] if author else []
    found = []
    for h, until in zip(marks, [*[m.at for m in marks[1:]], len(text)]):
        own = text[h.at : until].strip()
        if len(own) >= 200:
            found.append((h.justice, h.kind, text[max(0, h.at - P.JOINING_BEFORE) : h.end + P.JOINING_BEHIND], own))
    return found


def opinion_segments(text: Column, author: Column) -> Column:
    """array<struct<justice, opinion_type, joining_justices, text>>; the joining names are read by Spark."""

    names = ("justice", "opinion_type", "around", "text")

    @F.arrow_udf("array<struct<justice string, opinion_type string, around string, text string>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([(n, pa.string()) for n in names]))
        for columns in batches:
            yield from in_parts(columns, lambda t, a: [dict(zip(names, s)) for s in segments(t, a)], kind)

    return F.transform(run(text, author), lambda s: F.struct(s["justice"].alias("justice"), s["opinion_type"].alias("opinion_type"), X.joining_justices(s["around"]).alias("joining_justices"), s["text"].alias("text")))

import math
import random
import re

from brieflake.llm import licenses as L

SCHEMA = "doc_id long, text string, labels string, score int"


def brute(text):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for phrase, label in L.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    base = {x for _, x in places}
    more = {}
    def granted(words):
        """(family, start, end, variant) of every anchor."""
        out = []
        for f, (anchor, side, told) in enumerate(L.FAMILIES):
            a = anchor.split()
            for i in range(len(words)):
                if words[i : i + len(a)] == a:
                    run, at = [], i + len(a) if side == "behind" else i - 1
                    while 0 <= at < len(words) and words[at] in told and len(run) < L.RUN:
                        run.append(words[at])
                        at += 1 if side == "behind" else -1
                    out.append((f, i, i + len(a), tuple(run if side == "behind" else run[::-1])))
        return out

    places_of = granted(words)
    for b in range(max(1, math.ceil((len(words) - 64) / 32) + 1)):
        block = set(words[b * 32 : b * 32 + 64])
        for t, label in L.TEMPLATES:
            s = set(t.split())
            here = lambda f: {v for g, i, e, v in places_of if g == f and b * 32 <= i and e <= b * 32 + 64}
            right = all(v in here(f) or (not here(f) and not v) for f, _, _, v in granted(t.split()))
            if len(s & block) >= (len(s) if len(s) < 8 else 0.8 * len(s) - 1e-9) and right:
                more[label] = max(more.get(label, 0), len(s & block) / len(s))
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more.keys())), 1.0 if base else max(more.values(), default=0.0)


def texts():
    rng = random.Random(3)
    vocab = sorted({w for t, _ in L.TEMPLATES for w in t.split()} | {"été", "x_y", "Zz", "CC-BY", "MIT"})
    out = [None, "", "CC BY CC by cc-by", "Released under the MIT\nLicense.", "mit licenses", "GNU General Public License, v3 apache license", "İ ſ K gnu", "\x00a\x1f"]
    out += [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    for t, _ in L.TEMPLATES:
        w = t.split()
        for drop in (0, 2, 4):
            keep = [x for i, x in enumerate(w) if i not in set(rng.sample(range(len(w)), min(drop, len(w) - 1)))]
            out.append(" ".join(["pad"] * rng.randint(0, 100) + keep + ["end"] * rng.randint(0, 100)).title())
    return out


def test_against_brute_force(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(2, "CC BY CC by cc-by", "x", 1)]
    got = L.scan_licenses(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows)
    by = {i: t for i, t, *_ in rows}
    for r in got:
        assert tuple(r)[1:] == brute(by[r.doc_id]), by[r.doc_id]


def test_long_text_and_empty(spark):
    text = "word " * 300_000 + "apache license"
    r = L.scan_licenses(spark.createDataFrame([(1, text, "x", 1)], SCHEMA)).first()
    assert (r.n_words, r.n_base, r.first_word, r.base_labels) == (300_002, 1, 300_000, "apache")
    assert L.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_its_sql(spark, sf):
    import duckdb

    from brieflake.llm.queries import ORACLES, QUERIES

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.sql(ORACLES["op5_licenses"])
    got = QUERIES["op5_licenses"](spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_licenses_of_a_family_are_told_apart(spark):
    gpl, lgpl, agpl = [next(t for t, x in L.TEMPLATES if x == label) for label in ("gpl", "lgpl", "agpl")]
    said = [
        ("Licensed under CC BY 4.0", "cc-by"),
        ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc"),
        ("Licensed under CC BY-SA 4.0", "cc-by,cc-by-sa"),
        ("Licensed under CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
        (gpl.title(), "gpl"),
        (lgpl.title() + " as published by the Free Software Foundation", "lgpl"),
        ("This program is free software: " + agpl, "agpl"),
    ]
    said += [
        ("Licensed under CC BY 4.0. Elle aime sa maison, nd et nc", "cc-by"),
        ("text CC BY-NC, images CC BY-SA", "cc-by,cc-by-nc,cc-by-sa"),
        (gpl.title() + ", and to a lesser extent its library", "gpl"),
        ("sa nc. CC BY-ND is meant. It differs to a lesser extent from " + lgpl.title(), "cc-by,cc-by-nd,lgpl"),
        ("word " * 59 + "CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa"),
    ]
    rows = [(i, f"Some words before. {t}. And some behind.", "x", 1) for i, (t, _) in enumerate(said)]
    got = {r.doc_id: r.labels for r in L.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(len(said))] == [x for _, x in said]


def test_filters_prune_and_lose_nothing():
    rng = random.Random(9)
    scanner = L.Scanner({})
    found = 0
    for _ in range(4000):
        block = sorted(rng.sample(range(len(scanner.order)), rng.randint(1, 40)))
        left = set(scanner.candidates(block))
        meet = {t for t, (members, need, _, _) in enumerate(scanner.templates) if len(members.intersection(block)) >= need}
        assert meet <= left
        found += len(left)
    assert found and scanner.pruned > 500

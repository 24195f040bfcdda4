import hashlib
import math
import random
import re

from brieflake.operators import classify as C

CLASSES = ["a", "b", "never", "c"]


def _bucket(token):
    return int(hashlib.md5(token.encode()).hexdigest()[:4], 16)


def _plain(labelled, text):
    """(label, probability) by the definition, token by token."""
    every, scores = sum(1 for x, _ in labelled if x in CLASSES), {}
    for c in CLASSES:
        mine = [_bucket(t) for x, s in labelled if x == c for t in re.findall("[a-z0-9]+", (s or "").lower())]
        docs = sum(1 for x, _ in labelled if x == c)
        if docs:
            scores[c] = math.log(docs / every) + sum(math.log((mine.count(_bucket(t)) + 1) / (len(mine) + C.BUCKETS)) for t in re.findall("[a-z0-9]+", (text or "").lower()))
    best = max(scores, key=lambda c: (scores[c], -CLASSES.index(c)))
    return best, 1 / sum(math.exp(s - scores[best]) for s in scores.values())


def _texts(n, seed):
    """Labelled texts: words of each class's own among common ones."""
    rng = random.Random(seed)
    own = {"a": "brief counsel petition".split(), "b": "appendix record volume".split(), "c": "amicus friend court".split()}
    return [(c, " ".join(rng.choice(own[c]) if rng.random() < 0.3 else f"w{rng.randrange(60)}" for _ in range(rng.randrange(8, 25)))) for c in (rng.choice("aabc") for _ in range(n))]


def test_posteriors_against_plain_python(spark):
    labelled = _texts(60, 1) + [("other", "brief"), ("c", None), ("c", "")]
    docs = _texts(40, 2) + [("", None), ("", ""), ("", "Zebra!"), ("", "brief " * 3000), ("", "ÉÈ")]
    train = spark.createDataFrame(labelled, "label string, text string")
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(docs)], "id int, text string").repartition(3)
    got = {r.id: (r.label, r.probability) for r in C.predict(rows, "id", *C.fit(train, CLASSES), CLASSES, "?").collect()}
    assert len(got) == len(docs)
    for i, (_, text) in enumerate(docs):
        label, p = _plain(labelled, text)
        assert got[i][0] == label and abs(got[i][1] - p) < 1e-9, (i, got[i], label, p)


def test_held_out_accuracy_and_no_labels(spark):
    labelled, held = _texts(300, 3), _texts(200, 4)
    train = spark.createDataFrame(labelled, "label string, text string")
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(held)], "id int, text string")
    got = {r.id: r.label for r in C.predict(rows, "id", *C.fit(train, CLASSES), CLASSES, "?").collect()}
    assert all(got[i] == _plain(labelled, t)[0] for i, (_, t) in enumerate(held))
    assert sum(got[i] == c for i, (c, _) in enumerate(held)) >= 180  # by the definition 188
    none = C.predict(rows, "id", *C.fit(train.limit(0), CLASSES), CLASSES, "?").select("label", "probability").distinct().collect()
    assert [tuple(r) for r in none] == [("?", 0.0)]
    assert C.predict(rows.limit(0), "id", *C.fit(train, CLASSES), CLASSES, "?").count() == 0

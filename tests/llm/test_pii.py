import hashlib
import random
import re

from brieflake.llm import pii as P

SCHEMA = "doc_id long, text string, spans string, base int"
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def run(spark, texts):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    return {r.doc_id: r for r in P.digest(P.find(spark.createDataFrame(rows, SCHEMA).repartition(4))).collect()}


def check(r, text):
    want = brute(text)
    assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (text, want)
    assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in PLAIN]
    assert set(want) <= set(r.spans.split(",")) | {""}


def test_base_against_plain_patterns(spark):
    rng = random.Random(5)
    texts = [None, "", "a@b.c_d@e.f", "a@b.c@d.e", "x@y", "é😀 a.b@c-d.e.f. 1.2.3.4.5.6.7.8 1.2.3.400.5.6.7 0001.002.3.4 256.1.1.1 00000000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "+1 (988) 555-2485 +1+2 +123456789012345678", "+1 2 3 4 5 6 7 8 9 0-", "1.2.3.4@x.y", "49927398716 0000000000000000 0"]
    parts = ["a", "b.c", "@", "@", ".", "x.y", "-", "_", "+", " ", " ", "1", "23", "255", "256", "4111111111111111", "0", "(", ")", "é", "😀", "\n", "%"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    digits = ["0", "1", "5", "11", "4111", " ", "-", "  ", ".", "+"]
    texts += ["".join(rng.choice(digits) for _ in range(rng.randint(10, 80))) for _ in range(1500)]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        check(got[i], t)


def test_long_texts(spark):
    texts = ["me@host.example.org 10.0.0.1 " * 20_000, "a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" + "b." * 100_000, "+1" + " " * 200_000, "1 " * 150_000]
    got = run(spark, texts)
    for i, t in enumerate(texts[:1]):
        check(got[i], t)
    assert got[1].spans == "" and got[2].spans == ""


def test_bootstrap_finds_contexts_of_seeds(spark):
    texts = [f"Call phone: +1 (555) 555-01{i:02d} now or mail: u{i}@x.org today" for i in range(20)]
    texts += ["Call phone: 555-0199x now", "see version 2.0 and phone: 77-88", "mail: user(at)x9 today"] + [f"the version {i}.1" for i in range(5)] + ["no digits", "version +1 (555) 555-0188"]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        check(got[i], t)
    assert got[20].spans == "phone:12:21" and got[20].n_found == 1
    assert got[21].spans == "phone:27:32"
    assert got[22].spans == "email:6:16"
    assert all(got[i].spans == "" for i in range(23, 29))
    # no other context: a seed's own tokens add nothing
    assert all(got[i].n_found == 0 for i in range(20))


def test_no_python_in_the_plan(spark):
    plan = P.digest(P.find(spark.createDataFrame([(1, "a@b.c", "x", 1)], SCHEMA)))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_repeated_null_and_empty(spark):
    rows = [(None, "a@b.c", "x", 1), (1, "a@b.c", "x", 1), (1, "a@b.c", "x", 1)]
    got = P.digest(P.find(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == 3 and all(r.spans == "email:0:5" for r in got)
    assert P.digest(P.find(spark.createDataFrame([], SCHEMA))).count() == 0


def test_bootstrap_finds_values_of_several_tokens(spark):
    texts = [f"Call phone: +1 (555) 555-01{i:02d} now or mail: u{i}@x.org today" for i in range(20)]
    texts += ["Call phone: 555 123\n4567. Then", "phone: 555-0199x, mail: user(at)x9!) today", "phone: 77 88; a@b.org 99 later", "phone: 77 x=a@b.org", "phone: 1" + "." * 50_000 + "1 " * 50_000, "phone: @... so", "555 123 alone"]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        check(got[i], t)
    assert all(got[i].n_found == 0 for i in range(20))
    assert got[20].spans == "phone:12:24"
    assert got[21].spans == "phone:7:16,email:24:34"
    assert got[22].spans == "phone:7:12,email:14:21"
    assert got[23].spans == "phone:7:9,email:12:19"
    assert got[24].spans == f"phone:7:{len(texts[24]) - 1}"
    assert got[25].spans == ""
    assert got[26].spans == ""


def test_found_values_make_new_patterns(spark):
    seeds = [f"call line +1 (555) 555-01{i:02d} please" for i in range(20)]
    first = [f"call line {i}77-x{i} please" for i in range(8)]  # in the seeds' pattern
    second = [f"fax desk {i}77-x{i} thanks" for i in range(8)]  # the same values in another
    third = ["fax desk 991-zz thanks"]  # only in the second pattern
    clean = [f"chapter {i} of 12 begins" for i in range(8)] + ["see table 4 below"]
    texts = seeds + first + second + third + clean
    got = run(spark, texts)
    for i, t in enumerate(texts):
        check(got[i], t)
    at = len(seeds)
    assert all(got[i].n_found == 1 for i in range(at, at + 17))
    assert got[at + 16].spans == "phone:9:15"
    assert all(got[i].n_found == 0 for i in range(at + 17, len(texts)))
    # one round knows the seeds' patterns only
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    once = {r.doc_id: r for r in P.digest(P.find(spark.createDataFrame(rows, SCHEMA), rounds=1)).collect()}
    assert once[at].n_found == 1 and once[at + 16].n_found == 0


def test_keys_are_found_by_their_context(spark):
    keys = [f"{i:x}a9f{'0123456789abcdef'[i]}44c{i:x}77de{i:x}01b{i:x}92e{i:x}8" for i in range(6)]
    texts = [f'set token = "{k}" here' for k in keys] + ['set token = "short-1" here', "order 20240101abcdefghijklmnop arrived", "the 3 of 4"]
    got = run(spark, texts)
    for i in range(6):
        assert got[i].spans == f"secret:13:{13 + len(keys[i])}"
    assert got[6].spans == "secret:13:20"
    assert got[7].n_found == 0 and got[8].n_found == 0


def test_precision_on_labelled_contexts(spark):
    """Contexts of identifiers and of plain numbers, by hand: what is found beyond the base is right in at least 0.85 of the cases ("to: 12 people" is not)."""
    good = [f"phone: +1 (555) 555-02{i:02d} ok" for i in range(10)] + [f"write to: p{i}@mail.example.org soon" for i in range(10)]
    hidden = [("phone: 555-77{0}1 ok", "phone"), ("write to: p{0}(at)mail.example soon", "email")]
    positive = [(t.format(i), k) for t, k in hidden for i in range(4)]
    negative = [f"page {i} of 30" for i in range(8)] + [f"version 1.{i} is out" for i in range(5)] + ["room: 17 ok", "to: 12 people", "phone calls 3 a day", "write 5 pages"]
    texts = good + [t for t, _ in positive] + negative
    got = run(spark, texts)
    right = sum(got[len(good) + i].spans.startswith(k + ":") for i, (_, k) in enumerate(positive))
    wrong = sum(got[len(good) + len(positive) + i].n_found for i in range(len(negative)))
    assert right >= 7 and right / (right + wrong) >= 0.85


def graph(edges, rounds, support, prior, confident):
    """scored_patterns() in plain Python."""
    pairs = {(p, v) for p, v, _ in edges}
    values = {p: {v for q, v in pairs if q == p} for p, _ in pairs}
    seeds = {(v, k): 1.0 for _, v, k in edges if k >= 0}
    accepted, patterns = dict(seeds), {}
    for _ in range(rounds):
        patterns = {}
        for p, vs in values.items():
            best = []
            for k in {k for _, k in accepted}:
                held = [accepted[v, k] for v in vs if (v, k) in accepted]
                score = sum(held) / (len(vs) + prior)
                if len(held) >= support and score >= confident:
                    best.append((score, -k))
            if best:
                patterns[p] = max(best)
        accepted = dict(seeds)
        for v in {v for _, v, k in edges if k < 0}:
            for k in {-b for _, b in patterns.values()}:
                miss = [1 - patterns[p][0] for p, w, x in set(edges) if w == v and x < 0 and p in patterns and patterns[p][1] == -k]
                if miss:
                    gain = 1.0
                    for m in miss:
                        gain *= m
                    accepted[v, k] = max(accepted.get((v, k), 0.0), 1 - gain)
    return {p: (-k, s) for p, (s, k) in patterns.items()}


def test_graph_against_plain_python(spark):
    rng = random.Random(21)
    for case in range(3):
        edges = sorted({(f"p{rng.randint(0, 9)}", f"v{v}", v % 2 if v < 28 else -1) for v in (rng.randint(0, 40) for _ in range(170))})
        got = P.scored_patterns(spark.createDataFrame(edges, "pattern string, value string, kind int"), rounds=3, support=2, prior=1.0, confident=0.25 + 0.02 * case)
        want = graph(edges, 3, 2, 1.0, 0.25 + 0.02 * case)
        have = {r.pattern: (r.k, r.score) for r in got.collect()}
        assert want and have.keys() == want.keys()
        assert all(have[p][0] == k and abs(have[p][1] - s) < 1e-9 for p, (k, s) in want.items())


def test_identifiers_that_no_seed_pattern_matches(spark):
    """Contexts of four kinds; in each, values that the base finds and others that it can't. Recall of the others, and precision."""
    known = {"phone": "+1 (555) 555-0{0:03d}", "email": "p{0}@mail.example.org"}
    unseen = {"phone": ["555.77{0}1", "0{0}44 12-{0}", "ext. 9{0}7"], "email": ["p{0}(at)mail.example", "p{0}@localhost", "p{0} at mail9.example"]}
    context = {"phone": ["you can reach us by phone: {} today", "name=x tel={} y", "row <td>{}</td> end", "my number is {} ok"], "email": ["please write to {} soon", "contact mail={} z", 'see "mailto:{}" there', "her address: {}, always"]}
    texts, planted = [], {}
    for k, forms in context.items():
        for c, form in enumerate(forms):
            texts += [form.format(known[k].format(100 * c + i)) for i in range(12)]
            for u, other in enumerate(unseen[k]):
                value = other.format(10 * c + u + 1)
                planted[len(texts)] = (k, form.index("{}"), value)
                texts.append(form.format(value))
    clean = len(texts)
    texts += [f"page {i} of 30" for i in range(12)] + [f"chapter {i}: the year {1900 + i}" for i in range(12)] + [f"size={i}px width:{i}em" for i in range(12)] + [f"<li>{i} pieces</li>" for i in range(12)]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        check(got[i], t)
    right = sum(any(s.split(":")[0] == k and int(s.split(":")[1]) == at for s in got[i].spans.split(",") if s) for i, (k, at, _) in planted.items())
    found = sum(r.n_found for r in got.values())
    assert right / len(planted) >= 0.5 and right / found >= 0.85, (right, len(planted), found)
    assert all(got[i].n_found == 0 for i in range(clean, len(texts)))

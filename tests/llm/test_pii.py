import hashlib
import random
import re
from collections import Counter

from touchline.llm import pii
from touchline.llm.base import table

RES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0


def base(text):
    out = []
    for k, (kind, pattern) in enumerate(RES.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".") if kind == "ip"), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), m[0]))
    return sorted(out)


def protected(text):
    keys = [(m.start(), 4, m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9_-]{32,}", text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    return sorted(base(text) + keys)


def levels(k, m):
    """The entities of a span: its kind, its class and its value in plain form."""
    m = m.lower()
    digits = re.sub("[^0-9]", "", m)
    group = [m.split("@")[-1], ".".join(m.split(".")[:2]), digits[:6], digits[:4], ""][k]
    return {(k, 0, ""), (k, 1, group), (k, 2, digits if k in (2, 3) else m)}


def disclosed(rows, support, root):
    """(doc_id, begin, end, what) by counting everything in plain Python; all texts have terms of their own, so each is one piece of evidence."""
    spans = {d: protected(t) for d, t in rows}
    words = {d: [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t) if len(m[0]) >= pii.TERM] for d, t in rows}
    free = {d: [(a, b, w) for a, b, w in ws if not any(x <= b and a <= z for x, _, z, _ in spans[d])] for d, ws in words.items()}
    of = {d: {e for _, k, _, m in v for e in levels(k, m)} for d, v in spans.items()}
    n_e, n_t, n_te = Counter(e for v in of.values() for e in v), Counter(w for v in words.values() for w in {w for _, _, w in v}), Counter()
    for d, v in of.items():
        n_te.update((w, e) for e in v for w in {w for _, _, w in free[d]})
    told = {}
    for (w, e), n in n_te.items():
        p = n_e[e] / len(rows)
        share = (n + pii.PRIOR * p) / (n_t[w] + pii.PRIOR)
        if n >= support and n_e[e] >= support and share > p and share**root >= p:
            told[w] = max(told.get(w, (0, 0)), (share, -e[0]))
    return {(d, a, b, -1 if told[w][0] >= pii.SURE else -told[w][1]) for d, ws in free.items() for a, b, w in ws if w in told}


def test_base_spans_as_regular_expressions(spark):
    r = random.Random(1)
    bits = ["a@b.c", "x.y@d-e.fr.uk", "@", ".", "..", "1.2.3.4", "256.1.1.1", "10.0.0.255.7.8.9.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123456", "+1", "1234567", "ü", "é@x.y", " ", "\n", "-", "_", "000.00001.1.1", "+1 2 3 4 5 6 7 8 9 0"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 14))) for _ in range(400)]
    texts += [None, "", "7" * 40_000, "1 " * 30_000 + "4111111111111111", "a" * 50_000 + "@" + "b." * 20_000 + "c", "+" * 5000 + "1 " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r for r in pii.digest(pii.sanitise(docs)).collect()}
    for i, text in enumerate(texts):
        want = base(text)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == k for x in want) for k in range(4)], text
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e, _ in want)
        assert got[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()


def test_terms_as_counting(spark, monkeypatch):
    monkeypatch.setattr(pii, "SURE", 0.75)
    r = random.Random(2)
    people = [(f"user{i}@mail{i % 2}.example", f"codename{i}", f"project{i % 3}") for i in range(6)]
    filler = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(240):
        ws = [f"own{i}"] + [r.choice(filler) for _ in range(r.randrange(3, 25))]
        if i % 2:
            mail, name, project = r.choice(people)
            at = r.randrange(len(ws))
            ws[at:at] = [r.choice([name, name, r.choice(filler)]), mail, r.choice([project, "Contact"])]
        if i % 5 == 0:
            ws += ["token", "=", f'"{random.Random(i).getrandbits(160):040x}"']
        rows.append((i, r.choice(["", "\n"]) + r.choice([" ", "  "]).join(ws)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(pii, "_signs", lambda beside: pii.F.hash(beside))  # texts here are no near copies
    want = disclosed(rows, 3, 4)
    got = {(x.doc_id, t.s, t.e, t.what) for x in pii.sanitise(docs, support=3).collect() for t in x.terms}
    assert got == want and {-1, 0} <= {x[3] for x in want}

    spans = {d: protected(t) for d, t in rows}
    clean = {x.doc_id: x.text for x in pii.sanitised(docs, support=3).collect()}
    assert len(clean) == len(rows)
    for d, text in rows:
        marks = sorted([(s, e, f"<{pii.NAMES[k]}>") for s, k, e, _ in spans[d]] + [(a, b, "" if what < 0 else f"<{pii.NAMES[what]} term>") for i, a, b, what in want if i == d], reverse=True)
        for a, b, put in marks:
            text = text[:a] + put + text[b:]
        assert clean[d] == text


def test_terms_anywhere(spark):
    """A term far from its entity is evidence, and goes wherever it is, also without the entity; copies are no further evidence."""
    fars = [" ".join(f"filler{i * 7 + j}" for j in range(20)) for i in range(12)]
    far = " ".join(fars[:2])
    rows = [(i, f"The codename{i} is Bluebird, of own{i} and {fars[i]} mail a{i}@b.example now") for i in range(12)]
    rows += [(12, "Only bluebird. is here"), (13, "(bluebird) x"), (None, "null id with Bluebird!"), (14, "blue birds"), (15, None)]
    rows += [(50 + i, "copies tell of walrus c@d.example often") for i in range(30)]
    rows += [(i, f"{far} plain text {i} the mail codename only here now") for i in range(100, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.sanitise(docs, support=5).collect()
    clean = {x.doc_id: x.text for x in pii.sanitised(docs, support=5).collect()}
    assert len(found) == len(rows) and len(clean) == len(rows)
    assert clean[0] == f"The codename0 is <email term>, of own0 and {fars[0]} mail <email> now"
    assert clean[12] == "Only <email term>. is here" and clean[13] == "(<email term>) x" and clean[None] == "null id with <email term>!" and clean[14] == "blue birds" and clean[15] is None
    assert clean[50] == "copies tell of walrus <email> often"
    assert all(clean[i] == t for i, t in rows if i and i >= 100)


def test_terms_that_announce_secrets(spark):
    """On a whole table: what the method finds besides the patterns, and that nothing else is taken for it."""
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    told = total = right = 0
    for x in pii.sanitise(docs).collect():
        announced = [m.start() for m in re.finditer(r'\btoken\b(?= = ")', text[x.doc_id])]
        total += len(announced)
        right += len({t.s for t in x.terms} & set(announced))
        told += len(x.terms)
    assert total > 100 and right >= 0.95 * total and right >= 0.9 * told

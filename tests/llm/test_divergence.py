"""Divergence of sources against plain counting; a sketch too small for its terms changes nothing."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from touchline.llm import divergence
from touchline.llm.base import table

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=3, top=200):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOW))) for lang, source, text in rows]
    seen, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        seen[lang].update(set(terms))
        count[lang, source].update(terms)
    kept = {lang: sorted(t for t, n in c.items() if n >= min_docs) for lang, c in seen.items()}
    total = defaultdict(Counter)
    for (lang, _), c in count.items():
        total[lang].update(c)
    n = lambda c, lang: sum(c[t] for t in kept.get(lang, []))
    p = lambda c, t, lang, size: 1 + 10**9 * (c[t] + 1) // (size + len(kept[lang]))
    gap = lambda p, q: (p - q) ** 2 // q
    out, sizes = [], {g: n(c, g[0]) for g, c in count.items()}
    for lang, source in count:
        own, terms = count[lang, source], kept.get(lang, [])
        pairs = [(sum(gap(p(own, t, lang, sizes[lang, source]), p(count[lang, s], t, lang, sizes[lang, s])) for t in terms), s) for a, s in count if a == lang and s != source]
        found = []
        for t in terms:
            a, b = p(own, t, lang, sizes[lang, source]), p(total[lang], t, lang, n(total[lang], lang))
            if own[t] and a > b:
                found.append((gap(a, b), t))
        for part, items in (("pair", pairs), ("term", found)):
            ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


@pytest.mark.parametrize("cells", [1 << 20, 1 << 12])
def test_as_counting(spark, odd_folder, cells):
    for folder in (odd_folder, "/root/testdata/sf0.001"):
        docs = table(spark, folder, "documents")
        got = divergence.report(divergence.audit(docs, 3, cells), 50).select("lang", "source", "part", "item", "value", "rank").collect()
        assert sorted(map(tuple, got)) == brute([(r.lang, r.source, r.text) for r in docs.collect()], 3, 50)


def test_many_documents_saturate_the_sketch(spark):
    rows = [("en", f"s{i % 3}", f"often Often word{i % 90} Ärger\n") for i in range(700)] + [("en", "s0", "rare"), ("en", "s1", "rare 1rare2"), ("", None, None), ("de", None, "##")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    got = divergence.report(divergence.audit(docs)).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_sketch_never_underestimates(spark):
    r = np.random.default_rng(1)
    words = [f"x{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)]
    rows = [("en", "a", " ".join(r.choice(words, 30))) for _ in range(300)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    seen = Counter(w for _, _, t in rows for w in set(t.split()))
    counted = {x.term: x.docs for x in divergence.counts(docs, 3, 1 << 10).collect()}
    assert all(counted.get(w) == n for w, n in seen.items() if n >= 3)

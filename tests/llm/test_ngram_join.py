import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from touchline.llm import ngram_join as J
from touchline.llm import textblocks as tb


def shingles(text, n):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n, percent):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, families=12, copies=7):
    """Families of near copies with a few words changed, sharing a common passage."""
    r = random.Random(seed)
    word = lambda: "w" + str(r.randrange(400))
    common = [word() for _ in range(60)]
    rows = []
    for _ in range(families):
        base = [word() for _ in range(r.choice([1, 2, 3, 5, 12, 40, 90, 200]))] + (common if r.random() < 0.5 else [])
        for _ in range(copies):
            own = list(base)
            for _ in range(r.randrange(0, 1 + len(own) // 15)):
                own[r.randrange(len(own))] = word()
            rows.append((len(rows) * 3 + 1, " ".join(own)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_trie_finds_all(percent):
    r = np.random.default_rng(percent)
    base = np.unique(r.integers(0, 300, 60))
    sets = []
    for _ in range(40):
        keep = base[r.random(len(base)) > 0.08]
        sets.append(np.unique(np.concatenate([keep, r.integers(0, 300, r.integers(0, 8))])))
    sets = [s for s in sets if len(s)] + [sets[0], np.array([5]), np.array([5, 6])]
    trie, mark = J.Trie(sets), np.zeros(301, bool)
    for s in sets:
        want = {j for j, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= percent * len(np.union1d(s, t))}
        assert set(trie.like(s, mark, percent).tolist()) == want
    assert not mark.any()


@pytest.mark.parametrize("percent", [80, 90])
def test_blocks_lose_no_link(percent):
    rows = corpus(percent)
    texts = pa.array([t for _, t in rows])
    (piece,) = tb.pieces(texts)
    with np.errstate(over="ignore"):
        grams, begins = J.sets_of(piece, 3)
        found = J.block_keys(grams, begins, percent)
    own = [set(found.keys[found.whose == i].tolist()) for i in range(len(rows))]
    often = Counter(found.keys.tolist())
    rare = []
    for i in range(len(rows)):  # what is left of each class without the most frequent keys
        of = {c: sorted((found.whose == i).nonzero()[0][found.cls[found.whose == i] == c], key=lambda k: (often[int(found.keys[k])], int(found.keys[k]))) for c in set(found.cls[found.whose == i].tolist())}
        rare.append({int(found.keys[k]) for ks in of.values() for k in ks[: len(ks) - int(found.drop[ks[0]])]})
    sets = [set(grams[begins[i] : begins[i + 1]].tolist()) for i in range(len(rows))]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                assert own[i] & own[j]
                assert rare[i] & rare[j]


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_groups_as_brute_force(spark, n, percent, monkeypatch):
    rows = corpus(n) + [(900, None), (901, ""), (902, " \n\t "), (903, "One"), (904, "oNE"), (905, "one two"), (906, "ONE  two"), (907, "Ünï Ñ"), (908, "ünï Ñ")]
    rows += [(4, rows[0][1]), (1000, " ".join(f"x{i}" for i in range(30_000)))]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, key string, node int")
    want = brute(rows, n, percent)
    assert sorted(map(tuple, J.jaccard_groups(docs, n, percent).collect())) == want
    monkeypatch.setattr(J, "CHUNK", 3)  # groups over pairs of chunks
    monkeypatch.setattr(J, "PIVOTS", 2)
    monkeypatch.setattr(J, "HOT_ROWS", 0)  # keys of full cells are counted by partial sums
    assert sorted(map(tuple, J.jaccard_groups(docs, n, percent).collect())) == want


def test_large_group_without_one_family(spark, monkeypatch):
    """A group of many sets, most of which are not alike, although a passage ties them."""
    monkeypatch.setattr(J, "CHUNK", 4)
    monkeypatch.setattr(J, "PIVOTS", 2)
    monkeypatch.setattr(J, "_groups", lambda scanned: scanned.where("n_shingles > 0").select("node", J.F.lit(1).cast("long").alias("grp")).distinct())
    rows = corpus(8, families=9, copies=5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_groups(docs, 3, 90).collect())) == brute(rows, 3, 90)


def test_links_of_null_ids(spark):
    a = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, a), (5, a + " more"), (None, "x y z"), (None, "x y z")], "doc_id long, text string")
    assert sorted(map(str, J.jaccard_groups(docs, 3, 90).collect())) == sorted(map(str, [Row(doc_id=None, n_shingles=58, component_id=5), Row(doc_id=5, n_shingles=59, component_id=5)] + [Row(doc_id=None, n_shingles=1, component_id=None)] * 2))


def test_empty_table_and_copies(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert J.jaccard_groups(docs).collect() == [] and J.without_copies(docs).collect() == []
    rows = [(i, "a b c d e f g h") for i in range(5)] + [(9, "z y x"), (None, "q r s"), (7, None), (7, None), (8, " \n"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, [r.doc_id for r in J.without_copies(docs).collect()])) == ["0", "7", "7", "8", "9", "None", "None"]


def test_texts_that_differ_stay_whatever_their_ids(spark):
    a, b, c, d, e = ("one two three four five six", "seven eight nine ten", "red green blue black white grey", "up down left right", "cold warm hot")
    rows = [(1, a, 0), (5, a, 1), (5, b, 2), (None, c, 3), (None, d, 4), (None, e, 5), (5, b, 6), (None, e, 7), (None, a, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = sorted(((r.doc_id, r.text) for r in J.without_copies(docs).collect()), key=str)
    assert got == sorted([(1, a), (5, b), (None, c), (None, d), (None, e)], key=str)


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_sketches_lose_no_pair(percent):
    """Sets that are alike are joined, of one size or not, in one chunk or two; others rarely."""
    r = np.random.default_rng(percent)
    sets = []
    for size in (3, 20, 60, 70, 130, 500, 900):
        base = r.integers(0, 1 << 62, size).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[r.random(size) > cut], r.integers(0, 1 << 62, int(size * more)).astype(np.uint64)])) for cut in (0, 0.05, 0.1, 0.3) for more in (0, 0.05, 0.2)]
    sets = [s for s in sets if len(s)]
    begins = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    words, at = J.sketches(np.concatenate(sets), begins)
    words = [words[at[i] : at[i + 1]] for i in range(len(sets))]
    assert len({len(w) for w in words}) > 3
    alike = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))
    for few in (slice(0, 24), slice(24, 48), slice(48, 84), slice(0, 84)):
        which = list(range(len(sets)))[few]
        for left in (np.zeros(len(which), bool), np.arange(len(which)) % 2 == 0):
            name = np.arange(len(which))
            for x, y in zip(*J.close_pairs([words[i] for i in which], np.diff(begins)[which], left, percent), strict=True):
                name[name == name[x]] = name[y]
            assert all(name[x] == name[y] for x in range(len(which)) for y in range(x) if alike(which[x], which[y]) and (left[x] != left[y] or not left.any()))
    assert percent < 80 or not len(J.close_pairs([words[-1], words[-13]], np.diff(begins)[[-1, -13]], np.zeros(2, bool), percent)[0])


def test_shared_passages_make_no_group(spark, tmp_path, monkeypatch):
    """Texts that share passages with others, but are like none of them, are in no candidate group: joined with all of its group, each would cost the square of the table."""
    r = random.Random(5)
    passages = [" ".join(f"p{k}x{i}" for i in range(25)) for k in range(30)]
    rows = [(k, " ".join([f"w{r.randrange(10**6)}" for _ in range(60)] + [passages[r.randrange(30)] for _ in range(2)])) for k in range(150)]
    rows += [(1000 + k, rows[k][1] + " more") for k in range(4)]
    asked, groups = [], J._groups
    monkeypatch.setattr(J, "_groups", lambda keyed: asked.append(groups(keyed).collect()) or spark.createDataFrame(asked[-1], "node long, grp long"))
    got = sorted(map(tuple, J.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()))
    assert [(d, c) for d, _, c in got if d != c] == [(1000 + k, k) for k in range(4)]
    assert max(Counter(x.grp for x in asked[0]).values()) == 2 and len(asked[0]) == 8


def test_vertex_in_chunks(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(J, "SIFTED", 2)
    assert sorted(map(tuple, J.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect())) == brute(rows, 3, 80)

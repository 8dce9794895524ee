"""N-gram Jaccard join: all documents whose sets of word n-grams are at least ``percent`` per cent alike.

How it scales
1. A task turns each document into the sorted set of its n-gram hashes and keeps only the set's size, a 64-bit signature,
   a parity sketch and block keys. Documents with equal sets are one node from here on; within a task only the first of them
   brings keys and a sketch.
2. Block keys follow the pigeonhole principle: two sets of at most U n-grams each that are alike differ in at most
   H = 2U(100-percent)/(100+percent) n-grams. Each set is cut by hash into some H + H/6 parts, and a key is the hash of a
   whole part. At most H keys of a set are missing in a set that is like it, so both have one of the H + 1 keys that are
   rarest in the corpus (prefix filtering). Only these count: a passage that very many documents share gives frequent keys,
   which does not bring them together.
3. Each key moves once: rows meet by key, and those whose key only one node has end there (keys in cells that hold far more
   rows than others are counted with partial sums instead and joined back, so no key is gathered). This is done in SLICES
   passes, a part of the keys each, whose shuffle files go before the next. What is left moves once more, by node, where the
   most frequent keys are left out. The plan is the same at every size.
4. Nodes that share a remaining key are tied to a vertex of that key's lowest node and size class. Of the nodes of a vertex
   those are a candidate pair whose sketches differ in no more bits than their sets may in n-grams; connected components of
   the pairs are the candidate groups. Without the sketches a shared passage here and there would tie most texts into one
   group, which would grow with the table and be joined with itself.
5. A group's texts are read again, and their sets meet in one task as a prefix-tree (trie) join: the sets, in one
   global order, are stored in a path-compressed trie; a set is matched against it from the root, so the overlap of a shared
   path is counted once, and a subtree is left as soon as the remaining lengths cannot reach the needed overlap.
6. A group of more than ``CHUNK`` sets is first joined chunk by chunk, a few pivots in all of them. That makes one class of a
   family whose members are alike, at a cost in proportion to its size. Only the sets outside the group's largest class
   are then matched against the other chunks.
7. Found links go to connected components again.
No link is lost at any step; the only hashing is that of n-grams to 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textblocks as tb
from .base import WORD, components, cut, forest, perhaps, release, stage, swept

#: sets in a chunk of a large candidate group
CHUNK = 1024
#: n-grams in a chunk, about; a single longer set is a chunk of its own
CHUNK_GRAMS = 1_000_000
#: n-grams that a task of the trie join gets, about
TASK_GRAMS = 200_000
#: sets of a large group that go to all of its chunks
PIVOTS = 16
#: keys are counted in so many cells; a cell with more rows than this, and than 8 times the mean, has a hot key
CELLS, HOT_ROWS = 1 << 16, 1_000_000
#: signatures that a task remembers, to bring the keys of equal sets once; beyond that it starts anew
REMEMBERED = 200_000
#: the block keys are counted in so many passes, by their highest bits
SLICES = 4
#: bits of a sketch: the power of two that is not below the set's size, within these bounds (a full sketch lets every pair pass)
LEAST_BITS, MOST_BITS = 64, 1 << 16
#: sketches in a chunk of a vertex, and 64-bit words that are compared at once, about
SIFTED, SIFT_WORDS = 4096, 1 << 21
#: sizes in a class differ by a factor of 1.5 at most, or by as much as sizes of sets that are alike can
CLASS = 150


@cache
def size_classes(percent: int, most: int = 1 << 40) -> np.ndarray:
    """Lower bounds of the classes of set sizes."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * max(CLASS, -(-10_000 // percent)) // 100))
    return np.array(out, np.int64)


def sets_of(piece: tb.Piece, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all documents of a piece, one after another, and where each document begins."""
    w = tb.words(piece, lower=True)
    first, grams = tb.windows(w, n)
    doc = w.doc[first]
    for k in range(1, n):  # shorter texts: the whole sequence is the only n-gram
        f, g = tb.windows(w, k)
        own = w.counts[w.doc[f]] == k
        grams, doc = np.concatenate([grams, g[own]]), np.concatenate([doc, w.doc[f[own]]])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    if len(grams):
        keep = np.ones(len(grams), bool)
        keep[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
        grams, doc = grams[keep], doc[keep]
    return grams, np.searchsorted(doc, np.arange(piece.n + 1))


def signatures(grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; 0 for an empty one."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(tb.mix(grams ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    sizes = np.diff(begins).astype(np.uint64)
    return np.where(sizes > 0, tb.mix(sums[begins[1:]] - sums[begins[:-1]] + sizes), np.uint64(0))


def sketches(grams: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches of the sets as 64-bit words, one after another, and where each begins: each n-gram flips one of the bits, so two
    sketches of as many bits differ in no more of them than their sets in n-grams. A sketch of half the bits is its halves' exclusive or."""
    sizes = np.diff(begins)
    bits = np.int64(1) << np.ceil(np.log2(np.clip(sizes, LEAST_BITS, MOST_BITS))).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(bits // 64)])
    bit = tb.mix(grams ^ np.uint64(0x9E6C63D0876A9A35)) % np.repeat(bits, sizes).astype(np.uint64)
    words = np.zeros(int(at[-1]), np.uint64)
    np.bitwise_xor.at(words, np.repeat(at[:-1], sizes) + (bit // np.uint64(64)).astype(np.int64), np.uint64(1) << (bit % np.uint64(64)))
    return words, at


def close_pairs(words: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest whose components are those of all pairs that can be alike by their sketches: between ``left`` (a mask) and the others, or among all if it is empty."""
    fewest = min(map(len, words))
    every = np.array([np.bitwise_xor.reduce(w.reshape(-1, fewest), axis=0) for w in words])
    by_size = np.argsort(sizes, kind="stable")
    rows, cols = (by_size[left[by_size]], by_size[~left[by_size]]) if left.any() else (by_size, by_size)
    n, a, b = sizes[cols], np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = max(1, SIFT_WORDS // (len(cols) * min(fewest, 64)))
    for at in range(0, len(rows), step):
        r = rows[at : at + step]
        first = at if not left.any() else np.searchsorted(n, -(-int(sizes[r[0]]) * percent // 100))
        c = cols[first : np.searchsorted(n, int(sizes[r[-1]]) * 100 // percent, "right")]
        apart = np.zeros((len(r), len(c)), np.int64)
        for k in range(0, fewest, 64):  # a few words at a time, as single rows may be long
            apart += np.bitwise_count(every[r, None, k : k + 64] ^ every[None, c, k : k + 64]).sum(axis=2, dtype=np.int64)
        i, j = np.nonzero(apart <= (sizes[r][:, None] + sizes[c][None, :]) * (100 - percent) // (100 + percent))
        a, b = np.concatenate([a, r[i]]), np.concatenate([b, c[j]])
        a, b = forest(a, b)
    return a, b


class Keys(NamedTuple):
    """Block keys, the set of each, its size class, and how many of the most frequent keys of that set and class don't count."""

    keys: np.ndarray
    whose: np.ndarray
    cls: np.ndarray
    drop: np.ndarray


def block_keys(grams: np.ndarray, begins: np.ndarray, percent: int) -> Keys:
    """Block keys of the sets. A set has keys of its size class, and of the next one if a set of that class can be like it. An empty
    part gives a key only in the rare set that has too few other parts; all keys of such a set count."""
    sizes, classes = np.diff(begins), size_classes(percent)
    own = np.searchsorted(classes, sizes, "right") - 1
    found = [Keys(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
    for step in (0, 1):
        use = np.flatnonzero((sizes > 0) & (sizes * 100 >= percent * classes[own + step] * (step > 0)))
        cls = own[use] + step
        most = 2 * (classes[cls + 1] - 1) * (100 - percent) // (100 + percent)
        use, cls, most = (x[most > 0] for x in (use, cls, most))
        parts = most + 3 + most // 6
        if not len(use):
            continue
        lens = sizes[use]
        at = np.repeat(begins[use] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
        base = np.cumsum(parts) - parts
        g = grams[at]
        slot = np.repeat(base, lens) + (tb.mix(g + np.repeat(cls, lens).astype(np.uint64)) % np.repeat(parts, lens).astype(np.uint64)).astype(np.int64)
        total = np.zeros(int(parts.sum()), np.uint64)
        np.add.at(total, slot, tb.mix(g ^ np.uint64(0x2545F4914F6CDD1D)))
        full = np.bincount(slot, minlength=len(total)) > 0
        owner = np.repeat(np.arange(len(use)), parts)
        number = np.arange(len(total)) - base[owner]
        n = np.add.reduceat(full, base, dtype=np.int64)
        full |= (n <= most)[owner]
        label = (cls[owner] * 1_000_003 + number).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        found.append(Keys(tb.mix(total + label)[full], use[owner][full], cls[owner][full], np.maximum(n - most - 1, 0)[owner][full]))
    return Keys(*map(np.concatenate, zip(*found, strict=True)))


class Trie:
    """Path-compressed trie over sets of ordered numbers, as arrays. Node i holds tokens[begin[i]:end[i]] below its parent."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i8").tobytes())
        begin, end, depth, low, high, kids, here = [0], [0], [0], [1 << 62], [0], [[]], [[]]
        tokens: list[np.ndarray] = []
        size, path, last = 0, [0], None
        for i in order:
            s = sets[i]
            if last is None:
                shared = 0
            else:
                m = min(len(last), len(s))
                differ = np.flatnonzero(last[:m] != s[:m])
                shared = int(differ[0]) if len(differ) else m
            below = None
            while depth[path[-1]] > shared:
                below = path.pop()
            top = path[-1]
            if depth[top] < shared:  # the last branch parts inside a node: cut that node in two
                mid = len(begin)
                cutting = begin[below] + shared - depth[top]
                for column, value in ((begin, begin[below]), (end, cutting), (depth, shared), (low, low[below]), (high, high[below]), (kids, [below]), (here, [])):
                    column.append(value)
                begin[below] = cutting
                kids[top][-1] = mid
                path.append(mid)
                top = mid
            if len(s) > shared:
                new = len(begin)
                tokens.append(s[shared:])
                for column, value in ((begin, size), (end, size + len(s) - shared), (depth, len(s)), (low, len(s)), (high, len(s)), (kids, []), (here, [])):
                    column.append(value)
                size += len(s) - shared
                kids[top].append(new)
                path.append(new)
            here[path[-1]].append(i)
            for node in path:
                low[node], high[node] = min(low[node], len(s)), max(high[node], len(s))
            last = s
        self.tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
        self.begin, self.end, self.depth = (np.array(x, np.int64) for x in (begin, end, depth))
        self.low, self.high = np.array(low, np.int64), np.array(high, np.int64)
        self.kid_at = np.concatenate([[0], np.cumsum([len(x) for x in kids])])
        self.kids = np.array([y for x in kids for y in x], np.int64)
        self.set_at = np.concatenate([[0], np.cumsum([len(x) for x in here])])
        self.sets = np.array([y for x in here for y in x], np.int64)

    def like(self, s: np.ndarray, mark: np.ndarray, percent: int) -> np.ndarray:
        """Which sets are alike ``s`` (sorted, not empty). ``mark``: a scratch array of False, one place for each token."""
        mark[s] = True
        node, overlap, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(node):
            done = self.set_at[node + 1] > self.set_at[node]
            if done.any():
                need = -(-percent * (len(s) + self.depth[node]) // (100 + percent))
                for k in node[done & (overlap >= need)]:
                    found.append(self.sets[self.set_at[k] : self.set_at[k + 1]])
            count = self.kid_at[node + 1] - self.kid_at[node]
            if not count.any():
                break
            kid = self.kids[np.repeat(self.kid_at[node] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
            overlap = np.repeat(overlap, count)
            lens = self.end[kid] - self.begin[kid]
            base = np.cumsum(lens) - lens
            at = np.repeat(self.begin[kid] - base, lens) + np.arange(int(lens.sum()))
            overlap = overlap + np.add.reduceat(mark[self.tokens[at]], base, dtype=np.int64)
            rest = len(s) - np.searchsorted(s, self.tokens[self.end[kid] - 1], "right")
            depth = self.depth[kid]
            size = np.clip(rest + depth, self.low[kid], self.high[kid])  # the set size that can do best from here
            keep = overlap + np.minimum(rest, size - depth) >= -(-percent * (len(s) + size) // (100 + percent))
            node, overlap = kid[keep], overlap[keep]
        mark[s] = False
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def trie_join(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest among ``left`` (and ``right``, numbered on after it): every set of ``left`` is matched
    against a trie of ``right``, or of ``left`` itself. Sets are sorted, distinct and not empty."""
    both = left + (right or [])
    values, dense = np.unique(np.concatenate(both), return_inverse=True)
    cuts = np.cumsum([len(x) for x in both])[:-1]
    both = np.split(dense.astype(np.int64), cuts)
    shift = len(left) if right is not None else 0
    trie, mark, label, links = Trie(both[shift:]), np.zeros(len(values), bool), np.arange(len(both)), []
    for i in range(len(left)):
        found = trie.like(both[i], mark, percent) + shift
        before = label[found]
        for r in np.unique(before):
            j = int(found[np.argmax(before == r)])
            if label[j] != label[i]:
                links.append((i, j))
                low, high = min(label[j], label[i]), max(label[j], label[i])
                label[label == high] = low
    return links


def _scan(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for piece in tb.pieces(batch.column("text")):
                with np.errstate(over="ignore"):
                    grams, begins = sets_of(piece, n)
                    sigs = signatures(grams, begins)
                    new = np.zeros(piece.n, bool)
                    for i, sig in enumerate(sigs.tolist()):
                        if sig not in seen:
                            seen.add(sig)
                            new[i] = True
                    sizes = np.where(new, np.diff(begins), 0)
                    found = block_keys(grams[np.repeat(new, np.diff(begins))], np.concatenate([[0], np.cumsum(sizes)]), percent)
                if len(seen) > REMEMBERED:
                    seen.clear()
                out = {c: batch.column(c).slice(piece.first, piece.n) for c in ("doc_id", "row")}
                out |= {"n_shingles": pa.array(np.diff(begins).astype(np.int64)), "node": pa.array(sigs.view(np.int64))}
                words, at = sketches(grams, begins)
                new &= np.diff(begins) > 0
                out["sketch"] = pa.array([words[at[i] : at[i + 1]].tobytes() if new[i] else None for i in range(piece.n)], pa.binary())
                order = np.argsort(found.whose, kind="stable")
                part = found.keys[order] // np.uint64(-(-(1 << 64) // SLICES))
                for k in range(SLICES):
                    own = order[part == k]
                    at = np.searchsorted(found.whose[own], np.arange(piece.n + 1)).astype(np.int32)
                    parts = pa.StructArray.from_arrays([pa.array(found.keys[own].view(np.int64)), pa.array((found.cls[own] << 32) + found.drop[own])], ["key", "kind"])
                    out[f"keys_{k}"] = pa.ListArray.from_arrays(pa.array(at), parts)
                yield pa.record_batch(out)

    return run


def _sift(group: pa.Table) -> pa.Table:
    """Edges among the nodes of a vertex's chunk, or between its left and its right one, that can be alike."""
    node, left, sizes = (group.column(c).to_numpy() for c in ("node", "left", "n"))
    both = group.column("i")[0] != group.column("j")[0]
    a = b = np.zeros(0, np.int64)
    if len(node) > 1 and not (both and left.all() == left.any()):  # a chunk may be without nodes
        a, b = close_pairs([np.frombuffer(w, np.uint64) for w in group.column("sketch").to_pylist()], sizes, left, group.column("percent")[0].as_py())
    return pa.table({"a": node[a], "b": node[b]})


def _links(n: int, percent: int):
    def run(group: pa.Table) -> pa.Table:
        """Links among the texts of a chunk; if it has a left side, those between the left and the right one."""
        nodes, left, sets = [], [], []
        for batch in group.to_batches():
            node, side = batch.column("node").to_numpy(), batch.column("left").to_numpy(zero_copy_only=False)
            for piece in tb.pieces(batch.column("text")):
                with np.errstate(over="ignore"):
                    grams, begins = sets_of(piece, n)
                    same = signatures(grams, begins).view(np.int64) == node[piece.first : piece.first + piece.n]
                for i in np.flatnonzero(same):  # another row may have the same hash
                    nodes.append(int(node[piece.first + i]))
                    left.append(bool(side[piece.first + i]))
                    sets.append(grams[begins[i] : begins[i + 1]])
        one = {(node, side): i for i, (node, side) in enumerate(zip(nodes, left, strict=True))}
        a, b = ([i for (_, side), i in one.items() if side is which] for which in (True, False))
        pairs = trie_join([sets[i] for i in a], [sets[i] for i in b], percent) if a and b else trie_join([sets[i] for i in b], None, percent) if b else []
        who = a + b
        links = np.array([(nodes[who[i]], nodes[who[j]]) for i, j in pairs], np.int64).reshape(-1, 2)
        return pa.table({"a": links[:, 0], "b": links[:, 1]})

    return run


def _shuffled(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join that sorts and merges at every size, so that small tables show the plan of large ones."""
    return left.join(right.hint("merge"), on, how)


def _shared(keyed: DataFrame) -> DataFrame:
    """``keyed``: key, node, kind. Its rows whose key several nodes have, with n (how often there is the key) and low (its lowest node)."""
    several, each = F.col("low") != F.col("high"), Window.partitionBy("key")
    counts = [F.count("*"), F.min("node"), F.max("node")]
    cell = F.pmod("key", F.lit(CELLS)).alias("cell")
    cells = cut(keyed.groupBy(cell).agg(F.count("*").alias("n")))
    total = cells.agg(F.sum("n")).first()[0] or 0
    hot = cells.where(F.col("n") > max(HOT_ROWS, 8 * total // CELLS)).select("cell")  # CELLS / 8 rows at most
    alone = keyed.withColumn("cell", cell)
    if hot.limit(1).count():
        most = alone.join(F.broadcast(hot), "cell", "left_semi").select("key", "node", "kind")
        held = most.groupBy("key").agg(*[c.alias(name) for c, name in zip(counts, ("n", "low", "high"), strict=True)]).where(several)
        most = _shuffled(most, held, "key")
        alone = alone.join(F.broadcast(hot), "cell", "left_anti")
    out = alone.select("key", "node", "kind", *[c.over(each).alias(name) for c, name in zip(counts, ("n", "low", "high"), strict=True)]).where(several)
    if hot.limit(1).count():
        out = out.unionByName(most.select(*out.columns))
    return out.drop("high")


def _groups(keyed: DataFrame) -> DataFrame:
    """node, grp of every node that shares a key which counts with another one that it can be like. ``keyed`` has the percentage, too."""
    passes = [swept(_shared(keyed.select("node", F.inline(f"keys_{k}"))), "ngram-shared") for k in range(SLICES)]
    held = reduce(DataFrame.unionByName, passes).repartition("node").dropDuplicates(["node", "kind", "key"])
    common = F.row_number().over(Window.partitionBy("node", "kind").orderBy(F.col("n").desc(), F.col("key").desc()))
    held = held.withColumn("common", common).where(F.col("common") > F.col("kind").bitwiseAND(F.lit(0xFFFFFFFF)))
    ties = swept(held.select("node", F.xxhash64("low", F.shiftright("kind", 32)).alias("tie")).distinct(), "ngram-ties")
    for x in passes:
        release(x)
    own = perhaps(keyed.where("sketch is not null").select("node", F.col("n_shingles").alias("n"), "sketch", "percent"), ties, "node").dropDuplicates(["node"])
    several = ties.groupBy("tie").agg(F.ceil(F.count("*") / F.lit(SIFTED)).cast("int").alias("of"), F.count("*").alias("nodes")).where("nodes > 1").drop("nodes")
    sized = _shuffled(_shuffled(ties, several, "tie"), own, "node").withColumn("chunk", _chunk(F.col("of")))
    # a chunk meets itself, and each chunk after it as their left side
    places = F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda x: F.struct(F.least(x, "chunk").alias("i"), F.greatest(x, "chunk").alias("j")))
    dealt = sized.select("tie", "node", "n", "sketch", "percent", "chunk", F.inline(places)).withColumn("left", F.expr("chunk = i and i < j")).drop("chunk")
    pairs = swept(dealt.groupBy("tie", "i", "j").applyInArrow(_sift, "a long, b long"), "ngram-pairs")
    return components(pairs).withColumnRenamed("component", "grp")


def _chunks(n: Column, grams: Column) -> Column:
    return F.ceil(F.greatest(n / F.lit(CHUNK), grams / F.lit(CHUNK_GRAMS))).cast("int")


def _chunk(of: Column) -> Column:
    return F.pmod(F.xxhash64("node"), of).cast("int")


def _joined(dealt: DataFrame, grams: int, n: int, percent: int, name: str) -> DataFrame:
    """Links (a, b) of all groups (grp, i, j) of ``dealt``, in tasks of about TASK_GRAMS n-grams."""
    parts = max(1, -(-grams // TASK_GRAMS))
    return stage(dealt.repartition(parts, "grp", "i", "j").groupBy("grp", "i", "j").applyInArrow(_links(n, percent), "a long, b long"), name)


def _linked(docs: DataFrame, chosen: DataFrame, n: int, percent: int) -> DataFrame:
    """node, component of the nodes of ``chosen`` (row, node, n, grp, chunks) that have links, by links within their groups."""
    texts = _shuffled(perhaps(docs.select("row", "text"), chosen, "row"), chosen, "row")
    large = chosen.where("chunks > 1")
    few = large.groupBy("grp", F.pmod(F.xxhash64("node"), F.lit(PIVOTS))).agg(F.min("node").alias("node")).select("node", F.lit(True).alias("pivot"))
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    places = _shuffled(chosen, few, "node", "left").select("row", F.explode(F.when(F.col("pivot"), every).otherwise(F.array(_chunk(F.col("chunks"))))).alias("j"))
    dealt = _shuffled(texts, places, "row").select("grp", F.lit(0).alias("i"), "j", "node", F.lit(False).alias("left"), "text")
    grams, more = chosen.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("chunks"), F.lit(0)) > 1).first()
    labels = components(_joined(dealt, grams, n, percent, "ngram-links"))
    if not more:
        return labels
    labels = stage(labels, "ngram-labels")
    large = _shuffled(large, labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    main = large.groupBy("grp", "label").agg(F.count("*").alias("size")).groupBy("grp").agg(F.max(F.struct("size", "label"))["label"].alias("main"))
    large = _shuffled(large, main, "grp").withColumn("left", F.col("label") != F.col("main"))
    rest = large.where("left").groupBy("grp").agg(_chunks(F.count("*"), F.sum("n")).alias("rests"))
    large = stage(_shuffled(large, rest, "grp").select("row", "n", "chunks", "rests", "left"), "ngram-rest")
    both = large.where("left").select("row", "left", "rests").unionByName(large.select("row", F.lit(False).alias("left"), "rests"))
    i = F.when(F.col("left"), F.array(_chunk(F.col("rests")))).otherwise(F.sequence(F.lit(0), F.col("rests") - 1))
    j = F.when(F.col("left"), every).otherwise(F.array(_chunk(F.col("chunks"))))
    both = _shuffled(texts, both, "row").withColumn("i", F.explode(i)).withColumn("j", F.explode(j)).select("grp", "i", "j", "node", "left", "text")
    grams = large.agg(F.coalesce(F.sum(F.col("n") * (F.col("rests") + F.when(F.col("left"), F.col("chunks")).otherwise(0))), F.lit(0))).first()[0]
    links = _joined(both, grams, n, percent, "ngram-more-links")
    for end in ("a", "b"):
        links = _shuffled(links, labels.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    again = components(links)
    old = _shuffled(labels, again.select(F.col("node").alias("component"), F.col("component").alias("wider")), "component", "left")
    new = _shuffled(again, labels.select("node"), "node", "left_anti")
    return old.select("node", F.coalesce("wider", "component").alias("component")).unionByName(new).distinct()


def _scanned(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` as row (hash of doc_id and text), doc_id, n_shingles and node; and node, component of nodes that have links."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("doc_id", "text"))
    lists = ", ".join(f"keys_{k} array<struct<key:long,kind:long>>" for k in range(SLICES))
    keyed = stage(texts.mapInArrow(_scan(n, percent), f"doc_id long, row long, n_shingles long, node long, sketch binary, {lists}"), "ngram-keys")
    scanned = stage(keyed.select("doc_id", "row", "n_shingles", "node"), "ngram-sets")
    groups = stage(_groups(keyed.withColumn("percent", F.lit(percent))), "ngram-groups")
    release(keyed)
    nodes = scanned.where("n_shingles > 0").groupBy("node").agg(F.min("row").alias("row"), F.max("n_shingles").alias("n"))
    chosen = _shuffled(nodes, groups, "node")
    sizes = chosen.groupBy("grp").agg(F.count("*").alias("nodes"), _chunks(F.count("*"), F.sum("n")).alias("chunks")).where("nodes > 1")
    chosen = stage(_shuffled(chosen, sizes.drop("nodes"), "grp").select("row", "node", "n", "grp", "chunks"), "ngram-chosen")
    return scanned, stage(_linked(texts, chosen, n, percent), "ngram-linked")


def jaccard_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles (size of the document's n-gram set) and component_id (the smallest doc_id that links reach).

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of lower-cased (A-Z) word n-grams. A text
    with fewer than n words has its whole sequence as one n-gram; a null, empty or blank text has an empty set, no links and
    itself as component. One row comes out for each row that goes in, rows with the same doc_id included: each has the set size
    and component of its own text. Rows whose doc_id is null link like others, but give no component its name: it is null if all
    are. An empty table gives an empty result; other columns of ``docs`` are not looked at.
    """
    scanned, linked = _scanned(docs, n, percent)
    return _named(scanned, linked).select("doc_id", "n_shingles", "component_id")


def _named(scanned: DataFrame, linked: DataFrame) -> DataFrame:
    """``scanned`` with component_id, the smallest doc_id of its component. ``linked``: node, component, for nodes that have links."""
    nodes = _shuffled(scanned.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("low")), linked, "node", "left")
    nodes = nodes.select("node", "low", F.coalesce("component", "node").alias("component"))
    lows = nodes.groupBy("component").agg(F.min("low").alias("component_id"))
    nodes = _shuffled(nodes, lows, "component").select("node", "component_id")
    full = _shuffled(scanned.where("n_shingles > 0"), nodes, "node")
    return full.select(*scanned.columns, "component_id").unionByName(scanned.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")))


def without_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of jaccard_groups(): the one with the smallest doc_id (a null one only if there is no
    other), then the lowest hash of doc_id and text. Rows are told apart by doc_id and text: texts that differ and aren't alike stay
    also if they have one doc_id, or none; of rows with equal doc_id and text one stays. Documents without words all stay."""
    scanned, linked = _scanned(docs, n, percent)
    words = _shuffled(scanned.where("n_shingles > 0"), linked, "node", "left").select("doc_id", "row", F.coalesce("component", "node").alias("component"))
    order = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    several = words.groupBy("component").agg(order["row"].alias("kept"), F.count("*").alias("rows")).where("rows > 1").select("component", "kept")
    several = _shuffled(words, several, "component").groupBy("row").agg(F.max(F.col("row") == F.col("kept")).alias("ngram_kept"))
    several = stage(several.withColumnRenamed("row", "ngram_row"), "ngram-kept")
    hashed = docs.withColumn("ngram_row", F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))).withColumn("ngram_blank", ~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    hashed = perhaps(hashed, several, "ngram_row", keep="ngram_perhaps").withColumn("ngram_perhaps", F.col("ngram_perhaps") & ~F.col("ngram_blank"))
    one = F.row_number().over(Window.partitionBy("ngram_row").orderBy("ngram_row"))
    some = _shuffled(hashed.where("ngram_perhaps"), several, "ngram_row", "left").where("coalesce(ngram_kept, true)")
    some = some.withColumn("ngram_number", one).where("ngram_kept is null or ngram_number = 1")
    return hashed.where("not ngram_perhaps").select(*docs.columns).unionByName(some.select(*docs.columns))

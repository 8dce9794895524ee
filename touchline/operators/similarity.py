"""Similar names: pairs by Ratcliff-Obershelp ratio without comparing all with all.

If two names have the ratio t or more, their matched characters M are at least t (|a| + |b|) / 2. They are a subsequence of both, so if
M is ceil(t (|a| + |b|) / 2), both names become equal when some |a| - M and |b| - M characters are left out. Names whose lengths allow
few ways to do so (VARIANTS) meet by what is then left: however alike all names are, only those meet that differ in these few places.

Of other lengths, u = |a| + |b| - 2M characters are unmatched. The matched characters lie in at most u + 1 blocks, as between two blocks one
is unmatched; so the names share at least M - (u + 1) of their numbered pairs of letters. Each name brings as many of its rarest pairs as
two names that share so many cannot both miss, and names that meet there are tested by their letters' counts. Only what is left is compared
exactly.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from math import ceil, comb

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.session import cut

#: ways to leave characters out of both names of a pair of lengths, up to which they meet by what is left
VARIANTS = 400
#: length from which difflib's own search is the faster one
LONG = 64


def matched(a: str, b: str) -> int:
    """Characters in the matching blocks of difflib.SequenceMatcher: the longest block, first in a, then in b, and the same left and right of it."""
    for k in range(min(len(a), len(b)), 0, -1):
        for i in range(len(a) - k + 1):
            if (j := b.find(a[i : i + k])) >= 0:
                return k + matched(a[:i], b[:j]) + matched(a[i + k :], b[j + k :])
    return 0


def _ratio(a: str, b: str) -> float:
    if max(len(a), len(b)) >= LONG:
        return SequenceMatcher(None, a, b).ratio()
    return 2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, which Spark has no function for; nulls have none."""
    return pd.Series([_ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])


def _numbered(parts: Column) -> Column:
    """Each part with how often it has come so far, so that a set of these is the multiset."""
    return F.transform(parts, lambda g, i: F.concat(g, F.lit("#"), F.size(F.filter(F.slice(parts, 1, i + 1), lambda y: y == g)).cast("string")))


def _grams(name: Column) -> Column:
    return _numbered(F.when(F.char_length(name) >= 2, F.transform(F.sequence(F.lit(1), F.char_length(name) - 1), lambda i: F.substring(name, i, F.lit(2)))).otherwise(F.array().cast("array<string>")))


def _letters(name: Column) -> Column:
    return _numbered(F.filter(F.split(name, "", -1), lambda c: c != ""))


def _shared(n: Column, least: float) -> Column:
    """How many numbered pairs of letters a name of length n shares at least with any other of this ratio."""
    low, high = F.ceil(n * (least / (2 - least))), F.floor(n * ((2 - least) / least))

    def bound(m: Column) -> Column:
        matched = F.ceil((n + m) * (least / 2) - 1e-9)
        return F.when(matched <= F.least(n, m), matched - (n + m - 2 * matched + 1))

    return F.greatest(F.array_min(F.transform(F.sequence(low, high), bound)), F.lit(1))


def _left(least: float, n: int, m: int) -> int:
    """Characters that two names of lengths n and m share at least."""
    return ceil(least * (n + m) / 2 - 1e-9)


def _without(others: dict[int, list[tuple[int, int]]]):
    """What is left of a name when characters are left out: for a length, the other lengths that it meets and how many characters stay."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("other", T.IntegerType()), T.StructField("left", T.StringType())])))
    def variants(names: pd.Series) -> pd.Series:
        def of(name: str) -> list[dict]:
            kept, out = {len(name): {name}}, []
            for n in range(len(name) - 1, min((k for _, k in others.get(len(name), [])), default=len(name)) - 1, -1):
                kept[n] = {x[:i] + x[i + 1 :] for x in kept[n + 1] for i in range(n + 1)}
            for other, k in others.get(len(name), []):
                out += [{"other": other, "left": x} for x in kept[k]]
            return out

        return names.map(of)

    return variants


def similar_names(left: DataFrame, right: DataFrame, least: float = 0.92, by: tuple[str, ...] = ()) -> DataFrame:
    """a, b, ratio of all pairs of a distinct name of ``left`` (column a) and one of ``right`` (b) with a ratio of ``least`` or more (above 0.75: below
    2/3 the bound has no force), equal in the columns ``by`` that both have, which come first. Null and empty names are like none. Empty tables
    give no rows."""
    if least <= 0.75:
        raise ValueError("least must be above 0.75")
    one = lambda df, c: df.select(*by, F.col(c).cast("string").alias(c)).where(f"{c} <> ''").distinct()
    a, b = cut(one(left, "a")), cut(one(right, "b"))
    lengths = lambda df, c: [r[0] for r in df.select(F.char_length(c)).distinct().collect()]  # as many as lengths of names
    near = [(n, m, k) for n in lengths(a, "a") for m in lengths(b, "b") if (k := _left(least, n, m)) <= min(n, m)]
    few = {(n, m): k for n, m, k in near if comb(n, n - k) + comb(m, m - k) <= VARIANTS}
    rest = [(n, m) for n, m, _ in near if (n, m) not in few]
    la, lb, met = F.char_length("a"), F.char_length("b"), []
    if few:

        def side(df: DataFrame, c: str, own: int) -> DataFrame:
            others: dict[int, list[tuple[int, int]]] = {}
            for both, k in few.items():
                others.setdefault(both[own], []).append((both[1 - own], k))
            told = df.where(F.char_length(c).isin(*others)).select(*by, c, F.explode(_without(others)(F.col(c))).alias("v"))
            both = (F.char_length(c), F.col("v.other"))
            return told.select(*by, c, F.xxhash64(*(both if own == 0 else both[::-1]), "v.left").alias("met"))

        met.append(side(a, "a", 0).join(side(b, "b", 1), [*by, "met"]).select(*by, "a", "b"))
    if rest:
        of = lambda x: F.concat(F.char_length("a"), F.lit(":"), F.char_length("b")).isin(*x)
        ends = [sorted({x[i] for x in rest}) for i in (0, 1)]
        ra, rb = a.where(la.isin(*ends[0])), b.where(lb.isin(*ends[1]))
        names = ra.select(F.col("a").alias("name")).union(rb.select("b")).distinct()
        grams = names.select("name", F.explode(_grams(F.col("name"))).alias("gram"))
        seen = grams.groupBy("gram").agg(F.count("*").alias("n"))
        ranked = grams.join(seen, "gram").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("grams"))  # a name's own pairs of letters
        size = F.char_length("name")
        keys = ranked.select("name", F.explode(F.slice("grams", 1, F.size("grams") - _shared(size, least).cast("int") + 1)).alias("g")).select("name", "g.gram")
        keyed = lambda df, c: df.join(keys.withColumnRenamed("name", c), c)
        shared = keyed(ra, "a").join(keyed(rb, "b"), [*by, "gram"]).where(of([f"{n}:{m}" for n, m in rest])).select(*by, "a", "b").distinct()
        met.append(shared.where(F.size(F.array_intersect(_letters(F.col("a")), _letters(F.col("b")))) * 2 >= (la + lb) * least - 1e-9))
    pairs = a.join(b.withColumn("a", F.col("b")), [*by, "a"]).select(*by, "a", "b", F.lit(1.0).alias("ratio"))
    for some in met:  # a pair's lengths let it be in one of them only
        pairs = pairs.unionByName(some.where("a <> b").distinct().withColumn("ratio", ratio("a", "b")).where(F.col("ratio") >= least))
    return pairs


def fuzzy(left: DataFrame, right: DataFrame, block: str, name: str, least: float = 0.92, margin: float = 0.03) -> DataFrame:
    """Of each left name its most similar right name in the same block, if it is similar enough and the next best clearly less so. Pairs
    come from similar_names(), so that a block with a large part of all names costs no more than its similar ones. Pairs below ``least``
    are looked for only where one could make a match ambiguous that is sure so far."""
    own, other = left.select(block, F.col(name).alias("a")).where("a <> ''").distinct(), right.select(block, F.col(name).alias("b"))
    met = cut(similar_names(own, other, least, (block,)))
    top = met.groupBy(block, "a").agg(F.max("ratio").alias("best"))
    # ties go to the first name; a second one within the margin makes it ambiguous
    near = F.count_if(F.col("best") - F.col("ratio") < margin).alias("near")
    close = cut(met.join(top, [block, "a"]).groupBy(block, "a", "best").agg(F.min(F.when(F.col("ratio") == F.col("best"), F.col("b"))).alias("b"), near))
    doubt = close.where((F.col("near") == 1) & (F.col("best") - least < margin)).select(block, "a", "best")
    below = similar_names(doubt, other, least - margin, (block,)).join(doubt, [block, "a"]).groupBy(block, "a").agg(near.alias("nearer"))
    found = own.join(close.join(below, [block, "a"], "left"), [block, "a"], "left")
    status = F.when(F.col("best").isNull(), "no_match").when(F.greatest("near", "nearer") > 1, "ambiguous").otherwise("matched")
    return found.select(block, "a", "b", F.col("best").alias("ratio"), status.alias("status"))

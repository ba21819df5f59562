"""Fuzzy best match of names by edit distance.

The similarity of two names is ``1 - levenshtein / longer length``; a request takes the most similar name strictly above a threshold,
ties by name. Names of length at most m within d edits share at least ``m + 1 - 2 d`` of their padded pairs of characters, and
so, in one global order of pairs, the rarest first, the leading ``len + 2 - shared`` pairs of both (prefix filter). Only
those anchors are joined, together with the band of lengths; what meets is cut by position (a pair that either name holds
once can move by d places at most) and by the count of shared pairs before any edit distance is computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = (3, 5)  # similarity > 3/5
EDGE = "\u0002"


def _pairs(name: Column) -> Column:
    """Adjacent characters of the name with a mark at both ends."""
    padded = F.concat(F.lit(EDGE), name, F.lit(EDGE))
    return F.transform(F.sequence(F.lit(1), F.length(name) + 1), lambda i: F.substring(padded, i, F.lit(2)))


def _numbered(pairs: Column) -> Column:
    """Every pair with its position and how often it has stood before."""
    return F.transform(pairs, lambda p, i: F.struct(p.alias("pair"), i.alias("pos"), F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda q: q == p)).alias("nth")))


def most_edits(longer: Column, threshold: tuple[int, int] = THRESHOLD) -> Column:
    """The most edits that keep the similarity of names, the longer of this length, above the threshold."""
    num, den = threshold
    return F.floor((longer * (den - num) - 1) / den).cast("int")


def _anchors(names: DataFrame, name: str, frequency: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """name, tokens (all pairs, numbered), and one row for each of its anchors: pair, pos, once."""
    num, den = threshold
    # any partner is at least num/den as long, and for the longer length m: shared >= m + 1 - 2 * most_edits(m) > m * (2 num - den) / den + 1
    shared = F.greatest(F.lit(1), F.floor(F.length(name) * (2 * num - den) / den).cast("int") + 2)
    d = names.select(F.col(name), F.explode(_numbered(_pairs(F.col(name)))).alias("t"))
    ranked = d.join(frequency, F.col("t.pair") == F.col("pair")).groupBy(name).agg(
        F.sort_array(F.collect_list(F.struct("freq", F.col("t.pair").alias("pair"), F.col("t.nth").alias("nth"), F.col("t.pos").alias("pos")))).alias("order"))
    tokens = F.transform("order", lambda t: F.concat(t["pair"], t["nth"].cast("string"))).alias("tokens")
    lead = F.slice("order", F.lit(1), F.greatest(F.lit(1), F.length(name) + 2 - shared))
    once = lambda t: ~F.exists("order", lambda u: (u["pair"] == t["pair"]) & (u["nth"] == 1))
    firsts = F.transform(F.filter(lead, lambda t: t["nth"] == 0), lambda t: F.struct(t["pair"].alias("pair"), t["pos"].alias("pos"), once(t).alias("once")))
    return ranked.select(F.col(name), tokens, F.inline(firsts))


def candidate_pairs(requests: DataFrame, names: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(asked, name) of distinct ``requests`` (asked) and ``names`` (name) that may be similar enough."""
    num, den = threshold
    if 2 * num <= den:
        raise ValueError("the filter needs a threshold above one half")
    every = requests.select(F.col("asked").alias("n")).unionByName(names.select(F.col("name").alias("n")))
    frequency = every.select(F.explode(F.array_distinct(_pairs(F.col("n")))).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("freq"))
    a = _anchors(requests, "asked", frequency, threshold).withColumnsRenamed({"tokens": "ta", "pos": "pa", "once": "oa"})
    b = _anchors(names, "name", frequency, threshold).withColumnsRenamed({"tokens": "tb", "pos": "pb", "once": "ob"})
    la, lb = F.length("asked"), F.length("name")
    longer, shorter = F.greatest(la, lb), F.least(la, lb)
    edits = most_edits(longer, threshold)
    met = a.join(b, "pair").where((longer - shorter <= edits) & (~(F.col("oa") & F.col("ob")) | (F.abs(F.col("pa") - F.col("pb")) <= edits)))
    return (met.where(F.size(F.array_intersect("ta", "tb")) >= longer + 1 - 2 * edits).select("asked", "name").distinct())


def fuzzy_best_match(requests: DataFrame, asked: str, names: DataFrame, name: str, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Asked, best, similarity for every distinct ``asked``; best and similarity are null where no name is similar enough.
    Null names and requests take no part; empty ones match nothing but are answered."""
    q = requests.select(F.col(asked).alias("asked")).where("asked is not null").distinct()
    n = names.select(F.col(name).alias("name")).where("name is not null and name <> ''").distinct()
    same = q.join(n, F.col("asked") == F.col("name")).select("asked", F.col("name").alias("best"), F.lit(1.0).alias("similarity"))
    rest = q.join(n, F.col("asked") == F.col("name"), "left_anti")
    pairs = candidate_pairs(rest.where("asked <> ''"), n, threshold)
    longer = F.greatest(F.length("asked"), F.length("name"))
    edits = F.levenshtein("asked", "name", None)
    near = pairs.withColumn("edits", edits).where(F.col("edits") <= most_edits(longer, threshold))
    best = near.groupBy("asked").agg(F.min(F.struct((F.col("edits") / longer).alias("apart"), "name", ((longer - F.col("edits")) / longer).alias("similarity"))).alias("b"))
    found = rest.join(best, "asked", "left").select("asked", F.col("b.name").alias("best"), F.col("b.similarity").alias("similarity"))
    return same.unionByName(found)

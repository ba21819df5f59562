"""Deterministic ordering and skew-safe row numbers (see ``prefix_scan`` for sequences over time).

A window ``partitionBy(k).orderBy(...)`` puts every row of one key into one
task; when one key holds a third of the data that task is the job. Row numbers in a hash
order are found without it by splitting each key into nested ordered *chunks* (two, then four digits of the hash):

* totals per finest chunk are aggregated map-side;
* what precedes a chunk is found level by level: a window over the coarsest
  chunks of a key, then windows over the finer chunks inside one coarser chunk;
* the row-level window runs inside one finest chunk.

So row numbers stay exact and no task receives a whole hot key. Null keys form a group of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SEED = 42


def seeded_hash(seed: int, *cols) -> Column:
    """md5(seed ‖ key) — reproducible order independent of partitioning (never ``rand()``)."""
    parts = [F.lit(str(seed))] + [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit(""))
                                  for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def hash_bucket(h: Column, digits: int = 4) -> Column:
    """Leading hex digits of a hash: the chunk of an md5 order."""
    return F.substring(h, 1, digits)


def split_of(h: Column, train: str = "b333", validation: str = "d999") -> Column:
    """Three-way split by hash prefix: < b333 train (70 %), < d999 validation (15 %), else test."""
    b = hash_bucket(h)
    return F.when(b < train, "train").when(b < validation, "validation").otherwise("test")


def hash_chunks(h: Column) -> list[Column]:
    """Chunks of an order by a hex hash."""
    return [hash_bucket(h, 2), hash_bucket(h, 4)]


def join_null_safe(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet (``<=>`` is planned as a hash or sort-merge join)."""
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in cols})
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(r[f"_r_{c}"])
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in cols])


def _preceding(table: DataFrame, keys: list[str], chunks: list[str], names: dict[str, str]) -> DataFrame:
    """For each row of a (keys × chunks) table the aggregate (``sum`` or ``max``) of all earlier chunks of its key."""
    agg = {"sum": F.sum, "max": F.max}
    inner, last = [*keys, *chunks[:-1]], chunks[-1]
    w = Window.partitionBy(*inner).orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
    out = table.select(*inner, last, *[agg[op](n).over(w).alias(f"_p_{n}") for n, op in names.items()])
    if len(chunks) == 1:
        return out
    up = table.groupBy(*inner).agg(*[agg[op](n).alias(n) for n, op in names.items()])
    above = _preceding(up, keys, chunks[:-1], names).withColumnsRenamed({f"_p_{n}": f"_u_{n}" for n in names})
    j = join_null_safe(out, above, inner)
    for n, op in names.items():
        a, b = F.col(f"_u_{n}"), F.col(f"_p_{n}")
        both = a + b if op == "sum" else F.greatest(a, b)
        j = j.withColumn(f"_p_{n}", F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both))
    return j.drop(*[f"_u_{n}" for n in names])


def _chunked(df: DataFrame, keys: Sequence[str], chunks: Sequence[Column], values: dict[str, tuple[str, Column]]) -> tuple[DataFrame, list[str]]:
    """``df`` with chunk columns and, for each value, ``_p_<name>``: its aggregate over all earlier chunks of the key."""
    keys, names = list(keys), [f"_chunk{i}" for i in range(len(chunks))]
    d = df.select("*", *[c.alias(n) for c, n in zip(chunks, names)])
    fns = {"sum": F.sum, "max": F.max}
    table = d.groupBy(*keys, *names).agg(*[fns[op](e).alias(n) for n, (op, e) in values.items()])
    before = _preceding(table, keys, names, {n: op for n, (op, _) in values.items()})
    return join_null_safe(d, before, [*keys, *names]), names


def chunked_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunks: Sequence[Column],
                       out: str = "rn") -> DataFrame:
    """Exact ``row_number() over (partition by keys order by order)``; ``chunks`` are prefixes of ``order``."""
    j, names = _chunked(df, keys, chunks, {"_n": ("sum", F.lit(1))})
    w = Window.partitionBy(*keys, *names).orderBy(*order)
    return j.withColumn(out, F.coalesce("_p__n", F.lit(0)) + F.row_number().over(w)).drop(*names, "_p__n")

"""Exact per-key sequences over range partitions (row numbers, running sums and maxima, lags, leads, trailing sums).

A window ``partitionBy(k).orderBy(...)`` puts all rows of a key into one task. Here the rows are range-partitioned by (key,
order), so the ranges split a hot key like any other rows, and that is the only shuffle:

1. every partition is sorted and scanned as a stream of Arrow batches, as if nothing came before it; its rows are
   written to a staged table with the number of their partition;
2. the last row of each partition says what its last key has gathered. These rows, one a partition, are folded in order;
3. the carry of each partition, a one-row-a-partition table, is added to the rows of the partition's first key by a broadcast join.

Orders must be total (end in a unique column) for results to be defined. Null keys form one key, null values add nothing to sums and maxima.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ferret.functions.staging import stage


def _differs(a: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before (the first does not); nulls are equal to each other."""
    x, y = a[1:], a[:-1]
    out = pc.fill_null(pc.not_equal(x, y), True)
    out = pc.and_(out, pc.invert(pc.and_(pc.is_null(x), pc.is_null(y))))
    return np.concatenate([[False], out.to_numpy(zero_copy_only=False)])


class _Scan:
    """One partition: batches in, batches with the derived columns out."""

    def __init__(self, keys, sums, maxes, lags, trailing, leads, back: int, schema: pa.Schema):
        self.keys, self.sums, self.maxes, self.lags, self.trailing, self.leads, self.back, self.schema = keys, sums, maxes, lags, trailing, leads, back, schema
        self.part = TaskContext.get().partitionId()

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past, held, state = None, None, (0, {s: 0 for s in self.sums}, {m: (-np.inf, False) for m in self.maxes}, True)
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if held is not None:
                t = pa.concat_tables([held, t])
            # the last row waits for the next batch, which holds its lead
            if len(t) > 1:
                out, past, state = self._step(t, len(t) - 1, past, state, False)
                yield out
            held = t.slice(len(t) - 1)
        if held is not None:
            yield self._step(held, 1, past, state, True)[0]

    def _step(self, t: pa.Table, n: int, past, state, last: bool):
        rn0, sum0, max0, first0 = state
        p = 0 if past is None else len(past)
        every = (t if past is None else pa.concat_tables([past, t])).combine_chunks()
        col = lambda c: every[c].combine_chunks() if every[c].num_chunks != 1 else every[c].chunk(0)
        new = np.zeros(len(every), bool)
        for k in self.keys:
            new |= _differs(col(k))
        new = new[p:]
        if past is None:
            new[0] = True
        here, following = new[:n], np.append(new[n:], True)[:1] if len(new) > n else np.array([True])
        run = np.cumsum(here)  # 0: the run of the row before this step
        group = pd.Series(run)
        at0 = run == 0
        rn = group.groupby(group).cumcount().to_numpy() + 1 + np.where(at0, rn0, 0)
        values = {"_rn": rn}
        sums, maxes = {}, {}
        rows = every.slice(p, n)
        for name, c in self.sums.items():
            v = pd.Series(rows[c].fill_null(0).to_numpy())
            sums[name] = v.groupby(run).cumsum().to_numpy() + np.where(at0, sum0[name], 0)
            values[name] = sums[name]
        for name, c in self.maxes.items():
            v = rows[c].cast(pa.float64()).fill_null(-np.inf).to_numpy().copy()
            some = rows[c].is_valid().to_numpy()
            if at0[0]:
                v[0], some = np.maximum(v[0], max0[name][0]), some | (at0 & max0[name][1])
            v = pd.Series(v).groupby(run).cummax(skipna=False).to_numpy()
            some = pd.Series(some).groupby(run).cummax().to_numpy()
            maxes[name] = v[-1], bool(some[-1])
            values[name] = pa.array(v, mask=~some)
        index = np.arange(p, p + n)
        for name, (c, k) in self.lags.items():
            values[name] = col(c).take(pa.array(np.maximum(index - k, 0), mask=rn <= k))
        for name, (c, k) in self.trailing.items():
            v = np.concatenate([[0], np.cumsum(every[c].fill_null(0).to_numpy())])
            values[name] = v[index + 1] - v[np.maximum(index + 1 - np.minimum(rn, k), 0)]
        ahead = np.append(~here[1:], ~following)  # whether the next row is of the same key
        for name, c in self.leads.items():
            values[name] = col(c).take(pa.array(np.minimum(index + 1, len(every) - 1), mask=~ahead))
        first = first0 & at0 if past is not None else run == 1
        tail = [None] * n
        if last:
            k = min(self.back, int(rn[-1]))
            tail[-1] = every.slice(len(every) - k, k).select(sorted({c for c, _ in [*self.lags.values(), *self.trailing.values()]})).to_pylist()
        values |= {"_part": np.full(n, self.part, np.int32), "_first": first, "_last": np.arange(n) == (n - 1 if last else n), "_head": (index == 0) & (past is None), "_tail": tail}
        columns = [*(rows[c].combine_chunks() for c in t.column_names), *values.values()]
        kinds = [f.type for f in self.schema]
        out = pa.RecordBatch.from_arrays([v.cast(k) if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(columns, kinds)], schema=self.schema)
        state = int(rn[-1]), {k: v[-1] for k, v in sums.items()}, maxes, bool(first[-1])
        keep = max(self.back, 1)
        return out, every.slice(max(0, p + n - keep), min(keep, p + n)), state


def prefix_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], rn: str | None = None, sums: dict[str, str] | None = None, maxes: dict[str, str] | None = None,
                lags: dict[str, tuple[str, int]] | None = None, trailing: dict[str, tuple[str, int]] | None = None, leads: dict[str, str] | None = None,
                partitions: int | None = None) -> DataFrame:
    """``df`` with ``rn`` (row number in its key), running ``sums`` (name: long column) and ``maxes`` (name: double column), ``lags`` (name: column, rows back), ``trailing`` sums
    (name: long column, rows) and ``leads`` (name: column of the next row)."""
    sums, maxes, lags, trailing, leads = (x or {} for x in (sums, maxes, lags, trailing, leads))
    spark, keys, kinds = df.sparkSession, list(keys), dict(df.dtypes)
    tail = sorted({c for c, _ in [*lags.values(), *trailing.values()]})
    back = max([k for _, k in lags.values()] + [k - 1 for _, k in trailing.values()] + [0])
    made = {"_rn": "bigint", **dict.fromkeys(sums, "bigint"), **dict.fromkeys(maxes, "double"), **{n: kinds[c] for n, (c, _) in lags.items()}, **dict.fromkeys(trailing, "bigint"),
            **{n: kinds[c] for n, c in leads.items()}, "_part": "int", "_first": "boolean", "_last": "boolean", "_head": "boolean",
            "_tail": "array<struct<" + (",".join(f"`{c}`: {kinds[c]}" for c in tail) or "_none: int") + ">>"}
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in made.items())).fields])
    arrow = to_arrow_schema(schema)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)

    def run(batches):
        return _Scan(keys, sums, maxes, lags, trailing, leads, back, arrow).run(batches)

    local = stage(dealt.mapInArrow(run, schema), "scan")
    edges = local.where("_last or _head").select(*keys, *made, *set(leads.values()) - set(keys) - set(made)).collect()  # at most two rows a partition
    carried = _fold(edges, keys, sums, maxes, leads, back)
    if not carried:
        return local.select(*df.columns, *([F.col("_rn").alias(rn)] if rn else []), *sums, *maxes, *lags, *trailing, *leads)
    following = "struct<" + (",".join(f"`{c}`: {kinds[c]}" for c in leads.values()) or "_none: int") + ">"
    state = ["_p int", "_c_rn bigint", *[f"`_c_{s}` bigint" for s in sums], *[f"`_c_{m}` double" for m in maxes], f"_c_tail {made['_tail']}", f"_c_next {following}", "_c_same boolean"]
    carry = spark.createDataFrame(carried, ", ".join(state))
    j = local.join(F.broadcast(carry), F.col("_part") == F.col("_p"), "left")
    mine = F.col("_first") & F.col("_c_rn").isNotNull()
    add = lambda c, by: F.when(mine, F.col(c) + F.col(by)).otherwise(F.col(c))
    size = F.size("_c_tail")
    fixes = {s: add(s, f"_c_{s}") for s in sums} | {m: F.when(mine, F.greatest(m, f"_c_{m}")).otherwise(F.col(m)) for m in maxes}
    for name, (c, k) in lags.items():
        place = size - (F.lit(k) - F.col("_rn")).cast("int")  # from 1
        fixes[name] = F.when(mine & (F.col("_rn") <= k), F.when(place >= 1, F.get("_c_tail", place - 1)[c])).otherwise(F.col(name))
    for name, (c, k) in trailing.items():
        some = F.least(size, (F.lit(k) - F.col("_rn")).cast("int"))
        before = F.slice("_c_tail", size - some + 1, some)[c]  # the column's values in the rows before
        more = F.aggregate(before, F.lit(0).cast("long"), lambda s, e: s + F.coalesce(e.cast("long"), F.lit(0)))
        fixes[name] = F.when(mine & (F.col("_rn") < k) & (size > 0), F.col(name) + more).otherwise(F.col(name))
    for name, c in leads.items():
        fixes[name] = F.when(F.col("_last") & F.col("_c_same"), F.col("_c_next")[c]).otherwise(F.col(name))
    out = [fixes[c].alias(c) for c in (*sums, *maxes, *lags, *trailing, *leads)]
    return j.select(*[F.col(f"`{c}`") for c in df.columns], *([add("_rn", "_c_rn").alias(rn)] if rn else []), *out)


def _fold(edges, keys, sums, maxes, leads, back: int):
    """Carry of each partition from the first and last rows of all: what its first key has gathered in earlier ones, and
    the first row of the next one where that goes on with the last key."""
    heads = {r["_part"]: r for r in edges if r["_head"]}
    lasts = sorted((r for r in edges if r["_last"]), key=lambda r: r["_part"])
    key = lambda r: tuple(r[k] for k in keys)
    out, open_ = {}, None  # open_: key, rn, sums, maxes, tail
    for i, r in enumerate(lasts):
        entry = [r["_part"], None, *[None] * (len(sums) + len(maxes)), None, None, False]
        head = heads[r["_part"]]
        if open_ is not None and open_[0] == key(head):
            entry[1:3 + len(sums) + len(maxes)] = [open_[1], *open_[2], *open_[3], open_[4]]
        goes_on = entry[1] is not None and r["_first"]
        tail = [tuple(t) for t in r["_tail"] or []]
        mine = (r["_rn"], [r[s] for s in sums], [r[m] for m in maxes], tail)
        if goes_on:
            top = [a if b is None else b if a is None else float(np.maximum(a, b)) for a, b in zip(open_[3], mine[2])]
            open_ = key(r), open_[1] + mine[0], [a + b for a, b in zip(open_[2], mine[1])], top, (open_[4] + tail)[-back:] if back else []
        else:
            open_ = key(r), *mine
        if i + 1 < len(lasts) and key(heads[lasts[i + 1]["_part"]]) == key(r):
            entry[-1], entry[-2] = True, tuple(heads[lasts[i + 1]["_part"]][c] for c in leads.values()) or (None,)
        if entry[1] is not None or entry[-1]:
            out[r["_part"]] = tuple(entry)
    return list(out.values())

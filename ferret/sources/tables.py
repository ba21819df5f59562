"""Parquet scans of the driver tables with explicit schemas (never inferred).

Reading with the declared schema keeps the plan stable across files and lets
Catalyst prune columns and push filters into the parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

L, I, D, S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()
TS = T.TimestampNTZType()


def _s(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "region": _s(("r_regionkey", I), ("r_name", S)),
    "nation": _s(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "supplier": _s(("s_suppkey", L), ("s_name", S), ("s_nationkey", I), ("s_acctbal", D)),
    "customer": _s(("c_custkey", L), ("c_name", S), ("c_nationkey", I), ("c_acctbal", D), ("c_mktsegment", S)),
    "part": _s(("p_partkey", L), ("p_name", S), ("p_brand", S), ("p_type", S), ("p_size", I), ("p_retailprice", D)),
    "orders": _s(("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S), ("o_totalprice", D),
                 ("o_orderdate", TS), ("o_orderpriority", S)),
    "lineitem": _s(("l_orderkey", L), ("l_partkey", L), ("l_suppkey", L), ("l_linenumber", I),
                   ("l_quantity", D), ("l_extendedprice", D), ("l_discount", D), ("l_tax", D),
                   ("l_returnflag", S), ("l_linestatus", S), ("l_shipdate", TS)),
    "events": _s(("event_id", L), ("ts", TS), ("user_id", L), ("event_type", S), ("value", D), ("props", S)),
    "documents": _s(("doc_id", L), ("text", S), ("lang", S), ("source", S), ("n_chars", L)),
    "embeddings": _s(("vec_id", L), ("embedding", T.ArrayType(T.FloatType())), ("label", I)),
    "pages": _s(("page_id", L), ("url", S), ("html", S)),
    "benchmark": _s(("item_id", L), ("text", S)),
    "labels": _s(("doc_id", L), ("quality", I), ("toxic", I)),
    "conversations": _s(("conv_id", L), ("turn", L), ("role", S), ("text", S)),
}

TABLES = tuple(SCHEMAS)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(table_path(sf_dir, name))


class Tables:
    """Lazy accessor: ``Tables(spark, d).orders`` is a parquet scan, nothing is read until an action."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        return read_table(self.spark, self.sf_dir, name)

    def register(self, *names: str) -> None:
        for n in names or TABLES:
            read_table(self.spark, self.sf_dir, n).createOrReplaceTempView(n)

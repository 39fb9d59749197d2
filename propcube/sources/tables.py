"""SRC2: parquet table scans with explicit schemas (never inferred)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_L, _I, _S, _D = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()
_TS = T.TimestampNTZType()


def _st(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Schemas of the driver's source tables (as written in their parquet footers).
SOURCE_SCHEMAS: dict[str, T.StructType] = {
    "region": _st(("r_regionkey", _I), ("r_name", _S)),
    "nation": _st(("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I)),
    "customer": _st(("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I),
                    ("c_acctbal", _D), ("c_mktsegment", _S)),
    "supplier": _st(("s_suppkey", _L), ("s_name", _S), ("s_nationkey", _I), ("s_acctbal", _D)),
    "part": _st(("p_partkey", _L), ("p_name", _S), ("p_brand", _S), ("p_type", _S),
                ("p_size", _I), ("p_retailprice", _D)),
    "orders": _st(("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S),
                  ("o_totalprice", _D), ("o_orderdate", _TS), ("o_orderpriority", _S)),
    "lineitem": _st(("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L),
                    ("l_linenumber", _I), ("l_quantity", _D), ("l_extendedprice", _D),
                    ("l_discount", _D), ("l_tax", _D), ("l_returnflag", _S),
                    ("l_linestatus", _S), ("l_shipdate", _TS)),
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one source table; column pruning and filters reach the reader.
    Split sizes are the reader's (``spark.sql.files.maxPartitionBytes``)."""
    reader = spark.read
    schema = SOURCE_SCHEMAS.get(name)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(table_path(sf_dir, name))


def read_domain(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Scan a stored domain table (listings, transactions, ...)."""
    return spark.read.schema(schema).parquet(path)

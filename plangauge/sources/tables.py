"""The eight relational tables: schemas, cardinalities, loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(15, 2)


def _schema(spec: str) -> T.StructType:
    kinds = {"int": T.LongType(), "str": T.StringType(), "char": T.StringType(), "dec": MONEY, "date": T.DateType()}
    fields = []
    for item in spec.split():
        name, kind = item.split(":")
        fields.append(T.StructField(name, kinds[kind], False, {"padded": kind == "char"}))
    return T.StructType(fields)


# The standard TPC-H relations ("char" columns are blank padded at the source).
SCHEMAS: dict[str, T.StructType] = {
    "region": _schema("r_regionkey:int r_name:char r_comment:str"),
    "nation": _schema("n_nationkey:int n_name:char n_regionkey:int n_comment:str"),
    "part": _schema(
        "p_partkey:int p_name:str p_mfgr:char p_brand:char p_type:str p_size:int p_container:char "
        "p_retailprice:dec p_comment:str"
    ),
    "supplier": _schema(
        "s_suppkey:int s_name:char s_address:str s_nationkey:int s_phone:char s_acctbal:dec s_comment:str"
    ),
    "partsupp": _schema("ps_partkey:int ps_suppkey:int ps_availqty:int ps_supplycost:dec ps_comment:str"),
    "customer": _schema(
        "c_custkey:int c_name:str c_address:str c_nationkey:int c_phone:char c_acctbal:dec "
        "c_mktsegment:char c_comment:str"
    ),
    "orders": _schema(
        "o_orderkey:int o_custkey:int o_orderstatus:char o_totalprice:dec o_orderdate:date "
        "o_orderpriority:char o_clerk:char o_shippriority:int o_comment:str"
    ),
    "lineitem": _schema(
        "l_orderkey:int l_partkey:int l_suppkey:int l_linenumber:int l_quantity:dec l_extendedprice:dec "
        "l_discount:dec l_tax:dec l_returnflag:char l_linestatus:char l_shipdate:date l_commitdate:date "
        "l_receiptdate:date l_shipinstruct:char l_shipmode:char l_comment:str"
    ),
}

# Nominal row counts at scale factor 1.
TABLE_ROWS: dict[str, int] = {
    "lineitem": 6001215,
    "orders": 1500000,
    "customer": 150000,
    "part": 200000,
    "supplier": 10000,
    "partsupp": 800000,
    "nation": 25,
    "region": 5,
}


def table_rows(spark: SparkSession) -> DataFrame:
    """Row-count dimension (eight rows)."""
    return spark.createDataFrame(list(TABLE_ROWS.items()), "table_name string, row_count long")


def conform(df: DataFrame, name: str) -> DataFrame:
    """Cast the columns that are present to the declared types; trim blank padded text.

    Columns already of the declared type pass through untouched, so filters on
    them still reach the file scan.
    """
    declared = {f.name: f for f in SCHEMAS[name].fields}
    out = []
    for field in df.schema.fields:
        want = declared.get(field.name)
        column = F.col(field.name)
        if want is None:
            out.append(column)
            continue
        integral = isinstance(field.dataType, (T.IntegerType, T.LongType)) and isinstance(want.dataType, T.LongType)
        # money stored as doubles stays so: filters keep reaching the scan, and sums are exact in whole hundredths
        money = isinstance(field.dataType, T.DoubleType) and isinstance(want.dataType, T.DecimalType)
        if field.dataType != want.dataType and not integral and not money:
            column = column.cast(want.dataType)
        if want.metadata["padded"] and field.metadata.get("__CHAR_VARCHAR_TYPE_STRING", "").startswith("char"):
            column = F.rtrim(column)
        out.append(column.alias(field.name))
    return df.select(*out)


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One relation from Parquet, typed as declared."""
    return conform(spark.read.parquet(f"{directory}/{name}.parquet"), name)


def read_typed(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One relation in full form, with the schema declared up front (no inference)."""
    return spark.read.schema(SCHEMAS[name]).format(fmt).load(path)


def register_views(spark: SparkSession, directory: str, names: list[str] | None = None) -> None:
    """Register the relations as temporary views for ``spark.sql``."""
    for name in names or list(SCHEMAS):
        read_table(spark, directory, name).createOrReplaceTempView(name)

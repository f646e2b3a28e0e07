"""Adapter from the TPC-H-like test tables to the sales fact schema.

Mapping (one sales row per lineitem):

  store_nbr    l_suppkey
  family       p_brand                      (through part)
  city         n_name                       (through supplier -> nation)
  date         CAST(l_shipdate AS DATE)
  sales        l_extendedprice
  transactions CAST(l_quantity AS INT)
  onpromotion  ROUND(l_discount * 1000)     (0, 10, ..., 100: all four promotion buckets)
  customer     o_custkey                    (through orders; only with ``with_customer``)

Only the fact side is large. ``nation`` has a fixed domain and is broadcast
explicitly; ``part`` and ``supplier`` grow with the data, so the join
strategy for them is left to Catalyst's size estimate and AQE's runtime
statistics (broadcast when small, sort-merge otherwise).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _store_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (supplier.join(F.broadcast(nation), supplier.s_nationkey == nation.n_nationkey)
            .select(F.col("s_suppkey"), F.col("n_name")))


def _joined(spark: SparkSession, sf_dir: str, wanted: frozenset[str]) -> DataFrame:
    """lineitem with the dimensions that ``wanted`` columns need, and no other.

    Every l_partkey, l_suppkey and l_orderkey has its dimension row (foreign keys), so
    leaving out an unneeded join does not change the rows.
    """
    j = read_table(spark, sf_dir, "lineitem")
    if "family" in wanted:
        part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
        j = j.join(part, j.l_partkey == part.p_partkey)
    if "city" in wanted:
        stores = _store_cities(spark, sf_dir)
        j = j.join(stores, j.l_suppkey == stores.s_suppkey)
    if "customer" in wanted:
        orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        j = j.join(orders, j.l_orderkey == orders.o_orderkey)
    return j


SALES_COLUMNS = ("store_nbr", "family", "city", "date", "sales", "transactions", "onpromotion")


def sales_from_star(spark: SparkSession, sf_dir: str, *, columns: tuple[str, ...] = SALES_COLUMNS,
                    with_customer: bool = False) -> DataFrame:
    """Typed, clean sales facts (store_nbr BIGINT, date DATE, amounts DOUBLE).

    ``columns`` names what is wanted: only the dimensions behind it are joined.
    """
    made = {
        "store_nbr": F.col("l_suppkey"),
        "family": F.col("p_brand"),
        "city": F.col("n_name"),
        "date": F.col("l_shipdate").cast("date"),
        "sales": F.col("l_extendedprice"),
        "transactions": F.col("l_quantity").cast("int"),
        "onpromotion": F.round(F.col("l_discount") * 1000),
        "customer": F.col("o_custkey"),
    }
    columns = (*columns, "customer") if with_customer and "customer" not in columns else columns
    j = _joined(spark, sf_dir, frozenset(columns))
    return j.select([made[c].alias(c) for c in columns])


# Deterministic defects injected into the raw rows so that the
# cleaning and diagnostic operators have something to find. Applied in this
# order; for ``sales`` a later rule wins over an earlier one.
#   city         NULL           where l_orderkey % 97 = 0
#   sales        '0'            where l_orderkey % 89 = 0
#   transactions '0'            where l_orderkey % 83 = 0
#   sales        negated        where l_orderkey % 79 = 0
#   sales        'n/a'          where l_orderkey % 73 = 0
#   sales        'Infinity'     where l_orderkey % 67 = 0
#   sales        '1e400'        where l_orderkey % 61 = 0
#   date         '13/45/2014'   where l_orderkey % 71 = 0
#   exact copies of the rows    where l_orderkey % 50 = 0 are appended
DEFECT_RULES = {
    "null_city": 97, "zero_sales": 89, "zero_transactions": 83,
    "negative_sales": 79, "malformed_sales": 73, "infinite_sales": 67, "huge_sales": 61, "malformed_date": 71,
    "duplicate": 50,
}


def raw_sales_from_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-STRING raw rows, shaped like the sales CSV, with the defects above.

    Every lineitem row is present; the defects change values of some rows
    and append copies of others, so the whole table flows through cleaning.
    """
    r = DEFECT_RULES
    j = _joined(spark, sf_dir, frozenset({"family", "city"}))
    k = F.col("l_orderkey")
    price_text = F.format_string("%.2f", F.col("l_extendedprice"))
    sales_text = (F.when(k % r["huge_sales"] == 0, F.lit("1e400"))
                  .when(k % r["infinite_sales"] == 0, F.lit("Infinity"))
                  .when(k % r["malformed_sales"] == 0, F.lit("n/a"))
                  .when(k % r["negative_sales"] == 0,
                        F.format_string("%.2f", -F.col("l_extendedprice")))
                  .when(k % r["zero_sales"] == 0, F.lit("0"))
                  .otherwise(price_text))
    raw = j.select(
        F.col("l_suppkey").cast("string").alias("store_nbr"),
        F.col("p_brand").alias("family"),
        F.when(k % r["null_city"] == 0, F.lit(None).cast("string"))
         .otherwise(F.col("n_name")).alias("city"),
        F.when(k % r["malformed_date"] == 0, F.lit("13/45/2014"))
         .otherwise(F.date_format(F.col("l_shipdate"), "MM/dd/yyyy")).alias("date"),
        sales_text.alias("sales"),
        F.when(k % r["zero_transactions"] == 0, F.lit("0"))
         .otherwise(F.col("l_quantity").cast("int").cast("string")).alias("transactions"),
        F.round(F.col("l_discount") * 1000).cast("int").cast("string").alias("onpromotion"),
        # one copy, or two for the duplicated rows: a single scan, no union
        F.explode(F.sequence(F.lit(1), F.when(k % r["duplicate"] == 0, 2).otherwise(1))).alias("_copy"),
    )
    return raw.drop("_copy")

"""Registration, and the two relations that most queries search.

``records`` is orders with their customers' places: seven dimensions, confidence is the total price.
``notes`` is documents with their labels, which cover only some of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spec import SearchConfig
from ..session import ship_package

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its DuckDB SQL where there is one."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RECORDS = SearchConfig(
    id="o_orderkey", name="c_name", year="year", confidence="o_totalprice", sort_name="c_name", numeric=("year", "month"),
    dimensions={"region": "r_name", "nation": "n_name", "segment": "c_mktsegment", "priority": "o_orderpriority", "status": "o_orderstatus", "year": "year", "month": "month"},
    text_columns=("c_name", "n_name"), phrase_columns=("c_name", "n_name", "c_mktsegment"), pinyin=None, body=None,
)

RECORDS_SQL = """
records AS (
  SELECT o_orderkey, o_custkey, c_name, c_mktsegment, n_name, r_name, o_orderstatus, o_orderpriority, o_totalprice,
    year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
)"""

NOTES = SearchConfig(
    id="doc_id", name="source", year="quality", confidence="n_chars", sort_name="source", numeric=("quality", "toxic"),
    dimensions={"lang": "lang", "source": "source", "quality": "quality", "toxic": "toxic"}, text_columns=("text", "source"), phrase_columns=("text", "source", "lang"), pinyin=None, body="text",
)

NOTES_SQL = """
notes AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left joins; the small sides' sizes decide whether they are broadcast."""
    orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.select(
        "o_orderkey", "o_custkey", "c_name", "c_mktsegment", "n_name", "r_name", "o_orderstatus", "o_orderpriority", "o_totalprice",
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")

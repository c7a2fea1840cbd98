"""Filters, facets, statistics, sorting, paging and keyed loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facets, tables
from ..operators.jobs import prune_orphans
from ..operators.predicates import confident, empty_record, filtered, in_ids, like, manual_source, nonblank
from ..operators.search import completions, detail, envelope, health, overview
from ..plans.spec import order_by
from ..streaming.stream import pending
from .base import NOTES, NOTES_SQL, RECORDS, RECORDS_SQL, notes, query, records, table

FILTERS = {"region": ["ASIA", "EUROPE"], "priority": ["1-URGENT", "2-HIGH"], "year": ["1996", "1997", "no number"]}
_CLAUSES = {"region": "r_name IN ('ASIA', 'EUROPE')", "priority": "o_orderpriority IN ('1-URGENT', '2-HIGH')", "year": "year IN (1996, 1997)"}
_WHERE = " AND ".join(_CLAUSES.values())


@query(f"WITH {RECORDS_SQL} SELECT * FROM records")
def left_join_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir)


@query(f"WITH {RECORDS_SQL} SELECT o_orderkey, r_name, o_orderpriority, year FROM records WHERE {_WHERE}")
def filter_multi_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(records(spark, sf_dir), RECORDS, FILTERS).select("o_orderkey", "r_name", "o_orderpriority", "year")


def _facet_sql(skip_own: bool, limit: int) -> str:
    parts = []
    for dim, column in RECORDS.dimensions.items():
        where = [c for d, c in _CLAUSES.items() if d != dim] if skip_own else []
        parts.append(f"SELECT '{dim}' AS dim, {column}::VARCHAR AS value, count(*) AS n FROM records WHERE {' AND '.join([*where, f'{column} IS NOT NULL'])} GROUP BY 2")
    return f"WITH {RECORDS_SQL}, counts AS ({' UNION ALL '.join(parts)}) SELECT dim, value, n, rank FROM (SELECT *, (row_number() OVER (PARTITION BY dim ORDER BY n DESC, value))::INT AS rank FROM counts) WHERE rank <= {limit}"


@query(_facet_sql(True, 300))
def facet_exclude_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.exclude_self(records(spark, sf_dir), RECORDS, FILTERS)


@query(_facet_sql(True, 5))
def facet_request_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.exclude_self(records(spark, sf_dir), RECORDS, FILTERS, limit=5)


@query(_facet_sql(False, 10))
def facet_global_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.distributions(records(spark, sf_dir), RECORDS.dimensions, 10)


@query(f"WITH {RECORDS_SQL} SELECT count(*) AS total, count(DISTINCT r_name) AS regions, count(DISTINCT n_name) AS nations, count(DISTINCT c_mktsegment) AS segments, count(DISTINCT year) AS years, max(year) AS latest FROM records")
def stats_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    kinds = {"regions": "r_name", "nations": "n_name", "segments": "c_mktsegment", "years": "year"}
    return r.agg(F.count(F.lit(1)).alias("total"), *[F.count_distinct(F.when(nonblank(F.col(c)), F.col(c))).alias(a) for a, c in kinds.items()], F.max("year").alias("latest"))


@query(f"WITH {NOTES_SQL} SELECT {', '.join(f'''coalesce(avg(CASE WHEN {c} IS NOT NULL AND {c}::VARCHAR NOT IN ('', '0') THEN 1.0 ELSE 0.0 END), 0.0)::DOUBLE AS {c}''' for c in ('text', 'lang', 'quality', 'toxic'))} FROM notes")
def fill_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.fill_rates(notes(spark, sf_dir), {c: c for c in ("text", "lang", "quality", "toxic")})


@query("""SELECT count(*) AS records, count(DISTINCT event_type) FILTER (event_type <> 'click') AS images, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS latest_release_time, count(*) FILTER (value IS NULL AND props IS NULL) AS empty_records FROM events""")
def max_text_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The health row; fixed-width text of times has the latest as its greatest. One event type stands for a manual source."""
    image = F.when(F.col("event_type") == "click", "manual:click").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").withColumns({"image": image, "released": F.date_format("ts", "yyyy-MM-dd HH:mm:ss")})
    return health(rows, RECORDS, "image", "released", ["value", "props"])


def _page(spark: SparkSession, sf_dir: str, sort: str) -> DataFrame:
    return records(spark, sf_dir).orderBy(*order_by(RECORDS, sort)).offset(40).limit(20).select("o_orderkey", "c_name", "year", "o_totalprice")


def _page_sql(order: str) -> str:
    return f"WITH {RECORDS_SQL} SELECT o_orderkey, c_name, year, o_totalprice FROM records ORDER BY {order} LIMIT 20 OFFSET 40"


@query(_page_sql("year DESC NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey"))
def page_sort_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, "cohort_desc")


@query(_page_sql("year ASC NULLS FIRST, o_totalprice DESC NULLS LAST, o_orderkey"))
def page_sort_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, "cohort_asc")


@query(_page_sql("c_name ASC NULLS FIRST, o_orderkey"))
def page_sort_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, "name_pinyin")


@query(_page_sql("o_totalprice DESC NULLS LAST, year DESC NULLS LAST, o_orderkey"))
def page_sort_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, "confidence_desc")


@query(f"WITH {RECORDS_SQL} SELECT count(*) AS total, 3::BIGINT AS page, 20::BIGINT AS page_size, ceil(count(*) / 20.0)::BIGINT AS pages, TRUE AS has_prev, 3 < ceil(count(*) / 20.0) AS has_next FROM records WHERE {_WHERE}")
def page_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope(filtered(records(spark, sf_dir), RECORDS, FILTERS), 3, 20)


@query(f"WITH {RECORDS_SQL} SELECT o_orderkey, n_name, o_totalprice FROM records WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def ids_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select("l_orderkey")
    return in_ids(records(spark, sf_dir), ids, "o_orderkey").select("o_orderkey", "n_name", "o_totalprice")


@query(f"WITH {RECORDS_SQL} SELECT o_orderkey, n_name FROM records WHERE FALSE")
def ids_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_ids(records(spark, sf_dir), ["x", ""], "o_orderkey").select("o_orderkey", "n_name")


@query("SELECT 'manual:' || doc_id AS image, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'crawl/' || c_custkey, c_name FROM customer")
def orphan_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of manual sources that are gone are pruned; labels say which sources are left."""
    image = lambda c: F.concat(F.lit("manual:"), F.col(c).cast("string")).alias("image")
    stored = table(spark, sf_dir, "documents").select(image("doc_id"), "source")
    crawled = table(spark, sf_dir, "customer").select(F.concat(F.lit("crawl/"), F.col("c_custkey").cast("string")).alias("image"), F.col("c_name").alias("source"))
    return prune_orphans(stored.unionByName(crawled), table(spark, sf_dir, "labels").select(image("doc_id")))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT image, name, balance, starts_with(image, 'manual:') AS manual FROM (SELECT 'manual:' || s_suppkey AS image, s_name AS name, s_acctbal AS balance FROM supplier UNION ALL SELECT 'crawl/' || c_custkey, c_name, c_acctbal FROM customer)")
def source_union_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("manual:"), F.col("s_suppkey").cast("string")).alias("image"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("crawl/"), F.col("c_custkey").cast("string")).alias("image"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return s.unionByName(c).withColumn("manual", manual_source(F.col("image")))


@query("SELECT count(DISTINCT p_type) AS p_type, count(DISTINCT p_brand) AS p_brand, count(DISTINCT p_size) AS p_size FROM part")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.distinct_counts(table(spark, sf_dir, "part"), ["p_type", "p_brand", "p_size"])


@query("SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role HAVING count(*) > 1")
def hit_groups_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.duplicate_rules(table(spark, sf_dir, "conversations"), ["conv_id", "role"])


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_wins_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.latest(table(spark, sf_dir, "events"), "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", "value")


@query("SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS ordinal FROM events")
def row_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.ordinals(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "ordinal")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS id FROM orders")
def stable_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.stable_ids(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"]).select("o_orderkey", "id")


@query("SELECT l_returnflag, min(l_quantity) AS median FROM (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) WHERE rn = n // 2 + 1 GROUP BY l_returnflag")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.upper_median(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")


@query("SELECT o_orderpriority, count(*) AS n, coalesce(nullif(list_position(['3-MEDIUM', '1-URGENT', '5-LOW'], o_orderpriority), 0), 4)::INT AS position FROM orders GROUP BY o_orderpriority")
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.classify import category_rank

    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("position", category_rank(F.col("o_orderpriority"), ("3-MEDIUM", "1-URGENT", "5-LOW")).cast("int"))


@query(f"WITH {RECORDS_SQL} SELECT o_orderkey, o_totalprice FROM records WHERE o_totalprice >= 300000")
def threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confident(records(spark, sf_dir), RECORDS, 300000).select("o_orderkey", "o_totalprice")


@query(f"WITH {RECORDS_SQL} SELECT * FROM records WHERE o_orderkey = 7")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail(records(spark, sf_dir), RECORDS, 7)


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '01')")
def name_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter(like(F.col("c_name"), "01")).select("c_custkey", "c_name")


@query(f"WITH {NOTES_SQL} SELECT doc_id, lang FROM notes WHERE quality IS NULL AND toxic IS NULL")
def empty_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).filter(empty_record(F.col("quality"), F.col("toxic"))).select("doc_id", "lang")


_REPORT = ("lang", "source", "quality", "toxic")


@query(f"""WITH {NOTES_SQL}, pairs AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, {c}::VARCHAR AS value FROM notes" for c in _REPORT)}),
counts AS (SELECT col, value, count(*) AS n FROM pairs GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY (value IS NULL OR value = ''), n DESC, value) AS rank FROM counts)
SELECT col AS "column", coalesce(sum(n) FILTER (value <> ''), 0)::BIGINT AS filled, coalesce(sum(n) FILTER (value IS NULL OR value = ''), 0)::BIGINT AS empty,
  coalesce(string_agg(value || '=' || n, '; ' ORDER BY rank) FILTER (value <> '' AND rank <= 8), '') AS samples FROM ranked GROUP BY col""")
def column_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.column_report(notes(spark, sf_dir), _REPORT)


@query("SELECT count(*) AS total, count(*) FILTER (event_type IN ('click', 'view')) AS seen, count(*) FILTER (event_type = 'purchase') AS bought, count(*) FILTER (event_type = 'none') AS failed FROM events")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.status_rollup(table(spark, sf_dir, "events"), "event_type", {"seen": ["click", "view"], "bought": ["purchase"], "failed": ["none"]})


@query(f"WITH {NOTES_SQL}, n AS (SELECT doc_id, (lang <> '')::INT + (source <> '')::INT + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT AS fields, quality FROM notes) SELECT doc_id, fields AS field_count, CASE WHEN quality IS NOT NULL THEN least(1.0::DOUBLE, fields / 4.0::DOUBLE + 0.15::DOUBLE) ELSE fields / 4.0::DOUBLE END AS confidence FROM n")
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    count, confidence = facets.core_score({c: F.col(c) for c in _REPORT}, "quality")
    return notes(spark, sf_dir).select("doc_id", count.alias("field_count"), confidence.alias("confidence"))


@query(f"""WITH {RECORDS_SQL}, pairs AS (SELECT 0 AS position, 'n_name' AS dim, n_name AS value FROM records UNION SELECT 1, 'r_name', r_name FROM records UNION SELECT 2, 'c_mktsegment', c_mktsegment FROM records)
SELECT dim, value FROM pairs WHERE contains(lower(value), 'a') ORDER BY position, value LIMIT 12""")
def suggest_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.suggestions(records(spark, sf_dir), ["n_name", "r_name", "c_mktsegment"], "a", 12)


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def missing_columns_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality ELSE -1 END AS quality, d.lang FROM documents d LEFT JOIN labels l USING (doc_id)")
def merge_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("quality"), "lang")
    return tables.overlay(base, table(spark, sf_dir, "labels"), "doc_id", ["quality"])


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT o_orderkey, 'X', o_totalprice + 1 FROM orders WHERE o_orderstatus = 'O'")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.filter("o_orderstatus = 'O'").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return tables.upsert(o, new, ["o_orderkey"])


@query("SELECT o_custkey, o_orderkey, -1 AS block_index FROM orders WHERE o_custkey % 3 <> 0 UNION ALL SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT FROM orders WHERE o_custkey % 3 = 0")
def replace_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    stored = o.withColumn("block_index", F.lit(-1))
    return tables.replace_group(stored, o.filter("o_custkey % 3 = 0"), "o_custkey", "block_index", ["o_orderkey"])


@query(f"WITH {NOTES_SQL} SELECT lang, count(*) AS n FROM notes WHERE quality = 1 AND lang IN ('en', 'de') GROUP BY lang")
def notes_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(notes(spark, sf_dir), NOTES, {"quality": ["1"], "lang": ["en", "de"]}).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RECORDS_SQL}, counts AS ({' UNION ALL '.join(f"SELECT '{d}' AS dim, {c}::VARCHAR AS value, count(*) AS n FROM records WHERE {c} IS NOT NULL GROUP BY 2" for d, c in RECORDS.dimensions.items())}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY CASE WHEN dim IN ('year', 'month') THEN 0 ELSE -n END, value)::INT AS rank FROM counts)
SELECT * FROM ranked WHERE rank <= 4 OR dim IN ('year', 'month', 'segment')""")
def overview_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview(records(spark, sf_dir), RECORDS, 4, by_value=("year", "month"), whole=("segment",))


@query(f"""WITH {RECORDS_SQL}, v AS (SELECT 'region' AS kind, r_name AS value, count(*) AS n FROM records GROUP BY 2 UNION ALL SELECT 'segment', c_mktsegment, count(*) FROM records GROUP BY 2)
SELECT kind, value, NULL::VARCHAR AS target FROM v WHERE contains(lower(value), 'a') UNION ALL SELECT * FROM (VALUES ('alias', 'car', 'AUTOMOBILE'), ('alias', 'far east', 'ASIA')) a(kind, value, target)""")
def completion_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = [("AUTOMOBILE", ["AUTOMOBILE", "car", "motor"]), ("ASIA", ["ASIA", "far east"])]
    return completions(records(spark, sf_dir), RECORDS, ["region", "segment"], groups, "a")

import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

from facetmill.functions.classify import match_spans
from facetmill.operators import facets, tables
from facetmill.operators.predicates import filtered, in_ids, phrase
from facetmill.operators.search import completions, detail_page, health, indexed, overview, search, service_config, write_postings
from facetmill.plans.spec import SearchConfig

CONFIG = SearchConfig(dimensions={"province": "province", "city": "city", "cohort_year": "cohort_year"}, text_columns=("name", "city"), phrase_columns=("name", "city", "notice_title"), pinyin=("name_pinyin", "name_initials"))
ROWS = [
    (1, "张三", "湖南省", "长沙市", 2023, 0.9, "zhangsan", "zs", "选调生分享会"), (2, "李四", "湖南省", "株洲市", 2022, 0.8, "lisi", "ls", "选调生"), (3, "王五", "云南省", "昆明市", 2023, 0.9, "wangwu", "ww", None),
    (4, "张三丰", "云南省", "", None, 0.5, "zhangsanfeng", "zsf", "分享会"), (5, None, "", "长沙市", 2021, None, None, None, "选调生选调生选调生"),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id int, name string, province string, city string, cohort_year int, confidence double, name_pinyin string, name_initials string, notice_title string").cache()


def ids(frame):
    return [r.id for r in frame.collect()]


def counts(result):
    return {(r.dim, r.value): r.n for r in result.collect()}


def test_default_order_and_pages(df):
    assert ids(search(df, CONFIG).page) == [1, 3, 2, 5, 4]
    pages = [ids(search(df, CONFIG, page=p, size=2).page) for p in (1, 2, 3)]
    assert sum(pages, []) == [1, 3, 2, 5, 4]
    e = search(df, CONFIG, page=2, size=2).envelope.first()
    assert (e.total, e.pages, e.has_prev, e.has_next) == (5, 3, True, True)


def test_values_of_a_dimension_add_and_dimensions_cut(df):
    n = lambda **f: search(df, CONFIG, filters=f).matched.count()
    assert n(province=["湖南省", "云南省"]) == n(province=["湖南省"]) + n(province=["云南省"])
    both = set(ids(search(df, CONFIG, filters={"province": ["湖南省"], "cohort_year": ["2023"]}).matched))
    assert both == {1} and n(cohort_year=["x"]) == 5


def test_facets_exclude_their_own_dimension(df):
    wanted = {"province": ["湖南省"], "cohort_year": ["2023", "2022"]}
    got = counts(search(df, CONFIG, filters=wanted).facets)
    for dim, column in CONFIG.dimensions.items():
        rows = filtered(df, CONFIG, wanted, skip=dim).filter(F.col(column).cast("string") != "")
        want = {(dim, str(r[0])): r[1] for r in rows.groupBy(column).count().collect()}
        assert {k: v for k, v in got.items() if k[0] == dim} == want
    for (dim, value), n in counts(search(df, CONFIG).facets).items():
        assert search(df, CONFIG, filters={dim: [value]}).matched.count() == n


def test_modes(df):
    assert search(df, CONFIG, "选调生").mode == "fts" and ids(search(df, CONFIG, "选调生").page)[0] == 5
    assert set(ids(search(df, CONFIG, "zs").matched)) == {1, 4} and set(ids(search(df, CONFIG, "张三").matched)) == {1, 4}
    assert ids(search(df, CONFIG, "分享").matched) == []  # two characters don't search titles


def test_terms_and_then_or(df):
    r = search(df, CONFIG, "张三 长沙")
    assert ids(r.page) == [1] and {x.mode for x in r.matched.collect()} == {"and"}
    r = search(df, CONFIG, "王五 长沙 nothing")
    assert ids(r.page) == [1, 3, 5] and {x.mode for x in r.matched.collect()} == {"or"}
    assert {x.term: x.total for x in r.groups.collect()} == {"王五": 1, "长沙": 2, "nothing": 0}


def test_aliases_follow_exact_hits(df):
    r = search(df, CONFIG, "李四", groups=[("李四", ["李四", "王五"])])
    assert r.mode == "fuzzy" and ids(r.page) == [2, 3]


def test_ids(df):
    assert sorted(ids(in_ids(df, ["1", 3, "x"], "id"))) == [1, 3] and ids(in_ids(df, [], "id")) == []


def test_statistics(df):
    r = facets.fill_rates(df, {"name": "name", "city": "city"}).first()
    assert (r.name, r.city) == (0.8, 0.8)
    assert facets.fill_rates(df.filter("false"), {"name": "name"}).first().name == 0.0
    d = facets.distinct_counts(df, ["province", "city"]).first()
    assert (d.province, d.city) == (2, 3)


def test_loads(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    new = spark.createDataFrame([("a", 9), ("c", 8)], "k string, v int")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [("a", 9), ("b", 3), ("c", 8)]
    numbered = tables.replace_group(old.withColumn("block_index", F.lit(5)), new, "k", "block_index", ["v"])
    assert sorted(map(tuple, numbered.collect())) == [("a", 9, 0), ("b", 3, 5), ("c", 8, 0)]


def test_layout(spark):
    box = lambda x, y: [[x, y], [x + 8.0, y], [x + 8.0, y + 10.0], [x, y + 10.0]]
    lines = [("b", box(50.0, 1.0)), ("a", box(0.0, 0.0)), ("c", box(0.0, 30.0)), ("loose", [])]
    df = spark.createDataFrame([(lines,)], "lines array<struct<text:string,box:array<array<double>>>>")
    assert df.select(tables.reading_order(F.col("lines")).alias("r")).first().r == [["a", "b"], ["c"], ["loose"]]
    assert spark.range(1).select(tables.running_clusters(F.array(*map(F.lit, [0.0, 3.0, 9.0, 10.0])), F.lit(4.0)).alias("c")).first().c == [0, 0, 1, 1]


def test_gazetteer_joins(spark, monkeypatch):
    text = F.lit("在国家安全研究院与研究院")
    got = spark.range(1).select(tables.longest_terms(text, ["研究院", "国家安全研究院", "安全"]).alias("t")).first().t
    assert [(x.start, x.term) for x in got] == [(2, "国家安全研究院"), (10, "研究院")]
    texts = spark.createDataFrame([(1, "abcabc"), (2, None), (3, "xbcx")], "t int, text string")
    needles = spark.createDataFrame([(10, "bc"), (11, "abcabc"), (12, ""), (13, "bc")], "n int, text string")
    for most in (100, 0):
        got = tables.containing(texts, "t", "text", needles, "n", "text", gram=3, most=most)
        assert sorted(map(tuple, got.collect())) == [(1, 10), (1, 11), (1, 13), (3, 10), (3, 13)]
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    by_heads = tables._finder([tuple(r) for r in needles.filter("n <> 12").collect()], "t", "n")
    assert sorted(map(tuple, pd.concat(by_heads(iter([texts.toPandas()]))).values.tolist())) == [(1, 10), (1, 11), (1, 13), (3, 10), (3, 13)]
    words = spark.createDataFrame([("cat",), ("cart",), ("dog",), ("ca",)], "w string")
    known = spark.createDataFrame([("cats",), ("dot",), ("do",)], "k string")
    # dog is one edit from dot and from do, so it has no only match.
    assert sorted(map(tuple, tables.unique_edit_match(words, "w", known, "k").collect())) == [("cat", "cats")]


def test_ids_are_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(5)
    got = sorted((r.x, r.id) for r in tables.stable_ids(df, ["x"]).collect())
    assert [i for _, i in got] == list(range(1, 1001))


def test_field_rules(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "id int, name string, city string")
    rules = spark.createDataFrame([(1, 0, "name", "x"), (1, 1, "name", "y")], "id int, ord int, field string, value string")
    assert sorted(map(tuple, tables.override_fields(df, rules, "id", ["name", "city"]).collect())) == [(1, "y", "b"), (2, "c", "d")]


DOCS = "id int, name string, cohort_year int, confidence double, name_pinyin string, raw_text string"
TEXTS = SearchConfig(dimensions={"name": "name", "cohort_year": "cohort_year"}, text_columns=("name", "raw_text"), phrase_columns=("name", "raw_text"), pinyin=None)


def docs(spark):
    rows = [(1, "甲", 2021, 0.5, "a", "经验分享会经验分享会"), (2, "乙", 2021, 0.9, "b", "一次很长的经验分享会" + "。" * 40), (3, "丙", 2022, 0.1, "c", "交流活动在北京"), (4, "", None, 0.2, "d", None)]
    return spark.createDataFrame(rows, DOCS)


def test_fuzzy_search_goes_by_relevance_where_aliases_add_nothing(spark):
    ids = lambda r: [x.id for x in r.page.collect()]
    assert ids(search(docs(spark), TEXTS, "经验分享", groups=[("经验分享", ["经验分享", "没有的"])])) == ids(search(docs(spark), TEXTS, "经验分享")) == [1, 2]
    found = search(docs(spark), TEXTS, "经验分享", groups=[("经验分享", ["经验分享", "交流活动"])])
    assert ids(found) == [2, 1, 3] and found.envelope.first().total == 3
    assert ids(search(docs(spark), TEXTS, "经验分享", groups=[("经验分享", ["经验分享", "交流活动"])], most_candidates=2)) == [2, 1]


def test_highlight_section_and_detail(spark):
    shown = {r.id: r.highlight for r in search(docs(spark), TEXTS, "经验分享 乙").highlight.collect()}
    assert shown[2].html["name"] == "<mark>乙</mark>" and "<mark>经验分享</mark>" in shown[2].snippet and shown[2].matched_fields == ["name"] and sorted(shown[2].matched_terms) == ["乙", "经验分享"]
    texts = spark.createDataFrame([("b", "whole")], "name_pinyin string, source_text string")
    one = detail_page(docs(spark), TEXTS, 2, texts, "name_pinyin").first()
    assert one.source_text == "whole" and one.highlight.html["name"] == "乙"


def test_index_reads_and_finds_what_a_scan_finds(spark, tmp_path):
    write_postings(docs(spark), TEXTS, str(tmp_path / "index"), buckets=4)
    postings = spark.read.parquet(str(tmp_path / "index"))
    for term in ("经验分享", "分享会", "交流", "甲", "很长的经验", "会经验", "没有的词"):
        want = sorted(r.id for r in docs(spark).filter(phrase(TEXTS.phrase_columns, term)).collect())
        assert sorted(r.id for r in indexed(docs(spark), TEXTS, postings, term, buckets=4).collect()) == want


def test_overviews_and_completions(spark):
    assert tuple(health(docs(spark), TEXTS, "name_pinyin", "raw_text", ["name", "raw_text"]).first())[::3] == (4, 1)
    got = [(r.dim, r.value, r.n, r["rank"]) for r in sorted(overview(docs(spark), TEXTS, 1, by_value=["cohort_year"]).collect())]
    assert got == [("cohort_year", "2021", 2, 1), ("cohort_year", "2022", 1, 2), ("name", "丙", 1, 1)]
    groups = [("经验分享", ["经验分享", "心得"])]
    assert [tuple(r) for r in completions(docs(spark), TEXTS, ["cohort_year"], groups).collect()] == [("cohort_year", "2021", None), ("cohort_year", "2022", None), ("alias", "心得", "经验分享")]
    assert service_config(TEXTS, groups)["fuzzy"] == {"path": "", "groups": 1, "aliases": 1, "available": True}


def test_pinyin_spans():
    table = {"张": "zhang", "三": "san", "丰": "feng"}
    assert match_spans("张三丰", "zs", table) == [(0, 2)] and match_spans("张三丰", "sanf", table) == [(1, 3)] and match_spans("张三丰", "f", table) == [(2, 3)]
    assert match_spans("张三丰", "", table) == match_spans("张x", "zx", table) == []

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from facetmill.functions.gazetteer import Gazetteer
from facetmill.operators.extract import Extractor, cells_of_lines, cells_of_text, destination_score, extract, extraction_summary, occurrences, within_one_edit
from facetmill.operators.resolve import FIELDS, duplicate_of, finalize, group_by_rules, import_report, region_of_title, resolve

X = Extractor(Gazetteer.of({"surnames": "张李王赵刘周", "cities": ["昆明", "武汉", "崇左"]}))


def test_occurrences_are_longest_first_without_overlap():
    assert occurrences("ABCD", ["AB", "BCD"]) == [(1, 4, "BCD")]
    assert occurrences("aXa", ["a", "Xa"]) == [(1, 3, "Xa"), (0, 1, "a")]


@pytest.mark.parametrize(("a", "b", "yes"), [("abc", "abc", True), ("abc", "abd", True), ("abc", "ab", True), ("ab", "xab", True), ("abc", "acb", False), ("a", "abc", False)])
def test_one_edit(a, b, yes):
    assert within_one_edit(a, b) == yes


def test_names():
    assert X.name(["主讲人：张三"]) == "张三"
    assert X.name(["选调分享", "李四", "2023届"]) == "李四"
    assert X.name(["王五 法学院"]) == "王五"
    assert X.name(["欢迎张三学长"]) in ("张三", None)
    assert X.name(["经济", "学院"]) is None and X.name(["山西定向"]) is None


def test_dictionaries_are_parameters():
    bare = Extractor(Gazetteer())
    assert bare.name(["主讲人：张三"]) == "张三" and bare.name(["张三"]) is None and bare.region("昆明") == (None, None)
    with pytest.raises(ValueError):
        Gazetteer.of({"town": []})


def test_places_and_positions_are_trimmed():
    assert X._trim_place("2023年考入湖北省武汉市某局（不定职级）定向选调生") == "湖北省武汉市某局"
    assert X._trim_place("于在：昆明市某委、") == "昆明市某委"
    assert X.position("鹿原镇三口村党总支书记助理（不定职级）") == "党总支书记助理"
    assert X.position("任局长") is None or X.position("担任副局长") == "副局长"
    assert X.major("2021级文物专业", None) == "文物" and X.major("硕士研究生会计学专业", None) == "会计学"


def test_texts_and_ocr_results_as_cells(spark):
    box = lambda y: [[0.0, y], [9.0, y], [9.0, y + 8.0], [0.0, y + 8.0]]
    lines = [("2023届 法学院", box(30.0)), ("主讲人：张三", box(0.0))]
    df = spark.createDataFrame([(1, "主讲人：张三\n2023届 法学院\n扫码入群\n王五", lines)], "k int, text string, lines array<struct<text:string,box:array<array<double>>>>")
    for cells in (cells_of_text(F.col("text")), cells_of_lines(F.col("lines"))):
        rows = df.select("k", cells.alias("cells"))
        got = extract(rows, "k", "cells", X.g)
        assert [(r.name, r.cohort, r.college) for r in got.collect()] == [("张三", "2023届", "法学院")]
    s = extraction_summary(got, df.unionAll(df.withColumn("k", F.lit(2))), "k").first()
    assert (s.documents, s.with_records, s.records, s.nameless, s.with_college, s.with_city) == (2, 1, 1, 0, 1, 0)


def test_colleges():
    text = "2023届定向选调生文学院2020级"
    value, span = X.college(text)
    assert value == "文学院" and text[slice(*span)] == "文学院"
    assert X.college("没有") == (None, None)
    assert X.college("民族学与在会学学院")[0] == "民族学与社会学学院"


def test_other_fields():
    assert X.cohort("2021级本科2024届") == ("2024届", 2024)
    assert X.major("经济学院金融学专业", (0, 4)) == "金融学"
    assert X.region("湖北省武汉市某局") == ("湖北省", "武汉市") and X.region("北京市某委") == ("北京市", "北京市")
    assert X.destination("现就职于湖北省武汉市某局", ["现就职于湖北省武汉市某局"], []) == "湖北省武汉市某局"
    assert X.position("担任党总支书记助理") == "党总支书记助理" and X.position("选调生") is None
    assert X.degree("硕士研究生") == "硕士研究生"
    assert destination_score("湖北省武汉市某局") >= 3 and destination_score("法学院") == 0


def test_blocks_begin_at_names_and_end_at_the_footer():
    cells = ["选调经验分享", "张三", "法学院", "李四", "理学院", "扫码入群", "王五"]
    assert X.blocks(cells) == [["张三", "法学院"], ["李四", "理学院"]]
    assert X.blocks(["标题", "法学院"]) == [["标题", "法学院"]]


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, ["主讲人：张三", "2023届法学院", "现就职于云南省昆明市某局"]), (2, None), (3, []), (4, ["——"])], "k int, cells array<string>")
    got = extract(df, "k", "cells", X.g).collect()
    assert [(r.k, r.block_index, r.name, r.college, r.city, r.cohort_year) for r in got] == [(1, 0, "张三", "法学院", "昆明市", 2023)]
    assert got[0].field_count == 5 and got[0].confidence == 0.864


def _record(org=None, province=None, city=None, year=None):
    return {"org_key": org or "", "province_key": province, "city_key": city, "cohort_year": year}


def test_words_may_share_characters_with_a_college_where_asked():
    own = Gazetteer.of({"colleges": ["onbleea"], "majors": ["hation"], "cities": ["ndtion"]})
    for text, fields in (("andtionbleea", (None, "ndtion")), ("hationbleea", ("hation", None)), ("andtionbleea ndtion", (None, "ndtion"))):
        (r,) = Extractor(own, shared=True).records([text])
        assert (r.college, r.major, r.city) == ("onbleea", *fields)
        (r,) = Extractor(own).records([text])
        assert (r.college, r.major, r.city) == ("onbleea", None, "ndtion" if text.endswith(" ndtion") else None)


def test_the_query_agrees_with_its_sql_on_words_that_run_into_each_other(spark, tmp_path):
    texts = ["rehend andtionbleea hehaor", "hationbleea", "hationbleea\n1 / 2\nnicht ndtion", "queque\r\nthble\x0bspacer.gif", "thanedble\u2028ouaux", "onblee\na", "none", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = entry.queries()["extract_records"](spark, str(tmp_path)).collect()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.execute(entry.oracle_sql()["extract_records"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and {(r.college, r.major, r.city) for r in got if r.doc_id < 2} == {("onbleea", None, "ndtion"), ("onbleea", "hation", None)}


def test_duplicate_rules():
    other = _record(org="中共石家庄市委党校", province="河北省", year=2021)
    assert duplicate_of(_record(org="石家庄市委党校", year=2020), [other])[0] == 0  # organisation before cohort
    assert duplicate_of(_record(org="某局", province="河北省", year=2020), [other]) is None
    assert duplicate_of(_record(org="某局", province="河北省"), [other])[0] == 0
    assert duplicate_of(_record(), [other])[0] == 0


def test_import_sample(spark):
    fields = "name string, cohort string, cohort_year int, college string, major string, destination_org string, city string, province string, position string, degree string, note string"
    none = (None,) * 3
    new = spark.createDataFrame([
        ("张三", "2023届", 2023, "信息学院", None, "湖北省武汉市某局", "武汉市", "湖北省", None, "硕士研究生", None, 3),
        ("刘六", "2021届", 2021, None, "计算机", "石家庄市委党校", "石家庄市", "河北省", *none, 4),
        ("刘六", "2021届", 2021, None, "计算机", "中共石家庄市委党校", "石家庄市", "河北省", "定向选调生", None, None, 5),
        ("赵七", "2022届", 2022, None, None, None, "北京市", "北京市", None, "大学本科", None, 6),
    ], fields + ", source_row int")
    stored = spark.createDataFrame([("张 三", "2023届", 2023, None, None, "武汉市某局", "武汉市", "湖北省", *none, 77)], fields + ", id long")
    done = resolve(new, stored).cache()
    r = import_report(done).first()
    assert (r.imported, r.skipped, r.merged) == (2, 1, 1)
    assert done.filter("status = 'skipped'").first().existing_id == 77
    final = {x.name: x for x in finalize(done, "manual:a.csv").collect()}
    assert final["刘六"].destination_org == "中共石家庄市委党校" and final["刘六"].position == "定向选调生" and final["刘六"].source_rows == [4, 5]
    assert (final["刘六"].block_index, final["赵七"].block_index) == (0, 1)


def test_stored_places_are_normalised_and_ties_go_to_the_first(spark):
    kinds = ", ".join(f"{f} {'int' if f == 'cohort_year' else 'string'}" for f in FIELDS)
    rows = lambda values: spark.createDataFrame([(*[v.get(f) for f in FIELDS], i) for i, v in values], kinds + ", at int")
    new = rows([(1, {"name": "张三", "province": "湖南省"}), (2, {"name": "李四", "city": "湖北省武汉市", "destination_org": "甲乙丙局"}), (3, {"name": "王五", "destination_org": "某某市水利局"}), (4, {"name": "王五", "destination_org": "某某市水利局"}), (5, {"name": None}), (6, {"name": "孤"})])
    stored = rows([(10, {"name": "张 三", "province": "湖南"}), (11, {"name": "张三", "province": "湖南省"}), (12, {"name": "李四", "city": "武汉市", "destination_org": "丁戊己处"})])
    got = resolve(new.withColumnRenamed("at", "source_row"), stored.withColumnRenamed("at", "id")).collect()
    assert sorted((r.name, r.status, r.existing_id or 0, tuple(r.source_rows)) for r in got) == sorted(
        [("张三", "skipped", 10, (1,)), ("李四", "skipped", 12, (2,)), ("王五", "accepted", 0, (3, 4)), ("王五", "merged", 0, (4,)), ("孤", "accepted", 0, (6,))]
    )


def test_groups_hold_first_rows_only(spark):
    rows = [(k, "A b" if k % 2 else "a-B.", k % 7, ["x", "dept of y", "y", ""][k % 4]) for k in range(1, 60)]
    df = spark.createDataFrame(rows, "id int, name string, place int, org string")
    got = {r.id: r.duplicate_of for r in group_by_rules(df, "name", "id", "place", "org").collect()}
    bare = {k: re.sub(r"\W", "", o).lower() for k, _, _, o in rows}
    for k, _, place, _ in rows:
        near = [j for j, *_ in rows if j < k and bare[j] and bare[k] and (bare[j] == bare[k] or len(bare[k]) >= 3 and bare[k] in bare[j] or len(bare[j]) >= 3 and bare[j] in bare[k])]
        same = [j for j, _, p, _ in rows if j < k and p == place]
        assert got[k] == min(near or same or [None], key=lambda x: (x is None, x))


def test_titles_name_a_region_and_a_date(spark):
    titles = ["11月27日|| 沙龙——湖南选调经验分享", "北京 云南定向选调 03 月 5 日", "内蒙古座谈", "无", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string")
    got = [tuple(r.r) for r in df.select("i", region_of_title(F.col("t")).alias("r")).orderBy("i").collect()]
    assert got == [("湖南省", "11月27日"), ("云南省", "3月5日"), ("内蒙古自治区", None), (None, None), (None, None)]

from pyspark.sql import functions as F

from facetmill.functions.gazetteer import Gazetteer
from facetmill.operators import jobs
from facetmill.operators.resolve import FIELDS
from facetmill.sources.io import read_spreadsheets

SHEET = """姓名,学院,专业,去向单位,岗位,城市,省份,届别,学历
name,college,major,destination_org,position,city,province,cohort,degree
张三,信息学院,-,湖北省武汉市某局,-,武汉市,湖北,2023届,硕士研究生
刘六,-,计算机,石家庄市委党校,-,石家庄市,河北,2021届,-
刘六,-,计算机,中共石家庄市委党校,定向选调生,石家庄市,河北,2021届,-
赵七,-,-,-,-,-,北京市,2022届,大学本科
"""


def stored(spark):
    kinds = ", ".join(f"{f} {'int' if f == 'cohort_year' else 'string'}" for f in FIELDS)
    row = {"name": "张三", "cohort": "2023届", "cohort_year": 2023, "destination_org": "武汉市某局", "city": "武汉市", "province": "湖北省"}
    return spark.createDataFrame([("a.jpg", 0, 7, *[row.get(f) for f in FIELDS])], f"image string, block_index int, id long, {kinds}")


def test_import_is_repeatable(spark, tmp_path):
    (tmp_path / "a.csv").write_text(SHEET, "utf-8")
    rows = read_spreadsheets(spark, str(tmp_path))
    done = jobs.import_rows(rows, stored(spark), "manual:a.csv", "a.csv")
    r = done.report.first()
    assert (r.imported, r.skipped, r.merged) == (2, 1, 1)
    once = jobs.store(stored(spark), done).withColumn("id", F.coalesce("id", F.lit(0).cast("long")))
    again = jobs.import_rows(rows, once, "manual:a.csv", "a.csv")
    assert tuple(again.report.first()) == tuple(r) and jobs.store(once, again).count() == once.count() == 3
    got = {x["name"]: x for x in done.records.collect()}
    assert (got["刘六"].destination_org, got["刘六"].position, got["刘六"].evidence) == ("中共石家庄市委党校", "定向选调生", "手工整理自《a.csv》第 4、5 行")
    assert (got["赵七"].city, got["赵七"].province, got["赵七"].field_count) == ("北京市", "北京市", 3)
    assert jobs.prune_orphans(once, spark.createDataFrame([("manual:b.csv",)], "image string")).count() == 1
    assert jobs.replay(once, done.records.limit(1)).count() == 2


def test_records_are_normalised(spark):
    row = {"name": "李 四", "destination_org": "云南省昆明市某局", "province": "-", "cohort": "2024届"}
    rows = spark.createDataFrame([(1, *[row.get(f) for f in FIELDS if f != "cohort_year"]), (2, *[None] * (len(FIELDS) - 1))], "source_row int, " + ", ".join(f"{f} string" for f in FIELDS if f != "cohort_year"))
    got = jobs.build_records(rows, Gazetteer.of({"cities": ["昆明"]})).collect()
    assert [(r.name, r.province, r.city, r.cohort_year) for r in got] == [("李四", "云南省", "昆明市", 2024)]


def test_rules_by_name_and_place(spark):
    records = spark.createDataFrame([("a", 0, "张三", "x"), ("a", 1, "李四", "y"), ("b", 0, "张三", "z")], "image string, block_index int, name string, city string")
    rules = spark.createDataFrame([(0, "a", "张三", None, "name", "王五"), (1, "a", "张三", None, "city", "p"), (2, "a", None, 0, "city", None), (3, "c", "q", None, "city", "r")], "ord int, image string, name string, block_index int, field string, value string")
    got = sorted(map(tuple, jobs.override_records(records, rules).collect()))
    assert got == [("a", 0, "王五", None), ("a", 1, "李四", "y"), ("b", 0, "张三", "z")]
    assert [r.image for r in jobs.unknown_rule_images(rules, records).collect()] == ["c"]


def snapshot(spark, rows):
    kinds = ", ".join(f"{f} {'int' if f == 'cohort_year' else 'string'}" for f in FIELDS)
    return spark.createDataFrame([(image, i, *[row.get(f) for f in FIELDS]) for image, i, row in rows], f"image string, block_index int, {kinds}")


def test_replay_skips_what_is_stored_or_replayed_before(spark):
    li = {"name": "李四", "destination_org": "昆明市某某局", "province": "云南省"}
    wang = {"name": "王五", "destination_org": "成都市某某局", "province": "四川省"}
    shots = snapshot(spark, [
        ("manual:b.csv", 0, li), ("manual:b.csv", 1, wang | {"destination_org": "拉萨市委党校", "province": "西藏自治区"}), ("manual:b.csv", 2, {"name": None}),
        ("manual:a.csv", 0, {"name": "张 三", "destination_org": "武汉市某局"}), ("manual:a.csv", 1, li), ("manual:a.csv", 2, wang), ("manual:a.csv", 3, wang),
    ])
    old = stored(spark).unionByName(stored(spark).withColumns({"image": F.lit("manual:gone.csv"), "id": F.lit(8).cast("long")}))
    got = sorted((r.image, r.block_index, r.name or "") for r in jobs.replay(old, shots).collect())
    assert got == [("a.jpg", 0, "张三"), ("manual:a.csv", 0, "李四"), ("manual:a.csv", 1, "王五"), ("manual:b.csv", 0, "王五"), ("manual:b.csv", 1, "")]
    assert jobs.replay(old, shots, keep_duplicates=True).count() == 8

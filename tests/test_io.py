import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from facetmill.operators.jobs import override_records
from facetmill.operators.search import alias_groups
from facetmill.sources import io as src
from facetmill.streaming.stream import file_stream, first_occurrences, load_available, replace_sources

HEAD = ["姓名", "学院", "去向单位", "省份"]


def test_payload_to_images(spark, tmp_path):
    html = '<p><img src="/spacer.gif"><IMG alt="a b" src=\'http://x:80/i.png\'><img src="http://x/i.png"></p>'
    page = {"datas": {"tables": [{"notice_id": " 7 ", "notice_title": "t", "notice_release_time": "2023-11-27 08:00", "notice_content": html}], "page": {"total": 1}}}
    (tmp_path / "p.json").write_text(json.dumps(page, indent=1), "utf-8")
    notices = src.notices(spark, str(tmp_path / "p.json"))
    assert notices.first().notice_id == "7"
    images = src.images(notices)
    assert sorted((r.position, r.image_url, r.alt) for r in images.collect()) == [(2, "http://x/i.png", "a b"), (3, "http://x/i.png", "")]
    one = src.image_names(src.first_by_url(images, "position")).collect()
    assert [r.file_name for r in one] == ["20231127_7_02_a b.png"]


def test_ocr_results_skip_corrupt_files(spark, tmp_path):
    good = {"image": "a.jpg", "engine": "e", "elapsed": 0.1, "mean_score": 0.5, "lines": [{"text": "x", "score": 0.9, "box": [[0, 0], [1, 1]]}], "meta": {"alt": "q"}}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "bad.json").write_text("{ not json")
    (tmp_path / "_summary.json").write_text("{}")
    rows, corrupt = src.ocr_results(spark, str(tmp_path))
    assert [r.image for r in rows.collect()] == ["a.jpg"] and corrupt.first().corrupt == 1


def test_metadata_last_file_wins(spark, tmp_path):
    for name, title in (("m1", "old"), ("m2", "new")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"records": [{"notice_title": title, "local_path": "d\\a.jpg"}, {"local_path": ""}]}))
    got = src.image_metadata(spark, str(tmp_path)).collect()
    assert [(r["name"], r.notice_title) for r in got] == [("a.jpg", "new")]


def test_filename_metadata(spark):
    df = spark.createDataFrame([("20231127_n1_02_a_b",), ("other",)], "s string").select(src.filename_metadata(F.col("s")).alias("m"))
    assert [tuple(r.m) if r.m else None for r in df.collect()] == [("2023-11-27", "n1", 2, "a_b"), None]


def workbook(rows):
    cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r) if v) + "</row>" for i, r in rows)
    ns = "http://schemas.openxmlformats.org"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}/spreadsheetml/2006/main" xmlns:r="{ns}/officeDocument/2006/relationships"><sheets><sheet name="s" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{ns}/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_spreadsheets(spark, tmp_path):
    rows = [(1, ["标题"]), (3, HEAD), (4, ["张三", "", "某局", "湖南"]), (5, HEAD), (6, ["", "理学院"]), (8, ["李四", "法学院"])]
    (tmp_path / "a.xlsx").write_bytes(workbook(rows))
    (tmp_path / "b.csv").write_bytes("姓名,省份\n王五,云南\n".encode("gbk"))
    (tmp_path / "c.csv").write_bytes("﻿name,省份\n赵六,-\n".encode())
    got = sorted((r.file[-5:], r.source_row, r["name"], r.province) for r in src.read_spreadsheets(spark, str(tmp_path)).collect())
    assert got == [("a.xlsx"[-5:], 4, "张三", "湖南"), ("a.xlsx"[-5:], 8, "李四", None), ("b.csv", 2, "王五", "云南"), ("c.csv", 2, "赵六", "-")]
    with pytest.raises(ValueError):
        src.spreadsheet_rows("x.xls", b"")
    assert src.spreadsheet_rows("x.csv", b"no header\n") == []


def test_snapshots_and_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "张三", None), (2, "李四", "x")], "id int, name string, note string")
    src.write_snapshot(df, str(tmp_path / "s" / "one"), "manual:a.csv")
    back = src.read_snapshots(spark, str(tmp_path / "s" / "*"), "id:int,name:string,note:string")
    assert sorted((r.image, r.id, r.note) for r in back.collect()) == [("manual:a.csv", 1, None), ("manual:a.csv", 2, "x")]
    texts = [json.loads(r.value) for r in src.static_export(df, ["id"], ["name", "note"]).collect()]
    assert texts[0] == {"id": 1, "detail": {"name": "张三"}}


def test_rule_documents():
    text, fields, warnings = src.correction_rules({"text": {"global": [{"from": "a", "to": "b"}, {"from": "(", "to": "", "regex": True}, {"to": "x"}], "images": {"i": [{"from": "c", "to": "d"}]}}, "fields": {"i": [{"name": "张三", "city": "长沙市", "odd": 1}, {"city": "x"}]}})
    assert [(r["image"], r["from"]) for r in text] == [(None, "a"), ("i", "c")] and len(warnings) == 4
    assert [(r["name"], r["field"], r["value"]) for r in fields] == [("张三", "city", "长沙市")]


def test_small_parsers():
    assert src.interpolated("${A}-${B:-x}-${C}", {"A": "1"}) == "1-x-"
    assert src.cookies('{"a": "b"}') == src.cookies('[{"name": "a", "value": "b"}]') == {"a": "b"}
    assert src.source_key("d\\a.csv") == "manual:d/a.csv"


def test_scale(spark):
    df = spark.createDataFrame([(600, 900), (5000, 1000), (1300, 1400)], "w int, h int").select(src.enhancement_scale(F.col("w"), F.col("h")).alias("s"))
    assert [round(r.s, 3) for r in df.collect()] == [2.0, 0.8, 1.0]


def test_recognition_falls_back(spark):
    def missing():
        raise ImportError("no engine")

    def load():
        return lambda content: [{"text": content.decode(), "score": 1.0, "box": []}]

    df = spark.createDataFrame([("a", bytearray(b"hi"))], "image string, content binary")
    r = src.recognize(df, [("first", missing), ("second", load)]).first()
    assert (r.engine, r.lines[0].text, r.error) == ("second", "hi", None)
    assert "no engine" in src.recognize(df, [("first", missing)]).first().error


def pages(folder, ids, total=None):
    for k, rows in ids.items():
        page = {"tables": [{"notice_id": str(i), "notice_title": " t "} for i in rows]} | ({"page": {"total": total}} if total else {})
        (folder / f"page-{k}.json").write_text(json.dumps({"datas": page}))


def test_saved_pages_end_before_a_gap_or_an_empty_page(spark, tmp_path):
    pages(tmp_path, {k: [k, -k] for k in range(1, 24)} | {24: [], 25: [9], 30: [1]})
    got = src.saved_pages(spark, str(tmp_path)).collect()
    assert sorted({r.page for r in got}) == list(range(1, 24)) and len(got) == 46 and {r.notice_title for r in got} == {"t"}


@pytest.mark.parametrize(("total", "seen"), [(None, 4), (3, 3)])
def test_notice_lists_end_at_an_empty_page_or_the_total(spark, tmp_path, total, seen):
    pages(tmp_path, {1: [1, 2], 2: [3], 3: [4], 4: []}, total)
    spark.dataSource.register(src.NoticeList)
    got = spark.read.format("notice_list").option("url", f"file://{tmp_path}/page-{{page}}.json").load().collect()
    assert sorted(int(r.notice_id) for r in got) == list(range(1, seen + 1))


def test_fetched_files_and_failures(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"hi")
    df = spark.createDataFrame([(1, f"file://{tmp_path}/a"), (2, f"file://{tmp_path}/none")], "k int, image_url string")
    got = sorted(src.fetched(df).collect())
    assert [(r.k, r.status, r.size_bytes) for r in got] == [(1, "ok", 2), (2, "failed", None)]
    assert got[0].sha256 == hashlib.sha256(b"hi").hexdigest() and got[1].error
    assert src.crawl_summary(src.fetched(df)).first() == (2, 1, 1)


def test_documents_are_reloaded_when_they_change(spark, tmp_path):
    file = tmp_path / "terms.yaml"
    live = src.Reloaded(spark, f"file://{file}", alias_groups, [])
    assert live.get() == []
    file.write_text("groups:\n  - canonical: 信息工程学院\n    aliases: [信工]\n", "utf-8")
    assert live.get() == [("信息工程学院", ["信息工程学院", "信工"])] and live.get() is live.value
    file.write_text("groups: [[a, b], {oops", "utf-8")
    assert live.get() == [("信息工程学院", ["信息工程学院", "信工"])] and live.problem
    file.write_text('{"groups": [["a", "b", "c"]]}', "utf-8")
    assert live.get() == [("a", ["a", "b", "c"])] and live.problem is None
    file.unlink()
    assert live.get() == []


def test_rule_files_end_to_end(spark, tmp_path):
    (tmp_path / "rules.yaml").write_text("""
text:
  global:
    - {from: '(\\d+)届', to: '\\1级', regex: true}
    - {from: same, to: same}
  images:
    d/a.jpg: [{from: 误, to: 正}, oops]
fields:
  a.png: [{name: 张三, set: {city: ${CITY:-长沙市}}}, {block_index: 1, city: x}, {block_index: 1, city: y}]
  b: no list
""", "utf-8")
    text, fields, warnings = src.correction_rules(src.load_document(spark, str(tmp_path / "rules.yaml"), {}))
    assert [(r["image"], r["from"]) for r in text] == [(None, r"(\d+)届"), ("a", "误")]
    assert [(r["image"], r["name"], r["block_index"], r["value"]) for r in fields] == [("a", "张三", None, "长沙市"), ("a", None, 1, "x"), ("a", None, 1, "y")]
    assert len(warnings) == 4
    records = spark.createDataFrame([("a", 0, "张三", None), ("a", 1, "李四", None)], "image string, block_index int, name string, city string")
    assert sorted((r.name, r.city) for r in override_records(records, src.rule_table(spark, fields)).collect()) == [("张三", "长沙市"), ("李四", "y")]


def test_headers_need_two_columns_and_bad_files_are_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("姓名\n姓名,学院,城市\n张三,法学院,长沙市\n", "utf-8")
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    (tmp_path / "c.pdf").write_bytes(b"other")
    got = sorted(src.read_spreadsheets(spark, str(tmp_path)).collect(), key=lambda r: r.file)
    assert [(r["name"], r.college, r.city, r.source_row, bool(r.error)) for r in got] == [("张三", "法学院", "长沙市", 3, False), (None, None, None, None, True)]


def test_tables_summaries_static_sites_and_stop_words(spark, tmp_path):
    assert src.open_tables(spark, "facetmill_test", {"a": "k int", "b": "v string"}, reset=True) == ["a", "b"]
    assert src.open_tables(spark, "facetmill_test", {"a": "k int"}) == ["a", "b"]
    spark.sql("DROP DATABASE facetmill_test CASCADE")
    path = str(tmp_path / "summary")
    assert src.merge_summary(spark, path, {"a": 1, "b": 2}) == {"a": 1, "b": 2}
    assert src.merge_summary(spark, path, {"b": 3}) == {"a": 1, "b": 3} == src.load_document(spark, path)
    df = spark.createDataFrame([(1, "张三", None), (2, "李四", "x")], "id int, name string, note string")
    src.write_static(df, str(tmp_path / "site"), ["id"], ["name", "note"], stats=df.groupBy().count())
    back = src.read_static(spark, str(tmp_path / "site"), "id int", "name string, note string")
    assert sorted(map(tuple, back.collect())) == [(1, "张三", None), (2, "李四", "x")] and spark.read.json(str(tmp_path / "site" / "stats")).first()[0] == 2
    (tmp_path / "stop.txt").write_text("# note\n a \n\nb\na\n")
    assert sorted(r.word for r in src.stop_words(spark, str(tmp_path / "stop.txt")).collect()) == ["a", "b"]


def test_streams(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    put = lambda name, rows: (inbox / name).write_text("\n".join(json.dumps({"k": k, "v": v}) for k, v in rows))
    run = lambda: load_available(first_occurrences(file_stream(spark, str(inbox), "k string, v int"), ["k"]), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    put("a.json", [("x", 1), ("x", 2), ("y", 3)])
    run()
    run()
    put("b.json", [("y", 4), ("z", 5)])
    run()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["x", "y", "z"]
    replace_sources(file_stream(spark, str(inbox), "k string, v int"), str(tmp_path / "parts"), str(tmp_path / "cp2"), "k").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "parts")).select("k").distinct().count() == 3

import pytest
from pyspark.sql import functions as F

from facetmill.functions import classify as cl
from facetmill.functions import text as tx
from facetmill.operators import highlight
from facetmill.operators.predicates import keyword_mode, merge_legacy, parse_filters
from facetmill.operators.search import alias_groups, expand_terms
from facetmill.plans.spec import SearchConfig, n_pages, page_of, resolve_sort


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_parse_query(spark):
    cases = {"张三,选调、山西": ["张三", "选调", "山西"], "  张三   张三  ": ["张三"], "": [], " \t": [], "a+b|c/d；e;f": list("abcdef")}
    assert [tx.parse_query(q) for q in cases] == list(cases.values())
    assert apply(spark, tx.parse_query_col, cases) == list(cases.values())
    assert tx.parse_query(None) == []


def test_filters():
    c = SearchConfig()
    assert parse_filters(c, {"province": "湖南省", "city": ["a", "a", " ", None], "nope": ["x"], "college": ""}) == {"province": ["湖南省"], "city": ["a"]}
    assert parse_filters(c, None) == {}
    assert merge_legacy({"province": "云南省"}, province="四川省", city=None) == {"province": ["云南省", "四川省"]}


@pytest.mark.parametrize(("word", "mode"), [("", "all"), ("张三", "like"), ("选调生", "fts"), ("zs", "pinyin"), ("zhang san", "pinyin"), ("2024", "fts"), ("24", "like")])
def test_keyword_modes(word, mode):
    assert keyword_mode(word) == mode


def test_pages_and_sorts():
    assert page_of("x", None) == (1, 20) and page_of(0, 1000) == (1, 100) and page_of("3", "-1") == (3, 1)
    assert (n_pages(0, 20), n_pages(41, 20)) == (0, 3)
    assert resolve_sort("", True) == "relevance" and resolve_sort(None, False) == "cohort_desc" and resolve_sort("odd", True) == "odd"


def test_cleaning(spark):
    assert apply(spark, tx.collapse_repeats, ["哈哈哈哈", "哈哈哈", "分享分享分享分享会"]) == ["哈哈", "哈哈哈", "分享分享会"]
    assert apply(spark, tx.normalize_width, ["Ａ１，（ｘ）　。"]) == ["A1,(x) ."]
    assert apply(spark, tx.strip_invisible, ["a​b﻿\x07"]) == ["ab"]
    assert apply(spark, tx.fix_typos, ["定向选调牛时问"]) == ["定向选调生时间"]
    assert apply(spark, tx.normalize_text, ["①ﬁ​"]) == ["1fi"]
    lines = apply(spark, tx.clean_lines, ["选调 分享\n——\n1/9\na\n选调分享\n内容一\n扫码入群\n之后", "", "a\x85bb\u2028cc\r\ndd\n"])
    assert lines == [["选调分享", "内容一"], [], ["bb", "cc", "dd"]]


def test_noise_is_unicode_aware(spark):
    assert apply(spark, tx.is_noise, ["湖南省", "***", "微信公众号：x", "研究工作室"]) == [False, True, True, True]


def test_values(spark):
    assert apply(spark, tx.clean_value, ["-", " 无 ", "N/A", "2023.0", "a　 b", None]) == [None, None, None, "2023", "a b", None]
    assert apply(spark, tx.image_stem, ["a.jpg", "dir\\a.PNG", "d/e/b.txt", None]) == ["a", "a", "b.txt", ""]
    assert apply(spark, tx.shorten_region, ["湖南省", "广西壮族自治区", "省", "香港特别行政区"]) == ["湖南", "广西壮族", "省", "香港"]
    assert apply(spark, tx.normalize_url, ["http://a:80/x", "https://a:443", "http://a:8080/"]) == ["http://a/x", "https://a", "http://a:8080/"]
    assert apply(spark, tx.encode_path, ["a b/ü.jpg"]) == ["a%20b/%C3%BC.jpg"]
    assert apply(spark, tx.escape_html, ["<a> & \"'", None]) == ["&lt;a&gt; &amp; &quot;&#x27;", ""]
    assert apply(spark, tx.compact_date, ["20231127", "2023"]) == ["2023-11-27", None]
    assert apply(spark, tx.safe_filename, ["a/b:c", "", "x" * 80]) == ["a_b_c", "untitled", "x" * 60]
    assert apply(spark, tx.is_latin, ["Li Si", "2024", "张", "O’Neil-x"]) == [True, False, False, True]


def test_classification(spark):
    majors = {"金融学": "金融类", "计算机科学与技术": "技术研发类", "民族学": "其他"}
    assert apply(spark, lambda c: cl.classify(F.lit(None), F.lit(""), c)["category"], majors) == list(majors.values())
    got = apply(spark, lambda c: cl.classify(F.lit(None), c, F.lit("金融学")), ["市财政局", "某单位", "某大学"])
    assert [(r.category, r.basis) for r in got] == [("金融类", "岗位/单位"), ("公务/事业单位", "默认"), ("教育类", "岗位/单位")]
    assert apply(spark, cl.degree_level, ["硕士研究生", "MBA", "学士", "PhD", "专科", ""]) == ["硕士", "硕士", "本科", "博士", None, None]
    got = apply(spark, cl.cohort, ["2021级 2024届", "2020年毕业", "2019级", "无"])
    assert [tuple(r) if r else None for r in got] == [("2024届", 2024), ("2020届", 2020), ("2019级", 2019), None]


def test_pinyin(spark):
    table = {"张": "zhang", "三": "san"}
    keys = apply(spark, lambda c: cl.pinyin_keys(c, table), ["张三", "李四", None])
    assert [tuple(k) for k in keys] == [("zhangsan", "zs"), ("", ""), ("", "")]
    hit = lambda q: apply(spark, lambda c: cl.pinyin_matches(F.lit("zhangsan"), F.lit("zs"), q), ["x"])[0]
    assert [hit(q) for q in ("zs", "z", "zhangs", "lisi", "")] == [True, True, True, False, False]


def test_derived_columns(spark):
    df = spark.createDataFrame([("张三", None, "市财政局", "x", "硕士")], "name string, position string, destination_org string, major string, degree string")
    r = cl.with_derived(df, {"张": "zhang", "三": "san"}).first()
    assert (r.name_pinyin, r.name_initials, r.position_category, r.degree_level) == ("zhangsan", "zs", "金融类", "硕士")


def test_highlighting(spark):
    assert apply(spark, lambda c: highlight.mark(c, ["选调", "选调生"]), ["选调生经验", "<b>选调"]) == ["<mark>选调生</mark>经验", "&lt;b&gt;<mark>选调</mark>"]
    long = "x" * 300 + "选调生" + "y" * 300
    (cut, none) = apply(spark, lambda c: highlight.snippet(c, ["选调生"]), [long, "nothing"])
    assert cut.startswith("…") and cut.endswith("…") and len(cut) <= 180 and "<mark>选调生</mark>" in cut and none is None
    assert apply(spark, lambda c: highlight.snippet(c, []), ["y" * 200]) == ["y" * 160 + "…"]
    r = apply(spark, lambda c: highlight.build({"name": c, "city": F.lit("b.c")}, c, ["b.c", "zz"]), ["a B.C"])[0]
    assert r.matched_fields == ["name", "city"] and r.matched_terms == ["b.c"] and r.html["city"] == "<mark>b.c</mark>"


def test_aliases():
    groups = alias_groups({"groups": [{"canonical": "湖南", "aliases": ["湘", "三湘"]}, ["A", "b"], {"term": "x", "variants": []}], "aliases": {"沪": ["上海", "申"]}})
    assert [c for c, _ in groups] == ["湖南", "A", "上海", "申"]
    assert expand_terms(["Ａ", "三 湘", "none"], groups) == [("Ａ", ["Ａ", "b"]), ("三 湘", ["三 湘", "湖南", "湘"]), ("none", ["none"])]


def test_line_rules_by_image_and_on_the_normalised_line(spark):
    from facetmill.operators.rules import apply_line_corrections, apply_text_rules

    rules = [{"image": None, "from": "A1", "to": "ok", "regex": False}, {"image": "p.jpg", "from": "B+", "to": "x", "regex": True}]
    rows = [("d/p.jpg", ["A1", "Ａ１", "BB", "Ｃ"]), ("q.png", ["A1 BB", None]), (None, ["BB"]), ("p", None)]
    df = spark.createDataFrame([(i, x and [(t, 1) for t in x]) for i, x in rows], "image string, lines array<struct<text:string,page:int>>")
    got = {r.image: (r.lines and [(x.text, x.page) for x in r.lines], r.corrected) for r in apply_line_corrections(df, rules).collect()}
    assert got == {"d/p.jpg": ([("ok", 1), ("ok", 1), ("x", 1), ("Ｃ", 1)], 3), "q.png": ([("ok BB", 1), (None, 1)], 1), None: ([("BB", 1)], 0), "p": (None, 0)}
    assert apply(spark, lambda x: apply_text_rules(x, rules, F.lit("q")), ["A1BB"]) == ["okBB"]


def test_rules_are_python_expressions_and_are_reported(spark):
    from facetmill.operators.rules import apply_text_rules, rule_report

    rules = [{"from": r"(\d+)届", "to": r"\1级", "regex": True}, {"from": "x+", "to": "$5", "regex": True}, {"from": "\\", "to": "\\1"}, {"image": "b.png", "from": "级", "to": "班"}, {"from": "never", "to": ""}]
    assert apply(spark, lambda x: apply_text_rules(x, rules, F.lit("a")), ["2023届", "axxb", "\\", None]) == ["2023级", "a$5b", "\\1", None]
    df = spark.createDataFrame([("d/a.jpg", ["2023届", "１届", ""]), ("b", ["2021届xx", None]), ("c", None)], "image string, lines array<string>")
    got = sorted(map(tuple, rule_report(df, rules).collect()))
    assert [(r[0], r[1], r[4], r[5]) for r in got] == [(0, None, 3, True), (1, None, 1, True), (2, None, 0, False), (3, "b", 1, True), (4, None, 0, False)]
    plain = [r for r in rules if not r.get("regex")]
    assert apply(spark, lambda x: apply_text_rules(x, plain, F.lit("b.png")), ["级\\"]) == ["班\\1"]


def test_strings_and_columns_agree(spark):
    lines = ["", " ", "扫码入群", "1 / 3", "正文", "spacer.gif x", "某工作室", "=====", "abc", "关注我们", "长按识别", "éé", "_", "12", "第１行　x"]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    got = {r.x: (r.n, r.f, r.t) for r in df.select("x", tx.is_noise(F.col("x")).alias("n"), tx.is_footer(F.col("x")).alias("f"), tx.normalize_text(F.col("x")).alias("t")).collect()}
    assert got == {x: (tx.noise_line(x), tx.footer_line(x), tx.normalize_plain(x)) for x in lines}
    assert tx.cleaned_lines("主题：：：：：\n\u200b正文 一\r\n正文 一\n12\nx\n扫码入群\n后") == ["主题::", "正文一", "12"]
    assert tx.parse_query("12 2a，12") == spark.range(1).select(tx.parse_query_col(F.lit("12 2a，12")).alias("t")).first().t == ["12", "2a"]

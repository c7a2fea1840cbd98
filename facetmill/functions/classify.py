"""Ordered keyword rules: job categories, degree levels, cohorts; pinyin keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, normalize_latin

Rules = Sequence[tuple[str, Sequence[str]]]

# Fixed values ---------------------------------------------------------------------------------
CATEGORIES = ("公务/事业单位", "技术研发类", "教育类", "金融类", "其他")
OTHER, DEFAULT = "其他", "公务/事业单位"
JOB_RULES: Rules = (
    ("教育类", ("教师", "老师", "辅导员", "讲师", "助教", "教授", "班主任", "教研", "教研室", "教育", "党校", "干部学院", "中学", "小学", "幼儿园",
             "学校", "大学", "学院", "书院", "职业技术", "高等专科", "招生办", "教务处", "培训", "支教")),
    ("金融类", ("银行", "证券", "保险", "基金", "信托", "金融", "投资", "会计", "财务", "审计", "税务", "财政", "国资", "担保", "租赁", "交易所")),
    ("技术研发类", ("工程师", "技术", "研发", "开发", "软件", "算法", "数据", "人工智能", "计算机", "信息化", "信息中心", "工业和信息化", "大数据", "网络",
              "运维", "测试", "产品经理", "架构", "系统", "通信", "电子", "自动化", "科研", "研究院", "研究所", "实验室", "设计院", "科技")),
    ("公务/事业单位", ("政府", "党委", "党工委", "纪委", "监委", "纪检监察", "组织部", "宣传部", "统战部", "政法委", "人大", "政协", "法院", "检察",
                 "公安", "司法", "公务员", "参公", "事业编", "事业单位", "选调", "街道", "乡镇", "乡村", "社区", "居委", "管委会", "管理局",
                 "服务中心", "促进中心", "办公室", "委员会", "机关", "共青团", "妇联", "工会", "残联", "工商联", "红十字会", "发改", "住建",
                 "交通", "民政", "人社", "水利", "农业", "农村", "林草", "应急", "市场监管", "生态环境", "文旅", "卫生健康", "医保", "自然资源",
                 "城市管理", "综合执法", "编办", "机关事务")),
)
MAJOR_RULES: Rules = (
    ("教育类", ("教育学", "师范", "学前教育", "学科教学", "课程与教学", "教育技术")),
    ("金融类", ("金融", "会计", "财务管理", "审计", "统计", "经济", "保险", "国际贸易")),
    ("技术研发类", ("计算机", "软件", "信息", "电子", "通信", "自动化", "数据科学", "人工智能", "网络工程", "工程", "数学")),
)
DEGREE_RULES: Rules = (
    ("博士", ("博士", "博研", "博士后", "phd")),
    ("硕士", ("硕士", "研究生", "攻读", "mba", "mpa", "master")),
    ("本科", ("本科", "学士", "大学本科", "应届毕业生", "bachelor")),
)
BASIS_JOB, BASIS_DEFAULT, BASIS_MAJOR, NO_SIGNAL = "岗位/单位", "默认", "专业", "无更具体的岗位信号"
COHORT_PATTERNS = ((r"((?:20|19)\d{2})\s*届", "届"), (r"((?:20|19)\d{2})\s*年\s*毕业", "届"), (r"((?:20|19)\d{2})\s*级", "级"), (r"((?:20|19)\d{2})\s*年\s*入学", "级"))
# ----------------------------------------------------------------------------------------------


def _labels(rules: Rules) -> Column:
    """A map from keywords to labels; a keyword of several rules belongs to the first."""
    first = {w: label for label, words in reversed(rules) for w in words}
    return F.create_map(*[F.lit(x) for pair in first.items() for x in pair])


def first_keyword(text: Column, rules: Rules) -> Column:
    """The keyword that decides, in the order of rules and of keywords in a rule. One small expression for any number of keywords."""
    words = F.array(*[F.lit(w) for _, own in rules for w in own])
    return F.get(F.filter(words, lambda w: F.contains(text, w)), F.lit(0))


def first_rule(text: Column, rules: Rules) -> Column:
    """Label of the first rule that has a keyword in the text, else null."""
    return let(first_keyword(text, rules), lambda w: F.when(w.isNotNull(), F.element_at(_labels(rules), w)))


def classify(position: Column, org: Column, major: Column) -> Column:
    """struct(category, evidence, basis): job and organisation first, the major only without both.

    The keyword that decides is looked for once, and its rule follows from it.
    """
    job = F.trim(F.concat_ws(" ", F.nullif(position, F.lit("")), F.nullif(org, F.lit(""))))
    weak = F.trim(F.coalesce(major, F.lit("")))

    def row(category: Column, evidence: Column, basis: Column) -> Column:
        return F.struct(category.alias("category"), evidence.alias("evidence"), basis.alias("basis"))

    null = F.lit(None).cast("string")
    found = let(first_keyword(job, JOB_RULES), lambda k: F.when(k.isNotNull(), row(F.element_at(_labels(JOB_RULES), k), k, F.lit(BASIS_JOB))).otherwise(row(F.lit(DEFAULT), F.lit(NO_SIGNAL), F.lit(BASIS_DEFAULT))))
    guessed = let(first_keyword(weak, MAJOR_RULES), lambda k: F.when(k.isNotNull(), row(F.element_at(_labels(MAJOR_RULES), k), k, F.lit(BASIS_MAJOR))).otherwise(row(F.lit(OTHER), null, null)))
    return F.when(job != "", found).otherwise(guessed)


def degree_level(degree: Column) -> Column:
    return first_rule(F.lower(F.trim(F.coalesce(degree, F.lit("")))), DEGREE_RULES)


def category_rank(category: Column, order: Sequence[str] = CATEGORIES) -> Column:
    """Sort key of a fixed order; unknown values last."""
    at = F.array_position(F.array(*map(F.lit, order)), category)
    return F.when(at > 0, at).otherwise(len(order) + 1)


def cohort(text: Column) -> Column:
    """struct(cohort, year): graduation before enrolment, each spelling in turn."""
    tries = []
    for pattern, unit in COHORT_PATTERNS:
        year = F.regexp_extract(text, pattern, 1)
        tries.append(F.when(year != "", F.struct(F.concat(year, F.lit(unit)).alias("cohort"), year.cast("int").alias("year"))))
    return F.coalesce(*tries)


def pinyin_keys(name: Column, table: Mapping[str, str]) -> Column:
    """struct(full, initials) by a table from characters to syllables; '' for both when a character isn't in it."""
    syllables = dict(table)

    @F.pandas_udf("full string, initials string")
    def keys(names: pd.Series) -> pd.DataFrame:
        found = [[syllables.get(c) for c in (n or "").strip()] for n in names]
        good = [s if s and all(s) else [] for s in found]
        return pd.DataFrame({"full": ["".join(s) for s in good], "initials": ["".join(x[0] for x in s) for s in good]})

    return keys(name)


def pinyin_matches(full: Column, initials: Column, query: str) -> Column:
    """Highlighting's rule: up to two letters are a prefix of the initials; longer ones lie in the full
    spelling or begin the initials."""
    q = "".join(c for c in query.lower() if c.isascii() and c.isalnum())
    if not q:
        return F.lit(False)
    if len(q) <= 2:
        return F.startswith(initials, F.lit(q))
    return F.contains(full, F.lit(q)) | F.startswith(initials, F.lit(q))


def match_spans(name: str, query: str, table: Mapping[str, str]) -> list[tuple[int, int]]:
    """Where a name's characters are those whose syllables, or their initials, the query spells from some character on."""
    q = "".join(c for c in query.lower() if c.isascii() and c.isalnum())
    syllables = [table.get(c, "") for c in name]
    out = []
    for a in range(len(name)):
        for spelled in (syllables, [s[:1] for s in syllables]):
            run, b = "", a
            while b < len(name) and spelled[b] and len(run) < len(q):
                run, b = run + spelled[b], b + 1
            if q and run.startswith(q) and (a, b) not in out:
                out.append((a, b))
    return [s for s in out if not any(s[0] < b and a < s[1] for a, b in out[: out.index(s)])]


def with_derived(df: DataFrame, table: Mapping[str, str]) -> DataFrame:
    """The four derived columns, recomputed as a view."""
    keys = pinyin_keys(F.col("name"), table)
    return df.withColumn("_keys", keys).withColumns({
        "name_pinyin": normalize_latin(F.col("_keys.full")), "name_initials": normalize_latin(F.col("_keys.initials")),
        "position_category": classify(F.col("position"), F.col("destination_org"), F.col("major"))["category"],
        "degree_level": degree_level(F.col("degree")),
    }).drop("_keys")

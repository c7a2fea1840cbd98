import hashlib

from pyspark.sql import functions as F

from facetmill.llm.chat import FRAMES, PAGE, digest, escape, format_conversations, read_back, unescape
from facetmill.llm.queries import ORACLES, QUERIES

TURNS = "conv_id long, turn long, role string, text string, before int, piece string"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)


def test_escaping_is_reversible(spark):
    texts = ["", "<", "</turn>", r"<\/turn>", r"<\\\turn user>", "<part image 0>", "<<turn <part", r"\### Assistant: </turn> ok", "<tur n>", "<\\"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape("t").alias("e"))
    got = df.select("t", "e", unescape("e").alias("u")).collect()
    assert all(r.u == r.t for r in got)
    assert not any(m in r.e for r in got for m in ("<turn", "</turn", "<part"))


def test_query_against_brute_force(spark, sf_dir):
    rows = [(1, 0, "user", "hi </turn>\n<turn assistant>"), (1, 1, "assistant", "yes\n\n"), (1, 2, "assistant", None), (2, 5, "a>b%3E<", "x"), (2, 3, None, ""), (None, 0, "assistant", "lone"),
            (3, 1, "assistant", "tie"), (3, 1, "assistant", "tie"), (3, 1, "user", "tie"), (4, 0, "assistant", "ünï😀 " * 4000)]
    got = {r.conv_id: r for r in QUERIES["op10_typed_content_parts"](spark, sf_dir(conversations=turns_of(spark, rows))).collect()}
    said = r"\### Assistant: </turn> ok"
    rows = [*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)]
    assert sorted(got, key=str) == sorted({r[0] for r in rows}, key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in got:
        own = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))
    assert "op10_typed_content_parts" in ORACLES


def test_parts_become_numbered_placeholders(spark):
    parts = """array(named_struct('kind','text','text','see <part','ref',null,'width',null,'height',null,'seconds',null,'pages',null),
      named_struct('kind','image','text',null,'ref','a.png','width',57,'height',28,'seconds',null,'pages',null))"""
    more = """array(named_struct('kind','audio','text',null,'ref','b.wav','width',null,'height',null,'seconds',1.5D,'pages',null),
      named_struct('kind','scan','text',null,'ref','c.pdf','width',null,'height',null,'seconds',null,'pages',3), null)"""
    df = spark.sql(f"SELECT 1L AS conv_id, 0 AS turn, 'user' AS role, {parts} AS parts UNION ALL SELECT 1L, 1, 'assistant', {more} UNION ALL SELECT 1L, 2, 'user', null")
    out = format_conversations(df)
    r = out.first()
    assert r.formatted == "<turn user>see <\\part<part image 0></turn>\n<turn assistant><part audio 1><part document 2></turn>\n<turn user></turn>\n"
    assert [(a.number, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 3), (1, "audio", "b.wav", int(1.5 * FRAMES) + 1), (2, "document", "c.pdf", 3 * PAGE)]
    assert r.expanded_tokens == sum(a.tokens for a in r.attachments)
    assert [t.text for t in read_back(out).first().turns] == ["see <part<part image 0>", "<part audio 1><part document 2>", ""]
    assert r.formatted[r.loss_spans[0].start : r.loss_spans[0].end] == "<part audio 1><part document 2>"


def test_no_python_in_the_plan(spark):
    df = turns_of(spark, [(1, 0, "user", "x")]).select("*").withColumn("turn", F.col("turn") + 1)
    plan = digest(format_conversations(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark, sf_dir):
    got = QUERIES["op10_typed_content_parts"](spark, sf_dir(conversations=turns_of(spark, []))).collect()
    assert [r.conv_id for r in got] == [-7]

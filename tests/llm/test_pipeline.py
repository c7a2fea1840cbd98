import importlib.util
from types import SimpleNamespace

import pytest

import corpus_pipeline as cp
from facetmill.llm.shared import shared_folder, step_of

from .test_neardup import brute_force


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_take_effect_and_keep_columns(spark, sf_dir):
    words = "alpha beta gamma delta eps zeta eta theta iota kappa lambda mu nu xi omicron pi".split()
    rows = [(i, " ".join(words[(i * k) % 16] + str((i * k) % 37) for k in range(1, 40)), "abc"[i % 3]) for i in range(120)]
    rows += [(200 + i, "grobzak lomperd " + t, s) for i, t, s in rows[:15]]
    rows += [(300, rows[5][1], "b"), (301, rows[5][1].upper(), "c"), (302, "write a@b.cd " + rows[7][1][::-1], "a"), (303, None, "a"), (304, "", None)]
    labels = [(i, 1, int("grobzak" in (t or "")), "") for i, t, _ in rows if i % 2 == 0]
    docs = documents(spark, rows)
    path = sf_dir(documents=docs, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int, note string"))
    kept = docs
    for k, (name, stage) in enumerate(cp.STAGES):
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = stage(spark, kept, path).cache()
        after = kept.collect()
        if k < 4:
            assert kept.columns == docs.columns, name
        if name == "toxicity":
            assert not any(200 <= r.doc_id < 220 for r in after) and len(after) >= 0.95 * 125
        elif name == "near_dedup":
            comps = brute_force(list(before.items()), 80)
            assert sorted(r.doc_id for r in after) == sorted(i for i, (_, c) in comps.items() if c == i)
        elif name == "personal_data":
            assert len(after) == len(before) and "[EMAIL]" in next(r.text for r in after if r.doc_id == 302)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
        elif name == "mixing":
            assert {r.doc_id for r in after} <= set(before) and len(after) > 0
        else:
            assert all(r.length <= 1024 for r in after)
    assert cp.run(spark, path).count() > 0 and cp.ORACLE_SQL is None


def test_empty_tables(spark, sf_dir):
    path = sf_dir(documents=documents(spark, []), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert cp.run(spark, path).count() == 0


def test_registered_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
    assert importlib.util.find_spec("corpus_pipeline")


def test_shared_folder():
    """The session's where set; else a temporary one in local sessions, and an error on clusters."""

    def session(folder, master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master, applicationId=f"test-{master}"))

    assert shared_folder(session("hdfs://a/b/", "spark://x")) == "hdfs://a/b"
    own = shared_folder(session(None, "local[2]"))
    assert own.startswith("file:///") and own == shared_folder(session(None, "local[2]"))
    for master in ("spark://x", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError):
            shared_folder(session(None, master))


def test_steps(spark):
    from pyspark.sql import functions as F

    bounds = [3, 5, 5, 9]
    df = spark.range(12).select("id", step_of(bounds, lambda b: F.col("id") < b).alias("k"))
    assert all(r.k == sum(b <= r.id for b in bounds) for r in df.collect())


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    one, two, three = (" ".join(f"{w}{k}" for k in range(30)) for w in ("alpha", "beta", "gamma"))
    rows = [(1, one, "a"), (1, one, "b"), (2, two, "a"), (2, one, "a"), (None, two, "a"), (None, three, "a"), (None, three, "b"), (4, None, "a")]
    got = cp.drop_near_duplicates(spark, documents(spark, rows).repartition(3), "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, one), (2, two), (0, three), (4, "")])


def test_edge_rows_and_clashing_columns_in_every_stage(spark, sf_dir):
    words = [f"word{k}" for k in range(60)]
    rows = [(i, " ".join(words[i % 7 : 40 + i % 13]) + f" own{i} text{i} of{i} number{i} {i}" * 9, "abc"[i % 3]) for i in range(30)]
    rows += [(3, rows[3][1], "a"), (3, rows[3][1], "a"), (4, rows[9][1], None), (None, rows[5][1], "b"), (None, None, None), (77, None, "a"), (78, "", "b"), (79, "long " * 60_000, None)]
    full = [(i, t, "en", s, None if t is None else len(t), 1, 2, 3, "d", 4) for i, t, s in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, row0 int, copies int, label int, draw string, part int").repartition(3)
    path = sf_dir(documents=docs, labels=spark.createDataFrame([(i, 1, i % 2) for i in range(6)], "doc_id long, quality int, toxic int"))
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        before = kept
        kept = stage(spark, kept, path).cache()
        assert kept.columns == docs.columns, name
        if name in ("toxicity", "personal_data"):
            assert kept.count() <= before.count()
        elif name == "near_dedup":
            texts = [r.text for r in kept.collect() if r.text]
            assert len(texts) == len(set(texts)) and any(t.startswith("long long") for t in texts) == any((r.text or "").startswith("long long") for r in before.collect())
    packed = cp.STAGES[-1][1](spark, kept, path).collect()
    assert all(r.length <= 1024 for r in packed) and cp.run(spark, path).count() == len(packed)

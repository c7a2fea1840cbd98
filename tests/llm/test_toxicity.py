import math
import random
import re

import numpy as np

from facetmill.llm.queries import QUERIES
from facetmill.llm.toxicity import OrdinalModel, choose_features, feature_counts, fit_ordinal, labelled, score, train_on, without_rejected

LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n=900, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randrange(2, 8)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(10, 60))]
        toxic = i % 9 == 0
        if toxic:
            for _ in range(rng.choice([1, 2, 6])):
                words.insert(rng.randrange(len(words)), rng.choice(["grobzak", "lomperd", "sukkel"]) + rng.choice(["", "s", "en", "achtig"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic), ""))
    return rows, labels


def test_query_separates_held_out_documents(spark, docs_of, sf_dir):
    rows, labels = corpus()
    path = sf_dir(documents=docs_of(rows), labels=spark.createDataFrame(labels[:600], LABELS))
    got = {r.doc_id: r for r in QUERIES["op2_ordinal_toxicity"](spark, path).collect()}
    assert len(got) == len(rows)
    held = [(got[i].toxic, bool(y)) for i, _, y, _ in labels[600:]]
    assert sum(p and not y for p, y in held) <= 1 and sum(y and not p for p, y in held) <= 2
    assert all(0 <= r.p_toxic <= 1 and r.p_toxic - 1e-9 <= r.severity <= 3 and 0 <= r.grade <= 3 for r in got.values())
    many = np.mean([got[i].severity for i, t in rows if t.count("grobzak") + t.count("lomperd") + t.count("sukkel") > 4])
    few = np.mean([got[i].severity for i, t in rows if t.count("grobzak") + t.count("lomperd") + t.count("sukkel") == 1])
    assert many > few


def test_shared_weights_and_ordered_thresholds():
    rng = np.random.default_rng(0)
    x = rng.random(4000) * 4
    y = np.searchsorted([1.0, 2.0, 3.0], x + 0.05 * rng.standard_normal(4000))
    w, t = fit_ordinal(np.arange(4000), np.zeros(4000, int), x, y, 1)
    assert w[0] > 0 and (np.diff(t) > 0).all() and np.allclose(t / w[0], [1, 2, 3], atol=0.3)


def test_given_grades_are_used(spark, docs_of):
    grades = [0, 0, 0, 1, 2, 2] * 40
    docs = docs_of([(i, "bad " * 2 * g + "plain words here") for i, g in enumerate(grades)])
    labels = spark.createDataFrame([(i, 1, g, "") for i, g in enumerate(grades)], LABELS)
    model = train_on(docs, labels)
    assert len(model.thresholds) == 2
    got = {r.doc_id: r.severity for r in score(docs, model, "doc_id").collect()}
    assert got[0] < got[3] < got[4]


def slow_features(text):
    """Counts of features, word by word."""
    out = {}
    for w in re.findall(r"[^\W_]+", text.lower()):
        for f in [w, *[w[:k] + "~" for k in (4, 5, 6) if len(w) >= k]]:
            out[f] = out.get(f, 0) + 1
    return out


def test_scores_against_plain_computation(spark, docs_of):
    rows, labels = corpus(400)
    rows += [(5000, None), (5001, ""), (5002, "Grobzak! GROBZAK, lomperden " * 400), (3, rows[3][1])]
    docs = docs_of(rows)
    model = train_on(docs, spark.createDataFrame(labels, LABELS))
    got = sorted((r.doc_id, r.p_toxic, r.severity, r.grade, r.rejected) for r in score(docs, model, "doc_id").collect())
    for (i, p, severity, grade, rejected), (j, text) in zip(got, sorted(rows, key=lambda r: r[0])):
        linear = sum(model.weights[model.names[f]] * math.log1p(c) for f, c in slow_features(text or "").items() if f in model.names)
        own = [1 / (1 + math.exp(min(700, t - linear))) for t in model.thresholds]
        assert i == j and abs(p - own[0]) < 1e-9 and abs(severity - sum(own)) < 1e-9
        assert grade == sum(x > 0.5 for x in own) and rejected == (p >= model.cut)


def test_features_are_counted_by_exact_name(spark, docs_of):
    rows, labels = corpus(300)
    train = labelled(docs_of([*rows, (3, "another text of the same id")]), spark.createDataFrame(labels, LABELS), "toxic", 200)
    kept = train.collect()
    assert len(kept) == len({r.doc_id for r in kept}) == 200
    want = {}
    for r in kept:
        for f in slow_features(r.text):
            want.setdefault(f, [0] * 4)[(r.label > 0) + 2 * r.held] += 1
    counts = feature_counts(train)
    assert {r.name: [r.n0, r.n1, r.h0, r.h1] for r in counts.collect()} == want
    names, odds = choose_features(counts, sum(not r.label for r in kept), sum(r.label for r in kept), "nh")
    assert len(names) == len(odds) and all(want[f][1] + want[f][3] >= 4 for f in names)


def test_without_both_kinds_nothing_is_rejected(spark, docs_of):
    docs = docs_of([(1, "x"), (2, None), (None, ""), (3, "long " * 20_000), (1, "x")])
    for labels in ([], [(1, 1, 0, "")], [(1, 1, None, ""), (None, 1, 1, "")]):
        model = train_on(docs, spark.createDataFrame(labels, LABELS))
        got = score(docs, model, "doc_id").collect()
        assert len(got) == 5 and all(not r.rejected and r.severity < 1e-9 for r in got)
        assert without_rejected(docs, model).count() == 5


def test_rejected_rows_go_and_columns_stay(spark, docs_of):
    model = OrdinalModel({"bad": 0}, np.array([9.0]), np.array([1.0, 2.0]), 0.5)
    docs = docs_of([(1, "so bad"), (2, "fine"), (3, None)])
    assert sorted(score(docs.withColumnRenamed("size", "text0"), model, "doc_id", "text0").collect())[0].rejected
    out = without_rejected(docs, model)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 3]


def test_empty_table(spark, docs_of, sf_dir):
    path = sf_dir(documents=docs_of([]), labels=spark.createDataFrame([], LABELS))
    assert QUERIES["op2_ordinal_toxicity"](spark, path).count() == 0

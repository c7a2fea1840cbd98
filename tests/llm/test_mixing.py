import math
import re

import pytest

from facetmill.llm.mixing import copied, mix_sources
from facetmill.llm.queries import QUERIES


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Targets by sharing, stopping at the cap and sharing the excess, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    rest, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        level = {s: rest * weight[s] / total for s in open_}
        above = {s for s in open_ if level[s] > cap * sizes[s]}
        if not above:
            return out | level
        for s in above:
            out[s] = cap * sizes[s]
            rest -= out[s]
        open_ -= above
    return out


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, 9) for i, t, s in rows], "doc_id long, text string, source string, size int, target int").repartition(3)


def corpus(n=1200):
    names = [None, "b", "a", "z", "é", "a2"]
    return [(i, "word " * (1 + (i * 37) % 97), "hot" if i % 3 == 0 else names[i % 6]) for i in range(n)]


def test_query_against_brute_force(spark, sf_dir):
    rows = corpus()
    got = QUERIES["op9_entropy_balancing"](spark, sf_dir(documents=rows_of(spark, rows))).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    sizes = {}
    for i in size:
        sizes[source[i]] = sizes.get(source[i], 0) + size[i]
    targets = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    assert sorted(r.doc_id for r in got) == sorted(size)
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[s] and r.target == pytest.approx(targets[s])
        assert 0 <= r.taken <= 2 * r["size"] and r.taken % max(r["size"], 1) == 0
        taken[s] += r.taken
    largest = max(size.values())
    assert all(abs(taken[s] - targets[s]) <= largest / 2 + 1 for s in sizes), (taken, targets)


def test_rates_solve_the_dual_by_bisection(spark):
    rows = [*corpus(600), (9001, "w " * 3000, "b"), (9002, "w", "tiny"), (9003, "w " * 400, "tiny")]
    by_source = {}
    for r in mix_sources(rows_of(spark, rows)).collect():
        by_source.setdefault(r.source_key, []).append(r)
    for own in by_source.values():
        target, mean = own[0].target, sum(r["size"] for r in own) / len(own)
        if target >= 2 * own[0].source_size:
            assert all(r.rate == 2 for r in own)
            continue
        low, high = -1e4, 1e4
        rates = lambda m: [2 / (1 + math.exp(max(-700, min(700, -m * r["size"] / mean)))) for r in own]  # noqa: B023, E731
        for _ in range(200):
            m = (low + high) / 2
            low, high = (m, high) if sum(x * r["size"] for x, r in zip(rates(m), own)) < target else (low, m)
        assert [r.rate for r in own] == pytest.approx(rates(low), rel=1e-4, abs=1e-6)


def test_repeated_rows_are_dealt_by_count(spark):
    rows = [(i, "word " * (1 + i % 30), "abc"[i % 3]) for i in range(600)] + [(7, "one two three four five", "a")] * 400 + [(8, "x y", "b")] * 300
    got = mix_sources(rows_of(spark, rows)).collect()
    taken, target, largest = {}, {}, 31
    for r in got:
        taken[r.source_key] = taken.get(r.source_key, 0) + r.taken
        target[r.source_key] = r.target
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= largest / 2 + 1 for s in taken), (taken, target)
    again = mix_sources(rows_of(spark, rows[::-1]).repartition(5)).collect()
    count = lambda x: sorted((r.doc_id, r["size"], r.copies) for r in x)
    assert count(got) == count(again)


def test_rates_are_tilted_and_reruns_agree(spark):
    rows = corpus(600)
    a = sorted(mix_sources(rows_of(spark, rows)).collect(), key=lambda r: r.doc_id)
    b = sorted(mix_sources(rows_of(spark, rows[::-1]).repartition(7)).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.copies) for r in a] == [(r.doc_id, r.copies) for r in b]
    down = sorted((r["size"], r.rate) for r in a if r.target < r.source_size)
    by_source = {}
    for r in a:
        by_source.setdefault(r.source_key, []).append((r["size"], r.rate))
    for pairs in by_source.values():  # within a source rates are monotone in size
        rates = [x for _, x in sorted(pairs)]
        assert rates == sorted(rates) or rates == sorted(rates, reverse=True)
    assert down


def test_copies_are_made(spark):
    docs = rows_of(spark, corpus(300))
    mixed = mix_sources(docs)
    out = copied(docs, mixed)
    want = {r.doc_id: r.copies for r in mixed.collect() if r.copies}
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want and out.columns == docs.columns


def test_nulls_empty_texts_and_repeated_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", None), (3, "x y z", "b"), (3, "x y z", "b"), (4, "w " * 5000, "c")]
    docs = rows_of(spark, rows)
    got = mix_sources(docs).collect()
    assert len(got) == 6 and all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert copied(docs, mix_sources(docs)).count() == sum(r.copies for r in got)


def test_empty_table(spark):
    assert mix_sources(rows_of(spark, [])).count() == 0

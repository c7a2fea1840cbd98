import zlib

import pytest

from facetmill.llm.queries import QUERIES
from facetmill.llm.sharding import shard_by_bytes


def check(rows, got, shards):
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(0 <= s < shards for s in slots) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [0] * shards
    for r in got:
        sizes[r.shard] += r.size
    return sizes


@pytest.mark.parametrize("kind", ["different", "copies"])
def test_shards_have_near_equal_bytes(spark, docs_of, sf_dir, kind):
    rows = [(i * 7, f"text {i} " + "y" * (i % 90) if kind == "different" or i % 3 else "the same text") for i in range(4000)]
    got = QUERIES["op6_histogram_sort_shards"](spark, sf_dir(documents=docs_of(rows))).collect()
    sizes = check(rows, got, 40)
    largest = max(r.size for r in got)
    share = sum(sizes) / 40
    assert all(abs(s - share) <= largest + 0.002 * share for s in sizes)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_equal_texts_lie_side_by_side(spark, docs_of):
    rows = [(i, "one of few texts" if i % 50 == 0 else f"text {i}") for i in range(1000)]
    same = sorted((r.shard, r.slot) for r in shard_by_bytes(docs_of(rows), 4).collect() if r.doc_id % 50 == 0)
    assert len({s for s, _ in same}) <= 2 and all(b[1] - a[1] == 1 or a[0] != b[0] for a, b in zip(same, same[1:]))


def test_nulls_negative_ids_long_texts_and_repeated_rows(spark, docs_of):
    rows = [(None, "a"), (-5, None), (1 << 62, ""), (3, "z" * 100_000), (3, "z" * 100_000), (-(1 << 63), "b"), ((1 << 63) - 1, "b")]
    check(rows, shard_by_bytes(docs_of(rows), 3).collect(), 3)


@pytest.mark.parametrize("part_rows", [8_000_000, 30])
def test_rows_that_repeat_text_and_id_are_dealt_by_count(spark, docs_of, part_rows):
    rows = [(i, f"text {i} " + "y" * (i % 60)) for i in range(2800)] + [(9, "the same row again and again")] * 1200
    got = shard_by_bytes(docs_of(rows), 40, part_rows=part_rows).collect()
    sizes = check(rows, got, 40)
    share = sum(sizes) / 40
    assert all(abs(s - share) <= max(r.size for r in got) + 0.002 * share for s in sizes)


def test_all_rows_alike(spark, docs_of):
    assert sorted(check([(1, "x")] * 100, shard_by_bytes(docs_of([(1, "x")] * 100), 5).collect(), 5)) == [340] * 5


def test_few_rows_and_empty_table(spark, docs_of):
    check([(1, "x")], shard_by_bytes(docs_of([(1, "x")]), 40).collect(), 40)
    assert shard_by_bytes(docs_of([]), 40).count() == 0


def test_reruns_agree_whatever_the_partitions(spark, docs_of):
    rows = [(i, f"t{i % 17}") for i in range(500)]
    a = shard_by_bytes(docs_of(rows), 7).collect()
    b = shard_by_bytes(docs_of(rows[::-1]).repartition(11), 7).collect()
    assert sorted(a) == sorted(b)

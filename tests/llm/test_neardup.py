import random
import re

import numpy as np
import pyarrow as pa
import pytest

from facetmill.llm import neardup
from facetmill.llm.neardup import near_duplicates
from facetmill.llm.queries import QUERIES
from facetmill.llm.shingles import band_keys, sets, sketches

LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_rows(rows, percent):
    """Sorted (doc_id, n_shingles, component) of all rows, of which several may have one doc_id, from all pairs."""
    found = [(i, shingle_set(t)) for i, t in rows]
    comp = {i: i for i, _ in found if i is not None}
    for a, x in found:
        for b, y in found:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = {k: new if v == old else v for k, v in comp.items()}
    return sorted(((i, len(x), comp.get(i)) for i, x in found), key=str)


def brute_force(rows, percent):
    """Size and component of each document, from all pairs of sets of word tuples."""
    shingles = {i: shingle_set(t) for i, t in rows}
    comp = {i: i for i in shingles}
    ids = sorted(shingles)
    for a in ids:
        for b in ids:
            if a < b and shingles[a] and shingles[b]:
                both = len(shingles[a] & shingles[b])
                if 100 * both >= percent * (len(shingles[a]) + len(shingles[b]) - both):
                    old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                    comp = {k: new if v == old else v for k, v in comp.items()}
    return {i: (len(shingles[i]), comp[i]) for i in ids}


def random_rows(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(50))
    rows, base = [], [word() for _ in range(60)]
    for i in range(40):  # a chain of edits: ends aren't similar, neighbours are
        base = list(base)
        base[rng.randrange(60)] = word()
        rows.append((i, " ".join(base)))
    for i in range(40, 60):
        rows.append((i, " ".join(word() for _ in range(rng.randrange(1, 80)))))
    passage = " ".join(word() for _ in range(30))
    rows += [(i, passage + " " + " ".join(word() for _ in range(rng.randrange(5, 60)))) for i in range(60, 80)]
    rows += [(80, rows[3][1].upper().replace(" ", "\t \n")), (81, "a b"), (82, "A  B"), (83, ""), (84, None), (85, "   \n"), (86, "a b c d e"), (87, "long " * 3000)]
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_components_against_brute_force(spark, docs_of, percent):
    rows = random_rows(percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs_of(rows), percent).collect()}
    assert got == brute_force(rows, percent)


def test_blocks_lose_no_link(spark, docs_of, monkeypatch):
    monkeypatch.setattr(neardup, "_SKETCH_BLOCK", 5)
    monkeypatch.setattr(neardup, "_TEXT_BLOCK", 4)
    rows = random_rows(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs_of(rows), 85).collect()}
    assert got == brute_force(rows, 85)


def test_query_with_repeated_rows_and_null_ids(spark, docs_of, sf_dir):
    rows = [(7, "one two three four five six"), (7, "one two three four five six"), (9, "ONE two three four five six"), (None, "one two three four five six"), (3, None)]
    got = sorted(QUERIES["op4_minhash_near_dedup"](spark, sf_dir(documents=docs_of(rows))).collect(), key=str)
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (3, 3, True), (7, 7, True), (7, 7, True), (9, 7, False)]


def test_rows_of_one_id_with_different_texts(spark, docs_of, monkeypatch):
    a, b, c = (" ".join(f"{w}{k}" for k in range(40)) for w in ("alpha", "beta", "gamma"))
    rows = [(1, a), (5, b), (5, a), (7, b), (9, c), (9, None), (8, c), (11, ""), (None, a), (5, a)]
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs_of(rows), 85).collect()], key=str)
    assert got == brute_rows(rows, 85) and (7, 36, 1) in got and (9, 0, 8) in got
    monkeypatch.setattr(neardup, "_SKETCH_BLOCK", 5)
    monkeypatch.setattr(neardup, "_TEXT_BLOCK", 4)
    rng = random.Random(2)
    rows = [(rng.randrange(50) if i % 9 else None, t) for i, (_, t) in enumerate(random_rows(7) + random_rows(8))]
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs_of(rows), 80).collect()], key=str)
    assert got == brute_rows(rows, 80)


def test_empty_table(spark, docs_of, sf_dir):
    assert QUERIES["op4_minhash_near_dedup"](spark, sf_dir(documents=docs_of([]))).count() == 0


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(0)
    common, own = rng.integers(0, 1 << 62, 800).astype(np.uint64), rng.integers(0, 1 << 62, (2, 100)).astype(np.uint64)
    groups = [np.concatenate([common, own[0]]), np.concatenate([common, own[1]]), common[:1], common[:3]]
    made = sketches(groups, 256)
    assert (made != np.iinfo(np.uint64).max).all()
    assert abs((made[0] == made[1]).mean() - 0.8) < 0.1
    assert (band_keys(made[:1], 6) == band_keys(sketches(groups[:1], 256), 6)).all() and band_keys(made, 6).shape == (4, 42)


def test_sets_are_the_shingles_of_whole_texts():
    texts = ["a b c d e f", "A B\tC  d e\nf", "x", None, "a b c d e a b c d e f"]
    (_, got), = sets(pa.array(texts), 5)
    assert [len(g) for g in got] == [2, 2, 1, 0, 6] and (got[0] == got[1]).all() and np.isin(got[0], got[4]).all()

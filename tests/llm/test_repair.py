import zlib

import numpy as np
import pytest

from facetmill.llm.pieces import PieceEncoder
from facetmill.llm.queries import QUERIES, vocabulary
from facetmill.llm.repair import Block, pack_block, read_ids, write_ids


def _block(docs, first=49_408):
    ids = np.array([x for d in docs for x in d], np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    return pack_block(list(range(len(docs))), ids, bounds, 1, first)


@pytest.mark.parametrize("first", [200, 70_000])
def test_blocks_round_trip_and_give_random_access(first):
    rng = np.random.default_rng(3)
    docs = [[*rng.integers(2, 12, int(rng.integers(0, 400))).tolist(), 1] for _ in range(60)] + [[5] * 301 + [1], [1], [1, 1, 1]]
    raw = _block(docs, first)
    block = Block.read(raw)
    assert len(block.rules) and len(block.symbols) < sum(map(len, docs))
    assert block.ids().tolist() == [x for d in docs for x in d]
    assert block.counts().tolist() == [len(d) for d in docs]
    for i, d in enumerate(docs):
        assert block.document(i).tolist() == d
        for a, b in ((0, 1), (3, 9), (len(d) - 2, len(d)), (5, 5), (2, 10_000)):
            assert block.document(i, max(a, 0), b).tolist() == d[max(a, 0) : b]


def test_frequent_pairs_shrink_the_symbols():
    raw = _block([[7, 8] * 500 + [1]] * 4)
    assert len(Block.read(raw).symbols) < 4 * 1001 / 8


@pytest.mark.parametrize("first", [300, 70_000])
def test_rounds_go_on_until_no_pair_is_frequent(first):
    rng = np.random.default_rng(5)
    phrases = [rng.integers(2, 290, 9).tolist() for _ in range(30)]
    docs = [[x for k in rng.integers(0, 30, 40) for x in phrases[k]] + [1] for _ in range(50)]
    block = Block.read(_block(docs, first))
    left = {}
    for a, b in zip(block.starts[:-1].tolist(), block.starts[1:].tolist()):
        own = block.symbols[a:b].tolist()
        at = 0
        while at < len(own) - 1:
            left[own[at], own[at + 1]] = left.get((own[at], own[at + 1]), 0) + 1
            at += 1 + (own[at] == own[at + 1])
    assert max(left.values()) <= 5 and int(block.lengths.max()) >= 18
    assert block.ids().tolist() == [x for d in docs for x in d]


def test_rejects_other_bytes():
    with pytest.raises(ValueError):
        Block.read(b"\0" * 100)


def test_query_against_brute_force(spark, docs_of, sf_dir):
    texts = {5: "One two, three. FOUR", 1: None, 9: "", 2: '" quotes " have id 1 "', 7: "word, " * 4000, 3: "Ünï\ncödé"}
    path = sf_dir(documents=docs_of(list(texts.items())))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op8_repair_token_files"](spark, path).collect()}
    enc, at, want = PieceEncoder(vocabulary("word_bpe_49k.json"), False).tokenizer, 0, {}
    for i in sorted(texts):
        ids = np.array([*enc.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert got == want


def test_small_blocks_null_ids_and_repeated_rows(spark, docs_of):
    rows = [(None, "null id"), (4, "same"), (4, "same"), (4, "other"), (8, "x " * 50)]
    blocks = write_ids(docs_of(rows), vocabulary("word_bpe_49k.json"), False, 1, 49_408, block_ids=4)
    assert blocks.count() > 1
    got = sorted((r.start, r.n_tokens) for r in read_ids(blocks).collect())
    assert len(got) == 5 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:]))


def test_empty_table(spark, docs_of, sf_dir):
    assert QUERIES["op8_repair_token_files"](spark, sf_dir(documents=docs_of([]))).count() == 0

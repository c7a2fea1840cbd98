import hashlib
import re
import time

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facetmill.llm import pii
from facetmill.llm.queries import QUERIES

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_force(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in PATTERNS[kind].finditer(text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and _luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, (kind, *m.span())))
    return [s for *_, s in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab.@_-+%1234567890 ()é\n"), max_size=60))
def test_base_spans_against_plain_patterns(text):
    assert pii.base_spans(text) == brute_force(text)


@pytest.mark.parametrize("text", ["x@a.b_c@d.e", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (555) 555-1234 and +44", "a@@b.c", "256.1.1.1", "0001.2.3.4", "9" * 40])
def test_base_spans_of_edge_cases(text):
    assert pii.base_spans(text) == brute_force(text)


@pytest.mark.parametrize("text", ["a" * 200_000 + "@", "9" * 200_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "a.b at " * 30_000, "(1) " * 50_000, "a at b" + ".c" * 100_000, "a at b dot com " * 20_000, "a" * 100_000 + " at " + "b" * 100_000])
def test_time_is_linear(text):
    began = time.time()
    pii.base_spans(text)
    pii.candidates(text)
    assert time.time() - began < 8


@pytest.fixture(scope="module")
def models():
    return pii.train()


def test_held_out_accuracy(models):
    import numpy as np

    counts = {k: [0, 0, 0] for k in pii.KINDS}
    for text, span, label in pii._examples(999, 4000):
        chosen = models[span[0]].score(np.array([pii.features(text, span)], float))[0] >= models[span[0]].threshold
        right, wrong, missed = bool(chosen and label), bool(chosen and not label), bool(label and not chosen)
        counts[span[0]] = [a + b for a, b in zip(counts[span[0]], (right, wrong, missed))]
    for kind, (right, wrong, missed) in counts.items():
        assert right / (right + wrong) > 0.94 and right / (right + missed) > 0.8, (kind, right, wrong, missed)


def test_candidates_join_base_spans(models):
    text = "write to jan.kok (at) mail (dot) org or real@x.org, call (555) 555-1234; version 10.20.30.40"
    base = pii.base_spans(text)
    spans = pii.all_spans(text, base, models)
    assert set(base) <= set(spans)
    assert any(k == "email" and "(at)" in text[a:b] for k, a, b in spans)
    assert any(k == "phone" and text[a:b] == "(555) 555-1234" for k, a, b in spans)
    assert all(x[2] <= y[1] for x, y in zip(spans, spans[1:]) if x not in base or y not in base)
    assert pii.redacted(text, spans).count("[EMAIL]") == 2


def test_clean_prose_has_no_spans(models):
    for text in ("The meeting at noon ended at 12. Of 3 rooms, 2 were free in 2019.", "at. dot. a at b", ""):
        assert pii.all_spans(text, pii.base_spans(text), models) == []


def test_query(spark, docs_of, sf_dir):
    texts = {1: None, 2: "", 3: "ünï a@b.cd x 10.0.0.1 +1 (555) 555-1234 and 4111111111111111", 4: "plain prose", 5: "x " * 20_000 + "a@b.cd"}
    rows = [*texts.items(), (3, texts[3]), (None, "a@b.cd")]
    got = QUERIES["op5_personal_data"](spark, sf_dir(documents=docs_of(rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in texts:
            spans = brute_force(texts[r.doc_id] or "")
            line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in pii.KINDS)
            assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and r.spans == line


def test_the_method_finds_what_run_together_patterns_miss(models):
    text = "x +1 (555) 555-1234 4111111111111111 y"
    assert pii.base_spans(text) == brute_force(text) == []
    assert {k for k, *_ in pii.all_spans(text, [], models)} == {"phone", "card"}


def test_redaction_keeps_columns(spark, docs_of, models):
    docs = docs_of([(1, "mail a@b.cd now"), (2, None), (3, "none")])
    out = pii.redact(docs, models)
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()} == {1: "mail [EMAIL] now", 2: None, 3: "none"}


def test_empty_table(spark, docs_of, sf_dir):
    assert QUERIES["op5_personal_data"](spark, sf_dir(documents=docs_of([]))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["john", "a.b", "x", " ", "\n", "\xa0", "\u2003", "\x1c", "at", "AT", "@", "(", ")", "[", "{", "}", "dot", ".", "com", "org", "1", "555", "0123456789", "-", "+", "٣", "é", "/"]), max_size=24))
def test_the_prefilter_changes_nothing(models, parts):
    text = "".join(parts)
    (_, base, spans), = pii._by_text(pa.array([text]), models)
    assert base == pii.base_spans(text) and spans == pii.all_spans(text, base, models)


def test_long_addresses_and_those_before_a_sentence_are_proposed(models):
    long = "a" * 80 + ".b at " + " dot ".join(["c"] * 7) + " dot com"
    assert ("email", 0, len(long)) in pii.candidates(long)
    text = "write to jan.kok at mail dot org. Then wait. Or call"
    assert [text[a:b] for _, a, b in pii.all_spans(text, [], models)] == ["jan.kok at mail dot org"]


def test_prefilter_lets_all_candidates_through():
    spaces = [c for c in map(chr, range(0x110000)) if c.isspace()]
    texts = [f"write to john{s}at{s}example dot com" for s in spaces] + [f"john{s}AT example dot com" for s in spaces]
    texts += ["john(at)example dot com", "john [\nat\n] example dot com", "\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669\u0660"]
    assert all(pii.candidates(t) for t in texts)
    assert pc.match_substring_regex(pa.array(texts), pii._ANY).to_pylist() == [True] * len(texts)
    assert not pc.match_substring_regex(pa.array(["what a date", "at home"]), pii._ANY).to_pylist()[0]

"""Personal data: rule matches, and candidates that gradient boosting selects.

Base matches (email, ip, card, phone: fixed patterns with fixed checks) always count. High-recall
generators propose further, overlapping spans: spelled-out or spaced email addresses, number groups
without a plus sign, dotted quads. Boosted trees score each from its format and its context; a
kind's threshold is the lowest calibrated score that keeps precision on held-out examples. Selected
spans join the base ones where they overlap none, better scores first.

The trees are trained on the driver from a generator of labelled examples with a fixed seed, so the
model is the same in every run and needs nothing from the corpus.

Edge cases: null text is empty text and has no spans; repeated rows have equal results; an empty
table gives an empty table; other columns are kept by ``redact`` and ignored by ``find``. Patterns
run in time linear in the text, also over long runs of digits or letters.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .worker import lean

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# A match can begin inside a run of its first class only where the last match ended, so scans begin
# at the start of runs and, after a match, at its end.
_EMAIL_BODY = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_EMAIL_HERE, _EMAIL = re.compile(_EMAIL_BODY), re.compile(rf"(?<![A-Za-z0-9._%+-]){_EMAIL_BODY}")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while True:
        m = (_EMAIL_HERE.match(text, at) if at else None) or _EMAIL.search(text, at)
        if not m:
            return
        yield m.span()
        at = m.end()


def base_spans(text: str) -> list[Span]:
    """Rule matches by start, then kind."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# Candidates -----------------------------------------------------------------------------------

_AT, _DOT = r"(?:\s?@\s?|\s?[(\[{]\s?at\s?[)\]}]\s?|\sat\s)", r"(?:\s?\.\s?|\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s)"
_GENERATORS = (
    ("email", re.compile(rf"(?<![\w.%+-])[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+{_AT}(?P<domain>[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+)", re.I)),
    ("phone", re.compile(r"(?<![\w.+-])(?:\(\d{2,5}\)|00\d{1,3}|\d{2,5})(?:[\x20./-]{1,2}\d{2,5}){1,5}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.+-])\d{10,11}(?![\w-])")),
    ("card", re.compile(r"(?<![\w.-])\d{4}(?:[\x20.\-/]{1,2}\d{3,6}){2,4}(?![\w-])")),
    ("card", re.compile(r"(?<![\w.-])\d{13,19}(?![\w-])")),
    ("ip", re.compile(r"(?<![\w.-])\d{1,3}(?:\x20?\.\x20?\d{1,3}){3}(?![\w-])")),
)
#: What Python's \s takes, for RE2.
_SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
#: Needed for any candidate: a digit, or a spelled-out or written at sign, as wide as the generators have it.
_ANY = rf"[\p{{Nd}}@]|[{_SPACE}(\[{{][aA][tT][{_SPACE})\]}}]"
_HINTS = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|reach|address)\W*$", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|cell|mobile|fax|contact|number|ring)\b\W*(?:\w+\W+){0,2}$", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|account|pan)\b\W*(?:\w+\W+){0,2}$", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|ping|client|from)\b\W*(?:\w+\W+){0,1}$", re.I),
}
_AGAINST = re.compile(r"(?:\b(?:version|release|order|invoice|isbn|page|chapter|section|year|room|total|price|serial|part|item|build|ticket|ref|id|lot|code)\b\W*(?:\w+\W+){0,1}|[#$€£=/])$", re.I)
_DATE = re.compile(r"^(?:\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./]\d{2,4})")
_TLDS = {"com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "us"}
#: Where a spelled-out domain may end although what follows looks like more of it.
_TLD_END = re.compile(rf"{_DOT}(?:{'|'.join(sorted(_TLDS))})(?![A-Za-z0-9-])", re.I)


def candidates(text: str) -> list[Span]:
    """Spans of all generators; they may overlap."""
    out: list[Span] = []
    for kind, pattern in _GENERATORS:
        for m in pattern.finditer(text):
            out.append((kind, *m.span()))
            if kind == "email" and (end := _TLD_END.search(text, m.start("domain"), m.end())) and end.end() < m.end():
                out.append((kind, m.start(), end.end()))
    return out


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    kind, a, b = span
    body, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 3]
    digits = _NOT_DIGIT.sub("", body)
    groups = [len(x) for x in re.findall(r"\d+", body)]
    words = re.findall(r"[A-Za-z]+", body)
    return [
        len(digits),
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        len(set(re.findall(r"[^0-9A-Za-z]", body))),
        float(luhn(digits)) if digits else 0.0,
        float(body[0] in "(") + 2.0 * body.startswith("00"),
        float(int(digits[0])) if digits else -1.0,
        float(bool(_HINTS[kind].search(before))),
        float(bool(_AGAINST.search(before))),
        float(bool(_DATE.match(body))),
        float(all(x <= 255 for x in map(int, re.findall(r"\d{1,3}", body)))),
        float(bool(words) and words[-1].lower() in _TLDS),
        float("@" in body) + 2.0 * bool(re.search(r"[(\[{]\s?at", body, re.I)),
        float(bool(re.search(r"[(\[{]\s?dot|\sdot\s", body, re.I))) + 2.0 * ("." in body),
        float(after[:1] in "%°€$£"),
        len(body),
    ]


# Boosted trees --------------------------------------------------------------------------------


@dataclass
class Boosted:
    """Trees of depth 3 in heap order: feature, threshold and value arrays, a row for each tree."""

    bias: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    threshold: float = 1.0
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        at = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(3):
                node = 2 * node + 1 + (x[at, f[node]] > c[node])
            out += v[node - 7]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -500, 500)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, rate: float = 0.3, penalty: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss; splits by exact gain over all distinct values."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))), *(np.zeros((0, n), t) for n, t in ((7, np.int64), (7, float), (8, float))))
    raw = np.full(len(y), model.bias)
    order = np.argsort(x, axis=0, kind="stable")
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, cut, value = np.zeros(7, np.int64), np.full(7, np.inf), np.zeros(8)
        node = np.zeros(len(y), np.int64)
        for k in range(7):
            own = node == k
            if own.sum() > 1:
                best = 1e-6
                for f in range(x.shape[1]):
                    rows = order[:, f][own[order[:, f]]]
                    xs, gs, hs = x[rows, f], np.cumsum(g[rows]), np.cumsum(h[rows])
                    edge = np.flatnonzero(xs[1:] > xs[:-1])
                    if len(edge):
                        gl, hl = gs[edge], hs[edge]
                        gain = gl**2 / (hl + penalty) + (gs[-1] - gl) ** 2 / (hs[-1] - hl + penalty) - gs[-1] ** 2 / (hs[-1] + penalty)
                        i = int(gain.argmax())
                        if gain[i] > best:
                            best, feature[k], cut[k] = gain[i], f, (xs[edge[i]] + xs[edge[i] + 1]) / 2
            node = np.where(own, 2 * k + 1 + (x[:, feature[k]] > cut[k]), node)
        for leaf in range(8):
            own = node == 7 + leaf
            value[leaf] = -rate * g[own].sum() / (h[own].sum() + penalty)
        raw = raw + value[node - 7]
        model.feature, model.cut, model.value = np.vstack([model.feature, feature]), np.vstack([model.cut, cut]), np.vstack([model.value, value])
    return model


def _examples(seed: int, n: int) -> list[tuple[str, Span, int]]:
    """Labelled candidates in short invented contexts: personal data in loose formats, and look-alikes."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(str(int(d)) for d in rng.integers(0, 10, k))
    word = lambda: "".join(pick("abcdefghilmnoprstu") for _ in range(int(rng.integers(3, 9))))

    def card(valid: bool) -> str:
        body = pick("3456") + num(14)
        ends = [d for d in "0123456789" if luhn(body + d) == valid]
        return body + pick(ends)

    def spaced(x: str) -> str:
        sep = pick([" ", "-", ".", "  ", "/"])
        return sep.join(x[i : i + 4] for i in range(0, len(x), 4))

    def phone() -> str:
        a, b, c = str(int(rng.integers(2, 10))) + num(2), num(3), num(4)
        return pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}{b}{c}", f"00{num(2)} {a} {b} {c}", f"({a}) {b} {c}"])

    good = {
        "email": lambda: word() + pick([" at ", " (at) ", " [at] ", "(at)", " @ "]) + word() + pick([" dot ", " (dot) ", ".", " . "]) + pick(sorted(_TLDS)),
        "phone": phone,
        "card": lambda: spaced(card(True)) if rng.random() < 0.7 else card(True),
        "ip": lambda: " . ".join(str(int(x)) for x in rng.integers(0, 256, 4)),
    }
    bad = {
        "email": lambda: f"{word()} at {word()}{pick(['. ', ' . ', '.'])}{word()}",
        "phone": lambda: pick([f"{int(rng.integers(1900, 2100))}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(3)} {num(3)}", f"{num(2)}/{num(2)}/{num(4)}", num(10), f"{num(4)}-{num(4)}", " ".join(num(2) for _ in range(4)), f"978-{num(1)}-{num(4)}-{num(4)}"]),
        "card": lambda: pick([card(False), spaced(card(False)), num(13), num(19)]),
        "ip": lambda: pick([".".join(num(int(rng.integers(1, 4))) for _ in range(4)), " . ".join(str(int(x)) for x in rng.integers(256, 999, 4))]),
    }
    hint = {"email": ["email", "mail", "write to", "contact"], "phone": ["phone:", "call", "tel.", "mobile"], "card": ["card", "credit card", "visa", "account"], "ip": ["ip", "host", "server", "from"]}
    against = ["version", "order", "invoice", "isbn", "page", "serial", "total", "ref", "build", "#", "item"]
    out = []
    for i in range(n):
        kind, label = KINDS[i % 4], int(rng.random() < 0.5)
        body = (good if label else bad)[kind]()
        # Bare number groups don't tell phones from other numbers: there the context decides.
        loose = kind == "phone" and body.isdigit()
        lead = pick(hint[kind]) if label and (loose or rng.random() < 0.5) else pick(against) if not label and (loose or rng.random() < 0.5) else word()
        before = f"{word()} {word()} {lead} "
        text = f"{before}{body}{pick([' ', ' ', ' ', '. '])}{word()} {word()}"
        for span in candidates(text):
            if span[0] == kind and span[1] < len(before) + len(body) and span[2] > len(before):
                whole = span[1] == len(before) and span[2] == len(before) + len(body)
                out.append((text, span, int(bool(label) and whole)))
    return out


def train(seed: int = 17, n: int = 4000, precision: float = 0.98) -> dict[str, Boosted]:
    """A model for each kind: trees from half of the examples, calibration and threshold from the rest."""
    examples = _examples(seed, n)
    out = {}
    for kind in KINDS:
        own = [(features(t, s), y) for t, s, y in examples if s[0] == kind]
        x, y = np.array([f for f, _ in own], float), np.array([v for _, v in own], float)
        fit = np.arange(len(y)) % 2 == 0
        model = boost(x[fit], y[fit])
        raw, held = model.raw(x[~fit]), y[~fit]
        for _ in range(200):  # Platt's two parameters
            p = 1 / (1 + np.exp(-np.clip(model.slope * raw + model.shift, -500, 500)))
            h = p * (1 - p) + 1e-9
            g = np.array([((p - held) * raw).sum() + 1e-3 * model.slope, (p - held).sum()])
            hess = np.array([[(h * raw * raw).sum() + 1e-3, (h * raw).sum()], [(h * raw).sum(), h.sum()]])
            step = np.linalg.solve(hess + 1e-6 * np.eye(2), g)
            model.slope, model.shift = model.slope - 0.5 * step[0], model.shift - 0.5 * step[1]
        score = model.score(x[~fit])
        order = np.argsort(-score, kind="stable")
        right = np.cumsum(held[order]) / np.arange(1, len(order) + 1)
        ok = np.flatnonzero(right >= precision)
        model.threshold = max(0.8, float(score[order][ok[-1]])) if len(ok) else 1.1
        out[kind] = model
    return out


# Application ----------------------------------------------------------------------------------


def all_spans(text: str, base: list[Span], models: dict[str, Boosted]) -> list[Span]:
    """Base spans and the selected candidates that overlap neither them nor better candidates."""
    found = candidates(text)
    if not found:
        return base
    chosen = []
    for kind in KINDS:
        own = [s for s in found if s[0] == kind]
        if own:
            score = models[kind].score(np.array([features(text, s) for s in own], float))
            chosen += [(-p, s[1], KINDS.index(kind), s) for p, s in zip(score.tolist(), own) if p >= models[kind].threshold]
    taken = list(base)
    for *_, span in sorted(chosen):
        if all(span[2] <= a or b <= span[1] for _, a, b in taken):
            taken.append(span)
    return sorted(taken, key=lambda s: (s[1], KINDS.index(s[0])))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _by_text(texts: pa.Array, models: dict[str, Boosted]) -> Iterator[tuple[str, list[Span], list[Span]]]:
    """Text, base spans and all spans; texts that can't have any are not looked into."""
    may = pc.fill_null(pc.match_substring_regex(texts, _ANY), False).to_pylist()
    for i, yes in enumerate(may):
        if yes:
            text = texts[i].as_py()
            base = base_spans(text)
            yield text, base, all_spans(text, base, models)
        else:
            yield "", [], []


def find(docs: DataFrame, models: dict[str, Boosted]) -> DataFrame:
    """doc_id, numbers of base matches by kind, the digest of base spans, and all spans."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)) for _, base, spans in _by_text(batch.column(1), models)]
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), schema)


def redacted(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in brackets; of overlapping ones the first."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, models: dict[str, Boosted], text_col: str = "text") -> DataFrame:
    """``docs`` with spans of the text redacted; null stays null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            new = [redacted(text, spans) if spans else None for text, _, spans in _by_text(texts, models)]
            fixed = pc.coalesce(pa.array(new, texts.type), texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], fixed, *batch.columns[at + 1 :]], names=batch.schema.names)

    return docs.mapInArrow(lean(run), docs.schema)

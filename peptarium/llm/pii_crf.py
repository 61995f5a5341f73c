"""Personal data with a skip-chain conditional random field.

Base spans come from fixed patterns. The field adds to them: its nodes are the tokens of a text that hold a
digit or ``@`` (all others are observed as ``other``, which cuts the chain exactly), labelled ``other`` or one of
the four kinds. Neighbouring nodes share a chain potential. Tokens that are alike however far apart (same
letters and digits once case and punctuation are dropped, or the local part of an address) share a skip
potential: each occurrence is linked with the one before and the first, so edges grow with tokens, not pairs. Nodes inside base
spans are clamped to their kind; loopy sum-product passes the rest to a fixed number of rounds, and a node
whose best kind has at least ``CONFIDENCE`` becomes a span, joined with its neighbour if both have one kind.

Node and chain weights are fitted to the base labels of the whole corpus by pseudo-likelihood. All features are
small classes, so the corpus is first counted per feature pattern, at most a few thousand rows, and the fit
runs on the counts. The skip weight is the log odds with which alike tokens agree.

Limits of the model, not of the search: tokens are alike from ``MIN_ALIKE`` letters and digits on, and spans
that the field adds are joined up to ``MOST_DIGITS`` digits, the longest card. Base spans know no such limits.

Defined cases: null and empty texts have no spans; a null doc_id comes back as null; repeated rows are judged
one by one; with no base span in the corpus nothing is added.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptarium.llm.common import slices

# fixed values: the patterns of the contract, in its order
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}

LABELS = ("other", *KINDS)
EVIDENCE = re.compile(r"[@0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
#: the same matches as the pattern, without trying again inside a run of digits that has failed
_IP_SCAN = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
EDGE_PUNCTUATION = " \t\n\x0b\x0c\r,;:!?\"'<>[]{}|*#$%&=~`"
ROUNDS = 12
CONFIDENCE = 0.8
L2 = 2.0
STEPS = 300
MOST_DIGITS = 19  # of one joined span
MIN_ALIKE = 5
MOST_ALIKE = 6.0  # upper end of the skip weight


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _valid(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    digits = "".join(c for c in text if "0" <= c <= "9")
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


_NEEDS = {"email": "@", "ip": ".", "phone": "+", "card": ""}
_EMAIL_LEFT = re.compile(r"[A-Za-z0-9._%+-]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, tried only around each ``@``: every match has one after its first run."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _EMAIL_LEFT.match(text[start - 1]):
            start -= 1
        found = PATTERNS["email"].match(text, start) if start < at else None
        if found:
            yield found.span()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number), by start, then kind."""
    if not EVIDENCE.search(text):
        return []
    spans = []
    for k, kind in enumerate(KINDS):
        if kind == "email":
            spans += [(a, b, k) for a, b in _emails(text)]
        elif _NEEDS[kind] in text:
            scan = _IP_SCAN if kind == "ip" else PATTERNS[kind]
            spans += [(m.start(), m.end(), k) for m in scan.finditer(text) if _valid(kind, m[0])]
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


def shape(token: str) -> str:
    """A coarse class of a token."""
    if "@" in token:
        head, _, tail = token.rpartition("@")
        return "at-name" if head and "." in tail.strip(".") else "at"
    digits = sum("0" <= c <= "9" for c in token)
    letters = any(c.isalpha() for c in token)
    if letters:
        return "mixed-long" if len(token) >= 24 else "mixed"
    size = "1-3" if digits < 4 else "4-6" if digits < 7 else "7-11" if digits < 12 else "12-19" if digits < 20 else "20-"
    form = "+" if token.startswith("+") else "(" if "(" in token or ")" in token else "." if "." in token else "-" if "-" in token else "d"
    if form == "." and token.count(".") == 3:
        form = "ip" if _valid("ip", token) else "ip-off"
    if digits in range(12, 20) and form in "d-":
        form += "-luhn" if luhn("".join(c for c in token if "0" <= c <= "9")) else "-off"
    return f"{form}{size}"


def _cue(text: str, start: int) -> str:
    """The class of what stands right before a token."""
    before = text[max(0, start - 24) : start].rstrip()
    last = re.search(r"(\w+)\W*$", before)
    return "none" if not before else "digit" if before[-1].isdigit() else "sign" if not before[-1].isalnum() and before[-1] not in ".,;)" else "word" if last else "none"


@dataclass
class Graph:
    """Nodes and edges of one text: spans, feature pattern, base label or -1, chain and skip edges."""

    spans: list[tuple[int, int]]
    patterns: list[tuple[str, str]]
    base: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def graph(text: str, spans: list[tuple[int, int, int]]) -> Graph:
    out = Graph([], [], [], [], [])
    by_kind = sorted(spans)
    alike: dict[str, tuple[int, int]] = {}  # first and last node of a name
    end_before, j = -1, 0
    for m in TOKEN.finditer(text):
        if not EVIDENCE.search(m[0]):
            continue
        token = m[0].strip(EDGE_PUNCTUATION).rstrip(".")
        start = m.start() + m[0].find(token) if token else m.start()
        if not EVIDENCE.search(token):
            continue
        n = len(out.spans)
        out.spans.append((start, start + len(token)))
        out.patterns.append((shape(token), _cue(text, start)))
        while j < len(by_kind) and by_kind[j][1] <= start:
            j += 1
        hit = next((s for s in by_kind[j : j + 4] if s[0] < start + len(token) and s[1] > start), None)
        out.base.append(hit[2] + 1 if hit else -1)
        if end_before >= 0 and not text[end_before : m.start()].strip(" \t\n\x0b\x0c\r"):
            out.chain.append((n - 1, n))
        end_before = m.end()
        names = {re.sub(r"[\W_]+", "", token).casefold()}
        if "@" in token:
            names.add(re.sub(r"[\W_]+", "", token.partition("@")[0]).casefold())
        for name in sorted(names):
            if len(name) >= MIN_ALIKE:
                earlier = alike.get(name, ())
                out.skip += [(a, n) for a in sorted(set(earlier) - {n})]
                alike[name] = (earlier[0] if earlier else n, n)
    return out


@dataclass
class Field:
    node: dict[tuple[str, str], np.ndarray]
    chain: np.ndarray
    skip: float


def count_patterns(docs: DataFrame) -> DataFrame:
    """Corpus counts of (shape, cue, label, label before, label after) and of agreeing alike pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for piece in slices(batches):
            for text in piece.column(0).to_pylist():
                if not EVIDENCE.search(text):
                    continue
                g = graph(text, base_spans(text))
                label = [max(0, b) for b in g.base]
                before, after = defaultdict(lambda: -1), defaultdict(lambda: -1)
                for a, b in g.chain:
                    before[b], after[a] = label[a], label[b]
                for n, (s, c) in enumerate(g.patterns):
                    seen[s, c, label[n], before[n], after[n]] += 1
                for a, b in g.skip:
                    if label[a] or label[b]:
                        seen["alike", "", int(label[a] == label[b]), -1, -1] += 1
        columns = list(zip(*seen, strict=True)) or [()] * 5
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), pa.array(list(seen.values()), pa.int64())], ["shape", "cue", "label", "before", "after", "n"])

    source = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    counted = source.mapInArrow(run, "shape string, cue string, label int, before int, after int, n bigint")
    return counted.groupBy("shape", "cue", "label", "before", "after").agg(F.sum("n").alias("n"))


def fit(counts: list[tuple[str, str, int, int, int, int]]) -> Field:
    """Maximum pseudo-likelihood of node and chain weights, by gradient steps on the counted patterns."""
    agree = {row[2]: row[5] for row in counts if row[0] == "alike"}
    rows = sorted(row for row in counts if row[0] != "alike")
    if not rows:
        return Field({}, np.zeros((len(LABELS), len(LABELS))), 0.0)
    features = sorted({("shape", r[0]) for r in rows} | {("cue", r[1]) for r in rows})
    place = {f: i for i, f in enumerate(features)}
    shape_of = np.array([place["shape", r[0]] for r in rows])
    cue_of = np.array([place["cue", r[1]] for r in rows])
    label, before, after, n = (np.array([r[k] for r in rows]) for k in (2, 3, 4, 5))
    share = n / n.sum()
    size = len(LABELS)
    w, t = np.zeros((len(features), size)), np.zeros((size, size))
    has_b, has_a = before >= 0, after >= 0
    rate = np.full(len(features), 1e-12)
    np.add.at(rate, shape_of, share)
    np.add.at(rate, cue_of, share)
    truth = np.eye(size)[label]
    lam = L2 / n.sum()
    for _ in range(STEPS):
        score = w[shape_of] + w[cue_of]
        score[has_b] += t[before[has_b]]
        score[has_a] += t[:, after[has_a]].T
        p = np.exp(score - score.max(1, keepdims=True))
        miss = (truth - p / p.sum(1, keepdims=True)) * share[:, None]
        dw, dt = np.zeros_like(w), np.zeros_like(t)
        np.add.at(dw, shape_of, miss)
        np.add.at(dw, cue_of, miss)
        np.add.at(dt, before[has_b], miss[has_b])
        np.add.at(dt.T, after[has_a], miss[has_a])
        w += (dw - lam * w) / (rate[:, None] + lam)
        t += 0.5 * (dt - lam * t) / (max(share[has_b].sum() + share[has_a].sum(), 1e-12) + lam)
    node = {(s, c): w[place["shape", s]] + w[place["cue", c]] for s in {r[0] for r in rows} for c in {r[1] for r in rows}}
    node = {k: v - v.max() for k, v in node.items()}
    odds = np.log((agree.get(1, 0) + 1) / (agree.get(0, 0) + 1)) if agree.get(1) else 0.0
    return Field(node, t, float(np.clip(odds, 0, MOST_ALIKE)))


def marginals(graphs: list[Graph], field: Field) -> list[np.ndarray]:
    """Label beliefs of each graph's nodes after loopy sum-product, all graphs in one set of arrays."""
    first = np.cumsum([0, *(len(g.spans) for g in graphs)])
    size = len(LABELS)
    if not first[-1]:
        return [np.zeros((0, size)) for _ in graphs]
    flat = np.zeros(size)
    flat[1:] = -1.0  # a pattern the fit has not met says little; alike tokens decide
    own = np.array([field.node.get(p, flat) for g in graphs for p in g.patterns])
    base = np.array([b for g in graphs for b in g.base])
    fixed = np.flatnonzero(base >= 0)
    own[fixed] = -50.0
    own[fixed, base[fixed]] = 0.0
    edges = [(a + o, b + o, k) for g, o in zip(graphs, first[:-1].tolist(), strict=True) for k, es in ((0, g.chain), (1, g.skip)) for a, b in es]
    if not edges:
        belief = own
    else:
        u, v, kind = np.array(edges).T
        alike = np.eye(size) * field.skip
        psi = np.where(kind[:, None, None] == 0, field.chain, alike)  # [edge, label of u, label of v]
        source, target = np.concatenate([u, v]), np.concatenate([v, u])
        psi = np.concatenate([psi, psi.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(u)) + len(u), np.arange(len(u))])
        message = np.zeros((len(source), size))
        for _ in range(ROUNDS):
            belief = own.copy()
            np.add.at(belief, target, message)
            x = (belief[source] - message[back])[:, :, None] + psi
            top = x.max(axis=1)
            new = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            message = 0.5 * message + 0.5 * new
        belief = own.copy()
        np.add.at(belief, target, message)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return [p[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def added_spans(text: str, g: Graph, p: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Confident unclamped nodes, neighbours of one kind joined; never over a base span."""
    out: list[list[int]] = []
    for n, (a, b) in enumerate(g.spans):
        k = int(p[n].argmax())
        if g.base[n] >= 0 or k == 0 or p[n, k] < CONFIDENCE:
            continue
        near = out and out[-1][2] == k - 1 and not text[out[-1][1] : a].strip(" \t-.()")
        if near and sum("0" <= c <= "9" for c in text[out[-1][0] : b]) <= MOST_DIGITS:
            out[-1][1] = b
        else:
            out.append([a, b, k - 1])
    return [tuple(s) for s in out if not any(x[0] < s[1] and s[0] < x[1] for x in base)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans. Fits the field on ``docs`` if none is given."""
    if field is None:
        field = fit([tuple(r) for r in count_patterns(docs).collect()])
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            texts = piece.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            graphs = [graph(t, b) if EVIDENCE.search(t) else Graph([], [], [], [], []) for t, b in zip(texts, base, strict=True)]
            more = [added_spans(t, g, p, b) for t, g, p, b in zip(texts, graphs, marginals(graphs, shared.value), base, strict=True)]
            counts = [Counter(k for _, _, k in b) for b in base]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    *(pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))),
                    pa.array([joined(b) for b in base], pa.string()),
                    pa.array([joined(b + m) for b, m in zip(base, more, strict=True)], pa.string()),
                ],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_spans string, spans string"
    return source.mapInArrow(run, schema)

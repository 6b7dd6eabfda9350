"""Personal data by patterns and a skip-chain conditional random field.

The base patterns give spans that always stay. The field then looks at every
place in the document that might be personal data: the base spans, whose labels
are observed, and looser candidates (other number groups, written-out mail
addresses, values after a secret's name, keys, handles of known addresses).
Candidates that follow closely share a chain potential; candidates whose
normalised form is the same, however distant, share a skip potential, each with
the next of its kind, so edges are linear in candidates. Loopy message passing
over the whole document gives beliefs; a candidate that is more likely than not
an entity adds a span.

Potentials are fitted to counts over all documents, a table of a few hundred
rows at any scale. Number shapes: how often the base patterns take each. Values
after a secret's name: a class of value (a word, digits, mixed, long) is a secret
in as far as it is more frequent there than after other names and words, where
prose is what follows both. Chain and skip weights: the greatest pseudo-likelihood
of the base labels of linked spans, each seen by its number of digits alone, with
a normal prior; either sign may come out. Evidence that nothing in the corpus can
label has the fixed values below, as have shapes never seen.

Defined results: null is the empty text and has no spans; repeated rows are
treated alike; offsets are code points; overlapping spans of different kinds
all count, and redaction merges them under the first one's kind.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import slices

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "secret"]
LABELS = ["none", *KINDS]
_ORDER = {k: i for i, k in enumerate(KINDS)}

Span = tuple[int, int, str]  # start, end, kind

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Candidates beyond the base patterns, and the fixed chance of each label where
# the base patterns can't teach it.
_NUMBER = re.compile(r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[ ().\-/]{0,3}[0-9]){6,18}(?![0-9A-Za-z])")
_WRITTEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(](?:dot|DOT)[\])]|\.) ?[A-Za-z0-9-]{1,63})+")
_ASSIGNED = re.compile(r"(?<![\w])(\w{1,40})[\"']?\s{0,3}[=:]\s{0,3}[\"']?([^\s\"',;]{6,})")
_NAMED = re.compile(r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([^\s\"',;]{6,})", re.I)
_HANDLE = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]{5,}+(?!@)")
_KEY = re.compile(r"(?<![A-Za-z0-9])A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])")
_HEX = re.compile(r"(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])")
PRIOR = {
    "named word": ("secret", 0.02),
    "named digits": ("secret", 0.30),
    "named mixed": ("secret", 0.80),
    "named long": ("secret", 0.95),
    "key": ("secret", 0.98),
    "hex": ("secret", 0.20),
    "written": ("email", 0.90),
    "handle": ("email", 0.10),
    "number": ("phone", 0.01),
}
#: What the fixed values count against the corpus, in occurrences; the means of the
#: weights' normal priors (the same form is mostly the same thing) and their spread.
SMOOTHING = 20.0
MEAN, SPREAD = {"chain": 0.0, "skip": 5.0}, 3.0
CHAIN_REACH = 80
_NEVER = -30.0


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    out: list[Span] = []
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        after = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            floor = after = m.end()
        else:
            floor = at + 1
        at = text.find("@", after)
    return out


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans by start, then kind."""
    out = _emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], _ORDER[s[2]]))


def _loose(text: str, base: list[Span]) -> list[tuple[int, int, str]]:
    """(start, end, source) of candidates that no base span overlaps."""
    found: list[tuple[int, int, str]] = []
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "key") for m in _KEY.finditer(text)]
        found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
        found += [(m.start(), m.end(), "number") for m in _NUMBER.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start(1), m.end(1), "named") for m in _NAMED.finditer(text)]
    if "at]" in text or "at)" in text or "AT]" in text or "AT)" in text:
        found += [(m.start(), m.end(), "written") for m in _WRITTEN.finditer(text)]
    locals_ = {text[a:b].split("@")[0].lower() for a, b, kind in base if kind == "email"}
    locals_ = {x for x in locals_ if len(x) >= 5 and not x.isalpha()}
    if locals_:
        for m in _HANDLE.finditer(text):
            handle = m[0].rstrip(".-")
            if handle.lower() in locals_:
                found.append((m.start(), m.start() + len(handle), "handle"))
    strength = ["named", "key", "written", "handle", "hex", "number"]
    out: list[tuple[int, int, str]] = []
    starts = [a for a, _, _ in base]
    ends = list(accumulate((b for _, b, _ in base), max))  # of all spans that begin so far
    for a, b, source in sorted(set(found), key=lambda c: (c[0], strength.index(c[2]))):
        k = bisect_left(starts, b) - 1
        if (k < 0 or ends[k] <= a) and (not out or out[-1][1] <= a):
            out.append((a, b, source))
    return out


def _value_class(value: str) -> str:
    """Class of a value after a name: what prose has there is a word."""
    letters, digits = sum(map(str.isalpha, value)), sum("0" <= c <= "9" for c in value)
    if not digits and letters >= len(value) - 2:
        return "word"
    if not letters:
        return "digits"
    return "long" if len(value) >= 16 else "mixed"


def _shape(text: str, source: str) -> str:
    if source == "named":
        return f"named {_value_class(text)}"
    if source != "number":
        return source
    d = _digits(text)
    return f"number{len(d)}{'+' * text.startswith('+')}{'L' * _luhn(d)}"


def _form(text: str, kind: str) -> str:
    """The normalised form by which distant candidates are the same."""
    if kind in ("number", "phone", "card"):
        d = _digits(text)
        return "#" + (d[-9:] if len(d) >= 9 else d)
    if kind in ("email", "handle"):
        return "@" + text.split("@")[0].lower()
    if kind == "written":
        return "@" + re.split(r" ?[\[(]", text)[0].lower()
    return text.lower()


class Field:
    """Fitted potentials."""

    def __init__(self) -> None:
        self.node: dict[str, np.ndarray] = {}
        self.chain, self.skip = MEAN["chain"], MEAN["skip"]

    def node_potential(self, shape: str, source: str) -> np.ndarray:
        if shape in self.node:
            return self.node[shape]
        return np.log(_prior(shape if source == "named" else source))


def _prior(source: str) -> np.ndarray:
    kind, chance = PRIOR[source]
    p = np.full(len(LABELS), 1e-4)
    p[LABELS.index(kind)] = chance
    p[0] = 1 - p[1:].sum()
    return p


def _graph(text: str, base: list[Span], loose: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int, str, bool]], list[tuple[int, int]], list[tuple[int, int]]]:
    """Nodes (start, end, kind or source, observed) by start; chain and skip edges."""
    nodes = sorted([(a, b, k, True) for a, b, k in base] + [(a, b, s, False) for a, b, s in loose])
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][0] - nodes[i][1] <= CHAIN_REACH]
    last: dict[str, int] = {}
    skip = []
    for i, (a, b, kind, _) in enumerate(nodes):
        form = _form(text[a:b], kind)
        if form in last:
            skip.append((last[form], i))
        last[form] = i
    return nodes, chain, skip


def statistics(text: str) -> Counter:
    """What a document counts towards the potentials, by key:
    ``node|shape|label``, ``digits|number|label``, ``edge|type|number|label|other's``
    (number: of digits) and ``value|class|whether a secret's name comes first``."""
    out: Counter[str] = Counter()
    base = base_spans(text)
    nodes, chain, skip = _graph(text, base, _loose(text, base))
    numbers: dict[int, int] = {}
    for i, (a, b, kind, observed) in enumerate(nodes):
        if kind in ("phone", "card", "number"):
            label = kind if observed else "none"
            numbers[i] = len(_digits(text[a:b]))
            out[f"node|{_shape(text[a:b], 'number')}|{label}"] += 1
            out[f"digits|{numbers[i]}|{label}"] += 1
    for name, edges in (("chain", chain), ("skip", skip)):
        for i, j in edges:
            for x, y in ((i, j), (j, i)):
                # A number beside a span that the patterns don't take speaks against chains;
                # one of the same form as a span may be what they miss.
                if x in numbers and nodes[y][3] and (nodes[x][3] or name == "chain"):
                    out[f"edge|{name}|{numbers[x]}|{nodes[x][2] if nodes[x][3] else 'none'}|{nodes[y][2]}"] += 1
    if "=" in text or ":" in text:
        named = {m.start(1) for m in _NAMED.finditer(text)}
        for m in _ASSIGNED.finditer(text):
            out[f"value|{_value_class(m[2])}|{int(m.start(2) in named)}"] += 1
    return out


def _log_likelihood(weight: float, mean: float, edges: list[tuple[np.ndarray, int, int, float]]) -> float:
    """Of the labels at one end given the other's, with a normal prior."""
    total = -(((weight - mean) / SPREAD) ** 2) / 2
    for chance, label, other, n in edges:
        bonus = np.ones(len(chance))
        bonus[other] = math.exp(weight)
        total += n * math.log(chance[label] * bonus[label] / (chance @ bonus))
    return total


def _fitted_weight(mean: float, edges: list[tuple[np.ndarray, int, int, float]]) -> float:
    """The weight of greatest likelihood, a concave function, by golden sections."""
    low, high = -30.0, 30.0
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if _log_likelihood(a, mean, edges) < _log_likelihood(b, mean, edges):
            low = a
        else:
            high = b
    return (low + high) / 2


def fitted(counts: dict[str, int]) -> Field:
    """Potentials from the counts of ``statistics``, summed over all documents."""
    field = Field()
    by: dict[str, dict[str, np.ndarray]] = {"node": {}, "digits": {}}
    values = {"0": Counter(), "1": Counter()}
    edges: dict[str, list] = {"chain": [], "skip": []}
    for key, n in sorted(counts.items()):
        kind, *rest = key.split("|")
        if kind in by:
            by[kind].setdefault(rest[0], SMOOTHING * _prior("number"))[LABELS.index(rest[1])] += n
        elif kind == "value":
            values[rest[1]][rest[0]] += n
        else:
            edges[rest[0]].append((rest[1], LABELS.index(rest[2]), LABELS.index(rest[3]), n))
    for shape, p in by["node"].items():
        field.node[shape] = np.log(p / p.sum())
    chances = {digits: p / p.sum() for digits, p in by["digits"].items()}
    field.chain, field.skip = (_fitted_weight(MEAN[name], [(chances[d], y, other, n) for d, y, other, n in edges[name]]) for name in ("chain", "skip"))
    # Of the values after secrets' names, the share that is prose: what words say.
    there, elsewhere = sum(values["1"].values()), sum(values["0"].values())
    rate = lambda c: (values["1"][c] / there, values["0"][c] / elsewhere if elsewhere else 0.0)
    prose = min(1.0, rate("word")[0] / rate("word")[1]) if there and values["0"]["word"] else 0.0
    for c in values["1"]:
        named, other = rate(c)
        shape = f"named {c}"
        chance = 0.0 if c == "word" and prose else max(0.0, 1 - prose * other / named)
        if c == "word" and not prose:
            chance = PRIOR[shape][1]
        p = SMOOTHING * _prior(shape)
        p[LABELS.index("secret")] += chance * values["1"][c]
        p[0] += (1 - chance) * values["1"][c]
        field.node[shape] = np.log(p / p.sum())
    return field


def train(sample: list[str]) -> Field:
    """Potentials of a list of texts."""
    total: Counter[str] = Counter()
    for text in sample:
        total.update(statistics(text))
    return fitted(total)


def beliefs(potentials: np.ndarray, edges: list[tuple[int, int, float]], rounds: int = 30, damping: float = 0.3) -> np.ndarray:
    """Marginals by loopy sum-product; an edge adds its weight where both ends
    have the same label other than none. Exact on trees, given enough rounds."""
    n, k = potentials.shape
    if not edges:
        p = np.exp(potentials - potentials.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)
    a = np.array([e[0] for e in edges] + [e[1] for e in edges])
    b = np.array([e[1] for e in edges] + [e[0] for e in edges])
    bonus = np.exp(np.array([e[2] for e in edges] * 2))[:, None] - 1
    reverse = (np.arange(len(a)) + len(edges)) % len(a)
    messages = np.zeros((len(a), k))  # logarithms
    for _ in range(rounds):
        total = potentials.copy()
        np.add.at(total, b, messages)
        cavity = total[a] - messages[reverse]
        p = np.exp(cavity - cavity.max(axis=1, keepdims=True))
        sent = p.sum(axis=1, keepdims=True) + bonus * p * (np.arange(k) > 0)
        sent = np.log(sent / sent.sum(axis=1, keepdims=True))
        change = np.abs(sent - messages).max()
        messages = damping * messages + (1 - damping) * sent
        if change < 1e-5:
            break
    total = potentials.copy()
    np.add.at(total, b, messages)
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def find(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, then kind."""
    base = base_spans(text)
    loose = _loose(text, base)
    if not loose:
        return base, base
    nodes, chain, skip = _graph(text, base, loose)
    potentials = np.full((len(nodes), len(LABELS)), _NEVER)
    for i, (a, b, kind, observed) in enumerate(nodes):
        if observed:
            potentials[i, LABELS.index(kind)] = 0.0
        else:
            potentials[i] = field.node_potential(_shape(text[a:b], kind), kind)
    edges = [(i, j, field.chain) for i, j in chain] + [(i, j, field.skip) for i, j in skip]
    marginal = beliefs(potentials, edges)
    added = []
    for (a, b, _, observed), p in zip(nodes, marginal):
        if not observed and p[0] < 0.5:
            added.append((a, b, KINDS[int(p[1:].argmax())]))
    return base, sorted(base + added, key=lambda s: (s[0], _ORDER[s[2]]))


def shown(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with ``[KIND]`` in place of each span; overlapping spans are one."""
    out, at, k = [], 0, 0
    while k < len(spans):
        a, b, kind = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < b:
            b = max(b, spans[k][1])
            k += 1
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def fit(docs: DataFrame, text_col: str = "text") -> Field:
    """Field of all documents. Tasks count and the counts are summed; the keys are
    bounded by the patterns, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                total.update(statistics(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["key", "n"])

    some = docs.select(F.col(f"`{text_col}`").alias("text")).where(F.col("text").rlike("[0-9@:=]"))
    found = some.mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return fitted({r["key"]: r["n"] for r in found.collect()})


def scan(docs: DataFrame, field: Field, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, counts of base spans by kind, ``base_sha256``, ``spans``."""
    some = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = some.drop("__text").schema
    for kind in BASE:
        schema = schema.add(f"n_{kind}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            last = batch.num_columns - 1
            found = [find(t or "", shared.value) for t in batch.column(last).to_pylist()]
            counts = [pa.array([sum(s[2] == kind for s in base) for base, _ in found], pa.int64()) for kind in BASE]
            digests = pa.array([hashlib.sha256(shown(base).encode()).hexdigest() for base, _ in found], pa.string())
            spans = pa.array([shown(all_spans) for _, all_spans in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], *counts, digests, spans], names=schema.fieldNames())

    return some.mapInArrow(run, schema)


def redacted(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with every span in the text replaced by its kind."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = list(batch.columns)
            cleaned = [t and redact(t, find(t, shared.value)[1]) for t in columns[at].to_pylist()]
            columns[at] = pa.array(cleaned, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)

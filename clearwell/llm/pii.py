"""Personal data by a skip-chain conditional random field.

Nodes of a document's graph are the base finds of four patterns (e-mail, IP address, card,
phone) and other candidates that only resemble them: a number without its prefix, an
address without its domain's end, a card number with a wrong check digit. Neighbouring
nodes are linked as in a chain; nodes of the same key (equal text, equal last digits, equal
local part), however far apart, are linked by skip edges to one hub of the key, so a frequent
key gives as many edges as it has nodes. Base finds are fixed, and so are the hubs of keys
that have some: what is clear about a key, no number of unclear nodes outvotes. Loopy message
passing over both kinds of edges lets a document's clear finds label its unclear ones.

Weights of node features, of label pairs of neighbours and of skip edges are fitted on the
base finds of at most ``SAMPLE_ROWS`` documents (a documented bound, drawn by a hash of the
text). Search and labelling cover all rows and whole texts.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.storage import materialize
from .common import arrow_map, row_slices

# The kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
SAMPLE_ROWS = 4000
# Messages pass until none changes by more than STILL, or for so many rounds at most.
ROUNDS = 200
STILL = 1e-7
# Added to the score of "nothing" of every candidate: an unclear token is mostly no find.
CAUTION = 1.5
NEAR = 40
NEW_TOKEN = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_ALIKE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*[A-Za-z0-9]|(?<![0-9A-Za-z])[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,}+(?![0-9A-Za-z])")
_GROUP = re.compile(r"[0-9]+")
MOST_DIGITS = 19


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """From each @ to both sides, so that long runs without one cost nothing."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        tail = _DOMAIN.match(text, at + 1)
        if start < at and tail:
            out.append((start, tail.end()))
            free = tail.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four patterns, each leftmost and non-overlapping."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and passes_luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _unlikely(sizes: list[int], digits: str) -> float:
    """How unlike one number some groups of digits are: cards in their usual groups are the
    likeliest, with a right check digit most of all, then phones."""
    n = len(digits)
    if 13 <= n <= MOST_DIGITS:
        usual = len(sizes) == 1 or sizes[:2] == [4, 6] and len(sizes) == 3 or all(s == 4 for s in sizes[:-1]) and sizes[-1] <= 4
        if usual:
            return 1.0 if passes_luhn(digits) else 1.5
        return 2.0 if n <= 15 else 2.5
    if 7 <= n <= 12:
        return 1.3 if n >= 9 else 2.0
    return 4.0


def split_run(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The numbers in a row of ``text[start:end]``: its groups of digits cut into numbers of
    at most ``MOST_DIGITS`` digits so that these are likeliest in sum. Every group is in one;
    a longer group is one of its own."""
    groups = [m.span() for m in _GROUP.finditer(text, start, end)]
    best, cut = [0.0], [0]
    for j in range(1, len(groups) + 1):
        found, sizes, digits = (float("inf"), 0), [], ""
        for i in range(j - 1, -1, -1):
            a, b = groups[i]
            if sizes and len(digits) + b - a > MOST_DIGITS:
                break
            sizes.insert(0, b - a)
            digits = text[a:b] + digits
            found = min(found, (best[i] + _unlikely(sizes, digits), i))
            if len(digits) > MOST_DIGITS:
                break
        best.append(found[0])
        cut.append(found[1])
    out, j = [], len(groups)
    while j:
        a, b = groups[cut[j]][0], groups[j - 1][1]
        out.append((a - (a > start and text[a - 1] in "+("), b))
        j = cut[j]
    return out[::-1]


def other_candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans that resemble a find and touch none. Of a run of digits that a find touches, what
    lies beside the find; a run of more digits than any find has is cut into numbers."""
    out, at = [], 0
    if "@" not in text and not _DIGIT.search(text):
        return out
    taken: list[list[int]] = []  # base spans, those that overlap as one
    for low, _, high in base:
        if taken and low < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], high)
        else:
            taken.append([low, high])
    for m in _ALIKE.finditer(text):
        start, end = m.span()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        pieces, k = [], at
        while k < len(taken) and taken[k][0] < end:
            pieces.append((start, taken[k][0]))
            start = taken[k][1]
            k += 1
        pieces.append((start, end))
        for a, b in pieces:
            if "@" in m.group():
                out += [(a, b)] if (a, b) == m.span() else []
            elif groups := [x.span() for x in _GROUP.finditer(text, a, b)] if a < b else []:
                a, b = groups[0][0] - (groups[0][0] > a and text[groups[0][0] - 1] in "+("), groups[-1][1]
                out += split_run(text, a, b) if sum(y - x for x, y in groups) > MOST_DIGITS else [(a, b)]
    return out


def _shape(text: str) -> list[int]:
    """Numbers of the features that hold for a token."""
    digits = _DIGIT.findall(text)
    n = len(digits)
    dots = text.count(".")
    parts = text.split(".")
    four = len(parts) == 4 and all(p.isdigit() for p in parts)
    tests = [
        True, "@" in text, "@" in text and "." in text.partition("@")[2], text[0] == "+", "(" in text,
        "-" in text, " " in text, dots == 1, dots == 2, dots == 3, dots > 3, four,
        four and all(len(p) <= 3 and int(p) <= 255 for p in parts), n == 0, 0 < n < 7, 7 <= n <= 8, 9 <= n <= 11,
        12 <= n <= 15, n == 16, 17 <= n <= 19, n > 19, 12 <= n <= 19 and passes_luhn("".join(digits)),
        n == len(text), any(c.isalpha() for c in text),
    ]
    return [i for i, t in enumerate(tests) if t]


FEATURES = 24
LABELS = 1 + len(KINDS)


def _keys(text: str) -> list[str]:
    digits = "".join(_DIGIT.findall(text))
    keys = ["=" + text.lower()]
    if "@" in text:
        keys.append("@" + text.partition("@")[0].lower())
    elif len(digits) >= 7:
        keys.append("#" + digits[-7:])
        if len(digits) >= 12:
            keys.append("^" + digits[:10])
    return keys


class Graph:
    """The nodes and edges of the documents of one batch, side by side."""

    def __init__(self):
        self.spans: list[tuple[int, int, int]] = []  # document, start, end
        self.labels: list[int] = []  # -1: open
        self.features: list[list[int]] = []
        self.chain: list[tuple[int, int]] = []
        self.skips: list[tuple[int, int]] = []  # node and hub; hubs are -1, -2 and so on
        self.hubs = 0

    def add(self, document: int, text: str, base: list, others: list) -> None:
        nodes = sorted([(a, b, kind + 1) for a, kind, b in base] + [(a, b, -1) for a, b in others])
        first_of: dict[str, int] = {}
        hub_of: dict[str, int] = {}
        for i, (a, b, label) in enumerate(nodes):
            number = len(self.spans)
            token = text[a:b]
            self.spans.append((document, a, b))
            self.labels.append(label)
            self.features.append(_shape(token))
            if i and a - nodes[i - 1][1] <= NEAR:
                self.chain.append((number - 1, number))
            for key in _keys(token):
                if key not in first_of:
                    first_of[key] = number
                    continue
                if key not in hub_of:
                    self.hubs += 1
                    hub_of[key] = -self.hubs
                    self.skips.append((first_of[key], -self.hubs))
                self.skips.append((number, hub_of[key]))


def fit_weights(graph: Graph, steps: int = 300, rate: float = 0.5, l2: float = 1e-3):
    """(node weights, chain weights, skip weight) by pseudo-likelihood. Open nodes count as
    nothing found, except those that skip edges lead to from a base find: they are what the
    field is to decide, and teach nothing."""
    labels = np.array(graph.labels, np.int64)
    sure = np.ones(len(labels), bool)
    reached = np.concatenate([labels >= 0, np.zeros(graph.hubs, bool)])
    edges = np.array(graph.skips, np.int64).reshape(-1, 2) % max(1, len(reached))
    before = -1
    while before != (before := reached.sum()):
        for a, b in (edges.T, edges.T[::-1]):
            reached[b[reached[a]]] = True
    sure[reached[: len(labels)] & (labels < 0)] = False
    labels = np.maximum(labels, 0)
    weights = np.zeros((FEATURES, LABELS))
    if sure.any():
        x = np.zeros((len(labels), FEATURES))
        for i, f in enumerate(graph.features):
            x[i, f] = 1
        x, target = x[sure], np.eye(LABELS)[labels[sure]]
        for _ in range(steps):
            z = x @ weights
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            weights -= rate * (x.T @ (p - target) / len(x) + l2 * weights)
    pairs = np.ones((LABELS, LABELS))
    for a, b in graph.chain:
        if sure[a] and sure[b]:
            pairs[labels[a], labels[b]] += 1
    alone = pairs.sum(axis=1, keepdims=True) * pairs.sum(axis=0, keepdims=True) / pairs.sum()
    known, last = [], {}  # by hub, each sure node and the next
    for a, hub in graph.skips:
        if sure[a]:
            if hub in last:
                known.append(labels[last[hub]] == labels[a])
            last[hub] = a
    skip = np.log((sum(known) + 1) / (len(known) - sum(known) + 1))
    return weights, np.clip(np.log(pairs / alone), -1, 1), float(np.clip(skip, 2, 6))


def marginals(graph: Graph, model, rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities of every node after loopy message passing. A hub with fixed nodes
    has their share of labels and takes no messages."""
    weights, pairs, skip = model
    n = len(graph.spans)
    own = np.zeros((n + graph.hubs, LABELS))
    for i, f in enumerate(graph.features):
        own[i] = weights[f].sum(axis=0)
    own[:n, 0] += CAUTION
    for i, label in enumerate(graph.labels):
        if label >= 0:
            own[i] = -50
            own[i, label] = 0
    edges = np.array(graph.chain + graph.skips, np.int64).reshape(-1, 2) % max(1, len(own))
    skips = edges[len(graph.chain) :]
    seen = np.zeros((len(own), LABELS))
    for a, hub in skips[skips[:, 1] >= n].tolist():
        if graph.labels[a] >= 0:
            seen[hub, graph.labels[a]] += 1
    fixed = seen.any(axis=1)
    own[fixed] = np.where(seen[fixed] > 0, np.log(np.maximum(seen[fixed], 1) / seen[fixed].sum(axis=1, keepdims=True)), -50)
    forward = np.concatenate([
        np.broadcast_to(pairs, (len(graph.chain), LABELS, LABELS)),
        np.broadcast_to(np.eye(LABELS) * skip, (len(graph.skips), LABELS, LABELS))])
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    weight = np.concatenate([forward, forward.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    messages = np.zeros((len(source), LABELS))
    silent = fixed[target]

    def beliefs():
        total = own.copy()
        np.add.at(total, target, messages)
        return total

    for _ in range(rounds if len(edges) else 0):
        away = beliefs()[source] - messages[back]
        z = away[:, :, None] + weight
        top = z.max(axis=1, keepdims=True)
        fresh = np.log(np.exp(z - top).sum(axis=1)) + top[:, 0]
        fresh -= fresh.max(axis=1, keepdims=True)
        fresh[silent] = 0
        change = np.abs(fresh - messages).max()
        messages = 0.5 * messages + 0.5 * fresh
        if change <= STILL:
            break
    total = beliefs()[:n]
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _fit_task(batches):
    graph, document = Graph(), 0
    for batch in row_slices(batches, 0):
        for text in batch.column(0).to_pylist():
            base = base_spans(text)
            graph.add(document, text, base, other_candidates(text, base))
            document += 1
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_weights(graph))], pa.binary())], ["model"])


def fit(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS):
    """The field's weights from the base finds of at most ``sample_rows`` texts that hold a
    digit or an @, drawn by their hash. No such text: weights that add nothing."""
    rows = docs.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    # Hashes first, so that texts are not sorted; one task then reads the bounded sample.
    drawn = rows.select(F.xxhash64("text").alias("mark")).distinct().orderBy("mark").limit(sample_rows)
    last = drawn.agg(F.max("mark")).first()[0]
    sample = rows.where(F.xxhash64("text") <= (last if last is not None else 0)).dropDuplicates(["text"])
    sample = materialize(sample.limit(sample_rows), "pii-sample")
    rows = arrow_map(sample.coalesce(1), _fit_task, "model binary").collect()
    return pickle.loads(bytes(rows[0]["model"])) if rows else fit_weights(Graph())


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _find(model):
    def run(batches):
        for batch in row_slices(batches, 1):
            graph, bases = Graph(), []
            for i, text in enumerate(batch.column(1).to_pylist()):
                base = base_spans(text)
                others = other_candidates(text, base)
                bases.append(base)
                if others:
                    graph.add(i, text, base, others)
            added: dict[int, list] = {}
            if graph.spans:
                found = marginals(graph, model)
                for (i, a, b), label, p in zip(graph.spans, graph.labels, found):
                    if label < 0 and p[1:].max() > NEW_TOKEN:
                        added.setdefault(i, []).append((a, int(p[1:].argmax()), b))
            counts = [[sum(s[1] == k for s in base) for base in bases] for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([_listed(b) for b in bases]),
                 pa.array([_listed(b + added.get(i, [])) for i, b in enumerate(bases)]),
                 pa.array([len(added.get(i, [])) for i in range(len(bases))], pa.int64())],
                ["id", *(f"n_{k}" for k in KINDS), "base", "spans", "n_added"])

    return run


def find(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, spans, n_added) for every row. Spans are
    kind:start:end in code points, end exclusive, by start and kind, comma-joined; ``base``
    and the counts have the patterns' finds, ``spans`` also those of the field.

    Null and empty texts have none. Rows of a null id and repeated rows are answered like
    any other. Other columns are not read, whatever their names."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return arrow_map(rows, _find(model), f"id bigint, {counts}, base string, spans string, n_added bigint")


def _redacted(model, at: int):
    def run(batches):
        for batch in row_slices(batches, at):
            texts = batch.column(at).to_pylist()
            graph, spans = Graph(), []
            for i, text in enumerate(texts):
                base = base_spans(text or "")
                others = other_candidates(text or "", base)
                spans.append(list(base))
                if others:
                    graph.add(i, text, base, others)
            if graph.spans:
                for (i, a, b), label, p in zip(graph.spans, graph.labels, marginals(graph, model)):
                    if label < 0 and p[1:].max() > NEW_TOKEN:
                        spans[i].append((a, int(p[1:].argmax()), b))
            out = []
            for text, found in zip(texts, spans):
                parts, free = [], 0
                for a, kind, b in sorted(found):
                    if a >= free:
                        parts += [text[free:a], f"[{KINDS[kind]}]"]
                    free = max(free, b)
                out.append("".join([*parts, text[free:]]) if found else text)
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def redact(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """``docs`` with every found span of the text replaced by its kind in brackets; spans
    that overlap become one. Null texts stay null; all other columns stay as they are."""
    at = docs.columns.index(text_col)
    return arrow_map(docs, _redacted(model, at), docs.schema)


def op10_pii(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = find(docs, fit(docs))
    return found.select(
        F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone",
        F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")

"""Personal data by patterns and a skip-chain conditional random field.

Tokens with a digit, an at sign or a plus are the nodes of a field over the labels O, email, ip,
card and phone; all other tokens are O. A token inside a pattern's match has the match's label; the
others' labels are inferred. Neighbouring nodes share transition potentials. Repeated tokens, and
distant ones with the same digits, share skip-edge potentials; tokens that differ by one character
share weaker ones of their own. Loopy sum-product message passing runs over all documents of a slice
at once. A run of nodes that the field gives a kind becomes a span where skip edges among nodes of
this kind lead from it to a match in the same document.

All potentials are log-linear weights, trained together by conditional (pseudo-)likelihood: of each
node given its shape and the labels of its neighbours and of the equal and the similar token before
it. The data enter only by how often each such situation occurs, so Spark counts all documents and
the driver solves one small convex problem. A node that equals a match's token but lies in none is
of unknown label and is not learned from. Each situation also counts once without its shape, so
that the edges learn to carry a label by themselves.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeforge.llm.textvec import column, flat_slices

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1
#: The patterns in linear time: an address begins where its run of characters does or, behind a
#: match, at that match's end; parts of numbers are never given back.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL_HERE = re.compile(rf"{_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
EMAIL = re.compile(rf"(?<!{_LOCAL}){EMAIL_HERE.pattern}")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_BLANK = " \t\n\v\f\r"
#: Words with a digit, an at sign or a plus.
NODE = re.compile(rf"(?<![^{_BLANK}])[^{_BLANK}0-9@+]*+[0-9@+][^{_BLANK}]*+")
_NOT_DIGITS = re.compile("[^0-9]+")
_LETTER = re.compile(r"[^\W\d_]")
_NODE = bytes(c in b"0123456789@+" for c in range(256))

ROUNDS = 20
LEAST_KEY = 4  # digits that make two tokens the same
SIMILAR_KEYS = (7, 64)  # lengths of keys that one edit makes similar

#: Shapes: least digits of each class but the first, four marks, and up to four dots.
DIGITS = (1, 4, 7, 8, 10, 11, 13, 16, 20)
SHAPES = (len(DIGITS) + 1) * 16 * 5
ABSENT, HIDDEN = LABELS, LABELS + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return _NOT_DIGITS.sub("", text)


def _addresses(text: str) -> Iterator[re.Match]:
    at = 0
    while m := (EMAIL_HERE.match(text, at) if at else None) or EMAIL.search(text, at):
        yield m
        at = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind and start; failing matches are dropped."""
    out = []
    if "@" in text:
        out += [(0, m.start(), m.end()) for m in _addresses(text)]
    if "." in text:
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def shape(token: str) -> int:
    """A token's shape, one of ``SHAPES``."""
    marks = ("@" in token) + 2 * (token[0] == "+") + 4 * bool(_LETTER.search(token)) + 8 * ("-" in token or "(" in token)
    return (min(4, token.count(".")) * 16 + marks) * (len(DIGITS) + 1) + bisect_right(DIGITS, len(_digits(token)))


def key(token: str) -> str | None:
    """What makes distant tokens the same: an address, or four digits and more."""
    if "@" in token:
        return token.lower().strip(".,;:!?()[]<>\"'")
    d = _digits(token)
    return d if len(d) >= LEAST_KEY else None


def similar_keys(keys: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of distinct keys that one replaced, added or lost character makes equal.

    Keys that agree in all but one place form a chain, so the pairs are as many as the characters.
    """
    least, most = SIMILAR_KEYS
    known, last, out = {k: i for i, k in enumerate(keys)}, {}, set()
    for i, k in enumerate(keys):
        if not least <= len(k) <= most:
            continue
        for at in range(len(k)):
            rest = k[:at] + k[at + 1 :]
            if (j := known.get(rest)) is not None:
                out.add((min(i, j), max(i, j)))
            if (j := last.get((at, rest))) is not None:
                out.add((j, i))
            last[at, rest] = i
    return sorted(out)


class Nodes:
    """The nodes of one text: place, label by the patterns (0 is none), and the edges among them."""

    def __init__(self, text: str):
        self.spans = base_spans(text)
        self.tokens = [(m.start(), m.end(), m[0]) for m in NODE.finditer(text)]
        n = len(self.tokens)
        starts, ends = [t[0] for t in self.tokens], [t[1] for t in self.tokens]
        self.labels, owner = [0] * n, [-1] * n
        for s in range(len(self.spans) - 1, -1, -1):  # the kind listed first wins
            kind, a, b = self.spans[s]
            for k in range(bisect_right(ends, a), n):
                if starts[k] >= b:
                    break
                self.labels[k], owner[k] = kind + 1, s
        #: Whether each node's next one is its neighbour.
        self.joined = [(owner[k] == owner[k + 1] >= 0) or not text[ends[k] : starts[k + 1]].strip(_BLANK) for k in range(n - 1)]
        by_key: dict[str, list[int]] = defaultdict(list)
        for k, (_, _, token) in enumerate(self.tokens):
            if name := key(token):
                by_key[name].append(k)
        self.groups = list(by_key.values())
        #: A group's token that similar groups are tied to: its first match, else its first one.
        heads = [next((k for k in ks if self.labels[k]), ks[0]) for ks in self.groups]
        self.similar = [(heads[a], heads[b]) for a, b in similar_keys(list(by_key))]

    def chain(self) -> list[tuple[int, int]]:
        return [(k, k + 1) for k, near in enumerate(self.joined) if near]

    def equal(self) -> list[tuple[int, int]]:
        """Skip edges of equal tokens.

        Where some lie in matches, each other one is tied to the last match before it, else to the
        first one, so no tie is further than one edge; else they form a chain.
        """
        edges = []
        for ks in self.groups:
            last = next((k for k in ks if self.labels[k]), None)
            if last is None:
                edges += zip(ks, ks[1:], strict=False)
                continue
            for k in ks:
                if self.labels[k]:
                    last = k
                else:
                    edges.append((last, k))
        return edges

    def situations(self) -> Iterator[tuple[int, int]]:
        """A number for (shape, left, right, equal and similar token's label) of each node of known
        label, and that label."""
        n = len(self.tokens)
        seen = list(self.labels)
        equal, near = [ABSENT] * n, [ABSENT] * n
        for ks in self.groups:
            matched = [k for k in ks if self.labels[k]]
            if matched and len(matched) < len(ks):
                for k in ks:
                    seen[k] = seen[k] or HIDDEN
            known = matched or ks
            for a, b in zip(known, known[1:], strict=False):
                equal[b] = seen[a]
        for a, b in self.similar:
            if seen[a] != HIDDEN:
                near[b] = seen[a]
        for k, y in enumerate(seen):
            if y != HIDDEN:
                left = seen[k - 1] if k and self.joined[k - 1] else ABSENT
                right = seen[k + 1] if k + 1 < n and self.joined[k] else ABSENT
                yield (((shape(self.tokens[k][2]) * 7 + left) * 7 + right) * 6 + equal[k]) * 6 + near[k], y


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, str | None]]:
    """(row, text) of a batch; None for texts without any digit, at sign or plus."""
    texts = column(batch, "text")
    for a, b, flat in flat_slices(texts):
        marks = np.flatnonzero(np.frombuffer(flat.data.tobytes().translate(_NODE), bool))
        some = np.diff(np.searchsorted(marks, flat.offs)) > 0
        for i in range(a, b):
            yield i, texts[i].as_py() if some[i - a] else None


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for _, text in _texts(batch):
            if text is not None:
                counts.update(Nodes(text).situations())
        rows = list(counts.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.int64()), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())], names=["situation", "label", "n"])


def features(shapes: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 for shapes: a constant, the class of digits, the marks, the dots."""
    wide = len(DIGITS) + 1
    digits, marks, dots = shapes % wide, shapes // wide % 16, shapes // wide // 16
    one = np.ones((len(shapes), 1))
    return np.concatenate([one, np.eye(wide)[digits], marks[:, None] >> np.arange(4) & 1, np.eye(5)[dots]], axis=1)


FEATURES = 1 + len(DIGITS) + 1 + 4 + 5


class Model:
    """Weights of a field: of shapes, ends of runs, neighbours, equal and similar tokens."""

    #: Weight of the squared weights, against a mean over situations; what it allows does not
    #: depend on the size of the corpus.
    PENALTY = 1e-3
    #: Times the penalty of what one pair of labels has besides the weight that all agreement shares,
    #: so that kinds that seldom repeat are tied as well.
    ALONE = 10.0

    def __init__(self, situations: np.ndarray, labels: np.ndarray, n: np.ndarray, steps: int = 25):
        """Maximise the mean conditional log-likelihood by Newton's method; each label weighs the same."""
        sizes = {"shape": FEATURES * LABELS, "left": LABELS, "right": LABELS, "chain": LABELS**2, "equal": LABELS**2 + 1, "near": LABELS**2 + 1}
        at, self.place = 0, {}
        for name, size in sizes.items():
            self.place[name] = slice(at, at := at + size)
        self.w, self.penalty = np.zeros(at), np.full(at, self.PENALTY)
        for name in ("equal", "near"):
            self.penalty[self.place[name]][:-1] *= self.ALONE
        if len(n):
            totals = np.bincount(labels, weights=n, minlength=LABELS)
            weight = n / totals[labels] / np.count_nonzero(totals)
            self._fit(np.asarray(situations, np.int64), np.asarray(labels), weight, steps)
        part = lambda k: self.w[self.place[k]]
        both = lambda k: (x := part(k)[:-1].reshape(LABELS, LABELS)) + x.T + part(k)[-1] * np.eye(LABELS)
        self.shapes = features(np.arange(SHAPES)) @ part("shape").reshape(FEATURES, LABELS)
        self.left, self.right, self.chain = part("left"), part("right"), part("chain").reshape(LABELS, LABELS)
        self.equal, self.near = both("equal"), both("near")  # edges without a direction

    def _design(self, situations: np.ndarray, shaped: bool) -> np.ndarray:
        """(situation, label, weight) matrix of what each weight adds to a label's logit."""
        near, equal = situations % 6, situations // 6 % 6
        right, left = situations // 36 % 7, situations // 252 % 7
        m = len(situations)
        out = np.zeros((m, LABELS, len(self.w)))
        row = np.arange(m)
        shapes = features(situations // 1764)
        for y in range(LABELS):
            if shaped:
                out[:, y, self.place["shape"]].reshape(m, FEATURES, LABELS)[:, :, y] = shapes
            for name, seen, cell in (("chain", left, lambda s: s * LABELS + y), ("chain", right, lambda s: y * LABELS + s), ("equal", equal, lambda s: s * LABELS + y), ("equal", equal, lambda s: y * LABELS + s), ("near", near, lambda s: s * LABELS + y), ("near", near, lambda s: y * LABELS + s)):  # noqa: B023
                k = row[seen < LABELS]
                np.add.at(out, (k, y, self.place[name].start + cell(seen[k])), 1)
            for name, seen in (("equal", equal), ("near", near)):  # what all labels' agreement shares
                out[seen == y, y, self.place[name].stop - 1] = 1
            for name, seen in (("left", left), ("right", right)):
                out[seen == ABSENT, y, self.place[name].start + y] = 1
        return out

    def _slopes(self, situations, labels, weight, w, slopes: bool = True):
        """Penalised loss at ``w`` and, if asked for, its gradient and Hessian."""
        loss = self.penalty @ (w * w) / 2
        gradient, hessian = self.penalty * w, np.diag(self.penalty)
        for a in range(0, len(labels), 512):
            part = slice(a, a + 512)
            for shaped in (True, False):
                x = self._design(situations[part], shaped)
                z = x @ w
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                u, y = weight[part], labels[part]
                row = np.arange(len(y))
                loss -= u @ np.log(np.maximum(p[row, y], 1e-300))
                if slopes:
                    mean = np.einsum("cy,cyk->ck", p, x)
                    gradient += u @ (mean - x[row, y])
                    scaled = (x * np.sqrt(u[:, None] * p)[:, :, None]).reshape(-1, len(w))
                    mean *= np.sqrt(u)[:, None]
                    hessian += scaled.T @ scaled - mean.T @ mean
        return loss, gradient, hessian

    def _fit(self, situations, labels, weight, steps):
        for _ in range(steps):
            loss, gradient, hessian = self._slopes(situations, labels, weight, self.w)
            step = np.linalg.solve(hessian, gradient)
            size = 1.0
            while size > 1e-4 and self._slopes(situations, labels, weight, self.w - size * step, False)[0] > loss - 1e-4 * size * gradient @ step:
                size /= 2
            self.w = self.w - size * step
            if gradient @ step < 1e-9:
                break


def train(docs: DataFrame) -> Model:
    """Count the situations of all documents and fit the weights.

    The driver gets a row for each situation and label that occurs: some hundred, and at most
    5 x ``SHAPES`` x 7 x 7 x 6 x 6. Null and empty texts have none; without any, all weights are 0.
    """
    counted = docs.select("text").mapInArrow(_count, "situation long, label int, n long")
    rows = counted.groupBy("situation", "label").agg(F.sum("n").alias("n")).orderBy("situation", "label").toArrow()
    return Model(*[rows[c].to_numpy() for c in ("situation", "label", "n")])


def marginals(own: np.ndarray, edges: np.ndarray, factor: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities by loopy sum-product: own log-potentials of nodes, pairs of nodes, and
    the log-potentials (first label, second label) of each pair."""
    a, b = edges.reshape(-1, 2).T.astype(int)
    belief = own.copy()
    if len(a):
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        factor = np.concatenate([factor, factor.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        messages = np.zeros((len(source), own.shape[1]))
        for _ in range(rounds):
            belief = own.copy()
            np.add.at(belief, target, messages)
            out = (belief[source] - messages[back])[:, :, None] + factor
            top = out.max(1)
            fresh = np.log(np.exp(out - top[:, None, :]).sum(1)) + top
            fresh -= fresh.max(1, keepdims=True)
            change = np.abs(fresh - messages).max()
            messages = 0.5 * messages + 0.5 * fresh  # damped, so that loops settle
            if change < 1e-6:
                break
        belief = own.copy()
        np.add.at(belief, target, messages)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return a, b


def added_spans(text: str, nodes: Nodes, p: np.ndarray, least: float = 0.5) -> list[tuple[int, int, int]]:
    """Spans of nodes whose label comes over skip edges from a match in the same text."""
    if not nodes.spans:
        return []
    labels = [nodes.labels[k] or (int(y) if top >= least else 0) for k, (y, top) in enumerate(zip(p.argmax(1), p.max(1), strict=True))]
    ways = defaultdict(list)
    for a, b in [*nodes.equal(), *nodes.similar]:
        if labels[a] and labels[a] == labels[b]:
            ways[a].append(b)
            ways[b].append(a)
    reached = {k for k, y in enumerate(nodes.labels) if y}
    fresh = list(reached)
    while fresh:
        for b in ways[fresh.pop()]:
            if b not in reached:
                reached.add(b)
                fresh.append(b)
    begins = sorted((s, e) for _, s, e in nodes.spans)
    last = np.maximum.accumulate([e for _, e in begins])
    out, run = [], []
    for k in range(len(labels) + 1):
        fits = k < len(labels) and labels[k] and not nodes.labels[k]
        if run and not (fits and labels[k] == labels[run[-1]] and nodes.joined[k - 1]):
            if not reached.isdisjoint(run):
                a, b = _trim(text, nodes.tokens[run[0]][0], nodes.tokens[run[-1]][1])
                before = bisect_left(begins, (b,))  # spans that begin before the end
                if a < b and not (before and last[before - 1] > a):
                    out.append((labels[run[0]] - 1, a, b))
            run = []
        if fits:
            run.append(k)
    return out


FOUND = "doc_id long, spans array<struct<kind:int,start:long,end:long,base:boolean>>"
#: Less than any sum of weights: a match's label is known.
_NEVER = -1e4


def field(model: Model, texts: list[Nodes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own potentials, edges and factors of the field over all nodes of some texts."""
    own, edges, at = [], {"chain": [], "equal": [], "near": []}, 0
    for nodes in texts:
        x = model.shapes[[shape(t[2]) for t in nodes.tokens]].reshape(-1, LABELS)
        near = np.array(nodes.joined, bool)
        x = x + model.left * ~np.concatenate([[False], near])[: len(x), None] + model.right * ~np.concatenate([near, [False]])[: len(x), None]
        known = np.flatnonzero(nodes.labels)
        clamped = np.full((len(known), LABELS), _NEVER)
        clamped[np.arange(len(known)), np.array(nodes.labels, int)[known]] = 0
        x[known] = clamped
        own.append(x)
        for name, pairs in (("chain", nodes.chain()), ("equal", nodes.equal()), ("near", nodes.similar)):
            edges[name] += [(a + at, b + at) for a, b in pairs]
        at += len(x)
    listed = [np.array(pairs, int).reshape(-1, 2) for pairs in edges.values()]
    factors = [np.broadcast_to(getattr(model, name), (len(pairs), LABELS, LABELS)) for name, pairs in zip(edges, listed, strict=True)]
    return np.concatenate(own) if own else np.zeros((0, LABELS)), np.concatenate(listed), np.concatenate(factors)


def _find(model: Model, least: float):
    def infer(batch: list[tuple[str, Nodes]]) -> Iterator[tuple[list, list]]:
        """Base and added spans of texts whose nodes form one field."""
        p, at = marginals(*field(model, [nodes for _, nodes in batch])), 0
        for text, nodes in batch:
            yield nodes.spans, added_spans(text, nodes, p[at : at + len(nodes.tokens)], least)
            at += len(nodes.tokens)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(batch.num_rows)]
            held: list[tuple[int, str, Nodes]] = []

            def settle() -> None:
                for (i, _, _), (base, more) in zip(held, infer([(t, n) for _, t, n in held]), strict=True):
                    spans = [(*s, True) for s in base] + [(*s, False) for s in more]
                    out[i] = [dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in sorted(spans)]
                held.clear()

            waiting = 0
            for i, text in _texts(batch):
                if text is not None:
                    held.append((i, text, nodes := Nodes(text)))
                    waiting += len(nodes.tokens)
                    if waiting > 20_000:
                        settle()
                        waiting = 0
            settle()
            kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    return find


def find_spans(docs: DataFrame, model: Model | None = None, least: float = 0.5) -> DataFrame:
    """doc_id and all spans of each whole text, by kind and start; offsets are code points.

    A null text is empty, and an empty one has no spans. Null ids and repeated rows give a row each;
    other columns, whatever their names, are not read. A very long text is one field by itself, in
    time and memory in proportion to it. An empty table gives an empty one.
    """
    model = model or train(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find(model, least), FOUND)


def joined(spans) -> F.Column:
    """kind:start:end of spans, comma-joined."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))


def sha256_of(spans: list[tuple[int, int, int]]) -> str:
    """The digest of spans as the query gives it."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()

"""Personal data: a character BiLSTM with a CRF, trained in NumPy, beside exact patterns.

The model labels characters with the kind of span they belong to. Texts are cut into
overlapping windows around every admissible character; each window is decoded on its
own by the CRF, and the decoded spans are reconciled over the whole text: where windows
disagree, the one in which a span lies farthest from the edges decides.

A span is admissible only if it holds a digit or an at sign, so windows without one have
nothing to decode and are not run. This is a rule of the method, not of its input size.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.llm.bpe import slices

#: Kinds in the order in which spans are listed; the first four have exact patterns.
KINDS = ("email", "ip", "card", "phone", "secret")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local@domain, found from their at signs."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the exact patterns by kind, then start; failing matches are dropped."""
    found = list(emails(text))
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def joined(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{i}:{j}" for k, i, j in order)


# --- characters -----------------------------------------------------------------------

_ALPHABET = 128 + 3


def codes(text: str) -> np.ndarray:
    """ASCII as itself; other letters, other digits and all else as three more symbols."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.minimum(points, 130).astype(np.int64)
    for k in np.flatnonzero(points > 127):
        c = text[k]
        out[k] = 128 if c.isalpha() else 129 if c.isdigit() else 130
    return out


# --- labelled spans -------------------------------------------------------------------


def _word(r: random.Random) -> str:
    return "".join(r.choice("abcdefghiklmnoprstuvwzäéñß") for _ in range(r.randint(1, 9)))


def _prose(r: random.Random, n: int) -> str:
    words = [_word(r) for _ in range(n)]
    if r.random() < 0.3:  # numbers that are nobody's
        words.insert(r.randint(0, n), r.choice([str(r.randint(0, 99999)), f"{r.randint(1, 9)}.{r.randint(0, 9)}", f"{r.randint(1, 31)}.{r.randint(1, 12)}.{r.randint(1900, 2040)}", f"{r.randint(0, 9)},{r.randint(100, 999)}", f"§{r.randint(1, 99)}", f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"page={r.randint(1, 99)}", f"@{_word(r)}"]))
    text = " ".join(words)
    return text.capitalize() if r.random() < 0.3 else text


def _value(r: random.Random, kind: str) -> str:
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    if kind == "email":
        name = r.choice([".", "_", "-", ""]).join(_ascii(r) for _ in range(r.randint(1, 2))) + digits(r.choice([0, 0, 2, 3]))
        host = ".".join(_ascii(r) + digits(r.choice([0, 0, 1])) for _ in range(r.randint(1, 2)))
        return f"{name}{r.choice(['@', '@', '@', ' @ '])}{host}.{r.choice(['com', 'org', 'net', 'de', 'fr'])}"
    if kind == "ip":
        return ".".join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        body = digits(r.choice([12, 14, 15, 15, 15, 18]))
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = r.choice(["", "", " ", "-"])
        return sep.join(body[i : i + 4] for i in range(0, len(body), 4)) if sep else body
    if kind == "phone":
        a, b, c, d = str(r.randint(1, 49)), digits(3), digits(3), digits(4)
        return r.choice([f"+{a} ({b}) {c}-{d}", f"+{a} {b} {c} {d}", f"+{a}-{b}-{c}-{d}", f"+{a}{b}{c}{d}", f"({b}) {c}-{d}"])
    return "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64])))


def _ascii(r: random.Random) -> str:
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8)))


def labelled_snippets(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Invented sentences around invented values, with the values' spans."""
    r, out = random.Random(seed), []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(0, 2)):
            kind = r.choice(KINDS)
            if not spans or r.random() < 0.7:
                text += _prose(r, r.randint(1, 5)) + r.choice([" ", " ", ": ", "\n", " (", ", "])
            value = _value(r, kind)
            if kind == "secret":
                text += r.choice(["token = \"", "key: ", "password=", "secret = '", "token "])
            spans.append((kind, len(text), len(text) + len(value)))
            text += value + r.choice(["", ".", ", ", " ", "!!", "###", "\"", "%%%", ")", "$$$"])
            if text[-1] not in " " and r.random() < 0.8:
                text += " "
        out.append((text + _prose(r, r.randint(1, 5)), spans))
    return out


# --- the model ------------------------------------------------------------------------

# Labels: 0 outside; 1 + 2k begins a span of kind k, 2 + 2k goes on with it.
N_LABELS = 1 + 2 * len(KINDS)
_BAD = -1e4


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def allowed() -> tuple[np.ndarray, np.ndarray]:
    """Penalties of label pairs and of first labels that no span can have."""
    pair, first = np.zeros((N_LABELS, N_LABELS), np.float32), np.zeros(N_LABELS, np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        first[inside] = _BAD
        for a in range(N_LABELS):
            if a not in (inside - 1, inside):
                pair[a, inside] = _BAD
    return pair, first


@dataclass
class Model:
    """One LSTM per direction over character embeddings, label scores, CRF transitions."""

    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, hidden: int, seed: int) -> Model:
        g = np.random.default_rng(seed)
        w = {}
        for d in ("f", "b"):
            w[f"x{d}"] = g.normal(0, 0.3, (_ALPHABET, 4 * hidden))
            w[f"x{d}"][:, hidden : 2 * hidden] += 1  # remember by default
            w[f"h{d}"] = g.normal(0, 0.6 / np.sqrt(hidden), (hidden, 4 * hidden))
        w["o"], w["ob"] = g.normal(0, 0.3, (2 * hidden, N_LABELS)), np.zeros(N_LABELS)
        w["t"] = np.zeros((N_LABELS, N_LABELS))
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def _lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States (time, row, hidden) for characters x (row, time), and what training needs."""
        w, u = self.weights[f"x{d}"], self.weights[f"h{d}"]
        n, steps = x.shape
        hidden = len(u)
        h = c = np.zeros((n, hidden), np.float32)
        out, trace = np.zeros((steps, n, hidden), np.float32), []
        for t in range(steps) if d == "f" else reversed(range(steps)):
            z = w[x[:, t]] + h @ u
            s = _sigmoid(z[:, : 3 * hidden])
            i, f, o, g = s[:, :hidden], s[:, hidden : 2 * hidden], s[:, 2 * hidden :], np.tanh(z[:, 3 * hidden :])
            before = (h, c)
            c = f * c + i * g
            th = np.tanh(c)
            h = o * th
            out[t] = h
            trace.append((t, before, i, f, o, g, th))
        return out, trace

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Label scores (row, time, label)."""
        both = np.concatenate([self._lstm(x, "f")[0], self._lstm(x, "b")[0]], 2)
        return (both @ self.weights["o"] + self.weights["ob"]).transpose(1, 0, 2)

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best label sequence of every row by the CRF; positions past a row's length are outside."""
        pair, first = allowed()
        step = self.weights["t"] + pair
        e = self.scores(x)
        n, steps, _ = e.shape
        best, back = e[:, 0] + first, np.zeros((steps, n, N_LABELS), np.int8)
        for t in range(1, steps):
            all_ = best[:, :, None] + step
            back[t] = all_.argmax(1)
            new = all_.max(1) + e[:, t]
            live = (t < lengths)[:, None]
            best = np.where(live, new, best)
            back[t] = np.where(live, back[t], np.arange(N_LABELS, dtype=np.int8))
        out, now, rows = np.zeros((n, steps), np.int8), best.argmax(1), np.arange(n)
        for t in reversed(range(steps)):
            out[:, t] = now
            now = back[t][rows, now]
        out[np.arange(steps) >= lengths[:, None]] = 0
        return out

    def train(self, data: list[tuple[str, list[Span]]], epochs: int, rate: float = 0.01, batch: int = 64, seed: int = 0) -> Model:
        """Adam on the CRF's negative log-likelihood."""
        rows = sorted(data, key=lambda r: len(r[0]))
        batches = [rows[i : i + batch] for i in range(0, len(rows), batch)]
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v = {k: np.zeros_like(x) for k, x in self.weights.items()}
        order, step = random.Random(seed), 0
        for epoch in range(epochs):
            order.shuffle(batches)
            for part in batches:
                grads, step = self._gradients(part), step + 1
                lr = rate * (0.3 if epoch >= epochs - 2 else 1)
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.weights[k] = (self.weights[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def _gradients(self, part: list[tuple[str, list[Span]]]) -> dict[str, np.ndarray]:
        steps = max(len(t) for t, _ in part)
        n = len(part)
        x, y, live = np.zeros((n, steps), np.int64), np.zeros((n, steps), np.int64), np.zeros((n, steps), bool)
        for r, (text, spans) in enumerate(part):
            x[r, : len(text)], live[r, : len(text)] = codes(text), True
            for kind, i, j in spans:
                k = KINDS.index(kind)
                y[r, i], y[r, i + 1 : j] = 1 + 2 * k, 2 + 2 * k
        forward, tf = self._lstm(x, "f")
        backward, tb = self._lstm(x, "b")
        both = np.concatenate([forward, backward], 2)
        e = (both @ self.weights["o"] + self.weights["ob"]).astype(np.float64)  # (time, row, label)
        pair, first = allowed()
        trans = self.weights["t"].astype(np.float64) + pair
        alpha = np.zeros((steps, n, N_LABELS))
        alpha[0] = e[0] + first
        for t in range(1, steps):
            new = _logsum(alpha[t - 1][:, :, None] + trans, 1) + e[t]
            alpha[t] = np.where(live[:, t, None], new, alpha[t - 1])
        z = _logsum(alpha[-1], 1)
        beta = np.zeros((steps, n, N_LABELS))
        for t in range(steps - 2, -1, -1):
            new = _logsum(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(live[:, t + 1, None], new, 0)
        de = np.exp(alpha + beta - z[None, :, None])
        de *= live.T[:, :, None]
        dt = np.zeros_like(trans)
        for t in range(1, steps):
            p = np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None])
            dt += (p * live[:, t, None, None]).sum(0)
            rows = np.flatnonzero(live[:, t])
            np.add.at(dt, (y[rows, t - 1], y[rows, t]), -1)
        tt, rr = np.nonzero(live.T)
        np.add.at(de, (tt, rr, y[rr, tt]), -1)
        de, dt = de / n, dt / n
        hidden = forward.shape[2]
        grads = {"t": dt, "o": np.einsum("tnh,tnl->hl", both, de), "ob": de.sum((0, 1))}
        dh = (de @ self.weights["o"].T.astype(np.float64)).astype(np.float32)
        for d, trace, part_dh in (("f", tf, dh[:, :, :hidden]), ("b", tb, dh[:, :, hidden:])):
            gx, gu = np.zeros_like(self.weights[f"x{d}"]), np.zeros_like(self.weights[f"h{d}"])
            u = self.weights[f"h{d}"]
            nh = nc = np.zeros((n, hidden), np.float32)
            for t, (h0, c0), i, f, o, g, th in reversed(trace):
                h = part_dh[t] + nh
                c = nc + h * o * (1 - th * th)
                dz = np.concatenate([c * g * i * (1 - i), c * c0 * f * (1 - f), h * th * o * (1 - o), c * i * (1 - g * g)], 1)
                np.add.at(gx, x[:, t], dz)
                gu += h0.T @ dz
                nh, nc = dz @ u.T, c * f
            grads[f"x{d}"], grads[f"h{d}"] = gx, gu
        return grads


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def fit(snippets: int = 1500, hidden: int = 16, epochs: int = 10, seed: int = 7) -> Model:
    """A model from ``snippets`` labelled sentences made from ``seed``; a few hundred kilobytes."""
    return Model.fresh(hidden, seed).train(labelled_snippets(snippets, seed), epochs, seed=seed)


# --- windows --------------------------------------------------------------------------

_TRIGGER = re.compile(r"[0-9@]")


@dataclass(frozen=True)
class Windows:
    """Windows of ``size`` characters start every ``step`` of them."""

    size: int = 96
    step: int = 48


def admissible(text: str, w: Windows) -> list[int]:
    """Starts of the windows that hold a digit or an at sign."""
    starts, at = [], 0
    last = max(0, -(-(len(text) - w.size) // w.step)) * w.step
    while m := _TRIGGER.search(text, at):
        p = m.start()
        first = max(0, -(-(p - w.size + 1) // w.step)) * w.step
        for s in range(max(first, starts[-1] + w.step if starts else 0), min(p, last) + 1, w.step):
            starts.append(s)
        at = max(p + 1, starts[-1] + w.step if starts and starts[-1] + w.step > p and starts[-1] < last else p + 1)
        if starts and starts[-1] == last:
            break
    return starts


def label_spans(labels: np.ndarray, offset: int) -> Iterator[Span]:
    row = labels.tolist()
    at = 0
    while at < len(row):
        if row[at] % 2 == 1:
            k, end = row[at] // 2, at + 1
            while end < len(row) and row[end] == row[at] + 1:
                end += 1
            yield KINDS[k], offset + at, offset + end
            at = end
        else:
            at += 1


def reconcile(candidates: list[tuple[Span, int]], text: str) -> list[Span]:
    """Non-overlapping spans: the larger margin to its window's edges wins, then the leftmost.

    Pieces of one kind that touch across windows become one span.
    """
    merged: list[list] = []
    for (kind, i, j), margin in sorted(candidates, key=lambda c: (c[0][1], c[0][2], c[0][0])):
        if merged and merged[-1][0] == kind and i < merged[-1][2] and (margin == 0 or merged[-1][3] == 0):
            merged[-1][2], merged[-1][3] = max(j, merged[-1][2]), max(margin, merged[-1][3])
        else:
            merged.append([kind, i, j, margin])
    kept: list[Span] = []
    for kind, i, j, _ in sorted(merged, key=lambda c: (-c[3], c[1], c[2], c[0])):
        if all(j <= a or b <= i for _, a, b in kept) and _TRIGGER.search(text, i, j):
            kept.append((kind, i, j))
    return sorted(kept, key=lambda s: s[1])


#: A decoded span counts only if it looks like its kind at all (see ``plausible``).
SHAPE = {
    "email": re.compile(r"[^\s@]+ ?@ ?[^\s@]+\.[^\s@]+"),
    "ip": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[ -]?[0-9]){12,18}"),
    "phone": re.compile(r"[+(]?[0-9][0-9 ().-]{7,20}[0-9]"),
    "secret": re.compile(r"(?=[^ ]*[0-9])(?=[^ ]*[A-Za-z])[A-Za-z0-9_+/=-]{16,}"),
}


def plausible(text: str, span: Span) -> bool:
    kind, i, j = span
    if not SHAPE[kind].fullmatch(text, i, j):
        return False
    digits = _digits(text[i:j])
    return luhn(digits) if kind == "card" else len(digits) <= 15 if kind == "phone" else True


def model_spans(texts: list[str], model: Model, w: Windows = Windows(), rows: int = 512) -> list[list[Span]]:
    """Spans that the model finds, reconciled per text."""
    jobs = [(k, s) for k, t in enumerate(texts) for s in admissible(t, w)]
    found: list[list] = [[] for _ in texts]
    for at in range(0, len(jobs), rows):
        part = jobs[at : at + rows]
        lengths = np.array([min(w.size, len(texts[k]) - s) for k, s in part])
        x = np.zeros((len(part), w.size), np.int64)
        for r, (k, s) in enumerate(part):
            x[r, : lengths[r]] = codes(texts[k][s : s + w.size])
        labels = model.decode(x, lengths)
        for r in np.flatnonzero(labels.any(1)):
            k, s = part[r]
            end = s + int(lengths[r])
            for span in label_spans(labels[r, : lengths[r]], s):
                left = span[1] - s if s else w.size
                right = end - span[2] if end < len(texts[k]) else w.size
                found[k].append((span, min(left, right)))
    return [[s for s in reconcile(c, t) if plausible(t, s)] if c else [] for c, t in zip(found, texts, strict=True)]


def all_spans(text: str, base: list[Span], model: list[Span]) -> list[Span]:
    """The base spans, and the model's that overlap none of them."""
    return base + [s for s in model if all(s[2] <= i or j <= s[1] for _, i, j in base)]


def find(documents: DataFrame, model: Model | None = None, windows: Windows = Windows(), chars: int = 500_000) -> DataFrame:
    """One row per document: doc_id, text, base and spans (arrays of kind, start, end; code points).

    Every row is read whole, in windows; null is the empty text and has no spans. All
    work is done row by row, without a shuffle; repeated rows each give a row, other
    columns are not read. Without a model one is trained on the driver, from
    generated sentences, and sent with the task.
    """
    trained = model or fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for i, j in slices(texts, chars):
                part = texts[i:j]
                base = [base_spans(t) for t in part]
                more = model_spans(part, trained, windows)
                every = [all_spans(*x) for x in zip(part, base, more, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(part, pa.string()), _array(base), _array(every)],
                    names=["doc_id", "text", "base", "spans"],
                )

    given = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    span = "array<struct<kind:string,start:int,end:int>>"
    return given.mapInArrow(run, f"doc_id long, text string, base {span}, spans {span}")


def redacted(documents: DataFrame, model: Model | None = None, windows: Windows = Windows(), chars: int = 500_000) -> DataFrame:
    """The documents with their personal data replaced by its kind, and all other columns as they are.

    ``n_chars``, if there is one, follows the new text. Null texts stay null.
    """
    trained = model or fit()
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(at).to_pylist()
            texts = [t or "" for t in given]
            for i, j in slices(texts, chars):
                part = texts[i:j]
                more = model_spans(part, trained, windows)
                new = [redact(t, all_spans(t, base_spans(t), m)) for t, m in zip(part, more, strict=True)]
                columns = [c.slice(i, j - i) for c in batch.columns]
                columns[at] = pa.array([None if g is None else n for g, n in zip(given[i:j], new, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = documents.withColumn("text", F.col("text").cast("string"))
    out = out.mapInArrow(run, out.schema)
    if "n_chars" not in out.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType))


def _array(spans: list[list[Span]]) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    order = lambda s: (KINDS.index(s[0]), s[1], s[2])
    return pa.array([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in sorted(s, key=order)] for s in spans], kind)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans by the first."""
    out, at = [], 0
    for kind, i, j in sorted(spans, key=lambda s: (s[1], -s[2])):
        if i >= at:
            out += [text[at:i], f"<{kind}>"]
            at = j
        elif j > at:
            at = j
    return "".join([*out, text[at:]])

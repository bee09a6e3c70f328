"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages, and only the bag has a label. Every passage of the whole text is
encoded; a gated attention, learned from the document labels alone, weighs the passages; the
weighted passage representation is scored. Passages whose encoding tells good from bad get the weight,
so a long document is not judged by its average.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.llm.common import Scratch, prepare
from triloom.llm.memory import release, trimmed
from triloom.llm.op04_language_id import held_out
from triloom.llm.shingles import word_hashes

#: Words of a passage, and bytes after which a passage ends in any case.
WORDS, BYTES = 64, 4096
#: Bound of what is fitted on, in labelled documents; all passages of each count.
FIT_DOCS = 6000
#: Documents of a task that sums gradients, bags' passages it holds at once, and steps of the fit.
SHARE, PASSAGES, STEPS = 1500, 20_000, 40
#: Bytes of a text that are encoded at once.
SEGMENT = 1 << 20

# Byte classes: 0-25 letters by themselves after lower-casing would tell languages, so letters are
# classed by case only; each common mark has a class of its own.
_CLASS = np.full(256, 1, np.uint8)  # other ASCII
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 2, 3, 4, 5
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[0x0A] = 6
for _i, _c in enumerate(".,;:!?'\"-_()[]{}<>|*#$%&/@+=\\"):
    _CLASS[ord(_c)] = 7 + _i
_N = 7 + 30
#: Class pairs are folded into this many columns.
_PAIRS = 64
_FOLD = (np.arange(_N * _N) * 2654435761 % 2**32 >> 16) % _PAIRS  # of class pairs
WIDTH = _N + _PAIRS + 6


def passages(text: str | None) -> np.ndarray:
    """One row of WIDTH features for each passage of the whole text; a single row of zeros if it has no word.

    Texts are encoded in runs of passages of about SEGMENT bytes, so that a long one needs a few
    times its own size and no more.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    kind = _CLASS[data]
    space = (kind == 0) | (kind == 6)
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(data) else np.empty(0, np.intp)
    if not len(start):
        return np.zeros((1, WIDTH), np.float32)
    # A passage is a run of words; one of overlong words is cut by bytes.
    first = start[::WORDS].copy()
    first[0] = 0
    ends = np.append(first, len(data))
    if (np.diff(ends) > BYTES).any():
        first = np.concatenate([np.arange(a, b, BYTES) for a, b in zip(first, ends[1:], strict=True)]).astype(np.intp)
        ends = np.append(first, len(data))
    words = word_hashes(text)
    out, i = np.empty((len(first), WIDTH), np.float32), 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + SEGMENT, "right")) - 1)
        out[i:j, :-1] = _encoded(kind, start, words, first[i:j], int(ends[j]))
        i = j
    out[:, -1] = min(1.0, len(start) / 2000)
    return out


def _encoded(kind: np.ndarray, start: np.ndarray, words: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """All features but the last of the passages that begin at `first` and go on to `end`."""
    lo, n = int(first[0]), len(first)
    own, before = kind[lo:end].astype(np.intp), kind[max(lo, 1) - 1 : end - 1].astype(np.intp)
    of = np.zeros(end - lo, np.intp)
    of[first[1:] - lo] = 1
    of = np.cumsum(of)
    size = np.bincount(of, minlength=n).astype(np.float64)
    single = np.bincount(of * _N + own, minlength=n * _N).reshape(n, _N) / size[:, None]
    later = slice(len(own) - len(before), None)  # the text's first byte has none before it
    pair = np.bincount(of[later] * _PAIRS + _FOLD[before * _N + own[later]], minlength=n * _PAIRS).reshape(n, _PAIRS) / size[:, None]
    a, b = np.searchsorted(start, [lo, end])
    w, at = words[a:b], of[start[a:b] - lo]
    count = np.bincount(at, minlength=n).astype(np.float64)
    some = np.maximum(count, 1)
    again = (w[1:] == w[:-1]) & (at[1:] == at[:-1])
    same = np.bincount(at[1:], again, minlength=n) / some
    order = np.lexsort((w, at))
    ws, ps = w[order], at[order]
    distinct = (count - np.bincount(ps[1:], (ws[1:] == ws[:-1]) & (ps[1:] == ps[:-1]), minlength=n)) / some
    lines = np.bincount(of, own == 6, minlength=n) / some
    more = np.stack([same, distinct, np.minimum(size / some, 50) / 10, np.minimum(lines, 1), np.minimum(count, WORDS) / WORDS], axis=1)
    return np.concatenate([np.sqrt(single), np.sqrt(pair), more], axis=1)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


_NAMES = ("E", "e", "V", "U", "w", "c", "b")


class AttentionMIL:
    """h = tanh(x E + e); a = softmax over a bag of (tanh(h V) * sigmoid(h U)) w; score = sigmoid(sum(a h) c + b)."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 5):
        r = np.random.default_rng(seed)
        draw = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"E": draw(WIDTH, hidden), "e": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "b": np.zeros(1)}
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def _forward(self, x: np.ndarray, first: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        logit = (t * s) @ p["w"]
        n = np.diff(np.append(first, len(x)))
        z = np.exp(logit - np.repeat(np.maximum.reduceat(logit, first), n))
        a = z / np.repeat(np.add.reduceat(z, first), n)
        m = np.add.reduceat(a[:, None] * h, first, axis=0)
        return h, t, s, n, a, m, _sigmoid(m @ p["c"] + p["b"])

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.empty(0)
        first = np.cumsum([0, *(len(b) for b in bags[:-1])])
        return self._forward((np.concatenate(bags) - self.mean) / self.scale, first)[-1]

    def begin(self, sums: np.ndarray, squares: np.ndarray, rows: int, docs: int, positive: int) -> AttentionMIL:
        """Scale the features and set out from the share of positive labels, given sums over all passages."""
        self.mean = sums / rows
        self.scale = np.sqrt(np.maximum(squares / rows - self.mean**2, 0)) + 0.01
        y = positive / docs
        self.p["b"][0] = np.log((y + 1e-3) / (1 - y + 1e-3))
        self._m1, self._m2, self._step = {k: 0 * v for k, v in self.p.items()}, {k: 0 * v for k, v in self.p.items()}, 0
        return self

    def gradient(self, bags: list[np.ndarray], labels: list[int], docs: int) -> dict[str, np.ndarray]:
        """The part of the mean loss' gradient over `docs` documents that these bags give."""
        first = np.cumsum([0, *(len(b) for b in bags[:-1])])
        g = self._gradient((np.concatenate(bags) - self.mean) / self.scale, first, np.asarray(labels, float))
        return {k: v * (len(bags) / docs) for k, v in g.items()}

    def step(self, g: dict[str, np.ndarray], rate: float, decay: float = 1e-4) -> None:
        """One step of Adam by the whole gradient."""
        self._step += 1
        for k in self.p:
            v = g[k] + decay * self.p[k]
            self._m1[k], self._m2[k] = 0.9 * self._m1[k] + 0.1 * v, 0.99 * self._m2[k] + 0.01 * v**2
            self.p[k] = self.p[k] - rate * (self._m1[k] / (1 - 0.9**self._step)) / (np.sqrt(self._m2[k] / (1 - 0.99**self._step)) + 1e-8)

    def _gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h, t, s, n, a, m, out = self._forward(x, first)
        d = (out - y) / len(y)
        dm = np.repeat(d[:, None] * p["c"], n, axis=0)
        da = (dm * h).sum(axis=1)
        dl = a * (da - np.repeat(np.add.reduceat(a * da, first), n))
        dt, ds = dl[:, None] * p["w"] * s * (1 - t**2), dl[:, None] * p["w"] * t * s * (1 - s)
        dh = (dm * a[:, None] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h**2)
        return {"E": x.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": ((t * s) * dl[:, None]).sum(axis=0), "c": m.T @ d, "b": np.array([d.sum()])}


def bags(labelled: DataFrame) -> DataFrame:
    """(doc_id, label, rows, values): all encoded passages of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(2).to_pylist()):
                x = passages(text)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns[:2]), pa.array([len(x)], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["doc_id", "label", "rows", "values"])

    rows = labelled.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("label").cast("int").alias("label"), "text")
    return rows.mapInArrow(trimmed(run), "doc_id string, label int, rows long, values binary")


def _in_tasks(held: DataFrame, work) -> list[np.ndarray]:
    """work(bags, labels) summed over the bags of each task, a bounded number of passages at a time;
    one row of numbers for each task comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, own, labels, size = None, [], [], 0
        for batch in batches:
            for y, n, v in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if own and size + n > PASSAGES:
                    part = work(own, labels)
                    total, own, labels, size = part if total is None else total + part, [], [], 0
                own.append(np.frombuffer(v, np.float32).reshape(n, WIDTH))
                labels.append(y)
                size += n
        if own:
            part = work(own, labels)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    return [np.frombuffer(r["total"]) for r in held.select("label", "rows", "values").mapInArrow(trimmed(run), "total binary").collect()]


def _sums(own: list[np.ndarray], labels: list[int]) -> np.ndarray:
    x = np.concatenate(own).astype(np.float64)
    return np.concatenate([x.sum(axis=0), (x * x).sum(axis=0), [len(x), len(own), sum(labels)]])


def fit(held: DataFrame, steps: int = STEPS, rate: float = 0.06) -> AttentionMIL | None:
    """A model of all bags (label, rows, values): each step sums the gradients of all tasks, so the
    driver sees sums only and a task holds a bounded number of passages, or one document's."""
    sums = _in_tasks(held, _sums)
    if not sums:
        return None
    total = np.sum(sums, axis=0)
    rows, docs, positive = (int(x) for x in total[-3:])
    model = AttentionMIL().begin(total[:WIDTH], total[WIDTH : 2 * WIDTH], rows, docs, positive)
    shapes = {k: v.shape for k, v in model.p.items()}
    ends = np.cumsum([v.size for v in model.p.values()])[:-1]
    for k in range(steps):
        flat = np.sum(_in_tasks(held, lambda own, labels: np.concatenate([v.ravel() for v in model.gradient(own, labels, docs).values()])), axis=0)  # noqa: B023
        model.step({n: v.reshape(shapes[n]) for n, v in zip(_NAMES, np.split(flat, ends), strict=True)}, rate * (1 - k / steps))
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_docs: int = FIT_DOCS, scratch: Scratch | None = None) -> AttentionMIL | None:
    """A model fitted on at most `fit_docs` labelled documents, chosen by a hash of the id, and all
    their passages; None if no document has a label. Labels other than 0 and 1 are ignored; if a
    document has several, each counts."""
    scratch = scratch or Scratch(docs.sparkSession)
    chosen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(fit_docs)  # ids and labels only: a top-k, not a global sort
    chosen = scratch.cut(chosen, "chosen")
    rows = bags(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))  # at most fit_docs rows
    held = scratch.cut(rows.repartition(max(1, -(-fit_docs // SHARE)), F.xxhash64("doc_id")).sortWithinPartitions("doc_id", "label"), "bags")
    model = fit(held)
    scratch.free(chosen, held)
    return model


def score(docs: DataFrame, model: AttentionMIL | None, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted to all rows and columns of docs, from the whole text alone.
    Without a model every score is 0.5. Null, empty and blank texts are scored too, as one empty passage.
    Columns of docs that are called score or predicted give way to the new ones."""
    prepare(docs.sparkSession)

    @F.pandas_udf("double")
    def call(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            if model is None:
                yield pd.Series(0.5, index=t.index)
                continue
            out, held, size = [], [], 0
            for x in t:
                held.append(passages(x))
                size += len(held[-1])
                if size > 20_000:
                    out.append(model.scores(held))
                    held, size = [], 0
            yield pd.Series(np.concatenate([*out, model.scores(held)]))
        release()

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")]
    rows = docs.select(*kept, call(F.col(text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality_of_documents(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learns from labels that are not held out.

    Repeated rows are scored each by itself; a null doc_id is not held out and has no label. An
    empty table gives no rows; other columns are ignored and clash with nothing.
    """
    model = train(docs, labels.where(~held_out(F.col("doc_id"))), fit_docs=fit_docs, scratch=scratch)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return score(rows, model).select("doc_id", "held_out", "score", "predicted")

"""Language identification by a byte convolutional network in numpy.

Filters of widths 2, 3 and 4 slide over the bytes of a fixed-length window; each filter's largest response in the
window (max pooling) goes through a rectifier into a softmax layer. A filter is a table of weights per place and byte, so
a response is a sum of looked-up rows; for prediction the tables of neighbouring places are merged into tables of byte pairs,
which gives the same sums with half the look-ups. A text's prediction is the mean of its windows' log-probabilities, weighted by
their length, over the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices


WIDTHS = (2, 3, 4)
WINDOW = 192
FILTERS = 10
#: The training sample: at most so many documents of each language, and so many windows of each document.
SAMPLE_DOCUMENTS = 300
SAMPLE_WINDOWS = 6
HELD_BACK = 5
UNDETERMINED = "und"


def windows(data: bytes, size: int = WINDOW) -> np.ndarray:
    """The bytes in rows of ``size``, the last one filled up with zeros."""
    rows = max(1, -(-len(data) // size))
    out = np.zeros(rows * size, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(rows, size)


def lower(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


@dataclass
class ByteNet:
    languages: list[str]
    tables: list[np.ndarray]  # per width: [place, byte, filter]
    bias: np.ndarray
    weights: np.ndarray  # [feature, language]
    offset: np.ndarray
    #: The score under which a prediction is no language for sure; from held-back rows of the sample.
    limit: float = 0.0

    def __post_init__(self):
        self._pairs = None

    def _responses(self, x: np.ndarray, table: np.ndarray) -> np.ndarray:
        n = x.shape[1] - len(table) + 1
        return sum(part[x[:, i : i + n]] for i, part in enumerate(table))

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each filter's largest response, and where it is."""
        best, where = [], []
        for table in self.tables:
            r = self._responses(x, table)
            k = r.argmax(axis=1)
            where.append(k)
            best.append(np.take_along_axis(r, k[:, None, :], axis=1)[:, 0])
        return np.concatenate(best, axis=1) + self.bias, where

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each language for each window, from the merged tables."""
        if self._pairs is None:
            pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
            self._pairs = [
                [(0, pair(t[0], t[1])), *([(2, pair(t[2], t[3]))] if len(t) == 4 else [(2, t[2])] if len(t) == 3 else [])]
                for t in self.tables
            ]
        code = x[:, :-1].astype(np.uint16) << 8 | x[:, 1:]
        best = []
        for table, parts in zip(self.tables, self._pairs, strict=True):
            n = x.shape[1] - len(table) + 1
            r = sum(rows[(code if len(rows) == 65536 else x)[:, i : i + n]] for i, rows in parts)
            best.append(r.max(axis=1))
        return self._head(np.concatenate(best, axis=1) + self.bias)[1]

    def _head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(pooled, 0)
        z = hidden @ self.weights + self.offset
        z = z - z.max(axis=1, keepdims=True)
        return hidden, z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A language and a probability for each text: ``und`` and 0 for null and for texts without a letter."""
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        rows, counts, at = [], [], []
        for i, t in enumerate(texts):
            if t and self.languages and any(map(str.isalpha, t)):
                rows.append(windows(lower(t)))
                counts.append(len(rows[-1]))
                at.append(i)
        if not at:
            return names, scores
        x = np.concatenate(rows)
        logs = np.concatenate([self.log_probabilities(x[i : i + 512]) for i in range(0, len(x), 512)])
        logs *= (x != 0).sum(axis=1, keepdims=True)
        firsts = np.cumsum(counts) - counts
        total = np.add.reduceat(logs, firsts) / np.maximum(1, np.add.reduceat((x != 0).sum(axis=1), firsts))[:, None]
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for i, row in zip(at, p, strict=True):
            names[i], scores[i] = self.languages[int(row.argmax())], float(row.max())
        return names, scores


def train(texts: list[str], labels: list[str], epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteNet:
    """Adam on the cross-entropy of single windows. The same input gives the same network. No label: it predicts nothing."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    net = ByteNet(
        languages,
        [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), np.float32),
        rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    if not languages:
        return net
    rows, marks = [], []
    for t, label in zip(texts, labels, strict=True):
        own = windows(lower(t))
        own = own[np.linspace(0, len(own) - 1, min(len(own), SAMPLE_WINDOWS)).astype(int)]
        rows.append(own)
        marks += [languages.index(label)] * len(own)
    x, y = np.concatenate(rows), np.array(marks)
    # Shorter ones too, so that short texts are known.
    short = x.copy()
    short[np.arange(WINDOW)[None, :] >= rng.integers(8, WINDOW, len(x))[:, None]] = 0
    x, y = np.concatenate([x, short]), np.r_[y, y]
    params = [*net.tables, net.bias, net.weights, net.offset]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            xb, yb = x[order[i : i + batch]], y[order[i : i + batch]]
            pooled, where = net.pooled(xb)
            hidden, logs = net._head(pooled)
            d = np.exp(logs)
            d[np.arange(len(yb)), yb] -= 1
            d /= len(yb)
            back = (d @ net.weights.T) * (pooled > 0)
            grads = []
            for k, (table, w) in enumerate(zip(net.tables, where, strict=True)):
                g, own = np.zeros_like(table), back[:, k * FILTERS : (k + 1) * FILTERS]
                for place in range(len(table)):
                    np.add.at(g[place], (np.take_along_axis(xb, w + place, axis=1), np.arange(FILTERS)[None, :]), own)
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ d, d.sum(axis=0)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net._pairs = None
    return net


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learned from: crc32(doc_id as text) mod 5 is 0 (a null id's text is empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _window_texts(text: Column) -> Column:
    """At most SAMPLE_WINDOWS parts of a text of WINDOW characters each, evenly spread: all that training looks at."""
    last = F.greatest(F.lit(0), F.ceil(F.length(text) / WINDOW) - 1)
    at = lambda i: F.floor(last * i / (SAMPLE_WINDOWS - 1)).cast("int") * WINDOW + 1
    parts = F.array_distinct(F.array(*[F.struct(at(i).alias("at"), F.substring(text, at(i), F.lit(WINDOW)).alias("part")) for i in range(SAMPLE_WINDOWS)]))
    return F.transform(parts, lambda p: p["part"])


def fit(documents: DataFrame) -> ByteNet:
    """Train on a bounded sample of the learnable rows: SAMPLE_DOCUMENTS of each language, those with the least hash of the id.

    Languages are the lang values of learnable rows; they are assumed to be a few hundred at most. Null and blank texts are
    left out of the sample. Rows that repeat count once. Every HELD_BACK-th row is not learned from but sets the limit of ``accepted``: a quarter of the way from
    an even guess to the least score that such a row has with a right prediction, so that it leaves much room below all of them. Of each text at most SAMPLE_WINDOWS parts of WINDOW characters come to the driver.
    """
    rows = documents.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(
        F.col("lang").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("string")).alias("_order")
    )
    # Spark keeps the first rows of each language in every task, so no language's rows meet in one.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_order"))
    least = rows.select("lang", "_order", rank.alias("_rank")).where(F.col("_rank") <= SAMPLE_DOCUMENTS)
    limits = least.groupBy("lang").agg(F.max("_order").alias("most")).collect()
    if not limits:
        return train([], [])
    within = F.lit(False)
    for r in limits:
        within = within | ((F.col("lang") == r["lang"]) & (F.col("_order") <= r["most"]))
    chosen = rows.where(within & F.col("text").isNotNull()).where("trim(text) <> ''").select("lang", "_order", _window_texts(F.col("text")).alias("parts"))
    found = sorted((r["lang"], r["_order"], r["parts"]) for r in chosen.groupBy("lang", "_order").agg(F.min("parts").alias("parts")).collect())
    parts = [(r[0], p) for i, r in enumerate(found) if i % HELD_BACK for p in r[2] if p.strip()]
    net = train([p for _, p in parts], [lang for lang, _ in parts])
    held = [(r[0], "".join(r[2])) for i, r in enumerate(found) if i % HELD_BACK == 0]
    scores = [s for (lang, _), name, s in zip(held, *net.predict([t for _, t in held]), strict=True) if lang == name]
    if scores:
        net.limit = 0.75 / len(net.languages) + 0.25 * min(scores)
    return net


def predict(documents: DataFrame, net: ByteNet) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document's whole text; ``und`` and 0 without a text or a letter.

    Rows may repeat; a null doc_id counts as the empty string for held_out. Other columns are not looked at. An empty table
    gives an empty result; a network that has learned no language predicts ``und``.
    """
    net._pairs = None
    shared = documents.sparkSession.sparkContext.broadcast(net)  # its size is fixed by FILTERS and the languages

    def run(batches):
        for b in slices(batches):
            names, scores = shared.value.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    given = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(documents: DataFrame) -> DataFrame:
    """``predict`` by a network that is fitted on the same table; equal texts are predicted alike."""
    return predict(documents, fit(documents))


def accepted(documents: DataFrame, net: ByteNet, least: float | None = None) -> DataFrame:
    """The documents, all columns, whose prediction is a language with a score of ``least`` (the network's own limit) or more.

    Rows are judged one by one, so repeated rows and ids are no matter; null, empty and letterless texts go. An empty table stays empty.
    """
    net._pairs = None
    shared = documents.sparkSession.sparkContext.broadcast(net)
    least = net.limit if least is None else least
    at = documents.columns.index("text")

    def run(batches):
        for b in slices(batches):
            names, scores = shared.value.predict(b.column(at).to_pylist())
            yield b.filter(pa.array([n != UNDETERMINED and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)

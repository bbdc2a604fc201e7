"""Language ID: a byte convolutional network over fixed-length windows, trained in numpy, applied to whole texts.

Filters of WIDTHS bytes (a weight for each position, byte and filter), rectified, max-pooled over a window of WINDOW bytes, then softmax.
Training: about ROWS labelled rows of each label, drawn by a hash of id and text, whole; of all their windows about WINDOWS / labels of each label, drawn by
a hash of row and place (documented bounds of the fit alone); classes weigh alike, so a label of few rows is learned like the others. The table of rows
by label is collected: its size is the number of labels. Only text and lang are learned from, and only text is looked at in a prediction.
Inference: the whole text, as UTF-8 with A-Z lower-cased, is cut into windows, the last one padded; windows go through the network in batches
of BATCH, so memory is bounded whatever the text's length; a text's probabilities are its windows' mean, weighted by their bytes.

Defined results: und with score 0 where the text is null or has no letter, and everywhere if there is nothing to learn from; a row whose doc_id
is null isn't held out and isn't learned from; repeated rows get equal results; ties go to the label that sorts first.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, packed, share_of, small_batches, table, tidy, worker_state

UNKNOWN = "und"
WIDTHS, FILTERS, WINDOW, BATCH = (2, 3, 4), 16, 192, 64
ROWS, WINDOWS, LEAST, EPOCHS, STEP, SEED = 500, 16_000, 200, 4, 0.02, 3


@dataclass
class Network:
    labels: list[str]
    filters: list[np.ndarray]  # for each width: position, byte, filter
    biases: list[np.ndarray]
    dense: np.ndarray  # feature, label
    bias: np.ndarray

    def tables(self) -> list[tuple[list[tuple[int, np.ndarray]], np.ndarray]]:
        """For inference, weights of two positions as one table over byte pairs: (position, table) and bias by width."""
        if not hasattr(self, "_tables"):
            self._tables = []
            for w, b in zip(self.filters, self.biases):
                pairs = [(k, (w[k][:, None] + w[k + 1][None]).reshape(65536, -1).astype(np.float32)) for k in range(0, len(w) - 1, 2)]
                if len(w) % 2:
                    pairs.append((len(w) - 1, w[-1].astype(np.float32)))
                self._tables.append((pairs, b.astype(np.float32)))
        return self._tables

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """windows (n, WINDOW) of bytes to (n, labels)."""
        out = []
        for at in range(0, len(windows), BATCH):
            x = np.ascontiguousarray(windows[at : at + BATCH].T).astype(np.int64)
            two = x[:-1] * 256 + x[1:]
            pooled = []
            for pairs, b in self.tables():
                n = WINDOW - (pairs[-1][0] + (1 if len(pairs[-1][1]) == 256 else 2)) + 1
                total = None
                for k, t in pairs:
                    part = t[(x if len(t) == 256 else two)[k : k + n]]
                    total = part if total is None else np.add(total, part, out=total)
                pooled.append(np.maximum(total.max(axis=0) + b, 0))
            out.append(_softmax(np.concatenate(pooled, axis=1) @ self.dense + self.bias))
        return np.concatenate(out)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(text: str | bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text and the number of its bytes in each."""
    raw = (text if isinstance(text, bytes) else text.encode()).lower()
    n = max(1, -(-len(raw) // WINDOW))
    sizes = np.full(n, WINDOW)
    sizes[-1] = len(raw) - WINDOW * (n - 1)
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW), sizes


def train(texts: list[str | bytes], langs: list[str], seed: int = SEED, epochs: int = EPOCHS) -> Network | None:
    """A network from labelled texts, or single windows of them as bytes, by Adam on the cross entropy of windows; the gradient of max pooling reaches one position."""
    labels = sorted(set(langs))
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    parts = [(w, labels.index(y)) for t, y in zip(texts, langs) for w in windows_of(t)[0]]
    x, y = np.stack([p[0] for p in parts]).astype(np.int64), np.array([p[1] for p in parts])
    weight = len(y) / (len(labels) * np.maximum(1, np.bincount(y, minlength=len(labels))))[y]
    net = Network(labels, [rng.normal(0, 0.3, (w, 256, FILTERS)) for w in WIDTHS], [np.zeros(FILTERS) for _ in WIDTHS], rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(labels))), np.zeros(len(labels)))
    params = [*net.filters, *net.biases, net.dense, net.bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 128):
            own = order[at : at + 128]
            b, pooled, where = x[own], [], []
            for w, bias in zip(net.filters, net.biases):
                n = WINDOW - len(w) + 1
                z = sum(w[k][b[:, k : k + n]] for k in range(len(w)))
                p = z.argmax(axis=1)
                where.append(p)
                pooled.append(np.take_along_axis(z, p[:, None], 1)[:, 0] + bias)
            raw = np.concatenate(pooled, axis=1)
            h = np.maximum(raw, 0)
            d = _softmax(h @ net.dense + net.bias)
            d[np.arange(len(own)), y[own]] -= 1
            d *= weight[own][:, None] / len(own)
            dh = (d @ net.dense.T) * (raw > 0)
            grads = []
            for i, (w, p) in enumerate(zip(net.filters, where)):
                g = dh[:, i * FILTERS : (i + 1) * FILTERS]
                f = np.arange(FILTERS)[None]
                at_byte = [(k * 256 + np.take_along_axis(b, p + k, 1)) * FILTERS + f for k in range(len(w))]
                grads.append(sum(np.bincount(a.ravel(), g.ravel(), w.size) for a in at_byte).reshape(w.shape))
            grads += [dh[:, i * FILTERS : (i + 1) * FILTERS].sum(axis=0) for i in range(len(WIDTHS))] + [h.T @ d, d.sum(axis=0)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= STEP * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, rows: int = ROWS, windows: int = WINDOWS) -> Network | None:
    """A network from the labelled rows of documents that aren't held out: about `rows` rows of each label, about `windows` windows in all (LEAST of a label at least)."""
    h = lambda *key: F.pmod(F.xxhash64(*key), F.lit(2**52))
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    known = known.select("lang", h("doc_id", "text").alias("_h"), F.col("text").cast("binary").alias("_raw"))
    pieces = F.greatest(F.lit(1), F.ceil(F.octet_length("_raw") / WINDOW)).cast("int")

    def bound(counts: dict[str, int], most: int) -> Column:
        """Whether _h is under the bound of the row's label."""
        shares = {k: int(2**52 * share_of(most, n)) for k, n in counts.items()}
        return F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("lang")) > F.col("_h")

    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    drawn = known.where(bound(counts, rows))
    each = max(LEAST, windows // len(counts))
    of_label = {r.lang: r.n for r in drawn.groupBy("lang").agg(F.sum(pieces).alias("n")).collect()}
    cut_up = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.substr("_raw", i * WINDOW + 1, F.lit(WINDOW)))
    parts = drawn.select("lang", F.col("_h").alias("_row"), F.posexplode(cut_up).alias("_pos", "_piece")).select("lang", h("_row", "_pos").alias("_h"), "_piece")
    parts = parts.where(bound(of_label, each)).limit(2 * each * len(counts)).collect()
    parts.sort(key=lambda r: (r.lang, r["_h"], bytes(r["_piece"])))
    return train([bytes(r["_piece"]) for r in parts], [r.lang for r in parts])


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with _lang and _score, which replace columns of these names; rows stay where they are."""
    shared, key = docs.sparkSession.sparkContext.broadcast(network), ("language", uuid.uuid4().hex)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net = worker_state(key, lambda: shared.value and replace(shared.value))  # its tables go with the state
        for texts in batches:
            out = []
            for text in texts:
                if net is None or not text or not any(map(str.isalpha, text)):
                    out.append((UNKNOWN, 0.0))
                    continue
                x, sizes = windows_of(text)
                p = sizes @ net.probabilities(x) / sizes.sum()
                best = int(p.argmax())
                out.append((net.labels[best], float(min(1.0, p[best]))))
            yield pd.DataFrame(out, columns=["lang", "score"])

    small_batches(docs.sparkSession)

    @F.pandas_udf("struct<lang:string,score:double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidy(run)(batches)

    found = docs.select(packed(docs).alias("_row"), predict(col(text_col)).alias("_new"))
    same = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("_lang", "_score")]
    return found.select(*same, F.col("_new.lang").alias("_lang"), F.col("_new.score").alias("_score"))


def op6_lang_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = identify(docs.select("doc_id", "text"), learn(docs))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))

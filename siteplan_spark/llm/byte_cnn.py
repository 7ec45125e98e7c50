"""Language identification by a convolutional network over bytes.

Bytes are embedded, filters of several widths slide over a fixed-length window, each filter keeps
its maximum, and a softmax over these maxima names the language. The network is trained in numpy
on a bounded sample of labelled texts. A whole text is cut into windows, and its prediction is
the mean of the windows' log probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Bytes of a window; the last window of a text is padded.
WINDOW = 256
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 16, 8
#: Labelled texts for each language, and windows of each text, that training uses at most.
TRAIN_ROWS, TRAIN_WINDOWS = 600, 4
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.01, 7
#: Windows that are scored together.
STACK = 128
_PAD = 256


def windows_of(text: bytes) -> np.ndarray:
    """(n, WINDOW) byte values of the whole text, padded at the end; at least one window."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.full(n * WINDOW, _PAD, np.int16)
    out[:len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


class Network:
    """Weights, forward pass and training."""

    def __init__(self, languages: list[str], seed: int = SEED):
        rng, self.languages = np.random.default_rng(seed), languages
        self.weights = {"embedding": rng.normal(0, 0.3, (257, EMBEDDING))}
        for w in WIDTHS:
            self.weights[f"filter{w}"] = rng.normal(0, 0.2, (w * EMBEDDING, FILTERS))
            self.weights[f"shift{w}"] = np.zeros(FILTERS)
        m = FILTERS * len(WIDTHS)
        self.weights["out"] = rng.normal(0, 0.2, (m, len(languages)))
        self.weights["bias"] = np.zeros(len(languages))
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def maxima(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, list]:
        """(n, filters) maxima after the rectifier, and the places they came from."""
        e = self.weights["embedding"][x]
        n, length = x.shape
        tops, places = [], []
        for w in WIDTHS:
            view = np.lib.stride_tricks.sliding_window_view(e, w, axis=1)  # n, l, E, w
            flat = view.transpose(0, 1, 3, 2).reshape(n * (length - w + 1), w * EMBEDDING)
            y = (flat @ self.weights[f"filter{w}"]).reshape(n, length - w + 1, FILTERS)
            if where:
                at = y.argmax(axis=1)
                places.append(at)
                top = np.take_along_axis(y, at[:, None, :], axis=1)[:, 0]
            else:
                top = y.max(axis=1)
            tops.append(np.maximum(top + self.weights[f"shift{w}"], 0))
        return np.concatenate(tops, axis=1), places

    def log_softmax(self, hidden: np.ndarray) -> np.ndarray:
        z = hidden @ self.weights["out"] + self.weights["bias"]
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def train(self, x: np.ndarray, label: np.ndarray) -> None:
        """Adam on the cross-entropy of single windows."""
        rng = np.random.default_rng(SEED)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
                step += 1
                for k, g in self._slopes(x[part], label[part]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.weights[k] -= (RATE * (first[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)

    def _slopes(self, x: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        n = len(x)
        hidden, places = self.maxima(x, where=True)
        miss = np.exp(self.log_softmax(hidden))
        miss[np.arange(n), label] -= 1
        miss /= n
        back = (miss @ self.weights["out"].T) * (hidden > 0)
        out = {"out": hidden.T @ miss, "bias": miss.sum(axis=0),
               "embedding": np.zeros_like(self.weights["embedding"])}
        rows = np.arange(n)[:, None]
        for i, w in enumerate(WIDTHS):
            b = back[:, i * FILTERS:(i + 1) * FILTERS]
            grams = np.stack([x[rows, places[i] + j] for j in range(w)], axis=2)  # n, F, w
            e = self.weights["embedding"][grams].reshape(n, FILTERS, w * EMBEDDING)
            out[f"filter{w}"] = np.einsum("nf,nfk->kf", b, e)
            out[f"shift{w}"] = b.sum(axis=0)
            share = np.einsum("nf,kf->nfk", b, self.weights[f"filter{w}"])
            np.add.at(out["embedding"], grams.reshape(-1), share.reshape(-1, EMBEDDING))
        return out

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """(n, languages): mean log probabilities over the windows of each whole text."""
        total = np.zeros((len(texts), len(self.languages)))
        count = np.zeros(len(texts))
        held, owner = [], []

        def score() -> None:
            x = np.concatenate(held)
            own = np.concatenate(owner)
            for i in range(0, len(x), STACK):
                p = self.log_softmax(self.maxima(x[i:i + STACK])[0])
                for c in range(p.shape[1]):
                    total[:, c] += np.bincount(own[i:i + STACK], p[:, c], len(texts))
            count[:] += np.bincount(own, minlength=len(texts))

        size = 0
        for i, text in enumerate(texts):
            x = windows_of(text)
            held.append(x)
            owner.append(np.full(len(x), i))
            size += len(x)
            if size >= 16 * STACK:
                score()
                held, owner, size = [], [], 0
        if held:
            score()
        return total / np.maximum(count, 1)[:, None]


def train_network(texts: DataFrame, key_col: str, text_col: str, lang_col: str,
                  per_language: int = TRAIN_ROWS) -> Network | None:
    """Fit on at most ``per_language`` texts of each language; None if there is no labelled text.

    The sample is the keys with the smallest hashes, so it does not depend on the order of rows. Languages are a small fixed set; each text gives up to TRAIN_WINDOWS
    windows, spread over its length.
    """
    named = texts.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.xxhash64(key_col).alias("h"))
    languages = sorted(r["lang"] for r in named.select("lang").distinct().collect())
    if not languages:
        return None
    picked = None
    for lang in languages:
        part = named.where(F.col("lang") == lang).orderBy("h").limit(per_language)
        picked = part if picked is None else picked.unionAll(part)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for text in batch.column(2).to_pylist():
                x = windows_of(text.encode())
                at = np.unique(np.linspace(0, len(x) - 1, TRAIN_WINDOWS).astype(int))
                parts.append(x[at].astype("<i2").tobytes())
            yield pa.record_batch({"lang": batch.column(0), "h": batch.column(1),
                                   "windows": pa.array(parts, pa.binary())})

    # at most per_language rows of each language: a proven bound for the broadcast
    rows = (texts.select(F.col(lang_col).alias("lang"), F.xxhash64(key_col).alias("h"),
                         F.col(text_col).alias("text"))
            .join(F.broadcast(picked.distinct()), ["lang", "h"])
            .where(F.col("text").rlike(r"\p{L}")).select("lang", "h", "text")
            .mapInArrow(cut, "lang string, h long, windows binary")
            .dropDuplicates(["lang", "h"]).collect())
    if not rows:
        return None
    rows.sort(key=lambda r: (r["h"], r["lang"], r["windows"]))
    x = [np.frombuffer(r["windows"], "<i2").reshape(-1, WINDOW) for r in rows]
    label = np.repeat([languages.index(r["lang"]) for r in rows], [len(p) for p in x])
    network = Network(languages)
    network.train(np.concatenate(x), label)
    return network


_PREDICTION = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])


def predict_language(text: Column, network: Network | None) -> Column:
    """(lang, score) of each whole text; ``und`` with score 0 without any letter or network.

    The score is the probability that the mean log probabilities give to the language.
    """
    @F.arrow_udf(_PREDICTION)
    def predict(column: pa.Array) -> pa.Array:
        lang, score = ["und"] * len(column), [0.0] * len(column)
        texts = column.to_pylist()
        known = [i for i, t in enumerate(texts) if network and t and any(map(str.isalpha, t))]
        if known:
            logs = network.predict([texts[i].encode() for i in known])
            for i, row in zip(known, logs):
                p = np.exp(row - row.max())
                best = int(p.argmax())
                lang[i], score[i] = network.languages[best], float(p[best] / p.sum())
        return pa.StructArray.from_arrays([pa.array(lang), pa.array(score, pa.float64())],
                                          names=["lang", "score"])

    return predict(text)


def identify_languages(docs: DataFrame, id_col: str, text_col: str,
                       network: Network | None) -> DataFrame:
    """(id, lang, score) for each row; repeated rows and null ids give a row each.

    Only the two named columns are read, so languages, sources and others are never inputs.
    """
    found = docs.select(F.col(id_col).alias("id"),
                        predict_language(F.col(text_col), network).alias("p"))
    return found.select("id", "p.lang", "p.score")

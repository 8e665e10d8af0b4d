"""Language identification by a byte convolutional network.

Texts are UTF-8 bytes in consecutive windows of WINDOW bytes, the last one padded with zeros.
Filters of several widths run over a window; each filter's largest response anywhere in it (at
least 0) is pooled, and a softmax layer turns the pooled responses into language probabilities.
A document's prediction is the language with the largest mean log probability over all its
windows; its score is that mean's share after normalisation.

Training is plain numpy on the driver, from a bounded sample: of the labelled documents that
`learn_from` lets pass, SAMPLE_DOCUMENTS a language, those with the smallest hash of id and text
(rows that are equal in both count once), and of each SAMPLE_WINDOWS windows evenly spread over the
whole text. Labels are few, as a network has an output for each. The weights are a few hundred
kilobytes whatever the corpus. Prediction reads every window of every text, on the executors.

Edge cases: a null id is an id like any other; very long texts are predicted whole, a batch of windows at a time; a text that is null or has no letter is `und` with score 0; if nothing is learned,
every text is; ties go to the language that sorts first; labels that are null teach nothing;
rows that repeat an id are predicted each; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from eventloom.llm.common import plainly_named

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
SAMPLE_DOCUMENTS = 500
SAMPLE_WINDOWS = 6
UNKNOWN = "und"
#: Windows that are run at once.
BATCH = 128


@dataclass
class ByteCnn:
    """The weights: for each width a table (offset, byte, filter), filter biases, and the softmax layer."""

    languages: list[str]
    tables: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    offset: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], rng: np.random.Generator) -> ByteCnn:
        tables = [rng.normal(0, 0.5 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        return cls(
            languages,
            tables,
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32),
            np.zeros(len(languages), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.biases, self.weights, self.offset]

    def _responses(self, x: np.ndarray, width: int) -> np.ndarray:
        table = self.tables[width]
        span = x.shape[1] - len(table) + 1
        out = table[0][x[:, :span]]
        for j in range(1, len(table)):
            out += table[j][x[:, j : j + span]]
        return out

    def train_step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The loss on windows x with labels y, and its gradients by parameter."""
        n = len(x)
        rows, cols = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
        places, pooled = [], []
        for w in range(len(WIDTHS)):
            out = self._responses(x, w)
            best = out.argmax(axis=1)
            places.append(best)
            pooled.append(out[rows, best, cols] + self.biases[w])
        hidden = np.concatenate(pooled, axis=1)
        active = np.maximum(hidden, 0)
        scores = _log_softmax(active @ self.weights + self.offset)
        delta = np.exp(scores)
        delta[np.arange(n), y] -= 1
        delta /= n
        back = (delta @ self.weights.T) * (hidden > 0)
        tables, biases = [], []
        for w, best in enumerate(places):
            part = back[:, w * FILTERS : (w + 1) * FILTERS]
            grad = np.zeros_like(self.tables[w])
            for j in range(len(grad)):
                np.add.at(grad[j], (x[rows, best + j], np.broadcast_to(cols, best.shape)), part)
            tables.append(grad)
            biases.append(part.sum(axis=0))
        return -float(scores[np.arange(n), y].mean()), [*tables, *biases, active.T @ delta, delta.sum(axis=0)]

    def predictor(self) -> Predictor:
        return Predictor(self)


class Predictor:
    """Inference with the tables of neighbouring bytes added up beforehand: two bytes a lookup."""

    def __init__(self, model: ByteCnn):
        self.model = model
        self.lookups = []
        for table in model.tables:
            pairs = [(j, (table[j][:, None, :] + table[j + 1][None, :, :]).reshape(65536, FILTERS)) for j in range(0, len(table) - 1, 2)]
            single = [(len(table) - 1, table[-1])] if len(table) % 2 else []
            self.lookups.append((len(table), pairs, single))

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """By window (rows of bytes) and language."""
        out = np.empty((len(x), len(self.model.languages)), np.float32)
        for at in range(0, len(x), BATCH):
            part = x[at : at + BATCH]
            pair = (part[:, :-1].astype(np.uint16) << 8) | part[:, 1:]
            pooled = []
            for (width, pairs, single), bias in zip(self.lookups, self.model.biases, strict=True):
                span = part.shape[1] - width + 1
                total = None
                for source, lookups in ((pair, pairs), (part, single)):
                    for j, table in lookups:
                        found = np.take(table, source[:, j : j + span], axis=0)
                        total = found if total is None else np.add(total, found, out=total)
                pooled.append(total.max(axis=1) + bias)
            out[at : at + BATCH] = _log_softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ self.model.weights + self.model.offset)
        return out


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def windows(data: bytes) -> np.ndarray:
    """The whole text as rows of WINDOW bytes."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


def fit(x: np.ndarray, labels: list[str], epochs: int = 12, rate: float = 0.02, seed: int = 5) -> ByteCnn | None:
    """A network trained on windows x with their languages, by Adam; None without examples."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    model = ByteCnn.fresh(languages, rng)
    y = np.searchsorted(languages, labels)
    # languages with fewer windows come up as often as the others
    by_language = [np.flatnonzero(y == k) for k in range(len(languages))]
    each = max(len(rows) for rows in by_language)
    first = [np.zeros_like(p) for p in model.parameters()]
    second = [np.zeros_like(p) for p in model.parameters()]
    step = 0
    for epoch in range(epochs):
        order = np.concatenate([rng.permutation(np.resize(rng.permutation(rows), each)) for rows in by_language])
        rng.shuffle(order)
        speed = rate * (1 - epoch / epochs)
        for at in range(0, len(order), 128):
            part = order[at : at + 128]
            step += 1
            _, grads = model.train_step(x[part], y[part])
            for p, g, m, v in zip(model.parameters(), grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (speed / (1 - 0.9**step)) * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return model


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "utf-8")), F.lit(4))


def train(docs: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteCnn | None:
    """The network learned from labelled documents; see the module for the sample's bound."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if learn_from is not None:
        labelled = labelled.where(learn_from)
    drawn = labelled.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("draw"), F.col(text_col).alias("text"))
    order = Window.partitionBy("lang").orderBy("draw")
    chosen = drawn.select("lang", "draw").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_DOCUMENTS).select("lang", "draw")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, data = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = windows(text.encode())
                for k in np.unique(np.linspace(0, len(rows) - 1, SAMPLE_WINDOWS).astype(int)):
                    labels.append(lang)
                    data.append(rows[k].tobytes())
            yield pa.RecordBatch.from_pydict({"lang": pa.array(labels, pa.string()), "data": pa.array(data, pa.binary())})

    # equal rows are combined before they are shuffled, so the sample holds SAMPLE_DOCUMENTS texts a language at most
    texts = drawn.join(F.broadcast(chosen), ["lang", "draw"], "left_semi").groupBy("lang", "draw").agg(F.first("text").alias("text"))
    found = sorted((row.lang, bytes(row.data)) for row in texts.select("lang", "text").mapInArrow(cut, "lang string, data binary").collect())
    if not found:
        return None
    return fit(np.frombuffer(b"".join(d for _, d in found), np.uint8).reshape(-1, WINDOW), [lang for lang, _ in found])


def predict(docs: DataFrame, model: ByteCnn | None, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score; input columns of these names are replaced."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("lang_pred", "score")))
    place, names = docs.columns.index(text_col), [*docs.columns, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = model.predictor() if model else None
        for batch in batches:
            texts = batch.column(place).to_pylist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            asked = [i for i, t in enumerate(texts) if predictor and t and any(map(str.isalpha, t))]
            for group in _groups(asked, texts):
                parts = [windows(texts[i].encode()) for i in group]
                logs = predictor.log_probabilities(np.concatenate(parts))
                ends = np.cumsum([len(p) for p in parts])
                sums = np.add.reduceat(logs.astype(np.float64), np.concatenate(([0], ends[:-1])), axis=0)
                shares = np.exp(_log_softmax(sums / np.diff(np.concatenate(([0], ends)))[:, None]))
                for i, share in zip(group, shares, strict=True):
                    best = int(share.argmax())
                    langs[i], scores[i] = model.languages[best], min(1.0, float(share[best]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema)


def recognised(docs: DataFrame, model: ByteCnn | None, least_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents with a language that the model is sure of by `least_score`, with their columns; those without a letter go."""
    docs, names = plainly_named(docs)
    sure = predict(docs, model, names[text_col]).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    return sure.select(*docs.columns).toDF(*names)


def _groups(asked: list[int], texts: list, most: int = 4 << 20) -> Iterator[list[int]]:
    """The rows in groups of about `most` characters."""
    group, held = [], 0
    for i in asked:
        group.append(i)
        held += len(texts[i])
        if held >= most:
            yield group
            group, held = [], 0
    if group:
        yield group


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row per input row; learned from the documents that are not held out."""
    model = train(docs, fold(id_col) != 2, id_col, text_col, lang_col)
    return predict(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model).select("doc_id", (fold("doc_id") == 2).alias("held_out"), "lang_pred", "score")

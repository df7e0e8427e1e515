"""Toxicity by a classifier chain over word-presence features.

Categories are predicted one after the other. Each has a logistic regression over the
words that tell it apart best, the text's length, and the probabilities of the earlier
categories; in training these are out-of-fold predictions, so a later model sees
earlier ones as wrong as they will be on new texts. Models are fitted on the driver
from a bounded sample of labelled rows; every document is then scored where it lies.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, row_slices, utf8

_WORDS = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+").findall


def text_words(text: bytes) -> tuple[int, set[bytes]]:
    """Number of words, and the distinct ones, A-Z lower-cased."""
    words = _WORDS(text.lower())
    return len(words), set(words)


@dataclass
class LinearModel:
    """Log-odds = bias + length * log(1 + words) + the weights of the words present + chain * earlier probabilities."""

    bias: float = -10.0
    length: float = 0.0
    words: dict[int, float] = field(default_factory=dict)
    chain: list[float] = field(default_factory=list)
    threshold: float = 0.5


def _hash(word: bytes) -> int:
    """32 bits, signed."""
    return zlib.crc32(word) - (1 << 31)


def _select(indptr: np.ndarray, items: np.ndarray, y: np.ndarray, n_features: int, most: int) -> np.ndarray:
    """The words whose presence says most of the class: greatest log-likelihood ratio, 10.8 at least (p < 0.001)."""
    row_y = np.repeat(y, np.diff(indptr))
    n_1, n_0 = float((y == 1).sum()), float((y == 0).sum())
    cells = []
    for label, n in ((1, n_1), (0, n_0)):
        there = np.bincount(items[row_y == label], minlength=n_features).astype(float)
        cells += [(there, n), (n - there, n)]
    present, absent = cells[0][0] + cells[2][0], cells[1][0] + cells[3][0]
    ratio = np.zeros(n_features)
    for (seen, n), column in zip(cells, (present, absent, present, absent), strict=True):
        expected = column * n / (n_1 + n_0)
        ratio += 2 * seen * np.log(np.where(seen > 0, seen / np.maximum(expected, 1e-12), 1))
    best = np.argsort(-ratio, kind="stable")[:most]
    return best[ratio[best] >= 10.8]


def _design(indptr: np.ndarray, items: np.ndarray, chosen: np.ndarray, n_features: int, dense: np.ndarray) -> np.ndarray:
    column = np.full(n_features, -1)
    column[chosen] = np.arange(len(chosen))
    rows = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    at = column[items]
    x = np.zeros((len(indptr) - 1, len(chosen) + dense.shape[1]))
    x[rows[at >= 0], at[at >= 0]] = 1
    x[:, len(chosen) :] = dense
    return x


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column is the bias and isn't penalised."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where the F1 of the out-of-fold predictions is greatest."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    k = int(f1.argmax())
    below = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + below) / 2)


def fit_chain(sizes: np.ndarray, words: list[np.ndarray], targets: dict[str, np.ndarray], folds: int = 3, most_words: int = 192) -> dict[str, LinearModel]:
    """One model for each category of ``targets`` (0/1 arrays), in its order.

    ``words`` has the word hashes of each text. A category with one class only gets a model of its
    share alone; without any text nothing is ever predicted."""
    # copies would count as evidence again and again
    first = sorted({w.tobytes(): i for i, w in reversed(list(enumerate(words)))}.values())
    sizes, words, targets = sizes[first], [words[i] for i in first], {name: y[first] for name, y in targets.items()}
    n = len(sizes)
    if not n:
        return {name: LinearModel(chain=[0.0] * i) for i, name in enumerate(targets)}
    indptr = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    vocabulary, items, count = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
    often = count >= 3
    renumber = np.cumsum(often) - 1
    keep = often[items]
    indptr = np.concatenate([[0], np.cumsum(keep)])[indptr]
    items, vocabulary = renumber[items[keep]], vocabulary[often]
    fold = np.arange(n) % folds
    models, earlier = {}, []
    for name, y in targets.items():
        dense = np.stack([np.log1p(sizes), *earlier, np.ones(n)], axis=1)
        if y.min() == y.max():
            share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
            models[name] = LinearModel(float(np.log(share / (1 - share))), 0.0, {}, [0.0] * len(earlier))
            earlier.append(np.full(n, share))
            continue
        score = np.zeros(n)
        for k in range(folds):
            train = np.flatnonzero(fold != k)
            own_items = np.concatenate([items[indptr[i] : indptr[i + 1]] for i in train]) if len(train) else items[:0]
            own_ptr = np.concatenate([[0], np.cumsum((indptr[1:] - indptr[:-1])[train])])
            chosen = _select(own_ptr, own_items, y[train], len(vocabulary), most_words)
            x = _design(indptr, items, chosen, len(vocabulary), dense)
            score[fold == k] = x[fold == k] @ _fit(x[train], y[train])
        chosen = _select(indptr, items, y, len(vocabulary), most_words)
        w = _fit(_design(indptr, items, chosen, len(vocabulary), dense), y)
        rest = w[len(chosen) :]
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        models[name] = LinearModel(float(rest[-1]), float(rest[0]), dict(zip(vocabulary[chosen].tolist(), w[: len(chosen)].tolist(), strict=True)), rest[1:-1].tolist(), _best_threshold(p, y))
        earlier.append(p)
    return models


def labelled_words(docs: DataFrame, labels: DataFrame, categories: dict[str, F.Column], max_labelled: int, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id"):
    """(sizes, word hashes, targets) of a hash sample of ``max_labelled`` labelled documents at most; of several
    texts with one id the first in their order counts."""
    known = labels.select(F.col(label_id_col).alias("label_id"), *[c.cast("int").alias(n) for n, c in categories.items()]).where("label_id is not null")
    known = known.groupBy("label_id").agg(*[F.max(n).alias(n) for n in categories]).dropna()
    # the count is of narrow rows; the sample is cut by hash, so it is the same on every run
    rate = min(1.0, 1.2 * max_labelled / max(1, known.count()))
    place = F.pmod(F.xxhash64("label_id", F.lit(11)), F.lit(1 << 30))
    drawn = known.where(place < int(rate * (1 << 30))).orderBy(place, "label_id").limit(max_labelled)

    names = list(categories)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            seen = [text_words(t) for t in utf8(part.column(1))]
            found = [sorted({_hash(w) for w in words}) for _, words in seen]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in seen], pa.int64()), pa.array(found, pa.list_(pa.int32())), part.column(0), *part.columns[2:]], ["size", "words", "doc_id", *names])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.join(drawn, F.col("doc_id") == F.col("label_id")).groupBy("doc_id", *names).agg(F.min("text").alias("text")).select("doc_id", "text", *names)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = texts.mapInArrow(run, f"size long, words array<int>, doc_id {kind}, " + ", ".join(f"{n} int" for n in categories)).toArrow().sort_by("doc_id")
    words = rows.column("words").combine_chunks()
    cut = words.offsets.to_numpy()
    values = words.values.to_numpy()
    return rows.column("size").to_numpy(), [values[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], {n: rows.column(n).to_numpy().astype(float) for n in categories}


def default_categories() -> dict[str, F.Column]:
    """The categories that ``labels`` has, in the order of the chain: texts of low quality, then toxic ones."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, F.Column] | None = None,
    verdict: str = "toxic",
    max_labelled: int = 10_000,
    into: str = "toxicity",
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
) -> DataFrame:
    """``docs`` with a struct column ``into`` added (replaced if there): the probability of each category
    and ``rejected``, whether that of ``verdict`` reaches its threshold.

    ``max_labelled`` bounds the labelled rows that are fitted on (a hash sample); all documents are
    scored on their whole texts. Null texts are empty, labels with nulls are left out, a document's
    repeated labels count as their greatest, and of repeated labelled rows one counts. Words that tell equally
    much are taken by their hash. Without labels nothing is rejected. All other columns and repeated
    rows are kept.
    """
    categories = categories or default_categories()
    models = fit_chain(*labelled_words(docs, labels, categories, max_labelled, id_col, text_col, label_id_col))
    places = {name: i for i, name in enumerate(models)}
    held = docs.drop(into)
    text = free_name(held, "scored_text")
    rows = held.withColumn(text, F.col(text_col).cast("string"))
    fields = [*[(n, pa.float64()) for n in models], ("rejected", pa.bool_())]
    kind = pa.struct(fields)
    every = {h for m in models.values() for h in m.words}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            out, p = np.zeros((part.num_rows, len(models))), np.zeros((part.num_rows, len(models)))
            for i, content in enumerate(utf8(part.column(part.num_columns - 1))):
                size, words = text_words(content)
                present = {h for h in map(_hash, words) if h in every}
                for no, m in enumerate(models.values()):
                    own = m.words
                    out[i, no] = m.bias + m.length * np.log1p(size) + sum([own[h] for h in present if h in own]) + float(np.dot(m.chain, p[i, :no]))
                    p[i, no] = 1 / (1 + np.exp(-min(30.0, max(-30.0, out[i, no]))))
            last = models[verdict]
            rejected = (p[:, places[verdict]] >= last.threshold) & bool(last.words)
            scores = pa.StructArray.from_arrays([*[pa.array(p[:, k]) for k in range(p.shape[1])], pa.array(rejected)], fields=[pa.field(n, t) for n, t in fields])
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], scores], schema=part.schema.set(part.num_columns - 1, pa.field(into, kind)))

    spec = "struct<" + ",".join(f"{n}:double" for n in models) + ",rejected:boolean>"
    return rows.mapInArrow(run, held.withColumn(into, F.lit(None).cast(spec)).schema)

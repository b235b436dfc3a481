"""Language identification: sparse multinomial logistic regression on TF-IDF of character
n-grams, trained by follow-the-regularised-leader with an elastic net, and calibrated by a
temperature.

Document frequencies cover all training documents. The regression is fitted on a bounded
sample of them (`SAMPLE_ROWS`, in hash order, and up to `LEAST_ROWS` of each language that
is rare in it), of which every fifth sets the temperature.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxlake.llm.common import bounded_sample, code_points, fold, hash_place, mix, slices, small_batches

ORDERS = (1, 2, 3)
PLACES = 1 << 14  # hashed n-grams
SAMPLE_ROWS = 5_000
LEAST_ROWS = 50  # of each language, if it has as many
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
UNKNOWN = "und"
ROWS_AT_ONCE = 256

_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    idf: np.ndarray
    labels: list[str]
    weights: np.ndarray  # PLACES x labels
    bias: np.ndarray
    temperature: float = 1.0


# ------------------------------------------------------------------ features

def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Place and text of every n-gram; runs of digits and signs stay as they are, letters
    are lower case, and each text begins and ends with a space."""
    codes, offsets = code_points([f" {t.lower()} " for t in texts])
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
    wide = codes.astype(np.uint64)
    places, owners = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(wide), dtype=np.uint64)
        for n in range(1, max(ORDERS) + 1):
            h = h[: len(wide) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + wide[n - 1 :] + np.uint64(n)
            if n in ORDERS:
                owner = rows[: len(h)]
                inside = owner == rows[n - 1 :]
                places.append((mix(h.copy()) >> np.uint64(50)).astype(np.int64)[inside])
                owners.append(owner[inside])
    return np.concatenate(places), np.concatenate(owners)


def counts(texts: list[str]) -> np.ndarray:
    """Dense counts, texts by places."""
    place, row = _grams(texts)
    return np.bincount(row * PLACES + place, minlength=len(texts) * PLACES).reshape(len(texts), PLACES)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """TF-IDF with logarithmic counts, of length 1."""
    x = np.log1p(counts(texts).astype(np.float32)) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _pieces(batches) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in small_batches(batches, "text"):
        for part in slices([1] * batch.num_rows, ROWS_AT_ONCE):
            piece = batch.slice(part.start, part.stop - part.start)
            yield piece, [t or "" for t in piece.column("text").to_pylist()]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Smoothed inverse document frequencies of the places over all rows of `docs`, and the
    number of these. Each
    task adds up its own before the shuffle; the driver gets one row for each place."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(PLACES, dtype=np.int64), 0
        for _, texts in _pieces(batches):
            place, row = _grams(texts)
            seen = np.zeros(len(texts) * PLACES, dtype=bool)
            seen[row * PLACES + place] = True
            total += seen.reshape(len(texts), PLACES).sum(axis=0)
            rows += len(texts)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, filled]), pa.array(np.r_[rows, total[filled]])], ["place", "n"])

    sums = docs.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    place, n = np.asarray(sums["place"]), np.asarray(sums["n"])
    df = np.zeros(PLACES)
    df[place[place >= 0]] = n[place >= 0]
    total = int(n[place < 0].sum())
    return (np.log((1 + total) / (1 + df)) + 1).astype(np.float32), total


# ------------------------------------------------------------------ training

def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (`PLACES` by `k`) and bias by follow-the-regularised-leader. `rows` are sparse
    vectors (places, values). The bias isn't penalised."""
    z, n = np.zeros((PLACES + 1, k)), np.zeros((PLACES + 1, k))
    penalty = np.ones((PLACES + 1, 1))
    penalty[PLACES] = 0.0

    def weights(at=slice(None)) -> np.ndarray:
        l1 = L1 * penalty[at]
        w = -(z[at] - np.sign(z[at]) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2 * penalty[at])
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    order = np.random.RandomState(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x = np.r_[rows[i][0], PLACES], np.r_[rows[i][1], 1.0]
            w = weights(at)
            error = softmax(x @ w)
            error[labels[i]] -= 1.0
            g = x[:, None] * error
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights()
    return w[:PLACES].astype(np.float32), w[PLACES]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden section on its log."""

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return float(-np.log(p[np.arange(len(labels)), labels] + 1e-12).mean())

    low, high, ratio = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def sample(usable: DataFrame) -> DataFrame:
    """The rows to learn from: `LEAST_ROWS` of each language that would have fewer in a plain
    sample (all, if it hasn't as many), and `SAMPLE_ROWS` of the others."""
    counts = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    total = sum(counts.values())
    rare = {lang: n for lang, n in counts.items() if n * SAMPLE_ROWS < LEAST_ROWS * total or n < LEAST_ROWS}
    # Rows of one hash are settled by the text, so that reruns and row orders agree.
    ties = F.xxhash64("text")
    common = usable if not rare else usable.filter(~F.col("lang").isin(list(rare)))
    chosen = bounded_sample(common, SAMPLE_ROWS, total - sum(rare.values()), 5, "doc_id", ties)
    if rare:
        # Of each language only a hash range for twice as many is gathered.
        place, span = hash_place("doc_id", 5)
        bounds = [F.lit(x) for lang, n in rare.items() for x in (lang, -(-2 * LEAST_ROWS * span // n))]
        few = usable.filter(place < F.create_map(*bounds)[F.col("lang")])
        number = F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id", ties))
        chosen = chosen.unionByName(few.withColumn("_number", number).filter(F.col("_number") <= LEAST_ROWS).drop("_number"))
    return chosen


def fit(training: DataFrame) -> Model | None:
    """The model of `doc_id, text, lang`; None without a row that has a text with a letter
    and a language."""
    usable = training.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    idf, _ = document_frequencies(usable)

    def sparse(batches) -> Iterator[pa.RecordBatch]:
        for piece, texts in _pieces(batches):
            x = vectors(texts, idf)
            filled = [np.flatnonzero(r).astype(np.int32) for r in x]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("place"),
                    piece.column("doc_id"),
                    piece.column("tie"),
                    piece.column("lang"),
                    pa.array([f.tobytes() for f in filled], pa.binary()),
                    pa.array([r[f].tobytes() for r, f in zip(x, filled)], pa.binary()),
                ],
                ["place", "doc_id", "tie", "lang", "places", "vals"],
            )

    place, _ = hash_place("doc_id", 5)
    ordered = sample(usable).select(place.alias("place"), F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("tie"), "lang", "text")
    schema = "place long, doc_id string, tie long, lang string, places binary, vals binary"
    rows = sorted(ordered.mapInArrow(sparse, schema).collect(), key=lambda r: (r.place, r.doc_id, r.tie))
    if not rows:
        return None
    labels = sorted({r.lang for r in rows})
    y = np.array([labels.index(r.lang) for r in rows])
    x = [(np.frombuffer(r.places, np.int32), np.frombuffer(r.vals, np.float32)) for r in rows]
    tuned = np.arange(len(x)) % 5 == 4
    tuned[np.unique(y, return_index=True)[1]] = False  # no language is without a row to learn
    learned = np.flatnonzero(~tuned)
    weights, bias = train([x[i] for i in learned], y[learned], len(labels))
    model = Model(idf, labels, weights, bias)
    if tuned.any():
        logits = np.stack([v @ weights[p] + bias for (p, v), t in zip(x, tuned) if t])
        model.temperature = temperature(logits, y[tuned])
    return model


# ------------------------------------------------------------------ prediction

def predict(texts: list[str], model: Model | None) -> tuple[list[str], np.ndarray]:
    lettered = [i for i, t in enumerate(texts) if _LETTER.search(t)]
    names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model and lettered:
        x = vectors([texts[i] for i in lettered], model.idf)
        p = softmax((x @ model.weights + model.bias) / model.temperature)
        for i, best, value in zip(lettered, p.argmax(axis=1), p.max(axis=1)):
            names[i], score[i] = model.labels[best], value
    return names, score


def identify(docs: DataFrame) -> DataFrame:
    """`doc_id, held_out, lang_pred, score` for each row of `docs` (`doc_id, text, lang`).
    Rows whose crc32(doc_id) mod 5 is 0, or without an id, are never learned from. Null
    texts and texts without letters are `und` with score 0, as is everything if there is
    nothing to learn from."""
    training = docs.select("doc_id", "text", "lang").filter(~fold(F.col("doc_id"), 5).isin(0, -1))
    model = fit(training)
    fields = model and (model.idf, model.labels, model.weights, model.bias, model.temperature)
    shared = docs.sparkSession.sparkContext.broadcast(fields)

    def label(batches) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value) if shared.value else None
        for piece, texts in _pieces(batches):
            names, score = predict(texts, known)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = rows.mapInArrow(label, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")

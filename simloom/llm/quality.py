"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words. Every passage is encoded (measures of its
characters and words, and a hashed bag of its words, through a learnt layer), a gated attention
gives each passage a weight, and the weighted mean of the encodings is scored. Only the document's
label is known in training; which passages speak for it is learnt.

The model is trained on the driver from at most `sample` labelled documents, those least by a hash
of their id, and at most `most_passages` passages of each, evenly spread over its whole text; texts
are encoded on the executors and only the passages' numbers come back. So what the driver holds is
bounded, whatever the texts' lengths. The model's size does not depend on the data, and it is
broadcast for scoring, which reads each text once and uses all of its passages.

Nulls: a null text scores like an empty one, whose bag is one passage without words; a label row
with a null id or label is not used; several labels of a document count each, with the text that is
least by its hash where rows with different texts share an id (ties: equal hashes, by text). With
labels of one class only, that class is every score; without any, nothing is known and every score
is 1, so that nothing is rejected. Repeated rows are scored each. Long texts are scored whole, a
worker holds CHUNK_BYTES of text or one text. Empty tables give empty results. Columns that are not
asked for are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .wordhash import Words, chunks

PASSAGE = 80
SAMPLE = 5000
#: Passages of a labelled document that are learnt from.
MOST_PASSAGES = 400
BUCKETS = 32
THRESHOLD = 0.7

_UPPER, _DIGIT, _SIGN, _HIGH, _LINE = range(5)


def _classes() -> np.ndarray:
    table = np.zeros((256, 5), dtype=bool)
    table[65:91, _UPPER] = 1
    table[48:58, _DIGIT] = 1
    for a, b in ((33, 48), (58, 65), (91, 97), (123, 127)):
        table[a:b, _SIGN] = 1
    table[128:, _HIGH] = 1
    table[10, _LINE] = 1
    return table


_CLASS = _classes()
WIDTH = 14 + BUCKETS


def passages(words: Words, data: np.ndarray, starts: np.ndarray, length: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(features, document number) of all passages of a chunk; a text without words has one empty passage."""
    n_words = np.diff(words.first)
    per = np.maximum(1, -(-n_words // length))
    doc = np.repeat(np.arange(len(per)), per)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    begin = words.first[:-1][doc] + k * length
    end = np.minimum(begin + length, words.first[1:][doc])
    count = (end - begin).astype(np.float64)
    out = np.zeros((len(doc), WIDTH), dtype=np.float32)
    full = count > 0
    if not full.any():
        return out, doc
    of = np.repeat(np.arange(len(doc)), (end - begin))
    size = words.size.astype(np.float64)
    safe = np.maximum(count, 1)

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=values, minlength=len(doc)) / safe

    length_mean = mean(size)
    same = np.zeros(len(words.hash))
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((words.hash, of))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (of[order][1:] != of[order][:-1]) | (words.hash[order][1:] != words.hash[order][:-1])
    distinct = np.bincount(of[order][new], minlength=len(doc)) / safe
    first_byte = np.zeros(len(doc), dtype=np.int64)
    last_byte = np.zeros(len(doc), dtype=np.int64)
    first_byte[full] = words.at[begin[full]]
    last_byte[full] = (words.at + words.size)[end[full] - 1]
    n_bytes = np.maximum(last_byte - first_byte, 1)
    shares = np.empty((len(doc), 5))
    for kind in range(5):
        total = np.concatenate(([0], np.cumsum(_CLASS[:, kind][data], dtype=np.int64)))
        shares[:, kind] = (total[last_byte] - total[first_byte]) / n_bytes
    head = data[words.at]
    tail = data[words.at + words.size - 1]
    out[:, 0] = np.log1p(count) / 5
    out[:, 1] = np.minimum(length_mean, 40) / 10
    out[:, 2] = np.sqrt(np.maximum(mean(size * size) - length_mean**2, 0)).clip(0, 40) / 10
    out[:, 3:8] = shares
    out[:, 8] = distinct
    out[:, 9] = mean(same)
    out[:, 10] = mean(_CLASS[head, _UPPER])
    out[:, 11] = mean(_CLASS[tail, _SIGN])
    out[:, 12] = mean(size <= 3)
    out[:, 13] = full
    bucket = (words.hash >> np.uint64(59)).astype(np.int64)
    out[:, 14:] = np.bincount(of * BUCKETS + bucket, minlength=len(doc) * BUCKETS).reshape(-1, BUCKETS) / safe[:, None]
    return out, doc


@dataclass
class Model:
    """mean, scale: of the features; W, b: encoding; V, U, w: gated attention; c, d: score."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def score(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return _forward(self.p, (x - self.mean) / self.scale, _first_of(doc))["s"]


@dataclass
class Constant:
    """Scores where labels of one class were seen only."""

    value: float

    def score(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return np.full(len(_first_of(doc)), self.value)


def _first_of(doc: np.ndarray) -> np.ndarray:
    """Where each document's passages begin; doc is ascending."""
    return np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(p: dict, x: np.ndarray, first: np.ndarray) -> dict:
    e = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(e @ p["V"]), _sigmoid(e @ p["U"])
    a = (t * g) @ p["w"]
    sizes = np.diff(np.append(first, len(x)))
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, first), sizes))
    a /= np.repeat(np.add.reduceat(a, first), sizes)
    z = np.add.reduceat(a[:, None] * e, first, axis=0)
    return {"e": e, "t": t, "g": g, "a": a, "z": z, "sizes": sizes, "s": _sigmoid(z @ p["c"] + p["d"])}


def _gradient(p: dict, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean log loss, by parameter."""
    f = _forward(p, x, first)
    ds = (f["s"] - y) / len(y)
    grad = {"c": f["z"].T @ ds, "d": ds.sum()}
    dz = np.repeat(ds[:, None] * p["c"], f["sizes"], axis=0)
    e, a = f["e"], f["a"]
    along = (dz * e).sum(axis=1)
    da = a * (along - np.repeat(np.add.reduceat(a * along, first), f["sizes"]))
    grad["w"] = (f["t"] * f["g"]).T @ da
    dh = da[:, None] * p["w"]
    dt, dg = dh * f["g"] * (1 - f["t"] ** 2), dh * f["t"] * f["g"] * (1 - f["g"])
    grad["V"], grad["U"] = e.T @ dt, e.T @ dg
    de = (dz * a[:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - e**2)
    grad["W"], grad["b"] = x.T @ de, de.sum(axis=0)
    return grad


def train(x: np.ndarray, doc: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 250, rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> Model:
    """Full-batch Adam on the log loss. x, doc: passages and their document's number; y: a label a document."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = ((x - mean) / scale).astype(np.float64)
    first = _first_of(doc)
    d = x.shape[1]
    p = {"W": rng.normal(0, d**-0.5, (d, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, 0.2, (hidden, 16)), "U": rng.normal(0, 0.2, (hidden, 16)), "w": rng.normal(0, 0.2, 16), "c": rng.normal(0, 0.2, hidden), "d": np.zeros(())}
    m, v = ({k: np.zeros_like(q) for k, q in p.items()} for _ in range(2))
    for step in range(1, epochs + 1):
        grad = _gradient(p, x, first, y)
        for k in p:
            g = grad[k] + (decay * p[k] if k in ("W", "V", "U") else 0)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, p)


def held_out(id_col: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(folds)) == fold


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, most_passages: int = MOST_PASSAGES) -> Model | Constant | None:
    """Learn from the labelled documents outside the held-out fold; at most `sample` of them. None without labels."""
    usable = labels.select(F.col(id_col).alias("id_"), F.col(label_col).cast("double").alias("y")).filter("id_ is not null and y is not null")
    usable = usable.filter(~held_out(F.col("id_"))).orderBy(F.md5(F.col("id_").cast("string")), "id_", "y").limit(sample).withColumn("l_", F.monotonically_increasing_id())
    texts = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    one = Window.partitionBy("l_").orderBy(F.xxhash64("text_"), "text_")
    rows = texts.join(F.broadcast(materialise(usable, "labels")), "id_").withColumn("at_", F.row_number().over(one)).filter("at_ = 1").select("id_", "y", "text_")
    id_type = rows.schema["id_"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, starts in chunks(batch, 2):
                x, doc = passages(Words(data, starts), data, starts)
                order = np.arange(len(doc)) - np.searchsorted(doc, doc)
                of = np.bincount(doc)[doc]
                # Of n passages the k-th stays where k * most / n passes a whole number.
                stays = (order * most_passages) // of != ((order - 1) * most_passages) // of
                stays |= of <= most_passages
                x, doc, order = x[stays], doc[stays], order[stays]
                at = pa.array(a + doc)
                packed = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(order, pa.int64()), packed], ["id_", "y", "k", "x"])

    got = rows.mapInArrow(run, f"id_ {id_type}, y double, k long, x binary").toPandas()
    if got.empty:
        return None
    if got["y"].nunique() < 2:
        return Constant(float(got["y"].iloc[0] > 0.5))
    # Another order of the rows must not change the model.
    got = got.sort_values(["id_", "y", "k", "x"], kind="stable").reset_index(drop=True)
    doc = np.cumsum((got["k"] == 0) & ~got.duplicated(["id_", "y", "k"])) - 1
    x = np.frombuffer(b"".join(got["x"]), dtype=np.float32).reshape(-1, WIDTH)
    y = got["y"].to_numpy()[_first_of(doc.to_numpy())]
    return train(x, doc.to_numpy(), (y > 0.5).astype(float))


def score(docs: DataFrame, model: Model | Constant | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """Columns: id, score, predicted (score >= threshold), and those in keep."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text_"), F.col(id_col).alias("id_"), *(F.col(c).alias(f"k{i}_") for i, c in enumerate(keep)))
    names = ["id_", *(f"k{i}_" for i in range(len(keep)))]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a, b, data, starts in chunks(batch, 0):
                s = model.score(*passages(Words(data, starts), data, starts)) if model else np.ones(b - a)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(1 + i) for i in range(len(names))), pa.array(s, pa.float64())], [*names, "score"])

    schema = ", ".join([*(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names), "score double"])
    out = rows.mapInArrow(run, schema)
    return out.select(F.col("id_").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(F.col(f"k{i}_").alias(c) for i, c in enumerate(keep)))

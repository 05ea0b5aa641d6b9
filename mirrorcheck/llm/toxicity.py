"""Toxicity by subword bags: n-gram embeddings, averaged over stretches of words, under a linear softmax.

Every word gives its character n-grams, with marks where it begins and ends, hashed into buckets; a misspelt word
shares most of them with the word as trained. A text is cut into stretches of a few words, since a slur in a
long text would vanish in the average over all of it. The most toxic stretch scores the text. Embeddings, softmax
and the choice of the stretch are trained jointly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import ALNUM, LOWER, as_bytes, sliced, slices

#: Bytes of texts that a task scores together; arrays of their n-grams take some hundred times as much.
AT_ONCE = 250_000


@dataclass
class Settings:
    """Bounds and sizes of the model. ``rows_per_class`` and ``longest`` bound the training sample: labelled rows of
    each class, in the order of a hash of their id, whose texts have at most ``longest`` characters."""

    buckets: int = 1 << 17
    size: int = 8
    sizes: tuple[int, ...] = (3, 4, 5)
    words: int = 24
    rows_per_class: int = 1500
    longest: int = 8_000
    epochs: int = 14
    batch: int = 32
    rate: float = 0.15
    decay: float = 1e-4
    seed: int = 7


@dataclass
class Model:
    settings: Settings
    embeddings: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    prior: float
    weights: np.ndarray = field(init=False)

    def __post_init__(self):
        #: What one n-gram adds to the difference of the two logits, before averaging.
        self.weights = (self.embeddings @ (self.softmax[1] - self.softmax[0])).astype(np.float32)

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability of the toxic class for each text; texts without words get the share of that class in training."""
        ids, stretch, rows = features(column, self.settings, ordered=False)
        n = len(column)
        best = np.full(n, -np.inf)
        if len(ids):
            sums = np.bincount(stretch, self.weights[ids], len(rows))
            counts = np.bincount(stretch, minlength=len(rows))
            logits = np.where(counts > 0, sums / np.maximum(counts, 1), -np.inf) + self.bias[1] - self.bias[0]
            np.maximum.at(best, rows, logits)
        out = np.full(n, self.prior)
        known = np.isfinite(best)
        out[known] = 1 / (1 + np.exp(-np.clip(best[known], -500, 500)))
        return out


def features(column: pa.Array, settings: Settings, ordered: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket and stretch of every n-gram, if wanted in order of stretches; row of every stretch)."""
    data, offsets = as_bytes(column)
    spread = np.full(len(data) + len(offsets), 32, np.uint8)  # one separator before each text and after the last
    spread[np.arange(len(data)) + np.repeat(np.arange(1, len(offsets)), np.diff(offsets))] = LOWER[data]
    inside = ALNUM[spread]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    word = np.cumsum(begins) - 1  # of the last word begun
    at = np.flatnonzero(begins)
    row = np.searchsorted(offsets + np.arange(len(offsets)), at, "right") - 1
    first = np.searchsorted(row, row)  # first word of the same row
    number = (np.arange(len(at)) - first) // settings.words
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
    stretch_of_word, rows = np.cumsum(new) - 1, row[new]
    ids, places = [], []
    letters = spread.astype(np.uint32) + np.uint32(1)
    letters[~inside] = 1
    for n in settings.sizes:
        last = len(spread) - n + 1
        if last <= 0:
            continue
        value = np.full(last, n, np.uint32)
        whole = np.ones(last, bool)
        for k in range(n):
            value *= np.uint32(16777619)
            value ^= letters[k:k + last]
            if 0 < k < n - 1:
                whole &= inside[k:k + last]
        where = np.flatnonzero(whole)
        value = value[where]
        value ^= value >> np.uint32(15)
        value *= np.uint32(2246822519)
        value ^= value >> np.uint32(13)
        ids.append((value & np.uint32(settings.buckets - 1)).astype(np.int32))
        places.append(stretch_of_word[word[where + 1]] if len(at) else np.zeros(0, np.int64))
    if not ids or not len(at):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids_all, stretch = np.concatenate(ids), np.concatenate(places)
    if not ordered:
        return ids_all, stretch, rows
    order = np.argsort(stretch, kind="stable")
    return ids_all[order], stretch[order], rows


def _bags(texts: list[str] | pa.Array | pa.ChunkedArray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams in order; where those of each stretch begin; which stretches each text has. Few texts at a time are cut.

    N-grams are written to one array, whose unused end takes no memory, since the driver would hold a list of parts and its whole at once.
    """
    column = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string())
    most = (pc.sum(pc.binary_length(column)).as_py() or 0) + 2 * len(column) + 1  # more than the places at which n-grams of one size can begin
    ids, n, sizes, counts = np.empty(most * len(settings.sizes), np.int32), 0, [], []
    for i in range(0, len(column), 32):
        part = column.slice(i, 32)
        own, stretch, rows = features(part, settings)
        ids[n:n + len(own)] = own
        n += len(own)
        sizes.append(np.bincount(stretch, minlength=len(rows)))
        counts.append(np.bincount(rows, minlength=len(part)))
    starts = [np.concatenate(([0], np.cumsum(np.concatenate(x)))).astype(np.int64) for x in (sizes, counts)]
    return ids[:n], *starts


def fit(texts: list[str] | pa.Array | pa.ChunkedArray, labels: np.ndarray, prior: float, settings: Settings) -> Model:
    """Train on texts in memory. ``prior``: share of the toxic class where the model is to be used.

    Each step takes some texts, finds the stretch of each that now looks most toxic, and moves the embeddings of
    its n-grams and the softmax by Adagrad. Texts of a class are weighted so that the classes stand as in ``prior``.
    With a single class or no text, every score is ``prior``.
    """
    draw = np.random.default_rng(settings.seed)
    embeddings = draw.normal(0, 0.1, (settings.buckets, settings.size)).astype(np.float32)
    softmax = np.zeros((2, settings.size), np.float32)
    softmax[1] = draw.normal(0, 0.5, settings.size)
    softmax[0] = -softmax[1]
    bias = np.zeros(2)
    if len(set(labels.tolist())) < 2:
        logit = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
        return Model(settings, embeddings, np.zeros_like(softmax), np.array([0, logit]), prior)
    ids, bounds, of_text = _bags(texts, settings)
    usable = np.flatnonzero(np.diff(of_text) > 0)
    weight = np.where(labels == 1, prior / labels.mean(), (1 - prior) / (1 - labels.mean()))
    seen_e, seen_w, seen_b = (np.full(x.shape, 1e-6) for x in (embeddings, softmax, bias))
    for epoch in range(settings.epochs):
        draw.shuffle(usable)
        for i in range(0, len(usable), settings.batch):
            some = usable[i:i + settings.batch]
            direction = softmax[1] - softmax[0]
            grads, parts, means, gs = [], [], [], []
            for t in some:
                lo, hi = of_text[t], of_text[t + 1]
                own = ids[bounds[lo]:bounds[hi]]
                sizes = np.diff(bounds[lo:hi + 1])
                values = embeddings[own] @ direction
                sums = np.add.reduceat(values, np.minimum(bounds[lo:hi] - bounds[lo], max(0, len(values) - 1))) if len(values) else np.zeros(hi - lo)
                logits = np.where(sizes > 0, sums / np.maximum(sizes, 1), -np.inf)
                # a toxic text learns from its worst stretch; a clean one from its worst and from any other
                for pick in {int(np.argmax(logits))} | ({int(draw.integers(hi - lo))} if labels[t] == 0 else set()):
                    if not sizes[pick]:
                        continue
                    bag = ids[bounds[lo + pick]:bounds[lo + pick + 1]]
                    p = 1 / (1 + np.exp(-np.clip(logits[pick] + bias[1] - bias[0], -60, 60)))
                    g = (p - labels[t]) * weight[t]
                    gs.append(g)
                    parts.append(bag)
                    grads.append(np.full(len(bag), g / len(bag), np.float32))
                    means.append(embeddings[bag].mean(axis=0))
            if not gs:
                continue
            touched, inverse = np.unique(np.concatenate(parts), return_inverse=True)
            amount = np.bincount(inverse, np.concatenate(grads))
            step = amount[:, None] * direction[None, :] + settings.decay * embeddings[touched] / len(usable)
            seen_e[touched] += step ** 2
            rate = settings.rate * (1 - epoch / settings.epochs)
            own_step = (np.array(gs)[:, None] * np.array(means)).sum(axis=0)
            embeddings[touched] -= (rate * step / np.sqrt(seen_e[touched])).astype(np.float32)
            both = np.stack([-own_step, own_step])
            seen_w += both ** 2
            softmax -= (rate * both / np.sqrt(seen_w)).astype(np.float32)
            total = np.array([-np.sum(gs), np.sum(gs)])
            seen_b += total ** 2
            bias -= rate * total / np.sqrt(seen_b)
    return Model(settings, embeddings, softmax, bias, prior)


def train(documents: DataFrame, labels: DataFrame, allowed: Column, settings: Settings | None = None) -> Model:
    """Fit on a bounded sample of the labelled documents for whose doc_id ``allowed`` holds (see Settings)."""
    settings = settings or Settings()
    known = labels.where(allowed & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    parts = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.rows_per_class) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    rows = (documents.select("doc_id", "text").where(F.length("text").between(1, settings.longest))
            .join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(3 * settings.rows_per_class)
            .select("text", "toxic").toArrow())
    return fit(rows.column("text"), np.array(rows.column("toxic").to_pylist(), np.int64), prior, settings)


def score_column(documents: DataFrame, model: Model, extra: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``extra`` and ``score`` of every row; whole texts are scored."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*[documents.schema[c] for c in extra], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, AT_ONCE):
            yield pa.RecordBatch.from_arrays([*[batch.column(f"_{i}") for i in range(len(extra))], pa.array(model.score(batch.column("text")))], [*extra, "score"])

    kept = [F.col(c).alias(f"_{i}") for i, c in enumerate(extra)]
    return documents.select(F.col("text").cast("string").alias("text"), *kept).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def toxicity_table(documents: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row per document: held_out, score and the class at 0.5. Null and empty texts get the share of toxic labels."""
    model = train(documents, labels, ~held_out(F.col("doc_id")), settings)
    return (score_column(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


def remove_toxic(documents: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The documents that score below 0.5, with all their columns, whatever their names.

    Rows go to Python once, and only those that stay come back. Null and empty texts score the share of
    toxic labels; texts of any length are scored whole; equal texts score alike; no documents or labels are no error.
    """
    model = train(documents, labels, ~held_out(F.col("doc_id")), settings)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    text = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, f"c{text}", AT_ONCE):
            yield batch.filter(pa.array(shared.value.score(batch.column(f"c{text}")) < 0.5))

    by_place = documents.toDF(*[f"c{i}" for i in range(len(documents.columns))])
    return by_place.mapInArrow(run, by_place.schema).toDF(*documents.columns)

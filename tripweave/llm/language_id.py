"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is its byte 2-, 3- and 4-grams inside words, with a blank at each end of a word; A-Z are
lower-cased and everything that is neither a letter of ASCII nor a byte over 127 counts as a blank.
Each gram hashes to one of `buckets` embeddings; their average goes through a linear softmax.
Training is stochastic gradient descent in numpy on a bounded sample of labelled documents: of each
language at most `sample` / languages documents, those with the smallest hash of identifier, and of
at most `longest` bytes. A tenth of the sample (by the same hash) is not trained on: there a
temperature calibrates the probability and the rejection threshold is set at the score that
`rejected_share` of correctly predicted documents would miss. Only buckets * classes weights reach the
executors: averaging and the linear layer commute, so embedding times weights is one table.

A text without a letter, empty and null ones too, is `und` with score 0 and rejected. Ties go to the
label that sorts first. Rows may repeat; each is predicted from its text alone. Without any labelled
row every text is `und`. An empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import bounded_batches

UNKNOWN = "und"
PIECE = 1 << 20
BLANK = re.compile(rb"[^A-Za-z\x80-\xff]")
LETTERS = np.full(256, 32, np.uint8)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def gram_buckets(text: bytes, buckets: int) -> np.ndarray:
    """Bucket of every 2-, 3- and 4-gram that has no blank inside."""
    data = LETTERS[np.frombuffer(b" " + text + b" ", np.uint8)]
    blank = data == 32
    keep = ~(blank[1:] & blank[:-1])
    data = np.append(data[:1], data[1:][keep]).astype(np.uint32)
    blank = data == 32
    out, value = [], data
    inner = np.zeros(len(data), bool)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    for size, factor in zip((2, 3, 4), FACTORS):
        if len(value) < 2:
            break
        value = (value[:-1] << np.uint32(8)) ^ data[size - 1 :] if size < 4 else (
            (value[:-1] << np.uint32(8)) | data[size - 1 :]
        )
        if size > 2:
            inner = inner[:-1] | blank[size - 2 : len(data) - 1]
        else:
            inner = np.zeros(len(value), bool)
        out.append(((value * factor) >> shift)[~inner])
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """A long text in parts that have the same grams together as the whole: cut at blanks only."""
    start = 0
    while len(text) - start > size:
        found = BLANK.search(text, start + size)
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end
    yield text[start:]


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # buckets x labels: embedding times weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: bytes) -> np.ndarray:
        total, count = np.zeros(len(self.labels)), 0
        for piece in pieces(text):
            grams = gram_buckets(piece, len(self.table))
            counts = np.bincount(grams, minlength=len(self.table)) if len(grams) > 4096 else None
            if counts is None:
                total += self.table[grams].sum(axis=0, dtype=np.float64)
            else:
                total += counts @ self.table
            count += len(grams)
        return total / max(1, count) + self.bias

    def predict(self, text: bytes) -> tuple[str, float]:
        p = softmax(self.logits(text) / self.temperature)
        best = int(np.argmax(p))
        return self.labels[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(
    rows: list[tuple[bytes, str, bool]],
    buckets: int = 1 << 15,
    dimensions: int = 16,
    steps: int = 1500,
    rate: float = 20.0,
    batch: int = 32,
    rejected_share: float = 0.001,
    seed: int = 7,
) -> Model:
    """Fit embeddings and softmax on rows (text, label, held back for calibration)."""
    rng = np.random.default_rng(seed)
    labels = sorted({label for _, label, _ in rows})
    grams = []
    for text, _, _ in rows:
        ids, counts = np.unique(gram_buckets(text, buckets), return_counts=True)
        grams.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    y = np.array([labels.index(label) for _, label, _ in rows])
    held = np.array([h for _, _, h in rows])
    embedding = rng.normal(0, 0.1, (buckets, dimensions)).astype(np.float32)
    weights = np.zeros((dimensions, len(labels)), np.float32)
    weights += rng.normal(0, 0.1, weights.shape)
    bias = np.zeros(len(labels), np.float32)
    trained = np.flatnonzero(~held)
    if len(trained) == 0:
        trained = np.arange(len(rows))
    waiting = np.empty(0, np.int64)
    for step in range(steps):
        now = rate * (1 - step / steps)
        if len(waiting) < batch:
            waiting = np.append(waiting, rng.permutation(trained))
        chosen, waiting = waiting[:batch], waiting[batch:]
        hidden = np.stack([share @ embedding[ids] for ids, share in (grams[i] for i in chosen)])
        error = softmax(hidden @ weights + bias)
        error[np.arange(len(chosen)), y[chosen]] -= 1
        error /= len(chosen)
        back = error @ weights.T
        weights -= now * hidden.T @ error
        bias -= 0.1 * error.sum(axis=0)
        for row, i in enumerate(chosen):
            ids, share = grams[i]
            embedding[ids] -= now * share[:, None] * back[row]
    model = Model(labels, embedding @ weights, bias)
    check = np.flatnonzero(held)
    if len(check) == 0:
        return model
    z = np.stack([share @ model.table[ids] for ids, share in (grams[i] for i in check)]) + bias
    steps = np.geomspace(0.05, 20, 60)
    losses = [-np.log(softmax(z / t)[np.arange(len(check)), y[check]] + 1e-12).mean() for t in steps]
    model.temperature = float(steps[int(np.argmin(losses))])
    p = softmax(z / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y[check]]
    if len(right):
        # never above the score of an even guess between two languages
        model.threshold = float(min(0.5, np.quantile(right, rejected_share)))
    return model


def labelled_sample(
    docs: DataFrame, sample: int, longest: int, id_column: str, text_column: str, label_column: str
) -> list[tuple[bytes, str, bool]]:
    """At most `sample` rows in all, an equal share by language, chosen by hash of identifier.

    The share of hashes below a bound is taken from exact counts by language, so only about the
    sampled rows leave the executors.
    """
    usable = docs.where(F.col(label_column).isNotNull()).where(
        F.octet_length(text_column).between(1, longest)
    )
    counts = {r[0]: r[1] for r in usable.groupBy(label_column).count().collect()}
    if not counts:
        return []
    each = max(1, sample // len(counts))
    place = F.pmod(F.xxhash64(F.col(id_column).cast("long")), F.lit(1_000_000))
    keep = F.lit(False)
    for label, count in counts.items():
        keep = keep | ((F.col(label_column) == label) & (place < int(1_000_000 * each / count) + 1))
    rows = usable.where(keep).select(
        F.col(text_column).cast("binary"), label_column, place % 10 == 0, place, F.xxhash64(text_column)
    )
    rows = rows.orderBy(place, F.xxhash64(text_column)).limit(sample).collect()
    return [(bytes(r[0]), r[1], bool(r[2])) for r in rows]


def judged(model: Model | None, texts: pa.Array, letters: pa.Array) -> list[tuple[str, float, bool]]:
    """Label, score and rejection of each text; letters: whether it has one."""
    out = []
    for text, letter in zip(texts.cast(pa.binary()), letters.to_pylist()):
        if model is None or not letter:
            out.append((UNKNOWN, 0.0, True))
        else:
            label, score = model.predict(text.as_py())
            out.append((label, score, score < model.threshold))
    return out


def has_letter(text_column: str):
    return F.coalesce(F.col(text_column).rlike(r"\p{L}"), F.lit(False))


def identify(
    docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = judged(shared.value, batch.column(1), batch.column(2))
            labels, scores, rejected = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(labels, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(rejected, pa.bool_()),
                ],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(text_column).alias("text"),
        has_letter(text_column).alias("letter"),
    ).mapInArrow(made, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(id_column: str = "doc_id", parts: int = 5):
    """Whether crc32 of the identifier as text leaves no remainder; a null identifier is held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % parts == 0, F.lit(True))


def learn(
    docs: DataFrame,
    sample: int = 6_000,
    longest: int = 20_000,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "lang",
) -> Model | None:
    """Model from documents that are not held out."""
    seen = docs.where(~held_out(id_column))
    rows = labelled_sample(seen, sample, longest, id_column, text_column, label_column)
    return train(rows) if rows else None


def language_stage(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows whose language is not rejected, with all their columns; nothing is shuffled."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(
        learn(docs, id_column=id_column, text_column=text_column)
    )
    place = docs.columns.index(text_column)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column(batch.num_columns - 1)
            out = judged(shared.value, batch.column(place), letters)
            stays = pa.array([not rejected for _, _, rejected in out], pa.bool_())
            rows = batch.filter(stays)
            yield pa.RecordBatch.from_arrays(rows.columns[:-1], rows.schema.names[:-1])

    marked = docs.withColumn("__letter", has_letter(text_column))
    return marked.mapInArrow(kept, docs.schema)

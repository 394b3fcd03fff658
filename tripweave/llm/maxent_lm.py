"""Hashed maximum-entropy language model with class-factored softmax.

Texts are lower-cased in A-Z and cut at blanks and control characters 9 to 13; one end token follows
the words of each text (null and empty texts: only the end). Token counts cover all training texts.
The most frequent tokens are units of their own; all others belong to the unit of their last three
bytes, one of `suffixes`. The probability of a token is

    P(class | context) * P(unit | class, token before) * P(token | unit).

The class softmax sums weights of hashed features: the word before, the skipped words two and three
back, and the pair of the two words before. It is trained by gradient updates on the executors: in
each round every task takes steps over its part of the training texts (each text serves in one
round), and the changes are averaged by row over the tasks that touched it. The unit softmax is fit
to the summed counts of (word before, unit) by iterative scaling with a penalty. Inside a unit
the count of the token decides, with 0.1 added, as in the unigram base score. Units are dealt to
classes by clustering their contexts. Counts grow with the corpus and stay in Spark; the driver and
the broadcasts hold `lookup` frequent tokens and tables of fixed size only. Tokens beyond them are
joined with the counts, so base scores are exact.

A null identifier is held out. Repeated rows are scored alike. An empty table gives an empty result;
other columns are neither read nor returned. Without training texts all probabilities are even.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import bounded_batches, free_shuffles, stored

END = b" "  # no word holds a blank
ADDED = 0.1
FLUSH = 400_000
STEP_TOKENS = 8192


@dataclass
class Settings:
    frequent: int = 4096
    suffixes: int = 512
    lookup: int = 65_536
    classes: int = 32
    columns: int = 128
    rows: int = 1 << 14  # at most 1 << 16
    rounds: int = 3
    rate: float = 0.3
    penalty: float = 100.0


@dataclass
class Vocabulary:
    """The most frequent tokens with counts, and the units' totals over all tokens."""

    settings: Settings
    tokens: dict[bytes, int]
    counts: np.ndarray
    total: int
    distinct: int
    unit_total: np.ndarray = field(default_factory=lambda: np.empty(0))
    unit_distinct: np.ndarray = field(default_factory=lambda: np.empty(0))

    @property
    def units(self) -> int:
        return self.settings.frequent + self.settings.suffixes

    def suffix_unit(self, token: bytes) -> int:
        return self.settings.frequent + zlib.crc32(token[-3:]) % self.settings.suffixes

    def numbers(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Numbers of all tokens of the texts, text ends, the tokens not in the lookup, their ends.

        A token of the lookup has its place there as number, another one minus its unit minus one.
        """
        words: list[bytes] = []
        ends = []
        for text in texts:
            words += (text or b"").lower().split()
            words.append(END)
            ends.append(len(words))
        get = self.tokens.get
        found = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        others = np.flatnonzero(found < 0)
        unknown = [words[i] for i in others]
        found[others] = [-1 - self.suffix_unit(w) for w in unknown]
        return found, np.array(ends, np.int64), unknown, np.searchsorted(others, ends)

    def units_of(self, numbers: np.ndarray) -> np.ndarray:
        return np.where(numbers < 0, -1 - numbers, self.unit_of[np.maximum(numbers, -1)])

    def prepare(self) -> Vocabulary:
        frequent = self.settings.frequent
        self.unit_of = np.array(
            [i if i < frequent else self.suffix_unit(w) for w, i in self.tokens.items()] + [0], np.int64
        )
        return self


@dataclass
class Model:
    classes: np.ndarray  # class of each unit
    bias: np.ndarray  # by class
    weights: np.ndarray  # rows of hashed features by class
    units: np.ndarray  # log P(unit | class, column of the word before)


def before(units: np.ndarray, starts: np.ndarray, back: int, none: int) -> np.ndarray:
    """Unit `back` positions before each token, `none` before the start of its text."""
    out = np.full(len(units), none, np.int64)
    out[back:] = units[:-back] if back else units
    place = np.arange(len(units)) - starts
    out[place < back] = none
    return out


def feature_rows(w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, rows: int) -> list[np.ndarray]:
    """Hashed rows of the word before, two skips and the pair before."""

    def row(kind: int, value: np.ndarray) -> np.ndarray:
        h = (value.astype(np.uint64) * np.uint64(4) + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(32)).astype(np.int64) & (rows - 1)

    return [row(0, w1), row(1, w2), row(2, w3), row(3, w1 * 1_000_003 + w2)]


def starts_of(ends: np.ndarray, n: int) -> np.ndarray:
    """Start of the text of each of n tokens."""
    begins = np.r_[0, ends[:-1]] if len(ends) else ends
    return np.repeat(begins, ends - begins)


def contexts(units: np.ndarray, ends: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, list[np.ndarray]]:
    starts = starts_of(ends, len(units))
    w1, w2, w3 = (before(units, starts, k, v.units) for k in (1, 2, 3))
    column = np.minimum(w1, v.settings.columns - 2)
    column[w1 == v.units] = v.settings.columns - 1
    return column, feature_rows(w1, w2, w3, v.settings.rows)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def class_logits(model: Model, rows: list[np.ndarray]) -> np.ndarray:
    out = model.weights[rows[0]] + model.bias
    for more in rows[1:]:
        out += model.weights[more]
    return out


def numbered(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, held_out, numbers of the tokens (int32 as bytes), and the tokens not in the lookup."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, ends, others, other_ends = vocabulary.value.numbers(batch.column(2).to_pylist())
            told = [x.tobytes() for x in np.split(numbers, ends[:-1])] if len(ends) else []
            offsets = pa.array(np.r_[0, other_ends].astype(np.int32))
            left = pa.ListArray.from_arrays(offsets, pa.array(others, pa.binary()))
            columns = [batch.column(0), batch.column(1), pa.array(told, pa.binary()), left]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "numbers", "others"])

    schema = "doc_id long, held_out boolean, numbers binary, others array<binary>"
    return docs.select("doc_id", "held_out", "text").mapInArrow(made, schema)


def numbers_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a batch's texts one after another, and the texts' ends."""
    told = column.to_pylist()
    ends = np.cumsum([len(x) // 4 for x in told], dtype=np.int64)
    return np.frombuffer(b"".join(told), np.int32).astype(np.int64), ends


def token_counts(docs: DataFrame) -> DataFrame:
    """token, count over all texts, counted in each task before the shuffle."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter = Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                counter.update((text or b"").lower().split())
                counter[END] += 1
            if len(counter) > FLUSH:
                yield rows(counter)
                counter = Counter()
        yield rows(counter)

    def rows(counter: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counter), pa.binary()), pa.array(list(counter.values()), pa.int64())],
            ["token", "count"],
        )

    partial = docs.mapInArrow(made, "token binary, count long")
    return partial.groupBy("token").agg(F.sum("count").alias("count"))


def least_count(words: DataFrame, wanted: int) -> float:
    """Count from which on `wanted` tokens or a few more are met; of very many ties none is taken.

    Read off a histogram of at most some 2,000 bins, so no partition sends its most frequent tokens
    to the driver.
    """
    exact, count = 1024, F.col("count")
    bin_of = F.when(count < exact, count).otherwise(exact + F.floor((F.log2(count) - 10) * 16)).cast("long")
    bins = sorted(map(tuple, words.groupBy(bin_of).agg(F.count("*"), F.min("count")).collect()), reverse=True)
    met, least = 0, math.inf
    for _, tokens, smallest in bins:
        if met >= wanted or met + tokens > 2 * wanted + exact:
            break
        met, least = met + tokens, smallest
    return least


def build_vocabulary(counts: DataFrame, settings: Settings) -> Vocabulary:
    """Frequent tokens (at most `lookup` rows) and totals by suffix unit (at most `suffixes`)."""
    words = counts.where(F.col("token") != END)
    least = least_count(words, settings.lookup - 1)
    top = [(bytes(t), c) for t, c in words.where(F.col("count") >= least).collect()]
    top = sorted(top, key=lambda x: (-x[1], x[0]))[: settings.lookup - 1]
    total, distinct, end = counts.agg(
        F.sum("count"), F.count("*"), F.sum(F.when(F.col("token") == END, F.col("count")))
    ).first()
    top = [(END, end or 0), *top]
    v = Vocabulary(
        settings,
        {token: i for i, (token, _) in enumerate(top)},
        np.array([c for _, c in top] + [0], np.float64),
        total or 0,
        distinct,
    )
    v.unit_total, v.unit_distinct = np.zeros(v.units), np.zeros(v.units)
    unit = F.crc32(F.expr("substring(token, -3, 3)")) % settings.suffixes + settings.frequent
    sums = counts.where(F.col("token") != END).groupBy(unit.alias("u")).agg(F.sum("count"), F.count("*"))
    for u, c, n in sums.collect():
        v.unit_total[u], v.unit_distinct[u] = c, n
    for i, (token, c) in enumerate(top):
        if i >= settings.frequent:
            break
        if token != END:
            v.unit_total[v.suffix_unit(token)] -= c
            v.unit_distinct[v.suffix_unit(token)] -= 1
        v.unit_total[i] = c
    return v.prepare()


def summed(docs: DataFrame, work: Callable, parts: int) -> dict[int, np.ndarray]:
    """Sum of numpy vectors, by part, that `work` makes of each task's batches.

    Each task emits its parts once; parts are added up one by one where they are dealt, so no more
    than one vector of a part is held. What reaches the driver has the size of one model.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in work(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([values.astype(np.float32).tobytes()], pa.binary())],
                ["part", "values"],
            )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = np.frombuffer(values, np.float32).astype(np.float64)
                sums[part] = sums[part] + new if part in sums else new
        for part, values in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([values.tobytes()], pa.binary())],
                ["part", "values"],
            )

    schema = "part int, values binary"
    dealt = docs.mapInArrow(made, schema).repartition(parts, "part").mapInArrow(added, schema)
    return {part: np.frombuffer(values, np.float64) for part, values in dealt.collect()}


def pair_counts(docs: DataFrame, shared, parts: int = 16) -> np.ndarray:
    """Counts of (column of the word before, unit) over all training texts."""

    def work(batches: Iterator[pa.RecordBatch]):
        v = shared.value
        size = v.settings.columns * v.units
        total = np.zeros(size)
        for batch in batches:
            numbers, ends = numbers_of(batch.column(0))
            units = v.units_of(numbers)
            column, _ = contexts(units, ends, v)
            total += np.bincount(column * v.units + units, minlength=size)
        yield from enumerate(np.array_split(total, parts))

    v = shared.value
    got = summed(docs, work, parts)
    split = np.array_split(np.zeros(v.settings.columns * v.units), parts)
    return np.concatenate([got.get(k, split[k]) for k in range(parts)]).reshape(v.settings.columns, -1)


def cluster(pairs: np.ndarray, classes: int, seed: int = 11) -> np.ndarray:
    """Class of each unit by k-means on the square roots of its context shares."""
    rng = np.random.default_rng(seed)
    weight = pairs.sum(axis=0)
    share = np.sqrt((pairs / np.maximum(weight, 1)).T)
    prior = np.sqrt(pairs.sum(axis=1) / max(1.0, pairs.sum()))
    sure = (weight / (weight + 50))[:, None]
    points = sure * share + (1 - sure) * prior
    centres = points[rng.choice(len(points), classes, replace=False, p=(weight + 1e-9) / (weight + 1e-9).sum())]
    for _ in range(25):
        distance = (centres**2).sum(axis=1) - 2 * points @ centres.T
        label = distance.argmin(axis=1)
        for c in range(classes):
            own = label == c
            if weight[own].sum() > 0:
                centres[c] = np.average(points[own], axis=0, weights=np.sqrt(weight[own] + 1e-9))
    return label


def fit_units(pairs: np.ndarray, classes: np.ndarray, v: Vocabulary) -> np.ndarray:
    """log P(unit | class, column): expected counts scaled to the seen ones, with a penalty.

    A weight for each (column, unit) scales the unigram inside the class. With `penalty` counts of
    the unigram added, one step of iterative scaling is the optimum.
    """
    out = np.zeros_like(pairs)
    for c in np.unique(classes):
        own = np.flatnonzero(classes == c)
        prior = (v.unit_total[own] + ADDED) / (v.unit_total[own] + ADDED).sum()
        seen, added = pairs[:, own], v.settings.penalty * prior
        weights = np.log((seen + added) / (seen.sum(axis=1, keepdims=True) * prior + added))
        out[:, own] = log_softmax(np.log(prior) + weights)
    return out.astype(np.float32)


def local_steps(model: Model, v: Vocabulary, batches: Iterator[pa.RecordBatch]):
    """Gradient steps over a task's texts: touched rows and their changes, by the class softmax."""
    weights = model.weights.copy()
    own = Model(model.classes, model.bias.copy(), weights, model.units)
    squares = np.full(len(weights), 1.0, np.float32)  # rare rows move little
    touched = np.zeros(len(weights), bool)
    for batch in batches:
        numbers, ends = numbers_of(batch.column(0))
        units = v.units_of(numbers)
        _, rows = contexts(units, ends, v)
        target = model.classes[units]
        for start in range(0, len(units), STEP_TOKENS):
            part = [r[start : start + STEP_TOKENS] for r in rows]
            y = target[start : start + STEP_TOKENS]
            error = np.exp(log_softmax(class_logits(own, part)))
            error[np.arange(len(y)), y] -= 1
            for r in part:
                order = np.argsort(r.astype(np.uint16), kind="stable")
                first = np.flatnonzero(np.r_[True, r[order][1:] != r[order][:-1]])
                row, gradient = r[order][first], np.add.reduceat(error[order], first, axis=0)
                gradient /= np.sqrt(np.diff(np.r_[first, len(r)]))[:, None]
                squares[row] += (gradient**2).mean(axis=1)
                weights[row] -= v.settings.rate * gradient / np.sqrt(squares[row])[:, None]
                touched[row] = True
    return touched, weights - model.weights


def train_classes(docs: DataFrame, model: Model, vocabulary, settings: Settings) -> Model:
    """Rounds of distributed updates; each training text serves in exactly one round."""
    spark = docs.sparkSession
    parts, split = 16, np.array_split(np.arange(settings.rows), 16)
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(settings.rounds))
    for now in range(settings.rounds):
        shared = spark.sparkContext.broadcast(model)

        def work(batches: Iterator[pa.RecordBatch], shared=shared):
            touched, change = local_steps(shared.value, vocabulary.value, batches)
            for k, rows in enumerate(split):
                yield k, np.column_stack([touched[rows], change[rows]]).ravel()

        got = summed(docs.where(turn == now).select("numbers"), work, parts)
        weights = model.weights.copy()
        for k, values in got.items():
            table = values.reshape(len(split[k]), -1)
            weights[split[k]] += (table[:, 1:] / np.maximum(table[:, :1], 1)).astype(np.float32)
        model = Model(model.classes, model.bias, weights, model.units)
        free_shuffles(spark)
    return model


def score_texts(docs: DataFrame, vocabulary, shared) -> DataFrame:
    """Sums over the tokens of the lookup by row, with the units of all tokens in the model's part."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model = vocabulary.value, shared.value
        base_all = np.log10((v.counts + ADDED) / (v.total + ADDED * (v.distinct + 1)))
        base_all[-1] = 0
        unit_size = v.unit_total + ADDED * (v.unit_distinct + 1)
        inside = np.log10((v.counts + ADDED) / unit_size[v.unit_of])
        inside[: v.settings.frequent] = 0
        inside[-1] = 0
        known = np.append(v.counts[:-1] > 0, False)
        for batch in batches:
            numbers, ends = numbers_of(batch.column(2))
            units, found = v.units_of(numbers), np.maximum(numbers, -1)
            column, rows = contexts(units, ends, v)
            target = model.classes[units]
            logs = np.empty(len(units))
            for start in range(0, len(units), STEP_TOKENS):
                end = min(len(units), start + STEP_TOKENS)
                part = log_softmax(class_logits(model, [r[start:end] for r in rows]))
                logs[start:end] = part[np.arange(end - start), target[start:end]]
            logs = (logs + model.units[column, units]) / np.log(10)
            begins = np.r_[0, ends[:-1]] if len(ends) else ends
            add = lambda x: np.add.reduceat(x, begins) if len(begins) else x
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(ends - begins),
                    pa.array(add(known[found].astype(np.int64))),
                    pa.array(add(base_all[found])),
                    pa.array(add(logs + inside[found])),
                ],
                ["row", "doc_id", "n_tokens", "n_known", "base", "model"],
            )

    return docs.mapInArrow(
        made,
        "row long, doc_id long, n_tokens long, n_known long, base double, model double",
    )


def score_corpus(
    docs: DataFrame,
    held_out,
    settings: Settings | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row.

    held_out: column that is true for rows that nothing is learned from.
    """
    settings = settings or Settings()
    spark = docs.sparkSession
    bounded_batches(spark, size="4m")
    chosen = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(text_column).cast("binary").alias("text"),
        F.coalesce(held_out, F.lit(True)).alias("held_out"),
    )
    counts = stored(token_counts(chosen.where(~F.col("held_out")).select("doc_id", "text")), "lm-counts")
    free_shuffles(spark)
    v = build_vocabulary(counts, settings)
    vocabulary = spark.sparkContext.broadcast(v)
    texts = numbered(chosen, vocabulary).withColumn("row", F.monotonically_increasing_id())
    texts = stored(texts, "lm-numbers")
    training = texts.where(~F.col("held_out")).select("doc_id", "numbers")
    pairs = pair_counts(training.select("numbers"), vocabulary)
    classes = cluster(pairs, settings.classes)
    mass = np.bincount(classes, weights=v.unit_total, minlength=settings.classes)
    model = Model(
        classes,
        np.log((mass + ADDED) / (mass + ADDED).sum()).astype(np.float32),
        np.zeros((settings.rows, settings.classes), np.float32),
        fit_units(pairs, classes, v),
    )
    model = train_classes(training, model, vocabulary, settings)
    shared = spark.sparkContext.broadcast(model)

    scored = stored(score_texts(texts.select("row", "doc_id", "numbers"), vocabulary, shared), "lm-scores")
    free_shuffles(spark)
    unit = (F.crc32(F.expr("substring(token, -3, 3)")) % settings.suffixes + settings.frequent).cast("int")
    sizes = F.array(*[F.lit(float(x)) for x in v.unit_total + ADDED * (v.unit_distinct + 1)])
    others = texts.select("row", F.explode("others").alias("token")).groupBy("row", "token").agg(
        F.count("*").alias("times")
    )
    count = F.coalesce(F.col("count"), F.lit(0))
    base = F.log10((count + ADDED) / F.lit(v.total + ADDED * (v.distinct + 1)))
    inside = F.log10((count + ADDED) / F.element_at(sizes, unit + 1))
    more = others.join(counts, "token", "left").groupBy("row").agg(
        F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(base * F.col("times")).alias("base_more"),
        F.sum(inside * F.col("times")).alias("model_more"),
    )
    more = stored(more, "lm-others")
    free_shuffles(spark)
    zero = F.lit(0)
    return scored.join(more, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", zero)).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("model_more", F.lit(0.0))).alias("score"),
    )

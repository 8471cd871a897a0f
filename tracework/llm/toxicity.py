"""Toxicity by a factorization machine over hashed terms.

A document's terms are its words (runs of letters, lower-cased), the words' first PREFIXES letters, and the power of
two that its length falls under; each is hashed into SPACE_SIZE numbers, and every number is an input, present or not. The
score is the logistic of bias + sum of weights + sum over pairs of present terms of the product of their factor vectors.

Weights and factors are fitted together by sparse gradients. No term is left out beforehand: a penalty on each weight's
size and on each factor vector's length, larger for terms that tell the labels less apart, leaves those at zero that the
fit can do without, and a term that tells nothing alone may keep factors that tell in a pair. Rounds over all inputs and
rounds over those that aren't zero take turns, so inputs come back where their gradient asks for it. As the penalties
also make the weights that stay too small, these are fitted once more, with a mild penalty on squares alone.

It is fitted on at most TRAIN_ROWS labelled ids of each label, those with the smallest CRC of the id among the ids that
aren't held out, weighted to the labels' true share; the scores cover whole texts of all rows.

Defined results: null and empty texts have only their length term and a score like others; an id's labels count once, and
as toxic if any is; of rows that share an id one text is trained on, the one with the least hash; without labels of both
kinds the score is the share of toxic ones (0 if none); repeated rows are scored alike; an empty table gives no rows;
labels, lang, source and doc_id are never inputs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.session import cut, whole_texts

PREFIXES = (4, 5, 6)
SPACE_SIZE = 1 << 20
FACTORS = 6
TRAIN_ROWS = 4_000
#: Rounds; the first ones, and then every FULL_EVERY-th, take all inputs.
ROUNDS, FULL_ROUNDS, FULL_EVERY = 100, 20, 10
#: Penalties of weights and of factor vectors, for terms that tell the labels apart by one standard deviation.
WEIGHT_PENALTY, FACTOR_PENALTY = 6e-4, 1.2e-3
#: Rounds of the last fit, and its penalties of squares.
LAST_ROUNDS, WEIGHT_SQUARES, FACTOR_SQUARES = 200, 1e-4, 1e-3
THRESHOLD = 0.3
CACHED_WORDS = 200_000
FILES = 8
#: Training rows whose gradients are summed at once.
SLICE_ROWS = 1_024

_WORD = re.compile(r"[^\W\d_]+")


def _number(term: str) -> int:
    return xxhash.xxh64_intdigest(term, 42) % SPACE_SIZE


def word_terms(word: str) -> list[int]:
    return [_number("w " + word), *[_number("p " + word[:n]) for n in PREFIXES if len(word) > n]]


def length_term(words: int) -> int:
    return _number(f"n {words.bit_length()}")


def terms(text: str | None) -> set[int]:
    words = _WORD.findall((text or "").lower())
    return {length_term(len(words))}.union(*map(word_terms, set(words)))


@dataclass
class Machine:
    """The numbers of the terms that aren't zero, sorted, with their weights and factors."""

    numbers: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, active: list[list[int]]) -> np.ndarray:
        """Of documents given by the places of their terms."""
        if not active:
            return np.zeros(0)
        sizes = np.array([len(a) for a in active])
        flat = np.fromiter((i for a in active for i in a), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(active)), sizes)
        k = self.factors.shape[1]
        linear = np.bincount(owner, self.weights[flat], len(active))
        sums = np.stack([np.bincount(owner, self.factors[flat, f], len(active)) for f in range(k)], 1)
        squares = np.stack([np.bincount(owner, self.factors[flat, f] ** 2, len(active)) for f in range(k)], 1)
        return _logistic(self.bias + linear + 0.5 * (sums**2 - squares).sum(1))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Slice:
    """Some training rows: the columns of their terms by row, and the same by column, for sums either way."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, first: int) -> None:
        self.rows, self.flat = slice(first, first + len(sizes)), flat
        self.some = np.flatnonzero(sizes)
        self.starts = (np.cumsum(sizes) - sizes)[self.some]
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.columns, self.begins = np.unique(flat[order], return_index=True)

    def sums(self, params: np.ndarray) -> np.ndarray:
        """By row: the sums of its terms' weights and factors, and of the factors' squares."""
        found = np.zeros((self.rows.stop - self.rows.start, params.shape[1] + 1), np.float32)
        if len(self.flat):
            own = params[self.flat]
            found[self.some, :-1] = np.add.reduceat(own, self.starts, axis=0)
            found[self.some, -1] = np.add.reduceat((own[:, 1:] ** 2).sum(1), self.starts)
        return found

    def back(self, told: np.ndarray, into: np.ndarray) -> None:
        """Adds each row's numbers to those of its columns."""
        if len(self.flat):
            into[self.columns] += np.add.reduceat(told[self.owner], self.begins, axis=0)


def _slices(flat: np.ndarray, sizes: np.ndarray, kept: np.ndarray | None = None) -> list[_Slice]:
    """kept: the columns that count, by number; columns keep their numbers."""
    ends, out = np.cumsum(sizes), []
    for at in range(0, len(sizes), SLICE_ROWS):
        own, n = flat[ends[at] - sizes[at] : ends[min(at + SLICE_ROWS, len(sizes)) - 1]], sizes[at : at + SLICE_ROWS]
        if kept is not None:
            hit = kept[own]
            n = np.bincount(np.repeat(np.arange(len(n)), n)[hit], minlength=len(n))
            own = own[hit]
        out.append(_Slice(own, n, at))
    return out


def gaps(n1: np.ndarray, n0: np.ndarray, s1: int, s0: int) -> np.ndarray:
    """How far apart two classes of s1 and s0 rows are in what n1 and n0 of them have, in about standard deviations."""
    return np.abs((n1 + 0.5) / (s1 + 1) - (n0 + 0.5) / (s0 + 1)) / np.sqrt((n1 + n0 + 1.0) / (s1 + s0 + 1.0))


def fit(flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray, factors: int = FACTORS, rounds: int = ROUNDS, penalties: tuple[float, float] = (WEIGHT_PENALTY, FACTOR_PENALTY)) -> Machine:
    """A machine from rows of terms (flat, one row after the other, of the given sizes), labels and weights, by Adam's steps
    on the weighted log loss, each followed by the penalties' shrinking."""
    numbers, columns = np.unique(flat, return_inverse=True)
    every, width = _slices(columns, sizes), len(numbers)
    n1, n = np.bincount(columns, np.repeat(y, sizes), width), np.bincount(columns, minlength=width)
    scale = (1 / np.maximum(gaps(n1, n - n1, y.sum(), (1 - y).sum()), 0.05)).astype(np.float32)
    # column 0 has the weights, the others the factors
    params = np.concatenate([np.zeros((width, 1)), np.random.default_rng(7).normal(0, 0.05, (width, factors))], 1).astype(np.float32)
    first, second, bias, moments = np.zeros_like(params), np.zeros_like(params), 0.0, [0.0, 0.0]
    weight, rate, some = (weight / weight.sum()).astype(np.float32), 0.05, every
    for step in range(1, rounds + 1):
        full = step <= FULL_ROUNDS or step % FULL_EVERY == 0
        if step > FULL_ROUNDS and (step - 1) % FULL_EVERY == 0:
            alive = params.any(axis=1)
            some, at = _slices(columns, sizes, alive), np.flatnonzero(alive)
        back, slope = _gradient(every if full else some, params, bias, y, weight)
        own = slice(None) if full else at
        p, g = params[own], back[own]
        g[:, 1:] += 1e-4 * p[:, 1:]
        first[own] = m = 0.9 * first[own] + 0.1 * g
        second[own] = v = 0.99 * second[own] + 0.01 * g * g
        spread = np.sqrt(v / (1 - 0.99**step)) + 1e-6
        p = p - rate * (m / (1 - 0.9**step)) / spread
        p[:, 0] = np.sign(p[:, 0]) * np.maximum(np.abs(p[:, 0]) - rate * penalties[0] * scale[own] / spread[:, 0], 0)
        length = np.sqrt((p[:, 1:] ** 2).sum(1))
        p[:, 1:] *= np.maximum(1 - rate * penalties[1] * scale[own] / np.maximum(spread[:, 1:].mean(1) * length, 1e-12), 0)[:, None]
        params[own] = p
        moments = [0.9 * moments[0] + 0.1 * slope, 0.99 * moments[1] + 0.01 * slope * slope]
        bias -= rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
    kept = params.any(axis=1)
    return _refitted(columns, sizes, y, weight, kept, numbers, factors)


def _gradient(slices: list[_Slice], params: np.ndarray, bias: float, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Of the weighted log loss: by weights and factors, and by the bias."""
    back, slope = np.zeros_like(params), 0.0
    for part in slices:
        sums = part.sums(params)
        score = bias + sums[:, 0] + 0.5 * ((sums[:, 1:-1] ** 2).sum(1) - sums[:, -1])
        error = weight[part.rows] * (_logistic(score) - y[part.rows]).astype(np.float32)
        part.back(np.concatenate([error[:, None], error[:, None] * sums[:, 1:-1]], 1), back)
        slope += float(error.sum())
    back[:, 1:] -= params[:, 1:] * back[:, :1]
    return back, slope


def _refitted(columns: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray, kept: np.ndarray, numbers: np.ndarray, factors: int) -> Machine:
    """The columns that are kept, fitted anew by Adam's steps."""
    place, width = np.cumsum(kept) - 1, int(kept.sum())
    hit = kept[columns]
    own = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[hit], minlength=len(sizes))
    slices = _slices(place[columns[hit]], own)
    params = np.concatenate([np.zeros((width, 1)), np.random.default_rng(7).normal(0, 0.05, (width, factors))], 1).astype(np.float32)
    first, second, bias, moments = np.zeros_like(params), np.zeros_like(params), 0.0, [0.0, 0.0]
    squares, rate = np.array([WEIGHT_SQUARES, *[FACTOR_SQUARES] * factors], np.float32), 0.05
    for step in range(1, LAST_ROUNDS + 1):
        back, slope = _gradient(slices, params, bias, y, weight)
        back += squares * params
        size, rest = 1 - 0.9**step, 1 - 0.999**step
        first += 0.1 * (back - first)
        second += 0.001 * (back * back - second)
        params -= rate * (first / size) / (np.sqrt(second / rest) + 1e-8)
        moments = [moments[0] + 0.1 * (slope - moments[0]), moments[1] + 0.001 * (slope * slope - moments[1])]
        bias -= rate * (moments[0] / size) / (np.sqrt(moments[1] / rest) + 1e-8)
    return Machine(numbers[kept], float(bias), params[:, 0].astype(np.float64), params[:, 1:].astype(np.float64))


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Machine:
    """Fit on documents with labels that aren't held out. The driver gets the terms of 2 x most rows at most."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(share.values())
    if len(share) < 2:
        odds = (share.get(1, 0) + 1e-6) / (share.get(0, 0) + 1e-6) if total else 1e-9
        return Machine(np.zeros(0, np.int64), float(np.log(odds)), np.zeros(0), np.zeros((0, 1)))
    by_crc = [F.crc32(F.col("doc_id").cast("string")), F.col("doc_id")]
    sample = known.where("toxic = 1").orderBy(*by_crc).limit(most).unionByName(known.where("toxic = 0").orderBy(*by_crc).limit(most))
    sample = cut(sample.coalesce(1), "training-ids")  # at most 2 x most ids

    def list_terms(batches):
        for batch in batches:
            found = [sorted(terms(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "terms"])

    texts = whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    # a bounded sample, in few files
    found = cut(texts.coalesce(FILES).mapInArrow(list_terms, "doc_id long, toxic int, terms array<int>"), "training-rows").toArrow().sort_by("doc_id").combine_chunks()
    y, lists = found["toxic"].to_numpy().astype(np.float64), found["terms"].combine_chunks()
    if not len(y):  # labels of documents that aren't there
        return Machine(np.zeros(0, np.int64), float(np.log(share[1] / share[0])), np.zeros(0), np.zeros((0, 1)))
    sizes = pa.compute.list_value_length(lists).to_numpy().astype(np.int64)
    s1, s0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    return fit(lists.flatten().to_numpy().astype(np.int64), sizes, y, np.where(y == 1, share[1] / s1, share[0] / s0))


def score_documents(docs: DataFrame, machine: Machine, carry: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """carry columns, score and predicted of every row of docs.text."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    fields = [docs.schema[c] for c in carry]

    def run(batches):
        machine, cache = shared.value, {}
        columns = {int(number): i for i, number in enumerate(machine.numbers)}
        for batch in batches:
            active = []
            for value in batch.column(batch.schema.get_field_index("text")):
                words = _WORD.findall((value.as_py() or "").lower())
                present = {columns[t] for t in (length_term(len(words)),) if t in columns}
                for word in set(words):
                    inputs = cache.get(word)
                    if inputs is None:
                        if len(cache) >= CACHED_WORDS:
                            cache.clear()
                        inputs = cache[word] = tuple(columns[t] for t in word_terms(word) if t in columns)
                    if inputs:
                        present.update(inputs)
                active.append(sorted(present))
            scores = machine.scores(active)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in carry]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*carry, "score", "predicted"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "score double, predicted int"
    return whole_texts(docs).select(*carry, "text").mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")

"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum of w_i x_i + sum over pairs of <v_i, v_j> x_i x_j): the factors learn which terms are toxic only
together, such as an insult with the mention of a group, which additive weights miss. Terms are kept if they go with the
label by themselves or in a pair, by pair counts, so that terms that matter only together are learned too. A text is
scored by overlapping segments of SEGMENT_WORDS words, and its score is that of its worst segment: a long text does not
dilute an insult, and words at most SEGMENT_WORDS - STRIDE apart always stand in one segment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialise, spread, table

WORD = re.compile(r"[^\W\d_]+")
BITS = 18
FACTORS = 4
PREFIXES = (4, 5)
#: Terms of fewer training texts get no weight.
MIN_TEXTS = 4
CHI_SQUARE = 16.0
#: Pairs are counted among the terms of most training texts; a pair counts if its squared z-score is so large.
PAIR_TERMS, PAIR_CHI_SQUARE, MIN_PAIR_TEXTS = 2000, 64.0, 5.0
#: A toxic text counts for so many clean ones at most.
POSITIVE_WEIGHT = 3.0
SEGMENT_WORDS, STRIDE = 400, 200
#: Documented bound of the training sample: labelled rows of at most SAMPLE_CHARS characters, half of either label, with the
#: smallest hashes.
SAMPLE_ROWS, SAMPLE_CHARS = 8000, 10_000
EPOCHS = 8
RATE = 0.08
L2_LINEAR, L2_FACTOR = 2e-5, 2e-4
PAIR_SCALE = 0.1
#: Linear weights are taught for so many epochs before the factors, which explain what is left.
LINEAR_EPOCHS = 2


class _Terms(dict):
    """Hashed terms of a word: itself and its beginnings, which stay when endings change; emptied when full. With known, only
    terms that a model knows."""

    def __init__(self, known: np.ndarray | None = None):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        forms = [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)]
        ids = (xxhash.xxh64_intdigest(f) & ((1 << BITS) - 1) for f in forms)
        out = self[word] = tuple(i for i in ids if self.known is None or self.known[i])
        return out


_terms = _Terms()


def segments(text: str | None, terms: _Terms = _terms) -> list[np.ndarray]:
    """Distinct hashed terms of each stretch of SEGMENT_WORDS words, a new one every STRIDE words; one empty segment for a text
    without words."""
    words = WORD.findall((text or "").lower())
    out = []
    for s in range(0, max(1, len(words) - SEGMENT_WORDS + STRIDE), STRIDE):
        ids = {i for w in set(words[s : s + SEGMENT_WORDS]) for i in terms[w]}
        out.append(np.fromiter(ids, np.int64, len(ids)))
    return out


@dataclass
class Model:
    """Size fixed by BITS and FACTORS: 2**18 * 5 floats, 5 MB, whatever the corpus."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def __post_init__(self):
        self.terms = _Terms(self.factors.any(axis=1) | (self.linear != 0))

    def logit(self, ids: np.ndarray) -> float:
        if not len(ids):
            return self.bias
        v = self.factors[ids]
        s = v.sum(axis=0)
        return float(self.bias + self.linear[ids].sum() + 0.5 * PAIR_SCALE * ((s * s).sum() - (v * v).sum()))

    def score(self, text: str | None) -> float:
        z = max(self.logit(s) for s in segments(text, self.terms))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def associated(toxic_with: np.ndarray, clean_with: np.ndarray, n_toxic: int, n: int) -> np.ndarray:
    """Terms whose presence goes with the label beyond chance: chi-square of at least CHI_SQUARE, in MIN_TEXTS texts or more.
    Most words stand in a few texts only; as features they would fit the sample and nothing else."""
    a, b = toxic_with, clean_with
    c, d = n_toxic - a, n - n_toxic - b
    chi = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * max(1, n_toxic) * max(1, n - n_toxic), 1)
    return (a + b >= MIN_TEXTS) & (chi >= CHI_SQUARE)


def paired(rows: list[tuple[list[np.ndarray], int]], texts: np.ndarray) -> np.ndarray:
    """Terms of pairs whose joint presence goes with the label beyond what either does: the label's residuals summed over
    centred presences, for all pairs of the PAIR_TERMS terms of most texts (texts: number of each term) at once."""
    found = np.zeros(1 << BITS, bool)
    y = np.array([y for _, y in rows], np.float32)
    every = len(rows)
    # A term of every text pairs with nothing.
    usable = np.flatnonzero((texts >= MIN_TEXTS) & (texts < every))
    if not len(usable) or not y.any() or y.all():
        return found
    terms = np.sort(usable[np.argsort(-texts[usable], kind="stable")[:PAIR_TERMS]])
    at = np.full(1 << BITS, -1, np.int64)
    at[terms] = np.arange(len(terms))
    x = np.zeros((every, len(terms)), np.float32)
    for k, (parts, _) in enumerate(rows):
        for p in parts:
            i = at[p]
            x[k, i[i >= 0]] = 1
    share = x.mean(axis=0)
    x -= share
    # What single terms explain is taken off first, or their pairs with everything would count.
    left = y - y.mean()
    spread_ = share * (1 - share)
    linear = (x.T @ left) / (every * spread_)
    linear[linear**2 * every * spread_ < CHI_SQUARE * left.var()] = 0
    left = left - x @ linear
    left -= left.mean()
    z = x.T @ (left[:, None] * x)
    sd = np.sqrt(every * max(left.var(), 1e-9) * np.outer(spread_, spread_))
    enough = every * np.outer(np.minimum(share, 1 - share), np.minimum(share, 1 - share)) >= MIN_PAIR_TEXTS
    np.fill_diagonal(enough, False)
    found[terms[(enough & (z * z >= PAIR_CHI_SQUARE * sd * sd)).any(axis=0)]] = True
    return found


def fit(rows: list[tuple[list[np.ndarray], int]], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """rows: segments and label. Adagrad on logistic loss; a toxic text is taught by its worst segment so far, a clean one
    by one of its segments each epoch and its worst one: every segment of a clean text is clean."""
    rng = np.random.default_rng(seed)
    toxic_with, clean_with = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for parts, y in rows:
        (toxic_with if y else clean_with)[np.unique(np.concatenate(parts))] += 1
    known = associated(toxic_with, clean_with, sum(y for _, y in rows), len(rows)) | paired(rows, toxic_with + clean_with)
    rows = [([p[known[p]] for p in parts], y) for parts, y in rows]
    linear, factors, bias = np.zeros(1 << BITS, np.float32), (rng.normal(0, 0.05, (1 << BITS, FACTORS)) * known[:, None]).astype(np.float32), -1.0
    g_linear, g_factors, g_bias = np.full(1 << BITS, 1e-2, np.float32), np.full((1 << BITS, FACTORS), 1e-2, np.float32), 1e-2
    model = Model(bias, linear, factors)
    positives = max(1, sum(y for _, y in rows))
    weight = (max(1, len(rows) - positives) / positives, 1.0)
    for epoch in range(epochs):
        for i in rng.permutation(len(rows)):
            parts, y = rows[i]
            logits = [model.logit(s) for s in parts]
            worst = int(np.argmax(logits))
            chosen = {worst} if y else {worst, int(rng.integers(len(parts)))}
            for j in chosen:
                ids, z = parts[j], float(np.clip(logits[j], -40, 40))
                slope = (1 / (1 + np.exp(-z)) - y) * (min(weight[0], POSITIVE_WEIGHT) if y else 1.0)
                g_bias += slope * slope
                model.bias -= RATE * slope / np.sqrt(g_bias) * 0.1
                if not len(ids):
                    continue
                gl = slope + L2_LINEAR * linear[ids]
                g_linear[ids] += gl * gl
                linear[ids] -= RATE * gl / np.sqrt(g_linear[ids])
                if epoch >= LINEAR_EPOCHS:
                    v = factors[ids]
                    gf = slope * PAIR_SCALE * (v.sum(axis=0) - v) + L2_FACTOR * v
                    g_factors[ids] += gf * gf
                    factors[ids] -= RATE * gf / np.sqrt(g_factors[ids])
    return model


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def training_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """doc_id, toxic, text: at most sample_rows labelled rows, one for each id, whose crc32(doc_id) mod 5 is not 0. Only ids
    whose hash lies below a bound go to the join, so no more than the sample moves."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows at most
    half, steps = sample_rows // 2, 1 << 30
    order = F.xxhash64("doc_id")
    bound = lambda y: int(min(1.0, 1.5 * half / max(1, n.get(y, 0))) * steps)
    sample = known.where(F.pmod(order, F.lit(steps)) < F.when(F.col("toxic") == 1, F.lit(bound(1))).otherwise(F.lit(bound(0))))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    found = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    of = lambda y: found.where(F.col("toxic") == y).orderBy(F.pmod(order, F.lit(steps)), "doc_id").limit(half)
    return of(1).unionAll(of(0))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on training_sample(), in one task on an executor; the driver gets the model alone. Conflicting or repeated labels
    of an id: the greatest counts; of rows that repeat an id the smallest text. Without labels the model scores everything
    0.27 (its starting bias)."""
    sample = materialise(training_sample(docs, labels, sample_rows), "toxicity-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        m = fit([(segments(text), toxic) for _, toxic, text in sorted(rows)])
        kept = np.flatnonzero(m.factors.any(axis=1) | (m.linear != 0))
        row = [float(m.bias)], [kept.astype(np.int32).tobytes()], [m.linear[kept].tobytes()], [m.factors[kept].tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.float64()), *(pa.array(x, pa.binary()) for x in row[1:])], ["bias", "ids", "linear", "factors"])

    r = sample.repartition(1).mapInArrow(run, "bias double, ids binary, linear binary, factors binary").first()  # 6 MB at most
    linear, factors = np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, FACTORS), np.float32)
    ids = np.frombuffer(r["ids"], np.int32)
    linear[ids], factors[ids] = np.frombuffer(r["linear"], np.float32), np.frombuffer(r["factors"], np.float32).reshape(-1, FACTORS)
    return Model(r["bias"], linear, factors)


def score_texts(docs: DataFrame, model: Model, name: str = "__tox_score") -> DataFrame:
    """All columns of docs, and the score as a column of this name. Null and empty texts get the score of a text without words."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.bias, model.linear, model.factors))

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Model(*sent.value)
        for t in texts:
            yield pa.array([m.score(x) for x in t.to_pylist()], pa.float64())

    return spread(docs).withColumn(name, scored(F.col("text").cast("string")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, repeated ones each. A null doc_id is not held out. Texts without words,
    null and empty ones too, share one score; equal texts have equal scores; a text of any length is scored whole; an empty
    table gives an empty result. Labels, lang, source and doc_id are no inputs of the score; extra columns are not carried."""
    scored = score_texts(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("__tox_score").alias("score"),
        (F.col("__tox_score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not predict toxic, with their columns."""
    name = fresh(docs, "__tox_score")
    return score_texts(docs, train(docs, labels), name).where(F.col(name) < 0.5).drop(name)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Toxicity by multiple-instance learning: sentences are judged, documents are labelled.

A sentence's probability is logistic in the weights of its words; a word weighs
what the word itself and its beginnings weigh. A document is toxic if some
sentence is: its probability is the noisy-or of its sentences. Training needs
document labels only: the gradient of the document's likelihood reaches each
sentence in proportion to its own probability, so toxic sentences find themselves,
and the trained model points at them.

The classifier is fitted on a bounded sample of the labelled rows (``SAMPLE``, drawn
by a hash of the doc_id) with a bounded number of terms (``TERMS``), chosen by Spark
from counts over the sample; only these bounded tables reach the driver. Scoring
covers every whole text.

* Null or wordless texts have no sentence and the score 0.
* Labels that are null are not used; of several for a doc_id the largest counts.
* Rows without a doc_id are scored, never trained on, and are not held out.
* Without labelled rows of both classes every score is 0. Repeated rows get the
  same score; columns beside those named are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from updraft.llm.common import arrow_schema, batch_rows, read, small_batches, written

#: Labelled rows that the classifier is fitted on, as expected number of the draw by hash.
SAMPLE = 8000
#: Terms that carry weights, and the labelled documents a term must occur in.
TERMS = 2000
MIN_DOCS = 4
BEGINNINGS = (3, 4, 5, 6, 7, 8)
EPOCHS, RATE, SHRINK = 150, 0.15, 2e-4
WORDS = 400_000     # word weights kept per worker process
FOLDS = 5
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]+")
SCORES = "doc_id long, held_out boolean, score double, n_offending long, worst_start long, worst_end long"
SENTENCES = "doc_id long, start long, end long, probability double"


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def terms_of(word: str) -> list[str]:
    """The word and its beginnings; ``^`` marks a beginning."""
    word = word.lower()
    return [word, *(f"{word[:n]}^" for n in BEGINNINGS if len(word) > n)]


def sentences(text: str) -> Iterator[list[str]]:
    """Words of each sentence that has any."""
    now: list[str] = []
    for token in TOKEN.findall(text):
        if token[0].isalpha():
            now.append(token)
        elif now:
            yield now
            now = []
    if now:
        yield now


@dataclass
class Model:
    """Weights per term, and the bias of a sentence."""

    weights: dict[str, float]
    bias: float
    fitted: bool = True
    _words: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, token: str) -> float:
        value = self._words.get(token)
        if value is None:
            if len(self._words) >= WORDS:
                self._words.clear()
            # Separators are marked by an infinite value.
            value = sum(self.weights.get(t, 0.0) for t in terms_of(token)) if token[0].isalpha() else math.inf
            self._words[token] = value
        return value

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "fitted": self.fitted, "_words": {}}

    def sentence_logits(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Logit and first token of every sentence, and the number of tokens."""
        tokens = TOKEN.findall(text)
        values = np.fromiter(map(self.word, tokens), np.float64, len(tokens))
        stops = np.isinf(values)
        starts = np.flatnonzero(~stops & np.concatenate(([True], stops[:-1])))
        if not len(starts):
            return np.zeros(0), starts, len(tokens)
        return self.bias + np.add.reduceat(np.where(stops, 0.0, values), starts), starts, len(tokens)

    def score(self, text: str) -> float:
        if not self.fitted:
            return 0.0
        return float(-np.expm1(-np.logaddexp(0.0, self.sentence_logits(text)[0]).sum()))

    def located(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) in code points of the sentences at least that probable."""
        logits, starts, n = self.sentence_logits(text) if self.fitted else ([], [], 0)
        if not len(logits):
            return []
        probable = 1 / (1 + np.exp(-np.asarray(logits)))
        if probable.max() < least:
            return []
        spans = [m.span() for m in TOKEN.finditer(text)]
        ends = [*starts[1:], n]
        out = []
        for p, a, b in zip(probable, starts, ends):
            if p >= least:
                while b - 1 > a and not text[spans[b - 1][0]].isalpha():
                    b -= 1
                out.append((spans[a][0], spans[b - 1][1], float(p)))
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """text and label of about ``size`` labelled rows outside the held-out fold."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    total = known.count()
    part = 1_000_000 if total <= size else size * 1_000_000 // total
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(drawn), "doc_id").select("text", "label")     # bounded by the draw


def _term_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        terms, labels = [], []
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = {t for w in set(TOKEN.findall(text)) if w[0].isalpha() for t in terms_of(w)}
            terms += own
            labels += [label] * len(own)
        if terms:
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(labels, pa.int32())], ["term", "label"])


def choose_terms(sample: DataFrame, limit: int = TERMS) -> list[str]:
    """The terms whose documents are toxic most beyond the sample's share, in standard errors."""
    small_batches(sample.sparkSession)
    n, positive = sample.agg(F.count("*"), F.sum("label")).first()
    if not n or not positive or positive == n:
        return []
    rate = positive / n
    counts = sample.mapInArrow(_term_rows, "term string, label int").groupBy("term").agg(
        F.count("*").alias("n"), F.sum("label").alias("toxic")).where(F.col("n") >= MIN_DOCS)
    z = (F.col("toxic") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)))
    return [r[0] for r in counts.orderBy(z.desc(), "term").select("term").limit(limit).collect()]


def _instances(sample: DataFrame, terms: list[str]) -> list:
    """Per sampled document its label, sentence count, and (sentence, term) pairs of the chosen terms."""
    place = {t: i for i, t in enumerate(terms)}

    def row(text: str, label: int) -> tuple:
        at, which, n = [], [], 0
        for words in sentences(text):
            for w in words:
                for t in terms_of(w):
                    i = place.get(t)
                    if i is not None:
                        at.append(n)
                        which.append(i)
            n += 1
        return label, n, at, which

    # Ordered, since sums of floats depend on the order of their terms.
    encoded = batch_rows(sample, row, "label int, n int, at array<int>, which array<int>")
    return encoded.orderBy("n", "label", "at", "which").toArrow().to_pydict()


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """The model fitted by gradient ascent (Adam) on the sample's document likelihood."""
    sample = written(labelled_sample(docs, labels, size), "sample")
    terms = choose_terms(sample)
    if not terms:
        return Model({}, 0.0, fitted=False)
    data = _instances(sample, terms)
    labels_, counts = np.array(data["label"], float), np.array(data["n"], np.int64)
    first = np.cumsum(counts) - counts
    at = np.concatenate([np.array(a, np.int64) + f for a, f in zip(data["at"], first)])
    which = np.concatenate([np.array(w, np.int64) for w in data["which"]])
    doc = np.repeat(np.arange(len(counts)), counts)
    total = int(counts.sum())
    weights, bias = np.zeros(len(terms)), -math.log(max(total, 2) / max(labels_.sum(), 1))
    m, v = np.zeros(len(terms) + 1), np.zeros(len(terms) + 1)
    for step in range(1, EPOCHS + 1):
        z = bias + np.bincount(at, weights[which], total)
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        p = -np.expm1(-np.bincount(doc, np.logaddexp(0, z), len(counts)))
        share = np.where(labels_ > 0, (1 - p) / np.maximum(p, 1e-12), -1.0)
        g = s * share[doc] / len(counts)
        grad = np.append(np.bincount(which, g[at], len(terms)) - SHRINK * weights, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
        weights, bias = weights + move[:-1], bias + move[-1]
    return Model({t: float(w) for t, w in zip(terms, weights) if abs(w) > 1e-4}, float(bias))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and the offending sentences' number and worst place, of every row."""
    def row(doc_id, held, text: str) -> tuple:
        score = model.score(text)
        places = model.located(text) if score >= 0.5 else []
        worst = max(places, key=lambda x: (x[2], -x[0]), default=(None, None))
        return doc_id, held, score, len(places), worst[0], worst[1]

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    return batch_rows(rows, row, SCORES)


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """One row per sentence at least that probable: doc_id, start, end (code points), probability."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = arrow_schema(spark, SENTENCES)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = [(i, *p) for i, t in zip(*(c.to_pylist() for c in batch.columns)) for p in model.located(t, least)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SENTENCES)


def op1_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = score_documents(docs, model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                      "n_offending", "worst_start", "worst_end")

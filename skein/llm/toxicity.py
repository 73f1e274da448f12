"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's probability is logistic in the sum of its words' weights; a word's weight is the sum over its hashed
form and prefixes, so unseen inflections are covered. The document's probability is the noisy-or of its
sentences', ``1 - prod(1 - p)``, and is trained on document labels alone by proximal gradient steps with an L1
penalty. Scoring is one narrow pass that keeps each word's weight in a bounded table; the sentences that carry a
document's score are returned as spans.

The model is fitted on at most ``TRAIN_ROWS`` labelled documents, chosen by a hash of their doc_id (a documented
bound); documents whose crc32(doc_id as text) mod 5 is 0 are held out. Scores see the text only.

Cases. Null or empty text: no sentence, so the score is 0. Null doc_id: held out is false and no label joins.
Null labels are not used; a doc_id with several labels is toxic if one of them says so. Repeated rows: rows of
their own with equal scores. No or one-sided labels: every score is 0. Ties: a score of exactly 0.5 is toxic.
Very long texts are scored whole. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import documents, free_name, materialise, read, row_pass

#: Labelled documents that the model is fitted on, at most, and characters of their texts together.
TRAIN_ROWS = 6_000
TRAIN_CHARS = 60_000_000
#: Hashed features, as a power of two.
BITS = 18
#: A feature counts if so many training documents have it.
MIN_DOCS = 3
PREFIXES = (3, 4, 5, 6, 7)
EPOCHS = 100
#: Strength of the L1 penalty.
PENALTY = 3e-4
RATE = 0.1
#: A sentence whose own probability is at least this is offending.
OFFENDING = 0.5
#: Documents with at least this score are rejected.
REJECT = 0.5

_STRIP = ".,;:!?\"'()[]{}<>«»“”‘’…*_#$%&|~`"
_END = frozenset(".!?…。！？")


def features(word: str, bits: int = BITS) -> list[int]:
    """Hashed features of a raw word: its bare lower-case form and that form's prefixes."""
    w = word.lower().strip(_STRIP)
    if not w:
        return []
    forms = [f"={w}", *(f"^{w[:n]}" for n in PREFIXES if len(w) > n)]
    return [xxhash.xxh64_intdigest(f.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1) for f in forms]


def sentences(text: str) -> tuple[list[str], list[int]]:
    """The words of a text and the number of words up to each sentence's end. Lines and marks end sentences."""
    words: list[str] = []
    ends: list[int] = []
    for line in text.split("\n"):
        of = line.split()
        start = len(words)
        words += of
        ends += [start + k + 1 for k, w in enumerate(of) if w[-1] in _END]
        if len(words) > (ends[-1] if ends else 0):
            ends.append(len(words))
    return words, ends


def noisy_or(z: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sentence probabilities and, per document (sentences from ``starts``, none empty), log(1 - P)."""
    clean = -np.logaddexp(0.0, z)
    return 1.0 - np.exp(clean), np.add.reduceat(clean, starts)


class _Sample:
    """The training documents as arrays: the words of all, their sentences, and the features of each distinct word."""

    def __init__(self, texts: list[str], labels: np.ndarray, bits: int = BITS) -> None:
        number: dict[str, int] = {}
        forms: list[list[int]] = []
        ids, lengths, per_doc, y, df = [], [], [], [], np.zeros(1 << bits, np.int32)
        for text, label in zip(texts, labels, strict=True):
            words, ends = sentences(text)
            if not words:
                continue
            own = []
            for w in words:
                k = number.get(w)
                if k is None:
                    k = number[w] = len(forms)
                    forms.append(features(w, bits))
                own.append(k)
            df[list({f for k in set(own) for f in forms[k]})] += 1
            ids.append(np.array(own, np.int32))
            lengths.append(np.diff(np.array(ends), prepend=0))
            per_doc.append(len(ends))
            y.append(float(label))
        self.y, self.per_doc = np.array(y), np.array(per_doc, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.per_doc)[:-1]]).astype(np.int64)
        self.words = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        self.sentence = np.repeat(np.arange(int(self.per_doc.sum()), dtype=np.int32), np.concatenate(lengths)) if ids else np.zeros(0, np.int32)
        self.n_words, self.df = len(forms), df
        self.of_word = np.repeat(np.arange(len(forms), dtype=np.int32), [len(f) for f in forms])
        self.feature = np.array([f for own in forms for f in own], np.int32)

    def descend(self, used: np.ndarray, bias: float, epochs: int, penalty: float, rate: float, bits: int = BITS) -> tuple[np.ndarray, float]:
        """Proximal, adaptively scaled gradient steps on the noisy-or likelihood from zero weights of the features ``used``."""
        new = np.full(1 << bits, -1, np.int32)
        new[used] = np.arange(len(used), dtype=np.int32)
        at = new[self.feature]
        of_word, at = self.of_word[at >= 0], at[at >= 0]
        w, m1, m2, b = np.zeros(len(used)), np.zeros(len(used) + 1), np.zeros(len(used) + 1), bias
        for t in range(1, epochs + 1):
            z = np.bincount(self.sentence, np.bincount(of_word, w[at], self.n_words)[self.words], int(self.per_doc.sum())) + b
            p, log_clean = noisy_or(z, self.starts)
            toxic = np.maximum(1.0 - np.exp(log_clean), 1e-12)
            # d(-log likelihood)/dz is p for clean documents and -p (1 - P) / P for toxic ones
            factor = np.where(self.y > 0, -np.exp(log_clean) / toxic, 1.0)
            dz = np.repeat(factor, self.per_doc) * p / len(self.y)
            by_word = np.bincount(self.words, dz[self.sentence], self.n_words)
            grad = np.append(np.bincount(at, by_word[of_word], len(used)), dz.sum())
            m1 = 0.9 * m1 + 0.1 * grad
            m2 = 0.99 * m2 + 0.01 * grad * grad
            scale = rate / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-4)
            step = scale * m1 / (1 - 0.9**t)
            w = w - step[:-1]
            w = np.sign(w) * np.maximum(np.abs(w) - scale[:-1] * penalty, 0.0)
            b -= float(step[-1]) * 0.5
        return w, b


def fit(texts: list[str], labels: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Weights and bias. A first descent under the penalty chooses the features, a second one almost without it sets their weights."""
    sample = _Sample(texts, labels, bits)
    out = np.zeros(1 << bits)
    if not len(sample.y) or sample.y.min() == sample.y.max():
        return out, -40.0
    used = np.flatnonzero(sample.df >= MIN_DOCS)
    bias = float(np.log(sample.y.mean() / sample.per_doc.mean()))
    for penalty in (PENALTY, PENALTY / 50):
        w, bias = sample.descend(used, bias, EPOCHS, penalty, RATE, bits)
        out[:] = 0.0
        out[used] = w
        used = used[w != 0]
    return out, bias


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> tuple[np.ndarray, float]:
    """Fit on at most ``rows`` labelled documents. docs: doc_id, text; labels: doc_id, toxic.

    Whole texts of the sample reach the driver, in the order of a hash of their doc_id until they hold ``chars`` characters
    together; a doc_id with several texts counts once, with the longest, then least of them. Only the sample's ids are broadcast.
    """
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null")
        .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    order = F.xxhash64("doc_id", F.lit(29))
    sample = materialise(marked.orderBy(order, "doc_id").limit(rows), "sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most TRAIN_ROWS rows of two numbers, so the broadcast is bounded whatever the corpus
    one = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max(F.struct(F.length("text").alias("n"), F.col("text"))).alias("of"))
    one = materialise(one.select("doc_id", "toxic", F.coalesce("of.n", F.lit(0)).alias("n"), F.coalesce("of.text", F.lit("")).alias("text")), "sample-texts")
    upto = Window.orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # the sample's rows, without their texts
    fit_on = one.select("doc_id", F.sum("n").over(upto).alias("upto")).where(F.col("upto") <= chars).select("doc_id")
    got = one.join(F.broadcast(fit_on), "doc_id", "left_semi").select("doc_id", "toxic", "text").toPandas().sort_values("doc_id", kind="stable")
    return fit(list(got["text"]), got["toxic"].to_numpy())


class Scorer:
    """Scores texts with a fitted model; keeps the weights of up to ``room`` words."""

    def __init__(self, weights: np.ndarray, bias: float, room: int = 400_000) -> None:
        self.weights, self.bias, self.room, self.memo = weights, bias, room, {}

    def words(self, words: list[str]) -> np.ndarray:
        if len(self.memo) > self.room:
            self.memo.clear()
        memo, out = self.memo, []
        for w in words:
            s = memo.get(w)
            if s is None:
                s = memo[w] = float(sum(self.weights[f] for f in features(w)))
            out.append(s)
        return np.array(out)

    def document(self, text: str) -> tuple[float, np.ndarray]:
        """The document's probability and its sentences'."""
        words, ends = sentences(text)
        if not words:
            return 0.0, np.zeros(0)
        upto = np.array(ends)
        z = np.add.reduceat(self.words(words), np.concatenate([[0], upto[:-1]])) + self.bias
        p, log_clean = noisy_or(z, np.array([0]))
        return float(-np.expm1(log_clean[0])), p


def scored(docs: DataFrame, model: tuple[np.ndarray, float], name: str = "toxicity", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) of every row of ``docs`` and the struct ``name``: score, n_sentences, offending (numbers of the sentences at fault).

    The model is a fixed number of weights, 2 MB, sent with the tasks.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(model[0]).astype(np.int32), model[0][model[0] != 0], model[1]))

    def maker():
        at, values, bias = shipped.value
        weights = np.zeros(1 << BITS)
        weights[at] = values
        scorer = Scorer(weights, bias)

        def make(texts):
            found = [scorer.document(t) if t else (0.0, np.zeros(0)) for t in texts]
            return [[{"score": min(1.0, max(0.0, s)), "n_sentences": len(p), "offending": np.flatnonzero(p >= OFFENDING).tolist()} for s, p in found]]

        return make

    return row_pass(docs, ["text"], f"`{name}` struct<score:double,n_sentences:int,offending:array<int>>", maker, keep)


def op5_noisy_or_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    found = scored(docs, train(docs, read(spark, sf_dir, "labels")), keep=["doc_id"])
    score = F.col("toxicity.score")
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"),
        F.col("toxicity.n_sentences").alias("n_sentences"), F.array_join("toxicity.offending", ",").alias("offending"),
    )


def accepted(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` whose score is below ``reject``; a model trained on the labelled ones among them decides."""
    name = free_name(docs, "toxicity")
    return scored(docs, train(docs, labels), name).where(F.col(f"`{name}`.score") < reject).select(*(F.col(f"`{c}`") for c in docs.columns))

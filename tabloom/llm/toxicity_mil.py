"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's logistic score depends on its words and word beginnings; a document is toxic unless none of its sentences is
(noisy-or).  The terms are all those that toxic documents have significantly more often, however many these are.  Weights are
fitted to the document labels by Fisher scoring with the diagonal of the information, corrected by the curvature of the last
steps (L-BFGS), so that memory grows with the number of terms and not with its square.  All sums run over all labelled documents
on the executors.  The fitted sentence scores then say which sentences offend.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import Scratch, bounded, held_out, small_batches, summed

THRESHOLD = 0.5
LEAST_DOCUMENTS = 5
LEAST_RATIO = 20.0
PREFIXES = (4, 5, 6)
WORD_END = "$"
STEPS = 200
MEMORY = 10
RIDGE = 0.05
BAG_BATCH = 8192
BAGS_A_TASK = 50_000
MEMO_TERMS = 200_000
START = min(PREFIXES)
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_ASCII_WORD = re.compile("[a-z]+")
_FROM_FIRST_LETTER = re.compile(r"[^\W\d_][^.!?\n]*")


def training(labels: DataFrame) -> DataFrame:
    """(of_id, toxic) of the labelled documents outside the held-out fold; toxic if any label says so."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy(F.col("doc_id").alias("of_id")).agg(F.max("toxic").cast("int").alias("toxic"))


def _words(text: str) -> list[str]:
    """Runs of letters in lower case; where all characters are ASCII, a plain character class finds the same ones faster."""
    text = text.lower()
    return (_ASCII_WORD if text.isascii() else _WORD).findall(text)


def _terms(text: str | None) -> set[str]:
    """Distinct words of a text, marked at their end, and their beginnings."""
    words = set(_words(text or ""))
    out = {w + WORD_END for w in words}
    for n in PREFIXES:
        out.update({w[:n] for w in words if len(w) >= n})
    return out


def _document_counts(rows: DataFrame) -> DataFrame:
    """(term, n): documents of ``rows`` that have the term.  Tasks count before the shuffle, some hundred thousand terms at a time."""

    def as_batch(counts):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["term", "n"])

    def of_partition(batches):
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                counts.update(_terms(text.as_py()))
                if len(counts) >= MEMO_TERMS:
                    yield as_batch(counts)
                    counts.clear()
        yield as_batch(counts)

    return rows.select("text").mapInArrow(of_partition, "term string, n long")


def vocabulary(rows: DataFrame, scratch: Scratch) -> list[str]:
    """All terms that toxic documents have significantly more often, by likelihood ratio; ``rows`` has text and toxic.

    Document frequencies cover all training rows, and every term of five toxic documents is tested.  Terms of toxic documents
    are counted first, so that of the others only those are counted.  The driver sees the terms that pass.
    """
    totals = rows.agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("n")).first()
    if not totals["p"] or not totals["n"]:
        return []
    toxic = _document_counts(rows.where("toxic = 1")).groupBy("term").agg(F.sum("n").alias("p"))
    toxic = bounded(scratch.write(toxic.where(F.col("p") >= LEAST_DOCUMENTS)))
    other = _document_counts(rows.where("toxic = 0")).join(toxic.select("term"), "term", "left_semi")
    other = other.groupBy("term").agg(F.sum("n").alias("n"))
    both = toxic.join(other, "term", "left").select("term", "p", F.coalesce("n", F.lit(0)).alias("n"))
    share = totals["p"] / (totals["p"] + totals["n"])
    due = (F.col("p") + F.col("n")) * share
    ratio = F.col("p") * F.log(F.col("p") / due) + F.when(
        F.col("n") > 0, F.col("n") * F.log(F.col("n") / (F.col("p") + F.col("n") - due))
    ).otherwise(0.0)
    best = both.withColumn("ratio", ratio).where((F.col("p") > due) & (F.col("ratio") >= LEAST_RATIO / 2))
    return [r["term"] for r in best.orderBy(F.desc("ratio"), "term").select("term").collect()]


class Known(dict):
    """Numbers of the known terms.  A word can have one only if it is one itself or starts as a known beginning does."""

    def __init__(self, numbers: dict[str, int]) -> None:
        super().__init__(numbers)
        self.whole = {term.removesuffix(WORD_END) for term in numbers if term.endswith(WORD_END)}
        self.starts = {term[:START] for term in numbers if not term.endswith(WORD_END)}

    def telling(self, words: set[str]) -> dict[str, list[int]]:
        """The words that have known terms, with these."""
        starts = self.starts
        likely = (words & self.whole).union([w for w in words if w[:START] in starts])
        return {w: hits for w in likely if (hits := self.hits(w))}

    def hits(self, word: str) -> list[int]:
        terms = [word + WORD_END, *[word[:n] for n in PREFIXES if len(word) >= n]]
        return [self[t] for t in terms if t in self]


def sentences(text: str | None, known: Known) -> tuple[int, list[tuple[int, int, list[int]]]]:
    """Number of sentences with words, and (start, end, term numbers) of those with known terms."""
    text = text or ""
    found = []
    telling = known.telling(set(_words(text)))
    n = len(_FROM_FIRST_LETTER.findall(text))
    if telling:
        for match in _SENTENCE.finditer(text):
            hits = {h for w in _words(match.group()) if w in telling for h in telling[w]}
            if hits:
                found.append((match.start(), match.end(), sorted(hits)))
    return n, found


def _softplus(x):
    return np.logaddexp(0.0, x)


class Model:
    """Bias and one weight for each word of the vocabulary."""

    def __init__(self, words: list[str], weights: np.ndarray) -> None:
        self.words, self.weights = words, weights
        self.known = Known({w: i + 1 for i, w in enumerate(words)})

    def logit(self, hits: list[int]) -> float:
        return float(self.weights[0] + self.weights[hits].sum())

    def document(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Probability that any sentence is toxic, and (start, end, probability) of sentences from one half on."""
        n, found = sentences(text, self.known)
        logits = np.array([self.logit(hits) for _, _, hits in found])
        none = (n - len(found)) * _softplus(self.weights[0]) + _softplus(logits).sum()
        each = 0.5 * (1 + np.tanh(logits / 2))
        bad = [(a, b, float(p)) for (a, b, _), p in zip(found, each) if p >= THRESHOLD]
        return float(-np.expm1(-none)), bad


def _bag(text: str | None, known: Known) -> bytes:
    """A training document in numbers: its sentences, those of them with known terms, then which of these each hit is in, and the
    terms of the hits, in order of terms: hits of one term stand together, so that no pass has to sort."""
    n, found = sentences(text, known)
    terms = np.array([h for _, _, hits in found for h in hits], dtype=np.int32)
    at = np.repeat(np.arange(len(found), dtype=np.int32), [len(hits) for _, _, hits in found])
    order = np.argsort(terms, kind="stable")
    return np.concatenate([np.array([n, len(found)], dtype=np.int32), at[order], terms[order]]).tobytes()


def _sums(bags, toxic: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Number, loss, gradient and diagonal of the Fisher information of documents under noisy-or, in one vector."""
    width, n = len(weights), len(bags)
    parts = [np.frombuffer(b, dtype=np.int32) for b in bags]
    found = np.array([a[1] for a in parts])
    plain = np.array([a[0] for a in parts]) - found
    lengths = [len(a) // 2 - 1 for a in parts]
    hits = np.concatenate([a[2 + k :] for a, k in zip(parts, lengths)])
    document = np.repeat(np.arange(n), found)
    owner = np.repeat(np.arange(n), lengths)
    sentence = np.concatenate([a[2 : 2 + k] for a, k in zip(parts, lengths)]) + (np.cumsum(found) - found)[owner]
    z = weights[0] + np.bincount(sentence, weights[hits], len(document))
    s = _sigmoid(z)
    total = plain * _softplus(weights[0]) + np.bincount(document, _softplus(z), n)
    p = np.maximum(-np.expm1(-total), 1e-12)
    odds = np.exp(-total) / p
    pull = np.where(toxic == 1, -odds, 1.0)
    # slopes of a document's hazard; the Fisher information of a Bernoulli is their square times the odds against
    bias = plain * _sigmoid(weights[0]) + np.bincount(document, s, n)
    first = np.flatnonzero(np.diff(owner * width + hits, prepend=-1))
    slope = np.add.reduceat(s[sentence], first)
    of, term = owner[first], hits[first]
    gradient = np.bincount(term, pull[of] * slope, width).astype(np.float64)  # whole numbers where there is no term
    fisher = np.bincount(term, odds[of] * slope**2, width).astype(np.float64)
    gradient[0], fisher[0] = pull @ bias, odds @ bias**2
    return np.concatenate([[n, np.where(toxic == 1, -np.log(p), total).sum()], gradient, fisher])


def _plain_sums(counted: pd.DataFrame, weights: np.ndarray) -> np.ndarray:
    """``_sums`` of the documents without known terms, which differ by their number of sentences and label alone."""
    out, width = np.zeros(2 + 2 * len(weights)), len(weights)
    sentences = np.array([np.frombuffer(b, dtype=np.int32)[0] for b in counted["bag"]], dtype=np.float64)
    toxic, n = counted["toxic"].to_numpy(), counted["n"].to_numpy()
    total, bias = sentences * _softplus(weights[0]), sentences * _sigmoid(weights[0])
    p = np.maximum(-np.expm1(-total), 1e-12)
    odds = np.exp(-total) / p
    out[0], out[1] = n.sum(), (n * np.where(toxic == 1, -np.log(p), total)).sum()
    out[2], out[2 + width] = (n * np.where(toxic == 1, -odds, 1.0)) @ bias, (n * odds) @ bias**2
    return out


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(x / 2))


def _direction(slope: np.ndarray, diagonal: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Step of the diagonal Fisher information, corrected by ``past`` pairs of steps and changes of the gradient (L-BFGS)."""
    out, shares = -slope, []
    for step, change in reversed(past):
        shares.append(step @ out / (step @ change))
        out = out - shares[-1] * change
    out = out / diagonal
    if past:
        step, change = past[-1]
        out = out * (step @ change / (change @ (change / diagonal)))
    for (step, change), share in zip(past, reversed(shares)):
        out = out + (share - change @ out / (step @ change)) * step
    return out


def minimum(evaluate, weights: np.ndarray) -> np.ndarray:
    """Weights of least penalised loss; ``evaluate`` gives the vector of ``_sums`` over all documents."""
    width = len(weights)
    sums = evaluate(weights)
    if sums[0] == 0:
        return weights
    penalised = lambda sums, w: (sums[1] + RIDGE * w @ w / 2, sums[2 : 2 + width] + RIDGE * w, sums[2 + width :] + RIDGE)
    loss, slope, diagonal = penalised(sums, weights)
    past, step, quiet = [], None, 0
    for _ in range(STEPS):
        if step is None:
            step = _direction(slope, diagonal, past)
            if step @ slope >= 0:
                past, step = [], -slope / diagonal
            step = step * min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        new = penalised(evaluate(weights + step), weights + step)
        if new[0] > loss + 1e-4 * (step @ slope):
            if np.abs(step).max() < 1e-4:
                break
            step = step / 2
            continue
        change = new[1] - slope
        if step @ change > 1e-10 * np.linalg.norm(step) * np.linalg.norm(change):
            past = [*past[1 - MEMORY :], (step, change)]
        quiet = quiet + 1 if loss - new[0] < 1e-6 * abs(new[0]) else 0
        weights, step = weights + step, None
        loss, slope, diagonal = new
        if quiet == 2:
            break
    return weights


def fit(documents: DataFrame, labels: DataFrame, scratch: Scratch) -> Model:
    """Vocabulary and weights.  Without toxic or without clean training documents the vocabulary is empty.

    Documents without known terms, most of all, are counted once by their number of sentences (the driver sees one row for each
    such number); a pass reads the others.
    """
    known_labels = bounded(scratch.write(training(labels)))
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(known_labels, texts["doc_id"] == known_labels["of_id"]).select("text", "toxic")
    words = vocabulary(rows, scratch)
    model = Model(words, np.zeros(len(words) + 1))

    @F.pandas_udf("binary")
    def bag(texts: pd.Series) -> pd.Series:
        return pd.Series([_bag(t, model.known) for t in texts])

    # a bag begins with the number of sentences and that of those with known terms; without any it is these two alone
    bags = scratch.write(rows.select("toxic", bag("text").alias("bag")))
    plain = bags.where(F.octet_length("bag") == 8).groupBy("bag", "toxic").agg(F.count(F.lit(1)).alias("n")).toPandas()
    telling = scratch.write(bags.where(F.octet_length("bag") > 8))
    telling = scratch.write(telling.repartition(1 + telling.count() // BAGS_A_TASK))  # few tasks a pass: they are small

    def evaluate(weights: np.ndarray) -> np.ndarray:
        with small_batches(rows.sparkSession, BAG_BATCH):
            found = summed(telling, lambda batch: _sums(batch["bag"], batch["toxic"].to_numpy(), weights), 2 + 2 * len(weights))
        return found + _plain_sums(plain, weights)

    model.weights = minimum(evaluate, np.concatenate([[-4.0], np.full(len(words), 2.0)]))
    return model


def detected(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from one half on), sentences (start, end, score of those
    that offend, in characters).

    NULL, empty and wordless texts have score 0 and no sentences; rows without an id count as held out.  Repeated rows are
    scored alike; NULL labels and labels without a document are not used.
    """
    spark = documents.sparkSession
    with Scratch(spark, "toxicity") as scratch, small_batches(spark):
        model = fit(documents, labels, scratch)

        @F.pandas_udf("score double, sentences array<struct<start:int,end:int,score:double>>")
        def score(texts: pd.Series) -> pd.DataFrame:
            found = [model.document(t) for t in texts]
            return pd.DataFrame({
                "score": [p for p, _ in found],
                "sentences": [[{"start": a, "end": b, "score": s} for a, b, s in bad] for _, bad in found],
            })

        rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("x"))
        rows = rows.select("doc_id", "held_out", F.col("x.score").alias("score"),
                           (F.col("x.score") >= THRESHOLD).cast("int").alias("predicted"), F.col("x.sentences").alias("sentences"))
        return scratch.write(rows, keep=True)


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``detected`` with the number of offending sentences in place of the sentences."""
    return detected(documents, labels).withColumn("n_offending", F.size("sentences").cast("long")).drop("sentences")

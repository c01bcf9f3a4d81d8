"""Quality from weak labels: overlapping heuristic labellers, their accuracies by EM, and a hashed linear scorer.

Labellers vote good, bad or nothing. Votes are counted by pattern, of which there are at most 3 to the number of
labellers, so expectation-maximisation covers every document and still runs on a few thousand rows. The posterior of a
pattern labels its documents; a logistic scorer over hashed words and word shapes is trained on a bounded sample of
them and judges also what the labellers leave open.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from holdfast.llm.scratch import once, small_batches, stored

GOOD, BAD, NONE = 1, -1, 0
BUCKETS = 1 << 14
# Documents the scorer is trained on, about; chosen by hash. At most 100 KB each, usually 2 KB.
SAMPLE = 5000
STEPS, RATE, DECAY = 150, 0.5, 1e-4
# Words whose buckets a task remembers, and the characters of the longest of them.
MOST_WORDS = 200_000
LONGEST_WORD = 64


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, BAD)
    return (vote.when(good, GOOD) if good is not None else vote).otherwise(NONE)


def labellers(text: Column) -> dict[str, Column]:
    """The votes on a text, each a heuristic of its own."""
    length = F.greatest(F.char_length(text), F.lit(1))
    share = lambda kind: (length - F.char_length(F.regexp_replace(text, kind, ""))) / length
    letters = F.greatest(F.char_length(F.regexp_replace(text, r"[^\p{L}]+", "")), F.lit(1))
    capitals = F.char_length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) / letters
    symbols = share(r"[^\p{L}\p{N}\s.,;:!?'\"()|-]+")
    listed = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    words = F.size(listed)
    lines = F.filter(F.split(text, r"\n"), lambda line: F.trim(line) != "")
    n_lines = F.greatest(F.size(lines), F.lit(1))
    ended = F.size(F.filter(lines, lambda line: line.rlike(r"[.!?…。？！]\s*$"))) / n_lines
    repeated = 1 - F.size(F.array_distinct(lines)) / n_lines
    return {
        "symbols": _vote(symbols >= 0.05, symbols < 0.01), "capitals": _vote(capitals >= 0.3, capitals < 0.1),
        "bars": _vote(share(r"\|+") >= 0.02, share(r"\|+") == 0), "shouts": _vote(share("!+") >= 0.04, share("!+") < 0.005),
        "sentences": _vote(ended < 0.2, ended >= 0.8), "length": _vote(words < 3, words >= 40),
        "repetition": _vote(repeated >= 0.3),
        # The number of different words grows about as the square root of the length, or faster.
        "variety": _vote((words >= 20) & (F.size(F.array_distinct(listed)) < 2 * F.sqrt(words))),
        # Possessive, as each further word of a run would take stack otherwise: some 1,000 repeats end an executor.
        "runs": _vote(share(r"(?<!\S)(\S++)(?:\s+\1(?!\S))++") >= 0.2),
        "letters": _vote(letters / length < 0.6, letters / length >= 0.75)}


@dataclass(frozen=True)
class LabelModel:
    """Chance of each vote (bad, none, good) of each labeller for bad and good documents, and the share of good ones."""

    names: tuple[str, ...]
    votes: np.ndarray  # (class, labeller, vote)
    good: float

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance of good per pattern of votes -1, 0, 1."""
        at = np.arange(patterns.shape[1])
        logs = [np.log(self.votes[c][at, patterns + 1]).sum(axis=1) + np.log(p) for c, p in ((0, 1 - self.good), (1, self.good))]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))

    def accuracies(self) -> dict[str, float]:
        """Chance that a labeller that votes is right."""
        right = self.good * self.votes[1, :, 2] + (1 - self.good) * self.votes[0, :, 0]
        voted = self.good * (1 - self.votes[1, :, 1]) + (1 - self.good) * (1 - self.votes[0, :, 1])
        return dict(zip(self.names, (right / voted).tolist()))


def estimate(names: tuple[str, ...], patterns: np.ndarray, counts: np.ndarray, steps: int = 200) -> LabelModel:
    """EM over vote patterns with their counts; every chance stays off 0 and 1.

    A document is bad for one defect of several, so EM begins from the belief that any vote for bad is right.
    """
    belief = np.where((patterns == BAD).any(axis=1), 0.1, 0.9)
    model = LabelModel(names, np.full((2, len(names), 3), 1 / 3), 0.5)
    for _ in range(steps if len(counts) else 0):
        weights = np.stack([(1 - belief) * counts, belief * counts])
        votes = np.stack([[np.bincount(patterns[:, j] + 1, weights=w, minlength=3) + 1 for j in range(len(names))] for w in weights])
        model = LabelModel(names, votes / votes.sum(axis=2, keepdims=True), float((weights[1].sum() + 1) / (counts.sum() + 2)))
        now = model.posterior(patterns)
        if np.abs(now - belief).max() < 1e-9:
            break
        belief = now
    return model


def voted(docs: DataFrame) -> DataFrame:
    """``doc_id, text, votes`` per row; NULL texts are judged as empty ones."""
    text = F.coalesce("text", F.lit(""))
    marks = [v.cast("tinyint") for v in labellers(F.col("text")).values()]
    return docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.array(*marks).alias("votes"))


def fit_labels(votes: DataFrame) -> tuple[LabelModel, DataFrame]:
    """The model, and ``votes, posterior`` for every pattern (at most 3 to the number of labellers)."""
    spark = votes.sparkSession
    names = tuple(labellers(F.lit("")))
    rows = votes.groupBy("votes").agg(F.count("*").alias("n")).collect()
    rows.sort(key=lambda r: r["votes"])
    patterns = np.array([r["votes"] for r in rows], dtype=np.int64).reshape(-1, len(names))
    model = estimate(names, patterns, np.array([r["n"] for r in rows], dtype=float))
    chances = model.posterior(patterns) if rows else []
    table = spark.createDataFrame([(p.tolist(), float(c)) for p, c in zip(patterns, chances)],
                                  "votes array<tinyint>, posterior double")
    return model, table


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text: its words and their shapes, hashed; values have length 1 together."""
    known = once(("word buckets",), dict)
    if len(known) > MOST_WORDS:
        known.clear()
    places: list[int] = []
    for word in text.split():
        pair = known.get(word)
        if pair is None:
            shape = re.sub(r"[^\W\d_a-zß-ÿ]+", "X", re.sub(r"[a-zß-ÿ]+", "x", word))
            pair = tuple(crc32(s.encode("utf-8", "replace")) % BUCKETS for s in (word.lower(), "shape " + shape[:32]))
            if len(word) <= LONGEST_WORD:
                known[word] = pair
        places += pair
    if not places:
        return np.empty(0, dtype=np.int32), np.empty(0)
    buckets, n = np.unique(places, return_counts=True)
    values = np.log1p(n)
    return buckets.astype(np.int32), values / np.sqrt((values ** 2).sum())


def train(sample: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer by gradient steps with momentum on soft labels."""
    weights, bias = np.zeros(BUCKETS), 0.0
    if not sample:
        return weights, bias
    sizes = np.array([len(b) for b, _, _ in sample])
    rows = np.repeat(np.arange(len(sample)), sizes)
    buckets, values = (np.concatenate([s[i] for s in sample]) for i in (0, 1))
    wanted = np.array([p for _, _, p in sample])
    slope, bias_slope, scale = np.zeros(BUCKETS), 0.0, 8.0
    for _ in range(STEPS):
        raw = np.bincount(rows, weights=values * weights[buckets], minlength=len(sample)) * scale + bias
        error = 1 / (1 + np.exp(-np.clip(raw, -50, 50))) - wanted
        slope = 0.9 * slope + np.bincount(buckets, weights=values * error[rows], minlength=BUCKETS) * scale / len(sample) + DECAY * weights
        bias_slope = 0.9 * bias_slope + error.mean()
        weights, bias = weights - RATE * slope, bias - RATE * bias_slope
    return weights * scale, bias


def score_quality(docs: DataFrame, sample: int = SAMPLE, least_score: float = 0.5) -> DataFrame:
    """One row per input row: ``doc_id, posterior, score, kept``.

    ``posterior`` is the label model's chance that the document is good, ``score`` the linear scorer's; ``kept`` when
    their mean is ``least_score`` or more. NULL and empty texts are judged by the labellers that see them as short.
    Repeated rows are judged alike; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # The labellers' patterns are the dear part: they see each text once, and their votes are written beside it.
    votes = stored(voted(docs), "votes")
    total = votes.count()
    _, table = fit_labels(votes)
    labelled = votes.join(F.broadcast(table), "votes")
    share = min(1.0, sample / max(total, 1))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1))

    def describe(batches):
        for batch in batches:
            found = [features(t) for t in batch.text]
            yield pd.DataFrame({"buckets": [b.tobytes() for b, _ in found], "numbers": [v.tobytes() for _, v in found],
                                "posterior": batch.posterior})

    rows = (chosen.select("text", "posterior")
            .mapInPandas(describe, "buckets binary, numbers binary, posterior double")
            .orderBy(F.xxhash64("buckets", "numbers"), "posterior").limit(2 * sample).collect())
    weights, bias = train([(np.frombuffer(b, np.int32), np.frombuffer(n, float), p) for b, n, p in rows])
    shared = spark.sparkContext.broadcast((weights, bias))

    def judge(texts: pd.Series) -> pd.Series:
        own, base = shared.value
        raw = [float((own[b] * v).sum()) + base for b, v in map(features, texts)]
        return pd.Series(1 / (1 + np.exp(-np.clip(raw, -50, 50))), dtype=float)

    score = F.pandas_udf(judge, DoubleType())
    return (labelled.select("doc_id", "posterior", score(F.col("text")).alias("score"))
            .withColumn("kept", (F.col("posterior") + F.col("score")) / 2 >= least_score))

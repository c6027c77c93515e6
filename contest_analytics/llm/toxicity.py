"""Toxicity by weak supervision.

Many voters look at a text: *patterns* (a beginning that words share, an n-gram of a script
without spaces) and *lexicons* (word lists); the annotated label is one voter more. A generative model of the votes
estimates how often each voter fires on toxic and on clean texts, by expectation
maximisation, and how strongly voters correlate within a class; a voter that repeats
others counts less. Its posterior labels train a linear classifier over words and word
beginnings, which scores whole texts.

Lexicons and patterns are found in the labelled rows: pieces that far more toxic than
clean documents hold. Everything that is fitted uses a bounded sample of labelled rows
(``PER_CLASS`` of each class).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contest_analytics.llm.common import fold, text_rows
from contest_analytics.llm.subword import sample

#: Most labelled rows of a class that everything is fitted on.
PER_CLASS = 2000
#: Beginnings of these lengths are patterns; whole words are lexicon entries.
BEGINNINGS = (4, 5, 6)
PATTERNS, LEXICONS = 80, 24
#: Features of the linear classifier.
FEATURES = 512
#: Toxic documents that a piece must be in, how much likelier it must be in these than in
#: clean ones, and the product of the first and the logarithm of the second.
SUPPORT, LIFT, GAIN = 3, 4.0, 12.0
#: Voters correlate from here on; less is taken for chance.
CORRELATED = 0.2
#: An annotation is right in no larger share of the rows, so that other voters can outvote it.
TRUST = 0.98
#: Longest word whose pieces are remembered, and how many words.
LONGEST, CACHE = 64, 400_000
#: Lengths of the n-grams of scripts that are written without spaces.
GRAMS = (2, 3)
# The blocks of scripts without spaces (Thai, Lao, Myanmar, Khmer, kana, Han).
SPACELESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: Stretches of one kind: of such a script, or of letters and digits.
RUN = re.compile(f"[{SPACELESS}]+|[^\\W_{SPACELESS}]+")
LETTERS = re.compile(r"[^\W\d_]+")
SPACELESS_LETTER = re.compile(f"[{SPACELESS}]")


def pieces(word: str) -> list[str]:
    """Pieces of all stretches of letters and digits of a word, wherever they stand in it.

    A stretch gives itself (``=`` marks a whole one) and its beginnings, and one with digits
    those of its letters as well. A stretch of a script without spaces gives its n-grams (``~``).
    """
    found: list[str] = []
    for run in RUN.findall(word.lower()):
        if SPACELESS_LETTER.match(run):
            found += ["~" + run[i : i + n] for n in GRAMS for i in range(len(run) - n + 1)]
            continue
        parts = [run] if run.isalpha() else [run, *LETTERS.findall(run)]
        for part in parts:
            found += ["=" + part, *(part[:n] for n in BEGINNINGS if len(part) >= n)]
    return found


def document_pieces(text: str | None) -> set[str]:
    found: set[str] = set()
    for word in set((text or "").split()):
        found.update(pieces(word))
    return found


@dataclass
class Model:
    """Linear classifier: weight of each piece, and the bias."""

    weights: dict[str, float]
    bias: float

    def score_all(self, texts: Iterable[str | None]) -> Iterator[float]:
        weights = self.weights

        class Known(dict):
            def __missing__(self, word: str) -> tuple:
                if len(self) >= CACHE:
                    self.clear()
                found = tuple(p for p in pieces(word) if p in weights)
                if len(word) <= LONGEST:
                    self[word] = found
                return found

        known = Known()
        for text in texts:
            held: set[str] = set()
            for word in set((text or "").split()):
                if found := known[word]:
                    held.update(found)
            z = self.bias + sum(weights[p] for p in sorted(held))
            yield float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def find_voters(held: list[set[str]], toxic: np.ndarray) -> tuple[list[list[str]], list[str]]:
    """Voters, each a list of pieces of which any makes it fire, and all telling pieces."""
    bad, good = Counter(), Counter()
    for pieces_of, label in zip(held, toxic, strict=True):
        (bad if label else good).update(pieces_of)
    n_bad, n_good = max(int(toxic.sum()), 1), max(int((1 - toxic).sum()), 1)

    def lift(piece: str) -> float:
        return (bad[piece] / n_bad) / ((good[piece] + 0.5) / n_good)

    def gain(piece: str) -> float:
        return bad[piece] * np.log(lift(piece))

    often = [p for p in bad if bad[p] >= SUPPORT and lift(p) >= LIFT and gain(p) >= GAIN]
    telling = sorted(often, key=lambda p: (-gain(p), p))
    patterns = [[p] for p in telling if p[0] != "="][:PATTERNS]
    words = [p for p in telling if p[0] == "="]
    lexicons = [words[i::LEXICONS] for i in range(min(LEXICONS, len(words)))]
    return patterns + lexicons, telling


def label_model(votes: np.ndarray, labels: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, dict]:
    """Posterior probability of label 1 for each row of ``votes`` (0 or 1 per voter).

    ``labels`` starts the estimate and is the last voter. Returned beside it: each voter's
    rate of firing per class, and its weight after correlations.
    """
    everyone = np.column_stack([votes, labels]).astype(np.float64)
    posterior = np.where(labels == 1, 0.9, 0.1)
    weight = np.ones(everyone.shape[1])
    rates = np.zeros((2, everyone.shape[1]))
    for _ in range(rounds):
        shares = np.stack([1 - posterior, posterior])
        rates = (shares @ everyone + 0.5) / (shares.sum(axis=1)[:, None] + 1.0)
        rates[:, -1] = np.clip(rates[:, -1], 1 - TRUST, TRUST)
        # What is left of the votes once the class is known; voters that still move together repeat each other.
        rest = everyone - shares.T @ rates
        scale = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        together = (rest / scale).T @ (rest / scale) / len(everyone)
        np.fill_diagonal(together, 0)
        together[together < CORRELATED] = 0
        weight = 1 / (1 + together.sum(axis=0))
        weight[-1] = 1  # the annotation repeats no voter
        log_one = everyone * np.log(rates[1]) + (1 - everyone) * np.log(1 - rates[1])
        log_zero = everyone * np.log(rates[0]) + (1 - everyone) * np.log(1 - rates[0])
        odds = np.log(prior / (1 - prior)) + (log_one - log_zero) @ weight
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return posterior, {"rates": rates, "weights": weight}


def linear_fit(rows: np.ndarray, target: np.ndarray, rounds: int = 12, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps; ``ridge`` holds the weights small."""
    x = np.column_stack([rows, np.ones(len(rows))]).astype(np.float64)
    hold = np.full(x.shape[1], ridge)
    hold[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - target) + hold * w
        curve = (x.T * np.maximum(p * (1 - p), 1e-4)) @ x + np.diag(hold)
        w = w - np.clip(np.linalg.solve(curve, slope), -2, 2)
    return w[:-1], float(w[-1])


def fit_rows(held: list[set[str]], toxic: np.ndarray, prior: float) -> Model:
    """The classifier from the pieces and labels of sampled documents."""
    if not len(toxic) or toxic.min() == toxic.max():
        return Model({}, float(np.log(prior / (1 - prior))))
    voters, telling = find_voters(held, toxic)
    fires = np.array([[any(p in h for p in v) for v in voters] for h in held], bool).reshape(len(held), -1)
    share = float(toxic.mean())
    posterior, _ = label_model(fires, toxic, share)
    chosen = telling[:FEATURES]
    place = {p: i for i, p in enumerate(chosen)}
    rows = np.zeros((len(held), len(chosen)), np.float32)
    for i, h in enumerate(held):
        rows[i, [place[p] for p in h if p in place]] = 1
    w, b = linear_fit(rows, posterior)
    # The sample holds the classes in other shares than the labels do.
    b += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return Model({p: float(x) for p, x in zip(chosen, w, strict=True) if x}, float(b))


def fit(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text"
) -> Model:
    """A model of ``labels.toxic`` from rows whose crc32(id) mod 5 is not 0."""
    known = labels.select(F.col("doc_id").alias(id_col), F.col("toxic").cast("int").alias("_label")).filter(
        F.col(id_col).isNotNull() & F.col("_label").isin(0, 1) & (fold(id_col) != 0)
    )
    sizes = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (sizes.get(1, 0) + 1.0) / (sum(sizes.values()) + 2.0)
    # The sample has a fixed bound of rows, so it may be sent to every task.
    chosen = sample(known, "_label", per_class, 2, id_col)
    named = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), id_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_rows(batches):
            held = [" ".join(sorted(document_pieces(t))) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.string()), batch.column(1), batch.column(2)], ["pieces", "label", "h"]
            )

    hashed = named.select("_text", F.col("_label").alias("label"), F.xxhash64(id_col, "_text").alias("h"))
    few = hashed.mapInArrow(run, "pieces string, label int, h long").orderBy("h").limit(2 * per_class).collect()
    return fit_rows([set(r["pieces"].split()) for r in few], np.array([r["label"] for r in few], int), prior)


def score(model: Model, text: Column) -> Column:
    """Probability that a text is toxic."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(model.score_all(texts)), dtype="float64")

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (score of 0.5 or more) of every row.

    Defined cases: null, empty and blank texts get the score of a text without any
    telling piece; null ids count as held out; without labels of both classes every score
    is the smoothed share of toxic labels; repeated rows stay; other columns are ignored;
    an empty table gives no rows.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    scored = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (fold(id_col) == 0).alias("held_out"),
        score(model, F.col(text_col).cast("string")).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

"""Toxicity by a classifier chain: linear models in a fixed order, each fed with the probabilities of those before it.

Categories are predicted one after the other. A category's model sees the words of the text and the probabilities of the
earlier categories; in training these come from models that haven't seen the row (out of fold), so that later models
learn how far to trust them. The last category is toxicity itself, with labels from the table; the narrower ones before
it are labelled where a toxic text holds a word of their lists.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import keep_texts, per_text, small_enough

#: Categories before the last: a text with label toxic and one of these words has the category.
CATEGORIES = {
    "insult": ("idiot", "moron", "stupid", "dumb", "fool", "loser", "clown", "imbecile", "jerk", "ignorant"),
    "contempt": ("worthless", "pathetic", "trash", "scum", "disgusting", "garbage", "filth", "vermin", "useless", "despicable"),
    "threat": ("kill", "murder", "shoot", "strangle", "behead", "lynch", "stab"),
}
#: Labelled rows that training takes at most (half of each label, if there are as many), words it looks at, folds.
SAMPLE, VOCABULARY, FOLDS, FEWEST = 8000, 4000, 3, 20
#: Chi-squared that a word must reach to be looked at: chance alone gets there once in a hundred thousand words.
EVIDENCE = 20.0
L2, ROUNDS = 0.5, 150
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


class Rows:
    """Sparse binary rows with some dense columns."""

    def __init__(self, lists: list[list[int]], size: int):
        self.lengths = np.array([len(x) for x in lists], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(lists)), self.lengths)
        self.at = np.array([i for x in lists for i in x], dtype=np.int64)
        self.size, self.n = size, len(lists)

    def take(self, rows: np.ndarray) -> Rows:
        new = np.full(self.n, -1)
        new[rows] = np.arange(len(rows))
        keep = new[self.owner] >= 0
        out = Rows([], self.size)
        out.owner, out.at, out.n = new[self.owner[keep]], self.at[keep], len(rows)
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.at], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, g[self.owner], minlength=self.size)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(rows: Rows, dense: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the words, the dense columns and a bias, by accelerated gradient steps on the L2-penalised log loss."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(rows.size + dense.shape[1] + 1)
    v, grad_sq = w.copy(), np.full_like(w, 1e-8)
    for _ in range(ROUNDS):
        p = sigmoid(rows.times(v) + dense @ v[rows.size : -1] + v[-1])
        gap = (p - y) * weight
        g = np.concatenate((rows.back(gap), dense.T @ gap, [gap.sum()])) + np.append(L2 * v[:-1], 0.0)
        grad_sq += g * g
        v = v - 0.5 * g / np.sqrt(grad_sq)
    return v


def predict(rows: Rows, dense: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(rows.times(w) + dense @ w[rows.size : -1] + w[-1])


def _vocabulary(bags: list[set[str]], toxic: np.ndarray) -> dict[str, int]:
    """The words that differ most between the labels, by chi-squared of their presence."""
    held: dict[str, list[int]] = {}
    for bag, y in zip(bags, toxic, strict=True):
        for word in bag:
            held.setdefault(word, [0, 0])[int(y)] += 1
    n1 = max(1, int(toxic.sum()))
    n0 = max(1, len(toxic) - n1)
    n = n0 + n1

    def chi(a: int, b: int) -> float:
        return n * (b * (n0 - a) - a * (n1 - b)) ** 2 / max(1.0, float((a + b) * (n - a - b) * n0 * n1))

    scored = sorted((-x, word) for word, (a, b) in held.items() if a + b >= 5 and (x := chi(a, b)) >= EVIDENCE)
    return {word: i for i, (_, word) in enumerate(scored[:VOCABULARY])}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, int], list[tuple[str, np.ndarray]], float]:
    """Vocabulary, the chain's models in order (categories with fewer than FEWEST cases are left out) and the threshold.

    The rows are those whose hash of doc_id is least, in equal parts of both labels; a doc_id with several labels counts as
    toxic if one says so.
    """
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    half = sample // 2
    parts = [one.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half) for y in (0, 1)]
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    chosen = plain.join(small_enough(parts[0].union(parts[1])), "doc_id").toPandas()
    chosen = chosen.sort_values(["doc_id", "text"]).drop_duplicates("text")
    bags, toxic = [words_of(t) for t in chosen["text"]], chosen["toxic"].to_numpy(dtype=float)
    vocabulary = _vocabulary(bags, toxic)
    rows = Rows([[vocabulary[w] for w in bag if w in vocabulary] for bag in bags], len(vocabulary))
    targets = {name: np.array([y > 0 and not bag.isdisjoint(words) for bag, y in zip(bags, toxic, strict=True)], dtype=float) for name, words in CATEGORIES.items()} | {"toxic": toxic}
    fold = np.arange(len(toxic)) % FOLDS
    dense, chain, apart = np.zeros((len(toxic), 0)), [], np.zeros(len(toxic))
    for name, y in targets.items():
        if y.sum() < FEWEST or (1 - y).sum() < FEWEST:
            continue
        apart = np.zeros(len(toxic))
        for k in range(FOLDS):
            inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            model = train(rows.take(inside), dense[inside], y[inside])
            apart[outside] = predict(rows.take(outside), dense[outside], model)
        chain.append((name, train(rows, dense, y)))
        dense = np.column_stack((dense, apart))
    return vocabulary, chain, _threshold(apart, toxic) if chain and chain[-1][0] == "toxic" else 2.0


def _threshold(odds: np.ndarray, y: np.ndarray) -> float:
    """The middle of the thresholds with the best F1 out of fold."""
    tried = np.linspace(0.05, 0.95, 91)
    f1 = np.array([2 * ((odds >= t) & (y > 0)).sum() / max(1, (odds >= t).sum() + (y > 0).sum()) for t in tried])
    return float(np.median(tried[f1 >= f1.max() - 1e-9]))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, one probability for each category (p_insult, ..., p_toxic) and toxic (boolean) of each row of docs.

    Null and empty texts hold no words: probabilities 0 and not toxic. Without enough labels of both kinds the missing
    categories have probability 0 and nothing is toxic. Rows are judged one by one: repeated rows repeat, a null doc_id
    stays null, columns other than doc_id and text are ignored.
    """
    setup, names = _judge(docs, labels, sample)
    return per_text(docs, setup, **{f"p_{n}": "double" for n in names}, toxic="boolean")


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns unchanged, that classify() doesn't find toxic."""
    setup, _ = _judge(docs, labels, sample)

    def keep() -> Callable[[list[str]], list[bool]]:
        of = setup()
        return lambda texts: [not row[-1] for row in of(texts)]

    return keep_texts(docs, keep)


def _judge(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[Callable[[], Callable[[list[str]], list[tuple]]], list[str]]:
    vocabulary, chain, threshold = fit(docs, labels, sample)
    names = [*CATEGORIES, "toxic"]
    models = [(names.index(name), w[: len(vocabulary)], w[len(vocabulary) : -1], w[-1]) for name, w in chain]

    def setup() -> Callable[[list[str]], list[tuple]]:
        def one(text: str) -> tuple:
            at = [vocabulary[w] for w in words_of(text) if w in vocabulary]
            odds, earlier = [0.0] * len(names), []
            if not text.strip():
                return *odds, False
            for place, words, fed, bias in models:
                odds[place] = float(sigmoid(words[at].sum() + fed @ np.array(earlier) + bias))
                earlier.append(odds[place])
            return *odds, bool(odds[-1] >= threshold)

        return lambda texts: [one(t) for t in texts]

    return setup, names

"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, trained by FTRL-proximal.

n-grams of one to three characters of the lower-cased text are counted in SIZE hashed places. Document frequencies are
counted over all training documents; the weights are trained on a bounded sample of them (SAMPLE rows, spread evenly over
languages by a hash of doc_id) with per-coordinate rates and elastic-net penalties, so most weights are exactly zero.
A temperature, chosen on a fifth of the sample that the weights don't see, makes the scores match the hit rate.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import per_text, small_enough

SIZE, SAMPLE = 1 << 15, 4000
#: FTRL-proximal: rate, its offset, the weights of the L1 and L2 penalties, and passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.02, 0.001, 3
UNKNOWN = "und"
_SPREAD = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The places of the text's n-grams and their counts."""
    points = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    mixed = points * _SPREAD[0]
    mixed ^= mixed >> np.uint32(15)
    found, key = [mixed >> np.uint32(17)], mixed
    for n in (1, 2):
        key = key[:-1] * _SPREAD[n] + mixed[n:]
        found.append((key ^ key >> np.uint32(15)) * _SPREAD[0] >> np.uint32(17))
    counts = np.bincount(np.concatenate(found), minlength=SIZE)
    places = np.flatnonzero(counts)
    return places, counts[places]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    places, counts = ngrams(text)
    values = (1 + np.log(counts)) * idf[places]
    return places, values / max(1e-12, float(np.sqrt(values @ values)))


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """In how many texts each place occurs; each task sums its own rows first."""
    import pyarrow as pa

    def run(batches):
        held = np.zeros(SIZE, np.int64)
        for batch in batches:
            for text in batch.column(0):
                held[ngrams(text.as_py())[0]] += 1
        places = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(held[places])], ["place", "n"])

    rows = docs.where("text IS NOT NULL").select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    out = np.zeros(SIZE)
    for place, n in rows.collect():  # SIZE rows at most
        out[place] = n
    return out


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, classes: int) -> np.ndarray:
    """Weights (classes, SIZE + 1), the last column a bias without penalty."""
    z, n = np.zeros((classes, SIZE + 1)), np.zeros((classes, SIZE + 1))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zz, nn = z[:, at], n[:, at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(PASSES):
        for i in order.permutation(len(rows)):
            at, x = np.append(rows[i][0], SIZE), np.append(rows[i][1], 1.0)
            w = weights(at)
            gap = softmax(w @ x)
            gap[target[i]] -= 1
            g = gap[:, None] * x
            rate = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / ALPHA
            z[:, at] += g - rate * w
            n[:, at] += g * g
    return weights(slice(None))


def logits_of(rows: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    return np.array([weights[:, at] @ x + weights[:, -1] for at, x in rows]).reshape(len(rows), len(weights))


def temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature with the least loss on held-out logits."""
    if not len(target):
        return 1.0
    tried = np.geomspace(0.05, 10, 60)
    losses = [-np.log(softmax(logits / t)[np.arange(len(target)), target] + 1e-12).mean() for t in tried]
    return float(tried[int(np.argmin(losses))])


def fit(docs: DataFrame, label: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, IDF and calibrated weights learned from the rows of docs with text and label."""
    known = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull()).select(F.col(label).cast("string").alias("label"), "doc_id", "text")
    held = document_frequencies(known)
    idf = np.log((1 + held.max(initial=0)) / (1 + held)) + 1
    counts = known.groupBy("label").count()
    share = small_enough(counts.select("label", (F.lit(float(sample)) / F.lit(max(1, counts.count())) / F.col("count")).alias("rate")))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = known.select("label", "doc_id").join(share, "label").where(draw < F.col("rate")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample)
    chosen = known.join(small_enough(drawn.select("doc_id").distinct()), "doc_id", "left_semi").select("label", "text").toPandas()
    chosen = chosen.drop_duplicates().sort_values(["text", "label"], ignore_index=True)  # one order however rows are dealt, and no text on both sides of the calibration
    names = sorted(chosen["label"].unique())
    rows = [vector(t, idf) for t in chosen["text"]]
    target = np.array([names.index(x) for x in chosen["label"]], dtype=int)
    apart = np.random.default_rng(11).permutation(len(rows)) % 5 == 4
    if len(names) < 2:
        return names, idf, np.zeros((len(names), SIZE + 1))
    seen = [r for r, a in zip(rows, apart, strict=True) if not a]
    weights = train_ftrl(seen, target[~apart], len(names))
    t = temperature(logits_of([r for r, a in zip(rows, apart, strict=True) if a], weights), target[apart])
    return names, idf, weights / t


def identify(docs: DataFrame, train: Column, label: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs; learned from rows where train holds and label isn't null.

    A text that is null or has no letter is und with score 0; so is every text if no training row has a label. With a
    single label that label is predicted with score 1. Repeated rows repeat, a null doc_id stays null, and no column but
    the text enters a prediction. Texts that repeat count each for document frequencies and once for weights; of languages
    that tie the first by name is predicted. Equal tables give equal results however their rows are dealt.
    """
    names, idf, weights = fit(docs.where(train), label, sample)

    def setup() -> Callable[[list[str]], list[tuple]]:
        def one(text: str) -> tuple:
            if not names or not any(map(str.isalpha, text)):
                return UNKNOWN, 0.0
            at, x = vector(text, idf)
            odds = softmax(weights[:, at] @ x + weights[:, -1])
            best = int(np.argmax(odds))
            return names[best], float(odds[best])

        return lambda texts: [one(t) for t in texts]

    return per_text(docs, setup, lang_pred="string", score="double")

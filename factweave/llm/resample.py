"""Importance resampling towards a target distribution: hashed n-grams, weights from an array of gains, distributed quickselect.

Features are runs of one to three words. Two passes read the texts: one counts the features of each bucket in all documents
and in all target texts (a task sends one row for each bucket), one adds up, for each document, the gains of its features'
buckets out of an array. A draw by Gumbel noise then keeps the documents with the highest scores.

The k-th score isn't found by sorting all: a round draws pivot keys at random from the rows that are still open, counts how
many rows stand before and at each pivot, and goes on between the two pivots that enclose the k-th. Only what stands up to
the k-th key is sorted, in ranges whose sizes give the ranks.

Hashes are made in bulk: crc32 of two strings joined is the first one's crc32, moved on by the length of the second (a linear
map, looked up in tables), combined with that of the second; so each word is hashed once, whatever runs it is in.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.common import give_back, lean_worker, parts_of, settle, small_enough, texts_of

#: Buckets of features, words in the longest run, the fewest words of a document that can be drawn, percentage drawn.
BUCKETS, LONGEST, LEAST_WORDS, PERCENT = 10_000, 3, 20, 5
#: Bytes of text that are worked on at once; pivots of a round.
PART, PIVOTS = 1 << 20, 15

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _crc_table() -> np.ndarray:
    made = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        made = np.where(made & 1, (made >> 1) ^ np.uint32(0xEDB88320), made >> 1).astype(np.uint32)
    return made


_CRC = _crc_table()
#: Lengths up to this are moved by one look into the tables; words that are longer are hashed one by one.
_SHORT = 64


def _byte_tables(length: int) -> np.ndarray:
    """What moving on by so many bytes makes of each byte at each of the four places."""
    made = (np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]).astype(np.uint32)
    for _ in range(length):
        made = _CRC[made & 255] ^ (made >> 8)
    return made


_BY_LENGTH = np.stack([_byte_tables(n) for n in range(_SHORT + 1)])


def _moved(tables: np.ndarray, crc: np.ndarray, which: np.ndarray) -> np.ndarray:
    return tables[which, 0, crc & 255] ^ tables[which, 1, (crc >> 8) & 255] ^ tables[which, 2, (crc >> 16) & 255] ^ tables[which, 3, crc >> 24]


def _powers() -> np.ndarray:
    """Tables for moving on by 1, 2, 4, ... bytes."""
    made = [_byte_tables(1)]
    for _ in range(31):
        made.append(_moved(made[-1][None], made[-1], np.zeros_like(made[-1], np.intp)))
    return np.stack(made)


_BY_POWER = _powers()


def moved_on(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The part of a crc32 that is left after so many further bytes."""
    out = _moved(_BY_LENGTH, crc, np.minimum(length, _SHORT))
    far = np.flatnonzero(length > _SHORT)
    if len(far):
        value, left = crc[far], length[far]
        for bit in range(int(left.max()).bit_length()):
            value = np.where(left >> bit & 1, _moved(_BY_POWER, value, np.full(len(far), bit)), value)
        out[far] = value
    return out


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in lower-cased bytes of texts one after the other; none goes across a bound."""
    inside = _WORD[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = bounds[(bounds > 0) & (bounds < len(data))]
    before[cuts], after[cuts - 1] = False, False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    order = np.argsort(-lengths, kind="stable")
    long_ones = int(np.count_nonzero(lengths > _SHORT))
    out = np.empty(len(starts), np.uint32)
    for i in order[:long_ones]:
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]])
    order = order[long_ones:]
    at, sizes = starts[order], -lengths[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for place in range(-int(sizes[0]) if len(order) else 0):
        n = int(np.searchsorted(sizes, -place))  # words with a byte at this place
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + place]) & 255] ^ (crc[:n] >> 8)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def features(texts: pa.Array, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """The crc32 of every run of 1 to longest words of some texts, and the text that each is of."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    if raw is None or bounds[0] == bounds[-1]:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    data = _LOWER[np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    starts, ends = _words(data, bounds)
    lengths = ends - starts
    own = _crcs(data, starts, lengths)
    text_of = np.searchsorted(bounds, starts, side="right") - 1
    spaced = moved_on(np.full(len(own), zlib.crc32(b" "), np.uint32), lengths) ^ own  # of the word after a space
    crcs, of, last = [own], [text_of], own
    for width in range(2, longest + 1):
        n = len(own) - width + 1
        if n <= 0:
            break
        last = moved_on(last[:n], lengths[width - 1 :] + 1) ^ spaced[width - 1 :]
        within = text_of[:n] == text_of[width - 1 :]
        crcs.append(last[within])
        of.append(text_of[:n][within])
    return np.concatenate(crcs), np.concatenate(of)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (column text) fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in parts_of(batch, PART):
                held += np.bincount(features(texts_of(part))[0] % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["bucket", "n"])
        give_back()

    sums = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():  # a row for each bucket at most
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share of the target's features to its share of the source's, smoothed by one."""
    of_source, of_target = float(source.sum()) + buckets, float(target.sum()) + buckets
    return np.array([math.floor(1000 * math.log((float(t) + 1) * of_source / ((float(s) + 1) * of_target))) for s, t in zip(source, target, strict=True)], np.int64)


def _noise(doc_id: int | None, seed: int) -> int:
    drawn = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((drawn + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score of each row."""
    names = ["doc_id", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for batch in batches:
            for part in parts_of(batch, PART):
                crcs, of = features(texts_of(part))
                counts = np.bincount(of, minlength=part.num_rows)
                order = np.argsort(of, kind="stable")
                sums = np.concatenate(([0], np.cumsum(gain[(crcs % np.uint32(len(gain)))[order]])))
                ends = np.cumsum(counts)
                weights = sums[ends] - sums[ends - counts]
                noise = np.array([_noise(d, seed) for d in part.column("doc_id").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(a, pa.int64()) for a in (counts, weights, weights + noise))], names)
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


#: Rows come in the order of these columns: the highest score first, then the least doc_id (none last), then by features.
_ORDER = ("falls", "place", "n_features")


def _within(low: tuple | None, high: tuple | None) -> Column:
    """Rows after the key low and before the key high; the first column alone is compared too, for the scan to skip by."""
    at = F.struct(*_ORDER)
    key = lambda k: F.struct(*(F.lit(x).cast("long").alias(n) for x, n in zip(k, _ORDER, strict=True)))
    return ((F.col("falls") >= low[0]) & (at > key(low)) if low else F.lit(True)) & ((F.col("falls") <= high[0]) & (at < key(high)) if high else F.lit(True))


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS) -> tuple:
    """The key of the k-th row (from 1) in the order of _ORDER; rows has at least k rows.

    Pivots are drawn by a hash of key and round, so that a task that is run again gives the same. A round leaves about
    1/pivots of the open rows; keys that many rows share are found in one round, as rows at a pivot are counted as well.
    """
    low = high = None
    round_no = 0
    while True:
        open_rows = rows.where(_within(low, high))
        drawn = open_rows.select(*_ORDER).orderBy(F.xxhash64(F.lit(round_no), *_ORDER)).limit(pivots).collect()
        keys = sorted({tuple(r) for r in drawn})
        sums = []
        for i, key in enumerate(keys):
            sums += [F.count_if(_within(None, key)).alias(f"before{i}"), F.count_if((F.col("falls") == key[0]) & (F.col("place") == key[1]) & (F.col("n_features") == key[2])).alias(f"at{i}")]
        counts = open_rows.agg(*sums).first()
        passed = 0
        for i, key in enumerate(keys):
            before, upto = counts[f"before{i}"], counts[f"before{i}"] + counts[f"at{i}"]
            if before < k <= upto:
                return key
            if upto < k:
                low, passed = key, upto
            else:
                high = key
                break
        k -= passed
        round_no += 1


def draw(scored: DataFrame, k: int) -> DataFrame:
    """scored (doc_id, n_features, weight, score, drawable) with rank: 1 to k for the highest drawable scores, else null."""
    keyed = scored.withColumns({"falls": -F.col("score"), "place": F.coalesce("doc_id", F.lit(2**63 - 1))})
    keyed = settle(keyed, "scores")
    names = ("doc_id", "n_features", "weight", "score")
    if k < 1:
        return keyed.select(*names, F.lit(None).cast("long").alias("rank"))
    last = kth_key(keyed.where("drawable"), k)
    beyond = F.struct(*_ORDER) > F.struct(*(F.lit(x).cast("long").alias(n) for x, n in zip(last, _ORDER, strict=True)))
    ahead = F.col("drawable") & ~beyond
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    winners = keyed.where(ahead).repartitionByRange(parts, *_ORDER).withColumn("part", F.spark_partition_id())
    winners = settle(winners, "winners")
    sizes = winners.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of a shuffle
    starts = small_enough(sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*_ORDER)) + F.col("start")
    ranked = winners.join(starts, "part").select(*names, place.cast("long").alias("rank"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))  # rows at the last key beyond the k-th
    return ranked.union(keyed.where(~ahead).select(*names, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs: rank is 1, 2, 3, ... for those drawn, else null.

    floor(percent * N / 100) of the N rows with at least least_words words are drawn, those with the highest score, ties to
    the smaller doc_id. Null and empty texts have no features and a weight of 0. Rows without doc_id take part with the
    noise of an empty one and come last among equal scores. Rows that repeat a doc_id are drawn each by itself; if they are
    equal in all and only some are drawn, any are. An empty table gives no rows, an empty target one without features; other
    columns are ignored.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    least = sum(least_words - width + 1 for width in range(1, LONGEST + 1) if width <= least_words)
    scored = weigh(docs, gain, seed).withColumn("drawable", F.col("n_features") >= least)
    scored = settle(scored, "weights")
    return draw(scored, percent * scored.where("drawable").count() // 100)

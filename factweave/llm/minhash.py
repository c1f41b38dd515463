"""Near-duplicates by circulant MinHash: two permutations give all coordinates, bands find candidates, full sets confirm.

A shingle is a 32-bit place after the first permutation. Coordinate k of a signature is the least value of the second
permutation over the places moved back by k, so one pair of permutations serves for all coordinates. ROWS coordinates
make a band, and texts that share a band form a bucket.

Equal sets are put together first and are one node from there on. In a bucket every member is tied to the member with the
least doc_id (its hub), never to all others. All members that a hub meets in any bucket are then compared on their full
sets, split into blocks of bounded size so that no group has to fit into one task; within a pair of blocks, only texts that
are not yet connected are compared, and only links that connect are passed on. Every pair that shares a bucket is thus
either compared or already connected. With 28 bands of 4, a pair at 0.8 has no common bucket once in 2.5 million times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import per_part, settle, small_enough

BANDS, ROWS = 28, 4
#: Shingles in a block of texts that are compared with each other or with another block, about.
BLOCK_SHINGLES = 1 << 18

#: What tells a text apart: a doc_id may have several, with sets of their own.
NODE = ["doc_id", "set_a", "set_b"]

_STEP = np.uint64(0x9E3779B97F4A7C15)
_STIR = np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(texts: pa.Array) -> list[np.ndarray]:
    """64-bit hashes of each text's words; a distinct word of the given texts is hashed once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # both know ASCII only: A-Z, and white space from TAB to CR and space
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    at = coded.indices.to_numpy()
    held, hashes = np.array([len(w) > 0 for w in words], bool)[at], hashes[at]
    return [hashes[a:b] if held[a:b].all() else hashes[a:b][held[a:b]] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingles of width words, as sorted 64-bit hashes; fewer words than that are one shingle."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    out = hashes[:n] + np.uint64(width)
    for j in range(1, width):
        out = out * _STEP + hashes[j : j + n]
    out ^= out >> np.uint64(31)
    out *= _STIR
    return np.unique(out)


def _permute(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(13)
    return x


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """size coordinates of circulant MinHash of a set that isn't empty."""
    places = (hashes >> np.uint64(32)).astype(np.uint32)
    places ^= places >> np.uint32(16)
    places = _permute(places * np.uint32(0x27D4EB2F))
    out = np.empty(size, np.uint32)
    step = max(1, 32768 // len(places))
    for k in range(0, size, step):
        shifts = np.arange(k, min(size, k + step), dtype=np.uint32)
        out[k : k + step] = _permute(places[None, :] - shifts[:, None]).min(axis=1)
    return out


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (128 bits of the set, null if it is empty), bands (a key for each band)."""

    def setup() -> Callable[[pa.Array], list[pa.Array]]:
        salt = np.arange(BANDS, dtype=np.uint64) * _STIR

        def keys_of(found: np.ndarray) -> np.ndarray:
            rows = signature(found, BANDS * ROWS).astype(np.uint64).reshape(BANDS, ROWS)
            keys = salt
            for j in range(ROWS):
                keys = (keys + rows[:, j]) * _STEP
                keys ^= keys >> np.uint64(29)
            return keys.view(np.int64)

        def of(texts: pa.Array) -> list[pa.Array]:
            sets = [shingles(hashes, width) for hashes in word_hashes(texts)]
            sizes = [len(s) for s in sets]
            keys = pa.array([keys_of(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            return [pa.array(sizes, pa.int64()), *_digests(sets), keys]

        return of

    return per_part(docs, setup, n_shingles="long", set_a="long", set_b="long", bands="array<long>")


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """The two halves of 128 bits of each set, null for the empty set."""
    made = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8").tolist() if len(s) else (None, None) for s in sets]
    return [pa.array([m[k] for m in made], pa.int64()) for k in (0, 1)]


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def setup() -> Callable[[pa.Array], list[pa.Array]]:
        def of(texts: pa.Array) -> list[pa.Array]:
            sets = [shingles(hashes, width) for hashes in word_hashes(texts)]
            return [pa.array([s.tobytes() for s in sets], pa.binary()), *_digests(sets)]

        return of

    return per_part(docs, setup, shingles="binary", set_a="long", set_b="long").dropDuplicates(NODE)


def _confirm(frame: pd.DataFrame, percent: int) -> Iterator[tuple[int, int]]:
    """Links that connect the texts of a block, or those of one block with those of another.

    Columns: doc_id, own (the text's block), block and other (the two blocks, equal for one), is_hub, shingles.
    """
    frame = frame.sort_values(["is_hub", "doc_id", "set_a"], ascending=[False, True, True])
    nodes, own = frame["doc_id"].to_numpy(), frame["own"].to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in frame["shingles"]]
    sizes = np.array([len(s) for s in sets])
    across = frame["block"].iloc[0] != frame["other"].iloc[0]
    within = np.flatnonzero(own == frame["other"].iloc[0])  # those that are looked up
    asking = np.flatnonzero(own == frame["block"].iloc[0]) if across else within
    if not len(within):
        return
    every = np.concatenate([sets[i] for i in within])
    owner = np.repeat(within, sizes[within])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    starts = np.concatenate(([0], np.flatnonzero(np.diff(every)) + 1, [len(every)]))
    tokens = every[starts[:-1]]
    group = np.arange(len(sets))
    asked = np.zeros(len(sets), bool)
    asked[within] = True
    for x in asking:
        others = np.flatnonzero(asked & (group != group[x]) & (100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x])))
        if not len(others):
            continue
        at = np.minimum(np.searchsorted(tokens, sets[x]), len(tokens) - 1)
        at = at[tokens[at] == sets[x]]
        lengths = starts[at + 1] - starts[at]
        inside = np.repeat(starts[at] - np.concatenate(([0], np.cumsum(lengths)))[: len(at)], lengths) + np.arange(lengths.sum())
        common = np.bincount(owner[inside], minlength=len(sets))[others]
        for y in others[100 * common >= percent * (sizes[x] + sizes[others] - common)]:
            if group[y] != group[x]:
                group[group == group[y]] = group[x]
                yield int(nodes[x]), int(nodes[y])


def links(docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) of doc_ids that connect what is to be connected; nodes: NODE, n_shingles, bands of distinct sets.

    A hub's number is a hash: if two hubs share one, their texts are compared together, which does no harm.
    """
    keys = nodes.select(*NODE, "n_shingles", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min(F.struct(*NODE)).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub")
    tied = keys.join(hubs, "key").groupBy(F.xxhash64("hub").alias("hub"), *NODE).agg(F.first("n_shingles").alias("n_shingles"), F.bool_or(F.struct(*NODE) == F.col("hub")).alias("is_hub"))
    ties = settle(tied, "ties")
    wanted = settle(ties.select(*NODE).distinct(), "wanted")
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small_enough(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    sets = settle(_sets(first, width), "sets")
    blocks = ties.groupBy("hub").agg(F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES)).cast("int").alias("blocks")).where("blocks > 1")
    large = small_enough(settle(blocks, "blocks"))  # a row for each hub with more than one block, few beside the ties
    members = ties.join(large, "hub", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = members.withColumn("own", F.pmod(F.xxhash64(*NODE), F.col("blocks")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = members.select("hub", *NODE, "is_hub", "own", each.alias("each")).select(
        "hub", *NODE, "is_hub", "own", F.least("own", "each").alias("block"), F.greatest("own", "each").alias("other"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_confirm(frame, percent)), columns=["a", "b"], dtype="int64")

    full = pairs.join(sets, NODE).select("hub", "block", "other", "own", "doc_id", "set_a", "is_hub", "shingles")
    return full.groupBy("hub", "block", "other").applyInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that can be reached) of each node of edges (a, b).

    Each round every node takes the least label among its neighbours and itself, and then the label of that label;
    rounds end when no label changes, which takes about the logarithm of the longest path. Labels are written each round.
    """
    both = settle(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        offers = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("offer"))
        nearer = labels.join(offers, "node").select("node", F.least("component", "offer").alias("component"), F.col("component").alias("old"))
        beyond = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels_now = settle(nearer.join(beyond, "component").select("node", F.least("component", "next").alias("component"), "old"), "labels")
        changed = labels_now.where("component <> old").limit(1).count()
        labels = labels_now.select("node", "component")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text).

    Sets are of the distinct shingles of width words; two texts are linked when 100 * common >= percent * all of their
    shingles. component_id is the least doc_id that links reach, kept says that it is the row's own. Texts without words
    are linked with nothing. Rows without doc_id are left alone: component_id null, kept. Rows that repeat a doc_id belong
    together; if their texts differ, the links of each count.
    An empty table gives no rows; columns other than doc_id and text are ignored.
    """
    rows = settle(sketch(docs, width), "sketch")
    known = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    sets = known.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("least"))
    nodes = known.join(sets, ["set_a", "set_b"]).where(F.col("doc_id") == F.col("least")).dropDuplicates(["set_a", "set_b"])
    nodes = settle(nodes.select(*NODE, "n_shingles", "bands"), "nodes")
    the_set = F.struct(F.coalesce("set_a", F.lit(0)), F.coalesce("set_b", F.lit(0)))
    several = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.min(the_set) != F.max(the_set)).alias("differ")).where("differ").select("doc_id")
    several = small_enough(settle(several, "several"))  # doc_ids with texts that differ: all of their rows get one component
    own = known.join(several, "doc_id", "left_semi").join(sets, ["set_a", "set_b"]).where(F.col("doc_id") != F.col("least"))
    own = own.select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct()
    found = components(settle(links(docs, nodes, width, percent).where("a <> b").union(own), "links"))
    by_set = nodes.join(found, nodes["doc_id"] == found["node"], "left").select("set_a", "set_b", F.coalesce("component", "doc_id").alias("component"))
    component: Column = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    whole = rows.select("doc_id", "n_shingles", "set_a", "set_b").join(by_set, ["set_a", "set_b"], "left").withColumn("component", component)
    joint = whole.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component").alias("joint"))
    whole = whole.join(small_enough(settle(joint, "joint")), "doc_id", "left").withColumn("component", F.coalesce("joint", "component"))
    return whole.select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("component").isNull() | (F.col("component") == F.col("doc_id"))).alias("kept"))

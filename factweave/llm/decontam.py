"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A mask lays ones and zeros over consecutive words; the words under ones make a seed, those under zeros may differ. Seeds
of all benchmark items and of all documents are joined on their hash. Each hit fixes an alignment of a document with an
item; the words around it are then compared place by place, and substitutions are tolerated up to a share of a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import settle, small_enough

#: Six words of nine or ten each; all three are of different shape, so one substitution seldom breaks all.
MASKS = ("110110011", "1101001011", "1011010101")
#: Besides, for items of fewer than SHORT words: four words each, so that a seed survives two substitutions wherever they stand.
SHORT, SHORT_MASKS = 13, ("1111", "110011", "1010101")
#: Items of fewer words than this have runs of words instead: all that is left whole when as many words differ as may.
RUNS_BELOW = 10
#: Aligned words that are judged together, and the percentage of them that must agree.
WINDOW, PERCENT = 20, 80


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _mask_seeds(hashes: Column, number: int, mask: str) -> Column:
    at = [k for k, bit in enumerate(mask) if bit == "1"]

    def seed(i: Column) -> Column:
        return F.xxhash64(F.lit(number), *[F.get(hashes, i + k) for k in at])

    places = F.sequence(F.lit(0), F.size(hashes) - len(mask))
    return F.when(F.size(hashes) >= len(mask), F.transform(places, seed)).otherwise(F.array().cast("array<bigint>"))


def seeds_of(hashes: Column, masks: tuple[str, ...] = MASKS) -> Column:
    """For each mask an array of the seed hashes by place."""
    return F.array(*(_mask_seeds(hashes, len(masks[0]) * 100 + number, mask) for number, mask in enumerate(masks)))


def seed_rows(rows: DataFrame, *keep: str, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """keep, at, seed: one row for each seed of the rows' column hashes."""
    per_mask = rows.select(*keep, F.explode(seeds_of(F.col("hashes"), masks)).alias("seeds"))
    return per_mask.select(*keep, F.posexplode("seeds").alias("at", "seed"))


def run_of(words: Column) -> Column:
    """How many words in a row an item of fewer than RUNS_BELOW words keeps when as many differ as may: half of them if one may, else all."""
    return F.when(words * (100 - PERCENT) >= 100, F.floor(words / 2)).otherwise(words).cast("int")


def _best_window(item: Column, doc: Column, shift: Column) -> Column:
    """The largest number of agreeing words in a window of the item at this alignment (the whole item if it is shorter)."""
    same = F.transform(item, lambda w, i: F.coalesce(F.get(doc, i + shift) == w, F.lit(False)).cast("int"))
    width = F.least(F.size(item), F.lit(WINDOW))
    starts = F.sequence(F.lit(1), F.size(item) - width + 1)
    return F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice(same, s, width), F.lit(0), lambda a, b: a + b)))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, agreeing (percent of the best window's words): the pairs where a document holds words of an item.

    A pair counts when at some alignment found by a seed at least PERCENT of WINDOW consecutive words of the item (all of
    them, if it has fewer) stand in the document at the same distances. Short items count like others: of 5 to 9 words one may
    differ, of fewer none, and an item of one word is in every document with that word. Items and texts without words match
    nothing. Rows of docs or benchmark that repeat give one pair. A null
    doc_id or item_id stays null and pairs like any other. Empty tables give no pairs; other columns are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("hashes")).where(F.size("hashes") > 0)
    item_rows = settle(items.select("item_id", "hashes").distinct().withColumn("item", F.xxhash64("item_id", "hashes")), "items")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = plain.select("doc_id", F.xxhash64("text").alias("doc"), word_hashes(F.col("text")).alias("hashes"))

    def hits_of(some: DataFrame, masks: tuple[str, ...]) -> DataFrame:
        wanted = settle(seed_rows(some, "item", masks=masks).select("item", F.col("at").alias("item_at"), "seed"), "seeds")
        found = seed_rows(hashed, "doc_id", "doc", masks=masks)
        return found.join(small_enough(wanted), "seed").select("doc_id", "doc", "item", (F.col("at") - F.col("item_at")).alias("shift"))

    hits = hits_of(item_rows, MASKS)
    short = item_rows.where(F.size("hashes").between(RUNS_BELOW, SHORT - 1))
    if not short.isEmpty():  # the documents' short seeds are only made where there is something for them to meet
        hits = hits.union(hits_of(short, SHORT_MASKS))
    brief = item_rows.where(F.size("hashes") < RUNS_BELOW).withColumn("run", run_of(F.size("hashes")))
    for row in brief.select("run").distinct().collect():  # four lengths at most
        hits = hits.union(hits_of(brief.where(F.col("run") == row["run"]), ("1" * row["run"],)))
    hits = settle(hits.distinct(), "hits")
    few = small_enough(hits.select(F.col("doc_id").alias("hit_id"), F.col("doc").alias("hit")).distinct())
    same = plain["doc_id"].eqNullSafe(few["hit_id"]) & (F.xxhash64(plain["text"]) == few["hit"])
    texts = plain.join(few, same, "left_semi").select("doc_id", F.xxhash64("text").alias("doc"), word_hashes(F.col("text")).alias("words")).dropDuplicates(["doc_id", "doc"])
    shifts = hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("doc").alias("hit"), "item").agg(F.collect_set("shift").alias("shifts"))
    pairs = shifts.join(texts, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("doc") == F.col("hit"))).join(small_enough(item_rows), "item")
    best = F.array_max(F.transform("shifts", lambda s: _best_window(F.col("hashes"), F.col("words"), s)))
    width = F.least(F.size("hashes"), F.lit(WINDOW))
    judged = pairs.select("doc_id", "item_id", best.alias("best"), width.alias("width")).where(100 * F.col("best") >= PERCENT * F.col("width"))
    return judged.groupBy("doc_id", "item_id").agg(F.max(F.floor(100 * F.col("best") / F.col("width"))).alias("agreeing"))

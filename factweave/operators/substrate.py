"""The substrate's own tables: metadata, consistency, retraction, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def upsert(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """rows with those of new in place of rows with equal keys (nulls are equal)."""
    fresh = new.select(*[C(k).alias(f"new_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & C(k).eqNullSafe(C(f"new_{k}"))
    return rows.join(fresh, same, "left_anti").unionByName(new, allowMissingColumns=True)


SLOTS = ["subject_slot", "object_slot"]
TYPES = ["subject_type", "object_type"]


def mapping_classes(mappings: DataFrame) -> DataFrame:
    """The live mappings of a property with equal slot maps and types as one row: its least id and how many they are."""
    rows = mappings.where("NOT retracted AND subject_slot IS NOT NULL AND object_slot IS NOT NULL")
    return rows.groupBy("property", *SLOTS, *TYPES).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))


def _meet(x: str, y: str) -> Column:
    return F.coalesce(C(x) == C(y), F.lit(False))


def is_inverse(a: str = "a", b: str = "b") -> Column:
    """Whether the slot maps of two aliases are each other's, subject and object swapped."""
    return (C(f"{a}.subject_slot") == C(f"{b}.object_slot")) & (C(f"{a}.object_slot") == C(f"{b}.subject_slot"))


def is_coherent(a: str = "a", b: str = "b") -> Column:
    """An inverse pair is incoherent where types meet across roles but not within a role."""
    crossed = _meet(f"{a}.subject_type", f"{b}.object_type") | _meet(f"{a}.object_type", f"{b}.subject_type")
    straight = _meet(f"{a}.subject_type", f"{b}.subject_type") | _meet(f"{a}.object_type", f"{b}.object_type")
    return ~(crossed & ~straight)


def class_pairs(mappings: DataFrame) -> DataFrame:
    """Pairs of classes of one property with different slot maps: property, a, b (least ids, a before b), pairs (of members), inverse, coherent.

    There are few classes of a property, however many mappings it has, so members are never paired with each other.
    """
    rows = mapping_classes(mappings)
    a, b = rows.alias("a"), rows.alias("b")
    differ = (C("a.subject_slot") != C("b.subject_slot")) | (C("a.object_slot") != C("b.object_slot"))
    pairs = a.join(b, (C("a.property") == C("b.property")) & (C("a.id") < C("b.id")) & differ)
    return pairs.select(C("a.property").alias("property"), C("a.id").alias("a"), C("b.id").alias("b"), (C("a.n") * C("b.n")).alias("pairs"), is_inverse().alias("inverse"), is_coherent().alias("coherent"))


def translation_conflicts(mappings: DataFrame) -> DataFrame:
    """class_pairs() that contradict each other; a swapped pair whose role types agree is exempt."""
    return class_pairs(mappings).where(~(C("inverse") & C("coherent"))).select("property", "a", "b", "pairs")


def conflicting(mappings: DataFrame) -> DataFrame:
    """The ids of the mappings whose class is in a conflict."""
    found = translation_conflicts(mappings)
    classes = found.select(C("a").alias("class")).union(found.select("b")).distinct()
    rows = mappings.where("NOT retracted AND subject_slot IS NOT NULL AND object_slot IS NOT NULL")
    same = [rows[c].eqNullSafe(C(f"_{c}")) for c in ("property", *SLOTS, *TYPES)]
    members = mapping_classes(mappings).join(classes, C("id") == C("class"), "left_semi").select(*[C(c).alias(f"_{c}") for c in ("property", *SLOTS, *TYPES)])
    return rows.join(members, same, "left_semi").select("id")


def verdict_conflicts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with several verdicts."""
    return rows.where("NOT retracted").groupBy(*keys).agg(F.count_distinct("verdict").alias("verdicts")).where("verdicts > 1")


def borrowed(mappings: DataFrame) -> DataFrame:
    """mappings with the first slots (by id) of their property where they have none; a property's slots are aggregated, not its rows sorted."""
    lent = mappings.groupBy("property").agg(*[F.min_by(slot, F.when(C(slot).isNotNull(), C("id"))).alias(f"_{slot}") for slot in SLOTS])
    return mappings.join(lent, "property", "left").select(*[F.coalesce(c, f"_{c}").alias(c) if c in SLOTS else C(c) for c in mappings.columns])


def breaker(conflicts: DataFrame, signature: str, limit: int = 3) -> DataFrame:
    """Signatures with so many conflicts that they are given up; the first conflict never is enough."""
    return conflicts.groupBy(signature).agg(F.sum("pairs").alias("cycles")).select(signature, "cycles", (C("cycles") >= max(2, limit)).alias("unresolvable"))


def retract(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """rows with retracted set for the keys in gone, but for pinned ones."""
    hit = gone.select(C(key)).distinct().withColumn("hit", F.lit(True))
    return rows.join(hit, key, "left").withColumn("retracted", C("retracted") | (F.coalesce("hit", F.lit(False)) & ~C("pinned"))).drop("hit")


def evict(rows: DataFrame, used: str, cap: int, protected: Column) -> DataFrame:
    """The protected rows, and the cap most lately used others (ties to the larger id): a top-k, so no window over all rows."""
    return rows.where(protected).unionByName(rows.where(~protected).orderBy(C(used).desc(), C("id").desc()).limit(cap))


def direction(examples: DataFrame) -> DataFrame:
    """property, direction: by how many examples hold forward and backward."""
    counted = examples.groupBy("property").agg(F.count_if("forward").alias("f"), F.count_if("backward").alias("b"), F.count(F.lit(1)).alias("n"))
    verdict = F.when((C("f") == C("n")) & (C("b") == C("n")), "symmetric").when((C("f") > 0) & (C("b") == 0), "confirmed").when((C("b") > 0) & (C("f") == 0), "corrected").when(C("f") + C("b") == 0, "unconfirmed").otherwise("suspect")
    return counted.select("property", verdict.alias("direction"))


def ontology(rows: DataFrame, now: str) -> DataFrame:
    """property, its subject and value types and inverses as text, known_empty, fresh: rows (property, kind, value, fetched, expires).

    A row of kind empty says that the property was looked up and has nothing. fresh: no row has expired.
    """
    of = lambda kind: F.array_join(F.sort_array(F.collect_set(F.when(C("kind") == kind, C("value")))), ",")
    return rows.groupBy("property").agg(of("subject_type").alias("subject_types"), of("value_type").alias("value_types"), of("inverse").alias("inverses"), F.bool_and(C("kind") == "empty").alias("known_empty"), F.bool_and(C("expires") > now).alias("fresh"))


def discover_bindings(mappings: DataFrame, proposals: DataFrame) -> DataFrame:
    """predicate, place, property, source, gated: pinned mappings, then single-valued ones, other ones, and proposals (predicate, property).

    A property counts once for a predicate, from the first source that has it; all but the first two sources are gated.
    """
    live = mappings.where("NOT retracted")
    source = F.when(C("pinned"), "ontology").when(C("single_valued"), "oracle").otherwise("candidate")
    order = F.when(C("pinned"), 0).when(C("single_valued"), 1).otherwise(2)
    every = live.select("predicate", "property", F.struct(order.alias("rank"), "id", source.alias("source")).alias("it")).union(
        proposals.select("predicate", "property", F.struct(F.lit(3).alias("rank"), F.lit(0).cast("long").alias("id"), F.lit("co_occurrence").alias("source"))))
    best = every.groupBy("predicate", "property").agg(F.min("it").alias("it"))
    place = F.row_number().over(Window.partitionBy("predicate").orderBy("it.rank", "it.id", "property"))
    return best.select("predicate", (place - 1).alias("place"), "property", "it.source", (C("it.rank") > 1).alias("gated"))


def seed_bindings(seeds: DataFrame, candidates: DataFrame) -> DataFrame:
    """predicate, property, gated, rank: each seed's own property, and further candidates behind it, gated and of rank 0.4."""
    own = seeds.select("predicate", "property")
    more = candidates.select("predicate", "property").distinct().join(own, ["predicate", "property"], "left_anti").join(own.select("predicate").distinct(), "predicate", "left_semi")
    return own.select("predicate", "property", F.lit(False).alias("gated"), F.lit(1.0).alias("rank")).union(more.select("predicate", "property", F.lit(True), F.lit(0.4)))

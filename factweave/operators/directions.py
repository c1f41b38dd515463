"""Which way round a mapping holds its property's statements: told by examples, by what they are instances of, and by constraints.

A slot map says which slot of a claim is the entity that has the statement (standard: the subject). It came with the
mapping and may be the wrong way round, so it is held against examples of the property before it may contradict anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col
STANDARD, INVERSE = "standard", "inverse"
#: What a mapping's class is: all mappings of one are judged alike.
CLASS = ["property", "subject_type", "object_type"]


def examples(statements: DataFrame, most: int = 10) -> DataFrame:
    """property, entity, value: each property's first pairs in order. Tasks cut a property to most rows before they are dealt out."""
    order = Window.partitionBy("property").orderBy("entity", "value")
    return statements.select("property", "entity", "value").distinct().withColumn("_n", F.row_number().over(order)).where(C("_n") <= most).drop("_n")


def probed(found: DataFrame, statements: DataFrame) -> DataFrame:
    """property, grounds, symmetric of examples (property, entity, value): whether a usable statement holds one of them, and
    whether all those that are held are also held with entity and value swapped (one such pair proves nothing)."""
    usable = statements.where("rank <> 'deprecated'")
    held = lambda e, v, name: usable.select("property", C("entity").alias(e), C("value").alias(v), F.lit(True).alias(name)).distinct()
    keys = ["property", "entity", "value"]
    rows = found.join(held("entity", "value", "_there"), keys, "left").join(held("value", "entity", "_back"), keys, "left")
    return rows.groupBy("property").agg(F.count_if(C("_there")).alias("_n"), F.count_if(C("_there") & C("_back")).alias("_both")).select(
        "property", (C("_n") > 0).alias("grounds"), ((C("_n") > 0) & (C("_n") == C("_both"))).alias("symmetric"))


def decided(of_entity: Column, of_value: Column) -> Column:
    """standard, inverse or null for subject_type and object_type, against what an entity and a value with a statement are.

    The subject's type must meet one of the two only, and the object's mustn't speak against it. The object's alone can tell
    the standard way, but never the inverse one: a place with a statement on a place is no sign of that.
    """
    meets = lambda kinds, kind: F.coalesce(F.array_contains(kinds, C(kind)), F.lit(False))
    subject = F.struct(meets(of_entity, "subject_type").alias("e"), meets(of_value, "subject_type").alias("v"))
    object_ = F.struct(meets(of_entity, "object_type").alias("e"), meets(of_value, "object_type").alias("v"))
    upright = F.when(subject["e"], ~subject["v"] & ~object_["e"]).otherwise(~subject["v"] & object_["v"] & ~object_["e"])
    turned = subject["v"] & ~subject["e"] & ~object_["v"]
    return F.when(upright, STANDARD).when(turned, INVERSE)


def oriented(classes: DataFrame, found: DataFrame, kinds: DataFrame, constraints: DataFrame) -> DataFrame:
    """CLASS and way of each of classes: what all examples that decide anything agree on, else null; the constraints where none does.

    kinds: entity, kind; constraints: property, role (subject or value), kind. Examples of which a side has no kind are passed over.
    """
    of = kinds.groupBy("entity").agg(F.collect_set("kind").alias("kinds"))
    typed = found.join(of.withColumnRenamed("kinds", "_e"), "entity").join(of.select(C("entity").alias("value"), C("kinds").alias("_v")), "value")
    told = classes.join(typed, "property").withColumn("_way", decided(C("_e"), C("_v"))).groupBy(*CLASS).agg(F.min("_way").alias("_least"), F.max("_way").alias("_most"))
    role = lambda name: F.collect_set(F.when(C("role") == name, C("kind")))
    bounds = constraints.groupBy("property").agg(role("subject").alias("_rs"), role("value").alias("_rv"))
    same = [classes[c].eqNullSafe(C(f"_{c}")) for c in CLASS]
    rows = classes.join(told.withColumnsRenamed({c: f"_{c}" for c in CLASS}), same, "left").drop(*[f"_{c}" for c in CLASS]).join(bounds, "property", "left")
    ruled = F.when((F.size("_rs") > 0) & (F.size("_rv") > 0), decided(C("_rs"), C("_rv")))
    return rows.select(*CLASS, F.when(C("_least").isNull(), ruled).when(C("_least") == C("_most"), C("_least")).alias("way"))


def validated(mappings: DataFrame, statements: DataFrame, kinds: DataFrame, constraints: DataFrame, most: int = 10) -> DataFrame:
    """mappings with status and reason added, slot maps put right and single_valued kept only where the status is confirmed.

    mappings: property, subject_slot, object_slot, subject_type, object_type, single_valued and any other columns; statements:
    property, entity, value, rank. unconfirmed: no slot map, no example, or no telling which slot is which; suspect: no
    statement holds any example; symmetric: either way is right; corrected: the map was turned round; confirmed: examples agree
    with it. Only a confirmed map may contradict claims: a corrected one rests on types that came with the same mapping.
    """
    found = examples(statements, most)
    ways = oriented(mappings.select(*CLASS).distinct(), found, kinds, constraints)
    same = [mappings[c].eqNullSafe(C(f"_{c}")) for c in CLASS]
    rows = mappings.join(ways.withColumnsRenamed({c: f"_{c}" for c in CLASS}), same, "left").drop(*[f"_{c}" for c in CLASS])
    rows = rows.join(probed(found, statements), "property", "left")
    given = F.when((C("subject_slot") == "subject") & (C("object_slot") == "statement_value"), STANDARD).when((C("subject_slot") == "statement_value") & (C("object_slot") == "subject"), INVERSE)
    reason = (
        F.when(given.isNull(), "no_direction").when(C("grounds").isNull(), "no_example").when(~C("grounds"), "nothing_grounds").when(C("symmetric"), "both_ways_ground")
        .when(C("way").isNull(), "no_telling_slots").when(C("way") == given, "examples_agree").otherwise("examples_disagree")
    )
    status = F.when(C("reason") == "nothing_grounds", "suspect").when(C("reason") == "both_ways_ground", "symmetric").when(C("reason") == "examples_agree", "confirmed").when(C("reason") == "examples_disagree", "corrected").otherwise("unconfirmed")
    turn = C("status") == "corrected"
    rows = rows.withColumn("reason", reason).withColumn("status", status)
    put = {"subject_slot": F.when(turn, C("object_slot")).otherwise(C("subject_slot")), "object_slot": F.when(turn, C("subject_slot")).otherwise(C("object_slot")), "single_valued": C("single_valued") & (C("status") == "confirmed")}
    return rows.withColumns(put).select(*mappings.columns, "status", "reason")

"""Verdicts brought together: dual verdicts, statements, interventions, metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.sources.scratch import settle

C = F.col


def base_verdict(verdict: Column) -> Column:
    return F.regexp_replace(verdict, "_given_assertion$", "")


def level_verdict(verified: Column, contradicted: Column) -> Column:
    """struct(verdict, conflict): what the nodes of one level say together. A contradiction wins, and both together are a conflict."""
    return F.struct(F.when(contradicted, "contradicted").when(verified, "verified").alias("verdict"), F.coalesce(contradicted & verified, F.lit(False)).alias("conflict"))


def summarise(verdicts: DataFrame) -> DataFrame:
    """Per verification: counts by base verdict, given assertions, calls, depth, exceeded budgets and the number of sources."""
    base = base_verdict(C("verdict"))
    return verdicts.groupBy("verification_id").agg(
        F.count(F.lit(1)).alias("claims"), F.count_if(base == "verified").alias("verified"), F.count_if(base == "contradicted").alias("contradicted"), F.count_if(base == "no_grounding_found").alias("abstained"),
        F.count_if(C("verdict").endswith("_given_assertion")).alias("given_assertion"), F.sum("llm_calls").alias("llm_calls"), F.max("depth").alias("max_depth"),
        F.count_if(C("abstention_reason").contains("budget")).alias("budget_exceeded"), F.count_distinct("source").alias("sources"))


def conjunction(verdicts: DataFrame, key: str = "statement_id") -> DataFrame:
    """A statement's verdict: its only claim's; contradicted if one is; verified if all are; else nothing."""
    base = base_verdict(C("verdict"))
    told = verdicts.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.first("verdict").alias("only"), F.bool_or(base == "contradicted").alias("wrong"), F.bool_and(base == "verified").alias("right"), F.bool_or(C("verdict").endswith("_given_assertion")).alias("given"))
    together = F.when(C("wrong"), "contradicted").when(C("right"), "verified").otherwise("no_grounding_found")
    return told.select(key, F.when(C("n") == 1, C("only")).otherwise(together).alias("verdict"), C("n").alias("claims"))


def interventions(verdicts: DataFrame) -> DataFrame:
    """Per verification what to do with the draft: pass it, intervene or decline."""
    action = F.when(C("abstention_reason") == "not_checkworthy", None).when(C("verdict") == "contradicted", "correct").when(C("verdict") == "no_grounding_found", "abstain").when(C("verdict") != "verified", "condition")
    acted = verdicts.withColumn("action", action)
    told = acted.groupBy("verification_id").agg(F.count_if(C("verdict") == "verified").alias("verified"), F.count_if(C("action").isin("correct", "abstain")).alias("problems"), F.count_if(C("action") == "condition").alias("conditions"))
    plan = F.when(C("problems") + C("conditions") == 0, "pass_through").when((C("verified") == 0) & (C("problems") >= 2), "decline").otherwise("intervene")
    return told.select("verification_id", plan.alias("plan"), "problems", "conditions")


def reconcile(verdicts: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row of each key: contradicted before verified before caveated before the rest, the first of equals."""
    strength = F.when(C("verdict") == "contradicted", 3).when((C("verdict") == "verified") & ~C("temporal_scope_unconfirmed"), 2).when(C("verdict") == "verified", 1).otherwise(0)
    ranked = verdicts.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(strength.desc(), order)))
    return ranked.where("_n = 1").drop("_n")


def abstained(verdict: Column) -> Column:
    return F.when(F.coalesce(verdict, F.lit("abstain")).isin("verified", "contradicted"), verdict).otherwise("abstain")


def metrics(cases: DataFrame) -> DataFrame:
    """Accuracy counts for each failure mode and (mode null) for all; a missing or failed verdict abstains."""
    rows = cases.withColumn("v", abstained(C("verdict")))
    wrong = C("v") != C("ground_truth")
    return rows.rollup("failure_mode").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~wrong).alias("correct"), F.count_if(wrong & (C("v") == "verified")).alias("false_verified"),
        F.count_if(wrong & (C("v") == "abstain") & (C("ground_truth") == "verified")).alias("false_abstain"), F.count_if(wrong & (C("v") == "contradicted") & (C("ground_truth") == "verified")).alias("false_contradicted_true"),
        F.count_if(wrong & (C("v") == "contradicted") & (C("ground_truth") == "abstain")).alias("false_contradicted_open"))


def derived_metrics(cases: DataFrame) -> DataFrame:
    """Per failure mode: what kinds of error the run and its baseline make, and which of the two is right.

    fp_correction: contradicted though true; fp_abstention: abstained though true; fn_miss: verified though false;
    fv_on_abstain: verified though open. Those of the baseline begin with base_.
    """
    rows = cases.withColumns({"v": abstained(C("verdict")), "b": abstained(C("baseline"))})
    truth = C("ground_truth")
    kinds = {"fp_correction": ("contradicted", "verified"), "fp_abstention": ("abstain", "verified"), "fn_miss": ("verified", "contradicted"), "fv_on_abstain": ("verified", "abstain")}
    errors = [F.count_if((C(c) == said) & (truth == true)).alias(f"{prefix}{name}") for c, prefix in (("v", ""), ("b", "base_")) for name, (said, true) in kinds.items()]
    right, base = C("v") == truth, C("b") == truth
    agreement = [F.count_if(right & ~base).alias("wins"), F.count_if(~right & base).alias("hurts"), F.count_if(right & base).alias("both"), F.count_if(~right & ~base).alias("neither")]
    return rows.groupBy("failure_mode").agg(*errors, *agreement, F.count(F.lit(1)).alias("total"))


#: What a release has to reach: fixed values. The largest share of false verifications; how far accuracy has to be above the
#: baseline's; a gain that counts as large, and in how many failure modes it has to be reached.
FALSE_VERIFIED, GAIN, LARGE_GAIN, LARGE_MODES = 0.05, 0.15, 0.20, 4


def acceptance(cases: DataFrame) -> DataFrame:
    """One row: the medians over runs that the four criteria are about, and whether each is met and all are."""
    v, b, truth = abstained(C("verdict")), abstained(C("baseline")), C("ground_truth")
    share = lambda test: F.avg(test.cast("double"))
    each = cases.groupingSets([[C("run_id"), C("failure_mode")], [C("run_id")]], "run_id", "failure_mode").agg(
        F.grouping("failure_mode").alias("whole"), share((v == "verified") & (truth != "verified")).alias("fv"), share(v == truth).alias("accuracy"), share(b == truth).alias("base"))
    median = lambda c: F.expr(f"percentile({c}, 0.5)")
    over = each.groupBy("failure_mode", "whole").agg(median("fv").alias("fv"), median("accuracy").alias("accuracy"), median("base").alias("base"))
    whole = lambda c: F.max(F.when(C("whole") == 1, c))
    of_mode = C("whole") == 0
    told = over.agg(whole(C("fv")).alias("false_verified"), whole(C("accuracy") - C("base")).alias("gain"), F.count_if(of_mode & (C("accuracy") < C("base"))).alias("regressions"),
        F.count_if(of_mode & (C("accuracy") - C("base") >= LARGE_GAIN)).alias("large_gains"))
    met = {"few_false": C("false_verified") <= FALSE_VERIFIED, "gained": C("gain") >= GAIN, "no_regression": C("regressions") == 0, "large_enough": C("large_gains") >= LARGE_MODES}
    return told.withColumns(met).withColumn("accepted", C("few_false") & C("gained") & C("no_regression") & C("large_enough"))


CUTS = 200


def values_at(rows: DataFrame, key: str, value: str, places: Callable[[Column], Column]) -> DataFrame:
    """key, n, held: of each key's values in order, those at some places (an array, from 1, made of the number of values n).

    Exact, and no task sorts a whole group: approximate quantiles cut each key's values into bins, bins are counted, and only
    the bins that hold an asked place are ranked, by distinct value and its count.
    """
    plain = rows.where(C(value).isNotNull()).select(C(key).alias("key"), C(value).alias("value"))
    cuts = plain.groupBy("key").agg(F.percentile_approx("value", [i / CUTS for i in range(1, CUTS)], 10 * CUTS).alias("cuts"))
    binned = plain.join(cuts, "key").select("key", "value", F.size(F.filter("cuts", lambda c: c < C("value"))).alias("bin"))
    counted = settle(binned.groupBy("key", "bin", "value").agg(F.count(F.lit(1)).alias("n")), "bins")
    per_bin = counted.groupBy("key", "bin").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = per_bin.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "of": F.sum("n").over(Window.partitionBy("key"))})
    asked = bins.select("key", "bin", "before", "of", F.filter(places(C("of")), lambda p: (p > C("before")) & (p <= C("before") + C("n"))).alias("asked")).where(F.size("asked") > 0)
    inside = Window.partitionBy("key", "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.join(asked, ["key", "bin"]).withColumn("first", C("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    found = ranked.select("key", "of", "value", F.explode(F.filter("asked", lambda p: (p > C("first")) & (p <= C("first") + C("n")))).alias("place"))
    return found.select(C("key").alias(key), C("of").alias("n"), "place", "value")


def p95_place(n: Column) -> Column:
    """The 95th percentile by index: int(0.95 n), at least the first."""
    return F.greatest(F.floor(n * 0.95), F.lit(1)).cast("long")


def middle_places(n: Column) -> list[Column]:
    return [F.floor((n + 1) / 2).cast("long"), F.ceil((n + 1) / 2).cast("long")]


def latency(cases: DataFrame, key: str = "run_id") -> DataFrame:
    """Median, largest, sum, and the 95th percentile by index, of each key."""
    at = values_at(cases, key, "latency", lambda n: F.array_distinct(F.array(p95_place(n), *middle_places(n))))
    low, high = middle_places(C("n"))
    pick = lambda place: F.max(F.when(C("place") == place, C("value")))
    told = at.groupBy(key).agg(pick(low).alias("_low"), pick(high).alias("_high"), pick(p95_place(C("n"))).alias("p95"))
    total = cases.groupBy(key).agg(F.max("latency").alias("longest"), F.sum("latency").alias("total"))
    return told.join(total, key).select(key, ((C("_low") + C("_high")) / 2).alias("median"), "p95", "longest", "total")

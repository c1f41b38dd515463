"""Queries of results: roll-ups, metrics, provenance, retraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.operators import rollup
from factweave.plans.views import oracle, view

C = F.col
QUERIES, SQL = {}, {}
_B = "regexp_replace(verdict, '_given_assertion$', '')"
QUERIES["L1_verdict_rollup"] = lambda s, d: rollup.summarise(view(s, d, "verdicts"))
SQL["L1_verdict_rollup"] = oracle(f"""SELECT verification_id, count(*) AS claims, count(*) FILTER (WHERE {_B} = 'verified') AS verified, count(*) FILTER (WHERE {_B} = 'contradicted') AS contradicted, count(*) FILTER (WHERE {_B} = 'no_grounding_found') AS abstained,
  count(*) FILTER (WHERE verdict LIKE '%_given_assertion') AS given_assertion, CAST(sum(llm_calls) AS BIGINT) AS llm_calls, max(depth) AS max_depth, count(*) FILTER (WHERE abstention_reason LIKE '%budget%') AS budget_exceeded, count(DISTINCT source) AS sources FROM verdicts GROUP BY verification_id""", "verdicts")  # fmt: skip
QUERIES["L1_source_counts"] = lambda s, d: view(s, d, "verdicts").where("source IS NOT NULL").groupBy("verification_id", "source").agg(F.count(F.lit(1)).alias("claims"))
SQL["L1_source_counts"] = oracle("SELECT verification_id, source, count(*) AS claims FROM verdicts WHERE source IS NOT NULL GROUP BY ALL", "verdicts")
QUERIES["L2_base_verdict"] = lambda s, d: view(s, d, "verdicts").select("claim_id", rollup.base_verdict(C("verdict")).alias("base"))
SQL["L2_base_verdict"] = oracle(f"SELECT claim_id, {_B} AS base FROM verdicts", "verdicts")
QUERIES["L3_statement_conjunction"] = lambda s, d: rollup.conjunction(view(s, d, "verdicts"))
SQL["L3_statement_conjunction"] = oracle(f"""SELECT statement_id, CASE WHEN count(*) = 1 THEN min(verdict) WHEN bool_or({_B} = 'contradicted') THEN 'contradicted' WHEN bool_and({_B} = 'verified') THEN 'verified' ELSE 'no_grounding_found' END AS verdict, count(*) AS claims
  FROM verdicts GROUP BY statement_id""", "verdicts")  # fmt: skip
QUERIES["L4_intervention_plan"] = lambda s, d: rollup.interventions(view(s, d, "verdicts").withColumn("verification_id", C("statement_id")))
SQL["L4_intervention_plan"] = oracle("""WITH a AS (SELECT statement_id AS verification_id, verdict, CASE WHEN abstention_reason = 'not_checkworthy' THEN NULL WHEN verdict = 'contradicted' THEN 'correct' WHEN verdict = 'no_grounding_found' THEN 'abstain' WHEN verdict <> 'verified' THEN 'condition' END AS action FROM verdicts),
  t AS (SELECT verification_id, count(*) FILTER (WHERE verdict = 'verified') AS v, count(*) FILTER (WHERE action IN ('correct', 'abstain')) AS problems, count(*) FILTER (WHERE action = 'condition') AS conditions FROM a GROUP BY 1)
  SELECT verification_id, CASE WHEN problems + conditions = 0 THEN 'pass_through' WHEN v = 0 AND problems >= 2 THEN 'decline' ELSE 'intervene' END AS plan, problems, conditions FROM t""", "verdicts")  # fmt: skip
QUERIES["B17_reconcile_claims"] = lambda s, d: rollup.reconcile(view(s, d, "verdicts"), ["lang", "statement_id"], "claim_id").select("lang", "statement_id", "claim_id", "verdict")
SQL["B17_reconcile_claims"] = oracle("""SELECT lang, statement_id, claim_id, verdict FROM verdicts QUALIFY row_number() OVER (PARTITION BY lang, statement_id ORDER BY CASE WHEN verdict = 'contradicted' THEN 3 WHEN verdict = 'verified' AND NOT temporal_scope_unconfirmed THEN 2
  WHEN verdict = 'verified' THEN 1 ELSE 0 END DESC, claim_id) = 1""", "verdicts")  # fmt: skip


def _central(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected claims of a verification (depth 0); all where none is selected or there are four at most."""
    every = Window.partitionBy("verification_id")
    rows = view(spark, sf_dir, "verdicts").select("verification_id", "claim_id", (C("depth") == 0).alias("chosen"))
    rows = rows.withColumns({"some": F.bool_or("chosen").over(every), "n": F.count(F.lit(1)).over(every)})
    return rows.where("chosen OR NOT some OR n <= 4").select("verification_id", "claim_id")


QUERIES["B16_claim_selection"] = _central
SQL["B16_claim_selection"] = oracle("SELECT verification_id, claim_id FROM verdicts v WHERE depth = 0 OR NOT EXISTS (SELECT 1 FROM verdicts w WHERE w.verification_id = v.verification_id AND depth = 0) OR (SELECT count(*) FROM verdicts w WHERE w.verification_id = v.verification_id) <= 4", "verdicts")
QUERIES["B18_groundable_claims"] = lambda s, d: view(s, d, "verdicts").where("abstention_reason IS NULL").select("claim_id", "verdict")
SQL["B18_groundable_claims"] = oracle("SELECT claim_id, verdict FROM verdicts WHERE abstention_reason IS NULL", "verdicts")
_V = "CASE WHEN coalesce(verdict, 'abstain') IN ('verified', 'contradicted') THEN verdict ELSE 'abstain' END"
_METRICS = """count(*) AS total, count(*) FILTER (WHERE v = ground_truth) AS correct, count(*) FILTER (WHERE v = 'verified' AND v <> ground_truth) AS false_verified, count(*) FILTER (WHERE v = 'abstain' AND ground_truth = 'verified') AS false_abstain,
  count(*) FILTER (WHERE v = 'contradicted' AND ground_truth = 'verified') AS false_contradicted_true, count(*) FILTER (WHERE v = 'contradicted' AND ground_truth = 'abstain') AS false_contradicted_open"""
QUERIES["L5_accuracy_metrics"] = lambda s, d: rollup.metrics(view(s, d, "cases"))
SQL["L5_accuracy_metrics"] = oracle(f"SELECT failure_mode, {_METRICS} FROM (SELECT *, {_V} AS v FROM (SELECT * FROM cases)) GROUP BY GROUPING SETS ((failure_mode), ())", "cases")


QUERIES["L7_derived_metrics"] = lambda s, d: rollup.derived_metrics(view(s, d, "cases"))
_KINDS = {"fp_correction": ("contradicted", "verified"), "fp_abstention": ("abstain", "verified"), "fn_miss": ("verified", "contradicted"), "fv_on_abstain": ("verified", "abstain")}
_ERRORS = ", ".join(f"count(*) FILTER (WHERE {c} = '{said}' AND ground_truth = '{true}') AS {prefix}{name}" for c, prefix in (("v", ""), ("baseline", "base_")) for name, (said, true) in _KINDS.items())
SQL["L7_derived_metrics"] = oracle(f"""SELECT failure_mode, {_ERRORS}, count(*) FILTER (WHERE r AND NOT b) AS wins, count(*) FILTER (WHERE NOT r AND b) AS hurts, count(*) FILTER (WHERE r AND b) AS "both", count(*) FILTER (WHERE NOT r AND NOT b) AS neither, count(*) AS total
  FROM (SELECT *, {_V} AS v, {_V} = ground_truth AS r, baseline = ground_truth AS b FROM cases) GROUP BY failure_mode""", "cases")  # fmt: skip
QUERIES["L8_latency"] = lambda s, d: rollup.latency(view(s, d, "cases"))
SQL["L8_latency"] = oracle("""WITH r AS (SELECT run_id, latency, row_number() OVER (PARTITION BY run_id ORDER BY latency, case_id) AS n, count(*) OVER (PARTITION BY run_id) AS n_all FROM cases)
  SELECT run_id, median(latency) AS median, max(latency) FILTER (WHERE n = greatest(CAST(floor(n_all * 0.95) AS BIGINT), 1)) AS p95, max(latency) AS longest, sum(latency) AS total FROM r GROUP BY run_id""", "cases")  # fmt: skip
QUERIES["L9_across_runs"] = lambda s, d: rollup.latency(view(s, d, "cases")).agg(F.expr("percentile(total, 0.5)").alias("median_total"), F.min("total").alias("least"), F.max("total").alias("most"), F.count(F.lit(1)).alias("runs"))
SQL["L9_across_runs"] = oracle("SELECT median(t) AS median_total, min(t) AS least, max(t) AS most, count(*) AS runs FROM (SELECT run_id, sum(latency) AS t FROM cases GROUP BY run_id)", "cases")
QUERIES["L10_acceptance"] = lambda s, d: rollup.acceptance(view(s, d, "cases"))
SQL["L10_acceptance"] = oracle(f"""WITH e AS (SELECT run_id, failure_mode, grouping(failure_mode) AS whole, avg(CAST(v = 'verified' AND ground_truth <> 'verified' AS DOUBLE)) AS fv, avg(CAST(v = ground_truth AS DOUBLE)) AS a, avg(CAST(baseline = ground_truth AS DOUBLE)) AS b
    FROM (SELECT *, {_V} AS v FROM cases) GROUP BY GROUPING SETS ((run_id, failure_mode), (run_id))),
  m AS (SELECT failure_mode, whole, median(fv) AS fv, median(a) AS a, median(b) AS b FROM e GROUP BY failure_mode, whole),
  t AS (SELECT max(fv) FILTER (WHERE whole = 1) AS false_verified, max(a - b) FILTER (WHERE whole = 1) AS gain, count(*) FILTER (WHERE whole = 0 AND a < b) AS regressions, count(*) FILTER (WHERE whole = 0 AND a - b >= 0.2) AS large_gains FROM m)
  SELECT *, false_verified <= 0.05 AS few_false, gain >= 0.15 AS gained, regressions = 0 AS no_regression, large_gains >= 4 AS large_enough, false_verified <= 0.05 AND gain >= 0.15 AND regressions = 0 AND large_gains >= 4 AS accepted FROM t""", "cases")
QUERIES["L11_corpus_threshold"] = lambda s, d: view(s, d, "cases").groupBy("failure_mode").agg(F.count_if(rollup.abstained(C("verdict")) == C("ground_truth")).alias("passed"), F.count(F.lit(1)).alias("total")).select("failure_mode", "passed", "total", (C("passed") >= 0.3 * C("total")).alias("reached"))
SQL["L11_corpus_threshold"] = oracle(f"SELECT failure_mode, count(*) FILTER (WHERE {_V} = ground_truth) AS passed, count(*) AS total, count(*) FILTER (WHERE {_V} = ground_truth) >= 0.3 * count(*) AS reached FROM cases GROUP BY failure_mode", "cases")
QUERIES["C21_case_results"] = lambda s, d: view(s, d, "cases").select("case_id", rollup.abstained(C("verdict")).alias("verdict"))
SQL["C21_case_results"] = oracle(f"SELECT case_id, {_V} AS verdict FROM cases", "cases")

# ---- provenance and retraction ----


QUERIES["J13_replay"] = lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.max_by(F.from_json("props", "k INT")["k"], "event_id").alias("k"), F.max("event_id").alias("event_id"))
SQL["J13_replay"] = "SELECT user_id, CAST(json_extract(arg_max(props, event_id), '$.k') AS INT) AS k, max(event_id) AS event_id FROM events GROUP BY user_id"


QUERIES["J16_trace_text"] = lambda s, d: view(s, d, "verdicts").select("claim_id", F.concat_ws(" | ", "verdict", F.coalesce("source", F.lit("none")), F.concat(F.lit("depth "), C("depth")), "abstention_reason").alias("trace"))
SQL["J16_trace_text"] = oracle("SELECT claim_id, concat_ws(' | ', verdict, coalesce(source, 'none'), 'depth ' || depth, abstention_reason) AS trace FROM verdicts", "verdicts")


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verifications with their claims as one text each, in order."""
    return view(spark, sf_dir, "verdicts").groupBy("verification_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("claim_id", "verdict"))), lambda x: F.concat_ws("=", x["claim_id"], x["verdict"])), ";").alias("claims"))


QUERIES["A25_verification_scan"] = _nested
SQL["A25_verification_scan"] = oracle("SELECT verification_id, string_agg(claim_id || '=' || verdict, ';' ORDER BY claim_id) AS claims FROM verdicts GROUP BY verification_id", "verdicts")
_TEMPLATES = {"walk_budget_exceeded": "The check of {subject} ran out of budget.", "depth_exhausted": "No source says anything about {subject}.", "no_kb_path": "{subject} has no known relation of this kind."}
QUERIES["N_abstention_text"] = lambda s, d: view(s, d, "verdicts").where("abstention_reason IS NOT NULL").select("claim_id", F.replace(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _TEMPLATES.items() for x in kv]), C("abstention_reason")), F.lit("{subject} could not be checked.")), F.lit("{subject}"), F.concat(F.lit("claim "), C("claim_id"))).alias("line"))
SQL["N_abstention_text"] = oracle("SELECT claim_id, replace(CASE abstention_reason " + " ".join(f"WHEN '{k}' THEN '{v.replace('{subject}', '<s>')}'" for k, v in _TEMPLATES.items()) + " ELSE '<s> could not be checked.' END, '<s>', 'claim ' || claim_id) AS line FROM verdicts WHERE abstention_reason IS NOT NULL", "verdicts")
QUERIES["H9_assertion_designation"] = lambda s, d: view(s, d, "verdicts").join(view(s, d, "premises").groupBy("claim_id").agg(F.bool_or("is_assertion").alias("given")), "claim_id").select("claim_id", F.when(C("given"), F.concat(rollup.base_verdict(C("verdict")), F.lit("_given_assertion"))).otherwise(rollup.base_verdict(C("verdict"))).alias("verdict"))
SQL["H9_assertion_designation"] = oracle(f"SELECT claim_id, CASE WHEN given THEN {_B} || '_given_assertion' ELSE {_B} END AS verdict FROM verdicts JOIN (SELECT claim_id, bool_or(is_assertion) AS given FROM premises GROUP BY claim_id) USING (claim_id)", "verdicts", "premises")
def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7: what the verdicts of a level say together, by the rule that the walk goes by."""
    says = lambda v: F.bool_or(rollup.base_verdict(C("verdict")) == v)
    told = view(spark, sf_dir, "verdicts").groupBy("statement_id", "depth").agg(rollup.level_verdict(says("verified"), says("contradicted")).alias("it"))
    return told.select("statement_id", "depth", "it.*")


QUERIES["H7_level_conflict"] = _levels
SQL["H7_level_conflict"] = oracle(f"SELECT statement_id, depth, CASE WHEN c THEN 'contradicted' WHEN v THEN 'verified' END AS verdict, c AND v AS conflict FROM (SELECT statement_id, depth, bool_or({_B} = 'verified') AS v, bool_or({_B} = 'contradicted') AS c FROM verdicts GROUP BY 1, 2)", "verdicts")

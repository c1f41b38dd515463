"""Queries of the substrate, the walk, sources and sinks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.operators import graph, kb, resolve, rollup, substrate, verify
from factweave.plans import verification
from factweave.plans.grounding import IS_A, PART_OF, RESOLVED, _resolved, paths
from factweave.plans.views import NOW, VIEWS, oracle, view
from factweave.sources import files, statements
from factweave.sources.scratch import shared_dir
from factweave.streaming import stateful

C = F.col
QUERIES, SQL = {}, {}

_CLASSES = """classes AS (SELECT property, subject_slot, object_slot, subject_type, object_type, min(id) AS id, count(*) AS n FROM mappings WHERE NOT retracted AND subject_slot IS NOT NULL AND object_slot IS NOT NULL GROUP BY ALL),
  pairs AS (SELECT a.property, a.id AS a, b.id AS b, a.n * b.n AS pairs, a.subject_slot = b.object_slot AND a.object_slot = b.subject_slot AS inverse,
    NOT ((coalesce(a.subject_type = b.object_type, false) OR coalesce(a.object_type = b.subject_type, false)) AND NOT (coalesce(a.subject_type = b.subject_type, false) OR coalesce(a.object_type = b.object_type, false))) AS coherent
    FROM classes a JOIN classes b ON a.property = b.property AND a.id < b.id WHERE a.subject_slot <> b.subject_slot OR a.object_slot <> b.object_slot),
  clashes AS (SELECT property, a, b, pairs FROM pairs WHERE NOT (inverse AND coherent)),
  losers AS (SELECT m.id FROM mappings m JOIN classes c ON m.property = c.property AND m.subject_slot = c.subject_slot AND m.object_slot = c.object_slot AND m.subject_type IS NOT DISTINCT FROM c.subject_type AND m.object_type IS NOT DISTINCT FROM c.object_type
    WHERE NOT m.retracted AND c.id IN (SELECT a FROM clashes UNION SELECT b FROM clashes))"""


def _mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "mappings")


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many conflicts of each kind there are."""
    kinds = {
        "translation": substrate.translation_conflicts(_mappings(spark, sf_dir)).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("n")),
        "subsumption": substrate.verdict_conflicts(view(spark, sf_dir, "subsumptions"), ["a", "b", "relation"]).agg(F.count(F.lit(1)).alias("n")),
        "distribution": substrate.verdict_conflicts(view(spark, sf_dir, "distributions"), ["predicate", "polarity", "relation"]).agg(F.count(F.lit(1)).alias("n")),
    }
    return reduce(DataFrame.union, [n.select(F.lit(kind).alias("kind"), "n") for kind, n in kinds.items()])


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings after both sides of each conflict are retracted, but for pinned ones, and the conflicts of their property."""
    rows = _mappings(spark, sf_dir)
    cycles = substrate.breaker(substrate.translation_conflicts(rows), "property").select("property", "cycles")
    return substrate.retract(rows, substrate.conflicting(rows)).join(cycles, "property", "left").select("id", "retracted", F.coalesce("cycles", F.lit(0)).alias("cycles"))


def _stale_by_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7's propagation: claims that rest on a mapping which a conflict retracts, with how many such rows."""
    gone = substrate.retract(_mappings(spark, sf_dir), substrate.conflicting(_mappings(spark, sf_dir))).where("retracted").join(_mappings(spark, sf_dir).where("NOT retracted").select("id"), "id", "left_semi").select(C("id").alias("source_row_id"))
    return view(spark, sf_dir, "premises").where("source_table IS NOT NULL").join(gone, "source_row_id").groupBy("claim_id").agg(F.count_distinct("source_row_id").alias("rows_gone"))


QUERIES["J1_translation_conflicts"] = lambda s, d: substrate.translation_conflicts(_mappings(s, d))
SQL["J1_translation_conflicts"] = oracle(f"WITH {_CLASSES} SELECT * FROM clashes", "mappings")
QUERIES["J2_inverse_mappings"] = lambda s, d: substrate.class_pairs(_mappings(s, d)).where("inverse").select("property", "a", "b")
SQL["J2_inverse_mappings"] = oracle(f"WITH {_CLASSES} SELECT property, a, b FROM pairs WHERE inverse", "mappings")
QUERIES["J3_inverse_coherence"] = lambda s, d: substrate.class_pairs(_mappings(s, d)).where("inverse").select("property", "a", "b", "coherent")
SQL["J3_inverse_coherence"] = oracle(f"WITH {_CLASSES} SELECT property, a, b, coherent FROM pairs WHERE inverse", "mappings")
QUERIES["J5_distribution_conflicts"] = lambda s, d: substrate.verdict_conflicts(view(s, d, "distributions"), ["predicate", "polarity", "relation"])
SQL["J5_distribution_conflicts"] = oracle("SELECT predicate, polarity, relation, count(DISTINCT verdict) AS verdicts FROM distributions WHERE NOT retracted GROUP BY ALL HAVING count(DISTINCT verdict) > 1", "distributions")
QUERIES["J6_periodic_scan"] = _scan
SQL["J6_periodic_scan"] = oracle(f"""WITH {_CLASSES} SELECT 'translation' AS kind, CAST(coalesce(sum(pairs), 0) AS BIGINT) AS n FROM clashes UNION ALL SELECT 'subsumption', count(*) FROM (SELECT 1 FROM subsumptions WHERE NOT retracted GROUP BY a, b, relation HAVING count(DISTINCT verdict) > 1)
  UNION ALL SELECT 'distribution', count(*) FROM (SELECT 1 FROM distributions WHERE NOT retracted GROUP BY predicate, polarity, relation HAVING count(DISTINCT verdict) > 1)""", "mappings", "subsumptions", "distributions")  # fmt: skip
QUERIES["J7_retract_conflicting"] = _settled
SQL["J7_retract_conflicting"] = oracle(f"WITH {_CLASSES} SELECT id, retracted OR (NOT pinned AND id IN (SELECT id FROM losers)) AS retracted, CAST(coalesce((SELECT sum(pairs) FROM clashes c WHERE c.property = m.property), 0) AS BIGINT) AS cycles FROM mappings m", "mappings")
QUERIES["J7_conflict_propagation"] = _stale_by_conflict
SQL["J7_conflict_propagation"] = oracle(f"WITH {_CLASSES} SELECT claim_id, count(DISTINCT source_row_id) AS rows_gone FROM premises WHERE source_table IS NOT NULL AND source_row_id IN (SELECT id FROM losers WHERE id IN (SELECT id FROM mappings WHERE NOT pinned)) GROUP BY claim_id", "mappings", "premises")
QUERIES["J8_circuit_breaker"] = lambda s, d: substrate.breaker(substrate.translation_conflicts(_mappings(s, d)), "property")
SQL["J8_circuit_breaker"] = oracle(f"WITH {_CLASSES} SELECT property, CAST(sum(pairs) AS BIGINT) AS cycles, sum(pairs) >= 3 AS unresolvable FROM clashes GROUP BY property", "mappings")


# ---- metadata of predicates ----
def _proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each predicate the property that most often joins subject and object, over three sample claims at most; ties to the least."""
    place = F.row_number().over(Window.partitionBy("predicate").orderBy("claim_id"))
    sample = _resolved(spark, sf_dir).where("subject_id IS NOT NULL AND object_id IS NOT NULL").withColumn("_n", place).where("_n <= 3")
    held = view(spark, sf_dir, "kb_statements").select(C("entity").alias("subject_id"), C("value").alias("object_id"), "property")
    counted = sample.join(held, ["subject_id", "object_id"]).groupBy("predicate", "property").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("predicate").agg(F.min_by("property", F.struct(-C("n"), "property")).alias("property"))


_PROPOSED = """proposed AS (SELECT predicate, arg_min(property, (-n) || property) AS property FROM (SELECT predicate, property, count(*) AS n FROM (SELECT * FROM resolved WHERE subject_id IS NOT NULL AND object_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY predicate ORDER BY claim_id) <= 3) JOIN kb_statements ON entity = subject_id AND value = object_id GROUP BY 1, 2) GROUP BY predicate)"""
QUERIES["I10_co_occurrence"] = _proposals
SQL["I10_co_occurrence"] = oracle(f"WITH {RESOLVED}, {_PROPOSED} SELECT predicate, property FROM proposed", "claims", "kb_labels", "kb_statements")
QUERIES["I7_binding_discovery"] = lambda s, d: substrate.discover_bindings(_mappings(s, d), _proposals(s, d))
_SOURCES = f"""{_PROPOSED}, offered AS (SELECT predicate, property, CASE WHEN pinned THEN 0 WHEN single_valued THEN 1 ELSE 2 END AS rank, id FROM mappings WHERE NOT retracted UNION ALL SELECT predicate, property, 3, 0 FROM proposed),
  best AS (SELECT * FROM offered QUALIFY row_number() OVER (PARTITION BY predicate, property ORDER BY rank, id) = 1)"""
SQL["I7_binding_discovery"] = oracle(f"""WITH {RESOLVED}, {_SOURCES} SELECT predicate, CAST(row_number() OVER (PARTITION BY predicate ORDER BY rank, id, property) - 1 AS INT) AS place, property, CASE rank WHEN 0 THEN 'ontology' WHEN 1 THEN 'oracle' WHEN 2 THEN 'candidate' ELSE 'co_occurrence' END AS source,
  rank > 1 AS gated FROM best""", "claims", "kb_labels", "kb_statements", "mappings")  # fmt: skip


def _consulted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live mapping row of each predicate that claims use, the first by id; without one the predicate has no route."""
    first = _mappings(spark, sf_dir).where("NOT retracted").groupBy("predicate").agg(F.min_by(F.struct("id", "property"), "id").alias("it"))
    known = view(spark, sf_dir, "predicates").groupBy("predicate").agg(F.min_by("routing_hint", "id").alias("route"))
    asked = view(spark, sf_dir, "all_claims").select("predicate").union(view(spark, sf_dir, "distributions").select("predicate")).distinct()
    return asked.join(first, "predicate", "left").join(known, "predicate", "left").select("predicate", C("it.id").alias("id"), C("it.property").alias("property"), "route")


QUERIES["I6_predicate_consult"] = _consulted
SQL["I6_predicate_consult"] = oracle("""SELECT predicate, m.id, m.property, route FROM (SELECT predicate FROM all_claims UNION SELECT predicate FROM distributions) LEFT JOIN (SELECT * FROM mappings WHERE NOT retracted QUALIFY row_number() OVER (PARTITION BY predicate ORDER BY id) = 1) m USING (predicate)
  LEFT JOIN (SELECT predicate, arg_min(routing_hint, id) AS route FROM predicates GROUP BY predicate) USING (predicate)""", "all_claims", "distributions", "mappings", "predicates")  # fmt: skip


def _directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which side of a property's statements is of class place, by the statements themselves."""
    places = graph.places(paths(spark, sf_dir, "is_a"), ("place",))
    side = lambda c, name: places.select(C("node").alias(c), F.lit(True).alias(name))
    rows = view(spark, sf_dir, "kb_statements").select("property", "entity", "value").union(view(spark, sf_dir, "kb_edges").select("property", "src", "dst"))
    rows = rows.join(side("value", "_v"), "value", "left").join(side("entity", "_e"), "entity", "left")
    return substrate.direction(rows.select("property", F.coalesce("_v", F.lit(False)).alias("forward"), F.coalesce("_e", F.lit(False)).alias("backward")))


QUERIES["I9_direction_validation"] = _directions
SQL["I9_direction_validation"] = oracle(f"""WITH RECURSIVE {IS_A}, x AS (SELECT property, value IN (SELECT src FROM is_a WHERE dst = 'place') AS forward, entity IN (SELECT src FROM is_a WHERE dst = 'place') AS backward
    FROM (SELECT property, entity, value FROM kb_statements UNION ALL SELECT property, src, dst FROM kb_edges)), c AS (SELECT property, count(*) FILTER (WHERE forward) AS f, count(*) FILTER (WHERE backward) AS b, count(*) AS n FROM x GROUP BY property)
  SELECT property, CASE WHEN f = n AND b = n THEN 'symmetric' WHEN f > 0 AND b = 0 THEN 'confirmed' WHEN b > 0 AND f = 0 THEN 'corrected' WHEN f + b = 0 THEN 'unconfirmed' ELSE 'suspect' END AS direction FROM c""", "kb_edges", "kb_statements")  # fmt: skip
QUERIES["A17_property_ontology"] = lambda s, d: substrate.ontology(view(s, d, "ontology"), NOW).select("property", "subject_types", "value_types", "inverses")
QUERIES["I14_ontology_cache"] = lambda s, d: substrate.ontology(view(s, d, "ontology"), NOW).select("property", "known_empty", "fresh")
_KIND = "coalesce(string_agg(DISTINCT value, ',' ORDER BY value) FILTER (WHERE kind = '{0}'), '')"
SQL["A17_property_ontology"] = oracle(f"SELECT property, {_KIND.format('subject_type')} AS subject_types, {_KIND.format('value_type')} AS value_types, {_KIND.format('inverse')} AS inverses FROM ontology GROUP BY property", "ontology")
SQL["I14_ontology_cache"] = oracle(f"SELECT property, bool_and(kind = 'empty') AS known_empty, bool_and(expires > '{NOW}') AS fresh FROM ontology GROUP BY property", "ontology")
QUERIES["I15_nogood_eviction"] = lambda s, d: substrate.evict(view(s, d, "nogoods").where("NOT retracted"), "last_used", 500, C("reason") == "protected").select("id")
SQL["I15_nogood_eviction"] = oracle("WITH n AS (SELECT * FROM nogoods WHERE NOT retracted) SELECT id FROM n WHERE reason = 'protected' UNION ALL (SELECT id FROM n WHERE reason <> 'protected' ORDER BY last_used DESC, id DESC LIMIT 500)", "nogoods")


def _consult_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two names relate: by the graph where it knows a path, else by the first live row, else not at all."""
    names = kb.chosen(view(spark, sf_dir, "kb_labels"))
    pairs = view(spark, sf_dir, "taxonomy").where("relation = 'part_of'").groupBy("a", "b").agg(F.min_by("verdict", F.when(~C("retracted"), C("id"))).alias("told"))
    ids = pairs.join(names.select(C("label").alias("a"), C("id").alias("_a")), "a", "left").join(names.select(C("label").alias("b"), C("id").alias("_b")), "b", "left")
    known = graph.subsumption(ids.select(C("_a").alias("a"), C("_b").alias("b"), C("a").alias("name_a"), C("b").alias("name_b"), "told"), paths(spark, sf_dir, "part_of"))
    return known.select("name_a", "name_b", F.when(C("relation") != "unrelated", C("relation")).otherwise(F.coalesce("told", F.lit("unrelated"))).alias("verdict"))


QUERIES["I11_subsumption_consult"] = _consult_taxonomy
SQL["I11_subsumption_consult"] = oracle(f"""WITH RECURSIVE {PART_OF}, c AS (SELECT label, min(kb_id) AS id FROM kb_labels GROUP BY label), t AS (SELECT a, b, arg_min(verdict, id) FILTER (WHERE NOT retracted) AS told FROM taxonomy WHERE relation = 'part_of' GROUP BY a, b)
  SELECT a AS name_a, b AS name_b, CASE WHEN x.id = y.id THEN 'equivalent' WHEN EXISTS (SELECT 1 FROM part_of WHERE src = x.id AND dst = y.id) THEN 'a_subsumed_by_b' WHEN EXISTS (SELECT 1 FROM part_of WHERE src = y.id AND dst = x.id) THEN 'b_subsumed_by_a' ELSE coalesce(told, 'unrelated') END AS verdict
  FROM t LEFT JOIN c x ON x.label = a LEFT JOIN c y ON y.label = b""", "taxonomy", "kb_labels", "kb_edges")  # fmt: skip


def _claim_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the taxonomy has beside either slot of a claim, with the way it leads."""
    claims = view(spark, sf_dir, "all_claims").withColumn("node_id", C("claim_id"))
    return verify.slots(claims).join(verify.taxonomy_ways(view(spark, sf_dir, "taxonomy")), "held").select(C("node_id").alias("claim_id"), "slot", "relation", "way", "neighbour", "source_row")


_WAYS = """w AS (SELECT held, relation, way, neighbour, min(id) AS source_row FROM (SELECT a AS held, relation, CASE WHEN verdict IN ('a_subsumed_by_b', 'equivalent') THEN 'parent' WHEN verdict = 'b_subsumed_by_a' THEN 'child' END AS way, b AS neighbour, id FROM taxonomy WHERE NOT retracted
    UNION ALL SELECT b, relation, CASE WHEN verdict IN ('b_subsumed_by_a', 'equivalent') THEN 'parent' WHEN verdict = 'a_subsumed_by_b' THEN 'child' END, a, id FROM taxonomy WHERE NOT retracted) WHERE way IS NOT NULL GROUP BY ALL),
  beside AS (SELECT claim_id, slot, relation, way, neighbour, source_row, held FROM (SELECT claim_id, 'subject' AS slot, subject AS held FROM all_claims UNION ALL SELECT claim_id, 'object', object FROM all_claims) JOIN w USING (held) WHERE held <> '')"""
QUERIES["C16_subsumption_neighbours"] = _claim_neighbours
SQL["C16_subsumption_neighbours"] = oracle(f"WITH {_WAYS} SELECT * EXCLUDE (held) FROM beside", "all_claims", "taxonomy")


def _vetoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17: a claim's neighbours that no live nogood forbids."""
    s = verification.sources(spark, sf_dir)
    claims = view(spark, sf_dir, "all_claims").withColumn("node_id", C("claim_id"))
    near = verify.slots(claims).join(verify.taxonomy_ways(s.taxonomy), "held")
    return verify.vetoed(near, s, kb.chosen(s.labels)).select(C("node_id").alias("claim_id"), "slot", "relation", "way", "neighbour")


QUERIES["C17_nogood_anti_join"] = _vetoes
SQL["C17_nogood_anti_join"] = oracle(f"""WITH {_WAYS}, c AS (SELECT label, min(kb_id) AS id FROM kb_labels GROUP BY label) SELECT claim_id, slot, b.relation, way, neighbour FROM beside b LEFT JOIN c h ON h.label = held LEFT JOIN c o ON o.label = neighbour
  WHERE NOT EXISTS (SELECT 1 FROM nogoods g WHERE NOT retracted AND g.relation = b.relation AND g.source = CASE WHEN way = 'child' THEN o.id ELSE h.id END AND g.target = CASE WHEN way = 'child' THEN h.id ELSE o.id END)""", "all_claims", "taxonomy", "kb_labels", "nogoods")  # fmt: skip


def _preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: a claim's neighbours with those first that its predicate carries to, in stable order."""
    carried = verify.carried(view(spark, sf_dir, "all_claims").withColumn("node_id", C("claim_id")), verify.ways_of(view(spark, sf_dir, "distributions"))).select(C("node_id").alias("claim_id"), "relation", "way", F.lit(0).alias("_first"))
    rows = _claim_neighbours(spark, sf_dir).join(carried, ["claim_id", "relation", "way"], "left").withColumn("_first", F.coalesce("_first", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("claim_id", "slot").orderBy("_first", "source_row", "way", "neighbour"))
    return rows.select("claim_id", "slot", "way", "neighbour", place.alias("place"))


QUERIES["M4_preferred_order"] = _preferred
SQL["M4_preferred_order"] = oracle(f"""WITH {_WAYS}, d AS (SELECT predicate, polarity, relation, arg_min(verdict, id) AS v FROM distributions WHERE NOT retracted GROUP BY ALL)
  SELECT b.claim_id, slot, way, neighbour, CAST(row_number() OVER (PARTITION BY b.claim_id, slot ORDER BY CASE WHEN (way = 'child' AND v IN ('up', 'both')) OR (way = 'parent' AND v IN ('down', 'both')) THEN 0 ELSE 1 END, source_row, way, neighbour) AS INT) AS place
  FROM beside b JOIN all_claims c ON c.claim_id = b.claim_id LEFT JOIN d ON d.predicate = c.predicate AND d.polarity = c.polarity AND d.relation = b.relation""", "all_claims", "taxonomy", "distributions")  # fmt: skip


def _premise_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that a predicate's declared premises have for a claim, and whether all are there; a claim goes on only then."""
    asked = _resolved(spark, sf_dir).join(view(spark, sf_dir, "premise_slots"), "predicate").withColumn("entity", F.when(C("slot") == "subject", C("subject_id")).otherwise(C("object_id")))
    rows = asked.join(kb.premise_value(view(spark, sf_dir, "kb_statements")), ["entity", "property"], "left")
    each = F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", C("slot"), F.coalesce("value", F.lit("?"))))), ",")
    return rows.groupBy("claim_id").agg(each.alias("premises"), F.bool_and(C("value").isNotNull()).alias("goes_on"))


QUERIES["C18_python_premises"] = _premise_values
SQL["C18_python_premises"] = oracle(f"""WITH {RESOLVED}, v AS (SELECT *, CASE WHEN value_type = 'date' THEN substring(value, 1, 4) ELSE value END AS v FROM kb_statements WHERE rank <> 'deprecated'),
  e AS (SELECT entity, property, coalesce(arg_min(v, stmt_id) FILTER (WHERE rank = 'preferred'), CASE WHEN count(DISTINCT v) = 1 THEN min(v) END) AS value FROM v GROUP BY entity, property)
  SELECT claim_id, string_agg(slot || '=' || coalesce(value, '?'), ',' ORDER BY slot || '=' || coalesce(value, '?')) AS premises, bool_and(value IS NOT NULL) AS goes_on
  FROM resolved JOIN premise_slots p USING (predicate) LEFT JOIN e ON e.entity = CASE slot WHEN 'subject' THEN subject_id ELSE object_id END AND e.property = p.property GROUP BY claim_id""", "claims", "kb_labels", "kb_statements", "premise_slots")  # fmt: skip


def _against_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's results and a baseline's, case by case, against the truth."""
    rows = view(spark, sf_dir, "cases").select("case_id", "failure_mode", "ground_truth", "verdict").join(view(spark, sf_dir, "baselines").select("case_id", C("verdict").alias("other")), "case_id")
    right, base = rollup.abstained(C("verdict")) == C("ground_truth"), C("other") == C("ground_truth")
    return rows.groupBy("failure_mode").agg(F.count_if(right & base).alias("both"), F.count_if(right & ~base).alias("wins"), F.count_if(~right & base).alias("hurts"), F.count_if(~right & ~base).alias("neither"))


QUERIES["C22_run_comparison"] = _against_baseline
SQL["C22_run_comparison"] = oracle("""SELECT failure_mode, count(*) FILTER (WHERE r AND b) AS "both", count(*) FILTER (WHERE r AND NOT b) AS wins, count(*) FILTER (WHERE NOT r AND b) AS hurts, count(*) FILTER (WHERE NOT r AND NOT b) AS neither
  FROM (SELECT failure_mode, CASE WHEN coalesce(c.verdict, 'abstain') IN ('verified', 'contradicted') THEN c.verdict ELSE 'abstain' END = ground_truth AS r, o.verdict = ground_truth AS b FROM cases c JOIN baselines o USING (case_id)) GROUP BY failure_mode""", "cases", "baselines")  # fmt: skip


# ---- names to entities ----
def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    return tuple(view(spark, sf_dir, n) for n in ("surfaces", "redirects", "kb_labels", "aliases", "kb_edges"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, redirects, labels, _, _ = _asked(spark, sf_dir)
    return resolve.titles(asked, redirects, labels)


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, _, labels, aliases, _ = _asked(spark, sf_dir)
    return resolve.search(asked.select(C("reference").alias("query")), labels, aliases)


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked, _, labels, aliases, edges = _asked(spark, sf_dir)
    pairs = asked.select(C("reference").alias("query"), "expected_type").distinct()
    return resolve.search(pairs, labels, aliases).join(pairs, "query"), edges


def _composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.compose(*_asked(spark, sf_dir))


def _resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, _, labels, aliases, _ = _asked(spark, sf_dir)
    return resolve.resolve_cached(asked, _composed(spark, sf_dir), view(spark, sf_dir, "resolutions"), labels, aliases)


_NAMES = """asked AS (SELECT DISTINCT reference, expected_type FROM surfaces), bare AS (SELECT DISTINCT reference, coalesce(nullif(regexp_replace(reference, '(?i)^(the|a|an)\\s+', ''), ''), reference) AS plain FROM surfaces),
  pages AS (SELECT label AS title, min(kb_id) AS page_id, count(*) AS n FROM kb_labels GROUP BY label), led AS (SELECT reference, coalesce(target, plain) AS title FROM bare LEFT JOIN redirects r ON lower(r.title) = lower(trim(plain))),
  titled AS (SELECT reference, title, page_id, CASE WHEN page_id IS NULL THEN 'not_found' WHEN n > 1 THEN 'disambiguation_page' WHEN lower(title) <> lower(reference) THEN 'clean_redirect' ELSE 'canonical' END AS outcome FROM led LEFT JOIN pages USING (title)),
  names AS (SELECT q, kb_id, min(kind) AS kind FROM (SELECT lower(trim(label)) AS q, kb_id, 0 AS kind FROM kb_labels UNION ALL SELECT lower(trim(alias)), kb_id, 1 FROM aliases) GROUP BY q, kb_id),
  first_label AS (SELECT kb_id, min(label) AS label FROM kb_labels GROUP BY kb_id), kinds AS (SELECT DISTINCT src AS kb_id, dst AS kind FROM kb_edges WHERE property = 'P31')""".replace("\\\\","\\")
_FOUND = """(SELECT x.query, kb_id, label, CASE kind WHEN 0 THEN 'label' ELSE 'alias' END AS matched, place FROM (SELECT query, kb_id, kind, CAST(row_number() OVER (PARTITION BY query ORDER BY kind, kb_id) AS INT) AS place FROM (SELECT DISTINCT {0} AS query FROM {1}) JOIN names ON q = lower(trim(query))) x
    LEFT JOIN first_label USING (kb_id) WHERE place <= 30)"""
_KEPT = """(SELECT f.query, a.expected_type, f.kb_id, f.label, EXISTS (SELECT 1 FROM kinds k WHERE k.kb_id = f.kb_id AND k.kind = a.expected_type) AS typed FROM {0} f JOIN (SELECT DISTINCT {1} AS query, expected_type FROM {2}) a ON a.query = f.query)"""
_PICK = "SELECT query, expected_type, kb_id, label FROM {0} QUALIFY typed OR NOT bool_or(typed) OVER (PARTITION BY query, expected_type)"
_DIRECT = f"{_NAMES}, found AS {_FOUND.format('reference', 'surfaces')}, rated AS {_KEPT.format('found', 'reference', 'asked')}, kept AS ({_PICK.format('rated')})"
_COMPOSED = f"""{_NAMES}, put AS (SELECT reference, expected_type, title, page_id, outcome, outcome IN ('canonical', 'clean_redirect') AS clear, CASE WHEN outcome IN ('canonical', 'clean_redirect') THEN title ELSE reference END AS query FROM asked JOIN titled USING (reference)),
  found AS {_FOUND.format('query', 'put')}, rated AS {_KEPT.format('found', 'query', 'put')}, kept AS ({_PICK.format('rated')}), only_one AS (SELECT query, expected_type, min(kb_id) AS id, arg_min(label, kb_id) AS label FROM kept GROUP BY query, expected_type HAVING count(*) = 1),
  saved AS (SELECT p.*, id, label, CASE WHEN clear AND NOT EXISTS (SELECT 1 FROM found f WHERE f.query = p.query AND f.kb_id = page_id) AND (p.expected_type IS NULL OR EXISTS (SELECT 1 FROM kinds k WHERE k.kb_id = page_id AND k.kind = p.expected_type)) THEN page_id END AS rescue
    FROM put p LEFT JOIN only_one o ON o.query = p.query AND o.expected_type IS NOT DISTINCT FROM p.expected_type),
  composed AS (SELECT reference, expected_type, coalesce(id, rescue) AS kb_id, CASE WHEN id IS NOT NULL THEN label WHEN rescue IS NOT NULL THEN title ELSE reference END AS form, outcome FROM saved)"""
_NAME_VIEWS = ("surfaces", "redirects", "kb_labels", "aliases", "kb_edges")
QUERIES |= {"A20_redirects": _titles, "A12_search": _searched, "I5_normaliser": _composed, "I1_entity_resolve": _resolved_names}
QUERIES["I3_type_filter"] = lambda s, d: resolve.keep_typed(*_candidates(s, d)).select("query", "expected_type", "kb_id")
QUERIES["I4_only_candidate"] = lambda s, d: resolve.select_only(*_candidates(s, d)).select("query", "expected_type", "kb_id", "label")
SQL["A20_redirects"] = oracle(f"WITH {_NAMES} SELECT reference, title, page_id, outcome FROM titled", *_NAME_VIEWS)
SQL["A12_search"] = oracle(f"WITH {_DIRECT} SELECT query, kb_id, label, matched, place, 1.0 / CAST(place AS DOUBLE) AS score FROM found", *_NAME_VIEWS)
SQL["I3_type_filter"] = oracle(f"WITH {_DIRECT} SELECT query, expected_type, kb_id FROM kept", *_NAME_VIEWS)
SQL["I4_only_candidate"] = oracle(f"WITH {_DIRECT} SELECT query, expected_type, min(kb_id) AS kb_id, arg_min(label, kb_id) AS label FROM kept GROUP BY query, expected_type HAVING count(*) = 1", *_NAME_VIEWS)
SQL["I5_normaliser"] = oracle(f"WITH {_COMPOSED} SELECT * FROM composed", *_NAME_VIEWS)
SQL["I1_entity_resolve"] = oracle(f"""WITH {_COMPOSED}, n AS (SELECT reference, min(kb_id) AS id FROM composed WHERE kb_id IS NOT NULL AND expected_type IS NULL GROUP BY reference), h AS (SELECT reference, arg_min(kb_id, id) AS id FROM resolutions WHERE NOT retracted GROUP BY reference),
  b AS (SELECT query AS reference, kb_id AS id FROM {_FOUND.format('reference', 'surfaces')} WHERE place = 1) SELECT reference, coalesce(n.id, nullif(h.id, ''), CASE WHEN h.id IS NULL THEN b.id END) AS kb_id,
  CASE WHEN n.id IS NOT NULL THEN 'normaliser' WHEN h.id = '' THEN 'negative' WHEN h.id IS NOT NULL THEN 'cache' WHEN b.id IS NOT NULL THEN 'search' ELSE 'nothing' END AS via
  FROM (SELECT DISTINCT reference FROM surfaces) LEFT JOIN n USING (reference) LEFT JOIN h USING (reference) LEFT JOIN b USING (reference)""", *_NAME_VIEWS, "resolutions")  # fmt: skip
QUERIES["J4_subsumption_conflicts"] = lambda s, d: substrate.verdict_conflicts(view(s, d, "subsumptions"), ["a", "b", "relation"])
SQL["J4_subsumption_conflicts"] = oracle("SELECT a, b, relation, count(DISTINCT verdict) AS verdicts FROM subsumptions WHERE NOT retracted GROUP BY a, b, relation HAVING count(DISTINCT verdict) > 1", "subsumptions")
QUERIES["I8_slot_map_borrow"] = lambda s, d: substrate.borrowed(view(s, d, "mappings")).select("id", "subject_slot")
SQL["I8_slot_map_borrow"] = oracle("SELECT id, coalesce(subject_slot, first_value(subject_slot IGNORE NULLS) OVER (PARTITION BY property ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS subject_slot FROM mappings", "mappings")


def _touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I16: how often each mapping was used."""
    used = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(C("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("used"))
    return _mappings(spark, sf_dir).join(used, "id", "left").select("id", F.coalesce("used", F.lit(0)).alias("used"))


QUERIES["I16_usage_touch"] = _touched
SQL["I16_usage_touch"] = oracle("SELECT id, (SELECT count(*) FROM lineitem WHERE l_partkey = id) AS used FROM mappings", "mappings")
QUERIES["I17_retract"] = lambda s, d: substrate.retract(view(s, d, "mappings"), view(s, d, "mapping_retractions")).select("id", "retracted")
SQL["I17_retract"] = oracle(f"WITH retractions AS ({VIEWS['mapping_retractions'].format(lineitem='lineitem')}) SELECT id, retracted OR (NOT pinned AND id IN (SELECT id FROM retractions)) AS retracted FROM mappings", "mappings")


# ---- the walk ----
def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of claims in both slots, each once, 48 at most by name."""
    claims = _resolved(spark, sf_dir).where("subject_id IS NOT NULL").select("claim_id", F.explode(F.array_compact(F.array("subject_id", "object_id"))).alias("node"))
    edges = view(spark, sf_dir, "kb_edges").where(C("property").isin(*graph.NEIGHBOURS["default"]))
    steps = edges.select(C("src").alias("node"), C("dst").alias("neighbour")).union(edges.select("dst", "src")).distinct()
    # a node's first 48 are enough for any claim; a task keeps them before they are dealt out, so a hub's edges don't meet in one
    first = Window.partitionBy("node").orderBy("neighbour")
    few = steps.join(claims.select("node").distinct(), "node", "left_semi").withColumn("n", F.row_number().over(first)).where("n <= 48").drop("n")
    rows = claims.join(few, "node").select("claim_id", "neighbour").distinct()
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("claim_id").orderBy("neighbour"))).where("n <= 48")
    return ranked.groupBy("claim_id").agg(F.count(F.lit(1)).alias("probes"), F.max("neighbour").alias("last"))


QUERIES["G13_neighbour_probes"] = _capped
SQL["G13_neighbour_probes"] = oracle(f"""WITH {RESOLVED}, n AS (SELECT claim_id, subject_id AS node FROM resolved WHERE subject_id IS NOT NULL UNION SELECT claim_id, object_id FROM resolved WHERE subject_id IS NOT NULL AND object_id IS NOT NULL),
  e AS (SELECT * FROM kb_edges WHERE property IN ('P31', 'P279', 'P361', 'P131', 'P17')), st AS (SELECT src AS node, dst AS neighbour FROM e UNION ALL SELECT dst, src FROM e),
  r AS (SELECT DISTINCT claim_id, neighbour FROM n JOIN st USING (node)) SELECT claim_id, count(*) AS probes, max(neighbour) AS last FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY neighbour) AS k FROM r) WHERE k <= 48 GROUP BY claim_id""", "claims", "kb_labels", "kb_edges")  # fmt: skip

# ---- sources and sinks ----


def _sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verifications stored, some of them stored again by a second batch, which is then replayed."""
    rows = view(spark, sf_dir, "verdicts").select("verification_id", "claim_id", "verdict")
    doubtful = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 0").select(C("doc_id").alias("claim_id"))
    again = rows.join(rows.join(doubtful, "claim_id", "left_semi").select("verification_id").distinct(), "verification_id", "left_semi").withColumn("verdict", F.lit("no_grounding_found"))
    store = stateful.VerificationStore(f"{shared_dir(spark)}/verifications-{uuid.uuid4().hex}")
    for number, batch in ((0, rows), (1, again), (1, again)):
        store.write(batch, number)
    return store.read(spark, rows.withColumn("part", F.lit(0)).schema).select(*rows.columns)


QUERIES["A24_verification_sink"] = _sink
SQL["A24_verification_sink"] = oracle("""SELECT verification_id, claim_id, CASE WHEN verification_id IN (SELECT verification_id FROM verdicts JOIN labels ON doc_id = claim_id WHERE quality = 0) THEN 'no_grounding_found' ELSE verdict END AS verdict FROM verdicts""", "verdicts")


def _from_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements out of a store that is a data source, without deprecated ones."""
    path = statements.store(view(spark, sf_dir, "kb_statements"))
    statements.register(spark)
    return spark.read.format("statements").load(path).where("rank <> 'deprecated'").select("stmt_id", "entity", "property", "value", "start_q", "end_q")


QUERIES["A10_statement_source"] = _from_source
SQL["A10_statement_source"] = oracle("SELECT stmt_id, entity, property, value, start_q, end_q FROM kb_statements WHERE rank <> 'deprecated'", "kb_statements")


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: the statements of one property from files laid out by property."""
    rows = view(spark, sf_dir, "kb_statements").select("stmt_id", "entity", "property", "value", "value_type")
    return files.scan_property(spark, files.by_property(rows), "stmt_id long, entity string, value string, value_type string, property string", "P17").select("stmt_id", "entity", "value", "value_type")


QUERIES["A10_fixture_scan"] = _scanned
SQL["A10_fixture_scan"] = oracle("SELECT stmt_id, entity, value, value_type FROM kb_statements WHERE property = 'P17'", "kb_statements")


def _migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: mappings stored by a version that had no pins and retractions, read as today's layout."""
    rows = _mappings(spark, sf_dir).select("id", "predicate", "property", "pinned", "retracted")
    return files.migrated(files.old_layout(rows, ["id", "predicate", "property"], "mappings"), rows.schema, {"pinned": False, "retracted": False})


QUERIES["A3_schema_migration"] = _migrated
SQL["A3_schema_migration"] = oracle("SELECT id, predicate, property, false AS pinned, false AS retracted FROM mappings", "mappings")


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bindings of seeds: the pinned mapping's own property, and the others that the predicate is mapped to as gated candidates."""
    live = _mappings(spark, sf_dir).where("NOT retracted")
    seeds = live.where("pinned").groupBy("predicate").agg(F.min_by("property", "id").alias("property"))
    return substrate.seed_bindings(seeds, live)


QUERIES["A6_seed_bindings"] = _seeded
SQL["A6_seed_bindings"] = oracle("""WITH l AS (SELECT * FROM mappings WHERE NOT retracted), s AS (SELECT predicate, arg_min(property, id) AS property FROM l WHERE pinned GROUP BY predicate) SELECT predicate, property, false AS gated, CAST(1.0 AS DOUBLE) AS rank FROM s
  UNION ALL SELECT DISTINCT l.predicate, l.property, true, CAST(0.4 AS DOUBLE) FROM l JOIN s USING (predicate) WHERE l.property <> s.property""", "mappings")  # fmt: skip


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: mappings with seeds, read from JSON lines, in place of those on the same predicate and property."""
    columns = ["id", "predicate", "property", "pinned"]
    new = files.seeds(files.json_round_trip(view(spark, sf_dir, "seed_rows"), "seeds"))
    return substrate.upsert(_mappings(spark, sf_dir).select(*columns), new, ["predicate", "property"]).select(*columns)


QUERIES["A5_seed_upsert"] = _upserted
SQL["A5_seed_upsert"] = oracle("SELECT id, predicate, property, pinned FROM mappings m WHERE NOT EXISTS (SELECT 1 FROM seed_rows n WHERE n.predicate = m.predicate AND n.property = m.property) UNION ALL SELECT id, predicate, property, true FROM seed_rows", "mappings", "seed_rows")
QUERIES["A8_json_lines"] = lambda s, d: files.json_round_trip(view(s, d, "cases").select("case_id", "failure_mode", "ground_truth"), "cases")
SQL["A8_json_lines"] = oracle("SELECT case_id, failure_mode, ground_truth FROM cases", "cases")


QUERIES["M8_percentile_index"] = lambda s, d: rollup.values_at(s.read.parquet(f"{d}/orders.parquet"), "o_orderpriority", "o_totalprice", lambda n: F.array(rollup.p95_place(n))).select("o_orderpriority", C("value").alias("p95"))
SQL["M8_percentile_index"] = "SELECT o_orderpriority, o_totalprice AS p95 FROM (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS n, count(*) OVER (PARTITION BY o_orderpriority) AS n_all FROM orders) WHERE n = greatest(floor(n_all * 0.95), 1)"


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: the score of the best candidate of a name and its distance to the next one."""
    found = kb.candidates(view(spark, sf_dir, "kb_labels")).where("place <= 2")
    return found.groupBy("reference").agg(F.max("score").alias("top"), (F.max("score") - F.max(F.when(C("place") == 2, C("score")))).alias("gap"))


QUERIES["M5_candidate_gap"] = _gaps
SQL["M5_candidate_gap"] = oracle("SELECT label AS reference, CAST(1.0 AS DOUBLE) AS top, CASE WHEN count(*) > 1 THEN CAST(0.5 AS DOUBLE) END AS gap FROM kb_labels GROUP BY label", "kb_labels")


def _role_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the types of a property's subjects meet those of its objects, and which do."""
    told = _mappings(spark, sf_dir).where("NOT retracted").groupBy("property").agg(F.collect_set("subject_type").alias("s"), F.collect_set("object_type").alias("o"))
    return told.select("property", F.arrays_overlap("s", "o").alias("overlap"), F.array_join(F.array_sort(F.array_intersect("s", "o")), ",").alias("common"))


QUERIES["M10_type_overlap"] = _role_overlap
SQL["M10_type_overlap"] = oracle("""WITH s AS (SELECT DISTINCT property, subject_type AS t FROM mappings WHERE NOT retracted AND subject_type IS NOT NULL), o AS (SELECT DISTINCT property, object_type AS t FROM mappings WHERE NOT retracted AND object_type IS NOT NULL), b AS (SELECT property, t FROM s JOIN o USING (property, t))
  SELECT property, property IN (SELECT property FROM b) AS overlap, coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM b WHERE b.property = p.property), '') AS common FROM (SELECT DISTINCT property FROM mappings WHERE NOT retracted) p""", "mappings")  # fmt: skip


def _by_label_and_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by label or alias and a class that they are instances of, in any number of steps."""
    names = view(spark, sf_dir, "kb_labels").select("kb_id", C("label").alias("name")).union(view(spark, sf_dir, "aliases").select("kb_id", "alias"))
    classes = paths(spark, sf_dir, "is_a").select(C("src").alias("kb_id"), C("dst").alias("class"))
    return names.distinct().join(classes, "kb_id").groupBy("name", "class").agg(F.min("kb_id").alias("kb_id"), F.count_distinct("kb_id").alias("candidates"))


QUERIES["A13_label_type_lookup"] = _by_label_and_class
SQL["A13_label_type_lookup"] = oracle(f"""WITH RECURSIVE {IS_A} SELECT name, dst AS class, min(kb_id) AS kb_id, count(DISTINCT kb_id) AS candidates FROM (SELECT kb_id, label AS name FROM kb_labels UNION SELECT kb_id, alias FROM aliases) JOIN is_a ON src = kb_id GROUP BY name, dst""", "kb_labels", "kb_edges", "aliases")


def _first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each party's objects once, in the order in which they first come."""
    first = view(spark, sf_dir, "tier_u").groupBy("party", "object").agg(F.min("id").alias("first_id"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("party").orderBy("first_id")))


QUERIES["M12_ordered_dedupe"] = _first_of_each
SQL["M12_ordered_dedupe"] = oracle("SELECT party, object, min(id) AS first_id, CAST(row_number() OVER (PARTITION BY party ORDER BY min(id)) AS INT) AS place FROM tier_u GROUP BY party, object", "tier_u")
# ---- sets ----
QUERIES["F6_iso_or_null"] = lambda s, d: view(s, d, "tier_u").select("id", F.nullif(F.nullif(F.trim("valid_until"), F.lit("")), F.lit("before_present")).alias("end_date"))
SQL["F6_iso_or_null"] = oracle("SELECT id, nullif(nullif(trim(valid_until), ''), 'before_present') AS end_date FROM tier_u", "tier_u")


def _substituted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may stand for a claim's object: what lies on it as on a continent."""
    lies_on = view(spark, sf_dir, "kb_edges").where("property = 'P30'").select(C("dst").alias("object_id"), C("src").alias("substitute"))
    return _resolved(spark, sf_dir).join(lies_on, "object_id").select("claim_id", "subject_id", "substitute")


QUERIES["G18_entity_substitution"] = _substituted
SQL["G18_entity_substitution"] = oracle(f"WITH {RESOLVED} SELECT claim_id, subject_id, src AS substitute FROM resolved JOIN kb_edges ON dst = object_id AND property = 'P30'", "claims", "kb_labels", "kb_edges")


QUERIES["I12_query_neighbours"] = lambda s, d: view(s, d, "subsumptions").where("NOT retracted").groupBy("a", "relation").agg(F.count_distinct("b").alias("neighbours"))
SQL["I12_query_neighbours"] = oracle("SELECT a, relation, count(DISTINCT b) AS neighbours FROM subsumptions WHERE NOT retracted GROUP BY a, relation", "subsumptions")
QUERIES["M9_candidate_union"] = lambda s, d: view(s, d, "subsumptions").select(C("a").alias("entity"), F.lit("substrate").alias("source")).unionByName(view(s, d, "kb_labels").select(C("label").alias("entity"), F.lit("kb").alias("source"))).groupBy("entity").agg(F.count_distinct("source").alias("sources"))
SQL["M9_candidate_union"] = oracle("SELECT entity, count(DISTINCT source) AS sources FROM (SELECT a AS entity, 'substrate' AS source FROM subsumptions UNION ALL SELECT label, 'kb' FROM kb_labels) GROUP BY entity", "subsumptions", "kb_labels")
QUERIES["M11_set_difference"] = lambda s, d: view(s, d, "claims").select("subject").subtract(view(s, d, "kb_labels").select("label"))
SQL["M11_set_difference"] = oracle("SELECT subject FROM claims EXCEPT SELECT label FROM kb_labels", "claims", "kb_labels")

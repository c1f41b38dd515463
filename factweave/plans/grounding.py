"""Queries of statements and the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import text
from factweave.operators import graph, kb
from factweave.plans.extraction import QUANTITY, compatible_sql, date_relation_sql, latest_sql
from factweave.plans.views import NOW, oracle, view
from factweave.sources.scratch import settle

C = F.col
QUERIES, SQL = {}, {}


#: Texts that are entities of their own.
IDENTIFIER = "^O[0-9]+$"
#: Classes whose instances are regions.
REGIONS = ("country", "union")


def paths(spark: SparkSession, sf_dir: str, relation: str) -> DataFrame:
    edges = view(spark, sf_dir, "kb_edges")
    return graph.part_of_paths(edges, REGIONS) if relation == "part_of" else graph.transitive_paths(edges, graph.PATHS[relation])


def paths_sql(name: str, properties: tuple[str, ...]) -> str:
    """The closure level by level: a pair is kept at the level that first finds it, whatever its depth."""
    listed = ", ".join(f"'{p}'" for p in properties)
    return f"""{name}_step AS (SELECT src, dst, min(property) AS p FROM kb_edges WHERE property IN ({listed}) GROUP BY src, dst),
      {name}_all(src, dst, depth, first_property) USING KEY (src, dst) AS (SELECT src, dst, 1, p FROM {name}_step
      UNION SELECT x.src, x.dst, x.depth, x.first_property FROM (SELECT a.src, e.dst, a.depth + 1 AS depth, min(a.first_property) AS first_property FROM {name}_all a JOIN {name}_step e ON e.src = a.dst GROUP BY ALL) x
        LEFT JOIN recurring.{name}_all k ON k.src = x.src AND k.dst = x.dst WHERE k.src IS NULL),
      {name} AS (SELECT src, dst, CAST(depth AS INT) AS depth, first_property FROM {name}_all)"""


_BRIDGED = """bridges AS (SELECT DISTINCT src, dst FROM kb_edges b WHERE property = 'P361' AND EXISTS (SELECT 1 FROM kb_edges t WHERE t.src = b.src AND t.property = 'P31' AND t.dst IN ('country', 'union'))
      AND EXISTS (SELECT 1 FROM kb_edges t WHERE t.src = b.dst AND t.property = 'P31' AND t.dst IN ('country', 'union'))),
  part_of AS (SELECT src, dst, CAST(min(depth) AS INT) AS depth, arg_min(first_property, (depth, first_property)) AS first_property FROM (SELECT * FROM plain_part_of UNION ALL SELECT src, dst, 1, 'P361' FROM bridges
      UNION ALL SELECT p.src, b.dst, depth + 1, first_property FROM plain_part_of p JOIN bridges b ON b.src = p.dst) GROUP BY src, dst)"""
PART_OF, IS_A = f"{paths_sql('plain_part_of', graph.PATHS['part_of'])}, {_BRIDGED}", paths_sql("is_a", graph.PATHS["is_a"])
QUERIES["G2_part_of_paths"] = lambda s, d: paths(s, d, "part_of")
SQL["G2_part_of_paths"] = oracle(f"WITH RECURSIVE {PART_OF} SELECT * FROM part_of", "kb_edges")
QUERIES["G2_is_a_paths"] = lambda s, d: paths(s, d, "is_a")
SQL["G2_is_a_paths"] = oracle(f"WITH RECURSIVE {IS_A} SELECT * FROM is_a", "kb_edges")
QUERIES["G7_single_property_paths"] = lambda s, d: graph.transitive_paths(view(s, d, "kb_edges"), ("P279",))
SQL["G7_single_property_paths"] = oracle(f"WITH RECURSIVE {paths_sql('up', ('P279',))} SELECT * FROM up", "kb_edges")
QUERIES["G1_relation_edges"] = lambda s, d: view(s, d, "kb_edges").where(C("property").isin(*graph.PATHS["part_of"])).groupBy("property").agg(F.count(F.lit(1)).alias("edges"))
SQL["G1_relation_edges"] = oracle("SELECT property, count(*) AS edges FROM kb_edges WHERE property IN ('P131', 'P30', 'P17') GROUP BY property", "kb_edges")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.resolve(view(spark, sf_dir, "claims"), view(spark, sf_dir, "kb_labels"), IDENTIFIER)


RESOLVED = """chosen AS (SELECT label, min(kb_id) AS id FROM kb_labels GROUP BY label),
  resolved AS (SELECT c.*, coalesce(s.id, CASE WHEN regexp_matches(subject, '^O[0-9]+$') THEN subject END) AS subject_id, coalesce(o.id, CASE WHEN regexp_matches(object, '^O[0-9]+$') THEN object END) AS object_id
    FROM claims c LEFT JOIN chosen s ON s.label = subject LEFT JOIN chosen o ON o.label = object)"""
QUERIES["C9_resolve_entities"] = lambda s, d: _resolved(s, d).select("claim_id", "subject_id", "object_id")
SQL["C9_resolve_entities"] = oracle(f"WITH {RESOLVED} SELECT claim_id, subject_id, object_id FROM resolved", "claims", "kb_labels")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).where("subject_id IS NOT NULL AND object_id IS NOT NULL").select("claim_id", C("subject_id").alias("a"), C("object_id").alias("b"))


QUERIES["G3_subsumption"] = lambda s, d: graph.subsumption(_pairs(s, d), paths(s, d, "part_of")).select("claim_id", "relation")
SQL["G3_subsumption"] = oracle(f"""WITH RECURSIVE {PART_OF}, {RESOLVED} SELECT claim_id, CASE WHEN subject_id = object_id THEN 'equivalent' WHEN EXISTS (SELECT 1 FROM part_of WHERE src = subject_id AND dst = object_id) THEN 'a_subsumed_by_b'
  WHEN EXISTS (SELECT 1 FROM part_of WHERE dst = subject_id AND src = object_id) THEN 'b_subsumed_by_a' ELSE 'unrelated' END AS relation FROM resolved WHERE subject_id IS NOT NULL AND object_id IS NOT NULL""", "claims", "kb_labels", "kb_edges")  # fmt: skip
QUERIES["G4_establishing_property"] = lambda s, d: _pairs(s, d).join(paths(s, d, "part_of"), (C("src") == C("a")) & (C("dst") == C("b"))).select("claim_id", "first_property", "depth")
SQL["G4_establishing_property"] = oracle(f"WITH RECURSIVE {PART_OF}, {RESOLVED} SELECT claim_id, first_property, depth FROM resolved JOIN part_of ON src = subject_id AND dst = object_id", "claims", "kb_labels", "kb_edges")
QUERIES["G5_places"] = lambda s, d: graph.places(paths(s, d, "is_a"), ("country", "continent"))
SQL["G5_places"] = oracle(f"WITH RECURSIVE {IS_A} SELECT DISTINCT src AS node FROM is_a WHERE dst IN ('country', 'continent')", "kb_edges")
DISJOINT = """tops AS (SELECT DISTINCT src AS continent FROM is_a WHERE dst = 'continent'),
  lies_in AS (SELECT src, min(dst) AS continent FROM part_of WHERE dst IN (SELECT continent FROM tops) GROUP BY src)"""
APART = """value <> expected AND ((expected IN (SELECT continent FROM tops) AND coalesce(vi.continent <> expected, false)) OR (expected IN (SELECT src FROM is_a WHERE dst IN ('country', 'continent', 'place'))
  AND coalesce(vi.continent = ei.continent, false) AND NOT EXISTS (SELECT 1 FROM part_of WHERE src = value AND dst = expected) AND NOT EXISTS (SELECT 1 FROM part_of WHERE dst = value AND src = expected)))"""


_PLACING = ", ".join(f"'{p}'" for p in graph.PATHS["part_of"])
_PLACED = f"pairs AS (SELECT claim_id, stmt_id, value, object_id AS expected FROM resolved JOIN kb_statements ON entity = subject_id AND property IN ({_PLACING}) WHERE object_id IS NOT NULL)"


def _place_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims and the statements that place their subject anywhere, by whatever property."""
    held = view(spark, sf_dir, "kb_statements").where(C("property").isin(*graph.PATHS["part_of"])).select(C("entity").alias("subject_id"), "value", "stmt_id")
    return _resolved(spark, sf_dir).where("object_id IS NOT NULL").join(held, "subject_id").select("claim_id", "stmt_id", "value", C("object_id").alias("expected"))


QUERIES["G6_geographic_disjoint"] = lambda s, d: graph.disjoint_places(_place_pairs(s, d), paths(s, d, "part_of"), paths(s, d, "is_a")).select("claim_id", "stmt_id", "disjoint")
SQL["G6_geographic_disjoint"] = oracle(f"""WITH RECURSIVE {PART_OF}, {IS_A}, {RESOLVED}, {DISJOINT}, {_PLACED}
  SELECT claim_id, stmt_id, {APART} AS disjoint FROM pairs LEFT JOIN lies_in vi ON vi.src = value LEFT JOIN lies_in ei ON ei.src = expected""", "claims", "kb_labels", "kb_edges", "kb_statements")  # fmt: skip
QUERIES["G9_distribution_directions"] = lambda s, d: view(s, d, "distributions").select("id", graph.directions(C("verdict")).alias("directions"))
SQL["G9_distribution_directions"] = oracle("SELECT id, CASE verdict WHEN 'up' THEN 'child' WHEN 'down' THEN 'parent' WHEN 'both' THEN 'child,parent' ELSE '' END AS directions FROM distributions", "distributions")
QUERIES["A19_neighbours"] = lambda s, d: graph.neighbours(view(s, d, "kb_edges"), view(s, d, "kb_edges").select(C("dst").alias("node")).distinct(), graph.NEIGHBOURS["default"])
SQL["A19_neighbours"] = oracle("""WITH n AS (SELECT DISTINCT dst AS node FROM kb_edges), e AS (SELECT * FROM kb_edges WHERE property IN ('P31', 'P279', 'P361', 'P131', 'P17'))
  SELECT node, property, dst AS neighbour, 'out' AS way FROM n JOIN e ON src = node UNION ALL
  SELECT node, property, neighbour, 'in' FROM (SELECT node, property, src AS neighbour, row_number() OVER (PARTITION BY node ORDER BY src, property) AS k FROM n JOIN e ON dst = node) WHERE k <= 20""", "kb_edges")  # fmt: skip
QUERIES["A9_usable_statements"] = lambda s, d: kb.usable(view(s, d, "kb_statements")).select("stmt_id", "entity", "property", "value", "rank")
SQL["A9_usable_statements"] = oracle("SELECT stmt_id, entity, property, value, rank FROM kb_statements WHERE rank <> 'deprecated'", "kb_statements")
QUERIES["A11_entity_candidates"] = lambda s, d: kb.candidates(view(s, d, "kb_labels"))
SQL["A11_entity_candidates"] = oracle("SELECT label AS reference, kb_id, CAST(row_number() OVER w AS INT) AS place, 1.0 / CAST(row_number() OVER w AS DOUBLE) AS score FROM kb_labels WINDOW w AS (PARTITION BY label ORDER BY kb_id)", "kb_labels")
QUERIES["I2_select_candidate"] = lambda s, d: kb.select_candidate(kb.candidates(view(s, d, "kb_labels")))
SQL["I2_select_candidate"] = oracle("SELECT label AS reference, min(kb_id) AS kb_id, false AS ambiguous FROM kb_labels GROUP BY label", "kb_labels")
QUERIES["A14_unique_reverse_lookup"] = lambda s, d: view(s, d, "kb_labels").groupBy("label").agg(F.count_distinct("kb_id").alias("n"), F.min("kb_id").alias("kb_id")).where("n = 1").select("label", "kb_id")
SQL["A14_unique_reverse_lookup"] = oracle("SELECT label, min(kb_id) AS kb_id FROM kb_labels GROUP BY label HAVING count(DISTINCT kb_id) = 1", "kb_labels")
QUERIES["A15_types"] = lambda s, d: view(s, d, "kb_edges").where("property = 'P31'").groupBy("src").agg(F.array_join(F.sort_array(F.collect_set("dst")), ",").alias("types"))
SQL["A15_types"] = oracle("SELECT src, string_agg(DISTINCT dst, ',' ORDER BY dst) AS types FROM kb_edges WHERE property = 'P31' GROUP BY src", "kb_edges")
QUERIES["A16_value_labels"] = lambda s, d: view(s, d, "kb_statements").where("value_type = 'entity'").join(view(s, d, "kb_labels"), C("value") == C("kb_id"), "left").select("stmt_id", "label")
SQL["A16_value_labels"] = oracle("SELECT stmt_id, label FROM kb_statements LEFT JOIN kb_labels ON value = kb_id WHERE value_type = 'entity'", "kb_statements", "kb_labels")


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("property").orderBy("entity", "value")
    return view(spark, sf_dir, "kb_statements").select("property", "entity", "value").distinct().withColumn("place", F.row_number().over(order)).where("place <= 10")


QUERIES["A18_property_examples"] = _sampled
SQL["A18_property_examples"] = oracle("SELECT * FROM (SELECT property, entity, value, CAST(row_number() OVER (PARTITION BY property ORDER BY entity, value) AS INT) AS place FROM (SELECT DISTINCT property, entity, value FROM kb_statements)) WHERE place <= 10", "kb_statements")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).join(view(spark, sf_dir, "predicates").where("property IS NOT NULL").drop("id"), "predicate")


def bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only claims of predicates that have a binding are resolved."""
    bindings = view(spark, sf_dir, "bindings")
    claims = view(spark, sf_dir, "claims").join(bindings.select("predicate").distinct(), "predicate", "left_semi")
    return kb.bind(kb.resolve(claims, view(spark, sf_dir, "kb_labels"), IDENTIFIER), bindings, view(spark, sf_dir, "predicates"))


def compared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The comparison of each claim and binding, what was asked, and the paths by class."""
    part_of, is_a = paths(spark, sf_dir, "part_of"), paths(spark, sf_dir, "is_a")
    place = graph.place_table(part_of, is_a)
    statements = view(spark, sf_dir, "kb_statements").join(view(spark, sf_dir, "bindings").select("property").distinct(), "property", "left_semi")
    held = settle(kb.with_values(statements, place, view(spark, sf_dir, "kb_labels")), "held")
    asked = settle(bound(spark, sf_dir), "bound")
    return kb.compare(asked, held, part_of, place, F.to_date(F.lit(NOW[:10]))), asked, is_a


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, asked, is_a = compared(spark, sf_dir)
    return kb.gate(rows, kb.kinds(asked, is_a))


def grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.ground(gated(spark, sf_dir))


_APPROX = r"nullif(regexp_extract(trim(expected), '(?i)^(?:(?:approximately|approx\.?|circa|about|around|ca\.?|c\.?|~)\s+|~\s*)([0-9]{4})$', 1), '')"
_RELATION = date_relation_sql("coalesce(approx, expected)", "value")
BOUND = f"""first_meta AS (SELECT predicate, arg_min(object_type, id) AS object_type, arg_min(is_location, id) AS is_location FROM predicates GROUP BY predicate),
  bound0 AS (SELECT claim_id, place, property, inverted, single_valued, gated, object_class, object_type, is_location, polarity, valid_from, valid_until, CASE WHEN inverted THEN object_id ELSE subject_id END AS lookup,
      CASE WHEN inverted THEN subject_id ELSE object_id END AS expected_id, CASE WHEN inverted THEN subject ELSE object END AS expected FROM resolved JOIN bindings USING (predicate) JOIN first_meta USING (predicate)),
  bound AS (SELECT *, {_APPROX} AS approx FROM bound0)"""
COMPARED = f"""{BOUND},
  marked AS (SELECT a.*, k.stmt_id, k.stmt_id IS NOT NULL AS there, value, value_type, start_q, end_q,
      k.stmt_id IS NOT NULL AND (coalesce(lower(trim(value)) = lower(trim(CASE WHEN object_type = 'entity' THEN coalesce(expected_id, expected) ELSE expected END)), false) OR (object_type = 'time' AND coalesce({_RELATION} = 'match', false))) AS is_match,
      {compatible_sql('start_q', 'end_q', 'valid_from', 'valid_until')} OR (k.stmt_id IS NOT NULL AND object_type <> 'entity') AS fits, coalesce({_RELATION} = 'mismatch', false) AS is_clean, coalesce({latest_sql('end_q')} < DATE '{NOW[:10]}', false) AS past
    FROM bound a LEFT JOIN kb_statements k ON k.entity = a.lookup AND k.property = a.property AND k.rank <> 'deprecated'),
  pairs AS (SELECT DISTINCT value, expected_id AS expected FROM marked WHERE is_location AND value IS NOT NULL AND expected_id IS NOT NULL),
  apart AS (SELECT value, expected FROM pairs LEFT JOIN lies_in vi ON vi.src = value LEFT JOIN lies_in ei ON ei.src = expected WHERE {APART}),
  flagged AS (SELECT m.*, p.src IS NOT NULL AS inside, x.value IS NOT NULL AS disjoint, coalesce(lower(trim(l.label)) = lower(trim(m.expected)), false) AS named,
      is_match AND object_type = 'entity' AND valid_until IS NULL AND coalesce(valid_from < start_q AND NOT starts_with(start_q, valid_from), false) AND end_q IS NULL AS early, there AND fits AND NOT is_match AS is_wrong
    FROM marked m LEFT JOIN part_of p ON p.src = m.value AND p.dst = m.expected_id LEFT JOIN apart x ON x.value = m.value AND x.expected = m.expected_id LEFT JOIN kb_labels l ON l.kb_id = m.value),
  told AS (SELECT claim_id, place, any_value(property) AS property, any_value(object_type) AS object_type, any_value(expected_id) AS expected_id, any_value(approx) AS approx, any_value(single_valued) AS single_valued, any_value(gated) AS gated,
      any_value(object_class) AS object_class, any_value(is_location) AS is_location, any_value(polarity) AS polarity, any_value(valid_from) AS valid_from, any_value(valid_until) AS valid_until,
      bool_or(is_match AND fits) AS matched, bool_or(fits AND inside) AS inner_match, bool_or(is_wrong) AS wrong, count(DISTINCT CASE WHEN is_wrong THEN CASE WHEN object_type = 'time' THEN coalesce(nullif(regexp_extract(value, '^[+]?([0-9]{{4}})', 1), ''), value) ELSE value END END) AS n_values,
      bool_or(is_wrong AND is_clean) AS clean, bool_or(disjoint) AS disjoint, bool_or(is_match) AS ever, coalesce(bool_and(past) FILTER (WHERE is_match), false) AS only_past, bool_or(early) AS early, bool_or(is_wrong AND named) AS named,
      count(*) FILTER (WHERE there) AS n_statements, arg_min(value, stmt_id) FILTER (WHERE is_wrong) AS wrong_value, arg_min(value_type, stmt_id) FILTER (WHERE is_wrong) AS wrong_type,
      arg_min(start_q IS NULL, stmt_id) FILTER (WHERE is_match AND fits) AS start_missing FROM flagged GROUP BY claim_id, place),
  judged AS (SELECT *, valid_from IS NULL AND valid_until IS NULL AS present, CASE WHEN object_type = 'entity' AND expected_id IS NULL THEN 'value_unresolved' WHEN n_values > 1 THEN 'multi_valued_single_valued_predicate'
      WHEN object_type = 'entity' AND wrong_type NOT IN ('entity', 'literal') OR object_type = 'time' AND wrong_type NOT IN ('date', 'literal') OR object_type = 'quantity' AND wrong_type NOT IN ('quantity', 'literal') THEN 'value_type_object_type_mismatch'
      WHEN object_type = 'entity' AND wrong_type <> 'entity' THEN 'entity_claim_vs_literal_value' WHEN object_type = 'time' AND approx IS NOT NULL THEN 'approximate_date_no_year_match' WHEN object_type = 'time' AND NOT clean THEN 'date_not_a_clean_mismatch' END AS unclear FROM told),
  compared AS (SELECT *, CASE WHEN matched OR inner_match THEN 'verified' WHEN wrong AND single_valued THEN CASE WHEN unclear IS NULL THEN 'contradicted' ELSE 'no_match' END WHEN is_location AND disjoint THEN 'contradicted'
      WHEN object_type = 'entity' AND present AND ever AND only_past THEN 'contradicted' ELSE 'no_match' END AS verdict,
      CASE WHEN matched OR inner_match THEN NULL WHEN wrong AND single_valued THEN unclear WHEN is_location AND disjoint THEN NULL WHEN object_type = 'entity' AND present AND ever AND only_past THEN NULL
      WHEN object_type = 'entity' AND expected_id IS NULL THEN 'value_unresolved' ELSE 'no_matching_statement' END AS reason FROM judged)"""
_BASE = ("claims", "kb_labels", "kb_edges", "kb_statements", "predicates", "bindings")
PREFIX = f"WITH RECURSIVE {PART_OF}, {IS_A}, {DISJOINT}, {RESOLVED}, {COMPARED}"
QUERIES["D13_compare"] = lambda s, d: compared(s, d)[0].select("claim_id", "place", "verdict", "reason", "n_statements")
SQL["D13_compare"] = oracle(f"{PREFIX} SELECT claim_id, place, verdict, reason, n_statements FROM compared", *_BASE)

FLIPPED = "CASE WHEN polarity = 0 AND verdict = 'verified' THEN 'contradicted' WHEN polarity = 0 AND verdict = 'contradicted' THEN 'verified' ELSE verdict END"
GATED = """late AS (SELECT c.*, EXISTS (SELECT 1 FROM is_a WHERE src = expected_id AND dst = object_class) AS member, EXISTS (SELECT 1 FROM is_a WHERE src = expected_id) AS typed, verdict = 'no_match' AND expected_id IS NOT NULL AND early AS is_late FROM compared c),
  named1 AS (SELECT *, CASE WHEN is_late THEN 'verified' WHEN verdict = 'contradicted' AND object_type = 'entity' AND expected_id IS NOT NULL AND named THEN 'verified' ELSE verdict END AS v2 FROM late),
  shut1 AS (SELECT *, v2 = 'contradicted' AND object_class IS NOT NULL AND typed AND NOT member AS shut, v2 = 'verified' AND gated AND NOT member AS unsure FROM named1),
  final1 AS (SELECT * EXCLUDE (verdict, reason), reason AS old_reason, CASE WHEN shut OR unsure THEN 'no_match' ELSE v2 END AS verdict FROM shut1),
  gated1 AS (SELECT claim_id, place, property, single_valued, object_type, n_statements, """+FLIPPED+""" AS verdict, CASE WHEN shut THEN 'value_type_incompatible_binding' WHEN unsure THEN 'value_type_unconfirmed_positive_gate' WHEN verdict = 'no_match' THEN old_reason END AS reason,
    verdict = 'verified' AND (is_late OR coalesce(object_type = 'entity' AND valid_from IS NOT NULL AND valid_until IS NULL AND start_missing, false)) AS unconfirmed, wrong_value FROM final1),
  ranked1 AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY CASE verdict WHEN 'verified' THEN 0 WHEN 'contradicted' THEN 1 ELSE 2 END, CASE WHEN verdict = 'no_match' THEN -place ELSE place END) AS n FROM gated1),
  grounded AS (SELECT r.claim_id, verdict, place, property, reason, unconfirmed, CASE WHEN verdict = 'contradicted' THEN wrong_value END AS contradicting_value, value_known, functional_value_known, functional_entity FROM ranked1 r JOIN (SELECT claim_id,
    bool_or(n_statements > 0 AND object_type = 'entity') AS value_known, bool_or(n_statements > 0 AND single_valued) AS functional_value_known, bool_and(single_valued AND object_type = 'entity') AS functional_entity FROM gated1 GROUP BY claim_id) USING (claim_id) WHERE n = 1)"""
QUERIES["D16_apply_polarity"] = lambda s, d: gated(s, d).select("claim_id", "place", "verdict", "reason", "unconfirmed", "contradicting_value")
SQL["D16_apply_polarity"] = oracle(f"{PREFIX}, {GATED} SELECT claim_id, place, verdict, reason, unconfirmed, CASE WHEN verdict = 'contradicted' THEN wrong_value END AS contradicting_value FROM gated1", *_BASE)
QUERIES["D17_arbitrate_bindings"] = lambda s, d: grounded(s, d).select("claim_id", "verdict", "place", "reason")
SQL["D17_arbitrate_bindings"] = oracle(f"{PREFIX}, {GATED} SELECT claim_id, verdict, place, reason FROM grounded", *_BASE)
QUERIES["D18_value_signals"] = lambda s, d: grounded(s, d).select("claim_id", "value_known", "functional_value_known", "functional_entity")
SQL["D18_value_signals"] = oracle(f"{PREFIX}, {GATED} SELECT claim_id, value_known, functional_value_known, functional_entity FROM grounded", *_BASE)


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on claims by statements alone, counted."""
    rows = grounded(spark, sf_dir).join(view(spark, sf_dir, "claims").select("claim_id", "statement_id"), "claim_id")
    return rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("claims"), F.count_distinct("statement_id").alias("statements"))


QUERIES["verify_direct"] = verified
SQL["verify_direct"] = oracle(f"{PREFIX}, {GATED} SELECT verdict, count(*) AS claims, count(DISTINCT statement_id) AS statements FROM grounded JOIN claims USING (claim_id) GROUP BY 1", *_BASE)
QUERIES["C10_binding_direction"] = lambda s, d: bound(s, d).select("claim_id", "place", "lookup", "expected_id")
SQL["C10_binding_direction"] = oracle(f"WITH {RESOLVED}, {BOUND} SELECT claim_id, place, lookup, expected_id FROM bound", *_BASE)


def _value_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which values are entities: by their tag, or, for bare ends of edges, by their shape."""
    held = view(spark, sf_dir, "kb_statements").select("property", "value", "value_type").union(view(spark, sf_dir, "kb_edges").select("property", "dst", F.lit(None).cast("string")))
    return held.distinct().select("property", "value", F.coalesce("value_type", F.lit("none")).alias("tag"), kb.is_entity_value(C("value"), C("value_type")).alias("is_entity"))


QUERIES["D15_entity_value"] = _value_kinds
SQL["D15_entity_value"] = oracle("""SELECT property, value, coalesce(value_type, 'none') AS tag, coalesce(value_type = 'entity', regexp_matches(value, '^[A-Z]+[0-9]+$')) AS is_entity
  FROM (SELECT property, value, value_type FROM kb_statements UNION SELECT property, dst, NULL FROM kb_edges)""", "kb_statements", "kb_edges")  # fmt: skip
QUERIES["D9_too_early_match"] = lambda s, d: compared(s, d)[0].where("verdict = 'no_match' AND expected_id IS NOT NULL AND early").select("claim_id", "place")
SQL["D9_too_early_match"] = oracle(f"{PREFIX} SELECT claim_id, place FROM compared WHERE verdict = 'no_match' AND expected_id IS NOT NULL AND early", *_BASE)
QUERIES["D10_unconfirmed_start"] = lambda s, d: compared(s, d)[0].where("verdict = 'verified' AND start_open").select("claim_id", "place")
SQL["D10_unconfirmed_start"] = oracle(f"{PREFIX} SELECT claim_id, place FROM compared WHERE verdict = 'verified' AND object_type = 'entity' AND valid_from IS NOT NULL AND valid_until IS NULL AND start_missing", *_BASE)


def _disjoint_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims on places whose every held value surely lies elsewhere."""
    apart = graph.disjoint_places(_place_pairs(spark, sf_dir), paths(spark, sf_dir, "part_of"), paths(spark, sf_dir, "is_a"))
    return apart.groupBy("claim_id").agg(F.bool_and("disjoint").alias("all_apart"))


QUERIES["C13_all_values_apart"] = _disjoint_apart
SQL["C13_all_values_apart"] = oracle(f"""WITH RECURSIVE {PART_OF}, {IS_A}, {RESOLVED}, {DISJOINT}, {_PLACED}
  SELECT claim_id, bool_and({APART}) AS all_apart FROM pairs LEFT JOIN lies_in vi ON vi.src = value LEFT JOIN lies_in ei ON ei.src = expected GROUP BY claim_id""", "claims", "kb_labels", "kb_edges", "kb_statements")  # fmt: skip

QUERIES["D14_value_type_ok"] = lambda s, d: _asked(s, d).join(view(s, d, "kb_statements").withColumnRenamed("entity", "subject_id"), ["subject_id", "property"]).select(
    "claim_id", "stmt_id", F.when(C("object_type") == "entity", C("value_type").isin("entity", "literal")).when(C("object_type") == "time", C("value_type").isin("date", "literal")).when(C("object_type") == "quantity", C("value_type").isin("quantity", "literal")).otherwise(True).alias("ok"))
SQL["D14_value_type_ok"] = oracle(f"""WITH {RESOLVED} SELECT claim_id, stmt_id, CASE object_type WHEN 'entity' THEN value_type IN ('entity', 'literal') WHEN 'time' THEN value_type IN ('date', 'literal') WHEN 'quantity' THEN value_type IN ('quantity', 'literal') ELSE true END AS ok
  FROM resolved JOIN predicates USING (predicate) JOIN kb_statements k ON entity = subject_id AND k.property = predicates.property""", "claims", "kb_labels", "kb_statements", "predicates")  # fmt: skip
QUERIES["C14_object_class_gate"] = lambda s, d: _asked(s, d).where("is_location").join(graph.places(paths(s, d, "is_a"), ("country",)).withColumnRenamed("node", "object_id"), "object_id", "left_semi").select("claim_id")
SQL["C14_object_class_gate"] = oracle(f"WITH RECURSIVE {IS_A}, {RESOLVED} SELECT claim_id FROM resolved JOIN predicates p USING (predicate) WHERE p.property IS NOT NULL AND is_location AND object_id IN (SELECT src FROM is_a WHERE dst = 'country')", "claims", "kb_labels", "kb_edges", "predicates")
QUERIES["C15_name_match"] = lambda s, d: _asked(s, d).join(view(s, d, "kb_statements").withColumnRenamed("entity", "subject_id"), ["subject_id", "property"]).join(view(s, d, "kb_labels"), C("value") == C("kb_id")).where(F.lower(F.trim("label")) == F.lower(F.trim("object"))).select("claim_id", "stmt_id")
SQL["C15_name_match"] = oracle(f"WITH {RESOLVED} SELECT claim_id, stmt_id FROM resolved JOIN predicates USING (predicate) JOIN kb_statements k ON entity = subject_id AND k.property = predicates.property JOIN kb_labels ON kb_id = value WHERE lower(trim(label)) = lower(trim(object))", "claims", "kb_labels", "kb_statements", "predicates")
QUERIES["C11_part_of_upgrade"] = lambda s, d: _place_pairs(s, d).join(paths(s, d, "part_of"), (C("value") == C("src")) & (C("expected") == C("dst")), "left_semi").select("claim_id", "stmt_id")
SQL["C11_part_of_upgrade"] = oracle(f"WITH RECURSIVE {PART_OF}, {RESOLVED} SELECT claim_id, stmt_id FROM resolved JOIN kb_statements ON entity = subject_id AND property IN ({_PLACING}) JOIN part_of ON src = value AND dst = object_id", "claims", "kb_labels", "kb_edges", "kb_statements")
QUERIES["C12_no_statement_fallback"] = lambda s, d: _asked(s, d).where("is_location").join(kb.usable(view(s, d, "kb_statements")).select(C("entity").alias("subject_id"), "property"), ["subject_id", "property"], "left_anti").join(paths(s, d, "part_of"), (C("src") == C("subject_id")) & (C("dst") == C("object_id")), "left_semi").select("claim_id")
SQL["C12_no_statement_fallback"] = oracle(f"""WITH RECURSIVE {PART_OF}, {RESOLVED} SELECT claim_id FROM resolved JOIN predicates p USING (predicate) JOIN part_of ON src = subject_id AND dst = object_id WHERE is_location
  AND NOT EXISTS (SELECT 1 FROM kb_statements k WHERE k.entity = subject_id AND k.property = p.property AND rank <> 'deprecated')""", "claims", "kb_labels", "kb_edges", "kb_statements", "predicates")  # fmt: skip
def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim's predicate metadata, the first row by id."""
    first = view(spark, sf_dir, "predicates").groupBy("predicate").agg(F.min_by(F.struct("property", "routing_hint", "object_type"), "id").alias("it"))
    return view(spark, sf_dir, "all_claims").join(first, "predicate", "left").select("claim_id", "it.*")


QUERIES["C8_predicate_metadata"] = _metadata
SQL["C8_predicate_metadata"] = oracle("SELECT claim_id, property, routing_hint, object_type FROM all_claims LEFT JOIN (SELECT * FROM predicates QUALIFY row_number() OVER (PARTITION BY predicate ORDER BY id) = 1) USING (predicate)", "all_claims", "predicates")


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir).where("routing_hint = 'kb_quantitative'")
    return kb.quantity(asked, kb.known_amounts(view(spark, sf_dir, "kb_statements"), view(spark, sf_dir, "predicates").where("routing_hint = 'kb_quantitative'")))


QUERIES["F1_quantitative"] = _amounts
_NUM = QUANTITY
SQL["F1_quantitative"] = oracle(f"""WITH {RESOLVED}, known AS (SELECT entity, coalesce(arg_min({_NUM.format('value')}, stmt_id) FILTER (WHERE rank = 'preferred'), max({_NUM.format('value')})) AS known FROM kb_statements WHERE property = 'P2284' AND rank <> 'deprecated' GROUP BY entity),
  h AS (SELECT claim_id, polarity, known, CASE predicate WHEN 'priced_above' THEN known > t ELSE known < t END AS holds FROM (SELECT *, {QUANTITY.format('object')} AS t FROM resolved) LEFT JOIN known ON entity = subject_id WHERE predicate IN ('priced_above', 'priced_below'))
  SELECT claim_id, CASE WHEN holds = (polarity = 1) THEN 'verified' WHEN holds IS NOT NULL THEN 'contradicted' END AS verdict, known FROM h""", "claims", "kb_labels", "kb_statements")  # fmt: skip
QUERIES["F2_intervals"] = lambda s, d: kb.intervals(view(s, d, "kb_statements").where("value_type = 'entity'"))
_INTERVALS = """kept AS (SELECT * FROM kb_statements k WHERE value_type = 'entity' AND rank <> 'deprecated' AND (rank = 'preferred' OR NOT EXISTS (SELECT 1 FROM kb_statements p WHERE p.entity = k.entity AND p.property = k.property AND p.rank = 'preferred'))),
  spans AS (SELECT entity, property, min(start_q) AS start, CASE WHEN count(DISTINCT end_q) = 1 AND count(*) = count(end_q) THEN min(end_q) END AS "end", count(DISTINCT end_q) = 1 AND count(*) = count(end_q) AS end_known, count(*) = 1 AS unique_interval FROM kept GROUP BY entity, property HAVING count(DISTINCT start_q) <= 1)"""
SQL["F2_intervals"] = oracle(f"WITH {_INTERVALS} SELECT * FROM spans", "kb_statements")
QUERIES["E11_premise_value"] = lambda s, d: kb.premise_value(view(s, d, "kb_statements"))
SQL["E11_premise_value"] = oracle("""WITH v AS (SELECT *, CASE WHEN value_type = 'date' THEN substring(value, 1, 4) ELSE value END AS v FROM kb_statements WHERE rank <> 'deprecated')
  SELECT entity, property, coalesce(arg_min(v, stmt_id) FILTER (WHERE rank = 'preferred'), CASE WHEN count(DISTINCT v) = 1 THEN min(v) END) AS value FROM v GROUP BY entity, property""", "kb_statements")  # fmt: skip
QUERIES["L12_distinct_values"] = lambda s, d: view(s, d, "kb_statements").groupBy("entity", "property").agg(F.count_distinct(F.when(C("value_type") == "date", F.substring("value", 1, 4)).otherwise(C("value"))).alias("values"))
SQL["L12_distinct_values"] = oracle('SELECT entity, property, count(DISTINCT CASE WHEN value_type = \'date\' THEN substring(value, 1, 4) ELSE value END) AS "values" FROM kb_statements GROUP BY entity, property', "kb_statements")

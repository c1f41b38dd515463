"""Queries of names in their context and of the direction of mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators import directions, resolve
from factweave.plans.substrate import _COMPOSED, _FOUND, _NAME_VIEWS
from factweave.plans.views import NOW, oracle, view
from factweave.sources.scratch import settle

C = F.col
QUERIES, SQL = {}, {}


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "context_cache")
    return rows.select(resolve.signature().alias("signature"), "kb_id", F.lit(1).cast("long").alias("used"), "created_at", "retracted")


def _answered(spark: SparkSession, sf_dir: str, cache: DataFrame) -> DataFrame:
    asked = view(spark, sf_dir, "requests")
    redirects, labels, aliases, edges = (view(spark, sf_dir, n) for n in ("redirects", "kb_labels", "aliases", "kb_edges"))
    composed = settle(resolve.compose(asked, redirects, labels, aliases, edges), "composed")  # names that the cache lacks are told from it, and so are all others
    return resolve.in_context(asked, composed, cache, labels, aliases, edges)


def _in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each name stands for in its context, by normal form, cache or search."""
    return _answered(spark, sf_dir, _cache(spark, sf_dir)).select("request_id", "form", "kb_id", "via")


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after a batch of names, those without an entity included."""
    cache = _cache(spark, sf_dir)
    return resolve.written_through(cache, settle(_answered(spark, sf_dir, cache), "answered"), NOW)


_SIGNATURE = "sha256(" + " || ';' || ".join(f"coalesce(CAST(length({c}) AS VARCHAR) || ':' || {c}, '-')" for c in resolve.CONTEXT) + ")"
_ANSWERED = f"""WITH {_COMPOSED.replace("surfaces", "requests")}, asked_forms AS (SELECT *, {_SIGNATURE} AS signature FROM (SELECT r.request_id, r.expected_type, r.predicate, r.slot, r.party, coalesce(c.form, r.reference) AS form, c.kb_id AS normal
    FROM requests r LEFT JOIN composed c ON c.reference = r.reference AND c.expected_type IS NOT DISTINCT FROM r.expected_type AND NOT (r.reference = r.party OR starts_with(r.reference, 'event_') OR r.reference = ''))),
  held_rows AS (SELECT {_SIGNATURE} AS signature, kb_id, created_at, retracted FROM context_cache), held AS (SELECT signature, arg_min(kb_id, (created_at, kb_id)) AS cached FROM held_rows WHERE NOT retracted GROUP BY signature),
  form_found AS {_FOUND.format("form", "asked_forms")}, form_rated AS (SELECT f.query, a.expected_type, f.kb_id, f.place, EXISTS (SELECT 1 FROM kinds k WHERE k.kb_id = f.kb_id AND k.kind = a.expected_type) AS typed
    FROM form_found f JOIN (SELECT DISTINCT form, expected_type FROM asked_forms) a ON a.form = f.query), form_kept AS (SELECT * FROM form_rated QUALIFY typed OR NOT bool_or(typed) OVER (PARTITION BY query, expected_type)),
  form_best AS (SELECT query, expected_type, arg_min(kb_id, place) AS best, min(place) AS place FROM form_kept GROUP BY query, expected_type),
  answered AS (SELECT request_id, form, a.signature, CASE WHEN normal IS NOT NULL THEN normal WHEN cached IS NOT NULL THEN nullif(cached, '') WHEN 1.0 / place >= 0.6 THEN best END AS kb_id,
    CASE WHEN normal IS NOT NULL THEN 'normaliser' WHEN cached = '' THEN 'negative' WHEN cached IS NOT NULL THEN 'cache' WHEN 1.0 / place >= 0.6 THEN 'search' WHEN place IS NOT NULL THEN 'weak' ELSE 'nothing' END AS via
    FROM asked_forms a LEFT JOIN held h ON h.signature = a.signature LEFT JOIN form_best b ON b.query = form AND b.expected_type IS NOT DISTINCT FROM a.expected_type)"""
_CONTEXT_VIEWS = ("requests", "context_cache", *_NAME_VIEWS)
QUERIES |= {"C9_names_in_context": _in_context, "I1_write_through": _written}
SQL["C9_names_in_context"] = oracle(f"{_ANSWERED} SELECT request_id, form, kb_id, via FROM answered", *_CONTEXT_VIEWS)
SQL["I1_write_through"] = oracle(f"""{_ANSWERED}, live AS (SELECT DISTINCT signature FROM held_rows WHERE NOT retracted)
  SELECT signature, kb_id, 1 + CASE WHEN retracted OR row_number() OVER (PARTITION BY signature ORDER BY retracted, created_at, kb_id) > 1 THEN 0 ELSE (SELECT count(*) FROM answered a WHERE a.signature = r.signature AND via IN ('cache', 'negative')) END AS used, created_at, retracted FROM held_rows r
  UNION ALL SELECT signature, coalesce(arg_min(coalesce(kb_id, ''), request_id), ''), CASE WHEN arg_min(via, request_id) = 'normaliser' THEN 1 ELSE count(*) END, '{NOW}', false FROM answered WHERE via <> 'weak' AND signature NOT IN (SELECT signature FROM live) GROUP BY signature""", *_CONTEXT_VIEWS)  # fmt: skip


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings with the direction that examples tell, and what is left of their licence to contradict."""
    mappings, *told = (view(spark, sf_dir, n) for n in ("mappings", "direction_statements", "entity_kinds", "role_constraints"))
    return directions.validated(mappings, *told).select("id", "status", "reason", "subject_slot", "object_slot", "single_valued")


_MEETS = "CASE WHEN {e}s AND NOT {v}s AND NOT {e}o THEN 'standard' WHEN {v}s AND NOT {e}s AND NOT {v}o THEN 'inverse' WHEN NOT {e}s AND NOT {v}s AND {v}o AND NOT {e}o THEN 'standard' END"
QUERIES["I9_validated_mappings"] = _validated
SQL["I9_validated_mappings"] = oracle(f"""WITH ex AS (SELECT DISTINCT property, entity, value FROM direction_statements QUALIFY dense_rank() OVER (PARTITION BY property ORDER BY entity, value) <= 10), ok AS (SELECT * FROM direction_statements WHERE rank <> 'deprecated'),
  pr AS (SELECT property, count(*) FILTER (WHERE fwd) AS n, count(*) FILTER (WHERE fwd AND back) AS b FROM (SELECT property, EXISTS (SELECT 1 FROM ok WHERE ok.property = ex.property AND ok.entity = ex.entity AND ok.value = ex.value) AS fwd,
    EXISTS (SELECT 1 FROM ok WHERE ok.property = ex.property AND ok.entity = ex.value AND ok.value = ex.entity) AS back FROM ex) GROUP BY property),
  cl AS (SELECT DISTINCT property, subject_type AS s, object_type AS o FROM mappings),
  seen AS (SELECT cl.property, s, o, {_MEETS.format(e="e", v="v")} AS way FROM (SELECT cl.*, coalesce(list_contains(ek, s), false) AS es, coalesce(list_contains(vk, s), false) AS vs, coalesce(list_contains(ek, o), false) AS eo, coalesce(list_contains(vk, o), false) AS vo
    FROM cl JOIN ex ON ex.property = cl.property JOIN (SELECT entity AS x, list(kind) AS ek FROM entity_kinds GROUP BY 1) ON x = ex.entity JOIN (SELECT entity AS y, list(kind) AS vk FROM entity_kinds GROUP BY 1) ON y = ex.value) cl),
  agreed AS (SELECT property, s, o, CASE WHEN count(DISTINCT way) = 1 THEN min(way) END AS way, count(way) AS n FROM seen GROUP BY ALL),
  ruled AS (SELECT property, s, o, {_MEETS.format(e="e", v="v")} AS way FROM (SELECT cl.*, coalesce(list_contains(ek, s), false) AS es, coalesce(list_contains(vk, s), false) AS vs, coalesce(list_contains(ek, o), false) AS eo, coalesce(list_contains(vk, o), false) AS vo
    FROM cl JOIN (SELECT property AS p, list(kind) FILTER (WHERE role = 'subject') AS ek, list(kind) FILTER (WHERE role = 'value') AS vk FROM role_constraints GROUP BY 1) ON p = property WHERE len(ek) > 0 AND len(vk) > 0)),
  m AS (SELECT m.*, pr.n, pr.b, CASE WHEN coalesce(a.n, 0) > 0 THEN a.way ELSE r.way END AS way, CASE WHEN subject_slot = 'subject' AND object_slot = 'statement_value' THEN 'standard' WHEN subject_slot = 'statement_value' AND object_slot = 'subject' THEN 'inverse' END AS given
    FROM mappings m LEFT JOIN pr ON pr.property = m.property LEFT JOIN agreed a ON a.property = m.property AND a.s IS NOT DISTINCT FROM subject_type AND a.o IS NOT DISTINCT FROM object_type
      LEFT JOIN ruled r ON r.property = m.property AND r.s IS NOT DISTINCT FROM subject_type AND r.o IS NOT DISTINCT FROM object_type),
  w AS (SELECT *, CASE WHEN given IS NULL THEN 'no_direction' WHEN n IS NULL THEN 'no_example' WHEN n = 0 THEN 'nothing_grounds' WHEN n = b THEN 'both_ways_ground' WHEN way IS NULL THEN 'no_telling_slots' WHEN way = given THEN 'examples_agree' ELSE 'examples_disagree' END AS reason FROM m)
  SELECT id, CASE reason WHEN 'nothing_grounds' THEN 'suspect' WHEN 'both_ways_ground' THEN 'symmetric' WHEN 'examples_agree' THEN 'confirmed' WHEN 'examples_disagree' THEN 'corrected' ELSE 'unconfirmed' END AS status, reason,
    CASE WHEN reason = 'examples_disagree' THEN object_slot ELSE subject_slot END AS subject_slot, CASE WHEN reason = 'examples_disagree' THEN subject_slot ELSE object_slot END AS object_slot, single_valued AND reason = 'examples_agree' AS single_valued FROM w""", "mappings", "direction_statements", "entity_kinds", "role_constraints")  # fmt: skip

"""Queries of the extraction layer: claim text and dates as projections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import dates, registered, text
from factweave.plans.views import NOW, oracle, view

C = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _projection(name: str, source: str, columns: Callable[[], dict[str, Column]], sql: str, where: Callable[[], Column] | None = None, sql_where: str = "") -> None:
    """A query that keeps the key and adds columns (made when it runs); sql has their expressions."""
    key = {"raw_claims": "claim_id", "claims": "claim_id", "kb_statements": "stmt_id"}[source]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = view(spark, sf_dir, source)
        return (rows if where is None else rows.where(where())).select(key, *(c.alias(n) for n, c in columns().items()))

    QUERIES[name] = run
    SQL[name] = oracle(f"SELECT {key}, {sql} FROM {source} {sql_where}", source)


_STRIP = r"trim({0}, ' ' || chr(9) || chr(10) || chr(13))"
_NORM = rf"""coalesce(nullif(trim(regexp_replace(regexp_replace({_STRIP.format("regexp_replace(regexp_replace(CASE WHEN regexp_matches(p, '^(is|was|were|has|have|had|will|would|does|did)\\s+.*\\S') THEN regexp_replace(p, '^(is|was|were|has|have|had|will|would|does|did)\\s+', '') ELSE p END, '\\s+(the|a|an)$', ''), '[^0-9A-Za-z_\\s]', '_', 'g')")}, '\s+', '_', 'g'), '_+', '_', 'g'), '_'), ''), 'unknown_predicate')"""

_FIRST = r"coalesce(regexp_matches(trim(subject), '(?i)^(i|me|my|mine|myself|we|us|our|ours|ourselves)$'), false)"


def filled(name: str) -> Column:
    return F.coalesce(C(name), F.lit(""))



QUERIES["B3_normalize_predicate"] = lambda spark, d: view(spark, d, "raw_claims").select("claim_id", text.normalize_predicate(C("predicate")).alias("predicate"))
SQL["B3_normalize_predicate"] = oracle(f"SELECT claim_id, {_NORM} AS predicate FROM (SELECT claim_id, replace({_STRIP.format('lower(predicate)')}, '_', ' ') AS p FROM raw_claims)", "raw_claims")
_projection("B4_first_person", "raw_claims", lambda: {"subject": text.canonical_subject(C("subject"), C("party")), "first_person": text.is_first_person(C("subject"))},
            f"CASE WHEN {_FIRST} THEN party ELSE subject END AS subject, {_FIRST} AS first_person")
_GROUND = f"(starts_with(s, 'event_') OR {_FIRST.replace('subject', 's')} OR contains(lower(t), lower(s)) OR contains(lower(t), lower(o)))"
_FILLED = "SELECT claim_id, coalesce(subject, '') AS s, coalesce(predicate, '') AS p, coalesce(object, '') AS o, coalesce(source_text, '') AS t, party, polarity FROM raw_claims"
QUERIES["B5_hard_claim_check"] = lambda spark, d: view(spark, d, "raw_claims").select(
    "claim_id", (F.startswith(filled("subject"), F.lit("event_")) | text.is_first_person(filled("subject")) | text.contains_text(filled("source_text"), filled("subject")) | text.contains_text(filled("source_text"), filled("object"))).alias("passes"))
SQL["B5_hard_claim_check"] = oracle(f"SELECT claim_id, {_GROUND} AS passes FROM ({_FILLED})", "raw_claims")
QUERIES["B6_abstention_reason"] = lambda spark, d: view(spark, d, "raw_claims").select("claim_id", text.abstention(filled("subject"), filled("predicate"), filled("object"), filled("source_text"), F.lit(True)).alias("reason"))
SQL["B6_abstention_reason"] = oracle(f"""SELECT claim_id, CASE WHEN trim(s) = '' OR NOT {_GROUND} THEN 'subject_absent_from_source' WHEN trim(lower(s)) = trim(lower(o)) THEN 'self_referential'
    WHEN trim(lower(p)) = trim(lower(o)) AND trim(o) <> '' THEN 'predicate_eq_object' END AS reason FROM ({_FILLED})""", "raw_claims")  # fmt: skip
_projection("B7_residence_rewrite", "raw_claims", lambda: {"predicate": text.residence(C("predicate"), C("source_text"))},
            r"CASE WHEN predicate = 'located_in' AND regexp_matches(source_text, '(?i)\b(lives?|lived|resides?|residing)\s+in\b') THEN 'lives_in' ELSE predicate END AS predicate")
_projection("B8_null_coercion", "raw_claims", lambda: {"subject": filled("subject"), "object": filled("object"), "polarity": F.coalesce(C("polarity"), F.lit(1))},
            "coalesce(subject, '') AS subject, coalesce(object, '') AS object, coalesce(polarity, 1) AS polarity")
_scope = lambda: text.temporal_scope(C("verb_tense"), C("valid_from"), C("valid_until"), C("valid_during_ref"))
_projection("B9_temporal_scope", "raw_claims", lambda: {"valid_from": _scope()["valid_from"], "valid_until": _scope()["valid_until"]},
            """CASE WHEN valid_from IS NOT NULL OR valid_until IS NOT NULL THEN valid_from END AS valid_from,
            CASE WHEN valid_from IS NOT NULL OR valid_until IS NOT NULL THEN valid_until WHEN valid_during_ref IS NOT NULL THEN NULL WHEN verb_tense = 'past' THEN 'before_present' END AS valid_until""",
            lambda: ~_scope()["future"], "WHERE verb_tense <> 'future'")
_scoped = lambda: C("valid_from").isNotNull() | C("valid_until").isNotNull() | C("valid_during_ref").isNotNull()
_lists = ", ".join(f"'{p}'" for p in (*text.ALWAYS, *text.COMPARATIVE, *text.TEMPORAL))
_projection("B10_triage", "raw_claims", lambda: {"triage": text.triage(filled("predicate"), filled("subject"), filled("object"), _scoped())},
            rf"""CASE WHEN coalesce(predicate, '') IN ({_lists}) OR regexp_matches(coalesce(object, ''), '\b[0-9]+[,.]?[0-9]*\b') OR regexp_matches(coalesce(subject, ''), '\b[A-Z][a-zA-Z]')
            OR regexp_matches(coalesce(object, ''), '\b[A-Z][a-zA-Z]') OR valid_from IS NOT NULL OR valid_until IS NOT NULL OR valid_during_ref IS NOT NULL THEN 'verify' ELSE 'inert_prose' END AS triage""")  # fmt: skip
_projection("B11_strip_article", "raw_claims", lambda: {"subject": text.strip_article(C("subject"))}, r"coalesce(nullif(regexp_replace(subject, '(?i)^(the|a|an)\s+', ''), ''), subject) AS subject")
_projection("B12_slot_normalisation", "raw_claims", lambda: {"subject": text.normalize_slot(C("subject"), C("party"))},
            r"CASE WHEN trim(subject) = '' OR subject = party OR starts_with(subject, 'event_') THEN subject ELSE coalesce(nullif(regexp_replace(subject, '(?i)^(the|a|an)\s+', ''), ''), subject) END AS subject")
QUERIES["B13_source_grounding"] = lambda spark, d: view(spark, d, "raw_claims").select("claim_id", text.source_grounded(filled("subject"), filled("object"), filled("source_text"), C("party")).alias("grounded"))
SQL["B13_source_grounding"] = oracle(f"SELECT claim_id, trim(t) <> '' AND (s = party OR contains(lower(t), lower(s))) AND (o = '' OR contains(lower(t), lower(o))) AS grounded FROM ({_FILLED})", "raw_claims")
_projection("B14_vague_class", "raw_claims", lambda: {"vague": text.is_vague(C("object"))},
            "coalesce(regexp_matches(trim(lower(object)), '^(a|an|some|any) ') OR regexp_matches(trim(lower(object)), ' (that|which|where|whose|who) '), false) AS vague")
_CUTS = "|".join(text.CUTS)
QUERIES["B15_vague_class_head"] = lambda spark, d: view(spark, d, "raw_claims").select("claim_id", text.vague_head(C("object")).alias("head"))
SQL["B15_vague_class_head"] = oracle(f"""SELECT claim_id, nullif(trim(CASE WHEN regexp_matches(h, '(?i) ({_CUTS}) ') THEN regexp_extract(h, '(?i)^(.*?) (?:{_CUTS}) ', 1) ELSE h END), '') AS head
    FROM (SELECT claim_id, trim(regexp_extract(trim(object), '(?i)^(?:an|a|some|any) +(.*)$', 1)) AS h FROM raw_claims)""", "raw_claims")  # fmt: skip
_projection("B19_id_shapes", "kb_statements", lambda: {"entity_id": C("value").rlike("^[A-Z]+[0-9]+$"), "property_id": C("property").rlike("^P[0-9]+$")},
            "regexp_matches(value, '^[A-Z]+[0-9]+$') AS entity_id, regexp_matches(property, '^P[0-9]+$') AS property_id")

_UNIT = r"CASE lower(regexp_extract({0}, '(?i)([-+]?[0-9][0-9,]*\.?[0-9]*)\s*(WORDS)?', 2)) WHEN '' THEN 1.0 WHEN 'hundred' THEN 1e2 WHEN 'thousand' THEN 1e3 WHEN 'k' THEN 1e3 WHEN 'million' THEN 1e6 WHEN 'm' THEN 1e6 ELSE 1e9 END".replace("WORDS", "|".join(text.MULTIPLIERS))
QUANTITY = r"try_cast(replace(regexp_extract({0}, '(?i)([-+]?[0-9][0-9,]*\.?[0-9]*)\s*(WORDS)?', 1), ',', '') AS DOUBLE) * ".replace("WORDS", "|".join(text.MULTIPLIERS)) + _UNIT
STRICT = r"CASE WHEN regexp_full_match(trim({0}), '(?i)[-+]?([0-9]{{1,3}}(,[0-9]{{3}})+|[0-9]+)(\.[0-9]+)?\s*(WORDS)?') THEN ".replace("WORDS", "|".join(text.MULTIPLIERS)) + QUANTITY + " END"
_projection("E1_loose_quantity", "raw_claims", lambda: {"quantity": text.parse_quantity(C("object"))}, QUANTITY.format("object") + " AS quantity")
_projection("E2_strict_number", "claims", lambda: {"number": text.strict_number(C("object"))}, STRICT.format("object") + " AS number")
_projection("E3_strict_year", "claims", lambda: {"year": text.strict_year(C("object"))}, "CASE WHEN regexp_full_match(trim(object), '[-+]?[0-9]{1,4}') THEN try_cast(replace(trim(object), '+', '') AS INT) END AS year")
#: Computable claims made of keys: compared numbers, years, powers and counted strings.
_SUMS = """SELECT p_partkey AS claim_id,
  CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN CAST(1900 + p_size AS STRING) WHEN 2 THEN CAST(p_size % 9 AS STRING) WHEN 3 THEN 'the word ' || p_name ELSE p_name END AS subject,
  CASE p_partkey % 6 WHEN 0 THEN CASE p_size % 5 WHEN 0 THEN 'is_at_least' WHEN 1 THEN 'Less_Than' WHEN 2 THEN 'not_equal_to' WHEN 3 THEN 'equals' ELSE 'plus_30_equals' END
    WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'before' ELSE 'happened_after' END WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 'squared' ELSE 'cubed_is' END
    WHEN 3 THEN 'vowel_count' WHEN 4 THEN CASE p_size % 3 WHEN 0 THEN 'number_of_letters' WHEN 1 THEN 'word_count' ELSE 'count_consonants' END ELSE 'count_character' END AS predicate,
  CASE p_partkey % 6 WHEN 0 THEN '25' WHEN 1 THEN '1920' WHEN 2 THEN CAST((p_size % 9) * (p_size % 9) AS STRING) WHEN 3 THEN '3 vowels' WHEN 4 THEN CAST(2 + p_size % 9 AS STRING) ELSE 'ten' END AS object,
  CAST(p_size % 4 <> 0 AS INT) AS polarity FROM {part}"""


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SUMS, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def _sql_case(pairs: list[tuple[str, str | None]], probe: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({probe}, '{t}') THEN {'NULL' if v is None else repr(v)}" for t, v in pairs) + " END"


_COMPARATOR = _sql_case([*((t, None) for t in text.ARITHMETIC), *text.COMPARATORS], "lower(predicate)")
_YEARS = _sql_case([("before", "lt"), ("earlier_than", "lt"), ("older_than", "lt"), ("after", "gt"), ("later_than", "gt"), ("younger_than", "gt")], "lower(predicate)")
QUERIES["E4_comparator"] = lambda spark, d: _sums(spark, d).select("claim_id", text.comparator(C("predicate")).alias("comparator"), text.year_comparator(C("predicate")).alias("year_comparator"))
SQL["E4_comparator"] = f"SELECT claim_id, {_COMPARATOR} AS comparator, {_YEARS} AS year_comparator FROM ({_SUMS.format(part='part')})"
_target = lambda: text.count_target(C("subject"))
QUERIES["E8_string_counts"] = lambda spark, d: _sums(spark, d).select("claim_id", text.count_measure(C("predicate")).alias("measure"), _target().alias("target"),
    F.array_join(text.acceptable_counts(text.count_measure(C("predicate")), _target()), ",").alias("counts"))
_MEASURE = "CASE predicate WHEN 'vowel_count' THEN 'vowel' WHEN 'number_of_letters' THEN 'letter' WHEN 'word_count' THEN 'word' WHEN 'count_consonants' THEN 'consonant' WHEN 'count_character' THEN 'character' END"
_TARGET = r"trim(trim(CASE WHEN regexp_matches(subject, '(?i)^the\s+word\s+.') THEN regexp_extract(subject, '(?i)^the\s+word\s+(.*)$', 1) ELSE subject END), '''""“”‘’')"
_COUNTS = r"""CASE m WHEN 'vowel' THEN length(regexp_replace(lower(t), '[^aeiou]', '', 'g')) || ',' || length(regexp_replace(lower(t), '[^aeiouy]', '', 'g'))
  WHEN 'consonant' THEN length(regexp_replace(lower(t), '[^\p{L}]|[aeiou]', '', 'g')) || ',' || length(regexp_replace(lower(t), '[^\p{L}]|[aeiouy]', '', 'g'))
  WHEN 'letter' THEN CAST(length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS VARCHAR) WHEN 'character' THEN length(t) || ',' || length(regexp_replace(t, '\s', '', 'g'))
  WHEN 'word' THEN CAST(len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) AS VARCHAR) END"""
_COUNTED = f"SELECT *, {_COUNTS} AS counts FROM (SELECT *, {_MEASURE} AS m, {_TARGET} AS t FROM ({_SUMS.format(part='part')}))"
SQL["E8_string_counts"] = f"SELECT claim_id, m AS measure, t AS target, counts FROM ({_COUNTED})"
QUERIES["E10_computed_verdict"] = lambda spark, d: text.with_computed_verdict(_sums(spark, d), "verdict").select("claim_id", "verdict")
_A, _B = STRICT.format("subject"), STRICT.format("object")
_YA, _YB = (f"CASE WHEN regexp_full_match(trim({c}), '[-+]?[0-9]{{1,4}}') THEN try_cast(replace(trim({c}), '+', '') AS INT) END" for c in ("subject", "object"))
SQL["E10_computed_verdict"] = f"""WITH c AS ({_COUNTED}), n AS (SELECT claim_id, polarity, m, counts, t, object, lower(predicate) AS p, {_COMPARATOR} AS k, {_YEARS} AS y, {_A} AS a, {_B} AS b, {_YA} AS ya, {_YB} AS yb FROM c),
  h AS (SELECT claim_id, polarity, coalesce(CASE k WHEN 'gt' THEN a > b WHEN 'lt' THEN a < b WHEN 'ge' THEN a >= b WHEN 'le' THEN a <= b WHEN 'eq' THEN a = b END,
    CASE y WHEN 'lt' THEN ya < yb WHEN 'gt' THEN ya > yb END, CASE WHEN contains(p, 'squared') THEN a * a = b WHEN contains(p, 'cubed') THEN a * a * a = b END,
    CASE WHEN t <> '' AND m IS NOT NULL AND regexp_extract(object, '^\\s*([0-9]+)', 1) <> '' THEN list_contains(string_split(counts, ','), regexp_extract(object, '^\\s*([0-9]+)', 1)) END) AS holds FROM n)
  SELECT claim_id, CASE WHEN holds = (polarity = 1) THEN 'verified' WHEN holds IS NOT NULL THEN 'contradicted' END AS verdict FROM h"""

# ---- dates ----
_YMD = {"y": 1, "m": 3, "d": 5}


def _part(c: str, which: str) -> str:
    """A part of a date of the ISO forms, which are all that the stored claims and statements hold."""
    return rf"try_cast(nullif(regexp_extract(trim({c}), '^\+?(-?[0-9]{{4}})(-([0-9]{{2}}))?(-([0-9]{{2}}))?$', {_YMD[which]}), '') AS INT)"


def _precision(c: str) -> str:
    return f"CASE WHEN {_part(c, 'd')} IS NOT NULL THEN 3 WHEN {_part(c, 'm')} IS NOT NULL THEN 2 WHEN {_part(c, 'y')} IS NOT NULL THEN 1 END"




def _date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = view(spark, sf_dir, "dated_texts").withColumn("told", dates.parts(C("text")))
    return told.select("id", C("told.y").alias("year"), C("told.m").alias("month"), C("told.d").alias("day"), dates.sort_key(C("told")).alias("sort_key"))


QUERIES["D2_date_parts"] = _date_parts
SQL["D2_date_parts"] = oracle(r"""WITH low AS (SELECT id, lower(regexp_replace(trim(text), '^\+', '')) AS t FROM dated_texts), era AS (SELECT id, regexp_matches(t, ' *b\.?c\.?(e\.?)?$') OR t LIKE '-%' AS early, regexp_replace(t, ' *(b\.?c\.?(e\.?)?|a\.?d\.?|c\.?e\.?)$', '') AS t FROM low),
  iso AS (SELECT id, early, regexp_extract(t, '^-?([0-9]{4})(?:-([0-9]{2})(?:-([0-9]{2}))?)?(?:[t ][0-9].*)?$', ['y', 'm', 'd']) AS p FROM era),
  named AS (SELECT id, early, regexp_extract(t, '^([a-z]+)\.?(?: +([0-9]{1,2})(?:st|nd|rd|th)?)?,? +([0-9]{4})$', ['m', 'd', 'y']) AS p FROM era),
  other AS (SELECT id, early, regexp_extract(t, '^([0-9]{1,2})(?:st|nd|rd|th)? +(?:of +)?([a-z]+)\.?,? +([0-9]{4})$', ['d', 'm', 'y']) AS p FROM era),
  names AS (SELECT m, unnest([long, CASE WHEN m = 9 THEN 'sept' ELSE substr(long, 1, 3) END, substr(long, 1, 3)]) AS name FROM (SELECT unnest(range(1, 13)) AS m, unnest(['january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december']) AS long)),
  found AS (SELECT id, early, try_cast(p.y AS INT) AS y, try_cast(nullif(p.m, '') AS INT) AS m, try_cast(nullif(p.d, '') AS INT) AS d FROM iso WHERE p.y <> ''
    UNION ALL SELECT id, early, try_cast(p.y AS INT), n.m, try_cast(nullif(p.d, '') AS INT) FROM (SELECT * FROM named UNION ALL BY NAME SELECT * FROM other) JOIN (SELECT DISTINCT * FROM names) n ON n.name = p.m WHERE p.y <> ''),
  told AS (SELECT id, CASE WHEN early THEN -y ELSE y END AS y, CAST(m AS INT) AS m, d FROM found WHERE coalesce(m BETWEEN 1 AND 12, true) AND coalesce(d BETWEEN 1 AND 31, true))
  SELECT t.id, y AS year, m AS month, d AS day, (y * 12 + coalesce(m, 1) - 1) * 31 + coalesce(d, 1) - 1 AS sort_key FROM dated_texts t LEFT JOIN told USING (id)""", "dated_texts")  # fmt: skip
_projection("D3_date_precision", "claims", lambda: {"precision": dates.precision(C("object"))}, f"{_precision('object')} AS precision")
_projection("D11_approximate_year", "raw_claims", lambda: {"year": dates.approximate_year(C("object"))},
            r"nullif(regexp_extract(trim(object), '(?i)^(?:(?:approximately|approx\.?|circa|about|around|ca\.?|c\.?|~)\s+|~\s*)([0-9]{4})$', 1), '') AS year")
_projection("D12_year_of_value", "kb_statements", lambda: {"year": dates.year(C("value"))}, f"{_part('value', 'y')} AS year")


def date_relation_sql(claimed: str, known: str) -> str:
    kp = f"CASE WHEN {_part(known, 'd')} = 1 AND {_part(known, 'm')} = 1 THEN 1 WHEN {_part(known, 'd')} = 1 THEN 2 ELSE {_precision(known)} END"
    cp = _precision(claimed)
    return f"""CASE WHEN {cp} IS NULL OR {kp} IS NULL THEN NULL WHEN {_part(claimed, 'y')} <> {_part(known, 'y')} THEN 'mismatch' WHEN {cp} > {kp} THEN NULL
      WHEN {cp} >= 2 AND ({_part(claimed, 'm')} <> {_part(known, 'm')} OR ({cp} = 3 AND {_part(claimed, 'd')} <> {_part(known, 'd')})) THEN NULL ELSE 'match' END"""


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = view(spark, sf_dir, "claims").where("predicate = 'ordered_on'")
    known = view(spark, sf_dir, "kb_statements").where("property = 'P585' AND rank <> 'deprecated'")
    return claims.join(known, C("subject") == C("entity"))


_DATED = "FROM claims JOIN kb_statements ON subject = entity AND property = 'P585' AND rank <> 'deprecated' WHERE predicate = 'ordered_on'"
QUERIES["D4_date_relation"] = lambda spark, d: _dated(spark, d).select("claim_id", dates.relation(C("object"), C("value")).alias("relation"))
SQL["D4_date_relation"] = oracle(f"SELECT claim_id, {date_relation_sql('object', 'value')} AS relation {_DATED}", "claims", "kb_statements")
_now = lambda: F.to_date(F.lit(NOW[:10]))


def earliest_sql(c: str) -> str:
    return f"make_date({_part(c, 'y')}, coalesce({_part(c, 'm')}, 1), coalesce({_part(c, 'd')}, 1))"


def latest_sql(c: str) -> str:
    return f"CASE WHEN {_part(c, 'd')} IS NOT NULL THEN {earliest_sql(c)} ELSE last_day(make_date({_part(c, 'y')}, coalesce({_part(c, 'm')}, 12), 1)) END"


_projection("D5_date_bounds", "kb_statements", lambda: {"earliest": dates.earliest(C("start_q")).cast("string"), "latest": dates.latest(C("end_q")).cast("string")},
            f"CAST({earliest_sql('start_q')} AS VARCHAR) AS earliest, CAST({latest_sql('end_q')} AS VARCHAR) AS latest", lambda: C("start_q").isNotNull(), "WHERE start_q IS NOT NULL")
_now_then = lambda: F.to_date(F.lit("2012-06-01"))
_projection("D6_provable_bounds", "kb_statements", lambda: {"past": dates.provably_past(C("end_q"), _now_then()), "future": dates.provably_future(C("start_q"), _now_then())},
            f"coalesce({latest_sql('end_q')} < DATE '2012-06-01', false) AS past, coalesce({earliest_sql('start_q')} > DATE '2012-06-01', false) AS future")
_projection("D7_present_unscoped", "claims", lambda: {"unscoped": dates.present_unscoped(C("valid_from"), C("valid_until")), "reaches_present": C("valid_until").isNull()},
            "valid_from IS NULL AND valid_until IS NULL AS unscoped, valid_until IS NULL AS reaches_present")


def compatible_sql(start: str, end: str, frm: str, until: str) -> str:
    now = f"DATE '{NOW[:10]}'"
    return f"""(({start} IS NULL AND {end} IS NULL) OR NOT (({until} IS NULL AND {frm} IS NULL AND coalesce({latest_sql(end)} < {now}, false)) OR coalesce({earliest_sql(start)} > {now}, false)
      OR coalesce({frm} < {start}, false) OR coalesce({until} <> 'before_present' AND {until} > {end}, false)))"""


def _scoped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, known = view(spark, sf_dir, "claims"), view(spark, sf_dir, "kb_statements")
    return claims.join(view(spark, sf_dir, "kb_labels"), C("label") == C("subject")).join(known, C("entity") == C("kb_id"))


QUERIES["D8_scope_compatibility"] = lambda spark, d: _scoped_pairs(spark, d).select("claim_id", "stmt_id", dates.compatible(C("start_q"), C("end_q"), C("valid_from"), C("valid_until"), _now()).alias("compatible"))
SQL["D8_scope_compatibility"] = oracle(f"""SELECT claim_id, stmt_id, {compatible_sql('start_q', 'end_q', 'valid_from', 'valid_until')} AS compatible
    FROM claims JOIN kb_labels ON label = subject JOIN kb_statements ON entity = kb_id""", "claims", "kb_labels", "kb_statements")  # fmt: skip

# ---- decomposition ----
_words = lambda: F.filter(F.split(C("text"), r"[ \n]+"), lambda w: w != "")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns read as events: the first two words took part, the role is the type; the third word is the target of odd turns."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("w", _words())
    key = F.concat(F.lit("event_"), F.substring(F.sha2(F.concat_ws("/", "conv_id", "turn"), 256), 1, 8))
    parts = F.transform(F.slice("w", 1, 2), lambda p: F.struct(F.lit("has_participant").alias("predicate"), p.alias("object")))
    kind = F.array(F.struct(F.lit("event_type").alias("predicate"), C("role").alias("object")))
    target = F.when((C("turn") % 2 == 1) & (F.size("w") >= 3), F.array(F.struct(F.lit("target").alias("predicate"), F.get("w", F.lit(2)).alias("object")))).otherwise(
        F.array().cast("array<struct<predicate:string,object:string>>"))
    return turns.select("conv_id", "turn", key.alias("subject"), F.posexplode(F.concat(parts, kind, target)).alias("place", "claim")).select("conv_id", "turn", "subject", "place", "claim.predicate", "claim.object")


QUERIES["B2_event_decomposition"] = _events
SQL["B2_event_decomposition"] = r"""WITH t AS (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '') AS w,
    'event_' || substring(sha256(conv_id || '/' || turn), 1, 8) AS subject FROM conversations),
  p AS (SELECT conv_id, turn, subject, list_concat(list_transform(w[1:2], lambda x: {'predicate': 'has_participant', 'object': x}), [{'predicate': 'event_type', 'object': role}],
    CASE WHEN turn % 2 = 1 AND len(w) >= 3 THEN [{'predicate': 'target', 'object': w[3]}] ELSE [] END) AS c FROM t),
  u AS (SELECT conv_id, turn, subject, unnest(range(len(c))) AS place, unnest(c) AS x FROM p)
  SELECT conv_id, turn, subject, place, x.predicate AS predicate, x.object AS object FROM u"""


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw claims and the claims that events are taken apart into, as claims that can be checked or say why not."""
    none = F.lit(None).cast("string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text", "role")
    key = (C("conv_id") * 100000 + C("turn") * 100 + C("place") + 10**12).cast("long")
    events = _events(spark, sf_dir).join(turns, ["conv_id", "turn"]).select(key.alias("claim_id"), C("role").alias("party"), "subject", "predicate", "object", F.lit(1).alias("polarity"), F.lit("present").alias("verb_tense"),
        none.alias("valid_from"), none.alias("valid_until"), none.alias("valid_during_ref"), C("text").alias("source_text"))
    return text.extract(view(spark, sf_dir, "raw_claims").select(*events.columns).unionByName(events))


_ARTICLE = lambda c: rf"CASE WHEN trim({c}) = '' OR {c} = party OR starts_with({c}, 'event_') THEN {c} ELSE coalesce(nullif(regexp_replace({c}, '(?i)^(the|a|an)\s+', ''), ''), {c}) END"
QUERIES["B1_extract"] = _extracted
SQL["B1_extract"] = oracle(rf"""WITH events AS ({SQL["B2_event_decomposition"]}),
  raw AS (SELECT claim_id, party, subject, predicate, object, polarity, verb_tense, valid_from, valid_until, valid_during_ref, source_text FROM raw_claims
    UNION ALL SELECT CAST(e.conv_id * 100000 + e.turn * 100 + place + 1000000000000 AS BIGINT), role, e.subject, e.predicate, e.object, 1, 'present', NULL, NULL, NULL, c.text FROM events e JOIN conversations c ON c.conv_id = e.conv_id AND c.turn = e.turn),
  f AS (SELECT claim_id, party, coalesce(subject, '') AS s, coalesce(predicate, '') AS raw_p, coalesce(object, '') AS o, coalesce(source_text, '') AS t, coalesce(polarity, 1) AS polarity, valid_from IS NOT NULL OR valid_until IS NOT NULL AS dated, valid_from, valid_until, valid_during_ref, verb_tense,
    replace({_STRIP.format("lower(coalesce(predicate, ''))")}, '_', ' ') AS p FROM raw WHERE verb_tense <> 'future'),
  n AS (SELECT *, {_NORM} AS pred, CASE WHEN {_FIRST.replace('subject', 's')} THEN party ELSE s END AS subj, CASE WHEN trim(s) = '' OR NOT {_GROUND} THEN 'subject_absent_from_source' WHEN trim(lower(s)) = trim(lower(o)) THEN 'self_referential'
      WHEN trim(lower(raw_p)) = trim(lower(o)) AND trim(o) <> '' THEN 'predicate_eq_object' END AS reason, CASE WHEN dated THEN valid_from END AS vf, CASE WHEN dated THEN valid_until WHEN valid_during_ref IS NOT NULL THEN NULL WHEN verb_tense = 'past' THEN 'before_present' END AS vu FROM f),
  m AS (SELECT claim_id, party, polarity, reason, vf, vu, valid_during_ref, {_ARTICLE("subj")} AS subject, {_ARTICLE("o")} AS object, CASE WHEN pred = 'located_in' AND regexp_matches(t, '(?i)\b(lives?|lived|resides?|residing)\s+in\b') THEN 'lives_in' ELSE pred END AS predicate FROM n),
  x AS (SELECT *, CASE WHEN predicate IN ({_lists}) OR regexp_matches(object, '\b[0-9]+[,.]?[0-9]*\b') OR regexp_matches(subject, '\b[A-Z][a-zA-Z]') OR regexp_matches(object, '\b[A-Z][a-zA-Z]') OR vf IS NOT NULL OR vu IS NOT NULL OR valid_during_ref IS NOT NULL THEN 'verify' ELSE 'inert_prose' END AS triage FROM m)
  SELECT claim_id, party, subject, predicate, object, polarity, vf AS valid_from, vu AS valid_until, triage, coalesce(reason, CASE WHEN triage = 'inert_prose' THEN 'not_checkworthy' END) AS abstention_reason FROM x""", "raw_claims")  # fmt: skip


# ---- functions of SQL ----
def _by_function(name: str, table: str, columns: str) -> None:
    """A query that calls a registered function in SQL, and what it is in the other engine."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        registered.register(spark)
        return spark.sql(f"SELECT {columns} FROM {{rows}}", rows=view(spark, sf_dir, table))

    QUERIES[name] = run


_by_function("O_base_verdict", "verdicts", "claim_id, base_verdict(verdict) AS verdict")
_by_function("O_apply_polarity", "verdicts", "claim_id, apply_polarity(base_verdict(verdict), CAST(depth % 2 AS INT)) AS verdict")
_by_function("O_parse_quantity", "raw_claims", "claim_id, parse_quantity(object) AS amount")
_by_function("O_normalize_predicate", "raw_claims", "claim_id, normalize_predicate(predicate) AS predicate")
SQL["O_base_verdict"] = oracle("SELECT claim_id, regexp_replace(verdict, '_given_assertion$', '') AS verdict FROM verdicts", "verdicts")
SQL["O_apply_polarity"] = oracle("""SELECT claim_id, CASE WHEN depth % 2 = 1 THEN v WHEN v = 'verified' THEN 'contradicted' WHEN v = 'contradicted' THEN 'verified' ELSE v END AS verdict
  FROM (SELECT *, regexp_replace(verdict, '_given_assertion$', '') AS v FROM verdicts)""", "verdicts")  # fmt: skip
SQL["O_parse_quantity"] = oracle(f"SELECT claim_id, {QUANTITY.format('object')} AS amount FROM raw_claims", "raw_claims")
SQL["O_normalize_predicate"] = SQL["B3_normalize_predicate"]

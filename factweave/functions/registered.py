"""Functions for SQL. Their bodies are SQL, so Catalyst puts them into the plan as expressions; no function is called from outside."""

from __future__ import annotations

from pyspark.sql import SparkSession

from factweave.functions.text import AUXILIARIES, MULTIPLIERS

_WORDS = "|".join(MULTIPLIERS)
_FACTORS = " ".join(f"WHEN '{word}' THEN {factor:.1f}D" for word, factor in MULTIPLIERS.items())
_NUMBER = rf"(?i)([-+]?[0-9][0-9,]*\\.?[0-9]*)\\s*({_WORDS})?"

FUNCTIONS = {
    "base_verdict": ("verdict STRING", "STRING", "regexp_replace(verdict, '_given_assertion$', '')"),
    "apply_polarity": ("verdict STRING, polarity INT", "STRING", "CASE WHEN polarity = 0 AND verdict = 'verified' THEN 'contradicted' WHEN polarity = 0 AND verdict = 'contradicted' THEN 'verified' ELSE verdict END"),
    "parse_quantity": ("told STRING", "DOUBLE", f"""try_cast(replace(regexp_extract(told, '{_NUMBER}', 1), ',', '') AS DOUBLE)
        * CASE lower(regexp_extract(told, '{_NUMBER}', 2)) WHEN '' THEN 1.0D {_FACTORS} END"""),
    "normalize_predicate": ("raw STRING", "STRING", f"""coalesce(nullif(trim(BOTH '_' FROM regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(
          coalesce(nullif(trim(regexp_replace(trim(replace(trim(lower(raw)), '_', ' ')), '^({"|".join(AUXILIARIES)})\\\\s+', '')), ''), replace(trim(lower(raw)), '_', ' ')),
        '\\\\s+(the|a|an)$', ''), '[^0-9A-Za-z_\\\\s]', '_')), '\\\\s+', '_'), '_+', '_')), ''), 'unknown_predicate')"""),
}


def register(spark: SparkSession) -> None:
    """Makes FUNCTIONS known to the session's SQL."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")

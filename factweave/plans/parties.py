"""Queries of party assertions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.operators import party, verify
from factweave.plans import verification
from factweave.plans.views import NOW, oracle, view, with_views
from factweave.sources.scratch import shared_dir
from factweave.streaming import stateful

C = F.col
QUERIES, SQL = {}, {}
FUNCTIONAL = ["click", "purchase", "signup"]
_CURRENT = f"(NOT r.retracted AND (r.valid_until IS NULL OR (r.valid_until <> 'before_present' AND r.valid_until > '{NOW}')))"
_KEYS = "r.party = c.party AND r.subject = c.subject AND r.predicate = c.predicate"


def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return party.lookup(view(spark, sf_dir, "party_claims"), view(spark, sf_dir, "tier_u"), NOW)


def _row(name: str, condition: str) -> str:
    return f"(SELECT min(id) FROM tier_u r WHERE {_KEYS} AND {condition}) AS {name}"


_SAME, _NEGATED = _row("same_id", f"r.object = c.object AND r.polarity = c.polarity AND {_CURRENT}"), _row("negated_id", f"r.object = c.object AND r.polarity = 1 - c.polarity AND {_CURRENT}")
_OTHER, _PAST = _row("other_id", f"r.object <> c.object AND r.polarity = 1 AND c.polarity = 1 AND {_CURRENT}"), _row("past_id", "r.object = c.object AND r.polarity = c.polarity AND NOT r.retracted AND r.valid_until IS NOT NULL")
QUERIES["C1_assertion_lookup"] = lambda s, d: _lookup(s, d).select("claim_id", "same_id")
SQL["C1_assertion_lookup"] = oracle(f"SELECT claim_id, {_SAME} FROM party_claims c", "party_claims", "tier_u")
QUERIES["C2_negated_assertion"] = lambda s, d: _lookup(s, d).select("claim_id", "negated_id")
SQL["C2_negated_assertion"] = oracle(f"SELECT claim_id, {_NEGATED} FROM party_claims c", "party_claims", "tier_u")
QUERIES["C3_object_conflict"] = lambda s, d: _lookup(s, d).select("claim_id", "other_id", "other_object")
SQL["C3_object_conflict"] = oracle(f"SELECT claim_id, other_id, object AS other_object FROM (SELECT claim_id, {_OTHER} FROM party_claims c) LEFT JOIN tier_u ON id = other_id", "party_claims", "tier_u")
QUERIES["C6_historical_match"] = lambda s, d: _lookup(s, d).select("claim_id", (C("same_id").isNull() & C("past_id").isNotNull()).alias("historical_only"))
SQL["C6_historical_match"] = oracle(f"SELECT claim_id, same_id IS NULL AND past_id IS NOT NULL AS historical_only FROM (SELECT claim_id, {_SAME}, {_PAST} FROM party_claims c)", "party_claims", "tier_u")


def _persona_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims on a subject that the party has said to be a persona of its user."""
    own = view(spark, sf_dir, "assertions").where(party.is_current(NOW) & (C("polarity") == 1) & (C("subject") == "user") & (C("predicate") == "identity"))
    return view(spark, sf_dir, "all_claims").join(own.select("party", C("object").alias("subject")).distinct(), ["party", "subject"], "left_semi").select("claim_id")


QUERIES["C7_identity_semi_join"] = _persona_claims
SQL["C7_identity_semi_join"] = oracle(f"SELECT claim_id FROM all_claims c WHERE EXISTS (SELECT 1 FROM assertions r WHERE r.party = c.party AND r.subject = 'user' AND r.predicate = 'identity' AND r.object = c.subject AND r.polarity = 1 AND {_CURRENT})", "all_claims", "assertions")


def _broadened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: claims that the party has asserted under the first other predicate of the same property."""
    claims = view(spark, sf_dir, "all_claims").join(verify.siblings(view(spark, sf_dir, "predicates")), "predicate").select("claim_id", "party", "subject", C("sibling").alias("predicate"), "object", "polarity")
    told = party.lookup(claims, view(spark, sf_dir, "assertions"), NOW)
    return told.where("same_id IS NOT NULL").select("claim_id", "predicate", C("same_id").alias("row_id"))


QUERIES["C4_predicate_broadening"] = _broadened
SQL["C4_predicate_broadening"] = oracle(f"""WITH meta AS (SELECT * FROM predicates QUALIFY row_number() OVER (PARTITION BY predicate ORDER BY id) = 1), near AS (SELECT m.predicate, arg_min(p.predicate, p.id) AS sibling FROM meta m JOIN predicates p ON p.property = m.property AND p.predicate <> m.predicate GROUP BY m.predicate)
  SELECT claim_id, sibling AS predicate, min(r.id) AS row_id FROM all_claims c JOIN near USING (predicate) JOIN assertions r ON r.party = c.party AND r.subject = c.subject AND r.predicate = sibling AND r.object = c.object AND r.polarity = c.polarity WHERE {_CURRENT} GROUP BY claim_id, sibling""", "all_claims", "assertions", "predicates")  # fmt: skip


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return party.write_assertions(view(spark, sf_dir, "tier_u").where("NOT retracted"), FUNCTIONAL)


QUERIES["K1_write_assertions"] = _written


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 as a stream: events that land in a folder, taken as they come with the beliefs of each key as state."""
    text = f"{with_views('tier_u')} SELECT * FROM tier_u WHERE NOT retracted"
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    landed = spark.read.parquet(f"{sf_dir}/events.parquet")
    landed.write.parquet(f"{out}/landed")
    events = spark.readStream.schema(landed.schema).parquet(f"{out}/landed")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        taken = stateful.revise_stream(spark.sql(text, events=events), FUNCTIONAL)
        taken.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return party.closed(spark.read.schema(party.WRITE).parquet(f"{out}/rows").where(C("status") != stateful.LATE), FUNCTIONAL)


QUERIES["K1_revision_stream"] = _streamed


def _upgrades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: assertions that external sources bear out become externally verified, the unverified ones only."""
    found = verification.QUERIES["verify_claims"](spark, sf_dir).where("source = 'tier_u_upgrade'").select(C("premise").alias("id")).distinct().withColumn("hit", F.lit(True))
    return view(spark, sf_dir, "assertions").join(found, "id", "left").select("id", F.when(C("hit") & (C("status") == "asserted_unverified"), party.FIRM).otherwise(C("status")).alias("status"))


QUERIES["K2_status_upgrade"] = _upgrades
SQL["K2_status_upgrade"] = verification._sql("SELECT id, CASE WHEN status = 'asserted_unverified' AND id IN (SELECT premise FROM outcome WHERE source = 'tier_u_upgrade') THEN 'externally_verified' ELSE status END AS status FROM assertions")
QUERIES["K3_rows_for_party"] = lambda s, d: view(s, d, "tier_u").where("NOT retracted").withColumn("place", F.row_number().over(Window.partitionBy("party").orderBy("id"))).select("party", "place", "id")
SQL["K3_rows_for_party"] = oracle("SELECT party, CAST(row_number() OVER (PARTITION BY party ORDER BY id) AS INT) AS place, id FROM tier_u WHERE NOT retracted", "tier_u")


def _promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: what promoting each claim of a party to an assertion gives: a row, nothing new, or a row that verified ones contradict."""
    written = _written(spark, sf_dir).select("id", C("status").alias("now"), "closed_by")
    outcome = F.when(C("now").isNull(), "repeated").when(C("now") == "contradicted_by_externally_verified", "contradicted").when(C("now") == party.FIRM, "verified").otherwise("promoted")
    return view(spark, sf_dir, "tier_u").where("NOT retracted").join(written, "id", "left").select("id", outcome.alias("outcome"))


QUERIES["K4_promotion"] = _promoted
QUERIES["K5_sliding_window_limit"] = lambda s, d: party.rate_limit(s.read.parquet(f"{d}/events.parquet"), "user_id", "ts", most=3, window=6 * 3600.0)
SQL["K5_sliding_window_limit"] = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  w AS (SELECT event_id, user_id, n, true AS allowed, [t] AS recent FROM e WHERE n = 1
    UNION ALL SELECT event_id, user_id, n, len(kept) < 3, CASE WHEN len(kept) < 3 THEN list_append(kept, t) ELSE kept END FROM (SELECT e.event_id, e.user_id, e.n, e.t, list_filter(w.recent, lambda x: x > e.t - 21600.0) AS kept FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
  SELECT event_id, allowed FROM w"""
QUERIES["K5_window_counts"] = lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy("user_id", F.window("ts", "1 day")["start"].cast("string").alias("day")).agg(F.count(F.lit(1)).alias("events"))
SQL["K5_window_counts"] = "SELECT user_id, CAST(CAST(date_trunc('day', ts) AS TIMESTAMP) AS VARCHAR) AS day, count(*) AS events FROM events GROUP BY ALL"
QUERIES["M1_first_row_by_id"] = lambda s, d: view(s, d, "tier_u").where("NOT retracted").groupBy(*party.KEY).agg(F.min_by("object", "id").alias("object"))
SQL["M1_first_row_by_id"] = oracle("SELECT party, subject, predicate, arg_min(object, id) AS object FROM tier_u WHERE NOT retracted GROUP BY party, subject, predicate", "tier_u")
QUERIES["A23_latest_events"] = lambda s, d: s.read.parquet(f"{d}/events.parquet").where("event_type = 'error'").orderBy(C("event_id").desc()).limit(100).select("event_id", "user_id", "value")
SQL["A23_latest_events"] = "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 100"
QUERIES["as_of_assertion"] = lambda s, d: party.as_of(view(s, d, "party_claims"), view(s, d, "tier_u").where("NOT retracted"))
SQL["as_of_assertion"] = oracle("SELECT claim_id, (SELECT arg_max(r.object, r.id) FROM tier_u r WHERE NOT retracted AND r.party = c.party AND r.subject = c.subject AND r.predicate = c.predicate AND r.id < c.claim_id) AS object FROM party_claims c", "party_claims", "tier_u")

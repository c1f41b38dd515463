"""Golden cases of the stateful and iterative operators."""

import random

from pyspark.sql import functions as F

from factweave.functions import dates, text
from factweave.operators import graph, kb, party, rollup, verify
from factweave.plans import parties
from factweave.plans.views import view
from factweave.streaming import stateful


def write(id, object, polarity=1, status="asserted_unverified", start=None, end=None, predicate="lives_in"):
    return {"id": id, "party": "p", "subject": "s", "predicate": predicate, "object": object, "polarity": polarity, "valid_from": start, "valid_until": end, "status": status, "asserted_at": f"t{id}"}


def revise(writes, functional):
    """The rows that the writes of one key leave, by going through all earlier rows for each."""
    rows = []
    for w in writes:
        same = [r for r in rows if r["object"] == w["object"] and r["polarity"] == w["polarity"]]
        if any(r["valid_from"] == w["valid_from"] and r["valid_until"] == w["valid_until"] for r in same):
            continue
        hit = same + [r for r in rows if r["object"] == w["object"] and r["polarity"] != w["polarity"]]
        if w["polarity"] == 1 and w["predicate"] in functional:
            hit += [r for r in rows if r["object"] != w["object"] and r["polarity"] == 1]
        for r in hit:
            if r["status"] != party.FIRM:
                r["valid_until"], r["closed_by"] = w["asserted_at"], w["id"]
        rows.append(w | {"closed_by": None, "status": "contradicted_by_externally_verified" if any(r["status"] == party.FIRM for r in hit) else w["status"]})
    return rows


COLUMNS = "id long, party string, subject string, predicate string, object string, polarity int, valid_from string, valid_until string, status string, asserted_at string"


def written(spark, writes, functional):
    df = spark.createDataFrame([tuple(w.values()) for w in writes], COLUMNS)
    return [r.asDict() for r in party.write_assertions(df, functional).orderBy("id").collect()]


def test_a_repeated_write_changes_nothing(spark):
    assert [r["id"] for r in written(spark, [write(1, "a"), write(2, "a")], ["lives_in"])] == [1]


def test_a_negation_closes_the_assertion_and_a_functional_object_the_other(spark):
    rows = written(spark, [write(1, "a"), write(2, "a", 0), write(3, "b"), write(4, "c")], ["lives_in"])
    assert [(r["id"], r["closed_by"]) for r in rows] == [(1, 4), (2, None), (3, 4), (4, None)]


def test_a_verified_row_stays_and_marks_the_new_one(spark):
    old, new = written(spark, [write(1, "a", status=party.FIRM), write(2, "a", 0)], ["other"])
    assert old["closed_by"] is None and new["status"] == "contradicted_by_externally_verified"


def test_writes_are_those_of_going_through_all_rows(spark):
    rng = random.Random(5)
    writes = []
    for i in range(600):
        w = write(i, rng.choice("abcd"), int(rng.random() < 0.7), rng.choice(["asserted_unverified"] * 4 + [party.FIRM]), rng.choice([None, None, "2001"]), rng.choice([None, None, "2005"]), rng.choice(["x", "y"]))
        writes.append(w | {"subject": rng.choice("st")})
    want = []
    for s in "st":
        for p in "xy":
            want += revise([dict(w) for w in writes if w["subject"] == s and w["predicate"] == p], {"x"})
    assert written(spark, writes, ["x"]) == sorted(want, key=lambda r: r["id"])


def test_stored_writes_are_those_of_going_through_all_rows(spark):
    rows = [r.asDict() for r in view(spark, "/root/testdata/sf0.001", "tier_u").where("NOT retracted").select(*party.COLUMNS).orderBy("id").collect()]
    keyed = {}
    for r in rows:
        keyed.setdefault(tuple(r[k] for k in party.KEY), []).append(r)
    want = {r["id"]: (r["status"], r["valid_until"], r["closed_by"]) for mine in keyed.values() for r in revise(mine, set(parties.FUNCTIONAL))}
    got = {r["id"]: (r["status"], r["valid_until"], r["closed_by"]) for r in parties.QUERIES["K1_write_assertions"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want
    outcomes = {r["id"]: r["outcome"] for r in parties.QUERIES["K4_promotion"](spark, "/root/testdata/sf0.001").collect()}
    named = {None: "repeated", "contradicted_by_externally_verified": "contradicted", party.FIRM: "verified", "asserted_unverified": "promoted"}
    assert outcomes == {r["id"]: named[want.get(r["id"], (None,))[0]] for r in rows}


def test_refused_hits_do_not_count():
    recent = []
    assert party.allowed([0, 1, 2, 3, 10, 11], 2, 10.0, recent) == [True, True, False, False, True, True]
    assert recent == [10, 11]


def test_limit_on_spark_is_that_of_the_function(spark):
    hits = [(i, i % 3, f"2024-01-01 00:{(i * 7) % 60:02d}:00") for i in range(90)]
    df = spark.createDataFrame(hits, "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r["event_id"]: r["allowed"] for r in party.rate_limit(df, "user_id", "ts", 3, 600.0).collect()}
    want = {}
    for user in range(3):
        mine = sorted((t, i) for i, u, t in hits if u == user)
        seconds = [int(t[14:16]) * 60.0 for t, _ in mine]
        want |= dict(zip([i for _, i in mine], party.allowed(seconds, 3, 600.0, []), strict=True))
    assert got == want


def test_limit_stream_keeps_its_window(spark, tmp_path):
    schema = "event_id long, key string, at double"
    for n, part in enumerate([[(1, "a", 0.0), (2, "a", 1.0)], [(3, "a", 2.0), (4, "b", 2.0)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = stateful.limit_stream(stream, 2, 10.0).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start(str(tmp_path / "out"))
        query.awaitTermination(120)
        assert not query.isActive, n
    assert {r["event_id"]: r["allowed"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: True, 2: True, 3: False, 4: True}


def test_paths_end_in_cycles(spark):
    edges = spark.createDataFrame([("a", "P279", "b"), ("b", "P279", "c"), ("c", "P279", "a"), ("x", "P31", "a")], "src string, property string, dst string")
    got = {(r["src"], r["dst"]): (r["depth"], r["first_property"]) for r in graph.transitive_paths(edges, graph.PATHS["is_a"]).collect()}
    assert got[("x", "c")] == (3, "P31") and got[("a", "a")] == (3, "P279") and len(got) == 12


CLAIM = "claim_id long, subject string, predicate string, object string, polarity int, party string, valid_from string, valid_until string, abstention_reason string"


def small_world(spark):
    """A town in a nation in a continent, one firm there, and what parties say of it."""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    edges = frame([("N1", "P30", "R1"), ("N2", "P30", "R1"), ("N3", "P30", "R2"), ("N1", "P31", "country"), ("N2", "P31", "country"), ("N3", "P31", "country"), ("R1", "P31", "continent"), ("R2", "P31", "continent"), ("country", "P279", "place"), ("continent", "P279", "place")], "src string, property string, dst string")
    labels = frame([("N1", "Nord"), ("N2", "Ost"), ("N3", "Sued"), ("R1", "Alpha"), ("R2", "Beta"), ("F1", "Firm"), ("F2", "Other firm")], "kb_id string, label string")
    statements = frame([(1, "F1", "P17", "N1", "entity", "normal", None, None), (2, "F2", "P17", "somewhere in text", "literal", "normal", None, None)], "stmt_id long, entity string, property string, value string, value_type string, rank string, start_q string, end_q string")
    predicates = frame([("located_in", "P17", "entity", "kb_resolvable", True, True, False, 1), ("ships_from", None, "entity", "kb_resolvable", False, False, False, 2), ("prefers", None, "entity", "user_authoritative", True, False, True, 3), ("owns", None, "entity", "kb_resolvable", True, False, False, 4)],
        "predicate string, property string, object_type string, routing_hint string, single_valued boolean, is_location boolean, user_subject boolean, id int")
    bindings = frame([("located_in", 0, "P17", False, True, False, None)], "predicate string, place int, property string, inverted boolean, single_valued boolean, gated boolean, object_class string")
    row = lambda i, s, p, o, k=1, status="asserted_unverified": (i, "u", s, p, o, k, None, None, status, "0", False)
    said = frame([row(1, "Firm", "ships_from", "Nord"), row(2, "u", "prefers", "tea"), row(3, "Firm", "owns", "boat"), row(4, "a firm in town", "owns", "boat"), row(5, "Other firm", "ships_from", "Sued", 0, party.FIRM), row(6, "Firm", "located_in", "Nord")],
        "id long, party string, subject string, predicate string, object string, polarity int, valid_from string, valid_until string, status string, asserted_at string, retracted boolean")
    taxonomy = frame([(1, "Nord", "Alpha", "part_of", "a_subsumed_by_b", False), (2, "Ost", "Alpha", "part_of", "a_subsumed_by_b", False), (3, "Sued", "Beta", "part_of", "a_subsumed_by_b", False)], "id long, a string, b string, relation string, verdict string, retracted boolean")
    carries = frame([(1, "ships_from", 1, "part_of", "up", False)], "id long, predicate string, polarity int, relation string, verdict string, retracted boolean")
    nogoods = frame([], "id long, kind string, relation string, source string, target string, reason string, last_used string, retracted boolean")
    return verify.Sources(predicates, bindings, said, statements, labels, edges, graph.part_of_paths(edges, ("country",)), graph.transitive_paths(edges, graph.PATHS["is_a"]), taxonomy, carries, nogoods, "2024-01-15T00:00:00")


def test_claims_through_all_sources(spark):
    cases = [
        (("Firm", "located_in", "Nord", 1), "verified", "tier_u_upgrade"), (("Firm", "located_in", "Alpha", 1), "contradicted_given_assertion", "tier_u"), (("Firm", "located_in", "Alpha", 0), "contradicted", "kb"), (("Firm", "located_in", "Sued", 1), "contradicted_given_assertion", "tier_u"),
        (("Other firm", "located_in", "Nord", 1), "no_grounding_found", "depth_exhausted"), (("Firm", "ships_from", "Nord", 1), "verified_given_assertion", "tier_u"), (("Firm", "ships_from", "Alpha", 1), "verified_given_assertion", "tier_u"),
        (("Firm", "ships_from", "Beta", 1), "no_grounding_found", "depth_exhausted"), (("Firm", "ships_from", "Nord", 0), "contradicted_given_assertion", "tier_u"), (("Other firm", "ships_from", "Beta", 1), "no_grounding_found", "depth_exhausted"), (("Other firm", "ships_from", "Sued", 1), "contradicted", "tier_u"),
        (("u", "prefers", "tea", 1), "verified_given_assertion", "tier_u"), (("Firm", "prefers", "tea", 1), "no_grounding_found", "user_subject_required"), (("a firm in town", "owns", "house", 1), "no_grounding_found_given_assertion", "vague_subject_existential"),
        (("Firm", "owns", "house", 1), "contradicted_given_assertion", "tier_u"), (("Nord", "located_in", "a place that trades", 1), "verified", "kb"), (("Firm", "located_in", "a place that trades", 1), "no_grounding_found", "depth_exhausted"),
    ]
    claims = spark.createDataFrame([(i, s, p, o, k, "u", None, None, None) for i, ((s, p, o, k), _, _) in enumerate(cases)], CLAIM)
    got = {r["claim_id"]: (r["verdict"], r["reason"] or r["source"]) for r in verify.verify(claims, small_world(spark)).collect()}
    assert got == {i: want for i, (_, *want) in enumerate(cases) for want in [tuple(want)]}


def test_a_reason_from_extraction_comes_first(spark):
    claims = spark.createDataFrame([(1, "Firm", "located_in", "Nord", 1, "u", None, None, "self_referential")], CLAIM)
    row = verify.verify(claims, small_world(spark)).first()
    assert (row["verdict"], row["reason"], row["depth"]) == ("no_grounding_found", "self_referential", None)


def test_literal_and_mistyped_values_do_not_contradict_entities(spark):
    s = small_world(spark)
    rows = [(1, "F9", "P17", "somewhere", "literal", "normal", None, None), (2, "F8", "P17", "1999-01-01", "date", "normal", None, None), (3, "F7", "P17", "n1", "entity", "normal", None, None)]
    statements = spark.createDataFrame(rows, s.statements.schema)
    asked = spark.createDataFrame([(i, 0, "P17", False, True, False, None, "entity", True, 1, None, None, f"F{10 - i}", "N1", "Nord") for i in (1, 2, 3)], "claim_id long, place int, property string, inverted boolean, single_valued boolean, gated boolean, object_class string, object_type string, is_location boolean, polarity int, valid_from string, valid_until string, lookup string, expected_id string, expected string")
    place = graph.place_table(s.part_of, s.is_a)
    got = {r["claim_id"]: (r["verdict"], r["reason"]) for r in kb.compare(asked, kb.with_values(statements, place, s.labels), s.part_of, place, F.to_date(F.lit("2024-01-15"))).collect()}
    assert got == {1: ("no_match", "entity_claim_vs_literal_value"), 2: ("no_match", "value_type_object_type_mismatch"), 3: ("verified", None)}


def test_ranks_without_sorting_groups(spark):
    rng = random.Random(1)
    rows = [(k, float(rng.randint(0, 50 if k == "ties" else 10**6))) for k in ("ties", "many") for _ in range(5000)] + [("one", 3.0)]
    got = {r["k"]: r["value"] for r in rollup.values_at(spark.createDataFrame(rows, "k string, v double"), "k", "v", lambda n: F.array(rollup.p95_place(n))).collect()}
    for k in ("ties", "many", "one"):
        values = sorted(v for name, v in rows if name == k)
        assert got[k] == values[max(int(0.95 * len(values)), 1) - 1]


def test_as_of_takes_the_last_row_before(spark):
    rng = random.Random(3)
    rows = [(i, "p", rng.choice("ab"), "q", f"o{i}") for i in rng.sample(range(3000), 400)]
    claims = [(i, "p", rng.choice("ab"), "q") for i in rng.sample(range(3000), 200)]
    got = {r["claim_id"]: r["object"] for r in party.as_of(spark.createDataFrame(claims, "claim_id long, party string, subject string, predicate string"), spark.createDataFrame(rows, "id long, party string, subject string, predicate string, object string"), span=64).collect()}
    assert got == {i: max(((r[0], r[4]) for r in rows if r[2] == s and r[0] < i), default=(0, None))[1] for i, _, s, _ in claims}


def test_dates_of_other_precision(spark):
    cases = [("1998", "1998-09-04", "match"), ("1999", "1998-09-04", "mismatch"), ("1998-09-05", "1998-09-04", None), ("1998-09-05", "1998", None), ("1998-05-03", "1998-01-01", None), ("long ago", "1998", None)]
    df = spark.createDataFrame([c[:2] for c in cases], "a string, b string").select(dates.relation(F.col("a"), F.col("b")).alias("r"))
    assert [r["r"] for r in df.collect()] == [c[2] for c in cases]


def test_computed_verdicts(spark):
    cases = [("60 million", "greater_than", "1,000", 1, "verified"), ("10", "squared", "100", 0, "contradicted"), ("superstrawberry", "vowel_count", "4 vowels", 1, "verified"), ("1,2,3", "equals", "123", 1, None), ("5", "not_equal", "6", 1, None)]
    df = text.with_computed_verdict(spark.createDataFrame(cases, "subject string, predicate string, object string, polarity int, want string"), "v").select("v", "want")
    assert [r["v"] for r in df.collect()] == [c[4] for c in cases]


def test_conflicting_starts_leave_no_interval(spark):
    rows = [(1, "e", "P", "v", "entity", "normal", "1990", None), (2, "e", "P", "w", "entity", "normal", "1991", None), (3, "f", "P", "v", "entity", "preferred", "1990", "1995"), (4, "f", "P", "v", "entity", "normal", "1980", None)]
    df = spark.createDataFrame(rows, "stmt_id long, entity string, property string, value string, value_type string, rank string, start_q string, end_q string")
    assert [tuple(r) for r in kb.intervals(df).collect()] == [("f", "P", "1990", "1995", True, True)]

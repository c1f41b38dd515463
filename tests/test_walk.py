"""The walk: closures of any length, bridges, limits, what verdicts rest on, and verifying again after retractions."""

import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from test_operators import CLAIM, small_world

from factweave.operators import graph, party, verify
from factweave.plans import verification

EDGE = "src string, property string, dst string"


def claims_of(spark, *cases):
    return spark.createDataFrame([(i, s, p, o, k, "u", None, None, None) for i, (s, p, o, k) in enumerate(cases)], CLAIM)


def test_a_chain_of_a_thousand_edges_is_closed(spark):
    edges = spark.createDataFrame([(f"n{i}", "P279", f"n{i + 1}") for i in range(1000)] + [("x", "P31", "n990"), ("n1000", "P279", "n999")], EDGE)
    paths = graph.transitive_paths(edges, graph.PATHS["is_a"])
    far = {(r["src"], r["dst"]): r["depth"] for r in paths.where("(src IN ('n0', 'x') AND dst IN ('n1000', 'n537')) OR src = dst").collect()}
    assert far == {("n0", "n1000"): 1000, ("n0", "n537"): 537, ("x", "n1000"): 11, ("n999", "n999"): 2, ("n1000", "n1000"): 2}
    assert paths.count() == 500_500 + 1 + 2 + 11


def test_the_bridge_needs_regions_at_both_ends_and_comes_last(spark):
    rows = [("town", "P131", "land"), ("land", "P30", "continent"), ("land", "P361", "union"), ("land", "P361", "club"), ("town", "P361", "history"), ("union", "P131", "world"), ("union", "P361", "bigger")]
    kinds = [("land", "P31", "country"), ("union", "P31", "country"), ("bigger", "P31", "country"), ("club", "P31", "club")]
    got = {(r["src"], r["dst"]): (r["depth"], r["first_property"]) for r in graph.part_of_paths(spark.createDataFrame(rows + kinds, EDGE), ("country",)).collect()}
    assert got[("town", "union")] == (2, "P131") and got[("land", "union")] == (1, "P361")
    assert not {("town", "club"), ("land", "club"), ("town", "history"), ("town", "world"), ("town", "bigger")} & set(got)
    assert ("union", "world") in got and ("union", "bigger") in got


def test_a_stand_in_against_another_abstains(spark):
    s = small_world(spark)
    said = [(9, "u", "Firm", "ships_from", "Ost", 0, None, None, "asserted_unverified", "0", False)]
    s = replace(s, assertions=s.assertions.union(spark.createDataFrame(said, s.assertions.schema)))
    row = verify.verify(claims_of(spark, ("Firm", "ships_from", "Alpha", 1)), s).first()
    assert (row["base_verdict"], row["reason"], row["conflict"], row["depth"]) == ("no_grounding_found", "conflicting_stand_ins", True, 1)


def deep_world(spark):
    s = small_world(spark)
    rows = [(10, "Alpha", "World", "part_of", "a_subsumed_by_b", False), (11, "World", "Universe", "part_of", "a_subsumed_by_b", False), (12, "Beta", "World", "part_of", "a_subsumed_by_b", False)]
    return replace(s, taxonomy=s.taxonomy.union(spark.createDataFrame(rows, s.taxonomy.schema)))


def test_verdicts_rest_on_the_steps_to_them(spark):
    w = verify.walk(claims_of(spark, ("Firm", "ships_from", "Universe", 1), ("Firm", "ships_from", "Nord", 1), ("u", "prefers", "coffee", 1)), deep_world(spark))
    told = {r["claim_id"]: (r["base_verdict"], r["depth"]) for r in verify.outcome(w).collect()}
    assert told == {0: ("verified", 3), 1: ("verified", 0), 2: ("contradicted", 0)}
    got = sorted(tuple(r) for r in verify.premises(w).collect())
    assert got == [
        (0, 1, 0, "substrate", "taxonomy", 11, False), (0, 1, 1, "substrate", "taxonomy", 10, False), (0, 1, 2, "substrate", "taxonomy", 1, False), (0, 1, 3, "tier_u", "assertions", 1, True),
        (0, 2, 0, "substrate", "taxonomy", 11, False), (0, 2, 1, "substrate", "taxonomy", 10, False), (0, 2, 2, "tier_u", "assertions", 1, True), (0, 2, 3, "tier_u", "assertions", 1, True),
        (1, 1, 0, "tier_u", "assertions", 1, True), (2, 1, 0, "tier_u", "assertions", 2, True),
    ]


def test_verifying_again_is_verifying_anew(spark):
    s = deep_world(spark)
    claims = claims_of(spark, ("Firm", "ships_from", "Universe", 1), ("Firm", "ships_from", "Nord", 1), ("Other firm", "ships_from", "World", 1), ("u", "prefers", "tea", 1), ("Firm", "located_in", "Nord", 1), ("Firm", "owns", "house", 1))
    w = verify.walk(claims, s)
    before = verify.outcome(w)
    for gone, bears_on in (([("taxonomy", 10), ("assertions", 2)], {0, 2, 3}), ([("assertions", 1)], {0, 1, 4, 5})):
        retractions = spark.createDataFrame(gone, "source_table string, row_id long")
        assert {r["claim_id"] for r in verify.touched(w, retractions, s).collect()} == bears_on, gone
        got = verify.reverify(before, w, claims, s, retractions)
        want = verify.verify(claims, verify.without_rows(s, retractions))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), gone


def test_a_hub_uses_up_its_claims_limits_only(spark):
    s = small_world(spark)
    children = spark.range(100_000).select((F.col("id") + 1000).alias("id"), F.concat(F.lit("Place "), F.col("id")).alias("a"), F.lit("Hub").alias("b"), F.lit("part_of").alias("relation"), F.lit("a_subsumed_by_b").alias("verdict"), F.lit(False).alias("retracted"))
    s = replace(s, taxonomy=s.taxonomy.union(children.select(*s.taxonomy.columns)))
    claims = claims_of(spark, ("Firm", "ships_from", "Hub", 1), ("Firm", "ships_from", "Alpha", 1), ("Firm", "ships_from", "Nord", 1))
    for budget, reason in ((verify.Budget(work=60), "budget_kb_work"), (verify.Budget(depth=2, probes=48, frontier=60), "budget_kb_neighbor_probes")):
        w = verify.walk(claims, s, budget)
        got = {r["claim_id"]: (r["base_verdict"], r["reason"]) for r in verify.outcome(w).collect()}
        assert got == {0: ("no_grounding_found", reason), 1: ("verified", None), 2: ("verified", None)}
        used = {r["claim_id"]: r for r in w.ledger.collect()}
        assert used[0]["probes"] <= 62 and used[1]["work"] == 4 + 1 + 2 + 8 and used[2]["work"] == 4
    tight = verify.Budget(work=10)  # enough for the claim and its neighbours, not for looking them all up
    assert {r["claim_id"]: r["reason"] for r in verify.verify(claims, s, tight).collect()} == {0: "budget_kb_work", 1: None, 2: None}


@pytest.fixture
def shuffled(spark):
    """Joins of small tables as those of large ones."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda df: re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stand_ins_are_found_without_lookups_by_node(spark, shuffled):
    claims = claims_of(spark, ("Firm", "ships_from", "World", 1), ("Firm", "ships_from", "", 1), ("", "ships_from", "Alpha", 1), (None, "ships_from", "Universe", 1), ("Firm", "owns", "World", 1), ("Firm", "ships_from", "World", 0))
    p = verify.prepare(deep_world(spark), verify.Budget())
    nodes = verify.guards(claims, p.sources).withColumn("node_id", F.col("claim_id").cast("string"))
    found = verify.discover(nodes.withColumns({c: F.lit(False) for c in verify.SIGNALS}), p, verify.Budget())
    assert not [keys for keys in shuffled(found) if "node_id" in keys or "parent" in keys]
    got = sorted((r["claim_id"], r["slot"], r["held"], r["neighbour"], r["found_by"], r["source_row"]) for r in found.collect())
    assert got == [(0, "object", "World", "Alpha", "taxonomy", 10), (0, "object", "World", "Beta", "taxonomy", 12), (2, "object", "Alpha", "Nord", "taxonomy", 1), (2, "object", "Alpha", "Ost", "taxonomy", 2), (3, "object", "Universe", "World", "taxonomy", 11)]


def test_the_first_two_objects_of_a_key_take_two_shuffles(spark, shuffled):
    rng = random.Random(3)
    told = [(i // 2, rng.choice("pq"), rng.choice("st"), "x", rng.choice("abc"), rng.choice(["yes", "no"])) for i in range(40)]  # ids come twice
    told += [(90, "p", "u", "x", "a", "yes"), (91, "p", "u", "x", "a", "no")]
    got = party.first_two(spark.createDataFrame(told, "id long, party string, subject string, predicate string, object string, status string"))
    assert len(shuffled(got)) <= 2
    want = {}
    for key in {t[1:4] for t in told}:
        objects = {}
        for t in told:
            if t[1:4] == key:
                objects[t[4]] = min(objects.get(t[4], (t[0], t[5])), (t[0], t[5]))
        rows = sorted((i, o, status) for o, (i, status) in objects.items())
        want[key] = (rows[0], next((r for r in rows if r[0] != rows[0][0]), None))
    assert {(r["party"], r["subject"], r["predicate"]): (tuple(r["first"]), r["second"] and tuple(r["second"])) for r in got.collect()} == want


def hub_world(spark):
    """small_world() with thirty towns in Nord, so more than the first twenty, a village in one of them, and predicates of all kinds."""
    s, more = small_world(spark), lambda df, rows: df.union(spark.createDataFrame(rows, df.schema))
    edges = more(s.edges, [(f"T{i:02}", "P131", "N1") for i in range(30)] + [("V1", "P131", "T27"), ("TX", "P131", "N1"), ("T26", "P31", "country")])
    labels = more(s.labels, [(f"T{i:02}", f"Town {i:02}") for i in range(30)] + [("V1", "Village"), ("TX", "a place that trades")])
    predicates = more(s.predicates, [("holds", "P17", "entity", "kb_resolvable", False, False, False, 5), ("sells_in", None, "entity", "kb_resolvable", False, False, False, 6), ("sells", None, "entity", "kb_resolvable", False, False, False, 7)])
    predicates = predicates.withColumn("property", F.when(F.col("predicate").startswith("sells"), "P5").otherwise(F.col("property")))
    row = lambda i, s, p, o, k=1: (i, "u", s, p, o, k, None, None, "asserted_unverified", "0", False)
    said = [row(20, "Other firm", "ships_from", "Town 28"), row(21, "Other firm", "ships_from", "Village"), row(22, "Firm", "sells", "Town 29"), row(23, "Other firm", "owns", "Town 25"), row(24, "Town 24", "ships_from", "Town 23", 0), row(25, "Nord", "owns", "Village")]
    carries = [(10 + i, p, k, "part_of", "both", False) for i, (p, k) in enumerate([("ships_from", 0), ("owns", 1), ("holds", 1), ("sells_in", 1), ("located_in", 1), ("located_in", 0)])]
    return replace(s, edges=edges, labels=labels, predicates=predicates, bindings=more(s.bindings, [("holds", 0, "P17", True, True, False, None)]), assertions=more(s.assertions, said), distributions=more(s.distributions, carries),
        statements=more(s.statements, [(3, "T22", "P17", "F1", "entity", "normal", None, None), (4, "T21", "P17", "N1", "entity", "deprecated", None, None)]), part_of=graph.part_of_paths(edges, ("country",)), is_a=graph.transitive_paths(edges, graph.PATHS["is_a"]))


def test_all_neighbours_of_a_hub_are_asked_for(spark):
    w = verify.walk(claims_of(spark, ("Other firm", "ships_from", "Nord", 1)), hub_world(spark), verify.Budget(incoming=None))
    got = {(r["alternative"], r["literal_index"]): (r["source"], r["source_row_id"]) for r in verify.premises(w).collect()}
    assert sorted([got[a, 0], got[a, 1]] for a, i in got if i == 0) == [[("kb", None), ("tier_u", 20)], [("tier_u", 20), ("tier_u", 20)], [("tier_u", 21), ("tier_u", 21)]]


def test_what_nothing_speaks_to_may_be_left_out(spark, monkeypatch):
    s, plain, made = hub_world(spark), verify.discover, []
    slots = [(x, p, o, k) for x in ("Firm", "Other firm", "Town 21", "Town 24", "Nord", None) for p in ("located_in", "ships_from", "owns", "holds", "sells_in") for o in ("Nord", "Alpha", "Town 27", "Village", "Firm") for k in (0, 1)]
    told = []
    for every in (False, True):
        def discover(nodes, p, budget, telling=False):
            assert telling
            found = plain(nodes, p, budget, telling and not every)  # noqa: B023
            made.append((every, found.select("node_id").distinct().count()))  # noqa: B023
            return found

        monkeypatch.setattr(verify, "discover", discover)
        w = verify.walk(claims_of(spark, *slots), s, verify.Budget(incoming=None))
        told.append((sorted(map(str, verify.outcome(w).collect())), sorted(map(str, verify.premises(w).collect()))))
    assert told[0] == told[1] and len({text for text in told[0][1] if "substrate" in text or "kb" in text}) > 20
    assert 0 < sum(n for every, n in made if not every) < sum(n for every, n in made if every)


def test_all_neighbours_of_a_hub_are_listed(spark):
    p = verify.prepare(hub_world(spark), verify.Budget(incoming=None))
    nodes = verify.guards(claims_of(spark, ("Third firm", "ships_from", "Nord", 1)), p.sources).withColumn("node_id", F.col("claim_id").cast("string"))
    found = verify.discover(nodes.withColumns({c: F.lit(False) for c in verify.SIGNALS}), p, verify.Budget(incoming=None))
    assert {r["neighbour"] for r in found.collect()} == {f"Town {i:02}" for i in range(30)} | {"a place that trades"}


def test_verifying_again_prepares_only_what_retractions_bear_on(spark, monkeypatch):
    s = deep_world(spark)
    claims = claims_of(spark, ("Firm", "ships_from", "Universe", 1), ("Firm", "located_in", "Nord", 1), ("Firm", "owns", "house", 1))
    w = verify.walk(claims, s)
    retractions = spark.createDataFrame([("assertions", 1)], "source_table string, row_id long")
    assert {r["claim_id"] for r in verify.touched(w, retractions, s, by_predicate=True).collect()} == {0}
    monkeypatch.setattr(verify, "prepare", None)
    got = {r["claim_id"]: r["verdict"] for r in verify.reverify(verify.outcome(w), w, claims, s, retractions).collect()}
    assert got == {0: "no_grounding_found", 1: "verified", 2: "contradicted_given_assertion"}


def test_traces_of_claims_decided_at_once_are_looked_up_nowhere(spark):
    told = spark.createDataFrame([(1, "verified", "kb", None, 0, None, False), (2, "verified_given_assertion", "tier_u", None, 0, 7, True), (3, "verified", "kb", None, 1, None, False), (4, "no_grounding_found", None, "depth_exhausted", None, None, False)],
        "claim_id long, verdict string, source string, reason string, depth int, premise long, given boolean")
    every = spark.createDataFrame([(3, 2, [("kb", None, None, False)]), (3, 1, [("substrate", "taxonomy", 5, False), ("kb", None, None, False)])],
        "claim_id long, alternative int, literals array<struct<source:string,source_table:string,source_row_id:bigint,is_assertion:boolean>>")
    got = {r["claim_id"]: [(a["alternative"], [tuple(x) for x in a["literals"]]) for a in r["trace"]["alternatives"]] for r in verification.nested(told, every).collect()}
    assert got == {1: [(1, [(0, "kb", None, None, False)])], 2: [(1, [(0, "tier_u", "assertions", 7, True)])], 3: [(1, [(0, "substrate", "taxonomy", 5, False), (1, "kb", None, None, False)]), (2, [(0, "kb", None, None, False)])], 4: []}

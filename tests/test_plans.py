"""What Spark makes of shared steps: how tables are joined."""

from dataclasses import replace

from pyspark.sql import functions as F
from test_operators import small_world

from factweave.operators import graph, kb, verify
from factweave.sources import scratch


def plan_of(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_a_table_is_broadcast_by_its_rows_not_by_the_bytes_of_its_files(spark, capsys):
    many = spark.range(10 * scratch.SENT).select("id", F.lit("the same in all rows").alias("text"))
    large = scratch.settle(spark.range(2 * scratch.SENT).select("id", F.lit("x" * 500).alias("more")), "large")
    small = scratch.settle(spark.range(scratch.SENT).select("id", F.lit("x").alias("less")), "small")
    assert "Broadcast" not in plan_of(many.join(large, "id", "left"), capsys)
    assert "BroadcastHashJoin" in plan_of(large.join(small, "id", "left"), capsys)
    assert large.join(small, "id").count() == scratch.SENT


ASKED = "claim_id long, place int, property string, inverted boolean, single_valued boolean, gated boolean, object_class string, object_type string, is_location boolean, polarity int, valid_from string, valid_until string, lookup string, expected_id string, expected string"


def test_claims_without_an_expected_entity_do_not_meet_in_one_task(spark, capsys):
    frame = spark.createDataFrame
    row = lambda i, lookup, cls, kind, expected_id, expected: (i, 0, "P", False, True, False, cls, kind, False, 1, None, None, lookup, expected_id, expected)
    asked = scratch.settle(frame([row(1, "O1", None, "time", None, "circa 1996"), row(2, "O2", None, "time", None, "1997-02"), row(3, None, None, "time", None, "1996"), row(4, "O1", "country", "entity", "N1", "Nord"), row(5, None, None, "entity", None, "?")], ASKED), "asked")
    statements = frame([(1, "O1", "P", "1996-05-04", "date", "normal", None, None), (2, "O2", "P", "1997-01-02", "date", "normal", None, None)], "stmt_id long, entity string, property string, value string, value_type string, rank string, start_q string, end_q string")
    paths = lambda *rows: scratch.settle(frame(list(rows), "src string, dst string, depth int, first_property string"), "paths")
    part_of, is_a = paths(("N1", "R1", 1, "P30")), paths(("N1", "land", 1, "P31"))
    place, kinds = graph.place_table(part_of, is_a), kb.kinds(asked, is_a)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = kb.with_values(statements, place, frame([("N1", "Nord")], "kb_id string, label string"))
        gated = kb.gate(kb.compare(asked, held, part_of, place, F.to_date(F.lit("2024-01-15"))), kinds)
        plan = plan_of(gated, capsys)
        assert "hashpartitioning(_key" in plan and "hashpartitioning(expected_id" not in plan and "hashpartitioning(claim_id" not in plan
        got = {r["claim_id"]: (r["verdict"], r["reason"], r["n_statements"]) for r in gated.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert [tuple(r) for r in kinds.collect()] == [("N1", "country", None, True)]
    assert got == {1: ("verified", None, 1), 2: ("no_match", "date_not_a_clean_mismatch", 1), 3: ("no_match", "no_matching_statement", 0), 4: ("no_match", "value_type_object_type_mismatch", 1), 5: ("no_match", "value_unresolved", 0)}


def test_only_nodes_that_a_source_looks_up_by_id_meet_labels(spark, capsys):
    s = small_world(spark)
    named = scratch.settle(spark.range(2 * scratch.SENT).select(F.concat(F.lit("Firm "), "id").alias("label"), F.concat(F.lit("Q"), "id").alias("id")), "names")
    p = replace(verify.prepare(s), names=named)
    node = lambda i, subject, predicate, object_: (i, i, "u", subject, predicate, object_, 1, None, None, True, False)
    schema = "node_id long, claim_id long, party string, subject string, predicate string, object string, polarity int, valid_from string, valid_until string, external boolean, given boolean"
    nodes = spark.createDataFrame([node(1, "12", "greater_than", "11"), node(2, "Firm 1", "greater_than", "2"), node(3, "Firm 7", "located_in", "1997-02"), node(4, "zz", "located_in", "yy")], schema)
    rows = verify.resolved(scratch.settle(verify.described(nodes, p), "nodes"), p)
    assert "hashpartitioning(subject" not in plan_of(rows, capsys)
    got = {r["node_id"]: (r["named"], r["subject_id"], r["object_id"]) for r in rows.collect()}
    assert got[1] == (False, None, None) and got[2][0] is False and got[3] == (True, "Q7", None) and got[4] == (False, None, None)


def test_a_claim_on_a_single_statement_is_not_put_together(spark, capsys):
    frame = spark.createDataFrame
    row = lambda i, lookup, expected: (i, 0, "P", False, True, False, None, "time", False, 1, None, None, lookup, None, expected)
    asked = scratch.settle(frame([row(1, "O1", "1996-05-04"), row(2, "O2", "1997"), row(3, None, "1996"), row(4, "O3", "1998")], ASKED), "asked")
    statements = frame([(1, "O1", "P", "1996-05-04", "date", "normal", None, None), (2, "O2", "P", "1997-01-02", "date", "normal", None, None), (3, "O2", "P", "1999-01-02", "date", "normal", None, None)], "stmt_id long, entity string, property string, value string, value_type string, rank string, start_q string, end_q string")
    none = scratch.settle(frame([], "src string, dst string, depth int, first_property string"), "paths")
    place = graph.place_table(none, none)
    compared = kb.compare(asked, kb.with_values(statements, place, frame([("N1", "Nord")], "kb_id string, label string")), none, place, F.to_date(F.lit("2024-01-15")))
    assert "Union" in plan_of(compared, capsys)
    got = {r["claim_id"]: (r["verdict"], r["reason"], r["n_statements"]) for r in compared.collect()}
    assert got == {1: ("verified", None, 1), 2: ("verified", None, 2), 3: ("no_match", "no_matching_statement", 0), 4: ("no_match", "no_matching_statement", 0)}

"""Names in their context with a cache that is written through, and the direction of mappings."""

from factweave.operators import directions, resolve
from factweave.sources.scratch import settle

NAMES = "kb_id string, label string"
CACHE = "signature string, kb_id string, used long, created_at string, retracted boolean"
ASKED = "request_id long, reference string, expected_type string, predicate string, slot string, party string"


def world(spark):
    labels = spark.createDataFrame([("Q1", "Paris"), ("Q2", "Paris"), ("Q3", "Rome")], NAMES)
    aliases = spark.createDataFrame([("Q3", "the eternal city")], "kb_id string, alias string")
    redirects = spark.createDataFrame([("roma", "Rome")], "title string, target string")
    edges = spark.createDataFrame([("Q1", "P31", "city"), ("Q2", "P31", "prince"), ("Q3", "P31", "city")], "src string, property string, dst string")
    return labels, aliases, redirects, edges


def asked(spark, *rows):
    labels, aliases, redirects, edges = world(spark)
    requests = spark.createDataFrame(rows, ASKED)
    composed = settle(resolve.compose(requests, redirects, labels, aliases, edges), "composed")
    return lambda cache: settle(resolve.in_context(requests, composed, cache, labels, aliases, edges), "answered")


def told(df):
    return {r["request_id"]: (r["kb_id"], r["via"]) for r in df.collect()}


def test_a_name_is_searched_once_and_then_known_also_as_nothing(spark):
    ask = asked(spark, (1, "Paris", None, "p", "subject", "u"), (2, "nobody", None, "p", "subject", "u"), (3, "the eternal city", "city", "p", "object", "u"), (4, "roma", None, "p", "subject", "u"), (5, "Paris", None, "p", "subject", "u"))
    empty = spark.createDataFrame([], CACHE)
    first = ask(empty)
    assert told(first) == {1: ("Q1", "search"), 2: (None, "nothing"), 3: ("Q3", "normaliser"), 4: ("Q3", "normaliser"), 5: ("Q1", "search")}
    cache = settle(resolve.written_through(empty, first, "t1"), "cache")
    assert sorted((r["kb_id"], r["used"]) for r in cache.collect()) == [("", 1), ("Q1", 2), ("Q3", 1), ("Q3", 1)]
    again = ask(cache)
    assert {k: v for k, v in told(again).items() if k in (1, 2, 5)} == {1: ("Q1", "cache"), 2: (None, "negative"), 5: ("Q1", "cache")}
    assert sorted((r["kb_id"], r["used"]) for r in resolve.written_through(cache, again, "t2").collect()) == [("", 2), ("Q1", 4), ("Q3", 1), ("Q3", 1)]


def test_contexts_have_rows_of_their_own_and_retracted_rows_do_not_answer(spark):
    rows = [(1, "Paris", None, "p", "subject", "u"), (2, "Paris", None, "q", "subject", "u"), (3, "Paris", None, "p", "object", "u"), (4, "Paris", None, "p", "subject", "v"), (5, "Paris", None, None, "subject", "u"), (6, "Paris", None, "", "subject", "u")]
    empty = spark.createDataFrame([], CACHE)
    first = asked(spark, *rows)(empty)
    assert len({r["signature"] for r in first.collect()}) == 6
    cache = settle(resolve.written_through(empty, first, "t1"), "cache")
    gone = cache.selectExpr("signature", "'Q9' AS kb_id", "used", "created_at", "true AS retracted")
    assert told(asked(spark, *rows)(gone))[1] == ("Q1", "search")
    assert resolve.written_through(gone, asked(spark, *rows)(gone), "t2").count() == 12
    assert resolve.signature() is not None and told(asked(spark, *rows)(cache))[6] == ("Q1", "cache")


def test_speakers_and_events_are_not_looked_up_as_titles_and_a_weak_best_is_no_answer(spark):
    ask = asked(spark, (1, "Rome", None, "p", "subject", "Rome"), (2, "event_1", None, "p", "subject", "u"), (3, None, None, "p", "subject", "u"), (4, "", None, "p", "subject", "u"), (5, "Paris", "prince", "p", "subject", "u"))
    first = ask(spark.createDataFrame([], CACHE))
    got = told(first)
    assert got[1] == ("Q3", "search") and got[2] == (None, "nothing") and got[3] == (None, "nothing") and got[4] == (None, "nothing")
    assert got[5] == ("Q2", "normaliser")
    labels, aliases, _, edges = world(spark)
    only_type = spark.createDataFrame([(5, "Paris", "prince", "p", "subject", "u")], ASKED)
    none = spark.createDataFrame([], "reference string, expected_type string, kb_id string, form string")
    weak = resolve.in_context(only_type, none, spark.createDataFrame([], CACHE), labels, aliases, edges)
    assert told(weak) == {5: (None, "weak")}
    assert resolve.written_through(spark.createDataFrame([], CACHE), weak, "t").count() == 0


MAPPING = "id long, property string, subject_slot string, object_slot string, subject_type string, object_type string, single_valued boolean"
STATEMENT = "property string, entity string, value string, rank string"


def judged(spark, mapping, statements, kinds=(), constraints=()):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    row = directions.validated(frame([(1, *mapping, True)], MAPPING), frame(statements, STATEMENT), frame(kinds, "entity string, kind string"), frame(constraints, "property string, role string, kind string")).collect()
    assert len(row) == 1
    return row[0]["status"], row[0]["subject_slot"], row[0]["single_valued"]


STANDARD, INVERSE = ("subject", "statement_value"), ("statement_value", "subject")
BORN = [("P", "ann", "rome", "normal"), ("P", "bob", "oslo", "normal")]
KINDS = [("ann", "human"), ("bob", "human"), ("rome", "city"), ("oslo", "city")]


def test_a_map_is_confirmed_or_turned_by_what_examples_are(spark):
    assert judged(spark, ("P", *STANDARD, "human", "city"), BORN, KINDS) == ("confirmed", "subject", True)
    assert judged(spark, ("P", *INVERSE, "human", None), BORN, KINDS) == ("corrected", "subject", False)
    assert judged(spark, ("P", *STANDARD, "city", None), BORN, KINDS) == ("corrected", "statement_value", False)
    assert judged(spark, ("P", *STANDARD, None, "city"), BORN, KINDS) == ("confirmed", "subject", True)


def test_an_object_alone_never_turns_a_map_and_examples_must_agree(spark):
    assert judged(spark, ("P", *STANDARD, None, "human"), BORN, KINDS) == ("unconfirmed", "subject", False)
    assert judged(spark, ("P", *STANDARD, "human", "human"), BORN, KINDS)[0] == "unconfirmed"
    torn = [*KINDS[:1], ("bob", "city"), KINDS[2], ("oslo", "human")]
    assert judged(spark, ("P", *STANDARD, "human", None), BORN, torn) == ("unconfirmed", "subject", False)


def test_one_swapped_pair_makes_nothing_symmetric_but_all_do(spark):
    both = [*BORN, ("P", "rome", "ann", "normal"), ("P", "oslo", "bob", "normal")]
    assert judged(spark, ("P", *STANDARD, "human", "city"), both, KINDS) == ("symmetric", "subject", False)
    assert judged(spark, ("P", *STANDARD, "human", "city"), both[:3], [*KINDS[:2], KINDS[3]]) == ("confirmed", "subject", True)


def test_without_examples_statements_or_kinds_nothing_is_confirmed_but_by_constraints(spark):
    assert judged(spark, ("X", *STANDARD, "human", "city"), BORN, KINDS)[0] == "unconfirmed"
    assert judged(spark, ("P", None, None, "human", "city"), BORN, KINDS)[0] == "unconfirmed"
    assert judged(spark, ("P", *STANDARD, "human", "city"), [(*BORN[0][:3], "deprecated")], KINDS) == ("suspect", "subject", False)
    roles = [("P", "subject", "human"), ("P", "value", "city")]
    assert judged(spark, ("P", *STANDARD, "human", "city"), BORN, (), roles) == ("confirmed", "subject", True)
    assert judged(spark, ("P", *STANDARD, "human", "city"), BORN, (), roles[:1])[0] == "unconfirmed"

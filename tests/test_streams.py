"""Streams, sinks, sources and SQL functions against their batch forms."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factweave.functions import registered, text
from factweave.operators import party
from factweave.sources import statements
from factweave.streaming import stateful


def writes_of(n, seed):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    return [(i, f"u{i % 3}", pick("s", "t"), pick("x", "y"), pick(*"abcd"), int(rng.random() < 0.7), pick(None, None, "2001"), pick(None, None, "2005"), pick(*["asserted_unverified"] * 4, party.FIRM), f"t{i:04d}") for i in range(n)]


def test_writes_in_micro_batches_leave_what_one_batch_does(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = writes_of(360, 7)
    try:
        for n, part in enumerate([rows[:120], rows[120:240], rows[240:] + [(50, "u0", "s", "x", "a", 1, "1900", None, "asserted_unverified", "t")]]):
            spark.createDataFrame(part, party.WRITE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(party.WRITE).parquet(str(tmp_path / "in"))
            query = stateful.revise_stream(stream, ["x"]).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
            assert query.awaitTermination(300), n
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    taken = spark.read.parquet(str(tmp_path / "out"))
    assert [r["valid_from"] for r in taken.where("status = 'late'").collect()] == ["1900"]
    got = party.closed(taken.where("status <> 'late'"), ["x"])
    want = party.write_assertions(spark.createDataFrame(rows, party.WRITE), ["x"])
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_a_repeated_batch_changes_nothing_and_a_broken_row_is_set_aside(spark, tmp_path):
    store = stateful.VerificationStore(str(tmp_path / "store"))
    schema = "verification_id long, claim_id long, verdict string"
    frame = lambda *rows: spark.createDataFrame(rows, schema)
    store.write(frame((1, 10, "verified"), (1, 11, "contradicted"), (2, 20, "verified"), (3, 30, "nonsense"), (None, 40, "verified")), 0)
    first = frame((1, 10, "no_grounding_found_given_assertion"), (17, 170, "verified"))
    store.write(first, 1)
    read = lambda: sorted(tuple(r) for r in store.read(spark, frame((0, 0, "")).withColumn("part", F.lit(0)).schema).select("verification_id", "claim_id", "verdict").collect())
    want = [(1, 10, "no_grounding_found_given_assertion"), (2, 20, "verified"), (17, 170, "verified")]
    assert read() == want
    store.write(frame((1, 12, "verified")), 1)  # the ledger has this batch
    assert read() == want
    rejected = spark.read.parquet(store.rejected)
    assert sorted((r["claim_id"], r["batch_id"]) for r in rejected.collect()) == [(30, 0), (40, 0)]


def test_verdicts_stream_into_the_store(spark, tmp_path):
    schema = "verification_id long, claim_id long, verdict string"
    for part in ([(1, 10, "verified"), (2, 20, "verified")], [(1, 10, "contradicted"), (None, 1, "verified")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = stateful.store_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), stateful.VerificationStore(str(tmp_path / "store")), str(tmp_path / "state"), availableNow=True)
        assert query.awaitTermination(300)
    rows = spark.read.parquet(str(tmp_path / "store" / "rows")).select("verification_id", "claim_id", "verdict").collect()
    assert sorted(map(tuple, rows)) == [(1, 10, "contradicted"), (2, 20, "verified")]


def test_statements_are_read_by_property_and_entity(spark):
    rows = [(i, f"E{i % 50}", f"P{i % 4}", f"v{i}", "entity", "normal", None, None) for i in range(400)]
    path = statements.store(spark.createDataFrame(rows, statements.SCHEMA))
    statements.register(spark)
    try:
        whole = spark.read.format("statements").load(path)
        assert sorted(map(tuple, whole.collect())) == sorted(rows)
        some = whole.where("property = 'P1' AND entity = 'E5' AND stmt_id > 100").select("stmt_id", "value")
        assert sorted(map(tuple, some.collect())) == sorted((r[0], r[3]) for r in rows if r[1:3] == ("E5", "P1") and r[0] > 100)
        assert whole.where("property = 'P9'").count() == 0
        reader = statements.StatementReader(path, whole.schema)
        every = len(reader.partitions())
        from pyspark.sql.datasource import EqualTo, GreaterThan

        assert [type(f) for f in reader.pushFilters([EqualTo(("property",), "P1"), GreaterThan(("stmt_id",), 5)])] == [GreaterThan]
        assert 0 < len(reader.partitions()) < every
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("told", [["60 million", "1,234 units", "about 5k", "none", "-3.5 bn", "7 hundred", None], ["is located in the", "Has Population", "was_born in", " pays: for  a ", "is", "  ", "__x__", None]])
def test_functions_of_sql_are_the_columns(spark, told):
    registered.register(spark)
    df = spark.createDataFrame([(t,) for t in told], "t string")
    got = df.selectExpr("parse_quantity(t) AS q", "normalize_predicate(t) AS p")
    want = df.select(text.parse_quantity(F.col("t")).alias("q"), text.normalize_predicate(F.col("t")).alias("p"))
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan and "parse_quantity(" not in plan


def test_windowed_counts_leave_out_what_comes_after_the_watermark(spark, tmp_path):
    schema = "at timestamp, event_type string"
    batches = [["10:00:05", "10:00:50", "10:01:10"], ["10:00:55", "10:09:00"], ["10:00:57"], ["10:20:00"]]
    for n, times in enumerate(batches):
        rows = spark.createDataFrame([(f"2024-01-01 {t}", "click") for t in times], "at string, event_type string")
        rows.select(F.col("at").cast("timestamp").alias("at"), "event_type").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stateful.windowed_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "at", "1 minute", "5 minutes")
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert query.awaitTermination(120), n
    got = {r["w"]: r["events"] for r in spark.read.parquet(str(tmp_path / "out")).select(F.date_format("window.start", "HH:mm").alias("w"), "events").collect()}
    assert got == {"10:00": 3, "10:01": 1, "10:09": 1}


def test_a_new_key_asks_the_state_store_for_nothing():
    class Store:
        stored = {}

        def updateValue(self, key, value):
            self.stored[key] = value

    kept = stateful.Kept(Store(), tuple, tuple, fresh=True)
    assert kept.get("a") is None and list(kept) == []
    kept["a"] = (1, "x")
    assert kept.get("a") == (1, "x") and list(kept) == ["a"]
    kept.save()
    assert Store.stored == {("a",): (1, "x")}


class Told:
    """A state of the store, in memory; asked counts what it was asked for."""

    def __init__(self):
        self.held, self.asked = {}, 0

    def exists(self):
        return () in self.held

    def update(self, value):
        self.held[()] = value

    def containsKey(self, key):
        self.asked += 1
        return key in self.held

    def getValue(self, key):
        self.asked += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.asked += 1
        self.held[key] = value


class Handle:
    def __init__(self):
        self.states = {}

    def getMapState(self, name, *schemas):
        return self.states.setdefault(name, Told())

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Told())


@pytest.mark.parametrize(("whole", "batches"), [(64, 1), (64, 5), (3, 5), (0, 7)])
def test_a_group_keeps_its_keys_apart_and_asks_once_for_each(monkeypatch, whole, batches):
    monkeypatch.setattr(stateful, "WHOLE", whole)
    rows = [(*r[:2], rng_key, *r[3:]) for r, rng_key in zip(writes_of(400, 11), [None, "s", "t", "u"] * 100, strict=True)]
    columns = [c.split()[0] for c in party.WRITE.split(", ")]
    handle, revision, got = Handle(), stateful.Revision(["x"]), {}
    revision.init(handle)
    size = -(-len(rows) // batches)
    for at in range(0, len(rows), size):
        frame = pd.DataFrame(rows[at : at + size], columns=columns)
        for part in revision.handleInputRows((7,), iter([frame[:13], frame[13:]]), None):
            got |= dict(zip(part["id"], part["status"], strict=True))
    beliefs, want = {}, {}
    for row in rows:
        w = dict(zip(columns, row, strict=True))
        belief = beliefs.setdefault(row[1:4], party.Belief(row[3] == "x"))
        status = belief.take(w)
        if status is not None:
            want[row[0]] = status
    assert got == want and len(beliefs) == 24 and len(set(want.values())) == 3
    if batches == 1:
        assert sum(state.asked for state in handle.states.values()) == len(beliefs)

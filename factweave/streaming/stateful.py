"""Streaming forms: the sliding-window limit and the revision of assertions as keyed state, and the verification store as a sink."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from factweave.operators.party import COLUMNS, KEY, WRITE, Belief, allowed


def limit_stream(events: DataFrame, most: int, window: float) -> DataFrame:
    """A stream of (event_id, key, at) with allowed. State is the hits in a key's window, dropped after a window without any.

    A key's events are judged in order of time within a micro-batch and in order of arrival across them.
    """

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        for frame in frames:
            frame = frame.sort_values(["at", "event_id"])
            yield pd.DataFrame({"event_id": frame["event_id"], "key": key[0], "allowed": allowed(frame["at"], most, window, recent)})
        state.update((recent,))
        state.setTimeoutDuration(int(window * 1000))

    return events.select("event_id", "key", F.col("at").cast("double").alias("at")).groupBy("key").applyInPandasWithState(
        judge, "event_id long, key string, allowed boolean", "recent array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


LATE = "late"


class Kept:
    """A dictionary of a Belief whose entries are a map state's: read when asked for, written back when the batch is done.

    fresh: there is no entry yet, so there is nothing to ask the state store for. prefix: what entries' keys begin with, where
    several dictionaries share a state; stored: the entries that are then gone through beside those at hand.
    """

    def __init__(self, state: Any, load: Callable[[tuple], Any], store: Callable[[Any], tuple], fresh: bool = False, prefix: tuple = (), stored: list | None = None):
        self.state, self.load, self.store, self.fresh, self.held, self.prefix, self.stored = state, load, store, fresh, {}, prefix, stored

    def _key(self, key: Any) -> tuple:
        return (*self.prefix, *(key if isinstance(key, tuple) else (key,)))

    def get(self, key: Any, default: Any = None) -> Any:
        if key not in self.held and not self.fresh and self.state.containsKey(self._key(key)):
            self.held[key] = self.load(self.state.getValue(self._key(key)))
        return self.held.get(key, default)

    def setdefault(self, key: Any, default: Any) -> Any:
        found = self.get(key)
        if found is None:
            found = self.held[key] = default
        return found

    def __setitem__(self, key: Any, value: Any) -> None:
        self.held[key] = value

    def __iter__(self) -> Iterator:
        yield from list(self.held)
        if self.fresh:
            return
        for key in self.state.keys() if self.stored is None else self.stored:
            key = tuple(key) if len(key) > 1 else key[0]
            if key not in self.held:
                yield key

    def save(self) -> None:
        for key, value in self.held.items():
            self.state.updateValue(self._key(key), self.store(value))


def _pack(values: set) -> tuple:
    return (json.dumps(sorted((list(v) if isinstance(v, tuple) else v for v in values), key=str)),)


def _unpack(row: tuple) -> set:
    return {tuple(v) if isinstance(v, list) else v for v in json.loads(row[0])}


#: So many groups are keys dealt out to: what the state store is asked for a group, and a frame of rows, serve all of its keys.
GROUPS = 2048
#: The state of a key with so many entries at most is one value.
WHOLE = 64


class Revision(StatefulProcessor):
    """The writes of a group of (party, subject, predicate): what earlier micro-batches left of each key is state.

    keys: by key how many writes were taken, the last id, the last two positive writes on different objects, and its entries,
    as one text. Those of a key with more than WHOLE are in states of their own, and only those of objects that a batch
    writes on are read: last, by object the last write on it; firm, by object and polarity the scopes of externally verified
    rows (names: two objects that have positive ones); starts, by object and polarity the starts of rows that can be closed.
    begun: the group has had a batch.
    """

    def __init__(self, functional: list[str]):
        self.functional = set(functional)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.begun = handle.getValueState("begun", "yes boolean")
        self.keys = handle.getMapState("keys", "key string", "n long, last_id long, positive string, names string, entries string")
        self.last = handle.getMapState("last", "key string, object string", "place long, time string, polarity int, valid_from string, valid_until string, firm boolean")
        self.firm = handle.getMapState("firm", "key string, object string, polarity int", "scopes string")
        self.starts = handle.getMapState("starts", "key string, object string, polarity int", "starts string")

    def _kept(self, key: str, fresh: bool, names: list) -> tuple[Kept, Kept, Kept]:
        named = [(name, 1) for name in names]
        return Kept(self.last, tuple, tuple, fresh, (key,)), Kept(self.firm, _unpack, _pack, fresh, (key,), named), Kept(self.starts, _unpack, _pack, fresh, (key,))

    def _load(self, key: str, functional: bool, fresh: bool) -> list:
        """What a key's earlier writes leave, and the last id of them."""
        belief = Belief(functional)
        told = None if fresh else self.keys.getValue((key,))
        if told is None:
            return [belief, -(2**63)]
        belief.n, seen, positive, names, entries = told
        belief.positive = [tuple(x) for x in json.loads(positive)]
        if entries is None:
            belief.last, belief.firm, belief.starts = self._kept(key, False, json.loads(names))
        else:
            last, firm, starts = json.loads(entries)
            belief.last = {name: tuple(x) for name, x in last}
            belief.firm = {(name, k): {tuple(x) for x in scopes} for name, k, scopes in firm}
            belief.starts = {(name, k): set(x) for name, k, x in starts}
        return [belief, seen]

    def _save(self, key: str, belief: Belief, seen: int) -> None:
        entries, names = None, []
        if isinstance(belief.last, dict):
            if len(belief.last) + len(belief.firm) + len(belief.starts) <= WHOLE:
                entries = json.dumps([list(belief.last.items()), [(*k, list(x)) for k, x in belief.firm.items()], [(*k, list(x)) for k, x in belief.starts.items()]])
            else:
                held, kept = (belief.last, belief.firm, belief.starts), self._kept(key, True, [])
                for one, entry in zip(kept, held, strict=True):
                    one.held = entry
                belief.last, belief.firm, belief.starts = kept
        if entries is None:
            for kept in (belief.last, belief.firm, belief.starts):
                kept.save()
            names = sorted({name for name, k in belief.firm if k == 1})[:2]
        self.keys.updateValue((key,), (belief.n, seen, json.dumps(belief.positive), json.dumps(names), entries))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh = not self.begun.exists()
        if fresh:
            self.begun.update((True,))
        frame = pd.concat(list(rows))[COLUMNS].sort_values("id")
        status, mine = [], {}
        for values in zip(*frame.astype(object).where(frame.notna(), None).to_dict("list").values(), strict=True):
            row = dict(zip(COLUMNS, values, strict=True))
            one = mine.get(name := values[1 : 1 + len(KEY)])
            if one is None:
                one = mine[name] = self._load(json.dumps(name), name[KEY.index("predicate")] in self.functional, fresh)
            status.append(one[0].take(row) if row["id"] > one[1] else LATE)
            one[1] = max(one[1], row["id"])
        for name, (belief, seen) in mine.items():
            self._save(json.dumps(name), belief, int(seen))
        yield frame.assign(status=status)[[s is not None for s in status]]

    def close(self) -> None:
        pass


def revise_stream(writes: DataFrame, functional: list[str]) -> DataFrame:
    """A stream of writes (party.COLUMNS) as they are taken, with the status that each gets; party.closed() of them gives what they leave.

    Micro-batches are judged one after the other, a key's writes within one in order of id; keys are dealt out to groups and a
    group's writes of a micro-batch are put in order in memory, so the size of micro-batches bounds what a task holds. A write
    with an id below one of its key that an earlier micro-batch took comes too late to be judged: it has the status "late",
    and nothing depends on it. State is kept for good, as any later write may depend on it. Needs the state store provider of
    RocksDB.
    """
    rows = writes.select(*COLUMNS, F.pmod(F.xxhash64(*KEY), F.lit(GROUPS)).cast("int").alias("keys"))
    return rows.groupBy("keys").transformWithStateInPandas(Revision(functional), WRITE, "append", "none")


PARTS = 16
VERDICTS = ("verified", "contradicted", "no_grounding_found")


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing is stored yet
        return spark.createDataFrame([], schema)


class VerificationStore:
    """A store of verifications in one folder, written by micro-batches: rows (laid out by part), rejected, and a ledger of batches.

    A batch replaces the rows of its verifications and no others. Batches that the ledger holds are left alone, so one that is
    replayed changes nothing; a batch whose write broke off before its ledger entry is written again with the same result.
    A claim without ids, or with a verdict that there is none of, is set aside with its batch; the others are stored.
    """

    def __init__(self, path: str):
        self.rows, self.rejected, self.ledger, self.staged = f"{path}/rows", f"{path}/rejected", f"{path}/ledger", f"{path}/staged"

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not _read(spark, self.ledger, StructType().add("batch_id", "long")).where(F.col("batch_id") == batch_id).isEmpty():
            return
        sound = F.col("verification_id").isNotNull() & F.col("claim_id").isNotNull() & F.coalesce(F.regexp_replace("verdict", "_given_assertion$", "").isin(*VERDICTS), F.lit(False))
        batch.where(~sound).withColumn("batch_id", F.lit(batch_id).cast("long")).write.partitionBy("batch_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.rejected)
        fresh = batch.where(sound).withColumn("part", F.pmod(F.xxhash64("verification_id"), F.lit(PARTS)).cast("int"))
        stored = _read(spark, self.rows, fresh.schema)
        kept = stored.join(fresh.select("part").distinct(), "part", "left_semi").join(fresh.select("verification_id").distinct(), "verification_id", "left_anti")
        staged = f"{self.staged}/{batch_id}"  # what is read can't be overwritten in one go
        kept.select(*fresh.columns).union(fresh).write.mode("overwrite").parquet(staged)
        spark.read.schema(fresh.schema).parquet(staged).repartition("part").write.partitionBy("part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.rows)
        spark.createDataFrame([(batch_id,)], "batch_id long").coalesce(1).write.mode("append").parquet(self.ledger)

    def read(self, spark: SparkSession, schema: StructType) -> DataFrame:
        return _read(spark, self.rows, schema)


def store_stream(verdicts: DataFrame, store: VerificationStore, checkpoint: str, **trigger: Any) -> Any:
    """Starts the sink of a stream of verdicts (verification_id, claim_id, verdict, ...)."""
    return verdicts.writeStream.foreachBatch(store.write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def windowed_counts(events: DataFrame, time: str, size: str, late: str) -> DataFrame:
    """Events by window and type, with a watermark: what comes later than that is left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), "event_type").agg(F.count(F.lit(1)).alias("events"))


"""Assertions of parties: lookups against them, and the belief revision of writes in order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.sources.scratch import settle

C = F.col
KEY = ["party", "subject", "predicate"]


def is_current(now: str) -> Column:
    """Not retracted and not ended; a start that lies ahead doesn't matter."""
    return ~C("retracted") & (C("valid_until").isNull() | ((C("valid_until") != "before_present") & (C("valid_until") > now)))


def first_match(claims: DataFrame, rows: DataFrame, keys: list[str], extra: Column | None = None, name: str = "row_id") -> DataFrame:
    """claim_id and the least id of the rows that agree on keys (and extra, over aliases c and r); null without one."""
    c, r = claims.alias("c"), rows.alias("r")
    on = [C(f"c.{k}") == C(f"r.{k}") for k in keys]
    condition = on[0]
    for part in [*on[1:], *([] if extra is None else [extra])]:
        condition = condition & part
    return c.join(r, condition, "left").groupBy("c.claim_id").agg(F.min("r.id").alias(name))


def first_two(rows: DataFrame) -> DataFrame:
    """KEY, first and second (struct of id, object, status): the least id of each key, and the least with another object.

    A task keeps the first two ids of each key before keys are dealt out.
    """
    per_object = rows.groupBy(*KEY, "object").agg(F.min(F.struct("id", "status")).alias("it")).select(*KEY, F.struct(C("it.id").alias("id"), "object", C("it.status").alias("status")).alias("it"))
    order = Window.partitionBy(*KEY).orderBy("it.id")
    few = per_object.withColumn("_n", F.dense_rank().over(order)).where("_n <= 2")
    return few.groupBy(*KEY).agg(F.min("it").alias("first"), F.min(F.when(C("_n") == 2, C("it"))).alias("second"))


def lookup(claims: DataFrame, assertions: DataFrame, now: str) -> DataFrame:
    """claims (with claim_id, KEY, object, polarity) and the rows that speak to each, by equi-joins on whole keys.

    same_id and same_status: the first current row that asserts it; negated_id: that asserts its negation; other_id,
    other_object, other_status: for a positive claim the first that asserts another object; past_id: the first that is over.
    """
    valid = assertions.where(~C("retracted"))
    current = F.when(is_current(now), C("id"))
    told = valid.groupBy(*KEY, "object", "polarity").agg(F.min(current).alias("same_id"), F.min_by("status", current).alias("same_status"), F.min(F.when(C("valid_until").isNotNull(), C("id"))).alias("past_id"))
    against = told.select(*KEY, "object", (1 - C("polarity")).alias("polarity"), C("same_id").alias("negated_id"), C("same_status").alias("negated_status"))
    others = first_two(valid.where(is_current(now) & (C("polarity") == 1))).withColumn("polarity", F.lit(1))
    rows = claims.join(told, [*KEY, "object", "polarity"], "left").join(against, [*KEY, "object", "polarity"], "left").join(others, [*KEY, "polarity"], "left")
    other = F.when(C("first.object") != C("object"), C("first")).otherwise(C("second"))
    return rows.withColumn("_o", other).select(*claims.columns, "same_id", "same_status", "past_id", "negated_id", "negated_status", C("_o.id").alias("other_id"), C("_o.object").alias("other_object"), C("_o.status").alias("other_status"))


def as_of(claims: DataFrame, rows: DataFrame, span: int = 256) -> DataFrame:
    """claim_id and the object of the last row of the claim's KEY with a smaller id.

    Both are laid into buckets of span ids. Windows run within a key and bucket; what earlier buckets leave is one row a
    bucket, so no partition holds all rows of a key.
    """
    every = rows.select(*KEY, "id", C("object").alias("_held"), F.lit(None).cast("long").alias("claim_id")).unionByName(claims.select(*KEY, C("claim_id").alias("id"), F.lit(None).cast("string").alias("_held"), "claim_id"))
    every = every.withColumn("_bucket", F.floor(C("id") / span))
    told = C("_held").isNotNull()
    within = Window.partitionBy(*KEY, "_bucket").orderBy("id", C("claim_id").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    near = every.withColumn("_near", F.last("_held", ignorenulls=True).over(within)).where("claim_id IS NOT NULL")
    lasts = every.groupBy(*KEY, "_bucket").agg(F.max_by("_held", F.when(told, C("id"))).alias("_last"))
    before = Window.partitionBy(*KEY).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.withColumn("_far", F.last("_last", ignorenulls=True).over(before)).select(*KEY, "_bucket", "_far")
    return near.join(carried, [*KEY, "_bucket"], "left").select("claim_id", F.coalesce("_near", "_far").alias("object"))


FIRM = "externally_verified"


class Belief:
    """What the earlier writes of one (party, subject, predicate) leave that later ones depend on, without their rows.

    A write closes, as of its own time, the earlier rows of its object and, for a functional predicate, positive rows of other
    objects. So all earlier rows of an object share the time of their last closing, and only the last row of an object can
    still have its own end.
    """

    def __init__(self, functional: bool):
        self.functional = functional
        self.n = 0
        self.last: dict[str, tuple] = {}  # by object: place, time, polarity, valid_from, valid_until, firm
        self.starts: dict[tuple[str, int], set] = {}  # by object and polarity: starts of rows before the last that can be closed
        self.firm: dict[tuple[str, int], set] = {}  # by object and polarity: scopes of externally verified rows
        self.positive: list[tuple[int, str, str]] = []  # place, object, time of the last positive write and of the last one of another object

    def _others_close(self, w: dict) -> tuple[int, str]:
        """Place and time of the last positive write on another object, if those close."""
        for place, name, time in self.positive if self.functional else ():
            if name != w["object"]:
                return place, time
        return -1, ""

    def take(self, w: dict) -> str | None:
        """The status that the written row gets; None where it repeats a row with equal scope."""
        o, p, scope = w["object"], w["polarity"], (w["valid_from"], w["valid_until"])
        last, others = self.last.get(o), self._others_close(w) if w["polarity"] == 1 else (-1, "")
        if scope in self.firm.get((o, p), ()):
            return None
        if last is not None:
            closed = max(last[:2], others)[1]
            if w["valid_until"] == closed and w["valid_from"] in self.starts.get((o, p), ()):
                return None
            end = others[1] if others[0] > last[0] else last[4]
            if last[2] == p and not last[5] and scope == (last[3], end):
                return None
        hit = self.firm.get((o, 0)) or self.firm.get((o, 1))
        if p == 1 and self.functional:
            hit = hit or any(k == 1 and name != o for name, k in self.firm)
        status = "contradicted_by_externally_verified" if hit else w["status"]
        if last is not None and not last[5]:
            self.starts.setdefault((o, last[2]), set()).add(last[3])
        if status == FIRM:
            self.firm.setdefault((o, p), set()).add(scope)
        self.last[o] = (self.n, w["asserted_at"], p, *scope, status == FIRM)
        if p == 1:
            rest = [x for x in self.positive if x[1] != o]
            self.positive = [(self.n, o, w["asserted_at"]), *rest[:1]]
        self.n += 1
        return status


COLUMNS = ["id", *KEY, "object", "polarity", "valid_from", "valid_until", "status", "asserted_at"]
WRITE = "id long, party string, subject string, predicate string, object string, polarity int, valid_from string, valid_until string, status string, asserted_at string"


def write_assertions(writes: DataFrame, functional: list[str]) -> DataFrame:
    """The rows that writes leave, per KEY in order of id: COLUMNS and closed_by.

    A write that repeats a row with equal scope changes nothing. Otherwise it closes, as of its own time, the negation of its
    object, other scopes of the same assertion and, for a functional predicate, other asserted objects; rows that are
    externally verified stay, and then the new row is marked as contradicted by them. Closed rows can be closed again.

    Whether a write is taken depends on those before it: keys are dealt out and sorted, and a task streams over them with the
    state of one key (its objects and scopes, not its rows). A key with very many writes is still one task's stream, as their
    order is the meaning. What closes a row, the last taken write that can, is then found by aggregates and joins.
    """
    known = set(functional)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, belief = None, Belief(False)
        for frame in frames:
            status = []
            for row in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                mine = tuple(row[k] for k in KEY)
                if mine != key:
                    key, belief = mine, Belief(row["predicate"] in known)
                status.append(belief.take(row))
            yield frame.assign(status=status)[[s is not None for s in status]]

    taken = writes.select(*COLUMNS).repartition(*KEY).sortWithinPartitions(*KEY, "id").mapInPandas(run, WRITE)
    return closed(settle(taken, "taken"), functional)


def closed(taken: DataFrame, functional: list[str]) -> DataFrame:
    """Taken writes with the end that the last write which closes them gives them, and closed_by, its id."""
    last = taken.groupBy(*KEY, "object").agg(F.max(F.struct("id", "asserted_at")).alias("own"))
    positive = taken.where(C("polarity") == 1).groupBy(*KEY, "object").agg(F.max(F.struct("id", "object", "asserted_at")).alias("it"))
    top = positive.groupBy(*KEY).agg(F.max("it").alias("one"))
    names, same = [C(k).alias(f"_{k}") for k in KEY], [C(k) == C(f"_{k}") for k in KEY]
    below = positive.join(top.select(*names, C("one.id").alias("_id")), same).where(C("it.id") != C("_id")).groupBy(*KEY).agg(F.max("it").alias("two"))
    rows = taken.join(last, [*KEY, "object"]).join(top.join(below, KEY, "left"), KEY, "left")
    other = F.when(C("one.object") != C("object"), F.struct("one.id", "one.asserted_at")).otherwise(F.struct("two.id", "two.asserted_at"))
    closes = (C("polarity") == 1) & C("predicate").isin(*functional) & other.isNotNull()
    closing = F.greatest(F.when(C("own.id") > C("id"), C("own")), F.when(closes & (other["id"] > C("id")), other))
    hit = (C("status") != FIRM) & closing.isNotNull()
    return rows.withColumn("_by", F.when(hit, closing)).select(*[C(c) for c in COLUMNS if c != "valid_until"], F.coalesce("_by.asserted_at", "valid_until").alias("valid_until"), C("_by.id").alias("closed_by"))


def allowed(hits: Iterable[float], most: int, window: float, recent: list[float]) -> list[bool]:
    """Whether each hit of a key, in order of time, is let through: at most so many in a window; refused hits don't count.

    recent holds the hits in the window and is kept up to date.
    """
    out = []
    for t in hits:
        while recent and recent[0] <= t - window:
            recent.pop(0)
        out.append(len(recent) < most)
        if out[-1]:
            recent.append(t)
    return out


def rate_limit(events: DataFrame, key: str, time: str, most: int, window: float) -> DataFrame:
    """events (event_id, key, time) with allowed, by key in order of time; a task keeps one key's window at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, recent = object(), []
        for frame in frames:
            let = []
            for k, t in zip(frame["key"], frame["at"], strict=True):
                if k != last:
                    last, recent = k, []
                let += allowed([t], most, window, recent)
            yield pd.DataFrame({"event_id": frame["event_id"], "allowed": let})

    rows = events.select("event_id", C(key).alias("key"), F.unix_micros(C(time).cast("timestamp")).cast("double").alias("us"))
    rows = rows.select("event_id", "key", (C("us") / 1e6).alias("at"))
    return rows.repartition("key").sortWithinPartitions("key", "at", "event_id").mapInPandas(run, "event_id long, allowed boolean")

"""One claim through all sources, for all claims at once: guards, assertions, statements, computation, and the walk.

A node is a claim or a claim with slots replaced along the hierarchy. Each level looks up all open nodes in all sources, and
claims that a level decides aren't carried on. The claims that nothing decides are extended by neighbours whose edge is
confirmed, and only in the directions in which the predicate's distribution carries a verdict.

What the nodes of a level say together follows rollup.level_verdict(): a contradiction wins. But a stand-in that is
contradicted says nothing about the claim itself (the firm isn't in this nation, but may be elsewhere in the continent). So
stand-ins never contradict a claim: one that some verify and others contradict abstains for that conflict, and those that
are only contradicted aren't carried on.

The walk writes a few tables a level: nodes with their marks, what the sources say, those left open, and the steps to the next
nodes. A step points from the new node back to the one it was made of, so the premises of a verdict are read off by joining
backwards from the deciding nodes.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import dates, text
from factweave.operators import graph, kb, party, rollup
from factweave.sources.scratch import settle, settle_all

C = F.col
NODE = ["node_id", "claim_id", "party", "subject", "predicate", "object", "polarity", "valid_from", "valid_until", "external", "given"]


@dataclass(frozen=True)
class Sources:
    """The tables that verify() reads. Paths are closures; the rest is as in the views of the same names."""

    predicates: DataFrame
    bindings: DataFrame
    assertions: DataFrame
    statements: DataFrame
    labels: DataFrame
    edges: DataFrame
    part_of: DataFrame
    is_a: DataFrame
    taxonomy: DataFrame
    distributions: DataFrame
    nogoods: DataFrame
    now: str
    identifier: str | None = None  # the shape of texts that are entities of their own


@dataclass(frozen=True)
class Budget:
    """Levels (the claim's own among them), incoming neighbours of a node that the graph may offer, and limits for each claim.

    work counts what sources are asked: LOOKUP for each node that external sources are asked about, ENUMERATION for each node
    whose neighbours are listed, PROBE for each new neighbour. probes are the new neighbours alone, frontier the nodes that
    come of them. None is no limit. A claim that runs out abstains with the limit as its reason, whatever is left to look at.
    """

    depth: int = 4
    incoming: int | None = 20
    work: int | None = None
    probes: int | None = None
    frontier: int | None = None

    @property
    def most(self) -> int | None:
        """So many new nodes of a claim use up some limit at the latest."""
        limits = [x for x in (self.work, self.probes, self.frontier) if x is not None]
        return min(limits) + 1 if limits else None


LOOKUP, ENUMERATION, PROBE = 4, 1, 1

#: So many first letters tell which texts can't be names.
INITIAL = 2


def initial(c: Column) -> Column:
    return F.substring(c, 1, INITIAL)


def metadata(predicates: DataFrame) -> DataFrame:
    """One row for each predicate, the first by id."""
    return predicates.groupBy("predicate").agg(F.min_by(F.struct("property", "object_type", "routing_hint", "single_valued", "is_location", "user_subject"), "id").alias("it")).select("predicate", "it.*")


def siblings(predicates: DataFrame) -> DataFrame:
    """predicate, sibling: the first other predicate, by id, that has the same property."""
    one = metadata(predicates).select("predicate", "property")
    other = predicates.select("property", C("predicate").alias("sibling"), "id")
    return one.join(other, "property").where(C("sibling") != C("predicate")).groupBy("predicate").agg(F.min_by("sibling", "id").alias("sibling"))


def guards(claims: DataFrame, s: Sources) -> DataFrame:
    """claims with short (the reason not to look at all), external (whether other sources may be asked), given (an assertion for sure).

    A reason from extraction comes first; a predicate of the party about itself may be used of nobody else but the party's
    personas. What a party says about itself or a persona rests on its word alone.
    """
    personas = s.assertions.where(party.is_current(s.now) & (C("polarity") == 1) & (C("subject") == "user") & (C("predicate") == "identity"))
    personas = settle(personas.select("party", C("object").alias("subject")).distinct(), "personas").withColumn("persona", F.lit(True))  # few: then the claims stay where they are
    rows = claims.join(metadata(s.predicates).select("predicate", "routing_hint", "user_subject"), "predicate", "left").join(personas, ["party", "subject"], "left")
    persona = F.coalesce("persona", F.lit(False))
    stranger = F.coalesce("user_subject", F.lit(False)) & (C("subject") != C("party")) & ~persona
    own = persona | F.coalesce(C("routing_hint") == "user_authoritative", F.lit(False))
    short = F.coalesce("abstention_reason", F.when(stranger, "user_subject_required"))
    return rows.select(*claims.columns, short.alias("short"), (~own).alias("external"), own.alias("given"))


@dataclass(frozen=True)
class Prepared:
    """What all levels look up, worked out and written once, so that a level's plan scans tables and joins them."""

    sources: Sources
    meta: DataFrame  # by predicate: property, object_type, routing_hint, functional, is_location, sibling, bound (whether it has bindings)
    told: DataFrame  # by KEY and object: the first current row of each polarity, asserted and denied (struct of id, status)
    spoken: DataFrame  # predicate: those that any current row has
    others: DataFrame  # by KEY: the first two current positive rows with different objects
    names: DataFrame  # label, id
    initials: DataFrame  # initial: the first letters (INITIAL) that any label has
    place: DataFrame
    classes: DataFrame  # node, lower-cased class
    ends: DataFrame  # by KEY: the one asserted start or end
    intervals: DataFrame
    amounts: DataFrame
    held: DataFrame  # statements as compare() looks them up
    near: DataFrame  # held, relation, way, neighbour, source_row of the taxonomy, without vetoed ones
    far: DataFrame  # held, relation, way, neighbour, confirmed_by of the graph, admitted ones
    forward: DataFrame  # KEY, neighbour, source_row, object: asserted objects and the names of what they lie inside
    ways: DataFrame  # predicate, polarity, relation, way: where neighbours may stand in
    routes: tuple[str, ...]  # of the predicates that the walk can carry on


def prepare(s: Sources, budget: Budget | None = None) -> Prepared:
    """budget: for the walk, else None where only claims themselves are looked up."""
    bound = s.bindings.groupBy("predicate").agg((F.count(F.lit(1)) == 1).alias("sole"))
    first = {"assertions": s.assertions.where(party.is_current(s.now)), "labels": s.labels, "predicates": s.predicates, "bindings": s.bindings.join(bound, "predicate"), "ways": ways_of(s.distributions)}
    if budget is not None:
        first |= {"taxonomy": s.taxonomy, "nogoods": s.nogoods}
    made = settle_all(**first, names=kb.chosen(s.labels))
    ways, names, place = made.pop("ways"), made.pop("names"), graph.place_table(s.part_of, s.is_a)
    s = replace(s, **made)
    meta = metadata(s.predicates).join(siblings(s.predicates), "predicate", "left")
    meta = settle(meta.select("predicate", "property", "object_type", "routing_hint", C("single_valued").alias("functional"), "is_location", "user_subject", "sibling").join(s.bindings.select("predicate", F.lit(True).alias("bound")).distinct(), "predicate", "left"), "meta")
    rest = _asserted(s) | {
        "initials": names.select(initial(C("label")).alias("initial")).distinct(),
        "classes": s.is_a.select("src", F.lower("dst").alias("class")).distinct(), "intervals": kb.intervals(s.statements.join(meta.where("routing_hint = 'kb_interval'").select("property").distinct(), "property", "left_semi")),
        "held": kb.with_values(s.statements.join(s.bindings.select("property").distinct(), "property", "left_semi"), place, s.labels),
    }
    nothing, routes = s.labels.limit(0), ()
    if budget is not None:
        far = admitted(edge_ways(names.select(C("label").alias("held")), s, names, budget.incoming), s, names)
        rest |= {"near": vetoed(taxonomy_ways(s.taxonomy), s, names), "far": far, "forward": _forward(s, names, ways)}
        routes = tuple(r["routing_hint"] for r in meta.join(ways, "predicate", "left_semi").select("routing_hint").distinct().collect())
    return Prepared(sources=s, meta=meta, names=names, place=place, ways=ways, routes=routes, amounts=kb.known_amounts(s.statements, meta.where("routing_hint = 'kb_quantitative'")), **({"near": nothing, "far": nothing, "forward": nothing} | settle_all(**rest)))


def _asserted(s: Sources) -> dict[str, DataFrame]:
    """What levels look up of current assertions."""
    current = s.assertions
    row = F.struct("id", "status")
    of = lambda polarity: F.min(F.when(C("polarity") == polarity, row))
    said = current.where((C("polarity") == 1) & C("predicate").rlike("_(started|ended)$")).groupBy(*party.KEY).agg(F.count_distinct("object").alias("n"), F.min("object").alias("asserted"))
    return {"spoken": current.select("predicate").distinct(), "told": current.groupBy(*party.KEY, "object").agg(of(1).alias("asserted"), of(0).alias("denied")), "others": party.first_two(current.where("polarity = 1")), "ends": said.where("n = 1").drop("n")}


def _forward(s: Sources, names: DataFrame, ways: DataFrame) -> DataFrame:
    objects = s.assertions.where("polarity = 1").groupBy(*party.KEY, C("object").alias("neighbour")).agg(F.min("id").alias("source_row"))
    upward = ways.where("relation = 'part_of' AND way = 'child' AND polarity = 1").select("predicate").distinct()
    ids = names.select(C("label").alias("neighbour"), C("id").alias("src"))
    around = names.select(C("label").alias("object"), C("id").alias("dst")).join(s.part_of.select("dst").distinct(), "dst", "left_semi")
    return objects.join(upward, "predicate", "left_semi").join(ids, "neighbour").join(s.part_of.select("src", "dst"), "src").join(around, "dst").drop("src", "dst")


def prepare_after(p: Prepared, retractions: DataFrame) -> Prepared:
    """What prepare() for a walk gives after retractions: only what hangs on assertions and the taxonomy is worked out again.

    Edges of the graph that a path confirms stay; those that only a row did need one that is left.
    """
    made = without_rows(p.sources, retractions)
    made = settle_all(assertions=made.assertions.where("NOT retracted"), taxonomy=made.taxonomy)
    s, edge = replace(p.sources, **made), ["held", "relation", "way", "neighbour"]
    rows = taxonomy_ways(s.taxonomy)
    far = p.far.where("confirmed_by = 'path'").unionByName(p.far.where("confirmed_by = 'row'").join(rows.select(*edge), edge, "left_semi").select(*p.far.columns))
    return replace(p, sources=s, **settle_all(**_asserted(s), near=vetoed(rows, s, p.names), far=far, forward=_forward(s, p.names, p.ways)))


def stand_ins(p: Prepared) -> Prepared:
    """p with what nodes of later levels can meet: those have only predicates that are carried along some relation."""
    mine = p.ways.select("predicate").distinct()
    told = mine.union(p.meta.join(mine, "predicate", "left_semi").where("sibling IS NOT NULL").select("sibling")).distinct()
    asked = p.sources.bindings.join(mine, "predicate", "left_semi").select("property").distinct()
    few = settle_all(mine=mine, told=told, asked=asked)
    return replace(p, told=p.told.join(few["told"], "predicate", "left_semi"), others=p.others.join(few["mine"], "predicate", "left_semi"), held=p.held.join(few["asked"], "property", "left_semi"))


#: What described() adds beside a predicate's metadata.
MARKS = ["property", "object_type", "routing_hint", "functional", "is_location", "sibling", "bound", "spoken", "named", "vague_object", "vague_subject"]


def described(nodes: DataFrame, p: Prepared) -> DataFrame:
    """nodes with MARKS: their predicate's metadata, and whether parties speak of it (or its sibling), slots are vague, and ids are to be looked up.

    Written with the nodes, this is worked out once; each source then reads its own nodes by it. Ids of subjects are looked up
    for statements, amounts, intervals and vague classes, of objects for statements, but not of texts that begin as no label does.
    """
    no, rows = F.lit(False), nodes.join(p.meta.drop("user_subject"), "predicate", "left")
    for c in ("subject", "object"):
        rows = rows.join(p.initials.select(C("initial").alias(f"_{c}"), F.lit(True).alias(f"_{c}_like")), initial(C(c)) == C(f"_{c}"), "left")
    rows = rows.join(p.spoken.select("predicate", F.lit(True).alias("_own")), "predicate", "left").join(p.spoken.select(C("predicate").alias("sibling"), F.lit(True).alias("_as_sibling")), "sibling", "left")
    rows = rows.withColumns({"bound": F.coalesce("bound", no), "spoken": F.coalesce("_own", "_as_sibling", no), "vague_object": text.is_vague(C("object")), "vague_subject": text.is_vague(C("subject"))})
    by_id = C("bound") | C("routing_hint").isin("kb_quantitative", "kb_interval") | ((C("polarity") == 1) & C("vague_object"))
    return rows.select(*nodes.columns, *[c for c in MARKS if c not in ("named", "vague_object", "vague_subject")], F.coalesce((by_id & C("_subject_like")) | (C("bound") & C("_object_like")), no).alias("named"), "vague_object", "vague_subject")


def resolved(nodes: DataFrame, p: Prepared) -> DataFrame:
    """described() nodes with the ids of their slots, where some source looks these up; the others meet no label."""
    found = settle(kb.resolve_by(nodes.where("named"), p.names, p.sources.identifier), "resolved")
    return found.unionByName(nodes.where("NOT named").select(*nodes.columns, *[kb.own_id(c, p.sources.identifier).alias(f"{c}_id") for c in ("subject", "object")]))


def vague_instances(rows: DataFrame, p: Prepared) -> DataFrame:
    """node_id of positive nodes "x is ... a town that ...": the class noun is a class of the graph that the subject belongs to."""
    asked = rows.where((C("polarity") == 1) & C("vague_object") & C("subject_id").isNotNull()).select("node_id", C("subject_id").alias("src"), F.lower(text.vague_head(C("object"))).alias("class"))
    return asked.where("class IS NOT NULL").join(p.classes, ["src", "class"], "left_semi").select("node_id").distinct()


def by_interval(rows: DataFrame, p: Prepared) -> DataFrame:
    """node_id, known, said (by an assertion), unique, verdict: starts and ends against the statements' interval.

    Sides that the interval leaves open are filled from assertions; these alone are unique only where there is no interval.
    """
    asked = rows.where("routing_hint = 'kb_interval'")
    spans = p.intervals.select(C("entity").alias("subject_id"), "property", F.lit(True).alias("_has"), "start", "end", "end_known", "unique_interval")
    found = asked.join(spans, ["subject_id", "property"], "left").join(p.ends, party.KEY, "left")
    side = F.when(C("predicate").endswith("_ended"), F.when(C("end_known"), C("end"))).otherwise(C("start"))
    found = found.select("node_id", "polarity", "functional", F.coalesce(side, "asserted").alias("known"), side.isNull().alias("said"), F.when(C("_has"), C("unique_interval")).otherwise(C("asserted").isNotNull()).alias("unique"),
        dates.parts(C("object")).alias("_claimed"), dates.parts(F.coalesce(side, "asserted")).alias("_known"))
    found = found.withColumn("_relation", dates.relation_of(C("_claimed"), C("_known")))
    verdict = F.when(C("_relation") == "match", "verified").when(C("functional") & C("unique") & (C("_relation") == "mismatch"), "contradicted")
    return found.select("node_id", "known", "said", "unique", text.flip(verdict, C("polarity")).alias("verdict"))


SIGNALS = ("value_known", "functional_value_known", "functional_entity")


ROUTES = ("kb_quantitative", "kb_interval", "kb_resolvable", "python")


def said_of(source: str | None, verdict: Column, keep: tuple[str, ...] = (), **more: Column) -> list[Column]:
    """The columns of external(), from a source's own; keep: further ones that are passed on."""
    no, none = F.lit(False), F.lit(None).cast("string")
    return [C("node_id"), verdict.alias("verdict"), F.lit(source).cast("string").alias("source"), *[more.get(c, none).alias(c) for c in ("reason", "value")], *[F.coalesce(more.get(c, no), no).alias(c) for c in ("unconfirmed", "said", *SIGNALS)], *keep]


def by_statements(rows: DataFrame, p: Prepared, keep: tuple[str, ...] = ()) -> DataFrame:
    """external() for rows that statements may speak to. Only claims with several bindings have something to be put together."""
    s, kept = p.sources, ("sole", *keep)
    bound = kb.bind_with(rows.withColumn("claim_id", C("node_id")), s.bindings, kept)
    gated = settle(kb.gate(kb.compare(bound, p.held, s.part_of, p.place, F.to_date(F.lit(s.now[:10])), kept), kb.kinds(bound, s.is_a), kept), "gated")
    told = kb.ground_sole(gated.where("sole"), keep).unionByName(kb.ground(gated.where("NOT sole"), keep)).withColumnRenamed("claim_id", "node_id")
    return told.select(*said_of("kb", F.when(C("verdict") != "no_match", C("verdict")), keep, reason=C("reason"), value=C("contradicting_value"), unconfirmed=C("unconfirmed"), **{c: C(c) for c in SIGNALS}))


def by_others(rows: DataFrame, p: Prepared, routes: tuple[str, ...] = ROUTES) -> list[DataFrame]:
    """external() of the other sources, each for its own rows."""
    of, found = lambda route: rows.where(C("routing_hint") == route), []
    if "kb_quantitative" in routes:
        found.append(kb.with_quantity(of("kb_quantitative"), p.amounts, "_verdict").select(*said_of("kb_quantitative", C("_verdict"), value=F.when(C("_verdict") == "contradicted", C("known").cast("string")))))
    if "kb_interval" in routes:
        found.append(by_interval(rows, p).select(*said_of("kb_interval", C("verdict"), said=C("said"))))
    if "python" in routes:
        found.append(text.with_computed_verdict(of("python"), "_verdict").select(*said_of("python", C("_verdict"))))
    return found


def external(rows: DataFrame, p: Prepared, routes: tuple[str, ...] = ROUTES) -> DataFrame:
    """node_id, verdict, source, reason, value, unconfirmed, said and the signals of statements, for resolved() rows.

    A predicate's route names the one source that may decide: quantities, intervals, statements or computation. routes: those
    that the rows may have; sources of others aren't asked.
    """
    asked = rows.where("external")
    found = by_others(asked, p, routes)
    if "kb_resolvable" in routes:
        found.append(by_statements(asked.where("bound AND routing_hint = 'kb_resolvable'"), p))
    return reduce(DataFrame.unionByName, found or [asked.limit(0).select(*said_of(None, F.lit(None).cast("string")))])


def direct(rows: DataFrame, p: Prepared, routes: tuple[str, ...] = ROUTES, whole: bool = False) -> DataFrame:
    """node_id, claim_id, verdict (null if nothing speaks to the node), source, given, premise, reason, value, unconfirmed, vague_subject, signals.

    The order: a current assertion of the negation contradicts; an instance of a vague class verifies; another asserted object
    of a functional predicate contradicts; a matching assertion, or one under a sibling predicate, verifies: plainly if it is
    externally verified, as given if it is the party's own affair, upgraded if an external source verifies too, else as
    given; then the external sources. rows: resolved(); whole: they are claims themselves, so that node_id is claim_id.

    Nodes are looked up only where something may be found: assertions where a predicate has any, what sources say by node only
    where a node has both or several.
    """
    no, positive = F.lit(False), C("polarity") == 1
    by_itself = [route for route in (*PLAIN, *(["kb_resolvable"] if whole else [])) if route in routes]
    by_kb = C("routing_hint") == "kb_resolvable"
    asks = C("external") & F.coalesce(F.when(by_kb, C("bound")).otherwise(C("routing_hint").isin(*ROUTES)), no)
    rows = rows.withColumns({"alone": F.coalesce(~C("spoken") & C("routing_hint").isin(*by_itself) & ~C("vague_object"), no), "_asks": F.coalesce(asks, no)})
    plain = [plainly(rows.where("alone"), p, route) for route in by_itself if route in PLAIN]
    outer = by_others(rows.where("NOT alone AND _asks"), p, routes)
    if "kb_resolvable" in routes:
        keep = ("alone", "vague_subject")
        told = by_statements(rows.where("_asks").where(by_kb), p, keep)
        outer.append(told.where("NOT alone").drop(*keep))
        if whole:
            shown = lambda c: F.when(C("verdict").isNotNull(), C(c)).alias(c)
            plain.append(told.where("alone").select("node_id", C("node_id").alias("claim_id"), "verdict", shown("source"), no.alias("given"), F.lit(None).cast("long").alias("premise"), "reason", shown("value"),
                F.coalesce(C("verdict").isNotNull() & C("unconfirmed"), no).alias("unconfirmed"), "vague_subject", *SIGNALS))
            plain.append(unsaid(rows.where("alone AND NOT _asks").where(by_kb)))
    outer = reduce(DataFrame.unionByName, outer or [rows.limit(0).select(*said_of(None, F.lit(None).cast("string")))]).withColumnsRenamed({"verdict": "outer", "source": "outer_source"})
    key = [*party.KEY, "object"]
    broad = p.told.select("party", "subject", C("predicate").alias("sibling"), "object", C("asserted").alias("_yes"), C("denied").alias("_no"))
    other = p.others.withColumnsRenamed({"first": "_first", "second": "_second"})
    rest = rows.where("NOT alone")
    instances = vague_instances(rest, p).withColumn("_vague", F.lit(True))
    lean = rest.select("node_id", "claim_id", *key, "polarity", "sibling", "given", "functional", "spoken", "_asks", "vague_object", "vague_subject")
    briefly = C("spoken") & C("sibling").isNull() & ~(positive & F.coalesce("functional", no)) & ~C("_asks") & ~C("vague_object")
    briefly = F.coalesce(briefly, no)
    brief = lean.where(briefly).join(p.told, key, "left")
    said = lean.where(C("spoken") & ~briefly).join(p.told, key, "left").join(broad, ["party", "subject", "sibling", "object"], "left").join(other, party.KEY, "left")
    found = said.unionByName(lean.where(~C("spoken")), allowMissingColumns=True).join(instances, "node_id", "left").join(outer, "node_id", "left")
    found = found.unionByName(brief, allowMissingColumns=True)
    found = found.withColumns({
        "_match": F.coalesce(F.when(positive, C("asserted")).otherwise(C("denied")), F.when(positive, C("_yes")).otherwise(C("_no"))), "_against": F.when(positive, C("denied")).otherwise(C("asserted")),
        "_other": F.when(positive, F.when(C("_first.object") != C("object"), C("_first")).otherwise(C("_second")))})
    conflict = C("_other").isNotNull() & F.coalesce("functional", no) & ~C("vague_object")
    case = F.when(C("_against").isNotNull(), "negated").when(C("_vague"), "instance").when(conflict, "conflict").when(C("_match").isNotNull(), "match").when(C("outer").isNotNull(), "outer")
    found = found.withColumn("_case", case)
    premise = F.when(C("_case") == "negated", C("_against")).when(C("_case") == "conflict", F.struct("_other.id", "_other.status")).when(C("_case") == "match", C("_match"))
    upgraded = F.coalesce((C("_case") == "match") & (C("_match.status") != party.FIRM) & ~C("given") & (C("outer") == "verified"), no)
    found = found.withColumns({"_premise": premise, "_upgraded": upgraded})
    as_given = C("given") | F.coalesce((C("_premise.status") != party.FIRM) & ~C("_upgraded"), no) | ((C("_case") == "outer") & F.coalesce("said", no))
    verdict = F.when(C("_case").isin("negated", "conflict"), "contradicted").when(C("_case").isin("instance", "match"), "verified").when(C("_case") == "outer", C("outer"))
    source = F.when(C("_case") == "instance", "kb").when(C("_case") == "outer", C("outer_source")).when(C("_upgraded"), "tier_u_upgrade").when(C("_case").isNotNull(), "tier_u")
    value = F.when(C("_case") == "conflict", C("_other.object")).when(C("_case") == "outer", C("value"))
    told = found.select("node_id", "claim_id", verdict.alias("verdict"), source.alias("source"), F.coalesce(as_given, no).alias("given"), C("_premise.id").alias("premise"), "reason", value.alias("value"),
        F.coalesce((C("_case") == "outer") & C("unconfirmed"), no).alias("unconfirmed"), "vague_subject", *[F.coalesce(c, no).alias(c) for c in SIGNALS])
    return reduce(DataFrame.union, [told, *plain])


#: Routes to sources that say at most one thing of a node, by itself.
PLAIN = ("kb_quantitative", "python")


def plainly(rows: DataFrame, p: Prepared, route: str) -> DataFrame:
    """direct() for nodes that nothing but their route's source can speak to: without looking their verdicts up by node."""
    rows = rows.where(C("routing_hint") == route)
    if route == "python":
        told = text.with_computed_verdict(rows, "_verdict").withColumn("_value", F.lit(None).cast("string"))
    else:
        told = kb.with_quantity(rows, p.amounts, "_verdict").withColumn("_value", F.when(C("_verdict") == "contradicted", C("known").cast("string")))
    return unsaid(told.withColumn("_asked", C("external") & C("_verdict").isNotNull()), C("_verdict"), route, C("_value"), C("_asked"))


def unsaid(rows: DataFrame, verdict: Column | None = None, source: str | None = None, value: Column | None = None, shown: Column | None = None) -> DataFrame:
    """direct() for nodes to which nothing speaks, or (where shown) one source by a verdict and value."""
    none, no = F.lit(None).cast("string"), F.lit(False)
    of = lambda c: none if c is None else F.when(shown, c)
    return rows.select("node_id", "claim_id", of(verdict).alias("verdict"), of(None if source is None else F.lit(source)).alias("source"), F.coalesce("given", no).alias("given"), F.lit(None).cast("long").alias("premise"),
        none.alias("reason"), of(value).alias("value"), no.alias("unconfirmed"), "vague_subject", *[no.alias(c) for c in SIGNALS])


def ways_of(distributions: DataFrame) -> DataFrame:
    """predicate, polarity, relation, way (child or parent): where the first live distribution row lets a neighbour stand in."""
    first = distributions.where("NOT retracted").groupBy("predicate", "polarity", "relation").agg(F.min_by("verdict", "id").alias("verdict"))
    way = F.when(C("verdict") == "up", F.array(F.lit("child"))).when(C("verdict") == "down", F.array(F.lit("parent"))).when(C("verdict") == "both", F.array(F.lit("child"), F.lit("parent")))
    return first.select("predicate", "polarity", "relation", F.explode(way).alias("way"))


def carried(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """node_id, relation, way: how neighbours may stand in for a node's slots. ways: ways_of()."""
    return nodes.select("node_id", "predicate", "polarity").join(ways, ["predicate", "polarity"]).select("node_id", "relation", "way")


def slots(nodes: DataFrame) -> DataFrame:
    """node_id, slot, held: both slots of a node that aren't empty."""
    each = F.explode(F.array(F.struct(F.lit("subject").alias("slot"), C("subject").alias("held")), F.struct(F.lit("object").alias("slot"), C("object").alias("held"))))
    return nodes.select("node_id", each.alias("it")).select("node_id", "it.*").where("held <> ''")


def taxonomy_ways(taxonomy: DataFrame) -> DataFrame:
    """held, relation, way, neighbour, source_row: both readings of each live row that subsumes."""
    rows = taxonomy.where("NOT retracted")
    up = F.when(C("verdict").isin("a_subsumed_by_b", "equivalent"), "parent").when(C("verdict") == "b_subsumed_by_a", "child")
    down = F.when(C("verdict").isin("b_subsumed_by_a", "equivalent"), "parent").when(C("verdict") == "a_subsumed_by_b", "child")
    both = rows.select(C("a").alias("held"), "relation", up.alias("way"), C("b").alias("neighbour"), "id").union(rows.select("b", "relation", down, "a", "id"))
    return both.where("way IS NOT NULL").groupBy("held", "relation", "way", "neighbour").agg(F.min("id").alias("source_row"))


def _ends(candidates: DataFrame, names: DataFrame) -> DataFrame:
    """candidates with source and target: the ids of the lower and the upper end of their edge, null where a name has none."""
    ids = lambda c: names.select(C("label").alias(c), C("id").alias(f"{c}_id"))
    rows = candidates.join(ids("held"), "held", "left").join(ids("neighbour"), "neighbour", "left")
    down = C("way") == "child"
    return rows.withColumns({"source": F.when(down, C("neighbour_id")).otherwise(C("held_id")), "target": F.when(down, C("held_id")).otherwise(C("neighbour_id"))})


def vetoed(candidates: DataFrame, s: Sources, names: DataFrame) -> DataFrame:
    """candidates (held, relation, way, neighbour, ...) without those whose edge a live nogood forbids."""
    barred = s.nogoods.where("NOT retracted").select("relation", "source", "target").distinct()
    return _ends(candidates, names).join(barred, ["relation", "source", "target"], "left_anti").select(*candidates.columns)


def admitted(candidates: DataFrame, s: Sources, names: DataFrame) -> DataFrame:
    """candidates (held, relation, way, neighbour, ...) whose edge is confirmed, with confirmed_by.

    A live nogood vetoes an edge. Then a path of the graph from the lower to the upper end confirms it, or a row of the
    taxonomy that says so. An edge that neither confirms, such as a bridge between what aren't both regions, isn't admitted.
    Whether the predicate carries along the relation is for ways_of() to say: no neighbour of a relation that it doesn't
    carry along is listed at all.
    """
    paths = s.is_a.select(F.lit("is_a").alias("relation"), C("src").alias("source"), C("dst").alias("target")).union(s.part_of.select(F.lit("part_of"), "src", "dst")).withColumn("_path", F.lit(True))
    rows = taxonomy_ways(s.taxonomy).select("held", "relation", "way", "neighbour", F.lit(True).alias("_row"))
    told = _ends(vetoed(candidates, s, names), names).join(paths, ["relation", "source", "target"], "left").join(rows, ["held", "relation", "way", "neighbour"], "left")
    by = F.when(C("_path"), "path").when(C("_row"), "row")
    return told.where("_path OR _row").select(*candidates.columns, by.alias("confirmed_by"))


def futile() -> Column:
    """Whether the graph's neighbours along a relation can't help, by the signals of the node."""
    return C("functional_entity") | ((C("relation") == "part_of") & C("value_known")) | ((C("relation") == "is_a") & C("functional_value_known"))


def discover(nodes: DataFrame, p: Prepared, budget: Budget, telling: bool = False) -> DataFrame:
    """STEP rows: the nodes that may stand in for nodes (with SIGNALS), how each was made, and of which.

    Neighbours come from the taxonomy, where a row itself confirms the edge; where a node has none for a relation, from the
    graph, unless that is futile (the predicate is functional, or the values are known already); and forward from what the
    party asserted of the subject, where that lies inside the object. With a limit, no more neighbours of a slot are listed
    than use it up, the first by name.

    Nodes keep their columns all along, so none is looked up by node: whether the taxonomy has a neighbour follows from its
    slots, the relation and the ways. telling: without such nodes of the graph's that telling_places() leaves out.
    """
    ways = p.ways.groupBy("predicate", "polarity", "relation").agg(F.collect_set("way").alias("_ways"))
    listed = p.near.groupBy("held", "relation").agg(F.collect_set("way").alias("_listed"))
    rows, has = nodes.select(*NODE, *SIGNALS).join(ways, ["predicate", "polarity"]), F.lit(False)
    for slot in ("subject", "object"):
        rows = rows.join(listed.where("held <> ''").select(C("held").alias(slot), "relation", C("_listed").alias(f"_{slot}")), [slot, "relation"], "left")
        has = has | F.coalesce(F.arrays_overlap("_ways", f"_{slot}"), F.lit(False))
    each = F.explode(F.array(F.struct(F.lit("subject").alias("slot"), C("subject").alias("held")), F.struct(F.lit("object").alias("slot"), C("object").alias("held"))))
    rows = rows.where(has | ~futile()).select(*NODE, "relation", "_ways", has.alias("_has"), each.alias("_slot"))
    places = rows.select(*NODE, "relation", "_has", "_slot.*", F.explode("_ways").alias("way")).where("held <> ''")
    first = Window.partitionBy("held", "relation", "way").orderBy("neighbour")
    few = lambda rows: rows if budget.most is None else rows.withColumn("_n", F.row_number().over(first)).where(C("_n") <= budget.most).drop("_n")
    columns = (*NODE, "slot", "held", "neighbour", "found_by", "source_row")
    near = places.where("_has").join(few(p.near), ["held", "relation", "way"]).withColumn("found_by", F.lit("taxonomy"))
    open_ = places.where("NOT _has")
    far = (telling_places(open_, p) if telling else open_.join(few(p.far), ["held", "relation", "way"])).withColumns({"found_by": F.lit("graph"), "source_row": F.lit(None).cast("long")})
    rows = near.select(*columns).union(far.select(*columns)).union(premise_forward(nodes.select(*NODE), p).select(*columns)).withColumnRenamed("node_id", "parent")
    put = lambda slot: F.when(C("slot") == slot, C("neighbour")).otherwise(C(slot))
    rows = rows.withColumns({"_s": put("subject"), "_o": put("object")}).withColumns({"subject": C("_s"), "object": C("_o")})
    return rows.withColumn("node_id", node_key(C("claim_id"), C("subject"), C("object"))).select(*STEP)


STEP = [*NODE, "parent", "slot", "held", "neighbour", "found_by", "source_row"]


def telling_places(places: DataFrame, p: Prepared) -> DataFrame:
    """places (NODE, relation, way, slot, held) with the graph's neighbours, but for objects that nothing can speak to and that lead nowhere.

    All claims about a hub times all that lies inside it are too many to be asked one by one. A node with another object is
    met by what was asserted of its subject and that object, or of its subject where one object excludes others; by
    statements of its subject, or of its object where a binding is inverted; by the other routes; as a vague class; and it
    leads on where a neighbour or a forward assertion can stand in for one of its slots. What is known by subject keeps all
    neighbours; else only those are joined that are asserted or lead on themselves. What is left out has no verdict and no
    neighbours, so the walk decides the same without it. Other subjects are all kept.
    """
    place, no = ["held", "relation", "way"], F.lit(False)
    asked = settle(places.select("predicate", "polarity").distinct(), "asked")
    ways = settle(p.ways.join(asked, ["predicate", "polarity"]), "ways")
    listed = p.near.select(*place).union(p.far.select(*place)).distinct()
    leads = settle(listed.join(ways, ["relation", "way"]).select("held", "predicate", "polarity").distinct(), "leads")
    inverted = p.sources.bindings.groupBy("predicate").agg(F.bool_or("inverted").alias("_inverted"))
    ids = p.held.select("lookup").distinct()
    stated = ids.union(p.names.join(ids, C("id") == C("lookup"), "left_semi").select("label")).distinct().toDF("subject")
    flag = lambda rows, name: rows.withColumn(name, F.lit(True))
    rows = places.where("slot = 'object'").join(p.meta.select("predicate", "routing_hint", "functional", "sibling", "bound"), "predicate", "left").join(inverted, "predicate", "left")
    rows = rows.join(flag(stated, "_stated"), "subject", "left").join(flag(leads.withColumnRenamed("held", "subject"), "_leads"), ["subject", "predicate", "polarity"], "left")
    rows = rows.join(flag(p.others.select(*party.KEY), "_other"), party.KEY, "left")
    by_subject = C("_leads") | (C("functional") & C("_other")) | (C("bound") & (C("_inverted") | C("_stated"))) | (C("routing_hint").isin(*ROUTES) & (C("routing_hint") != "kb_resolvable"))
    rows = settle(rows.select(*places.columns, "sibling", F.coalesce(by_subject, no).alias("_every")), "places")
    every = places.where("slot <> 'object'").unionByName(rows.where("_every").select(*places.columns)).join(p.far, place)
    some = rows.where("NOT _every")
    vague = some.join(p.far.where(text.is_vague(C("neighbour"))), place)
    onward = p.far.join(ways, ["relation", "way"]).join(leads.withColumnRenamed("held", "neighbour"), ["neighbour", "predicate", "polarity"])
    onward = some.join(onward, [*place, "predicate", "polarity"])
    said = p.told.select(*party.KEY, C("object").alias("neighbour"))
    named = [some.join(said.union(p.forward.select(*party.KEY, "object")).distinct(), party.KEY), some.join(said.withColumnRenamed("predicate", "sibling"), ["party", "subject", "sibling"])]
    found = [one.select(*places.columns, "neighbour").join(p.far, [*place, "neighbour"]) for one in named]
    return reduce(DataFrame.unionByName, [one.select(*places.columns, "neighbour") for one in (vague, onward, *found)]).distinct().unionByName(every.select(*places.columns, "neighbour"))


def node_key(claim: Column, subject: Column, object_: Column) -> Column:
    """A text of its own for each claim and slots; the subject's length tells where it ends."""
    text_of = lambda c: F.coalesce(c, F.lit(""))
    return F.concat_ws("|", claim.cast("string"), F.length(text_of(subject)).cast("string"), text_of(subject), text_of(object_))


def edge_ways(asked: DataFrame, s: Sources, names: DataFrame, incoming: int | None) -> DataFrame:
    """held, relation, way, neighbour: labels along the graph's own edges of the names in asked (held), all outgoing ones and the first incoming ones by source (None: all).

    A task keeps the first ones of each node before they are dealt out, so a hub's edges don't meet in one task.
    """
    kinds = [s.edges.where(C("property").isin(*graph.NEIGHBOURS[r])).select("src", "dst", F.lit(r).alias("relation")) for r in ("is_a", "part_of")]
    edges = settle(kinds[0].union(kinds[1]).distinct(), "edges")
    rows = asked.distinct().join(names.select(C("label").alias("held"), "id"), "held")
    out = rows.join(edges, C("src") == C("id")).select("held", "relation", F.lit("parent").alias("way"), C("dst").alias("other"))
    back = rows.join(edges, C("dst") == C("id"))
    if incoming is not None:
        order = Window.partitionBy("held", "relation").orderBy("src")
        back = back.withColumn("_n", F.row_number().over(order)).where(C("_n") <= incoming)
    every = out.union(back.select("held", "relation", F.lit("child").alias("way"), C("src").alias("other")))
    label = s.labels.groupBy(C("kb_id").alias("other")).agg(F.min("label").alias("neighbour"))
    return every.join(label, "other").select("held", "relation", "way", "neighbour").distinct()


def premise_forward(nodes: DataFrame, p: Prepared) -> DataFrame:
    """nodes with slot, held, neighbour, found_by, source_row: objects that the party asserts of the subject and that lie inside the claimed one."""
    rows = nodes.where("polarity = 1").join(p.forward, [*party.KEY, "object"])
    return rows.select(*nodes.columns, F.lit("object").alias("slot"), C("object").alias("held"), "neighbour", F.lit("premise").alias("found_by"), "source_row")


REASONS = {"work": "budget_kb_work", "probes": "budget_kb_neighbor_probes", "frontier": "budget_fanout"}


def charge_lookups(nodes: DataFrame, ledger: DataFrame, budget: Budget) -> tuple[DataFrame, DataFrame]:
    """The nodes that a claim's work still allows to be looked up, in order of node_id, and the ledger after it.

    ledger: claim_id, work, probes, frontier, reason (null while the claim has some left).
    """
    cost = F.when(C("external"), LOOKUP).otherwise(0)
    order = Window.partitionBy("claim_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = nodes.join(ledger.select("claim_id", C("work").alias("_spent")), "claim_id").withColumn("_spent", C("_spent") + F.coalesce(F.sum(cost).over(order), F.lit(0)))
    rows = settle(rows.withColumn("_in", F.lit(True) if budget.work is None else C("_spent") < budget.work), "charged")
    sums = rows.groupBy("claim_id").agg(F.coalesce(F.sum(F.when(C("_in"), cost)), F.lit(0)).alias("_cost"), F.bool_and("_in").alias("_all"))
    after = ledger.join(sums, "claim_id", "left").withColumns({"work": C("work") + F.coalesce("_cost", F.lit(0)), "reason": F.when(~C("_all"), REASONS["work"]).otherwise(C("reason"))})
    return rows.where("_in").select(*nodes.columns), settle(after.select(*ledger.columns), "ledger")


def charge_steps(steps: DataFrame, asking: DataFrame, ledger: DataFrame, budget: Budget) -> tuple[DataFrame, DataFrame]:
    """The steps of the claims that can afford all of them, and the ledger after it. asking: claim_id of each node that lists neighbours."""
    listed = asking.groupBy("claim_id").agg((F.count(F.lit(1)) * ENUMERATION).alias("_listed"))
    order = Window.partitionBy("claim_id").orderBy("node_id")
    new = steps.select("claim_id", "node_id").distinct().withColumn("_n", F.row_number().over(order)).where(C("_n") <= budget.most)
    told = ledger.join(listed, "claim_id", "left").join(new.groupBy("claim_id").agg(F.max("_n").alias("_new")), "claim_id", "left")
    told = told.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("_listed", "_new")})
    after = told.withColumns({"work": C("work") + C("_listed") + PROBE * C("_new"), "probes": C("probes") + C("_new"), "frontier": C("frontier") + C("_new")})
    over = F.lit(None).cast("string")
    for name in ("frontier", "probes", "work"):
        if getattr(budget, name) is not None:
            over = F.when(C(name) > getattr(budget, name), REASONS[name]).otherwise(over)
    after = settle(after.withColumn("reason", F.coalesce("reason", F.when(C("_new") > 0, over))).select(*ledger.columns), "ledger")
    return steps.join(after.where("reason IS NULL").select("claim_id"), "claim_id", "left_semi"), after


@dataclass(frozen=True)
class Walk:
    """What a walk has written."""

    guarded: DataFrame  # claims with short, external, given
    decided: DataFrame  # claim_id, verdict, source, premise, value, unconfirmed, given, conflict, depth
    found: list[DataFrame]  # for each level what direct() says of its nodes
    steps: list[DataFrame]  # for each level but the first the STEP rows that lead to its nodes
    ledger: DataFrame | None  # claim_id, work, probes, frontier, reason; none without limits
    prepared: Prepared


def decide(found: DataFrame, depth: int) -> DataFrame:
    """claim_id, verdict, source, premise, value, unconfirmed, given, conflict, depth: the claims that a level's nodes decide."""
    right = C("verdict") == "verified"
    if depth == 0:  # a claim is one node, so nothing has to be put together
        told = found.where("verdict IS NOT NULL")
        return told.select("claim_id", rollup.level_verdict(right, ~right).alias("level"), "source", "premise", "value", "unconfirmed", "given").select("claim_id", "level.verdict", "source", "premise", "value", "unconfirmed", "given", "level.conflict", F.lit(depth).alias("depth"))
    order = F.struct((~right).alias("k"), "node_id")
    told = found.where("verdict IS NOT NULL").groupBy("claim_id").agg(
        rollup.level_verdict(F.bool_or(right), F.bool_or(~right)).alias("level"), F.min_by(F.struct("source", "premise", "value", "unconfirmed"), order).alias("it"),
        F.bool_or(F.when(right, C("given"))).alias("given"), F.bool_or(right).alias("_right"))
    told = told.where("_right")
    return told.select("claim_id", "level.verdict", "it.*", "given", "level.conflict", F.lit(depth).alias("depth"))


def walk(claims: DataFrame, s: Sources, budget: Budget = Budget()) -> Walk:
    return walk_by(claims, prepare(s, budget), budget)


def walk_by(claims: DataFrame, p: Prepared, budget: Budget) -> Walk:
    guarded = settle(described(guards(claims, p.sources), p), "guarded")
    nodes = guarded.where("short IS NULL").withColumn("node_id", C("claim_id")).select(*NODE, *MARKS)  # a claim is known by itself; only those carried on get a key
    ledger = None
    if budget.most is not None:
        zero = F.lit(0).cast("long")
        ledger = settle(nodes.select("claim_id", zero.alias("work"), zero.alias("probes"), zero.alias("frontier"), F.lit(None).cast("string").alias("reason")), "ledger")
    seen, decided, levels, steps = None, [], [], []
    later = stand_ins(p)
    carries = p.ways.select("predicate").distinct()
    for depth in range(budget.depth):
        if ledger is not None:
            nodes, ledger = charge_lookups(nodes, ledger, budget)
        found = settle(direct(resolved(nodes, p), later if depth else p, p.routes if depth else ROUTES, whole=not depth), "direct")
        levels.append(found)
        decided.append(decide(found, depth))
        if depth + 1 == budget.depth:
            break
        left = nodes.join(carries, "predicate", "left_semi").join(found.where("verdict IS NULL").select("node_id", *SIGNALS), "node_id")
        if depth:
            left = left.join(decided[-1].select("claim_id"), "claim_id", "left_anti")
        else:
            left = left.withColumn("node_id", node_key(C("claim_id"), C("subject"), C("object")))
        if ledger is not None:
            left = left.join(ledger.where("reason IS NULL").select("claim_id"), "claim_id", "left_semi")
        left = settle(left, "left")
        # new nodes are of the claims that are left, so only nodes of these can have been seen; at first that is the one they are made of
        wider = discover(left, p, budget, telling=budget.incoming is None and ledger is None)
        wider = wider.where(C("node_id") != C("parent")) if seen is None else wider.join(seen, "node_id", "left_anti")
        seen = left.select("node_id") if seen is None else seen
        if ledger is not None:
            asking = left.join(carried(left, p.ways).select("node_id").distinct(), "node_id", "left_semi").select("claim_id")
            wider, ledger = charge_steps(settle(wider, "wider"), asking, ledger, budget)
        wider = settle(wider, "steps")
        if wider.isEmpty():
            break
        nodes = settle(described(wider.select(*NODE).dropDuplicates(["node_id"]), p), "nodes")
        steps.append(wider)
        seen = seen.union(nodes.select("node_id"))
    return Walk(guarded, reduce(DataFrame.union, decided), levels, steps, ledger, p)


def outcome(w: Walk) -> DataFrame:
    """claim_id, verdict, base_verdict, source, reason, depth, given, premise, value, unconfirmed, conflict for each claim of a walk."""
    out_of = F.lit(None).cast("string")
    if w.ledger is None:  # all claims that aren't cut short were looked up: those decided there meet nothing else
        columns = ["claim_id", "verdict", "source", "premise", "value", "unconfirmed", "given", "_vague", "own", "short"]
        first = w.found[0].withColumnsRenamed({"vague_subject": "_vague"}).withColumns({"own": C("given"), "short": out_of})
        at_once = first.where("verdict IS NOT NULL").select(*columns, F.lit(False).alias("conflict"), F.lit(0).alias("depth"))
        walked = reduce(DataFrame.union, [decide(found, depth) for depth, found in enumerate(w.found) if depth] or [w.decided.limit(0)])
        later = first.where("verdict IS NULL").select("claim_id", "_vague", "own", "short").join(walked, "claim_id", "left")
        cut = w.guarded.where("short IS NOT NULL").select("claim_id", C("given").alias("own"), "short")
        rows = at_once.unionByName(later).unionByName(cut, allowMissingColumns=True)
    else:
        rows = w.guarded.select("claim_id", text.is_vague(C("subject")).alias("_vague"), "short", C("given").alias("own")).join(w.decided, "claim_id", "left")
        rows = rows.join(w.ledger.select("claim_id", C("reason").alias("_out")), "claim_id", "left")
        out_of = C("_out")
    no = F.lit(False)
    torn = F.coalesce("conflict", no) & (C("depth") > 0)
    vague = (C("verdict") == "contradicted") & C("_vague") & ~torn
    reason = F.when(C("short").isNotNull(), C("short")).when(torn, "conflicting_stand_ins").when(vague, "vague_subject_existential").when(C("verdict").isNull(), F.coalesce(out_of, F.lit("depth_exhausted")))
    base = F.when(reason.isNull(), C("verdict")).otherwise("no_grounding_found")
    given = C("short").isNull() & (C("own") | (F.coalesce("given", no) & ~torn))
    shown = lambda c: F.when(~torn, C(c)).alias(c)
    return rows.select("claim_id", F.when(given, F.concat(base, F.lit("_given_assertion"))).otherwise(base).alias("verdict"), base.alias("base_verdict"), shown("source"), reason.alias("reason"), "depth", given.alias("given"),
        shown("premise"), F.when(base == "contradicted", C("value")).alias("value"), F.coalesce("unconfirmed", no).alias("unconfirmed"), F.coalesce("conflict", no).alias("conflict"))


def verify(claims: DataFrame, s: Sources, budget: Budget = Budget()) -> DataFrame:
    """claim_id, verdict, base_verdict, source, reason, depth, given, premise, value, unconfirmed, conflict for each claim.

    claims: claim_id, subject, predicate, object, polarity, party, valid_from, valid_until, abstention_reason; claim_id is
    unique. conflict tells that one stand-in of the deciding level was verified and another contradicted: such a claim
    abstains. Contradictions of claims with a vague subject abstain. Verdicts that rest on an unverified assertion, or on the
    party's own word, are marked as given. A claim that nothing decides within the levels abstains as depth_exhausted, one
    that runs out of a limit with that as its reason.
    """
    return outcome(walk(claims, s, budget))


def alternatives(w: Walk) -> tuple[DataFrame, DataFrame]:
    """claim_id, alternative, literals of what verdicts rest on: of claims decided by themselves, which have one literal, and of the others.

    Each node of the deciding level that says what was decided is reached by one or more ways, and each way is an alternative:
    any of them is enough. Its literals (source, source_table, source_row_id, is_assertion) all have to hold: the steps from
    the claim to the node in order, then what speaks to the node. Alternatives are numbered in the order of their text. Claims
    torn by conflict have both sides' alternatives.
    """
    literal = lambda source, table, row, assertion: F.struct(source.alias("source"), table.cast("string").alias("source_table"), row.alias("source_row_id"), assertion.alias("is_assertion"))
    last = literal(C("source"), F.when(C("premise").isNotNull(), "assertions"), C("premise"), C("given"))
    own = w.found[0].where("verdict IS NOT NULL").select("claim_id", F.lit(1).alias("alternative"), F.array(last).alias("literals"))
    ways = [own.select("claim_id", "literals").limit(0)]
    for depth, found in enumerate(w.found):
        if depth == 0:
            continue
        told = decide(found, depth).select("claim_id", C("verdict").alias("_v"), "conflict")
        rows = found.join(told, "claim_id").where("verdict IS NOT NULL AND (verdict = _v OR conflict)").select("claim_id", "node_id", F.array(last).alias("literals"))
        for steps in reversed(w.steps[:depth]):
            kind, table = F.when(C("found_by") == "taxonomy", "substrate").when(C("found_by") == "graph", "kb").otherwise("tier_u"), F.when(C("found_by") == "taxonomy", "taxonomy").when(C("found_by") == "premise", "assertions")
            step = steps.select("node_id", "parent", literal(kind, table, C("source_row"), C("found_by") == "premise").alias("_step")).distinct()
            rows = rows.join(step, "node_id").select("claim_id", C("parent").alias("node_id"), F.concat(F.array("_step"), "literals").alias("literals"))
        ways.append(rows.select("claim_id", "literals"))
    every = reduce(DataFrame.union, ways).distinct()
    return own, every.withColumn("alternative", F.row_number().over(Window.partitionBy("claim_id").orderBy(term(C("literals"))))).select("claim_id", "alternative", "literals")


def premises(w: Walk) -> DataFrame:
    """claim_id, alternative, literal_index, source, source_table, source_row_id, is_assertion: alternatives() by literal."""
    own, every = alternatives(w)
    return own.union(every).select("claim_id", "alternative", F.posexplode("literals").alias("literal_index", "it")).select("claim_id", "alternative", "literal_index", "it.*")


def term(literals: Column) -> Column:
    """Literals as one text: source, table and row of each."""
    return F.array_join(F.transform(literals, lambda x: F.concat_ws(":", x["source"], F.coalesce(x["source_table"], F.lit("-")), F.coalesce(x["source_row_id"].cast("string"), F.lit("-")), F.when(x["is_assertion"], "given").otherwise("firm"))), " & ")


def touched(w: Walk, retractions: DataFrame, s: Sources, by_predicate: bool = False) -> DataFrame:
    """claim_id of the claims of a walk that retractions (source_table, row_id) can bear on: those with a node that a lookup of a retracted row meets.

    An assertion is looked up by party and subject (a persona also by what it names), a row of the taxonomy by its two ends.
    by_predicate: closer still, as an assertion is met under its own predicate and by claims whose sibling predicate that is.
    """
    gone = lambda table: retractions.where(C("source_table") == table).select(C("row_id").alias("id"))
    said = s.assertions.join(gone("assertions"), "id", "left_semi")
    named = said.where("predicate = 'identity'").select("party", C("object").alias("subject"))
    row = s.taxonomy.join(gone("taxonomy"), "id", "left_semi")
    ends = row.select(C("a").alias("held")).union(row.select("b")).distinct()
    nodes = w.guarded.select("claim_id", "party", "subject", "predicate", "object")
    for steps in w.steps:
        nodes = nodes.union(steps.select("claim_id", "party", "subject", "predicate", "object"))
    keys = ["party", "subject"]
    if by_predicate:
        as_sibling = said.join(w.prepared.meta.where("sibling IS NOT NULL").select(C("predicate").alias("_of"), "sibling"), C("predicate") == C("sibling")).select(*keys, C("_of").alias("predicate"))
        met = nodes.join(said.select(*party.KEY).union(as_sibling).distinct(), party.KEY, "left_semi")
    else:
        met = nodes.join(said.select(*keys).distinct(), keys, "left_semi")
    by_party = met.select("claim_id").union(nodes.join(named.distinct(), keys, "left_semi").select("claim_id"))
    slot = nodes.select("claim_id", F.explode(F.array("subject", "object")).alias("held"))
    return by_party.union(slot.join(ends, "held", "left_semi").select("claim_id")).distinct()


def without_rows(s: Sources, retractions: DataFrame) -> Sources:
    """The sources after retractions (source_table, row_id) of assertions and rows of the taxonomy."""
    def left(rows: DataFrame, table: str) -> DataFrame:
        gone = retractions.where(C("source_table") == table).select(C("row_id").alias("id")).distinct().withColumn("_gone", F.lit(True))
        return rows.join(gone, "id", "left").withColumn("retracted", C("retracted") | F.coalesce("_gone", F.lit(False))).select(*rows.columns)

    return replace(s, assertions=left(s.assertions, "assertions"), taxonomy=left(s.taxonomy, "taxonomy"))


def reverify(verdicts: DataFrame, w: Walk, claims: DataFrame, s: Sources, retractions: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """The verdicts (of verify()) after retractions: claims that they can bear on are verified again, the others keep theirs.

    claims and s are those of the walk. What it has prepared serves again, but for what hangs on assertions and the taxonomy.
    """
    again = settle(touched(w, retractions, s, by_predicate=True), "touched")
    fresh = outcome(walk_by(w.guarded.select(*claims.columns).join(again, "claim_id", "left_semi"), prepare_after(w.prepared, retractions), budget))
    return verdicts.join(again, "claim_id", "left_anti").unionByName(fresh)

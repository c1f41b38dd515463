"""From names to entities: titles and redirects, searches, selection by type, and resolution through a cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import text

C = F.col
LIMIT = 30


def titles(references: DataFrame, redirects: DataFrame, labels: DataFrame) -> DataFrame:
    """reference, title, page_id, outcome: the page that a name leads to, after one redirect (title, target) without regard to case.

    not_found without a page, disambiguation_page where several entities bear the title, clean_redirect where the page has
    another title than the name, else canonical.
    """
    asked = references.select("reference").distinct().withColumn("_plain", F.lower(F.trim(text.strip_article(C("reference")))))
    hop = redirects.select(F.lower("title").alias("_plain"), C("target").alias("_target"))
    pages = labels.groupBy(C("label").alias("title")).agg(F.min("kb_id").alias("page_id"), F.count(F.lit(1)).alias("_n"))
    rows = asked.join(hop, "_plain", "left").withColumn("title", F.coalesce("_target", text.strip_article(C("reference")))).join(pages, "title", "left")
    outcome = F.when(C("page_id").isNull(), "not_found").when(C("_n") > 1, "disambiguation_page").when(F.lower("title") != F.lower("reference"), "clean_redirect").otherwise("canonical")
    return rows.select("reference", "title", "page_id", outcome.alias("outcome"))


def search(queries: DataFrame, labels: DataFrame, aliases: DataFrame, limit: int = LIMIT) -> DataFrame:
    """query, kb_id, label, matched, place, score: entities whose label or an alias is the query without regard to case.

    Matches by label come before those by alias, then ids in order; the score of place n is 1/n.
    """
    plain = lambda c: F.lower(F.trim(c))
    names = labels.select("kb_id", plain("label").alias("_q"), F.lit(0).alias("_kind")).union(aliases.select("kb_id", plain("alias"), F.lit(1)))
    names = names.groupBy("_q", "kb_id").agg(F.min("_kind").alias("_kind"))
    order = Window.partitionBy("query").orderBy("_kind", "kb_id")
    found = queries.select("query").distinct().withColumn("_q", plain("query")).join(names, "_q").withColumn("place", F.row_number().over(order)).where(C("place") <= limit)
    first = labels.groupBy("kb_id").agg(F.min("label").alias("label"))
    return found.join(first, "kb_id", "left").select("query", "kb_id", "label", F.when(C("_kind") == 0, "label").otherwise("alias").alias("matched"), "place", (1 / C("place")).alias("score"))


def of_type(kb_id: str, edges: DataFrame) -> DataFrame:
    """kb_id, expected_type, typed: the classes that entities are instances of."""
    return edges.where("property = 'P31'").select(C("src").alias(kb_id), C("dst").alias("expected_type"), F.lit(True).alias("typed")).distinct()


def keep_typed(found: DataFrame, edges: DataFrame) -> DataFrame:
    """The candidates (query, expected_type, kb_id) of the expected type; all of them where none is, or nothing is expected."""
    rows = found.join(of_type("kb_id", edges), ["kb_id", "expected_type"], "left")
    some = F.coalesce(F.bool_or("typed").over(Window.partitionBy("query", "expected_type")), F.lit(False))
    return rows.withColumn("_some", some).where(~C("_some") | C("typed")).drop("_some", "typed")


def select_only(found: DataFrame, edges: DataFrame) -> DataFrame:
    """query, expected_type, kb_id, label: the only candidate that is left by type; none where several are."""
    kept = keep_typed(found, edges).groupBy("query", "expected_type").agg(F.count(F.lit(1)).alias("n"), F.min("kb_id").alias("kb_id"), F.min_by("label", "kb_id").alias("label"))
    return kept.where("n = 1").drop("n")


def compose(asked: DataFrame, redirects: DataFrame, labels: DataFrame, aliases: DataFrame, edges: DataFrame) -> DataFrame:
    """reference, expected_type, kb_id, form, outcome for each pair of asked (reference, expected_type).

    The title is searched where the name leads to one page, else the name itself. If selection leaves several candidates, the
    page's own entity stands in, but only where it isn't one of them and is of the expected type.
    """
    pairs = asked.select("reference", "expected_type").distinct()
    told = titles(pairs, redirects, labels)
    clear = C("outcome").isin("canonical", "clean_redirect")
    rows = pairs.join(told, "reference").withColumn("query", F.when(clear, C("title")).otherwise(C("reference")))
    found = search(rows, labels, aliases).join(rows.select("query", "expected_type").distinct(), "query")
    picked = select_only(found, edges).select(C("query").alias("_query"), C("expected_type").alias("_type"), C("kb_id").alias("_id"), C("label").alias("_label"))
    same = (C("query") == C("_query")) & C("expected_type").eqNullSafe(C("_type"))
    among = found.select("query", C("kb_id").alias("page_id")).distinct().withColumn("_among", F.lit(True))
    joined = rows.join(picked, same, "left").drop("_query", "_type").join(among, ["query", "page_id"], "left").join(of_type("page_id", edges), ["page_id", "expected_type"], "left")
    rescue = clear & C("_among").isNull() & (C("expected_type").isNull() | C("typed"))
    kb_id = F.coalesce("_id", F.when(rescue, C("page_id")))
    form = F.when(C("_id").isNotNull(), C("_label")).when(kb_id.isNotNull(), C("title")).otherwise(C("reference"))
    return joined.select("reference", "expected_type", kb_id.alias("kb_id"), form.alias("form"), "outcome")


def resolve_cached(references: DataFrame, composed: DataFrame, cache: DataFrame, labels: DataFrame, aliases: DataFrame, least: float = 0.6) -> DataFrame:
    """reference, kb_id, via: by the normaliser, else the cache (an empty id there means that there is nothing), else the best search result.

    Every reference that was searched for is a row to be cached, those without result with an empty id.
    """
    normal = composed.where("kb_id IS NOT NULL AND expected_type IS NULL").groupBy("reference").agg(F.min("kb_id").alias("_normal"))
    held = cache.where("NOT retracted").groupBy("reference").agg(F.min_by("kb_id", "id").alias("_cached"))
    rows = references.select("reference").distinct().join(normal, "reference", "left").join(held, "reference", "left")
    open_ = rows.where("_normal IS NULL AND _cached IS NULL").select(C("reference").alias("query"))
    best = search(open_, labels, aliases).where((C("place") == 1) & (C("score") >= least)).select(C("query").alias("reference"), C("kb_id").alias("_found"))
    via: Column = F.when(C("_normal").isNotNull(), "normaliser").when(C("_cached") == "", "negative").when(C("_cached").isNotNull(), "cache").when(C("_found").isNotNull(), "search").otherwise("nothing")
    return rows.join(best, "reference", "left").select("reference", F.coalesce("_normal", F.nullif("_cached", F.lit("")), "_found").alias("kb_id"), via.alias("via"))


#: The columns that tell one context from another, with the name in its normal form first.
CONTEXT = ("form", "predicate", "slot", "party")


def signature() -> Column:
    """The key of a name in its context: parts with their lengths, so that no two contexts share one; nulls differ from empty texts."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), C(c)), F.lit("-")) for c in CONTEXT]
    return F.sha2(F.concat_ws(";", *parts), 256)


def in_context(requests: DataFrame, composed: DataFrame, cache: DataFrame, labels: DataFrame, aliases: DataFrame, edges: DataFrame, least: float = 0.6) -> DataFrame:
    """request_id, form, signature, kb_id, via of requests (request_id, reference, expected_type, predicate, slot, party).

    A name is put into its normal form (composed), but for the speaker's own name, made-up events and empty names. If that
    tells the entity, it wins (normaliser). Else the first live row of cache (signature, kb_id, created_at, retracted) does;
    an empty id there says that there is nothing (negative). Else the best search result of the expected type does, if it
    scores least or more (search; weak below that, which is no answer and isn't cached, so that asking twice changes nothing),
    else nothing. Only names that the cache doesn't know are searched for, each once.
    """
    plain = (C("reference") == C("party")) | F.startswith("reference", F.lit("event_")) | (C("reference") == "")
    told = composed.select(C("reference").alias("_reference"), C("expected_type").alias("_type"), C("form").alias("_form"), C("kb_id").alias("_normal"))
    asked = requests.withColumn("_plain", F.coalesce(plain, F.lit(True)))
    rows = asked.join(told, ~C("_plain") & (C("reference") == C("_reference")) & C("expected_type").eqNullSafe(C("_type")), "left").drop("_reference", "_type")
    rows = rows.withColumn("form", F.coalesce("_form", "reference")).withColumn("signature", signature())
    held = cache.where("NOT retracted").groupBy("signature").agg(F.min_by("kb_id", F.struct("created_at", "kb_id")).alias("_cached"))
    rows = rows.join(held, "signature", "left")
    open_ = rows.where("_normal IS NULL AND _cached IS NULL AND form <> ''").select(C("form").alias("query"), "expected_type").distinct()
    kept = keep_typed(search(open_, labels, aliases).join(open_, "query"), edges)
    best = kept.groupBy("query", "expected_type").agg(F.min(F.struct("place", "kb_id", "score")).alias("_best"))
    best = best.select(C("query").alias("_query"), C("expected_type").alias("_type"), "_best")
    missed = C("_normal").isNull() & C("_cached").isNull()
    rows = rows.join(best, missed & (C("form") == C("_query")) & C("expected_type").eqNullSafe(C("_type")), "left")
    good = C("_best.score") >= least
    via = F.when(C("_normal").isNotNull(), "normaliser").when(C("_cached") == "", "negative").when(C("_cached").isNotNull(), "cache").when(good, "search").when(C("_best").isNotNull(), "weak").otherwise("nothing")
    return rows.select("request_id", "form", "signature", F.coalesce("_normal", F.nullif("_cached", F.lit("")), F.when(good, C("_best.kb_id"))).alias("kb_id"), via.alias("via"))


def written_through(cache: DataFrame, answered: DataFrame, at: str) -> DataFrame:
    """cache (signature, kb_id, used, created_at, retracted) after the answers of in_context().

    An answer out of the cache counts as a use of its row. A signature without a live row gets one, with an empty id if there
    was nothing: used once for each request of the batch, as those after the first would have found it, but once in all where
    the normaliser told it. Of requests with one signature but several answers (other expected types) the first by id is kept.
    """
    uses = answered.where("signature IS NOT NULL AND via <> 'weak'").groupBy("signature").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(C("via").isin("cache", "negative")).alias("_hits"), F.min_by(F.struct(F.coalesce("kb_id", F.lit("")).alias("id"), "via"), "request_id").alias("_it"))
    first = cache.where("NOT retracted").groupBy("signature").agg(F.min(F.struct("created_at", "kb_id")).alias("_first"))
    old = cache.join(first, "signature", "left").join(uses.select("signature", "_hits"), "signature", "left")
    mine = ~C("retracted") & (F.struct("created_at", "kb_id") == C("_first"))
    old = old.withColumn("used", C("used") + F.when(mine, F.coalesce("_hits", F.lit(0))).otherwise(0)).select("signature", "kb_id", "used", "created_at", "retracted")
    new = uses.join(first, "signature", "left_anti").select("signature", C("_it.id").alias("kb_id"), F.when(C("_it.via") == "normaliser", 1).otherwise(C("_n")).cast("long").alias("used"), F.lit(at).alias("created_at"), F.lit(False).alias("retracted"))
    return old.unionByName(new)

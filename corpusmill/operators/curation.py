"""Upkeep of a corpus: citations, drift lanes, worklists, audits and reports over documents, orders and a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as T
from ..functions.oracle import quoted
from ..functions.text import STOPWORDS
from ..sources.scratch import stored
from ..sources.tables import table
from .graph import _E, supply_edges, undirected
from .ledger import _S, sessions, strength

#: Strength under which a cited name is weak; sessions before a name is no longer young; neighbours attached; queue length.
WEAK, YOUNG, NEIGHBOURS, QUEUE = 0.15, 5, 3, 25
#: Days after which a baseline has lapsed, and the day the reports are of.
LAPSE_DAYS, NOW = 30, "1998-08-02"


# --- operators --------------------------------------------------------------------------------------------------------


def citing(citations: DataFrame, changed: DataFrame, name: str, path: str) -> DataFrame:
    """(name, hits): names that cite any changed path, with those paths in order."""
    hit = citations.select(name, path).distinct().join(changed.select(path).distinct(), path)
    return hit.groupBy(name).agg(F.array_sort(F.collect_list(path)).alias("hits"))


def scoped_drift(citations: DataFrame, changes: DataFrame, name: str, path: str) -> DataFrame:
    """(name, n): cited paths changed after the name's baseline; kept where either time is unknown.

    `citations` has name, path, baseline; `changes` path and changed_at.
    """
    late = F.col("changed_at").isNull() | F.col("baseline").isNull() | (F.col("changed_at") > F.col("baseline"))
    return citations.join(changes, path).where(late).groupBy(name).agg(F.count_distinct(path).alias("n"))


def attach_neighbours(edges: DataFrame, worklist: DataFrame, most: int = NEIGHBOURS) -> DataFrame:
    """(node, neighbours): the first neighbours of each node of a worklist that aren't on it themselves."""
    listed = worklist.select("node").distinct()
    near = undirected(edges).join(listed.withColumnRenamed("node", "src"), "src", "left_semi")
    near = near.join(listed.withColumnRenamed("node", "dst"), "dst", "left_anti")
    first = near.withColumn("n", F.row_number().over(W.partitionBy("src").orderBy("dst"))).where(F.col("n") <= most)
    return first.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))


def first_lane(lanes: list[tuple[str, DataFrame]], name: str) -> DataFrame:
    """(name, lane): each name under the first of the lanes that has it."""
    ranked = [df.select(name).distinct().select(name, F.lit(i).alias("at"), F.lit(lane).alias("lane")) for i, (lane, df) in enumerate(lanes)]
    every = ranked[0]
    for other in ranked[1:]:
        every = every.unionByName(other)
    return every.groupBy(name).agg(F.min_by("lane", "at").alias("lane"))


def joined_list(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


def fresh_quota(rows: DataFrame, key: str, item: str, order: list, most: int) -> DataFrame:
    """Rows in order, of which repeats of an item stay but don't count towards `most`."""
    new = (F.row_number().over(W.partitionBy(key, item).orderBy(*order)) == 1).cast("int")
    used = F.sum("new").over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("new", new).withColumn("used", used).where(F.col("used") <= most)


# --- queries: texts ---------------------------------------------------------------------------------------------------


def _first_line() -> Column:
    return F.substring_index(T.text_of("text"), "\n", 1)


def doc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is indexed of a document: the words of its name, then its first line."""
    d = table(spark, sf_dir, "documents")
    whole = F.trim(F.concat(F.translate(F.concat_ws("-", "source", "lang"), "-_", "  "), F.lit(". "), _first_line()))
    return d.select("doc_id", F.md5(whole).alias("text_md5"), F.length(whole).cast("bigint").alias("n_chars"))


def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each page from one heading to the next; what stands before the first is dropped."""
    p = table(spark, sf_dir, "pages")
    cut = F.split(T.text_of("html"), "<h[1-6]", -1)
    parts = F.slice(cut, F.lit(2), F.size(cut))
    return p.select("page_id", F.size(parts).cast("bigint").alias("n_sections"), F.md5(F.array_join(parts, "|")).alias("sections_md5"))


def cleaned_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as queries: without fences and tags, white space collapsed; empty with fewer than two content tokens."""
    b = table(spark, sf_dir, "benchmark")
    bare = F.regexp_replace(F.regexp_replace(T.text_of("text"), "(?s)```.*?```", " "), "<[^>]*>", " ")
    clean = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return b.select("item_id", F.when(F.size(T.tokens(clean)) >= 2, clean).otherwise("").alias("query"))


def identity_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as identities: small letters and digits, `_` for all else, 64 characters at most."""
    slug = F.regexp_replace(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    slug = F.substring(slug, 1, 64)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.coalesce(slug, F.lit("")) == "", "unknown").otherwise(slug).alias("slug"))


def soft_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of part names without their first segment; none where there is one segment alone."""
    slug = T.slug(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_extract(slug, "^[^-]*-(.+)$", 1).alias("alias")).where("alias <> ''")


def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.lower(F.regexp_extract(T.text_of("url"), r"^(?:https?|ssh|git)://(?:[^/@]*@)?([^/:?#]+)", 1))
    return table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"))


def grounding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct addresses, versions, references and hash-like words of each document."""
    found = lambda pattern: F.array_distinct(F.regexp_extract_all(T.text_of("text"), F.lit(pattern), F.lit(0)))
    shas = F.filter(found(r"\b[0-9a-f]{7,40}\b"), lambda x: F.rlike(x, F.lit("[a-f]")) & F.rlike(x, F.lit("[0-9]")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(found(r"https?://[^\s<>]+")).cast("bigint").alias("n_urls"), F.size(found(r"\bv?[0-9]+\.[0-9]+\b")).cast("bigint").alias("n_versions"),
        F.size(found("#[0-9]+")).cast("bigint").alias("n_refs"), F.size(shas).cast("bigint").alias("n_shas"),
    )


def ungrounded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation the different long words of answers that none of its questions holds."""
    c = table(spark, sf_dir, "conversations")
    asked = c.where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("q"))
    asked = asked.select("conv_id", F.lower(F.array_join(F.transform("q", lambda x: T.text_of(x["text"])), " ")).alias("evidence"))
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(T.text_of("text")), F.lit(r"[a-z]{6,}"), F.lit(0))))
    said = c.where("role <> 'user'").select("conv_id", words.alias("word")).distinct()
    j = said.join(asked, "conv_id", "left")
    return j.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_words"), F.count_if(~F.coalesce(F.contains("evidence", "word"), F.lit(False))).alias("n_ungrounded")
    )


def normalised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with white space collapsed, blank ones dropped."""
    lines = F.transform(F.split(T.text_of("text"), "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    kept = F.filter(lines, lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(kept).cast("bigint").alias("n_lines"), F.md5(F.array_join(kept, "\n")).alias("lines_md5"))


def fence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the first line of each document stands in the documents of the same source and length: exact, by white space, missing."""
    squeeze = lambda c: F.regexp_replace(c, r"\s+", " ")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", T.text_of("text").alias("text"))
    a = d.select("doc_id", "source", "n_chars", _first_line().alias("fence"))
    b = d.select("source", "n_chars", F.col("doc_id").alias("other"), "text")
    j = a.join(b, ["source", "n_chars"]).where("doc_id <> other")
    level = F.when(F.contains("text", "fence"), "exact").when(F.contains(squeeze("text"), squeeze("fence")), "whitespace").otherwise("missing")
    return j.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


def derived_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of addresses with parameters that cover no more than three times as many addresses as they are cited for."""
    p = table(spark, sf_dir, "pages").select(
        F.regexp_extract(T.text_of("url"), r"^([a-z]+://[^/]+/[^/?#]*)", 1).alias("folder"), F.contains("url", F.lit("?")).cast("int").alias("cited")
    )
    g = p.groupBy("folder").agg(F.sum("cited").alias("n_cited"), F.count(F.lit(1)).alias("n_all"))
    return g.where("n_cited > 0 AND n_all <= 3 * n_cited")


# --- queries: citations and drift -------------------------------------------------------------------------------------


def citation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that cite a changed part (the biggest size), with those parts."""
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_partkey").alias("path"))
    changed = table(spark, sf_dir, "part").where("p_size = 50").select(F.col("p_partkey").alias("path"))
    return citing(cited, changed, "name", "path").select("name", joined_list(F.col("hits")).alias("hits"))


def drift_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the cited parts that last shipped after them."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    cited = l.select("l_orderkey", F.col("l_partkey").alias("path")).join(
        o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("baseline")), "l_orderkey"
    )
    changes = stored(l.where("l_returnflag <> 'R'").groupBy(F.col("l_partkey").alias("path")).agg(F.max("l_shipdate").alias("changed_at")))
    return scoped_drift(cited, changes, "l_orderkey", "path")


def committed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited parts by whether the catalogue of small parts tracks them, and the orders that cite them."""
    tracked = table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("tracked"))
    j = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(tracked, "l_partkey", "left")
    return j.groupBy(F.coalesce("tracked", F.lit(False)).alias("tracked")).agg(
        F.count_distinct("l_partkey").alias("n_parts"), F.count_distinct("l_orderkey").alias("n_orders")
    )


def boundary_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations that the tracked catalogue leaves dangling: healed by local parts, or not at all, by segment of size."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    j = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(p, "l_partkey", "left").where("p_size IS NULL OR p_size > 25")
    return j.groupBy(F.when(F.col("p_size").isNull(), "dangling").when(F.col("p_size") > 40, "far").otherwise("near").alias("state")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("n_orders")
    )


def neighbour_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = table(spark, sf_dir, "part").where("p_size >= 30").select(F.col("p_partkey").alias("node"))
    found = attach_neighbours(supply_edges(spark, sf_dir), work)
    return found.select("node", joined_list(F.col("neighbours")).alias("neighbours"))


def evidence_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under the first lane that names them: returned lines, open lines, urgent ones."""
    l, o = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "name"), table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "name")
    lanes = [("returned", l.where("l_returnflag = 'R'")), ("open", l.where("l_linestatus = 'O'")), ("urgent", o.where("o_orderpriority = '1-URGENT'"))]
    return first_lane(lanes, "name").groupBy("lane").agg(F.count(F.lit(1)).alias("n"), F.sum("name").alias("names_sum"))


def interview_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first names of three queues together, without those already answered."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    stale = l.where("l_returnflag = 'R' AND l_quantity = 50").select(F.col("l_orderkey").alias("name"))
    urgent = o.where("o_orderpriority = '1-URGENT' AND o_totalprice > 300000").select(F.col("o_orderkey").alias("name"))
    idle = o.where("o_totalprice < 2000").select(F.col("o_orderkey").alias("name"))
    answered = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("name"))
    every = stale.union(urgent).union(idle).distinct().join(answered, "name", "left_anti")
    return every.orderBy("name").limit(QUEUE)


def staleness_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with returned lines by state: expired, worklisted, suppressed, or active."""
    o = table(spark, sf_dir, "orders")
    stale = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    old = F.datediff(F.to_date(F.lit(NOW)), F.to_date("o_orderdate")) > 1000
    state = F.when(old, "expired").when(F.col("o_orderpriority") == "1-URGENT", "worklisted").when(F.col("lines") == 1, "suppressed").otherwise("active")
    return o.join(stale, "o_orderkey").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.sum("lines").alias("lines"))


def expiry_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the day on which their baseline lapses."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_add(F.to_date("o_orderdate"), LAPSE_DAYS).alias("lapses"))


def nondrift_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lapsed orders that no returned line flags as drifted."""
    lapsed = expiry_map(spark, sf_dir).where(F.col("lapses") < F.to_date(F.lit(NOW)))
    drifted = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return lapsed.join(drifted, "o_orderkey", "left_anti")


def row_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from each order to its latest shipped line, one place."""
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    j = table(spark, sf_dir, "orders").join(last, "o_orderkey")
    seconds = F.unix_timestamp("last") - F.unix_timestamp("o_orderdate")
    return j.select("o_orderkey", F.round(seconds / 86400, 1).alias("days"))


def pair_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer's order and the next: which one newer, dearer and more urgent speak for; none if they disagree."""
    o = table(spark, sf_dir, "orders")
    order = W.partitionBy("o_custkey").orderBy("o_orderkey")
    after = lambda c: F.lead(c).over(order)
    j = o.select(
        F.col("o_orderkey").alias("a"), after("o_orderkey").alias("b"), F.signum(F.unix_timestamp(after("o_orderdate")) - F.unix_timestamp("o_orderdate")).alias("newer"),
        F.signum(after("o_totalprice") - F.col("o_totalprice")).alias("dearer"),
    ).where("b IS NOT NULL")
    verdict = F.when((F.col("newer") > 0) & (F.col("dearer") > 0), "b").when((F.col("newer") < 0) & (F.col("dearer") < 0), "a").otherwise("abstain")
    return j.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a_sum"))


# --- queries: ledger --------------------------------------------------------------------------------------------------


def outcome_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 + a tenth of an item's purchases over three, one at most."""
    s = sessions(spark, sf_dir)
    return s.groupBy("item").agg(F.count_if(F.col("event_type") == "purchase").alias("hits")).select(
        "item", "hits", F.round(1 + 0.10 * F.least(F.lit(1.0), F.col("hits") / 3), 6).alias("factor")
    )


def cooldown_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each user until the sixth different item; items shown before don't count."""
    s = sessions(spark, sf_dir).select("event_id", "user_id", "item", "ts")
    return fresh_quota(s, "user_id", "item", ["ts", "event_id"], 5).select("event_id", "user_id", F.col("used").cast("bigint").alias("used"))


def young_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with fewer than YOUNG sessions from their first purchase on, and how many."""
    s = sessions(spark, sf_dir)
    born = s.where("event_type = 'purchase'").groupBy("item").agg(F.max("ts").alias("born"))
    n = s.join(born, "item").where("ts >= born").groupBy("item").agg(F.count_distinct("session").alias("n_sessions"))
    return n.where(F.col("n_sessions") < YOUNG)


def authority_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts cited by orders whose strength in the ledger is weak, by brand."""
    known = strength(spark, sf_dir).select(F.col("item").cast("bigint").alias("p_partkey"), "strength")
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    j = table(spark, sf_dir, "part").join(cited, "p_partkey", "left_semi").join(known, "p_partkey", "left")
    weak = j.where(F.coalesce("strength", F.lit(0.0)) < WEAK)
    return weak.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_weak"), F.count("strength").alias("n_known"))


def blind_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no edge and no event names."""
    e = supply_edges(spark, sf_dir)
    linked = e.select(F.col("src").alias("p_partkey")).union(e.select("dst"))
    used = sessions(spark, sf_dir).select(F.col("item").cast("bigint").alias("p_partkey")).distinct()
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return p.join(linked, "p_partkey", "left_anti").join(used, "p_partkey", "left_anti").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


def baseline_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the ledger that no part of small size stands for, with their rows."""
    items = sessions(spark, sf_dir).groupBy(F.col("item").cast("bigint").alias("l_partkey")).agg(F.count(F.lit(1)).alias("n"))
    known = table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    return items.join(known, "l_partkey", "left_anti").select(F.col("l_partkey").alias("item"), "n")


def watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the latest session, and the first item in it with a purchase."""
    s = sessions(spark, sf_dir)
    last = s.groupBy("user_id").agg(F.max_by("session", F.struct("ts", "event_id")).alias("session"))
    bought = F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))
    return s.join(last, ["user_id", "session"]).groupBy("user_id", "session").agg(F.min_by("item", bought).alias("item"))


def latest_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last known value of each type of event, and the row it comes from."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    at = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x")
    return e.groupBy("event_type").agg(at).select("event_type", "x.event_id", "x.value")


def baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value by type in two halves of the month: worse, better or the same within one in a hundred."""
    e = table(spark, sf_dir, "events")
    half = F.dayofmonth("ts") <= 15
    g = e.groupBy("event_type").agg(F.avg(F.when(half, F.col("value"))).alias("old"), F.avg(F.when(~half, F.col("value"))).alias("new"))
    change = (F.col("new") - F.col("old")) / F.col("old")
    state = F.when(F.col("old").isNull() | F.col("new").isNull(), "skipped").when(change < -0.01, "worse").when(change > 0.01, "better").otherwise("same")
    return g.select("event_type", F.round("old", 6).alias("old"), F.round("new", 6).alias("new"), state.alias("state"))


def draft_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by their fate: graduated by purchases of two users, expired by errors alone, else kept."""
    s = sessions(spark, sf_dir)
    g = s.groupBy("item").agg(
        F.count_distinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("buyers"),
        F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") != "error").alias("others"),
    )
    fate = F.when(F.col("buyers") >= 2, "graduated").when(F.col("errors") > F.col("others") / 4, "expired").otherwise("kept")
    return g.select("item", fate.alias("fate"), "buyers", "errors")


def seed_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice the new items of a session, thrice its purchases, twice its errors."""
    s = sessions(spark, sf_dir)
    first = s.groupBy("user_id", "item").agg(F.min_by("session", F.struct("ts", "event_id")).alias("session"))
    new = first.groupBy("session").agg(F.count(F.lit(1)).alias("fresh"))
    g = s.groupBy("session").agg(F.count_if(F.col("event_type") == "purchase").alias("bought"), F.count_if(F.col("event_type") == "error").alias("failed"))
    fresh = F.coalesce("fresh", F.lit(0))
    return g.join(new, "session", "left").select("session", (2 * fresh + 3 * F.col("bought") + 2 * F.col("failed")).alias("salience"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by who verified them: purchases by others than the first user, by that one alone, or none."""
    s = sessions(spark, sf_dir)
    creator = stored(s.groupBy("item").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("creator")))
    g = s.join(creator, "item").groupBy("item").agg(
        F.count_if((F.col("event_type") == "purchase") & (F.col("user_id") != F.col("creator"))).alias("others"),
        F.count_if((F.col("event_type") == "purchase") & (F.col("user_id") == F.col("creator"))).alias("own"),
    )
    state = F.when(F.col("others") > 0, "others").when(F.col("own") > 0, "own").otherwise("none")
    return g.groupBy(state.alias("verified")).agg(F.count(F.lit(1)).alias("n"), F.sum("others").alias("n_others"))


def snapshot_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in lines of two halves of the ship dates: those in one alone."""
    l = table(spark, sf_dir, "lineitem")
    late = F.col("l_shipdate") >= F.lit("1995-06-17").cast("timestamp")
    g = l.groupBy("l_partkey").agg(F.bool_or(late).alias("new"), F.bool_or(~late).alias("old"))
    return g.where("new <> old").groupBy(F.when(F.col("new"), "added").otherwise("removed").alias("op")).agg(
        F.count(F.lit(1)).alias("n"), F.min("l_partkey").alias("first_part")
    )


# --- queries: graph and reports ---------------------------------------------------------------------------------------


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha1(T.text_of("text")).alias("h"))
    first = stored(d.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("tip"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    return d.join(first, "h")


def typed_inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a later copy supersedes, and the nearest that does."""
    order = W.partitionBy("h").orderBy("doc_id")
    return _copies(spark, sf_dir).select(F.col("doc_id").alias("dst"), F.lead("doc_id").over(order).alias("src")).where("src IS NOT NULL").select("dst", "src")


def decision_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of a chain of copies with the chain's first and last, and its length."""
    return _copies(spark, sf_dir).select("doc_id", "first_id", "tip", "n")


def dispute_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked pairs by the side that declares the edge."""
    e = supply_edges(spark, sf_dir)
    g = e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("src").alias("lo"), F.max("src").alias("hi"))
    side = F.when(F.col("lo") != F.col("hi"), "both").when(F.col("lo") == F.col("a"), "a").otherwise("b")
    return g.select("a", "b", side.alias("side"))


def edge_rot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to archived (small), superseded (cheap) and unknown parts, by class; an edge may be in several."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("dst"), (F.col("p_size") <= 10).alias("archived"), (F.col("p_retailprice") < 1200).alias("superseded"))
    j = supply_edges(spark, sf_dir).join(p, "dst", "left")
    classes = F.array_compact(
        F.array(
            F.when(F.col("archived").isNull(), F.lit("dangling")), F.when(F.col("archived"), F.lit("archived")), F.when(F.col("superseded"), F.lit("superseded")),
        )
    )
    return j.select("src", "dst", F.explode(classes).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def hub_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with more than eight orders, and what protects them: urgent orders, a high balance."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("degree"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent")
    )
    j = table(spark, sf_dir, "customer").join(o.where("degree > 8"), "c_custkey")
    why = F.array_compact(F.array(F.when(F.col("urgent") > 0, F.lit("urgent")), F.when(F.col("c_acctbal") > 5000, F.lit("balance"))))
    return j.select("c_custkey", "degree", F.array_join(why, ",").alias("protected"))


def protection_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are on the floor (dearest), linked, or cited by urgent orders, with the reasons in order."""
    p = table(spark, sf_dir, "part").where("p_retailprice >= 1800").select(F.col("p_partkey").alias("node"), F.lit("floor").alias("why"))
    linked = undirected(supply_edges(spark, sf_dir)).select(F.col("src").alias("node"), F.lit("linked").alias("why"))
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 350000").select(F.col("o_orderkey").alias("l_orderkey"))
    cited = table(spark, sf_dir, "lineitem").join(urgent, "l_orderkey", "left_semi").select(F.col("l_partkey").alias("node"), F.lit("cited").alias("why"))
    every = p.union(linked).union(cited)
    return every.groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("why")), ",").alias("reasons"))


def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each part touches: orders, suppliers, edges out and in."""
    l, e = table(spark, sf_dir, "lineitem"), supply_edges(spark, sf_dir)
    cited = l.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_suppkey").alias("suppliers"))
    out = e.groupBy(F.col("src").alias("p_partkey")).agg(F.count(F.lit(1)).alias("edges_out"))
    into = e.groupBy(F.col("dst").alias("p_partkey")).agg(F.count(F.lit(1)).alias("edges_in"))
    j = table(spark, sf_dir, "part").select("p_partkey").join(cited, "p_partkey", "left").join(out, "p_partkey", "left").join(into, "p_partkey", "left")
    return j.select("p_partkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("orders", "suppliers", "edges_out", "edges_in")])


def cross_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources by the contents that both hold."""
    d = table(spark, sf_dir, "documents").select("source", F.sha1(T.text_of("text")).alias("h")).distinct()
    # Sources are few; a content with very many copies stands once for each.
    pairs = d.toDF("a", "h").join(d.toDF("b", "h"), "h").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def shadowed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines that live documents share with archived ones (of the later sources)."""
    d = table(spark, sf_dir, "documents").select(F.md5(_first_line()).alias("name"), "source")
    return d.where("source <= 'src12'").select("name").intersect(d.where("source > 'src12'").select("name"))


def recent_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty latest different questions."""
    c = table(spark, sf_dir, "conversations").where("role = 'user' AND text IS NOT NULL")
    last = c.groupBy("text").agg(F.max(F.struct("conv_id", "turn")).alias("at"))
    return last.select(F.md5("text").alias("text_md5"), "at.conv_id", "at.turn").orderBy(F.desc("conv_id"), F.desc("turn"), "text_md5").limit(20)


def threat_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and distinct sources by kind of finding: addresses, mail, keys, markup."""
    kinds = (("url", "https?://"), ("mail", r"[a-z0-9.]+@[a-z0-9]+\.[a-z]"), ("key", "AKIA|(?:password|token) *[:=]"), ("markup", "<[a-z]+"))
    found = F.array_compact(F.array(*[F.when(F.rlike(T.text_of("text"), F.lit(p)), F.lit(k)) for k, p in kinds]))
    d = table(spark, sf_dir, "documents").select("source", F.explode(found).alias("kind"))
    return d.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources"))


def verification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language, those with labels, and those of good quality."""
    l = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    j = table(spark, sf_dir, "documents").join(l, "doc_id", "left")
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.count("quality").alias("verified"), F.count_if(F.col("quality") == 1).alias("good"))


def trust_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of checks over the corpus."""
    d = table(spark, sf_dir, "documents")
    line = F.length(F.trim(T.text_of("text")))
    return d.agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_distinct("source").alias("n_sources"), F.count_if(line == 0).alias("n_blank"),
        F.count_if(line < 200).alias("n_short"), F.count_if(F.col("n_chars") != F.length("text")).alias("n_wrong_size"), F.count_distinct(F.md5("text")).alias("n_texts"),
    )


def promote_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good, harmless documents without addresses or numbers that tie them to one place."""
    good = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND t = 0")
    d = table(spark, sf_dir, "documents").where(~F.rlike(T.text_of("text"), F.lit("https?://|@|[0-9]{5,}")))
    return d.join(good, "doc_id", "left_semi").select("doc_id", "lang")


def replay_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by the last verdict on the part they come from: failing, passing, or never run."""
    s = sessions(spark, sf_dir)
    last = s.groupBy(F.col("item").cast("bigint").alias("src")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("verdict"))
    j = supply_edges(spark, sf_dir).join(last, "src", "left")
    state = F.when(F.col("verdict").isNull(), "never run").when(F.col("verdict") == "error", "failing").otherwise("passing")
    return j.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def graduation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with three errors or more, and their first five purchases in order."""
    s = sessions(spark, sf_dir)
    stale = s.where("event_type = 'error'").groupBy("item").agg(F.count(F.lit(1)).alias("errors")).where("errors >= 3")
    order = W.partitionBy("item").orderBy("ts", "event_id")
    first = s.where("event_type = 'purchase'").withColumn("n", F.row_number().over(order)).where("n <= 5")
    kept = first.groupBy("item").agg(joined_list(F.transform(F.array_sort(F.collect_list(F.struct("n", "event_id"))), lambda x: x["event_id"])).alias("events"))
    return stale.join(kept, "item", "left").select("item", "errors", F.coalesce("events", F.lit("")).alias("events"))


def edge_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by the flags of the lines that they start from; an edge counts once for each."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_returnflag").alias("origin")).distinct()
    e = supply_edges(spark, sf_dir)
    return e.join(l, "src").groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("n_sources"))


QUERIES = {
    f.__name__: f
    for f in (
        doc_text, heading_sections, cleaned_queries, identity_slugs, soft_aliases, url_hosts, grounding_ids, ungrounded_words, normalised_lines,
        fence_levels, derived_globs, citation_candidates, drift_paths, committed_split, boundary_lint, neighbour_attach,
        evidence_fold, interview_queue, staleness_digest, expiry_map, nondrift_expiry, row_ages, pair_evidence, outcome_priors, cooldown_quota,
        young_items, authority_gap, blind_spots, baseline_health, watermarks, latest_metric, baseline_diff, draft_sweep, seed_salience, coverage,
        snapshot_sets, typed_inbound, decision_closure, dispute_states, edge_rot, hub_flags, protection_map, blast_radius, cross_twins,
        shadowed_names, recent_queries, threat_totals, verification_summary, trust_scorecard, promote_candidates, replay_coverage,
        graduation_history, edge_origins,
    )
}

_LINE = "split_part(text, chr(10), 1)"
_TOKENS = f"list_filter(regexp_extract_all(lower({{}}), '[\\p{{{{L}}}}\\p{{{{N}}}}_]+'), lambda x: length(x) >= 2 AND x NOT IN ({quoted(STOPWORDS)}))"
_SLUG = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name)), '\\.md$', ''), '[\\s_]+', '-', 'g'), '-+', '-', 'g'), '-')"
_SQUEEZE = "regexp_replace({}, '\\s+', ' ', 'g')"
_COPIES = """c AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS first_id, max(doc_id) OVER (PARTITION BY text) AS tip,
    count(*) OVER (PARTITION BY text) AS n, lead(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS src FROM documents)"""

ORACLES = {
    "doc_text": f"""WITH d AS (SELECT doc_id, trim(replace(source || ' ' || lang, '_', ' ') || '. ' || {_LINE}) AS x FROM documents)
        SELECT doc_id, md5(x) AS text_md5, length(x) AS n_chars FROM d""",
    "heading_sections": """WITH p AS (SELECT page_id, regexp_split_to_array(html, '<h[1-6]')[2:] AS x FROM pages)
        SELECT page_id, len(x) AS n_sections, md5(array_to_string(x, '|')) AS sections_md5 FROM p""",
    "cleaned_queries": f"""WITH b AS (SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS x FROM benchmark)
        SELECT item_id, CASE WHEN len({_TOKENS.format('x')}) >= 2 THEN x ELSE '' END AS query FROM b""",
    "identity_slugs": """WITH p AS (SELECT p_partkey, left(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 64) AS x FROM part)
        SELECT p_partkey, CASE WHEN coalesce(x, '') = '' THEN 'unknown' ELSE x END AS slug FROM p""",
    "soft_aliases": f"""WITH p AS (SELECT p_partkey, regexp_extract({_SLUG}, '^[^-]*-(.+)$', 1) AS alias FROM part) SELECT * FROM p WHERE alias <> ''""",
    "url_hosts": "SELECT lower(regexp_extract(url, '^(?:https?|ssh|git)://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1",
    "grounding_ids": r"""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(text, 'https?://[^\s<>]+')) AS u, list_distinct(regexp_extract_all(text, '\bv?[0-9]+\.[0-9]+\b')) AS v,
        list_distinct(regexp_extract_all(text, '#[0-9]+')) AS r, list_filter(list_distinct(regexp_extract_all(text, '\b[0-9a-f]{7,40}\b')), lambda x: regexp_matches(x, '[a-f]') AND regexp_matches(x, '[0-9]')) AS s FROM documents)
        SELECT doc_id, len(u) AS n_urls, len(v) AS n_versions, len(r) AS n_refs, len(s) AS n_shas FROM d""",
    "ungrounded_words": """WITH q AS (SELECT conv_id, lower(string_agg(text, ' ' ORDER BY turn)) AS evidence FROM conversations WHERE role = 'user' GROUP BY 1),
        w AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS word FROM conversations WHERE role <> 'user')
        SELECT conv_id, count(*) AS n_words, count(*) FILTER (NOT coalesce(contains(evidence, word), false)) AS n_ungrounded FROM w LEFT JOIN q USING (conv_id) GROUP BY 1""",
    "normalised_lines": """WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents)
        SELECT doc_id, len(l) AS n_lines, md5(array_to_string(l, chr(10))) AS lines_md5 FROM d""",
    "fence_levels": f"""WITH d AS (SELECT doc_id, source, n_chars, text, {_LINE} AS fence FROM documents)
        SELECT CASE WHEN contains(b.text, a.fence) THEN 'exact' WHEN contains({_SQUEEZE.format('b.text')}, {_SQUEEZE.format('a.fence')}) THEN 'whitespace' ELSE 'missing' END AS level,
        count(*) AS n FROM d a JOIN d b ON a.source = b.source AND a.n_chars = b.n_chars AND a.doc_id <> b.doc_id GROUP BY 1""",
    "derived_globs": """WITH p AS (SELECT regexp_extract(url, '^([a-z]+://[^/]+/[^/?#]*)', 1) AS folder, CAST(contains(url, '?') AS INT) AS cited FROM pages),
        g AS (SELECT folder, CAST(sum(cited) AS BIGINT) AS n_cited, count(*) AS n_all FROM p GROUP BY 1) SELECT * FROM g WHERE n_cited > 0 AND n_all <= 3 * n_cited""",
    "citation_candidates": """SELECT l_orderkey AS name, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS hits FROM
        (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 50) GROUP BY 1""".replace("DISTINCT CAST", "CAST", 1),
    "drift_paths": """WITH c AS (SELECT l_partkey, max(l_shipdate) AS changed_at FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
        SELECT l_orderkey, count(DISTINCT l.l_partkey) AS n FROM lineitem l JOIN orders ON o_orderkey = l_orderkey JOIN c ON c.l_partkey = l.l_partkey
        WHERE changed_at IS NULL OR o_orderdate IS NULL OR changed_at > o_orderdate GROUP BY 1""",
    "committed_split": """SELECT coalesce(p_size <= 25, false) AS tracked, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_orderkey) AS n_orders
        FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1""",
    "boundary_lint": """SELECT CASE WHEN p_size IS NULL THEN 'dangling' WHEN p_size > 40 THEN 'far' ELSE 'near' END AS state, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders
        FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE p_size IS NULL OR p_size > 25 GROUP BY 1""",
    "neighbour_attach": f"""WITH {_E}, w AS (SELECT p_partkey AS node FROM part WHERE p_size >= 30), x AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM u
        WHERE src IN (SELECT node FROM w) AND dst NOT IN (SELECT node FROM w)) SELECT src AS node, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours FROM x WHERE n <= 3 GROUP BY 1""",
    "evidence_fold": """WITH r AS (SELECT DISTINCT l_orderkey AS name FROM lineitem WHERE l_returnflag = 'R'), o AS (SELECT DISTINCT l_orderkey AS name FROM lineitem WHERE l_linestatus = 'O'),
        x AS (SELECT name, 'returned' AS lane FROM r UNION ALL SELECT name, 'open' FROM o WHERE name NOT IN (SELECT name FROM r) UNION ALL
          SELECT o_orderkey, 'urgent' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey NOT IN (SELECT name FROM r) AND o_orderkey NOT IN (SELECT name FROM o))
        SELECT lane, count(*) AS n, CAST(sum(name) AS BIGINT) AS names_sum FROM x GROUP BY 1""",
    "interview_queue": """SELECT name FROM (SELECT l_orderkey AS name FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50 UNION
        SELECT o_orderkey FROM orders WHERE (o_orderpriority = '1-URGENT' AND o_totalprice > 300000) OR o_totalprice < 2000)
        WHERE name NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ORDER BY 1 LIMIT 25""",
    "staleness_digest": f"""WITH s AS (SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
        SELECT CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '{NOW}') > 1000 THEN 'expired' WHEN o_orderpriority = '1-URGENT' THEN 'worklisted'
        WHEN lines = 1 THEN 'suppressed' ELSE 'active' END AS state, count(*) AS n, CAST(sum(lines) AS BIGINT) AS lines FROM orders JOIN s ON l_orderkey = o_orderkey GROUP BY 1""",
    "expiry_map": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) AS lapses FROM orders",
    "nondrift_expiry": f"""SELECT * FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) AS lapses FROM orders)
        WHERE lapses < DATE '{NOW}' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
    "row_ages": """SELECT o_orderkey, round(date_diff('second', o_orderdate, max(l_shipdate)) / 86400, 1) AS days FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate""",
    "pair_evidence": """WITH j AS (SELECT o_orderkey AS a, o_orderdate AS d, o_totalprice AS p, lead(o_orderkey) OVER w AS b, lead(o_orderdate) OVER w AS d2, lead(o_totalprice) OVER w AS p2
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
        SELECT CASE WHEN d2 > d AND p2 > p THEN 'b' WHEN d2 < d AND p2 < p THEN 'a' ELSE 'abstain' END AS verdict, count(*) AS n, CAST(sum(a) AS BIGINT) AS a_sum FROM j WHERE b IS NOT NULL GROUP BY 1""",
    "outcome_priors": f"""WITH {_S}, g AS (SELECT item, count(*) FILTER (event_type = 'purchase') AS hits FROM s GROUP BY 1)
        SELECT item, hits, round(1 + 0.10::DOUBLE * least(1.0::DOUBLE, hits / 3), 6) AS factor FROM g""",
    "cooldown_quota": f"""WITH {_S}, f AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, item ORDER BY ts, event_id) = 1 AS INT) AS new FROM s),
        q AS (SELECT event_id, user_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM f) SELECT * FROM q WHERE used <= 5""",
    "young_items": f"""WITH {_S}, b AS (SELECT item, max(ts) AS born FROM s WHERE event_type = 'purchase' GROUP BY 1)
        SELECT item, count(DISTINCT session) AS n_sessions FROM s JOIN b USING (item) WHERE ts >= born GROUP BY 1 HAVING count(DISTINCT session) < {YOUNG}""",
    "authority_gap": f"""WITH {_S}, t AS (SELECT count(DISTINCT session) AS n FROM s), k AS (SELECT CAST(item AS BIGINT) AS p, round(least(1.0::DOUBLE, count(DISTINCT session) / any_value(t.n)), 4) AS st
          FROM s, t GROUP BY item)
        SELECT p_brand, count(*) AS n_weak, count(st) AS n_known FROM part LEFT JOIN k ON p = p_partkey WHERE p_partkey IN (SELECT l_partkey FROM lineitem) AND coalesce(st, 0) < {WEAK} GROUP BY 1""",
    "blind_spots": f"""WITH {_E}, {_S} SELECT p_brand, count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT src FROM u) AND p_partkey NOT IN (SELECT CAST(item AS BIGINT) FROM s) GROUP BY 1""",
    "baseline_health": f"""WITH {_S} SELECT CAST(item AS BIGINT) AS item, count(*) AS n FROM s WHERE CAST(item AS BIGINT) NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) GROUP BY 1""",
    "watermarks": f"""WITH {_S}, l AS (SELECT user_id, arg_max(session, {{'t': ts, 'e': event_id}}) AS session FROM s GROUP BY 1)
        SELECT l.user_id, l.session, arg_min(item, {{'t': ts, 'e': event_id}}) FILTER (event_type = 'purchase') AS item FROM l JOIN s ON s.user_id = l.user_id AND s.session = l.session GROUP BY 1, 2""",
    "latest_metric": """SELECT event_type, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id, arg_max(value, {'t': ts, 'e': event_id}) AS value FROM events WHERE value IS NOT NULL GROUP BY 1""",
    "baseline_diff": """WITH g AS (SELECT event_type, avg(value) FILTER (day(ts) <= 15) AS o, avg(value) FILTER (day(ts) > 15) AS n FROM events GROUP BY 1)
        SELECT event_type, round(o, 6) AS old, round(n, 6) AS new, CASE WHEN o IS NULL OR n IS NULL THEN 'skipped' WHEN (n - o) / o < -0.01 THEN 'worse' WHEN (n - o) / o > 0.01 THEN 'better' ELSE 'same' END AS state FROM g""",
    "draft_sweep": f"""WITH {_S}, g AS (SELECT item, count(DISTINCT user_id) FILTER (event_type = 'purchase') AS buyers, count(*) FILTER (event_type = 'error') AS errors,
          count(*) FILTER (event_type <> 'error') AS others FROM s GROUP BY 1)
        SELECT item, CASE WHEN buyers >= 2 THEN 'graduated' WHEN errors > others / 4 THEN 'expired' ELSE 'kept' END AS fate, buyers, errors FROM g""",
    "seed_salience": f"""WITH {_S}, f AS (SELECT user_id, item, arg_min(session, {{'t': ts, 'e': event_id}}) AS session FROM s GROUP BY 1, 2), n AS (SELECT session, count(*) AS fresh FROM f GROUP BY 1)
        SELECT s.session, 2 * coalesce(any_value(fresh), 0) + 3 * count(*) FILTER (event_type = 'purchase') + 2 * count(*) FILTER (event_type = 'error') AS salience FROM s LEFT JOIN n ON n.session = s.session GROUP BY 1""",
    "coverage": f"""WITH {_S}, c AS (SELECT item, arg_min(user_id, {{'t': ts, 'e': event_id}}) AS creator FROM s GROUP BY 1),
        g AS (SELECT item, count(*) FILTER (event_type = 'purchase' AND user_id <> creator) AS others, count(*) FILTER (event_type = 'purchase' AND user_id = creator) AS own FROM s JOIN c USING (item) GROUP BY 1)
        SELECT CASE WHEN others > 0 THEN 'others' WHEN own > 0 THEN 'own' ELSE 'none' END AS verified, count(*) AS n, CAST(sum(others) AS BIGINT) AS n_others FROM g GROUP BY 1""",
    "snapshot_sets": """WITH g AS (SELECT l_partkey, bool_or(l_shipdate >= TIMESTAMP '1995-06-17') AS n, bool_or(l_shipdate < TIMESTAMP '1995-06-17') AS o FROM lineitem GROUP BY 1)
        SELECT CASE WHEN n THEN 'added' ELSE 'removed' END AS op, count(*) AS n, min(l_partkey) AS first_part FROM g WHERE n <> o GROUP BY 1""",
    "typed_inbound": f"WITH {_COPIES} SELECT doc_id AS dst, src FROM c WHERE src IS NOT NULL",
    "decision_closure": f"WITH {_COPIES} SELECT doc_id, first_id, tip, n FROM c WHERE n > 1",
    "dispute_states": f"""WITH {_E} SELECT least(src, dst) AS a, greatest(src, dst) AS b, CASE WHEN min(src) <> max(src) THEN 'both' WHEN min(src) = least(src, dst) THEN 'a' ELSE 'b' END AS side
        FROM e GROUP BY least(src, dst), greatest(src, dst)""",
    "edge_rot": f"""WITH {_E}, j AS (SELECT e.*, p_partkey, p_size, p_retailprice FROM e LEFT JOIN part ON p_partkey = dst),
        x AS (SELECT 'dangling' AS class FROM j WHERE p_partkey IS NULL UNION ALL SELECT 'archived' FROM j WHERE p_size <= 10 UNION ALL SELECT 'superseded' FROM j WHERE p_retailprice < 1200)
        SELECT class, count(*) AS n FROM x GROUP BY 1""",
    "hub_flags": """WITH o AS (SELECT o_custkey, count(*) AS degree, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1 HAVING count(*) > 8)
        SELECT c_custkey, degree, array_to_string(list_filter([CASE WHEN urgent > 0 THEN 'urgent' END, CASE WHEN c_acctbal > 5000 THEN 'balance' END], lambda x: x IS NOT NULL), ',') AS protected
        FROM customer JOIN o ON o_custkey = c_custkey""",
    "protection_map": f"""WITH {_E}, x AS (SELECT p_partkey AS node, 'floor' AS why FROM part WHERE p_retailprice >= 1800 UNION SELECT src, 'linked' FROM u UNION
        SELECT l_partkey, 'cited' FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 350000))
        SELECT node, string_agg(why, ',' ORDER BY why) AS reasons FROM x GROUP BY 1""",
    "blast_radius": f"""WITH {_E}, l AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS o, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1),
        a AS (SELECT src, count(*) AS n FROM e GROUP BY 1), b AS (SELECT dst, count(*) AS n FROM e GROUP BY 1)
        SELECT p_partkey, coalesce(o, 0) AS orders, coalesce(s, 0) AS suppliers, coalesce(a.n, 0) AS edges_out, coalesce(b.n, 0) AS edges_in
        FROM part LEFT JOIN l ON l_partkey = p_partkey LEFT JOIN a ON src = p_partkey LEFT JOIN b ON dst = p_partkey""",
    "cross_twins": """WITH d AS (SELECT DISTINCT source, sha1(text) AS h FROM documents) SELECT a.source AS a, b.source AS b, count(*) AS n FROM d a JOIN d b ON a.h = b.h AND a.source < b.source GROUP BY 1, 2""",
    "shadowed_names": f"""SELECT md5({_LINE}) AS name FROM documents WHERE source <= 'src12' INTERSECT SELECT md5({_LINE}) FROM documents WHERE source > 'src12'""",
    "recent_queries": """WITH l AS (SELECT md5(text) AS text_md5, max({'c': conv_id, 't': turn}) AS x FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY text)
        SELECT text_md5, x.c AS conv_id, x.t AS turn FROM l ORDER BY conv_id DESC, turn DESC, text_md5 LIMIT 20""",
    "threat_totals": """WITH x AS (SELECT source, 'url' AS kind FROM documents WHERE regexp_matches(text, 'https?://') UNION ALL SELECT source, 'mail' FROM documents WHERE regexp_matches(text, '[a-z0-9.]+@[a-z0-9]+\\.[a-z]')
        UNION ALL SELECT source, 'key' FROM documents WHERE regexp_matches(text, 'AKIA|(?:password|token) *[:=]') UNION ALL SELECT source, 'markup' FROM documents WHERE regexp_matches(text, '<[a-z]+'))
        SELECT kind, count(*) AS n, count(DISTINCT source) AS n_sources FROM x GROUP BY 1""",
    "verification_summary": """WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1)
        SELECT lang, count(*) AS total, count(q) AS verified, count(*) FILTER (q = 1) AS good FROM documents LEFT JOIN l USING (doc_id) GROUP BY 1""",
    "trust_scorecard": """SELECT count(*) AS n_docs, count(DISTINCT source) AS n_sources, count(*) FILTER (length(trim(text)) = 0) AS n_blank, count(*) FILTER (length(trim(text)) < 200) AS n_short,
        count(*) FILTER (n_chars <> length(text)) AS n_wrong_size, count(DISTINCT md5(text)) AS n_texts FROM documents""",
    "promote_candidates": """SELECT doc_id, lang FROM documents WHERE NOT regexp_matches(text, 'https?://|@|[0-9]{5,}') AND doc_id IN
        (SELECT doc_id FROM labels GROUP BY 1 HAVING min(quality) = 1 AND max(toxic) = 0)""",
    "replay_coverage": f"""WITH {_E}, {_S}, v AS (SELECT CAST(item AS BIGINT) AS src, arg_max(event_type, {{'t': ts, 'e': event_id}}) AS verdict FROM s GROUP BY 1)
        SELECT CASE WHEN verdict IS NULL THEN 'never run' WHEN verdict = 'error' THEN 'failing' ELSE 'passing' END AS state, count(*) AS n FROM e LEFT JOIN v USING (src) GROUP BY 1""",
    "graduation_history": f"""WITH {_S}, e AS (SELECT item, count(*) AS errors FROM s WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 3),
        p AS (SELECT item, event_id, row_number() OVER (PARTITION BY item ORDER BY ts, event_id) AS n FROM s WHERE event_type = 'purchase'),
        k AS (SELECT item, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY n) AS events FROM p WHERE n <= 5 GROUP BY 1) SELECT item, errors, coalesce(events, '') AS events FROM e LEFT JOIN k USING (item)""",
    "edge_origins": f"""WITH {_E}, l AS (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem) SELECT l_returnflag AS origin, count(*) AS n, count(DISTINCT src) AS n_sources FROM e JOIN l ON l_partkey = src GROUP BY 1""",
}

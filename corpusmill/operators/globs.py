"""Path patterns and what they reach: braces, globs, and references of rule texts that nothing answers any more.

A glob meets paths by what it says literally: the directories before its first
wildcard, else a whole part of the path, else its file ending. Only a glob that says
none of these is tried on every path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..sources.scratch import stored
from ..sources.tables import table

#: Endings by which a reference is a path and not a dotted name (fixed values).
ENDINGS = "py js mjs cjs jsx ts mts cts tsx json yaml yml toml sh sql md html css go rs java rb c h cpp".split()
#: A wildcard of a glob; a path-like reference, with lines behind it or without; a dotted name.
_WILD = r"[*?]"
PATH_REF = rf"^((?:[A-Za-z0-9_.-]+/)*[A-Za-z0-9_.-]+\.(?:{'|'.join(ENDINGS)}))(?::\d+(?:-\d+)?)?$"
SYMBOL_REF = r"^([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+)(?:\(\))?$"


# --- operators --------------------------------------------------------------------------------------------------------


def expanded(patterns: DataFrame, column: str = "pattern") -> DataFrame:
    """The rows of `patterns` with `glob`, one row for each alternative of the pattern's innermost braces, all groups through.

    `{a,b}` stands for a or b, within other braces too; braces without a partner
    stand for themselves. A round takes one group of every pattern, so there are
    as many rounds as groups in the fullest one.
    """
    left = patterns.withColumn("glob", F.col(column)).where("glob IS NOT NULL")
    done = None
    group = r"^(.*?)\{([^{}]*)\}(.*)$"
    while True:
        left = stored(left)
        has = F.rlike("glob", F.lit("(?s)" + group))
        flat = left.where(~has)
        done = flat if done is None else stored(done.unionByName(flat))
        more = left.where(has)
        if more.isEmpty():
            return done
        # The first group that holds no other: what stands before it may have open braces.
        at = lambda n: F.regexp_extract("glob", "(?s)" + group, n)
        alternatives = F.transform(F.split(at(2), ",", -1), lambda a: F.concat(at(1), a, at(3)))
        left = more.withColumn("glob", F.explode(alternatives))


def glob_pattern(glob: Column) -> Column:
    """The regular expression of a whole path that a glob without braces matches.

    `**/` is any number of directories, `**` anything, `*` and `?` stay within a
    part; all else stands for itself.
    """
    pieces = F.regexp_extract_all(glob, F.lit(r"(\*\*/|\*\*|\*|\?|[^*?]+)"), F.lit(1))
    one = lambda p: (
        F.when(p == "**/", "(?:[^/]+/)*").when(p == "**", ".*").when(p == "*", "[^/]*").when(p == "?", "[^/]").otherwise(F.concat(F.lit(r"\Q"), F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    )
    return F.concat(F.lit("^"), F.array_join(F.transform(pieces, one), ""), F.lit("$"))


def _anchor(glob: Column) -> Column:
    """What a path must offer (`_offers`) for a glob to be tried on it."""
    wild = F.rlike(glob, F.lit(_WILD))
    begin = F.regexp_extract(F.regexp_extract(glob, r"^[^*?]*", 0), "^(.*/)?", 0)
    # After `x**/` a part may go on from the x, so parts are sure only without that.
    parts = F.filter(F.split(glob, "/", -1), lambda s: ~F.rlike(s, F.lit(_WILD)) & (s != ""))
    parts = F.when(F.rlike(glob, F.lit(r"[^/]\*\*/")), F.array().cast("array<string>")).otherwise(parts)
    longest = F.array_max(F.transform(parts, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]
    ending = F.regexp_extract(glob, r"\.([A-Za-z0-9_]+)$", 1)
    return (
        F.when(~wild, F.concat(F.lit("="), glob)).when(begin != "", F.concat(F.lit("<"), begin)).when(F.size(parts) > 0, F.concat(F.lit("/"), longest))
        .when(ending != "", F.concat(F.lit("."), ending)).otherwise("*")
    )


def _offers(path: Column) -> Column:
    """All that globs may ask of a path: itself, its directories, its parts, its ending."""
    parts = F.split(path, "/", -1)
    directories = F.when(
        F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.lit("<"), F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))
    ).otherwise(F.array().cast("array<string>"))
    single = F.array(F.concat(F.lit("="), path), F.concat(F.lit("."), F.regexp_extract(path, r"\.([A-Za-z0-9_]+)$", 1)), F.lit("*"))
    return F.array_distinct(F.concat(directories, F.transform(parts, lambda s: F.concat(F.lit("/"), s)), single))


def glob_matches(globs: DataFrame, paths: DataFrame) -> DataFrame:
    """(glob, path) for every path (path) that a glob (glob), without braces, matches."""
    g = stored(globs.where("glob IS NOT NULL").select("glob", _anchor(F.col("glob")).alias("anchor"), glob_pattern(F.col("glob")).alias("pattern")).distinct())
    p = paths.where("path IS NOT NULL").select("path").distinct().select("path", F.explode(_offers(F.col("path"))).alias("anchor"))
    near = stored(p.join(g.select("anchor").distinct(), "anchor", "left_semi")).join(g, "anchor")
    return near.where(F.rlike("path", F.col("pattern"))).select("glob", "path")


def dead_globs(rules: DataFrame, paths: DataFrame) -> DataFrame:
    """(file, pattern) of the rules' patterns of which no alternative matches any path."""
    every = expanded(rules.select("file", "pattern").where("pattern IS NOT NULL").distinct())
    alive = stored(every).join(glob_matches(every.select("glob"), paths).select("glob").distinct(), "glob", "left_semi")
    return rules.select("file", "pattern").where("pattern IS NOT NULL").distinct().join(alive.select("file", "pattern").distinct(), ["file", "pattern"], "left_anti")


def references(texts: DataFrame) -> DataFrame:
    """(file, ref, kind, name, symbol) of the references between backticks of (file, text), each once.

    kind `path`: name is the path without its line number; kind `symbol`: name is
    the module's file, symbol what it should define. Other spans are left out.
    """
    spans = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"`([^`\n]+)`"), F.lit(1)), lambda s: F.trim(s)))
    found = texts.where("text IS NOT NULL").select("file", F.explode(spans).alias("ref")).distinct()
    is_path, is_symbol = F.rlike("ref", F.lit(PATH_REF)), F.rlike("ref", F.lit(SYMBOL_REF))
    dotted = F.split(F.regexp_extract("ref", SYMBOL_REF, 1), r"\.")
    kind = F.when(is_path, "path").when(is_symbol, "symbol")
    name = F.when(is_path, F.regexp_extract("ref", PATH_REF, 1)).otherwise(F.concat(F.element_at(dotted, F.lit(-2)), F.lit(".py")))
    return found.where(is_path | is_symbol).select("file", "ref", kind.alias("kind"), name.alias("name"), F.when(~is_path, F.element_at(dotted, F.lit(-1))).alias("symbol"))


def dead_references(texts: DataFrame, paths: DataFrame, sources: DataFrame) -> DataFrame:
    """(file, ref, kind) of references that nothing answers.

    A path with a slash must be among `paths` (path); a bare name must be some
    path's last part. A symbol is judged only if one path alone has its module's
    name, and `sources` (path, text) has its text; a module that several paths
    claim, or none, is no finding.
    """
    refs = stored(references(texts))
    known = paths.where("path IS NOT NULL").select("path").distinct()
    last = stored(known.groupBy(F.element_at(F.split("path", "/", -1), -1).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")))
    asked = refs.where("kind = 'path'")
    slashed = asked.where("contains(name, '/')").join(known.withColumnRenamed("path", "name"), "name", "left_anti")
    bare = asked.where("NOT contains(name, '/')").join(last.select("name"), "name", "left_anti")
    modules = refs.where("kind = 'symbol'").join(last.where("n = 1").select("name", "path"), "name")
    defined = F.concat(F.lit(r"(?m)^\s*(?:def|class)\s+"), F.col("symbol"), F.lit(r"\b|^"), F.col("symbol"), F.lit(r"\s*="))
    needed = modules.select("path").distinct()
    held = sources.where("text IS NOT NULL").select("path", "text").join(needed, "path", "left_semi")
    # A symbol is looked for once in a module, however many files name it.
    asked_of = modules.select("path", "symbol").distinct().join(held, "path")
    missing = asked_of.where(~F.rlike("text", defined)).select("path", "symbol").distinct()
    symbols = modules.join(missing, ["path", "symbol"], "left_semi")
    return slashed.select("file", "ref", "kind").unionByName(bare.select("file", "ref", "kind")).unionByName(symbols.select("file", "ref", "kind"))


# --- queries ----------------------------------------------------------------------------------------------------------


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path) of the pages: host and path of their addresses."""
    url = F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select(url.alias("path")).where("path <> ''")


def page_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, pattern): every page rules over its host's pages of some languages and numbers, and over paths with a part
    named as one of its links."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"), T.text_of("html").alias("html"))
    links = F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="/([A-Za-z]+)"'), F.lit(1)))
    own = p.select(F.col("page_id").alias("file"), F.explode(F.array(F.concat("host", F.lit("/{en,fr}/**")), F.concat("host", F.lit("/{de,{en,es}}/{1,2,3}?")))).alias("pattern"))
    named = p.select(F.col("page_id").alias("file"), F.explode(links).alias("name")).select("file", F.concat(F.lit("**/"), F.lower("name"), F.lit("/**")).alias("pattern"))
    return own.unionByName(named)


def dead_page_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of the pages' rules that no page's address answers."""
    return dead_globs(page_rules(spark, sf_dir), page_paths(spark, sf_dir))


QUERIES = {f.__name__: f for f in (dead_page_globs,)}

ORACLES = {
    "dead_page_globs": r"""WITH p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages WHERE regexp_extract(url, '^[a-z]+://([^?#]*)', 1) <> ''),
        own AS (SELECT page_id AS file, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages),
        named AS (SELECT DISTINCT page_id AS file, lower(name) AS name FROM (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), 'href="/([A-Za-z]+)"', 1)) AS name FROM pages)),
        parts AS (SELECT DISTINCT unnest(string_split(path, '/')[:-2]) AS part FROM p)
        SELECT file, host || '/{en,fr}/**' AS pattern FROM own WHERE NOT EXISTS (SELECT 1 FROM p WHERE starts_with(path, host || '/en/') OR starts_with(path, host || '/fr/'))
        UNION SELECT file, host || '/{de,{en,es}}/{1,2,3}?' FROM own WHERE NOT EXISTS (SELECT 1 FROM p WHERE starts_with(path, host || '/') AND regexp_matches(substr(path, length(host) + 2), '^(de|en|es)/[123][^/]$'))
        UNION SELECT file, '**/' || name || '/**' FROM named WHERE name NOT IN (SELECT part FROM parts)""",
}

"""Readers of document folders and of line ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as S

#: Names in a document folder that are no documents (fixed values).
RESERVED = ("MEMORY.md", "README.md", "INDEX.md")


def is_document(name: Column, reserved: tuple[str, ...] = RESERVED) -> Column:
    return name.endswith(".md") & ~name.isin(*reserved)


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """(name, file, text) of a folder's documents, one row a file.

    The argument form of wholetext is needed: the option form is read as false.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    return files.where(is_document(F.col("file"))).select(
        F.regexp_replace("file", r"\.md$", "").alias("name"), "file", F.col("value").alias("text")
    )


def frontmatter(text: Column) -> Column:
    """The block between the fences at the very start; null without a closed one."""
    found = F.regexp_extract(text, r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    return F.when(F.rlike(text, F.lit(r"(?s)\A---[ \t]*\r?\n(?:.*?\r?\n)?---[ \t]*(?:\r?\n|\z)")), found)


def body(text: Column) -> Column:
    """The text after its frontmatter; all of it without a closed one."""
    return F.regexp_replace(text, r"(?s)\A---[ \t]*\r?\n(?:.*?\r?\n)?---[ \t]*(?:\r?\n|\z)", "")


def fields(text: Column) -> Column:
    """map<string,string> of the frontmatter's flat `key: value` lines; nested keys by their own name.

    Values lose one pair of quotes. Colons inside a value stay. A repeated key
    keeps its first value.
    """
    lines = F.filter(F.split(F.coalesce(frontmatter(text), F.lit("")), r"\r?\n"), lambda x: F.rlike(x, F.lit(r"^\s*[\w-]+:\s+\S")))
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            F.regexp_extract(x, r"^\s*([\w-]+):", 1).alias("key"),
            F.regexp_replace(F.trim(F.regexp_extract(x, r"^\s*[\w-]+:\s+(.*)$", 1)), r"""^(["'])(.*)\1$""", "$2").alias("value"),
        ),
    )
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(first)


def steer(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low == "pin", low)


def confidence(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin("draft", "verified", "authoritative"), low)


RECALL_EVENT = S.StructType(
    [
        S.StructField("ts", S.DoubleType()),
        S.StructField("session_id", S.StringType()),
        S.StructField("names", S.ArrayType(S.StringType())),
        S.StructField("scores", S.ArrayType(S.DoubleType())),
        S.StructField("ranks", S.ArrayType(S.IntegerType())),
        S.StructField("backend", S.StringType()),
        S.StructField("latency_ms", S.DoubleType()),
        S.StructField("k", S.IntegerType()),
        S.StructField("query_preview", S.StringType()),
        S.StructField("channel", S.StringType()),
    ]
)
OUTCOME = S.StructType(
    [
        S.StructField("ts", S.DoubleType()),
        S.StructField("session_id", S.StringType()),
        S.StructField("tool", S.StringType()),
        S.StructField("path", S.StringType()),
        S.StructField("cited_by", S.ArrayType(S.StringType())),
        S.StructField("tree_path", S.StringType()),
    ]
)


#: Fields of the further ledgers, all optional.
LEDGERS = {
    "episode": "ts double, session_id string, query_preview string, recalled_names array<string>, head_commit string",
    "decision": "ts double, session_id string, text string",
    "reconsolidation": "ts double, name string, outcome string, invalidated boolean, invalid_after string, superseded_by string, "
    "succession_replay map<string,string>",
    "regret": "ts double, query string, stem string",
    "injection_cost": "ts double, session_id string, producers map<string,bigint>, total bigint, cap bigint",
    "threat": "ts double, session_id string, source string, name string, kinds array<string>",
    "eval_run": "ts double, head string, fixture_fingerprint string, corpus_fingerprint string, metrics map<string,double>",
    "usage": "names array<string>, sessions map<string,bigint>",
}
#: Characters of a query, and of a decision, that a ledger keeps.
PREVIEW_CHARS, DECISION_CHARS = 80, 500


def parse_ledger(lines: DataFrame, schema: S.StructType | str = RECALL_EVENT, line: str = "value") -> DataFrame:
    """Rows of JSON lines; lines that aren't objects of the schema are left out, absent keys are null."""
    objects = lines.where(F.rlike(line, F.lit(r"^\s*\{")) & F.try_parse_json(line).isNotNull())
    parsed = F.from_json(line, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return objects.select(parsed.alias("r")).select("r.*")


def read_ledger(spark: SparkSession, path: str, schema: S.StructType | str = RECALL_EVENT) -> DataFrame:
    """Rows of a JSON-lines ledger, as `parse_ledger` takes them."""
    return parse_ledger(spark.read.text(path), schema)


def ledger_lines(rows: DataFrame) -> DataFrame:
    """One JSON object a row; fields without a value are left out."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def committed_usage(rows: DataFrame) -> DataFrame:
    """(name, sessions) over all committed usage files: their names together, their session counts summed."""
    names = rows.select(F.explode("names").alias("name"), F.lit(0).cast("bigint").alias("sessions"))
    counts = rows.select(F.explode("sessions").alias("name", "sessions"))
    return names.unionByName(counts).groupBy("name").agg(F.sum("sessions").alias("sessions"))


def append_ledger(rows: DataFrame, path: str) -> None:
    """Add rows to a JSON-lines ledger folder."""
    rows.write.mode("append").json(path)

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import lint


def one(spark, make, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in df.select("i", make(F.col("x"))).orderBy("i").collect()]


def test_tokens(spark):
    got = one(spark, lambda x: T.tokens(T.text_of(x)), "The Café is a foo_bar x 42!", "", None, "東京2024 data", "日 a")
    assert got == [["café", "foo_bar", "42"], [], [], ["東京", "2024", "data"], ["日"]]


@pytest.mark.parametrize(
    "word,want",
    [
        ("classes", "class"), ("boxes", "box"), ("watches", "watch"), ("queries", "query"), ("movies", "movies"), ("embeds", "embed"),
        ("analysis", "analysis"), ("embedding", "embed"), ("hopping", "hop"), ("tested", "test"), ("embed", "embed"), ("calling", "call"),
        ("tokenizes", "tokenize"), ("ties", "ties"), ("string", "string"), ("moved", "moved"), ("x", "x"), ("ing", "ing"), ("bus", "bus"),
    ],
)
def test_stem(spark, word, want):
    assert one(spark, T.stem, word) == [want]


def test_names_and_links(spark):
    assert one(spark, T.slug, " My Note_One.md ", "a  -- b") == ["my-note-one", "a-b"]
    text = "see [[A b|shown]] and [[c#part]] and `[[no]]` [[c]]\n```\n[[no]]\n```"
    assert one(spark, T.wikilinks, text) == [["A b", "c"]]
    assert one(spark, T.citations, "in src/a_b.py:12 and src/a_b.py, x.py") == [["src/a_b.py"]]


def test_chunks_and_lines(spark):
    long = "word " * 30
    assert one(spark, T.chunks, f"short\n\n{long}\n\n{long}\n\n{long}\n\n{long}")[0] == [long.strip()] * 3
    assert one(spark, T.first_line, "tiny\n```x y z w\nhere it is\n") == ["here it is"]


def test_invisible_characters(spark):
    text = "a​b \U0001f468‍\U0001f469 ‮ x"
    found = one(spark, lint.invisible, text)[0]
    assert (found["zero_width"], found["bidi"], found["private_use"]) == (1, 1, 1)
    assert one(spark, lint.mixed_script, "pаy pay мир") == [1]
    assert one(spark, lint.lint_flags, "![x](https://e.com/i.png?d=1) <!-- hid -->") == [["html-comment", "exfil"]]

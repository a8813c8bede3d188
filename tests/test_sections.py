import pytest
from pyspark.sql import functions as F

from steerframe.operators import sections as so

CASES = [
    (
        "[[POSITIVE]]\nhi {{X}}\n[[x ]]\nshared\n[[NEGATIVE 2]]\nno",
        [("POSITIVE", "hi {{X}}"), ("X", "shared"), ("NEGATIVE 2", "no")],
    ),
    ("[[A]]\n[[B]]\n[[C]]\ntext", [("A", "[[B]]"), ("C", "text")]),
    ("[[A]]\nz\n[[B]]", [("A", "z\n[[B]]")]),
    ("[[A]]\nmid [[B]]\ntail\n[[C]]\nq", [("A", "mid [[B]]\ntail"), ("C", "q")]),
    ("[[A]]\nx\n\n[[B]]\n\n[[C]]\n", [("A", "x\n"), ("B", ""), ("C", "")]),
    ("[[a]b]]\nfoo [[K]]\nbar", []),
    ("[[a]b]]\nfoo\n[[K]]\nbar", [("K", "bar")]),
    ("plain", [("SHARED", "plain")]),
    ("", [("SHARED", "")]),
    ("[[A]]\n1\n[[B]]\n2\n[[a]]\n3", [("A", "3"), ("B", "2")]),
    ("[[ ]]\nblank name\n[[B]]\n2", [("", "blank name"), ("B", "2")]),
    ("[[ é ]]\nwide blanks", [("É", "wide blanks")]),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_parse(spark, text, expected):
    df = spark.createDataFrame([(1, text)], "k long, t string")
    rows = so.parse_sections(df, "t", ["k"]).orderBy("ord").collect()
    assert [(r.name, r.text) for r in rows] == expected
    assert [r.ord for r in rows] == list(range(len(rows)))


def test_long_text(spark):
    text = "[[A]]\n" + "line\n" * 200_000 + "[[B]]\nend"
    df = spark.createDataFrame([(1, text)], "k long, t string")
    rows = so.parse_sections(df, "t", ["k"]).orderBy("ord").collect()
    assert [(r.name, len(r.text)) for r in rows] == [("A", 999_999), ("B", 3)]


def variants(spark, char, inst=""):
    df = spark.createDataFrame(
        [(1, char, inst)], "spec_id long, char_context string, inst_context string"
    )
    rows = so.prompt_variants(df).orderBy("batch_idx").collect()
    assert [r.batch_idx for r in rows] == list(range(len(rows)))
    assert {(r.numpos, r.numneg) for r in rows} == {
        (
            sum(r.polarity == "positive" for r in rows),
            sum(r.polarity == "negative" for r in rows),
        )
    }
    return [(r.polarity, r.name, r.char_text, r.inst_text) for r in rows]


def test_shared_text_in_both(spark):
    char = (
        "[[SHARED]]\nInstructions:\n- Pet the dog.\n[[POSITIVE]]\nDo these {{SHARED}}"
        "\n[[NEGATIVE]]\nDon't do these {{SHARED}}"
    )
    assert variants(spark, char) == [
        ("positive", "POSITIVE", "Do these Instructions:\n- Pet the dog.", ""),
        ("negative", "NEGATIVE", "Don't do these Instructions:\n- Pet the dog.", ""),
    ]


def test_no_sections_is_one_positive(spark):
    assert variants(spark, "just text", "inst") == [
        ("positive", "POSITIVE", "just text", "inst")
    ]


def test_last_extra_is_promoted(spark):
    assert variants(spark, "[[POSITIVE A]]\na\n[[POSITIVE B]]\nb", "i") == [
        ("positive", "POSITIVE", "b", "i"),
        ("positive", "POSITIVE A", "a", "i"),
    ]


def test_empty_negative_is_not_replaced(spark):
    out = variants(spark, "[[POSITIVE]]\np\n[[NEGATIVE]]\n\n[[NEGATIVE 2]]\nn2", "i")
    assert out == [
        ("positive", "POSITIVE", "p", "i"),
        ("negative", "NEGATIVE 2", "n2", ""),
    ]


def test_character_negative_takes_instruction_positive(spark):
    assert variants(spark, "[[POSITIVE]]\np\n[[NEGATIVE]]\nn", "i")[-1] == (
        "negative", "NEGATIVE", "n", "i",
    )
    # not the other way round
    assert variants(spark, "p", "[[POSITIVE]]\ni\n[[NEGATIVE]]\nin")[-1] == (
        "negative", "NEGATIVE", "", "in",
    )


def test_nested_placeholder_needs_later_section(spark):
    forward = "[[POSITIVE]]\n{{A}}\n[[A]]\na {{B}}\n[[B]]\nb"
    backward = "[[POSITIVE]]\n{{A}}\n[[B]]\nb\n[[A]]\na {{B}}"
    assert variants(spark, forward)[0][2] == "a b"
    assert variants(spark, backward)[0][2] == "a {{B}}"


def test_strip_markers(spark):
    df = spark.createDataFrame(
        [("a<|chat|>b",), ("<|nochat|>a<|chat|>b<|nochat|>",)], "t string"
    )
    assert [r.t for r in so.strip_markers(df, "t").collect()] == ["a<|chat|>b", "ab"]


def test_variants_need_no_shuffle(spark):
    df = spark.range(10).select(
        F.col("id").alias("spec_id"),
        F.lit("[[POSITIVE]]\nx").alias("char_context"),
        F.lit("y").alias("inst_context"),
    )
    plan = so.prompt_variants(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="no_such"):
        so.parse_sections(spark.range(1), "no_such", ["id"])

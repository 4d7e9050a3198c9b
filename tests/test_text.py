"""Text functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from factloom import fixed_values as fv
from factloom.functions import text as tx


def values(spark, fn, texts):
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "i int, t string").select("i", fn(F.col("t")).alias("v"))
    return [r["v"] for r in df.orderBy("i").collect()]


def check(spark, fn, cases):
    assert values(spark, fn, list(cases)) == list(cases.values())


def test_clean_text(spark):
    check(
        spark,
        tx.clean_text,
        {
            "itâ€™s â€˜so": "it's 'so",
            "â€œaâ€\x9d": '"a"',
            "aâ€“bâ€”câ€¢d": "a-b-c-d",
            "xÂ yÂz": "x yz",
            "a  b\t\tc": "a b c",
            "a\r\nb\r\n\r\n\r\nc": "a\n\nb\n\nc",
            "a\n\n\n\n\nb": "a\n\nb",
            " 　 a  ": "a",
            "": "",
        },
    )


def test_sentences_limits_and_boundaries(spark):
    s34, s35, s700, s701 = "A" * 34, "A" * 35, "B" * 700, "B" * 701
    long_a = "This sentence is long enough to be kept by the filter."
    long_b = "Another sentence that is also long enough to be kept!"
    cases = {
        s34: [],
        s35: [s35],
        s700: [s700],
        s701: [],
        f"{long_a}  {long_b}": [long_a, long_b],
        f'{long_a} "{long_b}': [long_a, f'"{long_b}'],
        f"{long_a} É{long_b[1:]}": [f"{long_a} É{long_b[1:]}"],
        f"{long_a} {long_b}": [long_a, long_b],
        f"- {long_a} - ": [long_a],
        "": [],
    }
    check(spark, tx.sentences, cases)


def test_content_terms(spark):
    check(
        spark,
        tx.content_terms,
        {
            "The EV and EVs of q1 q5 GM U.S.": ["q1"],
            "Year-over-year HAS_MARKET_SHARE don't": ["year-over-year", "market", "share", "don't"],
            "tesla Tesla 2024": ["tesla", "tesla"],
        },
    )


def test_markers(spark):
    got = values(spark, tx.query_markers, ["Q1 2024 sales up 5% and 50.5% YEAR OVER YEAR; q9 1999"])
    assert set(got[0]) == {"q1", "2024", "5%", "50.5%", "sales", "year over year"}
    hits = values(spark, lambda t: tx.marker_hits(F.array(F.lit("5%"), F.lit("sales")), t), ["15% of Sales", "no"])
    assert hits == [2, 0]


def test_marker_candidates_are_all_markers_in_a_text(spark):
    texts = ["up 15.25% in 202024, 2019% of xq1q4", "1.2.5% Sales", "none", "2%3%", "year-over-year 50%: More than 50%"]
    forms = [f"q{i}" for i in range(1, 5)] + [f"20{i:02d}" for i in range(100)] + [f"{i}%" for i in range(2100)]
    forms += [f"0{i}%" for i in range(100)]
    forms += [f"{i}.{j}%" for i in range(20) for j in range(30)] + list(fv.MARKER_PHRASES)
    got = values(spark, tx.marker_candidates, texts)
    for text, found in zip(texts, got):
        assert {m for m in forms if m in text.lower()} == set(found)


def test_numbers(spark):
    check(
        spark,
        tx.numbers,
        {
            "US$1,234.5 million and 12.5%": ["US$1,234.5 million", "12.5%", "1,234"],
            "21,912, in 2024": ["21,912", "2024"],
            "$7.5 billion": ["$7.5 billion"],
            "only 12": [],
        },
    )


def test_names(spark):
    check(spark, tx.entity_key, {"Mercedes-Benz  Group": "mercedesbenzgroup", " U.S.": "us"})
    check(
        spark,
        tx.relation_name,
        {
            " year-over year ": "YEAROVER_YEAR",
            "a\tb": "AB",
            "": "RELATED_TO",
            "%%": "RELATED_TO",
            "x" * 70: "X" * 60,
            "has  Market_share": "HAS_MARKET_SHARE",
        },
    )
    check(spark, tx.metric_node, {" a \n b ": "metric:a b", "c" * 100: "metric:" + "c" * 90})
    check(spark, tx.dedup_key, {"Été, A_b -- c!": "été a_b c", "***": ""})


def test_garbage(spark):
    check(
        spark,
        tx.is_garbage,
        {
            "": False,
            "a" * 985 + "�" * 15: False,
            "a" * 983 + "�" * 16: True,
            "a" * 983 + "\x01" * 16: True,
            "\n\t\r" * 50: False,
            "endobj " * 12: False,
            "endobj " * 6 + "endstream " * 7: True,
        },
    )


def test_headers(spark):
    raw = "Query: q\nTitle:  First \nTitle: Second\nLink: l m\nSnippet: \n\nFull Content:\nbody\nFull Content: again"
    got = {
        f: values(spark, lambda t, f=f: tx.header_field(t, f), [raw])[0]
        for f in ("Query", "Title", "Link", "Snippet", "Missing")
    }
    assert got == {"Query": "q", "Title": "First", "Link": "l m", "Snippet": "Full Content:", "Missing": ""}
    bodies = values(spark, lambda t: tx.body_after(t, "Full Content:"), [raw, "none"])
    assert bodies == ["\nbody\nFull Content: again", ""]


def test_json_object(spark):
    check(
        spark,
        tx.json_object,
        {
            '{"a": 1}': '{"a": 1}',
            'Sure: {"a": {"b": 2}} done': '{"a": {"b": 2}}',
            "[1, 2]": None,
            '{"a": ': None,
            "no": None,
        },
    )


@pytest.mark.parametrize(
    "seconds, text", [(59.4, "59s"), (60.0, "1.0 minutes"), (600.0, "10.0 minutes"), (7200.0, "2.0 hours")]
)
def test_durations(spark, seconds, text):
    assert spark.range(1).select(tx.format_duration(F.lit(seconds))).first()[0] == text


def test_whole_texts_are_asked_for_by_default():
    from factloom.sources.chat import ChatSettings

    key = {"OPENAI_API_KEY": "k"}
    assert ChatSettings("k").max_chunks_per_doc is None and ChatSettings.from_env(key).max_chunks_per_doc is None
    assert ChatSettings.from_env(key | {"FACTLOOM_MAX_CHUNKS_PER_DOC": "3"}).max_chunks_per_doc == 3


def test_characters_are_not_looked_up_one_by_one(spark, capsys):
    df = spark.createDataFrame([("a　\n b  c d\r",)], "t string")
    for fn, wanted in ((tx.clean_text, "a　\n b c d"), (tx.collapse_spaces, "a b c d")):
        found = df.select(fn(F.col("t")).alias("v"))
        found.explain(True)
        assert "translate(" not in capsys.readouterr().out
        assert found.first()["v"] == wanted
    check(spark, tx.is_garbage, {"abc\x00\x01": True, "\x0b\x1f�": True, "a\t\r\n" * 9: False, "": False})

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, recipe string, node long, keep_id long, _source string, v string, p string, nth int, IDS string"
WORDS = "thorin anand relished enough mountains gravely whispering lanterns across seventeen harbours quietly beneath silver clouds wandering forgotten orchards towards distant meadows"


def odd_row(doc_id, text, lang="en", source="src0"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", "y", 1, 2, "z", "v", "p", 3, "i")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, further columns with names like our own."""
    long = (WORDS + ". ") * 2000
    rows = [
        odd_row(1, WORDS),
        odd_row(2, WORDS),
        odd_row(3, WORDS),
        odd_row(3, WORDS),
        odd_row(4, None),
        odd_row(5, None),
        odd_row(6, ""),
        odd_row(7, ""),
        odd_row(None, "a text without an identifier, all on its own in this table of quite odd rows"),
        odd_row(8, "no language is known for this one, though it has words enough for that", lang=None),
        odd_row(9, "no source is known for this one, though it has words enough for that too", source=None),
        odd_row(10, long),
        odd_row(11, long + "and an end"),
        odd_row(12, "\n\t  \n"),
        odd_row(13, "Ünïcödé 日本語 😀   ▁ é́ " * 3),
        (14, None, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

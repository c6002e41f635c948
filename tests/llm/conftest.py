import pytest

from loamline.llm.shared import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_ string, row string, fp long, id string, t string, n_words string, kept string, copy_ int"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, columns that clash with the operators' own."""
    long = "Wort eins zwei. " * 4000 + "\n" + "x" * 30000
    rows = [
        (1, "one two three four five six seven\nRepeated line of six plain words\n\nRepeated line of six plain words", "en", "a", 5),
        (2, "Repeated line of six simple words\nshort line\nshort line", "en", "a", 5),
        (3, None, None, None, None), (3, None, None, None, None), (4, "", "de", "b", 0), (5, " \n\t ", "de", None, 1),
        (6, long, "de", "b", len(long)), (7, long, "de", "b", len(long)), (None, "no id here but some words", "fr", "c", 1), (None, None, None, "c", None),
        (8, "MIT License MIT LICENSE, Apache license; general public license", "en", "c", 1), (9, "ÄÖÜ äöü École ONE two 漢字 <|endoftext|> it's 12345", "fr", "c", 1),
        (10, "same text twice in a row", "en", "d", 1), (10, "same text twice in a row", "en", "d", 1), (10, "other text, same id", "en", "d", 1),
    ]
    return spark.createDataFrame([(*r, "x", "y", 7, "i", "t", "w", "k", 1) for r in rows], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 4000
MESSY = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 60),
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 60),
    (2, "one two three four five six seven eight nine ten eleven twelve", None, "b", None),
    (3, None, "en", "a", 0),
    (4, "", None, None, None),
    (5, " \t\n ", "de", "b", 3),
    (None, "a row without an id", "en", "c", 19),
    (None, None, None, None, None),
    (6, "word", "en", None, 4),
    (7, LONG, "en", "a", len(LONG)),
    (8, "ÄÖÜ ñandú 漢字 emoji 😀 end", "de", "c", 22),
    (8, "another text with an id used before", "de", "c", 35),
    (-9, "negative id", "fr", "b", 11),
]


@pytest.fixture
def messy(spark):
    """Nulls in every column, empty and blank texts, a long text, repeated rows and ids."""
    return spark.createDataFrame(MESSY, DOC_SCHEMA)


@pytest.fixture
def clashing(messy):
    """The same with further columns, named as the operators' own ones might be."""
    from pyspark.sql import functions as F

    names = ("row", "point", "n", "keys", "size", "p", "o", "bucket", "copies", "open", "target", "held", "label", "chunk", "y", "of", "kept_key", "score")
    return messy.select("*", *[F.lit(7).alias(c) for c in names])


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def words_of(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    import re

    return re.findall("[^\x20\x09-\x0d]+", low)

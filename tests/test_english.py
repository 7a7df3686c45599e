"""The English normaliser of word errors."""

import pytest
from pyspark.sql import functions as F

from loomline.functions import align
from loomline.functions.english import english_kept_words, english_words


@pytest.mark.parametrize(
    ("said", "heard"),
    [
        ("It's forty-five past two.", "it is 45 past 2"),
        ("One hundred and five boats, twelve thousand three hundred men", "105 boats 12300 men"),
        ("Don't worry, they'll won't", "do not worry they will will not"),
        ("um, Mr. Hill's dog (laughs) ate 1,250 pies [noise]", "mister hills dog ate 1250 pies"),
        ("two million and six, seven twenty one", "2000006 7 21"),
        ("ninety % of ﬁsh", "90 percent of fish"),
        ("salt and pepper and nine hundred and", "salt and pepper and 900 and"),
        ("hundred thousand zero", "hundred thousand 0"),
        ("...", ""),
    ],
)
def test_words(said, heard):
    assert english_words(said) == heard.split()


def test_numbers_said_and_written_are_no_errors(spark):
    rows = spark.createDataFrame([("We meet at six forty five", "we meet at 6 45."), ("ten left", "eleven left"), (None, "x")], "r string, h string")
    pairs = rows.select(english_kept_words("r").alias("r"), english_kept_words("h").alias("h"))
    assert [x[0] for x in pairs.select(align.word_errors_native(F.col("r"), F.col("h"))).collect()] == [0, 1, 1]

import pytest
from pyspark.sql import SparkSession

SPACES = " \t\n\r\x0b\x0c"

#: Texts of every awkward kind.
TEXTS = [
    None,
    "",
    " \n\t",
    "one",
    "one two",
    "Die Straße, naïve Übung. Éa ñandú!",
    "MIT License and the Apache License, under the GNU General Public License.",
    "a\x1cb \x01c  d\n\ne .. f?! _g_ 1²3",
    "漢字かな交じり文 😀👍🏽 é ​ x",
    "<|endoftext|> it's they'll 'S don't",
    "same words here " * 40,
    "same words here " * 40,
    "Long text. " * 20_000,
    "İstanbul K ΑΣ",
]


@pytest.fixture(scope="session")
def texts():
    return TEXTS


@pytest.fixture
def docs(spark: SparkSession):
    """Documents with a repeated row, a null id, nulls in every column, and clashing extra columns."""
    rows = [(i, text, "en", None if i % 3 == 0 else f"src{i % 3}", None, "x", i) for i, text in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id", None, None, None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, size bigint"
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def none(spark: SparkSession):
    """Documents without rows."""
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")

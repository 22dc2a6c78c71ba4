import os

import pytest

from fieldgrid.llm.common import prepare


@pytest.fixture(scope="session", autouse=True)
def prepared(spark):
    prepare(spark)


@pytest.fixture(scope="session")
def sf_dir():
    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("test tables are not mounted")
    return path


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


ODD_TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "Ünï côdé ПРИВЕТ 你好 word",
    "a b c d e f g h i j k l m n o p q r s t u v w x y z",
    "a b c d e f g h i j k l m n o p q r s t u v w x y z",
    "  double  blanks \r\n and\ttabs . , and ..dots, ,x ",
    "bell\x07 and\x1cseparators\x85nel nbsp line <|endoftext|> mark",
    "Don't STOP, it's 12,345.67 é ﬁ ß İ \U0001f600\U0001f600 x.\n\n\ny",
    "very long " * 30_000,
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated ids, null, empty, long and repeated texts, columns with clashing names."""
    rows = [(i, t, "s", 1) for i, t in enumerate(ODD_TEXTS)] + [(None, "null id text here now", None, None), (3, "one", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long").repartition(3)

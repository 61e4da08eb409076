import pytest

SF = "/root/testdata/sf0.001"

#: Rows that every operator must take: nulls in any column, empty and long texts, ties, repeats.
ODD = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "src0", 35),
    (1, "alpha beta gamma delta epsilon zeta", "en", "src0", 35),
    (2, "", "en", "src0", 0),
    (3, None, "en", None, None),
    (None, "Alpha BETA gamma delta  epsilon\nzeta", None, "src1", 3),
    (4, "   \n\t ", "fr", "src1", 5),
    (5, "word " * 30_000, "en", "src0", 150_000),
    (6, "日本語 テスト 🎉 café naïve straße", "de", "src2", 20),
    (7, "<|endoftext|> it's we'll 12,5 x--y", "en", "src2", 30),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd(spark):
    """The odd rows, with extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD, SCHEMA)
    return rows.withColumns({c: F.lit("x") for c in ("start", "length", "kept", "n_words", "spans", "score", "bucket", "tie", "piece", "component_id")})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


#: Texts that every operator has to stand, with clashing columns beside them.
ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one"),
    (5, "one"),
    (5, "one"),
    (6, "the quick brown fox jumps over the lazy dog " * 3),
    (7, "the quick brown fox jumps over the lazy dog " * 3),
    (8, "word " * 40_000),
    (9, "x" * 200_000),
    (10, "日本語のテキスト éèß 🎉 <|endoftext|> <|im_end|>"),
    (None, "a row without an id"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", "src0", 0, "n", -1, True) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int, score string, bucket int, kept boolean")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")

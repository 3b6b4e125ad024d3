import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def bpe_file():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 997} über{i % 13}, x" for i in range(60_000))
    rows = [(1, "The quick brown fox jumps over the lazy dog near the old river bank.", "en", "a", 1),
            (1, "The quick brown fox jumps over the lazy dog near the old river bank.", "en", "a", 1),
            (2, None, None, None, None), (3, "", "en", "a", 0), (None, "no id here at all", "en", "b", 2),
            (4, long, "de", "a", len(long)), (5, long + " end", "de", "a", 1), (6, "  \n\t ", "en", "a", 3),
            (7, "short", "en", None, 5), (8, "The quick brown fox jumps over the lazy dog near the old river bank.", "en", "c", 9)]
    clash = ", score double, fp long, row long, n long, component_id long, slot int, text_crc32 string"
    return spark.createDataFrame([(*r, 0.5, 1, 2, 3, 4, 5, "x") for r in rows], DOCS + clash)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")

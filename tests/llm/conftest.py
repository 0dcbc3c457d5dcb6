import pytest

TEXT_KIND = "doc_id long, text string, lang string, source string, n_chars long, n int, id long, size string, key string, rep string, words string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, blank and long texts, ties, repeated rows, and columns whose names operators use inside."""
    long_text = " ".join(f"w{i % 997}x{i // 997}" for i in range(30000))
    para = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix strange potions near an old stone bridge at dawn and count every passing boat on the slow green river until the bells of the small town ring for the third time and all the shops begin to open their doors again today"
    rows = [
        (1, para, "en", "a"), (1, para, "en", "a"), (2, para, "en", "b"), (3, None, None, None), (4, "", "en", "a"), (5, "  \n\t ", "de", None),
        (6, long_text, "en", "a"), (None, para + " indeed", "en", "a"), (7, "Ä ö 😀 ñ", "de", "b"), (8, "one two", "en", "b"), (9, "one two", None, "b"), (50, para.upper(), "en", "c"),
    ]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, 0, 1, "s", "k", "r", "w") for r in rows], TEXT_KIND)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], TEXT_KIND)

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, fp long, n_tokens long, findings string, label string"
CLEAN = "The quick brown fox jumps over the lazy dog near the river bank while seven birds watch from a tall old tree by the mill. "


def doc(i, text, lang="en", source="s1"):
    return (i, text, lang, source, None if text is None else len(text), "r", "k", 1, 2, "f", "l")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, and columns that clash with inner names."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [
        (None,) * 11,
        doc(None, "a text without id but with words in it"),
        doc(1, ""),
        doc(1, ""),
        doc(2, None),
        doc(3, long),
        doc(4, CLEAN),
        doc(4, CLEAN),
        doc(5, CLEAN, None, None),
        doc(6, "  \n\t\n ", "de"),
        doc(7, "12 34 !!! ???"),
        doc(8, "Überall läuft das Wasser über die Straße und der Hund schläft", "de", "s2"),
        doc(9, "🎉 emoji \x00 control   line"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

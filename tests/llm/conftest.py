import pytest

LONG = " ".join(f"w{i}" for i in range(3000))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, repeats, ties and clashing extra columns."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n", None, "b"), (4, base, "en", "b"), (5, base, "en", "c"),
            (6, base.upper(), "en", "c"), (7, base + " phi", "en", "d"), (8, LONG, "de", "d"), (9, LONG + " tail", "de", "e"),
            (10, "Ünïcode ß wörter 123", "de", None), (11, "one two", "en", "a"), (12, "one two", "en", "a"), (13, "same same same same same same", "en", "a")]
    extra = [(*r, 1, 2, "x", 0.5) for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, rep long, size long, key string, score double")

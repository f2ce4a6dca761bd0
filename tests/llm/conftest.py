import pytest

ODD_TEXTS = [None, "", " \n\t", "one", "Gleiche Wörter  gleiche wörter", " x  y", "a" * 5000, "word " * 3000, "it's we'LL 12½ x<|endoftext|>y <|ENDOFTEXT|> z"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, long and repeated texts, null and repeated ids, and columns whose names operators use themselves."""
    rows = [(k, x, "t", k) for k, x in enumerate(ODD_TEXTS)] + [(3, "one", "u", 0), (None, "no id at all here", None, None), (20, "word " * 3000, "a", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, root int")

import pytest

from quire.llm.shared import ship_package


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture
def docs(spark):
    """Texts that every operator must survive: null, empty, blank, long,
    repeated rows, ties, other scripts, and columns with odd names."""
    texts = [None, "", "   \n", "One plain sentence of eight words in all.", "One plain sentence of eight words in all.",
             "x" * 50_000, "long words " * 9_000, "Ein Satz auf Deutsch, mit Umlauten: äöüß.", "日本語の文章。", "12345 !!",
             "tabs\t\tand  doubled   blanks \n end ", "<|endoftext|> inside"]
    rows = [(i, t, None if i % 5 == 0 else "en", "s", len(t or ""), i, i, "c") for i, t in enumerate(texts)]
    rows += [rows[3], (None, "One plain sentence of eight words in all.", "de", None, None, 1, 1, "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "rid int, _sha int, block string")

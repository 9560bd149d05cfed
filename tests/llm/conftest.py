import pytest

PROSE = "The quick brown fox jumps over the lazy dog, and nobody minds at all. "
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, shard string, kept string, contaminated string, n_tokens string, lang_pred string, n_lines string, mix_shard string, extra string"


def rows_of(texts, source="s", lang="en", first=0):
    return [(first + i, t, lang, source, None, *["mine"] * 10) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 977} tail{i % 31}." for i in range(60_000))
    rows = rows_of([PROSE * 5, PROSE * 5, "", None, " \t\n", long, "a", "one two", "12 34 !!", PROSE.upper() * 9])
    rows += [rows[0], rows[0]]  # repeated rows
    rows += [(None, PROSE, None, None, None, *[None] * 10), (None, None, None, None, None, *[None] * 10), (1 << 62, "naïve café — ﬁn 中文 İstanbul Σας 👍🏽", "fr", "t", 3, *["x"] * 10)]
    return spark.createDataFrame(rows, SHAPE).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"

import pytest

LONG = " ".join(f"word{i % 977} tail{i}" for i in range(6000))
PASSAGE = "zu der einen passage gehören viele worte die sonst nirgends stehen " * 9


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (None, None), (1, None), (2, ""), (3, " \n\t\n"), (4, "one"), (4, "one"), (None, "one"), (5, LONG), (6, LONG), (7, "a\x00b 'S it''s <|endoftext|> é ß 日本 Σ"),
        *((10 + i, f"Common Line \n own {i} text\n" + PASSAGE + f"\nend {i}") for i in range(12)),
        (30, "Released under the MIT License.\nmit license, Apache license; General  Public-License"),
    ]
    names = "doc_id long, text string, score string, kept string, lines string, vertex string, label string, n_chars long"
    return spark.createDataFrame([(i, t, "s", "k", "l", "v", "x", len(t or "")) for i, t in rows], names).repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality long, toxic long")

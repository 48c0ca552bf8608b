import pytest

EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, bits long, c0 string, row_id string, _id string, spans string"
BASE = "the quick brown fox jumps over the lazy dog and then it runs back to the river bank before night falls again today"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, repeated rows and ids, texts that differ a little."""
    near = BASE.replace("lazy", "sleepy")
    texts = [
        (1, BASE), (2, BASE), (2, BASE), (2, "another text under the same id, with token = \"abcdef0123\" in it"), (3, None), (4, ""), (5, "   \n\t"),
        (6, near), (7, "Éa ÀB " * 3 + "İ ß Σ"), (8, "a" * 60_000), (9, " ".join(f"w{k}" for k in range(30_000))), (None, BASE),
        (None, None), (10, "x"), (11, "x y"), (12, "AKIA" + "A" * 20 + " deadbeefdeadbeefdeadbeef"), (13, "Released under the MIT License."),
        (14, "password: hunter2hunter2 \U0001F600 passwd=short"), (15, "!!! ### 123"), (16, " ".join(["same"] * 50)),
    ]
    return [(i, t, None if i == 1 else "en", None, None, 1, 2, "c", "r", "i", "s") for i, t in texts]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, EDGE_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)

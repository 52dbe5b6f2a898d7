import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, w string, f long, score int"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    good = "The quick fox went over the hill and saw a river near the old mill where water ran under the wooden bridge. "
    rows = [
        (1, good * 3), (2, (good * 3).replace(" ", "  ")), (3, good * 3 + "End."), (3, good * 3 + "End."), (None, good * 3), (None, None),
        (4, ""), (5, None), (6, " \n\t "), (7, "word " * 120), (8, "Call +1 (702) 555-0742 or a.b@c.example.org from 10.0.0.1 with 4111 1111 1111 1111."),
        (9, "é" * 5000 + " 12@34.56 ++++ 1.2.3.4.5.6.7.8 +1"), (10, "x" * 200_000), (11, "1" * 3000 + " " + "1-" * 3000), (12, "a.b@" * 2000),
        (13, " ".join(f"w{i}" for i in range(30_000))), (14, "a b c a b c\na b c\n\n a b c"), (15, "Δ ς ÀÉ Straße #*$%&|<> <|endoftext|> it's"),
    ]
    rows = [(i, t, None if i == 4 else "en", None if i in (5, None) else f"s{(i or 0) % 3}", len(t or ""), "r", "k", "w", 1, 2) for i, t in rows]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")

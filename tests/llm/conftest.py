import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark, tmp_path_factory):
    """Rows as a scan of a written table, which is what the operators are given."""

    def run(rows, schema=SCHEMA, files=3):
        path = str(tmp_path_factory.mktemp("docs") / "t.parquet")
        spark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
        return spark.read.parquet(path)

    return run


LOREM = (
    "the erth tion of and are by in the estha that ingre from to anre was ofer with thes onti "
    "heat or is be an on this for it as at lyan which were had not but what all when your can said"
).split()


def prose(seed: int, n: int) -> str:
    """Words with little repetition, the same for the same seed."""
    import random

    r = random.Random(seed)
    return " ".join(r.choice(LOREM) + r.choice(LOREM) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties, and repeated rows."""
    long_ = prose(99, 30_000)
    rows = [
        (1, prose(1, 80), "en", "a", 1), (2, prose(1, 80), "en", "a", 1), (2, prose(1, 80), "en", "a", 1),
        (3, None, "en", "b", None), (4, "", None, "b", 0), (5, " \n\t", "de", None, 3), (None, prose(2, 60), "de", "b", 9),
        (None, None, None, None, None), (6, long_, "en", "c", len(long_)), (7, long_ + " end", "en", "c", 1),
        (8, "12 34 !!", "en", "a", 8), (9, "été über ñandú 漢字 🎉 <|endoftext|>", "fr", "a", 30), (10, "a " * 200, "en", None, 400),
        (11, prose(3, 400) + "\n" + prose(4, 40), "en", "a", 1), (12, prose(5, 30) + "\n" + prose(4, 40), "en", "a", 1),
        (2**40, "one two three", "es", "d", 13),
    ]
    return rows

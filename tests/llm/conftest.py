import pytest

WORDS = "the of and reon thed ation inest heran blees ouing wasti thare nered orati shand".split()


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text, source) with columns that the operators also use as names."""
    def make(*rows):
        schema = ("doc_id long, text string, source string, spans int, items string, fp int, size string, "
                  "id string, copies int, `_text` string, `n_words` string")
        return spark.createDataFrame([(*r, 1, "x", 2, "s", "i", 7, "t", "w") for r in rows], schema)
    return make


def prose(seed: int, n: int) -> str:
    """Words that do not repeat in runs of three or more between seeds."""
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(1000)) for _ in range(n))


AWKWARD = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (None, "one two three", "b"), (None, None, None),
           (5, "word " * 30000, "b"), (6, "é" * 70000, "b"), (7, "same text here now", "b"), (7, "same text here now", "b"),
           (8, "same text here now", "c"), (9, "x\x00y \x1fz", "c")]

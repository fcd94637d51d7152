import random

import pytest

WORDS = "the of and storm river alpha beta gamma delta moon idiot Été straße niño x1 2000 Über".split()


@pytest.fixture
def documents(spark):
    """Texts with nulls, blanks, ties, repeated rows, a long text and columns that clash with added ones."""
    pick = random.Random(5)
    say = lambda n: " ".join(pick.choice(WORDS) for _ in range(n))
    texts = [say(pick.randint(1, 60)) for _ in range(40)] + [None, "", "   ", "...", say(3000)]
    data = [(i, t, pick.choice(["en", "fr", None]), pick.choice(["a", "b", None]), i % 3, "x") for i, t in enumerate(texts)]
    data += [(100, texts[3], "en", "a", 0, "x"), (100, texts[3], "en", "a", 0, "x"), (None, texts[4], "en", None, 0, "x"), (101, texts[5].upper(), "en", "b", 0, "x")]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, size int, score string")


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")

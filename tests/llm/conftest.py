import random

import pytest

WORDS = "the of and heron lantern tide mast river stone quill ember fathom crest willow anchor drift sable".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (rng.choice(["", "", ",", "."])) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, odd characters, empty, blank and long ones."""
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(1, 120)) + f" uniq{i} " + sentence(rng, 30) for i in range(40)]
    near = []
    for t in base[:8]:
        words = t.split()
        for k in range(3):
            copy = list(words)
            copy[(7 * k) % len(copy)] = f"edit{k}"
            near.append(" ".join(copy))
    return base + near + base[:5] + [None, "", "   ", "\n\t", "one", "one two", "One TWO", "çà et là", "日本語 テキスト です", "###  </turn> \\ it's <|endoftext|>", sentence(rng, 6000), "1234 !!"]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with a clashing extra column, a null id and a repeated row."""
    rows = [(i, t, "en" if i % 3 else None, "src", len(t or ""), i) for i, t in enumerate(texts)]
    rows += [(None, texts[0], "en", None, None, 1), (3, texts[3], "en", "src", 1, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hash long")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

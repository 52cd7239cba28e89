import random

import pytest

WORDS = "the of and in to a is was for on that with as it be by from at this are or an have not river stone light garden winter morning letter window silver shadow travel market".split()


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + (str(r.randint(0, 99)) if r.random() < 0.2 else "") for _ in range(n)) + "."


@pytest.fixture
def texts():
    """Documents with exact and near copies, shared passages and lines, junk, nulls and very long ones."""
    r = random.Random(7)
    docs = ["\n".join(sentence(r, r.randint(5, 40)) for _ in range(r.randint(1, 12))) for _ in range(60)]
    docs += [docs[0], docs[0], docs[1].replace("river", "rivers"), docs[2] + " end"]
    passage = sentence(r, 70)
    docs += [f"{sentence(r, 30)} {passage} {sentence(r, 20)}" for _ in range(4)]
    docs += [None, "", " \n\t ", "a", "a b", "héllo wörld ñandú " * 30, "x" * 30_000, "word " * 20_000, "1 2 3 4 " * 50, "# $ % & " * 60]
    return docs


@pytest.fixture
def docs(spark, texts):
    """(doc_id, text, lang, source, n_chars) with clashing extra columns."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or ""), 1, "x", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp int, row string, node int").repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def odd_ids(spark):
    """Null and repeated ids."""
    rows = [(None, "one two three four", "en", "a", 1), (5, "same text here now", "en", "a", 1), (5, "same text here now", "en", "a", 1), (5, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

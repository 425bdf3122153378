import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, lane long, k1 string, `__k` long, cid long, quality string"


@pytest.fixture(scope="session")
def make(spark):
    """Rows of documents: (doc_id, text, lang, source), with further columns whose names clash with inner ones."""

    def docs(rows):
        full = [(i, t, la, s, None if t is None else len(t), 7, 7, "x", 7, 7, "q") for i, t, la, s in rows]
        return spark.createDataFrame(full, DOCS)

    return docs


@pytest.fixture(scope="session")
def prose():
    """Random prose of made-up words."""

    def text(seed, n_words, vocabulary=400, per_line=12):
        r = random.Random(seed)
        words = [f"w{r.randrange(vocabulary)}" for _ in range(n_words)]
        return "\n".join(" ".join(words[i : i + per_line]) for i in range(0, n_words, per_line))

    return text


#: Null id and text, empty text, blank text, a repeated row, one id with two texts, odd white space.
ODD = [(None, None, None, None), (None, "one two three four five six", "en", None), (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, "same row", "en", "b"), (4, "same row", "en", "b"), (5, "first text", "fr", "b"), (5, "second text", "fr", "c"), (6, "tab\tand  two spaces \n\n end ", "en", "c")]

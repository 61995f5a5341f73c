import random

import pytest

#: names the operators use inside
CLASHING = ("_id", "_row", "key", "node", "band", "n", "n_lines", "fail_bits", "mix_epoch", "component", "_doc", "n_words", "_text", "part", "length")


@pytest.fixture(scope="session")
def frame(spark):
    """(id, text) rows as a documents table, with extra columns of clashing names."""

    def make(rows, clash=True):
        rng = random.Random(0)
        extra = CLASHING if clash else ()
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint" + "".join(f", `{c}` string" for c in extra)
        data = [
            (i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None]), None if t is None else len(t), *(["x"] * len(extra)))
            for i, t in rows
        ]
        return spark.createDataFrame(data, schema)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Null ids and texts, repeated rows, one id with two texts, very long texts."""
    long = " ".join(f"w{k % 700}" for k in range(30_000))
    return [
        (None, "null id text with some words in it\nA line of its own here"),
        (None, None),
        (1, None),
        (2, ""),
        (3, "   \n \t\n"),
        (4, "twice the same row\nA line of its own here"),
        (4, "twice the same row\nA line of its own here"),
        (5, "one id first text, A LINE of its own here"),
        (5, "one id second text\n a line OF its own here \nz"),
        (6, long),
        (7, long + " end"),
        (8, "x" * 200_000),
        (9, "É a LINE of its own here é"),
        (10, "é a line of its own here é"),
    ]

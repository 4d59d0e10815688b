import random

import pytest

#: Texts that try the edges: nothing, white space, odd letters, long runs, special strings.
EDGE_TEXTS = [
    None, "", " ", "\n\t ", "a", "Don't STOP, they'll say: it's 3.14!", "ÀÉÎ ß ſ ﬁ Σας ΟΔΟΣ İstanbul", "日本語テキスト と english", "é ñ Å",
    "<|endoftext|> inside <|startoftext|>text", "x" * 300, "=" * 500, "  \u0085 spaces\x1c\x1d", "🙂🙂 emoji 👩‍👩‍👧", "12345678901234567890 1 2 3", "﻿bom ​zero", "word " * 400,
]


@pytest.fixture
def edge_docs(spark):
    rows = [(i, t, 1) for i, t in enumerate(EDGE_TEXTS)] + [(None, "no id", 1), (3, "repeated id", 1), (3, "repeated id", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, `count` int")


@pytest.fixture
def prose():
    rng = random.Random(5)
    words = ["the", "of", "tion", "Ering", "oué", "schät", "ñadoe", "and", "thanedble", "a", "Über", "l'eau", "x1", "--", "co-op", "U.S."]
    return [" ".join(rng.choice(words) + rng.choice(["", ",", ".", "!\n", ""]) for _ in range(rng.randrange(1, 400))) for _ in range(60)]

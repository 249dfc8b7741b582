import random

import pytest

SYLLABLES = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu ma me mi mo mu na ne ni no nu ra re ri ro ru sa se si so su ta te ti to tu".split()


def prose(seed: int, words: int) -> str:
    """Invented prose in sentences."""
    r = random.Random(seed)
    out = []
    for k in range(words):
        w = "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))
        out.append(w.capitalize() if not out or out[-1].endswith(".") else w)
        if r.random() < 0.1:
            out[-1] += "."
    return " ".join(out)


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows, and columns of clashing names."""
    long_text = prose(1, 30_000)
    rows = [
        (1, prose(2, 120), "en", "a"), (2, prose(3, 80), "en", "b"), (3, prose(2, 120), "fr", None), (3, prose(2, 120), "fr", None),
        (None, prose(4, 40), None, "a"), (None, None, None, None), (5, None, "en", "a"), (6, "", "en", "c"), (7, " \n\t ", "de", "a"),
        (8, long_text, "en", "a"), (9, "word", "en", "b"), (10, "😀 Ärger　中文 <|endoftext|>", "de", "b"), (10, "other text of ten", "en", "b"),
    ]
    full = [(d, t, lang, s, None if t is None else len(t), k, k, k, "x", k, k) for k, (d, t, lang, s) in enumerate(rows)]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, row int, tid int, key int, _spans string, bucket int, shard int"
    return spark.createDataFrame(full, ddl).coalesce(2)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.filter("doc_id < -1")

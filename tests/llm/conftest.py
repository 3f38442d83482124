"""A table of documents with the awkward cases, and plain versions to compare with."""

import random

import pytest

WORDS = "the of and thing stone river house light under seven little green walk never again north paper mouse table cloud".split()

#: id, text, lang and columns whose names operators use themselves
SCHEMA = "doc_id long, text string, lang string, n long, digest string, salt int, row string, part int, th long, slot int, runs string, size long"


def invented(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.choice(["", "s", "ing", "ed"])) for _ in range(n))


def awkward():
    rng = random.Random(7)
    passage = invented(rng, 60)
    long_text = invented(rng, 9000)
    base = invented(rng, 200)
    words = base.split()
    words[50] = "changed"
    words[150] = "altered"
    near = " ".join(words)
    texts = [
        None, "", " \t\n ", "One", "two words", "three little WORDS", "THREE LITTLE words", "Ünder Über", "ÜNDER über",
        long_text, long_text + " end", base, near, base.upper(), "x" * 5000, " " * 3000 + "after space", "tail " + " " * 3000,
        invented(rng, 80) + "\n" + passage + "  " + invented(rng, 10), passage + " and more", invented(rng, 40) + " " + passage,
        "write to jane.doe@example.com or +1 (555) 010-9999 today", "+1 (836) 555-9331 4913187196670932 53.121.55.90",
        "cards 4111 1111 1111 1111 and 4111111111111112, version 1.2.3.4.5 and 300.1.1.1", "a@b.com_x@y.org a@@b.com .@-.-",
        "é́ ﬁ İstanbul ΣΑΣ 漢字 <|endoftext|> don't WE'LL 12,345", "1 2 3 4 5", "...",
    ]
    rows = [(i, t, "en", 1, "d", 2, "r", 3, 4, 5, "u", 6) for i, t in enumerate(texts)]
    rows += [rows[6], rows[11], rows[18]]
    rows += [(None, "no id", None, *rows[0][3:]), (None, None, None, *rows[0][3:]), (100, long_text, "en", *rows[0][3:])]
    return rows


@pytest.fixture(scope="session")
def rows():
    return awkward()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

"""Documents that the tests of all operators share."""

import random

import pytest

from helpers import SCHEMA, VOCABULARY


@pytest.fixture(scope="session")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="session")
def texts():
    """Copies, near copies, shared passages, odd characters, personal data, a null, empty and very long texts."""
    r = random.Random(11)
    words = ["the", "of", "and", *("".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(400))]
    make = lambda n: " ".join(r.choices(words, k=n))
    passage = make(30)
    long = make(9000)
    out = [make(80), make(60) + ". " + passage, passage + "\n" + make(70), "", None, "Ok", long, long.replace("the", "die", 1), "ÀÉ ß İstanbul Σας <|endoftext|> x", "   ", "日本語 and ½ é"]
    out += [out[0], out[0].upper(), out[0].replace("of", "off", 1), make(50) + "\n" + "same line here\n" * 20]
    for i in range(6):
        out.append(f"{make(40)} write to Zorbax.vim and mail jo.do@ex-ample.org or 10.0.0.{i} +1 (555) 010-99{i}0 or card 4111 1111 1111 1111 end {make(10)}")
    out += [f"{make(20)}" for _ in range(10)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or ""), "x", None, "r", "t", "l") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n, stems=("the", "and", "ing", "tion", "er", "on", "ble", "sh", "re", "th")):
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Edge cases and ordinary texts by id."""
    rng = random.Random(5)
    rows = {
        1: None, 2: "", 3: "   \n\t ", 4: "Hello, World! it's 2024", 5: "don't 'll 'S\n\nx", 6: "naïve café ß ÀÉ ½ ²", 7: "漢字 text 🎉 <|endoftext|> more", 8: "a" * 5000, 9: "▁ marked ▁▁ text",
        10: "Nul\0inside and  two blanks ", 11: "Released under the MIT License.\nReleased under the MIT License.", 12: prose(rng, 20000),
    }
    for i in range(13, 60):
        rows[i] = prose(rng, rng.randint(5, 120)).capitalize() + "."
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", "c", None)[i % 4], len(t or "")) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

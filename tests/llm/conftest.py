import random

import pytest

SYLLABLES = {"en": ["the", "ing", "er", "on", "at", "th"], "fr": ["eau", "é", "ou", "ment", "le", "qu"], "de": ["sch", "ü", "ung", "ei", "pf", "der"]}


def words(rng, n, lang="en"):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus():
    """Texts with copies, near copies, shared passages, junk, and the odd cases: null, empty, blank, one word, long."""
    rng = random.Random(5)
    langs = ["en", "fr", "de"]
    rows = [(i, words(rng, rng.randint(60, 200), langs[i % 3]) + ".\n" + words(rng, 30, langs[i % 3]), langs[i % 3], f"s{i % 2}") for i in range(150)]
    passage = words(rng, 110)
    next_id = 150

    def more(text, lang="en", source="s0"):
        nonlocal next_id
        rows.append((next_id, text, lang, source))
        next_id += 1

    for i in range(0, 12, 3):
        more(rows[i][1])
        more(rows[i][1])
        changed = rows[i][1].split(" ")
        changed[len(changed) // 2] = "changed"
        more(" ".join(changed))
    for i in range(12):
        more(words(rng, 40 + i) + " " + passage + " " + words(rng, 30))
    for i in range(4):
        more(" ".join(w + "$$$" for w in words(rng, 80).split()), "fr", "s1")
    more("word " * 300)
    more(("same line\n" * 40) + words(rng, 100))
    for odd in (None, "", "   \n\t ", "one", "One", "two words", "12345 678 !!", "日本語のテキスト", "<|endoftext|> and <|endoftext|>", "a" * 900, "a" * 1000, "é" * 500, "\x00 nul \x00"):
        more(odd)
    more(words(rng, 25_000), None, None)
    more(rows[3][1], None, "s1")
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


#: Columns whose names the operators use inside.
CLASHING = ["rk", "spans", "set_id", "n", "k", "h", "c", "key", "row", "bin", "part", "range", "block", "a", "b", "held_out", "grp", "component_id", "_key"]


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    return frame.withColumn("n_chars", F.length("text").cast("long")).select("*", *(F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHING)))


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)

import pytest

#: Texts that every operator on documents has to take: null, empty, blank, long, one long word, repeated, not ASCII.
TEXTS = [None, "", " \t\n ", "a", "one two three four five six seven", "one two three four five six seven",
         "x" * 5000, "éß 漢字 🙂   a b <|endoftext|> </s>", "word " * 3000, "idiot scum trash " * 30,
         "A quick brown fox jumps over the lazy dog and then it sleeps for a very long time in the sun",
         "A quick brown fox jumps over the lazy dog and then it sleeps for a very long time in the shade",
         "tab\tand\x0bvt\x0cff\rcr \x00nul"]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot string, score double, block long, size long, part int, p double, n long, m long, uid string, copy int, target string, `__order` string, `__copy` int, `__text_key` string, `__doc_id_key` int, `__score` string, `__x` int, `__removed_bytes` string, `__nth` int, row string, removed int, times string"


@pytest.fixture(scope="session")
def odd_rows():
    rows = []
    for i, t in enumerate(TEXTS):
        rows.append((i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, None if t is None else len(t)))
    rows += [(4, TEXTS[4], "en", "src0", 33), (4, TEXTS[4], "en", "src0", 33), (None, "no id here", None, None, None), (7, "another text of id seven", "de", "src1", 5)]
    return [r + (1, "s", 0.5, 2, 3, 4, 0.25, 5, 6, "u", 7, "t", "o", 8, "k", 9, "c", 10, "b", 11, "w", 12, "n") for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """Rows with nulls, ties, repeats and extra columns whose names the operators use inside."""
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")

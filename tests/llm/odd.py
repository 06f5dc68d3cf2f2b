"""Rows that every operator must take: nulls, empty texts, repeats, ties, a very long text, clashing names."""

LONG = "word " * 30_000 + "x" * 5_000

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.", "a"),
    (2, None, "a"),
    (3, "", "b"),
    (4, " \n\t ", None),
    (None, "No number at all, but some words.", "b"),
    (5, "The quick brown fox jumps over the lazy dog.", "c"),
    (5, "The quick brown fox jumps over the lazy dog.", "c"),
    (6, LONG, "a"),
    (7, "ÀÉ ß 中文 😀 é x́ don't we'll ▁ <|endoftext|> <s> \x00 \x85   end", None),
    (8, "one", "a"),
]
SCHEMA = (
    "doc_id long, text string, source string, size int, score string, fp string, word int, kind string, `rows` int,"
    " copies int, number int, block int, total int, text_ string"
)


def documents(spark, rows=None):
    """The rows with other columns whose names operators use themselves."""
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(i, t, s, 1, "s", "f", 2, "k", 3, 4, 5, 6, 7, "t") for i, t, s in rows], SCHEMA)

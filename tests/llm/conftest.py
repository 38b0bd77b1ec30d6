import pytest

ODD = "x" * 30


@pytest.fixture
def table(spark):
    """Rows of (doc_id, text) as a documents table with clashing extra columns."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), 1.5, "w", 7) for i, t in rows]
        schema = (
            "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string, "
            "component_id int"
        )
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def awkward():
    """Nulls, empty texts, odd white space, one huge word, repeats, symbols and characters beyond ASCII."""
    long = " ".join(f"w{k % 977}" for k in range(6000))
    return [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "one two three four"), (6, "y" * 5000), (7, long), (8, long),
        (9, "Ünïcode  línea\nÜnïcode  línea\n日本語 テキスト 🎉\r\nlast"), (10, "a b c d e f g h"), (10, "a b c d e f g h"),
        (11, "###" * 40), (12, "\x00\x01 odd"), (13, "A B C D E F G H"),
    ]

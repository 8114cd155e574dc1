import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """make_docs(texts or rows): a documents table; rows are (doc_id, text, lang, source)."""

    def make(rows, slices=3):
        rows = [r if isinstance(r, tuple) else (i, r, "en", "s") for i, r in enumerate(rows)]
        data = [(*r, None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(data, SCHEMA).repartition(slices) if data else spark.createDataFrame([], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty, white space, one word, repeats, many scripts, a long word, a long text."""
    return [
        None, "", " \n\t", "word", "A a\nA a\n\nB", "one two three four five six", "the same line\nthe same line\nthe same line\nonce",
        "naïve Straße été — 日本語 テキスト 🙂", "x" * 300_000, "alpha beta gamma delta epsilon " * 4000, "a b c d e f a b c d e g", "a b c d e f a b c d e g", "\x00\x01 nul",
        "%%% ### | | | & <b> 12 34", "\r\nwin\r\nlines\r\n",
    ]

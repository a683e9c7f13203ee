import pytest

WIDE = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, class_id string, token int, "
    "words string, start int, score double, label int, ids string, span string, kept string, row_no int"
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of ``(doc_id, text)`` or ``(doc_id, text, source)``, with clashing further columns."""

    def make(rows):
        wide = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, "c", 1, "w", 2, 0.5, 1, "i", "s", "k", 3) for r in rows]
        df = spark.createDataFrame(wide, WIDE)
        return df.repartition(3) if rows else df

    return make


LONG = " ".join(f"word{k % 977} other{k % 31}." for k in range(60_000))


@pytest.fixture(scope="session")
def edge_docs(make_docs):
    """Nulls, empty and blank texts, a very long one, ties and repeated rows."""
    return make_docs(
        [
            (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "one"), (6, "one two three four"),
            (7, "Same text here, five words and more of them."), (8, "Same text here, five words and more of them."),
            (8, "Same text here, five words and more of them."), (None, "no id"), (None, None),
            (9, "no id"), (10, "ünïcödé 中文 😀 \x00 control"), (11, "a" * 50_000), (12, "!!! ... ,,,"), (13, None, None),
        ]
    )


EDGE_IDS = [None, None, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9, 10, 11, 12, 13]

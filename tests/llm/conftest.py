import pytest

#: Names that operators use inside, as extra columns of the input.
CLASHING = "key rank copies score hits hash p node sig grams first_id by_doc_id by_key mix_copies mix_times bucket_x root share list".split()
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with extra columns whose names clash."""

    def make(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        values = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1])) for r in rows]
        if extra:
            schema += "".join(f", {c} string" for c in CLASHING)
            values = [(*v, *("x",) * len(CLASHING)) for v in values]
        return spark.createDataFrame(values, schema)

    return make


@pytest.fixture
def odd():
    """Nulls, empty and blank texts, marks alone, a very long text, repeated rows, repeated ids."""
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa "
    return [
        (1, None), (2, ""), (3, "   "), (4, "..."), (5, word * 20_000), (6, "one two"), (7, "one two"), (7, "one two"), (None, "one two"), (None, None),
        (8, "other text under one id"), (8, "quite another text under the same id"), (9, ""), (10, "é ünïcode 漢字 \U0001f600 text"),
    ]

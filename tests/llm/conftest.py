import pytest

#: Columns besides those of documents, with names that operators use themselves.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "kept boolean, rank long, length long, salt string, key string, label string, n long, score double, shard long"
)


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text[, lang]) as documents with further columns of clashing names."""

    def make(*rows, partitions: int = 3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None, None, 1, 5, "x", None, "y", 1, 0.5, 9) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return make


@pytest.fixture
def collected():
    """All rows as plain tuples in a fixed order."""
    return lambda df, *names: sorted([tuple(r) for r in (df.select(*names) if names else df).collect()], key=repr)

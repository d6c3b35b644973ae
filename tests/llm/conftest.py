import pytest

#: Columns that clash with names the operators use inside.
CLASH = "id bigint, n bigint, text_len bigint, shard int, digest string, __row bigint, u bigint, comp bigint, idx int, block bigint, doc bigint, line int, gone int, __h bigint, __t bigint, __removed int, __words string, __text string, skey string, turn int, label int, size int"


@pytest.fixture(scope="session")
def llm_docs(spark):
    """Build a documents table from (doc_id, text[, source]) rows, with clashing extra columns if asked for."""

    def build(rows, clash=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        if clash:
            from pyspark.sql import functions as F

            for part in CLASH.split(", "):
                name, kind = part.rsplit(" ", 1)
                df = df.withColumn(name, F.lit("7").cast(kind))
        return df

    return build


ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (None, "a text without an id that is long enough to matter here"),
    (4, "one two three four five six seven eight nine ten"),
    (4, "one two three four five six seven eight nine ten"),
    (5, "one two three four five six seven eight nine ten"),
    (6, "word " * 30000 + "end"),
    (7, "Ünï çødé 日本語 🎉 text with more words than five of them"),
    (8, "x"),
]


@pytest.fixture(scope="session")
def odd():
    """Nulls in id and text, empty, blank and very long texts, repeated rows."""
    return ODD

"""Lines of one to four words, in op4 and in the pipeline."""

import random

import pytest

import corpus_pipeline
from quire.llm import line_dedup

from test_dedup import brute_lines


@pytest.mark.parametrize("width", [1, 5])
def test_short_lines_match_brute_force(spark, llm_docs, width):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(6)]
    rows = [(d, "\n".join(" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 4, 5, 9]))) for _ in range(rng.randint(0, 6)))) for d in range(30)]
    got = {(r.doc, r.line) for r in line_dedup.removed_lines(llm_docs(rows), width=width, min_words=1).collect()}
    assert got == brute_lines(rows, width, 80, 100, 1) and got


def test_short_lines_are_removed(spark, llm_docs, tmp_path):
    docs = llm_docs([(1, "All rights reserved.\n\nother\n"), (2, "all rights reserved.\n\nAll rights")])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.removed_lines for r in line_dedup.op4_line_dedup(spark, str(tmp_path)).collect()} == {1: [], 2: [0]}
    assert {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, "").collect()} == {1: "All rights reserved.\n\nother\n", 2: "\nAll rights"}

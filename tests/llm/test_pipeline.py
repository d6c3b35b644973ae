"""The pipeline's stages on the small tables and on odd rows."""

import importlib

import pytest
from pyspark.sql import functions as F

corpus_pipeline = importlib.import_module("corpus_pipeline")


def test_stages_follow_one_another(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        rows.append(docs.count())
        assert docs.filter("n_chars <> length(text)").count() == 0
    assert rows[1] < rows[0] and rows[2] <= rows[1] and rows[3] <= rows[2]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == rows[-1] and out.filter("n_tokens <> size(ids)").count() == 0


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_each_stage_takes_odd_rows(spark, sf, llm_docs, odd, at):
    name, stage = corpus_pipeline.STAGES[at]
    docs = llm_docs(odd, clash=True)
    out = stage(spark, docs, sf)
    assert out.count() <= 2 * len(odd)
    if name == "near_dedup":
        left = out.groupBy("text").agg(F.count("*").alias("n")).filter("text like 'one two%'").first()
        assert left.n == 2  # rows with the same id are one vertex
    assert stage(spark, llm_docs([]), sf).count() == 0


def test_stages_match_brute_force(spark, sf):
    """Each stage's rows against plain Python on its own input: line dedup, near dedup, mixing and encoding of the documents that the classifier keeps."""
    import hashlib
    from collections import Counter

    from test_dedup import brute_lines, least_reachable, shingle_words
    from tokenizers import Tokenizer

    from quire.llm import bpe, mixing

    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 4000")
    kept = {r.doc_id: r.text for r in corpus_pipeline.keep_quality(spark, docs, sf).collect()}
    assert 0 < len(kept) < docs.count() and all(docs.filter(F.col("doc_id") == i).first().text == t for i, t in list(kept.items())[:3])

    stage = corpus_pipeline.drop_lines(spark, docs, sf).cache()
    texts = {r.doc_id: r.text for r in docs.collect()}
    gone = brute_lines(list(texts.items()), 5, 80, 100, 1)
    want = {}
    for i, t in texts.items():
        lines = [line for n, line in enumerate((t or "").split("\n")) if (i, n) not in gone]
        if any((i, n) in gone for n in range(len((t or "").split("\n")))):
            t = "\n".join(lines)
            if not t.split():
                continue
        want[i] = t
    assert {r.doc_id: r.text for r in stage.collect()} == want and gone

    out = corpus_pipeline.drop_near_copies(spark, docs, sf)
    sets = {i: shingle_words(t, 5) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    top = least_reachable(sets, links)
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i in top if top[i] == i) and links

    mixed = corpus_pipeline.mix_sources(spark, docs, sf).cache()
    taken = {r["__id"]: r.taken for r in mixing.taken_words(mixing.mix(docs)).collect()}
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(r.text.split())
        assert set(r.text.split()) <= set(texts[r.doc_id].split())
    assert got == Counter({i: n for i, n in taken.items() if n})

    library = Tokenizer.from_file(bpe.vocabulary_path())
    for r, s in zip(corpus_pipeline.encode(spark, docs.limit(60), sf).collect(), docs.limit(60).collect(), strict=True):
        ids = library.encode(s.text or "", add_special_tokens=False).ids
        assert r.doc_id == s.doc_id and r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

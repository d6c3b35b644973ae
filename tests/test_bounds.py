"""What is broadcast and what is handed to Python stays in bounds."""

from pyspark.sql import functions as F

from quire.plans.files import table
from quire.sources.scratch import bounded, settle, spread

KEYS = ("spark.sql.sources.fileCompressionFactor", "spark.sql.execution.arrow.maxBytesPerBatch")


def test_a_table_that_is_small_on_disk_only_is_not_broadcast(spark, sf):
    table(spark, sf, "part")  # as every query over the PDF reader begins
    # half a million rows in a few megabytes of files
    rows = settle(spark.range(500_000).select((F.col("id") % 1000).alias("number"), F.concat(F.lit("doc-"), "id", F.lit(".pdf")).alias("path"), F.lit("<</Type/Page>>").alias("body")), "bound")
    other = settle(spark.range(1000).select(F.col("id").alias("number")), "bound").withColumn("x", F.lit(1))
    plan = other.join(rows, "number", "left")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan
    # and a really small one still is
    plan = rows.join(other, "number", "left")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_bounds_keep_what_the_user_has_set(spark):
    before = [spark.conf.get(k) for k in KEYS]
    try:
        for k in KEYS:
            spark.conf.unset(k)
        bounded(spark)
        assert [spark.conf.get(k) for k in KEYS] == ["32.0", "4194304b"] or [spark.conf.get(k) for k in KEYS] == ["32.0", "4194304"]
        for k, v in zip(KEYS, ("2.0", "1048576"), strict=True):
            spark.conf.set(k, v)
        bounded(spark)
        assert [spark.conf.get(k).rstrip("b") for k in KEYS] == ["2.0", "1048576"]
    finally:
        for k, v in zip(KEYS, before, strict=True):
            spark.conf.set(k, v)


def test_small_rows_that_take_long_are_dealt_over_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spread(spark.range(cores * 30).coalesce(1)).withColumn("part", F.spark_partition_id())
    assert rows.select("part").distinct().count() >= cores
    assert rows.select("id").distinct().count() == cores * 30


def test_the_entry_names_every_operator():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"pdf_locked_text", "line_filling", "pipeline"} <= names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))


def test_tables_settled_on_the_way_are_deleted(spark):
    import os

    from quire.sources.scratch import settled_alone

    before, on_the_way = settle(spark.range(3), "kept"), []

    def made():
        on_the_way.append(settled_alone(lambda: before, "first"))
        on_the_way.clear()
        on_the_way.append(settle(before.select((F.col("id") + 1).alias("id")), "on-the-way"))
        on_the_way.append(settled_alone(lambda: settle(on_the_way[0].filter("id > 1"), "inner").select("id"), "inner-result"))
        return on_the_way[1].unionByName(before)

    out = settled_alone(made, "result")
    assert sorted(r.id for r in out.collect()) == [0, 1, 2, 2, 3] and before.count() == 3
    assert not any(os.path.exists(t.settled_at) for t in on_the_way)
    assert os.path.exists(out.settled_at) and os.path.exists(before.settled_at)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_files_that_fit_a_row_deal_their_objects_once(spark):
    from quire.sources import writer

    objects = settle(spark.range(9000).select(F.concat(F.lit("f"), F.col("id") % 2).alias("path"), (F.floor(F.col("id") / 2) + 1).alias("number"), F.concat(F.lit("<</A "), "id", F.lit(">>é")).cast("binary").alias("body")), "few-objects")
    made = writer.written(objects)
    assert exchanges(made) == 1
    for encrypt in (False, True):  # more objects than a bucket of parts() has
        want = {r.path: bytes(r.content) for r in writer.joined(writer.parts(objects, encrypt)).collect()}
        assert {r.path: bytes(r.content) for r in writer.written(objects, encrypt).collect()} == want


def test_tokens_are_dealt_once_for_their_text(spark):
    from quire.operators import text_extract
    from quire.sources import reader

    ops = [b"BT /F1 9 Tf 5 0 Td <00410042>Tj [(c) -250 (d) 50 (e) 300] TJ T* T* (f) ' -200 0 Td ET", b"", b"q Q", b"[ -300 ] (x)Tj 200 200 Td [(y) -101", b"(\\(z) Tj [120] TJ"]
    streams = settle(spark.createDataFrame([("p", i // 3, i % 3, o) for i, o in enumerate(ops)], "path string, page_index int, stream_index int, content binary"), "streams")
    found = text_extract.page_texts(reader.tokens(streams))
    assert exchanges(found) == 1
    assert {r.page_index: r.text for r in found.collect()} == {0: "\nABc de \nf\n".lstrip("\n"), 1: "x\ny \n(z \n"}

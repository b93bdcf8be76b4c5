from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.operators import chunking, entities, progress
from quillgraph.sources.store import KnowledgeBase
from quillgraph.streaming import ingest
from quillgraph.streaming import progress as live

TEXTS = {
    "one": "Alexander conquered Babylonia. Babylonia remembered Alexander.",
    "two": "Alexander admired Aristotle, and Aristotle taught Alexander.",
}


def _lines(docs):
    return chunking.split_by_separator(docs, "\n", max_tokens=1000)


def test_stream_equals_batch(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    docs = spark.createDataFrame([(f"{k}.txt", v) for k, v in TEXTS.items()], "doc_id string, text string").withColumn("lang", F.lit("en"))
    terms = entities.term_gazetteer(docs, min_df=1)
    run = lambda: ingest.stream_ingest(
        spark, str(inbox), kb, str(tmp_path / "ck"), terms, label="en", split=_lines).awaitTermination()
    for name, text in TEXTS.items():
        (inbox / f"{name}.txt").write_text(text, encoding="utf-8")
        (inbox / f"{name}.png").write_text("ignored", encoding="utf-8")
        run()
    run()
    expected = ingest.build_tables(docs, terms, split=_lines)
    for table, columns in (("chunks", ["doc_id", "bid", "text"]), ("edges", ["doc_id", "source", "target", "weight"])):
        key = lambda df: sorted(map(tuple, df.select(*columns).collect()))
        assert key(kb.load(table)) == key(expected[table]) and kb.load(table).count() > 0
    refused = {(r.doc_id, r.reject_reason) for r in kb.load("rejected_files").collect()}
    assert refused == {("one.png", "unsupported_type"), ("two.png", "unsupported_type")}


def test_stream_progress_equals_batch(spark, tmp_path):
    rows = [("j", i, s, c, 4, sec) for i, (s, c, sec) in enumerate([
        ("entity_extraction", 1, 2.0), ("entity_extraction", 1, 5.0), ("entity_extraction", 2, 1.5),
        ("relationship_extraction", 1, 1.0), ("entity_extraction", 4, 0.0), ("entity_extraction", 3, 2.5)])]
    events = spark.createDataFrame(rows, schemas.STAGE_EVENTS)
    for part in range(3):
        events.filter(F.floor(F.col("seq") / 2) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(schemas.STAGE_EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    updates = {}

    def keep(batch, _):
        updates.update({(r.job_id, r.stage): r.asDict() for r in batch.collect()})

    live.stream_stage_progress(stream).writeStream.outputMode("update").foreachBatch(keep).option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    wanted = {(r.job_id, r.stage): r.asDict() for r in progress.stage_progress(events).drop("first").collect()}
    assert {k: {c: v[c] for c in wanted[k]} for k, v in updates.items()} == wanted

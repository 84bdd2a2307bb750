from gleaner.jobs.screen import final_records
from gleaner.operators.progress import replay
from gleaner.streaming.incremental import progress_stream, screen_arrivals

DOCS = "doc_id bigint, text string"


def test_arrivals_equal_a_batch(spark, tmp_path):
    text = "By the river\n" + "nothing here at all, moment after moment, until the line is long enough\n" * 4
    a, b = (spark.createDataFrame([(i, text), (i + 1, "under\nwonder")], DOCS) for i in (1, 10))
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for df in (a, b):
        df.coalesce(1).write.mode("append").parquet(folder)
        screen_arrivals(spark, folder, DOCS, out, mark).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(out).drop("epoch").select("piece_id", "theme", "judgment").collect()}
    assert got == {tuple(r) for r in final_records(a.unionByName(b)).select("piece_id", "theme", "judgment").collect()} and got


def test_progress_stream_equals_replay(spark, tmp_path):
    schema = "project bigint, seq int, action string, target string, delta int"
    rows = [(k, i, a, "", 1) for k in (1, 2) for i, a in enumerate(["start", "checkpoint", "complete", "start", "pause", "jump"])]
    folder = str(tmp_path / "in")
    seen = {}
    for part in (rows[:3] + rows[6:9], rows[3:6] + rows[9:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = progress_stream(spark.readStream.schema(schema).parquet(folder), ("a", "b"))
        q = stream.writeStream.outputMode("update").foreachBatch(lambda b, e: seen.update({r.project: tuple(r) for r in b.collect()})).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert set(seen.values()) == {tuple(r) for r in replay(spark.createDataFrame(rows, schema), ("a", "b")).collect()}

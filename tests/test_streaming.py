"""A stream that reads everything there is gives what the batch query gives."""

from pyspark.sql import functions as F

from palisade.operators import monitor as batch
from palisade.streaming import monitor as stream

FOLDER = "/root/testdata/sf0.001"


def shaped(rows):
    k = F.get_json_object("props", "$.k").cast("int")
    host = F.element_at(F.array(F.lit("registry.npmjs.org"), F.lit("evil.example.com"), F.lit("169.254.169.254")), (k % 3 + 1).cast("int"))
    return rows.select("user_id", F.col("ts").cast("timestamp").alias("ts"), host.alias("remote_host"), F.lit(None).cast("string").alias("resolved_host"), F.lit("npm").alias("process_name"), (F.col("event_type") == "error").alias("is_canary"), k.alias("remote_port"), F.col("user_id").cast("int").alias("pid"))


def test_kill_chain_equals_batch(spark, tmp_path):
    table = spark.read.parquet(f"{FOLDER}/events.parquet")
    table.write.parquet(str(tmp_path / "in"))
    live = stream.classified(shaped(stream.events(spark, str(tmp_path / "in"), table.schema)))
    q = stream.kill_chain(live).writeStream.format("memory").queryName("kc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("kc").collect()}
    rows = stream.classified(shaped(table)).withColumn("day", F.to_date("ts"))
    want = batch.kill_chain(rows.where("is_canary"), rows.where("not is_canary"), ["user_id", "day"]).select("user_id", "day", "canary", "unexpected", "critical", "verdict")
    assert got == {tuple(r) for r in want.collect()} and got


def test_connections_once(spark, tmp_path):
    table = spark.read.parquet(f"{FOLDER}/events.parquet")
    table.write.parquet(str(tmp_path / "in"))
    live = stream.seen_once(shaped(stream.events(spark, str(tmp_path / "in"), table.schema)), "40 days")
    q = live.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == shaped(table).select("remote_host", "remote_port", "pid").distinct().count()


def test_sessions_files_and_trees(spark, tmp_path):
    table = spark.read.parquet(f"{FOLDER}/events.parquet")
    table.write.parquet(str(tmp_path / "in"))
    live = lambda: stream.events(spark, str(tmp_path / "in"), table.schema)
    run = lambda rows, name: rows.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    run(stream.files_once(live().select("ts", F.col("user_id").alias("pid"), F.col("event_type").alias("path")), "40 days"), "files")
    assert spark.table("files").count() == table.select("user_id", "event_type").distinct().count()
    run(stream.sessions(live(), "user_id", "6 hours", "1 hour"), "sessions")
    whole = {tuple(r) for r in stream.sessions(table, "user_id", "6 hours").collect()}
    some = {tuple(r) for r in spark.table("sessions").collect()}  # the last ones stay open
    assert some and some <= whole
    seen = []
    processes = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (8, 9), (9, 8)], "pid long, parent long")
    stream.within_tree(lambda: processes, 1, lambda b, _: seen.extend(r.user_id for r in b.collect()))(table.withColumn("pid", F.col("user_id")), 0)
    assert seen and set(seen) <= {1, 2, 3}
    assert {tuple(r) for r in batch.process_tree(processes, 1).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert batch.process_tree(processes, 77).isEmpty()

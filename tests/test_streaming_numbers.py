"""Numbers of requirements go on over batches and restarts."""

from specloom.operators import requirements, text_parse
from specloom.streaming import ingest

PIECES = {
    (7, 1): "1.  Introduction\n\nThe client MUST send a frame. It MAY wait.\n", (7, 2): "2.  Overview\n\nA server SHOULD reply.\n\nNothing.\n",
    (7, 3): "3.  Security Considerations\n\nIt MUST NOT fail, and it MAY stop.\n", (9, 1): "1.  Introduction\n\nIt is OPTIONAL.\n", (9, 2): None,
}


def test_stream_of_pieces_equals_batch(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    ingest.use_rocksdb(spark)
    schema = "doc_id int, piece int, body string"

    def arrive(*keys):
        rows = [(*k, PIECES[k]) if k in PIECES else (None, 1, "1.  Introduction\n\nIt MUST.\n") for k in keys]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        found = ingest.numbered_requirements(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"))
        q = found.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start(f"file://{tmp_path}/out")
        q.awaitTermination()

    try:  # each arrival is a restart
        arrive((7, 2), (7, 1), (None, 1))
        arrive((9, 2))
        arrive((9, 1), (7, 3))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.parquet(f"file://{tmp_path}/out")
    whole = {d: "\n".join(b for (i, _), b in sorted(PIECES.items(), key=lambda x: x[0]) if i == d and b) for d in (7, 9)}
    want = requirements.extract_requirements(text_parse.parse_text(spark.createDataFrame(list(whole.items()), "doc_id int, body string")))
    assert want.count() == 6 and sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))

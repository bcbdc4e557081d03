import pyarrow as pa

from codecairn.llm import bpe, tables, words


def test_tasks_get_small_arrow_batches(spark):
    """No batch of long texts is much above a few MB, whatever the partition has; a session that says otherwise keeps its setting."""
    spark.conf.unset(tables.BATCH_SETTING)
    docs = spark.range(3000, numPartitions=1).selectExpr("id", "repeat('abcdefghij', 1000) as text")

    def task(rows):
        for b in rows:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).buffers()[2].size], pa.int64()), pa.array([b.num_rows], pa.int64())], ["size", "n"])

    def seen():
        return tables.map_rows(docs, ["text"], tables.T.StructType(tables.typed("size bigint, n bigint")), task).collect()

    got = seen()
    assert sum(r["n"] for r in got) == 3000 and max(r["size"] for r in got) <= 8 << 20
    spark.conf.set(tables.BATCH_SETTING, "64m")
    try:
        assert max(r["size"] for r in seen()) > 16 << 20 and spark.conf.get(tables.BATCH_SETTING) == "64m"
    finally:
        spark.conf.unset(tables.BATCH_SETTING)


def test_memo_of_pieces_stays_small():
    """A worker keeps what it remembers while other steps run in it."""
    b = bpe._loaded(open(bpe.vocabulary_path(), encoding="utf-8").read())
    b.known, b.older, b.merge = {}, {}, lambda piece: (1,)
    try:
        for i in range(450_000):
            b._ids_of(str(i))
        assert 0 < len(b.known) + len(b.older) <= 200_000
    finally:
        b.known, b.older = {}, {}
        del b.merge


def test_blocks_of_texts_are_small_and_whole():
    texts = [b"word " * 2000] * 100 + [b"x" * (1 << 20), b""]
    found = list(words.blocks(texts))
    assert [i for a, b in found for i in range(a, b)] == list(range(len(texts)))
    assert all(b - a == 1 or sum(map(len, texts[a:b])) <= 1 << 18 for a, b in found)

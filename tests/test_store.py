"""The chunk store: versions, drafts, failures, repeated batches, writers that die or meet; and pairs of tables."""

import pytest
from pyspark.sql import functions as F

from lodestone.constants import MAX_CHUNKS
from lodestone.operators import lifecycle
from lodestone.streaming import ingest, store

DOCS = "document_id long, version long, file_type string, text string, page_number int"
EMBED = ingest.trigram_embedding(8)


def picky_model():
    embed = ingest.trigram_embedding(8)

    def picky(texts):
        if any("poison" in t for t in texts):
            raise RuntimeError("no answer")
        if any("short" in t for t in texts):
            return embed(texts)[1:]
        return [v[:4] if "narrow" in t else v for v, t in zip(embed(texts), texts, strict=True)]

    return picky


def docs(spark, *rows):
    return spark.createDataFrame([(i, v, "txt", t, None) for i, v, t in rows], DOCS)


def seen(own):
    return sorted({(r.document_id, r.document_version, r.content) for r in own.visible().collect()})


def states(own):
    return {(r.document_id, r.document_version): (r.status, r.reason) for r in own.documents().collect()}


def test_versions_failures_and_repeated_batches(spark, tmp_path):
    own, picky = store.ChunkStore(spark, f"file://{tmp_path}/store"), picky_model()
    assert own.visible().count() == own.documents().count() == 0
    first = docs(spark, (1, 1, "old one"), (1, 2, "new one"), (2, 1, "poison"), (3, 1, ""), (4, 1, "fine"), (5, 1, "short"), (6, 1, "x\n\n" + "y" * 600 + " narrow"), (None, 1, "no id"), (7, None, "no version"))
    own.ingest(first, picky, "b1")
    want = [(1, 2, "new one"), (4, 1, "fine")]
    assert seen(own) == want
    got = states(own)
    assert got[1, 1] == ("superseded", None) and got[1, 2] == got[4, 1] == ("ready", None) and got[2, 1] == ("failed", "model: no answer") and got[3, 1] == ("failed", "no chunk")
    assert got[5, 1] == ("failed", "count of vectors") and got[6, 1] == ("failed", "width of vectors") and len(got) == 7
    number = own.current()[0]
    own.ingest(first, picky, "b1")
    assert own.current()[0] == number and seen(own) == want
    own.ingest(docs(spark, (4, 1, "fine"), (1, 1, "old one")), EMBED, "b2")  # ready before, and late
    assert seen(own) == want and states(own) == got
    own.ingest(docs(spark, (2, 1, "poison"), (4, 2, "poison")), picky, "b3")  # a failing new version leaves the old one visible
    assert seen(own) == want and states(own)[4, 2] == ("failed", "model: no answer")
    own.ingest(docs(spark, (2, 1, "poison"), (4, 2, "finer")), EMBED, "b4")  # failed ones are tried again
    assert seen(own) == [(1, 2, "new one"), (2, 1, "poison"), (4, 2, "finer")]
    own.compact()
    assert seen(own) == [(1, 2, "new one"), (2, 1, "poison"), (4, 2, "finer")] and states(own)[2, 1] == ("ready", None)
    own.ingest(docs(spark, (8, 1, "again")), EMBED, "b4")
    assert (8, 1) not in states(own) and len(own.read("chunks").collect()) == 3


def test_too_many_chunks_and_pages(spark, tmp_path):
    own = store.ChunkStore(spark, f"file://{tmp_path}/store")
    rows = [(1, 1, "txt", "a" * 300 + "\n\n" + "b" * 300, p) for p in range(1, 4)] + [(2, 1, "txt", "w" * 500, p) for p in range(MAX_CHUNKS + 1)]
    own.ingest(spark.createDataFrame(rows, DOCS), EMBED, "b")
    assert [tuple(r) for r in own.visible().groupBy("document_id").agg(F.count("*"), F.max("chunk_index"), F.count_distinct("page_number")).collect()] == [(1, 6, 5, 3)]
    assert states(own)[2, 1] == ("failed", "too many chunks")


def test_drafts_are_published_by_whoever_comes_next(spark, tmp_path):
    own = store.ChunkStore(spark, f"file://{tmp_path}/store")
    own.ingest(docs(spark, (1, 1, "one")), EMBED, "b1")
    own.draft(docs(spark, (1, 2, "two")), EMBED, "b2")  # the writer dies here
    assert seen(own) == [(1, 1, "one")] and states(own)[1, 2] == ("publishing", None)
    calls = []
    other = store.ChunkStore(spark, f"file://{tmp_path}/store")
    other.draft(docs(spark, (1, 2, "two")), lambda t: calls.append(t), "b2")
    assert other.publish() and not other.publish() and not calls
    assert seen(own) == [(1, 2, "two")] and states(own)[1, 2] == ("ready", None)


def test_two_writers(spark, tmp_path):
    a, b = (store.ChunkStore(spark, f"file://{tmp_path}/store") for _ in range(2))
    number, batches = a.current()
    b.ingest(docs(spark, (1, 1, "one")), EMBED, "b")
    with pytest.raises(store.Conflict):
        a.swap(number, batches)
    a.ingest(docs(spark, (2, 1, "two")), EMBED, "a")
    assert seen(b) == [(1, 1, "one"), (2, 1, "two")]


def test_stream_ingest(spark, tmp_path):
    docs(spark, (1, 1, "First paragraph.\n\nSecond."), (1, 2, "changed"), (2, 1, "body")).write.parquet(str(tmp_path / "in"))
    own = store.ChunkStore(spark, f"file://{tmp_path}/store")
    run = lambda: store.start(spark, str(tmp_path / "in"), own, str(tmp_path / "ck"), EMBED).awaitTermination()
    run()
    run()
    assert seen(own) == [(1, 2, "changed"), (2, 1, "body")]
    docs(spark, (2, 1, "body"), (1, 3, "third")).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert seen(own) == [(1, 3, "third"), (2, 1, "body")]


def test_messages_and_citations_together(spark, tmp_path):
    log = store.TableSet(spark, f"file://{tmp_path}/log", {"messages": "id long, content string", "citations": "message_id long, ref string, quote string, score decimal(5,4)"})
    messages = spark.createDataFrame([(1, "a"), (2, "b")], "id long, content string")
    citations = spark.createDataFrame([(1, "S1", "q", 0.5), (2, "S1", None, 0.5), (2, "S2", "q", 0.5)], "message_id long, ref string, quote string, score double")
    ok, rows = lifecycle.with_citations(messages, citations)
    broken = rows.withColumn("score", F.raise_error(F.lit("the second table fails")).cast("decimal(5,4)"))
    with pytest.raises(Exception, match="second table"):
        log.append("turn-1", {"messages": ok, "citations": broken})
    assert log.read("messages").count() == log.read("citations").count() == 0
    assert log.append("turn-1", {"messages": ok, "citations": rows}) and not log.append("turn-1", {"messages": ok, "citations": rows})
    assert [tuple(r) for r in log.read("messages", named=True).collect()] == [(1, "a", "turn-1")] and log.read("citations").count() == 1


def test_embedding_hashes_every_three_bytes():
    import zlib

    for text in ("", "a", "é", "Abc", "日本 text " * 9):
        data, plain = text.lower().encode(), [0.0] * 8
        for j in range(max(1, len(data) - 2)):
            h = zlib.crc32(data[j : j + 3])
            plain[h % 8] += 1 if h & 0x10000 else -1
        norm = sum(x * x for x in plain) ** 0.5
        assert all(abs(a - (b / norm if norm else 0)) < 1e-12 for a, b in zip(EMBED([text])[0], plain, strict=True))

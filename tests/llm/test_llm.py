"""The training-data operators against brute force, exact round trips and held-out accuracy; and their edge cases."""

import glob
import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import decontaminate, langid, linefreq, neardup, packing, queries, secrets, tokenbin, tokens, triecount, urltree, wacz
from lodestone.llm.common import shared_dir, words_of

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, bucket string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with clashing names."""
    body = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix potions in the old stone tower near the river. "
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, body), (4, body), (None, body), (5, body * 900), (6, "<|endoftext|> a  b c"), (7, "é\n\nß 日本語 😀"), (8, "!!! ###"), (9, body + "extra")]
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, None if k % 3 else "s", 0, "k", 1, "b") for k, (i, t) in enumerate(texts)], DOCS)


def ids_of(text):
    return tokens.encoder(tokens.default_tokenizer()).whole(text or "")


def rows(found):
    return sorted(tuple(repr(x) for x in r) for r in found)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall()
    assert want and rows(df.select(*columns).collect()) == rows(want)


def test_unit_encoder_equals_the_library(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_UNITS", 50)
    e = tokens.UnitEncoder(tokens.default_tokenizer())
    r = random.Random(4)
    alphabet = ["a", "Bc", "é", "ж", "日", "😀", " ", "  ", "\n", "\n\n", "\r\n", "\t", "\x1c", "\u3000", ".", ",", "!?", "'s", "1", "\xa0", "<|endoftext|>", "word", "_"]
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(500)] + [None, "", "x" * 5000, "a b\n" * 9000]
    texts += [" ".join("".join(r.choices(["a", "Bc", "é", "ж", ".", ",", "\n", "'s", "1", "_"], k=r.randint(1, 5))) for _ in range(r.randint(1, 9))) for _ in range(500)]
    assert e.encode(texts) == [e.whole(t or "") for t in texts]
    monkeypatch.setattr(tokens, "SLICE_BYTES", 100)
    assert e.encode(texts) == [e.whole(t or "") for t in texts] and e.encode([]) == [] and e.encode([None]) == [b""]


def check_packing(found, docs):
    want = sorted((i if i is not None else -1, ids_of(t) + b"\0\0\0\0") for i, t in docs)
    by_doc, by_seq = {}, {}
    for p in found:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0) and len(pieces) <= 128
    assert sum(p.length for p in found) == sum(len(b) // 4 for _, b in want)
    for i, packed in want:
        if sum(1 for j, _ in want if j == i) == 1:
            at = 0
            for p in sorted(by_doc[None if i == -1 else i], key=lambda p: p.start):
                assert (p.start, p.doc_tokens) == (at, len(packed) // 4) and p.ids_crc32 == zlib.crc32(packed[4 * at : 4 * (at + p.length)])
                at += p.length
            assert at == len(packed) // 4


def test_packing(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for df in (docs, odd, odd.limit(0)):
        check_packing(packing.pack_documents(df, tokens.default_tokenizer()).collect(), [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_example_packing(spark):
    r = random.Random(1)
    own = [(i, n := r.randint(1, 900), r.randint(0, n)) for i in range(500)] + [(1000, 99_999, 0), (1001, None, None), (7, 10, None), (None, 5, 5)]
    limits = packing.Limits(1024, 4, 600)
    df = spark.createDataFrame(own, "example_id long, n_tokens long, n_loss long")
    out = packing.pack_examples(df, limits).collect()
    want = sorted((-1 if i is None else i, n or 0, min(n or 0, n or 0 if k is None else k)) for i, n, k in own)
    assert sorted((-1 if x.example_id is None else x.example_id, x.n_tokens, x.n_loss) for x in out) == want
    seqs = {}
    for x in out:
        if x.sequence_id is not None:
            seqs.setdefault(x.sequence_id, []).append(x)
    assert {x.example_id for x in out if x.sequence_id is None} == {1000, 1001} | {i for i, _, k in want if k > 600}
    for s in seqs.values():
        assert len(s) <= 4 and sum(x.n_tokens for x in s) <= 1024 and sum(x.n_loss for x in s) <= 600
        at = 0
        for x in sorted(s, key=lambda x: x.offset):
            assert x.offset == at
            at += x.n_tokens
    assert packing.pack_examples(df.limit(0), limits).count() == 0


def test_conversation_packing(spark):
    d = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{d}/conversations.parquet").collect():
        n = len(ids_of(r.text)) // 4 + 1
        total, loss = want.get(r.conv_id, (0, 0))
        want[r.conv_id] = total + n, loss + (n if r.role == "assistant" else 0)
    out = packing.conversation_packing(spark, d).collect()
    assert {r.example_id: (r.n_tokens, r.n_loss) for r in out} == want and len(out) == len(want)
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append(r)
    assert all(n > 4096 or k > 3200 for n, k in (want[r.example_id] for r in seqs.pop(None, [])))
    full = [(sum(r.n_tokens for r in s), len(s), sum(r.n_loss for r in s)) for s in seqs.values()]
    assert all(a <= 4096 and b <= 4 and c <= 3200 for a, b, c in full)
    odd = spark.createDataFrame([(1, "user", "a b", 1), (1, "assistant", None, 1), (None, None, "c", 1)], "conv_id long, role string, text string, n long")
    got = sorted(map(tuple, packing.conversation_examples(odd, tokens.default_tokenizer()).collect()), key=str)
    assert got == [(1, 4, 1), (None, 2, 0)]
    assert packing.conversation_examples(odd.limit(0), tokens.default_tokenizer()).count() == 0


def test_packages(spark, tmp_path):
    page = [(3, "http://a\n/x", "p" * 200), (1, None, "p" * 200), (2, "u", None), (5, "u", ""), (6, "u", "é" * 49), (7, "u", "é" * 49), (9, "u", "é" * 50), (8, "u", "é" * 50), (9, "u", "é" * 50)]
    df = spark.createDataFrame([(*p, "d") for p in page], "page_id long, url string, html string, digest string")
    manifest = wacz.write_packages(df, shared_dir(spark, "t"))
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in wacz.read_packages(manifest).collect())
    assert got == [(1, 200, "response", None), (2, 0, "response", None), (3, 200, "revisit", 1), (5, 0, "response", None), (6, 98, "response", None), (7, 98, "response", None), (8, 100, "response", None), (9, 100, "revisit", 8), (9, 100, "revisit", 8)]
    uri = manifest.where("records > 0").first().path
    entry, _ = next(wacz.read_package(uri))
    assert wacz.read_one(uri, entry["offset"], entry["length"])[0]["warc-payload-digest"] == entry["digest"]
    assert wacz.read_packages(wacz.write_packages(df.limit(0), shared_dir(spark, "t"))).count() == 0


def test_zip64(tmp_path):
    """A hand-made end record with ZIP64 locator, and a compressed member that is refused."""
    import struct
    import zipfile

    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("stored", b"0123456789")
        z.writestr("packed", b"x" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"end"
    data = path.read_bytes()
    end = data.rfind(b"PK\x05\x06")
    count, size, at = struct.unpack_from("<HII", data, end + 10)
    record = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, size, at)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, end, 1)
    big = tmp_path / "b.zip"
    big.write_bytes(data[:end] + record + locator + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 3) + b"end")
    for p in (path, big):
        reader = wacz.ZipReader(f"file://{p}")
        assert reader.read("stored", 2, 3) == b"234" and set(reader.members) == {"stored", "packed"}
        with pytest.raises(ValueError, match="compressed"):
            reader.read("packed")


def test_decontamination_edges(spark, odd):
    bench = spark.createDataFrame([(1, "Quick BROWN fox"), (10, "lazy dog"), (2, None), (3, "..."), (None, "dog"), (1, "old stone")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.scan(odd, bench).collect()}
    assert (got[1].n_words, got[1].contaminated) == (0, False) and got[2].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert (got[4].n_words, got[4].n_hit, got[4].n_items, got[4].contaminated) == (23, 7, 2, True)
    assert got[4].items_sha256 == hashlib.sha256(b"1,10").hexdigest()
    assert decontaminate.scan(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.remove_contaminated(odd, bench).columns == odd.columns
    paths = decontaminate.write_items(bench, shared_dir(spark, "t"), block_bytes=10)
    assert len(paths) > 1
    docs, bench = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.scan(docs, bench).collect()))
    assert sorted(map(tuple, decontaminate.scan(docs, bench, block_bytes=2000).collect())) == whole


def test_alignment():
    r = random.Random(3)

    def brute(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    for _ in range(500):
        a = [r.randint(1, 6) for _ in range(r.randint(0, 40))]
        b = [x if r.random() < 0.8 else r.randint(1, 6) for x in a if r.random() < 0.9]
        most, d = r.randint(0, 20), brute(a, b)
        assert neardup.edit_distance(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), most) == (d if d <= most else None)
    for _ in range(2000):
        words = r.choice([3, 10, 200])
        a = [r.randint(1, words) for _ in range(r.randint(0, 40))]
        b = [x if r.random() < 0.9 else r.randint(1, words) for x in a if r.random() < 0.95]
        if r.random() < 0.2:
            b = b[len(b) // 2 :] + b[: len(b) // 2]
        near = bool(a and b) and brute(a, b) <= max(len(a), len(b)) // 5
        assert neardup.similar(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)) == near


def linked_pairs(texts, numbers=None):
    """Pairs of ids whose word edit similarity is 0.8 or more: all pairs, but for those whose counts of words already differ too much."""
    numbers = {} if numbers is None else numbers
    words = {i: [numbers.setdefault(w, len(numbers)) for w in words_of(t)] for i, t in texts.items()}
    counts = np.zeros((len(words), 256), dtype=np.int32)
    ids = sorted(words)
    for k, i in enumerate(ids):
        np.add.at(counts[k], np.array(words[i], dtype=np.int64) % 256, 1)
    lengths = np.array([len(words[i]) for i in ids])
    out = []
    for k, i in enumerate(ids):
        longest = np.maximum(lengths[k], lengths[k + 1 :])
        near = np.abs(counts[k + 1 :] - counts[k]).sum(axis=1) <= 2 * (longest // 5)
        for m in np.flatnonzero(near & (lengths[k + 1 :] > 0)) + k + 1:
            a, b = (np.array(words[x], dtype=np.uint64) for x in (i, ids[m]))
            if len(a) and neardup.edit_distance(a, b, max(len(a), len(b)) // 5) is not None:
                out.append((i, ids[m]))
    return out


def joined(ids, pairs):
    """The least id that each id is connected with."""
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    return {i: root(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    pairs = linked_pairs(texts)
    classes, links = neardup.linked(docs)
    got = {r.doc_id: r for r in classes.collect()}
    assert {i: r.class_id for i, r in got.items()} == joined(texts, pairs)
    links = [tuple(r) for r in links.collect()]
    assert links and set(links) <= set(pairs) and len(links) == len(set(links))
    assert sum(r.class_links for r in got.values() if r.doc_id == r.class_id) == len(links)
    found = sorted(((r.doc_id, r.class_id) for r in neardup.classes(odd).collect()), key=lambda r: r[0] or 0)
    assert found == [(None, None), (1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8), (9, 4)]
    assert neardup.classes(odd.limit(0)).count() == 0 and neardup.keep_first(odd).columns == odd.columns


def test_keep_first_edges(spark):
    twice = spark.createDataFrame([(1, "z0 " * 9, "s"), (1, "a0 " * 9, "s"), (1, "a0 " * 9, "s"), (2, "z0 " * 9, "s"), (3, "b", "s"), (None, "b", "s"), (4, None, "s"), (4, "", "t")], "doc_id long, text string, source string")
    assert sorted((r.doc_id or 0, (r.text or "")[:2]) for r in neardup.keep_first(twice).collect() if r.doc_id != 2) == [(0, "b"), (1, "a0"), (3, "b"), (4, "")]
    clash = ["source", "__id", "__nth", "id", "d", "key", "class_id", "bucket", "lead", "__contaminated", "contaminated"]
    docs = spark.createDataFrame([(i, "one two three four five six seven " * 3, *[f"{c}{i}" for c in clash]) for i in (1, 2)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in clash))
    assert [tuple(r) for r in neardup.keep_first(docs).collect()] == [tuple(docs.where("doc_id = 1").first())]
    bench = spark.createDataFrame([(1, "nothing here")], "item_id long, text string")
    for kept in (decontaminate.remove_contaminated(docs, bench), linefreq.clean(docs, most_docs=9), secrets.redact(docs)):
        assert kept.columns == docs.columns
    assert decontaminate.remove_contaminated(docs, bench).count() == 2


def test_one_changed_word_in_a_short_text(spark):
    words = [f"w{i}" for i in range(46)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[:20], "other", *words[21:]])), (3, " ".join(words[:30]))]
    got = {r.doc_id: (r.class_id, r.class_size, r.class_links) for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (1, 2, 1), 2: (1, 2, 1), 3: (3, 1, 0)}


def test_large_buckets_equal_brute_force(spark, monkeypatch):
    """A group of near copies that are often below the similarity to each other, beside texts that share a passage only; pairs of large buckets are compared or ruled out."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    texts = {}
    for i in range(300):
        words = list(base)
        for _ in range(rng.randrange(60)):
            words[rng.randrange(150)] = f"x{rng.randrange(9)}" if i % 2 else f"y{rng.randrange(10**6)}"
        if i % 3 == 0:
            words = words[:70] + [f"z{rng.randrange(3000)}" for _ in range(80)]
        texts[i] = " ".join(words)
    near = linked_pairs(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got, want = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}, joined(texts, near)
    buckets = {i: set(neardup.order_minhash(neardup.shingles(neardup.word_hashes(words_of(t))))) for i, t in texts.items()}
    met = joined(texts, [(a, b) for a, b in near if buckets[a] & buckets[b]])
    assert got == met and sum(got[i] == want[i] for i in texts) >= 0.9 * len(texts)
    monkeypatch.setattr(neardup, "PART", 20)  # many parts
    monkeypatch.setattr(neardup, "ROUNDS", 1)
    assert {r.doc_id: r.class_id for r in neardup.classes(docs).collect()} == met


def test_links_of_texts_that_repeat_a_passage(spark):
    """A word of a passage that comes 200 times is changed throughout: most labelled shingles differ, the shingle sets hardly."""
    docs = []
    for i in range(40):
        body, passage = " ".join(f"w{i}x{j}" for j in range(1000)), [f"p{i}x{j}" for j in range(10)]
        docs += [(2 * i, body + " " + " ".join(passage * 200)), (2 * i + 1, body + " " + " ".join((passage[:4] + [f"q{i}"] + passage[5:]) * 200))]
    hashes = [neardup.word_hashes(words_of(t)) for _, t in docs]
    assert all(neardup.similar(hashes[2 * i], hashes[2 * i + 1]) for i in range(40))
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(80)}


def test_recall_of_links_against_alignment(spark):
    """At sf0.01 over all pairs of texts with different words: those that align, and those that the operator puts in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    firsts = {}
    for r in docs.select("doc_id", "text").orderBy("doc_id").collect():
        firsts.setdefault(b" ".join(words_of(r.text)), r)
    links = linked_pairs({r.doc_id: r.text for w, r in firsts.items() if w})
    of = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    met = sum(of[a] == of[b] for a, b in links)
    assert len(links) >= 60 and met >= 0.97 * len(links), (met, len(links))


def test_token_files(spark, odd):
    for df in (spark.read.parquet(f"{DATA}/documents.parquet"), odd):
        out = shared_dir(spark, "t")
        manifest = tokenbin.write_token_files(df, out, tokens.default_tokenizer(), 2)
        got = sorted(map(tuple, tokenbin.read_token_files(manifest, out).collect()), key=lambda r: r[1])
        want, at = [], 0
        for i, t in sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
            packed = ids_of(t) + (2).to_bytes(4, "little")
            want.append((i, at, len(packed) // 4, zlib.crc32(packed)))
            at += len(packed) // 4
        assert got == want
    out = shared_dir(spark, "t")
    assert tokenbin.read_token_files(tokenbin.write_token_files(odd.limit(0), out, tokens.default_tokenizer(), 2), out).count() == 0


def test_dictionary_from_whole_texts_and_small_inputs(spark):
    head, tail = "the same head again and again. " * 70, "quietly mixing potions in old stone towers, "
    docs = spark.createDataFrame([(i, head + f"{i} " + tail * 100) for i in range(60)], "doc_id long, text string")
    name = tokens.default_tokenizer()
    assert ids_of(tail * 2)[16:40] in tokenbin.train_dictionary(docs, name)
    small = spark.createDataFrame([(i, f"{tail}number {i}") for i in range(40)], "doc_id long, text string")
    assert 0 < len(tokenbin.train_dictionary(small, name)) < 16 * 1024
    assert tokenbin.train_dictionary(small.limit(0), name) == b"" and all(tokenbin.train_dictionary(small.limit(k), name) for k in (1, 2, 5))


def test_secret_linking(spark, odd):
    texts = ["user: alice then x 0123456789abcdef01 end", "x 0123456789abcdef01 end", "user: alice" + " " * 300 + "0123456789abcdef01", "token=token:abcdefgh Password = 'hunter22'", "AKIA" + "A" * 16 + " http://h/x 0123456789abcdef01"]
    got = [r.spans for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["ident:0:11,weakhex:19:37", "", "", "assign:21:41", "access:0:20,endpoint:21:31,weakhex:32:50"]
    assert secrets.find_secrets(odd).count() == odd.count() and secrets.find_secrets(odd.limit(0)).count() == 0
    clean = secrets.redact(spark.createDataFrame([(0, "é Password = 'hunter22' z", 25), (1, None, 0)], "doc_id long, text string, n_chars long")).orderBy("doc_id").collect()
    assert (clean[0].text, clean[0].n_chars, clean[1].text) == ("é [SECRET]' z", 13, None)
    many = " ".join(f"token=abcdef{i}\npassword: secret={i}{i}{i}{i}{i}{i} plain" for i in range(300))
    spans = [tuple(map(int, x.split(":")[1:])) for x in secrets.find_secrets(spark.createDataFrame([(1, many)], "doc_id long, text string")).first().spans.split(",")]
    want, at = "", 0
    for start, end in sorted(spans):
        want, at = (want + many[at:start] + "[SECRET]" if start >= at else want), max(at, end)
    frame = spark.createDataFrame([(1, many, "x", 1, 2), (2, many, "y", 1, 2), (None, "", "z", 1, 2), (3, "no", None, 1, 2)], "doc_id long, text string, `so.urce` string, kept int, a int")
    got = secrets.redact(frame)
    assert got.columns == frame.columns and sorted(r.text for r in got.collect()) == sorted([want + many[at:], want + many[at:], "", "no"])
    assert secrets.redact(frame.limit(0)).count() == 0


def test_trie_counts(spark, odd):
    from tokenizers import models

    pieces = triecount.load_pieces(triecount.default_vocabulary())
    trie = triecount.Trie(pieces, 2000)
    names = [("<unk>", min(pieces.values()) - 10), *pieces.items()]
    exact = models.Unigram(names, unk_id=0, byte_fallback=False)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20).collect()
    for w in {w for r in docs for w in (r.text or "").split()}:
        if all(c in pieces for c in w):
            assert trie.count([w]) == len(exact.tokenize(triecount.MARK + w)), w
    got = {r.doc_id: r for r in triecount.count_tokens(odd, triecount.default_vocabulary()).collect()}
    assert got[1].n_tokens == got[2].n_tokens == got[3].n_pretokens == 0 and got[5].n_pretokens == 900 * 23


def test_token_counts_equal_brute_force(spark):
    """Whole documents, unknown characters included, by forward scores of each word alone; and words longer than a trie may be."""
    pieces = triecount.load_pieces(triecount.default_vocabulary())
    longest, below = max(map(len, pieces)), min(pieces.values()) - 10

    def brute(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            ways = [(best[a][0] + pieces[word[a:end]], -best[a][1] - 1) for a in range(max(0, end - longest), end) if word[a:end] in pieces]
            if word[end - 1] not in pieces:
                width = len(word[end - 1].encode())
                ways.append((best[-1][0] + width * below, -best[-1][1] - width))
            score, n = max(ways)
            best.append((score, -n))
        return best[-1][1]

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    known = {}
    want = {r.doc_id: sum(known[w] if w in known else known.setdefault(w, brute("▁" + w)) for w in (r.text or "").split()) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in triecount.op7_token_counts(spark, DATA).collect()} == want
    trie, rng = triecount.Trie(pieces, 500), random.Random(5)
    assert all(trie.count([w]) == known[w] for w in sorted(known, key=lambda w: rng.random())) and len(trie.score) <= 500
    word = "".join(rng.choices(["ab", "the", "é", "😀", "日", "-", "x"], k=8000))
    assert trie.forward("▁" + word, 700) == triecount.Trie(pieces).count([word]) == brute("▁" + word)
    odd = spark.createDataFrame([(1, word * 3, 7), (1, word * 3, 7), (None, "a", 7), (2, "", 7)], "doc_id long, text string, n_tokens long")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in triecount.count_tokens(odd, triecount.default_vocabulary()).collect()) == sorted([(0, brute("▁a")), (1, n := brute("▁" + word * 3)), (1, n), (2, 0)])
    assert triecount.count_tokens(odd.limit(0), triecount.default_vocabulary()).count() == 0


def test_language(spark, odd):
    d = "/root/testdata/sf0.01"
    out = langid.op8_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out and lang is not null and lang_pred <> 'und'")
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count() > 0
    assert out.where("score < 0 or score > 1").count() == 0
    model = langid.fit(odd.limit(0))
    got = langid.identify(odd.withColumn("held_out", F.lit(False)), model).collect()
    assert {r.lang_pred for r in got} == {"und"} and len(got) == odd.count()
    own = {r.doc_id: r.lang_pred for r in langid.identify(odd.withColumn("held_out", F.lit(False)), langid.fit(odd)).collect()}
    assert own[1] == own[2] == own[8] == "und" and own[4] == own[7] == "en"


def test_language_equals_brute_force(spark):
    """The same features, weights, sample and centroids in plain dictionaries, for every document."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("h")).collect()

    def features(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split() if text and any(c.isalpha() for c in text) else []
        line, out = f" {' '.join(words)} ", {}
        for width in (1, 2, 3):
            for i in range(1 if width == 1 else 0, len(line) - (1 if width == 1 else width - 1)):
                a = [ord(c) for c in line[i : i + width]]
                value = a[0] * 2654435761 % 2**32
                for code, (x, y) in zip(a[1:], ((2246822519, 3266489917), (668265263, 374761393)), strict=False):
                    value = (value ^ code * x % 2**32) * y % 2**32
                out[value >> 18] = out.get(value >> 18, 0) + 1
        return out if words else {}

    def held(doc_id):
        return zlib.crc32(str(doc_id).encode()) % 3 == 1

    own = {r.doc_id: features(r.text) for r in docs}
    training = [r for r in docs if not held(r.doc_id) and r.lang is not None and r.text is not None]
    seen, n = {}, sum(bool(own[r.doc_id]) for r in training)
    for r in training:
        for b in own[r.doc_id]:
            seen[b] = seen.get(b, 0) + 1

    def vector(found):
        v = {b: (1 + np.log(c)) * (np.log((1 + n) / (1 + seen.get(b, 0))) + 0.1) for b, c in found.items()}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {b: x / norm for b, x in v.items()}

    centroids = []
    for lang in sorted({r.lang for r in training}):
        sample = sorted((r for r in training if r.lang == lang and own[r.doc_id]), key=lambda r: r.h)
        assert len(sample) <= langid.SAMPLE  # so all of them are in the sample
        dense = np.zeros((len(sample), langid.DIM), dtype=np.float32)
        for i, r in enumerate(sample):
            for b, x in vector(own[r.doc_id]).items():
                dense[i, b] = x
        centroids += [(lang, c) for c in langid.spherical_means(dense)[0]]
    got = {r.doc_id: r for r in langid.op8_language(spark, DATA).collect()}
    assert len(got) == len(docs)
    for r in docs:
        cosines = [(float(sum(c[b] * x for b, x in vector(own[r.doc_id]).items())), lang) for lang, c in centroids] if own[r.doc_id] else [(0.0, "und")]
        best = max(cosines)
        assert got[r.doc_id].held_out == held(r.doc_id) and abs(got[r.doc_id].score - min(1, max(0, best[0]))) < 1e-4
        assert got[r.doc_id].lang_pred in {lang for c, lang in cosines if c > best[0] - 1e-4}


def test_language_samples(spark, monkeypatch):
    """A language with few rows is learned beside one whose rows share one doc_id; of a large one the rows of least hash are taken."""
    rows = [(1, f"der hund und die katze nummer {i}", "aa") for i in range(4000)] + [(1000 + i, f"the quick brown fox number {i}", "bb") for i in range(60)] + [(5, "ça va très bien", "cc")] * 900
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert set(model.langs) == {"aa", "bb", "cc"} and model.langs.count("cc") == 1
    asked = spark.createDataFrame([(1, False, "hund und katze"), (2, False, "the brown fox"), (3, False, "très bien")], "doc_id long, held_out boolean, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(asked, model).collect()} == {1: "aa", 2: "bb", 3: "cc"}
    # the same model from the least rows alone, with document frequencies over all
    hashes = sorted((r.h, r.text) for r in docs.where("lang = 'aa'").select("text", F.xxhash64("doc_id", "text").alias("h")).collect())[: langid.SAMPLE]
    vectors = np.zeros((len(hashes), langid.DIM), dtype=np.float32)
    plain = langid.Model(model.idf, model.centroids, model.langs, model.limits)
    for i, (_, text) in enumerate(hashes):
        bins, counts = langid.grams(text)
        vectors[i, bins] = plain.vector(bins, counts)
    assert np.allclose(langid.spherical_means(vectors)[0], model.centroids[[k for k, x in enumerate(model.langs) if x == "aa"]], atol=1e-6)
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        langid.fit(docs)


def test_urls(spark):
    pages = [(1, None), (2, "no scheme"), (3, "HTTP://A.Example.COM/en/7?x"), (4, "http://x.example.net/de/81#t"), (5, "http://y.net/de/1"), (6, "http://com/en/"), (7, "http://q.org/es/1"), (8, "http://h?x")]
    pages += [(100 + i, f"http://spam.biz/bad/{i}") for i in range(60)] + [(200 + i, f"http://spam.biz/good/{i + 100}") for i in range(60)]
    labels = spark.createDataFrame([(i, 0, 1) for i in range(60)] + [(i + 100, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urltree.judge_urls(spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, template string"), labels).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(1, 9)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "/en/7", "example.com/en/7", "allow"), ("x.example.net", "/de/81", "example.net/de/8", "block"),
        ("y.net", "/de/1", "net/de/", "allow"), ("com", "/en/", "com/en/", "block"), ("q.org", "/es/1", "org/es/", "block"), ("h", "", None, "allow")]
    assert all(got[100 + i].verdict == "block" and got[200 + i].verdict == "allow" for i in range(60)) and got[100].template == "bad/*"
    deep = [(i, f"http://h.biz/a/b/c/d/{'bad' if i < 60 else 'good'}/{i}") for i in range(120)] + [(i, f"http://h.biz/u{i}/x/y{i % 2}/{i % 60}") for i in range(200, 300)]
    deep += [(900, "http://h.biz/" + "q/" * 3000), (901, "http://h.biz/a/b/c/d/bad/999"), (901, "http://h.biz/a/b/c/d/bad/999"), (None, None)]
    frame = spark.createDataFrame([(*p, "t", "s", "n") for p in deep], "page_id long, url string, template string, salt string, segments string")
    half = spark.createDataFrame([(i, 1, int(i < 60)) for i in range(120)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urltree.judge_urls(frame, half).collect()}
    assert all(got[i].verdict == ("block" if i < 60 else "allow") for i in range(120)) and got[901].verdict == "block"
    assert got[5].template == "a/b/c/d/bad/*" and got[205].template == "*/x/y1/*" and got[900].template == "/".join("*" * 3000)
    assert urltree.judge_urls(frame.limit(0), half).count() == 0 and {r.verdict for r in urltree.judge_urls(frame, half.limit(0)).collect()} == {"allow"}


def test_line_frequency(spark, odd):
    words = "".join(f"w{i} " for i in range(60))
    name = lambda i: chr(97 + i // 26) + chr(97 + i % 26)  # noqa: E731  digits are all alike in a normalised line
    rows = [(i, "common boilerplate line of the site\n" + " ".join(f"{name(i)}q{name(j)}" for j in range(60)), "s") for i in range(120)]
    rows += [(1000 + i, words, "s") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in linefreq.judge(df).collect()}
    assert all(got[i].kept and len(got[i].removed) == (i > 0) for i in range(120))
    assert got[1000].kept and not any(got[1000 + i].kept for i in range(1, 60))
    cleaned = {r.doc_id: r.text for r in linefreq.clean(df).collect()}
    assert len(cleaned) == 121 and "common" in cleaned[0] and "common" not in cleaned[5]
    edge = {r.doc_id: r for r in linefreq.judge(odd).collect()}
    assert (edge[1].n_words, edge[1].kept) == (0, False) and edge[5].n_words == 900 * 23 and edge[5].base_failed
    assert linefreq.judge(odd.limit(0)).count() == 0 and linefreq.clean(odd).columns == odd.columns
    clash = df.withColumns({c: F.lit(1) for c in ("kept", "removed", "a", "d", "lines", "x.y")})
    assert {r.doc_id: r.text for r in linefreq.clean(clash).collect()} == cleaned and linefreq.clean(clash).columns == clash.columns


def test_repeats_whatever_hash_and_place(spark):
    one, other = ([f"{c}{i}" for c in "abc"] for i in (174210, 379122))  # equal in the low 42 bits of xxhash64
    line = [f"r{i}" for i in range(200)]
    far = line + [f"u{i}" for i in range((1 << 22) + 1000)] + line
    docs = [(1, " ".join(one + ["x"] + other + ["y"] + one), "s"), (2, " ".join(one + ["x"] + other), "s"), (3, " ".join(far), "s"), (4, "a b c a b c", "s"), (5, "a a a a", "s"), (6, "a b c", "s")]
    got = {r.doc_id: r.n_repeat_words for r in linefreq.base_rules(spark.createDataFrame(docs, "doc_id long, text string, source string")).select("doc_id", "n_repeat_words").collect()}
    assert got == {1: 6, 2: 0, 3: 400, 4: 6, 5: 4, 6: 0}


def test_pipeline(spark, tmp_path):
    """Every stage from scratch: rules, line removal, pairs, passages and spans in DuckDB and plain Python, tokens by the library."""
    import re

    rng = random.Random(8)
    prose = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(70))
    own = [(10_000 + i, f"{prose()}\npassword = hunter{i}hunter\nthis very line stands in a lot of documents of one site\n{prose()}", "en", "src1", 0) for i in range(12)]
    own.append((10_020, own[3][1] + " more", "en", "src1", 0))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    data = str(tmp_path)
    docs.unionByName(spark.createDataFrame(own, docs.schema)).write.parquet(f"{data}/documents.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{data}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create table {name} as select * from '{data}/{name}.parquet/*.parquet'")

    def kept_texts(name, sql):
        return con.sql(f"select {name} from ({sql})").fetchall()

    # quality rules: verdicts in SQL, lines counted here
    docs = con.sql("select doc_id, text, source from documents").fetchall()
    passed = {i for i, ok in kept_texts("doc_id, kept", queries.oracle_sql()["op10_quality_rules"]) if ok}
    letters = re.compile(r"[^\W\d_]")

    def normal(line):
        return " ".join("".join("0" if c in "0123456789" else c if letters.match(c) else " " for c in line.lower()).split())

    lines = {}
    for i, t, s in docs:
        for line in {normal(x) for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)}:
            lines.setdefault((s or "", line), []).append(i)
    above = {k: min(v) for k, v in lines.items() if len(v) > (10 if len(k[1].split(" ")) >= 10 else 50)}

    def shorter(i, t, s):
        gone = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x) and above.get((s or "", normal(x)), i) != i]
        return "\n".join(x for x in t.split("\n") if x not in gone) if gone else t

    texts = {i: shorter(i, t, s) for i, t, s in docs if i in passed}
    # near duplicates: all pairs
    label = joined(texts, linked_pairs(texts))
    texts = {i: t for i, t in texts.items() if label[i] == i}
    # decontamination and secrets: SQL over what is left
    def left(rows):
        con.sql("drop table if exists documents")
        con.sql("create table documents (doc_id bigint, text varchar)")
        con.executemany("insert into documents values (?, ?)", list(rows.items()))

    left(texts)
    gone = {i for i, bad in kept_texts("doc_id, contaminated", queries.oracle_sql()["op3_decontamination"]) if bad}
    texts = {i: t for i, t in texts.items() if i not in gone}
    left(texts)
    for i, spans in kept_texts("doc_id, spans", queries.oracle_sql()["op6_secrets"]):
        want, at = "", 0
        for start, end in sorted(tuple(map(int, x.split(":")[1:])) for x in spans.split(",") if x):
            want, at = (want + texts[i][at:start] + "[SECRET]" if start >= at else want), max(at, end)
        texts[i] = want + texts[i][at:]
    assert len(passed) < len(docs) and gone and any("[SECRET]" in t for t in texts.values()) and 10_020 not in texts
    assert sum("this very line" in t for t in texts.values()) == 1
    check_packing(corpus_pipeline.run(spark, data).collect(), list(texts.items()))


def test_pipeline_stages_on_odd_rows(spark, odd, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns; and empty tables."""
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    for name, frame in (("odd", odd), ("none", odd.limit(0))):
        d = str(tmp_path / name)
        frame.write.parquet(f"{d}/documents.parquet")
        (bench if name == "odd" else bench.limit(0)).write.parquet(f"{d}/benchmark.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, d).columns == docs.columns
            assert stage(spark, docs, d).count() <= docs.count()
        check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, d).collect(), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        assert corpus_pipeline.run(spark, d).count() == 0  # every odd text has fewer than 50 words or repeats itself

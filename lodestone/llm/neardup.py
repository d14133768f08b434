"""Near duplicates by Order MinHash, verified by banded alignment.

A document is its sequence of words; a k-mer is a shingle of five words, labelled with its
occurrence number.  Each of ``sketches`` hash functions selects the ``ell`` least labelled
k-mers and keeps them in text order; documents that agree in one of these share a bucket.
The later half of the functions selects among first occurrences only, so that texts which
repeat one passage a different number of times, or changed throughout, meet as well.
A candidate pair is linked if a banded alignment finds a word edit similarity (1 - distance /
words of the longer text) of at least 0.8.

Steps: documents of equal words are reduced to one representative (partial minimum).  Every
representative is compared with the leader of each of its buckets, the member that has most
company over all its buckets; linked ones become one class by minimum-label propagation.
Buckets of over SMALL rows get further leaders, others each time.  Such a round makes at most
one pair per bucket row.  Then all pairs across classes that share a bucket are compared.
Buckets of over SMALL rows are dealt out for that in parts of about PART rows, those of the
bucket's largest class apart from the others; two parts meet in a task, which rules pairs out
by their word counts and aligns the rest, but not those that its links have joined already.
Parts of the largest class do not meet each other.  So one rule holds for buckets of all
sizes: every pair that shares a bucket is of one class already, compared, or ruled out exactly.

Common words at both ends are cut off before an alignment, and none is made where the counts
of words alone already differ by too much.

Members carry ids and buckets only.  Texts of those that share a bucket are shuffled once,
into a table bucketed by id, so that rounds move a pair's rows to the texts; one text a pair
then goes to the pair's leader, whose pairs are dealt out in parts of ``PART``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import discard, shared_dir, stored, table, whole_row, words_of

K, ELL, SKETCHES, SIMILARITY = 5, 3, 24, 0.8
ROUNDS, SMALL, PART, PART_WORDS, BINS = 2, 64, 512, 400_000, 128
_SEEDS = np.random.RandomState(20).randint(1, 2**62, size=(2, 256), dtype=np.int64).astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_word_hash: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; a bounded cache serves those that recur."""
    import xxhash

    cache = _word_hash
    if len(cache) > 250_000:
        cache.clear()
    for w in words:
        if w not in cache:
            cache[w] = xxhash.xxh3_64_intdigest(w)
    return np.array([cache[w] for w in words], dtype=np.uint64)


def shingles(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-word shingles in text order; a shorter document is one shingle."""
    n = len(hashes)
    width = min(k, n)
    out = np.full(max(0, n - width + 1) if n else 0, width, dtype=np.uint64)
    for j in range(width):
        out = _mix(out * np.uint64(31) + hashes[j : n - width + 1 + j])
    return out


def _labelled(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle with its occurrence number mixed in; and those that occur for the first time."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    first = np.r_[True, ranked[1:] != ranked[:-1]]
    where = np.arange(len(grams))
    number = np.empty(len(grams), dtype=np.uint64)
    number[order] = (where - np.maximum.accumulate(np.where(first, where, 0))).astype(np.uint64)
    labelled = _mix(grams + number * np.uint64(0xD6E8FEB86659FD93))
    return labelled, labelled[number == 0]


def order_minhash(grams: np.ndarray, sketches: int = SKETCHES, ell: int = ELL) -> list[int]:
    """One signed 64-bit value per sketch: the ell least labelled shingles, in text order; in the later half, of first occurrences."""
    if not len(grams):
        return []
    labelled, first = _labelled(grams)
    if len(first) == len(labelled):
        return _sketched(labelled, 0, sketches, ell)
    return _sketched(labelled, 0, sketches // 2, ell) + _sketched(first, sketches // 2, sketches, ell)


def _sketched(labelled: np.ndarray, low: int, high: int, ell: int) -> list[int]:
    """The values of sketches ``low`` to ``high`` of shingles in text order."""
    n, group, out = len(labelled), max(1, 2_000_000 // len(labelled)), []
    for s in range(low, high, group):  # groups bound the matrix for very long texts
        seeds = _SEEDS[:, s : min(high, s + group)]
        if n > ell:
            value = labelled[None, :] * (seeds[0][:, None] | np.uint64(1)) + seeds[1][:, None]
            value ^= value >> np.uint64(33)
            value *= np.uint64(0xFF51AFD7ED558CCD)
            value ^= value >> np.uint64(29)
            place = np.sort(np.argpartition(value, ell - 1, axis=1)[:, :ell], axis=1)
        else:
            place = np.broadcast_to(np.arange(n), (seeds.shape[1], n))
        acc = np.arange(s + 1, s + 1 + seeds.shape[1], dtype=np.uint64)
        for column in labelled[place].T:
            acc = _mix(acc * np.uint64(0x100000001B3) + column)
        out.extend(acc.astype(np.int64).tolist())
    return out


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Word edit distance within a band of ``most`` diagonals to each side; None beyond."""
    a, b = _without_ends(a, b)
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    if len(a) <= most:  # the band holds all cells; a few more diagonals do no harm
        return _banded(a, b, len(a)) if len(b) else len(a)
    return d if (d := _banded(a, b, most)) <= most else None


def _without_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without the words that they have in common at their ends; the distance is the same."""
    n = min(len(a), len(b))
    head = int(np.argmin(np.r_[a[:n] == b[:n], False]))
    a, b, n = a[head:], b[head:], n - head
    tail = int(np.argmin(np.r_[a[::-1][:n] == b[::-1][:n], False]))
    return a[: len(a) - tail], b[: len(b) - tail]


def _banded(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Distance of ``a`` from ``b`` (not longer) along paths within the band; any number above ``band`` if there is none.

    A column of the band is kept as two numbers whose bits say where it rises and falls (the
    known bit-vector form of the alignment); from column to column the band moves down by one.
    """
    width = 2 * band + 2
    mask, top = (1 << width) - 1, 1 << (width - 1)
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):  # bit width + i: word i, so that a window may begin before the first
        places[x] = places.get(x, 0) | 1 << (width + i)
    rise, fall, d = mask & ~((1 << (width - band - 1)) - 1), 0, band
    longest = 2 * band + len(b) - len(a)  # beyond it d cannot come back to the band
    edge = top >> 1
    for j, y in enumerate(b.tolist()):
        here = places.get(y, 0) >> (j + band + 1) & mask
        diagonal = ((((here & rise) + rise) ^ rise) | here | fall) & mask
        right, left = fall | (mask & ~(diagonal | rise)), diagonal & rise
        if j < len(a) - band:
            d += not diagonal & top
        else:
            d += bool(right & edge) - bool(left & edge)
            edge >>= 1
        if d > longest:
            return band + 1
        rise, fall = left | (mask & ~(diagonal >> 1 | right)), diagonal >> 1 & right
    return d


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the word edit similarity of two word-hash sequences reaches ``least``."""
    if not len(a) or not len(b):
        return False
    longest = max(len(a), len(b))
    most = int((1 - least) * longest + 1e-9)
    if longest - min(len(a), len(b)) > most:
        return False
    a, b = _without_ends(a, b)
    longest = max(len(a), len(b))
    if longest <= most or not len(a) or not len(b):
        return longest <= most
    _, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = (np.bincount(part, minlength=len(place)) for part in (place[: len(a)], place[len(a) :]))
    if longest - int(np.minimum(x, y).sum()) > most:
        return False
    return edit_distance(a, b, most) is not None


def sketch(docs: DataFrame) -> DataFrame:
    """``doc_id, key, n_words, buckets``: key is equal for documents of equal words (of equal text, if it has no word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, buckets = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                said = b"w" + b" ".join(words) if words else b"t" + text.encode("utf-8", "surrogatepass") if text else b"n" + str(doc_id).encode()
                keys.append(hashlib.blake2b(said, digest_size=16).digest())
                counts.append(len(words))
                buckets.append(order_minhash(shingles(word_hashes(words))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(buckets, pa.list_(pa.int64()))], ["doc_id", "key", "n_words", "buckets"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, key binary, n_words long, buckets array<long>")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that are near duplicates, given ``a, b, lead`` (lead is a or b) and ``id, text`` of every id.

    The texts of the other sides go to the leader's; a leader of many pairs is dealt out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            keep = []
            for lead, x, y in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                if lead != last:
                    last, left = lead, word_hashes(words_of(x))
                keep.append(similar(left, word_hashes(words_of(y))))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    load = pairs.groupBy("lead").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    member = F.when(F.col("a") == F.col("lead"), F.col("b")).otherwise(F.col("a"))
    own = pairs.join(load, "lead").select("a", "b", "lead", member.alias("id"), F.pmod(F.xxhash64(member), F.col("parts")).cast("int").alias("part"))
    right = texts.join(own, "id").select("a", "b", "lead", "part", F.col("text").alias("y"))
    left = texts.join(load.withColumnRenamed("lead", "id"), "id").select(F.col("id").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("text").alias("x"))
    return right.join(left, ["lead", "part"]).select("a", "b", "lead", "x", "y").mapInArrow(run, "a long, b long")


def large_links(rows: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``a, b`` across classes within large buckets, given ``bucket, id, n_words, class_id`` of these.

    Rows of a bucket's largest class make parts of their own, as do the others; each part of the
    others meets all parts.  A pair is looked at in the first bucket that it shares.
    """
    of_class = rows.groupBy("bucket", "class_id").agg(F.count("*").alias("rows"), F.sum("n_words").alias("words"))
    main = F.max_by(F.struct("class_id", "rows", "words"), F.struct("rows", "class_id"))
    shape = of_class.groupBy("bucket").agg(main.alias("main"), F.sum("rows").alias("rows"), F.sum("words").alias("words"), F.count("*").alias("classes")).where("classes > 1")
    parts = lambda n, words: F.ceil(F.greatest(n / PART, words / PART_WORDS)).cast("int")
    shape = shape.select("bucket", F.col("main.class_id").alias("main"), parts(F.col("main.rows"), F.col("main.words")).alias("p"), parts(F.col("rows") - F.col("main.rows"), F.col("words") - F.col("main.words")).alias("q"))
    own = rows.join(shape, "bucket").withColumn("others", F.col("class_id") != F.col("main"))
    part = F.when(F.col("others"), F.col("p") + F.pmod(F.xxhash64("id"), F.col("q"))).otherwise(F.pmod(F.xxhash64("id"), F.col("p"))).cast("int")
    meets = F.when(F.col("others"), F.sequence(F.lit(0), F.col("p") + F.col("q") - 1)).otherwise(F.sequence(F.col("p"), F.col("p") + F.col("q") - 1))
    dealt = own.withColumn("part", part).select("bucket", "id", "class_id", "part", F.explode(meets).alias("other"))
    held = members.select("id", F.transform("buckets", lambda x: x["bucket"]).alias("held"))
    dealt = dealt.join(held, "id").join(texts, "id")
    dealt = dealt.select("bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "id", "class_id", "held", "text")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        bucket = group.column("bucket")[0].as_py()
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        ids, part, classes = (group.column(c).to_numpy() for c in ("id", "part", "class_id"))
        held = [set(x) for x in group.column("held").to_pylist()]
        words = [word_hashes(words_of(t)) for t in group.column("text").to_pylist()]
        length = np.array([len(w) for w in words])
        counts = np.stack([np.bincount((w % np.uint64(BINS)).astype(np.int64), minlength=BINS) for w in words]).astype(np.int32)
        label = {c: c for c in classes.tolist()}

        def root(c: int) -> int:
            while label[c] != c:
                c = label[c]
            return c

        left = np.flatnonzero(part == high)
        right = left if low == high else np.flatnonzero(part == low)
        found: list[tuple[int, int]] = []
        for i in left.tolist():
            j = right[right > i] if low == high else right
            longest = np.maximum(length[j], length[i])
            j = j[(classes[j] != classes[i]) & (np.minimum(length[j], length[i]) >= SIMILARITY * longest - 1e-6)]
            # one edit changes two counts at most
            far = np.abs(counts[j] - counts[i]).sum(axis=1)
            j = j[far <= 2 * ((1 - SIMILARITY) * np.maximum(length[j], length[i]) + 1e-6)]
            for k in j.tolist():
                a, b = root(int(classes[i])), root(int(classes[k]))
                if a != b and min(held[i] & held[k]) == bucket and similar(words[i], words[k]):
                    label[max(a, b)] = min(a, b)
                    found.append((int(min(ids[i], ids[k])), int(max(ids[i], ids[k]))))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("bucket", "low", "high").applyInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, out_dir: str) -> DataFrame:
    """``id, class_id`` of every id in ``links`` (a, b): the least id that it is connected with.

    Each round points every id to the least of its neighbours and itself, and on to where these
    point in the end; edges are then drawn between what their ends point to, and those within one drop out.
    Rounds, written to the shared folder, grow with the logarithm of the longest chain, and each
    works on what is left of the edges.
    """
    apart = lambda rows, a, b: rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    edges, rounds = stored(apart(links, "a", "b"), f"{out_dir}/edges-0"), []
    while edges.limit(1).count():
        n = len(rounds)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("class_id")), f"{out_dir}/points-{n}-0")
        for k in range(1, 64):  # each pass doubles the way; most end after two
            on = points.select(F.col("id").alias("class_id"), F.col("class_id").alias("on"))
            points = stored(points.join(on, "class_id").select("id", F.col("on").alias("class_id"), (F.col("on") != F.col("class_id")).alias("moved")), f"{out_dir}/points-{n}-{k}")
            if not points.where("moved").limit(1).count():
                break
        rounds.append(points.select("id", "class_id"))
        ends = rounds[-1].select(F.col("id").alias("a"), F.col("class_id").alias("x")), rounds[-1].select(F.col("id").alias("b"), F.col("class_id").alias("y"))
        edges = stored(apart(edges.join(ends[0], "a").join(ends[1], "b"), "x", "y"), f"{out_dir}/edges-{n + 1}")
    if not rounds:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("class_id"))
    labels = rounds.pop()
    while rounds:  # from the last round, of few ids, to the first
        further = labels.select(F.col("id").alias("class_id"), F.col("class_id").alias("last"))
        labels = stored(rounds.pop().join(further, "class_id", "left").select("id", F.coalesce("last", "class_id").alias("class_id")), f"{out_dir}/labels-{len(rounds)}")
    return labels


def merged(labels: DataFrame, found: DataFrame, out_dir: str) -> DataFrame:
    """``id, class_id`` after the links ``found`` (a, b), given those of the links before."""
    a, b = (labels.select(F.col("id").alias(x), F.col("class_id").alias(f"of_{x}")) for x in "ab")
    between = found.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = components(between, out_dir).select(F.col("id").alias("class_id"), F.col("class_id").alias("to"))
    ids = found.select(F.col("a").alias("id")).unionByName(found.select(F.col("b").alias("id"))).distinct().join(labels, "id", "left_anti")
    every = labels.unionByName(ids.select("id", F.col("id").alias("class_id")))
    return stored(every.join(joined, "class_id", "left").select("id", F.coalesce("to", "class_id").alias("class_id")), f"{out_dir}/merged")


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, class_id, class_size, class_links``; class_id is the least doc_id of the class.

    class_size counts documents, class_links the verified links between different texts of the
    class (``linked`` returns them); pairs that a class already connects are not compared again.

    A row with a null doc_id is a class of its own with a null class_id.  Null and empty texts
    are alone; texts without words are a class only with equal texts.  Repeated rows give
    repeated rows of one class; of different texts under one doc_id the least is compared.
    Texts of any length are compared whole.  Other columns are ignored, whatever their names.
    An empty table gives no rows.
    """
    return linked(docs)[0]


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``classes`` and the verified links ``a, b`` (a < b) between representatives, the least doc_ids of equal texts."""
    spark, out = docs.sparkSession, shared_dir(docs.sparkSession, "near-duplicates")
    own = docs.select(F.col("doc_id").cast("long"), "text")
    docs = own.where("doc_id is not null")
    sketched = stored(sketch(docs), f"{out}/sketches")
    first = sketched.groupBy("key").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), F.first("n_words").alias("n_words"), F.first("buckets").alias("buckets"))
    reps = stored(first, f"{out}/representatives")  # equal words have equal buckets
    rows = reps.where("n_words > 0").select("id", "n_words", F.posexplode("buckets").alias("s", "v")).select("id", "n_words", F.xxhash64("s", "v").alias("bucket"))
    crowded = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = rows.join(crowded, "bucket").groupBy("id").agg(F.max("n_words").alias("n_words"), F.sum("n").alias("company"), F.collect_set(F.struct("bucket", "n")).alias("buckets"))
    members = stored(shared, f"{out}/members")  # at most SKETCHES buckets each
    texts, drop_texts = _bucketed_texts(docs, members, f"{out}/texts")

    try:
        labels, links = _compared(members, texts, out)
        links = stored(links, f"{out}/links")
    finally:
        drop_texts()
    rep_class = reps.join(labels, "id", "left").select("key", F.coalesce("class_id", "id").alias("class_id"), "n")
    sizes = rep_class.groupBy("class_id").agg(F.sum("n").alias("class_size"))
    counts = links.join(labels.withColumnRenamed("id", "a"), "a").groupBy("class_id").agg(F.count("*").alias("class_links"))
    sizes = sizes.join(counts, "class_id", "left").withColumn("class_links", F.coalesce("class_links", F.lit(0).cast("long")))
    rep_class = stored(rep_class.join(sizes, "class_id").select("key", "class_id", "class_size", "class_links"), f"{out}/rep-classes")
    discard(out, keep=("sketches", "rep-classes", "links"))
    named = sketched.select("doc_id", "key").join(rep_class, "key").drop("key")
    one = F.lit(1).cast("long"), F.lit(0).cast("long")
    return named.unionByName(own.where("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), one[0].alias("class_size"), one[1].alias("class_links"))), links


def _compared(members: DataFrame, texts: DataFrame, out: str) -> tuple[DataFrame, DataFrame]:
    """``id, class_id`` of the members that are linked, and the links ``a, b``."""
    spark = members.sparkSession
    labels, links, tried = spark.createDataFrame([], "id long, class_id long"), spark.createDataFrame([], "a long, b long"), None
    for turn in range(ROUNDS + 1):
        now = members.join(labels, "id", "left").select("id", "n_words", "company", F.coalesce("class_id", "id").alias("class_id"), F.inline("buckets"))
        if turn < ROUNDS:  # every member against the leader of this turn
            pairs = _leader_pairs(now if turn == 0 else now.where(F.col("n") > SMALL), turn)
        else:  # all that buckets still hold in different classes
            mixed = now.groupBy("bucket").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("low <> high").select("bucket")
            now = stored(now.join(mixed, "bucket"), f"{out}/mixed")
            pairs = _small_pairs(now.where(F.col("n") <= SMALL))
        pairs = pairs.groupBy("a", "b").agg(F.min("lead").alias("lead"))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs, f"{out}/pairs-{turn}")
        found = verify(pairs, texts)
        if turn == ROUNDS:
            found = found.unionByName(large_links(now.where(F.col("n") > SMALL).select("bucket", "id", "n_words", "class_id"), members, texts)).distinct()
        found = stored(found, f"{out}/links-{turn}")
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        if found.limit(1).count():
            links = links.unionByName(found)
            labels = merged(labels, found, f"{out}/classes-{turn}")
    return labels, links


def _bucketed_texts(docs: DataFrame, members: DataFrame, path: str):
    """``id, text`` of the members as a table bucketed by id, and a function that drops its name.

    The one shuffle of texts; both sides are dealt out alike at every size, so that a bucket is
    one task and one file.
    """
    spark, name = docs.sparkSession, f"near_duplicates_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = members.select("id").repartition(n, "id").hint("merge")
    texts = docs.withColumnRenamed("doc_id", "id").repartition(n, "id").join(wanted, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    texts.write.bucketBy(n, "id").sortBy("id").option("path", path).saveAsTable(name)
    return spark.table(name), lambda: spark.sql(f"DROP TABLE {name}")


def _leader_pairs(now: DataFrame, turn: int) -> DataFrame:
    """``a, b, lead`` of every bucket row with the leader of its bucket, where classes differ and lengths fit."""
    rank = F.struct(-F.col("company") if turn == 0 else F.xxhash64("id", "bucket", F.lit(turn)), "id")
    leaders = now.groupBy("bucket").agg(F.min_by(F.struct("id", "class_id", "n_words"), rank).alias("lead"))
    met = now.join(leaders, "bucket").where("class_id <> lead.class_id").where(_lengths_fit("n_words", "lead.n_words"))
    return met.select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b"), F.col("lead.id").alias("lead"))


def _small_pairs(few: DataFrame) -> DataFrame:
    """``a, b, lead`` of all pairs of different classes that share a bucket and can be similar."""
    other = few.select("bucket", F.col("id").alias("b"), F.col("class_id").alias("other"), F.col("n_words").alias("length"))
    pairs = few.withColumnRenamed("id", "a").join(other, "bucket").where("a < b and class_id <> other").where(_lengths_fit("n_words", "length"))
    return pairs.select("a", "b", F.col("a").alias("lead"))


def _lengths_fit(a: str, b: str) -> Column:
    """An edit similarity of 0.8 is possible at these word counts."""
    return F.least(a, b) >= SIMILARITY * F.greatest(a, b) - 1e-6


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each class, that with the least doc_id; columns as they were, whatever their names.

    Of several rows with that doc_id the one of least text stays (a null text first), of equal
    ones one.  Rows with a null doc_id stay, as do null and empty texts (each is a class).  An
    empty table gives no rows.
    """
    kept = classes(docs).where("doc_id = class_id").select("doc_id").distinct()
    rows = docs.select(whole_row(docs).alias("d")).withColumn("doc_id", F.col("d.doc_id").cast("long"))
    first = rows.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    first = first.groupBy("doc_id").agg(F.min_by("d", F.struct("d.text")).alias("d")).select("d")
    both = first.unionByName(rows.where("doc_id is null").select("d"))
    return both.select(*(F.col(f"d.`{c}`").alias(c) for c in docs.columns))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))

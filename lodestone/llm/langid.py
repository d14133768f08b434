"""Language identification by nearest centroid over TF-IDF character n-grams.

Features are hashed 1- to 3-grams of lower-cased letters (runs of anything else are one
space), weighted (1 + ln tf) * idf and normalised.  Document frequencies are over all
training documents; each language's centroids are spherical k-means over at most ``SAMPLE``
of its training documents (those of least hash of doc_id and text), the documented bound of
the fit.  A text takes the language of the centroid with the greatest cosine; ``rejected`` says
that the cosine is below that centroid's own limit, learned from its members.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import crc_mod3, discard, shared_dir, stored, table

DIM, SAMPLE, CENTROIDS, ROUNDS, REJECT_QUANTILE = 1 << 14, 300, 4, 8, 0.01
#: A model has CENTROIDS dense centroids a language; more languages than this are taken for an error in the data.
MOST_LANGUAGES = 500


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hash bins and counts of a text's n-grams; empty if it has no letter.  Long texts are counted in slices."""
    if not text or not any(map(str.isalpha, text)):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    total = np.zeros(DIM, dtype=np.int64)
    words = " ".join(_letters(text).split())
    for at in range(0, len(words), 500_000):
        c = np.frombuffer((" " + words[max(0, at - 2) : at + 500_000] + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
        one = c * np.uint32(2654435761)
        two = (one[:-1] ^ (c[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
        three = (two[:-1] ^ (c[2:] * np.uint32(668265263))) * np.uint32(374761393)
        total += np.bincount(np.concatenate([one[1:-1] >> np.uint32(18), two >> np.uint32(18), three >> np.uint32(18)]), minlength=DIM)
    bins = np.flatnonzero(total)
    return bins, total[bins]


class _Blank(dict):
    """Maps characters that are not letters to a space, learning each once."""

    def __missing__(self, code: int) -> int:
        value = code if chr(code).isalpha() else 32
        if len(self) < 100_000:
            self[code] = value
        return value


_blank = _Blank()


def _letters(text: str) -> str:
    return text.lower().translate(_blank)


@dataclass
class Model:
    idf: np.ndarray  # DIM
    centroids: np.ndarray  # centroids x DIM
    langs: list[str]  # of each centroid
    limits: np.ndarray  # least cosine of each centroid

    def vector(self, bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1.0 + np.log(counts)) * self.idf[bins]
        norm = np.sqrt(v @ v)
        return v / norm if norm else v

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        bins, counts = grams(text)
        if not len(bins) or not self.langs:
            return "und", 0.0, True
        cosine = self.centroids[:, bins] @ self.vector(bins, counts)
        best = int(cosine.argmax())
        return self.langs[best], float(min(1.0, max(0.0, cosine[best]))), bool(cosine[best] < self.limits[best])


def fit(training: DataFrame) -> Model:
    """Fits on ``doc_id, text, lang``.

    Rows without text or lang are left out; texts without a letter have no features.  The sample
    of a language is its SAMPLE different rows of least hash of doc_id and text, or all if it has
    fewer, whatever other languages have; equal rows count once there, and each time in the
    document frequencies.  Texts of any length are counted whole.  The order of rows does not
    matter: the sample is sorted.  Other columns are ignored.  An empty table gives a model
    without languages; over MOST_LANGUAGES languages are refused.
    """
    rows = training.where("lang is not null and text is not null").select("doc_id", "text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    different = rows.where(F.col("text").rlike(r"\p{L}")).groupBy("lang", "h").agg(F.lit(1).alias("one"))
    least = different.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("nth") <= SAMPLE)  # at most SAMPLE a task and language are shuffled
    cuts = {r.lang: r.cut for r in least.groupBy("lang").agg(F.max("h").alias("cut")).limit(MOST_LANGUAGES + 1).collect()}  # one row a language
    if len(cuts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    least_hash = -(1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, taken = np.zeros(DIM, dtype=np.int64), 0, set()
        names = ["bin", "df", "lang", "h", "bins", "counts"]

        def batch_of(bins, dfs, langs, hs, bs, cs) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()), pa.array(dfs, pa.int64()), pa.array(langs, pa.string()), pa.array(hs, pa.int64()), pa.array(bs, pa.list_(pa.int64())), pa.array(cs, pa.list_(pa.int64()))], names)

        for batch in batches:
            langs, hs, bs, cs = [], [], [], []
            for text, lang, h in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                bins, counts = grams(text)
                if len(bins):
                    df[bins] += 1
                    n += 1
                    if h <= cuts.get(lang, least_hash) and (lang, h) not in taken:
                        taken.add((lang, h))
                        langs.append(lang), hs.append(h), bs.append(bins.tolist()), cs.append(counts.tolist())
            k = len(langs)
            yield batch_of([None] * k, [None] * k, langs, hs, bs, cs)
        at = np.flatnonzero(df).tolist()
        yield batch_of([-1, *at], [n, *df[at].tolist()], *([[None] * (len(at) + 1)] * 4))

    out = shared_dir(training.sparkSession, "language-features")
    seen = stored(rows.mapInArrow(run, "bin long, df long, lang string, h long, bins array<long>, counts array<long>"), out)
    df = {r.bin: r.df for r in seen.where("bin is not null").groupBy("bin").agg(F.sum("df").alias("df")).collect()}  # at most DIM + 1 rows
    n = df.pop(-1, 0)
    idf = np.full(DIM, np.log(1.0 + n))
    for b, d in df.items():
        idf[b] = np.log((1.0 + n) / (1.0 + d))
    model = Model(idf + 0.1, np.zeros((0, DIM), dtype=np.float32), [], np.zeros(0))
    centroids, langs, limits = [], [], []
    samples: dict[str, list] = {}
    for r in seen.where("lang is not null").select("lang", "h", "bins", "counts").dropDuplicates(["lang", "h"]).collect():  # at most SAMPLE a language
        samples.setdefault(r.lang, []).append((r.h, r.bins, r.counts))
    discard(out)
    for lang in sorted(samples):
        sample = sorted(samples[lang])
        vectors = np.zeros((len(sample), DIM), dtype=np.float32)
        for i, (_, own, counts) in enumerate(sample):
            bins = np.array(own, dtype=np.int64)
            vectors[i, bins] = model.vector(bins, np.array(counts))
        means, least = spherical_means(vectors)
        centroids.append(means), limits.extend(least), langs.extend([lang] * len(means))
    if langs:
        model = Model(model.idf, np.concatenate(centroids).astype(np.float32), langs, np.array(limits))
    return model


def spherical_means(vectors: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[np.ndarray, list[float]]:
    """Unit centroids by cosine, started at the vectors farthest from those chosen; and each one's least cosine but for REJECT_QUANTILE."""
    chosen = [0]
    near = vectors @ vectors[0]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    means = vectors[chosen].copy()
    for _ in range(rounds):
        own = (vectors @ means.T).argmax(axis=1)
        for c in range(len(means)):
            if (own == c).any():
                mean = vectors[own == c].mean(axis=0)
                means[c] = mean / max(float(np.linalg.norm(mean)), 1e-12)
    cosine = vectors @ means.T
    own = cosine.argmax(axis=1)
    return means, [float(np.quantile(cosine[own == c, c], REJECT_QUANTILE)) if (own == c).any() else 1.0 for c in range(len(means))]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``doc_id, text`` (and ``held_out``): the language, the cosine and whether it is rejected.

    ``und`` with score 0 for null texts, texts without a letter, and an empty model.  Of equal
    cosines the first centroid wins, in order of languages.  Texts of any length are read whole;
    repeated rows get equal rows; an empty table gives none; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: languages x CENTROIDS x DIM floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            said = [m.predict(t) for t in batch.column(2).to_pylist()]
            langs, scores, rejected = zip(*said, strict=True) if said else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(crc_mod3(F.col("doc_id")) == 1, F.lit(False)))
    return identify(docs, fit(docs.where("not held_out")))

"""Append-only tables under one manifest, and the versioned chunk store on it.

Batches are written to folders of their own; they count once a manifest names them.  A manifest
is a small file with a number; the next one is moved to its name only if no other writer took
it, so all tables of a batch appear together or not at all, a batch that runs again is known by
its id, and a writer that dies leaves files that nobody reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lodestone.constants import EMBED_BATCH, MAX_CHUNKS
from lodestone.sources.chunkers import chunk_documents

Embed = Callable[[list[str]], list[list[float]]]
Chunker = Callable[[DataFrame], DataFrame]


class Conflict(Exception):
    """Another writer has committed this number."""


class TableSet:
    """Named tables that are appended to in batches, under numbered manifests below ``root``."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]) -> None:
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def current(self) -> tuple[int, dict]:
        """Number and batches of the newest manifest; 0 and none before the first."""
        folder = self._path("manifest")
        system = folder.getFileSystem(self._conf)
        if not system.exists(folder):
            return 0, {}
        names = [str(s.getPath().getName()) for s in system.listStatus(folder)]
        newest = max((n for n in names if n.endswith(".json") and not n.startswith(".")), default=None)
        if newest is None:
            return 0, {}
        stream = system.open(self._path(f"manifest/{newest}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return int(newest[:-5]), json.loads(text)

    def swap(self, number: int, batches: dict) -> None:
        """Makes ``batches`` the manifest after ``number``; Conflict if there is one already."""
        target, private = self._path(f"manifest/{number + 1:012d}.json"), self._path(f"manifest/.{uuid.uuid4().hex}")
        system = target.getFileSystem(self._conf)
        stream = system.create(private, False)
        stream.write(bytearray(json.dumps(batches).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), self._conf)
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            context.rename(private, target, how)
        except Exception as error:
            system.delete(private, False)
            if "FileAlreadyExistsException" in str(error):
                raise Conflict(number + 1) from error
            raise

    def change(self, edit: Callable[[dict], dict | None], tries: int = 20) -> bool:
        """Applies ``edit`` to the newest batches until no other writer comes between; False where it returns None."""
        for _ in range(tries):
            number, batches = self.current()
            new = edit(dict(batches))
            if new is None:
                return False
            try:
                self.swap(number, new)
                return True
            except Conflict:
                continue
        raise Conflict(f"{tries} tries")

    def append(self, batch: str, tables: dict[str, DataFrame], **facts) -> bool:
        """Writes the batch's tables and commits them together; a batch that is there already changes nothing."""
        if batch in self.current()[1]:
            return False
        folders = {}
        for name, rows in tables.items():
            folders[name] = f"{name}/{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.root}/{folders[name]}")
        return self.commit(batch, folders, **facts)

    def commit(self, batch: str, folders: dict[str, str], **facts) -> bool:
        return self.change(lambda known: None if batch in known else known | {batch: {"folders": folders, **facts}})

    def read(self, name: str, where: Callable[[dict], bool] = lambda facts: True, named: bool = False) -> DataFrame:
        """The rows of all committed batches (or of those whose facts pass), with ``batch`` if asked."""
        chosen = {b: f["folders"][name] for b, f in self.current()[1].items() if name in f["folders"] and where(f)}
        if not chosen:
            empty = self.spark.createDataFrame([], self.schemas[name])
            return empty.withColumn("batch", F.lit(None).cast("string")) if named else empty
        rows = self.spark.read.schema(self.schemas[name]).parquet(*(f"{self.root}/{p}" for p in chosen.values()))
        if not named:
            return rows
        of = F.create_map(*(F.lit(x) for b, p in chosen.items() for x in (p.rpartition("/")[2], b)))
        return rows.withColumn("batch", F.try_element_at(of, F.regexp_extract(F.col("_metadata.file_path"), r"/([0-9a-f]{32})/[^/]+$", 1)))


CHUNKS = "document_id long, document_version long, chunk_index int, page_number int, content string, section_title string, embedding array<float>"
STATES = "document_id long, document_version long, status string, reason string, chunk_count long"


def embed_documents(chunks: DataFrame, embed: Embed) -> DataFrame:
    """``embedding`` and ``error`` for each chunk; a call has at most EMBED_BATCH texts, all of one document and version.

    A call that fails, or returns another number of vectors or vectors of several widths, marks
    the document's chunks in it and no others.
    """
    names = chunks.columns
    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])

    def called(texts: list[str]) -> tuple[list, str | None]:
        try:
            got = embed(texts)
        except Exception as error:  # noqa: BLE001  the model's failure is the document's, with its reason
            return [None] * len(texts), f"model: {error}"
        if len(got) != len(texts):
            return [None] * len(texts), "count of vectors"
        if len({len(v) for v in got}) != 1 or not len(got[0]):
            return [None] * len(texts), "width of vectors"
        return got, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(zip(*(batch.column(names.index(c)).to_pylist() for c in ("document_id", "document_version")), strict=True))
            texts, vectors, errors, at = batch.column(names.index("content")).to_pylist(), [], [], 0
            while at < len(texts):
                to = at + 1
                while to < len(texts) and to - at < EMBED_BATCH and own[to] == own[at]:
                    to += 1
                got, error = called([t or "" for t in texts[at:to]])
                vectors.extend(got)
                errors.extend([error] * (to - at))
                at = to
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], [*batch.schema.names, "embedding", "error"])

    return chunks.mapInArrow(run, schema)


class ChunkStore(TableSet):
    """Chunks and states of documents by version: drafted, then published in one swap of the manifest."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        super().__init__(spark, root, {"chunks": CHUNKS, "states": STATES})

    def draft(self, docs: DataFrame, embed: Embed, batch: str, chunker: Chunker | None = None) -> bool:
        """Chunks and embeds the newest versions of ``document_id, version, file_type, text, page_number`` as a batch that is not visible yet.

        Of several versions of a document the greatest counts, in the batch and against the
        store: others get the state ``superseded``.  A version that is ready is not made again,
        one that failed is.  A document without a chunk, with more than MAX_CHUNKS, or one that
        the model fails on or gives vectors of several widths, gets ``failed`` and the reason, and
        leaves no chunk.  Rows with a null id or version are left out.  The batch's id makes a
        repeated call do nothing.
        """
        if batch in self.current()[1]:
            return False
        chunker = chunker or (lambda rows: chunk_documents(rows, 500, 50))
        docs = docs.where("document_id is not null and version is not null")
        known = self._latest().groupBy("document_id").agg(F.max("document_version").alias("newest"), F.max(F.when(F.col("status") == "ready", F.col("document_version"))).alias("ready"))
        asked = docs.select("document_id", F.col("version").alias("document_version")).distinct()
        greatest = F.max("document_version").over(Window.partitionBy("document_id"))
        heads = asked.withColumn("greatest", greatest).join(known, "document_id", "left")
        late = (F.col("document_version") < F.col("greatest")) | F.coalesce(F.col("document_version") < F.col("newest"), F.lit(False))
        done = F.coalesce(F.col("document_version") == F.col("ready"), F.lit(False))
        folder = f"{self.root}/work/{uuid.uuid4().hex}"
        heads = self._written(heads.where(~done).select("document_id", "document_version", late.alias("late")), f"{folder}/heads")
        wanted = heads.where("not late").drop("late")
        own = docs.withColumnRenamed("version", "document_version").join(wanted, ["document_id", "document_version"], "left_semi")
        pieces = self._written(chunker(own), f"{folder}/pieces")
        counts = pieces.groupBy("document_id", "document_version").agg(F.count("*").alias("chunk_count"))
        fits = counts.where(F.col("chunk_count") <= MAX_CHUNKS)
        made = self._written(embed_documents(pieces.join(fits.drop("chunk_count"), ["document_id", "document_version"], "left_semi"), embed), f"{folder}/embedded")
        width = F.size("embedding")
        judged = made.groupBy("document_id", "document_version").agg(F.min("error").alias("error"), (F.min(width) == F.max(width)).alias("even"))
        states = wanted.join(counts, ["document_id", "document_version"], "left").join(judged, ["document_id", "document_version"], "left")
        reason = F.when(F.col("chunk_count").isNull(), "no chunk").when(F.col("chunk_count") > MAX_CHUNKS, "too many chunks").when(F.col("error").isNotNull(), F.col("error")).when(~F.col("even"), "width of vectors")
        states = states.withColumn("reason", reason)
        states = states.select("document_id", "document_version", F.when(F.col("reason").isNull(), "ready").otherwise("failed").alias("status"), "reason", F.when(F.col("reason").isNull(), F.col("chunk_count")).otherwise(0).cast("long").alias("chunk_count"))
        superseded = heads.where("late").select("document_id", "document_version", F.lit("superseded").alias("status"), F.lit(None).cast("string").alias("reason"), F.lit(0).cast("long").alias("chunk_count"))
        states = self._written(states.unionByName(superseded), f"{folder}/states")
        good = states.where("status = 'ready'").select("document_id", "document_version")
        columns = [f.split()[0] for f in CHUNKS.split(", ")]
        made_well = made.join(good, ["document_id", "document_version"], "left_semi").select(*columns)
        committed = self.append(batch, {"chunks": made_well, "states": states}, published=False)
        path = self._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self._conf).delete(path, True)
        return committed

    def _written(self, rows: DataFrame, path: str) -> DataFrame:
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def publish(self, batch: str | None = None) -> bool:
        """Publishes a drafted batch, or all of them (what a writer that died has left); twice is as once."""

        def edit(batches: dict) -> dict | None:
            mine = [b for b, f in batches.items() if not f["published"] and batch in (None, b)]
            return batches | {b: batches[b] | {"published": True} for b in mine} if mine else None

        return self.change(edit)

    def ingest(self, docs: DataFrame, embed: Embed, batch: str, chunker: Chunker | None = None) -> None:
        self.draft(docs, embed, batch, chunker)
        self.publish(batch)

    def _latest(self) -> DataFrame:
        """The last state of each document and version: ready counts, whatever comes after."""
        order = F.when(F.col("status") == "ready", 2).when(F.col("status") == "failed", 1).otherwise(0)
        rows = self.read("states")
        return rows.groupBy("document_id", "document_version").agg(F.max_by(F.struct("status", "reason", "chunk_count"), F.struct(order, "reason")).alias("s")).select("document_id", "document_version", "s.*")

    def documents(self) -> DataFrame:
        """``document_id, document_version, status, reason, chunk_count``; of drafted batches ready ones are still ``publishing``."""
        drafted = self.read("states", lambda f: not f["published"]).where("status = 'ready'").select("document_id", "document_version", F.lit(True).alias("drafted"))
        rows = self._latest().join(drafted, ["document_id", "document_version"], "left")
        return rows.withColumn("status", F.when(F.col("drafted") & (F.col("status") == "ready"), "publishing").otherwise(F.col("status"))).drop("drafted")

    def visible(self) -> DataFrame:
        """The chunks of each document's greatest published version: what readers see."""
        states = self.read("states", lambda f: f["published"]).where("status = 'ready'")
        newest = states.groupBy("document_id").agg(F.max("document_version").alias("document_version"))
        return self.read("chunks", lambda f: f["published"]).join(newest, ["document_id", "document_version"], "left_semi")

    def compact(self) -> None:
        """Rewrites what readers see, and the states, as one batch: old versions and many small folders go."""
        number, batches = self.current()
        if not batches or not all(f["published"] for f in batches.values()):
            raise ValueError("publish all batches first")
        folders = {"chunks": f"chunks/{uuid.uuid4().hex}", "states": f"states/{uuid.uuid4().hex}"}
        self.visible().write.parquet(f"{self.root}/{folders['chunks']}")
        self._latest().write.parquet(f"{self.root}/{folders['states']}")
        ids = {b: {"folders": {}, "published": True} for b in batches}  # still known as done
        self.swap(number, ids | {f"compacted-{number}": {"folders": folders, "published": True}})


def start(spark: SparkSession, source: str, store: ChunkStore, checkpoint: str, embed: Embed, once: bool = True) -> StreamingQuery:
    """Streams Parquet files of documents into the store; a batch that runs again is known by the stream's checkpoint and number."""
    schema = "document_id long, version long, file_type string, text string, page_number int"

    def write(batch: DataFrame, number: int) -> None:
        store.ingest(batch, embed, f"{checkpoint}#{number}")

    writer = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()

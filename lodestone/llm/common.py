"""Tables, shared folders and small helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the decontamination and near-duplicate operators: digits, letters and all beyond ASCII.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().translate(WORD_BYTES).split() if text else []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; sets a folder only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + root
    elif root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root[5:]
    return f"{root}/lodestone/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there and sizes are known to the planner."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(uri: str, keep: tuple[str, ...] = ()) -> None:
    """Removes what lies in a folder of the shared folder, but for the names in ``keep``."""
    from pyarrow import fs

    system, path = open_fs(uri)
    for entry in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if entry.base_name not in keep:
            (system.delete_dir if entry.type == fs.FileType.Directory else system.delete_file)(entry.path)


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, so that no name can clash with columns that are joined."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def two_hashes(*columns: Column | str) -> tuple[Column, Column]:
    """``a, b``: 128 bits of hash of the columns, to join rows of equal values."""
    return F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b")


def open_fs(uri: str):
    """pyarrow file system and path of a URI that executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_once(uri: str, write) -> None:
    """Calls ``write(stream)`` on a private name and moves the file to ``uri``; a repeated task replaces it with equal bytes."""
    system, path = open_fs(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    private = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(private) as stream:
        write(stream)
    system.move(private, path)


def crc_mod3(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))

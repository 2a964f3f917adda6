"""What several operators share: the shared folder, text batches, word hashes."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` names it.  Where that is unset a temporary
    folder is made and set, if driver and executors are one process (``local``); a
    cluster without the setting is refused, as its machines share no such folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Bytes of a row group that a task holds while it writes.
_ROW_GROUP = 16 << 20


class Scratch:
    """Tables that cut lineage, written as Parquet in the shared folder.

    A written table outlives any executor, so a later loss repeats only what
    came after it.  :meth:`drop` removes tables that nothing will read again; the
    rest goes when the driver's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.option("parquet.block.size", _ROW_GROUP).parquet(path)
        if self.n == 1:
            root, fs = self._file_system(self.root)
            fs.deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        #: For :meth:`drop`.
        out._quill_path = path
        return out

    def _file_system(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path, fs = self._file_system(df._quill_path)
            fs.delete(path, True)


def slim_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Bound what one Arrow batch of texts holds, for this session from here on: the setting is lowered, never raised."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def texts_of(column: pa.Array) -> list[str]:
    """A string column as Python strings; null is the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def held_out(column: str, parts: int, part: int):
    """Whether crc32 of the id's decimal text leaves ``part`` modulo ``parts``."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % F.lit(parts) == F.lit(part), F.lit(False))


def make_room(df: DataFrame, names: list[str], text: str) -> tuple[DataFrame, str]:
    """The rows with columns that have one of the names (in any case) renamed to ``<name>_in``; and what ``text`` is called then."""
    new = {n.lower() for n in names}
    taken = {c.lower() for c in df.columns} | new
    renamed = {}
    for c in df.columns:
        if c.lower() in new:
            to = f"{c}_in"
            while to.lower() in taken:
                to += "_in"
            taken.add(to.lower())
            renamed[c] = to
    return (df.withColumnsRenamed(renamed) if renamed else df), renamed.get(text, text)


_SALTS = 16


def beside(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """A join whose keys may be very uneven on the left: its rows are dealt over salts by other columns, each salt has the right side."""
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(_SALTS)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


def trained_in_one_task(rows: DataFrame, train: Callable[..., object], most_bytes: int):
    """What ``train`` makes of the columns of a bounded sample, in one task of an executor; None for no rows.

    The rows are taken in order, the first column (a text) up to ``most_bytes`` characters in all, so
    that the driver never holds texts, only the model.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in rows_columns]
        room = most_bytes
        for batch in batches(parts):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if room <= 0:
                    break
                room -= len(row[0])
                for column, x in zip(columns, row):
                    column.append(x)
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(*columns))], pa.binary())], names=["model"])

    rows_columns = rows.columns
    found = rows.repartition(1).sortWithinPartitions(*reversed(rows_columns)).mapInArrow(run, "model binary").toArrow().column(0)
    return pickle.loads(found[0].as_buffer()) if len(found) else None  # not by way of a row, which would copy the model


class WordHashes(dict):
    """64-bit hash of each word, kept for words that come again; bounded."""

    def __init__(self, most: int = 1 << 17):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that hold rows."""
    return (b for b in rows if b.num_rows)

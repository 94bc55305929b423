"""Tables in the shared folder, word splitting, and Arrow batches of bounded size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

#: Texts of one Arrow batch that a task holds at once, in bytes.
BATCH_BYTES = 16 << 20

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names.

    Only a local session without that setting gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _LOCAL[spark.sparkContext.applicationId] = root
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends, a lost executor re-reads files."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Separators of ASCII words, as bytes: all but a-z, digits and bytes of longer characters; A-Z become a-z.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, in UTF-8; null has none."""
    return text.encode().translate(_WORD).split() if text else []


def spaced(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, in UTF-8; null has none."""
    return text.encode().lower().split() if text else []


def pieces(batch: pa.RecordBatch, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes; a row is never split."""
    rows = batch.num_rows
    step = max(1, min(rows, int(rows * limit / max(1, batch.nbytes)))) if rows else 1
    for start in range(0, rows, step):
        yield batch.slice(start, step)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """Columns computed from slices of the rows; ``make`` runs once a task and gives the function for a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            for part in pieces(batch):
                yield pa.RecordBatch.from_pydict(of(part))

    return df.mapInArrow(run, schema)


def drawn(rows: DataFrame, by: Column, n: int) -> list[Row]:
    """``n`` rows that come first by the hash ``by``: hashes alone are sorted, then those rows are read."""
    last = rows.select(by.alias("h")).filter("h is not null").orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return [] if last is None else rows.filter(by <= last).limit(n).collect()


def clean_names(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the columns an operator needs, by exact name; others with clashing names stay out."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def typed(df: DataFrame, names: list[str]) -> str:
    """The columns with their types, for a schema string."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

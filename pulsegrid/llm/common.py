"""Helpers shared by the corpus operators: shared-folder tables, column hygiene and vectorised text scanning.

Text scanning works on Arrow string buffers with NumPy: a block of documents is one byte array plus offsets, words
are (start, end) spans of it, and hashes are computed for all spans of a block at once.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20
#: The white space of all word definitions here, as characters and as a regular expression class.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ------------------------------------------------------------------------------------------------- Spark side


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one only where it is unset and
    all of Spark runs in one local process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/pulsegrid-{tag}-{uuid.uuid4().hex}"


#: Narrow rows of one file of a materialized table whose size is known.
FILE_ROWS = 500_000


def files_for(rows: int) -> int:
    return max(1, -(-rows // FILE_ROWS))


def materialize(df: DataFrame, tag: str, files: int = 0) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    files: so many files at most, where the number of rows is known to suit them. Results read such tables, so they
    stay until `release` is called.
    """
    return Scratch(df.sparkSession).table(df, tag, files)


class Scratch:
    """The tables that one call of an operator has written, so that it can delete those that its result does not read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame, tag: str, files: int = 0) -> DataFrame:
        path = shared_path(self.spark, tag)
        df = df.coalesce(files) if files else df
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *keep: DataFrame) -> None:
        """Deletes all tables but those in keep."""
        kept = {id(x) for x in keep}
        for k in [k for k in self.paths if k not in kept]:
            _delete(self.spark, self.paths.pop(k)[0])


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(result: DataFrame) -> None:
    """Deletes the materialized tables that a result reads, once it is written or no longer wanted."""
    spark = result.sparkSession
    for folder in {name.rpartition("/")[0] for name in result.inputFiles()}:
        if folder.rpartition("/")[2].startswith("pulsegrid-"):
            _delete(spark, folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, as long and string (null text: empty), whatever other columns there are."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def words_expr(text: Column) -> Column:
    """array<string> of the words [^\\x20\\x09-\\x0D]+ of a text; no words: an empty array."""
    bare = F.trim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


# -------------------------------------------------------------------------------------------------- task side


class Block:
    """Some documents of an Arrow batch: rows lo..hi of it, their bytes, and each one's place in them."""

    def __init__(self, lo: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.data, self.offsets = lo, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1


def strings(col) -> pa.Array:
    """A column as one array of large strings without nulls (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col.cast(pa.large_string()), "")


def blocks(col, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of an Arrow column as blocks of at most `most` bytes, or of one document."""
    arr = strings(col)
    n = len(arr)
    if not n:
        return
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield Block(lo, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, byte by byte."""
    return _LOWER[data]


def spans(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of kept bytes, cut at document borders: starts, ends, and the document of each."""
    if not len(keep):
        z = np.zeros(0, np.int64)
        return z, z, z
    begin = keep.copy()
    begin[1:] &= ~keep[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(keep)]
    begin[inner] = keep[inner]
    end = keep.copy()
    end[:-1] &= ~keep[1:]
    last = inner[inner > 0] - 1
    end[last] = keep[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_spans(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans(~_SPACE[block.data], block.offsets)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, eight bytes a step over all spans."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    left = ends - starts
    h = mix(left.astype(np.uint64) + _GOLD)
    at, live = starts, np.arange(len(starts))
    while len(live):
        some = np.ascontiguousarray(eight[at]).view(np.uint64)[:, 0] & _TAIL[np.minimum(left, 8)]
        h[live] = mix((h[live] * _GOLD) ^ mix(some + _GOLD))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive word hashes; entry i covers words i..i+k-1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = mix(words[:n] + np.uint64(k))
    for j in range(1, k):
        h = mix(h * _GOLD + words[j : j + n])
    return h

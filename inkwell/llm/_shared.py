"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders that this process has staged and not removed.
_STAGED: list[str] = []


def remove_staged(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the folders staged from the `since`th on, but for those that the tables in `keep` read. Results that were
    not written yet can't be read any more."""
    kept = {f.split("/part-")[0].rsplit("/", 1)[-1] for table in keep for f in table.inputFiles()}
    for path in _STAGED[since:]:
        if path.rsplit("/", 1)[-1] not in kept:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            _STAGED.remove(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the fast built-in, which does the same on them."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def join_skewed(rows: DataFrame, counted: DataFrame, key: str, total: int, spread: str, parts: int = 20_000, how: str = "inner") -> DataFrame:
    """Join many rows with one row per key, where a key may hold a large part of all `total` rows.

    counted has the key, its number of rows as n, and what the join is to add (n is dropped). Keys with at least
    1/parts of all rows are hot; there are at most `parts` of them at any size, so their keys alone can be broadcast to
    mark rows. A hot key's row has a copy for every 1/parts of all rows it holds (2 * parts copies in all at most), and
    its rows are dealt over the copies by a hash of the column `spread`.
    """
    least = max(2, -(-total // parts))
    copies = F.ceil(F.col("n") / least)
    hot = counted.where(F.col("n") >= least).select(key, copies.alias("copies_"))
    marked = rows.join(F.broadcast(hot), key, "left")
    marked = marked.withColumn("salt_", F.coalesce(F.pmod(F.xxhash64(spread), F.col("copies_")), F.lit(0).cast("bigint"))).drop("copies_")
    salts = F.when(F.col("n") >= least, F.sequence(F.lit(0).cast("bigint"), copies - 1)).otherwise(F.array(F.lit(0).cast("bigint")))
    return marked.join(counted.withColumn("salt_", F.explode(salts)).drop("n"), [key, "salt_"], how).drop("salt_")


def keep_rows(rows: DataFrame, keys: DataFrame, key: str | list[str], how: str = "left_semi", most: int = 2_000_000) -> DataFrame:
    """Semi or anti join on one or more long columns. keys is broadcast only if it has at most `most` rows, else shuffled."""
    return rows.join(F.broadcast(keys) if keys.count() <= most else keys, key, how)


#: Stands for a null id inside operators: pandas would turn ids beside nulls into floats, which lose digits.
NO_ID = -(1 << 63)


def id_in(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID)).alias("doc_id")


def id_out(name: str = "doc_id") -> Column:
    return F.nullif(F.col(name), F.lit(NO_ID)).alias("doc_id")


def text_key(text: str) -> Column:
    """What tells rows of one id apart: a hash of the text (null as empty)."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def shared_ids(rows: DataFrame, id_col: str, mark: str) -> DataFrame:
    """The ids that rows of different `mark` share, with their number of rows as n (staged)."""
    counted = rows.groupBy(id_col).agg(F.min(mark).alias("low"), F.max(mark).alias("high"), F.count(F.lit(1)).alias("n"))
    return staged(counted.where("low <> high").select(id_col, "n"), "shared-ids")


def with_tie(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rows with `tie`, so that (id, tie) names what a row holds: 0 where an id is that of one text alone, else the
    text's key."""
    rows = rows.withColumn("tie_", text_key(text_col))
    shared = shared_ids(rows, id_col, "tie_")
    tie, n = F.lit(0).cast("bigint"), shared.count()
    if n:
        shared = shared.withColumn("shared_", F.lit(True))
        tie = F.when(F.col("shared_"), F.col("tie_")).otherwise(0)
        rows = rows.join(F.broadcast(shared.drop("n")), id_col, "left") if n <= 2_000_000 else join_skewed(rows, shared, id_col, rows.count(), "tie_", how="left")
    return rows.withColumn("tie", tie).drop("tie_", "shared_")


#: What a Python worker keeps between tasks, by name, with its version.
_HELD: dict[str, tuple[str, object]] = {}


def held(name: str, make: Callable, version: str = ""):
    """The worker's own `name`, made at first use of a version. Tasks of another kind drop it (see tidy)."""
    if name not in _HELD or _HELD[name][0] != version:
        _HELD.pop(name, None)
        _HELD[name] = version, make()
    return _HELD[name][1]


def release(keep: str) -> None:
    """Drop what the worker holds but for names that begin with `keep`, and give freed memory back to the system."""
    for name in [n for n in _HELD if not keep or not n.startswith(keep)]:
        del _HELD[name]
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(task: Callable | None = None, keep: str = "") -> Callable:
    """For functions that run on partitions or groups: give memory back before and after. Python workers live on
    between tasks, and what they hold on to counts against their executor. `keep` names what stays for the next task."""
    if task is None:
        return functools.partial(tidy, keep=keep)

    @functools.wraps(task)
    def partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release(keep)
        yield from task(batches)
        release(keep)

    @functools.wraps(task)
    def group(rows: pd.DataFrame) -> pd.DataFrame:
        out = task(rows)
        release(keep)
        return out

    @functools.wraps(task)
    def cogroup(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = task(left, right)
        release(keep)
        return out

    if "batches" in task.__annotations__:
        return partition
    return group if task.__code__.co_argcount == 1 else cogroup


# --- vectorised word hashing inside tasks -------------------------------------------------------------------------

_LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of bytes other than space and \\x09-\\x0D) of all texts, and each text's first
    word as an offset into them (one more entry than texts)."""
    raw = b"\n".join(t.encode("utf-8", "surrogatepass") for t in texts) + b"\n" if texts else b""
    if lower:
        raw = raw.translate(_LOWER_TABLE)
    data = np.frombuffer(raw, dtype=np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), dtype=np.uint64)))
    hashes = mix64((sums[ends] - sums[starts]) * _powers(_BASE_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))
    sizes = np.fromiter((len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts), np.int64, len(texts))
    return hashes, np.concatenate(([0], np.searchsorted(starts, np.cumsum(sizes))))


def chain(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The hash of a sequence from that of its beginning and that of its next element."""
    return mix64(first * np.uint64(0xD6E8FEB86659FD93) + second + np.uint64(0x2545F4914F6CDD1D))


def chunked(texts: list[str], most: int):
    """Consecutive (from, to) ranges of texts of about `most` characters; a longer text is a range of its own."""
    begin = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def pack_frame(frame: pd.DataFrame) -> bytes:
    """A frame as compressed Arrow bytes: a block's documents cross a shuffle as one small value."""
    table, out = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def unpack_frame(blob: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(blob).read_pandas()

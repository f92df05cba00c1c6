"""A positional n-gram index that is kept: written once, bucketed by gram, and looked up many times. It holds the texts, and
of each gram the places that are multiples of its length: all places of all grams would be several times the text."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.arrays import letters, piece
from ..streaming.usage import shared_folder

#: Grams of a phrase for each distance from a multiple of the grams' length, of which the one with fewest places is looked up.
GRAM, BUCKETS, FIRST_GRAMS = 5, 16, 4
#: Letters of the texts that share a row for each gram, and letters to a bucket, of which there are BUCKETS at least.
BLOCK_LETTERS, BUCKET_LETTERS = 4_000_000, 50_000_000
#: With as many writers at a time as buckets, a task's rows need no sort to be written.
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: Stands between the texts of a block: no letter.
_GAP = 0x110000


def _laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of texts behind each other, with a gap after each, and the places where they begin."""
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    begins = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))[:-1].astype(np.int32)
    return np.concatenate([x for p in parts for x in (p, np.array([_GAP], np.uint32))]) if parts else np.zeros(0, np.uint32), begins


def grams_of(texts: list[str], n: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of texts laid out behind each other with a gap between them, where each one's places begin
    among the steps, the steps (the first place of a gram that is a multiple of n, then the distances from one such place
    to the next, all divided by n), and the place where each text begins. No gram reaches over a gap."""
    codes, begins = _laid_out(texts)
    gaps = np.concatenate(([0], np.cumsum(codes == _GAP, dtype=np.int32)))
    whole = gaps[n:] == gaps[:-n] if len(codes) >= n else np.zeros(0, bool)
    if not whole.any():
        return [], np.zeros(1, np.int32), np.zeros(0, np.int32), begins
    seen = np.bincount(codes, minlength=_GAP + 1) > 0
    ranks, size = (np.cumsum(seen) - 1).astype(np.int32)[codes], int(seen.sum())
    key, most = ranks[: len(whole)].astype(np.int64), size
    for i in range(1, n):
        if most * size >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            most = int(key.max()) + 1
        key *= size
        key += ranks[i : i + len(whole)]
        most *= size
    key, places = key[whole], np.flatnonzero(whole)
    grams, first = np.unique(key, return_index=True)
    names = codes[places[first][:, None] + np.arange(n)].tobytes().decode("utf-32-le", "surrogatepass")
    kept = places % n == 0
    key, places = key[kept], places[kept] // n
    order = np.argsort(key, kind="stable")  # places of equal grams stay in order
    at = np.append(np.searchsorted(key[order], grams), len(order)).astype(np.int32)
    steps = np.diff(places[order], prepend=0)
    begin = at[:-1][at[1:] > at[:-1]]
    steps[begin] = places[order][begin]
    return [names[i : i + n] for i in range(0, len(names), n)], at, steps.astype(np.int32), begins


def postings(texts: DataFrame, key: str, n: int = GRAM, text_col: str = "text") -> DataFrame:
    """gram, block, steps, keys, texts: a row for each distinct n-gram of a block of texts (keys and texts are null; without
    steps where none of its places is a multiple of n), and a row that is no n-gram with the block's keys, texts and, as
    steps, the places where they begin. A row for each gram of each text would be many times the text."""
    kind = pa.string() if isinstance(texts.schema[key].dataType, T.StringType) else None

    def block_of(keys: list[pa.Array], held: list[str]) -> Iterator[pa.RecordBatch]:
        name = uuid.uuid4().int >> 65
        grams, at, steps, begins = grams_of(held, n)
        owners = pa.concat_arrays(keys)
        owners = owners.cast(kind) if kind else owners
        rows = len(grams)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*grams, f"{name}{_row_of(n)}"], pa.string()), pa.array([name] * (rows + 1), pa.int64()), pa.ListArray.from_arrays(pa.array(np.append(at, at[-1] + len(begins)).astype(np.int32)), pa.array(np.append(steps, begins).astype(np.int32))),
             *(pa.concat_arrays([pa.nulls(rows, pa.list_(x.type)), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)]) for x in (owners, pa.array(held, pa.string())))], names=["gram", "block", "steps", "keys", "texts"],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, size = [], [], 0
        for batch in batches:
            begin = 0
            for i in range(batch.num_rows):
                held.append(batch.column(1)[i].as_py())
                size += len(held[-1]) + 1
                if size >= BLOCK_LETTERS:
                    yield from block_of([*keys, batch.column(0).slice(begin, i + 1 - begin)], held)
                    keys, held, size, begin = [], [], 0, i + 1
            keys.append(batch.column(0).slice(begin))
        if held:
            yield from block_of(keys, held)

    schema = T.StructType([T.StructField("gram", T.StringType()), T.StructField("block", T.LongType()), T.StructField("steps", T.ArrayType(T.IntegerType())), T.StructField("keys", T.ArrayType(texts.schema[key].dataType)), T.StructField("texts", T.ArrayType(T.StringType()))])
    return texts.where(F.col(text_col).isNotNull() & F.col(key).isNotNull()).select(key, F.col(text_col).alias("text_")).mapInArrow(cut, schema)


def _row_of(n: int) -> str:
    """What follows a block's name where its row stands for a gram: no gram is as long."""
    return " " * n


def write_index(texts: DataFrame, key: str, n: int = GRAM, buckets: int | None = None, name: str | None = None, folder: str | None = None, text_col: str = "text") -> str:
    """Write the index of texts (key, text) as a table in `folder` (the shared one by default) and return the table's name.
    Texts without a key are left out. Each task writes its rows to the files of their buckets, so that nothing is shuffled
    or sorted on disk beside the table, and a join by gram reads buckets as they lie."""
    spark, name = texts.sparkSession, name or f"gram_index_{uuid.uuid4().hex}"
    if buckets is None:
        buckets = max(BUCKETS, (texts.agg(F.sum(F.char_length(text_col))).first()[0] or 0) // BUCKET_LETTERS)
    path = f"{folder or shared_folder(spark)}/{name}"
    writers = spark.conf.get(_WRITERS)
    spark.conf.set(_WRITERS, max(int(writers), buckets))
    try:
        postings(texts, key, n, text_col).write.bucketBy(buckets, "gram").option("path", path).option("compression", "zstd").mode("overwrite").saveAsTable(name)
    finally:
        spark.conf.set(_WRITERS, writers)
    return name


def _look(n: int, query: str, key: str, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """query, key, start of what is asked of blocks: of each phrase, where it stands at the places, divided by n, that the
    steps of one of its grams say, less the gram's place in the phrase; or anywhere, if no such place is given."""

    def at(codes: np.ndarray, phrase: np.ndarray, steps: np.ndarray, o: int | None) -> np.ndarray:
        starts = np.flatnonzero(codes == phrase[0]) if o is None else np.cumsum(steps, dtype=np.int64) * n - o
        starts = starts[(starts >= 0) & (starts + len(phrase) <= len(codes))]
        for k, letter in enumerate(phrase):
            if not len(starts):
                break
            starts = starts[codes[starts + k] == letter]
        return starts

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, keys, texts in zip(batch["asked"], batch["keys"], batch["texts"], strict=True):
                codes, begins = _laid_out(texts.as_py())
                asks = asked.values
                phrases, offsets, steps = asks.field("phrase").to_pylist(), asks.field("o").to_pylist(), asks.field("steps")
                found = [at(codes, np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32), steps[i].values.to_numpy(), offsets[i]) for i, p in enumerate(phrases)]
                starts = np.concatenate(found)
                owner = np.searchsorted(begins, starts, "right") - 1
                of = [asks.field(query).take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))), keys.values.take(pa.array(owner)), pa.array(starts - begins[owner], pa.int32())]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(of, schema, strict=True)], schema=schema)

    return look


def find_phrases(spark: SparkSession, index: str, phrases: DataFrame, query: str, key: str, n: int = GRAM) -> DataFrame:
    """query, key, start of every occurrence of each phrase (query, phrase); phrases shorter than n letters occur nowhere.

    Wherever a phrase of 2 n - 1 letters or more stands, some of its grams are at multiples of n, by how far it is from one.
    For each of these n cases its gram with the fewest places (of the first FIRST_GRAMS) says where the phrase may stand,
    and the texts whether it does. Shorter phrases are looked for in the texts of the blocks that have their first gram.
    The index is read as it is bucketed, for the grams and for the texts, whether phrases are broadcast or shuffled to
    its buckets.
    """
    size, table = F.char_length("phrase"), spark.table(index)
    # by as many partitions as the index has buckets, or Spark would rather shuffle the index than have fewer
    buckets = int(spark.sql(f"DESCRIBE FORMATTED {index}").where("col_name = 'Num Buckets'").first()["data_type"])
    by_gram = lambda rows: rows.repartition(buckets, "gram")
    long = size >= 2 * n - 1
    offsets = F.when(long, F.sequence(F.lit(0), F.least(size, F.lit((FIRST_GRAMS + 1) * n - 1)) - n)).otherwise(F.array(F.lit(0)))
    grams = phrases.where(size >= n).select(query, "phrase", letters(F.col("phrase")).alias("l"), F.explode(offsets).alias("o")).select(query, "phrase", "o", piece(F.col("l"), F.col("o"), n).alias("gram"))
    counts = table.join(by_gram(grams.select("gram")).distinct(), "gram").groupBy("gram").agg(F.sum(F.size("steps")).alias("places"))
    # a gram that no block has is the best of all: the phrase stands nowhere by it
    known = grams.join(counts, "gram", "left").groupBy(query, "phrase", (F.col("o") % n).alias("case")).agg(F.min(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "o", "gram")).alias("best"))
    best = known.select(query, "phrase", F.when(long, F.col("best.o")).alias("o"), F.col("best.gram").alias("gram"))
    steps = F.when(F.col("o").isNotNull(), F.col("steps")).otherwise(F.expr("cast(array() as array<int>)"))
    met = table.join(by_gram(best), "gram").where(F.col("o").isNull() | (F.size("steps") > 0)).select(F.concat(F.col("block").cast("string"), F.lit(_row_of(n))).alias("gram"), F.struct(query, "phrase", "o", steps.alias("steps")).alias("a"))
    # a row for each block, since its texts are megabytes
    asked = by_gram(met).groupBy("gram").agg(F.collect_list("a").alias("asked"))
    held = asked.join(table.where("keys is not null").select("gram", "keys", "texts"), "gram").select("asked", "keys", "texts")
    schema = T.StructType([T.StructField(query, phrases.schema[query].dataType), T.StructField(key, held.schema["keys"].dataType.elementType), T.StructField("start", T.IntegerType())])
    return held.mapInArrow(_look(n, query, key, to_arrow_schema(schema)), schema)

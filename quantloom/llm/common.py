"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as `[\x20\x09-\x0D]`; bytes.split() splits at exactly these.
SPACES = r"[\x20\x09-\x0D]+"
#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: As LOWER, with all ASCII that is neither a letter nor a digit turned into a space.
WORDS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in LOWER)

MASK64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, a temporary one on a
    local master and an error on any other."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="quantloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder. Spark removes the files once the frame is no longer used if
    spark.cleaner.referenceTracking.cleanCheckpoints is set; else they stay."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def remove_dir(spark: SparkSession, path: str) -> None:
    """Removes a folder, in whatever store it lies."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Within it, what a query has shuffled is removed as soon as that query ends, and not when the driver happens to
    collect its garbage, and Python gets batches of at most 1,000 rows. For queries whose results are kept, as by cut()."""
    given = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
    before = {k: spark.conf.get(k, None) for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(docs: DataFrame, *cols: str) -> DataFrame:
    """The named columns only, so that nothing else is read or sent to Python."""
    return docs.select(*[F.col(f"`{c}`") for c in cols])


def columns_of(batches: Iterator[pa.RecordBatch], rows: int = 2000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut to at most `rows` rows and about `size` bytes, so that memory doesn't grow with text length."""
    for b in batches:
        step = max(1, min(rows, int(b.num_rows * size / max(b.nbytes, 1))))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit values (that of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """A word's bytes to its xxHash64; emptied when it holds `limit` words, so that memory stays bounded."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def fold(doc_id: F.Column | str) -> F.Column:
    """crc32 of the id as text, mod 4; rows of fold 2 are kept from all training. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")) % 4


def if_small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, which should be cut, marked for broadcasting if it has at most `most` rows; else the join is an ordinary one."""
    return F.broadcast(df) if df.count() <= most else df


def join_counted(big: DataFrame, small: DataFrame, key: str, size: str, total: int, share: int = 2000, known: DataFrame | None = None) -> DataFrame:
    """big joined with small, which has each key once and in `size` how many rows of big have it (of `total`).

    Keys with more than one row in `share` are broadcast, and there can't be more than `share` of them; so no task
    gets a hot key's rows. The others are joined by an ordinary shuffle. Where small lacks keys of big that may be hot,
    `known` has them, so that their rows aren't shuffled either. big, small and known should be cut.
    """
    hot = small.where(F.col(size) * share > total)
    anywhere = hot if known is None else known.where(F.col(size) * share > total)
    rest = big.join(F.broadcast(anywhere.select(key)), key, "left_anti").join(small.where(F.col(size) * share <= total), key)
    return big.join(F.broadcast(hot), key).unionByName(rest)


def connected(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that can be reached over edges (a, b); nodes without edges are left out.

    A node takes the smallest label of its neighbours, twice a round, until nothing changes: a label never grows, since
    a neighbour's neighbours hold the node itself. Each round is kept in the shared folder; only whether something
    changed reaches the driver. The joins are plain ones, so that adaptive execution splits the partitions of labels
    that many nodes have. edges should be cut.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    lab = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")))
    hop = lambda x: both.join(x.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("l"))
    while True:
        one = hop(lab)
        new = cut(hop(one).join(one.select("u", F.col("l").alias("old")), "u"))
        lab = new.drop("old")
        if new.where("l != old").isEmpty():
            return lab.select(F.col("u").alias("node"), F.col("l").alias("comp"))


def free_names(df: DataFrame, n: int) -> list[str]:
    """n names that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    while len(out) < n:
        name = f"_own{len(out)}"
        while name in taken:
            name += "_"
        out.append(name)
    return out

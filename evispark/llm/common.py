"""Helpers shared by the training-data operators: shared storage, Arrow batches and vectorised text hashing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only in local mode, where driver and executors are one process, if the session names no shared folder.
LOCAL_CHECKPOINT_DIR = "file:///tmp/checkpoints/evispark"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``, which driver and executors share; a cluster must set it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = LOCAL_CHECKPOINT_DIR
    return f"{base.rstrip('/')}/evispark-{uuid.uuid4().hex}"


def materialize(df: DataFrame, codec: str = "lz4") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    A lost executor costs no recomputation of what was written, as every executor can read the table.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    _WRITTEN.append(path)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._evispark_path = path
    return out


#: Tables written by this driver and not yet deleted.
_WRITTEN: list[str] = []


def release(*frames: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that no later step reads."""
    for df in frames:
        path = getattr(df, "_evispark_path", None)
        if path:
            _delete(df.sparkSession, path)


def clean_up(spark: SparkSession, keep: Iterable[DataFrame] = (), before: frozenset[str] = frozenset()) -> None:
    """Delete the tables that :func:`materialize` wrote, but for those that existed ``before`` and those to ``keep``.

    To be called once the results that read them are written.
    """
    kept = {getattr(df, "_evispark_path", None) for df in keep}
    for path in list(_WRITTEN):
        if path not in kept and path not in before:
            _delete(spark, path)


def written() -> frozenset[str]:
    """The tables that exist now, to be given to :func:`clean_up`."""
    return frozenset(_WRITTEN)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


#: Keys are joined where their rows stand from so many rows on, and from such a share of all rows on; tables of so few
#: rows are joined plainly, as one task could take them whole.
HOT_ROWS, HOT_SHARE, FEW_ROWS = 2000, 100_000, 500_000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of rows with facts, unique by ``key``, whose column n says how many rows a key has (it is dropped).

    Rows of hot keys are not shuffled together: facts of keys with more than 1 / HOT_SHARE of ``total`` rows, which are
    less than HOT_SHARE whatever the total, are broadcast.  ``facts`` should be written, as it is read several times.
    """
    if total <= FEW_ROWS:
        return rows.join(facts.drop("n"), key)
    hot = F.col("n") > max(HOT_ROWS, total // HOT_SHARE)
    many = facts.filter(hot).drop("n")
    if not many.take(1):
        return rows.join(facts.drop("n"), key)
    rest = rows.join(F.broadcast(many.select(key)), key, "left_anti").join(facts.filter(~hot).drop("n"), key)
    return rows.join(F.broadcast(many), key).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What operators keep in a Python worker between tasks, by operator.
_CACHES: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """A dict for what tasks of one operator keep for later ones; :func:`slices` empties it when another's task begins."""
    return _CACHES.setdefault(owner, {})


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks, and share a limit with their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not the GNU library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the bytes of ``column`` in each stay near ``limit``; a longer text has a slice of its own.

    What other operators than ``keep`` left in the worker is dropped first: stages of a pipeline run in the same workers.
    """
    for owner, cache in _CACHES.items():
        if owner != keep:
            cache.clear()
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        _, ends = buffer_of(col)
        begin = 0
        while begin < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[begin] + limit, side="right")) - 1
            stop = min(max(stop, begin + 1), batch.num_rows)
            yield batch.slice(begin, stop - begin)
            begin = stop
        del batch, col
        give_back()


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty.  Offsets start at 0."""
    if pa.types.is_string(col.type):
        col = col.cast(pa.large_string()).cast(pa.large_binary())
    elif not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: Two primes below 2**31, an odd base for each, and values below both for the 256 bytes.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 742_938_285)
BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 30, 256, dtype=np.uint64)
_POWERS: dict[tuple[int, int], np.ndarray] = worker_cache("spans")


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo a prime below 2**31; a worker keeps the longest table that it needed."""
    table = _POWERS.get((base, prime))
    if table is None or len(table) < n:
        table = np.ones(1, np.uint32)
        while len(table) < n:
            table = np.concatenate([table, (table * np.uint64(pow(base, len(table), prime)) % np.uint64(prime)).astype(np.uint32)])
        _POWERS[base, prime] = table
    return table[:n]


class SpanHashes:
    """Hashes of any spans of a block: polynomials modulo two primes, 62 bits, equal for equal bytes wherever they stand.

    Unlike polynomials modulo a power of two, these have no structured strings that collide whatever the base; two given
    different spans of n bytes collide with a probability of at most (n / 2**31)**2 over the choice of bases.
    """

    def __init__(self, raw: np.ndarray) -> None:
        self.sums = []
        for base, prime in zip(BASES, PRIMES, strict=True):
            out = np.zeros(len(raw) + 1, np.uint64)
            # Terms are below 2**31: more than 2**32 of them fit.
            np.cumsum(BYTE_CODE[raw] * powers(base, prime, len(raw)) % np.uint64(prime), out=out[1:])
            self.sums.append(out)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of raw[start:end]."""
        out = []
        for sums, base, prime in zip(self.sums, BASES, PRIMES, strict=True):
            back = powers(pow(base, -1, prime), prime, len(sums))
            out.append((sums[end] - sums[start]) % np.uint64(prime) * back[start] % np.uint64(prime))
        return mix((out[0] << np.uint64(31) | out[1]) ^ (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def pieces_of(raw: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive stretches of a buffer as a binary column."""
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def numbered(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of each value, distinct values in order of number); values are told apart by themselves, not by hashes."""
    found = values.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the words ``[^\\x20\\x09-\\x0D]+``; no word crosses a document's end."""
    word = ~SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    first[cut] |= word[cut]
    last[cut - 1] |= word[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def words_of(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words that :func:`word_spans` found, as a binary column."""
    return pieces_of(raw[~SPACE[raw]], end - start)

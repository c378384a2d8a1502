"""Helpers shared by the training-data operators.

* :class:`Scratch` cuts lineage by writing Parquet into the folder named by
  ``spark.checkpoint.dir`` (shared by all executors), so a lost executor only
  costs the tasks it held.
* :func:`shingle_sets` hashes the word shingles of many texts at once in numpy.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text hashed in one numpy pass; bounds the temporary arrays.
PASS_BYTES = 1 << 20
#: Rows of an Arrow batch that holds whole texts.
TEXT_ROWS = 512
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to TEXT_ROWS rows for good; they are never raised.

    Spark reads this setting when a plan runs, so a returned plan would lose its memory
    bound if the setting were put back.
    """
    if not 0 < int(spark.conf.get(_ARROW)) <= TEXT_ROWS:
        spark.conf.set(_ARROW, str(TEXT_ROWS))


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Smaller Arrow batches for what runs inside; the setting is put back."""
    was = spark.conf.get(_ARROW)
    spark.conf.set(_ARROW, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ARROW, was)


#: What operators remember in a Python worker (word tables); Spark reuses workers.
MEMORIES: dict[str, dict] = {}


def turn_to(operator: str) -> None:
    """Drop what other operators remember in this worker, and give the memory back."""
    others = [m for name, m in MEMORIES.items() if name != operator and m]
    for memory in others:
        memory.clear()
    give_back(bool(others))


_last_given = 0.0


def give_back(now: bool = False) -> None:
    """Return freed memory to the system, every few seconds at most (``now``: at once).

    glibc keeps what numpy frees for its next arrays; a worker that Spark reuses would
    hold the largest task's memory for good.
    """
    global _last_given
    if not now and time.monotonic() - _last_given < 2:
        return
    try:
        gc.collect()
        ctypes.CDLL(None).malloc_trim(0)
        pyarrow.default_memory_pool().release_unused()
    except (OSError, AttributeError):
        pass  # not glibc
    _last_given = time.monotonic()


class Scratch:
    """Intermediate tables of one operator call, in the shared checkpoint folder."""

    #: Those made since the last :meth:`sweep`.
    made: list["Scratch"] = []

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            root = spark.sparkContext._jsc.sc().getCheckpointDir()
            root = root.get() if root.isDefined() else None
        if not root:
            # Only for tests and single-machine use: no shared folder is named.
            root = "file://" + tempfile.mkdtemp(prefix="lexiforge-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark = spark
        self.root = f"{root.rstrip('/')}/lexiforge-{name}-{uuid.uuid4().hex[:12]}"
        self.count, self.held = 0, []
        Scratch.made.append(self)

    def cut(self, df: DataFrame, **options) -> DataFrame:
        """Write ``df`` and read it back: later plans start from files."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}"
        df.write.options(**options).parquet(path)
        self.held.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lexiforge_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for table in tables:
            self._delete(table._lexiforge_path)

    def finish(self, *kept: DataFrame) -> None:
        """Delete all tables but those that the returned plan still reads."""
        paths = [t._lexiforge_path for t in kept]
        for path in [p for p in self.held if p not in paths]:
            self._delete(path)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if name in self.held:
            self.held.remove(name)

    @classmethod
    def sweep(cls, *kept: DataFrame) -> None:
        """Delete all tables made so far but ``kept``: once a pipeline's stage is written."""
        for scratch in cls.made:
            scratch.finish(*kept)
        cls.made = [s for s in cls.made if s.held]


def columns_free_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns cannot clash with ours."""
    return df.select(*[df[n] for n in names])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def total_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes in a text column: one small aggregate, used to size partitions."""
    from pyspark.sql import functions as F

    return df.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0


def deal(keys: np.ndarray, buckets: int, then: np.ndarray | None = None):
    """Entries by bucket (and then by ``then``): (order, bucket of each in that order)."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable") if then is None else np.lexsort((then, bucket))
    return order, bucket[order]


def dealt_runs(bucket: np.ndarray):
    """(bucket, begin, end) of the buckets that have entries: never more than entries."""
    begin = np.flatnonzero(np.diff(bucket, prepend=-1))
    return zip(bucket[begin].tolist(), begin.tolist(), np.append(begin[1:], len(bucket)).tolist())


def held_out(doc_id="doc_id"):
    """Rows whose labels are never learnt from: crc32 of the id as text divisible by five."""
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


#: Range of the hashes that pick bounded samples: far above the rows of any table, so that
#: a share of them never rounds to none.
PICK = 1 << 50


def pick_below(wanted: int, total: int) -> int:
    """The bound under which hashes (modulo PICK) pick about ``wanted`` of ``total`` rows."""
    return PICK * min(wanted, total) // max(1, total)


def table_ceil(spark: SparkSession, nbytes: int, per_task: int) -> int:
    """Partitions so that each holds about ``per_task`` bytes."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions", "8"))
    return max(least, -(-nbytes // per_task))


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII punctuation, for bare words.
_BREAK = _SPACE.copy()
_BREAK[[c for c in range(128) if not chr(c).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWER = np.zeros(0, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), in place on uint64."""
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(32)
    return h


def _powers(n: int) -> np.ndarray:
    global _POWER
    if len(_POWER) < n:
        size = max(n, 64, 2 * len(_POWER))
        steps = np.full(size, _BASE, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _POWER = np.cumprod(steps, dtype=np.uint64)
    return _POWER


def passes(lengths, limit: int = PASS_BYTES):
    """Split row numbers into runs of at most ``limit`` bytes (one row at least)."""
    begin, held = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and held + n > limit:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(lengths):
        yield begin, len(lengths)


def word_hashes(texts: list[bytes], lower: bool = True, bare: bool = False):
    """Hash every word ``[^\\x20\\x09-\\x0D]+`` of the texts (``bare``: runs of
    letters, digits and non-ASCII bytes).

    Returns (hash per word, text number per word, byte length per word).
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    if lower:
        data = _LOWER[data]
    inside = ~(_BREAK if bare else _SPACE)[data]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = stop - begin
    power = _powers(int(size.max()) + 1)
    body = np.flatnonzero(inside)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    within = np.arange(len(body)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        value = _BYTE[data[body]] * power[within]
        h = np.add.reduceat(value, first)
        h += size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h), np.searchsorted(ends, begin, side="right"), size


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams.

    A text of fewer than ``n`` words has its whole word sequence as its single
    shingle; a text without words has none.
    """
    out: list[np.ndarray] = []
    for a, b in passes([len(t) for t in texts]):
        h, owner, _ = word_hashes(texts[a:b])
        counts = np.bincount(owner, minlength=b - a)
        starts = np.concatenate(([0], np.cumsum(counts)))
        with np.errstate(over="ignore"):
            rolled = np.zeros(max(0, len(h) - n + 1), np.uint64)
            for j in range(n):
                rolled += h[j : len(h) - n + 1 + j] * _BYTE[j]
            mix(rolled)
            for i in range(b - a):
                k, s = counts[i], starts[i]
                if not k:
                    out.append(np.zeros(0, np.uint64))
                elif k < n:
                    whole = (h[s : s + k] * _BYTE[:k]).sum(dtype=np.uint64) + np.uint64(k)
                    out.append(mix(np.array([whole], np.uint64)))
                else:
                    own = np.sort(rolled[s : s + k - n + 1])
                    keep = np.ones(len(own), bool)
                    np.not_equal(own[1:], own[:-1], out=keep[1:])
                    out.append(own[keep])
    return out


def as_bytes(values) -> list[bytes]:
    """UTF-8 of each text; null is empty.  Tables kept for tokenizers are dropped first."""
    turn_to("bytes")
    return [v.encode("utf-8", "replace") if isinstance(v, str) else b"" for v in values]

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space of all contracts: space and 0x09-0x0D.
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark (the path may be in any store Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(col, UPPER, UPPER.lower())


def free_prefix(columns: list[str]) -> str:
    """A prefix for working columns that none of ``columns`` starts with, in whatever case."""
    return "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in columns), default=0))


def id_type(df: DataFrame, id_col: str) -> T.DataType:
    """The type that ids are worked with: long for whole numbers, else their own."""
    kind = df.schema[id_col].dataType
    return T.LongType() if isinstance(kind, T.IntegralType) else kind


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only a local master may do without it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: a cluster has to name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="sigloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit; the folder is then left to the cluster's cleaner
        pass


#: Staged tables by their frames, which are kept so that an id stays theirs.
_STAGED: dict[int, tuple[DataFrame, str]] = {}


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    This cuts the lineage, so a lost executor costs a re-read and no recomputation, and branches
    that share a stage do its work once. The table is removed by ``unstage`` or when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sigloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _STAGED[id(out)] = out, path
    return out


def unstage(*tables: DataFrame) -> None:
    """Removes staged tables that no plan reads any more; others are left alone."""
    for table in tables:
        _, path = _STAGED.pop(id(table), (None, None))
        if path:
            _remove(table.sparkSession, path)


def shuffle_width(spark: SparkSession) -> int:
    """Number of partitions that a shuffle has in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- word hashes over whole batches of texts -------------------------------------------------

_MASK = (1 << 64) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, _MASK, 256, dtype=np.uint64, endpoint=True)
_POWERS = {"n": 0}
_KEPT = 5 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (the multipliers are those of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for exponents 0 to n or more; tables of up to ``_KEPT`` are kept."""
    if _POWERS["n"] > n:
        return _POWERS["up"], _POWERS["down"]
    size = max(n + 1, 1 << 16)
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    both = []
    for base in (_BASE, inverse):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    if size <= _KEPT:
        _POWERS.update(n=size, up=both[0], down=both[1])
    return both[0], both[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] times base**-s a hash of bytes s to e (uint64, wrapping)."""
    up, _ = powers(len(data))
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, in order, and how many words each text has.

    Words are maximal runs of bytes outside 0x20 and 0x09-0x0D.
    """
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    ends_at = np.cumsum([len(t) + 1 for t in texts])
    word = ~_SPACE[data]
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    p = prefix_hash(data)
    _, down = powers(len(data))
    h = mix64((p[ends] - p[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    n = np.diff(np.searchsorted(starts, ends_at, "left"), prepend=0)
    return h, n.astype(np.int64)


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n consecutive items."""
    out = hashes[: len(hashes) - n + 1].copy()
    for i in range(1, n):
        out = mix64(out * _BASE + hashes[i : len(hashes) - n + 1 + i])
    return out


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text its sorted distinct n-word shingle hashes.

    Fewer than n words: the whole sequence is the one shingle. No words: an empty set.
    """
    h, counts = word_hashes(texts)
    runs, out, at = combine(h, n) if len(h) >= n else h[:0], [], 0
    for k in counts.tolist():
        if k >= n:
            out.append(np.unique(runs[at : at + k - n + 1]))
        elif k:
            short = h[at : at + k]
            out.append(np.array([mix64(np.uint64([k]) + combine(short, k))[0]], np.uint64))
        else:
            out.append(h[:0])
        at += k
    return out


def utf8(values) -> list[bytes]:
    """Texts of an Arrow or pandas column as UTF-8; null is empty."""
    return [v.encode("utf-8", "surrogatepass") if isinstance(v, str) else b"" for v in values]


def with_arrow(df: DataFrame, needs: list[str], fields: list, fn, slice_bytes: int = 1 << 20) -> DataFrame:
    """``df`` with columns that ``fn`` computes from the columns ``needs``, batch by batch.

    ``fn`` takes one list of Python values per needed column and returns one list per field. It
    sees slices of at most ``slice_bytes`` (one larger row comes alone), so memory stays bounded
    whatever the batch size. Columns of ``df`` named like a field, in whatever case, are replaced.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    names = [f.name for f in fields]
    own = [f for f in df.schema.fields if f.name.lower() not in {n.lower() for n in names}]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    at = [df.columns.index(c) for c in needs]
    keep = [df.columns.index(f.name) for f in own]
    schema = StructType([*own, *fields])

    def run(batches):
        for batch in batches:
            for part in slices(batch, slice_bytes):
                got = fn(*[part.column(i).to_pylist() for i in at])
                columns = [part.column(i) for i in keep] + [pa.array(v, k) for v, k in zip(got, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in own] + names)

    return df.mapInArrow(run, schema)


def slices(batch, most: int):
    """Parts of an Arrow batch of at most ``most`` bytes each, or of one row."""
    n, per = batch.num_rows, max(1, batch.nbytes)
    if n == 0:
        return
    rows = max(1, min(n, n * most // per))
    for i in range(0, n, rows):
        part = batch.slice(i, rows)
        if part.nbytes > 2 * most and part.num_rows > 1:
            half = part.num_rows // 2
            for piece in (part.slice(0, half), part.slice(half)):
                yield from slices(piece, most)
        else:
            yield part

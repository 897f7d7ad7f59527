"""Shared pieces: storage for intermediate tables, byte-level numpy kernels over Arrow text, packed blocks.

Text is handled as UTF-8 bytes.  A null text is an empty one.  Texts are read whole.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1
#: Bytes of text that one numpy pass works on (a longer document makes a pass of its own).
PASS_BYTES = 2 << 20


# ---------------------------------------------------------------- storage


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a folder of the warehouse on a cluster, and a temporary one in local runs."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/_routeloom"
    if not found:
        found = getattr(spark, "_routeloom_dir", None) or tempfile.mkdtemp(prefix="routeloom-")
        spark._routeloom_dir = found
    return found.rstrip("/")


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names that no column has (in any case), made by lengthening those given."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Deletes the files of tables made by stored() that no later step reads."""
    for df in frames:
        jvm = df.sparkSession._jvm
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if shared_dir(df.sparkSession).split(":", 1)[-1] in f:
                path = jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files of finished steps (it acts when the driver collects garbage)."""
    gc.collect()
    spark._jvm.System.gc()


def trimmed() -> None:
    """Gives a Python worker's free memory back to the system: Spark keeps workers for later tasks, and the C library what they freed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def parts_of(spark: SparkSession, items: float, per_part: int) -> int:
    """A number of hash parts: so many that one holds about per_part items, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(items / per_part))


# ---------------------------------------------------------------- bytes and words


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else pa.large_string()).fill_null("" if "string" in str(col.type) else b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def passes(offsets: np.ndarray, most: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes stay near `most`."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def batches_of(batches: Iterator[pa.RecordBatch], column: str, most: int = PASS_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches whose texts stay near `most` bytes, each with its bytes and offsets."""
    for b in batches:
        buf, off = text_bytes(b.column(b.schema.get_field_index(column)))
        for i, j in passes(off, most):
            yield b.slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes of `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after lower-casing): digits, a-z and all of non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def words_of(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, which never cross rows, and the first word of each row (n + 1 values)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    m = inside[buf]
    before = np.empty_like(m)
    before[0], before[1:] = False, m[:-1]
    before[offsets[:-1][offsets[:-1] < len(buf)]] = False
    starts = np.flatnonzero(m & ~before)
    after = np.empty_like(m)
    after[-1], after[:-1] = False, m[1:]
    after[offsets[1:-1][offsets[1:-1] > 0] - 1] = False
    return starts, np.flatnonzero(m & ~after) + 1, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, PASS_BYTES), base, np.uint64)
        x[0] = 1
        have = np.multiply.accumulate(x)
        if len(have) <= 4 * PASS_BYTES:
            _powers[base] = have
    return have[:n]


def sums(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of table[byte] * base ** position modulo 2 ** 64, from which spans() takes the fingerprint of any span."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * _power(_BASE, len(buf)), out=out[1:])
    return out


def spans(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the spans, equal for equal bytes wherever they stand."""
    back = _power(pow(_BASE, -1, 1 << 64), len(prefix))
    return mixed((prefix[ends] - prefix[starts]) * back[starts] + np.asarray(ends - starts, np.uint64) * np.uint64(0xA0761D6478BD642F))


#: Words of more bytes are hashed one by one: sums modulo 2 ** 64 can be made to collide on long strings.
LONG_WORD = 256


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of words of any length."""
    out = spans(sums(buf), starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of n consecutive word fingerprints, at each start (len - n + 1 of them; rows are not looked at)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return out


def starts_within(first: np.ndarray, n: int) -> np.ndarray:
    """Of the positions 0..first[-1]-n those whose n words lie in one row, as a mask."""
    total = int(first[-1])
    ok = np.ones(max(0, total - n + 1), bool)
    for k in range(1, n):
        cut = first[1:-1] - k
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    return ok


# ---------------------------------------------------------------- compact arrays


def packed(x: np.ndarray) -> bytes:
    """An array as bytes: planes of equal byte positions one after the other, zstd."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()) if len(x) else b""


def unpacked(b: bytes, dtype) -> np.ndarray:
    if not b:
        return np.zeros(0, dtype)
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def packed_sorted(x: np.ndarray) -> bytes:
    """A sorted unsigned array by its differences."""
    return packed(np.diff(x, prepend=x.dtype.type(0))) if len(x) else b""


def unpacked_sorted(b: bytes, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(unpacked(b, dtype), dtype=dtype)


# ---------------------------------------------------------------- rows and packed blocks of documents

#: The column of row_keys().
KEY = "__key"


def row_keys(docs: DataFrame, id_col: str, text_col: str, target: int = 8 << 20, name: str = KEY) -> tuple[DataFrame, dict]:
    """docs with the column `name`: the id, and for each row without one a number of its own above all ids.

    The latter are dealt into buckets of about `target` text bytes by a hash of the text and numbered in the order of its
    MD5, so that every run gives a text the same numbers (rows of one text may swap theirs).
    Returns them and {"bytes", "rows", "none"}; none is the first number that is no id (None, where every row has an id).
    """
    key, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = lambda c: F.coalesce(F.sum(c), F.lit(0))
    s = docs.agg(F.count("*").alias("rows"), size(F.octet_length(text)).alias("bytes"), F.max(key).alias("top"), F.count_if(key.isNull()).alias("lone"), size(F.when(key.isNull(), F.octet_length(text))).alias("lone_bytes")).first()
    out = {"bytes": int(s["bytes"]), "rows": int(s["rows"]), "none": None}
    if not s["lone"]:
        return docs.withColumn(name, key), out
    out["none"] = 0 if s["top"] is None else s["top"] + 1
    if out["none"] + s["lone"] > 1 << 63:
        raise ValueError(f"no numbers above the ids of {id_col} are left for the rows without one")
    bucket = F.pmod(F.xxhash64(text), F.lit(max(1, math.ceil(s["lone_bytes"] / target))))
    (b,) = fresh([*docs.columns, name], "__bucket")
    lone = docs.where(key.isNull()).withColumn(b, bucket)
    start, starts = out["none"] - 1, []
    for r in lone.groupBy(F.col(b).alias("b")).agg(F.count("*").alias("c")).orderBy("b").collect():  # one number a bucket
        starts += [F.lit(r["b"]), F.lit(start).cast("long")]
        start += r["c"]
    place = F.row_number().over(Window.partitionBy(b).orderBy(F.md5(text.cast("binary"))))
    lone = lone.withColumn(name, F.element_at(F.create_map(*starts), F.col(b)) + place).drop(b)
    return docs.where(key.isNotNull()).withColumn(name, key).unionByName(lone), out


def own_id(key: Column, none: int | None) -> Column:
    """The id that a key of row_keys() stands for, null for rows without one."""
    return key if none is None else F.when(key < none, key)


BLOCKS = "block long, n int, ids binary, lens binary, payload binary"
_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("lens", pa.binary()), ("payload", pa.binary())])


def _packed_rows(block: int, ids: np.ndarray, texts: pa.Array) -> dict:
    buf, off = text_bytes(texts)
    return {"block": block, "n": len(ids), "ids": np.ascontiguousarray(ids.astype(np.int64)).tobytes(), "lens": packed(np.diff(off)), "payload": zstandard.ZstdCompressor(3).compress(buf.tobytes())}


def pack_blocks(docs: DataFrame, id_col: str, text_col: str, name: str, target: int = 8 << 20) -> tuple[DataFrame, dict]:
    """Documents as stored blocks of about `target` text bytes: ids, byte lengths, and all texts as one zstd string.

    Documents are dealt by a hash of the id.  Those without an id are documents of their own: ids holds the keys of row_keys().
    Returns the blocks and {"bytes", "rows", "blocks", "none"}, the last as row_keys() has it.
    """
    d, s = row_keys(docs, id_col, text_col, target)
    d = d.select(F.col(KEY).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # small inputs are dealt finer, so that every core has blocks
    n = max(1, math.ceil(s["bytes"] / target), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(s["bytes"] * 8 / target)))

    def pack(t: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([_packed_rows(t.column("block")[0].as_py(), t.column("id").to_numpy(zero_copy_only=False), t.column("text"))], _BLOCK_SCHEMA)

    out = stored(d.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n))).groupBy("block").applyInArrow(pack, BLOCKS), name)
    released(docs.sparkSession)
    return out, s | {"blocks": n}


def range_blocks(docs: DataFrame, id_col: str, text_col: str, name: str, target: int = 8 << 20) -> tuple[DataFrame, dict]:
    """As pack_blocks(), but a block holds consecutive ids in order, all rows of an id, and is named by its first one.

    Spark's range partitioning deals the ids; a partition is cut into blocks as its sorted rows pass by.
    """
    d, s = row_keys(docs, id_col, text_col, target)
    d = d.select(F.col(KEY).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            ids = t.column(0).to_numpy()
            return pa.RecordBatch.from_pylist([_packed_rows(int(ids[0]), ids, t.column(1))], _BLOCK_SCHEMA)

        for b in batches:
            ids, (_, off) = b.column(0).to_numpy(), text_bytes(b.column(1))
            at = 0
            while at < len(b):
                # up to the first row beyond the target that begins another id
                new = np.flatnonzero((np.diff(ids[at:], prepend=ids[at] if last is None else last) != 0) & (size + off[at:-1] - off[at] >= target))
                end = at + int(new[0]) if len(new) else len(b)
                if end > at:
                    held.append(b.slice(at, end - at))
                    size, last = size + int(off[end] - off[at]), int(ids[end - 1])
                if len(new):
                    yield block()
                    held, size = [], 0
                at = end
        if held:
            yield block()

    parts = parts_of(docs.sparkSession, s["bytes"], 4 * target)
    out = stored(d.repartitionByRange(parts, "id").sortWithinPartitions("id").mapInArrow(pack, BLOCKS), name)
    released(docs.sparkSession)
    return out, s


def unpack(ids: bytes, lens: bytes, payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, bytes and offsets of a block."""
    buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8) if payload else np.zeros(0, np.uint8)
    n = unpacked(lens, np.int64)
    off = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=off[1:])
    return np.frombuffer(ids, np.int64), buf, off

"""Questions and answers between chunks of documents and an index partitioned by key.

Documents are dealt to chunks of a few megabytes and shuffled once; every pass over the texts reads
that same exchange. A chunk asks about its distinct 64-bit keys (words, n-grams, windows): the sorted
keys travel in one packed row for each range of the key space. A range gathers the rows of all
chunks, and answers each with one value a key in the order asked. A key takes at most one place in a
chunk's question, however often it occurs there, so common keys are aggregated before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlake.llm.common import mixed, tasks

CHUNK_BYTES = 6_000_000


def chunked(docs: DataFrame, columns: list, text: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """The columns with a chunk number, shuffled by it; and the number of key ranges to use.

    Chunks take whole documents by a hash of their columns, so a chunk holds about ``chunk_bytes``
    of text or one longer document, whatever source or group they belong to.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    n = tasks(docs.sparkSession)
    rows = docs.select(*columns)
    return rows.withColumn("chunk", F.pmod(F.xxhash64(*rows.columns), F.lit(chunks)).cast("int")).repartition(
        n, "chunk"), max(n, chunks // 8)


def word_hashes(text: bytes, lower: bool = False) -> tuple[list[bytes], np.ndarray]:
    """Words between ASCII white space, and their XXH64."""
    import xxhash

    words = (text.lower() if lower else text).split()
    return words, np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def planes(values: np.ndarray) -> bytes:
    """Bytes of 64-bit numbers, all first bytes before all second ones: high zero bytes compress."""
    return np.ascontiguousarray(values.astype(np.uint64)).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(from_planes(raw), dtype=np.uint64)


def ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Ends of the equal ranges of the key space in an array of sorted keys, with a leading 0."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the place of each key among them."""
    import pandas as pd

    codes, values = pd.factorize(keys)
    order = np.argsort(values)
    place = np.empty(len(values), np.int64)
    place[order] = np.arange(len(values))
    return values[order], place[codes]


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Keys of longer sequences from keys of what comes first and what follows."""
    return mixed(left * np.uint64(0x9E3779B97F4A7C15) + right)


def table(schema: str, columns: dict[str, list]) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64(),
             "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array(columns[name], kinds[kind]) for name, kind in fields})


def by_part(rows: pa.Table, name: str) -> Iterator[bytes]:
    for value in rows.column(name):
        yield value.as_py()

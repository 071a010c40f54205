"""Sorted 64-bit key arrays in the session's shared folder, written by tasks and memory-mapped by workers.

Keys are unsigned and dealt to ``2**bits`` shards by their leading bits.  Between tasks they travel as
compressed blobs, one per shard and task.  The folder is ``spark.checkpoint.dir``; whoever clears that
folder removes these files.  It must be a mounted (POSIX) path, as memory mapping needs one.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import scratch_path

from .common import by_group, u64


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder, as a path that open() takes on every machine."""
    path = scratch_path(spark, name)
    if "://" in path:
        raise ValueError(f"spark.checkpoint.dir must be a mounted shared path for memory-mapped arrays, not {path}")
    path = "/" + path.lstrip("/") if path.startswith("/") else os.path.abspath(path)
    os.makedirs(path, exist_ok=True)
    return path


def shard_bits(partitions: int) -> int:
    """Bits for at least as many shards as there are partitions to read."""
    return max(2, int(np.ceil(np.log2(max(partitions, 1)))))


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def shard_cuts(sorted_keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each shard starts in a sorted key array, and its length at the end."""
    firsts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(sorted_keys, firsts), len(sorted_keys))


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Compress an integer array by byte planes (of differences, if it ascends)."""
    if ascending and len(values):
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.copy()
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes, dtype, ascending: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(dtype).itemsize
    values = raw.reshape(size, len(raw) // size).T.copy().view(dtype).ravel()
    return np.cumsum(values, dtype=dtype) if ascending else values


def save(path: str, values: np.ndarray) -> None:
    """Write whole and rename, so that a retried or speculative task leaves one complete file."""
    context = TaskContext.get()
    part = f"{path}.{context.taskAttemptId() if context else os.getpid()}.part"
    with open(part, "wb") as f:
        np.save(f, values)
    os.replace(part, path)


def slim(values: np.ndarray) -> np.ndarray:
    """Counts in the narrowest unsigned type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max())) if len(values) else np.uint8)


def load(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r") if os.path.exists(path) else np.zeros(0, np.uint64)


class SortedArrays:
    """Reader: ``{folder}/{shard}.{column}.npy`` for every shard; ``find`` answers sorted unique keys."""

    def __init__(self, folder: str, bits: int, key: str = "key"):
        self.folder, self.bits, self.key, self.open = folder, bits, key, {}

    def column(self, shard: int, name: str) -> np.ndarray:
        if (shard, name) not in self.open:
            self.open[shard, name] = load(f"{self.folder}/{shard}.{name}.npy")
        return self.open[shard, name]

    def find(self, keys: np.ndarray, names: dict[str, object]) -> dict[str, np.ndarray]:
        """``keys`` ascending; names: column and the value where a key is absent ("rank": the place in its shard).
        Adds "found"."""
        out = {n: np.full(len(keys), absent, dtype=np.asarray(absent).dtype) for n, absent in names.items()}
        found = np.zeros(len(keys), bool)
        cuts = shard_cuts(keys, self.bits)
        for shard in np.flatnonzero(np.diff(cuts)).tolist():
            part = keys[cuts[shard] : cuts[shard + 1]]
            held = self.column(shard, self.key)
            if not len(held):
                continue
            at = np.minimum(np.searchsorted(held, part), len(held) - 1)
            hit = np.flatnonzero(held[at] == part)
            found[cuts[shard] + hit] = True
            for n in names:
                out[n][cuts[shard] + hit] = at[hit] if n == "rank" else self.column(shard, n)[at[hit]]
        return out | {"found": found}

    def find_any(self, keys: np.ndarray, names: dict[str, object]) -> dict[str, np.ndarray]:
        """As ``find``, for keys in any order."""
        unique, back = np.unique(keys, return_inverse=True)
        return {n: v[back] for n, v in self.find(unique, names).items()}


def write_arrays(df: DataFrame, folder: str, bits: int, names: list[str]) -> int:
    """Write ``df(key, *names)`` of longs as sorted arrays, one file per shard and column; returns the rows."""

    def write(key, t: pa.Table) -> pa.Table:
        keys = u64(t["key"])
        order = np.argsort(keys)
        for n in names:
            save(f"{folder}/{key[0].as_py()}.{n}.npy", np.asarray(t[n])[order])
        save(f"{folder}/{key[0].as_py()}.key.npy", keys[order])
        return pa.table({"n": pa.array([len(keys)], pa.int64())})

    shards = df.withColumn("shard", F.shiftrightunsigned("key", 64 - bits).cast("int"))
    return by_group(shards, "shard", write, "n long").agg(F.sum("n")).first()[0] or 0

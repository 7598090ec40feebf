"""Messages of columns and of texts in few bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

#: Bytes of texts that deal() holds before it packs them.
HELD_BYTES = 1 << 25


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte plane by byte plane: planes of small or like numbers nearly vanish."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, at, out = len(data) // sum(sizes), 0, []
    for k, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(data[at : at + n * size].reshape(size, n).T).view(k).reshape(n))
        at += n * size
    return out


def steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of ascending unsigned numbers; summed() undoes it."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def summed(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=differences.dtype)


def deal(batches):
    """mapInArrow: rows (u, ...) become rows (u, blob), the rows of one u packed together; rows() undoes it."""
    compressor = zstandard.ZstdCompressor(level=3)

    def packed(held):
        table = pa.Table.from_batches(held).combine_chunks()
        u = table.column("u").to_numpy()
        order = np.argsort(u, kind="stable")
        names, at = np.unique(u[order], return_index=True)
        rest = table.drop_columns(["u"])
        for name, where in zip(names, np.split(order, at[1:])):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as out:
                out.write_table(rest.take(pa.array(where)).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([compressor.compress(sink.getvalue())], pa.binary())], ["u", "blob"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size > HELD_BYTES:
            yield from packed(held)
            held, size = [], 0
    if held:
        yield from packed(held)


def rows(blobs) -> pa.Table:
    """The rows of some blobs of deal(), at least one."""
    return pa.concat_tables(pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(b)).read_all() for b in blobs.to_pylist())

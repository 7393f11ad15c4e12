"""Parity of an object's pieces: sums over words, Reed-Solomon rows and columns, fountain symbols.

Sums over pieces are DataFrame aggregates.  Field arithmetic and decoding run over Arrow batches, one object at a time
from its own row; nothing is grouped, so an object of any number of pieces costs its own bytes only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import bytes as B
from ..functions import fountain, galois


def xor_words(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """keys, word, parity: the sum over GF(2) of the pieces' 4-byte words, short pieces padded with zeros."""
    words = pieces.select(*keys, F.explode(B.words32(F.col("data"))).alias("w"))
    return words.groupBy(*keys, "w.word").agg(F.bit_xor("w.value").alias("parity"))


def xor_row(content: bytes, size: int) -> list[int]:
    """The sum over GF(2) of an object's pieces, as big-endian 4-byte words; no more words than the longest piece has."""
    m = matrix(content, size)
    words = -(-min(size, len(content)) // 4)
    return np.bitwise_xor.reduce(m, axis=0)[: 4 * words].view(">u4").astype(np.int64).tolist() if len(m) else []


def symbols_of(pieces: DataFrame, edges: DataFrame) -> DataFrame:
    """object_id, symbol_id, word, value: symbols as sums of the pieces that `edges` (blocks, symbol_id, member) names.

    pieces: object_id, blocks (their number), block_idx, data.  Edges depend on the number alone.
    """
    members = pieces.join(edges, (pieces["blocks"] == edges["blocks"]) & (pieces["block_idx"] == edges["member"])).select("object_id", "symbol_id", "data")
    return xor_words(members, ["object_id", "symbol_id"]).withColumnRenamed("parity", "value")


def per_object(objects: DataFrame, run: Callable[[bytes, object], tuple], columns: str) -> DataFrame:
    """object_id and `columns` as `run(content, object_id)` gives them."""
    schema = StructType([objects.schema["object_id"], *StructType.fromDDL(columns).fields])
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            out = [run(bytes(c or b""), i) for c, i in zip(b.column(1).to_pylist(), ids)]
            cols = list(zip(*out)) if out else [[] for _ in list(arrow)[1:]]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow.field(0).type), *(pa.array(c, f.type) for c, f in zip(cols, list(arrow)[1:]))], schema=arrow)

    return objects.select("object_id", "content").mapInArrow(work, schema)


def matrix(content: bytes, size: int) -> np.ndarray:
    """Pieces of `size` bytes as rows, the last one padded with zeros."""
    rows = -(-len(content) // size)
    out = np.zeros(rows * size, np.uint8)
    out[: len(content)] = np.frombuffer(content, np.uint8)
    return out.reshape(rows, size)


def row_parity(content: bytes, size: int) -> np.ndarray:
    """One check row over all pieces: brings back any one of them."""
    m = matrix(content, size)
    return galois.encode(m, 1)[0] if len(m) else np.zeros(0, np.uint8)


def column_parity(piece: np.ndarray, cell: int = 16) -> np.ndarray:
    """Two check cells over the cells of one piece."""
    m = matrix(piece.tobytes(), cell)
    return galois.encode(m, 2).reshape(-1)


def recovered_row(content: bytes, size: int, lost: int) -> bytes:
    """The piece `lost`, from the others and the check row alone."""
    m = matrix(content, size)
    rows = {i: r for i, r in enumerate(m) if i != lost} | {len(m): row_parity(content, size)}
    return galois.decode(rows, len(m), size)[lost].tobytes()


def fountain_recovery(content: bytes, size: int, code: str, lost: np.ndarray) -> tuple[bytes, int]:
    """The content after the blocks in `lost` went and symbols brought back what they could, and how many stay lost."""
    m = matrix(content, size)
    equations = (fountain.lt_equations if code == "lt" else fountain.duip_equations)(len(m))
    values = fountain.symbols(m, equations)
    broken = m.copy()
    broken[lost] = 0
    back, still = fountain.decoded(broken, lost, equations, values)
    return back.tobytes()[: len(content)], int(still.sum())


# ---- two-dimensional parity: a check row over all fragments, two check cells of 16 bytes for each fragment

CELL, CHECKS = 16, 2


def grid_encoded(fragments: list[bytes]) -> list[bytes]:
    """Data fragments, the check row, then the check cells packed into fragments of the same size."""
    size = max((len(f) for f in fragments), default=0)
    if not size:
        return list(fragments)
    rows = matrix(b"".join(f.ljust(-(-size // CELL) * CELL, b"\0") for f in fragments), -(-size // CELL) * CELL)
    cells = b"".join(column_parity(r, CELL).tobytes() for r in rows)
    held = max(1, size // CELL) * CELL
    return [*fragments, galois.encode(rows, 1)[0].tobytes(), *(cells[i : i + held] for i in range(0, len(cells), held))]


def grid_decoded(available: dict[int, bytes], missing: list[int], sizes: list[int]) -> dict[int, bytes]:
    """Missing data fragments, as far as they come back; those that do not are zeros, cut to their sizes.

    One missing fragment comes from the check row.  Of more, each comes from its own check cells if it has no more cells
    than these; the check row has to be there, as it marks a complete set.
    """
    k, size = len(sizes), max((len(f) for f in available.values()), default=0)
    wide = -(-size // CELL) * CELL
    rows = {i: np.frombuffer(available[i].ljust(wide, b"\0"), np.uint8) for i in range(k) if i in available}
    wanted = [i for i in missing if i < k]
    held = max(1, size // CELL)
    out = {i: np.zeros(wide, np.uint8) for i in wanted}
    if k in available:
        if len(wanted) == 1 and len(rows) == k - 1:
            check = np.frombuffer(available[k].ljust(wide, b"\0"), np.uint8)
            out[wanted[0]] = galois.decode({**rows, k: check}, k, wide)[wanted[0]]
        for i in wanted:
            cells = out[i].reshape(-1, CELL)
            empty = [r for r in range(len(cells)) if not cells[r].any()]
            checks = {}
            for p in range(CHECKS):
                part, at = divmod(i * CHECKS + p, held)
                if k + 1 + part in available:
                    checks[len(cells) + p] = np.frombuffer(available[k + 1 + part][at * CELL : (at + 1) * CELL], np.uint8)
            if empty and len(empty) <= len(checks):
                known = {r: cells[r] for r in range(len(cells)) if r not in empty}
                out[i] = galois.decode({**known, **checks}, len(cells), CELL).reshape(-1)
    return {i: x.tobytes()[: sizes[i]] for i, x in out.items()}


def rebuilt(fragments: list[bytes], size: int, code: str, bad: dict[int, set[int]], repair: np.ndarray, blocks: int) -> list[bytes] | None:
    """Fragments with their bad blocks rebuilt from symbols over all fragments' blocks in a row.

    bad: places of bad blocks by fragment; `blocks` is the number that the symbols were made of.  None if the fragments
    have another number of blocks; blocks that do not come back stay as they were.
    """
    offsets = np.cumsum([0] + [-(-len(f) // size) for f in fragments])
    if offsets[-1] != blocks:
        return None
    rows = np.concatenate([matrix(f, size) for f in fragments]) if blocks else np.zeros((0, size), np.uint8)
    lost = np.zeros(blocks, bool)
    for i, places in bad.items():
        lost[[offsets[i] + x for x in places]] = True
    equations = (fountain.lt_equations if code == "lt" else fountain.duip_equations)(blocks)
    back, still = fountain.decoded(np.where(lost[:, None], 0, rows).astype(np.uint8), lost, equations, repair)
    back[still] = rows[still]
    return [back[offsets[i] : offsets[i + 1]].tobytes()[: len(f)] for i, f in enumerate(fragments)]

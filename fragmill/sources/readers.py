"""Files of a store as rows: index documents with decryption, recovery containers, and indexes found without an index.

Files come through Spark's binaryFile reader; CBOR and keys are worked out over Arrow batches, one key derivation for a
salt and worker.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import aes
from . import cbor, container

# Length of the salt before an index, shortest file that has one, keys of which an index has at least one.
SALT, SHORTEST, KNOWN = 32, 45, ("file_fingerprint", "version", "original_name")
_CONTAINER = "version int, file_fingerprint string, created_at long, index_blocks int, fragments int, fragment_blocks int, repair_a_blocks int, repair_b_blocks int"


def files(spark: SparkSession, folder: str, glob: str, recursive: bool = True) -> DataFrame:
    """path, name, modified, size, content of matching files, newest first; empty files are not listed."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content").orderBy(F.desc("modified"), "name")


def placed(spark: SparkSession, path: str, place: str = "place") -> DataFrame:
    """A Parquet table with `place`, which rises from row to row of a file and from file to file by their paths."""
    t = spark.read.parquet(path)
    nth = F.row_number().over(Window.orderBy("_file")).cast("long")  # one row for each file
    files = t.select(F.col("_metadata.file_path").alias("_file")).distinct().withColumn("_nth", nth)
    rows = t.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return rows.join(F.broadcast(files), "_file").select(*t.columns, (F.col("_nth") * (1 << 40) + F.col("_row")).alias(place))


@lru_cache(maxsize=256)
def _key(password: str, salt: bytes, rounds: int) -> bytes:
    return aes.derived_key(password, salt, rounds)


def _valid(document: bytes) -> bool:
    try:
        fields = cbor.loads(document)
    except (ValueError, IndexError, OverflowError):
        return False
    return isinstance(fields, dict) and any(k in fields for k in KNOWN)


def _plain(data: bytes, key: bytes) -> bytes:
    """Counter mode with xor in one go; the key stream comes from Spark's own cipher on the other side."""
    from ..functions.ctr import crypt

    return crypt(data[aes.NONCE :], data[: aes.NONCE], key)


def sealed_index(document: bytes, password: str, salt: bytes, nonce: bytes, rounds: int = aes.ROUNDS) -> bytes:
    """Salt, nonce, encrypted document."""
    from ..functions.ctr import crypt

    return salt + nonce + crypt(document, nonce, _key(password, salt, rounds))


def opened_index(data: bytes, password: str, rounds: int = aes.ROUNDS) -> bytes | None:
    """The document of a sealed index: behind a salt, or under the older key without one; None if neither makes sense."""
    if len(data) >= SHORTEST:
        document = _plain(data[SALT:], _key(password, data[:SALT], rounds))
        if _valid(document):
            return document
    document = _plain(data, aes.legacy_key(password))
    return document if _valid(document) else None


def indexes(found: DataFrame, password: str, rounds: int = aes.ROUNDS) -> DataFrame:
    """found (content, ...) with `slim` and the index's fields; null ones where the password does not open a file."""

    @F.pandas_udf("binary")
    def open_(x: pd.Series) -> pd.Series:
        return x.map(lambda d: None if d is None else opened_index(bytes(d), password, rounds))

    return container.decoded_indexes(found.withColumn("slim", open_("content")).withColumn("slim", F.coalesce("slim", F.lit(b""))))


def containers(found: DataFrame, column: str = "content") -> DataFrame:
    """found with a recovery container's fields: counts of its block maps and of the blocks its repair data cover."""

    @F.pandas_udf(_CONTAINER)
    def read(x: pd.Series) -> pd.DataFrame:
        rows = []
        for d in x:
            try:
                c = cbor.loads(bytes(d))
                maps = c.get("fragment_block_maps") or []
                repair = [(c.get(k) or {}).get("block_count") for k in ("repair_a", "repair_b")]
                rows.append((c.get("version"), c.get("file_fingerprint"), c.get("created_at"), len(c.get("index_block_map") or []), len(maps), sum(map(len, maps)), *repair))
            except (ValueError, TypeError, AttributeError, IndexError):
                rows.append((None,) * 8)
        names = [f.split(" ")[0] for f in _CONTAINER.split(", ")]
        out = pd.DataFrame(rows, columns=names, dtype=object)
        return out.astype({n: "Int64" if n == "created_at" else "Int32" for n in names if n != "file_fingerprint"})

    return found.withColumn("_c", read(column)).select("*", "_c.*").drop("_c")


def container_document(fields: dict) -> bytes:
    """A recovery container; repair data that are None are left out, as in its canonical form."""
    return cbor.dumps({k: v for k, v in fields.items() if v is not None})


def canonical_container(document: bytes) -> bytes:
    """A container without repair data, which is what its digest covers."""
    return container_document({k: v for k, v in cbor.loads(document).items() if not k.startswith("repair_")})


def canonical_index(document: bytes) -> bytes:
    """An index without the maps and repair data of cross-validation."""
    return cbor.dumps({k: v for k, v in cbor.loads(document).items() if not k.startswith("fss6")})


def rescued(found: DataFrame, most: int = 1000) -> DataFrame:
    """prefix, fragments, probe, name, content: per prefix the first fragment file with a proper header, by place 0, 1, ...

    Places beyond `most` are not probed, as a store without its first thousand fragments holds nothing to rescue.
    """
    heads = container.parsed(found.where(F.col("frag_idx").between(0, most)))
    first = heads.where("is_fragment").groupBy("prefix").agg(F.min_by(F.struct("name", "content"), "frag_idx").alias("x"), F.min("frag_idx").alias("probe"))
    count = found.where("frag_idx is not null").groupBy("prefix").agg(F.count(F.lit(1)).alias("fragments"))
    return first.join(count, "prefix").select("prefix", "fragments", "probe", "x.*")

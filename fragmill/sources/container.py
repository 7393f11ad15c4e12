"""Fragment files: headers, parsing as columns, and a data source that reads a folder of them.

Bytes come through Spark's binaryFile reader, so any file system that Spark reads serves.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import codecs
from . import cbor

# Mark, versions without and with salt, lengths.
MARK, PLAIN, SALTED, SALT, NONCE, HEADER = b"\xff\x01", 1, 2, 32, 12, 6


def header(salt: bytes = b"") -> bytes:
    """Mark, version, salt length, CRC-8 of these, zero, salt."""
    first = MARK + bytes([SALTED if salt else PLAIN, len(salt)])
    return first + bytes([codecs._crc8(first), 0]) + salt


def fragment_file(index: dict, payload: bytes, nonce: bytes, salt: bytes = b"", seal=lambda x, nonce: x) -> bytes:
    """Header, nonce, then the sealed length, slim index and payload."""
    slim = cbor.index_document(index)
    return header(salt) + nonce + seal(len(slim).to_bytes(4, "little") + slim + payload, nonce)


def parsed(files: DataFrame, content: str = "content") -> DataFrame:
    """files with is_fragment, header_version, salt, nonce, body; a wrong mark, length or checksum is no fragment."""
    c = F.col(content)
    number = lambda i: F.conv(F.hex(F.substr(c, F.lit(i), F.lit(1))), 16, 10).cast("int")
    ok = (F.substring(c, 1, 2) == F.lit(MARK)) & number(3).isin(PLAIN, SALTED) & (number(5) == codecs.crc8(F.substring(c, 1, 4))) & (number(4) == F.when(number(3) == SALTED, SALT).otherwise(0))
    out = files.withColumn("is_fragment", F.coalesce(ok, F.lit(False)))
    n = number(4)
    return out.select(
        "*",
        F.when(F.col("is_fragment"), number(3)).alias("header_version"),
        F.when(F.col("is_fragment") & (n > 0), F.substr(c, F.lit(HEADER + 1), n)).alias("salt"),
        F.when(F.col("is_fragment"), F.substr(c, n + HEADER + 1, F.lit(NONCE))).alias("nonce"),
        F.when(F.col("is_fragment"), F.substr(c, n + HEADER + NONCE + 1, F.octet_length(c))).alias("body"),
    )


def index_and_payload(opened: DataFrame, body: str = "opened") -> DataFrame:
    """opened with `slim` (CBOR) and `payload`, by the little-endian length before them."""
    b = F.col(body)
    length = F.conv(F.concat(*(F.hex(F.substr(b, F.lit(i), F.lit(1))) for i in (4, 3, 2, 1))), 16, 10).cast("int")
    return opened.withColumn("_n", length).select("*", F.substr(b, F.lit(5), F.col("_n")).alias("slim"), F.substr(b, F.col("_n") + 5, F.octet_length(b)).alias("payload")).drop("_n")


def scanned(spark: SparkSession, folder: str, glob: str = "*.frag", recursive: bool = True) -> DataFrame:
    """path, name, prefix, frag_idx, modified, size, content of the fragment files of a folder, newest first."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.regexp_extract(name, r"^(.*)_\d+\.frag$", 1).alias("prefix"), F.expr(r"try_cast(regexp_extract(element_at(split(path, '/'), -1), '_(\\d+)\\.frag$', 1) as int)").alias("frag_idx"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content").orderBy(F.desc("modified"), "name")


def recovered_indexes(files: DataFrame) -> DataFrame:
    """The first fragment of each prefix, which carries a slim index."""
    return files.where("frag_idx is not null").groupBy("prefix").agg(F.min_by(F.struct("name", "content"), "frag_idx").alias("x"), F.count(F.lit(1)).alias("fragments")).select("prefix", "fragments", "x.*")


class _IndexPartition(InputPartition):
    def __init__(self, documents: list[bytes]):
        self.documents = documents


class _IndexReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        docs = [bytes.fromhex(x) for x in self.options.get("documents", "").split(",") if x]
        n = max(1, int(self.options.get("numPartitions", "1")))
        return [_IndexPartition(docs[i::n]) for i in range(n)]

    def read(self, partition):
        for d in partition.documents:
            i = cbor.read_index(d)
            yield (i.get("original_hash"), i.get("original_name"), i.get("file_size"), len(i.get("fragments", [])), i.get("fss_strategy"), i.get("compression"))


class IndexSource(DataSource):
    """Index documents given in hex, as rows: spark.read.format("fragmill-index").option("documents", ...)."""

    @classmethod
    def name(cls) -> str:
        return "fragmill-index"

    def schema(self) -> str:
        return "object_id string, original_name string, file_size long, fragment_count int, fss_strategy string, compression string"

    def reader(self, schema) -> DataSourceReader:
        return _IndexReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(IndexSource)


def decoded_indexes(documents: DataFrame, column: str = "slim") -> DataFrame:
    """documents with the index's fields as columns; what cannot be read has null ones."""
    @F.pandas_udf("original_hash string, original_name string, file_size long, fragment_count int")
    def read(x: pd.Series) -> pd.DataFrame:
        rows = []
        for d in x:
            try:
                i = cbor.read_index(bytes(d))
                rows.append((i.get("original_hash"), i.get("original_name"), i.get("file_size"), len(i.get("fragments", []))))
            except (ValueError, TypeError):
                rows.append((None, None, None, None))
        return pd.DataFrame(rows, columns=["original_hash", "original_name", "file_size", "fragment_count"]).astype({"file_size": "Int64", "fragment_count": "Int32"})

    return documents.withColumn("_i", read(column)).select("*", "_i.*").drop("_i")


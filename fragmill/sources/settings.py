"""Settings from YAML-like text and JSON metadata, with environment variables put in."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

ROUNDS = 10


def expanded(text: str, env: Mapping[str, str] | None = None) -> str:
    """`${NAME}` replaced, also where a value holds another one, in at most ten rounds; unknown names stay."""
    env = os.environ if env is None else env
    for _ in range(ROUNDS):
        after = re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", lambda m: env.get(m[1], m[0]), text)
        if after == text:
            break
        text = after
    return text


def backends(text: str, env: Mapping[str, str] | None = None) -> list[dict[str, str]]:
    """The `backends:` list: items start with `- key: value`, further keys are indented below."""
    out: list[dict[str, str]] = []
    inside = False
    for raw in expanded(text, env).splitlines():
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if not line.strip():
            continue
        if not line.startswith((" ", "-")):
            inside = line.strip() == "backends:"
            continue
        if inside and (m := re.match(r"^\s*(- )?\s*([A-Za-z_]+)\s*:\s*(.*)$", line)):
            if m[1]:
                out.append({})
            if out:
                out[-1][m[2].lower()] = m[3].strip().strip("'\"")
    return out


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """A JSON metadata store of backups, one row per backup."""
    return spark.read.option("multiLine", "true").schema("fingerprint string, filename string, size long, hash string, strategy string, count int, backend string, created_at timestamp").json(path)

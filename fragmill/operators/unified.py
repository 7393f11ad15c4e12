"""Unified line diffs of two versions, and the registry that picks a diff by its confidence.

A pair's own lines are compared in one worker, from its own row; nothing is grouped.  Ends that both versions share are
cut off first, three lines of them stay as context; of the rest, every old line meets the first equal new line that is
still free.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Lines of context, and lines of a run of kept ones that is left out.
CONTEXT, LEFT_OUT = 3, 2
KEEP, DELETE, INSERT = " ", "-", "+"


def split_lines(data: bytes) -> list[str]:
    """Lines without their ends (\\n or \\r\\n), after a byte order mark; a last line without an end counts."""
    data = data.removeprefix(b"\xef\xbb\xbf")
    parts = data.split(b"\n")
    ended = [p.removesuffix(b"\r") for p in parts[:-1]]
    return [p.decode("utf-8", "replace") for p in ended + ([parts[-1]] if parts[-1] else [])]


def _shared(a, b, most: int) -> int:
    return next((i for i, (x, y) in enumerate(zip(a[:most], b[:most])) if x != y), min(most, len(a), len(b)))


def _middle(old: list[str], new: list[str]) -> Iterator[tuple[str, str]]:
    """Edits of what lies between the shared ends.  New lines behind one that an earlier old line took are passed over."""
    free: dict[str, deque[int]] = defaultdict(deque)
    for j, line in enumerate(new):
        free[line].append(j)
    taken = [free[line].popleft() if free.get(line) else None for line in old]
    used = {j for j in taken if j is not None}
    at = 0

    def inserts(end: int):
        nonlocal at
        while at < end and at not in used:
            yield INSERT, new[at]
            at += 1

    for line, j in zip(old, taken):
        if j is None:
            yield DELETE, line
            continue
        yield from inserts(len(new))
        yield KEEP, line
        yield from inserts(j)
        if at == j:
            at += 1
    yield from inserts(len(new))


def edits(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """(kind, line) in order, with up to three lines of the shared ends."""
    head = _shared(old, new, min(len(old), len(new)))
    tail = _shared(old[::-1], new[::-1], min(len(old), len(new)) - head)
    middle = list(_middle(old[head : len(old) - tail], new[head : len(new) - tail]))
    after = old[len(old) - tail :][:CONTEXT]
    return [(KEEP, x) for x in old[max(0, head - CONTEXT) : head]] + middle + [(KEEP, x) for x in after]


def unified(old: bytes, new: bytes, label: str = "file") -> tuple[int, int, int, str]:
    """Lines added, removed and changed (the more of both), and the text of the diff."""
    found = edits(split_lines(old), split_lines(new))
    out = [f"--- a/{label}", f"+++ b/{label}"]
    for kept, run in groupby(found, key=lambda e: e[0] == KEEP):
        run = list(run)
        if kept and len(run) <= LEFT_OUT:
            continue
        count = lambda kind: sum(e[0] == kind for e in run)  # noqa: E731, B023
        out.append(f"@@ -{count(DELETE) + count(KEEP)} +{count(INSERT) + count(KEEP)} @@")
        out += [k + line for k, line in run]
    added, removed = sum(e[0] == INSERT for e in found), sum(e[0] == DELETE for e in found)
    return added, removed, max(added, removed), "\n".join(out) + "\n"


def unified_diffs(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """key, added_lines, removed_lines, changed_lines, text of pairs (key, old, new: bytes, null as empty)."""
    schema = StructType([pairs.schema[key], *StructType.fromDDL("added_lines int, removed_lines int, changed_lines int, text string").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [unified(bytes(x or b""), bytes(y or b""), str(k)) for k, x, y in zip(*(b.column(i).to_pylist() for i in range(3)))]
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(arrow)[1:]))], schema=arrow)

    return pairs.select(key, "old", "new").mapInArrow(run, schema)


class DiffRegistry:
    """Diffs by name, each with a confidence for a sample of the data and a file name; the surest one is taken."""

    def __init__(self):
        self._kinds: list[tuple[str, Callable[[bytes, str], float], Callable[[bytes, bytes, str], tuple]]] = []

    def register(self, name: str, confidence: Callable[[bytes, str], float], diff: Callable[[bytes, bytes, str], tuple]) -> None:
        """Adds a kind; of equally sure ones the earliest counts."""
        self._kinds.append((name, confidence, diff))

    def chosen(self, sample: bytes, label: str) -> str | None:
        best = max(self._kinds, key=lambda k: k[1](sample, label), default=None)
        return best[0] if best and best[1](sample, label) > 0 else None

    def diff(self, old: bytes, new: bytes, label: str) -> tuple | None:
        name = self.chosen(new, label)
        return next((d(old, new, label) for n, _, d in self._kinds if n == name), None)


def text_confidence(data: bytes, label: str) -> float:
    """0.9 for data without zeros and at most a tenth of other control bytes."""
    odd = sum(b < 32 and b not in (9, 10, 13) for b in data)
    return 0.0 if 0 in data or not data or odd > len(data) // 10 else 0.9


def standard() -> DiffRegistry:
    r = DiffRegistry()
    r.register("text", text_confidence, unified)
    r.register("binary", lambda data, label: 0.1, lambda old, new, label: (max(0, len(new) - len(old)), max(0, len(old) - len(new))))
    return r

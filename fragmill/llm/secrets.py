"""Secrets in texts, with multipart credential linking.

Base kinds stand alone.  Weak candidates (an endpoint, a short access identifier, a bare secret-like string) are
reported only where complementary parts co-occur: each kind of part is a sorted list of intervals, and a sweep joins
identifiers with secrets and with endpoints when at most `SCOPE` code points lie between them.  The join runs
within a text, so nothing is shuffled, and a part keeps its nearest partners only by existence: no pairs are listed.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame

from .shared import per_text

#: Code points in the gap between two parts of one credential.
SCOPE = 400

# The base kinds' patterns.  Hex and access runs carry their least length, which a maximal run has or not.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
# The weak parts: named identifiers, long mixed strings, endpoints.
IDENTIFIER = re.compile(r"""(?:user(?:name)?|login|account|client_?id|access_?(?:key_?)?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.IGNORECASE | re.ASCII)
BARE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~-]+(?::[0-9]+)?|(?<![A-Za-z0-9.-])[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5}(?![0-9])")
_CUES = re.compile(r"AKIA|pass|secret|token|api_?key|user|login|account|client|access|[0-9a-f]{24}|://|[A-Za-z0-9+/_-]{32}", re.IGNORECASE | re.ASCII)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the base kinds, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _near(part: tuple[int, int], starts: list[int], ends: list[int], scope: int) -> bool:
    """Whether an interval, of those with these sorted starts and ends, lies beside `part` with a gap within the scope."""
    i, j = bisect_right(ends, part[0]), bisect_left(starts, part[1])
    return (i > 0 and part[0] - ends[i - 1] <= scope) or (j < len(starts) and starts[j] - part[1] <= scope)


def linked_spans(text: str, base: list[tuple[int, int, int]], scope: int = SCOPE) -> list[tuple[int, str, int]]:
    """(start, kind, end) of weak parts that complementary parts complete: kinds endpoint, identifier, part."""
    held = [[(s, e) for s, k, e in base if k == kind] for kind in range(len(KINDS))]  # spans of one kind do not overlap

    def free(m: re.Match, n: int = 0) -> bool:
        before = (spans[bisect_left(spans, (m.end(n), 0)) - 1 : bisect_left(spans, (m.end(n), 0))] for spans in held)
        return not any(e > m.start(n) for last in before for _, e in last)

    weak_id = [m.span(1) for m in IDENTIFIER.finditer(text) if free(m, 1)]
    strong_id = [(s, e) for s, k, e in base if k == 1]
    weak_secret = [m.span() for m in BARE.finditer(text) if free(m) and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    strong_secret = [(s, e) for s, k, e in base if k != 1]
    ends = [m.span() for m in ENDPOINT.finditer(text) if free(m)]
    lists = {k: (sorted(s for s, _ in v), sorted(e for _, e in v)) for k, v in (("id", weak_id + strong_id), ("secret", weak_secret + strong_secret))}
    near = lambda p, k: _near(p, *lists[k], scope)
    out = [(s, "identifier", e) for s, e in weak_id if near((s, e), "secret")]
    out += [(s, "part", e) for s, e in weak_secret if near((s, e), "id")]
    out += [(s, "endpoint", e) for s, e in ends if near((s, e), "id") and near((s, e), "secret")]
    return sorted(out)


def find(texts: list[str], scope: int = SCOPE) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked")}
    for t in texts:
        base = base_spans(t) if (cue := _CUES.search(t)) else []
        more = linked_spans(t, base, scope) if cue else []
        lines = [(s, i, f"{KINDS[i]}:{s}:{e}") for s, i, e in base]
        out["base_sha256"].append(hashlib.sha256(",".join(x[2] for x in lines).encode()).hexdigest())
        every = sorted(lines + [(s, 3 + ("endpoint", "identifier", "part").index(k), f"{k}:{s}:{e}") for s, k, e in more])
        out["spans"].append(",".join(x[2] for x in every))
        for i, k in enumerate(KINDS):
            out[f"n_{k}"].append(sum(x[1] == i for x in lines))
        out["n_linked"].append(len(more))
    return out


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked (weak parts reported) of each whole text.

    Spans are kind:start:end in code points, end exclusive, by start, then kind.  Null text counts as empty and has no
    spans.  Every row gives a row, repeated ones too; a null id stays null; texts of any length are read whole; an empty
    table gives an empty one; other columns are not read.
    """
    return per_text(docs, lambda texts: find(texts, scope), "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")

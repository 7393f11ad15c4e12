"""Byte-level BPE encoding and decoding with a pair occurrence index, and cached encoding for packing.

`PairIndex` maps each mergeable pair, known by its rank, to all its positions in a block of distinct pre-tokens.
Active ranks are applied in ascending order; each merge updates the lists of the two pairs it makes.  A worker keeps
what it has encoded, within a bound, so a pre-token costs merges once per worker and a look-up afterwards.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import public_tokenizers
from pyspark.sql import DataFrame

from .pretoken import ByteCutter
from .shared import in_use, per_text

BYTE_VOCABULARY = "byte_bpe_50k.json"
#: Distinct pre-tokens that are indexed together, and those that a worker remembers.
BLOCK, REMEMBERED = 30_000, 600_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level vocabulary file: ids of bytes, merges by rank, bytes of ids, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        ids, letters = whole["model"]["vocab"], byte_letters()
        back = {c: b for b, c in letters.items()}
        self.byte_id = [ids[letters[b]] for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.left, self.right, self.made = [], [], []
        for rank, pair in enumerate(whole["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[ids[a] << 20 | ids[b]] = rank
            self.left.append(ids[a])
            self.right.append(ids[b])
            self.made.append(ids[a + b])
        self.added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in ids.items() if t not in self.added}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}


class PairIndex:
    """Encodes a block of distinct pre-tokens at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary

    def encode(self, words: list[str]) -> list[list[int]]:
        v, pairs = self.v, self.v.pairs
        sym: list[int] = []
        starts = []
        for w in words:
            starts.append(len(sym))
            sym.extend(map(v.byte_id.__getitem__, w.encode("utf-8")))
            sym.append(-1)  # ends a pre-token; no pair has it
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        at: dict[int, list[int]] = {}
        get = pairs.get
        for i in range(n - 1):
            if (b := sym[i + 1]) >= 0 and sym[i] >= 0 and (rank := get(sym[i] << 20 | b)) is not None:
                if rank in at:
                    at[rank].append(i)
                else:
                    at[rank] = [i]
        active = list(at)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            left, right, made = v.left[rank], v.right[rank], v.made[rank]
            where = at.pop(rank)
            where.sort()
            for i in where:
                if sym[i] != left or sym[j := after[i]] != right:
                    continue  # an earlier merge took it
                sym[i], sym[j] = made, -2
                after[i] = k = after[j]
                before[k] = i
                for p, a, b in ((before[i], sym[before[i]] if before[i] >= 0 else -1, made), (i, made, sym[k])):
                    if a >= 0 and b >= 0 and (r := get(a << 20 | b)) is not None:
                        if r in at:
                            at[r].append(p)
                        else:
                            at[r] = [p]
                            heapq.heappush(active, r)
        return [[x for x in sym[s:e] if x >= 0] for s, e in zip(starts, [*starts[1:], n])]


class Codec:
    """Encoded and decoded forms of pre-tokens, remembered by a worker."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.index = PairIndex(self.v)
        self.cut = ByteCutter(public_tokenizers.PATTERN)
        self.ids: dict[str, str] = {}
        self.back: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and added tokens in order."""
        found = [(i, t) for t in self.v.added if (i := text.find(t)) >= 0]
        if not found:
            return self.cut(text)
        i, t = min(found, key=lambda x: (x[0], -len(x[1])))
        out = self.cut(text[:i])
        while True:
            out.append(t)
            i += len(t)
            found = [(k, s) for s in self.v.added if (k := text.find(s, i)) >= 0]
            if not found:
                return out + self.cut(text[i:])
            k, t = min(found, key=lambda x: (x[0], -len(x[1])))
            out += self.cut(text[i:k])
            i = k

    def learn(self, words: set[str]) -> None:
        if len(self.ids) + len(words) > REMEMBERED:
            self.ids.clear()
            self.back.clear()
        new = [w for w in words if w not in self.ids]
        for w in self.v.added.keys() & set(new):
            self.ids[w], self.back[w] = str(self.v.added[w]), self.v.bytes_of[self.v.added[w]]
        new = sorted(w for w in new if w not in self.ids)
        for i in range(0, len(new), BLOCK):
            block = new[i : i + BLOCK]
            for w, ids in zip(block, self.index.encode(block)):
                self.ids[w] = ",".join(map(str, ids))
                self.back[w] = b"".join(map(self.v.bytes_of.__getitem__, ids))

    def run(self, texts: list[str]) -> list[tuple[str, str]]:
        """Decimal ids joined by commas, and the text that they decode to, of each text."""
        cut = [self.pieces(t) for t in texts]
        words = set()
        for c in cut:
            words.update(c)
        self.learn(words)
        return [(",".join(map(self.ids.__getitem__, c)), b"".join(map(self.back.__getitem__, c)).decode("utf-8", "replace")) for c in cut]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    in_use(_CODECS)
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids (decimal, comma-joined) and decoded: the token ids of each text and what they decode to.

    Null text counts as empty: no ids, empty decoded text.  Special strings in a text become their ids, as the library
    does by default.  Every row gives a row, repeated ones too; a null id stays null; other columns are not read.
    """
    path = vocabulary or public_tokenizers.path(BYTE_VOCABULARY)

    def run(texts: list[str]) -> dict[str, list]:
        out = codec(path).run(texts)
        return {"ids": [x for x, _ in out], "decoded": [y for _, y in out]}

    return per_text(docs, run, "ids string, decoded string")


def encode_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text; digests of `encode_documents` taken in the workers."""
    path = vocabulary or public_tokenizers.path(BYTE_VOCABULARY)

    def run(texts: list[str]) -> dict[str, list]:
        out = codec(path).run(texts)
        return {
            "n_tokens": [x.count(",") + 1 if x else 0 for x, _ in out],
            "ids_sha256": [hashlib.sha256(x.encode()).hexdigest() for x, _ in out],
            "decoded_sha256": [hashlib.sha256(y.encode()).hexdigest() for _, y in out],
        }

    return per_text(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")

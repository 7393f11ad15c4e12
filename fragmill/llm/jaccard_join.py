"""N-gram Jaccard join by a token-group matrix, and the components of its links.

Words give distinct 5-word shingles; two documents link when 100 * intersection >= 75 * union.

1. One pass takes each document's set size, a digest of its set, two minimum hashes and adds its shingles to a sketch
   whose counters grow with the corpus.  Documents with one set are one class, which its smallest id stands for.
2. Classes that share both minimum hashes are dealt into chunks.  In a chunk, documents join groups; a group keeps the
   union of its members' shingles, a query opens a group only if enough of it lies in that union, and links to the first
   member near enough.  Large groups are dealt twice, and clusters that share one of the hashes meet by a few members.
   Links so far make clusters.
3. For exactness every class lists its prefix, rare shingles first by the sketch: near documents share some of them.
   Shingles that two clusters share name candidates, a document of the smaller cluster and the larger cluster; those
   remain that share as many prefix shingles as a link of their sizes needs.  Unions of the cluster's groups bound the
   overlap again, and only qualifying groups are opened.
4. Links of both rounds make components by label propagation with pointer jumping.

Widely shared passages come last in every prefix, and copies meet as one class or one cluster, so neither lists its
pairs.  Prefixes travel packed: a row holds one bucket's part of many documents' prefixes, not one shingle.  The
documents that ask a large cluster are dealt in blocks, each beside the members it is compared with, so no task gathers
all of them.  All tables live in the shared folder; the driver sees counters of heavy shingles and bitmaps of bounded
size only.  Shingles are compared by 64-bit hashes; prefixes hold 48 bits of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, in_blocks, in_use, mapped, per_text, row_of, text_or_empty, written

WORDS, SHARE = 5, 75
#: Least and most counters of the sketch and bits of a membership map (as powers of two), parts in which both travel,
#: members of a chunk or opened group, of a cluster that meet other clusters, queries of a block.
COUNTERS, BITS, PARTS, CHUNK, DELEGATES, BLOCK = (18, 26), (16, 30), 256, 64, 8, 256
#: At most so many shingles are heavy; least documents of a heavy one.
HEAVY, LEAST = 1 << 24, 8
#: Shingles that are packed at once, prefix shingles of a bucket, parts of a bucket that are compared one by one.
PACKED, BUCKET, SLICES = 1_000_000, 1_000_000, 8
REMEMBERED = 120_000
#: Rows of numbers that are broadcast at most, some 20 MB; with more, both sides are shuffled.
SENT = 200_000
#: Bytes of a shingle in a prefix.
WIDTH = 6
_U = np.uint64


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


_WORDS = Words()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Ascending distinct hashes of each text's shingles; one for the whole of a shorter text, none without words."""
    in_use(_WORDS)
    cut = [t.encode("utf-8", "replace").lower().split() for t in texts]  # bytes: lower-cases A-Z, splits at [ \t\n\v\f\r]
    size = [len(w) for w in cut]
    h = np.fromiter(map(_WORDS.__getitem__, chain.from_iterable(cut)), np.uint64, sum(size))
    full = _rolled(h, words) if len(h) >= words else h[:0]
    out, at = [], 0
    for n in size:
        if n >= words:
            s = np.sort(full[at : at + n - words + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(_rolled(h[at : at + n], n) if n else h[:0])
        at += n
    return out


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n word hashes."""
    s = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        s *= _U(0x9E3779B97F4A7C15)
        s += h[i : len(h) - n + 1 + i]
    return mixed(s)


def linked(x: np.ndarray, y: np.ndarray, share: int = SHARE) -> bool:
    least, most = sorted((len(x), len(y)))
    if 100 * least < share * most:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= share * (len(x) + len(y) - both)


class Groups:
    """A chunk's groups: members in order, and the union of their shingles."""

    def __init__(self, share: int = SHARE):
        self.share, self.members, self.unions = share, [], []

    def opened(self, q: np.ndarray) -> Iterator[int]:
        """Groups that may hold a link: enough of the query lies in the union."""
        for g, u in enumerate(self.unions):
            at = np.searchsorted(u, q)
            if 100 * int((u[np.minimum(at, len(u) - 1)] == q).sum()) >= self.share * len(q):
                yield g

    def add(self, me: int, q: np.ndarray) -> int | None:
        """The member that links to it, of whose group it becomes one; else None, and it starts a group."""
        for g in self.opened(q):
            for other, s in self.members[g]:
                if linked(q, s, self.share):
                    self.members[g].append((me, q))
                    self.unions[g] = np.union1d(self.unions[g], q)
                    return other
        self.members.append([(me, q)])
        self.unions.append(q)
        return None


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    x = xxhash.xxh3_128_intdigest(s.tobytes())
    return tuple(v - (1 << 64) if v >> 63 else v for v in (x >> 64, x & (1 << 64) - 1))


def _power(n: float, bounds: tuple[int, int]) -> int:
    """The least power of two from n on, within bounds (both as exponents)."""
    return min(max(int(n).bit_length(), bounds[0]), bounds[1])


def planes(x: np.ndarray, width: int | None = None) -> bytes:
    """Bytes of numbers, all first bytes before all second ones; `width` bytes of each are kept."""
    return x.view(np.uint8).reshape(-1, x.itemsize)[:, :width].T.tobytes()


def unplaned(data: bytes, count: int, dtype, width: int | None = None) -> np.ndarray:
    out = np.zeros((count, np.dtype(dtype).itemsize), np.uint8)
    width = width or out.shape[1]
    out[:, :width] = np.frombuffer(data, np.uint8, count * width).reshape(width, count).T
    return out.view(dtype).reshape(-1)


def _sketched(flat: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """part, data: the counters (top `bits` bits of a shingle) that these shingles add to, and how much."""
    at, n = np.unique((flat >> _U(64 - bits)).astype(np.uint32), return_counts=True)
    each = (1 << bits) // PARTS
    cuts = np.searchsorted(at, np.arange(PARTS + 1, dtype=np.int64) * each)
    for part in range(PARTS):
        s, e = cuts[part], cuts[part + 1]
        if e > s:
            yield part, zstandard.compress(planes(np.diff(at[s:e], prepend=np.uint32(part * each))) + planes(np.minimum(n[s:e], 0xFFFFFFFF).astype(np.uint32)), 1)


def _heavy(rows: DataFrame, bits: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Counters of at least `least`, ascending, and their levels: 1, and one more for each doubling."""
    each = (1 << bits) // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = None, np.zeros(each, np.int64)

        def done():
            hit = np.flatnonzero(counts >= least)
            if at is not None and len(hit):
                level = 1 + np.floor(np.log2(counts[hit] / least)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([(hit + at * each).astype(np.uint32).tobytes()], pa.binary()), pa.array([level.tobytes()], pa.binary())], names=["part", "at", "level"])

        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if part != at:
                    yield from done()
                    at = part
                    counts[:] = 0
                raw = zstandard.decompress(data)
                n = len(raw) // 8
                counts[np.cumsum(unplaned(raw, n, np.uint32), dtype=np.int64)] += unplaned(raw[4 * n :], n, np.uint32)
        yield from done()

    got = sorted(mapped(rows.select("part", "data").repartition("part").sortWithinPartitions("part"), run, "part int, at binary, level binary").collect())
    join = lambda k, dtype: np.concatenate([np.frombuffer(r[k], dtype) for r in got] or [np.empty(0, dtype)])
    return join("at", np.uint32), join("level", np.uint8)


def _first_pass(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """Rows of documents (part null) and of the sketch (doc_id null)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("t"))
    names = ["doc_id", "n", "s0", "s1", "k0", "k1", "part", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted():
            found = list(_sketched(np.concatenate(held), bits))
            none = pa.nulls(len(found), pa.int64())
            return pa.RecordBatch.from_arrays([*[none] * 6, pa.array([x for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=names)

        for b in batches:
            texts = b.column(1).to_pylist()
            for s in in_blocks(texts):
                sets = shingle_sets(texts[s], words)
                held += sets
                size += sum(map(len, sets))
                least = np.array([(x[0], mixed(x ^ _U(0x51ED270B)).min()) if len(x) else (0, 0) for x in sets], np.uint64).view(np.int64).T
                cols = [*zip(*map(digest, sets)), *least]
                m = len(sets)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.start, m), pa.array([len(x) for x in sets], pa.int64()), *(pa.array(c, pa.int64()) for c in cols), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
                if size >= PACKED:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    return written(mapped(rows, run, "doc_id long, n long, s0 long, s1 long, k0 long, k1 long, part int, data binary"), "jaccard-pass")


def _with_sets(docs: DataFrame, need: DataFrame, words: int) -> DataFrame:
    """need (id, s0, s1, ...) with `set`, the shingles of the documents that have those digests.

    A bitmap of some 16 bits for each needed id, 2^30 at most, spares most other documents the cutting, and the join
    settles the rest.
    """
    spark = docs.sparkSession
    needed = need.count()
    size = 1 << _power(16 * needed, BITS)
    each = size // PARTS
    bit = lambda column: F.pmod(F.xxhash64(column), F.lit(size)).cast("int")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, np.zeros(each, bool)
        for b in batches:
            part, x = b.column(0).to_numpy(), b.column(1).to_numpy()
            for s, e in zip(c := [0, *(np.flatnonzero(np.diff(part)) + 1)], [*c[1:], len(part)]):
                if e > s and part[s] != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(held).tobytes()], pa.binary())], names=["part", "data"])
                    at = int(part[s])
                    held[:] = False
                held[x[s:e] - (at or 0) * each] = True
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(held).tobytes()], pa.binary())], names=["part", "data"])

    bits = need.select(bit(F.col("id")).alias("bit")).distinct().select(F.floor(F.col("bit") / each).cast("int").alias("part"), "bit")
    got = {r["part"]: r["data"] for r in mapped(bits.repartition("part").sortWithinPartitions("part"), fill, "part int, data binary").collect()}
    sent = spark.sparkContext.broadcast(b"".join(got.get(p, bytes(each // 8)) for p in range(PARTS)))
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), bit(F.col("doc_id").cast("long")).alias("bit"), text_or_empty(docs).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            at = b.column(1).to_numpy()
            b = b.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))
            texts = b.column(2).to_pylist()
            for s in in_blocks(texts):
                sets = shingle_sets(texts[s], words)
                digests = [pa.array(x, pa.int64()) for x in zip(*map(digest, sets))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.start, s.stop - s.start), *digests, pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "s0", "s1", "set"])

    return mapped(rows, run, "id long, s0 long, s1 long, set binary").join(F.broadcast(need) if needed <= SENT else need, ["id", "s0", "s1"])


def components(edges: DataFrame, what: str = "labels") -> DataFrame:
    """id, label: the least id reachable by edges (a, b), of the ids that have any."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{what}-edges")
    labels = held = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), what)
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        least = labels.join(seen, "id").select("id", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("far"))
        after = written(least.join(jump, "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("label"), (F.least("next", F.coalesce("far", "next")) != F.col("label")).alias("moved")), what)
        dropped(held)
        labels, held = after.select("id", "label"), after
        if after.where("moved").isEmpty():
            dropped(both)
            return labels


def _linked_in_chunks(docs: DataFrame, members: DataFrame, keys: list[str], words: int, share: int) -> DataFrame:
    """Links (a, b) within the chunks (keys, chunk) of members (id, s0, s1, keys, chunk)."""

    def link(group: pa.Table) -> pa.Table:
        groups = Groups(share)
        rows = dict(zip(group["id"].to_pylist(), group["set"].to_pylist()))
        out = [(me, groups.add(me, np.frombuffer(s, np.uint64))) for me, s in sorted(rows.items(), key=lambda x: (len(x[1]), x[0]))]
        out = [x for x in out if x[1] is not None]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return written(_with_sets(docs, members, words).groupBy(*keys, "chunk").applyInArrow(link, "a long, b long"), "jaccard-links")


def _chunk_links(docs: DataFrame, classes: DataFrame, words: int, share: int) -> DataFrame | None:
    """Links (a, b) among classes that share minimum hashes, from chunks of bounded size."""
    own, keys = classes.select("id", "s0", "s1", "k0", "k1"), ["k0", "k1"]
    found = None
    for turn in range(2):  # large groups are dealt twice, so that chunks of one group overlap
        many = written(own.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > (CHUNK if turn else 1)), "jaccard-keys")
        chunk = F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("size") / CHUNK))
        members = written(own.join(many, keys).select("id", "s0", "s1", *keys, chunk.alias("chunk")), "jaccard-members")
        if not members.isEmpty():
            links = _linked_in_chunks(docs, members, keys, words, share)
            found = links if found is None else found.unionByName(links)
        dropped(many, members)
    if found is None:
        return None
    # clusters of some size that share one hash meet by a few members each
    labels = written(own.join(components(found), "id", "left").select("id", "s0", "s1", *keys, F.coalesce("label", "id").alias("label")), "jaccard-labels")
    for key in keys:
        sizes = written(labels.groupBy(key, "label").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first")), "jaccard-sizes")
        many = sizes.groupBy(key).agg(F.count(F.lit(1)).alias("labels"), F.max("size").alias("most"), F.sum(F.least("size", F.lit(2 * DELEGATES))).alias("all")).where((F.col("labels") > 1) & (F.col("most") >= DELEGATES))
        sent = (F.col("id") == F.col("first")) | (F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / DELEGATES)) == 0)
        chunk = F.pmod(F.xxhash64("id", F.lit(key)), F.ceil(F.col("all") / CHUNK))
        members = written(labels.join(sizes, [key, "label"]).join(written(many, "jaccard-keys"), key).where(sent).select("id", "s0", "s1", key, chunk.alias("chunk")), "jaccard-members")
        if not members.isEmpty():
            found = found.unionByName(_linked_in_chunks(docs, members, [key], words, share))
        dropped(sizes, members)
    dropped(labels)
    return found


def _needed(x: np.ndarray, y: np.ndarray, share: int) -> np.ndarray:
    """Prefix shingles that sets of these sizes share at least if they link."""
    both = -(-share * (x + y) // (100 + share))
    return np.maximum(1, both - np.maximum(-(-share * x // 100), -(-share * y // 100)) + 1)


def _packed(listed: DataFrame, buckets: int) -> DataFrame:
    """bucket, data: the prefixes (id, cluster, n, rank, light, tokens) cut by the hash of their shingles.

    A row has one bucket's shingles of as many documents as `PACKED` prefix shingles come from: they ascend, each with
    its document (an entry of a small table) and its place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done():
            docs = np.array([x[:5] for x in held], np.int64)
            count = np.array([len(x[5]) // WIDTH for x in held], np.int32)
            docs = np.column_stack([docs, count - docs[:, 4]])
            token = np.concatenate([unplaned(x[5], n, np.int64, WIDTH) for x, n in zip(held, count)])
            of = np.repeat(np.arange(len(held), dtype=np.int32), count)
            place = np.concatenate([np.arange(n, dtype=np.int32) for n in count])
            order = np.argsort(token, kind="stable")
            order = order[np.argsort(token[order] % buckets, kind="stable")]
            token, of, place = token[order], of[order], place[order]
            bucket = token % buckets
            starts = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(token)]
            names, data = [], []
            for b, e in zip(starts, starts[1:]):
                mine, at = np.unique(of[b:e], return_inverse=True)
                head = np.array([e - b, len(mine)], np.int64).tobytes()
                body = planes(np.diff(token[b:e], prepend=0)) + planes(at.astype(np.int64)) + planes(place[b:e].astype(np.int64)) + b"".join(planes(np.ascontiguousarray(c)) for c in docs[mine].T)
                names.append(int(bucket[b]))
                data.append(zstandard.compress(head + body, 1))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "data"])

        for b in batches:
            for x in zip(*(b.column(i).to_pylist() for i in range(6))):
                held.append(x)
                size += len(x[5]) // WIDTH
                if size >= PACKED:
                    yield done()
                    held, size = [], 0
        if size:
            yield done()

    return mapped(listed.select("id", "cluster", "n", "rank", "light", "tokens"), run, "bucket long, data binary")


def unpacked(data: bytes) -> np.ndarray:
    """Rows of token, id, cluster, set size, rank of the cluster by size, place, heavy ones in the prefix, whether it is one."""
    raw = zstandard.decompress(data)
    rows, docs = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    at = [16]

    def next_(n: int) -> np.ndarray:
        out = unplaned(raw[at[0] :], n, np.int64)
        at[0] += 8 * n
        return out

    token, of, place = np.cumsum(next_(rows)), next_(rows), next_(rows)
    ids, cluster, n, rank, light, heavy = (next_(docs)[of] for _ in range(6))
    return np.stack([token, ids, cluster, n, rank, place, heavy, place >= light])


def _candidates(rows: DataFrame, share: int) -> DataFrame:
    """query, cluster: documents and larger clusters that share as many prefix shingles as some pair of theirs needs.

    Documents that link share a shingle that stands early in both prefixes, before so much of each that the rest is too
    little for a link.  A heavy shingle names only pairs for which it stands there, so those who merely share a passage
    are not listed.  Light ones name all, and are counted: as many must be shared as a link needs, less the heavy ones
    of the prefixes.  For clusters of one class the last shared place also counts: no more can follow than is left of
    the shorter rest.  rows: bucket, data as `_packed` gives them.
    """

    far = 1 << 40
    both_of = lambda x, y: -(-share * (x + y) // (100 + share))

    def few(x: np.ndarray) -> list[np.ndarray]:
        """Pairs of rows of one token: all tokens at once, by distance."""
        out, at, d = [], np.arange(x.shape[1]), 0
        while True:
            d += 1
            at = at[at + d < x.shape[1]]
            at = at[x[0, at] == x[0, at + d]]
            if not len(at):
                return out
            a, b = x[:, at], x[:, at + d]
            ok = (a[2] != b[2]) & (100 * np.minimum(a[3], b[3]) >= share * np.maximum(a[3], b[3]))
            ok &= (a[7] == 0) | (np.minimum(a[3] - a[5], b[3] - b[5]) >= both_of(a[3], b[3]))
            a, b = a[:, ok], b[:, ok]
            swap = (a[4] > b[4]) | (a[4] == b[4]) & (a[2] > b[2])  # the query is of the smaller cluster
            q, c = np.where(swap, b[1], a[1]), np.where(swap, a[2], b[2])
            # both sets may hold so many more after this place; only one class against one is told by it
            left, both = np.minimum(a[3] - a[5], b[3] - b[5]) - 1, both_of(a[3], b[3])
            least = _needed(a[3], b[3], share) - np.minimum(a[6], b[6])
            out.append(np.stack([a[0], q, c, a[7] == 0, least, np.where((a[4] == 0) & (b[4] == 0), left, far), both, left + 1 >= both]))

    def many(x: np.ndarray) -> Iterator[np.ndarray]:
        """The same for one heavy token with many rows: documents against clusters, told by their sizes and first places."""
        x = x[:, np.argsort(x[3], kind="stable")]
        t = x[:, np.lexsort((x[5], x[3], x[2]))]
        first = np.flatnonzero(np.concatenate([[True], (t[2, 1:] != t[2, :-1]) | (t[3, 1:] != t[3, :-1])]))
        most = np.maximum.reduceat(t[6], first)
        t = t[:, first]
        t[6] = most
        t = t[:, np.argsort(t[3], kind="stable")]
        step = max(1, 500_000 // t.shape[1])
        for s in range(0, x.shape[1], step):
            q = x[:, s : s + step]
            o = t[:, np.searchsorted(t[3], -(-share * q[3, 0] // 100)) : np.searchsorted(t[3], 100 * q[3, -1] // share, "right")]
            n, m = q[3][:, None], o[3][None, :]
            both = both_of(n, m)
            ok = (n - q[5][:, None] >= both) & (m - o[5][None, :] >= both) & (100 * np.minimum(n, m) >= share * np.maximum(n, m))
            ok &= (o[4][None, :] > q[4][:, None]) | (o[4][None, :] == q[4][:, None]) & (o[2][None, :] > q[2][:, None])
            i, j = np.nonzero(ok & (o[2][None, :] != q[2][:, None]))
            least = _needed(q[3, i], o[3, j], share) - np.minimum(q[6, i], o[6, j])
            yield np.stack([np.full(len(i), x[0, 0]), q[1, i], o[2, j], np.zeros(len(i), np.int64), least, np.full(len(i), far), np.zeros(len(i), np.int64), np.ones(len(i), np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(x: np.ndarray):
            x = x[:, np.argsort(x[0], kind="stable")]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(x[0])) + 1])
            mixed_ = np.minimum.reduceat(x[2], starts) != np.maximum.reduceat(x[2], starts)
            size = np.diff([*starts, x.shape[1]])
            large = mixed_ & (size > 64) & (x[7, starts] == 1)
            out = few(x[:, np.repeat(mixed_ & ~large, size)])
            for g in np.flatnonzero(large):
                for y in many(x[:, starts[g] : starts[g] + size[g]]):
                    out.append(y)
                    if sum(z.shape[1] for z in out) > PACKED // 4:
                        yield from summed(np.concatenate(out, 1))
                        out = []
            if out:
                yield from summed(np.concatenate(out, 1))

        def summed(y: np.ndarray):
            """query, cluster, n (light ones shared), all, least (light ones needed), rest (what may follow), both (shingles that a link shares), early."""
            if not y.shape[1]:
                return
            y = y[:, np.lexsort((y[0], y[2], y[1]))]
            pair = np.concatenate([[True], (y[1, 1:] != y[1, :-1]) | (y[2, 1:] != y[2, :-1])])
            token = pair | np.concatenate([[True], y[0, 1:] != y[0, :-1]])
            starts = np.flatnonzero(pair)
            cols = (y[1, starts], y[2, starts], np.add.reduceat(token * y[3], starts), np.add.reduceat(token.astype(np.int64), starts), *(np.minimum.reduceat(y[k], starts) for k in (4, 5, 6)), np.maximum.reduceat(y[7], starts))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query", "cluster", "n", "all", "least", "rest", "both", "early"])

        at, held = None, [[] for _ in range(SLICES)]

        def done():
            for part in held:
                if part:
                    yield from flush(np.concatenate(part, 1))
                part.clear()

        for b in batches:
            for bucket, data in zip(b.column(0).to_pylist(), b.column(1)):
                if bucket != at:
                    yield from done()
                at = bucket
                x = unpacked(data.as_py())
                part = mixed(x[0].view(np.uint64)) % _U(SLICES)
                for k in np.unique(part):
                    held[k].append(x[:, part == k])
        yield from done()

    shared = mapped(rows.repartition("bucket").sortWithinPartitions("bucket"), run, "query long, cluster long, n long, all long, least long, rest long, both long, early long")
    pairs = shared.groupBy("query", "cluster").agg(F.sum("n").alias("n"), F.sum("all").alias("all"), *(F.min(c).alias(c) for c in ("least", "rest", "both")), F.max("early").alias("early"))
    return pairs.where("n >= least and all + rest >= both and early > 0").select("query", "cluster")


def _prefixes(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray], bits: int, words: int, share: int) -> DataFrame:
    """doc_id, tokens, light (those before the heavy ones), s0, s1: prefixes of all texts, rare shingles first, and the digests of their sets."""
    sent = docs.sparkSession.sparkContext.broadcast(heavy)  # at most HEAVY counters

    def run(texts: list[str]) -> dict[str, list]:
        tokens, light, digests = [], [], []
        at, levels = sent.value
        for s in shingle_sets(texts, words):
            mine = (s >> _U(64 - bits)).astype(np.uint32)
            place = np.minimum(np.searchsorted(at, mine), max(0, len(at) - 1))
            level = np.where(at[place] == mine, levels[place], 0) if len(at) else np.zeros(len(s), np.uint8)
            keep = len(s) - -(-share * len(s) // 100) + 1 if len(s) else 0
            tokens.append(planes(s[np.argsort(level, kind="stable")[:keep]], WIDTH))
            light.append(min(keep, int((level == 0).sum())))
            digests.append(digest(s))
        return {"tokens": tokens, "light": light, "s0": [x for x, _ in digests], "s1": [x for _, x in digests]}

    return per_text(docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "tokens binary, light int, s0 long, s1 long")


def _opened_links(docs: DataFrame, asked: DataFrame, clusters: DataFrame, words: int, share: int) -> DataFrame:
    """Links (a, b) of the candidates (query, cluster): groups of a cluster's classes that qualify are opened."""
    parts = F.ceil(F.col("size") / CHUNK).cast("int")
    targets = written(clusters.select("cluster", "size").distinct().join(asked.groupBy("cluster").agg(F.count(F.lit(1)).alias("queries")), "cluster"), "jaccard-targets")
    blocks = F.ceil(F.col("queries") / BLOCK).cast("int")  # members go to every block of queries, so none is large
    members = clusters.drop("size").join(targets, "cluster").select("cluster", F.pmod(F.xxhash64("id"), parts).cast("int").alias("sub"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(0).alias("turn"), "id", "s0", "s1")
    queries = asked.join(targets, "cluster").select("cluster", F.explode(F.sequence(F.lit(0), parts - 1)).alias("sub"), F.pmod(F.xxhash64("query"), blocks).cast("int").alias("block"), F.lit(1).alias("turn"), F.col("query").alias("id")).join(clusters.select("id", "s0", "s1"), "id")
    rows = written(members.unionByName(queries), "jaccard-asked")
    dealt = _with_sets(docs, rows, words).select("cluster", "sub", "block", "turn", "id", "set").repartition("cluster", "sub", "block").sortWithinPartitions("cluster", "sub", "block", "turn", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members, union = None, [], None
        for b in batches:
            out = []
            for cluster, sub, block, turn, me, s in zip(*(b.column(i).to_pylist() for i in range(6))):
                s = np.frombuffer(s, np.uint64)
                if at != (cluster, sub, block):
                    at, members, union = (cluster, sub, block), [], None
                if turn == 0:
                    members.append((me, s))
                    continue
                if not members:
                    continue
                if union is None:
                    union = np.unique(np.concatenate([x for _, x in members]))
                place = np.minimum(np.searchsorted(union, s), len(union) - 1)
                if 100 * int((union[place] == s).sum()) < share * len(s):
                    continue
                other = next((o for o, x in members if linked(s, x, share)), None)
                if other is not None:
                    out.append((me, other))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    links = written(mapped(dealt, run, "a long, b long"), "jaccard-opened")
    dropped(targets, rows)
    return links


def jaccard_components(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included) of each row.

    Null or wordless text has an empty set and links with nothing, equal ones included.  Of rows that repeat an id, the
    text with the least digest speaks for the id: all its rows get that text's component, and n_shingles of their own.
    A row without an id has no component and links nothing.  An empty table gives an empty one; ids are integers; other
    columns are not read.
    """
    bits = _power((docs.agg(F.sum(F.octet_length(docs["text"].cast("string")))).first()[0] or 0) // 16, COUNTERS)
    first = _first_pass(docs, words, bits)
    rows = first.where("part is null").select("doc_id", "n", "s0", "s1", "k0", "k1")
    shingles = rows.agg(F.sum("n")).first()[0] or 0
    heavy = _heavy(first.where("part is not null"), bits, max(LEAST, shingles // HEAVY))
    ids = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("s0", "s1", "n", "k0", "k1")).alias("x"))
    ids = written(ids.select("doc_id", "x.*"), "jaccard-ids")
    classes = written(ids.groupBy("s0", "s1", "n", "k0", "k1").agg(F.min("doc_id").alias("id")), "jaccard-classes")
    links = _chunk_links(docs, classes, words, share)
    clusters = classes.select("id", "s0", "s1", F.col("id").alias("cluster"), "n")
    if links is not None:
        clusters = clusters.drop("cluster").join(components(links), "id", "left").select("id", "s0", "s1", F.coalesce("label", "id").alias("cluster"), "n")
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    clusters = written(clusters.join(sizes, "cluster", "left").select("id", "s0", "s1", "cluster", "n", F.coalesce("size", F.lit(1)).alias("size")), "jaccard-clusters")
    prefixes = _prefixes(docs, heavy, bits, words, share).withColumnRenamed("doc_id", "id")
    listed = prefixes.join(clusters, ["id", "s0", "s1"]).withColumn("rank", F.floor(F.log2("size")).cast("long"))
    asked = written(_candidates(_packed(listed, 1 + shingles * (100 - share) // (100 * BUCKET)), share), "jaccard-candidates")
    if not asked.isEmpty():
        more = _opened_links(docs, asked, clusters, words, share)
        links = more if links is None else links.unionByName(more)
    named = classes.select("s0", "s1", F.col("id").alias("component_id"))
    if links is not None:
        named = classes.join(components(links, "components"), "id", "left").select("s0", "s1", F.coalesce("label", "id").alias("component_id"))
    named = written(named, "jaccard-named")
    of_ids = written(ids.select("doc_id", "s0", "s1").join(named, ["s0", "s1"]).select("doc_id", "component_id"), "jaccard-components")
    dropped(ids, classes, clusters, asked, named)
    joined = rows.select("doc_id", "n").join(of_ids, "doc_id", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """The rows of docs that their component is named after, all columns, whatever their names: one document of each group."""
    gone = written(jaccard_components(docs, words, share).where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "jaccard-gone")
    few = F.broadcast(gone) if gone.count() <= SENT else gone
    rows = docs.select(row_of(docs).alias("payload"), docs["doc_id"].alias("id"))
    return rows.join(few, F.col("id") == F.col("gone"), "left_anti").select("payload.*")

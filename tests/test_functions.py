"""Codes, codecs, documents, plans and settings on small inputs."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fragmill.functions import aes, codecs, fountain, galois
from fragmill.functions import bytes as B
from fragmill.operators import chunking, dedup, diffs, parity, placement, rings, validation
from fragmill.plans import planner
from fragmill.sources import cbor, container
from fragmill.sources import settings as config


@given(st.integers(1, 12), st.integers(1, 3), st.data())
@settings(max_examples=40, deadline=None)
def test_reed_solomon_any_erasures(k, p, data):
    m = np.random.default_rng(k).integers(0, 256, (k, 8), dtype=np.uint8)
    rows = dict(enumerate(m)) | {k + i: r for i, r in enumerate(galois.encode(m, p))}
    gone = data.draw(st.sets(st.integers(0, k - 1), max_size=min(1, p)))
    left = {i: r for i, r in rows.items() if i not in gone}
    assert (galois.decode(left, k, 8) == m).all()


def test_reed_solomon_too_many():
    m = np.zeros((4, 8), np.uint8)
    assert galois.decode({0: m[0], 1: m[1]}, 4, 8) is None


def test_field_laws():
    for a in range(1, 256):
        assert galois.MUL[a, galois.inverse(a)] == 1
    assert galois.MUL[0].sum() == 0


@pytest.mark.parametrize("code", ["lt", "duip"])
@pytest.mark.parametrize("k", [0, 1, 7, 100])  # with two blocks the one symbol need not hold the lost one
def test_fountain_recovers(code, k):
    content = np.random.default_rng(k).integers(0, 256, k * 32, dtype=np.uint8).tobytes()
    lost = np.zeros(k, bool)
    lost[: max(1, k // 20) if k else 0] = True
    back, still = parity.fountain_recovery(content, 32, code, lost)
    assert still == 0 and back == content


def test_fountain_is_deterministic_and_partial():
    assert fountain.lt_members(50) == fountain.lt_members(50)
    assert all(len(set(m)) == len(m) for m in fountain.duip_members(40))
    lost = np.ones(100, bool)
    assert parity.fountain_recovery(bytes(range(100)) * 32, 32, "lt", lost)[1] > 0


@given(st.binary(max_size=300))
@settings(max_examples=60, deadline=None)
def test_transforms_and_codecs(data):
    assert codecs.undelta(codecs.xor_delta(data)) == data if data else True
    assert codecs.from_front(codecs.to_front(data)) == data
    assert codecs.rotations_undone(*codecs.rotations_sorted(data)) == data
    assert codecs._unzstd(codecs._zstd(data)) == data


_VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**63) | st.text() | st.binary() | st.floats(allow_nan=False), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=12)


@given(_VALUES)
@settings(max_examples=80, deadline=None)
def test_cbor_round_trip(value):
    assert cbor.loads(cbor.dumps(value)) == value


def test_cbor_refuses():
    for bad in (b"", b"\x81", b"\x01\x01", b"\x9f\xff", b"\x81" * 80 + b"\x01"):
        with pytest.raises(cbor.CborError):
            cbor.loads(bad)
    with pytest.raises(cbor.CborError):
        cbor.read_index(cbor.dumps({"a": 1, "schema_version": 1}))
    with pytest.raises(cbor.CborError):
        cbor.read_index(cbor.dumps({"schema_version": 2}))
    assert cbor.read_index(cbor.dumps({"schema_version": 1, "later": 3}))["later"] == 3


def test_aes_counter_mode(spark):
    # The published AES-256 counter-mode example, its key and first counter block f0..ff
    key = bytes(range(32))
    rows = spark.createDataFrame([(b"",), (b"x",), (bytes(range(100)),)], "d binary")
    out = rows.select("d", aes.opened(aes.sealed(F.col("d"), F.lit(bytes(12)), key), key).alias("back"), aes.sealed(F.col("d"), F.lit(bytes(12)), key).alias("s"))
    for r in out.collect():
        assert r["back"] == r["d"] and len(r["s"]) == 12 + len(r["d"])
    assert aes.derived_key("p", b"salt", 10) == hashlib.pbkdf2_hmac("sha256", b"p", b"salt", 10, 32)


def test_byte_functions(spark):
    row = spark.createDataFrame([(b"\xfb\xff\x00a", 150_000_000, "ab/../c", "x")], "b binary, n long, p string, q string")
    r = row.select(B.url_base64(F.col("b")).alias("u"), B.from_url_base64(B.url_base64(F.col("b"))).alias("v"), B.adler32(F.col("b")).alias("a"), B.human_size(F.col("n")).alias("h"), B.safe_path(F.col("p")).alias("s"), B.fragment_name(F.col("q"), F.lit(3)).alias("f"), B.fragment_size(F.col("n")).alias("z")).first()
    import zlib

    assert (r["u"], bytes(r["v"]), r["a"]) == ("-_8AYQ", b"\xfb\xff\x00a", zlib.adler32(b"\xfb\xff\x00a"))
    assert (r["h"], r["s"], r["f"], r["z"]) == ("143.05 MiB", False, "x_3.frag", 3_000_000)


def test_chunk_and_merge(spark):
    o = spark.createDataFrame([(1, b"abcdefg"), (2, b"")], "object_id long, content binary")
    f = chunking.split(o, 3)
    assert sorted((r["object_id"], r["frag_idx"], bytes(r["data"])) for r in f.collect()) == [(1, 0, b"abc"), (1, 1, b"def"), (1, 2, b"g")]
    assert bytes(chunking.merged(f, ["object_id"]).first()["content"]) == b"abcdefg"


def test_ring_round_trip(spark):
    f = spark.createDataFrame([(1, i, 3, bytes([i])) for i in range(3)] + [(2, 0, 1, b"z")], "object_id long, frag_idx int, n int, data binary")
    e = rings.ring_encoded(f)
    out = {(r["object_id"], r["frag_idx"]): r for r in rings.ring_recovered(e.where("not (object_id = 1 and frag_idx = 1)"), f.select("object_id", "frag_idx", "n")).collect()}
    assert bytes(out[1, 1]["data"]) == b"\x01" and out[1, 1]["source"] == "neighbour"
    both = rings.ring_recovered(e.where("not (object_id = 1 and frag_idx <= 1)"), f.select("object_id", "frag_idx", "n"))
    assert {r["frag_idx"]: r["source"] for r in both.where("object_id = 1").collect()} == {0: "neighbour", 1: "lost", 2: "stored"}


def test_placement_counts(spark):
    b = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    f = spark.range(10).select(F.col("id").cast("int").alias("frag_idx")).union(spark.createDataFrame([(-1,)], "i int"))
    got = {r["backend"]: r["count"] for r in placement.placed(f, placement.candidates(b)).groupBy("backend").count().collect()}
    assert got == {"a": 5, "b": 3, "c": 3}
    assert placement.candidates(b, excluded=["B"]).count() == 2 and placement.candidates(b, forced=["C"]).count() == 1


def test_probe_gc_orphans(spark):
    known = spark.createDataFrame([("h1", 1, 2), ("h2", 2, 1)], "hash string, owner long, ref_count long")
    new = spark.createDataFrame([(0, "h1"), (1, "h9")], "frag_idx int, hash string")
    assert {r["frag_idx"]: r["changed"] for r in dedup.probe(new, known).collect()} == {0: False, 1: True}
    gone = spark.createDataFrame([("h1",), ("h2",)], "hash string")
    kept = dedup.collected(known, gone, spark.createDataFrame([(9,)], "owner long"))
    assert [r["hash"] for r in kept.collect()] == ["h1"]
    files = spark.createDataFrame([(1,), (2,), (3,)], "owner long")
    assert [r["owner"] for r in dedup.orphans(files, known).collect()] == [3]


def test_verdicts(spark):
    rows = spark.createDataFrame([("a", "x", "a", None, None), ("b", "x", "a", "x", None), ("b", "x", "a", None, "x"), ("b", "x", "a", "y", "z"), ("b", "x", None, None, None)], "n2 string, n8 string, k2 string, a string, c string")
    got = [r[0] for r in rows.select(validation.fragment_verdict(*(F.col(c) for c in ("n2", "n8", "k2", "a", "c")))).collect()]
    assert got == ["ok", "suspicious", "suspicious", "corrupted", "corrupted"]


def test_diffs(spark):
    old = spark.createDataFrame([(1, "﻿a\r\nb\nb\nc")], "p int, text string")
    new = spark.createDataFrame([(1, "a\nb\nd\nb\ne")], "p int, text string")
    r = diffs.line_counters(diffs.matched_lines(diffs.lines(old, ["p"]), diffs.lines(new, ["p"]), ["p"]), ["p"]).first()
    assert (r["added_lines"], r["removed_lines"], r["changed_lines"], r["kept_lines"]) == (2, 1, 2, 3)
    i = diffs.ini_entries(spark.createDataFrame([(1, "x=1\n; no=1\n[S]\nK = v ; w\nk=2")], "p int, text string"), ["p"])
    assert sorted((r["section"], r["key"], r["value"]) for r in i.collect()) == [("", "x", "1"), ("s", "k", "2")]
    j = diffs.json_entries(spark.createDataFrame([(1, '{"a":[1,{"b":null}]}'), (2, "no")], "p int, text string"), ["p"])
    assert sorted((r["path"], r["value"]) for r in j.collect()) == [("$.a[0]", "1"), ("$.a[1].b", "null")]


def test_planner():
    p = planner.compute("FSS1", ["FSS2"])
    assert (p.effective_primary, p.active_strategies, [s["step"] for s in p.restore_pipeline]) == ("FSS2", ["FSS2", "FSS6"], ["etn_strip", "strip"])
    assert planner.compute("FSS5").is_single_strategy and planner.compute("FSS5").estimated_overhead == 2.0
    assert planner.compute("FSS5+", []).estimated_overhead == pytest.approx(36.00008)
    with pytest.raises(ValueError):
        planner.compute("FSS1", ["FSS3"])


def test_settings_and_files(spark, tmp_path):
    env = {"A": "${B}", "B": "x"}
    assert config.expanded("k: ${A} ${C}", env) == "k: x ${C}"
    assert config.backends("backends:\n  - name: one\n    path: ${B}\n  - name: 'two' # no\nother: 1\n", env) == [{"name": "one", "path": "x"}, {"name": "two"}]
    for i in range(2):
        (tmp_path / f"abc_{i}.frag").write_bytes(container.fragment_file({"original_name": "n", "file_size": 3}, b"pay", bytes(12), bytes(32) if i else b""))
    (tmp_path / "bad_0.frag").write_bytes(b"\xff\x01\x07\x00\x00\x00rest")
    f = container.parsed(container.scanned(spark, str(tmp_path)))
    assert {r["name"]: (r["is_fragment"], r["header_version"]) for r in f.collect()} == {"abc_0.frag": (True, 1), "abc_1.frag": (True, 2), "bad_0.frag": (False, None)}
    d = container.decoded_indexes(container.index_and_payload(f.where("is_fragment"), "body"))
    assert {(r["original_name"], r["file_size"], bytes(r["payload"])) for r in d.collect()} == {("n", 3, b"pay")}
    assert container.recovered_indexes(container.scanned(spark, str(tmp_path))).count() == 2


def test_diff_sample_limits(spark):
    d = spark.createDataFrame([(134_000,), (256 * 1024,), (256 * 1024 + 1,)], "n int").select("n", F.expr("repeat('a', n)").cast("binary").alias("b"))
    got = {r["n"]: r["k"] for r in d.select("n", F.octet_length(diffs.sample(F.col("b"))).alias("k")).collect()}
    assert got == {134_000: 134_000, 256 * 1024: 256 * 1024, 256 * 1024 + 1: 64 * 1024}


def test_json_of_any_depth(spark):
    """Leaves twelve levels down, by their paths."""
    from fragmill.operators import diffs

    deep = "1"
    for i in range(12):
        deep = f'{{"k{i % 3}":{deep}}}' if i % 2 else f"[{deep},2]"
    d = spark.createDataFrame([(1, deep), (2, "3"), (3, "no json"), (4, None), (5, "[]")], "id int, text string")
    got = diffs.json_entries(d, ["id"]).collect()
    assert len([r for r in got if r["id"] == 1]) == 7 and max(r["path"].count(".") + r["path"].count("[") for r in got) == 12
    assert [(r["path"], r["value"]) for r in got if r["id"] == 2] == [("$", "3")] and {r["id"] for r in got} == {1, 2}
    assert diffs.json_entries(d, ["id"], depth=2).where("id = 1").count() == 2

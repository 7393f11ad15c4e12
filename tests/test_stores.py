"""Stores, readers, unified diffs, recovery codes and version chains on small cases."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fragmill.functions import aes, ctr, fountain
from fragmill.operators import dedup, parity, recovery, strategies, unified, versions
from fragmill.plans import planner
from fragmill.sources import cbor, container, readers, storage


def test_backend(tmp_path):
    b = storage.Backend(str(tmp_path))
    b.put("x/one.frag", b"abc")
    b.put("x/one.frag", b"abcd")
    assert b.exists("x/one.frag") and b.get("x/one.frag") == b"abcd" and b.names() == ["x/one.frag"] and b.ping()
    b.delete("x/one.frag")
    assert not b.exists("x/one.frag")
    for name in ("../out", "/out", "a/../../b"):
        with pytest.raises(ValueError):
            b.put(name, b"")


def test_store_fetch_and_roll_back(spark, tmp_path):
    rows = [("Path", str(tmp_path / "a"), f"{i}.frag", bytes([i]) * i) for i in range(20)] + [("path", str(tmp_path / "a"), "../bad", b"x")]
    files = spark.createDataFrame(rows, "kind string, uri string, name string, data binary")
    out = {r["name"]: r for r in storage.stored(files).collect()}
    assert out["../bad"]["error"] and all(out[f"{i}.frag"]["error"] is None and out[f"{i}.frag"]["bytes"] == i for i in range(20))
    stores = spark.createDataFrame([("A", "path", str(tmp_path / "a"))], "name string, kind string, uri string")
    at = spark.createDataFrame([("o", i, f"{i}.frag", "a") for i in range(3)] + [("p", 0, "none.frag", "a"), ("p", 1, "1.frag", "a"), ("q", 0, "1.frag", "z")], "object_id string, frag_idx int, name string, backend string")
    got = {r["object_id"]: r for r in storage.objects_read(at, stores).collect()}
    assert bytes(got["o"]["content"]) == b"\1\2\2" and got["p"]["failed"] == 1 and got["p"]["content"] is None and got["q"]["failed"] == 1
    good = files.where("name <> '../bad'")
    assert storage.rolled_back(good) == 20 and storage.rolled_back(good) == 0


def test_transfer(spark, tmp_path):
    a, b = storage.Backend(str(tmp_path / "a")), storage.Backend(str(tmp_path / "b"))
    for n in ("0.frag", "2.frag", "o.idx", "o.rc"):
        a.put(n, n.encode())
    expected = spark.createDataFrame([("o", "fragment", f"{i}.frag") for i in range(3)] + [("o", "index", "o.idx"), ("o", "rc", "o.rc")], "object_id string, part string, name string")
    present = spark.createDataFrame([(n,) for n in a.names()], "name string")
    plan = storage.transfer_plan(expected, present)
    assert {r["name"]: r["action"] for r in plan.collect()} == {"0.frag": "move", "1.frag": "skip", "2.frag": "move", "o.idx": "move", "o.rc": "copy"}
    done = storage.transferred(plan, str(tmp_path / "a"), str(tmp_path / "b"))
    assert done.where("error is not null").count() == 0 and b.names() == ["0.frag", "2.frag", "o.idx", "o.rc"] and a.names() == ["o.rc"]


def test_counter_mode_matches_the_column_expression(spark):
    key, nonce = bytes(range(32)), bytes(range(12))
    data = [bytes([7]) * n for n in (0, 1, 15, 16, 17, 1000)]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, x binary")
    got = {r["i"]: bytes(r["y"]) for r in d.select("i", aes.aes_ctr(F.col("x"), F.lit(nonce), key).alias("y")).collect()}
    assert got == {i: ctr.crypt(x, nonce, key) for i, x in enumerate(data)}
    # a published vector of the cipher
    assert ctr.encrypted(np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), np.uint8).reshape(1, 16), key).tobytes().hex() == "8ea2b7ca516745bfeafc49904b496089"


def test_indexes_from_files(spark, tmp_path):
    document = cbor.index_document({"version": 1, "original_name": "a.txt", "original_hash": "ff", "file_size": 7, "fragments": [{"size": 7}]})
    legacy = bytes(12) + ctr.crypt(document, bytes(12), aes.legacy_key("pw"))
    files = {"new.idx": readers.sealed_index(document, "pw", bytes(range(32)), bytes(12), rounds=10), "old.idx": legacy, "bad.idx": b"\1" * 100, "short.idx": b"\1"}
    for n, x in files.items():
        (tmp_path / n).write_bytes(x)
    found = readers.files(spark, str(tmp_path), "*.idx")
    got = {r["name"]: r for r in readers.indexes(found, "pw", rounds=10).collect()}
    assert got["new.idx"]["original_name"] == got["old.idx"]["original_name"] == "a.txt" and got["bad.idx"]["original_name"] is None and got["short.idx"]["original_name"] is None
    assert all(r["original_name"] is None for r in readers.indexes(found, "other", rounds=10).collect())


def test_containers_and_canonical_forms(spark):
    fields = {"version": 1, "file_fingerprint": "ab", "index_block_map": ["x", "y"], "fragment_block_maps": [["a"], ["b", "c"]], "created_at": 5, "repair_a": {"seed": 1, "block_count": 9, "block_size": 4, "data": b"z"}, "repair_b": None}
    document = readers.container_document(fields)
    d = spark.createDataFrame([(document,), (b"\xff",), (None,)], "content binary")
    rows = [tuple(r)[1:] for r in readers.containers(d).collect()]
    assert rows[0] == (1, "ab", 5, 2, 2, 3, 9, None) and rows[1] == rows[2] == (None,) * 8
    assert readers.canonical_container(document) == readers.canonical_container(readers.container_document(fields | {"repair_a": None}))
    one, other = ({"version": 1, "original_name": "n", "fss6_maps": [i]} for i in (1, 2))
    assert readers.canonical_index(cbor.dumps(one)) == readers.canonical_index(cbor.dumps(other))


def test_rescue_without_an_index(spark, tmp_path):
    for i in (1, 2, 3):
        (tmp_path / f"o_{i}.frag").write_bytes(b"junk" if i == 1 else container.fragment_file({"original_name": "o"}, b"data", bytes(12)))
    got = readers.rescued(container.scanned(spark, str(tmp_path))).first()
    assert (got["prefix"], got["fragments"], got["probe"]) == ("o", 3, 2)


def test_unified_diff():
    old = b"\xef\xbb\xbf" + b"".join(b"line %d\r\n" % i for i in range(10))
    new = b"".join(b"line %d\n" % i for i in (0, 1, 2, 3, 4, 99, 6, 7, 8, 9))
    added, removed, changed, text = unified.unified(old, new, "f")
    assert (added, removed, changed) == (1, 1, 1)
    assert text == "--- a/f\n+++ b/f\n@@ -3 +3 @@\n line 2\n line 3\n line 4\n@@ -1 +1 @@\n-line 5\n+line 99\n@@ -3 +3 @@\n line 6\n line 7\n line 8\n"
    assert unified.unified(b"a\n", b"a\n")[:3] == (0, 0, 0) and unified.unified(b"", b"x")[3].endswith("@@ -0 +1 @@\n+x\n")
    # kept runs of one or two lines are left out; a moved line is kept where the old one stood
    assert unified.unified(b"a\nb\nc\n", b"x\nb\nz\n")[3] == "--- a/file\n+++ b/file\n@@ -1 +1 @@\n-a\n+x\n@@ -1 +1 @@\n-c\n+z\n"
    assert unified.edits(["a", "b"], ["b", "a"]) == [(" ", "a"), (" ", "b")]


def test_unified_diff_gives_the_new_text_back():
    """Where matches do not cross, what is kept and inserted is the new version, what is kept and deleted the old one."""
    r = random.Random(4)
    for _ in range(200):
        old = [f"{i}" for i in range(r.randint(0, 12))]
        new = [x if r.random() < 0.8 else f"n{r.random()}" for x in old if r.random() < 0.8]
        head = max(0, next((i for i, (x, y) in enumerate(zip(old, new)) if x != y), min(len(old), len(new))) - 3)
        found = unified.edits(old, new)
        kept_new, kept_old = [x for k, x in found if k != "-"], [x for k, x in found if k != "+"]
        assert kept_new == new[head : head + len(kept_new)] and kept_old == old[head : head + len(kept_old)]


def test_registry_takes_the_surest():
    r = unified.standard()
    assert r.chosen(b"plain text\n", "a.txt") == "text" and r.chosen(b"\0\1", "a.bin") == "binary"
    r.register("ini", lambda data, label: 1.0 if label.endswith(".ini") else 0.0, lambda o, n, label: ("ini",))
    assert r.diff(b"a=1", b"a=2", "x.ini") == ("ini",) and r.diff(b"\0", b"\0\0", "x") == (1, 0)


@pytest.mark.parametrize("code", ["lt", "duip"])
def test_sparse_decoding_against_elimination(code):
    """What comes back is what plain elimination over all equations determines, and it is right."""
    rng, equations = np.random.default_rng(5), fountain.lt_equations if code == "lt" else fountain.duip_equations
    for blocks in (1, 2, 7, 40, 90):
        data, e = rng.integers(0, 256, (blocks, 8), dtype=np.uint8), equations(blocks)
        values = fountain.symbols(data, e)
        for share in (0.1, 0.4, 0.7):
            lost = rng.random(blocks) < share
            back, still = fountain.decoded(np.where(lost[:, None], 0, data).astype(np.uint8), lost, e, values)
            assert (back[~still] == data[~still]).all() and not (still & ~lost).any()
            m = np.zeros((len(e), int(lost.sum())), np.uint8)
            at = np.cumsum(lost) - 1
            for i, x in enumerate(e):
                m[i, at[x[lost[x]]]] = 1
            row = 0
            for c in range(m.shape[1]):  # reduced rows: a column is determined if its row has nothing else
                hit = np.flatnonzero(m[row:, c])
                if len(hit):
                    m[[row, row + hit[0]]] = m[[row + hit[0], row]]
                    for i in np.flatnonzero(m[:, c]):
                        if i != row:
                            m[i] ^= m[row]
                    row += 1
            assert int((m.sum(1) == 1).sum()) == int((lost & ~still).sum())


def test_large_codes_stay_small():
    e = fountain.lt_equations(20_000)
    assert len(e) == 14_000 and sum(map(len, e)) < 40 * 20_000


def test_grid_code():
    r = random.Random(2)
    data = [r.randbytes(100) for _ in range(6)] + [r.randbytes(37)]
    sizes, whole = [len(x) for x in data], parity.grid_encoded(data)
    for lost in range(7):
        assert parity.grid_decoded({i: x for i, x in enumerate(whole) if i != lost}, [lost], sizes)[lost] == data[lost]
    two = parity.grid_decoded({i: x for i, x in enumerate(whole) if i not in (1, 2)}, [1, 2], sizes)
    assert two == {1: bytes(100), 2: bytes(100)}  # seven cells each, two check cells
    assert parity.grid_encoded([]) == []


def test_frames(spark):
    d = spark.createDataFrame([(b"abc", b"", b"x" * 300), (b"", b"", b"")], "a binary, b binary, c binary")
    got = d.select(recovery.parts_of(recovery.framed(F.col("a"), F.col("b"), F.col("c"))).alias("p"), recovery.parts_of(F.concat(recovery.framed(F.col("a"), F.col("b"), F.col("c")), F.lit(b"!"))).alias("q")).collect()
    assert [tuple(map(bytes, r["p"])) for r in got] == [(b"abc", b"", b"x" * 300), (b"", b"", b"")] and all(r["q"] is None for r in got)


def test_chains(spark):
    rows = [(1, 1, 0, "a"), (1, 1, 1, "b"), (1, 2, 0, "a"), (1, 2, 1, "c"), (1, 2, 2, "c"), (1, 3, 0, "a"), (1, 3, 1, "c"), (1, 3, 3, "c"), (1, 3, 4, "d")]
    f = spark.createDataFrame([(o, n, i, h, ord(h)) for o, n, i, h in rows], "object_id int, number long, frag_idx int, hash string, checksum long")
    got = {(r["number"], r["frag_idx"]): (r["stored"], r["source_number"], r["source_index"]) for r in versions.chained(f).collect()}
    assert got[2, 0] == (True, None, None) and got[3, 0] == (False, 2, 0) and got[3, 1] == (False, 2, 2) and got[3, 3] == (False, 2, 2) and got[3, 4][0]
    whole = {(r["number"], r["frag_idx"]): (r["stored"], r["source_number"], r["source_index"]) for r in versions.chained_whole(f).collect()}
    assert whole[2, 2] == (False, 2, 1) and whole[3, 3] == (False, 2, 1) and whole[1, 0][0] is not False


def test_catalogue(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "c", 1), (3, "d", 2), (3, "e", 3)], "k int, v string, at int")
    assert sorted(tuple(r) for r in versions.upserted(old, new, ["k"], "at").collect()) == [(1, "c", 1), (2, "b", 1), (3, "e", 3)]
    assert sorted(tuple(r) for r in versions.ensured(old, new, ["k"], "at").collect()) == [(1, "a", 1), (2, "b", 1), (3, "d", 2)]


def test_catalogue_of_ties_and_nulls(spark, tmp_path):
    from fragmill.plans import catalog

    # l_orderkey, l_linenumber, l_suppkey, l_quantity, l_linestatus, l_shipdate; the second half is a file of its own
    rows = [(1, n, 10 * n + i, float(i + 1), "F", "2000-01-01") for i in range(6) for n in (1, 2)]
    rows += [(2, 1, 7, 1.0, "F", "2000-01-01"), (2, 1, None, None, "F", "2001-01-01"), (3, 1, 5, 2.0, "F", None), (3, 1, 6, 3.0, "F", "2000-01-01"), (4, 2, None, 1.0, "O", None), (None, 2, 1, 1.0, "F", "2000-01-01")]
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (l_orderkey BIGINT, l_linenumber INTEGER, l_suppkey BIGINT, l_quantity DOUBLE, l_linestatus VARCHAR, l_shipdate TIMESTAMP)")
    for name, part in (("b", rows[6:]), ("a", rows[:6])):
        con.execute("DELETE FROM t")
        con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?)", part)
        con.execute(f"COPY t TO '{folder}/{name}.parquet'")
    con.execute(f"SET threads = 1; CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/*.parquet')")
    columns = "object_id, frag_idx, backend, file_size, uploaded_at"
    want = con.execute(f"SELECT {columns} FROM ({catalog.oracle_sql()['catalog_upserts']})").fetchall()
    got = catalog.queries()["catalog_upserts"](spark, str(tmp_path)).select(*columns.split(", ")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert (1, 1, 10, 1024) in {r[:4] for r in want} and (2, 1, 7, 1024) in {r[:4] for r in want}


def test_dictionary_falls_back(spark):
    d = spark.createDataFrame([(b"abcdXX",), (b"abcdYY",), (b"ZZabcd",)], "content binary")
    assert [tuple(r) for r in dedup.dictionary(d).collect()] == [(b"abcd".hex().upper(), 3, 12)]
    assert dedup.dictionary(d.where("false")).count() == 0


def test_third_validation_is_a_step_of_its_own():
    p = planner.compute("FSS6.2", [])
    assert [s["step"] for s in p.restore_pipeline] == ["strip"] and p.active_strategies == ["FSS6.2"]


def test_windowed_plans():
    assert planner.windowed(planner.compute("FSS1"), "zstd") and planner.windowed(planner.compute("FSS1"), None)
    assert not planner.windowed(planner.compute("FSS1"), "CKC") and not planner.windowed(planner.compute("FSS1", []), None)
    assert not planner.windowed(planner.compute("FSS1", ["FSS2"]), None) and not planner.windowed(planner.compute("FSS3"), None)


def test_resume_and_clean(tmp_path):
    from datetime import datetime, timedelta, timezone

    b = storage.Backend(str(tmp_path))
    assert b.received("x") == 0 and b.resume("x", 0, b"abc") == 3 and b.received("x") == 3 and not b.exists("x") and b.names() == []
    with pytest.raises(ValueError):
        b.resume("x", 1, b"z")
    assert b.resume("x", 3, b"de", last=True) == 5 and b.get("x") == b"abcde" and b.received("x") == 0
    b.resume("y", 0, b"1")
    assert b.cleaned(1) == [] and b.cleaned(1, datetime.now(timezone.utc) + timedelta(hours=2)) == ["y.part"] and b.received("y") == 0


@pytest.mark.parametrize("level", ["FSS1", "fss2", "FSS5"])
def test_strategies_recover(spark, level):
    rows = [(o, i, 6, f"{o}-{i}".encode()) for o in range(3) for i in range(6)]
    f = spark.createDataFrame(rows, "object_id int, frag_idx int, n int, data binary")
    s = strategies.of(level)
    stored = s.encode(f).where("frag_idx <> 2 and frag_idx <> 4")
    got = s.recover(stored, f.select("object_id", "frag_idx", "n")).collect()
    assert {(r["object_id"], r["frag_idx"]): bytes(r["data"]) for r in got} == {(o, i): d for o, i, _, d in rows}


def test_own_strategies():
    strategies.register("plain", strategies.Strategy(lambda f: f, lambda stored, expected: expected.join(stored, ["object_id", "frag_idx", "n"], "left")))
    assert strategies.known() == ["FSS1", "FSS2", "FSS5", "PLAIN"]
    with pytest.raises(ValueError):
        strategies.of("FSS9")

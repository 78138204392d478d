"""Searches, the correlation filter and headers against plain Python."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxstrata.operators import relational, search
from voxstrata.plans import search as plans
from voxstrata.sources import audio, headers


def brute_find(tree, roots, patterns, most, stop=True):
    out = {}
    for root in roots:
        seen, front, depth = {root}, [(root, ())], 0
        while front and depth <= most:
            reached = {}
            for key, way in front:
                for k, p, n in tree:
                    if p == key and k is not None and k not in seen:
                        reached[k] = min(reached.get(k, ((*way, n or ""), n)), ((*way, n or ""), n), key=lambda v: v[0])
            seen |= reached.keys()
            front = []
            for k, (way, n) in reached.items():
                hit = any(p.lower() in (n or "").lower() for p in patterns)
                if hit:
                    out[root, k] = (n, depth, "/".join(way))
                if not (hit and stop):
                    front.append((k, way))
            depth += 1
    return out


@pytest.mark.parametrize("stop", [True, False])
def test_find_below_with_cycles_and_any_order_of_keys(spark, stop):
    r = np.random.default_rng(4)
    names = ["Processed", "raw", "a/b", "reprocessed 2", None, "x"]
    tree = [(int(a), int(b), names[int(c)]) for a, b, c in zip(r.integers(0, 60, 150), r.integers(0, 60, 150), r.integers(0, 6, 150))]  # several parents, cycles
    tree += [(1, 1, "raw"), (2, 50, "processed"), (50, 2, "raw"), (None, 3, "processed"), (7, None, "processed")]
    roots = [(50, "s", 1), (3, "t", 2), (999, "u", 3), (None, "v", 4)]
    got = search.find_below(spark.createDataFrame(tree, "key long, parent long, name string"), spark.createDataFrame(roots, "key long, subject string, week int"), ["PROCESSED"], 4, stop).collect()
    assert {(g["root"], g["key"]): (g["name"], g["depth"], g["path"]) for g in got} == brute_find(tree, [50, 3, 999], ["processed"], 4, stop)
    assert len(got) == len({(g["root"], g["key"]) for g in got}) > 4 and all((g["subject"], g["week"]) == {50: ("s", 1), 3: ("t", 2)}[g["root"]] for g in got)


def test_find_below_long_chain_and_empty(spark):
    chain = spark.createDataFrame([(i, i + 1, "x" if i else "hit") for i in range(12)], "key long, parent long, name string")
    roots = spark.createDataFrame([(12,)], "key long")
    assert [(g["key"], g["depth"]) for g in search.find_below(chain, roots, ["hit"], None).collect()] == [(0, 11)]
    assert search.find_below(chain, roots, ["hit"], 5).count() == search.find_below(chain.limit(0), roots, ["hit"]).count() == search.find_below(chain, roots.limit(0), ["hit"]).count() == 0


def test_containing_is_a_join_on_contains(spark):
    texts = [("week_1_Beck and Kurt_S_Snip",), ("Week_11_beck_U_snip",), ("wEEk_2_Ab_B_Snip",), (None,), ("",), ("x",), ("week_1_Beck and Kurt_S_Snip",)]
    rows = [(1, "week_1_", "Beck and Kurt", "S_Snip"), (2, "WEEK_1_", "beck", "u_snip"), (3, "week_11_", "eck", ""), (4, "", "", ""), (5, "k", "", "b"), (6, None, "x", "x"), (7, "zzz", "", ""), (8, "ab", "b_", "_"), (9, "week_1_", "beck", "s_snip")]
    a, b = spark.createDataFrame(rows, "id long, p string, q string, r string"), spark.createDataFrame(texts, "text string")
    found = search.containing(a, b, [F.col("p"), F.col("q"), F.col("r")])
    want = sorted((i, t) for i, *n in rows for (t,) in texts if t is not None and None not in n and all(x.lower() in t.lower() for x in n))
    assert sorted((r["id"], r["text"]) for r in found.collect()) == want and found.columns == ["id", "p", "q", "r", "text"]
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert search.containing(a, b.limit(0), [F.col("p")]).count() == search.containing(a.limit(0), b, [F.col("p")]).count() == 0
    with pytest.raises(ValueError):
        search.containing(a, b.withColumnRenamed("text", "id"), [F.col("p")], "id")


def test_token_lookup_asks_for_each_set_of_pieces_once(spark, tmp_path, monkeypatch):
    """2,000 rows of few sets of pieces: only distinct sets go into the search, whatever the number of rows."""
    spark.range(2000).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(i, f"hot {n}", f"Brand#{i % 25 + 1}", i % 50 + 1) for i in range(50) for n in ("ring", "bolt")], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    asked, search_for = [], search.containing

    def counted(rows, *args):
        asked.append(rows.count())
        return search_for(rows, *args)

    monkeypatch.setattr(search, "containing", counted)
    got = {r["c_custkey"]: (r["n_folders"], r["folder"]) for r in plans.token_lookup(spark, str(tmp_path)).collect()}
    assert asked == [50] and len(got) == 2000
    for k, (n, folder) in got.items():
        size, kind, brand = k % 50 + 1, ["red", "BLUE", "hot", "small", "ring"][k % 5], k % 25 + 1
        names = [f"Week_{i % 50 + 1}_hot {x}_Brand#{i % 25 + 1}_Snip" for i in range(50) for x in ("ring", "bolt")]
        fits = [f for f in names if f"week_{size}_" in f.lower() and kind.lower() in f.lower() and f"brand#{brand}_snip" in f.lower()]
        assert (n, folder) == (len(fits), max(fits, default=None))


def brute_filter(n, over, variance):
    gone = {}
    for i in range(n):
        if i in gone:
            continue
        for j in range(i + 1, n):
            if j in gone or (i, j) not in over:
                continue
            if variance[i] >= variance[j]:
                gone[j] = i
            else:
                gone[i] = j
                break
    return gone


@pytest.mark.parametrize("seed, n, share", [(0, 40, 0.1), (1, 60, 0.03), (2, 25, 0.5), (3, 30, 1.0), (4, 10, 0.0)])
def test_correlation_filter_is_the_sequential_rule(spark, seed, n, share):
    r = np.random.default_rng(seed)
    over = {(i, j) for i in range(n) for j in range(i + 1, n) if r.random() < share}
    variance = r.integers(0, 6, n).astype(float)
    edges = spark.createDataFrame([(j, i) if (i + j) % 2 else (i, j) for i, j in over] + [(3, 3)], "i long, j long")
    features = spark.createDataFrame([(i, f"f{i}", float(v)) for i, v in enumerate(variance)], "place long, feature string, variance double")
    got = {x["place"]: x["by"] for x in search.correlation_filter(edges, features).collect()}
    assert {k: v for k, v in got.items() if v is not None} == brute_filter(n, over, variance) and len(got) == n


def test_vector_correlations(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((200, 6))
    x[:, 3] = 2 * x[:, 0] + 0.1 * x[:, 3]
    x[:, 5] = 4.0
    rows = [([float(v) for v in row],) for row in x] + [(None,), ([1.0],), ([None, float("nan"), 3.0],)]
    got = {(g["i"], g["j"]): g["r"] for g in relational.vector_correlations(spark.createDataFrame(rows, "v array<double>"), "v", 6).collect()}
    want = np.corrcoef(x[:, :5], rowvar=False)
    assert len(got) == 15 and all(got[i, 5] is None for i in range(5)) and all(abs(got[i, j] - want[i, j]) < 1e-9 for i in range(5) for j in range(i + 1, 5))


# ---------------------------------------------------------------- headers


class Spy:
    """A file that counts what is read from it."""

    def __init__(self, content):
        self.content, self.at, self.count = content, 0, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        out = self.content[self.at : self.at + n]
        self.at, self.count = self.at + len(out), self.count + len(out)
        return out


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def wave(n=1000, rate=8000, channels=2, bits=16, before=b"", kind=1, extra=b""):
    form = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits) + extra
    body = b"WAVE" + before + chunk(b"fmt ", form) + chunk(b"data", b"\1" * (n * channels * bits // 8))
    return b"RIFF" + struct.pack("<I", len(body)) + body


LONG = b"RF64" + b"\xff" * 4 + b"WAVE" + chunk(b"ds64", struct.pack("<QQQ", 0, 3200, 0)) + wave(1600, 1600, 1)[12:-3208] + b"data" + b"\xff" * 4 + b"\1" * 3200
FILES = {
    "week_1/a.wav": wave(),
    "week_1/b.WAV": wave(50, 44100, 1, 24, before=chunk(b"LIST", b"x" * 99_999)),  # samples far behind a list that isn't read
    "week_1/c.wav": wave(10, 100, 1, 32, kind=0xFFFE, extra=struct.pack("<HHIH", 22, 32, 0, 3) + b"\0" * 14),
    "week_2/deep/d.wav": wave(100_000),
    "week_2/long.wav": LONG,
    "week_2/cut.wav": wave()[:500],
    "week_2/short.wav": wave()[:30],
    "week_2/empty.wav": b"",
    "week_2/text.wav": b"not a recording at all",
    "week_2/none.wav": wave()[:36],
    "week_2/many.wav": wave(before=chunk(b"junk", b"") * 1000),
    "week_2/._hidden.wav": wave(),
    "week_2/other.mp3": wave(),
}


def test_header_reads_few_bytes():
    for name, content in FILES.items():
        spy = Spy(content)
        counted = headers.Counted(spy, 4096)
        out = headers.header(counted, len(content))
        assert spy.count == counted.count <= 4096
        if name.endswith(("a.wav", "b.WAV", "d.wav")):
            assert spy.count <= 60 and "error" not in out
            assert out["duration"] == audio.riff(content)["duration"]


@pytest.fixture(scope="module")
def recordings(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("recordings")
    written = headers.write_files(spark.createDataFrame(list(FILES.items()), "path string, content binary"), str(root))
    assert {r["path"]: r["size"] for r in written.collect()} == {k: len(v) for k, v in FILES.items()}
    (root / "nothing").mkdir()
    return str(root)


def test_headers_of_a_folder(spark, recordings):
    for root in (recordings, "file://" + recordings):
        got = {r["path"].split("/", len(recordings.split("/")))[-1]: r for r in headers.read_headers(spark, root).collect()}
        assert got.keys() == {k for k in FILES if not k.endswith(("mp3", "_hidden.wav"))}
        fields = lambda k: tuple(got[k][c] for c in ("sampling_rate", "channels", "bits", "format", "duration", "error"))
        assert fields("week_1/a.wav") == (8000, 2, 16, 1, 0.125, None) and fields("week_1/b.WAV") == (44100, 1, 24, 1, 50 / 44100, None)
        assert fields("week_1/c.wav") == (100, 1, 32, 3, 0.1, None) and fields("week_2/long.wav") == (1600, 1, 16, 1, 1.0, None)
        assert got["week_2/cut.wav"]["error"] == "456 of 4000 bytes of samples" and got["week_2/cut.wav"]["duration"] == 0.125
        assert [got[f"week_2/{k}.wav"]["error"] for k in ("short", "empty", "text", "none", "many")] == ["cut short in the header", "cut short in the header", "not a RIFF/WAVE file", "no samples", "no samples found in 4096 bytes"]
        assert all(r["bytes_read"] <= 4096 and r["size"] == len(FILES[k]) for k, r in got.items()) and got["week_2/deep/d.wav"]["parent"] == "deep"


def test_headers_by_columns_and_patterns(spark, recordings):
    listed = headers.read_headers(spark, recordings, ["name", "size"])
    assert listed.columns == ["name", "size"] and listed.count() == 11
    assert {r["name"] for r in headers.read_headers(spark, recordings, folders="WEEK_1", names="[ab]*").collect()} == {"a.wav", "b.WAV"}
    assert headers.read_headers(spark, recordings + "/nothing").count() == 0
    spark.dataSource.register(headers.WavHeaders)
    assert spark.read.format("wav_headers").option("split", 3).load(recordings).where("error IS NULL").count() == 5


def test_names_alone_open_no_file(tmp_path):
    (tmp_path / "a.wav").write_bytes(wave())
    from pyspark.sql.types import StructType

    for names, opened in ((["name", "size"], False), (["name", "bits"], True)):
        kind = StructType.fromDDL(", ".join(f"{n} string" for n in names))
        reader = headers.HeaderReader({"path": str(tmp_path), "split": 1}, kind)
        rows = [row for part in reader.partitions() for row in reader.read(part)]
        assert rows == [("a.wav", 16 if opened else 4044)]

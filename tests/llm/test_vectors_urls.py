"""URL templates, centroid clustering and whitening as their queries return them, against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxstrata.llm import centroids, url_filter, vector_search, whitening
from voxstrata.llm.secular import Spectrum

# ---------------------------------------------------------------- urls


def brute_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group(0)
    path = re.match(r"[^?#]*", rest[len(host) :]).group(0)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fits = [(len(r), r, v) for v, r in url_filter.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def brute_form(s):
    if len(s) > 64:
        return "~"
    if re.fullmatch("[0-9a-fA-F-]{16,}", s) and re.search("[0-9]", s) and not re.fullmatch("[0-9-]+", s):
        return "$"
    return re.sub("[0-9]+", "#", s)


def brute_forms(path):
    if not path:
        return ("",) * 4
    parts = re.sub("^/", "", path).split("/", 3)
    return tuple("/" + brute_form(p) for p in parts) + ("",) * (4 - len(parts))


def brute_verdicts(urls):
    """The same templates with dictionaries: a node at a time."""
    seen = [(h, p, *brute_rule(h, p)) for h, p in map(brute_host_path, urls)]
    t = defaultdict(lambda: [0, 0, 0])
    for h, p, _, v in seen:
        c = t[h, brute_forms(p)]
        c[0], c[1], c[2] = c[0] + 1, c[1] + (v == "block"), c[2] + (v is not None)
    now = {k: k[1] for k in t}  # (host, form) -> levels
    for d in range(4):
        nodes = defaultdict(Counter)
        for k, s in now.items():
            if s[d]:
                nodes[k[0], s[:d]][s[d]] += t[k][0]
        for k, s in now.items():
            kids = nodes[k[0], s[:d]]
            if s[d] and len(kids) >= 16 and 2 * sum(n == 1 for n in kids.values()) >= len(kids) and kids[s[d]] * 20 < sum(kids.values()):
                now[k] = (*s[:d], "/*", *s[d + 1 :])
    for d in reversed(range(4)):
        nodes = defaultdict(lambda: defaultdict(Counter))
        labels = defaultdict(lambda: [0, 0])
        for k, s in now.items():
            if s[d]:
                nodes[k[0], s[:d]][s[d]][s[d + 1 :]] += t[k][0]
                own = labels[k[0], s[:d], s[d]]
                own[0], own[1] = own[0] + t[k][1], own[1] + t[k][2]
        name = {}
        for node, kids in nodes.items():
            left = set(kids)
            for _ in range(2):
                if len(left) < 2:
                    break
                lead = max(left, key=lambda c: (sum(kids[c].values()), c))
                group = set()
                for c in left:
                    a, b = kids[c], kids[lead]
                    n, m = sum(a.values()), sum(b.values())
                    both = set(a) | set(b)
                    x2 = sum((a[x] * math.sqrt(m / n) - b[x] * math.sqrt(n / m)) ** 2 / (a[x] + b[x]) for x in both)
                    (bad, lab), (bad2, lab2) = labels[(*node, c)], labels[(*node, lead)]
                    against = False
                    if lab and lab2:
                        p = (bad + bad2 + 1) / (lab + lab2 + 2)
                        against = (bad / lab - bad2 / lab2) ** 2 > 9 * p * (1 - p) * (1 / lab + 1 / lab2)
                    if x2 <= len(both) - 1 + 3 * math.sqrt(2 * (len(both) - 1)) + 1e-9 and not against:
                        group.add(c)
                if len(group) > 1:
                    name |= {(*node, c): "/{" + lead[1:] + "}" for c in group}
                left -= group
        for k, s in now.items():
            now[k] = (*s[:d], name.get((k[0], s[:d], s[d]), s[d]), *s[d + 1 :])
    total, bad = sum(c[2] for c in t.values()), sum(c[1] for c in t.values())
    prior = min(bad / total, 0.5) if total else 0.0
    sums = defaultdict(lambda: [0, 0])
    for k, s in now.items():
        own = sums[k[0], s]
        own[0], own[1] = own[0] + t[k][1], own[1] + t[k][2]
    out = []
    for h, p, r, v in seen:
        s = now[h, brute_forms(p)]
        b, n = sums[h, s]
        out.append((h, p, r, v or ("block" if (b + 10 * prior) / (n + 10) >= 0.8 else "allow"), "".join(s)))
    return out


ODD_URLS = [None, "", "no scheme", "http://", "https://NET", "http://Net/x", "http://a.b.net?x=/en/", "ftp://EXAMPLE.NET/en/1?q#f", "http://x.example.com/de", "http://x.example.com/de/", "http://notexample.net/en/",
            "http://org/fr/#", "http://org//fr/", "a://b://c/d", "http://ÄÖ.org/fr/é", "http://long.com/" + "x" * 300_000, "http://deep.com/" + "a/" * 50, "http://u:p@h.com:80/1/0123456789abcdef01"]


def some_urls():
    r = np.random.default_rng(5)
    out = list(ODD_URLS)
    for i in range(1500):
        host = ["hot.example.com", "b.example.com", "c.example.org", "d.example.net"][min(int(r.integers(0, 8)), 3) if i % 3 else 0]
        kind = r.integers(0, 5)
        lang = ["en", "de", "fr", "es"][int(r.integers(0, 4))]
        path = [f"/{lang}/{i}", f"/{lang}/{i}.html", f"/{lang}/post-{hashlib.md5(str(i).encode()).hexdigest()[:5]}zz", f"/tag/{['a', 'b'][i % 2]}/{i}/x", f"/{lang}/about"][kind]
        out.append(f"http://{host}{path}?r={i}")
    return out


@pytest.mark.parametrize("rows", [some_urls(), ODD_URLS, []], ids=["many", "odd", "none"])
def test_urls(spark, tmp_path, rows):
    pages = spark.createDataFrame([(i // 2 if i % 7 else None, u, "<p>", "x", 0.5) for i, u in enumerate(rows)], "page_id long, url string, html string, host string, purity double")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = url_filter.op11_url_filter(spark, str(tmp_path)).toPandas()
    want = [(i // 2 if i % 7 else -1, *w) for i, w in enumerate(brute_verdicts(rows))]
    key = lambda x: tuple(map(str, x))
    have = got[["page_id", "host", "path", "rule", "verdict", "template"]].assign(page_id=got["page_id"].fillna(-1).astype(int)).astype(object)
    have = have.where(have.notna(), None)
    assert sorted(map(tuple, have.to_numpy().tolist()), key=key) == sorted(want, key=key)
    if len(rows) > 1000:
        judged = got[got["rule"].isna()]
        assert {"block", "allow"} == set(judged["verdict"]) and judged["template"].str.contains(r"\*").any() and judged["template"].str.contains(r"\{").any()


def test_siblings_merge_with_any_leader(spark):
    """Five pairs of branches, each alike and unlike all others: all five are merged, not only those of the first leaders."""
    urls = [f"http://h.com/{name}{pair}/{tail}{pair}" for pair in "abcde" for name in ("u", "v") for tail in ("x", "y") for _ in range(20 + ord(pair) - ord("a"))]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["template"] for r in url_filter.filtered(pages).select("template").distinct().collect()}
    assert {t.split("/", 2)[1] for t in got} == {"{v" + pair + "}" for pair in "abcde"}


# ---------------------------------------------------------------- centroids

VECTORS = "vec_id long, embedding array<float>, label int, cluster int, distance long, n long"


def vectors_table(spark, path, rows):
    spark.createDataFrame([(i, v, 1, None, None, 5) for i, v in rows], VECTORS).repartition(5).write.parquet(str(path / "embeddings.parquet"))
    return str(path)


def clustered_vectors(n, seed=3, width=64):
    r = np.random.default_rng(seed)
    middles = r.standard_normal((7, width))
    return [(i, [float(x) for x in middles[i % 7] * (1 + i % 3) + 0.05 * r.standard_normal(width)]) for i in range(n)]


def odd_vectors(rows):
    return rows + [rows[0]] * 60 + [(5, rows[6][1]), (None, rows[7][1]), (900, None), (901, []), (902, [1.0] * 63), (903, [None] + [1.0] * 63), (904, [float("nan")] * 64), (905, [float("inf")] * 64)]


def test_centroids_are_those_of_all_distances(spark, tmp_path):
    rows = odd_vectors(clustered_vectors(400))
    folder = vectors_table(spark, tmp_path, rows)
    got = centroids.op12_centroids(spark, folder).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    want = con.sql(centroids.OP12_SQL).df()
    as_rows = lambda f: sorted(map(str, f[sorted(want.columns)].astype({"vec_id": "Int64"}).itertuples(index=False)))
    assert list(got.columns) == list(want.columns) and len(got) == 462 and as_rows(got) == as_rows(want)
    # clustered vectors: most centroids are passed over by their bounds
    measured = centroids.clustered(spark.read.parquet(f"{folder}/embeddings.parquet")).agg(F.avg("n_measured")).first()[0]
    assert measured < 30


def test_bounds_hold_and_prune():
    r = np.random.default_rng(0)
    for scale in (1, 1000, 10**9, 4 * 10**18):
        x = (r.uniform(-1, 1, (200, 8)) * scale).astype(np.int64)
        x[:50] = x[0]
        c = x[::17]
        bounds = centroids.Bounds(centroids.spread(c, 5))
        true = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x], object)
        lower = bounds.lower(bounds.distances(x), bounds.distances(c))
        assert (lower <= np.sqrt(true.astype(float)) * (1 + 1e-12)).all()
        at, best, taken = centroids.assign(x, bounds.distances(x), c, bounds)
        assert at.tolist() == [min(range(len(c)), key=lambda j: (row[j], j)) for row in true] and [int(b) for b in best] == [min(row) for row in true]
        assert taken <= true.size


def test_large_components_are_exact(spark):
    rows = [(i, [float(np.float32(v))] * 64) for i, v in enumerate([1e12, 1.5e12, -1e12, 3e38, -3e38, 0.0, 1e12, 2.5e12] * 8)]
    frame = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in centroids.clustered(frame, k=3).collect()}
    x = [[max(min(math.floor(256 * float(c)), (1 << 63) - 1), -(1 << 63)) for c in v] for _, v in rows]
    start = sorted(range(len(rows)), key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())[:3]
    own, gap = [x[i] for i in start], lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for turn in range(6):
        at = [min(range(3), key=lambda j: (gap(v, own[j]), j)) for v in x]
        if turn < 5:
            own = [[sum(x[i][p] for i in range(len(x)) if at[i] == j) // at.count(j) for p in range(64)] if j in at else own[j] for j in range(3)]
    assert [got[i]["cluster"] for i in range(len(x))] == at
    assert [got[i]["distance"] for i in range(len(x))] == [min(gap(v, own[j]), (1 << 63) - 1) for v, j in zip(x, at)]


def test_top_k_of_large_vectors_is_exact(spark, tmp_path):
    r = np.random.default_rng(8)
    wide = lambda scale: [float(np.float32(v)) for v in r.uniform(-1, 1, 64) * scale]
    rows = [(i, wide([1, 1e6, 1e6, 1e12, 1][i % 5])) for i in range(160)] + [(200 + i, [3e38] * 64) for i in range(2)] + [(250, wide(1e6))]
    rows += [(300 + i, rows[150][1]) for i in range(3)]
    folder = vectors_table(spark, tmp_path, rows)
    most = (1 << 63) - 1
    x = {i: [max(min(math.floor(256 * v), most), -most - 1) for v in e] for i, e in rows}
    want = {}
    for q in (i for i in x if i % 50 == 0):
        scores = sorted((-max(min(sum(a * b for a, b in zip(x[q], x[c])), most), -most - 1), c) for c in x if c != q)[:5]
        want |= {(q, n + 1): (c, -s) for n, (s, c) in enumerate(scores)}
    got = {(g["query_id"], g["rank"]): (g["vec_id"], g["score"]) for g in vector_search.op2_topk(spark, folder).collect()}
    assert got == want


# ---------------------------------------------------------------- whitening


@pytest.mark.parametrize("kind", range(4))
def test_rank_one_updates_are_the_scatter(kind):
    r = np.random.default_rng(kind)
    x = [r.standard_normal((150, 24)) * np.geomspace(1e-3, 100, 24) + 50, np.repeat(r.standard_normal((8, 24)), 20, 0), np.eye(24)[r.integers(0, 24, 150)] * 7, np.full((150, 24), 3.0)][kind]
    centred = x - x.mean(0)
    scatter = centred.T @ centred
    one, two, all_ = Spectrum.empty(24), Spectrum.empty(24), Spectrum.empty(24)
    for row in x:
        all_.add(row[None])  # one row an update
    one.add(x[:100])  # by the chunk's triangular factor
    two.add(x[100:110])
    two.add(x[110:])
    one.combine(two)
    for s in (all_, one):
        assert s.n == len(x) and np.allclose(s.mean, x.mean(0)) and np.abs(s.q.T @ s.q - np.eye(24)).max() < 1e-11
        assert np.abs(s.q @ np.diag(s.d) @ s.q.T - scatter).max() <= 1e-11 * max(np.abs(scatter).max(), 1)


def brute_whitening(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    x = [(i, [math.floor(256 * float(np.float32(c))) for c in v] + [0] * (width - len(v))) for i, v in kept]
    fit = np.array(sorted({tuple(v) for _, v in x}), object)
    n, sums = len(fit), fit.sum(0)
    centred = (fit * n - sums).astype(float) / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    return [(i, n, sum((n * c - s) ** 2 for c, s in zip(v, sums)), (np.array([n * c - s for c, s in zip(v, sums)], float) / n) @ axes[:, ::-1][:, :4] / np.sqrt(e[::-1][:4])) for i, v in x], e[::-1][:4] / e.sum()


def test_whitening(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = [(i, [float(c) for c in r.standard_normal(12) * np.linspace(1, 3, 12)]) for i in range(300)]
    rows += [rows[3]] * 150 + [(7, rows[8][1]), (None, rows[9][1]), (1, None), (2, [None, 1.0]), (3, [float("nan")] * 12), (4, [float("inf")] * 12), (800, [1.0, -2.0]), (801, [])]
    folder = vectors_table(spark, tmp_path, rows)
    got = whitening.op13_whitening(spark, folder).toPandas()
    want, explained = brute_whitening(rows)
    assert len(got) == 4 * len(want) and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    assert np.allclose(got.groupby("component")["explained"].first(), explained, rtol=1e-12)
    key = lambda i, w: (-1 if i is None or i != i else int(i), *np.round(np.abs(w), 6))
    sign = {}
    for c in range(1, 5):
        at = got[(got["vec_id"] == 10) & (got["component"] == c)].iloc[0]["whitened"]
        sign[c] = np.sign(at) * np.sign(next(w for i, _, _, w in want if i == 10)[c - 1])
    wide = got.assign(whitened=got["whitened"] * got["component"].map(sign))
    have = sorted(key(i, w) for i, w in ((g["vec_id"].iloc[k], g["whitened"].to_numpy()[k : k + 4]) for g in [wide] for k in range(0, len(g), 4)))
    assert np.allclose(np.array(have), np.array(sorted(key(i, w) for i, _, _, w in want)), atol=2e-6)
    assert set(zip(got["vec_id"].fillna(-1), got["n"], got["deviation"])) == {(-1 if i is None else i, n, d) for i, n, d, _ in want}


def test_whitening_is_the_same_for_any_partitions(spark):
    rows = clustered_vectors(300, width=16)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    one = whitening.whitened(frame.coalesce(1)).orderBy("vec_id", "component").toPandas()
    many = whitening.whitened(frame.repartition(23), fan=3).orderBy("vec_id", "component").toPandas()
    assert np.allclose(one["whitened"], many["whitened"], atol=1e-8) and one["deviation"].equals(many["deviation"])


def test_directions_without_variance(spark):
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(20)], "vec_id long, embedding array<float>")
    got = whitening.whitened(line).toPandas()
    assert set(got["component"]) == {1} and np.allclose(got["explained"], 1) and len(got) == 20
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert whitening.whitened(same).count() == 0


def test_deviations_beyond_a_long_are_null(spark):
    frame = spark.createDataFrame([(i, [1e15 * i, 1.0]) for i in range(10)], "vec_id long, embedding array<double>")
    got = whitening.whitened(frame, components=1).orderBy("vec_id").toPandas()
    assert got["deviation"].isna().all() and np.allclose(got["whitened"], (np.arange(10) - 4.5) / np.arange(10).std())


@pytest.mark.parametrize("query", [centroids.op12_centroids, whitening.op13_whitening])
def test_no_vectors(spark, tmp_path, query):
    assert query(spark, vectors_table(spark, tmp_path, [])).count() == 0
    assert query(spark, vectors_table(spark, tmp_path / "nulls", [(1, None), (2, [None] * 64)])).count() == 0

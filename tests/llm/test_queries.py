"""The registered queries and the pipeline as they return, against brute force.

The tables hold nulls in every column that may be null, empty texts, repeated rows, ties, and columns whose names clash
with those that operators make; the empty folder holds the same tables without rows.
"""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import ODD, brute_base, brute_components, prose

import corpus_pipeline
from voxstrata.llm import bpe, quality, registry

SHARED = "This very line stands in four documents"
ITEM = prose("item", 24)
CLASHING = "id long, label int, score double, component_id long, n_words long, keep string, __maybe boolean"


def texts():
    out = list(ODD)
    for i in range(200):
        text = prose(i, 50)
        if i % 4 == 0:
            text += " vile rotten " + prose(i + 1000, 10)
        if i % 5 == 1:
            text = "buy !!! now ### " * (5 + i % 7) + text
        out.append(text)
    for i in range(4):
        out.append(f"{prose(300 + i, 30)}\n  {SHARED.upper() if i % 2 else SHARED}\t\n{prose(400 + i, 30)}")
    base = prose(500, 150).split()
    for i in range(5):
        out.append(" ".join(base[: 7 * i] + ["changed"] + base[7 * i + 1 :]))
    words = ITEM.split()
    out += [f"{prose(600, 30)} {' '.join(words[4:16]).upper()}, {prose(601, 30)}", f"{prose(602, 30)} {' '.join(words[4:13])} {prose(603, 30)}", f"{prose(604, 30)} three short-words {prose(605, 30)}"]
    out += [f"{prose(606, 20)} mail someone@example.org or call +1 (555) 010-2030 {prose(607, 20)}", prose(608, 5000)]
    return out


TEXTS = texts()


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, len(t) if t is not None else None) for i, t in enumerate(TEXTS)]
    rows += [rows[20], rows[20], (None, prose(700, 40), None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHING.split(", "):
        name, kind = c.split(" ")
        docs = docs.withColumn(name, F.lit(None).cast(kind))
    labels = [(6 + i, int(i % 5 != 1), int(i % 4 == 0)) for i in range(200)] + [(None, 1, 1), (6, None, None), (99999, 0, 1)]
    items = [(1, ITEM), (2, "three short words"), (3, None), (4, ""), (None, prose(0, 50)), (12, ITEM)]
    r = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in r.standard_normal(6)]) for i in range(210)] + [(300, None), (350, [1.0, None]), (None, [1.0] * 6)]
    vectors += [(400 + i, vectors[50][1]) for i in range(8)]
    tables = {
        "documents": docs,
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")),
        "benchmark": spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0)),
        "pages": spark.createDataFrame([(1, "http://a.net/x", "h"), (None, None, None), (1, "http://a.net/x", "h")], "page_id long, url string, html string").withColumn("host", F.lit(1)),
        "embeddings": spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("norm", F.lit("x")).withColumn("block", F.lit("x")),
    }
    full, empty = (str(tmp_path_factory.mktemp(n)) for n in ("full", "empty"))
    for name, df in tables.items():
        df.repartition(3).write.parquet(f"{full}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return full, empty


@pytest.fixture(scope="module")
def found(spark, folders):
    """What a query returns, as lists of rows by doc_id, and its rows in all."""
    seen = {}

    def of(name):
        if name not in seen:
            by = defaultdict(list)
            for r in registry.QUERIES[name](spark, folders[0]).collect():
                by[r["doc_id"]].append(r)
            seen[name] = by
        return seen[name]

    return of


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute_lines(docs):
    """{doc_id: (lines, lines dropped, what stays)}"""
    holders = defaultdict(set)
    for i, t in docs.items():
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= 20:
                holders[key_of(line)].add(i)
    out = {}
    for i, t in docs.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key_of(x)]) < 3 or max(holders[key_of(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def brute_hits(text, items):
    """(words, words hit, items with a window in the text)"""
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, names = split(text), set(), set()
    for name, item in items:
        w = split(item)
        n = min(10, len(w))
        for j in range(len(w) - n + 1) if n else ():
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[j : j + n]:
                    hit.update(range(i, i + n))
                    names.add(str(name))
    return len(words), len(hit), sorted(names)


ITEMS = [(1, ITEM), (2, "three short words"), (12, ITEM)]


@pytest.fixture(scope="module")
def theirs():
    return public_coder("byte_bpe_multi_50k.tiktoken")


def public_coder(name):
    import public_tokenizers
    import tiktoken

    ranks = bpe.public_vocabulary(name).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name,modulus,remainder,caught", [("op1_toxicity", 4, 2, lambda i: i % 4 == 0), ("op10_quality", 5, 0, lambda i: i % 5 != 1)])
def test_classifiers(found, name, modulus, remainder, caught):
    got = found(name)
    assert set(got) == {None, *range(len(TEXTS))} and len(got[20]) == 3 and len({r["score"] for r in got[20]}) == 1
    for i, rows in got.items():
        for r in rows:
            assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % modulus == remainder)
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [i for i in range(200) if got[6 + i][0]["held_out"]]
    assert np.mean([got[6 + i][0]["predicted"] == caught(i) for i in held]) > 0.9


def test_op2(spark, folders):
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in registry.QUERIES["op2_topk"](spark, folders[0]).collect()}
    ok = {}
    for r in spark.read.parquet(f"{folders[0]}/embeddings.parquet").collect():
        if r["vec_id"] is not None and r["embedding"] and None not in r["embedding"]:
            ok[r["vec_id"]] = np.floor(256 * np.array(r["embedding"], float)).astype(int)
    want = {}
    for q in (i for i in ok if i % 50 == 0):
        for rank, (score, i) in enumerate(sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q)[:5], 1):
            want[q, rank] = (i, -score)
    assert got == want and len(want) == 6 * 5


def test_op3(found):
    got = found("op3_near_dup")
    root, size = brute_components(TEXTS)
    for i in range(len(TEXTS)):
        for r in got[i]:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (size[i], root[i], root[i] == i)
    assert len(got[20]) == 3 and len(set(root)) < len(TEXTS) and got[None][0]["kept"] and got[None][0]["component_id"] is None


def test_op4(found):
    got = found("op4_line_dedup")
    for i, (n, dropped, kept) in brute_lines(dict(enumerate(TEXTS))).items():
        assert all((r["n_lines"], r["n_dropped"], r["kept_sha256"]) == (n, dropped, sha(kept)) for r in got[i])
    assert sum(r["n_dropped"] for rows in got.values() for r in rows) == 3 and got[None][0]["n_dropped"] == 0


def test_op6(found, theirs):
    got = found("op6_bpe")
    for i, t in enumerate(TEXTS):
        ids = theirs.encode_ordinary(t or "")
        assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t or "")) for r in got[i])
    assert len(got[20]) == 3 and len(got[None]) == 1


def test_op7(found):
    got = found("op7_pii")
    for i, t in enumerate(TEXTS):
        base = brute_base(t or "")
        for r in got[i]:
            assert r["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
            assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[0] == k for x in base) for k in ("email", "ip", "card", "phone")]
            assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(","))
    assert sum(rows[0]["n_email"] + rows[0]["n_phone"] for rows in got.values()) == 2


def test_op8(found):
    got = found("op8_decontaminate")
    for i, t in enumerate(TEXTS):
        n, hit, names = brute_hits(t, ITEMS)
        assert all((r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(names), sha(",".join(names)), hit > 0) for r in got[i])
    assert sorted(rows[0]["n_hit"] for rows in got.values())[-3:] == [0, 3, 12]


def test_op9(spark, folders, found):
    got = found("op9_lm_score")
    assert sum(map(len, got.values())) == len(TEXTS) + 3 and all(np.isfinite(r["difference"]) for rows in got.values() for r in rows)


def test_op5(spark, folders):
    """Every answer at every length that occurs, from the public library's lengths."""
    coder = public_coder("byte_bpe_50k.tiktoken")
    lengths = np.array([len(coder.encode_ordinary(r["text"] or "")) for r in spark.read.parquet(f"{folders[0]}/documents.parquet").select("text").collect()])
    got = {r["context_limit"]: r for r in registry.QUERIES["op5_token_counts"](spark, folders[0]).collect()}
    assert set(got) == set(lengths.tolist())
    for limit, r in got.items():
        over = lengths[lengths > limit]
        want = ((lengths == limit).sum(), len(over), over.sum(), lengths.sum(), np.minimum(lengths, limit).sum())
        assert (r["n_docs"], r["docs_over"], r["tokens_over"], r["total_tokens"], r["truncated_total"]) == want
        assert abs(r["share_within"] - (lengths <= limit).mean()) < 1e-12


def test_pipeline(spark, folders, theirs):
    """Each stage against brute force on what the one before it kept; run returns the last stage's rows."""
    docs = spark.read.parquet(f"{folders[0]}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folders[0]).cache()
        seen.append((name, docs))
        assert name == "bpe" or docs.columns == columns
    (_, good), (_, lines), (_, single), (_, clean), (_, coded) = seen
    text_of = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    source = spark.read.parquet(f"{folders[0]}/documents.parquet")
    scores = quality.scored(source, quality.train(source, spark.read.parquet(f"{folders[0]}/labels.parquet"))).collect()
    assert sorted(r["doc_id"] or -1 for r in good.collect()) == sorted(r["doc_id"] or -1 for r in scores if r["score"] >= 0.3)
    left = text_of(good)
    want = {i: x[2] for i, x in brute_lines({i: t for i, t in left.items() if i is not None}).items()}
    after = text_of(lines)
    assert {i: t or "" for i, t in after.items() if i is not None} == want and all(r["n_chars"] == len(r["text"] or "") for r in lines.collect())
    ids = sorted(want)
    root, _ = brute_components([want[i] for i in ids], 80)
    kept = {i for place, i in enumerate(ids) if root[place] == place}
    assert set(text_of(single)) - {None} == kept and len(kept) < len(ids)
    clear = {i for i in kept if not brute_hits(want[i], ITEMS)[1]}
    assert set(text_of(clean)) - {None} == clear and len(clear) == len(kept) - 2
    last = {r["doc_id"]: r for r in coded.collect()}
    assert set(last) - {None} == clear
    for i in clear:
        assert np.frombuffer(last[i]["ids"], "<u4").tolist() == theirs.encode_ordinary(want[i]) and last[i]["decoded_sha256"] == sha(want[i])
    whole = corpus_pipeline.run(spark, folders[0]).collect()
    assert sorted(map(str, whole)) == sorted(map(str, coded.collect()))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, folders, name):
    assert registry.QUERIES[name](spark, folders[1]).count() == 0


def test_empty_pipeline(spark, folders):
    assert corpus_pipeline.run(spark, folders[1]).count() == 0

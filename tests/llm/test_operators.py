"""The training-data operators against brute force, on small tables with nulls, ties, repeats and long texts."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxstrata.llm import bpe, decontaminate, line_dedup, lm_score, near_dup, pii, quality, token_counts, toxicity, vector_search
from voxstrata.llm.common import Scratch
from voxstrata.llm.graph import components
from voxstrata.llm.words import ALNUM, PLAIN, Words

WORDS = [a + b for a in "ba de fi go lu ma ne po ri su ta vo".split() for b in "ba de fi go lu ma ne po ri su ta vo".split()]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


ODD = [None, "", " \n\t ", "one", "Ünï çödé x", "\n\n\n"]


def test_words_match_plain_splitting():
    texts = [t.encode() for t in ("Abc dEF  x\ty\n", "", "é1-2_ü z", "a" * 5000)]
    for table, pattern in ((PLAIN, rb"[^\x20\x09-\x0D]+"), (ALNUM, rb"[0-9a-z\x80-\xff]+")):
        w, seen = Words(texts, table), {}
        for i, t in enumerate(texts):
            own = re.findall(pattern, t.lower())
            assert len(own) == len(w.of(i))
            for x, h in zip(own, w.of(i)):
                assert seen.setdefault(x, h) == h
        assert len(set(seen.values())) == len(seen)


def test_line_dedup(spark, make):
    long = "This line is long enough to count"
    texts = [*ODD, f"{long}\nown line of the document 6", f"  {long.upper()} \nshort\nshort", f"{long}\n{long}", long, "only in two documents ok\nx", "only in two documents ok"]
    docs = make(texts)
    docs = docs.unionAll(docs.where("doc_id = 8"))  # a repeated row
    got = {r["doc_id"]: r for r in line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs), ["doc_id"]).collect()}
    assert got[6]["kept"] == b"own line of the document 6" and got[7]["kept"] == b"short\nshort" and got[8]["kept"] == b"" and got[8]["n_dropped"] == 2
    assert got[9]["kept"].decode() == long and got[10]["n_dropped"] == got[11]["n_dropped"] == 0
    for i, t in enumerate(ODD):
        assert got[i]["kept"] == (t or "").encode() and got[i]["n_lines"] == (t or "").count("\n") + 1
    staged = line_dedup.stage(spark, docs.withColumn("keep", F.lit(1)).withColumn("n_dropped", F.lit(2)), "")
    assert staged.columns == [*docs.columns, "keep", "n_dropped"] and staged.count() == docs.count()
    assert line_dedup.stage(spark, docs.limit(0), "").count() == 0


def test_line_dedup_hot_line_over_many_partitions(make):
    line = "a line that every document holds"
    docs = make([f"{line}\n{i} is the rest of the text" for i in range(300)]).repartition(7)
    gone = line_dedup.dropped_lines(docs, partitions=13)
    assert gone.count() == 299 and gone.where("doc_id = 299").count() == 0


def brute_components(texts, similar=85):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        n = min(5, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= similar * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def test_near_dup(spark, make):
    r, texts = random.Random(5), [*ODD, "one", "ONE"]
    for g in range(12):
        base = prose(g, 120).split()
        for _ in range(8):
            own = list(base)
            for _ in range(r.randrange(4)):
                own[r.randrange(len(own))] = r.choice(WORDS)
            texts.append(" ".join(own))
    texts += [prose(99, 3000)] * 3
    docs = make(texts)
    got = {x["doc_id"]: x for x in near_dup.near_duplicates(docs, block=4).collect()}
    root, size = brute_components(texts)
    assert [got[i]["component_id"] for i in range(len(texts))] == root
    assert [got[i]["n_shingles"] for i in range(len(texts))] == size
    kept = near_dup.stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == len(set(root))
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_stage_drops_copies_from_four_fifths_on(spark, make):
    """Pairs between 0.80 and 0.85 are near copies to the pipeline's stage, not to op3; pairs under 0.80 are to neither."""
    texts = []
    for g in range(40):
        own = [f"w{g}x{i}" for i in range(104)]  # 100 shingles; k words apart in the middle change 5 * k of them
        copy = list(own)
        for i in range(2 if g < 30 else 3):
            copy[10 + 20 * i] += "changed"
        texts += [" ".join(own), " ".join(copy)]  # 90 of 110 and 85 of 115
    docs, stage = make(texts), dict(corpus_pipeline.STAGES)["near_dedup"]
    assert {r["doc_id"] for r in stage(spark, docs, "").collect()} == {i for i in range(80) if i % 2 == 0 or i >= 60}
    assert near_dup.near_duplicates(docs, similar=85).where("doc_id <> component_id").count() == 0


def test_distance_follows_the_similarity():
    assert near_dup.allowed(85) == (23, 12)
    distance, chunks = near_dup.allowed(80)
    assert distance > 23
    keys, r = near_dup.key_columns(64, distance, chunks), random.Random(0)
    for _ in range(200):
        wrong = set(r.sample(range(64), distance))
        assert any(not wrong & set(k) for k in keys)


def test_keys_cover_every_allowed_set_of_errors():
    keys = near_dup.key_columns(64, 23, 12)
    r = random.Random(0)
    for _ in range(200):
        wrong = set(r.sample(range(64), 23))
        assert any(not wrong & set(k) for k in keys)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)]
    table = spark.createDataFrame(edges, "u long, v long")
    got, once = ({x["id"]: x["component"] for x in components(table.repartition(5), Scratch(spark, "t"), at_once=n).collect()} for n in (0, 10**6))
    assert got == once
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for a, c in got.items():
        seen, todo = {a}, [a]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert c == min(seen)


def test_decontaminate(spark, make):
    item, short = prose(7, 30), "tiny Item here"
    bench = spark.createDataFrame([(1, item), (2, short), (3, ""), (4, None), (12, item)], "item_id long, text string")
    w = item.split()
    texts = [*ODD, prose(8, 40), prose(9, 30) + " " + " ".join(w[5:20]) + "! " + prose(10, 30), "so TINY, item. Here it is", " ".join(w[:9])]
    docs = make(texts)
    for limit in (10**6, 20):  # in one slice and in several
        got = {r["doc_id"]: r for r in decontaminate.matches(docs, bench, bench_words=limit).collect()}
        assert got[7]["n_hit"] == 15 and got[7]["items"] == [1, 12] and got[7]["spans"][0]["start"] == 30 and got[7]["spans"][0]["words"] == 15
        assert got[8]["n_hit"] == 3 and got[8]["items"] == [2]
        assert all(got[i]["n_hit"] == 0 for i in (*range(7), 9))
        clean = decontaminate.without_contaminated(docs, bench, bench_words=limit)
        assert sorted(r["doc_id"] for r in clean.collect()) == [*range(7), 9] and clean.columns == docs.columns


def test_decontaminate_equal_words_stay_linear(spark, make):
    """Long runs of one word on both sides: no product of their lengths."""
    began = time.time()
    bench = decontaminate.Suffixes.of([1, 2], [b"na " * 1000, b"na " * 400 + b"ba " + b"na " * 700], 10)
    shard = decontaminate.Shard(Words([b"na " * 20000, b"x " + b"na " * 450 + b"ba " + b"na " * 30 + b"y"], ALNUM))
    window, at = shard.matches(bench)
    assert len(at) < 22000 and time.time() - began < 5
    docs = make(["na " * 20000, "x " + "na " * 450 + "ba " + "na " * 30 + "y"])
    got = {r["doc_id"]: r for r in decontaminate.matches(docs, spark.createDataFrame([(1, "na " * 1000), (2, "na " * 400 + "ba " + "na " * 700)], "item_id long, text string")).collect()}
    assert got[0]["n_hit"] == 20000 and got[0]["items"] == [1, 2] and [s["words"] for s in got[0]["spans"]] == [1000] * 20 + [180]
    assert got[1]["n_hit"] == 481 and [(s["start"], s["words"]) for s in got[1]["spans"]] == [(1, 450), (442, 40)] and got[1]["spans"][1]["item_id"] == 2


def test_longest_matches_by_brute_force():
    r = random.Random(3)
    items = [" ".join(r.choice("abc") for _ in range(r.randrange(3, 40))) for _ in range(30)]
    bench = decontaminate.Suffixes.of(list(range(30)), [x.encode() for x in items], 4)
    text = " ".join(r.choice("abc") for _ in range(300))
    words, w = Words([text.encode()], ALNUM), text.split()
    window, at = decontaminate.Shard(words).matches(bench)
    long = [x.split() for x in items if len(x.split()) >= 4]
    for d, p in zip(window, at):
        if bench.length[d] < 4:
            continue
        best = max(next((k for k in range(min(len(i) - s, len(w) - p) + 1) if k == min(len(i) - s, len(w) - p) or i[s + k] != w[p + k])) for i in long for s in range(len(i) - 3))
        assert bench.longest(int(d), words.of(0)[p:])[1] == best


def test_shard_time_hardly_depends_on_the_benchmark():
    r = np.random.default_rng(4)
    say = lambda n: b" ".join(b"w%d" % k for k in r.integers(0, 20000, n))
    text, spent = say(100_000), []
    for n in (200, 10_000):  # items of 100 words
        items = [say(100) for _ in range(n)]
        items[7] = b" ".join(text.split()[500:600])
        bench = decontaminate.Suffixes.of(list(range(n)), items, 10)
        shard = decontaminate.Shard(Words([text], ALNUM))
        times = []
        for _ in range(3):
            began = time.perf_counter()
            window, at = shard.matches(bench)
            times.append(time.perf_counter() - began)
        assert list(at) == list(range(500, 591)) and set(bench.item_of[bench.start[window]]) == {7}
        spent.append(min(times))
    assert spent[1] < 4 * spent[0] + 0.05  # 50 times the benchmark


def test_suffix_array_orders_suffixes():
    r = np.random.default_rng(0)
    ranks = r.integers(1, 4, 200)
    order = decontaminate.suffix_array(ranks)
    suffixes = [tuple(ranks[i : i + 16]) for i in order]
    assert suffixes == sorted(suffixes) and sorted(order) == list(range(200))


def test_bpe_is_tiktoken(make):
    import public_tokenizers
    import tiktoken

    vocabulary = bpe.public_vocabulary("byte_bpe_multi_50k.tiktoken")
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    texts = [*ODD, prose(3, 500), "x" * 3000, "<|endoftext|> it's 12½ 日本語 🙂\x1c\x85"]
    for r in bpe.round_trip(make(texts), vocabulary).collect():
        text = texts[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == theirs.encode_ordinary(text) and r["bytes"] == text.encode()


def test_perfect_hash_is_minimal():
    entries = {f"k{i}".encode(): str(i).encode() for i in range(5000)}
    h = bpe.PerfectHash(entries)
    assert sorted(h.keys) == sorted(entries) and all(h.get(k) == v for k, v in entries.items()) and h.get(b"none") is None


def test_token_counts(make):
    docs = make([*ODD, prose(1, 20), prose(2, 20), prose(3, 700)])
    vocabulary = bpe.public_vocabulary("byte_bpe_50k.tiktoken")
    coder = bpe.Coder(vocabulary)
    lengths = np.array([coder.count(r["text"] or "") for r in docs.collect()])
    histogram = token_counts.length_histogram(docs, vocabulary)
    for r in token_counts.limits(histogram, span=16).collect():
        assert r["docs_over"] == (lengths > r["context_limit"]).sum() and r["truncated_total"] == np.minimum(lengths, r["context_limit"]).sum()
    assert token_counts.quantile(histogram, 0.5) == sorted(lengths)[(len(lengths) + 1) // 2 - 1]


def test_top_k(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.standard_normal(8) * r.choice([0.3, 1, 4])]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 8), (2150, []), (2200, [1.0, 2.0]), (2250, [0.0] * 8)]
    df = vector_search.prepared(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in vector_search.top_k(df.where("vec_id % 50 = 0"), df, block=32, chunk=4).collect()}
    ok = {i: np.floor(256 * np.pad(np.array(v, np.float32).astype(float), (0, 8 - len(v)))) for i, v in rows if v and None not in v and np.isfinite(v).all()}
    n = 0
    for q in (i for i in ok if i % 50 == 0):
        best = sorted(((-int(ok[q] @ ok[c]), c) for c in ok if c != q))[:5]
        for rank, (s, c) in enumerate(best, 1):
            assert got[q, rank] == (c, -s)
            n += 1
    assert n == len(got)


def test_top_k_ships_only_visited_blocks(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.standard_normal(8) * 10 / (1 + i)]) for i in range(600)]  # lengths fall quickly
    df = vector_search.prepared(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1 << 16)
    dealt = df.withColumn("block", F.expr("int(vec_id div 50)"))
    longest = np.array([x["m"] for x in dealt.groupBy("block").agg(F.max("norm").alias("m")).orderBy("block").collect()])
    asked = df.where("vec_id < 50").withColumns({"chunk": F.expr("int(vec_id div 25)"), "floor": F.col("norm") * float(longest[3])})
    asked = asked.unionAll(df.limit(0).withColumns({"chunk": F.lit(0), "floor": F.lit(0.0)}))
    sent = spark.sparkContext.broadcast(longest)
    got = vector_search.shipped(asked, dealt, sent)
    assert sorted((x["chunk"], x["block"]) for x in got.select("chunk", "block").distinct().collect()) == [(c, b) for c in range(2) for b in (1, 2, 3)]
    assert got.count() == 2 * 3 * 50 < 2 * 600


def test_top_k_takes_no_more_rows_back_from_python(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in np.round(v / np.linalg.norm(v), 2)]) for i, v in enumerate(r.standard_normal((1200, 8)))]  # lengths alike: all blocks are open
    df = vector_search.prepared(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    plain = type(df).mapInPandas

    def watched(self, work, schema, *more, **named):
        def counted(frames):
            taken = 0

            def told():
                nonlocal taken
                for f in frames:
                    taken += len(f)
                    yield f

            for f in work(told()):
                assert len(f) <= taken, f"{len(f)} rows held at a time for {taken}"
                yield f

        return plain(self, counted, schema, *more, **named)

    monkeypatch.setattr(type(df), "mapInPandas", watched)
    found = vector_search.top_k(df.where("vec_id % 50 = 0"), df, block=8, chunk=7).collect()
    x = {i: np.floor(256 * np.array(v)) for i, v in rows}
    want = {q: sorted((-int(x[q] @ x[c]), c) for c in x if c != q)[:5] for q in x if q % 50 == 0}
    assert {(f["query_id"], f["rank"], f["vec_id"], f["score"]) for f in found} == {(q, n + 1, c, -s) for q, best in want.items() for n, (s, c) in enumerate(best)}
    assert len(found) == 5 * len(want)


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_top_of_block_is_brute_force(kind):
    r = np.random.default_rng(9)
    for width, spread in ((3, 4), (40, 30), (40, 1)):
        c = r.integers(-spread, spread + 1, (300, width)) * r.choice([1, 2, 5], (300, 1))
        c[50:90] = c[7]  # ties
        q = np.concatenate([c[:60], c[:20], np.zeros((1, width), int)])
        c_ids = np.concatenate([r.permutation(290), r.integers(0, 290, 10)])  # some ids repeated
        q_ids = np.concatenate([c_ids[:60], c_ids[100:120], [1000]])
        full = q @ c.T
        kth = np.sort(np.where(q_ids[:, None] == c_ids, -(10**6), full), axis=1)[:, -6].astype(float)
        for floors in (np.full(len(q), -np.inf), kth, np.where(np.arange(len(q)) % 3, kth, -np.inf), kth + 1e9):
            got = vector_search.top_of_block(q_ids, q.astype(kind), np.sqrt((q * q).sum(1)), floors, c_ids, c.astype(kind), np.sqrt((c * c).sum(1)), 5, piece=32, at_once=16)
            want = [(q_ids[i], -s, v) for i in range(len(q)) for s, v in sorted((-full[i, j], c_ids[j]) for j in range(300) if c_ids[j] != q_ids[i] and full[i, j] >= floors[i])[:5]]
            assert sorted(zip(got["query_id"], got["score"], got["vec_id"])) == sorted(want)


def test_top_of_block_bounds_hold_when_rounded():
    r = np.random.default_rng(10)
    for size in np.geomspace(1e3, 1e7, 60):
        q = np.floor(r.standard_normal(40) * size)
        q[16:] = r.choice([-1, 1], 24) * r.integers(1, 4, 24)
        near = np.concatenate([q[:16] + np.floor(r.standard_normal(16) * size / 10), q[16:] * 2])  # the bound over the other coordinates is met
        c = np.concatenate([np.repeat(near[None], 7, 0), np.floor(r.standard_normal((20, 40)) * size / 10)])
        got = vector_search.top_of_block(np.array([100]), q[None], np.sqrt([q @ q]), np.array([q @ near]), np.arange(27), c, np.sqrt((c * c).sum(1)), 5)
        assert sorted(got["vec_id"]) == list(range(5))


def test_pii_base_and_bootstrap(make):
    known = [f"please call agent {prose(i, 3)} ring desk +1 (555) 010-{1000 + i} before noon {prose(i + 50, 5)}" for i in range(12)]
    texts = [*known, "ring desk 555-0199-77 before noon today", "mail x.y@a-b.co.uk, ip 1.2.3.4 not 1.2.3.400 card 4111 1111 1111 1111 or 4111 1111 1111 1112", *ODD]
    got = {(r["doc_id"], r["kind"], r["base"]): (r["start"], r["end"]) for r in pii.spans(make(texts)).collect()}
    assert all((i, "phone", True) in got for i in range(12))
    start = texts[12].index("555")
    assert got[12, "phone", False] == (start, start + len("555-0199-77"))
    t = texts[13]
    for kind, what in (("email", "x.y@a-b.co.uk"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111")):
        assert got[13, kind, True] == (t.index(what), t.index(what) + len(what))
    assert sum(k[0] == 13 for k in got) == 3 and not any(k[0] > 13 for k in got)


def test_pii_finds_unseen_ones_among_many(make):
    """Half of the identifiers in a context are unseen; secrets go by key names; texts without such contexts get nothing."""
    seen = [f"{prose(i, 6)} tel: +1 (555) 010-{1000 + i} {prose(i + 90, 4)}" for i in range(14)]
    unseen = [f"{prose(i, 6)} tel: {20 + i} 555 {7000 + i} {prose(i + 90, 4)}" for i in range(14)]
    keyed = [f'{prose(i, 5)} secret_key = "{hashlib.sha1(str(i).encode()).hexdigest()}" {prose(i + 70, 3)}' for i in range(12)]
    odd = [f'{prose(i, 5)} secret_key = "Zq{i}x-{i * 7919}kk-77ab" {prose(i + 70, 3)}' for i in range(9)]
    clean = [f"{prose(i, 8)} {1900 + i} {prose(i + 30, 3)} room 1234{i}" for i in range(40)]
    texts = [*seen, *unseen, *keyed, *odd, *clean]
    added = {(r["doc_id"], r["kind"]): texts[r["doc_id"]][r["start"] : r["end"]] for r in pii.spans(make(texts)).where("NOT base").collect()}
    want = {(14 + i, "phone"): f"{20 + i} 555 {7000 + i}" for i in range(14)}
    want |= {(28 + i, "secret"): hashlib.sha1(str(i).encode()).hexdigest() for i in range(12)} | {(40 + i, "secret"): f"Zq{i}x-{i * 7919}kk-77ab" for i in range(9)}
    assert added == want


def test_pii_formats_alone_mark_nothing(make):
    """Digests that share no context stay; those withheld from the seeds are found by what stands before them."""
    digest = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    alone = [f"{prose(i * 37 + 5, 4)} w{i}q {digest(i)} v{i}z {prose(i + 9, 3)}" for i in range(20)]
    assert pii.spans(make(alone)).count() == 0
    keyed = [f'{prose(i, 5)} token = "{digest(i)}" {prose(i + 70, 3)}' for i in range(40)]
    withheld = [i for i in range(40) if zlib.crc32(digest(i).encode()) % pii.WITHHELD == 0]
    got = {(r["doc_id"], r["kind"], r["start"], r["end"]) for r in pii.spans(make(keyed)).collect()}
    assert got == {(i, "secret", t.index(digest(i)), t.index(digest(i)) + 32) for i, t in enumerate(keyed)} and len(withheld) > 5


def test_pii_withheld_secrets_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    said = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    want = {(i, m.start(1), m.end(1)) for i, t in said.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    withheld = {x for x in want if zlib.crc32(said[x[0]][x[1] : x[2]].encode()) % pii.WITHHELD == 0}
    got = {(r["doc_id"], r["start"], r["end"]) for r in pii.spans(docs).where("NOT base").collect()}
    assert withheld and withheld <= got and got == want


def brute_base(text):
    """Base spans by the plain patterns, as (kind, start, end)."""
    out = []
    for kind, pattern in {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    order = ("email", "ip", "card", "phone")
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


def test_op7_base_columns(spark):
    """The registered query against the plain patterns, on all given documents."""
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.op7_pii(spark, sf).collect():
        base = brute_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[0] == k for x in base) for k in ("email", "ip", "card", "phone")]
        assert r["n_spans"] == len(base) + r["n_added"] == len([x for x in r["spans"].split(",") if x])
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(","))


def labelled(spark, make, bad, column):
    texts = [prose(i, 60) if i % 4 else bad(i) for i in range(400)] + [None, ""]
    labels = spark.createDataFrame([(i, int((i % 4 == 0) == (column == "toxic"))) for i in range(400)], f"doc_id long, {column} int")
    return make(texts), labels


def test_toxicity_held_out(spark, make):
    docs, labels = labelled(spark, make, lambda i: prose(i, 40) + " vile rotten " + prose(i + 1, 20), "toxic")
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, toxicity.train(docs, labels)).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(scores[i] >= 0.3) == (i % 4 == 0) for i in held]) > 0.97 and 0 <= scores[400] == scores[401] < 0.3
    none = toxicity.train(docs, labels.limit(0))
    assert none.score(iter([np.empty(0, np.uint64)]))[0] < 0.01


def test_classifiers_with_repeated_ids_and_without_telling_words(spark, make):
    docs, labels = labelled(spark, make, lambda i: prose(i, 60), "toxic")  # nothing tells the toxic ones apart
    flat = toxicity.train(docs, labels)
    assert not len(flat.words) and {round(r["score"], 6) for r in toxicity.scored(docs, flat).collect()} == {round(1 / (1 + np.exp(-flat.bias)), 6)}
    docs, labels = labelled(spark, make, lambda i: prose(i, 40) + " vile rotten " + prose(i + 1, 20), "toxic")
    hot = docs.unionAll(docs.where("doc_id = 4").crossJoin(spark.range(300)).drop("id"))  # one id many times
    own = labels.selectExpr("doc_id", "toxic AS quality", "toxic")
    for train in (toxicity.train, quality.train):
        kind = {"positives": 50, "unlabelled": 60} if train is toxicity.train else {"sample": 50}
        once, often = train(docs, own, **kind), train(hot, own, **kind)
        for x, y in zip(vars(once).values(), vars(often).values()):
            assert np.array_equal(x, y)
        train(docs, own, most_bytes=2000)
        train(docs.limit(0), own)
        train(docs, own.where("toxic = 1"))


def dense_votes(voters, rows):
    """Scores with all cosines written out in Python's whole numbers, and neighbours by full sorting."""
    out = []
    axes, vectors = voters.axes.astype(int).tolist(), voters.vectors.astype(int).tolist()
    for found, counts in rows:
        v = [0] * len(axes[0])
        for f, c in zip(found, counts):
            for i in np.flatnonzero(voters.vocabulary == f):
                w = round((1 + math.log(c)) * voters.idf[i] * quality.WEIGHT_STEPS)
                v = [a + w * b for a, b in zip(v, axes[i])]
        most = max(map(abs, v)).bit_length()
        v = [round(a * 2.0 ** (22 - most)) for a in v]
        norm = math.sqrt(sum(a * a for a in v)) or 1.0
        v = [round(a / norm * quality.UNIT_STEPS) for a in v]
        assert abs(math.hypot(*v) / quality.UNIT_STEPS - 1) < 1e-5 or not any(v)
        near = [round(sum(a * b for a, b in zip(v, u)) * quality.STEPS / quality.UNIT_STEPS**2) for u in vectors]
        top = sorted(range(len(near)), key=lambda j: (-near[j], j))[: quality.NEIGHBOURS]
        w = [max(near[j] / quality.STEPS, 0) ** quality.SHARPNESS for j in top]
        out.append(sum(a * voters.labels[j] for a, j in zip(w, top)) / sum(w) if sum(w) else voters.share)
    return out


def test_quality_votes_are_those_of_all_cosines(spark, make):
    docs, labels = labelled(spark, make, lambda i: prose(i, 50) + " Xx!!" * (i % 9), "quality")
    voters = quality.train(docs, labels)
    texts = [(r["text"] or "").encode() for r in docs.orderBy("doc_id").collect()]
    rows = list(quality.terms(texts))
    got = voters.score(rows)
    assert np.abs(got - dense_votes(voters, rows)).max() < 1e-9
    again = voters.score(rows[:1] * 3 + rows[::-1])
    assert np.array_equal(again[:3], got[[0, 0, 0]]) and np.array_equal(again[3:][::-1], got)  # whatever else is in the block


def test_toxicity_risk_is_the_dense_one():
    """The classifier's loss at its end is below that of the prior alone, by a dense version of the estimator."""
    r = np.random.default_rng(1)
    vocabulary = np.sort(r.integers(0, 2**63, 40).astype(np.uint64))
    draw = lambda p: np.sort(vocabulary[r.random(40) < p])
    bad, good = np.where(np.arange(40) < 8, 0.7, 0.3), np.full(40, 0.3)
    positive, unlabelled = [draw(bad) for _ in range(300)], [draw(bad if i % 5 == 0 else good) for i in range(900)]
    model = toxicity.fit(positive, unlabelled, 0.2)
    dense = lambda sets: np.array([model.bias + sum(model.weights[model.words == x].sum() for x in s) for s in sets])
    assert np.allclose(1 / (1 + np.exp(-dense(positive[:50]))), model.score(iter(positive[:50])))
    risk = lambda zp, zu: 0.2 * np.logaddexp(0, -zp).mean() + max(0, np.logaddexp(0, zu).mean() - 0.2 * np.logaddexp(0, zp).mean())
    flat = np.log(0.25)
    assert risk(dense(positive), dense(unlabelled)) < 0.85 * risk(np.full(300, flat), np.full(900, flat))


def noisy(i):
    r = random.Random(i)
    return " ".join([prose(i, 20), *(f"bad{k}" for k in range(12) if r.random() < (0.5 if i % 4 == 0 else 0.12)), *(f"good{k}" for k in range(12) if r.random() < 0.4)])


def test_toxicity_risk_is_over_all_documents(spark, make):
    """Few documents for the curvature lead to about the risk that all of them give; sums are those of a dense loss."""
    docs = make([noisy(i) for i in range(900)])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 900, 3)], "doc_id long, toxic int")
    few, every = toxicity.train(docs, labels, unlabelled=150), toxicity.train(docs, labels)
    assert np.array_equal(few.words, every.words) and len(every.words) >= 8
    sets = list(toxicity.word_sets([noisy(i).encode() for i in range(900)]))
    own = [toxicity._columns(s, every.words) for s in sets]
    mine = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 != 2]
    p, u = toxicity.Rows([own[i] for i in mine if i % 12 == 0]), toxicity.Rows([own[i] for i in mine])
    prior = np.mean([i % 4 == 0 for i in mine if i % 3 == 0])

    def risk(theta):
        zp = p.times(theta[:-1]) + theta[-1]
        return prior * np.logaddexp(0, -zp).mean() + max(0, u.as_zero(theta)[0] - prior * np.logaddexp(0, zp).mean())

    alone = toxicity.descend(p, toxicity.Rows([own[i] for i in mine[:150]]), toxicity._flat(len(every.words), prior), prior, 200)
    theta = np.append(every.weights, every.bias)
    found = risk(np.append(few.weights, few.bias))
    assert found < 1.15 * risk(theta) and found < 0.8 * risk(alone)
    sent = spark.sparkContext.broadcast(every.words)
    packed = docs.selectExpr("CAST(text AS binary) AS text").mapInPandas(toxicity._packed(sent), "columns binary, sizes binary, counts binary")
    value, slope = toxicity.whole_risk(packed, theta, 900)
    dense = toxicity.Rows(own).as_zero(theta)
    assert abs(value - dense[0]) < 1e-6 and np.abs(slope - dense[1]).max() < 1e-6


def test_quality_held_out(spark, make):
    docs, labels = labelled(spark, make, lambda i: " ".join(w.upper() + "!!" for w in prose(i, 60).split()), "quality")
    voters = quality.train(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in quality.scored(docs, voters).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(scores[i] >= 0.3) == (i % 4 != 0) for i in held]) > 0.97 and 0 <= scores[400] <= 1
    kept = quality.good_rows(docs, voters)
    assert kept.columns == docs.columns and kept.count() == sum(s >= 0.3 for s in scores.values())
    assert quality.good_rows(docs, quality.train(docs, labels.limit(0))).count() == 402


def test_lm_score(spark, make):
    texts = [prose(i, 50) for i in range(20)] + [" ".join(["ba ba de"] * 20)] * 3 + [None, ""]
    docs = make(texts)
    got = {r["doc_id"]: r for r in lm_score.cross_entropy_difference(docs, spark.createDataFrame([(20,), (21,)], "doc_id long"), words=50).collect()}
    assert got[22]["difference"] < 0 < got[3]["difference"] and got[23]["n_tokens"] == 0 == got[24]["difference"]
    words = [(t or "").split() for t in texts]
    count = {}
    for w in (x for t in words for x in t):
        count[w] = count.get(w, 0) + 1
    h = {w: int(Words([w.encode()], ALNUM).hashes[0].view(np.int64)) for w in count}
    known = set(sorted(count, key=lambda w: (-count[w], h[w]))[:50])
    seq = [[w if w in known else "?" for w in t] for t in words]
    for k, docs_in in (("target_loss", (20, 21)), ("background_loss", [i for i in range(25) if i not in (20, 21)])):
        pair, hist, uni = {}, {}, {}
        for i in docs_in:
            for a, b in zip(["^", *seq[i]], seq[i]):
                pair[a, b] = pair.get((a, b), 0) + 1
                hist[a] = hist.get(a, 0) + 1
                uni[b] = uni.get(b, 0) + 1
        total, size = sum(uni.values()) + 51, 51
        p = lambda a, b: (pair.get((a, b), 0) + 50 * (uni.get(b, 0) + 1) / total) / (hist.get(a, 0) + 50)
        want = np.mean([-np.log(p(a, b)) for a, b in zip(["^", *seq[5]], seq[5])])
        assert got[5][k] == pytest.approx(want, rel=1e-5)
        assert size == 51


def test_lm_score_counts_every_word(spark, make):
    """Words far beyond the 2,047 most frequent are told apart, whether their bigrams are broadcast or joined."""
    common = [f"w{i}" for i in range(3000)]
    texts = [" ".join(common[i : i + 100] * 3) for i in range(0, 3000, 100)] + ["alpha rare1 beta", "alpha rare2 beta", "alpha rare1 beta"]
    good = spark.createDataFrame([(30,)], "doc_id long")
    seq = [t.split() for t in texts]
    grams = lambda docs: [(a, b) for i in docs for a, b in zip(["^", *seq[i]], seq[i])]
    size = len({w for t in seq for w in t}) + 1

    def loss(docs, i):
        pairs = grams(docs)
        pair, hist, uni = Counter(pairs), Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
        p = lambda a, b: (pair[a, b] + 50 * (uni[b] + 1) / (len(pairs) + size)) / (hist[a] + 50)
        return np.mean([-np.log(p(a, b)) for a, b in grams([i])])

    for head in (0, 5, 10**6):
        got = {r["doc_id"]: r for r in lm_score.cross_entropy_difference(make(texts), good, head=head, most_ids=0 if head == 5 else 10).collect()}
        assert len(got) == len(texts) and got[31]["difference"] > got[32]["difference"]
        for i in (0, 29, 30, 31, 32):
            assert got[i]["target_loss"] == pytest.approx(loss([30], i))
            assert got[i]["background_loss"] == pytest.approx(loss([x for x in range(33) if x != 30], i))


def test_digest_of_kept_text(spark, make):
    docs = make(["a\nb"])
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs), ["doc_id"]).select(F.sha2("kept", 256)).first()[0]
    assert kept == hashlib.sha256(b"a\nb").hexdigest()

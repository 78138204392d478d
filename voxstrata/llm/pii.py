"""PII by bootstrapped contextual extraction, in DataFrame and SQL functions only.

Four base patterns find emails, IP addresses, card and phone numbers. These are the seed entities, with secrets
(keys and access tokens) of well-known formats, but for those whose crc32 (of the lower-case instance) is a multiple of
``WITHHELD``: a third of them. What stands around them induces lexical patterns: two words before; a word before
and one after; a word before and the entity's shape; the nearest word with the signs between (``token = "``, ``tel: ``);
the signs on both sides with the shape. Patterns and the identifier-like strings that occur in them form a bipartite graph,
which is scored in rounds. A pattern's confidence in a kind is the score of its instances of that kind, as a share of those,
of the instances of other kinds, and of the unknown ones that cannot be of the kind by their characters (other unknown ones
count neither way); an instance's score is the noisy-or of its patterns' confidences; seeds stay at 1. Identifier-like
strings outside the base spans (white-space tokens, or groups of digits with single spaces between) in a pattern with enough
distinct instances and high confidence become further spans of its kind. Base spans always stay. A format marks nothing by
itself: a secret, seed or not, is a span only where a confident pattern says so, so the secrets that were withheld from the
seeds measure what the patterns find.

Positions come from a regular expression's matches and the pieces between them, summed up in a window over each
document's matches, so that a document with very many of them costs no more than their number. Repetitions are possessive
and start only where a match can start, which keeps them linear on long runs.

Defined cases: null and empty texts have no spans; repeated rows get equal results each; rows without a doc_id are handled
like others; other columns don't matter; words of more than ``REACH`` code points are in no context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
#: The base patterns, made possessive: they match what the plain ones match.
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: White-space tokens with a digit or an at sign, and groups of digits with single spaces between.
TOKEN = r"(?<!\S)(?:[^\s0-9@+(]*+[+(]?+[0-9][0-9().-]*+(?:\x20\(?+[0-9][0-9().-]*+)++\S*+|[^\s0-9@]*+[0-9@]\S*+)"
#: Formats of secrets (fixed values): hexadecimal digests and tokens, and prefixes of public services' keys.
SECRET = r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}|AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)$"
#: One secret of a known format in so many, by a hash, is no seed.
WITHHELD = 3
#: Code points on either side in which the words of a context are looked for, whole words only.
REACH = 256
#: Distinct instances that a pattern needs, its least confidence, an instance's least score, rounds, and the smoothing.
SUPPORT, CONFIDENT, SURE, ROUNDS, SMOOTH = 5, 0.8, 0.8, 3, 1.0


def _found(text: Column, pattern: str) -> Column:
    """The matches in order, each with the length of the piece before it and its context on both sides."""
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    rows = F.arrays_zip(matches.alias("m"), F.slice(pieces, F.lit(1), F.size(matches)).alias("b"), F.slice(pieces, F.lit(2), F.size(matches)).alias("a"))
    before = lambda b: F.when(F.length(b) > REACH, F.regexp_replace(F.right(b, F.lit(REACH)), r"^\S+", "")).otherwise(b)  # noqa: E731  without the word that the cut goes through
    after = lambda a: F.when(F.length(a) > REACH, F.regexp_replace(F.left(a, F.lit(REACH)), r"(?<!\S)\S+$", "")).otherwise(a)
    side = lambda r: F.struct(r["m"].alias("m"), F.length(r["b"]).alias("gap"), before(r["b"]).alias("left"), after(r["a"]).alias("right"))
    return F.transform(rows, side)


def _valid(kind: Column, m: Column) -> Column:
    """Whether a match of a base pattern counts."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    ip = F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    luhn = F.aggregate(
        F.sequence(F.lit(1), F.least(F.greatest(n, F.lit(1)), F.lit(19))),
        F.lit(0),
        lambda a, i: a + F.when(i % 2 == 0, F.element_at(F.array(*(F.lit(2 * d - 9 * (d > 4)) for d in range(10))), F.substring(F.reverse(digits), i, F.lit(1)).cast("int") + 1)).otherwise(F.substring(F.reverse(digits), i, F.lit(1)).cast("int")),
    )
    return F.when(kind == "email", F.lit(True)).when(kind == "ip", ip).when(kind == "card", n.between(12, 19) & F.when(n.between(12, 19), luhn % 10 == 0).otherwise(False)).otherwise(n.between(9, 15))


def _words(piece: Column, last: bool) -> Column:
    """Lower-case words of a piece, without signs at their ends, nearest first."""
    w = F.filter(F.transform(F.split(F.lower(piece), r"\s+"), lambda x: F.regexp_replace(x, r"^[^\p{L}0-9]+|[^\p{L}0-9]+$", "")), lambda x: x != "")
    return F.reverse(w) if last else w


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, version, kind, i, m, start, end, left, right): matches of the base patterns, and tokens as kind ''.

    start and end are code points, end exclusive. version is a hash of the text.
    """
    text = F.col("text")
    parts = []
    for kind, pattern in {**PATTERNS, "": TOKEN}.items():
        own = _found(text, pattern)
        need = NEEDS.get(kind)
        if need is not None:
            own = F.when(F.contains(text, F.lit(need)), own)
        parts.append(F.struct(F.lit(kind).alias("kind"), own.alias("found")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), "text").where("text rlike '[0-9@]'").select("doc_id", "version", F.explode(F.array(*parts)).alias("x"))
    rows = rows.select("doc_id", "version", "x.kind", F.posexplode("x.found").alias("i", "f")).select("doc_id", "version", "kind", "i", "f.*").dropDuplicates(["doc_id", "version", "kind", "i"])
    so_far = Window.partitionBy("doc_id", "version", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("m")
    end = F.sum(F.col("gap") + size).over(so_far)
    return rows.withColumn("end", end).select("doc_id", "version", "kind", "i", "m", (F.col("end") - size).alias("start"), "end", "left", "right")


def _patterns(found: DataFrame) -> DataFrame:
    """found with a row for each lexical pattern that an occurrence lies in."""
    shape = F.left(F.regexp_replace(F.regexp_replace(F.left("m", F.lit(REACH)), r"[0-9]+", "9"), r"\p{L}+", "a"), F.lit(16))
    worded = found.withColumn("l", _words(F.col("left"), True)).withColumn("r", _words(F.col("right"), False)).withColumn("shape", shape)
    l1, l2, r1 = F.try_element_at("l", F.lit(1)), F.try_element_at("l", F.lit(2)), F.try_element_at("r", F.lit(1))
    # the nearest word and the signs up to the entity; the signs alone on both sides
    signs, close = F.regexp_extract("left", r"([^\p{L}0-9]*)$", 1), F.regexp_extract("right", r"^([^\p{L}0-9\s]*)", 1)
    squeezed = F.regexp_replace(signs, r"\s+", " ")
    marked = F.length(F.trim(squeezed)) > 0
    both = F.array(
        F.concat(F.lit("before "), l2, F.lit(" "), l1),
        F.concat(F.lit("around "), l1, F.lit(" "), r1),
        F.concat(F.lit("shaped "), l1, F.lit(" "), F.col("shape")),
        F.when(marked, F.concat(F.lit("key "), l1, F.lit("|"), F.left(squeezed, F.lit(16)))),
        F.when(marked & (close != ""), F.concat(F.lit("between "), F.left(squeezed, F.lit(16)), F.lit("|"), F.left(close, F.lit(8)), F.lit("|"), F.col("shape"))),
    )
    return worded.withColumn("pattern", F.explode(F.filter(both, lambda p: p.isNotNull()))).drop("l", "r", "shape", "left", "right")


def _could_be(kind: Column, instance: Column) -> Column:
    """Whether an unknown instance may be of a kind by its characters alone."""
    digits, length = F.length(F.regexp_replace(instance, "[^0-9]", "")), F.length(instance)
    number = ~F.contains(instance, F.lit("@")) & ~instance.rlike(r"\p{L}")
    return (
        F.when(kind == "email", F.contains(instance, F.lit("@")))
        .when(kind == "ip", number & digits.between(4, 12) & F.contains(instance, F.lit(".")))
        .when(kind == "card", number & (digits >= 8))
        .when(kind == "phone", number & digits.between(5, 15))
        .otherwise((digits >= 2) & (length >= 12) & instance.rlike(r"\p{L}") & ~F.contains(instance, F.lit("@")))
    )


def seed_secret(core: str) -> Column:
    """Whether a string is of a secret's format and among those that serve as seeds."""
    return F.col(core).rlike(SECRET) & (F.crc32(F.lower(F.col(core)).cast("binary")) % WITHHELD != 0)


def score_graph(edges: DataFrame, seeds: DataFrame, scratch: Scratch, rounds: int = ROUNDS, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """Confidences (pattern, kind, confidence, support) and scores (instance, kind, score).

    edges: distinct (pattern, instance); seeds: distinct (instance, kind).
    """
    kinds = [*KINDS, "secret"]
    scores = seeds.withColumn("score", F.lit(1.0))
    confidences = None
    # unknown instances that cannot be of a kind, by pattern and kind; an instance with any score is known
    could = [F.sum((~_could_be(F.lit(k), F.col("instance"))).cast("int")).alias(k) for k in kinds]
    for _ in range(rounds):
        known = edges.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count_if(F.col("score") >= SURE).alias("support"))
        backed = known.where(F.col("support") >= support)
        of_all = known.groupBy("pattern").agg(F.sum("sum").alias("all"))
        unknown = edges.join(scores.select("instance").distinct(), "instance", "left_anti").join(backed.select("pattern").distinct(), "pattern", "left_semi").groupBy("pattern").agg(*could)
        against = F.coalesce(F.element_at(F.create_map(*(x for k in kinds for x in (F.lit(k), F.col(k)))), F.col("kind")), F.lit(0))
        told = backed.join(of_all, "pattern").join(unknown, "pattern", "left")
        confidences = scratch.write(told.select("pattern", "kind", (F.col("sum") / (F.col("all") + against + SMOOTH)).alias("confidence"), "support"))
        doubt = F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999))))
        trusted = edges.join(confidences.where(F.col("confidence") >= CONFIDENT), "pattern").where(_could_be(F.col("kind"), F.col("instance")))
        induced = trusted.groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("score"))
        before, scores = scores, scratch.write(induced.unionByName(seeds.withColumn("score", F.lit(1.0))).groupBy("instance", "kind").agg(F.max("score").alias("score")))
        if scores.count() == before.count():  # nothing new was found
            break
    return confidences, scores


def _free(tokens: DataFrame, taken: DataFrame) -> DataFrame:
    """The tokens that overlap no taken span; by one ordered pass over each text."""
    rows = tokens.withColumn("taken", F.lit(False)).unionByName(taken.select("doc_id", "version", "start", "end").withColumn("taken", F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy("doc_id", "version").orderBy("start")
    reaches = F.max(F.when(F.col("taken"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    begins = F.min(F.when(F.col("taken"), F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    marked = rows.withColumn("reaches", reaches).withColumn("begins", begins).where(~F.col("taken"))
    return marked.where((F.coalesce("reaches", F.lit(0)) <= F.col("start")) & (F.col("begins").isNull() | (F.col("begins") >= F.col("end")))).drop("taken", "reaches", "begins")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, version, kind, start, end, base): all spans. Kinds are the four base ones and ``secret``."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.write(occurrences(docs))
    base = found.where("kind <> ''").where(_valid(F.col("kind"), F.col("m")))
    # tokens that may be identifiers, without signs at their ends
    core = F.regexp_extract("m", r"[\p{L}0-9@+].*[\p{L}0-9]", 0)
    offset = F.instr("m", core) - 1
    digits = F.length(F.regexp_replace("m", "[^0-9]", ""))
    looks = (digits >= 5) | F.col("m").contains("@") | ((digits >= 2) & (F.length(core) >= 12))
    tokens = found.where("kind = ''").where(looks).withColumn("offset", F.when(core != "", offset)).where("offset IS NOT NULL").withColumn("core", core)
    begin = F.col("start") + F.col("offset")
    sides = F.concat("left", F.substring("m", F.lit(1), F.col("offset"))).alias("left"), F.concat(F.substring("m", F.col("offset") + F.length("core") + 1, F.length("m")), "right").alias("right")
    tokens = tokens.select("doc_id", "version", F.when(seed_secret("core"), "secret").otherwise("").alias("kind"), "i", F.col("core").alias("m"), begin.alias("start"), (begin + F.length("core")).alias("end"), *sides)
    in_patterns = scratch.write(_patterns(base.unionByName(_free(tokens, base))).select("doc_id", "version", "kind", "start", "end", F.lower("m").alias("instance"), "pattern"))
    edges = scratch.write(in_patterns.select("pattern", "instance").distinct())
    seeds = scratch.write(in_patterns.where("kind <> ''").select("instance", "kind").distinct())
    confidences, scores = score_graph(edges, seeds, scratch)
    trusted = confidences.where(F.col("confidence") >= CONFIDENT).select("pattern", "kind")
    sure = scores.where(F.col("score") >= SURE).select("instance", "kind", "score")
    seen = in_patterns.where("kind IN ('', 'secret')").drop("kind")
    named = seen.join(trusted, "pattern").join(sure, ["instance", "kind"])
    # an occurrence in patterns of several kinds takes the likeliest, then the first as listed
    rank = F.array_position(F.array(*map(F.lit, (*KINDS, "secret"))), F.col("kind"))
    best = named.groupBy("doc_id", "version", "start", "end").agg(F.min(F.struct(-F.col("score"), rank, F.col("kind").alias("kind")))["kind"].alias("kind"))
    columns = ("doc_id", "version", "kind", "start", "end")
    added = best.select(*columns)
    return base.select(*columns, F.lit(True).alias("base")).unionByName(added.withColumn("base", F.lit(False)))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the number of base spans of each kind, of added spans and of all, base_sha256, and the spans of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rank = F.array_position(F.array(*map(F.lit, (*KINDS, "secret"))), F.col("kind"))
    one = F.struct(F.col("start"), rank.alias("rank"), F.col("end"), F.col("base"), F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("said"))
    by_doc = spans(docs).groupBy(F.col("doc_id").alias("d"), F.col("version").alias("h")).agg(F.array_sort(F.collect_list(one)).alias("all"), *(F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS), F.count_if(~F.col("base")).alias("n_added"), F.count("*").alias("n_spans"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"))
    joined = rows.join(by_doc, rows["doc_id"].eqNullSafe(by_doc["d"]) & (rows["version"] == by_doc["h"]), "left")
    said = lambda which: F.coalesce(F.array_join(F.transform(which, lambda s: s["said"]), ","), F.lit(""))
    counts = (F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in (*(f"n_{k}" for k in KINDS), "n_added", "n_spans"))
    return joined.select("doc_id", *counts, F.sha2(said(F.filter("all", lambda s: s["base"])), 256).alias("base_sha256"), said(F.col("all")).alias("spans"))

"""URL filters by a tree of path templates for each host, with rules as labels.

Rules (a host and a path prefix, each to block or to allow) judge what they fit. All other urls are judged by templates that
are learned from the urls themselves, with the urls that rules judge as labels:

1. A path is cut into at most ``DEPTH`` segments (what is left over counts as the last one). Segments that vary by their
   form become marks: runs of digits ``#``, long hexadecimal strings ``$``, very long segments ``~``; endings like ``.html`` stay.
2. Top-down, a node of a host's tree whose children are many and mostly seen once is variable: its children, but for the
   frequent ones, become the wildcard ``*``.
3. Bottom-up, sibling branches are merged that a two-sample chi-square test cannot tell apart by what follows below them, and
   whose labels do not contradict each other. Each is held against the largest sibling not yet settled, in rounds until all are:
   a round settles the leader of every node that is left, so there are as many as the node of most groups has groups.
4. A template's purity is the share of blocked pages among its labelled ones, smoothed by ``WEIGHT`` pages of the share in all
   labels (at most a half, so that a template without labels is never rejected). Templates of a purity from ``PURITY`` on are rejected: their urls get the verdict block, all others allow.

Everything is counted over all pages, as joins and aggregates of a table with a row for each host and form of path. Sums are
aggregated before they are shuffled, and joins are inner or left ones on a table that has one row a key, whose large
partitions adaptive execution splits: one host may hold any share of the pages.

Defined cases: a null url, or one without ``://``, has an empty host and path, which form a template of their own; every row
gets a verdict, repeated ones the same; page_id may be null; without labels everything is allowed; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Levels of a tree.
DEPTH = 4
#: Children of a variable node at least; the share of its pages (one in so many) from which a child is frequent.
MANY, FREQUENT = 16, 20
#: Standard deviations by which branches, and the labels of branches, may differ.
APART = 3.0
#: Pages that smoothing counts for, and the purity from which a template is rejected.
WEIGHT, PURITY = 10.0, 0.8
#: The share that smoothing assumes at most: a template without labels is never rejected.
MOST_PRIOR = 0.5
#: Code points of a segment from which it is not looked at.
LONG = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEVELS = [f"s{i}" for i in range(1, DEPTH + 1)]


def host_path(url: Column) -> tuple[Column, Column]:
    """What comes after the first ``://`` up to a slash, question mark or hash, lower-cased; and from there up to the latter two."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, ties by the greater text; null where none fits. rules: up to some hundreds."""
    fits = [F.lit(None).cast("struct<long:int,rule:string,verdict:string>")] * 2
    for verdict, rule in rules:
        own, prefix = rule[: rule.index("/")], rule[rule.index("/") :]
        fits.append(F.when(((host == own) | host.endswith("." + own)) & path.startswith(prefix), F.struct(F.lit(len(rule)).alias("long"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.greatest(*fits)


def _form(segment: Column) -> Column:
    """A segment with what varies by its form replaced by a mark."""
    hexed = segment.rlike("^[0-9a-fA-F-]{16,}$") & segment.rlike("[0-9]")
    return F.when(F.length(segment) > LONG, "~").when(hexed & ~segment.rlike("^[0-9-]+$"), "$").otherwise(F.regexp_replace(segment, "[0-9]+", "#"))


def levels(path: Column) -> list[Column]:
    """The forms of a path's segments, each with a slash in front; empty strings beyond its end."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", DEPTH)
    rooted = path != ""
    return [F.when(rooted & (F.size(parts) >= i), F.concat(F.lit("/"), _form(F.get(parts, F.lit(i - 1))))).otherwise("") for i in range(1, DEPTH + 1)]


def _generalised(t: DataFrame, d: int) -> DataFrame:
    """t with the children of variable nodes at level d as a wildcard."""
    keys, own = ["host", *LEVELS[: d - 1]], LEVELS[d - 1]
    child = t.where(F.col(own) != "").groupBy(*keys, own).agg(F.sum("n").alias("pages"))
    node = child.groupBy(*keys).agg(F.count("*").alias("kinds"), F.count_if(F.col("pages") == 1).alias("once"), F.sum("pages").alias("all"))
    variable = node.where((F.col("kinds") >= MANY) & (2 * F.col("once") >= F.col("kinds")))
    stars = child.join(variable.select(*keys, "all"), keys).where(F.col("pages") * FREQUENT < F.col("all")).select(*keys, own, F.lit("/*").alias("star"))
    return t.join(stars, [*keys, own], "left").withColumn(own, F.coalesce("star", own)).drop("star")


def similar(x2: Column, freedom: Column, bad: Column, lab: Column, bad2: Column, lab2: Column) -> Column:
    """Whether two branches are alike by the statistic over what follows, and by their labels where both have some."""
    both = (lab > 0) & (lab2 > 0)
    share = (bad + bad2 + 1) / (lab + lab2 + 2)
    gap = bad / F.greatest(lab, F.lit(1)) - bad2 / F.greatest(lab2, F.lit(1))
    against = gap * gap > APART * APART * share * (1 - share) * (1 / F.greatest(lab, F.lit(1)) + 1 / F.greatest(lab2, F.lit(1)))
    return (x2 <= freedom + APART * F.sqrt(2.0 * freedom) + 1e-9) & ~(both & against)


def _merged(t: DataFrame, d: int, scratch: Scratch) -> DataFrame:
    """t with similar sibling branches at level d under one name."""
    keys, own, below = ["host", *LEVELS[: d - 1]], LEVELS[d - 1], LEVELS[d:]
    tails = t.where(F.col(own) != "").groupBy(*keys, own, *below).agg(F.sum("n").alias("a"), F.sum("bad").alias("bad"), F.sum("lab").alias("lab"))
    open_ = tails.groupBy(*keys, own).agg(F.sum("a").alias("c"), F.count("*").alias("kinds"), F.sum("bad").alias("bad"), F.sum("lab").alias("lab"))
    groups = None
    while True:
        node = open_.groupBy(*keys).agg(F.max_by(F.struct(F.col(own).alias("leader"), F.col("c").alias("c2"), F.col("kinds").alias("kinds2"), F.col("bad").alias("bad2"), F.col("lab").alias("lab2")), F.struct("c", own)).alias("l"), F.count("*").alias("left"))
        pairs = open_.join(node.where("left > 1").select(*keys, "l.*"), keys)
        theirs = tails.select(*keys, F.col(own).alias("leader"), *below, F.col("a").alias("b"))
        shared = tails.select(*keys, own, *below, "a").join(pairs, [*keys, own]).join(theirs, [*keys, "leader", *below], "left")
        b, root = F.coalesce("b", F.lit(0)), F.sqrt(F.col("c2") / F.col("c"))
        gap = F.col("a") * root - b / root
        facts = ["leader", "c", "c2", "kinds", "kinds2", "bad", "bad2", "lab", "lab2"]
        sums = shared.groupBy(*keys, own, *facts).agg(F.sum(gap * gap / (F.col("a") + b)).alias("x"), F.sum(b).alias("seen"), F.count("b").alias("both"))
        x2 = F.col("x") + F.col("c") / F.col("c2") * (F.col("c2") - F.col("seen"))  # the last is what only the leader has
        alike = similar(x2, F.col("kinds") + F.col("kinds2") - F.col("both") - 1, F.col("bad"), F.col("lab"), F.col("bad2"), F.col("lab2"))
        tested = scratch.write(sums.select(*keys, own, "leader", alike.alias("alike"), "c", "kinds", "bad", "lab"))
        found = tested.where("alike").select(*keys, own, "leader")
        groups = found if groups is None else groups.unionByName(found)
        open_ = tested.where("NOT alike").select(*keys, own, "c", "kinds", "bad", "lab")
        if open_.isEmpty():
            break
    several = groups.groupBy(*keys, "leader").agg(F.count("*").alias("size")).where("size > 1").drop("size")
    names = groups.join(several, [*keys, "leader"]).select(*keys, own, F.concat(F.lit("/{"), F.expr("substring(leader, 2)"), F.lit("}")).alias("name"))
    return t.join(names, [*keys, own], "left").withColumn(own, F.coalesce("name", own)).drop("name")


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, o1.., template, labelled, bad, purity, reject) for each form of path. pages: host, o1.. and blocked (null: no label)."""
    forms = [f"o{i}" for i in range(1, DEPTH + 1)]
    t = pages.groupBy("host", *forms).agg(F.count("*").alias("n"), F.count_if("blocked").alias("bad"), F.count("blocked").alias("lab"))
    t = scratch.write(t.select("host", *forms, *(F.col(o).alias(s) for o, s in zip(forms, LEVELS)), "n", "bad", "lab"))
    facts = t.agg(F.sum("bad").alias("b"), F.sum("lab").alias("l"), *(F.max(o).alias(o) for o in forms)).first()
    prior = min((facts["b"] or 0) / facts["l"], MOST_PRIOR) if facts["l"] else 0.0
    depth = sum(1 for o in forms if facts[o])  # levels that occur
    for d in range(1, depth + 1):
        t = scratch.write(_generalised(t, d))
    for d in range(depth, 0, -1):
        t = scratch.write(_merged(t, d, scratch))
    judged = t.groupBy("host", *LEVELS).agg(F.sum("bad").alias("t_bad"), F.sum("lab").alias("t_lab"))
    judged = judged.withColumn("purity", (F.col("t_bad") + F.lit(WEIGHT * prior)) / (F.col("t_lab") + WEIGHT))
    return scratch.write(t.join(judged, ["host", *LEVELS]).select("host", *forms, F.concat(*LEVELS).alias("template"), F.col("t_lab").alias("labelled"), F.col("t_bad").alias("bad"), "purity", (F.col("purity") >= PURITY).alias("reject")))


def filtered(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every row of pages (page_id, url)."""
    scratch = Scratch(pages.sparkSession, "url-filter")
    host, path = host_path(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule = ruled(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.getField("rule").alias("rule"), rule.getField("verdict").alias("said"), *(c.alias(f"o{i}") for i, c in enumerate(levels(F.col("path")), 1)))
    learned = templates(base.select("host", *(f"o{i}" for i in range(1, DEPTH + 1)), (F.col("said") == "block").alias("blocked")), scratch)
    out = base.join(learned, ["host", *(f"o{i}" for i in range(1, DEPTH + 1))])
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("reject"), "block").otherwise("allow")).alias("verdict"), "template", "purity")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page, and the template it was judged by."""
    return filtered(table(spark, sf_dir, "pages").select("page_id", "url"))

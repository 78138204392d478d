"""Exact token counts from a histogram of encoded lengths.

Documents are aggregated by length once; suffix sums over the histogram then answer, for every context limit, how many
documents are longer, what all tokens come to when each document is cut at the limit, and which share of documents fits.
The sums run in two levels (within spans of lengths, then over the spans' totals), so that no task sees the whole
histogram.

Defined cases: null and empty texts have length 0 and are counted; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Vocabulary, public_vocabulary, sent, token_count
from .common import Scratch, table

#: Lengths in a span.
SPAN = 4096


def length_histogram(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(length, n_docs), exact; written to the shared folder, so that texts are encoded once however often it is read."""
    words = sent(docs.sparkSession, vocabulary)
    return Scratch(docs.sparkSession, "token-counts").write(docs.select(token_count(F.col("text"), words).alias("length")).groupBy("length").agg(F.count("*").alias("n_docs")))


def limits(histogram: DataFrame, span: int = SPAN) -> DataFrame:
    """For each length that occurs, taken as a context limit, the answers of the histogram's suffix sums."""
    h = histogram.withColumn("span", F.expr(f"length div {span}")).withColumn("tokens", F.col("length") * F.col("n_docs"))
    totals = h.groupBy("span").agg(F.sum("n_docs").alias("span_docs"), F.sum("tokens").alias("span_tokens"))
    # one row a span: as many as the longest document has spans
    later = Window.orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select("span", *(F.coalesce(F.sum(f"span_{k}").over(later), F.lit(0)).alias(f"later_{k}") for k in ("docs", "tokens")), *(F.sum(f"span_{k}").over(everything).alias(f"all_{k}") for k in ("docs", "tokens")))
    own = Window.partitionBy("span").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    x = h.withColumns({f"own_{k}": F.coalesce(F.sum(c).over(own), F.lit(0)) for k, c in (("docs", "n_docs"), ("tokens", "tokens"))}).join(totals, "span")
    over_docs, over_tokens = F.col("own_docs") + F.col("later_docs"), F.col("own_tokens") + F.col("later_tokens")
    within = F.col("all_tokens") - over_tokens
    return x.select(
        F.col("length").alias("context_limit"),
        "n_docs",
        over_docs.alias("docs_over"),
        over_tokens.alias("tokens_over"),
        F.col("all_tokens").alias("total_tokens"),
        (within + F.col("length") * over_docs).alias("truncated_total"),
        ((F.col("all_docs") - over_docs) / F.col("all_docs")).alias("share_within"),
    )


def quantile(histogram: DataFrame, q: float) -> int | None:
    """The least length that at least a share q of the documents does not exceed; None without documents."""
    row = limits(histogram).where(F.col("share_within") >= q).agg(F.min("context_limit")).first()
    return row[0]


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers for every length that occurs among all documents."""
    histogram = length_histogram(table(spark, sf_dir, "documents"), public_vocabulary("byte_bpe_50k.tiktoken"))
    return limits(histogram)

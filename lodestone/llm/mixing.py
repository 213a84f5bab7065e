"""Mixing sources to target shares of a total size, by weighted sampling without replacement.

Efraimidis-Spirakis: a document's key is an exponential draw divided by its quality weight; in
ascending order of keys the first documents are a weighted sample. Within each source documents are
ranked by key, their sizes in tokens are summed up in that order, and whole passes over the source
(epochs) come before the one fraction of a pass that fills the rest of its budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.bpe_trie import TOKENIZERS, token_counts
from lodestone.sources.storage import cut_lineage

#: Documents of a source whose running sum is taken together, about.
RANGE_ROWS = 50_000


def source_key(column: str = "source") -> Column:
    """Spellings of a source brought together: lower case, blanks and dashes as ``_``, trimmed."""
    return F.regexp_replace(F.lower(F.trim(F.col(column))), r"[\s\-]+", "_")


def quality_weight(text_col: str = "text") -> Column:
    """Weight in (0, 1] of a document: its share of letters and digits, at least 0.05; 0.05 for null and empty texts."""
    letters = F.length(F.regexp_replace(F.col(text_col), r"[^\p{L}\p{N}]", ""))
    return F.greatest(F.lit(0.05), F.coalesce(letters / F.nullif(F.length(text_col), F.lit(0)), F.lit(0.0)))


def _uniform(id_col: str, seed: int) -> Column:
    """A number in (0, 1) that depends on the id alone, so that a lost task draws the same again."""
    return (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(2**40)) + F.lit(0.5)) / F.lit(float(2**40))


def plan_budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, size, share, max_repeats, budget): the tokens wanted of each source, from one row per source.

    Shares are scaled to sum to 1 over the sources that have documents with tokens. The total is the
    given one, or the largest that every source can fill within its repeats: min over sources of
    size * max_repeats / share. With a given total a source that cannot fill its share gives all it has.
    """
    wanted = targets.select(source_key().alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    wanted = wanted.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("target_share > 0 and max_repeats > 0")
    both = wanted.join(sizes.where("size > 0"), "source")
    everything = Window.partitionBy(F.lit(1))  # one row for each listed source
    share = F.col("target_share") / F.sum("target_share").over(everything)
    planned = both.withColumn("share", share)
    fill = F.lit(total).cast("double") if total is not None else F.min(F.col("size") * F.col("max_repeats") / F.col("share")).over(everything)
    budget = F.floor(F.least(fill * F.col("share"), F.col("size") * F.col("max_repeats").cast("double")) + F.lit(1e-6)).cast("bigint")
    return planned.select("source", "size", "share", "max_repeats", budget.alias("budget"))


def mix_sources(
    documents: DataFrame, targets: DataFrame, total: int | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, tokenizers: str = TOKENIZERS
) -> DataFrame:
    """(id, source, n_tokens, repeats): how often each document is used; documents not used are left out.

    Sizes are tokens of byte_bpe_50k. Sources are matched after ``source_key``; those that are not
    listed, null or without tokens give nothing. A document's repeats are the source's complete
    epochs, plus 1 if its tokens still fit when the documents of the source are added in order of their
    keys; the last one that would overshoot is left out, so no share exceeds its target. Documents
    of no tokens are never used. A repeated id counts as one document each time it occurs.

    A source may hold most rows: its running sum is taken by ranges of keys, each summed on its own and
    offset by the sums of the ranges before it. Ranges are equal steps of the keys' logarithm, of which
    no step holds more than a fourth of its width in octaves, whatever the weights; their number grows
    with the source. The sizes are counted once, while the plan is built.
    """
    sized = token_counts(documents.select(id_col, F.col(text_col).alias("__text"), source_key().alias("source"), quality_weight(text_col).alias("weight")), "__text", tokenizers=tokenizers).drop("__text")
    keyed = cut_lineage(sized.where("n_tokens > 0 and source is not null").withColumn("key", -F.log(_uniform(id_col, seed)) / F.col("weight")))
    sizes = cut_lineage(keyed.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("documents")))
    budgets = plan_budgets(sizes.drop("documents"), targets, total).join(sizes.select("source", "documents"), "source")
    planned = keyed.join(F.broadcast(budgets), "source").withColumn("epochs", F.floor(F.col("budget") / F.col("size"))).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("size"))  # one row for each listed source
    steps = F.ceil(F.col("documents") / (4 * RANGE_ROWS))
    ranged = planned.withColumn("range", F.floor(F.log2("key") * steps).cast("bigint"))
    sums = ranged.groupBy("source", "range").agg(F.sum("n_tokens").alias("tokens"))
    before = sums.withColumn("before", F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("source", "range", "before")
    inside = Window.partitionBy("source", "range").orderBy("key", id_col).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.join(before, ["source", "range"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside))
    repeats = (F.col("epochs") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)).cast("int")
    return summed.select(id_col, "source", "n_tokens", repeats.alias("repeats")).where("repeats > 0")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, documents, most_repeats, actual_share): what the mix came to, one row for each listed source.

    target_share is scaled over all listed sources; a source without documents has 0 tokens.
    """
    wanted = targets.select(source_key().alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("w")).groupBy("source").agg(F.sum("w").alias("w"))
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    everything = Window.partitionBy(F.lit(1))  # one row for each listed source
    joined = wanted.join(used, "source", "left").select("source", "w", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
    return joined.select(
        "source", F.round(F.col("w") / F.sum("w").over(everything), 6).alias("target_share"), "tokens", "documents", "most_repeats",
        F.round(F.col("tokens") / F.greatest(F.sum("tokens").over(everything), F.lit(1)), 6).alias("actual_share"),
    )

"""Token counts: an exact histogram of encoded lengths.

Documents are aggregated by their encoded length; sums over the histogram from either end
then answer how many documents and tokens exist, any quantile, and how many tokens are
left when every document is cut to a context limit, for all limits at once.
"""

from __future__ import annotations

import base64

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import map_texts, materialise, utf8

#: Histogram rows whose sums are taken in one task; blocks are then summed over each other.
BLOCK = 1024


def load(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def lengths(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens`` of every whole text; null and empty texts have 0 tokens, repeated rows
    are counted each, an empty table gives an empty result.

    ``path`` names a byte-level BPE rank file that every worker can read, ``pattern`` its
    pre-splitting pattern; strings of special tokens are ordinary text.
    """
    def make():
        encoding = load(path, pattern)

        def one(text):
            try:
                return len(encoding.encode_ordinary(text)) if text else 0
            except UnicodeEncodeError:  # a lone surrogate, which the library cannot take
                return len(encoding.encode_ordinary(utf8(text).decode("utf-8", "replace")))

        return lambda texts: [([one(t) for t in texts], pa.int64())]

    return map_texts(docs, ["doc_id"], "text", "n_tokens bigint", make)


def histogram(counted: DataFrame) -> DataFrame:
    """One row per encoded length ``context_limit`` of ``counted(n_tokens)``:

    n_docs, n_tokens    documents of exactly this length and their tokens
    docs_at_most        documents that fit into a context of this limit
    docs_longer         documents that do not
    quantile            docs_at_most as a share of all documents
    total_tokens        tokens of all documents
    truncated_tokens    tokens left when every document is cut to this limit

    Between two lengths the answers for a limit L follow from the row below it:
    truncated_tokens + (L - context_limit) * docs_longer. No rows give an empty result;
    null counts are ignored.
    """
    # read twice below, so it is written: counting may mean encoding whole texts
    hist = materialise(counted.filter("n_tokens IS NOT NULL").groupBy("n_tokens")
                       .agg(F.count("*").alias("n_docs"))
                       .withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
                       .withColumn("block", F.floor(F.col("n_tokens") / BLOCK)))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("b_docs"),
                                       F.sum("tokens").alias("b_tokens"))
    upto = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select(
        F.col("block").alias("of_block"),
        F.coalesce(F.sum("b_docs").over(upto), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("b_tokens").over(upto), F.lit(0)).alias("tokens_before"),
        F.sum("b_docs").over(every).alias("all_docs"),
        F.sum("b_tokens").over(every).alias("all_tokens"))
    inside = (Window.partitionBy("block").orderBy("n_tokens")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = (hist.withColumn("docs_in", F.sum("n_docs").over(inside))
            .withColumn("tokens_in", F.sum("tokens").over(inside))
            .join(blocks, F.col("block") == F.col("of_block"))
            .withColumn("docs_at_most", F.col("docs_before") + F.col("docs_in"))
            .withColumn("tokens_at_most", F.col("tokens_before") + F.col("tokens_in")))
    longer = F.col("all_docs") - F.col("docs_at_most")
    return sums.select(
        F.col("n_tokens").alias("context_limit"), "n_docs", F.col("tokens").alias("n_tokens"),
        "docs_at_most", longer.alias("docs_longer"),
        (F.col("docs_at_most") / F.col("all_docs")).alias("quantile"),
        F.col("all_tokens").alias("total_tokens"),
        (F.col("tokens_at_most") + longer * F.col("n_tokens")).alias("truncated_tokens"))

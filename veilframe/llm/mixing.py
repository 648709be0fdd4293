"""Mixing sources to target weights by hierarchical budgeting.

Documents hang under a tree of domain, language and source. A token budget is handed down
the tree in proportion to the children's weights. A child that cannot use its share (its
documents, repeated for at most MAX_EPOCHS epochs, hold fewer tokens) takes what it has, and
the rest goes to its siblings; only when all siblings are full does it reach the parent's
siblings. Each leaf then takes a token-prefix of its documents in a seeded order per epoch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import materialise
from veilframe.llm.vectors import ranked

#: Buckets of the seeded order per leaf and epoch; only the bucket in which a leaf's budget
#: ends is ordered row by row.
BUCKET_DIGITS = 3
LEVELS = ("domain", "language", "source")
#: The plan of a leaf is broadcast up to this many leaves, else joined by a shuffle.
BROADCAST_LEAVES = 20_000


@dataclass(frozen=True)
class Mix:
    """Parameters. Weights are whole numbers; names not listed weigh ``other``."""
    #: Share of all tokens to select, in percent.
    percent: int = 60
    max_epochs: int = 2
    seed: str = "mix-1"
    other: int = 1
    #: Domain of a source: its trailing number modulo the number of domain names.
    domains: tuple[str, ...] = ("web", "books", "code")
    domain_weights: dict[str, int] = field(default_factory=lambda: {"web": 5, "books": 3, "code": 2})
    language_weights: dict[str, int] = field(default_factory=lambda: {"en": 6, "de": 2, "fr": 2, "es": 1})
    source_weights: dict[str, int] = field(default_factory=dict)


def word_tokens(text: Column) -> Column:
    """The unit of budgets: words ``[^\\x20\\x09-\\x0D]+`` of the whole text (null: 0)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _domain(source: Column, mix: Mix) -> Column:
    digits = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    place = F.when(digits == "", 0).otherwise(
        F.pmod(digits.try_cast("int"), F.lit(len(mix.domains))))
    return F.element_at(F.array(*map(F.lit, mix.domains)), (place + 1).cast("int"))


def leaf_columns(mix: Mix, lang: str = "lang", source: str = "source") -> list[Column]:
    """Domain, language and source of a row; nulls are the empty name."""
    name = F.coalesce(F.col(source), F.lit(""))
    return [_domain(name, mix).alias("domain"),
            F.coalesce(F.col(lang), F.lit("")).alias("language"), name.alias("source")]


def order_key(mix: Mix, epoch: Column, doc_id: Column) -> Column:
    """Seeded order of a document in an epoch."""
    return F.md5(F.concat(F.lit(f"{mix.seed}:"), epoch.cast("string"), F.lit(":"),
                          F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _tie(text: str = "text") -> Column:
    """Orders rows that share an id, or have none; only equal rows stay equal."""
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _weight(name: str, weights: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for key, value in weights.items():
        out = F.when(F.col(name) == key, value).otherwise(out)
    return out.cast("long")


def share_out(children: DataFrame, parent: list[str], budget: str) -> DataFrame:
    """Adds ``share`` to ``children(…, weight, capacity, <budget of the parent>)``.

    Siblings in the order of capacity per weight: as long as a child's capacity is below its
    part of what is left, it is full, and what it leaves raises the parts of the others. All
    in whole numbers; parts are rounded down. A child of weight 0 gets nothing.
    """
    ratio = F.expr("capacity / nullif(weight, 0)").asc_nulls_last()
    order = [ratio, *map(F.col, LEVELS)]
    before = (Window.partitionBy(*parent).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    every = Window.partitionBy(*parent)
    left = children.withColumns({
        "left_b": F.col(budget) - F.coalesce(F.sum("capacity").over(before), F.lit(0)),
        "left_w": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    full = (F.col("capacity").cast("decimal(38,0)") * F.col("left_w")
            <= F.col("left_b").cast("decimal(38,0)") * F.col("weight")) & (F.col("weight") > 0)
    # from the first child that is not full, all that follow share what is left there
    state = left.withColumn("full", full).withColumn("open", ~full)
    upto = (Window.partitionBy(*parent).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    state = state.withColumns({
        "b0": F.first(F.when(F.col("open"), F.col("left_b")), ignorenulls=True).over(upto),
        "w0": F.first(F.when(F.col("open"), F.col("left_w")), ignorenulls=True).over(upto),
    })
    part = F.expr("CAST((CAST(b0 AS DECIMAL(38,0)) * weight) div nullif(w0, 0) AS BIGINT)")
    return (state.withColumn("share", F.when(F.col("w0").isNull(), F.col("capacity"))
                             .otherwise(F.least(F.coalesce(part, F.lit(0)), "capacity")))
            .drop("left_b", "left_w", "full", "open", "b0", "w0"))


def leaf_budgets(totals: DataFrame, mix: Mix) -> DataFrame:
    """``domain, language, source, tokens, share`` for ``totals(domain, language, source, tokens)``."""
    def weighed(rows: DataFrame, name: str, weights: dict[str, int]) -> DataFrame:
        """A child of weight 0 can take nothing, so its parent does not count on it."""
        return rows.withColumn("weight", _weight(name, weights, mix.other)).withColumn(
            "capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0)))

    sums = [F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens")]
    leaves = weighed(totals.select(*LEVELS, "tokens", (F.col("tokens") * mix.max_epochs).alias("capacity")),
                     "source", mix.source_weights)
    langs = weighed(leaves.groupBy("domain", "language").agg(*sums), "language", mix.language_weights)
    doms = weighed(langs.groupBy("domain").agg(*sums), "domain", mix.domain_weights)

    doms = (doms.withColumn("budget", F.sum("tokens").over(Window.partitionBy()))
            .withColumn("budget", F.expr(f"budget * {mix.percent} div 100"))
            .withColumns({"language": F.lit(""), "source": F.lit("")}))
    doms = share_out(doms, [], "budget").select("domain", F.col("share").alias("d_share"))
    langs = langs.join(doms, "domain").withColumn("source", F.lit(""))
    langs = share_out(langs, ["domain"], "d_share").select(
        "domain", "language", F.col("share").alias("l_share"))
    leaves = leaves.join(langs, ["domain", "language"])
    return share_out(leaves, ["domain", "language"], "l_share").select(*LEVELS, "tokens", "share")


def plan(docs: DataFrame, mix: Mix, tokens: Column | None = None) -> DataFrame:
    """Per leaf: budget, full epochs, the order key where its last epoch ends, and how many rows of
    the key after that, which are equal, still fit.

    ``tokens`` counts a row's tokens (default: words of ``text``).
    """
    counted = materialise(docs.select(
        "doc_id", *leaf_columns(mix), _tie().alias("tie"),
        (word_tokens(F.col("text")) if tokens is None else tokens).alias("tokens")))
    totals = materialise(counted.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")))
    leaves = materialise(
        leaf_budgets(totals, mix)
        .withColumn("epochs", F.expr("CASE WHEN tokens > 0 THEN share div tokens ELSE 0 END"))
        .withColumn("left", F.col("share") - F.col("epochs") * F.col("tokens"))
        .withColumnsRenamed({k: f"p_{k}" for k in (*LEVELS, "tokens")}))

    on = [F.col(k) == F.col(f"p_{k}") for k in LEVELS]
    keyed = (counted.join(_sized(leaves), on).filter("left > 0 AND tokens > 0")
             .select(*LEVELS, "left", "tokens", F.concat(
                 order_key(mix, F.col("epochs"), F.col("doc_id")), "tie").alias("key")))
    bucket = F.substring("key", 1, BUCKET_DIGITS)
    sums = (keyed.groupBy(*LEVELS, "left", bucket.alias("bucket"))
            .agg(F.sum("tokens").alias("held")))
    upto = (Window.partitionBy(*LEVELS).orderBy("bucket")
            .rowsBetween(Window.unboundedPreceding, -1))
    last = materialise(
        sums.withColumn("before", F.coalesce(F.sum("held").over(upto), F.lit(0)))
        .filter("before <= left AND before + held > left")
        .select(*[F.col(k).alias(f"l_{k}") for k in LEVELS], F.col("bucket").alias("l_bucket"),
                "before"))
    inside = keyed.join(_sized(last), [*(F.col(k) == F.col(f"l_{k}") for k in LEVELS),
                                       bucket == F.col("l_bucket")])
    equal = (inside.groupBy(*LEVELS, "left", "before", "key", "tokens").agg(F.count("*").alias("n"))
             .withColumn("held", F.col("n") * F.col("tokens")))
    upto = F.col("before") + F.col("upto")
    some = F.expr("greatest((left - before - upto + held) div tokens, 0)")
    cut = (_running(equal, "key", "held").withColumn("fits", upto <= F.col("left"))
           .groupBy(*LEVELS).agg(
               F.max(F.when(F.col("fits"), F.col("key"))).alias("end_key"),
               F.min(F.when(~F.col("fits"), F.struct("key", some.alias("copies")))).alias("edge")))
    ends = last.join(cut, [F.col(k) == F.col(f"l_{k}") for k in LEVELS], "left").select(
        *[F.col(f"l_{k}") for k in LEVELS], F.coalesce("end_key", "l_bucket").alias("end_key"), "edge")
    return leaves.join(ends, [F.col(f"p_{k}") == F.col(f"l_{k}") for k in LEVELS], "left").select(
        *[F.col(f"p_{k}") for k in LEVELS], F.col("p_tokens").alias("p_available"), "share",
        "epochs", F.coalesce("end_key", F.lit("")).alias("end_key"), F.col("edge.key").alias("edge_key"),
        F.coalesce("edge.copies", F.lit(0)).alias("edge_copies"))


def _running(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Adds ``upto``, the sum of ``value`` in a leaf up to each row; a leaf is shared by many tasks.

    Rows are range partitioned and written; sums per leaf and partition lead to each row's own.
    """
    placed = materialise(rows.repartitionByRange(*LEVELS, order).withColumn("_part", F.spark_partition_id()))
    whole = Window.partitionBy(*LEVELS).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (placed.groupBy(*LEVELS, "_part").agg(F.sum(value).alias("_sum"))
             .withColumn("_base", F.coalesce(F.sum("_sum").over(whole), F.lit(0))).drop("_sum"))
    own = Window.partitionBy(*LEVELS, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (placed.join(bases, [*LEVELS, "_part"])
            .withColumn("upto", F.col("_base") + F.sum(value).over(own)).drop("_part", "_base"))


def _sized(leaves: DataFrame) -> DataFrame:
    small = leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    return F.broadcast(leaves) if small else leaves


def mix_sources(docs: DataFrame, mix: Mix = Mix(), tokens: Column | None = None) -> DataFrame:  # noqa: B008
    """All columns of ``docs`` as struct ``row``, its leaf, and ``epoch``: one row for each
    time a document is selected.

    Epochs count from 0. A document without a token is selected in no epoch. Rows without an
    id, and rows that share one, are ordered by their texts; of equal rows as many are taken as
    fit, so a leaf falls short of its share by less than its next row. Null lang and source
    are names of their own; an empty table gives an empty result. Texts stay where they are: the
    plan of a leaf, a few values, is joined to them. Only where some of several equal rows
    are taken are these rows put in order.
    """
    leaves = materialise(plan(docs, mix, tokens))
    count = word_tokens(F.col("text")) if tokens is None else tokens
    rows = docs.select(F.struct("*").alias("row"), *leaf_columns(mix), F.col("doc_id").alias("id"),
                       _tie().alias("tie"), count.alias("tokens")).filter("tokens > 0")
    joined = rows.join(_sized(leaves), [F.col(k) == F.col(f"p_{k}") for k in LEVELS]).withColumn(
        "key", F.concat(order_key(mix, F.col("epochs"), F.col("id")), "tie"))
    times = F.col("epochs").cast("int") + F.when(F.col("key") <= F.col("end_key"), 1).otherwise(0)
    out = (joined.withColumn("times", times).filter("times > 0")
           .select("row", *LEVELS, "tokens",
                   F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch")))
    if leaves.filter("edge_copies > 0").isEmpty():
        return out
    equal = ranked(joined.filter("edge_copies > 0 AND key = edge_key").withColumn("_hash", F.xxhash64("row")),
                   *LEVELS, "_hash")
    first = equal.groupBy(*[F.col(k).alias(f"f_{k}") for k in LEVELS]).agg(F.min("rank").alias("first"))
    taken = equal.join(first, [F.col(k) == F.col(f"f_{k}") for k in LEVELS]).filter("rank - first < edge_copies")
    return out.unionByName(taken.select("row", *LEVELS, "tokens", F.col("epochs").cast("int").alias("epoch")))


def _case(name: str, weights: dict[str, int], other: int) -> str:
    if not weights:
        return str(other)
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {other} END"


def _share_sql(source: str, keys: str, parent: str, budget: str) -> str:
    """SQL of ``share_out``."""
    part = f"PARTITION BY {parent}" if parent else ""
    order = f"ORDER BY capacity / nullif(weight, 0) NULLS LAST, {keys}"
    return f"""
  (SELECT *, CASE WHEN w0 IS NULL THEN capacity
     ELSE least(coalesce(CAST(CAST(b0 AS HUGEINT) * weight // nullif(w0, 0) AS BIGINT), 0), capacity) END AS share
   FROM (SELECT *,
       first_value(CASE WHEN open THEN left_b END IGNORE NULLS) OVER v AS b0,
       first_value(CASE WHEN open THEN left_w END IGNORE NULLS) OVER v AS w0
     FROM (SELECT *, CAST(capacity AS HUGEINT) * left_w > CAST(left_b AS HUGEINT) * weight OR weight = 0 AS open
       FROM (SELECT *,
           {budget} - coalesce(sum(capacity) OVER u, 0) AS left_b,
           sum(weight) OVER ({part}) - coalesce(sum(weight) OVER u, 0) AS left_w
         FROM {source}
         WINDOW u AS ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
     WINDOW v AS ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))"""


def sql(mix: Mix = Mix()) -> str:  # noqa: B008
    """The whole selection in DuckDB SQL."""
    names = "[" + ", ".join(f"'{d}'" for d in mix.domains) + "]"
    digits = "regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1)"
    return f"""
WITH rows_ AS (
  SELECT doc_id, md5(coalesce(text, '')) AS tie, coalesce(lang, '') AS language, coalesce(source, '') AS source,
    {names}[CASE WHEN {digits} = '' THEN 1
      ELSE CAST({digits} AS INTEGER) % {len(mix.domains)} + 1 END] AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens
  FROM documents),
leaves AS (SELECT * REPLACE (CASE WHEN weight > 0 THEN capacity ELSE 0 END AS capacity) FROM (
  SELECT domain, language, source, CAST(sum(tokens) AS BIGINT) AS tokens,
    CAST(sum(tokens) * {mix.max_epochs} AS BIGINT) AS capacity,
    {_case('source', mix.source_weights, mix.other)} AS weight FROM rows_ GROUP BY ALL)),
langs AS (SELECT * REPLACE (CASE WHEN weight > 0 THEN capacity ELSE 0 END AS capacity) FROM (
  SELECT domain, language, CAST(sum(capacity) AS BIGINT) AS capacity,
    {_case('language', mix.language_weights, mix.other)} AS weight FROM leaves GROUP BY ALL)),
doms AS (SELECT * REPLACE (CASE WHEN weight > 0 THEN capacity ELSE 0 END AS capacity) FROM (
  SELECT domain, CAST(sum(capacity) AS BIGINT) AS capacity,
    {_case('domain', mix.domain_weights, mix.other)} AS weight,
    (SELECT CAST(sum(tokens) * {mix.percent} // 100 AS BIGINT) FROM leaves) AS budget
  FROM langs GROUP BY domain)),
d AS (SELECT domain, share AS d_share FROM {_share_sql('doms', 'domain', '', 'budget')}),
l AS (SELECT domain, language, share AS l_share
  FROM {_share_sql('(SELECT * FROM langs JOIN d USING (domain))', 'domain, language', 'domain', 'd_share')}),
s AS (SELECT domain, language, source, tokens AS available, share
  FROM {_share_sql('(SELECT * FROM leaves JOIN l USING (domain, language))',
                   'domain, language, source', 'domain, language', 'l_share')}),
times AS (SELECT *, CASE WHEN available > 0 THEN share // available ELSE 0 END AS epochs,
    share - epochs * available AS remainder FROM s),
keyed AS (SELECT doc_id, domain, language, source, tokens, epochs, remainder,
    md5('{mix.seed}:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) || tie AS key
  FROM rows_ JOIN times USING (domain, language, source) WHERE tokens > 0),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, source ORDER BY key
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed)
SELECT doc_id, domain, language, source, tokens, CAST(unnest(range(0,
    CAST(epochs + CASE WHEN upto <= remainder THEN 1 ELSE 0 END AS BIGINT))) AS INTEGER) AS epoch
FROM summed
"""

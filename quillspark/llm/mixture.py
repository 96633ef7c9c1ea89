"""Mixing sources to target weights by Efraimidis-Spirakis sampling without replacement.

Every document gets an exponential key, divided by its quality weight; within a source the documents are taken in
order of their keys until the source's token budget is used up. A budget above the source's tokens gives complete
epochs first and samples only the rest.

The order is never sorted as a whole: keys fall into buckets, tokens are summed by source and bucket, and these
small sums tell which buckets are inside the budget. Only the one bucket of each source that the budget cuts is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weights of documents labelled good, bad, and not labelled.
GOOD, BAD, UNLABELLED = 1.0, 0.25, 0.5
SEED = 17
#: Buckets of keys for each source.
BUCKETS = 4096
NO_SOURCE = ""


def mixture_plan(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, source, n_tokens, copies)`` of every document that the mixture holds at least once.

    ``docs(doc_id, text, source)``; ``labels(doc_id, quality)`` gives the weights GOOD, BAD or UNLABELLED (repeated labels:
    the least quality). ``weights`` maps sources to shares of the token ``budget``, normalised over those present; without it,
    all sources are alike, and without ``budget`` it is all tokens. A token is a run of non-blank ASCII-delimited characters.

    A source of T tokens and budget b gives floor(b / T) copies of each document, and one more of those first in key order
    whose tokens, summed up to and including the document, do not exceed the rest. Ties of keys go by doc_id. A null source
    is a source of its own, named ''; documents of no tokens (null and empty texts) or null ids are never drawn. Rows that
    repeat a doc_id are one document, that of the most tokens (then the greatest source). Empty tables give no rows.
    """
    sized = docs.where("doc_id is not null").select("doc_id", F.coalesce("source", F.lit(NO_SOURCE)).alias("source"), F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("n_tokens")).where("n_tokens > 0")
    sized = sized.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("d")).select("doc_id", "d.source", "d.n_tokens")
    quality = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(16**12 + 1))
    keyed = sized.join(quality, "doc_id", "left").select("doc_id", "source", "n_tokens", (-F.log(u) / F.when(F.col("quality") == 1, GOOD).when(F.col("quality") == 0, BAD).otherwise(UNLABELLED)).alias("key"))
    # 1 - exp(-key / mean weight) spreads the keys of any mixture of weights over (0, 1) well enough to be cut evenly
    keyed = keyed.withColumn("bucket", F.least(F.lit(buckets - 1), F.floor((1 - F.exp(-F.col("key") * UNLABELLED)) * buckets)).cast("int"))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    per_source = sums.groupBy("source").agg(F.sum("tokens").alias("total"))
    if weights is None:
        share = F.lit(1.0)
    elif weights:
        table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        share = F.coalesce(table[F.col("source")], F.lit(0.0))
    else:
        share = F.lit(0.0)
    everything = per_source.select("source", "total", share.alias("share")).selectExpr("source", "total", "share", "sum(total) over () as corpus", "sum(share) over () as shares")
    whole = F.lit(int(budget)) if budget is not None else F.col("corpus")
    wanted = everything.where("shares > 0").withColumn("wanted", F.floor(whole * F.col("share") / F.col("shares")).cast("long"))
    plan = wanted.select("source", F.expr("wanted div total").alias("epochs"), F.expr("wanted % total").alias("rest"))
    reached = sums.selectExpr("source", "bucket", "tokens", "sum(tokens) over (partition by source order by bucket) as upto").join(plan, "source")
    fate = reached.select("source", "bucket", "epochs", "rest", (F.col("upto") - F.col("tokens")).alias("before"), F.when(F.col("upto") <= F.col("rest"), 1).when(F.col("upto") - F.col("tokens") >= F.col("rest"), 0).alias("extra"))
    judged = keyed.join(fate, ["source", "bucket"])
    settled = judged.where("extra is not null").select("doc_id", "source", "n_tokens", (F.col("epochs") + F.col("extra")).alias("copies"))
    cut = judged.where("extra is null").selectExpr("doc_id", "source", "n_tokens", "epochs + cast(before + sum(n_tokens) over (partition by source order by key, doc_id rows unbounded preceding) <= rest as int) as copies")
    return settled.union(cut).where("copies > 0").select("doc_id", "source", "n_tokens", F.col("copies").cast("long").alias("copies"))


def mix_sources(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`mixture_plan` draws, one for each id, with ``copies`` added (replacing a column of that name)."""
    docs = docs.drop("copies")
    drawn = docs.join(mixture_plan(docs, labels, **options).select("doc_id", "copies"), "doc_id")
    # of rows that repeat an id only the one that the plan counted is drawn; the hash settles ties
    tokens = F.regexp_count("text", F.lit(r"\S+"))
    order = Window.partitionBy("doc_id").orderBy(F.desc(tokens), F.desc(F.coalesce("source", F.lit(NO_SOURCE))), F.xxhash64("text"))
    names = [c.lower() for c in docs.columns]
    place = next(n for n in (f"place{k}" for k in range(len(names) + 1)) if n not in names)
    return drawn.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*docs.columns, "copies")


#: DuckDB SQL of :func:`mixture_plan` with its defaults, over the tables documents and labels.
SQL = rf"""
WITH sized AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(text, '\S+')) AS n_tokens FROM documents WHERE doc_id IS NOT NULL
), one AS (
  SELECT doc_id, max((n_tokens, source)) AS d FROM sized WHERE n_tokens > 0 GROUP BY doc_id
), q AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id
), keyed AS (
  SELECT doc_id, d[2] AS source, d[1] AS n_tokens,
    -ln((CAST('0x' || substr(md5('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) + 1)::DOUBLE / {float(16**12 + 1)!r})
      / CASE quality WHEN 1 THEN {GOOD} WHEN 0 THEN {BAD} ELSE {UNLABELLED} END AS key
  FROM one LEFT JOIN q USING (doc_id)
), plan AS (
  SELECT source, total, CAST(floor(CAST(sum(total) OVER () AS DOUBLE) / count(*) OVER ()) AS BIGINT) AS wanted FROM (SELECT source, sum(n_tokens) AS total FROM keyed GROUP BY source)
), judged AS (
  SELECT doc_id, k.source, n_tokens, CAST(wanted // total AS BIGINT)
    + CASE WHEN sum(n_tokens) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) <= wanted % total THEN 1 ELSE 0 END AS copies
  FROM keyed k JOIN plan p ON k.source = p.source
)
SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(copies AS BIGINT) AS copies FROM judged WHERE copies > 0
"""

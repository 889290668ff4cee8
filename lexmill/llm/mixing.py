"""Mixing sources to target weights along a curriculum (problem 9).

Sizes are tokens of a public tokenizer. A source's demand is its target share of the total size T, or
``max_repeats`` times its own size where that is less. Its weight over training time t in [0, 1] follows a
linear schedule with that integral; weights of all sources sum to one at any time as long as all can meet
their share. Documents of a source stand one after another in a hashed order, repeat after repeat; the
document whose middle lies c tokens into the source's demand gets the position t at which the integrated
schedule has asked for c tokens (a closed form). All documents are then range-sorted by position.

The running sums inside a source are taken in two levels, over hashed buckets and inside each
bucket, whose number grows with the documents, so a source with most of them is spread over as many tasks.

Cases: documents whose source isn't exactly a target's are left out; null and empty texts have size 0 and
are not placed; a source without documents has size 0; targets with null shares or repeats count as 0.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.sources.tables import cut, spread

#: Session setting that names the vocabulary file, which every executor must see; where it is unset, ``TOKENIZER`` is used.
SETTING, TOKENIZER = "spark.lexmill.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAST_BUCKETS, DOCS_PER_BUCKET = 64, 20_000
SLOPE = 0.5
_loaded: dict = {}


def encoder(path: str):
    """The tokenizer at ``path``, loaded once per process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def sized(documents: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens of the documents of the target sources."""
    path = path or documents.sparkSession.conf.get(SETTING, TOKENIZER)
    wanted = targets.where("source is not null").select("source").distinct()
    docs = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.col("text").cast("string").alias("text"))).join(wanted, "source", "left_semi")

    def run(batches):
        encode = encoder(path).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "n_tokens": np.array([len(encode(t)) if t else 0 for t in batch["text"]], dtype="int64")})

    return docs.select("doc_id", "source", "text").mapInPandas(run, "doc_id bigint, source string, n_tokens bigint")


def demands(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: target_share, max_repeats, n_docs, size, total (T), demand and whether it is short."""
    own = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("size"))
    joined = targets.where("source is not null").join(own, "source", "left").select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("size", F.lit(0)).alias("size"))
    totals = joined.withColumn("total", F.sum("size").over(Window.partitionBy(F.lit(1))))
    asked, most = F.col("target_share") * F.col("total"), F.col("max_repeats") * F.col("size")
    return totals.withColumns({"short": most < asked, "demand": F.least(asked, most.cast("double"))})


def short_sources(documents: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """The sources that can't reach their share: in the mix, all their repeats are used up below the target."""
    mix = shares(cut(sized(documents, targets, path)), targets)
    return mix.where((F.col("used_tokens") == F.col("max_repeats") * F.col("size")) & (F.col("used_tokens") < F.col("target_tokens"))).select("source")


def slopes(demand: DataFrame) -> DataFrame:
    """source, slope: rising for the first half of the target mass in source order, falling for the rest.

    The slopes, weighted by demand, sum to zero, so the weights sum to one at any time.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("source")
    before = F.sum("demand").over(w.rowsBetween(Window.unboundedPreceding, -1))
    half = demand.withColumn("early", F.coalesce(before, F.lit(0.0)) < 0.5 * F.sum("demand").over(Window.partitionBy(F.lit(1))))
    side = F.sum("demand").over(Window.partitionBy("early"))
    least = F.least(F.sum(F.when(F.col("early"), F.col("demand")).otherwise(0.0)).over(Window.partitionBy(F.lit(1))), F.sum(F.when(F.col("early"), F.lit(0.0)).otherwise(F.col("demand"))).over(Window.partitionBy(F.lit(1))))
    return half.withColumn("slope", F.when(side > 0, F.when(F.col("early"), -1.0).otherwise(1.0) * SLOPE * least / side).otherwise(0.0)).drop("early")


def placed(sizes: DataFrame, targets: DataFrame, seed: int = 11) -> DataFrame:
    """The mix in training order: position, source, doc_id, repeat, n_tokens."""
    plan = slopes(demands(sizes, targets)).select("source", "size", "demand", "slope").where("demand > 0")
    buckets = max(LEAST_BUCKETS, sizes.count() // DOCS_PER_BUCKET)
    order = F.xxhash64(F.lit(seed), "doc_id")
    docs = sizes.where("n_tokens > 0").withColumns({"h": order, "bucket": F.pmod(F.shiftright(order, 20), F.lit(buckets))})
    per_bucket = docs.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("b"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("source", "bucket", F.coalesce(F.sum("b").over(running), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = docs.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(offsets, ["source", "bucket"]).join(plan, "source")
    repeats = starts.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("demand") / F.col("size")).cast("int") - 1))))
    middle = F.col("repeat") * F.col("size") + F.col("offset") + F.col("inner") + F.col("n_tokens") / 2
    used = repeats.withColumn("u", middle / F.col("demand")).where("u <= 1")
    a = F.col("slope")
    # integrated schedule: (1 - a) t + a t^2 = u
    t = F.when(F.abs(a) < 1e-9, F.col("u")).otherwise((-(1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * F.col("u"))) / (2 * a))
    return used.select(F.round(t, 12).alias("position"), "source", "doc_id", "repeat", "n_tokens").orderBy("position", "source", "doc_id", "repeat")


def shares(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, actual_share, size, used_tokens, target_tokens, max_repeats."""
    used = placed(sizes, targets).groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"))
    joined = demands(sizes, targets).join(used, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    whole = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))
    return joined.select("source", "target_share", F.when(whole > 0, F.col("used_tokens") / whole).otherwise(F.lit(0.0)).alias("actual_share"), "size", "used_tokens", (F.col("target_share") * F.col("total")).alias("target_tokens"), "max_repeats")

"""Toxicity by naive Bayes over the words of whole texts, trained from labels, or by any plugged-in scorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenwell import catalog as cat
from screenwell.functions import text as tx
from screenwell.sources import tables as tb

#: Log odds are kept as whole millionths, so that sums do not depend on their order.
UNIT = 1_000_000
#: Words of the model that are broadcast, and 64-bit words of the bitmap of all.
HEAVY, MARKS = 20_000, 1 << 16


def toxicity_label(score: Column, threshold: Column | float = cat.DEFAULT_TOXICITY) -> Column:
    """Rounded score, model label (> 0.5) and the caller's verdict (> threshold)."""
    s = F.round(score, 4)
    bar = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.struct(s.alias("toxicity"), F.when(score > 0.5, F.lit("toxic")).otherwise(F.lit("not_toxic")).alias("label"),
                    (s > bar).alias("is_toxic"))


def _odds(hit: Column, of: Column, base: Column, base_of: Column) -> Column:
    return F.round(F.log((hit + 1.0) / (of + 2.0)) * UNIT - F.log((base + 1.0) / (base_of + 2.0)) * UNIT).cast("long")


def train(texts: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          label: str = "toxic") -> DataFrame:
    """Log odds of every word that occurs in labelled texts: word, odds, n (texts that have it), prior.

    A word counts once per text.  Labels meet the texts before words are made, and
    counts combine before the shuffle.
    """
    known = labels.select(key, (F.col(label) == 1).alias("y"))
    n1, n0 = known.join(texts.select(key), key, "left_semi").agg(F.count_if("y"), F.count_if(~F.col("y"))).first()
    words = texts.select(key, text).join(known, key).select("y", F.explode(tx.word_tokens(text)).alias("word"))
    counts = words.groupBy("word").agg(F.count_if("y").alias("w1"), F.count_if(~F.col("y")).alias("w0"))
    prior = F.round(F.log(F.lit((n1 + 1.0) / (n0 + 1.0))) * UNIT).cast("long")
    return counts.select("word", _odds(F.col("w1"), F.lit(n1), F.col("w0"), F.lit(n0)).alias("odds"),
                         (F.col("w1") + F.col("w0")).alias("n"), prior.alias("prior"))


def score(model: DataFrame | None, df: DataFrame, key: str = "doc_id", text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """Key and `toxicity`; zero where no model is at hand or no word is known.

    The model's `heavy` most frequent words are broadcast and added up where the text is read; so is a bitmap of hashes of all its
    words, by which words it does not know are dropped.  Both are bounded.  Only the rare words that are left
    travel to the rest of the model.
    """
    if model is None:
        return df.select(key, F.lit(0.0).alias("toxicity"))
    model = tb.materialise(model, "toxicity-model")
    top = tb.materialise(model.orderBy(F.desc("n"), "word").limit(heavy).select("word", F.col("odds").alias("_odds")), "toxicity-model")
    place = F.xxhash64("word")
    word, bit = place.bitwiseAND(F.lit(MARKS - 1)).cast("int"), F.shiftright(place, 40).bitwiseAND(F.lit(63)).cast("int")
    marks = tb.materialise(model.select(word.alias("_w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_m")).groupBy(
        "_w").agg(F.bit_or("_m").alias("_m")), "toxicity-model")
    words = df.select(key, F.explode(tx.word_tokens(text)).alias("word")).join(F.broadcast(top), "word", "left").withColumn(
        "_w", word).join(F.broadcast(marks), "_w", "left")
    rare = F.col("_odds").isNull() & (F.call_function("shiftrightunsigned", F.coalesce("_m", F.lit(0).cast("long")), bit).bitwiseAND(F.lit(1)) == 1)
    near = tb.materialise(words.filter(F.col("_odds").isNotNull() | rare).groupBy(key).agg(
        F.sum("_odds").alias("odds"), F.collect_list(F.when(F.col("_odds").isNull(), F.col("word"))).alias("rare")), "toxicity")
    far = near.select(key, F.explode("rare").alias("word")).join(model, "word").groupBy(key).agg(F.sum("odds").alias("odds"))
    sums = near.filter("odds is not null").select(key, "odds").unionByName(far).groupBy(key).agg(F.sum("odds").alias("odds"))
    prior = F.lit(model.agg(F.max("prior")).first()[0])
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("odds") + prior) / UNIT))
    return df.select(key).join(sums, key, "left").select(key, F.coalesce(p, F.lit(0.0)).alias("toxicity"))

"""Which short texts hold which needles: trigram postings, the rarest trigram of a needle, verification.

A needle of three characters or more can only stand in texts that have all of its trigrams, so it meets the texts of
its rarest one. Shorter needles meet the texts of every trigram that begins with them; texts are padded at the end,
so that every character of a text begins one. All meetings are equality joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import stage

#: Fixed value: a character that ends texts; it is taken out of texts and needles.
PAD = "\u0000"


#: Folders that written trigrams are dealt to; a search reads those of the trigrams it asks for.
BUCKETS = 64


def clean(text: Column) -> Column:
    return F.replace(text, F.lit(PAD), F.lit(" "))


def grams(text: Column) -> Column:
    """The distinct trigrams of the padded text."""
    padded = F.concat(text, F.lit(PAD * 2))
    return F.when(F.length(text) > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(padded, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def keyed(texts: DataFrame) -> DataFrame:
    """The distinct texts of (field, text) with an ``id``, a hash of the text."""
    own = texts.where("text IS NOT NULL").select("field", clean(F.col("text")).alias("text")).distinct()
    return own.withColumn("id", F.xxhash64("text"))


def trigrams(keys: DataFrame) -> DataFrame:
    """Postings (field, gram, id) of keyed texts."""
    return keys.select("field", F.explode(grams(F.col("text"))).alias("gram"), "id")


def bucket_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Grams:
    """Keyed texts, their trigrams and in how many texts each is; ``bucketed`` if the trigrams are written by bucket."""

    keys: DataFrame
    posts: DataFrame
    counts: DataFrame
    bucketed: bool = False


def gram_index(texts: DataFrame, put=None) -> Grams:
    """The trigram index of (field, text); ``put(df, name, *partition columns)`` writes a table and returns it read back."""
    if put is None:
        keys = keyed(texts)
        posts = trigrams(keys)
        return Grams(keys, posts, posts.groupBy("field", "gram").agg(F.count("*").alias("n")))
    keys = put(keyed(texts), "keys")
    posts = put(trigrams(keys).withColumn("bucket", bucket_of(F.col("gram"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram"), "grams", "bucket")
    return Grams(keys, posts, put(posts.groupBy("field", "gram").agg(F.count("*").alias("n")), "gram_counts"), True)


def contained(index: Grams, needles: DataFrame) -> DataFrame:
    """Distinct (field, text, needle) with the needle in the text, of indexed texts and needles (field, needle).

    Empty needles are in no text here. Upper and lower case differ: fold both before. Frequent trigrams are never asked
    for if the needle has a rarer one; the joins are on (field, gram) and (field, id), and every candidate is verified
    on its text.
    """
    own = needles.where("needle IS NOT NULL AND needle != ''").select("field", clean(F.col("needle")).alias("needle")).distinct()
    inner = F.transform(F.sequence(F.lit(1), F.greatest(F.length("needle") - 2, F.lit(1))), lambda i: F.substring(F.col("needle"), i, F.lit(3)))
    asked = own.where(F.length("needle") >= 3).select("field", "needle", F.explode(F.array_distinct(inner)).alias("gram"))
    known = asked.join(index.counts, ["field", "gram"], "left").groupBy("field", "needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    long = known.where("least.n > 0").select("field", "needle", F.col("least.gram").alias("gram"))
    heads = index.counts.select("field", "gram", F.explode(F.array(F.substring("gram", 1, 1), F.substring("gram", 1, 2))).alias("needle"))
    short = own.where(F.length("needle") < 3).join(heads, ["field", "needle"]).select("field", "needle", "gram").distinct()
    meet, posts = stage(long.unionByName(short), "needles"), index.posts
    if index.bucketed:
        posts = posts.where(F.col("bucket").isin(*[r.b for r in meet.select(bucket_of(F.col("gram")).alias("b")).distinct().collect()]))
    hit = posts.join(meet, ["field", "gram"]).select("field", "id", "needle").distinct()
    return hit.join(index.keys, ["field", "id"]).where(F.contains("text", "needle")).select("field", "text", "needle").distinct()

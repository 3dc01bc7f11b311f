"""Spelling variants: words one edit apart, found by their rarest bigrams; every word points at a far more frequent one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stage

#: Fixed value: what a word is made of.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
#: One edit spoils two bigrams at most, so of the three rarest of a word one is left.
RAREST = 3


def occurrences(docs: DataFrame, every: int = 199) -> DataFrame:
    """One row (word) for each run of letters of the whole text, A-Z lower-cased.

    Where crc32 of ``<doc_id>:<run>`` is a multiple of ``every``, the code point at crc32 % length is deleted
    (a null doc_id counts as empty, and what is left may be an empty word).
    """
    run = F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"({RUN})"), F.lit(1)))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), run.alias("w"))
    each = each.withColumn("h", F.crc32(F.concat("i", F.lit(":"), "w").cast("binary")))
    at = (F.col("h") % F.length("w")).cast("int")
    shorter = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
    return each.select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("w")).alias("word"))


def vocabulary(docs: DataFrame, every: int = 199, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): how often each word of at least ``least_length`` letters occurs in all documents, if at least ``least_count`` times."""
    return occurrences(docs, every).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def rarest(words: DataFrame, n: int = RAREST) -> DataFrame:
    """(word, length, gram, at): the n rarest positional bigrams of each word.

    One global order: bigrams in fewer words first, then by the bigram, then by position. With this order two
    words of one edit share, among their n = 3 rarest, a bigram whose positions differ by one at most.
    """
    at = F.sequence(F.lit(1), F.length("word") - 1)
    grams = F.transform(at, lambda i: F.struct(F.substring(F.col("word"), i, F.lit(2)).alias("gram"), i.alias("at")))
    each = words.where(F.length("word") > 1).select("word", F.explode(grams).alias("g")).select("word", "g.gram", "g.at")
    # How many words have a bigram: as many rows as there are pairs of letters, so they are sent to all tasks (at most 88 ** 2 = 7,744).
    share = each.groupBy("gram").agg(F.count("*").alias("in_words"))
    ranked = each.join(F.broadcast(share), "gram").groupBy("word").agg(F.slice(F.sort_array(F.collect_list(F.struct("in_words", "gram", "at"))), 1, n).alias("first"))
    return ranked.select("word", F.length("word").alias("length"), F.explode("first").alias("g")).select("word", "length", "g.gram", "g.at")


def halves(grams: DataFrame) -> DataFrame:
    """Keys under which two words of one edit meet at a shared bigram.

    The edit stands before or behind the middle of the shorter word, so the other half is the same in both.
    Every word is listed for both lengths that the shorter of a pair can have: its own, and one less.
    """
    middle = (F.col("least") / 2).cast("int")
    left, right = F.struct(F.lit("l").alias("side"), F.substring("word", F.lit(1), middle).alias("half")), F.struct(F.lit("r").alias("side"), F.substring("word", F.col("length") - F.col("least") + middle + 1, F.col("least") - middle).alias("half"))
    each = grams.withColumn("least", F.explode(F.array("length", F.col("length") - 1)))
    return each.withColumn("h", F.explode(F.array(left, right))).select("word", "length", "least", "gram", "at", "h.side", "h.half")


def near(a: Column, b: Column) -> Column:
    """Exactly one inserted, deleted or replaced code point."""
    return F.levenshtein(a, b, 1) == 1


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) with a < b: all pairs of the distinct words that are one edit apart, each once.

    Candidates share one of their three rarest bigrams, at positions that differ by one at most, and the half
    of the word that the edit leaves alone; so no list of words that only share a common bigram is paired up.
    All candidates are verified. Words need four letters (three bigrams) at least.
    """
    keys = stage(halves(rarest(words)), "bigrams")
    a, b = keys.alias("a"), keys.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("gram", "side", "half", "least")]
    close = (F.col("a.word") < F.col("b.word")) & (F.abs(F.col("a.at") - F.col("b.at")) <= 1) & (F.least("a.length", "b.length") == F.col("a.least")) & (F.abs(F.col("a.length") - F.col("b.length")) <= 1)
    hit = a.join(b, same[0] & same[1] & same[2] & same[3] & close & near(F.col("a.word"), F.col("b.word")))
    return hit.select(F.col("a.word").alias("a"), F.col("b.word").alias("b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms are followed to the last, twice as far in each round."""
    far = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = far.select(F.col("word").alias("root"), F.col("root").alias("next"))
        doubled = stage(far.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        far = doubled.select("word", "root")
        if not doubled.where("moved").limit(1).count():
            return far


def group_variants(words: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for (word, n) with distinct words.

    form: the near word with the largest n (of several the first in code-point order), if its n is at least
    ``times`` the word's. n grows along forms, so following them ends.
    """
    words = stage(words.select("word", "n"), "words")
    pairs = stage(near_pairs(words), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    known = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = known.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("top"))
    best = best.select("word", "n_near", F.col("top.other").alias("other"), (-F.col("top.less")).alias("m"))
    takes = F.col("m") >= times * F.col("n")
    out = stage(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("other")).alias("form"), F.when(takes, F.col("m")).alias("form_n")), "forms")
    last = roots(out.where("form IS NOT NULL"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Every word of at least 6 letters and 5 occurrences in all documents, with its form and root.

    Null and empty texts have no words; repeated rows count as often as they come; other columns are ignored;
    an empty table gives an empty one.
    """
    return group_variants(vocabulary(docs))

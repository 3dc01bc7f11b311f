"""Benchmark decontamination on templates (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Placeholders of names, numbers and units (private-use characters, so no text has them by chance).
NAME, NUMBER, UNIT = "", "", ""
#: Units that may follow a number.
UNITS = "km cm mm kg mg ml km/h mph m g l s h ms min hours hour minutes minute seconds second days day weeks week months month years year meters metres miles feet inches pounds dollars euros cents percent degrees".split()
# The repetitions are possessive: Java matches others by recursion, which long runs (rows of figures, title-cased tables) overflow.
_NAME = r"\p{Lu}%s\p{Ll}[\p{L}'-]*+(?: \p{Lu}\p{Ll}[\p{L}'-]*+)*+"
NAMES_AT = _NAME % r"(?<=[\p{Ll},;] [\"'(\[{“”‘’«„]{0,2}\p{Lu})"
CAPITALS_AT = _NAME % r"(?<![\p{L}\p{M}\p{N}]\p{Lu})"
#: What is folded to one space before names are looked for.
WHITE_AT = r"[\s\p{Z}]{2,}|[\s\p{Z}&&[^ ]]"
NUMBERS_AT = r"\d++(?:[.,:/]\d++)*+"
UNITS_AT = "(?:[%€$£°]|(?:" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + r")(?![\p{L}\p{N}]))"
BETWEEN = rf"[^\p{{L}}\p{{M}}{NAME}{NUMBER}{UNIT}]+"
#: The forms in which texts are compared (see ``forms``).
TEMPLATE, CAPITALS, PLAIN = 0, 1, 2
#: Windows that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 200_000
#: Texts that are broadcast by their key (two numbers) at most.
MOST_SUSPECTS = 1_000_000
# All explodes are outer ones: below others the planner puts a filter on the array, whose whole expression is then made several times.
#: Words of the runs by which texts are singled out before they are compared in all forms.
GRAM = 4


def template(text: Column, names: str = NAMES_AT) -> Column:
    """The text's tokens: lower-cased words, with names, numbers and the units after numbers as placeholders.

    A name is a run of capitalised words after a lower-case letter or a comma (so not the first word of a
    sentence), also in quotes or brackets; with CAPITALS_AT for ``names`` any run of capitalised words.
    White space counts as one space. Null text has no tokens.
    """
    return F.filter(F.split(_filled(text, names, *(f" {p} " for p in (NAME, NUMBER, UNIT))), BETWEEN), lambda t: t != "")


def slot_values(text: Column, names: str = NAMES_AT) -> Column:
    """What stands in the placeholders of ``template``, in order (lower case)."""
    held = _filled(text, names, *(f" {p}$0{p} " for p in (NAME, NUMBER)), f" {UNIT}$1{UNIT} ")
    return F.regexp_extract_all(held, F.lit(rf"([{NAME}{NUMBER}{UNIT}])([^{NAME}{NUMBER}{UNIT}]+)\1"), F.lit(2))


def plain(text: Column) -> Column:
    """The text's words and figures, lower-cased, without any placeholder."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != "")


def signs(text: Column | str) -> Column:
    """The text in lower case with a space around every sign that isn't inside a number, and at both ends."""
    spaced = F.regexp_replace(F.lower(text), r"(?!(?<=\d)[.,:/]\d)([^\p{L}\p{M}\p{N}\s\p{Z}])", " $1 ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(spaced, r"[\s\p{Z}]+", " ")), F.lit(" "))


def _filled(text: Column, names: str, name: str, number: str, unit: str) -> Column:
    """The text in lower case, its names, numbers and units replaced: the one place that says where slots are."""
    text = F.coalesce(text, F.lit(""))
    own = F.contains(text, F.lit(NAME)) | F.contains(text, F.lit(NUMBER)) | F.contains(text, F.lit(UNIT))
    text = F.when(own, F.translate(text, NAME + NUMBER + UNIT, "   ")).otherwise(text)
    low = F.lower(F.regexp_replace(F.regexp_replace(text, WHITE_AT, " "), names, name))
    units = rf"(?<={NUMBER} )\s?({UNITS_AT})"
    return F.when(low.rlike(r"\d"), F.regexp_replace(F.regexp_replace(low, NUMBERS_AT, number), units, unit)).otherwise(low)


def forms(df: DataFrame, id_col: str) -> DataFrame:
    """id_col, form, tok: each text as template, as template in which every capitalised run is a name, and as plain words.

    The second finds renamed questions whose names start sentences; the third finds copies whatever their case,
    as lower or upper case hides names.
    """
    text = F.col("text")
    each = F.array(*[F.struct(F.lit(n).alias("form"), tok.alias("tok")) for n, tok in ((TEMPLATE, template(text)), (CAPITALS, template(text, CAPITALS_AT)), (PLAIN, plain(text)))])
    return df.select(id_col, F.explode_outer(each).alias("e")).select(id_col, "e.form", "e.tok")


def hashed(df: DataFrame, lengths: list[int]) -> DataFrame:
    """df (with tok) with hs, an array of (len, hashes of all runs of len tokens, in order), and without tok.

    Hashes of 2, 4, 8... tokens are made from two of half as many, and those of other lengths from these.
    """
    keep = [c for c in df.columns if c != "tok"]
    out = df.select(*keep, F.size("tok").alias("_n"), F.expr("transform(tok, t -> xxhash64(t))").alias("_1"))
    have = {1: "_1"}
    join = lambda a, b, by: f"zip_with({a}, slice({b}, {by + 1}, _n), (x, y) -> xxhash64(x, y))"
    while 2 * max(have) <= max(lengths):
        p = max(have)
        out = out.withColumn(f"_{2 * p}", F.expr(join(have[p], have[p], p)))
        have[2 * p] = f"_{2 * p}"
    for n in lengths:
        got, name = 0, None
        for p in sorted(have, reverse=True):
            if n & p:
                if name:
                    out = out.withColumn(f"_{n}_{p}", F.expr(join(name, have[p], got)))
                name, got = f"_{n}_{p}" if name else have[p], got + p
        out = out.withColumn(f"h{n}", F.expr(f"slice({name}, 1, greatest(_n - {n - 1}, 0))"))
    return out.select(*keep, F.array(*[F.struct(F.lit(n).alias("len"), F.col(f"h{n}").alias("h")) for n in lengths]).alias("hs"))


def runs(text: Column) -> Column:
    """The text's runs of letters and its runs of figures, lower-cased, in order: what all forms have in common."""
    low = F.lower(F.coalesce(text, F.lit("")))
    low = F.when(low.rlike("[0-9]"), F.regexp_replace(low, "[0-9]++", " $0 ")).otherwise(low)
    return F.filter(F.split(low, r"[^\p{L}\p{M}0-9]+"), lambda t: t != "")


def probe_grams(windows: DataFrame, coverage: float) -> DataFrame | None:
    """gram, size: runs of up to GRAM words one of which is in every text that holds an item; None if there are no such runs.

    Words that stand side by side in a window, with no placeholder between, stand side by side in every
    text with that window. Each window gives its longest such stretch. A pair needs ``coverage`` of an
    item's windows, so of a template's windows the weakest may be left out as long as too few are left for a pair.
    """
    worded = F.transform("win", lambda t: F.when(t.isin(NAME, NUMBER, UNIT) | t.rlike(r"^\p{M}"), "|").otherwise(t))
    stretch = F.transform(F.split(F.array_join(worded, " "), r"\|"), lambda s: F.slice(runs(s), 1, GRAM))
    # As sorted: the longest first, ties by the words.
    best = F.expr("array_sort(stretch, (a, b) -> size(b) - size(a))[0]")
    each = windows.select("item_id", "form", "at", "total", stretch.alias("stretch")).select("item_id", "form", "at", "total", best.alias("gram"))
    order = Window.partitionBy("item_id", "form").orderBy(F.desc(F.size("gram")), "at")
    each = each.withColumn("_n", F.row_number().over(order)).where((F.col("form") == PLAIN) | (F.col("_n") <= F.col("total") - F.ceil(F.col("total") * coverage) + 1))
    each = each.select("gram", F.size("gram").alias("size")).distinct()
    return None if each.where("size = 0").limit(1).count() else each


def suspects(docs: DataFrame, windows: DataFrame, coverage: float) -> DataFrame:
    """The documents that hold one of the items' probe grams at least (all, if there is none): _doc (a number of the row), doc_id, text_hash, text.

    Every document that ``leaks`` reports is among them, and the other forms are made of these alone.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    grams = probe_grams(windows, coverage)
    if grams is not None:
        grams = stage(grams, "grams")
        sizes = sorted(r[0] for r in grams.select("size").distinct().collect())  # GRAM numbers at most
        few = grams.count() <= MOST_BROADCAST
        wanted = hashed(grams.withColumnRenamed("gram", "tok"), sizes).select(F.explode_outer("hs").alias("e"), "size").where("e.len = size").select("size", F.expr("e.h[0]").alias("h")).distinct()
        found = hashed(keyed.select("doc_id", "text_hash", runs(F.col("text")).alias("tok")), sizes).select("doc_id", "text_hash", F.explode_outer("hs").alias("e"))
        found = found.select("doc_id", "text_hash", F.col("e.len").alias("size"), F.explode_outer("e.h").alias("h"))
        # Broadcast: MOST_BROADCAST grams at most, as just counted; then MOST_SUSPECTS keys.
        found = stage(found.join(F.broadcast(wanted) if few else wanted, ["size", "h"], "left_semi").select("doc_id", "text_hash").distinct(), "suspects")
        few = found.count() <= MOST_SUSPECTS
        found = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        keyed = keyed.join(F.broadcast(found) if few else found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left_semi")
    return stage(keyed.withColumn("_doc", F.expr("monotonically_increasing_id()")), "suspect_texts")


def item_windows(items: DataFrame, length: int, least_words: int) -> DataFrame:
    """item_id, form, at, len, h, total, slots, win (its tokens) for every window with at least ``least_words`` words (placeholders don't count).

    Plain windows need no such number. An item with fewer tokens than ``length`` is one window of its own length.
    """
    slot = lambda t: t.isin(NAME, NUMBER, UNIT)
    own = forms(items, "item_id").withColumn("len", F.least(F.size("tok"), F.lit(length))).where(F.col("len") > 0)
    own = own.withColumns({"slots": F.when(F.col("form") == PLAIN, 0).otherwise(F.size(F.filter("tok", slot))), "words": F.transform("tok", lambda t: (~slot(t)).cast("int")), "toks": F.col("tok")})
    each = hashed(own, list(range(1, length + 1))).withColumn("hs", F.expr("element_at(hs, len).h"))
    each = each.select("item_id", "form", "len", "slots", "words", "toks", F.posexplode_outer("hs").alias("at", "h")).withColumn("win", F.expr("slice(toks, at + 1, len)")).drop("toks")
    worded = F.expr("aggregate(slice(words, at + 1, len), 0, (s, x) -> s + x)")
    each = each.where((F.col("form") == PLAIN) | (worded >= F.least(F.lit(least_words), F.col("len")))).drop("words")
    return each.withColumn("total", F.count("*").over(Window.partitionBy("item_id", "form")))


def leaks(docs: DataFrame, items: DataFrame, length: int = 8, least_words: int = 4, coverage: float = 0.5, run: int = 25, by_text: bool = False) -> DataFrame:
    """Which documents hold which benchmark item: one row for each such pair.

    Returns doc_id, item_id, matched (distinct windows of the item found), total (windows it has),
    coverage, slots, substituted (slots of the item that have another value wherever they are aligned).

    All windows of all documents are looked up, in three ``forms``: as templates by two notions of a name,
    and as plain words, so that a copy is found whatever its case and layout. A pair counts if at least ``coverage`` of the item's
    windows occur in the document, in alignments of the two texts whose names are consistent: each name
    of the item stands for one name of the document and the other way round (see ``consistent``). So a
    question with other numbers or names is caught, wherever in the document and whatever its numbers,
    and a text that only has the item's wording around contradictory names isn't.

    A pair also counts, whatever the coverage, if ``run`` plain windows follow one another in both texts (32
    words). Items without a template window of enough words count only if their whole text occurs, with its
    signs (case and white space don't matter). Items of fewer than ``least_words`` words and no figure ("Paris") are
    too common for that: they count only where they are a whole text.

    The forms are made of ``suspects`` alone: texts without any of the items' runs of words can't match in any form.

    Null and empty texts match nothing; items without tokens can't be looked for. Rows with one identifier
    and different texts are looked up one by one and reported together, repeated rows once; null
    identifiers are reported as null. With ``by_text`` there is a row for each text (text_hash, its xxhash64) of
    an identifier. Items with equal texts are all reported. Empty tables give an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    probes = stage(item_windows(items.select("item_id", "text"), length, least_words), "item_windows")
    # Both are read off the items: at most ``length`` lengths, and a count.
    lengths = sorted(r[0] for r in probes.select("len").distinct().collect())
    few = probes.count() <= MOST_BROADCAST
    names = ["doc_id", *["text_hash"] * by_text, "item_id"]
    if not lengths:
        kinds = {"doc_id": docs.schema["doc_id"].dataType.simpleString(), "text_hash": "long", "item_id": items.schema["item_id"].dataType.simpleString()}
        return spark.createDataFrame([], ", ".join(f"{n} {kinds[n]}" for n in names) + ", matched long, total long, coverage double, slots int, substituted long")
    hashes = probes.groupBy("form", "len", "h").agg(F.collect_set(F.struct("item_id", "at", "total", "slots")).alias("of"))
    texts = suspects(docs, probes, coverage)
    found = hashed(forms(texts.select("_doc", "text"), "_doc"), lengths)
    found = found.select("_doc", "form", F.explode_outer("hs").alias("e")).select("_doc", "form", "e.len", F.posexplode_outer("e.h").alias("pos", "h"))
    # Broadcast: MOST_BROADCAST windows at most, as just counted.
    hits = found.join(F.broadcast(hashes) if few else hashes, ["form", "len", "h"]).select("_doc", "form", "pos", F.explode_outer("of").alias("of"))
    hits = hits.select("_doc", "form", "of.*", (F.col("pos") - F.col("of.at")).alias("shift"))
    key = ["_doc", "item_id", "form", "total", "slots"]
    by_shift = hits.groupBy(*key, "shift").agg(F.collect_set("at").alias("ats"))
    enough = F.col("matched") / F.col("total") >= coverage
    # Runs: in sorted places, those that follow one another differ from their index by the same number.
    steps = "transform(array_sort(x.ats), (a, i) -> a - i)"
    longest = F.expr(f"array_max(transform(filter(alignments, x -> size(x.ats) >= {run}), x -> array_max(transform(array_distinct({steps}), d -> size(filter({steps}, y -> y = d))))))")
    pairs = stage(
        by_shift.groupBy(*key)
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).cast("long").alias("matched"), F.collect_list(F.struct("shift", "ats")).alias("alignments"))
        .where(enough | ((F.col("form") == PLAIN) & (longest >= run))),
        "leaks",
    )
    none = F.lit(0).cast("long").alias("substituted")
    worded = probes.where(F.col("form") == TEMPLATE).select("item_id").distinct()
    short = items.select("item_id", plain(F.col("text")).alias("w")).where((F.size("w") < least_words) & ~F.exists("w", lambda t: t.rlike(r"\p{N}"))).select("item_id").distinct()
    bare = probes.where(F.col("form") == PLAIN).select("item_id").distinct().join(worded, "item_id", "left_anti").unionByName(short).distinct()
    out = pairs.where("slots = 0")
    if bare.limit(1).count():
        theirs = items.select("item_id", F.col("text").alias("_item")).join(short.withColumn("_short", F.lit(True)), "item_id", "left")
        whole = pairs.where(F.col("form") == PLAIN).join(bare, "item_id", "left_semi").join(theirs, "item_id")
        whole = whole.join(texts.select("_doc", F.col("text").alias("_text")), "_doc")
        held = F.contains(signs("_text"), signs(F.regexp_replace("_item", r"[\s.,;:!?=]+$", "")))
        whole = whole.where(F.when(F.col("_short"), plain(F.col("_text")) == plain(F.col("_item"))).otherwise(held))
        pairs = pairs.join(bare, "item_id", "left_anti").select(*pairs.columns)
        out = pairs.where("slots = 0").unionByName(whole.select(*pairs.columns))
    out = out.select(*key, "matched", none)
    for form, at in ((TEMPLATE, NAMES_AT), (CAPITALS, CAPITALS_AT)):
        slotted = pairs.where((F.col("form") == form) & (F.col("slots") > 0))
        if slotted.limit(1).count():
            out = out.unionByName(consistent(slotted, texts, items, length, at).where(enough).select(*out.columns))
    # One row for a pair: the form in which most of the item was found.
    row = F.struct((F.col("matched") / F.col("total")).alias("coverage"), (-F.col("form")).alias("first"), "matched", F.col("total").cast("long").alias("total"), F.col("slots").cast("int").alias("slots"), "substituted")
    out = out.join(texts.select("_doc", "doc_id", "text_hash"), "_doc").groupBy(*names).agg(F.max(row).alias("r"))
    return out.select(*names, "r.matched", "r.total", "r.coverage", "r.slots", "r.substituted")


def consistent(pairs: DataFrame, texts: DataFrame, items: DataFrame, length: int, names: str) -> DataFrame:
    """The pairs again, with the windows of their consistent alignments only, and substituted.

    Each alignment is tried by itself, on the slots that its windows cover. Its names must go one to one;
    a name that stays the same is never a contradiction, and numbers and units may take any values.
    """
    own = texts.select("_doc", "text").join(pairs.select("_doc").distinct(), "_doc", "left_semi")
    slot = lambda t: t.isin(NAME, NUMBER, UNIT)
    places = lambda tok: F.filter(F.transform(tok, lambda t, i: F.when(slot(t), i)), lambda i: i.isNotNull())
    values = own.select("_doc", template(F.col("text"), names).alias("tok"), slot_values(F.col("text"), names).alias("dv")).select("_doc", places("tok").alias("dp"), "dv")
    theirs = items.select("item_id", template(F.col("text"), names).alias("tok"), slot_values(F.col("text"), names).alias("iv"))
    theirs = theirs.select("item_id", "iv", places("tok").alias("ip"), F.filter("tok", slot).alias("kinds"), F.least(F.size("tok"), F.lit(length)).alias("len"))
    each = pairs.select("_doc", "item_id", "form", "total", "slots", F.explode_outer("alignments").alias("x")).select("_doc", "item_id", "form", "total", "slots", "x.*")
    each = each.join(values, "_doc").join(theirs, "item_id")
    both = """transform(filter(sequence(0, size(ip) - 1), k -> exists(ats, a -> ip[k] >= a AND ip[k] < a + len)),
        k -> named_struct('k', k, 'named', kinds[k] = '%s', 'a', iv[k], 'b', get(dv, CAST(array_position(dp, CAST(ip[k] + shift AS INT)) AS INT) - 1)))""" % NAME
    each = each.withColumn("both", F.expr(both)).where("forall(both, x -> x.b IS NOT NULL)")
    each = each.withColumn("renamed", F.expr("array_distinct(transform(filter(both, x -> x.named AND x.a != x.b), x -> named_struct('a', x.a, 'b', x.b)))"))
    good = each.where("size(array_distinct(transform(renamed, x -> x.a))) = size(renamed) AND size(array_distinct(transform(renamed, x -> x.b))) = size(renamed)")
    of = lambda test: F.array_distinct(F.flatten(F.collect_list(F.expr(f"transform(filter(both, x -> {test}), x -> x.k)"))))
    found = good.groupBy("_doc", "item_id", "form", "total", "slots").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).cast("long").alias("matched"), F.size(F.array_except(of("x.a != x.b"), of("x.a = x.b"))).cast("long").alias("substituted")
    )
    return found

"""Benchmark decontamination as a prefix-filtered set join, in column expressions only.

A window is a run of ``window`` item words and is contained in a text only as a whole, so
it can only occur where its rarest word does: that word is its prefix. Words are ordered by
how often they occur in all documents. The prefixes of an item's windows meet the words
of the documents in one equality join. A match fixes where the whole item would lie in the
text (its diagonal); length and position bounds drop those for which no window fits. What
remains is verified word by word, window by window, on the text itself.

The item side is a few words per item. Spark broadcasts it while its written size is below
the session's threshold and shuffles otherwise. Frequencies are partial sums before they
are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import columns_of, lower_ascii, whole_text
from tilewright.session import write_table


def benchmark_words(text: Column) -> Column:
    """Words of ASCII letters, digits and all characters beyond ASCII, with A-Z lower-cased."""
    return F.array_remove(F.split(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def prefixes(items: DataFrame, rarity: DataFrame) -> DataFrame:
    """The rarest word of every window: word, item, its place in the item, and first and last window it stands for."""
    windows = items.select("item", "words", "span", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("span"))).alias("start"))
    places = windows.select("item", "span", "start", F.posexplode(F.slice("words", F.col("start") + 1, F.col("span"))).alias("at", "word"))
    ranked = places.join(rarity, "word", "left")
    rarest = ranked.groupBy("item", "span", "start").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("rarest")
    )
    return (
        rarest.where("rarest.n > 0")
        .groupBy("item", "span", F.col("rarest.word").alias("word"), (F.col("start") + F.col("rarest.at")).alias("place"))
        .agg(F.min("start").alias("first"), F.max("start").alias("last"))
    )


def hits_of(words: Column, candidates: Column) -> Column:
    """Per candidate item: its id and the places of all words inside occurring windows."""

    def verified(c: Column) -> Column:
        span, n = c["span"], F.size(words)
        starts = F.filter(
            F.sequence(F.greatest(F.lit(0), -c["diagonal"]), F.least(F.size(c["words"]), n - c["diagonal"]) - span),
            lambda s: F.slice(words, c["diagonal"] + s + 1, span) == F.slice(c["words"], s + 1, span),
        )
        room = F.greatest(F.lit(0), -c["diagonal"]) <= F.least(F.size(c["words"]), n - c["diagonal"]) - span
        places = F.transform(starts, lambda s: F.sequence(c["diagonal"] + s, c["diagonal"] + s + span - 1))
        none = F.array().cast("array<int>")
        return F.struct(c["item_id"].alias("item_id"), F.when(room, F.flatten(places)).otherwise(none).alias("places"))

    return F.filter(F.transform(candidates, verified), lambda h: F.size(h["places"]) > 0)


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", row: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    ``row`` names one more column that holds the whole row of ``docs`` as a struct.

    A window is ``window`` consecutive item words; an item of fewer words, but not none, is
    one window. ``n_hit`` counts the text's words inside any occurrence of a window,
    ``n_items`` the items with such windows; contaminated means n_hit > 0 and
    share * n_hit >= n_words. Null text has no words. Items with a null id or without words take no part; rows of
    one item id are one item. Documents with a null id and repeated rows are judged like
    any other. Other columns are ignored.
    """
    columns_of(docs, id_col, text_col)
    columns_of(benchmark, item_id, item_text)
    items = benchmark.select(F.col(item_id).alias("item_id"), benchmark_words(whole_text(item_text)).alias("words"))
    items = items.where(F.col("item_id").isNotNull() & (F.size("words") > 0))
    own = F.sha2(F.concat_ws(" ", F.col("item_id").cast("string"), "words"), 256)  # an item id may have several texts
    items = items.withColumns({"span": F.least(F.lit(window), F.size("words")), "item": own}).dropDuplicates(["item"])
    items = write_table(items, "items")
    vocabulary = write_table(items.select(F.explode("words").alias("word")).distinct(), "vocabulary")

    texts = docs.select(
        F.col(id_col).alias("doc_id"),
        whole_text(text_col).alias("text"),
        (F.struct("*") if row else F.lit(None).cast("int")).alias("whole"),
    )
    words = benchmark_words(F.col("text"))
    seen = texts.select(F.explode(words).alias("word")).join(vocabulary, "word", "left_semi")
    rarity = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    prefix = write_table(prefixes(items, rarity), "prefixes")

    split = texts.select("doc_id", words.alias("words")).withColumn("n", F.size("words"))
    spots = split.select("doc_id", "n", F.posexplode("words").alias("at", "word"))
    diagonal = F.col("at") - F.col("place")
    fits = (diagonal + F.col("last") >= 0) & (diagonal + F.col("first") + F.col("span") <= F.col("n"))
    spots = spots.join(prefix, "word").where(fits).select("doc_id", "item", diagonal.alias("diagonal")).distinct()
    found = spots.join(items, "item").groupBy("doc_id").agg(
        F.collect_list(F.struct("item_id", "diagonal", "words", "span")).alias("candidates")
    )
    found = write_table(found.withColumnRenamed("doc_id", "found_id"), "candidates")

    joined = texts.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    none = F.filter(F.col("candidates"), lambda c: F.lit(False))
    # Texts move whole and are split behind the join. The words are bound once by the outer
    # lambda, so that no inner step splits the text again.
    judged = F.transform(
        F.array(words),
        lambda w: F.struct(F.size(w).alias("n"), hits_of(w, F.coalesce("candidates", none)).alias("hits")),
    )[0]
    judged = joined.select("doc_id", "whole", judged.alias("j"))
    hits = F.col("j.hits")
    names = F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["item_id"].cast("string"))))
    n_words = F.col("j.n").cast("long")
    counted = judged.select(
        "doc_id",
        "whole",
        n_words.alias("n_words"),
        F.coalesce(F.size(F.array_distinct(F.flatten(F.transform(hits, lambda h: h["places"])))), F.lit(0)).alias("n_hit"),
        F.coalesce(names, F.array().cast("array<string>")).alias("names"),
    )
    n_hit = F.greatest(F.col("n_hit"), F.lit(0)).cast("long")
    return counted.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("names").cast("long").alias("n_items"),
        F.sha2(F.array_join("names", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        *([F.col("whole").alias(row)] if row else []),
    )

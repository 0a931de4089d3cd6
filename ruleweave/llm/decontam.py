"""Benchmark decontamination with a distributed positional inverted index.

The index holds a posting (document, position) for every occurrence in the training
texts of a term that the benchmark has, and an end mark for each document, at the
position after its last word.  It is made in one pass, without a shuffle, and read
by column.  A window of test words is looked up from its rarest term, counted over
all documents: that term's postings, less the term's place in the window, are the
possible starts; the second-rarest term's postings, adjusted in the same way, are
intersected with them, and then those of all others.  A start that every term has
is an exact match; with a slop, terms may each be that far from their place.

The index has the terms of one benchmark: another benchmark needs another pass.  All of
it is DataFrame code.  Sides are broadcast only after a count of a written
table; larger ones are shuffled on document and position, which no frequent term or
passage can heat.  Only a benchmark whose distinct terms are too many to broadcast (some
hundred thousand) has its terms joined by a shuffle on the term, which AQE then splits.

Defined cases: a null text has no words; a text of fewer words than a window is one
window, and one without words has none; rows that repeat an id, or have none, are
matched as rows, told apart by their text's hash; null item ids are not counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, small

SIZE = 10
#: Words of a phrase at most: their places are bits of a long.
MOST = 63
#: What parts words, after A-Z are lower-cased.
PARTS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters beyond A-Z that lower() would change; texts with them take the slower translate().
OTHER_CASE = "[\\p{Lu}\\p{Lt}\\p{Nl}\\p{So}&&[^A-Z]]"
END = ""


def words(text: str | Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    body = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    plain = F.when(body.rlike(OTHER_CASE), F.translate(body, UPPER, LOWER)).otherwise(F.lower(body))
    return F.array_remove(F.split(plain, PARTS), "")


def windows(items: DataFrame, size: int = SIZE, text: str = "text", key: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(phrases, holders): distinct windows as (wid, words, n), and (wid, item_id) of the items that have them."""
    split = items.select(F.col(key).alias("item_id"), words(text).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(size))
    each = split.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length))).alias("words"))
    each = cut(each.distinct(), "windows")
    phrases = cut(each.select("words").distinct().select(F.monotonically_increasing_id().alias("wid"), "words", F.size("words").alias("n")), "phrases")
    holders = cut(each.join(phrases, "words").select("wid", "item_id").distinct(), "holders")
    return phrases, holders


def postings(docs: DataFrame, terms: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, tie, term, pos of every occurrence of `terms` (term) in `docs`, and of END after the last word."""
    wanted = small(cut(terms.select("term").union(terms.sparkSession.createDataFrame([(END,)], "term string")).distinct(), "terms"))
    each = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"), F.posexplode(F.concat(words(text), F.array(F.lit(END)))).alias("pos", "term"))
    return each.join(wanted, "term").select("doc_id", "tie", "term", "pos")


def _looked_up(found: DataFrame, index: DataFrame, needed: DataFrame, slop: int) -> DataFrame:
    """Of the starts in `found`, those whose terms in `needed` (wid, k, term) all stand in their places."""
    terms = cut(needed.select("term").distinct(), "terms")
    wanted = cut(found.join(small(needed), "wid").select("doc_id", "tie", "wid", "start", "k", "term", (F.col("start") + F.col("k")).alias("place")), "places")
    lists = index.join(small(terms), "term", "left_semi")
    documents = cut(found.select(F.col("doc_id").alias("d"), F.col("tie").alias("t")).distinct(), "candidates")
    lists = lists.join(small(documents), lists.doc_id.eqNullSafe(F.col("d")) & (lists.tie == F.col("t")), "left_semi")
    lists = lists.select(F.col("doc_id").alias("d"), F.col("tie").alias("t"), F.col("term").alias("at_term"), "pos")
    near = F.col("place") == F.col("pos") if not slop else F.abs(F.col("place") - F.col("pos")) <= slop
    hit = wanted.join(lists, wanted.doc_id.eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")) & (F.col("term") == F.col("at_term")) & near)
    masks = hit.groupBy("doc_id", "tie", "wid", "start").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("mask"))
    full = needed.groupBy("wid").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("all"))
    return masks.join(small(cut(full, "masks")), "wid").where("mask = all").select("doc_id", "tie", "wid", "start")


def matches(index: DataFrame, phrases: DataFrame, slop: int = 0) -> DataFrame:
    """doc_id, tie, wid, start, n: where each phrase (wid, words, n) of at most MOST words stands."""
    frequency = small(cut(index.where(F.col("term") != END).groupBy("term").agg(F.count(F.lit(1)).alias("tf")), "frequencies"))
    terms = phrases.select("wid", "n", F.posexplode("words").alias("k", "term")).join(frequency, "term")
    whole = Window.partitionBy("wid")
    ranked = terms.withColumn("rank", F.row_number().over(whole.orderBy("tf", "term", "k"))).withColumn("there", F.count(F.lit(1)).over(whole))
    plan = cut(ranked.where("there = n").select("wid", "n", "k", "term", "rank"), "plans")
    rarest = cut(plan.where("rank = 1").select("wid", "k", "term"), "rarest")
    found = cut(index.join(small(rarest), "term").select("doc_id", "tie", "wid", (F.col("pos") - F.col("k")).alias("start")).where(F.col("start") >= -slop).distinct(), "starts")
    lengths = plan.where("rank = 1").select("wid", "n")
    done = []
    for ranks in ("rank = 2", "rank > 2"):
        needed = cut(plan.where(ranks).select("wid", "k", "term"), "needed")
        more = small(cut(needed.select("wid").distinct(), "longer"))
        done.append(found.join(more, "wid", "left_anti"))  # phrases that have no more terms
        found = cut(_looked_up(found.join(more, "wid", "left_semi"), index, needed, slop), "starts")
    return found.unionByName(done[0]).unionByName(done[1]).join(small(cut(lengths, "lengths")), "wid").select("doc_id", "tie", "wid", "start", "n")


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, slop: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, tie, n_words, n_hit, n_items, items_sha256, contaminated for each row of `docs`."""
    if not 1 <= size <= MOST:
        raise ValueError(f"a window has 1 to {MOST} words, not {size}")
    phrases, holders = windows(items, size)
    index = cut(postings(docs, phrases.select(F.explode("words").alias("term")), text, key), "postings")
    found = cut(matches(index, phrases, slop), "matches")
    row = ["doc_id", "tie"]
    past = F.max(F.col("start") + F.col("n")).over(Window.partitionBy(*row).orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1))
    stands = found.select(*row, "start", "n").distinct()
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", F.coalesce(past, "start")))
    hits = stands.withColumn("fresh", fresh).groupBy(*row).agg(F.sum("fresh").alias("n_hit"))
    held = found.select(*row, "wid").distinct().join(small(holders), "wid").where(F.col("item_id").isNotNull()).select(*row, F.col("item_id").cast("string").alias("item")).distinct()
    named = held.groupBy(*row).agg(F.count("item").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    both = hits.join(named, hits.doc_id.eqNullSafe(named.doc_id) & (hits.tie == named.tie), "left").select(hits.doc_id.alias("d"), hits.tie.alias("t"), "n_hit", "n_items", "items")
    ends = index.where(F.col("term") == END).select(*row, F.col("pos").cast("long").alias("n_words"))
    out = ends.join(both, ends.doc_id.eqNullSafe(F.col("d")) & (ends.tie == F.col("t")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(*row, "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))

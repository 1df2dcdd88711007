"""Test items inside documents: MinHash containment search in size partitions.

An item of q shingles is contained when at least ``need = ceil(t * q)`` of them
occur in a document. Then at most ``q - need`` are missing, so of the item's
``q - need + 1`` smallest hashes at least one occurs there: this is the item's
signature. Items lie in partitions by size (powers of two). A partition knows its
smallest need and the largest hash of its signatures; a document's signature for
it is all hashes up to that bound, and a document with fewer shingles than the
need skips the partition. Looking one up in the other misses no item. Candidates
are verified on the shingles themselves. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexfold.llm.common import written

WIDTH = 5


def words(text: str) -> str:
    """SQL for the lower-cased runs of letters and digits of a text; null counts as empty."""
    return f"regexp_extract_all(lower(coalesce({text}, '')), '[\\\\p{{L}}\\\\p{{N}}]+', 0)"


def kept_hashes(text: str, keep: str) -> Column:
    """``keep`` of h, the hashes of all five-word shingles in order, or of the whole
    sequence for fewer words.

    Words and hashes are bound to lambda variables, so that a text is taken apart once.
    """
    return F.expr(f"""
        transform(transform(array({words(text)}), w -> case
          when size(w) >= {WIDTH} then transform(sequence(0, size(w) - {WIDTH}), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))
          when size(w) > 0 then array(xxhash64(array_join(w, ' ')))
          else cast(array() as array<bigint>) end), h -> {keep})[0]""")


def shingles(text: str) -> Column:
    """The distinct shingles as text."""
    return F.expr(f"""
        array_distinct(transform(array({words(text)}), w -> case
          when size(w) >= {WIDTH} then transform(sequence(1, size(w) - {WIDTH - 1}), i -> array_join(slice(w, i, {WIDTH}), ' '))
          when size(w) > 0 then array(array_join(w, ' '))
          else cast(array() as array<string>) end)[0])""")


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item, n_found, containment) of every item found in a document.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are
    ignored. Null, empty and word-less texts hold no shingles and match nothing; a
    text of fewer than five words is one shingle and matches such a text only.
    Repeated rows of one doc_id and text give one result; texts that share a doc_id
    are told apart while searching, and one row per doc_id, item and count comes
    out. Ids may be null. Items with the same item_id and different texts are
    different items. An empty table gives an empty result.
    """
    items = written(
        items.select("item_id", "text").distinct().select("item_id", F.xxhash64("text").alias("item_text"), shingles("text").alias("shingles"))
        .withColumn("n_item", F.size("shingles")).where("n_item > 0")
        .withColumn("need", F.ceil(F.col("n_item") * percent / 100).cast("int"))
    )
    # the hashes of an item's shingles are taken from the joined words, as those of a document's are
    parts = "split(s, ' ')"
    hashed = items.withColumn(
        "hashes",
        F.expr(f"transform(shingles, s -> transform(array({parts}), w -> if(size(w) = {WIDTH}, xxhash64(w[0], w[1], w[2], w[3], w[4]), xxhash64(s)))[0])"),
    )
    signed = hashed.withColumn("signature", F.expr("slice(array_sort(hashes), 1, n_item - need + 1)"))
    partitions = signed.groupBy(F.floor(F.log2("n_item")).alias("part")).agg(
        F.min("need").alias("need"), F.max(F.element_at("signature", -1)).alias("bound")
    )
    by_need = sorted((p.need, p.bound) for p in partitions.collect())  # one row for each power of two
    tests = [f"when size(h) >= {need} then {max(b for n, b in by_need if n <= need)}L" for need, _ in reversed(by_need)]
    sketch_bound = f"case {' '.join(tests)} end" if tests else "cast(null as bigint)"
    lookup = written(signed.select("item_id", "item_text", "need", F.explode("signature").alias("h")))

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("doc_text"))
    signature = kept_hashes("text", f"filter(h, x -> x <= {sketch_bound})")
    sketch = keyed.select("doc_id", "doc_text", F.explode(signature).alias("h"))
    pairs = written(sketch.join(lookup, "h").select("doc_id", "doc_text", "item_id", "item_text").distinct())

    found = pairs.select(F.col("doc_id").alias("_id"), "doc_text").distinct()
    texts = keyed.join(found, (keyed.doc_text == found.doc_text) & keyed.doc_id.eqNullSafe(found["_id"]), "left_semi")
    held = texts.select("doc_id", "doc_text", F.explode(shingles("text")).alias("shingle")).distinct()
    wanted = items.select("item_id", "item_text", "n_item", "need", F.explode("shingles").alias("shingle"))
    hits = held.join(wanted, "shingle").groupBy("doc_id", "doc_text", "item_id", "item_text", "n_item", "need").agg(F.count("*").alias("n_found"))
    return (
        hits.where("n_found >= need")
        .select("doc_id", "item_id", "n_item", "n_found", (F.col("n_found") / F.col("n_item")).alias("containment")).distinct()
    )

"""Document fingerprints: bottom-k sketches of five-word shingles, in SQL functions only.

A sketch is the ``K`` smallest distinct 64-bit hashes of a text's shingles, ascending.
Sketches merge (the ``K`` smallest of both), so parts of a document or of a corpus can be
sketched apart; resemblance, containment and the number of distinct shingles are estimated
from them.  Words are runs of characters other than ASCII white space; a text of one to
four words has one shingle, all of its words, and a text without words has an empty sketch.

Defined results: null text is empty; two empty sketches resemble each other fully (1.0),
an empty and a full one not at all; equal texts have equal sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swapledger.llm.common import written

K = 256
WORDS = 5
#: Width of the hash space below the largest long, for counting from the k-th smallest value.
_SPACE = float(2**64)


def with_words(df: DataFrame, text: str | Column, out: str) -> DataFrame:
    """Add the array of words of a text."""
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return df.withColumn(out, F.filter(F.split(whole, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""))


def sketch(words: str, k: int = K) -> Column:
    """Bottom-k sketch of an array of words."""
    w, n = F.col(words), F.size(words)
    full = F.transform(
        F.sequence(F.lit(1), n - WORDS + 1), lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(WORDS)])
    )
    short = F.array(F.xxhash64(F.concat_ws(" ", w)))
    none = F.array().cast("array<bigint>")
    return F.slice(F.sort_array(F.array_distinct(F.when(n >= WORDS, full).when(n > 0, short).otherwise(none))), 1, k)


def merged(a: str, b: str, k: int = K) -> Column:
    """Sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: str, b: str, k: int = K) -> Column:
    """Estimated Jaccard similarity: share of the joint sketch that both have."""
    both = F.size(F.array_intersect(F.array_intersect(merged(a, b, k), F.col(a)), F.col(b)))
    size = F.least(F.size(F.array_union(a, b)), F.lit(k))
    return F.when(size == 0, F.lit(1.0)).otherwise(both.cast("double") / size)


def distinct_shingles(a: str, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact while the sketch is not full."""
    reach = (F.element_at(a, -1).cast("double") + F.lit(_SPACE / 2)) / F.lit(_SPACE)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / reach)


def containment(a: str, b: str, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    j = resemblance(a, b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k)) / distinct_shingles(a, k))
    )


def encoded(a: str) -> Column:
    """A sketch as text (base64 of its big-endian values)."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def following(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, hash) of every row and of the row after it, by ascending id, then text hash; the first follows the last.

    Only ids and hashes are sorted, in ranges; each range needs one more row, the first of
    the next range.  Repeated rows (equal id and text) are one.
    """
    ranged = written(
        docs.select(doc_id, F.xxhash64(text).alias("_h")).distinct()
        .select(F.struct(F.col(doc_id).isNull().alias("n"), F.coalesce(F.col(doc_id), F.lit(0)).alias("i"), F.col("_h").alias("h")).alias("key"))
        .repartitionByRange("key").withColumn("part", F.spark_partition_id()),
        "id-ranges",
    )
    firsts = ranged.groupBy("part").agg(F.min("key").alias("first"))
    across = Window.orderBy("part")
    after = firsts.select(
        "part", F.coalesce(F.lead("first").over(across), F.first("first").over(across)).alias("after")
    )
    inside = Window.partitionBy("part").orderBy("key")
    return ranged.withColumn("next", F.lead("key").over(inside)).join(after, "part").select(
        "key", F.coalesce("next", "after").alias("next")
    )


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness to each other and to the next text.

    The edited text keeps the first half and takes as many characters from the start of
    the next document as it loses.
    """
    given = docs.select(F.col(doc_id).cast("long").alias(doc_id), F.coalesce(F.col(text), F.lit("")).alias(text))
    pairs = following(given, doc_id, text)
    key = F.struct(F.col(doc_id).isNull().alias("n"), F.coalesce(F.col(doc_id), F.lit(0)).alias("i"), F.xxhash64(text).alias("h"))
    # Both joins below read this by its key: one exchange of the texts serves the two.
    rows = given.select(key.alias("key"), text)
    # The text of each row, beside the key of the row before it.
    afterwards = (
        rows.join(pairs.select(F.col("key").alias("_before"), F.col("next").alias("key")).hint("merge"), "key")
        .select(F.col("_before").alias("key"), F.col(text).alias("_next")).dropDuplicates(["key"])
    )
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    joined = rows.join(afterwards.hint("merge"), "key").select(
        F.when(~F.col("key.n"), F.col("key.i")).alias(doc_id), text, "_next", n.cast("long").alias("n_chars"),
        F.concat(F.substring(F.col(text), F.lit(1), n - half), F.substring(F.col("_next"), F.lit(1), half)).alias("_edited"),
    )
    worded = with_words(with_words(with_words(joined, text, "_w"), "_edited", "_we"), "_next", "_wn")
    sketched = worded.select(
        doc_id, "n_chars", F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"),
        sketch("_w", k).alias("sketch"), sketch("_we", k).alias("edited_sketch"), sketch("_wn", k).alias("next_sketch"),
    )
    return sketched.select(
        doc_id, "n_chars", "edited_sha256", encoded("sketch").alias("fingerprint"), encoded("edited_sketch").alias("edited_fingerprint"),
        resemblance("sketch", "edited_sketch", k).alias("near_edited"), resemblance("sketch", "next_sketch", k).alias("near_next"),
        distinct_shingles("sketch", k).alias("n_shingles"), containment("sketch", "edited_sketch", k).alias("contained_in_edited"),
    )

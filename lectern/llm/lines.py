"""Removal of repeated lines: every line but those of the first document that holds it.

Lines become 128-bit hashes of their keys. Hashes are range-partitioned (they are uniform,
so even ranges need no sampling), sorted within a range by hash, document and position, and
streamed: a row whose document is not the first of its hash is a later copy. A line that a
large share of rows hold would fill one range, so such lines, found on a bounded sample, are
dealt over slices; each slice streams its own first document, and the least of those (one
row a slice) decides. The sample moves work only, never a result.

Everything is DataFrame functions. What comes back is a bitmap per document, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from lectern.llm.common import id_and_text, parts_for
from lectern.session import cut_lineage

#: ASCII white space, stripped at both ends of a line.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: About so many documents are looked at to find crowded lines and the number of lines.
SAMPLE = 50_000
#: Bytes of a line's row, and of a range of rows that one task sorts.
ROW_BYTES, RANGE_BYTES = 64, 64 << 20
#: A line in at least so many sampled rows can be crowded.
LEAST_SEEN = 20


def folded(text: Column) -> Column:
    """A-Z in lower case, other letters as they are; the quick way where a text is ASCII."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_hashes(texts: DataFrame, least: int) -> DataFrame:
    """``doc_id, print, pos, h1, h2``: a row for every line whose key has ``least`` code points.

    ``print`` is the hash of the text: rows of one id and one text get one bitmap.
    """
    text = F.coalesce("text", F.lit(""))
    printed = texts.select("doc_id", F.xxhash64(text).alias("print"), folded(text).alias("text"))  # once a text, not once a line
    cut = printed.select("doc_id", "print", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = cut.withColumn("line", F.btrim("line", F.lit(SPACES))).where(F.char_length("line") >= least)
    return keyed.select("doc_id", "print", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def crowded(texts: DataFrame, least: int) -> tuple[DataFrame, int]:
    """Lines that would fill a good part of a range, with the slices to deal them over, and the number of ranges.

    At most four rows a range come back: each holds a quarter of a range or more in the sample.
    """
    spark = texts.sparkSession
    share = min(1.0, SAMPLE / max(1, texts.count()))
    seen = line_hashes(texts if share == 1.0 else texts.sample(share, seed=13), least).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    seen = cut_lineage(seen)
    total = seen.agg(F.sum("n")).first()[0] or 0
    ranges = parts_for(int(total / share) * ROW_BYTES, RANGE_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    even = max(total / ranges, 1.0)
    slices = F.ceil(F.col("n") * 4 / F.lit(even)).cast("int")
    hot = seen.where((F.col("n") * 4 >= even) & (F.col("n") >= LEAST_SEEN)).select("h1", "h2", F.greatest(slices, F.lit(2)).alias("slices"))
    return cut_lineage(hot), ranges


def later_copies(texts: DataFrame, least: int) -> DataFrame:
    """``doc_id, print, pos`` of the lines that an earlier document holds too."""
    hot, ranges = crowded(texts, least)
    dealt = line_hashes(texts, least).join(F.broadcast(hot), ["h1", "h2"], "left")  # at most four rows a range
    slice_ = F.when(F.col("slices").isNotNull(), F.pmod(F.xxhash64("doc_id", "print", "pos"), "slices").cast("int"))
    dealt = dealt.withColumn("slice", slice_).drop("slices")
    place = F.when(F.col("slice").isNull(), F.col("h1")).otherwise(F.xxhash64("h1", "h2", "slice"))
    at = F.floor((place.cast("double") / float(2**64) + 0.5) * ranges)
    ranged = dealt.withColumn("range", F.least(at, F.lit(ranges - 1)).cast("int")).repartitionById(ranges, F.col("range"))
    order = W.partitionBy("range", "h1", "h2", "slice").orderBy(F.col("doc_id").asc_nulls_last(), "pos")
    streamed = ranged.withColumn("first", F.first("doc_id").over(order)).drop("range")
    later = ~F.col("doc_id").eqNullSafe(F.col("first"))
    found = cut_lineage(streamed.where(later | F.col("slice").isNotNull()))
    heads = found.where("slice IS NOT NULL").groupBy("h1", "h2").agg(F.min("first").alias("head"))
    decided = found.join(F.broadcast(heads), ["h1", "h2"], "left")  # a row for each crowded line
    return decided.where(F.col("slice").isNull() | ~F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "print", "pos")


def keep_bitmaps(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, print, n_dropped, keep``: which lines of a document stay, for documents that lose some.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of
    ``least`` code points or more stay only in the document of the least id that holds them
    (with all their lines there); shorter ones always stay. ``keep`` holds words of 64 lines as
    ``(word, bits)``, bit set: the line stays; words whose lines all stay are left out.
    A null text is one empty line. Null ids are one document after all others; rows of one
    id are one document. An empty table gives no rows, and other columns are not looked at.
    """
    later = later_copies(id_and_text(docs, id_col, text_col), least)
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)).alias("gone")
    words = later.groupBy("doc_id", "print", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(bits)
    entry = F.struct("word", F.bitwise_not("gone").alias("bits"))
    return words.groupBy("doc_id", "print").agg(
        F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"), F.sort_array(F.collect_list(entry)).alias("keep")
    )


def spread_out(keep: Column) -> Column:
    """The words of a bitmap up to its last one, those left out put in again, so that word i is entry i."""
    before = F.concat(F.array(F.lit(-1)), F.transform(F.slice(keep, 1, F.size(keep) - 1), lambda e: e["word"]))
    gaps = F.zip_with(before, keep, lambda b, e: F.concat(F.array_repeat(F.lit(-1).cast("long"), e["word"] - b - 1), F.array(e["bits"])))
    return F.flatten(gaps)


def kept_texts(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` for every row: the lines that stay, joined by newlines."""
    keyed = id_and_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("print", F.xxhash64("text"))
    dense = bitmaps.select(F.col("doc_id").alias("of"), F.col("print").alias("its"), "n_dropped", spread_out(F.col("keep")).alias("words"))
    both = keyed.join(dense, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("print") == F.col("its")), "left")

    def stays(_, i):
        word = F.get("words", F.floor(i / 64).cast("int"))
        return F.coalesce(F.call_function("shiftrightunsigned", word, i % 64).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(True))

    lines = F.split("text", "\n")
    kept = F.when(F.col("words").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    return both.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), kept.alias("kept"))

"""Exact dedup by content-defined chunk recipes, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import key_parts, packed_rows, stage, text_or_empty, unpacked

#: Bytes that decide a chunk's end, and bytes of a chunk, at least and at most.
WINDOW, LEAST, MOST = 10, 64, 4096


def _class(place: int) -> str:
    """What passes at a place of the window: half of ASCII, a third of the bytes that end a character, all other bytes of one."""
    mixed = lambda b: ((b + 1) * (0x9E3779B1 + 2 * place * 0x85EBCA6B) & 0xFFFFFFFF) >> 13
    some = "".join(f"\\x{b:02x}" for b in range(0xC0) if mixed(b) % (2 if b < 0x80 else 3) == 0)
    return rf"(?:[{some}]|[\xc0-\xff]|[\x80-\xbf](?=[\x80-\xbf]))"


#: A chunk of a text's bytes (one character each) ends behind a window whose
#: bytes are all in their classes, whatever the script; about one place in 1000
#: is (in 30 to 400 beyond ASCII), so an edit moves only the boundaries beside it.
CHUNK = rf"(?s).{{{LEAST},{MOST}}}?(?:(?<={''.join(map(_class, range(WINDOW)))})|\z)|.{{1,{MOST}}}"


def short_id(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def recipes(docs: DataFrame, chunk_id: Callable[[Column], Column] = short_id) -> DataFrame:
    """(doc_id, row, text_sha256, ids, alts): each text as the ordered identifiers of its chunks.

    A chunk's identifier is a 64-bit hash, verified over the whole table by 128
    bits of its SHA-256: where chunks that differ in these share a hash, each of
    them gets a number of its own (``alts``, by position; null for documents
    without such a chunk).
    """
    text = text_or_empty()
    # Bytes as characters: expressions see single bytes.
    chars = F.decode(text.cast("binary"), "ISO-8859-1")
    cut = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.sha2(text, 256).alias("text_sha256"), F.regexp_extract_all(chars, F.lit(CHUNK), F.lit(0)).alias("chunks"))
    cut = cut.select("doc_id", "row", "text_sha256", F.transform("chunks", chunk_id).alias("ids"), F.transform("chunks", lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 32))).alias("digests"))
    cut = stage(cut, "recipes")
    chunks = cut.select("row", F.explode(F.arrays_zip("ids", "digests")).alias("c")).select("row", F.col("c.ids").alias("id"), F.col("c.digests").alias("digest"))
    clash = chunks.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("id")
    clash = stage(clash, "clash")
    plain = cut.select("doc_id", "row", "text_sha256", "ids")
    if clash.isEmpty():
        return plain.withColumn("alts", F.lit(None).cast("array<int>"))
    numbered = chunks.join(clash, "id", "left_semi").select("id", "digest").distinct()
    numbered = numbered.withColumn("alt", F.row_number().over(Window.partitionBy("id").orderBy("digest")))
    placed = cut.select("row", F.posexplode(F.arrays_zip("ids", "digests")).alias("pos", "c")).select("row", "pos", F.col("c.ids").alias("id"), F.col("c.digests").alias("digest"))
    alts = placed.join(stage(numbered, "numbered"), ["id", "digest"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "alt"))).alias("alts"))
    alts = alts.select("row", F.transform("alts", lambda x: x["alt"]).alias("alts"))
    return plain.join(alts, "row", "left")


def exact_groups(docs: DataFrame, chunk_id: Callable[[Column], Column] = short_id) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Documents are equal when their ordered identifier lists are; of each group
    the texts' SHA-256 is asserted to be one.  Only identifiers and hashes move,
    never a text.  Groups are counted before they are shuffled and joined back
    to the rows, where adaptive execution splits a group that holds many rows.

    Null text counts as empty, and empty texts equal one another.  A very long
    text is cut like any other; its list has one identifier a kilobyte, about.
    The largest doc_id stays; of rows that repeat it, one stays.  A null doc_id
    is smaller than any other.  An empty table gives no rows; other columns are
    not read, whatever their names.
    """
    listed = stage(recipes(docs, chunk_id), "lists")
    key = F.xxhash64("ids", "alts")
    groups = listed.groupBy("ids", "alts").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"), F.min("text_sha256").alias("lo"), F.max("text_sha256").alias("hi"))
    groups = groups.where(F.assert_true(F.col("lo") == F.col("hi"), "texts that differ have one recipe").isNull())
    groups = stage(groups.select(key.alias("key"), F.col("ids").alias("g_ids"), F.col("alts").alias("g_alts"), F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size"), "groups")
    out = listed.withColumn("key", key).join(groups, "key")
    out = out.where(F.col("ids").eqNullSafe(F.col("g_ids")) & F.col("alts").eqNullSafe(F.col("g_alts")))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long"), (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns unchanged, whatever their names.

    That of the largest doc_id stays (a null one only without another), and one
    row of those that repeat it; null and empty texts are one group; an empty
    table gives no rows.  A row and its text move once: rows that repeat another
    whole are cut before, and the join that follows needs no other shuffle.
    """
    keep = exact_groups(docs).where("kept").select(*[c.alias(k) for k, c in key_parts().items()], F.col("text_sha256").alias("sha"))
    rows = packed_rows(docs, sha=F.sha2(text_or_empty(), 256), **key_parts())
    once = F.row_number().over(Window.partitionBy("no_id", "id", "sha").orderBy("sha"))
    rows = rows.withColumn("turn", once).where("turn = 1").drop("turn")
    return unpacked(rows.join(keep, ["no_id", "id", "sha"], "left_semi"))

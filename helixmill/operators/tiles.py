"""Reference sequences in tiles that overlap: bases at a place are fetched by an equi-join on (contig, tile), and no row holds a contig as one string.

A tile holds `tile` bases from a multiple of `tile` on, and the first `halo` bases after it, so a span of up to halo bases that starts in a tile ends in its row. Requests are dealt by (contig, tile), so those of one chromosome
spread over its tiles, and only a tile's bases meet its requests. Bases are kept as bytes, where a span is cut without a walk from the tile's start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.scratch import few

TILE = 4096


def of_sequences(contigs: DataFrame, *, tile: int = TILE) -> DataFrame:
    """contig, start, sequence in tiles, from rows of whole sequences (contig, sequence); read_fasta makes the same from a file."""
    starts = F.sequence(F.lit(0).cast("long"), F.length("sequence").cast("long") - 1, F.lit(tile).cast("long"))
    cut = contigs.where(F.length("sequence") > 0).select("contig", "sequence", F.explode(starts).alias("start"))
    return cut.select("contig", "start", F.substring("sequence", (F.col("start") + 1).cast("int"), F.lit(tile)).alias("sequence"))


def with_halo(tiles: DataFrame, halo: int, *, tile: int = TILE) -> DataFrame:
    """Tiles (contig, start, sequence as bytes) lengthened by the first bases of the tile after them."""
    if not 0 < halo <= tile:
        raise ValueError("a halo is from one base to a tile")
    bases = tiles.select("contig", "start", F.col("sequence").cast("binary").alias("sequence"))
    after = bases.where(F.col("start") > 0).select("contig", (F.col("start") - tile).alias("start"), F.substring("sequence", 1, halo).alias("more"))
    return bases.join(after, ["contig", "start"], "left").select("contig", "start", F.concat("sequence", F.coalesce("more", F.lit(b""))).alias("sequence"))


def lengths(tiles: DataFrame) -> DataFrame:
    """contig, length, of tiles with or without a halo; one row a contig, broadcast if they are few."""
    return few(tiles.groupBy("contig").agg(F.max(F.col("start") + F.length("sequence")).alias("length")), "lengths")


def fetch(requests: DataFrame, tiles: DataFrame, at: Column, width: Column | int, name: str, *, tile: int = TILE) -> DataFrame:
    """requests (contig) with `name`: up to `width` bases from the 0-based place `at` on, fewer where the contig ends; null without the contig, or where it has ended.

    tiles come from with_halo, whose halo is the greatest width. An `at` below 0 is an error of the caller."""
    wanted = requests.withColumn("_at", at.cast("long")).withColumn("_start", F.col("_at") - F.col("_at") % tile)
    held = tiles.select("contig", F.col("start").alias("_start"), F.col("sequence").alias("_bases"))
    size = F.lit(width) if isinstance(width, int) else width
    cut = F.substring("_bases", (F.col("_at") - F.col("_start") + 1).cast("int"), size.cast("int")).cast("string")
    return wanted.join(held, ["contig", "_start"], "left").withColumn(name, F.nullif(cut, F.lit(""))).drop("_at", "_start", "_bases")


def against_reference(rows: DataFrame, tiles: DataFrame, *, longest: int, tile: int = TILE) -> DataFrame:
    """rows (contig, pos, ref) with reads: missing_contig, outside (REF passes the contig's end, or is longer than `longest`, the halo), mismatch or match."""
    known = rows if "length" in rows.columns else rows.join(lengths(tiles), "contig", "left")
    met = fetch(known, tiles, F.greatest(F.col("pos") - 1, F.lit(0)), F.length("ref"), "_read", tile=tile)
    inside = (F.col("pos") >= 1) & (F.col("pos") - 1 + F.length("ref") <= F.col("length")) & (F.length("ref") <= longest)
    reads = F.when(F.col("length").isNull(), "missing_contig").when(~inside, "outside").when(F.col("_read") == F.upper("ref"), "match").otherwise("mismatch")
    return met.withColumn("reads", reads).drop("_read")

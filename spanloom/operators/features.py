"""Features of gene models (BED12)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import c, check_interval

BED12 = ["chrom", "start", "end", "name", "score", "strand", "cds_start", "cds_end", "item_rgb", "exon_count", "exon_sizes", "exon_starts"]
BED6 = BED12[:6]


def _exons(x: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Exons of each row with their number from the 5' end."""
    x = check_interval(x)
    if len(x.columns) != 12:
        raise ValueError("expected 12 column input")
    if not {"exon_sizes", "exon_starts"} <= set(x.columns):
        x = x.toDF(*BED12)
    types = dict(x.dtypes)
    if bad := [n for n in ("exon_sizes", "exon_starts") if types[n] != "string"]:
        raise ValueError(f"does not look like BED12 input: {', '.join(bad)} must be comma-separated strings")
    # the list ends at its first empty field
    field = lambda n: F.split(F.regexp_replace(c(n), ",(,.*)?$", ""), ",")
    pairs = F.filter(F.arrays_zip(field("exon_sizes").alias("size"), field("exon_starts").alias("at")), lambda p: p["size"].isNotNull() & p["at"].isNotNull() & (p["size"] != "") & (p["at"] != ""))
    x = x.select("chrom", "start", "name", "strand", F.posexplode(pairs).alias("i", "p"), F.size(pairs).alias("n"))
    start = c("start") + F.col("p.at").cast("long")
    number = F.when(c("strand") == "-", F.col("n") - F.col("i")).otherwise(F.col("i") + 1)
    return x.select("chrom", start.alias("start"), (start + F.col("p.size").cast("long")).alias("end"), "name", number.cast("long").alias("score"), "strand")


def bed12_to_exons(x: DataFrame | str, sort: bool = False) -> DataFrame:
    """A BED6 row per exon; score is the exon's number from the 5' end. ``x`` may be the path of a bigBed file of twelve fields."""
    if isinstance(x, str):
        from ..sources.bigbinary import read_bigbed12

        x = read_bigbed12(SparkSession.active(), x)
    out = _exons(x)
    return out.orderBy("chrom", "start", "end") if sort else out


def create_introns(x: DataFrame, key: Sequence[str] = ("name",)) -> DataFrame:
    """The gaps between a gene's exons. ``key`` names a gene; add chrom where names repeat across loci."""
    w = Window.partitionBy(*map(c, key)).orderBy("chrom", "start", "end")
    nxt = F.lead("start").over(w)
    score = F.when(c("strand") == "+", c("score")).otherwise(c("score") - 1)
    out = _exons(x).withColumns({"__next": nxt, "__score": score})
    return out.where(c("end") < c("__next")).select("chrom", c("end").alias("start"), c("__next").alias("end"), "name", c("__score").alias("score"), "strand").dropna()


def _by_strand(x: DataFrame, plus: tuple[Column, Column], minus: tuple[Column, Column]) -> DataFrame:
    up = c("strand") == "+"
    x = check_interval(x).withColumns({"start": F.when(up, plus[0]).otherwise(minus[0]), "end": F.when(up, plus[1]).otherwise(minus[1])})
    return x.select(*map(c, BED6))


def create_utrs5(x: DataFrame) -> DataFrame:
    """5' untranslated regions."""
    return _by_strand(x, (c("start"), c("cds_start")), (c("cds_end"), c("end"))).where("start < end")


def create_utrs3(x: DataFrame) -> DataFrame:
    """3' untranslated regions."""
    return _by_strand(x, (c("cds_end"), c("end")), (c("start"), c("cds_start"))).where("start < end")


def create_tss(x: DataFrame) -> DataFrame:
    """Transcription start sites, one base each."""
    return _by_strand(x, (c("start"), c("start") + 1), (c("end") - 1, c("end")))

"""BED-family, VCF and genome files as DataFrames. Plain or gzipped text is read by Spark, one split per block of plain files."""

from __future__ import annotations

import posixpath
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import c

_TYPES = {"s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType()}


def _schema(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split(":") for f in spec.split())])


# The formats' columns.
BED12 = _schema("chrom:s start:l end:l name:s score:s strand:s cds_start:l cds_end:l item_rgb:s exon_count:i exon_sizes:s exon_starts:s")
NARROW_PEAK = _schema("chrom:s start:l end:l name:s score:i strand:s signal:d pvalue:d qvalue:d peak:i")


def extension(path: str) -> str:
    """Extension of a path or URL without query and fragment, in lower case."""
    return posixpath.splitext(urlsplit(path).path if "://" in path else path.split("?")[0].split("#")[0])[1].lower()


def is_bigwig_path(path: object) -> bool:
    return isinstance(path, str) and extension(path) in (".bw", ".bigwig")


def is_bigbed_path(path: object) -> bool:
    return isinstance(path, str) and extension(path) in (".bb", ".bigbed")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    return lines.where(~F.col("value").rlike(r"^(#|track\b|browser\b)") & (F.trim("value") != ""))


def sniff_fields(spark: SparkSession, path: str) -> int:
    """Fields of the file, from its first ten data lines."""
    return max((len(r.value.split("\t")) for r in _lines(spark, path).head(10)), default=0)


def _read(spark: SparkSession, path: str, schema: T.StructType, n: int) -> DataFrame:
    """The first ``n`` fields; start, end and size must be numbers, other fields that don't fit their type are null."""
    parts = F.split("value", "\t")

    def field(i: int, f: T.StructField) -> Column:
        raw = F.get(parts, F.lit(i))
        value = raw.try_cast(f.dataType)
        if f.name in ("start", "end", "size"):
            value = F.when(value.isNull(), F.raise_error(F.concat(F.lit(f"no number for {f.name} in line: "), "value")).cast("long")).otherwise(value)
        return value.alias(f.name)

    return _lines(spark, path).select(*(field(i, f) for i, f in enumerate(schema.fields[:n])))


def read_bed(spark: SparkSession, path: str, sort: bool = True, schema: T.StructType = BED12) -> DataFrame:
    """BED with 3 to 12 fields; the number is found in the file. Header, track and browser lines are skipped."""
    n = sniff_fields(spark, path)
    if not 3 <= n:
        raise ValueError(f"expected at least 3 fields, found {n}")
    out = _read(spark, path, schema, min(n, len(schema.fields)))
    return out.orderBy("chrom", "start", "end") if sort else out


def read_bed12(spark: SparkSession, path: str) -> DataFrame:
    if (n := sniff_fields(spark, path)) != 12:
        raise ValueError(f"expected 12 columns in bed12, found {n}")
    return read_bed(spark, path)


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, value."""
    if (n := sniff_fields(spark, path)) != 4:
        raise ValueError(f"expected 4 columns in bedgraph, found {n}")
    return _read(spark, path, _schema("chrom:s start:l end:l value:d"), 4)


def read_narrowpeak(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, NARROW_PEAK, 10)


def read_broadpeak(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, NARROW_PEAK, 9)


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """All VCF columns as strings (POS long), with chrom ("chr" + CHROM) in place of CHROM, start (POS) and end (POS + length of REF)."""
    header = spark.read.text(path).where(F.col("value").startswith("#CHROM")).head(1)
    if not header:
        raise ValueError("no #CHROM line")
    names = header[0].value.lstrip("#").split("\t")
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    out = rows.select(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names))).withColumn("POS", c("POS").cast("long"))
    return out.withColumns({"chrom": F.concat(F.lit("chr"), c("CHROM")), "start": c("POS"), "end": c("POS") + F.length(c("REF"))})


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    """chrom and size, largest first."""
    return _read(spark, path, _schema("chrom:s size:l"), 2).orderBy(F.desc("size"))


def read_gtf(*_: object) -> DataFrame:
    raise NotImplementedError("read_gtf is defunct: GTF attributes need a dedicated parser")


def write_bed(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The BED columns of ``df`` in format order, tab-separated; missing text is a dot."""
    names = [f.name for f in BED12.fields if f.name in df.columns]
    df.select(*(F.coalesce(c(n).cast("string"), F.lit(".")).alias(n) for n in names)).write.mode(mode).option("sep", "\t").option("emptyValue", "").csv(path)


def write_bedgraph(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select("chrom", "start", "end", "value").write.mode(mode).option("sep", "\t").csv(path)

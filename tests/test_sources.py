"""Readers and writers, and the streaming verbs."""

import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

import spanloom as S
from spanloom.sources import bigbinary
from spanloom.sources.bed import extension, is_bigbed_path, is_bigwig_path
from spanloom.sources.db import db_ensembl, db_ucsc
from spanloom.streaming import merge_stream, overlap_stream
from tests.helpers import gen, ivl, rows


def write(path, text):
    with (gzip.open if str(path).endswith(".gz") else open)(path, "wt") as f:
        f.write(text)
    return str(path)


def test_bed_family(spark, tmp_path):
    bed = write(tmp_path / "a.bed", "#chr\tstart\nbrowser x\ntrack y\nchr1\t20\t30\tb\t5\t-\tfoo\nchr1\t1\t9\ta\t7\t+\tbar\n")
    df = S.read_bed(spark, bed)
    assert df.columns[:6] == ["chrom", "start", "end", "name", "score", "strand"] and rows(df, "start", "strand") == [(1, "+"), (20, "-")]
    three = write(tmp_path / "b.bed.gz", "chr1\t1\t9\n")
    assert S.read_bed(spark, three).columns == ["chrom", "start", "end"]
    with pytest.raises(ValueError, match="12"):
        S.read_bed12(spark, three)
    assert rows(S.read_bedgraph(spark, write(tmp_path / "c.bg", "chr1\t1\t9\t0.5\n"))) == [("chr1", 1, 9, 0.5)]
    peak = write(tmp_path / "d.narrowPeak", "chr1\t1\t9\tp\t10\t.\t1.5\t2.5\t3.5\t4\n")
    assert rows(S.read_narrowpeak(spark, peak), "signal", "peak") == [(1.5, 4)] and len(S.read_broadpeak(spark, peak).columns) == 9
    vcf = write(tmp_path / "e.vcf", "##x\n#CHROM\tPOS\tID\tREF\tALT\n1\t100\t.\tAC\tG\n")
    assert rows(S.read_vcf(spark, vcf), "chrom", "start", "end", "ALT") == [("chr1", 100, 102, "G")]
    assert [r.chrom for r in S.read_genome(spark, write(tmp_path / "g", "a\t5\nb\t9\n")).collect()] == ["b", "a"]
    with pytest.raises(NotImplementedError):
        S.read_gtf(spark, "x")


def test_write_and_names(spark, tmp_path):
    x = ivl(spark, [("chr1", 1, 9, "n", 0.5)], "name string, value double")
    S.write_bed(x, str(tmp_path / "o"))
    assert rows(S.read_bed(spark, str(tmp_path / "o")), "start", "name") == [(1, "n")]
    S.write_bedgraph(x, str(tmp_path / "w"))
    assert rows(S.read_bedgraph(spark, str(tmp_path / "w")), "value") == [(0.5,)]
    assert is_bigwig_path("http://h/x.bw?a=1.bb") and is_bigbed_path("x.BB") and not is_bigwig_path(x) and extension("a.bed#f.bw") == ".bed"
    assert db_ucsc("hg38")["url"].endswith("/hg38") and "3307" in db_ensembl("x", port=3307)["url"]


def big_file(path, magic, chroms, blocks, fields=0, defined=0):
    """A small file of the format: one tree leaf each for chromosomes and blocks; blocks are (chrom id, start, end, bytes)."""
    key = max(len(c) for c, _ in chroms)
    tree = struct.pack("<IIIIQQ", 0x78CA8C91, 256, key, 8, len(chroms), 0) + struct.pack("<BBH", 1, 0, len(chroms))
    tree += b"".join(c.encode().ljust(key, b"\0") + struct.pack("<II", i, size) for i, (c, size) in enumerate(chroms))
    at, data, leaf = 64 + len(tree), b"", b""
    for chrom, s, e, raw in blocks:
        packed = zlib.compress(raw)
        leaf += struct.pack("<IIIIQQ", chrom, s, chrom, e, at + len(data), len(packed))
        data += packed
    index = struct.pack("<IIQIIIIQII", 0x2468ACE0, 256, len(blocks), 0, 0, 9, 9, 0, 1, 0) + struct.pack("<BBH", 1, 0, len(blocks)) + leaf
    head = struct.pack("<IHHQQQHHQQIQ", magic, 4, 0, 64, 0, at + len(data), fields, defined, 0, 0, 1 << 15, 0)
    path.write_bytes(head + tree + data + index)
    return str(path)


def test_malformed_coordinates(spark, tmp_path):
    (tmp_path / "bad.bed").write_text("chr1\t5\tx\nchr1\t6\t7\n")
    with pytest.raises(Exception, match="no number for end in line: chr1"):
        S.read_bed(spark, str(tmp_path / "bad.bed")).collect()


def test_bigwig(spark, tmp_path):
    part = lambda c, s, kind, step, span, items, n: struct.pack("<IIIIIBBH", c, s, 0, step, span, kind, 0, n) + items
    blocks = [
        (0, 10, 40, part(0, 10, 1, 0, 0, struct.pack("<IIfIIf", 10, 20, 1.5, 30, 40, 2.5), 2)),
        (0, 100, 110, part(0, 100, 2, 0, 5, struct.pack("<IfIf", 100, 3.0, 105, 4.0), 2)),
        (1, 0, 20, part(1, 0, 3, 10, 10, struct.pack("<ff", 5.0, 6.0), 2)),
    ]
    path = big_file(tmp_path / "t.bw", bigbinary.BIGWIG, [("chr1", 500), ("chr2", 500)], blocks)
    every = [("chr1", 10, 20, 1.5), ("chr1", 30, 40, 2.5), ("chr1", 100, 105, 3.0), ("chr1", 105, 110, 4.0), ("chr2", 0, 10, 5.0), ("chr2", 10, 20, 6.0)]
    assert rows(S.read_bigwig(spark, path)) == every
    assert rows(S.read_bigwig(spark, path, [("chr1", 15, 31)])) == every[:2]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert rows(S.read_bigwig(spark, path).where("chrom = 'chr1' and start >= 100")) == every[2:4]
    assert rows(bigbinary.read_bigwig_regions(spark, path, ivl(spark, [("chr2", 5, 6), ("chr2", 5, 7)]))) == every[4:5]
    assert rows(bigbinary.read_bigwig_regions(spark, path, ivl(spark, [("chr2", 5, 6), ("chr1", 5, 11)]), most=1)) == [every[0], every[4]]
    with pytest.raises(ValueError, match="not a file"):
        bigbinary.read_header(path, bigbinary.BIGBED)
    x, y = ivl(spark, [("chr1", 15, 35), ("chr2", 8, 12), ("chr1", 200, 300)]), S.read_bigwig(spark, path)
    sizes = gen(spark, chr1=500, chr2=500)
    for verb in (S.bed_intersect, S.bed_coverage, S.bed_subtract, lambda x, y: S.bed_map(x, y, total=F.sum("value")), lambda x, y: S.bed_window(x, y, sizes, both=3)):
        assert rows(verb(x, path)) == rows(verb(x, y)) != []
    assert rows(S.bed_intersect(x, path, invert=True)) == [("chr1", 200, 300)]
    with pytest.raises(ValueError, match="path"):
        S.bed_intersect(x, "t.bed")


def test_bigbed(spark, tmp_path):
    raw = struct.pack("<III", 0, 100, 500) + b"g\t0\t+\t150\t450\t0\t2\t50,100\t0,300\0"
    path = big_file(tmp_path / "t.bb", bigbinary.BIGBED, [("chr1", 900)], [(0, 100, 500, raw)], 12, 12)
    df = bigbinary.read_bigbed12(spark, path)
    assert rows(df, "start", "name", "cds_end") == [(100, "g", 450)]
    assert rows(S.bed12_to_exons(df), "start", "end") == [(100, 150), (400, 500)]
    assert rows(S.bed12_to_exons(path)) == rows(S.bed12_to_exons(df))


def test_streams(spark, tmp_path):
    src = ivl(spark, [("chr1", 5, 15), ("chr1", 100, 120)])
    src.write.parquet(str(tmp_path / "in"))
    y = ivl(spark, [("chr1", 10, 110)])
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = overlap_stream(stream, y).writeStream.format("memory").queryName("hits").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("hits"), "`start.x`".strip("`"), ".overlap") == [(5, 5), (100, 10)]
    t = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:05"), ("a", "2024-01-01 00:10:00")], "chrom string, t string").select("chrom", F.to_timestamp("t").alias("t"))
    assert rows(merge_stream(t, "t", "10 seconds", "1 minute"), "n") == [(1,), (2,)]

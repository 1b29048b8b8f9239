"""bigWig and bigBed as a Spark data source, after the published format: header, chromosome B+ tree, R-tree of data blocks.

``spark.read.format("bigwig").load(path)``; option ``regions`` ("chr1:100-200,chr2:0-50", or a chromosome alone) reads only the
blocks that meet them, and equality filters on chrom and bounds on start and end are pushed down with option ``pushdown``, which
``read_bigwig`` and ``read_bigbed`` set where ``spark.sql.python.filterPushdown.enabled`` is. Runs of data blocks are the partitions. Paths are local to every executor (a
mounted store); ``register(spark)`` makes the formats known.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

# Magic numbers of the format.
BIGWIG, BIGBED, CHROM_TREE, DATA_TREE = 0x888FFC26, 0x8789F2EB, 0x78CA8C91, 0x2468ACE0
#: Compressed bytes that one partition reads.
PART_BYTES = 16 << 20


@dataclass
class Header:
    order: str
    chroms: dict[str, tuple[int, int]]  # name: id, size
    index: int
    packed: bool
    fields: int
    defined: int


def _path(path: str) -> str:
    return path.removeprefix("file://")


def read_header(path: str, magic: int) -> Header:
    with open(_path(path), "rb") as f:
        raw = f.read(64)
        order = next((o for o in "<>" if len(raw) == 64 and struct.unpack(o + "I", raw[:4])[0] == magic), None)
        if order is None:
            raise ValueError(f"not a file of this format: {path}")
        _, _, _, tree, _, index, fields, defined, _, _, buffer, _ = struct.unpack(order + "IHHQQQHHQQIQ", raw)
        return Header(order, dict(_chroms(f, order, tree)), index, buffer > 0, fields, defined)


def _chroms(f, order: str, at: int) -> Iterator[tuple[str, tuple[int, int]]]:
    f.seek(at)
    magic, _, key, _, _, _ = struct.unpack(order + "IIIIQQ", f.read(32))
    if magic != CHROM_TREE:
        raise ValueError("no chromosome tree")
    todo = [at + 32]
    while todo:
        f.seek(todo.pop())
        leaf, _, n = struct.unpack(order + "BBH", f.read(4))
        for _ in range(n):
            name = f.read(key).rstrip(b"\0").decode()
            if leaf:
                yield name, struct.unpack(order + "II", f.read(8))
            else:
                todo.append(struct.unpack(order + "Q", f.read(8))[0])


def blocks(path: str, h: Header, wanted: list[tuple[int, int, int]] | None) -> Iterator[tuple[int, int]]:
    """Offset and size of the data blocks that meet one of the wanted (chromosome id, start, end), all if None."""
    hit = lambda c0, s, c1, e: wanted is None or any((c0, s) < (k, z) and (k, a) < (c1, e) for k, a, z in wanted)
    with open(_path(path), "rb") as f:
        f.seek(h.index)
        if struct.unpack(h.order + "I", f.read(4))[0] != DATA_TREE:
            raise ValueError("no data index")
        todo = [h.index + 48]
        while todo:
            f.seek(todo.pop())
            leaf, _, n = struct.unpack(h.order + "BBH", f.read(4))
            size, more = (32, "IIIIQQ") if leaf else (24, "IIIIQ")
            raw = f.read(size * n)
            for i in range(n):
                c0, s, c1, e, *rest = struct.unpack_from(h.order + more, raw, i * size)
                if hit(c0, s, c1, e):
                    if leaf:
                        yield rest[0], rest[1]
                    else:
                        todo.append(rest[0])


def _wig(order: str, raw: bytes) -> Iterator[tuple[int, int, int, float]]:
    chrom, start, _, step, span, kind, _, n = struct.unpack_from(order + "IIIIIBBH", raw)
    if kind == 1:
        for s, e, v in struct.iter_unpack(order + "IIf", raw[24 : 24 + 12 * n]):
            yield chrom, s, e, v
    elif kind == 2:
        for s, v in struct.iter_unpack(order + "If", raw[24 : 24 + 8 * n]):
            yield chrom, s, s + span, v
    else:
        for i, (v,) in enumerate(struct.iter_unpack(order + "f", raw[24 : 24 + 4 * n])):
            yield chrom, start + i * step, start + i * step + span, v


def _bed(order: str, raw: bytes) -> Iterator[tuple]:
    at = 0
    while at + 12 <= len(raw):
        chrom, s, e = struct.unpack_from(order + "III", raw, at)
        stop = raw.index(b"\0", at + 12)
        yield chrom, s, e, *raw[at + 12 : stop].decode().split("\t")
        at = stop + 1


@dataclass
class Part(InputPartition):
    blocks: list

    def __init__(self, blocks: list):
        super().__init__(None)
        self.blocks = blocks


def parse_regions(text: str) -> list[tuple[str, int, int]]:
    out = []
    for r in filter(None, (p.strip() for p in text.split(","))):
        name, _, span = r.rpartition(":") if ":" in r else (r, "", "")
        a, _, z = span.partition("-")
        out.append((name, int(a or 0), int(z or 2**32 - 1)))
    return out


class _Reader(DataSourceReader):
    def __init__(self, path: str, magic: int, names: list[str], regions: list[tuple[str, int, int]] | None):
        self.path, self.magic, self.names, self.regions = path, magic, names, regions
        self.chrom, self.low, self.high = None, None, None

    def _wanted(self, h: Header) -> list[tuple[int, int, int]] | None:
        if self.regions is None and self.chrom is None and self.low is None and self.high is None:
            return None
        given = self.regions if self.regions is not None else [(n, 0, 2**32 - 1) for n in h.chroms]
        low, high = self.low or 0, self.high if self.high is not None else 2**32 - 1
        return [(h.chroms[n][0], max(a, low), min(z, high)) for n, a, z in given if n in h.chroms and self.chrom in (None, n)]

    def partitions(self):
        h = read_header(self.path, self.magic)
        out, held, size = [], [], 0
        for at, n in sorted(blocks(self.path, h, self._wanted(h))):
            held.append((at, n))
            size += n
            if size >= PART_BYTES:
                out.append(Part(held))
                held, size = [], 0
        return [*out, Part(held)] if held or not out else out

    def read(self, partition):
        h = read_header(self.path, self.magic)
        names = {k: n for n, (k, _) in h.chroms.items()}
        wanted = self._wanted(h) if self.regions is not None else None
        width = len(self.names)
        with open(_path(self.path), "rb") as f:
            for at, n in partition.blocks:
                f.seek(at)
                raw = f.read(n)
                raw = zlib.decompress(raw) if h.packed else raw
                for chrom, s, e, *rest in (_wig if self.magic == BIGWIG else _bed)(h.order, raw):
                    if wanted is None or any(chrom == k and s < z and a < e for k, a, z in wanted):
                        if self.magic == BIGBED:
                            rest = [*rest, *[None] * width][: width - 3]
                        yield names[chrom], s, e, *rest


class _PushedReader(_Reader):
    """Spark accepts this method only where filter pushdown is enabled."""

    def pushFilters(self, filters):
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if isinstance(f, EqualTo) and name == "chrom":
                self.chrom = f.value
            elif name == "end" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low or 0, f.value - isinstance(f, GreaterThanOrEqual))
            elif name == "start" and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high or 2**32, f.value + isinstance(f, LessThanOrEqual))
            yield f  # blocks are pruned here, rows by Spark


class BigWigSource(DataSource):
    """Format "bigwig": chrom, start, end, value."""

    MAGIC, TAIL = BIGWIG, ["value"]

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def _names(self) -> list[str]:
        return ["chrom", "start", "end", "value"]

    def schema(self) -> str:
        return "chrom string, start long, end long, value double"

    def reader(self, schema) -> DataSourceReader:
        text = self.options.get("regions")
        kind = _PushedReader if self.options.get("pushdown") == "true" else _Reader
        return kind(self.options["path"], self.MAGIC, self._names(), None if text is None else parse_regions(text))


class BigBedSource(BigWigSource):
    """Format "bigbed": the first three columns typed, the others strings under their BED names."""

    MAGIC = BIGBED

    @classmethod
    def name(cls) -> str:
        return "bigbed"

    def _names(self) -> list[str]:
        from .bed import BED12

        h = read_header(self.options["path"], BIGBED)
        names = [f.name for f in BED12.fields][: h.defined]
        return [*names, *(f"field{i + 1}" for i in range(len(names), h.fields))]

    def schema(self) -> str:
        return ", ".join(f"`{n}` {'long' if n in ('start', 'end') else 'string'}" for n in self._names())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BigWigSource)
    spark.dataSource.register(BigBedSource)


def _load(spark: SparkSession, kind: str, path: str, regions: list[tuple[str, int, int]] | None) -> DataFrame:
    register(spark)
    reader = spark.read.format(kind).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if regions is not None:
        reader = reader.option("regions", ",".join(f"{n}:{a}-{z}" for n, a, z in regions))
    return reader.load(path)


def read_bigwig(spark: SparkSession, path: str, regions: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """A bigWig file, or its entries that meet (chrom, start, end) regions."""
    return _load(spark, "bigwig", path, regions)


def read_bigbed(spark: SparkSession, path: str, regions: list[tuple[str, int, int]] | None = None) -> DataFrame:
    return _load(spark, "bigbed", path, regions)


def read_bigbed12(spark: SparkSession, path: str) -> DataFrame:
    if (n := read_header(path, BIGBED).defined) != 12:
        raise ValueError(f"expected 12 defined fields, found {n}")
    df = read_bigbed(spark, path)
    return df.withColumns({n: df[n].cast("long") for n in ("cds_start", "cds_end")}).withColumn("exon_count", df["exon_count"].cast("int"))


def read_bigwig_regions(spark: SparkSession, path: str, x: DataFrame, most: int = 10_000) -> DataFrame:
    """Entries that overlap rows of ``x``, once each; few regions (at most ``most``) prune the file's blocks, more are joined."""
    from ..operators.joins import bed_intersect
    from ..plans.islands import merged

    kind = "bigwig" if is_bigwig(path) else "bigbed"
    some = merged(x, ["chrom"]).limit(most + 1).collect()
    entries = _load(spark, kind, path, [(r.chrom, r.start, r.end) for r in some] if len(some) <= most else None)
    if len(some) > most:
        met = bed_intersect(entries.select("chrom", "start", "end").distinct(), x.select("chrom", "start", "end"))
        entries = entries.join(met.selectExpr("chrom", "`start.x` as start", "`end.x` as end").distinct(), ["chrom", "start", "end"], "left_semi")
    return entries.distinct()


def is_bigwig(path: str) -> bool:
    from .bed import is_bigwig_path

    return is_bigwig_path(path)

"""Small interval tables and their rows."""


def ivl(spark, rows, extra=""):
    """A table of (chrom, start, end, ...) rows; ``extra`` lists further columns as DDL."""
    return spark.createDataFrame([tuple(r) for r in rows], "chrom string, start long, `end` long" + (f", {extra}" if extra else ""))


def gen(spark, **sizes):
    return spark.createDataFrame(list(sizes.items()), "chrom string, size long")


def rows(df, *names):
    names = names or df.columns
    key = lambda t: tuple((v is not None, v) for v in t)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=key)

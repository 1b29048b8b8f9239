"""Benchmark decontamination by template canonicalisation; DataFrame functions only.

Numbers, names and units of a text become typed placeholders, other words lose case and punctuation. Windows of template words
are hash-joined with the benchmark's, which are taken in blocks of a checked size so that each block's broadcast is bounded.
Along each alignment of a document with an item the placeholders' values must map consistently (one value of the item to one
value of the document; windows that hold a value with several do not count), which catches re-parameterised questions and drops chance matches of frames. Windows of mostly
placeholders say too little as templates; they are joined by all their words instead, values included.

Edge cases: null and empty texts match nothing; items shorter than the window use one window of their own length; windows of
mostly placeholders match only word for word; rows that share an id are judged together by ``contaminated`` and all go in ``clean``; a null
id is an id; repeated items and empty tables are fine; other columns are kept by ``clean`` and ignored by ``contaminated``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import let
from .sieve import bitmap, literal, may_hold
from .storage import materialize

# Fixed values.
PUNCTUATION = ".,;:!?\"'()[]{}<>#*$%&|`~^_=+/\\-"
UNITS = ["km", "m", "cm", "mm", "kg", "g", "mg", "lb", "l", "ml", "h", "hours", "min", "minutes", "s", "seconds", "days", "years", "usd", "eur", "dollars", "euros", "percent", "miles", "feet"]
#: Characters that mark placeholders and part values inside; they leave a text's words.
CONTROLS = "\x01\x02\x03"
WINDOW = 8
#: Windows of the benchmark in one broadcast (about 50 bytes each).
BLOCK = 1_000_000


def _canonical(word: Column, before: Column, first: Column) -> Column:
    """Struct of the template word t and the slot's value v ('' for ordinary words)."""
    core = F.translate(word, PUNCTUATION + CONTROLS, "")

    def typed(c: Column) -> Column:
        low, head = F.lower(c), F.substring(c, 1, 1)
        number = (head >= "0") & (head <= "9")
        prev = F.translate(before, PUNCTUATION + CONTROLS, "")
        unit = low.isin(UNITS) & (F.substring(prev, 1, 1) >= "0") & (F.substring(prev, 1, 1) <= "9")
        second = F.substring(c, 2, 1)
        name = (head != F.lower(head)) & (second == F.lower(second)) & ~first & ~F.substring(before, -1, 1).isin(".", "!", "?", ":", "\"")
        slot = lambda kind: F.struct(F.lit(kind).alias("t"), low.alias("v"))
        return F.when(number, slot("\x01n")).when(unit, slot("\x01u")).when(name, slot("\x01p")).otherwise(F.struct(low.alias("t"), F.lit("").alias("v")))

    return let(core, typed)


def windows(df: DataFrame, sizes: list[int], keep: list[str], bits: list[int] | None = None, exact: bool = False) -> DataFrame:
    """keep columns, size, pos, total (words), exact, hash and values of every window of ``text`` with at least half ordinary words.

    With ``exact``, every window is there again, flagged, with the hash of its words in place of the template's. With ``bits``, a
    fixed-size bitmap of wanted hashes, only windows whose bit is set become rows.
    """
    raw = F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")
    typed = let(raw, lambda ws: F.filter(F.transform(ws, lambda w, i: _canonical(w, F.when(i > 0, F.get(ws, i - 1)).otherwise(F.lit("")), i == 0)), lambda x: x["t"] != ""))
    wanted = None if bits is None else literal(bits)

    def cut(xs: Column) -> Column:
        hashes = F.transform(xs, lambda x: F.xxhash64(x["t"]))
        values = F.transform(xs, lambda x: x["v"])
        said = F.transform(xs, lambda x: F.xxhash64(F.when(x["v"] == "", x["t"]).otherwise(x["v"]), F.lit("\x03")))

        def of(z: Column) -> Column:
            n = F.size(z["h"])

            def sized(s: int, exactly: bool) -> Column:
                at = F.when(n >= s, F.sequence(F.lit(1), n - s + 1)).otherwise(F.array().cast("array<int>"))
                hash_at = lambda i: F.xxhash64(F.slice(z["e" if exactly else "h"], i, s))
                if wanted is not None:
                    at = F.filter(at, lambda i: let(hash_at(i), lambda h: may_hold(wanted, h)))
                return F.transform(
                    at,
                    lambda i: F.struct(
                        F.lit(s).alias("size"), i.alias("pos"), n.alias("total"), F.lit(exactly).alias("exact"), hash_at(i).alias("hash"),
                        F.array_join(F.slice(z["v"], i, s), "\x02").alias("values"),
                    ),
                )

            per = [sized(s, e) for s in sizes for e in ((False, True) if exact else (False,))]
            return F.concat(*per) if len(per) > 1 else per[0]

        return let(F.struct(hashes.alias("h"), values.alias("v"), *([said.alias("e")] if exact else [])), of)

    out = df.select(*keep, F.explode(let(typed, cut)).alias("w")).select(*keep, "w.*")
    return out.where(F.col("exact") | _ordinary())


def _ordinary() -> Column:
    """At least half of a window's words are ordinary."""
    all_of_them = F.length(F.col("values")) == F.col("size") - 1
    half = F.size(F.filter(F.split("values", "\x02"), lambda v: v == "")) * 2 >= F.col("size")
    return F.when(all_of_them, F.lit(True)).otherwise(half)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, size, item_pos, n_windows, n_plain, exact, hash, item_values of the benchmark's windows.

    Each window is there once: exact where it is of mostly placeholders. n_plain counts the others.
    """
    words = windows(benchmark, list(range(1, window + 1)), ["item_id"], exact=True).where(~F.col("exact") | ~_ordinary())
    mine = words.where(F.col("size") == F.least(F.lit(window), F.col("total")))
    mine = mine.select("item_id", "size", F.col("pos").alias("item_pos"), "exact", "hash", F.col("values").alias("item_values")).distinct()
    plain = F.when(~F.col("exact"), F.col("item_pos"))
    return mine.join(mine.groupBy("item_id").agg(F.countDistinct("item_pos").alias("n_windows"), F.countDistinct(plain).alias("n_plain")), "item_id")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = 0.5, enough: int = 13) -> DataFrame:
    """doc_id, item_id, n_matched, n_windows of every document that holds ``share`` of an item's windows, or of those that aren't exact, or ``enough`` of them."""
    bench = materialize(benchmark_windows(benchmark.select("item_id", "text"), window).withColumn("block", F.pmod("hash", F.lit(1 << 16))), "bench")
    n, sizes = bench.count(), sorted(r.size for r in bench.select(F.col("size").alias("size")).distinct().collect())  # at most ``window`` sizes
    if not sizes:
        sizes = [window]
    parts = -(-max(n, 1) // BLOCK)
    exact = bool(bench.where("exact").head(1))
    said = windows(docs.select("doc_id", "text"), sizes, ["doc_id"], bitmap(bench.select("hash")), exact)
    hits = reduce(
        DataFrame.unionByName,
        (said.join(F.broadcast(bench.where(F.pmod("block", F.lit(parts)) == p).drop("block")), ["hash", "size", "exact"]) for p in range(parts)),
    )
    hits = hits.select("doc_id", "item_id", "item_pos", "n_windows", "n_plain", "exact", (F.col("pos") - F.col("item_pos")).alias("line"), "values", "item_values")
    hits = materialize(hits, "hits")
    key = ["doc_id", "item_id", "line"]
    pairs = hits.where(~F.col("exact") & (F.length("values") > F.size(F.split("item_values", "\x02")) - 1)).select(
        *key, F.explode(F.arrays_zip(F.split("item_values", "\x02").alias("a"), F.split("values", "\x02").alias("b"))).alias("p")
    )
    clash = pairs.where("p.a <> ''").groupBy(*key, "p.a").agg(F.min("p.b").alias("lo"), F.max("p.b").alias("hi")).where("lo <> hi").select(*key, "a").distinct()
    same = [*(hits[c].eqNullSafe(clash[c]) for c in key), ~hits["exact"], F.array_contains(F.split(hits["item_values"], "\x02"), clash["a"])]
    good = hits.join(clash, same, "left_anti")
    plain = F.countDistinct(F.when(~F.col("exact"), F.col("item_pos")))
    found = good.groupBy("doc_id", "item_id").agg(
        F.countDistinct("item_pos").alias("n_matched"), F.max("n_windows").alias("n_windows"), plain.alias("plain"), F.max("n_plain").alias("n_plain")
    )
    of_plain = (F.col("n_plain") > 0) & (F.col("plain") >= share * F.col("n_plain"))
    return found.where((F.col("n_matched") >= share * F.col("n_windows")) | of_plain | (F.col("n_matched") >= enough)).drop("plain", "n_plain")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated documents."""
    bad = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")

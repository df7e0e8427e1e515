"""Interaction audit of five document filters by Walsh-Hadamard sums.

Each document gets a mask of the filters that it fails. For each part and label, 32 signed sums
are aggregated: sum ``w`` adds +1 for a document whose mask shares an even number of bits with ``w``, and -1 for
an odd one. The transform is its own inverse up to the factor 32, so the sums give back how many
documents have each mask, exactly. From these 32 cells a part, every order of the filters is
evaluated; the Shapley value over all 120 orders has a closed form, as a document that fails k filters
is removed first by each of them in 120 / k orders.

Documents are read once for their masks. The narrow rows (id, hash of the text, part, mask) then meet, on
the id, the labels and the least id of each text, so that a group of copies never has to meet in one task.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

FILTERS = "ABCDE"
_WHITE = "[\\x20\\x09-\\x0D]+"
_CELLS = 1 << len(FILTERS)
_ORDERS = 120


def _parity(bits: Column, other: Column) -> Column:
    """+1 if the two share an even number of bits, else -1."""
    return F.lit(1) - F.lit(2) * (F.bit_count(bits.bitwiseAND(other)) % 2)


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, _WHITE), lambda w: w != "")
    n = F.size(words).cast("long")
    failed = [
        n < 200,
        F.size(F.array_distinct(words)).cast("long") * 100 < n * 50,
        F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.char_length(text).cast("long") * 3,
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(failed)), F.lit(0))


def failure_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, mask, good, toxic`` of every row of ``docs``: bit i of ``mask`` is the i-th of the filters A to E."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("copy"),
        text_mask(text).alias("mask"),
    )
    rows = written(rows, "masks")
    first = rows.where("id is not null").groupBy("copy").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    told = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    told = told.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    joined = rows.join(first, ["id", "copy"], "left").join(told, "id", "left")
    copied = F.col("id").isNotNull() & F.col("first").isNull()
    no = F.lit(False)
    return joined.select("part", (F.col("mask") + F.when(copied, F.lit(1 << 4)).otherwise(F.lit(0))).alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def parity_sums(masks: DataFrame) -> DataFrame:
    """``part, good, toxic, sums``: the 32 signed sums of each part and label."""
    sums = masks.groupBy("part", "good", "toxic").agg(*[F.sum(_parity(F.col("mask"), F.lit(w)).cast("long")).alias(f"s{w}") for w in range(_CELLS)])
    return sums.select("part", "good", "toxic", F.array(*[f"s{w}" for w in range(_CELLS)]).alias("sums"))


def mask_cells(sums: DataFrame) -> DataFrame:
    """``part`` and arrays ``n``, ``n_good``, ``n_toxic`` of the documents with each mask, by the inverse transform."""
    none = F.lit(0).cast("long")
    each = sums.select("part", "good", "toxic", F.posexplode("sums").alias("w", "s")).groupBy("part", "w")
    each = each.agg(F.sum("s").alias("n"), F.sum(F.when(F.col("good"), F.col("s")).otherwise(none)).alias("n_good"), F.sum(F.when(F.col("toxic"), F.col("s")).otherwise(none)).alias("n_toxic"))
    whole = each.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("w", "n", "n_good", "n_toxic"))).alias("signed"))

    def inverse(kind: str) -> Column:
        cell = lambda m: F.aggregate("signed", none, lambda a, s: a + s[kind] * _parity(s["w"], m))
        # the sum is a multiple of 32
        return F.transform(F.sequence(F.lit(0), F.lit(_CELLS - 1)), lambda m: F.shiftright(cell(m), 5))

    return whole.select("part", *[inverse(kind).alias(kind) for kind in ("n", "n_good", "n_toxic")])


def audit_orders(cells: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from the cells of ``mask_cells``."""
    bit = {name: 1 << i for i, name in enumerate(FILTERS)}
    steps = [("".join(order), no, sum(bit[x] for x in order[:no]), bit[order[no]]) for order in permutations(FILTERS) for no in range(len(FILTERS))]
    plan = F.array(*[F.struct(F.lit(order).alias("filter_order"), F.lit(no + 1).alias("step"), F.lit(before).alias("before"), F.lit(own).alias("own")) for order, no, before, own in steps])
    rows = cells.withColumn("s", F.explode(plan)).select("*", "s.*")
    before, own = F.col("before"), F.col("own")

    def total(kind: str, which) -> Column:
        kept = F.transform(F.col(kind), lambda n, m: F.when(which(m), n).otherwise(F.lit(0).cast("long")))
        return F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x)

    shares = lambda m, bits: m.bitwiseAND(bits) != 0
    first = lambda m: shares(m, own) & ~shares(m, before)
    value = F.transform(F.col("n"), lambda n, m: F.when(shares(m, own), n * (F.lit(_ORDERS) / F.bit_count(m)).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: ~shares(m, before.bitwiseOR(own))).alias("kept"),
        total("n", first).alias("removed"),
        total("n", lambda m: shares(m, own) & shares(m, before)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("n_good", first).alias("good_lost"),
        total("n_toxic", first).alias("toxic_lost"),
        F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + x).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The whole audit: ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    Filters: A under 200 words; B under half of the words distinct; C over 3 % of the code points in A-Z; D holds
    one of ``#$%&*|``; E the text of a smaller id, in any part. A null text is empty, a null part is the empty
    string. Repeated rows with the least id of a text are all first; a row with a null id is never a copy and makes
    none. Labels that repeat an id are good (toxic) if one of them is; labels of no document and null ids
    count nowhere. No documents: no rows. Other columns are not read.
    """
    return audit_orders(mask_cells(parity_sums(failure_masks(docs, labels, id_col, text_col, part_col))))

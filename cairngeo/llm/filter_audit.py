"""How filters interact: what each order of them removes at each step, and each filter's share over all orders.

Every document gets a bit mask of the filters it fails; documents are counted per (part, mask), and all else follows from
those counts. The sets of filters that may have been applied are the states of a subset lattice, an edge applies one more
filter. Paths from the empty to the full set are orders. Counting paths forward gives the orders that reach a state,
backward those that leave it; an edge lies on forward * backward orders. The documents an edge removes, weighted so and
added up over a filter's edges, are its removals over all orders (divided by their number: its Shapley value). The steps
of a single order are read off the same edges.

A document is a duplicate when a row of a smaller id has the same text, whatever else happens to either. That is told
from counts per (digest, part, labels) with a partial step before the shuffle, never by comparing rows of one text.

Defined results: null texts are empty texts; a null part is the empty string; rows without an id are no duplicates and
make none; rows that repeat an id are counted each, and of one id and text none is the other's duplicate; a document
is good or toxic if any of its label rows says so; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_FILTERS = 8  # all orders are listed: 8! is 40,320

MIN_WORDS = 100
DISTINCT_PERCENT = 80
CAPITALS_PERCENT = 10
SYMBOLS = "[#$%&*|]"
BLANKS = "[\\x20\\x09-\\x0D]+"


def conditions(text_col: str = "text") -> dict[str, Column]:
    """Failure conditions on the text alone: too short, repetitive, capitals, symbols."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, BLANKS, -1), lambda w: w != "")
    counted = F.element_at(F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"))), 1)
    # A failing mask is made of both bits at once, so that the words are cut out once.
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "AB": F.element_at(
            F.transform(
                F.array(counted),
                lambda c: F.when(c["n"] < MIN_WORDS, 1).otherwise(0) + F.when(100 * c["distinct"] < DISTINCT_PERCENT * c["n"], 2).otherwise(0),
            ),
            1,
        ),
        "C": F.when(100 * capitals > CAPITALS_PERCENT * F.length(text), 1).otherwise(0),
        "D": F.when(text.rlike(SYMBOLS), 1).otherwise(0),
    }


def mask_of(parts: Mapping[str, Column]) -> tuple[str, Column]:
    """(names, mask): filter i of the names has bit i. A condition of several names gives their bits together."""
    names, mask = "", F.lit(0)
    for own, bits in parts.items():
        mask = mask + F.shiftleft(bits, len(names))
        names += own
    return names, mask


def failure_counts(
    docs: DataFrame, labels: DataFrame, mask: Column, duplicate_bit: int, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents fail just these filters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        mask.alias("mask"),
    )
    said = (
        labels.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("of"))
        .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    )
    kind = ["digest", "part", "mask", *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic"))]
    # Rows of one id first, then rows of one text: no key of either step holds the rows of a frequent text.
    per_id = rows.join(said, F.col("id") == F.col("of"), "left").groupBy("id", *kind).agg(F.count("*").alias("n"))
    named = F.when(F.col("id").isNotNull(), F.col("n")).otherwise(0)
    per_text = per_id.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(named).alias("named"),
        F.min("id").alias("first"),
        F.min_by("n", "id").alias("n_first"),
    )
    lowest = per_text.groupBy("digest").agg(F.min("first").alias("lowest"))
    stays = F.when(F.col("first") == F.col("lowest"), F.col("n_first")).otherwise(0)
    again = F.when(F.col("named") > 0, F.col("named") - stays).otherwise(0)
    split = F.inline(
        F.array(
            F.struct(F.col("mask").alias("failed"), (F.col("n") - again).alias("many")),
            F.struct((F.col("mask") + F.lit(1 << duplicate_bit)).alias("failed"), again.alias("many")),
        )
    )
    both = per_text.join(lowest, "digest").select("part", "good", "toxic", split).where("many > 0")
    return both.groupBy("part", F.col("failed").alias("mask"), "good", "toxic").agg(F.sum("many").alias("n"))


def lattice(n: int) -> list[tuple[int, int, int]]:
    """(state, filter's bit, orders through the edge) of the subset lattice of n filters."""
    if n > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters")
    full = (1 << n) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for state in range(full + 1):  # a state has a smaller number than any it leads to
        for f in range(n):
            if not state >> f & 1:
                reach[state | 1 << f] += reach[state]
    for state in range(full, -1, -1):
        leave[state] += sum(leave[state | 1 << f] for f in range(n) if not state >> f & 1)
    return [(s, 1 << f, reach[s] * leave[s | 1 << f]) for s in range(full + 1) for f in range(n) if not s >> f & 1]


def edge_counts(counts: DataFrame, n: int) -> DataFrame:
    """Per (part, state, bit): what the edge keeps, removes, fails again, fails alone, and its orders."""
    steps = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(b).alias("bit"), F.lit(w).cast("long").alias("orders")) for s, b, w in lattice(n)]))
    before = F.col("mask").bitwiseAND(F.col("state"))
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0

    def many(which: Column) -> Column:
        return F.sum(F.when(which, F.col("n")).otherwise(0))

    lost = (before == 0) & fails
    return (
        counts.select("*", steps.alias("edge"))
        .select("*", "edge.*")
        .groupBy("part", "state", "bit", "orders")
        .agg(
            many((before == 0) & ~fails).alias("kept"),
            many(lost).alias("removed"),
            many((before != 0) & fails).alias("redundant"),
            many(F.col("mask") == F.col("bit")).alias("unique_fails"),
            many(lost & F.col("good")).alias("good_lost"),
            many(lost & F.col("toxic")).alias("toxic_lost"),
        )
    )


def every_order(counts: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters and step."""
    edges = edge_counts(counts, len(names))
    shares = edges.groupBy("part", "bit").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    steps = []
    for order in itertools.permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(names[k] for k in order), step, state, 1 << f))
            state |= 1 << f
    # The steps of all orders are at most 8! * 8 small rows, whatever the data.
    table = counts.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, bit int")
    told = edges.join(shares, ["part", "bit"]).join(F.broadcast(table), ["state", "bit"])
    return told.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", duplicates: str = "E") -> DataFrame:
    """The audit of the four text filters A to D and the duplicate filter."""
    names, mask = mask_of(conditions(text_col))
    counts = failure_counts(docs, labels, mask, len(names), id_col, text_col, part_col)
    return every_order(counts, names + duplicates)

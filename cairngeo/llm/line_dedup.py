"""Cross-site boilerplate lines: how many distinct sites a line occurs on decides whether it goes.

Built of DataFrame functions only. A line is hashed (two 64-bit hashes), the hashes are grouped, and a
HyperLogLog sketch of the sites is kept per line hash; sketches merge by aggregation, so neither a frequent
line nor a large site gathers rows in one task. A line whose estimate lies near the threshold gets an exact
distinct count. A line that only one site has, or that occurs less often than the threshold, cannot reach it
and is left out before the sketches are made.

Defined results: null text stays null and has no lines; blank lines are no lines and stay where they are; a
null site is no site; repeated rows are judged alike; rows without an id are judged like any other; an empty
table gives an empty result. Every column of the input besides the text passes through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import fresh, written

MIN_SITES = 10
LOG_K = 12  # 4,096 registers: a standard error of 1.6 %
SIGMAS = 5.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\r\x0b\x0c"

_ROW, _PRINT, _SITE, _HASH, _AT = "row", "print", "site", "hash", "at"


def normalised(line: Column) -> Column:
    """White space off both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(own: Column) -> Column:
    """Two hashes of a normalised line."""
    return F.struct(F.xxhash64(own).alias("a"), F.xxhash64(F.lit("line"), own).alias("b"))


def boilerplate(occurrences: DataFrame, min_sites: int, log_k: int = LOG_K) -> DataFrame:
    """Hashes of the lines that at least ``min_sites`` sites have, from rows (site, hash)."""
    rows = occurrences.where(F.col(_SITE).isNotNull())
    able = written(
        rows.groupBy(_HASH)
        .agg(F.count("*").alias("n"), F.min(_SITE).alias("low"), F.max(_SITE).alias("high"))
        .where((F.col("n") >= min_sites) & ((F.lit(min_sites) <= 1) | (F.col("low") != F.col("high"))))
        .select(_HASH)
    )
    sketched = written(
        rows.join(able, _HASH, "left_semi")
        .groupBy(_HASH)
        .agg(F.hll_sketch_agg(_SITE, log_k).alias("sketch"))
        .select(_HASH, F.hll_sketch_estimate("sketch").alias("sites"))
    )
    margin = max(2.0, SIGMAS * 1.04 / (2 ** (log_k / 2)) * min_sites)
    near = F.abs(F.col("sites") - min_sites) <= margin
    exact = (
        rows.join(sketched.where(near).select(_HASH), _HASH, "left_semi")
        .groupBy(_HASH, _SITE)
        .agg(F.lit(1).alias("one"))
        .groupBy(_HASH)
        .agg(F.count("*").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    return sketched.where(~near & (F.col("sites") >= min_sites)).select(_HASH).unionByName(exact.select(_HASH))


def drop_boilerplate(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """``docs`` with the lines that ``min_sites`` or more distinct sites share taken out of every text.

    ``counts`` names two more columns for the number of lines before and of lines removed.
    """
    docs = docs.drop(*counts or ())  # columns of these names are replaced
    key = [F.col(id_col).alias(_ROW), F.xxhash64(F.col(text_col)).alias(_PRINT)]
    occurrences = written(
        docs.where(F.col(text_col).isNotNull())
        .select(*key, F.col(site_col).cast("string").alias(_SITE), _lines(F.col(text_col)).alias("lines"))
        .select(_ROW, _PRINT, _SITE, F.posexplode("lines").alias(_AT, "line"))  # the print is made before, once a text
        .select(_ROW, _PRINT, _SITE, _AT, normalised(F.col("line")).alias("own"))
        .where("own <> ''")
        .select(_ROW, _PRINT, _SITE, _AT, _hash(F.col("own")).alias(_HASH))
    )
    bad = written(boilerplate(occurrences.select(_SITE, _HASH), min_sites))
    of, by, found, left = fresh(docs, "hit_of", "hit_by", "hit_lines", "hit_left")
    hits = (
        occurrences.join(bad, _HASH, "left_semi")
        .groupBy(F.col(_ROW).alias(of), F.col(_PRINT).alias(by))
        .agg(F.array_sort(F.collect_set(_AT)).alias(found))
    )
    text = F.col(text_col)
    joined = docs.join(hits, (F.xxhash64(text) == F.col(by)) & F.col(id_col).eqNullSafe(F.col(of)), "left")

    def between(lines: Column) -> Column:
        """The lines between the hits, as many stretches as there are hits and one more: linear in the lines."""
        hits = F.col(found)
        ends = F.concat(hits, F.array(F.size(lines)))
        start = lambda k: F.when(k == 0, 0).otherwise(F.get(hits, k - 1) + 1)
        return F.flatten(F.transform(ends, lambda end, k: F.slice(lines, start(k) + 1, end - start(k))))

    # Texts without such a line are passed through as they are.
    kept = F.element_at(F.transform(F.array(_lines(text)), between), 1)
    hit = F.col(found).isNotNull()
    clean = F.when(hit, F.array_join(F.col(left), "\n")).otherwise(text)
    extra = []
    if counts:
        filled = F.size(F.filter(_lines(text), lambda x: F.btrim(x, F.lit(BLANK)) != ""))
        extra = [
            F.coalesce(filled, F.lit(0)).alias(counts[0]),
            F.when(hit, F.size(found)).otherwise(0).alias(counts[1]),
        ]
    marked = joined.withColumn(left, F.when(hit, kept))
    return marked.select(*[clean.alias(c) if c == text_col else F.col(c) for c in docs.columns], *extra)

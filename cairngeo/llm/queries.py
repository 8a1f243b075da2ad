"""The registered query of each corpus operator, and its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import (
    decontamination,
    filter_audit,
    language,
    licences,
    line_dedup,
    near_dedup,
    neighbours,
    packing,
    passage_dedup,
    periodic,
    quality,
    secrets,
    toxicity,
)
from .tables import held_out

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir.rstrip("/"))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINES_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
parts AS (
  SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs
), units AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS unit FROM parts
), bad AS (SELECT unit FROM units WHERE unit <> '' GROUP BY unit HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}),
marked AS (SELECT u.*, u.unit <> '' AND b.unit IS NOT NULL AS gone FROM units u LEFT JOIN bad b ON u.unit = b.unit),
merged AS (
  SELECT r, count(*) FILTER (WHERE unit <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
    string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM marked GROUP BY r)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text
FROM docs d LEFT JOIN merged m ON d.r = m.r"""


@query("op6_line_dedup", LINES_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten or more sources share."""
    docs = table(spark, sf_dir, "documents")
    return line_dedup.drop_boilerplate(docs, counts=("n_lines", "n_removed")).select("doc_id", "n_lines", "n_removed", "text")


WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LEAKS_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({WORDS_SQL}, []) AS w FROM documents),
items AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size,
    list_slice(w, i, i + least(len(w), 10) - 1) AS win
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0) x
), sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT r, size, i, list_slice(w, i, i + size - 1) AS win
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size) x
), found AS (SELECT p.r, p.i, p.size, x.item_id FROM places p JOIN windows x ON p.size = x.size AND p.win = x.win),
hits AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS k FROM found) y GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found) z GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)"""


@query("op5_benchmark_decontamination", LEAKS_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of its words that lie in a window of a benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("leaks.hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"] + 1)
    return found.select(
        "doc_id",
        "leaks.n_words",
        n_hit.alias("n_hit"),
        F.size("leaks.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leaks.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in pieces of at most 2,048 tokens, packed into few sequences of that size."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op1_minhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component of near-duplicates it belongs to."""
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op3_pu_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.with_quality(docs, table(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


@query("op4_ordinal_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its expected severity grade."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.with_severity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "severity", "p_toxic", "toxic")


@query("op9_compression_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its language by compression."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.with_language(docs)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


_STOPS, _UNSPACED = passage_dedup.STOPS, passage_dedup.UNSPACED
PASSAGES_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(text, '[^{_STOPS}\\n]+[{_STOPS}]*|[{_STOPS}\\n]+') AS tokens FROM documents),
parts AS (SELECT r, doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM docs),
placed AS (
  SELECT *, CAST(sum(len(token)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS stop,
    CASE WHEN regexp_full_match(token, '[{_STOPS}\\n]+') THEN '' ELSE translate(trim(regexp_replace(token, '[ \\t\\r\\x0B\\x0C]+', ' ', 'g')),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS unit
  FROM parts
), units AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY i) AS number, greatest(len(string_split(unit, ' ')), len(regexp_extract_all(unit, '[{_UNSPACED}]'))) AS words,
    row_number() OVER (PARTITION BY unit ORDER BY doc_id, i) > 1 AS again FROM placed WHERE unit <> ''
), runs AS (
  SELECT r, min(stop - len(token)) AS a, max(stop) AS b
  FROM (SELECT *, number - row_number() OVER (PARTITION BY r ORDER BY number) AS run FROM units WHERE again) x
  GROUP BY r, run HAVING sum(words) >= {passage_dedup.MIN_WORDS}
), spans AS (SELECT r, count(*) AS n, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM runs GROUP BY r),
rest AS (
  SELECT p.r, string_agg(p.token, '' ORDER BY p.i) AS kept
  FROM placed p LEFT JOIN runs s ON s.r = p.r AND p.stop > s.a AND p.stop <= s.b WHERE s.r IS NULL GROUP BY p.r)
SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_removed, coalesce(spans, '') AS spans,
  CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text
FROM docs LEFT JOIN spans USING (r) LEFT JOIN rest USING (r)"""


@query("op7_passage_dedup", PASSAGES_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier document has, and where they were."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = passage_dedup.drop_repeats(docs)
    spans = F.transform("removed", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", F.size("removed").alias("n_removed"), F.array_join(spans, ",").alias("spans"), "text")


@query("op8_licence_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, as a file below the folder of its source, with its own or inherited licence."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.concat(F.lit("part"), F.floor(F.col("doc_id") / 1000)), F.concat(F.col("doc_id"), F.lit(".txt")))
    found = licences.licences(docs.select("doc_id", path.alias("path"), "text"), keep=("doc_id",))
    return found.select("doc_id", "path", "licence", "cosine", "start", "end", "licence_file", "licence_source", "from_path", "spans")


@query("op10_nearest_neighbours")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches_sql(rank: int, kind: str, regex: str, group: int) -> str:
    p = _quoted(regex)
    return f"""
  SELECT r, {rank} AS rank, '{kind}' AS kind, generate_subscripts(string_split_regex(text, {p}), 1) AS i,
    unnest(string_split_regex(text, {p})) AS gap, unnest(regexp_extract_all(text, {p}, 0)) AS m, unnest(regexp_extract_all(text, {p}, {group})) AS part
  FROM docs"""


def _class_sql(rank: int, of: secrets.CharacterClass) -> str:
    allowed = " OR ".join(f"regexp_matches(m, {_quoted(a)})" for a in of.allowed)
    return f"""
  SELECT r, rank, kind, start + min(o) AS start, start + max(o) + {of.window} AS stop
  FROM (SELECT *, unnest(range(0, len(m) - {of.window} + 1)) AS o FROM placed WHERE rank = {rank} AND NOT ({allowed})) x
  WHERE list_aggregate(string_split(substr(m, CAST(o + 1 AS BIGINT), {of.window}), ''), 'entropy') >= {of.bits}
  GROUP BY r, rank, kind, start"""


_BASE = len(secrets.PATTERNS)
SECRETS_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join([
    *[_matches_sql(i, p.kind, p.regex, p.group) for i, p in enumerate(secrets.PATTERNS)],
    *[_matches_sql(_BASE + i, c.kind, c.regex, 0) for i, c in enumerate(secrets.CLASSES)],
])}
), placed AS (
  SELECT *, CAST(sum(len(gap) + coalesce(len(m), 0)) OVER (PARTITION BY r, rank ORDER BY i) - len(m) AS BIGINT) AS start FROM found QUALIFY m IS NOT NULL
), spans AS (
  SELECT r, rank, kind, start, start + len(m) AS stop FROM placed
  WHERE {" OR ".join(f"(rank = {i} AND len(part) >= {p.least})" for i, p in enumerate(secrets.PATTERNS))}
  UNION ALL {" UNION ALL ".join(_class_sql(_BASE + i, c) for i, c in enumerate(secrets.CLASSES))}
), merged AS (
  SELECT r, {", ".join(f"count(*) FILTER (WHERE rank = {i}) AS n_{p.kind}" for i, p in enumerate(secrets.PATTERNS))},
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < {_BASE}) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{p.kind}, 0) AS n_{p.kind}" for p in secrets.PATTERNS)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN merged USING (r)"""


@query("op11_entropy_secrets", SECRETS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its secrets: those of the named patterns, and all spans with those of high entropy."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [p.kind for p in secrets.PATTERNS]

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    named = secrets.span_text(F.filter("secrets", lambda s: s["kind"].isin(base)))
    return found.select("doc_id", *map(count, base), F.sha2(named, 256).alias("base_sha256"), secrets.span_text(F.col("secrets")).alias("spans"))


AUDIT_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
said AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * len(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM docs LEFT JOIN said USING (doc_id)),
counted AS (SELECT part, good, toxic, fails, count(*) AS n FROM judged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
numbered AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, ascii(substr(filter_order, step, 1)) - 64 AS f,
    [ascii(x) - 64 FOR x IN string_split(substr(filter_order, 1, step - 1), '') IF x <> ''] AS before
  FROM steps),
parted AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS here, len([x FOR x IN before IF fails[x]]) > 0 AS gone,
    len([x FOR x IN fails IF x]) = 1 AS once
  FROM numbered, counted),
rows_ AS (
  SELECT part, filter_order, step, f,
    CAST(coalesce(sum(n) FILTER (WHERE NOT here AND NOT gone), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (WHERE here AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE here AND gone), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (WHERE here AND once), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (WHERE here AND NOT gone AND good), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n) FILTER (WHERE here AND NOT gone AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM parted GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM rows_"""


@query("op12_filter_audit", AUDIT_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language, order of five filters and step: what the filter removes there, and its share over all orders."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


RUNS_SQL = r"""
WITH raw AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
    xor(4294967295, list_reduce(list_concat([4294967295], [ascii(x) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, d:
      list_reduce(list_concat([xor(c, CAST(d AS BIGINT))], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) AS h
  FROM documents),
drawn AS (SELECT *, len(w) AS n, h // 10 AS g FROM raw),
placed AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM drawn),
docs AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE
    [w[1 + (CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END)] FOR i IN range(n)] END AS w
  FROM placed),
words AS (SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM docs),
pairs AS (SELECT a.r, a.i, b.i - a.i AS q FROM words a JOIN words b ON a.r = b.r AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
stretches AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) x GROUP BY r, q, island
  HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length),
told AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    first(struct_pack(start := start, length := length, period := period) ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS best
  FROM runs GROUP BY r),
dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT w.r, string_agg(w.word, ' ' ORDER BY w.i) AS rest
  FROM words w LEFT JOIN dropped d ON w.r = d.r AND w.i = d.i WHERE d.r IS NULL GROUP BY w.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
  CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM docs LEFT JOIN told USING (r) LEFT JOIN kept USING (r)"""


def with_repeats(docs: DataFrame) -> DataFrame:
    """The texts that op13 searches: in a tenth of the documents the words from a place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", filter_audit.BLANKS, -1), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10).cast("long")
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        at = F.sequence(F.lit(0), n - 1)
        return F.array_join(F.transform(at, lambda i: F.get(w, F.when(i >= a, a + F.pmod(i - a, p)).otherwise(i))), " ")

    changed = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w))), 1)
    drawn = (h % 10 == 0) & F.col("text").isNotNull()
    return docs.withColumn("text", F.when(drawn, F.coalesce(changed, F.col("text"))).otherwise(F.col("text")))


@query("op13_periodic_runs", RUNS_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its periodic runs of words, the strongest of them, and the text without their repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.collapse_runs(with_repeats(docs))

    def stronger(a: Column, b: Column) -> Column:
        # runs come by start and then period, so an equal one that comes later is no better
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)

    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    lines = F.transform("runs", lambda x: F.concat(x["start"], F.lit(","), x["length"], F.lit(","), x["period"], F.lit("\n")))
    best = found.withColumn("best", F.aggregate("runs", none, stronger))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

"""Secret scans, the filter audit and periodic runs against brute force, on odd rows and on empty tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cairngeo.llm import filter_audit, language, licences, line_dedup, near_dedup, passage_dedup, periodic, queries, secrets
from cairngeo.sources import files
from scripts.check import rows_of

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


# --- secrets ---------------------------------------------------------------------------


def entropy(text):
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def brute_spans(text):
    """Every window of every candidate has its entropy worked out anew."""
    text, out = text or "", []
    for rank, (kind, pattern, group, least) in enumerate(
        [
            ("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
            ("access", "AKIA[A-Z0-9]+", 0, 20),
            ("hex", "[0-9a-f]+", 0, 24),
        ]
    ):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    for rank, of in enumerate(secrets.CLASSES, 3):
        for m in re.finditer("[" + re.escape(of.alphabet) + "]+", text):
            if len(m.group()) < of.window or any(re.search(a, m.group()) for a in of.allowed):
                continue
            high = [o for o in range(len(m.group()) - of.window + 1) if entropy(m.group()[o : o + of.window]) >= of.bits]
            if high:
                out.append((m.start() + high[0], rank, m.start() + high[-1] + of.window, of.kind))
    return [(kind, start, end) for start, _, end, kind in sorted(out)]


def odd_secrets(seed):
    rng = random.Random(seed)
    pieces = [
        "token", "secret=token: \"abcdefgh\"", "password = 'hunter22'", "API_KEY:abc", "apikey=abcdef", "AKIA" + "Z9" * 9, "AKIAAKIA", "AKIA" + "Q" * 15, "AKIA" + "Q" * 16,
        "0" * 24, "a" * 23, "ſecret=abcdefgh", "toKen==" + "x" * 9, "é😀日本", "\n", " ", ":", "=", "_", "00000000-0000-0000-0000-000000000000",
        "thequickbrownfoxjumpsoverthelazydog", "1234567890" * 4, "your_key_9dk3Kd82jKwla0qPz71b",
    ]
    texts = []
    for _ in range(120):
        words = []
        for _ in range(rng.randint(0, 14)):
            kind = rng.random()
            if kind < 0.5:
                words.append(rng.choice(pieces))
            elif kind < 0.8:
                alphabet = rng.choice(["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHabcdefgh0123456789+/_-xyzXYZ", "ab", "0123456789"])
                words.append("".join(rng.choice(alphabet) for _ in range(rng.choice([5, 19, 20, 23, 24, 40, 90]))))
            else:
                words.append("".join(rng.choice("abc ñ日😀=:'\"-_.A9") for _ in range(rng.randint(1, 30))))
        texts.append(rng.choice(["", " ", "\n"]).join(words))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_secrets_equal_every_window(make, seed):
    texts = odd_secrets(seed)
    found = {r["doc_id"]: [tuple(s) for s in r["secrets"]] for r in secrets.scan(make([(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    want = {i: brute_spans(t) for i, t in enumerate(texts)}
    assert found == want
    assert {k for spans in want.values() for k, _, _ in spans} == {"assign", "access", "hex", "entropy_hex", "entropy_base64"}


def test_a_text_of_very_many_secrets_and_a_long_candidate(make):
    many = "😀 " + " ".join(f"token=abcdef{i}" for i in range(30_000))
    rng = random.Random(5)
    long_ = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(30_000))
    low = "xy1" * 2000 + long_[:200] + "yx2" * 2000
    rows = {r["doc_id"]: [tuple(s) for s in r["secrets"]] for r in secrets.scan(make([(1, many, "en", "s"), (2, long_, "en", "s"), (3, low, "en", "s")])).collect()}
    assert len(rows[1]) == 30_000 and rows[1] == brute_spans(many)
    assert rows[2] == [("entropy_base64", 0, 30_000)]
    assert rows[3] == brute_spans(low) and 5980 < rows[3][0][1] < 6005 and 6195 < rows[3][0][2] < 6220, rows[3]


def test_scan_plans_no_python_and_no_shuffle(make):
    plan = secrets.scan(make([(1, "a", "en", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Window", plan)


# --- filter audit ----------------------------------------------------------------------


def brute_audit(docs, labels):
    """Every order is applied filter by filter."""
    quality, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}

    def fails(doc):
        text = doc["text"] or ""
        words = SPACE.findall(text)
        same = [e["doc_id"] for e in docs if (e["text"] or "") == text and e["doc_id"] is not None]
        found = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc["doc_id"] is not None and any(i < doc["doc_id"] for i in same),
        }
        return {k for k, v in found.items() if v}

    failed = [fails(d) for d in docs]
    rows, shapley = [], Counter()
    for part in {d["lang"] or "" for d in docs}:
        own = [(d, f) for d, f in zip(docs, failed, strict=True) if (d["lang"] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left, gone = own, []
            for step, f in enumerate(order, 1):
                lost = [x for x in left if f in x[1]]
                again = sum(f in x[1] for x in gone)
                left, gone = [x for x in left if f not in x[1]], gone + lost
                ids = [x[0]["doc_id"] for x in lost]
                rows.append((part, "".join(order), step, len(left), len(lost), again, sum(x[1] == {f} for x in own), sum(i in quality for i in ids), sum(i in toxic for i in ids)))
                shapley[part, f] += len(lost)
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in rows)


def audit_texts(seed, odd_rows):
    rng = random.Random(seed)
    texts = ["", None, "short", "SHORT TEXT", "a # b"]
    for _ in range(12):
        words = [f"w{rng.randrange(rng.choice([40, 4000]))}" for _ in range(rng.choice([99, 100, 140]))]
        if rng.random() < 0.4:
            words = [w.upper() for w in words]
        if rng.random() < 0.4:
            words[3] += rng.choice("#$%&*|")
        texts.append(" ".join(words))
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["en", "de", None, ""]), "s") for _ in range(90)]
    return rows + odd_rows


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_every_order_applied(spark, make, odd_rows, seed):
    rows = audit_texts(seed, odd_rows)
    labels = [(4, 1, 0), (5, 1, 1), (6, 0, 0), (6, 1, 1), (None, 1, 1), (7, None, None), (99, 1, 0), (12, 1, 1), (20, 0, 1)]
    found = filter_audit.audit(make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    docs = [{"doc_id": i, "text": t, "lang": lang} for i, t, lang, _ in rows]
    assert sorted(tuple(r) for r in found.collect()) == brute_audit(docs, [x for x in labels if x[0] is not None])


def test_lattice_counts_every_order_once():
    for n in (1, 2, 5):
        edges = filter_audit.lattice(n)
        assert len(edges) == n * 2 ** (n - 1)
        for bit in range(n):
            assert sum(w for _, b, w in edges if b == 1 << bit) == math.factorial(n)
    with pytest.raises(ValueError):
        filter_audit.lattice(9)


# --- periodic runs ---------------------------------------------------------------------


def brute_runs(words, least=6, repeats=4):
    """Every period and every stretch that keeps it."""
    found = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, repeats * q):
                found.setdefault((i, length), q)  # periods come from the smallest
            i = j + 1
    return sorted((start, length, q) for (start, length), q in found.items())


def brute_collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(150):
        words = []
        for _ in range(rng.randint(0, 6)):
            unit = [rng.choice("abc") for _ in range(rng.choice([1, 1, 2, 3, 5, 9]))]
            part = unit * rng.choice([1, 2, 3, 4, 5, 11])
            words += part[: len(part) - rng.randrange(len(unit))]
            words += [rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 4]))]
        texts.append(rng.choice([" ", "\n", " \t "]).join(words))
    a, b = "a", "b"
    for _ in range(12):  # a Fibonacci word, rich in runs
        a, b = a + b, a
    return [*texts, " ".join(a), " ".join("ab" * 300), "x " * 700, " ".join(rng.choice("ab") for _ in range(900)), "", " \n ", None, "é\x00 é\x00 é\x00 é\x00 é\x00 é\x00"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_equal_every_period_tried(make, seed):
    texts = repetitive(seed)
    docs = make([(i, t, "en", "s") for i, t in enumerate(texts)])
    found = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.collapse_runs(docs).collect()}
    for i, text in enumerate(texts):
        words = SPACE.findall(text or "")
        want = brute_runs(words)
        assert found[i] == (want, brute_collapsed(words, want)), text


def test_suffix_array_is_sorted_within_texts():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 3, n) for n in (0, 1, 50, 0, 300)]
    bounds = np.cumsum([0, *map(len, texts)])
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    symbol = np.concatenate(texts)
    suffixes, inverse, ranks = periodic.suffix_array(text * 3 + symbol, bounds[1:][text])
    keyed = [(int(text[i]), symbol[i : bounds[text[i] + 1]].tolist()) for i in suffixes]
    assert keyed == sorted(keyed) and (inverse[suffixes] == np.arange(len(symbol))).all()
    a, b = rng.integers(0, 351, 500), rng.integers(0, 351, 500)
    a, b = a[a != b], b[a != b]
    for x, y, got in zip(a, b, periodic.common_prefix(ranks, bounds[1:][text], a, b), strict=True):
        same = 0
        while x + same < bounds[text[x] + 1] and y + same < bounds[text[y] + 1] and text[x] == text[y] and symbol[x + same] == symbol[y + same]:
            same += 1
        assert got == same


def test_query_rows_of_runs(spark, make, tmp_path):
    texts = repetitive(7)
    rows = [(i * 7, t, "en", "s") for i, t in enumerate(texts)] + [(None, "a a a a a a a", "en", "s")]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    for doc_id, text, *_ in rows:
        words = SPACE.findall(text or "")
        n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        want = {
            "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": 1000 * best[1] // best[2] if runs else None,
            "runs_sha256": hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(brute_collapsed(words, runs).encode()).hexdigest(),
        }
        assert {k: found[doc_id][k] for k in want} == want, text


# --- odd rows, empty tables, SQL --------------------------------------------------------


def test_odd_rows_and_clashing_columns(spark, make, odd_rows):
    docs = make(odd_rows)
    scanned = secrets.scan(docs.withColumn("spans_of_kind_0", F.lit(1)).withColumn("secrets", F.lit("old")))
    assert scanned.columns == [*docs.columns, "spans_of_kind_0", "secrets"] and scanned.count() == len(odd_rows)
    ran = periodic.collapse_runs(docs.withColumn("runs", F.lit("old")))
    assert ran.columns == [*docs.columns, "runs", "collapsed"] and ran.count() == len(odd_rows)
    assert {r["collapsed"] for r in ran.where("text IS NULL").collect()} == {""}


def test_empty_tables(spark, make):
    docs, labels = make([]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert secrets.scan(docs).count() == periodic.collapse_runs(docs).count() == filter_audit.audit(docs, labels).count() == 0
    some = filter_audit.audit(make([(1, "a", "en", "s")]), labels).collect()
    assert len(some) == 600 and {r["shapley"] for r in some} == {0, 120}


@pytest.mark.parametrize("name", ["op11_entropy_secrets", "op12_filter_audit", "op13_periodic_runs"])
def test_equals_its_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    df = queries.QUERIES[name](spark, folder)
    columns, rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    db = duckdb.connect()
    for table in ("documents", "labels"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    result = db.execute(queries.ORACLES[name])
    assert (columns, rows) == rows_of([c[0] for c in result.description], result.fetchall())


# --- passages in other scripts, and a frequent unit ---------------------------------------


def test_passages_of_scripts_without_spaces_and_with_other_stops(make):
    chinese = "".join(chr(0x4E00 + i * 7 % 5000) for i in range(120))
    hindi = " ".join(f"शब्द{i}" for i in range(14)) + "। " + " ".join(f"वाक्य{i}" for i in range(14)) + "।"
    rows = [(i, f"own{i} line\n{chinese}\nmore{i} words. {hindi} end{i}", "zh", "s") for i in range(3)]
    found = {r["doc_id"]: r for r in passage_dedup.drop_repeats(make(rows)).collect()}
    assert found[0]["removed"] == []
    for i in (1, 2):
        assert chinese not in found[i]["text"] and "शब्द3" not in found[i]["text"]
        assert f"own{i} line" in found[i]["text"] and f"end{i}" in found[i]["text"]
    short = [(i, f"own{i}\n{chinese[:20]}\nmore{i}", "zh", "s") for i in range(3)]
    assert all(r["removed"] == [] for r in passage_dedup.drop_repeats(make(short)).collect())


def test_a_frequent_unit_and_rare_ones_lose_their_later_occurrences(spark, make, monkeypatch):
    sentence = " ".join(f"often{i}" for i in range(30)) + "."
    twice = " ".join(f"twice{i}" for i in range(30)) + "."
    rows = [(i, f"own{i} {i}. {sentence}" + (f" {twice}" if i in (50, 90) else ""), "en", "s") for i in range(120)]
    monkeypatch.setattr(passage_dedup, "HEAVY", 4)
    docs = make([*rows, (None, f"{sentence}", "en", "s")])
    found = passage_dedup.drop_repeats(docs).collect()
    assert sum("often3" in r["text"] for r in found) == 1 and "often3" in next(r["text"] for r in found if r["doc_id"] == 0)
    assert [r["doc_id"] for r in found if "twice3" in r["text"]] == [50]


def test_passing_tables_are_deleted_and_lasting_ones_stay(spark):
    from cairngeo.llm.tables import passing_tables, written

    def folder(df):
        return df.inputFiles()[0].rsplit("/", 1)[0]

    with passing_tables(spark) as folders:
        passing = folder(written(spark.range(3)))
        lasting = written(spark.range(5))
        folders.pop()
    assert lasting.count() == 5 and not files.exists(spark, passing)
    with pytest.raises(RuntimeError), passing_tables(spark):
        lost = folder(written(spark.range(3)))
        raise RuntimeError
    assert not files.exists(spark, lost)
    assert files.exists(spark, folder(written(spark.range(2))))


# --- earlier operators on cases that had no test ---------------------------------------------


def test_licences_with_clashing_columns(spark):
    rows = [("a/LICENSE", "Released under the MIT License.", "n", "f", "old", 1.0, 3), ("a/b/x.txt", "nothing to see", "n2", "f2", "old", 2.0, 4)]
    files_ = spark.createDataFrame(rows, "path string, text string, near string, folder string, licence string, cosine double, above int")
    found = {r["path"]: r for r in licences.licences(files_, keep=("near", "folder", "licence", "cosine", "above")).collect()}
    assert (found["a/b/x.txt"]["licence"], found["a/b/x.txt"]["from_path"]) == ("MIT", "a/LICENSE")
    assert [(found[p]["near"], found[p]["folder"], found[p]["above"]) for p in ("a/LICENSE", "a/b/x.txt")] == [("n", "f", 3), ("n2", "f2", 4)]


def test_equal_licences_in_one_folder_and_equal_languages(spark, make):
    mit = "Released under the MIT License."
    rows = [("a/COPYING", mit), ("a/LICENSE", mit), ("a/x.txt", "nothing to see"), ("a/x.txt", "nothing to see")]
    found = [r for r in licences.licences(spark.createDataFrame(rows, "path string, text string")).collect() if r["path"] == "a/x.txt"]
    assert [(r["licence"], r["from_path"]) for r in found] == [("MIT", "a/COPYING")] * 2
    same = [(1, "uno dos tres", "es", "s"), (2, "uno dos tres", "pt", "s"), (3, "uno dos tres", "es", "s"), (4, "uno dos tres", "pt", "s")]
    assert {r["lang_pred"] for r in language.with_language(make(same)).collect()} == {"es"}  # ties go to what sorts first


def test_texts_of_very_many_lines(make):
    shared = "\n".join(f"shared line number {i} of many" for i in range(3000))
    rows = [(i, f"own {i}\n{shared}\nend {i}", "en", f"s{i}") for i in range(4)]
    lines = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(make(rows), min_sites=3).collect()}
    assert lines == {i: f"own {i}\nend {i}" for i in range(4)}
    kept = {r["doc_id"]: r for r in passage_dedup.drop_repeats(make(rows), kind="line").collect()}
    assert kept[0]["text"] == rows[0][1] and all("shared line" not in kept[i]["text"] for i in (1, 2, 3))


def test_a_large_bucket_of_copies_below_the_bar(make):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(150):  # every pair shares a lot, hardly any 85 %
        words = list(base)
        for k in rng.sample(range(120), 3):
            words[k] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    found = near_dedup.near_duplicates(make([(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: top(i) for i in range(len(texts))}

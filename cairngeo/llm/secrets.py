"""Secrets in texts: named patterns, and stretches of high entropy, by DataFrame functions only.

Three patterns name a secret by its form: an assignment to a telling name, an access key, a long hexadecimal number.
Beside them every character class has its candidate strings, runs of its characters. A window slides over a candidate;
the counts of its characters are carried from place to place, one character leaves and one enters, and with them the sum
of c * log2(c) that gives the window's Shannon entropy. The part of a candidate from its first to its last window
at or above the class's bits is a span, unless the whole candidate is on the class's allow-list (numbers, words,
alphabets, placeholders, UUIDs).

A text is worked on in its own row: no shuffle, no window function, no list of more than one text.
Places of matches are running sums over the lengths of matches and of what lies between them, taken in blocks, so their work
grows with the matches to the power of 1.5, not with their square.

Defined results: null and empty texts have no spans; rows without an id and repeated rows are searched like any other;
spans that begin at one place come in the order of their kinds; an empty table gives an empty result. Other columns pass
through, columns of the names asked for are replaced. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import fresh

DIGITS, SMALL, LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SCALE = 1 << 20  # sums of logarithms are whole numbers, so they come out alike in any order
BLOCK = 256


def either_case(word: str) -> str:
    """A pattern for a word in ASCII letters of either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Pattern:
    """A secret known by its form; ``group`` must have ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


@dataclass(frozen=True)
class CharacterClass:
    """Candidate strings of a class, at least ``window`` long, and the entropy from which a window is suspect."""

    kind: str
    alphabet: str
    window: int
    bits: float
    allowed: tuple[str, ...] = ()

    @property
    def regex(self) -> str:
        return f"[{''.join(chr(92) + c if c in '-]^' else c for c in self.alphabet)}]{{{self.window},}}"


_NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
PATTERNS = (
    Pattern("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", group=2, least=6),
    # Runs are maximal, so asking for the length in the pattern gives the matches of "+" that are long enough.
    Pattern("access", "AKIA[A-Z0-9]{16,}"),
    Pattern("hex", "[0-9a-f]{24,}"),
)

# What looks random and is none.
PLACEHOLDERS = "|".join(map(either_case, ("example", "placeholder", "changeme", "your_", "dummy", "sample", "xxxx")))
COMMON = ("0123456789|abcdefghij|ABCDEFGHIJ|qwertyuiop", PLACEHOLDERS)
UUID = "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
CLASSES = (
    CharacterClass("entropy_hex", DIGITS + SMALL[:6] + LARGE[:6], 24, 3.01, (*COMMON, "^[0-9]+$")),
    CharacterClass("entropy_base64", LARGE + SMALL + DIGITS + "+/_-", 20, 3.61, (*COMMON, UUID, "^[^0-9]+$", "^[0-9A-Fa-f]+$", "^[0-9+/_-]+$")),
)

SPAN = "array<struct<start:int,rank:int,end:int>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often and in whatever lambda it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def running_sums(lengths: Column) -> Column:
    """The sums of the first 1, 2, ... numbers of an array."""

    def summed(numbers: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK).cast("int")), lambda b: _total(F.slice(numbers, b * BLOCK + 1, BLOCK)))
        before = _let(blocks, lambda sums: F.transform(sums, lambda _, b: _total(F.slice(sums, F.lit(1), b))))

        def upto(offsets: Column) -> Column:
            def one(_: Column, k: Column) -> Column:
                block = F.floor(k / BLOCK).cast("int")
                return F.get(offsets, block) + _total(F.slice(numbers, block * BLOCK + 1, k - block * BLOCK + 1))

            return F.transform(numbers, one)

        return F.when(F.size(numbers) > 0, _let(before, upto)).otherwise(F.array().cast("array<int>"))

    return _let(lengths, summed)


def matches(text: Column, regex: str, group: int = 0) -> Column:
    """(start, end, found, part) of the leftmost non-overlapping matches, in order; ``part`` is the group's text."""
    shape = "array<struct<start:int,end:int,found:string,part:string>>"
    gaps, found = F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    parts = found if group == 0 else F.regexp_extract_all(text, F.lit(regex), F.lit(group))

    def placed(all_: Column) -> Column:
        lengths = F.transform(all_["found"], lambda m, k: F.length(F.get(all_["gaps"], k)) + F.length(m))
        return _let(
            running_sums(lengths),
            lambda ends: F.transform(
                all_["found"],
                lambda m, k: F.struct(
                    (F.get(ends, k) - F.length(m)).alias("start"), F.get(ends, k).alias("end"), m.alias("found"), F.get(all_["parts"], k).alias("part")
                ),
            ),
        )

    whole = F.struct(gaps.alias("gaps"), found.alias("found"), parts.alias("parts"))
    return F.when(text.rlike(regex), _let(whole, placed)).otherwise(F.array()).cast(shape)


def suspect_part(candidate: Column, of: CharacterClass) -> Column:
    """(first, last) of a candidate: from its first to behind its last window of high entropy; first is -1 without one.

    The state carries a count per character and the window's scaled sum of c * log2(c); the character that leaves and the
    one that enters change one count and one term each.
    """
    width = of.window
    weigh = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    change = F.array(*[F.lit(round((weigh[c] - weigh[max(c - 1, 0)]) * SCALE)).cast("long") for c in range(width + 1)])
    limit = round((math.log2(width) - of.bits) * width * SCALE)
    symbols = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(of.alphabet), c) - 1)

    def searched(symbol: Column) -> Column:
        start = F.struct(
            F.array_repeat(F.lit(0), len(of.alphabet)).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last")
        )

        def step(state: Column, i: Column) -> Column:
            enters, leaves = F.get(symbol, i), F.coalesce(F.get(symbol, i - width), F.lit(-1))  # none leaves the first window
            counts = state["counts"]
            held = F.get(counts, enters) - (enters == leaves).cast("int") + 1
            total = state["sum"] - F.coalesce(F.get(change, F.get(counts, leaves)), F.lit(0).cast("long")) + F.get(change, held)
            moved = F.transform(counts, lambda n, s: n + (s == enters).cast("int") - (s == leaves).cast("int"))
            high = (i >= width - 1) & (total <= limit)
            return F.struct(
                moved.alias("counts"),
                total.alias("sum"),
                F.when(high & (state["first"] < 0), i - width + 1).otherwise(state["first"]).alias("first"),
                F.when(high, i + 1).otherwise(state["last"]).alias("last"),
            )

        end = F.aggregate(F.sequence(F.lit(0), F.length(candidate) - 1), start, step)
        return _let(end, lambda state: F.struct(state["first"].alias("first"), state["last"].alias("last")))

    return _let(symbols, searched)


def pattern_spans(text: Column, pattern: Pattern, rank: int) -> Column:
    kept = F.filter(matches(text, pattern.regex, pattern.group), lambda m: F.length(m["part"]) >= pattern.least)
    return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"))).cast(SPAN)


def entropy_spans(text: Column, of: CharacterClass, rank: int) -> Column:
    def unknown(m: Column) -> Column:
        fine = F.lit(False)
        for allowed in of.allowed:
            fine = fine | m["found"].rlike(allowed)
        return ~fine

    def part(m: Column) -> Column:
        return _let(
            suspect_part(m["found"], of),
            lambda p: F.struct((m["start"] + p["first"]).alias("start"), F.lit(rank).alias("rank"), (m["start"] + p["last"]).alias("end")),
        )

    parts = F.transform(F.filter(matches(text, of.regex), unknown), part)
    return F.filter(parts, lambda p: p["end"] > p["start"]).cast(SPAN)  # without a window: first = last = -1


def scan(
    docs: DataFrame,
    text_col: str = "text",
    patterns: tuple[Pattern, ...] = PATTERNS,
    classes: tuple[CharacterClass, ...] = CLASSES,
    out: str = "secrets",
) -> DataFrame:
    """``docs`` with a column ``out``: the spans (kind, start, end) of all secrets, by start and then by kind."""
    docs = docs.drop(out)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = F.array(*[F.lit(k.kind) for k in (*patterns, *classes)])
    # Each kind is a column of its own, so that a text is searched for it once.
    (prefix,) = fresh(docs, "spans_of_kind")
    names = fresh(docs, *[f"{prefix}_{i}" for i in range(len(patterns) + len(classes))])
    found = [pattern_spans(text, p, i) for i, p in enumerate(patterns)]
    found += [entropy_spans(text, c, len(patterns) + i) for i, c in enumerate(classes)]
    marked = docs.withColumns(dict(zip(names, found, strict=True)))
    spans = F.transform(
        F.array_sort(F.concat(*names)),
        lambda s: F.struct(F.get(kinds, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return marked.select(*[F.col(f"`{c}`") for c in docs.columns], spans.alias(out))


def span_text(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")

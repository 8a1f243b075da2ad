"""Best-fit packing of token sequences by linear grouping.

Texts are cut into pieces of at most ``capacity`` tokens and only the number of pieces per length (at most
``capacity`` numbers, whatever the corpus) reaches the driver. There the large lengths are dealt, longest first,
into groups of equal cardinality and rounded up to the longest of their group; configurations of the few rounded
sizes are chosen that fill a sequence, each used as often as its sizes last; the actual lengths are put in the
place of the rounded ones; small lengths then go by best fit into what is left. The plan is a list of runs: so
many sequences of these lengths. Pieces of one length are interchangeable, so a piece finds its place by its
rank among its length, which is a count per task and length plus the piece's number in its task: no length, however
frequent, is gathered or sorted in one task.

Defined results: null and empty texts are the single closing token; rows that repeat, and rows without an id, are
packed like any other; an empty table gives an empty result. Texts are encoded whole.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import chunks, text_buffer, written

CAPACITY = 2048
GROUPS = (1024, 2048)
SMALL = (1 / 4, 1 / 8)
CHUNK_BYTES = 2 << 20  # of text encoded at a time: a worker then needs about 200 MB
VOCABULARY = "byte_bpe_50k.json"


class Encoder:
    """Ids of many texts at once: every distinct unit of text is encoded once per call.

    A unit begins at a space between two characters of ASCII or Latin-1 that are no white space. The byte-level
    pattern always begins a token there, so units can be encoded apart. Units of plain Latin text go to the rank
    encoder, built of the same vocabulary file; any other unit goes to the file's own tokenizer.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as source:
            vocabulary = json.load(source)["model"]["vocab"]
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # printable bytes stand for themselves in the file
        letters = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(kept)))}
        special = {t.content for t in self.own.get_added_tokens_decoder().values()}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.rank = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)

    def _units(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, tokens per unit) of units that lie one after the other in ``data``."""
        bounds = np.concatenate([[0], np.cumsum(size)])
        plain = ((data >= 0x09) & (data <= 0x7E)) | (data == 0xC3)
        plain[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80)
        odd = np.add.reduceat(np.append(~plain, False), bounds[:-1]) > 0
        head = (data[bounds[:-1]] != 0x20) | (data[bounds[1:] - 1] <= 0x20)
        pipe = (data[:-1] == 0x3C) & (data[1:] == 0x7C)  # may be the name of a special token
        odd[np.searchsorted(bounds, np.flatnonzero(pipe), side="right") - 1] = True
        rest = ~odd & ~head
        count = np.zeros(len(size), np.int64)
        parts: list[np.ndarray] = [np.zeros(0, np.int64)] * 2
        apart: dict[int, list[int]] = {}
        raw = data.tobytes()
        for i in np.flatnonzero(odd | head):
            text = raw[bounds[i] : bounds[i + 1]].decode()
            ids = self.own.encode(text, add_special_tokens=False).ids if odd[i] else self.rank.encode_ordinary(text)
            apart[int(i)] = ids
            count[i] = len(ids)
        if rest.any():
            mask = np.repeat(rest, size)
            joined, sizes = data[mask], size[rest]
            edges = np.cumsum(sizes)
            ids, begin = [], 0
            for step in range(0, len(sizes), 4096):
                stop = int(edges[min(step + 4096, len(sizes)) - 1])
                ids.append(np.asarray(self.rank.encode_ordinary(joined[begin:stop].tobytes().decode()), np.int64))
                begin = stop
            parts = ids
            ends = np.cumsum(self.size[np.concatenate(ids)])
            upto = np.searchsorted(ends, edges, side="right")
            count[rest] = np.diff(upto, prepend=0)
        flat = np.concatenate(parts)
        tokens = np.zeros(int(count.sum()), np.int64)
        place = np.concatenate([[0], np.cumsum(count)])
        mine = np.repeat(rest, count)
        tokens[mine] = flat
        for i, ids in apart.items():
            tokens[place[i] : place[i + 1]] = ids
        return tokens, count

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, ids) of the texts data[offsets[i]:offsets[i + 1]]; each text ends with id 0."""
        texts = len(offsets) - 1
        if not len(data):
            return np.arange(texts + 1), np.zeros(texts, np.uint32)
        solid = (data > 0x20) & (data < 0x7F)
        before = solid.copy()
        before[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80)
        cut = data == 0x20
        cut[0] = False
        cut[1:] &= before[:-1]
        cut[:-1] &= solid[1:] | (data[1:] == 0xC3)
        cut[-1] = False
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(cut)
        owner = np.searchsorted(offsets, start, side="right") - 1
        units = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(data)).astype(np.int64)), pa.py_buffer(data)]
        ).dictionary_encode()
        distinct = units.dictionary
        at = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1]
        tokens, count = self._units(np.frombuffer(distinct.buffers()[2], np.uint8)[: at[-1]], np.diff(at))
        place = np.concatenate([[0], np.cumsum(count)])
        unit = units.indices.to_numpy(zero_copy_only=False)
        many = count[unit]
        first = np.cumsum(many) - many
        source = np.repeat(place[unit] - first, many) + np.arange(int(many.sum()))
        of = np.repeat(owner, many)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=texts) + 1)])
        ids = np.zeros(int(bounds[-1]), np.uint32)
        ids[np.arange(len(of)) + of] = tokens[source]
        return bounds, ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """One encoder per Python worker; without a path the installed vocabulary is taken."""
    if path is None:
        from public_tokenizers import path as installed

        path = installed(VOCABULARY)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(total: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of ``total`` tokens; only the first may be shorter than ``capacity``."""
    begin = total % capacity or min(total, capacity)
    yield 0, begin
    for start in range(begin, total, capacity):
        yield start, capacity


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and task and number, which name it within its length."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, tool = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(vocabulary)
        for batch in chunks(batches, limit=CHUNK_BYTES):
            bounds, ids = tool.encode(*text_buffer(batch.column("text")))
            rows: list[tuple[int, int, int, int, int, int]] = []
            for i in range(batch.num_rows):
                begin, total = int(bounds[i]), int(bounds[i + 1] - bounds[i])
                for k, (start, length) in enumerate(cut(total, capacity)):
                    crc = zlib.crc32(ids[begin + start : begin + start + length].astype("<u4", copy=False))
                    rows.append((i, k, start, length, crc, seen[length]))
                    seen[length] += 1
            table = np.array(rows, np.int64)
            columns = [pa.array(table[:, k]) for k in range(1, 6)]
            columns[0] = columns[0].cast(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(table[:, 0])), *columns, pa.array(np.full(len(rows), task, np.int64))],
                names=["id", "piece", "start", "length", "ids_crc32", "number", "task"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, piece int, start long, length long, ids_crc32 long, number long, task long")


Run = tuple[tuple[int, ...], int]  # the lengths in a sequence, and how many sequences have them


def _grouped(large: list[tuple[int, int]], groups: int) -> dict[int, list[list[int]]]:
    """Rounded size: the runs [length, count] it stands for; groups hold equally many pieces, longest first."""
    total = sum(n for _, n in large)
    each = max(1, -(-total // groups))
    out: dict[int, list[list[int]]] = defaultdict(list)
    room, size = 0, 0
    for length, n in large:
        while n:
            if not room:
                room, size = each, length
            take = min(room, n)
            if out[size] and out[size][-1][0] == length:
                out[size][-1][1] += take
            else:
                out[size].append([length, take])
            room -= take
            n -= take
    return out


def _completion(room: int, left: Counter, sizes: list[int]) -> tuple[int, ...]:
    """At most three sizes that fill ``room`` as far as possible, the fewest first. sizes: ascending, those in ``left``."""
    if left[room]:
        return (room,)
    best: tuple[int, tuple[int, ...]] = (0, ())
    top = bisect_left(sizes, room)
    if top:
        best = (sizes[top - 1], (sizes[top - 1],))

    def two(room: int, high: int) -> tuple[int, tuple[int, ...]]:
        """Best pair of sizes below index ``high``, by two pointers."""
        found: tuple[int, tuple[int, ...]] = (0, ())
        i, j = 0, high - 1
        while i <= j:
            total = sizes[i] + sizes[j]
            if total > room or (i == j and left[sizes[i]] < 2):
                j -= 1
                continue
            if total > found[0]:
                found = (total, (sizes[j], sizes[i]))
                if total == room:
                    return found
            i += 1
        return found

    pair = two(room, top)
    best = max(best, pair)
    if best[0] == room:
        return best[1]
    for k in range(top - 1, max(-1, top - 65), -1):
        a = sizes[k]
        total, rest = two(room - a, bisect_left(sizes, min(room - a, a)))
        if rest and a + total > best[0] and all(left[s] >= (a, *rest).count(s) for s in (a, *rest)):
            best = (a + total, (a, *rest))
            if best[0] == room:
                break
    return best[1]


def _configurations(counts: dict[int, int], capacity: int) -> list[Run]:
    """Configurations of rounded sizes, each used as often as its sizes last, largest size first."""
    left = Counter(counts)
    sizes = sorted(left)
    out: list[Run] = []
    while sizes:
        size = sizes[-1]
        left[size] -= 1  # the one that opens the sequence
        usable = sizes if left[size] else sizes[:-1]
        others = _completion(capacity - size, left, usable)
        left[size] += 1
        chosen = (size, *others)
        need = Counter(chosen)
        times = min(left[s] // n for s, n in need.items())
        for s, n in need.items():
            left[s] -= n * times
            if not left[s]:
                sizes.pop(bisect_left(sizes, s))
                del left[s]
        out.append((chosen, times))
    return out


def _substituted(configurations: list[Run], groups: dict[int, list[list[int]]]) -> list[Run]:
    """The same runs with actual lengths in the place of rounded sizes."""
    queues = {size: [list(r) for r in reversed(runs)] for size, runs in groups.items()}
    out: list[Run] = []
    for chosen, times in configurations:
        need = Counter(chosen)
        while times:
            taken = {s: queues[s][-1] for s in need}
            run = min([times, *(taken[s][1] // n for s, n in need.items())])
            if run:
                lengths = tuple(taken[s][0] for s in chosen)
                for s, n in need.items():
                    taken[s][1] -= n * run
                    if not taken[s][1]:
                        queues[s].pop()
            else:  # one sequence takes the last of one length and the first of the next
                run, own = 1, []
                for s in chosen:
                    own.append(queues[s][-1][0])
                    queues[s][-1][1] -= 1
                    if not queues[s][-1][1]:
                        queues[s].pop()
                lengths = tuple(own)
            out.append((lengths, run))
            times -= run
    return out


def _best_fit(runs: list[Run], small: list[tuple[int, int]], capacity: int) -> list[Run]:
    """Small lengths, longest first, each into the sequence with the least room that holds it."""
    by_room: dict[int, list[Run]] = defaultdict(list)
    for lengths, times in runs:
        by_room[capacity - sum(lengths)].append((lengths, times))
    for length, n in small:
        while n:
            room = next((r for r in range(length, capacity + 1) if by_room.get(r)), None)
            lengths, times = by_room[room].pop() if room is not None else ((), -(-n // (capacity // length)))
            room = capacity - sum(lengths)
            many = min(room // length, n)
            used = min(times, n // many)
            by_room[room - many * length].append((lengths + (length,) * many, used))
            n -= many * used
            if used < times and lengths:
                by_room[room].append((lengths, times - used))
            elif used < times and n:  # the last new sequence is not full
                by_room[room - n * length].append((lengths + (length,) * n, 1))
                n = 0
    return [run for runs in by_room.values() for run in runs]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS, small: tuple[float, ...] = SMALL) -> list[Run]:
    """Runs of sequences that together hold ``histogram[length]`` pieces of each length.

    ``groups`` are numbers of groups of large lengths, ``small`` shares of the capacity up to which a length is
    small; each pair of them makes a plan, and the one with the fewest sequences is taken.
    """
    lengths = sorted(((k, n) for k, n in histogram.items() if n), reverse=True)
    plans = []
    for share in small:
        border = int(capacity * share)
        for number in groups:
            large = _grouped([x for x in lengths if border < x[0]], number)
            configurations = _configurations({s: sum(n for _, n in runs) for s, runs in large.items()}, capacity)
            plans.append(_best_fit(_substituted(configurations, large), [x for x in lengths if x[0] <= border], capacity))
    return min(plans, key=lambda runs: sum(n for _, n in runs))


def _places(runs: list[Run]) -> dict[str, np.ndarray]:
    """For each stretch of ranks of a length: its key (length and first rank), first sequence, offset in a sequence."""
    seen: Counter = Counter()
    rows, sequence = [], 0
    for lengths, times in runs:
        offset = 0
        for length in lengths:
            rows.append((length << 48 | seen[length], sequence, offset))
            seen[length] += times
            offset += length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return {"key": table[:, 0], "sequence": table[:, 1], "offset": table[:, 2]}


def pack(docs: DataFrame, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    The columns are id_col, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    cuts = written(pieces(docs, capacity, vocabulary, id_col, text_col))
    per_task = written(cuts.groupBy("task", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(plan(histogram, capacity, groups)))
    running = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("task", "length", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = places.value
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            run = np.searchsorted(at["key"], key, side="right") - 1
            found = [pa.array(at["sequence"][run] + key - at["key"][run]), pa.array(at["offset"][run])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    id_type = docs.schema[id_col].dataType.simpleString()
    ranked = cuts.join(bases, ["task", "length"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.shiftleft(F.col("length"), 48) + F.col("base") + F.col("number")).alias("key")
    )
    schema = "id " + id_type + ", piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema).withColumnRenamed("id", id_col)

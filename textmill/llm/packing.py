"""Best-fit packing by bin completion with branch and bound.

What is packed are token counts, and a count is a whole number from 1 to the capacity; so a histogram of at most
``capacity`` rows holds the whole problem at any size of corpus. The solver works on it:

- the largest piece left opens a sequence; fillings of the room beside it are enumerated by growing waste, then from large
  pieces to small, leaving out dominated ones (a filling is dominated if pieces of it could be swapped for one larger or equal
  piece that is left). Bitsets of the sums that the smaller lengths can still reach, with as many pieces as there are, lead
  the enumeration, so the first filling is the one with the least waste of all, whatever the number of pieces in it;
- in the descent the best filling is repeated as often as its pieces last, so each step uses up a length;
- if the descent doesn't reach the lower bound, its last pieces (``TAILS``, more and more of them) are searched by branch and
  bound: a branch is cut when the waste spent so far rules out fewer sequences than the incumbent has;
- best-fit decreasing, over the tail and over everything, is the incumbent that the search has to beat.

Every piece then finds its place from its rank among pieces of its length and the plan's intervals of ranks. Ranks are
counted in salted groups, so a length that a third of all pieces share is spread over many tasks.

Edge cases: a null or empty text is the end id alone; texts longer than the capacity are cut into full pieces after a
shorter first one; an empty table packs into nothing; repeated rows are packed each by itself; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmill.llm.common import col, materialize
from textmill.llm.tokens import MAX_PIECES, crc32_of, default_tokenizer, encoder

CAPACITY = 2048
#: Pieces at the end that are searched, and how many nodes and fillings of a node at most.
TAILS, NODES, WIDTH = (24, 64, 160), 1500, 8
PIECES = "array<struct<start:bigint,length:bigint,ids_crc32:bigint>>"


# --- solver ---------------------------------------------------------------------------------------------------------


def _spread(bits: int, by: int) -> int:
    """Every bit, moved up by 0 to ``by`` places."""
    out, done = bits, 0
    while done < by:
        step = min(done + 1, by - done)
        out |= out << step
        done += step
    return out


def dominated(items: tuple[int, ...], waste: int, left: Counter) -> bool:
    """Whether a piece that is left could take the place of pieces of this filling, all the room they use or more."""
    one = more = 0  # sums of one piece, and of two or more
    for x in items:
        more |= (more | one) << x
        one |= 1 << x
    used = Counter(items)
    spare = sum(1 << x for x, n in left.items() if n > used.get(x, 0))
    return bool((_spread(more, waste) | _spread(one << 1, waste - 1) if waste else more) & spare)


def _reach(lens: list[int], left: Counter, room: int) -> list[int]:
    """``out[i]``: the sums up to ``room`` of pieces of ``lens[i:]``, no more than are left, as bits."""
    full, out = (1 << (room + 1)) - 1, [1]
    for x in reversed(lens):
        bits, n, part = out[-1], min(left[x], room // x), 1
        while n:
            part = min(part, n)
            bits |= (bits << (part * x)) & full
            n, part = n - part, 2 * part
        out.append(bits)
    return out[::-1]


def fillings(left: Counter, room: int) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``room``, by growing waste, then from large pieces to small; each non-increasing."""
    lens = sorted((x for x, n in left.items() if n > 0 and x <= room), reverse=True)
    reach = _reach(lens, left, room)

    def search(i: int, target: int) -> Iterator[tuple[int, ...]]:
        if not target:
            yield ()
            return
        while (reach[i] >> target) & 1:
            x = lens[i]
            i += 1
            for k in range(min(left[x], target // x), 0, -1):
                if (reach[i] >> (target - k * x)) & 1:
                    for f in search(i, target - k * x):
                        yield (x,) * k + f

    for waste in range(room + 1):
        if (reach[0] >> (room - waste)) & 1:
            for f in search(0, room - waste):
                if not dominated(f, waste, left):
                    yield f


def best_fit_decreasing(counts: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: sequences with the same content move together."""
    by_room: dict[int, Counter] = {}
    for x in sorted((k for k, n in counts.items() if n), reverse=True):
        n = counts[x]
        while n:
            room = next((r for r in range(x, capacity) if by_room.get(r)), None)
            if room is None:
                room, content, have = capacity, (), n
            else:
                content, have = next(iter(by_room[room].items()))
            k = min(room // x, n)
            take = min(have, n // k)
            if room != capacity:
                by_room[room][content] -= take
                by_room[room] += Counter()
            by_room.setdefault(room - k * x, Counter())[content + (x,) * k] += take
            n -= take * k
    return [(content, n) for groups in by_room.values() for content, n in groups.items() if n]


def _bound(counts: Counter, capacity: int) -> int:
    """Sequences that are needed at least: by volume, and with pieces that exclude each other (for every threshold)."""
    total = sum(x * n for x, n in counts.items())
    best = -(-total // capacity)
    for t in {x for x, n in counts.items() if n and 2 * x <= capacity}:
        big = sum(n for x, n in counts.items() if x > capacity - t)
        mid = [(x, n) for x, n in counts.items() if capacity / 2 < x <= capacity - t]
        low = sum(x * n for x, n in counts.items() if t <= x <= capacity / 2)
        spare = sum((capacity - x) * n for x, n in mid)
        best = max(best, big + sum(n for _, n in mid) + max(0, -(-(low - spare) // capacity)))
    return best


def _descend(counts: Counter, capacity: int, stop: int) -> tuple[list[tuple[tuple[int, ...], int]], Counter]:
    """First descent: the best filling around the largest piece, repeated while its pieces last; ends with ``stop`` pieces left."""
    left, plan = Counter(counts), []
    while (n_left := sum(left.values())) > stop:
        x = max(left)
        left[x] -= 1
        f = next(fillings(left, capacity - x))
        left[x] += 1
        content = (x, *f)
        need = Counter(content)
        times = min(left[k] // n for k, n in need.items())
        if len(f) == 0 or n_left - times * len(content) < stop:
            times = max(1, min(times, (n_left - stop) // len(content)))
        plan.append((content, times))
        for k, n in need.items():
            left[k] -= n * times
        left += Counter()
    return plan, left


def branch_and_bound(counts: Counter, capacity: int, incumbent: list[tuple[int, ...]], nodes: int = NODES, width: int = WIDTH) -> list[tuple[int, ...]]:
    """Fewer sequences than the incumbent, if the search finds them: at most ``width`` fillings a node, ``nodes`` in all."""
    best, budget = list(incumbent), [nodes]
    total = sum(x * n for x, n in counts.items())
    bound = _bound(counts, capacity)

    def search(left: Counter, done: list[tuple[int, ...]], waste: int) -> None:
        nonlocal best
        if budget[0] <= 0 or len(best) <= bound:
            return
        budget[0] -= 1
        if not left:
            if len(done) < len(best):
                best = list(done)
            return
        if len(done) + 1 > len(best) - 1:
            return
        x = max(left)
        rest = left - Counter([x])
        for f in islice(fillings(rest, capacity - x), width):
            lost = waste + capacity - x - sum(f)
            if lost > (len(best) - 1) * capacity - total:
                return
            search(rest - Counter(f), [*done, (x, *f)], lost)

    search(Counter(counts), [], 0)
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY, tails: tuple[int, ...] = TAILS) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths in order, how many sequences)`` that pack all pieces of a histogram."""
    todo = Counter({int(k): int(n) for k, n in counts.items() if n and k < capacity})
    out = [((capacity,), int(counts[capacity]))] if counts.get(capacity) else []
    if not todo:
        return out
    size = lambda p: sum(n for _, n in p)
    bound = _bound(todo, capacity)
    best, _ = _descend(todo, capacity, 0)
    if size(best) > bound:
        best = min(best, best_fit_decreasing(todo, capacity), key=size)
    for tail in tails:
        if size(best) <= bound:
            break
        head, left = _descend(todo, capacity, tail)
        fitted = [c for c, n in best_fit_decreasing(left, capacity) for _ in range(n)]
        end = branch_and_bound(left, capacity, fitted)
        best = min(best, head + [(c, 1) for c in end], key=size)
    return out + best


def intervals(packed: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows ``length, first rank, first sequence, pieces of that length in one sequence, offset`` sorted by the first two."""
    rank: Counter = Counter()
    rows, sequence = [], 0
    for content, n in packed:
        offset = 0
        for x, k in sorted(Counter(content).items(), reverse=True):
            rows.append((x, rank[x], sequence, k, offset))
            rank[x] += k * n
            offset += k * x
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


# --- frames ---------------------------------------------------------------------------------------------------------


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` ids: the first may be shorter, the others are full."""
    head = n % capacity or capacity
    return [(0, min(head, n))] + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", max_pieces: int = MAX_PIECES) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece, as a table in the shared folder."""
    path = tokenizer or default_tokenizer()

    @F.pandas_udf(PIECES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for ids in encoder(path, max_pieces).encode(texts.tolist()):
                ids = np.append(ids, np.uint32(end_id))
                out.append([{"start": s, "length": n, "ids_crc32": crc32_of(ids[s : s + n])} for s, n in cut(len(ids), capacity)])
            yield pd.Series(out)

    run = run.asNondeterministic()
    rows = docs.select(col(id_col).alias("doc_id"), run(col(text_col)).alias("p")).select("doc_id", F.posexplode("p").alias("piece", "q"))
    return materialize(rows.select("doc_id", "piece", "q.*"), "pieces")


def place(cut_up: DataFrame, capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the pieces; lengths above the capacity are an error."""
    spark = cut_up.sparkSession
    salts = salts or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = {r[0]: r[1] for r in cut_up.groupBy("length").count().collect()}  # at most ``capacity`` rows
    if any(k > capacity for k in counts):
        raise ValueError("a piece is longer than the capacity")
    table = intervals(plan(counts, capacity))
    key = (table[:, 0] << 44) + table[:, 1]

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(dtype=np.int64), rank.to_numpy(dtype=np.int64)
        row = table[np.searchsorted(key, (n << 44) + r, side="right") - 1]
        past = r - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 2] + past // row[:, 3], "offset": row[:, 4] + past % row[:, 3] * n})

    salted = cut_up.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    base = salted.groupBy("length", "__salt").count()
    base = base.select("length", "__salt", (F.sum("count").over(W.partitionBy("length").orderBy("__salt")) - F.col("count")).alias("__base"))
    ranked = salted.withColumn("__rank", F.row_number().over(W.partitionBy("length", "__salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(materialize(base, "rank-bases"), ["length", "__salt"])
    found = ranked.withColumn("__at", find.asNondeterministic()(F.col("length"), F.col("__rank") + F.col("__base")))
    return found.select(*[col(c) for c in cut_up.columns], "__at.sequence_id", "__at.offset")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return place(pieces(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

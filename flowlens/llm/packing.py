"""Best-fit packing of token pieces into sequences by bin completion.

How well pieces fit depends on their lengths alone, and there are no more different lengths than a sequence has tokens.
Spark counts the pieces of each length; the search runs on these counts, never on pieces. It takes the largest length
left and branches over the undominated fillings of the rest of its sequence, least waste first; a branch whose waste is more
than any better solution may have is pruned. Along the way the pieces left are packed by best fit; the best such
solution so far is the incumbent. A solution is a list of layouts, each with the number of sequences that
have it. Spark then numbers the pieces of each length and gives each number its place.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from flowlens.llm.common import free_name, small_batches, stored, texts, worker_state
from flowlens.session import broadcast_if_small

CAPACITY = 2048
# Fillings tried at a node, pieces that a filling may add, and nodes searched before the incumbent is taken.
FILLINGS = 12
DEPTH = 6
NODES = 6000
# Lengths left up to which every node is closed by best fit, and nodes from one such to the next beyond.
DENSE = 64
SPARSE = 50
# Groups that pieces are numbered in, about, and pieces that one length has in a group at least.
GROUPS = 1 << 14
RUN = 1 << 10
# White space, in characters, up to which the library's own splitter is used.
WHITE_RUN = 1000

# Fills: ((length, how often in a sequence), ...), longest first. Layout: fills and the number of sequences.
Fills = tuple[tuple[int, int], ...]
Layout = tuple[Fills, int]


class ByteLevelCoder:
    """Ids of byte-level BPE by a vocabulary file, as its library gives them, without added special tokens."""

    def __init__(self, vocabulary_path: str, pattern: str):
        import regex
        import tiktoken

        from flowlens.llm.prefix_tokens import byte_letters

        with open(vocabulary_path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.coder = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.white = regex.compile(pattern), regex.compile(rf"\s{{{WHITE_RUN}}}")
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _part(self, text: str) -> np.ndarray:
        if self.white.search(text):
            # The splitter gives up on very long white space; each match of the pattern stands alone anyway.
            return np.concatenate([self.coder.encode_to_numpy(w) if not w.isspace() else self._blank(w) for w in self.pattern.findall(text)])
        return self.coder.encode_to_numpy(text)

    def _blank(self, white: str) -> np.ndarray:
        return np.array(self.coder._encode_single_piece(white), "<u4")

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if self.split is None or not self.split.search(text):
            return self._part(text).astype("<u4")
        parts = [np.array([self.special[p]], "<u4") if p in self.special else self._part(p) for p in self.split.split(text) if p]
        return np.concatenate(parts).astype("<u4")


def pieces(
    docs: DataFrame, vocabulary_path: str, pattern: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids): the ids of each whole text, closed by `end_id`, in pieces of at most `capacity` tokens.

    All pieces but the first have `capacity` tokens, the first has the rest. ids are little-endian 32-bit integers; start counts the
    document's ids before. A null or empty text is the end id alone; repeated rows and null ids keep their rows; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    names, kinds = ["doc_id", "piece", "start", "length", "ids"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    end = np.array([end_id], "<u4")

    def run(batches):
        coder = worker_state(f"bytes:{vocabulary_path}:{pattern}", lambda: ByteLevelCoder(vocabulary_path, pattern))
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.concatenate([coder.ids(text), end])
                edges = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                out += [(doc_id, i, a, b - a, ids[a:b].tobytes()) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out) if out else [[]] * 5, kinds)], names)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(counts: dict[int, int], capacity: int) -> list[Layout]:
    """Best-fit decreasing over lengths and their counts; sequences with equal contents are handled as one."""
    # Open sequences by the room left: [fills, number of sequences].
    rooms: dict[int, list[list]] = {}
    keys: list[int] = []

    def put(room, fills, n):
        if room not in rooms:
            rooms[room] = []
            keys.insert(bisect_right(keys, room), room)
        rooms[room].append([fills, n])

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_right(keys, size - 1)
            room = keys[at] if at < len(keys) else capacity
            if at == len(keys):
                fills, n = (), left
            else:
                fills, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], keys[at]
            # Best fit goes on with the sequence that it just put a piece in, as long as one fits.
            each = min(room // size, left)
            full = min(n, left // each)
            if full < n and fills:
                put(room, fills, n - full)
            put(room - each * size, (*fills, (size, each)), full)
            left -= full * each
    return [(tuple(fills), n) for groups in rooms.values() for fills, n in groups]


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """A lower bound of the sequences: the best of the volume and, for each k, of those that pieces over k's complement hold alone."""
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in sizes.tolist()], np.int64)
    volume = np.concatenate([[0], np.cumsum(sizes * n)])
    number = np.concatenate([[0], np.cumsum(n)])
    best = -(-int(volume[-1]) // capacity)
    for k in [0, *sizes[2 * sizes <= capacity].tolist()]:
        low, half, high = (int(x) for x in (np.searchsorted(sizes, k), np.searchsorted(sizes, capacity // 2, "right"), np.searchsorted(sizes, capacity - k, "right")))
        alone, middle = int(number[-1] - number[half]), int(number[high] - number[half])
        free = middle * capacity - int(volume[high] - volume[half])
        best = max(best, alone + max(0, -(-(int(volume[half] - volume[low]) - free) // capacity)))
    return best


def _flat(fills: Fills) -> list[int]:
    return [size for size, times in fills for _ in range(times)]


def dominates(a: Fills, b: Fills) -> bool:
    """Whether the pieces of `b` can be dealt over those of `a` so that each of `a` is at least the sum of its share."""

    def fits(room: list[int], rest: list[int]) -> bool:
        if not rest:
            return True
        tried = set()
        for i, r in enumerate(room):
            if r >= rest[0] and r not in tried:
                tried.add(r)
                if fits([*room[:i], r - rest[0], *room[i + 1:]], rest[1:]):
                    return True
        return False

    return a != b and sum(_flat(a)) >= sum(_flat(b)) and fits(_flat(a), _flat(b))


def fillings(sizes: list[int], counts: dict[int, int], room: int, most: int = FILLINGS) -> list[Fills]:
    """Undominated fillings of `room`, least waste first; `sizes` are those in `counts`, ascending.

    Fillings of few pieces come from a search over lengths from the largest that fits down; after DEPTH pieces the rest is filled
    greedily. At most `most` are given, and a search that has found a full one for each goes no further.
    """
    found: dict[Fills, int] = {}

    def extend(room: int, at: int, taken: tuple[int, ...]) -> None:
        # Lengths from sizes[at] down may follow; those that fit leave at least one more filling.
        at = min(at, bisect_right(sizes, room) - 1)
        while at >= 0 and taken.count(sizes[at]) >= counts[sizes[at]]:
            at -= 1
        if at < 0 or not room:
            fills = tuple((s, taken.count(s)) for s in dict.fromkeys(taken))
            found[fills] = room
            return
        tries = 0
        while at >= 0 and tries < (3 if len(taken) < DEPTH else 1) and len(found) < 4 * most:
            if taken.count(sizes[at]) < counts[sizes[at]]:
                extend(room - sizes[at], at, (*taken, sizes[at]))
                tries += 1
            at -= 1

    extend(room, len(sizes) - 1, ())
    # Two pieces that fill the room exactly may be far from the largest.
    for size in reversed(sizes[:bisect_right(sizes, room)]):
        other = room - size
        if other > size or len(found) >= 8 * most:
            break
        if other in counts and counts[other] >= 1 + (other == size):
            found[((size, 1), (other, 1)) if other != size else ((size, 2),)] = 0
    ranked = sorted(found, key=lambda f: (found[f], len(_flat(f)), [-s for s in _flat(f)]))
    kept: list[Fills] = []
    for fills in ranked:
        if len(kept) < most and not any(len(_flat(f)) <= 8 and len(_flat(fills)) <= 8 and dominates(f, fills) for f in kept):
            kept.append(fills)
    return kept


def solve(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Layout]:
    """Layouts of as few sequences as the search finds for so many pieces of each length, at most `capacity` each.

    The work is bounded by the number of different lengths and by `nodes`, not by the number of pieces.
    """
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return []
    total = sum(s * n for s, n in counts.items())
    least = least_sequences(counts, capacity)
    incumbent = best_fit(counts, capacity)
    fewest = sum(n for _, n in incumbent)

    def branches(left: dict[int, int]) -> Iterator[tuple[dict[int, int], int, int]]:
        """(pieces of a sequence, how many sequences at once, waste) around the largest length, in the order to try them."""
        *sizes, largest = sorted(left)
        rest = left if left[largest] > 1 else {s: n for s, n in left.items() if s != largest}
        if left[largest] > 1:
            rest, sizes = {**left, largest: left[largest] - 1}, [*sizes, largest]
        for fills in fillings(sizes, rest, capacity - largest):
            need = dict(fills)
            need[largest] = need.get(largest, 0) + 1
            times = min(left[s] // k for s, k in need.items())
            lost = capacity - sum(s * k for s, k in need.items())
            # All at once first; then one, so that the next sequence may be filled in another way.
            for n in dict.fromkeys((times, 1)):
                yield need, n, n * lost

    # The path from the root: (pieces left, layouts so far as (layout, those before), sequences, waste, branches to try).
    path = [(counts, None, 0, 0, branches(counts))]
    seen = 0
    while path and fewest > least and seen < nodes:
        left, done, used, waste, untried = path[-1]
        branch = next(untried, None)
        if branch is None:
            path.pop()
            continue
        need, n, lost = branch
        # A better solution has one sequence less than the incumbent, so this much waste at most.
        if waste + lost > (fewest - 1) * capacity - total:
            continue
        seen += 1
        after = {s: m - n * need.get(s, 0) for s, m in left.items() if m > n * need.get(s, 0)}
        done, used = ((tuple(sorted(need.items(), reverse=True)), n), done), used + n
        # Best fit of what is left: at each node of small searches, at some of large ones.
        if len(after) <= DENSE or seen % SPARSE == 0:
            best = best_fit(after, capacity)
            if used + sum(m for _, m in best) < fewest:
                incumbent, fewest, layouts = best, used + sum(m for _, m in best), done
                while layouts:
                    incumbent, layouts = [layouts[0], *incumbent], layouts[1]
        if after:
            path.append((after, done, used, waste + lost, branches(after)))
    return incumbent


def slots(layouts: list[Layout]) -> dict[str, np.ndarray]:
    """Runs of pieces by their number within their length: (length, first, each, sequence, offset), sorted by length and first.

    The pieces `first` on of a length stand `each` to a sequence, from `sequence` on, the first of them at `offset`.
    """
    out, sequence, numbered = [], 0, {}
    for fills, n in layouts:
        offset = 0
        for size, each in fills:
            first = numbered.get(size, 0)
            out.append((size, first, each, sequence, offset))
            numbered[size] = first + each * n
            offset += each * size
        sequence += n
    table = np.array(sorted(out), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "sequence", "offset"), table.T))


def pack(items: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """`items` with sequence_id and offset (long): where each row stands in sequences of at most `capacity` tokens.

    Lengths are integers from 1 to `capacity`, of which the driver gets the counts alone; a row with another length raises. Pieces of a
    sequence follow each other from 0 without gaps. Rows of equal length may trade places, so equal and repeated rows do no harm. Nulls in
    other columns are kept; columns named sequence_id or offset are replaced. The rows are written once to shared storage, and a length
    that many rows have is numbered in groups: at most GROUPS and one for each length.
    """
    items = items.drop("sequence_id", "offset")
    columns, schema = items.columns, items.schema
    row, size, group, number, before = (free_name(items, c) for c in ("row", "size", "group", "number", "before"))
    # The row number is written, so that it is the same wherever it is read.
    rows = stored(items.withColumn(row, F.monotonically_increasing_id()))
    length = rows[length_col].cast("long")
    counts = {r["size"]: r["count"] for r in rows.groupBy(
        F.when(length.between(1, capacity), length).otherwise(-1).alias("size")).count().collect()}
    if -1 in counts:
        raise ValueError(f"{counts[-1]} rows have no length from 1 to {capacity}")
    placed = slots(solve(counts, capacity))
    # Rows of a length are dealt over groups, then numbered group by group.
    run = max(RUN, sum(counts.values()) // GROUPS)
    groups = rows.sparkSession.createDataFrame([(s, -(-n // run)) for s, n in counts.items()], f"{size} long, parts long")
    dealt = (
        rows.withColumn(size, length).join(F.broadcast(groups), size)
        .withColumn(group, F.pmod(F.xxhash64(row), F.col("parts"))).drop("parts"))
    firsts = dealt.groupBy(size, group).count().withColumn(
        before, F.coalesce(F.sum("count").over(W.partitionBy(size).orderBy(group).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    numbered = (
        dealt.withColumn(number, F.row_number().over(W.partitionBy(size, group).orderBy(row)) - 1).join(broadcast_if_small(firsts), [size, group])
        .select(*columns, size, (F.col(number) + F.col(before)).alias(number)))

    def place(batches):
        # Lengths and first numbers as one ascending key.
        width = 1 << 44
        starts = placed["length"] * width + placed["first"]
        for batch in batches:
            sizes, numbers = (batch.column(c).to_numpy().astype(np.int64) for c in (size, number))
            at = np.searchsorted(starts, sizes * width + numbers, "right") - 1
            turn, seat = np.divmod(numbers - placed["first"][at], placed["each"][at])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(placed["sequence"][at] + turn), pa.array(placed["offset"][at] + seat * sizes)],
                [*columns, "sequence_id", "offset"])

    return numbered.mapInArrow(place, T.StructType([*schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence in order, from packed rows that carry `ids`; at most `capacity` pieces are one group."""
    joined = F.array_sort(F.collect_list(F.struct("offset", "ids")))

    @F.pandas_udf("binary")
    def concatenated(parts):
        return parts.map(lambda p: b"".join(x["ids"] for x in p))

    return packed.groupBy("sequence_id").agg(joined.alias("parts")).select("sequence_id", concatenated("parts").alias("ids"))

"""Fill-in-the-middle transformation over an indexable skip list.

A text is cut into units, a word with the white space before it. The bottom lane of the skip list links one unit to the
next; each unit rises to the lane above with a chance of one in 2^RISE. A link of any lane carries two widths: the units
and the code points that it passes. To find the place after k units, a search goes down from the top lane, along links
as long as the units passed stay within k, adding both widths; on the bottom lane it stands at exactly k units, and the
code points passed are the place to cut. The lanes speed the search up; the cuts do not depend on which units rise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.common import small_batches, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# A unit rises a lane if so many more bits of its coin are zero.
RISE = 3


def unit_ends(text: str) -> np.ndarray:
    """Code points from the start to the end of each unit: `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`, left to right."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.empty(0, np.int64)
    white = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    # A unit ends where a word does; white space that no word follows is a unit too.
    last = np.empty(len(points), bool)
    last[:-1], last[-1] = ~white[:-1] & white[1:], True
    return np.flatnonzero(last) + 1


class SkipList:
    """Lanes of links, each with its width in units and in code points, over the units of one text."""

    def __init__(self, ends: np.ndarray, seed: int = 0):
        self.units = len(ends)
        # Node 0 stands before the first unit and is on every lane; node i stands after i units.
        nodes, at = np.arange(self.units + 1), np.concatenate([[0], ends])
        coins = np.random.default_rng(seed).integers(1, 1 << 62, self.units + 1)
        coins[0] = 0
        # Of each lane, bottom first: the widths of the link from each node to the next, and where the node is on the lane below.
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        below = nodes
        while len(nodes) > 1:
            self.lanes.append((np.diff(nodes), np.diff(at), below))
            below = np.flatnonzero(coins & ((1 << RISE) - 1) == 0)
            nodes, at, coins = nodes[below], at[below], coins[below] >> RISE

    def place(self, rank: int) -> int:
        """Code points in the first `rank` units."""
        node = passed = points = 0
        for level in range(len(self.lanes) - 1, -1, -1):
            units, width, below = self.lanes[level]
            while node < len(units) and passed + units[node] <= rank:
                passed, points, node = passed + int(units[node]), points + int(width[node]), node + 1
            node = int(below[node])
        return points


def _cut(doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    ends = unit_ends(text)
    n = len(ends)
    if not text or h3 % 100 >= 50 or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    lanes = SkipList(ends, h1)
    a, b = (lanes.place(rank) for rank in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 80:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): one row per row of `docs`.

    The cuts and the form are drawn from the SHA-256 of `42:` and the decimal id, nothing for a null id, so they are the same in
    every run; rows of equal id and text have equal outputs. n counts the units of the whole text, of any length. A null or
    empty text, half of the others, and those that hold a mark stay as they are: form plain, null widths. An empty table gives none.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            cuts = [_cut(doc_id, text) for doc_id, text in zip(ids, batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip([ids, *zip(*cuts)] if cuts else [[]] * 6, kinds)], names)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from. No piece holds a mark, and none can arise where a piece meets a mark."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)

"""SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints that differ in at most three bits differ in at most one bit in one of their halves. In a
half, the code words of the Hamming code over 31 of its 32 bits are the anchors: its covering radius is 1, so every
fingerprint has a home anchor within one bit. A fingerprint at most one bit away from another in that half lies within
radius plus threshold, two bits, of the other's home. Each fingerprint is therefore replicated to every anchor
within two bits (16 of 2^26, or the one it equals), and per anchor those at home are compared, over all 64 bits,
with all that were sent there. Every link is found; nothing is sampled or cut off.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.common import small_batches, stored
from flowlens.llm.components import components
from flowlens.session import broadcast_if_small

BITS = 64
# Bytes of a text that are held as words at once.
PIECE = 1 << 20
# Fingerprints at home with one anchor that one task compares; more are dealt over several.
HOME = 2048
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of a text; see fingerprints()."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    data = text.encode("utf-8", "surrogatepass").lower()
    ones, total, carry, at = np.zeros(BITS, np.int64), 0, [], 0
    while at < len(data):
        cut = len(data)
        if at + PIECE < cut and (white := _WHITE.search(data, at + PIECE)):
            cut = white.start()
        words = carry + data[at:cut].split()
        at = cut
        if len(words) < shingle:
            carry = words
            continue
        joined = b" ".join(words)
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        begins, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(begins, ends[shingle - 1:])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(hashes)
        carry = words[len(words) - shingle + 1:]
    if not total:
        if not carry:
            return 0
        value = digest(b" ".join(carry), seed)
        return value - (1 << 64) if value >> 63 else value
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint", shingle: int = 3) -> DataFrame:
    """`docs` with the SimHash of each whole text as a long.

    A-Z is lower-cased, words are runs without ASCII white space; the XXH64 (seed 42) of each run of `shingle` words,
    repeats included, votes on each bit, and a bit is set if over half have it. Fewer words: the hash of them all;
    none, or a null text: 0. Rows and columns stay as they are.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t or "", shingle) for t in text], dtype="int64")

    return docs.withColumn(out, of(F.coalesce(docs[text_col].cast("string"), F.lit(""))))


def _syndromes(x: np.ndarray) -> np.ndarray:
    """Exclusive or of the positions, from 1, of the set bits: 0 for a code word, else the bit to flip."""
    out = np.zeros(len(x), np.int64)
    for k in range(5):
        mask = np.uint64(sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1))
        out |= (np.bitwise_count(x & mask).astype(np.int64) & 1) << k
    return out


def anchors(fingerprint_values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fingerprint, at home) for every anchor of both halves within two bits; a key is half and code word."""
    keys, values, homes = [], [], []
    unsigned = fingerprint_values.view(np.uint64)
    one = np.uint64(1)
    for half in (0, 1):
        x = (unsigned >> np.uint64(32 * half)) & np.uint64((1 << 31) - 1)
        s = _syndromes(x)

        def add(code, rows, home):
            keys.append((code | np.uint64(half << 31)).astype(np.int64))
            values.append(fingerprint_values[rows])
            homes.append(np.full(len(code), home))

        everywhere = np.arange(len(x))
        off = s > 0
        add(np.where(off, x ^ (one << np.maximum(s - 1, 0).astype(np.uint64)), x), everywhere, True)
        for i in range(1, 32):
            # Two flips, at i and at i xor s, lead to a code word as well; each pair counts once.
            j = i ^ s
            rows = everywhere[off & (j > i)]
            add(x[rows] ^ (one << np.uint64(i - 1)) ^ (one << (j[rows] - 1).astype(np.uint64)), rows, False)
    return np.concatenate(keys), np.concatenate(values), np.concatenate(homes)


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links: at most one per node, with the same components."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[:len(u)], index[len(u):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    tied = label != np.arange(len(nodes))
    return nodes[tied], nodes[label[tied]]


def _compare(keys: np.ndarray, values: np.ndarray, homes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between those at home and all others of the same key; rows come sorted by key."""
    found_u, found_v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    _, first, sizes = np.unique(keys, return_index=True, return_counts=True)
    position = np.arange(len(keys)) - np.repeat(first, sizes)
    size_of = np.repeat(sizes, sizes)
    small = size_of <= 64
    for step in range(1, int(sizes[sizes <= 64].max(initial=1))):
        a = np.flatnonzero(small & (position + step < size_of))
        b = a + step
        a, b = (x[homes[a] | homes[b]] for x in (a, b))
        near = np.bitwise_count(values[a].view(np.uint64) ^ values[b].view(np.uint64)) <= most
        found_u.append(values[a[near]])
        found_v.append(values[b[near]])
    for begin, size in zip(first[sizes > 64], sizes[sizes > 64]):
        group, home = values[begin:begin + size], homes[begin:begin + size]
        at_home = group[home]
        width = max(1, (1 << 22) // size)
        for i in range(0, len(at_home), width):
            near = np.bitwise_count(at_home[i:i + width, None].view(np.uint64) ^ group[None, :].view(np.uint64)) <= most
            x, y = np.nonzero(near)
            u, v = at_home[i:i + width][x], group[y]
            u, v = _forest(u[u != v], v[u != v])
            found_u.append(u)
            found_v.append(v)
    u, v = np.concatenate(found_u), np.concatenate(found_v)
    return _forest(u[u != v], v[u != v])


def links(distinct: DataFrame, most: int = 3) -> DataFrame:
    """Links (u, v) that join all pairs of fingerprints within `most` (up to 3) differing bits into their components.

    `distinct`: one row per fingerprint. Within a task links that close a circle are left out, so copies of copies
    do not multiply. Anchors that are home to very many fingerprints are split over tasks.
    """
    schema = "key long, value long, home boolean"

    def covered(batches):
        for batch in batches:
            keys, values, homes = anchors(batch.column(0).to_numpy().astype(np.int64))
            for i in range(0, len(keys), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(values[part]), pa.array(homes[part])], ["key", "value", "home"])

    def compared(batches):
        held = None
        names = ["u", "v"]
        for batch in batches:
            # A key and its part are one group.
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "value", "home")]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut:
                u, v = _compare(*(x[:cut] for x in held), most)
                held = [x[cut:] for x in held]
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names)
        if held is not None and len(held[0]):
            u, v = _compare(*held, most)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names)

    rows = distinct.select("fingerprint").mapInArrow(covered, schema)
    hot = stored(
        rows.where("home").groupBy("key").count().where(F.col("count") > HOME)
        .select("key", F.ceil(F.col("count") / HOME).cast("long").alias("parts")))
    dealt = rows.join(broadcast_if_small(hot), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # Those at home are dealt over the parts; every part gets the others, and those at home elsewhere as such.
    own = F.pmod(F.xxhash64("value"), F.col("parts"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select(
        F.xxhash64("key", "part").alias("group"), "value", (F.col("home") & (own == F.col("part"))).alias("home"))
    return dealt.repartition("group").sortWithinPartitions("group").mapInArrow(compared, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, most: int = 3, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of `docs`.

    fingerprint: 16 lowercase hex digits; component_id: the smallest doc_id among all rows that links of at most
    `most` differing bits reach, the row itself included. Equal fingerprints are linked, those of texts without
    words too. Null texts are empty; a null doc_id counts as none and stays null only if its whole group has none;
    repeated rows and ids keep their rows; an empty table gives an empty result.
    """
    rows = stored(fingerprints(docs, text_col, "fingerprint", shingle).select(docs[id_col].cast("long").alias("doc_id"), "fingerprint"))
    classes = component_ids(rows, most)
    return rows.join(classes, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(rows: DataFrame, first, most: int) -> DataFrame:
    """(fingerprint, first, root) for each distinct fingerprint of `rows`, written to shared storage; `first` is an aggregate."""
    distinct = stored(rows.groupBy("fingerprint").agg(first.alias("first")))
    roots = components(links(distinct, most))
    return stored(
        distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
        .select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")))


def component_ids(rows: DataFrame, most: int = 3) -> DataFrame:
    """(fingerprint, component_id) for each distinct fingerprint of `rows` (doc_id, fingerprint), written to shared storage."""
    rooted = _rooted(rows, F.min("doc_id"), most)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return stored(rooted.join(least, "root").select("fingerprint", "component_id"))


def one_of_each(docs: DataFrame, most: int = 3, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that of the smallest id, null ids last.

    Groups are those of near_duplicates(); repeated rows are of one group, so one of them stays.
    """
    held = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    rows = stored(fingerprints(held, "text", "fingerprint", shingle).drop("text"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    kept = _rooted(rows, F.min(rank), most).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    dropped = stored(rows.select("row").join(kept, "row", "left_anti"))
    return rows.join(broadcast_if_small(dropped), "row", "left_anti").select("doc.*")

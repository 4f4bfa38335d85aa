"""Benchmark leaks by spaced seeds.

A seed is five words at fixed places of a window of five or six, so one mask ignores each inner place of six. In an
overlap of at least 13 words of which at least 80 % agree, some window of six has at most one word that differs
(on average less than two do), so one of the five masks finds it. Items of five and of ten words have masks of their own
for the changes that leave no such window. Seeds of the benchmark and of the corpus are joined by hash, each with all its places; overlaps are then verified word by word around the seeds that met, differing words allowed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.common import CACHE_ENTRIES, small_batches, stored, worker_state
from flowlens.session import broadcast_if_small

# Places of a seed's words.
MASKS = ((0, 1, 2, 3, 4), (0, 2, 3, 4, 5), (0, 1, 3, 4, 5), (0, 1, 2, 4, 5), (0, 1, 2, 3, 5))
# More masks for items of so many words: five words less one, and ten words whose fifth and sixth differ.
SHORT_MASKS = {5: ((0, 1, 2, 3), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 4)), 10: ((0, 1, 4, 5, 6),)}
# log2 of the bits of the filter that is sent to all tasks: 4 MB, whatever the benchmark's size.
FILTER_BITS = 25
# Words an overlap has at least; of a shorter item, all.
LEAST_WORDS = 13
SIMILARITY = 0.8
# Diagonals this close belong to one overlap with words put in or left out.
NEIGHBOURS = 2


class WordHashes:
    """64-bit hashes of words, letters and digits only, lower case; frequent words are remembered."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, text: str) -> np.ndarray:
        """The hashes of a text's words, in order; runs without a letter or digit are left out."""
        import xxhash

        known, words = self.known, text.split()
        try:
            hashes = np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > CACHE_ENTRIES:
                known.clear()
            for w in words:
                if w not in known:
                    plain = w.lower() if w.isalnum() else "".join(filter(str.isalnum, w)).lower()
                    known[w] = (xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass")) | 1) if plain else 0
            hashes = np.array([known[w] for w in words], np.uint64)
        return hashes[hashes != 0]


def _word_hashes() -> WordHashes:
    return worker_state("word-hashes", WordHashes)


def seeds(words: np.ndarray, lengths: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of every seed of a text's word hashes, mask by mask; with those of SHORT_MASKS for items of `lengths`."""
    hashes, positions = [np.empty(0, np.uint64)], [np.empty(0, np.int32)]
    short = [mask for length, masks in SHORT_MASKS.items() for mask in masks if length in lengths]
    for mask in (*MASKS, *short):
        number = _NUMBERS[mask]
        n = len(words) - mask[-1]
        if n <= 0:
            continue
        mixed = np.full(n, 0x9E3779B97F4A7C15 * (number + 1) % (1 << 64), np.uint64)
        for place in mask:
            mixed = (mixed ^ words[place:place + n]) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
        hashes.append(mixed)
        positions.append(np.arange(n, dtype=np.int32))
    return np.concatenate(hashes), np.concatenate(positions)


_NUMBERS = {mask: number for number, mask in enumerate((*MASKS, *(m for masks in SHORT_MASKS.values() for m in masks)))}


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return hashes >> np.uint64(64 - FILTER_BITS), hashes & np.uint64((1 << FILTER_BITS) - 1)


def _filter(item_seeds: DataFrame) -> np.ndarray:
    """A Bloom filter of the seeds' hashes with two bits each; the driver gets at most 2^FILTER_BITS / 64 rows."""
    h = F.col("hash")
    slots = F.array(F.shiftrightunsigned(h, 64 - FILTER_BITS), h.bitwiseAND(F.lit((1 << FILTER_BITS) - 1)))
    bits = (
        item_seeds.select(F.explode(slots).alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    rows = bits.toPandas()
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [_word_hashes().of(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), pa.array(rows, pa.binary())], ["item", "item_id", "item_words"])

    rows = benchmark.select(
        F.monotonically_increasing_id().alias("item"), benchmark[id_col].cast("long").alias("item_id"),
        F.coalesce(benchmark[text_col].cast("string"), F.lit("")).alias("text"))
    return stored(rows.mapInArrow(run, "item long, item_id long, item_words binary"))


def _item_seeds(items: DataFrame) -> DataFrame:
    """(hash, item, item_places): each seed of an item once, with all places where it stands."""

    def run(batches):
        for batch in batches:
            for item, words in zip(batch.column("item").to_pylist(), batch.column("item_words").to_pylist()):
                own = np.frombuffer(words, np.uint64)
                hashes, at = grouped(*seeds(own, (len(own),)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(np.full(len(hashes), item, np.int64)), at], ["hash", "item", "item_places"])

    return stored(items.mapInArrow(run, "hash long, item long, item_places array<int>"))


def grouped(hashes: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The distinct hashes, each with its positions."""
    order = np.argsort(hashes, kind="stable")
    distinct, first = np.unique(hashes[order], return_index=True)
    return distinct, pa.ListArray.from_arrays(pa.array([*first.tolist(), len(hashes)], pa.int32()), pa.array(positions[order], pa.int32()))


def diagonals_of(doc_places: np.ndarray, item_places: np.ndarray) -> np.ndarray:
    """The distinct differences of two lists of places, without listing all pairs."""
    if len(doc_places) == len(item_places) == 1:
        return doc_places - item_places
    low = int(doc_places.min()) - int(item_places.max())
    met = np.zeros(int(doc_places.max()) - int(item_places.min()) - low + 1, bool)
    for at in item_places:
        met[doc_places - at - low] = True
    return np.flatnonzero(met) + low


def longest_overlap(agree: np.ndarray, similarity: float) -> tuple[int, int]:
    """(begin, end) of the longest stretch whose share of agreeing words is at least `similarity`; (0, 0) if none."""
    sums = np.concatenate([[0.0], np.cumsum(agree - similarity)]) + 1e-9 * np.arange(len(agree) + 1)
    lowest = np.minimum.accumulate(sums)
    # The first begin whose sum is no higher than that of each end.
    begins = np.searchsorted(-lowest, -sums, side="left")
    lengths = np.arange(len(sums)) - begins
    end = int(lengths.argmax())
    return (int(begins[end]), end) if lengths[end] > 0 else (0, 0)


def verify(doc: np.ndarray, item: np.ndarray, diagonals: list[int], least: int, similarity: float) -> tuple[int, int, int, float] | None:
    """(first word in the document, first word in the item, words, share that agrees) of the longest overlap around the diagonals.

    Diagonals close to each other are merged: a word agrees if it does on one of them.
    """
    best = None
    groups, start = [], 0
    diagonals = sorted(diagonals)
    for i in range(1, len(diagonals) + 1):
        if i == len(diagonals) or diagonals[i] - diagonals[i - 1] > NEIGHBOURS:
            groups.append(diagonals[start:i])
            start = i
    at = np.arange(len(item))

    def overlap(group):
        agree, used = np.zeros(len(item), bool), np.zeros(len(doc), bool)
        for d in group:
            inside = at[max(0, -d):max(0, len(doc) - d)]
            same = inside[doc[inside + d] == item[inside]]
            agree[same] = True
            used[same + d] = True
        if len(item) < least:
            # All of a shorter item, its ends may differ as well.
            begin, end = (0, len(item)) if agree.mean() >= similarity - 1e-9 else (0, 0)
        else:
            begin, end = longest_overlap(agree.astype(float), similarity)
            while begin < end and not agree[begin]:
                begin += 1
            while begin < end and not agree[end - 1]:
                end -= 1
        if end - begin < min(least, len(item)) or end == begin:
            return None
        # Words of a repeated phrase must not count for more than the document has of them.
        enough = len(group) == 1 or used[max(0, begin + group[0]):end + group[-1]].sum() >= similarity * (end - begin) - 1e-9
        return (max(0, begin + group[0]), begin, end - begin, float(agree[begin:end].mean())) if enough else False

    for group in groups:
        found = overlap(group)
        for one in [found] if found is not False else [overlap([d]) for d in group]:
            if one and (best is None or one[2] > best[2]):
                best = one
    return best


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    least_words: int = LEAST_WORDS, similarity: float = SIMILARITY,
) -> DataFrame:
    """(doc_id, item_id, text_hash, doc_word, item_word, n_words, agreement): one row per document and item that overlap.

    An overlap has at least `least_words` words of the item (all of a shorter item), of which the share `similarity`
    or more agrees in place; the longest is reported. A phrase that an item repeats counts at all its places. Words are compared without case and punctuation. Null and
    empty texts, and items of fewer than five words, have no seeds and never match. Repeated rows of either table
    give a row each; null ids are kept as null; an empty table gives an empty result. text_hash is xxhash64 of the
    text, which tells rows apart whose ids repeat.
    """
    small_batches(docs.sparkSession)
    items = _items(benchmark, item_id_col, item_text_col)
    item_seeds = _item_seeds(items)
    bits = docs.sparkSession.sparkContext.broadcast(_filter(item_seeds))
    size = F.octet_length("item_words") / 8
    lengths = tuple(sorted(int(r[0]) for r in items.where(size.isin(*SHORT_MASKS)).select(size).distinct().collect()))

    def hits(batches):
        table, coder, one = bits.value, _word_hashes(), np.uint64(1)
        probe = lambda slots: table[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63)) & one > 0
        for batch in batches:
            rows, words, hashes, places = [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                own = coder.of(text)
                found, at = seeds(own, lengths)
                first, second = _slots(found)
                maybe = np.flatnonzero(probe(first))
                maybe = maybe[probe(second[maybe])]
                if len(maybe):
                    rows.append(row)
                    words.append(own.tobytes())
                    distinct, stand = grouped(found[maybe], at[maybe])
                    hashes.append(distinct.view(np.int64))
                    places.append(stand.to_pylist())
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(take), batch.column("doc_id").take(take), batch.column("text_hash").take(take), pa.array(words, pa.binary()),
                 pa.array(hashes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.list_(pa.int32())))],
                ["doc", "doc_id", "text_hash", "words", "hashes", "places"])

    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("doc"), docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    # Only documents with a seed that may be the benchmark's, each with the hashes of its words.
    near = stored(rows.mapInArrow(hits, "doc long, doc_id long, text_hash long, words binary, hashes array<long>, places array<array<int>>"))

    @F.pandas_udf("array<int>")
    def crossed(doc_places: pd.Series, item_places: pd.Series) -> pd.Series:
        return pd.Series([diagonals_of(a, b) for a, b in zip(doc_places, item_places)], dtype=object)

    met = (
        near.select("doc", F.explode(F.arrays_zip("hashes", "places")).alias("s")).select("doc", F.col("s.hashes").alias("hash"), F.col("s.places").alias("doc_places"))
        .join(item_seeds, "hash").select("doc", "item", F.explode(crossed("doc_places", "item_places")).alias("diagonal"))
        .distinct().groupBy("doc", "item").agg(F.collect_list("diagonal").alias("diagonals"))
    )

    def verified(batches):
        for batch in batches:
            keep, found = [], []
            for i, (words, own, diagonals) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("words", "item_words", "diagonals")))):
                overlap = verify(np.frombuffer(words, np.uint64), np.frombuffer(own, np.uint64), diagonals, least_words, similarity)
                if overlap:
                    keep.append(i)
                    found.append(overlap)
            take = pa.array(keep, pa.int64())
            numbers = list(zip(*found)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(take) for c in ("doc_id", "item_id", "text_hash")),
                 *(pa.array(x, t) for x, t in zip(numbers, (pa.int64(), pa.int64(), pa.int64(), pa.float64())))],
                ["doc_id", "item_id", "text_hash", "doc_word", "item_word", "n_words", "agreement"])

    return (
        met.join(near.select("doc", "doc_id", "text_hash", "words"), "doc").join(items, "item")
        .select("doc_id", "item_id", "text_hash", "words", "item_words", "diagonals")
        .mapInArrow(verified, "doc_id long, item_id long, text_hash long, doc_word long, item_word long, n_words long, agreement double")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """The rows of `docs` that overlap no item of the benchmark, with all their columns; see leaks()."""
    id_col, text_col = columns.get("id_col", "doc_id"), columns.get("text_col", "text")
    found = leaks(docs, benchmark, **columns).select(F.col("doc_id").alias("leak_id"), F.col("text_hash").alias("leak_hash")).distinct()
    bad = broadcast_if_small(stored(found))
    same = docs[id_col].cast("long").eqNullSafe(bad["leak_id"]) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == bad["leak_hash"])
    return docs.join(bad, same, "left_anti")

"""Byte-level BPE by overlapping chunks: encoding and decoding.

Long texts are cut into overlapping chunks that are pre-tokenised in parallel. In an overlap the pre-tokens of
the earlier chunk are known to be right; from the first boundary that both chunks share on, the later chunk is
right too, because a match depends only on where it starts and on what follows. There the chunks are stitched,
and the pieces between the stitches are encoded pre-token by pre-token. Decoding joins the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.common import CACHE_ENTRIES, small_batches, texts, worker_state

# Characters of a chunk, and how many more it shares with the next one.
CHUNK = 1 << 15
OVERLAP = 1 << 9


class RankCoder:
    """Encodes pre-tokens by a rank file, remembering frequent ones."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.raw = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.raw[rank] = token
        self.decimal = [str(i).encode() for i in range(len(self.raw))]
        self.known: dict[str, bytes] = {}

    @cached_property
    def library(self):
        """The library's encoder; a worker that only decodes never makes it."""
        import tiktoken

        ranks = {token: rank for rank, token in enumerate(self.raw) if token}
        return tiktoken.Encoding("ranks", pat_str=self.pattern.pattern, mergeable_ranks=ranks, special_tokens={})

    def starts(self, text: str) -> list[int]:
        return [m.start() for m in self.pattern.finditer(text)]

    def encode(self, words: list[str]) -> bytes:
        """Ids of the pre-tokens as little-endian 32-bit integers."""
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > CACHE_ENTRIES:
            known.clear()
        out = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = np.array(self.library.encode_ordinary(w), "<u4").tobytes()
                if len(w) < 64:
                    known[w] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in ids])


def _coder(ranks_path: str, pattern: str) -> RankCoder:
    return worker_state(f"ranks:{ranks_path}:{pattern}", lambda: RankCoder(ranks_path, pattern))


def cut(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, str]]:
    """(start, chunk) in order; each chunk but the last reaches `overlap` characters into the next."""
    start = 0
    while True:
        yield start, text[start:start + chunk + overlap]
        if start + chunk + overlap >= len(text):
            return
        start += chunk


def stitch(chunks: Iterable[tuple[int, str, np.ndarray]], find_starts) -> Iterator[list[str]]:
    """Pre-tokens of a document, in order, from (start, text, pre-token starts within the text) of its chunks.

    Holds one chunk at a time. Where an overlap has no common boundary (one pre-token covers it), the chunks are
    joined and split again from the last known boundary; a joined text is split again only after it has doubled.
    """
    base, text, bounds, waiting, size = 0, "", None, [], 0
    for start, piece, starts in chunks:
        if bounds is None:
            base, text, bounds = start, piece, np.asarray(starts)
            continue
        if waiting:
            have = base + len(text) + sum(map(len, waiting))
            waiting.append(piece[have - start:])
            if sum(map(len, waiting)) < size:
                continue
            text += "".join(waiting)
            waiting, bounds = [], np.asarray(find_starts(text))
            size = len(text)
            continue
        common = np.intersect1d(bounds[bounds >= start - base] + base, np.asarray(starts) + start, assume_unique=True)
        if len(common):
            at = int(common[0]) - base
            edges = bounds[bounds <= at].tolist()
            yield [text[a:b] for a, b in zip(edges, edges[1:])]
            keep = int(common[0]) - start
            starts = np.asarray(starts)
            base, text, bounds = start + keep, piece[keep:], starts[starts >= keep] - keep
            continue
        # Everything before the last boundary is settled; the rest waits for more text.
        edges = bounds.tolist()
        if len(edges) > 1:
            yield [text[a:b] for a, b in zip(edges, edges[1:])]
        base, text = base + edges[-1], text[edges[-1]:]
        waiting = [piece[base + len(text) - start:]]
        size = len(text)
        if len(waiting[0]) >= size:
            text += waiting[0]
            waiting, bounds, size = [], np.asarray(find_starts(text)), len(text)
    if bounds is not None:
        if waiting:
            text += "".join(waiting)
            bounds = np.asarray(find_starts(text))
        edges = [*bounds.tolist(), len(text)]
        yield [text[a:b] for a, b in zip(edges, edges[1:])]


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """(doc_id, ids): one row per row of `docs`; ids are little-endian 32-bit integers.

    Equals the library's encoding of the whole text without special tokens. A null or empty text has no ids;
    repeated rows, repeated and null doc_ids each keep their row; an empty table gives none. Texts of one chunk
    are encoded where they are read. Longer ones are dealt over all tasks by chunk, then stitched as a stream
    that is sorted by document and chunk, so that a task holds one chunk's text at a time.
    """
    small_batches(docs.sparkSession)
    rows = texts(docs, id_col, text_col)

    def whole(batches):
        coder = _coder(ranks_path, pattern)
        for batch in batches:
            ids = [coder.encode(coder.pattern.findall(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    def chunks_of(batches):
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("text", pa.string())])
        for batch in batches:
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                parts, held = [], 0
                for start, piece in cut(text, chunk, overlap):
                    parts.append({"row": row, "doc_id": doc, "start": start, "text": piece})
                    held += len(piece)
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_pylist(parts, schema)
                        parts, held = [], 0
                if parts:
                    yield pa.RecordBatch.from_pylist(parts, schema)

    def pretokenised(batches):
        coder = _coder(ranks_path, pattern)
        for batch in batches:
            found = [np.array(coder.starts(t), "<i4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "starts"])

    def stitched(batches):
        from itertools import groupby

        coder = _coder(ranks_path, pattern)

        def stream():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "start", "text", "starts")))

        for _, group in groupby(stream(), key=lambda r: r[0]):
            first = next(group)
            parts = ((r[2], r[3], np.frombuffer(r[4], "<i4")) for g in ([first], group) for r in g)
            ids = b"".join(coder.encode(words) for words in stitch(parts, coder.starts))
            yield pa.RecordBatch.from_arrays([pa.array([first[1]], pa.int64()), pa.array([ids], pa.binary())], ["doc_id", "ids"])

    short = rows.where(F.length("text") <= chunk).mapInArrow(whole, "doc_id long, ids binary")
    long = (
        rows.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
        .mapInArrow(chunks_of, "row long, doc_id long, start long, text string")
        .repartition("row", "start").mapInArrow(pretokenised, "row long, doc_id long, start long, text string, starts binary")
        .repartition("row").sortWithinPartitions("row", "start").mapInArrow(stitched, "doc_id long, ids binary")
    )
    return short.unionByName(long)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, raw): the bytes that the ids of each row stand for, joined."""

    def run(batches):
        coder = _coder(ranks_path, pattern)
        for batch in batches:
            raw = [coder.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def round_trip(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the bytes decoded from them.

    Reads ids only. ids_sha256 is over the decimal ids joined by commas; both digests are lowercase hex.
    """

    def run(batches):
        coder = _coder(ranks_path, pattern)
        decimal = coder.decimal
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for packed in batch.column("ids").to_pylist():
                ids = np.frombuffer(packed or b"", "<u4").tolist()
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(b",".join([decimal[i] for i in ids])).hexdigest())
                of_bytes.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

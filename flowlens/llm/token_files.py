"""Token ids of a corpus in Simple-8b files: written in document order by Spark, read back by Spark.

A file set is a Parquet folder: one row per document with the packed words, the word offset of each block of ids
and the position of the document in its shard. Shards are ranges of doc_id; a table beside them, one row per
shard, holds where each shard starts. Any document, or any block of one, can be read alone.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from flowlens.llm import simple8b
from flowlens.llm.common import small_batches, texts, worker_state

# Distinct words of a stretch of texts; a Python worker remembers those of two stretches.
WORDS = 200_000


class WordTokenizer:
    """Encodes texts word by word by a vocabulary file of BPE with word ends, remembering frequent words.

    White space ends words and is dropped, so texts are cut at ASCII white space and each distinct word is encoded
    once: normalised and split as the file says, then merged by the file's own order. The merges run in the rank
    coder, with a zero byte as the mark of a word's end; joining the mark to a word's last byte comes before all
    other merges. The library itself takes words with special strings or zero bytes. Equal to encoding the whole
    text with the library, at a third of the time.
    """

    def __init__(self, vocabulary_path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        from flowlens.llm.prefix_tokens import byte_letters

        with open(vocabulary_path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, end = byte_letters(), spec["model"]["end_of_word_suffix"]
        self.library = cache(lambda: Tokenizer.from_file(vocabulary_path))
        self.special = [t["content"] for t in spec["added_tokens"]]
        # Words stand on lines of their own; a line end is a part too.
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + r"|\n")
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in self.special:
                plain = token.removesuffix(end)
                ranks[bytes(letters[c] for c in plain) + b"\0" * (plain != token)] = i
        self.mark = ranks[b"\0"]
        self.coder = tiktoken.Encoding("words", pat_str=r"[^\n]+", mergeable_ranks=ranks, special_tokens={})
        # Words seen lately, and those of the time before, which come back when they are seen again.
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        plain, letters = [], []
        for word in words:
            if word.isalpha():
                letters.append(word)
            elif b"\0" in word or b"<|" in word:
                ids = self.library().encode(word.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids
                self.known[word] = np.array(ids, "<u4").tobytes()
            else:
                plain.append(word)
        # A word of ASCII letters is one part, and lower case is all that changes it.
        marked = [b"\0\n\0\n".join([*letters, b""]).lower().decode()]
        if plain:
            lines = b"\n".join([*plain, b""]).decode("utf-8", "surrogatepass")
            # Character by character, a capital sigma has one lower case.
            lines = unicodedata.normalize("NFC", lines).replace("\u03a3", "\u03c3").lower()
            marked.append("\0\n".join([*self.pattern.findall(lines), ""]))
        ids = self.coder.encode_to_numpy("".join(marked)).astype("<u4", copy=False)
        # A line end leaves a mark without a word.
        marks = np.flatnonzero(ids == self.mark)
        raw, begins, ends = ids.tobytes(), [0, *((marks[:-1] + 1) * 4).tolist()], (marks * 4).tolist()
        for word, a, b in zip(chain(letters, plain), begins, ends):
            self.known[word] = raw[a:b]

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [t.encode("utf-8", "surrogatepass").split() for t in batch]
        if len(self.known) > WORDS:
            self.known, self.before = {}, self.known
        if new := set().union(*split).difference(self.known):
            again = new.intersection(self.before)
            self.known.update((w, self.before[w]) for w in again)
            self.learn(new - again)
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


def tokenize_words(docs: DataFrame, vocabulary_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): little-endian 32-bit ids of each whole text, closed by `end_id`; a null or empty text is the end id alone."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        coder = worker_state(f"words:{vocabulary_path}", lambda: WordTokenizer(vocabulary_path))
        for batch in batches:
            ids = [x + end for x in coder.encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) in ranges of ascending doc_id, null ids first; texts, then nothing, settle equal ids.

    The text's hash is part of the range key, so one doc_id with many different rows is spread over shards.
    """
    rows = texts(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")


def write(tokens: DataFrame, path: str) -> None:
    """Writes (doc_id, ids), in the order of its partitions and rows, as the file set `path`."""

    def pack(batches):
        from pyspark import TaskContext

        shard, position, row = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            ids = [x or b"" for x in batch.column("ids").to_pylist()]
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            words, starts, blocks = simple8b.encode_many(np.frombuffer(b"".join(ids), "<u4"), sizes)
            # The words and block offsets of each document.
            last = np.cumsum(blocks)
            edges = np.append(starts, len(words))
            begins, ends = edges[last - blocks], edges[last]
            words, offsets = words.astype("<u8"), (starts - np.repeat(begins, blocks)).astype("<u4")
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * n, pa.int64()), pa.array(range(row, row + n), pa.int64()), batch.column("doc_id"),
                 pa.array(position + np.cumsum(sizes) - sizes, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array([offsets[a:b].tobytes() for a, b in zip(last - blocks, last)], pa.binary()),
                 pa.array([words[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary())],
                ["shard", "row", "doc_id", "shard_start", "n_tokens", "offsets", "words"])
            position += int(sizes.sum())
            row += n

    packed = tokens.mapInArrow(
        pack, "shard long, row long, doc_id long, shard_start long, n_tokens long, offsets binary, words binary")
    packed.write.mode("errorifexists").parquet(f"{path}/documents")
    spark = tokens.sparkSession
    sizes = spark.read.parquet(f"{path}/documents").groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    # One row per shard: as many as the writing job had partitions, however many documents there are.
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first_token")).write.parquet(f"{path}/shards")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a file set: start counts the ids of all documents before; ids are unpacked."""
    small_batches(spark)

    def unpack(batches):
        for batch in batches:
            words = [np.frombuffer(x, "<u8") for x in batch.column("words").to_pylist()]
            sizes = batch.column("n_tokens").to_numpy()
            shifts = np.cumsum([0, *map(len, words)])
            offsets = [np.frombuffer(x, "<u4") + shift for x, shift in zip(batch.column("offsets").to_pylist(), shifts)]
            values = simple8b.decode(np.concatenate(words or [[]]), np.concatenate(offsets or [[]]), int(sizes.sum())).astype("<u4")
            ends = np.cumsum(sizes)
            ids = [values[a:b].tobytes() for a, b in zip(ends - sizes, ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(ids, pa.binary())],
                ["doc_id", "start", "n_tokens", "ids"])

    rows = spark.read.parquet(f"{path}/documents")
    firsts = spark.read.parquet(f"{path}/shards")
    return (
        rows.join(F.broadcast(firsts), "shard").withColumn("start", F.col("first_token") + F.col("shard_start"))
        .select("doc_id", "start", "n_tokens", "offsets", "words")
        .mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")
    )


def digests(documents: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from what read() gives: crc32 over the little-endian 32-bit ids."""

    def run(batches):
        for batch in batches:
            sums = [zlib.crc32(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    return documents.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

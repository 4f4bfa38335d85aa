"""Token counts of every prefix of a text, by dynamic programming over prefixes.

For each prefix of a pre-token the last token of its byte-level BPE encoding is the one token ending there that
may follow the last token of the shorter prefix; the count is one more than that prefix has. Whether a token may
follow another is decided once per pair: the merges applied to both together must give the two again. Counts of
pre-tokens add up along the text. The result, one change of the count per character, answers truncation and
budget questions for any prefix without encoding again.
"""

from __future__ import annotations

import json
import struct
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowlens.llm.common import small_batches, texts, worker_state

# Distinct pre-tokens a Python worker remembers before it starts anew.
PRE_TOKENS = 1_000_000
# Pairs of tokens it remembers.
PAIRS = 1_000_000


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for the 256 bytes in byte-level vocabulary files."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts of one vocabulary file, remembering frequent pre-tokens and pairs."""

    def __init__(self, vocabulary_path: str, pattern: str):
        import regex

        with open(vocabulary_path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        special = {t["content"] for t in spec["added_tokens"]}
        raw = lambda token: bytes(letters[c] for c in token)
        self.tokens = {raw(t) for t in spec["model"]["vocab"] if t not in special}
        self.ranks = {}
        for i, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[raw(left), raw(right)] = i
        # Parts and rank of each token's last merge, and the longest token that starts with three bytes.
        self.made = {left + right: (left, right, rank) for (left, right), rank in self.ranks.items()}
        self.reach: dict[bytes, int] = {}
        for token in self.tokens:
            if len(token) > 2:
                self.reach[token[:3]] = max(len(token), self.reach.get(token[:3], 0))
        self.spines: tuple[dict, dict] = ({}, {})
        self.pattern = regex.compile(pattern)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.doubled = regex.compile(r"\s\s")
        self.known: dict[str, bytes] = {}
        self.fits: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """The merges in their order, on a few bytes."""
        parts = [data[i:i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            rank, at = min((ranks.get(pair, len(ranks)), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == len(ranks):
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """What stands at one end of a token (0: left, 1: right), from byte to token, each with the rank of the merge that ends it."""
        found = self.spines[side].get(token)
        if found is None:
            found, end = [], len(self.ranks)
            part = token
            while True:
                found.append((part, end))
                if part not in self.made:
                    break
                end = self.made[part][2]
                part = self.made[part][side]
            self.spines[side][token] = found = found[::-1]
        return found

    def follows(self, last: bytes, token: bytes) -> bool:
        """Whether encoding both together gives the two: no merge across their border comes before those beside it."""
        if len(self.fits) > PAIRS:
            self.fits.clear()
        if not last:
            ok = self.merged(token) == [token]
        else:
            left, right, i, j, ok = self.spine(last, 1), self.spine(token, 0), 0, 0, True
            never = len(self.ranks)
            while True:
                (a, a_ends), (b, b_ends) = left[i], right[j]
                across = self.ranks.get((a, b), never)
                # Of equal merges the left one comes first.
                if across < a_ends and across <= b_ends and across < never:
                    ok = False
                    break
                if a_ends == b_ends == never:
                    break
                if a_ends <= b_ends:
                    i += 1
                else:
                    j += 1
        self.fits[last, token] = ok
        return ok

    def counts(self, data: bytes) -> list[int]:
        """Tokens of data[:i] for each i from 0 to the length; `data` is part of one pre-token."""
        tokens, fits, reach, size = self.tokens, self.fits, self.reach, len(data)
        counts, lasts = [0] * (size + 1), [b""] * (size + 1)
        for begin in range(size):
            last, count = lasts[begin], counts[begin] + 1
            far = begin + reach.get(data[begin:begin + 3], 2)
            for end in range(begin + 1, (far if far < size else size) + 1):
                if not counts[end] and (token := data[begin:end]) in tokens:
                    ok = fits.get((last, token))
                    if ok or ok is None and self.follows(last, token):
                        counts[end], lasts[end] = count, token
        return counts

    def at_characters(self, word: str) -> list[int]:
        """Tokens of word[:i] for each i from 0 on; `word` is part of one pre-token."""
        data = word.encode("utf-8", "surrogatepass")
        counts = self.counts(data)
        if len(data) == len(word):
            return counts
        return [0, *(counts[i + 1] for i in range(len(data)) if i + 1 == len(data) or data[i + 1] & 0xC0 != 0x80)]

    def changes(self, word: str) -> bytes:
        """Change of the count by each character of a pre-token, as 16-bit integers."""
        counts = self.at_characters(word)
        if word in ("'re", "'ve", "'ll"):
            # Cut short, the contraction is a quote and a letter.
            counts[2] = self.at_characters("'")[-1] + self.at_characters(word[1])[-1]
        return np.diff(counts).astype("<i2").tobytes() if len(counts) > 64 else struct.pack(f"<{len(counts) - 1}h", *map(sub, counts[1:], counts))

    def total(self, text: str) -> int:
        return sum(self.at_characters(w)[-1] for w in self.pattern.findall(text))

    def part(self, text: str) -> np.ndarray:
        """Changes along a text without special strings."""
        words, known = self.pattern.findall(text), self.known
        if len(known) > PRE_TOKENS:
            known.clear()
        for word in {*words}.difference(known):
            known[word] = self.changes(word)
        joined = b"".join([known[w] for w in words])
        if len(text) > 1 << 20:
            known.clear()
        changes = np.frombuffer(joined, "<i2")
        if self.doubled.search(text):
            # White space that ends a prefix is one pre-token, though its last character belongs to the next one.
            changes, at = changes.copy(), 0
            for word, after in zip(words, words[1:]):
                at += len(word)
                if word.isspace() and after[0].isspace():
                    shift = self.at_characters(word + after[0])[-1] - self.at_characters(word)[-1] - self.at_characters(after[0])[-1]
                    changes[at] += shift
                    if at + 1 < len(changes):
                        changes[at + 1] -= shift
        return changes

    def text(self, text: str) -> np.ndarray:
        """Changes of the count along the text, one per character, as the library splits off special strings."""
        if not self.special or not self.special.search(text):
            return self.part(text)
        out, at = [], 0
        for found in self.special.finditer(text):
            before = text[at:found.start()]
            out.append(self.part(before))
            # Cut short, the special string is ordinary text that goes on from what stands before it.
            words = self.pattern.findall(before)
            tail = "".join(words[-2:])
            base = self.total(before) - self.total(tail)
            counts = [self.total(before), *(base + self.total(tail + found[0][:i]) for i in range(1, len(found[0]))), self.total(before) + 1]
            out.append(np.diff(counts).astype("<i2"))
            at = found.end()
        out.append(self.part(text[at:]))
        return np.concatenate(out)


def _counter(vocabulary_path: str, pattern: str) -> PrefixCounter:
    return worker_state(f"prefix:{vocabulary_path}:{pattern}", lambda: PrefixCounter(vocabulary_path, pattern))


def prefix_counts(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, changes): the prefix table of each text, 16-bit changes of the count per character.

    The sum of the first k changes is the exact token count of the first k characters, as the library encodes
    them without added special tokens. A null or empty text has no changes; repeated rows, repeated and null ids
    keep their rows.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        counter = _counter(vocabulary_path, pattern)
        for batch in batches:
            rows = [counter.text(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "changes"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, changes binary")


def token_budget(
    docs: DataFrame, vocabulary_path: str, pattern: str, limit: int, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars): answers read off the prefix table of each text.

    n_tokens is the table's last entry; fit_chars is the longest prefix, in characters, of at most `limit` tokens.
    The table is used where it is made and not moved. A null or empty text has 0 bytes and tokens.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        counter = _counter(vocabulary_path, pattern)
        for batch in batches:
            sizes, totals, fits = [], [], []
            for text in batch.column("text").to_pylist():
                prefix = np.cumsum(counter.text(text), dtype=np.int64)
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                totals.append(int(prefix[-1]) if len(prefix) else 0)
                fits.append(int(np.flatnonzero(np.concatenate([[0], prefix]) <= limit)[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()),
                 pa.array([n > limit for n in totals], pa.bool_()), pa.array(fits, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")

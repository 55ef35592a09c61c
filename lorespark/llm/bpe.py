"""Byte-level BPE encoding and decoding with a public vocabulary of merge ranks.

Each pre-token is encoded by backtracking over its longest matches: an Aho-Corasick automaton over
the bytes, mapped to Latin-1 characters, finds every vocabulary entry in one pass; a sequence of
entries is the exact merge result if and only if each adjacent pair is what merging that pair's
bytes gives, so the walk tries the longest entry at a place, takes shorter ones when the pair does
not fit, and steps back when none is left. Pair checks are memoised, and a place that has failed is
never entered again, which bounds the walk by the pre-token's length.

Defined results: a null or empty text has no ids and decodes to no bytes; texts are read whole;
repeated rows give repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import short_batches, table, text_or_empty

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Longest pre-token whose ids a worker remembers, and how many it keeps in each of two generations.
MEMO_CHARS, MEMO_SIZE = 48, 150_000
#: Pair checks that a worker remembers.
MEMO_PAIRS = 150_000
#: Characters of text that are handled before a batch of results leaves a worker.
BATCH_CHARS = 1_000_000
#: What public_tokenizers.PATTERN means for texts of ASCII characters alone, for the standard library's faster matcher.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from a file of lines with a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Codec:
    """Exact encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.find_ascii = re.compile(ASCII_PATTERN).findall if pattern == public_tokenizers.PATTERN else self.find
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.old_memo: dict[str, bytes] = {}
        # entries that merging can never produce take no part in the walk
        own = {b: i for b, i in ranks.items() if self.merged(b) == [i]}
        self.halves = {i: self.merged(b, 2) for b, i in own.items() if len(b) > 1}
        #: Whether an entry always ranks behind both entries that it is merged from.
        self.rising = all(len(h) == 2 and max(h) < i for i, h in self.halves.items())
        self.edges: tuple[dict, dict] = {}, {}
        sizes = np.zeros(max(self.bytes_of) + 1, np.int64)
        sizes[list(self.bytes_of)] = [len(b) for b in self.bytes_of.values()]
        self.sizes, self.starts = sizes, np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(sizes))), np.uint8)
        self.length = {i: len(b) for b, i in own.items()}
        self.shorter = {i: next((own[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in own), None) for b, i in own.items()}
        self.automaton = ahocorasick.Automaton()
        for b, i in own.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()

    def merged(self, piece: bytes, until: int = 1) -> list[int]:
        """By definition: again and again the leftmost adjacent pair of the lowest rank. For short pieces only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > until:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The entries at one end of a token as it is merged, each with the rank at which it goes into the next."""
        known = self.edges[side].get(token)
        if known is None:
            known, part, upto = [], token, 1 << 60
            while True:
                known.append((self.bytes_of[part], upto))
                if part not in self.halves:
                    break
                part, upto = self.halves[part][side], part
            self.edges[side][token] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives just these two: no merge across the border comes first."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            if self.rising:
                rank, known = self.ranks.get, True
                for a, upto_a in self.edge(left, 1):
                    for b, upto_b in self.edge(right, 0):
                        if (r := rank(a + b)) is not None and r < upto_a and r <= upto_b:
                            known = False
            else:
                known = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self.pairs[key] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        length, longest = self.length, [None] * (len(piece) + 1)
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - length[token]
            if longest[start] is None or length[longest[start]] < length[token]:
                longest[start] = token
        dead = bytearray(len(piece) + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            while token is not None and (dead[at + length[token]] or ids and not self.fits(ids[-1], token)):
                token = self.shorter[token]
            if token is None:
                if not ids:
                    raise ValueError("the vocabulary lacks a byte of this text")
                dead[at] = 1
                token = ids.pop()
                at -= length[token]
                token = self.shorter[token]
            else:
                ids.append(token)
                at += length[token]
                token = longest[at]
        return ids

    def packed(self, piece: str) -> bytes:
        """The ids of a pre-token as 32-bit integers."""
        ids = self.old_memo.get(piece) or array("i", self.encode_piece(piece.encode())).tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_SIZE:
                self.old_memo, self.memo = self.memo, {}
            self.memo[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers."""
        known, packed = self.memo.get, self.packed
        pieces = self.find_ascii(text) if text.isascii() else self.find(text)
        out = []
        for p in pieces:
            ids = known(p)
            if ids is None:
                ids = packed(p)
                known = self.memo.get
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and how many each has."""
        sizes = self.sizes[ids]
        total = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - (total - sizes), sizes)
        at += np.arange(len(at))
        return self.all_bytes[at], sizes


_codecs: dict[tuple[int, str], Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """The worker's codec for a vocabulary, built once."""
    key = hash(data), pattern
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(data), pattern)
    return _codecs[key]


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, ids array<int>, decoded binary (the decoded ids).

    vocabulary is the path of a rank file on the driver; its bytes, whose size the file fixes,
    travel to the executors.
    """
    short_batches(docs.sparkSession)
    with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as file:
        data = docs.sparkSession.sparkContext.broadcast(file.read())
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(data.value, pattern)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            start = 0
            while start < len(texts):
                end, chars, packed = start, 0, []
                while end < len(texts) and (end == start or chars < BATCH_CHARS):
                    packed.append(own.encode(texts[end]))
                    chars += len(texts[end])
                    end += 1
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in packed])))
                ids = np.frombuffer(b"".join(packed), np.int32)
                decoded, sizes = own.decode(ids)
                ends = np.concatenate(([0], np.cumsum(sizes)))[offsets]
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.slice(start, end - start),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                        pa.Array.from_buffers(pa.binary(), end - start, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(decoded)]),
                    ],
                    ["doc_id", "ids", "decoded"],
                )
                start = end

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>, decoded binary"
    )


def op5_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

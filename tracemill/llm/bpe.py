"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that can end its encoding. The table keeps that token, so that
appending reads only the table's end, cutting is free, and an edit needs new entries only from the edit to where the
table runs as before. A token t may follow a token s if the encoding of their joined bytes is just (s, t).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents


TOKENIZER = "byte_bpe_multi_50k.tiktoken"


class Vocabulary:
    """Ranks of a tokenizer file: lines of a base64 token and its rank. It must hold all 256 single bytes."""

    def __init__(self, path: str, pattern: str, most_pieces: int = 600_000):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, self.ranks))
        #: By the last two bytes, the lengths of the tokens that end so, longest first, and the one byte.
        found: dict[bytes, set[int]] = {}
        for token in self.ranks:
            if len(token) > 1:
                found.setdefault(token[-2:], {1}).add(len(token))
        self.lengths = {tail: sorted(sizes, reverse=True) for tail, sizes in found.items()}
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.split = regex.compile(pattern).findall
        self.most_pieces = most_pieces
        self.follows: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self._take_apart()

    def merged(self, data: bytes) -> list[int]:
        """The definition: again and again, join the leftmost pair whose joined token has the lowest rank."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:])]
            known = [r for r in ranks if r is not None]
            if not known:
                break
            at = ranks.index(min(known))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _take_apart(self) -> None:
        """For each token the two tokens that its last merge joins; itself twice if no merges make it."""
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(len(self.tokens))]
        self.joined: dict[tuple[int, int], int] = {}
        for token in sorted(self.ranks.values()):
            data = self.tokens[token]
            for cut in range(1, len(data)):
                a, b = self.ranks.get(data[:cut], token), self.ranks.get(data[cut:], token)
                if a < token and b < token and self._stays(a, b):
                    self.halves[token] = a, b
                    self.joined[a, b] = token
                    break
        self.made = [len(t) == 1 or h[0] != i for i, (t, h) in enumerate(zip(self.tokens, self.halves))]

    def _stays(self, a: int, b: int) -> bool:
        """Whether no merge crosses from a to b: undoes the merges on both sides, latest first, and at each step
        looks for a join across that would have come before the merge just undone."""
        below = len(self.tokens)
        while True:
            if self.joined.get((a, b), below) < below:
                return False
            for _ in range(2):  # the side with the later merge first; on equal terms the left one came first
                if (a > b) == (_ == 0):
                    inner = self.halves[a][1]
                    if inner != a:
                        below, a = a, inner
                        break
                else:
                    inner = self.halves[b][0]
                    if inner != b:
                        below, b = b + 1, inner
                        break
            else:
                return True

    def may_follow(self, before: int, token: int) -> bool:
        """before -1 stands for the start of the piece."""
        if before < 0:
            return self.made[token]
        key = before * len(self.tokens) + token
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > 1_000_000:
                self.follows.clear()
            known = self.follows[key] = self.made[token] and self._stays(before, token)
        return known

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.ranks.get(data)
        out = (whole,) if whole is not None else tuple(PrefixTable(self, data).tokens())
        if len(self.pieces) >= self.most_pieces:
            self.pieces.clear()
        if len(piece) < 200:
            self.pieces[piece] = out
        return out

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        get = self.pieces.get
        for piece in self.split(text):
            ids += get(piece) or self.encode_piece(piece)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixTable:
    """last[i] is the last token of the encoding of the first i bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), [-1]
        self.append(data)

    def _extend(self, data: bytes, shift: int, end: int, stop: int) -> None:
        """Entries for the prefixes of end .. stop bytes; data holds the bytes from shift on."""
        v, last = self.vocabulary, self.last
        rank, known, lengths, size, made = v.ranks.get, v.follows.get, v.lengths.get, len(v.tokens), v.made
        for end in range(end, stop + 1):
            for length in lengths(data[max(0, end - 2 - shift) : end - shift], (1,)):
                start = end - length
                if start < 0:
                    continue
                token = rank(data[start - shift : end - shift])
                if token is None:
                    continue
                before = last[start]
                follows = made[token] if before < 0 else known(before * size + token)
                if follows is None:
                    follows = v.may_follow(before, token)
                if follows:
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")

    def append(self, data: bytes) -> None:
        begin = len(self.data)
        shift = max(0, begin - self.vocabulary.longest)
        self.data += data
        self._extend(bytes(self.data[shift:]) if shift else bytes(self.data), shift, begin + 1, len(self.data))

    def cut(self, length: int) -> None:
        del self.data[length:], self.last[length + 1 :]

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Puts data in place of bytes start .. end. Returns how many entries were worked out anew."""
        old, moved = self.last, len(data) - (end - start)
        self.data[start:end] = data
        self.last = old[: start + 1]
        settled, need, done, seen = 0, self.vocabulary.longest, 0, bytes(self.data)
        for at in range(start + 1, len(self.data) + 1):
            self._extend(seen, 0, at, at)
            done += 1
            settled = settled + 1 if at > start + len(data) and old[at - moved] == self.last[at] else 0
            if settled >= need:  # later entries look back no further, so they run as before
                self.last += old[at - moved + 1 :]
                break
        return done

    def tokens(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.tokens[self.last[at]])
        return out[::-1]


_LOADED: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One for each worker process; the file is part of the workers' installation."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Vocabulary(path, pattern)
    return _LOADED[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids also ids.

    Null text: as the empty text, no tokens and the digests of nothing. Null doc_id and repeated rows: a row each. Ties
    between merges do not arise: no two tokens have one rank, and of one rank's places the leftmost merges first.
    Texts are encoded whole, however long; only doc_id and text are read, so other columns do not matter. Empty
    input: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        sha = hashlib.sha256
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                counts, digests, back, all_ids = [], [], [], []
                for text in part.column(1).to_pylist():
                    ids = v.encode(text or "")
                    counts.append(len(ids))
                    digests.append(sha(",".join(map(v.decimal.__getitem__, ids)).encode()).hexdigest())
                    back.append(sha(v.decode(ids)).hexdigest())
                    if with_ids:
                        all_ids.append(ids)
                arrays = [part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents, as `encode_documents` defines it, by the public vocabulary TOKENIZER; nulls, ties,
    repeated rows, long texts and empty tables likewise."""
    import public_tokenizers

    path = public_tokenizers.path(TOKENIZER)
    return encode_documents(documents(spark, sf_dir), path, public_tokenizers.PATTERN, with_ids=False)

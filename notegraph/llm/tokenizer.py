"""Exact byte-level BPE by backtracking from longest matches, in time linear in the text.

A token sequence is the merge procedure's result if and only if every adjacent pair is: merging the pair's own text
gives that pair back. So the encoder takes the longest token at each place and steps back to a shorter one when the
pair does not fit or nothing follows. Whether two tokens fit is remembered, as are the ids of whole pieces.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter everywhere.
VOCABULARIES = os.environ.get("NOTEGRAPH_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: how the public byte-level vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered per worker; then the memory starts afresh.
MEMORY = 400_000


class ByteBpe:
    """A byte-level BPE vocabulary given as ranks (token bytes to id, ids in merge order)."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick
        import regex

        self.find = regex.compile(PATTERN).findall
        self.ranks = ranks
        self.text = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.memory: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, bytes | None] = {"": None}
        self.made: dict[tuple[int, int], int] = {}
        for token, i in ranks.items():
            self.parts[i] = (i, i) if len(token) == 1 else self._last_merge(token, i)
            if len(token) > 1:
                self.made[self.parts[i]] = i
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()

    @classmethod
    def load(cls, folder: str = VOCABULARIES, name: str = "byte_bpe_50k.tiktoken") -> ByteBpe:
        with open(os.path.join(folder, name), "rb") as f:
            lines = (line.split() for line in f if line.strip())
            return cls({base64.b64decode(a): int(b) for a, b in lines})

    def _last_merge(self, token: bytes, own: int) -> tuple[int, int]:
        """The two tokens whose merge gives ``token``: merge its bytes by rank, its own rank left out."""
        ranks, parts = self.ranks, [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            options = [(ranks.get(a + b, own), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, k = min(options)
            if rank >= own:
                raise ValueError(f"token {own} is not made of two others")
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def _shorter(self, token: int) -> int:
        """The longest proper prefix of a token that is a token, or -1."""
        known = self.shorter.get(token)
        if known is None:
            text, known = self.text[token], -1
            for n in range(len(text) - 1, 0, -1):
                if (known := self.ranks.get(text[:n], -1)) >= 0:
                    break
            self.shorter[token] = known
        return known

    def _fit(self, left: int, right: int) -> bool:
        """Whether merging the text of ``left`` and ``right`` ends in exactly these two tokens.

        Undo merges from the inner ends, latest first; if at some time the two inner tokens had a merge earlier than
        the one undone last, that merge would have happened across the border.
        """
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, limit, good = left, right, 1 << 60, True
        while True:
            made = self.made.get((a, b))
            if made is not None and made < limit:
                good = False
                break
            inner_a, inner_b = self.parts[a][1], self.parts[b][0]
            if a > b:
                if inner_a != a:
                    a, limit = inner_a, a
                elif inner_b != b:
                    b, limit = inner_b, b + 1
                else:
                    break
            elif inner_b != b:
                b, limit = inner_b, b + 1
            elif inner_a != a:
                a, limit = inner_a, a
            else:
                break
        self.fits[left, right] = good
        return good

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """The ids of one piece of the split, without use of the memory of pieces."""
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        end = len(data)
        longest = [-1] * end
        for last, (n, token) in self.automaton.iter(data.decode("latin-1")):
            start = last - n + 1
            if longest[start] < 0 or n > self.size[longest[start]]:
                longest[start] = token
        open_at = bytearray(b"\1") * (end + 1)
        at, out, token = 0, [], longest[0]
        while True:
            to = at + self.size[token]
            if open_at[to] and (not out or self._fit(out[-1], token)):
                out.append(token)
                if to == end:
                    return tuple(out)
                at, token = to, longest[to]
                continue
            token = self._shorter(token)
            while token < 0:
                open_at[at] = 0
                token = out.pop()
                at -= self.size[token]
                token = self._shorter(token)

    def _run(self, text: str) -> bytes:
        """The ids of a text, piece by piece, as packed 32-bit numbers."""
        memory, found = self.memory, self.find(text)
        if len(memory) > MEMORY:
            memory.clear()
        for piece in set(found).difference(memory):
            memory[piece] = self.encode_piece(piece)
        return array("i", [i for p in found for i in memory[p]]).tobytes()

    def runs(self, text: str) -> list[bytes]:
        """The ids of a text as a list of packed runs, one per stretch between single spaces.

        The split pattern never joins across a space that stands between two other characters, except that the space
        goes with what follows. So such stretches are encoded, and remembered, on their own; those at wider white space
        are joined first.
        """
        words, parts = self.words, text.split(" ")
        head, parts[0] = parts[0], ""
        if len(words) > MEMORY:
            words.clear()
            words[""] = None
        got = list(map(words.get, parts))
        done: list[bytes] = []
        at, n = 0, len(parts)
        parts[0] = head
        while at < n:
            try:
                hole = got.index(None, at)
            except ValueError:
                done += got[at:]
                break
            done += got[at:hole]
            stop = hole + 1
            while stop < n and (not parts[stop] or not parts[stop - 1] or parts[stop][0].isspace() or parts[stop - 1][-1].isspace()):
                stop += 1
            part = parts[hole] if stop == hole + 1 else " ".join(parts[hole:stop])
            if hole and stop == hole + 1 and part and len(part) < 48 and not part[0].isspace() and not part[-1].isspace():
                ids = words[part] = self._run(" " + part)
            else:
                ids = self._run((" " if hole else "") + part)
            done.append(ids)
            at = stop
        return done

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text without special tokens; an empty or null text has none."""
        return list(array("i", b"".join(self.runs(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, self.runs(text))) // 4 if text else 0


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def loaded(folder: str, name: str) -> ByteBpe:
    """The vocabulary, read once per Python worker."""
    if (folder, name) not in _LOADED:
        _LOADED[folder, name] = ByteBpe.load(folder, name)
    return _LOADED[folder, name]


def encode_corpus(docs: DataFrame, key: str, text: str, folder: str = VOCABULARIES, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``(key, ids)``: the token ids of each text. Null and empty texts give an empty list. Narrow, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bpe = loaded(folder, name)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                packed = [b"".join(bpe.runs(t)) if t else b"" for t in part.column(1).to_pylist()]
                offsets = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype("i4")
                flat = np.frombuffer(b"".join(packed), "i4")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.select(F.col("key").alias(key), "ids")


def count_tokens(docs: DataFrame, key: str, text: str, folder: str = VOCABULARIES, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``(key, n_tokens)`` by the same encoder. Null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(folder, name)
        for batch in batches:
            sizes = [bpe.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["key", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, n_tokens bigint")
    return out.select(F.col("key").alias(key), "n_tokens")

"""Token ids of whole texts by a public tokenizer, as little-endian unsigned 32-bit numbers."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

ID_BYTES = 4
ADDED_TOKEN = "<|endoftext|>"  # fixed value: the one added token of the tokenizer file; its id follows the ranks
_KNOWN_CHUNKS = 700_000  # chunks a worker remembers
_BATCH_CHARS = 1 << 20
_SPACE_RUN = re.compile(r" (?=\s|\Z)")
_BREAK = re.compile(r" (?=\S)")


class _Numbers(dict):
    """Numbers chunks as they come and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        self.new.append(chunk)
        return number


class ChunkEncoder:
    """Encodes texts chunk by chunk and remembers the ids of chunks it has met.

    A byte-level tokenizer of this kind always begins a new piece at a space that is followed by a character other
    than white space, so the ids of a text are those of the chunks between such spaces, one after the other. New
    chunks are handed to the byte-pair encoder in one go, parted by the added token. Where a text holds the added token's
    string, it has its id there, and what lies before and after are texts of their own.

    The encoder reads the vocabulary's rank file, which holds the same tokens as the tokenizer file and is several
    times faster to apply; the tests hold its ids against those of the tokenizer file.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.part_id, self.part = len(ranks), ADDED_TOKEN
        self.encoder = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={self.part: self.part_id}
        )
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.ids = np.empty(0, dtype="<u4")
        self.starts = np.empty(0, dtype=np.int64)
        self.sizes = np.empty(0, dtype=np.int64)

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The text's chunks without the space before them; the first, which has none, is marked by a line feed."""
        found = _BREAK.split(text) if _SPACE_RUN.search(text) else text.split(" ")
        found[0] = "\n" + found[0]
        return found

    def _learn(self, chunks: list[str]) -> None:
        """Adds the ids of new chunks."""
        texts = [c[1:] if c[0] == "\n" else " " + c for c in chunks]
        ids = np.array(self.encoder.encode(self.part.join(texts), allowed_special={self.part}), dtype="<u4")
        parts = np.flatnonzero(ids == self.part_id)
        sizes = np.diff(np.concatenate(([-1], parts, [len(ids)]))) - 1
        ids = np.delete(ids, parts)
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate((self.ids, ids))
        self.starts, self.sizes = np.concatenate((self.starts, starts)), np.concatenate((self.sizes, sizes))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, in order."""
        parts = [t.split(self.part) if self.part in t else [t] for t in texts]
        added = self.part_id.to_bytes(ID_BYTES, "little")
        found = self._encode_parts([p for own in parts for p in own])
        for own in parts:
            yield added.join(islice(found, len(own)))

    def _encode_parts(self, texts: list[str]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= _BATCH_CHARS):
                chars += len(texts[end])
                end += 1
            if len(self.numbers) > _KNOWN_CHUNKS:
                self._forget()
            split = [self.chunks(t) for t in texts[at:end]]
            counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
            of = np.fromiter(
                map(self.numbers.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(counts.sum())
            )
            if self.numbers.new:
                self._learn(self.numbers.new)
                self.numbers.new = []
            sizes = self.sizes[of]
            ends = np.cumsum(sizes)
            place = np.arange(ends[-1]) + np.repeat(self.starts[of] - ends + sizes, sizes)
            found = self.ids[place].tobytes()
            cuts = np.concatenate(([0], ends[np.cumsum(counts) - 1])) * ID_BYTES
            yield from (found[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist()))
            at = end


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ChunkEncoder:
    return ChunkEncoder(path, pattern)


def token_ids(text: Column, path: str, pattern: str, end_id: int | None = 0) -> Column:
    """Ids of a text, then ``end_id`` if given; a null text has those of the empty text."""
    tail = b"" if end_id is None else int(end_id).to_bytes(ID_BYTES, "little")

    @F.pandas_udf("binary")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:  # one encoder for all batches of a task
        for texts in parts:
            yield pd.Series([ids + tail for ids in encoder(path, pattern).encode(texts.tolist())], dtype=object)

    return encode(F.coalesce(text, F.lit("")))

"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The ranks of a vocabulary file become a BPE model of the tokenizers library: bytes map
to printable characters, and every split of a token into two others is a merge with
the token's rank.  Texts are cut by the vocabulary's pattern; each distinct piece is
encoded once and remembered, so repeated words cost one dictionary look-up.
Offsets come from token lengths in bytes, mapped to characters through the text's own
byte table; decoding reverses the byte table and joins bytes, so a character split over
several tokens comes back whole.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from ..runtime import lean, own_names, plain_names, small_batches, trim

#: Distinct pieces that a worker remembers before it starts anew.
REMEMBERED = 100_000

#: Texts that are cut into pieces at once.
_TEXTS = 128


def byte_characters() -> list[str]:
    """The printable character of each byte: itself where it is visible, else the next free one from 256 on."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class Codec:
    """One vocabulary: ranks, the library's model and the memory of pieces."""

    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        table = byte_characters()
        shown = {token: "".join(map(table.__getitem__, token)) for token in ranks}
        merges = [
            (shown[token[:i]], shown[token[i:]])
            for token in sorted(ranks, key=ranks.__getitem__)
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        model = models.BPE({shown[t]: r for t, r in ranks.items()}, merges, ignore_merges=True)
        self.library = Tokenizer(model)
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        back = {c: b for b, c in enumerate(table)}
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = bytes(back[c] for c in shown[token])
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.decimal = [str(i) for i in range(len(self.bytes))]
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        del shown, merges
        trim()  # what the model was made from

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Token ids of every text, without special tokens."""
        pieces = [self.split(t) for t in texts]
        fresh = set(chain.from_iterable(pieces)).difference(self.known)
        if fresh:
            if len(self.known) + len(fresh) > REMEMBERED:
                self.known.clear()
                fresh = set(chain.from_iterable(pieces))
            new = list(fresh)
            lists = [new[i : i + 64] for i in range(0, len(new), 64)]
            coded = self.library.encode_batch_fast(lists, is_pretokenized=True, add_special_tokens=False)
            ids = list(chain.from_iterable(x.ids for x in coded))
            # the tokens of a piece hold its bytes: lengths tell where each piece ends
            ends = np.cumsum([len(p.encode()) for p in new])
            cut = [0, *(np.searchsorted(np.cumsum(self.length[ids]), ends) + 1).tolist()]
            self.known.update((p, tuple(ids[a:b])) for p, a, b in zip(new, cut, cut[1:]))
        look = self.known.__getitem__
        return [list(chain.from_iterable(map(look, p))) for p in pieces]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def offsets(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last.

        Tokens that share a split character all cover it.
        """
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character that each byte belongs to
        ends = np.cumsum(self.length[np.array(ids, np.int64)])
        return char[ends - self.length[np.array(ids, np.int64)]], char[ends - 1] + 1


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    return Codec(path, pattern)


def _rows(path: str | Callable[[], str], pattern: str, want: tuple[str, ...], extra: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path() if callable(path) else path, pattern)
        for batch in (whole.slice(i, _TEXTS) for whole in batches for i in range(0, whole.num_rows, _TEXTS)):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            coded = coder.encode(texts)
            cols: list[pa.Array] = []
            for w in want:
                if w == "n_tokens":
                    cols.append(pa.array([len(x) for x in coded], pa.int64()))
                elif w == "ids":
                    cols.append(pa.array(coded, pa.list_(pa.int32())))
                elif w == "ids_sha256":
                    cols.append(pa.array([hashlib.sha256(",".join(map(coder.decimal.__getitem__, x)).encode()).hexdigest() for x in coded]))
                elif w == "decoded":
                    cols.append(pa.array([coder.decode(x).decode() for x in coded], pa.string()))
                elif w == "decoded_sha256":
                    cols.append(pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in coded]))
                else:
                    spans = [coder.offsets(t, x) for t, x in zip(texts, coded)]
                    cols.append(pa.array([s[w == "ends"] for s in spans], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], names=[*batch.schema.names[1:], *want])

    return run


_KINDS = {
    "n_tokens": "long",
    "ids": "array<int>",
    "starts": "array<int>",
    "ends": "array<int>",
    "ids_sha256": "string",
    "decoded": "string",
    "decoded_sha256": "string",
}


def encode_documents(
    docs: DataFrame, path: str | Callable[[], str], pattern: str, want: tuple[str, ...] = ("n_tokens", "ids", "starts", "ends")
) -> DataFrame:
    """The other columns of ``docs`` and, for its ``text``, the ``want``ed ones of

    n_tokens, ids, starts and ends (characters), decoded (from the ids alone),
    ids_sha256 (of the decimal ids joined by commas) and decoded_sha256.

    ``path`` names the rank file where each executor finds it, or is a function that
    gives the place there.  Null and empty texts have no tokens; strings of special
    tokens are ordinary text.  Columns with the name of a wanted one are replaced.
    The work is a narrow map: no shuffle, one Arrow batch in memory.
    """
    small_batches(docs.sparkSession)
    docs, named = plain_names(docs.drop(*want), "text")
    rest = [c for c in docs.columns if c != "text"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in rest), *(f"{w} {_KINDS[w]}" for w in want)])
    return own_names(docs.select(F.col("text"), *rest).mapInArrow(lean(_rows(path, pattern, want, len(rest))), schema), named)


def decode_documents(coded: DataFrame, path: str | Callable[[], str], pattern: str) -> DataFrame:
    """Adds ``decoded`` (binary) to a DataFrame with ``ids``; null ids decode to null.

    An id outside the vocabulary is an error.  A column named ``decoded`` is replaced.
    """
    coded, named = plain_names(coded.drop("decoded"), "ids")
    rest = [c for c in coded.columns if c != "ids"]
    kinds = {f.name: f.dataType.simpleString() for f in coded.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path() if callable(path) else path, pattern)
        for batch in batches:
            out = [None if x is None else coder.decode(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    schema = ", ".join(["ids array<int>", *(f"{c} {kinds[c]}" for c in rest), "decoded binary"])
    return own_names(coded.select(F.col("ids").cast("array<int>"), *rest).mapInArrow(lean(run), schema), named)

"""Encoding of a corpus with a public byte-level BPE vocabulary, through a sentencepiece model made from it."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pre-token pattern of the vocabulary.
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens remembered in one task; a bound on memory, not on the corpus.
MEMO = 300_000


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str = VOCABULARY) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, payload: bytes | int | float) -> bytes:
    """One protobuf field: bytes by length, int as varint, float as 32 bits."""
    if isinstance(payload, float):
        return _varint(number << 3 | 5) + np.float32(payload).tobytes()
    if isinstance(payload, int):
        return _varint(number << 3) + _varint(payload)
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def piece_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model: piece i is token i in byte letters, scored by its negative rank; unknown is last.

    Normalisation is the identity: no prefix, no removal or escape of white space.
    """
    letters = byte_letters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [
        _field(1, _field(1, "".join(letters[b] for b in t).encode()) + _field(2, float(-i)) + _field(3, normal)) for i, t in enumerate(tokens)
    ]
    pieces.append(_field(1, _field(1, b"<unknown piece>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(2, _field(3, bpe) + _field(4, len(tokens) + 1) + _field(40, len(tokens)))
    normalizer = _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return b"".join(pieces) + trainer + normalizer


class Encoder:
    """Texts to ids and back with a piece model."""

    def __init__(self, model: bytes, pattern: str = PRE_TOKENS):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.table = {i: c for i, c in enumerate(byte_letters())}
        self.back = {c: i for i, c in self.table.items()}
        self.memo: dict[str, list[int]] = {}

    def ids(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; null and empty give none, control-like strings are ordinary text."""
        out: list[int] = []
        if not text:
            return out
        memo = self.memo
        for token in self.split(text):
            ids = memo.get(token)
            if ids is None:
                if len(memo) >= MEMO:
                    memo.clear()
                # utf-8 bytes, each as a letter
                ids = memo[token] = self.pieces.encode(token.encode("utf-8", "replace").decode("latin-1").translate(self.table))
            out += ids
        return out

    def text(self, ids: list[int]) -> str:
        """The text that ids stand for."""
        letters = "".join(self.pieces.id_to_piece(i) for i in ids)
        return bytes(self.back[c] for c in letters).decode("utf-8", "replace")


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids: one row per row of documents, an empty list for null and empty texts. No shuffle, one pass.

    The driver reads the vocabulary file and ships the model, so executors need no file.
    """
    model = documents.sparkSession.sparkContext.broadcast(piece_model(read_ranks(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in batches:
            # some hundred rows at a time: ids of very long texts need not be held together
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = [np.array(encoder.ids(t), dtype=np.int32) for t in part.column(1).to_pylist()]
                offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                flat = np.concatenate(lists) if lists else np.array([], np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    return documents.select(F.col(key).cast("long").alias(key), F.col(text).cast("string")).mapInArrow(run, f"{key} long, ids array<int>")

"""Byte-level BPE by a sentencepiece model that is serialised directly from the vocabulary.

Every piece is its bytes, each mapped to the character U+0100 + byte; its score is its
negative rank, so the pair of lowest rank merges first, the leftmost of equal ones. The
normaliser is the identity. Pre-tokens are encoded one by one; decoding maps the
characters of the pieces back to bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor

from envtally.llm.pretokens import read_ranks, splitter

_FIRST = 0x100
#: Pre-tokens whose ids a task keeps; then it starts anew.
CACHE = 1 << 18
#: Bytes of ids and decoded text after which a task hands on a batch.
_BATCH_BYTES = 1 << 24

# Fixed values of the model format: field numbers, wire types and enumerations.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE, _SCORE, _TYPE = 1, 2, 3
_NORMAL, _UNKNOWN = 1, 2
_MODEL_TYPE, _BPE, _VOCAB_SIZE = 3, 2, 4
_UNK_ID, _BOS_ID, _EOS_ID, _PAD_ID = 40, 41, 42, 43
_NAME, _DUMMY_PREFIX, _REMOVE_SPACES, _ESCAPE_SPACES = 1, 3, 4, 5


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def mapped(data: bytes) -> str:
    """The characters that stand for ``data``."""
    return (np.frombuffer(data, np.uint8).astype("<u2") + _FIRST).tobytes().decode("utf-16-le")


def unmapped(piece: str) -> bytes:
    return bytes(ord(c) - _FIRST for c in piece)


def model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model; the id of a piece is its place in rank order, the last is unknown."""
    pieces = sorted(ranks, key=ranks.__getitem__)
    out = bytearray()
    for piece in pieces:
        score = struct.pack("<f", -float(ranks[piece]))
        out += _bytes(
            _PIECES,
            _bytes(_PIECE, mapped(piece).encode()) + _varint(_SCORE << 3 | 5) + score + _number(_TYPE, _NORMAL),
        )
    out += _bytes(_PIECES, _bytes(_PIECE, b"<unk>") + _number(_TYPE, _UNKNOWN))
    out += _bytes(
        _TRAINER,
        _number(_MODEL_TYPE, _BPE)
        + _number(_VOCAB_SIZE, len(pieces) + 1)
        + _number(_UNK_ID, len(pieces))
        + b"".join(_number(field, -1) for field in (_BOS_ID, _EOS_ID, _PAD_ID)),
    )
    out += _bytes(
        _NORMALIZER,
        _bytes(_NAME, b"identity")
        + b"".join(_number(field, 0) for field in (_DUMMY_PREFIX, _REMOVE_SPACES, _ESCAPE_SPACES)),
    )
    return bytes(out)


class Codec:
    """Encodes and decodes with a serialised model; ``ids`` has the rank of each piece.

    A pre-token that is a piece itself is that piece, as in the library whose ids these are;
    merges build the same wherever they reach it.
    """

    def __init__(self, serialised: bytes, ids: np.ndarray, pattern: str) -> None:
        self.processor = SentencePieceProcessor(model_proto=serialised)
        self.split = splitter(pattern)
        self.ids = ids
        pieces = [unmapped(self.processor.id_to_piece(i)) for i in range(len(ids))]
        self.whole = {piece: ids[i].astype("<u4").tobytes() for i, piece in enumerate(pieces)}
        self.piece = dict(zip(ids.tolist(), pieces))
        self.cache: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        return b"".join(b"".join(self._encoded(tokens)) for tokens in self.split(text))

    def decode(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.piece.__getitem__, numbers))

    def _encoded(self, tokens: list[str]) -> Sequence[bytes]:
        parts = list(map(self.cache.get, tokens))
        if None not in parts:
            return parts
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = []
        for token in set(tokens).difference(self.cache):
            data = token.encode()
            found = self.whole.get(data)
            if found is None:
                new.append((token, mapped(data)))
            else:
                self.cache[token] = found
        encoded = self.processor.encode([m for _, m in new], out_type=int, num_threads=1)
        for (token, _), places in zip(new, encoded):
            self.cache[token] = self.ids[places].astype("<u4").tobytes()
        return itemgetter(*tokens)(self.cache) if len(tokens) > 1 else [self.cache[tokens[0]]]


def encode(docs: DataFrame, keys: Sequence[str], ranks_path: str, pattern: str) -> DataFrame:
    """``keys`` of each row of ``docs``, its ``ids`` and the text that these decode to.

    ids (binary) are little-endian unsigned 32-bit integers, decoded (binary) is UTF-8. A
    null text is an empty one, with no ids. Rows stay as they are: repeated ones repeat,
    null keys stay null, columns besides the keys and ``text`` are not read. The driver
    reads the vocabulary; the model, of fixed size, is broadcast.
    """
    ranks = read_ranks(ranks_path)
    ordered = np.array(sorted(ranks.values()), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((model(ranks), ordered))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value, pattern)
        for batch in batches:
            texts, done, ids, decoded, size = batch.column(len(keys)), 0, [], [], 0
            for row in range(len(texts)):
                ids.append(codec.encode(texts[row].as_py() or ""))
                decoded.append(codec.decode(ids[-1]))
                size += len(ids[-1]) + len(decoded[-1])
                if size > _BATCH_BYTES or row == len(texts) - 1:
                    columns = [batch.column(k).slice(done, len(ids)) for k in range(len(keys))]
                    columns += [pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, [*keys, "ids", "decoded"])
                    done, ids, decoded, size = row + 1, [], [], 0

    rows = docs.select(*keys, F.col("text").cast("string").alias("text"))
    schema = T.StructType(
        [
            *docs.select(*keys).schema.fields,
            T.StructField("ids", T.BinaryType()),
            T.StructField("decoded", T.BinaryType()),
        ]
    )
    return rows.mapInArrow(run, schema)


def digests(encoded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, n_tokens, ids_sha256, decoded_sha256`` of what ``encode`` returns."""
    return encoded.select(
        *keys,
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

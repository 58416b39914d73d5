"""Operator 10: byte-level BPE through a sentencepiece model serialised from a rank file.

The rank file's byte strings become pieces of one character per byte, scored by
negative rank, in a BPE model with identity normalisation. A text is cut by the
pre-token pattern, each pre-token is mapped to those characters and encoded, and
decoding looks the ids' bytes up again.

Cases: a null text counts as empty (no ids, digest of nothing). Very long texts
are encoded whole. Rows keep their order and number; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from sentencepiece import sentencepiece_model_pb2 as proto

from .common import Cache, read


def byte_characters() -> list[str]:
    """One printable character for each byte: itself if printable Latin-1, else from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Codec:
    """Encodes and decodes texts by the ranks in a file of lines `base64 rank`."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        chars = byte_characters()
        self.mapped = lambda raw: "".join(map(chars.__getitem__, raw))
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=self.model())
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.cache = Cache(self.one)

    def model(self) -> bytes:
        m = proto.ModelProto()
        for rank, piece in enumerate(self.bytes_of):
            m.pieces.add(piece=self.mapped(piece), score=-float(rank), type=proto.ModelProto.SentencePiece.NORMAL)
        m.pieces.add(piece="<unk>", score=0.0, type=proto.ModelProto.SentencePiece.UNKNOWN)
        m.trainer_spec.model_type = proto.TrainerSpec.BPE
        m.trainer_spec.unk_id, m.trainer_spec.bos_id, m.trainer_spec.eos_id, m.trainer_spec.pad_id = len(self.bytes_of), -1, -1, -1
        m.trainer_spec.vocab_size = len(m.pieces)
        m.normalizer_spec.name = "identity"
        m.normalizer_spec.add_dummy_prefix = m.normalizer_spec.remove_extra_whitespaces = m.normalizer_spec.escape_whitespaces = False
        return m.SerializeToString()

    def one(self, token: str) -> bytes:
        """The ids of a pre-token, little-endian; a pre-token that is itself a piece is that piece."""
        raw = token.encode()
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else self.pieces.encode(self.mapped(raw))
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=1)
def codec(rank_file: str, pattern: str) -> Codec:
    """One for each worker."""
    return Codec(rank_file, pattern)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of each row; with keep_ids the ids themselves, too."""

    def run(batches):
        c = codec(rank_file, pattern)
        try:
            for batch in batches:
                ids = [c.encode(t.as_py()) if t.is_valid else b"" for t in batch.column(1)]
                columns = [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string()),
                ]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype("i4") for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        finally:
            c.cache.clear()  # the codec outlives the task, and the stages after it need the memory

    rows = docs.select(key, text)
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents", "doc_id", "text"), *vocabulary())

"""SentencePiece encoding that keeps offsets: every piece is projected to the bytes of the original text it came from.

A text is normalised here: at each place the longest prefix in the model's compiled character map (a double array) is
replaced, else one character passes, and for each normalised byte the source byte is recorded.  The library splits the
text into pieces; the pieces' lengths lead through the normalised text, and the recorded alignment leads back.  That the
pieces add up to the normalised text is checked for every text, so an alignment that does not belong to the ids of the
library is never returned.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import pieces, tidy_arrow

BLANK = "▁".encode()
BYTE_PIECE, UNKNOWN_PIECE = 6, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Normalizer:
    """The normaliser of a model, with the source of every byte that it makes."""

    def __init__(self, model: bytes):
        spec: dict[int, int | bytes] = {}
        trainer: dict[int, int | bytes] = {}
        for number, value in _fields(model):
            if number == 3:
                spec = dict(_fields(value))
            elif number == 2:
                trainer = dict(_fields(value))
        self.prefix, self.squeeze, self.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        self.suffix = bool(trainer.get(24, 0))  # blanks stand after words
        compiled = spec.get(2, b"")
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if compiled:
            (size,) = struct.unpack_from("<I", compiled)
            self.units = struct.unpack_from(f"<{size // 4}I", compiled, 4)
            self.strings = compiled[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement of the longest prefix of ``data[at:]`` in the character map, and the prefix's length."""
        units = self.units
        node, found, unit = 0, None, units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        start, length = found
        return self.strings[start : self.strings.index(b"\0", start)], length

    def normalize(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them, and the end, the source byte."""
        if not self.units and not self.squeeze and self.escape and not self.suffix:
            return self._plain(data)
        return self._mapped(data)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int64)
        own = np.frombuffer(data, np.uint8)
        lead = (own & 0xC0) != 0x80
        source = np.maximum.accumulate(np.where(lead, np.arange(len(own)), 0))
        source = np.repeat(source, np.where(own == 32, len(BLANK), 1))
        if self.prefix:
            source = np.concatenate((np.zeros(len(BLANK), np.int64), source))
        return BLANK * self.prefix + data.replace(b" ", BLANK), np.append(source, len(data))

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        blank = BLANK if self.escape else b" "
        out, source = bytearray(), []
        at = 0
        before = self.squeeze  # leading blanks go
        start = True

        def put(what: bytes, where: int) -> None:
            out.extend(what)
            source.extend([where] * len(what))

        while at < len(data):
            found = self.longest(data, at) if self.units else None
            if found is None:
                first = data[at]
                length = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                found = (data[at : at + length], length)
            made, length = found
            if before:
                made = made.lstrip(b" ")
            if made:
                if start and self.prefix and not self.suffix:
                    put(blank, at)
                start = False
                for c in made:
                    put(blank if c == 32 else bytes((c,)), at)
                before = self.squeeze and made.endswith(b" ")
            at += length
        end = len(data)
        if self.squeeze:
            while out.endswith(blank):
                del out[-len(blank) :]
                end = source[-len(blank)]
                del source[-len(blank) :]
        if not out:
            end = 0
        elif self.prefix and self.suffix:
            put(blank, end)
        return bytes(out), np.array([*source, end], dtype=np.int64)


class Encoder:
    """Encodes and decodes with a model given as bytes."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalizer = Normalizer(model)
        sizes = []
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                sizes.append(1 if piece.get(3) == BYTE_PIECE else 0 if piece.get(3) == UNKNOWN_PIECE else len(piece[1]))
        self.sizes = np.array(sizes, dtype=np.int64)
        self.names = [str(i) for i in range(len(sizes))]

    def spans(self, data: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte, and byte after the last, of the source of each piece.

        A piece that stands for nothing in the text (the blank that is put in front) has an empty span; of the bytes of a
        character that is spelled byte by byte the last has the character's span.
        """
        made, source = self.normalizer.normalize(data)
        size = self.sizes[ids]
        if len(ids) and not size.all():
            size = self._unknown(made, ids, size)
        end = np.cumsum(size)
        if (end[-1] if len(end) else 0) != len(made):
            raise ValueError("the pieces do not add up to the normalised text")
        return source[end - size], source[end]

    def _unknown(self, made: bytes, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sizes of unknown pieces: each reaches to where the next known piece is found."""
        size = size.copy()
        at = 0
        for i in range(len(ids)):
            if size[i] == 0:
                rest = b""
                if i + 1 < len(ids):
                    rest = self.library.id_to_piece(int(ids[i + 1])).encode()
                end = made.index(rest, at + 1) if rest else len(made)
                size[i] = end - at
            at += int(size[i])
        return size


_SPANS = "array<struct<id: int, begin: long, end: long>>"


def _encode(model: bytes, passed: list[str], spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            for piece in pieces(batch, "_text"):
                texts = piece.column("_text").fill_null("").to_pylist()
                ids = encoder.library.encode(texts, num_threads=1)
                decoded = encoder.library.decode(ids, num_threads=1) if ids else []
                names, n, sums, back, spanned = encoder.names, [], [], [], []
                for text, own, again in zip(texts, ids, decoded, strict=True):
                    begin, end = encoder.spans(text.encode(), np.array(own, dtype=np.int64))
                    n.append(len(own))
                    sums.append(hashlib.sha256(",".join([names[i] for i in own]).encode()).hexdigest())
                    back.append(hashlib.sha256(again.encode()).hexdigest())
                    if spans:
                        spanned.append(pa.StructArray.from_arrays(
                            [pa.array(own, pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], names=["id", "begin", "end"]
                        ))
                columns = [*(piece.column(c) for c in passed), pa.array(n, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())]
                labels = [*passed, "n_tokens", "ids_sha256", "decoded_sha256"]
                if spans:
                    at = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                    columns += [pa.ListArray.from_arrays(at, pa.concat_arrays(spanned)), pa.array(decoded, pa.string())]
                    labels += ["pieces", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=labels)

    return run


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of each row and, with ``spans``, ``pieces`` (id, and
    first and last byte of its source in the text) and ``decoded``.

    Ids are those of the library without begin and end ids; the model's file is read on the driver (its size does not
    depend on the data).  Spans are found and checked in any case.  A null text is an empty one, without pieces; null ids and
    repeated rows are carried through; other columns are not read.
    """
    tidy_arrow(docs.sparkSession)
    with open(model_path, "rb") as file:
        model = file.read()
    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = read.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + f", pieces {_SPANS}, decoded string" * spans
    return read.mapInArrow(_encode(model, ["_id"], spans), schema).withColumnRenamed("_id", id_col)

"""SentencePiece encoding and decoding with byte spans in the original text."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, ship, slices, table

MARK = "▁"
#: Distinct segments that a worker keeps encoded; when full, the cache starts anew.
CACHE = 300_000


class CharMap:
    """The compiled character map of a model: a double-array trie over UTF-8 keys, then the replacements.

    Layout (public format): uint32 size of the trie in bytes, its uint32 units, then zero-terminated UTF-8
    replacements; a leaf's value is the offset of its replacement.
    """

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.text = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that ``data`` has at ``at`` and its replacement, if any key fits."""
        units = self.units
        if not units:
            return None
        found = None

        def base(unit: int) -> int:
            return (unit >> 10) << ((unit & 0x200) >> 6)

        node = base(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= base(unit)
            if unit & 0x100:  # a value hangs here
                value = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.text[value : self.text.index(b"\0", value)])
        return found


class Normalizer:
    """Longest-prefix normalisation that records, for every normalised byte, the original byte it comes from."""

    def __init__(self, charmap: bytes, dummy_prefix: bool, squeeze: bool, escape: bool):
        self.map = CharMap(charmap)
        self.dummy_prefix, self.squeeze, self.escape = dummy_prefix, squeeze, escape
        self.space = MARK.encode() if escape else b" "
        self.plain = not charmap and not squeeze and escape
        self.seen: dict[str, tuple[int, bytes]] = {}

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and origins: as many offsets into ``data`` as there are bytes, and one more for the end."""
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.plain:
            raw = np.frombuffer(data, np.uint8)
            origin = np.repeat(np.arange(len(raw), dtype=np.int32), np.where(raw == 32, 3, 1))
            text = data.replace(b" ", self.space)
            if self.dummy_prefix:
                text, origin = self.space + text, np.concatenate([np.zeros(3, np.int32), origin])
            return text, np.append(origin, np.int32(len(data)))
        return self._mapped(data)

    def _chunk(self, data: bytes, at: int) -> tuple[int, bytes]:
        found = self.map.longest(data, at)
        if found:
            return found
        lead = data[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return n, data[at : at + n]

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        out, origin, at = bytearray(), [], 0
        after_space = self.squeeze
        if self.squeeze:  # leading spaces go before the prefix is set
            while at < len(data):
                n, to = self._chunk(data, at)
                if to.strip(b" "):
                    break
                at += n
            if at == len(data):
                return b"", np.array([at])
        if self.dummy_prefix:
            out += self.space
            origin += [at] * len(self.space)
        while at < len(data):
            n, to = self._chunk(data, at)
            if self.squeeze and after_space:
                to = to.lstrip(b" ")
            if to:
                new = to.replace(b" ", self.space)
                out += new
                origin += [at] * len(new)
                after_space = to.endswith(b" ")
            at += n
            if not self.squeeze:
                after_space = False
        end = len(data)
        if self.squeeze:
            while out.endswith(self.space):
                del out[-len(self.space) :]
                end = origin[len(out)]
                del origin[len(out) :]
        return bytes(out), np.array([*origin, end])


class _Segments(dict):
    """Segment to its ids as bytes, encoded when first asked for."""

    def __init__(self, processor):
        super().__init__()
        self.encode = processor.encode

    def __missing__(self, segment: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self.encode(segment)
        got = self[segment] = struct.pack(f"<{len(ids)}I", *ids)
        return got


class Encoder:
    """Encodes whole texts as the library does, a cached segment at a time.

    The model's merges never join a mark for a space to a character before it when no piece holds such a pair, nor
    anything to a newline when no piece holds one beside another character (both checked here). So text cut before
    each run of marks and around newlines is encoded segment by segment with the same ids; else the whole text is one
    segment.
    """

    def __init__(self, model_path: str):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        if any(p.type == 4 for p in model.pieces):
            raise ValueError("models with user-defined symbols aren't supported")
        spec = model.normalizer_spec
        self.normalize = Normalizer(
            spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        )
        self.library = spm.SentencePieceProcessor(model_file=model_path)
        self.bos, self.eos, self.unk = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        bare = pb.ModelProto()
        bare.CopyFrom(model)
        bare.ClearField("normalizer_spec")
        bare.normalizer_spec.name = "identity"
        bare.normalizer_spec.add_dummy_prefix = False
        bare.normalizer_spec.remove_extra_whitespaces = False
        bare.normalizer_spec.escape_whitespaces = False
        self.bare = spm.SentencePieceProcessor(model_proto=bare.SerializeToString())
        self.lengths = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in model.pieces], np.int32)
        crosses = re.compile(f"[^{MARK}]{MARK}")
        whole = model.trainer_spec.model_type != 2 or any(crosses.search(p.piece) for p in model.pieces)
        lone = "" if any("\n" in p.piece and len(p.piece) > 1 for p in model.pieces) else "\n"
        self.cut = re.compile("(?s).+" if whole else f"{MARK}*[^{MARK}{lone}]+|{MARK}+" + f"|{lone}+" * bool(lone))
        self.cache = _Segments(self.bare)

    def _sizes(self, ids: np.ndarray, segments: list[str]) -> np.ndarray:
        """Bytes of normalised text that each id stands for."""
        if not (ids == self.unk).any():
            return self.lengths[ids]
        pieces = [p for s in segments for p in self.bare.encode(s, out_type="immutable_proto").pieces]
        return np.array([1 if self.bare.is_byte(p.id) else len(p.surface.encode()) for p in pieces], np.int32)

    def encode(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """ids with begin and end, as little-endian uint32 bytes, and each id's (start, end) bytes in ``data``."""
        text, origin = self.normalize(data)
        segments = self.cut.findall(text.decode())
        ids = b"".join(map(self.cache.__getitem__, segments))
        sizes = self._sizes(np.frombuffer(ids, "<u4"), segments)
        edges = np.zeros(len(sizes) + 1, np.int32)
        np.cumsum(sizes, out=edges[1:])
        at = origin[edges]
        spans = np.zeros((len(edges) + 1, 2), "<i4")
        spans[1:-1, 0], spans[1:-1, 1] = at[:-1], at[1:]
        spans[-1] = len(data)
        begin, end = struct.pack("<I", self.bos), struct.pack("<I", self.eos)
        return begin + ids + end, spans

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


_ENCODERS: dict[str, Encoder] = {}


def encoder(model_path: str) -> Encoder:
    """One per worker process and model."""
    if model_path not in _ENCODERS:
        _ENCODERS[model_path] = Encoder(model_path)
    return _ENCODERS[model_path]


_SCHEMA = "doc_id long, ids binary, spans binary, decoded string"


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (little-endian uint32 with begin and end), spans (pairs of little-endian int32: first byte and
    byte after the last in the original text, per id) and the text that the library decodes from the ids.

    Row by row, without a shuffle. Null and empty texts give the begin and end ids, spans (0, 0) twice and an
    empty decoded text; repeated texts repeat their result; an empty table gives none; further columns are not
    read. ``model_path`` must exist on every executor.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_path)
        for batch in slices(batches, limit=2 << 20):
            ids, spans, decoded = [], [], []
            for text in batch.column("text"):
                i, s = e.encode(text.as_py().encode())
                ids.append(i)
                spans.append(s.tobytes())
                decoded.append(e.decode(i))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary()), pa.array(spans, pa.binary()), pa.array(decoded, pa.string())],
                names=["doc_id", "ids", "spans", "decoded"],
            )

    return doc_text(docs).mapInArrow(run, _SCHEMA)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.sha2("spans", 256).alias("spans_sha256"),
    )


def public_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_pieces(spark, sf_dir: str) -> DataFrame:
    return digests(encode_documents(table(spark, sf_dir, "documents"), public_model()))

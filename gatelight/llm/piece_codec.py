"""SentencePiece BPE encoding and decoding that keeps byte offsets into the source text.

Encoding has two steps. The text is first normalised by longest-prefix replacement
through the compiled character map of the model, and for every normalised byte the source
byte it came from is kept. Then the normalised text is segmented by merging the best
scored neighbours, and every piece is projected through that alignment to a span of bytes
of the original text.

Segments are found once per distinct run: where no piece of the vocabulary crosses a word
start, or holds some character together with others, merging cannot cross it either, so
runs between such places are independent and their pieces are remembered.

Null and empty texts give no pieces (only the end id, when asked for). Texts of any length
are encoded whole; memory follows the longest text of a batch. Repeated rows give equal
rows, other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelight.llm.common import id_and_text, packed_ints, slices, texts_of

SPACE = "▁"
_SPACE_BYTES = SPACE.encode()
_NO_PIECE = "⁇"  # what an unknown id decodes to, between spaces

ENCODED = "doc_id long, ids array<int>, begins array<int>, ends array<int>"


class CharMap:
    """The compiled character map: a double-array trie over source bytes, values pointing at replacements.

    Layout (fixed format): trie size as little-endian uint32, the trie units, then the
    replacements as zero-terminated UTF-8.
    """

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.replacements = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of ``data[at:]``, and its replacement."""
        units, found = self.units, None
        unit = units[0]
        node = _offset(unit)
        for used in range(at, len(data)):
            node ^= data[used]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[used]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found = (used + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        start = found[1]
        return found[0], self.replacements[start : self.replacements.index(b"\0", start)]


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 0x200) >> 6)


def _char_length(lead: int) -> int:
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class PieceCodec:
    """Encoder and decoder of one model file.

    Two generations of runs are remembered, at most ``MOST`` each; that bounds memory and
    changes no result.
    """

    MOST, LONGEST = 100_000, 64

    def __init__(self, model_file: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as schema

        model = schema.ModelProto()
        with open(model_file, "rb") as file:
            model.ParseFromString(file.read())
        self._set_up(model)

    def _set_up(self, model) -> None:
        from sentencepiece import SentencePieceProcessor

        if model.trainer_spec.model_type != 2:
            raise ValueError("only BPE models can be read")
        spec = model.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.dummy_prefix, self.trims, self.escapes = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.fallback = model.trainer_spec.byte_fallback
        self.ids: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        self.surface: list[bytes | None] = []
        self.is_byte: list[bool] = []
        self.unknown, self.end_id = 0, model.trainer_spec.eos_id
        for number, piece in enumerate(model.pieces):
            kind = piece.type  # 1 normal, 2 unknown, 3 control, 4 user defined, 5 unused, 6 byte
            if kind in (4, 5):
                raise ValueError("models with user-defined or unused pieces are not read")
            if kind == 1:
                self.ids[piece.piece] = number
                self.surface.append(piece.piece.encode().replace(_SPACE_BYTES, b" "))
            elif kind == 6:
                self.byte_ids[int(piece.piece[3:5], 16)] = number
                self.surface.append(bytes([int(piece.piece[3:5], 16)]))
            elif kind == 2:
                self.unknown = number
                self.surface.append(f" {_NO_PIECE} ".encode())
            else:
                self.surface.append(b"")
            self.is_byte.append(kind == 6)
        self.controls = {i for i, put in enumerate(self.surface) if not put}
        joined = {c for piece in self.ids if len(piece) > 1 for c in piece}
        word_starts = not any(SPACE in piece.lstrip(SPACE) for piece in self.ids)
        # Characters that stand alone in the vocabulary never merge: frequent ones cut runs.
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        if word_starts:
            cut = f"[{alone}]|" if alone else ""
            self.runs = re.compile(f"{cut}{SPACE}*[^{SPACE}{alone}]+|{SPACE}+")
        else:
            self.runs = re.compile(r"(?s).+")
        self.sizes = [len(piece.piece.encode()) for piece in model.pieces]
        self.byte_set = set(self.byte_ids.values())
        # The library segments what is normalised already.
        spec.Clear()
        spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", False, False, False
        self.segmenter = SentencePieceProcessor(model_proto=model.SerializeToString())
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    # Normalisation

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the source byte."""
        data = text.encode()
        if not data:
            return b"", np.zeros(1, np.int32)
        if self.map is None and not self.trims:
            source = np.frombuffer(data, np.uint8)
            wide = np.ones(len(data), np.int64)
            if self.escapes:
                wide[source == 0x20] = 3
            steps = np.repeat(np.arange(len(data), dtype=np.int32), wide)
            space = _SPACE_BYTES if self.escapes else b" "
            head = space if self.dummy_prefix else b""
            align = np.concatenate([np.zeros(len(head), np.int32), steps, np.array([len(data)], np.int32)])
            return head + data.replace(b" ", space), align
        return self._normalise_stepwise(data)

    def _normalise_stepwise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        space = _SPACE_BYTES if self.escapes else b" "
        parts: list[tuple[bytes, int, int]] = []  # replacement, source begin, source end
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at) if self.map else None
            used, put = hit or (_char_length(data[at]), data[at : at + _char_length(data[at])])
            parts.append((put, at, at + used))
            at += used
        if self.trims:
            while parts and parts[0][0] == b" ":
                parts.pop(0)
        if not parts:
            return b"", np.array([len(data)], np.int32)
        out, align = bytearray(), []
        if self.dummy_prefix:
            out += space
            align += [parts[0][1]] * len(space)
        after_space = self.trims
        for put, begin, _ in parts:
            if after_space:
                put = put.lstrip(b" ")
            if put:
                for byte in put:
                    piece = space if byte == 0x20 else bytes([byte])
                    out += piece
                    align += [begin] * len(piece)
                after_space = self.trims and put.endswith(b" ")
        end = len(data)
        if self.trims:
            while out.endswith(space):
                end = align[len(out) - len(space)]
                del out[-len(space) :]
                del align[len(out) :]
        return bytes(out), np.array([*align, end], np.int32)

    # Segmentation

    def _pairs(self, run: str, ids: list[int]) -> bytes:
        """Pairs of id and length in bytes of the pieces of one run, as int32."""
        sizes = [self.sizes[i] for i in ids]
        if self.unknown in ids:
            sizes = [len(p.encode()) for p in self.segmenter.encode(run, out_type=str)]
        elif not self.byte_set.isdisjoint(ids):
            # Of the bytes of one character the last stands for it, the others for its start.
            rest = whole = 0
            for at, number in enumerate(ids):
                if self.is_byte[number]:
                    if rest:
                        rest -= 1
                    else:
                        whole = _char_length(self.surface[number][0])
                        rest = whole - 1
                    sizes[at] = 0 if rest else whole
        return np.array([x for pair in zip(ids, sizes) for x in pair], "<i4").tobytes()

    def _known(self, runs: set[str]) -> dict[str, bytes]:
        """The pieces of every run; those not remembered are segmented in one call."""
        known = {r: f for r in runs if (f := self.memory.get(r) or self.older.get(r)) is not None}
        new = list(runs - known.keys())
        if new:
            known.update(zip(new, map(self._pairs, new, self.segmenter.encode(new, num_threads=1))))
        self.memory.update((r, f) for r, f in known.items() if len(r) <= self.LONGEST)
        if len(self.memory) > self.MOST:
            self.older, self.memory = self.memory, {}
        return known

    def encode_batch(self, texts: list[str], end: bool = False) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text the ids, and the span of source bytes (begin, end) of each."""
        normal = [self.normalise(t) for t in texts]
        runs = [self.runs.findall(n.decode()) for n, _ in normal]
        known = self._known(set().union(*runs))
        return [self._spans(b"".join(map(known.__getitem__, r)), align, end) for r, (_, align) in zip(runs, normal)]

    def encode(self, text: str, end: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.encode_batch([text], end)[0]

    def _spans(self, found: bytes, align: np.ndarray, end: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs = np.frombuffer(found, "<i4")
        ids, sizes = pairs[::2], pairs[1::2]
        until = np.cumsum(sizes)
        begins, ends = align[until - sizes], align[until]
        if not self.fallback and len(ids):
            ids, begins, ends = self._join_unknown(ids, begins, ends)
        if end:
            last = np.array([align[-1]], np.int32)
            ids, begins, ends = np.append(ids, np.int32(self.end_id)), np.append(begins, last), np.append(ends, last)
        return ids, begins, ends

    def _join_unknown(self, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbouring unknown pieces are one unknown piece."""
        keep = np.ones(len(ids), bool)
        keep[1:] = ~((ids[1:] == self.unknown) & (ids[:-1] == self.unknown))
        first = np.flatnonzero(keep)
        last = np.append(first[1:], len(ids)) - 1
        return ids[first], begins[first], ends[last]

    # Decoding

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids; bytes that are no UTF-8 become U+FFFD one by one."""
        surface = self.surface
        # Control ids have no surface; the first visible piece loses the prefix added on encoding.
        data = b"".join(map(surface.__getitem__, ids))
        if self.dummy_prefix or self.trims:
            data = self._without_prefix(ids, data)
        try:
            if self.controls.isdisjoint(ids[:-1]):
                return data.decode()
        except UnicodeDecodeError:
            pass
        return self._decode_stepwise(ids, data)

    def _decode_stepwise(self, ids: list[int], data: bytes) -> str:
        """As above, where a run of byte ids is no UTF-8 or is cut by a control id."""
        out, run = [], bytearray()
        cut = len(b"".join(map(self.surface.__getitem__, ids))) - len(data)
        for number in ids:
            if self.is_byte[number]:
                run += self.surface[number]
                continue
            out.append(_decode_bytewise(bytes(run)))
            run.clear()
            put = self.surface[number].decode()
            out.append(put[cut:])
            cut = max(0, cut - len(put))
        out.append(_decode_bytewise(bytes(run)))
        return "".join(out)

    def _without_prefix(self, ids: list[int], data: bytes) -> bytes:
        for number in ids:
            put = self.surface[number]
            if not put:
                continue
            if put.startswith(b" ") and not self.is_byte[number] and number != self.unknown:
                return data.lstrip(b" ") if self.trims else data[1:]
            return data
        return data


def _decode_bytewise(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        size = _char_length(data[at])
        try:
            char = data[at : at + size].decode()
            if len(char) != 1:
                raise ValueError
            out.append(char)
            at += size
        except ValueError:
            out.append("�")
            at += 1
    return "".join(out)


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """One codec per worker and file, with what it remembers."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def _encoded(batches: Iterator[pa.RecordBatch], model_file: str, end: bool) -> Iterator[pa.RecordBatch]:
    own = codec(model_file)
    for batch in slices(batches, 128, "text", 1 << 20):
        done = own.encode_batch(texts_of(batch, "text"), end)
        columns = [packed_ints([d[i] for d in done]) for i in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "ids", "begins", "ends"])


def _decoded(batches: Iterator[pa.RecordBatch], model_file: str) -> Iterator[pa.RecordBatch]:
    own = codec(model_file)
    for batch in slices(batches, 128):
        column = batch.column("ids")
        texts = [own.decode(v.values.to_numpy().tolist() if v.is_valid else []) for v in column]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])


def encode(docs: DataFrame, model_file: str, end: bool = True) -> DataFrame:
    """``doc_id``, ``ids`` and the byte spans ``begins`` and ``ends`` of every text.

    One pass without a shuffle. ``model_file`` is read by every worker and must be
    installed where the workers run.
    """
    return id_and_text(docs).mapInArrow(lambda batches: _encoded(batches, model_file, end), ENCODED)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """``doc_id``, ``ids`` and the ``decoded`` text; null ids decode to the empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _decoded(batches, model_file), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model_file: str) -> DataFrame:
    """Number and hash of the ids of every text, the hash of what they decode to, and the bytes the spans reach.

    Encoding and decoding share one pass through the workers.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _decoded(_encoded(batches, model_file, True), model_file):
            yield batch.select(["doc_id", "ids", "ends", "decoded"])

    return id_and_text(docs).mapInArrow(work, "doc_id long, ids array<int>, ends array<int>, decoded string").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.element_at("ends", -1).cast("long").alias("n_bytes"),
    )

"""SentencePiece merge-type encoding and decoding by backtracking.

A text is encoded left to right, chunk by chunk, since no piece of the model has a
space behind another character. An Aho-Corasick automaton over the vocabulary
lists, for every position, the pieces that start there. The longest is tried
first. A piece may follow another only if merging their joined text afresh gives
back exactly these two pieces; a sequence whose neighbours all agree in this way
is the one that the merge rule itself would give, so no global merge is run. A
position from which no piece works is struck from a bitfield and never tried
again, which keeps the search linear.

Exact for models with an identity normaliser, byte fallback and no
user-defined pieces; others are refused when loaded. Runs of spaces, whose pieces all
have one score so that the leftmost pair merges first, come out right because the
longest piece is tried first.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.chunks import ChunkMemo, split_chunks
from graphloom.llm.common import byte_slices, small_batches, text_or_empty

SPACE = "▁"


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, raw[at : at + n]
            at += n


def _kinds(model_file: str) -> tuple[set[int], int]:
    """The kinds of pieces in a model file (4: user-defined), and the model's (2: merges)."""
    with open(model_file, "rb") as f:
        fields = list(_fields(f.read()))
    pieces = {dict(_fields(v)).get(3, 1) for n, v in fields if n == 1}
    return pieces, next((dict(_fields(v)).get(3, 1) for n, v in fields if n == 2), 1)


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, model_file: str):
        kinds, model = _kinds(model_file)
        if model != 2 or 4 in kinds:
            raise ValueError("only models of merges without user-defined pieces can be used")
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        if sp.encode("a  b 　ﬁ", out_type=str) != sp.encode("a  b 　ﬁ".replace(" ", SPACE), out_type=str):
            raise ValueError("only models that keep white space and characters as they are can be used")
        self.control = [sp.is_control(i) for i in range(size)]
        self.byte = [int(self.pieces[i][3:5], 16) if sp.is_byte(i) else None for i in range(size)]
        self.byte_id = {b: i for i, b in enumerate(self.byte) if b is not None}
        if len(self.byte_id) != 256:
            raise ValueError("only models with byte fallback can be used")
        self.unknown, self.bos, self.eos = sp.unk_id(), sp.bos_id(), sp.eos_id()
        plain = [i for i in range(size) if not (self.control[i] or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id_of = {self.pieces[i]: i for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("only models whose pieces have spaces in front alone can be used")
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.automaton = ahocorasick.Automaton()
        for p in self.id_of:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.id_of))
        self.lines = not any("\n" in p and len(p) > 1 for p in self.id_of)
        self._agree: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """The merge rule itself: join the best-scored adjacent pair, leftmost
        first among equals, until no joined pair is a piece."""
        parts: list[str | None] = list(text)
        right = list(range(1, len(parts) + 1))
        left = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < len(parts) and (s := self.score.get(joined := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, joined))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or right[i] != j or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, None
            right[i] = right[j]
            if right[i] < len(parts):
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p is not None]

    def agree(self, a: str, b: str) -> bool:
        """Whether ``b`` may follow ``a`` (or stand first, for an empty ``a``)."""
        key = (a, b)
        known = self._agree.get(key)
        if known is None:
            known = self.merge(a + b) == ([a, b] if a else [b])
            if len(self._agree) >= 1_000_000:
                self._agree.clear()
            self._agree[key] = known
        return known

    def backtrack(self, text: str) -> list[str]:
        """Pieces of ``text``; a character outside the vocabulary is a piece by itself."""
        n = len(text)
        if n == 0:
            return []
        if (tiles := self._tiles(text)) is not None:
            return tiles
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, length in self.automaton.iter(text):
            if length > 1:
                starts[end + 1 - length].append(length)
        agree = self._agree
        failed = bytearray(n // 8 + 1)  # a bit for each position from which no piece works
        out: list[str] = []
        # chosen[k]: how many longer candidates than the kept one are left at piece k
        tries: list[int] = []
        pos, prev, at = 0, "", len(starts[0])
        while True:
            here = starts[pos]
            found = False
            while at >= 0:
                length = here[at - 1] if at else 1
                end = pos + length
                if not failed[end >> 3] >> (end & 7) & 1:
                    piece = text[pos:end]
                    ok = agree.get((prev, piece))
                    if ok if ok is not None else self.agree(prev, piece):
                        found = True
                        break
                at -= 1
            if found:
                out.append(piece)
                tries.append(at)
                if end == n:
                    return out
                pos, prev, at = end, piece, len(starts[end])
                continue
            if not out:
                return self.merge(text)
            failed[pos >> 3] |= 1 << (pos & 7)
            pos -= len(out.pop())
            at = tries.pop() - 1
            prev = out[-1] if out else ""

    def _tiles(self, text: str) -> list[str] | None:
        """The automaton's leftmost-longest matches, where they cover the text and
        all neighbours agree: the search above would end there without a step back."""
        out, prev, pos, agree = [], "", 0, self._agree
        for end, length in self.automaton.iter_long(text):
            if end + 1 - length != pos:
                return None
            pos = end + 1
            piece = text[pos - length : pos]
            ok = agree.get((prev, piece))
            if not (ok if ok is not None else self.agree(prev, piece)):
                return None
            out.append(piece)
            prev = piece
        return out if pos == len(text) else None

    def encode_chunk(self, text: str) -> list[int]:
        """Ids of a chunk in which spaces are already written as the space sign."""
        pieces = self.backtrack(text)
        ids: list[int] = []
        get = self.id_of.get
        for p in pieces:
            i = get(p)
            if i is None:
                ids.extend(self.byte_id[b] for b in p.encode("utf-8", "surrogatepass"))
            else:
                ids.append(i)
        return ids

    def encode(self, text: str, ends: bool = True) -> list[int]:
        """Ids of a whole text, with begin and end ids unless ``ends`` is false."""
        ids: list[int] = []
        if text:
            for chunk in self.chunks(text):
                ids += self.encode_chunk(chunk.replace(" ", SPACE))
        return [self.bos, *ids, self.eos] if ends else ids

    def chunks(self, text: str) -> list[str]:
        """Chunks with the leading space that the model puts before every text."""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        # where a piece may hold a line feed, the text is one chunk
        return [c for c in split_chunks(" " + text) if c] if self.lines else [" " + text]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ids: control ids vanish, runs of byte ids become characters
        (a replacement sign for each byte that is none), the space put before
        the text goes when ``first`` is set."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            b = self.byte[i]
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            if self.control[i]:
                continue
            out.append(" ⁇ " if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        if run:
            out.append(_utf8(run))
        text = "".join(out)
        lead = next((i for i in ids if not self.control[i]), None)
        return text[1:] if first and lead is not None and self.byte[lead] is None and self.pieces[lead].startswith(SPACE) else text


    def decode_array(self, ids: np.ndarray) -> str:
        """``decode`` of many ids at once: the pieces' bytes are gathered in one go."""
        if not hasattr(self, "_blob"):
            raw = [
                b"" if self.control[i] else " ⁇ ".encode() if i == self.unknown else bytes([self.byte[i]]) if self.byte[i] is not None else p.replace(SPACE, " ").encode()
                for i, p in enumerate(self.pieces)
            ]
            self._blob = np.frombuffer(b"".join(raw), np.uint8)
            self._sizes = np.array([len(r) for r in raw], np.int64)
            self._begins = np.cumsum(self._sizes) - self._sizes
        sizes = self._sizes[ids]
        total = np.cumsum(sizes)
        if not len(ids) or not total[-1]:
            return ""
        whole = self._blob[np.repeat(self._begins[ids] - (total - sizes), sizes) + np.arange(total[-1])].tobytes()
        try:
            text = whole.decode("utf-8")
        except UnicodeDecodeError:
            return self.decode(ids.tolist())
        lead = ids[int(np.argmax(sizes > 0))]
        return text[1:] if self.byte[lead] is None and self.pieces[lead].startswith(SPACE) else text


def _utf8(run: bytearray) -> str:
    """Each byte that starts no whole character gives one replacement sign."""
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(bytes(run[k : k + n]).decode("utf-8"))
                    k += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k += 1
        return "".join(out)


_CODECS: dict[str, tuple[PieceCodec, ChunkMemo]] = {}


def _codec(model_file: str) -> tuple[PieceCodec, ChunkMemo]:
    if model_file not in _CODECS:
        codec = PieceCodec(model_file)

        def compute(chunk: str) -> bytes:
            return array("I", codec.encode_chunk(chunk.replace(" ", SPACE))).tobytes()

        _CODECS[model_file] = codec, ChunkMemo(compute, 400_000)
    return _CODECS[model_file]


def encode_column(df: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """All columns of ``df`` plus ``piece_ids`` (array of int, with begin and end
    ids) and ``piece_text`` (the ids decoded). Null texts count as empty; an empty
    text has the begin and end ids only. A column of either name is replaced; the other
    columns come back as they are, whatever their types."""
    keep = [c for c in df.columns if c not in ("piece_ids", "piece_text")]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", piece_ids array<int>, piece_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, _ = _codec(model_file)
        for b in batches:
            for part in byte_slices(b, text):
                ids = [codec.encode(t or "") for t in part.column(text).to_pylist()]
                made = [pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(i) for i in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], [*keep, "piece_ids", "piece_text"])

    return small_batches(df).mapInArrow(run, schema)


def digest_column(df: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, ``n_tokens``, ``ids_sha256`` of the ids as little-endian
    32-bit integers and ``decoded_sha256`` of the decoded text.

    Rows are taken as they are: repeated keys give repeated rows, keys of any type and
    null ones come back unchanged, null texts count as empty, and an empty text has two
    ids (begin, end) and decodes to nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, memo = _codec(model_file)
        bos, eos = codec.bos.to_bytes(4, "little"), codec.eos.to_bytes(4, "little")
        for b in batches:
            counts, ids_sha, text_sha = [], [], []
            for t in b.column("_text"):
                t = t.as_py()
                ids = b"".join([bos, *map(memo.__getitem__, codec.chunks(t) if t else ()), eos])
                decoded = codec.decode_array(np.frombuffer(ids, "<u4"))
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                memo.trim()
            made = [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("_key"), *made], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return small_batches(df.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text"))).mapInArrow(
        run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )

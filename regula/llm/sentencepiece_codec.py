"""Offset-preserving SentencePiece encoding and decoding.

A text is normalised by the model's compiled character map: at each position
the longest prefix found in the map's trie is replaced, every produced byte
remembers the source byte it stems from, spaces become the model's space mark
and a dummy mark goes in front where the model asks for it.  The normalised
text is cut where no piece of the model can reach across: before a run of
space marks, and before a line feed if no piece of several characters holds
one.  Equal cuts have equal pieces, so a task keeps the pieces of the cuts it
has met (a bounded store) and the library's merge step runs on new ones only.
Piece lengths over the normalised text and its alignment give every piece's
byte span in the source.

Decoding joins the pieces by the same rules, from a per-piece table made once.

Defined results: a null text counts as empty: no pieces but the end id;
malformed bytes cannot occur in a string column; repeated rows give equal
results; an empty table gives an empty table; extra columns are ignored."""

from __future__ import annotations

import hashlib
import re
import struct
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regula.llm.text import slices

MARK = "▁"
#: cuts whose pieces a worker remembers before it starts afresh
STORE = 200_000
#: bytes of text that are taken apart at once: their cuts, alignments and spans
#: take some hundred times as much
SLICE_BYTES = 1 << 19


def _fields(blob: bytes):
    """(number, value) of each field of a serialised protocol message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = blob[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < len(blob):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, blob[at:at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, blob[at:at + n]
            at += n


@dataclass
class Rules:
    """The model's normaliser: the character map and its switches."""

    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    mark_spaces: bool = True

    @classmethod
    def of(cls, model: bytes) -> Rules:
        # Field numbers of the public model format.
        spec = next((v for n, v in _fields(model) if n == 3), b"")
        got = dict(_fields(spec))
        return cls(got.get(2, b""), bool(got.get(3, 1)), bool(got.get(4, 1)), bool(got.get(5, 1)))


class Normaliser:
    """Longest-prefix normalisation with source alignment."""

    def __init__(self, rules: Rules):
        self.rules = rules
        blob = rules.charsmap
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], dtype="<u4").tolist()
        self.targets = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """Length of the longest prefix at ``at`` that the map holds, and its
        target's offset; (0, 0) without one."""
        if not self.units:
            return 0, 0
        units, node, best = self.units, 0, (0, 0)
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                best = (i - at + 1, units[node] & 0x7FFFFFFF)
        return best

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text and, for each of its bytes and its end, the source byte."""
        source = text.encode()
        if not source:
            return "", np.zeros(1, np.int64)
        out, align, at = bytearray(), [], 0
        if not self.units:
            out, align = bytearray(source), np.arange(len(source) + 1)
        else:
            while at < len(source):
                n, target = self.longest(source, at)
                if n:
                    new = self.targets[target:self.targets.index(b"\0", target)]
                else:
                    lead = source[at]
                    n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                    new = source[at:at + n]
                out += new
                align += [at] * len(new)
                at += n
            align = np.array([*align, len(source)])
        return self._spaces(bytes(out), np.asarray(align, np.int64))

    def _spaces(self, data: bytes, align: np.ndarray) -> tuple[str, np.ndarray]:
        """Squeeze and mark spaces, add the dummy prefix; alignment follows."""
        rules = self.rules
        keep = np.ones(len(data), bool)
        raw = np.frombuffer(data, np.uint8)
        if rules.squeeze and len(raw):
            space = raw == 0x20
            keep[1:] = ~(space[1:] & space[:-1])
            words = np.flatnonzero(~space)
            if not len(words):
                return "", np.array([align[-1]])
            keep[:words[0]] = False
            keep[words[-1] + 1:] = False
        end = align[-1]
        raw, align = raw[keep], align[:-1][keep]
        mark = MARK.encode() if rules.mark_spaces else b" "
        times = np.where(raw == 0x20, len(mark), 1)
        text = raw.tobytes().replace(b" ", mark)
        align = np.repeat(align, times)
        if rules.dummy_prefix and len(text):
            text, align = mark + text, np.concatenate([np.full(len(mark), align[0]), align])
        return text.decode(), np.append(align, end)


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, model_path: str):
        with open(model_path, "rb") as f:
            blob = f.read()
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.rules = Rules.of(blob)
        self.normalise = Normaliser(self.rules)
        n = self.sp.get_piece_size()
        pieces = [self.sp.id_to_piece(i) for i in range(n)]
        # Piece kinds of the public format are asked of the library.
        self.byte = [int(p[3:5], 16) if self.sp.is_byte(i) else None for i, p in enumerate(pieces)]
        self.hidden = [self.sp.is_control(i) for i in range(n)]
        self.unknown = self.sp.unk_id()
        self.pieces = pieces
        normal = [p for i, p in enumerate(pieces) if self.byte[i] is None and not self.hidden[i] and i != self.unknown]
        # where no piece reaches across, the text may be cut
        self.can_cut = (self.rules.mark_spaces and self.rules.dummy_prefix and not self.rules.charsmap and not self.rules.squeeze
                        and not any(re.search(f"[^{MARK}]{MARK}", p) for p in normal))
        self.cut_lines = self.can_cut and not any("\n" in p for p in normal)
        line = "\n" if self.cut_lines else ""
        self._cut = re.compile(f"{MARK}+[^{MARK}{line}]*" + (f"|\n[^{MARK}\n]*" if line else "")) if self.can_cut else None
        self.mark_id = self.sp.piece_to_id(MARK)
        self.special = {i for i in range(n) if self.byte[i] is not None or self.hidden[i] or i == self.unknown}
        self.length = np.array([1 if b is not None else len(p.encode()) for p, b in zip(pieces, self.byte)], np.int64)
        self._ids: dict[str, str] = {}
        #: decoded text of the cuts that do not come back as they were
        self._surface: dict[str, str] = {}

    # -- encoding -------------------------------------------------------
    def learn(self, cuts) -> None:
        """Fill the store for these cuts: one call of the library for all new ones."""
        new = [c for c in dict.fromkeys(cuts) if c not in self._ids]
        if not new:
            return
        if len(self._ids) + len(new) > STORE:  # start afresh with what is needed now
            self._ids = {c: self._ids[c] for c in cuts if c in self._ids}
            self._surface = {c: self._surface[c] for c in self._ids if c in self._surface}
        plain = [c[1:].replace(MARK, " ") if c[0] == MARK else c for c in new]
        for cut, ids in zip(new, self.sp.encode(plain, num_threads=1)):
            # the library puts its dummy mark in front of whatever it is given
            # (nothing for an empty text); a cut at a line feed has none of its own
            ids = ([self.mark_id] if cut == MARK else ids) if cut[0] == MARK else ids[1:]
            self._ids[cut] = " ".join(map(str, ids))
            if (surface := self.surface(ids)) != cut.replace(MARK, " "):
                self._surface[cut] = surface

    def surface(self, ids) -> str:
        """Decoded text of ids, the dummy mark still in front: runs of byte
        pieces are read as UTF-8, each malformed byte as U+FFFD."""
        if self.special.isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
        out, run = [], bytearray()

        def flush():
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at:at + n]).decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("\ufffd")
                    at += 1
            run.clear()

        for i in ids:
            if self.byte[i] is not None:
                run.append(self.byte[i])
                continue
            flush()
            if self.hidden[i]:
                continue
            out.append(" \u2047 " if i == self.unknown else self.pieces[i].replace(MARK, " "))
        flush()
        return "".join(out)

    def decode(self, ids) -> str:
        text = self.surface(ids)
        return text[1:] if (self.rules.dummy_prefix or self.rules.squeeze) and text.startswith(" ") else text

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, str, str]]:
        """Per text: ids (no end id), each piece's byte span [begin, end) in the
        source, the ids in decimal joined by spaces, the text they decode to."""
        normal = [self.normalise(t) for t in texts]
        none = np.empty(0, np.int64)
        if self.can_cut:
            cuts = [self._cut.findall(n) for n, _ in normal]
            self.learn(list(chain.from_iterable(cuts)))
        out = []
        for i, (text, align) in enumerate(normal):
            if not text:
                out.append((none, none, none, "", ""))
                continue
            if self.can_cut:
                written = " ".join(map(self._ids.__getitem__, cuts[i]))
                ids = np.fromstring(written, np.int64, sep=" ")
                lengths = self.length[ids]
                if self._surface.keys().isdisjoint(cuts[i]):
                    decoded = text.replace(MARK, " ")
                else:
                    decoded = "".join([self._surface[c] if c in self._surface else c.replace(MARK, " ") for c in cuts[i]])
                decoded = decoded[1:] if decoded.startswith(" ") else decoded
            else:
                pieces = self.sp.encode(texts[i], return_type="proto").pieces
                ids = np.array([p.id for p in pieces], np.int64)
                lengths = np.array([len(p.piece.encode()) if self.byte[p.id] is None else 1 for p in pieces], np.int64)
                written, decoded = " ".join(map(str, ids)), self.decode(ids.tolist())
            ends = np.cumsum(lengths)
            out.append((ids, align[ends - lengths], align[ends], written, decoded))
        return out


_CODECS: dict[str, Codec] = {}


def codec(model_path: str) -> Codec:
    """One codec per worker and model file."""
    if model_path not in _CODECS:
        _CODECS[model_path] = Codec(model_path)
    return _CODECS[model_path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, the ids (end id last) and
    every piece's byte span in the source text; the end id has the empty span
    at the text's end.  Each text is encoded once, all columns stem from that."""
    frame = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = ("doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, "
              "ids array<int>, span_begin array<int>, span_end array<int>")

    def encode(batches):
        c = codec(model_path)
        for part in slices(batches, "text", SLICE_BYTES):
            texts = [t or "" for t in part.column("text").to_pylist()]
            found, end = c.encode(texts), c.sp.eos_id()
            last = [len(t.encode()) for t in texts]
            sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
            columns = [part.column("doc_id"), pa.array([len(f[0]) + 1 for f in found], pa.int64()),
                       pa.array([sha(f"{f[3]} {end}" if f[3] else str(end)) for f in found], pa.string()),
                       pa.array([sha(f[4]) for f in found], pa.string()),
                       _lists([np.append(f[0], end) for f in found]),
                       _lists([np.append(f[1], n) for f, n in zip(found, last)]),
                       _lists([np.append(f[2], n) for f, n in zip(found, last)])]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return frame.mapInArrow(encode, schema)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate(arrays).astype(np.int32) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text that an array of ids decodes to (null ids: empty)."""
    frame = encoded.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids"))

    def decode(batches):
        c = codec(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([c.decode(i or []) for i in part.column("ids").to_pylist()], pa.string())],
                    names=["doc_id", "text"])

    return frame.mapInArrow(decode, "doc_id bigint, text string")

"""SentencePiece (BPE kind) encoding and decoding with a merge-type prefix table.

For every prefix of a text the last token of its encoding is unique. Going left to right, the vocabulary entries that
end at a position are found by an automaton, longest first; entry t is that prefix's last token if the prefix before t
has a last token u and the pair (u, t) is compatible, that is, if merging the characters of u + t by rank gives back
exactly u and t. The ids are then read off backwards. No merge queue runs over the text.

The text is cut at places no vocabulary entry crosses (after a word, before its next blank mark; around characters that
stand in no longer entry), and each part's ids are kept in a bounded table of the worker.

Defined results: null and empty texts have no ids and decode to the empty text; characters outside the vocabulary become
their UTF-8 bytes' entries (or the unknown id where the model has none); repeated rows get the same ids; an empty
table gives an empty result; very long texts are taken whole.
"""

from __future__ import annotations

import re
import struct
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
LETTER = "[A-Za-zÀ-ÖØ-öø-ɏ]"
#: Parts kept by a worker in its newer table (only those met before, by a bit each); when it is full it becomes the older one, from which parts in use move back.
TABLE = 300_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 1:
            yield key >> 3, data[at : at + 8]
            at += 8
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        elif kind == 5:
            yield key >> 3, data[at : at + 4]
            at += 4
        else:
            raise ValueError("not a model file")


def read_model(path: str) -> dict:
    """Pieces, scores, kinds and the normaliser's switches of a model file."""
    pieces, switches, kind = [], {}, 1
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            piece, score, type_ = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    type_ = v
            pieces.append((piece, score, type_))
        elif number == 2:
            kind = dict(_fields(value)).get(3, 1)
        elif number == 3:
            switches = {n: v for n, v in _fields(value) if n in (1, 2, 3, 4, 5)}
    if kind != 2 or switches.get(2) or switches.get(4, 1) or any(t in (USER, UNUSED) for _, _, t in pieces):
        raise ValueError("only BPE models with the identity normaliser, all spaces kept, are read here")
    return {"pieces": pieces, "dummy": bool(switches.get(3, 1))}


class Known(dict):
    """Parts of texts and their ids as bytes; what is missing is worked out and kept."""

    def __init__(self, coder: Coder):
        super().__init__()
        self.coder, self.older, self.met = coder, {}, bytearray(1 << 22)

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            inner = self.coder.cut.findall(part)
            ids = b"".join(map(self.__getitem__, inner)) if len(inner) > 1 else self.coder.part_ids(part).tobytes() if part else b""
        slot = hash(part) & 0x3FFFFF
        if not self.met[slot]:
            self.met[slot] = 1
        elif len(part) <= 64:
            if len(self) >= TABLE:
                self.older, self.met = dict(self), bytearray(1 << 22)
                self.clear()
            self[part] = ids
        return ids


class Coder:
    """Encoder and decoder of one model; built once a worker."""

    def __init__(self, model: dict):
        self.dummy = model["dummy"]
        self.ids, self.score, self.bytes, self.surface = {}, {}, [None] * 256, []
        self.unknown = 0
        for i, (piece, score, kind) in enumerate(model["pieces"]):
            if kind == NORMAL:
                self.ids[piece], self.score[piece] = i, score
                self.surface.append(piece.replace(MARK, " ").encode())
            elif kind == BYTE:
                self.bytes[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            else:
                self.unknown = i if kind == UNKNOWN else self.unknown
                self.surface.append(" ⁇ ".encode() if kind == UNKNOWN else b"")
        self.is_byte = np.array([k == BYTE for _, _, k in model["pieces"]])
        self.names = [p for p, _, _ in model["pieces"]]
        self._automaton = None
        self.cut = self.parting()
        self.fits: dict[int, bool] = {}
        self.runs: dict[int, array] = {}
        self.known = Known(self)
        self.newline = self.cut is not None and not any("\n" in p for p in self.ids)

    @property
    def automaton(self):
        """Built when a text is first encoded; decoding does without."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for piece, i in self.ids.items():
                self._automaton.add_word(piece, (len(piece), i))
            self._automaton.make_automaton()
        return self._automaton

    def parting(self) -> re.Pattern | None:
        """Parts of a text that no vocabulary entry crosses; None where entries cross all the places tried."""
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            return None
        bodies = [b for p in self.ids if len(b := p.lstrip(MARK)) > 1]
        within = {c for b in bodies for c in b} | {p.lstrip(MARK) for p in self.ids if p.startswith(MARK)}
        alone = "".join(re.escape(c) for c in "\n\r\t" if c not in within)
        signs_of = {chr(c) for c in range(33, 127) if not chr(c).isalpha()}
        latin = re.compile(LETTER)
        behind = {y for p in bodies for x, y in zip(p, p[1:]) if latin.match(x) and y in signs_of}
        free = "".join(re.escape(c) for c in sorted(signs_of - behind))
        #: A word ends before a sign that no entry has behind a letter.
        word = f"{MARK}*{LETTER}+(?=[{free}{MARK}{alone}]|$)|" if free else ""
        return re.compile((f"[{alone}]|" if alone else "") + f"{word}{MARK}*[^{MARK}{alone}]+|{MARK}+", re.DOTALL)

    def merged(self, text: str) -> list[str]:
        """Merging by rank, leftmost first among equals: the definition, for pair tests on short texts."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the characters of entries a and b gives back a and b."""
        if len(self.fits) > 4 * TABLE:
            self.fits.clear()
        x, y = self.names[a], self.names[b]
        known = self.fits[a << 32 | b] = self.merged(x + y) == [x, y]
        return known

    def prefix_table(self, part: str) -> array | None:
        """Ids of a part by its prefix table; None if a character is not in the vocabulary."""
        n = len(part)
        last, size_at = [-1] * (n + 1), [0] * (n + 1)
        fits, done = self.fits, 0
        for end, (size, i) in self.automaton.iter(part):  # at each end the longest entry comes first
            end += 1
            if size_at[end]:
                continue
            start = end - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                known = fits.get(before << 32 | i)
                if not (self.compatible(before, i) if known is None else known):
                    continue
            last[end], size_at[end] = i, size
        out = array("i")
        at = n
        while at:
            if not size_at[at]:
                return None
            out.append(last[at])
            at -= size_at[at]
        out.reverse()
        return out

    def whole(self, part: str) -> array:
        """As prefix_table, with what is outside the vocabulary as bytes or the unknown id."""
        ids = self.prefix_table(part)
        if ids is None:
            ids, run = array("i"), ""
            for c in [*part, ""]:
                if c and c in self.ids:
                    run += c
                    continue
                if run:
                    ids.extend(self.prefix_table(run))
                    run = ""
                if c:
                    ids.extend((self.bytes[b] for b in c.encode("utf-8", "replace")) if self.bytes[0] is not None else [self.unknown])
        return ids

    def part_ids(self, part: str) -> array:
        lead = len(part) - len(part.lstrip(MARK))
        if lead < 2:
            ids = self.whole(part)
        elif lead == len(part):
            ids = self.marks(lead)
        else:  # entries of marks alone rank below all others: the last mark goes with the word wherever an entry wants it
            ids = self.whole(part[lead - 1 :])
            ids = self.marks(lead) + ids[1:] if self.names[ids[0]] == MARK else self.marks(lead - 1) + ids
        return ids

    def marks(self, n: int) -> array:
        """A run of blank marks: entries of one rank, so the order of merging decides. Merged by definition, with the pairs in a
        heap by rank and place, so that the work is in proportion to the run."""
        known = self.runs.get(n)
        if known is not None:
            return known
        after, before, size = [*range(1, n + 1)], [*range(-1, n - 1)], [1] * n
        heap: list[tuple[float, int, int]] = []

        def push(k: int) -> None:
            if k >= 0 and after[k] < n and (s := self.score.get(MARK * (size[k] + size[after[k]]))) is not None:
                heappush(heap, (-s, k, size[k] + size[after[k]]))

        for k in range(n):
            push(k)
        while heap:
            _, k, whole = heappop(heap)
            if not size[k] or after[k] >= n or size[k] + size[after[k]] != whole:
                continue  # one of the pair has been merged meanwhile
            gone = after[k]
            size[k], size[gone], after[k] = whole, 0, after[gone]
            if after[k] < n:
                before[after[k]] = k
            push(before[k])
            push(k)
        ids = array("i", [self.ids[MARK * x] for x in size if x])
        if len(self.runs) < 1000:
            self.runs[n] = ids
        return ids

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids as 32-bit integers."""
        if not text:
            return b""
        text = (" " if self.dummy else "") + text
        if self.cut is None:
            return self.part_ids(text.replace(" ", MARK)).tobytes()
        if "  " in text or MARK in text:
            return b"".join(map(self.known.__getitem__, self.cut.findall(text.replace(" ", MARK))))
        # no two marks stand together: every blank starts a part, and newlines stand alone
        parts = text.replace(" ", f" {MARK}").replace("\n", " \n ").split(" ") if self.newline else text.replace(" ", f" {MARK}").split(" ")
        return b"".join(map(self.known.__getitem__, parts))

    def encode(self, text: str | None) -> array:
        return array("i", self.encode_bytes(text))

    def decode(self, ids) -> str:
        ids = np.asarray(ids, dtype=np.int64)
        raw = b"".join(map(self.surface.__getitem__, ids.tolist()))
        first = len(ids) and self.surface[ids[0]].startswith(b" ") and not self.is_byte[ids[0]]
        if self.dummy and first and self.surface[ids[0]] != " ⁇ ".encode():
            raw = raw[1:]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return _bytewise(raw)


def _bytewise(raw: bytes) -> str:
    """UTF-8 with every byte that belongs to no character replaced on its own."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_coders: dict[int, Coder] = {}


def _coder(shared) -> Coder:
    key = id(shared.value["pieces"])
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(shared.value)
    return _coders[key]


def model_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``id_col, out array<int>`` of every whole text; with ``decoded`` also a column of that name with the ids decoded again,
    in the same worker. The model is read once, by the driver; its size is that of a vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model_path(path)))
    names = [id_col, out, *([decoded] if decoded else [])]

    def run(batches):
        coder = _coder(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                coded = [coder.encode_bytes(text) for text in part.column(1).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in coded]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), np.int32)))
                columns = [part.column(0), lists]
                if decoded:
                    columns.append(pa.array([coder.decode(np.frombuffer(x, np.int32)) for x in coded], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, `{out}` array<int>" + (f", `{decoded}` string" if decoded else "")
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``id_col, ids_col, out string``. Null ids decode to the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_model(model_path(path)))

    def run(batches):
        coder = _coder(shared)
        for batch in batches:
            texts = [coder.decode(x.values.to_numpy(zero_copy_only=False) if x.is_valid else []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [id_col, ids_col, out])

    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {dict(encoded.dtypes)[id_col]}, `{ids_col}` array<int>, `{out}` string")

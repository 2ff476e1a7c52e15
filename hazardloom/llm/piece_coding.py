"""SentencePiece encoding and decoding, by merges or by a max-plus parallel scan.

A BPE model's ids come from merges (:class:`MergeModel`). No merge crosses a place that no piece spans, so texts are
cut there and each distinct unit between is merged once by the library; giant texts are cut into chunks at such places.

A unigram model's best segmentation maximises the sum of piece scores over its lattice (on request, a model file of another
type lends its pieces and scores). Giant texts are split into chunks. A
chunk's transfer matrix holds, for each number of characters that a piece from the left reaches into
it and each number that its own last piece reaches beyond it, the best score between. Matrices combine
by max-plus products, which are associative: those of a block of chunks first, block by block in parallel, then
the blocks', and on the way back the blocks' boundary states give those of their chunks. Every chunk is then backtraced on
its own. Scores are multiples of 2**-24, so their sums are exact in any order, and where two best paths cross a
boundary apart, that is seen: such a text is traced whole, so ids never depend on the chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blobs import small_batches
from .common import cut, numbered, shuffle_width
from .text_arrays import text_bytes, text_slices

#: characters of one chunk, and chunks of one block
CHUNK, BLOCK = 32_768, 64
#: an unknown character scores this much less than the lowest piece
UNKNOWN_PENALTY = 10.0
SPACE = "▁"
#: units that a task remembers
MEMO = 700_000
#: model types of a model file
UNIGRAM, BPE = 1, 2


class PieceModel:
    """Pieces, scores and normaliser of a model file, with tables for cutting texts where no piece spans."""

    most = MEMO

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.processor = p = SentencePieceProcessor(model_file=path)
        plain = [i for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.ids = {p.id_to_piece(i): i for i in plain}
        self.scores = {s: _exact(p.get_score(i)) for s, i in self.ids.items()}
        self.unknown = _exact(min(self.scores.values()) - UNKNOWN_PENALTY)
        #: what the normaliser puts before a text, and decoding takes off again
        self.prefix = SPACE if p.normalize("a") == SPACE + "a" else ""
        self.bytes = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown_id, self.has_bytes = p.unk_id(), p.is_byte(self.bytes[0])
        self.starts = {s[:n] for s in self.ids for n in range(1, len(s) + 1)}
        self.reach = max(map(len, self.ids))
        self._cuts(self.ids)
        self._clear()

    def _cuts(self, pieces: Iterable[str]) -> None:
        """The neighbours that a piece holds, by characters and by bytes."""
        self.inside = {s[i : i + 2] for s in pieces for i in range(len(s) - 1)}
        #: no piece holds a blank behind another character: a word always begins at its blanks
        self.blanks_lead = not any(s[1] == SPACE != s[0] for s in self.inside)
        self.byte_pairs = np.zeros(1 << 16, bool)
        for s in pieces:
            raw = np.frombuffer(s.encode(), np.uint8).astype(np.int64)
            self.byte_pairs[(raw[:-1] << 8) | raw[1:]] = True

    def _clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.first, self.count, self.worth = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14)
        self.used = 0

    def normal(self, text: str) -> str:
        return self.processor.normalize(text)

    def matches(self, text: str, at: int) -> Iterator[tuple[int, float]]:
        """(length, score) of the pieces that begin at ``at``; a character without a piece is unknown."""
        one = False
        for n in range(1, min(self.reach, len(text) - at) + 1):
            part = text[at : at + n]
            if part not in self.starts:
                break
            score = self.scores.get(part)
            if score is not None:
                one |= n == 1
                yield n, score
        if not one:
            yield 1, self.unknown

    def ids_of(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        return [self.bytes[b] for b in piece.encode()] if self.has_bytes else [self.unknown_id]

    def trace(self, text: str, entry: int, end: int) -> tuple[list[int], float]:
        """Ids and score of the best path of ``text`` from ``entry`` to exactly ``end``; the longer last piece wins ties."""
        low, starts, scores, reach = float("-inf"), self.starts, self.scores, self.reach
        best, back = [low] * (end + 1), [0] * (end + 1)
        best[entry] = 0.0
        for i in range(entry, end):
            here = best[i]
            if here == low:
                continue
            if text[i] not in scores and here + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1] = here + self.unknown, i
            for j in range(i + 1, min(i + reach, end) + 1):
                part = text[i:j]
                if part not in starts:
                    break
                score = scores.get(part)
                if score is not None and here + score > best[j]:
                    best[j], back[j] = here + score, i
        ids, at = [], end
        while at > entry:
            ids.append(self.ids_of(text[back[at] : at]))
            at = back[at]
        return [i for part in reversed(ids) for i in part], best[end]

    def units(self, text: str) -> list[str]:
        """``text`` cut wherever no piece holds both neighbours."""
        out, start, inside = [], 0, self.inside
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in inside or (text[i] == SPACE != text[i - 1] and self.blanks_lead):
                out.append(text[start:i])
                start = i
        out.append(text[start:])
        return out

    def code(self, units: list[str]) -> list[tuple[list[int], float]]:
        """(ids, score) of units."""
        return [self.trace(u, 0, len(u)) for u in units]

    def learn(self, units: list[str]) -> None:
        """Code units that are not yet remembered."""
        new = [u for u in dict.fromkeys(units) if u not in self.memo]
        if not new:
            return
        made = self.code(new)
        count = np.array([len(ids) for ids, _ in made], np.int64)
        n, used = len(self.memo), self.used + int(count.sum())
        self.flat = _room(self.flat, used)
        self.first, self.count, self.worth = (_room(x, n + len(new)) for x in (self.first, self.count, self.worth))
        self.flat[self.used : used] = [i for ids, _ in made for i in ids]
        self.first[n : n + len(new)] = self.used + np.cumsum(count) - count
        self.count[n : n + len(new)] = count
        self.worth[n : n + len(new)] = [score for _, score in made]
        self.used = used
        self.memo.update(zip(new, range(n, n + len(new))))

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all normalised texts, offsets of the texts in them, scores): each distinct unit is coded once."""
        flat, offsets = text_bytes(pa.array(texts, pa.large_string()))
        n = len(flat)
        start = np.zeros(n + 1, bool)
        if n:
            left, right = flat[:-1].astype(np.int64), flat[1:]
            start[1:n] = ~self.byte_pairs[(left << 8) | right] & ((right & 0xC0) != 0x80)
            if self.blanks_lead and n > 3:
                blank = np.zeros(n, bool)
                blank[:-2] = (flat[:-2] == 0xE2) & (flat[1:-1] == 0x96) & (flat[2:] == 0x81)
                start[3:n] |= blank[3:] & ~blank[:-3]
                start[:3] |= blank[:3]
        start[offsets] = True
        start[n] = False
        at = np.flatnonzero(start)
        units = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, n).astype(np.int64)), pa.py_buffer(flat)).dictionary_encode()
        distinct = units.dictionary.to_pylist()
        if len(self.memo) + len(distinct) > self.most:
            self._clear()
        self.learn(distinct)
        rank = np.array([self.memo[u] for u in distinct], np.int64)[units.indices.to_numpy()] if len(at) else np.zeros(0, np.int64)
        count = self.count[rank]
        before, worth = np.zeros(len(rank) + 1, np.int64), np.zeros(len(rank) + 1)
        np.cumsum(count, out=before[1:])
        ids = self.flat[np.repeat(self.first[rank] - before[:-1], count) + np.arange(before[-1])]
        bounds = np.searchsorted(at, offsets)
        scores = np.array([self.worth[rank[a:z]].sum() for a, z in zip(bounds[:-1], bounds[1:])])
        return ids, before[bounds], scores

    def _spans(self, text: str, size: int) -> tuple[list[str], int, int]:
        """(units between, first cut, last cut) of the first ``size`` characters; cuts are equal where there are none."""
        units = self.units(text)
        ends = np.cumsum([len(u) for u in units])
        inner = ends[:-1][ends[:-1] <= size]
        if len(inner) < 2:
            return [], 0, 0
        return units[1 : len(inner)], int(inner[0]), int(inner[-1])

    def _steps(self, text: str, begin: int, end: int, best: np.ndarray) -> None:
        """Fill ``best`` (position, reach in) from ``begin``; pieces may begin before ``end`` only."""
        for i in range(begin, end):
            here = best[i]
            if np.isneginf(here).all():
                continue
            for n, score in self.matches(text, i):
                if i + n < len(best):
                    np.maximum(best[i + n], here + score, out=best[i + n])

    def transfer(self, text: str, size: int) -> np.ndarray:
        """Max-plus matrix of a chunk of ``size`` characters (``text`` looks ahead beyond it): [reach in, reach out].

        All paths meet at a cut, so between the first and the last one the sum of the units' scores will do.
        """
        s = self.reach
        units, first, last = self._spans(text, size)
        best = np.full((size + s, s), -np.inf)
        best[np.arange(min(s, len(best))), np.arange(min(s, len(best)))] = 0.0
        if last > first:
            self._steps(text, 0, first, best[: first + 1])
            self.learn(units)
            best[last] = best[first] + sum(self.worth[self.memo[u]] for u in units)
            self._steps(text, last, size, best)
        else:
            self._steps(text, 0, size, best)
        return best[size : size + s].T.copy()

    def backtrace(self, text: str, size: int, entry: int, leave: int) -> tuple[list[int], float]:
        """The best path of a chunk between its boundary states."""
        units, first, last = self._spans(text, size)
        if not (last > first >= entry):
            return self.trace(text, entry, size + leave)
        head, a = self.trace(text[:first], entry, first)
        tail, b = self.trace(text[last:], 0, size + leave - last)
        self.learn(units)
        at = [self.memo[u] for u in units]
        middle = [i for k in at for i in self.flat[self.first[k] : self.first[k] + self.count[k]].tolist()]
        return head + middle + tail, a + float(sum(self.worth[k] for k in at)) + b

    def chunks(self, text: str, chunk: int) -> list[tuple[int, str]]:
        """(size, text) of each chunk; the text looks ahead as far as a piece can reach."""
        return [(min(chunk, len(text) - c), text[c : c + chunk + self.reach]) for c in range(0, max(1, len(text)), chunk)]

    def _piece_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all pieces in id order, their offsets); control pieces have none."""
        if not hasattr(self, "_table"):
            p, raw = self.processor, []
            for i in range(p.get_piece_size()):
                raw.append(bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else b"" if p.is_control(i) else p.id_to_piece(i).encode())
            self._table = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        return self._table

    def texts_of(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The normalised texts that rows of ids (offsets ``at``) stand for."""
        flat, offsets = self._piece_bytes()
        first, size = offsets[ids], offsets[ids + 1] - offsets[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        out = flat[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])]
        return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(ends[at].astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


    def restored(self, decoded: pa.Array, first: pa.Array) -> pa.Array:
        """``decoded`` as the library's decoder gives it: blanks for their marks, without the prefix in a text's ``first`` chunk."""
        bare = pc.and_(first, pc.starts_with(decoded, self.prefix))
        return pc.replace_substring(pc.if_else(bare, pc.utf8_slice_codeunits(decoded, len(self.prefix)), decoded), SPACE, " ")


class MergeModel(PieceModel):
    """A model whose own encoder is not the lattice's: its ids are the library's, unit by unit.

    The library merges about as fast as units are looked up, so few are remembered. Without byte pieces it joins neighbouring unknown characters into one id, and types other than BPE do not merge: there a text is one unit.
    """

    most = 150_000

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        super().__init__(path)
        with open(path, "rb") as f:
            raw = f.read()
        #: normalizer_spec without character map, prefix, trimming and escapes: units are normalised already
        self.merger = SentencePieceProcessor(model_proto=raw + b"\x1a\x08\x12\x00\x18\x00\x20\x00\x28\x00")
        p = self.processor
        self.whole = _kind(raw) != BPE or not self.has_bytes
        self._cuts([*self.ids, *(p.id_to_piece(i) for i in range(p.get_piece_size()) if p.is_unused(i))])  # unused pieces take part in merges
        if self.whole:
            self.byte_pairs[:], self.blanks_lead = True, False
        self.worths = np.array([p.get_score(i) for i in range(p.get_piece_size())])
        if self.has_bytes:
            self.worths[self.bytes] = [0.0 if b & 0xC0 == 0x80 else self.unknown for b in range(256)]
        self.worths[self.unknown_id] = self.unknown

    def code(self, units: list[str]) -> list[tuple[list[int], float]]:
        return [(ids, float(self.worths[ids].sum()) if ids else 0.0) for ids in self.merger.encode(units, num_threads=1)]

    def chunks(self, text: str, chunk: int) -> list[tuple[int, str]]:
        """Chunks begin at the first cut from each multiple of ``chunk`` on; one that a unit covers is empty."""
        at = [0]
        for c in range(chunk, len(text), chunk):
            i = max(c, at[-1])
            while i < len(text) and (self.whole or (text[i - 1 : i + 1] in self.inside and not (text[i] == SPACE != text[i - 1] and self.blanks_lead))):
                i += 1
            at.append(i)
        return [(z - a, text[a:z]) for a, z in zip(at, [*at[1:], len(text)])]


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        x = shift = 0
        while True:
            at += 1
            x |= (raw[at - 1] & 127) << shift
            if raw[at - 1] < 128:
                return x
            shift += 7

    while at < len(raw):
        field, kind = divmod(number(), 8)
        if kind == 0:
            yield field, number()
        else:
            n = {1: 8, 5: 4}.get(kind) or number()
            at += n
            yield field, raw[at - n : at]


def _kind(raw: bytes) -> int:
    """The model type of a model file (trainer_spec.model_type)."""
    return ([UNIGRAM] + [v for f, spec in _fields(raw) if f == 2 for g, v in _fields(spec) if g == 3])[-1]  # of repeated fields the last counts


def maps_characters(path: str) -> bool:
    """Whether the normaliser has a character map, and may lengthen a text by more than its prefix."""
    with open(path, "rb") as f:
        return any(g == 2 and v for n, spec in _fields(f.read()) if n == 3 for g, v in _fields(spec))


def merges(path: str) -> bool:
    """Whether the model's own encoder is another than the lattice's."""
    with open(path, "rb") as f:
        return _kind(f.read()) != UNIGRAM


def _exact(score: float) -> float:
    """The nearest multiple of 2**-24: a file's scores are such already, but for tiny ones."""
    return round(score * 2.0**24) / 2.0**24


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two transfer matrices."""
    return np.max(a[:, :, None] + b[None, :, :], axis=1)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The product of neighbouring matrices, by pairs."""
    while len(matrices) > 1:
        matrices = [max_plus(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def boundary_states(matrices: list[np.ndarray], entry: int = 0, leave: int = 0) -> tuple[list[int], bool]:
    """(reach at each boundary on the best path from reach ``entry`` to reach ``leave``, both included; whether no other is as good)."""
    reached = [np.where(np.arange(len(matrices[0])) == entry, 0.0, -np.inf)]
    for m in matrices[:-1]:
        reached.append(np.max(reached[-1][:, None] + m, axis=0))
    states, sure = [leave], True
    for at in range(len(matrices) - 1, 0, -1):
        total = reached[at] + matrices[at][:, states[-1]]
        states.append(int(np.argmax(total)))
        sure &= int((total == total[states[-1]]).sum()) == 1
    return [entry, *reversed(states)], bool(sure)


_MODELS: dict[tuple[str, bool], PieceModel] = {}


def _model(path: str, own: bool = False) -> PieceModel:
    return _MODELS.get((path, own)) or _MODELS.setdefault((path, own), (MergeModel if own else PieceModel)(path))


CHUNKS = "rid long, doc_id long, chunk int, chunks int, size int, text string, source binary, ids binary, score double"
CODED = "rid long, doc_id long, chunk int, chunks int, ids binary, score double, text string, source binary"


def _digest(*texts: str) -> bytes:
    """Digest of the texts joined."""
    made = hashlib.sha256()
    for t in texts:
        made.update(t.encode())
    return made.digest()


def _split(path: str, chunk: int, own: bool, long: bool = False):
    """Chunks of texts, with the ids of those of one chunk; or (``long``) only the chunks of texts of several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path, own)
        for batch in batches:
            for a, z in text_slices(batch.column(2), 2 << 20):
                part = batch.slice(a, z - a)
                sources = [t or "" for t in part.column(2).to_pylist()]
                texts = [model.normal(t) for t in sources]
                ids, at, scores = model.encode_batch([t if len(t) <= chunk and not long else "" for t in texts])
                raw = ids.astype("<u4", copy=False).tobytes()
                rows: list[list] = [[] for _ in range(9)]
                for i, (rid, doc, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts)):
                    if long and len(text) <= chunk:
                        continue
                    pieces, source = model.chunks(text, chunk), _digest(sources[i])
                    for c, (size, piece) in enumerate(pieces):
                        whole = (raw[4 * at[i] : 4 * at[i + 1]], float(scores[i])) if len(pieces) == 1 else (None, None)
                        for column, value in zip(rows, (rid, doc, c, len(pieces), size, piece, source, *whole)):
                            column.append(value)
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=[f.split()[0] for f in CHUNKS.split(", ")])

    return run


def _merged(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path, True)
        for batch in batches:
            for a, z in text_slices(batch.column("text"), 2 << 20):
                part = batch.slice(a, z - a)
                found, at, scores = model.encode_batch(part.column("text").to_pylist())
                raw = found.astype("<u4", copy=False).tobytes()
                ids = pa.array([raw[4 * i : 4 * j] for i, j in zip(at[:-1], at[1:])], pa.binary())
                columns = [part.column(c) for c in ("rid", "doc_id", "chunk", "chunks")]
                yield pa.RecordBatch.from_arrays([*columns, ids, pa.array(scores, pa.float64()), part.column("text"), part.column("source")], names=[f.split()[0] for f in CODED.split(", ")])

    return run


def _transfers(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            text, size = batch.column("text").to_pylist(), batch.column("size").to_pylist()
            made = [model.transfer(t, s).tobytes() for t, s in zip(text, size)]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("chunk"), pa.array(made, pa.binary())], names=["rid", "chunk", "matrix"])

    return run


def _matrices(table: pa.Table) -> tuple[pa.Table, list[np.ndarray]]:
    table = table.combine_chunks().sort_by("chunk")
    flat = [np.frombuffer(m) for m in table.column("matrix").to_pylist()]
    side = int(round(len(flat[0]) ** 0.5))
    return table, [m.reshape(side, side) for m in flat]


def _block_product(table: pa.Table) -> pa.Table:
    table, matrices = _matrices(table)
    return pa.table({"rid": table.column("rid")[:1], "chunk": table.column("block")[:1], "matrix": pa.array([product(matrices).tobytes()], pa.binary())})


def _block_states(table: pa.Table) -> pa.Table:
    table, matrices = _matrices(table)
    states, sure = boundary_states(matrices)
    return pa.table({"rid": table.column("rid"), "block": table.column("chunk"), "enter": pa.array(states[:-1], pa.int32()), "leave": pa.array(states[1:], pa.int32()), "sure": pa.array([sure] * len(matrices))})


def _chunk_states(table: pa.Table) -> pa.Table:
    table, matrices = _matrices(table)
    states, sure = boundary_states(matrices, *(table.column(c)[0].as_py() for c in ("enter", "leave")))
    whole = pa.array([sure and table.column("sure")[0].as_py()] * len(matrices))
    return pa.table({"rid": table.column("rid"), "chunk": table.column("chunk"), "entry": pa.array(states[:-1], pa.int32()), "exit": pa.array(states[1:], pa.int32()), "sure": whole})


def chunk_states(matrices: DataFrame) -> DataFrame:
    """(rid, chunk, entry, exit, sure) of chunks (rid, chunk, matrix): up a tree of two levels by products, and down again."""
    blocks = matrices.withColumn("block", F.floor(F.col("chunk") / BLOCK).cast("int"))
    tops = blocks.groupBy("rid", "block").applyInArrow(_block_product, "rid long, chunk int, matrix binary")
    between = tops.groupBy("rid").applyInArrow(_block_states, "rid long, block int, enter int, leave int, sure boolean")
    return blocks.join(between, ["rid", "block"]).groupBy("rid", "block").applyInArrow(_chunk_states, "rid long, chunk int, entry int, exit int, sure boolean")


def _whole(path: str):
    """A text of several chunks traced at once, as its first chunk; the others are empty."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("chunk")
        n = table.num_rows
        text = "".join(t[:size] for t, size in zip(table.column("text").to_pylist(), table.column("size").to_pylist()))
        ids, score = _model(path).trace(text, 0, len(text))
        none, facts = [b""] * (n - 1), [table.column(c) for c in ("rid", "doc_id", "chunk", "chunks")]
        made = [pa.array([np.array(ids, "<u4").tobytes(), *none], pa.binary()), pa.array([score, *[0.0] * (n - 1)]), pa.array([text, *[""] * (n - 1)], pa.string())]
        return pa.table([*facts, *made, table.column("source")], names=[f.split()[0] for f in CODED.split(", ")])

    return run


def _backtrace(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            ids, scores, texts = [], [], []
            for text, size, entry, leave in zip(*(batch.column(c).to_pylist() for c in ("text", "size", "entry", "exit"))):
                found, score = model.backtrace(text, size, entry, leave)
                ids.append(np.array(found, "<u4").tobytes())
                scores.append(score)
                texts.append(text[entry : size + leave])
            columns = [batch.column(c) for c in ("rid", "doc_id", "chunk", "chunks")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary()), pa.array(scores, pa.float64()), pa.array(texts, pa.string()), batch.column("source")], names=[f.split()[0] for f in CODED.split(", ")])

    return run


def _coded(docs: DataFrame, model: str, id_col: str, text_col: str, chunk: int, own: bool) -> tuple[DataFrame, DataFrame]:
    """(texts of one chunk, chunks of longer ones), coded."""
    small_batches(docs.sparkSession)
    base = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).select("rid", "doc_id", "text")
    own = own and merges(model)
    parts = base.mapInArrow(_split(model, chunk, own), CHUNKS)
    whole = parts.where("chunks = 1").select("rid", "doc_id", "chunk", "chunks", "ids", "score", "text", "source")
    # a normaliser without a map adds its prefix alone; any other is asked for every text
    likely = base if maps_characters(model) else base.where(F.char_length("text") >= chunk - 64)
    giant = cut(likely.mapInArrow(_split(model, chunk, own, long=True), CHUNKS).where("chunks > 1").drop("ids", "score").repartition(shuffle_width(docs.sparkSession), "rid", "chunk"))
    if own:
        return whole, giant.mapInArrow(_merged(model), CODED)
    matrices = cut(giant.select("rid", "chunk", "size", "text").mapInArrow(_transfers(model), "rid long, chunk int, matrix binary"))
    states = cut(chunk_states(matrices))
    torn = states.where(~F.col("sure")).select("rid").distinct()
    traced = giant.join(torn, "rid", "left_anti").join(states.drop("sure"), ["rid", "chunk"]).mapInArrow(_backtrace(model), CODED)
    return whole, traced.union(giant.join(torn, "rid", "left_semi").groupBy("rid").applyInArrow(_whole(model), CODED))


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, own: bool = False) -> DataFrame:
    """Ids of all rows by chunk: rid, doc_id, chunk, chunks, ids (little-endian unsigned 32-bit), score, text, source.

    By the best path, or with ``own`` by the model's own type: then the ids are those that the library gives the row.
    ``text`` is the normalised text that the chunk's ids cover, ``source`` the SHA-256 of the row's whole text before normalising; of equally good
    paths the one is taken whose last piece is longest, then the last but one, and so on, whatever the chunks; ids and texts of a row's chunks join in
    order. A null or empty text is one chunk without ids and score 0; a null id stays null; repeated rows are coded apart; an empty
    table gives no rows; columns other than id and text are not read. Only texts of over ``chunk`` characters are
    shuffled, a chunk at a time; the matrices (2 kB a chunk) of a block of chunks meet in one task, and one for each block of a row.
    """
    whole, traced = _coded(docs, model, id_col, text_col, chunk, own)
    return whole.union(traced)


def decode_documents(coded: DataFrame, model: str) -> DataFrame:
    """``coded`` with decoded, the normalised text that each chunk's ids stand for, and restored, the same with the normaliser's marks undone.

    The restored chunks of a row join to what the library decodes its ids to.
    """
    schema = T.StructType([*coded.schema.fields, T.StructField("decoded", T.StringType()), T.StructField("restored", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _model(model)
        for batch in batches:
            for a, z in text_slices(batch.column("ids"), 1 << 20):
                part = batch.slice(a, z - a)
                raw = part.column("ids").to_pylist()
                ids = np.frombuffer(b"".join(x for x in raw if x), "<u4").astype(np.int64)
                made = held.texts_of(ids, np.concatenate([[0], np.cumsum([len(x) // 4 if x is not None else 0 for x in raw])]))
                plain = held.restored(made, pc.equal(part.column("chunk"), 0))
                yield pa.RecordBatch.from_arrays([*part.columns, made, plain], names=[*batch.schema.names, "decoded", "restored"])

    return coded.mapInArrow(run, schema)


def _joined(table: pa.Table) -> pa.Table:
    """Chunks of one row with round_trip: all are there, and joined they have the source's digest."""
    table = table.combine_chunks().sort_by("chunk")
    good = table.column("chunk").to_pylist() == list(range(table.column("chunks")[0].as_py())) and _digest(*table.column("restored").to_pylist()) == table.column("source")[0].as_py()
    return table.drop_columns(["restored", "source"]).append_column("round_trip", pa.array([good] * len(table), pa.bool_()))


def round_trips(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, own: bool = True) -> DataFrame:
    """A row for each chunk: doc_id, chunk, chunks, n_ids, ids_crc32, score, round_trip.

    ``round_trip`` holds for all chunks of a row or for none: whether the row's ids decode to its text as it was before normalising (a null counts
    as empty). The decoded chunks of a text of over ``chunk`` characters meet in one task, as its characters did in the input.
    """
    facts = ["doc_id", "chunk", "chunks", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), "score"]
    whole, giant = (decode_documents(x.drop("text"), model) for x in _coded(docs, model, id_col, text_col, chunk, own))
    giant = giant.select("rid", *facts, "restored", "source").groupBy("rid").applyInArrow(_joined, "rid long, doc_id long, chunk int, chunks int, n_ids long, ids_crc32 long, score double, round_trip boolean")
    return whole.select(*facts, (F.unhex(F.sha2("restored", 256)) == F.col("source")).alias("round_trip")).union(giant.drop("rid"))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_piece_coding(spark, sf_dir: str) -> DataFrame:
    """Every text coded and decoded again, a row for each chunk."""
    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())

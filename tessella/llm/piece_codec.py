"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by piece score (ties: leftmost first), merges the best
pair, and adds the pairs that the merge creates. A normalised text is first cut where no vocabulary piece can span, and
each distinct chunk of a slice of a batch is encoded once. The agendas of the chunks of one length are rows of a matrix:
the best pair of every row is merged at once. Nothing is kept from slice to slice. All ids and all decoded texts of each
slice are compared with the sentencepiece library's; a difference raises.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import lean, ship, slices, without

SPACE = "▁"
MARK = SPACE.encode()
#: Chunks of so many characters at most are rows of a matrix of agendas; longer ones have a heap each.
SHORT = 40
#: Characters that are encoded together, unless one text has more.
SLICE_CHARS = 2_000_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, model_path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.lib, n = lib, lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(n)]
        if any(lib.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces are not supported")
        self.ids = {p: i for i, p in enumerate(names) if not special[i]}
        self.scores = {p: lib.get_score(i) for p, i in self.ids.items() if len(p) > 1}
        self.unk = lib.unk_id()
        self.bos, self.eos = lib.bos_id(), lib.eos_id()
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(names) if lib.is_byte(i)}
        # What each id stands for when decoding; control pieces stand for nothing.
        self.out = [
            bytes([int(p[3:5], 16)]) if lib.is_byte(i) else b"" if lib.is_control(i) else b" \xe2\x81\x87 " if lib.is_unknown(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(names)
        ]
        # A cut before a space mark is safe if no piece has a space mark after another character.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.merges = Merges(self.ids, self.scores, self.bytes)

    def agenda(self, text: str) -> list[int]:
        """Ids of one chunk."""
        ids = self.ids
        if (one := ids.get(text)) is not None and len(text) == 1:
            return [one]
        sym: list = list(text)
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        score = self.scores.get
        heap = []
        for i in range(n - 1):
            pair = sym[i] + sym[i + 1]
            if (s := score(pair)) is not None:
                heap.append((-s, i, pair))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, pair = pop(heap)
            a = sym[i]
            if a is None:
                continue
            j = right[i]
            if j >= n or len(a) + len(sym[j]) != len(pair):
                continue  # one of the two has been merged since
            sym[i], sym[j] = pair, None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                new = pair + sym[k]
                if (s := score(new)) is not None:
                    push(heap, (-s, i, new))
            h = left[i]
            if h >= 0:
                new = sym[h] + pair
                if (s := score(new)) is not None:
                    push(heap, (-s, h, new))
        return self.spell([x for x in sym if x is not None])

    def spell(self, sym: list[str]) -> list[int]:
        """The symbols' ids; those without a piece as bytes, or as the unknown piece."""
        ids = self.ids
        out: list[int] = []
        for x in sym:
            if (one := ids.get(x)) is not None:
                out.append(one)
            elif self.bytes:
                out.extend(self.bytes[b] for b in x.encode())
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return out

    def encode_chunks(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in a row, how many each has)."""
        if not len(chunks):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        sizes = pc.utf8_length(chunks).to_numpy().astype(np.int64)
        first = np.cumsum(sizes) - sizes
        points = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays([0, len(chunks)], chunks), "")[0].as_py().encode("utf-32-le"), np.uint32)
        counts, parts, order = np.zeros(len(chunks), np.int64), [], []
        alone = sizes > SHORT
        for n in np.unique(sizes[~alone]).tolist():
            at = np.flatnonzero(sizes == n)
            found, counts[at], spelled = self.merges.merge(points[first[at][:, None] + np.arange(n)])
            if not spelled.all():
                alone[at[~spelled]] = True
                found = found[np.repeat(spelled, counts[at])]
                at = at[spelled]
            parts.append(found)
            order.append(at)
        for i in np.flatnonzero(alone).tolist():
            one = self.agenda(chunks[i].as_py())
            counts[i] = len(one)
            parts.append(np.array(one, np.uint32))
            order.append(np.array([i]))
        flat, place = np.concatenate(parts), np.concatenate(order)
        starts = np.zeros(len(chunks), np.int64)
        starts[place] = np.cumsum(counts[place]) - counts[place]
        return flat[_ranges(starts, counts)], counts

    def chunks(self, texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The chunks of normalised texts (UTF-8), in a row, and how many each text has."""
        sizes = np.array([len(t) for t in texts], np.int64)
        raw = b"".join(texts)
        new = np.zeros(len(raw) + 1, bool)
        if self.cuts and len(raw) > 2:
            b = np.frombuffer(raw, np.uint8)
            mark = np.zeros(len(raw), bool)
            mark[:-2] = (b[:-2] == MARK[0]) & (b[1:-1] == MARK[1]) & (b[2:] == MARK[2])
            new[:-1] = mark
            new[3:-1] &= ~mark[:-3]
        ends = np.cumsum(sizes)
        new[ends] = new[0] = True
        at = np.flatnonzero(new)
        flat = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])
        return flat.dictionary_encode(), np.searchsorted(at, ends) - np.searchsorted(at, ends - sizes)

    def encode_all(self, texts: list[str], bos: bool = True, eos: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each has)."""
        cut, n = self.chunks([t.encode() for t in self.lib.normalize(texts)] if texts else [])
        pieces, counts = self.encode_chunks(cut.dictionary)
        each = cut.indices.to_numpy()
        owner = np.repeat(np.arange(len(texts)), n)
        starts = np.cumsum(counts) - counts
        body = np.bincount(owner, counts[each], minlength=len(texts)).astype(np.int64)
        head, tail = int(bos and self.bos >= 0), int(eos and self.eos >= 0)
        sizes = body + head + tail
        ends = np.cumsum(sizes)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        inner = np.ones(len(out), bool)
        if head:
            out[ends - sizes] = self.bos
            inner[ends - sizes] = False
        if tail:
            out[ends - 1] = self.eos
            inner[ends - 1] = False
        out[inner] = pieces[_ranges(starts[each], counts[each])]
        return out, sizes

    def encode(self, text: str, bos: bool = True, eos: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text], bos, eos)[0].tobytes()

    def normalize(self, text: str) -> str:
        return self.lib.normalize(text)

    def decode(self, ids: bytes | list[int]) -> str:
        """The text of ids; the space that the encoder puts before a text goes."""
        seq = array("I", ids) if isinstance(ids, bytes) else ids
        raw = b"".join(map(self.out.__getitem__, seq))
        try:
            text = raw.decode()
        except UnicodeDecodeError:  # ids that no text gives
            return self.lib.decode(list(seq))
        first = next((i for i in seq if self.out[i]), None)
        return text[1:] if first is not None and first != self.unk and text.startswith(" ") and first not in self.bytes.values() else text

    def check(self, texts: list[str], ids: np.ndarray, sizes: np.ndarray, decoded: list[str]) -> None:
        """Raise unless the library gives the same ids and the same decoded text for each of the texts, whole."""
        theirs = self.lib.encode(texts, add_bos=True, add_eos=True, num_threads=1)
        if [len(x) for x in theirs] != sizes.tolist() or not np.array_equal(np.fromiter(chain.from_iterable(theirs), np.uint32, int(sizes.sum())), ids):
            raise AssertionError("piece ids differ from the library's")
        if self.lib.decode(theirs, num_threads=1) != decoded:
            raise AssertionError("a decoded text differs from the library's")


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, in a row."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class Merges:
    """Agendas as matrix rows.

    Symbols are numbered from 1; 0 is no symbol. The pairs that merge are in an open-addressing table by left * symbols +
    right, whose values are the rank of the merged piece's score, best first, and the merged piece.
    """

    NONE = np.int32(2**31 - 1)

    def __init__(self, ids: dict[str, int], scores: dict[str, float], bytes: dict[int, int]):
        number = {s: i for i, s in enumerate(dict.fromkeys([*ids, *(c for p in ids for c in p)]), 1)}
        self.n = len(number) + 1
        #: The piece of a symbol, -1 for characters that are none.
        self.piece = np.array([-1, *(ids.get(s, -1) for s in number)], np.int64)
        self.of_char = np.zeros(0x110000, np.int32)
        for s, i in number.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.bytes = np.array([bytes.get(b, -1) for b in range(256)], np.int64) if bytes else None
        ranks = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        found = [(a * self.n + b, ranks[s], number[p]) for p, s in scores.items() for k in range(1, len(p)) if (a := number.get(p[:k])) and (b := number.get(p[k:]))]
        key, rank, made = (np.array(x, t) for x, t in zip(zip(*found) if found else ([], [], []), (np.int64, np.int32, np.int32), strict=True))
        self.shift = np.uint64(64 - max(4, (4 * len(key)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.ranks, self.made = np.full(size, -1, np.int64), np.full(size, self.NONE, np.int32), np.zeros(size, np.int32)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1), return_index=True)  # one key takes a free slot
            put = first[free[first]]
            self.keys[slot[put]], self.ranks[slot[put]], self.made[slot[put]] = key[put], rank[put], made[put]
            rest = np.ones(len(key), bool)
            rest[put] = False
            if not rest.any():
                break
            key, rank, made, slot = key[rest], rank[rest], made[rest], (slot[rest] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the piece that each two symbols make, or NONE."""
        return self.ranks[self._find(a, b)]

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slots of the pairs, or a free slot."""
        key = a.astype(np.int64) * self.n + b
        slot = self._slot(key)
        found = self.keys[slot]
        todo = np.flatnonzero((found != key) & (found >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[todo]]
            todo = todo[(found != key[todo]) & (found >= 0)]
        return slot

    def merge(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece ids of the rows' chunks in a row, how many each has, rows that this spells). points: code points, a chunk in
        each row. Without pieces for bytes, rows with a symbol that is no piece are not spelled."""
        rows, n = points.shape
        sym = np.zeros((rows, n + 1), np.int32)  # the last column stands for no symbol
        sym[:, :n] = self.of_char[points]
        after, before = np.tile(np.arange(1, n + 2), (rows, 1)), np.tile(np.arange(-1, n), (rows, 1))
        before[:, 0] = n
        stays = np.ones((rows, n), bool)
        agenda = np.full((rows, n + 1), self.NONE, np.int32)
        agenda[:, : n - 1] = self.rank(sym[:, : n - 1].ravel(), sym[:, 1:n].ravel()).reshape(rows, n - 1)
        live = np.arange(rows)
        while len(live):
            i = agenda.argmin(axis=1)  # ties: leftmost first
            go = agenda[np.arange(len(live)), i] != self.NONE
            if not go.all():
                live, i, agenda = live[go], i[go], agenda[go]
                if not len(live):
                    break
            own = np.arange(len(live))
            j = after[live, i]
            k, h, new = after[live, j], before[live, i], self.made[self._find(sym[live, i], sym[live, j])]
            sym[live, i], after[live, i], before[live, k], stays[live, j] = new, k, i, False
            agenda[own, j] = self.NONE
            agenda[own, i] = self.rank(new, sym[live, k])
            agenda[own, h] = self.rank(sym[live, h], new)
        found, counts = self.piece[sym[:, :n][stays]], stays.sum(axis=1)
        odd = np.flatnonzero(found < 0)
        if not len(odd):
            return found.astype(np.uint32), counts, np.ones(rows, bool)
        owner = np.repeat(np.arange(rows), counts)
        if self.bytes is None:
            return found, counts, np.bincount(owner[odd], minlength=rows) == 0
        # A symbol that is no piece is one character: its bytes have a piece each.
        spelled = [chr(x).encode() for x in points[stays][odd].tolist()]
        size = np.ones(len(found), np.int64)
        size[odd] = [len(x) for x in spelled]
        out = np.repeat(found, size)
        out[np.repeat(found < 0, size)] = self.bytes[np.frombuffer(b"".join(spelled), np.uint8)]
        return out.astype(np.uint32), np.bincount(owner, size, minlength=rows).astype(np.int64), np.ones(rows, bool)


_codecs: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """One codec for each worker and model."""
    if model_path not in _codecs:
        _codecs[model_path] = PieceCodec(model_path)
    return _codecs[model_path]


def roundtrip(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", model_path: str | None = None, verify: bool = True) -> DataFrame:
    """Add the ids (binary, little-endian unsigned 32-bit, with begin and end ids) and the text decoded from them.

    A null text counts as empty (ids are the begin and end ids, decoded text is empty). Columns named as the two new
    ones are replaced; all others stay. An empty table gives an empty table, repeated rows are treated alike, and a text of any
    length is encoded whole. With verify, the ids and the decoded text of every row are compared with the library's, and
    the job fails on a difference.
    """
    path = model_path or default_model()
    df = without(df, ids, decoded)
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            for s in slices(texts, SLICE_CHARS):
                part = texts[s]
                flat, sizes = c.encode_all(part)
                ends = np.concatenate([[0], np.cumsum(sizes)]) * 4
                raw = flat.astype("<u4", copy=False).tobytes()
                back = [c.decode(raw[x:y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                if verify:
                    c.check(part, flat, sizes, back)
                mine = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
                rows = b.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays([*rows.columns, mine, pa.array(back, pa.string())], names=[*rows.schema.names, ids, decoded])

    return df.mapInArrow(lean(run), schema)


def encode(df: DataFrame, text: str = "text", out: str = "piece_ids", model_path: str | None = None) -> DataFrame:
    """Add an array<int> column of ids. Nulls count as empty texts."""
    path = model_path or default_model()
    df = without(df, out)
    ship(df.sparkSession)

    @F.pandas_udf("array<int>")
    def run(texts):
        c = codec(path)
        return texts.map(lambda t: array("i", c.encode(t or "")).tolist())

    return df.withColumn(out, run(F.col(text)))


def decode(df: DataFrame, ids: str = "piece_ids", out: str = "decoded", model_path: str | None = None) -> DataFrame:
    """Add the text of an array<int> column. Null ids give null."""
    path = model_path or default_model()
    df = without(df, out)
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def run(rows):
        c = codec(path)
        return rows.map(lambda r: None if r is None else c.decode([int(i) for i in r]))

    return df.withColumn(out, run(F.col(ids)))


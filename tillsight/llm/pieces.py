"""SentencePiece encoding and decoding in batched numpy.

A text becomes units: runs of the blank mark and the characters up to the next one (no piece of a
model with word-start marks crosses such a border; the model is checked for it). The distinct units of a
batch are encoded together: units of equal length form a matrix of code points, and for every
start and length the substring hashes probe the sorted hashes of the pieces (one binary search for
all units), which gives the lattice of pieces and scores.

* Unigram models: Viterbi. All units of a length advance together; at each end the vectorised
  maximum over the starts is kept with its backpointer.
* BPE models (what piece_bpe_32k is): best-scored sums are not what merging gives, so
  Viterbi cannot give SentencePiece's own ids. There the units of a length advance together
  through the same lattice by merges: each round joins, in every unit, the neighbouring pair of best
  score (the leftmost on a tie) until none is a piece.

Characters without a piece become byte pieces. Encoded units are remembered within a task (bounded).

Defined results: null and empty texts have no ids and decode to the empty text; the blank mark U+2581
in a text is a blank to the model, so such a text decodes with blanks and ``round_trip`` is false;
repeated rows give equal ids; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.llm.common import bound_batches, free_name

BLANK = "▁"
_UNITS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
NORMAL, USER, BYTE = 1, 4, 6
UNIGRAM, BPE = 1, 2
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Longer units are merged with a heap, as a matrix of a few long rows would be mostly idle.
MATRIX_LENGTH = 128
UNKNOWN_PENALTY = 10.0


def _hash_rows(codes: np.ndarray) -> np.ndarray:
    """Polynomial hash of each row of code points."""
    h = np.zeros(len(codes), np.uint64)
    for column in codes.T:
        h = h * _FACTOR + column.astype(np.uint64) + np.uint64(1)
    return h


@dataclass
class PieceModel:
    """Pieces of a model file as sorted substring hashes with ids and scores."""
    kind: int
    pieces: list[str]
    types: list[int]
    scores: np.ndarray
    unknown: int
    hashes: np.ndarray = field(init=False)
    ids: np.ndarray = field(init=False)
    longest: int = field(init=False)
    bytes_: np.ndarray = field(init=False)
    lookup: dict[str, int] = field(init=False)
    maybe: np.ndarray = field(init=False)

    def __post_init__(self):
        usable = [i for i, t in enumerate(self.types) if t in (NORMAL, USER)]
        crossing = [self.pieces[i] for i in usable if BLANK in self.pieces[i].lstrip(BLANK)]
        if crossing:
            raise ValueError(f"pieces cross a word border: {crossing[:3]}")
        self.lookup = {self.pieces[i]: i for i in usable}
        self.longest = max((len(p) for p in self.lookup), default=1)
        order = sorted((int(_hash_rows(np.array([[ord(c) for c in p]]))[0]), i) for p, i in self.lookup.items())
        self.hashes = np.array([h for h, _ in order], np.uint64)
        if len(np.unique(self.hashes)) != len(order):
            raise ValueError("two pieces share a hash")
        self.ids = np.array([i for _, i in order], np.int64)
        self.maybe = np.zeros(1 << 20, bool)                    # leading hash bits that some piece has
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        self.bytes_ = np.full(256, self.unknown, np.int64)
        for i, t in enumerate(self.types):
            if t == BYTE:
                self.bytes_[int(self.pieces[i][1:-1], 16)] = i

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Piece id of each hash, -1 where no piece has it."""
        out = np.full(hashes.shape, -1, np.int64)
        try_ = self.maybe[(hashes >> np.uint64(44)).astype(np.int64)]
        some = hashes[try_]
        at = np.minimum(np.searchsorted(self.hashes, some), len(self.hashes) - 1)
        out[try_] = np.where(self.hashes[at] == some, self.ids[at], -1)
        return out


def load_pieces(raw: bytes) -> PieceModel:
    """Model from the bytes of a SentencePiece model file with the identity normaliser."""
    from sentencepiece import sentencepiece_model_pb2 as schema
    model = schema.ModelProto()
    model.ParseFromString(raw)
    norm = model.normalizer_spec
    if len(norm.precompiled_charsmap) or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
        raise ValueError("only models without text normalisation and with a leading blank are handled")
    return PieceModel(model.trainer_spec.model_type, [p.piece for p in model.pieces],
                      [p.type for p in model.pieces], np.array([p.score for p in model.pieces]),
                      model.trainer_spec.unk_id)


def _codes(units: list[str]) -> np.ndarray:
    """Code points of units of equal length, a row each."""
    raw = "".join(units).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32).reshape(len(units), -1)


def _lattice(codes: np.ndarray, model: PieceModel) -> np.ndarray:
    """``ids[unit, length - 1, start]`` of the piece there, -1 where there is none."""
    n, size = codes.shape
    top = min(size, model.longest)
    ids = np.full((n, top, size), -1, np.int32)
    plus = codes.astype(np.uint64) + np.uint64(1)
    h = np.zeros((n, size), np.uint64)
    for length in range(1, top + 1):
        width = size - length + 1
        h = h[:, :width] * _FACTOR + plus[:, length - 1:]
        ids[:, length - 1, :width] = model.probe(h)
    return ids


def _viterbi(ids: np.ndarray, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Segment starts and ends (mask, end by start) of best score sum: all rows advance together.

    Of equal sums the longest last piece wins.
    """
    n, top, size = ids.shape
    floor = float(model.scores[model.ids].min(initial=0.0)) - UNKNOWN_PENALTY
    scores = np.where(ids >= 0, model.scores[ids], -np.inf)
    scores[:, 0, :] = np.where(ids[:, 0, :] >= 0, scores[:, 0, :], floor)     # a single unknown character
    best, back = np.full((n, size + 1), -np.inf), np.zeros((n, size + 1), np.int64)
    best[:, 0] = 0.0
    rows = np.arange(n)
    for end in range(1, size + 1):
        lengths = np.arange(min(end, top), 0, -1)
        reach = best[:, end - lengths] + scores[:, lengths - 1, end - lengths]
        pick = reach.argmax(1)
        best[:, end], back[:, end] = reach[rows, pick], end - lengths[pick]
    start, nxt = np.zeros((n, size), bool), np.zeros((n, size), np.int64)
    end, open_ = np.full(n, size), rows
    while len(open_):
        at = back[open_, end[open_]]
        start[open_, at], nxt[open_, at] = True, end[open_]
        end[open_] = at
        open_ = open_[at > 0]
    return start, nxt


def _merge_long(text: str, model: PieceModel) -> list[tuple[int, int]]:
    """Merges of one long unit with a heap of pairs; the same rule as ``_merge``."""
    end = list(range(1, len(text) + 1))
    prev, alive = list(range(-1, len(text) - 1)), [True] * len(text)
    heap: list[tuple[float, int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < len(text):
            k = model.lookup.get(text[i:end[j]]) if end[j] - i <= model.longest else None
            if k is not None:
                heapq.heappush(heap, (-model.scores[k], i, j, end[j]))

    for i in range(len(text)):
        offer(i)
    while heap:
        _, i, j, e = heapq.heappop(heap)
        if not (alive[i] and j < len(text) and alive[j] and end[i] == j and end[j] == e):
            continue
        alive[j], end[i] = False, e
        if e < len(text):
            prev[e] = i
        if prev[i] >= 0:
            offer(prev[i])
        offer(i)
    return [(i, end[i]) for i in range(len(text)) if alive[i]]


def _merge(ids: np.ndarray, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Segments (as in ``_viterbi``) by merging the neighbouring pair of best score: all rows advance together."""
    n, top, size = ids.shape
    flat = np.where(ids >= 0, model.scores[ids], -np.inf).reshape(n, -1)      # by (length - 1) * size + start
    nxt = np.tile(np.arange(1, size + 2), (n, 1))                            # end of the segment that starts here
    nxt[:, size] = size
    start = np.ones((n, size), bool)
    place, live = np.arange(size), np.arange(n)
    # score of joining each segment with the next one; after a merge only two of them change
    value = np.full((n, size), -np.inf)
    if top > 1:
        value[:, :size - 1] = flat[:, size:2 * size - 1]
    while len(live):
        part = value[live]
        i = part.argmax(1)                                                    # the leftmost of equals
        ok = part[np.arange(len(live)), i] > -np.inf
        live, i = live[ok], i[ok]
        if not len(live):
            break
        j = nxt[live, i]
        start[live, j], value[live, j] = False, -np.inf
        nxt[live, i] = nxt[live, j]
        before = np.where(start[live] & (place < i[:, None]), place, -1).max(1)
        for at in (i, before):
            seg = at >= 0
            row, k = live[seg], at[seg]
            end = nxt[row, k]
            after = nxt[row, end]
            length = after - k
            fits = (end < size) & (length <= top)
            value[row, k] = np.where(fits, flat[row, np.where(fits, (length - 1) * size + k, 0)], -np.inf)
    return start, nxt[:, :size]


def _to_ids(unit: str, cuts: list[tuple[int, int]], model: PieceModel) -> list[int]:
    out: list[int] = []
    for i, j in cuts:
        known = model.lookup.get(unit[i:j])
        out += [known] if known is not None else model.bytes_[list(unit[i:j].encode("utf-8", "surrogatepass"))].tolist()
    return out


def encode_units(units: list[str], model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units one after another and the number of ids of each.

    Units of equal length are worked together, in blocks; the few with characters unknown to the model
    are spelt out one by one.
    """
    order, parts, counts = [], [], []
    by_length: dict[int, list[int]] = {}
    for k, unit in enumerate(units):
        by_length.setdefault(len(unit), []).append(k)
    for length, members in by_length.items():
        long = model.kind == BPE and length > MATRIX_LENGTH
        block = 1 if long else max(1, 400_000 // (length * min(length, model.longest)))
        for at in range(0, len(members), block):
            part = members[at:at + block]
            if long:
                spelt = [_to_ids(units[part[0]], _merge_long(units[part[0]], model), model)]
            else:
                codes = _codes([units[k] for k in part])
                ids = _lattice(codes, model)
                start, nxt = _merge(ids, model) if model.kind == BPE else _viterbi(ids, model)
                row, i = np.nonzero(start)
                found = ids[row, nxt[row, i] - i - 1, i]
                letter = codes[row, i]
                found = np.where((found < 0) & (letter < 128), model.bytes_[np.minimum(letter, 127)], found)
                odd = np.zeros(len(part), bool)
                odd[row[found < 0]] = True                        # rows with characters of several byte pieces
                order += [k for k, o in zip(part, odd) if not o]
                parts.append(found[~odd[row]])
                counts.append(start[~odd].sum(1))
                part = [k for k, o in zip(part, odd) if o]
                spelt = [_to_ids(units[k], [(int(a), int(nxt[r, a])) for a in np.flatnonzero(start[r])], model)
                         for k, r in zip(part, np.flatnonzero(odd))]
            order += part
            parts += [np.array(x, np.int64) for x in spelt]
            counts.append(np.array([len(x) for x in spelt], np.int64))
    if not order:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    ids, n = np.concatenate(parts).astype(np.int32), np.concatenate(counts)
    sort = np.argsort(order)                                                  # back to the order of ``units``
    return ids[_spread((np.cumsum(n) - n)[sort], n[sort])], n[sort]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[0] ... starts[0] + sizes[0] - 1, starts[1] ... one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)


class Encoder:
    """Encodes texts; remembers units (emptied when large, so its memory is bounded)."""

    def __init__(self, model: PieceModel, remember: int = 400_000):
        self.model, self.remember = model, remember
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        if len(self.known) > self.remember:
            self._forget()
        cut = [_UNITS.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        new = list({u for units in cut for u in units if u not in self.known})
        ids, sizes = encode_units(new, self.model)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        starts = np.cumsum(self.sizes) - self.sizes
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        unit = np.fromiter((self.known[u] for units in cut for u in units), np.int64, int(counts.sum()))
        size = self.sizes[unit]
        ends = np.concatenate([[0], np.cumsum(size)])
        last = np.cumsum(counts)
        return self.ids[_spread(starts[unit], size)], ends[last] - ends[last - counts]


class Decoder:
    """Decodes ids: the bytes of all pieces are gathered at once."""

    def __init__(self, model: PieceModel):
        raw = [bytes([int(p[1:-1], 16)]) if t == BYTE else p.replace(BLANK, " ").encode() if t in (NORMAL, USER) else b""
               for p, t in zip(model.pieces, model.types)]
        self.size = np.array([len(r) for r in raw])
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.flat = np.frombuffer(b"".join(raw), np.uint8)

    def __call__(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        size = self.size[ids]
        ends = np.cumsum(size)
        raw = self.flat[_spread(self.start[ids], size)].tobytes()
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return [raw[a + 1:b].decode("utf-8", "replace") if b > a else "" for a, b in zip(edges[:-1], edges[1:])]


def encode_texts(docs: DataFrame, model: bytes, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the text) with ``ids``, ``n_ids`` and ``round_trip``.

    ``model``: bytes of the model file (its size is the bound of what is broadcast). ``round_trip`` tells
    whether the ids decode to the text exactly. Columns of those names are replaced.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made = ("ids", "n_ids", "round_trip")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made and (keep is not None or c != text)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(shared.value)
        encode, decode = Encoder(pieces), Decoder(pieces)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            ids, counts = encode(texts)
            back = decode(ids, counts)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
            same = pa.array([(t or "") == b for t, b in zip(texts, back)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, pa.array(counts, pa.int64()), same],
                                             names=[*batch.schema.names[:-1], *made])

    out = docs.select(*[F.col(c) for c in keep], F.col(text).alias(free_name(docs, "whole_text")))
    schema = T.StructType([*out.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("n_ids", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    return out.mapInArrow(work, schema)


def decode_ids(ids: Column, model: bytes) -> Column:
    """The text of a column of id arrays (null for null)."""
    @F.pandas_udf(T.StringType())
    def decode(rows: pd.Series) -> pd.Series:
        turn = Decoder(load_pieces(model))
        return pd.Series([None if r is None else turn(np.asarray(r, np.int64), np.array([len(r)]))[0] for r in rows])
    return decode(ids)


def model_bytes(path: str) -> bytes:
    """The model file, read on the driver (half a megabyte) and sent along with the tasks."""
    with open(path, "rb") as f:
        return f.read()

"""SentencePiece encoding and decoding by streaming Viterbi.

A text is cut into the pieces of a given vocabulary so that the sum of the pieces'
scores (in double precision) is largest, as models of the unigram kind are searched;
of equal sums the one whose last piece starts first wins. Characters without a piece become byte pieces. The search keeps
only a window of the text: once all surviving backpointer paths run through one
boundary, the ids before it are final and are given out, and no piece is longer than
the longest of the vocabulary, so the window stays short.

Where no piece of the vocabulary holds two neighbouring characters in a row, every
path has a boundary between them. Texts are cut there first, and equal parts are
searched once, many at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import _U64, fresh, mix64, slices, small_batches, text_buffer

SPACE = "▁"
#: Stands for a space mark that the text itself holds; no text can hold it.
_MARK = "\ud800"
#: Below every piece's score by so much lies that of a character without a piece.
UNKNOWN_PENALTY = 10.0
LONG_PART = 40
_SLICE_BYTES = 1 << 20
_BASE = _U64(0x9E3779B97F4A7C15)
_FALLBACK = -2
_NO_PIECE = -1


@dataclass
class Vocabulary:
    """pieces and scores by id; byte_ids: the 256 byte pieces' ids; special: ids that
    never stand for text (control, unknown, unused)."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    special: frozenset[int]
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        bytes_of = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.text = [bytes_of[i] if i in bytes_of else b"" if i in self.special else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        real = {p: i for i, p in enumerate(self.pieces) if i not in bytes_of and i not in self.special and p}
        self.real = real
        self.longest = max(map(len, real), default=1)
        self.unknown_score = min((self.scores[i] for i in real.values()), default=0.0) - UNKNOWN_PENALTY
        # All prefixes of pieces in an open-addressing table: hash -> id, or _NO_PIECE for a mere prefix.
        nodes: dict[str, int] = {}
        for p in real:
            for k in range(1, len(p)):
                nodes.setdefault(p[:k], _NO_PIECE)
        nodes.update(real)
        keys = np.array([_hash_of(p) for p in nodes], _U64)
        values = np.array(list(nodes.values()), np.int64)
        bits = max(4, int(len(keys)).bit_length() + 3)
        self.shift = _U64(64 - bits)
        self.slot_key, self.slot_value = np.zeros(1 << bits, _U64), np.full(1 << bits, -3, np.int64)
        self.probes = 1
        for key, value, slot in zip(keys, values, mix64(keys) >> self.shift, strict=True):
            at, d = int(slot), 0
            while self.slot_value[(at + d) & ((1 << bits) - 1)] != -3:
                d += 1
            self.slot_key[(at + d) & ((1 << bits) - 1)], self.slot_value[(at + d) & ((1 << bits) - 1)] = key, value
            self.probes = max(self.probes, d + 1)
        self.score = np.array([*self.scores, self.unknown_score, 0.0])
        inside = {(ord(p[k - 1]) << 21) | ord(p[k]) for p in real for k in range(1, len(p))}
        self.inside = np.array(sorted(inside), np.int64)
        self.byte_table = np.array(self.byte_ids, np.int64)

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Ids of pieces by hash: _NO_PIECE for mere prefixes, -3 for anything else."""
        mask = len(self.slot_key) - 1
        at = (mix64(h) >> self.shift).astype(np.int64)
        out = np.full(len(h), -3, np.int64)
        for d in range(self.probes):
            slot = (at + d) & mask
            out = np.where((self.slot_key[slot] == h) & (out == -3), self.slot_value[slot], out)
        return out


def load_vocabulary(model_path: str) -> Vocabulary:
    """The vocabulary of a SentencePiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = sp.get_piece_size()
    by_byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
    special = frozenset(i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
    if len(by_byte) < 256:
        raise ValueError("the vocabulary has no piece for every byte")
    return Vocabulary([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], [by_byte[b] for b in range(256)], special)


def _hash_of(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_BASE) + ord(c) + 1) % 2**64
    return h


class StreamingViterbi:
    """Feed characters, take final ids as soon as they are known.

    window: the positions kept, from the last boundary that all paths share."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.chars: list[str] = []
        self.best = [0.0]
        self.back: list[tuple[int, int]] = [(0, 0)]

    def feed(self, chars: Iterable[str]) -> Iterator[int]:
        v = self.v
        for c in chars:
            self.chars.append(c)
            end, n = len(self.chars), min(v.longest, len(self.chars))
            best, back = float("-inf"), (0, 0)
            # From the longest to the shortest: of equal sums the earliest start stays.
            for k in range(n, 0, -1):
                piece = "".join(self.chars[end - k :]) if k > 1 else c
                i = v.real.get(piece)
                if i is None and k > 1:
                    continue
                score = self.best[end - k] + (v.unknown_score if i is None else v.scores[i])
                if score > best:
                    best, back = score, (k, _FALLBACK if i is None else i)
            self.best.append(best)
            self.back.append(back)
            if end >= 2 * v.longest:
                yield from self._commit(self._shared())

    def finish(self) -> Iterator[int]:
        yield from self._commit(len(self.chars))

    def _shared(self) -> int:
        """The last boundary that the paths to all open positions run through."""
        ends = set(range(max(0, len(self.chars) - self.v.longest + 1), len(self.chars) + 1))
        while len(ends) > 1:
            top = max(ends)
            ends.remove(top)
            ends.add(top - self.back[top][0])
        return ends.pop()

    def _commit(self, upto: int) -> Iterator[int]:
        ids: list[int] = []
        at = upto
        while at > 0:
            k, i = self.back[at]
            if i == _FALLBACK:
                ids.extend(self.v.byte_ids[b] for b in reversed((SPACE if self.chars[at - 1] == _MARK else self.chars[at - 1]).encode()))
            else:
                ids.append(i)
            at -= k
        yield from reversed(ids)
        if upto:
            base = self.best[upto]
            self.chars = self.chars[upto:]
            self.best = [x - base for x in self.best[upto:]]
            self.back = [(0, 0), *self.back[upto + 1 :]]


def _viterbi(v: Vocabulary, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best pieces of many parts of one length (rows of code points): an id for each
    character at which a piece ends (-1: none ends there), and its length."""
    rows, width = x.shape
    best = np.full((rows, width + 1), -np.inf)
    best[:, 0] = 0
    length, ident = np.zeros((rows, width + 1), np.int64), np.full((rows, width + 1), _NO_PIECE, np.int64)
    codes = x.astype(_U64) + _U64(1)
    for i in range(width):
        h, alive = np.zeros(rows, _U64), np.arange(rows)
        for k in range(1, min(v.longest, width - i) + 1):
            h = h * _BASE + codes[alive, i + k - 1]
            found = v.look_up(h)
            if k == 1:
                unknown = alive[found < 0]
                _offer(best, length, ident, unknown, i, 1, np.full(len(unknown), _FALLBACK), v.unknown_score)
            good = found >= 0
            if good.any():
                _offer(best, length, ident, alive[good], i, k, found[good], v.score[found[good]])
            go = found != -3
            if not go.any():
                break
            alive, h = alive[go], h[go]
    out, size = np.full((rows, width), _NO_PIECE, np.int64), np.zeros((rows, width), np.int64)
    at, all_rows = np.full(rows, width), np.arange(rows)
    while True:
        open_ = at > 0
        if not open_.any():
            return out, size
        r, p = all_rows[open_], at[open_]
        out[r, p - 1], size[r, p - 1] = ident[r, p], length[r, p]
        at[open_] = p - length[r, p]


def _offer(best, length, ident, rows, start, k, ids, score) -> None:
    new = best[rows, start] + score
    better = new > best[rows, start + k]
    r = rows[better]
    best[r, start + k], length[r, start + k], ident[r, start + k] = new[better], k, ids[better]


def _bytes_of(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of code points in a row, and the number of each."""
    n = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
    at = np.repeat(cp, n)
    k = np.repeat(n, n) - 1 - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    lead = np.repeat(np.array([0, 0, 0xC0, 0xE0, 0xF0])[n], n)
    first = np.repeat(n, n) - 1 == k
    return np.where(first, lead | (at >> (6 * k)), 0x80 | ((at >> (6 * k)) & 0x3F)), n


def shared_boundary(v: Vocabulary, buf: np.ndarray, least: int) -> int:
    """The first byte from `least` on at which all paths have a boundary: no piece holds the
    characters on both sides of it in a row. len(buf) if there is none."""
    for lo in range(least, len(buf), 4096):
        part = buf[lo : lo + 4096 + 8]
        first = np.flatnonzero((part & 0xC0) != 0x80)
        if len(first) < 2:
            continue
        cps = np.frombuffer(part[first[0] :].tobytes().decode("utf-8", "ignore").encode("utf-32-le"), np.uint32).astype(np.int64)
        code = np.where(cps == 0x2581, 0x1FFFFF, np.where(cps == 32, 0x2581, cps))
        pair = (code[:-1] << 21) | code[1:]
        at = np.minimum(np.searchsorted(v.inside, pair), max(len(v.inside) - 1, 0))
        apart = np.flatnonzero(v.inside[at] != pair) if len(v.inside) else np.arange(len(pair))
        if len(apart):
            return lo + int(first[apart[0] + 1])
    return len(buf)


def encode_long(v: Vocabulary, buf: np.ndarray, piece: int) -> np.ndarray:
    """Ids of one long text, searched in pieces of about `piece` bytes: what is held beside the
    ids is one piece, and the window of a part without a shared boundary."""
    out, at = [], 0
    while at < len(buf):
        end = shared_boundary(v, buf, at + piece) if at + piece < len(buf) else len(buf)
        out.append(encode_texts(v, buf[at:end], np.array([0, end - at]), at == 0)[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def encode_texts(v: Vocabulary, buf: np.ndarray, offsets: np.ndarray, begins: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text's begin. begins: whether they are whole
    texts, before which a space is put, or go on from a shared boundary."""
    texts = buf.tobytes().decode("utf-8", "replace")
    cps = np.frombuffer(texts.encode("utf-32-le"), np.uint32).astype(np.int64)
    lead = (buf & 0xC0) != 0x80
    first = np.concatenate([[0], np.cumsum(lead)])[offsets]
    some = np.flatnonzero(np.diff(first))
    # A space before each text, and spaces as the space mark; a mark in a text is not a piece's mark.
    own = np.where(cps == 0x2581, -0x2581, np.where(cps == 32, 0x2581, cps))
    starts = first[some]
    if begins:
        own = np.insert(own, first[some], 0x2581)
        starts = starts + np.arange(len(some))
    begin = np.concatenate([starts, [len(own)]])
    if not len(own):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = np.where(own < 0, 0x1FFFFF, own)
    pair = (code[:-1] << 21) | code[1:]
    at = np.minimum(np.searchsorted(v.inside, pair), max(len(v.inside) - 1, 0))
    cut = np.ones(len(own), bool)
    cut[1:] = v.inside[at] != pair if len(v.inside) else True
    cut[starts] = True
    part = np.flatnonzero(cut)
    size = np.diff(np.append(part, len(own)))
    place = np.arange(len(own)) - np.repeat(part, size)
    power = np.cumprod(np.concatenate([np.ones(1, _U64), np.full(int(size.max()), _BASE)]))
    key = mix64(np.add.reduceat(mix64(code.astype(_U64) + _U64(1)) * power[place], part) + size.astype(_U64))
    _, one, same = np.unique(key, return_index=True, return_inverse=True)
    ids, counts = _encode_parts(v, own, part[one], size[one])
    where = np.cumsum(counts) - counts
    n = counts[same]
    total = np.concatenate([[0], np.cumsum(n)])
    flat = ids[np.arange(total[-1]) - np.repeat(total[:-1] - where[same], n)]
    ends = np.zeros(len(offsets), np.int64)
    ends[some + 1] = np.diff(total[np.searchsorted(part, begin)])
    return flat, np.cumsum(ends)


def _encode_parts(v: Vocabulary, own: np.ndarray, part: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the parts in a row, and how many each has."""
    counts = np.zeros(len(part), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for width in np.unique(size):
        which = np.flatnonzero(size == width)
        if width > LONG_PART:
            for w in which:
                chars = (_MARK if c < 0 else chr(c) for c in own[part[w] : part[w] + width])
                stream = StreamingViterbi(v)
                got = np.array([*stream.feed(chars), *stream.finish()], np.int64)
                found.append((np.full(len(got), w), np.arange(len(got)), got))
                counts[w] = len(got)
            continue
        for k in range(0, len(which), 20000):
            rows = which[k : k + 20000]
            x = own[part[rows][:, None] + np.arange(width)]
            ident, _ = _viterbi(v, np.where(x < 0, 0x1FFFFF, x))
            r, c = np.nonzero(ident != _NO_PIECE)
            ids = ident[r, c]
            n = np.ones(len(ids), np.int64)
            back = np.flatnonzero(ids == _FALLBACK)
            if len(back):
                data, m = _bytes_of(np.abs(x[r[back], c[back]]))
                n[back] = m
                ids, r = np.repeat(ids, n), np.repeat(r, n)
                ids[ids == _FALLBACK] = v.byte_table[data]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            counts[rows] = np.bincount(r, minlength=len(rows))
            found.append((rows[r], place, ids))
    where = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.int64)
    for w, place, ids in found:
        out[where[w] + place] = ids
    return out, counts


def encode(v: Vocabulary, text: str) -> list[int]:
    data = np.frombuffer(text.encode(), np.uint8)
    return encode_texts(v, data, np.array([0, len(data)]))[0].tolist()


def decode(v: Vocabulary, ids: Iterable[int]) -> str:
    """The text of ids; bytes that are not UTF-8 become U+FFFD. encode() and then
    decode() give back every text."""
    text = b"".join(map(v.text.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def tokenize(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """All rows and columns of docs with ids (array of int), n_tokens and decoded_same
    (whether decoding gives the text back). A null or empty text has no ids; repeated
    rows are encoded alike. Columns with these names are replaced."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = ("ids", "n_tokens", "decoded_same") + (() if keep_text else (text_col,))
    kept = [c for c in docs.columns if c not in names]
    rows = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(fresh("text_in", kept)), *[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("decoded_same", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            buf, offs = text_buffer(batch.column(0))
            for i, j in slices(offs, _SLICE_BYTES):
                part = buf[offs[i] : offs[j]]
                if len(part) > _SLICE_BYTES:  # one long text
                    ids = encode_long(v, part, _SLICE_BYTES)
                    first = np.array([0, len(ids)])
                else:
                    ids, first = encode_texts(v, part, offs[i : j + 1] - offs[i])
                listed = ids.tolist()
                same = []
                for d in range(j - i):
                    back = b"".join(map(v.text.__getitem__, listed[first[d] : first[d + 1]]))
                    same.append(back[1:] == buf[offs[i + d] : offs[i + d + 1]].tobytes())
                arrays = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], arrays, pa.array(np.diff(first), pa.int64()), pa.array(same, pa.bool_())], [*kept, "ids", "n_tokens", "decoded_same"])

    return rows.mapInArrow(run, schema)

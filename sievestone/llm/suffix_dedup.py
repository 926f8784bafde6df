"""Exact removal of repeated substrings by suffix sorting.

Every byte covered by a string of `length` bytes that also starts earlier (in a
document of smaller id, or earlier in the same one) is removed.

Each such string is represented by an anchor: the least hash of its 32-byte grams,
which equal strings have at the same place. Documents are packed in blocks, and blocks
ask which anchors others have too. For those they send snippets, the bytes of all
strings that an anchor stands for, each different one once with its first place. Where
an anchor stands in very many blocks, its strings are told apart by a second anchor,
the least of other hashes, so that a phrase common to many texts does not bring all
that stands around it to one place. The snippets of a range of anchors are joined to a
text whose suffixes are sorted by external induction; neighbours in that order with a
common prefix of `length` bytes are the repeats. Equal snippets are one entry, however
many documents hold them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._blocks import FAN, add_up, exchange, give_keys, make_blocks, merge_keys, open_block, pack_counts, pack_hashes, range_of
from ._common import _U64, combine, fresh, mix64, pack, slices, small_batches, stage, text_buffer, trim, unpack, word_hashes
from ._induced_sort import suffix_order

LENGTH = 100
GRAM = 32
BLOCK_BYTES = 4 << 20
_SLICE_BYTES = 1 << 20
_CHUNK = 1 << 22
_PLACE = _U64((1 << 24) - 1)
#: Bytes of queues held in memory, beyond which they are on disk; the text and its order are always in memory.
QUEUE_BYTES = 128 << 20
#: Blocks that may share an anchor before its strings are told apart by a second one.
HOT_BLOCKS = 128


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    padded = np.append(buf, np.zeros(8, np.uint8))
    eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(buf) - 7,), (1,))
    n = len(buf) - GRAM + 1
    h = eight[:n] * _U64(0x9E3779B97F4A7C15)
    for k, odd in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
        h ^= h >> _U64(29)
        h += eight[k : k + n] * _U64(odd)
    h ^= h >> _U64(32)
    h *= _U64(0xD6E8FEB86659FD93)
    h ^= h >> _U64(29)
    return h * _U64(0x9FB21C651E98DF25)


class Anchors:
    """Of a row of texts: key (the anchor's hash), start and last (the first and last
    string that it stands for, by their starts in the buffer), doc."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, length: int, salt: int = 0) -> None:
        parts = [self._of(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length, int(offsets[i]), i, salt) for i, j in slices(offsets, _SLICE_BYTES)]
        parts = [p for p in parts if len(p[0])]
        self.key, self.start, self.last, self.doc = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, _U64), *[np.zeros(0, np.int64)] * 3)

    @staticmethod
    def _of(buf, offsets, length, base, first_doc, salt):
        none = (np.zeros(0, _U64), *[np.zeros(0, np.int64)] * 3)
        if len(buf) < length:
            return none
        out = []
        # A very long text goes by chunks that overlap; each string starts in one of them.
        for c in range(0, len(buf) - length + 1, _CHUNK):
            piece = buf[c : c + _CHUNK + length - 1]
            h = _gram_hashes(piece)
            if salt:
                h = mix64(h ^ _U64(salt))
            low = (h & ~_PLACE) | np.arange(len(h), dtype=_U64)
            width, want = 1, length - GRAM + 1
            while 2 * width <= want:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            if width < want:
                low = np.minimum(low[: len(low) - (want - width)], low[want - width :])
            start = np.arange(c, c + len(low))
            doc = np.searchsorted(offsets, start, side="right") - 1
            inside = start + length <= offsets[doc + 1]
            start, doc, at = start[inside], doc[inside], (low[inside] & _PLACE).astype(np.int64)
            if not len(start):
                continue
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            # Least hashes are small: they are mixed again, so that ranges of keys are alike.
            out.append((mix64(h[at[first]]), start[first] + base, start[last] + base, doc[first] + first_doc))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else none


def _ask(parts: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                buf, offs = text_buffer(open_block(rows).column(0))
                keys = np.unique(Anchors(buf, offs, length).key)
                at = range_of(keys, parts)
                one = [pack_counts(np.ones(at[p + 1] - at[p], np.int64)) for p in range(parts)]
                yield pa.RecordBatch.from_arrays([pa.array([block] * parts, pa.int64()), pa.array(range(parts), pa.int32()), pa.array([pack_hashes(keys[at[p] : at[p + 1]]) for p in range(parts)], pa.binary()), pa.array(one, pa.binary())], ["sender", "part", "keys", "n"])

    return run


def _pack_marks(x: np.ndarray) -> bytes:
    return pack(x.astype(np.uint8).tobytes())


def _unpack_marks(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(unpack(data), np.uint8)


def _answer(hot: int):
    """For each anchor of a cell 0, 1 if several blocks have it, or 2 if more than `hot` do."""

    def run(cells: pa.Table) -> pa.Table:
        _, total, at = add_up(cells)
        marks = (total > 1).astype(np.uint8) + (total > hot)
        return pa.table({"sender": cells.column("sender"), "part": cells.column("part"), "answer": pa.array([_pack_marks(marks[x]) for x in at], pa.binary())})

    return run


class _Shared:
    """The shared anchors of a block, sorted by key, snippet and place: buf, offs, doc ids,
    and for each its start, strings (count), first (index of the first of equal snippets),
    and head (which are the first of their snippet)."""

    def __init__(self, rows: bytes, answers: list[dict], length: int) -> None:
        table = open_block(rows)
        self.table = table
        self.buf, self.offs = text_buffer(table.column(0))
        ids = table.column(1)
        self.null_id = ids.is_null().to_numpy(zero_copy_only=False) if ids.null_count else np.zeros(table.num_rows, bool)
        self.ids = ids.cast(pa.int64()).fill_null(-(2**63)).to_numpy()
        a = Anchors(self.buf, self.offs, length)
        _, at, count = np.unique(a.key, return_inverse=True, return_counts=True)
        marks = np.concatenate([_unpack_marks(x["answer"], 0) for x in answers]) if len(count) else np.zeros(0, np.uint8)
        use = ((marks > 0) | (count > 1))[at]
        key, start, last, doc = a.key[use], a.start[use], a.last[use], a.doc[use]
        hot = (marks > 1)[at][use]
        if hot.any():
            key, start, last, doc = (np.concatenate(x) for x in zip((key[~hot], start[~hot], last[~hot], doc[~hot]), self._apart(key[hot], start[hot], last[hot], doc[hot], length), strict=True))
        snippet = word_hashes(self.buf, start, last + length, lower=False)
        place = start - self.offs[doc]
        order = np.lexsort((place, self.ids[doc], snippet, key))
        self.key, self.start, self.doc, self.place = key[order], start[order], doc[order], place[order]
        self.strings = (last - start)[order] + 1
        snippet = snippet[order]
        self.head = np.ones(len(order), bool)
        self.head[1:] = (self.key[1:] != self.key[:-1]) | (snippet[1:] != snippet[:-1])
        self.of = np.cumsum(self.head) - 1

    def _apart(self, key, start, last, doc, length):
        """The strings of these anchors by a second anchor: each run of them by one or more."""
        size = last - start + length
        begin = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(begin[-1]) - np.repeat(begin[:-1] - start, size)
        b = Anchors(self.buf[place], begin, length, salt=0x5BD1E9955BD1E995)
        move = start[b.doc] - begin[:-1][b.doc]
        return mix64(combine(key[b.doc], b.key)), b.start + move, b.last + move, doc[b.doc]


_SNIPPETS = "sender long, part int, bytes binary, about binary"


def _send(parts: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trim()
            for block, rows, answers in zip(*[batch.column(c).to_pylist() for c in ("block", "rows", "answers")], strict=True):
                s = _Shared(rows, answers, length)
                head = np.flatnonzero(s.head)
                cut = range_of(s.key[head], parts)
                out = []
                for p in range(parts):
                    h = head[cut[p] : cut[p + 1]]
                    if len(h):
                        size = s.strings[h] + length - 1
                        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                        out.append((block, p, pack(s.buf[place + np.repeat(s.start[h], size)].tobytes()), pack(np.stack([s.key[h].view(np.int64), s.strings[h], s.ids[s.doc[h]], s.place[h]]).tobytes())))
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["sender", "part", "bytes", "about"])

    return run


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on, n of each, in a row."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - start, n)


def _relay(length: int):
    """merge and give of an exchange of snippets: the entries of a range's cells, sorted by key
    and cut into sub ranges; and their flags, in the order of the cells again."""

    def opened(cells: pa.Table, sub: int, ranges: int):
        part = cells.column("part")[0].as_py()
        rows = sorted(range(cells.num_rows), key=lambda k: cells.column("sender")[k].as_py())
        about = [np.frombuffer(unpack(cells.column("about")[k].as_py()), np.int64).reshape(4, -1) for k in rows]
        whole = np.concatenate(about, axis=1)
        order = np.argsort(whole[0].view(_U64), kind="stable")
        return part, rows, about, whole[:, order], order, range_of(whole[0].view(_U64)[order], sub, part % ranges, ranges)

    def merge(cells: pa.Table, sub: int, ranges: int) -> pa.Table:
        part, rows, about, whole, order, cut = opened(cells, sub, ranges)
        text = np.concatenate([np.frombuffer(unpack(cells.column("bytes")[k].as_py()), np.uint8) for k in rows])
        size = np.concatenate([a[1] for a in about]) + length - 1
        start, size = (np.cumsum(size) - size)[order], size[order]
        out = []
        for j in range(sub):
            i, k = cut[j], cut[j + 1]
            if k > i:
                out.append((cells.column("node")[0].as_py(), part * sub + j, pack(text[_spread(start[i:k], size[i:k])].tobytes()), pack(np.ascontiguousarray(whole[:, i:k]).tobytes())))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array([x[k] for x in out], kinds[k]) for k in range(4)], ["sender", "part", "bytes", "about"])

    def give(cells: pa.Table, answers: pa.Table, sub: int, ranges: int) -> pa.Table:
        part, rows, about, whole, order, cut = opened(cells, sub, ranges)
        by = dict(zip(answers.column("part").to_pylist(), answers.column("answer").to_pylist(), strict=True))
        told = [np.unpackbits(np.frombuffer(by[part * sub + j], np.uint8), count=int(whole[1, cut[j] : cut[j + 1]].sum())) for j in range(sub) if cut[j + 1] > cut[j]]
        strings = np.concatenate([a[1] for a in about])
        flags = np.zeros(int(strings.sum()), np.uint8)
        flags[_spread((np.cumsum(strings) - strings)[order], whole[1])] = np.concatenate(told)
        each = np.split(flags, np.cumsum([int(a[1].sum()) for a in about])[:-1])
        take = pa.array(rows)
        return pa.table({"sender": cells.column("sender").take(take), "part": cells.column("part").take(take), "answer": pa.array([np.packbits(x).tobytes() for x in each], pa.binary())})

    return merge, give


def repeated(snippets: np.ndarray, size: np.ndarray, doc: np.ndarray, place: np.ndarray, length: int, limit: int = QUEUE_BYTES) -> np.ndarray:
    """For each string (length bytes) of the snippets in a row: whether it also starts at
    an earlier (doc, place). size: bytes of each snippet, doc and place of its start."""
    strings = size - length + 1
    total = int(strings.sum())
    out = np.zeros(total, bool)
    if not total:
        return out
    # The snippets with a 0 behind each; bytes are raised by one.
    begin = np.cumsum(size + 1) - (size + 1)
    text = np.zeros(int((size + 1).sum()), np.uint16)
    behind = np.zeros(len(text), bool)
    behind[begin + size] = True
    text[~behind] = snippets
    text[~behind] += 1
    del behind
    order = suffix_order(text, length, limit)
    first = np.cumsum(strings) - strings
    number = np.full(len(text), -1, np.int32)
    k = np.arange(total, dtype=np.int32) - np.repeat(first.astype(np.int32), strings)
    number[k + np.repeat(begin.astype(np.int32), strings)] = np.arange(total, dtype=np.int32)
    order = order[number[order] >= 0]
    same = np.zeros(total, bool)
    cols = np.arange(length)
    for i in range(1, total, 1 << 13):
        j = min(total, i + (1 << 13))
        rows = text[order[i - 1 : j, None] + cols]
        same[i:j] = (rows[1:] == rows[:-1]).all(1)
    which = number[order]
    # Only strings with an equal one need their places compared.
    some = same.copy()
    some[:-1] |= same[1:]
    which, group = which[some], np.cumsum(~same)[some]
    if not len(which):
        return out
    snippet = np.searchsorted(first, which, side="right") - 1
    d, x = doc[snippet], place[snippet] + k[which]
    by = np.lexsort((x, d, group))
    lead = np.ones(len(by), bool)
    lead[1:] = group[by][1:] != group[by][:-1]
    head = by[np.flatnonzero(lead)][np.cumsum(lead) - 1]
    # Rows of one id at one place are one string, not one that starts earlier.
    out[which[by]] = (d[by] != d[head]) | (x[by] != x[head])
    return out


def _sort_range(length: int):
    def run(cells: pa.Table) -> pa.Table:
        trim()
        texts = [np.frombuffer(unpack(x), np.uint8) for x in cells.column("bytes").to_pylist()]
        about = [np.frombuffer(unpack(x), np.int64).reshape(4, -1) for x in cells.column("about").to_pylist()]
        buf, whole = np.concatenate(texts), np.concatenate(about, axis=1)
        key, strings, doc, place = whole
        size = strings + length - 1
        start = np.cumsum(size) - size
        snippet = word_hashes(buf, start, start + size, lower=False)
        order = np.lexsort((place, doc, snippet, key))
        head = np.ones(len(order), bool)
        head[1:] = (key[order][1:] != key[order][:-1]) | (snippet[order][1:] != snippet[order][:-1])
        first = order[head]
        # An anchor with one snippet has no other string to meet.
        _, of, count = np.unique(key[first], return_inverse=True, return_counts=True)
        several = first[count[of] > 1]
        n = size[several]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[several], n)
        found = repeated(buf[at], n, doc[several], place[several], length)
        flag_at = np.cumsum(strings) - strings
        flags = np.zeros(int(strings.sum()), bool)
        m = strings[several]
        flags[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(flag_at[several], m)] = found
        # Of equal snippets from several blocks, those that start later are repeats as a whole; those at one place are as the first.
        leader = np.empty(len(order), np.int64)
        leader[order] = first[np.cumsum(head) - 1]
        later = (doc != doc[leader]) | (place != place[leader])
        flags |= np.repeat(later, strings)
        tied = np.flatnonzero(~later & (leader != np.arange(len(leader))))
        for i in tied:
            flags[flag_at[i] : flag_at[i] + strings[i]] = flags[flag_at[leader[i]] : flag_at[leader[i]] + strings[i]]
        cut = np.cumsum([a[1].sum() for a in about])[:-1]
        return pa.table({"sender": cells.column("sender"), "part": cells.column("part"), "answer": pa.array([np.packbits(x).tobytes() for x in np.split(flags, cut)], pa.binary())})

    return run


def _remove(parts: int, length: int, keep_text: bool, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trim()
            for rows, answers, replies in zip(*[batch.column(c).to_pylist() for c in ("rows", "answers", "replies")], strict=True):
                yield from _rewrite(_Shared(rows, answers, length), {x["part"]: x["answer"] for x in replies or []})

    def _rewrite(s: _Shared, replies: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        head = np.flatnonzero(s.head)
        cut = range_of(s.key[head], parts)
        strings = s.strings[head]
        flags = [np.unpackbits(np.frombuffer(replies[p], np.uint8), count=int(strings[cut[p] : cut[p + 1]].sum())) for p in range(parts) if cut[p + 1] > cut[p]]
        flags = np.concatenate(flags).astype(bool) if flags else np.zeros(0, bool)
        flag_at = np.cumsum(strings) - strings
        lead = head[s.of]
        later = (s.ids[s.doc] != s.ids[s.doc[lead]]) | (s.place != s.place[lead])
        change = np.zeros(len(s.buf) + 1, np.int32)
        # All strings of a later copy go, from its first to behind its last.
        np.add.at(change, s.start[later], 1)
        np.add.at(change, s.start[later] + s.strings[later] - 1 + length, -1)
        some = np.add.reduceat(flags, flag_at, dtype=np.int64) > 0 if len(flag_at) else np.zeros(0, bool)
        part = np.flatnonzero(~later)
        part = part[some[s.of[part]]]
        n = s.strings[part]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = (k + np.repeat(s.start[part], n))[flags[k + np.repeat(flag_at[s.of[part]], n)]]
        np.add.at(change, at, 1)
        np.add.at(change, at + length, -1)
        removed = np.cumsum(change[:-1], dtype=np.int32) > 0
        total = np.concatenate([np.zeros(1, np.int32), np.cumsum(removed, dtype=np.int32)])
        begins = removed.copy()
        begins[1:] &= ~removed[:-1]
        inner = s.offs[1:-1][s.offs[1:-1] < len(removed)]
        begins[inner] = removed[inner]
        spans = np.concatenate([np.zeros(1, np.int32), np.cumsum(begins, dtype=np.int32)])
        digests, texts = [], []
        for d in range(len(s.offs) - 1):
            lo, hi = s.offs[d], s.offs[d + 1]
            rest = s.buf[lo:hi] if total[hi] == total[lo] else s.buf[lo:hi][~removed[lo:hi]]
            rest = rest.tobytes()
            digests.append(hashlib.sha256(rest).hexdigest())
            if keep_text:
                texts.append(rest.decode("utf-8", "ignore"))
        extra = {"n_bytes": pa.array(np.diff(s.offs), pa.int64()), "n_removed": pa.array(np.diff(total[s.offs]).astype(np.int64)), "n_spans": pa.array(np.diff(spans[s.offs]).astype(np.int64)), "kept_sha256": pa.array(digests, pa.string())}
        table = s.table.slice(0)
        columns = []
        for f in schema:
            if f.name in extra:
                columns.append(extra[f.name])
            elif f.name == "_text_out":
                columns.append(pa.array(texts, pa.string()))
            else:
                columns.append(table.column(f.name).combine_chunks())
        yield from pa.Table.from_arrays(columns, [f.name for f in schema]).to_batches(512)

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_text: bool = True, block_bytes: int = BLOCK_BYTES, hot: int = HOT_BLOCKS, parts: int | None = None, fan: int = FAN) -> DataFrame:
    """All rows and columns of docs with n_bytes, n_removed, n_spans (maximal removed
    runs) and kept_sha256; the text has the removed bytes cut out (keep_text=False leaves
    it out). Where a cut leaves part of a character, that part is left out too; the
    digest is of the very bytes that stay.

    Strings of `length` bytes are judged on the input. Ids must be integers; a null id
    is smaller than any. Rows of one id are one document: what stands at the same
    place of several is not a repeat of each other. A null text is empty. Texts shorter
    than `length` lose nothing; a very long text is one block. Columns with the names of
    results are replaced.

    hot: anchors in more blocks than this are told apart by a second one. parts: ranges
    of anchors (one for each four thirds of a block by default), fan: cells of a sender.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} or more")
    spark = docs.sparkSession
    small_batches(spark)
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    others = [c for c in docs.columns if c not in (id_col, text_col, *names)]
    rows = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(fresh("text_in", [id_col, *others])), F.col(f"`{id_col}`"), *[F.col(f"`{c}`") for c in others])
    blocks = stage(rows.mapInArrow(make_blocks(block_bytes), "block long, rows binary"), "sd-blocks")
    senders = blocks.count()
    parts = parts or max(1, senders * 3 // 4)
    first = min(parts, fan)
    answer = "sender long, part int, answer binary"
    asked = blocks.mapInArrow(_ask(first, length), "sender long, part int, keys binary, n binary")
    answers = exchange(asked, senders, parts, fan, merge_keys, give_keys((_unpack_marks, _pack_marks)), (_answer(hot), answer))
    by_block = stage(answers.groupBy(F.col("sender").alias("block")).agg(F.array_sort(F.collect_list(F.struct("part", "answer"))).alias("answers")), "sd-answers")
    sent = blocks.join(by_block, "block").mapInArrow(_send(first, length), _SNIPPETS)
    flags = exchange(sent, senders, parts, fan, *_relay(length), (_sort_range(length), answer))
    replies = stage(flags.groupBy(F.col("sender").alias("block")).agg(F.collect_list(F.struct("part", "answer")).alias("replies")), "sd-replies")
    both = blocks.join(by_block.join(replies, "block", "left"), "block").select("rows", "answers", "replies")
    kinds = {f.name: f for f in rows.schema.fields}
    out = T.StructType([kinds[id_col], *[kinds[c] for c in others], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    if keep_text:
        out = out.add(T.StructField("_text_out", T.StringType()))
    done = both.mapInArrow(_remove(first, length, keep_text, out), out)
    if not keep_text:
        return done
    order = [c for c in docs.columns if c not in names]
    return done.select(*[F.col("_text_out").alias(text_col) if c == text_col else F.col(f"`{c}`") for c in order], *names)

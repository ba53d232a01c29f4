"""Exact removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if a string of LENGTH bytes that covers it also starts in a
document with a smaller id.  Sorting all suffixes of a corpus is out of reach,
and not needed: equal strings have equal least k-grams at the same place, so

1. each window of LENGTH bytes belongs to its least k-gram (its anchor), one
   anchor for about 14 bytes.  The windows of an anchor and the bytes they
   cover are its context.  Anchors go to blocks by their hash; where documents
   have one in common, each sends the bytes of its contexts to the block of the
   place at which the smallest of these documents has it.  Contexts next to each
   other mostly go the same way, as one run of bytes.
2. these suffixes, but for those whose hash no other one of the block has and
   which are therefore equal to none, are sorted by mergesort.  Two are compared in log2(LENGTH)
   steps: binary search over prefix polynomial hashes finds their common
   extension, the next byte decides.  Hashes can collide, so all neighbours are
   compared byte by byte afterwards; where the order is wrong, it is made again
   from the bytes.  The smallest document of a run of equal strings keeps them.

No byte is removed for a hash alone: whole contexts that a task sees several
times (copies, common passages) are compared byte by byte with the first one
before they stand for one suffix, so a common passage sends one row a task, not
one a document.  An anchor with very many contexts is split by the hashes of
its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, lean, mix64, prefix_hash, range_hash, text_slices
from .packing import PACKED, block_bits, heads, joined, packed, runs, text_totals, values

U = np.uint64
#: Bytes of a string that counts as a repeat, of an anchor, and k-grams in a window.
LENGTH, GRAM = 50, 24
GRAMS = LENGTH - GRAM + 1
#: Windows looked at in one step; a longer text is cut here, which moves contexts but changes no result.
STEP = 1 << 20
#: Anchors (or contexts) buffered by a task before they are dealt.
BUFFER, CONTEXT_BUFFER = 1_000_000, 100_000
#: Contexts of one anchor in one task, and entries of one in a block, above which its windows are dealt by their own hashes.
TASK_CONTEXTS, BLOCK_CONTEXTS = 64, 4_096
#: Text bytes for each block, and the bits of the smallest and largest number of blocks.
BLOCK_BYTES, MIN_BITS, MAX_BITS = 12 << 20, 6, 24
#: Bits of an anchor's hash, and of the places in a document that share a block.
NAME_BITS, PLACE_BITS = 48, 9
#: In place of a block: the windows of this anchor are dealt apart.
HOT = (1 << 32) - 1
_ENTRIES, _MARKS, _ASKED, _SPANS, _RUNS = 0, 1, 2, 3, 4


class Anchors:
    """Anchors of a slice: windows lo..hi (first bytes), anchor byte, hashes, document, each by position."""

    __slots__ = ("at", "context", "doc", "end", "gram", "hi", "lo", "prefix")

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.prefix = prefix_hash(data)
        self.end = np.repeat(starts[1:], np.diff(starts))  # of the document at each byte
        parts = [self._step(starts, lo, min(lo + STEP, len(data) - LENGTH + 1)) for lo in range(0, max(0, len(data) - LENGTH + 1), STEP)]
        none = np.zeros(0, np.int64)
        self.lo, self.hi, self.at, gram = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (none, none, none, none.astype(U))
        self.doc = np.searchsorted(starts, self.lo, side="right") - 1
        self.gram = mix64(gram) >> U(64 - NAME_BITS)  # anchors are small hashes: mixed again they spread over all blocks
        shape = ((self.at - self.lo) * GRAMS + self.hi - self.lo).astype(U)
        self.context = mix64(range_hash(self.prefix, self.lo, self.hi + LENGTH) + shape * U(0x9E3779B97F4A7C15))

    def _step(self, starts: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        n = hi - lo + GRAMS - 1
        at = np.arange(lo, lo + n)
        gram = mix64(range_hash(self.prefix, slice(lo, lo + n), slice(lo + GRAM, lo + n + GRAM)))
        key = (gram >> U(28) << U(28)) | np.arange(n, dtype=U)  # ties go to the left
        width = 1
        while width * 2 <= GRAMS:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if GRAMS > width:
            key = np.minimum(key[: len(key) - (GRAMS - width)], key[GRAMS - width :])
        first = at[: hi - lo]
        end = self.end[lo:hi]
        ok = first + LENGTH <= end
        first, best = first[ok], (key[ok] & U((1 << 28) - 1)).astype(np.int64)
        new = heads(best, end[ok])
        if not len(new):
            return first, first, best, gram[:0]
        return first[new], first[np.append(new[1:], len(first)) - 1], best[new] + lo, gram[best[new]]


def _ids(s) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, which of them are known, tags) of the rows of a slice; a tag tells rows apart that repeat an id."""
    ids = s.column("doc_id")
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_valid().to_numpy(zero_copy_only=False), s.column("tag").to_numpy(zero_copy_only=False)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one number that compares like them; a view."""
    return np.ndarray((max(0, len(data) - 7),), ">u8", np.ascontiguousarray(data).data, strides=(1,))


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a : a + size] equals data[b : b + size], for sizes of eight and more."""
    w, same = _words(data), np.ones(len(a), bool)
    for k in range(0, int(size.max(initial=0)), 8):
        o = np.minimum(k, size - 8)
        same &= w[a + o] == w[b + o]
    return same


def _offsets() -> list[int]:
    return [*range(0, LENGTH - 7, 8), LENGTH - 8]


def compare(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """-1, 0 or 1: how the LENGTH bytes at a compare with those at b."""
    w, out = _words(data), np.zeros(len(a), np.int8)
    for k in _offsets():
        x, y = w[a + k].astype(U), w[b + k].astype(U)
        out = np.where(out == 0, (x > y).astype(np.int8) - (x < y), out)
    return out


def verified(data: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray, doc: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Of each row, that of the smallest document with equal key, size, bytes and `more`, or its own."""
    out, order = np.arange(len(key)), np.argsort(key)
    count = np.diff([*heads(key[order]), len(key)])
    some = order[np.repeat(count > 1, count)]
    some = some[np.lexsort((doc[some], key[some]))]
    head = heads(key[some])
    first = np.repeat(some[head], np.diff([*head, len(some)]))
    at = np.flatnonzero((first != some) & (size[first] == size[some]))
    for x in more:
        at = at[x[first[at]] == x[some[at]]]
    at = at[same_bytes(data, begin[some[at]], begin[first[at]], size[some[at]])]
    out[some[at]] = first[at]
    return out


def _spans(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray, blocks: int, shift: int) -> list[tuple]:
    """Rows (block of the document + shift; documents, tags, starts, ends) of removed bytes, overlapping spans made one."""
    block = (mix64(doc.view(U)) % U(blocks)).astype(np.int64)
    order = np.lexsort((end, start, tag, doc, block))
    doc, tag, start, end, block = doc[order], tag[order], start[order], end[order], block[order]
    own = heads(doc, tag)
    if not len(own):
        return []
    # the farthest end so far in the row: rows are laid out one after another so that none reaches the next
    base = np.repeat(np.concatenate([[0], np.cumsum(np.maximum.reduceat(end, own) + 1)[:-1]]), np.diff([*own, len(doc)]))
    far = np.maximum.accumulate(base + end)
    new = np.ones(len(doc), bool)
    new[1:] = base[1:] + start[1:] > far[:-1]
    x = np.flatnonzero(new)
    last = np.append(x[1:], len(doc)) - 1
    doc, tag, start, end, block = doc[x], tag[x], start[x], (far - base)[last], block[x]
    return [(int(block[lo]) + shift, _SPANS, doc[lo:hi], tag[lo:hi], start[lo:hi], end[lo:hi], None) for lo, hi in runs(heads(block), len(doc))]


def _asked(doc: np.ndarray, gram: np.ndarray, place: np.ndarray, blocks: int, shift: int) -> list[tuple]:
    """Rows (block of the document + shift; documents, counts, anchors, the block each is asked to)."""
    block = (mix64(doc.view(U)) % U(blocks)).astype(np.int64)
    order = np.lexsort((doc, block))
    doc, gram, place, block = doc[order], gram[order], place[order], block[order]
    head, rows = heads(doc, block), []
    for lo, hi in runs(heads(block), len(doc)):
        x = head[np.searchsorted(head, lo) : np.searchsorted(head, hi)]
        rows.append((int(block[lo]) + shift, _ASKED, doc[x], np.diff([*x, hi]).astype(np.uint32), gram[lo:hi], place[lo:hi].astype(np.uint32), None))
    return rows


def _by_block(block: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by block, where each block begins)."""
    order = np.argsort(block.astype(np.uint16 if blocks <= 1 << 16 else np.uint32), kind="stable")
    return order, np.searchsorted(block[order], np.arange(blocks + 1))


def _deal(bits: int):
    """Texts to (anchor, document) by block of the anchor; of equal contexts in a task only the smallest document's."""
    blocks = 1 << bits

    def flush(parts: list[tuple], data: list[np.ndarray]) -> pa.RecordBatch:
        gram, context, doc, tag, pos, size, begin = (np.concatenate(x) for x in zip(*parts, strict=True))
        first = verified(np.concatenate(data), begin, size, context, doc, gram)
        later = doc > doc[first]
        rows = _spans(doc[later], tag[later], pos[later], (pos + size)[later], blocks, blocks)
        # contexts that stand for themselves count towards a hot anchor; a document enters with each anchor once
        rest = np.flatnonzero(~later)
        alone = first[rest] == rest
        gram, doc, place = gram[rest], doc[rest], np.minimum(pos[rest] >> PLACE_BITS, 65535)
        order = np.argsort(gram)
        g = heads(gram[order])
        size = np.diff([*g, len(gram)])
        many = np.add.reduceat(alone[order], g) > TASK_CONTEXTS if len(g) else np.zeros(0, bool)
        hot, once = np.zeros(len(gram), bool), np.ones(len(gram), bool)
        hot[order] = np.repeat(many, size)
        marks = gram[order][g][many]
        some = order[np.repeat(size > 1, size)]
        some = some[np.lexsort((place[some], doc[some], gram[some]))]
        once[some] = False
        once[some[heads(gram[some], doc[some])]] = True
        rows += _asked(doc[hot & once], gram[hot & once], np.full((hot & once).sum(), HOT), blocks, blocks)
        rows += [(int(x >> U(NAME_BITS - bits)), _MARKS, np.array([x]), None, None, None, None) for x in marks]
        gram, doc, place = (x[once & ~hot] for x in (gram, doc, place))
        order, cuts = _by_block((gram >> U(NAME_BITS - bits)).astype(np.int64), blocks)
        gram, doc, place = gram[order], doc[order], place[order]
        for b in np.flatnonzero(np.diff(cuts)):
            lo, hi = cuts[b], cuts[b + 1]
            d, x = doc[lo:hi], gram[lo:hi]
            head = heads(d)
            rows.append((int(b), _ENTRIES, d[head], np.diff([*head, hi - lo]).astype(np.uint32), x.astype(np.uint32), (x >> U(32)).astype(np.uint16), place[lo:hi].astype(np.uint16)))
        return packed(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, data, held, size = [], [], 0, 0
        for s in text_slices(batches):
            a = Anchors(s.data, s.starts)
            ids, known, tags = _ids(s)
            ok = np.flatnonzero(known[a.doc])
            doc, lo = a.doc[ok], a.lo[ok]
            parts.append((a.gram[ok], a.context[ok], ids[doc], tags[doc], lo - s.starts[doc], a.hi[ok] + LENGTH - lo, lo + size))
            data.append(s.data.copy())
            held, size = held + len(ok), size + len(s.data)
            if held >= BUFFER:
                yield flush(parts, data)
                parts, data, held, size = [], [], 0, 0
        if held:
            yield flush(parts, data)

    return run


def _pass_on(table: pa.Table, blocks: int) -> pa.Table:
    return table.set_column(0, "key", pa.array([table["key"][0].as_py() - blocks] * table.num_rows, pa.int64()))


def _meet(bits: int):
    """One block of anchors: which documents share one with others, and are asked for its contexts."""
    blocks = 1 << bits

    def run(table: pa.Table) -> pa.Table:
        if table["key"][0].as_py() >= blocks:
            return _pass_on(table, blocks)
        kind = table["kind"].to_numpy()
        marks = joined(table.filter(pa.array(kind == _MARKS)), "a", U)
        table = table.filter(pa.array(kind == _ENTRIES))
        doc = np.repeat(joined(table, "a", np.int64), joined(table, "b", np.uint32))
        gram = joined(table, "c", np.uint32).astype(U) | (joined(table, "d", np.uint16).astype(U) << U(32))
        place = joined(table, "e", np.uint16)
        order = np.lexsort((place, doc, gram))
        gram, doc, place = gram[order], doc[order], place[order]
        g = heads(gram)
        size = np.diff([*g, len(gram)])
        several = doc[np.append(g[1:], len(doc)) - 1] > doc[g] if len(g) else np.zeros(0, bool)
        hot = np.isin(gram[g], marks) | (several & (size > BLOCK_CONTEXTS))
        to = (mix64(doc[g].view(U) * U(0x9E3779B97F4A7C15) + place[g]) % U(blocks)).astype(np.int64)
        to = np.repeat(np.where(hot, HOT, to), size)
        once = np.zeros(len(gram), bool)
        once[heads(gram, doc)] = True
        once &= np.repeat(several | hot, size)
        return pa.Table.from_batches([packed(_asked(doc[once], gram[once], to[once], blocks, 0))])

    return run


_ANSWERS = "id long, asked binary, spans binary"


def _answers(table: pa.Table) -> pa.Table:
    """By document: the anchors it is asked for and the blocks it is asked to, and (tag, start, end) of what is removed."""
    kind = table["kind"].to_numpy()
    asked, spans = table.filter(pa.array(kind == _ASKED)), table.filter(pa.array(kind == _SPANS))
    doc = np.repeat(joined(asked, "a", np.int64), joined(asked, "b", np.uint32))
    gram, place = joined(asked, "c", U), joined(asked, "d", np.uint32)
    order = np.lexsort((gram, doc))
    doc, gram, place = doc[order], gram[order], place[order]
    out = {int(doc[lo]): [gram[lo:hi].tobytes() + place[lo:hi].tobytes(), None] for lo, hi in runs(heads(doc), len(doc))}
    doc = joined(spans, "a", np.int64)
    triple = np.stack([joined(spans, x, np.int64) for x in "bcd"], axis=1)
    order = np.argsort(doc, kind="stable")
    doc, triple = doc[order], triple[order]
    for lo, hi in runs(heads(doc), len(doc)):
        out.setdefault(int(doc[lo]), [None, None])[1] = triple[lo:hi].tobytes()
    cols = [list(out), [x[0] for x in out.values()], [x[1] for x in out.values()]]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["id", "asked", "spans"])


def _listed(column: pa.Array, gram: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchors that their documents are asked for, the block each is asked to)."""
    lists = [(int(i), column[int(i)].as_buffer()) for i in np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))]
    if not lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    have = np.concatenate([(U(i) << U(NAME_BITS)) | np.frombuffer(x, U, len(x) // 12) for i, x in lists])
    place = np.concatenate([np.frombuffer(x, np.uint32, offset=len(x) // 12 * 8) for _, x in lists])
    want = (doc.astype(U) << U(NAME_BITS)) | gram
    k = np.minimum(np.searchsorted(have, want), len(have) - 1)
    at = np.flatnonzero(have[k] == want)
    return at, place[k[at]].astype(np.int64)


def _take(data: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all data[lo : lo + size], one after another."""
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return data[at]


def _send_contexts(bits: int):
    """Texts with the anchors that are asked of them to runs of bytes: neighbours that go to one block, or windows of hot anchors by their hash."""
    blocks = 1 << bits

    def flush(parts: list[tuple]) -> pa.RecordBatch:
        block, doc, tag, pos, size, raw = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, cuts = _by_block(block, blocks)
        begin = np.cumsum(size) - size
        rows = []
        for b in np.flatnonzero(np.diff(cuts)):
            x = order[cuts[b] : cuts[b + 1]]
            rows.append((int(b), _RUNS, doc[x], tag[x], pos[x].astype(np.uint32), size[x].astype(np.uint32), _take(raw, begin[x], size[x])))
        return packed(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for s in text_slices(batches):
            a = Anchors(s.data, s.starts)
            ids, _, tags = _ids(s)
            at, block = _listed(s.column("asked"), a.gram, a.doc)
            need, hot = at[block != HOT], at[block == HOT]
            if len(need):
                block, doc, lo = block[block != HOT], a.doc[need], a.lo[need]
                new = np.ones(len(need), bool)
                new[1:] = (block[1:] != block[:-1]) | (doc[1:] != doc[:-1]) | (lo[1:] != a.hi[need[:-1]] + 1)
                x = np.flatnonzero(new)
                size = a.hi[need[np.append(x[1:], len(need)) - 1]] + LENGTH - lo[x]
                parts.append((block[x], ids[doc[x]], tags[doc[x]], lo[x] - s.starts[doc[x]], size, _take(s.data, lo[x], size)))
                held += len(need)
            if len(hot):
                count = a.hi[hot] + 1 - a.lo[hot]
                at = np.repeat(a.lo[hot] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                row = np.repeat(a.doc[hot], count)
                length = np.full(len(at), LENGTH)
                key = range_hash(a.prefix, at, at + LENGTH)
                first = verified(s.data, at, length, key, ids[row])
                doc, tag, pos = ids[row], tags[row], at - s.starts[row]
                later = doc > doc[first]
                yield packed(_spans(doc[later], tag[later], pos[later], pos[later] + LENGTH, blocks, blocks))
                x = np.flatnonzero(~later)
                parts.append(((mix64(key[x]) % U(blocks)).astype(np.int64), doc[x], tag[x], pos[x], length[x], _take(s.data, at[x], length[x])))
                held += len(x)
            if held >= CONTEXT_BUFFER:
                yield flush(parts)
                parts, held = [], 0
        if held:
            yield flush(parts)

    return run


def common_extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Length of the longest common beginning of the suffixes at a and b, at most `limit`, by binary search over hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), limit, np.int64)
    while (low < high).any():
        mid = (low + high + 1) >> 1
        same = range_hash(prefix, a, a + mid) == range_hash(prefix, b, b + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _below(data: np.ndarray, prefix: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int, or_equal: np.ndarray) -> np.ndarray:
    """Whether each suffix at a sorts before the one at b."""
    n = common_extension(prefix, a, b, limit)
    k = np.minimum(n, limit - 1)
    return np.where(n == limit, or_equal, data[a + k] < data[b + k])


def merge_sort(data: np.ndarray, prefix: np.ndarray, at: np.ndarray, segment: np.ndarray, limit: int) -> np.ndarray:
    """Order of the suffixes at `at` by their first `limit` bytes within each run of equal `segment`.

    All runs of one width of all segments are merged at once: a suffix moves to
    its place in its own run plus the number of suffixes before it in the other
    run, which binary search finds.
    """
    head = heads(segment)
    size = np.diff([*head, len(segment)])
    order = np.arange(len(at))
    width = 1
    while len(size) and width < size.max():
        live = np.flatnonzero(np.repeat(size > width, size))
        begin, length = np.repeat(head, size)[live], np.repeat(size, size)[live]
        local = live - begin
        run = local // width
        other = (run ^ 1) * width
        low, high = np.minimum(other, length), np.minimum(other + width, length)
        first = low.copy()
        mine = at[order[live]]
        while (todo := np.flatnonzero(low < high)).size:
            mid = (low[todo] + high[todo]) >> 1
            theirs = at[order[begin[todo] + mid]]
            before = _below(data, prefix, theirs, mine[todo], limit, run[todo] % 2 == 1)  # of equal ones the left run's come first
            low[todo] = np.where(before, mid + 1, low[todo])
            high[todo] = np.where(before, high[todo], mid)
        place = begin + (run // 2) * 2 * width + local % width + (low - first)
        new = order.copy()
        new[place] = order[live]
        order, width = new, width * 2
    return order


def sorted_windows(data: np.ndarray, prefix: np.ndarray, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the windows at `at` by place and bytes, whether each differs from the one before it); no hash is relied on."""
    order = np.argsort(place, kind="stable")
    order = order[merge_sort(data, prefix, at[order], place[order], LENGTH)]
    new = np.ones(len(order), bool)
    same = np.flatnonzero(place[order][1:] == place[order][:-1])
    how = compare(data, at[order[same]], at[order[same + 1]])
    if (how > 0).any():  # a collision misled the mergesort
        w = _words(data)
        order = np.lexsort((*[w[at + k].astype(U) for k in _offsets()[::-1]], place))
        same = np.flatnonzero(place[order][1:] == place[order][:-1])
        how = compare(data, at[order[same]], at[order[same + 1]])
    new[same[how == 0] + 1] = False
    return order, new


def _sort_windows(bits: int):
    """One block: sorts the windows of the contexts in its runs and answers which of them a smaller document has."""
    blocks = 1 << bits

    def run(table: pa.Table) -> pa.Table:
        if table["key"][0].as_py() >= blocks:
            return _pass_on(table, blocks)
        run_doc, run_tag, run_pos, data = joined(table, "a", np.int64), joined(table, "b", np.int64), joined(table, "c", np.uint32), joined(table, "e", np.uint8)
        starts = np.concatenate([[0], np.cumsum(joined(table, "d", np.uint32).astype(np.int64))])
        # a run holds the windows of its contexts and no others, so its anchors are those of the document
        a = Anchors(data, starts)
        prefix, begin, size, off = a.prefix, a.lo, a.hi + LENGTH - a.lo, a.at - a.lo
        doc, tag, pos = run_doc[a.doc], run_tag[a.doc], run_pos[a.doc].astype(np.int64) + a.lo - starts[a.doc]
        # equal contexts, byte by byte, stand for one: larger documents lose it whole, the smallest one's repeats fare alike
        first = verified(data, begin, size, a.context, doc, off)
        seg = a.gram
        later = doc > doc[first]
        out = [(doc[later], tag[later], pos[later], (pos + size)[later])]
        one = np.flatnonzero(first == np.arange(len(first)))
        count = size[one] - LENGTH + 1
        own = np.repeat(one, count)
        i = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        # equal windows have their anchor at the same place
        place = mix64(seg[own] + (off[own] - i + GRAMS).astype(U) * U(0x9E3779B97F4A7C15))
        # a window whose hash no other one has is equal to none; all others are sorted
        key = place + mix64(range_hash(prefix, begin[own] + i, begin[own] + i + LENGTH))
        order = np.argsort(key)
        size_of = np.diff([*heads(key[order]), len(order)])
        order = order[np.repeat(size_of > 1, size_of)]
        place, own, i = place[order], own[order], i[order]
        order, new = sorted_windows(data, prefix, begin[own] + i, place)
        own, i = own[order], i[order]
        head = np.flatnonzero(new)
        least = np.repeat(np.minimum.reduceat(doc[own], head), np.diff([*head, len(own)])) if len(own) else doc[:0]
        lost = np.flatnonzero(doc[own] > least)
        own, i = own[lost], i[lost]
        out.append((doc[own], tag[own], pos[own] + i, pos[own] + i + LENGTH))
        alike = np.flatnonzero(~later & (first != np.arange(len(first))))
        if len(alike) and len(own):
            order = np.argsort(own, kind="stable")
            own, i = own[order], i[order]
            lo, hi = np.searchsorted(own, first[alike]), np.searchsorted(own, first[alike], side="right")
            who = np.repeat(alike, hi - lo)
            x = i[np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(len(who))]
            out.append((doc[who], tag[who], pos[who] + x, pos[who] + x + LENGTH))
        return pa.Table.from_batches([packed(_spans(*(np.concatenate(x) for x in zip(*out, strict=True)), blocks, 0))])

    return run


_OUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for s in text_slices(batches):
        gone, touched = np.zeros(len(s.data) + 1, np.int32), np.zeros(len(s), bool)
        tags = s.column("tag").to_numpy(zero_copy_only=False)
        for name in ("spans", "more"):
            column = s.column(name)
            for i in np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False)).tolist():
                told = values(column[i], np.int64).reshape(-1, 3)
                told = told[told[:, 0] == tags[i], 1:] + s.starts[i]  # not those of other rows that repeat the id
                np.add.at(gone, told[:, 0], 1)
                np.add.at(gone, told[:, 1], -1)
                touched[i] |= len(told) > 0
        lost = np.cumsum(gone[:-1]) > 0
        n_removed, spans, kept = [], [], []
        for i, (lo, hi) in enumerate(zip(s.starts[:-1], s.starts[1:], strict=True)):
            if not touched[i]:
                n_removed.append(0)
                spans.append([])
                kept.append(s.data[lo:hi].tobytes())
                continue
            x = lost[lo:hi]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], x.view(np.int8), [0]])))
            n_removed.append(int(x.sum()))
            spans.append([{"start": int(p), "end": int(q)} for p, q in zip(edge[::2], edge[1::2], strict=True)])
            kept.append(s.data[lo:hi][~x].tobytes())
        yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(np.diff(s.starts)), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` for each row: what is removed, and the bytes that stay.

    * null or empty texts, and those below LENGTH bytes, lose nothing.
    * very long texts: a text is looked at whole by one task, which holds some tens of bytes a byte of it.
    * rows that repeat an id aren't compared with each other and lose what smaller ids have; they are
      told apart by a 64-bit hash of their texts.
    * null ids: the row loses nothing and takes nothing from others.
    * repeats within a document stay.  Empty table: empty result; other columns are ignored.
    * `kept` can begin or end within a character, as matches are of bytes.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bits = block_bits(text_totals(d, "text")[1], BLOCK_BYTES, MIN_BITS, MAX_BITS)
    d = d.withColumn("tag", F.xxhash64("text"))
    met = d.mapInArrow(_deal(bits), PACKED).groupBy("key").applyInArrow(_meet(bits), PACKED)
    answers = checkpoint(met.groupBy("key").applyInArrow(_answers, _ANSWERS))
    asked = answers.where("asked IS NOT NULL").select("id", "asked")
    sent = d.join(asked, F.col("doc_id") == F.col("id")).select("doc_id", "tag", "text", "asked").mapInArrow(_send_contexts(bits), PACKED)
    windows = sent.groupBy("key").applyInArrow(lean(_sort_windows(bits)), PACKED)
    more = checkpoint(windows.groupBy("key").applyInArrow(_answers, _ANSWERS).select("id", F.col("spans").alias("more")))
    told = answers.where("spans IS NOT NULL").select("id", "spans").join(more, "id", "full")
    out = d.join(told, F.col("doc_id") == F.col("id"), "left")
    return out.select("doc_id", "tag", "text", "spans", "more").mapInArrow(_remove, _OUT)


def digest(result: DataFrame) -> DataFrame:
    """The thin view of the query: sizes, spans and the hash of what is kept."""
    return result.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

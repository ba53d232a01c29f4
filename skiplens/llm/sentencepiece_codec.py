"""SentencePiece encoding and decoding by suffix-array matching.

Texts are cut into chunks that no piece can cross (a run of word marks and
the letters, digit or other characters that follow, as far as the pieces
allow).  The distinct chunks of a batch are concatenated and all their suffixes
sorted, every piece of the vocabulary finds its range of occurrences by binary
search, and the resulting edges, sorted by position, are relaxed: for unigram
models to the path of the best total score, for BPE models in the order of
their ranks, an edge being taken when two tokens fill it.  Every token of a
batch comes out of that batch's array; nothing is remembered between batches.

The vocabulary comes from a model file, read once on the driver.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, text_slices

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of text in a batch, and characters of chunks that are indexed at once.
BATCH_BYTES, INDEX_CHARS = 8 << 20, 400_000
#: The same for a worker that shares its executor with other stages: it holds less and indexes common chunks more often.
LEAN_BYTES, LEAN_CHARS = 2 << 20, 100_000
#: Characters above which the edges of a chunk are relaxed from a heap, in place of rounds over the edges of all chunks.
LONG_CHUNK = 64
UNIGRAM, BPE = 1, 2
#: Ways to cut texts into chunks, the finest first.  Each cuts between two characters by these two alone,
#: so no piece crosses chunks if each piece by itself is one chunk.
_LETTERS, _OTHER = "[^\\W\\d_²³¹¼-¾⁰-₉]+", f"(?:[^\\w{MARK}\n]|[_²³¹¼-¾⁰-₉])+"
CUTS = (
    f"\n|{MARK}*{_LETTERS}|{MARK}*\\d|{MARK}*{_OTHER}|{MARK}+",
    f"\n|{MARK}*{_LETTERS}|{MARK}*\\d+|{MARK}*{_OTHER}|{MARK}+",
    f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+",
)


def finest_cut(pieces: list[str]) -> re.Pattern:
    for cut in map(re.compile, CUTS):
        if all(len(cut.findall(t)) == 1 for t in pieces):
            return cut
    raise ValueError("pieces across words or lines are not supported")


@dataclass
class Vocabulary:
    """Pieces that can be matched (text, score), the byte pieces, and the unknown piece."""

    kind: int
    pieces: list[tuple[int, str, float]]  # id, text, score
    byte_ids: list[int]  # 256, or empty
    unk: int
    texts: list[bytes]  # what each id decodes to
    prefix: bool = True
    index: dict = field(default_factory=dict)

    @staticmethod
    def load(path: str = MODEL_PATH) -> Vocabulary:
        """Reads a model whose normaliser is the identity and keeps all white space."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with an identity normaliser that keep white space are supported")
        kinds = {1: "normal", 2: "unknown", 3: "control", 4: "user", 5: "unused", 6: "byte"}
        pieces, byte_ids, unk, texts = [], [-1] * 256, 0, []
        for i, p in enumerate(model.pieces):
            kind = kinds[p.type]
            texts.append(b"" if kind == "control" else p.piece.encode())
            if kind == "normal":
                pieces.append((i, p.piece, p.score))
            elif kind == "user":
                raise ValueError("user-defined pieces are not supported")
            elif kind == "unknown":
                unk, texts[-1] = i, model.trainer_spec.unk_surface.encode()
            elif kind == "byte":
                b = int(p.piece[3:5], 16)
                byte_ids[b], texts[-1] = i, bytes([b])
        return Vocabulary(model.trainer_spec.model_type, pieces, byte_ids if min(byte_ids) >= 0 else [], unk, texts, norm.add_dummy_prefix)


class Matcher:
    """Finds and relaxes the pieces of many chunks at once."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.cut = finest_cut([t for _, t, _ in vocab.pieces])
        chars = sorted({c for _, t, _ in vocab.pieces for c in t})
        self.char = np.zeros(0x110000, np.uint16)  # 0: in no piece
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        order = sorted(vocab.pieces, key=lambda p: (-p[2], p[0]))
        rank = {p[0]: r for r, p in enumerate(order)}
        self.width = int(-(-max((len(p[1]) for p in vocab.pieces), default=1) // 8) * 8)
        flat = np.zeros((len(vocab.pieces), self.width), np.uint16)
        for i, (_, t, _) in enumerate(vocab.pieces):
            flat[i, : len(t)] = self.char[[ord(c) for c in t]]
        by = np.lexsort(flat.T[::-1])
        self.flat = flat[by]
        pieces = [vocab.pieces[i] for i in by]
        self.ids = np.array([p[0] for p in pieces], np.int32)
        self.rank = np.array([rank[p[0]] for p in pieces], np.int64)
        self.score = np.array([p[2] for p in pieces])
        self.length = np.array([len(p[1]) for p in pieces], np.int64)

    @staticmethod
    def _words(rows: np.ndarray, bits: int) -> list[np.ndarray]:
        """Rows of characters as 64-bit words of 64 / bits each, most significant first."""
        per = 64 // bits
        out = []
        for k in range(0, rows.shape[1], per):
            word = rows[:, k].astype(np.uint64)
            for j in range(k + 1, k + per):
                word = word << np.uint64(bits) | rows[:, j].astype(np.uint64)
            out.append(word)
        return out

    def suffixes(self, text: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """(positions but separators in order of their suffixes, the sorted keys); suffixes end at a separator or at the longest piece."""
        n, per = len(text), 64 // bits
        stops = np.flatnonzero(text == 0)
        left = np.repeat(stops, np.diff(stops, prepend=-1)) - np.arange(n)
        word = np.zeros(n + self.width, np.uint64)
        word[:n] = text
        step = 1
        while step < per:
            word[:-step] = word[:-step] << np.uint64(bits * step) | word[step:]
            step *= 2
        mask = np.array([(1 << 64) - (1 << (64 - bits * k)) for k in range(per + 1)], np.uint64)
        at = np.flatnonzero(text)
        left = left[at]
        keys = [word[at + k] & mask[np.clip(left - k, 0, per)] for k in range(0, self.width, per)]
        order = np.argsort(keys[0])
        first = keys[0][order]
        # equal first words are put in order by the others, unless these are all empty
        new = np.ones(len(first), bool)
        new[1:] = first[1:] != first[:-1]
        group = np.cumsum(new) - 1
        rest = np.zeros(group[-1] + 1 if len(group) else 0, bool)
        rest[group[left[order] > per]] = True
        tied = np.flatnonzero(rest[group])
        some = order[tied]
        order[tied] = some[np.lexsort([k[some] for k in keys[::-1]])]
        return at[order], [first] + [k[order] for k in keys[1:]]

    @staticmethod
    def _search(keys: list[np.ndarray], want: list[np.ndarray], low: np.ndarray, high: np.ndarray, upper: bool) -> np.ndarray:
        """Of each wanted row, the end of the suffixes below it (or not above it) between `low` and `high`."""
        low, high = low.copy(), high.copy()
        while (todo := np.flatnonzero(low < high)).size:
            mid = (low[todo] + high[todo]) >> 1
            right = np.full(len(todo), upper)
            for k, w in zip(keys[::-1], want[::-1], strict=True):
                a, b = k[mid], w[todo]
                right = np.where(a == b, right, a < b)
            low[todo] = np.where(right, mid + 1, low[todo])
            high[todo] = np.where(right, high[todo], mid)
        return low

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every occurrence of every piece, by position."""
        # the characters of this text, numbered densely: a word holds eight if they are few
        used = np.flatnonzero(np.bincount(text))
        used = used[used > 0]
        bits = 8 if len(used) < 255 else 16
        code = np.zeros(int(self.char.max()) + 1, np.uint16)
        code[used] = np.arange(1, len(used) + 1)
        rows = code[self.flat]
        whole = np.flatnonzero(np.count_nonzero(rows, axis=1) == self.length)
        rows, length = rows[whole], self.length[whole]
        low = self._words(rows, bits)
        rows[np.arange(self.width) >= length[:, None]] = (1 << bits) - 1
        high = self._words(rows, bits)
        order, keys = self.suffixes(code[text], bits)
        lo, hi = np.searchsorted(keys[0], low[0], "left"), np.searchsorted(keys[0], high[0], "right")
        far = np.flatnonzero((length > 64 // bits) & (lo < hi))
        want = [k[far] for k in low[1:]], [k[far] for k in high[1:]]
        lo[far], hi[far] = self._search(keys[1:], want[0], lo[far], hi[far], False), self._search(keys[1:], want[1], lo[far], hi[far], True)
        count = hi - lo
        piece = np.repeat(whole, count)
        start = order[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(len(piece))]
        shift = len(self.length).bit_length()
        both = start << shift | piece
        both.sort()
        return both >> shift, both & ((1 << shift) - 1)

    def segment(self, chunks: list[str]) -> list[np.ndarray]:
        """The ids of each chunk."""
        return [np.frombuffer(x, np.int32) for x in self.packed(chunks)]

    def packed(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, four bytes each."""
        if not chunks:
            return []
        joined = "\0".join(chunks) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        text = self.char[points]
        size = np.array([len(c) for c in chunks], np.int64)
        begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        text[begin + size] = 0
        start, piece = self.edges(text)
        relax = self._best if self.vocab.kind == UNIGRAM else self._merge
        bound, token = relax(text, start, piece, begin, size)
        # tokens: one for each boundary; -1 where no piece fits the character
        at = np.flatnonzero(bound)
        ids = token[at]
        cuts = np.searchsorted(at, np.append(begin, len(text)))
        raw, ends = ids.tobytes(), (4 * cuts).tolist()
        out = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for c in np.unique(np.searchsorted(cuts, np.flatnonzero(ids < 0), side="right") - 1).tolist():
            pairs = zip(ids[cuts[c] : cuts[c + 1]].tolist(), at[cuts[c] : cuts[c + 1]].tolist(), strict=True)
            out[c] = np.array([i for t, p in pairs for i in ([t] if t >= 0 else self._fallback(chr(points[p])))], np.int32).tobytes()
        return out

    def _fallback(self, char: str) -> list[int]:
        return [self.vocab.byte_ids[b] for b in char.encode()] if self.vocab.byte_ids else [self.vocab.unk]

    def _merge(self, text, start, piece, begin, size):
        """Relaxes edges by rank: the best edge of a chunk that two tokens fill becomes one token, the leftmost of equal ones first.

        Short chunks take a round for each token together; each long one takes
        time n log n by itself.
        """
        n = len(text)
        bound = np.ones(n + 1, bool)
        follow = np.arange(1, n + 2, dtype=np.int32)  # the boundary after each one
        token = np.full(n + 1, -1, np.int32)
        one = self.length[piece] == 1
        token[start[one]] = self.ids[piece[one]]
        start, piece = start[~one], piece[~one]
        chunk = np.repeat(np.arange(len(begin), dtype=np.int32), size + 1)[start]
        rank, ident = self.rank[piece].astype(np.int32), self.ids[piece]
        start, end = start.astype(np.int32), (start + self.length[piece]).astype(np.int32)
        if len(long := np.flatnonzero(size > LONG_CHUNK)):
            cuts = np.searchsorted(chunk, [long, long + 1])
            for c, lo, hi in zip(long.tolist(), *cuts.tolist(), strict=True):
                self._merge_one(int(begin[c]), int(size[c]), start[lo:hi], end[lo:hi], rank[lo:hi], ident[lo:hi], bound, token)
            live = np.flatnonzero(size[chunk] <= LONG_CHUNK)
            start, end, rank, ident, chunk = start[live], end[live], rank[live], ident[live], chunk[live]
        while len(start):
            # no boundary is ever added, so an edge with an end that is none, or none inside, is done with
            live = np.flatnonzero(bound[start] & bound[end] & (follow[start] < end))
            start, end, rank, ident, chunk = start[live], end[live], rank[live], ident[live], chunk[live]
            ready = np.flatnonzero(follow[follow[start]] == end)
            if not len(ready):
                break
            # edges are by position: the first of the best rank of its chunk wins
            c = chunk[ready]
            head = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            key = rank[ready].astype(np.int64) * (n + 1) + start[ready]
            best = np.minimum.reduceat(key, head)
            win = ready[key == np.repeat(best, np.diff(head, append=len(c)))]
            s = start[win]
            bound[follow[s]] = False
            follow[s] = end[win]
            token[s] = ident[win]
        bound[begin + size] = False  # separators are no tokens
        return bound[:n], token[:n]

    @staticmethod
    def _merge_one(base, size, start, end, rank, ident, bound, token):
        """One chunk from a heap of (rank, start) of the edges that two tokens fill; `bound` and `token` are changed."""
        first = memoryview(np.searchsorted(start, np.arange(base, base + size + 1)))
        ends, ranks, idents = (memoryview(np.ascontiguousarray(x)) for x in (end - np.int32(base), rank, ident))
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))  # the tokens beside each token
        filled = [-1] * size  # the edge that this token and the next one fill
        heap = []

        def look(s):
            m = after[s]
            filled[s] = -1
            if m < size:
                e = after[m]
                for k in range(first[s], first[s + 1]):
                    if ends[k] == e:
                        filled[s] = k
                        heapq.heappush(heap, (ranks[k] << 40) + s)
                        return

        for s in range(size):
            look(s)
        while heap:
            top = heapq.heappop(heap)
            s = top & ((1 << 40) - 1)
            k = filled[s]
            if k < 0 or ranks[k] != top >> 40:
                continue  # filled by other tokens since
            m = after[s]
            bound[base + m] = False
            filled[m] = -1
            token[base + s] = idents[k]
            after[s] = after[m]
            if after[s] < size:
                before[after[s]] = s
            look(s)
            if s:
                look(before[s])

    def _best(self, text, start, piece, begin, size):
        """Relaxes edges by end: the path of the largest total score; an unknown character costs more than any piece."""
        n = len(text)
        penalty = self.score.min(initial=0) - 10.0
        known = np.zeros(n, bool)
        known[start[self.length[piece] == 1]] = True
        lone = np.flatnonzero(~known)
        lone = lone[~np.isin(lone, begin + size)]
        start = np.concatenate([start, lone])
        end = np.concatenate([start[: len(piece)] + self.length[piece], lone + 1])
        score = np.concatenate([self.score[piece], np.full(len(lone), penalty)])
        ident = np.concatenate([self.ids[piece], np.full(len(lone), -1, np.int32)])
        chunk = np.searchsorted(begin, start, side="right") - 1
        step = end - begin[chunk]
        order = np.lexsort((start, end, step))
        start, end, score, ident, step = start[order], end[order], score[order], ident[order], step[order]
        total = np.full(n + 1, -np.inf)
        total[begin] = 0.0
        back = np.full(n + 1, -1, np.int64)
        cuts = np.searchsorted(step, np.arange(1, step.max(initial=0) + 2))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            s = total[start[lo:hi]] + score[lo:hi]
            e = end[lo:hi]
            np.maximum.at(total, e, s)
            hit = np.flatnonzero(s == total[e])
            back[e[hit][::-1]] = lo + hit[::-1]  # of equal ones the longest
        bound, token = np.zeros(n, bool), np.full(n, -1, np.int32)
        at = begin + size
        while len(at := at[at > begin[np.searchsorted(begin, at, side="right") - 1]]):
            e = back[at]
            at = start[e]
            bound[at] = True
            token[at] = ident[e]
        return bound, token


class Codec:
    """Encodes batches of texts; a worker keeps one for each vocabulary."""

    def __init__(self, vocab: Vocabulary, lean: bool = False):
        self.matcher, self.vocab, self.lean = Matcher(vocab), vocab, lean
        self.batch = LEAN_CHARS if lean else INDEX_CHARS
        self.cut = self.matcher.cut

    def _marked(self, text: str) -> str:
        return (MARK if self.vocab.prefix else "") + text.replace(" ", MARK)

    def chunks(self, text: str) -> list[str]:
        return self.cut.findall(self._marked(text)) if text else []

    def _index(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, four bytes each, in the order of the chunks."""
        out: list[bytes] = [b""] * len(chunks)
        order = sorted(range(len(chunks)), key=lambda i: len(chunks[i]))  # of like length, so that all end after as many rounds
        todo, held = [], 0
        for k, i in enumerate(order):
            todo.append(i)
            held += len(chunks[i]) + 1
            if held >= self.batch or k == len(order) - 1:
                for j, ids in zip(todo, self.matcher.packed([chunks[j] for j in todo]), strict=True):
                    out[j] = ids
                todo, held = [], 0
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        # each distinct chunk of the batch is held once, a text as the numbers of its chunks
        number: dict[str, int] = defaultdict(count().__next__)
        cut = [np.fromiter(map(number.__getitem__, (m.group() for m in self.cut.finditer(self._marked(t)))), np.int32) if t else np.zeros(0, np.int32) for t in texts]
        ids = self._index(list(number))
        del number
        if self.lean:
            give_back()
        return [np.frombuffer(b"".join(map(ids.__getitem__, c.tolist())), np.int32) for c in cut]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.vocab.texts.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return raw[1:] if self.vocab.prefix and raw.startswith(" ") else raw


_CODECS: dict[tuple, Codec] = {}


def codec(vocab: Vocabulary, lean: bool = False) -> Codec:
    key = (vocab.kind, len(vocab.pieces), hash(tuple(vocab.pieces)), lean)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(vocab, lean)
    return _CODECS[key]


def encode_texts(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text", decode: bool = True, lean: bool = False) -> DataFrame:
    """``doc_id, ids`` and, if asked for, ``decoded`` for each row: the ids of its whole text, and these decoded again.

    `lean` workers hold less and take longer; the ids are the same.

    * null text: counts as empty, no ids and ''.
    * characters in no piece become byte pieces, or the unknown piece if the model has none.
    * very long texts: a text is encoded whole, and one run of letters takes time n log n.
    * null ids are passed on; repeated rows get equal ids; other columns are ignored, whatever their names.
    * empty table: empty result.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab, lean)
        for s in text_slices(batches, max_bytes=LEAN_BYTES if lean else BATCH_BYTES):
            ids = c.encode(s.column("text").to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            cols = [s.column("doc_id"), lists]
            if decode:
                cols.append(pa.array([c.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "decoded"][: len(cols)])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>" + ", decoded string" * decode)


def digest(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """The thin view of the query: number and hash of the ids, and the hash of what they decode to."""
    out = encode_texts(docs, vocab)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

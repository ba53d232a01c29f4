"""Language identification by cross-parsing.

For each language a suffix automaton holds all substrings of a bounded sample
of its text.  A document is parsed into the fewest phrases that occur in the
sample: walking the automaton yields the longest match, and where it fails a
new phrase starts.  c phrases over n bytes against a sample of N bytes cost
about c * log2(N) / n bits a byte; the cheapest language wins.

Many pieces of many documents walk all automata in lockstep, so a step of the
parse is one table look-up per piece and language in numpy.  Where a phrase
crosses into a piece, that piece is walked again from the state in which the
one before it ended, until both walks are in the same state: the phrases are
those of one walk over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, raw_strings, text_slices

#: Bounds of the training sample: normalised bytes a language, passages a language (one of a document, about), characters a passage.
TRAIN_BYTES, TRAIN_PASSAGES, PASSAGE_CHARS = 40_000, 80, 520
#: Texts are walked in pieces of this many normalised bytes, and so many pieces at once.
PIECE, PIECES = 512, 4_096
UNKNOWN = "und"
_GAP = 0x20


def _letters() -> np.ndarray:
    keep = np.zeros(256, bool)
    keep[97:123] = keep[0x80:] = True
    return keep


_LETTER = _letters()


def normalise(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with each run of bytes outside letters made one blank; (bytes, starts)."""
    if not len(data):
        return data, starts
    letter = _LETTER[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first byte of a gap stays, as a blank
    out = np.where(letter, data, _GAP)[keep]
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return out, total[starts]


class Automata:
    """The suffix automata of all languages as one transition table.

    A cell holds (next state << 2) + phrases that end on this byte.
    """

    def __init__(self, samples: list[bytes]):
        used = np.unique(np.frombuffer(b"".join(samples), np.uint8))
        self.code = np.full(256, len(used), np.uint8)  # the code after the used ones: bytes of no sample
        self.code[used] = np.arange(len(used))
        self.width, self.pad = len(used) + 2, len(used) + 1
        tables, self.roots, base = [], [], 0
        for sample in samples:
            tables.append(self._table(self.code[np.frombuffer(sample, np.uint8)].tolist(), base))
            self.roots.append(base)
            base += len(tables[-1])
        self.table = np.concatenate(tables).ravel()
        self.bits = np.log2([max(2, len(s)) for s in samples])

    def _table(self, text: list[int], base: int) -> np.ndarray:
        nxt, link, length, last = [{}], [-1], [0], 0
        for c in text:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    twin = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[cur] = twin
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = twin
                        p = link[p]
            last = cur
        row = np.full(self.width, (base << 2) + 2, np.int32)  # the phrase ends, and the unknown byte is one more
        for c, t in nxt[0].items():
            row[c] = ((base + t) << 2) + 1
        row[self.pad] = (base << 2) + 1
        table = np.tile(row, (len(nxt), 1))
        at = np.repeat(np.arange(len(nxt)), [len(d) for d in nxt])
        table[at, [c for d in nxt for c in d]] = (np.array([t for d in nxt for t in d.values()], np.int64) + base) << 2
        table[0, np.flatnonzero((row & 3) == 2)] -= 1
        table[0, self.pad] = base << 2
        return table

    def phrases(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Phrases of each text in each language, as [language, text]; a phrase crosses pieces like any other bytes."""
        size = np.diff(starts)
        pieces = -(-size // PIECE)
        first = np.concatenate([[0], np.cumsum(pieces)])
        inner = np.ones(first[-1], bool)  # pieces that go on from the one before
        inner[first[:-1][pieces > 0]] = False
        last = np.append(~inner[1:], True)[: len(inner)]
        total = np.zeros((len(self.roots), first[-1] + 1), np.int64)
        state = np.array(self.roots, np.int64)
        for lo in range(0, int(first[-1]), PIECES):
            hi = min(lo + PIECES, int(first[-1]))
            begin, end = np.searchsorted(first, [lo, hi], side="right") - 1
            flat = np.full((hi - lo) * PIECE, self.pad, np.uint8)
            # the bytes of pieces lo..hi: of the texts from `begin` on, perhaps with parts of the first and the last
            a = starts[begin] + (lo - first[begin]) * PIECE
            b = min(starts[end] + (hi - first[end]) * PIECE, starts[end + 1]) if end < len(size) else starts[-1]
            at = np.arange(a, b)
            text = np.searchsorted(starts, at, side="right") - 1
            flat[(first[text] - lo) * PIECE + at - starts[text]] = self.code[data[a:b]]
            count, state = self._walk(np.ascontiguousarray(flat.reshape(-1, PIECE).T), inner[lo:hi], last[lo:hi], state)
            total[:, lo + 1 : hi + 1] = count
        np.cumsum(total, axis=1, out=total)
        return total[:, first[1:]] - total[:, first[:-1]]

    def _walk(self, steps: np.ndarray, inner: np.ndarray, last: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases that end in each piece, state after the last); `state` is that before the first, if it goes on."""
        roots = np.array(self.roots, np.int64)[:, None]
        cells = np.empty((len(steps), len(roots), steps.shape[1]), np.int32)
        now = np.repeat(roots, steps.shape[1], axis=1)
        for k, row in enumerate(steps):
            cells[k] = self.table[now * self.width + row]
            now = (cells[k] >> 2).astype(np.int64)
        entry = np.repeat(roots, steps.shape[1], axis=1)
        while True:
            before = np.concatenate([state[:, None], now[:, :-1]], axis=1)
            lang, piece = np.nonzero((before != entry) & inner)
            if not len(piece):
                break
            entry[lang, piece] = at = before[lang, piece]
            for k in range(len(steps)):
                cell = self.table[at * self.width + steps[k, piece]]
                new = (cell >> 2) != (cells[k, lang, piece] >> 2)
                cells[k, lang, piece] = cell
                lang, piece, at = lang[new], piece[new], (cell[new] >> 2).astype(np.int64)
                if not len(piece):
                    break
            now[lang, piece] = at
        count = (cells & 3).sum(axis=0, dtype=np.int64)
        count[:, last] += now[:, last] != roots  # a text's last phrase ends with it
        return count, now[:, -1]


@lru_cache(maxsize=2)
def _automata(samples: tuple[bytes, ...]) -> Automata:
    return Automata(list(samples))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Training text by language from labelled rows; the bounds are at the top of this file.

    Documents are drawn by a hash of id and text at a rate that depends on how
    many each language has; each gives a passage from a place in its whole text
    that a hash chooses, and equal passages count once.  Rows with a null id,
    text or language aren't learned from.
    """
    d = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("i IS NOT NULL AND t IS NOT NULL AND l IS NOT NULL")
    counts = {r["l"]: r["n"] for r in d.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    draw = F.pmod(F.xxhash64("i", "t", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    place = F.pmod(F.xxhash64("t", F.lit("place")), F.greatest(F.length("t") - PASSAGE_CHARS, F.lit(0)) + 1) + 1
    rate = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, TRAIN_PASSAGES / n)))])
    drawn = d.where(draw < F.element_at(rate, F.col("l"))).select("l", F.substring("t", place.cast("int"), F.lit(PASSAGE_CHARS)).alias("t"))
    rows = drawn.distinct().withColumn("h", F.xxhash64("t")).collect()
    texts: dict[str, list[bytes]] = {k: [] for k in sorted(counts)}
    for r in sorted(rows, key=lambda r: (r["l"], r["h"], r["t"])):
        raw = np.frombuffer(r["t"].lower().encode(), np.uint8)
        texts[r["l"]].append(normalise(raw, np.array([0, len(raw)]))[0].tobytes())
    # equal shares, so that one mixed or repetitive document doesn't shape the sample
    out = {k: b" ".join(t[: max(1, TRAIN_BYTES // len(ts))] for t in ts if t)[:TRAIN_BYTES] for k, ts in texts.items() if ts}
    return {k: v for k, v in out.items() if v}


def predict(docs: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, phrases`` for each row; only the text is looked at.

    * null text, or one without a letter: 'und' with score 0.
    * ties go to the language first in order; without any training text all are 'und'.
    * a null id is passed on; repeated rows get equal answers; very long texts are parsed whole.
    * empty table: empty result; other columns are ignored, whatever their names.
    """
    names, samples = list(model), tuple(model.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in text_slices(batches, transform=lambda a: pc.utf8_lower(a.fill_null(""))):
            lettered = pc.match_substring_regex(s.column("text").fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
            n = len(s)
            best, score, phrases = np.full(n, -1), np.zeros(n), np.zeros(n, np.int64)
            if names:
                a = _automata(samples)
                data, starts = normalise(s.data, s.starts)
                count = a.phrases(data, starts)
                bits = count * a.bits[:, None] / np.maximum(1, np.diff(starts))
                best = np.argmin(bits, axis=0)
                score = 1 / np.exp(-10 * (bits - bits.min(axis=0))).sum(axis=0)
                phrases = count[best, np.arange(n)]
            best, score = np.where(lettered, best, -1), np.where(lettered & (best >= 0), score, 0.0)
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array([*names, UNKNOWN], pa.string()).take(pa.array(np.where(best < 0, len(names), best))), pa.array(score), pa.array(phrases)], names=["doc_id", "lang_pred", "score", "phrases"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, phrases long")


def identify(docs: DataFrame) -> DataFrame:
    """The query: learns from the folds that aren't held out, answers for all rows."""
    fold = held_out(F.col("doc_id"), 4, 2)
    model = fit(docs.where(~fold))
    return predict(docs, model).select("doc_id", fold.alias("held_out"), "lang_pred", "score", "phrases")

"""N-gram Jaccard join as a blocked sparse matrix product.

Rows of the matrix are documents with one set of shingles (copies share a
row), columns are shingles.  It is never built in one place:

1. Columns are dealt into blocks by their hash.  A block finds the columns
   that hold more than one row; only these add to an overlap.  Very common
   columns, found on a bounded sample, are taken as shared without being
   dealt, so none of them meets in one task.
2. Overlap a row can have with any other is at most its number of shared
   columns.  A row of n shingles with less than 0.75 n of them is discarded.
3. The remaining rows are grouped: of two rows that link, the n - 0.75 n + 1
   rarest columns of each have one in common, so the components over these
   columns hold all links.
4. Within a group, rows of the product are accumulated from posting lists and
   cut at the size-derived bound.  A row is multiplied only while it can still
   join two components.  A large group is split into blocks, each with some
   rows that all blocks share; only rows that are not in the group's largest
   component after that meet all blocks of the group.

Blocks cross the shuffle as packed arrays.  Shingles are compared by 52-bit
hashes, sets by 64-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, TextSlice, checkpoint, few, lean, mix64, prefix_hash, range_hash, text_slices, word_bounds
from .components import connected_components, forest
from .packing import PACKED, block_bits, heads, joined, packed, runs, text_totals, values

U = np.uint64
HASH_BITS = 52
#: Text bytes for each block of columns, and the bits of the smallest and largest number of blocks.
BLOCK_BYTES, MIN_BITS, MAX_BITS = 12 << 20, 6, 24
#: The sample from which very common columns are taken: documents, how many of them hold such a column, and the most
#: columns known to all tasks.  Which columns these are changes how they travel, not what links.
SAMPLE_DOCS, SAMPLE_HITS, COMMON_COLUMNS = 2_000, 8, 100_000
#: Rows of a group that one task looks at (twice as many for a pair of blocks), and rows that all blocks of a group share, about.
GROUP_ROWS, HUBS = 500, 16
#: Shingles buffered by a task before they are dealt.
BUFFER = 500_000


def need(n, percent: int):
    """Shared shingles that a set of n needs at least to link with any other."""
    return -(-n * percent // 100)


def shingle_sets(s: TextSlice, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, document after document; number of each document)."""
    first, last, doc = word_bounds(s.data, s.starts, SPACE)
    w = mix64(range_hash(prefix_hash(LOWER[s.data]), first, last))
    c = mix64(np.arange(11, 11 + k, dtype=U)) | U(1)
    m = len(w) - k + 1
    if m > 0:
        h = w[:m] * c[0]
        for i in range(1, k):
            h += w[i : m + i] * c[i]
        ok = doc[: m] == doc[k - 1 :]
        h, d = h[ok], doc[:m][ok]
    else:
        h, d = w[:0], doc[:0]
    words = np.bincount(doc, minlength=len(s))
    short = (words > 0) & (words < k)
    if short.any():
        at = np.flatnonzero(short[doc])
        begin = np.searchsorted(doc, np.flatnonzero(short))
        place = at - np.repeat(begin, words[short])
        whole = np.add.reduceat(w[at] * c[place], np.flatnonzero(place == 0)) + words[short].astype(U)
        h, d = np.concatenate([h, whole]), np.concatenate([d, np.flatnonzero(short)])
    key = (d.astype(U) << U(HASH_BITS)) | (mix64(h) >> U(64 - HASH_BITS))
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    n = np.bincount((key >> U(HASH_BITS)).astype(np.int64), minlength=len(s))
    return key & U((1 << HASH_BITS) - 1), n


def fingerprints(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, 0 for the empty one."""
    total = np.zeros(len(h) + 1, U)
    np.cumsum(mix64(h + U(0x51ED27)), out=total[1:])
    end = np.cumsum(n)
    out = mix64((total[end] - total[end - n]) + n.astype(U) * U(0x9E3779B97F4A7C15))
    return np.where(n > 0, out, U(0)).view(np.int64)


SHARED, DOCS, COLUMNS = 0, 1, 2


def _by_owner(owner: np.ndarray, n: np.ndarray, h: np.ndarray, df: np.ndarray, blocks: int) -> list[tuple]:
    """Packed rows (block of the owner; owners, their n, counts, hashes, frequencies) for shared columns."""
    block = (mix64(owner.view(U)) % U(blocks)).astype(np.int64)
    order = np.lexsort((owner, block))
    owner, n, h, df, block = owner[order], n[order], h[order], df[order], block[order]
    head = heads(owner)
    cuts = heads(block)
    rows = []
    for lo, hi in runs(cuts, len(owner)):
        x = head[np.searchsorted(head, lo) : np.searchsorted(head, hi)]
        rows.append((int(block[lo]), SHARED, owner[x], n[x].astype(np.uint32), np.diff([*x, hi]).astype(np.uint32), h[lo:hi], df[lo:hi]))
    return rows


def _deal(bits: int, blocks: int, common: np.ndarray, k: int):
    """Texts to packed rows: columns by hash (key < 2^bits), common columns by owner, and the documents."""
    rest = U(HASH_BITS - bits)

    def flush(owner, n, count, h):
        own = np.repeat(np.arange(len(owner)), count)
        rows = []
        if len(common):
            at = np.minimum(np.searchsorted(common, h), len(common) - 1)
            hot = common[at] == h
            o = own[hot]
            # kind SHARED on its way to the owners: any task passes it on
            rows += [(r[0] + (1 << bits), *r[1:]) for r in _by_owner(owner[o], n[o], h[hot], np.full(len(o), 65535, np.uint16), blocks)]
            h, own = h[~hot], own[~hot]
        block = (h >> rest).astype(np.uint32)
        order = np.argsort(block.astype(np.uint16) if bits <= 16 else block, kind="stable")
        h, own = h[order] & ((U(1) << rest) - U(1)), own[order]
        cuts = np.searchsorted(block[order], np.arange((1 << bits) + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            lo, hi = cuts[b], cuts[b + 1]
            head = np.flatnonzero(np.concatenate([[True], own[lo + 1 : hi] != own[lo : hi - 1]]))
            who = own[lo:hi][head]
            x = h[lo:hi]
            meta = np.concatenate([n[who].astype(np.uint32), np.diff([*head, hi - lo]).astype(np.uint32)])
            rows.append((int(b), COLUMNS, owner[who], meta, (x & U(0xFFFFFFFF)).astype(np.uint32), (x >> U(32)).astype(np.uint16), None))
        return packed(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        kept: list[tuple] = []
        held = 0
        for s in text_slices(batches):
            h, n = shingle_sets(s, k)
            mark = fingerprints(h, n)
            ids = s.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            first = np.zeros(len(s), bool)
            for i in np.flatnonzero(known & (n > 0)):
                # a copy of a set that this task has dealt adds no column
                if (x := int(mark[i])) not in seen:
                    seen.add(x)
                    first[i] = True
            if len(seen) > 2_000_000:
                seen.clear()
            kept.append((mark[first], n[first], h[np.repeat(first, n)]))
            held += int(n[first].sum())
            lost = int((~known).sum())
            tags = s.column("tag").to_numpy(zero_copy_only=False)
            doc = [((1 << bits) + blocks + int(s.starts[-1]) % blocks, DOCS, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), n.astype(np.uint32), mark, known if lost else None, tags)]
            yield packed(doc)
            if held >= BUFFER:
                o, c, x = (np.concatenate(z) for z in zip(*kept, strict=True))
                yield flush(o, c, c, x)
                kept, held = [], 0
        if held:
            o, c, x = (np.concatenate(z) for z in zip(*kept, strict=True))
            yield flush(o, c, c, x)

    return run


def _shared(bits: int, blocks: int):
    """One block of columns: keeps those with more than one row and sends them to the blocks of their owners."""

    def run(table: pa.Table) -> pa.Table:
        key = table["key"][0].as_py()
        if key >= 1 << bits:  # on its way to the owners, or documents
            return table.set_column(0, "key", pa.array([key - (1 << bits)] * table.num_rows, pa.int64()))
        owners, ns, counts = [], [], []
        for a, b in zip(table["a"], table["b"], strict=True):
            o, m = values(a, np.int64), values(b, np.uint32)
            owners.append(o)
            ns.append(m[: len(o)])
            counts.append(m[len(o) :])
        owner, n, count = (np.concatenate(x) for x in (owners, ns, counts))
        h = joined(table, "c", np.uint32).astype(U) | (joined(table, "d", np.uint16).astype(U) << U(32))
        own = np.repeat(np.arange(len(owner)), count)
        order = np.argsort(h)
        h, own = h[order], own[order]
        same = h[1:] == h[:-1]
        more = np.zeros(len(h), bool)
        more[1:] |= same
        more[:-1] |= same
        h, own = h[more], own[more]
        o = owner[own]
        order = np.lexsort((o, h))  # copies dealt by several tasks count once
        h, own, o = h[order], own[order], o[order]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        h, own, o = h[once], own[once], o[once]
        head = heads(h)
        size = np.diff([*head, len(h)])
        df = np.repeat(np.minimum(size, 65534).astype(np.uint16), size)
        ok = df > 1
        full = h[ok] | (U(key) << U(HASH_BITS - bits))
        return pa.Table.from_batches([packed(_by_owner(o[ok], n[own[ok]], full, df[ok], blocks))])

    return run


_ROWS = "doc_id long, n long, mark long, columns binary, frequencies binary, tag long"


def _survivors(blocks: int, percent: int):
    """Rows with enough shared columns, and the documents as they are."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("mark", pa.int64()), ("columns", pa.binary()), ("frequencies", pa.binary()), ("tag", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        if table["key"][0].as_py() >= blocks:
            ids, n, mark = joined(table, "a", np.int64), joined(table, "b", np.uint32), joined(table, "c", np.int64)
            known = np.concatenate([values(d, bool) if d.is_valid else np.ones(len(values(a, np.int64)), bool) for a, d in zip(table["a"], table["d"], strict=True)])
            none = pa.nulls(len(ids), pa.binary())
            return pa.Table.from_arrays([pa.array(ids, mask=~known), pa.array(n.astype(np.int64)), pa.array(mark), none, none, pa.array(joined(table, "e", np.int64))], schema=schema)
        owner, n, count = joined(table, "a", np.int64), joined(table, "b", np.uint32), joined(table, "c", np.uint32)
        h, df = joined(table, "d", np.uint64), joined(table, "e", np.uint16)
        row = np.repeat(np.arange(len(owner)), count)
        o = owner[row]
        order = np.lexsort((h, o))
        o, h, df, row = o[order], h[order], df[order], row[order]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        o, h, df, row = o[once], h[once], df[once], row[once]
        head = heads(o)
        size = np.diff([*head, len(o)])
        full = n[row[head]].astype(np.int64)
        out = [(None, int(full[i]), int(o[head[i]]), h[head[i] : head[i] + size[i]].tobytes(), df[head[i] : head[i] + size[i]].tobytes(), None) for i in np.flatnonzero(size >= need(full, percent))]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, schema.types, strict=True)], schema=schema)

    return run


def _rarest(batch: pa.RecordBatch, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(column, mark) of the columns by which each row must meet any row that it links with."""
    hs, ms = [], []
    for n, mark, c, f in zip(batch.column("n"), batch.column("mark"), batch.column("columns"), batch.column("frequencies"), strict=True):
        h, df = values(c, np.uint64), values(f, np.uint16)
        n = n.as_py()
        take = n - need(n, percent) + 1 - (n - len(h))  # columns of its own come first and meet nothing
        hs.append(h[np.lexsort((h, df))[: max(0, take)]])
        ms.append(np.full(len(hs[-1]), mark.as_py(), np.int64))
    return np.concatenate(hs), np.concatenate(ms)


def _stars(h: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(columns, first row of each; links between rows that share a column, as a star forest)."""
    order = np.lexsort((m, h))
    h, m = h[order], m[order]
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    first = m[new][np.cumsum(new) - 1] if len(h) else m
    a, b = forest(first[~new], m[~new])
    return h[new], m[new], a, b


def _candidates(bits: int, blocks: int, percent: int):
    """Columns by block, one row a task for each; the links that a task finds itself go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h, m, a, b = _stars(*_rarest(batch, percent))
            rows = [((1 << bits) + int(m[0] if len(m) else 0) % blocks, SHARED, a, b, None, None, None)] if len(a) else []
            block = (h >> U(HASH_BITS - bits)).astype(np.int64)
            cuts = np.searchsorted(block, np.arange((1 << bits) + 1))
            rows += [(int(k), COLUMNS, m[cuts[k] : cuts[k + 1]], h[cuts[k] : cuts[k + 1]], None, None, None) for k in np.flatnonzero(np.diff(cuts))]
            yield packed(rows)

    return run


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINKS)


def _meet(bits: int):
    def run(table: pa.Table) -> pa.Table:
        if table["key"][0].as_py() >= 1 << bits:
            return _links(joined(table, "a", np.int64), joined(table, "b", np.int64))
        _, _, a, b = _stars(joined(table, "b", np.uint64), joined(table, "a", np.int64))
        return _links(a, b)

    return run


def overlaps(ptr: np.ndarray, col: np.ndarray, posts: np.ndarray, pptr: np.ndarray, row: int) -> np.ndarray:
    """One row of the product: the overlap of `row` with every row."""
    c = col[ptr[row] : ptr[row + 1]]
    size = pptr[c + 1] - pptr[c]
    at = np.repeat(pptr[c] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return np.bincount(posts[at], minlength=len(ptr) - 1)


def link_group(sets: list[np.ndarray], n: np.ndarray, percent: int, todo: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Links (as positions) that have the components of all links between the sets.

    `sets` hold the shared columns, `n` the full sizes.  The row of the product
    with the most overlap comes first; all that link with it form a star, so
    afterwards only links with an end outside that star can join components,
    and only the rows of those are multiplied.  Links between rows that are not
    in `todo` (a mask, if given) are known already and not looked for.
    """
    size = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    _, col, df = np.unique(flat, return_inverse=True, return_counts=True)
    ptr = np.concatenate([[0], np.cumsum(size)])
    pptr = np.concatenate([[0], np.cumsum(df)])
    posts = np.repeat(np.arange(len(sets)), size)[np.argsort(col, kind="stable")]
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b, parts = [], [], len(sets)
    reach = np.add.reduceat(df[col].astype(np.int64), ptr[:-1]) if size.all() else np.array([df[col[ptr[i] : ptr[i + 1]]].sum() for i in range(len(sets))])
    skip = np.zeros(len(sets), bool) if todo is None else ~todo
    for turn, i in enumerate(np.argsort(-reach, kind="stable")):
        if skip[i] or parts == 1:
            continue
        both = overlaps(ptr, col, posts, pptr, i)
        hit = np.flatnonzero((both > 0) & (100 * both >= percent * (n[i] + n - both)))
        if turn == 0 and todo is None:
            skip[hit] = True
        for j in hit:
            if (x := root(i)) != (y := root(j)):
                parent[y] = x
                parts -= 1
                a.append(int(i))
                b.append(int(j))
    return a, b


def _verify(percent: int):
    def run(table: pa.Table) -> pa.Table:
        # one set may come twice if it was written by two tasks
        comp, mark, n, rest = (table[x].to_numpy() for x in ("component", "mark", "n", "rest"))
        order = np.lexsort((~rest, mark, comp))
        once = np.ones(len(order), bool)
        once[1:] = (mark[order][1:] != mark[order][:-1]) | (comp[order][1:] != comp[order][:-1])
        order = order[once]
        cuts = heads(comp[order])
        columns, a, b = table["columns"], [], []
        for lo, hi in runs(cuts, len(order)):
            if hi - lo > 1:
                x = order[lo:hi]
                i, j = link_group([values(columns[int(k)], np.uint64) for k in x], n[x], percent, None if rest[x].all() else rest[x])
                a.append(mark[x][i])
                b.append(mark[x][j])
        none = [np.zeros(0, np.int64)]
        return _links(np.concatenate(a or none), np.concatenate(b or none))

    return run


def common_columns(docs: DataFrame, k: int, n: int) -> np.ndarray:
    """Hashes of the shingles that many documents of a bounded sample of `n` hold, sorted."""
    draw = F.pmod(F.xxhash64("doc_id", F.lit("shingles")), F.lit(1 << 30)) / float(1 << 30)
    sample = docs.where((draw < SAMPLE_DOCS / max(1, n)) & (F.length("text") < 200_000)).limit(2 * SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in text_slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(s, k)[0].view(np.int64))], names=["h"])

    hits = sample.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= SAMPLE_HITS)
    got = hits.orderBy(F.desc("n"), "h").limit(COMMON_COLUMNS).select("h").toArrow()["h"].to_numpy()
    return np.sort(got).astype(U)


def _verified(sets: DataFrame, tasks: DataFrame, percent: int) -> DataFrame:
    work = sets.select("n", "mark", "columns").join(tasks.withColumnRenamed("vertex", "mark"), "mark")
    return work.groupBy("task").applyInArrow(lean(_verify(percent)), "a long, b long")


def _blocks(large: DataFrame) -> DataFrame:
    """Tasks for the blocks of large groups: each row in its own, some rows in all blocks of their group."""
    hub = F.pmod(F.xxhash64("vertex", F.lit("hub")), F.col("rows")) < HUBS
    at = F.explode(F.when(hub, F.sequence(F.lit(0), F.col("shards") - 1)).otherwise(F.array("shard"))).alias("at")
    return large.select("vertex", "component", at).select("vertex", "component", F.xxhash64("component", "at").alias("task"), F.lit(True).alias("rest"))


def _remaining(large: DataFrame, linked: DataFrame) -> DataFrame | None:
    """Tasks for the rows outside the largest component found so far in their group: they meet all rows of the group; None if no row is."""
    linked = linked.select("vertex", F.col("component").alias("class"))
    rows = checkpoint(large.join(linked, "vertex", "left").withColumn("class", F.coalesce("class", "vertex")))
    largest = rows.groupBy("component", "class").agg(F.count("*").alias("size")).groupBy("component").agg(F.max(F.struct("size", "class"))["class"].alias("largest"), F.sum("size").alias("all"), F.max("size").alias("size"))
    largest = checkpoint(largest.where(F.col("all") > F.col("size")).withColumn("parts", F.ceil((F.col("all") - F.col("size")) / GROUP_ROWS).cast("int")))
    if largest.isEmpty():
        return None
    rows = rows.join(few(largest), "component")
    part = F.pmod(F.xxhash64("vertex", F.lit("part")), F.col("parts")).cast("int")
    outside = rows.where(F.col("class") != F.col("largest")).select("vertex", "component", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(True).alias("rest"))
    others = rows.select("vertex", "component", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "shard", F.lit(False).alias("rest"))
    return outside.unionByName(others).select("vertex", "component", F.xxhash64("component", "part", "shard", F.lit("part")).alias("task"), "rest")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, tag: Column | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row; 100 * overlap >= percent * union links two documents.

    With a long `tag` of each row, also ``tag`` and ``group``: rows with shingles
    have equal groups if and only if links connect them, whatever their ids.

    * null or empty text, or one without words: no shingles, a component of its own.
    * fewer than k words: the whole sequence is the one shingle.
    * very long texts: a text is looked at whole by one task.
    * null ids: counted, linked with nothing, component null.
    * rows that repeat an id are compared like any others and carry that id.
    * empty table: empty result; other columns are ignored.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.lit(0).cast("long") if tag is None else tag).alias("tag"))
    n_rows, size = text_totals(d, "text")
    bits = block_bits(size, BLOCK_BYTES, MIN_BITS, MAX_BITS)
    blocks = 1 << bits
    dealt = d.mapInArrow(_deal(bits, blocks, common_columns(d, k, n_rows), k), PACKED)
    shared = dealt.groupBy("key").applyInArrow(lean(_shared(bits, blocks)), PACKED)
    rows = checkpoint(shared.groupBy("key").applyInArrow(lean(_survivors(blocks, percent)), _ROWS))
    sets = rows.where("columns IS NOT NULL").select("n", "mark", "columns", "frequencies")
    meet = sets.mapInArrow(_candidates(bits, blocks, percent), PACKED).groupBy("key").applyInArrow(lean(_meet(bits)), "a long, b long")
    groups = connected_components(meet)
    sizes = groups.groupBy("component").agg(F.count("*").alias("rows"))
    groups = checkpoint(groups.join(sizes, "component").withColumn("shards", F.ceil(F.col("rows") / GROUP_ROWS).cast("int")))
    total, most = groups.agg(F.count("*"), F.coalesce(F.max("shards"), F.lit(0))).first()
    verified = lambda tasks: _verified(sets, tasks, percent)
    small = groups.where("shards = 1").select("vertex", "component", F.pmod(F.xxhash64("component"), F.lit(max(32, total // GROUP_ROWS))).alias("task"), F.lit(True).alias("rest"))
    if most > 1:
        large = groups.where("shards > 1").withColumn("shard", F.pmod(F.xxhash64("vertex"), F.col("shards")).cast("int"))
        links = checkpoint(verified(small.unionByName(_blocks(large))))
        if (tasks := _remaining(large, connected_components(links))) is not None:
            links = links.union(verified(tasks))
    else:
        links = verified(small)
    linked = connected_components(links).select(F.col("vertex").alias("mark"), "component")
    docs_ = rows.where("columns IS NULL").select("doc_id", "n", "mark", "tag")
    classes = docs_.where("n > 0").groupBy("mark").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = classes.join(linked, "mark", "left").where("copies > 1 OR component IS NOT NULL")
    classes = checkpoint(classes.select("mark", "rep", F.coalesce("component", "mark").alias("component")))
    lowest = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = classes.join(lowest, "component").select("mark", "component_id", "component")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id")))
    more = [] if tag is None else ["tag", F.coalesce("component", "mark").alias("group")]
    return docs_.join(named, "mark", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), *more)

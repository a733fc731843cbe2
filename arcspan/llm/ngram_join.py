"""Similarity self-join of documents on their sets of word shingles (Jaccard), with components.

The product of the document by shingle matrix with its transpose, computed in blocks and only where
it can matter. Exactly equal sets (two 64-bit sums agree) are one class from the start.

1. Shingles are counted. Each task packs the (document, shingle) entries of a chunk of documents by
   parts of the hash range, five bytes an entry; a part finds the shingles that several documents
   hold and sends each chunk a code of these, four bytes an entry, which tells how common they are. Shingles of a large share of all
   documents (`hot`) are known before and are not sent, so no part gets more than its share.
2. Two sets link only if their overlap reaches ceil(least * n) of either. So a document with fewer
   shared shingles than that links with nothing and ends here; a passage that many documents share
   keeps none of them. Of the others, the first n - ceil(least * n) + 1 shingles, rarest first, one
   of which any partner must have too, become postings.
3. Classes that a chain of postings joins, at sizes that allow a link, are a cluster. A cluster is a
   block of the product; one of more than `BLOCK` sets or `ENTRIES` entries is cut into several.
   A task accumulates the overlap counts of all pairs of a block, slice after slice of shingles,
   and drops the pairs below the bound that their sizes set, 175 * overlap >= 75 * (size + size) at
   0.75. What leaves the task is one row a member at most, its component in the block.
4. Blocks of one cluster first meet a few of its members (pivots), which joins most of what belongs
   together; members are then dealt anew by component and size, and only pairs of blocks that hold
   different components at sizes that allow a link are multiplied. That part alone can grow with
   the square of a group: with its members that no pivot joined, divided by `BLOCK`.

The input is read more than once and must give the same rows in the same order each time, as
Parquet files do; an input whose plan shuffles is therefore written to the shared folder first.

Edge cases: null, empty and blank texts have no shingles and link with nothing; texts with fewer
words than a shingle have their whole sequence as one; repeated rows are copies like any
others; rows with a null id link with nothing and have a null component; an empty table gives an
empty table; other columns of the input are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spool, blobs, groups, map_arrow
from .components import components, local_labels
from .shingles import mix, shingle_sets

#: Documents with a hot shingle, at least this many and one in `SHARE` of all; documents of a chunk that
#: must have it to report it, likewise at least; hot shingles and document ids broadcast at most.
HOT, SHARE, LOCAL, HOT_MOST, IDS_MOST = 64, 2048, 4, 2_000_000, 1_000_000
#: Entries of a chunk and of a part, about; documents of a chunk at most.
CHUNK, PART, CHUNK_DOCS = 4_000_000, 2_000_000, 1 << 16
#: Sets and entries of a block; pivots of a cluster; cells of a slice of the incidence matrix.
BLOCK, ENTRIES, PIVOTS, CELLS = 512, 2_000_000, 8, 1 << 22

_SALTS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))
_HEAD = np.dtype([("c", "<i8"), ("d", "<i8"), ("n", "<i4"), ("hot", "<i4"), ("listed", "<i4")])
#: Documents up to which a shared shingle is of the rarest, the next and the third kind; of the fourth beyond.
_COMMON = np.array([2, 4, 16])


def _fingerprints(counts: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit fingerprints of each set; 0 for empty ones."""
    end, out = np.cumsum(counts), []
    for salt in _SALTS:
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ salt), dtype=np.uint64)])
        whole = mix((sums[end] - sums[end - counts]) + counts.astype(np.uint64))
        out.append(np.where(counts > 0, whole, np.uint64(0)).view(np.int64))
    return out


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of runs of a batch of (id, text): ids, set sizes, both fingerprints, hashes (uint64)."""
    for first, counts, h in shingle_sets(batch.column(1).to_pylist(), size):
        c, d = _fingerprints(counts, h)
        yield batch.column(0).slice(first, len(counts)), counts, c, d, h


class _Classes:
    """Tells which sets of a chunk are the first of their class there."""

    def __init__(self) -> None:
        self.known: set[tuple[int, int]] = set()

    def new(self, counts: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        out = np.zeros(len(counts), bool)
        for k, key in enumerate(zip(c.tolist(), d.tolist())):
            if counts[k] and key not in self.known:
                self.known.add(key)
                out[k] = True
        return out


def _describe(docs: DataFrame, size: int) -> DataFrame:
    """Of each document its set's size n and fingerprints c, d; and shingles h that many sets of a
    chunk hold, with their number in n."""
    most, local, share = CHUNK, LOCAL, SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, classes, total, sets = [], _Classes(), 0, 0

        def heavy() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            many = n >= max(local, sets // share)
            none = pa.nulls(int(many.sum()), pa.int64())
            columns = [none, pa.array(n[many].astype(np.int64)), none, none, pa.array(h[many].view(np.int64))]
            return pa.RecordBatch.from_arrays(columns, ["id", "n", "c", "d", "h"])

        for batch in batches:
            for ids, counts, c, d, h in _sets(batch, size):
                columns = [ids, pa.array(counts.astype(np.int64)), pa.array(c), pa.array(d), pa.nulls(len(c), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "c", "d", "h"])
                new = classes.new(counts, c, d)
                held.append(h[np.repeat(new, counts)])
                total, sets = total + len(held[-1]), sets + int(new.sum())
            if total > most:
                yield heavy()
                held, classes, total, sets = [], _Classes(), 0, 0
        yield heavy()

    return map_arrow(docs, run, "id long, n long, c long, d long, h long")


def _deal(docs: DataFrame, hot: np.ndarray, least: int, size: int, parts: int) -> DataFrame:
    """The entries of chunks of documents by parts of the hash range.

    Rows part, chunk, head, own (steps of the documents' numbers in the chunk), h (32 bits of the
    hash each); a row with `head` describes the chunk's documents and lists their hot shingles.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(hot.view(np.uint64)))
    most, most_docs = CHUNK, CHUNK_DOCS

    def packed(chunk: int, heads: list[np.ndarray], lists: list[np.ndarray], own: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        part = (h >> np.uint64(32)) % np.uint64(parts)
        order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")
        per = np.bincount(part.astype(np.int64), minlength=parts)
        filled, own = np.flatnonzero(per), own[order]
        steps = _steps(own, per)
        head, listed = np.concatenate(heads), np.concatenate(lists)
        columns = [
            pa.array(np.append(filled, chunk % parts).astype(np.int32)),
            pa.array(np.full(len(filled) + 1, chunk)),
            pa.array(np.append(np.zeros(len(filled), bool), True)),
            pa.concat_arrays([blobs(steps, per[filled]), pa.array([head.tobytes()], pa.binary())]),
            pa.concat_arrays([blobs(h[order].astype(np.uint32), per[filled]), pa.array([listed.tobytes()], pa.binary())]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["part", "chunk", "head", "own", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, chunk = shared.value, TaskContext.get().partitionId() << 20
        classes, heads, lists, owns, held, total, docs_held = _Classes(), [], [], [], [], 0, 0
        for batch in batches:
            for ids, counts, c, d, h in _sets(batch, size):
                if docs_held and (total > most or docs_held + len(counts) > most_docs):
                    yield packed(chunk, heads, lists, np.concatenate(owns), np.concatenate(held))
                    classes, heads, lists, owns, held, total, docs_held = _Classes(), [], [], [], [], 0, 0
                    chunk += 1
                new = classes.new(counts, c, d)
                h, counts, c, d = h[np.repeat(new, counts)], counts[new], c[new], d[new]
                owner = np.repeat(np.arange(len(counts)), counts)
                at = np.minimum(np.searchsorted(hot, h), max(len(hot) - 1, 0))
                is_hot = hot[at] == h if len(hot) else np.zeros(len(h), bool)
                head = np.zeros(len(counts), _HEAD)
                head["c"], head["d"], head["n"] = c, d, counts
                head["hot"] = np.bincount(owner[is_hot], minlength=len(counts))
                # As many hot ones as a prefix can hold are listed.
                rank = np.arange(is_hot.sum()) - (np.cumsum(head["hot"]) - head["hot"])[owner[is_hot]]
                take = rank < (counts - -(-least * counts // 100) + 1)[owner[is_hot]]
                head["listed"] = np.bincount(owner[is_hot][take], minlength=len(counts))
                heads.append(head)
                lists.append(at[is_hot][take].astype(np.int32))
                owns.append(owner[~is_hot] + docs_held)
                held.append(h[~is_hot])
                total, docs_held = total + len(held[-1]), docs_held + len(counts)
        if docs_held:
            yield packed(chunk, heads, lists, np.concatenate(owns), np.concatenate(held))

    out = map_arrow(docs, run, "part int, chunk long, head boolean, own binary, h binary")
    return out.repartitionById(parts, "part").sortWithinPartitions("part")


def _steps(own: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Ascending numbers, `per` for each row, as steps from the one before (a row begins at 0)."""
    steps = np.diff(own, prepend=0)
    begin = (np.cumsum(per) - per)[per > 0]
    steps[begin] = own[begin]
    return steps.astype(np.uint8 if not len(steps) or steps.max() < 256 else np.uint16)


def _numbers(rows: list[bytes], per: np.ndarray) -> np.ndarray:
    """What `_steps` took, of rows of it with `per` numbers each."""
    made = [np.cumsum(np.frombuffer(x, "<u1" if len(x) == n else "<u2"), dtype=np.int64) for x, n in zip(rows, per.tolist())]
    return np.concatenate(made) if made else np.zeros(0, np.int64)


def _shared(dealt: DataFrame) -> DataFrame:
    """Of each part and chunk the entries that other documents hold too: the document (steps) and the
    shingle's code in the part, three bytes (w0 to w2) of which the top two bits tell how common it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, none = ["chunk", "part", "head", "own", "w0", "w1", "w2", "hot"], pa.nulls(1, pa.binary())
        for table in groups(batches, "part"):
            part, chunk, head = (table[k].to_numpy() for k in ("part", "chunk", "head"))
            rows, packed = table["own"].to_pylist(), table["h"].to_pylist()
            for k in np.flatnonzero(head).tolist():
                columns = [pa.array(chunk[k : k + 1]), pa.array(part[k : k + 1]), pa.array([True]), pa.array([rows[k]]), none, none, none, pa.array([packed[k]])]
                yield pa.RecordBatch.from_arrays(columns, names)
            rows, packed = ([x for x, y in zip(z, head.tolist()) if not y] for z in (rows, packed))
            part, chunk = part[~head], chunk[~head]
            if not packed:
                continue
            per = np.array([len(x) // 4 for x in packed])
            h = np.frombuffer(b"".join(packed), "<u4")
            at = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
            at.sort()
            run_of = np.cumsum(np.diff(at >> np.uint64(32), prepend=np.uint64(0)) != 0)
            df = np.bincount(run_of)
            code = np.where(df > 1, (np.searchsorted(_COMMON, df) << 22) | ((np.cumsum(df > 1) - 1) & ((1 << 22) - 1)), -1)
            own_code = np.empty(len(h), np.int64)
            own_code[(at & np.uint64(0xFFFFFFFF)).astype(np.int64)] = code[run_of]
            more = own_code >= 0
            left = np.bincount(np.repeat(np.arange(len(per)), per)[more], minlength=len(per))
            some, found = left > 0, own_code[more]
            steps = _steps(_numbers(rows, per)[more], left)
            columns = [pa.array(chunk[some]), pa.array(part[some]), pa.array(np.zeros(int(some.sum()), bool)), blobs(steps, left[some])]
            columns += [blobs((found >> 8 * k).astype(np.uint8), left[some]) for k in range(3)] + [pa.nulls(int(some.sum()), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    found = map_arrow(dealt, run, "chunk long, part int, head boolean, own binary, w0 binary, w1 binary, w2 binary, hot binary")
    # Chunks are numbered by the task that read them; dealt in turn, each task here gets as many.
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = F.pmod(F.shiftright("chunk", 20) + 7 * F.col("chunk").bitwiseAND((1 << 20) - 1), F.lit(parts)).cast("int")
    return found.repartitionById(parts, turn).sortWithinPartitions("chunk")


def _prefixes(shared: DataFrame, least: int) -> DataFrame:
    """Of each document that has shared shingles enough for a link: c, d, n and gs, its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "chunk"):
            is_head = table["head"].to_numpy()
            top = table.filter(pa.array(is_head))
            head, listed = np.frombuffer(top["own"][0].as_py(), _HEAD), np.frombuffer(top["hot"][0].as_py(), "<i4")
            table = table.filter(pa.array(~is_head))
            planes = [table[f"w{k}"].to_pylist() for k in range(3)]
            per = np.array([len(x) for x in planes[0]], np.int64)
            code = sum(np.frombuffer(b"".join(x), np.uint8).astype(np.int64) << 8 * k for k, x in enumerate(planes))
            # A shingle's number: by how common it is, then its part and its code there.
            g = ((code >> 22) << 58) | (np.repeat(table["part"].to_numpy().astype(np.int64), per) << 24) | code
            own, n = _numbers(table["own"].to_pylist(), per), head["n"].astype(np.int64)
            s = np.bincount(own, minlength=len(head))
            bound = -(-least * n // 100)
            good = s + head["hot"] >= bound
            alone, prefix = n - s - head["hot"], n - bound + 1
            keep = good[own]
            own, g = own[keep], g[keep]
            order = np.lexsort((g, own))
            own, g = own[order], g[order]
            held = np.bincount(own, minlength=len(head))
            rank = np.arange(len(own)) - (np.cumsum(held) - held)[own]
            use = alone[own] + rank < prefix[own]
            hot_own = np.repeat(np.arange(len(head)), head["listed"])
            hot_rank = np.arange(len(hot_own)) - np.repeat(np.cumsum(head["listed"]) - head["listed"], head["listed"])
            use_hot = good[hot_own] & ((alone + s)[hot_own] + hot_rank < prefix[hot_own])
            own = np.concatenate([own[use], hot_own[use_hot]])
            g = np.concatenate([g[use], -1 - listed[use_hot].astype(np.int64)])
            order = np.argsort(own, kind="stable")
            count = np.bincount(own, minlength=len(head))
            some = count > 0
            ends = np.concatenate([[0], np.cumsum(count[some])]).astype(np.int32)
            gs = pa.ListArray.from_arrays(pa.array(ends), pa.array(g[order]))
            columns = [pa.array(head["c"][some]), pa.array(head["d"][some]), pa.array(head["n"][some]), gs]
            yield pa.RecordBatch.from_arrays(columns, ["c", "d", "n", "gs"])

    return map_arrow(shared, run, "c long, d long, n int, gs array<long>")


def _fetch(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Rows blk, k, s (hashes, packed): the sets of the wanted classes; `wanted`: blk, k, c, d and rep, the
    id of a document. Other documents of that id are left out; repeated rows give repeated sets."""
    ids = wanted.select(F.col("rep").alias("id"), "blk", "k", F.col("c").alias("c1"), F.col("d").alias("d1"))
    few = docs.join(F.broadcast(ids) if wanted.count() <= IDS_MOST else ids, "id").select("id", "text", "blk", "k", "c1", "d1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c1, d1, done = batch.column(4).to_numpy(), batch.column(5).to_numpy(), 0
            for _, counts, c, d, h in _sets(batch, size):
                rows = slice(done, done + len(counts))
                done += len(counts)
                own = pa.array((c == c1[rows]) & (d == d1[rows]))
                columns = [batch.column(2)[rows], batch.column(3)[rows], blobs(h, counts)]
                yield pa.RecordBatch.from_arrays([x.filter(own) for x in columns], ["blk", "k", "s"])

    return map_arrow(few, run, "blk long, k long, s binary")


def _overlaps(a: list[np.ndarray], b: list[np.ndarray] | None, cells: int) -> np.ndarray:
    """Overlap counts of sets with sets (`b` None: with themselves): a block of the product,
    accumulated over slices of the shingles."""
    h, own = np.concatenate(a), np.repeat(np.arange(len(a)), [len(x) for x in a])
    columns, place, held = np.unique(h, return_inverse=True, return_counts=True)
    if b is None:
        use = held[place] > 1
        sides = [(own[use], place[use], len(a))]
    else:
        other, owner = np.concatenate(b), np.repeat(np.arange(len(b)), [len(x) for x in b])
        at = np.minimum(np.searchsorted(columns, other), len(columns) - 1)
        there = columns[at] == other
        both = np.zeros(len(columns), bool)
        both[at[there]] = True
        sides = [(own[both[place]], place[both[place]], len(a)), (owner[there], at[there], len(b))]
    live, total = np.unique(sides[0][1]), np.zeros((len(a), len(a if b is None else b)))
    dealt = []
    for o, p, m in sides:
        p = np.searchsorted(live, p)
        order = np.argsort(p, kind="stable")
        dealt.append((o[order], p[order], m))
    width = max(cells // sum(m for _, _, m in sides), 64)
    for first in range(0, len(live), width):
        blocks = []
        for o, p, m in dealt:
            x, y = np.searchsorted(p, [first, first + width])
            block = np.zeros((m, width), np.float32)
            block[o[x:y], p[x:y] - first] = 1
            blocks.append(block)
        total += blocks[0] @ blocks[-1].T
    return total


def _multiply(dealt: DataFrame, least: int, parts: int) -> DataFrame:
    """Links a, b of blocks of the product: rows blk, side, root, s; both sides of a block are
    compared with one another, a block with side 0 alone with itself. Sets of the same root are
    joined already; links are between roots, one a member at most."""
    cells = CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "blk"):
            if len(table) < 2:
                continue
            side, root = table["side"].to_numpy(), table["root"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in table["s"].to_pylist()]
            x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(x):
                continue
            alone = not len(y)
            n = np.array([len(s) for s in sets])
            overlap = _overlaps([sets[k] for k in x], None if alone else [sets[k] for k in y], cells)
            y = x if alone else y
            p, q = np.nonzero((100 + least) * overlap >= least * (n[x][:, None] + n[y][None]))
            p, q = x[p], y[q]
            p, q = p[root[p] != root[q]], q[root[p] != root[q]]
            if not len(p):
                continue
            nodes, at = np.unique(root, return_inverse=True)
            label = local_labels(len(nodes), at[p], at[q])
            moved = label != np.arange(len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["a", "b"])

    return map_arrow(dealt.repartition(parts, "blk").sortWithinPartitions("blk"), run, "a long, b long")


def _cut(members: DataFrame, by: list[str]) -> DataFrame:
    """`members` with blocks, the number of blocks of each group, and block, the member's own by hash."""
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / ENTRIES)).cast("int")
    sizes = members.groupBy(*by).agg(blocks.alias("blocks"))
    return members.join(sizes, by).withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))


def _links(members: DataFrame, docs: DataFrame, least: int, size: int, spool: Spool) -> DataFrame:
    """Links a, b of the classes of each cluster; `members`: cluster, k, c, d, n, band, rep."""
    blk = F.xxhash64("cluster", "band", "block")
    first = members.join(members.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("w")), "cluster")
    whole = (F.col("m") <= BLOCK) & (F.col("w") <= ENTRIES)
    keep = ["blk", "k", "c", "d", "rep"]
    wanted = first.filter(whole).withColumn("blk", F.col("cluster")).select(keep)
    large = spool.write(_cut(first.filter(~whole).drop("m", "w"), ["cluster", "band"]).withColumn("blk", blk))
    some = not large.isEmpty()
    entries = members.agg(F.sum("n")).first()[0] or 0
    parts = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries // PART))
    sets = _fetch(docs, wanted.unionByName(large.select(keep)) if some else wanted, size)
    sets = spool.write(sets) if some else sets
    dealt = sets.select("blk", F.lit(0).alias("side"), F.col("k").alias("root"), "s")
    sets = sets.select("k", "s")
    if some:
        # A few members by hash meet every other block of their cluster.
        lead = large.groupBy("cluster", F.pmod(F.xxhash64("k"), F.lit(PIVOTS))).agg(F.min(F.struct(F.xxhash64("k", F.lit(1)), "k", "blk")).alias("p"))
        pivots = large.select("cluster", "blk").distinct().join(lead.select("cluster", F.col("p.k").alias("k"), F.col("p.blk").alias("own")), "cluster").filter("blk != own")
        dealt = dealt.unionByName(pivots.join(sets, "k").select("blk", F.lit(0).alias("side"), F.col("k").alias("root"), "s"))
    links = spool.write(_multiply(dealt, least, parts))
    if not some:
        return links
    roots = components(links, spool)
    now = large.select("cluster", "k", "n", "band").join(roots, F.col("k") == F.col("node"), "left").withColumn("root", F.coalesce("root", "k"))
    # Large components have blocks of their own; the rest of a cluster share theirs.
    pure = now.groupBy("cluster", "root").agg(F.count("*").alias("m")).filter(F.col("m") >= BLOCK).select("cluster", "root", F.col("root").alias("of"))
    now = spool.write(_cut(now.join(pure, ["cluster", "root"], "left").withColumn("of", F.coalesce("of", F.lit(-1))), ["cluster", "of", "band"]))
    blocks = spool.write(now.select("cluster", "of", "band", "block").distinct())
    left, right = (blocks.select("cluster", *[F.col(c).alias(f"{c}{k}") for c in ("of", "band", "block")]) for k in (0, 1))
    ordered = F.struct("of0", "band0", "block0") <= F.struct("of1", "band1", "block1")
    pairs = left.join(right, "cluster").filter(ordered & (F.abs(F.col("band0") - F.col("band1")) <= 1) & ((F.col("of0") == -1) | (F.col("of0") != F.col("of1"))))
    pairs = pairs.withColumn("blk", F.xxhash64("cluster", *[f"{c}{k}" for k in (0, 1) for c in ("of", "band", "block")]))
    same = F.struct("of0", "band0", "block0") == F.struct("of1", "band1", "block1")
    ends = pairs.select("cluster", "blk", F.lit(0).alias("side"), F.col("of0").alias("of"), F.col("band0").alias("band"), F.col("block0").alias("block"))
    ends = ends.unionByName(pairs.filter(~same).select("cluster", "blk", F.lit(1).alias("side"), F.col("of1").alias("of"), F.col("band1").alias("band"), F.col("block1").alias("block")))
    dealt = ends.join(now, ["cluster", "of", "band", "block"]).join(sets, "k").select("blk", "side", "root", "s")
    return links.unionByName(spool.write(_multiply(dealt, least, parts)))


def similar_components(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 75, size: int = 5) -> DataFrame:
    """Columns id, n_shingles, component_id, n_copies (documents with the same set), a row for each row."""
    spark = docs.sparkSession
    spool = Spool(spark)
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = spool.write(docs)
    told = spool.write(_describe(docs, size))
    own = told.filter("h is null").select("id", "n", "c", "d")
    total = own.agg(F.count("*").alias("docs"), F.sum("n").alias("entries")).first()
    enough = max(HOT, total["docs"] // SHARE)
    hot = told.filter("h is not null").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= enough)
    hot = hot.orderBy(F.desc("n"), "h").limit(HOT_MOST).select("h").toArrow()["h"].to_numpy()
    grouped = own.filter("n > 0 and id is not null").groupBy("c", "d").agg(F.min("id").alias("rep"), F.count("*").alias("n_copies"))
    classes = spool.write(grouped.withColumn("k", F.monotonically_increasing_id()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total["entries"] or 0) // PART))
    prefixes = spool.write(_prefixes(_shared(_deal(docs.filter("id is not null"), hot, least, size, parts)), least))
    # A document may speak in several chunks' name for its class; its prefix is the same everywhere.
    once = prefixes.groupBy("c", "d").agg(F.first("n").alias("n"), F.first("gs").alias("gs"))
    live = spool.write(once.join(classes.select("c", "d", "k", "rep"), ["c", "d"]))
    spool.drop(prefixes)
    # Sizes in neighbouring bands of a factor of least at least can link; others can't.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.5 / least))).cast("int") if least < 100 else F.col("n")
    live = live.withColumn("band", band)
    postings = live.select("k", "band", F.explode("gs").alias("g"))
    heads = spool.write(postings.groupBy("g", "band").agg(F.min("k").alias("head"), F.count("*").alias("m")))
    joined = postings.join(heads.filter("m > 1"), ["g", "band"]).select(F.col("k").alias("a"), F.col("head").alias("b"))
    above = heads.select("g", (F.col("band") - 1).alias("band"), F.col("head").alias("b"))
    joined = joined.unionByName(heads.join(above, ["g", "band"]).select(F.col("head").alias("a"), "b"))
    clusters = spool.write(components(joined.filter("a != b").distinct(), spool))
    members = live.drop("gs").join(clusters, F.col("k") == F.col("node")).withColumnRenamed("root", "cluster").drop("node")
    members = spool.write(members)
    roots = spool.write(components(_links(members, docs, least, size, spool), spool))
    joined = classes.join(roots, classes["k"] == roots["node"], "left").withColumn("root", F.coalesce("root", "k"))
    least_id = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_class = joined.join(least_id, "root").select(F.col("c").alias("c1"), F.col("d").alias("d1"), "component_id", "n_copies")
    same = (F.col("c") == F.col("c1")) & (F.col("d") == F.col("d1")) & (F.col("n") > 0) & F.col("id").isNotNull()
    out = own.join(by_class, same, "left")
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))

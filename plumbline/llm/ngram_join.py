"""Self join of documents by the Jaccard similarity of their word n-grams.

Every text becomes the set of its distinct word shingles (64-bit hashes). Documents
with equal sets form a class; one of each class, its smallest id, is compared.

1. Candidates. Sets of n elements that reach the threshold ``num/den`` have at least
   T = ceil(num * n / den) elements in common, so, in the order of the hashes, their
   first ``l`` common ones are among the first n - T + l of each: these are the set's
   postings. ``l`` is a tenth of T. Postings are counted over the corpus, and in the
   order of their counts any two such sets share one of the first few (all but L - 1,
   where L is the least ``l`` of a partner). A set whose postings are mostly its own
   has no partner and ends here; a passage that many documents share is frequent and
   joins only documents that hold little else. Documents that share one of the first
   few, within neighbouring size intervals, are connected; connected documents are a
   block. No pair over the threshold crosses blocks.
2. Tiles. A block is one tile, unless it is large: then its documents are dealt to
   chunks by size interval and hash, and each pair of chunks whose sizes can match
   is a tile. A tile's size is bounded whatever the size of a group of copies.
3. T-occurrence search (DivideSkip) in each tile. A probe of n elements needs at
   least T common ones. The longest inverted lists, at most T - 1 of them, are set
   aside; the short ones, sorted runs of documents, are merged, and documents found
   T - L times or more are looked up in the L long lists by binary search. Exact
   integers decide: ``den * common >= num * union``.

A posting that many documents hold isn't shuffled row by row: shingles in some 1/256 of
all documents or more are at most 256 times the mean number of postings; they are sent
to every task, count as the most frequent, and a document that needs one among its
first few says so by itself.

A task returns links as counts and as one edge from each document to the smallest it
reaches, never as pairs. Components of those edges are the result.

Defined results: no words (null or empty text) give an empty set, linked with
nothing; fewer words than the shingle size give the whole sequence as one shingle;
rows that repeat an id are one document with several texts; a row with a null id is
linked with nothing and has no component; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import bounded, fresh, mix, partitions, words_of
from plumbline.operators.graph import connected_components
from plumbline.sources.shared import broadcast_if_small, drop_table, work_table

#: Shingles in a chunk of a large block.
CHUNK_SHINGLES = 400_000

#: Rows of the block table (three integers each) that are broadcast at most.
MOST_BROADCAST = 2_000_000

#: A shingle is hot in 1/HOT_SHARE of the documents; the most frequent MOST_HOT of them are sent to the tasks (8 MB).
HOT_SHARE, MOST_HOT = 256, 1_000_000


def size_bounds(num: int, den: int, most: int = 1 << 36) -> np.ndarray:
    """Lower ends of the size intervals: a set's similar sets are in its own or a neighbouring one."""
    ends = [1]
    while ends[-1] < most:
        ends.append(ends[-1] * den // num + 1)
    return np.array(ends, np.int64)


def sets_of(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, first = words_of(column).shingles(size)
    return [np.unique(hashes[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)]


def common_postings(n: int, num: int, den: int) -> int:
    """``l``: how many common elements similar sets of n elements or more must have among their postings."""
    return max(1, -(-num * n // den) // 10)


def postings(s: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """The postings of a set (sorted, not empty) and L, how many of them any similar set shares at least."""
    n = len(s)
    need = -(-num * n // den)
    return s[: n - need + common_postings(n, num, den)], common_postings(need, num, den)


def describe(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """``doc_id, n_shingles, key1, key2``: the keys are 128 bits of the set, null where it is empty.

    Rows with ``sign`` count postings that are frequent in a batch (``times`` of them).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_shingles", "key1", "key2", "sign", "times"]
        for b in bounded(batches):
            sets = sets_of(b.column("text"), size)
            key1, key2 = ([set_key(s, k) if len(s) else None for s in sets] for k in (0x1D, 0x2B))
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(key1, pa.int64()), pa.array(key2, pa.int64()), none, none], names)
            full = [postings(s, num, den)[0] for s in sets if len(s)]
            if full:
                signs, times = np.unique(np.concatenate(full), return_counts=True)
                often = times >= max(2, len(full) / 64)
                none = pa.nulls(int(often.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(signs[often].view(np.int64)), pa.array(times[often])], names)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, key1 long, key2 long, sign long, times long")


def set_key(s: np.ndarray, salt: int) -> int:
    """64 bits of a set, as a signed integer."""
    key = (int(mix(s ^ np.uint64(salt)).sum(dtype=np.uint64)) ^ len(s) * 0x9E3779B97F4A7C15) % (1 << 64)
    return key - (1 << 64) * (key >> 63)


def first_few(docs: DataFrame, size: int, num: int, den: int, hot: np.ndarray) -> DataFrame:
    """``node, sign, g``: the postings by which a set finds its partners; ``node`` is the set's key, ``g`` its size interval.

    ``hot`` are the (sorted) hot postings; they come last in the order of the counts.
    """
    bounds = size_bounds(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            cells: dict[int, list[tuple]] = {}
            for s in sets_of(b.column("text"), size):
                if not len(s) or (node := set_key(s, 0x1D)) in cells:
                    continue
                own, shared = postings(s, num, den)
                g = int(np.searchsorted(bounds, len(s), side="right")) - 1
                is_hot = np.isin(own, hot, assume_unique=True) if len(hot) else np.zeros(len(own), bool)
                n_hot = int(is_hot.sum())
                # So many of its first few are hot whatever the counts of the others.
                cells[node] = [(own[~is_hot], node, max(0, shared - 1 - n_hot), g, False), (own[is_hot][: max(0, n_hot - shared + 1)], node, 0, g, True)]
            flat = [c for both in cells.values() for c in both]
            if flat:
                n = [len(c[0]) for c in flat]
                spread = [pa.array(np.repeat(np.array([c[k] for c in flat], kind), n)) for k, kind in ((1, np.int64), (2, np.int32), (3, np.int32), (4, bool))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([c[0] for c in flat]).view(np.int64)), *spread], ["sign", "node", "spare", "g", "hot"])

    found = docs.mapInArrow(run, "sign long, node long, spare int, g int, hot boolean")
    # A hot posting isn't counted: its rows are dealt by set as well.
    dealt = found.withColumn("deal", F.when(F.col("hot"), F.xxhash64("sign", "node")).otherwise(F.col("sign")))
    same = Window.partitionBy("deal", "hot").orderBy("node")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = dealt.select(
        "sign", "node", "spare", "g", "hot", F.count("*").over(whole).alias("times"), (F.first("node").over(whole) == F.last("node").over(whole)).alias("alone"), F.lag("node").over(same).alias("last")
    ).where("(hot or not alone) and (last is null or last <> node)")
    rare = F.row_number().over(Window.partitionBy("node").orderBy("hot", "times", "sign"))
    cold = F.sum((~F.col("hot")).cast("int")).over(Window.partitionBy("node"))
    return met.select("node", "sign", "g", "hot", "spare", rare.alias("k"), cold.alias("cold")).where("hot or k <= cold - spare").select("node", "sign", "g")


def exact_edges(docs: DataFrame, about: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """``a, b``: candidate edges between class representatives that connect any two sets over the threshold."""
    counted = about.where("sign is not null").groupBy("sign").agg(F.sum("times").alias("times"))
    least = max(8, about.where("sign is null").count() // HOT_SHARE)
    often = counted.where(F.col("times") >= least).orderBy(F.desc("times"), "sign").limit(MOST_HOT).collect()
    hot = np.sort(np.array([r.sign for r in often], np.int64).view(np.uint64))
    few = work_table(first_few(docs.where("doc_id is not null"), size, num, den, hot), "few")
    keyed = few.select("node", "sign", F.explode(F.array(F.col("g"), F.col("g") - 1)).alias("g"))
    lead = keyed.groupBy("sign", "g").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b < top").select("sign", "g", "b")
    linked = work_table(keyed.join(lead, ["sign", "g"]), "linked")
    # A set is named by the least set that it meets; then the sets of a posting, and their names, meet. Near copies
    # share a name at once, so a group of them has an edge for each of its sets, not for each of their postings.
    names = linked.groupBy("node").agg(F.min("b").alias("name"))
    named = work_table(linked.select("sign", "g", "node").join(names, "node"), "named")
    least = named.groupBy("sign", "g").agg(F.min("name").alias("least"))
    ends = names.select(F.col("node").alias("a"), F.col("name").alias("b")).unionByName(named.select("sign", "g", "name").distinct().join(least, ["sign", "g"]).select(F.col("name").alias("a"), F.col("least").alias("b")))
    stars = work_table(ends.where("a <> b").distinct(), "stars")
    reps = about.where("key1 is not null and doc_id is not null").groupBy("key1").agg(F.min("doc_id").alias("rep"))
    ends = stars
    for end in ("a", "b"):
        ends = ends.join(reps.select(F.col("key1").alias(end), F.col("rep").alias(f"{end}_rep")), end)
    edges = work_table(ends.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).where("a <> b").distinct(), "candidates")
    for t in (few, linked, named, stars):
        drop_table(t)
    return edges


Signer = Callable[[list[np.ndarray]], tuple[np.ndarray, np.ndarray]]


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n items' component under the edges a - b."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            return root


def candidate_edges(docs: DataFrame, size: int, signer: Signer) -> DataFrame:
    """``a, b``: each document that shares a signature with a smaller id, and the smallest such id.

    A batch links the documents that share signatures to the smallest of them, and sends
    each signature once, for that one; so a signature that a third of all documents hold
    is shuffled once for each batch, and a group of copies has one row for each batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            signs, owners = signer(sets_of(b.column("text"), size))
            if not len(signs):
                continue
            held = ids[owners].astype(np.int64)
            # Documents of the batch that share signatures, as stars to their smallest id.
            known, spot = np.unique(held, return_inverse=True)
            order = np.lexsort((spot, signs))
            signs, spot = signs[order], spot[order]
            first = np.concatenate([[True], signs[1:] != signs[:-1]])
            lead = spot[np.flatnonzero(first)[np.cumsum(first) - 1]]
            root = local_roots(len(known), spot, lead)
            star = np.flatnonzero(root != np.arange(len(known)))
            # A signature is sent once, for the smallest id of its star.
            keyed = pa.RecordBatch.from_arrays([pa.array(signs[first].view(np.int64)), pa.array(known[root[spot[first]]]), pa.nulls(int(first.sum()), pa.int64())], ["sign", "a", "b"])
            yield keyed
            yield pa.RecordBatch.from_arrays([pa.nulls(len(star), pa.int64()), pa.array(known[star]), pa.array(known[root[star]])], ["sign", "a", "b"])

    found = docs.where("doc_id is not null").mapInArrow(run, "sign long, a long, b long")
    # One shuffle: the rows of a signature, and, dealt by their ends, the edges found inside batches.
    dealt = found.withColumn("deal", F.coalesce(F.col("sign"), F.xxhash64("a", "b")))
    lead = F.min("a").over(Window.partitionBy("deal", F.col("sign").isNull()))
    edges = dealt.select("a", F.when(F.col("sign").isNull(), F.col("b")).otherwise(lead).alias("b"))
    return edges.where("a <> b").distinct()


def merge(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The documents of sorted lists, ascending, and how many lists each is in.

    A stable sort finds the sorted runs and merges them two by two, a heap's work without a step of Python each.
    """
    if not lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    merged = np.sort(np.concatenate(lists), kind="stable")
    first = np.flatnonzero(np.append(True, merged[1:] != merged[:-1]))
    return merged[first], np.diff(np.append(first, len(merged)))


class Index:
    """Inverted lists over sets: ``posts[starts[k]:starts[k + 1]]`` are the documents with ``terms[k]``."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
        docs = np.repeat(np.arange(len(sets)), sizes)
        order = np.lexsort((docs, flat))
        self.sizes, self.posts = sizes, docs[order]
        self.terms, self.starts = np.unique(flat[order], return_index=True)
        self.starts = np.append(self.starts, len(flat))

    def search(self, probe: np.ndarray, num: int, den: int, before: int) -> np.ndarray:
        """Documents below ``before`` that reach the threshold with ``probe``."""
        need = -(-num * len(probe) // den)
        at = np.searchsorted(self.terms, probe)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == probe)]
        if len(at) < need:
            return np.zeros(0, np.int64)
        lengths = self.starts[at + 1] - self.starts[at]
        by_length = np.argsort(-lengths, kind="stable")
        long = by_length[: need - 1][lengths[by_length[: need - 1]] > 8 * np.median(lengths)]
        short = np.setdiff1d(np.arange(len(at)), long)
        found, common = merge([self.posts[self.starts[k] : self.starts[k + 1]] for k in at[short]])
        sizes = self.sizes[found]
        fits = (found < before) & (common >= need - len(long)) & (den * sizes >= num * len(probe)) & (num * sizes <= den * len(probe))
        found, common = found[fits], common[fits]
        for k in at[long]:
            posts = self.posts[self.starts[k] : self.starts[k + 1]]
            spot = np.searchsorted(posts, found)
            common = common + (posts[np.minimum(spot, len(posts) - 1)] == found)
        return found[den * common >= num * (self.sizes[found] + len(probe) - common)]


def link_tile(nodes: np.ndarray, copies: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest node reached in the tile, and the number of linked documents, for each entry.

    In a tile of two chunks (sides 0 and 1) side 0 is indexed and side 1 probes; in a
    tile of one chunk (side 0 alone) every entry probes those before it.
    """
    order = np.lexsort((nodes, sides))
    sets = [sets[i] for i in order]
    side = sides[order]
    cross = bool(side[-1]) if len(side) else False
    n0 = int((side == 0).sum())
    index = Index(sets[:n0])
    node, copy = nodes[order], copies[order]
    label = node.copy()
    links = np.zeros(len(node), np.int64)
    for i in range(n0 if cross else 1, len(node)):
        if not len(sets[i]) or not n0:
            continue
        found = index.search(sets[i], num, den, n0 if cross else i)
        found = found[node[found] != node[i]]
        if len(found):
            links[i] += copy[found].sum()
            np.add.at(links, found, copy[i])
            met = np.unique(np.append(label[found], label[i]))
            if len(met) > 1:
                label[np.isin(label, met[1:])] = met[0]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return label[back], links[back]


def search_tiles(rows: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """``node, root, links`` of rows ``tile (5 columns), side, node, copies, text`` sorted by tile."""
    keys = ["block", "g1", "c1", "g2", "c2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]] = []
        tile: tuple | None = None

        def close() -> pa.RecordBatch:
            nodes, copies, sides = (np.concatenate([h[k] for h in held]) for k in range(3))
            if tile[1:3] != tile[3:] and not sides.any():  # two chunks by its key, but the second is empty
                root, links = nodes, np.zeros(len(nodes), np.int64)
            else:
                root, links = link_tile(nodes, copies, sides, [s for h in held for s in h[3]], num, den)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root), pa.array(links)], ["node", "root", "links"])

        for b in bounded(batches):
            columns = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys], 1)
            sets = sets_of(b.column("text"), size)
            nodes, copies, sides = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("node", "copies", "side"))
            cuts = np.append(np.flatnonzero(np.append(True, (columns[1:] != columns[:-1]).any(1))), len(columns))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                now = tuple(columns[i])
                if held and now != tile:
                    yield close()
                tile = now
                held.append((nodes[i:j], copies[i:j], sides[i:j], sets[i:j]))
        if held:
            yield close()

    spread = rows.repartition(partitions(rows), *keys).sortWithinPartitions(*keys)
    return spread.select(*keys, "side", "node", "copies", "text").mapInArrow(run, "node long, root long, links long")


def tiles_of(members: DataFrame, num: int, den: int, chunk: int = CHUNK_SHINGLES) -> DataFrame:
    """``node, copies`` and one row for each tile that the document is in, from ``node, block, n, copies``."""
    ends = F.array(*[F.lit(int(x)) for x in size_bounds(num, den)])
    # Only blocks over a chunk are dealt: these are few, and a hot block isn't a join key of its own.
    totals = members.groupBy("block").agg(F.sum("n").alias("all")).where(F.col("all") > chunk).select("block", F.lit(True).alias("large"))
    sized = members.join(broadcast_if_small(work_table(totals, "large"), MOST_BROADCAST), "block", "left")
    sized = sized.withColumn("g", F.when(F.col("large"), F.size(F.filter(ends, lambda e: e <= F.col("n")))).otherwise(0))
    counts = work_table(sized.where("large").groupBy("block", "g").agg(F.ceil(F.sum("n") / F.lit(chunk)).cast("int").alias("chunks")), "chunks")
    around = [counts.select("block", (F.col("g") - d).alias("g"), F.col("chunks").alias(name)) for d, name in ((0, "here"), (1, "above"), (-1, "below"))]
    for side in around:
        sized = sized.join(broadcast_if_small(side, MOST_BROADCAST), ["block", "g"], "left")
    sized = sized.withColumn("here", F.coalesce("here", F.lit(1)))
    c = F.pmod(F.xxhash64("node", F.lit(5)), F.col("here")).cast("int")
    sized = sized.withColumn("c", c)

    def upto(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def tile(g1: Column, c1: Column, g2: Column, c2: Column, side: Column) -> Column:
        return F.struct(g1.alias("g1"), c1.alias("c1"), g2.alias("g2"), c2.alias("c2"), side.cast("int").alias("side"))

    g, c = F.col("g"), F.col("c")
    same = F.transform(upto(F.col("here")), lambda k: tile(g, F.least(c, k), g, F.greatest(c, k), (k < c)))
    higher = F.transform(upto(F.coalesce("above", F.lit(0))), lambda k: tile(g, c, g + 1, k, F.lit(0)))
    lower = F.transform(upto(F.coalesce("below", F.lit(0))), lambda k: tile(g - 1, k, g, c, F.lit(1)))
    return sized.select("node", "copies", "block", F.explode(F.concat(same, higher, lower)).alias("t")).select("node", "copies", "block", "t.*")


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, chunk: int = CHUNK_SHINGLES, signer: Signer | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for each row of ``docs`` (``doc_id, text``).

    ``signer`` makes signatures that form blocks instead of the postings, which miss no link.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = work_table(describe(docs, size, num, den), "about")
    about = described.where("sign is null").drop("sign", "times")
    known = about.where("key1 is not null and doc_id is not null")
    classes = work_table(known.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "classes")
    named = F.col("doc_id").isNotNull()
    placed = about.join(classes, ["key1", "key2"], "left").select(
        "doc_id", "n_shingles", F.when(named & F.col("key1").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"), F.when(named, F.coalesce("copies", F.lit(1))).otherwise(1).alias("copies")
    )
    placed = work_table(placed, "placed")

    # Candidate edges between class representatives, and their components: the blocks.
    if signer is None:
        edges = exact_edges(docs, described, size, num, den)
    else:
        edges = work_table(candidate_edges(docs, size, signer), "candidates")
        moved = placed.where("rep <> doc_id").select("doc_id", "rep")
        for end in ("a", "b"):
            edges = edges.join(broadcast_if_small(moved, MOST_BROADCAST), edges[end] == moved.doc_id, "left").withColumn(end, F.coalesce("rep", end)).drop("doc_id", "rep")
        edges = edges.where("a <> b").distinct()
    blocks = connected_components(edges, "a", "b")
    reps = placed.where("rep = doc_id").groupBy(F.col("rep").alias("node")).agg(F.max("n_shingles").alias("n"), F.max("copies").alias("copies"))
    members = work_table(blocks.select("node", F.col("component").alias("block")).join(reps, "node"), "members")
    tiles = work_table(tiles_of(members, num, den, chunk), "tiles")
    small = broadcast_if_small(tiles, MOST_BROADCAST)
    rows = docs.join(small, docs.doc_id == small.node).drop("doc_id")
    linked = work_table(search_tiles(rows, size, num, den), "linked")
    for t in (described, classes, members, tiles):
        drop_table(t)

    # Documents with several texts join their classes.
    several = placed.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("src"), F.max("rep").alias("dst")).where("src <> dst")
    joins = linked.where("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst")).unionByName(several.select("src", "dst"))
    reached = connected_components(joins)
    degree = linked.groupBy("node").agg(F.sum("links").alias("linked"))
    out = placed.join(reached, placed.rep == reached.node, "left").drop("node").join(degree, placed.rep == degree.node, "left")
    own = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group of linked documents, the smallest id, with all its columns.

    Of rows that repeat an id one stays; documents without words and rows without an id stay.
    """
    found = work_table(jaccard_components(docs, size, num, den), "found")
    other, again = fresh("other", docs.columns), fresh("again", docs.columns)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(other)).distinct()
    left = docs.join(broadcast_if_small(gone, MOST_BROADCAST), F.col("doc_id").cast("long") == F.col(other), "left_anti")
    several = work_table(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(again)), "again")
    if several.isEmpty():
        return left
    several = broadcast_if_small(several, MOST_BROADCAST)
    same = F.col("doc_id").cast("long") == F.col(again)
    # Of rows that repeat an id, linked or not, any one stays.
    return left.join(several, same, "left_anti").unionByName(left.join(several, same, "left_semi").dropDuplicates(["doc_id"]))

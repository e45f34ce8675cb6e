"""N-gram Jaccard join: chosen-path join of documents by their word shingles.

1. Each text becomes a set of hashes of word n-grams, with a minhash signature and a sketch of one bit per minhash.
   Texts of equal sets count as one from here on.
2. In each run sets fall into a tree of buckets: a node picks one or two signature coordinates (1 / threshold of them
   on average), and a child holds the sets that agree there. A bucket of one ends; small buckets are compared pair by
   pair on the sketches, with a bound that similar sets fail with negligible probability. Sets of a large bucket are
   compared with a few of them, its pivots; if that connects them all, as it does in a family of near copies, the bucket
   ends too, else it splits again. Runs repeat until a pair at the threshold is met with the target recall, and for sets
   in buckets that split further until it is for the deepest level that they reached; buckets whose sets earlier runs
   have all connected end at once. What is met joins candidate clusters.
3. Inside a cluster all pairs are verified on the full sets, block by block, so that links are exact and a pair that
   no bucket held is still found if other pairs connect its cluster. Verified links give classes and link counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeframe.llm.common import Tables, bit_table, components, held, mix, slices, word_hashes

COORDINATES = 64
SKETCH = 128
BUCKET = 16_384
FEW = 32
PIVOTS = 8
BLOCK = 1_024  # sets of a verification block, and shingles of all of them
BLOCK_SHINGLES = 400_000
WIDTH = 4_096
DEPTH = 12
with np.errstate(over="ignore"):
    MULTIPLIERS = mix(np.arange(SKETCH, dtype=np.uint64), 11) | np.uint64(1)
    MASKS = mix(np.arange(SKETCH, dtype=np.uint64), 12)


def second(threshold: float) -> float:
    """The share of nodes that pick a second coordinate, so that nodes pick 1 / threshold on average."""
    return min(1.0, 1 / threshold - 1)


def runs_for(threshold: float, target: float, levels: int = 2) -> int:
    """Runs after which a pair at the threshold has been met after so many levels with the target probability.

    Runs share the coordinates, of which a pair agrees in a binomial number; given that number runs are independent.
    """
    q, k = second(threshold), np.arange(COORDINATES + 1)
    share = np.array([math.comb(COORDINATES, int(i)) * threshold ** int(i) * (1 - threshold) ** int(COORDINATES - i) for i in k])
    met = np.ones(len(k))  # by the number of equal coordinates, the probability that a run holds the pair together
    for _ in range(levels):
        lost = 1 - k / COORDINATES * met
        met = 1 - ((1 - q) * lost + q * lost**2)
    enough = lambda runs: share @ (1 - met) ** runs <= 1 - target
    if share[0] > 1 - target:
        raise ValueError(f"a recall of {target} at the threshold {threshold} needs more than {COORDINATES} coordinates")
    high = 1
    while not enough(high):
        high *= 2
    low = high // 2
    while high - low > 1:
        low, high = (low, (low + high) // 2) if enough((low + high) // 2) else ((low + high) // 2, high)
    return high


def sketch_bound(threshold: float) -> int:
    """The most differing sketch bits: the mean at the threshold and six standard deviations."""
    p = (1 - threshold) / 2
    return min(SKETCH, math.ceil(SKETCH * p + 6 * math.sqrt(SKETCH * p * (1 - p))))


class Shingles:
    """The sets of a column of texts: those of text i are hashes[ends[i]:ends[i + 1]], sorted. A text of fewer than n words has one shingle, of all of them; one without words has none."""

    def __init__(self, texts: pa.Array, n: int):
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        words = split.flatten().dictionary_encode()
        code = words.indices.to_numpy()
        owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        empty = pc.index(words.dictionary, pa.scalar("", words.dictionary.type)).as_py()
        if empty >= 0:
            full = code != empty
            code, owner = code[full], owner[full]
        word = word_hashes(words.dictionary)[code]
        count = np.bincount(owner, minlength=len(texts))
        first = np.cumsum(count) - count
        take = np.maximum(np.where(count > 0, 1, 0), count - n + 1)
        of = np.repeat(np.arange(len(texts)), take)
        at = np.repeat(first, take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
        h = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                inside = k < count[of]
                h = mix(h + np.where(inside, word[np.where(inside, at + k, 0)] if len(word) else 0, 0).astype(np.uint64), k)
        by = np.lexsort((h, of))
        h, of = h[by], of[by]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])[: len(h)]
        self.hashes = h[new]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=len(texts)))]).astype(np.int64)

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.ends[i] : self.ends[i + 1]]


def signature(hashes: np.ndarray) -> np.ndarray:
    """SKETCH minhashes of a set."""
    out = np.full(SKETCH, np.iinfo(np.uint64).max)
    for low in range(0, len(hashes), 8_192):
        with np.errstate(over="ignore"):
            np.minimum(out, ((hashes[None, low : low + 8_192] ^ MASKS[:, None]) * MULTIPLIERS[:, None]).min(1), out=out)
    return out


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    with np.errstate(over="ignore"):
        return int(mix(hashes, 21).sum(dtype=np.uint64)) - 2**63, int(mix(hashes, 22).sum(dtype=np.uint64)) - 2**63


def signatures(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc, h1, h2, size, coordinates binary, s1, s2); size 0 and nulls for a text without words."""

    def run(batches):
        for part in slices(batches, 1):
            sets = Shingles(part.column(1), n)
            keys, coordinates, sketches = [], [], []
            for i in range(part.num_rows):
                hashes = sets.of(i)
                if len(hashes):
                    m = mix(signature(hashes), 5)
                    coordinates.append((m[:COORDINATES] >> np.uint64(32)).astype(np.uint32).tobytes())
                    sketches.append(np.packbits((m & np.uint64(1)).astype(bool)).view(np.int64))
                    keys.append(set_key(hashes))
                else:
                    coordinates.append(None)
                    sketches.append((0, 0))
                    keys.append((0, 0))
            keys, sketches = np.array(keys, np.int64).reshape(-1, 2), np.array(sketches, np.int64).reshape(-1, 2)
            arrays = [part.column(0), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(np.diff(sets.ends)), pa.array(coordinates, pa.binary()), pa.array(sketches[:, 0]), pa.array(sketches[:, 1])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "h1", "h2", "size", "coordinates", "s1", "s2"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), text_col).where("doc is not null").mapInArrow(run, "doc long, h1 long, h2 long, size long, coordinates binary, s1 long, s2 long")


ROWS = "bucket long, rep long, comp long, s1 long, s2 long"


NODE = ["rep", "comp", "s1", "s2"]


def children(nodes: DataFrame, threshold: float) -> DataFrame:
    """Rows ROWS of the child buckets of nodes (path, rep, comp, coordinates, s1, s2), or of the roots of the runs from low up to high of rows (low, high, rep, comp, coordinates, s1, s2); a root's path is its run's number."""
    share = np.uint64(int(second(threshold) * (2**32 - 1)))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("coordinates").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            if "path" in b.schema.names:
                paths = [(b.column("path").to_numpy().view(np.uint64), np.arange(b.num_rows))]
            else:
                low, high = b.column("low").to_numpy(), b.column("high").to_numpy()
                roots = ((r, np.flatnonzero((low <= r) & (r < high))) for r in range(low.min(), high.max()))
                paths = ((np.full(len(rows), r, np.uint64), rows) for r, rows in roots)
            for path, rows in paths:
                pick = mix(path, 31)
                one = (pick % np.uint64(COORDINATES)).astype(np.int64)
                two = (one + 1 + ((pick >> np.uint64(8)) % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
                for chosen, who in ((one, np.arange(len(rows))), (two, np.flatnonzero((pick >> np.uint64(32)) < share))):
                    if len(who):
                        at = chosen[who]
                        with np.errstate(over="ignore"):
                            bucket = mix(mix(path[who], 32) + mix(sig[rows[who], at].astype(np.uint64) + (at.astype(np.uint64) << np.uint64(32)), 33), 34)
                        index = pa.array(rows[who])
                        yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), *[b.column(c).take(index) for c in NODE]], ["bucket", *NODE])

    return nodes.mapInArrow(run, ROWS)


def by_group(batches, key: str):
    """Batches cut so that rows of one key, which lie together, come in one piece."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        column = t.column(key)
        low = pc.index(column, column[t.num_rows - 1]).as_py()  # rows lie in order of the key
        if low:
            yield t.slice(0, low)
        rest = t.slice(low)
    if rest is not None and rest.num_rows:
        yield rest


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component under the pairs (a, b)."""
    labels = np.arange(n)
    while True:
        low = np.minimum(labels[a], labels[b])
        before = labels.copy()
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        labels = labels[labels]
        if (labels == before).all():
            return labels


def connected(s1: np.ndarray, s2: np.ndarray, bound: int) -> np.ndarray:
    """Labels of the components that sketches connect: the place of each one's first member. Rows that have their component already are not compared again."""
    labels = np.arange(len(s1))
    for k in range(len(s1) - 1):
        other = k + 1 + np.flatnonzero(labels[k + 1 :] != labels[k])
        near = other[np.bitwise_count(s1[other] ^ s1[k]).astype(np.int64) + np.bitwise_count(s2[other] ^ s2[k]) <= bound]
        if len(near):
            joined = np.unique(np.append(labels[near], labels[k]))
            labels[np.isin(labels, joined)] = joined[0]
    return labels


def brute(small: DataFrame, bound: int) -> DataFrame:
    """Edges (a, b) from each set of a small bucket to the first of those that its sketch connects it with; rows lie by bucket and rep."""

    def run(batches):
        for t in by_group(batches, "bucket"):
            bucket, rep = t.column("bucket").to_numpy(), t.column("rep").to_numpy()
            s1, s2 = t.column("s1").to_numpy().view(np.uint64), t.column("s2").to_numpy().view(np.uint64)
            rows = np.arange(len(rep))
            begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            size = np.diff(np.append(begin, len(rep)))
            many = size > FEW
            start, depth = np.repeat(begin, size), rows - np.repeat(begin, size)
            depth[np.repeat(many, size)] = 0
            pairs, k = [(rows[:0], rows[:0])], 0
            alive = rows[depth > 0]
            while len(alive):  # the k-th row of each bucket of few against all rows after it
                other = start[alive] + k
                near = np.bitwise_count(s1[alive] ^ s1[other]).astype(np.int64) + np.bitwise_count(s2[alive] ^ s2[other]) <= bound
                pairs.append((other[near], alive[near]))
                k += 1
                alive = alive[depth[alive] > k]
            root = labels_of(len(rep), np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
            for low, n in zip(begin[many].tolist(), size[many].tolist(), strict=True):
                root[low : low + n] = low + connected(s1[low : low + n], s2[low : low + n], bound)
            moved = rep[root] != rep
            yield pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[root][moved])], ["a", "b"])

    return small.mapInArrow(run, "a long, b long")


def pivoted(large: DataFrame, bound: int) -> DataFrame:
    """Rows (bucket, rep, comp, s1, s2, to) of large buckets: to lists the pivots that the set's sketch connects it with, each as the smallest pivot that sketches connect it with."""
    slot = F.pmod(F.xxhash64("rep"), F.lit(PIVOTS)).alias("slot")
    some = large.groupBy("bucket", slot).agg(F.min(F.struct("rep", "s1", "s2")).alias("p")).groupBy("bucket").agg(F.collect_list("p").alias("p"))  # PIVOTS of them at most
    pivots = some.select("bucket", F.col("p.rep").alias("p"), F.col("p.s1").alias("p1"), F.col("p.s2").alias("p2"))

    def run(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            width = pc.list_value_length(b.column("p")).to_numpy(zero_copy_only=False)
            at, of = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width), np.repeat(np.arange(n), width)
            sides = []
            for name in ("p", "p1", "p2"):
                wide = np.zeros((n, PIVOTS), np.int64)
                wide[of, at] = b.column(name).flatten().to_numpy()
                sides.append(wide)
            p, p1, p2 = sides[0], sides[1].view(np.uint64), sides[2].view(np.uint64)
            there = np.arange(PIVOTS) < width[:, None]
            far = lambda x1, x2, k: np.bitwise_count(x1 ^ p1[:, k, None]).astype(np.int64) + np.bitwise_count(x2 ^ p2[:, k, None])
            top = np.where(there, p, np.iinfo(np.int64).max)
            for _ in range(PIVOTS):  # the smallest pivot passes along sketch links
                for k in range(PIVOTS):
                    near = (far(p1, p2, k) <= bound) & there & there[:, k, None]
                    least = np.where(near, top, np.iinfo(np.int64).max).min(1)
                    top = np.where(near, np.minimum(top, least[:, None]), top)
            s1, s2 = (b.column(c).to_numpy().view(np.uint64)[:, None] for c in ("s1", "s2"))
            met = np.concatenate([far(s1, s2, k) <= bound for k in range(PIVOTS)], 1) & there
            tops = np.sort(np.where(met, top, np.iinfo(np.int64).max), 1)
            new = (tops < np.iinfo(np.int64).max) & np.concatenate([np.ones((n, 1), bool), tops[:, 1:] != tops[:, :-1]], 1)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(new.sum(1))]), pa.int32()), pa.array(tops[new]))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("bucket", *NODE)], lists], ["bucket", *NODE, "to"])

    return large.select("bucket", *NODE).join(pivots, "bucket").mapInArrow(run, f"{ROWS}, to array<long>")


def walk(roots: DataFrame, sketches: DataFrame, tables: Tables, threshold: float, partitions: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges between sets that some bucket of the runs of roots held together, and rows (rep, level) of sets in buckets that split more than twice: the levels after which a bucket of theirs ended."""
    rows, edges, deep, above, bound = children(roots, threshold), None, None, None, sketch_bound(threshold)
    for depth in range(DEPTH):
        rows = tables.keep(rows)
        if above is not None:
            tables.drop(above)
        counts = rows.groupBy("bucket").agg(F.count("*").alias("c"), (F.min("comp") < F.max("comp")).alias("apart")).where("c > 1 and apart").drop("apart")
        shared = tables.keep(rows.join(counts, "bucket"))
        tables.drop(rows)
        small = shared.where(f"c <= {BUCKET}").select("bucket", "rep", "s1", "s2").repartition(partitions, "bucket").sortWithinPartitions("bucket", "rep")
        found = brute(small, bound)
        large = shared.where(f"c > {BUCKET}")
        if large.isEmpty():
            found = tables.keep(found.distinct())
            tables.drop(shared)
            return found if edges is None else edges.unionByName(found), deep
        large = tables.keep(pivoted(large, bound))
        linked = large.select(F.col("rep").alias("a"), F.explode("to").alias("b")).where("a <> b")
        one = (F.size("to") == 1) & (F.element_at("to", 1) == F.col("least"))
        least = large.groupBy("bucket").agg(F.min(F.try_element_at("to", F.lit(1))).alias("least"))
        open_ = large.join(least, "bucket").groupBy("bucket").agg(F.min(F.coalesce(one, F.lit(False))).alias("done")).where("not done").select("bucket")
        large = tables.keep(large.join(open_, "bucket", "left_semi").select("bucket", *NODE))
        last = depth == DEPTH - 1
        found = found.unionByName(linked)
        if last:  # sets that agreed at every level
            first = large.groupBy("bucket").agg(F.min("rep").alias("b"))
            found = found.unionByName(large.join(first, "bucket").select(F.col("rep").alias("a"), "b"))
        found = tables.keep(found.distinct())
        tables.drop(shared)
        edges = found if edges is None else edges.unionByName(found)
        if last or large.isEmpty():
            return edges, deep
        if depth:
            here = tables.keep(large.select("rep", F.lit(depth + 2).alias("level")).distinct())
            deep = here if deep is None else deep.unionByName(here)
        rows, above = children(large.select(F.col("bucket").alias("path"), *NODE).join(sketches, "rep"), threshold), large


def candidate_edges(reps: DataFrame, tables: Tables, threshold: float, recall: float, partitions: int) -> DataFrame:
    """Edges between sets that some bucket of some run held together: each pair at the threshold with the probability recall, or connected by other edges.

    All sets go through the runs for two levels. Those in buckets that split further go through more, until there are
    enough for the deepest level that they reached.
    """
    sketches, edges = reps.select("rep", "coordinates"), None
    now = reps.select("rep", F.col("rep").alias("comp"), "coordinates", "s1", "s2", F.lit(0).alias("low"), F.lit(runs_for(threshold, recall)).alias("high"))
    while True:
        found, deep = walk(now, sketches, tables, threshold, partitions)
        edges = found if edges is None else edges.unionByName(found)
        if deep is None:
            return edges
        deepest = deep.groupBy("rep").agg(F.max("level").alias("level"))
        levels = [r["level"] for r in deepest.select("level").distinct().collect()]  # DEPTH of them at most
        wanted = F.coalesce(*[F.when(F.col("level") == n, runs_for(threshold, recall, n)) for n in levels])
        of = components(edges, tables).select(F.col("node").alias("rep"), F.col("component").alias("into"))
        now = now.join(deepest, "rep").join(of, "rep", "left").select("rep", F.coalesce("into", "rep").alias("comp"), "coordinates", "s1", "s2", F.col("high").alias("low"), wanted.alias("high")).where("high > low")
        now = tables.keep(now)
        if now.isEmpty():
            return edges


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b, or of a; those of a set with itself may be too small. Only hashes that lie in two sets count, a stretch of them at a time."""
    flat = lambda sets: (np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
    va, oa = flat(a)
    values, times = np.unique(va, return_counts=True)
    if b is None:
        values = values[times > 1]
    else:
        vb, ob = flat(b)
        values = np.intersect1d(values, vb)

    def coded(v, owner):
        at = np.minimum(np.searchsorted(values, v), max(len(values) - 1, 0))
        some = np.flatnonzero(values[at] == v) if len(values) else np.zeros(0, np.int64)
        by = some[np.argsort(at[some], kind="stable")]
        return at[by], owner[by]

    def dense(code, owner, low, n):
        x, y = np.searchsorted(code, (low, low + WIDTH))
        out = np.zeros((n, min(WIDTH, len(values) - low)), np.float32)
        out[owner[x:y], code[x:y] - low] = 1
        return out

    left = coded(va, oa)
    right = left if b is None else coded(vb, ob)
    out = np.zeros((len(a), len(a if b is None else b)), np.float32)
    for low in range(0, len(values), WIDTH):
        x = dense(*left, low, len(a))
        out += x @ (x if b is None else dense(*right, low, len(b))).T
    return out.astype(np.int64)


def verify(tasks: DataFrame, threshold: float, n: int) -> DataFrame:
    """Rows (rep, links, root) from tasks (task, rep, weight, first, whole, h1, text), which lie by task, first and rep: within a whole block, or of one block's sets with another's, first being the block.

    links: the weights of the sets that rep is linked with; root: the smallest rep that links of the task connect it with.
    """

    def run(batches):
        for t in by_group(batches, "task"):
            task, rep, weight, first, whole, h1 = (t.column(c).to_numpy() for c in ("task", "rep", "weight", "first", "whole", "h1"))
            cuts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]]))
            texts = t.column("text").combine_chunks()
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                shingles = Shingles(texts.slice(low, high - low), n)
                sets = [shingles.of(i) for i in range(high - low)]
                own = np.array([set_key(s)[0] for s in sets]) == h1[low:high]
                seen = np.flatnonzero(own)  # of repeated rows the first counts
                own[seen[1:][rep[low + seen[1:]] == rep[low + seen[:-1]]]] = False
                sets, at = [s for s, x in zip(sets, own, strict=True) if x], low + np.flatnonzero(own)
                cross, cut = not whole[low], int((first[at] == first[low]).sum())
                if len(at) < 2 or (cross and cut in (0, len(at))):
                    continue
                size = np.array([len(s) for s in sets])
                rows, columns = (size[:cut], size[cut:]) if cross else (size, size)
                both = overlaps(sets[:cut], sets[cut:]) if cross else overlaps(sets)
                link = both >= np.ceil(threshold * (rows[:, None] + columns[None] - both) - 1e-9)
                if not cross:
                    np.fill_diagonal(link, False)
                r, w = rep[at], weight[at]
                a, b = np.nonzero(link)
                links = np.zeros(len(at), np.int64)
                np.add.at(links, a, w[b + cut] if cross else w[b])
                if cross:
                    b = b + cut
                    np.add.at(links, b, w[a])
                order = np.argsort(r, kind="stable")
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                root = r[order][labels_of(len(r), place[a], place[b])[place]]
                some = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(r[some]), pa.array(links[some]), pa.array(root[some])], ["rep", "links", "root"])

    return tasks.mapInArrow(run, "rep long, links long, root long")


def texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (rep, text) of the documents with ids in ids, and of few others, which a bit table lets out of the scan; the join that follows is exact."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(ids, lambda rep: rep.view(np.uint64)))  # of bounded size

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(held(table.value, b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))

    return docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).where("rep is not null").mapInArrow(run, "rep long, text string")


def near_classes(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.99999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, class_id, n_links), one for each id: the smallest id of its class, and how many other ids it is linked with.

    Two texts are linked if their sets of n-word shingles (words divided by ASCII white space; a shorter text has one
    shingle) have a Jaccard similarity of at least the threshold; classes are the connected components of links. A text
    without words, null too, is linked with nothing. Ids are integers; rows with a null id have no row; of rows that
    share an id the one with the smallest set hash counts, and they have one row together. Sets are taken for equal where
    their 128-bit hashes are. There are no ties to break: all links count. Other columns are not read. An empty table
    gives no rows. recall: the share of pairs at the threshold that some bucket holds.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sets = tables.keep(signatures(docs, n, id_col, text_col))
    one = sets.groupBy("doc").agg(F.min(F.struct("h1", "h2", "size")).alias("x")).select("doc", "x.*")
    groups = one.where("size > 0").groupBy("h1", "h2", "size").agg(F.min("doc").alias("rep"), F.count("*").alias("weight"))
    of = tables.keep(one.join(groups, ["h1", "h2", "size"], "left").select("doc", "h1", "size", F.coalesce("rep", "doc").alias("rep"), F.coalesce("weight", F.lit(1)).alias("weight"), (F.col("size") > 0).alias("full")))
    heads = of.where("doc = rep and full").select("rep", "h1", "size", "weight")
    reps = sets.withColumnRenamed("doc", "rep").join(heads, ["rep", "h1"], "left_semi").dropDuplicates(["rep"])
    edges = candidate_edges(tables.keep(reps.select("rep", "coordinates", "s1", "s2")), tables, threshold, recall, partitions)
    clusters = tables.keep(components(edges, tables))
    clusters = tables.keep(clusters.select(F.col("node").alias("rep"), "component").join(heads, "rep"))
    sizes = clusters.groupBy("component").agg(F.count("*").alias("c"), F.sum("size").alias("s"))
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    members = clusters.join(sizes, "component").select("rep", "component", "h1", "weight", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("first"))
    # a block meets itself and each other block of its cluster once
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("second")
    texts = texts_of(docs, members.select("rep"), id_col, text_col)
    tasks = texts.join(members, "rep").select("*", other)
    tasks = tasks.select(F.xxhash64("component", F.least("first", "second"), F.greatest("first", "second")).alias("task"), "rep", "weight", "first", (F.col("first") == F.col("second")).alias("whole"), "h1", "text")
    done = tables.keep(verify(tasks.repartition(partitions, "task").sortWithinPartitions("task", "first", "rep"), threshold, n))
    links = done.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(done.select(F.col("rep").alias("a"), F.col("root").alias("b")), tables).select(F.col("node").alias("rep"), "component")
    out = of.join(links, "rep", "left").join(classes, "rep", "left")
    return out.select(F.col("doc").alias(id_col), F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))


def one_of_each(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without those whose class has a smaller id; rows with a null id stay, and of repeated rows all."""
    gone = classes.where(F.col(id_col) != F.col("class_id")).select(F.col(id_col).alias("gone"))
    return docs.join(gone, docs[id_col].cast("long") == gone["gone"], "left_anti")

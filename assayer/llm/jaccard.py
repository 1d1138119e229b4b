"""Similarity join of documents on word shingles: T-occurrence search with DivideSkip.

1. Every document becomes the set of its k-word shingles, as 64-bit hashes.
   Documents with the same set are one node (of which nothing is expanded).
2. Nodes that can be linked are in one cluster: they agree in a band of minimum
   hashes, or others between them do. The number of bands is set from the
   threshold, so that a pair exactly at it is missed with probability 1e-12 at
   most; a cluster decides nothing, it is where a set is searched for.
3. An inverted index over a cluster's sets answers for each set which others
   reach the overlap T that the threshold asks of its size: the short lists are
   merged by a heap, which skips what can't come up often enough, and the long
   ones are probed by binary search for what did (DivideSkip). Overlaps are exact
   counts. A set that is in one component with another already isn't verified
   against it again.
   A cluster over a bound of sets or shingles is cut in blocks by hash. Each block
   is searched by itself and for up to PIVOTS sets of the cluster, the same for
   all blocks. The largest component that has one of these is settled: near
   copies of one text take one round over the blocks. A link that is left has an
   end outside of it. Two linked sets of sizes a and b share one of their first
   a - ceil(p a) + 1 and b - ceil(p b) + 1 shingles in any order that is the same
   for both; the order puts last what several pivots have. Only these shingles
   are dealt out, counted, and dropped where one set has them or none that isn't
   settled; sets that share what is left meet in ranges of shingles, in blocks
   again where a range is large. So pages of one template, which don't link,
   meet nowhere, and no link is lost.
4. Links make components; a component is named by its smallest doc_id.

Defined results: null and blank text have the empty set, which links with
nothing. Texts of fewer than k words have their words as one shingle. Repeated
rows and equal texts share a node and each get their row. A null doc_id is
never a component's name unless the component has no other (then it is null).
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import chunks, discard, distinct, mix, released, shingle_hashes, shuffle_partitions, staged, word_hashes
from assayer.llm.files import as_rows
from assayer.llm.graph import components
from assayer.llm.repeats import NO_ID

MISS = 1e-12
PIVOTS = 16
SALTS = 16
BLOCK_SETS = 1_000
BLOCK_SHINGLES = 2_000_000


def bands_for(percent: int) -> tuple[int, int]:
    """(bands, rows of each)."""
    rows = 4 if percent >= 88 else 3 if percent >= 75 else 2
    hit = (percent / 100) ** rows
    return math.ceil(math.log(MISS) / math.log(1 - hit)), rows


def band_keys(hashes: np.ndarray, place: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """rows x bands keys of the minimum hashes of each row's shingles; rows without shingles get 0."""
    filled = np.flatnonzero(np.diff(place))
    out = np.zeros((len(place) - 1, bands), np.uint64)
    if not len(filled):
        return out
    starts = place[:-1][filled]
    for b in range(bands):
        key = np.full(len(filled), b + 1, np.uint64)
        for r in range(rows):
            i = b * rows + r
            low = np.minimum.reduceat((hashes ^ mix(np.array([2 * i + 1], np.uint64))) * (mix(np.array([2 * i + 2], np.uint64)) | np.uint64(1)), starts)
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low)
        out[filled, b] = key
    return out


def sketches(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, mark, n_shingles, node, keys) of every row; mark is a hash of the text, node names the set (null for the empty one)."""
    bands, rows = bands_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in chunks(batch):
                words, _, bounds = word_hashes(data, at)
                hashes, place = shingle_hashes(words, bounds, k)
                keys = band_keys(hashes, place, bands, rows)
                out, flat = [], []
                for i, (doc, mark) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("mark").to_pylist(), strict=True)):
                    own = distinct(hashes[place[i] : place[i + 1]])
                    out.append((doc, mark, len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None))
                    flat.append(keys[i] if len(own) else keys[i, :0])
                batch_rows = as_rows(["doc_id", "mark", "n_shingles", "node"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()], out)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in flat])]), pa.int32()), pa.array(np.concatenate(flat).astype(np.int64) if flat else [], pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch_rows.columns, lists], names=["doc_id", "mark", "n_shingles", "node", "keys"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    return rows_in.mapInArrow(run, "doc_id long, mark long, n_shingles long, node binary, keys array<long>")


def required(a, b, percent: int):
    """Least overlap of sets of a and b members that are linked: 100 * overlap >= percent * (a + b - overlap)."""
    return -(-percent * (a + b) // (100 + percent))


def merged_by_heap(flat: list[int], heads: list[tuple[int, int]], least: int, below: int) -> Iterator[tuple[int, int]]:
    """(x, count) of each number under `below` that is in at least `least` of the ascending lists flat[begin:end]."""
    heap = [(flat[p], p, end) for p, end in heads]
    heapq.heapify(heap)
    while len(heap) >= least and heap[0][0] < below:
        x, count = heap[0][0], 0
        taken = []
        while heap and heap[0][0] == x:
            taken.append(heapq.heappop(heap))
            count += 1
        if count >= least:
            yield x, count
            target = x + 1
        else:  # what follows comes up often enough only from the number that so few more lists reach
            while heap and len(taken) < least - 1:
                taken.append(heapq.heappop(heap))
            if not heap:
                return
            target = heap[0][0]
        for _, p, end in taken:
            p = bisect_left(flat, target, p, end)
            if p < end:
                heapq.heappush(heap, (flat[p], p, end))


def t_occurrence(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, known: Callable[[int, int], bool] = lambda i, j: False) -> Iterator[tuple[int, list[int]]]:
    """(i, partners) for each set with links, every link once. side: links between two sets of side 1 don't count. known(i, j): that link needs no search."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")  # by size: partners of i come after it
    sizes = sizes[order]
    n = len(sets)
    if n < 2:
        return
    _, token = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    by_token = np.argsort(token, kind="stable")
    ends = np.cumsum(np.bincount(token))
    where = np.empty(len(token), np.int64)
    where[by_token] = np.arange(len(token))  # the place of a set's own entry in its token's list
    begin, end = where + 1, ends[token]
    flat = np.repeat(np.arange(n), sizes)[by_token].tolist()  # the inverted lists, one after another, each ascending
    first = np.concatenate([[0], np.cumsum(sizes)])
    largest = np.searchsorted(sizes, sizes * 100 // percent, "right").tolist()  # partners are below this
    names = order.tolist()
    sides = side[order].tolist() if side is not None else None
    for i in range(n - 1):
        size = int(sizes[i])
        if not size or all((sides is not None and sides[x] and sides[i]) or known(names[i], names[x]) for x in range(i + 1, largest[i])):
            continue
        own = slice(first[i], first[i + 1])
        length = end[own] - begin[own]
        need = int(required(size, size, percent))
        live = np.flatnonzero(length)
        if len(live) < need:
            continue
        live = live[np.argsort(length[live], kind="stable")]
        lists = list(zip(begin[own][live].tolist(), end[own][live].tolist(), strict=True))
        long = min(need - 1, int(need / (0.01 * math.log2(int(length[live[-1]]) + 1) + 1)))
        short, rest = lists[: len(lists) - long], lists[len(lists) - long :]
        linked = []
        for x, count in merged_by_heap(flat, short, need - long, largest[i]):
            if sides is not None and sides[x] and sides[i] or known(names[i], names[x]):
                continue
            want, left = int(required(size, sizes[x], percent)), len(rest)
            for a, b in rest:
                if count >= want or count + left < want:
                    break
                p = bisect_left(flat, x, a, b)
                count += p < b and flat[p] == x
                left -= 1
            if count >= want:
                linked.append(names[x])
        if linked:
            yield names[i], linked


def _join_block(nodes: list[bytes], sets: list[np.ndarray], side: np.ndarray | None, percent: int) -> list[tuple]:
    """(node, root): a forest whose trees are the components of the links; a root is its component's first node."""
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, partners in t_occurrence(sets, percent, side, lambda i, j: find(i) == find(j)):
        for j in partners:
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return [(nodes[i], nodes[find(i)]) for i in range(len(nodes)) if find(i) != i]


def _searched(sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the links found in each group (cluster, block, other) of rows with (node, side, set); links between two of side 1 only count where a group has no other."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["u", "v"], [pa.binary(), pa.binary()]
        key, nodes_, sets_, side_, known, out = None, [], [], [], set(), []

        def close() -> None:
            if len(nodes_) > 1:
                out.extend(_join_block(nodes_, sets_, np.array(side_) if key[2] is not None else None, percent))

        for batch in batches:
            for *own, node, side, blob in zip(*(batch.column(c).to_pylist() for c in ("cluster", "block", "other", "node", "side", "set")), strict=True):
                if own != key:
                    close()
                    key, nodes_, sets_, side_, known = own, [], [], [], set()
                    if len(out) > 10_000:
                        yield as_rows(names, kinds, out)
                        out.clear()
                if node in known:  # a set that is on both sides is taken once, on side 0
                    continue
                known.add(node)
                nodes_.append(node)
                sets_.append(np.frombuffer(blob, np.uint64))
                side_.append(side)
        close()
        yield as_rows(names, kinds, out)

    by = ["cluster", "block", "other"]
    n = shuffle_partitions(sets.sparkSession)
    return sets.repartition(n, *by).sortWithinPartitions(*by, "side", "node").mapInArrow(join, "u binary, v binary")


def links(docs: DataFrame, marks: DataFrame, k: int, percent: int, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(u, v) of linked nodes, as many as make the components. marks: staged sketches."""
    nodes = marks.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("_of"), F.max("n_shingles").alias("n"), F.first("keys").alias("keys"))
    nodes = staged(nodes.select("node", F.col("_of.doc_id").alias("_doc"), F.col("_of.mark").alias("_mark"), "n", "keys"), "nodes")
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").drop("last")
    near = components(keyed.join(hubs, "key").select(F.col("node").alias("u"), F.col("hub").alias("v")))
    cluster = near.select(F.col("u").alias("node"), F.col("v").alias("cluster")).unionByName(near.select(F.col("v").alias("node"), F.col("v").alias("cluster")).distinct())
    member = staged(cluster.join(nodes.drop("keys"), "node").withColumn("_salt", F.pmod(F.hash("node"), F.lit(SALTS))), "clusters")
    discard(nodes)
    discard(near)
    clusters = member
    size = member.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / F.lit(block_sets), F.sum("n") / F.lit(block_shingles))).cast("int").alias("blocks")).where("blocks > 1")
    size = size.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    blocks = F.coalesce("blocks", F.lit(1))
    member = member.join(size.hint("merge"), ["cluster", "_salt"], "left").select("node", "cluster", "_doc", "_mark", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    member = staged(member, "members")
    discard(clusters)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("node", "cluster", "block", "blocks")
        for batch in batches:
            for part, data, at in chunks(batch):
                words, _, bounds = word_hashes(data, at)
                hashes, place = shingle_hashes(words, bounds, k)
                out = [distinct(hashes[a:b]).tobytes() for a, b in zip(place[:-1], place[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(out, pa.binary())], names=[*names, "set"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    # a merge at every size: members grow with the documents
    same = (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    wanted = texts.join(member.hint("merge"), same).dropDuplicates(["node"]).select("node", "cluster", "block", "blocks", "text")
    sets = staged(wanted.mapInArrow(read, "node binary, cluster binary, block int, blocks int, set binary"), "sets")
    discard(member)
    released(docs.sparkSession)
    none = F.lit(None).cast("int")
    own = sets.select("cluster", "block", none.alias("other"), "node", F.lit(1).alias("side"), "set")
    several = sets.where("blocks > 1")
    if several.isEmpty():
        found = staged(_searched(own, percent), "links")
        discard(sets)
        return found
    first = several.groupBy("cluster").agg(F.slice(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64(F.lit(7), "node"), F.greatest(F.lit(1), F.floor(F.col("blocks") * block_sets / (2 * PIVOTS)))) == 0, F.col("node")))), 1, PIVOTS).alias("nodes"))
    pivots = several.join(first.select("cluster", F.explode("nodes").alias("node")).hint("merge"), ["cluster", "node"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = staged(_searched(own.unionByName(pivots.select("cluster", "block", none.alias("other"), "node", F.lit(0).alias("side"), "set")), percent), "links")
    # pivots come first in every block, so a component that has some has the same root in all blocks
    root = found.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("top"))
    top = several.select("cluster", "node").join(root.hint("merge"), "node", "left").withColumn("top", F.coalesce("top", "node"))
    top = staged(top, "tops")
    main = top.groupBy("cluster", "top").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "top"))["top"].alias("main"))
    main = main.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rest = staged(top.withColumn("_salt", F.pmod(F.hash("node"), F.lit(SALTS))).join(main.hint("merge"), ["cluster", "_salt"]).where("top <> main").select("cluster", "node"), "rest")
    discard(top)
    if not rest.isEmpty():
        across = _across(several, several.join(first.select("cluster", F.explode("nodes").alias("node")).hint("merge"), ["cluster", "node"]), rest, percent, block_sets)
        found = found.unionByName(staged(_searched(across, percent), "links-across"))
    discard(sets)
    return found


def prefix(tokens: np.ndarray, common: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in its cluster's order, of which it shares one with whatever it is linked to. common: ascending, shingles that several pivots have; often: how many."""
    rank = np.zeros(len(tokens), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        rank = np.where(common[at] == tokens, often[at], 0)
    return tokens[np.lexsort((mix(tokens), rank))[: len(tokens) + percent * len(tokens) // -100 + 1]]


def _across(several: DataFrame, pivots: DataFrame, rest: DataFrame, percent: int, block_sets: int) -> DataFrame:
    """Groups for `_searched` of sets that may be linked to one of rest: those that share a shingle of their prefixes with it."""
    salted = lambda df: df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = lambda df: df.withColumn("_salt", F.pmod(F.hash("node"), F.lit(SALTS)))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cluster, sets in zip(batch.column("cluster").to_pylist(), batch.column("sets").to_pylist(), strict=True):
                tokens, often = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in sets]), return_counts=True)
                out.append((cluster, tokens[often > 1].tobytes(), often[often > 1].astype(np.int64).tobytes()))
            yield as_rows(["cluster", "common", "often"], [pa.binary()] * 3, out)

    common = pivots.groupBy("cluster").agg(F.collect_list("set").alias("sets")).mapInArrow(shared, "cluster binary, common binary, often binary")  # PIVOTS sets at most

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ends = [], [0]
            for blob, tokens, often in zip(*(batch.column(c).to_pylist() for c in ("set", "common", "often")), strict=True):
                own = prefix(np.frombuffer(blob, np.uint64), np.frombuffer(tokens or b"", np.uint64), np.frombuffer(often or b"", np.int64), percent)
                found.append(own.view(np.int64))
                ends.append(ends[-1] + len(own))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("cluster"), batch.column("node"), batch.column("blocks"), lists], names=["cluster", "node", "blocks", "tokens"])

    known = dealt(several.select("cluster", "node", "blocks", "set")).join(salted(common).hint("merge"), ["cluster", "_salt"], "left").drop("_salt")
    prefixes = known.mapInArrow(first, "cluster binary, node binary, blocks int, tokens array<long>")
    open_ = prefixes.join(rest.withColumn("open", F.lit(True)).hint("merge"), ["cluster", "node"], "left")
    each = staged(open_.select("cluster", "node", "blocks", F.col("open").isNotNull().alias("open"), F.explode("tokens").alias("token")), "prefixes")
    live = each.groupBy("cluster", "token").agg(F.count("*").alias("n"), F.max("open").alias("any")).where("n > 1 and any").select("cluster", "token")
    part = F.pmod(F.xxhash64("token"), "blocks").cast("string")
    meet = dealt(each).join(salted(live).hint("merge"), ["cluster", "token", "_salt"]).select(F.concat("cluster", F.encode(part, "UTF-8")).alias("group"), "node", "open").distinct()
    meet = staged(meet, "meeting")
    sizes = meet.groupBy("group").agg(F.ceil(F.count("*") / F.lit(block_sets)).cast("int").alias("blocks"), F.ceil(F.count_if("open") / F.lit(block_sets)).cast("int").alias("others")).where("others > 0")
    each = dealt(meet).join(salted(sizes).hint("merge"), ["group", "_salt"])
    number = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = each.withColumns({"block": number("blocks"), "other": F.explode(F.sequence(F.lit(0), F.col("others") - 1)), "side": F.lit(1)})
    asked = each.where("open").withColumns({"other": number("others"), "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "side": F.lit(0)})
    columns = ["group", "block", "other", "node", "side"]
    groups = every.select(columns).unionByName(asked.select(columns))
    return groups.join(several.select("node", "set").hint("merge"), "node").withColumnRenamed("group", "cluster").select("cluster", "block", "other", "node", "side", "set")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, mark, n_shingles, component_id and component (a name of it that is never null but for empty sets)."""
    marks = staged(sketches(docs, k, percent), "sketches")
    found = links(docs, marks, k, percent, block_sets, block_shingles)
    joined = components(found)
    discard(found)
    named = joined.select(F.col("u").alias("node"), F.col("v").alias("top"))
    nodes = marks.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc")).join(named, "node", "left")
    nodes = staged(nodes.select("node", "doc", F.coalesce("top", "node").alias("component")), "nodes-named")
    least = nodes.groupBy("component").agg(F.min("doc").alias("component_id")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = nodes.withColumn("_salt", F.pmod(F.hash("node"), F.lit(SALTS))).join(least.hint("merge"), ["component", "_salt"]).select("node", "component_id", "component")
    full = marks.where("n_shingles > 0").drop("keys").join(named, "node").select("doc_id", "mark", "n_shingles", "component_id", "component")
    empty = marks.where("n_shingles = 0").select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("component"))
    return full.unionByName(empty)


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: that of the least (doc_id, mark), null ids last. All columns are kept.

    Rows alike in doc_id and text are one document. Documents without words are in no component and all stay.
    """
    found = near_duplicates(docs, k, percent)
    name = F.struct(F.coalesce("doc_id", F.lit(int(NO_ID))).alias("id"), F.col("mark"))
    grouped = found.where("component is not null").groupBy("component").agg(F.min(name).alias("x"))
    a, b = ("_keep_id", "_keep_mark")
    while {a, b} & set(docs.columns):
        a, b = f"_{a}", f"_{b}"
    keep = grouped.select(F.col("x.id").alias(a), F.col("x.mark").alias(b))
    keep = keep.unionByName(found.where("component is null").select(name["id"].alias(a), F.col("mark").alias(b)).distinct())
    keyed = docs.withColumns({a: F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))), b: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    return keyed.join(keep.hint("merge"), [a, b]).dropDuplicates([a, b]).select(*docs.columns)


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90).drop("mark", "component")

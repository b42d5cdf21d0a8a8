"""Near duplicates by SimHash, searched in BK-trees.

A fingerprint holds, for every bit, whether over half of a document's shingle hashes have it set. Fingerprints that
differ in at most ``radius`` bits are linked. The different fingerprints are dealt to shards in which every linked pair
meets at least once; a shard builds a BK-tree, in which the child of a node is keyed by its Hamming distance to that
node, and a search follows only those edges whose key is within the radius of the distance to the node.

A shard with more than ``cell`` fingerprints is cut into several trees, and each tree is sent to every block of the
shard's fingerprints, so no task ever holds more than a fixed number and no pair is missed. A shard returns the links of
its spanning forest, never all pairs; forests of all shards are joined to components.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import components, inner_names, meet, written

SEED = 42
UPPER_TO_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
STEP = 1 << 15


def _shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words; of the whole sequence if there are fewer; nothing without words."""
    found = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(UPPER_TO_LOWER))
    if not found:
        return np.empty(0, np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed)], np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(found) - words + 1)


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a number."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STEP):
        part = hashes[i : i + STEP].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big") if len(hashes) else 0


def _mix(hashes: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    """Another 64-bit hash of a hash (a multiply-xorshift finaliser)."""
    with np.errstate(over="ignore"):
        x = hashes ^ (np.uint64(salt) if isinstance(salt, int) else salt) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _print(hashes: np.ndarray, width: int) -> bytes:
    return b"".join(_majority(hashes if k == 0 else _mix(hashes, k)).to_bytes(8, "big") for k in range(width))


def fingerprint(text: str | None, words: int = 3, width: int = 1) -> bytes:
    """The fingerprint of one text: ``width`` times 64 bits, big-endian; all zero without words."""
    return _print(_shingle_hashes(text, words, SEED), width)


def bands(hashes: np.ndarray, tables: int, rows: int) -> list[int]:
    """Shard keys of a set of shingle hashes: for each table a hash of ``rows`` smallest ones, each under another mix."""
    if not len(hashes):
        return [0] * tables
    salts = np.arange(1000, 1000 + tables * rows, dtype=np.uint64)[:, None]
    least = np.full(tables * rows, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), STEP):
        least = np.minimum(least, _mix(hashes[None, i : i + STEP], salts).min(axis=1))
    return [xxhash.xxh64_intdigest(part.tobytes()) >> 1 for part in least.reshape(tables, rows)]


def sketches(docs: DataFrame, id: str, text: str, words: int, width: int, tables: int = 0, rows: int = 0) -> DataFrame:
    """``(id, fp)`` for every row. The text is read whole and not passed on.

    With ``tables``, fingerprints are of the sets of shingles instead of their sequences, eight bytes of a hash of the
    text stand behind them, so that different texts never share one, and ``keys`` are the shards of the text.
    """
    schema = f"`id` {docs.schema[id].dataType.simpleString()}, fp binary, keys array<long>"

    def one(text: str | None) -> tuple[bytes, list[int]]:
        hashes = _shingle_hashes(text, words, SEED)
        if not tables:
            return _print(hashes, width), []
        hashes = np.unique(hashes)
        whole = xxhash.xxh64_digest((text or "").encode("utf-8", "surrogatepass"), SEED)
        return _print(hashes, width) + whole, bands(hashes, tables, rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                fps, keys = zip(*[one(t.as_py()) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["id", "fp", "keys"],
                )

    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(work, schema)


def block_masks(bits: int, radius: int, fixed: int) -> list[int]:
    """Masks of which at least one hides all bits in which two fingerprints within ``radius`` differ.

    The bits are cut into ``radius + fixed`` blocks; ``radius`` differing bits touch at most ``radius`` blocks, so some
    choice of ``fixed`` blocks is equal in both.
    """
    edges = [round(bits * i / (radius + fixed)) for i in range(radius + fixed + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(choice) for choice in itertools.combinations(blocks, fixed)]


class Forest:
    """BK-trees over fingerprints ``codes[n, width]``, one for each group of equal ``groups`` (sorted).

    All trees are built and searched level by level as arrays: every level is one pass over what is still moving down.
    """

    def __init__(self, codes: np.ndarray, groups: np.ndarray):
        n = len(codes)
        self.codes, self.bits = codes, codes.shape[1] * 64 + 1
        first = np.concatenate(([True], groups[1:] != groups[:-1])) if n else np.zeros(0, bool)
        self.root = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        moving, node = np.flatnonzero(~first), self.root[~first]
        edge_key, edge_child = [], []
        while len(moving):
            key = node * self.bits + self.distance(moving, node)
            slots, owner, inverse = np.unique(key, return_index=True, return_inverse=True)
            edge_key.append(slots)
            edge_child.append(moving[owner])
            settled = np.zeros(len(moving), bool)
            settled[owner] = True
            node = moving[owner][inverse][~settled]
            moving = moving[~settled]
        keys = np.concatenate(edge_key) if edge_key else np.zeros(0, np.int64)
        children = np.concatenate(edge_child) if edge_child else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.edge_key, self.edge_child = keys[order], children[order]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.codes[a] ^ self.codes[b]).sum(axis=1, dtype=np.int64)

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int, chunk: int = 1 << 18):
        """Pairs (query, node) within the radius, in pieces; a query finds itself too."""
        stack = [(queries, roots)]
        while stack:
            query, node = stack.pop()
            if len(query) > chunk:
                stack += [(query[i : i + chunk], node[i : i + chunk]) for i in range(0, len(query), chunk)]
                continue
            d = self.distance(query, node)
            hit = d <= radius
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(self.edge_key, node * self.bits + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(self.edge_key, node * self.bits + np.minimum(d + radius, self.bits - 1), "right")
            many = high - low
            if many.any():
                at = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
                stack.append((np.repeat(query, many), self.edge_child[at]))


def forest_labels(n: int, pieces) -> np.ndarray:
    """The smallest index that pairs connect each of ``n`` items with."""
    label = np.arange(n)
    for a, b in pieces:
        while True:
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                break
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def cell_pairs(codes: np.ndarray, groups: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, radius: int):
    """Index pairs within the radius, in pieces.

    Rows are sorted by group; rows of a group with ``in_tree`` form its BK-tree, rows with ``asks`` search it.
    """
    tree_rows = np.flatnonzero(in_tree)
    forest = Forest(codes[tree_rows], groups[tree_rows])
    starts = np.searchsorted(groups[tree_rows], groups[asks], "left")
    ends = np.searchsorted(groups[tree_rows], groups[asks], "right")
    queries = np.flatnonzero(asks)[ends > starts]
    starts = starts[ends > starts]
    # the searching rows stand behind those of the trees
    forest.codes = np.concatenate([forest.codes, codes[queries]])
    base = len(tree_rows)
    back = np.concatenate([tree_rows, queries])
    return ((back[q], back[t]) for q, t in forest.search(base + np.arange(len(queries)), starts, radius))


def cell_links(codes: np.ndarray, groups: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, radius: int):
    """Index pairs of a spanning forest of each group's links."""
    label = forest_labels(len(codes), cell_pairs(codes, groups, in_tree, asks, radius))
    child = np.flatnonzero(label != np.arange(len(codes)))
    return child, label[child]


def confirmed_labels(n: int, pieces, holds) -> np.ndarray:
    """As :func:`forest_labels`, but a pair counts only if ``holds(i, j)``. Pairs that are connected already are not
    asked for; of those that join the same two parts, one is asked at a time until one holds."""
    label = np.arange(n)
    for a, b in pieces:
        while True:
            open_ = label[a] != label[b]
            a, b = a[open_], b[open_]
            if not len(a):
                break
            # one pair for every part at a time: most hold, and then spare their part all others
            _, first = np.unique(label[a], return_index=True)
            good = first[[holds(i, j) for i, j in zip(a[first].tolist(), b[first].tolist())]]
            joined = forest_labels(n, [(label[a[good]], label[b[good]])])
            label = joined[label]
            rest = np.ones(len(a), bool)
            rest[first] = False
            a, b = a[rest], b[rest]
    return label


def in_cells(dealt: DataFrame, search, schema: str, most_rows: int = 50_000, most_bytes: int = 1 << 27) -> DataFrame:
    """``search`` applied to tables of whole cells ``(tab, key, i, j)`` of a table that is dealt and sorted by them."""
    names = ("tab", "key", "i", "j")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = size = 0

        def cut(table: pa.Table) -> int:
            """Where the last cell of the table begins; it may go on in the next batch."""
            at = table.num_rows - 1
            same = np.ones(table.num_rows, bool)
            for c in names:
                same &= table.column(c).to_numpy() == table.column(c)[at].as_py()
            return int(np.argmax(same))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            size += batch.nbytes
            if rows >= most_rows or size >= most_bytes:
                table = pa.Table.from_batches(held)
                at = cut(table)
                if at:
                    yield search(table.slice(0, at))
                rest = table.slice(at)
                held, rows, size = rest.to_batches(), rest.num_rows, 0
        if rows:
            yield search(pa.Table.from_batches(held))

    return dealt.mapInArrow(work, schema)


def dealt_to_cells(nodes: DataFrame, trees: Column, name: str) -> DataFrame:
    """Rows of groups ``(tab, key)`` dealt to cells: a group is cut into so many trees, and tree i meets block j once,
    for i <= j."""
    dealt = nodes.withColumn("trees", trees).withColumn("own", F.pmod(F.xxhash64(name), F.col("trees")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "trees")
    return dealt.repartition("tab", "key", "i", "j").sortWithinPartitions("tab", "key", "i", "j", "own", name)


def _cells_of(table: pa.Table, width: int | None):
    """Fingerprints, codes, group numbers, and which rows stand in the tree and which search it, of a table of cells."""
    fps = table.column("fp").combine_chunks().to_pylist()
    codes = np.frombuffer(b"".join(fps), ">u8").reshape(len(fps), -1)[:, :width].astype(np.uint64)
    tab, key, i, j, own = (table.column(c).combine_chunks().to_numpy() for c in ("tab", "key", "i", "j", "own"))
    change = np.concatenate(([True], (tab[1:] != tab[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
    return fps, codes, np.cumsum(change), own == i, own == j


def links(nodes: DataFrame, radius: int, cell: int = 2048, width: int | None = None) -> DataFrame:
    """Edges ``(a, b)`` that connect every pair of fingerprints within ``radius`` that shares a shard.

    ``nodes (fp, tab, key)``: a fingerprint and the shards it is in, no row twice; distances are those of the first
    ``width`` times 64 bits.
    """
    counts = nodes.groupBy("tab", "key").agg(F.count("*").alias("n")).where("n > 1")
    joined = nodes.join(counts, ["tab", "key"])
    dealt = dealt_to_cells(joined, F.ceil(F.col("n") / F.lit(cell)).cast("int"), "fp").select("tab", "key", "i", "j", "own", "fp")

    def search(table: pa.Table) -> pa.RecordBatch:
        fps, codes, groups, in_tree, asks = _cells_of(table, width)
        child, root = cell_links(codes, groups, in_tree, asks, radius)
        pick = lambda rows: pa.array([fps[r] for r in rows.tolist()], pa.binary())
        return pa.RecordBatch.from_arrays([pick(child), pick(root)], names=["a", "b"])

    return in_cells(dealt, search, "a binary, b binary").distinct()


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """``(fp, root, size, hashes)`` of ``texts (fp, root, text)``: the sorted set of shingle hashes as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                sets = [np.unique(_shingle_hashes(t.as_py(), words, SEED)) for t in batch.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())],
                    names=["fp", "root", "size", "hashes"],
                )

    return texts.select("fp", "root", "text").mapInArrow(work, "fp binary, root binary, size long, hashes binary")


def confirmed(sets: DataFrame, radius: int, width: int, similarity: float, cell: int = 400_000) -> DataFrame:
    """Edges ``(a, b)`` of pairs of one ``root`` within the radius whose sets overlap by ``similarity`` or more.

    ``sets`` comes from :func:`shingle_sets`, written. Groups are cut into trees of about ``cell`` shingles, so a task
    holds two trees of the group, and all their pairs within the radius meet in one cell. Not all of them are compared:
    what confirmed pairs connect needs no further pair.
    """
    totals = sets.groupBy("root").agg(F.sum(F.col("size") + 16).alias("total"), F.count("*").alias("n")).where("n > 1")
    joined = sets.join(totals, "root").select(F.lit(0).alias("tab"), F.col("root").alias("key"), "fp", "hashes", "total")
    dealt = dealt_to_cells(joined.withColumn("key", F.xxhash64("key")), F.ceil(F.col("total") / F.lit(cell)).cast("int"), "fp")
    dealt = dealt.select("tab", "key", "i", "j", "own", "fp", "hashes")

    def search(table: pa.Table) -> pa.RecordBatch:
        fps, codes, groups, in_tree, asks = _cells_of(table, width)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes").combine_chunks()]

        def holds(a: int, b: int) -> bool:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                return False
            both = len(np.intersect1d(x, y, assume_unique=True))
            return both >= similarity * (len(x) + len(y) - both) - 1e-9

        label = confirmed_labels(len(fps), cell_pairs(codes, groups, in_tree, asks, radius), holds)
        child = np.flatnonzero(label != np.arange(len(fps)))
        pick = lambda rows: pa.array([fps[r] for r in rows.tolist()], pa.binary())
        return pa.RecordBatch.from_arrays([pick(child), pick(label[child])], names=["a", "b"])

    return in_cells(dealt, search, "a binary, b binary").where("a != b").distinct()


def members(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """``(id, fp, root)`` for every row: the fingerprint, and the smallest fingerprint it is connected with.

    Every pair within ``radius`` of 64 bits is found: shards are the equal bits of some blocks, as many as keep an
    average shard small. Rows without words have the all-zero fingerprint and are linked like any others; null texts
    count as empty; repeated rows give repeated results.
    """
    sketch = written(sketches(docs, id, text, words, 1), "sketch").drop("keys")
    different = written(sketch.select("fp").distinct(), "fingerprints")
    count = different.count()
    fixed = 1
    while fixed < 4 and count / 2 ** (64 * fixed / (radius + fixed)) > 64:
        fixed += 1
    masks = block_masks(64, radius, fixed)
    number = F.conv(F.hex("fp"), 16, -10).cast("long")
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    shard = F.explode(
        F.array(*[F.struct(F.lit(t).alias("tab"), F.col("number").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(signed)])
    )
    nodes = different.withColumn("number", number).select("fp", shard.alias("s")).select("fp", "s.tab", "s.key")
    return _rooted(sketch, links(nodes, radius))


def similar(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    words: int = 5,
    similarity: float = 0.8,
    width: int = 4,
    tables: int = 16,
    rows: int = 3,
    deviations: float = 4.0,
) -> DataFrame:
    """``(id, fp, root)`` for every row, linking texts whose sets of shingles overlap by ``similarity`` or more.

    Uses ``width`` times 64 bits. The expected share of differing bits of two texts with shingle overlap J is
    ``acos(2 J / (1 + J)) / pi``; the radius is that share at ``similarity`` plus ``deviations`` standard deviations.
    Shards are bands of smallest shingle hashes: two texts with overlap J miss each other with probability ``(1 - J **
    rows) ** tables``, 1e-5 at 0.8 with the defaults. What is within the radius is only a candidate: a link is a pair
    whose sets of shingles were compared, so no text below ``similarity`` to all others of its group is in it.

    Rows of equal texts are in one group, null texts count as empty, and texts without words are alike. Null ids are
    like any other; repeated rows give repeated results.
    """
    bits = 64 * width
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    radius = int(bits * share + deviations * math.sqrt(bits * share * (1 - share)))
    sketch = written(sketches(docs, id, text, words, width, tables, rows), "sketch")
    nodes = sketch.select("fp", F.posexplode("keys").alias("tab", "key")).distinct()
    near = written(components(links(nodes, radius, width=width)), "candidates")
    sketch = sketch.drop("keys")
    # one row stands for all copies of a text; its text is found again by id and hash
    chosen = sketch.join(near.withColumnRenamed("node", "fp"), "fp").groupBy("fp", "root").agg(F.min("id").alias("_id"))
    whole = F.unhex(F.lpad(F.hex(F.xxhash64(F.coalesce(F.col(text), F.lit("")))), 16, "0"))
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), whole.alias("whole"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("whole") == F.substring("fp", 8 * width + 1, 8))
    sets = written(shingle_sets(texts.join(chosen, same), words), "sets")
    return _rooted(sketch, confirmed(sets, radius, width, similarity))


def _rooted(sketch: DataFrame, edges: DataFrame) -> DataFrame:
    roots = components(edges)
    return sketch.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "id", "fp", F.coalesce("root", "fp").alias("root")
    )


def with_components(found: DataFrame) -> DataFrame:
    """``(id, fp, component)``: the smallest id (null only if all are) of everything connected with the row."""
    # copies are merged before ids of a component meet
    found = written(found, "rooted")
    least = found.groupBy("fp", "root").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    least = least.groupBy("root").agg(F.min("least").alias("component"), F.sum("rows").alias("rows"))
    return meet(found, written(least, "least"), ["root"], "rows").select("id", "fp", "component")


def keep_one(docs: DataFrame, found: DataFrame, id: str = "doc_id") -> DataFrame:
    """Of each group the rows with its smallest id; rows that repeat that id stay only if they are all alike."""
    names = inner_names(docs, "chosen")
    chosen = found.groupBy("root").agg(F.min("id").alias(names[0])).select(names[0]).distinct()
    return docs.join(chosen, docs[id].eqNullSafe(chosen[names[0]]), "left_semi")


def hex_of(fp: Column) -> Column:
    return F.lower(F.hex(fp))

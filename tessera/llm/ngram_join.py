"""N-gram Jaccard join through a MinHash LSH forest.

Every whole text becomes the set of hashes of its five-word shingles (a shorter text is one shingle). Texts with equal
sets form a class. A class has a label of ``LONGEST`` MinHash values in every tree; texts whose labels begin alike meet
at a node of that tree. A prefix of ``length`` values reaches the target recall for pairs at the threshold in
:func:`trees_for` trees: the shorter the prefix, the fewer trees. So the prefix of each text is as short as the nodes it
then shares allow: where a node of a length is crowded (more than ``CROWD`` classes), its members go on to the next
longer prefix, in as many trees more as that one needs for the same recall; elsewhere the short one already decides.
Members of a node are sorted by label and compared by their whole labels, which estimate the similarity; only what an
estimate does not rule out (``MARGIN`` standard deviations under the threshold) becomes an edge, a star for each set of
members in reach of one another. Large nodes are compared block by block.

Components of these edges are the clusters whose pairs are verified exactly on their shingle sets, in blocks of
about ``BLOCK`` classes (fewer, if long) against one another; only counts and star edges leave a block, never the pairs. There is no cap on
nodes, partners or candidates.

A null or empty text, or one without words, has no links and is a class of its own; rows with a null doc_id likewise
(class_id is null then). Very long texts are whole sets. Rows that repeat a doc_id with equal words are in one class;
with different words they are different texts, each with its own links. Extra columns are ignored; empty tables give
none.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from tessera.llm.columnar import bound_batches, documents, stored, text_slices
from tessera.llm.components import components
from tessera.llm.words import mixed, rolling, word_hashes

SHINGLE = 5
#: Similarity of 0.8 as a fraction, so that the comparison is exact.
THRESHOLD = (4, 5)
TARGET_RECALL = 0.9995
#: Prefix lengths of the forest, from the shortest to the whole label.
LENGTHS = (4, 6, 8)
LONGEST = LENGTHS[-1]
#: Classes at one node from which its members take the next longer prefix.
CROWD = 1024
#: Standard deviations that an estimate may lie under the threshold.
MARGIN = 4.5
#: Classes of a node that one block holds for estimates, and of a cluster for exact comparison.
NODE_BLOCK, BLOCK = 1024, 128
#: Shingles that one block of a cluster holds about, where its texts are long.
BLOCK_SHINGLES = 300_000


def trees_for(length: int, threshold: float = THRESHOLD[0] / THRESHOLD[1], recall: float = TARGET_RECALL) -> int:
    """Trees in which a pair at the threshold shares a prefix of this length at least once with the target probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**length))


TREES = trees_for(LONGEST)
VALUES = TREES * LONGEST


def least_equal(threshold: float = THRESHOLD[0] / THRESHOLD[1]) -> int:
    """Equal values of two labels from which the pair may reach the threshold."""
    return math.floor(VALUES * threshold - MARGIN * math.sqrt(VALUES * threshold * (1 - threshold)))


def shingle_sets(texts: list[str], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, bounds = word_hashes(texts)
    grams, edges = rolling(hashes, bounds, width, salt=width)
    out = []
    for k in range(len(texts)):
        n = bounds[k + 1] - bounds[k]
        if n >= width:
            out.append(np.unique(grams[edges[k] : edges[k + 1]]))
        elif n:
            own, _ = rolling(hashes[bounds[k] : bounds[k + 1]], np.array([0, n]), int(n), salt=int(n))
            out.append(own)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def labels_of(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, VALUES) the top 16 bits of a mix of every MinHash value, tree by tree; sets are not empty."""
    joined = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.empty((len(sets), VALUES), np.uint16)
    for k in range(VALUES):
        factor = np.uint64((0xD1342543DE82EF95 * (2 * k + 3) | 1) & 0xFFFFFFFFFFFFFFFF)
        least = np.minimum.reduceat((joined ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * factor, starts)
        out[:, k] = mixed(least, k) >> np.uint64(48)
    return out


def prefix_keys(labels: np.ndarray, length: int) -> np.ndarray:
    """(classes, trees) for each class and tree that this length needs, a hash of the tree and the prefix."""
    own = labels.reshape(len(labels), TREES, LONGEST)[:, : trees_for(length), :length].astype(np.uint64)
    keys = np.broadcast_to(mixed(np.arange(own.shape[1], dtype=np.uint64), length), own.shape[:2])
    for place in range(length):
        keys = mixed(keys ^ own[:, :, place], place)
    return keys.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, size, first, second, labels): a 128-bit digest of the shingle set and its labels."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch):
                sets = shingle_sets(texts)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                labels: list[bytes | None] = [None] * len(sets)
                digest = np.zeros((2, len(sets)), np.uint64)
                if len(full):
                    own = [sets[k] for k in full]
                    for k, row in zip(full, labels_of(own), strict=True):
                        labels[k] = row.astype("<u2").tobytes()
                    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]]).astype(np.int64)
                    for half in (0, 1):
                        digest[half, full] = np.add.reduceat(mixed(np.concatenate(own), 101 + half), starts)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(sizes), *(pa.array(d.view(np.int64)) for d in digest), pa.array(labels, pa.binary())],
                    ["doc_id", "text_hash", "size", "first", "second", "labels"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, size long, first long, second long, labels binary")


def in_reach(labels: np.ndarray) -> np.ndarray:
    """For each row the least row in reach over pairs that may be similar.

    Rows like an earlier one hang on it at once; afterwards only rows of different sets are compared.
    """
    n, bound = len(labels), least_equal()
    group = np.arange(n)
    leads = np.ones(n, bool)

    def unite(k: int, rows: np.ndarray) -> np.ndarray:
        close = rows[(labels[rows] == labels[k]).sum(axis=1) >= bound]
        found = np.unique(group[np.append(close, k)])
        if len(found) > 1:
            group[np.isin(group, found)] = found[0]
        return close

    for k in range(n):
        if leads[k]:
            leads[unite(k, k + 1 + np.flatnonzero(leads[k + 1 :]))] = False
    for k in range(n):
        if len(rows := k + 1 + np.flatnonzero((group[k + 1 :] != group[k]) & ~(leads[k + 1 :] & leads[k]))):
            unite(k, rows)
    return group


def node_edges(places: DataFrame) -> DataFrame:
    """Star edges (a, b) from members of the nodes (node, labels, key, blocks) that a comparison of labels leaves."""
    dealt = places.withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) AS int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "labels", "node")
    dealt = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "labels", "node")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in _with_end(batches):
            if batch is not None:
                kept.append(batch)
                if sum(map(len, kept)) < 4 * NODE_BLOCK:
                    continue
            if not kept:
                return
            table = pa.Table.from_batches(kept).combine_chunks()
            ids = np.stack([table.column(c).to_numpy() for c in ("key", "low", "high")])
            cuts = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
            whole = len(table) if batch is None else int(cuts[-1]) if len(cuts) else 0  # the last node may go on
            kept = table.slice(whole).to_batches() if batch is not None else []
            if whole:
                yield _stars(table.slice(0, whole), [0, *cuts[cuts < whole].tolist(), whole])

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _with_end(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _stars(table: pa.Table, bounds: list[int]) -> pa.RecordBatch:
    """Edges of whole nodes that stand one after another."""
    labels = np.frombuffer(b"".join(table.column("labels").to_pylist()), "<u2").reshape(-1, VALUES)
    node = table.column("node").to_numpy()
    a, b = [], []
    starts, ends = np.array(bounds[:-1]), np.array(bounds[1:])
    twos = starts[ends - starts == 2]
    close = twos[(labels[twos] == labels[twos + 1]).sum(axis=1) >= least_equal()]
    a.append(node[close])
    b.append(node[close + 1])
    for at, end in zip(starts, ends, strict=True):
        if end - at > 2:
            group = in_reach(labels[at:end])
            hung = np.flatnonzero(group != np.arange(end - at))
            a.append(node[at:end][hung])
            b.append(node[at:end][group[hung]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def candidate_edges(classes: DataFrame) -> DataFrame:
    """Star edges between classes that meet in the forest and may be similar."""
    edges, going = None, classes.select("node", "labels")
    for length in LENGTHS:
        trees = trees_for(length)

        def unfold(batches: Iterable[pa.RecordBatch], length: int = length, trees: int = trees) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                labels = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, VALUES)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), trees))), pa.array(prefix_keys(labels, length).reshape(-1))], ["node", "key"])

        places = going.mapInArrow(unfold, "node long, key long")
        members = F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members")  # nodes of the same members are compared once
        sizes = stored(places.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"), members).filter("n > 1"), "nodes")
        last = length == LONGEST
        once = sizes.filter("true" if last else f"n <= {CROWD}").groupBy("n", "least", "members").agg(F.min("key").alias("key"))
        wanted = once.select("key", F.expr(f"cast(ceil(n / {NODE_BLOCK}) AS int)").alias("blocks"))
        shared = places.join(wanted, "key")
        found = stored(node_edges(shared.join(going, "node").select("node", "labels", "key", "blocks")), "edges")
        edges = found if edges is None else edges.unionByName(found)
        if last:
            return edges
        crowds = sizes.filter(f"n > {CROWD}").select("key")
        if crowds.isEmpty():
            return edges
        going = stored(going.join(places.join(crowds, "key").select("node").distinct(), "node"), "going")


def links_in_block(reps: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, threshold: tuple[int, int] = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Documents linked to each class, and the least class in reach over these links.

    ``side`` is None for all pairs of one block; else only pairs with different sides count.
    """
    n = len(reps)
    sizes = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(n), sizes)
    _, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = uses[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    width = max(1, (16 << 20) // (4 * n))
    common = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        part = np.zeros((n, min(width, int(column[b - 1]) - start + 1) if b > a else 1), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        common += part @ part.T
    common = np.rint(common).astype(np.int64)
    up, down = threshold
    linked = (up + down) * common >= up * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    label = reps.copy()
    while True:
        reach = np.where(linked, label[None, :], label[:, None]).min(axis=1, initial=np.iinfo(np.int64).max)
        reach = np.minimum(label, reach)
        if (reach == label).all():
            return linked @ copies, label
        label = reach


def verified(docs: DataFrame, classes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(node, links, label, alone): per block pair, links found and the least class reached; alone if it was the only block."""
    members = stored(classes.select("node", "rep", "copies", "size").join(clusters.withColumnRenamed("label", "cluster"), "node"), "members")
    sizes = stored(members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").alias("total")), "sizes")
    blocks = F.expr(f"cast(ceil(greatest(n / {BLOCK}, least(total / {BLOCK_SHINGLES}, n / 2))) AS int)")
    dealt = members.join(sizes, "cluster").select("node", "rep", "copies", "cluster", blocks.alias("blocks"))
    dealt = dealt.withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) AS int)"))
    own = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text")
    texts = own.join(dealt.hint("shuffle_hash"), (F.col("id") == F.col("rep.doc_id")) & (F.col("hash") == F.col("rep.text_hash"))).select("node", "copies", "cluster", "blocks", "block", "text")

    def shingle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, own in text_slices(batch):
                sets = pa.array([s.astype("<u8").tobytes() for s in shingle_sets(own)], pa.binary())
                yield pa.RecordBatch.from_arrays([*rows.columns[:5], sets], ["node", "copies", "cluster", "blocks", "block", "shingles"])

    sets = texts.mapInArrow(shingle, "node long, copies long, cluster long, blocks int, block int, shingles binary")
    pairs = sets.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node").sort_values("node")
        sets = [np.frombuffer(s, "<u8") for s in group["shingles"]]
        block = group["block"].to_numpy()
        side = None if group["low"].iloc[0] == group["high"].iloc[0] else block
        links, label = links_in_block(group["node"].to_numpy(), group["copies"].to_numpy(), sets, side)
        return pd.DataFrame({"node": group["node"].to_numpy(), "links": links, "label": label, "alone": group["blocks"].to_numpy() == 1})

    return pairs.groupBy("cluster", "low", "high").applyInPandas(compare, "node long, links long, label long, alone boolean")


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, first, second, takes_part) and classes (first, second, rep, copies, links, group, chosen).

    ``rep`` and ``chosen`` are the least (doc_id, text_hash) of the class and of its group.
    """
    rows = stored(signatures(docs), "signatures")
    least = F.min(F.struct("doc_id", "text_hash")).alias("rep")
    taking = rows.filter("size > 0 AND doc_id IS NOT NULL").groupBy("first", "second").agg(least, F.count("*").alias("copies"), F.max("size").alias("size"), F.min("labels").alias("labels"))
    classes = stored(taking.withColumn("node", F.monotonically_increasing_id()), "classes")
    clusters = components(candidate_edges(classes))
    found = stored(verified(docs, classes, clusters), "verified")
    across = components(found.filter("NOT alone AND label <> node").select(F.col("node").alias("a"), F.col("label").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"), F.min(F.expr("CASE WHEN alone THEN label END")).alias("within"))
    groups = stored(
        classes.select("first", "second", "node", "rep", "copies").join(links, "node", "left").join(across, "node", "left").select("first", "second", "rep", "copies", "links", F.coalesce("label", "within", "node").alias("group")),
        "groups",
    )
    chosen = groups.groupBy("group").agg(F.min("rep").alias("chosen"))
    return rows.select("doc_id", "text_hash", "first", "second", F.expr("size > 0 AND doc_id IS NOT NULL").alias("takes_part")), groups.join(chosen, "group").withColumn("takes_part", F.lit(True))


def join(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, text_hash, class_id (least doc_id of its group), copy_id (least with an equal set), n_links."""
    rows, groups = grouped(docs)
    return rows.join(groups, ["first", "second", "takes_part"], "left").select(
        "doc_id",
        "text_hash",
        F.coalesce("chosen.doc_id", "doc_id").alias("class_id"),
        F.coalesce("rep.doc_id", "doc_id").alias("copy_id"),
        F.expr("CASE WHEN rep IS NULL THEN 0L ELSE coalesce(links, 0L) + copies - 1 END").alias("n_links"),
    )


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links between all ``documents``: class and number of linked documents of each."""
    return join(documents(spark, sf_dir)).select("doc_id", "class_id", "copy_id", "n_links")


def orderable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return orderable(kind.elementType)
    if isinstance(kind, StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, MapType) and kind.typeName() not in ("variant", "void", "interval")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the least doc_id, of rows that repeat it the least by its columns.

    Null and empty texts are groups of their own, of which rows that repeat a doc_id go too; rows with a null doc_id stay
    all. Columns keep their names and values, whatever they are called; an empty table stays empty.
    """
    bound_batches(spark)
    rows, groups = grouped(docs)
    picked = rows.join(groups, ["first", "second", "takes_part"], "left").filter("doc_id IS NOT NULL AND (chosen IS NULL OR chosen = struct(doc_id, text_hash))")
    kept = picked.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.count("*").alias("n"))
    fields = [f"`{f.name}`" for f in docs.schema.fields if f.name not in ("doc_id", "text") and orderable(f.dataType)]
    own = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.struct(*fields or [F.lit(0)]).alias("order"), F.struct("*").alias("row"))
    found = own.join(kept, ["id", "hash"])
    # Repeated rows are rare or very many: they are dealt over salts first. Whatever salt a row gets, the least one stays.
    again = found.filter("n > 1").withColumn("salt", F.monotonically_increasing_id() % 64)
    for keys in ("id, hash, salt", "id, hash"):
        again = again.withColumn("turn", F.expr(f'row_number() OVER (PARTITION BY {keys} ORDER BY `order`)')).filter("turn = 1").drop("turn")
    return found.filter("n = 1").select("row").unionByName(again.select("row")).unionByName(own.filter("id IS NULL").select("row")).select("row.*")

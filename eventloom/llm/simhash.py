"""SimHash near-duplicates by generalised pigeonhole search in Hamming space.

Fingerprints: a text is lower-cased (A-Z), cut into words, and its word shingles, repeats
included, are hashed with XXH64 (seed 42); a bit of the fingerprint is 1 where over half the
hashes have it. A text with fewer words than a shingle has one shingle, the words it has; a text
without words has fingerprint zero and is linked like any other.

Search: the 64 bits are cut into m groups, correlated bits together. By the general pigeonhole
principle, if thresholds t_i satisfy sum(t_i + 1) = k + 1, two fingerprints within k bits are
within t_i bits in at least one group i (t_i = -1 leaves a group out). Dynamic programming picks
m and the thresholds that cost least by the estimated numbers of probes and candidates, from bit
counts over all fingerprints. Each fingerprint is filed under its own value in group i and probes
the values within t_i bits; candidates are verified on all 64 bits.

Scale: only distinct fingerprints are searched, so exact copies never meet. A bucket with over
BUCKET_ROWS fingerprints is cut into blocks and searched by pairs of blocks, each a task-sized
piece: exact, whatever the bucket's size. Tasks emit spanning edges (at most one a fingerprint and
piece), never all pairs of a group, and components are found with alternating stars.

Edge cases: null text is the empty text; rows that repeat a doc_id keep their own fingerprints; a
null doc_id takes part and its component_id is the smallest non-null id; very long texts are hashed whole, 65,536
shingles at a time; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import materialised
from eventloom.llm.components import components, forest
from eventloom.llm.ranks import join_ranks
from eventloom.llm.textkit import mix64

BITS = 64
#: Fingerprints of one bucket that are compared in one piece.
BUCKET_ROWS = 4096
#: Estimated costs: a filed or probing row against a compared pair.
ROW_COST, PAIR_COST = 100.0, 1.0
#: The seed of the hashes of shingles.
SEED = 42
#: Bands of a text's least shingle hashes and hashes a band. Texts of similarity s share no band with a probability of
#: (1 - s ** DEPTH) ** BANDS: 1.3e-7 at 0.8, below 1e-15 at 0.9.
BANDS, DEPTH = 40, 5
#: Texts, and shingles of them, of one candidate class that are compared in one piece (about half of it a block).
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 19

_ORDERS = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * DEPTH, dtype=np.uint64)


def fingerprint(data: bytes, words: int = 3) -> int:
    """The 64-bit SimHash of a UTF-8 text."""
    found = data.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    last = ends[-n:] if len(found) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)], dtype=">u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">u8")[0])


def shingle_set(data: bytes, words: int) -> np.ndarray:
    """The distinct 64-bit hashes, sorted, of the shingles of a lower-cased UTF-8 text."""
    found = data.lower().split()
    digest = xxhash.xxh64_intdigest
    hashes = {digest(b" ".join(found[i : i + words]), SEED) for i in range(max(1, len(found) - words + 1))}
    return np.sort(np.fromiter(hashes, np.uint64, len(hashes)))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS names, each of the least of the shingles in DEPTH random orders of its own."""
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 1024):
        least = np.minimum(least, mix64(shingles[None, at : at + 1024] ^ _ORDERS[:, None]).min(axis=1))
    folded = np.arange(BANDS, dtype=np.uint64)
    for k in range(DEPTH):
        folded = mix64(folded * np.uint64(0x9E3779B97F4A7C15) + least[k::DEPTH])
    return folded


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long), a row per input row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            made = np.fromiter((fingerprint(x.as_py() or b"", words) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and how often two bits are both 1, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy()).astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        i, j = np.triu_indices(BITS)
        if n:
            yield pa.RecordBatch.from_pydict({"i": np.append(i, -1).astype(np.int32), "j": np.append(j, -1).astype(np.int32), "n": np.append(total[i, j], n).astype(np.int64)})

    sums = fps.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 2,081 rows
    both, n = np.zeros((BITS, BITS)), 0
    for row in sums:
        if row.i < 0:
            n = row.n
        else:
            both[row.i, row.j] = both[row.j, row.i] = row.n
    return n, both


def _bits(values: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones for each value, the lowest bit first."""
    return np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m groups of about equal size, each grown from its seed by the highest correlation with the group."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    strength = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(strength, 0)
    left, groups = list(range(BITS)), []
    for k in range(m):
        width = -(-len(left) // (m - k))
        group = [max(left, key=lambda b: (strength[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < width:
            group.append(max(left, key=lambda b: (strength[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def within(n: int, both: np.ndarray, group: list[int], k: int) -> np.ndarray:
    """Estimated shares of pairs at most 0 .. k bits apart in the group, from the bits' shares of ones."""
    p = np.diag(both)[group] / max(n, 1)
    differ = np.maximum(2 * p * (1 - p), 1e-3)
    at = np.zeros(k + 1)
    at[0] = 1
    for q in differ:
        at[1:], at[0] = at[1:] * (1 - q) + at[:-1] * q, at[0] * (1 - q)
    return np.cumsum(at)


def allocate(n: int, both: np.ndarray, k: int, sizes: tuple[int, ...] = (2, 3, 4, 5, 6)) -> list[tuple[list[int], int]]:
    """Bit groups with their thresholds: the cheapest split of k + 1 among the groups, over several numbers of groups."""
    best, plan = np.inf, []
    for m in (s for s in sizes if s <= max(k + 1, 2)):
        groups = bit_groups(n, both, m)
        costs = []
        for group in groups:
            share = within(n, both, group, k)
            probes = np.cumsum([comb(len(group), t) for t in range(k + 1)])
            costs.append(np.concatenate(([0.0], n * probes * ROW_COST + 0.5 * n * n * share * PAIR_COST)))
        least = np.full((m + 1, k + 2), np.inf)
        least[0, 0] = 0
        choice = np.zeros((m + 1, k + 2), int)
        for g in range(m):
            for used in range(k + 2):
                for take in range(used + 1):
                    cost = least[g, used - take] + costs[g][take]
                    if cost < least[g + 1, used]:
                        least[g + 1, used], choice[g + 1, used] = cost, take
        if least[m, k + 1] < best:
            best, used, plan = least[m, k + 1], k + 1, []
            for g in range(m, 0, -1):
                take = choice[g, used]
                used -= take
                if take:
                    plan.append((groups[g - 1], int(take) - 1))
    return plan


def _filed(plan: list[tuple[list[int], int]], names: list[str]):
    """Rows (part, key, own, then the columns `names`, the first of which is the fingerprint): each row under its own value of a group and those within the group's threshold.

    Of two values one bit apart, one has the bit and the other is it without the bit, so single
    flips only clear bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for part, (group, threshold) in enumerate(plan):
                mask = np.uint64(sum(1 << b for b in group))
                for flips in range(threshold + 1):
                    for bits in combinations(group, flips):
                        change = np.uint64(sum(1 << b for b in bits))
                        rows = np.flatnonzero(fps & change) if flips == 1 else np.arange(len(fps))
                        key = ((fps[rows] & mask) ^ change).view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(rows), part, np.int32)), pa.array(key), pa.array(np.full(len(rows), not flips)), *(c.take(pa.array(rows)) for c in batch.columns)],
                            ["part", "key", "own", *names],
                        )

    return run


def _linked(k: int):
    """Spanning edges of the rows within k bits of each other in each piece of a bucket; rows come sorted by piece."""

    def edges(piece: np.ndarray, own: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        node, values = columns[1], columns[0].view(np.uint64)
        left, right, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        at = np.arange(len(node))
        step = 1
        while True:
            at = at[at + step < len(node)]
            at = at[piece[at] == piece[at + step]]
            if not len(at):
                break
            near = at[(own[at] | own[at + step]) & (np.bitwise_count(values[at] ^ values[at + step]) <= k)]
            left.append(node[near])
            right.append(node[near + step])
            held += len(near)
            if held > 1 << 20:
                a, b = forest(np.concatenate(left), np.concatenate(right))
                left, right, held = [a], [b], 0
            step += 1
        return forest(np.concatenate(left), np.concatenate(right))

    columns = ["part", "key", "low", "high", "own", "fp", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            rows = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns]
            rest = rows if rest is None else [np.concatenate(x) for x in zip(rest, rows, strict=True)]
            new = _starts(rest[:4])
            whole = int(np.flatnonzero(new)[-1]) if new.any() else 0
            if whole >= 1 << 16:
                x, y = edges(np.cumsum(new[:whole]), rest[4][:whole], [c[:whole] for c in rest[5:]])
                a, b = np.append(a, x), np.append(b, y)
                rest = [c[whole:] for c in rest]
        if rest is not None:
            x, y = edges(np.cumsum(_starts(rest[:4])), rest[4], rest[5:])
            a, b = np.append(a, x), np.append(b, y)
        if len(a):
            a, b = forest(a, b)
            yield pa.RecordBatch.from_pydict({"u": a, "v": b})

    return run


def _starts(keys: list[np.ndarray]) -> np.ndarray:
    """Where a row's keys differ from those of the row before."""
    new = np.zeros(len(keys[0]), bool)
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    return new


def links(rows: DataFrame, k: int = 3) -> DataFrame:
    """Edges (u, v) of nodes that join the rows within k bits of each other into the same components.

    `rows` holds distinct fp (fingerprint) and node (long, names the row).
    """
    names = ["fp", "node"]
    n, both = bit_statistics(rows)
    filed = rows.select(*names).mapInArrow(_filed(allocate(n, both, k), names), ", ".join(["part int, key long, own boolean", *(f"{c} long" for c in names)]))
    sizes = filed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("some")).where("n > 1 and some")
    pieces = (
        filed.join(sizes, ["part", "key"])
        .withColumn("blocks", F.ceil(F.col("n") / F.lit(BUCKET_ROWS)).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("part", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "own", *names)
    )
    return pieces.repartition("part", "key", "low", "high").sortWithinPartitions("part", "key", "low", "high").mapInArrow(_linked(k), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach), a row per input row."""
    rows = materialised(fingerprints(docs, words, id_col, text_col))
    distinct = materialised(rows.groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("node", F.col("fp")))
    classes = _classes(distinct, links(distinct.select("fp", "node"), k)).select(F.col("node").alias("fp"), F.col("least").alias("component_id"))
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, least: the smallest `first` of each node's component."""
    roots = components(edges)
    rooted = materialised(nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    # a class may hold a third of all nodes
    least = rooted.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n"))
    return join_ranks(rooted, least, ["root"], rooted.count()).select("node", "least")


def exact_links(sets: list[np.ndarray], similarity: float, block: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning edges of the sets whose Jaccard similarity is `similarity` or more; with `block`, of pairs from different blocks alone.

    Pairs that are already joined are not compared again: they add nothing to the components.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    block = None if block is None else block[order]
    ends = np.cumsum(sizes)
    names, dense = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    parts = np.split(dense, ends[:-1])
    mark = np.zeros(len(names), bool)
    root = np.arange(len(sets))
    edges = []
    for i in range(len(sets) - 1):
        last = np.searchsorted(sizes, sizes[i] / similarity + 1e-9, "right")
        rest = np.arange(i + 1, last)
        rest = rest[(root[rest] != root[i]) & (True if block is None else block[rest] != block[i])]
        if not len(rest):
            continue
        mark[parts[i]] = True
        shared = np.array([np.count_nonzero(mark[parts[j]]) for j in rest])
        mark[parts[i]] = False
        for j in rest[shared * (1 + similarity) >= similarity * (sizes[i] + sizes[rest]) - 1e-9]:
            if root[j] != root[i]:
                edges.append((int(order[i]), int(order[j])))
                root[root == root[j]] = root[i]
    return edges


def _exact(rows: DataFrame, similarity: float) -> DataFrame:
    """Edges (u, v) that join the nodes of `rows` (node, root, shingles: the bytes of a sorted set) with an exact similarity, within each root.

    A class with many texts or long ones is cut into blocks and searched by pairs of blocks.
    """

    def run(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table["shingles"]]
        block = table["block"].to_numpy() if table["low"][0].as_py() != table["high"][0].as_py() else None
        edges = exact_links(sets, similarity, block) if len(sets) > 1 else []
        return pa.table({"u": pa.array([node[i] for i, _ in edges], pa.int64()), "v": pa.array([node[j] for _, j in edges], pa.int64())})

    totals = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("shingles") / 8).alias("size")).where("n > 1")
    pieces = (
        rows.join(totals, "root")
        .withColumn("blocks", F.greatest(F.ceil(F.col("n") / F.lit(BLOCK_ROWS)), F.ceil(F.col("size") / F.lit(BLOCK_SHINGLES))).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "shingles")
    )
    return pieces.groupBy("root", "low", "high").applyInArrow(run, "u long, v long")


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of the documents that links join), a row per input row.

    Two documents are linked if the exact Jaccard similarity of their sets of shingles of `words`
    words is at least `similarity`. Candidates are documents whose SimHashes differ in `k` bits at
    most, found by the pigeonhole search, and, as SimHashes of pairs near `similarity` differ in
    far more, those with an equal band of least shingle hashes (see BANDS). The components of both
    are the classes within which shingle sets are compared, so no pair of candidates is left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py() or b"", words) for x in batch.column(2).cast(pa.large_binary())]
            node = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            keys = np.array([band_keys(x) for x in sets], np.uint64).reshape(-1).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys))
            fps = pa.array(np.array([set_fingerprint(x) for x in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), fps, bands], ["doc_id", "body", "node", "fp", "bands"])

    read = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("body"), F.col(text_col).alias("text"))
    rows = materialised(read.mapInArrow(run, f"doc_id {kind}, body long, node long, fp long, bands array<long>"))
    # equal shingle sets are one node, whichever of its texts stands for it
    distinct = materialised(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "body", "fp", "bands")).alias("x")).select("node", "first", F.col("x.doc_id").alias("of"), "x.body", "x.fp", "x.bands"))
    candidates = components(_sharing(distinct).unionByName(_near(distinct, k)))
    edges = _exact(_with_shingles(read, distinct, candidates, words), similarity)
    classes = _classes(distinct.select("node", "first"), edges)
    return rows.select("doc_id", "node").join(classes, "node").select("doc_id", F.col("least").alias("class_id"))


def set_fingerprint(shingles: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        ones += np.unpackbits(shingles[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(shingles)).view(">u8")[0])


def _near(distinct: DataFrame, k: int) -> DataFrame:
    """Edges (u, v) that join the nodes whose SimHashes are equal or differ in `k` bits at most."""
    fps = materialised(distinct.groupBy("fp").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")))
    same = join_ranks(distinct.select("node", "fp"), fps.where("n > 1"), ["fp"], distinct.count()).where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    return links(fps.select("fp", F.col("least").alias("node")), k).unionByName(same)


def _sharing(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) from each node (with its bands) to the smallest node of every band it shares."""
    filed = distinct.select("node", F.explode("bands").alias("band"))
    shared = filed.groupBy("band").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return filed.join(shared, "band").where("node <> v").select(F.col("node").alias("u"), "v")


def _with_shingles(read: DataFrame, distinct: DataFrame, candidates: DataFrame, words: int) -> DataFrame:
    """node, root, shingles of the nodes in candidate classes, made again from one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(x.as_py() or b"", words).tobytes() for x in batch.column(2).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["node", "root", "shingles"])

    roots = candidates.unionByName(candidates.select(F.col("root").alias("node"), "root").distinct())
    wanted = distinct.select("node", "of", "body").join(roots, "node").withColumnRenamed("body", "same")
    texts = read.join(wanted, read["doc_id"].eqNullSafe(wanted["of"]) & (read["body"] == wanted["same"])).dropDuplicates(["node"])
    return materialised(texts.select("node", "root", "text").mapInArrow(run, "node long, root long, shingles binary"))


def drop_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with the smallest id of their class, with all their columns."""
    stay = similar_documents(docs, words, similarity, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("__stay")).distinct()
    return docs.join(stay, docs[id_col].eqNullSafe(stay["__stay"]), "left_semi")

"""Suffix-array deduplication of byte strings by distributed prefix doubling.

A byte is removed if a string of `size` bytes that covers it starts anywhere else too, in the same
document or another.

1. Anchors (see :mod:`eventloom.llm.repeats`) choose the suffixes that can repeat: blocks of
   documents send a record for each distinct (anchor, content of a run) to the bucket of the anchor.
   A content that occurs again repeats as a whole; only anchors with several contents need ranks.
2. The contents of those are cut into cells of a quarter of `size`, counted from the anchor, so
   that equal strings have equal cells. Spark doubles over the cells: rank pairs of a cell and the
   cell h on are sorted, ranked again and dropped once unique (:mod:`eventloom.llm.ranks`), up to
   the three whole cells that every string of `size` bytes holds.
3. The suffixes that are left are sent to the bucket of their anchor, and the doubling goes on there
   byte by byte: the rank of the first h bytes and the rank of the position h on form pairs, from the 8
   bytes themselves up to `size` (see :func:`doubled`). Positions that still share a rank repeat.
4. Blocks put the answers together and cut their texts.

An anchor with over `most_contents` contents would be too much for one bucket: its strings go to
all buckets by their names, each once a block. Records and such strings are equal if their 64-bit
names are; ranks in a bucket are exact.

Scale: a pair for every byte of the corpus would be shuffled at each round; anchors and cells
leave about one in a hundred. Texts are shuffled once and read from there. Copies within a
block are one record, so a passage that stands in a third of all documents reaches a bucket once
per block and distinct surrounding. Memory follows the block and, where a text is longer, that text.

Edge cases: a null text is empty; texts shorter than the threshold lose nothing; very long texts are
searched whole; matches never cross documents; rows that repeat a doc_id and text are each other's
copies, so both lose what they share; an empty table gives no rows. Ids are integers (others raise).
Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm import ranks
from eventloom.llm import textkit as tk
from eventloom.llm.common import materialised
from eventloom.llm.repeats import BLOCK_BYTES, Runs, bucket_of, deal, documents, find_runs, pack, rows_table, slices, unpack

SIZE = 400
GRAM = 32
#: Contents of one anchor that a bucket ranks itself; the strings of an anchor with more are spread over all buckets by their names.
MOST_CONTENTS = 1000
#: Flags of a record: it repeats as a whole; its positions are ranked; they are spread.
REPEATED, RANKED, SPREAD = 1, 2, 4
#: Kinds of messages: records and their flags; contents and repeated stretches of them; spread strings and their flags; what Spark's ranks left of a record.
RECORDS, CONTENTS, STRINGS, LEFT = 0, 1, 2, 3
#: Bytes that are ranked together in a bucket, about.
RANKED_BYTES = 1 << 20

_TO_BUCKET = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("kind", pa.int64()), ("data", pa.binary())])
_TO_BLOCK = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int64()), ("data", pa.binary())])
_CELLS = pa.schema([("block", pa.int64()), ("record", pa.int64()), ("pos", pa.int64()), ("rank", pa.int64())])


@dataclass(frozen=True)
class Search:
    size: int
    gram: int
    most_contents: int

    @property
    def cell(self) -> int:
        return max(1, self.size // 4)

    @property
    def core(self) -> int:
        """Whole cells that every string of `size` bytes holds, wherever it starts."""
        return min(3, self.size // self.cell)

    def runs(self, ids: np.ndarray, texts: list[bytes]) -> Runs:
        return find_runs(lambda d: _names(texts[d]), self.size, self.gram, ids)


def _names(text: bytes) -> np.ndarray:
    return tk.BYTE_NAMES[np.frombuffer(text, np.uint8)]


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each key (their order), and whether others share it."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    last = np.ones(len(keys), bool)
    last[:-1] = new[1:]
    rank, shared = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
    rank[order] = np.cumsum(new) - 1
    shared[order] = ~(new & last)
    return rank, shared


def doubled(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Which of the positions `at` (indices into it) share their next `size` bytes with another of them, by prefix doubling.

    Every position starts with the rank of its first 8 bytes. Each round pairs the rank of a
    position with that of the position h on; those that are unique have no rank any more, and none
    that reaches them has.
    """
    h = min(8, size)
    n = len(data) - h + 1
    keys = np.zeros(max(0, n), np.uint64)
    for k in range(h if n > 0 else 0):
        keys = (keys << np.uint64(8)) | data[k : n + k]
    ranks_at = np.full(len(data), -1, np.int64)
    alive = np.arange(len(keys))
    found, shared = _ranked(keys)
    while True:
        alive, found = alive[shared], found[shared]
        ranks_at[:] = -1
        ranks_at[alive] = found
        if h >= size:
            break
        step = min(h, size - h)
        inside = alive + step < len(data)
        alive, found = alive[inside], found[inside]
        after = ranks_at[alive + step]
        both = after >= 0
        alive = alive[both]
        found, shared = _ranked(found[both] * np.int64(len(data)) + after[both])
        h += step
    # positions outside `at` may share a rank as well: only those of `at` count
    mine = np.flatnonzero(ranks_at[at] >= 0)
    _, shared = _ranked(ranks_at[at[mine]])
    return mine[shared]


def _file_records(search: Search, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        ids, texts, _ = documents(table)
        runs = search.runs(ids, texts)
        copies = np.minimum(runs.copies, 2).astype(np.uint8)
        return rows_table(_TO_BUCKET, [(bucket, block, RECORDS, pack(runs.anchors[a:b], runs.contents[a:b], copies[a:b])) for bucket, a, b in slices(bucket_of(runs.anchors, buckets))])

    return run


def _judge(search: Search, bucket: int, blocks: list[int], data: list[bytes], kind: int) -> list[tuple]:
    """Flags for the records (or spread strings) of each block, as messages of `kind`."""
    parts = [unpack(x, "<u8", "<u8", "u1") for x in data]
    lengths = [len(p[0]) for p in parts]
    anchors, contents, copies = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((np.repeat(np.array(blocks, np.int64), lengths), contents, anchors))
    a, c = anchors[order], contents[order]
    new_anchor = np.ones(len(order), bool)
    new_anchor[1:] = a[1:] != a[:-1]
    new = new_anchor.copy()
    new[1:] |= c[1:] != c[:-1]
    content = np.cumsum(new) - 1
    group = np.cumsum(new_anchor) - 1
    several = np.bincount(group[new])[group]
    repeated = np.bincount(content, weights=copies[order])[content] > 1
    flags = np.empty(len(order), np.uint8)
    flags[order] = repeated * REPEATED + ((several > 1) & new) * RANKED + (several > search.most_contents) * SPREAD
    return [(block, bucket, kind, part.tobytes()) for block, part in zip(blocks, np.split(flags, np.cumsum(lengths)[:-1]), strict=True)]


def _judge_records(search: Search):
    def run(table: pa.Table) -> pa.Table:
        return rows_table(_TO_BLOCK, _judge(search, table.column("bucket")[0].as_py(), table.column("block").to_pylist(), table.column("data").to_pylist(), RECORDS))

    return run


def _flags(names: np.ndarray, answers: pa.Table, buckets: int, kind: int) -> np.ndarray:
    """The flags of names that are in order, put together from the answers of their buckets."""
    got = {bucket: data for bucket, k, data in zip(*(answers.column(c).to_pylist() for c in ("bucket", "kind", "data")), strict=True) if k == kind}
    flags = np.zeros(len(names), np.uint8)
    for bucket, a, b in slices(bucket_of(names, buckets)):
        flags[a:b] = np.frombuffer(got[bucket], np.uint8)
    return flags


def _by_document(runs: Runs, records: np.ndarray):
    """(document, records) of the records' first runs, document by document."""
    records = records[np.argsort(runs.document[runs.first[records]], kind="stable")]
    for d, a, b in slices(runs.document[runs.first[records]]):
        yield d, records[a:b]


def _cells(search: Search, buckets: int):
    """The cells of the records that are to be ranked, a row each: Spark's positions."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return rows_table(_CELLS, [])
        block = table.column("block")[0].as_py()
        ids, texts, _ = documents(table)
        runs = search.runs(ids, texts)
        flags = _flags(runs.anchors, answers, buckets, RECORDS)
        records, places, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for d, chosen in _by_document(runs, np.flatnonzero((flags & (RANKED | SPREAD)) == RANKED)):
            prefix = tk.prefix_hash(_names(texts[d]))
            first = runs.first[chosen]
            low = -(runs.offset[first] // search.cell)
            count = (runs.count[first] + search.size - 1 - runs.offset[first]) // search.cell - low
            cell = np.repeat(low, count) + tk.counted(count)
            begin = np.repeat(runs.start[first] + runs.offset[first], count) + cell * search.cell
            records.append(np.repeat(chosen, count))
            places.append(cell)
            names.append(tk.mix64(tk.span_hash(prefix, begin, begin + search.cell) ^ tk.mix64(np.repeat(runs.anchors[chosen], count) + cell.astype(np.uint64))))
        record = np.concatenate(records)
        return pa.Table.from_arrays([pa.array(np.full(len(record), block)), pa.array(record), pa.array(np.concatenate(places)), pa.array(np.concatenate(names).view(np.int64))], schema=_CELLS)

    return run


@dataclass
class Spread:
    """The strings of a block's spread records, and their distinct names in order with how often they occur."""

    record: np.ndarray
    offset: np.ndarray
    name: np.ndarray
    names: np.ndarray
    copies: np.ndarray


def spread_strings(search: Search, runs: Runs, flags: np.ndarray, texts: list[bytes]) -> Spread:
    record, offset, name = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for d, chosen in _by_document(runs, np.flatnonzero((flags & (RANKED | SPREAD)) == (RANKED | SPREAD))):
        prefix = tk.prefix_hash(_names(texts[d]))
        count = runs.count[runs.first[chosen]]
        at = tk.counted(count)
        start = np.repeat(runs.start[runs.first[chosen]], count) + at
        record.append(np.repeat(chosen, count))
        offset.append(at)
        name.append(tk.span_hash(prefix, start, start + search.size))
    record, offset, name = (np.concatenate(x) for x in (record, offset, name))
    names, copies = np.unique(name, return_counts=True)
    return Spread(record, offset, name, names, copies)


def _send_contents(search: Search, buckets: int):
    """What Spark's ranks left of each record to the bucket of its anchor, and the strings of spread records to theirs."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return rows_table(_TO_BUCKET, [])
        block = table.column("block")[0].as_py()
        ids, texts, _ = documents(table)
        runs = search.runs(ids, texts)
        flags = _flags(runs.anchors, answers, buckets, RECORDS)
        left = answers.filter(pa.compute.equal(answers.column("kind"), LEFT))
        asked, low, high = (left.column(c).to_numpy().astype(np.int64) for c in ("bucket", "low", "high"))
        order = np.argsort(asked)
        asked, low, high = asked[order], low[order], high[order]
        first = runs.first[asked]
        # strings that hold one of the cells left
        begin = np.maximum(0, runs.offset[first] + low * search.cell - (search.cell - 1))
        stop = np.minimum(runs.count[first], runs.offset[first] + high * search.cell + 1)
        some = stop > begin
        asked, first, begin, stop = asked[some], first[some], begin[some], stop[some]
        start = runs.start[first] + begin
        rows = []
        for bucket, a, b in slices(bucket_of(runs.anchors[asked], buckets)):
            data = [texts[d][s : s + n + search.size - 1] for d, s, n in zip(runs.document[first[a:b]].tolist(), start[a:b].tolist(), (stop - begin)[a:b].tolist(), strict=True)]
            parts = [runs.anchors[asked[a:b]], asked[a:b], flags[asked[a:b]], begin[a:b], (stop - begin)[a:b]]
            rows.append((bucket, block, CONTENTS, pack(*parts, np.frombuffer(b"".join(data), np.uint8))))
        spread = spread_strings(search, runs, flags, texts)
        for bucket, a, b in slices(bucket_of(spread.names, buckets)):
            rows.append((bucket, block, STRINGS, pack(spread.names[a:b], spread.names[a:b], np.minimum(spread.copies[a:b], 2).astype(np.uint8))))
        return rows_table(_TO_BUCKET, rows)

    return run


def _repeated_strings(search: Search, anchors: np.ndarray, counts: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Mask of the strings (numbered over all contents) that also stand in another content; whole anchors are ranked together."""
    lengths = counts + search.size - 1
    base, place = np.cumsum(counts) - counts, np.cumsum(lengths) - lengths
    mask = np.zeros(int(counts.sum()), bool)
    order = np.argsort(anchors, kind="stable")

    def rank(records: np.ndarray) -> None:
        held = np.concatenate([data[p : p + n] for p, n in zip(place[records].tolist(), lengths[records].tolist(), strict=True)])
        inside = tk.counted(counts[records])
        at = np.repeat(np.cumsum(lengths[records]) - lengths[records], counts[records]) + inside
        mask[(np.repeat(base[records], counts[records]) + inside)[doubled(held, at, search.size)]] = True

    group: list[np.ndarray] = []
    held = 0
    for _, a, b in slices(anchors[order]):
        group.append(order[a:b])
        held += int(lengths[order[a:b]].sum())
        if held >= RANKED_BYTES:
            rank(np.concatenate(group))
            group, held = [], 0
    if group:
        rank(np.concatenate(group))
    return mask


def _rank_contents(search: Search):
    kinds = ("<u8", "<i8", "u1", "<i8", "<i8", "u1")

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        sent = list(zip(*(table.column(c).to_pylist() for c in ("block", "kind", "data")), strict=True))
        strings = [(block, data) for block, kind, data in sent if kind == STRINGS]
        out = _judge(search, bucket, [b for b, _ in strings], [x for _, x in strings], STRINGS) if strings else []
        blocks = [block for block, kind, _ in sent if kind == CONTENTS]
        if not blocks:
            return rows_table(_TO_BLOCK, out)
        parts = [unpack(data, *kinds) for _, kind, data in sent if kind == CONTENTS]
        anchors, records, flags, begin, counts, data = (np.concatenate([p[i] for p in parts]) for i in range(6))
        owner = np.repeat(np.arange(len(blocks)), [len(p[0]) for p in parts])
        mask = _repeated_strings(search, anchors, counts, data)
        mask[np.repeat((flags & REPEATED).astype(bool), counts)] = False
        # strings that repeat, as stretches within their record
        of = np.repeat(np.arange(len(counts)), counts)
        at = np.flatnonzero(mask)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (of[at[1:]] != of[at[:-1]])
        edges = np.flatnonzero(new)
        first, last = at[edges], at[np.append(edges[1:], len(at)) - 1] if len(at) else at
        record = of[first]
        shift = begin[record] - (np.cumsum(counts) - counts)[record]
        found = [records[record], first + shift, last + 1 + shift]
        for k, a, b in slices(owner[record]):
            out.append((blocks[k], bucket, CONTENTS, pack(*(x[a:b].astype("<i8") for x in found))))
        return rows_table(_TO_BLOCK, out)

    return run


def _cut(search: Search, buckets: int, schema: pa.Schema):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        ids, texts, at = documents(table)
        runs = search.runs(ids, texts)
        flags = _flags(runs.anchors, answers, buckets, RECORDS)
        whole = (flags[runs.record] & REPEATED).astype(bool)
        stretches = [unpack(data, "<i8", "<i8", "<i8") for kind, data in zip(answers.column("kind").to_pylist(), answers.column("data").to_pylist(), strict=True) if kind == CONTENTS]
        record, low, high = (np.concatenate([np.zeros(0, np.int64), *(s[i] for s in stretches)]) for i in range(3))
        spread = spread_strings(search, runs, flags, texts)
        if len(spread.names):
            again = (_flags(spread.names, answers, buckets, STRINGS)[np.searchsorted(spread.names, spread.name)] & REPEATED).astype(bool)
            record = np.append(record, spread.record[again])
            low, high = np.append(low, spread.offset[again]), np.append(high, spread.offset[again] + 1)
        # stretches of a record hold for each of its runs
        order = np.argsort(record, kind="stable")
        record, low, high = record[order], low[order], high[order]
        since, upto = np.searchsorted(record, runs.record, "left"), np.searchsorted(record, runs.record, "right")
        count = np.where(whole, 0, upto - since)
        run_of = np.repeat(np.arange(len(count)), count)
        stretch = np.repeat(since, count) + tk.counted(count)
        begin = np.concatenate((runs.start[whole], runs.start[run_of] + low[stretch]))
        stop = np.concatenate(((runs.start + runs.count)[whole], runs.start[run_of] + high[stretch])) - 1 + search.size
        document = np.concatenate((runs.document[whole], runs.document[run_of]))
        order = np.argsort(document, kind="stable")
        cuts = np.searchsorted(document[order], np.arange(len(texts) + 1))
        out = [_finish(text, begin[order[a:b]], stop[order[a:b]]) for text, a, b in zip(texts, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        made = [pa.array([r[i] for r in out], f.type) for i, f in enumerate(list(schema)[1:])]
        return pa.Table.from_arrays([table.column("id").take(pa.array(at)).combine_chunks(), *made], schema=schema)

    return run


def _finish(text: bytes, begin: np.ndarray, stop: np.ndarray) -> tuple:
    if not len(begin):
        return len(text), 0, [], text
    gone = tk.covered(len(text), begin, stop)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).view(np.int8)))
    spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[0::2], edge[1::2], strict=True)]
    return len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()


def drop_repeated_bytes(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, most_contents: int = MOST_CONTENTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, n_bytes, n_removed, spans (maximal removed runs of bytes), kept (the remaining bytes), a row per input row."""
    search = Search(size, min(gram, size), most_contents)
    by_block, blocks = deal(docs, id_col, text_col, block_bytes)
    to_bucket, to_block = "bucket long, block long, kind long, data binary", "block long, bucket long, kind long, data binary"
    # written once, as each use of it in a job of its own would search all texts again
    judged = materialised(by_block.applyInArrow(_file_records(search, blocks), to_bucket).groupBy("bucket").applyInArrow(_judge_records(search), to_block))
    cells = by_block.cogroup(judged.groupBy("block")).applyInArrow(_cells(search, blocks), "block long, record long, pos long, rank long")
    shared, _ = ranks.repeated(cells.withColumn("at", F.col("pos")), ["block", "record"], search.core)
    left = shared.groupBy("block", "record").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    left = left.select("block", F.col("record").alias("bucket"), F.lit(LEFT).cast("long").alias("kind"), F.lit(None).cast("binary").alias("data"), "low", "high")
    told = judged.withColumn("low", F.lit(None).cast("long")).withColumn("high", F.lit(None).cast("long")).unionByName(left)
    ranked = by_block.cogroup(told.groupBy("block")).applyInArrow(_send_contents(search, blocks), to_bucket).groupBy("bucket").applyInArrow(_rank_contents(search), to_block)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", spans), ("kept", pa.binary())])
    return by_block.cogroup(judged.unionByName(ranked).groupBy("block")).applyInArrow(_cut(search, blocks, schema), f"{id_col} long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")

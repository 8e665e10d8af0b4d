"""Substring deduplication by relative Lempel-Ziv parsing against indexed reference blocks.

The corpus is its own reference, in blocks of documents (dealt by a hash, about `block_bytes` of
text each). A word is removed if a window of `words` words that covers it also starts earlier: in
a document with a smaller id or earlier in the same one. The input decides, not what other
removals leave.

1. Index. Every block files its phrases under content-defined anchors (see
   :func:`eventloom.llm.repeats.find_runs`): for each distinct stretch of windows that choose one
   anchor a record of (anchor, hash of the stretch, place). Equal windows choose equal anchors, so
   an index bucket (a range of anchor names) sees all places that can hold a phrase.
2. An anchor with several surroundings has the windows of each of them filed once more, under
   their own names, so that phrases that agree in part of a stretch meet too, however many there are.
3. The index asks the block of the next earlier place of a phrase to send its words to the block
   that repeats it. Places form a chain, so a phrase that stands in a third of all documents asks
   every block for one copy and none for many.
4. Every block parses its documents against the reference it now holds, its own texts and
   the words it was sent. A factor starts at a window that stands earlier in the reference and is
   grown word by word, comparing the words themselves, as far as the reference agrees. The parse
   goes on with the first window that is not inside the factor, which lies across its boundary, so
   no phrase is lost between two factors. Factors of `words` words or more are the duplicate spans.

Hashes only choose what is compared: a span is removed if its words are equal. A repeat could be
missed if another phrase had the same 64-bit hash and an earlier place.

Scale: texts are shuffled once, into blocks, and read again from there; what moves besides are
records, names of windows and one copy of each repeated phrase a block. Memory follows the block
and, where a text is longer than a block, that text.

Edge cases: a null text has no words; texts shorter than a window lose nothing; very long texts are
parsed whole; a null doc_id comes after all others; rows with the same doc_id and text are both
first copies, as neither starts earlier; an empty table gives no rows. Ids are integers (others
raise). Extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm import textkit as tk
from eventloom.llm.repeats import BLOCK_BYTES, bucket_of, deal, documents, find_runs, pack, rows_table, slices, unpack

WORDS = 20
GRAM = 6
#: Kinds of messages to a block: which of its records have their windows filed; phrases to send.
FLAGS, REQUESTS = 0, 1
#: What a bucket gets of a phrase: name of its anchor, of its words, id, document of the block, first word, windows.
_FILED = ("<u8", "<u8", "<i8", "<u4", "<u4", "<u4")
#: What a block is asked for: document of the block, first word, windows, the block that asks.
_ASKED = ("<u4", "<u4", "<u4", "<i8")
#: What a block is sent: id of the document, first word, bytes of the words; then the words.
_SENT = ("<i8", "<i8", "<i8", "u1")

_TO_BUCKET = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])
_TO_BLOCK = pa.schema([("block", pa.int64()), ("kind", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())])
_PIECES = pa.schema([("block", pa.int64()), ("data", pa.binary())])


def _file_stretches(size: int, gram: int, buckets: int):
    """A block's records to the index: one for each distinct stretch, at its earliest place."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        ids, texts, _ = documents(table)
        runs = find_runs(tk.all_word_names(texts).__getitem__, size, gram, ids)
        first, bucket = runs.first, bucket_of(runs.anchors, buckets)
        order = np.lexsort((runs.start[first], runs.document[first], bucket))
        columns = [runs.anchors, runs.contents, ids[runs.document[first]], runs.document[first], runs.start[first], runs.count[first]]
        return rows_table(_TO_BUCKET, _messages(block, bucket[order], [c[order] for c in columns]))

    return run


def _messages(block: int, bucket: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
    """Rows of _TO_BUCKET from columns in order of bucket."""
    return [(to, block, pack(*(c[a:b].astype(kind) for c, kind in zip(columns, _FILED, strict=True)))) for to, a, b in slices(bucket)]


def _filed(table: pa.Table) -> tuple[np.ndarray, list[int], list[int], np.ndarray, list[np.ndarray], np.ndarray]:
    """What a bucket was sent: the sender of each record, senders, their counts, an order by phrase and place, the columns so ordered, where a phrase begins."""
    blocks = table.column("block").to_pylist()
    parts = [unpack(x, *_FILED) for x in table.column("data").to_pylist()]
    counts = [len(p[0]) for p in parts]
    columns = [np.concatenate([p[i] for p in parts]) for i in range(len(_FILED))]
    order = np.lexsort((columns[4], columns[2], columns[1], columns[0]))
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
    return np.repeat(blocks, counts), blocks, counts, order, columns, new


def _flag(table: pa.Table) -> pa.Table:
    """To each block, for its records: 1 where the windows of the stretch are to be filed (the anchor has others, and this is the earliest place of this one)."""
    _, blocks, counts, order, columns, new = _filed(table)
    anchor = np.ones(len(order), bool)
    anchor[1:] = columns[0][1:] != columns[0][:-1]
    group = np.cumsum(anchor) - 1
    flags = np.empty(len(order), np.uint8)
    flags[order] = (np.bincount(group[new])[group] > 1) & new
    bucket = table.column("bucket")[0].as_py()
    return rows_table(_TO_BLOCK, [(block, FLAGS, bucket, part.tobytes()) for block, part in zip(blocks, np.split(flags, np.cumsum(counts)[:-1]), strict=True)])


def _request(table: pa.Table) -> pa.Table:
    """To the block of the next earlier place of each phrase: send it to the block that has it here."""
    sender, _, _, order, columns, new = _filed(table)
    sender = sender[order]
    place = new.copy()  # where a place begins: the same place may come from several blocks if an id has several texts
    place[1:] |= (columns[2][1:] != columns[2][:-1]) | (columns[4][1:] != columns[4][:-1])
    before = np.flatnonzero(place)[np.cumsum(place) - 1] - 1
    later = np.flatnonzero(before >= np.flatnonzero(new)[np.cumsum(new) - 1])
    source = before[later]
    other = sender[source] != sender[later]
    later, source = later[other], source[other]
    by_source = np.argsort(sender[source], kind="stable")
    later, source = later[by_source], source[by_source]
    bucket = table.column("bucket")[0].as_py()
    columns = [columns[3][source], columns[4][source], columns[5][source], sender[later]]
    return rows_table(_TO_BLOCK, [(int(block), REQUESTS, bucket, pack(*(c[a:b].astype(kind) for c, kind in zip(columns, _ASKED, strict=True)))) for block, a, b in slices(sender[source])])


def _file_windows(size: int, gram: int, buckets: int):
    """The windows of flagged stretches to the index, under their own names."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return rows_table(_TO_BUCKET, [])
        block = table.column("block")[0].as_py()
        ids, texts, _ = documents(table)
        named = tk.all_word_names(texts)
        runs = find_runs(named.__getitem__, size, gram, ids)
        first, bucket = runs.first, bucket_of(runs.anchors, buckets)
        order = np.lexsort((runs.start[first], runs.document[first], bucket))
        got = dict(zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True))
        flagged = [order[a:b][np.frombuffer(got[to], bool)] for to, a, b in slices(bucket[order])]
        chosen = first[np.concatenate(flagged)] if flagged else first[:0]
        chosen = chosen[np.lexsort((runs.start[chosen], runs.document[chosen]))]
        if not len(chosen):
            return rows_table(_TO_BUCKET, [])
        every, counts = tk.all_windows(named, size)
        count = runs.count[chosen]
        document = np.repeat(runs.document[chosen], count)
        start = np.repeat(runs.start[chosen], count) + tk.counted(count)
        names = every[(np.cumsum(counts) - counts)[document] + start]
        # a window once a block, at its earliest place
        order = np.lexsort((start, ids[document], names))
        order = order[tk.run_bounds(names[order])[0]]
        bucket = bucket_of(names, buckets)
        order = order[np.lexsort((start[order], document[order], bucket[order]))]
        names, document, start = names[order], document[order], start[order]
        return rows_table(_TO_BUCKET, _messages(block, bucket[order], [names, names, ids[document], document, start, np.ones(len(names))]))

    return run


def _send(size: int):
    """The words of the phrases that other blocks ask for; phrases that touch are one piece."""

    def run(table: pa.Table, requests: pa.Table) -> pa.Table:
        if not table.num_rows or not requests.num_rows:
            return rows_table(_PIECES, [])
        ids, texts, _ = documents(table)
        parts = [unpack(x, *_ASKED) for x in requests.column("data").to_pylist()]
        document, start, count, target = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(4))
        end = start + count + size - 1
        order = np.lexsort((end, start, target, document))
        document, start, end, target = document[order], start[order], end[order], target[order]
        made: dict[int, list] = {}
        for d, a, b in slices(document):
            words = texts[d].split()
            for to, x, y in slices(target[a:b]):
                s, e = start[a + x : a + y], np.maximum.accumulate(end[a + x : a + y])
                new = np.ones(len(s), bool)
                new[1:] = s[1:] > e[:-1]
                at = np.flatnonzero(new)
                for low, high in zip(s[at].tolist(), e[np.append(at[1:] - 1, len(s) - 1)].tolist(), strict=True):
                    made.setdefault(to, []).append((ids[d], low, b" ".join(words[low:high])))
        rows = []
        for to, pieces in made.items():
            data = b"".join([p[2] for p in pieces])
            heads = [np.array(x, "<i8") for x in ([p[0] for p in pieces], [p[1] for p in pieces], [len(p[2]) for p in pieces])]
            rows.append((to, pack(*heads, np.frombuffer(data, np.uint8))))
        return rows_table(_PIECES, rows)

    return run


class Reference:
    """The segments (id, first word, bytes) that documents are parsed against; windows are found by their names, words are compared."""

    def __init__(self, segments: list[tuple[int, int, bytes]], size: int):
        self.size, self.segments = size, segments
        self.names = tk.all_word_names([text for _, _, text in segments])
        self._words: dict[int, list[bytes]] = {}
        name, lengths = tk.all_windows(self.names, size)
        segment, offset = np.repeat(np.arange(len(lengths)), lengths), tk.counted(lengths)
        # only windows that occur twice can stand earlier
        order = np.argsort(name)
        first, last = tk.run_bounds(name[order])
        order = order[np.repeat(last > first, last - first + 1)]
        name, segment, offset = name[order], segment[order], offset[order]
        ids = np.array([s[0] for s in segments], np.int64)
        begins = np.array([s[1] for s in segments], np.int64)
        order = np.lexsort((begins[segment] + offset, ids[segment], name)) if len(name) else np.zeros(0, np.int64)
        self.name, self.segment, self.offset = name[order], segment[order], offset[order]
        self.id, self.place = ids[self.segment], begins[self.segment] + self.offset
        first, last = tk.run_bounds(self.name)
        self.first = np.repeat(first, last - first + 1)

    def words(self, segment: int) -> list[bytes]:
        found = self._words.get(segment)
        if found is None:
            found = self._words[segment] = self.segments[segment][2].split()
        return found

    def candidates(self, segments: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each of the first `segments` segments that has any: the windows whose name stands earlier, in order, and their numbers in the index."""
        earlier = (self.id[self.first] != self.id) | (self.place[self.first] != self.place) if len(self.name) else np.zeros(0, bool)
        at = np.flatnonzero(earlier & (self.segment < segments))
        at = at[np.lexsort((self.offset[at], self.segment[at]))]
        return {s: (self.offset[at[a:b]], at[a:b]) for s, a, b in slices(self.segment[at])}

    def factor(self, segment: int, start: int, entry: int) -> int:
        """The length of the factor at word `start` of a segment: how far it agrees with the first earlier place of the reference that agrees for a window; 0 if none does."""
        have, mine = self.words(segment), self.names[segment]
        for k in range(int(self.first[entry]), entry):
            if (self.id[k], self.place[k]) >= (self.id[entry], self.place[entry]):
                break
            source, at = int(self.segment[k]), int(self.offset[k])
            n = _agreeing(mine, start, self.names[source], at)
            theirs = self.words(source)
            if have[start : start + n] != theirs[at : at + n]:
                n = next(x for x in range(n) if have[start + x] != theirs[at + x])
            if n >= self.size:
                return n
        return 0


def _agreeing(a: np.ndarray, i: int, b: np.ndarray, j: int) -> int:
    """How many items of a from i on equal those of b from j on."""
    most, n, step = min(len(a) - i, len(b) - j), 0, 64
    while n < most:
        part = min(step, most - n)
        differ = a[i + n : i + n + part] != b[j + n : j + n + part]
        if differ.any():
            return n + int(differ.argmax())
        n += part
        step *= 2
    return n


def factors(reference: Reference, segment: int, windows: np.ndarray, entries: np.ndarray) -> list[tuple[int, int]]:
    """The greedy parse of a segment: (start, end) in words of its factors of a window or more.

    After a factor the parse goes on with the first window that crosses its end.
    """
    found, k = [], 0
    at, number = windows.tolist(), entries.tolist()
    while k < len(at):
        n = reference.factor(segment, at[k], number[k])
        if n:
            found.append((at[k], at[k] + n))
            k = bisect_left(at, at[k] + n - reference.size + 1, k)
        else:
            k += 1
    return found


def _parse(size: int, schema: pa.Schema):
    def run(table: pa.Table, pieces: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        ids, texts, order = documents(table)
        segments = [(int(i), 0, text) for i, text in zip(ids, texts, strict=True)]
        for data in pieces.column("data").to_pylist():
            where, start, lengths, raw = unpack(data, *_SENT)
            ends, raw = np.cumsum(lengths), raw.tobytes()
            segments += [(int(w), int(s), raw[e - n : e]) for w, s, n, e in zip(where, start, lengths.tolist(), ends.tolist(), strict=True)]
        reference = Reference(segments, size)
        found = reference.candidates(len(texts))
        nothing: list[tuple[int, int]] = []
        out = [_finish(text, factors(reference, d, *found[d]) if d in found else nothing) for d, text in enumerate(texts)]
        made = [pa.array([r[i] for r in out], f.type) for i, f in enumerate(list(schema)[1:])]
        return pa.Table.from_arrays([table.column("id").take(pa.array(order)).combine_chunks(), *made], schema=schema)

    return run


def _finish(text: bytes, found: list[tuple[int, int]]) -> tuple:
    words = text.split()
    if not found:
        return len(words), 0, [], b" ".join(words).decode()
    spans: list[list[int]] = []
    for start, end in found:
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    edges = [0, *(x for span in spans for x in span), len(words)]
    kept = [w for a, b in zip(edges[0::2], edges[1::2], strict=True) for w in words[a:b]]
    return len(words), len(words) - len(kept), [{"start": a, "end": b} for a, b in spans], b" ".join(kept).decode()


def drop_repeated_phrases(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, n_words, n_removed, spans (removed stretches of words), kept_text (the kept words joined by one space), a row per input row."""
    gram = min(gram, words)
    by_block, blocks = deal(docs, id_col, text_col, block_bytes)
    to_bucket, to_block = "bucket long, block long, data binary", "block long, kind long, bucket long, data binary"
    filed = by_block.applyInArrow(_file_stretches(words, gram, blocks), to_bucket).groupBy("bucket")
    flags = filed.applyInArrow(_flag, to_block)
    windows = by_block.cogroup(flags.groupBy("block")).applyInArrow(_file_windows(words, gram, blocks), to_bucket).groupBy("bucket")
    requests = filed.applyInArrow(_request, to_block).unionByName(windows.applyInArrow(_request, to_block))
    pieces = by_block.cogroup(requests.groupBy("block")).applyInArrow(_send(words), "block long, data binary")
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([(id_col, pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", spans), ("kept_text", pa.string())])
    return by_block.cogroup(pieces.groupBy("block")).applyInArrow(_parse(words, schema), f"{id_col} long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept_text string")

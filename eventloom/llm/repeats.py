"""Blocks of documents and content-defined anchors, which substring and suffix-array dedup share.

A text is a sequence of tokens (bytes, or words) and a window is `size` consecutive ones. Every
window chooses an anchor: the position of the smallest k-gram name within it. Equal windows choose
equal anchors at equal places, so windows can only repeat where anchors do. Consecutive windows
with the same anchor form a run; its content is everything its windows cover. Blocks are groups
of documents, dealt by a hash; buckets are ranges of names, which blocks send records to.

Long texts are cut into slices of SLICE windows, which overlap by a window; the names of all their
tokens are held at once, so memory is a small multiple of a block or of a longer text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from eventloom.llm import textkit as tk

BLOCK_BYTES = 6 << 20
SLICE = 1 << 20

_U64 = np.uint64


@dataclass
class Runs:
    """The runs of a block's documents (document, first window, number of windows, place of the anchor from there, record), and its distinct records in order of anchor and content."""

    document: np.ndarray
    start: np.ndarray
    count: np.ndarray
    offset: np.ndarray
    record: np.ndarray
    anchors: np.ndarray
    contents: np.ndarray
    first: np.ndarray
    copies: np.ndarray


def find_runs(name: Callable[[int], np.ndarray], size: int, gram: int, ids: np.ndarray) -> Runs:
    """The runs of windows of `size` tokens that choose one anchor, a gram of `gram` tokens; `name` gives the names of the tokens of a document by its number."""
    found: list[list[np.ndarray]] = [[] for _ in range(6)]
    held: list[tuple[int, int, np.ndarray]] = []

    def search() -> None:
        """The runs of the held stretches (document, first token, names), all at once: windows across two of them are left out."""
        length = np.array([len(n) for _, _, n in held])
        base = np.cumsum(length) - length
        prefix = tk.prefix_hash(np.concatenate([n for _, _, n in held]))
        grams = tk.window_hash(prefix, gram)
        at = np.repeat(base, length - size + 1) + tk.counted(length - size + 1)
        chosen = tk.selected(grams, size - gram + 1)[at]
        first, last = tk.run_bounds(chosen)
        anchor, begin, end = chosen[first], at[first], at[last]
        of = np.searchsorted(base, begin, "right") - 1
        parts = (
            np.array([d for d, _, _ in held])[of],
            begin - base[of] + np.array([low for _, low, _ in held])[of],
            end - begin + 1,
            anchor - begin,
            tk.mix64(grams[anchor]),  # chosen grams are small, their mixed names are not
            tk.mix64(tk.span_hash(prefix, begin, end + size) ^ (anchor - begin).astype(np.uint64)),
        )
        for kept, part in zip(found, parts, strict=True):
            kept.append(part)
        held.clear()

    tokens = 0
    for d in range(len(ids)):
        names = name(d)
        for low in range(0, max(0, len(names) - size + 1), SLICE):
            part = names[low : low + SLICE + size - 1]
            held.append((d, low, part))
            tokens += len(part)
            if tokens >= SLICE:
                search()
                tokens = 0
    if held:
        search()
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    document, start, count, offset = (join(x, np.int64) for x in found[:4])
    anchors, contents = (join(x, np.uint64) for x in found[4:])
    # the first run of a record is the earliest: by document id, then by place
    order = np.lexsort((start, ids[document] if len(document) else document, contents, anchors))
    new = np.ones(len(order), bool)
    new[1:] = (anchors[order][1:] != anchors[order][:-1]) | (contents[order][1:] != contents[order][:-1])
    record = np.empty(len(order), np.int64)
    record[order] = np.cumsum(new) - 1
    first = order[new]
    return Runs(document, start, count, offset, record, anchors[first], contents[first], first, np.bincount(record, minlength=len(first)))


def bucket_of(anchors: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of anchor names, so a block's records of one bucket are neighbours."""
    return ((anchors >> _U64(32)) * _U64(buckets) >> _U64(32)).astype(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8")
    return b"".join([head.tobytes(), *(a.tobytes() for a in arrays)])


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    lengths = np.frombuffer(data, "<i8", len(kinds), 8)
    at, out = 8 + 8 * len(kinds), []
    for kind, n in zip(kinds, lengths.tolist(), strict=True):
        out.append(np.frombuffer(data, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def slices(values: np.ndarray):
    """(value, from, to) of each run of equal neighbours."""
    first, last = tk.run_bounds(values)
    return zip(values[first].tolist(), first.tolist(), (last + 1).tolist(), strict=True)


def documents(table: pa.Table) -> tuple[np.ndarray, list[bytes], list[int]]:
    """Ids (null: after all others) and texts in the order of the ids and then of the texts, and where they stand in the table.

    The order is the same whichever way the rows arrive, so a document's number can be sent about.
    """
    ids = [2**63 - 1 if x is None else x for x in table.column("id").to_pylist()]
    texts = [x or b"" for x in table.column("text").cast(pa.large_binary()).to_pylist()]
    order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
    return np.array([ids[k] for k in order], np.int64), [texts[k] for k in order], order


def rows_table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def deal(docs: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """(id, text, block) of the documents grouped by block, and the number of blocks."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be of an integer type")
    body = F.col(text_col)
    total = docs.select(F.coalesce(F.sum(F.octet_length(body)), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_bytes))
    dealt = docs.select(F.col(id_col).cast("long").alias("id"), body.alias("text"), F.pmod(F.xxhash64(F.col(id_col), body), F.lit(blocks)).cast("long").alias("block"))
    # the same shuffle of the texts serves all steps
    return dealt.repartition("block").groupBy("block"), blocks

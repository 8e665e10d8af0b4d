"""Exact deduplication with counting quotient filters.

Each partition of the corpus builds a counting quotient filter (CQF) over 64-bit fingerprints of
its normalised texts. A filter keeps its remainders sorted within the run of each quotient, so
filters of different partitions merge losslessly by one merge of sorted remainders, summing the
counts. Filters are cut by quotient range, each range is merged in one task, and fingerprints
whose count is above one route their documents to byte verification: a grouping by the whole
normalised text. Fingerprints that occur once need no verification.

Skew: a fingerprint has one slot per partition filter, however many copies the partition holds,
and verification combines equal texts on the map side, so a group with a third of all rows
reaches a reducer as one row per input partition.

Edge cases: a null text counts as the empty text; texts of white space only equal each other;
rows that repeat a doc_id and a text count separately in group_size and each is `kept` if its
doc_id is the smallest; a null doc_id is larger than any other; very long texts are compared whole, on the JVM; an
empty table gives no rows.
Columns of the input other than doc_id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import SPACES, partitions, plainly_named, text_or_empty

#: Bits of a fingerprint that choose the filter segment, which one task merges.
SEGMENT_BITS = 16


class CountingQuotientFilter:
    """A quotient filter over 64-bit fingerprints with a count in every slot.

    A fingerprint is split into a quotient (its top `quotient_bits`) and a remainder. Slots are in
    order of quotient, then remainder: `occupied` holds the quotients that have a run, `run_ends`
    the slot after each run's last, `remainders` and `counts` the slots themselves.
    """

    def __init__(self, quotient_bits: int, occupied: np.ndarray, run_ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotient_bits, self.occupied, self.run_ends, self.remainders, self.counts = quotient_bits, occupied, run_ends, remainders, counts

    @classmethod
    def _of_sorted(cls, quotient_bits: int, fingerprints: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        shift = np.uint64(64 - quotient_bits)
        quotients = fingerprints >> shift
        occupied, first = np.unique(quotients, return_index=True)
        return cls(quotient_bits, occupied, np.append(first[1:], len(quotients)).astype(np.int64), fingerprints & ((np.uint64(1) << shift) - np.uint64(1)), counts)

    @classmethod
    def build(cls, fingerprints: np.ndarray, quotient_bits: int = 24) -> CountingQuotientFilter:
        return cls._of_sorted(quotient_bits, *np.unique(fingerprints.astype(np.uint64), return_counts=True))

    def fingerprints(self) -> np.ndarray:
        """Every fingerprint, rebuilt from quotients and remainders: the filter loses nothing."""
        lengths = np.diff(np.concatenate(([0], self.run_ends))) if len(self.run_ends) else self.run_ends
        return (np.repeat(self.occupied, lengths) << np.uint64(64 - self.quotient_bits)) | self.remainders

    def count(self, fingerprint: int) -> int:
        shift = 64 - self.quotient_bits
        run = np.searchsorted(self.occupied, np.uint64(fingerprint >> shift))
        if run == len(self.occupied) or int(self.occupied[run]) != fingerprint >> shift:
            return 0
        start = self.run_ends[run - 1] if run else 0
        remainder = np.uint64(fingerprint & ((1 << shift) - 1))
        slot = start + np.searchsorted(self.remainders[start : self.run_ends[run]], remainder)
        return int(self.counts[slot]) if slot < self.run_ends[run] and self.remainders[slot] == remainder else 0

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """The filter of all the fingerprints in `filters`: slots in order of quotient and remainder, equal ones summed."""
        quotient_bits = filters[0].quotient_bits
        slots = np.concatenate([f.fingerprints() for f in filters])
        counts = np.concatenate([f.counts for f in filters])
        order = np.argsort(slots, kind="stable")
        slots, counts = slots[order], counts[order]
        if not len(slots):
            return filters[0]
        first = np.flatnonzero(np.concatenate(([True], slots[1:] != slots[:-1])))
        return cls._of_sorted(quotient_bits, slots[first], np.add.reduceat(counts, first))

    def slices(self, bits: int) -> Iterator[tuple[int, bytes]]:
        """The parts of the filter by the top `bits` of the quotient, serialised."""
        slots = self.fingerprints()
        segments = slots >> np.uint64(64 - bits)
        for start, end in zip(*_runs(segments), strict=True):
            yield int(segments[start]), self._of_sorted(self.quotient_bits, slots[start:end], self.counts[start:end]).to_bytes()

    def to_bytes(self) -> bytes:
        head = np.array([self.quotient_bits, len(self.occupied), len(self.remainders)], dtype="<i8")
        return b"".join(x.tobytes() for x in (head, self.occupied, self.run_ends, self.remainders, self.counts.astype("<i8")))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, runs, slots = (int(x) for x in np.frombuffer(data, "<i8", 3))
        at = 24
        parts = []
        for kind, n in (("<u8", runs), ("<i8", runs), ("<u8", slots), ("<i8", slots)):
            parts.append(np.frombuffer(data, kind, n, at))
            at += 8 * n
        return cls(bits, *parts)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1))
    return first, np.append(first[1:], len(values))


def normalised(text: str | Column) -> Column:
    """The text with each run of white space replaced by one space; null becomes the empty text."""
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def repeated_fingerprints(fingerprints: DataFrame, segments: int | None = None) -> DataFrame:
    """Of a frame with one long column `fp`, the values that occur more than once, by merging CQFs."""
    segments = segments or partitions(fingerprints.sparkSession)
    bits = min(SEGMENT_BITS, max(1, (segments - 1).bit_length() + 3))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: list[CountingQuotientFilter] = []
        for batch in batches:
            filters.append(CountingQuotientFilter.build(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            if len(filters) >= 16:
                filters = [CountingQuotientFilter.merge(filters)]
        if filters:
            for segment, data in CountingQuotientFilter.merge(filters).slices(bits):
                yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "filter": pa.array([data], pa.binary())})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        merged = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x) for x in group["filter"]])
        return pd.DataFrame({"fp": merged.fingerprints()[merged.counts > 1].view(np.int64)})

    return fingerprints.select("fp").mapInArrow(build, "segment int, filter binary").groupBy("segment").applyInPandas(merge, "fp long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("body")).withColumn("fp", F.xxhash64("body"))
    repeated = repeated_fingerprints(keyed.select("fp"))
    verified = (
        keyed.join(repeated, "fp", "left_semi")
        .groupBy("body")  # not by fp, so that a hot fingerprint's rows are combined wherever the join has them
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(F.xxhash64("body").alias("fp"), F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    light = keyed.select("doc_id", "fp", F.sha2("body", 256).alias("text_sha256"))
    return light.join(verified, ["fp", "text_sha256"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    docs, names = plainly_named(docs)
    id_col, text_col = names[id_col], names[text_col]
    stay = exact_groups(docs, id_col, text_col).where("kept").select("doc_id", "text_sha256").distinct()
    same = docs[id_col].eqNullSafe(stay["doc_id"]) & (F.sha2(normalised(text_col), 256) == stay["text_sha256"])
    return docs.join(stay, same, "left_semi").toDF(*names)

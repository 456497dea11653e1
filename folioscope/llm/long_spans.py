"""Problem 3: long exact spans shared between records.

Any stretch of ``length`` characters that stands in two records, at whatever
places, contains a shorter window that starts, in both, at a place whose
remainder modulo the period lies in a difference cover. So windows are hashed
only at those places (9 of 73). Windows that stand in two records are anchors;
around anchors, and only there, every run of ``length`` characters is hashed
and compared, and runs that stand in another record are merged to stretches.

Hashes travel as columns packed per task and hash range, a few bytes each
instead of a row each; hashes that a task finds in two records of its own are
settled there, so that a passage in a third of all records weighs once per
task. Ranges are counted out so that one fits in memory at any size of data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffle_width

LENGTH = 150
#: Characters whose hashes a task packs together, and hashes that one range
#: should hold on average: bounds on memory, not on what is compared.
CHUNK_CHARS = 4_000_000
RANGE_HASHES = 1_000_000
#: Kinds of records that can be told apart.
MAX_KINDS = 256

#: Packed columns of a hash range: hash (8 bytes), further hash bits (4),
#: record id, its kind, place.
FIELDS = (("h", np.uint64), ("g", np.uint32), ("id", np.int64), ("kind", np.uint8), ("pos", np.uint32))
BLOB = "bucket long, settled boolean, n long, h binary, g binary, id binary, kind binary, pos binary"


def difference_cover(period: int) -> list[int]:
    """Remainders of which any two places, shifted by one same amount, hit
    members: every difference modulo ``period`` occurs between two members.
    Powers of two modulo 73 are such a set, of the least possible size; for
    other periods one is built greedily."""
    powers = sorted({pow(2, k, period) for k in range(9)}) if period % 2 else []
    if _covers(powers, period):
        return powers
    cover = [0]
    missing = set(range(1, period // 2 + 1))
    while missing:
        best = max(range(period), key=lambda c: len({min((c - x) % period, (x - c) % period) for x in cover} & missing))
        missing -= {min((best - x) % period, (x - best) % period) for x in cover}
        cover.append(best)
    return sorted(set(cover))


def _covers(cover: list[int], period: int) -> bool:
    return len({(a - b) % period for a in cover for b in cover}) == period


def period_for(length: int) -> int:
    """About half of the length: windows stay long, places few."""
    return 73 if length >= 110 else max(1, length // 2)


def _pack(bucket: int, settled: bool, rows: dict[str, np.ndarray]) -> dict:
    blobs = {f: pa.compress(np.ascontiguousarray(rows[f], t).tobytes(), "zstd", asbytes=True) for f, t in FIELDS}
    return {"bucket": bucket, "settled": settled, "n": len(rows["id"])} | blobs


def _unpack(row: dict) -> dict[str, np.ndarray]:
    return {f: np.frombuffer(pa.decompress(row[f], row["n"] * np.dtype(t).itemsize, "zstd", asbytes=True), t) for f, t in FIELDS}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    types = {"bucket": pa.int64(), "settled": pa.bool_(), "n": pa.int64()}
    return pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], types.get(c, pa.binary())) for c in ("bucket", "settled", "n", *(f for f, _ in FIELDS))})


def _take(rows: dict[str, np.ndarray], index: np.ndarray) -> dict[str, np.ndarray]:
    return {f: v[index] for f, v in rows.items()}


def _groups(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, starts of the groups of equal hashes in it, and whether
    each group stands in two records."""
    order = np.lexsort((rows["g"], rows["h"]))
    h, g, i, k = (rows[f][order] for f in ("h", "g", "id", "kind"))
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    starts = np.flatnonzero(new)
    if not len(starts):
        return order, starts, np.zeros(0, bool)
    two = (np.minimum.reduceat(i, starts) != np.maximum.reduceat(i, starts)) | (np.minimum.reduceat(k, starts) != np.maximum.reduceat(k, starts))
    return order, starts, two


def _send(rows: dict[str, np.ndarray], buckets: int) -> Iterator[dict]:
    """Packs hashes by range. Groups that stand in two records here are settled:
    they go out marked, spread by record, and leave two of their rows as
    witnesses for the other tasks."""
    order, starts, two = _groups(rows)
    if not len(order):
        return
    sizes = np.diff(np.append(starts, len(order)))
    member = np.repeat(two, sizes)
    settled = _take(rows, np.sort(order[member]))
    if len(settled["id"]):
        yield _pack(int(settled["id"][0]) % buckets, True, settled)
    # of a settled group one row of its least and one of its greatest record stays
    witness = np.zeros(len(order), bool)
    for a, n in zip(starts[two], sizes[two], strict=True):
        ids = rows["id"][order[a : a + n]] * 256 + rows["kind"][order[a : a + n]]
        witness[a + int(ids.argmin())] = witness[a + int(ids.argmax())] = True
    left = np.sort(order[~member | witness])
    rest = _take(rows, left)
    # 64 hash bits over the ranges; the order of records and places is kept, it packs well
    bucket = (rest["h"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    by = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[by])) + 1
    for part in np.split(by, edges):
        yield _pack(int(bucket[part[0]]), False, _take(rest, part))


def _meet(packed: DataFrame) -> DataFrame:
    """(kind, id, places): the places of all hashes that stand in two records,
    in parts; witnesses come twice and are merged later."""

    def found(blobs: list[dict]) -> Iterator[dict[str, np.ndarray]]:
        yield from (_unpack(b) for b in blobs if b["settled"])
        open_ = [_unpack(b) for b in blobs if not b["settled"]]
        if open_:
            rows = {f: np.concatenate([x[f] for x in open_]) for f, _ in FIELDS}
            order, starts, two = _groups(rows)
            sizes = np.diff(np.append(starts, len(order)))
            yield _take(rows, order[np.repeat(two, sizes)])

    def per_record(blobs: list[dict]) -> Iterator[pa.RecordBatch]:
        for rows in found(blobs):
            order = np.lexsort((rows["pos"], rows["kind"], rows["id"]))
            if not len(order):
                continue
            rows = _take(rows, order)
            starts = np.flatnonzero(np.append(True, (np.diff(rows["id"]) != 0) | (np.diff(rows["kind"].astype(np.int16)) != 0)))
            places = [np.asarray(x, np.uint32).tobytes() for x in np.split(rows["pos"], starts[1:])]
            yield pa.RecordBatch.from_pydict({"kind": pa.array(rows["kind"][starts], pa.int32()), "id": pa.array(rows["id"][starts], pa.int64()), "places": pa.array([pa.compress(x, "zstd", asbytes=True) for x in places], pa.binary()), "n": pa.array([len(x) // 4 for x in places], pa.int32())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (held[-1]["bucket"] != row["bucket"] or row["settled"]):
                    yield from per_record(held)
                    held = []
                held.append(row)
        yield from per_record(held)

    width = shuffle_width(packed.sparkSession)
    ranges = packed.repartition(width, "bucket").sortWithinPartitions("bucket", "settled")
    return ranges.mapInArrow(run, "kind int, id long, places binary, n int")


def _places(parts: list[bytes], counts: list[int]) -> np.ndarray:
    return np.unique(np.concatenate([np.frombuffer(pa.decompress(p, 4 * n, "zstd", asbytes=True), np.uint32) for p, n in zip(parts, counts, strict=True)])).astype(np.int64)


def _merged(met: DataFrame) -> DataFrame:
    """(kind, id, parts): the packed places of each record together."""
    return met.groupBy("kind", "id").agg(F.collect_list(F.struct("places", "n")).alias("parts"))


def _anchor_bits(hashes: float) -> int:
    """Bits by which anchors are told apart: false ones stay rare at any size,
    and only cost a look at their runs."""
    return min(64, max(34, math.ceil(math.log2(hashes + 2)) + 12))


def _run_bits(hashes: float) -> int:
    """Bits by which runs are compared: with 2 log2(n) + 30, fewer than 2^-30
    false pairs are expected among n, up to n = 2^33; 96 bits beyond."""
    return min(96, max(64, 2 * math.ceil(math.log2(hashes + 2)) + 30))


class _Chunk:
    """Hashes of a task's texts, until there are enough to pack."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.h: list[int] = []
        self.g: list[int] = []
        self.pos: list[int] = []
        self.owners: list[tuple[int, int, int]] = []
        self.chars = 0

    def add(self, kind: int, rec: int, text: str, starts: list[int], size: int, exact: bool) -> None:
        # four bytes a character, so that any character can be cut out directly
        raw = text.encode("utf-32-le", "surrogatepass")
        cuts = [raw[4 * s : 4 * (s + size)] for s in starts]
        if exact:
            digest, more = xxhash.xxh3_128_intdigest, (1 << (self.bits - 64)) - 1
            values = [digest(c) for c in cuts]
            self.h += [v & 0xFFFFFFFFFFFFFFFF for v in values]
            self.g += [v >> 64 & more for v in values]
        else:
            digest64, top = xxhash.xxh3_64_intdigest, (1 << self.bits) - 1 << 64 - self.bits
            self.h += [digest64(c) & top for c in cuts]
        self.pos += starts
        self.owners.append((kind, rec, len(starts)))
        self.chars += len(text) if not exact else 8 * len(starts)

    def rows(self) -> dict[str, np.ndarray]:
        counts = [n for _, _, n in self.owners]
        return {
            "h": np.array(self.h, np.uint64), "g": np.array(self.g, np.uint32) if self.g else np.zeros(len(self.h), np.uint32), "pos": np.array(self.pos, np.uint32),
            "id": np.repeat(np.array([r for _, r, _ in self.owners], np.int64), counts), "kind": np.repeat(np.array([k for k, _, _ in self.owners], np.uint8), counts),
        }


def _packed(rows: DataFrame, starts_of: Callable[[dict], list[int]], size: int, exact: bool, hashes: float) -> DataFrame:
    buckets = max(shuffle_width(rows.sparkSession), int(hashes / RANGE_HASHES))
    bits = _run_bits(hashes) if exact else _anchor_bits(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk(bits)
        for batch in batches:
            for row in batch.to_pylist():
                starts = starts_of(row)
                if starts:
                    chunk.add(row["kind"], row["id"], row["text"], starts, size, exact)
                if chunk.chars >= CHUNK_CHARS:
                    for packed in _send(chunk.rows(), buckets):
                        yield _batch([packed])
                    chunk = _Chunk(bits)
        for packed in _send(chunk.rows(), buckets):
            yield _batch([packed])

    return rows.mapInArrow(run, BLOB)


def anchor_windows(texts: DataFrame, length: int, hashes: float) -> DataFrame:
    """Packed windows at the cover places of ``texts`` (kind, id, text)."""
    period = period_for(length)
    cover = difference_cover(period)
    size = length - period + 1

    def starts_of(row: dict) -> list[int]:
        n = len(row["text"])
        if n < length:
            return []
        return [s for block in range(0, n - size + 1, period) for c in cover if (s := block + c) <= n - size]

    return _packed(texts.select("kind", "id", "text"), starts_of, size, False, hashes)


def candidate_runs(anchored: DataFrame, length: int, hashes: float) -> DataFrame:
    """Packed hashes of all runs of ``length`` characters that contain an anchor,
    from rows (kind, id, text, parts)."""
    size = length - period_for(length) + 1

    def starts_of(row: dict) -> list[int]:
        last = len(row["text"]) - length
        out: list[int] = []
        done = -1
        for p in _places([x["places"] for x in row["parts"]], [x["n"] for x in row["parts"]]).tolist():
            out += range(max(done + 1, p + size - length, 0), min(p, last) + 1)
            done = max(done, p)
        return out

    return _packed(anchored.select("kind", "id", "text", "parts"), starts_of, length, True, hashes)


def shared_stretches(records: DataFrame, length: int = LENGTH) -> DataFrame:
    """``rec_kind, rec_id, start_pos, end_pos, n_chars`` from records
    (rec_kind, rec_id BIGINT, text): the longest stretches in which every
    character lies in a run of ``length`` characters that also stands in
    another record. Runs are compared by 64 to 96 bits of their hash, as many
    as the size of the data asks for.

    Records are told apart by kind and id; a record delivered several times
    with the same text is one; of different texts under one id the least is
    taken. Null ids and texts, and texts shorter than ``length``, have none.
    """
    spark = records.sparkSession
    kinds = sorted(r[0] for r in records.select("rec_kind").filter("rec_kind is not null").distinct().limit(MAX_KINDS + 1).collect())
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of records")
    code = F.try_element_at(F.create_map(*(F.lit(x) for i, k in enumerate(kinds) for x in (k, i))), F.col("rec_kind")) if kinds else F.lit(None).cast("int")
    known = records.filter((F.length("text") >= length) & F.col("rec_id").isNotNull() & F.col("rec_kind").isNotNull()).select(code.alias("kind"), F.col("rec_id").alias("id"), "text")
    # which text counts for an id, on hashes alone; copies of one text are looked at once, in its least record
    hashed = known.select("kind", "id", F.unhex(F.md5("text")).alias("doc"), F.length("text").alias("n_chars"))
    members = cut_lineage(hashed.groupBy("kind", "id").agg(F.min(F.struct("doc", "n_chars")).alias("m")).select("kind", "id", "m.*"))
    docs = members.groupBy("doc").agg(F.min(F.struct("kind", "id")).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = docs.select("first.kind", "first.id", "doc", "n")
    copies = docs.filter("n > 1").select("doc")

    chars = members.agg(F.sum("n_chars")).collect()[0][0] or 0
    period = period_for(length)
    anchors = _merged(_meet(anchor_windows(known, length, chars * len(difference_cover(period)) / period)))
    # of copies only the first record goes on; the join also drops texts that do not count for their id
    chosen = anchors.join(firsts, ["kind", "id"])
    runs = known.join(chosen, ["kind", "id"]).filter(F.unhex(F.md5("text")) == F.col("doc"))
    found = _merged(_meet(candidate_runs(runs, length, chars)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, a, b = [], [], []
            for row, parts in enumerate(batch.column(2).to_pylist()):
                s = _places([x["places"] for x in parts], [x["n"] for x in parts])
                breaks = np.flatnonzero(np.diff(s) > length) + 1
                for part in np.split(s, breaks):
                    rows.append(row)
                    a.append(int(part[0]))
                    b.append(int(part[-1]) + length)
            index = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["kind", "id", "start_pos", "end_pos"])

    stretches = found.mapInArrow(merge, "kind int, id long, start_pos int, end_pos int")
    whole = members.join(copies, "doc", "left_semi").select("kind", "id", "n_chars", F.lit(0).alias("start_pos"), F.col("n_chars").alias("end_pos"))
    single = members.join(copies, "doc", "left_anti").join(stretches, ["kind", "id"]).select("kind", "id", "n_chars", "start_pos", "end_pos")
    name = F.element_at(F.array(*(F.lit(k) for k in kinds)), F.col("kind") + 1) if kinds else F.lit(None).cast("string")
    return single.unionByName(whole).select(name.alias("rec_kind"), F.col("id").alias("rec_id"), "start_pos", "end_pos", "n_chars")


def shared_part(stretches: DataFrame) -> DataFrame:
    """``rec_kind, rec_id, n_chars, shared_chars, shared_part`` of each record
    that has a stretch."""
    return stretches.groupBy("rec_kind", "rec_id", "n_chars").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars")).withColumn("shared_part", F.round(F.col("shared_chars") / F.col("n_chars"), 6))

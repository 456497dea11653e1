"""Problem 2: splits that keep related records together.

A record is tied to the things it names: its author, its source file, the
entities in its text. Records that share a thing, directly or through others,
form a group. Only the graph between things is solved (each record contributes
one path over its own things, never its pairs with other records).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, even_rank
from .words import canonical_words, strip_marks

#: More names than this go through a join on word n-grams instead of a broadcast.
MAX_BROADCAST_NAMES = 100_000
#: Split totals are exact up to this many records; above, sizes are planned in
#: units of records / MAX_TOTAL.
MAX_TOTAL = 1 << 22
PROPORTIONS = (("train", 0.8), ("val", 0.1), ("test", 0.1))


def author_key(name: str | None) -> str | None:
    """A full name however written: case, accents and spacing aside, and
    ``Last, First`` turned round."""
    parts = [p for p in ((name or "").replace("\xa0", " ")).split(",")]
    ordered = parts[1:] + parts[:1] if len(parts) == 2 and all(canonical_words(p) for p in parts) else parts
    return " ".join(w for p in ordered for w in canonical_words(p)) or None


def file_key(path: str | None) -> str | None:
    """The file's name without folders, extension and case."""
    name = (path or "").strip().replace("\\", "/").rsplit("/", 1)[-1]
    stem, dot, extension = name.rpartition(".")
    if dot and stem and 0 < len(extension) <= 5 and extension.isalnum():
        name = stem
    return strip_marks(name.casefold()).strip() or None


def _names(entities: DataFrame, id_col: str, name_cols: list[str]) -> DataFrame:
    """(name, entity): each spelling once per entity, as canonical words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [" ".join(canonical_words(x)) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch.column(1)], names=["name", "entity"])

    long = entities.select(F.explode(F.array(*name_cols)).alias("name"), F.col(id_col).cast("string").alias("entity")).filter("name is not null")
    return long.mapInArrow(run, "name string, entity string").filter("name != ''").distinct()


def record_keys(df: DataFrame, id_col: str, source_col: str, author_col: str, text_col: str, entities: DataFrame, entity_id: str = "entity_id", name_cols: tuple[str, ...] = ("name", "alias")) -> DataFrame:
    """``(id, keys)``: the things each row names, as sorted distinct strings
    ``a:<author>``, ``e:<entity>``, ``f:<file>``. Nulls and blanks name nothing."""
    spark = df.sparkSession
    names = _names(entities, entity_id, list(name_cols))
    few = names.limit(MAX_BROADCAST_NAMES + 1).collect()
    small = len(few) <= MAX_BROADCAST_NAMES
    table: dict[str, list[str]] = {}
    for r in few if small else []:
        table.setdefault(r["name"], []).append(r["entity"])
    shared = spark.sparkContext.broadcast(table)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        known = shared.value
        search = ahocorasick.Automaton()
        for name, ids in known.items():
            search.add_word(f" {name} ", ids)
        if known:
            search.make_automaton()
        for batch in batches:
            out, texts = [], []
            for source, author, text in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                words = " ".join(canonical_words(text))
                keys = {f"f:{x}" for x in [file_key(source)] if x} | {f"a:{x}" for x in [author_key(author)] if x}
                if known and words:
                    keys |= {f"e:{e}" for _, ids in search.iter(f" {words} ") for e in ids}
                out.append(sorted(keys))
                texts.append(None if small else words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["id", "keys", "words"])

    rows = df.select(F.col(id_col).alias("id"), *(F.col(c) for c in (source_col, author_col, text_col))).mapInArrow(run, f"id {kind}, keys array<string>, words string")
    if small:
        return rows.drop("words").withColumnRenamed("id", id_col)
    sizes = [r[0] for r in names.select(F.size(F.split("name", " "))).distinct().collect()]  # word counts of names: few
    words = F.split("words", " ")
    grams = F.flatten(F.array(*(_word_grams(words, n) for n in sizes)))
    named = rows.select("id", F.explode(F.array_distinct(grams)).alias("name")).join(names, "name").groupBy("id").agg(F.collect_set(F.concat(F.lit("e:"), "entity")).alias("more"))
    all_keys = rows.join(named.withColumnRenamed("id", "__i"), F.col("id").eqNullSafe(F.col("__i")), "left")
    return all_keys.select(F.col("id").alias(id_col), F.array_sort(F.array_union("keys", F.coalesce("more", F.array().cast("array<string>")))).alias("keys"))


def _word_grams(words: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def connected(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges`` (u, v): label is the least
    node of its component.

    Each round hooks every node that has a smaller neighbour under the least
    one, shortcuts the parents until all point to roots (each step halves the
    depth), and contracts the edges to roots. Everything stays in joined
    tables, checkpointed each step; rounds grow with the logarithm of the
    longest chain. A null end drops its edge.
    """
    pairs = edges.filter("u is not null and v is not null")
    live = cut_lineage(pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
    labels = cut_lineage(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")))
    live = live.filter("a != b")
    while not live.isEmpty():
        parents = cut_lineage(live.groupBy(F.col("b").alias("child")).agg(F.min("a").alias("parent")))
        while True:
            up = parents.select(F.col("child").alias("parent"), F.col("parent").alias("grand"))
            parents = cut_lineage(parents.join(up, "parent", "left").select("child", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")))
            if parents.filter("moved").isEmpty():
                break
            parents = parents.drop("moved")
        parents = parents.drop("moved")

        def root(df: DataFrame, column: str, parents: DataFrame = parents) -> DataFrame:
            lifted = df.join(parents, df[column] == parents["child"], "left")
            return lifted.withColumn(column, F.coalesce("parent", column)).drop("child", "parent")

        labels = cut_lineage(root(labels, "label"))
        moved = root(root(live, "a"), "b").filter("a != b")
        live = cut_lineage(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels


def related_groups(keys: DataFrame, id_col: str, keys_col: str = "keys") -> DataFrame:
    """``(id, group_id, n)``: each record with the least id of its group and the
    number of records in it; records tied to none are groups of one.

    ``keys`` may hold an id several times; its things are then taken together.
    Null ids are left out, as they name no record.
    """
    rows = keys.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(keys_col).alias("keys"))
    rows = cut_lineage(rows.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("keys")))
    first = F.get("keys", F.lit(0))
    # things with one partner each: a record's path to its first thing
    edges = rows.filter(F.size("keys") > 0).select(first.alias("u"), F.explode("keys").alias("v")).distinct()
    labels = connected(edges)
    tied = rows.filter(F.size("keys") > 0).select("id", first.alias("node")).join(labels, "node").select("id", "label")
    tied = cut_lineage(tied)
    groups = tied.groupBy("label").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n"))
    alone = rows.filter(F.size("keys") == 0).select("id", F.col("id").alias("group_id"), F.lit(1).cast("long").alias("n"))
    return tied.join(groups, "label").select("id", "group_id", "n").unionByName(alone).withColumnRenamed("id", id_col)


def choose(sizes: dict[int, int], target: float, limit: int) -> dict[int, int]:
    """How many groups of each size to take so that their total is as near to
    ``target`` as any choice can be; of equally near totals the smaller.

    A bitset holds all totals that can be reached; a size that occurs m times
    enters as bundles of 1, 2, 4, ... groups, so it costs log m shifts.
    """
    bundles = []
    for size in sorted(sizes, reverse=True):
        left, k = sizes[size], 1
        while left > 0:
            k = min(k, left)
            bundles.append((size, k))
            left -= k
            k *= 2
    mask = (1 << (limit + 1)) - 1
    reach = 1
    when = np.full(limit + 1, -1, np.int32)
    for index, (size, k) in enumerate(bundles):
        step = size * k
        if step > limit:
            continue
        grown = (reach | reach << step) & mask
        fresh = grown & ~reach
        if fresh:
            bits = np.unpackbits(np.frombuffer(fresh.to_bytes(limit // 8 + 1, "little"), np.uint8), bitorder="little")[: limit + 1]
            when[bits.astype(bool)] = index
            reach = grown
    totals = np.flatnonzero(when >= 0)
    totals = np.concatenate([[0], totals])
    total = int(totals[np.argmin(np.abs(totals - target))])
    taken: dict[int, int] = {}
    while total:
        size, k = bundles[when[total]]
        taken[size] = taken.get(size, 0) + k
        total -= size * k
    return taken


def plan_splits(sizes: dict[int, int], proportions: tuple[tuple[str, float], ...] = PROPORTIONS, max_total: int = MAX_TOTAL) -> list[tuple[int, int, int, str]]:
    """``(size, first_rank, last_rank, split)``: the groups of each size, by
    rank, over the splits. All but the largest share are filled in turn, each
    as near as possible to its total; the largest share takes the rest."""
    total = sum(s * n for s, n in sizes.items())
    unit = max(1, -(-total // max_total))
    left = dict(sizes)
    start = dict.fromkeys(sizes, 0)
    out = []
    order = sorted(proportions, key=lambda p: (p[1], p[0]))
    for name, share in order[:-1]:
        if unit == 1:
            taken = choose(left, share * total, min(total, int(2 * share * total) + max(left, default=0) + 1))
        else:
            # sizes below the unit are planned as whole units of equal groups, then topped up one by one
            coarse = {s: n for s, n in left.items() if s >= unit and n}
            by_unit: dict[int, int] = {}
            for s, n in coarse.items():
                by_unit[s // unit] = by_unit.get(s // unit, 0) + n
            wanted = choose(by_unit, share * total / unit, min(max_total, int(2 * share * max_total) + 1))
            taken, room = {}, share * total
            for s in sorted(coarse, reverse=True):
                k = min(coarse[s], wanted.get(s // unit, 0), int(room // s))
                if k:
                    taken[s] = k
                    wanted[s // unit] -= k
                    room -= s * k
            for s in sorted((s for s in left if left[s] > taken.get(s, 0)), reverse=True):
                k = min(left[s] - taken.get(s, 0), int(room // s))
                if k > 0:
                    taken[s] = taken.get(s, 0) + k
                    room -= s * k
        for s, k in taken.items():
            out.append((s, start[s], start[s] + k - 1, name))
            start[s] += k
            left[s] -= k
    out += [(s, start[s], sizes[s] - 1, order[-1][0]) for s in sizes if start[s] < sizes[s]]
    return out


def grouped_splits(groups: DataFrame, id_col: str, proportions: tuple[tuple[str, float], ...] = PROPORTIONS) -> DataFrame:
    """``id, group_id, split`` for every record: whole groups, split totals as
    near to the proportions as whole groups allow (chosen on the table of group
    sizes, which for N records has at most sqrt(2 N) rows)."""
    spark = groups.sparkSession
    heads = groups.filter(F.col(id_col) == F.col("group_id")).select(F.col("group_id").alias("g"), F.col("n").cast("long").alias("n"))
    sizes = {r["n"]: r["count"] for r in heads.groupBy("n").count().collect()}
    steps = spark.createDataFrame(plan_splits(sizes, proportions), "size long, lo long, hi long, split string")
    ranked = even_rank(heads, "n", ["g"], "r")
    placed = ranked.join(steps, (F.col("n") == F.col("size")) & F.col("r").between(F.col("lo"), F.col("hi"))).select("g", "split")
    return groups.join(placed, F.col("group_id") == F.col("g")).select(id_col, "group_id", "split")


def tied_records(groups: DataFrame, id_col: str) -> DataFrame:
    """``id, group_id`` of the records that are tied to at least one other."""
    return groups.filter("n > 1").select(id_col, "group_id")


def file_column(source: Column) -> Column:
    """:func:`file_key` as a column expression, accents kept."""
    name = F.element_at(F.split(F.regexp_replace(F.trim(source), r"\\", "/"), "/"), -1)
    plain = F.lower(F.regexp_replace(name, r"(?<=.)\.[A-Za-z0-9]{1,5}$", ""))
    return F.when(plain != "", plain)

"""Problem 8: items into containers of fixed capacity, best fit decreasing.

Best fit decreasing treats equal items alike, so its outcome depends only on
how many items of each size there are. Sizes are whole numbers up to the
capacity, so this table has at most ``capacity`` rows whatever the data. The
packing is planned on it, with a segment tree over the remaining capacities
that finds the tightest open container in logarithmic time; equal items for
equal containers are placed in one step. The plan then goes back to the rows
by the rank of each item among those of its size.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, even_rank
from .corpus_ids import count_tokens
from .tokenizer import BYTE_BPE

CAPACITY = 2048


class TightestFit:
    """Segment tree over remaining capacities 0..n: whether any container
    stands at each, and the least one at or above a size."""

    def __init__(self, n: int) -> None:
        self.leaves = 1
        while self.leaves <= n:
            self.leaves *= 2
        self.any = bytearray(2 * self.leaves)

    def set(self, i: int, present: bool) -> None:
        i += self.leaves
        self.any[i] = present
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def least(self, size: int) -> int | None:
        i = size + self.leaves
        if self.any[i]:
            return size
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan(sizes: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Steps ``(size, first_rank, last_rank, first_container, per_container)``
    and the number of containers: the items of ``size`` with these ranks go to
    consecutive containers, ``per_container`` to each (the last may get
    fewer). Same result as placing the items one by one, largest first, each
    into the tightest container that holds it, the oldest of equal ones."""
    tree = TightestFit(capacity)
    open_at: dict[int, deque[tuple[int, int]]] = defaultdict(deque)
    steps: list[tuple[int, int, int, int, int]] = []
    made = 0

    def put(remaining: int, first: int, count: int) -> None:
        if count and remaining:
            open_at[remaining].append((first, count))
            tree.set(remaining, True)

    for size in sorted((s for s in sizes if s > 0), reverse=True):
        rank, left = 0, sizes[size]
        while left:
            remaining = tree.least(size)
            if remaining is None:
                remaining = capacity
                first, count = made, -(-left // (capacity // size))
                made += count
            else:
                first, count = open_at[remaining].popleft()
                if not open_at[remaining]:
                    tree.set(remaining, False)
            each = remaining // size
            full = min(count, left // each)
            over = left - full * each if full < count else 0
            over = min(over, each - 1)
            placed = full * each + over
            steps.append((size, rank, rank + placed - 1, first, each))
            used = full + (over > 0)
            put(remaining - each * size, first, full)
            put(remaining - over * size, first + full, 1 if over else 0)
            if used < count:
                # unused containers go back to the front: they are the oldest of their kind
                open_at[remaining].appendleft((first + used, count - used))
                tree.set(remaining, True)
            rank += placed
            left -= placed
    return steps, made


def pack(df: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY) -> DataFrame:
    """``id, part, size, container``: every row in one container, or, if larger
    than the capacity, in parts of ``capacity`` and a rest (``part`` counts
    from 0). Containers are numbered from 0.

    Rows without size (null or at most 0) take no room and get a null
    container. Ids should differ; rows with equal id and size are told apart
    by no one, so they are numbered as they come within their bucket.
    """
    spark = df.sparkSession
    items = df.select(F.col(id_col).alias("__id"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("long").alias("__total"))
    parts = F.greatest(F.ceil(F.col("__total") / capacity), F.lit(1)).cast("int")
    items = items.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    items = items.withColumn("size", F.least(F.col("__total") - F.col("part") * capacity, F.lit(capacity)).cast("int")).drop("__total")
    items = cut_lineage(items)
    sizes = {r["size"]: r["count"] for r in items.filter("size > 0").groupBy("size").count().collect()}  # at most `capacity` rows
    steps, _ = plan(sizes, capacity)
    schema = "__size int, __from long, __to long, __first long, __each long"
    # bounded by the capacity, not by the data: a step uses up a size or a group of equal containers
    by_plan = F.broadcast(spark.createDataFrame(steps, schema))
    ranked = even_rank(items.filter("size > 0"), "size", ["__id", "part"], "__rank")
    placed = ranked.join(by_plan, (F.col("size") == F.col("__size")) & F.col("__rank").between(F.col("__from"), F.col("__to")))
    placed = placed.withColumn("container", (F.col("__first") + F.floor((F.col("__rank") - F.col("__from")) / F.col("__each"))).cast("long"))
    nothing = items.filter("size = 0").withColumn("container", F.lit(None).cast("long"))
    columns = ["__id", "part", "size", "container"]
    return placed.select(columns).unionByName(nothing.select(columns)).withColumnRenamed("__id", id_col)


def pack_texts(df: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, path: str = BYTE_BPE) -> DataFrame:
    """:func:`pack` with sizes in tokens of a public tokenizer."""
    return pack(count_tokens(df, id_col, text_col, path), id_col, "n_tokens", capacity)


def container_fill(packed: DataFrame) -> DataFrame:
    """``container, n_items, used`` of each container."""
    return packed.filter("container is not null").groupBy("container").agg(F.count(F.lit(1)).alias("n_items"), F.sum("size").alias("used"))

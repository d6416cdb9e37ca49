"""Problem 9: filling containers of fixed capacity.

Only an item's size matters for the plan, and sizes are whole numbers up to the capacity.
So the items are counted by size in Spark; the plan is made on that histogram, whose
length the capacity bounds; and the items are dealt to the planned places by their rank within
their size. The plan first fixes small sets that dominate every alternative
(Martello-Toth reduction), then packs the rest best-fit decreasing, whole classes of equal
items and equal containers at a time.

An item above the capacity is cut into full pieces and one rest; no other item is split.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.bpe import token_counts
from pagewright.plans.runtime import materialize, table

#: Items per share: the pieces of one size are ranked share by share.
SHARE = 50_000


def reduce_dominated(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Martello-Toth reduction of a histogram size -> number, in place.

    Returns the fixed containers as (sizes, how many). For the largest size a of what is left:
    {a} if nothing fits beside it; {a, b} if b is the largest that fits and either fills the
    container or no two items fit beside a; {a, b, c} if no three fit, b is the largest that
    fits, c the largest that fits after it, and no pair with an item above c fits.
    Sizes that allow none are stepped over and tried again after each change.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    sizes = sorted(counts)

    def take(*items: int) -> None:
        need = defaultdict(int)
        for s in items:
            need[s] += 1
        times = min(counts[s] // k for s, k in need.items())
        for s, k in need.items():
            counts[s] -= k * times
            if not counts[s]:
                del counts[s]
                sizes.pop(bisect_left(sizes, s))
        fixed.append((items, times))

    def largest(limit: int, used: tuple[int, ...]) -> int | None:
        """The largest size up to ``limit`` of which an item is left besides ``used``."""
        i = bisect_right(sizes, limit) - 1
        while i >= 0 and counts[sizes[i]] <= used.count(sizes[i]):
            i -= 1
        return sizes[i] if i >= 0 else None

    def smallest(k: int, used: tuple[int, ...]) -> list[int]:
        out: list[int] = []
        for s in sizes:
            out += [s] * min(counts[s] - used.count(s), k - len(out))
            if len(out) == k:
                break
        return out

    def fix(a: int) -> bool:
        room = capacity - a
        b = largest(room, (a,))
        if b is None:
            take(a)
            return True
        two = smallest(2, (a,))
        if a + b == capacity or len(two) < 2 or sum(two) > room:
            take(a, b)
            return True
        three = smallest(3, (a,))
        if len(three) == 3 and sum(three) <= room:
            return False
        c = largest(room - b, (a, b))
        if c is None:
            return False
        i = bisect_right(sizes, c)
        while i < len(sizes) and counts[sizes[i]] <= (a, b, c).count(sizes[i]):
            i += 1
        if i == len(sizes) or 2 * sizes[i] > room:
            take(a, b, c)
            return True
        return False

    changed = True
    while changed:
        changed = False
        i = len(sizes) - 1
        while i >= 0:
            if fix(sizes[i]):
                changed = True
                i = min(i, len(sizes)) - (i >= len(sizes))
                i = min(i, len(sizes) - 1)
            else:
                i -= 1
            if i >= 0 and 4 * sizes[i] <= capacity:
                break  # three more items of this size fit beside it: no rule applies to it or below
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing of a histogram; equal containers are kept as one group (sizes, how many)."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, sizes: tuple[int, ...], n: int) -> None:
        if room not in groups or not groups[room]:
            insort(rooms, room)
        groups[room].append((sizes, n))

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                room, sizes, n = capacity, (), -1
            else:
                room = rooms[i]
                sizes, n = groups[room].pop()
                if not groups[room]:
                    rooms.pop(i)
            each = room // s  # after one item the container is the best fit for the next
            full = left // each if n < 0 else min(n, left // each)
            if full:
                put(room - each * s, sizes + (s,) * each, full)
                left -= full * each
            if n < 0 or full < n:
                rest = left if left < each else 0
                if rest:
                    put(room - rest * s, sizes + (s,) * rest, 1)
                    left = 0
                if n > full + bool(rest):
                    put(room, sizes, n - full - bool(rest))
    return [g for room in sorted(groups) for g in groups[room]]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """All containers of a histogram of sizes 1 to capacity, as (sizes, how many)."""
    counts = {s: n for s, n in counts.items() if n}
    fixed = reduce_dominated(counts, capacity)
    return fixed + best_fit(counts, capacity)


def places(containers: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(size, first_rank, last_rank, first_container, per_container): where the items of a size go, by rank from 0."""
    seen: dict[int, int] = defaultdict(int)
    out, first = [], 1
    for sizes, n in containers:
        for s in sorted(set(sizes)):
            each = sizes.count(s)
            out.append((s, seen[s], seen[s] + each * n - 1, first, each))
            seen[s] += each * n
        first += n
    return out


def pieces(sizes: DataFrame, budgets: list[tuple[int, int]], key: str) -> DataFrame:
    """(budget_id, capacity, key, piece_no, start, tokens) for every budget (id, capacity): items up to the capacity whole, larger ones in full pieces and a rest.

    Null and non-positive sizes count as 0 and give one piece of 0 tokens. The sizes are read once for all budgets, which are few.
    """
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("budget_id"), F.lit(c).alias("capacity")) for b, c in budgets])).alias("b")
    t = F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0))
    base = sizes.select(F.col(key), t.alias("all"), each).select("b.*", key, "all")
    n = F.greatest(F.ceil(F.col("all") / F.col("capacity")), F.lit(1)).cast("int")
    out = base.withColumn("piece_no", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("piece_no").cast("long") * F.col("capacity")
    return out.select("budget_id", "capacity", key, "piece_no", start.alias("start"), F.least(F.col("all") - start, F.col("capacity")).cast("int").alias("tokens"))


def packed_all(sizes: DataFrame, budgets: list[tuple[int, int]], key: str = "doc_id") -> DataFrame:
    """(budget_id, key, piece_no, start, tokens, container_id) for items (key, tokens) and budgets (id, capacity); container_id counts from 1 in each budget.

    Pieces of 0 tokens take no room and go to container 1. Keys should be unique; repeated
    ones are items of their own. Equal items are told apart by key and piece. The shares that rank the pieces of a size
    follow from the number of items, so a size that most pieces have, full ones above all, is spread over tasks.
    """
    spark = sizes.sparkSession
    shares = max(8, -(-sizes.count() // SHARE))
    parts = pieces(sizes, budgets, key).withColumn("share", F.pmod(F.xxhash64(key, "piece_no"), F.lit(shares)).cast("int"))
    by_share = materialize(parts.filter("tokens > 0").groupBy("budget_id", "tokens", "share").agg(F.count("*").alias("n")), "p9-sizes")
    histograms: dict[int, dict[int, int]] = defaultdict(dict)
    for r in by_share.groupBy("budget_id", "tokens").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows a budget
        histograms[r.budget_id][r.tokens] = r.n
    layout = [(b, *place) for b, c in budgets for place in places(plan(histograms[b], c))]
    before = by_share.select("budget_id", "tokens", "share", (F.sum("n").over(Window.partitionBy("budget_id", "tokens").orderBy("share")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("budget_id", "tokens", "share").orderBy(key, "piece_no")) - 1
    ranked = parts.withColumn("in_share", rank).join(before, ["budget_id", "tokens", "share"], "left").withColumn("rank", F.col("in_share") + F.col("before"))
    place = spark.createDataFrame(layout, "budget int, size int, lo long, hi long, first long, each int")
    # the layout has a few rows per size, so the capacities bound it too
    fit = (F.col("budget_id") == F.col("budget")) & (F.col("tokens") == F.col("size")) & F.col("rank").between(F.col("lo"), F.col("hi"))
    at = F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))
    return ranked.join(F.broadcast(place), fit, "left").select("budget_id", key, "piece_no", "start", "tokens", F.coalesce(at, F.lit(1)).cast("long").alias("container_id"))


def packed(sizes: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """(key, piece_no, start, tokens, container_id) of one capacity; see :func:`packed_all`."""
    return packed_all(sizes, [(0, capacity)], key).drop("budget_id")


def _budgets(spark: SparkSession, sf_dir: str) -> list[tuple[int, str, int]]:
    """The rows of token_budgets, a table of fixed size."""
    rows = table(spark, sf_dir, "token_budgets").filter("capacity > 0 and tokenizer is not null").orderBy("budget_id").collect()
    return [(r.budget_id, r.tokenizer, r.capacity) for r in rows]


def pack_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(budget_id, doc_id, piece_no, start, tokens, container_id) for every budget; documents are encoded once per tokenizer."""
    by_name: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for budget, name, capacity in _budgets(spark, sf_dir):
        by_name[name].append((budget, capacity))
    out = None
    for name, budgets in by_name.items():
        one = packed_all(materialize(token_counts(table(spark, sf_dir, "documents"), name=name), "p9-tokens"), budgets)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "budget_id int, doc_id long, piece_no int, start long, tokens int, container_id long")
    return out


def p9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every piece of every document, for each token budget."""
    return pack_all(spark, sf_dir)


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per budget: containers used, the lower bound by volume, and the share of space left over."""
    caps = table(spark, sf_dir, "token_budgets").select("budget_id", "capacity")
    return (
        pack_all(spark, sf_dir)
        .groupBy("budget_id")
        .agg(F.max("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
        .join(F.broadcast(caps), "budget_id")  # the fixed table of budgets
        .select("budget_id", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("lower_bound"), (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("left_over"))
    )


QUERIES = {"p9_pack": p9_pack, "p9_fill": p9_fill}

"""Packing documents into containers of a fixed number of tokens."""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import col, fresh, staged
from .tokens import Vocabulary, count_tokens

#: Documents are dealt to parts, to be ranked within their length: at least so many, and one for every million documents.
LEAST_PARTS = 256
PART_ROWS = 1_000_000


Pattern = tuple[tuple[int, int], ...]  # (length, copies), longest first


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns of lengths and how many containers have each, for ``histogram`` (length -> number of items).

    Lengths go in from the longest to the shortest. Each goes to the emptiest patterns that have room, as many
    of their containers as there are items; a pattern of which only some containers take the length is split in two.
    What finds no room opens new containers. Works on the histogram alone. A length adds at most three patterns, and a
    pattern has at most sqrt(2 * capacity) different lengths, so the result is bounded by ``capacity``, whatever the counts.
    """
    # What is still free -> patterns with so much room, as [pattern, containers]; rooms: a heap of the negated keys.
    open_by_room: dict[int, list[list]] = defaultdict(list)
    rooms: list[int] = []
    done: list[tuple[Pattern, int]] = []

    def put(pattern: Pattern, containers: int, room: int) -> None:
        if room:
            if not open_by_room[room]:
                heapq.heappush(rooms, -room)
            open_by_room[room].append([pattern, containers])
        else:
            done.append((pattern, containers))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while rooms and not open_by_room[-rooms[0]]:
                heapq.heappop(rooms)
            room = -rooms[0] if rooms else 0
            if room < length:
                # One item opens a container and the next ones of its length find room there.
                most = capacity // length
                for copies, n in ((most, left // most), (left % most, 1)):
                    if copies and n:
                        put(((length, copies),), n, capacity - copies * length)
                break
            pattern, containers = open_by_room[room].pop()
            taken = min(left, containers)
            if containers > taken:
                open_by_room[room].append([pattern, containers - taken])
            more = (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern[-1][0] == length else (*pattern, (length, 1))
            put(more, taken, room - length)
            left -= taken
    done.extend((pattern, n) for held in open_by_room.values() for pattern, n in held)
    return done


def pack_documents(
    df: DataFrame, capacity: int, doc_id: str = "doc_id", text: str = "text", vocabulary: Vocabulary = Vocabulary(), size: str | None = None
) -> DataFrame:
    """Which container each document, or part of one, goes to.

    Sizes are tokens of ``vocabulary`` (or the column ``size``). A document within ``capacity`` is one piece. One beyond
    it, and only such a one, is split: full containers of its own, and a remainder that is packed like a document.
    Pieces are packed shortest-pack-first over their length histogram. The histogram (at most ``capacity`` rows) is all
    that reaches the driver, and the patterns made of it are all that goes back; documents meet patterns by their rank
    within their length. Ranks are counted in parts, so that a length shared by a third of all documents is spread
    like any other.

    Returns ``doc_id, piece_no, token_from, token_to, n_tokens, container_id``: piece ``piece_no`` of the document is its
    tokens [token_from, token_to). Container ids run from 0 without gaps.

    Defined cases: NULL and empty texts (or a NULL or negative ``size``) have no tokens: one row with n_tokens 0 and
    container_id NULL, as they take no room; repeated rows and equal ids are packed separately (``doc_id`` only orders
    equal lengths); an empty table gives no rows; other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = df.sparkSession
    tokens = count_tokens(col(text), vocabulary) if size is None else F.greatest(F.coalesce(col(size).cast("long"), F.lit(0)), F.lit(0))
    # Staged: texts are tokenized once, and the rows keep their numbers, which deal them to parts.
    docs = staged(df.select(col(doc_id).alias("id"), tokens.alias("n"), F.monotonically_increasing_id().alias("row")))
    n_parts = max(LEAST_PARTS, -(-docs.count() // PART_ROWS))
    docs = docs.select("id", "n", F.pmod(F.xxhash64("row"), F.lit(n_parts)).alias("part"))

    c = F.lit(capacity).cast("long")
    rest = docs.withColumn("len", F.when(F.col("n") <= c, F.col("n")).otherwise(F.col("n") % c))
    # Rank within the length: the counts of the parts before, plus the rank inside the part.
    parts = staged(rest.where("len > 0").groupBy("len", "part").agg(F.count("*").alias("n_part")))
    histogram = {r["len"]: r["n"] for r in parts.groupBy("len").agg(F.sum("n_part").alias("n")).collect()}
    before = Window.partitionBy("len").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("len", "part", F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("before"))
    ranked = rest.where("len > 0").withColumn("inside", F.row_number().over(Window.partitionBy("len", "part").orderBy("id")) - 1)
    # Both sides lie by (length, part) already, so they are merged, and the counts, which grow with the parts, are sent to no one.
    ranked = ranked.join(parts.hint("merge"), ["len", "part"]).withColumn("rank", F.col("before") + F.col("inside"))

    slots, first = defaultdict(list), 0
    upto: dict[int, int] = defaultdict(int)
    for pattern, n in shortest_pack_first(histogram, capacity):
        for length, copies in pattern:
            # From this rank on, the length's items go round these containers: copies times.
            slots[length].append((upto[length], first, n))
            upto[length] += copies * n
        first += n
    patterns = spark.createDataFrame(
        [(length, *map(list, zip(*s))) for length, s in slots.items()],
        "len long, starts array<long>, firsts array<long>, sizes array<long>",
    )
    placed = ranked.join(F.broadcast(patterns), "len")  # bounded by the capacity: 10 MB for 2,048 tokens
    # Starts are sorted: the slot of a rank is the last one that starts at or before it.
    placed = placed.withColumn("slot", F.size(F.filter("starts", lambda s: s <= F.col("rank"))))
    start, at, size_of = (F.element_at(c, F.col("slot")) for c in ("starts", "firsts", "sizes"))
    placed = placed.withColumn("container_id", at + F.pmod(F.col("rank") - start, size_of))

    name = fresh(doc_id, ["piece_no", "token_from", "token_to", "n_tokens", "container_id"])
    whole = F.col("n") - F.col("len")
    pieces = placed.select(
        F.col("id").alias(name), F.floor(whole / c).alias("piece_no"), whole.alias("token_from"), F.col("n").alias("token_to"),
        F.col("len").alias("n_tokens"), "container_id",
    )
    empty = docs.where("n = 0").select(
        F.col("id").alias(name), F.lit(0).cast("long").alias("piece_no"), F.lit(0).cast("long").alias("token_from"),
        F.lit(0).cast("long").alias("token_to"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("long").alias("container_id"),
    )

    # The full containers of split documents come behind the patterns'.
    split = rest.where(F.col("n") > c).withColumn("fulls", F.floor(F.col("n") / c))
    totals = split.groupBy("part").agg(F.sum("fulls").alias("fulls_part"))
    offsets = totals.select(
        "part", F.coalesce(F.sum("fulls_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )  # a row a part
    inside = F.sum("fulls").over(Window.partitionBy("part").orderBy("id", "n").rowsBetween(Window.unboundedPreceding, 0)) - F.col("fulls")
    split = split.withColumn("inside", inside).join(offsets, "part")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("fulls") - 1)).alias("k")
    split = split.select("id", F.col("before") + F.col("inside") + F.lit(first), k)
    full = split.toDF("id", "base", "k").select(
        F.col("id").alias(name), F.col("k").alias("piece_no"), (F.col("k") * c).alias("token_from"), ((F.col("k") + 1) * c).alias("token_to"),
        c.alias("n_tokens"), (F.col("base") + F.col("k")).alias("container_id"),
    )
    return pieces.unionByName(full).unionByName(empty)


def containers(packed: DataFrame, capacity: int, doc_id: str = "doc_id") -> DataFrame:
    """One row per container: ``container_id, n_pieces, used, free, docs`` (its documents in order of id; at most ``capacity`` of them)."""
    return packed.where(F.col("container_id").isNotNull()).groupBy("container_id").agg(
        F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("used"), (F.lit(capacity) - F.sum("n_tokens")).alias("free"),
        F.sort_array(F.collect_list(F.struct(col(doc_id), "piece_no"))).alias("docs"),
    )

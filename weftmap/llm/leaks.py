"""Finding passages of evaluation items in a corpus, exact or slightly edited."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import col, staged
from .visible import reader_bytes

#: Sizes of windows in words, and the word edits allowed in each: the shortest passage, and a longer one with an edit in five words.
PASSAGES = {12: 1, 20: 4}
#: An item's own size is the greatest of these that it has words for; an edit in five words is allowed.
ITEM_SIZES = {n: n // 5 for n in (40, 56, 80, 112, 160, 224, 320)}
#: The embedding's places that are sampled: this many times the window. The walk stands at a word for two steps on average.
STRETCH = 2
GRAM = 3
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base mod 2**64 and of its inverse, kept for later batches."""
    global _POWERS, _INVERSE
    if len(_POWERS) <= n:
        size = max(n + 1, 2 * len(_POWERS), 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("_POWERS", _BASE), ("_INVERSE", inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            globals()[name] = np.multiply.accumulate(p)
    return _POWERS, _INVERSE


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``hash, begin, end`` of the words of a byte buffer, words being runs of bytes above the space.

    A word's hash is its polynomial in an odd base, read off a running sum over the whole buffer.
    """
    is_word = buf > 32
    edge = np.diff(np.concatenate(([0], is_word.view(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    powers, inverse = _powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(buf.astype(np.uint64) * powers[: len(buf)], out=total[1:])
    return _mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64)), begin, end


@dataclass(frozen=True)
class Walks:
    """How windows are embedded and sampled: ``walks`` random walks, ``samples`` samplings of ``bits`` places of each."""

    walks: int = 4
    samples: int = 4
    bits: int = 6
    seed: int = 5

    def plan(self, size: int) -> list[list[np.ndarray]]:
        """For every walk, the sorted places that each of its samplings reads."""
        rnd = np.random.default_rng((self.seed, size))
        reach = STRETCH * size
        return [[np.sort(rnd.choice(reach, min(self.bits, reach), replace=False)) for _ in range(self.samples)] for _ in range(self.walks)]


@dataclass
class Texts:
    """The words of a batch of texts: their hashes, bytes, and the bounds of each word's text."""

    data: bytes
    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(texts: list[bytes]) -> Texts:
        data = b"\n".join(texts)
        buf = np.frombuffer(data, np.uint8)
        hashes, begin, end = word_hashes(buf) if len(buf) else (np.zeros(0, np.uint64), *np.zeros((2, 0), np.int64))
        owner = np.searchsorted(np.flatnonzero(buf == 10), begin)
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        return Texts(data, hashes, begin, end, owner, bounds[owner], bounds[owner + 1] if len(owner) else owner)

    def passage(self, first: int, last: int) -> str:
        return " ".join(self.data[self.begin[first] : self.end[last - 1]].decode().split())


def signatures(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, plan: list[list[np.ndarray]], size: int) -> np.ndarray:
    """[repetition, window]: the signatures of the windows words[start:end].

    Each walk is one random CGK embedding, over words as symbols: step j writes the symbol under the pointer and moves on if the
    symbol's random bit for step j is set, so that few edits leave most of the embedding's places equal. All windows take a step
    together. A signature combines the symbols at the sampled places; it is 64 bits with the repetition and the window size mixed in.
    """
    out = []
    for w, samplings in enumerate(plan):
        moves = _mix(words ^ np.uint64((w + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)))
        at = starts.copy()
        sums = [np.full(len(starts), np.uint64((w * len(samplings) + z + 1 + 1000 * size) * 0x9E3779B97F4A7C15 & (2**64 - 1))) for z in range(len(samplings))]
        wanted = [set(p.tolist()) for p in samplings]
        for j in range(1 + max(int(p[-1]) for p in samplings)):
            off = at >= ends
            here = np.minimum(at, len(words) - 1)
            readers = [z for z, p in enumerate(wanted) if j in p]
            if readers:
                symbol = np.where(off, np.uint64(7), words[here])
                factor = np.uint64(_mix(np.array([j + 1], np.uint64))[0] | np.uint64(1))
                for z in readers:
                    sums[z] += symbol * factor
            at += ((moves[here] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64) * ~off
        out += [_mix(s) for s in sums]
    return np.array(out)


def _grams(t: Texts) -> np.ndarray:
    """A hash of every three consecutive words of a text, by the place of the first; 0 where the text ends before."""
    if len(t.hashes) < GRAM:
        return np.zeros(len(t.hashes), np.uint64)
    h = t.hashes
    grams = _mix(h[:-2] * np.uint64(9) + h[1:-1] * np.uint64(3) + h[2:])
    return np.append(np.where(t.owner[:-2] == t.owner[2:], grams, np.uint64(0)), np.zeros(2, np.uint64))


def _starts(t: Texts, size: int, edits: int, known: np.ndarray | None) -> np.ndarray:
    """Where windows of ``size`` words begin; at the end of a text they may have ``edits`` words less.

    ``known`` tells of every word whether a gram of the items begins there. Each edit of an item's window breaks up to three of its grams,
    and the others stand in the first ``size + edits`` words in their order: windows with fewer known ones are no match, and left out.
    """
    at = np.arange(len(t.hashes))
    fits = t.high - at >= size - edits
    least = size - GRAM + 1 - GRAM * edits
    if known is not None and least > 0:
        upto = np.concatenate(([0], np.cumsum(known)))
        fits &= upto[np.minimum(at + size + edits, t.high)] - upto[:-1] >= least
    return np.flatnonzero(fits)


def item_sizes(words: int, passages: Mapping[int, int], sizes: Mapping[int, int]) -> dict[int, int]:
    """Window sizes of an item with so many words, with the edits allowed: all of ``passages`` that fit, and its own size."""
    own = max((n for n in sizes if n <= words), default=None)
    return {n: e for n, e in passages.items() if n <= words} | ({own: sizes[own]} if own else {})


def _rows(x: np.ndarray, y: np.ndarray, free: bool) -> np.ndarray:
    """For each row, the edit distances of all of y to x's beginnings (to what ends there, if ``free``): the last line of the usual table."""
    ramp = np.arange(x.shape[1] + 1, dtype=np.int16)
    row = np.repeat((ramp * (not free))[None, :], len(x), axis=0)
    for i in range(y.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, :-1] + (x != y[:, i : i + 1]), row[:, 1:] + 1, out=new[:, 1:])
        # Words of x left over: the running minimum of what lies to the left, one more for every place.
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
    return row


def _least(distance: np.ndarray, allowed: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """The place of each row's least distance among the allowed ones, on a tie the nearest to ``middle``, then the first."""
    off = np.abs(np.arange(distance.shape[1])[None, :] - middle[:, None])
    return np.argmin(np.where(allowed, distance.astype(np.int64) * 4096 + off, np.iinfo(np.int64).max), axis=1)


def nearest_spans(words: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, y: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``distance, first, last``: for each row of y, the span of words[low:high] with the least word edit distance to it, from ``edits`` words before ``start`` on to
    ``2 * edits`` words behind its window. Its end is sought first, the nearest to the window's on a tie, then its beginning."""
    size = y.shape[1]
    left, right = np.maximum(start - edits, low), np.minimum(start + size + 2 * edits, high)
    places = left[:, None] + np.arange(size + 3 * edits)
    x = np.where(places < right[:, None], words[np.minimum(places, len(words) - 1)], np.uint64(0))
    there = np.arange(x.shape[1] + 1)[None, :] <= (right - left)[:, None]
    distance = _rows(x, y, True)
    end = _least(distance, there, start + size - left)
    last = left + end
    back = last[:, None] - 1 - np.arange(size + 3 * edits)
    x = np.where(back >= left[:, None], words[np.maximum(back, 0)], np.uint64(0))
    there = np.arange(x.shape[1] + 1)[None, :] <= end[:, None]
    behind = _rows(x, y[:, ::-1], False)
    n = _least(behind, there, np.full(len(y), size))
    return distance[np.arange(len(y)), end], last - n, last


def verified(words: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, y: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`nearest_spans`; windows that are equal as they stand need no table."""
    size = y.shape[1]
    places = start[:, None] + np.arange(size)
    equal = (start + size <= high) & (words[np.minimum(places, len(words) - 1)] == y).all(axis=1)
    distance, first, last = np.where(equal, 0, edits + 1), start.copy(), start + size
    more = np.flatnonzero(~equal) if edits else np.zeros(0, np.int64)
    for k in range(0, len(more), 4096):
        m = more[k : k + 4096]
        # All but ``edits`` words of the item's window must stand in the text, at most so far from their place.
        there = np.zeros((len(m), size), bool)
        for off in range(-2 * edits, 4 * edits + 1):
            at = places[m] + off
            there |= (words[np.clip(at, 0, len(words) - 1)] == y[m]) & (at >= low[m, None]) & (at < high[m, None])
        m = m[there.sum(axis=1) >= size - edits]
        distance[m], first[m], last[m] = nearest_spans(words, low[m], high[m], start[m], y[m], edits)
    return distance, first, last


@dataclass(frozen=True)
class Known:
    """The items' words and windows, small enough to be sent to all tasks."""

    words: np.ndarray  # of all items, one behind the other
    item: np.ndarray  # of each window
    size: np.ndarray
    at: np.ndarray  # its first word in its item
    place: np.ndarray  # and in ``words``
    sigs: np.ndarray  # sorted
    window: np.ndarray  # of each signature


def _match(ids, texts: list[bytes], sizes: Mapping[int, int], walks: Walks, keep, known: Known) -> Iterator[pd.DataFrame]:
    """The best verified match of each document and item."""
    t = Texts.of(texts)
    grams = keep(_grams(t))
    found = []
    for size, edits in sizes.items():
        starts = _starts(t, size, edits, grams)
        if not len(starts):
            continue
        pairs = []
        for sig in signatures(t.hashes, starts, np.minimum(starts + size, t.high[starts]), walks.plan(size), size):
            at = np.flatnonzero(keep(sig))
            low, high = (np.searchsorted(known.sigs, sig[at], side) for side in ("left", "right"))
            n = high - low
            if n.sum():
                place = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                pairs.append((np.repeat(starts[at], n) << 32) | known.window[place])
        if pairs:
            pairs = np.unique(np.concatenate(pairs))  # a pair found by several repetitions is verified once
            pairs = pairs[known.size[pairs & 0xFFFFFFFF] == size]
            start, window = pairs >> 32, pairs & 0xFFFFFFFF
            found.append(pd.DataFrame({"doc": t.owner[start], "item": known.item[window], "size": size, "start": start, "window": window}))
    if not found:
        return
    rows = pd.concat(found, ignore_index=True)
    rows["edits"], rows["first"], rows["last"] = -1, 0, 0
    equal = np.zeros(len(rows), bool)
    for size in sizes:
        m = np.flatnonzero(rows["size"].to_numpy() == size)
        for k in range(0, len(m), 1 << 16):
            p = m[k : k + (1 << 16)]
            start, window = rows["start"].to_numpy()[p], rows["window"].to_numpy()[p]
            x = t.hashes[np.minimum(start[:, None] + np.arange(size), len(t.hashes) - 1)]
            equal[p] = (start + size <= t.high[start]) & (x == known.words[known.place[window][:, None] + np.arange(size)]).all(axis=1)
    # An unedited passage is best; the other windows of its document and item need no table.
    settled = pd.MultiIndex.from_frame(rows.loc[equal, ["doc", "item"]].drop_duplicates())
    open_ = ~pd.MultiIndex.from_frame(rows[["doc", "item"]]).isin(settled)
    best = [rows[equal].assign(edits=0, first=rows["start"][equal], last=(rows["start"] + rows["size"])[equal])]
    for size in sorted(sizes, reverse=True):
        more = rows[open_ & (rows["size"].to_numpy() == size)]
        if len(more):
            more = more[~pd.MultiIndex.from_frame(more[["doc", "item"]]).isin(settled)]
        if not len(more):
            continue
        start, window = more["start"].to_numpy(), more["window"].to_numpy()
        y = known.words[known.place[window][:, None] + np.arange(size)]
        edits, first, last = verified(t.hashes, t.low[start], t.high[start], start, y, sizes[size])
        more = more.assign(edits=edits, first=first, last=last)
        more = more[edits <= sizes[size]]
        best.append(more)
        settled = settled.append(pd.MultiIndex.from_frame(more[["doc", "item"]].drop_duplicates()))  # a longer passage is better
    rows = pd.concat(best)
    rows = rows.assign(edited=rows["edits"] > 0, shorter=-rows["size"], at=known.at[rows["window"].to_numpy()])
    rows = rows.sort_values(["doc", "item", "edited", "shorter", "edits", "start", "at"]).drop_duplicates(["doc", "item"])
    if len(rows):
        yield pd.DataFrame({
            "doc": ids[rows["doc"].to_numpy()], "item": rows["item"].to_numpy(), "size": rows["size"].to_numpy(), "edits": rows["edits"].to_numpy(),
            "start": (rows["start"] - t.low[rows["start"].to_numpy()]).to_numpy(), "at": rows["at"].to_numpy(),
            "passage": [t.passage(a, b) for a, b in zip(rows["first"], rows["last"])],
        })


def _item_rows(ids, texts: list[bytes], passages, own_sizes, walks: Walks) -> Iterator[pd.DataFrame]:
    """One row per item: its words and grams, and of its windows the sizes, places and signatures, one window's behind the other's."""
    t = Texts.of(texts)
    bounds = np.searchsorted(t.owner, np.arange(len(texts) + 1))
    grams = _grams(t).view(np.int64)
    held: dict[int, list] = {k: [] for k in range(len(texts))}
    for size in {**passages, **own_sizes}:
        mine = [k for k in held if size in item_sizes(bounds[k + 1] - bounds[k], passages, own_sizes)]
        starts = [np.arange(bounds[k], bounds[k + 1] - size + 1) for k in mine]
        if mine:  # the windows of all items in one go
            at = np.concatenate(starts)
            sigs = signatures(t.hashes, at, at + size, walks.plan(size), size).T.view(np.int64)
            for k, s, x in zip(mine, starts, np.split(sigs, np.cumsum([len(s) for s in starts])[:-1])):
                held[k].append((np.full(len(s), size), s - bounds[k], x.ravel()))
    rows = [
        (ids[k], t.hashes[a:b].view(np.int64), grams[a : b - GRAM + 1], *map(np.concatenate, zip(*held[k])))
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if held[k]
    ]
    yield pd.DataFrame(rows, columns=["item", "words", "grams", "size", "at", "sigs"])


def _hits(ids, texts: list[bytes], sizes: Mapping[int, int], walks: Walks, keep) -> Iterator[pd.DataFrame]:
    """The windows that have a signature of the items: with all words that verifying may read, ``lead`` of them before the window."""
    t = Texts.of(texts)
    grams = keep(_grams(t))
    for size, edits in sizes.items():
        starts = _starts(t, size, edits, grams)
        if not len(starts):
            continue
        sigs = signatures(t.hashes, starts, np.minimum(starts + size, t.high[starts]), walks.plan(size), size)
        hit = np.array([keep(s) for s in sigs])
        at = np.flatnonzero(hit.any(axis=0))
        if len(at):
            s = starts[at]
            a, b = np.maximum(s - edits, t.low[s]), np.minimum(s + size + 2 * edits, t.high[s])
            yield pd.DataFrame({
                "doc": ids[t.owner[s]], "size": size, "start": s - t.low[s], "lead": s - a, "around": [t.passage(x, y) for x, y in zip(a, b)],
                "sigs": [sigs[hit[:, n], n].view(np.int64).tolist() for n in at],
            })


def _batches(pdfs: Iterator[pd.DataFrame], work, chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """``work(ids, texts)`` over bounded pieces of the texts; one text is never split."""
    for pdf in pdfs:
        ids, texts, size, held = pdf["id"].to_numpy(), [], 0, 0
        for i, s in enumerate(pdf["text"]):
            texts.append(reader_bytes(s))
            size += len(texts[-1])
            if size > chars or i + 1 == len(pdf):
                yield from work(ids[held : i + 1], texts)
                held, texts, size = i + 1, [], 0


def _slots(x: np.ndarray, log_slots: int) -> np.ndarray:
    return (x >> np.uint64(64 - log_slots)).astype(np.int64)


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
    passages: Mapping[int, int] = PASSAGES, own_sizes: Mapping[int, int] = ITEM_SIZES, walks: Walks = Walks(), log_slots: int = 26, send_rows: int = 2_000_000,
    heavy: int = 100_000, salts: int = 64,
) -> DataFrame:
    """Documents that hold a passage of an item, whole or in part, edited or not: ``doc_id, item_id, edits, passage``.

    Compared are windows of consecutive words, as a reader sees the page (:mod:`.visible`). An item has windows of the sizes in ``passages``, and of its own
    size, the greatest of ``own_sizes`` that it has words for; both tell how many word edits (changed, inserted, deleted) are allowed. Every window gets
    ``walks.walks * walks.samples`` signatures: a CGK random walk embeds it so that few edits change few places, and each signature samples ``walks.bits``
    places (:func:`signatures`). Equal windows have equal signatures, so unedited passages of the least size are found with certainty; the recall of edited ones
    is set by the number of repetitions. A document's window is embedded only if enough three-word runs of it are in any item to allow for a match
    (:func:`_starts`; this loses none). Candidates with an equal signature are verified exactly: the best span of words around the document's
    window must have a word edit distance within the size's number of edits. One row per document and item: an unedited passage before edited ones, the longer
    before the shorter, then the fewest edits, then the first place in the document and in the item.

    Sent to all tasks is a bitmap of the items' signatures and three-word runs, 2 ** ``log_slots`` bits (8 MB) whatever the number of items; it has no false
    negatives. Up to ``send_rows`` signatures of items (counted first; 2,000,000 are some 30 MB) the items' words and windows are sent as well, and candidates are
    verified in the task that read the document. Beyond that, windows that hit the bitmap leave the scan and meet the items' windows in a join on the signature;
    signatures with ``heavy`` windows or more are dealt to ``salts`` parts. Both ways have the same candidates, verify them by the same function and rank them alike, so they
    return the same rows. Words are compared by their 64-bit hashes.

    Defined cases: NULL, empty or short texts have no window and match nothing; texts of any length are read whole; repeated documents and items
    have the rows of one; items that share a passage each have their own; rows with a NULL id are left out; empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    passages, own_sizes = dict(passages), dict(own_sizes)
    item_rows = items.select(col(item_id).cast("long").alias("id"), col(text).alias("text")).where(F.col("text").isNotNull() & F.col("id").isNotNull()).distinct()
    known_items = staged(item_rows.mapInPandas(
        lambda it: _batches(it, lambda i, t: _item_rows(i, t, passages, own_sizes, walks)),
        "item long, words array<long>, grams array<long>, size array<int>, at array<int>, sigs array<long>",
    ))
    all_sizes = passages | own_sizes
    sizes = {r[0]: all_sizes[r[0]] for r in known_items.select(F.explode("size").alias("size")).distinct().orderBy("size").collect()}  # as many as there are sizes

    marks = known_items.select(F.explode("sigs").alias("x")).unionByName(known_items.select(F.explode("grams").alias("x")))
    slot = F.shiftrightunsigned("x", 64 - log_slots)
    filled = marks.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    bitmap = np.zeros((1 << log_slots) // 8 + 4096, np.uint8)
    for b, held in filled.collect():  # at most 2 ** log_slots / 32768 rows of 4 KB
        if b > 0:
            bitmap[(b - 1) * 4096 : b * 4096] = np.frombuffer(held, np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)

    def keep(x: np.ndarray) -> np.ndarray:
        # bitmap_bucket_number puts n > 0 at 1 + (n - 1) // 32768 and its bit at (n - 1) % 32768; 0 is bucket 0, bit 0.
        n = _slots(x, log_slots)
        at = np.where(n > 0, n - 1, 0)
        hit = (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (hit == 1) | (n == 0)

    doc_rows = docs.select(col(doc_id).cast("long").alias("id"), col(text).alias("text")).where(F.col("text").isNotNull() & F.col("id").isNotNull())
    if known_items.agg(F.coalesce(F.sum(F.size("sigs")), F.lit(0))).first()[0] <= send_rows:
        known = spark.sparkContext.broadcast(_known(known_items))
        found = doc_rows.mapInPandas(
            lambda it: _batches(it, lambda i, t: _match(i, t, sizes, walks, keep, known.value)),
            "doc long, item long, size int, edits int, start int, at int, passage string",
        )
        return _best(found, doc_id, item_id)

    hits = staged(doc_rows.mapInPandas(
        lambda it: _batches(it, lambda i, t: _hits(i, t, sizes, walks, keep)), "doc long, size int, start int, lead int, around string, sigs array<long>"
    ))
    by_sig = hits.select("doc", "size", "start", F.explode("sigs").alias("sig"))
    many = by_sig.groupBy("sig").count().where(F.col("count") >= heavy).select("sig", F.lit(salts).alias("parts"))
    mine = by_sig.join(many, "sig", "left").withColumn("salt", F.pmod(F.xxhash64("doc", "start"), F.coalesce("parts", F.lit(1)))).drop("parts")
    each = walks.walks * walks.samples
    theirs = known_items.select("item", "sigs", F.posexplode(F.arrays_zip("size", "at")).alias("n", "w"))
    theirs = theirs.select("item", "w.size", "w.at", F.explode(F.slice("sigs", F.col("n") * each + 1, F.lit(each))).alias("sig")).join(many, "sig", "left")
    theirs = theirs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), (F.coalesce("parts", F.lit(1)) - 1).cast("long")))).drop("parts")
    pairs = mine.join(theirs, ["sig", "size", "salt"]).select("doc", "item", "size", "start", "at").distinct()
    pairs = pairs.join(hits.select("doc", "size", "start", "lead", "around").distinct(), ["doc", "size", "start"])
    words = known_items.select("item", "words").distinct()
    pairs = pairs.join(words, "item").withColumn("words", F.slice("words", F.col("at") + 1, F.col("size")))
    pairs = pairs.withColumn("near", _near(sizes)("size", "lead", "around", "words")).where("near.edits >= 0")
    return _best(pairs.select("doc", "item", "size", "near.edits", "start", "at", "near.passage"), doc_id, item_id)


def _best(found: DataFrame, doc_id: str, item_id: str) -> DataFrame:
    rank = F.struct((F.col("edits") > 0).alias("edited"), (-F.col("size")).alias("shorter"), "edits", "start", "at", "passage")
    best = found.groupBy("doc", "item").agg(F.min(rank).alias("best"))
    return best.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), F.col("best.edits").alias("edits"), F.col("best.passage").alias("passage"))


def _known(known_items: DataFrame) -> Known:
    rows = known_items.toPandas().drop_duplicates("item")
    if not len(rows):
        return Known(*(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64, np.uint64, np.int64)))
    first = np.concatenate(([0], np.cumsum(rows["words"].map(len))[:-1]))
    flat = lambda c: np.concatenate(rows[c].to_list()).astype(np.int64)
    n = rows["size"].map(len)
    at, sigs = flat("at"), flat("sigs").view(np.uint64)
    order = np.argsort(sigs, kind="stable")
    window = np.repeat(np.arange(len(at)), len(sigs) // len(at))
    return Known(flat("words").view(np.uint64), np.repeat(rows["item"].to_numpy(), n), flat("size"), at, np.repeat(first, n) + at, sigs[order], window[order])


def _near(sizes: Mapping[int, int]):
    """Edits (-1 beyond those allowed) and passage of joined windows, by the function that the scan uses."""

    def spans(size: pd.Series, lead: pd.Series, around: pd.Series, words: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"edits": np.full(len(size), -1), "passage": pd.Series([None] * len(size), dtype=object)})
        if len(size):
            t = Texts.of([s.encode() for s in around])
            bounds = np.searchsorted(t.owner, np.arange(len(size) + 1))
            for n, allowed in sizes.items():
                m = np.flatnonzero(size.to_numpy() == n)
                if len(m):
                    y = np.array([words.iloc[k] for k in m], np.int64).view(np.uint64)
                    edits, first, last = verified(t.hashes, bounds[m], bounds[m + 1], bounds[m] + lead.to_numpy()[m], y, allowed)
                    ok = np.flatnonzero(edits <= allowed)
                    out.loc[m[ok], "edits"] = edits[ok]
                    out.loc[m[ok], "passage"] = [t.passage(first[k], last[k]) for k in ok]
        return out

    return F.pandas_udf(spans, "edits int, passage string")

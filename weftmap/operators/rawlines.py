"""Parsing delimited lines into typed rows, with a reason for every line that fails."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import col

#: Fixed values of the pairs text format.
FIELDS = ("read_id", "chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2", "pair_type", "sam1", "sam2", "mapq1", "mapq2")
PAIR_TYPES = ("UU", "UR", "RU", "DD", "MM", "MU", "NM", "NN", "NU", "WW")
MAX_MAPQ = 60

TAB, QUOTE = 9, 34


def _take(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings buf[start:end], as one Arrow array."""
    sizes = ends - starts
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    where = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf[where])))


def index_lines(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The structural index of the lines buf[begin:end]: ``first, last, enclosed, n_fields, broken``.

    ``first`` and ``last`` ([line, field]) bound each field's bytes, outer quotes left out, and ``enclosed`` tells whether it had them; beyond the
    line's fields, or beyond ``width`` fields, they are 0. Masks over the whole buffer give the tabs and
    the quotes. A quote that opens a field is one behind a tab or a line's begin. Where a line has
    none, its tabs are its delimiters. In the others the prefix parity of the quotes tells inside from
    outside: the field that opens at a quote ends at the first following quote that makes the parity
    even again and has no quote right behind it (doubled quotes cancel out). Those lines advance field by
    field together, one vectorised step per field.
    """
    n = len(begin)
    first, last = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
    enclosed = np.zeros((n, width), bool)
    count, broken = np.zeros(n, np.int64), np.zeros(n, bool)
    tabs, quotes = np.flatnonzero(buf == TAB), np.flatnonzero(buf == QUOTE)

    before = np.where(quotes > 0, buf[np.maximum(quotes - 1, 0)], TAB) if len(buf) else quotes
    line_of = np.searchsorted(begin, quotes, "right") - 1
    opens = (before == TAB) | (quotes == begin[np.maximum(line_of, 0)]) if n else np.zeros(0, bool)
    quoted = np.zeros(n, bool)
    quoted[line_of[opens]] = True

    # Lines without a quoted field: the k-th delimiter is the k-th tab.
    low, high = np.searchsorted(tabs, begin), np.searchsorted(tabs, end)
    plain = np.flatnonzero(~quoted)
    count[plain] = high[plain] - low[plain] + 1
    for k in range(width):
        at = plain[count[plain] > k]
        first[at, k] = begin[at] if k == 0 else tabs[low[at] + k - 1] + 1
        is_last = count[at] == k + 1
        last[at, k] = np.where(is_last, end[at], tabs[np.minimum(low[at] + k, max(len(tabs) - 1, 0))] if len(tabs) else end[at])

    # Lines with quoted fields.
    parity = (np.arange(len(quotes)) + 1) & 1  # of the quotes up to and with this one
    after = np.where(quotes + 1 < len(buf), buf[np.minimum(quotes + 1, max(len(buf) - 1, 0))], 0) if len(buf) else quotes
    follows = line_of == np.append(line_of[1:], -1)  # the quote behind belongs to the same line
    closes = ~((after == QUOTE) & follows & (np.append(quotes[1:], -1) == quotes + 1))
    by_parity = [quotes[closes & (parity == p)] for p in (0, 1)]
    live = np.flatnonzero(quoted)
    pos = begin[live].copy()
    while len(live):
        stop = end[live]
        starts_quoted = (pos < stop) & (buf[np.minimum(pos, len(buf) - 1)] == QUOTE)
        i = np.searchsorted(tabs, pos)
        tab = np.where(i < len(tabs), tabs[np.minimum(i, max(len(tabs) - 1, 0))] if len(tabs) else stop, stop)
        a, b = pos.copy(), np.minimum(tab, stop)
        bad = np.zeros(len(live), bool)
        q = np.flatnonzero(starts_quoted)
        if len(q):
            base = np.searchsorted(quotes, pos[q])  # quotes before the opening one
            close = np.full(len(q), -1)
            for p in (0, 1):
                mine = np.flatnonzero((base & 1) == p)
                ends_at = by_parity[p]
                j = np.searchsorted(ends_at, pos[q[mine]], "right")
                ok = j < len(ends_at)
                close[mine[ok]] = ends_at[j[ok]]
            inside = (close >= 0) & (close < stop[q])
            nxt = close + 1
            fits = inside & ((nxt == stop[q]) | ((nxt < stop[q]) & (buf[np.clip(nxt, 0, len(buf) - 1)] == TAB)))
            bad[q] = ~fits
            a[q], b[q] = pos[q] + 1, np.where(fits, close, pos[q] + 1)
            tab = tab.copy()
            tab[q] = np.where(fits, nxt, stop[q])
        k = count[live]
        keep = (k < width) & ~bad
        first[live[keep], k[keep]], last[live[keep], k[keep]] = a[keep], b[keep]
        enclosed[live[keep], k[keep]] = starts_quoted[keep]
        count[live] += 1
        broken[live[bad]] = True
        go = ~bad & (tab < stop)
        live, pos = live[go], tab[go] + 1
    return first, last, enclosed, count, broken


def _number(text: pa.Array, high: int) -> pa.Array:
    """ASCII digits only -> LONG (leading zeros allowed), NULL for anything else or beyond ``high``."""
    digits = pc.match_substring_regex(text, r"\A[0-9]+\z")
    short = pc.utf8_ltrim(text, "0")
    fits = pc.and_(digits, pc.less_equal(pc.utf8_length(short), len(str(high))))
    value = pc.cast(pc.if_else(fits, pc.if_else(pc.equal(short, ""), "0", short), pa.scalar(None, pa.large_string())), pa.int64())
    return pc.if_else(pc.less_equal(value, high), value, pa.scalar(None, pa.int64()))


SCHEMA = (
    "__id long, read_id string, chrom1 string, pos1 long, chrom2 string, pos2 long, strand1 string, strand2 string, "
    "pair_type string, sam1 string, sam2 string, mapq1 int, mapq2 int, reason string"
)


def parse_batch(ids: pa.Array, lines: pa.Array) -> pa.RecordBatch:
    """One Arrow batch of lines -> typed fields, and the reason where a line fails (chromosomes are not looked at here)."""
    lines = pc.fill_null(lines, "").cast(pa.large_string())
    if lines.offset:
        lines = pa.concat_arrays([lines])
    _, offsets, data = lines.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(lines) + 1) if len(lines) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8, bounds[-1]) if data is not None and bounds[-1] else np.zeros(0, np.uint8)
    width = len(FIELDS)
    first, last, enclosed, count, broken = index_lines(buf, bounds[:-1], bounds[1:], width)

    whole = ~broken & (count == width)
    f = {}
    for k, name in enumerate(FIELDS):
        a, b = np.where(whole, first[:, k], 0), np.where(whole, last[:, k], 0)
        f[name] = pc.if_else(pa.array(whole), _take(buf, a, b), pa.scalar(None, pa.large_string()))
        quoted = whole & enclosed[:, k]
        if quoted.any():  # of quoted fields only, "" stands for one "
            f[name] = pc.if_else(pa.array(quoted), pc.replace_substring(f[name], '""', '"'), f[name])

    big = np.iinfo(np.int64).max // 10
    pos = {n: _number(f[n], big) for n in ("pos1", "pos2")}
    mapq = {n: _number(f[n], MAX_MAPQ) for n in ("mapq1", "mapq2")}
    good = pc.and_(pc.is_valid(mapq["mapq1"]), pc.is_valid(mapq["mapq2"]))
    for n in ("pos1", "pos2"):
        good = pc.and_(good, pc.or_(pc.equal(f[n], "."), pc.greater_equal(pc.fill_null(pos[n], 0), 1)))
    for n in ("strand1", "strand2"):
        good = pc.and_(good, pc.is_in(f[n], pa.array(["+", "-"], pa.large_string())))
    good = pc.fill_null(pc.and_(good, pc.is_in(f["pair_type"], pa.array(PAIR_TYPES, pa.large_string()))), False)
    reason = np.where(broken, "quoting", np.where(count != width, "column_count", np.where(good.to_numpy(False), "", "bad_value")))
    reason = pa.array(np.where(reason == "", None, reason), pa.string())
    cols = [f[n].cast(pa.string()) if n not in pos and n not in mapq else (pos[n] if n in pos else mapq[n].cast(pa.int32())) for n in FIELDS]
    return pa.RecordBatch.from_arrays([ids, *cols, reason], ["__id", *FIELDS, "reason"])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield parse_batch(batch.column(0), batch.column(1))


def parse_pairs_lines(lines: DataFrame, chrom_sizes: DataFrame, line_id: str = "line_id", line: str = "line") -> DataFrame:
    """Records of text pairs lines: ``line_id``, the typed pairs columns and ``reason`` (NULL where the record is valid).

    ``reason`` is the first that applies: ``quoting`` (a quoted field that never ends, or is not followed by a tab or
    the line's end), ``column_count`` (not 12 fields), ``bad_value`` (a chromosome neither in ``chrom_sizes`` nor ``!``;
    a position neither ``.`` nor digits from 1 to its chromosome's size; a strand, pair type or mapq outside its values).
    A rejected row of 12 fields keeps those of its fields that could be read, other rejected rows have NULLs.

    Batches of lines are indexed with numpy inside the tasks (:func:`index_lines`), chromosomes are checked by joins
    that Spark may broadcast or shuffle. One narrow stage otherwise: nothing depends on a neighbouring line.

    Defined cases: a line that starts with ``#`` is a header and gives no row; an empty line is a record of one empty
    field (``column_count``); a NULL line is treated as an empty one; ``.`` is a NULL position; repeated lines give
    repeated rows; a chromosome listed twice in ``chrom_sizes`` counts with its greatest size; a very long line is
    one record like any other; an empty table gives no rows.
    """
    records = lines.select(col(line_id).cast("long").alias("__id"), col(line).alias("line")).where(
        F.coalesce(~F.col("line").startswith("#"), F.lit(True))
    )
    parsed = records.mapInArrow(_parse, SCHEMA)
    sizes = chrom_sizes.where(F.col("chrom").isNotNull()).groupBy("chrom").agg(F.max("size").alias("size"))
    for k in (1, 2):
        parsed = parsed.join(sizes.select(F.col("chrom").alias(f"chrom{k}"), F.col("size").alias(f"__size{k}")), f"chrom{k}", "left")

    def fits(k: int):
        chrom, pos, size = F.col(f"chrom{k}"), F.col(f"pos{k}"), F.col(f"__size{k}")
        return (size.isNotNull() & (pos.isNull() | (pos <= size))) | ((chrom == "!") & size.isNull() & pos.isNull())

    reason = F.coalesce("reason", F.when(F.coalesce(fits(1) & fits(2), F.lit(False)), F.lit(None).cast("string")).otherwise("bad_value"))
    return parsed.select(F.col("__id").alias(line_id), *FIELDS, reason.alias("reason"))


def valid_records(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).drop("reason")


def rejects(parsed: DataFrame, line_id: str = "line_id") -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select(line_id, "reason")

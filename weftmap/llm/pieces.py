"""Cutting long documents into overlapping pieces at the page's own boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import col, fresh
from .tokens import Vocabulary, _well_formed, encode, token_ends

#: Kinds of boundary, best first; ``hard`` cuts inside a word, ``end`` is the text's end.
KINDS = ("section", "paragraph", "line", "sentence", "word", "hard", "end")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# First bytes of non-ASCII characters that may be white space (NEL and NBSP; Ogham; U+2000..; U+3000): no boundary is seen before them.
_DOUBTFUL = np.zeros(256, bool)
_DOUBTFUL[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_INK = ~_SPACE & ~_DOUBTFUL
_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord("!"), ord("?"), ord(";")]] = True


def boundaries(buf: np.ndarray) -> list[np.ndarray]:
    """Sorted byte offsets at which a piece may begin, for each kind from section to word; each kind includes the better ones.

    All are places where the tokenizer's pattern begins a new match whatever comes before or after, so that cutting
    there leaves the tokens as they are: behind a line break and before visible text, or before the single
    space that leads a word. (Ideographic full stops end a sentence when a letter's bytes follow.)
    """
    n = len(buf)
    if n < 2:
        return [np.zeros(0, np.int64)] * 5
    prev, here = buf[:-1], buf[1:]
    ink = _INK[here]
    line = np.flatnonzero((prev == 10) & ink) + 1
    if len(line):
        # The character before the break, carriage returns skipped, is a break too: a blank line.
        back = line - 2
        back = np.where((back >= 0) & (buf[np.maximum(back, 0)] == 13), back - 1, back)
        blank = (back >= 0) & (buf[np.maximum(back, 0)] == 10)
        heading = (buf[line] == ord("=")) & (buf[np.minimum(line + 1, n - 1)] == ord("="))
    else:
        blank = heading = np.zeros(0, bool)
    # A space before ink; the space itself begins the next piece.
    lead = np.flatnonzero((prev == 32) & ink)
    lead = lead[lead > 0]
    stop = lead[_STOP[buf[lead - 1]]]
    wide = np.flatnonzero((buf[:-3] == 0xE3) & (buf[1:-2] == 0x80) & (buf[2:-1] == 0x82)) + 3 if n > 3 else np.zeros(0, np.int64)
    wide = wide[(buf[wide] >= 0xE4) & (buf[wide] <= 0xE9)] if len(wide) else wide  # a CJK ideograph
    section = line[heading]
    paragraph = np.union1d(section, line[blank])
    sentence = np.union1d(np.union1d(line, stop), wide)
    return [section, paragraph, line, sentence, np.union1d(sentence, lead)]


def _last_under(sorted_tokens: np.ndarray, low: int, high: int) -> int:
    """The greatest element in (low, high], -1 if there is none, by binary search."""
    i = int(np.searchsorted(sorted_tokens, high, "right")) - 1
    return int(sorted_tokens[i]) if i >= 0 and sorted_tokens[i] > low else -1


def cut(s: str, limit: int, overlap: int, vocabulary: Vocabulary, fill: float = 0.5) -> list[tuple[int, int, int, str]]:
    """Pieces of one text as (first byte, last byte, tokens, kind of the cut at its end).

    Prefix sums of the token lengths turn byte offsets into token offsets. From a piece's start, the last boundary
    within ``limit`` tokens is found by binary search, the best kind first; a section, paragraph, line or sentence
    counts only if the piece keeps ``fill`` of the limit; a word may be anywhere behind the overlap. Without one, the
    cut is hard, between two tokens that are not inside a character. The next piece starts exactly ``overlap`` tokens of the text
    back, or, where that is inside a character, at the character's begin (a character has 4 tokens at most).
    """
    data = s.encode("utf-8")
    ends = token_ends(s, vocabulary)
    n = len(ends)
    if n <= limit:
        return [(0, len(data), n, "end")]
    buf = np.frombuffer(data, np.uint8)
    starts = np.concatenate(([0], ends))  # starts[t]: the byte at which token t begins
    kinds = []
    for at in boundaries(buf):
        t = np.searchsorted(starts, at)
        kinds.append(t[starts[t] == at])
    words = kinds[-1]
    inside = np.zeros(n + 1, bool)
    inside[:-1] = (buf[starts[:-1]] & 0xC0) == 0x80
    chars = np.flatnonzero(~inside)  # tokens that begin at a character
    out, at, exact_start = [], 0, True
    while True:
        stop, last = at + limit, out[-1][1] if out else 0
        kind = "end"
        # Each piece must end behind the piece before, whatever the overlap was rounded to.
        floor = int(np.searchsorted(starts, last)) if out else at
        end = n if n <= stop else -1
        if end < 0:
            for name, tokens in zip(KINDS, kinds):
                low = max(floor, at + int(fill * limit)) if name != "word" else floor
                end = _last_under(tokens, low, stop)
                if end >= 0:
                    kind = name
                    break
        if end < 0:
            kind, end = "hard", _last_under(chars, floor, stop)
            if end < 0:  # a character of more tokens than the limit leaves: it stays whole
                end = int(chars[np.searchsorted(chars, max(floor, at), "right")])
        size = end - at
        if kind == "hard" or not exact_start:
            # Inside a word the piece alone may be tokenized otherwise: count it, and shorten it until it fits.
            size = len(encode(data[starts[at] : starts[end]].decode(), vocabulary))
            while size > limit:
                shorter = _last_under(words, floor, end - 1)
                if shorter < 0 or end - shorter > max(limit // 4, 1):
                    shorter = _last_under(chars, floor, end - 1)
                if shorter < 0:
                    break
                kind, end = "word" if shorter in words else "hard", shorter
                size = len(encode(data[starts[at] : starts[end]].decode(), vocabulary))
        out.append((int(starts[at]), int(starts[end]), size, kind))
        if end >= n:
            return out
        begin = _last_under(chars, at, end - overlap) if overlap else end
        exact_start = kind != "hard" if not overlap else bool(np.isin(begin, words))
        at = begin if begin > at else end


def split_documents(
    df: DataFrame, limit: int, overlap: int = 0, doc_id: str = "doc_id", text: str = "text", vocabulary: Vocabulary = Vocabulary()
) -> DataFrame:
    """Ordered pieces of at most ``limit`` tokens: ``doc_id, piece_no, n_pieces, start_char, end_char, n_tokens, cut, piece``.

    Pieces are cut at section headings, blank lines, line breaks, sentence ends or words, in that order of preference,
    and only inside a word where it has no boundary within the limit (:func:`cut`). Consecutive pieces share exactly ``overlap``
    tokens of the text, or up to 3 more where the place is inside a character; without overlap the pieces joined
    are the text. ``n_tokens`` is the number of tokens of the piece taken by itself. A document within the limit is one
    piece. ``cut`` tells the boundary at the piece's end. Works document by document in one stage, without a shuffle.

    Defined cases: NULL and empty texts have no pieces; a single character of more tokens than ``limit`` is a piece of
    its own beyond the limit (a character has 4 tokens at most); repeated rows give repeated pieces; a NULL id stays NULL; a lone surrogate counts and
    comes out as ``?``; an empty table gives no rows; other columns are ignored. ``overlap`` must be less than half of ``limit``.
    """
    if limit < 1 or overlap < 0 or 2 * overlap >= max(limit, 1):
        raise ValueError("limit must be at least 1, and overlap less than half of it")

    def pieces(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows: list[tuple] = []
            held = 0
            for i, s in zip(pdf["id"], pdf["text"]):
                s = _well_formed(s)
                data, cuts = s.encode("utf-8"), cut(s, limit, overlap, vocabulary)
                chars = None
                if len(data) != len(s):  # characters up to each byte
                    chars = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
                for k, (a, b, size, kind) in enumerate(cuts):
                    ca, cb = (a, b) if chars is None else (int(chars[a]), int(chars[b]))
                    rows.append((i, k, len(cuts), ca, cb, size, kind, s[ca:cb]))
                held += len(data)
                if held > 8_000_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    names = ["id", "piece_no", "n_pieces", "start_char", "end_char", "n_tokens", "cut", "piece"]
    # Ids travel as text: pandas would make floats of longs beside a NULL.
    rows = df.select(col(doc_id).cast("string").alias("id"), col(text).alias("text")).where(F.length("text") > 0)
    out = rows.mapInPandas(
        pieces, "id string, piece_no int, n_pieces int, start_char long, end_char long, n_tokens long, cut string, piece string"
    )
    kind = df.select(col(doc_id)).dtypes[0][1]
    return out.select(F.col("id").cast(kind).alias(fresh(doc_id, names[1:])), *names[1:])

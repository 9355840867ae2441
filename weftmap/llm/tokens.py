"""Token counts and offsets of public byte-level tokenizers, inside the tasks."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Longer runs of white space overflow the pattern matcher (from about a million characters on); they are merged without it.
MAX_BLANK = 100_000
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK = re.compile(f"[{_SPACES}]{{{MAX_BLANK},}}")


@dataclass(frozen=True)
class Vocabulary:
    """A rank file (one base64 token and its rank a line); every executor must see it under this path."""

    path: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    pattern: str = PATTERN


@functools.lru_cache(maxsize=4)
def load(vocabulary: Vocabulary):
    """The encoding and the byte length of every token; loaded once in a worker."""
    import tiktoken

    with open(vocabulary.path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encoding = tiktoken.Encoding("vocabulary", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return encoding, sizes


def _well_formed(s: str) -> str:
    """Lone surrogates cannot be written as UTF-8; they count as the replacement character."""
    return s if s.isascii() else s.encode("utf-8", "replace").decode()


def _tokens(encoding, s: str) -> list[int]:
    """The text's tokens.

    Of a run of white space the pattern takes all but the last character as one match (all of it at the text's end), and that match's merges do
    not depend on what stands around it: very long runs are merged by themselves, with the same tokens.
    """
    s = _well_formed(s)
    out, at = [], 0
    for m in _BLANK.finditer(s) if len(s) >= MAX_BLANK else ():
        stop = m.end() - (m.end() < len(s))
        out += encoding.encode_ordinary(s[at : m.start()]) + encoding._encode_single_piece(s[m.start() : stop].encode())
        at = stop
    return out + encoding.encode_ordinary(s[at:])


def encode(s: str, vocabulary: Vocabulary) -> np.ndarray:
    return np.array(_tokens(load(vocabulary)[0], s), np.int64)


def token_ends(s: str, vocabulary: Vocabulary) -> np.ndarray:
    """Prefix sums of the tokens' lengths: the UTF-8 offset at which each token ends."""
    _, sizes = load(vocabulary)
    return np.cumsum(sizes[encode(s, vocabulary)])


def count_tokens(text: Column, vocabulary: Vocabulary = Vocabulary()) -> Column:
    """Number of tokens; 0 for NULL and empty texts. The strings of special tokens are ordinary text."""

    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding, _ = load(vocabulary)
        for batch in batches:
            yield pd.Series([len(_tokens(encoding, s)) if s else 0 for s in batch], dtype="int64")

    return F.pandas_udf(counts, "long")(text)

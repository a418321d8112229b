"""Fill-in-middle: documents cut at token boundaries and rearranged around three sentinels.

A text is chunked where a rolling hash of its bytes says so, so that equal passages give equal chunks wherever they stand.
A chunk's boundary summary (token starts inside it, whether it begins and ends with a blank) is kept by the chunk's hash
together with the chunk, and used again only for equal content. Summaries of neighbours add up to the text's token count
and tell which chunk holds a cut; only that chunk is scanned for it.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.llm.common import bounded_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Per cent of the documents that are rearranged, and per cent of these that begin with the suffix.
RATE, SUFFIX_FIRST = 50, 80
RESULT = "text string, form string, n long, prefix_chars long, middle_chars long"

BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: A random number for each byte; the window of the rolling hash; a chunk ends where the hash's first bits are 0, about
#: every 2 KB, or at the most bytes.
GEAR = np.random.default_rng(SEED).integers(0, 1 << 32, 256, dtype=np.uint32)
WINDOW, BITS, MOST = 32, 11, 1 << 14
#: Bytes hashed at once, and bytes of chunks that a worker remembers.
BLOCK, REMEMBERED = 1 << 20, 1 << 25


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the ``WINDOW`` bytes that end at each byte: the sum of each one's number, shifted by its distance."""
    h, k = GEAR[data], 1
    while k < WINDOW:
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        k *= 2
    return h


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Where the chunks of a text's bytes end."""
    found = []
    for at in range(0, len(data), BLOCK):
        first = max(0, at - WINDOW + 1)
        h = rolling(data[first : at + BLOCK])[at - first :]
        found.append(at + 1 + np.flatnonzero(h >> np.uint32(32 - BITS) == 0))
    ends = np.unique(np.append(np.concatenate(found), len(data))) if found else np.zeros(0, np.int64)
    wide = np.flatnonzero(np.diff(ends, prepend=0) > MOST)
    if len(wide):
        starts = np.append(0, ends[:-1])
        ends = np.unique(np.concatenate([ends, *(np.arange(starts[k] + MOST, ends[k], MOST) for k in wide)]))
    return ends


def token_starts(chunk: bytes) -> np.ndarray:
    """Places in a chunk, but for its first, where a blank follows another character: there a token starts."""
    blank = BLANKS[np.frombuffer(chunk, np.uint8)]
    return 1 + np.flatnonzero(blank[1:] & ~blank[:-1])


class Summaries:
    """(token starts, begins with a blank, ends with a blank) of chunks. The oldest are forgotten beyond ``limit`` bytes."""

    def __init__(self, limit: int = REMEMBERED, digest=xxhash.xxh3_64_intdigest):
        self.limit, self.digest, self.held, self.size, self.hits = limit, digest, {}, 0, 0

    def of(self, chunk: bytes) -> tuple[int, bool, bool]:
        key = self.digest(chunk)
        known = self.held.get(key)
        if known and known[0] == chunk:
            self.hits += 1
            return known[1]
        summary = len(token_starts(chunk)), bool(BLANKS[chunk[0]]), bool(BLANKS[chunk[-1]])
        if known:
            self.size -= len(known[0])
        self.held[key] = chunk, summary
        self.size += len(chunk)
        while self.size > self.limit:
            self.size -= len(self.held.pop(next(iter(self.held)))[0])
        return summary


class Tokens:
    """Token count of a text's bytes, and where its tokens start."""

    def __init__(self, data: bytes, summaries: Summaries):
        ends = chunk_ends(np.frombuffer(data, np.uint8)).tolist()
        self.data, self.ends = data, ends
        counts, blank_before, at = [], True, 0
        self.opens = []  # whether a token starts at a chunk's first byte
        for end in ends:
            inside, begins, last = summaries.of(data[at:end])
            self.opens.append(at == 0 or (begins and not blank_before))
            counts.append(inside + self.opens[-1])
            blank_before, at = last, end
        self.before = np.cumsum([0, *counts])
        self.n = int(self.before[-1])

    def start(self, token: int) -> int:
        """First byte of a token; the end of the text for the token behind the last."""
        if token >= self.n:
            return len(self.data)
        k = int(np.searchsorted(self.before, token, "right")) - 1
        at, rest = self.ends[k - 1] if k else 0, token - int(self.before[k]) - self.opens[k]
        return at if rest < 0 else at + int(token_starts(self.data[at : self.ends[k]])[rest])


def rearranged(text: str, doc_id: int | None, summaries: Summaries, seed: int, rate: int, suffix_first: int) -> tuple:
    """``RESULT`` of one text."""
    data = text.encode()
    tokens = Tokens(data, summaries)
    n = tokens.n
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h1, h2, h3, h4 = struct.unpack(">4I", hashlib.sha256(name.encode()).digest()[:16])
    if not n or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return text, "plain", n, None, None
    low, high = sorted((tokens.start(h1 % (n + 1)), tokens.start(h2 % (n + 1))))
    prefix, middle, suffix = data[:low].decode(), data[low:high].decode(), data[high:].decode()
    if h4 % 100 < suffix_first:
        form, out = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, out = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return out, form, n, len(prefix), len(middle)


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Documents with a struct column ``_infill``: text (the output), form, n (tokens), prefix_chars and middle_chars.

    A token is a run of other characters with the ASCII blanks before it; blanks at a text's end are a token of their own.
    The cuts depend on the seed, the doc_id and the token count alone, so repeated rows get the same. A text is ``plain``
    (passed on as it is, with null lengths) if it is null (then empty) or empty, holds a sentinel already, or is not drawn;
    a null doc_id is drawn as an empty name. Texts of any length are read in blocks. All columns are passed on whatever
    their names (``_infill`` is replaced); an empty table gives no rows. One narrow pass; what a worker remembers of
    chunks changes its time only.
    """
    summaries: list[Summaries] = []

    @F.pandas_udf(RESULT)
    def cut(ids: pd.Series, known: pd.Series, texts: pd.Series) -> pd.DataFrame:
        if not summaries:
            summaries.append(Summaries())
        rows = [rearranged(t or "", int(i) if k else None, summaries[0], seed, rate, suffix_first) for i, k, t in zip(ids, known, texts)]
        out = pd.DataFrame(rows, columns=["text", "form", "n", "prefix_chars", "middle_chars"])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return bounded_batches(docs).withColumn("_infill", cut(F.expr("coalesce(doc_id, 0L)"), F.expr("doc_id IS NOT NULL"), F.col("text")))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. Only the three sentinels can stand in an output that is not plain, in the
    order of its form."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)

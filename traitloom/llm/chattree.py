"""Chat formatting into one token stream in which conversations share their common beginnings.

A conversation is the path of its turns from the root of a prefix tree. Conversations sorted by their paths are the tree
in depth-first order: each brings a branch, the turns that it does not share with the one before. A branch is emitted once,
as one stretch of the stream, with the position of its first token in the conversation, and the stretches of the stream
that its tokens attend to besides the branch itself (its ancestors).
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.llm.common import bounded_batches, materialise

VOCABULARY = os.environ.get("TRAITLOOM_CHAT_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how the vocabulary's authors split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Control strings; each is a token of its own, behind the vocabulary. A turn is <s>[INST]role[/INST]text</s>.
OPEN, CLOSE, ROLE, BODY = CONTROLS = "<s>", "</s>", "[INST]", "[/INST]"
LEARNED = "assistant"
#: Code points encoded in one call; tokens of a row of the stream; tokens of a block that readers look up.
CALL, PIECE, BLOCK = 1 << 16, 1 << 16, 1 << 10

_PLAIN = re.compile(r"(</?\\*)(?=s>)|(\[/?\\*)(?=INST\])")
_ESCAPED = re.compile(r"(</?\\*)\\(?=s>)|(\[/?\\*)\\(?=INST\])")


def escape(text: str) -> str:
    """One more backslash inside whatever is a control string or an escaped one, before its letters."""
    return _PLAIN.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][:-1], text)


class Tokenizer:
    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        size = max(ranks.values()) + 1
        self.encoding = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={c: size + k for k, c in enumerate(CONTROLS)})
        self.open, self.close, self.role, self.body = (size + k for k in range(len(CONTROLS)))

    def plain(self, text: str) -> list[int]:
        return [t for at in range(0, len(text), CALL) for t in self.encoding.encode_ordinary(text[at : at + CALL])]

    def turn(self, role: str | None, text: str | None) -> tuple[list[int], int, int]:
        """Tokens of a turn, and where those begin and end that are learned."""
        head, body = [self.open, self.role, *self.plain(escape(role or "")), self.body], self.plain(escape(text or ""))
        learned = len(body) if role == LEARNED else 0
        return [*head, *body, self.close], len(head), len(head) + learned

    def read(self, tokens: np.ndarray, learned: np.ndarray) -> tuple[str, str, str, str]:
        """A turn's formatted text, role, text, and learned text, from its tokens and their mask."""
        said = lambda ids: self.encoding.decode_bytes(ids.tolist()).decode()
        formatted = said(tokens)
        role, _, body = formatted[len(OPEN + ROLE) : -len(CLOSE)].partition(BODY)
        return formatted, unescape(role), unescape(body), unescape(said(tokens[learned]))


@lru_cache(maxsize=2)
def tokenizer(vocabulary: bytes) -> Tokenizer:
    """Kept while a worker lives."""
    return Tokenizer(vocabulary)


def _digest():
    """128 bits of a turn's role and text; null counts as empty."""
    empty = F.lit("")
    return F.unhex(F.md5(F.concat(F.md5(F.coalesce("role", empty)), F.md5(F.coalesce("text", empty)))))


LAID = "at long, conv_id long, digests array<binary>, sizes array<int>, shared int, starts array<long>"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``LAID`` of the conversations of one range, in the order of their paths: the turns shared with the one before, and
    where each turn starts in the range's own stretch of the stream. The first shares nothing yet."""
    digests, starts, end = [], [], 0
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            own, sizes = list(row.digests), row.sizes
            shared = next((k for k, (a, b) in enumerate(zip(digests, own)) if a != b), min(len(digests), len(own)))
            starts = starts[:shared] + (end + np.cumsum([0, *sizes[shared:]])[:-1]).tolist()
            digests, end = own, end + int(sum(sizes[shared:]))
            out.append((row.at, row.conv_id, own, sizes, shared, starts))
        yield pd.DataFrame(out, columns=["at", "conv_id", "digests", "sizes", "shared", "starts"])


def _seams(laid: DataFrame) -> dict[int, tuple]:
    """For each range (by number): what to add to its starts, its first tokens that the range before has emitted already,
    where those turns start, and how many turns its last conversation shares with the next range. One row a range is
    read."""
    row = F.struct("digests", "sizes", "starts")
    ends = laid.groupBy(F.shiftright("at", 33).alias("part")).agg(F.min_by(row, "at").alias("first"), F.max_by(row, "at").alias("last"), F.max("at").alias("end"), F.min("at").alias("begin"))
    out, digests, starts, offset, before = {}, [], [], 0, None
    for part in ends.orderBy("part").collect():
        first, last = part.first, part.last
        shared = next((k for k, (a, b) in enumerate(zip(digests, first.digests)) if a != b), min(len(digests), len(first.digests)))
        known = sum(first.sizes[:shared])
        carried = starts[:shared]
        if before is not None:
            out[before] = (*out[before][:3], shared, out[before][4])
        shift = offset - known
        out[part.part] = (shift, known, carried, 0, part.begin)
        starts = [carried[k] if s < known else s + shift for k, s in enumerate(last.starts)]
        digests, before = last.digests, part.part
        offset = starts[-1] + last.sizes[-1] if starts else offset
    return out


BRANCHES = "conv_id long, at long, shared int, needed int, sizes array<int>, starts array<long>"


def branches(turns: DataFrame, vocabulary: bytes) -> tuple[DataFrame, DataFrame]:
    """(members, tree). members: conv_id and its path. tree: ``BRANCHES`` of one conversation of each path: its place in
    depth-first order, the turns shared with the one before and with the one behind, and where all its turns start."""
    held = turns.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("int")
    def size(role: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([len(tokenizer(held.value).turn(r, t)[0]) for r, t in zip(role, text)], dtype="int32")

    told = bounded_batches(turns).select("conv_id", F.struct("turn", _digest().alias("digest"), size("role", "text").alias("size")).alias("t"))
    convs = told.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    convs = materialise(convs.select("conv_id", F.col("t.digest").alias("digests"), F.col("t.size").alias("sizes")), "conversations")
    path = F.array_join(F.transform("digests", lambda d: F.hex(d)), "")
    members = convs.select("conv_id", F.md5(path).alias("path"))
    one = convs.groupBy(path.alias("path")).agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "digests", "sizes")).alias("c"))
    ordered = one.orderBy("path").select(F.monotonically_increasing_id().alias("at"), "c.conv_id", "c.digests", "c.sizes")
    laid = materialise(ordered.mapInPandas(_scan, LAID), "tree")
    seams = turns.sparkSession.sparkContext.broadcast(_seams(laid))
    behind = laid.select((F.col("at") - 1).alias("at"), F.col("shared").alias("next"))
    paths = laid.select("conv_id", "at", F.md5(path).alias("path"))

    def settle(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                shift, known, carried, last, begin = seams.value[row.at >> 33]
                shared = len(carried) if row.at == begin else row.shared
                starts = [carried[k] if s < known else s + shift for k, s in enumerate(row.starts)]
                needed = int(row.next) if row.next >= 0 else last
                out.append((row.conv_id, row.at, shared, needed, row.sizes, starts))
            yield pd.DataFrame(out, columns=["conv_id", "at", "shared", "needed", "sizes", "starts"])

    kept = laid.select("conv_id", "at", "shared", "sizes", "starts").join(behind, "at", "left").withColumn("next", F.coalesce("next", F.lit(-1)))
    tree = kept.mapInPandas(settle, BRANCHES)
    return members.join(paths.drop("conv_id"), "path").select("conv_id", "at"), tree


STREAM = (
    "at long, piece int, start long, position long, token_ids array<int>, learned array<boolean>, turns int, needed int, "
    "ancestors array<struct<from: long, to: long>>"
)


def spans(starts, sizes) -> list[dict[str, int]]:
    """Stretches of the stream that turns fill, neighbours as one."""
    out: list[dict[str, int]] = []
    for s, n in zip(starts, sizes):
        if out and out[-1]["to"] == s:
            out[-1]["to"] = int(s + n)
        else:
            out.append({"from": int(s), "to": int(s + n)})
    return out


class Branch:
    """The part of a conversation that the stream holds for it, while its turns come in."""

    def __init__(self, at, shared, needed, sizes, starts, most: int):
        self.at, self.shared, self.needed, self.sizes, self.starts, self.most = at, shared, needed, sizes, starts, most
        self.depth, self.pieces, self.ids, self.learned = 0, 0, [], []

    def add(self, tokens: Tokenizer, role: str | None, text: str | None) -> tuple | None:
        """The next turn; the piece that it completes, if any."""
        if self.depth >= self.shared:
            ids, low, high = tokens.turn(role, text)
            mask = np.zeros(len(ids), bool)
            mask[low:high] = True
            self.ids.append(np.array(ids, np.int32))
            self.learned.append(mask)
        self.depth += 1
        return self.close() if sum(map(len, self.ids)) >= self.most else None

    def close(self) -> tuple | None:
        """The turns that came in since the last piece, as a row of the stream."""
        if not self.ids:
            return None
        first = self.depth - len(self.ids)
        ids, learned = np.concatenate(self.ids), np.concatenate(self.learned)
        needed = sum(len(x) for k, x in enumerate(self.ids) if first + k < self.needed)
        ancestors = spans(self.starts[:first], self.sizes[:first])
        row = (self.at, self.pieces, int(self.starts[first]), int(sum(self.sizes[:first])), ids, learned, len(self.ids), needed, ancestors)
        self.pieces, self.ids, self.learned = self.pieces + 1, [], []
        return row


def emit(turns: DataFrame, tree: DataFrame, vocabulary: bytes, piece: int = PIECE) -> DataFrame:
    """The stream, ``STREAM``: pieces of whole turns, of ``piece`` tokens or little more, of one branch. ``start`` is the first
    token's place in the stream, ``position`` its position in the conversation (those of the others follow); ``learned`` masks
    the tokens to learn from; ``ancestors`` are the stretches of the stream before it that its tokens attend to; later branches
    attend to its first ``needed`` tokens.

    The turns meet their conversation's branch in one shuffle; a task reads them in order and holds one piece."""
    held = turns.sparkSession.sparkContext.broadcast(vocabulary)
    head = [("at", "long"), ("shared", "int"), ("needed", "int"), ("sizes", "array<int>"), ("starts", "array<long>")]
    body = [("turn", "long"), ("digest", "binary"), ("role", "string"), ("text", "string")]
    none = lambda columns: [F.lit(None).cast(kind).alias(name) for name, kind in columns]
    heads = tree.select("conv_id", F.lit(0).alias("kind"), *none(body), *(name for name, _ in head))
    told = turns.select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), _digest().alias("digest"), "role", "text", *none(head))
    met = heads.unionByName(told).select(F.col("conv_id").isNotNull().alias("known"), F.coalesce("conv_id", F.lit(0)).alias("conv"), "*")
    met = met.repartition("known", "conv").sortWithinPartitions("known", "conv", "kind", "turn", "digest")
    whole = lambda v: None if v is None or v != v else int(v)

    def run(batches):
        of, branch, tokens = None, None, tokenizer(held.value)
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if (row.known, row.conv) != of:
                    out.append(branch.close() if branch else None)
                    of, branch = (row.known, row.conv), None
                if row.kind == 0:
                    branch = Branch(whole(row.at), whole(row.shared), whole(row.needed), row.sizes, row.starts, piece)
                elif branch:
                    out.append(branch.add(tokens, row.role, row.text))
            yield _stream(out)
        yield _stream([branch.close() if branch else None])

    return met.drop("conv_id", "turn", "digest").mapInPandas(run, STREAM)


def _stream(rows: list) -> pd.DataFrame:
    return pd.DataFrame([r for r in rows if r], columns=["at", "piece", "start", "position", "token_ids", "learned", "turns", "needed", "ancestors"])


def with_ancestors(stream: DataFrame) -> DataFrame:
    """at, start, token_ids, learned: of each branch its own pieces, and what it attends to of other branches, in the order of
    ``start`` its whole conversation. Readers find stretches by the blocks of the stream that these touch."""
    blocks = lambda low, high: F.explode(F.sequence(F.expr(f"{low} div {BLOCK}"), F.expr(f"({high} - 1) div {BLOCK}")))
    asked = stream.where("piece = 0").select("at", F.explode("ancestors").alias("a")).select("at", "a.from", "a.to")
    asked = asked.select("at", "from", "to", blocks("`from`", "`to`").alias("block"))
    told = stream.where("needed > 0").select(F.col("start").alias("low"), (F.col("start") + F.col("needed")).alias("high"), "token_ids", "learned")
    told = told.select("*", blocks("low", "high").alias("block"))
    edge = F.greatest("low", F.col("block") * BLOCK)
    cut = lambda c, low, first, size: F.slice(c, (low - first + 1).cast("int"), size.cast("int")).alias(c)
    size = F.least("high", (F.col("block") + 1) * BLOCK) - edge
    told = told.select("block", edge.alias("low"), (edge + size).alias("high"), *(cut(c, edge, F.col("low"), size) for c in ("token_ids", "learned")))
    low, high = F.greatest("low", "from"), F.least("high", "to")
    met = asked.join(told, "block").where(low < high)
    met = met.select("at", low.alias("start"), *(cut(c, low, F.col("low"), high - low) for c in ("token_ids", "learned")))
    return stream.select("at", "start", "token_ids", "learned").unionByName(met)


READ = "at long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(stream: DataFrame, vocabulary: bytes) -> DataFrame:
    """``READ`` of every branch's conversation, from the stream alone: roles and texts, the text under the mask (all unescaped)
    and the formatted length. A task reads a conversation's pieces in order and holds a turn and a piece."""
    held = stream.sparkSession.sparkContext.broadcast(vocabulary)
    met = with_ancestors(stream).repartition("at").sortWithinPartitions("at", "start")

    def run(batches):
        tokens, of, rest, told = tokenizer(held.value), None, None, None

        def closed():
            return [] if told is None else [(of, told[0], told[1].hexdigest(), told[2], told[3].hexdigest(), told[4])]

        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row.at != of:
                    out += closed()
                    of, rest, told = row.at, (np.zeros(0, np.int32), np.zeros(0, bool)), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, mask = np.concatenate([rest[0], row.token_ids]), np.concatenate([rest[1], np.asarray(row.learned, bool)])
                at = 0
                for end in (np.flatnonzero(ids == tokens.close) + 1).tolist():
                    formatted, role, text, learned = tokens.read(ids[at:end], mask[at:end])
                    told[0], told[2], told[4], at = told[0] + 1, told[2] + len(learned), told[4] + len(formatted), end
                    told[1].update(f"{role}\n{text}\n".encode())
                    told[3].update(learned.encode())
                rest = ids[at:], mask[at:]
            yield pd.DataFrame(out, columns=READ_NAMES)
        yield pd.DataFrame(closed(), columns=READ_NAMES)

    return met.mapInPandas(run, READ)


READ_NAMES = [c.split()[0] for c in READ.split(", ")]


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """The vocabulary's file; the driver sends it to the executors."""
    return Path(path).read_bytes()


def format_conversations(conversations: DataFrame, vocabulary: bytes | None = None, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(members, stream). ``stream`` is the prefix tree of all conversations in depth-first order of ``start`` (see ``emit``),
    written to the shared folder; ``members`` (conv_id, at) says which branch's leaf is a conversation's end.

    ``conversations`` holds conv_id, turn, role and text; other columns are left out whatever their names. Turns are in the
    order of turn (nulls first), then of a hash of role and text; repeated rows are turns of their own. Null roles and texts are
    empty; rows without a conv_id are one conversation. Control strings inside roles and texts are escaped. Conversations
    with the same turns share a leaf. Empty tables give empty ones.

    Texts are shuffled once; what else moves is 20 bytes a turn. A task holds a conversation's hashes (20 MB for a million
    turns), and one piece of its tokens.
    """
    vocabulary = vocabulary or read_vocabulary()
    turns = bounded_batches(conversations).select("conv_id", "turn", "role", "text")
    members, tree = branches(turns, vocabulary)
    return members, materialise(emit(turns, tree, vocabulary, piece), "stream")

"""SentencePiece models run by the tokenizers library.

The model protobuf is read field by field; the normaliser, the metaspace marker, the pieces with their scores and the
byte fallback are rebuilt as a ``tokenizers`` pipeline. Unigram models keep their scores; BPE models get their merges
from the pieces' order, which is the order in which SentencePiece itself would merge.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitloom.llm.common import bounded_batches

MODEL = os.environ.get("TRAITLOOM_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
#: Characters that one call encodes, and its threads.
CHUNK, THREADS = 1 << 18, 2
#: A word with the markers before it. Characters of words, with ``WORD_COST`` for each, that a worker remembers.
WORD, WORD_COST, REMEMBERED = f"{MARK}*[^{MARK}]+|{MARK}+", 24, 12 << 20

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
NEVER = -1e6


def fields(data: bytes):
    """(number, value) of a protobuf message: ints for varints, bytes for the rest."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """What the protobuf says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normaliser = {}, {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                score = float(np.frombuffer(piece[2], np.float32)[0]) if 2 in piece else 0.0
                self.pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = normaliser.get(2, b"")
        self.add_prefix, self.squeeze, self.escape = (bool(normaliser.get(n, 1)) for n in (3, 4, 5))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Every split of a piece into two pieces, the better (earlier) merged piece first."""
    known = {p: s for p, s, kind in pieces if kind in (NORMAL, USER_DEFINED)}
    found = []
    for order, (piece, score, kind) in enumerate(pieces):
        if kind == NORMAL:
            found += [(-score, order, cut, piece[:cut], piece[cut:]) for cut in range(1, len(piece)) if piece[:cut] in known and piece[cut:] in known]
    return [(a, b) for *_, a, b in sorted(found)]


def words_stand_alone(model: Model) -> bool:
    """Whether no piece reaches from a word into the marker after it, so that a text's ids are those of its words."""
    return not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED))


def segmenter(model: Model):
    """The ``tokenizers`` model that splits normalised text into pieces."""
    from tokenizers import models

    unknown = model.pieces[model.unknown][0]
    if model.kind == UNIGRAM:
        # a text that spells a control or byte piece is ordinary text: its characters' own pieces must win
        scored = [(p, s if kind in (NORMAL, USER_DEFINED) else NEVER) for p, s, kind in model.pieces]
        return models.Unigram(scored, model.unknown, model.byte_fallback)
    if model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        return models.BPE(vocab, merges(model.pieces), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    raise ValueError("only unigram and BPE models are read")


def build(model: Model):
    """The ``tokenizers`` pipeline of a model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, normalizers, pre_tokenizers

    tokenizer = Tokenizer(segmenter(model))
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex(r"\A | \z"), "")]
    if model.add_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if words_stand_alone(model):
        # no piece reaches from a word into the marker after it: words can be encoded, and remembered, one by one
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(WORD), "isolated")
    tokenizer.add_tokens([AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED])
    parts = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(parts + [decoders.Strip(" ", 1, 0)] * model.add_prefix)
    return tokenizer


class Words:
    """Encodes texts word by word through ``tokenizers`` and remembers the ids of words, so that each is encoded once.

    For models whose texts are their words: ``words_stand_alone``, no pieces of the user's, and a normaliser that only
    writes markers. What is remembered is bounded and forgotten as a whole; it changes the time only.
    """

    def __init__(self, model: Model):
        from tokenizers import Tokenizer, pre_tokenizers

        self.alone, self.joined = Tokenizer(segmenter(model)), Tokenizer(segmenter(model))
        self.joined.pre_tokenizer = pre_tokenizers.Split(MARK, "merged_with_next")
        self.begins = np.array([p.startswith(MARK) for p, _, _ in model.pieces])
        self.before = MARK * model.add_prefix
        self.split = re.compile(WORD).findall
        self.ids: dict[str, bytes] = {}
        self.cost = 0

    @staticmethod
    def fit(model: Model) -> bool:
        return words_stand_alone(model) and model.escape and not (model.charsmap or model.squeeze or any(kind == USER_DEFINED for *_, kind in model.pieces))

    def _learn(self, words: set[str]) -> None:
        """Ids of new words. Those with one marker, in front, go to the library as one text, where pieces that begin with it
        tell the words apart; the others, and all if a marker got no piece, one by one."""
        one = [w for w in words if w.rfind(MARK) == 0]
        ids = np.array(self.joined.encode_batch_fast(["".join(one)], add_special_tokens=False)[0].ids, np.int32)
        cuts = (4 * np.flatnonzero(self.begins[ids])).tolist()
        if len(cuts) == len(one):
            packed = ids.tobytes()
            self.ids.update(zip(one, [packed[a:b] for a, b in zip(cuts, [*cuts[1:], len(packed)])]))
            words = words.difference(one)
        rest = list(words)
        for word, got in zip(rest, self.alone.encode_batch_fast(rest, add_special_tokens=False)):
            self.ids[word] = np.array(got.ids, np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.split(self.before + t.replace(" ", MARK)) if t else [] for t in texts]
        known = [list(map(self.ids.get, words)) for words in parts]
        new = {w for words, got in zip(parts, known) if None in got for w, i in zip(words, got) if i is None}
        if new:
            self._learn(new)
            of = self.ids.__getitem__
            known = [list(map(of, words)) if None in got else got for words, got in zip(parts, known)]
            self.cost += sum(map(len, new)) + WORD_COST * len(new)
            if self.cost > REMEMBERED:
                self.ids, self.cost = {}, 0
        return [np.frombuffer(b"".join(got), np.int32) for got in known]


def byte_table(model: Model) -> list[bytes]:
    """What each id writes: its text with the marker as a blank, one byte for a byte piece, nothing for a control."""
    special = {CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[3:5], 16)]), UNKNOWN: lambda p: " ⁇ ".encode()}
    return [special.get(kind, lambda p: p.replace(MARK, " ").encode())(p) for p, _, kind in model.pieces]


def decode_ids(table: list[bytes], ids: list[int], add_prefix: bool) -> str:
    text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if add_prefix and text.startswith(" ") else text


def encode_texts(tokenizer, texts: list[str], chunk: int = CHUNK):
    """Token ids of each text, encoded in batches of about ``chunk`` characters by a pipeline's threads or by ``Words``."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= chunk):
            size += len(texts[end])
            end += 1
        if isinstance(tokenizer, Words):
            yield from tokenizer.encode(texts[at:end])
        else:
            for one in tokenizer.encode_batch_fast(texts[at:end], add_special_tokens=False):
                yield np.array(one.ids, np.int32)
        at = end


#: Rows that one result batch holds, at most.
ROWS = 256
PIECES = T.StructType([T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()), T.StructField("parity", T.BooleanType())])


@lru_cache(maxsize=1)
def _ready(data: bytes, threads: int):
    """Tokenizer, library, byte table and prefix flag of a model, kept while a worker lives."""
    import sentencepiece

    os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = str(threads), "true"
    model = Model(data)
    tokenizer = Words(model) if Words.fit(model) else build(model)
    return tokenizer, sentencepiece.SentencePieceProcessor(model_proto=data), byte_table(model), model.add_prefix


def _pieces(texts: list[str], ready) -> pa.StructArray:
    tokenizer, library, table, add_prefix = ready
    ids = list(encode_texts(tokenizer, texts))
    lists = [x.tolist() for x in ids]
    same = [x == library.encode(t) for x, t in zip(lists, texts)]  # text by text costs a tenth less than a list of texts
    decoded = [decode_ids(table, x, add_prefix) for x in lists]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
    return pa.StructArray.from_arrays([lists, pa.array(decoded, pa.string()), pa.array(same, pa.bool_())], ["token_ids", "decoded", "parity"])


def tokenise(docs: DataFrame, model_path: str = MODEL, threads: int = THREADS) -> DataFrame:
    """Documents with a struct column ``_pieces``: token_ids, decoded and parity.

    ``decoded`` is the text that the ids give back. ``parity`` says of every text whether the sentencepiece library gives
    the same ids.
    Null texts count as empty and have no ids. All columns are passed on whatever their names (``_pieces`` is
    replaced); repeated rows are encoded each; an empty table gives no rows. The model file is read on the driver and
    sent to the executors (its size is that of the vocabulary).
    """
    held = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    docs = bounded_batches(docs).drop("_pieces")

    def run(batches):
        ready = _ready(held.value, threads)
        for held_ in batches:
            for at in range(0, held_.num_rows, ROWS):
                row, text = held_.slice(at, ROWS).columns
                yield pa.RecordBatch.from_arrays([row, _pieces([t or "" for t in text.to_pylist()], ready)], ["_row", "_pieces"])

    inner = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))
    schema = T.StructType([inner.schema["_row"], T.StructField("_pieces", PIECES)])
    return inner.mapInArrow(run, schema).select("_row.*", "_pieces")

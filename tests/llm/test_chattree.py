import hashlib
import random
import re

import pytest

from traitloom.llm import chattree

ODD = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "</\\\\s>", "[\\INST]", "[/\\\\\\INST]", "\\", "<", "/", "s>", "INST]", "[", " ok ", "é", "日本", "\n", "word " * 40, "\\\\s>"]
SAID = "</s>[INST] ok [/INST]"
SCHEMA = "conv_id long, turn long, role string, text string, at long, path string"


def odd_text(draw):
    return "".join(draw.choice(ODD) for _ in range(draw.randrange(9)))


def test_escape_is_reversible_and_leaves_no_control_string():
    draw = random.Random(1)
    for _ in range(5000):
        text = odd_text(draw)
        escaped = chattree.escape(text)
        assert chattree.unescape(escaped) == text and not any(c in escaped for c in chattree.CONTROLS)
    assert chattree.escape("plain \\ text") == "plain \\ text"


def conversations(seed, count):
    """Rows of conversations that begin alike, copies, a long one, and odd ones."""
    draw = random.Random(seed)
    shared = [[("system", "be kind"), ("user", odd_text(draw)), ("assistant", "yes")], [("user", "hello"), ("assistant", SAID)], []]
    talks = []
    for _ in range(count):
        begin = draw.choice([*shared, draw.choice(talks) if talks else []])
        talks.append([*begin, *((draw.choice(["user", "assistant", "system", "<s>", None]), draw.choice([None, odd_text(draw)])) for _ in range(draw.randrange(5)))][:40] or [("user", "")])
    talks += [[("user", f"turn {k}") for k in range(300)], [("user", f"turn {k}") for k in range(200)] + [("assistant", "x " * 3000)], [("user", "turn 0"), ("assistant", "short")]]
    rows = [(c, 10 * k, *turn, 1, "p") for c, talk in enumerate([*talks, *[talks[3]] * 50]) for k, turn in enumerate(talk)]
    rows += [(None, 1, "user", "no id", 1, "p"), (None, 2, "assistant", "none", 1, "p"), (-7, 0, "user", SAID, 1, "p"), (-7, 1, "assistant", SAID, 1, "p")]
    rows += [(-8, 0, "user", "again", 1, "p")] * 3 + [(-9, None, "user", "untimed", 1, "p"), (-9, 1, "assistant", "late", 1, "p")]
    return rows


def talks_of(rows):
    out = {}
    for c, turn, role, text, *_ in rows:
        out.setdefault(c, []).append((turn if turn is not None else -1, role, text))
    return {c: [(r, t) for _, r, t in sorted(x, key=lambda y: y[0])] for c, x in out.items()}


@pytest.fixture(scope="module")
def vocabulary():
    return chattree.read_vocabulary()


def test_stream_and_what_is_read_back(spark, monkeypatch, vocabulary):
    """Small pieces and blocks, many ranges: every turn's tokens once, in depth-first order, and all conversations whole."""
    monkeypatch.setattr(chattree, "BLOCK", 32)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = conversations(2, 120)
    talks = talks_of(rows)
    tokens = chattree.tokenizer(vocabulary)
    try:
        members, stream = chattree.format_conversations(spark.createDataFrame(rows, SCHEMA).repartition(6), vocabulary, piece=60)
        pieces = sorted(stream.collect(), key=lambda r: r.start)
        leaves = {r.conv_id: r.at for r in members.collect()}
        back = {r.at: r for r in chattree.read_back(stream, vocabulary).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.at >> 33 for r in pieces}) > 1 and max(r.piece for r in pieces) > 3

    # every prefix of every conversation once, without gaps
    prefixes = {tuple((r or "", t or "") for r, t in talk[: k + 1]) for talk in talks.values() for k in range(len(talk))}
    written = [(r.start, len(r.token_ids)) for r in pieces]
    assert sum(n for _, n in written) == sum(len(tokens.turn(*p[-1])[0]) for p in prefixes) and sum(r.turns for r in pieces) == len(prefixes)
    assert all(a + n == b for (a, n), (b, _) in zip(written, written[1:])) and written[0][0] == 0
    flat = [t for r in pieces for t in r.token_ids]
    masks = [m for r in pieces for m in r.learned]

    # depth first: the branches that attend to a stretch follow it before anything else does
    for r in pieces:
        assert all(a["to"] <= r.start for a in r.ancestors) and sum(a["to"] - a["from"] for a in r.ancestors) == r.position
        assert all(a["to"] < b["from"] for a, b in zip(r.ancestors, r.ancestors[1:]))
    parent = [r.ancestors[-1]["to"] if r.ancestors else None for r in pieces]
    for k, r in enumerate(pieces):
        later = [p for p in parent[k + 1 :] if p is not None and r.start < p <= r.start + len(r.token_ids)]
        apart = next((j for j, p in enumerate(parent[k + 1 :]) if p is None or p <= r.start), len(pieces))
        assert all(not (r.start < (p or 0) <= r.start + len(r.token_ids)) for p in parent[k + 1 + apart :]), later

    # what a conversation's last piece attends to, and the piece, are the conversation
    last = {}
    for r in pieces:
        last[r.at] = r
    for c, talk in talks.items():
        r = last[leaves[c]]
        path = [x for a in r.ancestors for x in range(a["from"], a["to"])] + list(range(r.start, r.start + len(r.token_ids)))
        turned = [tokens.turn(*x) for x in talk]
        assert [flat[x] for x in path] == [t for ids, _, _ in turned for t in ids]
        assert [masks[x] for x in path] == [low <= k < high for ids, low, high in turned for k in range(len(ids))]
        got = back[leaves[c]]
        said = "".join(f"{role or ''}\n{text or ''}\n" for role, text in talk)
        loss = "".join(text or "" for role, text in talk if role == "assistant")
        formatted = "".join(f"<s>[INST]{chattree.escape(role or '')}[/INST]{chattree.escape(text or '')}</s>" for role, text in talk)
        assert got[1:] == (len(talk), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted))
    assert len(leaves) == len(talks) and len(set(leaves.values())) < len(talks) - 45


def test_empty_table_and_long_text(spark, vocabulary):
    docs = spark.createDataFrame([(1, 0, "assistant", "a" * 300_000 + " " * 70_000, 0, ""), (2, 0, None, None, 0, "")], SCHEMA)
    members, stream = chattree.format_conversations(docs, vocabulary)
    told = {r.conv_id: r for r in members.join(chattree.read_back(stream, vocabulary), "at").collect()}
    assert told[1].loss_chars == 370_000 and told[2].n_turns == 1 and told[2].loss_chars == 0
    members, stream = chattree.format_conversations(docs.limit(0), vocabulary)
    assert members.count() == stream.count() == chattree.read_back(stream, vocabulary).count() == 0


def test_other_implementation_of_the_escape_in_sql():
    """The oracle's two expressions do what ``escape`` does."""
    draw = random.Random(5)
    for _ in range(2000):
        text = odd_text(draw)
        assert re.sub(r"(\[/?\\*)(INST\])", r"\1\\\2", re.sub(r"(</?\\*)(s>)", r"\1\\\2", text)) == chattree.escape(text)

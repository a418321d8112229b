"""Labelled findings for the secret scan: secrets and look-alikes planted between the words of documents.

A plant's label is known because of how it was made, not from a rule over what a scan can see. Secrets and look-alikes
share lengths, alphabets and neighbours: a digest has the form of a token, an identifier may stand where a password does.
"""

from __future__ import annotations

import random
import uuid

HEX, LOWER, UPPER, DIGITS = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALNUM = LOWER + UPPER + DIGITS
# What a secret is assigned to, what look-alikes are, and values that hold a secret's place
NAMES = "password passwd pwd secret token api_key apikey access_key secret_key auth_token client_secret db_password credential".split()
OTHERS = "commit sha256 checksum md5 etag id uuid request_id revision digest build order file version class package session trace".split()
PLACEHOLDERS = "changeme your_password_here your-api-key insert_token_here xxxxxxxxxxxx ******** <password> ${SECRET_KEY} {{token}} example_secret REDACTED not_set undefined none_given".split()
SEPARATORS, QUOTES = (" = ", "=", ": ", ":", " := ", " => "), ('"', '"', "'", "")


def _of(draw: random.Random, alphabet: str, size: int) -> str:
    return "".join(draw.choice(alphabet) for _ in range(size))


def _words(draw: random.Random, words: list[str], most: int) -> list[str]:
    return [draw.choice(words) for _ in range(draw.randint(1, most))] if words else [_of(draw, LOWER, draw.randint(3, 9))]


def _password(draw: random.Random, words: list[str]) -> str:
    if draw.random() < 0.5:
        return draw.choice(_words(draw, words, 1)).capitalize()[:9] + draw.choice("#!@$_-") + _of(draw, DIGITS, draw.randint(2, 5)) + draw.choice(["", "!", "$"])
    return _of(draw, ALNUM, 4) + _of(draw, ALNUM + "!@#$%^*", draw.randint(4, 14)) + _of(draw, DIGITS, 1)


def _key(draw: random.Random) -> str:
    """A key of a public form."""
    return draw.choice(
        [
            lambda: "AKIA" + _of(draw, UPPER + "234567", 16),
            lambda: f"gh{draw.choice('opsu')}_" + _of(draw, ALNUM, 36),
            lambda: "sk-" + _of(draw, ALNUM, draw.randint(24, 48)),
            lambda: "AIza" + _of(draw, ALNUM + "_-", 35),
            lambda: f"xox{draw.choice('abp')}-" + _of(draw, DIGITS, 11) + "-" + _of(draw, ALNUM, 24),
            lambda: ".".join(["eyJ" + _of(draw, ALNUM, draw.randint(16, 40)), "eyJ" + _of(draw, ALNUM, draw.randint(24, 80)), _of(draw, ALNUM + "_-", 43)]),
        ]
    )()


def secret(draw: random.Random, words: list[str]) -> tuple[str, str, str]:
    """(before, value, after) of a secret."""
    kind = draw.random()
    if kind < 0.25:
        value = _key(draw)
        if draw.random() < 0.5:
            return draw.choice(["", "use ", "key ", "Authorization: Bearer "]), value, ""
    elif kind < 0.5:
        value = _of(draw, HEX, draw.choice([32, 40, 40, 64]))
    elif kind < 0.65:
        value = _of(draw, ALNUM + "+/", draw.randint(16, 44))
    else:
        value = _password(draw, words)
        if draw.random() < 0.15:
            return f"{draw.choice(['https', 'postgres', 'ftp'])}://{draw.choice(['admin', 'app', 'root'])}:", value.replace("@", "_"), "@host/" + draw.choice(["", "db"])
    quote = draw.choice(QUOTES)
    return draw.choice(NAMES) + draw.choice(SEPARATORS) + quote, value, quote


def look_alike(draw: random.Random, words: list[str]) -> tuple[str, str, str]:
    """(before, value, after) of what is no secret."""
    parts = _words(draw, words, 4)
    name = draw.choice(
        [
            lambda: "_".join(parts),
            lambda: "-".join(parts),
            lambda: "".join(p.capitalize() for p in parts),
            lambda: parts[0] + "".join(p.capitalize() for p in parts[1:]),
            lambda: "/".join(parts) + draw.choice(["", ".txt", ".py"]),
        ]
    )()
    long_name = name if len(name) >= 16 else "".join(parts + _words(draw, words, 4) + _words(draw, words, 4))
    digest = _of(draw, HEX, draw.choice([32, 40, 40, 64]))
    quote = draw.choice(QUOTES)
    kind = draw.random()
    if kind < 0.2:
        return "", long_name, ""
    if kind < 0.35:
        return draw.choice(["", "card ", "call ", "no. "]), _of(draw, DIGITS, draw.randint(16, 19)), ""
    if kind < 0.5:
        return draw.choice(["", "id ", "id: ", "request_id="]), str(uuid.UUID(int=draw.getrandbits(128), version=4)), ""
    if kind < 0.7:
        return draw.choice(OTHERS) + draw.choice(SEPARATORS + (" ", " ")) + quote, digest, quote
    if kind < 0.85:
        return draw.choice(NAMES) + draw.choice(SEPARATORS) + quote, draw.choice(PLACEHOLDERS) if draw.random() < 0.5 else name if len(name) > 5 else name + long_name, quote
    return draw.choice(OTHERS) + draw.choice(SEPARATORS) + quote, long_name, quote


def plant(text: str, seed: int, count: int = 4, around: int = 80) -> list[tuple[str, int, int, int]]:
    """(snippet, start, end, label) of ``count`` plants between words of a text, half of them secrets on average."""
    draw = random.Random(seed)
    out = []
    for _ in range(count):
        at = text.find(" ", draw.randrange(len(text) + 1)) if text else -1
        at = len(text) if at < 0 else at
        left, right = text[max(0, at - around) : at] + " ", " " + text[at + 1 : at + around]
        words = [w for w in (left + right).lower().split() if w.isalpha() and len(w) > 2]
        label = draw.randrange(2)
        before, value, after = (secret if label else look_alike)(draw, words)
        turn = draw.random()
        change = str.upper if turn < 0.15 and label == 0 or turn < 0.08 else str.lower if turn > 0.97 else str
        before, value, after = change(before), change(value), change(after)
        out.append((left + before + value + after + right, len(left) + len(before), len(left) + len(before) + len(value), label))
    return out

"""Small tables of texts with awkward rows, and plain versions of what the operators compute."""

from __future__ import annotations

import re

import public_tokenizers
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, set string, row long, label string"


def documents(spark, texts: list):
    """Rows of (doc_id, text) or texts; further columns carry names that operators use inside."""
    rows = [t if isinstance(t, tuple) else (n, t) for n, t in enumerate(texts)]
    return spark.createDataFrame(
        [(i, t, "en", "web", None if t is None else len(t), "x", 1, "y") for i, t in rows], SCHEMA
    )


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, short: bool = True) -> frozenset:
    found = WORD.findall(lowered(text or ""))
    if len(found) < 5:
        return frozenset([tuple(found)] if found and short else [])
    return frozenset(tuple(found[n : n + 5]) for n in range(len(found) - 4))


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def groups(nodes, links) -> dict:
    """Smallest node reachable from each node."""
    best = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(best[a], best[b])
            changed |= best[a] != low or best[b] != low
            best[a] = best[b] = low
    return best


def token_ids(name: str, text: str | None) -> list[int]:
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids


AWKWARD = [
    None,
    "",
    " \t\n ",
    "one",
    "two words",
    "Éa ñandú für über 日本語 テスト",
    "a  double  space and a trailing one ",
    "tab\tand\nnew line\r\n and　wide x",
    "word " * 3000,
    "x" * 5000,
    "same words here as there are in the next row of it",
    "same words here as there are in the next row of it",
    "<|endoftext|> is text here, and it's 12345 too!!",
]

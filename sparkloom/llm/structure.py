"""Pushdown parsing of a text's markup, and its sentences in a form that ignores numbers and names."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa

#: Tags of messages, closers of brackets, marks that end a sentence.
TAGS = ("think", "answer", "tool_call")
CLOSERS = {")": "(", "]": "[", "}": "{"}
ENDS = ".!?。！？…؟।"
AFTER_END = "\"'”’»)]}*_`"

STEP = re.compile(r"```|</?[a-z_]+>|[()\[\]{}\"“”«»]|[A-Za-z]\)|\d+\)")
SPLIT = re.compile(r"(?<=[.!?。！？…])[\"'”’»)]*\s+|[\n\r]+|</?(?:think|answer|tool_call)>")
MATRIX = re.compile(r"\[\s*\[.*?\]\s*\]", re.S)
NUMBER = re.compile(r"-?\d+(?:[.,]\d+)*")
NAME = re.compile(r"(?<![\w'’])[^\W\d_](?![\w'’])")


#: Fixed value: format characters.
INVISIBLE = re.compile("[\u00ad\u0600-\u0605\u061c\u06dd\u070f\u08e2\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\ufff9-\ufffb]")


#: White space other than single blanks and line ends.
BLANKS = re.compile(r"[^\S\n ][^\S\n]*| [^\S\n]+")


def plain(text: str) -> str:
    """Compatibility form without invisible characters, with plain minus signs and single blanks."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.replace("…", "\x00")).replace("\x00", "…").replace("−", "-")
        text = INVISIBLE.sub("", text)
    return BLANKS.sub(" ", text).strip()


def unclosed(text: str) -> list[str]:
    """Tags, fences, brackets and quotations still open at the end of a text.

    A closer takes its nearest opener and what was opened since; closers without opener, as after
    list numbers, are skipped. Straight quotation marks open and close in turn.
    """
    stack: list[str] = []
    if "[" in text:
        text = MATRIX.sub(" ", text)
    for m in STEP.finditer(text):
        x = m.group()
        if x[-1] == ")" and len(x) > 1:
            x = ")"
        if x == "```" or x == '"':
            if x in stack:
                del stack[len(stack) - 1 - stack[::-1].index(x) :]
            else:
                stack.append(x)
        elif x[0] == "<":
            name = x.strip("</>")
            if name not in TAGS:
                continue
            if x[1] != "/":
                stack.append(name)
            elif name in stack:
                del stack[len(stack) - 1 - stack[::-1].index(name) :]
        elif "```" in stack:
            continue
        elif x in "([{“«":
            stack.append(x)
        else:
            opener = CLOSERS.get(x) or {"”": "“", "»": "«"}[x]
            if opener in stack:
                del stack[len(stack) - 1 - stack[::-1].index(opener) :]
    return stack


def broken_tag(text: str) -> bool:
    """Whether the text ends within a tag."""
    m = re.search(r"</?([a-z_]*)$", text)
    return bool(m) and any(t.startswith(m.group(1)) for t in TAGS)


def dangling_list(text: str) -> bool:
    """Whether the text ends in an empty list item."""
    return bool(re.search(r"\n\s*(?:[-*•]|\d+[.)])\s*$", text))


def is_closed(text: str) -> bool:
    """Whether the last mark of a text ends a sentence (or is a picture, as after an informal one)."""
    bare = text.rstrip().rstrip(AFTER_END)
    if not bare:
        return True
    return bare[-1] in ENDS or unicodedata.category(bare[-1]) in ("So", "Sk") or bare[-1] == "‍"


#: A plain number, or a whole matrix: most values need no more than this look.
SCALAR = re.compile(r"\s*-?\d+(?:\.\d+)?\s*")
WHOLE_MATRIX = re.compile(r"\s*\[\s*\[[^\[\]]*\](?:\s*,\s*\[[^\[\]]*\])*\s*\]\s*")
LETTER = re.compile(r"[^\W\d_]")


def is_bare(text: str) -> bool:
    """Whether a text holds no letters: a value, or nothing."""
    return not LETTER.search(text)


def mask(sentence: str, last: bool = True) -> str:
    """A sentence without its numbers, matrices and one-letter names; ``last``: also a name at its end."""
    s = NUMBER.sub("0", MATRIX.sub("0", sentence))
    tail = ""
    if not last and (m := re.search(r"(?<![\w'’])[^\W\d_]$", s)):
        s, tail = s[: m.start()], m.group()
    return (NAME.sub("v", s) + tail).lower().strip(" " + ENDS)


@lru_cache(maxsize=50_000)
def known_sentence(sentence: str) -> tuple[str, bool] | None:
    """mask() of a sentence and whether it is closed; None for one without letters. Sentences repeat heavily."""
    return None if is_bare(sentence) else (mask(sentence), is_closed(sentence))


def sentences(text: str) -> list[tuple[str, bool]]:
    """The sentences of a plain() text as written, and whether each is closed."""
    return [(s, is_closed(s)) for s in (x.strip() for x in SPLIT.split(text)) if s]


def rows(batch: pa.RecordBatch, size: int = 256) -> Iterator[tuple]:
    """The rows of a batch, of which few are in memory as Python values at a time, as texts may be long."""
    for at in range(0, batch.num_rows, size):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, size).columns))

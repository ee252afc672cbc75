"""Sentence spans of a line of prose, for the operators that need a splitter which knows abbreviations."""

from __future__ import annotations

import re

# Words before a full stop that don't end a sentence.
ABBREVIATIONS = {"al", "approx", "cf", "co", "corp", "dr", "e.g", "etc", "fig", "gen", "i.e", "inc", "jr", "ltd", "mr", "mrs", "ms", "no", "prof", "rev", "sr", "st", "vs"}

_END = re.compile(r"[.!?]+[\"'”’)\]]*(?=\s)")
_LAST_WORD = re.compile(r"([\w.]+)$")
_START = re.compile(r"\s+(?=[\"'“‘(\[*_]*[^\sa-z,;:])")


def spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence: after an end mark that no abbreviation or initial explains, before something that can begin one."""
    out, begin = [], 0
    for m in _END.finditer(text):
        follows = _START.match(text, m.end())
        if not follows:
            continue
        word = _LAST_WORD.search(text[begin : m.start()])
        if text[m.start()] == "." and word and (word[1].lower() in ABBREVIATIONS or re.fullmatch(r"[A-Z]", word[1])):
            continue
        out.append((begin, m.end()))
        begin = follows.end()
    end = len(text.rstrip())
    if begin < end:
        out.append((begin, end))
    lead = len(text) - len(text.lstrip())
    return [(max(a, lead), b) for a, b in out if text[a:b].strip()]


def sentences(text: str) -> list[str]:
    return [text[a:b] for a, b in spans(text)]

"""Text cut into chunks that can be tokenised on their own, and a bounded cache over them.

The byte-level patterns never match across the end of a run of non-space characters. So a
text may be cut before every space that follows a non-space character: each chunk (a space and what
stands up to the next such space) gives the same pre-tokens alone as in its text. Few
chunks are new after the first megabytes, which makes a dictionary of them worth its memory.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import regex

#: Chunks that a task remembers. The memory is given back when it is full; results do not change.
CACHE_ENTRIES = 400_000
#: First chunks of texts that a task remembers beside them.
OPENINGS = 50_000
#: Runs of marks that follow words, remembered beside them.
RUNS = 10_000
#: Longer chunks are computed each time they occur.
LONGEST_CACHED = 64

#: White space before a space: where these occur, a space is not the start of a chunk.
_RUNS = tuple(c + " " for c in map(chr, range(0x3001)) if c.isspace())
_ASCII_RUNS = tuple(run for run in _RUNS if run.isascii())

#: Fixed value: the published pattern of byte-level vocabularies.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def piece_finder(pattern: str) -> Callable[[str], list[str]]:
    """Function that cuts a chunk into the matches of `pattern`.

    Words, alone or with one mark after them, need no search with the byte-level pattern.
    """
    find = regex.compile(pattern).findall
    if pattern != BYTE_LEVEL:
        return find

    def pieces(chunk: str) -> list[str]:
        if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            return [chunk]
        body, last = chunk[:-1], chunk[-1:]
        if last in ".,;:!?" and body[1:].isalpha() and (body[0] == " " or body[0].isalpha()):
            return [body, last]
        return find(chunk)

    return pieces


def parts_and_chunks(text: str) -> tuple[list[str], list[str]]:
    """The chunks of `text` in two lists: those that start with one space, without it, and all others."""
    if any(run in text for run in (_ASCII_RUNS if text.isascii() else _RUNS)):
        return [], split_chunks(text)
    first, *parts = text.split(" ")
    return parts, [first] if first else []


def split_chunks(text: str) -> list[str]:
    """The chunks of `text`; joined they give `text`, and each can be tokenised alone.

    >>> split_chunks("one  two\\n three")
    ['one', '  two\\n three']
    """
    parts = text.split(" ")
    if not any(run in text for run in (_ASCII_RUNS if text.isascii() else _RUNS)):
        chunks = [" " + part for part in parts]
        chunks[0] = parts[0]
        return chunks if parts[0] else chunks[1:]
    chunks = [parts[0]]
    for part in parts[1:]:
        last = chunks[-1]
        if last and not last[-1].isspace():
            chunks.append(" " + part)
        elif last == "" and len(chunks) == 1:
            chunks[0] = " " + part
        else:
            chunks[-1] = last + " " + part
    return chunks if chunks != [""] else []


class ChunkCache:
    """Values of chunks, computed by `compute` for the chunks of a text that are not known yet."""

    def __init__(
        self, compute: Callable[[Sequence[str]], Sequence[Any]], entries: int = CACHE_ENTRIES
    ):
        self.compute = compute
        self.entries = entries
        self.known: dict[str, Any] = {}  # by the chunk without its leading space
        self.get = self.known.get
        self.openings: dict[str, Any] = {}

    def values(self, text: str) -> list[Any]:
        """The values of the chunks of `text`, in order."""
        first, *rest = text.split(" ")
        if first and first[-1].isspace():
            return self._plain(text)
        found = list(map(self.get, rest))
        if None in found:
            places = [i for i, value in enumerate(found) if value is None]
            new = list({rest[i]: None for i in places})
            if any(not part or part[-1].isspace() for part in new):
                return self._plain(text)
            values = self._new_values(new)
            for i in places:
                found[i] = values[rest[i]]
            self._remember(values)
        return [self.opening(first), *found] if first else found

    def of_parts(self, parts: list[str]) -> list[Any]:
        """The values of chunks that start with one space and end without, given without it, each once."""
        found = list(map(self.get, parts))
        places = [i for i, value in enumerate(found) if value is None]
        if places:
            values = self._new_values([parts[i] for i in places])
            for i in places:
                found[i] = values[parts[i]]
            self._remember(values)
        return found

    def _new_values(self, new: Sequence[str]) -> dict[str, Any]:
        """The values of chunks that are not in `known`, by the chunk without its leading space."""
        return dict(zip(new, self.compute([" " + part for part in new])))

    def opening(self, chunk: str) -> Any:
        """The value of the first chunk of a text, which has no space before it."""
        value = self.openings.get(chunk)
        if value is None:
            [value] = self.compute([chunk])
            if len(self.openings) >= OPENINGS:
                self.openings.clear()
            if len(chunk) <= LONGEST_CACHED:
                self.openings[chunk] = value
        return value

    def _remember(self, values: dict[str, Any]) -> None:
        if len(self.known) + len(values) > self.entries:
            self.known.clear()
        if max(map(len, values)) > LONGEST_CACHED:
            values = {k: v for k, v in values.items() if len(k) <= LONGEST_CACHED}
        self.known.update(values)

    def _plain(self, text: str) -> list[Any]:
        chunks = split_chunks(text)
        return list(self.compute(chunks)) if chunks else []


class WordCache(ChunkCache):
    """A cache for values that are added up with `+`, which knows a word with any marks behind it by its parts.

    The byte-level patterns always cut between a letter and the marks after it. `marks` are the characters that
    count as such; none may be a letter, a digit or white space. A full cache forgets what was not asked for since it was last half full,
    so frequent chunks stay.
    """

    def __init__(self, compute: Callable[[Sequence[str]], Sequence[Any]], entries: int, marks: str):
        super().__init__(compute, entries // 2)
        self.marks = marks
        self.runs: dict[str, Any] = {}  # of marks
        self.older: dict[str, Any] = {}

    def _remember(self, values: dict[str, Any]) -> None:
        if len(self.known) + len(values) > self.entries:
            # `get` looks into `known`, so both change places by their contents.
            self.older = self.known
            self.known = {}
            self.get = self.known.get
        super()._remember(values)

    def _new_values(self, new: Sequence[str]) -> dict[str, Any]:
        known, older, marks = self.get, self.older.get, self.marks
        values, wanted, cut = {}, {}, []
        for part in new:
            value = older(part)
            if value is not None:
                values[part] = value
                continue
            body = part.rstrip(marks)
            run = self._run(part[len(body) :]) if body != part and _is_letter(body[-1:]) else None
            if run is None:
                wanted[part] = None
                continue
            cut.append((part, body, run))
            value = known(body)
            if value is None:
                value = older(body)
            if value is None:
                wanted[body] = None
            else:
                values[body] = value
        if wanted:
            values.update(super()._new_values(list(wanted)))
        for part, body, run in cut:
            values[part] = values[body] + run
        return values

    def _run(self, run: str) -> Any:
        """The value of marks that follow a letter; none when there are too many different ones."""
        value = self.runs.get(run)
        if value is None and len(self.runs) < RUNS and len(run) <= LONGEST_CACHED:
            [value] = self.compute([run])
            self.runs[run] = value
        return value


def _is_letter(char: str) -> bool:
    """Whether `char` is a letter in every version of Unicode, so for any pattern; other letters are not told."""
    return char < "\u0250" and char.isalpha()

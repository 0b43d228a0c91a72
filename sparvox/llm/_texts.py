"""Encoding whole texts chunk by chunk, with a bounded cache."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space beside a place where the text would be cut, or at its ends; no text.
_ODD = re.compile(r"(?:^| )(?:\s|$)|\s(?: |$)")
#: A single line feed between characters that aren't white space.
_LINE = re.compile(r"(?<=\S)\n(?=\S)")
#: Characters of the texts whose chunks are encoded in one call.
GROUP = 1 << 22
#: What may follow a word as one match of the pattern; not the apostrophe, with which some matches open.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


class Chunked:
    """Encodes a text as the concatenation of its chunks' encodings, each chunk encoded once while it stays cached.

    A chunk is what lies between single spaces, with the space before it. The pattern of byte-level BPE lets no match
    cross the place before a space that stands between two characters that aren't white space: a space opens a match
    (" ?\\p{L}+" and its like), and nothing but white space goes on over one. So cutting there changes no match. A single line feed between
    two such characters is a match by itself; it opens a chunk as well. Where a chunk is empty or has other white space at an edge, it is joined
    with what surrounds it, and encoded as one.

    Arrow cuts some texts at once, numbers their distinct chunks and gathers the encodings in the texts' order; Python sees distinct chunks only.
    A full cache keeps the chunks of the texts at hand, among which are the frequent ones.
    """

    def __init__(self, split: Callable[[str], list[str]], encode_pretokens: Callable[[list[str]], list[bytes]], most: int = 700_000, words: bool = True):
        """split: a chunk's matches; words: whether letters with the space before them are one match, and _MARKS after them another."""
        self.split, self.encode_pretokens, self.most, self.words = split, encode_pretokens, most, words
        #: By chunk: without its space, or with its line feed.
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The encoding of each text. Chunks that aren't cached are encoded together, for some texts at once."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP:
                yield from self._some(group)
                group, size = [], 0
        if group:
            yield from self._some(group)

    def _some(self, texts: list[str]) -> list[bytes]:
        easy = [k for k, t in enumerate(texts) if plain(t)]
        held = set(easy)
        odd = [k for k in range(len(texts)) if k not in held]
        lists = [pc.split_pattern(pa.array([spaced(texts[k]) for k in easy], pa.large_string()), " ")]
        lists.append(pa.array([chunks(texts[k]) for k in odd], lists[0].type))
        parts = pa.concat_arrays(lists)
        places, words = parts.offsets.to_numpy(), parts.values
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.cache.get, distinct))
        if None in ids:
            fresh = [p for p, x in zip(distinct, ids) if x is None]
            new = dict(zip(fresh, self._chunks(fresh)))
            ids = [new[p] if x is None else x for p, x in zip(distinct, ids)]
            if len(self.cache) + len(new) > self.most:
                self.cache = dict(zip(distinct, ids))
            else:
                self.cache.update(new)
        run = pa.array(ids, pa.large_binary()).take(coded.indices)
        at = np.frombuffer(run.buffers()[1], np.int64)[run.offset : run.offset + len(run) + 1]
        raw = memoryview(run.buffers()[2] or b"")
        firsts = words.take(pa.array(places[:-1])).to_pylist()
        openings = list(set(firsts))
        first = dict(zip(openings, self._pieces(list(map(self.split, openings)))))
        starts, ends = at[places[:-1] + 1].tolist(), at[places[1:]].tolist()
        out: list[bytes] = [b""] * len(texts)
        for k, word, a, b in zip([*easy, *odd], firsts, starts, ends):
            out[k] = first[word] + raw[a:b]
        return out

    def _chunks(self, parts: list[str]) -> list[bytes]:
        """Encodings of distinct chunks that aren't cached."""
        if not self.words:
            return self._pieces([self.split(p if p[:1] == "\n" else " " + p) for p in parts])
        known, get = {}, self.cache.get
        alone, marked, others = [], [], []
        for p in parts:
            if p.isalpha():
                alone.append(p)
                continue
            word = p.rstrip(_MARKS)
            if word.isalpha():
                marked.append((p, word, p[len(word) :]))
            else:
                others.append(p)
        bodies = {w for _, w, _ in marked}.difference(alone)
        ids = list(map(get, bodies := list(bodies)))
        known.update((w, x) for w, x in zip(bodies, ids) if x is not None)
        alone += [w for w, x in zip(bodies, ids) if x is None]
        known.update(zip(alone, self.encode_pretokens([" " + w for w in alone])))
        marks = list({m for _, _, m in marked})
        after = dict(zip(marks, self.encode_pretokens(marks)))
        if len(self.cache) < self.most:
            self.cache.update((w, known[w]) for w, x in zip(bodies, ids) if x is None)
        known.update([(p, known[w] + after[m]) for p, w, m in marked])
        known.update(zip(others, self._pieces([self.split(p if p[:1] == "\n" else " " + p) for p in others])))
        return list(map(known.__getitem__, parts))

    def _pieces(self, runs: list[list[str]]) -> list[bytes]:
        """Of each run of matches their encodings, joined; each distinct match is encoded once."""
        distinct = list({x for run in runs for x in run})
        known = dict(zip(distinct, self.encode_pretokens(distinct)))
        return [known[run[0]] if len(run) == 1 else b"".join(map(known.__getitem__, run)) for run in runs]


def plain(text: str) -> bool:
    """Whether the text may be cut at every space: none stands beside white space or at an end."""
    if not text or text[0].isspace() or text[-1].isspace() or "  " in text or "\n " in text or " \n" in text:
        return False
    # Space is the only white space that is printable.
    return text.isprintable() or text.replace("\n", "").isprintable() or not _ODD.search(text)


def spaced(text: str) -> str:
    """A plain text with a space before each line feed that opens a chunk."""
    if "\n" not in text:
        return text
    simple = "\n\n" not in text and text.replace("\n", "").isprintable()
    return text.replace("\n", " \n") if simple else _LINE.sub(" \n", text)


def chunks(text: str) -> list[str]:
    """The text's chunks, all but the first without the space that they begin with; joined by spaces they are the text."""
    parts = text.split(" ")
    if plain(text):
        return parts
    out = [parts[0]]
    loose = not parts[0] or parts[0][-1].isspace()  # whether the chunk so far can't be closed
    for part in parts[1:]:
        if loose or not part or part[0].isspace():
            out[-1] += " " + part
        else:
            out.append(part)
        loose = not part or part[-1].isspace()
    return out

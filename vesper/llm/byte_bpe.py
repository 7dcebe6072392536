"""Token ids of a byte-level BPE file, for many texts at once.

The pattern that splits text before the merges makes runs of one kind of character (letters, numbers, white
space, others), with a space before them and a few contractions set apart. Here the cuts of all texts of a block are
found in arrays, equal parts are encoded once, and their ids are remembered in a table of fixed size.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np

from ._bytes import U64, _grown, digested, mix

LETTER, NUMBER, SPACE, OTHER, UNSURE = range(5)
#: The pattern whose cuts are made here.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: A place at which every text may be cut without changing any part: white space after something else.
_SAFE = re.compile(r"(?<=\S)[ \n]")

BLOCK = 1 << 18
LONG = 1 << 20
LONG_PART = 512
SLOTS = 20
KEPT_IDS = 1 << 22


def _kinds() -> np.ndarray:
    """The kind of each code point of the first three planes; unassigned ones, which libraries see differently, are unsure."""
    letters = {"L": LETTER, "N": NUMBER}
    names = (unicodedata.category(chr(c)) for c in range(0x30000))
    out = np.fromiter((UNSURE if n in ("Cn", "Co", "Cs") else letters.get(n[0], OTHER) for n in names), np.uint8, 0x30000)
    out[_SPACES] = SPACE
    return out


def cuts(points: np.ndarray, kinds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where parts begin, in the code points of several texts that begin and end at ``bounds``."""
    n = len(points)
    new = np.ones(n + 1, dtype=bool)
    new[1:n] = kinds[1:] != kinds[:-1]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = new[bounds] = True
    # the last character of a run of white space is a part of its own, or the next part's first if it is the space
    last = np.flatnonzero((kinds == SPACE) & new[1:])
    last = last[~edge[last + 1]]
    new[last] = True
    new[last[points[last] == 32] + 1] = False
    # a quote alone that begins a part takes one or two letters after it
    quote = np.flatnonzero((points == 39) & new[:-1] & new[1:])
    quote = quote[~edge[quote + 1]]
    if len(quote):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = ((one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108)) & ~edge[np.minimum(quote + 2, n)]
        for chosen, size in ((quote[short], 2), (quote[pair], 3)):
            new[chosen + 1] = False
            new[chosen + size] = True
    return np.flatnonzero(new[:-1])


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library.

    The merges of parts are done by the tiktoken library on the file's own vocabulary; ``same_ids`` compares both on a
    probe, once on the driver. Texts with one of the file's special tokens or with a character that isn't assigned,
    parts that are very long, and files that aren't byte-level BPE with ``PATTERN`` go to the file's own library.
    """

    PROBE = "It's  a\tprobe,\n\n of 12345 naïve — “quotes”, Überß ñandú, 日本語 😀 and   runs...   "

    def __init__(self, path: str, pattern: str, trusted: bool) -> None:
        self.path, self._own, self.fast = path, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        if not trusted or pattern != PATTERN:
            return
        import tiktoken

        try:
            back = _byte_of_char()
            ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        except (KeyError, ValueError):
            return
        self.size_of = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.size_of[list(ranks.values())] = [len(b) for b in ranks]
        self.kinds = _kinds()
        self._forget()

    def _forget(self) -> None:
        self.key = np.zeros(1 << SLOTS, dtype=U64)
        self.at = np.zeros(1 << SLOTS, dtype=np.int32)
        self.number = np.zeros(1 << SLOTS, dtype=np.int32)
        self.kept, self.used = np.zeros(1 << 16, dtype=np.uint32), 0

    @property
    def own(self):
        if self._own is None:
            from tokenizers import Tokenizer

            self._own = Tokenizer.from_file(self.path)
        return self._own

    def own_ids(self, text: str) -> np.ndarray:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def same_ids(self) -> bool:
        return self.fast is not None and self.ids(self.PROBE).tolist() == self.own_ids(self.PROBE).tolist()

    def ids(self, text: str) -> np.ndarray:
        return next(self.all_ids([text]))

    def all_ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        if self.fast is None:
            yield from map(self.own_ids, texts)
            return
        pieces: list[tuple[int, str]] = []  # (text, part of it)
        size, first = 0, 0
        for i, text in enumerate(texts):
            at = 0
            while len(text) - at > LONG and (m := _SAFE.search(text, at + LONG)):
                pieces.append((i, text[at : m.start()]))
                at = m.start()
            pieces.append((i, text[at:] if at else text))
            size += len(text)
            if size >= BLOCK or i + 1 == len(texts):
                yield from self._texts(first, i + 1, pieces)
                pieces, size, first = [], 0, i + 1

    def _texts(self, first: int, last: int, pieces: list[tuple[int, str]]) -> Iterator[np.ndarray]:
        odd = {i for i, part in pieces if any(s[:2] in part and s in part for s in self.special)}
        got: dict[int, list] = {i: [] for i in range(first, last)}
        whole: dict[int, list] = {}
        run: list[tuple[int, str]] = []
        size = 0
        for i, part in [*pieces, (-1, "")]:
            if run and (i < 0 or size + len(part) > LONG + BLOCK):
                for (j, _), ids in zip(run, self._block([p for _, p in run])):
                    if ids is None:
                        odd.add(j)
                    got[j].append(ids)
                run, size = [], 0
            if i >= 0 and i not in odd:
                run.append((i, part))
                size += len(part)
        for i in odd:
            whole[i] = [part for j, part in pieces if j == i]
        for i in range(first, last):
            if i in odd:
                yield self.own_ids("".join(whole[i]))
            else:
                yield got[i][0] if len(got[i]) == 1 else np.concatenate(got[i]) if got[i] else np.zeros(0, np.uint32)

    def _block(self, texts: list[str]) -> Iterator[np.ndarray | None]:
        """Ids of each text; None where a character is not assigned."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        if not len(points):
            yield from (np.zeros(0, np.uint32) for _ in texts)
            return
        kinds = self.kinds[np.minimum(points, len(self.kinds) - 1)]
        unsure = np.concatenate([[0], np.cumsum((kinds == UNSURE) | (points >= len(self.kinds)))])[bounds]
        starts = cuts(points, kinds, bounds)
        ends = np.append(starts[1:], len(points))
        powers, inverses = _grown(len(points))
        sums = np.zeros(len(points) + 1, dtype=U64)
        with np.errstate(over="ignore"):
            np.cumsum((points.astype(U64) + U64(1)) * powers[: len(points)], out=sums[1:])
            hashes = mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(U64))
        hashes = digested(hashes, points, starts, ends) | U64(1)
        if self.used > KEPT_IDS:
            self._forget()
        slot = (hashes >> U64(64 - SLOTS)).astype(np.int64)
        at, number = self.at[slot], self.number[slot]
        missing = np.flatnonzero(self.key[slot] != hashes)
        if len(missing):
            found, which, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            place = missing[which]
            wide = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
            flat, begin, sizes = self._parts([joined[a:b] for a, b in zip(starts[place].tolist(), ends[place].tolist())], kinds[ends[place] - 1] == SPACE, wide[ends[place]] - wide[starts[place]])
            if self.used + len(flat) > len(self.kept):
                self.kept = np.concatenate([self.kept, np.zeros(max(len(self.kept), len(flat)), np.uint32)])
            self.kept[self.used : self.used + len(flat)] = flat
            begin += self.used
            self.used += len(flat)
            self.key[slot[place]], self.at[slot[place]], self.number[slot[place]] = found, begin, sizes
            at[missing], number[missing] = begin[back], sizes[back]
        total = np.cumsum(number, dtype=np.int64)
        ids = self.kept[np.arange(total[-1]) + np.repeat(at - (total - number), number)]
        ends_of = np.concatenate([[0], total])[np.searchsorted(starts, bounds)]
        for i in range(len(texts)):
            yield None if unsure[i + 1] > unsure[i] else ids[ends_of[i] : ends_of[i + 1]]

    def _parts(self, parts: list[str], spaces: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct parts of so many bytes, of which some are white space: all ids, and where each part's begin and how many they are."""
        begin, number = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        apart = spaces | (sizes > LONG_PART)
        out, used = [], 0
        for i in np.flatnonzero(apart).tolist():
            ids = np.array(self.fast.encode_ordinary(parts[i]), dtype=np.uint32) if sizes[i] <= LONG_PART else self.own_ids(parts[i])
            begin[i], number[i] = used, len(ids)
            out.append(ids)
            used += len(ids)
        plain = np.flatnonzero(~apart)
        if len(plain):
            # one call for all: parts that begin with a space keep apart by themselves, a line feed sets the others apart
            said = [p if (p := parts[i])[0] == " " else "\n" + p for i in plain.tolist()]
            ids = np.array(self.fast.encode_ordinary("".join(said)), dtype=np.uint32)
            fed = np.fromiter((s[0] == "\n" for s in said), bool, len(said))
            at = np.concatenate([[0], np.cumsum(self.size_of[ids])])
            to = np.cumsum(sizes[plain] + fed)
            first, last = np.searchsorted(at, to - sizes[plain]), np.searchsorted(at, to)
            begin[plain], number[plain] = used + first, last - first
            out.append(ids)
        return np.concatenate(out), begin, number


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE files write each byte as a printable character: itself where it is one, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in printable}
    out.update({chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))})
    return out


_encoders: dict[tuple[str, str, bool], Encoder] = {}


def encoder(path: str, pattern: str, trusted: bool) -> Encoder:
    """One encoder a process for each file."""
    made = _encoders.get((path, pattern, trusted))
    if made is None:
        made = _encoders[path, pattern, trusted] = Encoder(path, pattern, trusted)
    return made

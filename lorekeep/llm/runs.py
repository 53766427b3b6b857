"""Front-coded sorted runs of byte strings, and their merge by loser trees that know common prefixes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

_HEAD = struct.Struct("<HHQI")


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, given that ``known`` bytes agree."""
    end = min(len(a), len(b))
    gap = int.from_bytes(a[known:end], "big") ^ int.from_bytes(b[known:end], "big")
    return end - (gap.bit_length() + 7) // 8 if gap else end


def encode_run(strings: list[bytes], tags: list[int], counts: list[int]) -> bytes:
    """A sorted run: each string as the length it shares with the one before it, and the rest."""
    out, last = [], b""
    for s, tag, n in zip(strings, tags, counts):
        shared = common_prefix(last, s)
        out.append(_HEAD.pack(shared, len(s) - shared, tag, n))
        out.append(s[shared:])
        last = s
    return b"".join(out)


def decode_run(block: bytes) -> Iterator[tuple[int, bytes, int, int]]:
    """(shared with the one before, string, tag, count) of a run."""
    at, last = 0, b""
    while at < len(block):
        shared, rest, tag, n = _HEAD.unpack_from(block, at)
        at += _HEAD.size
        last = last[:shared] + block[at : at + rest]
        at += rest
        yield shared, last, tag, n


class LoserTree:
    """Merge of runs in order; a node keeps the loser and what it shares with the string that beat it.

    Candidates that meet share known prefixes with the last string given out.
    The longer share wins unread; only at equal shares are bytes read, from
    there on, so no known prefix is compared again.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, int, int]]]):
        self.runs = runs
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.now: list[tuple | None] = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.shared = [0] * self.size
        self.losers = [-1] * self.size
        self.winner = self._first(1)

    def _first(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._first(2 * node), self._first(2 * node + 1)
        win, lose = self._play(a, b)
        self.losers[node] = lose
        return win

    def _play(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.now[a], self.now[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = self.shared[a], self.shared[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        s, t = x[1], y[1]
        n = common_prefix(s, t, p)
        # A prefix of the other comes first.
        if n == len(s) or (n < len(t) and s[n] < t[n]):
            self.shared[b] = n
            return a, b
        self.shared[a] = n
        return b, a

    def __iter__(self) -> Iterator[tuple[int, int, bytes, int, int]]:
        """(run, shared with the string before, string, tag, count) in ascending order."""
        while self.now[self.winner] is not None:
            w = self.winner
            _, s, tag, n = self.now[w]
            yield w, self.shared[w], s, tag, n
            self.now[w] = item = next(self.runs[w], None)
            self.shared[w] = item[0] if item else 0
            node = (w + self.size) // 2
            while node:
                win, lose = self._play(w, self.losers[node])
                self.losers[node] = lose
                w = win
                node //= 2
            self.winner = w

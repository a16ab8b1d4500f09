"""Front-coded sorted runs of byte strings, and their merge by a loser tree that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterator


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> list[tuple[int, bytes]]:
    """A sorted run as (prefix shared with the string before, rest)."""
    out, last = [], b""
    for s in strings:
        n = common_prefix(last, s)
        out.append((n, s[n:]))
        last = s
    return out


class _Run:
    """The head of a run: its string, and the prefix it is known to share with the last string put out."""

    __slots__ = ("head", "items", "known", "value")

    def __init__(self, items: Iterator[tuple[int, bytes, object]]):
        self.items, self.head, self.known, self.value = items, b"", 0, None
        self.advance()

    def advance(self) -> None:
        """The new head's shared prefix with the old one, just put out, is what the run's coding says."""
        nxt = next(self.items, None)
        if nxt is None:
            self.head = None
        else:
            n, rest, self.value = nxt
            self.head, self.known = self.head[:n] + rest, n


def merge(runs: list[Iterator[tuple[int, bytes, object]]]) -> Iterator[tuple[int, bytes, object]]:
    """All strings in order as (prefix shared with the one before, string, value).

    Of two heads, that which shares more with the last string put out is the smaller; only
    when both share as much are bytes compared, and only beyond that prefix. The loser of
    a match keeps the prefix it shares with the winner.
    """
    heads = [r for r in map(_Run, runs) if r.head is not None]
    k = len(heads)
    if not k:
        return
    tree: list[int] = [-1] * k  # losers; -1: no run has come here yet

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = heads[a], heads[b]
        if x.head is None:
            return b, a
        if y.head is None:
            return a, b
        if x.known != y.known:
            return (a, b) if x.known > y.known else (b, a)
        s, t, n = x.head, y.head, x.known
        if s[n : n + 16] == t[n : n + 16]:
            n += common_prefix(s[n:], t[n:])
        else:
            while n < len(s) and n < len(t) and s[n] == t[n]:
                n += 1
        if s[n:] <= t[n:] if n == len(s) or n == len(t) else s[n] < t[n]:
            y.known = n
            return a, b
        x.known = n
        return b, a

    def seed(node: int) -> int:
        if node >= k:
            return node - k
        won, tree[node] = play(seed(2 * node), seed(2 * node + 1))
        return won

    winner = seed(1) if k > 1 else 0
    while (run := heads[winner]).head is not None:
        yield run.known, run.head, run.value
        run.advance()
        node = (winner + k) // 2 if k > 1 else 0
        while node:
            winner, tree[node] = play(winner, tree[node])
            node //= 2

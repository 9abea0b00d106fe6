"""A run-length FM-index in numpy: run-compressed BWT, sampled run ends, streamed matching statistics.

The text is many short pieces of UTF-8, each ended by a separator byte that UTF-8 never holds. Kept are the runs of
its Burrows-Wheeler transform (start, symbol, image of the start under the LF mapping), the text positions at both
ends of each run, and the text itself, one byte a symbol, by which jumps are compared. The suffix order is needed
while building only.

Patterns are streamed from right to left, all at once: while the next symbol extends the match, the row follows
the LF mapping inside its run; otherwise it jumps to the nearer sampled end of a run of that symbol, the one
that keeps the longer match. Each step leaves, for every pattern, a text position and the length of a match.
Lengths are exact up to ``cap`` symbols; a longer match is given as ``cap`` or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Fixed value: the separator, a byte that UTF-8 does not use.
SEPARATOR = 0xFF


def _words(text: np.ndarray, kind: str) -> np.ndarray:
    """The eight bytes from every position on as one number; a view, without a copy of the text."""
    return np.ndarray(shape=(len(text) - 7,), dtype=kind, buffer=text, strides=(1,))


def _suffix_order(text: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Positions by the symbols up to the next separator, then by place; ``rest`` counts those symbols."""
    n, longest = len(rest), int(rest.max())
    key = _words(text, ">u8")[:n].astype(np.uint64)
    short = np.flatnonzero(rest < 8)
    key[short] &= ~np.uint64(0) << (np.uint64(8) * (np.uint64(8) - rest[short].astype(np.uint64)))
    step, key = 8, key
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.zeros(n, np.int64)
        np.cumsum(ranked[1:] != ranked[:-1], out=new[1:])
        if step >= longest or new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        key = rank * np.int64(n + 1)
        on = np.flatnonzero(rest > step)
        key[on] += rank[on + step] + 1
        step *= 2


class RunLengthIndex:
    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, cap: int = 64):
        """Of pieces data[start : start + length], UTF-8 bytes."""
        n = int(lengths.sum()) + len(lengths)
        self.cap = -(-cap // 8) * 8
        text = np.full(n + self.cap + 8, SEPARATOR, np.uint8)
        self.piece_start = np.cumsum(lengths + 1) - lengths - 1
        at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        text[np.repeat(self.piece_start, lengths) + at] = data[np.repeat(starts, lengths) + at]
        rest = np.repeat(self.piece_start + lengths + 1, lengths + 1) - np.arange(n)
        suffixes = _suffix_order(text, rest)
        bwt = text[suffixes - 1]  # before the first piece stands the padding, a separator too
        self.text, self.n = text, n
        self.run_start = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.run_symbol = bwt[self.run_start].astype(np.int64)
        self.run_end = np.concatenate([self.run_start[1:], [n]]) - 1
        self.first_pos, self.last_pos = suffixes[self.run_start], suffixes[self.run_end]
        # LF: the rows that begin with a symbol stand in the order of the rows that it precedes.
        self.symbol_runs = np.argsort(self.run_symbol, kind="stable")
        sizes = (self.run_end - self.run_start + 1)[self.symbol_runs]
        self.run_image = np.empty(len(sizes), np.int64)
        self.run_image[self.symbol_runs] = np.cumsum(sizes) - sizes
        self.n_runs = len(sizes)
        self.symbol_keys = self.run_symbol[self.symbol_runs] * (self.n_runs + 1) + self.symbol_runs

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common symbols from text positions a and b on, exact up to ``most`` and to the cap."""
        words = _words(self.text, "<u8")
        out, on = np.zeros(len(a), np.int64), np.arange(len(a))
        for step in range(0, self.cap, 8):
            differ = words[a[on] + step] ^ words[b[on] + step]
            same = differ == 0
            low = differ & (~differ + np.uint64(1))  # the lowest bit in which they differ
            out[on] = step + np.where(same, 8, np.log2(np.maximum(low, 1)).astype(np.int64) >> 3)
            on = on[same & (most[on] > step + 8)]
            if not len(on):
                break
        return np.minimum(out, most)

    def matching_statistics(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Yields (pattern numbers, offset from each start, text positions, match lengths), offsets falling."""
        m = len(starts)
        row, pos, held = np.zeros(m, np.int64), np.full(m, int(self.first_pos[0]), np.int64), np.zeros(m, np.int64)
        order = np.argsort(-lengths, kind="stable")
        longest = int(lengths.max()) if m else 0
        sorted_len = -lengths[order]
        for back in range(1, longest + 1):
            who = order[: int(np.searchsorted(sorted_len, -back, side="right"))]  # patterns with a symbol left
            symbol = data[starts[who] + lengths[who] - back].astype(np.int64)
            r, p, h = row[who], pos[who], held[who]
            run = np.searchsorted(self.run_start, r, side="right") - 1
            miss = np.flatnonzero(self.run_symbol[run] != symbol)
            lost = np.zeros(len(who), bool)
            if len(miss):
                key = symbol[miss] * (self.n_runs + 1) + run[miss]
                at = np.searchsorted(self.symbol_keys, key)
                below, above = np.minimum(at, self.n_runs - 1), np.maximum(at - 1, 0)
                rb, ra = self.symbol_runs[below], self.symbol_runs[above]
                has_below = (at < self.n_runs) & (self.run_symbol[rb] == symbol[miss])
                has_above = (at > 0) & (self.run_symbol[ra] == symbol[miss])
                lb = np.where(has_below, self.extension(p[miss], self.first_pos[rb], h[miss]), -1)
                la = np.where(has_above, self.extension(p[miss], self.last_pos[ra], h[miss]), -1)
                down = lb > la
                run[miss] = np.where(down, rb, ra)
                r[miss] = np.where(down, self.run_start[rb], self.run_end[ra])
                p[miss] = np.where(down, self.first_pos[rb], self.last_pos[ra])
                h[miss] = np.maximum(lb, la)
                lost[miss] = ~(has_below | has_above)
            row[who] = np.where(lost, 0, self.run_image[run] + r - self.run_start[run])
            pos[who] = np.where(lost, int(self.first_pos[0]), p - 1)
            held[who] = np.where(lost, 0, h + 1)
            yield who, lengths[who] - back, pos[who], held[who]

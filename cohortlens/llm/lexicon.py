"""A minimal acyclic transducer from words to token ids.

Words are added in sorted order; whenever a branch is finished, its states
are replaced by equal ones that exist already, so suffixes are shared. Each
transition carries how many words sort before those behind it. The sum along
a word's path is the word's number, which selects its ids from a table. The
whole lexicon is one array of integers, which tasks map into memory.
"""

from __future__ import annotations

import numpy as np


def build(words: list[bytes], ids: list[list[int]]) -> np.ndarray:
    """The lexicon of different ``words`` as one array: sizes, then the tables."""
    order = sorted(range(len(words)), key=words.__getitem__)
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, state), ...))
    count: list[int] = []  # words accepted from each state

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        at = register.get(key)
        if at is None:
            at = register[key] = len(states)
            states.append(key)
            count.append(node[0] + sum(count[s] for _, s in node[1]))
        return at

    path: list[list] = [[0, []]]  # open states: final, settled transitions
    last = b""
    for k in order:
        w = words[k]
        same = 0
        for x, y in zip(w, last):  # noqa: B905
            if x != y:
                break
            same += 1
        while len(path) > same + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(node)))
        path.extend([0, []] for _ in range(len(w) - same))
        path[-1][0], last = 1, w
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], settle(node)))
    root = settle(path[0])
    key, to, skip = [], [], []
    for s, (final, edges) in enumerate(states):
        before = final
        for byte, target in edges:
            key.append(s << 8 | byte)
            to.append(target)
            skip.append(before)
            before += count[target]
    flat = [i for k in order for i in ids[k]]
    offs = np.cumsum([0] + [len(ids[k]) for k in order])
    parts = [key, to, skip, [f for f, _ in states], offs, flat]
    sizes = [len(p) for p in parts]
    return np.concatenate([np.array([root, *sizes], np.int64)] + [np.array(p, np.int64) for p in parts])


class Lexicon:
    def __init__(self, table: np.ndarray):
        self.root, sizes = int(table[0]), table[1:7]
        at = np.concatenate([[0], np.cumsum(sizes)]) + 7
        self.key, self.to, self.skip, self.final, self.offs, self.flat = (table[a:b] for a, b in zip(at[:-1], at[1:], strict=True))

    def find(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where the lexicon lacks it."""
        state, number = np.full(len(starts), self.root), np.zeros(len(starts), np.int64)
        live = np.arange(len(starts)) if len(self.key) else np.zeros(0, np.int64)
        if not len(self.key):
            return np.full(len(starts), -1)
        step = 0
        out = np.full(len(starts), -1)
        while len(live):
            done = lens[live] == step
            end = live[done]
            ok = end[self.final[state[end]] == 1]
            out[ok] = number[ok]
            live = live[~done]
            want = (state[live] << 8) | data[starts[live] + step]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[at] == want
            live, at = live[hit], at[hit]
            state[live] = self.to[at]
            number[live] += self.skip[at]
            step += 1
        return out

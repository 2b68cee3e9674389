"""Burrows-Wheeler transforms of block strings and their merge by interleave refinement.

A text is read as ``stride`` strings of blocks: the blocks at positions i, i + stride, i +
2 * stride and so on, each a symbol. A window of ``depth`` blocks is then ``depth`` symbols
of one string, so windows at every byte are compared in ``depth`` rounds.

Two transforms, each of one shard's strings in suffix order, are merged without sorting
suffixes of both: the interleave (which shard the n-th suffix comes from) starts as one shard
after the other, and each round deals its entries out by the symbol before them. After round
h it is right for prefixes of h symbols. A border between neighbours that first shows in
round h means a common prefix of h - 1 symbols; neighbours without a border after ``depth``
rounds are a repeated interval.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from offerwise.llm.shingles import prefix_sums, spans


@dataclass
class Transform:
    """Symbols before each suffix of a shard in suffix order, and the suffixes themselves."""

    before: np.ndarray
    suffix: np.ndarray


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def transform(symbol: np.ndarray, after: np.ndarray, depth: int) -> Transform:
    """The transform of strings given as nodes: ``symbol`` (from 1) of each node and the node
    ``after`` it (-1: none). Each string gets an end, symbol 0; ends are numbered behind the
    nodes, in the order of their strings' first nodes."""
    n = len(symbol)
    first = np.ones(n, dtype=bool)
    first[after[after >= 0]] = False
    before = np.zeros(n, dtype=np.int64)
    linked = np.flatnonzero(after >= 0)
    before[after[linked]] = symbol[linked]
    rank, jump, reach = symbol.astype(np.int64), after.copy(), 1
    while reach < depth or (jump >= 0).any():
        held = np.where(jump >= 0, rank[jump] + 1, 0)
        rank = _dense(rank * (held.max(initial=0) + 1) + held)
        jump = np.where(jump >= 0, jump[jump], -1)
        reach *= 2
    order = np.lexsort((np.arange(n), rank))
    # ends: one for each string, ordered as the strings' beginnings are
    starts = order[first[order]]
    last = np.arange(n)
    hop = after.copy()
    while (hop >= 0).any():
        last = np.where(hop >= 0, last[hop], last)
        hop = np.where(hop >= 0, hop[hop], -1)
    ends_before = symbol[last[starts]]
    return Transform(
        np.concatenate([ends_before, before[order]]).astype(np.int64),
        np.concatenate([np.full(len(starts), -1, dtype=np.int64), order]),
    )


def merge(left: Transform, right: Transform, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, border): the shard of every merged suffix, and the round in which a border
    before it first showed (0: none within ``depth`` rounds)."""
    total = len(left.before) + len(right.before)
    interleave = np.zeros(total, dtype=np.int8)
    interleave[len(left.before) :] = 1
    group = np.zeros(total, dtype=np.int64)
    border = np.zeros(total, dtype=np.int64)
    for step in range(1, depth + 1):
        of_right = interleave == 1
        symbols = np.empty(total, dtype=np.int64)
        symbols[~of_right] = left.before
        symbols[of_right] = right.before
        order = np.argsort(symbols, kind="stable")
        interleave, symbols, group = interleave[order], symbols[order], group[order]
        new = np.ones(total, dtype=bool)
        new[1:] = (symbols[1:] != symbols[:-1]) | (group[1:] != group[:-1])
        border[new & (border == 0)] = step
        group = np.cumsum(new)
    return interleave, border


def repeated_windows(texts: list[bytes], window: int, stride: int) -> list[np.ndarray]:
    """Per text, the starts of its windows that also start elsewhere in the texts."""
    depth = window // stride
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]
    of = np.repeat(np.arange(len(texts)), ends - begins)
    at = np.arange(len(data))
    whole = at + stride <= ends[of]
    place = at[whole]
    sums = prefix_sums(data)
    _, kind, often = np.unique(
        spans(sums, place, place + stride), return_inverse=True, return_counts=True
    )
    symbol = np.zeros(len(data) + window, dtype=np.int64)
    symbol[place[often[kind] > 1]] = kind[often[kind] > 1] + 1
    # windows of which every block repeats, and the blocks of such windows
    alive = at + window <= ends[of]
    for k in range(depth):
        alive &= symbol[at + k * stride] > 0
    starts = np.flatnonzero(alive)
    none = np.empty(0, dtype=np.int64)
    if not len(starts):
        return [none] * len(texts)
    node = np.zeros(len(data) + window, dtype=bool)
    for k in range(depth):
        node[starts + k * stride] = True
    nodes = np.flatnonzero(node)
    number = np.full(len(data) + window, -1, dtype=np.int64)
    number[nodes] = np.arange(len(nodes))
    follows = number[nodes + stride]
    same = follows >= 0
    same[same] = of[nodes[follows[same]]] == of[nodes[same]]
    follows = np.where(same, follows, -1)
    marks = _dense(symbol[nodes]) + 1
    shard = of[nodes] % 2
    parts, own = [], []
    for side in (0, 1):
        mine = np.flatnonzero(shard == side)
        back = np.full(len(nodes), -1, dtype=np.int64)
        back[mine] = np.arange(len(mine))
        after = np.where(follows[mine] >= 0, back[follows[mine]], -1)
        parts.append(transform(marks[mine], after, depth))
        own.append(mine)
    interleave, border = merge(parts[0], parts[1], depth)
    suffix = np.empty(len(interleave), dtype=np.int64)
    for side in (0, 1):
        held = parts[side].suffix
        suffix[interleave == side] = np.where(held >= 0, own[side][held], -1) if len(held) else -1
    interval = np.cumsum(border > 0)
    full = suffix >= 0
    full[full] = alive[nodes[suffix[full]]]
    size = np.bincount(interval[full], minlength=interval[-1] + 1)
    twice = full & (size[interval] > 1)
    found = np.sort(nodes[suffix[twice]])
    cut = np.searchsorted(found, np.append(begins, len(data)))
    return [found[a:b] - s for a, b, s in zip(cut, cut[1:], begins, strict=False)]

"""Suffix arrays by linear grouping, for many strings at once.

Phase 1 takes groups of suffixes in descending order. Every suffix of a group finds the nearest
suffix to its left that is in a lower group (its previous-smaller pointer, which skips over all
suffixes settled so far); the suffixes pointed at leave their group for new ones right above it,
by how many pointers they got. In the end a group holds the suffixes of one Lyndon prefix. Phase 2
goes through the order as it emerges and emits, along the pointers, each suffix into the next free
place of its group. No ranks are renamed and nothing recurses.

Both phases are inherently sequential within a string, so they run in lock-step over all strings of
a batch: one numpy operation handles the current group, or the current suffix, of every string.
"""

from __future__ import annotations

import numpy as np

#: About how long one symbol takes by itself, and how long one step takes however many strings share it.
ONE_BY_ONE, IN_STEP = 5, 50


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def suffix_arrays(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Suffix arrays of non-negative integer strings, one behind the other, and where each begins.

    Values are positions within the string. A string's end sorts before every symbol. The few
    longest strings, for which lock-step has hardly anything to share, are sorted one by one.
    """
    lens = np.array([len(x) for x in strings], np.int64)
    order = np.argsort(-lens, kind="stable")
    sizes = np.append(lens[order], 0)
    ahead = np.cumsum(sizes) - sizes
    alone = int(np.argmin(ONE_BY_ONE * ahead + IN_STEP * sizes)) if len(strings) else 0
    if not alone:
        return _in_step(strings)
    begins = np.cumsum(lens) - lens
    out = np.empty(int(lens.sum()), np.int64)
    for k in order[:alone].tolist():
        out[begins[k] : begins[k] + lens[k]] = one_suffix_array(strings[k])
    rest = order[alone:].tolist()
    found, at = _in_step([strings[k] for k in rest])
    for k, b in zip(rest, at.tolist(), strict=True):
        out[begins[k] : begins[k] + lens[k]] = found[b : b + lens[k]]
    return out, begins


def one_suffix_array(string: np.ndarray) -> list[int]:
    """The same construction for one string, suffix by suffix."""
    n = len(string)
    symbol = np.concatenate(([-1], np.asarray(string, np.int64) + 1, [0]))
    order = np.argsort(symbol, kind="stable")
    heads = np.flatnonzero(np.concatenate(([True], np.diff(symbol[order]) != 0)))
    width = np.diff(np.append(heads, n + 2))
    sizes = np.zeros(n + 2, np.int64)
    sizes[heads] = width
    groups, places = np.empty(n + 2, np.int64), np.empty(n + 2, np.int64)
    groups[order] = np.repeat(heads, width)
    places[order] = np.arange(n + 2)
    at, size, group, place = order.tolist(), sizes.tolist(), groups.tolist(), places.tolist()
    group[0] = -1
    prev = list(range(-1, n + 1))
    end = n + 2
    while end > 2:
        low = group[at[end - 1]]
        pointed: dict[int, int] = {}
        for i in sorted(at[low:end]):
            p = i - 1
            while group[p] >= low:
                p = prev[p]
            prev[i] = p
            if p:
                pointed[p] = pointed.get(p, 0) + 1
        end = low
        leaving: dict[int, list] = {}
        for p, k in pointed.items():
            leaving.setdefault(group[p], []).append((k, p))
        for old, members in leaving.items():
            members.sort()
            target = old + size[old] - len(members)
            size[old] -= len(members)
            last = 0
            for k, p in members:
                q, was = at[target], place[p]
                at[was], place[q] = q, was
                at[target], place[p] = p, target
                if k != last:
                    last, head = k, target
                    size[head] = 0
                size[head] += 1
                group[p] = head
                target += 1
    out, free = [-1] * (n + 2), list(range(n + 2))
    done = [False] * (n + 2)
    done[0] = done[n + 1] = True
    out[1] = n + 1
    for row in range(1, n + 2):
        cell = out[row] - 1
        while not done[cell]:
            g = group[cell]
            out[free[g]] = cell
            free[g] += 1
            done[cell] = True
            cell = prev[cell]
    return [c - 1 for c in out[2:]]


def _in_step(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``suffix_arrays`` by lock-step."""
    lens = np.array([len(x) for x in strings], np.int64)
    order = np.argsort(-lens, kind="stable")
    # cells of a string: one ahead of it that is lower than all, its symbols, its end
    cells = lens[order] + 2
    first = np.cumsum(cells) - cells
    total = int(cells.sum())
    symbol = np.zeros(total, np.int64)
    symbol[first] = -1
    for f, k in zip(first.tolist(), order.tolist(), strict=True):
        symbol[f + 1 : f + 1 + lens[k]] = strings[k] + 1
    lane = np.repeat(np.arange(len(strings)), cells)
    top = int(symbol.max(initial=0)) + 2
    at = np.argsort(lane * top + symbol + 1, kind="stable")  # place -> cell; the cell ahead has a string's first place
    key = lane[at] * top + symbol[at]
    new = np.concatenate(([True], key[1:] != key[:-1])) if total else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    group_at = np.repeat(heads, np.diff(np.append(heads, total)))
    group = np.empty(total, np.int64)
    group[at] = group_at
    group[first] = -1
    size = np.zeros(total, np.int64)
    size[heads] = np.diff(np.append(heads, total))
    place = np.empty(total, np.int64)
    place[at] = np.arange(total)
    prev = np.arange(-1, total - 1)
    chosen = np.zeros(total, bool)

    # phase 1
    floor, end = first + 2, first + cells  # places of the cell ahead and of the string's end stay out
    while len(end):
        live = end > floor
        if not live.all():
            floor, end = floor[live], end[live]
            if not len(end):
                break
        low = group[at[end - 1]]
        sizes = end - low
        own = at[_ragged(low, sizes)]
        mine = np.repeat(low, sizes)
        end = low
        todo, level, ptr = own, mine, prev[own]
        while True:
            open_ = group[ptr] >= level
            if not open_.any():
                break
            todo, level, ptr = todo[open_], level[open_], ptr[open_]
            ptr = prev[ptr]
            prev[todo] = ptr
        hit = np.sort(prev[own])
        hit = hit[group[hit] >= 0]
        if not len(hit):
            continue
        edge = np.flatnonzero(np.concatenate(([True], hit[1:] != hit[:-1])))
        count = np.diff(np.append(edge, len(hit)))
        hit = hit[edge]
        old = group[hit]
        by = np.argsort(old * (int(count.max()) + 1) + count)
        hit, count, old = hit[by], count[by], old[by]
        fresh = np.concatenate(([True], old[1:] != old[:-1]))
        edge = np.flatnonzero(fresh)
        many = np.diff(np.append(edge, len(hit)))
        bottom = old[edge] + size[old[edge]] - many  # the top places of the old group are for those that leave
        target = _ragged(bottom, many)
        chosen[hit] = True
        held = at[target]
        stay = held[~chosen[held]]
        gone = place[hit]
        gone = gone[gone < np.repeat(bottom, many)]
        at[gone] = stay
        place[stay] = gone
        at[target] = hit
        place[hit] = target
        chosen[hit] = False
        size[old[edge]] -= many
        run = np.flatnonzero(fresh | np.concatenate(([True], count[1:] != count[:-1])))
        width = np.diff(np.append(run, len(hit)))
        head = target[run]
        size[head] = width
        group[hit] = np.repeat(head, width)

    # phase 2
    out = np.full(total, -1, np.int64)
    free = np.arange(total)  # by group: its next free place
    done = np.zeros(total, bool)
    done[first] = True
    place_of_end = first + 1
    out[place_of_end] = first + cells - 1
    done[first + cells - 1] = True
    row, last = place_of_end.copy(), first + cells - 1
    cell = out[row] - 1
    while len(row):
        act = ~done[cell]
        if act.all():
            put = cell
        else:
            put = cell[act]
        spot = group[put]
        to = free[spot]
        free[spot] = to + 1
        out[to] = put
        done[put] = True
        nxt = prev[cell]
        # lanes that put a suffix follow its pointer if that is open still, the others go on in the order
        follow = act & ~done[nxt]
        row = np.where(follow, row, row + 1)
        cell = np.where(follow, nxt, 0)
        ended = row > last
        if ended.any():
            keep = ~ended
            row, last, cell, follow = row[keep], last[keep], cell[keep], follow[keep]
            if not len(row):
                break
        go = np.flatnonzero(~follow)
        cell[go] = out[row[go]] - 1

    # back to the order of the input
    begins = np.cumsum(lens) - lens
    sa = np.empty(int(lens.sum()), np.int64)
    for f, k in zip(first.tolist(), order.tolist(), strict=True):
        sa[begins[k] : begins[k] + lens[k]] = out[f + 2 : f + 2 + lens[k]] - f - 1
    return sa, begins

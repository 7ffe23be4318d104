"""Suffix array by grouping: suffixes are sorted into groups of equal Lyndon prefix, groups are worked off in descending
order, and one ascending pass then emits the order inside the groups. No reduced string is renamed and sorted again."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers. A least end mark is added, so a suffix that is a prefix of another comes
    first. Time is linear in the length."""
    n = len(symbols) + 1
    text = np.zeros(n, dtype=np.int64)
    text[:-1] = np.asarray(symbols, dtype=np.int64) + 1
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    sizes = np.diff(np.append(first, n))
    begins = np.empty(n, dtype=np.int64)
    begins[order] = np.repeat(first, sizes)
    size_at = np.zeros(n + 1, dtype=np.int64)
    size_at[first] = sizes
    where = np.empty(n, dtype=np.int64)
    where[order] = np.arange(n)
    group, size, slot, place = begins.tolist(), size_at.tolist(), order.tolist(), where.tolist()
    smaller = [-1] * n  # previous position whose suffix is in a lower group

    end = n - 1
    while end > 0:
        begin = group[slot[end]]
        members = slot[begin : end + 1]
        if len(members) == 1:
            i = members[0]
            j = i - 1
            while j >= 0 and group[j] > begin:
                j = smaller[j]
            smaller[i] = j
            waves = ((j,),) if j >= 0 else ()
        else:
            members.sort()
            times: dict[int, int] = {}
            for i in members:
                j = i - 1
                while j >= 0 and group[j] > begin:
                    j = smaller[j]
                if j >= 0 and group[j] == begin:
                    j = smaller[j]
                smaller[i] = j
                if j >= 0:
                    times[j] = times.get(j, 0) + 1
            by_times: dict[int, list[int]] = {}
            for j, k in times.items():
                by_times.setdefault(k, []).append(j)
            waves = tuple(by_times[k] for k in sorted(by_times, reverse=True))
        for wave in waves:  # those followed by more members go above those followed by fewer
            for j in wave:
                g = group[j]
                last = g + size[g] - 1
                other, at = slot[last], place[j]
                slot[last], slot[at] = j, other
                place[j], place[other] = last, at
                size[g] -= 1
            for j in wave:
                g = group[j]
                new = g + size[g]
                if new == g:  # the whole group moved
                    continue
                group[j] = new
            for j in wave:
                size[group[j]] += 1
        end = begin - 1

    filled = [0] * (n + 1)
    out = [0] * n
    done = bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not done[i]:
            g = group[i]
            out[g + filled[g]] = i
            filled[g] += 1
            done[i] = 1
            i = smaller[i]
    return np.asarray(out[1:], dtype=np.int64)

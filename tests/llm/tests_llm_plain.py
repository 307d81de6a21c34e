"""Plain versions that the text operators are held against."""

from bisect import bisect_left, insort


def best_fit_decreasing(lengths, size):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fit = min(((g, i) for i, g in enumerate(gaps) if g >= x), default=None)
        if fit:
            gaps[fit[1]] -= x
        else:
            gaps.append(size - x)
    return len(gaps)


def jaccard_classes(texts):
    """For each text the position of the first of its class."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else None)
    label = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and len(x & sets[j]) / len(x | sets[j]) >= 0.8:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if k == old else k for k in label]
    return label


def rounds(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int]]:
    """Best-fit decreasing on counts of lengths: intervals of ranks as (first rank, number, first sequence, offset).

    Ranks are those of all pieces, longest first. A round takes the longest run that is left. Its successor is the run
    of the smallest gaps that hold a piece; lower ranks go there, as many to each gap as fit one after the other (what
    is left of a gap is then the smallest that still fits), and the rest of the run meets the next gaps. When no gap
    holds them, pieces open sequences.
    """
    out: list[tuple[int, int, int, int]] = []
    sizes: list[int] = []  # of gaps, ascending
    runs: dict[int, list[tuple[int, int]]] = {}  # size of gap to its runs of sequences (first, number)
    rank = sequences = 0
    for length in sorted(counts, reverse=True):
        number, fresh = counts[length], []
        while number:
            k = bisect_left(sizes, length)
            if k < len(sizes):
                gap = sizes[k]
                start, many = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], sizes[k]
            else:
                gap = size
                start, many = sequences, -(-number // (size // length))
                sequences += many
            each = gap // length
            full = min(many, number // each)
            rest = min(number - full * each, each - 1) if full < many else 0
            for groups, per in ((full, each), (int(rest > 0), rest)):
                if groups:
                    out.extend((rank + j * groups, groups, start, size - gap + j * length) for j in range(per))
                    rank += per * groups
                    number -= per * groups
                    fresh.append((gap - per * length, (start, groups)))
                    start, many = start + groups, many - groups
            if many:
                fresh.append((gap, (start, many)))
        for gap, run in fresh:
            if gap:
                if gap not in runs:
                    insort(sizes, gap)
                    runs[gap] = []
                runs[gap].append(run)
    return out

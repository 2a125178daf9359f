"""Character alignment of sentence pairs.

Links between equal characters, none crossing, as many as possible, optionally
only between positions less than `band` apart: a (banded) longest common
subsequence. Built-in functions cannot express the walk back through the table,
so it runs in an Arrow function, map-only, on whatever partitioning the pairs
already have. Repeated pairs of one batch are aligned once.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from misheard.constants import ALIGN_BAND, GAP

_ROWS_PER_BLOCK = 512      # table rows held at once; the rest is recomputed
_ONE_TABLE = 512           # characters up to which the whole table is held
_CACHE_ENTRIES = 200_000


def _masks(text: str, lo: int, hi: int) -> dict:
    """Bit (hi-1-j) of masks[c] says text[j] == c."""
    out: dict = {}
    for k in range(hi - lo):
        c = text[hi - 1 - k]
        out[c] = out.get(c, 0) | (1 << k)
    return out


def _links(a: str, b: str, band: int | None) -> list:
    """Linked positions. Takes (i, j) when equal, else moves i if the optimum
    survives that, else j.

    Row i of the table keeps, as the bits of one integer, where the best count
    of links within a[i:], b[j:] drops as j grows; bit t stands for j = top - t.
    """
    n = len(a)
    width = n if band is None else 2 * band - 1
    full = (1 << width) - 1
    whole = _masks(b, 0, n) if band is None else None

    def rows(lo: int, hi: int, flat: int, base: int):
        """Rows hi-1 down to lo, given row hi; `flat` bits mark no drop."""
        end = n if band is None else min(n, hi + band)
        masks = whole if band is None else _masks(b, max(0, lo - band), end)
        for i in range(hi - 1, lo - 1, -1):
            shift = 0
            if band is not None:
                base += 1 - (flat & 1)
                flat = (flat >> 1) | (1 << (width - 1))
                shift = i + band - end
            m = masks.get(a[i], 0)
            m = ((m << shift) if shift >= 0 else (m >> -shift)) & full
            hit = flat & m
            flat = ((flat + hit) | (flat & ~m)) & full
            yield i, flat, base

    # Keep every block's border row; rows inside a block are made again on the
    # walk, so long strings need little memory.
    step = _ROWS_PER_BLOCK
    marks = {n: (full, 0)}
    table: dict = {}

    def fill(hi: int) -> None:
        nonlocal table
        table = {i: (f, s) for i, f, s in rows(max(0, hi - step), hi, *marks[hi])}

    for hi in range(n, 0, -step):
        fill(hi)
        lo = max(0, hi - step)
        marks[lo] = table[lo]

    def best(i: int, j: int) -> int:
        if i not in marks and i not in table:
            fill(n - (n - i) // step * step)
        flat, base = marks[i] if i in marks else table[i]
        t = (n - 1 if band is None else i + band - 1) - j
        if t < 0:
            return base
        return base + (~flat & full & ((1 << (t + 1)) - 1)).bit_count()

    out, i, j, left = [], 0, 0, best(0, 0)
    while left:
        if a[i] == b[j] and (band is None or -band < i - j < band):
            out.append((i, j))
            i, j, left = i + 1, j + 1, left - 1
        elif best(i + 1, j) == left:
            i += 1
        else:
            j += 1
    return out


def _short_links(a: str, b: str) -> list:
    """`_links` without a band for texts of a sentence: one whole table."""
    n = len(a)
    full = (1 << n) - 1
    masks: dict = {}
    bit = full + 1
    for c in b:
        bit >>= 1
        masks[c] = masks.get(c, 0) | bit
    flat, drops = full, [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        m = masks.get(a[i], 0)
        hit = flat & m
        flat = ((flat + hit) | (flat & ~m)) & full
        drops[i] = flat ^ full
    out, i, j, left, right_of = [], 0, 0, drops[0].bit_count(), full
    while left:
        if a[i] == b[j]:
            out.append((i, j))
            i += 1
            j += 1
            left -= 1
            right_of >>= 1
        elif (drops[i + 1] & right_of).bit_count() == left:
            i += 1
        else:
            j += 1
            right_of >>= 1
    return out


def _layout(a: str, b: str, links: list) -> tuple:
    """Write both strings over shared columns. The unlinked runs before a link
    are right-justified against it; the side whose link position is smaller
    first gets as many gaps as the positions differ. Columns empty on both
    sides go."""
    out_a = out_b = ""
    pi = pj = si = sj = 0                     # si, sj: where the links without a break began
    for i, j in links:
        if i == pi and j == pj:               # nothing but gaps on both sides stands between
            pi, pj = i + 1, j + 1
            continue
        out_a += a[si:pi]
        out_b += b[sj:pj]
        x, y = a[pi:i] + GAP * (j - i), b[pj:j] + GAP * (i - j)
        if x or y:
            x, y = _side_by_side(x, y)
        out_a += x
        out_b += y
        si, sj, pi, pj = i, j, i + 1, j + 1
    out_a += a[si:pi]
    out_b += b[sj:pj]
    x, y = _side_by_side(a[pi:], b[pj:])
    return (out_a + x, out_b + y) if GAP not in a or GAP not in b else _side_by_side(out_a + x, out_b + y)


def _side_by_side(x: str, y: str) -> tuple:
    """Right-justify over shared columns; columns empty on both sides go."""
    w = max(len(x), len(y))
    x, y = x.rjust(w, GAP), y.rjust(w, GAP)
    if GAP in x and GAP in y:
        kept = [(p, q) for p, q in zip(x, y) if p != GAP or q != GAP]
        return "".join([p for p, _ in kept]), "".join([q for _, q in kept])
    return x, y


def align_strings(a: str, b: str, band: int | None) -> tuple:
    """Pad to equal length with gaps, link, lay out. A common start links to
    itself, so only what follows it is worked on."""
    n = max(len(a), len(b))
    a, b = a.ljust(n, GAP), b.ljust(n, GAP)
    if a == b:
        kept = a.replace(GAP, "")
        return kept, kept
    k = 0
    while a[k] == b[k]:
        k += 1
    start, a, b = a[:k].replace(GAP, ""), a[k:], b[k:]
    links = _short_links(a, b) if n - k <= _ONE_TABLE else None
    # links of an optimum without a band that all lie in the band are those with the band:
    # each step of that walk then leaves as many links in the band as without one
    if links is None or band is not None and any(abs(i - j) >= band for i, j in links):
        links = _links(a, b, band)
    a, b = _layout(a, b, links)
    return start + a, start + b


def sweep_strings(a: str, b: str, window: int, stride: int, cache: dict) -> tuple:
    """Re-align window after window from left to right, each over the outcome
    of the one before, then whatever is left. Returns score and both strings."""
    n = max(len(a), len(b))
    a, b = a.ljust(n, GAP), b.ljust(n, GAP)

    def window_aligned(x: str, y: str) -> tuple:
        if x == y:
            kept = x.replace(GAP, "")
            return kept, kept
        got = cache.get((x, y))
        if got is None:
            if len(cache) >= _CACHE_ENTRIES:
                cache.clear()
            got = cache[(x, y)] = align_strings(x, y, None)
        return got

    done_a, done_b, open_a, open_b, read, start = [], [], "", "", 0, 0
    size = n                                  # current number of columns
    while start + window < size:
        more = max(0, window - len(open_a))
        x, y = open_a + a[read:read + more], open_b + b[read:read + more]
        read += more
        new_x, new_y = window_aligned(x[:window], y[:window])
        open_a, open_b = new_x + x[window:], new_y + y[window:]
        size += len(new_x) - window
        short = max(0, stride - len(open_a))
        open_a, open_b = open_a + a[read:read + short], open_b + b[read:read + short]
        read += short
        done_a.append(open_a[:stride])
        done_b.append(open_b[:stride])
        open_a, open_b = open_a[stride:], open_b[stride:]
        start += stride
    last_a, last_b = window_aligned(open_a + a[read:], open_b + b[read:])
    a_out, b_out = "".join(done_a) + last_a, "".join(done_b) + last_b
    same = sum(p == q for p, q in zip(a_out[:n], b_out))
    return same / n, a_out, b_out


def align_column(ref: Column, hyp: Column, band: int | None = ALIGN_BAND) -> Column:
    """struct<ref_aln, hyp_aln>; null where either input is null."""

    @F.pandas_udf("ref_aln string, hyp_aln string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for refs, hyps in batches:
            seen: dict = {}
            out = []
            for a, b in zip(refs, hyps):
                if a is None or b is None:
                    out.append((None, None))
                    continue
                if (a, b) not in seen:
                    seen[a, b] = align_strings(a, b, band)
                out.append(seen[a, b])
            yield pd.DataFrame(out, columns=["ref_aln", "hyp_aln"])

    return run.asNondeterministic()(ref, hyp)   # not to be run twice by pushed filters


def best_sweep_strings(a: str, b: str, configs: list, cache: dict) -> tuple:
    """Score, configuration, and both strings of the highest score, the first
    configuration on ties. All zero gives a single space on both sides."""
    if a == b:
        return 1.0, 0, a, b
    best = (0.0, None, " ", " ")
    for k, (window, stride) in enumerate(configs):
        score, x, y = sweep_strings(a, b, window, stride, cache)
        if score > best[0]:
            best = (score, k, x, y)
        if score >= 1:
            break
    return best

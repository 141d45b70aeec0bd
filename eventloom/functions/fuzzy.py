"""String similarity that has no built-in: Arrow-batched helpers over single rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE_MATCH = 0.85
QUOTE_STOP = 0.9
SHORT = 63  # characters of texts that are matched many pairs together: a run and its place fit in 16 bits
SIDES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 40, 48, 56, SHORT)  # stretches are padded to the next of these
AT_ONCE = 512  # pairs of stretches matched together, so that they stay in the cache
NO_LEFT, NO_RIGHT, CODES = 32766, 32765, 32760  # beyond a stretch's end; codes of characters lie below
ASKED, TOKENS, EASE = 256, 256, 1e-9


def matched(left: list[str], right: list[str]) -> np.ndarray:
    """Characters in the matching blocks of :class:`SequenceMatcher`, for each pair of texts.

    Short texts go many pairs together: of all open pairs of stretches the longest common one is found (the
    first in the left text, then in the right one), and what lies before and behind it is opened.
    """
    total = np.zeros(len(left), np.int64)
    short = np.array([len(x) <= SHORT and len(y) <= SHORT for x, y in zip(left, right)], bool)
    for i in np.flatnonzero(~short):
        total[i] = sum(block.size for block in SequenceMatcher(None, left[i], right[i]).get_matching_blocks())
    few = np.flatnonzero(short)
    if len(few):
        total[few] = _matched_short([left[i] for i in few], [right[i] for i in few])
    return total


def _matched_short(left: list[str], right: list[str]) -> np.ndarray:
    n = len(left)
    codes = np.array([*left, *right], dtype=f"U{SHORT}").view(np.uint32).reshape(2 * n, SHORT)
    if codes.max() >= CODES:
        kinds, codes = np.unique(codes, return_inverse=True)
        if len(kinds) >= CODES:  # more characters than codes: fewer pairs at a time have fewer
            return np.concatenate([_matched_short(left[at : at + 100], right[at : at + 100]) for at in range(0, n, 100)])
    codes = codes.reshape(2, n * SHORT).astype(np.int16)
    total, waiting = np.zeros(n, np.int64), {side: [] for side in reversed(SIDES)}

    def open_(rows: np.ndarray) -> None:
        rows = rows[:, (rows[2] > rows[1]) & (rows[4] > rows[3])]
        side = np.searchsorted(SIDES, np.maximum(rows[2] - rows[1], rows[4] - rows[3]))
        for k in np.unique(side):
            waiting[SIDES[k]].append(rows[:, side == k])

    lengths = [np.fromiter(map(len, texts), np.int64, n) for texts in (left, right)]
    open_(np.stack([np.arange(n), np.zeros(n, np.int64), lengths[0], np.zeros(n, np.int64), lengths[1]]))
    for side in waiting:  # from the widest: what is opened is never wider
        while waiting[side]:
            rows, waiting[side] = np.concatenate(waiting[side], axis=1), []
            for at in range(0, rows.shape[1], AT_ONCE):
                part = rows[:, at : at + AT_ONCE]
                size, i, j = _longest(*codes, part, side)
                hit = size > 0
                (pair, a, a_end, b, b_end), size, i, j = part[:, hit], size[hit], i[hit], j[hit]
                np.add.at(total, pair, size)
                open_(np.concatenate([np.stack([pair, a, i, b, j]), np.stack([pair, i + size, a_end, j + size, b_end])], axis=1))
    return total


def _longest(left: np.ndarray, right: np.ndarray, rows: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and both places of the longest common stretch of each row (pair, from and to on the left and right)."""
    pair, a, a_end, b, b_end = rows
    i, j = (start + np.arange(side)[:, None] for start in (a, b))
    x = np.where(i < a_end, left.take(pair * SHORT + i, mode="clip"), np.int16(NO_LEFT))
    y = np.where(j < b_end, right.take(pair * SHORT + j, mode="clip"), np.int16(NO_RIGHT))
    run, new = (np.zeros((side + 1, len(pair)), np.int16) for _ in range(2))  # 64 times the common run that ends here
    best, now = (np.zeros((side, len(pair)), np.int16) for _ in range(2))
    for k in range(side):
        np.bitwise_xor(y, x[k], out=now)
        now -= 1
        now >>= 15  # all bits where the characters are equal, else none
        np.add(run[:-1], 64, out=new[1:])
        new[1:] &= now
        np.add(new[1:], SHORT - k, out=now)  # of equal runs the first on the left
        np.maximum(best, now, out=best)
        run, new = new, run
    at = best.argmax(axis=0)  # and then the first on the right
    value = best[at, np.arange(len(pair))].astype(np.int64)
    size = value >> 6
    return size, a + SHORT - (value & 63) - size + 1, b + at - size + 1


def alike(asked: list[str], held: list[str], ratio: Callable[[slice, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each asked text the places of the held ones whose :func:`fuzzy_ratio` to it may reach what ``ratio``
    says for some asked texts (rows) and held ones (columns).

    Matching blocks hold no more characters than both texts have in common, counted for many pairs by one product
    of matrices, and no more than their longest common subsequence, found for many held texts at once by
    arithmetic on bits. Hardly a pair that passes both has a lower ratio.
    """
    words = np.array([-(-len(text) // 64) for text in held], np.int64)
    for w in np.unique(words[words > 0]):
        places = np.flatnonzero(words == w)
        some = [held[i] for i in places]
        lengths = np.fromiter(map(len, some), np.int64, len(some))
        masks, column = bit_masks(some), _columns([*some, *asked])
        tokens = _token_counts(some, column).T.copy()
        for at in range(0, len(asked), ASKED):
            texts = asked[at : at + ASKED]
            both = np.fromiter(map(len, texts), np.int64, len(texts))[:, None] + lengths
            need = ratio(slice(at, at + len(texts)), places) * both / 2 - EASE
            possible = _token_counts(texts, column) @ tokens >= need
            for k, text in enumerate(texts):
                found = np.flatnonzero(possible[k])
                if len(found):
                    found = found[common_length(masks, lengths[found], text, found) >= need[k, found]]
                if len(found):
                    yield at + k, places[found]


def _columns(texts: list[str]) -> dict[str, list[int]]:
    """For each character a column for its first, second, ... occurrence in a text; the rarest share columns."""
    seen = Counter()
    for text in texts:
        seen.update((c, k) for c, n in Counter(text).items() for k in range(n))
    out: dict[str, list[int]] = {}
    column = {token: at if at < TOKENS else TOKENS + at % TOKENS for at, (token, _) in enumerate(seen.most_common())}
    for c, k in sorted(column):
        out.setdefault(c, []).append(column[c, k])
    return out


def _token_counts(texts: list[str], column: dict[str, list[int]]) -> np.ndarray:
    """Texts by columns; the product of two such rows is at least the number of characters in common."""
    width = max(map(max, column.values()), default=0) + 1
    at = [t * width + i for t, text in enumerate(texts) for c, n in Counter(text).items() for i in column[c][:n]]
    return np.bincount(np.array(at, np.int64), minlength=len(texts) * width).reshape(len(texts), -1).astype(np.float32)


def common_length(masks: dict[str, np.ndarray], lengths: np.ndarray, text: str, found: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``text`` and each of the texts ``found`` in :func:`bit_masks`."""
    words, count = next(iter(masks.values())).shape[0], len(found)
    near = {c: masks[c].take(found, axis=1) for c in set(text) if c in masks}
    open_ = np.full((words, count), ~np.uint64(0))
    used, grown = np.empty(count, np.uint64), np.empty(count, np.uint64)
    for c in text:
        carry = None
        for v, mask in zip(open_, near.get(c, ())):
            np.bitwise_and(v, mask, out=used)
            np.add(v, used, out=grown)
            if words > 1:
                over = grown < v
                if carry is not None:
                    grown += carry
                    over |= grown < carry
                carry = over.astype(np.uint64)
            np.subtract(v, used, out=used)
            np.bitwise_or(grown, used, out=v)
    common = np.zeros(count, np.int64)
    for w in range(words):
        bits = np.clip(lengths - 64 * w, 0, 64)
        held = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << (bits % 64).astype(np.uint64)) - np.uint64(1))
        common += np.bitwise_count(~open_[w] & held)
    return common


def bit_masks(texts: list[str]) -> dict[str, np.ndarray]:
    """For each character, where it stands in each text, as bits of one or more words (words, texts)."""
    words = max(1, -(-max(map(len, texts), default=0) // 64))
    masks: dict[str, np.ndarray] = {}
    for t, text in enumerate(texts):
        at: dict[str, int] = {}
        for i, c in enumerate(text):
            at[c] = at.get(c, 0) | 1 << i
        for c, bits in at.items():
            if c not in masks:
                masks[c] = np.zeros((words, len(texts)), np.uint64)
            for w in range(words):
                masks[c][w, t] = bits >> 64 * w & 2**64 - 1
    return masks


def fuzzy_ratio(left: Column, right: Column) -> Column:
    """Ratcliff-Obershelp ratio; 0.0 where a side is empty, 1.0 for equal texts.

    Only pairs that are neither empty nor equal are worth the trip to Python.
    """

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = [None if x is None or y is None else (x, y) for x, y in zip(a, b)]
        known = dict.fromkeys(p for p in pairs if p is not None)  # equal pairs of a batch are matched once
        counts = matched([x for x, _ in known], [y for _, y in known])
        known = {p: 2.0 * int(n) / (len(p[0]) + len(p[1])) for p, n in zip(known, counts)}
        return pd.Series([known.get(p) for p in pairs], dtype="float64")

    a, b = F.coalesce(left, F.lit("")), F.coalesce(right, F.lit(""))
    worth = (a != "") & (b != "") & (a != b)
    computed = ratio(F.when(worth, a), F.when(worth, b))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(computed)


def ratio_bound(left: Column, right: Column) -> Column:
    """Cheap upper bound of :func:`fuzzy_ratio` from the lengths."""
    total = F.length(left) + F.length(right)
    return F.when(total == 0, 0.0).otherwise(
        2.0 * F.least(F.length(left), F.length(right)) / total
    )


def best_window(quote: str | None, text: str | None) -> tuple[int, int, float] | None:
    """Offset, length and ratio of the window of ``text`` most like ``quote``.

    A running count of shared characters bounds each window's ratio from above, so most windows
    are passed over without an alignment.
    """
    if quote is None or text is None:
        return None
    needle = quote.strip('"\n ').lower()
    hay = text.lower()
    size = len(needle)
    if size == 0 or len(text) < size:
        return None
    matcher = SequenceMatcher(None)
    missing: dict[str, int] = {}
    for ch in needle:
        missing[ch] = missing.get(ch, 0) + 1
    shared = 0

    def enter(ch: str) -> int:
        missing[ch] = missing.get(ch, 0) - 1
        return 1 if missing[ch] >= 0 else 0

    def leave(ch: str) -> int:
        missing[ch] += 1
        return 1 if missing[ch] > 0 else 0

    best, at = QUOTE_MATCH, -1
    for ch in hay[:size]:
        shared += enter(ch)
    for i in range(len(text) - size + 1):
        if i:
            shared -= leave(hay[i - 1])
            shared += enter(hay[i + size - 1]) if i + size - 1 < len(hay) else 0
        if shared / size > best:
            matcher.set_seqs(needle, hay[i : i + size])
            score = matcher.ratio()
            if score > best:
                best, at = score, i
                if score > QUOTE_STOP:
                    break
    return None if at < 0 else (at, size, best)


_HIT = T.StructType(
    [
        T.StructField("pos", T.IntegerType()),
        T.StructField("len", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("kind", T.StringType()),
    ]
)


@F.pandas_udf(_HIT)
def _fuzzy_quote(quotes: pd.Series, texts: pd.Series) -> pd.DataFrame:
    rows = []
    for quote, text in zip(quotes, texts):
        hit = best_window(quote, text)
        rows.append((*hit, "fuzzy") if hit else (None, None, None, None))
    frame = pd.DataFrame(rows, columns=["pos", "len", "confidence", "kind"])
    return frame.astype({"pos": "Int32", "len": "Int32"})


def fuzzy_quote(quote: Column, source: Column) -> Column:
    """Most similar window of ``source``; null where none is similar enough."""
    hit = _fuzzy_quote(quote, source)
    return F.when(hit["pos"].isNotNull(), hit)

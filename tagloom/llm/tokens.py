"""Token counts of a byte-fallback piece model by rank-synchronous array merging.

A text becomes one sequence of symbols: a marker for the text's start and for every
space, and the characters as they are.  No piece of the model has the marker after
another character, so merges never cross the start of a run of markers and the text
falls into pre-tokens there.  The distinct pre-tokens of a batch lie end to end in
one numpy array of symbol numbers, beside the rank of every adjacent pair.  Each round
takes each pre-token's lowest rank, merges all its occurrences at once, looks up the
pairs next to them, and goes on with the pre-tokens that still have a pair.  Symbols
that survive count 1 if they are pieces, else one for each UTF-8 byte.

Long pre-tokens (unspaced text) would take a round for every rank in them.  A piece has
at most `reach` characters, so what is merged at some place can only meet pairs within
`reach` symbols of it: there, every pair merges whose rank is the lowest within that
distance.  Symbols farther than that from any pair are counted and leave the array.

Merging all occurrences of a pair at once equals merging them one by one unless one of
them makes a pair that ranks no later.  Of equal ranks within reach of each other, a
round takes those from the left up to the first that makes such a pair.

Cases: null and empty texts count 0 tokens; texts are whole whatever their length;
strings that look like special tokens are ordinary text; equal texts, equal counts;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import text_of

MARK = "▁"
#: Pre-tokens start where a run of markers starts.
_RUNS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Characters beyond which a pre-token's pairs are compared within reach only.
LONG = 64


class Merges:
    """Symbols and mergeable pairs of a model, as arrays.

    Symbols: 0 is any character that no piece contains; then the characters of the
    pieces, then the pieces of several characters.  A pair's key is left << 20 | right;
    `ranks` and `joined` lie beside `keys`, and a hash table leads to them."""

    def __init__(self, pieces: list[tuple[str, float]]):
        score = dict(pieces)
        chars = sorted({c for p in score for c in p})
        longer = sorted(p for p in score if len(p) > 1)
        number = {s: i + 1 for i, s in enumerate([*chars, *longer])}
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        #: tokens per symbol; 0 where the text's bytes decide
        self.known = np.array([False, *(c in score for c in chars), *(True for _ in longer)])
        # equal scores share a rank: the leftmost of them merges first
        rank = {s: i for i, s in enumerate(sorted({score[p] for p in longer}, reverse=True))}
        self.NONE = len(rank)
        self.reach = max(map(len, longer), default=1)
        of = [rank[score[p]] for p in longer]
        self.careful = np.bincount(np.array(of, np.int64), minlength=self.NONE) > 1
        rows = []
        for p, r in zip(longer, of):
            for k in range(1, len(p)):
                left, right = number.get(p[:k]), number.get(p[k:])
                if left and right:
                    rows.append((left << 20 | right, r, number[p]))
                    for q in (p[:k], p[k:]):
                        if len(q) > 1 and rank[score[q]] >= r:
                            self.careful[rank[score[q]]] = True
        rows.sort()
        self.keys, self.ranks, self.joined = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
        self._index()

    def _index(self, bits: int = 20) -> None:
        """Two tables of places in keys: the second holds what the first has no room
        for, under a multiplier that leaves no two keys in one place."""
        self.shift, multiplier = np.uint64(64 - bits), 0x9E3779B97F4A7C15
        keys, rest = self.keys.astype(np.uint64), np.arange(len(self.keys))
        self.tables: list[tuple[np.uint64, np.ndarray]] = []
        while len(rest):
            odd = np.uint64(multiplier | 1)
            place = (keys[rest] * odd >> self.shift).astype(np.int64)
            kept = np.unique(place, return_index=True)[1]
            if not self.tables or len(kept) == len(rest):
                table = np.full(1 << bits, -1, np.int32)
                table[place[kept]] = rest[kept]
                self.tables.append((odd, table))
                rest = np.delete(rest, kept)
            multiplier = (multiplier * 6364136223846793005 + 1442695040888963407) % 2**64

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Each key's place in keys, or -1."""
        key = key.astype(np.uint64)
        found = np.full(len(key), -1, np.int32)
        keys = self.keys.astype(np.uint64)
        for odd, table in self.tables:
            slot = table[(key * odd >> self.shift).astype(np.int64)]
            found = np.where((slot >= 0) & (keys[slot] == key), slot, found)
        return found

    def count(self, tokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        n = len(tokens)
        out = np.zeros(n, np.int64)
        lengths = np.fromiter(map(len, tokens), np.int64, n)
        for long in (False, True):
            own = np.flatnonzero((lengths > LONG) == long)
            if len(own):
                # long pre-tokens stand so far apart that none reaches the next
                between = "\0" * (self.reach + 1) if long else ""
                points = np.frombuffer(between.join([tokens[i] for i in own]).encode("utf-32-le", "surrogatepass"), np.uint32)
                owner = np.repeat(np.arange(len(own)), lengths[own] + (len(between) if long else 0))[: len(points)]
                apart = np.zeros(len(points), bool)
                if long:
                    starts = np.cumsum(lengths[own] + len(between)) - len(between)
                    for start in starts[:-1].tolist():
                        apart[start : start + len(between)] = True
                out[own] = self._count(points, owner, apart, len(own), long)
        return out

    def _count(self, points: np.ndarray, owner: np.ndarray, apart: np.ndarray, n: int, long: bool) -> np.ndarray:
        symbols = np.where(apart, 0, self.code[points]).astype(np.int64)
        nbytes = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        # a symbol that is no piece can't come from a merge, so its bytes are its character's
        weight = np.where(apart, 0, np.where(self.known[symbols], 1, nbytes))
        out = np.zeros(n, np.int64)
        rank = np.full(len(symbols), self.NONE, np.int64)  # of the pair that begins there
        joined = np.zeros(len(symbols), np.int64)
        self._look(np.arange(len(symbols) - 1), symbols, owner, rank, joined)
        while len(symbols):
            if long:
                near = _least(rank, self.reach)
                low, live = near == rank, near < self.NONE
                low &= live
            else:
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                near = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(owner)]))
                live = near < self.NONE
                low = (rank == near) & live
            at = self._apart(low, symbols, owner, rank, joined, self.reach if long else None)
            symbols[at] = joined[at]
            weight[at] = 1
            live[at + 1] = False
            gone = ~live
            gone[at + 1] = False  # merged away, not counted
            out += np.bincount(owner[gone], weight[gone], n).astype(np.int64)
            place = np.cumsum(live) - 1
            at, size = place[at], int(place[-1]) + 1
            symbols, owner, weight, rank, joined = symbols[live], owner[live], weight[live], rank[live], joined[live]
            if size:
                changed = np.unique(np.r_[at, at[at > 0] - 1])
                rank[changed] = self.NONE
                self._look(changed[changed + 1 < size], symbols, owner, rank, joined)
        return out

    def _look(self, at: np.ndarray, symbols: np.ndarray, owner: np.ndarray, rank: np.ndarray, joined: np.ndarray) -> None:
        """Fills in rank and joined for the pairs that begin at these places."""
        at = at[owner[at] == owner[at + 1]] if len(at) else at
        if not len(at) or not len(self.keys):
            return
        slot = self._find(symbols[at] << 20 | symbols[at + 1])
        hit = slot >= 0
        rank[at[hit]], joined[at[hit]] = self.ranks[slot[hit]], self.joined[slot[hit]]

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        slot = self._find(left << 20 | right)
        return np.where(slot >= 0, self.ranks[slot], self.NONE) if len(self.keys) else np.full(len(left), self.NONE)

    def _apart(self, low: np.ndarray, symbols: np.ndarray, owner: np.ndarray, rank: np.ndarray, joined: np.ndarray, reach: int | None) -> np.ndarray:
        """Of places of lowest pairs, those that merge in this round: from the left,
        none overlapping, and, of equal ranks within reach (None: in one pre-token),
        none after one that makes a pair of the same rank or a lower one."""
        at = np.flatnonzero(low)
        if not len(at):
            return at

        def waits(at: np.ndarray, back: int) -> np.ndarray:
            """Whether a pair of the same rank, `back` places to the left, has yet to wait
            for lower ones."""
            there = np.maximum(at - back, 0)
            return (at >= back) & (owner[there] == owner[at]) & (rank[there] == rank[at]) & ~low[there]

        differ = (owner[at[1:]] != owner[at[:-1]]) | (rank[at[1:]] != rank[at[:-1]])
        start = np.r_[True, (at[1:] != at[:-1] + 1) | differ]  # runs of overlapping pairs
        begin = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
        at = at[((np.arange(len(at)) - begin) % 2 == 0) & ~waits(at, 1)[begin]]
        careful = self.careful[rank[at]]
        if not careful.any():
            return at
        blocked = np.zeros(len(at), bool)
        if reach is not None:
            some = np.flatnonzero(careful)
            for back in range(1, reach + 1):
                blocked[some] |= waits(at[some], back)
        # what each would stand next to, if those before it in the round have merged
        end = len(symbols)
        left = np.where(at > 0, symbols[at - 1], 0)
        touching = np.r_[False, at[1:] == at[:-1] + 2]
        left[touching] = joined[at[:-1]][touching[1:]]
        left[(at == 0) | (owner[np.maximum(at - 1, 0)] != owner[at])] = 0
        right = np.where(at + 2 < end, symbols[np.minimum(at + 2, end - 1)], 0)
        right[(at + 2 >= end) | (owner[np.minimum(at + 2, end - 1)] != owner[at])] = 0
        new = joined[at]
        bad = careful & (np.minimum(self._rank_of(left, new), self._rank_of(new, right)) <= rank[at]) | blocked
        if not bad.any():
            return at
        cut = np.r_[True, owner[at[1:]] != owner[at[:-1]]]
        if reach is not None:
            cut |= np.r_[True, at[1:] - at[:-1] > reach]
        group = np.cumsum(cut) - 1
        before = np.cumsum(bad) - bad  # bad ones to the left, in all groups
        return at[(before == before[cut][group]) & ~blocked]


def _least(x: np.ndarray, reach: int) -> np.ndarray:
    """The least of the values at most `reach` places away."""
    wide = 2 * reach + 1
    padded = np.full(-(-(len(x) + 2 * reach) // wide) * wide, np.iinfo(np.int64).max)
    padded[reach : reach + len(x)] = x
    blocks = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(x)], ahead[wide - 1 : wide - 1 + len(x)])


@lru_cache(maxsize=2)
def load(path: str) -> Merges:
    """The merges of a piece model file; only its piece list and scores are read."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return Merges([(model.id_to_piece(i), model.get_score(i)) for i in usual])


def count_tokens(texts: list[str], merges: Merges) -> np.ndarray:
    """Tokens of each text.  A batch's pre-tokens are counted once each."""
    numbers: dict[str, int] = {}
    ids, lengths = [], []
    for text in texts:
        parts = _RUNS.findall(MARK + text.replace(" ", MARK)) if text else []
        ids.extend([numbers.setdefault(p, len(numbers)) for p in parts])
        lengths.append(len(parts))
    each = merges.count(list(numbers))
    sums = np.r_[0, np.cumsum(each[np.array(ids, np.int64)])] if ids else np.zeros(1, np.int64)
    ends = np.cumsum(lengths)
    return sums[ends] - sums[ends - np.array(lengths, np.int64)]


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of docs.  model: a file
    that every executor has, such as an installed package's."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        merges = load(model)
        for texts in batches:
            # a few million characters at a time, so that the arrays stay small
            part = texts.str.len().cumsum() // 3_000_000
            yield pd.concat([pd.Series(count_tokens(own.tolist(), merges)) for _, own in texts.groupby(part)] or [pd.Series([], dtype="int64")])

    text = text_of()
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), counted(text).alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )

"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a byte string one token is stored: the last token of that prefix's
encoding. It is the only token that ends there and may follow the stored token of the
prefix before it. So the table grows byte by byte (exact appends), and after an edit only
the entries from the edit to the point where old and new entries agree for a whole token
length are computed again.

Texts are encoded piece by piece, and the table of many new pieces is filled at once: an array
per prefix length holds the last token of that prefix of every piece.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, functions as F

from salesmart.llm.common import map_rows
from salesmart.llm.pretokens import WHOLE_TEXT, batches, pieces

#: Entries of each worker's caches: pieces, some 200 bytes each, pairs of tokens as objects, and
#: slots for pairs in arrays, 9 bytes each. Results do not depend on them.
CACHE_ENTRIES = 300_000
PAIR_ENTRIES = 1 << 16
SLOT_BITS = 20
#: Pieces of more bytes, and few pieces, are encoded one by one.
BATCH_LENGTH, BATCH_PIECES = 32, 64

#: Odd multipliers of hashes.
BASE, SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class Vocabulary:
    """Byte tokens with ranks; a rank is both the id and the order of merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.never = len(self.tokens)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._follows: dict[tuple[int, int], bool] = {}
        self.known = self._follows.get
        #: Tokens that merges can make; no other stands in an encoding.
        made = {token: rank for token, rank in ranks.items() if self.reachable(rank)}
        self.longest = max(map(len, made), default=0)
        #: Every suffix of a token, with its id if it is a token itself, else -1.
        self.endings = {token[start:]: -1 for token in made for start in range(1, len(token))}
        self.endings |= made

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a rank file: a token in base64 and its rank on each line."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank)
                        for token, rank in (line.split() for line in lines if line.strip())})

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte or if no merge does."""
        if token not in self._halves:
            parts = [self.tokens[token][i:i + 1] for i in range(len(self.tokens[token]))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], self.never), i)
                               for i in range(len(parts) - 1))
                if rank >= token:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = (
                (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None)
        return self._halves[token]

    def reachable(self, token: int) -> bool:
        """Whether merges can make the token from its own bytes."""
        return len(self.tokens[token]) == 1 or self.halves(token) is not None

    def follows(self, left: int, right: int) -> bool:
        """Whether ``right`` may directly follow ``left`` in an encoding."""
        holds = self._follows.get((left, right))
        if holds is None:
            if len(self._follows) >= PAIR_ENTRIES:
                self._follows.clear()
            holds = self._follows[left, right] = self._seam_holds(left, right)
        return holds

    def _seam_holds(self, left: int, right: int) -> bool:
        """Take merges back, youngest first; no earlier merge may ever cross the seam.

        A merge across the seam would have come first if its rank is below that of the
        merge taken back last, or equal to it where that one lies to the right.
        """
        before = self.never
        while True:
            if self.ranks.get(self.tokens[left] + self.tokens[right], self.never) < before:
                return False
            young_left = left > right
            if len(self.tokens[left if young_left else right]) == 1:
                young_left = not young_left
                if len(self.tokens[left if young_left else right]) == 1:
                    return True
            if young_left:
                before, left = left, self.halves(left)[1]
            else:
                before, right = right + 1, self.halves(right)[0]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixTable:
    """The last token of every prefix of a byte string, open to appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self._extend(len(self.data))

    def _extend(self, stop: int) -> None:
        """Entries up to ``stop``: of the tokens that end there, the one that may follow."""
        vocabulary, data, last = self.vocabulary, self.data, self.last
        endings, known = vocabulary.endings.get, vocabulary.known
        for end in range(len(last) + 1, stop + 1):
            found = []
            for start in range(end - 1, -1, -1):
                token = endings(data[start:end])
                if token is None:
                    break
                if token >= 0:
                    found.append((start, token))
            for start, token in reversed(found):
                if start == 0:
                    break
                holds = known((last[start - 1], token))
                if holds is None:
                    holds = vocabulary.follows(last[start - 1], token)
                if holds:
                    break
            else:
                raise ValueError(f"the vocabulary lacks the byte {data[end - 1]}")
            last.append(token)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes ``start:end``; returns how many entries were computed."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[:start]
        agreed = 0
        for position in range(start + 1, len(self.data) + 1):
            self._extend(position)
            if position > start + len(new) and self.last[-1] == old[position - 1 - shift]:
                agreed += 1
                if agreed >= self.vocabulary.longest:
                    self.last += old[position - shift:]
                    return position - start
            else:
                agreed = 0
        return len(self.data) - start

    def encode(self) -> list[int]:
        ids, end = [], len(self.data)
        while end:
            token = self.last[end - 1]
            ids.append(token)
            end -= len(self.vocabulary.tokens[token])
        return ids[::-1]


class TokenArrays:
    """A vocabulary as arrays: tokens by the hash of their bytes, halves, and pairs that may follow.

    Hashes are polynomials modulo 2^64, so those of a part and of a concatenation are computed
    from others.
    """

    def __init__(self, vocabulary: Vocabulary):
        tokens = vocabulary.tokens
        self.vocabulary = vocabulary
        self.longest = vocabulary.longest
        self.lengths = np.array([len(token) for token in tokens], np.int64)
        powers = np.full(max(self.lengths.max(initial=0), BATCH_LENGTH) + 1, BASE, np.uint64)
        powers[0] = 1
        self.powers = np.cumprod(powers)
        self.hashes = np.zeros(len(tokens) + 1, np.uint64)  # the last is no token's
        for rank, token in enumerate(tokens):
            number = 0
            for byte in token:
                number = (number * BASE + byte + 1) & 0xFFFFFFFFFFFFFFFF
            self.hashes[rank] = number
        self.made = np.array([bool(token) and vocabulary.reachable(rank)
                              for rank, token in enumerate(tokens)] + [False])
        halves = [vocabulary.halves(rank) if token else None for rank, token in enumerate(tokens)]
        self.left, self.right = (np.array([half[side] if half else -1 for half in halves], np.int64)
                                 for side in (0, 1))
        ranks = np.flatnonzero(self.lengths)
        #: Two tables by different bits of the hash: the second has what met in the first.
        self.tables = []
        multiplier = SPREAD
        while len(ranks) or not self.tables:
            slots = self._slots(self.hashes[ranks], multiplier)
            table = np.full(1 << SLOT_BITS, len(tokens), np.int32)
            table[slots] = ranks
            self.tables.append((multiplier, table))
            ranks = ranks[table[slots] != ranks]
            multiplier = multiplier * BASE % (1 << 64)
        #: Pairs by slot; a new pair takes the place of the one it meets.
        self.pairs = np.zeros(1 << SLOT_BITS, np.uint64)
        self.holds = np.zeros(1 << SLOT_BITS, bool)

    @staticmethod
    def _slots(hashes: np.ndarray, multiplier: int) -> np.ndarray:
        return (hashes * np.uint64(multiplier)) >> np.uint64(64 - SLOT_BITS)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The tokens of these hashes; where there is none, the number of tokens."""
        none = len(self.lengths)
        found = np.full(len(hashes), none, np.int64)
        left = np.arange(len(hashes))
        for multiplier, table in self.tables:
            token = table[self._slots(hashes[left], multiplier)]
            same = self.hashes[token] == hashes[left]
            found[left[same]] = token[same]
            left = left[~same]
        return found

    def seams_hold(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``Vocabulary.follows`` of many pairs."""
        never = self.vocabulary.never
        result = np.ones(len(left), bool)
        before = np.full(len(left), never)
        left, right, active = left.copy(), right.copy(), np.arange(len(left))
        while len(active):
            whole = self.find(self.hashes[left] * self.powers[self.lengths[right]] + self.hashes[right])
            crossed = (whole < never) & (whole < before)
            result[active[crossed]] = False
            young_left = left > right
            single = self.lengths[np.where(young_left, left, right)] == 1
            young_left ^= single
            over = crossed | (single & (self.lengths[np.where(young_left, left, right)] == 1))
            active, left, right, young_left = (
                values[~over] for values in (active, left, right, young_left))
            before = np.where(young_left, left, right + 1)
            left, right = (np.where(young_left, self.right[left], left),
                           np.where(young_left, right, self.left[right]))
        return result

    def follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) + right.astype(np.uint64) + np.uint64(1)
        slots = self._slots(keys, SPREAD)
        known = self.pairs[slots] == keys
        result = self.holds[slots]
        new = np.flatnonzero(~known)
        if len(new):
            distinct, first, place = np.unique(keys[new], return_index=True, return_inverse=True)
            holds = self.seams_hold(left[new[first]], right[new[first]])
            result[new] = holds[place]
            slots = self._slots(distinct, SPREAD)
            self.pairs[slots] = distinct
            # Of pairs that meet in a slot the last one stays, here as above.
            self.holds[slots] = holds
        return result

    def encode(self, pieces: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """Pieces of up to BATCH_LENGTH bytes, none empty, by length, and their ids as 32-bit numbers."""
        pieces = sorted(pieces, key=len, reverse=True)
        lengths = np.array([len(piece) for piece in pieces])
        size = int(lengths[0])
        points = np.array(pieces, f"S{size}").view(np.uint8)
        points = np.ascontiguousarray(points.reshape(-1, size).T)
        hashes = np.zeros((size + 1, len(pieces)), np.uint64)
        last = np.full((size + 1, len(pieces)), -1, np.int64)
        for end in range(1, size + 1):
            # Longer pieces come first, so those that have this prefix are a slice.
            open_rows = np.arange(np.searchsorted(-lengths, -end, side="right"))
            hashes[end] = hashes[end - 1] * np.uint64(BASE) + points[end - 1] + np.uint64(1)
            for start in range(max(0, end - self.longest), end):
                token = self.find(hashes[end, open_rows]
                                  - hashes[start, open_rows] * self.powers[end - start])
                fits = self.made[token]
                if start:
                    at = np.flatnonzero(fits)
                    fits[at] = self.follow(last[start, open_rows[at]], token[at])
                last[end, open_rows[fits]] = token[fits]
                open_rows = open_rows[~fits]
                if not len(open_rows):
                    break
            if len(open_rows):
                raise ValueError(f"the vocabulary lacks the byte {points[end - 1, open_rows[0]]}")
        steps, place, rows = [], lengths, np.arange(len(pieces))
        while len(rows):
            token = last[place, rows]
            steps.append((rows, token))
            place = place - self.lengths[token]
            rows, place = rows[place > 0], place[place > 0]
        counts = np.bincount(np.concatenate([rows for rows, _ in steps]), minlength=len(pieces))
        ends = np.cumsum(counts)
        ids = np.empty(ends[-1], "<u4")
        for number, (rows, token) in enumerate(steps, 1):
            ids[ends[rows] - number] = token
        data = ids.tobytes()
        borders = [0, *(4 * ends).tolist()]
        return pieces, [data[start:end] for start, end in zip(borders, borders[1:])]


class PieceCache(dict):
    """Ids by piece, as 32-bit numbers. A piece that is a token is that token; others take the table.

    A full cache becomes the older half, from which pieces still in use are taken over.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.arrays = TokenArrays(vocabulary)
        self.older: dict[str, bytes] = {}

    def learn(self, runs: list[list[str]]) -> None:
        """Encode what is not known yet of these pieces, all at once."""
        used = set().union(*runs)
        fresh = used.difference(self)
        if len(self) + len(fresh) > CACHE_ENTRIES // 2:
            self.older = dict(self)
            self.clear()
            fresh = used
        ranks, older = self.vocabulary.ranks, self.older
        short, long = [], []
        for piece in fresh:
            ids = older.get(piece)
            if ids is None:
                data = piece.encode()
                rank = ranks.get(data)
                if rank is None:
                    (short if len(data) <= BATCH_LENGTH else long).append(data)
                    continue
                ids = rank.to_bytes(4, "little")
            self[piece] = ids
        if len(short) < BATCH_PIECES:
            long, short = long + short, []
        for data in long:
            ids = PrefixTable(self.vocabulary, data).encode()
            self[data.decode()] = np.array(ids, "<u4").tobytes()
        if short:
            for data, ids in zip(*self.arrays.encode(short), strict=True):
                self[data.decode()] = ids

    def encode(self, run: list[str]) -> list[int]:
        """The ids of known pieces."""
        return np.frombuffer(b"".join(map(self.__getitem__, run)), "<u4").tolist()


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceCache:
    """One per worker and vocabulary file."""
    return PieceCache(Vocabulary.load(path))


def encode_text(text: str, cache: PieceCache) -> Iterator[list[int]]:
    """The ids of a text, in runs of bounded length."""
    for run in pieces(text):
        cache.learn([run])
        yield cache.encode(run)


def encoded_runs(batch: list[tuple], cache: PieceCache) -> Iterator[tuple[int | None, Iterable[list[int]]]]:
    """Key and runs of ids of each row of a batch, whose new pieces are learned together."""
    if len(batch[0][1]) > WHOLE_TEXT:
        [(key, text)] = batch
        yield key, encode_text(text, cache)
        return
    split = [(key, list(pieces(text))) for key, text in batch]
    cache.learn([run for _, runs in split for run in runs])
    for key, runs in split:
        yield key, map(cache.encode, runs)


def round_trip(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Digests of every text's ids and of the bytes that they decode to; the ids if asked for.

    Null and empty texts have no ids and the digests of nothing; null doc_ids stay; rows
    that repeat are encoded each; other columns of ``docs`` are ignored.
    """
    def make():
        cache = encoder(path)
        vocabulary = cache.vocabulary
        decimals = [str(rank) for rank in range(len(vocabulary.tokens))]

        def work(rows):
            for doc_id, runs in chain.from_iterable(
                    encoded_runs(batch, cache) for batch in batches(rows)):
                count, ids_digest, bytes_digest = 0, hashlib.sha256(), hashlib.sha256()
                every: list[int] = []
                for ids in runs:
                    if ids:
                        ids_digest.update((b"," if count else b"") + ",".join(
                            map(decimals.__getitem__, ids)).encode())
                        bytes_digest.update(vocabulary.decode(ids))
                        count += len(ids)
                        if keep_ids:
                            every += ids
                row = doc_id, count, ids_digest.hexdigest(), bytes_digest.hexdigest()
                yield (*row, every) if keep_ids else row
        return work

    schema = f"{SCHEMA}, ids array<int>" if keep_ids else SCHEMA
    return map_rows(docs.select(F.col("doc_id").cast("bigint"), "text"), schema, make)

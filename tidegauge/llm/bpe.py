"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is cut before every blank that a non-blank character follows.  The split pattern of the
vocabulary always starts a new match at such a place, and what precedes it looks the same as the
end of a text to the pattern's look-ahead, so the pieces encode independently; most pieces repeat,
so each worker keeps a bounded memo of them.

Pieces that are not in the memo are split by the pattern, and the matches are merged.  Over the
byte positions of a match stands a segment tree whose leaves hold ``rank * width + position`` of
the pair that starts there (infinity if no pair does); the root is the leftmost pair of least
rank.  A merge changes three leaves - the merged position, its dead right half and its live left
neighbour - and recomputes their paths to the root, which is logarithmic in the length.  Matches
of one width class are merged side by side, one NumPy operation for a step of all of them, in
trees of eight children to a node; matches beyond the largest class take a binary tree.

Null text counts as empty (no ids), null ids as none (no bytes).  Ids keep the order of the text;
repeated rows stay repeated, a text of any length is one task's.  Columns named like an output are
replaced by it, all others stay; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Splits text before merging; the public vocabularies are made for it.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers; beyond it the memo starts anew.
MEMO = 500_000
WIDTHS = (8, 16, 32, 64)
#: Matches merged side by side; their trees stay in a processor's cache.
SIDE = 4096
_NONE = np.int32(1 << 30)
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


class PieceMemo:
    """Remembers the ids of pieces; at most ``memo`` and what one more million characters hold.

    ``cut`` cuts a text into pieces that encode independently (default: ``pieces``)."""

    def __init__(self, encode_pieces: Callable[[list[str]], list[bytes]], cut: Callable[[str], list[str]] | None = None, memo: int = MEMO):
        self._encode_pieces, self._cut, self._most = encode_pieces, cut or pieces, memo
        self._memo: dict[str, bytes] = {}

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        collecting = gc.isenabled()
        gc.disable()  # millions of strings come and go here, none of them in a cycle
        try:
            return self._encode_texts(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode_texts(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        start = 0
        while start < len(texts):  # about a million characters at a time, so that few pieces are new at once
            stop, chars = start, 0
            while stop < len(texts) and chars < 1_000_000:
                chars += len(texts[stop])
                stop += 1
            cut = [self._cut(t) for t in texts[start:stop]]
            if len(self._memo) > self._most:
                self._memo.clear()
            missing = list(set().union(*cut).difference(self._memo))
            self._memo.update(zip(missing, self._encode_pieces(missing), strict=True))
            known = self._memo.__getitem__
            out += [b"".join(map(known, c)) for c in cut]
            start = stop
        return out


class RankBPE:
    """Merge order given by a rank file: one base64 token and its rank per line."""

    def __init__(self, path: str, pattern: str = SPLIT):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pieces = regex.compile(pattern)
        size = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self._keys = keys[order]
        self._merged = np.fromiter(pairs.values(), np.int32, len(pairs))[order]
        if size * max(WIDTHS) >= _NONE:
            raise ValueError("too many ranks for 32-bit tree keys")
        self._byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self._byte < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        self._memo = PieceMemo(self.encode_pieces)

    # -- merging ---------------------------------------------------------------------------

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or _NONE."""
        want = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self._keys, want)
        at[at == len(self._keys)] = 0
        return np.where(self._keys[at] == want, self._merged[at], _NONE)

    def _merge_side_by_side(self, words: list[bytes], width: int) -> list[bytes]:
        """Trees of one width, eight children to a node: ``leaf`` and ``node`` are the two levels
        below the root, and the root is the minimum of at most eight nodes."""
        n, shift, nodes = len(words), width.bit_length() - 1, width // 8
        sizes = np.fromiter(map(len, words), np.int32, n)
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8)
        token = self._byte[raw]
        place = np.arange(width, dtype=np.int32)
        inside = place[None, :] < sizes[:, None]
        follow = np.where(place[None, :] + 1 < sizes[:, None], place[None, :] + 1, width).astype(np.int32).ravel()
        before = np.tile(place - 1, n)
        live = inside.ravel().copy()
        leaf = np.full((n, width), _NONE, np.int32)
        start = np.flatnonzero(follow < width)
        rank = self._pair_ranks(token[start], token[start + 1])
        leaf.ravel()[start] = np.where(rank < _NONE, (rank << shift) + (start & (width - 1)), _NONE)
        eights, leaf = leaf.reshape(-1, 8), leaf.ravel()
        node = eights.min(axis=1)
        node_rows = node.reshape(n, nodes)
        rows = np.arange(n)
        while len(rows):
            best = node_rows[rows].min(axis=1) if nodes > 1 else node[rows]
            on = best < _NONE
            rows, best = rows[on], best[on]
            base = rows << shift
            rank, spot = best >> shift, base + (best & (width - 1))
            dead = base + follow[spot]
            after = follow[dead]
            prior = before[spot]
            token[spot] = rank
            live[dead] = False
            follow[spot] = after
            leaf[dead] = leaf[spot] = _NONE
            has = after < width
            here, right = spot[has], (base + after)[has]
            before[right] = here & (width - 1)
            joined = self._pair_ranks(rank[has], token[right])
            ok = joined < _NONE
            here, joined = here[ok], joined[ok]
            leaf[here] = (joined << shift) + (here & (width - 1))
            has = prior >= 0
            here = (base + prior)[has]
            joined = self._pair_ranks(token[here], rank[has])
            leaf[here] = np.where(joined < _NONE, (joined << shift) + (here & (width - 1)), _NONE)
            changed = np.concatenate([spot, dead, here]) >> 3
            node[changed] = eights[changed].min(axis=1)
        ends = [0, *(4 * np.cumsum(live.reshape(n, width).sum(axis=1))).tolist()]
        ids = token[live].astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _merge_one(self, word: bytes) -> list[int]:
        """The same tree for one long match."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        token = [int(self._byte[b]) for b in word]
        follow, before = [*range(1, n), width], list(range(-1, n - 1))
        live = [True] * n
        none = int(_NONE)
        tree = [none] * (2 * width)
        pairs = self.pairs
        for i in range(n - 1):
            rank = pairs.get(token[i] << 32 | token[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            dead = follow[at]
            after, prior = follow[dead], before[at]
            token[at], live[dead], follow[at] = rank, False, after
            tree[width + dead] = none
            if after < width:
                before[after] = at
                right = pairs.get(rank << 32 | token[after])
                tree[width + at] = none if right is None else right * width + at
            else:
                tree[width + at] = none
            changed = [dead, at]
            if prior >= 0:
                left = pairs.get(token[prior] << 32 | rank)
                tree[width + prior] = none if left is None else left * width + prior
                changed.append(prior)
            for i in changed:
                i = (i + width) >> 1
                while i:
                    tree[i] = min(tree[2 * i], tree[2 * i + 1])
                    i >>= 1
        return [t for t, on in zip(token, live, strict=True) if on]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each match as unsigned 32-bit integers, little end first."""
        out: list[bytes] = [b""] * len(words)
        classes: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif word:
                classes.setdefault(next((w for w in WIDTHS if len(word) <= w), 0), []).append(i)
        for width, members in classes.items():
            for start in range(0, len(members), SIDE):
                part = members[start : start + SIDE]
                group = [words[i] for i in part]
                ids = self._merge_side_by_side(group, width) if width else [np.array(self._merge_one(w), "<u4").tobytes() for w in group]
                for i, x in zip(part, ids, strict=True):
                    out[i] = x
        return out

    # -- whole texts -----------------------------------------------------------------------

    def encode_pieces(self, missing: list[str]) -> list[bytes]:
        """Ids of whole pieces of text."""
        matches = [plain.groups() if (plain := _PLAIN(p)) else self.pieces.findall(p) for p in missing]
        ids = dict.fromkeys([m for found in matches for m in found])
        ids.update(zip(ids, self.merge([w.encode() for w in ids]), strict=True))
        return [ids[m[0]] + ids[m[1]] if len(m) == 2 else b"".join([ids[x] for x in m]) for m in matches]

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self._memo.encode_texts(texts)

    def decode_ids(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_CUT = regex.compile(r" (?=\S)")
#: A blank before one of these starts no piece.
_ODD = tuple(" " + chr(c) for c in range(0x3001) if chr(c).isspace())


def pieces(text: str) -> list[str]:
    """Cuts before each blank that a non-blank follows; joined again, the pieces are the text."""
    if not text:
        return []
    plain = text[-1] != " " and not any([odd in text for odd in _ODD])
    found = text.split(" ") if plain else _CUT.split(text)
    return [found[0], *[" " + p for p in found[1:]]] if found[0] else [" " + p for p in found[1:]]


_LOADED: dict[tuple[str, str], RankBPE] = {}


def loaded(path: str, pattern: str = SPLIT) -> RankBPE:
    """The tokenizer of this process; its memo outlives a task."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = RankBPE(path, pattern)
    return _LOADED[path, pattern]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None, pattern: str = SPLIT) -> DataFrame:
    """``keep`` columns (default: all but the text) and the ids of ``text`` as array<int>."""
    keep = [c for c in df.columns if c not in (text, ids)] if keep is None else keep
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for start in range(0, len(texts), 512):
                found = bpe.encode_texts([t or "" for t in texts[start : start + 512]])
                ends = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in found], out=ends[1:])
                values = pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32))
                rows = batch.slice(start, len(found))
                yield pa.RecordBatch.from_arrays([*[rows.column(i) for i in range(len(keep))], pa.ListArray.from_arrays(pa.array(ends), values)], names=[*keep, ids])

    return df.select(*keep, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) and the bytes that ``ids`` stand for; null ids give no bytes."""
    keep = [c for c in df.columns if c != out] if keep is None else keep
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            lists = batch.column(len(keep))
            values = lists.values.to_numpy(zero_copy_only=False)
            ends = lists.offsets.to_numpy()
            texts = [bpe.decode_ids(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(texts, pa.binary())], names=[*keep, out])

    return df.select(*keep, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("_ids")).mapInArrow(run, schema)

"""Operator 7: byte-level BPE encoding and decoding by corpus-level merge replay.

The texts of an Arrow batch are split by the pattern and reduced to their distinct pieces. An
inverted index maps each mergeable pair's rank to the positions, over all pieces, where that pair
stands. Merges are replayed in rank order: all positions of the lowest rank are merged at once,
and only the pairs that touch a merged position are looked up anew and filed under their own ranks.
Texts then take the ids of their pieces from that table. The index spans slices of ``SLICE`` characters, not the whole corpus; README has
the figures that decided this.

Memory is bounded by the batch (``SLICE`` characters of text at a time), whatever the corpus; no
text is shuffled. Pieces stay exact: a null text counts as empty, empty texts give no ids, long
pieces are merged like short ones. Repeated rows are encoded one by one; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Characters of text whose pieces are merged together.
SLICE = 12_000_000
_NONE = np.int32(1 << 30)
#: Code points of letters and digits (first-last, hexadecimal) that tiktoken 0.x, built on an older Unicode, takes for neither.
LATE = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a
11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20
18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2
1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def late_class() -> str:
    """``LATE`` as a character class without its brackets."""
    runs = [x.split("-") for x in LATE.split()]
    return "".join(rf"\U{int(r[0], 16):08x}-\U{int(r[-1], 16):08x}" for r in runs)


class MergeReplay:
    """Encoder and decoder for a rank file and a split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, late: str = ""):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.late = self.late_split = None
        if late:
            self.late = regex.compile(f"[{late}]")
            self.late_split = regex.compile("(?V1)" + pattern.replace(r"\p{L}", rf"[\p{{L}}--[{late}]]").replace(r"\p{N}", rf"[\p{{N}}--[{late}]]"))
        self.token = {r: t for t, r in ranks.items()}
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        keys, made = [], []
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(r)
        order = np.argsort(np.array(keys, np.int64))
        self.pair, self.made = np.array(keys, np.int64)[order], np.array(made, np.int32)[order]

    def pieces(self, text: str) -> list[str]:
        if self.late and not text.isascii() and self.late.search(text):
            return self.late_split.findall(text)
        return self.split.findall(text)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.made[at], _NONE)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, joined, and the number of ids of each piece."""
        size = np.array([len(p) for p in pieces], np.int64)
        token = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        n, ends = len(token), np.cumsum(size)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[ends - size] = -1
        alive = np.ones(n, bool)
        rank = np.full(n, _NONE, np.int32)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def file(at: np.ndarray) -> None:
            """Look the pairs that begin at these positions up and file them under their ranks."""
            r = self.rank_of(token[at], token[after[at]])
            rank[at] = r
            ok = r < _NONE
            at, r = at[ok], r[ok]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            for key, part in zip(r[first].tolist(), np.split(at, first[1:])):
                if key in index:
                    index[key].append(part)
                else:
                    index[key] = [part]
                    heapq.heappush(queue, key)

        file(np.flatnonzero(after >= 0).astype(np.int32))
        while queue:
            r = heapq.heappop(queue)
            parts = index.pop(r)
            at = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
            at = at[rank[at] == r]
            if len(at) > 1:
                # Of overlapping pairs in a row the first, third, ... merge, from the left.
                chained = np.r_[False, after[at[:-1]] == at[1:]]
                if chained.any():
                    nth = np.arange(len(at))
                    run = np.maximum.accumulate(np.where(chained, 0, nth))
                    at = at[(nth - run) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            token[at] = r
            after[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            alive[gone] = False
            rank[gone] = rank[at] = _NONE
            left = before[at]
            file(np.unique(np.concatenate([at[beyond >= 0], left[left >= 0]])))
        owner = np.repeat(np.arange(len(pieces)), size)
        return token[alive], np.bincount(owner[alive], minlength=len(pieces))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        seen: defaultdict[str, int] = defaultdict()
        seen.default_factory = seen.__len__
        spots = [np.array([seen[p] for p in self.pieces(t)], np.int32) for t in texts]
        pieces = [p.encode("utf-8", "surrogatepass") for p in seen]
        count = np.zeros(len(pieces), np.int64)
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int64)
        rest = np.flatnonzero(whole < 0)
        ids, sizes = self.merge([pieces[i] for i in rest]) if len(rest) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        count[whole >= 0] = 1
        count[rest] = sizes
        starts = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), np.uint32)
        flat[starts[whole >= 0]] = whole[whole >= 0]
        if len(rest):
            inside = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            flat[np.repeat(starts[rest], sizes) + inside] = ids
        out = []
        for at in spots:
            n = count[at]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out.append(flat[np.repeat(starts[at], n) + inside])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


_loaded: list[tuple] = []


def _replay(blob: tuple[dict[bytes, int], str, str]) -> MergeReplay:
    """The encoder of a broadcast (ranks, pattern, late), built once a worker."""
    if not _loaded or _loaded[0][0] is not blob:
        _loaded[:] = [(blob, MergeReplay(*blob))]
    return _loaded[0][1]


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``id_col``, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids of every row.

    ``path`` is read on the driver; the vocabulary (its size is fixed by the file) is broadcast.
    """
    model = docs.sparkSession.sparkContext.broadcast((read_ranks(path), pattern, late_class()))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _replay(model.value)
        for b in batches:
            texts = b.column(1)
            sizes = np.cumsum(np.array([len(t.as_py() or "") for t in texts], np.int64))
            at = 0
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, side="right")))
                own = [t or "" for t in texts.slice(at, end - at).to_pylist()]
                ids = coder.encode(own)
                cols = [b.column(0).slice(at, end - at), pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids], pa.string())]
                names = [b.schema.names[0], "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
                at = end

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>" if with_ids else ""))

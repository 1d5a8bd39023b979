"""Operator 4: language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is cross-parsed against it:
from each point the longest match that the automaton holds is one phrase. The language whose
automaton needs the fewest phrases, each weighed by the bits of a pointer into its training text,
wins. Automata are completed into tables (a missing transition ends the phrase and restarts at the
root), so that thousands of blocks are parsed side by side with one numpy lookup a byte.

Texts are lower-cased, runs of characters that are no letters become one separator, and the UTF-8 bytes
of what is left are the symbols, so letters of all scripts stay apart. Long texts are cut into blocks of
``BLOCK`` bytes that are parsed side by side; then each block is parsed again from the state in which the block
before it ended, until both parses meet. The phrases are those of one parse of the whole text.

Every language that has a label is learned, from a bounded sample: up to ``TRAIN_ROWS`` documents a language in the
order of a hash, first those of up to ``ROW_CHARS`` characters, whole, then the beginnings of longer ones, until there are ``TRAIN_BYTES``
bytes of symbols; over ``TOTAL_BYTES`` / ``TRAIN_BYTES`` languages share ``TOTAL_BYTES`` evenly (64 bytes each at least). Prediction
reads every text whole.

Null texts and texts without a letter give ``und`` and score 0. Ties go to the language with
more labelled rows, then to the smaller name. If no labelled row exists, every text gives ``und``. Repeated rows are judged one
by one, null ids too; other columns, whatever their names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the training sample: bytes and rows a language, characters of a text that is taken whole, bytes of all languages.
TRAIN_BYTES, TRAIN_ROWS, ROW_CHARS, TOTAL_BYTES = 40_000, 200, 5_000, 1_280_000
BLOCK, SLICE = 1_024, 6_000_000
_SPACE = 32


def training_sample(docs: DataFrame, text_col: str, lang_col: str, id_col: str, rows: int = TRAIN_ROWS) -> dict[str, list[str]]:
    """Texts by language, the language with most rows first. At most ``rows`` a language come to the driver, none of more than ROW_CHARS characters."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), text_col).alias("draw"), F.substring(text_col, 1, ROW_CHARS).alias("text"), (F.char_length(text_col) > ROW_CHARS).alias("cut"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()  # a row a language
    # Each task keeps its own first rows of a language before anything is shuffled.
    first = Window.partitionBy("lang").orderBy("cut", "draw", "text")
    kept = known.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= rows).collect()
    text: dict[str, list[str]] = {}
    for r in sorted(kept, key=lambda r: (r["lang"], r["nth"])):
        text.setdefault(r["lang"], []).append(r["text"])
    return {r["lang"]: text[r["lang"]] for r in counts}


def symbols(text: str) -> bytes:
    """Lower-cased letters in UTF-8, with one space for each run of other characters behind a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = points >= 1 << 16
    letter = _LETTER[np.where(wide, 0, points)]
    if wide.any():
        letter[wide] = [chr(p).isalpha() for p in points[wide].tolist()]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, points, _SPACE)[keep].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")


_LETTER = np.array([chr(p).isalpha() for p in range(1 << 16)])


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring of ``codes``; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in codes:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
        last = new
    return moves


class Parser:
    """Completed automata of all languages in one table. An entry holds the row of the next state and the phrases that end.

    Each language's rows are as wide as the bytes of its own sample, and one for all others.
    """

    def __init__(self, samples: dict[str, list[str]], most: int = TRAIN_BYTES, total: int = TOTAL_BYTES):
        self.langs = list(samples)
        most = max(64, min(most, total // max(1, len(samples))))
        self.column = np.zeros((len(self.langs), 256), np.int32)
        tables, base, self.roots, bits = [], 0, [], []
        for i, lang in enumerate(self.langs):
            own = bytearray()
            for text in samples[lang]:
                own += symbols(text + "\n")
                if len(own) >= most:
                    break
            own = bytes(own[:most])
            held = sorted(set(own))
            self.column[i, held] = np.arange(1, len(held) + 1)
            table = self._table(suffix_automaton(self.column[i, list(own)].tolist()), base, len(held) + 1)
            self.roots.append(base)
            base += len(table)
            tables.append(table)
            bits.append(np.log2(max(2, len(own))))
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int64)
        if len(self.table) < 1 << 29:
            self.table = self.table.astype(np.int32)
        self.bits = np.array(bits)

    def _table(self, moves: list[dict[int, int]], base: int, width: int) -> np.ndarray:
        """Entries are (index of the next state's row in the joint table) * 4 + phrases that end here. Column 0 has no transitions."""
        to = np.full((len(moves), width), -1, np.int64)
        for s, m in enumerate(moves):
            to[s, list(m)] = list(m.values())
        root = to[0].copy()
        fresh = np.where(root >= 0, root, 0)  # a byte unknown to the language is a phrase of its own
        alone = (root < 0).astype(np.int64)
        full = np.where(to >= 0, to, fresh[None, :])
        ends = np.where(to >= 0, 0, 1 + alone[None, :])
        ends[0] = alone
        return ((base + full * width) * 4 + ends).astype(np.int64).ravel()

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        entry = self.table[state + self.column[:, symbol]]
        return entry >> 2, entry & 3

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text in each language: an array of texts x languages."""
        sizes = np.array([len(t) for t in texts], np.int64)
        roots = np.array(self.roots, np.int64)[:, None]
        if not sizes.sum() or not self.langs:
            return np.zeros((len(texts), len(self.langs)), np.int64)
        flat = np.frombuffer(b"".join(texts), np.uint8)
        parts = -(-sizes // BLOCK)
        head = np.cumsum(parts) - parts
        owner = np.repeat(np.arange(len(texts)), parts)
        nth = np.arange(len(owner)) - head[owner]
        start = (np.cumsum(sizes) - sizes)[owner] + nth * BLOCK
        length = np.minimum(BLOCK, sizes[owner] - nth * BLOCK)
        # All blocks from the root, the longest first.
        order = np.argsort(-length, kind="stable")
        s, state = start[order], np.repeat(roots, len(owner), axis=1)
        count = np.zeros(state.shape, np.int64)
        active = np.searchsorted(-length[order], -np.arange(1, length.max() + 1), side="right")
        for t, k in enumerate(active):
            state[:, :k], ended = self._step(state[:, :k], flat[s[:k] + t])
            count[:, :k] += ended
        end, phrase = np.empty_like(state), np.empty_like(count)
        end[:, order], phrase[:, order] = state, count
        # The second, third, ... block of each text once more from the true state, until both parses are in one state.
        for j in range(1, int(parts.max())):
            block = head[parts > j] + j
            true, from_root = end[:, block - 1], np.repeat(roots, len(block), axis=1)
            fixed, met = np.zeros(true.shape, np.int64), np.zeros(len(block), np.int64)
            still, a, b = np.arange(len(block)), true.copy(), from_root
            for t in range(int(length[block].max())):
                still = still[(length[block[still]] > t) & (a[:, still] != b[:, still]).any(0)]
                if not len(still):
                    break
                symbol = flat[start[block[still]] + t]
                a[:, still], more = self._step(a[:, still], symbol)
                b[:, still], less = self._step(b[:, still], symbol)
                fixed[:, still] += more - less
                met[still] = t + 1
            phrase[:, block] += fixed
            # A block that ended before both parses met ends in the true one's state.
            open_ = np.flatnonzero((met == length[block]) & (a != b).any(0))
            end[:, block[open_]] = a[:, open_]
        last = head + parts - 1
        phrase[:, last[sizes > 0]] += end[:, last[sizes > 0]] != roots
        return np.stack([np.bincount(owner, weights=p, minlength=len(texts)) for p in phrase], axis=1).astype(np.int64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        i = 0
        while i < len(texts):
            batch, size = [], 0
            while i < len(texts) and (not batch or size < SLICE):
                batch.append(symbols(texts[i] or ""))
                size += len(batch[-1])
                i += 1
            cost = self.phrases(batch) * self.bits
            for own, row in zip(batch, cost):
                if not own or not self.langs:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                best = int(np.argmin(row))
                second = np.min(np.delete(row, best)) if len(row) > 1 else row[best]
                langs.append(self.langs[best])
                scores.append(float(second / max(row[best] + second, 1e-9)))
        return langs, scores


def identify(docs: DataFrame, learn_from: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col`` and columns lang_pred, score for every row of ``docs``, learned from ``learn_from`` only."""
    spark = docs.sparkSession
    # Automata of at most 2 * TOTAL_BYTES states together, as wide as the bytes in use: the table's size is bounded.
    model = spark.sparkContext.broadcast(Parser(training_sample(learn_from, text_col, lang_col, id_col)))
    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_predictor(model), f"`{id_col}` {id_type}, lang_pred string, score double")


def _predictor(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2_000):
                part = b.slice(at, 2_000)
                langs, scores = model.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[b.schema.names[0], "lang_pred", "score"])

    return run

"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of its labelled text accepts exactly the
substrings of that sample. A text is parsed greedily: each phrase is the longest match of the automaton
at that place. A text of the sample's language needs few, long phrases. The phrase count times the bits
that point into the sample, per character, estimates the cross entropy; the language with the least wins.

Letters are compared in lower case; whatever lies between letters counts as one boundary. Each letter of
the samples is a symbol of its own; a letter that no sample holds is a phrase by itself in every language.

A text is parsed whole. Its chunks of CHUNK characters are parsed side by side, each as if a phrase began
there; then each chunk is parsed again from the state in which the one before it ended, until that parse
meets the first one, which mostly takes a few characters. So phrases go on across chunks, and the counts
are those of one parse from the first character to the last.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.llm.memory import give_back, text_runs

CHUNK = 256
SIDE_BY_SIDE = 1 << 13
#: Symbols with a column in the transition tables; the moves of rarer ones are looked up in sorted keys. This
#: bounds memory and changes no result.
DENSE = 128
#: No column of labels that holds languages has more values.
MOST_LABELS = 10_000
UNDETERMINED = "und"
#: Symbols that every language knows: the boundary between words, letters outside the samples, padding.
BOUNDARY, FOREIGN, PADDING = range(3)


@dataclass(frozen=True)
class Samples:
    """Labelled text, bounded by total_chars; all that a worker needs to build the automata."""

    texts: tuple[tuple[str, tuple[str, ...]], ...]


def suffix_automaton(sequence: Iterable[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts the substrings of sequence; state 0 starts."""
    moves, links, lengths, last = [{}], [-1], [0], 0
    for c in sequence:
        new = len(moves)
        moves.append({})
        lengths.append(lengths[last] + 1)
        links.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = new
            p = links[p]
        if p != -1:
            q = moves[p][c]
            if lengths[q] == lengths[p] + 1:
                links[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                lengths.append(lengths[p] + 1)
                links.append(links[q])
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = links[p]
                links[q] = links[new] = copy
        last = new
    return moves


#: Columns of a transition table: symbols that are looked up, padding, symbols that the language doesn't know.
RARE, SKIPPED, UNKNOWN = range(3)


class Table:
    """An automaton as arrays. move() takes states and symbols; an odd result says that a phrase began."""

    def __init__(self, sequence: np.ndarray):
        moves = suffix_automaton(sequence.tolist())
        known, counts = np.unique(sequence, return_counts=True)
        self.none = len(moves)  # the state in which no phrase is open
        dense = np.sort(known[np.argsort(-counts, kind="stable")][:DENSE])
        self.column = np.full(int(known.max(initial=PADDING)) + 2, UNKNOWN, np.int32)
        self.column[known], self.column[PADDING] = RARE, SKIPPED
        self.column[dense] = np.arange(UNKNOWN + 1, UNKNOWN + 1 + len(dense))
        self.width = UNKNOWN + 1 + len(dense)
        table = np.full((self.none + 1, self.width), -1, np.int32)
        sparse: list[tuple[int, int]] = []
        for state, out in enumerate(moves):
            for symbol, to in out.items():
                if (column := self.column[symbol]) != RARE:
                    table[state, column] = to
                else:
                    sparse.append(((symbol << 32) + state, to))
        begin = np.where(table[0] < 0, self.none, table[0])
        table = np.where(table < 0, begin * 2 + 1, table * 2).astype(np.int32)
        table[:, SKIPPED] = np.arange(len(table), dtype=np.int32) * 2
        self.dense = table.ravel()
        sparse.sort()
        self.keys, self.to = np.array([k for k, _ in sparse], np.int64), np.array([t for _, t in sparse], np.int32)
        self.bits = math.log2(len(sequence) + 1)

    def _find(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where a rare symbol leads, or -1."""
        key = (symbol.astype(np.int64) << 32) + state
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def columns(self, symbols: np.ndarray) -> np.ndarray:
        return self.column[np.minimum(symbols, len(self.column) - 1)]

    def move(self, state: np.ndarray, symbol: np.ndarray, column: np.ndarray) -> np.ndarray:
        step = self.dense[state * self.width + column]
        if len(self.keys) and len(rare := np.flatnonzero(column == RARE)):
            at, what = state[rare], symbol[rare]
            to, first = self._find(at, what), self._find(np.zeros(len(at), np.int64), what)
            step[rare] = np.where(to < 0, first * 2 + 1, to * 2)
        return step


class Parser:
    """Automata of all languages, and the symbols that they share."""

    def __init__(self, samples: Samples):
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.symbols = np.where(self.letter, FOREIGN, BOUNDARY).astype(np.int32)
        for i, c in enumerate(sorted({c for _, texts in samples.texts for t in texts for c in t.lower() if c.isalpha()})):
            self.symbols[ord(c)] = PADDING + 1 + i
        self.languages, self.tables = [], []
        for language, texts in samples.texts:
            parts = [np.zeros(1, np.int32)]
            for t in texts:
                parts += [self.of(t), np.zeros(1, np.int32)]
            self.languages.append(language)
            self.tables.append(Table(np.concatenate(parts)))

    def of(self, text: str) -> np.ndarray:
        """Symbols of the letters of text, runs of others as one boundary."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.symbols[codes]
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != BOUNDARY) | (symbols[:-1] != BOUNDARY)
        return symbols[keep]

    def has_letter(self, text: str) -> bool:
        return bool(self.letter[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())

    def phrases(self, chunks: np.ndarray, follows: np.ndarray, entries: list[int]) -> tuple[np.ndarray, list[int]]:
        """Phrases that each language needs for each column of chunks, and the states at the end. A column
        that follows goes on with the phrase with which the column before it ended, the first with entries.
        """
        out, ends = np.empty((len(self.tables), chunks.shape[1]), np.int64), []
        for k, table in enumerate(self.tables):
            columns = table.columns(chunks)
            states = np.empty((len(chunks) + 1, chunks.shape[1]), np.int32)
            begins = np.empty(chunks.shape, bool)
            states[0] = table.none
            states[0, 0] = entries[k] if follows[0] else table.none
            for i, (symbols, at) in enumerate(zip(chunks, columns, strict=True)):
                step = table.move(states[i], symbols, at)
                begins[i] = step & 1
                states[i + 1] = step >> 1
            again = np.flatnonzero(follows[1:]) + 1
            while len(again):
                # a column is right once the one before it is, so each round settles at least one more
                entry = states[-1][again - 1]
                other = entry != states[0][again]
                again = again[other]
                states[0][again] = entry[other]
                for i in range(len(chunks)):
                    if not len(again):
                        break
                    step = table.move(states[i][again], chunks[i][again], columns[i][again])
                    begins[i][again] = step & 1
                    apart = states[i + 1][again] != step >> 1
                    again, step = again[apart], step[apart]
                    states[i + 1][again] = step >> 1
                again = again[again + 1 < len(follows)] + 1
                again = again[follows[again]]
            out[k] = begins.sum(0)
            ends.append(int(states[-1, -1]))
        return out, ends

    def costs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits a symbol for each language and text, which texts have letters, and their symbols."""
        known = np.array([bool(t) and self.has_letter(t) for t in texts], bool)
        costs = np.zeros((len(self.tables), len(texts)))
        parsed = np.zeros(len(texts), np.int64)
        columns: list[np.ndarray] = []
        owners: list[int] = []
        last, ends = -1, [0] * len(self.tables)

        def flush() -> None:
            nonlocal last, ends
            if columns:
                owner = np.array(owners)
                found, ends = self.phrases(np.ascontiguousarray(np.concatenate(columns).T), owner == np.concatenate([[last], owner[:-1]]), ends)
                for k in range(len(self.tables)):
                    costs[k] += np.bincount(owner, found[k], len(texts))
                last = owners[-1]
                columns.clear()
                owners.clear()

        for i, text in enumerate(texts):
            if known[i]:
                symbols = self.of(text)
                parsed[i] = len(symbols)
                padded = np.full(-(-len(symbols) // CHUNK) * CHUNK, PADDING, np.int32)
                padded[: len(symbols)] = symbols
                chunks = padded.reshape(-1, CHUNK)
                for at in range(0, len(chunks), SIDE_BY_SIDE):
                    columns.append(chunks[at : at + SIDE_BY_SIDE])
                    owners += [i] * len(columns[-1])
                    if len(owners) >= SIDE_BY_SIDE:
                        flush()
        flush()
        return costs * np.array([t.bits for t in self.tables])[:, None] / np.maximum(parsed, 1), known, parsed


_parsers: dict[Samples, Parser] = {}


def parser(samples: Samples) -> Parser:
    """One per worker process."""
    if samples not in _parsers:
        _parsers.clear()
        _parsers[samples] = Parser(samples)
    return _parsers[samples]


def held_out(doc_id: Column) -> Column:
    """The documents that nothing is learned from; false where the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_labelled(df: DataFrame, total_chars: int = 1 << 17, slice_chars: int = 256, least_chars: int = 4096, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> Samples:
    """A bounded sample of labelled text: total_chars characters in all, as many for each language, but
    not fewer than least_chars for one. Every value of lang_col with a letter in its sample is learned.

    Rows are chosen by a hash of key_col, one slice of slice_chars from each. Rows without text or label
    are skipped. A column of more than MOST_LABELS values is no column of languages and is refused.
    """
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(text_col) != ""))
    counts = rows.groupBy(lang_col).count().orderBy(lang_col).limit(MOST_LABELS + 1).collect()
    if len(counts) > MOST_LABELS:
        raise ValueError(f"{lang_col} has more than {MOST_LABELS} values")
    if not counts:
        return Samples(())
    each = max(least_chars, total_chars // len(counts))
    wanted = 4 * -(-each // slice_chars)
    hashed = F.xxhash64(F.col(key_col).cast("string"))
    share = F.pmod(hashed, F.lit(1 << 20))
    limits = F.create_map(*(F.lit(x) for lang, n in counts for x in (lang, max(1, math.ceil((1 << 20) * min(1.0, wanted / n))))))
    chosen = share < limits[F.col(lang_col)]
    place = F.pmod(F.shiftright(hashed, 20), F.greatest(F.length(text_col) - slice_chars, F.lit(1))).cast("int") + 1
    found = rows.where(chosen).select(F.col(lang_col).alias("lang"), share.alias("share"), F.substring(F.col(text_col), place, F.lit(slice_chars)).alias("text"))
    # what is collected is bounded for each language, so that no common one crowds out a rare one
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("share", "text"))).where(F.col("rank") <= 2 * wanted).drop("rank").orderBy("share", "text")
    texts: dict[str, list[str]] = {lang: [] for lang, _ in counts}
    left = dict.fromkeys(texts, each)
    for lang, _, text in ranked.collect():
        if left[lang] > 0:
            texts[lang].append(text[: left[lang]])
            left[lang] -= len(texts[lang][-1])
    return Samples(tuple((lang, tuple(t)) for lang, t in sorted(texts.items()) if any(c.isalpha() for x in t for c in x)))


def identify(df: DataFrame, samples: Samples, text_col: str = "text") -> DataFrame:
    """df with lang_pred, score (0 to 1: by how much the best language undercuts the second), symbols (letters
    and boundaries that were parsed) and bits (for each of them, in the best language).

    A text that is null or has no letter gets UNDETERMINED, score 0, no symbols and null bits, as has every
    text if nothing was learned. Equal costs go to the language first in order. Repeated rows are kept;
    columns of df with these four names are replaced. No shuffle.
    """
    known = df.drop("lang_pred", "score", "symbols", "bits")
    shared = df.sparkSession.sparkContext.broadcast(samples)
    index = known.columns.index(text_col)

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = parser(shared.value) if shared.value.texts else None
        for whole in batches:
            for start, end, texts in text_runs(whole.column(index), SIDE_BY_SIDE * CHUNK):
                batch, n = whole.slice(start, end - start), end - start
                names, score, symbols, bits = [UNDETERMINED] * n, np.zeros(n), np.zeros(n, np.int64), [None] * n
                if learned:
                    costs, ok, symbols = learned.costs(texts)
                    order = np.argsort(costs, 0, "stable")
                    best = costs[order[0], np.arange(n)]
                    second = costs[order[min(1, len(costs) - 1)], np.arange(n)]
                    names = [learned.languages[k] if y else UNDETERMINED for k, y in zip(order[0], ok, strict=True)]
                    score = np.where(ok, 1 - best / np.maximum(second, 1e-9) if len(costs) > 1 else 1.0, 0.0)
                    bits = [float(b) if y else None for b, y in zip(best, ok, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(symbols), pa.array(bits, pa.float64())],
                    schema=pa.schema([*batch.schema, ("lang_pred", pa.string()), ("score", pa.float64()), ("symbols", pa.int64()), ("bits", pa.float64())]),
                )
        give_back()

    schema = T.StructType(list(known.schema.fields)).add("lang_pred", "string").add("score", "double").add("symbols", "long").add("bits", "double")
    return known.mapInArrow(predict, schema)

"""Exact token counts of a byte-pair vocabulary by a compiled finite-state transducer.

Byte-pair encoding is deterministic, and a sequence of pieces is the encoding of its text if and only if
each two neighbours encode to themselves. So the encoding of every prefix ends in one piece, and that
piece follows from the last pieces of a few shorter prefixes: those from which a vocabulary piece may
still grow. What a prefix leaves behind is therefore a finite state: for each such shorter prefix its
distance, its last piece, and its token count relative to the prefix itself. The transducer over these
states reads one character at a time; each transition is annotated with the change of the token count.
States and transitions are compiled when first met and kept.

A space after another character always ends a piece (checked when the vocabulary is compiled), so the
transducer returns to its start state there. A chunk of text thus maps any entry state to the count of
its head, read from that state, plus a constant, and to one fixed exit state; the constant is itself a sum
over the words of the chunk, whose maps are remembered. Every text is cut into chunks, and their maps,
which compose associatively, are composed pairwise as in a parallel prefix scan.

Remembered words and compiled states are bounded: beyond KNOWN_WORDS or KNOWN_STATES they are dropped and
made anew, also in the middle of a text. States are therefore passed on by what they stand for.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
CHUNK = 1 << 16
KNOWN_WORDS = 1 << 19
KNOWN_STATES = 1 << 18
LONGEST_KNOWN_WORD = 48


def merge_pieces(text: str, scores: dict[str, float]) -> list[str]:
    """Byte-pair encoding by its definition: the best score first, the leftmost of equals."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            score = scores.get(parts[i] + parts[i + 1])
            if score is not None and (best is None or score > best):
                best, at = score, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


#: The state before the first character.
START = ("", ((0, None, 0),))


class Transducer:
    """The compiled vocabulary. run() reads characters."""

    def __init__(self, scores: dict[str, float], fallback: bool = True):
        self.scores, self.fallback = scores, fallback
        if any(SPACE in p.lstrip(SPACE) for p in scores):
            raise ValueError("a piece goes on after a space: texts can't be cut at spaces")
        letters = {p for p in scores if len(p) == 1}
        if any(c not in letters for p in scores for c in p):
            raise ValueError("a piece holds a character that is no piece")
        self.letters = letters
        self.growing = {p[:i] for p in scores for i in range(1, len(p))}
        self.forget()

    def forget(self) -> None:
        """Drops all compiled states but the start."""
        self.agree: dict[tuple[str | None, str], bool] = {}
        self.ids: dict[tuple, int] = {}
        self.known: list[tuple] = []
        self.moves: list[dict[str, tuple[int, int]]] = []
        self._state(START)

    def _state(self, key: tuple) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.known)
            self.known.append(key)
            self.moves.append({})
        return self.ids[key]

    def _follows(self, last: str | None, piece: str) -> bool:
        key = (last, piece)
        if key not in self.agree:
            self.agree[key] = merge_pieces((last or "") + piece, self.scores) == [*([last] if last else []), piece]
        return self.agree[key]

    def _compile(self, state: int, c: str) -> tuple[int, int]:
        if c not in self.letters:  # unknown characters never join a piece: one token a byte
            return 0, len(c.encode()) if self.fallback else 1
        suffix, marks = self.known[state]
        for back, last, rel in marks:
            piece = suffix[len(suffix) - back :] + c
            if piece in self.scores and self._follows(last, piece):
                break
        else:
            raise AssertionError("no piece ends here")
        delta, kept = rel + 1, [(0, piece, 0)]
        kept += [(back + 1, last, rel - delta) for back, last, rel in marks if suffix[len(suffix) - back :] + c in self.growing]
        longest = max(back for back, _, _ in kept)
        grown = suffix + c
        return self._state((grown[len(grown) - longest :], tuple(sorted(kept, key=lambda x: x[0])))), delta

    def run(self, text: str, entry: tuple = START) -> tuple[tuple, int]:
        """The state after text, and by how much the token count grew."""
        total, moves, state = 0, self.moves, self._state(entry)
        for c in text:
            move = moves[state].get(c)
            if move is None:
                if len(self.known) >= KNOWN_STATES:
                    here = self.known[state]
                    self.forget()
                    moves, state = self.moves, self._state(here)
                move = moves[state][c] = self._compile(state, c)
            state = move[0]
            total += move[1]
        return self.known[state], total


class _Words(dict):
    """Counts of whole words, each beginning at the start state."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, word: str) -> int:
        count = self.transducer.run(word)[1]
        if len(word) <= LONGEST_KNOWN_WORD:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = count
        return count


class Counter:
    """Token counts of texts with a given transducer."""

    _words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
    _cut = re.compile(f"(?<=[^{SPACE}]){SPACE}").search

    def __init__(self, transducer: Transducer):
        self.transducer, self.known = transducer, _Words(transducer)

    def chunk_map(self, text: str) -> tuple:
        """(head, count of what follows the first cut up to the last, exit state); no cut: (head, None, None)."""
        first = self._cut(text)
        if not first:
            return (text,), None, None
        words = self._words(text, first.start())
        state, tail = self.transducer.run(words.pop())
        return (text[: first.start()],), sum(map(self.known.__getitem__, words)) + tail, state

    def compose(self, a: tuple, b: tuple) -> tuple:
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        state, count = a[2], a[1]
        for part in b[0]:
            state, more = self.transducer.run(part, state)
            count += more
        return (a[0], count, state) if b[1] is None else (a[0], count + b[1], b[2])

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        # a space that begins a chunk belongs to its head, so composing needs no look back
        maps = [self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, rest, _ = maps[0]
        if len(head) == 1:  # a word like any other
            return self.known[head[0]] + (rest or 0)
        state, total = START, rest or 0
        for part in head:
            state, more = self.transducer.run(part, state)
            total += more
        return total


#: Texts that a model must leave as they are before encoding, beside the space before them: what other
#: normalisations fold, drop or join.
UNTOUCHED = ("a  b", " a ", "\t\n\r", "\u00a0\u200b", "\u2460\ufb01\u00bd\uff21", "e\u0301 \u00e9", "\u0130\u1e9e", "\u1100\u1161", "\u2581")


def load_counter(model_path: str) -> Counter:
    """Compiles a byte-pair model file of sentencepiece; one with another normalisation than the identity, of
    another kind or with pieces of the user's own is refused.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    every = range(model.get_piece_size())
    scores = {model.id_to_piece(i): model.get_score(i) for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    if any(model.normalize(x) != SPACE + x.replace(" ", SPACE) for x in UNTOUCHED):
        raise ValueError(f"{model_path}: the model changes texts before it encodes them")
    counter = Counter(Transducer(scores, any(model.is_byte(i) for i in every)))
    # pieces of the user's own and other kinds of models segment without merging: the pieces tell
    for piece in scores:
        plain = piece.replace(SPACE, " ")
        if len(piece) > 1 and not piece.startswith(SPACE) and counter.count(plain) != len(model.encode(plain)):
            raise ValueError(f"{model_path}: {piece!r} is not encoded by merging pairs")
    return counter


_loaded: dict[str, Counter] = {}


def _counter(model_path: str) -> Counter:
    """One per worker process."""
    if model_path not in _loaded:
        _loaded[model_path] = load_counter(model_path)
    return _loaded[model_path]


def count_tokens(df: DataFrame, model_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, n_bytes, n_tokens, over_limit for each row of df.

    A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows each give a row; an
    empty table gives none; other columns are not read, whatever their names. The texts stay in their
    partitions: no shuffle. A text is read whole, in chunks of CHUNK characters.
    """

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path)
        for batch in batches:
            sizes, tokens = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                tokens.append(counter.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(counts, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")

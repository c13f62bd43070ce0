"""Token counts: a compiled transducer over characters, run in chunks at once.

The tokenizer is compiled into a deterministic transducer in two parts.

The first reads characters. Each character becomes a symbol of its class and, where
the tokenizer's pattern looks ahead, of what follows; ``_NEXT`` has the next state and
``_CUT`` says whether a piece of text begins at the transition. A long run of symbols
is cut into chunks that are read in step from all states at once, which gives each
chunk a map from states to states. A parallel prefix scan composes the maps, which
gives the state each chunk really starts in, and a second reading marks the cuts.

The second part holds the weight of each transition out of a piece: the number of
tokens that the vocabulary's merges leave of it. Weights are compiled the first time
a piece is met. The sum of the weights along a text is its token count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Symbols.
_LETTER, _NUMBER, _OTHER, _JOINED, _LAST, _BLANK, _SHORT, _LONG, _RESET = range(9)
# States: at a cut, in letters, in numbers, in others, after a joined blank, in
# blanks, one or two letters before the end of a contraction.
_FRESH, _LETTERS, _NUMBERS, _OTHERS, _LEAD, _BLANKS, _ONE, _TWO = range(8)
_STATES = 8

#: Fixed value: Unicode's white space.
WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Fixed value: letters that make a contraction with the apostrophe before them.
SHORT_ENDS = "stmd"
LONG_ENDS = ("re", "ve", "ll")

#: Characters that are worked on at once, and in one chunk.
BATCH = 1 << 21
CHUNK = 1 << 10
#: Pieces whose weights a task remembers; a full memory is emptied, which costs time only.
MEMORY = 1 << 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    goes = np.zeros((_STATES, 9), np.uint8)
    cuts = np.ones((_STATES, 9), np.uint8)
    for symbol, state in ((_LETTER, _LETTERS), (_NUMBER, _NUMBERS), (_OTHER, _OTHERS)):
        goes[:, symbol] = state
        cuts[[state, _LEAD], symbol] = 0
    goes[[_ONE, _TWO], _LETTER] = _FRESH, _ONE
    cuts[[_ONE, _TWO], _LETTER] = 0
    goes[:, _JOINED] = _LEAD
    goes[:, _LAST] = _FRESH
    goes[:, _BLANK] = _BLANKS
    cuts[_BLANKS, _BLANK] = 0
    for symbol, state in ((_SHORT, _ONE), (_LONG, _TWO)):
        goes[:, symbol] = state
        goes[[_OTHERS, _LEAD], symbol] = _OTHERS
        cuts[[_OTHERS, _LEAD], symbol] = 0
    goes[:, _RESET] = _FRESH
    return goes, cuts


_NEXT, _CUT = _tables()


@lru_cache(1)
def _classes() -> np.ndarray:
    """Letter, number, other or blank of every code point."""
    import regex

    kinds = np.full(0x110000, _OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER)):
        every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000))
        for run in regex.finditer(pattern, every):
            kinds[run.start() : run.end()] = kind
    kinds[list(WHITE)] = _BLANK
    return kinds


def symbols(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The transducer's symbols for code points in which each text is followed by one reset.

    ``ends`` has the places of the resets.
    """
    kinds = _classes()[codes]
    kinds[ends] = _RESET
    out = kinds.copy()
    after = np.append(kinds[1:], _RESET)
    white = kinds == _BLANK
    followed = white & (after != _BLANK) & (after != _RESET)
    out[followed] = _LAST
    out[followed & (codes == 32)] = _JOINED
    quotes = np.flatnonzero((codes == ord("'")) & (kinds == _OTHER))
    if len(quotes):
        padded = np.append(codes, [0, 0])
        one, two = padded[quotes + 1], padded[quotes + 2]
        bounded = np.append(kinds, [_RESET, _RESET])
        out[quotes[np.isin(one, [ord(c) for c in SHORT_ENDS])]] = _SHORT
        for first, second in LONG_ENDS:
            fits = (one == ord(first)) & (two == ord(second)) & (bounded[quotes + 2] != _RESET)
            out[quotes[fits]] = _LONG
    return out


def compose(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The map of two chunks from the maps of each; rows are chunks, columns states."""
    return np.take_along_axis(second, first.astype(np.intp), 1)


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Row k: the map of chunks 0 to k, in log2(chunks) rounds of pairwise composition."""
    done, step = maps.copy(), 1
    while step < len(done):
        done[step:] = compose(done[:-step], done[step:])
        step *= 2
    return done


def cuts_of(marks: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where pieces begin in a run of symbols that starts fresh."""
    n = len(marks)
    rows = -(-n // chunk)
    padded = np.full(rows * chunk, _RESET, np.uint8)
    padded[:n] = marks
    columns = np.ascontiguousarray(padded.reshape(rows, chunk).T)
    flat = _NEXT.ravel()
    # From every state at once; a state is kept as its row's place in the table.
    now = np.broadcast_to(np.arange(_STATES, dtype=np.intp) * 9, (rows, _STATES)).copy()
    for column in columns:
        now = flat[now + column[:, None]].astype(np.intp) * 9
    reached = prefix_scan((now // 9).astype(np.uint8))
    state = np.zeros(rows, np.intp)
    state[1:] = reached[:-1, _FRESH].astype(np.intp) * 9
    flat_cut, found = _CUT.ravel(), np.empty((chunk, rows), np.uint8)
    for k, column in enumerate(columns):
        at = state + column
        found[k] = flat_cut[at]
        state = flat[at].astype(np.intp) * 9
    return np.flatnonzero(found.T.ravel()[:n])


class Counter:
    """Counts tokens as the tokenizer in a file does, without added begin or end tokens."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        # Strings of special tokens inside a text are one token each and part it.
        self._special = sorted(
            (token.content for token in self._tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True
        )
        self._weights: dict[str, int] = {}

    def _compile(self, piece: str) -> int:
        return len(self._tokenizer.encode(piece, add_special_tokens=False).ids)

    def weigh(self, pieces: list[str]) -> list[int]:
        known = self._weights
        out = list(map(known.get, pieces))
        if None in out:
            if len(known) > MEMORY:
                known.clear()
            for k, weight in enumerate(out):
                if weight is None:
                    piece = pieces[k]
                    weight = known.get(piece)
                    if weight is None:
                        weight = self._compile(piece)
                        if len(piece) <= 64:
                            known[piece] = weight
                    out[k] = weight
        return out

    def _parts(self, text: str) -> Iterator[str]:
        """Parts of bounded length, cut where a piece always begins: before a blank after a character."""
        at = 0
        while len(text) - at > BATCH:
            end = at + BATCH
            while end < len(text) and not (text[end] in " \n\t" and not text[end - 1].isspace()):
                end += 1
            yield text[at:end]
            at = end
        yield text[at:]

    def count(self, texts: list[str]) -> list[int]:
        totals = [0] * len(texts)
        queue: list[tuple[int, str]] = []
        waiting = 0
        for k, text in enumerate(texts):
            whole = [text]
            for token in self._special:
                if token in text:
                    parted = [part.split(token) for part in whole]
                    totals[k] += sum(len(parts) - 1 for parts in parted)
                    whole = [part for parts in parted for part in parts]
            for part in whole:
                for bounded in self._parts(part):
                    if bounded:
                        queue.append((k, bounded))
                        waiting += len(bounded)
                        if waiting >= BATCH:
                            self._run(queue, totals)
                            queue, waiting = [], 0
        if queue:
            self._run(queue, totals)
        return totals

    def _run(self, queue: list[tuple[int, str]], totals: list[int]) -> None:
        joined = "\0".join(text for _, text in queue) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(text) + 1 for _, text in queue]) - 1
        marks = symbols(codes, ends)
        starts = cuts_of(marks)
        # A reset is a piece of its own, without weight.
        real = marks[starts] != _RESET
        stops = np.append(starts[1:], len(codes))
        pieces = [joined[a:b] for a, b in zip(starts[real].tolist(), stops[real].tolist(), strict=True)]
        weights = np.array(self.weigh(pieces), np.int64)
        owner = np.searchsorted(ends, starts[real])
        sums = np.bincount(owner, weights, len(queue)).astype(np.int64)
        for (k, _), total in zip(queue, sums.tolist(), strict=True):
            totals[k] += total


@lru_cache(4)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, id_col: str, text_col: str, tokenizer_path: str) -> DataFrame:
    """One row per input row: the id, ``n_bytes`` of the UTF-8 text and ``n_tokens``.

    ``tokenizer_path`` is a byte-level BPE tokenizer in JSON that every executor can
    read. Null counts as an empty text, with no bytes and no tokens. A text of any
    length is worked on in parts of bounded length, unless it is one run without
    blanks. Repeated rows are counted one by one, an empty table gives an empty
    result, and other columns of the input play no part.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [len(text.encode("utf-8", "surrogatepass")) for text in texts]
            totals = counts.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())],
                ["id", "n_bytes", "n_tokens"],
            )

    out = rows.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", id_col)

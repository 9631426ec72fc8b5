"""SentencePiece byte-pair encoding of whole batches of texts in vectorised merge rounds, and decoding.

The normalised texts of a batch are one flat array of symbols. It is cut into words wherever two
neighbouring characters stand side by side in no piece, since no merge can cross such a place. In
each round every word finds the smallest rank among its pairs (a segmented minimum) and merges its
pairs of that rank at once, leftmost first; then the array is compacted, and words without a pair that
could merge leave it. Equal words of a batch are merged once.

Merging all pairs of a rank at once is what merging them one by one gives, as long as no piece they make opens a pair
of the same or a smaller rank with its neighbours. Pieces that could do so are known from the vocabulary; where one does,
the word merges its pairs up to that place only in that round. Pieces of the worst rank may share it (runs of blanks do);
a long word that has only such pairs left would take a round for each, so it is finished in one pass from the left.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from sentencepiece.sentencepiece_model_pb2 import ModelProto

from .batches import parts
from .shingles import MULTIPLIER, _powers, mixed

#: Kinds of pieces in a model file, and its number for byte-pair encoding (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
#: Characters that are merged at a time; a longer word is taken whole.
SPAN = 1 << 20
#: Slots of the table of neighbouring characters; two pairs in one slot only make longer words.
_NEIGHBOURS = 1 << 22
_NONE = np.int32(0x7FFFFFFF)
#: Symbols of a word from which pairs of a shared worst rank are merged in one pass.
_LONG_RUN = 64


class Vocabulary:
    """What a model file says about symbols (single characters and pieces), and which pairs of them merge."""

    def __init__(self, path: str) -> None:
        model = ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != BPE or not model.trainer_spec.byte_fallback or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("only byte-pair models with byte fallback, without user-defined or unused pieces, are encoded")
        self.library = SentencePieceProcessor(model_file=path)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        pieces = {p.piece: (k, -p.score) for k, p in enumerate(model.pieces) if p.type == NORMAL}
        self.bytes = np.full(256, -1, np.int64)
        for k, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = k  # <0x41>
        if (self.bytes < 0).any() or min(self.begin, self.end) < 0:
            raise ValueError("the model lacks pieces for bytes, begin or end")
        long = [p for p in pieces if len(p) > 1]
        symbols = sorted({c for p in pieces for c in p} | set(long), key=lambda s: (len(s), s))
        number = {s: k for k, s in enumerate(symbols)}
        #: Ids of symbols; -1 for characters that are no piece. The last symbol stands for all other characters.
        self.ids = np.array([pieces[s][0] if s in pieces else -1 for s in symbols] + [-1], np.int64)
        self.symbol_of = np.full(0x110000, len(symbols), np.int32)
        for s in symbols:
            if len(s) == 1:
                self.symbol_of[ord(s)] = number[s]
        self._learn_pairs(long, pieces, number)
        self.neighbours = np.zeros(_NEIGHBOURS, bool)
        both = np.array(sorted({(number[a], number[b]) for p in long for a, b in zip(p, p[1:], strict=False)}), np.int64)
        self.neighbours[_slot(*both.reshape(-1, 2).T)] = True

    def _learn_pairs(self, long: list[str], pieces: dict[str, tuple[int, float]], number: dict[str, int]) -> None:
        places = {cost: k for k, cost in enumerate(sorted({pieces[p][1] for p in long}))}
        rank = {p: places[pieces[p][1]] for p in long}
        made = defaultdict(set)
        for p in long:
            made[rank[p]].add(p)
        unsafe = np.zeros(len(places) + 1, bool)
        for r, same in made.items():
            unsafe[r] = len(same) > 1
        pairs = []
        for p in long:
            for cut in range(1, len(p)):
                left, right = p[:cut], p[cut:]
                if left in number and right in number:
                    pairs.append((number[left], number[right], number[p], rank[p]))
                    for side in (left, right):
                        if side in rank and rank[p] <= rank[side]:
                            unsafe[rank[side]] = True
        table = np.array(sorted(pairs), np.int64).reshape(-1, 4)
        self.keys = (table[:, 0] << 32) | table[:, 1]
        self.merged, self.ranks = table[:, 2].astype(np.int32), table[:, 3].astype(np.int32)
        self.unsafe = unsafe
        #: The worst rank if several pieces share it, else none.
        self.shared = len(places) - 1 if places and len(made[len(places) - 1]) > 1 else -1
        self.pairs = {key: (r, m) for key, r, m in zip(self.keys.tolist(), self.ranks.tolist(), self.merged.tolist(), strict=True)}

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of what each pair makes; rank _NONE if they don't merge."""
        if not len(self.keys):
            return np.full(len(left), _NONE), np.zeros(len(left), np.int32)
        keys = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE), self.merged[at]


def _slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.uint32) * np.uint32(0x9E3779B1) + right.astype(np.uint32) * np.uint32(0x85EBCA77)) % np.uint32(_NEIGHBOURS)


@cache
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a model file, once for each worker."""
    return Vocabulary(path)


def merge_rounds(symbols: np.ndarray, starts: np.ndarray, known: Vocabulary) -> np.ndarray:
    """The symbols that remain of words (their first places are ``starts``), each at the place of its first character; others -1."""
    out = np.full(len(symbols), -1, np.int32)
    place = np.arange(len(symbols))
    word = np.zeros(len(symbols), np.int64)
    word[starts] = 1
    word = np.cumsum(word) - 1
    rank, made = _pair_ranks(symbols, word, np.arange(len(symbols)), known)
    while len(symbols):
        heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        least = np.minimum.reduceat(rank, heads)
        sizes = np.diff(np.concatenate((heads, [len(symbols)])))
        of_word = np.repeat(least, sizes)
        idle = of_word == _NONE
        out[place[idle]] = symbols[idle]
        for w in np.flatnonzero((least == known.shared) & (sizes >= _LONG_RUN)):
            own = slice(heads[w], heads[w] + sizes[w])
            ends, left = from_the_left(symbols[own].tolist(), known)
            out[place[own][ends]] = left
            idle[own] = True
        hits = np.flatnonzero((rank == of_word) & ~idle)
        hits = _leftmost(hits)
        hits = hits[_in_order(hits, symbols, word, rank, made, known)]
        symbols = symbols.copy()
        symbols[hits] = made[hits]
        kept = ~idle
        kept[hits + 1] = False
        changed = (np.cumsum(kept) - 1)[hits]
        symbols, place, word, rank, made = symbols[kept], place[kept], word[kept], rank[kept], made[kept]
        before = changed[changed > 0] - 1
        for at in (changed, before):
            rank[at], made[at] = _pair_ranks(symbols, word, at, known)
    return out


def from_the_left(symbols: list[int], known: Vocabulary) -> tuple[list[int], list[int]]:
    """What merging one pair after the other leaves of a word whose pairs all have the worst rank: first places and symbols.

    The leftmost pair merges next, unless the symbol just made opens a better one with a neighbour.
    """
    none = (int(_NONE), 0)
    places, done, at = [0], [symbols[0]], 1
    while True:
        back = known.pairs.get((done[-2] << 32) | done[-1], none) if len(done) > 1 else none
        ahead = known.pairs.get((done[-1] << 32) | symbols[at], none) if at < len(symbols) else none
        if ahead[0] < back[0]:
            done[-1] = ahead[1]
            at += 1
        elif back[0] < none[0]:
            done.pop()
            places.pop()
            done[-1] = back[1]
        elif at < len(symbols):
            places.append(at)
            done.append(symbols[at])
            at += 1
        else:
            return places, done


def _pair_ranks(symbols: np.ndarray, word: np.ndarray, at: np.ndarray, known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Rank and symbol of the pairs that begin at places ``at``; the last symbol of a word begins none."""
    following = np.minimum(at + 1, len(symbols) - 1)
    rank, made = known.look_up(symbols[at], symbols[following])
    rank[(word[at] != word[following]) | (following == at)] = _NONE
    return rank, made


def _leftmost(hits: np.ndarray) -> np.ndarray:
    """Of pairs that overlap in runs every second one."""
    order = np.arange(len(hits))
    head = np.concatenate(([True], hits[1:] != hits[:-1] + 1))[: len(hits)]
    return hits[(order - np.maximum.accumulate(np.where(head, order, 0))) % 2 == 0]


def _in_order(
    hits: np.ndarray, symbols: np.ndarray, word: np.ndarray, rank: np.ndarray, made: np.ndarray, known: Vocabulary
) -> np.ndarray:
    """Which pairs one merge after the other would take too: those of a word up to the first that opens a pair as good as itself.

    At that time the pairs to the left are merged already, those to the right are not.
    """
    kept = np.ones(len(hits), bool)
    doubtful = np.flatnonzero(known.unsafe[rank[hits]])
    if not len(doubtful):
        return kept
    at = hits[doubtful]
    new, own, last = made[at], rank[at], len(symbols) - 1
    right, left = np.minimum(at + 2, last), np.maximum(at - 1, 0)
    follows = np.zeros(len(hits), bool)
    follows[1:] = hits[1:] == hits[:-1] + 2
    left_symbol = np.where(follows[doubtful], made[np.maximum(at - 2, 0)], symbols[left])
    after = known.look_up(new, symbols[right])[0]
    after[(at + 2 > last) | (word[right] != word[at])] = _NONE
    before = known.look_up(left_symbol, new)[0]
    before[(at == 0) | (word[left] != word[at])] = _NONE
    opening = np.zeros(len(hits), bool)
    opening[doubtful] = np.minimum(after, before) <= own
    # Openings of the same word before each hit.
    passed = np.cumsum(opening) - opening
    heads = np.concatenate(([True], word[hits[1:]] != word[hits[:-1]]))
    return passed == passed[heads][np.cumsum(heads) - 1]


def encode_points(points: np.ndarray, text_starts: np.ndarray, known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of normalised texts (code points, one after the other) and the place of the character that each begins with."""
    symbols = known.symbol_of[points]
    heads = np.concatenate(([True], ~known.neighbours[_slot(symbols[:-1], symbols[1:])])) if len(points) else np.empty(0, bool)
    heads[text_starts[text_starts < len(points)]] = True
    starts = np.flatnonzero(heads)
    found = []
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + SPAN, side="right")) - 1) if starts[-1] > starts[at] + SPAN else len(starts)
        end = starts[stop] if stop < len(starts) else len(points)
        ids, places = _encode_words(symbols[starts[at] : end], points[starts[at] : end], starts[at:stop] - starts[at], known)
        found.append((ids, places + starts[at]))
        at = stop
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _encode_words(symbols: np.ndarray, points: np.ndarray, starts: np.ndarray, known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(np.concatenate((starts, [len(symbols)])))
    model = _equal_words(symbols, points, starts, sizes)
    own = np.flatnonzero(model == np.arange(len(starts)))  # words that stand for all equal ones
    flat = _ragged(starts[own], sizes[own])
    heads = np.concatenate(([0], np.cumsum(sizes[own])))[:-1]
    left = merge_rounds(symbols[flat], heads, known)
    ids, counts = _with_bytes(left, points[flat], known)
    # Tokens of every character (0 where a symbol began earlier), then of every word.
    ends = np.concatenate(([0], np.cumsum(counts)))
    first, tokens = ends[heads], np.add.reduceat(counts, heads)
    row = np.empty(len(starts), np.int64)
    row[own] = np.arange(len(own))
    row = row[model]
    places = np.repeat(np.arange(len(counts)), counts) - np.repeat(heads, tokens)
    taken = _ragged(first[row], tokens[row])
    return ids[taken], places[taken] + np.repeat(starts, tokens[row])


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of ``sizes`` from ``starts``, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _equal_words(symbols: np.ndarray, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each word the first equal one. Hashes find it, and the characters themselves confirm it."""
    up, down = _powers(1 << max(12, len(points).bit_length()))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
    hashes = mixed((sums[starts + sizes] - sums[starts]) * down[starts]) + sizes.astype(np.uint64) * MULTIPLIER
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    model = first[inverse]
    same_size = sizes[model] == sizes
    model = np.where(same_size, model, np.arange(len(starts)))
    differs = points != points[_ragged(starts[model], sizes)]
    wrong = np.add.reduceat(differs, starts, dtype=np.int64) > 0
    return np.where(wrong, np.arange(len(starts)), model)


def _with_bytes(left: np.ndarray, points: np.ndarray, known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the symbols, and their number at every place; a character that is no piece gives the pieces of its UTF-8 bytes."""
    at = np.flatnonzero(left >= 0)
    ids = known.ids[left[at]]
    lost = np.flatnonzero(ids < 0)
    counts = np.zeros(len(left), np.int64)
    counts[at] = 1
    if not len(lost):
        return ids, counts
    encoded = points[at[lost]].astype("<u4").tobytes().decode("utf-32-le").encode()
    lengths = 1 + np.sum([points[at[lost]] >= limit for limit in (0x80, 0x800, 0x10000)], axis=0)
    counts[at[lost]] = lengths
    widths = np.ones(len(ids), np.int64)
    widths[lost] = lengths
    out = np.repeat(ids, widths)
    out[out < 0] = known.bytes[np.frombuffer(encoded, np.uint8)]
    return out, counts


def encode(texts: list[str], known: Vocabulary) -> list[np.ndarray]:
    """The ids of each text, with begin and end."""
    if not texts:
        return []
    normal = [known.library.normalize(t) if t else "" for t in texts]
    points = np.frombuffer("".join(normal).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) for t in normal])
    ids, places = encode_points(points, np.concatenate(([0], ends))[:-1], known)
    cuts = np.searchsorted(places, ends)
    return [np.concatenate(([known.begin], own, [known.end])) for own in np.split(ids, cuts[:-1])]


def char_parts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of batches with texts of about SPAN bytes; a longer text is a part of its own."""
    for batch in parts(batches):
        sizes = np.cumsum([len(t or b"") for t in batch.column(column).cast(pa.binary()).to_pylist()])
        at = 0
        while at < batch.num_rows:
            passed = sizes[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(sizes, passed + SPAN, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def encoded(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (with begin and end) and ``decoded`` text of every row of ``docs``, as the library gives them for ``model``.

    ``model`` is the path of a byte-pair model with byte fallback on every worker; others are an error. Whole texts are
    encoded, without sampling. A null text counts as empty: begin and end only. A text without white space is
    as good as any; the time of a word grows with its length times the different ranks in it. Rows that repeat
    others or have no doc_id are encoded all the same; an empty table gives no rows. Other columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, decoded in _both_ways(batches, model):
            columns = [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    return given.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of what ``encoded`` gives, without passing it on."""
    kind = docs.schema[doc_id].dataType.simpleString()
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, decoded in _both_ways(batches, model):
            columns = [
                batch.column("doc_id"),
                pa.array([len(i) for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return given.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _both_ways(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[str]]]:
    known = vocabulary(model)
    for batch in char_parts(batches):
        ids = encode([t or "" for t in batch.column("text").to_pylist()], known)
        yield batch, ids, known.library.decode([i.tolist() for i in ids])

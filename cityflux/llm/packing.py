"""Best-fit packing: documents into as few sequences of at most ``capacity`` tokens as possible.

Only the histogram of piece lengths, at most ``capacity`` numbers whatever the input, reaches the
driver. There the configuration linear program (how often to use each way of filling a sequence) is
solved by multiplicative weights: a knapsack dynamic program prices the fillings, lengths served
too little get dearer, those served too much cheaper. The fractional solution is rounded down and what
is left goes by best fit, all on counts. Each piece then
finds its sequence from its length and its rank among pieces of that length.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityflux.llm.common import chunks, even_ranks
from cityflux.plans.scratch import materialize

CAPACITY = 2048
# Rounds of multiplicative weights.
ROUNDS = 80
# Spacing other than single blanks and line ends between words.
_ODD_SPACES = r"^$|^[ \n]|[ \n]$|[ \n][ \n]|[\t\r\x{b}\x{c}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Distinct words whose ids a Python worker remembers.
REMEMBERED = 300_000
# Bytes of texts encoded together.
BLOCK_BYTES = 6_000_000


def default_tokenizer() -> str:
    """A name among the public vocabulary files, found where it is read; a path works too."""
    return "byte_bpe_50k.tiktoken"


# --- tokens ---------------------------------------------------------------------------------


class Encoder:
    """Token ids of whole texts, as arrays of unsigned 32-bit numbers.

    The vocabulary never joins across a single blank or line end between two words, so the distinct
    words of a block of texts are encoded once and each text is put together from them. Texts with
    other spacing are encoded as they are, and so are those that hold one of the vocabulary's added tokens
    (such as ``<|endoftext|>``), which have ids of their own. Rank files and ``.json`` files of one vocabulary
    give the same ids; the former are faster, and take the added tokens from the latter.
    """

    def __init__(self, file: str):
        import public_tokenizers

        path = file if "/" in file else public_tokenizers.path(file)
        added = f"{path.rsplit('.', 1)[0]}.json"
        self._added = {}
        if os.path.exists(added):
            with open(added, encoding="utf-8") as told:
                self._added = {t["content"]: t["id"] for t in json.load(told)["added_tokens"]}
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            self.whole = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        else:
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
            ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            # The library cuts texts at added tokens first, the longest at a place.
            cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self._added, key=len, reverse=True)) + ")") if self._added else None

            def whole(text: str) -> np.ndarray:
                parts = cut.split(text) if cut else [text]
                ids = [[self._added[part]] if k % 2 else ranked.encode_ordinary(part) for k, part in enumerate(parts)]
                return np.array([x for own in ids for x in own], np.uint32)

            self.whole = whole
        self._line = self.whole("\n")[0]
        # Words seen before: their ids lie in _ids from _start on, _size of them.
        self._words = pa.array([], pa.string())
        self._ids, self._start, self._size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; none may be null."""
        odd = pc.match_substring_regex(texts, _ODD_SPACES).to_numpy(zero_copy_only=False)
        for token in self._added:
            odd = odd | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        even = iter(self._together(texts.filter(pa.array(~odd))))
        return [self.whole(text.as_py()) if is_odd else next(even) for text, is_odd in zip(texts, odd)]

    def _together(self, texts: pa.Array) -> list[np.ndarray]:
        """Texts whose words stand between single blanks and line ends."""
        if not len(texts):
            return []
        # A word after a blank keeps it; one after a line end, or the first, does not.
        lists = pc.split_pattern(pc.replace_substring(texts, " ", "\n "), "\n")
        coded = lists.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        pool, start, size, own = self._look_up(coded.dictionary)
        firsts = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
        skip = np.zeros(len(at), np.int64)
        skip[firsts] = ~own[at[firsts]]
        begin, count = start[at] + skip, size[at] - skip
        ends = np.cumsum(count)
        flat = pool[np.arange(ends[-1]) + np.repeat(begin - ends + count, count)]
        return np.split(flat, ends[firsts[1:] - 1])


    def _look_up(self, words: pa.Array) -> tuple[np.ndarray, ...]:
        """A pool of ids, and of each word: where it starts there, how many ids it has, whether it brings a blank.

        A word that brings no blank stands after a line end, whose id is its first.
        """
        place = pc.index_in(words, value_set=self._words)
        new = words.filter(pc.is_null(place))
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(new)], new), "\n")[0].as_py()
        ids = self.whole("\n" + joined) if len(new) else np.zeros(0, np.uint32)
        lines = np.flatnonzero(ids == self._line)
        blank = pc.starts_with(words, " ").to_numpy(zero_copy_only=False)
        known = ~pc.is_null(place).to_numpy(zero_copy_only=False)
        fresh = lines + blank[~known]
        pool = np.concatenate((self._ids, ids))
        starts = np.concatenate((self._start, fresh + len(self._ids)))
        sizes = np.concatenate((self._size, np.append(lines[1:], len(ids))[: len(lines)] - fresh))
        row = np.empty(len(words), np.int64)
        row[known] = pc.drop_null(place).to_numpy()
        row[~known] = len(self._words) + np.arange(len(new))
        if len(self._words) + len(new) <= REMEMBERED:
            self._words = pa.concat_arrays([self._words, new])
            self._ids, self._start, self._size = pool, starts, sizes
        return pool, starts[row], sizes[row], blank


_ENCODERS: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """One encoder per Python worker and file."""
    if file not in _ENCODERS:
        _ENCODERS[file] = Encoder(file)
    return _ENCODERS[file]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole if it fits, else full pieces after a first that may be shorter."""
    first = length % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document (its tokens, then id 0)."""
    file = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(file)
        for batch in batches:
            for part in chunks(batch, most=BLOCK_BYTES):
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), coder.encode(part.column("text").fill_null(""))):
                    ids = np.append(ids, np.uint32(0)).astype("<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        rows.append((doc, k, start, length, zlib.crc32(ids[start : start + length])))
                columns = list(zip(*rows))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


# --- the plan on counts ---------------------------------------------------------------------


def _knapsack(weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value within each capacity, and the length taken there (0: none); lengths may repeat.

    ``weights[s]`` is the price of length s (-1 where there is none).
    """
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        values = weights[1 : c + 1] + best[c - 1 :: -1]
        at = int(values.argmax())
        if values[at] > best[c - 1]:
            best[c], taken[c] = values[at], at + 1
        else:
            best[c], taken[c] = best[c - 1], 0
    return best, taken


def _filling(first: int, taken: np.ndarray, capacity: int) -> tuple[int, ...]:
    """The dearest filling that contains ``first``."""
    out, left = [first], capacity - first
    while left > 0:
        if taken[left]:
            out.append(int(taken[left]))
            left -= out[-1]
        else:
            left -= 1
    return tuple(sorted(out, reverse=True))


def _fractional(counts: dict[int, int], capacity: int, rounds: int, step: float = 1.0, slack: float = 0.005) -> dict[tuple[int, ...], float]:
    """Fillings and how often to use them, by multiplicative weights over the lengths.

    Each round every length asks for its share of the round in the dearest filling it is part of,
    if that is within ``slack`` of the dearest of all.
    """
    lengths = np.array(sorted(counts))
    need = np.array([counts[s] for s in lengths], float)
    at = {int(s): i for i, s in enumerate(lengths)}
    price = lengths / capacity
    served = np.zeros(len(lengths))
    used: dict[tuple[int, ...], float] = Counter()
    for r in range(1, rounds + 1):
        weights = np.full(capacity + 1, -1.0)
        weights[lengths] = price
        best, taken = _knapsack(weights, capacity)
        value = price + best[capacity - lengths]
        for i in np.argsort(-value):
            missing = need[i] * r / rounds - served[i]
            if missing <= 0 or value[i] < (1 - slack) * best[capacity]:
                continue
            filling = _filling(int(lengths[i]), taken, capacity)
            inside = Counter(filling)
            times = missing / inside[int(lengths[i])]
            used[filling] += times
            for s, k in inside.items():
                served[at[s]] += times * k
        ahead = served / need - r / rounds
        price = np.maximum(price * np.exp(-step * np.clip(ahead, -0.5, 0.5) / np.sqrt(r)), 1e-9)
    return used


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit of what is left, longest first, on counts: open sequences with equal contents move together."""
    open_: dict[int, Counter] = {}  # room -> contents -> sequences
    for s in sorted(left, reverse=True):
        n = left[s]
        while n > 0:
            room = min((r for r, held in open_.items() if r >= s and held), default=None)
            if room is None:
                fit = min(capacity // s, n)
                many = n // fit
                open_.setdefault(capacity - s * fit, Counter())[(s,) * fit] += many
                n -= many * fit
                continue
            contents, many = next(iter(open_[room].items()))
            fit = min(room // s, n)
            moved = min(many, n // fit)
            open_[room][contents] -= moved
            if not open_[room][contents]:
                del open_[room][contents]
            open_.setdefault(room - s * fit, Counter())[contents + (s,) * fit] += moved
            n -= moved * fit
    return [(contents, many) for held in open_.values() for contents, many in held.items()]


def plan(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a filling, sequences filled so); every piece is in one, none is used twice."""
    left = {s: n for s, n in counts.items() if n > 0}
    out: Counter = Counter()
    if left.get(capacity):
        out[(capacity,)] = left.pop(capacity)
    if not left:
        return list(out.items())

    def use(filling: tuple[int, ...], most: float) -> None:
        inside = Counter(filling)
        times = int(min(most, min(left[s] // k for s, k in inside.items())))
        if times > 0:
            out[filling] += times
            for s, k in inside.items():
                left[s] -= times * k

    used = _fractional(left, capacity, rounds)
    fullest = sorted(used, key=lambda f: (-sum(f), -used[f], f))
    for filling in fullest:
        use(filling, used[filling])
    for filling, many in _best_fit({s: n for s, n in left.items() if n}, capacity):
        out[filling] += many
    return list(out.items())


def places(planned: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, times inside, first sequence, offset), sorted by length and first rank."""
    ranks: Counter = Counter()
    rows, sequence = [], 0
    for filling, many in planned:
        offset = 0
        for s, k in sorted(Counter(filling).items(), reverse=True):
            rows.append((s, ranks[s], k, sequence, offset))
            ranks[s] += many * k
            offset += s * k
        sequence += many
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of one token (id 0). A null doc_id stays null. Repeated rows
    are packed each. An empty table gives no rows. Other columns than doc_id and text are left out.
    """
    held = materialize(pieces(docs, capacity, tokenizer), "pieces")
    counts = {r["length"]: r["count"] for r in held.groupBy("length").count().collect()}
    table = places(plan(counts, capacity, rounds))
    ranked = even_ranks(held, ["length"], ["doc_id", "piece", "ids_crc32"], sum(counts.values()), "rank")
    # Lengths are below 2^22 and ranks below 2^41: one sorted key finds the place.
    keys = (table[:, 0] << 41) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(keys, (length << 41) + rank, side="right") - 1]
            within = rank - row[:, 1]
            sequence = row[:, 3] + within // row[:, 2]
            offset = row[:, 4] + within % row[:, 2] * length
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long")).mapInArrow(run, schema)


def sequences(docs: DataFrame, packed: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array of at most ``capacity``), doc_ids of its pieces in order.

    ``docs`` must hold each doc_id once, as it was packed.
    """
    file = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(file)
        for batch in batches:
            for part in chunks(batch, most=BLOCK_BYTES):
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), coder.encode(part.column("text").fill_null(""))):
                    ids = np.append(ids, np.uint32(0)).astype(np.int32)
                    rows += [(doc, k, ids[a : a + n]) for k, (a, n) in enumerate(cut(len(ids), capacity))]
                doc, piece, tokens = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(tokens, pa.list_(pa.int32()))], names=["doc_id", "piece", "ids"])

    cut_up = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, ids array<int>")
    placed = packed.select("doc_id", "piece", "sequence_id", "offset").join(cut_up, ["doc_id", "piece"])
    held = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return placed.groupBy("sequence_id").agg(held.alias("held")).select("sequence_id", F.flatten("held.ids").alias("ids"), F.col("held.doc_id").alias("doc_ids"))

"""Best-fit packing by a configuration linear program.

1. Documents become token counts; only longer ones than a sequence are cut.
2. The histogram of piece lengths (one number per length, whatever the
   corpus) goes to the driver.  The configuration program asks for
   non-negative amounts of fillings ("so many pieces of each length, together
   at most the capacity") that cover the histogram with as few sequences as
   possible.  Multiplicative weights solve it: each length has a price that
   falls exponentially with its cover; a knapsack dynamic program finds the
   dearest fillings at these prices, which also bounds the program from below;
   fillings near the best grow.
3. Amounts are rounded down; what is left over is packed best-fit, largest
   first, length by length.  The residual may instead be filled greedily by
   price first, and plain best-fit of everything competes: the plan of fewest
   sequences is taken.
4. Pieces are numbered within their length (counted per shard, so that no
   length sits in one task) and look up their place in the plan, whose size is
   bounded by capacity and rounds, not by the corpus.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import on_workers, partitions, rows_of, saved, table

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
#: The byte-level pre-tokenizer's words, for texts without characters above U+024F and without U+001C to U+001F.
LATIN_WORDS = re.compile(rf" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9²³¹¼-¾]+| ?[^\s{LETTERS}0-9²³¹¼-¾]+|\s+(?!\S)|\s+").findall
OTHER = re.compile("[^\x00-\x1b\x20-ɏ]").search


def spaced_words(text: str) -> list[str]:
    """Coarser cuts for any text: a byte-level word starts at every space that stands before another character than white space."""
    head, *rest = text.split(" ")
    words = [head]
    for w in rest:
        if w and not w[0].isspace():
            words.append(" " + w)
        else:
            words[-1] += " " + w
    return words


class WordTokens:
    """Token ids of texts as by the tokenizers library with a byte-level vocabulary.

    Words are tokenized once and remembered (a bounded table of two
    generations).  Texts that hold an added token go to the library whole.
    """

    def __init__(self, path: str, remembered: int = 150_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.remembered = remembered

    def _ids(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        got = self.old.get(word) or self._ids(word)
        if len(word) <= 64:  # very long words aren't kept
            if len(self.young) >= self.remembered:
                self.old, self.young = self.young, {}
            self.young[word] = got
        return got

    def encode(self, text: str) -> bytes:
        for a in self.added:
            if a in text:
                return WordTokens._ids(self, text)
        words = spaced_words(text) if OTHER(text) else LATIN_WORDS(text)
        got = list(map(self.young.get, words))
        if None in got:
            got = [g or self._word(w) for g, w in zip(got, words)]
        return b"".join(got)


class FastWordTokens(WordTokens):
    """The same ids by tiktoken, for vocabularies whose merges it can hold as ranks."""

    def __init__(self, path: str, ranks: str, pattern: str, remembered: int = 150_000):
        import tiktoken

        super().__init__(path, remembered)
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def _ids(self, text: str) -> bytes:
        return array("I", self.encoding.encode_ordinary(text)).tobytes()


_TOKENS: dict[tuple, WordTokens] = {}


def tokens_of(vocabulary: str, ranks: tuple[str, str] | None) -> WordTokens:
    key = (vocabulary, ranks)
    if key not in _TOKENS:
        _TOKENS[key] = FastWordTokens(vocabulary, *ranks) if ranks else WordTokens(vocabulary)
    return _TOKENS[key]


def pieces(docs: DataFrame, vocabulary: str, ranks: tuple[str, str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Rows of ``PIECES``; ``row`` numbers equal ids apart so that repeated rows stay apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens_of(vocabulary, ranks)
        end = np.array([END_ID], "<u4").tobytes()
        for ids, rows, texts in rows_of(batches, "doc_id", "row", "text"):
            out: list[tuple] = []
            for i, row, t in zip(ids, rows, texts):
                b = tok.encode(t or "") + end
                n = len(b) // 4
                first = n % capacity or capacity
                at = 0
                for k, stop in enumerate(range(first, n + 1, capacity)):
                    out.append((i, row, k, at, stop - at, zlib.crc32(b[4 * at : 4 * stop])))
                    at = stop
            cols = list(zip(*out)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types)], ["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return numbered.mapInArrow(run, PIECES)


# --- the plan, on the driver ---------------------------------------------------------------


def plan_for(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], int]], int]:
    """The plan of fewest sequences among the rounded program, its residual filled by price, and plain best-fit; with the program's lower bound."""
    volume = -(-sum(x * n for x, n in histogram.items()) // capacity)
    plain = rounded(histogram, [], capacity)
    if _sequences(plain) == volume:
        return plain, volume
    fillings, bound = solve(histogram, plain, capacity)
    floors = [(f, int(x + 1e-9)) for f, x in fillings]
    left = dict(histogram)
    for f, n in floors:
        for x, k in f.items():
            left[x] -= k * n
    plans = [plain, rounded(histogram, fillings, capacity)]
    for bulk in (0.02, 0.1):
        plans.append(rounded(histogram, floors + filled(left, capacity, bulk=bulk), capacity))
        plans.append(rounded(histogram, filled(histogram, capacity, bulk=bulk), capacity))
    return min(plans, key=_sequences), max(bound, volume)


def _sequences(plan: list[tuple[dict[int, int], int]]) -> int:
    return sum(n for _, n in plan)


def _knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each room 0..capacity, and the length taken last (0: none)."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    lengths = np.flatnonzero(price > 0)
    values = price[lengths]
    for room in range(1, capacity + 1):
        k = int(np.searchsorted(lengths, room, side="right"))
        if k:
            got = best[room - lengths[:k]] + values[:k]
            j = int(np.argmax(got))
            if got[j] > best[room - 1]:
                best[room], took[room] = got[j], lengths[j]
                continue
        best[room] = best[room - 1]
    return best, took


def _around(length: int, took: np.ndarray, capacity: int) -> dict[int, int]:
    """The dearest filling that holds a piece of this length."""
    filling = {int(length): 1}
    room = capacity - int(length)
    while room > 0:
        if not took[room]:
            room -= 1
            continue
        filling[int(took[room])] = filling.get(int(took[room]), 0) + 1
        room -= int(took[room])
    return filling


def solve(
    histogram: dict[int, int], first: list[tuple[dict[int, int], int]], capacity: int = CAPACITY, accuracy: float = 0.05, pricings: int = 12, steps: int = 20_000
) -> tuple[list[tuple[dict[int, int], float]], int]:
    """Fillings with amounts that cover the histogram exactly, and a lower bound of the sequences, by multiplicative weights.

    The covering program: least sum of amounts, each length covered as often
    as the histogram says.  A length's weight falls exponentially with its
    cover; its price is its weight by its count.  In each step all known
    fillings whose value at these prices is near the best get more, in
    proportion to what they have.  Now and then the knapsack prices all
    fillings there are: at first the dearest around each length, later the
    dearest alone, are added if they beat those known, and its value gives a
    dual bound, both for the present prices and for their average.  The steps
    end when every length has been covered ``log(lengths) / accuracy ** 2``
    times, in scaled amounts.  ``first`` are the fillings to begin with;
    ``pricings`` bulk additions and ``steps`` steps are the most.
    """
    lengths = np.array(sorted(x for x, n in histogram.items() if n > 0))
    need = np.array([histogram[x] for x in lengths], dtype=float)
    row = {int(x): i for i, x in enumerate(lengths)}
    known: dict[tuple, int] = {}
    entries: list[tuple[int, int, float]] = []  # row, filling, pieces by need

    def add(filling: dict[int, int]) -> None:
        key = tuple(sorted(filling.items()))
        if key not in known:
            known[key] = len(known)
            entries.extend((row[x], known[key], k / need[row[x]]) for x, k in filling.items())

    def priced(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        price = np.zeros(capacity + 1)
        price[lengths] = weight / need
        return _knapsack(price, capacity)

    for f, _ in first:
        add(f)
    goal = np.log(max(len(lengths), 2)) / accuracy**2
    every = max(5, int(goal / 25))
    cover, amount = np.zeros(len(lengths)), np.zeros(0)
    mean, bound, worth = np.zeros(len(lengths)), 0.0, 0.0
    for step in range(steps):
        open_ = cover < goal
        if not open_.any():
            break
        # At first a price is the length, whose dual bound is that of the volume.
        weight = np.where(open_, lengths * need * np.exp(-accuracy * (cover - cover[open_].min())), 0.0)
        weight /= weight.sum()
        mean += weight
        if step % every == 0:
            best, took = priced(weight)
            bound = max(bound, 1 / best[capacity])
            if step == 0 or best[capacity] > worth * (1 + accuracy / 50):
                value = best[capacity - lengths] + weight / need
                for x in lengths[weight > 0] if step < every * pricings else [lengths[np.argmax(value)]]:
                    add(_around(x, took, capacity))
                r, c, m = (np.array(v) for v in zip(*entries))
                least = np.full(len(known), np.inf)
                np.minimum.at(least, c, 1 / m)
                amount = np.concatenate([amount, np.zeros(len(known) - len(amount))])
                amount = np.maximum(amount, 1e-3 * least / len(known))
                cover = np.bincount(r, m * amount[c], minlength=len(lengths))
        value = np.bincount(c, m * weight[r], minlength=len(known))
        worth = value.max()
        more = np.where(value >= worth * (1 - accuracy), amount, 0.0)
        gain = np.bincount(r, m * more[c], minlength=len(lengths))
        pace = min(1.0, 1.0 / gain.max())
        amount += pace * more
        cover += pace * gain
    bound = int(np.ceil(max(bound, 1 / priced(mean / mean.sum())[0][capacity]) - 1e-6))
    if cover.min() <= 0:
        return [(dict(f), float(n)) for f, n in first], bound
    amount /= cover.min()
    return _trimmed([(dict(f), amount[i]) for f, i in known.items() if amount[i] > 1e-9], histogram), bound


def _trimmed(fillings: list[tuple[dict[int, int], float]], histogram: dict[int, int]) -> list[tuple[dict[int, int], float]]:
    """The amounts cut, fullest fillings kept first, so that no length is covered more often than the histogram has it."""
    left = {x: float(n) for x, n in histogram.items()}
    out = []
    for f, n in sorted(fillings, key=lambda x: (-sum(a * k for a, k in x[0].items()), -x[1], sorted(x[0].items()))):
        n = min([n, *(left[x] / k for x, k in f.items())])
        if n > 1e-9:
            for x, k in f.items():
                left[x] -= k * n
            out.append((f, n))
    return out


def filled(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 64, rate: float = 0.05, tolerance: float = 1e-3, bulk: float = 0.02) -> list[tuple[dict[int, int], float]]:
    """Fillings for whole pieces, the dearest first, each used until one of its lengths runs out.

    Every round prices a length that is still open at
    ``length ** (1 + bulk) * exp(-rate * covered share)``, solves one knapsack
    and takes, for each open length, the best filling that holds it, if its
    value is within ``tolerance`` of the best of all.  ``bulk`` over 0 keeps
    short pieces for the ends.
    """
    need = np.zeros(capacity + 1)
    for length, n in histogram.items():
        need[length] = n
    left, total = need.copy(), np.maximum(need, 1)
    made: list[tuple[dict[int, int], float]] = []
    for _ in range(rounds):
        open_ = np.flatnonzero(left >= 1)
        if not len(open_):
            break
        covered = 1 - left / total
        price = np.where(left >= 1, np.arange(capacity + 1) ** (1 + bulk) * np.exp(-rate * covered), 0)
        best, took = _knapsack(price, capacity)
        used = False
        for length in open_[::-1]:
            if left[length] < 1 or price[length] + best[capacity - length] < best[capacity] * (1 - tolerance):
                continue
            filling = _around(length, took, capacity)
            amount = int(min(left[x] // k for x, k in filling.items()))
            if amount < 1:
                continue
            for x, k in filling.items():
                left[x] -= k * amount
            made.append((filling, float(amount)))
            used = True
        if not used:
            tolerance *= 2
            if tolerance > 0.2:
                break
    return made


def rounded(histogram: dict[int, int], fillings: list[tuple[dict[int, int], float]], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Whole amounts: fillings rounded down, then the rest best-fit, largest first."""
    left = dict(histogram)
    plan: list[tuple[dict[int, int], int]] = []
    rooms: dict[int, list[list]] = {}  # room left: [filling, amount]
    sizes: list[int] = []

    def put(filling: dict[int, int], n: int) -> None:
        room = capacity - sum(x * k for x, k in filling.items())
        if room <= 0:
            plan.append((filling, n))
            return
        if room not in rooms:
            rooms[room] = []
            insort(sizes, room)
        rooms[room].append([filling, n])

    for filling, amount in fillings:
        n = min([int(amount + 1e-9), *(left.get(x, 0) // k for x, k in filling.items())])
        if n > 0:
            for x, k in filling.items():
                left[x] -= k * n
            put(filling, n)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n > 0:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                k = capacity // length
                if n >= k:
                    put({length: k}, n // k)
                    n %= k
                else:
                    put({length: n}, 1)
                    n = 0
                continue
            room = sizes[at]
            filling, m = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                sizes.pop(at)
            k = min(room // length, n)
            use = min(m, n // k)
            if m > use:
                put(filling, m - use)
            put({**filling, length: filling.get(length, 0) + k}, use)
            n -= k * use
    return plan + [(f, m) for r in rooms.values() for f, m in r]


def places(plan: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """For ranks of each length: first rank, first sequence, pieces a sequence, offset; sorted by (length, first rank)."""
    rows, base, seen = [], 0, {}
    for filling, n in plan:
        at = 0
        for length, k in sorted(filling.items(), reverse=True):
            rows.append((length, seen.get(length, 0), base, k, at))
            seen[length] = seen.get(length, 0) + k * n
            at += length * k
        base += n
    rows.sort()
    return tuple(np.array([r[i] for r in rows], dtype=np.int64) for i in range(5))


def pack(docs: DataFrame, vocabulary: str | None = None, ranks: tuple[str, str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and the place in it.

    Null texts count as empty (one token, the end id); very long ones are cut
    into as many pieces as they need; repeated rows are packed each; pieces of
    one length tie and take their places by id, row and piece; extra columns
    are ignored; an empty table gives no rows.  Sequences are numbered from 0
    and filled without gaps.
    """
    spark = on_workers(docs.sparkSession)
    if vocabulary is None:
        import public_tokenizers as P

        vocabulary, ranks = default_vocabulary(), (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    cut = saved(pieces(docs, vocabulary, ranks, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(places(plan_for(histogram, capacity)[0]))

    shards = partitions(spark)
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(shards)).cast("int"))
    counts = cut.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")
    counts = counts.select("length", "shard", before.alias("base"))
    order = Window.partitionBy("length", "shard").orderBy("doc_id", "row", "piece")
    ranked = cut.withColumn("at", F.row_number().over(order) - 1).join(counts, ["length", "shard"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("at"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, base, each, offset = plan.value
        key = length << 44 | first
        for b in batches:
            t = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            ln, rank = t["length"].to_numpy(), t["rank"].to_numpy()
            k = np.searchsorted(key, ln << 44 | rank, side="right") - 1
            at = rank - first[k]
            cols = [t[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            cols += [pa.array(base[k] + at // each[k]), pa.array(offset[k] + at % each[k] * ln)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of 1024 tokens; edge cases as in ``pack``."""
    return pack(table(spark, sf_dir, "documents"))

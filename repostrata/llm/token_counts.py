"""Token counts under a byte-level BPE vocabulary, by rank-synchronous merging of arrays.

A text is cut at added tokens, then into pre-tokens. The distinct new pre-tokens of a bounded
stretch of text stand one behind the other in one array of symbols. Each round looks up the
ranks of all neighbouring pairs at once and merges, in every sequence, all occurrences of its
lowest pair; a sequence without a known pair is done, and its symbols are counted.

A round costs the length of what is left, so a sequence of many thousand symbols would cost
its square. Sequences of more than ``LONG`` symbols are merged together instead, one rank
after the other in ascending order with linked neighbours: at most one step per merge rule.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from repostrata.llm.common import as_bytes, settle

LIMIT = 512
LONG = 256
STRETCH = 1 << 20  # characters of text whose pre-tokens are held at a time
_CACHED = 200_000  # pre-tokens whose counts a task keeps; short ones only
_SHORT = 48
_NONE = np.int64(1 << 62)
# Fixed value: the pattern that byte-level vocabularies split texts by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _alphabet() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merge rules as arrays: bounded by the vocabulary file, so they travel with the task."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, before = content["model"], content.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True)
        odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if not plain or before.get("add_prefix_space") or content.get("normalizer") or any(model.get(k) for k in odd):
            raise ValueError("only byte-level BPE without a normalizer is counted")
        self.added = [a["content"] for a in content.get("added_tokens", [])]
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in content.get("added_tokens", [])):
            raise ValueError("added tokens with white space rules are not counted")
        ids = model["vocab"]
        rules = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = np.int64(max(ids.values()) + 1)
        self.symbol = np.zeros(256, np.int64)
        for char, byte in _alphabet().items():
            self.symbol[byte] = ids[char]
        left, right, self.made = (np.array(c, np.int64) for c in zip(*((ids[a], ids[b], ids[a + b]) for a, b in rules)))
        # A rule comes after those that make its parts, and no two make the same symbol: so a
        # merge never opens a pair of a lower rank, and all occurrences of a rank go at once.
        first = np.full(self.size, _NONE)
        first[self.symbol] = -1
        first[self.made] = np.arange(len(rules))
        if len(np.unique(self.made)) < len(rules) or (np.maximum(first[left], first[right]) >= np.arange(len(rules))).any():
            raise ValueError("merge rules are not in the order in which their symbols arise")
        # Ranks lie in hash tables, each for the pairs that found no place in those before.
        self.keys = np.r_[left * self.size + right, -1]
        self.tables: list[tuple[np.uint64, np.ndarray]] = []
        rest, rng = np.arange(len(rules)), np.random.default_rng(3)
        while len(rest):
            factor = rng.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            table = np.full(1 << (len(rest) * 16).bit_length(), -1, np.int32)
            slots = self._slots(self.keys[rest], factor, table)
            table[slots] = rest
            self.tables.append((factor, table))
            rest = rest[table[slots] != rest]

    @staticmethod
    def _slots(keys: np.ndarray, factor: np.uint64, table: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * factor) >> np.uint64(65 - len(table).bit_length())

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or a number above all ranks where no rule merges it."""
        wanted = left * self.size + right
        out = np.full(len(wanted), _NONE)
        for factor, table in self.tables:
            at = table[self._slots(wanted, factor, table)]
            found = self.keys[at] == wanted
            out[found] = at[found]
        return out


def _every_other(follows: np.ndarray) -> np.ndarray:
    """Of hits that overlap the one before where ``follows``, the first, third, ... of each run."""
    place = np.arange(len(follows))
    start = np.maximum.accumulate(np.where(follows, 0, place))
    return (place - start) % 2 == 0


def _rounds(symbols: np.ndarray, owner: np.ndarray, out: np.ndarray, rules: Vocabulary) -> None:
    """Write into ``out`` how many symbols are left of each sequence; ``owner`` numbers them."""
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        rank = np.full(len(symbols), _NONE)
        rank[:-1] = np.where(owner[1:] == owner[:-1], rules.ranks(symbols[:-1], symbols[1:]), _NONE)
        lowest = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.r_[starts, len(symbols)])
        done = lowest == _NONE
        out[owner[starts[done]]] = sizes[done]
        hits = np.flatnonzero((rank == np.repeat(lowest, sizes)) & (rank != _NONE))
        hits = hits[_every_other(np.r_[False, hits[1:] == hits[:-1] + 1])] if len(hits) else hits
        symbols[hits] = rules.made[rank[hits]]
        stay = np.repeat(~done, sizes)
        stay[hits + 1] = False
        symbols, owner = symbols[stay], owner[stay]


def _ascending(symbols: np.ndarray, owner: np.ndarray, out: np.ndarray, rules: Vocabulary) -> None:
    """The same for long sequences: all pairs of one rank, then all of the next."""
    size = len(symbols)
    place = np.arange(size)
    joined = np.r_[owner[1:] == owner[:-1], False]
    after = np.where(joined, place + 1, -1)
    before = np.where(np.r_[False, joined[:-1]], place - 1, -1)
    alive = np.ones(size, bool)
    rank = np.full(size, _NONE)
    rank[joined] = rules.ranks(symbols[:-1][joined[:-1]], symbols[1:][joined[:-1]])
    waiting: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def put(where: np.ndarray) -> None:
        where = where[rank[where] != _NONE]
        where = where[np.argsort(rank[where], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[where])) + 1
        for part in np.split(where, cuts) if len(where) else ():
            key = int(rank[part[0]])
            if key not in waiting:
                waiting[key] = []
                heapq.heappush(heap, key)
            waiting[key].append(part)

    put(place)
    while heap:
        now = heapq.heappop(heap)
        hits = np.unique(np.concatenate(waiting.pop(now)))
        hits = hits[alive[hits] & (rank[hits] == now)]
        if not len(hits):
            continue
        hits = hits[_every_other(np.r_[False, after[hits[:-1]] == hits[1:]])]
        gone = after[hits]
        alive[gone] = False
        rank[gone] = _NONE
        symbols[hits] = rules.made[now]
        after[hits] = after[gone]
        linked = after[hits] >= 0
        before[after[hits[linked]]] = hits[linked]
        touched = np.unique(np.r_[hits, before[hits]])
        touched = touched[touched >= 0]
        rank[touched] = _NONE
        touched = touched[after[touched] >= 0]
        rank[touched] = rules.ranks(symbols[touched], symbols[after[touched]])
        put(touched)
    numbers, counts = np.unique(owner[alive], return_counts=True)
    out[numbers] = counts


def symbols_left(pieces: list[bytes], rules: Vocabulary) -> np.ndarray:
    """How many symbols each pre-token consists of after all merges."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    symbols = rules.symbol[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), sizes)
    out = np.zeros(len(pieces), np.int64)
    long = np.repeat(sizes > LONG, sizes)
    _rounds(symbols[~long], owner[~long], out, rules)
    if long.any():
        _ascending(symbols[long], owner[long], out, rules)
    return out


def counter(rules: Vocabulary) -> Callable[[list[bytes]], list[int]]:
    """A function from UTF-8 texts to their numbers of tokens."""
    split = regex.compile(PATTERN).findall
    seam = regex.compile(r"(?<=\S)\s")
    added = regex.compile("|".join(regex.escape(a) for a in sorted(rules.added, key=len, reverse=True)) or r"(?!)")
    known: dict[str, int] = {}

    def stretches(text: str) -> Iterator[str]:
        """Pieces of a text; a pre-token always ends where white space follows something else."""
        at = 0
        while len(text) - at > 2 * STRETCH:
            cut = seam.search(text, at + STRETCH)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def count(texts: list[bytes]) -> list[int]:
        totals, held, size = [0] * len(texts), [], 0

        def settle_held() -> None:
            new = set().union(*(pieces for _, pieces in held))
            if len(known) > _CACHED:
                known.clear()
            new = list(new.difference(known))
            known.update(zip(new, symbols_left([p.encode() for p in new], rules).tolist()))
            for i, pieces in held:
                totals[i] += sum(map(known.__getitem__, pieces))
            for p in new:
                if len(p) > _SHORT:
                    del known[p]
            held.clear()

        for i, raw in enumerate(texts):
            text = raw.decode("utf-8", "replace")
            parts = added.split(text)
            totals[i] += len(parts) - 1
            for part in parts:
                for piece in stretches(part):
                    held.append((i, split(piece)))
                    size += len(piece)
                    if size >= STRETCH:
                        settle_held()
                        size = 0
        settle_held()
        return totals

    return count


def counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``: one row per row of ``docs``, without a shuffle.

    ``path`` is a vocabulary file on the driver. Added tokens inside a text count as one token
    each; none is put before or after a text. Null and empty texts have no bytes and no tokens;
    bytes that are no UTF-8 count as the replacement character. Null ids and repeated rows are
    passed through, an empty table gives no rows, other columns are not read.
    """
    settle(docs.sparkSession)
    rules = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(rules.value)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            columns = [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(count(texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)

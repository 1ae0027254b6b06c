"""Token counts of a piece vocabulary (operator 12) by rank-synchronous merging of ragged arrays.

The vocabulary is a BPE of scored pieces with byte fallback, read from a model file (a parameter). A text becomes
pre-tokens between which no piece can reach; the new ones of a batch lie behind one another in one flat array of symbols.
In each round every sequence finds its pair of lowest rank and joins all places of it at once, whatever the other
sequences do; what is left when no pair has a rank is counted. Symbols outside the vocabulary count their UTF-8 bytes.

Joining all places at once gives what one join after the other gives if no pair that a join makes ranks before or beside
the joined piece. Pieces of which that cannot be said (``calm``) are joined at their leftmost place, one a round.

Defined results: a null text is read as empty and has no tokens; very long texts are read whole, and a pre-token of any
length is a sequence like others; repeated rows give repeated results; a null doc_id stays null. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import re
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.bpe import vocab_path
from opsloom.llm.common import small_batches, table

VOCAB = "piece_bpe_32k.model"
LIMIT = 4096
#: The sign that stands for a space in pieces.
MARK = "▁"
NEVER = np.int32(2**31 - 1)
#: A word with the space before it, line ends, or the spaces before that one.
PRE_TOKENS = re.compile(r" ?[^ \n]+|\n+| +(?= [^ \n])| +")
RUNS = (" ", "  ")  # how a pre-token of spaces alone begins
#: A place that no piece reaches over, whatever stands around it.
BETWEEN = re.compile(r"(?<=[^ \u2581])(?= [^ \n\u2581])|(?<=\n)")
#: Characters of pre-tokens whose counts a Python worker keeps; emptied when full, so memory is bounded.
CACHE_CHARS = 6_000_000
#: Characters of text that are split and counted at once.
CHARS_AT_ONCE = 2_000_000


class PairTable:
    """(left piece, right piece) -> joined piece for whole arrays, by open addressing."""

    def __init__(self, pairs: dict[tuple[int, int], int], base: int):
        self.base, bits = base, max(8, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        if not pairs:
            return
        keys = np.array([a * base + b for a, b in pairs], np.int64)
        for k, at, v in zip(keys.tolist(), self.slot(keys).tolist(), pairs.values(), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.values[at] = k, v

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Joined pieces; -1 where the two make none."""
        keys = left.astype(np.int64) * self.base + right
        at = self.slot(keys)
        found = np.where(self.keys[at] == keys, self.values[at], -1)
        open_ = np.flatnonzero((self.keys[at] >= 0) & (self.keys[at] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            there, wanted = self.keys[at[open_]], keys[open_]
            hit = there == wanted
            found[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return found


class Pieces:
    """Pieces of a model file in order of their scores, and what is known of their joins."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "  Ａé  \tﬁ x "
        if model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("only models that keep texts as they are, with one space in front, can be counted")
        known = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        known.sort(key=lambda i: -model.get_score(i))
        names, scores = [model.id_to_piece(i) for i in known], [model.get_score(i) for i in known]
        self.ids = {p: k for k, p in enumerate(names)}
        self.unknown = len(names)  # the symbol of every character outside the vocabulary
        runs = [p for p in names if len(p) > 1 and set(p) == {MARK}]
        if any(c not in self.ids for p in names for c in p) or any(MARK in p[1:] for p in names if p not in runs) or any("\n" in p for p in names):
            raise ValueError("a piece reaches over a space or line end, or has a character that is no piece")
        last = {s for p, s in zip(names, scores, strict=True) if p in runs}
        if len(last) > 1 or any(s <= max(last) for p, s in zip(names, scores, strict=True) if last and len(p) > 1 and p not in runs):
            raise ValueError("runs of spaces must rank last")
        rank = np.cumsum([0, *(a != b for a, b in zip(scores, scores[1:], strict=False))]).astype(np.int32)
        self.rank = np.append(rank, NEVER)  # at -1: no piece
        self.calm = np.bincount(rank) == 1
        pairs: dict[tuple[int, int], int] = {}
        for q, k in self.ids.items():
            for cut in range(1, len(q)):
                a, b = self.ids.get(q[:cut]), self.ids.get(q[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = k
                    for part in (a, b):
                        if rank[k] <= rank[part]:
                            self.calm[rank[part]] = False
        self.pair = PairTable(pairs, self.unknown + 1)
        self.pieces_of = np.full(sys.maxunicode + 1, self.unknown, np.int32)  # by code point
        single = [p for p in names if len(p) == 1]
        self.pieces_of[[ord(p) for p in single]] = [self.ids[p] for p in single]
        self.pieces_of[ord(" ")] = self.ids[MARK]
        self.near = PairTable({(self.ids[p[i]], self.ids[p[i + 1]]): 1 for p in names for i in range(len(p) - 1)}, self.unknown + 1)
        self.counts: dict[str, int] = {}
        self.lone: set[str] = set()  # kept pre-tokens whose leading space stays a symbol of its own
        self.kept = 0
        longest = max(map(len, [MARK, *runs]))
        owner = np.repeat(np.arange(4 * longest + 1), np.arange(4 * longest + 1))
        alone, _ = self.survivors(np.full(len(owner), self.ids[MARK], np.int32), owner, 4 * longest + 1)
        self.runs = alone[:longest].tolist()
        if any(n // longest + self.runs[n % longest] != k for n, k in enumerate(alone.tolist())):
            raise ValueError("runs of spaces must grow from the left up to the longest piece of spaces")

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.rank[self.pair(left, right)]

    def survivors(self, sym: np.ndarray, owner: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of each of many sequences, and the first of them (-1: empty). owner: of each symbol, ascending."""
        left, first = np.zeros(many, np.int64), np.full(many, -1, np.int32)
        while len(sym):
            # a compact state: the symbols that live, of the sequences that still have a pair
            n = len(sym)
            end = np.append(owner[1:] != owner[:-1], True)
            starts = np.flatnonzero(np.append(True, end[:-1]))
            after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
            after[end], before[starts] = -1, -1
            low = np.full(n, NEVER, np.int32)
            at = np.flatnonzero(~end)
            low[at] = self.joined(sym[at], sym[at + 1])
            alive, group, gone, live = np.ones(n, bool), np.cumsum(np.append(0, end[:-1])), 0, n
            while True:
                least = np.minimum.reduceat(low, starts)
                hit = np.flatnonzero((low == least[group]) & (low < NEVER))
                busy = least < NEVER
                if not len(hit) or gone * 2 > live or np.count_nonzero(busy) * 2 < len(starts):
                    break
                hit = self.chosen(hit, after, group, low)
                nxt = after[hit]
                sym[hit] = self.pair(sym[hit], sym[nxt])
                alive[nxt], low[nxt], far = False, NEVER, after[nxt]
                after[hit] = far
                inner = far >= 0
                before[far[inner]] = hit[inner]
                gone += len(hit)
                low[hit[~inner]] = NEVER
                low[hit[inner]] = self.joined(sym[hit[inner]], sym[far[inner]])
                prior = before[hit]
                prior, here = prior[prior >= 0], hit[prior >= 0]
                low[prior] = self.joined(sym[prior], sym[here])
            done = ~busy[group]
            left += np.bincount(owner[done & alive], minlength=many)
            closed = starts[~busy]
            first[owner[closed]] = sym[closed]
            stay = alive & ~done
            sym, owner = sym[stay], owner[stay]
        return left, first

    def chosen(self, hit: np.ndarray, after: np.ndarray, group: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Of the places of the lowest pairs: every other one of a row of overlapping places, the leftmost alone unless calm."""
        linked = np.append(False, after[hit[:-1]] == hit[1:])
        number = np.arange(len(hit))
        run = number - np.maximum.accumulate(np.where(linked, 0, number))
        leftmost = np.append(True, group[hit[1:]] != group[hit[:-1]])
        return hit[leftmost | ((run % 2 == 0) & self.calm[low[hit]])]

    def of_spaces(self, n: int) -> int:
        """Tokens of n spaces that no word takes: pieces of spaces rank last and grow from the left up to the longest."""
        return n // len(self.runs) + self.runs[n % len(self.runs)]

    def learn(self, tokens: list[str]) -> None:
        """Keep the counts of pre-tokens."""
        self.counts.update((t, self.of_spaces(len(t))) for t in tokens if t[:2] in RUNS)
        self.kept += sum(map(len, tokens))
        words = [t for t in tokens if t[:2] not in RUNS]
        if not words:
            return
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        starts, sym = np.cumsum(sizes) - sizes, self.pieces_of[points]
        fresh = np.append(True, self.near(sym[:-1], sym[1:]) < 0)  # nothing reaches over two characters that no piece has side by side
        fresh[starts] = True
        part = np.cumsum(fresh) - 1
        left, first = self.survivors(sym, part, int(part[-1]) + 1)
        of_part = np.repeat(np.arange(len(words)), sizes)[fresh]
        unknown = np.flatnonzero(sym == self.unknown)  # a part of their own; counted by bytes
        more = np.searchsorted([0x80, 0x800, 0x10000], points[unknown], side="right")
        counts = np.bincount(of_part, weights=left) + np.bincount(of_part[part[unknown]], weights=more, minlength=len(words))
        self.counts.update(zip(words, counts.astype(np.int64).tolist(), strict=True))
        own = np.flatnonzero((sym[starts] == self.ids[MARK]) & (first[part[starts]] == self.ids[MARK]))
        self.lone.update(words[k] for k in own.tolist())

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each of some texts, which carry the leading space already."""
        rows = [PRE_TOKENS.findall(t.replace(MARK, " ")) for t in texts]
        if self.kept > CACHE_CHARS:
            self.clear()
        self.learn(list(set().union(*rows).difference(self.counts)))
        counts, lone, out = self.counts, self.lone, []
        for text, row in zip(texts, rows, strict=True):
            n = sum(map(counts.__getitem__, row))
            for t, word in zip(row, row[1:], strict=False) if "  " in text or MARK in text else ():
                if t[:2] in RUNS and word in lone:  # the space before the word joins the run
                    n += self.of_spaces(len(t) + 1) - self.of_spaces(len(t)) - 1
            out.append(n)
        return out

    def count_whole(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; null is empty. About ``CHARS_AT_ONCE`` characters are split at a time, long texts in parts."""
        total, some, whose, n = [0] * len(texts), [], [], 0

        def close():
            for k, found in zip(whose, self.count(some), strict=True):
                total[k] += found
            some.clear()
            whose.clear()

        for k, text in enumerate(texts):
            for part in parts(" " + text) if text else ():
                some.append(part)
                whose.append(k)
                n += len(part)
                if n >= CHARS_AT_ONCE:
                    close()
                    n = 0
        close()
        return total

    def clear(self) -> None:
        self.counts.clear()
        self.lone.clear()
        self.kept = 0


@lru_cache(maxsize=2)
def loaded(path: str) -> Pieces:
    return Pieces(path)


def parts(text: str):
    """A text in parts of about ``CHARS_AT_ONCE`` characters whose tokens are those of the whole."""
    start = 0
    while len(text) - start > CHARS_AT_ONCE and (cut := BETWEEN.search(text, start + CHARS_AT_ONCE)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every document."""
    name = path

    def run(batches):
        pieces = loaded(name or vocab_path(VOCAB))
        for b in batches:
            texts = b.column(1).to_pylist()
            sizes = [len((t or "").encode("utf-8")) for t in texts]
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(pieces.count_whole(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
        pieces.clear()  # Python workers live on; the next stage needs the memory

    kept = small_batches(docs).select("doc_id", "text")
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of all documents."""
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)

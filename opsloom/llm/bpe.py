"""BPE encoding and decoding (operator 8).

Words are encoded by a priority queue of merge ranks over a doubly linked symbol list; entries whose symbols have
changed since they were queued are stale and skipped. Decoding concatenates vocabulary strings. The vocabulary file
is a parameter, loaded once per Python worker. Text passes through Spark in Arrow batches; nothing is shuffled.

Defined results: a null text is read as empty and gives no tokens and an empty decoded string; very long texts are
encoded whole; repeated rows give repeated results. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from opsloom.llm.common import small_batches, table

VOCAB = "word_bpe_49k.json"
#: Words kept encoded by a Python worker; the table is emptied when full, so memory is bounded.
CACHE_WORDS = 150_000
#: Documents encoded before a batch goes back to Spark.
ROWS_BACK = 500


def vocab_path(name: str = VOCAB) -> str:
    """Place of a public tokenizer file of that name."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stays, the others follow from U+0100 on."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def _classes(upto: int) -> tuple[str, str, str]:
    """Escaped character classes of letters, numbers and white space below a code point."""
    kinds = {"L": [], "N": [], "S": []}
    for c in map(chr, range(upto)):
        if regex.match(r"[\t-\r \x85\p{Z}]", c):
            kinds["S"].append(c)
        elif unicodedata.category(c)[0] in "LN":
            kinds[unicodedata.category(c)[0]].append(c)
    return tuple("".join(map(re.escape, kinds[k])) for k in "LNS")


class Words(dict):
    """word -> (little-endian ids, decoded string), filled on demand."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        self[word] = out = self.encode(word)
        return out


class Bpe:
    """A word-level BPE with an end-of-word suffix, read from a tokenizer file."""

    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"
    NARROW = 0x250

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.specials).items()}
        self.suffix = model["end_of_word_suffix"] or ""
        #: for each left id: right id -> merge rank; rank -> joined id
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(self.vocab.values()) + 1)]
        self.joined: list[int] = []
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.ranks[self.vocab[a]][self.vocab[b]] = rank
            self.joined.append(self.vocab[a + b])
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + self.suffix] for s in symbols]
        letters, numbers, spaces = _classes(self.NARROW)
        self.narrow = re.compile(self.PIECES.format(L=letters, N=numbers, S=spaces))
        self.wide = regex.compile(self.PIECES.format(L=r"\p{L}", N=r"\p{N}", S=r"\t-\r \x85\p{Z}"))
        self.not_narrow = re.compile(f"[^\\x00-\\u{self.NARROW - 1:04x}]")
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.words = Words(self._packed, cache_words)

    def merge(self, word: str) -> list[int]:
        """Ids of one word: lowest rank first, leftmost among equals."""
        raw = word.encode("utf-8")
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        n, ranks = len(ids), self.ranks
        # a queue entry is the rank and, in its low bits, the position: equal ranks come out leftmost first
        bits = max(12, n.bit_length())
        queue = [r << bits | i for i in range(n - 1) if (r := ranks[ids[i]].get(ids[i + 1])) is not None]
        if not queue:
            return ids
        heapq.heapify(queue)
        pop, push, joined, mask = heapq.heappop, heapq.heappush, self.joined, (1 << bits) - 1
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        while queue:
            entry = pop(queue)
            rank, i = entry >> bits, entry & mask
            a, j = ids[i], after[i]
            if a < 0 or j < 0 or ranks[a].get(ids[j]) != rank:
                continue  # stale: one of the two symbols has been merged away
            ids[i], ids[j] = new, _ = joined[rank], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks[new].get(ids[k])) is not None:
                    push(queue, r << bits | i)
            if (h := before[i]) >= 0 and (r := ranks[ids[h]].get(new)) is not None:
                push(queue, r << bits | h)
        return [x for x in ids if x >= 0]

    def _packed(self, word: str) -> tuple[bytes, str]:
        ids = self.merge(word)
        return struct.pack(f"<{len(ids)}I", *ids), " ".join(map(self.strings.__getitem__, ids))

    def pieces(self, text: str) -> list[str]:
        """Words of one text without special tokens: canonical composition, lower case, white space dropped."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case without word-end context
        text = text.lower()
        return (self.wide if self.not_narrow.search(text) else self.narrow).findall(text)

    def encode_packed(self, text: str) -> tuple[bytes, str]:
        """(ids as little-endian unsigned 32-bit integers, decoded text)."""
        parts = self.special.split(text) if self.special and "<|" in text else [text]
        found = []
        for part in parts:
            if part in self.specials:
                found.append((struct.pack("<I", self.specials[part]), part))
            elif part:
                found.extend(map(self.words.__getitem__, self.pieces(part)))
        return b"".join([x[0] for x in found]), " ".join([x[1] for x in found])

    def encode(self, text: str) -> list[int]:
        raw = self.encode_packed(text)[0]
        return list(struct.unpack(f"<{len(raw) // 4}I", raw))

    def decode(self, ids) -> str:
        """Vocabulary strings joined by a space, special tokens kept (the file names no decoder)."""
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=4)
def loaded(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and decoded text of every document."""
    name = path

    def run(batches):
        bpe = loaded(name or vocab_path())
        for b in (b.slice(k, ROWS_BACK) for b in batches for k in range(0, b.num_rows, ROWS_BACK)):
            found = [bpe.encode_packed(t.as_py() or "") for t in b.column(1)]
            ends = np.cumsum([0] + [len(raw) // 4 for raw, _ in found])
            flat = pa.array(np.frombuffer(b"".join([raw for raw, _ in found]), np.int32))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.record_batch([b.column(0), pa.array(np.diff(ends), pa.int64()), ids, pa.array([x for _, x in found], pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])
        bpe.words.clear()  # Python workers live on; the next stage needs the memory

    kept = small_batches(docs).select("doc_id", "text")
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digest of ``encode`` without moving ids between processes."""
    name = path

    def run(batches):
        bpe = loaded(name or vocab_path())
        for b in batches:
            n, ids, texts = [], [], []
            for t in b.column(1):
                raw, text = bpe.encode_packed(t.as_py() or "")
                n.append(len(raw) // 4)
                ids.append(hashlib.sha256(raw).hexdigest())
                texts.append(hashlib.sha256(text.encode("utf-8")).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.words.clear()

    kept = small_batches(docs).select("doc_id", "text")
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the encoded corpus."""
    return encode(docs)


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of all documents."""
    return digests(table(spark, sf_dir, "documents"))

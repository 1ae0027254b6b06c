"""Spelling variants, token counts of a piece vocabulary and the prefix trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from opsloom.llm import pieces, trie, variants
from opsloom.llm.bpe import vocab_path
from opsloom.llm.oracles import OP11, OP13
from opsloom.llm.registry import ORACLES, QUERIES

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def in_duckdb(sql, **tables):
    """Rows of the SQL over (columns, rows) tables, by the order of the wanted columns."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for name, (columns, rows) in tables.items():
        con.register(f"{name}_rows", pd.DataFrame(rows, columns=[c.split()[0] for c in columns]).astype(object))
        con.execute(f"create view {name} as select {', '.join(f'cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}' for c in columns)} from {name}_rows")
    return con.sql(sql)


# spelling variants


def plain_variants(rows):
    counts = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    near = {w: [x for x in n if x != w and one_edit(w, x)] for w in n}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    stock = ["house", "houses", "mouse", "mousse", "river", "rivers", "drive", "étude", "études", "straße", "abcabc", "abcab", "aabbcc", "banana", "bananas", "banane", "listen", "silent", "Ärger", "ärger", "nano×", "abcde", "edcba"]
    weight = [rnd.choice([1, 3, 9, 40]) for _ in stock]
    rows = [(1, None), (2, ""), (3, "1234 _ \t\n"), (None, "house river house river house"), (5, "Four tiny word s"), (6, "x" * 300 + " " + "House-RIVER_étude9straße")]
    rows += [(7, "listen silent " * 4), (7, "listen silent " * 4), (8, " ".join(f"w{c}rd{d}s" for c in "aeiou" for d in "xyz") * 3)]
    for i in range(20, 160):
        rows.append((i, rnd.choice([" ", "\n", "--", ", "]).join(rnd.choices(stock, weight, k=rnd.randint(0, 80)))))
    for w in stock:  # misspelled in many ways, some of them often
        for _ in range(6):
            at = rnd.randrange(len(w))
            rows.append((1000 + len(rows), (w[:at] + rnd.choice(["", "e", "é", w[at] * 2]) + w[at + 1 :] + " ") * rnd.randint(3, 9)))
    return rows


def test_variants_against_brute_force(spark, texts, tmp_path):
    columns = ["doc_id bigint", "text varchar"]
    spark.createDataFrame([(*r, "x", 1) for r in texts], "doc_id long, text string, word string, n int").write.parquet(f"{tmp_path}/documents.parquet")
    want = plain_variants(texts)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in QUERIES["op11_spelling_variants"](spark, str(tmp_path)).collect()}
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[0] != v[1] for v in want.values() if v[0])
    assert {r[0]: r[1:] for r in in_duckdb(f"select word, form, root, n, n_near, form_n from ({ORACLES['op11_spelling_variants']})", documents=(columns, texts)).fetchall()} == want
    assert OP11 == ORACLES["op11_spelling_variants"]


def test_variants_of_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group_variants(none).collect() == []
    assert variants.group_variants(spark.createDataFrame([(1, "lonely words occur once")], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("m", [5, 7, 12])
def test_signatures_lose_no_pair(spark, m):
    """Every two words one edit apart meet, and meet once, whatever the number of parts."""
    rnd = random.Random(m)
    words = {"".join(rnd.choices("abcdé", k=rnd.randint(5, 9))) for _ in range(400)}
    df = spark.createDataFrame([(w, 1 + k) for k, w in enumerate(sorted(words))], "word string, n long")
    pairs = variants.candidates(variants.vectors(df), m).collect()
    assert len({(r.bag, r.bag_) for r in pairs}) == len(pairs)
    met = {(r.bag, r.bag_) for r in pairs}
    want = {tuple(sorted(("".join(sorted(a)), "".join(sorted(b))))) for a in words for b in words if a != b and one_edit(a, b)}
    assert want and want <= met
    n = {w: 1 + k for k, w in enumerate(sorted(words))}
    got = {r.word: (r.n_near, r.best) for r in variants.near_words(df).collect()}
    near = {w: [x for x in words if x != w and one_edit(w, x)] for w in words}
    assert got == {w: (len(x), max(x, key=n.get)) for w, x in near.items() if x}


def test_vocabulary_is_never_broadcast(spark):
    """However small Spark takes a side for: a row of the file is one for each choice of parts in the join."""
    words = spark.createDataFrame([("house", 3), ("houses", 4), ("mouse", 9)], "word string, n long")
    docs = spark.createDataFrame([(k, "house houses mouse " * 3) for k in range(1, 9)], "doc_id long, text string")
    for df in (variants.candidates(variants.written(variants.vectors(words)), 12), variants.group_variants(docs)):
        assert "SortMergeJoin" in (plan := df._jdf.queryExecution().executedPlan().toString()) and "Broadcast" not in plan


def test_letters_that_differ():
    assert variants.dimensions("aabé") == ["a", "a1", "b", "é"]
    assert variants.one_more("abc", "abd") == ("c", "d") and variants.one_more("abc", "abcc") == ("", "c") and variants.one_more("aab", "bcc") is None
    assert variants.edited("banana", "a", "") == {"bnana", "banna", "banan"} and variants.edited("abc", "b", "x") == {"axc"}


def test_long_runs_are_split_alike(monkeypatch):
    text = "Some WORDS, and étude " * 50
    whole = Counter(w for some in variants.runs_of(text) for w in some)
    monkeypatch.setattr(variants, "CHARS_AT_ONCE", 40)
    assert Counter(w for some in variants.runs_of(text) for w in some) == whole and "étude" in whole


def test_roots_of_a_long_chain(spark):
    rows = [(f"w{k}", f"w{k + 1}") for k in range(37)] + [("x", "w30"), ("y", "x")]
    assert {r.root for r in variants.roots(spark.createDataFrame(rows, "word string, form string")).collect()} == {"w37"}


# token counts


@pytest.fixture(scope="module")
def odd_texts():
    rnd = random.Random(1)
    letters = "the and▁  \n\t一二三中国日本aaéÉ０１2345ththethethe∑😀\x00 "
    out = ["", " ", "<s></s><0x0A><unk>", "the" * 500, "ab" * 700, "中国" * 99, "\n\n a\n  b", "▁▁ x ▁", *("a" * n for n in range(60))]
    out += [" " * n + w for n in range(70) for w in ("", "a", "the", "中", "∑", "é\n")]
    return out + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(4000)]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocab_path(pieces.VOCAB))


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(vocab_path(pieces.VOCAB))


def test_token_counts_equal_the_library(model, library, odd_texts):
    assert model.count_whole(odd_texts) == [len(x) for x in library.encode(odd_texts, num_threads=1)]


def test_token_counts_in_parts(model, library, odd_texts, monkeypatch):
    monkeypatch.setattr(pieces, "CHARS_AT_ONCE", 50)
    monkeypatch.setattr(pieces, "CACHE_CHARS", 300)
    some = ["".join(odd_texts[k : k + 9]) for k in range(0, 900, 9)] + [" " * 1000 + "x " * 300 + "中" * 300]
    assert model.count_whole(some) == [len(x) for x in library.encode(some, num_threads=1)]


def test_rounds_are_what_one_join_after_the_other_gives(model):
    """Symbols left by joining the leftmost pair of lowest rank, again and again."""
    rnd = random.Random(2)
    names = {k: p for p, k in model.ids.items()}
    for _ in range(300):
        sym = [model.ids[c] for c in ("".join(rnd.choice("thean▁") for _ in range(rnd.randint(1, 30))))]
        left, first = model.survivors(np.array(sym, np.int32), np.zeros(len(sym), np.int64), 1)
        while True:
            ranks = [model.rank[model.ids.get(names[a] + names[b], -1)] for a, b in zip(sym, sym[1:], strict=False)]
            if not ranks or min(ranks) == pieces.NEVER:
                break
            i = ranks.index(min(ranks))
            sym[i : i + 2] = [model.ids[names[sym[i]] + names[sym[i + 1]]]]
        assert (left[0], first[0]) == (len(sym), sym[0])


def test_op12(spark, library, tmp_path):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "no id"), (5, "same"), (5, "same"), (6, "word " * 5000), (7, "x" * 30000), (8, "中" * 4097)]
    spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, n_tokens int, n_bytes string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_token_counts"](spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "bigint", "boolean"]
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert pieces.token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# prefix trie


def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns[c].append((t is not None, t or 0, r, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), x))
    convs = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in turns.items()}
    nodes, kids, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].append((c, len(path) == d))
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    low = {p: min(c for c, _ in m) for p, m in nodes.items()}
    return sorted((low[p], len(p), low[p[:-1]] if p else -1, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(c for c, e in m if e))).encode()).hexdigest()) for p, m in nodes.items())


def found(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def turns():
    rnd = random.Random(8)
    rows = [(None, 1, "user", "nobody's"), (3, 0, "user", "a"), (0, None, "user", "first"), (0, 0, None, None), (0, 0, "user", "tie b"), (0, 0, "user", "tie a"), (0, 0, "user", "tie a"), (0, 5, "assistant", "é" * 500)]
    stock = [("system", "be kind"), ("user", "hello"), ("assistant", "hello"), ("user", ""), (None, None), ("user", "héllo")]
    for c in range(7, 260):
        if c % 11:  # some bases are absent
            rows += [(c, t, *rnd.choice(stock)) for t in range(rnd.randint(1, 6))]
    for c in range(1000, 1400):  # a hot conversation of more than 8 turns, so that copies stay copies
        rows += [(c, t, "user", f"turn {t}") for t in range(12)]
    rows += [(2000, t, "user", "long") for t in range(300)] + [(2001, t, "user", "long") for t in range(301)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("shards", [1, 2, 7, 40, None])
def test_trie_against_brute_force(spark, turns, shards):
    df = spark.createDataFrame([(*r, "x", 2) for r in turns], "conv_id long, turn long, role string, text string, path string, node int")
    assert found(trie.prefix_trie(trie.rebuilt(df), shards)) == plain_trie(turns)


def test_trie_in_small_chunks(spark, turns, monkeypatch):
    """Ids of a hot node cross shards in many chunks, and splitters are cut short."""
    monkeypatch.setattr(trie, "SKELETON_TURNS", 3)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    cuts = trie.splitters(trie.rebuilt(df), 30)
    assert len(cuts) > 5 and max(len(p) for p, _ in cuts) <= 3 * trie.STEP and len(trie.skeleton_of(cuts)) <= 30 * 3 + 1
    assert found(trie.prefix_trie(trie.rebuilt(df), 30)) == plain_trie(turns)


def test_trie_scan_hands_on_chunks_and_rows(turns, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 8)
    monkeypatch.setattr(trie, "BATCH", 3)
    step = trie.STEP
    paths = sorted([(bytes([c]) * step * d, i) for i, (c, d) in enumerate([(1, 1), (1, 1), (1, 2), (2, 1), (2, 3), (2, 3), (3, 0), (4, 2)])])
    scan, out = trie.Scan({b"": 0, bytes([1]) * step: 1}, 5), []
    for p, i in paths:
        scan.see(i, p, [4] * (len(p) // step))
        if scan.full():
            out += [r for b in scan.batches() for r in b.to_pylist()]
    while scan.stack:
        scan.close()
    out += [r for b in scan.batches() for r in b.to_pylist()]
    ends = [(r["node"], r["ids"]) for r in out if r["ids"] is not None]
    assert b",".join(x for n, x in ends if n == 1) == b"0,1" and (0, b"6") in ends
    local = {(r["conv_id"], r["depth"]): (r["parent"], r["parent_conv_id"], r["n_convs"], r["n_leaves"], r["saved_tokens"]) for r in out if r["node"] is None}
    assert local[3, 1] == (0, None, 3, 1, 2 * 4 + 4 + 4) and local[4, 2] == (None, 3, 2, 1, 8) and local[2, 2] == (1, None, 1, 1, 0)
    assert {r["node"]: (r["n_convs"], r["n_children"]) for r in out if r["node"] is not None and r["ids"] is None} == {0: (8, 2), 1: (3, 1)}


def test_op13_and_its_sql(spark, turns, tmp_path):
    columns = ["conv_id bigint", "turn bigint", "role varchar", "text varchar"]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op13_prefix_trie"](spark, str(tmp_path))
    assert got.columns == trie.COLUMNS and {t for c, t in got.dtypes if c != "ends_sha256"} == {"bigint"}
    want = plain_trie(turns)
    assert found(got) == want
    rows = in_duckdb(f"select {', '.join(trie.COLUMNS)} from ({OP13})", conversations=(columns, turns)).fetchall()
    assert sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in rows) == want


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(trie.rebuilt(none)).collect() == []
    # a conversation whose only turns are replaced by those of an absent base is a member of the root alone
    lone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    one = spark.createDataFrame([(lone, 0, "user", "x"), (lone, 1, "user", "y")], "conv_id long, turn long, role string, text string")
    assert found(trie.prefix_trie(trie.rebuilt(one))) == [(lone, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]

import base64
import collections
import hashlib
import json
import math
import random
import re
import subprocess
import sys
import unicodedata
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from spanloom.llm import brown_lm, byte_bpe, common, decontaminate, line_dedup, merkle, ngram_join, pii, quality, repair_ids, toxicity

RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = ["rid", "cls", "n", "gram", "h1", "words", "score", "predicted", "text_sha256", "range", "tail", "n_tokens", "first"]


def say(seed, n=40):
    r = random.Random(seed)
    return " ".join(r.choice("the and of walk tree stone river cloud bread night slow green under paper seven".split()) + str(r.randint(0, 99)) for _ in range(n))


BASE = say(1, 60)
ROWS = [
    (1, BASE), (2, BASE), (3, BASE.replace(" ", "  ").upper()), (4, " ".join(BASE.split()[:-2] + ["x", "y"])), (5, None), (6, ""), (7, "   \n\t "),
    (8, "one two"), (9, "one two"), (10, say(2, 200) + "\n" + say(3, 30)), (11, say(4, 30) + "\n" + say(3, 30) + "\nshort"), (12, say(3, 29) + " other\n" + say(5)),
    (13, " ".join(say(6, 20000).split())), (14, "naïve café — 日本語 🎉 " + say(7)), (15, say(8)), (15, say(8)), (16, "A,B;C " + say(9)), (17, say(11, 200).replace(" ", ", ")), (None, BASE), (None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 8 else "en", None if i == 9 else f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in ROWS]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(text):
    return (text or "").encode().lower().split()


def bag(rows):
    return collections.Counter(rows)


def sets(text):
    w = tokens(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    known = [(i, sets(t)) for i, t in rows if i is not None]
    for a, x in known:
        for b, y in known:
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_ngram_join(docs, nothing):
    got = bag((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect())
    comp = brute_components(ROWS)
    assert got == bag((i, len(sets(t)), comp[i] if i is not None else None) for i, t in ROWS)
    assert comp[4] == 1
    assert ngram_join.near_duplicates(nothing).collect() == []
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and bag(r.doc_id for r in kept.collect()) == bag(i for i, _ in ROWS if i is None or comp[i] == i)


def test_ngram_join_on_random_groups(spark):
    r, rows = random.Random(3), []
    for g in range(12):
        words = say(100 + g, r.randint(3, 120)).split()
        for _ in range(r.randint(1, 14)):
            copy = list(words)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = f"z{r.randint(0, 9)}"
            rows.append((len(rows), " ".join(copy)))
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_components(rows)


def test_ngram_join_on_a_passage_of_unlike_documents(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    own = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i, f"{own(i, 30)} {passage} {own(i + 10_000, 10 + i % 80)}") for i in range(2_000)]
    words = [f"c{k}" for k in range(120)]
    copies = [(5_000 + i, " ".join(w if k != i % 120 else f"z{i}" for k, w in enumerate(words))) for i in range(150)]  # a large bucket, all linked
    pairs = [(6_000 + i, f"{own(20_000 + i // 2, 60)} tail{i}") for i in range(40)]
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows + copies + pairs, "doc_id bigint, text string")).collect()}
    assert got == {**{i: i for i, _ in rows}, **{i: 5_000 for i, _ in copies}, **{i: i - i % 2 for i, _ in pairs}}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 101)]
    got = {r.node: r.comp for r in common.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102)}}


def brute_lines(rows):
    """What line dedup keeps: a line goes if an earlier one is within one word."""

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = (a, b) if len(a) < len(b) else (b, a)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    lines = sorted({(i, k, tuple(tokens(s))) for i, t in rows if i is not None and t is not None for k, s in enumerate(t.split("\n"))})
    lines = [x for x in lines if len(x[2]) >= line_dedup.SHORTEST]
    gone = {(i, k) for n, (i, k, w) in enumerate(lines) if any(near(w, v) for *at, v in lines[:n] if tuple(at) != (i, k))}
    return [(i, "\n".join(s for k, s in enumerate(t.split("\n")) if (i, k) not in gone) if t is not None else None) for i, t in rows]


def test_line_dedup(docs, nothing):
    done = line_dedup.drop_lines(docs)
    assert bag((r.doc_id, r.text) for r in done.collect()) == bag(brute_lines(ROWS))
    assert done.columns == [*docs.columns, "lines_removed"]
    assert line_dedup.drop_lines(nothing).collect() == []


def test_line_dedup_on_random_edits(spark):
    r, rows = random.Random(4), []
    seeds = [say(50 + k, r.randint(4, 12)).split() for k in range(8)]
    for i in range(40):
        lines = []
        for _ in range(r.randint(1, 4)):
            w = list(r.choice(seeds))
            for _ in range(r.choice([0, 1, 1, 2])):
                at, how = r.randrange(len(w)), r.randint(0, 2)
                if how == 0:
                    w[at] = f"q{r.randint(0, 3)}"
                elif how == 1:
                    w.insert(at, f"q{r.randint(0, 3)}")
                elif len(w) > 1:
                    del w[at]
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    got = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert bag((x.doc_id, x.text) for x in got) == bag(brute_lines(rows))


def test_line_dedup_of_short_equal_lines(spark, tmp_path):
    from spanloom.llm import queries

    rows = [(1, "All rights reserved.\nhome\n\nfive words stand in here"), (2, "all  rights reserved.\nall rights reserved\n\nhome"), (3, "HOME\nfive words stand out here\nhome page")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {1: rows[0][1], 2: "all rights reserved\n", 3: "home page"}
    got = {r.doc_id: r.text_sha256 for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}


def brute_tree(text):
    """Sections of paragraphs of leaves, with whole hashes, by plain loops."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    word = lambda c: unicodedata.category(c)[0] in "LN"
    paragraphs, at = [], 0
    for k in range(1, len(text)):
        if text[k - 1] == "\n" and text[k] != "\n":
            paragraphs.append(text[at:k])
            at = k
    paragraphs.append(text[at:])
    sections, held = [], []
    for p in paragraphs:
        leaves, at = [], 0
        for k in range(2, len(p)):
            mark = not word(p[k - 2]) and not p[k - 2] in " \t\n\r\x0b\x0c"
            if p[k - 1] == " " and p[k] not in " \t\n\r\x0b\x0c" and (mark or (k >= 9 and all(map(word, p[k - 9 : k - 1])))):
                leaves.append(sha(p[at:k]))
                at = k
        leaves.append(sha(p[at:]))
        held.append((sha("".join(leaves)), leaves))
        if int(held[-1][0][-1], 16) % merkle.GROUP == 0:
            sections.append(held)
            held = []
    if held:
        sections.append(held)
    return [(sha("".join(n for n, _ in s)), s) for s in sections], sha("".join(sha("".join(n for n, _ in s)) for s in sections) + f":{len(text)}")


def brute_print(text):
    tree, root = brute_tree(text)
    leaves = "/".join(".".join(",".join(x[:8] for x in own) for _, own in s) for _, s in tree)
    return f"{root}:{leaves}:" + "/".join(".".join([n[:16], *(p[:16] for p, _ in s)]) for n, s in tree)


def brute_likeness(a, b):
    x, y = ({leaf[:8] for _, s in brute_tree(t)[0] for _, leaves in s for leaf in leaves} for t in (a, b))
    return len(x & y) / len(x | y)


def test_merkle(docs, nothing):
    got = merkle.compared(docs).collect()
    h = dict(docs.selectExpr("coalesce(text, '') t", "xxhash64(coalesce(text, '')) h").distinct().collect())
    order = sorted(((i, t or "") for i, t in ROWS), key=lambda x: (x[0] is not None, x[0] or 0, h[x[1]], x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after, cut = order[(k + 1) % len(order)][1], len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), brute_print(t), brute_print(edited), brute_likeness(t, edited), brute_likeness(t, after)))
    assert bag(tuple(r)[:7] for r in got) == bag(want)
    assert all((r.paragraph is None) == (r.fingerprint == r.edited_fingerprint) for r in got)
    assert len({r.fingerprint for r in merkle.fingerprints(docs).collect()}) == len({t or "" for _, t in ROWS})
    long = next(r for r in got if r.doc_id == 17)
    assert long.near_edited > long.near_next
    assert merkle.compared(nothing).collect() == []


def test_merkle_deals_a_common_id_into_several_ranges(spark):
    rows = [(None if i % 3 else 7, f"text {i}") for i in range(400)] + [(i, f"more {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    h = dict(df.selectExpr("text", "xxhash64(text)").collect())
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, h[x[1]], x[1]))
    got = merkle.with_next(df).collect()
    assert bag(tuple(r) for r in got) == bag((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    edges = merkle._edges([3, 7, 7, 7, 9], 4, 16)
    assert [i for i, _ in edges] == [merkle._NONE] * 4 + [3, 7, 7, 7, 9] and edges[0][1] == edges[4][1] == -(1 << 63)


def test_merkle_locates_edits(spark):
    from pyspark.sql import functions as F

    lines = [f"line {i}, {say(i, 12)}. And more; here it ends.\n" for i in range(40)]
    a = "".join(lines)
    changed = lambda k, new: "".join(new if i == k else x for i, x in enumerate(lines))
    cases = [(a, a), (a, changed(7, lines[7].replace("more", "less"))), (a, changed(20, "")), (a, changed(39, "an end")), (a, ""), ("", "x"), (a, "new line, here.\n" + a)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, a string, b string")
    got = [r.d for r in df.select("k", merkle.differing(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("d")).orderBy("k").collect()]
    for (x, y), d in zip(cases, got, strict=True):
        flat = [[leaf for _, s in brute_tree(t)[0] for _, leaves in s for leaf in leaves] for t in (x, y)]
        if x == y:
            assert d is None
            continue
        assert flat[0][: d.leaf - 1] == flat[1][: d.leaf - 1] and flat[0][d.last_leaf_a :] == flat[1][d.last_leaf_b :]
        assert 1 <= d.leaf and d.last_leaf_a < len(flat[0]) + 1 and flat[0][d.leaf - 1 : d.last_leaf_a] != flat[1][d.leaf - 1 : d.last_leaf_b]
    assert got[1].paragraph == 8 and got[2].paragraph == 21 and got[3].paragraph == 40


def test_brown_lm(docs, nothing):
    got = brown_lm.score(docs).collect()
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    count = collections.Counter(w for i, t in ROWS if not held(i) for w in [*tokens(t), None])
    n, v = sum(count.values()), len(count)
    want = collections.defaultdict(list)
    for i, t in ROWS:
        w = [*tokens(t), None]
        want[i].append((held(i), len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)))
    for i, rows in want.items():
        mine = sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got if r.doc_id == i)
        assert len(mine) == len(rows)
        for a, b in zip(mine, sorted(rows), strict=True):
            assert a[:4] == b[:4] and a[4] == pytest.approx(b[4])
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert brown_lm.score(nothing).collect() == []


def test_brown_score_against_plain_loops(spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    rows = [(i, say(i % 13, 20 + i % 7) + (f" rare{i} unseen{i}" if i % 5 == 0 else "")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model, counts = brown_lm.train(docs.selectExpr("doc_id", "text", "crc32(cast(doc_id as string)) % 7 = 2 as held_out"))
    known = {bytes(r.word): (r.n, r.kind) for r in counts.collect()}
    end, n_end = int(model.of[brown_lm.END]), sum(not held(i) for i, _ in rows)
    kinds = lambda t: [*(known[w][1] if w in known else int(model.of[brown_lm.ending(w)]) for w in tokens(t)), end]
    grid, norm = np.zeros((brown_lm.CLASSES,) * 2), collections.Counter({end: n_end + 1})
    for i, t in rows:
        if not held(i):
            for a, b in zip([end, *kinds(t)], kinds(t), strict=False):
                grid[a, b] += 1
    for n, kind in known.values():
        norm[kind] += n + 1
    for kind in set(model.of[brown_lm.WORDS : brown_lm.END].tolist()):
        norm[kind] += 1
    total = sum(n for n, _ in known.values()) + n_end
    flat = 1 / (total + len(known) + 1 + 1)
    loo, want = [], {}
    for i, t in rows:
        logs = 0.0
        for a, b, w in zip([end, *kinds(t)], kinds(t), [*tokens(t), None], strict=False):
            c = n_end if w is None else known.get(w, (0, 0))[0]
            step = (grid[a, b] + 0.1) / (grid[a].sum() + 0.1 * brown_lm.CLASSES)
            logs += math.log10((c + 1) * (model.mix * step / max(norm[b], 1) + (1 - model.mix) * flat))
            if not held(i):
                loo.append((grid[a, b] - 1 + 0.1) / (grid[a].sum() - 1 + 0.1 * brown_lm.CLASSES) / max(norm[b] - 1, 1) / flat)
        want[i] = logs
    m = 0.5
    for _ in range(200):
        m = sum(m * x / (m * x + 1 - m) for x in loo) / len(loo)
    assert model.mix == pytest.approx(min(max(m, 0.01), 0.99), abs=0.01) and 0 < model.mix < 1
    for r in brown_lm.score(docs).collect():
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-6)


def test_brown_model_is_a_distribution(spark):
    docs = spark.createDataFrame([(i, say(i, 30)) for i in range(30)], "doc_id bigint, text string")
    m, counts = brown_lm.train(docs.selectExpr("doc_id", "text", "false as held_out"))
    words = {bytes(r.word): r.n for r in counts.collect()}
    base = m.read("")[3]
    total = (m.known[-1] and 10 ** (m.log_count[-1])) * 10**base
    for w in words:
        _, _, logs, context, _ = m.read(w.decode())
        total += 10 ** (logs - m.log_count[-1] + context - _end(m, w))
    assert 0.9 < total <= 1.0 + 1e-9


def _end(m, word):
    """log10 of what the end token's context gives after the word."""
    kind = m.of[m.item[m.place[word]]]
    return math.log10(m.mix * m.step[kind, m.of[brown_lm.END]] * m.emit[brown_lm.END] + (1 - m.mix) * m.flat)


def test_brown_rare_words_get_classes_by_their_transitions(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "KNOWN", brown_lm.WORDS + 2)  # most rare words meet their classes in a join
    r, rows = random.Random(7), []
    for i in range(600):  # frequent words of two sorts in turn, and rare ones of either sort, all spelt with the same end
        rows.append((i, " ".join(f"{'nv'[k % 2]}{i}rare" if k % 12 in (0, 5) else f"{'nv'[k % 2]}{r.randrange(500)}{'xy'[k % 2]}" for k in range(96))))
    m, counts = brown_lm.train(spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "false as held_out"))
    got = {bytes(x.word).decode(): (x.n, x.kind) for x in counts.collect()}
    assert {w: n for w, (n, _) in got.items()} == collections.Counter(w for _, t in rows for w in t.split())
    met = [collections.Counter(kind for w, (n, kind) in got.items() if w.endswith("rare") and w[0] == c) for c in "nv"]
    assert (met[0] & met[1]).total() <= 0.05 * met[0].total() and (met[0] + met[1]).total() == 1200


def test_exchange_finds_classes():
    r = np.random.RandomState(0)
    pairs = np.zeros((40, 40), np.int64)
    for _ in range(20000):  # even items follow odd ones and the reverse
        a = r.randint(40)
        b = r.randint(20) * 2 + (1 - a % 2)
        pairs[a, b] += 1
    of = brown_lm.exchange(pairs, classes=2)
    assert len(set(of[::2])) == 1 and len(set(of[1::2])) == 1 and of[0] != of[1]


SPECIAL = [(60, "see <|endoftext|> here"), (61, "inside<|startoftext|>words <|EndOfText|> <| endoftext |>"), (62, "<|endoftext|><|endoftext|>")]


def test_repair_round_trip(spark, docs, nothing):
    tok = Tokenizer.from_file(WORDS)
    docs = docs.unionByName(spark.createDataFrame(SPECIAL, "doc_id bigint, text string"), allowMissingColumns=True)
    at, want = 0, []
    for i, t in sorted(((i, t or "") for i, t in ROWS + SPECIAL), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    for shard in (1 << 20, 50):
        assert bag(tuple(r) for r in repair_ids.written(docs, WORDS, shard).collect()) == bag(want)
    assert repair_ids.written(nothing, WORDS).collect() == []


def repeats(symbols):
    """The most places that any pair has without overlapping itself."""
    n, last = collections.Counter(), {}
    for k, pair in enumerate(zip(symbols, symbols[1:], strict=False)):
        if last.get(pair, -2) < k - 1:
            n[pair] += 1
            last[pair] = k
    return max(n.values(), default=0)


@pytest.mark.parametrize("top", [50, 70_000])
def test_repair_grammar(top):
    r = np.random.RandomState(1)
    ids = np.concatenate([r.randint(0, top, 500), np.tile([7, 7, 7, 9], 900), r.randint(0, 6, 4000)]).astype(np.uint32)
    shard = repair_ids.Shard(repair_ids.write_shard([5, None], [100, len(ids) - 100], ids))
    assert repeats(shard.symbols.tolist()) < 2
    assert (shard.ids() == ids).all() and len(shard.table) and len(shard.symbols) < len(ids) and shard.doc_ids == [5, None]
    for _ in range(50):
        a = r.randint(len(ids))
        b = r.randint(a, len(ids))
        assert (shard.range(a, b) == ids[a:b]).all()
    assert len(repair_ids.Shard(repair_ids.write_shard([], [], ids[:0])).ids()) == 0


def test_repair_leaves_no_pair_twice():
    r = np.random.RandomState(2)
    cases = [np.full(65_536, 3), np.tile(r.randint(0, 50, 10), 5), np.array([1, 1, 1]), np.array([1, 1, 1, 2, 1, 1, 1]), np.array([4]), *(r.randint(0, k, r.randint(2, 400)) for k in (2, 3, 9, 40) for _ in range(40))]
    for ids in cases:
        ids = ids.astype(np.uint32)
        symbols, table, base = repair_ids.compress(ids)
        assert repeats(symbols.tolist()) < 2
        sizes = repair_ids.lengths(table, base)
        assert (repair_ids.expand(symbols, table, base, sizes) == ids).all()
    assert len(repair_ids.compress(cases[0].astype(np.uint32))[0]) <= 2


def test_words_tokenizer_by_chunks(tmp_path):
    tok = Tokenizer.from_file(WORDS)
    r, odd = random.Random(7), ["Σας ΣΑΣ", "é ́x", "<|endoftext|>", "\x01", "İI", "'S don't'll", "a b", "9,9.9", "A.B!?c", " ", "ﬁ", "x_y-z", " ", "\n", "\t"]
    texts = ["".join(r.choice(odd) for _ in range(r.randint(0, 12))) for _ in range(300)]
    for text, got in zip(texts, repair_ids.encode_texts(texts, WORDS), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == [*tok.encode(text, add_special_tokens=False).ids, 2], text
    said = json.load(open(WORDS))
    said["normalizer"] = None  # one that keeps case is read whole
    (tmp_path / "cased.json").write_text(json.dumps(said))
    cased = Tokenizer.from_file(f"{tmp_path}/cased.json")
    for text, got in zip(texts[:50], repair_ids.encode_texts(texts[:50], f"{tmp_path}/cased.json"), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == [*cased.encode(text, add_special_tokens=False).ids, 2], text


def reference_bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, nothing):
    enc, want = reference_bpe(), []
    for i, t in ROWS:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert bag(tuple(r) for r in byte_bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()) == bag(want)
    assert byte_bpe.digests(nothing, RANKS, public_tokenizers.PATTERN).collect() == []
    assert byte_bpe.encode(docs.where("doc_id = 8"), RANKS, public_tokenizers.PATTERN).first().ids == enc.encode_ordinary("one two")


def test_byte_bpe_on_odd_texts_and_edits():
    enc, r = reference_bpe(), random.Random(1)
    for _ in range(500):
        text = "".join(r.choice(["a", "aa", "e", "th", "  ", "\n", "ééé", "日本", "🎉", "́", "�", "\x00", "ing", "0", "19", "!!", "---", "ß"]) for _ in range(r.randint(1, 30)))
        assert byte_bpe.encode_text(text, RANKS, public_tokenizers.PATTERN) == enc.encode_ordinary(text)
    bpe = byte_bpe.encoder(RANKS, public_tokenizers.PATTERN)[0]
    for _ in range(100):
        piece = "".join(r.choice("abethingrso") for _ in range(r.randint(1, 200))).encode()
        held, a = byte_bpe.Editable(bpe, piece), r.randint(0, len(piece))
        b = r.randint(a, min(len(piece), a + 4))
        held.edit(a, b, b"xy")
        assert held.last == bpe.chain(piece[:a] + b"xy" + piece[b:])
        held.append(b"tion")
        assert held.last == bpe.chain(held.piece) and held.bpe.decode(held.ids()) == held.piece


#: Encodes a batch of many distinct words in a process of its own; prints the MB that this took and the rows that came back.
WORKER = """
import random, re, sys
import pyarrow as pa
import public_tokenizers
from spanloom.llm import byte_bpe

def held():
    return int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

class Docs:
    def mapInArrow(self, run, schema):
        return run

byte_bpe.docs_of = lambda docs: docs
r, part = random.Random(1), "an en er in on st th te de le".split()
texts = pa.array([" ".join("".join(r.choices(part, k=r.randint(4, 7))) for _ in range(90)) for _ in range(8000)])
batch, before = pa.record_batch([pa.array(range(8000)), texts], names=["doc_id", "text"]), held()
run = byte_bpe.digests(Docs(), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
rows = sum(x.num_rows for x in run([batch]))
print(held() - before, rows)
"""


def test_byte_bpe_worker_memory():
    root = str(Path(byte_bpe.__file__).parents[2])
    got = subprocess.run([sys.executable, "-c", WORKER], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(got[1]) == 8000 and float(got[0]) < 120


def test_byte_bpe_of_long_texts(monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG", 50)
    monkeypatch.setattr(byte_bpe, "RUN", 7)
    bpe, pieces, split = byte_bpe.encoder(RANKS, public_tokenizers.PATTERN)
    spelled = {str(r).encode(): b for r, b in bpe.bytes_of.items()}.__getitem__
    for text in ("", BASE, say(14, 300) + "\n\n  naïve 日本語 🎉", "a" * 500):
        ids = reference_bpe().encode_ordinary(text)
        assert byte_bpe._digest(text, pieces.__getitem__, spelled, split) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def fuzzy(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontaminate(spark, docs, nothing):
    bench = spark.createDataFrame([(1, say(10, 12)), (2, None), (3, ""), (4, "tiny"), (5, BASE[40:140]), (5, BASE[40:140])], "item_id bigint, text string")
    got = decontaminate.leaks(docs, bench).collect()
    hit = [i for i, t in ROWS if t and BASE[40:140].lower() in t.lower()]
    assert bag((r.doc_id, r.item_id) for r in got if r.edits == 0) == bag((i, 5) for i in hit)
    assert {r.item_id for r in got} <= {5} and all(r.stop - r.start == len(BASE[40:140].strip()) for r in got if r.edits == 0)
    assert bag(decontaminate.leaks(docs, bench, most=10).collect()) == bag(got)  # the same as a join
    assert decontaminate.leaks(nothing, bench).collect() == [] == decontaminate.leaks(docs, bench.where("false")).collect()
    assert None in [r.doc_id for r in got]
    assert bag(r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()) == bag(i for i, _ in ROWS if i is None or i not in {r.doc_id for r in got})


def test_decontaminate_joined_as_sent(spark):
    r, items, texts = random.Random(9), [], []
    for k in range(60):
        items.append((k % 50, "".join(r.choice("abcdefgh ") for _ in range(r.choice([2, 5, 9, 13, 14, 15, 16, 30, 90])))))
    for k in range(80):
        parts = []
        for _ in range(r.randint(0, 3)):
            x = list(r.choice(items)[1])
            for _ in range(r.randint(0, 2)):
                x[r.randrange(len(x))] = "z"
            parts += ["".join(x), "".join(r.choice("ijklé ") for _ in range(r.randint(0, 30)))]
        texts.append((k if k % 9 else None, " ".join(parts)))
    d, b = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = bag(decontaminate.leaks(d, b).collect())
    assert got and bag(decontaminate.leaks(d, b, most=1).collect()) == got


def test_decontaminate_against_all_alignments():
    r = random.Random(2)
    for _ in range(400):
        item = "".join(r.choice("abcdef ") for _ in range(r.randint(3, 60) if r.random() < 0.5 else r.randint(13, 15))).strip()
        if not item:
            continue
        copy = list(item)
        for _ in range(r.randint(0, 5)):
            at, how = r.randrange(len(copy)), r.randint(0, 2)
            copy[at : at + (how != 1)] = [] if how == 2 else [r.choice("abcdef ")]
            copy = copy or ["a"]
        pad = lambda: "".join(r.choice("ghij ") for _ in range(r.randint(0, 50)))
        text = (pad() + "".join(copy) + pad()).encode()
        hits = decontaminate.Items([(1, item)]).find(text)
        best = fuzzy(item.encode(), text)
        assert bool(hits) == (best <= decontaminate.budget(len(item))[0])
        assert not hits or min(h[3] for h in hits) == best


def test_pii_base_matches_plain_patterns():
    import re

    plain = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    passes = [lambda x: True, lambda x: all(int(p) <= 255 for p in x.split(".")), pii.is_card, pii.is_phone]
    r = random.Random(5)
    for _ in range(20000):
        t = "".join(r.choice(["@", ".", "a", "b", "_", "1", "12", "255", "+", "-", " ", "(", "4111111111111111", "é", "%", "٣", "\n"]) for _ in range(r.randint(1, 16)))
        assert pii.base_spans(t) == [(k, *m.span()) for k in range(4) for m in re.finditer(plain[k], t) if passes[k](m[0])]


def test_pii(spark, docs, nothing):
    rows = [(i, f"{say(i, 6)} +1 ({200 + i}) 555-0{100 + i} and u{i}@mail{i}.example.com {say(i, 3)} {i}.7.8.9 x") for i in range(60)] + [(90, "call (301) 555-0346 now"), (91, None), (92, "4111 1111 1111 1111"), (93, "1" * 50_000 + "." * 50_000 + "a@" * 5_000)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows:
        base = pii.told(pii.base_spans(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i].spans.split(","))
        assert got[i].n_email + got[i].n_ip + got[i].n_card + got[i].n_phone == (got[i].spans.count(",") + 1 if got[i].spans else 0)
    assert got[90].spans == "phone:5:19"  # the field's own, beyond the base pattern
    assert got[91].spans == "" and got[92].spans == "card:0:19"
    assert len(pii.find(docs).collect()) == len(ROWS) and pii.find(nothing).collect() == []


def test_pii_field_against_enumeration():
    field, r = pii.Field(), np.random.RandomState(3)
    field.w[:], field.next[:] = r.randn(*field.w.shape), r.randn(*field.next.shape)
    for text in ("12", "1.2 a@b", "+1 (2) 3", "12 34 5.6 7@8 9"):
        chunks, before = next(pii.stretches(text))
        n, scores = len(chunks), field.scores(field.lattice(text, chunks, before[0]))

        def paths(at, text=text, n=n):
            if at == n:
                yield []
            for size in range(1, min(pii.LONGEST, n - at) + 1):
                for kind in range(pii.OTHER + 1):
                    if kind != pii.OTHER or size == 1:
                        yield from ([(at + size, size, kind), *rest] for rest in paths(at + size))

        worth = {}
        for path in map(tuple, paths(0)):
            kinds = [pii.OTHER + 1, *(k for *_, k in path)]
            worth[path] = sum(scores[e, s][k] for e, s, k in path) + sum(field.next[a, b] for a, b in zip(kinds, kinds[1:], strict=False))
        total = np.logaddexp.reduce(list(worth.values()))
        assert field.sums(scores, n)[3] == pytest.approx(total)
        assert tuple(field.best(scores, n)) == max(worth, key=worth.get)
        sure = field.sure(scores, n)
        for cell in {c for path in worth for c in path}:
            assert sure(*cell) == pytest.approx(np.exp(np.logaddexp.reduce([w for path, w in worth.items() if cell in path]) - total))
        post, follow = field.posteriors(scores, n)
        assert sum(v.sum() * size for (_, size), v in post.items()) == pytest.approx(n) and follow.sum() == pytest.approx(sum(v.sum() for v in post.values()))


def test_pii_learns_other_spellings(spark):
    assert re.findall("[0-9]+", pii.spelt(3, "+1 (301) 555-0346")) == ["301", "555", "0346"]
    r = random.Random(6)
    rows = [(i, f"{say(i, 6)} +1 {r.randint(200, 999)} {r.randint(200, 999)} {r.randint(1000, 9999)} and {r.randint(1, 99)} {say(i, 3)} 20{r.randint(10, 30)}-0{r.randint(1, 9)}-1{r.randint(0, 9)} x") for i in range(300)]
    field = pii.train(spark.createDataFrame(rows, "doc_id bigint, text string"))
    for text in ("call (301) 555-0346 now", "call 301-555-0346 now", "call 301.555.0346 now"):
        assert pii.all_spans(text, field) == [(3, 5, len(text) - 4)], text
    for text in ("on 2024-05-17 and 33", "a 12 b", "7 of 9"):
        assert pii.all_spans(text, field) == [], text
    assert np.isfinite(pii.Field().learn([x for i in range(10) for x in pii.examples(f"see a@b.co {i}")] * 2_000, epochs=1).w).all()


def test_pii_in_long_stretches(spark):
    rows = [(i, f"{say(i, 6)} +1 ({200 + i}) 555-0{100 + i} and u{i}@mail{i}.example.com {say(i, 3)} {i}.7.8.9 x") for i in range(60)]
    field = pii.train(spark.createDataFrame(rows, "doc_id bigint, text string"))
    for lead in (61, 62, 63, 64, 127):  # the phone lies over, before and after what would be a border of 64 chunks
        text = "x " + "u1@mail1.example.com " * lead + "(301) 555-0346"
        assert pii.all_spans(text, field)[-1] == (3, len(text) - 14, len(text)), lead


def labelled(spark):
    rows, labels = [], []
    for i in range(400):
        words = say(1000 + i, 40).split()
        bad, toxic = i % 5 == 0, i % 4 == 0
        if toxic:
            words[5::9] = [random.Random(i).choice(["scoundrel", "nitwit", "dunderhead"])] * len(words[5::9])
        text = " ".join(w + "###" for w in words) if bad else " ".join(words) + ".\n" + say(i, 8)
        rows.append((i, text, "en", f"src{i % 4}", len(text)))
        if i % 3:
            labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")


def test_quality(spark, docs, nothing):
    d, labels = labelled(spark)
    got = quality.score(d, labels, exchange=20).collect()
    assert sum(r.predicted == (r.doc_id % 5 != 0) for r in got) >= 0.98 * len(got) and len(got) == 400
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns and kept.count() == pytest.approx(320, abs=6)
    assert len(quality.score(docs, labels).collect()) == len(ROWS)
    assert {r.score for r in quality.score(docs, labels.where("quality = 1")).collect()} == {1.0} == {r.score for r in quality.score(docs, labels.where("false")).collect()}
    assert quality.score(nothing, labels).collect() == []


def test_toxicity(spark, docs, nothing):
    d, labels = labelled(spark)
    got = toxicity.score(d, labels).collect()
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len(toxicity.score(docs, labels).collect()) == len(ROWS)
    assert {r.score for r in toxicity.score(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.score(nothing, labels).collect() == []


def test_toxicity_against_plain_loops(spark):
    import zstandard

    d, labels = labelled(spark)
    raw = lambda x: zstandard.ZstdCompressionDict(bytes(range(1, 33)) + x, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    size = lambda x, by: len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=raw(by), write_content_size=False, write_dict_id=False).compress(x))
    texts = ["", "a b! c?", "you nitwit " + say(3, 9), "x" * 200 + " é", say(4, 30)]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA).union(d.where("doc_id >= 5"))
    got = {r.doc_id: r.score for r in toxicity.score(d, labels).collect()}
    own = toxicity.train(d, labels)
    assert len(own.toxic) <= toxicity.TOXIC_BYTES and len(own.ordinary) <= toxicity.ORDINARY_BYTES
    for i, t in enumerate(texts):
        words = t.lower().encode().split()
        windows = [w[k : k + 64] for w in words for k in range(0, len(w), 64)]
        assert b"".join(windows) == b"".join(words)  # the whole text
        values = []
        for w in windows:
            x = b" " + w + b" " + bytes(range(1, 33))
            values.append(own.ratios.get((len(w) * 256 + size(x, own.ordinary)) * 256 + size(x, own.toxic + own.ordinary), 0.0))
        n, over = len(values) + 30, [max(v - 1, 0) for v in values]
        feats = [sum(values) / n, sum(max(v - 0.5, 0) for v in values) / n, sum(over) / n, min(sum(over), 20), max([0, *values])]
        assert got[i] == pytest.approx(float(1 / (1 + np.exp(-own.curve(np.array([feats]))[0]))), abs=1e-9)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d, labels = labelled(spark)
    more = spark.createDataFrame([(500, BASE, "en", "src1", 1), (501, BASE.replace(" ", "  "), "en", "src1", 1), (502, say(77, 30) + " " + BASE[:200], "en", "src1", 1)], SCHEMA)
    docs = d.union(more)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, BASE[:200])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    rows = [(r.doc_id, r.text) for r in quality.keep_good(docs, labels).collect()]
    rows = [(i, t) for i, t in brute_lines(sorted(rows)) if t.strip()]
    comp = brute_components(rows)
    rows = [(i, t) for i, t in rows if comp[i] == i and BASE[:200] not in t]
    enc = reference_bpe()
    assert got.keys() == {i for i, _ in rows} and not got.keys() & {500, 501, 502}
    for i, t in rows:
        assert got[i].n_tokens == len(enc.encode_ordinary(t)) and got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


CLASH = ["gone_lines", "gone_id", "touched__", "lines_removed", "h1", "words", "rid", "least"]


def test_line_dedup_keeps_columns_of_any_name(spark, docs):
    from pyspark.sql import functions as F

    odd = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASH if c not in docs.columns])
    done = line_dedup.drop_lines(odd)
    assert done.columns == [*odd.columns, "lines_removed_"]
    got = done.collect()
    assert bag((r.doc_id, r.text) for r in got) == bag(brute_lines(ROWS))
    assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in got for c in CLASH if c not in docs.columns)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_tables(spark, docs, nothing, tmp_path, empty):
    import corpus_pipeline
    from pyspark.sql import functions as F

    odd = (nothing if empty else docs).select("*", *[F.lit("x").alias(c) for c in CLASH if empty or c not in docs.columns])
    for name, kind in (("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        rows = [] if empty else {"labels": [(1, 1, 0), (8, 0, 0), (None, 0, 0), (2, None, None)], "benchmark": [(1, None), (2, ""), (None, say(7))]}[name]
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, str(tmp_path))
        rows = got.collect()
        if name != "byte_bpe":
            assert got.columns == odd.columns and bag(r.doc_id for r in rows) <= bag(r.doc_id for r in odd.collect())
            assert not rows or {r.touched__ for r in rows} == {"x"}
        if name in ("byte_bpe",):
            assert len(rows) == odd.count()
        if name == "line_dedup" and not empty:
            assert {r.doc_id for r in rows} >= {1, 5, 6, None}
        if name == "benchmark_decontamination" and not empty:
            assert {i for i, t in ROWS if i} - {r.doc_id for r in rows} == {i for i, t in ROWS if i and t and say(7) in t}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= odd.count()


def test_quality_exchange_grows_and_keeps(spark):
    d, labels = labelled(spark)
    feats = quality.features(d)
    views = quality.train(feats, labels, exchange=5, rounds=1)[:2]
    rows = feats.mapInArrow(quality._sure(views, 3), "kind int, lean double, x array<double>").collect()
    x = np.array([r.x for r in feats.collect()])
    for v, part in enumerate((slice(0, quality._TEXT), slice(quality._TEXT, None))):
        for label in (0, 1):
            leans = sorted({round(float(z), 9) for z in (views[v](x[:, part]) * (1 if label else -1))}, reverse=True)
            own = [round(r.lean, 9) for r in rows if r.kind == 2 * v + label]
            assert max(own) == leans[0] and len({tuple(r.x) for r in rows if r.kind == 2 * v + label}) <= len(own)


def test_stages_keep_columns(spark, docs):
    assert json.dumps(ngram_join.keep_one(docs.select("doc_id", "text")).columns) == '["doc_id", "text"]'

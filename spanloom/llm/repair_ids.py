"""Token ids in a Re-Pair grammar file format.

Documents are dealt by ranges of ``doc_id`` and sorted; each task cuts its ids into shards. A shard is
compressed by Re-Pair in rounds: the most frequent pairs of neighbouring symbols, counted over the whole
shard, become nonterminals, and their occurrences are replaced, until no pair occurs twice. The blob stores
rules, expansion lengths and, every ``STEP`` symbols, the offset they expand to, so any range of ids can be decoded
without reading what comes before it. Blobs are rows of a Parquet table in the shared folder.

Blob: magic ``RPI1``; six little-endian u32: documents, ids, first nonterminal, rules, symbols, STEP; then
i64 doc ids, u8 null flags of them, u32 id counts; u32 rules (left, right); u32 expansion lengths of the rules;
u32 offsets; u16 symbols (u32 if a symbol is over 65,535, told by the magic ``RPI4``).

Ids are those of the tokenizers library with its defaults and without added special tokens: the string of a special
token in a text is that token's id.

Defined results: null or empty text is its end id alone; rows with a null ``doc_id`` come first; equal ids
are ordered by text; other input columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Recent, docs_of, stash

END = 2
#: Pairs that occur this often in a shard are replaced: Re-Pair's own bound, no pair is left twice.
LEAST = 2
#: A round replaces pairs up to this many times rarer than the top one.
SPREAD = 1024
SHARD, STEP = 1 << 20, 1024
_CHUNKS = 1_000_000


def _repeated(left: np.ndarray, right: np.ndarray, least: int):
    """Of the pairs (left, right) those that occur ``least`` times: their numbers, pair by pair, and how often each pair occurs."""
    n = len(left)
    bits = max(n - 1, 1).bit_length()
    half = (64 - bits) // 2
    if n and max(int(left.max()), int(right.max())) >> half == 0:  # pair and number in one, sorted at once
        row = left.astype(np.uint64)
        row <<= np.uint64(half)
        row |= right
        row <<= np.uint64(bits)
        row |= np.arange(n, dtype=np.uint64)
        row.sort()
        place = (row & np.uint64((1 << bits) - 1)).astype(np.int32)
        row >>= np.uint64(bits)
    else:
        row = (left.astype(np.uint64) << np.uint64(32)) | right
        place = np.argsort(row, kind="stable").astype(np.int32)
        row = row[place]
    starts = np.flatnonzero(np.concatenate([np.ones(min(n, 1), bool), row[1:] != row[:-1]]))
    counts = np.diff(starts, append=n)
    often = counts >= least
    return place[np.repeat(often, counts)], counts[often]


def _apart(spots: np.ndarray) -> np.ndarray:
    """Of a run of neighbouring places every other one, from its start: their pairs overlap."""
    if len(spots) > 1:
        new = np.concatenate([[True], spots[1:] != spots[:-1] + 1])
        if not new.all():
            start = np.maximum.accumulate(np.where(new, spots, 0))
            spots = spots[(spots - start) % 2 == 0]
    return spots


def compress(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols, rules as rows (left, right), and the first nonterminal.

    A round counts neighbouring pairs exactly and replaces the most frequent ones, down to ``SPREAD`` times fewer
    occurrences than the top pair's; where two of them overlap, the more frequent one has the place, and a pair
    that is left with fewer than ``least`` places waits. Rounds go on until no pair occurs ``least`` times. After the
    first round only pairs that occurred often enough so far and pairs with a new symbol are counted: no other
    can reach the bound.
    """
    base = int(ids.max()) + 1 if len(ids) else 0
    symbols, table, rules, at = ids.astype(np.uint32), [], 0, None
    while True:
        place, counts = _repeated(symbols[:-1], symbols[1:], least) if at is None else _repeated(symbols[at], symbols[at + 1], least)
        place = place if at is None else at[place]
        first = place[np.cumsum(counts) - counts]
        owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        which = np.empty(len(symbols), np.int32)
        which[place] = owner
        left, right, worth = symbols[first], symbols[first + 1], counts
        twins = left == right
        if twins.any():  # a pair of equal symbols overlaps itself in a run of them: only every other place counts
            own = _apart(np.sort(place[twins[owner]]))
            worth = np.where(twins, np.bincount(which[own], minlength=len(counts)), counts)
        chosen = worth >= max(least, int(worth.max(initial=0)) // SPREAD)
        if not chosen.any():
            return symbols, np.concatenate(table) if table else np.empty((0, 2), np.uint32), base
        weight = np.zeros(len(symbols) + 2, np.int32)
        weight[place + 1] = np.where(chosen, worth, 0).astype(np.int32)[owner]
        here = weight[1:-1]
        spots = _apart(np.flatnonzero((here > 0) & (weight[:-2] <= here) & (weight[2:] <= here)))
        fit = np.bincount(which[spots], minlength=len(counts)) >= least
        if not fit.any():  # all of them stand in each other's way: the top pair goes alone
            one = int(np.argmax(worth))
            spots, fit = _apart(np.sort(place[owner == one])), np.arange(len(counts)) == one
        spots = spots[fit[which[spots]]]
        table.append(np.column_stack([left[fit], right[fit]]))
        symbols[spots] = (np.cumsum(fit) - 1 + base + rules).astype(np.uint32)[which[spots]]
        rules += int(fit.sum())
        stay, again = np.ones(len(symbols), bool), np.zeros(len(symbols), bool)
        stay[spots + 1] = False
        again[place] = again[spots] = again[np.maximum(spots, 1) - 1] = True
        again[np.maximum(spots, 2) - 2] |= ~stay[np.maximum(spots, 2) - 1]  # the one before is a new symbol too
        again = again[stay]
        again[-1] = False
        symbols, at = symbols[stay], np.flatnonzero(again)


def lengths(table: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule expands to: a rule's parts come before it, so a pass a level settles all."""
    out = np.zeros(len(table), np.int64)
    left, right = table[:, 0].astype(np.int64) - base, table[:, 1].astype(np.int64) - base
    todo = np.arange(len(table))
    while len(todo):
        a = np.where(left[todo] < 0, 1, out[np.maximum(left[todo], 0)])
        b = np.where(right[todo] < 0, 1, out[np.maximum(right[todo], 0)])
        done = (a > 0) & (b > 0)
        out[todo[done]] = (a + b)[done]
        todo = todo[~done]
    return out


def expand(symbols: np.ndarray, table: np.ndarray, base: int, sizes: np.ndarray) -> np.ndarray:
    """The ids of symbols. Every pass writes the ids that are reached and opens the rules one level."""
    size = np.ones(len(symbols), np.int64)
    grown = symbols >= base
    size[grown] = sizes[symbols[grown].astype(np.int64) - base]
    at = np.cumsum(size) - size
    out, symbols = np.empty(int(size.sum()), np.uint32), symbols.astype(np.int64)
    while len(symbols):
        plain = symbols < base
        out[at[plain]] = symbols[plain]
        at, rule = at[~plain], symbols[~plain] - base
        left, right = table[rule, 0].astype(np.int64), table[rule, 1].astype(np.int64)
        step = np.where(left < base, 1, sizes[np.maximum(left - base, 0)])
        symbols, at = np.concatenate([left, right]), np.concatenate([at, at + step])
    return out


def write_shard(doc_ids: list, counts: list[int], ids: np.ndarray) -> bytes:
    symbols, table, base = compress(ids)
    sizes = lengths(table, base)
    size = np.ones(len(symbols), np.int64)
    grown = symbols >= base
    size[grown] = sizes[symbols[grown].astype(np.int64) - base]
    offsets = (np.cumsum(size) - size)[::STEP]
    wide = base + len(table) > 1 << 16
    return b"".join(
        [
            b"RPI4" if wide else b"RPI1",
            struct.pack("<6I", len(doc_ids), len(ids), base, len(table), len(symbols), STEP),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is None for x in doc_ids], np.uint8).tobytes(),
            np.array(counts, "<u4").tobytes(),
            table.astype("<u4").tobytes(),
            sizes.astype("<u4").tobytes(),
            offsets.astype("<u4").tobytes(),
            symbols.astype("<u4" if wide else "<u2").tobytes(),
        ]
    )


class Shard:
    def __init__(self, blob: bytes):
        if blob[:4] not in (b"RPI1", b"RPI4"):
            raise ValueError("not a shard of token ids")
        docs, self.n_ids, self.base, rules, n, self.step = struct.unpack_from("<6I", blob, 4)
        at = 28

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, count, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null, strict=True)]
        self.counts = take("<u4", docs)
        self.table = take("<u4", 2 * rules).reshape(-1, 2)
        self.sizes = take("<u4", rules)
        self.offsets = take("<u4", -(-n // self.step))
        self.symbols = take("<u4" if blob[:4] == b"RPI4" else "<u2", n)

    def ids(self) -> np.ndarray:
        return expand(self.symbols, self.table, self.base, self.sizes)

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, expanding only the blocks that hold them."""
        a = max(0, int(np.searchsorted(self.offsets, start, "right")) - 1)
        b = int(np.searchsorted(self.offsets, stop, "left"))
        got = expand(self.symbols[a * self.step : b * self.step], self.table, self.base, self.sizes)
        skip = start - int(self.offsets[a]) if len(self.offsets) else 0
        return got[skip : skip + stop - start]


_MARK = b"\x01"
#: Bytes: blanks 0, a-z and 0-9 1, ASCII marks but the apostrophe 2, others 3. Between 1 and 2 the tokenizer always splits.
_KIND = np.full(256, 3, np.uint8)
_KIND[[10, 32]] = 0
_KIND[[*range(48, 58), *range(97, 123)]] = 1
_KIND[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
#: Chunks are told apart by sums of these numbers by byte, times a power by place.
_NUMBERS, _BASE = np.random.RandomState(7).randint(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1), 0x9E3779B97F4A7C15
#: Bytes that are looked at together.
_PART = 1 << 21


#: What a tokenizer file must say for its chunks between blanks to be independent. Fixed values.
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class Chunks:
    """Ids, as bytes, of whole texts.

    Where the tokenizer's file folds blanks and case and splits at blanks, no rule reaches over a blank: a text goes in
    chunks, and each different one is encoded once and remembered. Chunks not met lately are encoded together, set
    apart by a mark, and a chunk that holds the mark goes alone. Texts that hold a special token's string, and all
    texts of other tokenizers, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        steps = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.apart = said.get("normalizer") == _NORMAL and steps[0].get("pattern") == {"Regex": _SPLIT} and steps[0].get("behavior") == "Removed"
        self.special = [x["content"] for x in said.get("added_tokens") or []]
        self.mark = self._alone(_MARK)
        self.words, suffix = None, (said.get("model") or {}).get("end_of_word_suffix")
        if self.apart and suffix:
            self.words = Tokenizer.from_file(path)
            self.words.normalizer = normalizers.Sequence([])
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocab = self.words.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.memo = Recent(self._alone, _CHUNKS)
        back = pow(_BASE, -1, 1 << 64)
        self.powers, self.inverse = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(_PART, x, np.uint64)])) for x in (_BASE, back))

    def _alone(self, chunk: bytes) -> bytes:
        return np.array(self.tok.encode(chunk.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, chunks: list[bytes]) -> None:
        """Words of plain Latin letters in lower case need neither the file's folding nor its splitting, only blanks between them."""
        memo, old, plain, others = self.memo, self.memo.old, [], []
        for x in chunks:
            if x in old:
                memo.put(x, old[x])
            elif len(x) <= memo.longest:
                if x.isalpha():  # ASCII letters, lowered already
                    plain.append(x)
                elif _MARK not in x:
                    y = x.decode()
                    (plain if y.isalpha() and max(y) < "\u0180" and y == y.lower() and unicodedata.is_normalized("NFC", y) else others).append(x)
        if plain and self.words is not None:
            ids = np.array(self.words.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0].ids, "<u4")
            self._keep(plain, ids, np.flatnonzero(self.ends[ids]) + 1, 0)
        if others and len(self.mark) == 4:
            ids = np.array(self.tok.encode_batch_fast([(b" " + _MARK + b" ").join(others).decode()], add_special_tokens=False)[0].ids, "<u4")
            self._keep(others, ids, np.append(np.flatnonzero(ids == np.frombuffer(self.mark, "<u4")[0]), len(ids)), 1)

    def _keep(self, chunks: list[bytes], ids: np.ndarray, ends: np.ndarray, between: int) -> None:
        raw, start = ids.tobytes(), 0
        for x, end in zip(chunks, (4 * ends).tolist(), strict=True):
            self.memo.put(x, raw[start:end])
            start = end + 4 * between

    def _together(self, texts: list[bytes]) -> list[bytes]:
        """Ids of lower-cased texts that have ``_PART`` bytes together, with the blanks between them."""
        raw = b"\n".join(texts)
        b = np.frombuffer(raw, np.uint8)
        kind = _KIND[b]
        before, after = np.concatenate([[0], kind[:-1]]), np.concatenate([kind[1:], [0]])
        starts = np.flatnonzero((kind > 0) & ((before == 0) | ((before == 1) & (kind == 2))))
        ends = np.flatnonzero((kind > 0) & ((after == 0) | ((kind == 1) & (after == 2)))) + 1
        if not len(starts):
            return [b""] * len(texts)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_NUMBERS[b] * self.powers[: len(b)], dtype=np.uint64)])
        code = (sums[ends] - sums[starts]) * self.inverse[starts] ^ (ends - starts).astype(np.uint64)
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        bits = np.uint64(max(len(code) - 1, 1).bit_length())
        order = np.sort((code >> bits << bits) | np.arange(len(code), dtype=np.uint64))
        at = (order & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        # neighbours in this order are told apart by all bits, so that a group is one chunk
        new = np.concatenate([[True], code[at[1:]] != code[at[:-1]]])
        which = np.empty(len(code), np.int64)
        which[at] = np.cumsum(new) - 1
        first = at[new]
        chunks = [raw[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        got = list(map(self.memo.get, chunks))
        new = [k for k, x in enumerate(got) if x is None]
        self.learn([chunks[k] for k in new])
        for k in new:
            got[k] = self.memo[chunks[k]]
        flat, size = np.frombuffer(b"".join(got), "<u4"), np.fromiter(map(len, got), np.int64, len(got)) // 4
        place, n = np.cumsum(size) - size, size[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(place[which] - upto[:-1], n) + np.arange(upto[-1])]
        edges = np.cumsum([0] + [len(x) + 1 for x in texts])
        cuts = upto[np.searchsorted(starts, edges)].tolist()
        return [ids[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]

    def _pieces(self, text: bytes):
        """A text in parts that end at blanks; a longer run without a blank stays whole."""
        while len(text) > _PART // 2:
            cut = max(text.rfind(b" ", 0, _PART // 2), text.rfind(b"\n", 0, _PART // 2))
            if cut < 0:
                cut = min((x for x in (text.find(b" "), text.find(b"\n")) if x >= 0), default=len(text))
            yield text[:cut]
            text = text[cut + 1 :]
        yield text

    def encode(self, texts: list[str]) -> list[bytes]:
        end = struct.pack("<I", END)
        out: list[list[bytes]] = [[] for _ in texts]
        held, owners, size = [], [], 0

        def flush():
            nonlocal held, owners, size
            for k, ids in zip(owners, self._together(held), strict=True):
                out[k].append(ids)
            held, owners, size = [], [], 0

        for k, x in enumerate(texts):
            if not self.apart or any(s in x for s in self.special):
                out[k].append(self._alone(x.encode()))
                continue
            for part in self._pieces(x.encode().lower()):  # lower-casing A-Z changes no id, but lets more chunks be met again
                if len(part) > _PART // 2:
                    out[k].append(self._alone(part))
                    continue
                if size + len(part) + 1 > _PART:
                    flush()
                held.append(part)
                owners.append(k)
                size += len(part) + 1
            if len(out[k]) or size > _PART // 2:
                flush()
        if held:
            flush()
        return [b"".join(x) + end for x in out]


_held: dict[str, Chunks] = {}


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids and the end id, as little-endian u32."""
    if path not in _held:
        _held[path] = Chunks(path)
    return _held[path].encode(texts)


def write_ids(docs: DataFrame, path: str, shard: int = SHARD) -> DataFrame:
    """The shard table, written and read back: ``part, at`` (offset in the part), ``n_ids, blob``."""

    def run(batches):
        from pyspark import TaskContext

        part, at, held, names, counts = TaskContext.get().partitionId(), 0, [], [], []

        def flush():
            nonlocal at, held, names, counts
            ids = np.frombuffer(b"".join(held), "<u4")
            out = pa.record_batch([pa.array([part], pa.int64()), pa.array([at], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([write_shard(names, counts, ids)], pa.binary())], names=["part", "at", "n_ids", "blob"])
            at += len(ids)
            held, names, counts = [], [], []
            return out

        size = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                for doc_id, ids in zip(some.column(0).to_pylist(), encode_texts(some.column(1).to_pylist(), path), strict=True):
                    held.append(ids)
                    names.append(doc_id)
                    counts.append(len(ids) // 4)
                    size += counts[-1]
                    if size >= shard:
                        yield flush()
                        size = 0
        if names:
            yield flush()

    ordered = docs_of(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stash(ordered.mapInArrow(run, "part bigint, at bigint, n_ids bigint, blob binary"))


def read_ids(shards: DataFrame) -> DataFrame:
    """``part, doc_id, local`` (offset in the part)``, n_tokens, ids_crc32`` from the blobs."""

    def run(batches):
        for batch in batches:
            for part, at, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                s = Shard(blob)
                ids = s.ids().astype("<u4", copy=False)
                starts = [0, *accumulate(s.counts.tolist())]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
                yield pa.record_batch([pa.array([part] * len(crc), pa.int64()), pa.array(s.doc_ids, pa.int64()), pa.array([at + x for x in starts[:-1]], pa.int64()), pa.array(s.counts.astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "doc_id", "local", "n_tokens", "ids_crc32"])

    return shards.select("part", "at", "blob").mapInArrow(run, "part bigint, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")


def written(docs: DataFrame, path: str, shard: int = SHARD) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    shards = write_ids(docs, path, shard)
    # one sum a range partition: their number is the cluster's setting and not the corpus's size
    sums = sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = list(zip((p for p, _ in sums), accumulate((n for _, n in sums), initial=0), strict=False))
    bases = docs.sparkSession.createDataFrame(before or [(-1, 0)], "part bigint, base bigint")
    return read_ids(shards).join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")

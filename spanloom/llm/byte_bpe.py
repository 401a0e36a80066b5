"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece exactly one token can end a correct encoding: the token whose removal leaves
a prefix whose own last token may stand beside it. Storing that last token for each prefix gives the
encoding by walking back, allows exact appends, and after an edit only the prefixes near it change.
Whether two tokens may stand side by side depends on them alone: no merge across their border may come
due while its two sides are exposed.

Defined results: null or empty text has no ids, the sha256 of nothing twice and 0 tokens; equal rows give
equal results; null ``doc_id`` stays null; other input columns are ignored; an empty table gives no rows.
Pieces and caches are bounded in memory only; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from spanloom.llm.common import Recent, docs_of, small

#: Pieces of text that a worker remembers, and pairs of tokens of which it knows whether they may stand side by side.
CACHE, PAIRS = 300_000, 400_000
#: Code points of a text that is split at once, and pieces of a longer one that are held at a time.
LONG, RUN = 1 << 18, 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Rows(dict):
    def __missing__(self, key):
        self[key] = row = {}
        return row


class PrefixBPE:
    """Tokens go by their ranks; only ``ranks`` and ``bytes_of`` hold their bytes, once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks: dict[bytes, int] = {}  # grows below: a token is split by the merges that come before it
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        #: token -> its right and left edges below itself, each (bytes, rank of the merge that hides it, the edges below)
        self.right: dict[int, tuple | None] = dict.fromkeys(ranks.values())
        self.left: dict[int, tuple | None] = dict.fromkeys(ranks.values())
        #: token -> those whose standing after it is known
        self.fits, self.known = Rows(), 0
        self.usable = {token: rank for token, rank in ranks.items() if len(token) == 1}
        #: last three bytes -> lengths of the usable tokens that end so, the longest first, then 2 and 1
        self.lengths: dict[bytes, tuple[int, ...]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            parts = self._two_parts(token) if len(token) > 1 else None
            self.fits.clear()
            self.known, self.ranks[token] = 0, rank
            if parts is None:
                continue  # no merges lead to it; it is only found as a whole piece
            a, b = parts
            self.usable[token] = rank
            self.right[rank], self.left[rank] = (self.bytes_of[b], rank, self.right[b]), (self.bytes_of[a], rank, self.left[a])
            known = self.lengths.get(token[-3:], (2, 1))
            if len(token) not in known:
                self.lengths[token[-3:]] = tuple(sorted((*known, len(token)), reverse=True))

    def _two_parts(self, token: bytes):
        """The two tokens that the last merge joins into this one, encoding it by shorter tokens first."""
        found = self.chain(token)
        if found is None:
            return None
        end, out = len(token), []
        while end:
            out.append(found[end])
            end -= len(self.bytes_of[found[end]])
        return (out[1], out[0]) if len(out) == 2 else None

    def beside(self, a: int, b: int) -> bool:
        known = self.fits[a].get(b)
        if known is None:
            known, merges = True, self.ranks.get
            right = (self.bytes_of[a], float("inf"), self.right[a])
            while right and known:
                x, hides_x, right = right
                left = (self.bytes_of[b], float("inf"), self.left[b])
                while left:
                    y, hides_y, left = left
                    merge = merges(x + y)
                    if merge is not None and hides_x > merge and hides_y >= merge:  # of equal merges the left one comes first
                        known = False
                        break
            self.known += 1
            if self.known > PAIRS:
                self.fits.clear()
                self.known = 1
            self.fits[a][b] = known
        return known

    def chain(self, piece: bytes, last: list | None = None):
        """Each prefix's last token, index 0 unused; ``last`` continues a chain that already holds a start."""
        last = last if last is not None else [-1]
        usable, lengths, fits = self.usable, self.lengths.get, self.fits
        for end in range(len(last), len(piece) + 1):
            for size in lengths(piece[end - 3 : end] if end > 2 else piece[:end], (2, 1)):
                if size < end:
                    token = piece[end - size : end]
                    if token in usable:
                        rank, before = usable[token], last[end - size]
                        known = fits[before].get(rank)
                        if known or known is None and self.beside(before, rank):
                            last.append(rank)
                            break
                elif size == end and (token := piece[:end]) in usable:
                    last.append(usable[token])
                    break
            else:
                return None
        return last

    def walk(self, last: list) -> list[int]:
        end, out = len(last) - 1, []
        while end > 0:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        last = self.chain(piece)
        if last is None:
            raise ValueError("a byte is missing from the vocabulary")
        return self.walk(last)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Editable:
    """A piece that keeps its prefix tokens, so that appends and edits redo only what they touch."""

    def __init__(self, bpe: PrefixBPE, piece: bytes = b""):
        self.bpe, self.piece = bpe, piece
        self.last = bpe.chain(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.last = self.bpe.chain(self.piece, last=self.last)

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace ``piece[start:stop]``; returns how many prefixes were computed anew."""
        old, shift = self.last, len(new) - (stop - start)
        self.piece = self.piece[:start] + new + self.piece[stop:]
        last, same, done = old[: start + 1], 0, 0
        while len(last) <= len(self.piece):
            end = len(last)
            self.bpe.chain(self.piece[:end], last=last)
            done += 1
            same = same + 1 if end - shift > stop and old[end - shift] == last[end] else 0
            if same >= self.bpe.longest:  # no later token can reach before these: the rest is as it was
                last += old[end - shift + 1 :]
        self.last = last
        return done

    def ids(self) -> list[int]:
        rank = self.bpe.ranks.get(self.piece)
        return [rank] if rank is not None else self.bpe.walk(self.last)


def _pieces(bpe: PrefixBPE) -> Recent:
    """Piece of text to its decimal ids."""
    return Recent(lambda piece: ",".join(map(str, bpe.encode_piece(piece.encode()))), CACHE)


_held: dict[tuple[str, str], tuple] = {}


def encoder(path: str, pattern: str):
    """The pieces' cache and the splitter, built once a worker."""
    key = (path, pattern)
    if key not in _held:
        bpe = PrefixBPE(load_ranks(path))
        _held[key] = (bpe, _pieces(bpe), regex.compile(pattern))
    return _held[key]


def encode_text(text: str, path: str, pattern: str) -> list[int]:
    bpe, _, split = encoder(path, pattern)
    return [i for x in split.findall(text) for i in bpe.encode_piece(x.encode())]


def _runs(text: str, split):
    """The pieces of a text, those of a long one in several lists."""
    if len(text) <= LONG:
        yield split.findall(text)
        return
    found = (x.group() for x in split.finditer(text))
    while got := list(islice(found, RUN)):
        yield got


def _digest(text: str, get, spelled, split) -> tuple[int, str, str]:
    """Number of ids, digests of the ids and of what they decode to."""
    n, ids, back, comma = 0, hashlib.sha256(), hashlib.sha256(), b""
    for pieces in _runs(text, split):
        if pieces:
            got = ",".join(map(get, pieces)).encode()
            ids.update(comma)
            ids.update(got)
            each = got.split(b",")
            n += len(each)
            back.update(b"".join(map(spelled, each)))
            comma = b","
    return n, ids.hexdigest(), back.hexdigest()


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text, encoded and decoded again."""

    def run(batches):
        bpe, pieces, split = encoder(path, pattern)
        get, spelled = pieces.__getitem__, {str(r).encode(): b for r, b in bpe.bytes_of.items()}.__getitem__
        for batch in small(batches):
            n, ids, back = zip(*[_digest(text, get, spelled, split) for text in batch.column(1).to_pylist()], strict=True)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs_of(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` of every text."""

    def run(batches):
        for batch in small(batches):
            yield pa.record_batch([batch.column(0), pa.array([encode_text(x, path, pattern) for x in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs_of(docs).mapInArrow(run, "doc_id bigint, ids array<int>")

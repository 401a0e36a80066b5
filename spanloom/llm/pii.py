"""Personal data by base patterns and a semi-Markov conditional random field.

Base spans come from the four fixed patterns. The field then reads every stretch of chunks that hold
digits or an at sign, whole however long: candidate segments of up to ``LONGEST`` chunks are scored as wholes (shape, group lengths,
digit count, checks, the word before), and a dynamic program over segments, bounded by that length, chooses
boundaries and kinds jointly. Its segments of a kind are added where their posterior is at least ``SURE`` and
no base span overlaps them; base spans always stay.

The field is trained on ``SAMPLE`` different stretches of at most ``MOST`` chunks, those with the smallest hashes in the whole
corpus. Their base spans are labels; and as the base patterns leave out other public spellings of the same data, each
stretch with a phone or a card is also learned with them spelt anew - without the country code, with brackets, points,
hyphens or blanks between the groups -, so that the field finds what the patterns cannot.

Defined results: null or empty text has no spans, counts 0 and the sha256 of nothing; repeated rows give repeated
results; a null ``doc_id`` stays; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import docs_of

KINDS = ("email", "ip", "card", "phone")
SAMPLE, MOST, LONGEST, SURE, BUCKETS, EPOCHS = 3_000, 64, 6, 0.95, 1 << 13, 4
OTHER = len(KINDS)

_LOCAL = r"[A-Za-z0-9._%+-]"
_EMAIL = re.compile(_LOCAL + r"++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_START = re.compile(r"(?<![A-Za-z0-9._%+-])" + _EMAIL.pattern)
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def is_card(text: str) -> bool:
    d = _NOT_DIGIT.sub("", text)
    return 16 <= len(d) <= 19 and luhn(d)


def is_phone(text: str) -> bool:
    return 8 <= len(_NOT_DIGIT.sub("", text)) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches. A run's first character starts a match if any does, so only starts of runs are tried."""
    out, at = [], 0
    while text.find("@", at) >= 0:
        m = _EMAIL.match(text, at) or _EMAIL_START.search(text, at)
        if not m:
            break
        out.append(m.span())
        at = m.end()
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, *x) for x in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if is_ip(m[0])]
        out += [(2, *m.span()) for m in _CARD.finditer(text) if is_card(m[0])]
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if is_phone(m[0])]
    return out


# ---- the field

_CHUNK = re.compile(r"\S+")
_TRIGGER = re.compile(r"\S*[0-9@]\S*(?:[ \t]+\S*[0-9@]\S*)*")
_EDGE = ".,;:!?\"'|<>[]{}"


def stretches(text: str):
    """(chunks as (start, end), word before) for each stretch of neighbouring chunks that hold a digit or an at sign."""
    for m in _TRIGGER.finditer(text):
        chunks = []
        for c in _CHUNK.finditer(text, m.start(), m.end()):
            a, b = c.span()
            while a < b and text[a] in _EDGE:
                a += 1
            while b > a and text[b - 1] in _EDGE:
                b -= 1
            if b > a:
                chunks.append((a, b))
        if chunks:
            yield chunks, text[max(0, m.start() - 24) : m.start()].split()[-1:] or [""]


def shape(text: str) -> str:
    out = []
    for c in text if len(text) < 256 else text[:128] + text[-128:]:
        k = "9" if c.isdigit() else "a" if c.isalpha() else " " if c.isspace() else c
        if not out or out[-1] != k or k not in "9a":
            out.append(k)
    return "".join(out[:24])


def traits(text: str, start: int, end: int, chunks: int, before: str) -> list[int]:
    """Hashed features of a whole segment."""
    part = text[start:end]
    digits = _NOT_DIGIT.sub("", part)
    groups = "-".join(str(min(len(g), 20)) for g in re.findall(r"[0-9]+", part)[:7])
    has = "".join(c for c in "+()@.-_" if c in part)
    n = len(digits)
    says = [
        f"s{shape(part)}",
        f"g{groups}",
        f"n{min(n, 24)}",
        f"h{has}",
        f"c{chunks}",
        f"l{min(len(part), 60) // 3}",
        f"a{any(c.isalpha() for c in part)}{n > 0}",
        f"i{part.count('.') == 3 and is_ip(part) if re.fullmatch(r'[0-9.]+', part) else None}",
        f"u{is_card(part) if not re.search('[^0-9 .-]', part) else None}",
        f"p{before.lower()[-12:]}",
        f"x{part.count('@') == 1 and '.' in part.rpartition('@')[2]}",
        f"t{has}{min(n, 24)}",
    ]
    return [zlib.crc32(x.encode()) % BUCKETS for x in says]


class Field:
    """Weights by kind and feature, and by neighbouring kinds; kind OTHER takes single chunks."""

    def __init__(self):
        self.w = np.zeros((OTHER + 1, BUCKETS))
        self.next = np.zeros((OTHER + 2, OTHER + 1))

    def lattice(self, text: str, chunks, before: str):
        """((end, size), features) of each candidate segment, made as they are asked for."""
        for end in range(1, len(chunks) + 1):
            for size in range(1, min(LONGEST, end) + 1):
                a, b = chunks[end - size][0], chunks[end - 1][1]
                yield (end, size), traits(text, a, b, size, before if end == size else text[chunks[end - size - 1][0] : chunks[end - size - 1][1]])

    def scores(self, cells):
        out = {}
        for (end, size), f in cells:
            s = self.w[:, f].sum(1)
            if size > 1:
                s[OTHER] = -1e9
            out[end, size] = s
        return out

    def sums(self, scores, n: int):
        """Log sums forward and backward over segmentations, by the last (next) segment's kind."""
        fwd = np.full((n + 1, OTHER + 2), -1e9)
        fwd[0, OTHER + 1] = 0.0
        into = np.full((n + 1, OTHER + 1), -1e9)  # best entry: log sum over kinds before
        for end in range(n + 1):
            if end:
                parts = [into[end - size] + scores[end, size] for size in range(1, min(LONGEST, end) + 1) if (end, size) in scores]
                fwd[end, : OTHER + 1] = np.logaddexp.reduce(parts)
            into[end] = np.logaddexp.reduce(fwd[end][:, None] + self.next, axis=0)
        bwd = np.zeros((n + 1, OTHER + 2))
        for start in range(n - 1, -1, -1):
            parts = [bwd[start + size, : OTHER + 1] + scores[start + size, size] for size in range(1, min(LONGEST, n - start) + 1) if (start + size, size) in scores]
            bwd[start] = np.logaddexp.reduce(self.next + np.logaddexp.reduce(parts)[None, :], axis=1)
        return fwd, into, bwd, float(np.logaddexp.reduce(fwd[n]))

    def posteriors(self, scores, n: int):
        """Each segment's probability by kind, and how often each kind is expected after each."""
        fwd, into, bwd, total = self.sums(scores, n)
        follow = np.zeros_like(self.next)
        for start in range(n):
            after = np.logaddexp.reduce([bwd[start + size, : OTHER + 1] + scores[start + size, size] for size in range(1, min(LONGEST, n - start) + 1) if (start + size, size) in scores])
            follow += np.exp(fwd[start][:, None] + self.next + after[None, :] - total)
        return {(end, size): np.exp(into[end - size] + s + bwd[end, : OTHER + 1] - total) for (end, size), s in scores.items()}, follow

    def sure(self, scores, n: int):
        """The probability of a segment of a kind, over the whole stretch."""
        _, into, bwd, total = self.sums(scores, n)
        return lambda end, size, kind: float(np.exp(into[end - size, kind] + scores[end, size][kind] + bwd[end, kind] - total))

    def best(self, scores, n: int):
        """The best segmentation: (end, size, kind) from left to right."""
        top, back = np.full((n + 1, OTHER + 2), -1e18), {}
        top[0, OTHER + 1] = 0.0
        for end in range(1, n + 1):
            for size in range(1, min(LONGEST, end) + 1):
                if (end, size) not in scores:
                    continue
                entry = top[end - size][:, None] + self.next
                came = entry.argmax(0)
                new = entry.max(0) + scores[end, size]
                for kind in np.flatnonzero(new > top[end, : OTHER + 1]).tolist():
                    top[end, kind] = new[kind]
                    back[end, kind] = (size, int(came[kind]))
        out, end, kind = [], n, int(top[n].argmax())
        while end:
            size, came = back[end, kind]
            out.append((end, size, kind))
            end, kind = end - size, came
        return out[::-1]

    def learn(self, rows, epochs: int = EPOCHS, rate: float = 0.2, decay: float = 1e-4):
        """Stochastic gradient on the conditional log likelihood of the given segmentations."""
        ready = [(dict(self.lattice(t, c, b)), gold, len(c)) for t, c, b, gold in rows]
        order = np.random.RandomState(0)
        keep = float(np.exp(-decay * len(ready)))
        for epoch in range(epochs):
            step = rate / (1 + epoch)
            for r in order.permutation(len(ready)).tolist():
                cells, gold, n = ready[r]
                if any((end, size) not in cells for end, size, _ in gold):
                    continue
                post, follow = self.posteriors(self.scores(cells.items()), n)
                for (end, size), p in post.items():
                    np.add.at(self.w, (slice(None), cells[end, size]), -step * p[:, None])
                self.next -= 0.1 * step * follow
                before = OTHER + 1
                for end, size, kind in gold:
                    np.add.at(self.w[kind], cells[end, size], step)
                    self.next[before, kind] += 0.1 * step
                    before = kind
            self.w *= keep
        return self


def gold_of(chunks, spans):
    """The segmentation in which each base span covers whole chunks; None if one doesn't."""
    out, k = [], 0
    owner = sorted((s, e, kind) for kind, s, e in spans)
    while k < len(chunks):
        a, b = chunks[k]
        hit = next(((s, e, kind) for s, e, kind in owner if s < b and e > a), None)
        if not hit:
            out.append((k + 1, 1, OTHER))
            k += 1
            continue
        last = k
        while last + 1 < len(chunks) and chunks[last + 1][0] < hit[1]:
            last += 1
        if last - k + 1 > LONGEST or hit[0] < a or hit[1] > chunks[last][1] or chunks[last][1] - hit[1] > 0 or hit[0] > a:
            return None
        out.append((last + 1, last - k + 1, hit[2]))
        k = last + 1
    return out


#: Public spellings of ten digits of a phone and of sixteen of a card.
_PHONES = ("({}) {}-{}", "({}){}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "({}) {} {}")
_CARDS = ("{}.{}.{}.{}", "{}  {}  {}  {}")


def uncoded(kind: int, value: str) -> str | None:
    """A phone without its country code."""
    return re.sub(r"^\+[0-9]+ *", "", value) if kind == 3 else None


def spelt(kind: int, value: str) -> str | None:
    """Another spelling of a phone or a card, always the same one for the same value."""
    d = _NOT_DIGIT.sub("", value)
    pick = lambda ways: ways[zlib.crc32(d.encode()) % len(ways)]
    if kind == 3 and len(d) >= 10:
        return pick(_PHONES).format(d[-10:-7], d[-7:-4], d[-4:])
    return pick(_CARDS).format(d[:4], d[4:8], d[8:12], d[12:]) if kind == 2 and len(d) == 16 else None


def examples(text: str):
    """Segmentations to learn of each stretch: as it is, with phones uncoded, and with phones and cards spelt anew."""
    spans = base_spans(text)
    for chunks, before in stretches(text):
        a, z = chunks[0][0], chunks[-1][1]
        own = sorted((s, e, kind) for kind, s, e in spans if s < z and e > a)
        gold = gold_of(chunks, [(kind, s, e) for s, e, kind in own])
        if not gold:
            continue
        yield text, chunks, before[0], gold
        for way in (uncoded, spelt):
            out, at, moved = "", a, []
            for s, e, kind in own:
                new = way(kind, text[s:e]) or text[s:e]
                out += text[at:s]
                moved.append((kind, len(out), len(out) + len(new)))
                out, at = out + new, e
            out += text[at:z]
            if own and out != text[a:z] and all(x[1] <= y[0] for x, y in zip(own, own[1:], strict=False)):
                pieces = next(stretches(out), ([], ""))[0]
                again = gold_of(pieces, moved)
                if again:
                    yield out, pieces, before[0], again


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """A field from the ``sample`` different stretches with the smallest hashes."""
    some = docs_of(docs).where(F.col("text").rlike("[0-9@]")).select("text").mapInArrow(_smallest(sample), "h bigint, text string")
    rows = some.distinct().orderBy("h", "text").limit(sample).collect()
    return Field().learn([x for r in rows for x in examples(r.text)])


def _smallest(sample: int):
    """A task's stretches (with the word before) of the smallest hashes, each once: as many as the sample at most."""

    def run(batches):
        held: dict[str, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for chunks, _ in stretches(text):
                    if len(chunks) <= MOST and chunks[-1][1] - chunks[0][0] <= 32 * MOST:
                        piece = text[max(0, chunks[0][0] - 24) : chunks[-1][1] + 1]
                        held[piece] = zlib.crc32(piece.encode("utf-8", "surrogatepass"))
            if len(held) > 2 * sample:
                held = dict(sorted(held.items(), key=lambda x: (x[1], x[0]))[:sample])
        rows = sorted(held.items(), key=lambda x: (x[1], x[0]))[:sample]
        yield pa.record_batch([pa.array([h for _, h in rows], pa.int64()), pa.array([t for t, _ in rows], pa.string())], names=["h", "text"])

    return run


def all_spans(text: str, field: Field, base=None, memo: dict | None = None) -> list[tuple[int, int, int]]:
    base = base_spans(text) if base is None else base
    out = list(base)
    if not ("@" in text or _DIGIT.search(text)):
        return out
    for chunks, before in stretches(text):
        a, z = chunks[0][0], chunks[-1][1]
        key = (text[a:z], before[0])
        found = memo.get(key) if memo is not None else None
        if found is None:
            moved, n = [(s - a, e - a) for s, e in chunks], len(chunks)
            scores = field.scores(field.lattice(key[0], moved, key[1]))
            sure = field.sure(scores, n)
            found = [(kind, moved[end - size][0], moved[end - 1][1]) for end, size, kind in field.best(scores, n) if kind != OTHER and sure(end, size, kind) >= SURE]
            if memo is not None and len(key[0]) <= 256:
                if len(memo) > 100_000:
                    memo.clear()
                memo[key] = found
        out += [(kind, s + a, e + a) for kind, s, e in found if not any(s + a < y and x < e + a for _, x, y in base)]
    return sorted(out)


def told(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row."""
    field = field or train(docs)

    def run(batches):
        memo: dict = {}
        for batch in batches:
            counts, digest, spans = [], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                both = all_spans(text, field, base, memo)
                counts.append([sum(s[0] == k for s in both) for k in range(4)])
                digest.append(hashlib.sha256(told(base).encode()).hexdigest())
                spans.append(told(both))
            yield pa.record_batch([batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs_of(docs).mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")

"""Toxicity scores of deobfuscated text.

Noisy-channel deobfuscation: a spelling with digits or signs among letters, letters set apart, or
letters repeated three times and more spans a lattice of letters. Viterbi decoding under a
character trigram model finds the likeliest word, which replaces the spelling. The trigrams are
counted over every document. A logistic model then scores the restored text: its features are the
distinct words and word beginnings of a document, hashed; words that decide nothing get no weight.

The classifier is fitted on at most SAMPLE labelled rows (taken in order of a hash of the doc_id),
never on rows held out. Labels, languages, sources and ids are not inputs of a score.

Edge cases: null and empty texts get the score of a text without any feature; without labels, or
with labels of one class only, every score is the share of label 1 (0 without labels); labels that
are null are not used; repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

SAMPLE = 8000
THRESHOLD = 0.7
FEATURE_BITS = 20
BEGINNINGS = (4, 5, 6)
#: Restored spellings that a worker remembers; it starts anew beyond.
REMEMBERED = 1 << 16
#: Letters that a digit or sign can stand for.
READINGS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "*": "aeiou", "#": "h", "(": "c", "<": "c"}
SEPARATORS = " ._-*~'`^"
COST = {"own": 0.0, "read": -0.7, "skip": -0.4, "again": -0.1}
LETTERS = 27
#: Steps of a lattice between kept scores.
STRIDE = 512
REPEATED = re.compile(r"([a-z])\1{2,}")
U = np.uint64

_NOT_WORD = np.ones(256, bool)
_NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_SIGN = rb"0-9@$!|*+#(<"
# Each alternative starts only where its run of bytes starts, so a scan is linear in the text.
SPELLING = re.compile(
    rb"(?<![A-Za-z0-9\x80-\xff])(?:[A-Za-z@$!0-9][ ._\-*~]){3,}[A-Za-z@$!0-9](?![A-Za-z0-9\x80-\xff])"  # letters set apart
    rb"|(?:(?<![A-Za-z" + _SIGN + rb"])|(?<=[A-Za-z])(?=[" + _SIGN + rb"]))[A-Za-z" + _SIGN + rb"]*[A-Za-z][" + _SIGN + rb"]+[A-Za-z][A-Za-z" + _SIGN + rb"]*"  # signs among letters
    rb"|(?<![A-Za-z0-9\x80-\xff])[0-9@$!|(<][A-Za-z][A-Za-z" + _SIGN + rb"]*"  # a sign, then letters
    rb"|(?<![A-Za-z])[A-Za-z]*([A-Za-z])\1\1+[A-Za-z]*"  # repeated letters
    rb"|(?<![A-Za-z])[A-Za-z]+(?:[._\-*~][A-Za-z]+)+"  # signs between letters
)


def _bytes(pattern: bytes) -> np.ndarray:
    """Which bytes a character class has."""
    one = re.compile(rb"[" + pattern + rb"]")
    return np.array([bool(one.match(bytes([i]))) for i in range(256)])


_LETTER, _SIGNS, _LEAD = _bytes(rb"A-Za-z"), _bytes(_SIGN), _bytes(rb"0-9@$!|(<")
_ALONE, _JOINT, _WORDY = _bytes(rb"A-Za-z@$!0-9"), _bytes(rb" ._\-*~"), _bytes(rb"A-Za-z0-9\x80-\xff")


def candidates(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the zones (whole tokens between spaces, never across texts) in which
    SPELLING can match; outside it cannot. Byte classes decide, in a fixed number of passes."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    d = np.zeros(n + 4, np.uint8)
    d[2:-2] = data  # a zero byte belongs to no class
    letter, wordy = _LETTER[d], _WORDY[d]
    here = letter[2:-2]
    hit = np.zeros(n, bool)
    # three equal letters; a joint between letters; a leading sign before a letter
    hit |= here & (d[1:-3] == d[2:-2]) & (d[3:-1] == d[2:-2])
    hit |= _JOINT[data] & (data != 32) & letter[1:-3] & letter[3:-1]
    hit |= _LEAD[data] & ~wordy[1:-3] & letter[3:-1]
    # signs between letters
    sign = _SIGNS[data]
    begin = np.flatnonzero(sign & ~np.concatenate([[False], sign[:-1]]))
    end = np.flatnonzero(sign & ~np.concatenate([sign[1:], [False]]))
    both = letter[begin + 1] & letter[end + 3]
    hit[begin[both]] = True
    # two lone characters around one joint
    alone = _ALONE[d[2:-2]] & ~wordy[1:-3] & ~wordy[3:-1]
    two = np.flatnonzero(alone[:-2] & _JOINT[data[1:-1]] & alone[2:]) if n > 2 else np.zeros(0, np.int64)
    hit[two] = hit[two + 2] = True
    # a text's first or last byte has neighbours of another text: such a token is looked at anyway
    at = offs[:-1][np.diff(offs) > 0]
    hit[at] = True
    hit[offs[1:][np.diff(offs) > 0] - 1] = True
    at = np.flatnonzero(hit)
    blank = np.flatnonzero((data == 32) | edge[:n])
    # token: from after the last blank (or a text's start) to the next one
    k = np.searchsorted(blank, at, "right") - 1
    low = np.where(k >= 0, blank[np.maximum(k, 0)], 0)
    low = np.where((data[low] == 32) & (low < at), low + 1, low)
    high = np.append(blank, n)[np.searchsorted(blank, at, "right")]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] > high[:-1] + 1) | (edge[low[1:]] & (low[1:] != low[:-1]))
    first = np.flatnonzero(new)
    return low[first], np.maximum.reduceat(high, first) if len(first) else high


def letter_codes() -> np.ndarray:
    code = np.zeros(256, np.int64)
    code[97:123] = np.arange(1, 27)
    code[65:91] = np.arange(1, 27)
    return code


def trigram_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) over letters and the word edge (0), from all documents."""

    def count(batches):
        code = letter_codes()
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            data, offs = K.strings(batch.column("text"))
            for lo, hi in K.chunks(offs):
                c = code[data[offs[lo] : offs[hi]]]
                c = np.concatenate([[0, 0], c, [0, 0]])
                total += np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=len(total))
        i = np.flatnonzero(total)
        if len(i):
            yield pa.RecordBatch.from_pydict({"gram": i.astype(np.int32), "n": total[i]})

    rows = docs.select("text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    n = np.zeros(LETTERS**3)
    for r in rows.collect():  # 27**3 rows at most
        n[r.gram] = r.n
    n = n.reshape(LETTERS, LETTERS, LETTERS)
    n[0, 0, 0] = 0
    pair = n.sum(0)
    back = (pair + 0.5) / (pair + 0.5).sum(1, keepdims=True)
    return np.log((n + 8 * back[None]) / (n.sum(2, keepdims=True) + 8))


def _arcs(low: str, i: int) -> list[tuple[int, float]]:
    """What the character at ``i`` can stand for: letters (0: nothing) and their costs."""
    ch, same = low[i], i > 0 and low[i - 1] == low[i]
    if "a" <= ch <= "z":
        return [(ord(ch) - 96, COST["again"]), (0, COST["own"])] if same else [(ord(ch) - 96, COST["own"])]
    arcs = [(ord(x) - 96, COST["read"]) for x in READINGS.get(ch, "")]
    if ch in SEPARATORS or not arcs or same:
        arcs.append((0, COST["skip"]))
    return arcs


def _step(score: dict[int, float], arcs: list[tuple[int, float]], model: list[float], came: dict[int, tuple[int, int]]) -> dict[int, float]:
    """One Viterbi step over the live states (last two letters); ``came`` takes the way back."""
    best: dict[int, float] = {}
    for letter, cost in arcs:
        for s, v in score.items():
            to = s % LETTERS * LETTERS + letter if letter else s
            w = v + cost + (model[s * LETTERS + letter] if letter else 0.0)
            if to not in best or w > best[to]:
                best[to] = w
                came[to] = (s, letter)
    return best


def _viterbi(low: str, begin: int, end: int, state: int, model: list[float], last: bool) -> str:
    """The likeliest letters of the lattice of ``low[begin:end]`` from a state; ``last``: the word ends
    with it. Scores are kept at every STRIDE-th step only and the steps between made again on the
    way back, so memory grows with a small part of the length."""
    score = {state: 0.0}
    kept = []
    for i in range(begin, end):
        if (i - begin) % STRIDE == 0:
            kept.append(score)
        score = _step(score, _arcs(low, i), model, {})
    at = max(sorted(score), key=lambda s: score[s] + (model[s * LETTERS] if last else 0.0))
    out = []
    for block in range(len(kept) - 1, -1, -1):
        score, ways = kept[block], []
        first = begin + block * STRIDE
        for i in range(first, min(end, first + STRIDE)):
            ways.append({})
            score = _step(score, _arcs(low, i), model, ways[-1])
        for came in reversed(ways):
            at, letter = came[at]
            if letter:
                out.append(chr(96 + letter))
    return "".join(reversed(out))


def decode(spelling: str, model: np.ndarray) -> str:
    """The likeliest word for a spelling, by Viterbi decoding over states (last two letters).

    Of a letter repeated more than twice only two change a state, so the rest is left out first. Two
    plain letters in a row leave one state alive; there the lattice falls apart into pieces
    that are decoded one by one, with the same result."""
    low = REPEATED.sub(r"\1\1", spelling.lower())
    flat = model.ravel().tolist() if isinstance(model, np.ndarray) else model
    plain = [("a" <= ch <= "z") and (i == 0 or low[i - 1] != ch) for i, ch in enumerate(low)]
    out: list[str] = []
    state = begun = 0
    for i, ch in enumerate(low):
        if plain[i] and (i == 0 or plain[i - 1]):
            out.append(ch if i == begun else _viterbi(low, begun, i + 1, state, flat, False))
            state, begun = (ord(low[i - 1]) - 96 if i else 0) * LETTERS + ord(ch) - 96, i + 1
    if begun < len(low):
        out.append(_viterbi(low, begun, len(low), state, flat, True))
    return "".join(out)


class Restorer:
    """Replaces obfuscated spellings in texts; remembers what it has decoded."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = model.ravel().tolist(), {}

    def word(self, m: re.Match) -> bytes:
        raw = m.group()
        if raw not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[raw] = decode(raw.decode("ascii"), self.model).encode()
        return self.known[raw]

    def texts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        out, at, grown = [], 0, np.zeros(len(offs), np.int64)
        starts, ends = candidates(data, offs)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            new = SPELLING.sub(self.word, raw[a:b])
            if len(new) != b - a or new != raw[a:b]:
                out += [raw[at:a], new]
                at = b
                grown[np.searchsorted(offs, a, "right")] += len(new) - (b - a)
        out.append(raw[at:])
        return np.frombuffer(b"".join(out), np.uint8), offs + np.cumsum(grown)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word and word beginning; pairs may repeat."""
    low = K.LOWER[data]
    starts, ends, first = K.words(low, offs, _NOT_WORD)
    pre = K.prefix(low)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    found = [(text, K.span_hash(pre, starts, ends))]
    for n in BEGINNINGS:
        far = ends - starts > n
        found.append((text[far], K.span_hash(pre, starts[far], starts[far] + n) ^ U(n)))
    return np.concatenate([t for t, _ in found]), (np.concatenate([h for _, h in found]) >> U(64 - FEATURE_BITS)).astype(np.int64)


def fit(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Weights of all hashed features and the bias, from (distinct features, label) rows."""
    w = np.zeros(1 << FEATURE_BITS, np.float32)
    y = np.array([label for _, label in rows], float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return w, -30.0 if share <= 0 else 30.0
    size = np.array([len(x) for x, _ in rows])
    doc, feat = np.repeat(np.arange(len(y)), size), np.concatenate([x for x, _ in rows])
    n1 = np.bincount(feat, weights=y[doc], minlength=len(w))
    n = np.bincount(feat, minlength=len(w))
    p = y.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        z = (n1 - n * p) / np.sqrt(np.maximum(n * p * (1 - p), 1e-9))
    chosen = np.flatnonzero((n >= 4) & (z > 4.5))
    if not len(chosen):
        return w, float(np.log(p / (1 - p)))
    index = np.full(len(w), -1)
    index[chosen] = np.arange(len(chosen))
    keep = index[feat] >= 0
    doc, col = doc[keep], index[feat[keep]]
    beta = np.zeros(len(chosen))
    bias = np.log(p / (1 - p))
    m, v, mb, vb = np.zeros_like(beta), np.zeros_like(beta), 0.0, 0.0
    for t in range(1, 301):
        s = bias + np.bincount(doc, weights=beta[col], minlength=len(y))
        err = 1 / (1 + np.exp(-s)) - y
        g = np.bincount(col, weights=err[doc], minlength=len(beta)) / len(y) + 2e-5 * beta
        gb = err.mean()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        beta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        bias -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    w[chosen] = beta
    return w, float(bias)


def held_out():
    """Rows that the classifier never learns from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text and others) with held_out, score and predicted."""
    spark = docs.sparkSession
    model = trigram_model(docs)
    lm = spark.sparkContext.broadcast(model)

    def sets(batches):
        restorer = Restorer(lm.value)
        for batch in batches:
            data, offs = K.strings(batch.column("text"))
            out = []
            for lo, hi in K.chunks(offs):
                d, o = restorer.texts(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                text, feat = features(d, o)
                both = np.unique(text << FEATURE_BITS | feat)
                cut = np.searchsorted(both, np.arange(hi - lo + 1) << FEATURE_BITS)
                feat = (both & ((1 << FEATURE_BITS) - 1)).astype(np.int32)
                out += [feat[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"features": pa.array(out, pa.binary()), "toxic": batch.column("toxic")})

    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    some = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "toxic").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "toxic").mapInArrow(sets, "features binary, toxic int").collect()
    weights, bias = fit([(np.frombuffer(r.features, np.int32), r.toxic) for r in rows])
    shared = spark.sparkContext.broadcast((weights, bias))
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    rows = docs.select(*kept, held_out().alias("held_out"))
    names = rows.columns
    at = names.index("text")

    def apply(batches):
        restorer = Restorer(lm.value)
        w, b = shared.value
        for batch in batches:
            data, offs = K.strings(batch.column(at))
            total = np.zeros(len(offs) - 1)
            for lo, hi in K.chunks(offs):
                d, o = restorer.texts(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                text, feat = features(d, o)
                decides = w[feat] != 0
                both = np.unique(text[decides] << FEATURE_BITS | feat[decides])
                total[lo:hi] = np.bincount(both >> FEATURE_BITS, weights=w[both & ((1 << FEATURE_BITS) - 1)], minlength=hi - lo)
            p = 1 / (1 + np.exp(-np.clip(total + b, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(apply, f"{schema}, score double, predicted int")

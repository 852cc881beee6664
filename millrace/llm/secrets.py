"""Secret scans: fixed patterns, and a linear-chain conditional random field that finds what they miss."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Shared
from .arrow import bounded_batches, extend
from .sampling import distinct_texts

KINDS = ("assign", "access", "hex")
FOUND = "crf"  # the kind of spans the field adds
MASK = "[SECRET]"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
# Words that announce a secret, alone or as a part of a name. Features, and together with a value a weak label.
HINTS = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "api_?key", "key", "auth", "credential",
         "bearer", "private")
HINT = re.compile(rf"(?:^|[_.\-])({'|'.join(HINTS)})s?(?:$|[_.\-])")
NEAR = 4  # tokens before a value in which a hint announces it
# Values that are secrets by their form: long hex of either case, signed tokens, a short name and a long random part.
FORM = re.compile(r"[0-9A-Fa-f]{32,}|eyJ[\w-]{8,}(?:\.[\w-]{4,}){1,2}|[A-Za-z]{2,6}[_-][A-Za-z0-9_-]{20,}")

OUT, BEGIN, INSIDE = 0, 1, 2
DIMENSIONS = 1 << 18
# A token is a mark that stands between names and values, or a run of anything else but white space.
TOKEN = re.compile(r"""["'`,;:=(){}\[\]<>|]|[^\s"'`,;:=(){}\[\]<>|]+""")
EDGE = "\"'`.,;:!?()[]{}<>#$%&*|"
SHAPE = str.maketrans({**{c: "a" for c in "bcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "BCDEFGHIJKLMNOPQRSTUVWXYZ"},
                       **{c: "0" for c in "123456789"}})
RUNS = re.compile(r"(.)\1+")
HEX_DIGITS = frozenset("0123456789abcdefABCDEF")
WORDS_KNOWN = 400_000  # words whose scores a task keeps

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                     T.StructField("end", T.LongType())])
FIELDS = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("spans", T.ArrayType(SPAN))]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns, in that order. A cheap search rules most texts out first."""
    found = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % DIMENSIONS


def _name(core: str, low: str) -> bool:
    return len(core) <= 12 and core.isalpha()


def _coarse(word: str, core: str, low: str, shape: str, names: frozenset[str]) -> str:
    if not core:
        return word[:3]
    if _name(core, low):
        return low if low in names else "a rare word"
    return f"{shape[:4]}~{min(len(core) // 8, 4)}"


def word_features(word: str, known: frozenset[str]) -> tuple[list[int], int, int, int]:
    """Feature slots of a whole token itself, and the one slot it gives its successor, its predecessor, and itself behind
    a hint.

    A short word is itself if it is `known`, and a rare word otherwise.
    """
    core = word.strip(EDGE)
    low = core.lower()
    shape = RUNS.sub(r"\1", core.translate(SHAPE))
    around = _coarse(word, core, low, shape, known)
    n = max(1, len(core))
    names = ["bias", "shape " + shape if len(shape) <= 6 else f"turns {10 * len(shape) // n}", f"length {min(len(core), 48) // 4}",
             f"variety {10 * len(set(core)) // n} {min(n // 8, 4)}", "word " + around]
    digits = sum(c.isdigit() for c in core)
    kind = "plain"
    if digits:
        names.append(f"digits {4 * digits // n} {min(n // 8, 4)}")
        kind = "digits" if digits == n else f"some digits {min(n // 4, 4)}"
        if not core.islower() and not core.isupper() and not core.isdigit():
            names.append(f"mixed {min(n // 8, 4)}")
    if n >= 8 and HEX_DIGITS.issuperset(core):
        names.append(f"hex {min(n // 8, 4)}")
    if FORM.fullmatch(core):
        names.append("form")
    if not word[0].isalnum():
        names.append("opens " + word[0])
    if not word[-1].isalnum():
        names.append("closes " + word[-1])
    hint = HINT.search(low)
    if hint:
        names.append("hint " + hint[1])
    return [_slot(x) for x in names], _slot("after " + around), _slot("before " + around), _slot("hinted " + kind)


def file_features(text: str) -> list[int]:
    """Feature slots of a whole text."""
    low = text.lower()
    names = [f"file size {min(len(text).bit_length(), 20)}", f"file code {('{' in text) + (';' in text)}",
             f"file pairs {min((text.count('=') + 1).bit_length(), 5)}"]
    names += ["file hint " + h for h in ("password", "secret", "token", "key") if h in low]
    return [_slot(x) for x in names]


@dataclass
class Field:
    """Weights by feature slot and tag, and by pair of neighbouring tags (row: the earlier; last row: the start)."""

    weights: np.ndarray
    moves: np.ndarray
    known: frozenset[str]


DOUBT = -1  # a token that may be a secret or not: no example


def _entropy(core: str) -> float:
    n = len(core)
    return -sum(k / n * math.log2(k / n) for k in Counter(core).values())


def weak_tag(core: str, hinted: bool) -> int:
    """BEGIN for a token that weak rules take for a secret, DOUBT for one that they cannot decide, else OUT."""
    n = len(core)
    if n < 8 or "@" in core or "/" in core and "." in core:
        return OUT
    digits, letters = sum(c.isdigit() for c in core), sum(c.isalpha() for c in core)
    mixed = digits and letters and len(set(core)) >= 6
    if FORM.fullmatch(core) and mixed and _entropy(core) >= 2.5:
        return BEGIN
    if hinted and mixed and _entropy(core) >= 2.5:
        return BEGIN
    random = n >= 20 and mixed and _entropy(core) >= 3.5
    return DOUBT if random or hinted and (digits or not core.isalpha()) else OUT


def _line_tags(line: str, at: int, spans: list) -> tuple[list[str], list[int]]:
    """Tokens of a line and their tags: the values of fixed-pattern spans, and what weak rules say of the others."""
    words, tags = [], []
    values = [(m.start(2) + at, m.end(2) + at) for m in ASSIGN.finditer(line)]
    spans = [(next((v for v in values if start <= v[0] and v[1] == end), (start, end)), (start, end)) for start, _, end in spans]
    hint = -NEAR - 1
    for m in TOKEN.finditer(line):
        lo, hi, k = at + m.start(), at + m.end(), len(words)
        tag = None
        for value, whole in spans:
            if lo < value[1] and hi > value[0]:
                tag = INSIDE if tags and lo > value[0] and tags[-1] in (BEGIN, INSIDE) else BEGIN
            elif lo < whole[1] and hi > whole[0]:
                tag = OUT
        core = m.group().strip(EDGE)
        words.append(m.group())
        tags.append(weak_tag(core, k - hint <= NEAR) if tag is None else tag)
        if HINT.search(core.lower()):
            hint = k
    return words, tags


def training_windows(docs: DataFrame, text_col: str = "text", reach: int = 10, per_text: int = 8,
                     plain: int = 2) -> DataFrame:
    """Windows of tagged tokens: around secrets by the fixed patterns and the weak rules, and up to `plain` around other
    tokens with a digit. Windows with a doubtful token are left out.

    At most `per_text` windows come from a text; they are training examples, not results.
    """
    rows = bounded_batches(docs).select(F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(0).to_pylist():
                spans, own, rest, at = base_spans(text), [], [], 0
                facts = file_features(text)
                for line in text.split("\n"):
                    near = [s for s in spans if s[0] < at + len(line) and s[2] > at]
                    if near or any(c.isdigit() for c in line) or not rest:
                        words, tags = _line_tags(line, at, near)
                        hits = [i for i, t in enumerate(tags) if t == BEGIN]
                        for k in hits or [next((i for i, w in enumerate(words) if any(c.isdigit() for c in w)), 0)]:
                            cut = slice(max(0, k - reach), k + reach)
                            if words and DOUBT not in tags[cut]:
                                (own if hits else rest).append((words[cut], tags[cut], facts))
                    at += len(line) + 1
                # The plainest line and, from the end, those with digits: hard negatives.
                out += (own + rest[:1] + rest[1:][::-1][:plain - 1])[:per_text]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in out], kind) for k, kind in
                 enumerate((pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())))],
                names=["words", "tags", "facts"])

    return rows.mapInArrow(run, "words array<string>, tags array<int>, facts array<long>")


def fit(examples: list[tuple[list[str], list[int], list[int]]], rounds: int = 60, rate: float = 0.2,
        ridge: float = 1e-4) -> Field | None:
    """Maximum likelihood by full-batch Adam; all sequences advance together. None without a tagged example."""
    if not any(any(tags) for _, tags, _ in examples):
        return None
    n, length = len(examples), max(len(w) for w, _, _ in examples)
    gold = np.full((n, length), -1)
    slot, place = [], []
    uses = Counter(w.strip(EDGE).lower() for words, _, _ in examples for w in words)
    names = frozenset(w for w, k in uses.items() if k >= 3 and _name(w, w))
    known: dict[str, tuple] = {}
    for i, (words, tags, facts) in enumerate(examples):
        gold[i, :len(tags)] = tags
        feats = [known.get(w) or known.setdefault(w, word_features(w, names)) for w in words]
        hints = [t for t, w in enumerate(words) if HINT.search(w.strip(EDGE).lower())]
        for t, (own, _, _, hinted) in enumerate(feats):
            found = own + facts
            if any(t - NEAR <= h < t for h in hints):
                found = [*found, hinted]
            if t:
                found = [*found, feats[t - 1][1]]
            if t + 1 < len(feats):
                found = [*found, feats[t + 1][2]]
            slot += found
            place += [i * length + t] * len(found)
    used, slot = np.unique(np.array(slot), return_inverse=True)
    place = np.array(place)
    mask = gold >= 0
    last = mask.sum(1) - 1
    seen = np.zeros((len(used), 3))
    for tag in range(3):
        seen[:, tag] = np.bincount(slot, (gold.ravel()[place] == tag), len(used))
    moved = np.zeros((4, 3))
    np.add.at(moved, (np.where(np.arange(length) > 0, np.roll(gold, 1, 1), 3)[mask], gold[mask]), 1)
    w, a = np.zeros((len(used), 3)), np.zeros((4, 3))
    moments = [np.zeros_like(x) for x in (w, w, a, a)]
    for step in range(1, rounds + 1):
        emit = np.stack([np.bincount(place, w[slot, tag], n * length) for tag in range(3)], 1).reshape(n, length, 3)
        ahead, back = np.zeros((n, length, 3)), np.zeros((n, length, 3))
        ahead[:, 0] = emit[:, 0] + a[3]
        for t in range(1, length):
            ahead[:, t] = emit[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + a[None, :3], axis=1)
        for t in range(length - 2, -1, -1):
            onward = np.logaddexp.reduce(a[None, :3] + (emit[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            back[:, t] = np.where((t < last)[:, None], onward, 0.0)
        total = np.logaddexp.reduce(ahead[np.arange(n), last], axis=1)
        chance = np.exp(ahead + back - total[:, None, None]) * mask[:, :, None]
        expected = np.zeros_like(w)
        flat = chance.reshape(-1, 3)
        for tag in range(3):
            expected[:, tag] = np.bincount(slot, flat[place, tag], len(used))
        moves = np.zeros_like(a)
        moves[3] = chance[:, 0].sum(0)
        for t in range(1, length):
            live = mask[:, t]
            joint = ahead[live, t - 1, :, None] + a[None, :3] + (emit[live, t] + back[live, t])[:, None, :]
            moves[:3] += np.exp(joint - total[live, None, None]).sum(0)
        for k, (x, grad) in enumerate(((w, (expected - seen) / n + ridge * w), (a, (moves - moved) / n + ridge * a))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros((DIMENSIONS, 3), np.float32)
    weights[used] = w
    return Field(weights, a.astype(np.float32), names)


def learn(docs: DataFrame, text_col: str = "text", sample_docs: int = 20_000, plain_windows: int = 3000,
          tagged_windows: int = 6000) -> Field | None:
    """Fit on `sample_docs` distinct texts, or all where there are fewer, tagged by the fixed patterns and weak rules.

    Up to `tagged_windows` tagged windows are examples, and up to `plain_windows` of the others, drawn by hash in the tasks'
    output, so that the bound holds for the driver. Null and empty texts give nothing; None without a tagged window.
    Copies count once. Columns other than `text_col` are not read, whatever their names.
    """
    found = training_windows(distinct_texts(docs, sample_docs, text_col), "text")
    found = found.withColumn("hit", F.exists("tags", lambda t: t > 0)).withColumn("draw", F.xxhash64("words"))
    some = [found.filter("hit").orderBy("draw", "words").limit(tagged_windows),
            found.filter("not hit").orderBy("draw", "words").limit(plain_windows)]
    rows = some[0].unionByName(some[1]).toPandas()
    return fit(sorted((list(w), list(t), list(f)) for w, t, f in zip(rows["words"], rows["tags"], rows["facts"], strict=True)))


class WordScores(dict):
    """Token to the row of `scores` that holds its own score, what it gives the next and the previous token, and what it
    has more behind a hint; `hints` tells which rows are hints.

    Rare plain words that look alike have the same features, so they share a row found by a cheap key.
    """

    def __init__(self, field: Field):
        self.field = field
        self.alike: dict[tuple, int] = {}
        self.scores = np.zeros((1024, 4, 3), np.float32)
        self.hints = np.zeros(1024, bool)
        self.rows = 0

    def __missing__(self, word: str) -> int:
        tail = word[-1] if word[-1] in ".," else ""
        core = word[:-1] if tail else word
        low = core.lower()
        plain = (core.isalpha() and len(low) == len(core) and core[1:] == low[1:] and not HINT.search(low)
                 and not (len(core) <= 12 and low in self.field.known) and len(core) <= 48)
        if plain:
            key = (core[0] == low[0], tail, core.isascii() and len(core) >= 8 and HEX_DIGITS.issuperset(core),
                   len(core), len(set(core)), core.translate(SHAPE)[:40] if not core.isascii() else "")
            row = self.alike.get(key)
            if row is None:
                row = self.alike[key] = self._score(word)
        else:
            row = self._score(word)
        self[word] = row
        return row

    def _score(self, word: str) -> int:
        at, w = self.rows, self.field.weights
        if at == len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.hints = np.concatenate([self.hints, np.zeros_like(self.hints)])
        own, *others = word_features(word, self.field.known)
        self.scores[at, 0] = w[own].sum(0)
        self.scores[at, 1:] = w[others]
        self.hints[at] = HINT.search(word.strip(EDGE).lower()) is not None
        self.rows += 1
        return at


class Tagger:
    """Viterbi over all lines of a batch at once."""

    def __init__(self, field: Field):
        self.field = field
        self.number = WordScores(field)

    def tags(self, lines: list[list[str]], facts: list[int], texts: list[list[int]]) -> list[np.ndarray]:
        """Best tags per line of tokens; `facts[i]` names the text of line i, `texts` the file features by text."""
        if len(self.number) > WORDS_KNOWN:
            self.number = WordScores(self.field)
        size = np.array([len(x) for x in lines], np.int64)
        order = np.argsort(-size, kind="stable")
        start = np.cumsum(size) - size
        number = self.number
        word = np.array(list(map(number.__getitem__, chain.from_iterable(lines))), np.int64)
        scores = number.scores
        emit = scores[word, 0]
        first, final = np.zeros(len(word), bool), np.zeros(len(word), bool)
        first[start[size > 0]] = True
        final[(start + size - 1)[size > 0]] = True
        emit[1:] += np.where(first[1:, None], 0, scores[word[:-1], 1])
        emit[:-1] += np.where(final[:-1, None], 0, scores[word[1:], 2])
        place = np.arange(len(word))
        hint = np.maximum.accumulate(np.where(number.hints[word], place, -1)) if len(word) else place
        hint = np.concatenate([[-1], hint[:-1]])[:len(word)]  # the last hint before a token
        announced = (hint >= np.repeat(start, size)) & (place - hint <= NEAR)
        emit[announced] += scores[word[announced], 3]
        by_text = np.stack([self.field.weights[f].sum(0) for f in texts])
        emit += np.repeat(by_text[np.array(facts, np.int64)], size, axis=0)
        live = np.searchsorted(-size[order], -np.arange(size.max(initial=0)))  # lines longer than t
        a = self.field.moves
        best = np.zeros((len(lines), 3), np.float32)
        came = np.zeros((len(word), 3), np.int8)
        for t, n in enumerate(live):
            at = start[order[:n]] + t
            if t == 0:
                best[:n] = emit[at] + a[3]
            else:
                paths = best[:n, :, None] + a[None, :3]
                came[at] = paths.argmax(1)
                best[:n] = paths.max(1) + emit[at]
        tags = np.zeros(len(word), np.int8)
        state = best.argmax(1)
        for t in range(len(live) - 1, -1, -1):
            n = live[t]
            at = start[order[:n]] + t
            tags[at] = state[:n]
            state[:n] = came[at, state[:n]]
        return np.split(tags, np.cumsum(size)[:-1])


def field_spans(line: str, at: int, tags: np.ndarray) -> list[tuple[int, int]]:
    """Code point spans of the tagged runs of a line, without surrounding marks."""
    out: list[list[int]] = []
    for k, m in enumerate(TOKEN.finditer(line)):
        if tags[k] == BEGIN or tags[k] == INSIDE and (k == 0 or tags[k - 1] == OUT):
            out.append([m.start(), m.end()])
        elif tags[k] == INSIDE:
            out[-1][1] = m.end()
    spans = []
    for lo, hi in out:
        piece = line[lo:hi]
        lo += len(piece) - len(piece.lstrip(EDGE))
        hi -= len(piece) - len(piece.rstrip(EDGE))
        if hi > lo:
            spans.append((at + lo, at + hi))
    return spans


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, field: Field | None, keep: Sequence[str] | None = None, text_col: str = "text",
         redact: bool = False) -> DataFrame:
    """`row` (struct of the `keep` columns), n_assign, n_access, n_hex, spans; with `redact` also `redacted`.

    `spans` holds (kind, start, end) in code points, end exclusive, by start and then kind: the fixed patterns' matches
    and, as kind `crf`, what the field tags beside them (tagged runs that overlap a fixed span are left out). The field
    tags lines; a line is decoded exactly, however long. `redacted` is the text with every span replaced by MASK.

    Null text counts as empty and stays null in `redacted`. Without a field only the fixed patterns are found. Repeated
    rows are scanned alike. An empty table gives an empty result.
    """
    sent = None if field is None else Shared(docs.sparkSession, field)
    fields = [*FIELDS, *([T.StructField("redacted", T.StringType())] if redact else [])]
    names = [*KINDS, FOUND]

    def make():
        tagger = None if sent is None else Tagger(sent.value)

        def find(batch: pa.RecordBatch) -> list:
            texts = batch.column(1).to_pylist()
            spans = [base_spans(t or "") for t in texts]
            counts = [[sum(s[1] == k for s in own) for own in spans] for k in range(len(KINDS))]
            if tagger is not None:
                lines, home, where = [], [], []
                for k, text in enumerate(texts):
                    at = 0
                    for line in (text or "").split("\n"):
                        lines.append(line)
                        home.append(k)
                        where.append(at)
                        at += len(line) + 1
                tags = tagger.tags([TOKEN.findall(x) for x in lines], home, [file_features(t or "") for t in texts])
                for line, k, at, own in zip(lines, home, where, tags, strict=True):
                    if own.any():
                        fixed = [s for s in spans[k] if s[1] < len(KINDS)]
                        spans[k] += [(lo, len(KINDS), hi) for lo, hi in field_spans(line, at, own)
                                     if not any(lo < s[2] and hi > s[0] for s in fixed)]
                spans = [sorted(own) for own in spans]
            found = [[{"kind": names[k], "start": lo, "end": hi} for lo, k, hi in own] for own in spans]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            out = [*(pa.array(c, pa.int64()) for c in counts), pa.array(found, kind)]
            if redact:
                out.append(pa.array([None if t is None else masked(t, own) for t, own in zip(texts, spans, strict=True)],
                                    pa.string()))
            return out

        return find

    return extend(docs, keep, [F.col(text_col).alias("text")], fields, make)

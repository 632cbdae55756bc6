"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes (operator 2)."""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tempofuse.llm.common import Texts, chunks, prefix_hash, span_hash, splitmix

KINDS = ("email", "ip", "card", "phone")
#: O, then beginning and inside of each kind.
LABELS = 1 + 2 * len(KINDS)
BITS = 12
#: Features of a word.
FEATURES = 4
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(rb"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = bytes(i for i in range(256) if not 48 <= i <= 57)


def luhn(digits: bytes) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d -= 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: bytes, at_sign: bool = True, digit: bool = True) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes, of the fixed patterns; leftmost and non-overlapping within a kind."""
    found = []
    end = 0
    at = text.find(b"@") if at_sign else -1
    while at >= 0:
        start = at  # the local part goes back to what cannot be in it, or to the match before
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end(), 0))
            end = m.end()
        at = text.find(b"@", max(at + 1, end))
    if digit:
        for m in _IP.finditer(text):
            if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in m[0].split(b".")):
                found.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            if 12 <= len(d := m[0].translate(None, _NOT_DIGIT)) <= 19 and luhn(d):
                found.append((m.start(), m.end(), 2))
        for m in _PHONE.finditer(text):
            if 9 <= len(m[0].translate(None, _NOT_DIGIT)) <= 15:
                found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


# --- word shapes -----------------------------------------------------------------------------------------------

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 65, 97, 48, 97


def shapes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word's shape: letters and digits by class, a run of letters once, of digits up to four times."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    c, place = _CLASS[buf], np.arange(len(buf))
    new = np.ones(len(buf), dtype=bool)
    new[1:] = c[1:] != c[:-1]
    new[start] = True
    run = place - np.maximum.accumulate(np.where(new, place, 0))
    kept = np.flatnonzero(new | ((c == 48) & (run < 4)))
    prefix = prefix_hash(c[kept])
    return span_hash(prefix, np.searchsorted(kept, start), np.searchsorted(kept, end))


def _luhn_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """Whether each word has 12 to 19 digits that pass Luhn's test."""
    out = np.zeros(len(start), dtype=bool)
    for w in np.flatnonzero((digits >= 12) & (digits <= 19)).tolist():
        out[w] = luhn(buf[start[w] : end[w]].tobytes().translate(None, _NOT_DIGIT))
    return out


def token_features(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Buckets of each word's own features, (words, FEATURES): shape; number of digits, Luhn's test and last byte;
    beginning with length and marks; whether it has digits and which marks."""
    digits = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum((buf >= 48) & (buf <= 57), out=digits[1:])
    count = digits[end] - digits[start]
    n = (np.minimum(count, 20) + 32 * _luhn_words(buf, start, end, count)).astype(np.uint64)
    first, last = _CLASS[buf[start]].astype(np.uint64), _CLASS[buf[end - 1]].astype(np.uint64)
    size = np.minimum(end - start, 24).astype(np.uint64)
    marks = np.minimum(count, 1).astype(np.uint64)
    for k, c in enumerate(b"@=[("):
        run = np.zeros(len(buf) + 1, dtype=np.int64)
        np.cumsum(buf == c, out=run[1:])
        has = (run[end] > run[start]).astype(np.uint64)
        size += has << np.uint64(40 + k)
        marks += has << np.uint64(1 + k)
    own = [shapes(buf, start, end), splitmix(n * np.uint64(256) + last + np.uint64(1 << 20)), splitmix(first * np.uint64(64) + size + np.uint64(1 << 21)), splitmix(marks + np.uint64(1 << 22))]
    return np.stack([(h >> np.uint64(64 - BITS)).astype(np.int64) for h in own], axis=1)


def sentences(t: Texts, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Places of the words that begin a sentence: after another text, a line break, or a word that ends in a stop."""
    new = np.ones(len(start), dtype=bool)
    breaks = np.zeros(len(t.buf) + 1, dtype=np.int32)
    np.cumsum(t.buf == 10, out=breaks[1:])
    new[1:] = (row[1:] != row[:-1]) | (breaks[start[1:]] > breaks[end[:-1]]) | np.isin(t.buf[end[:-1] - 1], np.frombuffer(b".!?", np.uint8))
    return np.flatnonzero(new)


@dataclass
class Field:
    """emit: (3 offsets, FEATURES, buckets, labels); move: (labels, labels)."""

    emit: np.ndarray
    move: np.ndarray

    def scores(self, feats: np.ndarray) -> np.ndarray:
        """(sequences, steps, labels) of features (sequences, steps, FEATURES); bucket -1 is no word."""
        padded = np.pad(feats, ((0, 0), (1, 1), (0, 0)), constant_values=-1)
        out = np.zeros((*feats.shape[:2], LABELS))
        for offset in range(3):
            near = padded[:, offset : offset + feats.shape[1]]
            for f in range(FEATURES):
                b = near[:, :, f]
                out += np.where((b >= 0)[:, :, None], self.emit[offset, f][b], 0.0)
        return out

    def word_scores(self, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(words, labels), as scores(), of words in a row; first is where sequences begin."""
        before, own, after = (sum(self.emit[offset, f][feats[:, f]] for f in range(FEATURES)) for offset in range(3))
        new = np.zeros(len(feats) + 1, dtype=bool)
        new[first] = new[-1] = True
        own[1:] += np.where(new[1:-1, None], 0, before[:-1])
        own[:-1] += np.where(new[1:-1, None], 0, after[1:])
        return own

    def decode(self, s: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Labels of the best path of each sequence (Viterbi) of scores s (sequences, steps, labels), over a whole batch
        at each step."""
        n, steps, _ = s.shape
        move = (self.move + _ALLOWED).astype(s.dtype)
        own = np.ascontiguousarray(s.transpose(1, 2, 0))
        best = np.empty((steps, LABELS, n), dtype=s.dtype)
        best[0] = own[0] + _START.astype(s.dtype)[:, None]
        for t in range(1, steps):
            np.max(best[t - 1][:, None, :] + move[:, :, None], axis=0, out=best[t])
            best[t] += own[t]
        label, each = np.zeros((n, steps), dtype=np.int8), np.arange(n)
        now = best[size - 1, :, each].argmax(1)
        for t in range(steps - 1, -1, -1):
            live = size > t
            label[live, t] = now[live]
            if t:
                now = np.where(live, (best[t - 1] + move[:, now]).argmax(0), now)
        return label


_ALLOWED = np.zeros((LABELS, LABELS))
for _k in range(len(KINDS)):  # an inside follows its beginning or itself
    _ALLOWED[:, 2 + 2 * _k] = -1e9
    _ALLOWED[1 + 2 * _k, 2 + 2 * _k] = _ALLOWED[2 + 2 * _k, 2 + 2 * _k] = 0
_START = np.array([0.0] + [0.0, -1e9] * len(KINDS))


def labelled_table(rows: int = 500, seed: int = 5) -> list[list[tuple[str, int]]]:
    """The small labelled table: sentences as (word, label), drawn from templates by a fixed seed. As many again are
    sentences without personal data, of words with all kinds of signs about them."""
    r = random.Random(seed)
    syllables = "an ber co da el fi ga ho in jo ka lu mi no or pe qui ra so ti un vo we xa yo zu é ñ ü ç".split()

    def word():
        w = "".join(r.choices(syllables, k=r.randint(1, 4)))
        w = w.capitalize() if r.random() < 0.15 else w
        return w + (r.choice(".,;:") if r.random() < 0.12 else "")

    def noise():
        mark = r.choice("!#$%&*+-/:;<=>?^_|~()[]{}\"'.,") * r.choice([1, 1, 2, 3])
        return r.choice([word() + mark, word().strip(".,;:") + mark, mark, mark + word(), word() + mark + word(), word().upper(), d(r.randint(1, 9)) + mark, no_card()[0] + mark])

    def d(n):
        return "".join(r.choices("0123456789", k=n))

    def name():
        return r.choice([word().strip(".,;:"), word().strip(".,;:") + "." + d(2), word().strip(".,;:") + "_" + word().strip(".,;:")])

    def domain():
        return r.choice(["mail", "post", "web", "corp"]) + d(r.randint(0, 1)) + "." + r.choice(["example.com", "test.org", "host.net"])

    def email():
        at = r.choice(["(at)", "[at]", "(AT)"])
        return r.choice([[f"{name()}@{domain()}"], [name(), at, domain()], [name() + at + domain()], [name(), "@", domain()]])

    def phone():
        a, b, c = d(3), d(3), d(4)
        return r.choice([["+" + d(1), f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], ["+" + d(2), d(2), d(4), d(4)], [f"({a}){b}-{c}"], ["00" + d(2), d(3), d(6)]])

    def ip():
        n = [str(r.randint(1, 255)) for _ in range(4)]
        return r.choice([[".".join(n)], [".".join(n) + ":" + d(4)], ["[.]".join(n)]])

    def card():
        n = d(15)
        n += next(c for c in "0123456789" if luhn((n + c).encode()))
        four = [n[k : k + 4] for k in range(0, 16, 4)]
        return r.choice([[n], four, ["-".join(four)], [".".join(four)], ["/".join(four)]])

    def no_card():
        n = d(r.randint(13, 18))
        return [n + next(c for c in "5678901234" if not luhn((n + c).encode()))]

    def clean():
        return r.choice(
            [
                ["version", d(1) + "." + d(1)], ["Version", f"{d(1)}.{d(1)}."], [f"{d(1)}.{d(1)}.{d(1)}"], ["19" + d(2)], ["20" + d(2) + "."], [d(r.randint(1, 9))], [d(r.randint(1, 6)) + r.choice(".,%")], [d(1) + "," + d(3)], ["BY-NC", d(1) + ".0."],
                [f"{d(2)}:{d(2)}"], [f"20{d(2)}-{d(2)}-{d(2)}"], [f"{d(2)}/{d(2)}/20{d(2)}"], ["§", d(2)], ["password=" + "".join(r.choices("0123456789abcdef", k=18))], ["token", "=", '"' + "".join(r.choices("0123456789abcdef", k=40)) + '"'],
                ["AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16))], ["@" + word()], ["#" + d(3)], ["(" + d(1) + ")"], [d(3) + "-" + d(4)], [d(2) + "-" + d(4)], [d(1) + "th"], ["$" + d(3)], [d(3) + "&&&"], [d(2) + "." + d(2)], ["@@" + d(2)], no_card(), no_card(), [d(10)], [d(24)], ["https://x.example/" + d(4)],
            ]
        )

    def tail(words):
        return words[:-1] + [words[-1] + r.choice(".,;!?)")] if r.random() < 0.3 else words

    table = []
    for _ in range(rows):
        row = [(word(), 0) for _ in range(r.randint(0, 5))]
        for _ in range(r.randint(1, 2)):
            kind = r.choice([0, 1, 2, 3, 4, 4, 4])
            words = tail((email, ip, card, phone, clean)[kind]())
            row += [(w, 0 if kind == 4 else 1 + 2 * kind + (k > 0)) for k, w in enumerate(words)]
            row += [(word(), 0) for _ in range(r.randint(1, 5))]
        table.append(row)
    for _ in range(rows):
        words = [noise() if r.random() < 0.4 else word() for _ in range(r.randint(2, 9))]
        if r.random() < 0.3:
            words += clean()
        table.append([(w, 0) for w in words])
    return table


def train(table: list[list[tuple[str, int]]], steps: int = 50, l2: float = 0.003) -> Field:
    """Maximum likelihood by forward-backward over the whole table at each step of Adam."""
    n, width = len(table), max(map(len, table))
    feats, gold, size = np.full((n, width, FEATURES), -1), np.zeros((n, width), np.int64), np.array([len(x) for x in table])
    for i, row in enumerate(table):
        words = [w.encode() for w, _ in row]
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.array([e - len(w) - 1 for w, e in zip(words, ends, strict=True)])
        feats[i, : len(row)] = token_features(np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8), starts, ends - 1)
        gold[i, : len(row)] = [k for _, k in row]
    live = np.arange(width) < size[:, None]
    field = Field(np.zeros((3, FEATURES, 1 << BITS, LABELS)), np.zeros((LABELS, LABELS)))
    padded = np.pad(feats, ((0, 0), (1, 1), (0, 0)), constant_values=-1)
    one = np.eye(LABELS)[gold] * live[:, :, None]
    pairs = one[:, :-1].reshape(-1, LABELS).T @ one[:, 1:].reshape(-1, LABELS)
    moments = [[np.zeros_like(field.emit), np.zeros_like(field.emit)], [np.zeros_like(field.move), np.zeros_like(field.move)]]

    def lse(x, axis):
        top = x.max(axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))

    for step in range(1, steps + 1):
        s, move = field.scores(feats), field.move + _ALLOWED
        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0] + _START
        for t in range(1, width):
            alpha[:, t] = np.where(live[:, t, None], lse(alpha[:, t - 1][:, :, None] + move, 1) + s[:, t], alpha[:, t - 1])
        z = lse(alpha[:, -1], 1)
        for t in range(width - 2, -1, -1):
            beta[:, t] = np.where(live[:, t + 1, None], lse(move + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0.0)
        p = np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * live[:, :, None]
        expect = np.zeros_like(move)
        for t in range(1, width):
            joint = alpha[:, t - 1][:, :, None] + move + (s[:, t] + beta[:, t])[:, None, :] - z[:, None, None]
            expect += np.exp(np.minimum(joint, 0))[live[:, t]].sum(0)
        g_emit = l2 * n * field.emit / n
        for offset in range(3):
            near = padded[:, offset : offset + width]
            for f in range(FEATURES):
                b = near[:, :, f]
                np.add.at(g_emit[offset, f], b[live & (b >= 0)], (p - one)[live & (b >= 0)] / n)
        for k, (w, g) in enumerate(((field.emit, g_emit), (field.move, (expect - pairs) / n + l2 * field.move))):
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(field.emit.astype(np.float32), field.move)


_EDGE = b".,;:!?()[]{}<>\"'"


def field_spans(t: Texts, field: Field) -> list[tuple[int, int, int, int]]:
    """(row, start, end, kind) in bytes of the buffer, of the spans that the field finds in the sentences of all texts;
    punctuation at their edges is left out."""
    start, end, row = t.words()
    if not len(start):
        return []
    first = sentences(t, start, end, row)
    size = np.diff(np.append(first, len(start)))
    score = field.word_scores(token_features(t.buf, start, end), first)
    label = np.zeros(len(start), dtype=np.int8)
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):  # sentences of like length together, so many that a batch has about as many words
        width = int(size[order[min(at + 2000, len(order)) - 1]])
        part = order[at : at + max(1, min(2000, 60_000 // width))]
        width = int(size[part].max())
        grid = np.minimum(first[part][:, None] + np.arange(width), len(start) - 1)
        live = np.arange(width) < size[part][:, None]
        label[grid[live]] = field.decode(score[grid], size[part])[live]
        at += len(part)
    out = []
    for i in np.flatnonzero(label % 2 == 1).tolist():
        kind, to = (int(label[i]) - 1) // 2, i
        while to + 1 < len(label) and label[to + 1] == label[i] + 1:
            to += 1
        a, b = int(start[i]), int(end[to])
        while a < b and t.buf[a] in _EDGE and not (kind == 3 and t.buf[a] == 40):
            a += 1
        while a < b and t.buf[b - 1] in _EDGE:
            b -= 1
        if a < b:
            out.append((int(row[i]), a, b, kind))
    return out


def find_pii(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added; columns of these names are replaced.

    The counts and the digest are of the fixed patterns; spans has these and what the field adds beside them: a span
    of the field that touches one of a pattern is left out. Places are code points of the text. Null text is the empty
    text: no spans, and the digest of the empty string. Rows are handled one by one.
    """
    ddl = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    names = [x.split()[0] for x in ddl.split(", ")]
    docs = docs.drop(*names)
    schema = StructType(docs.schema.fields + StructType.fromDDL(ddl).fields)

    def run(batches):
        for batch in chunks(batches, text_col):
            t = Texts(batch.column(batch.schema.names.index(text_col)))
            digits, ats = ((t.buf >= 48) & (t.buf <= 57)), t.buf == 64
            has = [np.bincount(np.searchsorted(t.off, np.flatnonzero(x), side="right") - 1, minlength=t.n) > 0 for x in (ats, digits)]
            added: dict[int, list] = {}
            for i, a, b, kind in field_spans(t, field):
                added.setdefault(i, []).append((a - int(t.off[i]), b - int(t.off[i]), kind))
            counts, digest, spans, more = np.zeros((4, t.n), np.int64), [], [], np.zeros(t.n, np.int64)
            for i in range(t.n):
                base = base_spans(t.bytes(i), bool(has[0][i]), bool(has[1][i])) if has[0][i] or has[1][i] else []
                extra = [s for s in added.get(i, ()) if all(s[1] <= b[0] or s[0] >= b[1] for b in base)]
                whole = sorted(base + extra, key=lambda s: (s[0], s[2]))
                points = {}
                if whole:  # byte places to code points
                    run_ = np.cumsum((t.buf[t.off[i] : t.off[i + 1]] & 0xC0) != 0x80)
                    points = {p: int(run_[p - 1]) if p else 0 for s in whole for p in s[:2]}
                said = [",".join(f"{KINDS[k]}:{points[a]}:{points[b]}" for a, b, k in x) for x in (base, whole)]
                for s in base:
                    counts[s[2], i] += 1
                more[i] = len(extra)
                digest.append(hashlib.sha256(said[0].encode()).hexdigest())
                spans.append(said[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, counts), pa.array(digest), pa.array(spans), pa.array(more)], names=schema.names)

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_pii(docs, train(labelled_table())).drop("text")


def base_query(spark, sf_dir: str) -> DataFrame:
    """The counts of the fixed patterns alone, which SQL can express."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    silent = Field(np.zeros((3, FEATURES, 1 << BITS, LABELS), np.float32), np.zeros((LABELS, LABELS)))
    return find_pii(docs, silent).select("doc_id", *[f"n_{k}" for k in KINDS])


BASE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
 list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))) AS card, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) AS phone FROM t)
SELECT doc_id, n_email, len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS DOUBLE), 0) > 255)) = 0)) AS n_ip,
 len(list_filter(card, lambda x: length(x) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN x[i]::INT WHEN x[i]::INT < 5 THEN 2 * x[i]::INT ELSE 2 * x[i]::INT - 9 END)) % 10 = 0)) AS n_card,
 len(list_filter(phone, lambda x: x BETWEEN 9 AND 15)) AS n_phone FROM m
"""

"""Personal data: exact patterns, and a character tagger that finds what they miss.

The patterns label a bounded sample of texts; a bidirectional LSTM with CRF
transitions learns from these spans, from altered copies of them (other
separators, missing signs) and from look-alikes such as dates and versions.  It reads
every place with a digit or a mark of an address, to the ends of its tokens, through overlapping windows; their scores
are averaged and each stretch is decoded as a whole, so a span across windows is
found once.  Spans it adds pass the exact check of their kind.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm.bilstm_crf import Tagger
from tallyworks.llm.common import data, documents, pieces
from tallyworks.llm.registry import query

KINDS = ("email", "ip", "card", "phone")
# Patterns of the kinds: fixed values.
AT = re.compile(r"@")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Spelled at signs and dots: in brackets, or plain words between blanks.
_IN = r"[\x20\t\r\n]{0,3}[\[({][\x20\t]{0,3}%s[\x20\t]{0,3}[\])}][\x20\t\r\n]{0,3}"
_PLAIN = r"[\x20\t]{1,3}%s[\x20\t]{1,3}"
SPELLED_AT = re.compile(f"(?P<in>{_IN % 'at'})|{_PLAIN % 'at'}", re.IGNORECASE)
SPELLED_DOT = re.compile(f"(?:{_IN % 'dot'}|{_PLAIN % 'dot'})", re.IGNORECASE)
SPELLED_DOMAIN = re.compile(rf"[A-Za-z0-9-]++(?:(?:\.|{_IN % 'dot'}|{_PLAIN % 'dot'})[A-Za-z0-9-]++)+", re.IGNORECASE)
# Last labels of a plain spelled address that need no model; words of texts, such as "in" or "it", are none.
ENDINGS = frozenset("com org net edu gov mil info biz example uk de fr es eu ca au jp br ru nl".split())
DOT_BEFORE = re.compile(f"(?:{_IN % 'dot'}|{_PLAIN % 'dot'})$", re.IGNORECASE)

# No kind is without a digit, an at sign or its spelling; spelled() finds plain words.
TRIGGER = re.compile(r"[0-9@]|[\[({][\x20\t]{0,3}at[\x20\t]{0,3}[\])}]", re.IGNORECASE)
# Window and stride of the tagger, and what it sees around a trigger.
WINDOW, STRIDE, AROUND = 64, 32, 24
# Documents that training reads, on average: each is drawn by a hash of its text.  Windows it keeps at most.
SAMPLE_DOCS, SAMPLE_WINDOWS = 4000, 1500
STEPS = 600
SURE = 0.9
LANES = 256

# Codes of characters: 0 fills up, one for all digits, one for letters beyond ASCII, one for the rest.
_CODES = np.zeros(128, np.int16)
_CODES[32:127] = np.arange(2, 97)
_CODES[48:58] = _CODES[48]
_CODES[65:91] = _CODES[97:123]
_CODES[9:14] = _CODES[32]
CODES = 98


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _is_card(s: str) -> bool:
    d = "".join(DIGIT.findall(s))
    return 12 <= len(d) <= 19 and luhn(d)


def _is_phone(s: str) -> bool:
    return 9 <= len(DIGIT.findall(s)) <= 15


def _is_ip(s: str) -> bool:
    parts = [p.lstrip("0") for p in s.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: for every at sign the longest run before it, then the domain."""
    out, free = [], 0
    for m in AT.finditer(text):
        at = m.start()
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start == at or at < free:
            continue
        found = DOMAIN.match(text, at + 1)
        if found:
            out.append((start, found.end()))
            free = found.end()
    return out


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(spans of the patterns by start and kind, matches that failed their check), as (start, end, kind)."""
    good, bad = [], []
    if "@" in text:
        good += [(a, b, 0) for a, b in _emails(text)]
    for kind, pattern, check in ((1, IP, _is_ip), (2, CARD, _is_card), (3, PHONE, _is_phone)):
        for m in pattern.finditer(text):
            (good if check(m[0]) else bad).append((m.start(), m.end(), kind))
    return sorted(good, key=lambda s: (s[0], s[2])), bad


def spelled(text: str) -> list[tuple[int, int, bool]]:
    """Whole spelled addresses as (start, end, is it clear without a model?); a plain one needs a spelled dot as well."""
    out: list[tuple[int, int, bool]] = []
    for m in SPELLED_AT.finditer(text):
        found = SPELLED_DOMAIN.match(text, m.end())
        if not found or not m["in"] and not SPELLED_DOT.search(found[0]):
            continue
        free = out[-1][1] if out else 0
        start = end = m.start()
        while True:
            while start > free and text[start - 1] in LOCAL_CHARS:
                start -= 1
            dot = DOT_BEFORE.search(text[max(free, start - 16) : start]) if start < end else None
            if not dot:
                break
            end = start - len(dot[0])
            if end <= free or text[end - 1] not in LOCAL_CHARS:
                break
            start = end
        if start < m.start():
            last = re.split("[^a-z0-9-]", found[0].lower())[-1]
            out.append((start, found.end(), bool(m["in"]) or last in ENDINGS))
    return out


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CODES[np.minimum(points, 127)], 97).astype(np.int16)


def stretches(text: str, around: int = AROUND, whole: bool = True) -> list[tuple[int, int]]:
    """What the tagger reads: characters near a trigger or a spelled address, to the ends of tokens if ``whole``, merged where they meet."""
    marks = [m.span() for m in TRIGGER.finditer(text)]
    near: list[tuple[int, int]] = []
    # Marks in brackets are triggers; windows for training stay near them.
    spans = [(a, b) for a, b, _ in spelled(text) if whole or not set("[({") & set(text[a:b])]
    for start, end in sorted(marks + spans):
        a, b = max(0, start - around), min(len(text), end + around)
        if near and a <= near[-1][1]:
            near[-1] = (near[-1][0], max(b, near[-1][1]))
        else:
            near.append((a, b))
    if not whole:
        return near
    out: list[tuple[int, int]] = []
    for a, b in near:
        floor = out[-1][1] if out else 0
        if b <= floor:
            continue
        while a > floor and not text[a - 1].isspace() and not text[a].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace() and not text[b - 1].isspace():
            b += 1
        if out and a <= floor:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def windows(size: int) -> list[int]:
    """Where windows begin in a stretch: every STRIDE, until one holds its end."""
    return list(range(0, max(1, size - WINDOW + STRIDE), STRIDE)) if size > WINDOW else [0]


# -- training ---------------------------------------------------------------------------------------------------------


def _worn(text: str, rng: np.random.Generator) -> str:
    """Some letters replaced by others, so that the words of the sample are not learnt by heart."""
    hit = rng.random(len(text)) < 0.15
    letters = "abcdefghijklmnopqrstuvwxyz"
    return "".join(letters[rng.integers(26)] if h and c.isalpha() else c for c, h in zip(text, hit))


def _altered(text: str, spans: list[tuple[int, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its spans written in other ways, or with a look-alike that is none."""
    out, found, at = "", [], 0
    for a, b, kind in spans:
        if a < at:
            continue
        s = text[a:b]
        way = rng.integers(4)
        if kind == 0 and way == 2 and len(s) % 2:
            s = s.replace("@", " at ").replace(".", " dot ")
        elif kind == 0 and way:
            s = s.replace("@", ("[at]", " [at] ", "(at)")[way - 1]).replace(".", (".", " [dot] ", ".")[way - 1])
        elif kind == 1 and way == 1:
            s = s.replace(".", " . ")
        elif kind == 2 and way:
            d = "".join(DIGIT.findall(s))
            s = (" - ", "_", "/")[way - 1].join(d[i : i + 4] for i in range(0, len(d), 4))
        elif kind == 3 and way:
            d = "".join(DIGIT.findall(s))
            s = (f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}", f"00{d[:-10]} {d[-10:-7]} {d[-7:-4]} {d[-4:]}")[way - 1]
        out += _worn(text[at:a], rng)
        if rng.integers(3) == 0:  # a look-alike in its place
            n = rng.integers(1, 99999, 6)
            s = (
                f"{1900 + n[0] % 200}-{1 + n[1] % 12:02d}-{1 + n[2] % 28:02d} {n[3] % 24:02d}:{n[4] % 60:02d}:{n[5] % 60:02d}",
                f"{n[0] % 30}.{n[1] % 30}.{n[2] % 30}", f"{n[0]},{n[1] % 1000:03d}.{n[2] % 100:02d}", f"{n[0] % 999}-{n[1] % 99}-{n[2]}",
                f"v{n[0] % 9}.{n[1] % 20}", f"#{n[0]}", f"{n[0]}{n[1]}{n[2]}", f"{1900 + n[0] % 200}-{1900 + n[1] % 200}",
            )[rng.integers(8)]
        else:
            found.append((len(out), len(out) + len(s), kind))
        out += s
        at = b
    return out + _worn(text[at:], rng), found


def training_windows(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, tags) of every window of a text's stretches; tag 0 is outside, then begin and inside of each kind."""
    code, tags = encode(text), np.zeros(len(text), np.int8)
    for a, b, kind in spans:
        tags[a:b] = 2 + 2 * kind
        tags[a] = 1 + 2 * kind
    for a, b in stretches(text, whole=False):
        for w in windows(b - a):
            c, t = np.zeros(WINDOW, np.int16), np.zeros(WINDOW, np.int8)
            part = code[a + w : min(b, a + w + WINDOW)]
            c[: len(part)], t[: len(part)] = part, tags[a + w : a + w + len(part)]
            yield c, t


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE_DOCS, most: int = SAMPLE_WINDOWS, steps: int = STEPS) -> Tagger | None:
    """A tagger learnt from the patterns' spans in a bounded sample; None if there is nothing to learn from.

    The sample is one group of SAMPLE_WINDOWS rows at most, and one task learns from it.
    """
    n = docs.count()
    draw = F.pmod(F.xxhash64(text, F.lit(11)), F.lit(1 << 30)) < min(1.0, sample / max(n, 1)) * (1 << 30)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            codes, tags = [], []
            for t in piece.column(0):
                t = t.as_py()
                if not TRIGGER.search(t):
                    continue
                spans, bad = base_spans(t)
                # A span of one kind inside another, such as a card in a phone, gives way to the one that begins first.
                clear, at = [], 0
                for s in spans:
                    if s[0] >= at:
                        clear.append(s)
                        at = s[1]
                rng = np.random.default_rng(zlib.crc32(t.encode("utf-8", "surrogatepass")))
                for version in ((t, clear), _altered(t, clear, rng), _altered(t, clear, rng)):
                    for c, g in training_windows(*version):
                        codes.append(c.tobytes())
                        tags.append(g.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), pa.array(tags, pa.binary())], ["codes", "tags"])

    rows = docs.where(F.col(text).isNotNull() & draw).select(F.col(text).alias("text")).mapInArrow(cut, "codes binary, tags binary")
    rows = rows.distinct().orderBy(F.xxhash64("codes"), "codes", "tags").limit(most)

    def learn(group: pa.Table) -> pa.Table:
        x = np.stack([np.frombuffer(v.as_py(), np.int16) for v in group.column("codes")]).astype(np.int64)
        y = np.stack([np.frombuffer(v.as_py(), np.int8) for v in group.column("tags")]).astype(np.int64)
        order = np.lexsort(np.c_[x, y].T)
        model = Tagger(CODES, 1 + 2 * len(KINDS)).start().fit(x[order], y[order], steps)
        return pa.table({"model": [pickle.dumps(model)]})

    found = rows.groupBy(F.lit(0).alias("one")).applyInArrow(learn, "model binary").collect()
    return pickle.loads(bytes(found[0]["model"])) if found else None


# -- finding ----------------------------------------------------------------------------------------------------------


def _fits(s: str, kind: int) -> bool:
    """The exact check of a span that the tagger adds."""
    digits = len(DIGIT.findall(s))
    if kind == 0:
        s = s.lower()
        return ("@" in s or "at" in s) and ("." in s or "dot" in s) and len(s) >= 6
    if kind == 1:
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and s.count(".") >= 3
    if kind == 2:
        return _is_card(s)
    return 9 <= digits <= 15 and len(re.findall("[0-9]+", s)) >= 2


def tagged(texts: list[str], model: Tagger) -> list[list[tuple[int, int, int]]]:
    """Spans that the model finds in each text, before any check."""
    where, codes = [], []
    for i, text in enumerate(texts):
        code = encode(text)
        for a, b in stretches(text):
            where.append((i, a, b, len(codes)))
            for w in windows(b - a):
                c = np.zeros(WINDOW, np.int64)
                part = code[a + w : min(b, a + w + WINDOW)]
                c[: len(part)] = part
                codes.append(c)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not codes:
        return out
    all_codes = np.stack(codes)
    em = np.concatenate([model.emissions(all_codes[k : k + LANES]) for k in range(0, len(all_codes), LANES)])
    # A window's middle has seen more on both sides than its ends.
    weight = np.minimum(np.arange(WINDOW) + 1, np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
    order = sorted(range(len(where)), key=lambda j: where[j][2] - where[j][1])
    for k in range(0, len(order), LANES):
        lanes = [where[j] for j in order[k : k + LANES]]
        size = np.array([b - a for _, a, b, _ in lanes])
        total = np.zeros((len(lanes), int(size.max()) + WINDOW, em.shape[2]), np.float32)
        share = np.zeros((len(lanes), total.shape[1], 1), np.float32)
        for r, (_, a, b, first) in enumerate(lanes):
            for n, w in enumerate(windows(b - a)):
                total[r, w : w + WINDOW] += em[first + n] * weight
                share[r, w : w + WINDOW] += weight
        mean = (total / np.maximum(share, 1e-6))[:, : int(size.max())]
        tags = model.viterbi(mean, size)
        some = np.flatnonzero(tags.any(axis=1))
        odds = dict(zip(some, model.marginals(mean[some], size[some]))) if len(some) else {}
        for r, (i, a, b, _) in enumerate(lanes):
            row, t = tags[r, : b - a], 0
            while t < len(row):
                if row[t]:
                    kind, end = (int(row[t]) - 1) // 2, t + 1
                    while end < len(row) and row[end] == 2 + 2 * kind:
                        end += 1
                    # Begin and inside of the kind both speak for it.
                    if odds[r][t:end, 1 + 2 * kind : 3 + 2 * kind].sum(axis=1).mean() >= SURE:
                        # A border inside a number moves to the number's end.
                        x, y = a + t, a + end
                        while x > 0 and texts[i][x - 1].isdigit() and texts[i][x].isdigit():
                            x -= 1
                        while y < len(texts[i]) and texts[i][y - 1].isdigit() and texts[i][y].isdigit():
                            y += 1
                        out[i].append((x, y, kind))
                    t = end
                else:
                    t += 1
    return out


def find_spans(texts: list[str], model: Tagger | None) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text: the patterns' spans, and all spans with those added, by start and kind.

    The model adds spans; one that meets a spelled address takes all of it.  A clear one needs no model.
    """
    base = [base_spans(t) for t in texts]
    more = tagged(texts, model) if model is not None else [[] for _ in texts]
    out = []
    for t, (good, bad), added in zip(texts, base, more):
        # Numbers that failed as cards are no phones either.
        veto = good + [s for s in bad if s[2] == 2 and len(DIGIT.findall(t[s[0] : s[1]])) >= 12]
        own = []
        for a, b, kind in added:
            number = kind in (1, 2)  # these begin and end with a digit
            while a < b and (t[a].isspace() or number and not t[a].isdigit()):
                a += 1
            while a < b and (t[b - 1].isspace() or t[b - 1] in ",;" or number and not t[b - 1].isdigit()):
                b -= 1
            clear = all(b <= x or y <= a for x, y, _ in veto) and all(b <= x or y <= a for x, y, k in bad if k == kind)
            if a < b and clear and _fits(t[a:b], kind):
                own.append((a, b, kind))
        for a, b, clear in spelled(t):
            met = [s for s in own if s[2] == 0 and s[0] < b and a < s[1]]
            if (clear or met) and all(b <= x or y <= a for x, y, k in good if k == 0):
                own = [s for s in own if s not in met]
                own.append((min([a, *(s[0] for s in met)]), max([b, *(s[1] for s in met)]), 0))
        out.append((good, sorted(good + own, key=lambda s: (s[0], s[2])) if own else good))
    return out


def _found(batches: Iterator[pa.RecordBatch], at: int, text: str, model: Tagger | None):
    """(piece, rows with a trigger, their texts, their spans): other texts hold nothing and are not decoded."""
    for piece in pieces(batches, text):
        col = piece.column(at)
        raw, ends = data(col)
        mark = np.cumsum(np.r_[0, (raw - 48 < 10) | (raw == 64)])
        may = mark[ends[1:]] > mark[ends[:-1]]
        if not may.all():
            def words(word: bytes) -> tuple[np.ndarray, np.ndarray]:
                """Where a word stands in any case, and whether a bracket is one to four bytes before it."""
                found = np.flatnonzero(np.logical_and.reduce([low[i : len(low) - len(word) + 1 + i] == c for i, c in enumerate(word)]))
                return found, np.isin(raw[np.maximum(found[:, None] - np.arange(1, 5), 0)], [40, 91, 123]).any(axis=1)

            low = np.where(raw - 65 < 26, raw | 32, raw)
            if len(low) > 2:
                spot, bracket = words(b"at")
                plain, dotted = np.zeros(piece.num_rows, bool), np.zeros(piece.num_rows, bool)
                row = lambda x: np.searchsorted(ends, x, side="right") - 1
                may[row(spot[bracket])] = True
                plain[row(spot[np.isin(raw[np.maximum(spot - 1, 0)], [9, 32])])] = True
                dot, bracket = words(b"dot")
                dotted[row(dot[bracket | np.isin(raw[np.maximum(dot - 1, 0)], [9, 32])])] = True
                may |= plain & dotted
        rows = np.flatnonzero(may)
        texts = [col[int(i)].as_py() for i in rows]
        yield piece, rows, texts, find_spans(texts, model)


def tag(docs: DataFrame, model: Tagger | None, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` and with ``base`` and ``spans``: arrays of (start, end, kind), ends exclusive.

    Positions are code points.  Null and empty texts hold nothing.
    """
    kept = [c for c in docs.columns if c != text]
    known = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, rows, _, found in _found(batches, len(kept), text, known.value):
            lists = [[[] for _ in range(piece.num_rows)] for _ in range(2)]
            for i, both in zip(rows, found):
                for side, spans in zip(lists, both):
                    side[i] = [{"start": a, "end": b, "kind": k} for a, b, k in spans]
            yield pa.RecordBatch.from_arrays([*piece.columns[: len(kept)], pa.array(lists[0], kind), pa.array(lists[1], kind)], [*kept, "base", "spans"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema)
    rows = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(text))
    return rows.mapInArrow(run, schema + "base array<struct<start:int,end:int,kind:int>>, spans array<struct<start:int,end:int,kind:int>>")


def redact(docs: DataFrame, model: Tagger | None, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; spans that overlap become one, named by the first."""
    at = docs.columns.index(text)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, rows, texts, found in _found(batches, at, text, known.value):
            changed = {}
            for i, t, (_, spans) in zip(rows, texts, found):
                out, done = [], 0
                for a, b, kind in spans:
                    if a >= done:
                        out += [t[done:a], f"[{KINDS[kind].upper()}]"]
                    done = max(done, b)
                if spans:
                    changed[int(i)] = "".join([*out, t[done:]])
            if changed:
                col = piece.column(at)
                new = [changed[i] if i in changed else col[i].as_py() for i in range(piece.num_rows)]
                piece = piece.set_column(at, piece.schema.field(at), pa.array(new, col.type))
            yield piece

    return docs.mapInArrow(run, docs.schema)


@query("op10_pii_tagger")
def op10_pii_tagger(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    found = tag(docs, fit(docs))

    def joined(spans: str):
        name = F.array(*[F.lit(k) for k in KINDS])
        part = lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
        return F.array_join(F.transform(spans, part), ",")

    def n(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [n(i) for i in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))

"""Personal data: patterns, and a character-level BiLSTM-CRF that adds spans the patterns miss.

The patterns' spans always stay. The tagger is trained on the driver from labelled spans: those of the patterns in a bounded sample of documents, and forms made up by rules (numbers without a plus, addresses written with brackets) set into the sample's texts. It then reads whole texts in overlapping windows. A span that it adds has one of the FORMS, each of which holds a digit, an `@`, a bracketed `at` or the word `dot`; windows without any of them are settled without running the network, which changes no result (a test compares both ways). Where windows overlap, each character takes its tag from the window in which it lies farthest from an edge, and spans are put together over the whole text: a tagged stretch stands for the form that it lies on for the most part, of its own kind where there is one, which must be sound (parts, Luhn) and touch no other span.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import documents, id_type, small_batches
from foliant.llm.tagger import WINDOW, Tagger, classes

KINDS = ("email", "ip", "card", "phone")
#: Documents that the tagger is trained on, in expectation; windows of them at most.
SAMPLE, TRAIN_WINDOWS = 1500, 2400
STRIDE = WINDOW // 2

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match that begins inside a run of digits would begin at the run's first
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|(?i:[(\[{] ?at ?[)\]}]|\bdot\b)")
_LOCAL_PART, _LABEL = r"[A-Za-z0-9._%+-]+", r"[A-Za-z0-9-]+"
#: What a span may look like that the tagger adds.
FORMS = {
    "email": re.compile(rf"{_LOCAL_PART} ?(?:@|(?i:[(\[{{] ?at ?[)\]}}])) ?{_LABEL}(?:(?:\.| ?(?i:[(\[{{] ?dot ?[)\]}}]) ?| (?i:dot) ){_LABEL})+|{_LOCAL_PART} (?i:at) {_LABEL}(?: (?i:dot) {_LABEL})+"),
    "ip": re.compile(r"[0-9]{1,3}(?:(?: ?\. ?|\[\.\]|\(\.\)| ?(?i:\[dot\]) ?)[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[\x20.-]{0,2}[0-9]){15,18}"),
    "phone": re.compile(r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|00[0-9]{1,3}[\x20().0-9-]{4,18}[0-9]"),
}
#: Characters to either side of a tagged stretch where its form may begin or end.
AROUND = 48


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from each @: in time that grows with the text."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """The patterns' spans by kind as listed, then start."""
    if not text:
        return []
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return found
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    found += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def sound(kind: str, text: str) -> bool:
    """Whether a span that the tagger adds can be of its kind."""
    if not FORMS[kind].fullmatch(text):
        return False
    if kind == "ip":
        return all(int(p) <= 255 for p in re.findall("[0-9]+", text))
    digits = _digits(text)
    return kind == "email" or (16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15)


def form_of(kind: str, text: str, a: int, b: int) -> tuple[int, int] | None:
    """The sound form of a kind, between no letters or digits, that the tagged stretch lies on for the most part."""
    best = None
    for m in FORMS[kind].finditer(text, max(0, a - AROUND), min(len(text), b + AROUND)):
        x, y = m.span()
        shared = min(b, y) - max(a, x)
        if 2 * shared >= b - a and (best is None or shared > best[0]) and sound(kind, m[0]) and (x == 0 or not text[x - 1].isalnum()) and (y == len(text) or not text[y].isalnum()):
            best = shared, x, y
    return best and best[1:]


def _window_starts(text: str) -> list[int]:
    """Begins of the windows that hold every trigger and what stands around it: on a grid of STRIDE, so that every character of theirs lies in two."""
    found: list[int] = []
    for m in _TRIGGER.finditer(text):
        cell = m.start() // STRIDE
        for k in (cell - 2, cell - 1, cell, cell + 1):
            if 0 <= k and (not found or k > found[-1]) and k * STRIDE < len(text):
                found.append(k)
    return [k * STRIDE for k in found]


def _cut(codes: np.ndarray, start: int) -> np.ndarray:
    part = codes[start : start + WINDOW]
    return np.concatenate([part, np.zeros(WINDOW - len(part), np.uint8)]) if len(part) < WINDOW else part


def _made_up(r: np.random.Generator) -> tuple[str, str]:
    """A span's kind and text by rule."""
    n = lambda k: "".join(str(x) for x in r.integers(0, 10, k))
    word = lambda: "".join(chr(97 + x) for x in r.integers(0, 26, r.integers(3, 9)))
    kind = KINDS[max(0, int(r.integers(-3, 4)))]  # more addresses, which have more forms
    if kind == "email":
        ways = [(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", "."), ("(at)", "(dot)"), (" @ ", "."), (" @ ", "."), (" at ", " dot "), (" at ", " dot "), (" {at} ", " {dot} "), (" (at) ", " (dot) ")]
        at, dot = ways[r.integers(0, len(ways))]
        if r.random() < 0.15:
            at, dot = at.upper(), dot.upper()
        ends = ["com", "org", "net", "example", "io", "co"]
        host = dot.join([word() for _ in range(int(r.integers(1, 3)))] + [ends[r.integers(0, len(ends))]])
        return kind, f"{word()}{['', '.', '_', '-'][r.integers(0, 4)]}{word()}{n(int(r.integers(0, 2) * r.integers(1, 4)))}{at}{host}"
    if kind == "ip":
        return kind, [".", "[.]", " . ", "(.)", "[dot]"][r.integers(0, 5)].join(str(x) for x in r.integers(0, 256, 4))
    if kind == "card":
        digits = "3456"[r.integers(0, 4)] + n(14)
        digits += next(str(x) for x in range(10) if luhn(digits + str(x)))
        return kind, ["", " ", "-", ".", ".", "  "][r.integers(0, 6)].join([digits[:4], digits[4:8], digits[8:12], digits[12:]])
    sep = " -."[r.integers(0, 3)]
    abroad = sep.join(["00" + n(int(r.integers(1, 4))), *(n(int(k)) for k in r.integers(1, 8, int(r.integers(2, 4))))])
    if not 8 <= len(_digits(abroad)) <= 15:
        abroad = f"00{n(2)}{sep}{n(3)}{sep}{n(6)}"
    return kind, [f"+{n(1)} ({n(3)}) {n(3)}-{n(4)}", f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}{sep}{n(3)}{sep}{n(4)}", f"+{n(2)} {n(3)} {n(4)} {n(3)}", abroad][r.integers(0, 5)]


def training_windows(texts: list[str], most: int = TRAIN_WINDOWS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows of character classes and their tags: spans of the patterns, made-up spans in the texts, numbers that are none, and plain text."""
    r = np.random.default_rng(seed)
    texts = [t for t in texts if t] or ["no text was given"]
    ids, tags = [], []

    def add(text: str, spans: list[tuple[str, int, int]], start: int) -> None:
        own = np.zeros(len(text), np.int8)
        for kind, a, b in spans:
            k = KINDS.index(kind)
            own[a] = 1 + 2 * k
            own[a + 1 : b] = 2 + 2 * k
        part = own[start : start + WINDOW]
        ids.append(_cut(classes(text), start))
        tags.append(np.concatenate([part, np.zeros(WINDOW - len(part), np.int8)]))

    for text in texts:
        spans = base_spans(text)
        taken: list[tuple[str, int, int]] = []
        for s in sorted(spans, key=lambda s: (s[1], -s[2])):
            if not taken or s[1] >= taken[-1][2]:
                taken.append(s)
        for _, a, _ in taken[:6]:
            if len(ids) < most // 3:
                add(text, taken, max(0, a - int(r.integers(4, 40))))
    while len(ids) < most:
        text = texts[r.integers(0, len(texts))]
        cut = int(r.integers(0, max(1, len(text) - 40)))
        left, right = text[max(0, cut - 60) : cut], text[cut : cut + 90]
        if base_spans(left) or base_spans(right):
            left, right = "see also ", " for more of it"
        choice = r.random()
        if choice < 0.65:
            kind, own = _made_up(r)
            spans = [(kind, len(left) + 1, len(left) + 1 + len(own))]
            add(f"{left} {own} {right}", spans, max(0, len(left) + 1 - int(r.integers(2, 50))))
        elif choice < 0.85:
            number = ["".join(str(x) for x in r.integers(0, 10, r.integers(1, 8))), f"{r.integers(0, 99)}.{r.integers(0, 99)}", f"{r.integers(1000, 9999)}-{r.integers(1, 12)}-{r.integers(1, 28)}", f"v{r.integers(0, 9)}.{r.integers(0, 9)}.{r.integers(0, 9)}", f"@{r.integers(0, 99)}", f"{r.integers(1, 99)}%"][r.integers(0, 6)]
            add(f"{left} {number} {right}", [], max(0, len(left) + 1 - int(r.integers(2, 50))))
        else:
            add(f"{left}{right}", [], 0)
    return np.array(ids), np.array(tags)


def train(texts: list[str]) -> Tagger:
    tagger = Tagger(len(KINDS))
    tagger.fit(*training_windows(texts))
    return tagger


def tagged_spans(texts: list[str], tagger: Tagger, starts_of=_window_starts) -> list[list[tuple[str, int, int]]]:
    """The tagger's sound spans of each text. starts_of: which windows are decoded."""
    rows, windows, found = [], [], [[] for _ in texts]
    for i, text in enumerate(texts):
        starts = starts_of(text)
        if starts:
            codes = classes(text)
            rows += [(i, s) for s in starts]
            windows += [_cut(codes, s) for s in starts]
    tags = [tagger.decode(np.array(windows[a : a + 2048])) for a in range(0, len(windows), 2048)]
    tags = np.concatenate(tags) if tags else np.zeros((0, WINDOW), np.int8)
    depth = np.minimum(np.arange(WINDOW), WINDOW - 1 - np.arange(WINDOW))
    at = 0
    while at < len(rows):
        i, end = rows[at][0], at
        while end < len(rows) and rows[end][0] == i:
            end += 1
        text, first = texts[i], rows[at][1]
        size = rows[end - 1][1] + WINDOW - first
        own, deep = np.zeros(size, np.int8), np.full(size, -1)
        for (_, start), some in zip(rows[at:end], tags[at:end], strict=True):
            here = slice(start - first, start - first + WINDOW)
            better = depth > deep[here]
            own[here][better] = some[better]
            deep[here][better] = depth[better]
        for a, b, kind in _runs(own):
            a, b = a + first, min(b + first, len(text))
            for name in (KINDS[kind], *KINDS) if a < b else ():  # its own kind first
                form = form_of(name, text, a, b)
                if form:
                    if (name, *form) not in found[i][-1:]:
                        found[i].append((name, *form))
                    break
        at = end
    return found


def _runs(tags: np.ndarray) -> list[tuple[int, int, int]]:
    found, start = [], -1
    for i, t in enumerate([*tags.tolist(), 0]):
        if start >= 0 and (t == 0 or t % 2 == 1 or (t - 1) // 2 != kind):
            found.append((start, i, kind))
            start = -1
        if t and start < 0:
            start, kind = i, (t - 1) // 2
    return found


def all_spans(texts: list[str | None], tagger: Tagger) -> list[tuple[list, list]]:
    """The patterns' spans of each text, and all its spans."""
    texts = [t or "" for t in texts]
    result = []
    for base, more in zip(map(base_spans, texts), tagged_spans(texts, tagger), strict=True):
        taken = [(a, b) for _, a, b in base]
        added = []
        for kind, a, b in more:
            if all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                added.append((kind, a, b))
        result.append((base, sorted([*base, *added], key=lambda s: (KINDS.index(s[0]), s[1]))))
    return result


def fit(docs: DataFrame, sample: int = SAMPLE) -> Tagger:
    """Trains on a sample of docs (doc_id, text) drawn by a hash of doc_id: `sample` rows in expectation."""
    total = docs.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("pii")), F.lit(1_000_000))
    rows = docs.select("doc_id", "text").where((draw < F.lit(1e6 * sample / max(1, total))) & F.col("text").isNotNull()).collect()
    return train([r["text"] for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["text"]))])


def find_personal_data(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """docs (doc_id, text) with base (the patterns' spans) and spans (all): arrays of kind, start and end in code points, by kind and start. Null and empty texts have none, repeated rows are searched each, an empty table gives no rows, other columns are kept (but for their own base and spans)."""
    sent = docs.sparkSession.sparkContext.broadcast(tagger)
    kept = [c for c in docs.columns if c not in ("base", "spans")]
    place = kept.index("text")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in small_batches(batches, place):
            found = all_spans(batch.column(place).to_pylist(), sent.value)
            lists = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans[i]] for spans in found], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "base", "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    spans = "array<struct<kind: string, start: int, end: int>>"
    return docs.select(*kept).mapInArrow(run, f"{schema}, base {spans}, spans {spans}")


def redact(found: DataFrame) -> DataFrame:
    """The rows of find_personal_data() with each span replaced by its kind in angle brackets; a span inside another goes with it."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            texts, spans = batch.column(names.index("text")).to_pylist(), batch.column(names.index("spans")).to_pylist()
            for i, own in enumerate(spans):
                parts, done = [], 0
                for s in sorted(own, key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= done:
                        parts += [texts[i][done : s["start"]], f"<{s['kind']}>"]
                        done = s["end"]
                if parts:
                    texts[i] = "".join(parts) + texts[i][done:]
            yield batch.set_column(names.index("text"), "text", pa.array(texts, pa.string()))

    return found.mapInArrow(run, found.schema)


def op7_bilstm_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    tagger = fit(docs)
    sent = spark.sparkContext.broadcast(tagger)

    def run(batches):
        write = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        for batch in small_batches(batches):
            found = all_spans(batch.column(1).to_pylist(), sent.value)
            counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([hashlib.sha256(write(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([write(s) for _, s in found], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.mapInArrow(run, f"doc_id {id_type(docs)}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


QUERIES = {"op7_bilstm_pii": op7_bilstm_pii}
SQL: dict[str, str] = {}

"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Four kinds have a fixed definition (``base_spans``) and are always reported. Around them the method looks at
candidates the definitions leave out: credentials, and numbers shaped like phone or identity numbers or beside a word
for them, wherever they stand in a list of numbers. Regex, gazetteer
and context labelers vote yes, no or nothing on each; expectation-maximisation over the counts of vote patterns gives
every labeler's reliability and every pattern a probability; these soft labels train a naive Bayes classifier
over span features, which decides. All texts take part in the counts, and only counts of votes and features, both of
bounded variety, reach the driver.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import add_columns, slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "tel", "id")
SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"
THRESHOLD = 0.5
NAME_CHARS = 200  # characters of a token before a value that may name it
MOST_DIGITS = 20  # numbers of more digits share one feature
ROUNDS = 25

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"\+?[0-9][0-9 .()-]*")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # Everything between two @ that may stand in a local part is one; the leftmost match starts where it starts.
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield start, done
        at = text.find("@", done)


def base_spans(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, int]]]:
    """Spans (start, kind, end) of the four fixed kinds by start and kind, and the stretches of digits seen."""
    spans = [(start, 0, end) for start, end in _emails(text)]
    runs = []
    for run in _NUMBERS.finditer(text):
        start, end = run.span()
        runs.append((start, end))
        if end - start < 7:
            continue
        for chain in _DOTTED.finditer(text, start, end):
            parts = chain.group().split(".")
            at = chain.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                size = sum(map(len, four)) + 3
                if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in four):
                    spans.append((at, 1, at + size))
                at += size + 1
        if end - start < 10:
            continue
        for m in _CARD.finditer(text, start, end):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if text[start] == "+":
            m = _PHONE.match(text, start, end)
            if m and 10 <= len(_DIGIT.findall(m.group())) <= 15:
                spans.append((m.start(), 3, m.end()))
    spans.sort()
    return [(s, KINDS[k], e) for s, k, e in spans], runs


# Fixed words and prefixes of the gazetteer and context labelers.
_SECRET_WORDS = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "access_key", "private_key", "auth")
_SECRET_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_live_", "xoxb-", "xoxp-", "AIza", "glpat-")
_PHONE_WORDS = ("call", "tel", "phone", "mobile", "fax", "contact", "dial")
_ID_WORDS = ("ssn", "social security", "passport", "id no", "identity", "tax id")
_NUMBER_WORDS = ("version", "page", "figure", "chapter", "section", "issn", "isbn", "no.", "vol", "year", "since")

_SECRET_SHAPES = re.compile(
    r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[po]_[0-9A-Za-z]{36}|sk[-_][0-9A-Za-z_-]{20,}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}"
)
_TEL_SHAPE = re.compile(r"(?:1[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")
_ID_SHAPE = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_TOKEN_END = re.compile(r"[\s\"'`,;|<>()\[\]{}]")
_SEPARATOR = re.compile(r"[=:\"' ]+\Z")
# Values beside a word of the gazetteer, and those that look like a credential by themselves.
_NAMED = re.compile(rf"(?:{'|'.join(_SECRET_WORDS)})[=:\"' ]+([^\s\"'`,;|<>()\[\]{{}}]+)", re.I | re.A)
_SHAPED = re.compile(
    rf"(?<![0-9A-Za-z_-])(?:(?:{'|'.join(_SECRET_PREFIXES)})[^\s\"'`,;|<>()\[\]{{}}]+|(?:{_SECRET_SHAPES.pattern})(?![0-9A-Za-z_-]))"
)
# Numbers of a telephone's or identity number's shape, also where other numbers stand beside them.
_NUMBER_SHAPES = re.compile(rf"(?<![0-9])(?:{_ID_SHAPE.pattern}|{_TEL_SHAPE.pattern})(?![0-9])")
_FIELD = re.compile(r"[0-9(][0-9.()-]*")


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    votes: str  # one of y, n and - per labeler
    features: tuple[str, ...]


def _vote(yes: bool, no: bool = False) -> str:
    return "y" if yes else "n" if no else "-"


def _token(text: str, start: int, end: int) -> tuple[int, int]:
    """The stretch around a run of digits up to white space, quotes or brackets."""
    while start > 0 and not _TOKEN_END.match(text[start - 1]):
        start -= 1
    stop = _TOKEN_END.search(text, end)
    return start, stop.start() if stop else len(text)


def _secret(text: str, start: int, value_start: int, end: int) -> Candidate | None:
    """The value from ``value_start`` in the token from ``start``; away from secret words it needs length, digits and letters."""
    value = text[value_start:end].rstrip(".!?")
    end = value_start + len(value)
    digits = len(_DIGIT.findall(value))
    letters = sum(c.isalpha() for c in value)
    if not digits and not letters:
        return None
    named = text[max(start, value_start - NAME_CHARS) : value_start].rstrip("=:").lower()
    gap = text[max(0, value_start - 40) : value_start]
    separator = _SEPARATOR.search(gap)
    assigned = separator is not None and any(c in "=:" for c in separator.group())
    before = _SEPARATOR.sub("", gap).lower()
    cue = next((w for w in _SECRET_WORDS if before.endswith(w)), "")
    known = bool(_SECRET_SHAPES.fullmatch(value)) or value.startswith(_SECRET_PREFIXES)
    if not cue and not known and (len(value) < 12 or not digits or not letters or "@" in value or "://" in value):
        return None
    share = digits / len(value)
    even = len(set(value)) / min(len(value), 16)
    case = "upper" if value.upper() == value else "lower" if value.lower() == value else "mixed"
    plain = all(c.isalnum() or c in "-_+/=" for c in value)
    votes = (
        _vote(bool(_SECRET_SHAPES.fullmatch(value)))
        + _vote(value.startswith(_SECRET_PREFIXES) or any(w in named for w in _SECRET_WORDS))
        + _vote(bool(cue) and (assigned or digits > 0))
        + _vote(0.1 <= share <= 0.85 and even >= 0.5 and plain, not plain or share < 0.1)
        + _vote(False, not value.isascii())
        + _vote(bool(cue) and assigned, bool(cue) and not assigned and not digits)
    )
    size = "1-11" if len(value) < 12 else "12-15" if len(value) < 16 else "16-31" if len(value) < 32 else "32+"
    return Candidate(
        "secret", value_start, end, votes, (f"size={size}", f"digits={round(share * 4)}", f"case={case}", f"plain={plain}")
    )


def _number(text: str, start: int, end: int, run: int) -> Candidate | None:
    """The number in a stretch of the run of numbers that begins at ``run``; a word before the run stands for all its numbers."""
    value = text[start:end].rstrip(" .(-")
    lead = len(value) - len(value.lstrip(" .)-"))
    start, value = start + lead, value[lead:]
    if start and text[start - 1] == "(" and ")" in value:
        start, value = start - 1, "(" + value
    elif ")" in value and "(" not in value:
        value = value.split(")")[0]
    digits = len(_DIGIT.findall(value))
    if not digits:
        return None
    before = f"{text[max(0, run - 24) : run]} {text[max(0, start - 24) : start]}".lower()
    cued = [any(w in before for w in words) for words in (_PHONE_WORDS, _ID_WORDS)]
    shapes = bool(_TEL_SHAPE.fullmatch(value)), bool(_ID_SHAPE.fullmatch(value))
    if not any(shapes) and not any(cued) and (not 9 <= digits <= 12 or _DOTTED.fullmatch(value)):
        return None
    kind = "id" if shapes[1] or not shapes[0] and cued[1] and not cued[0] else "tel"
    votes = (
        _vote(shapes[kind == "id"])
        + _vote(kind == "tel" and value.lstrip("(").startswith(("800", "888", "877", "555")))
        + _vote(cued[kind == "id"] and 7 <= digits <= 15, any(w in before for w in _NUMBER_WORDS))
        + _vote(False, value.count(" ") > 3 or value.count(".") > 3)
        + _vote(False, start > 0 and text[start - 1].isalnum())
        + _vote(cued[kind == "id"] and digits in ((9,) if kind == "id" else (7, 10, 11, 12)), not 7 <= digits <= 15)
    )
    marks = "".join(sorted(set(value) - set("0123456789"))).replace(" ", "_")
    return Candidate(kind, start, start + len(value), votes, (f"digits={min(digits, MOST_DIGITS)}", f"marks={marks}"))


def _without(start: int, end: int, cut: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What is left of a stretch without the stretches in ``cut``, which are sorted by their starts."""
    for a, b in cut[max(0, bisect_left(cut, (start, 0)) - 1) :]:
        if a >= end:
            break
        if b > start:
            if a > start:
                yield start, a
            start = b
    if start < end:
        yield start, end


def _merged(spans: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, _, end in spans:
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def candidates(text: str, spans: list[tuple[int, str, int]], runs: list[tuple[int, int]]) -> list[Candidate]:
    """All candidates outside the base spans, by start. They may overlap each other: the classifier decides between them.

    Secrets are the values beside a secret word, those of a credential's shape and the tokens around digits; numbers are
    those of a known shape inside a run, what is left of the run between them, and the single fields of that.
    """
    base = _merged(spans)
    found: dict[tuple[str, int, int], Candidate] = {}

    def keep(one: Candidate | None) -> None:
        if one:
            found.setdefault((one.kind, one.start, one.end), one)

    beside: list[tuple[int, int]] = []
    for pattern, group in ((_NAMED, 1), (_SHAPED, 0)):
        first = last = 0  # of the token around the latest match; a long token may hold very many
        for m in pattern.finditer(text):
            beside.append(m.span(group))
            if not first <= m.start(group) < last:
                first, last = _token(text, *m.span(group))
            for a, b in _without(*m.span(group), base):
                keep(_secret(text, first, a, b))
    beside = _merged([(a, "", b) for a, b in sorted(beside)])
    seen = 0  # end of the last token taken, as many runs may lie in one
    for start, end in runs:
        if start >= seen:
            first, last = _token(text, start, end if end - start < 2 else start + 1)
            seen = last
            if last - first >= 12:
                for a, b in _without(first, last, base):
                    for c, d in _without(a, b, beside):
                        cut = max(text.rfind("=", c, d - 8), text.rfind(":", c, d - 8)) + 1
                        keep(_secret(text, first, max(c, cut), d))
        for a, b in _without(start, end, base):
            if a == start and a and text[a - 1] == "(":
                a -= 1
            shaped = [m.span() for m in _NUMBER_SHAPES.finditer(text, a, b)]
            for c, d in shaped:
                keep(_number(text, c, d, start))
            for c, d in _without(a, b, shaped):
                keep(_number(text, c, d, start))
                for m in _FIELD.finditer(text, c, d):
                    keep(_number(text, *m.span(), start))
    return sorted(found.values(), key=lambda c: (c.start, KINDS.index(c.kind), c.end))


def additions(text: str, spans: list[tuple[int, str, int]], runs: list[tuple[int, int]], model: Model) -> list[tuple[int, str, int]]:
    """Spans of the candidates that the classifier takes; of those that overlap the most probable, then the longest."""
    rated = [(model.probability(c), c) for c in candidates(text, spans, runs)]
    likely = sorted((-p, c.start - c.end, c.start, KINDS.index(c.kind)) for p, c in rated if p >= THRESHOLD)
    out: list[tuple[int, str, int]] = []
    for _, size, start, kind in likely:
        k = bisect_left(out, (start, "", 0))
        end = start - size
        if (not k or out[k - 1][2] <= start) and (k == len(out) or end <= out[k][0]):
            out.insert(k, (start, KINDS[kind], end))
    return out


@dataclass(frozen=True)
class Model:
    """Reliabilities of the labelers and the weights of the span classifier, per kind."""

    reliability: dict[str, list[dict[str, tuple[float, float]]]]  # labeler: vote -> P(vote | real), P(vote | not)
    bias: dict[str, float]
    weight: dict[tuple[str, str], float]

    def probability(self, one: Candidate) -> float:
        total = self.bias.get(one.kind, -9.0)
        total += sum(self.weight.get((one.kind, f), 0.0) for f in (*one.features, *_vote_features(one.votes)))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, total))))


def _vote_features(votes: str) -> list[str]:
    return [f"vote{k}={v}" for k, v in enumerate(votes)]


def fit_counts(counts: Counter) -> Model:
    """EM over the counts of (kind, votes, features), then naive Bayes from the expected counts."""
    reliability, bias, weight = {}, {}, {}
    for kind in {key[0] for key in counts}:
        patterns: Counter = Counter()
        for (k, votes, _), n in counts.items():
            if k == kind:
                patterns[votes] += n
        labelers = len(next(iter(patterns)))
        # A yes is at first taken as good evidence and a no as strong; pseudo-counts keep that meaning when data are few.
        start = {"y": (0.6, 0.05), "n": (0.02, 0.35), "-": (0.38, 0.6)}
        rates = [dict(start) for _ in range(labelers)]
        prior = 0.5
        for _ in range(ROUNDS):
            sums = [{v: [20 * p for p in start[v]] for v in start} for _ in range(labelers)]
            real = total = 0.0
            posterior = {}
            for votes, n in patterns.items():
                yes, no = prior, 1 - prior
                for k, v in enumerate(votes):
                    yes, no = yes * rates[k][v][0], no * rates[k][v][1]
                posterior[votes] = q = yes / (yes + no)
                real, total = real + n * q, total + n
                for k, v in enumerate(votes):
                    sums[k][v][0] += n * q
                    sums[k][v][1] += n * (1 - q)
            prior = (real + 1) / (total + 2)
            for k in range(labelers):
                both = [sum(sums[k][v][c] for v in start) for c in (0, 1)]
                rates[k] = {v: (sums[k][v][0] / both[0], sums[k][v][1] / both[1]) for v in start}
        reliability[kind] = rates
        seen: dict = defaultdict(lambda: [1.0, 1.0])
        whole = [2.0, 2.0]
        for (k, votes, features), n in counts.items():
            if k == kind:
                q = posterior[votes]
                whole = [whole[0] + n * q, whole[1] + n * (1 - q)]
                for f in (*features, *_vote_features(votes)):
                    seen[f] = [seen[f][0] + n * q, seen[f][1] + n * (1 - q)]
        bias[kind] = math.log(whole[0] / whole[1])
        for f, (yes, no) in seen.items():
            weight[kind, f] = math.log(yes / whole[0]) - math.log(no / whole[1])
    return Model(reliability, bias, weight)


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Train on the candidates of all texts. No candidates (or no rows) give a model that adds nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for piece in slices(batches):
            for body in piece["text"].to_pylist():
                if body:
                    spans, runs = base_spans(body)
                    seen.update((c.kind, c.votes, " ".join(c.features)) for c in candidates(body, spans, runs))
        rows = list(seen.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k, _ in rows], pa.string()) for i in range(3)] + [pa.array([n for _, n in rows], pa.int64())],
            ["kind", "votes", "features", "n"],
        )

    source = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    rows = source.mapInArrow(run, "kind string, votes string, features string, n bigint")
    totals = rows.groupBy("kind", "votes", "features").agg(F.sum("n").alias("n")).collect()
    return fit_counts(Counter({(r.kind, r.votes, tuple(r.features.split(" "))): r.n for r in totals}))


def annotate(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``base`` and ``spans``, the latter with the classifier's additions: (kind, start, end) in code points.

    Spans are ordered by start, then by kind as listed. Null and empty texts have none; repeated rows are treated alike
    and stay; a column of the same name is replaced. Texts of any length are read whole.
    """

    def task(piece: pa.RecordBatch) -> list[pa.Array]:
        base, whole = [], []
        for body in piece["text"].to_pylist():
            spans, runs = base_spans(body) if body else ([], [])
            base.append([{"kind": k, "start": s, "end": e} for s, k, e in spans])
            more = additions(body, spans, runs, model) if body else []
            if more:
                spans = sorted(spans + more, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))
            whole.append([{"kind": k, "start": s, "end": e} for s, k, e in spans])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return [pa.array(base, kind), pa.array(whole, kind)]

    return add_columns(docs, task, f"base {SPAN}, spans {SPAN}", text)


def mask_text(body: str | None, spans: list[dict] | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    if not body or not spans:
        return body
    out, at = [], 0
    for span in spans:
        if span["start"] >= at:
            out.append(body[at : span["start"]])
            out.append(f"<{span['kind'].upper()}>")
        at = max(at, span["end"])
    return "".join(out) + body[at:]


def masked(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the spans in the text masked; all columns stay."""

    def task(piece: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for body in piece["text"].to_pylist():
            spans, runs = base_spans(body) if body else ([], [])
            if body:
                spans = sorted(spans + additions(body, spans, runs, model))
            out.append(mask_text(body, [{"kind": k, "start": s, "end": e} for s, k, e in spans]))
        return [pa.array(out, pa.string())]

    names = docs.columns
    held = "__text"
    while held in (c.lower() for c in names):
        held += "_"
    masked_ = add_columns(docs.withColumnRenamed(text, held), task, f"`{text}` string", held)
    return masked_.select(*(f"`{c}`" for c in names))


def join_spans(spans) -> F.Column:
    """kind:start:end of every span, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")

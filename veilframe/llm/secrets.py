"""Secret scans by a linear-chain conditional random field (operator 10).

Three patterns give the base spans. The field tags tokens as secret begin, inside or outside from
their shape, neighbouring words and features of the whole text; Viterbi decodes. Begin or inside can
be tokens of eight characters with a digit, an inner capital or a hint and "=" before a value, tokens
of twenty characters, and tokens of six within three after a hint word (a hard constraint of the
field, in training as in decoding). All others are outside, so each run of such tokens, of any
length, decodes alone with the same result as over the whole text.

The field is trained on the driver from generated lines: secrets of many makes, and addresses,
numbers, versions, dates, paths and identifiers that are none. Its weights, a few hundred numbers,
go to the executors.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, kept

#: Fixed values of the base: kinds in order, their patterns, and the least length of what counts.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # of maximal runs only those of 20 or more can count
HEX = re.compile(r"[0-9a-f]{24,}")
_LIKELY = re.compile(r"passw|secret|token|api_?key", re.I | re.A)

_CHARS = "A-Za-z0-9+/_.=-"
_TOKEN = re.compile(rf"[{_CHARS}]+|[^\s{_CHARS}]")
_HINTS = frozenset("password passwd pwd pass secret token passphrase key apikey api_key auth authorization bearer credential credentials private access client_secret aws".split())
CONTEXT = 3  # tokens to each side that features look at
B, I, O = range(3)  # noqa: E741


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if _LIKELY.search(text) else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def hinted(token: str) -> bool:
    """Whether a token is a hint word or has one as a part."""
    word = token.lower()
    return word in _HINTS or not _HINTS.isdisjoint(re.split(r"[_.-]", word))


def assigns(token: str) -> bool:
    """Whether a token is a hint word, "=" and a value."""
    name, equals, value = token.partition("=")
    return bool(equals) and len(value) >= 4 and hinted(name)


_SHAPED, _HINT, _AFTER = 1, 2, 4


class _Flags(dict):
    """By token: may be secret by its shape, is a hint, may be secret after a hint."""

    def __missing__(self, token: str) -> int:
        n = len(token)
        out = _HINT if hinted(token) else 0
        if n >= 20 or (n >= 8 and (re.search(r"[0-9]|[a-z][A-Z]", token) or assigns(token))):
            out |= _SHAPED
        if n >= 6:
            out |= _AFTER
        if len(self) >= 200_000:
            self.clear()
        self[token] = out
        return out


_FLAGS = _Flags()
kept(_FLAGS)


def may_be_secret(tokens: list[str]) -> list[int]:
    """Places, in order, of the tokens that can be begin or inside."""
    flags, out = list(map(_FLAGS.__getitem__, tokens)), set()
    for i, f in enumerate(flags):
        if f & _SHAPED:
            out.add(i)
        if f & _HINT:
            out.update(j for j in range(i + 1, min(i + 1 + CONTEXT, len(flags))) if flags[j] & _AFTER)
    return sorted(out)


def shape(token: str) -> list[str]:
    """What a token looks like."""
    n, counts = len(token), Counter(token)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    up, low, dig = (sum(map(f, token)) for f in (str.isupper, str.islower, str.isdigit))
    kinds = ["A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else c for c in token]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:]))
    out = [f"len{min(n // 8, 6)}", f"size{min(n // 2, 10)}", f"ent{int(min(entropy, 5) * 2)}", f"turn{min(5, int(8 * turns / n))}", f"dig{int(4 * dig / n)}"]
    out += [name for name, yes in (("mixed", up and low), ("upper", up and not low), ("lower", low and not up), ("nodigit", not dig), ("alldigit", dig == n), ("hex", not re.search(r"[^0-9a-fA-F-]", token)), ("slash", "/" in token), ("dots", token.count(".") > 1), ("dot", "." in token), ("dashes", token.count("-") > 1), ("under", "_" in token), ("pad", token.endswith("=")), ("jwt", token.startswith("eyJ")), ("inner", re.search(r"[a-z][A-Z]", token)), ("assigns", assigns(token)), ("path", token[0] in "./"), ("words", re.fullmatch(r"[a-z]+(-[a-z]+)+", token)), ("sep", not re.search(r"[A-Za-z]{2}", token))) if yes]
    return out


def features(tokens: list[str], i: int, whole: list[str]) -> list[str]:
    """Shape of token i, words near it, and what the whole text has."""
    out = ["bias", *shape(tokens[i])]
    for d in range(1, CONTEXT + 1):
        for side, j in (("-", i - d), ("+", i + d)):
            if 0 <= j < len(tokens):
                word = tokens[j].lower()
                if _FLAGS[tokens[j]] & _HINT:
                    out.append(f"hint{side}{d}")
                if d == 1:
                    out.append(f"by{side}{word if word == 'is' or len(word) == 1 and not word.isalnum() else 'w'}")
            elif d == 1:
                out.append(f"edge{side}")
    return out + whole


_PAIR, _CODE = re.compile(r"\w\s?=\s?\S"), re.compile(r"[{};]")


def whole_features(text: str) -> list[str]:
    """What the whole text has: words of secrets, settings, marks of code, mail signs."""
    return ["text:hint" if _LIKELY.search(text) else "text:none", *(name for name, yes in (("text:pairs", _PAIR.search(text)), ("text:code", _CODE.search(text)), ("text:mail", "@" in text)) if yes)]


def _made(rng: random.Random) -> list[tuple[list[str], list[int]]]:
    """Generated lines as tokens and tags."""
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alnum = upper + lower + digit
    word = lambda: pick(lower, rng.randint(2, 11))
    def secret() -> str:
        x = rng.choice([
            lambda: rng.choice(["ghp_", "gho_", "glpat-", "npm_", "sk-", "pk_live_", "sk_test_", "xoxb-", "hf_"]) + pick(alnum, rng.randint(20, 40)),
            lambda: "AKIA" + pick(upper + digit, 16), lambda: pick(alnum + "+/", 40), lambda: pick(digit + "abcdef", rng.choice([24, 32, 40, 64])),
            lambda: "eyJ" + pick(alnum, 30) + "." + pick(alnum + "-_", 60) + "." + pick(alnum + "-_", 40), lambda: pick(alnum, rng.randint(20, 48)), lambda: pick(alnum + "+/", 42) + "==",
            lambda: "AIza" + pick(alnum + "-_", 35), lambda: "/" + pick(alnum + "+/", 39), lambda: pick(upper + lower, rng.randint(16, 40)),
        ])()
        return x
    def phrase() -> str:
        """A secret of letters that only the words before it show."""
        return rng.choice([
            lambda: "".join(word().capitalize() for _ in range(rng.randint(2, 5))), lambda: "-".join(word() for _ in range(rng.randint(3, 5))), lambda: pick(lower, rng.randint(12, 20)), lambda: pick(upper + lower, rng.randint(8, 24)), lambda: word() + pick(digit, rng.randint(2, 4)),
        ])()
    hint = lambda: (lambda x: rng.choice([x, x, x.capitalize(), x.upper()]))(rng.choice(sorted(_HINTS)))
    def other() -> str:
        return rng.choice([
            lambda: f"{word()}.{word()}{rng.randint(1, 99)}", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
            lambda: f"{rng.randint(200, 999)}-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}", lambda: pick(digit, rng.randint(8, 16)), lambda: f"{word()}-{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}",
            lambda: f"{word()}/{word()}/{word()}{rng.randint(1, 99)}.{rng.choice(['html', 'txt', 'py', 'png'])}", lambda: f"{word()}_{word()}_{rng.randint(1, 9999)}", lambda: f"{word()}{rng.randint(1, 9999)}{word()}", lambda: word().capitalize() + str(rng.randint(10, 9999)) + ".",
            lambda: f"https//{word()}.{word()}{rng.randint(0, 9)}.com/{word()}/{rng.randint(1, 99999)}", lambda: f"mail{rng.randint(1, 9)}.{word()}.com", lambda: f"{rng.randint(10, 23)}.{rng.randint(10, 59)}.{rng.randint(10, 59)}", lambda: word().upper() + "-" + pick(digit, rng.randint(4, 8)),
            lambda: "-".join(pick(digit + "abcdef", n) for n in (8, 4, 4, 4, 12)), lambda: "-".join(pick(digit + "abcdef", n) for n in (8, 4, 4, 4, 12)).upper(), lambda: pick(upper + digit, rng.randint(8, 12)), lambda: pick(digit + "abcdef", rng.randint(8, 12)),
            lambda: f"{word()}{rng.randint(1,9)}{word()}.{word()}", lambda: f"+{rng.randint(10, 99)}-{pick(digit, 9)}", lambda: f"{rng.randint(1, 99)}.{pick(digit, 6)}",
        ])()
    out = []
    for _ in range(2400):
        before = [word() for _ in range(rng.randint(3, 6))]
        after = [word() for _ in range(rng.randint(3, 6))]
        yes = rng.random() < 0.4
        lead = rng.choice([[], [rng.choice(sorted(_HINTS)), rng.choice("=:")], [rng.choice(sorted(_HINTS)), "=", '"'], ["bearer"], ['"'], ["key", "is"], [rng.choice(sorted(_HINTS))]] if yes else [[], [], ["@"], ["version"], ["order"], ["commit"], ["id", ":"], ["("], [word(), ":"], [word(), "="], ["token"], ['"'], ["$"], ["http", ":"]])
        token = secret() if yes else other()
        kind = rng.random()
        if yes and kind < 0.4:
            lead, token = rng.choice([lambda: ([], f"{hint()}={phrase()}"), lambda: ([hint(), ":"], phrase()), lambda: ([hint(), "is"], phrase()), lambda: (["Authorization", ":", "Bearer"], pick(upper + lower, rng.randint(16, 40))), lambda: ([hint(), ":", '"'], phrase()), lambda: ([], f"{hint()}={secret()}")])()
            while len(token) < 8 or (lead[1:] == ["is"] and len(token) < 12):
                token += pick(lower, 4)
        elif not yes and kind < 0.5:
            text = lambda: rng.choice([word(), pick(lower, rng.randint(6, 11)), pick(lower, rng.randint(6, 14)), f"{word()}-{word()}", word().capitalize()])
            lead, token = rng.choice([lambda: ([hint()], text()), lambda: ([hint(), "is"], pick(lower, rng.randint(3, 10))), lambda: ([hint(), word()], text()), lambda: ([hint(), ","], text()), lambda: ([hint(), "."], text().capitalize()), lambda: ([word(), ":"], text()), lambda: ([], word().capitalize() + word().capitalize()), lambda: ([], "-" * rng.randint(20, 60)), lambda: ([], "/" + "/".join(word() for _ in range(rng.randint(2, 6)))), lambda: ([], "-".join(word() for _ in range(4))), lambda: ([], "_".join(word() for _ in range(4))), lambda: ([], ".".join(word() for _ in range(4))), lambda: ([], pick(lower, rng.randint(20, 30)))])()
        tokens = [*before, *lead, token, *(['"'] if lead and lead[-1] == '"' else []), *after]
        tags = [O] * len(tokens)
        if not yes and rng.random() < 0.3:
            tokens.insert(len(before) + len(lead) + 1, pick(digit, rng.randint(8, 16)))
            tags.append(O)
        if yes:
            at = len(before) + len(lead)
            tags[at] = B
            if rng.random() < 0.1:
                tokens.insert(at + 1, pick(alnum, 16) + rng.choice(digit))
                tags.insert(at + 1, I)
        out.append((tokens, tags))
    return out


class Field:
    """Weights by feature and tag, and of tag pairs."""

    def __init__(self, names: list[str], emit: np.ndarray, move: np.ndarray) -> None:
        self.at, self.emit, self.move = {n: i for i, n in enumerate(names)}, emit, move

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        s = np.zeros((len(rows), 3))
        for i, row in enumerate(rows):
            for n in row:
                if (j := self.at.get(n)) is not None:
                    s[i] += self.emit[j]
        return s

    def viterbi(self, s: np.ndarray, last: bool = True) -> list[int]:
        """The best tags; before the first token stands an outside one, and, unless `last`, behind the last one."""
        best, back = self.move[O] + s[0], []
        for x in s[1:]:
            through = best[:, None] + self.move
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + x
        tags = [int((best if last else best + self.move[:, O]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


@lru_cache(maxsize=1)
def trained(seed: int = 10, rounds: int = 100) -> Field:
    """Maximum likelihood with a squared penalty, by gradient steps over all lines at once."""
    lines = _made(random.Random(seed))
    rows = [[features(t, i, whole) for i in range(len(t))] for t, _ in lines for whole in [whole_features(" ".join(t))]]
    names = sorted({n for r in rows for f in r for n in f})
    at = {n: i for i, n in enumerate(names)}
    size, longest = len(names), max(map(len, rows))
    x = np.zeros((len(lines), longest, size), np.float32)
    real, open_ = np.zeros((len(lines), longest), bool), np.zeros((len(lines), longest), bool)
    gold = np.full((len(lines), longest), O)
    for k, (r, (tokens, tags)) in enumerate(zip(rows, lines)):
        for i, f in enumerate(r):
            x[k, i, [at[n] for n in f]] = 1
        real[k, : len(r)], gold[k, : len(r)] = True, tags
        open_[k, may_be_secret(tokens)] = True
    flat = x.reshape(-1, size)
    one = np.eye(3)[gold] * real[..., None]
    emit, move = np.zeros((size, 3)), np.zeros((3, 3))
    move[O, I] = -1e9  # inside follows begin or inside
    speed = [np.zeros_like(emit), np.zeros_like(move)]
    pairs = np.einsum("kia,kib->ab", np.eye(3)[gold[:, :-1]] * real[:, 1:, None], one[:, 1:]) + np.outer(np.eye(3)[O], one[:, 0].sum(axis=0))
    log = lambda a, axis: (m := a.max(axis=axis)) + np.log(np.exp(a - np.expand_dims(m, axis)).sum(axis=axis))
    for _ in range(rounds):
        s = (flat @ emit.astype(np.float32)).reshape(len(lines), longest, 3).astype(float)
        s[..., :2] += np.where(open_, 0, -1e9)[..., None]
        s *= real[..., None]
        s[~real] = (-1e9, -1e9, 0)
        a = [move[O] + s[:, 0]]
        for i in range(1, longest):
            a.append(log(a[-1][:, :, None] + move, 1) + s[:, i])
        z = log(a[-1], 1)
        b = [np.zeros((len(lines), 3))]
        for i in range(longest - 1, 0, -1):
            b.append(log(move[None] + (s[:, i] + b[-1])[:, None, :], 2))
        a, b = np.stack(a, 1), np.stack(b[::-1], 1)
        p = np.exp(a + b - z[:, None, None]) * real[..., None]
        joint = np.exp(a[:, :-1, :, None] + move + (s[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        hope = joint.sum(axis=(0, 1)) + np.outer(np.eye(3)[O], p[:, 0].sum(axis=0))
        steps = [flat.T @ (one - p).reshape(-1, 3) / len(lines) - 1e-4 * emit, (pairs - hope) / len(lines)]
        steps[1][O, I] = 0
        for k, g in enumerate(steps):
            speed[k] = 0.9 * speed[k] + g
        emit, move = emit + 0.5 * speed[0], move + 0.5 * speed[1]
    return Field(names, emit, move)


def crf_spans(text: str, field: Field) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the field tags as secret."""
    names = _TOKEN.findall(text)
    places = may_be_secret(names)
    if not places:
        return []
    whole, tags, k = whole_features(text), {}, 0
    while k < len(places):
        first = k
        while k + 1 < len(places) and places[k + 1] == places[k] + 1:
            k += 1
        run = places[first : k + 1]
        k += 1
        tags.update(zip(run, field.viterbi(field.scores([features(names, i, whole) for i in run]), run[-1] == len(names) - 1)))
    if all(tag == O for tag in tags.values()):
        return []
    out = []
    for i, m in enumerate(_TOKEN.finditer(text)):
        tag = tags.get(i, O)
        if tag != O:
            e = m.start() + len(m[0].rstrip("."))
            if tag == I and out:
                out[-1] = (out[-1][0], 3, e)
            else:
                out.append((m.start(), 3, e))
    return out


def secret_spans(text: str | None, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base spans with those of the field that touch none of them."""
    if not text:
        return [], []
    base = base_spans(text)
    taken = sorted((s, e) for s, _, e in base)
    far, most = [], 0
    for _, e in taken:
        most = max(most, e)
        far.append(most)
    new = []
    for s, k, e in crf_spans(text, field):
        i = bisect.bisect_left(taken, (e, 0))  # those that start before e
        if not i or far[i - 1] <= s:
            new.append((s, k, e))
    return base, sorted(base + new)


def _line(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans. Rows are taken each for itself. An empty table gives an
    empty result. Spans are code points, end exclusive, by start, then kind.
    """
    field = field or trained()

    def run(batches):
        alone(_FLAGS)
        for b in batches:
            counts, sha, lines = [[], [], []], [], []
            for t in b.column(1):
                base, spans = secret_spans(t.as_py(), field)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                sha.append(hashlib.sha256(_line(base).encode()).hexdigest()), lines.append(_line(spans))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(lines, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(text: str | None, field: Field, by: str = "[SECRET]") -> str | None:
    """The text with each secret, overlapping spans as one, replaced."""
    spans = secret_spans(text, field)[1]
    if not spans:
        return text
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], by]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None = None, by: str = "[SECRET]") -> DataFrame:
    """docs with secrets in `text` replaced and n_chars, if it is there, counted anew; all columns and rows stay.

    Null and empty texts stay as they are, repeated rows are masked each for itself, and an empty table
    gives an empty one.
    """
    field = field or trained()
    at = docs.columns.index("text")

    def run(batches):
        alone(_FLAGS)
        for b in batches:
            new = pa.array([mask(t.as_py(), field, by) for t in b.column(at)], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), new)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

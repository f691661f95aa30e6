"""Secret scan: probabilistic automata inferred from labelled credentials.

Labelled values of each format become a prefix tree: a child for each class of
characters (letters and digits of a random string are one class, in words vowels,
other letters and digits are three; every mark is its own, and so is everything in
runs of one character, however long they are), and at each state the
counts of the characters that follow and of ends.  States are merged in red-blue
order, a blue one into the most likely compatible red one: compatible are states
whose next-character and end counts pass a two-sample chi-square test, as do those
of all their continuations.  The result is one probabilistic automaton for each
format.  Fixed prefixes, separators and lengths come out as chains of states (an
end is as improbable before the last of them as a wrong character), parts of any
length as loops.

Every candidate of a text (a run of 8 or more characters of tokens, however long,
from its first letter or digit to its last) is scored by all automata.  It is
reported when a credential format is likelier than all plain formats (words,
numbers, names of files, dates) by ODDS bits.  Candidates advance together for
their first STEPS characters; what is left of longer ones is walked one by one,
with the same result.

Fixed patterns (assign, access, hex) are found as well and always stay; the
automata only add spans that overlap none of these.  Offsets are code points,
ends exclusive.  Scanning is one pass over whole texts, without a shuffle; the
automata are about a megabyte and depend on the labelled values alone.

Defined results: a null or empty text has no spans (the digest of nothing);
repeated rows give equal rows; a null id stays null; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm.store import table
from statuta.llm.textkit import text_slices, word_hashes

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ia)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_CHARS, STEPS = 8, 1024
#: Bits by which a credential format must beat the plain ones.
ODDS = 16.0
#: States with fewer observations are not tested; what a state has for classes never seen there, in bits; counts that
#: smooth the characters of classes that were.
LEAST, FLOOR, PSEUDO = 24, -12.0, 48.0
_END = 256
_PIECES = np.zeros(256, bool)
_PIECES[[ord(c) for c in string.ascii_letters + string.digits + "+/_=.-"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[ord(c) for c in string.ascii_letters + string.digits]] = True
_SAME = np.arange(256, dtype=np.uint8)


def classes(spoken: bool) -> np.ndarray:
    """The class of each byte."""
    out = np.arange(256) + 3
    for c in string.ascii_letters + string.digits:
        out[ord(c)] = 0 if not spoken or c.lower() in "aeiouy" else 2 if c.isdigit() else 1
    return out


class Automaton:
    """emit: log2 probability of each byte at each state; to: the next state; end: log2 probability to end there."""

    def __init__(self, emit: np.ndarray, to: np.ndarray, end: np.ndarray):
        self.emit, self.to, self.end = emit, to, end

    @property
    def states(self) -> int:
        return len(self.end) - 1  # but for the one that has lost its way

    def bits(self, text: str) -> float:
        """log2 probability of text and its end."""
        state, total = 0, 0.0
        for c in text.encode():
            total += float(self.emit[state, c])
            state = int(self.to[state, c])
        return total + float(self.end[state])


def _differ(a: np.ndarray, b: np.ndarray, na: float, nb: float) -> bool:
    """Two-sample chi-square test of counts, with a margin of several of its standard deviations."""
    both = a + b
    seen = both > 0
    x, y, both = a[seen], b[seen], both[seen]
    size = na + nb
    ex, ey = both * (na / size), both * (nb / size)
    chi = (((x - ex) ** 2) / ex).sum() + (((y - ey) ** 2) / ey).sum()
    free = len(both) - 1
    return chi > free + 5 * math.sqrt(2 * max(free, 1)) + 4


def infer(values: list[str], spoken: bool = False, kind: np.ndarray | None = None) -> Automaton:
    """Merge the compatible states of the prefix tree of values; kind: the class of each byte."""
    kind = classes(spoken) if kind is None else kind
    rows = [v.encode() for v in values]
    used = np.append(np.unique(np.frombuffer(b"".join(rows), np.uint8)), _END)
    place = np.zeros(257, np.int64)
    place[used] = np.arange(len(used))
    count: list[np.ndarray] = [np.zeros(len(used))]
    child: list[dict[int, int]] = [{}]
    for row in rows:
        at = 0
        for c in row:
            count[at][place[c]] += 1
            if (k := int(kind[c])) not in child[at]:
                child[at][k] = len(child)
                child.append({})
                count.append(np.zeros(len(used)))
            at = child[at][k]
        count[at][place[_END]] += 1
    total = [float(c.sum()) for c in count]

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if min(total[a], total[b]) < LEAST:
                continue
            if _differ(count[a], count[b], total[a], total[b]):
                return False
            todo += [(child[a][s], child[b][s]) for s in child[a].keys() & child[b].keys() if (child[a][s], child[b][s]) != (a, b)]
        return True

    def likelihood(a: int, b: int) -> float:
        """Mean log probability of b's symbols under a's frequencies."""
        return float((count[b] * np.log((count[a] + 0.1) / (total[a] + 0.1 * len(used)))).sum()) / max(total[b], 1.0)

    def fold(a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            count[a] = count[a] + count[b]
            total[a] += total[b]
            for s, c in child[b].items():
                if s in child[a]:
                    todo.append((child[a][s], c))
                else:
                    child[a][s] = c

    red = [0]
    blue = [(0, s) for s in child[0]]
    while blue:
        parent, symbol = max(blue, key=lambda x: (total[child[x[0]][x[1]]], -x[0], -x[1]))
        node = child[parent][symbol]
        fits = [r for r in red if compatible(r, node)]
        if fits:
            best = max(fits, key=lambda r: (likelihood(r, node), -r))
            child[parent][symbol] = best
            fold(best, node)
        else:
            red.append(node)
        known = set(red)
        blue = [(r, s) for r in red for s, c in child[r].items() if c not in known]
    index = {r: i for i, r in enumerate(red)}
    lost = len(red)
    emit, to, end = np.full((lost + 1, 256), FLOOR, np.float32), np.full((lost + 1, 256), lost, np.int32), np.full(lost + 1, FLOOR, np.float32)
    end[lost] = -1.0
    every = np.bincount(np.frombuffer(b"".join(rows), np.uint8), minlength=256)
    for r, i in index.items():
        if spoken:
            to[i] = 0  # a plain value may begin anew, at a price; a credential may not
        open_to = np.array([c for c in used[:-1].tolist() if int(kind[c]) in child[r]], np.int64)
        ends = count[r][place[_END]] / total[r]
        if len(open_to):
            # beside what was seen here, PSEUDO counts as the whole format has its characters
            shared = every[open_to] / every[open_to].sum()
            p = (count[r][place[open_to]] + PSEUDO * shared) / (total[r] - count[r][place[_END]] + PSEUDO)
            emit[i, open_to] = np.log2(np.maximum(p * (1 - ends), 1e-9))
            to[i, open_to] = [index[child[r][int(kind[c])]] for c in open_to.tolist()]
        if ends:
            end[i] = math.log2(ends)
    return Automaton(emit, to, end)


def example_values(per_format: int = 300, seed: int = 3) -> dict[str, tuple[bool, list[str]]]:
    """Labelled values made by rule, with their kind: credential formats, and (spoken) plain ones."""
    rng = random.Random(seed)
    pick = lambda chars, n: "".join(rng.choices(chars, k=n))
    upper, lower, digits = string.ascii_uppercase, string.ascii_lowercase, string.digits
    alnum, hexes = upper + lower + digits, "0123456789abcdef"
    onsets = "t t t s s n r d l c m p b f h g w v th sh st tr ch pr k qu j pl gr br fr str z x sch pf zw schw".split() + [""] * 12
    nuclei = "e e e e a a a i i o o u y ea ou ie io ai ei au".split()
    codas = "n n n r r s s t t d l m nd nt st th ng ch sch ss x k p ble ly tion tz cht nth rst chs".split() + [""] * 14

    def word(least: int = 1, most: int = 6) -> str:
        return "".join(rng.choice(onsets) + rng.choice(nuclei) + rng.choice(codas) for _ in range(rng.randint(least, most)))

    def piece() -> str:
        return rng.choice([word, word, lambda: word().capitalize(), lambda: word(1, 2).upper(), lambda: pick(digits, rng.randint(1, 6))])()

    secrets = {
        "cloud_key": lambda: rng.choice(["AKIA", "ASIA"]) + pick(upper + "234567", 16),
        "code_token": lambda: "gh" + rng.choice("pos") + "_" + pick(alnum, 36),
        "pay_key": lambda: rng.choice("srp") + "k_" + rng.choice(["live", "test"]) + "_" + pick(alnum, 24),
        "chat_token": lambda: "xox" + rng.choice("bpa") + "-" + pick(digits, 11) + "-" + pick(digits, 12) + "-" + pick(alnum, 24),
        "web_token": lambda: "eyJ" + pick(alnum + "-_", rng.randint(15, 60)) + ".eyJ" + pick(alnum + "-_", rng.randint(30, 90)) + "." + pick(alnum + "-_", 42) + pick(alnum, 1),
        "uuid": lambda: "-".join(pick(hexes, n) for n in (8, 4, 4, 4, 12)),
        "hex_digest": lambda: pick(hexes, rng.choice((16, 20, 32, 40, 64))),
        "base64_key": lambda: pick(alnum + "+/", 39) + pick(alnum, 1),
        "mixed_token": lambda: pick(alnum, rng.choice((12, 16, 20, 24, 32, 40))),
        "small_token": lambda: pick(lower + digits, rng.choice((16, 20, 24, 32))),
        "letter_token": lambda: pick(lower, rng.choice((20, 24, 32))),
    }
    plain = {
        "plain_word": word,
        "plain_title": lambda: word().capitalize(),
        "plain_capitals": lambda: word().upper(),
        "plain_camel": lambda: (word(1, 2) if rng.random() < 0.5 else "") + "".join(word(1, 3).capitalize() for _ in range(rng.randint(1, 3))),
        "plain_joined": lambda: rng.choice("--_/.").join(piece() for _ in range(rng.randint(2, 6))),
        "plain_mixed": lambda: piece() + "".join(rng.choice("--__//..") + piece() for _ in range(rng.randint(1, 6))),
        "plain_file": lambda: "/".join([word(1, 2) + rng.choice(["", "", pick(digits, rng.randint(1, 4))]) for _ in range(rng.randint(1, 3))]) + "." + word(1, 1),
        "plain_host": lambda: rng.choice(["www.", "mail" + pick(digits, 1) + ".", ""]) + word(1, 3) + "." + rng.choice(["com", "org", "net", "de", "fr", "example.com"]) + rng.choice(["", "/" + word(1, 3)]),
        "plain_number": lambda: pick(digits, rng.randint(1, 24)),
        "plain_grouped": lambda: rng.choice("-./").join(pick(digits, rng.randint(1, 5)) for _ in range(rng.randint(2, 6))),
        "plain_numbered": lambda: rng.choice([word(1, 3), word(1, 2).capitalize(), word(1, 1).upper()]) + rng.choice(["", "-", "_", "."]) + pick(digits, rng.randint(1, 6)),
    }
    made = {k: (False, [f() for _ in range(per_format)]) for k, f in secrets.items()}
    made |= {k: (True, [f() for _ in range(per_format * 2)]) for k, f in plain.items()}
    return made | {"plain_run": (True, [c * rng.randint(8, 40) for c in alnum for _ in range(2 * LEAST)])}  # so many that a state for each is tested


@functools.lru_cache(maxsize=1)
def infer_all() -> dict[str, Automaton]:
    """The automata of example_values(), inferred once in a process."""
    return {name: infer(values, spoken, _SAME if name == "plain_run" else None) for name, (spoken, values) in example_values().items()}


class Formats:
    """All automata as one table of states, to score many candidates at once."""

    def __init__(self, automata: dict[str, Automaton]):
        self.names = list(automata)
        self.plain = np.array([n.startswith("plain") for n in self.names])
        first = np.cumsum([0, *[len(a.end) for a in automata.values()]])
        self.first = first[:-1]
        self.emit = np.concatenate([a.emit.ravel() for a in automata.values()])
        self.to = np.concatenate([(a.to + f).ravel() for a, f in zip(automata.values(), first, strict=False)]).astype(np.int32)
        self.end = np.concatenate([a.end for a in automata.values()])

    @functools.cached_property
    def lists(self) -> tuple[list[list[float]], list[list[int]], list[bool]]:
        """Of each state, as lists: emit, to, and whether it is never left and emits all alike."""
        emit, to = self.emit.reshape(-1, 256), self.to.reshape(-1, 256)
        stuck = (to == np.arange(len(to))[:, None]).all(1) & (emit == emit[:, :1]).all(1)
        return emit.tolist(), to.tolist(), stuck.tolist()

    def walk(self, state: int, bits: float, text: bytes) -> tuple[int, float]:
        """State and bits after text."""
        emit, to, stuck = self.lists
        for k, c in enumerate(text):
            if stuck[state]:
                return state, bits + emit[state][0] * (len(text) - k)
            bits += emit[state][c]
            state = to[state][c]
        return state, bits

    def leads(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the likeliest credential format, its lead over plain ones in bits) of each candidate."""
        sizes = end - start
        order = np.argsort(-sizes)
        start, sizes = start[order], sizes[order]
        state = np.repeat(self.first[:, None], len(start), axis=1)
        bits = np.zeros(state.shape)
        for t in range(min(int(sizes[0]), STEPS) if len(sizes) else 0):
            going = int(np.searchsorted(-sizes, -t))  # the longest come first
            at = state[:, :going] * 256 + data[start[:going] + t]
            bits[:, :going] += self.emit[at]
            state[:, :going] = self.to[at]
        for j in range(int(np.searchsorted(-sizes, -STEPS))):
            rest = data[start[j] + STEPS : start[j] + sizes[j]].tobytes()
            for i in range(len(self.names)):
                state[i, j], bits[i, j] = self.walk(int(state[i, j]), float(bits[i, j]), rest)
        bits += self.end[state]
        secret = np.where(self.plain[:, None], -np.inf, bits)
        best, lead = np.zeros(len(order), np.int64), np.zeros(len(order))
        best[order], lead[order] = secret.argmax(0), secret.max(0) - bits[self.plain].max(0)
        return best, lead


def candidates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the candidates of a slice, in bytes."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none
    inside = _PIECES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1]))
    end = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1
    core = np.flatnonzero(_ALNUM[data])
    if not len(core):
        return none, none, none
    a, b = np.searchsorted(core, start), np.searchsorted(core, end) - 1
    has = a <= b
    start, end = core[a[has]], core[b[has]] + 1
    fits = end - start >= LEAST_CHARS
    start, end = start[fits], end[fits]
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def found_in_slice(data: np.ndarray, offsets: np.ndarray, formats: Formats) -> tuple[dict[int, list[tuple[int, str, int]]], np.ndarray]:
    """(spans of likely credentials by row, in code points; the highest lead of each row)."""
    rows = len(offsets) - 1
    start, end, row = candidates(data, offsets)
    best_lead = np.zeros(rows)
    if not len(start):
        return {}, best_lead
    _, first, of = np.unique(word_hashes(data, start, end, _SAME), return_index=True, return_inverse=True)
    kind, lead = formats.leads(data, start[first], end[first])
    kind, lead = kind[of], lead[of]
    np.maximum.at(best_lead, row, lead)
    spans: dict[int, list[tuple[int, str, int]]] = {}
    for i in np.flatnonzero(lead >= ODDS).tolist():
        r = int(row[i])
        text = data[offsets[r] : offsets[r + 1]]
        a = int(((text[: start[i] - offsets[r]] & 0xC0) != 0x80).sum())
        spans.setdefault(r, []).append((a, formats.names[kind[i]], a + int(end[i] - start[i])))
    return spans, best_lead


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the fixed patterns, in order."""
    found = []
    low = text.lower()
    if "password" in low or "passwd" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _beside(base: list[tuple[int, int, int]], added: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    return [a for a in added if not any(s < a[2] and a[0] < e for s, _, e in base)]


def scan(text: str | None, automata: dict[str, Automaton] | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, str, int]]]:
    """(base spans, added spans) of one text."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    spans, _ = found_in_slice(data, np.array([0, len(data)]), Formats(automata or infer_all()))
    base = base_spans(text or "")
    return base, _beside(base, spans.get(0, []))


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long, best_lead double"


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", automata: dict[str, Automaton] | None = None) -> DataFrame:
    """Spans of secrets in each text: counts, digest of the base ones, all as a string."""
    sent = docs.sparkSession.sparkContext.broadcast(Formats(automata or infer_all()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formats = sent.value
        for batch in batches:
            for at, rows, data, offsets in text_slices(batch.column(1)):
                found, leads = found_in_slice(data, offsets, formats)
                counts: tuple[list, list, list] = ([], [], [])
                digests, spans, n_added = [], [], []
                for k, text in enumerate(batch.column(1).slice(at, rows)):
                    base = base_spans(text.as_py() or "")
                    added = _beside(base, found.get(k, []))
                    for j, of in enumerate(counts):
                        of.append(sum(1 for b in base if b[1] == j))
                    names = [(s, j, f"{KINDS[j]}:{s}:{e}") for s, j, e in base]
                    digests.append(hashlib.sha256(",".join(x[2] for x in names).encode()).hexdigest())
                    names += [(s, len(KINDS), f"{j}:{s}:{e}") for s, j, e in added]
                    spans.append(",".join(x[2] for x in sorted(names)))
                    n_added.append(len(added))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, rows), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans), pa.array(n_added, pa.int64()), pa.array(leads, pa.float64())],
                    names=[x.split()[0] for x in RESULT.split(", ")],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(task, RESULT)


def op10_grammar_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


QUERIES = {"op10_grammar_secrets": op10_grammar_secrets}
ORACLES: dict[str, str] = {}

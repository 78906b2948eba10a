"""Secret scans: fixed rules, and probabilistic automata inferred from what the rules label.

The rules label credentials in the corpus; long tokens that cannot be any (no
digit or no letter) are its background. A prefix tree of each class is folded: two states are merged when no
frequency of theirs differs by more than Hoeffding's bound allows, down their
common subtree, which gives a probabilistic automaton (states by random-looking
format, not by value). Every remaining token that could be a credential is
scored by its log-likelihood ratio per character under the two automata and
added as kind ``learned`` from the threshold on.

The automata are fitted on at most ``sample`` distinct values of each class,
those with the smallest hashes; finding and scoring covers every text in whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from math import log, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import text_of
from timberline.session import cut

# The rules, each with the least length of what it must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RULES = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
KINDS = ("assign", "access", "hex", "learned")

#: Runs of these of 16 or more, with a digit and a letter, can be credentials.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SAMPLE = 2_000
ALPHA = 0.01
#: Share of every step that goes to all symbols alike, known or not, in both automata.
UNKNOWN = 0.05
#: Quantiles of the held-out ratios of labelled values and of background between which the threshold lies.
LOW, HIGH = 0.05, 0.99
END = ""

SPANS = "struct<n_assign:long,n_access:long,n_hex:long,base:string,spans:string>"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the fixed rules; code points, end exclusive."""
    found = []
    for kind, pattern, group, least in RULES:
        if kind == "hex":  # a run of 32 or more begins where the leftmost match of any run begins
            found += [(m.start(), m.end(), kind) for m in _LONG_HEX.finditer(text)]
        else:
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return sorted(found, key=_order)


_LONG_HEX = re.compile(r"[0-9a-f]{32,}")


def _order(span: tuple[int, int, str]) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def values(text: str) -> tuple[list[str], list[str]]:
    """Labelled credentials and background tokens of a text."""
    base = base_spans(text)
    labelled = [m.group(2) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    labelled += [text[a:b] for a, b, kind in base if kind != "assign"]
    return labelled, [t for t in (text[a:b] for a, b in _long_tokens(text, base)) if not candidate(t)]


def _long_tokens(text: str, base: list[tuple[int, int, str]]):
    """Long runs outside the base spans."""
    for match in CANDIDATE.finditer(text):
        if not any(match.start() < b and a < match.end() for a, b, _ in base):
            yield match.span()


def candidate(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


# --- grammar inference ------------------------------------------------------------------------------------------


class Automaton:
    """A probabilistic deterministic automaton folded from a prefix tree of strings."""

    def __init__(self, strings: list[str], alpha: float = ALPHA, symbols: int | None = None):
        """``symbols``: how many there are in all; automata to be compared need the same number."""
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.spread = sqrt(log(2 / alpha) / 2)
        for string in sorted(strings):
            state = 0
            for char in string:
                self.count[state][char] = self.count[state].get(char, 0) + 1
                state = self.next[state].setdefault(char, len(self.next))
                if state == len(self.count):
                    self.next.append({})
                    self.count.append({})
            self.count[state][END] = self.count[state].get(END, 0) + 1
        self._fold()
        self._finish(symbols or count_symbols(strings))

    def _fold(self) -> None:
        """Red states are final; each blue state (a child of a red one) merges into the first compatible red, or turns red."""
        red, blue = [0], sorted((c, 0) for c in self.next[0])
        while blue:
            char, parent = blue.pop(0)
            state = self.next[parent][char]
            if state in red:
                continue
            for goal in red:
                if self._compatible(goal, state):
                    self.next[parent][char] = goal
                    self._merge(goal, state)
                    break
            else:
                red.append(state)
            inside = set(red)
            blue = sorted({(c, r) for r in red for c, s in self.next[r].items() if s not in inside}, key=lambda x: (red.index(x[1]), x[0]))
        self.states = red

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if a == b:
                continue
            one, two = self.count[a], self.count[b]
            n, m = sum(one.values()), sum(two.values())
            if not n or not m:
                continue
            limit = self.spread * (1 / sqrt(n) + 1 / sqrt(m))
            if any(abs(one.get(c, 0) / n - two.get(c, 0) / m) > limit for c in one.keys() | two.keys()):
                return False
            stack += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def _merge(self, a: int, b: int) -> None:
        """Add the subtree of ``b`` to ``a``."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            for char, n in self.count[b].items():
                self.count[a][char] = self.count[a].get(char, 0) + n
            for char, child in self.next[b].items():
                if char in self.next[a]:
                    if self.next[a][char] != child:
                        stack.append((self.next[a][char], child))
                else:
                    self.next[a][char] = child

    def _finish(self, symbols: int) -> None:
        place = {s: k for k, s in enumerate(self.states)}
        self.table = []
        for state in self.states:
            total = sum(self.count[state].values())
            logs = {c: log((1 - UNKNOWN) * n / total + UNKNOWN / symbols) for c, n in self.count[state].items()}
            self.table.append((logs, {c: place[s] for c, s in self.next[state].items()}))
        self.unknown = log(UNKNOWN / symbols)
        del self.next, self.count

    def score(self, string: str) -> float:
        """Log-likelihood; an unknown step has one price in all states and leads to the first one."""
        state, total = 0, 0.0
        for char in string:
            logs, step = self.table[state]
            total += logs.get(char, self.unknown)
            state = step.get(char, 0)
        return total + self.table[state][0].get(END, self.unknown)


def count_symbols(strings: list[str]) -> int:
    """Characters, the end, and one for all others."""
    return len({c for s in strings for c in s}) + 2


@dataclass(frozen=True)
class SecretModel:
    """Both automata and the ratio per character from which a token is a credential; no automata: nothing is added."""

    secret: Automaton | None = None
    background: Automaton | None = None
    threshold: float = field(default=float("inf"))

    def ratio(self, token: str) -> float:
        return (self.secret.score(token) - self.background.score(token)) / (len(token) + 1)


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> SecretModel:
    """Automata from at most ``sample`` distinct labelled values and background tokens of the documents.

    The threshold lies midway between the lowest twentieth of the labelled values and the highest hundredth of the
    background, by ratios held out: each half of the values is scored by automata of the other.
    """
    def gather(batches):
        for batch in batches:
            kind, value = [], []
            for text in batch.column("text").to_pylist():
                labelled, other = values(text)
                kind += [1] * len(labelled) + [0] * len(other)
                value += labelled + other
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(value, pa.string())], ["secret", "value"])

    found = docs.select(text_of(text_col).alias("text")).mapInArrow(gather, "secret int, value string")
    found = cut(found.distinct(), "labelled")
    chosen = []
    for kind in (1, 0):
        own = found.filter(F.col("secret") == kind).orderBy(F.xxhash64("value"), "value").limit(sample)
        chosen.append([r.value for r in own.collect()])
    secret, other = chosen
    if not secret or not other:
        return SecretModel()
    return learn(secret, other)


def learn(secret: list[str], other: list[str]) -> SecretModel:
    """The model of labelled values and background tokens, both in random order and not empty."""
    symbols = count_symbols(secret + other)

    def model(one: list[str], two: list[str]) -> SecretModel:
        return SecretModel(Automaton(one, symbols=symbols), Automaton(two, symbols=symbols))

    high, low = [], []
    for (fit_one, out_one), (fit_two, out_two) in zip(_halves(secret), _halves(other), strict=True):
        half = model(fit_one, fit_two)
        high += map(half.ratio, out_one)
        low += map(half.ratio, out_two)
    threshold = (sorted(high)[int(len(high) * LOW)] + sorted(low)[int(len(low) * HIGH)]) / 2
    whole = model(secret, other)
    return SecretModel(whole.secret, whole.background, threshold)


def _halves(strings: list[str]) -> list[tuple[list[str], list[str]]]:
    """Both ways to fit on a half and score the other; a single value is fitted and scored itself."""
    one, two = strings[::2], strings[1::2] or strings
    return [(one, two), (two, one)]


# --- scan -------------------------------------------------------------------------------------------------------


def spans(text: str, model: SecretModel) -> tuple[list, list]:
    """Base spans, and all spans, each in order."""
    base = base_spans(text)
    added = []
    if model.secret is not None:
        for a, b in _long_tokens(text, base):
            token = text[a:b]
            if candidate(token) and model.ratio(token) >= model.threshold:
                added.append((a, b, "learned"))
    return base, sorted(base + added, key=_order)


def scan(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, s)`` per row: counts per rule, base spans and all spans as ``kind:start:end`` joined by commas.

    A null or empty text has no spans; null ids and repeated rows stay; other columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            base, every = spans(text, model)
            kinds = [k for *_, k in base]
            rows.append((*map(kinds.count, KINDS[:3]), *(",".join(f"{k}:{a}:{b}" for a, b, k in x) for x in (base, every))))
        types = [pa.int64()] * 3 + [pa.string()] * 2
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                          ["n_assign", "n_access", "n_hex", "base", "spans"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    find = F.arrow_udf(run, SPANS).asNondeterministic()
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t")).select("id", find(F.col("t")).alias("s"))

"""Toxicity: a weighted finite-state grammar over clauses.

The lexicon transducer reads a token and writes its class: an insult (learned whole words and word beginnings, weighted by
log odds), a threat, a target, a negation, reported speech, or none. Five small transducers read these classes: negation
marks the insults and threats within a few tokens after it, reported speech those after the verb up to the end of the
sentence, and one each keeps the insult, the threat and the target of a clause. They are composed into one machine, which
writes the matched pattern at the end of a clause; each pattern has a learned weight. A document's score comes from its
matched clauses, not from single words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterable
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriskill.llm.common import arrow_stage, hashed_sample

#: Of the labelled rows outside the held-out fold, at most this many, chosen by the hash of their id, are learned from.
SAMPLE_ROWS = 8_000
STEMS = range(4, 8)  # lengths of learned word beginnings
LEAST_DOCS, LEAST_ODDS = 5, 3.0
TOKEN = re.compile(r"[^\W_]+|[.!?;:\n]")
MARKS = frozenset(".!?;:\n")
SCOPE = 4  # tokens after a negation that it reaches

# Closed classes of the grammar, English, German, French and Spanish.
THREAT = frozenset("kill hurt destroy beat burn shoot stab hang töten umbringen schlagen tuer tuerai frapper brûler matar mataré golpear quemar".split())
TARGET = frozenset("you your yours u they them these those people du dich dir dein ihr euch sie tu te toi vous vos ils eux tú ti usted ustedes vosotros ellos".split())
NEGATION = frozenset("not no never none nobody isn aren don doesn nicht kein keine nie niemals ne pas jamais aucun ni nunca jamás ningún".split())
REPORT = frozenset("said says wrote writes called quoted claimed reported sagte schrieb behauptete nannte dit écrit affirme dijo escribió afirmó llamó".split())

#: Classes that the lexicon transducer writes; COLON and STOP stand for punctuation.
OTHER, INSULT, THREATEN, AIM, DENY, TELL, COLON, STOP = range(8)
#: What negation and reported speech make of insults and threats.
DENIED_INSULT, DENIED_THREAT, TOLD_INSULT, TOLD_THREAT = range(8, 12)
#: Matched patterns of a clause: insult or threat, aimed or not, then weakened by negation or reported speech.
PATTERNS = ("insult", "insult_aimed", "threat_aimed", "insult_denied", "insult_told", "threat_denied_or_told")


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: arcs lead from (state, symbol) to (state, what is written)."""

    start: Hashable
    arcs: dict[tuple[Hashable, int], tuple[Hashable, Hashable]]

    @staticmethod
    def of(start: Hashable, symbols: Iterable[int], step: Callable[[Hashable, int], tuple[Hashable, Hashable]]) -> Transducer:
        """All states that can be reached from `start` over `symbols`."""
        arcs, open_, symbols = {}, [start], tuple(symbols)
        seen = {start}
        while open_:
            state = open_.pop()
            for symbol in symbols:
                arcs[state, symbol] = after, _ = step(state, symbol)
                if after not in seen:
                    seen.add(after)
                    open_.append(after)
        return Transducer(start, arcs)

    def then(self, other: Transducer) -> Transducer:
        """Composition: `other` reads what this one writes."""

        def step(state, symbol):
            mine, written = self.arcs[state[0], symbol]
            theirs, out = other.arcs[state[1], written]
            return (mine, theirs), out

        return Transducer.of((self.start, other.start), {s for _, s in self.arcs}, step)

    def beside(self, other: Transducer) -> Transducer:
        """Both read the same symbols; what they write is put together."""

        def step(state, symbol):
            (mine, out), (theirs, more) = self.arcs[state[0], symbol], other.arcs[state[1], symbol]
            return (mine, theirs), (*(out if isinstance(out, tuple) else (out,)), more)

        return Transducer.of((self.start, other.start), {s for _, s in self.arcs}, step)


def _negation(left: int, symbol: int) -> tuple[int, int]:
    if symbol == DENY:
        return SCOPE, OTHER
    if symbol in (STOP, COLON):
        return 0, symbol
    return max(0, left - 1), {INSULT: DENIED_INSULT, THREATEN: DENIED_THREAT}.get(symbol, symbol) if left else symbol


def _report(told: bool, symbol: int) -> tuple[bool, int]:
    if symbol == TELL:
        return True, OTHER
    return told and symbol != STOP, {INSULT: TOLD_INSULT, THREATEN: TOLD_THREAT}.get(symbol, symbol) if told else symbol


def _keeper(kinds: tuple[int, ...]) -> Callable[[int, int], tuple[int, int]]:
    """Keeps the strongest of `kinds` (the strongest last) in a clause, and writes it at its end: 0 for none."""
    return lambda best, symbol: (0, best) if symbol in (STOP, COLON) else (max(best, kinds.index(symbol) + 1 if symbol in kinds else 0), 0)


def _clause_machine() -> Transducer:
    classes, marked = range(8), (OTHER, INSULT, THREATEN, AIM, COLON, STOP, DENIED_INSULT, DENIED_THREAT)
    negation, report = Transducer.of(0, classes, _negation), Transducer.of(False, (*marked, TELL), _report)
    read = (*marked, TOLD_INSULT, TOLD_THREAT)
    insult, threat, target = (Transducer.of(0, read, _keeper(k)) for k in ((DENIED_INSULT, TOLD_INSULT, INSULT), (DENIED_THREAT, TOLD_THREAT, THREATEN), (AIM,)))
    return negation.then(report).then(insult.beside(threat).beside(target))


def pattern_of(found: tuple[int, int, int]) -> int:
    """The index of the pattern of a clause with this insult, threat and target; -1 for none."""
    insult, threat, target = found
    if insult:
        return (3, 4, 1 if target else 0)[insult - 1]
    return -1 if not threat or not target else 2 if threat == 3 else 5


def _tables(machine: Transducer) -> tuple[list[list[int]], list[list[int]]]:
    """Next state and written pattern by state number and class; the start is state 0."""
    number = {machine.start: 0}
    for state, _ in machine.arcs:
        number.setdefault(state, len(number))
    after, out = ([[0] * 8 for _ in number] for _ in range(2))
    for (state, symbol), (to, found) in machine.arcs.items():
        after[number[state]][symbol], out[number[state]][symbol] = number[to], pattern_of(found)
    return after, out


NEXT, WRITES = _tables(_clause_machine())


@dataclass
class Grammar:
    words: dict[str, float]
    stems: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(PATTERNS)))
    bias: float = -2.0

    def __post_init__(self) -> None:
        self.forms = self.automaton()

    def __getstate__(self) -> tuple:
        return self.words, self.stems, self.weights, self.bias

    def __setstate__(self, state: tuple) -> None:
        self.words, self.stems, self.weights, self.bias = state
        self.forms = self.automaton()

    def automaton(self) -> ahocorasick.Automaton:
        """All insults and threats, each with its length and whether it is a whole token: one pass finds any of them."""
        out = ahocorasick.Automaton()
        for w in {*self.words, *THREAT, *self.stems}:
            out.add_word(w, (len(w), w not in self.stems))
        out.make_automaton()
        return out

    def may_match(self, lowered: str) -> bool:
        """Whether an insult or a threat stands in the text as a token, or begins one."""
        for last, (size, whole) in self.forms.iter(lowered):
            before = last - size
            if (before < 0 or not lowered[before].isalnum()) and not (whole and lowered[last + 1 : last + 2].isalnum()):
                return True
        return False

    def lexicon(self, token: str) -> tuple[int, float]:
        weight = self.words.get(token)
        if weight is None:
            weight = max((self.stems[token[:k]] for k in STEMS if token[:k] in self.stems and len(token) >= k), default=None)
        if weight is not None:
            return INSULT, weight
        for kind, members in ((THREATEN, THREAT), (DENY, NEGATION), (TELL, REPORT), (AIM, TARGET)):
            if token in members:
                return kind, float(kind == THREATEN)
        return OTHER, 0.0

    def clauses(self, text: str | None, memo: dict[str, tuple[int, float]]) -> np.ndarray:
        """For each pattern, the summed weight of the clauses that match it."""
        out = np.zeros(len(PATTERNS))
        lowered = (text or "").lower()
        if not self.may_match(lowered):
            return out  # a clause matches only where an insult or a threat stands in it
        state, weight = 0, 0.0
        for token in [*TOKEN.findall(lowered), "."]:
            if token in MARKS:
                symbol = COLON if token == ":" else STOP
                if (p := WRITES[state][symbol]) >= 0:
                    out[p] += weight
                state, weight = NEXT[state][symbol], 0.0
                continue
            got = memo.get(token)
            if got is None:
                if len(memo) > 200_000:
                    memo.clear()
                got = memo[token] = self.lexicon(token)
            state = NEXT[state][got[0]]
            weight += got[1]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(np.log1p(x) @ self.weights + self.bias, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def _learn_lexicon(texts: DataFrame) -> Grammar:
    """Words and word beginnings that mark toxic rows, with their log odds.

    Counted over all of `texts` (toxic, text); only those in at least LEAST_DOCS toxic rows reach the driver.
    """

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            words = {t for t in TOKEN.findall((text or "").lower()) if t not in MARKS}
            seen[label].update(words)
            seen[label].update({t[:k] + "*" for t in words for k in STEMS if len(t) >= k})
        keys = list(seen[0] | seen[1])
        return {"form": keys, "tame": [seen[0][k] for k in keys], "foul": [seen[1][k] for k in keys]}

    n = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    foul, tame = n.get(1, 0), n.get(0, 0)
    forms = arrow_stage(texts, each, "form string, tame bigint, foul bigint").groupBy("form").agg(F.sum("tame").alias("tame"), F.sum("foul").alias("foul"))
    odds = F.log((F.col("foul") + 0.5) / (foul + 1.0)) - F.log((F.col("tame") + 0.5) / (tame + 1.0))
    got = forms.where(F.col("foul") >= LEAST_DOCS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).collect()
    words = {r.form: (r.foul, r.odds) for r in got if r.form[-1] != "*"}
    stems: dict[str, float] = {}
    for r in sorted((r for r in got if r.form[-1] == "*"), key=lambda r: (-r.foul, -len(r.form))):  # the most common, then the longest
        stem = r.form[:-1]
        widest = max((c for w, (c, _) in words.items() if w.startswith(stem)), default=LEAST_DOCS)
        if r.foul >= 1.5 * widest and not any(stem.startswith(s) or s.startswith(stem) for s in stems):
            stems[stem] = r.odds
    return Grammar({w: o for w, (_, o) in words.items()}, stems)


def fit_grammar(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, toxic: str = "toxic") -> Grammar:
    """A grammar learned from at most `rows` labelled documents outside the held-out fold.

    Rows without a 0 or 1 label take no part; with no toxic row the lexicon is empty and scores are low.
    """
    known = labels.where(F.col(toxic).isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col(toxic).cast("int").alias("toxic"))
    some = hashed_sample(known, "doc_id", rows)  # at most `rows` ids: bounded, so it may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("toxic", "text")
    grammar = _learn_lexicon(texts)
    got = _clause_stage(texts, grammar, "toxic", "int").collect()
    x = np.log1p(np.array([r.clauses for r in got], float).reshape(-1, len(PATTERNS)))
    y = np.array([r.toxic for r in got], float)
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.concatenate([grammar.weights, [grammar.bias]])
    ridge = np.diag([*[1e-2] * len(PATTERNS), 1e-3])
    for _ in range(30 if len(y) else 0):  # Newton steps of a ridge logistic regression on the pattern weights
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + ridge, x1.T @ (p - y) + ridge @ w)
        w = w - np.clip(step, -2, 2)
    grammar.weights, grammar.bias = np.maximum(w[:-1], 0), float(min(w[-1], -0.5))
    return grammar


def _clause_stage(df: DataFrame, grammar: Grammar, key: str, kind: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(grammar)

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        memo: dict[str, tuple[int, float]] = {}
        x = np.array([shared.value.clauses(t, memo) for t in batch.column("text").to_pylist()])
        return {key: batch.column(key), "clauses": list(x), "score": shared.value.score(x)}

    return arrow_stage(df.select(key, "text"), each, f"{key} {kind}, clauses array<double>, score double")


def score_toxicity(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5), clauses (weight by pattern), for every row.

    Reads doc_id and text alone, the score only text; one narrow Arrow pass. Null and empty texts match no clause and
    get the base score, under 0.5; a very long text is read whole, clause by clause. Repeated rows are scored alike; an
    empty table gives an empty frame. Other columns are dropped, whatever their names.
    """
    out = _clause_stage(docs, grammar, "doc_id", docs.schema["doc_id"].dataType.simpleString())
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses")


def keep_civil(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """Those rows of `docs`, with all their columns, whose score is under 0.5 (null and empty texts too); one narrow Arrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        memo: dict[str, tuple[int, float]] = {}
        x = np.array([shared.value.clauses(t, memo) for t in batch.column("text").to_pylist()])
        kept = batch.filter(pa.array(shared.value.score(x) < 0.5))
        return {n: kept.column(i) for i, n in enumerate(kept.schema.names)}

    return arrow_stage(docs, each, ddl)

"""The query language: one short normalised text as terms, concepts, constraints and a compatibility context.

At each token the scan tries a context phrase, a constraint, then an alias, exact or misspelled; what nothing takes is a term unless it
is a stopword. Vocabulary comes from ``lexicon``; nothing here depends on a language.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from dataclasses import asdict, dataclass, field

from wayfind.plans.lexicon import Lexicon


#: Places of numbers in patterns of ranges.
NUMBERS = ("{a}", "{b}")


@dataclass
class Parsed:
    terms: list[dict] = field(default_factory=list)
    concepts: list[dict] = field(default_factory=list)
    constraints: list[dict] = field(default_factory=list)
    context: str | None = None
    target: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def as_row(self) -> tuple:
        return tuple(asdict(self).values())


@dataclass(frozen=True)
class Number:
    value: float
    used: int
    multiplied: bool = False


def edits_allowed(length: int) -> int:
    return 0 if length <= 3 else 1 if length <= 5 else 2 if length <= 9 else 3


def osa_distance(a: bytes, b: bytes, most: int | None = None) -> int:
    """Restricted Damerau-Levenshtein distance of two short byte strings. most: a distance above it is only told to be so."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if most is not None and min(row) > most and min(last) > most:  # all that follows is made of these two rows
            return most + 1
        before, last = last, row
    return last[-1]


class PhraseBook:
    """Phrases by first word, longest first; and, for misspellings, by trigram."""

    def __init__(self, entries: list[tuple[tuple[str, ...], object]]):
        self.first: dict[str, list[tuple[tuple[str, ...], object]]] = defaultdict(list)
        self.spelled: dict[str, object] = {}
        #: Trigrams of each phrase with its length in bytes: only phrases of about a text's length can be near it.
        self.sized: list[tuple[int, str, list[bytes]]] = []
        for words, value in entries:
            if not words:
                continue
            self.first[words[0]].append((words, value))
            if (phrase := " ".join(words)) not in self.spelled:
                self.spelled[phrase] = value
                self.sized.append((len(phrase.encode()), phrase, self._grams(phrase)))
        for of in self.first.values():
            of.sort(key=lambda e: -len(e[0]))
        self.near = functools.lru_cache(1 << 15)(self._near)  # words of texts repeat
        self.in_reach = functools.lru_cache(1 << 10)(self._in_reach)

    @staticmethod
    def _grams(text: str) -> list[bytes]:
        data = text.encode()
        padded = b"$" + data + b"$"
        return [padded[i : i + 3] for i in range(len(padded) - 2)] if len(data) >= 3 else []

    def at(self, tokens: list[str], i: int) -> tuple[int, object] | None:
        """(number of words, value) of the longest phrase that begins at i."""
        for words, value in self.first.get(tokens[i], ()) if i < len(tokens) else ():
            if tuple(tokens[i : i + len(words)]) == words:
                return len(words), value
        return None

    def _in_reach(self, length: int, allowed: int) -> dict[bytes, list[str]]:
        """Phrases by trigram, as often as they have it, of those whose length may be within the edits allowed; empty for lengths beyond all phrases."""
        out: dict[bytes, list[str]] = {}
        for n, phrase, grams in self.sized:
            if abs(n - length) <= allowed:
                for g in grams:
                    out.setdefault(g, []).append(phrase)
        return out

    def _near(self, text: str, allowed: int, one_word: bool = False) -> tuple[int, str] | None:
        """(distance, phrase) of the closest phrase within the edits allowed: most shared trigrams first, then in order of spelling."""
        data = text.encode()
        if not (reach := self.in_reach(len(data), allowed)):
            return None
        shared: dict[str, int] = defaultdict(int)
        grams = self._grams(text)
        for g in grams:
            for phrase in reach.get(g, ()):
                shared[phrase] += 1
        least = max(1, len(grams) - 3 * allowed)
        enough = [p for p, n in shared.items() if n >= least]
        enough = sorted(enough, key=lambda p: (-shared[p], p))[:200]
        best = None
        for p in enough:  # of equal distances the first counts, so a later one must be closer
            if not (one_word and " " in p) and (distance := osa_distance(data, p.encode(), allowed)) <= allowed:
                best, allowed = (distance, p), distance - 1
        return best


class Parser:
    def __init__(self, locales: tuple[str, ...] = ("en",), lexicon: Lexicon | None = None):
        self.lexicon = lexicon or Lexicon.load(locales)
        lex = self.lexicon
        self.aliases = PhraseBook(lex.aliases)
        self.compat, self.selected = PhraseBook([(p, None) for p in lex.compat]), PhraseBook([(p, None) for p in lex.selected])
        self.ranges = sorted(lex.ranges, key=len, reverse=True)
        self.operators = sorted(lex.operators, key=lambda o: -len(o[1]))
        #: What may begin with a word, in order. Patterns that begin with a number may begin with any word that is one.
        self.number_value = functools.lru_cache(1 << 15)(self._number_value)
        begins = {p[0] for p in self.ranges if p} | {w[0] for _, w in self.operators if w}
        self.ranges_at = {b: [p for p in self.ranges if not p or p[0] in (b, *NUMBERS)] for b in begins}
        self.ranges_else = [p for p in self.ranges if not p or p[0] in NUMBERS]
        self.operators_at = {b: [o for o in self.operators if not o[1] or o[1][0] == b] for b in begins}
        self.operators_else = [o for o in self.operators if not o[1]]

    # ---- numbers and units

    def _number_value(self, token: str) -> float | None:
        """Digits with the locale's separators. The last separator is decimal if it is the decimal one or no three digits follow."""
        decimal, thousands = self.lexicon.decimal, self.lexicon.thousands
        if not re.fullmatch(f"[0-9{re.escape(decimal + thousands)}]*[0-9][0-9{re.escape(decimal + thousands)}]*", token):
            return None
        separators = [c for c in token if not c.isdigit()]
        groups = re.split("[^0-9]", token)
        if not separators:
            return float(token)
        if separators[-1] == decimal or len(groups[-1]) != 3:
            whole = "".join(groups[:-1])
            return float(f"{whole}.{groups[-1]}") if whole and groups[-1] else None
        return float("".join(groups)) if all(len(g) == 3 for g in groups[1:]) else None

    def number(self, tokens: list[str], i: int) -> Number | None:
        if i >= len(tokens):
            return None
        if (value := self.lexicon.spelled.get(tokens[i])) is not None:
            return Number(value, 1)
        if (value := self.number_value(tokens[i])) is None:
            return None
        factor = self.lexicon.multipliers.get(tokens[i + 1]) if i + 1 < len(tokens) else None
        return Number(value, 1) if factor is None else Number(value * factor, 2, True)

    def unit(self, tokens: list[str], i: int) -> tuple[str, float, str, int] | None:
        """(quantity, factor, unit, words)."""
        for n in (2, 1):
            if i + n <= len(tokens) and (of := self.lexicon.unit(" ".join(tokens[i : i + n]))):
                return (*of, n)
        return None

    def money(self, tokens: list[str], i: int) -> int:
        return int(i < len(tokens) and self.lexicon.is_money_sign(tokens[i]))

    # ---- constraints

    def _range(self, pattern: list[str], tokens: list[str], i: int) -> dict | None:
        at, numbers = i, {}
        for part in pattern:
            if part in NUMBERS:
                if (n := self.number(tokens, at)) is None:
                    return None
                numbers[part] = n
                at += n.used
            elif at < len(tokens) and tokens[at] == part:
                at += 1
            else:
                return None
        quantity, factor, unit = None, 1.0, None
        if used := self.money(tokens, at):
            quantity, at = "money", at + used
        elif of := self.unit(tokens, at):
            quantity, factor, unit, used = of
            at += used
        ends = sorted(n.value * factor for n in numbers.values())
        return self._constraint(quantity, "between", ends[0], ends[1], unit, factor, at - i, list(numbers.values()))

    def _amount(self, tokens: list[str], at: int, begin: int, op: str | None) -> dict | None:
        """A number with money before or a unit after; without ``op`` one of them must be there."""
        quantity, factor, unit = None, 1.0, None
        if used := self.money(tokens, at):
            quantity, at = "money", at + used
        if (n := self.number(tokens, at)) is None:
            return None
        at += n.used
        if quantity is None and (of := self.unit(tokens, at)):
            quantity, factor, unit, used = of
            at += used
        if quantity is None and op is None:
            return None
        v = n.value * factor
        low, high = {"gt": (v, None), "gte": (v, None), "lt": (None, v), "lte": (None, v), "approx": (v * 0.9, v * 1.1), None: (v * 0.95, v * 1.05)}[op]
        return self._constraint(quantity, op or "between", low, high, unit, factor, at - begin, [n])

    @staticmethod
    def _constraint(quantity, op, low, high, unit, factor, used, numbers: list[Number]) -> dict:
        """A number without a unit is money if it was multiplied or is 1000 or more."""
        if quantity is None and (any(n.multiplied for n in numbers) or max(abs(n.value) for n in numbers) >= 1000):
            quantity = "money"
        return {"quantity": quantity, "op": op, "low": low, "high": high, "unit": unit, "factor": factor, "used": used}

    def constraint(self, tokens: list[str], i: int) -> dict | None:
        for pattern in self.ranges_at.get(tokens[i], self.ranges_else):
            if found := self._range(pattern, tokens, i):
                return found
        for op, words in self.operators_at.get(tokens[i], self.operators_else):
            if tokens[i : i + len(words)] == words and (found := self._amount(tokens, i + len(words), i, op)):
                return found
        return self._amount(tokens, i, i, None)

    # ---- concepts and contexts

    def concept(self, tokens: list[str], i: int) -> tuple[int, str, str, float] | None:
        """(words, kind, value, confidence)."""
        if found := self.aliases.at(tokens, i):
            return found[0], *found[1], 1.0
        for n in (3, 2, 1):
            if i + n > len(tokens):
                continue
            text = " ".join(tokens[i : i + n])
            allowed = edits_allowed(len(text.replace(" ", "")) if n > 1 else len(text.encode()))
            if allowed and (near := self.aliases.near(text, allowed, one_word=n == 1)):
                return n, *self.aliases.spelled[near[1]], 1 - near[0] / max(len(text.encode()), len(near[1].encode()))
        return None

    def context(self, tokens: list[str], i: int) -> tuple[int, str, list[str]] | None:
        """(words, what is meant, target's words): a phrase such as "fits", then "this" or all the rest."""
        if not (found := self.compat.at(tokens, i)):
            return None
        at = i + found[0]
        if chosen := self.selected.at(tokens, at):
            return found[0] + chosen[0], "selected", []
        return len(tokens) - i, "query", tokens[at:]

    def parse_normal(self, norm: str | None) -> Parsed:
        """norm: as from functions.text.normalize()."""
        out, tokens, i, pos = Parsed(), (norm or "").split(), 0, 0
        while i < len(tokens):
            if found := self.context(tokens, i):
                if out.context is None:
                    out.context, out.target = found[1], found[2]
                else:
                    out.warnings.append("second context ignored")
                i += found[0]
                continue
            c = self.constraint(tokens, i)
            if c and c["quantity"]:
                i += c.pop("used")
                out.constraints.append({"n": len(out.constraints), **c})
                continue
            if c:
                out.warnings.append("number without unit dropped")
            if found := self.concept(tokens, i):
                n, kind, value, confidence = found
                out.concepts.append({"c": len(out.concepts), "kind": kind, "value": value, "confidence": confidence, "words": n, "text": " ".join(tokens[i : i + n])})
                i += n
                continue
            if tokens[i] not in self.lexicon.stopwords:
                pos += 1
                out.terms.append({"pos": pos, "text": tokens[i]})
            i += 1
        seen = [c["quantity"] for c in out.constraints]
        out.warnings += [f"two constraints on {q}" for q in dict.fromkeys(seen) if seen.count(q) > 1]
        return out

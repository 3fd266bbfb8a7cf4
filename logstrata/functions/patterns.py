"""Patterns: literal vocabularies, a gate for regular expressions, and matching as columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of accepted patterns.
MAX_CHARS, MAX_NODES, MAX_OF_A_KIND, MAX_DEPTH, MAX_REPEAT, MAX_COMPONENTS = 4096, 4096, 128, 64, 100_000, 64


class PatternError(ValueError):
    """A pattern that is invalid or may take too long."""


def unique(*groups: Iterable[str]) -> list[str]:
    """Stripped, without empties, first occurrence first."""
    return list(dict.fromkeys(s for g in groups for x in g if (s := str(x).strip())))


def from_terms(terms: Iterable[str]) -> str:
    return "|".join(re.escape(t) for t in unique(terms))


def combine(*patterns: str) -> str:
    """Any of the patterns."""
    found = unique(patterns)
    return found[0] if len(found) == 1 else "|".join(f"(?:{p})" for p in found)


def literals(pattern: str) -> list[str] | None:
    """The words of a pattern that is nothing but alternatives of plain text, else None."""
    branches, current, depth, group = [], "", 0, False
    if not pattern:
        return None
    tokens = re.findall(r"\\.|\\$|\(\?:|.", pattern, re.DOTALL)
    out: list[str] = []

    def close(text: str, grouped: list[str] | None) -> bool:
        if grouped is not None:
            out.extend(grouped)
            return not text.strip()
        word = re.sub(r"\\(.)", r"\1", text.strip(), flags=re.DOTALL)
        out.append(word)
        return bool(word)

    grouped: list[str] | None = None
    for token in [*tokens, "|"]:
        if token == "(?:" and depth == 0 and not current.strip() and grouped is None:
            depth, group, branches, current = 1, True, [], ""
        elif token == ")" and depth == 1:
            branches.append(current)
            words = [re.sub(r"\\(.)", r"\1", b.strip(), flags=re.DOTALL) for b in branches]
            if not all(words):
                return None
            depth, grouped, current = 0, words, ""
        elif token == "|" and depth == 1:
            branches.append(current)
            current = ""
        elif token == "|":
            if not close(current, grouped):
                return None
            current, grouped = "", None
        elif len(token) == 1 and token in "^$.*+?{}[]()" or token == "(?:" or token == "\\" or len(token) == 2 and token[1].isalnum():
            return None
        else:
            current += token
    return out if depth == 0 else None


def _walk(nodes: Any, depth: int, repeating: bool, seen: dict[str, int]) -> None:
    if depth > MAX_DEPTH:
        raise PatternError("nested too deeply")
    for op, arg in nodes:
        name = str(op)
        seen["nodes"] += 1
        if seen["nodes"] > MAX_NODES:
            raise PatternError("too many parts")
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, child = arg
            seen["repeats"] += 1
            bound = int(high)
            unbounded = str(high) == "MAXREPEAT"
            if max(int(low), 0 if unbounded else bound) > MAX_REPEAT:
                raise PatternError("repeats too often")
            variable = unbounded or low != bound
            if variable and repeating:
                raise PatternError("a variable repeat within a variable repeat")
            _walk(child, depth + 1, repeating or (variable and bound > 1), seen)
        elif name == "BRANCH":
            seen["branches"] += 1
            if repeating and _ambiguous(arg[1]):
                raise PatternError("ambiguous alternatives within a repeat")
            for branch in arg[1]:
                _walk(branch, depth + 1, repeating, seen)
        elif name == "SUBPATTERN":
            seen["groups"] += 1
            _walk(arg[-1], depth + 1, repeating, seen)
        elif name in ("ASSERT", "ASSERT_NOT"):
            _walk(arg[1], depth + 1, repeating, seen)
        elif name == "ATOMIC_GROUP":
            _walk(arg, depth + 1, repeating, seen)
        elif name.startswith("GROUPREF"):
            if repeating:
                raise PatternError("a back-reference within a repeat")
    if any(seen[k] > MAX_OF_A_KIND for k in ("groups", "repeats", "branches")):
        raise PatternError("too many groups, repeats or alternatives")


def _starts(branch: Any) -> list[str]:
    """The literal characters that a branch begins with; '?' stands for anything."""
    out = []
    for op, arg in branch:
        if str(op) == "LITERAL":
            out.append(chr(arg))
        else:
            out.append("?")
            break
    return out


def _ambiguous(branches: Sequence[Any]) -> bool:
    """Whether one alternative may be the start of another, or is empty."""
    heads = [_starts(b) for b in branches]
    for i, x in enumerate(heads):
        for y in heads[i + 1 :]:
            if not x or not y or all("?" in (a, b) or a == b for a, b in zip(x, y, strict=False)):
                return True
    return any(not h for h in heads)


def check(pattern: str) -> str:
    """``pattern`` if it compiles and its shape can't backtrack without end."""
    import re._parser as parser

    if len(pattern) > MAX_CHARS:
        raise PatternError(f"longer than {MAX_CHARS} characters")
    try:
        tree = parser.parse(pattern)
    except (re.error, RecursionError, OverflowError) as error:
        raise PatternError(str(error)) from error
    _walk(tree, 0, False, {"nodes": 0, "repeats": 0, "branches": 0, "groups": 0})
    return pattern


def to_java(pattern: str) -> str:
    """The same pattern in the engine's dialect: Unicode classes, and group names without underscores."""
    out = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{java_group(m[1])}>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\\k<{java_group(m[1])}>", out)
    return f"(?U){out}"


def java_group(name: str) -> str:
    return name.replace("_", "U95")


def group_names(pattern: str) -> list[str]:
    return list(re.compile(pattern).groupindex)


def any_literal(text: Column, terms: Sequence[str]) -> Column:
    """Whether any term occurs; plain ``contains`` calls reach a Parquet scan."""
    found = [text.contains(t) for t in terms]
    return F.coalesce(reduce(lambda a, b: a | b, found), F.lit(False)) if found else F.lit(False)


def terms_in(text: Column, terms: Sequence[str]) -> Column:
    """The terms that occur, sorted."""
    return F.array_compact(F.array(*[F.when(text.contains(t), F.lit(t)) for t in sorted(set(terms))]))


def first_term(text: Column, terms: Sequence[str]) -> Column:
    """The term whose first occurrence ends first, the longest of those that end together."""
    ends = [F.when(text.contains(t), F.struct((F.locate(t, text) + len(t)).alias("end"), F.lit(-len(t)).alias("size"), F.lit(t).alias("term"))) for t in unique_terms(terms)]
    return F.array_min(F.array_compact(F.array(*ends)))["term"]


#: Terms from which a vocabulary is searched by an automaton, one pass over a text however many there are.
VOCABULARY = 24


@lru_cache(maxsize=8)
def _automaton(terms: tuple[str, ...]) -> Any:
    import ahocorasick

    made = ahocorasick.Automaton()
    for place, term in enumerate(terms):
        made.add_word(term, place)
    made.make_automaton()
    return made


def vocabulary_hits(text: Column, terms: Sequence[str]) -> Column:
    """struct(terms that occur, sorted; first: the one whose first occurrence ends first, the longest of those that end together), in Arrow batches."""
    words = tuple(sorted(set(terms)))

    def search(column: pd.Series) -> pd.DataFrame:
        automaton, found, first = _automaton(words), [], []
        for value in column:
            least: dict[int, int] = {}
            for end, place in automaton.iter(value) if value else ():
                least.setdefault(place, end)
            found.append([words[place] for place in sorted(least)])
            first.append(words[min(least, key=lambda p: (least[p], -len(words[p])))] if least else None)
        return pd.DataFrame({"terms": found, "first": first})

    return F.pandas_udf(search, "terms array<string>, first string")(text)


def unique_terms(terms: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(terms))


@dataclass(frozen=True)
class Component:
    """A named part of a pattern, for provenance."""

    component_id: str
    pattern: str
    kind: str | None = None
    effective: bool = True
    metadata: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Matcher:
    """A pattern as columns: literal alternatives avoid the regex engine."""

    pattern: str
    components: tuple[Component, ...] = ()

    def __post_init__(self) -> None:
        check(self.pattern)
        if len(self.components) > MAX_COMPONENTS or len({c.component_id for c in self.components}) < len(self.components):
            raise PatternError("components need distinct ids, 64 at most")

    @property
    def terms(self) -> list[str] | None:
        return literals(self.pattern)

    def vocabulary(self) -> list[str] | None:
        """The terms, if there are many of them."""
        terms = unique_terms(self.terms or ())
        return terms if len(terms) >= VOCABULARY else None

    def matched(self, text: Column) -> Column:
        terms = self.terms
        if many := self.vocabulary():
            return F.coalesce(F.size(vocabulary_hits(text, many)["terms"]) > 0, F.lit(False))
        return any_literal(text, unique_terms(terms)) if terms else F.coalesce(text.rlike(to_java(self.pattern)), F.lit(False))

    def first(self, text: Column) -> Column:
        return first_term(text, self.terms) if self.terms else F.lit(None).cast("string")

    def all(self, text: Column) -> Column:
        return terms_in(text, self.terms) if self.terms else F.array().cast("array<string>")

    def matched_by(self, text: Column) -> Column:
        """Ids of the effective components that match, else ``pattern``."""
        parts = [F.when(Matcher(c.pattern).matched(text), F.lit(c.component_id)) for c in self.components if c.effective]
        found = F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")
        return F.when(F.size(found) == 0, F.array(F.lit("pattern"))).otherwise(found)

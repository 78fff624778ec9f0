"""Sets over a short fixed list of names, held as bits in whole-number columns.

Bit sets have a fixed width, so Spark aggregates them by hash with partial results in each task,
and a running OR over terms stays inside code generation. Lists longer than one word use more columns.
Expressions are SQL text: rule sets give many small ones, and text reaches the JVM in one call.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 62
LANES, LANE_BITS = 4, 16  # a student has fewer than 65,536 terms


def quoted(text: str) -> str:
    """``text`` as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def named(column: str) -> str:
    """``column`` as a SQL identifier."""
    return "`" + column.replace("`", "``") + "`"


class BitIndex:
    """Gives each name of a list a word and a bit."""

    def __init__(self, names: Iterable[str]):
        self.names = list(dict.fromkeys(names))
        self._at = {name: divmod(i, WORD) for i, name in enumerate(self.names)}
        self.words = range(max(1, -(-len(self.names) // WORD)))

    def __contains__(self, name: str) -> bool:
        return name in self._at

    def mask(self, names: Iterable[str]) -> list[int]:
        """The set of ``names``, one number per word."""
        masks = [0 for _ in self.words]
        for name in names:
            word, bit = self._at[name]
            masks[word] |= 1 << bit
        return masks

    def columns(self, prefix: str) -> list[str]:
        return [f"{prefix}{w}" for w in self.words]

    def meets(self, prefix: str, names: Iterable[str]) -> str:
        """SQL: whether the set in the ``prefix`` columns contains any of ``names``."""
        pairs = zip(self.columns(prefix), self.mask(names))
        return "(" + " OR ".join(f"({column} & {mask}L) <> 0" for column, mask in pairs if mask) + ")"

    def has(self, prefix: str, name: str) -> Column:
        """1 if ``name`` is in the set in the ``prefix`` columns, else 0."""
        word, bit = self._at[name]
        return F.expr(f"CAST(getbit({prefix}{word}, {bit}) AS INT)")

    def gather(self, conditions: dict[str, str], prefix: str) -> list[Column]:
        """Columns holding the set of names whose SQL condition is true."""
        words: list[list[str]] = [["0L"] for _ in self.words]
        for name, condition in conditions.items():
            word, bit = self._at[name]
            words[word].append(f"IF({condition}, {1 << bit}L, 0L)")
        return [F.expr(" | ".join(parts)).alias(column) for parts, column in zip(words, self.columns(prefix))]

    # Counters: sixteen bits for each name, four names to a long, so that a handful of sums counts every name.

    def lanes(self, prefix: str) -> list[str]:
        return [f"{prefix}{k}" for k in range(max(1, -(-len(self.names) // LANES)))]

    def spread(self, prefix: str) -> list[str]:
        """SQL per lane column: 1 in the counter of each name in the set in the ``prefix`` columns, else 0."""
        parts: list[list[str]] = [[] for _ in self.lanes("")]
        for i, name in enumerate(self.names):
            word, bit = self._at[name]
            lane, place = divmod(i, LANES)
            parts[lane].append(f"shiftleft(shiftright({prefix}{word}, {bit}) & 1L, {LANE_BITS * place})")
        return [" | ".join(p) or "0L" for p in parts]

    def counter(self, prefix: str, name: str) -> Column:
        """What the counter of ``name`` in the lane columns says."""
        lane, place = divmod(self.names.index(name), LANES)
        return F.expr(_counter(f"{prefix}{lane}", str(LANE_BITS * place)))

    def counter_at(self, prefix: str, place: str) -> str:
        """SQL: the counter of the name at ``place``, a whole number expression."""
        lanes = ", ".join(self.lanes(prefix))
        return _counter(f"element_at(array({lanes}), CAST({place} DIV {LANES} AS INT) + 1)", f"CAST({place} % {LANES} AS INT) * {LANE_BITS}")

    def holds_at(self, prefix: str, place: str) -> str:
        """SQL: whether the set in the ``prefix`` columns has the name at ``place``."""
        words = ", ".join(self.columns(prefix))
        return f"getbit(element_at(array({words}), CAST({place} DIV {WORD} AS INT) + 1), CAST({place} % {WORD} AS INT)) = 1"

    def mask_at(self, place: str) -> list[str]:
        """SQL per word: the set of the one name at ``place``; empty for a place below 0."""
        return [
            f"IF({place} >= {w * WORD} AND {place} < {(w + 1) * WORD}, shiftleft(1L, CAST({place} - {w * WORD} AS INT)), 0L)" for w in self.words
        ]


def _counter(lane: str, shift: str) -> str:
    return f"CAST(shiftrightunsigned({lane}, {shift}) & {2**LANE_BITS - 1}L AS INT)"

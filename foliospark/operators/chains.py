"""Chains of selection steps over pages, as an automaton along each element's path: one pass over the elements, no join.

An element's chain is the array of what can be told of the elements from the top of the page down to it (sources.pages.element_chains).
A bit of a mask stands for each step: it is set where an element is found by the steps so far. Going down the
path, `here` has the bits of the element itself, `reached` those of it and all above.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """An element below what was found so far (child: directly), by tag, all words of a class, and id.

    place counts the elements of the same parent from 1, -1 is the last: those of the same tag, or all if no tag is asked for.
    """

    tag: str | None = None
    cls: str | None = None
    ident: str | None = None
    child: bool = False
    place: int | None = None

    def test(self, e: Column) -> Column:
        found = F.lit(True)
        if self.tag:
            found = found & (e["tag"] == self.tag.lower())
        for word in (self.cls or "").split():
            found = found & F.array_contains(F.split(e["cls"], r"\s+"), word)
        if self.ident:
            found = found & (e["id"] == self.ident)
        if self.place is not None:
            k, n = (e["nth"], e["n_same"]) if self.tag else (e["place"], e["n_all"])
            found = found & (k == (F.lit(self.place) if self.place > 0 else n + self.place + 1))
        return found


def _down(steps: list[Step], state: Column, e: Column) -> Column:
    """The state below: the bits of the element e, and those reached."""
    bits = [F.when(step.test(e) & ((state["here"] if step.child else state["reached"]).bitwiseAND(1 << k) != 0), F.lit(2 << k)).otherwise(F.lit(0)).cast("long") for k, step in enumerate(steps)]
    here = reduce(lambda a, b: a.bitwiseOR(b), bits)
    return F.struct(here.alias("here"), here.bitwiseOR(state["reached"]).alias("reached"))


def _start() -> Column:
    return F.struct(F.lit(1).cast("long").alias("here"), F.lit(1).cast("long").alias("reached"))


def found(chain: Column, steps: list[Step]) -> Column:
    """Whether the steps lead to the last element of a chain. Up to 62 steps."""
    if not 0 < len(steps) < 63:
        raise ValueError("1 to 62 steps")
    final = F.aggregate(chain, _start(), lambda state, e: _down(steps, state, e))
    return (F.size(chain) > 0) & (final["here"].bitwiseAND(1 << len(steps)) != 0)


def found_at(chain: Column, steps: list[Step]) -> Column:
    """Depths (from 1, ascending) of the elements of a chain that the steps lead to."""
    if not 0 < len(steps) < 63:
        raise ValueError("1 to 62 steps")

    def down(state: Column, e: Column) -> Column:
        below = _down(steps, state["s"], e)
        return F.struct(below.alias("s"), (state["depth"] + 1).alias("depth"), F.when(below["here"].bitwiseAND(1 << len(steps)) != 0, F.array_append(state["at"], state["depth"] + 1)).otherwise(state["at"]).alias("at"))

    start = F.struct(_start().alias("s"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("at"))
    return F.aggregate(chain, start, down, lambda state: state["at"])


def selected(chains: DataFrame, steps: list[Step]) -> DataFrame:
    """Of elements with their chain those that the steps find, each once."""
    return chains.filter(found(F.col("chain"), steps))

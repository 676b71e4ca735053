"""Antimony text: the subset that gives the structure of a model.

Reactions are `[name:] [n] A + [n] $B -> C; rate`, with `->` or `=>` (one way), parted by `;` or line breaks. `$` marks
boundary species. Comments, assignments, rules, functions, units and declarations are skipped, as are the model's
header and end; events and imported models are an error. Reactions without a name get _J0, _J1, ... in order.
"""

from __future__ import annotations

import re

_COMMENT = re.compile(r"//[^\n]*|#[^\n]*|/\*.*?\*/", re.DOTALL)
_REACTION = re.compile(r"^(?:(?P<name>[A-Za-z_]\w*)\s*:)?\s*(?P<left>[^;:=<>]*?)\s*(?:->|=>)\s*(?P<right>[^;=<>]*)$")
_TERM = re.compile(r"^(?:(?P<n>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*\*?\s*)?(?P<dollar>\$?)(?P<species>[A-Za-z_]\w*)$")
_BLOCK = re.compile(r"\bfunction\b.*?\bend\b", re.DOTALL)


class AntimonyError(ValueError):
    pass


def _side(text: str) -> list[tuple[str, float, bool]]:
    out = []
    for term in (x.strip() for x in text.split("+")):
        if not term:
            continue
        found = _TERM.match(term)
        if not found:
            raise AntimonyError(f"not a species: {term}")
        out.append((found["species"], float(found["n"] or 1), bool(found["dollar"])))
    return out


def parse(text: str, name: str | None = None) -> dict:
    """A network in a row: floating species in the order of their appearance, then boundary species."""
    text = _BLOCK.sub("", _COMMENT.sub("", text))
    reactions: list[tuple[str, list, list]] = []
    species: dict[str, bool] = {}
    boundary: set[str] = set()
    for line in (x.strip() for x in re.split(r"[;\n]", text)):
        if not line:
            continue
        head = re.match(r"^(?:model|module)\s+\*?\s*([A-Za-z_]\w*)", line)
        if head:
            name = name or head[1]
            continue
        if re.match(r"^at\b|^\w+\s*:\s*at\b", line):  # an event changes values, not the structure
            continue
        if re.match(r"^import\b", line):
            raise AntimonyError(f"not supported: {line}")
        if "->" not in line and "=>" not in line:
            declared = re.match(r"^(?:const\s+|var\s+)*(?:species|substanceOnly\s+species)\s+(.*)$", line)
            for part in declared[1].split(",") if declared else []:
                own = part.split(" in ")[0].split("=")[0].strip()
                species.setdefault(own.lstrip("$"), False)
                if own.startswith("$") or line.startswith("const"):
                    boundary.add(own.lstrip("$"))
            continue
        found = _REACTION.match(line)
        if not found:
            raise AntimonyError(f"not a reaction: {line}")
        left, right = _side(found["left"]), _side(found["right"])
        reactions.append((found["name"] or f"_J{len(reactions)}", left, right))
        for s, _, dollar in (*left, *right):
            species[s] = True
            if dollar:
                boundary.add(s)
    names = [s for s in species if s not in boundary] + [s for s in species if s in boundary]
    place = {s: i for i, s in enumerate(names)}
    cells: dict[tuple[int, int], list[float]] = {}
    for j, (_, left, right) in enumerate(reactions):
        for side, terms in enumerate((left, right)):
            for s, n, _ in terms:
                cells.setdefault((place[s], j), [0.0, 0.0])[side] += n
    return {"network": name or "network", "species": names, "reactions": [r[0] for r in reactions], "cells": [{"s": s, "j": j, "r": r, "p": p} for (s, j), (r, p) in sorted(cells.items())]}


def render(row: dict) -> str:
    """Antimony text of a network in a row, with names as they are; species in no reaction are declared."""
    sides: dict[int, tuple[list[str], list[str]]] = {j: ([], []) for j in range(len(row["reactions"]))}
    for c in row["cells"]:
        for terms, n in zip(sides[c["j"]], (c["r"], c["p"]), strict=True):
            if n:
                terms.append(row["species"][c["s"]] if n == 1 else f"{n:g} {row['species'][c['s']]}")
    lines = [f"{name}: {' + '.join(sides[j][0])} -> {' + '.join(sides[j][1])}; 1" for j, name in enumerate(row["reactions"])]
    return "\n".join([f"model {row['network']}", f"species {', '.join(row['species'])}", *lines, "end"])

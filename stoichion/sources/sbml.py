"""SBML models: species and reactions by the standard XML reader of Python, modifiers and kinetics ignored."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape


class SbmlError(ValueError):
    pass


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def parse(text: str | bytes, name: str | None = None) -> dict:
    """A network in a row: floating species first, then boundary species; repeated references add up."""
    if b"<!DOCTYPE" in (text if isinstance(text, bytes) else text.encode()):
        raise SbmlError("document types aren't read")
    root = ET.fromstring(text)
    model = next((x for x in root.iter() if _local(x.tag) == "model"), None)
    if model is None:
        raise SbmlError("no model")
    all_species = [x for x in model.iter() if _local(x.tag) in ("species", "specie") and (x.get("id") or x.get("name"))]
    key = lambda x: x.get("id") or x.get("name")
    fixed = lambda x: x.get("boundaryCondition", "false").lower() in ("true", "1")
    names = [key(x) for x in all_species if not fixed(x)] + [key(x) for x in all_species if fixed(x)]
    place = {s: i for i, s in enumerate(names)}
    reactions, cells = [], {}
    for x in model.iter():
        if _local(x.tag) != "reaction":
            continue
        j = len(reactions)
        reactions.append(key(x) or f"_J{j}")
        for part in x:
            side = {"listOfReactants": 0, "listOfProducts": 1}.get(_local(part.tag))
            for ref in part if side is not None else ():
                s = ref.get("species") or ref.get("specie")
                if s is None:
                    continue
                if s not in place:
                    place[s] = len(names)
                    names.append(s)
                amount = float(ref.get("stoichiometry", "1")) / float(ref.get("denominator", "1"))
                cells.setdefault((place[s], j), [0.0, 0.0])[side] += amount
    return {"network": name or model.get("id") or model.get("name") or "network", "species": names, "reactions": reactions, "cells": [{"s": s, "j": j, "r": r, "p": p} for (s, j), (r, p) in sorted(cells.items())]}


def render(row: dict) -> str:
    """SBML text of a network in a row."""
    quoted = lambda x: escape(str(x), {'"': "&quot;"})
    ref = lambda c, n: f'<speciesReference species="{quoted(row["species"][c["s"]])}" stoichiometry="{n:g}"/>'
    sides: dict[int, tuple[list[str], list[str]]] = {j: ([], []) for j in range(len(row["reactions"]))}
    for c in row["cells"]:
        for part, n in zip(sides[c["j"]], (c["r"], c["p"]), strict=True):
            if n:
                part.append(ref(c, n))
    species = "".join(f'<species id="{quoted(s)}" boundaryCondition="false"/>' for s in row["species"])
    lists = lambda j: "".join(f"<{n}>{''.join(x)}</{n}>" for n, x in zip(("listOfReactants", "listOfProducts"), sides[j], strict=True) if x)
    reactions = "".join(f'<reaction id="{quoted(name)}">{lists(j)}</reaction>' for j, name in enumerate(row["reactions"]))
    return f'<sbml xmlns="http://www.sbml.org/sbml/level3/version1/core" level="3" version="1"><model id="{quoted(row["network"])}"><listOfSpecies>{species}</listOfSpecies><listOfReactions>{reactions}</listOfReactions></model></sbml>'

"""Boolean trigram queries of regular expressions.

A text that matches an expression holds, in one of the alternatives found here, every trigram of it (after A-Z are
lower-cased). An expression with an alternative that demands no trigram has no query and must be searched everywhere.
"""

from __future__ import annotations


try:
    from re import _constants as sre
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse as parser

#: Classes of more characters, and products of more alternatives, count as unknown text.
_FEW, _MOST = 8, 512
_GAP = None

Pieces = tuple[str | None, ...]


def _class_chars(items: list) -> list[str] | None:
    found: list[str] = []
    for op, value in items:
        if op is sre.LITERAL:
            found.append(chr(value))
        elif op is sre.RANGE and value[1] - value[0] < 64:
            found += map(chr, range(value[0], value[1] + 1))
        else:
            return None
    lowered = sorted({c.lower() if c.isascii() else c for c in found})
    return lowered if len(lowered) <= _FEW else None


def _alternatives(nodes) -> list[Pieces]:
    """What the nodes match, in sequence: tuples of literal text and gaps of unknown text."""
    out: list[Pieces] = [()]
    for op, value in nodes:
        if op is sre.LITERAL:
            own = [(chr(value).lower() if value < 128 else chr(value),)]
        elif op is sre.IN:
            chars = _class_chars(value)
            own = [(c,) for c in chars] if chars else [(_GAP,)]
        elif op is sre.SUBPATTERN:
            own = _alternatives(value[3])
        elif op is sre.BRANCH:
            own = [x for branch in value[1] for x in _alternatives(branch)]
        elif op is sre.AT:
            own = [()]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = value
            inner = _alternatives(body)
            if (low, high) == (0, 1):
                own = [(), *inner]
            elif low == high == 1:
                own = inner
            else:
                own = [(_GAP, *x, _GAP) for x in inner] if low else [(_GAP,)]
        else:
            own = [(_GAP,)]
        own = own if len(own) * len(out) <= _MOST else [(_GAP,)]
        out = [a + b for a in out for b in own]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of trigrams that a match demands together, or None if the expression demands none."""
    found: set[frozenset[str]] = set()
    for pieces in _alternatives(parser.parse(pattern)):
        runs = "".join("\0" if x is _GAP else x for x in pieces).split("\0")
        own = frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2))
        if not own:
            return None
        found.add(own)
    return sorted((x for x in found if not any(y < x for y in found)), key=sorted)



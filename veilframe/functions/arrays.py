"""Small builders of Spark SQL expressions.

Detection combines many nested array functions. Composing them as SQL text and parsing
the result once with ``F.expr`` is far quicker than building them call by call, and the
text works on a column name and on a lambda variable alike.
"""

from __future__ import annotations

from itertools import count

BLOCK = 256

_serial = count()


def lit(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def var(prefix: str) -> str:
    """A fresh lambda variable name, so that nested lambdas never capture each other's."""
    return f"{prefix}{next(_serial)}"


def let(value: str, body) -> str:
    """Evaluate ``value`` once and use it several times inside ``body(name)``."""
    v = var("v")
    return f"get(transform(array({value}), {v} -> {body(v)}), 0)"


def _add(a: str, b: str) -> str:
    return f"{a} + {b}"


def _max(a: str, b: str) -> str:
    return f"greatest({a}, {b})"


def _scan(values: str, combine) -> str:
    acc, x = var("acc"), var("x")
    last = combine(f"{acc}.last", x)
    return (f"aggregate({values}, named_struct('last', 0, 'all', cast(array() AS array<int>)), "
            f"({acc}, {x}) -> named_struct('last', {last}, "
            f"'all', array_append({acc}.all, {last})), {acc} -> {acc}.all)")


def _running(values: str, combine) -> str:
    """Inclusive scan of an ``array<int>`` of numbers from 0 up.

    Arrays are immutable, so a plain fold copies its output at each step. Above BLOCK
    elements the scan works block by block, which keeps long arrays near linear.
    """
    def blocked(a: str) -> str:
        b, e, x, i, y = var("b"), var("e"), var("x"), var("i"), var("y")
        part = _scan(f"slice({a}, {b} * {BLOCK} + 1, {BLOCK})", combine)
        blocks = f"transform(sequence(0, cast(ceil(size({a}) / {BLOCK}) AS int) - 1), {b} -> {part})"

        def shifted(bs: str) -> str:
            ends = _scan(f"transform({bs}, {e} -> element_at({e}, -1))", combine)
            return let(ends, lambda es: (
                f"flatten(transform({bs}, ({x}, {i}) -> transform({x}, {y} -> "
                f"{combine(y, f'coalesce(get({es}, {i} - 1), 0)')})))"))
        return let(blocks, shifted)

    return let(values, lambda a: f"IF(size({a}) <= {BLOCK}, {_scan(a, combine)}, {blocked(a)})")


def running_sum(values: str) -> str:
    return _running(values, _add)


def running_max(values: str) -> str:
    return _running(values, _max)

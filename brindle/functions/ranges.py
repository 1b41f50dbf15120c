"""Column ranges as text: '1', 'first-3,5,last', counted from one."""

from __future__ import annotations


def columns_in(expression: str, columns: list[str], invert: bool = False) -> list[str]:
    """Names that a range takes, in table order; with ``invert`` all others."""
    n = len(columns)

    def index(text: str) -> int:
        text = text.strip().lower()
        i = 1 if text == "first" else n if text == "last" else int(text)
        if not 1 <= i <= n:
            raise ValueError(f"no column {text} among {n}")
        return i

    taken: set[int] = set()
    for part in filter(None, (p.strip() for p in expression.split(","))):
        ends = part.split("-")
        low, high = index(ends[0]), index(ends[-1])
        if low > high or len(ends) > 2:
            raise ValueError(f"not a range: {part}")
        taken |= set(range(low, high + 1))
    return [c for i, c in enumerate(columns, 1) if (i in taken) != invert]

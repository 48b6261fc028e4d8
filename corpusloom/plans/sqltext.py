"""Small helps for the SQL texts."""

from __future__ import annotations


def floored(sql: str) -> str:
    """``sql`` with ``epoch_ms(x)`` as whole milliseconds, rounded down (DuckDB's own function rounds to the nearest)."""
    out, at = "", 0
    while (found := sql.find("epoch_ms(", at)) >= 0:
        start = found + len("epoch_ms(")
        depth, end = 1, start
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += sql[at:found] + f"(epoch_us({floored(sql[start : end - 1])}) // 1000)"
        at = end
    return out + sql[at:]

"""Bitmask predicates on hex flag columns (``EFLAG[offset:] & mask op value``).

The filter expression is parsed once on the driver into a Column; the flag
column holds the flag bytes as hex text (two digits per byte).  Bytes are
taken from ``offset``; a flag shorter than ``offset + len(operand)`` never
matches.  Comparison is big-endian unsigned, which for equal-length byte
strings equals numeric comparison.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(0[xX][0-9a-fA-F]+|[0-9]+|[A-Za-z]+|[<>=!]=|\S)")
_COMPARES = ("==", "!=", "<=", ">=", "<", ">")


def parse_eflag(expr: str) -> tuple[int, str | None, str | None, str, str]:
    """(offset, bit operator, mask, comparison, operand) of a filter: the word EFLAG, then
    optionally ``[offset:]``, then optionally a bit operator and a mask, then the comparison."""
    words = _TOKEN.findall(expr)
    offset, bitop, mask = 0, None, None

    def take(n: int) -> list[str]:
        nonlocal words
        out, words = words[:n], words[n:]
        return out

    ok = take(1) == ["EFLAG"]
    if words[:1] == ["["]:
        inside = take(words.index("]") + 1)[1:-1] if "]" in words else []
        ok &= inside[-1:] == [":"] and (len(inside) == 1 or len(inside) == 2 and inside[0].isdigit())
        offset = int(inside[0]) if ok and len(inside) == 2 else 0
    if words[:1] in (["&"], ["|"], ["^"]):
        bitop, mask = (take(2) + [""])[:2]
        ok &= mask.startswith("0x")
    compare, operand = (take(2) + ["", ""])[:2]
    if not ok or words or compare not in _COMPARES or not operand.startswith("0x"):
        raise ValueError(f"invalid flag filter: {expr!r}")
    return offset, bitop, mask, compare, operand


def eflag_predicate(expr: str, flag_col: str = "flag") -> Column:
    offset, bitop, mask, op, rhs = parse_eflag(expr)
    width = len((mask or rhs)[2:])                    # hex digits compared
    flag = F.col(flag_col)
    start = offset * 2 + 1
    seg = F.substring(flag, start, width)
    val = F.conv(seg, 16, 10).cast("bigint")
    if bitop and mask:
        mv = F.lit(int(mask, 16))
        val = {"&": val.bitwiseAND(mv), "|": val.bitwiseOR(mv), "^": val.bitwiseXOR(mv)}[bitop]
    r = F.lit(int(rhs, 16))
    cmp = {"==": val == r, "!=": val != r, "<": val < r, "<=": val <= r, ">": val > r, ">=": val >= r}[op]
    return (F.length(flag) >= F.lit(offset * 2 + width)) & cmp

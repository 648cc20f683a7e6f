"""Default bucket of a key: CRC-32C without the last inversion over the key's parts as text, in Python and as a Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ShardingFuncError

BUCKETS = 3000
_POLY = 0x82F63B78  # fixed value: Castagnoli polynomial, reflected


def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (_POLY if n & 1 else 0)
        out.append(n)
    return out


TABLE = _table()


def part_text(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def crc32c(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = TABLE[(crc ^ b) & 255] ^ crc >> 8
    return crc


def strcrc32(key, buckets: int = BUCKETS) -> int:
    parts = key if isinstance(key, (list, tuple)) else (key,)
    return crc32c("".join(map(part_text, parts)).encode()) % buckets + 1


def mpcrc32(key, buckets: int = BUCKETS) -> int:
    """As strcrc32, over the MessagePack bytes of non-negative integers and strings."""
    crc = b""
    for v in key if isinstance(key, (list, tuple)) else (key,):
        if isinstance(v, int) and v >= 0:
            size = 0 if v < 128 else 1 if v < 1 << 8 else 2 if v < 1 << 16 else 4 if v < 1 << 32 else 8
            crc += v.to_bytes(1, "big") if not size else bytes([{1: 0xCC, 2: 0xCD, 4: 0xCE, 8: 0xCF}[size]]) + v.to_bytes(size, "big")
        else:
            raw = str(v).encode()
            head = bytes([0xA0 | len(raw)]) if len(raw) < 32 else bytes([0xD9, len(raw)]) if len(raw) < 256 else b"\xda" + len(raw).to_bytes(2, "big")
            crc += head + raw
    return crc32c(crc) % buckets + 1


def text_column(c: Column, kind: str | None = None) -> Column:
    text = c.cast("string")
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(text) if kind in ("double", "float") else text


def crc32c_column(text: Column) -> Column:
    """CRC of the UTF-8 bytes, inside the JVM: a fold over the two hex digits of each byte."""
    table = F.array(*[F.lit(v).cast("long") for v in TABLE])
    digits = F.hex(F.encode(text, "UTF-8"))
    byte = lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    count = (F.length(digits) / 2).cast("int")
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    step = lambda crc, i: F.element_at(table, (crc.bitwiseXOR(byte(i)).bitwiseAND(F.lit(255)) + 1).cast("int")).bitwiseXOR(F.shiftright(crc, 8))
    return F.aggregate(places, F.lit(0xFFFFFFFF).cast("long"), step)


#: Characters of a 64-bit number as text.
_DIGITS, _MOST_DIGITS = "-0123456789", 20


def integer_bucket(number: Column, buckets: int = BUCKETS) -> Column:
    """strcrc32 of a whole number. A CRC is linear: each character adds the table's entry for it, moved on by as many zero bytes as follow, so the sum is spelled out by place instead of folded byte by byte."""

    def moved(crc: int, places: int) -> int:
        for _ in range(places):
            crc = TABLE[crc & 255] ^ crc >> 8
        return crc

    text = number.cast("string")
    length, total = F.length(text), F.lit(0).cast("long")
    spelled = lambda values: F.expr(f"array({', '.join(f'{v}L' for v in values)})")
    for p in range(1, _MOST_DIGITS + 1):  # the p-th character from the end
        c = F.substring(text, -p, 1)
        entry = F.get(spelled([moved(TABLE[ord(d)], p - 1) for d in _DIGITS]), F.instr(F.lit(_DIGITS), c) - 1)
        total = total.bitwiseXOR(F.when(length >= p, entry).otherwise(F.lit(0)))
    start = F.get(spelled([moved(0xFFFFFFFF, n) for n in range(1, _MOST_DIGITS + 1)]), length - 1)
    return total.bitwiseXOR(start) % buckets + 1


def bucket_column(parts: list[Column], buckets: int = BUCKETS) -> Column:
    return crc32c_column(F.concat(*parts)) % buckets + 1


_named: dict[str, Callable] = {"strcrc32": strcrc32, "mpcrc32": mpcrc32}


def register(name: str, function: Callable) -> None:
    """A custom sharding function: key values (tuple) -> bucket."""
    _named[name] = function


def function_of(name_or_callable) -> Callable:
    if callable(name_or_callable):
        return name_or_callable
    if name_or_callable is None:
        return strcrc32
    short = str(name_or_callable).rpartition(".")[2].removeprefix("bucket_id_")
    if name_or_callable not in _named and short not in _named:
        raise ShardingFuncError(f"Wrong sharding function specified in _ddl_sharding_func space for ({name_or_callable}) space")
    return _named.get(name_or_callable) or _named[short]

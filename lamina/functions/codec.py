"""Codecs as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, HEADER = 32768, 7


def pack_tag(seq: Column, op: Column) -> Column:
    return F.shiftleft(seq.cast("long"), 8).bitwiseOR(op.cast("long"))


def fixed64(n: Column) -> Column:
    """Hexadecimal digits of the eight big-endian bytes."""
    return F.lpad(F.hex(n.cast("long")), 16, "0")


def varint_length(n: Column) -> Column:
    """Bytes of a varint of a number from 0 to 2^63 - 1."""
    out = F.lit(9)
    for size in range(8, 0, -1):
        out = F.when(n < F.lit(1 << (7 * size)), size).otherwise(out)
    return out.cast("int")


def entry_size(key_bytes: Column, value_bytes: Column) -> Column:
    """Bytes of a buffered entry: varint(key + 8), key, tag, varint(value), value."""
    return (varint_length(key_bytes + 8) + key_bytes + 8 + varint_length(value_bytes) + value_bytes).cast("long")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two strings."""
    n = F.least(F.length(a), F.length(b))
    differs = lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))
    first = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), differs)
    return F.when(n == 0, 0).otherwise(F.coalesce(F.get(first, F.lit(0)) - 1, n)).cast("int")


def prefix_delta(df: DataFrame, file: str, key: str, interval: int = 16) -> DataFrame:
    """``file, key, shared, non_shared``: common prefix with the previous key of the file, 0 at every restart."""
    order = Window.partitionBy(file).orderBy(key)
    place = (F.row_number().over(order) - 1) % interval
    shared = F.when(F.col("place") == 0, 0).otherwise(common_prefix(F.col("before"), F.col(key)))
    placed = df.select(file, key, place.alias("place"), F.coalesce(F.lag(key).over(order), F.lit("")).alias("before"))
    return placed.select(file, key, shared.cast("int").alias("shared")).withColumn("non_shared", F.length(key) - F.col("shared"))


def short_separator(a: Column, b: Column) -> Column:
    """A shortest string s with a <= s < b (single-byte characters): the first differing byte of a, one up, if that stays below b's."""
    p = common_prefix(a, b)
    x, y = F.ascii(F.substring(a, p + 1, F.lit(1))), F.ascii(F.substring(b, p + 1, F.lit(1)))
    prefix = p >= F.least(F.length(a), F.length(b))
    return F.when(prefix | (x + 1 >= y), a).otherwise(F.concat(F.substring(a, F.lit(1), p), F.char(x + 1)))


def short_successor(a: Column) -> Column:
    """A short string not below a (7-bit characters): the first byte, one up."""
    return F.when(F.length(a) == 0, a).otherwise(F.char(F.ascii(a) + 1))


def log_fragments(records: DataFrame, log: str, order: str, size: str) -> DataFrame:
    """Physical records of each log file: ``log, order, fragment, kind, bytes, block``. A fold per log file."""
    kinds = dict(records.dtypes)
    schema = f"{log} {kinds[log]}, {order} {kinds[order]}, fragment int, kind string, bytes bigint, block bigint"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, block, at = None, 0, 0
        for batch in batches:
            out = []
            for g, o, left in zip(batch[log], batch[order], batch[size], strict=True):
                if g != last:
                    last, block, at = g, 0, 0
                fragment = 0
                while True:
                    if BLOCK - at < HEADER:
                        block, at = block + 1, 0
                    n = min(left, BLOCK - at - HEADER)
                    end = n == left
                    kind = ("FULL" if end else "FIRST") if fragment == 0 else ("LAST" if end else "MIDDLE")
                    out.append((g, o, fragment, kind, n, block))
                    at, left, fragment = at + HEADER + n, left - n, fragment + 1
                    if end:
                        break
            yield pd.DataFrame(out, columns=[log, order, "fragment", "kind", "bytes", "block"])

    return records.repartition(log).sortWithinPartitions(log, order).mapInPandas(fold, schema)


def join_fragments(fragments: DataFrame, log: str, order: str) -> DataFrame:
    """Fragments back to whole records: only those that begin with FULL or FIRST and end with FULL or LAST count."""
    whole = fragments.groupBy(log, order).agg(F.sum("bytes").alias("bytes"), F.min_by("kind", "fragment").alias("begins"), F.max_by("kind", "fragment").alias("ends"))
    return whole.filter(F.col("begins").isin("FULL", "FIRST") & F.col("ends").isin("FULL", "LAST")).select(log, order, "bytes")


def _right(n: Column, bits: Column) -> Column:
    return F.call_function("shiftright", n, bits.cast("int"))


def _byte_hex(b: Column) -> Column:
    return F.lpad(F.hex(b.cast("long")), 2, "0")


def unpack_tag(tag: Column) -> Column:
    """Struct ``(seq, op)``."""
    return F.struct(F.shiftright(tag, 8).alias("seq"), tag.bitwiseAND(F.lit(255)).cast("tinyint").alias("op"))


def fixed32(n: Column) -> Column:
    """Hexadecimal digits of the four big-endian bytes."""
    return F.lpad(F.hex(n.cast("long")), 8, "0")


def fixed_value(digits: Column) -> Column:
    """The number that ``fixed32`` or ``fixed64`` wrote (below 2^63)."""
    return F.conv(digits, 16, 10).cast("long")


def varint(n: Column) -> Column:
    """Hexadecimal digits of the varint of a number from 0 to 2^63 - 1: seven bits a byte, low ones first, the top bit if more follow."""
    size = varint_length(n)
    group = lambda i: _right(n, 7 * i).bitwiseAND(F.lit(127)) + F.when(i < size - 1, 128).otherwise(0)
    return F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda i: _byte_hex(group(i))), "")


def hex_bytes(digits: Column) -> Column:
    """The bytes of hexadecimal digits as numbers."""
    at = lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    return F.when(F.length(digits) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1), at))


def read_varint(digits: Column) -> Column:
    """Struct ``(value, size)`` of the varint that ``digits`` begin with; null if it doesn't end."""
    read = F.aggregate(
        F.slice(hex_bytes(digits), F.lit(1), F.lit(9)),
        F.struct(F.lit(0).cast("long").alias("value"), F.lit(0).alias("size"), F.lit(False).alias("ended")),
        lambda acc, b: F.when(acc["ended"], acc).otherwise(
            F.struct((acc["value"] + F.call_function("shiftleft", b.bitwiseAND(F.lit(127)), 7 * acc["size"])).alias("value"), (acc["size"] + 1).alias("size"), (b < 128).alias("ended"))
        ),
    )
    return F.transform(F.array(read), lambda r: F.when(r["ended"], F.struct(r["value"].alias("value"), r["size"].alias("size"))))[0]


def length_prefixed(data: Column) -> Column:
    """Hexadecimal digits of a binary value behind the varint of its length."""
    return F.concat(varint(F.octet_length(data).cast("long")), F.hex(data))


def read_length_prefixed(digits: Column) -> Column:
    """The value as binary; null if the digits end before it does."""
    whole = lambda head: F.when(F.length(digits) >= 2 * (head["size"] + head["value"]), F.unhex(F.substring(digits, 2 * head["size"] + 1, (2 * head["value"]).cast("int"))))
    return F.transform(F.array(read_varint(digits)), whole)[0]


def short_successor_bytes(data: Column) -> Column:
    """Hexadecimal digits of a short key not below a binary one: the first byte below ff, one up; a run of ff stays."""
    digits = F.hex(data)
    run = (F.length(F.regexp_extract(digits, "^((?:FF)*)", 1)) / 2).cast("int")
    next_ = F.conv(F.substring(digits, 2 * run + 1, F.lit(2)), 16, 10).cast("long") + 1
    return F.when(2 * run == F.length(digits), digits).otherwise(F.concat(F.repeat(F.lit("FF"), run), _byte_hex(next_)))


#: Tag of the largest sequence number and the value type that seeks use, as a signed 64-bit number.
SEEK_TAG = (((1 << 56) - 1) << 8 | 1) - (1 << 64)


def internal_key(start: Column, shortened: Column, tag: Column) -> Column:
    """Struct ``(key, tag)``: the shortened user key with the seek tag if it is shorter and larger, else the old one."""
    better = (F.octet_length(shortened) < F.octet_length(start)) & (start < shortened)
    return F.struct(F.when(better, shortened).otherwise(start).alias("key"), F.when(better, F.lit(SEEK_TAG)).otherwise(tag).alias("tag"))


_MASK32 = (1 << 32) - 1


def _times32(h: Column, m: int) -> Column:
    """Product modulo 2^32 without overflow of 64 bits."""
    low = h.bitwiseAND(F.lit(0xFFFF)) * m
    high = (F.shiftright(h, 16) * m).bitwiseAND(F.lit(0xFFFF)) * 65536
    return (low + high).bitwiseAND(F.lit(_MASK32))


def hash32(data: Column, seed: int) -> Column:
    """Hash of the Murmur kind over little-endian words of four bytes, then the rest."""
    m = 0xC6A4A793
    digits, n = F.hex(data), F.octet_length(data).cast("long")
    value = lambda part: F.aggregate(F.reverse(part), F.lit(0).cast("long"), lambda acc, b: acc * 256 + b)

    def whole(bytes_: Column) -> Column:
        words = (n / 4).cast("int")
        full = F.when(words > 0, F.transform(F.sequence(F.lit(0), words - 1), lambda i: value(F.slice(bytes_, 4 * i + 1, F.lit(4))))).otherwise(F.array().cast("array<bigint>"))
        start = F.lit(seed).cast("long").bitwiseXOR(_times32(n.bitwiseAND(F.lit(_MASK32)), m))

        def mix(h: Column, w: Column, shift: int) -> Column:
            return F.transform(F.array(_times32((h + w).bitwiseAND(F.lit(_MASK32)), m)), lambda x: x.bitwiseXOR(F.shiftright(x, shift)))[0]

        body = F.aggregate(full, start, lambda h, w: mix(h, w, 16))
        rest = F.when(n % 4 > 0, value(F.slice(bytes_, 4 * words + 1, F.lit(3)))).otherwise(F.lit(0))
        return F.when(n % 4 > 0, mix(body, rest, 24)).otherwise(body)

    return F.transform(F.array(hex_bytes(digits)), whole)[0]


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


CRC_TABLE = _crc_table()


def crc32c(data: Column) -> Column:
    """CRC of the Castagnoli polynomial as a long."""
    table = F.lit(CRC_TABLE)
    step = lambda c, b: F.get(table, c.bitwiseXOR(b).bitwiseAND(F.lit(255)).cast("int")).cast("long").bitwiseXOR(F.shiftright(c, 8))
    return F.aggregate(hex_bytes(F.hex(data)), F.lit(_MASK32).cast("long"), step).bitwiseXOR(F.lit(_MASK32).cast("long"))


def masked(crc: Column) -> Column:
    """As stored: rotated right by 15 bits, plus a constant."""
    return (F.shiftright(crc, 15).bitwiseOR(F.shiftleft(crc, 17)).bitwiseAND(F.lit(_MASK32)) + 0xA282EAD8).bitwiseAND(F.lit(_MASK32))


def unmasked(stored: Column) -> Column:
    turned = (stored - 0xA282EAD8).bitwiseAND(F.lit(_MASK32))
    return F.shiftright(turned, 17).bitwiseOR(F.shiftleft(turned, 15)).bitwiseAND(F.lit(_MASK32))

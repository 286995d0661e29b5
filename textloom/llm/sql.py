"""Pieces of DuckDB SQL that several operators' checks need."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, by the table of its polynomial."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda c, x: xor(c >> 8, ({table}::bigint[])[(xor(c, x) & 255) + 1])), 4294967295::bigint)"


def lowered(text: str) -> str:
    """Only A-Z in lower case."""
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

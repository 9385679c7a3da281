"""Pieces of DuckDB SQL that several operators' SQL shares."""

#: A common table expression: the table of the reflected CRC-32 polynomial, as one list.
CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS crc_list)"


def crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text, where ``crc_table`` is among the tables."""
    codes = f"list_transform(range(1, len({text}) + 1), lambda k: ord(({text})[k])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, crc_list[(xor(c, b) & 255) + 1])), 4294967295)"

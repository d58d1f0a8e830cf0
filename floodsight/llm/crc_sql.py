"""crc32 in DuckDB, which has no function for it."""

#: the table of crc32, one step for each byte value
CRC_SQL = """crc AS (SELECT list(v ORDER BY i) AS steps FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda a, b: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)) AS v FROM range(256) r(i)))"""


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes in DuckDB, where `CRC_SQL` is among the tables."""
    each = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: ('0x' || p)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {each}), lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295)"

"""CRC-32 in DuckDB SQL, for oracles of contracts that draw rows by it."""

#: A table expression ``crc`` with one row, the list ``steps`` of the 256 steps; the polynomial is a fixed value.
CRC_STEPS = "crc as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) as steps)"


def crc32(text: str) -> str:
    """SQL of the CRC-32 of an ASCII text; ``crc`` must be joined."""
    bytes_ = f"list_transform(string_split({text}, ''), lambda c: cast(ascii(c) as bigint))"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {bytes_}), lambda s, b: xor(s >> 8, steps[(xor(s, b) & 255) + 1])), 4294967295)"

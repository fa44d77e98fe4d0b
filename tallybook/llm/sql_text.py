"""Pieces of DuckDB SQL that oracles of this subpackage share."""

#: CTE of the 256 values of the CRC-32 table, as one list.
CRC_TABLE = """crc_table as (
  select list(list_reduce([1, 1, 1, 1, 1, 1, 1, 1],
    lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, i) order by i) as crc
  from (select cast(unnest(range(256)) as bigint) as i))"""


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text; crc_table has to be in the FROM clause."""
    return f"""xor(4294967295, list_reduce(list_transform(string_split({text}, ''), lambda ch: cast(ascii(ch) as bigint)),
    lambda v, b: xor(v >> 8, crc[1 + (xor(v, b) & 255)]), cast(4294967295 as bigint)))"""

"""Dictionary codes of the star's text columns, both ways, as column expressions.

Fixed values: the regions and nations in code order.  The nations are not in
alphabetical order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
NATIONS = (
    "ALGERIA", "ARGENTINA", "BRAZIL", "CANADA", "EGYPT", "ETHIOPIA", "FRANCE", "GERMANY", "INDIA", "INDONESIA", "IRAN", "IRAQ", "JAPAN",
    "JORDAN", "KENYA", "MOROCCO", "MOZAMBIQUE", "PERU", "CHINA", "ROMANIA", "SAUDI ARABIA", "VIETNAM", "RUSSIA", "UNITED KINGDOM", "UNITED STATES",
)
CATEGORIES_PER_MFGR, BRANDS_PER_CATEGORY, CITIES_PER_NATION, CITY_STEM = 5, 40, 10, 9


def _position(names: tuple[str, ...], c: Column) -> Column:
    """Index of a name; null if it is none of them."""
    at = F.array_position(F.array(*map(F.lit, names)), c)
    return F.when(at > 0, (at - 1).cast("int"))


def _name(names: tuple[str, ...], code: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, names)), F.when((code >= 0) & (code < len(names)), code + 1).cast("int"))


def encode_region(c: Column) -> Column:
    return _position(REGIONS, c)


def decode_region(code: Column) -> Column:
    return _name(REGIONS, code)


def encode_nation(c: Column) -> Column:
    return _position(NATIONS, c)


def decode_nation(code: Column) -> Column:
    return _name(NATIONS, code)


def encode_city(city: Column, nation: Column) -> Column:
    """A city is the first nine characters of its nation, padded, and a digit."""
    return (encode_nation(nation) * CITIES_PER_NATION + F.right(city, F.lit(1)).try_cast("int")).cast("int")


def decode_city(code: Column) -> Column:
    stem = F.rpad(F.substring(decode_nation(F.floor(code / CITIES_PER_NATION)), 1, CITY_STEM), CITY_STEM, " ")
    return F.concat(stem, F.pmod(code, F.lit(CITIES_PER_NATION)).cast("string"))


def encode_mfgr(c: Column) -> Column:
    return (F.regexp_extract(c, r"^MFGR#(\d)", 1).try_cast("int") - 1).cast("int")


def encode_category(c: Column) -> Column:
    return (encode_mfgr(c) * CATEGORIES_PER_MFGR + F.regexp_extract(c, r"^MFGR#\d(\d)", 1).try_cast("int") - 1).cast("int")


def encode_brand(c: Column) -> Column:
    return (encode_category(c) * BRANDS_PER_CATEGORY + F.regexp_extract(c, r"^MFGR#\d\d(\d+)", 1).try_cast("int") - 1).cast("int")


def decode_mfgr(code: Column) -> Column:
    return F.concat(F.lit("MFGR#"), (code + 1).cast("int").cast("string"))


def decode_category(code: Column) -> Column:
    return F.concat(decode_mfgr(F.floor(code / CATEGORIES_PER_MFGR)), (F.pmod(code, F.lit(CATEGORIES_PER_MFGR)) + 1).cast("int").cast("string"))


def decode_brand(code: Column) -> Column:
    return F.concat(decode_category(F.floor(code / BRANDS_PER_CATEGORY)), (F.pmod(code, F.lit(BRANDS_PER_CATEGORY)) + 1).cast("int").cast("string"))

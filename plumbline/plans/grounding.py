"""What the phrases of a program mean over the star schema. Unknown phrases are errors that name what is known."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


class Ungrounded(LookupError):
    pass


@dataclass(frozen=True)
class Entity:
    """A table, its key, and the columns that phrases name."""

    table: str
    key: str
    attributes: dict[str, str] = field(default_factory=dict)
    #: phrase -> (entity, own column, its column)
    links: dict[str, tuple[str, str, str]] = field(default_factory=dict)


SCHEMA: dict[str, Entity] = {
    "regions": Entity("region", "r_regionkey", {"name": "r_name"}, {"nations": ("nations", "r_regionkey", "n_regionkey")}),
    "nations": Entity("nation", "n_nationkey", {"name": "n_name"}, {"region": ("regions", "n_regionkey", "r_regionkey"), "customers": ("customers", "n_nationkey", "c_nationkey"), "suppliers": ("suppliers", "n_nationkey", "s_nationkey")}),
    "customers": Entity("customer", "c_custkey", {"name": "c_name", "balance": "c_acctbal", "segment": "c_mktsegment"}, {"nation": ("nations", "c_nationkey", "n_nationkey"), "orders": ("orders", "c_custkey", "o_custkey")}),
    "suppliers": Entity("supplier", "s_suppkey", {"name": "s_name", "balance": "s_acctbal"}, {"nation": ("nations", "s_nationkey", "n_nationkey")}),
    "parts": Entity("part", "p_partkey", {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "price": "p_retailprice"}),
    "orders": Entity("orders", "o_orderkey", {"status": "o_orderstatus", "total price": "o_totalprice", "date": "o_orderdate", "priority": "o_orderpriority"}, {"customer": ("customers", "o_custkey", "c_custkey"), "lines": ("lines", "o_orderkey", "l_orderkey")}),
    "lines": Entity("lineitem", "l_orderkey", {"quantity": "l_quantity", "extended price": "l_extendedprice", "discount": "l_discount", "flag": "l_returnflag"}),
}


def _bare(phrase: str) -> str:
    return re.sub(r"^(?:the|all|different) ", "", phrase.strip())


def entity_of(phrase: str) -> str:
    name = _bare(phrase)
    if name in SCHEMA:
        return name
    raise Ungrounded(f"no table for {phrase!r}; known: {', '.join(SCHEMA)}")


def attribute_of(entity: str, phrase: str) -> str | tuple[str, str, str]:
    """A column, or a link to another table."""
    known, name = SCHEMA[entity], _bare(phrase)
    if name in known.attributes:
        return known.attributes[name]
    if name in known.links:
        return known.links[name]
    raise Ungrounded(f"no {phrase!r} of {entity}; known: {', '.join([*known.attributes, *known.links])}")


def value_of(text: str) -> Column:
    text = text.strip().strip('"')
    return F.lit(float(text)) if re.fullmatch(r"-?\d+(\.\d+)?", text) else F.lit(text)


def compared(column: Column, op: str, value: Column | str) -> Column:
    if op == "BETWEEN":
        low, high = (value_of(v) for v in re.split(r"\s+AND\s+", value))
        return column.between(low, high)
    v = value if isinstance(value, Column) else F.lit(value) if op in ("start", "end", "LIKE") else value_of(value)
    kinds = {">": lambda: column > v, ">=": lambda: column >= v, "<": lambda: column < v, "<=": lambda: column <= v, "=": lambda: column == v, "!=": lambda: column != v, "start": lambda: column.startswith(v), "end": lambda: column.endswith(v), "LIKE": lambda: column.contains(v)}
    return kinds[op]()


def filter_of(entity: str, phrase: str) -> tuple[str, str]:
    """(column, value) of a phrase such as `from segment AUTOMOBILE` or `with status F`."""
    if m := re.fullmatch(r"(?:from|with|of|in|whose) (?:the )?([a-z ]+?) (?:is )?([^ ].*)", phrase.strip()):
        words = f"{m[1]} {m[2]}".split()
        for k in range(len(words) - 1, 0, -1):
            name = " ".join(words[:k])
            if name in SCHEMA[entity].attributes:
                return SCHEMA[entity].attributes[name], " ".join(words[k:])
    raise Ungrounded(f"no filter {phrase!r} of {entity}; known: from/with/of {', '.join(SCHEMA[entity].attributes)} <value>")

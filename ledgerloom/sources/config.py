"""Replay configuration from XML, and credentials from the environment."""

from __future__ import annotations

import os
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field


@dataclass
class QueryMix:
    freq: int
    tables: list[str]


@dataclass
class ReplayConfig:
    """What a replay needs to know. Group ids are positions; a query's groups come from its tables."""

    is_remote: bool = False
    is_single_group: bool = False
    logical_clock: bool = False
    files: list[str] = field(default_factory=list)
    parse_pool: int = 1
    interval: int = 0
    groups: list[list[str]] = field(default_factory=list)
    pools: list[int] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)
    queries: list[QueryMix] = field(default_factory=list)

    def mode(self) -> str:
        return "logical_clock" if self.logical_clock else "single_group" if self.is_single_group else "grouped"

    def group_of(self, table: str) -> int:
        for i, tables in enumerate(self.groups):
            if table in tables:
                return i
        raise KeyError(f"table {table} is in no group")


def _flag(root: ET.Element, name: str) -> bool:
    return (root.findtext(f".//{name}") or "").strip().lower() in ("1", "true", "yes")


def _texts(node: ET.Element | None, name: str) -> list[str]:
    return [(x.text or "").strip() for x in node.iter(name)] if node is not None else []


def load_config(source: str) -> ReplayConfig:
    """From the path or the text of an XML document. A query over a table of no group is an error."""
    text = source if source.lstrip().startswith("<") else open(source, encoding="utf-8").read()
    root = ET.fromstring(text)
    number = lambda name, default: int((root.findtext(f".//{name}") or str(default)).strip())
    out = ReplayConfig(_flag(root, "is_remote"), _flag(root, "is_single_group"), _flag(root, "mysql_mode"), _texts(root.find(".//files"), "file"), number("parse_pool", 1), number("interval", 0))
    for group in root.iter("group_cfg"):
        out.groups.append(_texts(group, "group_table"))
        out.pools.append(int((group.findtext("pool") or "1").strip()))
    out.tables = _texts(root.find(".//tables"), "table")
    for query in root.iter("query_ferq"):
        tables = _texts(query, "query_tables")
        out.queries.append(QueryMix(int((query.findtext("freq") or "1").strip()), tables))
    declared = root.findtext(".//group_num")
    if declared and int(declared) != len(out.groups):
        raise ValueError(f"{declared} groups are declared and {len(out.groups)} given")
    for query in out.queries:
        for table in query.tables:
            out.group_of(table)
    return out


def connection_options() -> dict[str, str]:
    """JDBC options of the primary, from LEDGERLOOM_JDBC_URL, _USER and _PASSWORD."""
    return {"url": os.environ["LEDGERLOOM_JDBC_URL"], "user": os.environ["LEDGERLOOM_JDBC_USER"], "password": os.environ["LEDGERLOOM_JDBC_PASSWORD"]}

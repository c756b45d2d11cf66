"""Exports at the edge: calendar, graph JSON and a short report, from DataFrames that a limit or a key has made small."""

from __future__ import annotations

import json
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: What a calendar value may not hold as it is.
_ESCAPES = str.maketrans({c: f"\\{c}" for c in "\\;,"} | {"\n": r"\n"})


def escaped(text: str) -> str:
    return text.translate(_ESCAPES)


def folded_line(line: str) -> str:
    """At most 75 octets a line; a continuation begins with a blank, and no character is cut."""
    out, size = [""], 0
    for ch in line:
        n = len(ch.encode())
        if size + n > 75:
            out.append(" ")
            size = 1
        out[-1] += ch
        size += n
    return "\r\n".join(out)


def calendar(facts: DataFrame) -> str:
    """One event for each different (entity_id, key, value) with a date; MM-DD returns each year, others warn a week before."""
    rows = facts.select("entity_id", "name", "key", "value", "date").dropDuplicates(["entity_id", "key", "value"]).where("date is not null").orderBy("date", "entity_id", "key", "value")
    lines = ["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//citegraph//EN"]
    for r in rows.toLocalIterator():
        day = r.date if isinstance(r.date, date) else date.fromisoformat(str(r.date))
        lines += ["BEGIN:VEVENT", f"UID:{r.entity_id}-{r.key}-{r.value}@citegraph", f"DTSTART;VALUE=DATE:{day:%Y%m%d}", f"DTEND;VALUE=DATE:{day + timedelta(days=1):%Y%m%d}"]
        lines.append(f"SUMMARY:{escaped(f'{r.name}: {r.key}')}")
        lines += ["RRULE:FREQ=YEARLY"] if len(r.value) == 5 else ["BEGIN:VALARM", "ACTION:DISPLAY", "TRIGGER:-P7D", "END:VALARM"]
        lines.append("END:VEVENT")
    return "\r\n".join(map(folded_line, [*lines, "END:VCALENDAR"])) + "\r\n"


def graph_json(nodes: DataFrame, edges: DataFrame) -> str:
    """The top nodes and the edges among them."""
    return json.dumps({"nodes": [json.loads(x) for x in nodes.select(F.to_json(F.struct("*"))).toPandas().iloc[:, 0]], "edges": [json.loads(x) for x in edges.select(F.to_json(F.struct("*"))).toPandas().iloc[:, 0]]}, sort_keys=True)


def report(per_source: DataFrame, people: DataFrame, upcoming: DataFrame) -> str:
    lines = ["# Report", "", "## Sources", *(f"- {r.source_id}: {r.n}" for r in per_source.orderBy("source_id").toLocalIterator())]
    lines += ["", "## People", *(f"- {r.name} ({r.items} items)" for r in people.toLocalIterator())]
    lines += ["", "## Upcoming", *(f"- {r.date} {r.name}: {r.key}" for r in upcoming.orderBy("date", "name", "key").toLocalIterator())]
    return "\n".join(lines) + "\n"

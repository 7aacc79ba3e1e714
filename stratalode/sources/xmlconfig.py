"""XML configuration records with exact byte spans."""

from __future__ import annotations

from xml.parsers import expat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rowmap import map_rows

MOST_DEPTH, MOST_RECORDS = 128, 4096
SCHEMA = "path string, ordinal int, record_id string, model string, start_byte bigint, end_byte bigint, field string, attributes map<string,string>, content string, children boolean, error string"


def records(raw: bytes) -> list[dict]:
    """``record`` elements of a file with their fields and byte spans; entities, document types and namespaces are refused."""
    out, stack, now, field = [], [], None, None
    p = expat.ParserCreate()
    p.buffer_text = True

    def refuse(*_):
        raise ValueError("entities and document types are refused")

    def start(name, attrs):
        nonlocal now, field
        if ":" in name or any(a.startswith("xmlns") for a in attrs):
            raise ValueError("namespaces are refused")
        stack.append(name)
        if len(stack) > MOST_DEPTH:
            raise ValueError("nested too deep")
        if name == "record" and now is None:
            now = {"id": attrs.get("id"), "model": attrs.get("model"), "start": p.CurrentByteIndex, "fields": [], "depth": len(stack)}
        elif now is not None and name == "field" and len(stack) == now["depth"] + 1:
            field = {"name": attrs.get("name"), "attributes": dict(attrs), "content": "", "children": False}
        elif field is not None:
            field["children"] = True

    def end(name):
        nonlocal now, field
        if now is not None and name == "field" and len(stack) == now["depth"] + 1:
            now["fields"].append(field)
            field = None
        elif now is not None and name == "record" and len(stack) == now["depth"]:
            close = raw.find(b">", p.CurrentByteIndex) + 1
            out.append({**now, "end": close})
            if len(out) > MOST_RECORDS:
                raise ValueError("too many records")
            now = None
        stack.pop()

    def text(data):
        if field is not None and not field["children"]:
            field["content"] += data

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, text
    p.StartDoctypeDeclHandler = p.EntityDeclHandler = refuse
    p.Parse(raw, True)
    return out


def configuration(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row per field of every record (a record without fields has one with null field); a refused file has one row with its error."""

    def make():
        def row(p, raw):
            try:
                found = records(bytes(raw))
            except (expat.ExpatError, ValueError) as e:
                return [(p, None, None, None, None, None, None, None, None, None, str(e))]
            out = []
            for k, r in enumerate(found):
                for f in r["fields"] or [None]:
                    out.append((p, k, r["id"], r["model"], r["start"], r["end"], f and f["name"], f and list(f["attributes"].items()), f and f["content"], f and f["children"], None))
            return out

        return row

    src = files.where(F.col(content).isNotNull()).select(path, F.col(content).cast("binary").alias("c"))
    return map_rows(src, make, SCHEMA)


def duplicate_ids(fields: DataFrame) -> DataFrame:
    """``record_id, files`` of identities that several records claim."""
    r = fields.where("record_id is not null").select("path", "ordinal", "record_id").distinct()
    return r.groupBy("record_id").agg(F.count("*").alias("records")).where("records > 1")

"""RDF texts as triples: Turtle, RDF/XML and JSON-LD, as far as plain triples go."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
_TOKEN = re.compile(r'#[^\n]*|"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|<[^<>\s]*>|\^\^|@[A-Za-z][\w-]*|[;,.\[\]()]|[^\s;,\[\]()"<>^]+')
Triple = tuple[str, str, str]


def turtle(text: str) -> list[Triple]:
    """Statements with prefixes, `a`, `;` and `,`; a list or an unnamed node raises ValueError."""
    tokens: list[str] = []
    for t in _TOKEN.findall(text):
        if t.startswith("#"):
            continue
        if len(t) > 1 and t.endswith(".") and t[0] not in '"<':
            tokens += [t[:-1], "."]
        else:
            tokens.append(t)
    prefixes, base, out = {}, "", []

    def term(t: str) -> str:
        if t[0] == "<":
            return t[1:-1] if ":" in t else base + t[1:-1]
        if t[0] == '"':
            quotes = 3 if t.startswith('"""') else 1
            return t[quotes:-quotes].encode("latin-1", "backslashreplace").decode("unicode_escape") if "\\" in t else t[quotes:-quotes]
        prefix, colon, name = t.partition(":")
        return prefixes[prefix] + name if colon and prefix in prefixes else t

    place, row = 0, []
    while place < len(tokens):
        t = tokens[place]
        if t.lower().lstrip("@") in ("prefix", "base") and not row:
            named = t.lower().endswith("prefix")
            if named:
                prefixes[tokens[place + 1].rstrip(":")] = term(tokens[place + 2])
            else:
                base = term(tokens[place + 1])
            place += 3 if named else 2
            place += place < len(tokens) and tokens[place] == "."
            continue
        place += 1
        if t in "[]()":
            raise ValueError("not a plain triple")
        if t in (".", ";", ","):
            if len(row) == 3:
                out.append(tuple(row))
            row = {".": [], ";": row[:1], ",": row[:2]}[t]
        elif t == "^^":
            place += 1  # a literal's type
        elif not t.startswith("@"):  # nor its language
            row.append(TYPE if t == "a" and len(row) == 1 else term(t))
    return out


def rdf_xml(text: str) -> list[Triple]:
    """Described nodes with their properties; a node within a property is described, too."""
    out: list[Triple] = []

    def bare(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def describe(node: ET.Element, number: list[int]) -> str:
        number[0] += 1
        subject = node.get(f"{_RDF}about") or node.get(f"{_RDF}ID") or f"_:n{number[0]}"
        if node.tag != f"{_RDF}Description":
            out.append((subject, TYPE, bare(node.tag)))
        for child in node:
            inner = list(child)
            value = child.get(f"{_RDF}resource") or (describe(inner[0], number) if inner else (child.text or "").strip())
            out.append((subject, bare(child.tag), value))
        return subject

    root, number = ET.fromstring(text), [0]
    for node in root if root.tag == f"{_RDF}RDF" else [root]:
        describe(node, number)
    return out


def json_ld(text: str) -> list[Triple]:
    """Nodes with @id, @type and properties; terms are looked up in an inline @context."""
    out: list[Triple] = []
    whole = json.loads(text)
    context = whole.get("@context", {}) if isinstance(whole, dict) else {}
    context = context if isinstance(context, dict) else {}

    def name(term: str) -> str:
        found = context.get(term, term)
        found = found.get("@id", term) if isinstance(found, dict) else found
        prefix, colon, rest = found.partition(":")
        return context[prefix] + rest if colon and isinstance(context.get(prefix), str) else found

    def value(x) -> str:
        if isinstance(x, dict):
            return str(x["@value"]) if "@value" in x else node(x)
        return x if isinstance(x, str) else json.dumps(x)

    def node(x: dict) -> str:
        subject = name(x.get("@id", f"_:n{len(out)}"))
        for key, held in x.items():
            if key == "@type":
                out.extend((subject, TYPE, name(t)) for t in (held if isinstance(held, list) else [held]))
            elif not key.startswith("@"):
                for one in held if isinstance(held, list) else [held]:
                    out.append((subject, name(key), value(one)))
        return subject

    for top in whole if isinstance(whole, list) else whole.get("@graph", [whole]):
        node(top)
    return out


SYNTAX = {"ttl": turtle, "rdf": rdf_xml, "owl": rdf_xml, "xml": rdf_xml, "jsonld": json_ld}


def parsed(name: str, text: str) -> list[Triple]:
    """By the extension, then by any other syntax; nothing if none fits."""
    first = SYNTAX.get(name.rpartition(".")[2].lower())
    for syntax in [first, *(s for s in (turtle, rdf_xml, json_ld) if s is not first)]:
        try:
            if syntax and (found := syntax(text)):
                return found
        except (ValueError, KeyError, IndexError, AttributeError, ET.ParseError):
            continue
    return []


def triples_from_rdf(texts: DataFrame) -> DataFrame:
    """subject, predicate, object, source_file, seq of rows (source_file, value) of RDF text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = parsed(name, text or "")
                yield pa.RecordBatch.from_pydict({k: pa.array([t[i] for t in found], pa.string()) for i, k in enumerate(("subject", "predicate", "object"))} | {"source_file": pa.array([name] * len(found), pa.string()), "seq": pa.array(range(len(found)), pa.int64())})

    return texts.select("source_file", "value").mapInArrow(task, "subject string, predicate string, object string, source_file string, seq long")

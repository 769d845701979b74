"""Configuration files in XML: objects, their structure and links, forms, subscriptions, rights and manifests.

Two dialects hold the same facts: one with elements like `Attribute/Properties/Name` and types `cfg:KindRef.Name`, and one with
elements like `attributes/name` and types `KindRef.Name`. Both give rows of one shape, (path, fact, owner, name, target, kind,
detail), from which the tables of the derived layer are selected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("path", "fact", "owner", "name", "target", "kind", "detail")
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)
#: Sections of an object with the kind of link that their types make, in both dialects; singular of folders.
SECTIONS = {"Attribute": "attr", "Resource": "attr", "Dimension": "register_dim", "attributes": "attr", "resources": "attr", "dimensions": "register_dim"}
TABLES = ("TabularSection", "tabularSections")
FOLDERS = {
    "Catalogs": "Catalog", "Documents": "Document", "InformationRegisters": "InformationRegister", "AccumulationRegisters": "AccumulationRegister", "Enums": "Enum", "Reports": "Report",
    "DataProcessors": "DataProcessor", "CommonForms": "CommonForm", "ExchangePlans": "ExchangePlan", "Roles": "Role", "Constants": "Constant", "BusinessProcesses": "BusinessProcess", "Tasks": "Task",
}
#: Targets of one attribute beyond which they are told as many.
MANY = 30


def _tree(text: str) -> ElementTree.Element:
    """The document without name-space prefixes, declared or not."""
    bare = re.sub(r"(</?)[\w.-]+:(?=\w)", r"\1", text)
    bare = re.sub(r'(\s)(?:[\w.-]+:)?xmlns(?::[\w.-]+)?\s*=\s*"[^"]*"', r"\1", bare)
    return ElementTree.fromstring(re.sub(r"(\s)[\w.-]+:(\w+\s*=)", r"\1\2", bare).encode())


def _text(node: ElementTree.Element | None, *names: str) -> str | None:
    """Text of the first child path that exists: Properties are looked into as well."""
    for name in names:
        for place in (f"Properties/{name}", name):
            found = node.find(place) if node is not None else None
            if found is not None and (found.text or "").strip():
                return found.text.strip()
    return None


def _synonym(node: ElementTree.Element) -> str | None:
    """The Russian synonym, or else the first."""
    pairs = []
    for item in [*node.findall("Properties/Synonym/item"), *node.findall("synonym")]:
        said = item.findtext("content") or item.findtext("value")
        if said:
            pairs.append((item.findtext("lang") or item.findtext("key") or item.get("lang"), said.strip()))
    return next((t for lang, t in pairs if lang == "ru"), pairs[0][1] if pairs else None)


def target_of(kind: str) -> str | None:
    """`cfg:CatalogRef.X` to Catalog.X, `cfg:CatalogRef` to *Catalog, any reference to *Any; other types to None."""
    bare = kind.strip().rpartition(":")[2]
    if bare.startswith("DefinedType."):
        return bare
    if bare == "AnyRef":
        return "*Any"
    m = re.fullmatch(r"(\w+?)(?:Ref|Object)(?:\.(.+))?", bare)
    return None if m is None else f"{m[1]}.{m[2]}" if m[2] else f"*{m[1]}"


def _types(node: ElementTree.Element) -> list[str]:
    found = [x.text for place in ("Properties/Type", "Type", "type") for t in node.findall(place) for x in t.iter() if x is not t and x.text and x.tag in ("Type", "types", "TypeSet")]
    return [x.strip() for x in found if x.strip()]


def _owner(path: str) -> str | None:
    """Type.Name from the folders of a path."""
    parts = path.replace("\\", "/").split("/")
    at = next((i for i, p in enumerate(parts[:-1]) if p in FOLDERS), None)
    return None if at is None else f"{FOLDERS[parts[at]]}.{re.sub(r'[.](xml|mdo)$', '', parts[at + 1])}"


def _object(top: ElementTree.Element, kind: str) -> Iterator[tuple]:
    name = _text(top, "Name", "name")
    if name is None:
        return
    full = f"{kind}.{name}"
    yield "object", full, name, None, kind, _synonym(top)
    if top.get("uuid"):
        yield "uuid", full, name, None, kind, top.get("uuid")

    def fields(node: ElementTree.Element, inside: str | None) -> Iterator[tuple]:
        for child in [*node.findall("ChildObjects/*"), *[x for x in node if x.tag in SECTIONS or x.tag in TABLES]]:
            own = _text(child, "Name", "name")
            if own is None:
                continue
            if child.tag in TABLES:
                yield "field", full, own, None, "tabular_section", None
                yield from fields(child, own)
            elif child.tag in SECTIONS:
                place = f"{inside}.{own}" if inside else own
                types = _types(child)
                yield "field", full, place, None, child.tag, ", ".join(types)
                link = "tabular_attr" if inside else SECTIONS[child.tag]
                targets = list(dict.fromkeys(t for x in types if (t := target_of(x))))
                for t in targets if len(targets) <= MANY else ["*Multiple"]:
                    yield "link", full, place, t, link, "composite" if len(targets) > 1 else None

    yield from fields(top, None)
    lists = (("RegisterRecords", "registerRecords", "recorder"), ("Owners", "owners", "owner"))
    for one, two, link in lists:
        items = [x.text for x in top.findall(f"Properties/{one}/*")] + [x.text for x in top.findall(two)]
        for item in dict.fromkeys(x.strip() for x in items if x and x.strip()):
            yield "link", full, "", item, link, None
    if kind == "Subsystem":
        for item in [*top.findall("Properties/Content/Item"), *top.findall("content")]:
            if (item.text or "").strip():
                yield "link", full, "", item.text.strip(), "subsystem_content", None
    if kind == "DefinedType":
        for t in dict.fromkeys(t for x in _types(top) if (t := target_of(x))):
            yield "link", full, "", t, "defined_type_content", None
    if kind == "FunctionalOption":
        for item in [*top.findall("Properties/Content/Object"), *top.findall("content")]:
            if (item.text or "").strip():
                yield "link", full, "", ".".join(item.text.strip().split(".")[:2]), "functional_option_content", item.text.strip()
        place = _text(top, "Location", "location")
        if place:
            yield "link", full, "", ".".join(place.split(".")[:2]), "functional_option_location", place
    if kind == "EventSubscription":
        handler = _text(top, "Handler", "handler") or ""
        module, _, proc = re.sub(r"^CommonModule\.", "", handler).rpartition(".")
        sources = [x.text.strip() for place in ("Properties/Source", "source") for s in top.findall(place) for x in s.iter() if x.text and x.text.strip()]
        named = [re.sub(r"^[^:]*:", "", x) for x in sources]
        yield "subscription", module, name, proc, _text(top, "Event", "event"), "\n".join(named)


def _form(top: ElementTree.Element, path: str) -> Iterator[tuple]:
    parts = path.replace("\\", "/").split("/")
    form = parts[parts.index("Forms") + 1] if "Forms" in parts[:-1] else None

    def walk(node: ElementTree.Element, element: str | None) -> Iterator[tuple]:
        for child in node:
            if child.tag == "Event" and (child.text or "").strip():
                yield "handler", _owner(path), form, child.text.strip(), child.get("name"), element
            elif child.tag == "handlers":
                if child.findtext("event") and child.findtext("name"):
                    yield "handler", _owner(path), form, child.findtext("name"), child.findtext("event"), element
            else:
                yield from walk(child, child.get("name") or child.findtext("name") or element)

    yield from walk(top, None)


def _rights(top: ElementTree.Element, path: str) -> Iterator[tuple]:
    role = (_owner(path) or "").removeprefix("Role.")
    for thing in top.iter("object"):
        for right in thing.findall("right"):
            if (right.findtext("value") or "").strip() == "true":
                yield "right", role, None, (thing.findtext("name") or "").strip(), (right.findtext("name") or "").strip(), None


def facts(path: str, text: str | None) -> list[tuple]:
    """Rows of one file; none if it isn't well-formed or of no known kind."""
    try:
        top = _tree(text or "")
    except ElementTree.ParseError:
        return []
    if top.tag == "MetaDataObject":
        rows = [r for child in top for r in _object(child, child.tag)]
    elif top.tag == "Form" or path.endswith(".form"):
        rows = list(_form(top, path))
    elif top.tag == "Rights" or path.endswith(".rights"):
        rows = list(_rights(top, path))
    elif top.tag == "ExchangePlanContent":
        found = (x.strip() for item in top.findall("Item") if (x := item.findtext("Metadata")))
        rows = [("link", _owner(path), "", x, "exchange_plan_content", None) for x in found]
    elif top.tag == "ConfigDumpInfo":
        rows = [("manifest", None, m.get("name"), None, None, m.get("configVersion")) for m in top.iter("Metadata") if m.get("name") and m.get("configVersion")]
    elif path.endswith(".mdo"):
        rows = list(_object(top, top.tag))
    else:
        rows = []
    return [(path, *r) for r in rows]


def read(files: DataFrame) -> DataFrame:
    """All facts of (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in facts(p, t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(COLUMNS))], names=list(COLUMNS))

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def metadata_objects(rows: DataFrame) -> DataFrame:
    """(full_name, meta_type, name, synonym, full_name_key), one for each object: a synonym is kept if any file has one."""
    found = rows.filter("fact = 'object'").groupBy("owner").agg(F.min("kind").alias("meta_type"), F.min("name").alias("name"), F.min("detail").alias("synonym"))
    return found.select(F.col("owner").alias("full_name"), "meta_type", "name", "synonym", F.lower("owner").alias("full_name_key"))


def data_links(rows: DataFrame) -> DataFrame:
    """(from_object, from_path, to_object, link_kind, is_composite, is_universal, to_object_key), distinct."""
    found = rows.filter("fact = 'link'").select(F.col("owner").alias("from_object"), F.col("name").alias("from_path"), F.col("target").alias("to_object"), F.col("kind").alias("link_kind"), F.coalesce(F.col("detail") == "composite", F.lit(False)).alias("is_composite"))
    return found.distinct().withColumns({"is_universal": F.col("to_object").startswith("*"), "to_object_key": F.lower("to_object")})


def metadata_forms(rows: DataFrame) -> DataFrame:
    """(owner_full_name, form_name, handlers_json)."""
    entry = F.struct(F.col("kind").alias("event"), F.col("target").alias("handler"), F.col("detail").alias("element"))
    return rows.filter("fact = 'handler'").groupBy(F.col("owner").alias("owner_full_name"), F.col("name").alias("form_name")).agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("handlers_json"))


def event_subscriptions(rows: DataFrame) -> DataFrame:
    """(name, event, handler_module, handler_proc, sources_json)."""
    return rows.filter("fact = 'subscription'").select("name", F.col("kind").alias("event"), F.col("owner").alias("handler_module"), F.col("target").alias("handler_proc"), F.to_json(F.array_remove(F.split("detail", "\n"), "")).alias("sources_json"))


def role_rights(rows: DataFrame) -> DataFrame:
    """(role_name, object_name, right_name, object_name_key), distinct."""
    found = rows.filter("fact = 'right'").select(F.col("owner").alias("role_name"), F.col("target").alias("object_name"), F.col("kind").alias("right_name"))
    return found.distinct().withColumn("object_name_key", F.lower("object_name"))


def structures(rows: DataFrame) -> DataFrame:
    """(full_name, attributes_json): fields by section, the first definition of a field by path."""
    first = rows.filter("fact = 'field'").groupBy("owner", "name").agg(F.min_by(F.struct("kind", "detail"), "path").alias("d"))
    entry = F.struct(F.col("name"), F.col("d.detail").alias("type"))
    by = first.groupBy("owner", F.lower(F.regexp_replace("d.kind", "s$", "")).alias("section")).agg(F.array_sort(F.collect_list(entry)).alias("fields"))
    return by.groupBy(F.col("owner").alias("full_name")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "fields"))))).alias("attributes_json"))


def manifest(rows: DataFrame) -> DataFrame:
    """(full_name, config_version)."""
    return rows.filter("fact = 'manifest'").select(F.col("name").alias("full_name"), F.col("detail").alias("config_version")).distinct()

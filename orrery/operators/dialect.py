"""A dialect of business modules: procedures with directives and overrides, platform events, and what a changed file touches."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from orrery.operators.extract import Rows

#: Directives by which an extension overrides a procedure, in both spellings.
OVERRIDES = {
    "перед": "Перед", "before": "Перед", "после": "После", "after": "После", "вместо": "Вместо", "around": "Вместо",
    "изменениеиконтроль": "ИзменениеИКонтроль", "changeandvalidate": "ИзменениеИКонтроль",
}
#: Platform names of events and the names that answers give them.
EVENTS = {
    "BeforeWrite": "ПередЗаписью",
    "OnWrite": "ПриЗаписи",
    "AfterWrite": "ПослеЗаписи",
    "BeforeDelete": "ПередУдалением",
    "OnCopy": "ПриКопировании",
    "Filling": "ОбработкаЗаполнения",
    "FillCheckProcessing": "ОбработкаПроверкиЗаполнения",
    "Posting": "ОбработкаПроведения",
    "UndoPosting": "ОбработкаУдаленияПроведения",
    "OnSetNewNumber": "ПриУстановкеНовогоНомера",
    "OnSetNewCode": "ПриУстановкеНовогоКода",
    "FormGetProcessing": "ОбработкаПолученияФормы",
    "PresentationGetProcessing": "ОбработкаПолученияПредставления",
    "PresentationFieldsGetProcessing": "ОбработкаПолученияПолейПредставления",
    "OnSendDataToMaster": "ПриОтправкеДанныхГлавному",
    "OnSendDataToSlave": "ПриОтправкеДанныхПодчиненному",
    "OnSendNodeDataToSlave": "ПриОтправкеДанныхУзлаПодчиненному",
    "OnReceiveDataFromMaster": "ПриПолученииДанныхОтГлавного",
    "OnReceiveDataFromSlave": "ПриПолученииДанныхОтПодчиненного",
    "BeforeDeleteAtServer": "ПередУдалениемНаСервере",
    "ChoiceDataGetProcessing": "ОбработкаПолученияДанныхВыбора",
    "OnCopyAtServer": "ПриКопированииНаСервере",
}
#: Words before a parenthesis that are no calls.
_WORDS = "если иначеесли пока для каждого возврат не и или новый if elsif while for each return not and or new".split()
_HEAD = re.compile(r"(?im)^[ \t]*(?:(?:асинх|async)\s+)?(процедура|функция|procedure|function)\s+(\w+)\s*(\([^)]*\))?[ \t]*(?:(экспорт|export)\b)?")
_TAIL = re.compile(r"(?im)^[ \t]*(?:конецпроцедуры|конецфункции|endprocedure|endfunction)\b")
_MARK = re.compile(r'&(\w+)\s*(?:\(\s*"([^"]*)"\s*\))?\s*$')
_CALL = re.compile(r"(?<![\w.&])(\w+(?:\.\w+)*)[ \t]*\(|\)\s*\.\s*(\w+)[ \t]*\(")
_VARIABLES = re.compile(r"(?im)^[ \t]*(?:перем|var)\s+([^;]+);")


def module(text: str, rows: Rows) -> None:
    """Procedures with their arguments (marked when exported) and directive, overrides (name, target and kind), calls glued to what
    they are called on, and variables of the module."""
    hide = lambda s: re.sub(r"[^\n]", " ", s)
    bare = re.sub(r'//[^\n]*|"(?:[^"]|"")*"', lambda m: hide(m[0]), text)
    starts = [0, *[m.end() for m in re.finditer("\n", text)]]
    line = lambda at: bisect_right(starts, at)
    spans: list[tuple[int, int, int, str]] = []
    for m in _HEAD.finditer(bare):
        if spans and m.start() < spans[-1][1]:
            continue
        tail = _TAIL.search(bare, m.end())
        at, end = m.start(1), tail.end() if tail else len(text)
        args = text[m.start(3) : m.end(3)] if m[3] else None
        if m[4]:
            args = f"{args or '()'} Export"
        before = text[: m.start()].rstrip().rsplit("\n", 1)[-1].strip()
        mark = _MARK.match(before)
        rows.add("function", m[2], line(at), line(end - 1), detail=args, kind=f"&{mark[1]}" if mark else None, body=text[at:end])
        if mark and (kind := OVERRIDES.get(mark[1].lower())):
            rows.add("override", m[2], line(at), qualified=mark[2], kind=kind)
        spans.append((at, end, m.end(), m[2]))
    for m in _CALL.finditer(bare):
        inside = next((s for s in spans if s[0] <= m.start() < s[1]), None)
        name = m[1] or m[2]
        if name.lower() not in _WORDS and not (inside and m.start() < inside[2]):
            rows.add("call", name, line(m.start()), caller=inside[3] if inside else "<module>")
    for m in _VARIABLES.finditer(bare):
        if not any(a <= m.start() < b for a, b, _, _ in spans):
            for name in re.findall(r"\w+", re.sub(r"(?i)\b(экспорт|export)\b", "", m[1])):
                rows.add("variable", name, line(m.start()))


def overrides(entities: DataFrame) -> DataFrame:
    """(target_key, name): what call_graph() takes, from the entity rows of modules."""
    return entities.filter("entity = 'override' AND qualified_name IS NOT NULL").select(F.col("qualified_name").alias("target_key"), "name")


def event_name(event: Column) -> Column:
    """The name of an event in answers; an unknown one stays as it is."""
    table = F.create_map(*[F.lit(x) for pair in EVENTS.items() for x in pair])
    return F.coalesce(table[event], event)


def touched(path: Column) -> Column:
    """What a changed file of a configuration has to be done again for: an array of parts of the derived layer, by its path.

    Rights of a role and the sources of links between objects count besides what the file is itself.
    """
    parts = F.split(path, "/")
    name, folder = F.element_at(parts, -1), F.get(parts, F.size(parts) - 2)
    under = lambda x: F.array_contains(F.slice(parts, F.lit(1), F.size(parts) - 1), x)
    xml = F.lower(name).endswith(".xml")
    own = (
        F.when(F.lower(name).endswith(".bsl"), "code")
        .when(name == "ConfigDumpInfo.xml", "manifest")
        .when(name == "Form.xml", "form")
        .when(xml & (folder == "Templates"), "template")
        .when(xml & (folder == "EventSubscriptions"), "subscription")
        .when(xml & folder.rlike(r"^\p{Lu}\p{L}+s$") & ~folder.isin("Subsystems", "Roles", "DefinedTypes", "FunctionalOptions"), "object")
    )
    rights = F.when((name == "Rights.xml") & under("Roles"), "rights")
    links = under("Subsystems") | under("DefinedTypes") | under("FunctionalOptions") | ((name == "Content.xml") & under("ExchangePlans"))
    return F.array_compact(F.array(rights, F.when(links, "links"), own))


def routed(changes: DataFrame) -> DataFrame:
    """(path, kind, part): a row for each part that a change of a file touches; files that touch none are left out."""
    return changes.select("path", "kind", F.explode(touched(F.col("path"))).alias("part"))

"""Answers that fit a budget: driver-side shaping of gathered results. Nothing here touches a DataFrame."""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Callable, Iterable

#: Bytes of an answer: the default and the most that a caller may ask for.
BUDGET, HARD = 48_000, 4 * 48_000
STEPS, MAP_KEYS = 256, 16
PLUMBING = frozenset(("id", "file_id", "node_hash", "content_hash", "indexed_at"))


def size(value: object) -> int:
    return len(json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=str).encode())


def clamp_budget(asked: int | None) -> int:
    return BUDGET if not asked or asked < 1 else min(asked, HARD)


def strip(value: object, names: frozenset[str] = PLUMBING) -> object:
    """Without plumbing keys, at any depth."""
    if isinstance(value, dict):
        return {k: strip(v, names) for k, v in value.items() if k not in names}
    return [strip(v, names) for v in value] if isinstance(value, list) else value


def _arrays(value: object, holder: dict | None = None, name: str = "") -> Iterable[tuple[int, dict, str]]:
    if isinstance(value, list):
        if holder is not None and len(value) > 1:
            yield size(value), holder, name
        for x in value:
            yield from _arrays(x)
    elif isinstance(value, dict):
        for k, v in list(value.items()):
            yield from _arrays(v, value, k)


def cap(answer: dict, budget: int = BUDGET) -> dict:
    """Halve the heaviest array until the answer fits; its first length stays as <name>_total."""
    for _ in range(STEPS):
        if size(answer) <= budget:
            break
        heavy = max(_arrays(answer), key=lambda x: x[0], default=None)
        if heavy is None:
            break
        _, holder, name = heavy
        rows = holder[name]
        holder.setdefault(f"{name}_total", len(rows))
        holder[f"{name}_truncated"] = True
        holder[name] = rows[: max(1, len(rows) // 2)]
    return answer


def omit_sections(answer: dict, budget: int = BUDGET) -> dict:
    """Drop the heaviest section whole until the answer fits: arrays of more than one entry, maps of many keys."""
    while size(answer) > budget:
        heavy = [(size(v), k) for k, v in answer.items() if (isinstance(v, list) and len(v) > 1) or (isinstance(v, dict) and len(v) > MAP_KEYS)]
        if not heavy:
            break
        _, name = max(heavy)
        gone = answer.pop(name)
        answer.setdefault("_omitted", []).append(name)
        answer.setdefault("_count", {})[name] = len(gone)
    return answer


def shrink_results(answer: dict, name: str = "results", budget: int = BUDGET) -> dict:
    """Sections within the items first, then fewer items, one at least."""
    items = answer.get(name, [])
    if size(answer) > budget:
        for item in items:
            if isinstance(item, dict):
                omit_sections(item, max(200, budget // max(1, len(items))))
    total = len(items)
    while size(answer) > budget and len(answer[name]) > 1:
        answer[name] = answer[name][: max(1, len(answer[name]) // 2)]
        answer[f"{name}_total"], answer["truncated"] = total, True
    return answer


def fold(full: dict, folded: dict, budget: int = BUDGET) -> dict:
    return full if size(full) <= budget else folded


def page(items: list[object], budget: int = BUDGET, offset: int = 0) -> tuple[list[object], bool]:
    """Items from an offset on for as long as they fit; one at least. And whether there are more."""
    out, used = [], 0
    for item in items[offset:]:
        used += size(item) + 1
        if out and used > budget - 2000:
            return out, True
        out.append(item)
    return out, False


def file_map(entries: list[dict], most: int = 120) -> dict:
    """Few entries as they are; many as columns."""
    if len(entries) <= most:
        return {"entries": entries}
    names = list(dict.fromkeys(k for e in entries for k in e))
    return {"columns": names, "rows": [[e.get(n) for n in names] for e in entries], "note": "compact"}


def cache_key(repo: str, tool: str, arguments: dict) -> str:
    """Equal for equal arguments in any order."""
    own = json.dumps({k: v for k, v in arguments.items() if k != "repo"}, sort_keys=True, default=str)
    return f"{repo}|{tool}|{hashlib.sha256(own.encode()).hexdigest()}"


class AnswerCache:
    """Answers by key until their files change, their time is up or the repository moves on."""

    def __init__(self, most: int = 1000, seconds: float = 15.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.most, self.seconds, self.clock = most, seconds, clock
        self._held: OrderedDict[str, tuple[object, frozenset[str], float, int]] = OrderedDict()
        self._epochs: dict[str, int] = {}

    def epoch(self, repo: str) -> int:
        return self._epochs.get(repo, 0)

    def put(self, repo: str, key: str, value: object, files: Iterable[str], epoch: int) -> bool:
        """Refused if the repository changed since `epoch`, when the answer was begun."""
        if epoch != self.epoch(repo):
            return False
        self._held[key] = (value, frozenset(files), self.clock(), epoch)
        self._held.move_to_end(key)
        while len(self._held) > self.most:
            self._held.popitem(last=False)
        return True

    def get(self, key: str) -> object | None:
        found = self._held.get(key)
        if found is None:
            return None
        value, files, at, _ = found
        if not files and self.clock() - at > self.seconds:
            del self._held[key]
            return None
        return value

    def changed(self, repo: str, paths: Iterable[str]) -> int:
        """Forget answers that depend on the paths; answers begun before aren't taken any more."""
        self._epochs[repo] = self.epoch(repo) + 1
        gone = set(paths)
        keys = [k for k, (_, files, _, _) in self._held.items() if k.startswith(f"{repo}|") and files & gone]
        for k in keys:
            del self._held[k]
        return len(keys)


class Delivered:
    """Rows that a session has had already, by tool and repository; bounded in rows and sessions."""

    def __init__(self, rows: int = 50_000, sessions: int = 2_000) -> None:
        self.rows, self._sessions, self._held = rows, sessions, OrderedDict()

    def fresh(self, session: str, scope: str, items: list[object]) -> tuple[list[object], int]:
        """Items not sent before, and how many were left out."""
        seen: OrderedDict[bytes, None] = self._held.setdefault(session, OrderedDict())
        self._held.move_to_end(session)
        while len(self._held) > self._sessions:
            self._held.popitem(last=False)
        out = []
        for item in items:
            mark = hashlib.sha256(f"{scope}|{json.dumps(item, sort_keys=True, default=str)}".encode()).digest()[:8]
            if mark not in seen:
                out.append(item)
                seen[mark] = None
                if len(seen) > self.rows:
                    seen.popitem(last=False)
        return out, len(items) - len(out)
